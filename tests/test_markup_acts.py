"""Acts from markup: heading levels, schedules, endnotes, subsections by class, containers, anchored sections."""

import io
import zipfile

import pytest

from lodestrata.operators import markup_acts

TAIL = " with enough words to make a unit of it."
ACT = "doc_id long, economy string, act_name string, act_ref string, law_number_ref string, last_amended string, source_url string"
ROW = (1, "Australia", "Word Act", "REF", None, None, "https://x")


def head(level, inner):
    return f'<p id="nav" class="ActHead{level}">{inner}</p>'


def section(number, heading, body):
    return head(5, f'<a><span class="CharSectno">{number}</span><span>&#xa0; </span><span>{heading}</span></a>') + f"<p class='subsection'>{body}</p>"


@pytest.fixture(scope="module")
def acts(spark):
    return spark.createDataFrame([ROW], ACT)


def units(spark, acts, *parts):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(parts)], "doc_id long, page long, text string")
    return {r.article_section: r for r in markup_acts.parse(rows, acts).collect()}


def test_only_blocks_of_their_class_begin_subsections(spark, acts):
    got = units(spark, acts, head(2, "Part 1—First") + section("5", "Meaning", "(1) A word means what subsection (2) says" + TAIL) + "<p class='paragraph'>(a) one item</p><p class='SubsectionHead'>Topic</p><p class=\"subsection\">(3A) A later one" + TAIL + "</p>")
    assert set(got) == {"s. 5(1)", "s. 5(3A)"} and got["s. 5(1)"].id == "au:REF:s5-1"
    one = got["s. 5(1)"]
    assert one.text.endswith("(a) one item") and one.hierarchy_labels == ["a"] and one.heading == "Meaning" and one.part == "Part 1—First" and one.anchor == "nav"
    assert "Topic" in one.raw_context and [b["class"] for b in one.semantic_blocks] == ["subsection", "paragraph"]


def test_schedules_decimals_levels_and_endnotes(spark, acts):
    got = units(
        spark, acts,
        head(1, "Chapter 2—Controls") + head(2, "Part 3—Duties") + head(3, "Division 4—Keeping") + '<p class="TOC5"><span>12</span><span> Keep words</span></p>' + section("12", "Keep words", "One must keep" + TAIL),
        head(1, "Schedule&#xa0;1—Forms") + section("5", "Clause", "A clause" + TAIL) + head(2, "Part 1—Inner") + section("6", "Clause", "A clause too" + TAIL) + section("474.17", "Code", "A code rule" + TAIL),
        head(1, "Chapter 3—Other") + section("7", "After", "After it" + TAIL) + section("8", "Short", "short") + head(5, "no number") + head(1, "Endnotes") + section("99", "History", "No law" + TAIL),
    )
    assert set(got) == {"s. 12", "Sch 1, cl. 5", "Sch 1, cl. 6", "s. 474.17", "s. 7"}
    assert got["s. 12"].hierarchy_path == ["Chapter 2—Controls", "Part 3—Duties", "Division 4—Keeping", "Keep words"] and got["s. 12"].toc_hint == "Keep words" and got["s. 12"].division == "Division 4—Keeping"
    assert got["Sch 1, cl. 5"].id == "au:REF:sch1-cl5" and got["Sch 1, cl. 6"].part == "Part 1—Inner" and got["s. 7"].hierarchy_path == ["Chapter 3—Other", "After"] and got["s. 7"].schedule is None


def test_nothing_to_parse(spark, acts):
    assert units(spark, acts, None, "", "<p>plain</p>" + TAIL) == {}
    assert units(spark, acts.limit(0), section("1", "A", "B" + TAIL)) == {}


def test_containers(spark, acts):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a/one.xhtml", section("1", "One", "First" + TAIL))
        z.writestr("a/style.css", "p {}")
        z.writestr("b/two.html", section("2", "Two", "Second é" + TAIL).encode())
    files = spark.createDataFrame([(1, held.getvalue()), (2, b"no zip"), (3, None)], "doc_id long, content binary")
    parts = markup_acts.containers(files)
    assert [(r.doc_id, r.page) for r in parts.orderBy("page").collect()] == [(1, 0), (1, 1)]
    assert {r.article_section for r in markup_acts.parse(parts, acts).collect()} == {"s. 1", "s. 2"}


def test_blocks_know_their_place(spark):
    text = "x<p>One &amp; two</p> <P class='Toc5 big' id='k'>Three<br/>four</P>"
    got = [tuple(r) for r in markup_acts.blocks(spark.createDataFrame([(1, 0, text)], "doc_id long, page long, text string")).collect()]
    assert [(r[5], r[8], r[9]) for r in got] == [("plain", None, "One & two"), ("toc5", "k", "Three four")]
    assert [text[r[3] : r[4]][:2].lower() for r in got] == ["<p", "<p"]


PAGE = (
    '<title>Word Act - Portal</title>Current version as at 5 Jul 2024<td class="partNo">PART 6</td><td class="partHdr">CARE</td>'
    '<div class="prov1"><td class="prov1Hdr" id="pr26-"><span>Moving</span></td><td><strong>26.</strong><a name="pr26-ps1-"></a>—(1) One &amp; two <a name="pr26-ps2A-"></a>(2A) Three, except four</td></div>'
    '<div class="prov1"><td class="prov1Hdr" id="pr27A-">Solo</td><td>Whole body</td></div><div class="prov1">no id</div><div class="prov1"><td class="prov1Hdr" id="Sc1-">Sched</td><td></td></div>'
)


def test_anchored_sections(spark, acts):
    sections = markup_acts.anchored_sections(spark.createDataFrame([(1, PAGE), (2, None)], "doc_id long, text string"), " - Portal")
    got = {r.sec_id: r for r in sections.collect()}
    assert set(got) == {"pr26-", "pr27A-", "Sc1-"} and got["pr26-"].part == "PART 6 CARE" and got["Sc1-"].subsections == []
    assert [tuple(s) for s in got["pr26-"].subsections] == [("26(1)", "(1) One & two", "pr26-ps1-"), ("26(2A)", "(2A) Three, except four", "pr26-ps2A-")]
    assert got["pr27A-"].section_number == "27A" and got["pr27A-"].text == "Whole body"
    units = {r.id: r for r in markup_acts.section_units(sections, acts).collect()}
    assert set(units) == {"australia:REF:pr26-ps1-", "australia:REF:pr26-ps2A-", "australia:REF:pr27A-"}
    one = units["australia:REF:pr26-ps2A-"]
    assert (one.law_name, one.article_section, one.source_url, one.current_as_at) == ("Word Act", "s. 26(2A)", "https://x#pr26-", "5 Jul 2024")
    assert [c.role for c in one.rule_components] == ["principal_rule", "exception"] and one.raw_context == "(1) One & two\n(2A) Three, except four"


def test_a_part_gives_a_row_for_each_heading_and_what_stands_before_it_goes_back(spark, acts):
    head = lambda n: f'<p class="ActHead5" id="i{n}"><span class="CharSectno">{n}</span> Title</p>'
    long = "that is said at some length, by which it is a unit"
    pages = [f'<p class="toc5">1 Listed</p>{head(1)}<p class="subsection">(1) One {long}</p><p>(a) more</p>', f'<p class="subsection">(2) Two {long}</p>', f"<P CLASS='Subsection'>(3) Thr&eacute;e {long}</P>{head(2)}<p>Last {long}</p>"]
    assert [(x[1], x[2], len(x[9])) for x in markup_acts._fragments(2, pages[2])] == [(0, None, 1), (1, 5, 1)]
    doc = acts.select("doc_id").first()[0]
    rows = spark.createDataFrame([(doc, k, t) for k, t in enumerate(pages)], acts.select("doc_id").schema.add("page", "long").add("text", "string"))
    units = {r.article_section: (r.text.split(" that")[0], r.toc_hint, r.anchor) for r in markup_acts.parse(rows, acts).collect()}
    assert units == {"s. 1(1)": ("(1) One", "Listed", "i1"), "s. 1(2)": ("(2) Two", "Listed", "i1"), "s. 1(3)": ("(3) Thrée", "Listed", "i1"), "s. 2": ("Last", None, "i2")}


def test_parts_are_told_in_one_pass_and_a_section_is_shuffled_without_its_text(spark, acts):
    mark = lambda kind, said: f'<td class="part{kind} x">{said}</td>'
    section = lambda n: f'<div class="prov1"><td class="prov1Hdr" id="pr{n}-">H</td><td>Body {n}</td></div>'
    page = mark("Hdr", "ALONE") + section(1) + mark("No", "PART 1") + section(2) + mark("Hdr", "FIRST") + mark("No", "PART 2") + section(3) + mark("Hdr", "SECOND") + mark("Hdr", "AGAIN") + section(4)
    sections = markup_acts.anchored_sections(spark.createDataFrame([(1, page)], "doc_id long, text string"))
    assert {r.section_number: r.part for r in sections.collect()} == {"1": "ALONE", "2": "ALONE", "3": "PART 1 FIRST", "4": "PART 2 AGAIN"}
    units = markup_acts.section_units(sections, acts)
    assert {r.text: r.raw_context for r in units.collect()} == {x: x for x in ("Body 1 PART 1", "Body 2 FIRST PART 2", "Body 3 SECOND AGAIN", "Body 4")}
    above = units._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("MapInArrow")[0]
    assert "Project" in above and " text#" not in above
