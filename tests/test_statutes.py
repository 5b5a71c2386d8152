"""Statute parsing: shapes of layouts, and the chunked scan against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import legal
from lodestrata.functions.text import law_tokens
from lodestrata.operators import statutes
from lodestrata.plans import statutes as plans

ACT = "doc_id long, economy string, act_name string, act_ref string, law_number_ref string, source_url string, grammar string, citation string, ocr boolean"


def units(spark, pages, name="Plain Word Act 1979", grammar=None, ocr=False):
    acts = spark.createDataFrame([(1, "Malaysia", name, "ref", None, "https://x", grammar, grammar, ocr)], ACT)
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(pages, 1)], "doc_id long, page int, text string")
    return {r.article_section: r for r in statutes.parse(rows, acts).collect()}


TAIL = " and whatever else is needed to make a unit."


def test_sections_and_subsections(spark):
    got = units(spark, [f"Section 4. First rule\n(1) A keeper shall keep{TAIL}\n(2) Despite (1), a keeper may stop{TAIL}\n", f"Section 5. Second rule{TAIL}\nNote: it goes on.", None])
    assert set(got) == {"s. 4(1)", "s. 4(2)", "s. 5"}
    assert got["s. 4(1)"].text == f"(1) A keeper shall keep{TAIL}" and got["s. 4(2)"].id == "ma:ref:s4-2" and got["s. 5"].location_reference == "page 2"
    assert got["s. 5"].text == f"Section 5. Second rule{TAIL} Note: it goes on." and got["s. 4(1)"].raw_context.startswith("Section 4. First rule (1)")
    assert [c.role for c in got["s. 5"].rule_components] == ["principal_rule", "note", "cross_reference"]


def test_letters_lists_footers_and_prose(spark):
    page = f"116B. Access to things\nOne may look{TAIL}\n3. a list item{TAIL}\n102  Plain Word Act 1979\n116A. Sibling out of order{TAIL}\n116B. Repeated heading{TAIL}\n117. Later rule{TAIL}\nSection 118 removes something{TAIL}\n300. Too far ahead{TAIL}\n"
    got = units(spark, [page])
    assert set(got) == {"s. 116B", "s. 116A", "s. 117"} and "102 Plain Word Act 1979" in got["s. 116B"].text and "300. Too far" in got["s. 117"].text


def test_decimals_contents_and_no_dot_layout(spark):
    got = units(spark, [f"3.5 KEEPING RULE{TAIL}\n3.5.1 Users shall keep{TAIL}\n3.5.2 Records may stay{TAIL}\n4.10.1 A user must not send{TAIL}"])
    assert set(got) == {"s. 3.5", "s. 3.5.1", "s. 3.5.2", "s. 4.10.1"}
    got = units(spark, ["CONTENTS\n1. Title\n9. Savings\n24. Duty\nAn Act to say so.\n1. Title of it all in words\n(1) This may be cited" + TAIL + "\n(2) It may not" + TAIL])
    assert set(got) == {"s. 1(1)", "s. 1(2)"}
    assert set(units(spark, [f"13  Interference with things{TAIL}\n13A  More of that{TAIL}"])) == {"s. 13", "s. 13A"}


def test_grammars(spark):
    page = f"Article 14.11: Sending words{TAIL}\nARTICLE 15\nA title below it{TAIL}\n"
    assert set(units(spark, [page], grammar="treaty")) == {"Art. 14.11", "Art. 15"}
    assert units(spark, [page]) == {}
    assert set(units(spark, [f"Seksyen 12A. Pindah kata{TAIL}\nSeksyen 13 Lagi kata{TAIL}"], grammar="malay")) == {"s. 12A", "s. 13"}
    # A declared grammar wins ties only.
    assert set(units(spark, [f"1. Common rule{TAIL}\n2. Common too{TAIL}\nPerkara 5. Kata{TAIL}"], grammar="malay")) == {"s. 1", "s. 2"}


def test_ocr_letters(spark):
    page = f"7a. First of them{TAIL}\n7s. Second of them{TAIL}\n7c. Third of them{TAIL}\n8x. Last of them{TAIL}"
    assert set(units(spark, [page], ocr=True)) == {"s. 7A", "s. 7B", "s. 7C", "s. 8X"}


def test_no_headings_and_no_acts(spark):
    assert units(spark, ["nothing here", None, ""]) == {}
    acts = spark.createDataFrame([], ACT)
    assert statutes.parse(spark.createDataFrame([(1, 1, "1. A" + TAIL)], "doc_id long, page int, text string"), acts).count() == 0


def key(number):
    annex = re.fullmatch(r"(\d+)([A-Z]+)\.(\d+)([A-Z]*)", number.upper())
    if annex:
        n = 0
        for c in annex[2]:
            n = n * 26 + ord(c) - 64
        return int(annex[1]), 1000 + n, int(annex[3]), annex[4]
    m = re.fullmatch(r"(\d+)(?:\.(\d+))?(?:\.(\d+))?([A-Z]*)", number.upper())
    return (int(m[1]), int(m[2] or -1), int(m[3] or -1), m[4]) if m else (0, -1, -1, "")


def taken(numbers):
    top, out = (0, -1, -1, ""), []
    for at, n in numbers:
        k = key(n)
        if out:
            kin = k[:-1] == top[:-1] and k[-1] != top[-1]
            if (kin and n in [x for _, x in out[-6:]]) or (not kin and (k <= top or k[0] > top[0] + 40)):
                continue
        elif k[0] == 0:
            continue
        out.append((at, n))
        top = max(top, k)
    return out


@pytest.mark.parametrize("chunk, block", [(4096, 512), (9, 2)])
def test_scan_in_chunks_equals_a_plain_loop(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(statutes, "CHUNK", chunk)
    monkeypatch.setattr(statutes, "BLOCK", block)
    rnd, rows, want = random.Random(chunk), [], set()
    for doc in range(3):
        found, n = [], 0
        for at in range(35):
            n = max(0, n + rnd.choice([0, 0, 1, 1, 2, -3, 45]))
            found.append(((at // 7, at % 7), rnd.choice([f"{n}", f"{n}A", f"{n}B", f"{n}.2", f"{n}.2.1", "3", f"{n}C.4"])))
        rows += [(doc, 0, p, line, n) for (p, line), n in found]
        want |= {(doc, p, line, n) for (p, line), n in taken(found)}
    df = spark.createDataFrame(rows, "doc_id long, pattern int, page int, line int, number string").withColumn("key", legal.section_order(F.col("number")))
    assert {(r.doc_id, r.page, r.line, r.number) for r in statutes.accepted(df).collect()} == want


def test_lines_find_their_sections_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(statutes, "BLOCK", 2)
    lines = spark.createDataFrame([(1, p, k, f"{p}{k}") for p in (1, 2) for k in range(5)], "doc_id long, page int, line int, text string")
    heads = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 3, "b")], "doc_id long, page int, line int, number string")
    assert {(r.number, r.body) for r in statutes.sections(lines, heads).collect()} == {("a", "11 12 13 14 20 21 22"), ("b", "23 24")}


COMPONENT_TEXT = "A keeper must not go unless it is due. Note 2: See section 5. If where iffy. Data means words"


def test_rule_components(spark):
    rows = spark.createDataFrame([(COMPONENT_TEXT,), ("",), (None,), ("Subject to this. does not apply",)], "x string").select("x", legal.rule_components(F.col("x")).alias("c")).collect()
    for r in rows:
        if r.x is None:
            assert r.c is None
            continue
        want = [("principal_rule", 0, len(r.x), r.x)]
        for role, p in legal.COMPONENTS.items():
            for m in re.finditer(p, r.x):
                stop = (r.x.find(".", m.start()) + 1) or len(r.x)
                want.append((role, m.start(), stop, r.x[m.start() : stop]))
        assert [tuple(c) for c in r.c] == want


PATHS = {
    "s. 26(1)(a)": ["section 26", "item (1)", "item (a)"],
    "Sch 1, cl. 8(1)": ["Schedule 1", "clause 8", "item (1)"],
    "Sch. 3 section 4": ["Schedule 3"],
    "reg. 5A(ii)": ["regulation 5A", "item (ii)"],
    "Article 12(2)": ["article 12", "item (2)"],
    "Part IV, Division B of Chapter X": ["Part IV", "Division B", "Chapter X"],
    "474.17A(iv)": ["section 474.17A", "item (iv)"],
    "nothing": [],
    "": [],
}


def test_citation_paths(spark):
    rows = spark.createDataFrame([(x,) for x in PATHS], "x string").select("x", legal.citation_path(F.col("x")).alias("p")).collect()
    assert {r.x: r.p for r in rows} == PATHS


def test_headings_that_are_none(spark):
    name = "Telephones (Listening and Access) Act 1979"
    texts = {"removes some": False, "Moving of words": True, "Telephones (Listening and Access) Act": False, "see Section 5": False, "": True, "  ": True, "Listening and words": True}
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", legal.plausible_heading(F.col("x"), law_tokens(F.lit(name))).alias("p")).collect()
    assert {r.x: r.p for r in rows} == texts


def test_rule_components_are_told_once_for_a_section(spark):
    acts = spark.createDataFrame([(1, "Malaysia", "Data Act", "ref", None, "https://x", None, None, False)], ACT)
    found = spark.createDataFrame([(1, 1, "4", "4. Rule (1) One may go if it rains. (2) Two may stay where it is dry.")], "doc_id long, page int, number string, body string")
    plan = statutes.rule_units(found, acts)._jdf.queryExecution().optimizedPlan().toString()
    # What opens a role's parts and what stands between is sought once each, before pieces are made.
    assert plan.count("provided that") == 2 and plan.index("Generate") < plan.index("provided that")


def test_words_are_made_once(spark, tmp_path):
    texts = ["One, two", " 3 ", "", None, "é", "a-b!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = plans._words(spark, str(tmp_path))
    assert sorted((r.doc_id, r.m, r.k, list(r.v)) for r in words.collect()) == [(0, 1, 1, ["one", "two"]), (5, 1, 1, ["a", "b"])]
    assert words._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("regexp_replace") == 1


def test_units_stay_where_their_documents_are(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plans.malay_units(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Texts are dealt once, and neither sections nor units are shuffled again.
    assert "Exchange" not in plan[: plan.index("collect_list(lines")] and plan.count("REPARTITION_BY_NUM") == 1


def test_repeated_pages_repeat(spark):
    acts = spark.createDataFrame([(1, "Malaysia", "Data Act", "ref", None, "https://x", None, None, False)], ACT)
    rows = [(1, 2, "and on"), (1, 1, f"1. Rule{TAIL}\nIt goes on"), (1, 1, f"1. Rule{TAIL}\nIt goes on"), (1, 3, None)]
    got = statutes.parse(spark.createDataFrame(rows, "doc_id long, page int, text string"), acts).collect()
    assert [r.text for r in got] == [f"Rule{TAIL} 1. Rule{TAIL} It goes on It goes on and on"]


def test_what_a_pattern_takes_the_one_over_all_takes():
    every = re.compile(statutes._any_heading().replace("(?:(?i)", "(?i:"))
    for line in ("Section 12A. Rule", "3.5.1 Users", "12. Rule", "13A  More", "Article 14.11-B: Words", "Seksyen 12A. Kata", "  Perkara 5 Kata", "PERKARA 7  kata"):
        assert every.search(line)
    assert not any(every.search(line) for line in ("(1) Unless exempt", "words 12. Rule", "  (2) It means", "", "Sections 3"))
