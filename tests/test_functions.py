import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions.closure import balanced, close, ends_sentence, folded, g9, locate, open_ending


def values(spark, column, given_):
    return [r[0] for r in spark.createDataFrame([(x,) for x in given_], "x string").select(column(F.col("x"))).collect()]


def test_section_base(spark):
    got = values(spark, X.section_base, ["s. 26", "section 116b", "26.1", "Schedule 1 cl. 8", "Act 1999", "none", None, "Sch 1A cl 2", "Schedule 2 para 4", "reschedule 3", "s. 474.17A(1)", "reg. 0999"])
    assert got == ["26", "116B", "26.1", "sch1cl8", None, None, None, "sch1Acl2", "sch2", "3", "474.17A", "0999"]


def test_law_identity(spark):
    pairs = [("Personal Data Protection Act 2012", "Personal Data Protection Act", True), ("Privacy Act", "Evidence Act", False), ("Data Protection Commission (Amendment) Act 2020", "Data Protection Commission Act 1998", True), ("", "Privacy Act", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", X.same_law(X.law_tokens(F.col("a")), X.law_tokens(F.col("b")))).collect())


def test_names(spark):
    names = {"Data Act (PDPA) & Rules (No. 12) (Draft)": "data act and rules draft", "Act (Act 854-A) (AB2.C) 2010": "act 2010", "(pdpa) X": "pdpa x", "A (No 7b)": "a", "": "", "B ((C D) E)": "b c d e"}
    assert values(spark, X.normalize_law_name, [*names, None]) == [*names.values(), ""]
    assert values(spark, lambda x: X.family(X.law_tokens(x)), ["Word (Amendment) Act 2010 A123 ab12 amended"]) == [["ab12", "amended", "word"]]
    assert values(spark, X.url_host, ["https://www.A.gov.sg:8/x?y", "no url"]) == ["a.gov.sg", ""]
    assert values(spark, X.furniture_print, ["Page 12 of  30"]) == ["page # of #"]


def test_dates(spark):
    assert [str(x) for x in values(spark, X.parse_date, ["5 Mar 2024", "2024-03-05", "soon"])] == ["2024-03-05", "2024-03-05", "None"]


def test_closure():
    source = "1. General.\nNo person shall transfer data (see s. 4) unless permitted. Another rule follows: and"
    code, start, end, text = close("shall transfer  DATA", source)
    assert code == "PASS_CLOSED" and source[start:end] == text == "No person shall transfer data (see s. 4) unless permitted."
    assert close("Another rule", source)[0] == "FAIL_DANGLING_CONNECTOR"
    assert close("rule", "A rule applies to:")[0] == "FAIL_OPEN_LIST" and close("rule", "A rule of this Part")[0] == "FAIL_DANGLING_CONNECTOR"
    assert close("rule", "A rule (that applies")[0] == "FAIL_UNBALANCED_STRUCTURE" and close("rule", "A rule that applies")[0] == "FAIL_UNBALANCED_STRUCTURE"
    assert close("missing", source) == ("FAIL_UNBALANCED_STRUCTURE", None, None, None)
    assert close("word", "word " * 200 + ".")[0] == "PASS_LONG_BUT_CLOSED"
    assert close("word", "word " * 900 + ".")[0] == "FAIL_CLOSURE_OVER_HARD_LIMIT"


CLOSED = [
    ("The court may", "(1) The rule holds where: (a) the court may order it. (b) it is late; and (c) it is due. A rule follows.", "(1) The rule holds where: (a) the court may order it. (b) it is late; and (c) it is due."),
    ("keep it for the time:", "One must keep it for the time: (a) seven years; (b) until then; and (c) longer if a court says so. Another rule.", "One must keep it for the time: (a) seven years; (b) until then; and (c) longer if a court says so."),
    ("ensure that:", "One must ensure that: (a) where it holds: (i) it is kept. (ii) it is sent. (b) all else is kept. The next begins.", "One must ensure that: (a) where it holds: (i) it is kept. (ii) it is sent. (b) all else is kept."),
    ("an or", "One may order where: ( a ) it is so; or ( b ) an oral thing is likely. Explanation 1.—It is (c) no part.", "One may order where: ( a ) it is so; or ( b ) an oral thing is likely."),
    ("look at", "A heading without a stop (1) One may look at it all. (2) Another may not.", "(1) One may look at it all."),
    ("s. 474.17", "Under s. 474.17 and Art. 2.1, No. 8 holds for A. Smith. The next one.", "Under s. 474.17 and Art. 2.1, No. 8 holds for A. Smith."),
    ("second", "First\n\nThe second one (said \"so.\") holds? Yes.", "The second one (said \"so.\") holds?"),
]


@pytest.mark.parametrize("snippet, source, want", CLOSED)
def test_passages(snippet, source, want):
    code, start, end, text = close(snippet, source)
    assert (code, text, source[start:end]) == ("PASS_CLOSED", want, want)


def test_blocks_below_their_introduction_belong_to_it():
    source = "A thing must: hold well. second one is kept. third one too. After it."
    blocks = [{"class": "subsection", "text": "A thing must: hold well."}, {"class": "paragraph", "text": "second one is kept."}, {"class": None, "text": "(b) odd"}, {"class": "paragraph", "text": "third one too."}, {"class": "subsection", "text": "After it."}]
    assert close("A thing must:", source, blocks=blocks)[3] == "A thing must: hold well. second one is kept. third one too."
    assert close("A thing must:", source, blocks=[*blocks[:1], *blocks[4:]])[3] == close("A thing must:", source)[3] == "A thing must: hold well."
    assert g9("PASS_LONG_BUT_CLOSED") == "PASS" and g9("FAIL_OPEN_LIST") == "FAIL"


def test_open_endings(spark):
    texts = {"it holds:": "FAIL_OPEN_LIST", "it holds —)": "FAIL_OPEN_LIST", "this and ": "FAIL_DANGLING_CONNECTOR", "under section\"": "FAIL_DANGLING_CONNECTOR", "(it holds": "FAIL_UNBALANCED_STRUCTURE", "a (b].": "FAIL_UNBALANCED_STRUCTURE", ")(": "FAIL_UNBALANCED_STRUCTURE", "a ([b]) holds.": None, "sand": None, "": None}
    assert values(spark, X.open_ending, [*texts]) == [*texts.values()] == [open_ending(t) for t in texts]


def test_stops():
    assert not ends_sentence("s. 4", 1) and not ends_sentence("3.5", 1) and ends_sentence("done. Next", 4)
    assert balanced("a (b [c])") and not balanced("a (b]") and not balanced(")")


@given(st.text(max_size=60), st.integers(0, 50), st.integers(1, 20))
def test_located_text_folds_to_the_snippet(source, at, n):
    snippet = source[at : at + n]
    found = locate(snippet, source)
    if found and folded(snippet)[0]:
        assert folded(snippet)[0] in folded(source[slice(*found)])[0]


def test_citations(spark):
    assert values(spark, X.expand_citations, ["Sections 4, 5A and 7(1)", "x"]) == [["s4", "s5A", "s7(1)"], []]
    assert values(spark, X.indicator_code, ["Indicator 6.4", "6.4", "v11.2.3", "13.1", "Infrastructure  Requirements!", None]) == ["P6-I4", "P6-I4", "P2-I3", None, "P6-I3", None]
    assert values(spark, X.strip_markdown, ["**a** [b](http://c)"]) == ["a b"]


def test_edits_in_bands(monkeypatch):
    from lodestrata.functions import edits as bands

    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    long = "".join(chr(97 + k * k % 23) for k in range(60_000))
    assert bands.edits(long, long.replace("a", "")) == long.count("a") > 64
    pick = random.Random(5)
    for step, least in ((1024, 64), (1, 1), (3, 1), (7, 2)):
        monkeypatch.setattr(bands, "STEP", step)
        monkeypatch.setattr(bands, "LEAST", least)
        for _ in range(100):
            a = "".join(pick.choices("abc", k=pick.randrange(40)))
            b = "".join(c for c in a for _ in range(pick.choice((0, 1, 1, 1, 2)))) if pick.random() < 0.5 else "".join(pick.choices("abc", k=pick.randrange(40)))
            assert bands.edits(a, b) == plain(a, b)


def test_edits_leave_out_what_cannot_be_on_a_cheapest_way(monkeypatch):
    from lodestrata.functions import edits as bands

    met, places = [], bands._Ways._places
    monkeypatch.setattr(bands._Ways, "_places", lambda self, own, low, high: met.append(high - low) or places(self, own, low, high))
    text = "".join(chr(97 + k * k % 23) for k in range(40_000))
    # The symbols' numbers tell all edits but for a few, however many they are.
    assert bands.edits(text, text.replace("c", "C").replace("e", "")) == text.count("c") + text.count("e") > 4000
    assert max(met) < 4 * bands.STEP
    met.clear()
    words = [f"w{k}" for k in range(5000)]
    assert bands.edits(words, [w.replace("7", "x") for w in words]) == sum("7" in w for w in words) > 1000 and not met


def test_edits_of_odd_sequences():
    from lodestrata.functions.edits import edits

    assert [edits(*x) for x in (("", ""), ("", "ab"), ("ab", "ab"), ([], ["a"]), (["a", "b"], ["b"]), ("a\U0001f600b", "a\U0001f601"), ("abc" * 400, "xyz" * 300))] == [0, 2, 0, 1, 1, 2, 1200]
