"""The rules over names, facts, references, findings and scores, branch by branch."""

import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import corpus, curation, gates, graph, matching, references, scoring


def applied(spark, rows, schema, column):
    return [r.got for r in spark.createDataFrame(rows, schema).coalesce(1).select(column.alias("got")).collect()]


ELIGIBLE = [
    ("Word Act", "statute", "in_force", None), ("Word Act", " STATUTE ", "in_force", None), ("Billing Act", "act", "in_force", None), ("Data Bill", "act", "in_force", "BILL_OR_DRAFT"),
    ("Exposure Draft", "act", "in_force", "BILL_OR_DRAFT"), ("Consultation on data", "act", "in_force", "CONSULTATION"), ("A discussion paper", "act", "in_force", "CONSULTATION"), ("RCEP", "act", "in_force", "INTERNATIONAL_AGREEMENT"),
    ("Trade Agreement", "treaty", "in_force", None), ("Draft Agreement", "treaty", "in_force", "BILL_OR_DRAFT"), ("Trade Agreement", None, "in_force", "INTERNATIONAL_AGREEMENT"), ("Client alert", "act", "in_force", "SECONDARY_COMMENTARY"),
    ("Corporate policy", "act", "in_force", "COMPANY_POLICY"), ("Convention", "act", "in_force", None), ("Word Act", "bill", "in_force", "BILL_OR_DRAFT"), ("Word Act", "company_policy", None, "COMPANY_POLICY"),
    ("Word Act", "act", "repealed", "STATUS_REPEALED"), ("Word Act", "act", None, "STATUS_UNKNOWN"), ("Word Act", "news", "in_force", "UNSUPPORTED_SOURCE_TYPE"), ("Word Act", "news", None, "STATUS_UNKNOWN"), (None, "act", "in_force", None),
]


def test_eligibility(spark):
    got = applied(spark, [r[:3] for r in ELIGIBLE], "n string, t string, s string", gates.eligibility(F.col("n"), F.col("t"), F.col("s")))
    assert got == [r[3] for r in ELIGIBLE]


def test_drafts_by_their_pages(spark):
    pages = [(1, "a\n  Exposure Draft \nb"), (1, "DRAFT"), (1, "c"), (2, "draft of it"), (2, "a draft"), (3, "draft"), (3, None), (5, "draft"), (5, "draft")] + [(5, "x")] * 19
    docs = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "doc long")
    got = {r.doc: (r.draft_pages, r.pages, r.reason) for r in gates.content_eligibility(spark.createDataFrame(pages, "doc long, text string"), ["doc"], docs).collect()}
    assert got == {1: (2, 3, "BILL_OR_DRAFT_CONTENT"), 2: (0, 2, None), 3: (1, 2, None), 4: (0, 0, "EMPTY_DOCUMENT"), 5: (2, 21, None)}


STATUSES = [
    ("Repealed and superseded", "2024", None, "repealed", False), ("ceased to be in force", None, None, "repealed", False), ("replaced by another", "2024", None, "superseded", False), ("Not yet commenced, a draft", "2024", None, "not_yet_effective", False),
    ("commences on Monday", None, None, "not_yet_effective", False), ("a Bill", "2024", None, "draft", False), ("Billing, in force", "2024", None, "in_force", False), ("in force", None, None, "unknown", False), ("in force", "", "", "unknown", False),
    ("unsuperseded compilation", "2024", None, "in_force", True), ("repealed", None, "in_force", "in_force", True), (None, "2024", None, "unknown", False), ("words", "2024", None, "unknown", False),
]


def test_status_of_a_fact(spark):
    found = gates.resolve_status(F.col("f"), F.col("d"), F.col("e"))
    final = gates.status_allows_final(found["status"], found["conflict"], F.lit("https://x"), F.col("f"))
    got = applied(spark, [r[:3] for r in STATUSES], "f string, d string, e string", F.struct(found["status"].alias("s"), found["conflict"].alias("c"), final.alias("f"), found["rule"].alias("r")))
    assert [(g.s, g.c) for g in got] == [r[3:] for r in STATUSES]
    assert [g.f for g in got] == [r[3] == "in_force" and not r[4] for r in STATUSES] and all(g.r for g in got)
    assert applied(spark, [("in_force", False, None)], "s string, c boolean, u string", gates.status_allows_final(F.col("s"), F.col("c"), F.col("u"), F.lit("fact"))) == [False]


REFS = {
    "Section 245(2) and Rule 7 of the Regulations 2020; Clause 3; s. 12A; sec. 9": ["s. 245(2)", "s. 9", "s. 12A", "reg. 2020", "cl. 3"],
    "Articles 14.11 ( a ), Art 5 and art.5": ["Art. 14.11(a)", "Art. 5"],
    "Seksyen 12A, perkara 5, Peraturan 4": ["s. 12A", "Art. 5", "reg. 4"],
    "Rule 7, Schedules 2B and sch 3": ["r. 7", "Sch. 2B"],
    "section 3a and SECTION 3A": ["s. 3a"],
    "": [],
}


def test_references(spark):
    assert applied(spark, [(x,) for x in REFS], "x string", references.extract_refs(F.col("x"))) == [*REFS.values()]
    assert applied(spark, [(None,)], "x string", references.extract_refs(F.col("x"))) == [[]]


def test_role_of_a_reference(spark):
    ban = "One must not transfer words abroad under section 26."
    rows = [
        (1, ban, "P6-I1", "1"), (2, ban, "P6-I1", "0"), (3, ban, "P7-I3", "1"), (4, ban, None, None), (5, "Data means what section 26 says", "P6-I1", "1"), (6, "One must not send words abroad, read with section 26", "P6-I1", "1"),
        (7, "One shall not send words abroad as relevant to any of that under section 26", "P6-I1", "1"), (8, "Regulations 2021 say so", "P6-I1", "1"), (9, "Regulations 1899 say so", None, "1"), (10, "Nothing. See also section 26. One must not send abroad what section 26 says", "P6-I1", "1"),
        (11, "A framework in section 26", "P7-I1", "0"), (12, "A framework in section 26", "P7-I1", "1"), (13, None, "P6-I1", "1"), (14, "no reference", "P6-I1", "1"),
    ]
    found = references.mentions(spark.createDataFrame([(k, t, "", i, s) for k, t, i, s in rows], "k long, text string, acts string, indicator string, score string"), ["k"])
    got = {r.k: (r.ref, r.role) for r in found.collect()}
    roles = {1: "operative", 2: "negative_evidence", 3: "supporting", 4: "operative", 5: "definition", 6: "supporting", 7: "supporting", 10: "operative", 11: "operative", 12: "negative_evidence"}
    assert got == {k: ("s. 26", r) for k, r in roles.items()} | {8: ("reg. 2021", "instrument_title"), 9: ("reg. 1899", "operative")}


def around(text, start, end, radius=references.RADIUS):
    """The prose of a reference, told another way."""
    floor, ceiling = max(0, start - radius), min(len(text), end + radius)
    ends = lambda a, b: [m.start() + a for m in re.finditer(r"(?=\. |\n|• )", text[a:b]) if m.start() + a + len({".": ". ", "\n": "\n", "•": "• "}[text[m.start() + a]]) <= b]
    left = (ends(floor, start) or [-1])[-1]
    rights = [m.start() + end for m in re.finditer(r"(?=\. |\n| •)", text[end:ceiling])]
    right = min(rights) + 1 if rights else ceiling
    out = text[left + 1 : right].strip()
    if re.match(r"(?:It|This)\b", out):
        out = text[(ends(floor, max(floor, left)) or [-1])[-1] + 1 : right].strip()
    return " ".join(out.split())


def test_prose_around_references(spark):
    texts = ["One. Two words. It is section 5 so. Three", "first\nThis holds. It is section 5\nnext", "• a point • It says section 5 • end", "It section 5", "word " * 100 + "section 5 " + "word " * 100, "A. " + "word " * 100 + "section 5. B", "see section 5"]
    rows = spark.createDataFrame([(k, t, "", None, "1") for k, t in enumerate(texts)], "k long, text string, acts string, indicator string, score string")
    got = {r.k: r.context for r in references.mentions(rows, ["k"]).collect()}
    assert got == {k: around(t, t.index("section 5"), t.index("section 5") + 9) for k, t in enumerate(texts)}


HINTS = [
    ("the Telephones (Listening and Access) Act says", "Telephones Act 1997; Telephones (Listening and Access) Act 1979", ["telephones listening and access act 1979"]),
    ("the data protection rules", "Data Protection Act 2012\nData Protection Regulations", ["data protection act 2012"]),
    ("words amendment of privacy", "Privacy Words (Amendment) Act 2020; Evidence Act", ["privacy words amendment act 2020", "evidence act"]),
    ("nothing of it", "Privacy Words Act", []),
    ("evidence", "Evidence Act; Privacy Words Act", ["evidence act"]),
    ("", "", []),
]


def test_laws_that_the_prose_names(spark):
    acts = F.transform(X.split_acts(F.col("a")), X.normalize_law_name)
    assert applied(spark, [r[:2] for r in HINTS], "c string, a string", references.law_hints(F.col("c"), acts)) == [r[2] for r in HINTS]


FITS = [
    ("P6-I1", "they must not send words abroad", True), ("P6-I1", "they send words abroad", False), ("P6-I2", "keep records within the country", True), ("P6-I2", "keep it", False), ("P6-I3", "a server that is local", True), ("P6-I3", "a server", False),
    ("P6-I4", "transfer outside if they consent", True), ("P6-I4", "transfer outside", False), ("P7-I3", "preserve it for a week", True), ("P7-I3", "preserve it", False), ("P7-I5", "police search", True), ("P7-I5", "search", False), ("P7-I2", "x", True), (None, "x", True),
]


def test_prose_that_fits_an_indicator(spark):
    assert applied(spark, [r[:2] for r in FITS], "i string, c string", references.indicator_fits(F.col("i"), F.col("c"))) == [r[2] for r in FITS]


def test_pillars_and_policies(spark):
    rows = [("", "6", "P6-I?"), ("", "7.0", "P7-I?"), ("", "13", None), ("", "x", None), ("Local storage requirements", "7", "P6-I2"), ("13.4", "6", "P6-I?"), ("12.4 x", None, "P12-I4"), (None, "6", "P6-I?")]
    assert applied(spark, [r[:2] for r in rows], "x string, p string", X.indicator_code(F.col("x"), F.col("p"))) == [r[2] for r in rows]


KINDS = {"its PURPOSE": "framework", "notify": "incident", "an audit": "risk_audit", "code of practice": "controls", "they retain": "retention", "computerized data": "data_access", "a warrant": "search_seizure", "investigate": "investigation", "words": "other", "": "other"}


def test_what_a_provision_does(spark):
    assert applied(spark, [(x,) for x in KINDS], "x string", X.legal_function(F.col("x"))) == [*KINDS.values()]
    direct = [("P7-I1", "Personal Data Protection", 1), ("P7-I3", "for a period of two years", 1), ("P7-I3", "years", 0), ("P7-I5", "without obtaining a warrant", 1), ("P6-I1", "purpose", 0), (None, "purpose", 0)]
    assert applied(spark, [r[:2] for r in direct], "i string, x string", X.directness(F.col("i"), F.col("x"))) == [r[2] for r in direct]


def test_findings_are_kept_by_function_and_limit(spark):
    row = lambda key, indicator, snippet, tag="NEW", align=None, risks=(), conf=0.5, law="L": (key, "E", indicator, law, f"s. {key}", snippet, None, tag, align, [*risks], conf)
    rows = [
        row("1", "P7-I3", "they retain it", conf=0.9), row("2", "P7-I3", "they retain it for 5 years"), row("3", "P7-I3", "a warrant", risks=("r",)), row("4", "P7-I3", "a warrant", conf=0.4), row("5", "P7-I3", "words"),
        row("6", "P7-I1", "words", align="exact"), row("7", "P7-I1", "the purpose", conf=1.0), row("8", "P7-I1", "known", tag="KNOWN"), row("9", "P7-I1", "NO_EVIDENCE_FOUND"), row("10", "P6-I9", "words"), row("11(a)", "P6-I9", "words"), row("12", "P6-I9", "words"),
    ]
    df = spark.createDataFrame(rows, "id string, economy string, indicator string, law string, section string, snippet string, rationale string, tag string, alignment string, risks array<string>, confidence double")
    got = {r.id: (r.chosen, r.place) for r in curation.curate_findings(df).collect()}
    # Section 2 is direct; 4 has no risk; of 1 and 3 the first has another function's place taken.
    assert {k for k, v in got.items() if v[0]} == {"2", "4", "5", "6", "8", "9", "11(a)", "12"} and got["8"] == (True, None) and got["2"] == (True, 1) and got["11(a)"] == (True, 1)


SCORED = [
    ("P6-I1", 0, False, 0, 0.0), ("P6-I1", 2, False, 0, 0.5), ("P6-I4", 2, True, 0, 1.0), ("P6-I3", 1, False, 0, 1.0), ("P6-I5", 1, False, 0, 0.0), ("P6-I5", 0, False, 0, 1.0), ("P7-I1", 0, False, 0, 1.0), ("P7-I1", 1, False, 0, 0.5), ("P7-I2", 1, True, 0, 0.0),
    ("P7-I3", 1, False, 0, 1.0), ("P7-I4", 1, False, 0, 0.5), ("P7-I4", 1, True, 0, 1.0), ("P7-I5", 2, False, 2, 0.0), ("P7-I5", 2, False, 1, 1.0), ("P7-I5", 0, False, 0, 0.0), ("P9-I1", 5, True, 0, 0.0),
]


def test_scores_of_indicators(spark):
    got = applied(spark, [r[:4] for r in SCORED], "i string, n long, h boolean, g long", scoring.indicator_score(F.col("i"), F.col("n"), F.col("h"), F.col("g")))
    assert got == [r[4] for r in SCORED]


def edits(a, b):
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_citation_accuracy(spark):
    pairs = [("s. 12(a)", "s. 12(a)"), ("s. 12(b)", "s. 12(a)"), ("12 13", "13 12 14B"), ("", "s. 5.1A"), ("5", ""), ("words", "words"), ("(iv) 5A (2)", "5A (iv)")]
    got = applied(spark, pairs, "a string, b string", X.citation_accuracy(F.col("a"), F.col("b")))
    tokens = lambda x: re.findall(r"\b\d+(?:\.\d+)?[A-Z]{0,3}\b|\([a-z0-9ivxlcdm]+\)", x, re.I)
    assert got == [pytest.approx(1 - edits(tokens(a), tokens(b)) / max(len(tokens(b)), 1)) for a, b in pairs]


def test_error_rates_of_many_words(spark):
    """Words are told apart by characters; there are more words here than characters before the surrogates."""
    truth = " ".join(f"w{k}" for k in range(36_000))
    df = spark.createDataFrame([(truth,)], "b string")
    signs = df.select(F.transform(F.sequence(F.lit(35_320), F.lit(35_340)), lambda k: X._sign(F.concat(F.lit("w"), k.cast("string")), F.split(F.col("b"), " "))).alias("s")).first().s
    assert len(set(signs)) == 21 and all(len(x) == 1 for x in signs)


def test_paths_that_two_readings_share(spark):
    one = spark.createDataFrame([(1, ["a", "b"]), (1, ["a"]), (1, ["a"]), (2, ["c"]), (3, None)], "k long, path array<string>")
    two = spark.createDataFrame([(1, ["a"]), (1, ["z"]), (2, ["c", "d"])], "k long, path array<string>")
    assert {r.k: (r.expected, r.shared, r.accuracy) for r in matching.structure_accuracy(one, two, ["k"]).collect()} == {1: (2, 1, 0.5), 2: (1, 0, 0.0)}


def test_references_within_an_act(spark):
    rows = [("p1", "AU", "Word Act", "See section 5b, Section 7 of this Act and section 8 of the Evidence Act 1995. Section 5B."), ("p2", "AU", "Word Act", "x" * 3000 + " section 9"), ("p3", "AU", "Word Act", None)]
    got = {tuple(r) for r in graph.section_references(spark.createDataFrame(rows, "id string, economy string, law string, text string")).collect()}
    assert got == {("p1", "CROSS_REFERENCES", "section:AU:Word Act:s. 5B"), ("p1", "CROSS_REFERENCES", "section:AU:Word Act:s. 7")}


def test_words_of_exception(spark):
    rows = [("P6-I1", "must go", "must go unless late", "FAIL"), ("P7-I1", "must go", "must go. Notwithstanding", "WARN"), ("P6-I1", "go UNLESS late", "go unless late", "PASS"), ("P6-I1", "must go", "it is exceptional", "PASS"), ("P6-I1", "must go", "Subject To this", "FAIL")]
    assert applied(spark, [r[:3] for r in rows], "i string, s string, t string", gates.g5_exceptions(F.col("i"), F.col("s"), F.col("t"))) == [r[3] for r in rows]


def test_edges_of_allowed_types_only(spark):
    edges = spark.createDataFrame([("a", "HAS", "b"), ("b", "CITES", "c")], "src string, rel string, dst string")
    assert corpus.guarded_edges(edges, ("HAS", "CITES")).count() == 2
    for bad in (edges, edges.withColumn("rel", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            corpus.guarded_edges(bad, ("HAS",))


def test_documents_of_too_few_units(spark):
    rows = [(2, 1, True), (3, 19, False), (3, 20, True), (4, 24, False), (None, None, True), (3, None, False)]
    assert applied(spark, [r[:2] for r in rows], "u int, p int", gates.structure_too_thin(F.col("u"), F.col("p"))) == [r[2] for r in rows]


def test_tasks_do_not_grow_with_the_rows(spark, monkeypatch):
    from lodestrata import session

    monkeypatch.setattr(session, "SPREAD", 50)
    rows = spark.range(1000).selectExpr("id % 300 k", "array(string(id % 7), null) path")
    some = spark.createDataFrame([(None, ["0", None]), (5, ["5", None]), (6, None)], "k long, path array<string>")
    found = matching.structure_accuracy(rows.unionByName(some), rows.where("k < 9"), ["k"])
    assert "RepartitionByExpression" in found._jdf.queryExecution().analyzed().toString() and session.spread(rows, "k").rdd.getNumPartitions() >= 20
    got = {r.k: (r.expected, r.shared) for r in found.collect()}
    assert len(got) == 301 and got[None] == (1, 0) and all(shared == (n if k < 9 else 0) for k, (n, shared) in got.items() if k is not None)


def test_forms_that_a_text_lacks_are_sought_once(spark):
    assert str(references._places(F.col("t"))).lower().count("rlike") >= len(references.REFERENCES)
    rows = spark.createDataFrame([(1, "By Sec. 5(1) and Section 7, Rule 8"), (2, "nothing"), (3, "")], "k long, t string")
    got = {r.k: [(p.kind, p.ref, p.start) for p in r.p] for r in rows.select("k", references._places(F.col("t")).alias("p")).collect()}
    assert got == {1: [(5, "s. 7", 17), (6, "s. 5(1)", 3), (9, "r. 8", 28)], 2: [], 3: []}
