import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.operators import corpus, curation, gates, graph, matching, retrieval, review, scoring, segmentation


def test_bm25_prefers_rare_terms(spark):
    texts = spark.createDataFrame([(1, "data data law"), (2, "law"), (3, "law of privacy"), (4, None), (5, "")], "item_id long, text string")
    terms = spark.createDataFrame([(1, "privacy"), (1, "law")], "query_id long, term string")
    assert [r.item_id for r in retrieval.bm25(texts, terms).orderBy("rank").collect()][0] == 3


def test_exact_phrases_fold_case_and_skip_blanks(spark):
    texts = spark.createDataFrame([(1, "The Data Act"), (2, None)], "item_id long, text string")
    phrases = spark.createDataFrame([(7, "data act"), (8, " "), (9, None)], "query_id long, phrase string")
    assert [tuple(r) for r in retrieval.exact_phrases(texts, phrases).collect()] == [(7, 1, 10.0)]
    assert retrieval.exact_phrases(texts, phrases.limit(0)).count() == 0


def test_known_sections_tell_null_from_empty(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")], "law string, section string")
    recorded = spark.createDataFrame([("a", "1"), ("b", None)], "law string, section string")
    got = {(r.law, r.section): (r.tag, r.known_sections) for r in matching.tag_new_known(rows, recorded).collect()}
    assert got == {("a", "1"): ("KNOWN", ["1"]), ("a", "2"): ("NEW", ["1"]), ("b", "1"): ("NEW", []), ("c", "1"): ("NEW", None)}


def test_curation_takes_each_kind_first(spark):
    rows = spark.createDataFrame([(1, "x", 9), (2, "x", 8), (3, "y", 1)], "id int, kind string, score int").withColumn("g", F.lit(1))
    out = curation.curate(rows, ["g"], "kind", [F.desc("score"), F.col("id")], 2).where("chosen")
    assert sorted(r.id for r in out.collect()) == [1, 3]


def test_correction_voids_what_was_before(spark):
    rows = [("k", "s", 1, "approved"), ("k", "fix", 2, ""), ("k", "s", 3, "rejected"), ("m", "s", 1, "approved")]
    ledger = spark.createDataFrame(rows, "key string, stage string, at int, decision string").withColumn("id", F.col("at"))
    got = {r.key: r.decision for r in curation.latest_decisions(ledger, "key", "stage", "at", "id", "fix").collect()}
    assert got == {"k": "rejected", "m": "approved"}


def test_alpha_extremes(spark):
    same = spark.createDataFrame([(1, 1), (1, 1), (2, 1)], "unit int, value int")
    single = spark.createDataFrame([(1, 1), (2, 0)], "unit int, value int")
    assert scoring.nominal_alpha(same).first().alpha == 1.0
    assert scoring.nominal_alpha(single).first().alpha is None


def test_monotonic_sections(spark):
    rows = [(1, k, n, s) for k, (n, s) in enumerate([(1, ""), (2, ""), (90, ""), (2, "A"), (1, ""), (3, "")])]
    got = segmentation.monotonic_sections(spark.createDataFrame(rows, "doc_id int, pos int, number int, suffix string")).orderBy("pos").collect()
    assert [r.accepted for r in got] == [True, True, False, True, False, True]


def test_expected_subsections(spark):
    df = spark.createDataFrame([([1, 7, 2, 3],), ([1, 5],), ([],)], "m array<int>")
    assert [r[0] for r in df.select(segmentation.expected_subsections(F.col("m"))).collect()] == [[1, 2, 3], [], []]


def test_two_hops_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    nodes = graph.expand(edges, spark.createDataFrame([("a",)], "node string"))
    assert {r.node: r.hop for r in nodes.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert graph.dangling(edges, nodes.where("node <> 'd'")).count() == 1


@pytest.mark.parametrize(("wanted", "found", "hit"), [("26", "26", True), ("26", "26.1", True), ("2", "26", False), ("sch1", "sch1cl8", True), ("sch1cl8", "sch1", False)])
def test_section_ladder(spark, wanted, found, hit):
    one = spark.createDataFrame([(wanted,)], "section string")
    assert bool(matching.section_hits(one, spark.createDataFrame([(found,)], "section string"), []).count()) is hit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_location_gate(spark):
    cases = [("#pr26-", "26", "PASS"), ("#pr26-", "27", "FAIL"), ("page 42", "129", "PASS"), ("#PR12A", "12A", "PASS"), ("#pr12-", "", "FAIL"), ("#pr12-", None, "FAIL"), ("see #pr9", "9", "WARN"), (None, "9", "WARN"), ("Vol. 2", None, "PASS")]
    for place, base, want in cases:
        assert one(spark, gates.g2_location(F.lit(place), F.lit(base))) == want, (place, base)


def test_modality_gate(spark):
    cases = [("the law prohibits export", "no such word", "", "WARN"), ("a duty is required", "shallow mustard", "", "WARN"), ("requires it", "consent is required", "", "PASS"), ("requires it", "they may keep", "", "WARN"), ("requires it", "", "x" * 1600 + " must", "WARN"), ("requires it", "", "one must", "PASS"), ("nothing", "", "", "PASS"), (None, None, None, "PASS"), ("a ban", "one may not", None, "PASS")]
    for claim, snippet, text, want in cases:
        assert one(spark, gates.g6_modality(F.lit(claim), F.lit(snippet), F.lit(text))) == want, (claim, snippet)


def test_dangling_gate(spark):
    known = F.array(F.lit("25"), F.lit("9"), F.lit("7A"))
    cases = [("powers under section 999 of this Act", ["999"]), ("see section 25 for details", []), ("section 5 of the Contracts Act and section 9", []), ("Section 7a, section 8 and SECTION 8", ["8"]), ("section 30 of the said Privacy Act", []), ("section 30 of that very Act", ["30"]), ("x" * 3000 + " section 1", []), (None, [])]
    for text, want in cases:
        assert one(spark, gates.g8_lost(F.lit(text), known)) == want, text
        assert one(spark, gates.g8_dangling(F.lit(text), known)) == ("WARN" if want else "PASS")
    assert one(spark, gates.g8_dangling(F.lit("section 4"), F.lit(None).cast("array<string>"))) == "PASS"


FITS = [
    ("P7-I1", "any", "Data Bill 2024", "FAIL"),
    ("P7-I1", "any", "Billing Act", "PASS"),
    ("P6-I1", "A firm may transfer personal data outside the country.", "Act", "FAIL"),
    ("P6-I1", "A firm must not transfer personal data outside the country.", "Act", "PASS"),
    ("P6-I1", "A firm must not disclose data.", "Act", "FAIL"),
    ("P6-I4", "A firm may transfer data abroad only if consent is given.", "Act", "PASS"),
    ("P6-I4", "A firm may transfer data abroad.", "Act", "FAIL"),
    ("P6-I4", "None shall send data to another country except in accordance with rules.", "Act", "PASS"),
    ("P6-I2", "Every register of documents must be kept, and maintained in the capital.", "Act", "PASS"),
    ("P6-I2", "Every register of documents must be kept.", "Act", "FAIL"),
    ("P6-I2", "Records must be preserved and maintained at an office within the state.", "Act", "PASS"),
    ("P6-I2", "An operator shall not hold or\ntake any record outside Malaysia.", "Act", "PASS"),
    ("P6-I3", "The Minister may name a computer system located outside the state.", "Act", "FAIL"),
    ("P6-I3", "A provider must keep its server infrastructure within the country as a condition of service.", "Act", "PASS"),
    ("P6-I3", "Servers must be located in another country.", "Act", "FAIL"),
    ("P7-I3", "The office need only keep a register for 5 years, and must hold it.", "Act", "FAIL"),
    ("P7-I3", "A firm must retain every record for at least 5 years.", "Act", "PASS"),
    ("P7-I3", "A firm must keep staff records for the period prescribed.", "Act", "WARN"),
    ("P7-I3", "A permit shall be kept for a year.", "Act", "FAIL"),
    ("P7-I5", "An authorized officer may search computer data without first obtaining a warrant.", "Act", "PASS"),
    ("P7-I5", "An authorised officer may search computer data under a warrant issued by a magistrate.", "Act", "WARN"),
    ("P7-I5", "The Attorney-General may issue a warrant for access to computer data.", "Act", "PASS"),
    ("P7-I5", "Anyone may look around.", "Act", "FAIL"),
    (None, None, None, "PASS"),
]


def test_fit_gate(spark):
    rows = spark.createDataFrame([(k, *x) for k, x in enumerate(FITS)], "k int, indicator string, said string, law string, want string")
    got = rows.select("k", "want", gates.g7_fit(F.col("indicator"), F.col("said"), F.col("said"), F.col("law")).alias("got")).collect()
    assert [(FITS[r.k], r.got) for r in got if r.got != r.want] == []
    far = gates.g7_fit(F.lit("P6-I4"), F.lit(""), F.lit("x" * 2100 + " transfer abroad if"), F.lit("Act"))
    assert one(spark, far) == "FAIL"


def test_blocked(spark):
    good = "<p>words</p>" * 400
    cases = [(403, good, True), (200, good, False), (200, "short", True), (404, "short", False), (500, "captcha", False), (200, "Are You a Robot?" + good, True), (200, good + "captcha", False), (200, None, True), (None, good, False)]
    for status, body, want in cases:
        assert one(spark, corpus.blocked(F.lit(status).cast("int"), F.lit(body))) == want, status


def test_bm25_equals_brute_force(spark):
    import collections
    import math
    import random

    random.seed(3)
    pool = [f"w{k}" for k in range(30)]
    texts = [(k, None if k == 5 else " ".join(random.choices(pool, k=k % 17))) for k in range(80)]
    asked = [(q, t) for q in range(6) for t in random.sample(pool, 4)] + [(9, "absent")]
    got = retrieval.bm25(spark.createDataFrame(texts, "item_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, term string"), 5).collect()
    n = len(texts)
    words = {k: (t or "").split() for k, t in texts}
    mean = sum(map(len, words.values())) / (n - 1)
    df = collections.Counter(w for x in words.values() for w in set(x))
    want = set()
    for q in {q for q, _ in asked}:
        scores = {}
        for k, x in words.items():
            s = 0
            for t in {t for p, t in asked if p == q} & set(x):
                idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
                f = x.count(t)
                s += (idf if idf > 0 else retrieval.LEAST_IDF) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(x) / mean))
            if s:
                scores[k] = round(s, 6)
        want |= {(q, k, scores[k], r + 1) for r, k in enumerate(sorted(scores, key=lambda k: (-scores[k], k))[:5])}
    assert {tuple(r) for r in got} == want


def test_law_pairs_lose_nothing(spark):
    import itertools

    names = ["Personal Data Protection Act 2012", "Data Protection Act", "Personal Data Protection (Amendment) Act 2020", "Privacy Act", "The Privacy and Data Act", "Act", "", "Evidence Act 1950", "Data Protection Commission Act", "Data Protection Commission (Amendment) Act 1999"]
    left = spark.createDataFrame([(x,) for x in names], "law string")
    got = {tuple(r) for r in matching.law_pairs(left, left).collect()}
    pairs = spark.createDataFrame([*itertools.product(names, names)], "a string, b string")
    assert got == {(r.a, r.b) for r in pairs.where(X.same_law(X.law_tokens(F.col("a")), X.law_tokens(F.col("b")))).collect()}


def test_error_rates(spark):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = [("the cat sat", "the cat sat"), ("tbe cat", "the cat sat down"), ("", "one two"), ("été  à", "ete a b"), ("a b c d", "d c b a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", *(c.alias(k) for k, c in X.error_rates(F.col("a"), F.col("b")).items())).collect()
    assert all((r.char_edits, r.chars, r.word_edits, r.words) == (edits(r.a, r.b), len(r.b), edits(r.a.split(), r.b.split()), len(r.b.split())) for r in got)


def test_escalation_reasons(spark):
    def reasons(applies=True, confidence=0.9, indicator="P6-I2", snippet="a duty", context="There is A  Duty here", gold=False, expected=False):
        return one(spark, review.escalation_reasons(*(F.lit(x) for x in (applies, confidence, indicator, snippet, context, gold, expected))))

    assert reasons() == [] and reasons(applies=None) == []
    assert reasons(applies=False, gold=True, expected=True) == ["known-anchor-rejected"] and reasons(applies=False, expected=True) == ["expected-anchor-rejected"]
    assert reasons(snippet="") == reasons(snippet="no") == reasons(snippet=None) == ["snippet-not-source-locatable"]
    assert reasons(confidence=0.75, gold=True) == ["low-confidence-known-anchor"] and reasons(confidence=None) == ["low-confidence-positive"]
    assert reasons(indicator="6.1", context="a duty except") == ["ban-vs-condition-ambiguity"] and reasons(indicator="P7-I5", context="a duty by court order") == ["judicial-access-ambiguity"]


def test_recovered_anchors_keep_half_a_confidence(spark):
    rows = [(1, False, 0.9, "s", "whole"), (2, False, 0.0, "s", "whole"), (3, True, 0.9, "s", "whole"), (4, False, 0.3, "s", "whole"), (5, None, None, "s", "whole")]
    df = spark.createDataFrame(rows, "id long, applies boolean, confidence double, snippet string, text string")
    got = {r.id: (r.applies, r.confidence, r.snippet, r.recovered) for r in review.recover_anchors(df, spark.createDataFrame([(1,), (1,), (2,), (3,), (5,), (None,)], "id long"), "id").collect()}
    assert got == {1: (True, 0.5, "whole", True), 2: (True, 0.5, "whole", True), 3: (True, 0.9, "s", False), 4: (False, 0.3, "s", False), 5: (True, 0.5, "whole", True)}


def test_interrupted_builds_are_not_taken_over(spark):
    provisions = spark.createDataFrame([("a", "f", "g0", k) for k in range(3)] + [("b", "f", "g0", 9), (None, "f", "g0", 10)], "economy string, fingerprint string, generation string, id long")
    builds = spark.createDataFrame([("a", "f", 2, "g0"), ("b", "f", 1, "g0")], "economy string, fingerprint string, unit_count long, generation string")
    stamped = lambda b: {(r.economy, r.generation) for r in review.restamp(provisions, b, "g1").collect()}
    assert stamped(builds) == {("a", "g0"), ("b", "g1"), (None, "g0")}
    done = spark.createDataFrame([("a", "f", 3, "g1"), ("b", "f", 0, "g1")], builds.schema)
    assert stamped(review.complete_build(builds, done)) == {("a", "g1"), ("b", "g1"), (None, "g0")}


def test_verdicts_need_one_version_and_all_new_findings(spark):
    found = spark.createDataFrame([("i", "l", "1", "NEW"), ("i", "l", "2", "KNOWN")], "indicator string, law string, article string, tag string")
    of = lambda rows: [r.verdict for r in review.with_verdicts(found, spark.createDataFrame(rows, "indicator string, law string, article string, version string, verdict string, fresh boolean"), "v2").orderBy("article").collect()]
    assert of([("i", "l", "1", "v2", "holds", True)]) == ["holds", None]
    assert of([("i", "l", "1", "v1", "holds", True)]) == of([("i", "l", "1", "v2", "holds", False)]) == of([("i", "l", "2", "v2", "holds", True)]) == of([]) == [None, None]


def test_windows_of_pages_hold_their_units(spark):
    from lodestrata.operators import segmentation

    rnd = random.Random(4)
    words = ["a", "b", "c", "dd", "e"]
    pages = [(v, p * 2, None if p == 3 else " ".join(rnd.choice(words) for _ in range(rnd.randrange(6)))) for v in (1, 2) for p in range(9)]
    text = {v: [t or "" for w, _, t in pages if w == v] for v in (1, 2)}
    number = {v: [p for w, p, _ in pages if w == v] for v in (1, 2)}
    units = [(k, rnd.choice([1, 2]), " ".join(rnd.choice(words) for _ in range(rnd.randrange(9)))) for k in range(80)] + [(100, 1, " ".join(text[1][0:3])), (101, 2, " ".join(text[2])[3:40]), (102, 1, None), (103, 3, "a"), (104, 1, "a zz b")]
    want = set()
    for k, v, t in units:
        own = text.get(v, [])
        hit = t is not None and next(((n, i) for n in range(1, 7) for i in range(len(own) - n + 1) if t in " ".join(own[i : i + n])), None)
        if hit:
            want.add((k, v, number[v][hit[1]], number[v][hit[1] + hit[0] - 1]))
    found = segmentation.page_windows(spark.createDataFrame(units, "unit_id long, volume long, text string"), spark.createDataFrame(pages, "volume long, page long, text string"))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 20


def test_cosine_in_small_matrices(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    vectors = spark.createDataFrame([(k, [float(k * k % 7 - 3), float(k % 5 - 2), 1.0]) for k in range(40)], "item_id long, embedding array<double>")
    queries = vectors.where("item_id % 3 = 0").withColumnRenamed("item_id", "query_id")
    found = lambda: sorted(map(tuple, retrieval.cosine_topk(vectors, queries, 4).collect()))
    whole = found()
    # Whole texts and vectors come in small batches, and a matrix has a bounded number of queries.
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    monkeypatch.setattr(retrieval, "_CELLS", 20)
    assert found() == whole and whole


def test_lines_of_runs_of_words_are_those_of_their_words(spark):
    runs = [(1, 0, ["a", "", "b c"]), (1, 3, ["d"]), (2, 5, ["x", None, "z"]), (2, 6, ["y"]), (3, 0, ["one", "two"]), (4, 2, []), (5, 1, [""])]
    words = [(doc, k + i, w) for doc, k, run in runs for i, w in enumerate(run)]
    got = lambda rows, kind: {r.doc: (r.place, r.line) for r in corpus.words_to_lines(spark.createDataFrame(rows, f"doc long, k int, w {kind}"), ["doc"], "k", "w").collect()}
    assert got(runs, "array<string>") == got(words, "string") | {4: (2, "")}
    assert got(words, "string") == {1: (0, "a  b c d"), 2: (5, "x y z"), 3: (0, "one two"), 5: (1, "")}
    late = spark.createDataFrame([("b", "2"), ("a", "1")], "k string, w string").selectExpr("0 doc", "*")
    assert corpus.words_to_lines(late, ["doc"], "k", "w").first().line == "1 2"


@pytest.mark.parametrize("block", [1, 3, 8])
def test_page_windows_across_blocks_of_pages(spark, monkeypatch, block):
    monkeypatch.setattr(segmentation, "BLOCK", block)
    pages = [(1, 2 * k, f"a w{k % 9} b{k} c") for k in range(21)] + [(2, 5, None), (2, 6, "a"), (3, 0, "p q r")]
    text = {v: [x or "" for w, _, x in pages if w == v] for v in (1, 2, 3)}
    number = {v: [p for w, p, _ in pages if w == v] for v in (1, 2, 3)}
    units = [(k, 1, " ".join(text[1][k : k + n])) for k, n in [(0, 1), (1, 6), (7, 2), (8, 1), (6, 4), (15, 6), (3, 7)]]
    units += [(20, 1, "w4"), (21, 1, "c a w8 b8"), (22, 2, "a"), (23, 2, ""), (24, 2, None), (25, 3, "q r"), (26, 1, "c a"), (27, 3, "p x r")]
    expected = []
    for unit, volume, wanted in units:
        t = text[volume]
        found = [(n, i) for n in range(1, 7) for i in range(len(t) - n + 1) if wanted is not None and wanted in " ".join(t[i : i + n])]
        if found:
            n, i = min(found)
            expected.append((unit, volume, number[volume][i], number[volume][i + n - 1]))
    units = spark.createDataFrame(units, "unit_id long, volume long, text string")
    got = segmentation.page_windows(units, spark.createDataFrame(pages, "volume long, page int, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
