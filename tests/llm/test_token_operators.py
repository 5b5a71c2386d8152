"""Runs of words, token counts and alignment against brute force and the libraries, over odd rows too."""

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from lodestrata.llm import alignment, periodic, queries, token_counts

SF_DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_tokens string, runs int, a_ids string, _block int, pair string"
LONG = "alpha beta gamma delta. " * 20_000
POOL = "aaab  \n\t \x1c\x85 'st.,<|endoftext|>é日本🙂0123½²Ⅷ▁́‍_-=౜\0"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, "en", "a", "x", 1, "y", 2, "z") for k, t in texts], DOC)


def mixed(n, size, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(POOL) for _ in range(rnd.randrange(size))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "one two three " * 12), (3, "one two three " * 12), (None, "no id here " * 10), (5, LONG), (6, " \n\t "), (7, "Tab\tand\nline é 日本 🙂 ▁ <|endoftext|>"), (8, "x" * 5000)]
    return documents(spark, rows).cache()


# Runs of words


def brute_runs(w, least, times):
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            own = w[i : j + p]
            if len(own) >= max(least, times * p) and not any(own[:-q] == own[q:] for q in range(1, p)):
                out.append((i, len(own), p))
            i = j
    return sorted(out)


def strings(n, seed=0):
    rnd = random.Random(seed)
    for _ in range(n):
        w = [rnd.randrange(rnd.choice([1, 2, 3, 5, 50])) for _ in range(rnd.randrange(160))]
        for _ in range(rnd.randrange(3)):
            at, p = rnd.randrange(len(w) + 1), 1 + rnd.randrange(12)
            w[at:at] = ([rnd.randrange(4) for _ in range(p)] * 60)[: rnd.randrange(80)]
        yield w


@pytest.mark.parametrize("least, times", [(24, 3), (3, 3), (10, 4)])
def test_runs_equal_brute_force(least, times):
    for w in strings(400):
        assert periodic.runs(np.array(w, dtype=np.int32), least, times) == brute_runs(w, least, times)


def test_runs_of_fibonacci_and_few_probes(monkeypatch):
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    w = [ord(c) for c in b]
    expected = brute_runs(w, 24, 3)
    assert len(expected) > 100
    for probes in (1 << 20, 100):
        monkeypatch.setattr(periodic, "PROBES", probes)
        assert periodic.runs(np.array(w, dtype=np.int32)) == expected


def test_runs_of_many_words():
    assert periodic.runs(np.zeros(200_000, dtype=np.int32)) == [(0, 200_000, 1)]
    assert periodic.runs(np.tile(np.arange(40_000, dtype=np.int32), 5)) == [(0, 200_000, 40_000)]


def expected_digest(key, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    found = brute_runs([number[w] for w in words], 24, 3)
    best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_op11_equals_brute_force(spark):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op11_periodic(spark, SF_DIR).collect()}
    rows = [r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect() if len((r.text or "").split()) < 1500]
    assert rows and len(got) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    for r in rows:
        assert got[r.doc_id] == expected_digest(r.doc_id, r.text)
    assert any(v[0] for v in got.values())


def test_runs_of_odd_rows(spark, odd):
    found = periodic.find(odd)
    assert found.columns == [c for c in DOC_NAMES if c != "runs"] + ["n_words", "runs"]
    got = sorted(found.collect(), key=lambda r: (r.doc_id or 0, r.text or ""))
    runs = collections.defaultdict(list)
    for r in got:
        runs[r.doc_id].append((r.n_words, [tuple(x) for x in r.runs]))
    assert runs[1] == runs[2] == runs[6] == [(0, [])]
    assert runs[3] == [(36, [(0, 36, 3)])] * 2 and runs[None] == [(30, [(0, 30, 3)])]
    assert runs[5] == [(80_000, [(0, 80_000, 4)])] and runs[8] == [(1, [])] and runs[7] == [(8, [])]
    collapsed = sorted(((r.doc_id or 0, r.text) for r in periodic.collapse(odd).collect()), key=str)
    assert (3, "one two three") in collapsed and (5, "alpha beta gamma delta.") in collapsed and (1, None) in collapsed and (6, " \n\t ") in collapsed
    digest = {r.doc_id: tuple(r)[1:] for r in periodic.digest(odd).collect()}
    assert digest[2] == expected_digest(None, "") == digest[1] and digest[None] == expected_digest(None, "no id here " * 10)
    assert periodic.find(odd.limit(0)).count() == periodic.digest(odd.limit(0)).count() == 0


DOC_NAMES = [x.split()[0] for x in DOC.split(", ")]

# Token counts


@pytest.fixture(scope="module")
def vocabulary():
    with open(queries.byte_vocabulary(), encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(vocabulary)


def test_counts_and_ids_equal_the_library(vocabulary, library, monkeypatch):
    from tokenizers import Tokenizer

    rnd = random.Random(5)
    texts = mixed(1500, 60) + ["a" * n for n in (1, 190, 193, 1000, 5001)] + [" " * 300, "ab" * 700, "=-" * 999, "", "".join(rnd.choice("abcdefghijklmnop") for _ in range(20_000)), "x<|endoftext|>y <|endoftext|>" * 3, "end \n", "a \x1c b", "a ౜౜1"]
    plain = Tokenizer.from_str(vocabulary)
    plain.encode_special_tokens = True
    for long in (token_counts.LONG, 1, 10_000):
        monkeypatch.setattr(token_counts, "LONG", long)
        monkeypatch.setattr(token_counts, "CACHE", 50)
        bpe = token_counts.ByteBpe(vocabulary)
        for k in range(0, len(texts), 400):
            part = texts[k : k + 400]
            assert bpe.counts(part) == [len(library.encode(t, add_special_tokens=False).ids) for t in part]
            assert [x.tolist() for x in bpe.encode(part)] == [plain.encode(t, add_special_tokens=False).ids for t in part]


def test_vocabularies_that_are_not_supported(vocabulary):
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            token_counts.ByteBpe(json.dumps(json.loads(vocabulary) | change))
    spec = json.loads(vocabulary)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    with pytest.raises(ValueError):
        token_counts.ByteBpe(json.dumps(spec))


def test_op12_equals_the_library(spark, library):
    got = {r.doc_id: r for r in queries.op12_token_counts(spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert tuple(got[r.doc_id]) == (r.doc_id, len((r.text or "").encode()), n, n > 1024)


def test_counts_of_odd_rows(spark, odd, library):
    counted = token_counts.count(odd, queries.byte_vocabulary())
    assert counted.columns == [c for c in DOC_NAMES if c != "n_tokens"] + ["n_bytes", "n_tokens", "over_limit"]
    rows = counted.collect()
    assert len(rows) == 9
    for r in rows:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit, r.lang, r.runs) == (len((r.text or "").encode()), n, n > 1024, "en", 1)
    assert token_counts.count(odd.limit(0), queries.byte_vocabulary()).count() == 0


# Alignment


@pytest.fixture(scope="module")
def sides(library, vocabulary):
    import sentencepiece
    from tokenizers import Tokenizer

    plain = Tokenizer.from_str(vocabulary)
    plain.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    letter = {x: b for b, x in enumerate(token_counts.byte_letters())}

    def sides(text):
        """Ids and bytes of both sides' tokens."""
        a, b = plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
        bytes_a = [bytes(letter[c] for c in plain.id_to_token(i)) if i != 50256 else b"" for i in a]
        bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        return a, bytes_a, b, bytes_b

    return sides


def brute_alignment(sides, text):
    if not text:
        return 0, 0, 0, [], ""
    a, bytes_a, b, bytes_b = sides(text)
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return 0, 0, 0, [], ""
    ends_a, ends_b = (np.cumsum([len(x) for x in own]).tolist() for own in (bytes_a, bytes_b))
    shared = sorted(set(ends_a) & set(ends_b))
    groups, i, j = [], 0, 0
    for cut in shared:
        m, n = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        i, j = m, n
    begin_a, begin_b = [0, *ends_a[:-1]], [0, *ends_b[:-1]]
    links = [(x, y) for x, s, e in zip(a, begin_a, ends_a, strict=True) for y, t, f in zip(b, begin_b, ends_b, strict=True) if max(s, t) < min(e, f)]
    return len(a), len(b), len(shared), links, ";".join(groups)


def brute_scores(sides, rows):
    each = [(k, brute_alignment(sides, t)) for k, t in rows]
    count = collections.Counter(link for _, x in each for link in x[3])
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(((k, *x[:3], len(x[3]), sum(count[p] == best[p[1]] for p in x[3]), sum(count[p] for p in x[3]), hashlib.sha256(x[4].encode()).hexdigest() if x[4] else "") for k, x in each), key=str)


def test_alignment_equals_brute_force(spark, sides, monkeypatch):
    texts = [*enumerate(mixed(150, 50, 7)), (200, None), (201, ""), (202, " "), (203, "▁"), (204, "\0a"), (205, "a\n\n  b<|endoftext|>"), (206, "same words here"), (206, "same words here"), (None, "no id")]
    docs = documents(spark, texts).repartition(3)
    for size in (alignment.PART_BYTES, 40):
        monkeypatch.setattr(alignment, "PART_BYTES", size)
        got = alignment.score(docs, queries.byte_vocabulary(), queries.piece_model())
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_scores(sides, texts)
    assert alignment.score(docs.limit(0), queries.byte_vocabulary(), queries.piece_model()).count() == 0


@pytest.mark.parametrize("n", range(60, 70))
def test_bits_of_any_length(n):
    places = np.array([k for k in range(1, n + 1) if k % 3 == 0 or k == n])
    bits = alignment.Bits.at(places, n)
    assert bits.select().tolist() == places.tolist()
    assert bits.rank(np.arange(n + 2)).tolist() == [int((places < k).sum()) for k in range(n + 2)]


def test_op13_equals_brute_force(spark, sides, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("length(text) < 3000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_alignment(spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_scores(sides, [(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_of_odd_rows(spark, odd, sides):
    aligned = alignment.align(odd, queries.byte_vocabulary(), queries.piece_model())
    assert aligned.columns == [c for c in DOC_NAMES if c != "a_ids"] + ["a_ids", "b_ids", "a_ends", "b_ends"]
    for r in aligned.collect():
        if len(r.text or "") > 10_000:
            assert r.a_ends[-1] == len(r.a_ids) and r.b_ends[-1] == len(r.b_ids)
            continue
        cut = lambda ids, ends: [",".join(map(str, ids[s:e])) for s, e in zip([0, *ends], ends, strict=False)]
        groups = ";".join(f"{x}|{y}" for x, y in zip(cut(r.a_ids, r.a_ends), cut(r.b_ids, r.b_ends), strict=True))
        assert groups == brute_alignment(sides, r.text)[4]
    scored = alignment.score(odd, queries.byte_vocabulary(), queries.piece_model()).collect()
    assert len(scored) == 9 and {r.doc_id: r.n_links for r in scored}[7] == 0
