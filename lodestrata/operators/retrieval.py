"""The three retrieval legs and their union."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import plain_letters

#: Fixed values of the retrieval legs.
PHRASE_SCORE, LEG_LIMIT, DENSE_FLOOR, UNION_CAP = 10.0, 40, 0.25, 400
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: A pass takes phrases or query vectors up to this many bytes; more take more passes.
PACK_BYTES = 32 << 20


def _packs(df: DataFrame, size: str, key: str) -> Iterator[list]:
    """The rows of df in packs of about PACK_BYTES, dealt by a hash of key."""
    total = df.agg(F.sum(F.expr(size))).first()[0] or 0
    n = max(1, -(-total // PACK_BYTES))
    for k in range(n):
        yield df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k).collect()


def _small_batches(texts: DataFrame) -> None:
    """Bounds what a Python worker holds of whole texts or vectors at once, whatever the size of its partition."""
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def exact_phrases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, item_id, sparse) where a text (item_id, text) holds a phrase (query_id, phrase), case folded.

    An automaton finds all phrases of a pack in one pass over the texts, whatever their number."""
    import ahocorasick

    _small_batches(texts)
    spark, out = texts.sparkSession, None
    low = texts.select("item_id", F.lower("text").alias("text"))
    wanted = phrases.select("query_id", F.lower("phrase").alias("phrase")).where("trim(phrase) <> ''").distinct()
    for rows in _packs(wanted, "octet_length(phrase)", "phrase"):
        by: dict[str, list] = {}
        for r in rows:
            by.setdefault(r.phrase, []).append(r.query_id)
        sent = spark.sparkContext.broadcast(by)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for phrase, ids in sent.value.items():
                machine.add_word(phrase, ids)
            if sent.value:
                machine.make_automaton()
            for batch in batches:
                at, query = [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    found = {i for _, ids in machine.iter(text or "") for i in ids} if sent.value else ()
                    at += [k] * len(found)
                    query += sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), batch.column("item_id").take(pa.array(at, pa.int64()))], names=["query_id", "item_id"])

        part = low.mapInArrow(run, f"query_id long, item_id {dict(low.dtypes)['item_id']}")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("sparse", F.lit(PHRASE_SCORE))


#: Scores that are held at once, texts of a batch times queries.
_SCORES = 1 << 22
_WORD = re.compile(r"[^\W_]+")


def bm25(texts: DataFrame, queries: DataFrame, limit: int | None = LEG_LIMIT, allowed: Column | None = None) -> DataFrame:
    """(query_id, item_id, sparse, rank): Okapi BM25 of any query term (query_id, term); idf has a floor.

    Corpus statistics cover all texts; `allowed` limits what is ranked, before the limit.  Packs of queries
    are scored against every batch of texts, and a task hands on its own best `limit` of each query, so no
    row is made for a query and a text that doesn't rank.  The document frequencies that are gathered are
    those of a pack's terms.  Without a limit all scores come, unranked."""
    _small_batches(texts)
    spark, out = texts.sparkSession, None
    ok = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    plain = texts.select("item_id", plain_letters(F.col("text")).alias("text"), ok.alias("ok"))
    kind = dict(plain.dtypes)["item_id"]
    for rows in _packs(queries.select("query_id", "term").distinct(), "octet_length(term)", "query_id"):
        ids = sorted({r.query_id for r in rows})
        terms = {t: k for k, t in enumerate(sorted({r.term for r in rows}))}
        at = {q: k for k, q in enumerate(ids)}
        pairs = np.array(sorted((terms[r.term], at[r.query_id]) for r in rows), dtype=np.int64).reshape(-1, 2)
        sent = spark.sparkContext.broadcast((ids, terms, pairs))

        def found(batch: pa.RecordBatch, terms: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """The lengths of texts (-1 for null) and, text by text, the terms that they hold and how often."""
            length, row, term, n = np.full(batch.num_rows, -1), [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                if text is not None:
                    words = _WORD.findall(text)
                    length[k] = len(words)
                    own = Counter(filter(terms.__contains__, words))
                    row += [k] * len(own)
                    term += map(terms.__getitem__, own)
                    n += own.values()
            return length, *(np.array(x, dtype=np.int64) for x in (row, term, n))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            _, terms, _ = sent.value
            df, texts_, words_, known = np.zeros(len(terms), dtype=np.int64), 0, 0, 0
            for batch in batches:
                length, _, term, _ = found(batch, terms)
                np.add.at(df, term, 1)
                texts_, words_, known = texts_ + len(length), words_ + int(length[length >= 0].sum()), known + int((length >= 0).sum())
            own = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array([-3, -2, -1, *own.tolist()], pa.int64()), pa.array([known, words_, texts_, *df[own].tolist()], pa.int64())], names=["term", "n"])

        counts = {r.term: r.n for r in plain.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n, mean = counts.get(-1, 0), counts.get(-2, 0) / max(counts.get(-3, 0), 1) or 1.0
        df = np.array([counts.get(k, 0) for k in range(len(terms))], dtype=np.float64)
        idf = np.log((n - df + 0.5) / (df + 0.5))
        weights = spark.sparkContext.broadcast(np.where(idf > 0, idf, LEAST_IDF))

        def score(batches: Iterator[pa.RecordBatch], sent=sent, weights=weights, mean=mean) -> Iterator[pa.RecordBatch]:
            ids, terms, pairs = sent.value
            starts = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
            best: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
            held = 0

            def cut(parts: list) -> list:
                query, item, got = np.concatenate([p[0] for p in parts]), pa.concat_arrays([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
                order = np.lexsort((item.to_numpy(zero_copy_only=False), -got, query))
                first = np.searchsorted(query[order], query[order])
                order = order[np.arange(len(order)) - first < limit] if limit else order
                return [(query[order], item.take(pa.array(order)), got[order])]

            rows_ = max(1, _SCORES // max(len(ids), 1))
            for whole in batches:
                for at in range(0, whole.num_rows, rows_):
                    batch = whole.slice(at, rows_).filter(whole.slice(at, rows_).column("ok"))
                    length, row, term, f = found(batch, terms)
                    part = weights.value[term] * f * (K1 + 1) / (f + K1 * (1 - B + B * length[row] / mean))
                    many = starts[term + 1] - starts[term]
                    to = np.repeat(starts[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    cell = np.repeat(row * len(ids), many) + pairs[to, 1]
                    scores = np.round(np.bincount(cell, np.repeat(part, many), batch.num_rows * len(ids)), 6).reshape(-1, len(ids))
                    wanted = scores > 0
                    if limit and batch.num_rows > limit:
                        wanted &= scores >= np.partition(scores, batch.num_rows - limit, axis=0)[batch.num_rows - limit]
                    text, query = np.nonzero(wanted)
                    best += cut([(query, batch.column("item_id").take(pa.array(text)), scores[text, query])])
                    held += len(best[-1][0])
                    if limit is None or held > 4 * limit * len(ids):
                        if limit is None:
                            yield from told(best, ids)
                            best = []
                        else:
                            best = cut(best)
                        held = sum(len(b[0]) for b in best)
            if best:
                yield from told(cut(best), ids)

        def told(best: list, ids: list) -> Iterator[pa.RecordBatch]:
            for query, item, got in best:
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in query.tolist()], pa.int64()), item, pa.array(got)], names=["query_id", "item_id", "sparse"])

        part = plain.mapInArrow(score, f"query_id long, item_id {kind}, sparse double")
        out = part if out is None else out.unionByName(part)
    if limit is None:
        return out
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sparse"), "item_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= limit)


#: Similarities that are held at once, vectors of a batch times queries.
_CELLS = 1 << 20


def cosine_topk(vectors: DataFrame, queries: DataFrame, limit: int = LEG_LIMIT, floor: float = DENSE_FLOOR) -> DataFrame:
    """(query_id, item_id, dense, rank): each query's most similar vectors, cut at the floor after the limit.

    Packs of queries are multiplied with every batch of vectors; a batch hands on its own best `limit`."""
    _small_batches(vectors)
    spark, out = vectors.sparkSession, None
    for rows in _packs(queries, "8 * size(embedding)", "query_id"):
        rows = sorted(rows, key=lambda r: r.query_id)
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in rows], dtype=np.int64), np.array([r.embedding for r in rows], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                x = np.array(batch.column("embedding").to_pylist(), dtype=np.float64)
                item = batch.column("item_id").to_numpy()
                size = np.linalg.norm(x, axis=1)
                # Some queries at a time, so that no matrix grows with their number.
                some = max(1, _CELLS // len(x))
                for at in range(0, len(ids), some):
                    own, part = ids[at : at + some], q[at : at + some]
                    norms = np.linalg.norm(part, axis=1)[:, None] * size[None, :]
                    s = np.round(np.divide(part @ x.T, norms, out=np.zeros(norms.shape), where=norms > 0), 5)
                    order = np.lexsort((np.broadcast_to(item, s.shape), -s), axis=1)[:, :limit]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, order.shape[1])), pa.array(item[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["query_id", "item_id", "dense"])

        part = vectors.select("item_id", "embedding").mapInArrow(run, "query_id long, item_id long, dense double")
        out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("dense"), "item_id"))
    return out.withColumn("rank", rank).where((F.col("rank") <= limit) & (F.col("dense") >= floor))


def merge(*legs: DataFrame) -> DataFrame:
    """(item_id, sparse, dense, matched, combined) over legs of (query_id, item_id, sparse and/or dense):
    the best of each score, and the queries in order, repeats kept."""
    both = None
    for leg in legs:
        zero = {c: F.lit(0.0) for c in ("sparse", "dense") if c not in leg.columns}
        leg = leg.withColumns(zero).select("query_id", "item_id", "sparse", "dense")
        both = leg if both is None else both.unionByName(leg)
    out = both.groupBy("item_id").agg(F.max("sparse").alias("sparse"), F.max("dense").alias("dense"), F.array_sort(F.collect_list("query_id")).alias("matched"))
    return out.withColumn("combined", F.round(F.col("dense") + F.least("sparse", F.lit(10.0)) / 10, 6))


def capped(candidates: DataFrame, cap: int = UNION_CAP) -> DataFrame:
    """The `cap` best candidates with their rank; ties go to the smaller id."""
    best = candidates.orderBy(F.desc("combined"), "item_id").limit(cap)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("combined"), "item_id")))


def missing_embeddings(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """The texts (item_id, text) that have no vector yet."""
    return texts.join(vectors.select(F.col("item_id").alias("_id")), F.col("item_id") == F.col("_id"), "left_anti")
