"""Toxicity: class-conditional Kneser-Ney models compared by length-normalised log-likelihood."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from . import kneser_ney as kn
from .blocks import Blocks
from .common import kept, scratch, stage

#: Characters in a window; a document's features are the mean log-likelihood ratio of a character, over the
#: whole text and over its most toxic windows of these lengths.
WINDOWS = (8, 16, 24)
FEATURES = [f"x{k}" for k in range(len(WINDOWS) + 1)]
#: Training documents are dealt into so many parts, each with models of its own.
PARTS = 2
#: At most so many labelled rows calibrate the score.
CALIBRATION_ROWS = 20_000


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _known(labels: DataFrame) -> DataFrame:
    """(_id, part, toxic) of the documents to learn from."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.max("toxic") == 1).cast("int").alias("toxic"))
    return known.where(_fold(F.col("_id")) != 0).select("_id", F.pmod(F.xxhash64("_id", F.lit(2)), F.lit(PARTS)).cast("int").alias("part"), "toxic")


def ratios(counts: DataFrame) -> DataFrame:
    """(x, r0, r1, ...): for counts(part, toxic, x, n), the log-ratio of toxic to ordinary probability under
    the models of each part, of n-grams seen in either class and, under x, of those that begin with the
    context x and were not seen.

    A class's discounted counts back off to the Kneser-Ney model of the pooled counts, so what neither class
    tells apart gives nothing."""
    pooled = stage(counts.groupBy("part", "x").agg(F.sum("n").alias("n")), "toxicity-pooled")
    p = kn.probabilities(stage(kn.parts(pooled), "toxicity-parts"), kn.symbols(pooled))
    each = kn.discounted(counts.withColumnRenamed("n", "c"), ("part", "toxic")).withColumn("h", F.expr(f"left(x, {kn.ORDER - 1})"))
    of = lambda v, k: F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col(v))), F.lit(0.0))
    contexts = each.groupBy("part", "h").agg(*(of(v, k).alias(f"{n}{k}") for v, n in (("c", "t"), ("d", "l")) for k in (0, 1)))
    share = lambda v, k: F.when(F.col(f"t{k}") > 0, F.col(v) / F.col(f"t{k}"))
    contexts = contexts.select("part", "h", "t0", "t1", *(F.coalesce(share(f"l{k}", k), F.lit(1.0)).alias(f"g{k}") for k in (0, 1)))
    grams = each.groupBy("part", "x").agg(*(F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("c") - F.col("d"))), F.lit(0.0)).alias(f"a{k}") for k in (0, 1)))
    p = p.select(F.col("part").alias("_part"), F.col("x").alias("_x"), F.col("h").alias("_h"), "p")
    met = grams.join(p.hint("merge"), (F.col("part") == F.col("_part")) & (F.col("x") == F.col("_x"))).drop("_part", "_x")
    met = met.join(contexts.withColumnRenamed("part", "_part").hint("merge"), (F.col("part") == F.col("_part")) & (F.col("_h") == F.col("h")))
    own = [F.coalesce(share(f"a{k}", k), F.lit(0.0)) + F.col(f"g{k}") * F.col("p") for k in (0, 1)]
    seen = met.select("part", "x", (F.log(own[1]) - F.log(own[0])).alias("r"))
    unseen = contexts.select("part", F.col("h").alias("x"), (F.log("g1") - F.log("g0")).alias("r"))
    return seen.unionByName(unseen).groupBy("x").agg(*(F.max(F.when(F.col("part") == k, F.col("r"))).cast("float").alias(f"r{k}") for k in range(PARTS)))


def features(texts: list[str | None], table: pa.Table) -> np.ndarray:
    """For each part and text, the mean ratio of a character and its greatest mean over a window of each
    length; zeros for empty texts.  Slices of a long text are taken as they come, the greatest of any slice
    counts."""
    total, n, best = np.zeros((len(texts), PARTS)), np.zeros(len(texts)), np.full((len(WINDOWS), len(texts), PARTS), -np.inf)
    last = None
    for alphabet, rows, starts, keys in kn.grams(texts):
        if alphabet is not last:
            last, lookup = alphabet, kn.Lookup(alphabet, table, [f"r{k}" for k in range(PARTS)])
        x, at = np.unique(keys, return_inverse=True)
        seen = lookup(kn.ORDER, x)
        got = np.nan_to_num(np.where(np.isnan(seen), lookup(kn.ORDER - 1, kn.context(x)), seen))[at]
        np.add.at(total, rows, np.add.reduceat(got, starts))
        length = np.diff([*starts, len(keys)])
        np.add.at(n, rows, length)
        run = np.concatenate([np.zeros((1, PARTS)), np.cumsum(got, axis=0)])
        begin = np.repeat(starts, length)
        for k, w in enumerate(WINDOWS):
            # A window ending at i starts no earlier than its text.
            first = np.maximum(np.arange(1, len(run)) - w, begin)
            np.maximum.at(best[k], rows, np.maximum.reduceat((run[1:] - run[first]) / w, starts))
    full = np.where(np.isfinite(best), best, 0)
    return np.stack([total / np.maximum(n, 1)[:, None], *full], axis=2).transpose(1, 0, 2)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A ridge-penalised logistic regression by Newton's method: centre, scale, weights (bias last)."""
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), np.append(np.zeros(x.shape[1]), np.log(rate / (1 - rate)))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], 0.1), 1e-6)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def featured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, toxic, x0, ..., unseen_x0, ...): the features of each document in lower case by the mean of all
    models, whatever its labels and doc_id; of those learned from also part, toxic and the features by the models of
    the other parts."""
    blocks, known = Blocks(docs.select("doc_id", F.lower("text").alias("text"))), _known(labels)
    mine = blocks.labelled(known)
    counts = stage(kn.counts(blocks, mine, ["part", "toxic"]), "toxicity-counts")
    answers = kn.answers(kn.requests(blocks, kn.ORDER - 1), ratios(counts))
    schema = StructType([blocks.df.schema["doc_id"]])
    for k in range(PARTS):
        for name in FEATURES:
            schema = schema.add(f"{name}_{k}", DoubleType())

    def run(rows: pa.Table, table: pa.Table) -> pa.Table:
        every = features(rows.column("text").to_pylist(), table)
        return pa.table([rows.column("doc_id"), *(pa.array(every[k][:, j]) for k in range(PARTS) for j in range(len(FEATURES)))], names=schema.names)

    found = blocks.join(["doc_id", "text"], answers, run, schema).join(known.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    mean = lambda name, ks: sum(F.col(f"{name}_{k}") for k in ks) / len(ks)

    def unseen(name: str) -> Column:
        out = F.lit(None).cast("double")
        for k in range(PARTS):
            out = F.when(F.col("part") == k, mean(name, [j for j in range(PARTS) if j != k])).otherwise(out)
        return out

    return found.select("doc_id", "part", "toxic", *(mean(n, range(PARTS)).alias(n) for n in FEATURES), *(unseen(n).alias(f"unseen_{n}") for n in FEATURES))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted.

    Learns from labelled rows whose crc32(doc_id) mod 5 is not 0, in PARTS parts.  The n-gram counts of all
    of them, by part and class, make the models.  The score is one logistic function of the text's features, so equal
    texts score equal; it is fitted on at most CALIBRATION_ROWS of the rows learned from, there none judged by a model
    that has seen it.  Null and empty texts take
    the score of features that are all 0.  A null doc_id counts as not held out; repeated rows score alike;
    a document with contradicting labels counts as toxic; null labels are ignored.  Without toxic or without
    ordinary rows all documents score the base rate.  An empty table gives no rows.  Only doc_id and text of
    docs are read."""
    with scratch():
        found = kept(stage(featured(docs, labels), "toxicity"))
    unseen = [f"unseen_{n}" for n in FEATURES]
    rows = found.where("toxic is not null").orderBy(F.xxhash64("doc_id"), "doc_id", *unseen).limit(CALIBRATION_ROWS).select("toxic", *unseen).toArrow()
    x = np.column_stack([rows.column(n).to_numpy() for n in unseen])
    y = rows.column("toxic").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # sums in one order
    centre, scale, weights = fit(x[order], y[order])
    z = F.lit(float(weights[-1]))
    for name, c, s, w in zip(FEATURES, centre, scale, weights, strict=False):
        z = z + (F.col(name) - float(c)) / float(s) * float(w)
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    held = F.coalesce(_fold(F.col("doc_id")) == 0, F.lit(False))
    out = found.select("doc_id", held.alias("held_out"), p.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
