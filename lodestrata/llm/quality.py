"""Quality classifier: perplexity under a Kneser-Ney model of trusted text, cut at language-specific quantiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from . import kneser_ney as kn
from .blocks import Blocks
from .common import Guard, kept, scratch, stage

#: Perplexities are told apart by thousandths of their logarithm.
STEP = 1e-3
#: Trusted documents are dealt into so many parts, each with a model of its own.
PARTS = 2


def _trusted(labels: DataFrame) -> DataFrame:
    """(_id, part) of the documents labelled quality 1."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    return good.withColumn("part", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(PARTS)).cast("int"))


def model(found: DataFrame) -> DataFrame:
    """(x, q0, g0, q1, g1, ...): kn.parts() by n-gram; q of x as an n-gram, g (gamma) of x as a context."""
    none = F.lit(None).cast("double")
    own = found.select("x", "part", "q", none.alias("g"))
    contexts = found.groupBy("part", "h").agg(F.first("gamma").alias("g")).select(F.col("h").alias("x"), "part", none.alias("q"), "g")
    values = [F.max(F.when(F.col("part") == k, F.col(v))).cast("float").alias(f"{v}{k}") for k in range(PARTS) for v in "qg"]
    return own.unionByName(contexts).groupBy("x").agg(*values)


def perplexity(blocks: Blocks, counts: DataFrame) -> DataFrame:
    """(_block, _row, doc_id, lang, n_symbols, nll0, nll1, ...) of each document: the mean negative
    log-probability of a character under each part's model (null without characters or without the part)."""
    sizes = kn.symbols(counts)
    answers = kn.answers(kn.requests(blocks, 0), model(kn.parts(counts)))
    columns = ["_block", "_row", "doc_id", "lang"]
    schema = StructType([*(blocks.df.schema[c] for c in columns)]).add("n_symbols", LongType())
    for k in range(PARTS):
        schema = schema.add(f"nll{k}", DoubleType())
    values = [f"{v}{k}" for k in range(PARTS) for v in "qg"]

    def run(docs: pa.Table, table: pa.Table) -> pa.Table:
        total, n, last = np.zeros((PARTS, docs.num_rows)), np.zeros(docs.num_rows, dtype=np.int64), None
        for alphabet, rows, starts, keys in kn.grams(docs.column("text").to_pylist()):
            if alphabet is not last:
                last, lookup = alphabet, kn.Lookup(alphabet, table, values)
            x, at = np.unique(keys, return_inverse=True)
            p = np.tile([1 / sizes.get(k, 1) for k in range(PARTS)], (len(x), 1))
            for k in range(1, kn.ORDER + 1):
                q = np.nan_to_num(lookup(k, kn.suffix(x, k))[:, ::2])
                g = lookup(k - 1, kn.context(kn.suffix(x, k)))[:, 1::2]
                p = q + np.where(np.isnan(g), 1.0, g) * p
            logs = np.log(p)[at]
            np.add.at(total.T, rows, np.add.reduceat(logs, starts))
            np.add.at(n, rows, np.diff([*starts, len(keys)]))
        nll = [pa.array(-total[k] / np.maximum(n, 1), mask=(n == 0) | (k not in sizes)) for k in range(PARTS)]
        return pa.table([*(docs.column(c) for c in columns), pa.array(n), *nll], names=schema.names)

    return blocks.join(["doc_id", "lang", "text"], answers, run, schema)


def thresholds(scored: DataFrame, quantile: float) -> DataFrame:
    """(lang, bound): the smallest perplexity step that `quantile` of a language's trusted documents stay
    within.  A row with every lang pooled (lang_pooled) serves languages without trusted documents."""
    steps = scored.where("part is not null and nll is not null").select("lang", F.floor(F.col("nll") / STEP).alias("step"))
    one = steps.groupBy("lang", "step").count()
    both = one.withColumn("lang_pooled", F.lit(False)).unionByName(
        one.groupBy("step").agg(F.sum("count").alias("count")).withColumns({"lang": F.lit(None).cast("string"), "lang_pooled": F.lit(True)})
    )
    by = Window.partitionBy("lang_pooled", "lang")
    upto = F.sum("count").over(by.orderBy("step"))
    cut = both.select("lang", "lang_pooled", "step", upto.alias("upto"), F.sum("count").over(by).alias("all"))
    return cut.where(F.col("upto") >= quantile * F.col("all")).groupBy("lang_pooled", "lang").agg(((F.min("step") + 1) * STEP).alias("bound"))


def _judged(blocks: Blocks, labels: DataFrame, quantile: float) -> DataFrame:
    """(_block, _row, doc_id, lang, n_symbols, perplexity, bound, keep) of each document."""
    with scratch():
        scored = kept(_scored(blocks, _trusted(labels)))
    cuts = stage(thresholds(scored.withColumn("nll", F.col("unseen")), quantile), "quality-cuts")
    own = cuts.where("not lang_pooled").select(F.col("lang").alias("_lang"), F.col("bound").alias("_own"))
    pooled = cuts.where("lang_pooled").select("bound").first()
    bound = F.coalesce("_own", F.lit(pooled and pooled.bound).cast("double"))
    keep = (F.col("n_symbols") > 0) & F.coalesce(F.col("nll") < bound, F.lit(True))
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return out.select("_block", "_row", "doc_id", "lang", "n_symbols", F.exp("nll").alias("perplexity"), F.exp(bound).alias("bound"), keep.alias("keep"))


def _scored(blocks: Blocks, trusted: DataFrame) -> DataFrame:
    """(_block, _row, doc_id, lang, part, n_symbols, nll, unseen) of each document, staged: nll by the mean of all
    models; part of the trusted ones, and unseen, by the mean of the models of other parts."""
    counts = stage(kn.counts(blocks, blocks.labelled(trusted), ["part"]), "quality-counts")
    found = perplexity(blocks, counts).join(trusted.hint("merge"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
    names = [f"nll{k}" for k in range(PARTS)]
    told = F.filter(F.array(*names), lambda x: x.isNotNull())
    mean = lambda some: F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(some), F.lit(0))
    unseen = F.lit(None).cast("double")
    for k in range(PARTS):
        unseen = F.when(F.col("part") == k, mean(F.filter(F.array(*(F.col(n) for n in names if n != f"nll{k}")), lambda x: x.isNotNull()))).otherwise(unseen)
    return stage(found.withColumns({"nll": mean(told), "unseen": unseen}).drop(*names), "quality-scores")


def score(docs: DataFrame, labels: DataFrame, quantile: float = 0.997) -> DataFrame:
    """One row per document: doc_id, lang, n_symbols, perplexity, bound, keep.

    The documents labelled quality 1 are dealt into PARTS parts, and a model is trained on each.  Every document
    is judged by the mean log-probability of all models, so equal texts are judged alike, labelled or not.  It is
    kept if its perplexity stays within the bound that `quantile` of its language's trusted documents keep, where each
    of them is judged by the models of the other parts, which have not seen it.  Null and empty texts have no perplexity and aren't kept; a
    null lang is a language of its own; languages without trusted documents take the bound of all trusted
    documents; without any trusted document all other texts are kept.  Rows that share a doc_id share its label; repeated
    rows are judged alike.  An empty table gives no rows.  Other columns of docs are ignored."""
    blocks = Blocks(docs.select("doc_id", "lang", "text"))
    judged = _judged(blocks, labels, quantile).drop("_block", "_row")
    blocks.drop()
    return judged


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = 0.997) -> DataFrame:
    """docs without the documents that score() rejects, in the columns of docs."""
    guard = Guard(docs, ["doc_id", "lang", "text"])
    blocks = Blocks(guard.df)
    good = _judged(blocks, labels, quantile).where("keep").select("_block", "_row")
    names = guard.df.columns

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        stays = np.zeros(rows.num_rows, dtype=bool)
        stays[own.column("_row").to_numpy()] = True
        return rows.select(names).filter(pa.array(stays))

    return guard.restore(blocks.join(names, good, run, guard.df.schema))
