"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import Blocks
from .common import Guard, stage

#: Weights of the sources in code point order, repeating; the share of all words that a mix holds; how often
#: at most a document is taken.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Words of a block: a schedule has a slot for each, so it grows with the corpus.
BLOCK = 128
#: Slots are ranked in runs of so many.
RUN = 4096
#: A source's shuffled documents are added up in this many pieces.
PIECES = 1024
GOLDEN = 0.6180339887498949
_CELLS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """docs with size, the number of words of the text (0 for null), and _tag, which tells apart texts that share
    a doc_id."""
    return docs.withColumn("_tag", F.xxhash64("text")).withColumn("size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) for sizes(source, size): targets in proportion to the weights, none
    above `repeats` times its source's size, adding up to `share` of all words.

    The excess of capped sources is shared anew until none is above; so a source gets the smaller of its
    cap and its weight times one common level, which the sources in the order of cap / weight give."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    at = F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights)))
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (at + 1).cast("int")).cast("double"))
    each = each.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    upto = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    tried = each.withColumn("level", left / rest)
    # Of the sources that their level does not lift above their cap, the first has the greatest: that of all.
    common = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(common * F.col("weight"), F.col("cap")))
    return tried.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def placed(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """docs(doc_id, source, size) with source_size, target and start: the words of its source's shuffled
    documents before it."""
    key = F.xxhash64(F.lit(8), "doc_id")
    dealt = docs.withColumn("_key", key).withColumn("_piece", F.pmod("_key", F.lit(PIECES)))
    sums = dealt.groupBy("source", "_piece").agg(F.sum("size").alias("_sum"))
    before = sums.select(F.col("source").alias("_source"), F.col("_piece").alias("_of"), (F.sum("_sum").over(Window.partitionBy("source").orderBy("_piece")) - F.col("_sum")).alias("_before"))
    goals = goals.select(F.col("source").alias("_goal"), "source_size", "target")
    before = before.join(goals, F.col("_source").eqNullSafe(F.col("_goal"))).drop("_goal")
    order = [c for c in ("_key", "doc_id", "size", "_tag") if c in dealt.columns]
    within = F.sum("size").over(Window.partitionBy("source", "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = dealt.withColumn("_upto", within - F.col("size"))
    out = out.join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_piece") == F.col("_of")))
    return out.withColumn("start", F.col("_before") + F.col("_upto")).drop("_key", "_piece", "_upto", "_source", "_of", "_before")


def schedule(goals: DataFrame, block: int) -> DataFrame:
    """(source, rank, slot): the mix's blocks in their order, one for each `block` words of all targets.

    Slot i stands at the golden-ratio point frac(i * GOLDEN); the cumulative shares of the targets map it to
    a source, and a source's slots in their order take its blocks 0, 1, ...  So the points that fall into its
    share decide how many blocks a source gives, a few more or less than its target asks for, and where they
    stand.  A source whose share no point meets gives one block at the end.  Blocks end where the target does.  Slots are ranked within runs,
    after the slots of the runs before."""
    spark = goals.sparkSession
    total = goals.agg(F.sum("target")).first()[0] or 0
    n = int(total // block) + 1
    order = Window.orderBy(F.asc_nulls_last("source"))
    upto = F.sum("target").over(order)
    shares = goals.where("target > 0").select("source", (upto / total).alias("hi"), ((upto - F.col("target")) / total).alias("lo"), (F.row_number().over(order) + n).alias("late"))
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * _CELLS), F.floor(F.col("hi") * _CELLS))))
    points = spark.range(n).select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN) % 1.0).alias("point")).withColumn("_cell", F.floor(F.col("point") * _CELLS))
    met = points.join(F.broadcast(cells), F.col("_cell") == F.col("cell")).where("lo <= point and point < hi").select("source", "slot", F.floor(F.col("slot") / RUN).alias("_run"))
    sums = met.groupBy("source", "_run").agg(F.count("*").alias("_n"))
    missed = shares.join(sums.select(F.col("source").alias("_of")).distinct(), F.col("source").eqNullSafe(F.col("_of")), "left_anti").select("source", F.lit(0).cast("long").alias("rank"), F.col("late").cast("long").alias("slot"))
    before = sums.select(F.col("source").alias("_of"), F.col("_run").alias("_r"), (F.sum("_n").over(Window.partitionBy("source").orderBy("_run")) - F.col("_n")).alias("_before"))
    within = met.withColumn("_k", F.row_number().over(Window.partitionBy("source", "_run").orderBy("slot")) - 1)
    ranked = within.join(before, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_run") == F.col("_r"))).select("source", (F.col("_before") + F.col("_k")).alias("rank"), "slot")
    return ranked.unionByName(missed)


def takes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """placed documents, and (source, start, epoch, taken, slot): the words that the scheduled
    blocks take of the document at `start`, by epoch; slot is the first that takes some."""
    spots = stage(docs, "mixing")
    goals = stage(targets(spots.select("source", "size")), "mixing-targets")
    block = BLOCK
    plan = schedule(goals, block).select(F.col("source").alias("_source"), "rank", "slot")
    where = stage(placed(spots, goals), "mixing-places")
    runs = where.where("size > 0").select("source", "start", "size", F.round("target").cast("long").alias("goal"), F.explode(F.array(*(F.struct(F.lit(e).alias("epoch"), (F.col("start") + e * F.col("source_size")).alias("at")) for e in range(REPEATS)))).alias("x"))
    runs = runs.select("source", "start", "size", "goal", "x.epoch", "x.at")
    parts = runs.withColumn("part", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    met = parts.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("rank")))
    low = F.col("rank") * block
    # A source's last block ends at its target.
    taken = F.least(F.col("at") + F.col("size"), low + block, "goal") - F.greatest(F.col("at"), low)
    return where, met.withColumn("taken", taken).where("taken > 0").groupBy("source", "start", "epoch").agg(F.sum("taken").alias("taken"), F.min("slot").alias("slot"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, slots.

    size is the number of words; source_size and target those of the document's source; taken the words
    that the mix takes of it, at most REPEATS times its size.  A source's documents are shuffled by a hash
    of doc_id and cut, as one run of words that is passed REPEATS times, into equal blocks; the mix takes
    the blocks that schedule() has slots for, up to its target rounded to words, so a source gives its target or a
    few blocks less.  slots has the place of the document
    in the mix, the first slot of the schedule that takes some of it, for each pass that does; documents of
    one slot follow one another in their source's order.  Null texts have size 0 and give nothing; a
    null source is a source of its own, last in order; a null doc_id is shuffled like any other.  Repeated
    rows are documents of their own.  An empty table gives no rows.  Other columns are ignored."""
    where, pieces = takes(sized(docs.select("doc_id", "source", "text")).drop("text"))
    sums = pieces.groupBy("source", "start").agg(F.sum("taken").alias("taken"), F.array_sort(F.collect_list("slot")).alias("slots")).select(F.col("source").alias("_source"), F.col("start").alias("_start"), "taken", "slots")
    # Documents without words share their start with the next one.
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    out = where.join(sums, on, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.array().cast("array<long>")).alias("slots"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of docs and the order of the schedule: a row for each pass that takes
    some of a document, at the first slot that does.  Where a source's last block ends within a document, its
    row holds the words taken.  Documents without words (null and empty texts) are in no mix; repeated rows are
    documents of their own; an empty table gives no rows."""
    guard = Guard(docs, ["doc_id", "source", "text"])
    blocks = Blocks(guard.df)
    where, pieces = takes(sized(blocks.df.select("_block", "_row", "doc_id", "source", "text")).drop("text"))
    pieces = pieces.select(F.col("source").alias("_source"), F.col("start").alias("_start"), "epoch", "taken", "slot")
    places = where.where("size > 0").join(pieces, F.col("source").eqNullSafe(F.col("_source")) & (F.col("start") == F.col("_start")))
    names, added = guard.df.columns, ["size", "taken", "slot", "epoch", "start"]
    schema = StructType([*guard.df.schema.fields, *(places.schema[c] for c in added)])

    def run(rows: pa.Table, own: pa.Table) -> pa.Table:
        met = rows.select(names).take(own.column("_row"))
        return pa.table([*met.columns, *(own.column(c) for c in added)], names=schema.names)

    out = blocks.join(names, places.select("_block", "_row", *added), run, schema).orderBy("slot", "epoch", "start")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), F.col("taken").cast("int")), "")
    return guard.restore(out.withColumn("text", F.when(F.col("taken") < F.col("size"), cut).otherwise(F.col("text"))))
