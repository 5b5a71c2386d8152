"""Operators over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.gates import CROSS_REFERENCE, REFERENCE_REACH


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(node, hop): the nodes within `hops` undirected steps of seeds(node), at their least distance."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    found = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for k in range(1, hops + 1):
        front = found.where(F.col("hop") == k - 1).join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(k).alias("hop"))
        found = found.unionByName(front).groupBy("node").agg(F.min("hop").alias("hop"))
    return found


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends are among nodes(node)."""
    one = edges.join(nodes.select(F.col("node").alias("_n")), F.col("src") == F.col("_n"), "left_semi")
    return one.join(nodes.select(F.col("node").alias("_n")), F.col("dst") == F.col("_n"), "left_semi")


def paths(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, b, c) of distinct two-step paths over first(src, dst) and second(src, dst)."""
    return first.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(second.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b").select("a", "b", "c").distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose target is no node."""
    return edges.join(nodes.select(F.col("node").alias("_n")), F.col("dst") == F.col("_n"), "left_anti")


def section_references(provisions: DataFrame) -> DataFrame:
    """(src, rel, dst) for provisions(id, economy, law, text): an edge to each section of the same act that the first
    REFERENCE_REACH characters name; references to another act that is named give none."""
    near = F.substring(F.coalesce(F.col("text"), F.lit("")), 1, REFERENCE_REACH)
    base, act = (F.regexp_extract_all(near, F.lit(CROSS_REFERENCE), F.lit(k)) for k in (1, 2))
    met = provisions.select("id", "economy", "law", F.explode(F.arrays_zip(base.alias("base"), act.alias("act"))).alias("x"))
    met = met.where((F.col("x.act") == "") | F.lower(F.trim(F.col("x.act"))).rlike("^(this |that |the said)"))
    target = F.concat(F.lit("section:"), "economy", F.lit(":"), "law", F.lit(":s. "), F.upper("x.base"))
    return met.select(F.col("id").alias("src"), F.lit("CROSS_REFERENCES").alias("rel"), target.alias("dst")).distinct()
