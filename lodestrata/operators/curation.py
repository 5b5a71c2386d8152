"""Shortlists and the decision ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import directness, legal_function


def curate(rows: DataFrame, by: list[str], kind: str, rank: list[Column], limit: Column | int) -> DataFrame:
    """rows with chosen and place: in each group the best row of every kind first, then the others by rank,
    up to the limit."""
    group = [F.col(c) for c in by]
    first = F.row_number().over(Window.partitionBy(*group, kind).orderBy(*rank)) == 1
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_first"), *rank))
    out = rows.withColumn("_first", first).withColumn("place", place).drop("_first")
    return out.withColumn("chosen", F.col("place") <= limit)


#: How many findings of an instrument an indicator keeps; two for any other.
LIMITS = {"P7-I1": 1, "P7-I2": 2, "P7-I3": 3, "P7-I4": 2, "P7-I5": 2}
FINDING = ["economy", "indicator", "law"]


def curate_findings(findings: DataFrame) -> DataFrame:
    """findings(economy, indicator, law, section, snippet, rationale, tag, alignment, risks, confidence) with
    legal_function, place and chosen: of the NEW ones of an instrument those kept are, best first, one for each legal
    function and then the others, up to the indicator's limit.  Known findings and absences are all chosen, without a
    place.  Better is: aligned, direct, fewer risks (an array), more confident, pinpointed, the later section."""
    said = F.concat_ws(" ", F.coalesce("snippet", F.lit("")), F.coalesce("rationale", F.lit("")))
    out = findings.withColumn("legal_function", legal_function(said)).withColumn("_new", F.coalesce((F.col("tag") == "NEW") & ~F.contains(F.col("snippet"), F.lit("NO_EVIDENCE_FOUND")), F.lit(False)))
    limit = F.lit(2)
    for name, n in LIMITS.items():
        limit = F.when(F.col("indicator") == name, n).otherwise(limit)
    rank = [
        F.desc(F.coalesce(F.col("alignment").isin("exact", "anchor"), F.lit(False))),
        F.desc(directness(F.col("indicator"), said)),
        F.coalesce(F.size("risks"), F.lit(0)),
        F.desc("confidence"),
        F.desc(F.contains(F.coalesce("section", F.lit("")), F.lit("("))),
        F.desc("section"),
    ]
    new = curate(out.where("_new"), FINDING, "legal_function", rank, limit)
    rest = out.where("not _new").withColumn("place", F.lit(None).cast("int")).withColumn("chosen", F.lit(True))
    return new.unionByName(rest).drop("_new")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest_decisions(ledger: DataFrame, key: str, kind: str, at: str, tie: str, correction: str, subjects: DataFrame | None = None) -> DataFrame:
    """The last decision of each key and kind that is newer than the key's last correction; with subjects
    (key, subject), only decisions on the current subject count."""
    fixed = ledger.where(F.col(kind) == correction).groupBy(F.col(key).alias("_key")).agg(F.max(at).alias("_since"))
    live = ledger.where(F.col(kind) != correction).join(fixed, F.col(key) == F.col("_key"), "left")
    live = live.where(F.col("_since").isNull() | (F.col(at) > F.col("_since"))).drop("_key", "_since")
    if subjects is not None:
        now = subjects.select(F.col(key).alias("_key"), F.col("subject").alias("_subject"))
        live = live.join(now, (F.col(key) == F.col("_key")) & (F.col("subject") == F.col("_subject"))).drop("_key", "_subject")
    return first_of(live, [key, kind], [F.desc(at), F.desc(tie)])


def effective_review(latest: DataFrame, key: str) -> DataFrame:
    """(key, state) from latest(key, stage, decision, reviewer): rejected if any stage is; approved if the
    citation and mapping stages are approved by different reviewers and the status stage is; else pending."""
    stage = lambda s, c: F.max(F.when(F.col("stage") == s, F.col(c)))
    each = latest.groupBy(key).agg(F.bool_or(F.col("decision") == "rejected").alias("no"), *(stage(s, "decision").alias(s) for s in ("citation", "mapping", "status")), *(stage(s, "reviewer").alias(f"{s}_by") for s in ("citation", "mapping")))
    yes = (F.col("citation") == "approved") & (F.col("mapping") == "approved") & (F.col("status") == "approved") & (F.col("citation_by") != F.col("mapping_by"))
    return each.select(key, F.when(F.col("no"), "rejected").when(yes, "approved").otherwise("pending").alias("state"))


def overlay(template: DataFrame, current: DataFrame, batch: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The template's keys with the values of the batch, else the current ones, else its own."""
    parts = [df.select(*keys, *values, F.lit(k).alias("_priority")) for k, df in enumerate((batch, current, template))]
    best = first_of(parts[0].unionByName(parts[1]).unionByName(parts[2]), keys, [F.col("_priority")])
    return best.join(template.select(*keys), keys, "left_semi").drop("_priority")


def replay(decisions: DataFrame, subjects: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Approved decisions on the current subject; and those that block a replay, with the reason."""
    now = subjects.select(F.col(key).alias("_key"), F.col("subject").alias("_subject"))
    met = decisions.join(now, F.col(key) == F.col("_key"), "left")
    reason = F.when(F.col("_key").isNull(), "unknown key").when(F.col("subject") != F.col("_subject"), "stale subject")
    met = met.withColumn("reason", reason).drop("_key", "_subject")
    return met.where(F.col("reason").isNull() & (F.col("decision") == "approved")).drop("reason"), met.where("reason is not null")


def page(rows: DataFrame, order: list[Column], number: int, size: int = 50, most: int = 200) -> DataFrame:
    """One page of ordered rows, numbered from 1."""
    size = min(size, most)
    numbered = rows.orderBy(*order).limit(number * size).withColumn("row", F.row_number().over(Window.orderBy(*order)))
    return numbered.where(F.col("row") > (number - 1) * size)


def quota_sample(rows: DataFrame, kind: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """Up to a quota of rows of each kind, in order."""
    limit = F.lit(0)
    for name, n in quotas.items():
        limit = F.when(F.col(kind) == name, n).otherwise(limit)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(*order))).where(F.col("place") <= limit)
