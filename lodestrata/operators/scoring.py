"""Scores, agreement and operating statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nominal_alpha(ratings: DataFrame) -> DataFrame:
    """One row (alpha, units, ratings) over ratings(unit, value): 1 - observed / expected disagreement.

    Observed disagreement runs over ordered pairs within a unit, expected over pairs of all ratings, those
    of single-rated units included; one value gives 1, no pair gives null."""
    cells = ratings.where("value is not null").groupBy("unit", "value").agg(F.count("*").alias("n"))
    units = cells.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("same"))
    seen = units.agg(F.sum(F.when(F.col("m") > 1, (F.col("m") * F.col("m") - F.col("same")) / (F.col("m") - 1))).alias("apart"), F.sum(F.when(F.col("m") > 1, F.col("m"))).alias("paired"), F.count("*").alias("units"))
    values = cells.groupBy("value").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("equal"), F.count("*").alias("kinds"))
    expected = (F.col("all") * F.col("all") - F.col("equal")) / (F.col("all") * (F.col("all") - 1))
    alpha = F.when(F.col("paired").isNull(), None).when(F.col("kinds") == 1, 1.0).otherwise(1 - F.col("apart") / F.col("paired") / expected)
    one = seen.withColumn("_k", F.lit(1)).join(values.withColumn("_k", F.lit(1)), "_k")
    return one.select(F.round(alpha, 3).alias("alpha"), "units", F.col("all").alias("ratings"))


# The scores of indicators without evidence, with evidence of some sectors only, and with evidence that
# holds for all sectors.
SCORES = {
    "P6-I1": (0.0, 0.5, 1.0),
    "P6-I2": (0.0, 0.5, 1.0),
    "P6-I3": (0.0, 1.0, 1.0),
    "P6-I4": (0.0, 0.5, 1.0),
    "P6-I5": (1.0, 0.0, 0.0),
    "P7-I1": (1.0, 0.5, 0.0),
    "P7-I2": (1.0, 0.5, 0.0),
    "P7-I3": (0.0, 1.0, 1.0),
    "P7-I4": (0.0, 0.5, 1.0),
    "P7-I5": (0.0, 1.0, 1.0),
}
COURT_GATED = "COURT-GATED"


def indicator_score(indicator: Column, real: Column, horizontal: Column, gated: Column) -> Column:
    """The score that an indicator's number of real rows, whether one of them is horizontal, and how many of them stand
    under a court's control give; access that is so controlled throughout scores 0, as do unknown indicators."""
    out = F.lit(0.0)
    for name, (none, some, all_) in SCORES.items():
        own = F.when(real == 0, none).when(horizontal, all_).otherwise(some)
        out = F.when(indicator == name, own).otherwise(out)
    return F.when((indicator == "P7-I5") & (real > 0) & (gated == real), 0.0).otherwise(out)


def indicator_scores(evidence: DataFrame, keys: list[str], indicators: DataFrame) -> DataFrame:
    """indicators(keys, indicator) with real, horizontal and score, from evidence(keys, indicator, section, coverage,
    notes): rows whose section is empty or n/a are no evidence."""
    real = F.coalesce(~F.col("section").isin("n/a", ""), F.lit(False))
    flat = F.col("coverage").startswith("Horizontal")
    names = [*keys, "indicator"]
    gated = F.contains(F.concat_ws(" ", *(F.col(c).cast("string") for c in evidence.columns)), F.lit(COURT_GATED))
    each = evidence.where(real).groupBy(*(F.col(c).alias(f"_{c}") for c in names)).agg(F.count("*").alias("real"), F.coalesce(F.bool_or(flat), F.lit(False)).alias("horizontal"), F.count_if(gated).alias("_gated"))
    met = indicators.select(*names).distinct().join(each, [F.col(c) == F.col(f"_{c}") for c in names], "left").fillna(0, ["real", "_gated"]).fillna(False, ["horizontal"])
    return met.select(*names, "real", "horizontal", indicator_score(F.col("indicator"), F.col("real"), F.col("horizontal"), F.col("_gated")).alias("score"))


def score_band(values: list[Column], own: Column, gold: Column) -> dict[str, Column]:
    low, high = F.least(own, *values), F.greatest(own, *values)
    return {"low": low, "high": high, "spread": high - low, "divergence": F.abs(own - gold), "review": (high - low >= 0.5) | F.coalesce(own != gold, F.lit(False))}


def majority(votes: DataFrame, keys: list[str], against: Column) -> DataFrame:
    """Two refutations reject, none keeps, one splits; votes without a verdict stay out."""
    n = F.count_if(against)
    return votes.groupBy(*keys).agg(n.alias("refuted"), F.count(against).alias("votes"), F.when(n >= 2, "RECOMMEND-REJECT").when(n == 0, "RECOMMEND-KEEP").otherwise("SPLIT-REVIEW").alias("verdict"))


def histogram(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by columns with hist, 'value:count' pairs in the order of the values."""
    n = rows.groupBy(*by, F.coalesce(F.col(value).cast("string"), F.lit("")).alias("_v")).agg(F.count("*").alias("_n"))
    return n.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_v", F.col("_n").cast("string")))), ",").alias("hist"))


def token_cost(tokens_in: Column, cached: Column, tokens_out: Column, price_in: Column, price_out: Column, batch: Column) -> Column:
    """Cached input (at most the input) costs a tenth, batches half."""
    cached = F.least(cached, tokens_in)
    full = ((tokens_in - cached) * price_in + cached * price_in * 0.1 + tokens_out * price_out) / 1e6
    return F.when(batch, full / 2).otherwise(full)
