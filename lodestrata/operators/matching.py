"""Law identity, section ladders, NEW/KNOWN tags, anchors and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import family, law_tokens, same_law, section_ancestors
from lodestrata.session import spread


def law_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right) of distinct names (column law) of both sides that mean one law.

    One side's tokens, or its family's, lie within the other's, so the other has the rarest of them: candidates
    come from an equality join of the rarest tokens of either side with all tokens of the other, which no
    common word can swell."""
    sides = [df.select("law").distinct().withColumn("tokens", law_tokens(F.col("law"))) for df in (left, right)]
    every = [side.select("law", "tokens", F.explode("tokens").alias("t")) for side in sides]
    often = every[0].select("t").unionByName(every[1].select("t")).groupBy("t").agg(F.count("*").alias("n")).withColumnRenamed("t", "_t")

    def rarest(side: DataFrame) -> DataFrame:
        met = side.join(often, F.col("t") == F.col("_t"))
        at = F.struct("n", "t")
        kin = F.array_contains(family(F.col("tokens")), F.col("t"))
        found = met.groupBy("law").agg(F.first("tokens").alias("tokens"), F.min(at).alias("one"), F.min(F.when(kin, at)).alias("two"))
        return found.select("law", "tokens", F.explode(F.array_distinct(F.array("one.t", "two.t"))).alias("t"))

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = (df.select(F.col("law").alias(f"{n}"), F.col("tokens").alias(f"{n}t"), F.col("t").alias(f"{n}u")) for df, n in ((a, "left"), (b, "right")))
        return a.join(b, F.col("leftu") == F.col("rightu")).where(same_law(F.col("leftt"), F.col("rightt"))).select("left", "right")

    return meet(rarest(every[0]), every[1]).unionByName(meet(every[0], rarest(every[1]))).distinct()


def section_hits(wanted: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Rows of wanted(section, ...) with the rows of found(section, ...) that match: equal, child or clause."""
    up = found.withColumn("_up", F.explode(section_ancestors(F.col("section")))).withColumnRenamed("section", "found")
    right = up.select(*[F.col(c).alias(f"_{c}") for c in on], "_up", "found")
    cond = F.col("section") == F.col("_up")
    for c in on:
        cond = cond & (F.col(c) == F.col(f"_{c}"))
    return wanted.join(right, cond).drop("_up", *(f"_{c}" for c in on))


def tag_new_known(rows: DataFrame, recorded: DataFrame) -> DataFrame:
    """rows(law, section, ...) with tag: KNOWN if the law is recorded with the section, else NEW, and
    known_sections, null for a law that isn't recorded and empty for one recorded without sections."""
    known = recorded.groupBy(F.col("law").alias("_law")).agg(F.array_sort(F.collect_set("section")).alias("known_sections"))
    out = rows.join(known, F.col("law") == F.col("_law"), "left").drop("_law")
    hit = F.coalesce(F.array_contains("known_sections", F.col("section")), F.lit(False))
    return out.withColumn("tag", F.when(hit, "KNOWN").otherwise("NEW"))


def inject_anchors(candidates: DataFrame, anchors: DataFrame, corpus: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Candidates with every corpus row that an anchor names, and the anchors that name none."""
    named = corpus.join(anchors.select(*on).distinct(), on, "left_semi")
    added = named.join(candidates.select(*on), on, "left_anti").withColumn("injected", F.lit(True))
    both = candidates.withColumn("injected", F.lit(False)).unionByName(added, allowMissingColumns=True)
    return both, anchors.select(*on).distinct().join(corpus.select(*on), on, "left_anti")


def adjudicate(anchors: DataFrame, emitted: DataFrame, corpus: DataFrame) -> DataFrame:
    """anchors(law, section, indicator) with outcome and failure class, from emitted(law, section,
    indicator) and corpus(law, section)."""
    e = emitted.groupBy(F.col("law").alias("_l"), F.col("section").alias("_s")).agg(F.collect_set("indicator").alias("under"))
    c = corpus.select(F.col("law").alias("_cl"), F.col("section").alias("_cs"), F.lit(True).alias("there")).distinct()
    out = anchors.join(e, (F.col("law") == F.col("_l")) & (F.col("section") == F.col("_s")), "left")
    out = out.join(c, (F.col("law") == F.col("_cl")) & (F.col("section") == F.col("_cs")), "left")
    outcome = (
        F.when(F.col("section").isNull(), "GOLD_REF_UNPARSEABLE")
        .when(F.array_contains("under", F.col("indicator")), "MATCHED")
        .when(F.col("under").isNotNull(), "EMITTED_OTHER_INDICATOR")
        .when(F.col("there"), "IN_CORPUS_NOT_EMITTED")
        .otherwise("NOT_IN_CORPUS")
    )
    out = out.withColumn("outcome", outcome).drop("_l", "_s", "_cl", "_cs", "there", "under")
    kinds = {"GOLD_REF_UNPARSEABLE": "GOLD_ERROR", "EMITTED_OTHER_INDICATOR": "MAPPING", "IN_CORPUS_NOT_EMITTED": "STRUCTURE", "NOT_IN_CORPUS": "ACQUISITION"}
    kind = F.lit(None).cast("string")
    for a, b in kinds.items():
        kind = F.when(F.col("outcome") == a, b).otherwise(kind)
    return out.withColumn("failure", kind)


def stage_recall(trace: DataFrame, by: str, anchor: str, stages: list[str]) -> DataFrame:
    """The share of a group's anchors of which any row survived each stage (boolean columns)."""
    each = trace.groupBy(by, anchor).agg(*(F.bool_or(s).alias(s) for s in stages))
    return each.groupBy(by).agg(F.count("*").alias("anchors"), *(F.round(F.avg(F.col(s).cast("int")), 4).alias(s) for s in stages))


def without_conditional_bans(rows: DataFrame, ban: str, conditional: str) -> DataFrame:
    """Drops rows of indicator `ban` whose (law, section) also stands under `conditional`; null is a value."""
    other = rows.where(F.col("indicator") == conditional).select(F.col("law").alias("_law"), F.col("section").alias("_section")).distinct()
    bans = rows.where(F.col("indicator") == ban).join(other, F.col("law").eqNullSafe(F.col("_law")) & F.col("section").eqNullSafe(F.col("_section")), "left_anti")
    return bans.unionByName(rows.where(~F.col("indicator").eqNullSafe(F.lit(ban))))


def unresolved(seeds: DataFrame, attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Seeds without a successful attempt, with the detail of the last one or 'never attempted'."""
    last = attempts.groupBy(*keys).agg(F.bool_or("ok").alias("_ok"), F.max_by("detail", "at").alias("detail"))
    out = seeds.join(last, keys, "left").where(~F.coalesce("_ok", F.lit(False)))
    return out.withColumn("detail", F.coalesce("detail", F.lit("never attempted"))).drop("_ok")


def audit(rows: DataFrame, official: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, check, verdict) of rows(id, act, article, host, status, years): dead links, hosts that aren't
    official, articles that the act lacks, bills as acts, and missing time frames."""
    hosts = official.select(F.col("domain").alias("_d"))
    away = rows.join(hosts, F.col("host") == F.col("_d"), "left_anti").select("id", F.lit("host").alias("check"), F.lit("WARN").alias("verdict"))
    there = sections.select(F.col("law").alias("_l"), F.col("section").alias("_s"))
    lost = rows.join(there, (F.col("act") == F.col("_l")) & (F.col("article") == F.col("_s")), "left_anti").select("id", F.lit("article").alias("check"), F.lit("ERROR").alias("verdict"))
    dead = rows.where(F.col("status") >= 400).select("id", F.lit("link").alias("check"), F.lit("ERROR").alias("verdict"))
    bills = rows.where(F.lower(F.col("act").cast("string")).rlike("(^|[^a-z])bill([^a-z]|$)")).select("id", F.lit("bill").alias("check"), F.lit("ERROR").alias("verdict"))
    undated = rows.where(~F.coalesce(F.col("years"), F.lit("")).rlike("(19|20)[0-9]{2}")).select("id", F.lit("timeframe").alias("check"), F.lit("WARN").alias("verdict"))
    return away.unionByName(lost).unionByName(dead).unionByName(bills).unionByName(undated)


def proofs(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """findings(id, span_ids) with proof_text, the texts of their spans in the order of the ids, and missing,
    the number of ids without a span."""
    asked = findings.select("id", F.posexplode("span_ids").alias("place", "_span"))
    met = asked.join(spans.select(F.col("span_id").alias("_s"), "text"), F.col("_span") == F.col("_s"), "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("place", "text")))), lambda x: x["text"]), " ")
    return met.groupBy("id").agg(text.alias("proof_text"), F.count_if(F.col("_s").isNull()).alias("missing"))


def token_disagreement(one: DataFrame, two: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """keys with the tokens that either reading of a page has and the other lacks."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0)))
    met = one.withColumnRenamed("text", "_a").join(two.withColumnRenamed("text", "_b"), keys, "left")
    apart = F.array_sort(F.array_union(F.array_except(tokens(F.col("_a")), tokens(F.col("_b"))), F.array_except(tokens(F.col("_b")), tokens(F.col("_a")))))
    return met.select(*keys, apart.alias("apart"))


def structure_accuracy(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected, shared, accuracy): the share of the distinct paths (arrays) of expected(keys, path) that
    found(keys, path) has too."""
    one = expected.where("path is not null").select(*keys, "path", F.lit(True).alias("_e"), F.lit(False).alias("_f"))
    # Null keys equal none.
    two = found.dropna(subset=[*keys, "path"]).select(*keys, "path", F.lit(False).alias("_e"), F.lit(True).alias("_f"))
    # All of a key's paths are in one partition: no join, and no second shuffle.
    each = spread(one.unionByName(two), *keys).groupBy(*keys, "path").agg(F.max("_e").alias("_e"), F.max("_f").alias("_f")).where("_e")
    return each.groupBy(*keys).agg(F.count("*").alias("expected"), F.count_if("_f").alias("shared"), F.round(F.count_if("_f") / F.count("*"), 6).alias("accuracy"))
