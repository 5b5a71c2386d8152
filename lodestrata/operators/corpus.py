"""The corpus: scans, status, routing, upserts, graph derivation, generations, expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lodestrata.operators.curation import first_of


def scan(provisions: DataFrame, economy: str, status: str = "in_force") -> DataFrame:
    """The eligible provisions of one economy that are in force."""
    return provisions.where((F.col("economy") == economy) & F.col("evidence_eligible") & (F.col("legal_status") == status))


def whitelist(listed: DataFrame, mined: DataFrame) -> DataFrame:
    """The distinct lower-cased domains of both lists, without www."""
    both = listed.select("domain").unionByName(mined.select("domain"))
    return both.select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("domain")).distinct()


def media_suffix(url: Column, content_type: Column) -> Column:
    low, kind = F.lower(url), F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(F.contains(low, F.lit(".pdf")) | F.contains(kind, F.lit("pdf")), ".pdf").when(F.contains(low, F.lit(".epub")) | F.contains(kind, F.lit("epub")), ".epub").otherwise(".html")


def blocked(status: Column, body: Column) -> Column:
    """Whether a fetch met a block: its status or, of one that went well, a challenge early on or hardly any
    content; no body counts as an empty one."""
    body = F.coalesce(body, F.lit(""))
    challenge = F.lower(F.substring(body, 1, 4000)).rlike("(captcha|are you a robot)") | (F.octet_length(body) < 2000)
    return F.coalesce(status.isin(403, 429, 503) | ((status == 200) & challenge), F.lit(False))


def page_route(chars: Column, quality: Column, text_area: Column, spans: Column, bands: Column, images: Column) -> Column:
    """How a page is read: NATIVE_SIMPLE, NATIVE_COMPLEX, SCANNED, MIXED or REVIEW."""
    return (
        F.when((chars < 25) & images, "SCANNED")
        .when(chars < 25, "REVIEW")
        .when(quality < 0.995, "REVIEW")
        .when(images & (text_area < 0.03), "MIXED")
        .when((spans > 250) | (bands > 8), "NATIVE_COMPLEX")
        .otherwise("NATIVE_SIMPLE")
    )


def words_to_lines(words: DataFrame, keys: list[str], order: str, word: str) -> DataFrame:
    """The words of each line joined in their order; lines keep the place of their first word.

    Where word is an array, a row holds a run of words, of which the first has the place order and each other one the
    place after.  Runs are shuffled whole, and joined with others word by word only where a line has several."""
    many = isinstance(words.schema[word].dataType, ArrayType)
    run = F.col(word) if many else F.array(word)
    # Shuffled as one text, but for runs that it would not tell apart again.
    plain = (F.size(run) > 0) & ~F.exists(run, lambda w: w.isNull() | F.contains(w, F.lit(" ")))
    runs = words.select(*keys, F.col(order).alias("_at"), F.when(plain, F.array_join(run, " ")).alias("_t"), F.when(~plain, run).alias("_w"))
    # Dealt beforehand: lists of runs that are all different would only be sorted and copied before the shuffle.
    out = runs.repartition(*keys).groupBy(*keys).agg(F.min("_at").alias("place"), F.collect_list(F.struct("_at", "_t", "_w")).alias("_p"))
    parts = F.transform("_p", lambda p: F.transform(F.coalesce(p["_w"], F.split(p["_t"], " ")), lambda w, k: F.struct((p["_at"] + k if many else p["_at"]).alias("at"), w.alias("word"))))
    several = F.array_join(F.transform(F.array_sort(F.flatten(parts)), lambda x: x["word"]), " ")
    one = F.col("_p")[0]
    return out.withColumn("line", F.when(F.size("_p") > 1, several).otherwise(F.coalesce(one["_t"], F.array_join(one["_w"], " ")))).drop("_p")


def upsert(current: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both with the latest version of each key; of equal versions the batch's."""
    both = current.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
    return first_of(both, keys, [F.desc(version), F.desc("_new")]).drop("_new")


def derive_graph(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, rel, dst) of units(economy, law, section, unit_id)."""
    instrument = F.concat_ws(":", F.lit("instrument"), "economy", "law")
    section = F.concat_ws(":", F.lit("section"), "economy", "law", "section")
    unit = F.concat(F.lit("provision:"), F.col("unit_id").cast("string"))
    row = units.select(
        F.array(F.struct(instrument.alias("id"), F.lit("Instrument").alias("label")), F.struct(section.alias("id"), F.lit("Section").alias("label")), F.struct(unit.alias("id"), F.lit("Provision").alias("label"))).alias("n"),
        F.array(F.struct(instrument.alias("src"), F.lit("HAS_SECTION").alias("rel"), section.alias("dst")), F.struct(section.alias("src"), F.lit("HAS_PROVISION").alias("rel"), unit.alias("dst"))).alias("e"),
    )
    return row.select(F.explode("n").alias("n")).select("n.*").distinct(), row.select(F.explode("e").alias("e")).select("e.*").distinct()


def guarded_edges(edges: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """edges, all of whose types are allowed; ValueError if one, or a null, isn't."""
    bad = edges.where(~F.coalesce(F.col("rel").isin(*allowed), F.lit(False))).select("rel").limit(1).collect()
    if bad:
        raise ValueError(f"edge type {bad[0][0]} is not allowed")
    return edges


def prune(rows: DataFrame, column: str, current: str) -> DataFrame:
    """The rows of the current generation; null is another one."""
    return rows.where(F.coalesce(F.col(column), F.lit("")) == current)


def pending(rows: DataFrame, built: DataFrame, fingerprint: str) -> DataFrame:
    """What an incremental build must still process: rows whose fingerprint isn't among those built."""
    return rows.join(built.select(F.col(fingerprint).alias("_f")).distinct(), F.col(fingerprint) == F.col("_f"), "left_anti")


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, n): duplicate nodes, edges without an end, edges that repeat."""
    ids = nodes.select(F.col("id").alias("_n")).distinct()
    lost = lambda end: edges.join(ids, F.col(end) == F.col("_n"), "left_anti").agg(F.lit(f"missing {end}").alias("check"), F.count("*").alias("n"))
    twice = nodes.groupBy("id").count().where("count > 1").agg(F.lit("duplicate node").alias("check"), F.count("*").alias("n"))
    again = edges.groupBy("src", "rel", "dst").count().where("count > 1").agg(F.lit("duplicate edge").alias("check"), F.count("*").alias("n"))
    return lost("src").unionByName(lost("dst")).unionByName(twice).unionByName(again)


def unmet(expectations: DataFrame, units: DataFrame) -> DataFrame:
    """Expectations (law, prefix) that no unit (law, section) of the law begins with."""
    hit = (F.col("law") == F.col("_law")) & F.startswith(F.col("_section"), F.col("prefix"))
    return expectations.join(units.select(F.col("law").alias("_law"), F.col("section").alias("_section")), hit, "left_anti")


def newest(versions: DataFrame, key: str, version: str, value: str) -> DataFrame:
    return versions.groupBy(key).agg(F.max_by(value, version).alias(value), F.max(version).alias(version))


def ordered_lookup(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of rows for a list of ids(place, key), in the order asked for; missing ones are dropped."""
    return ids.join(rows, key).orderBy("place")


def wildcard_rules(rows: DataFrame, rules: DataFrame, fields: list[str], order: str) -> DataFrame:
    """rows(id, fields) with the first rule that fits; a blank field of a rule fits anything.

    Each pattern of blanks is an equality join on the other fields; there are at most 2**len(fields)."""
    out = None
    blank = [F.coalesce(F.col(f), F.lit("")) == "" for f in fields]
    for mask in range(1 << len(fields)):
        kept = rules
        for k in range(len(fields)):
            kept = kept.where(blank[k] if mask >> k & 1 else ~blank[k])
        used = [f for k, f in enumerate(fields) if not mask >> k & 1]
        right = kept.select(*(F.col(f).alias(f"_{f}") for f in used), F.col(order).alias("_order"), "action")
        if used:
            on = F.lit(True)
            for f in used:
                on = on & (F.col(f) == F.col(f"_{f}"))
            part = rows.join(right, on)
        else:
            best = right.orderBy("_order").limit(1).collect()
            if not best:
                continue
            part = rows.withColumn("_order", F.lit(best[0]["_order"])).withColumn("action", F.lit(best[0]["action"]))
        part = part.select("id", "_order", "action")
        out = part if out is None else out.unionByName(part)
    first = out.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("_order"))).where("_n = 1")
    return first.select("id", F.col("_order").alias("rule"), "action")
