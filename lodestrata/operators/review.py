"""Review: escalation, recovered anchors, absences, page evidence, build receipts, verdicts, context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import collapse
from lodestrata.operators.curation import first_of
from lodestrata.operators.segmentation import page_windows

#: The confidences below which a decision is looked at again, and that of a recovered anchor.
LOW_POSITIVE, LOW_ANCHOR, RECOVERED = 0.72, 0.80, 0.5
#: Words that can reverse what an indicator means.
CONDITIONAL, JUDICIAL = r" unless | except |subject to|provided that", r"warrant|court order|judicial|without consent"
#: Fixed values of absence rows.
ABSENCE, ABSENCE_CONFIDENCE = "NO_EVIDENCE_FOUND_PENDING_REVIEW", 0.6


def escalation_reasons(applies: Column, confidence: Column, indicator: Column, snippet: Column, context: Column, gold: Column, expected: Column) -> Column:
    """Why a decision needs a second look, in the order of the rules; nulls count as false or empty."""
    yes, gold, expected = (F.coalesce(x, F.lit(False)) for x in (applies, gold, expected))
    low = F.lower(F.coalesce(context, F.lit("")))
    snippet = F.coalesce(snippet, F.lit(""))
    found = (snippet != "") & F.contains(collapse(low), collapse(F.lower(snippet)))
    sure = F.coalesce(confidence, F.lit(0.0))
    rules = (
        (gold & ~yes, "known-anchor-rejected"),
        (~gold & expected & ~yes, "expected-anchor-rejected"),
        (yes & ~found, "snippet-not-source-locatable"),
        (yes & (sure < LOW_POSITIVE), "low-confidence-positive"),
        (yes & gold & (sure < LOW_ANCHOR), "low-confidence-known-anchor"),
        (yes & indicator.isin("6.1", "6.4", "P6-I1", "P6-I4") & F.concat(F.lit(" "), low, F.lit(" ")).rlike(CONDITIONAL), "ban-vs-condition-ambiguity"),
        (yes & indicator.isin("7.5", "P7-I5") & low.rlike(JUDICIAL), "judicial-access-ambiguity"),
    )
    return F.filter(F.array(*(F.when(rule, name) for rule, name in rules)), lambda x: x.isNotNull())


def recover_anchors(decisions: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """decisions(key, applies, confidence, snippet, text) in which known anchors that were rejected apply, with
    their whole text and half a confidence at most; `recovered` marks them."""
    known = anchors.select(F.col(key).alias("_anchor")).distinct()
    met = decisions.join(known, F.col(key) == F.col("_anchor"), "left")
    again = F.col("_anchor").isNotNull() & ~F.coalesce("applies", F.lit(False))
    sure = F.least(F.when(F.coalesce("confidence", F.lit(0.0)) == 0, RECOVERED).otherwise(F.col("confidence")), F.lit(RECOVERED))
    out = met.withColumn("recovered", again).withColumns({"snippet": F.when(F.col("recovered"), F.col("text")).otherwise(F.col("snippet")), "confidence": F.when(F.col("recovered"), sure).otherwise(F.col("confidence")), "applies": F.col("recovered") | F.coalesce("applies", F.lit(False))})
    return out.drop("_anchor")


def absences(indicators: DataFrame, findings: DataFrame, governing: DataFrame) -> DataFrame:
    """A row (economy, indicator, law, snippet, confidence, configured) for each regulatory indicator of
    indicators(economy, indicator, regulatory) without findings(economy, indicator), under the law of
    governing(economy, indicator, law); configured is false where that law is missing, which is an error."""
    wanted = indicators.where("regulatory").select("economy", "indicator").distinct()
    lacking = wanted.join(findings.select("economy", "indicator"), ["economy", "indicator"], "left_anti")
    out = lacking.join(governing.select("economy", "indicator", "law"), ["economy", "indicator"], "left")
    return out.withColumns({"snippet": F.lit(ABSENCE), "confidence": F.lit(ABSENCE_CONFIDENCE), "configured": F.col("law").isNotNull()})


def page_evidence_fault(location: Column, alignment: Column, disagreement: Column) -> Column:
    """Why evidence is rejected: a page without exact alignment, or readings that disagree; else null."""
    paged = F.coalesce(location, F.lit("")).rlike(r"(?i)page\s+\d+")
    return F.when(paged & ~F.coalesce(alignment == "exact", F.lit(False)), "unaligned").when(F.coalesce(disagreement, F.lit(False)), "readings disagree")


def page_metrics(spans: DataFrame, keys: list[str], area: Column) -> DataFrame:
    """(keys, spans, text_area, bands) of spans(keys, x0, y0, x1, y1): their number, the share of the page's
    area that they cover, and how many bands of 40 units they begin in."""
    width, height = (F.greatest(F.col(b) - F.col(a), F.lit(0)) for a, b in (("x0", "x1"), ("y0", "y1")))
    return spans.groupBy(*keys).agg(F.count("*").alias("spans"), (F.sum(width * height) / F.greatest(F.max(area), F.lit(1))).alias("text_area"), F.count_distinct(F.rint(F.col("x0") / 40)).alias("bands"))


def complete_build(builds: DataFrame, done: DataFrame) -> DataFrame:
    """builds(economy, fingerprint, unit_count, generation) with the receipts of done, which replace those of
    the same economy and fingerprint; receipts without units don't count."""
    new = done.where("unit_count > 0")
    return builds.join(new.select("economy", "fingerprint"), ["economy", "fingerprint"], "left_anti").unionByName(new)


def restamp(provisions: DataFrame, builds: DataFrame, generation: str) -> DataFrame:
    """provisions(economy, fingerprint, generation, ...) in which those of a completed build take the new
    generation, if there are as many as its receipt says; an interrupted build is never taken over."""
    have = provisions.groupBy("economy", "fingerprint").agg(F.count("*").alias("_n"))
    whole = have.join(builds.where("unit_count > 0").select("economy", "fingerprint", "unit_count"), ["economy", "fingerprint"]).where("_n = unit_count")
    whole = whole.select(F.col("economy").alias("_e"), F.col("fingerprint").alias("_f"))
    met = provisions.join(whole, (F.col("economy") == F.col("_e")) & (F.col("fingerprint") == F.col("_f")), "left")
    return met.withColumn("generation", F.when(F.col("_e").isNotNull(), generation).otherwise(F.col("generation"))).drop("_e", "_f")


def alignment_targets(context: Column, unit: Column, least: int = 25) -> Column:
    """The (mode, text) to align, from wide to narrow: texts of `least` characters or more, no text twice."""
    norm = lambda x: collapse(F.lower(F.coalesce(x, F.lit(""))))
    wide, narrow = norm(context), norm(unit)
    pair = lambda mode, text: F.struct(F.lit(mode).alias("mode"), text.alias("text"))
    first = F.when(F.length(wide) >= least, pair("canonical-context", context))
    second = F.when((F.length(narrow) >= least) & ((narrow != wide) | (F.length(wide) < least)), pair("semantic-unit", unit))
    return F.filter(F.array(first, second), lambda x: x.isNotNull())


def failure_line(indicator: Column, act: Column, detail: Column, url: Column) -> Column:
    text = lambda x, none="": F.coalesce(x, F.lit(none))
    line = F.concat(F.lit("ACQUISITION_UNRESOLVED "), text(indicator), F.lit(": "), text(act, "unnamed source"), F.lit(" | "), text(detail), F.lit(" | "), text(url))
    return F.regexp_replace(line, r"[ |]+$", "")


def display(x: Column, limit: int) -> Column:
    return F.substring(F.coalesce(x, F.lit("")), 1, limit)


def allowed_properties(props: Column, names: tuple[str, ...], text: str = "text", limit: int = 320) -> Column:
    """The map's entries of these names, the text cut for display."""
    kept = F.map_filter(props, lambda k, _: k.isin(*names))
    return F.transform_values(kept, lambda k, v: F.when(k == text, F.substring(v, 1, limit)).otherwise(v))


def with_verdicts(findings: DataFrame, verdicts: DataFrame, version: str) -> DataFrame:
    """findings(indicator, law, article, tag, ...) with the verdict of verdicts(indicator, law, article, version,
    verdict, fresh), which are used only if all are of the version, all are fresh and every NEW finding has one."""
    keys = ["indicator", "law", "article"]
    lacking = findings.where("tag = 'NEW'").join(verdicts.select(*keys), keys, "left_anti").agg(F.count("*").alias("lacking"))
    usable = verdicts.agg((F.count("*") > 0).alias("some"), F.coalesce(F.bool_and((F.col("version") == version) & F.col("fresh")), F.lit(False)).alias("sound"))
    usable = usable.crossJoin(lacking).select((F.col("some") & F.col("sound") & (F.col("lacking") == 0)).alias("usable"))  # one row each
    own = verdicts.select(*keys, "verdict").dropDuplicates(keys)
    met = findings.join(own, keys, "left").join(F.broadcast(usable))
    return met.withColumn("verdict", F.when(F.col("usable"), F.col("verdict")))


def title_id(url: Column, host: str = r"legislation\.gov\.au") -> Column:
    """The register's identifier in an address, null without one."""
    found = F.regexp_extract(url, rf"{host}/([CF][0-9]{{4}}[A-Z][0-9]{{5}})", 1)
    return F.when(found != "", found)


#: The candidates of an indicator that are screened, and how many at once.
SCREEN_CAP, SCREEN_BATCH = 200, 12


def screened(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """The candidates(indicator, place, ...) that decisions(indicator, batch, index, relevant) keep: place counts from 1,
    those behind SCREEN_CAP are not screened, and an index that a batch doesn't have keeps none.  A candidate that is
    kept twice stays twice."""
    at = F.col("place") - 1
    kept = decisions.where("relevant").select(F.col("indicator").alias("_i"), F.col("batch").alias("_b"), F.col("index").alias("_k"))
    on = (F.col("indicator") == F.col("_i")) & (F.floor(at / SCREEN_BATCH) == F.col("_b")) & (at % SCREEN_BATCH == F.col("_k"))
    return candidates.where(F.col("place").between(1, SCREEN_CAP)).join(kept, on).drop("_i", "_b", "_k")


def consolidated(rows: DataFrame, keys: list[str], run: str, place: str, ranks: dict[str, int], economy: str, then: list[str]) -> DataFrame:
    """Of rows of several runs the first of each key, by run and place, with rank: by the economy's rank (others last),
    then the given columns, then run and place."""
    first = first_of(rows, keys, [F.col(run), F.col(place)])
    rank = F.lit(9)
    for name, n in ranks.items():
        rank = F.when(F.col(economy) == name, n).otherwise(rank)
    return first.withColumn("economy_rank", rank).orderBy("economy_rank", *then, run, place)


def realigned(units: DataFrame, pages: DataFrame, law: str, version: str) -> DataFrame:
    """The units(unit_id, law, volume, text, alignment) of one law that were not aligned exactly and now are, with first,
    last, alignment and version; only these are to be upserted, all others stay untouched."""
    open_ = units.where((F.col("law") == law) & (F.coalesce("alignment", F.lit("")) != "exact"))
    volumes = open_.select("volume").distinct()
    found = page_windows(open_.select("unit_id", "volume", "text"), pages.join(volumes, "volume", "left_semi"))
    found = found.select(F.col("unit_id").alias("_u"), F.col("volume").alias("_v"), "first", "last")
    met = open_.join(found, (F.col("unit_id") == F.col("_u")) & (F.col("volume") == F.col("_v"))).drop("_u", "_v")
    return met.withColumn("alignment", F.lit("exact")).withColumn("version", F.lit(version))
