"""References in prose: what they are, what they say of their indicator, and which laws they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import collapse, normalize_law_name, split_acts

# The forms of references, in the order in which they are sought, and how each is written.
NUMBER = r"\d+(?:\.\d+){0,2}[A-Z]{0,2}(?:\s*\(\s*\w{1,3}\s*\))*"
REFERENCES = (
    (rf"\b[Ss]eksyen\s+({NUMBER})", "s."),
    (rf"\b[Pp]erkara\s+({NUMBER})", "Art."),
    (rf"\b[Pp]eraturan\s+({NUMBER})", "reg."),
    (rf"(?i)\bArticles?\s+({NUMBER})", "Art."),
    (rf"(?i)\bArt\.?\s*({NUMBER})", "Art."),
    (rf"(?i)\bSections?\s+({NUMBER})", "s."),
    (rf"(?i)\bSec\.?\s*({NUMBER})", "s."),
    (rf"\b[Ss]\.\s*({NUMBER})", "s."),
    (rf"(?i)\bRegulations?\s+({NUMBER})", "reg."),
    (rf"(?i)\bRules?\s+({NUMBER})(?!\s*of)", "r."),
    (rf"(?i)\bClauses?\s+({NUMBER})", "cl."),
    (r"(?i)\bSchedules?\s+(\d+[A-Z]{0,2})", "Sch."),
)
# The words that tell a reference's role, from the weakest role to the strongest, and how far they reach.
ROLES = ("instrument_title", "negative_evidence", "definition", "supporting", "operative")
DEFINITION = r"(?i)\b(defin(?:e[sd]?|ition)|means|refers? to)\b"
SUPPORTING = r"(?i)\b(see also|read with|as defined in|provided for under)\b"
DEPENDENCY = r"(?i)(?:set out in|relevant to .{0,35} under|as mentioned in|defined in)\s*$"
RADIUS, PREFIX = 360, 90
COMMON_TOKENS = ("act", "acts", "the", "of", "and", "a", "an", "bill", "code", "regulations", "amendment", "legislation", "organisation", "organization")
# What the prose near a reference must hold for it to be evidence of an indicator.
NEAR = {
    "transfer": r"transfer|transmit|send",
    "abroad": r"outside|abroad|foreign|cross[- ]border|out of",
    "ban": r"must not|shall not|prohibit|ban",
    "store": r"stor|keep|maintain|records?",
    "country": r"local|within|in malaysia|in singapore|in australia|territor",
    "infrastructure": r"server|data cent|infrastructure|facility",
    "territory": r"local|within|territor",
    "condition": r"unless|\bif\b|consent|adequate|contract|condition|approval|safeguard",
    "retain": r"retain|keep|preserve|maintain",
    "period": r"year|month|day|week|period of|not less than|at least",
    "access": r"access|search|intercept|produce|seiz|investigat",
    "authority": r"government|police|officer|authority|commissioner|prosecutor|minister|organisation|organization|agency|security intelligence|law enforcement",
}
FITS = {"P6-I1": ("transfer", "abroad", "ban"), "P6-I2": ("store", "country"), "P6-I3": ("infrastructure", "territory"), "P6-I4": ("transfer", "abroad", "condition"), "P7-I3": ("retain", "period"), "P7-I5": ("access", "authority")}
REVERSED = ("P7-I1", "P7-I2")


def extract_refs(x: Column) -> Column:
    """The references of a text in their common form, such as 's. 245(2)', each once whatever its case: by the order of
    REFERENCES, then of the text."""
    written = lambda p, prefix: F.transform(F.regexp_extract_all(x, F.lit(p), F.lit(1)), lambda r: F.concat(F.lit(f"{prefix} "), F.regexp_replace(r, r"\s+", "")))
    every = F.flatten(F.array(*(written(p, prefix) for p, prefix in REFERENCES)))
    once = F.aggregate(every, F.array().cast("array<string>"), lambda found, r: F.when(F.exists(found, lambda y: F.lower(y) == F.lower(r)), found).otherwise(F.concat(found, F.array(r))))
    return F.coalesce(once, F.array().cast("array<string>"))


def indicator_fits(indicator: Column, context: Column) -> Column:
    """Whether the prose holds all that the indicator asks for; indicators without a test are content with any."""
    low, out = F.lower(context), F.lit(True)
    for name, needs in FITS.items():
        out = F.when(indicator == name, F.array_position(F.array(*(low.rlike(NEAR[n]) for n in needs)), False) == 0).otherwise(out)
    return out


def anchor_expected(indicator: Column, score: Column) -> Column:
    """Whether a recorded score says that a provision exists: above 0, or for frameworks below 1; a score that can't be
    read says so."""
    value = F.trim(score).try_cast("double")
    return F.when(value.isNull(), True).when(F.coalesce(indicator.isin(*REVERSED), F.lit(False)), value < 1).otherwise(value > 0)


def law_hints(context: Column, acts: Column) -> Column:
    """Of the laws of a cell (normalised names of split_acts()) those that the prose names: most words in common, of
    equals the larger share, then the longer names; where all are amendments, the cell's other laws besides."""
    spoken = F.split(normalize_law_name(context), " ")
    tokens = lambda act: F.array_distinct(F.filter(F.split(act, " "), lambda t: ~t.isin(*COMMON_TOKENS, "") & ~t.rlike("^[0-9]+$")))

    def scored(act: Column) -> Column:
        own = F.size(tokens(act)).cast("double")
        shared = F.size(F.array_intersect(tokens(act), spoken)).cast("double")
        good = (own > 0) & (shared >= F.least(F.lit(2.0), own)) & (shared / own >= 0.5)
        score = F.array(shared, F.round(shared / own, 9), own, F.size(F.split(act, " ")).cast("double"))
        return F.when(good, F.struct(score.alias("score"), act.alias("act")))

    found = F.filter(F.transform(acts, scored), lambda x: x.isNotNull())
    best = F.array_max(F.transform(found, lambda x: x["score"]))
    amends = lambda x: x.rlike(r"\bamend")
    hints = F.transform(F.filter(found, lambda x: x["score"] == best), lambda x: x["act"])
    others = F.filter(acts, lambda a: ~amends(a) & (a != ""))
    with_others = F.concat(hints, F.array_except(others, hints))
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).when(F.forall(hints, amends), with_others).otherwise(hints)


def _places(text: Column) -> Column:
    """array<struct<kind, ref, start, end>> of all references: kind counts REFERENCES."""

    def of(kind: int, pattern: str, prefix: str) -> Column:
        # Where a reference stands is the length of the stretches and references before it.
        whole, number = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, 1))
        gaps = F.split(text, pattern, -1)
        zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), number.alias("number"))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:int,ref:string,start:int,end:int>>").alias("found"))

        def step(s: Column, x: Column) -> Column:
            start = s["at"] + F.length(x["gap"])
            end = start + F.length(x["whole"])
            ref = F.concat(F.lit(f"{prefix} "), F.regexp_replace(x["number"], r"\s+", ""))
            return F.struct(end.alias("at"), F.concat(s["found"], F.array(F.struct(F.lit(kind).alias("kind"), ref.alias("ref"), start.alias("start"), end.alias("end")))).alias("found"))

        # Most texts lack most forms, and are then read once for each and not three times.
        return F.when(text.rlike(pattern), F.aggregate(zipped, none, step, lambda s: s["found"])).otherwise(F.array().cast("array<struct<kind:int,ref:string,start:int,end:int>>"))

    return F.flatten(F.array(*(of(k, p, prefix) for k, (p, prefix) in enumerate(REFERENCES))))


def mentions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ref, role, context, laws) of rows(keys, text, acts, indicator, score): each reference of a row once, in the
    strongest role that any of its places gives it, of equals the first in the order of extract_refs().

    A place is in prose that reaches to the nearest ends of sentences, lines or bullets within RADIUS characters (to
    the text's beginning, where there is none before it), and to the one before where that begins with It or This."""
    each = rows.where("text is not null").select(*keys, "text", "acts", "indicator", "score", F.explode(_places(F.col("text"))).alias("m"))
    text, start, end = F.col("text"), F.col("m.start"), F.col("m.end")
    cut = lambda a, b: F.substring(text, a + 1, F.greatest(b - a, F.lit(0)))
    floor, ceiling = F.greatest(F.lit(0), start - RADIUS), F.least(F.length(text), end + RADIUS)

    def last_end(upto: Column) -> Column:
        """Where the last end of a sentence, line or bullet before a place begins; -1 without one."""
        before = F.regexp_extract(cut(floor, upto), r"(?s)^(.*)(?:\. |\n|• )", 0)
        kept = F.length(F.regexp_extract(cut(floor, upto), r"(?s)^(.*)(?:\. |\n|• )", 1))
        return F.when(before == "", F.lit(-1)).otherwise(floor + kept)

    ahead = r"(?s)^(.*?)(?:\. |\n| •)"
    right = F.when(F.regexp_extract(cut(end, ceiling), ahead, 0) == "", ceiling).otherwise(end + F.length(F.regexp_extract(cut(end, ceiling), ahead, 1)) + 1)
    each = each.withColumn("_left", last_end(start)).withColumn("_right", right)
    near = F.trim(cut(F.col("_left") + 1, F.col("_right")))
    wide = cut(last_end(F.greatest(floor, F.col("_left"))) + 1, F.col("_right"))
    each = each.withColumn("context", collapse(F.when(near.rlike(r"^(?:It|This)\b"), wide).otherwise(near)))
    year = F.regexp_extract("m.ref", r"^reg\. ([0-9]+)$", 1).try_cast("int").between(1900, 2100)
    before = cut(F.greatest(F.lit(0), start - PREFIX), start)
    context, indicator = F.col("context"), F.col("indicator")
    role = (
        F.when(F.coalesce(year, F.lit(False)), 0)
        .when(~anchor_expected(indicator, F.col("score")), 1)
        .when(context.rlike(DEFINITION), 2)
        .when(context.rlike(SUPPORTING) | before.rlike(DEPENDENCY) | ~indicator_fits(indicator, context), 3)
        .otherwise(4)
    )
    acts = F.transform(split_acts(F.coalesce("acts", F.lit(""))), normalize_law_name)
    found = each.select(*keys, "m", F.lower("m.ref").alias("_ref"), role.alias("_role"), "context", law_hints(context, acts).alias("laws"))
    best = Window.partitionBy(*keys, "_ref").orderBy(F.desc("_role"), "m.kind", "m.start")
    found = found.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return found.select(*keys, F.col("m.ref").alias("ref"), F.element_at(F.array(*map(F.lit, ROLES)), F.col("_role") + 1).alias("role"), "context", "laws")
