"""Deterministic gate predicates; each is a column with PASS, WARN or FAIL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import collapse, parse_date


def g1_contained(snippet: Column, source: Column) -> Column:
    low = lambda x: collapse(F.lower(x))
    return F.when((F.trim(snippet) != "") & F.contains(low(source), low(snippet)), "PASS").otherwise("FAIL")


def g2_location(location: Column, base: Column) -> Column:
    """A location that begins with an anchor must hold the section's base; page and volume references are
    accepted; anything else warns.  A section without a base fails an anchor."""
    place, base = F.lower(F.coalesce(location, F.lit(""))), F.lower(F.coalesce(base, F.lit("")))
    held = (base != "") & F.contains(place, base)
    return F.when(place.rlike("^#(pr|sc)"), F.when(held, "PASS").otherwise("FAIL")).when(place.rlike("page|vol"), "PASS").otherwise("WARN")


def g3_authority(matched: Column) -> Column:
    return F.when(F.coalesce(matched, F.lit(False)), "PASS").otherwise("FAIL")


def g4_currentness(status: Column, date: Column) -> Column:
    return F.when(status.isNull() | (status == "unknown"), "WARN").when(status != "in_force", "FAIL").when(parse_date(date).isNull(), "WARN").otherwise("PASS")


#: Words of exception.
EXCEPTIONS = r"(?i)\bunless\b|\bexcept\b|subject to|provided that|notwithstanding"


def g5_exceptions(indicator: Column, snippet: Column, text: Column, words: str = EXCEPTIONS) -> Column:
    """Words of exception in the text but not in the snippet."""
    hidden = text.rlike(words) & ~snippet.rlike(words)
    return F.when(hidden & (indicator == "P6-I1"), "FAIL").when(hidden, "WARN").otherwise("PASS")


#: Claims of a rationale, what supports them, and how much of a text is read for it.
CLAIMS = r"prohibit|require|mandate|must|ban"
SUPPORT = r"\bmust\b|\bshall\b|is required|are required|\bmay not\b"
SUPPORT_REACH = 1500


def g6_modality(rationale: Column, snippet: Column, text: Column) -> Column:
    """A rationale that claims a duty or a ban needs words of one in the snippet or the text's beginning."""
    blob = F.lower(F.concat_ws(" ", snippet, F.substring(text, 1, SUPPORT_REACH)))
    claims = F.lower(F.coalesce(rationale, F.lit(""))).rlike(CLAIMS)
    return F.when(claims & ~blob.rlike(SUPPORT), "WARN").otherwise("PASS")


#: The lexical tests of what an indicator asks of a provision, and how much of a text they read.
FIT_REACH = 2000
FIT = {
    "abroad": r"outside|abroad|cross[- ]border|foreign|another country|other countr|place outside|out of",
    "transfer": r"transfer|transmit|send|disclos\w+ to .{0,40}(outside|abroad|foreign)",
    "retain": r"retain|keep|preserve|maintain|stor\w+|\bhold\b",
    "duration": r"(year|month|day|week)s?",
    "records": r"record|data|document|book|information|register",
    "infrastructure": r"server|data cent(?:re|er)|comput(?:er|ing) (?:system|facility)|infrastructure|facility",
    "domestic": r"\b(?:local|domestic(?:ally)?)\b|\b(?:located|established|maintained|hosted)\b.{0,35}\b(?:in|within)\b(?!\s+(?:another|other|foreign))|\b(?:server|data cent(?:re|er)|facility|infrastructure)\b.{0,35}\b(?:in|within)\b(?!\s+(?:another|other|foreign))",
    "kept_out": r"(?s)\b(?:must not|shall not|may not|prohibit(?:s|ed)?)\b.{0,120}\b(?:hold|take|store|process|handle)\b.{0,80}\boutside\b.{0,40}\b(?:australia|malaysia|singapore|the country|the jurisdiction)\b",
    "ban": r"\b(?:must not|shall not|may not|is prohibited|are prohibited|prohibit(?:s|ed)?)\b",
    "condition": r"\b(?:if|unless|only if|consent|adequacy|adequate|approval|condition|safeguard|contract|except|subject to|in accordance with|prescribed|standard of protection)\b",
    "service_condition": r"\b(?:condition|precondition)\b",
    "duty": r"\b(?:must|shall|required to|not less than|at least|minimum(?: period)? of)\b",
    "ceiling": r"\b(?:need only|may (?:retain|keep)|up to|not more than|no longer than|maximum(?: period)? of)\b",
    "licence": r"licen[cs]e|permit",
    "data": r"record|data",
    "judicial": r"court order|order of (?:a|the) court|judge|magistrate|judicial|(?:warrant.{0,100}(?:issued|granted|authori[sz]ed) by .{0,30}(?:court|judge|magistrate))",
    "without_judicial": r"\b(?:without|no need for|does not require|not required to obtain)\b.{0,35}\b(?:warrant|court order|judicial authori[sz]ation)\b|\bwarrantless\b",
    "government": r"\b(?:police|law[- ]enforcement|security agency|intelligence agency|authori[sz]ed officer|commissioner|director[- ]general|attorney[- ]general|minister|inspector|magistrate|prosecutor|government|public authority|agency)\b",
    "access": r"\b(?:access|intercept\w*|search|seiz\w*|obtain|inspect|copy|produce|give|provide|disclos\w*|warrant|enter)\b",
    "object": r"\b(?:personal data|data|information|document|record|communication\w*|computer|device|account|book)\b",
}


def g7_fit(indicator: Column, snippet: Column, text: Column, law: Column) -> Column:
    """Whether a provision says what its indicator asks for.  Bills always fail; then, for each indicator, the
    first rule that applies decides, and what no rule stops passes."""
    snippet = F.lower(F.coalesce(snippet, F.lit("")))
    blob = F.concat_ws(" ", snippet, F.lower(F.substring(F.coalesce(text, F.lit("")), 1, FIT_REACH)))
    has = {name: blob.rlike(pattern) for name, pattern in FIT.items()}
    stays = (has["retain"] & has["records"] & has["domestic"] & has["duty"]) | (has["records"] & has["kept_out"])
    hosted = has["infrastructure"] & has["domestic"] & (has["duty"] | has["service_condition"])
    powers = has["government"] & has["access"] & has["object"]
    permit_only = snippet.rlike(FIT["licence"]) & ~snippet.rlike(FIT["data"])
    rules = (
        (("P6-I1", "P6-I4"), ~(has["abroad"] & has["transfer"]), "FAIL"),
        (("P6-I1",), ~has["ban"], "FAIL"),
        (("P6-I2",), ~stays, "FAIL"),
        (("P6-I3",), ~hosted, "FAIL"),
        (("P6-I4",), ~has["condition"], "FAIL"),
        (("P7-I3",), ~(has["retain"] & has["records"] & has["duty"]) | permit_only | has["ceiling"], "FAIL"),
        (("P7-I3",), ~has["duration"], "WARN"),
        (("P7-I5",), ~powers, "FAIL"),
        (("P7-I5",), has["judicial"] & ~has["without_judicial"], "WARN"),
    )
    draft = F.array_contains(F.split(F.regexp_replace(F.lower(F.coalesce(law, F.lit(""))), "[^a-z ]", " "), " +"), "bill")
    out = F.when(draft, "FAIL")
    for indicators, stopped, verdict in rules:
        out = out.when(indicator.isin(*indicators) & stopped, verdict)
    return out.otherwise("PASS")


#: A reference to a section, with the other act that it may name, and how much of a text is read.
CROSS_REFERENCE = r"(?i)section\s+(\d{1,3}[A-Z]{0,2})(?:\s+of\s+(?:the\s+)?([A-Z][\w() ]{4,60}?(?:Act|Code|Regulations)[\w ]{0,12}))?"
REFERENCE_REACH = 3000


def g8_lost(text: Column, sections: Column) -> Column:
    """The sections of the same act that the text's beginning refers to and `sections` (bases, upper-cased)
    lacks, each once and sorted; none if no section is known."""
    near = F.substring(F.coalesce(text, F.lit("")), 1, REFERENCE_REACH)
    base, act = (F.regexp_extract_all(near, F.lit(CROSS_REFERENCE), F.lit(k)) for k in (1, 2))
    met = F.arrays_zip(base.alias("base"), act.alias("act"))
    # "of this Act" names no other one.
    same = F.filter(met, lambda x: (x["act"] == "") | F.lower(F.trim(x["act"])).rlike("^(this |that |the said)"))
    known = F.coalesce(sections, F.array().cast("array<string>"))
    lost = F.array_except(F.transform(same, lambda x: F.upper(x["base"])), known)
    return F.when(F.size(known) == 0, F.array().cast("array<string>")).otherwise(F.array_sort(lost))


def g8_dangling(text: Column, sections: Column) -> Column:
    return F.when(F.size(g8_lost(text, sections)) > 0, "WARN").otherwise("PASS")


def overall(*gates: Column) -> Column:
    return F.when(F.exists(F.array(*gates), lambda g: g == "FAIL"), "FAIL").when(F.exists(F.array(*gates), lambda g: g == "WARN"), "WARN").otherwise("PASS")


# Source types that give no evidence and why, those that may, and what names betray.
INELIGIBLE_TYPES = {
    "bill": "BILL_OR_DRAFT",
    "draft": "BILL_OR_DRAFT",
    "consultation": "CONSULTATION",
    "international_agreement": "INTERNATIONAL_AGREEMENT",
    "commentary": "SECONDARY_COMMENTARY",
    "company_policy": "COMPANY_POLICY",
}
ELIGIBLE_TYPES = ("act", "statute", "regulation", "official_code", "official_instrument", "treaty")
INELIGIBLE_NAMES = (
    ("BILL_OR_DRAFT", r"(?i)\b(bill|draft|exposure draft)\b"),
    ("CONSULTATION", r"(?i)\bconsultation|discussion paper\b"),
    ("INTERNATIONAL_AGREEMENT", r"(?i)\b(agreement|treaty|rcep)\b"),
    ("SECONDARY_COMMENTARY", r"(?i)\b(commentary|client alert|legal update|blog)\b"),
    ("COMPANY_POLICY", r"(?i)\b(company|corporate) policy\b"),
)


def eligibility(name: Column, source_type: Column, status: Column) -> Column:
    """Why an instrument gives no evidence, or null: its type, what its name betrays (a declared treaty may be named as
    one), a status other than in force (null: unknown), or a type that isn't on the list."""
    kind, name = F.lower(F.trim(source_type)), F.coalesce(name, F.lit(""))
    status = F.coalesce(status, F.lit("unknown"))
    out = F.when(~F.coalesce(kind.isin(*ELIGIBLE_TYPES), F.lit(False)), "UNSUPPORTED_SOURCE_TYPE")
    out = F.when(status != "in_force", F.concat(F.lit("STATUS_"), F.upper(status))).otherwise(out)
    for reason, pattern in reversed(INELIGIBLE_NAMES):
        told = name.rlike(pattern)
        if reason == "INTERNATIONAL_AGREEMENT":
            told = told & ~F.coalesce(kind == "treaty", F.lit(False))
        out = F.when(told, reason).otherwise(out)
    for denied, reason in INELIGIBLE_TYPES.items():
        out = F.when(kind == denied, reason).otherwise(out)
    return out


#: A page that a draft marks, and how many and what share of the pages must be.
DRAFT_PAGE, DRAFT_PAGES, DRAFT_SHARE = r"(?im)^\s*(?:exposure\s+)?draft\s*$", 2, 0.10


def content_eligibility(pages: DataFrame, keys: list[str], documents: DataFrame) -> DataFrame:
    """documents(keys) with draft_pages, pages and reason: EMPTY_DOCUMENT without pages(keys, text),
    BILL_OR_DRAFT_CONTENT if enough of them hold a line that is only the mark of a draft, else null."""
    marked = F.count_if(F.coalesce(F.col("text").rlike(DRAFT_PAGE), F.lit(False)))
    each = pages.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(marked.alias("draft_pages"), F.count("*").alias("pages"))
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    out = documents.select(*keys).distinct().join(each, on, "left").drop(*(f"_{k}" for k in keys))
    draft = (F.col("draft_pages") >= DRAFT_PAGES) & (F.col("draft_pages") / F.col("pages") >= DRAFT_SHARE)
    reason = F.when(F.col("pages").isNull(), "EMPTY_DOCUMENT").when(draft, "BILL_OR_DRAFT_CONTENT")
    return out.withColumn("reason", reason).fillna(0, ["draft_pages", "pages"])


# What tells a status, of which the first decides, and what contradicts one in force.
STATUS_MARKERS = (
    ("repealed", r"\brepealed|ceased to be in force\b", "official fact contains repeal marker"),
    ("superseded", r"\bsuperseded|replaced by\b", "official fact contains supersession marker"),
    ("not_yet_effective", r"\bnot yet (in force|commenced)|commences on\b", "official fact contains future-commencement marker"),
    ("draft", r"\b(bill|draft)\b", "official fact identifies a bill/draft"),
)
IN_FORCE = r"\b(current|latest|in force|compilation)\b"
CONTRADICTS = r"\brepealed|superseded|ceased to be in force\b"


def resolve_status(fact: Column, current_as_at: Column, explicit: Column) -> dict[str, Column]:
    """status, rule and conflict of an official fact: an explicit status wins, then the markers in their order, then an
    assertion of currency that bears a date; one in force conflicts with words of repeal."""
    low = F.lower(F.coalesce(fact, F.lit("")))
    dated = F.coalesce(current_as_at != "", F.lit(False))
    current = dated & low.rlike(IN_FORCE)
    status = F.when(current, "in_force").otherwise("unknown")
    rule = F.when(current, "official current/latest compilation assertion plus date").otherwise("no sufficient official legal-status assertion")
    for name, pattern, why in reversed(STATUS_MARKERS):
        status, rule = F.when(low.rlike(pattern), name).otherwise(status), F.when(low.rlike(pattern), why).otherwise(rule)
    told = F.coalesce(explicit != "", F.lit(False))
    status, rule = F.when(told, explicit).otherwise(status), F.when(told, "official structured status field").otherwise(rule)
    return {"status": status, "rule": rule, "conflict": (status == "in_force") & low.rlike(CONTRADICTS)}


def status_allows_final(status: Column, conflict: Column, url: Column, fact: Column) -> Column:
    """In force, without conflict, from a fact with an address."""
    filled = lambda x: F.coalesce(x != "", F.lit(False))
    return F.coalesce((status == "in_force") & ~conflict, F.lit(False)) & filled(url) & filled(fact)


def structure_too_thin(units: Column, pages: Column) -> Column:
    """Whether a document has fewer units than a fifth of its pages, or than three; null counts as none."""
    count = lambda x: F.coalesce(x, F.lit(0))
    return count(units) < F.greatest(F.lit(3), F.floor(count(pages) / 5))
