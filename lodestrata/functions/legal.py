"""Column functions over statutes: headings, citations, parts of rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.text import law_tokens

# The section grammars.  Group 1 is a section's number, group 2 its heading.
SECTION_GRAMMARS: dict[str, tuple[str, ...]] = {
    "statute": (
        r"(?i)^\s{0,6}Section\s+(\d{1,3}[A-Z]{0,2})\.?\s+(.{0,120})",
        r"^\s{0,6}(\d{1,3}(?:\.\d{1,2}){1,2}[A-Z]{0,2})\s+(\S.{0,110})",
        r"(?i)^\s{0,6}(\d{1,3}[A-Z]{0,2})\.\s+(.{0,120})",
        r"(?i)^\s{0,6}(\d{1,3}[A-Z]{0,2})\s{2,}(\S.{0,110})",
    ),
    "treaty": (r"(?i)^\s{0,6}Article\s+(\d{1,3}[A-Z]?(?:\.\d{1,2}[A-Z]?){0,2}(?:-[A-Z])?)\s*(?:[:.\-–—]\s*)?(.*?)\s*$",),
    "malay": (r"(?i)^\s{0,6}Seksyen\s+(\d{1,3}[A-Z]{0,2})\.?\s+(\S.{0,110})", r"(?i)^\s{0,6}Perkara\s+(\d{1,3}[A-Z]{0,2})\.?\s+(\S.{0,110})"),
}
CITATION_TEMPLATES = {"statute": "s. ", "treaty": "Art. ", "malay": "s. "}
ENACTING = r"(?i)^\s*An Act to\b"
SUBSECTION = r"\((\d{1,2})\)\s"
CROSS_REFERENCE = r"(?i)\b(?:Section|Article|Regulation|Clause)\s+\d"


def plausible_heading(heading: Column, act_tokens: Column) -> Column:
    """Whether what follows a section's number can be its heading: it doesn't go on in lower case, names no other
    section, and isn't the act's own title of three tokens or more (act_tokens: law_tokens() of it), but for one."""
    text = F.trim(heading)
    title = (F.size(act_tokens) >= 3) & (F.size(F.array_except(act_tokens, law_tokens(F.substring(text, 1, 80)))) <= 1)
    return (text == "") | ~(text.rlike("^[a-z]") | text.rlike(CROSS_REFERENCE) | title)


def section_order(number: Column) -> Column:
    """The key by which sections are ordered: body numbers, then their decimals and letters; annexes such as 4B.7
    lie behind the decimals of their number; what has neither form comes first."""
    x = F.upper(number)
    annex = F.regexp_extract(x, r"^(\d+)([A-Z]+)\.(\d+)([A-Z]*)$", 2)
    part = lambda pattern, k: F.nullif(F.regexp_extract(x, pattern, k), F.lit("")).cast("int")
    letters = F.aggregate(F.filter(F.split(annex, ""), lambda c: c != ""), F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64)
    of_annex, plain = r"^(\d+)([A-Z]+)\.(\d+)([A-Z]*)$", r"^(\d+)(?:\.(\d+))?(?:\.(\d+))?([A-Z]*)$"
    key = lambda a, b, c, d: F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    body = F.when(x.rlike(plain), key(part(plain, 1), *(F.coalesce(part(plain, k), F.lit(-1)) for k in (2, 3)), F.regexp_extract(x, plain, 4)))
    return F.when(annex != "", key(part(of_annex, 1), letters + 1000, part(of_annex, 3), F.regexp_extract(x, of_annex, 4))).otherwise(F.coalesce(body, key(F.lit(0), F.lit(-1), F.lit(-1), F.lit(""))))


# What opens the parts of a rule.
COMPONENTS = {
    "exception": r"(?i)\b(?:except|unless|does not apply|despite)\b",
    "condition": r"(?i)\b(?:if|where|provided that|subject to)\b",
    "definition": r"(?i)\b(?:means|includes|in this (?:Act|section))\b",
    "note": r"(?i)\bNote\s*\d*\s*[:—-]",
    "cross_reference": r"(?i)\b(?:section|subsection|paragraph|Schedule)\s+\d",
}


def rule_components(text: Column) -> Column:
    """array<struct<role, start, end, text>>: the principal rule, which is all of the text, then for each role the
    stretches from what opens it to the end of the sentence (its full stop) or of the text."""
    size = F.length(text)
    span = lambda role, start, end: F.struct(F.lit(role).alias("role"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.substring(text, start + 1, end - start).alias("text"))
    parts = [F.array(span("principal_rule", F.lit(0), size))]
    stop = lambda at: F.coalesce(F.nullif(F.call_function("locate", F.lit("."), text, (at + 1).cast("int")), F.lit(0)), size)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def opening(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["gap"])
        new = F.struct((at + F.length(x["word"])).alias("at"), F.concat(s["starts"], F.array(at)).alias("starts"))
        return F.when(x["word"].isNull(), s).otherwise(new)

    def stretches(role: str, pattern: str) -> Column:
        # Where an opening stands is the length of the stretches and openings before it; behind the last is one more.
        def told(opened: Column) -> Column:
            zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), opened.alias("word"))
            return F.transform(F.aggregate(zipped, none, opening, lambda s: s["starts"]), lambda at: span(role, at, stop(at)))

        # Openings are bound by a lambda, so what is between them is sought only where there are any, and they once.
        return F.flatten(F.transform(F.filter(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda x: F.size(x) > 0), told))

    parts += [stretches(role, pattern) for role, pattern in COMPONENTS.items()]
    return F.when(text.isNotNull(), F.concat(*parts))


# The kinds of a citation's parts, in the order in which the first decides.
PATH_KINDS = (
    ("regulation", r"(?i)\b(?:reg(?:ulation)?\.?\s*)(\d+(?:\.\d+)?[A-Z]{0,3})"),
    ("article", r"(?i)\b(?:art(?:icle)?\.?\s*)(\d+(?:\.\d+)?[A-Z]{0,3})"),
    ("clause", r"(?i)\b(?:cl(?:ause)?\.?\s*)(\d+(?:\.\d+)?[A-Z]{0,3})"),
    ("section", r"(?i)\b(?:s(?:ection)?\.?\s*)?(\d+(?:\.\d+)?[A-Z]{0,3})"),
)
SCHEDULE = r"(?i)\b(?:Sch(?:edule)?\.?\s*)([A-Z0-9]+)"
ITEM = r"(?i)\(([0-9]+|[a-z]{1,3}|[ivxlcdm]+)\)"


def citation_path(x: Column) -> Column:
    """The hierarchy of a citation, outermost first: its schedule; its regulation, article, clause or section, with
    the bracketed items behind it; or, where neither is found, its Part, Division and Chapter."""
    empty = F.array().cast("array<string>")
    schedule = F.regexp_extract(x, SCHEDULE, 1)
    body = F.lit(None).cast("array<string>")
    for kind, pattern in reversed(PATH_KINDS):
        value = F.regexp_extract(x, pattern, 1)
        rest = F.regexp_extract(x, rf"(?is){pattern.removeprefix('(?i)')}(.*)$", 2)
        items = F.transform(F.regexp_extract_all(rest, F.lit(ITEM), F.lit(1)), lambda i: F.concat(F.lit("item ("), i, F.lit(")")))
        found = value != ""
        if kind == "section":
            found = found & ~((schedule != "") & (value == schedule))
        body = F.when(found, F.concat(F.array(F.concat(F.lit(f"{kind} "), value)), items)).otherwise(body)
    above = [F.concat(F.lit(f"{h} "), F.nullif(F.regexp_extract(x, rf"(?i)\b{h}\s+([A-Z0-9]+)", 1), F.lit(""))) for h in ("Part", "Division", "Chapter")]
    headings = F.filter(F.array(*above), lambda h: h.isNotNull())
    path = F.concat(F.when(schedule != "", F.array(F.concat(F.lit("Schedule "), schedule))).otherwise(empty), F.coalesce(body, empty))
    return F.when(F.size(path) > 0, path).otherwise(headings)
