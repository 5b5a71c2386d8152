"""Column functions over names, citations, markup and lines."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that tell nothing of a law's identity.
LAW_STOP_WORDS = ("act", "acts", "the", "of", "and", "a", "an", "no", "pu")
#: Words of amending instruments, and what numbers an instrument.
AMENDMENT_WORDS = ("amendment", "amending")
NUMBERING = "^(?:[0-9]+|[a-z][0-9]+)$"
ACCENTED, PLAIN = "äçèéêíñóöüáâúîô", "aceeeinoouaauio"


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_law(x: Column) -> Column:
    """Lower case, anything but letters a-z, digits and spaces to a space, spaces collapsed."""
    return collapse(F.regexp_replace(F.lower(x), "[^a-z0-9 ]+", " "))


def normalize_law_name(x: Column) -> Column:
    """A title in lower case, letters a-z and digits only: parentheses that hold an acronym or a register identifier
    go, those of other words stay, & becomes and."""
    alias = r"\(\s*(?:[A-Z][A-Z0-9.&/-]{1,14}|(?i:Act|No\.?)\s*[0-9]+(?i:[A-Z-]*))\s*\)"
    x = F.replace(F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), alias, " ")), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))


def law_tokens(x: Column, stop: tuple[str, ...] = LAW_STOP_WORDS) -> Column:
    """The distinct words of a normalised name without stop words, sorted."""
    words = F.array_distinct(F.split(normalize_law(x), " "))
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, (*stop, "")))))


def family(tokens: Column) -> Column:
    """Tokens without amendment words, numbers and letters with a number."""
    return F.filter(tokens, lambda t: ~t.isin(*AMENDMENT_WORDS) & ~t.rlike(NUMBERING))


def same_law(a: Column, b: Column) -> Column:
    """Whether two token sets name one law: one holds the other, or so do their families of three or more."""
    subset = lambda x, y: (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    full = (F.size(a) > 0) & (F.size(b) > 0)
    kin = (F.size(family(a)) >= 3) & (F.size(family(b)) >= 3) & subset(family(a), family(b))
    return full & (subset(a, b) | kin)


def section_base(x: Column) -> Column:
    """sch1Acl8 for clauses of schedules and sch1A for schedules, else the first number with up to two decimal
    parts and its letters, upper-cased; null for years (whole numbers from 1000) and without a number."""
    schedule = F.regexp_extract(x, r"(?i)\bsch(?:edule)?\.?\s+([0-9]+[A-Z]*)", 1)
    clause = F.regexp_extract(x, r"(?i)\bcl\.?\s+([0-9]+[A-Z]*)", 1)
    number = F.upper(F.regexp_extract(x, r"(?i)([0-9]+(?:\.[0-9]+){0,2}[A-Z]*)", 1))
    plain = F.when((number == "") | number.rlike("^0*[1-9][0-9]{3,}$"), F.lit(None)).otherwise(number)
    return F.when(schedule != "", F.concat(F.lit("sch"), schedule, F.when(clause != "", F.concat(F.lit("cl"), clause)).otherwise(""))).otherwise(plain)


def base_ref(x: Column) -> Column:
    """The reference up to its first bracket, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(x, r"\(.*$", "")))


def section_matches(wanted: Column, found: Column) -> Column:
    """Equal, a child by '.', or any clause of a wanted whole schedule."""
    schedule = wanted.rlike("^sch") & ~F.contains(wanted, F.lit("cl")) & F.startswith(found, F.concat(wanted, F.lit("cl")))
    return (wanted == found) | F.startswith(found, F.concat(wanted, F.lit("."))) | schedule


def section_ancestors(x: Column) -> Column:
    """A section and everything that would match it as a wanted section, for equality joins."""
    parent, upper = F.regexp_extract(x, r"^([0-9]+)\.", 1), F.regexp_extract(x, r"^([0-9]+\.[0-9]+)\.", 1)
    schedule = F.regexp_extract(x, r"^(sch[0-9]+[A-Za-z]*?)cl", 1)
    return F.filter(F.array_distinct(F.array(x, parent, upper, schedule)), lambda y: y.isNotNull() & (y != ""))


def section_key(x: Column) -> Column:
    """Sort key of a section: three numbers and a suffix."""
    part = lambda k: F.coalesce(F.try_element_at(F.split(F.regexp_extract(x, "^([0-9.]+)", 1), r"\."), F.lit(k)).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), F.upper(F.regexp_extract(x, "([A-Za-z]*)$", 1)).alias("suffix"))


def plain_letters(x: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def words(x: Column) -> Column:
    """The runs of letters and digits of a text, lower-cased and without accents."""
    return F.filter(F.split(plain_letters(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def clean_markup(html: Column) -> Column:
    """Tags to spaces, the five common entities resolved, white space collapsed."""
    x = F.regexp_replace(html, r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[\s\x{00A0}\x{2009}\x{202F}]+", " "))


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it, for equality joins with domain lists."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def is_government(host: Column) -> Column:
    return host.rlike(r"(^|\.)gov(\.[a-z]{2})?$") | host.rlike(r"(^|\.)(parliament|legislation)\.")


def furniture_print(line: Column) -> Column:
    """A line's form for spotting repeats: lower case, digits to #, white space collapsed."""
    return collapse(F.regexp_replace(F.lower(line), "[0-9]+", "#"))


def unicode_quality(x: Column) -> Column:
    """The share of characters that are neither replacement nor control characters."""
    n = F.length(x)
    bad = F.regexp_count(x, F.lit(r"[\x{FFFD}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}]"))
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - bad / n)


def balanced(x: Column) -> Column:
    """Whether each bracket of a text is closed by its own kind, in order."""
    pairs = F.create_map(*(F.lit(c) for c in ")(][}{"))
    kept = F.filter(F.split(F.regexp_replace(x, r"[^()\[\]{}]", ""), ""), lambda c: c != "")
    closing = lambda s, c: F.when(F.substring(s, -1, 1) == F.element_at(pairs, c), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise("!")
    return F.aggregate(kept, F.lit(""), lambda s, c: F.when(s == "!", s).when(c.isin(*"([{"), F.concat(s, c)).otherwise(closing(s, c))) == ""


def open_ending(x: Column) -> Column:
    """Why a text can't end there: it introduces a list, ends with and, or, or the word of a reference, or leaves a
    bracket open; else null."""
    end = F.regexp_replace(x, r"\s+$", "")
    end = F.regexp_replace(end, r"[\"'’”)\]}]+$", "")
    words = r"(?i)\b(?:and|or|section|subsection|paragraph|subparagraph|article|regulation|schedule|clause|part)\s*$"
    return F.when(end.rlike("[:—–]$"), "FAIL_OPEN_LIST").when(end.rlike(words), "FAIL_DANGLING_CONNECTOR").when(~balanced(x), "FAIL_UNBALANCED_STRUCTURE")


def _sign(word: Column, known: Column) -> Column:
    """One character for each of the known words, by its place; surrogates are passed over."""
    code = F.array_position(known, word) + 0x4E00
    return F.decode(F.unhex(F.lpad(F.hex(code + F.when(code >= 0xD800, 0x800).otherwise(0)), 8, "0")), "UTF-32")


def list_edits(one: Column, two: Column) -> Column:
    """Levenshtein's distance of two arrays of strings."""
    coded = lambda x, known: F.array_join(F.transform(x, lambda w: _sign(w, known)), "")
    return F.element_at(F.transform(F.array(F.array_distinct(F.concat(one, two))), lambda known: F.levenshtein(coded(one, known), coded(two, known))), 1)


# The tokens of a citation.
CITATION_TOKEN = r"(?i)\b\d+(?:\.\d+)?[A-Z]{0,3}\b|\([a-z0-9ivxlcdm]+\)"


def citation_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(CITATION_TOKEN), F.lit(0))


def citation_accuracy(reading: Column, truth: Column) -> Column:
    """1 less the edits of a reading's list of citation tokens by the truth's tokens, of which one at least counts."""
    return 1 - list_edits(citation_tokens(reading), citation_tokens(truth)) / F.greatest(F.size(citation_tokens(truth)), F.lit(1))


def error_rates(reading: Column, truth: Column) -> dict[str, Column]:
    """Edits of a reading by characters and by words, and the truth's characters and words.

    Texts may be long, so edits are counted in bands of bit vectors."""
    words = F.size(F.filter(F.split(truth, r"\s+"), lambda w: w != ""))
    return {"char_edits": _text_edits(False)(reading, truth), "chars": F.length(truth), "word_edits": _text_edits(True)(reading, truth), "words": words}


WHITE = re.compile(r"\s+", re.ASCII)


def _text_edits(by_words: bool) -> Callable[..., Column]:
    """A function of two texts: their Levenshtein distance by characters or words, null if either is."""
    from lodestrata.functions.edits import edits

    def count(one: pa.Array, two: pa.Array) -> pa.Array:
        cut = (lambda x: [w for w in WHITE.split(x) if w]) if by_words else str
        return pa.array([None if a is None or b is None else edits(cut(a), cut(b)) for a, b in zip(one.to_pylist(), two.to_pylist(), strict=True)], pa.int32())

    return F.arrow_udf(count, "int")


# What a provision does, of which a text has the first that matches, and what makes it speak directly
# to an indicator.
LEGAL_FUNCTIONS = (
    ("framework", r"purpose|object|framework|national cyber security system|govern"),
    ("incident", r"incident|notify|notification|report"),
    ("risk_audit", r"risk assessment|audit|vulnerability|exercise"),
    ("controls", r"code of practice|standard|measure|mechanism|program|plan"),
    ("retention", r"retain|keep|preserve|year|month|day"),
    ("data_access", r"computer(?:i[sz]ed)? data|access to data|produce document|intercept"),
    ("search_seizure", r"search|seiz|enter premises|warrant"),
    ("investigation", r"investigat|authorised officer|authorized officer"),
)
DIRECT = {
    "P7-I1": r"purpose|govern|personal data protection|horizontal",
    "P7-I2": r"cyber security system|cybersecurity framework|risk management|incident",
    "P7-I3": r"at least|not less than|for (?:a period of )?\w+ years?|\d+ years?",
    "P7-I4": r"data protection officer|impact assessment|responsible for compliance",
    "P7-I5": r"without (?:first )?(?:obtaining )?(?:a )?warrant|computer(?:i[sz]ed)? data|intercept",
}


def legal_function(x: Column) -> Column:
    out, low = F.lit("other"), F.lower(x)
    for name, pattern in reversed(LEGAL_FUNCTIONS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def directness(indicator: Column, x: Column) -> Column:
    """1 if the text speaks directly to the indicator, else 0."""
    out, low = F.lit(0), F.lower(x)
    for name, pattern in DIRECT.items():
        out = F.when((indicator == name) & low.rlike(pattern), 1).otherwise(out)
    return out


def parse_date(x: Column) -> Column:
    """'5 Mar 2024' or '2024-03-05'; null for anything else."""
    return F.coalesce(F.try_to_date(x, "d MMM yyyy"), F.try_to_date(x, "yyyy-MM-dd"))


def split_acts(x: Column) -> Column:
    """The acts of a cell that lists several, by semicolons and newlines."""
    return F.filter(F.transform(F.split(x, r"[;\n]+"), lambda a: F.trim(a)), lambda a: a != "")


# The policies' names and the indicators that they stand for.
POLICY_INDICATORS = {
    "ban and local processing requirements": "P6-I1",
    "local storage requirements": "P6-I2",
    "infrastructure requirements": "P6-I3",
    "conditional flow regimes": "P6-I4",
    "not in agreement with binding commitments on data transfer": "P6-I5",
    "lack of comprehensive legal framework for data protection": "P7-I1",
    "lack of dedicated legal framework for cybersecurity": "P7-I2",
    "minimum period of data retention requirements": "P7-I3",
    "data protection impact assessment or data protection officer requirements": "P7-I4",
    "requirements to allow government access to personal data": "P7-I5",
}


def policy_name(x: Column) -> Column:
    """A policy's name in lower case, & as and, without other punctuation."""
    return collapse(F.regexp_replace(F.replace(F.lower(x), F.lit("&"), F.lit("and")), "[^a-z0-9 ]+", " "))


def indicator_code(x: Column, pillar: Column | None = None) -> Column:
    """'6.4' or 'Indicator 6.4' as P6-I4, or a policy by its name; else the pillar alone as P6-I?, if it is one of the
    twelve; else null."""
    one, two = (F.nullif(F.regexp_extract(x, r"\b([0-9]{1,2})\.([0-9]{1,2})\b", k), F.lit("")).cast("int") for k in (1, 2))
    code = F.when(one.between(1, 12), F.concat(F.lit("P"), one.cast("string"), F.lit("-I"), two.cast("string")))
    name = F.element_at(F.create_map(*(F.lit(v) for pair in POLICY_INDICATORS.items() for v in pair)), policy_name(x))
    whole = F.floor(pillar.try_cast("double")).cast("int") if pillar is not None else F.lit(None).cast("int")
    return F.coalesce(code, name, F.when(whole.between(1, 12), F.concat(F.lit("P"), whole.cast("string"), F.lit("-I?"))))


def expects_anchor(score: Column, restrictive_when_high: Column) -> Column:
    """Whether a recorded score says that a provision exists: above 0, or below 1 for inverted indicators;
    a score that can't be read says so too."""
    n = score.try_cast("double")
    return F.when(n.isNull(), True).when(restrictive_when_high, n > 0).otherwise(n < 1)


def expand_citations(x: Column) -> Column:
    """'Sections 4, 5A and 7(1)' as s4, s5A, s7(1), each once."""
    found = F.regexp_extract_all(F.regexp_extract(x, r"(?i)(?:sections?|ss?\.?)\s+(.*)$", 1), F.lit(r"([0-9]+[A-Za-z]{0,2}(?:\([0-9A-Za-z]+\))*)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda r: F.concat(F.lit("s"), r)))


def strip_markdown(x: Column) -> Column:
    """Links to their text, emphasis and code marks away."""
    return collapse(F.regexp_replace(F.regexp_replace(x, r"\[([^\]]*)\]\([^)]*\)", "$1"), r"[*_`]+", ""))


def markdown_urls(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(r"(https?://[^\s)|>\]]+)"), F.lit(1)))


def citation_tier(x: Column) -> Column:
    """Citations of a part of a section carry the higher risk of being invented."""
    return F.when(F.contains(x, F.lit("(")), "[verify-pinpoint]").otherwise("[verify]")


def usable_unit(x: Column, least: int = 30, most: int = 20_000) -> Column:
    """The text of a unit, cut at `most` characters; null below `least`."""
    return F.when(F.length(F.trim(x)) >= least, F.substring(x, 1, most))


def needs_review(confidence: Column, warned: Column, escalated: Column, tag: Column) -> Column:
    return (F.coalesce(confidence, F.lit(0.0)) < 0.8) | F.coalesce(warned, F.lit(False)) | F.coalesce(escalated, F.lit(False)) | F.coalesce(tag == "NEW", F.lit(False))
