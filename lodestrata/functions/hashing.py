"""Keys and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; null counts as empty."""
    return F.sha2(F.concat_ws(UNIT, *map(_text, parts)), 256)


def normal_key(*parts: Column) -> Column:
    """SHA-256 of lower-cased parts with single spaces, joined by bars."""
    return F.sha2(F.concat_ws("|", *(F.trim(F.regexp_replace(F.lower(_text(x)), r"\s+", " ")) for x in parts)), 256)


def content_hash(x: Column) -> Column:
    return F.sha2(_text(x), 256)


def cache_key(item: Column, text: Column) -> Column:
    """An item's id and the first 16 hex digits of its text's hash."""
    return F.concat_ws(":", item.cast("string"), F.substring(content_hash(text), 1, 16))


def processing_fingerprint(content: Column, version: str, profile: str, grammars: list[str], config: str = "") -> Column:
    """What a build depends on: the content's hash, version, profile, sorted grammars and configuration."""
    return key(content_hash(content), F.lit(version), F.lit(profile), F.lit(",".join(sorted(grammars))), F.lit(config))


def subject_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of a JSON object with its keys in order and nulls kept."""
    row = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)
