"""Scalar functions of the engine as Column builders: everything stays in the JVM."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RECENCY_WEIGHT, PATTERN_WEIGHT, QUALITY_WEIGHT = 0.15, 0.10, 0.05
RECENCY_DAYS = 90
# Patterns that count half when the query does not name them.
HIGH_VALUE_PATTERNS = ("repository", "service", "factory", "middleware", "strategy", "observer")
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def estimate_tokens(text: Column) -> Column:
    """A token for every four bytes begun, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.octet_length(text) / 4)).cast("long")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def chunk_id(path: Column, kind: Column, start: Column, end: Column) -> Column:
    return content_hash(F.concat_ws(":", path, kind, start.cast("string"), end.cast("string")))


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_DNS) -> Column:
    """UUID version 5 from SHA-1 over namespace and name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12)
    )


def point_id(chunk: Column) -> Column:
    """The id itself if it is a UUID, else its version-5 UUID."""
    return F.when(F.lower(chunk).rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lower(chunk)).otherwise(uuid5(chunk))


def lossy_text(raw: Column) -> Column:
    return F.make_valid_utf8(raw.cast("string"))


def truthy(value: Column, default: bool = False) -> Column:
    """A flag that may be spelled true, 1 or yes."""
    return F.when(value.isNull(), F.lit(default)).otherwise(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes"))


def recency_score(stamp: Column, now: Column) -> Column:
    """Decay over whole elapsed days of an RFC 3339 stamp; anything else scores 0."""
    moment = F.when(stamp.rlike(RFC3339), F.try_to_timestamp(stamp))
    days = ((F.unix_seconds(now) - F.unix_seconds(moment)) / 86400).cast("long")
    return F.when(moment.isNull(), 0.0).when(days <= 0, 1.0).when(days >= RECENCY_DAYS, 0.0).otherwise(F.exp(-days / (RECENCY_DAYS / 3.0)))


def pattern_score(patterns: Column, query: Column) -> Column:
    named = F.exists(patterns, lambda p: F.contains(F.lower(query), p))
    valued = F.arrays_overlap(patterns, F.array(*map(F.lit, HIGH_VALUE_PATTERNS)))
    return F.when(F.coalesce(F.size(patterns), F.lit(0)) <= 0, 0.0).when(named, 1.0).when(valued, 0.5).otherwise(0.2)


def quality_score(dead: Column, documented: Column, public: Column, cyclomatic: Column, tested: Column) -> Column:
    """Bonuses and penalties of a chunk's flags, within -1 and 1."""
    points = (
        F.when(truthy(dead), -0.5).otherwise(0.0)
        + F.when(truthy(documented), 0.2).otherwise(0.0)
        + F.when(truthy(public, True), 0.1).otherwise(0.0)
        + F.when(F.coalesce(cyclomatic, F.lit(0)) > 20, -0.2).otherwise(0.0)
        + F.when(truthy(tested), 0.3).otherwise(0.0)
    )
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), points))


def squash_lexical(raw: Column) -> Column:
    return F.when(raw <= 0, 0.0).otherwise(0.75 * raw / (raw + 3.0))


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def score_ranked(path: Column, name: Column, parent: Column, code: Column, kind: Column | None, terms: Sequence[str]) -> Column:
    """Term score of a chunk; with kind, functions and methods gain a little."""
    empty = F.lit("")
    path, name, parent = (F.lower(F.coalesce(c, empty)) for c in (path, name, parent))
    text = F.concat_ws(" ", path, name, parent, F.lower(F.coalesce(code, empty)))
    score = F.lit(1.0)
    for term in map(str.lower, terms):
        score = score + F.when(name == term, 4.0).when(parent == term, 2.5).when(F.contains(path, F.lit(term)), 1.5).otherwise(0.0)
        score = score + F.least(F.lit(8), occurrences(text, term)) * 0.25
    return score if kind is None else score + F.when(kind.isin("function", "method"), 0.6).otherwise(0.0)


def score_fraction(name: Column, code: Column, terms: Sequence[str]) -> Column:
    """Share of the terms that occur, plus 1 if one is the name; null if none occurs."""
    text = F.lower(F.concat_ws(" ", name, code))
    matched = sum((F.when(F.contains(text, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    named = F.lower(F.coalesce(name, F.lit(""))).isin(*terms) if terms else F.lit(False)
    return F.when(matched > 0, matched / float(max(1, len(terms))) + F.when(named, 1.0).otherwise(0.0))


def citation(path: Column, start: Column, end: Column, name: Column, parent: Column) -> Column:
    """path:a-b (parent.name); missing lines are a question mark."""
    line = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    label = F.concat_ws(".", F.nullif(parent, F.lit("")), F.nullif(name, F.lit("")))
    return F.concat(path, F.lit(":"), line(start), F.lit("-"), line(end), F.when(label != "", F.concat(F.lit(" ("), label, F.lit(")"))).otherwise(""))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def sanitize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]", "_"), F.lit("_"))


def redact(text: Column) -> Column:
    """Blank out bearer tokens, assigned secrets and two shapes of keys."""
    # The four patterns, in this order.
    for pattern, put in (
        (r"(?i)\bBearer\s+[A-Za-z0-9._\-+/=]+\b", "Bearer <redacted>"),
        (r"(?i)\b(api[_-]?key|token|secret|password)\b\s*[:=]\s*([^\s,;]+)", "$1=<redacted>"),
        (r"\bsk-[A-Za-z0-9]{16,}\b", "<redacted>"),
        (r"\bAIza[0-9A-Za-z_-]{20,}\b", "<redacted>"),
    ):
        text = F.regexp_replace(text, pattern, put)
    return text


def call_names(code: Column, skip: Sequence[str]) -> Column:
    """Identifiers called in a text, distinct in order of appearance."""
    found = F.array_distinct(F.regexp_extract_all(code, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)))
    return F.filter(found, lambda x: ~x.isin(*skip))


def is_test_path(path: Column) -> Column:
    p = F.lower(path)
    return p.startswith("test_") | p.endswith("_test.py") | p.contains("/test/") | p.contains("tests/") | p.endswith("test.py") | p.contains("test.") | p.contains("spec.")


def humanize_seconds(s: Column) -> Column:
    part = lambda by, within=None: F.floor((s if within is None else s % within) / by)
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", part(60), s % 60))
        .when(s < 86400, F.format_string("%dh %dm", part(3600), part(60, 3600)))
        .otherwise(F.format_string("%dd %dh", part(86400), part(3600, 86400)))
    )
