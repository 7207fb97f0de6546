"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query expansions (the first three count), intents in the order they are tried, and what they narrow to.
SYNONYMS = {
    "auth": ["authentication", "authorization", "login"],
    "login": ["authentication", "signin", "credential"],
    "database": ["db", "sql", "query"],
    "api": ["endpoint", "route", "controller"],
    "error": ["exception", "catch", "throw"],
    "config": ["configuration", "settings", "environment"],
    "test": ["spec", "unit", "integration"],
    "cache": ["redis", "memcache", "ttl"],
    "log": ["logging", "logger", "trace"],
    "queue": ["worker", "job", "task"],
    "security": ["encrypt", "decrypt", "hash"],
    "validate": ["validation", "schema", "sanitize"],
    "deploy": ["deployment", "docker", "kubernetes"],
    "middleware": ["interceptor", "filter", "guard"],
}
INTENTS = [
    ("find-implementation", r"\b(how|implement|create|build|write|make)\b"),
    ("find-usage", r"\b(where|find|locate|show)\b.*\b(use|used|call|called|reference)\b"),
    ("understand-architecture", r"\b(architecture|structure|overview|diagram|design|pattern)\b"),
    ("find-definition", r"\b(what is|define|definition|interface|type|class|function)\b"),
    ("find-configuration", r"\b(config|setting|env|environment|option|parameter)\b"),
    ("find-test", r"\b(test|spec|mock|fixture|assert)\b"),
    ("find-documentation", r"\b(doc|readme|guide|tutorial|example|usage)\b"),
    ("debug", r"\b(bug|error|fix|debug|issue|problem|fail)\b"),
]
NARROWING = {
    "find-test": ("tags", ["test"]),
    "find-configuration": ("domains", ["config"]),
    "find-documentation": ("kinds", ["section", "paragraph"]),
    "find-implementation": ("kinds", ["function", "method", "class"]),
    "find-definition": ("kinds", ["class", "interface", "function"]),
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def estimate_tokens(c: Column) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("long")


def truncate_tokens(c: Column, n: int) -> Column:
    return F.when(F.length(c) > 4 * n, F.concat(F.substring(c, 1, 4 * n), F.lit("..."))).otherwise(c)


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def make_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), short_hash(F.concat_ws(":", *[p.cast("string") for p in parts])))


def normalize_query(c: Column) -> Column:
    spaced = F.lower(F.regexp_replace(strip(c), r"\s+", " "))
    return strip(F.regexp_replace(spaced, r"[^\w\s\-_.?]", " "))


def rewrite_query(c: Column) -> Column:
    words = F.split(c, r"\s+")
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = F.flatten(F.transform(words, lambda w: F.coalesce(F.element_at(table, F.lower(w)), F.array().cast("array<string>"))))
    return F.array_join(F.array_distinct(F.concat(words, more)), " ")


def detect_intent(c: Column) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(INTENTS):
        out = F.when(F.lower(c).rlike(pattern), name).otherwise(out)
    return out


def intent_filter(intent: Column, field: str) -> Column:
    """The values that an intent narrows ``field`` to, or null."""
    out = F.lit(None).cast("array<string>")
    for name, (f, values) in NARROWING.items():
        if f == field:
            out = F.when(intent == name, F.array(*map(F.lit, values))).otherwise(out)
    return out


def sanitize_fts(c: Column) -> Column:
    """The words of a full-text query: quotes, stars and parentheses dropped, words of one character left out."""
    return F.filter(F.split(F.regexp_replace(c, "['\"*()]", ""), r"\s+"), lambda w: F.length(w) > 1)


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s")))


#: Fixed value: instants as text, in UTC and to the millisecond.
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso_time(at: Column) -> Column:
    """A timestamp as text, for a session in UTC."""
    return F.date_format(at, ISO)


def from_iso(text: Column) -> Column:
    """The timestamp of such a text; null for anything else."""
    return F.try_to_timestamp(text, F.lit(ISO))
