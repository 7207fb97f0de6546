"""Quality rules: a table of thresholds compiled into one Spark projection, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, table, words_of

SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"()"
#: Function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with he be this by at from or an have not".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas plus il ne ou se".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más es o".split(),
}
STOPS = sorted({w for ws in STOP_WORDS.values() for w in ws})


@dataclass(frozen=True)
class Rule:
    """A document fails if ``metric`` is below ``least`` or above ``most``."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Ratios are over words, but for lines.
RULES = (
    Rule("word_length", 2.0, 20.0),
    Rule("symbol_ratio", None, 0.25),
    Rule("bang_ratio", None, 0.25),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
)
MIN_WORDS = 50
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it and wherever the optimizer copies it."""
    return F.get(F.transform(F.array(value), f), 0)


def repeated_words(words: Column) -> Column:
    """The number of words in three-word windows that occur twice or more. Equal windows lie side by side once sorted; texts without any skip the sort."""

    def covered(places):
        return F.aggregate(
            places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")),
            lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.least(F.lit(3), p - acc["last"])).alias("sum")),
            lambda acc: acc["sum"],
        )

    def twice(pairs):
        same = lambda p, q: F.coalesce(p["x"] == q["x"], F.lit(False))
        again = F.filter(pairs, lambda p, j: same(F.get(pairs, j - 1), p) | same(F.get(pairs, j + 1), p))
        return covered(F.sort_array(F.transform(again, lambda p: p["i"])))

    def of_windows(win):
        pairs = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(win)) < F.size(win), let(pairs, twice)).otherwise(0)

    def of_words(w):
        win = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(win, of_windows)

    return let(words, of_words)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per document: ``row`` (the document's own columns), the five counts and the ratios of the table."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    df = df.select(
        "row",
        F.size(words_of(F.col("t"))).cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", WS, "")).cast("long").alias("word_chars"),
        _without(F.col("t"), SYMBOLS).cast("long").alias("n_symbols"),
        _without(F.col("t"), "!").alias("bangs"),
        let(F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        F.size(F.filter(F.split(F.translate(F.lower("t"), PUNCTUATION, ""), WS), lambda x: x.isin(STOPS))).alias("stops"),
        repeated_words(words_of(F.col("t"))).cast("long").alias("n_repeat_words"),
    ).withColumns({"n_dup_lines": F.col("lines.dup").cast("long"), "n_lines": F.col("lines.n")})
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.select(
        "row", *COLUMNS,
        (F.col("word_chars") / n).alias("word_length"), (F.col("n_symbols") / n).alias("symbol_ratio"), (F.col("bangs") / n).alias("bang_ratio"),
        (F.col("stops") / n).alias("stop_ratio"), (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_ratio"),
    )


def passes(rules=RULES) -> Column:
    """The table as one boolean expression."""
    ok = F.lit(True)
    for r in rules:
        if r.least is not None:
            ok = ok & (F.col(r.metric) >= r.least)
        if r.most is not None:
            ok = ok & (F.col(r.metric) <= r.most)
    return ok


def judged(docs: DataFrame, text_col: str = "text", rules=RULES, min_words: int = MIN_WORDS) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail; repeated rows are judged each on its own; an empty table gives no
    rows; the document's columns travel inside ``row``, so none of their names can clash.
    """
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(docs, text_col).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & passes(rules))


def quality_filter(docs: DataFrame, **kw) -> DataFrame:
    """The documents that pass, with their own columns only."""
    # A filter is pushed through deterministic projections by copying their expressions, which would compute the counts
    # twice; it does not pass a row number.
    return judged(docs, **kw).withColumn("at", F.monotonically_increasing_id()).where("kept AND at >= 0").select("row.*")


def op6_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("row.doc_id", *COLUMNS, "base_failed", "kept")


_IN = ", ".join(f"'{w}'" for w in STOPS)
_BOUNDS = " AND ".join(f"{r.metric} {op} {v}" for r in RULES for op, v in ((">=", r.least), ("<=", r.most)) if v is not None)
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines,
  length(t) - length(replace(t, '!', '')) AS bangs,
  len(list_filter(string_split_regex(regexp_replace(lower(t), '[.,;:!?"()]', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x IN ({_IN}))) AS stops
  FROM w LEFT JOIN cov USING (rid)),
r AS (SELECT *, word_chars / greatest(n_words, 1) AS word_length, n_symbols / greatest(n_words, 1) AS symbol_ratio, bangs / greatest(n_words, 1) AS bang_ratio,
  stops / greatest(n_words, 1) AS stop_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_BOUNDS} AS kept FROM r
"""
