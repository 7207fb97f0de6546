"""Fill-in-the-middle transformation in built-in functions.

A text is an array of units (``regexp_extract_all``), cut at two places that follow from a hash of its id (``conv`` of
parts of ``sha2``), arranged around sentinels (``slice`` and ``array_join``), and restored by parsing the sentinels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: A unit of text, as a regular expression that matches at every place: here a code point.
UNIT = r"(?s)."
#: Percent of the texts that are rearranged, and of these percent whose suffix comes first.
RATE, SUFFIX_FIRST = 90, 20
SALT = "1"


def draws(key: Column, salt: str = SALT) -> Column:
    """Four numbers of 32 bits from the SHA-256 of salt, colon and key; a null key counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in s)


def fill_in_middle(
    docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = UNIT, sentinels: tuple = SENTINELS, salt: str = SALT, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``row`` (the record, all its columns), ``n`` (units), ``form``, ``prefix``, ``middle``, ``suffix`` and ``output`` for every record.

    ``form`` is "plain" (the text as it is: empty ones, those that hold a sentinel, and those that the rate leaves
    out), "psm" (prefix, suffix, middle) or "spm" (suffix, prefix, middle); parts are null where it is plain. ``unit``
    must match all of a text: the units joined are the text. A null text counts as empty. Equal ids and texts come out
    equal; an empty table gives no rows. Columns travel inside ``row``, so none can clash. One projection, no shuffle:
    a text's units are in memory while its row is, some sixty bytes each.
    """
    if len({*sentinels}) != 3 or not all(sentinels) or any(a in b for a in sentinels for b in sentinels if a != b):
        raise ValueError("three sentinels, none of which is part of another")
    p, s, m = map(F.lit, sentinels)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    df = docs.select(row, text.alias("text"), draws(F.col(f"`{id_col}`"), salt).alias("h"))
    df = df.select("row", "text", "h", F.regexp_extract_all("text", F.lit(unit), F.lit(0)).alias("units"))
    df = df.select("*", F.size("units").alias("n"))
    first, second = (F.col("h")[i] % (F.col("n") + 1) for i in (0, 1))
    held = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    plain = (F.col("n") == 0) | held | (F.col("h")[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    df = df.select("row", "text", "units", "n", F.least(first, second).cast("int").alias("low"), F.greatest(first, second).cast("int").alias("high"), form.alias("form"))
    part = lambda begin, end: F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin + 1, end - begin), ""))
    df = df.select(
        "row", "text", F.col("n").cast("long").alias("n"), "form",
        part(F.lit(0), F.col("low")).alias("prefix"), part(F.col("low"), F.col("high")).alias("middle"), part(F.col("high"), F.col("n")).alias("suffix"),
    )
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    return df.select("row", "n", "form", "prefix", "middle", "suffix", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"))


def restored(output: Column, form: Column, sentinels: tuple = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of. The sentinels stand once each, as no other text holds them; null stays null."""
    parts = F.split(output, "|".join(map(_quoted, sentinels)))
    order = F.when(form == "psm", F.array(F.lit(2), F.lit(4), F.lit(3))).when(form == "spm", F.array(F.lit(3), F.lit(4), F.lit(2)))
    return F.when(form == "plain", output).otherwise(F.array_join(F.transform(order, lambda i: F.element_at(parts, i)), ""))


def op13_fill_in_middle(spark, sf_dir):
    sha = lambda c: F.sha2(c, 256)
    return fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "row.doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
