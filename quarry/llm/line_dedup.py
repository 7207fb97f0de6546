"""Line dedup: a suffix array over the corpus's line sequences by distributed prefix doubling, in built-in operators.

Round k ranks every suffix (a place in a document) by its first 2^k lines. Ranks come from a range-partitioned sort of
the distinct pairs (rank, rank 2^(k-1) lines on) and a running count over the partitions; suffixes whose prefix occurs
once leave. Two suffixes share their first m lines, so lie in one interval of the longest-common-prefix array at depth
m, exactly if both of the overlapping 2^k-line ranks that cover m lines agree. Of each interval deep enough to hold
``min_words`` words the first place in corpus order keeps its lines; the lines of all later copies go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WS, materialize, scratch, table

MIN_WORDS = 50


def _key(doc_id: Column, text: Column) -> Column:
    """A document's key: repeated rows share it, so that they are no copies of each other."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("\x01"), text).cast("binary")))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, WS, " "))


def _reach(words: Column, start: Column, least: int, back: bool) -> Column:
    """How many lines from ``start`` on (or back) hold ``least`` words; null if the document ends before. Each line has a word."""
    if back:
        part = F.reverse(F.slice(words, F.greatest(start + 2 - least, F.lit(1)), F.least(start + 1, F.lit(least))))
    else:
        part = F.slice(words, start + 1, least)
    sums = F.aggregate(
        part, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("m")),
        lambda acc, x: F.when(acc["sum"] >= least, acc).otherwise(F.struct((acc["sum"] + x).alias("sum"), (acc["m"] + 1).alias("m"))),
    )
    return F.when(sums["sum"] >= least, sums["m"])


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """A row for each line with a word: doc, none and doc_id (the corpus order), no (its number among such lines), h (the line's digest), and how many lines from it on (``ahead``) and up to it (``behind``) hold ``min_words``."""
    text = F.coalesce("text", F.lit(""))
    d = docs.select(_key(F.col("doc_id"), text).alias("doc"), F.col("doc_id").isNull().alias("none"), "doc_id", F.filter(F.transform(F.split(text, "\n"), _normal), lambda x: x != "").alias("lines"))
    d = d.withColumn("words", F.transform("lines", lambda x: F.size(F.split(x, " "))))
    d = d.select("doc", "none", "doc_id", F.posexplode(F.transform("lines", lambda x, i: F.struct(
        F.unhex(F.md5(x.cast("binary"))).alias("h"), _reach(F.col("words"), i, min_words, False).alias("ahead"), _reach(F.col("words"), i, min_words, True).alias("behind"),
    ))).alias("no", "x"))
    return d.select("doc", "none", "doc_id", "no", "x.*").dropDuplicates(["doc", "no"])


def ranked(keys: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct ``keys`` with ``rank``, their place in the order of ``cols``, from 0."""
    spread = materialize(keys.repartitionByRange(*cols).withColumn("part", F.spark_partition_id()), "range")
    sizes = spread.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    # A row for each partition.
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*cols)) - 1
    return spread.withColumn("inside", inside).join(F.broadcast(starts), "part").select(*cols, (F.col("start") + F.col("inside")).alias("rank"))


def _twice(pairs: DataFrame, cols: list[str]) -> DataFrame:
    return pairs.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*cols)


def intervals(lines: DataFrame) -> DataFrame:
    """The windows of ``lines`` that hold enough words and occur more than once: none, doc_id, doc, at (their place), m (lines), and the interval (k, m, a, b) they lie in."""
    # A window counts only if the line it was measured from occurs twice.
    alive = lines.join(ranked(_twice(lines, ["h"]), ["h"]), "h").select("doc", "none", "doc_id", "no", "ahead", "behind", "rank")
    alive = materialize(alive, "alive")
    ahead = alive.where("ahead IS NOT NULL").select("doc", "none", "doc_id", F.col("no").alias("at"), F.col("ahead").alias("m"))
    behind = alive.where("behind IS NOT NULL").select("doc", "none", "doc_id", (F.col("no") - F.col("behind") + 1).alias("at"), F.col("behind").alias("m"))
    windows = ahead.unionByName(behind)
    longest = alive.agg(F.greatest(F.max("ahead"), F.max("behind"))).first()[0] or 0
    suffixes = alive.select("doc", "no", "rank")
    found, k = None, 0
    while 1 << k <= longest:
        step = 1 << k
        mine = windows.where(F.col("m").between(step, 2 * step - 1))
        first = suffixes.select("doc", F.col("no").alias("at"), F.col("rank").alias("a"))
        last = suffixes.select("doc", F.col("no").alias("to"), F.col("rank").alias("b"))
        hit = mine.join(first, ["doc", "at"]).withColumn("to", F.col("at") + F.col("m") - step).join(last, ["doc", "to"])
        hit = hit.select(F.lit(k).alias("k"), "m", "a", "b", "none", "doc_id", "doc", "at")
        found = hit if found is None else found.unionByName(hit)
        if 2 << k > longest:
            break
        on = F.first("rank").over(Window.partitionBy("doc").orderBy("no").rangeBetween(step, step))
        pairs = materialize(suffixes.select("doc", "no", F.col("rank").alias("a"), on.alias("b")).where("b IS NOT NULL"), "pairs")
        suffixes = materialize(pairs.join(ranked(_twice(pairs, ["a", "b"]), ["a", "b"]), ["a", "b"]).select("doc", "no", "rank"), "suffixes")
        if suffixes.isEmpty():
            break
        k += 1
    return found


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc and ``gone``, the numbers (among lines with a word) of the lines that later copies hold, for each document with any."""
    lines = materialize(line_table(docs, min_words), "lines")
    found = intervals(lines)
    if found is None:
        return lines.where("false").select("doc", F.array().cast("array<int>").alias("gone"))
    found = materialize(found, "windows")
    first = found.groupBy("k", "m", "a", "b").agg(F.min(F.struct("none", "doc_id", "doc", "at")).alias("first"))
    first = materialize(first, "first")  # so that Spark can split the join of a hot interval
    later = found.join(first, ["k", "m", "a", "b"]).where((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    gone = later.select("doc", F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("no")).distinct()
    return gone.groupBy("doc").agg(F.collect_list("no").alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``row`` (the document's own columns), ``text`` without later copies of runs of at least ``min_words`` words, n_lines and n_removed.

    Lines are equal up to their white space; lines without words end no run and stay. Corpus order is by doc_id
    (nulls last), then by text. Null texts stay null and empty ones empty. Repeated rows (same id, same text) are
    one document: they lose and keep the same lines. An empty table gives no rows. Columns of ``docs`` travel inside
    ``row``, so none can clash.
    """
    with scratch() as keep:
        gone = materialize(repeated_lines(docs.select("doc_id", "text"), min_words), "gone")
        keep(gone)
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(F.col("doc_id"), F.coalesce("text", F.lit(""))).alias("doc"))
    d = d.join(gone.hint("merge"), "doc", "left")  # the same plan at every size
    d = d.withColumn("all", F.split(F.coalesce("row.text", F.lit("")), "\n"))
    every = F.sequence(F.lit(0), F.size("all") - 1)
    d = d.withColumn("real", F.filter(every, lambda i: F.get("all", i).rlike(r"[^\x20\x09-\x0D]")))
    kept = F.array_except(every, F.transform("gone", lambda j: F.get("real", j)))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("all", i)), "\n"))
    return d.select("row", text.alias("text"), F.size("real").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def op10_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("row.doc_id", "n_lines", "n_removed", "text")


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') AS l FROM d),
f AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM e),
c AS (SELECT doc_id, l, i, sum(len(string_split(l[i], ' '))) OVER (PARTITION BY doc_id ORDER BY i) AS upto, len(string_split(l[i], ' ')) AS w FROM f),
g AS (SELECT x.doc_id, x.i AS a, min(y.i) AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i >= x.i AND y.upto - x.upto + x.w >= 50 GROUP BY ALL
  UNION SELECT x.doc_id, max(y.i) AS a, x.i AS b FROM c x JOIN c y ON x.doc_id = y.doc_id AND y.i <= x.i AND x.upto - y.upto + y.w >= 50 GROUP BY x.doc_id, x.i),
h AS (SELECT g.doc_id, a, b, array_to_string(l[a:b], chr(10)) AS s FROM g JOIN e USING (doc_id)),
k AS (SELECT doc_id, a, b FROM h QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, a) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM k),
n AS (SELECT doc_id, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS raw FROM d),
o AS (SELECT *, CASE WHEN regexp_matches(x, '[^\x20\x09-\x0D]') THEN sum(CAST(regexp_matches(x, '[^\x20\x09-\x0D]') AS INT)) OVER (PARTITION BY doc_id ORDER BY raw) END AS i FROM n),
p AS (SELECT o.doc_id, string_agg(x, chr(10) ORDER BY raw) FILTER (r.i IS NULL) AS t, count(o.i) AS nl, count(r.i) AS nr FROM o LEFT JOIN r ON o.doc_id = r.doc_id AND o.i = r.i GROUP BY o.doc_id)
SELECT d.doc_id, CAST(nl AS BIGINT) AS n_lines, CAST(nr AS BIGINT) AS n_removed, CASE WHEN nr = 0 THEN text ELSE coalesce(t, '') END AS text FROM d JOIN p USING (doc_id)
"""
