"""URL filter: gradient-boosted trees on lexical features of a URL, trained from labelled URLs, behind a list of rules."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, scratch, table
from .quality_rules import let

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Up to so many rules are compiled into one expression; more are joined by host.
COMPILED_RULES = 1000
#: Bound of the labelled URLs of each class that the trees are trained on, by hash of the URL.
TRAIN_ROWS = 10_000
PRIOR = 20.0
SUFFIXES = ("tld", "domain", "ending")
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digit_ratio", "hyphens", "host_entropy", "entropy", "params", "fragment", "secure", "tld_rate", "domain_rate", "ending_rate")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for texts without ``://``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, ascii_lower(host)).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null; ties go to the rule that sorts first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=_precedence):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _precedence(rule: tuple[str, str, str]) -> tuple:
    """Greater for the rule that wins: the longer, then of equal length the one that sorts first by host, path and verdict."""
    verdict, h, p = rule
    return len(h + p), [-ord(c) for c in h + "\0" + p + "\0" + verdict]


def ruled(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` (host, path, ...) with ``hit`` (see ``rule_of``). Many rules are joined by the ends of hosts instead, to the same result."""
    if len(rules) <= COMPILED_RULES:
        return urls.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    rows = [(h, p, v, k) for k, (v, h, p) in enumerate(sorted(rules, key=_precedence))]
    table_ = urls.sparkSession.createDataFrame(rows, "end string, prefix string, verdict string, k int")
    ends = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in sorted({h.count(".") + 1 for _, h, _ in rules})]))
    found = urls.select("host", "path").distinct().withColumn("end", F.explode(ends)).join(table_, "end").where(F.startswith("path", F.col("prefix")))
    found = found.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("end", "prefix").alias("rule"), "verdict"), "k").alias("hit"))
    return urls.join(found, ["host", "path"], "left")


def entropy(text: Column) -> Column:
    """Bits a character."""

    def of(chars):
        n = F.size(chars)
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        bits = F.aggregate(F.transform(F.array_distinct(chars), share), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
        return F.when(n == 0, 0.0).otherwise(bits)

    return let(F.filter(F.split(text, ""), lambda x: x != ""), of)


def suffixes(urls: DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with the suffixes that have statistics."""
    return urls.select(
        "*", F.substring_index("host", ".", -1).alias("tld"), F.substring_index("host", ".", -2).alias("domain"), F.regexp_extract("path", r"(\.[A-Za-z0-9]{1,8}|/)$", 1).alias("ending"),
    )


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` with columns url, host and path gets the features that need no statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    n = F.greatest(F.length(url), F.lit(1))
    return urls.select(
        "*",
        F.length(url).cast("double").alias("length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        ((F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n).alias("digit_ratio"),
        (F.length("host") - F.length(F.translate("host", "-", ""))).cast("double").alias("hyphens"),
        entropy(F.col("host")).alias("host_entropy"), entropy(url).alias("entropy"),
        F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double").alias("params"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"), F.startswith(url, F.lit("https://")).cast("double").alias("secure"),
    )


def with_rates(urls: DataFrame, known: DataFrame, base: float, own: bool = False) -> DataFrame:
    """Suffix statistics: the smoothed share of blocked URLs among all labelled ones (``known``: suffixes, label) with that suffix.

    With ``own``, ``urls`` are labelled ones themselves, and each one's own label is left out of its statistics: else a
    suffix that occurs once would give the label away. Spark broadcasts the statistics only if they are small.
    """
    mine, one = (F.col("label"), 1) if own else (F.lit(0.0), 0)
    for c in SUFFIXES:
        rates = known.groupBy(c).agg(F.sum("label").alias("_blocked"), F.count(F.lit(1)).alias("_all"))
        rate = (F.col("_blocked") - mine + PRIOR * base) / (F.col("_all") - one + PRIOR)
        urls = urls.join(rates, c, "left").withColumn(f"{c}_rate", F.coalesce(rate, F.lit(base))).drop("_blocked", "_all")
    return urls


def training(known: DataFrame, counts: dict[float, int], rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` URLs of each class of ``known`` (distinct ones), by a hash, and ``weight``: how many each stands for."""
    parts = [known.where(F.col("label") == y).orderBy(F.xxhash64("url"), "url").limit(rows).withColumn("weight", F.lit(max(1.0, n / rows))) for y, n in sorted(counts.items())]
    return parts[0].unionByName(parts[1])


def filter_urls(urls: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``urls`` (``key``, ``url``) with host, path, rule, verdict and the trees' ``block_score`` (null where a rule decides).

    ``labelled`` has ``url`` and ``label`` (1.0: block). Without it the URLs that a rule decides are the labelled ones.
    Copies of a labelled URL count once, and of different labels the greater. Null URLs and URLs without ``://`` have
    an empty host and path, fit no rule and are judged by the trees. With no labelled URL of one of the two classes,
    there is nothing to learn: what no rule blocks is allowed. Repeated rows are judged alike; an empty table gives no
    rows.
    """
    host, path = split_url(F.col("url"))
    df = ruled(urls.select("key", "url", host.alias("host"), path.alias("path")), rules)
    if labelled is None:
        known = df.where("hit IS NOT NULL").select("url", "host", "path", (F.col("hit.verdict") == "block").cast("double").alias("label"))
    else:
        known = labelled.select("url", host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")).where("label IS NOT NULL")
    known = materialize(suffixes(known.groupBy("url", "host", "path").agg(F.max("label").alias("label"))), "known")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    own = ("key", "url", "host", "path", "hit")
    if set(counts) != {0.0, 1.0}:
        return df.select(*own[:4], "hit.rule", F.coalesce("hit.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    base = counts[1.0] / sum(counts.values())
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    gbt = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=12, maxDepth=3, stepSize=0.3, maxBins=32, seed=7)
    parts = max(1, sum(min(n, TRAIN_ROWS) for n in counts.values()) // 2000)
    with scratch():
        model = gbt.fit(materialize(vectors.transform(with_rates(lexical(training(known, counts).repartition(parts, "url")), known, base, own=True)).select("features", "label", "weight"), "trees"))
    open_ = with_rates(lexical(suffixes(df.where("hit IS NULL"))), known, base)
    scored = model.transform(vectors.transform(open_)).select(
        *own[:4], F.lit(None).cast("string").alias("rule"), F.when(F.col("prediction") > 0.5, "block").otherwise("allow").alias("verdict"),
        F.element_at(_to_array(F.col("probability")), 2).alias("block_score"),
    )
    decided = df.where("hit IS NOT NULL").select(*own[:4], "hit.rule", "hit.verdict", F.lit(None).cast("double").alias("block_score"))
    return decided.unionByName(scored)


def _to_array(c: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(c)


def op3_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url")
    return filter_urls(pages).select(F.col("key").alias("page_id"), "host", "path", "rule", "verdict", "block_score")
