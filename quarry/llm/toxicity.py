"""Toxicity: maximum-scoring segments over token log-odds.

Token weights are log-odds of a token's share of toxic and of clean labelled text under Dirichlet priors, less one
standard deviation. Words that share a beginning back each other: a word has the weight of whichever says most, itself
or one of its beginnings; all other tokens together have one (negative) weight. A linear scan (Ruzzo and Tompa, 1999)
finds every maximal scoring segment of a text; extreme-value statistics of such segments (Karlin and Altschul, 1990)
say how many as good a clean text of that length would have, and make the document's score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass, field, replace
from functools import cached_property

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize, scratch, table

#: Bound of the labelled documents of each class that the weights are fitted on, by a hash of the id.
TRAIN_ROWS = 10_000
#: One labelled text in so many serves for the calibration, and not for the weights.
FOLDS = 5
#: Uses of each token that the prior adds, split between the classes by their size.
PRIOR = 1.0
#: The least z-score and log-odds (less one standard deviation) of a token with a weight of its own.
LEAST_Z, LEAST_WEIGHT = 3.5, 1.0
#: The fewest toxic texts that such a token, or a beginning, occurs in.
LEAST_TEXTS = 3
#: Lengths of the beginnings of words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: What any other token loses: the least that ``fit`` gives, and the default of a model made by hand.
LEAST_DRIFT, DRIFT = 0.01, 0.15
SIGNIFICANT = 0.02
THRESHOLD = 0.3
#: Words whose weights a worker remembers.
REMEMBERED = 500_000
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # of whole words
    base: float  # share of toxic documents
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0  # of the score's log-odds over -log(p)
    shift: float = 0.0
    starts: dict[str, float] = field(default_factory=dict)  # weights of beginnings
    drift: float = DRIFT

    @cached_property
    def seen(self) -> Seen:
        return Seen(self)


class Seen(dict):
    """Word to its weight, or None, for the words that a worker has met."""

    def __init__(self, model: Model):
        self.model = model

    def __missing__(self, word: str) -> float | None:
        if len(self) >= REMEMBERED:
            self.clear()
        own = [self.model.starts.get(word[:n]) for n in BEGINNINGS if len(word) > n]
        out = self[word] = max((w for w in [self.model.weights.get(word), *own] if w is not None), default=None)
        return out


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last token) of a text whose tokens score ``-drift`` but for ``scores`` (ascending positions).

    Each segment on the stack knows the nearest one below it that began at a lower total, so that the scan is linear.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, the nearest with less before
    total, at = 0.0, 0
    for pos, s in scores:
        total -= drift * (pos - at)
        at = pos + 1
        first, before, after = pos, total, total + s
        total = after
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((first, pos, before, after, j))
                break
            first, _, before, _, below = stack[j]
            del stack[j:]
            j = below
    return [(after - before, first, last) for first, last, before, after, _ in stack]


def scan(text: str | None, model: Model) -> tuple[int, list[tuple[float, int, int]]]:
    """The number of tokens and the maximal segments. Every use of a token counts its whole weight."""
    found = TOKEN.findall((text or "").lower())
    hits = [(i, w) for i, w in enumerate(map(model.seen.__getitem__, found)) if w is not None]
    return len(found), segments(hits, model.drift) if hits else []


def _tail(mean: float, r: int, enough: float = math.inf) -> float:
    """The chance of at least ``r`` events where fewer than ``r`` are expected; a lower bound of it where that is already ``enough``."""
    if r == 1:
        return -math.expm1(-mean)
    if mean <= 0:
        return 0.0
    total = term = math.exp(r * math.log(mean) - mean - math.lgamma(r + 1))
    while term > 1e-17 * total and total < enough:
        r += 1
        term *= mean / r
        total += term
    return min(1.0, total)


def p_value(n: int, found: list[tuple[float, int, int]], model: Model) -> float:
    """How likely a clean text of ``n`` tokens has segments as good as these: the best of the r best, over all r, corrected for the choice of r."""
    best = 1.0
    for r, s in enumerate(sorted((x[0] for x in found), reverse=True), 1):
        mean = model.k * max(n, 1) * math.exp(-model.lam * s)
        if mean < r:  # else at least r events have a chance of a half and more, and r * (r + 1) times that is no evidence
            best = min(best, r * (r + 1) * _tail(mean, r, best / (r * (r + 1))))
    return best


def score(n: int, found: list, model: Model) -> float:
    x = model.shift + model.slope * evidence(n, found, model)
    return 1 / (1 + math.exp(-x))


def evidence(n: int, found: list, model: Model) -> float:
    return -math.log(max(p_value(n, found, model), 1e-13))


def _root(rates: list[tuple[float, float]], drift: float) -> float:
    """The positive root of sum(rate * exp(x * score)) = 1, by halving."""
    rest = max(1e-9, 1 - sum(p for p, _ in rates))
    f = lambda x: sum(p * math.exp(min(600.0, x * s)) for p, s in rates) + rest * math.exp(-x * drift) - 1
    low, high = 1e-6, 1e-3
    while f(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), 1)


def _family(words: Column) -> Column:
    """The least hash of a text's three-word windows, which near copies nearly always share."""
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(words, i + 1, 3))))
    return F.array_min(windows)


def _named(word: Column) -> Column:
    """The features of a word: each of its beginnings, and "=" with the word for itself."""
    return F.array_compact(F.array(F.concat(F.lit("="), word), *[F.when(F.length(word) > n, F.substring(word, 1, n)) for n in BEGINNINGS]))


def _fitted(train: DataFrame) -> tuple[list, dict, dict]:
    """(f, a, b, w) of the features with a weight of their own, from ``train`` (words: the distinct ones of a text, toxic), and tokens and texts of each class.

    Of a word and its beginnings the one of most weight takes the word; what then is left of the others is weighed
    anew. Shares are of distinct words of texts; the spread follows the number of toxic texts. The driver gets only
    features that several toxic texts have, so no more than the bounded sample holds.
    """
    a, b = F.col("toxic"), 1 - F.col("toxic")
    by = materialize(train.select("toxic", F.explode("words").alias("x")).groupBy("x").agg(F.sum(a).alias("a"), F.sum(b).alias("b")), "tokens")
    total = by.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    t1, t0 = max(total["a"], 1), max(total["b"], 1)
    toxic, clean = F.col("a") + PRIOR * t1 / (t1 + t0), F.col("b") + PRIOR * t0 / (t1 + t0)
    odds, sd = F.log(toxic / clean) - math.log(t1 / t0), F.sqrt(1 / (F.least("texts", "a") + PRIOR * t1 / (t1 + t0)) + 1 / clean)

    def strong(counts):
        return counts.where((F.col("a") >= LEAST_TEXTS) & (odds >= LEAST_Z * sd) & (odds - sd >= LEAST_WEIGHT)).withColumn("w", odds - sd)

    features = F.array_distinct(F.flatten(F.transform("words", _named)))
    texts = train.where("toxic = 1").select(F.explode(features).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= LEAST_TEXTS)
    own = by.select(F.explode(_named(F.col("x"))).alias("f"), F.col("x").alias("word"), "a", "b")
    good = materialize(strong(own.groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).join(texts, "f")).select("f", "texts", "w"), "features")
    best = F.max(F.struct("w", F.length("f"), "f", "texts")).alias("best")
    taken = own.join(good, "f").groupBy("word").agg(best, F.first("a").alias("a"), F.first("b").alias("b"))
    rows = strong(taken.groupBy("best.f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.first("best.texts").alias("texts"))).collect()
    return rows, t1, t0


def _model(rows: list, t1: int, t0: int, base: float) -> Model:
    """Weights, drift (the log-odds of all other tokens together) and Karlin-Altschul's lambda for just these."""
    r1, r0 = (min(0.5, sum(r[c] for r in rows) / t) for c, t in (("a", t1), ("b", t0)))
    drift = max(LEAST_DRIFT, math.log((1 - r0) / (1 - r1)))
    lam = _root([((r["b"] + 0.5) / t0, r["w"]) for r in rows], drift)
    words = {r["f"][1:]: r["w"] for r in rows if r["f"][0] == "="}
    starts = {r["f"]: r["w"] for r in rows if r["f"][0] != "="}
    return Model(words, base, lam=lam, starts=starts, drift=drift)


def _calibrated(model: Model, docs: DataFrame) -> Model:
    """K, and the score's log-odds, from ``docs`` (text, toxic, share) that the weights have not seen.

    K is such that at no height up to the greatest weight clean texts have more segments than it expects.
    """
    every = [*model.weights.values(), *model.starts.values()]
    heights = sorted({round(w, 1) for w in every})

    def observe(batches):
        total, seen = 0, [0] * len(heights)
        for batch in batches:
            for t in batch.column("text"):
                n, found = scan(t.as_py(), model)
                total += n
                for s, _, _ in found:
                    seen[bisect_right(heights, s + 0.05) - 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(heights))], pa.int32()), pa.array([total, *seen], pa.int64())], ["at", "n"])

    seen = {r["at"]: r["n"] for r in docs.where("toxic = 0").select("text").mapInArrow(observe, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    above, ks = 0, [1 / math.exp(-model.lam * heights[0])]
    for at in reversed(range(len(heights))):
        above += seen.get(at, 0)
        if above >= LEAST_TEXTS or at == 0:
            ks.append((above + 1) / math.exp(-model.lam * heights[at]))
    model = replace(model, k=max(ks) / max(seen.get(-1, 0), 1))

    def binned(batches):
        for batch in batches:
            x = [round(4 * evidence(*scan(t.as_py(), model), model)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), batch.column("toxic"), batch.column("share")], ["x", "toxic", "share"])

    bins = docs.select("text", F.col("toxic").cast("int").alias("toxic"), "share").mapInArrow(binned, "x int, toxic int, share double").groupBy("x", "toxic").agg(F.sum("share").alias("n")).collect()
    slope, shift = _logistic([(r["x"] / 4, r["toxic"], r["n"]) for r in bins], model.base)
    return replace(model, slope=slope, shift=shift)


def _logistic(bins: list[tuple[float, int, float]], base: float, ridge: float = 1.0) -> tuple[float, float]:
    """Newton steps for log-odds = shift + slope * x; the slope is drawn towards 1 and stays above 0.1."""
    slope, shift = 1.0, math.log(base / (1 - base))
    for _ in range(50):
        g0 = h00 = h01 = 0.0
        g1, h11 = -ridge * (slope - 1), ridge
        for x, y, n in bins:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, shift + slope * x))))
            g0, g1, w = g0 + n * (y - p), g1 + n * (y - p) * x, n * p * (1 - p) + 1e-9
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        big = max(1.0, abs(d0), abs(d1))
        shift, slope = shift + d0 / big, max(0.1, slope + d1 / big)
        if abs(d0) + abs(d1) < 1e-7:
            break
    return slope, shift


def fit(labelled: DataFrame) -> Model:
    """Weights and calibration from ``labelled`` (doc_id, text, toxic 0/1 and perhaps share; see ``training_rows``); nulls in ``toxic`` are left out.

    Of near copies with one label a single one counts. One text in FOLDS is kept for the calibration, which fits its
    constants to just the weights that are used, on texts that they have not seen. With no document of one class there
    are no weights, and every text gets the same low score.
    """
    with scratch():
        return _fit(labelled)


def _fit(labelled: DataFrame) -> Model:
    share = F.col("share") if "share" in labelled.columns else F.lit(1.0)
    known = labelled.where("toxic IS NOT NULL").select("text", F.col("toxic").cast("long").alias("toxic"), share.cast("double").alias("share"))
    known = known.withColumn("words", _words(F.col("text"))).withColumn("family", F.coalesce(_family(F.col("words")), F.lit(0).cast("long")))
    known = known.withColumn("words", F.array_distinct("words")).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "family"), F.lit(FOLDS)))
    one = known.groupBy("family", "toxic").agg(F.min_by(F.struct("text", "words", "fold", "share"), F.struct(F.length("text"), "text")).alias("x")).select("toxic", "x.*")
    train = materialize(one, "labelled")
    n = {(r["toxic"], r["own"]): (r["n"], r["w"]) for r in train.groupBy("toxic", (F.col("fold") == 0).alias("own")).agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("w")).collect()}
    w1, w0 = (sum(n.get((t, own), (0, 0.0))[1] for own in (True, False)) for t in (1, 0))
    base = (w1 + 1) / (w1 + w0 + 10)
    out = no_model = Model({}, base, shift=math.log(min(base, 0.2) / (1 - min(base, 0.2))))
    if w1 and w0:
        apart = all((t, own) in n for t in (0, 1) for own in (True, False))
        rows, t1, t0 = _fitted(train.where("fold > 0") if apart else train)
        out = _calibrated(_model(rows, t1, t0, base), train.where("fold = 0") if apart else train) if rows else no_model
    return out


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
SPANS_SQL = "array<struct<first:int,last:int,score:double,expected:double>>"


def _judged(texts, model: Model) -> tuple[pa.Array, pa.Array]:
    scores, spans = [], []
    for t in texts:
        n, found = scan(t.as_py(), model)
        scores.append(score(n, found, model))
        e = [(s, a, b, model.k * max(n, 1) * math.exp(-model.lam * s)) for s, a, b in found]
        spans.append([{"first": a, "last": b, "score": s, "expected": x} for s, a, b, x in e if x <= SIGNIFICANT])
    return pa.array(scores, pa.float64()), pa.array(spans, SPANS)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) and ``passages`` (first and last token, segment score, expected number in clean text; those up to SIGNIFICANT) of every document.

    A null or empty text has no segment and gets the score of a clean text. Whole texts are scanned, however long.
    Repeated rows get equal scores; an empty table gives no rows. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_judged(batch.column("text"), model)], ["doc_id", "score", "passages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, passages {SPANS_SQL}")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below ``threshold``, with all their columns, in one pass."""

    def run(batches):
        for batch in batches:
            scores, _ = _judged(batch.column("text"), model)
            yield batch.filter(pc.less(scores, threshold))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """At most ``rows`` labelled documents of each class outside the held-out part, by a hash of the id, and ``share``: how many of the labelled each stands for.

    Of a document's labels the highest counts, and of rows with one id the least text.
    """
    own = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.where(~held_out(F.col("doc_id"), 4, 2))
    total = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for t in (0, 1):
        part = own.where(F.col("toxic") == t).orderBy(*order).limit(rows).withColumn("share", F.lit(max(1.0, total.get(t, 0) / rows)))
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * TRAIN_ROWS ids and labels
    return found.groupBy("doc_id", "toxic", "share").agg(F.min("text").alias("text"))


def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(training_rows(docs, labels))
    return scored(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages",
    )
