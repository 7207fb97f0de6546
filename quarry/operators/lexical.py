"""Full-text search: an inverted index as tables, kept in a store and updated, and BM25 over it."""

from __future__ import annotations

import string
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..sources.scan import last_of
from ..sources.store import Commit, Store, touched

# BM25's parameters and the floor of its inverse document frequency.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Scores (of a distinct question and a document) that one task sums, at most or so.
SUMS = 500_000
#: The numbers of documents of so many asked terms may be broadcast.
FEW_TERMS = 200_000
#: Postings that are put together to blocks at a time.
BLOCK_ROWS = 1_000_000


def _folds() -> tuple[str, str]:
    """Latin letters with marks, and the letters without."""
    pairs = ((chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
    own = [(x, y) for x, y in pairs if y.isascii() and y.isalpha()]
    return "".join(x for x, _ in own), "".join(y for _, y in own)


def fold(text: Column) -> Column:
    """``text`` with Latin letters in place of the same letters with diacritics."""
    return F.translate(F.regexp_replace(text, r"\p{Mn}", ""), *_folds())


def terms_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def asked_of(queries: DataFrame) -> DataFrame:
    """query_id and asked, a row for each distinct term of ``queries`` (query_id, terms)."""
    return queries.select("query_id", F.explode(F.array_distinct("terms")).alias("asked"))


def postings(docs: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """term, id, tf for ``docs`` (id, text); whole texts are indexed, however long. With ``queries``, only the terms that they ask for."""
    every = docs.select("id", F.explode(terms_of(F.col("text"))).alias("term"))
    if queries is not None:
        every = every.join(asked_of(queries).select(F.col("asked").alias("term")).distinct(), "term", "left_semi")
    return every.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    """id and n, the number of terms, which needs no list of them."""
    return docs.select("id", F.coalesce(F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}]+")), F.lit(0)).alias("n"))


def _blocks(term: pa.Array, doc: np.ndarray, tf: np.ndarray | None, ids: pa.Array) -> list[pa.Array]:
    """Columns term, ids and tfs: a row for each term, with its documents (places in ``ids``) in their order. Without ``tf`` each use of a term counts one."""
    coded = term.dictionary_encode()
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(1, len(ids)) + doc
    if tf is None:
        key, tf = np.unique(key, return_counts=True)
    else:
        order = np.argsort(key, kind="stable")
        key, tf = key[order], tf[order]
    code, doc = np.divmod(key, max(1, len(ids)))
    own, begin = np.unique(code, return_index=True)
    ends = pa.array(np.append(begin, len(code)), pa.int32())
    return [coded.dictionary.take(pa.array(own)), pa.ListArray.from_arrays(ends, ids.take(pa.array(doc))), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))]


def blocks(docs: DataFrame) -> DataFrame:
    """term, ids and tfs: what ``postings`` gives for ``docs`` (id, text; ids once each), some documents of a term in each row, and rows without a term with the numbers of all terms of some documents.

    The terms of a document are counted where it lies, so what is shuffled later is a row for each term of a batch of
    documents, not one for each use of it. The texts are read once, for postings and for lengths.
    """
    kind = docs.schema["id"].dataType

    def count(batches):
        for batch in batches:
            ids, terms = batch.column("id").cast(to_arrow_type(kind)), batch.column("terms")
            n = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids):
                yield pa.RecordBatch.from_arrays(_blocks(terms.flatten(), np.repeat(np.arange(len(ids)), n), None, ids), ["term", "ids", "tfs"])
                whole = pa.array([0, len(ids)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, pa.array(n))], ["term", "ids", "tfs"])

    return docs.select("id", terms_of(F.col("text")).alias("terms")).mapInArrow(count, f"term string, ids array<{kind.simpleString()}>, tfs array<bigint>")


def blocked(rows: DataFrame) -> DataFrame:
    """``rows`` (term, id, tf) in blocks; a null term is one too."""
    kind = rows.schema["id"].dataType

    def gather(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= BLOCK_ROWS:
                yield from out(held)
                held, n = [], 0
        yield from out(held)

    def out(held):
        t = pa.Table.from_batches(held) if held else []
        for part in (t.filter(pc.is_valid(t.column("term"))), t.filter(pc.is_null(t.column("term")))) if len(t) else ():
            if len(part):
                part = part.combine_chunks()
                term, ids = (part.column(x).combine_chunks() for x in ("term", "id"))
                lone = not term[0].is_valid
                term = pa.array(np.zeros(len(part)), pa.int8()).cast(pa.string()) if lone else term
                columns = _blocks(term, np.arange(len(part)), part.column("tf").to_numpy(), ids.cast(to_arrow_type(kind)))
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()) if lone else columns[0], *columns[1:]], ["term", "ids", "tfs"])

    return rows.select("term", "id", F.col("tf").cast("long").alias("tf")).mapInArrow(gather, f"term string, ids array<{kind.simpleString()}>, tfs array<bigint>")


def flat(rows: DataFrame) -> DataFrame:
    """Blocks as rows with ``id`` and ``tf``; other columns stay."""
    each = rows.withColumn("_each", F.explode(F.arrays_zip("ids", "tfs")))
    return each.select(*[c for c in rows.columns if c not in ("ids", "tfs")], F.col("_each.ids").alias("id"), F.col("_each.tfs").alias("tf"))


class Index:
    """A stored full-text index of immutable segments.

    A change appends a segment for its documents (blocks of postings in buckets by a hash of the term, a dictionary of
    terms in their order, lengths) and tombstones for what they replace: what is written follows the change, not the index. A
    posting counts if no younger tombstone has its id. ``merge`` makes one segment of all. ``folded`` drops diacritics,
    ``stemmed`` keeps a stem with each term, so that ``search`` can ask by stems.
    """

    def __init__(self, store: Store, name: str = "fts", folded: bool = False, stemmed: bool = False):
        self.store, self.name, self.folded, self.stemmed = store, name, folded, stemmed

    def write(self, docs: DataFrame, queries: DataFrame | None = None, order: str | None = None, unique: bool = False) -> Index:
        """The index of ``docs`` (id, text) alone. With ``queries`` it serves these alone: it has only the terms that they ask for.

        Of several rows with one id the last counts, as in ``upsert``; ``unique`` says that there are none, and spares
        the shuffle of the texts that finds them. If there are some all the same, their uses of a term are summed.
        """
        once = not unique or docs.groupBy("id").count().where("count > 1").isEmpty()
        return self._commit(lambda c: (self._clear(c), self._add(c, docs if unique else last_of(docs, ["id"], order), queries, once)))

    def upsert(self, docs: DataFrame, order: str | None = None, stream: str | None = None, batch_id: int | None = None) -> Index:
        """Documents take the place of those with their ids; of several with one id the last by ``order`` counts (without it, the greatest text)."""
        return self._commit(lambda c: (self._bury(c, docs.select("id")), self._add(c, last_of(docs, ["id"], order))), stream, batch_id)

    def delete(self, ids: DataFrame) -> Index:
        return self._commit(lambda c: self._bury(c, ids.select("id")))

    def merge(self) -> Index:
        """One segment of all that counts, without tombstones."""

        def change(c: Commit) -> None:
            live = self._live(flat(c.read(f"{self.name}-postings")), c.manifest)
            self._clear(c)  # the manifest's lists only: what was read above stays
            self._append(c, blocked(live))

        return self._commit(change)

    def segments(self) -> int:
        own = self.store.manifest()["tables"].get(f"{self.name}-lengths")
        return len(own["parts"].get("0", [])) if own else 0

    def _commit(self, change, stream: str | None = None, batch_id: int | None = None) -> Index:
        self.store.commit(change, stream, batch_id)
        return self

    def _clear(self, c: Commit) -> None:
        for part in ("postings", "terms", "lengths", "gone"):
            c.clear(f"{self.name}-{part}")

    def _bury(self, c: Commit, ids: DataFrame) -> None:
        c.append(f"{self.name}-gone", ids.distinct().withColumn("segment", F.lit(c.version)))

    def _add(self, c: Commit, docs: DataFrame, queries: DataFrame | None = None, unique: bool = True) -> None:
        docs = docs.select("id", (fold(F.col("text")) if self.folded else F.col("text")).alias("text"))
        if unique:
            rows = blocks(docs)
        else:
            rows = blocked(postings(docs).unionByName(lengths(docs).select(F.lit(None).cast("string").alias("term"), "id", F.col("n").alias("tf"))))
        if queries is not None:
            asked = asked_of(queries).select(F.col("asked").alias("_asked")).distinct().unionByName(self.store.spark.createDataFrame([(None,)], "_asked string"))
            rows = rows.join(asked, F.col("term").eqNullSafe(F.col("_asked")), "left_semi")
        self._append(c, rows)

    def _append(self, c: Commit, rows: DataFrame) -> None:
        """A segment of ``rows`` as ``blocks`` gives them."""
        here = F.lit(c.version).alias("segment")
        written = c.append(f"{self.name}-postings", rows.select("term", "ids", "tfs", here), by=["term"], sort=["term"])
        terms = written.where("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
        # Written once: dealing it by ranges reads it twice, the first time for their bounds.
        terms = c._staged(terms.withColumn("stem", stem("term") if self.stemmed else F.lit(None).cast("string")))
        c.append(f"{self.name}-terms", terms.select("term", "stem", "df", here).repartitionByRange("term"), sort=["term"])
        c.append(f"{self.name}-lengths", flat(written.where("term IS NULL")).select("id", F.col("tf").alias("n"), here))

    def _gone(self, manifest: dict) -> bool:
        """Whether there are tombstones."""
        return bool(manifest["tables"].get(f"{self.name}-gone", {}).get("parts"))

    def _live(self, rows: DataFrame, manifest: dict) -> DataFrame:
        """``rows`` (id, segment, ...) of documents that no younger commit has replaced or deleted."""
        if not self._gone(manifest):
            return rows
        upto = self.store.read(f"{self.name}-gone", manifest=manifest).groupBy("id").agg(F.max("segment").alias("_upto"))
        return rows.join(upto, "id", "left").where(F.col("_upto").isNull() | (F.col("segment") >= F.col("_upto"))).drop("_upto")

    def dictionary(self) -> DataFrame:
        """term, stem and df of every segment; terms whose documents are gone stay until ``merge``."""
        return self.store.read(f"{self.name}-terms")

    def search(self, queries: DataFrame, top_k: int | None = None, by: str = "word") -> DataFrame:
        """See ``score``. ``by``: "word", "prefix" (terms that begin with an asked one) or "stem" (terms of the asked terms' stems).

        Asked terms are first looked up in the dictionary; then only the buckets of postings that hold one are read.
        """
        manifest = self.store.manifest()
        asked = asked_of(queries)
        if self.folded:
            asked = asked.select("query_id", fold(F.col("asked")).alias("asked")).distinct()
        if by == "stem":
            asked = asked.select("query_id", stem("asked").alias("asked")).distinct()
        words = asked.select("asked").distinct()
        known = self.store.read(f"{self.name}-terms", manifest=manifest)
        if by == "word":
            pairs = words.withColumn("term", F.col("asked"))
        elif by == "stem":
            pairs = known.select(F.col("stem").alias("asked"), "term").join(words, "asked", "left_semi").distinct()
        else:
            # Equal beginnings of the lengths that occur, a few small numbers, are joined.
            sizes = sorted(r["n"] for r in words.select(F.length("asked").alias("n")).distinct().collect())
            starts = known.select("term").distinct().withColumn("asked", F.explode(F.array(*[F.substring("term", 1, n) for n in sizes])) if sizes else F.lit(None).cast("string"))
            pairs = starts.distinct().join(words, "asked", "left_semi").select("asked", "term")
        pairs = pairs.where("asked <> ''")
        own = manifest["tables"][f"{self.name}-postings"]
        found = self.store.read(f"{self.name}-postings", touched(pairs, ["term"], own["buckets"]), manifest).join(pairs, "term")
        df = None
        if by == "word" and not self._gone(manifest):  # then the dictionary's numbers are exact
            df = known.join(words, known["term"] == words["asked"]).groupBy("asked").agg(F.sum("df").alias("df"))
        length = self._live(self.store.read(f"{self.name}-lengths", manifest=manifest), manifest).select("id", "n")
        # Several terms of a document may answer to one asked, if not by word.
        return score(asked, flat(found).select("asked", "id", "tf", "segment"), length, top_k, df, by != "word", lambda x: self._live(x, manifest))


def score(asked: DataFrame, found: DataFrame, length: DataFrame, top_k: int | None = None, df: DataFrame | None = None, several: bool = False, live=None) -> DataFrame:
    """query_id, id and ``score`` (BM25, higher is better) of the best ``top_k`` per query; ties go to the smaller id.

    ``asked`` has query_id and asked, ``found`` the uses of what is asked (asked, id, tf), ``df`` the number of documents
    of each (asked, df), counted here if it is not known. ``several``: an id may have several rows of one asked, which are
    summed. ``live`` gives the rows of ``found`` that count. A document matches if any term does. Queries that ask for the
    same terms are scored once, so the rows here follow the distinct questions, however many ask them.
    """
    sets = asked.groupBy("query_id").agg(F.sort_array(F.collect_list("asked")).alias("set"))
    once = sets.groupBy("set").agg(F.min("query_id").alias("first"))
    askers = sets.join(once, "set").select("query_id", "first")
    asked = once.select("first", F.explode("set").alias("asked"))
    stats = length.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    # Dealt by document before all else: then neither what stands together in a document nor its sums, once queries have
    # multiplied the rows, need a shuffle of their own. The number of tasks follows the sums, as those of a task are in
    # memory; Spark alone sees only the bytes before them.
    n = max(length.sparkSession.sparkContext.defaultParallelism, -(-length.count() * once.count() // SUMS))
    found = found.repartition(n, "id")
    found = live(found) if live else found
    found = found.groupBy("asked", "id").agg(F.sum("tf").alias("tf")) if several else found.select("asked", "id", "tf")
    # What a term gives a document does not depend on the query, so it is computed once, before queries multiply the rows.
    df = found.groupBy("asked").agg(F.count("tf").alias("df")) if df is None else df  # tf is never null, but then both uses read the same shuffle
    few = asked.select("asked").distinct().count() <= FEW_TERMS
    own = found.join(length, "id").join(F.broadcast(df) if few else df, "asked").crossJoin(F.broadcast(stats))  # one row
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    own = own.select("asked", "id", part.alias("part"))
    own = own if few else own.repartition(n, "id")
    scored = asked.join(own, "asked").groupBy("first", "id").agg(F.round(F.sum("part"), 6).alias("score"))
    if top_k is not None:
        rank = F.row_number().over(Window.partitionBy("first").orderBy(F.desc("score"), "id"))
        scored = scored.withColumn("rank", rank).where(F.col("rank") <= top_k)
    return askers.join(scored, "first").select("query_id", *scored.drop("first").columns)


_KINDS = str.maketrans({c: "v" if c in "aeiou" else "y" if c == "y" else "c" for c in string.ascii_letters})


def _kinds(w: str) -> str:
    """c or v for each letter; y is a vowel behind a consonant."""
    kinds = w.translate(_KINDS)
    while (i := kinds.find("y")) >= 0:
        kinds = kinds[:i] + ("v" if i and kinds[i - 1] == "c" else "c") + kinds[i + 1 :]
    return kinds


def _measure(w: str) -> int:
    return _kinds(w).count("vc")


def _has_vowel(w: str) -> bool:
    return "v" in _kinds(w)


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c"


def _cvc(w: str) -> bool:
    return len(w) > 2 and _kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"


# The suffix tables of Porter (1980).
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


_LONGEST = [sorted(t, key=lambda x: -len(x[0])) for t in (_STEP2, _STEP3)], sorted([*_STEP4, "ion"], key=len, reverse=True)


def porter(w: str) -> str:
    """The stem of an English word; words with other letters stay as they are."""
    if len(w) <= 2 or not (w.isascii() and w.isalpha()):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in _LONGEST[0]:
        for end, to in table:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + to
                break
    for end in _LONGEST[1]:
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _cvc(w[:-1]):
            w = w[:-1]
    if _measure(w) > 1 and _double(w) and w.endswith("l"):
        w = w[:-1]
    return w


def _stems(s: pd.Series) -> pd.Series:
    return s.map(porter)


def stem(words: str) -> Column:
    return F.pandas_udf(_stems, "string")(words)
