"""Exact dedup of incoming batches against an immutable snapshot.

The snapshot's distinct digests are stored in buckets, each with a static binary fuse filter, once; every batch reads
this index. A batch is first grouped by itself, its distinct digests are screened bucket by bucket, and only those that a filter lets through join the
snapshot's exact buckets. Before two rows count as copies, their bytes are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse
from .common import WS, crc_of, materialize, scratch, table

KEYS_PER_BUCKET = 20_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _grouped(rows: DataFrame) -> DataFrame:
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))
    return rows.groupBy("digest").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))


def _key(digest: Column) -> Column:
    """The first 64 bits of a digest, as a signed long."""
    return F.conv(F.substring(F.rpad(digest, 64, "0"), 1, 16), 16, -10).cast("long")


def _unsigned(keys: pd.Series) -> np.ndarray:
    return keys.to_numpy().astype(np.int64).view(np.uint64)


def build_filters(groups: DataFrame) -> DataFrame:
    """A filter for each bucket of distinct digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, span, cells = fuse.build(_unsigned(pdf["key"]))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [seed], "segment": [segment], "span": [span], "cells": [cells]})

    return groups.select("bucket", _key(F.col("digest")).alias("key")).groupBy("bucket").applyInPandas(build, "bucket long, seed int, segment int, span long, cells binary")


def screened(groups: DataFrame, filters: DataFrame) -> DataFrame:
    """``groups`` with ``maybe``: false where the snapshot surely lacks the digest."""

    def screen(batch: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(batch), dtype=bool)
        if len(own) and len(batch):
            f = own.iloc[0]
            hit = fuse.contains(_unsigned(batch["key"]), int(f["seed"]), int(f["segment"]), int(f["span"]), f["cells"])
        return pd.DataFrame({"digest": batch["digest"], "maybe": hit})

    marks = groups.select("bucket", "digest", _key(F.col("digest")).alias("key")).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(screen, "digest string, maybe boolean")
    return groups.join(marks, "digest")


@dataclass(frozen=True)
class Index:
    """What is stored of a snapshot: its distinct digests in buckets (digest, first, n, bucket) and a filter for each bucket."""

    digests: DataFrame
    filters: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.rpad("digest", 64, "0"), 33, 12), 16, 10).cast("long"), F.lit(buckets)).alias("bucket")


def build_index(rows: DataFrame) -> Index:
    """The stored index of a snapshot's ``rows`` (rid, doc_id, digest). It is written once and never changes."""
    groups = materialize(_grouped(rows), "snapshot")
    buckets = max(16, -(-groups.count() // KEYS_PER_BUCKET))
    groups = groups.select("*", _bucket(buckets))
    return Index(groups, materialize(build_filters(groups), "filters"), buckets)


def screen(index: Index, rows: DataFrame) -> DataFrame:
    """The distinct digests of a batch's ``rows`` with ``maybe``: false where the snapshot surely lacks it. Only the stored filters are read."""
    return materialize(screened(_grouped(rows).select("*", _bucket(index.buckets)), index.filters).drop("bucket"), "screened")


def exact_dedup(snapshot: DataFrame, incoming: DataFrame | list[DataFrame], digest=sha256) -> DataFrame:
    """One row for each row of both inputs (``doc_id``, ``text``): doc_id, keep_id, group_size, kept, text_sha256, incoming.

    A null text counts as empty, and all empty texts are copies of each other. Of equal texts the row with the
    smallest doc_id stays; null ids come last; of repeated rows with that id, exactly one stays. Empty tables on
    either side are fine. Other columns are not looked at. ``incoming`` may be several batches: each is screened by the
    same stored index.
    """
    with scratch() as keep:
        return _deduped(snapshot, incoming if isinstance(incoming, list) else [incoming], digest, keep)


def _deduped(snapshot: DataFrame, incoming: list[DataFrame], digest, keep) -> DataFrame:
    every = None
    for batch, df in enumerate([snapshot, *incoming]):
        part = df.select(F.col("doc_id"), normalised(F.col("text")).alias("text"), F.lit(batch).alias("batch"))
        every = part if every is None else every.unionByName(part)
    every = every.withColumn("incoming", F.col("batch") > 0).withColumn("digest", digest(F.col("text")))
    rows = materialize(every.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "batch", "incoming", "digest"), "digests")
    index = build_index(rows.where("batch = 0"))
    old = index.digests

    # Each batch by itself and through the filters; what they let through is joined with the exact buckets.
    new = None
    for batch in range(1, len(incoming) + 1):
        own = screen(index, rows.where(F.col("batch") == batch))
        new = own if new is None else new.unionByName(own)
    if len(incoming) > 1:
        new = materialize(new.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.max("maybe").alias("maybe")), "batches")
    theirs = new.where("maybe").select("digest", F.col("first").alias("first2"), F.col("n").alias("n2"))
    merged = old.drop("bucket").join(theirs, "digest", "left").select(
        "digest", F.least("first", F.coalesce("first2", "first")).alias("first"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"),
    )
    alone = new.where("maybe").select("digest", "first", "n").join(old.select("digest"), "digest", "left_anti")
    groups = merged.unionByName(new.where("NOT maybe").select("digest", "first", "n")).unionByName(alone)
    groups = materialize(groups, "groups")

    # Byte checks: the texts of all rows whose digest has company, against the text of the row that stays.
    company = groups.where("n > 1").select("digest", "first")
    texts = materialize(every.select("doc_id", "digest", "text").join(company, "digest"), "company")
    model = texts.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).groupBy("digest").agg(F.min("text").alias("model"))
    model = materialize(model, "models")  # the join with it reads two written tables, so that Spark can split a hot digest
    odd = materialize(texts.join(model, "digest").where("text <> model").select("digest"), "odd")
    out = rows.join(groups.join(odd, "digest", "left_anti"), "digest").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("first.rid")).alias("kept"), "digest", "incoming",
    )
    keep(rows, groups, odd)
    if not odd.isEmpty():  # a digest that stands for several texts: its rows are grouped by their bytes
        clash = every.join(odd, "digest", "left_semi").withColumn("rid", F.monotonically_increasing_id())
        clash = materialize(clash, "clash")
        keep(clash)
        own = clash.groupBy("digest", "text").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("n"))
        out = out.unionByName(clash.join(own, ["digest", "text"]).select(
            "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("first.rid")).alias("kept"), "digest", "incoming",
        ))
    return out.withColumnRenamed("digest", "text_sha256")


def op4_exact_dedup(spark, sf_dir):
    """All documents: half of them, by a hash of the id, play the snapshot and two quarters the batches that come one after the other."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = crc_of(F.col("doc_id")) % 4
    return exact_dedup(docs.where(part % 2 == 0), [docs.where(part == k) for k in (1, 3)]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, CAST(count(*) OVER (PARTITION BY t) AS BIGINT) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""
