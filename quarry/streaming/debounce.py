"""Change feeds: the last event of each burst, in batch and as a stream, and applying it to a stored table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..sources.scan import Snapshots, last_of
from ..sources.store import Commit, Store


def debounce(events: DataFrame, gap_ms: int) -> DataFrame:
    """Events (key, kind, ts timestamp, event_id) that no other of their key follows within ``gap_ms``."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    following = F.lead("ts").over(w)
    wait = F.unix_millis(following) - F.unix_millis("ts")
    return events.withColumn("_wait", wait).where(F.col("_wait").isNull() | (F.col("_wait") > gap_ms)).drop("_wait")


def debounce_stream(events: DataFrame, gap_ms: int, delay: str = "10 minutes") -> DataFrame:
    """The same on a stream, by event time: a key's last event comes out once the watermark has passed it by ``gap_ms``."""

    def step(key, batches, state: GroupState):
        last = list(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((key[0], last[0], last[1], last[2]))
            state.remove()
            last = None
        else:
            rows = sorted((r.ts.value // 1_000_000, r.event_id, r.kind) for b in batches for r in b.itertuples(index=False))
            for ts, event_id, kind in rows:
                if last is not None and ts - last[1] > gap_ms:
                    out.append((key[0], last[0], last[1], last[2]))
                if last is None or (ts, event_id) >= (last[1], last[2]):
                    last = [kind, ts, event_id]
            if last is not None:
                state.update(tuple(last))
                state.setTimeoutTimestamp(max(last[1] + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "kind", "ts_ms", "event_id"])

    return events.withWatermark("ts", delay).groupBy("key").applyInPandasWithState(
        step, "key long, kind string, ts_ms long, event_id long", "kind string, ts_ms long, event_id long", "append", GroupStateTimeout.EventTimeTimeout,
    )


def debounce_arrivals(events: DataFrame, gap_ms: int) -> DataFrame:
    """The same on a stream by the clock: a key's last event (by ts and event_id) comes out ``gap_ms`` after the last arrival.

    Each arrival puts the key's timer back, as a watcher does; events need no order and no watermark.
    """

    def step(key, batches, state: GroupState):
        last = tuple(state.get) if state.exists else None
        out = []
        if state.hasTimedOut:
            out.append((key[0], last[0], last[1], last[2]))
            state.remove()
        else:
            for b in batches:
                for r in b.itertuples(index=False):
                    own = (r.kind, r.ts.value // 1_000_000, r.event_id)
                    if last is None or own[1:] >= last[1:]:
                        last = own
            state.update(last)
            state.setTimeoutDuration(gap_ms)
        yield pd.DataFrame(out, columns=["key", "kind", "ts_ms", "event_id"])

    kind = events.schema["key"].dataType.simpleString()
    return events.groupBy("key").applyInPandasWithState(
        step, f"key {kind}, kind string, ts_ms long, event_id long", "kind string, ts_ms long, event_id long", "append", GroupStateTimeout.ProcessingTimeTimeout,
    )


def apply_changes(store: Snapshots, name: str, key: str = "path", order: str | None = None):
    """A ``foreachBatch`` function: changed rows replace those with their key, rows of kind ``unlink`` take them away.

    Of several rows with one key in a batch the last by ``order`` counts (see ``last_of``), be it a change or not.

    A batch that is delivered twice leaves the same table.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch = last_of(batch, [key], order).persist()
        changed = batch.where("kind <> 'unlink'")
        stored = store.read(name)
        left = changed if stored is None else stored.join(batch.select(key), key, "left_anti").unionByName(changed.select(*stored.columns))
        store.write(name, left)
        store.prune(name)
        batch.unpersist()

    return write


def apply_to(store: Store, stream: str, name: str, keys: list[str], order: str, also=None):
    """A ``foreachBatch`` function over a ``Store``: changed rows replace those with their keys, rows of kind ``unlink`` take them away.

    Of several rows with one key in a batch the last by ``order`` counts, be it a change or not. Only the buckets that
    the batch touches are written, and the batch's number is published with them, so a batch that comes again changes
    nothing. ``also`` (of the commit, changed rows and keys that went) may change other tables in the same commit.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        def change(c: Commit) -> None:
            last = c._staged(last_of(batch, keys, order))
            changed, gone = last.where("kind <> 'unlink'"), last.where("kind = 'unlink'").select(*keys)
            c.upsert(name, changed, keys, order)
            c.delete(name, gone)
            if also:
                also(c, changed, gone)

        store.commit(change, stream, batch_id)

    return write
