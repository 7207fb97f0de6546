"""Exact vector search over stored cells.

Vectors are unit vectors, dealt into cells around the means of a bounded sample; a cell keeps its widest angle. For a
query no vector of a cell can be nearer than the angle to the mean less that width, so cells whose bound is below the
k-th score that the nearest cells gave are passed over, and the result is still that of comparing everything.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..sources.store import Store
from . import vectors

#: Bounds of the sample that the means are fitted to, and of the number of cells.
SAMPLE_ROWS, SAMPLE_BYTES, MOST_CELLS, ROUNDS = 20_000, 64 << 20, 1024, 8
#: Cells that every query visits first; more where these hold fewer than k vectors.
FIRST = 2
#: Scores are rounded to six places; bounds get as much more.
MARGIN = 2e-6
#: The cell of vectors without a direction.
NOWHERE = -1


def means(x: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit means of ``n`` groups of unit rows."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _unit(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows, and which have a direction and the right length."""
    out, norm = vectors.unit(column, width)
    ok = (norm > 0) & np.isfinite(norm)
    out[~ok] = 0
    return out, ok


class Cells:
    """A stored index of vectors by cells, in a store's tables."""

    def __init__(self, store: Store, name: str = "vectors"):
        self.store, self.name = store, name

    def build(self, rows: DataFrame) -> Cells:
        """Index ``rows`` (id, embedding), every one of them; null vectors and those of another length than most of the sample are left out."""
        rows = rows.where(F.col("embedding").isNotNull())
        total, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.mode(F.size("embedding")), F.lit(0))).first()
        most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // max(1, 8 * width)))
        sample = rows.select("embedding").where(F.size("embedding") == width).orderBy(F.xxhash64("embedding")).limit(most).toArrow().column("embedding") if width else []
        x, ok = _unit(sample, width)
        n = max(1, min(MOST_CELLS, int(total**0.5)))
        centres = means(x[ok], n) if ok.any() else np.zeros((0, width))
        kind = rows.schema["id"].dataType

        def deal(batches):
            for batch in batches:
                x, ok = _unit(batch.column("embedding"), width)
                cell, angle = np.full(len(x), NOWHERE), np.zeros(len(x))
                if len(centres) and len(x):
                    cos = x @ centres.T
                    best = cos.argmax(axis=1)
                    cell[ok], angle[ok] = best[ok], np.arccos(np.clip(cos[np.arange(len(x)), best], -1, 1))[ok]
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(to_arrow_type(kind)), batch.column("embedding"), pa.array(cell, pa.int32()), pa.array(angle)], ["id", "embedding", "cell", "angle"])

        own = rows.where(F.size("embedding") == width).select("id", "embedding")
        dealt = own.mapInArrow(deal, f"id {kind.simpleString()}, embedding {own.schema['embedding'].dataType.simpleString()}, cell int, angle double")

        def change(c):
            for part in ("members", "cells"):
                c.clear(f"{self.name}-{part}")
            c.append(f"{self.name}-members", dealt, by=["cell"], buckets=64, sort=["cell"])
            about = c.read(f"{self.name}-members").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("width"))
            at = self.store.spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(centres)], "cell int, mean array<double>")
            c.append(f"{self.name}-cells", about.join(at, "cell", "left"))

        self.store.commit(change)
        return self

    def _bounds(self, cells: list) -> tuple[np.ndarray, np.ndarray, int, Callable]:
        """Numbers and sizes of ``cells``, the vectors' length, and a function that gives the greatest cosine that a vector of each can have with each of some queries."""
        width = max((len(r["mean"]) for r in cells if r["mean"]), default=0)
        own = np.array([bool(r["mean"]) for r in cells], dtype=bool)
        centres, wide = np.array([r["mean"] for r in cells if r["mean"]], dtype=float).reshape(own.sum(), width), np.array([r["width"] for r in cells if r["mean"]])

        def bound(column) -> np.ndarray:
            x, ok = _unit(column, width)
            out = np.full((len(x), len(own)), 1 + MARGIN)  # of vectors without a direction too: zero with everything
            if width:
                out[:, own] = np.cos(np.clip(np.arccos(np.clip(x @ centres.T, -1, 1)) - wide, 0, np.pi)) + MARGIN
            out[~ok] = 1 + MARGIN
            return out

        return np.array([r["cell"] for r in cells], dtype=np.int32), np.array([r["n"] for r in cells], dtype=np.int64), width, bound

    def search(self, queries: DataFrame, k: int, first: int = FIRST, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
        """``vectors.top_k`` of ``queries`` (query_id, vector; ids once each) over all members, and the (query_id, cell, n) pairs that were compared for it.

        Cells are put together to groups of bounded size, large ones are split. A query goes once to each group that has a
        cell to compare, with the list of these; a vector goes once to each block of queries. The table of cells is at
        most MOST_CELLS rows. ``keep`` writes what is read more than once.
        """
        cells = sorted(self.store.read(f"{self.name}-cells").collect(), key=lambda r: r["cell"])
        number, size, width, bound = self._bounds(cells)
        most = min(vectors.VECTOR_ROWS, max(vectors.FEW_ROWS, -(-int(size.sum()) // self.store.spark.sparkContext.defaultParallelism)))
        groups, spans, held = [], [], most  # spans: first and last + 1 of a group's cells, and its first and last + 1 number
        for i, n in enumerate(size.tolist()):
            if held + n > most:
                start, held = spans[-1][3] if spans else 0, 0
                spans.append([i, i, start, start + max(1, -(-n // vectors.VECTOR_ROWS))])
            spans[-1][1], held = i + 1, held + n
            groups.append((int(number[i]), spans[-1][2], spans[-1][3] - spans[-1][2]))
        asked_n, asked_width = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        n_blocks, n_cells = max(1, -(-asked_n // (vectors.QUERY_ROWS * vectors.QUERY_TURNS))), len(cells)
        kinds = queries.schema["query_id"].dataType, queries.schema["vector"].dataType
        asked = f"query_id {kinds[0].simpleString()}, vector {kinds[1].simpleString()}"

        def lists(wanted: np.ndarray, of: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], wanted.sum(axis=1).cumsum()]), pa.int32()), pa.array(of[np.nonzero(wanted)[1]], pa.int32()))

        def begin(batches):
            for batch in (b.slice(i, 1000) for b in batches for i in range(0, len(b), 1000)):
                own = bound(batch.column("vector"))
                order = np.lexsort((np.broadcast_to(number, own.shape), -own), axis=1)
                there = np.arange(n_cells) < first
                early = np.zeros(own.shape, dtype=bool)
                np.put_along_axis(early, order, there | (size[order].cumsum(axis=1) - size[order] < k), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").cast(to_arrow_type(kinds[0])), batch.column("vector").cast(to_arrow_type(kinds[1])), lists(early, number)], ["query_id", "vector", "cells"])

        def rest(batches):
            for batch in (b.slice(i, 1000) for b in batches for i in range(0, len(b), 1000)):
                least = batch.column("least").to_numpy(zero_copy_only=False)
                wanted = (bound(batch.column("vector")) >= least[:, None]) | np.isnan(least)[:, None]
                seen = batch.column("cells")
                row = np.repeat(np.arange(len(batch)), seen.value_lengths().to_numpy(zero_copy_only=False))
                wanted[row, np.searchsorted(number, seen.flatten().to_numpy(zero_copy_only=False))] = False
                yield pa.RecordBatch.from_arrays([batch.column("query_id").cast(to_arrow_type(kinds[0])), batch.column("vector").cast(to_arrow_type(kinds[1])), lists(wanted, number), batch.column("least")], ["query_id", "vector", "cells", "least"])

        def deal(batches):
            for batch in batches:
                listed = batch.column("cells")
                row = np.repeat(np.arange(len(batch)), listed.value_lengths().to_numpy(zero_copy_only=False))
                wanted = np.zeros((len(batch), n_cells), dtype=bool)
                wanted[row, np.searchsorted(number, listed.flatten().to_numpy(zero_copy_only=False))] = True
                for lo, hi, start, end in spans:
                    own = np.nonzero(wanted[:, lo:hi].any(axis=1))[0]
                    if len(own):
                        part = batch.take(pa.array(own))
                        part = part.set_column(part.schema.get_field_index("cells"), "cells", lists(wanted[own, lo:hi], number[lo:hi]))
                        for i in range(start, end):
                            yield part.append_column("_part", pa.array(np.full(len(own), i), pa.int32()))

        def best(a: pa.Table, b: pa.Table) -> pa.Table:
            rows, cols, found = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
            if len(a) and len(b):
                b = b.sort_by([("cell", "ascending"), ("id", "ascending")])
                place = np.empty(len(b), dtype=np.int64)
                place[pc.sort_indices(b.column("id")).to_numpy()] = np.arange(len(b))
                cell, x, y = b.column("cell").to_numpy(), vectors.unit(a.column("vector"), width)[0], vectors.unit(b.column("embedding"), width)[0]
                own, begins = np.unique(cell, return_index=True)
                ends = [*begins[1:], len(cell)]
                listed, least = a.column("cells").combine_chunks(), pc.fill_null(a.column("least"), -np.inf).to_numpy()
                at = np.repeat(np.arange(len(a)), listed.value_lengths().to_numpy(zero_copy_only=False))
                asked_for = listed.flatten().to_numpy(zero_copy_only=False)
                for start in range(0, len(a), vectors.QUERY_ROWS):
                    z = x[start : start + vectors.QUERY_ROWS]
                    inside = (at >= start) & (at < start + len(z))
                    scores = np.full((len(z), len(b)), -np.inf)
                    for c, i, j in zip(own.tolist(), begins, ends):
                        need = at[inside & (asked_for == c)] - start
                        if len(need):
                            scores[need, i:j] = np.round(z[need] @ y[i:j].T, 6) + 0.0
                    row, col = vectors.ranked(scores, place, k, least[start : start + len(z)])
                    rows.append(row + start), cols.append(col), found.append(scores[row, col])
            return pa.table({"query_id": a.column("query_id").take(pa.array(np.concatenate(rows))), "id": b.column("id").take(pa.array(np.concatenate(cols))), "score": pa.array(np.concatenate(found))})

        members = self.store.read(f"{self.name}-members").select("id", "embedding", "cell").where(F.size("embedding") == asked_width)
        where = self.store.spark.createDataFrame(groups, "cell int, _start int, _parts int")
        members = members.withColumn("_at", F.monotonically_increasing_id()).join(F.broadcast(where), "cell")
        members = members.select("id", "embedding", "cell", (F.col("_start") + F.pmod("_at", "_parts")).cast("int").alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))

        def compared(wanted: DataFrame) -> DataFrame:
            """query_id, id and score of the k best members of the cells that each of ``wanted`` lists."""
            q = wanted.mapInArrow(deal, f"{asked}, cells array<int>, least double, _part int").withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int"))
            out = q.groupBy("_part", "_block").cogroup(members.groupBy("_part", "_block")).applyInArrow(best, f"query_id {kinds[0].simpleString()}, id {members.schema['id'].dataType.simpleString()}, score double")
            return out.withColumn("rank", rank).where(F.col("rank") <= k)

        near = keep(queries.select("query_id", "vector").mapInArrow(begin, f"{asked}, cells array<int>"))
        found = keep(compared(near.withColumn("least", F.lit(None).cast("double"))))
        least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        more = keep(near.join(least, "query_id", "left").select("query_id", "vector", "cells", "least").mapInArrow(rest, f"{asked}, cells array<int>, least double"))
        out = found.unionByName(compared(more)).drop("rank").withColumn("rank", rank).where(F.col("rank") <= k)
        sizes = self.store.spark.createDataFrame([(int(c), int(n)) for c, n in zip(number, size)], "cell int, n long")
        pairs = near.select("query_id", F.explode("cells").alias("cell")).unionByName(more.select("query_id", F.explode("cells").alias("cell")))
        return out, pairs.join(F.broadcast(sizes), "cell").select("query_id", "cell", "n")
