"""Property graphs as a node table (id, kind, label, path) and an edge table (id, source_id, target_id, kind, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import RETRIEVAL

from ..functions.text import make_id

# Weights of the edge kinds.
CONTAINS, DEPENDS, IMPORTS = 1.0, 0.8, 0.8


def edges_of(pairs: DataFrame, kind: str, weight: float) -> DataFrame:
    """Edges for ``pairs`` (source_id, target_id)."""
    return pairs.select(make_id("edge", F.col("source_id"), F.col("target_id"), F.lit(kind)).alias("id"), "source_id", "target_id", F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))


def document_graph(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents (id, path, dependencies) and their chunks (chunk_id, document_id, title).

    A dependency's target may be no node: such edges stay, and drop out where edges join nodes.
    """
    node = lambda df, i, kind, label, path: df.select(F.col(i).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"), F.col(path).alias("path"))
    parts = chunks.join(docs.select(F.col("id").alias("document_id"), "path"), "document_id")
    nodes = node(docs, "id", "document", "path", "path").unionByName(node(parts, "chunk_id", "chunk", "title", "path"))
    deps = docs.select(F.col("id").alias("source_id"), F.explode("dependencies").alias("d")).select("source_id", make_id("doc", F.col("d")).alias("target_id")).distinct()
    edges = edges_of(chunks.select(F.col("document_id").alias("source_id"), F.col("chunk_id").alias("target_id")), "contains", CONTAINS)
    return nodes, edges.unionByName(edges_of(deps, "depends_on", DEPENDS))


def chunk_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of chunks (id, title, path, dependencies), the files that contain them and what they import; each once."""
    node = lambda i, kind, label, path: F.struct(i.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), path.alias("path"))
    file = F.concat(F.lit("file:"), "path")
    own = chunks.select(F.explode(F.array(node(F.col("id"), "chunk", F.col("title"), F.col("path")), node(file, "file", F.col("path"), F.col("path")))).alias("n"))
    deps = chunks.select("id", F.explode("dependencies").alias("d")).withColumn("to", F.concat(F.lit("dep:"), "d"))
    nodes = own.unionByName(deps.select(node(F.col("to"), "file", F.col("d"), F.col("d")).alias("n"))).select("n.*").dropDuplicates(["id"])
    contains = edges_of(chunks.select(file.alias("source_id"), F.col("id").alias("target_id")), "contains", CONTAINS)
    imports = edges_of(deps.select(F.col("id").alias("source_id"), F.col("to").alias("target_id")).distinct(), "imports", IMPORTS)
    return nodes, contains.unionByName(imports).dropDuplicates(["id"])


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k")


def edges_at(edges: DataFrame, ids: DataFrame, end: str, kinds: list[str] | None = None) -> DataFrame:
    """Edges whose ``end`` (source_id or target_id) is among ``ids`` (id)."""
    own = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    return own.join(ids.select(F.col("id").alias(end)), end, "left_semi").select(*edges.columns)


def neighbours(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, kinds: list[str] | None = None, max_nodes: int | None = None) -> DataFrame:
    """id and depth of the nodes within ``depth`` undirected steps of ``seeds`` (id); the first ``max_nodes`` by depth and id.

    Each step is one join of the last frontier with the edges. Ids without a node are walked through, but not returned.
    """
    own = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    both = own.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).unionByName(own.select(F.col("target_id").alias("u"), F.col("source_id").alias("v")))
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    last = seen
    for d in range(1, depth + 1):
        last = last.join(both, F.col("id") == F.col("u")).select(F.col("v").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(last)
    found = seen.join(nodes.select("id"), "id", "left_semi")
    return found.orderBy("depth", "id").limit(max_nodes) if max_nodes else found


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, depth: int, kinds: list[str] | None = None, max_nodes: int = RETRIEVAL.graph_nodes) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) and edges of a walk from ``seeds`` (id) that stops once it has admitted ``max_nodes`` nodes.

    Ids come by level, and in their order within a level. Each is walked from, and its edges are recorded, whether or
    not their other ends will be admitted; ids without a node are walked from but not counted. After the last admitted
    node nothing is walked. The driver sees one row for each level.
    """
    own = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    both = own.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).unionByName(own.select(F.col("target_id").alias("u"), F.col("source_id").alias("v")))
    level, seen = seeds.select("id").distinct(), seeds.select("id").where("false")
    admitted, walked, left = None, seeds.select("id").where("false"), max_nodes
    for d in range(depth + 1):
        real = level.join(nodes.select("id").distinct(), "id", "left_semi")
        last = real.orderBy("id").limit(left).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("id")).first()
        full = last["n"] >= left
        part = real.where(F.col("id") <= last["id"]) if full else real
        part = part.withColumn("depth", F.lit(d))
        admitted = part if admitted is None else admitted.unionByName(part)
        if d < depth:
            walked = walked.unionByName(level.where(F.col("id") <= last["id"]) if full else level)
        left -= last["n"]
        if full or d == depth:
            break
        seen = seen.unionByName(level)
        level = level.join(both, F.col("id") == F.col("u")).select(F.col("v").alias("id")).distinct().join(seen, "id", "left_anti")
    found = edges_at(own, walked, "source_id").unionByName(edges_at(own, walked, "target_id")).dropDuplicates(["id"])
    return admitted, found


def edges_around(edges: DataFrame, seeds: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """The edges that a walk of ``depth`` undirected steps from ``seeds`` (id) passes: those at any node that is fewer steps away, each once."""
    own = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    ends = own.select(F.col("source_id").alias("id")).unionByName(own.select(F.col("target_id").alias("id"))).distinct()
    inner = neighbours(ends, own, seeds, depth - 1).select("id") if depth else seeds.select("id").where("false")
    return edges_at(own, inner, "source_id").unionByName(edges_at(own, inner, "target_id")).dropDuplicates(["id"])


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_nodes: int = 5, keep=None) -> DataFrame:
    """source_id, target_id and path (array of ids) of the shortest directed path of at most ``max_nodes`` nodes; of equal ones the first in order.

    The walk starts once from each distinct source, however many pairs it has, and goes only to nodes from which some
    target is still within reach: it holds one path for each source and node of that kind, at most. ``keep`` writes a
    table and reads it back; what several steps read is then made once.
    """
    keep, steps = keep or (lambda df: df), max_nodes - 1
    pairs = keep(pairs.select("source_id", "target_id").distinct())
    out = keep(edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")))
    near = [pairs.select(F.col("target_id").alias("v")).distinct()]  # at place k: nodes at most k steps before a target
    for _ in range(1, steps):
        before = out.join(near[-1], "v", "left_semi").select(F.col("u").alias("v"))
        near.append(keep(near[-1].unionByName(before).distinct()))
    last = pairs.select("source_id").distinct().select("source_id", F.col("source_id").alias("end"), F.array("source_id").alias("path"))
    seen = last
    for left in reversed(range(steps)):
        step = last.join(out, F.col("end") == F.col("u")).join(near[left], "v", "left_semi").select("source_id", F.col("v").alias("end"), F.concat("path", F.array("v")).alias("path"))
        # Of the ways to the same node only the first can be part of an answer.
        step = step.join(seen.select("source_id", "end"), ["source_id", "end"], "left_anti").groupBy("source_id", "end").agg(F.min("path").alias("path"))
        last = keep(step)
        seen = seen.unionByName(last)
    return pairs.join(seen.withColumnRenamed("end", "target_id"), ["source_id", "target_id"]).select("source_id", "target_id", "path")
