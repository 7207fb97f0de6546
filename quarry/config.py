"""Default settings. All are plain parameters of the operators."""

from dataclasses import dataclass


# Limits that results depend on.
@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    overlap_tokens: int = 64
    min_tokens: int = 20
    large_node_tokens: int = 800


@dataclass(frozen=True)
class Retrieval:
    vector_top_k: int = 20
    fts_top_k: int = 20
    candidates: int = 50
    final_top_k: int = 10
    min_score: float = 0.3
    graph_depth: int = 2
    graph_nodes: int = 10
    compression: float = 0.6


@dataclass(frozen=True)
class Cache:
    threshold: float = 0.92
    ttl_seconds: int = 3600
    max_entries: int = 1000


CHUNKING, RETRIEVAL, CACHE = Chunking(), Retrieval(), Cache()
