"""Connected components of a distributed edge table.

Large-star and small-star rounds (Kiveris et al., 2014).  A star's centre may
have any number of neighbours: a round takes minima with partial aggregates and
joins them back, and gathers no neighbour list.  Before the rounds each task
contracts its own edges in blocks of fixed size, which keeps every component
and leaves at most one edge a node and block.  Where no more edges are left than
a block holds, one task contracts them all and no round is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged

BLOCK = 200_000
SCHEMA = "src long, dst long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) for the components of edges a-b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        src, dst = forest(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= BLOCK:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def components(edges: DataFrame, staged: Staged) -> DataFrame:
    """node, component (its smallest node) for every node that has an edge.

    ``edges``: src, dst long, in any direction; loops and repeats do no harm.
    Node values are compared as signed integers.
    """
    links = edges.where("src <> dst").select("src", "dst").mapInArrow(_contract, SCHEMA)
    links = staged(links, "links0")
    if links.count() <= BLOCK:
        whole = staged(links.coalesce(1).mapInArrow(_contract, SCHEMA), "links")
        staged.done("links0")
        return _named(whole)
    seen, k = None, 0
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = links.unionAll(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        large = large.where("src <> dst").distinct()
        k += 1
        large = staged(large, f"large{k}")
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(low, "src")
        small = small.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionAll(low.select("src", F.col("low").alias("dst")))
        links_new = staged(small.where("src <> dst").distinct(), f"links{k}")
        staged.done(f"large{k}", f"links{k - 1}")
        links = links_new
    return _named(links)


def _named(links: DataFrame) -> DataFrame:
    """Nodes with their roots, and the roots with themselves."""
    roots = links.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return links.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionAll(roots)
