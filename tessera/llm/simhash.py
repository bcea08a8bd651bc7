"""SimHash near-dedup by a binary trie self-join.

Fingerprints of three-word shingles are the keys of a binary trie.  Node pairs
are traversed together from the root; bits in which the two paths differ add up
and a pair is dropped once it exceeds the error budget.  A pair whose two nodes
hold few fingerprints is compared at once, any other is taken deeper, so that no
task ever meets an unbounded node.  Equal fingerprints are one class beforehand.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, utf8
from .components import SCHEMA, components, forest

SHINGLE, SEED, BUDGET = 3, 42, 2
#: Fingerprints in a node, on average, where the traversal starts; and at most in two nodes that are compared.
START, LEAF, STEP = 384, 2048, 4
_SLICE = 1 << 16


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[: -size])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])]


def _bits(hashes) -> np.ndarray:
    return np.unpackbits(np.asarray(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _majority(lists: list[list[int]]) -> np.ndarray:
    """Fingerprints of several documents, of which each has at least one hash."""
    sizes = np.array([len(x) for x in lists])
    if len(lists) == 1:
        flat = lists[0]
        counts = sum(_bits(flat[k : k + _SLICE]).sum(axis=0, dtype=np.int64) for k in range(0, len(flat), _SLICE))[None, :]
    else:
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        counts = np.add.reduceat(_bits(np.concatenate([np.asarray(x, dtype="<u8") for x in lists])), starts, axis=0, dtype=np.int32)
    ones = (counts * 2 > sizes[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view("<i8").reshape(-1)


def majority(lists: list) -> np.ndarray:
    """Signed 64-bit fingerprints of sequences of hashes; 0 for an empty one."""
    out = np.zeros(len(lists), dtype=np.int64)
    held: list[int] = []
    size = 0
    for i, hashes in enumerate(lists):
        if len(hashes):
            if size and size + len(hashes) > _SLICE:
                out[held] = _majority([lists[k] for k in held])
                held, size = [], 0
            held.append(i)
            size += len(hashes)
    if held:
        out[held] = _majority([lists[k] for k in held])
    return out


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Signed 64-bit fingerprints; 0 for a text without words."""
    out, held, size = [], [], 0
    for i, text in enumerate(texts):
        held.append(shingle_hashes(text))
        size += len(held[-1])
        if size > _SLICE or i + 1 == len(texts):
            out.append(majority(held))
            held, size = [], 0
    return np.concatenate([np.zeros(0, dtype=np.int64), *out])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = fingerprints(batch.column("body").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(fp, pa.int64())], names=["doc_id", "digest", "fp"])


def _prefix(depth: int):
    return F.shiftrightunsigned("fp", 64 - depth) if depth < 64 else F.col("fp")


def _masks(bits: int, budget: int) -> list[int]:
    one = [1 << i for i in range(bits)]
    out = [0]
    if budget >= 1:
        out += one
    if budget >= 2:
        out += [a | b for i, a in enumerate(one) for b in one[:i]]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _mask_column(bits: int, budget: int):
    return F.array(*[F.lit(m).cast("long") for m in _masks(bits, budget)])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(edges):
        src, dst = forest(np.concatenate([x for x, _ in edges]), np.concatenate([y for _, y in edges]))
        return pa.RecordBatch.from_pydict({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    edges, size = [], 0
    for batch in batches:
        left, right, same = batch.column("left"), batch.column("right"), batch.column("same").to_pylist()
        for i in range(batch.num_rows):
            x = left[i].values.to_numpy()
            y = x if same[i] else right[i].values.to_numpy()
            rows = max(1, (1 << 21) // len(y))
            for k in range(0, len(x), rows):
                near = np.bitwise_count(x[k : k + rows, None].view(np.uint64) ^ y[None, :].view(np.uint64)) <= BUDGET
                a, b = np.nonzero(near)
                a += k
                if same[i]:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    edges.append(forest(x[a], y[b]))
                    size += len(edges[-1][0])
        if size >= 100_000:
            yield out(edges)
            edges, size = [], 0
    if size:
        yield out(edges)


def trie_links(classes: DataFrame, staged: Staged) -> DataFrame:
    """Edges (src, dst) that join the fingerprints within the budget into components.

    ``classes``: distinct ``fp`` long.  Every link lies inside one component of
    the edges and every edge is a link or follows from links; a pair of nodes
    gives at most as many edges as it has fingerprints.
    """
    spark = classes.sparkSession
    count = classes.count()
    depth = min(60, max(2, math.ceil(math.log2(max(count, 1) / START))))
    nodes = classes.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n"))
    a = nodes.select(F.col("p").alias("a"), F.col("n").alias("na"))
    b = nodes.select(F.col("p").alias("b"), F.col("n").alias("nb"))
    pairs = a.withColumn("m", F.explode(_mask_column(depth, BUDGET))).withColumn("b", F.col("a").bitwiseXOR(F.col("m"))).where("a <= b")
    pairs = staged(pairs.drop("m").join(b, "b"), f"pairs{depth}")
    found = None
    while True:
        here = f"pairs{depth}"
        cost = F.when(F.col("a") == F.col("b"), F.col("na")).otherwise(F.col("na") + F.col("nb"))
        small = cost <= LEAF if depth < 64 else F.lit(True)
        leaf = pairs.where(small).select("a", "b")
        members = classes.select("fp", _prefix(depth).alias("p"))
        wanted = leaf.select(F.col("a").alias("p")).unionAll(leaf.select(F.col("b").alias("p"))).distinct()
        blocks = members.join(wanted, "p", "left_semi").groupBy("p").agg(F.collect_list("fp").alias("fps"))
        joined = (
            leaf.join(blocks.select(F.col("p").alias("a"), F.col("fps").alias("left")), "a")
            .join(blocks.select(F.col("p").alias("b"), F.col("fps").alias("right")), "b")
            .select("left", "right", (F.col("a") == F.col("b")).alias("same"))
        )
        edges = staged(joined.mapInArrow(_compare, SCHEMA), f"edges{depth}")
        found = edges if found is None else found.unionAll(edges)
        if depth >= 64 or not pairs.where(~small).take(1):
            staged.done(here)
            return found
        step = min(STEP, 64 - depth)
        deep = pairs.where(~small).select("a", "b", (F.lit(BUDGET) - F.bit_count(F.col("a").bitwiseXOR(F.col("b")))).alias("left"))
        depth += step
        nodes = classes.groupBy(_prefix(depth).alias("p")).agg(F.count("*").alias("n"))
        up = F.shiftrightunsigned("p", step)
        left = nodes.select(F.col("p").alias("ca"), F.col("n").alias("na"), up.alias("a"))
        right = nodes.select(F.col("p").alias("cb"), F.col("n").alias("nb"))
        mask = F.when(F.col("left") >= 2, _mask_column(step, 2)).when(F.col("left") == 1, _mask_column(step, 1)).otherwise(_mask_column(step, 0))
        low = F.col("ca").bitwiseAND(F.lit((1 << step) - 1)).bitwiseXOR(F.col("m"))
        pairs = deep.join(left, "a").withColumn("m", F.explode(mask)).withColumn("cb", F.shiftleft("b", step).bitwiseOR(low))
        pairs = pairs.where("a <> b or ca <= cb").join(right, "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "na", "nb")
        pairs = staged(pairs, f"pairs{depth}")
        staged.done(here)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """doc_id, digest, fp (signed long), component_id, group: one row per row of ``docs``.

    ``digest`` is any long that the caller wants kept for its rows (else 0);
    ``group`` is a fingerprint of the component, for components without an id.

    Rows whose fingerprints differ in at most two bits are linked; component_id
    is the smallest id reachable.  A null or empty text, or one without words,
    has fingerprint zero and is linked like any other.  Rows with a null id keep
    their row and never name a component unless it holds no other id (then
    null).  Repeated rows stay, in one component.  Other columns are ignored.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "simhash")
    kept = F.lit(0).cast("long") if digest is None else digest
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), kept.alias("digest"), utf8(text_col).alias("body"))
    rows = staged(rows.mapInArrow(_fingerprint_batches, "doc_id long, digest long, fp long"), "rows")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    edges = trie_links(classes.select("fp"), staged)
    linked = components(edges, staged)
    named = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = staged(named.join(lowest, "component").select("fp", "component_id", F.col("component").alias("group")), "named")
    staged.done("classes", *[x for x in staged.paths if x.startswith(("edges", "links"))])
    return rows.join(named, "fp").select("doc_id", "digest", "fp", "component_id", "group")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found_by: Callable[..., DataFrame] = simhash_components) -> DataFrame:
    """The rows of ``docs``, one for each component: the smallest id, among equal ids the smallest digest of the text.

    Of rows equal in both only one stays.  A component of null ids keeps one too.
    Columns may have any names: rows are carried as one struct.  An empty table
    gives an empty one.  ``found_by`` gives the components.
    """
    digest = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    spark = docs.sparkSession
    found = found_by(docs, id_col, text_col, digest)
    # among rows of a component that share its smallest id, and so its null if it has no other
    first = found.groupBy("component_id", "group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("x"))
    keyed = lambda i, d: [F.coalesce(i, F.lit(0)).alias("i"), i.isNull().alias("none"), d.alias("digest")]
    keys = ["i", "none", "digest"]
    chosen = Staged(spark, "simhash")(first.select(*keyed(F.col("x.doc_id"), F.col("x.digest"))).distinct(), "chosen")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *keyed(F.col(id_col).cast("long"), digest))
    return rows.join(chosen, keys, "left_semi").dropDuplicates(keys).select("row.*")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for all of ``documents``."""
    from .common import table

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
