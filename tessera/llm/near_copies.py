"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Every pair is found and every link is checked on the whole sets.  Texts of equal
sets are one class beforehand.

1. *SimHash.*  Fingerprints of the five-word sets go through the binary trie
   self-join of ``simhash``; its links are checked.
2. *Near.*  Classes with an equal key of three minima are compared with the
   next class of that key, and with that one of it whose own keys are shared most
   often: the text that a large group was copied from, to which all its copies are
   similar, though they need not be to each other.  So large groups of near copies
   are joined by a constant number of comparisons for each class.
3. *Rest.*  What two bits of a fingerprint cannot reach is found exactly: a pair
   as similar as that has a common shingle in both its prefixes, the first fifth
   of each set in one order of all shingles.  Classes that share shingles there
   and are not joined yet are compared, unless their sizes, the number of the
   shared shingles and the places of the last of them rule them out, or bitmaps
   of the sets, in which each shingle turns one bit: sets differ in at least as
   many shingles as their bitmaps in bits.  A first look
   compares 16 bits of each shingle, which only ever makes sets more alike, and
   what passes is compared in full.  The order puts common shingles, as a sample
   of the classes has them, last; any order finds all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, slices, tasks_for, utf8
from .components import SCHEMA, components
from .simhash import majority, shingle_hashes, trie_links

#: Words of a shingle; the similarity is PART / WHOLE.
SHINGLE, PART, WHOLE = 5, 4, 5
KEYS, MINIMA = 8, 3
#: Common shingles are those of at least so many texts of one in SAMPLE; so many of them go last.
SAMPLE, COMMON, MOST_COMMON = 16, 3, 100_000
_TIMES = np.random.default_rng(11).integers(0, 1 << 63, KEYS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Longs of a set's bitmap.
BITMAP = 8
_BITS = [f"b{k}" for k in range(BITMAP)]
_ROWS = "doc_id long, digest long, own long, node long, fp long, keys array<bigint>, " + ", ".join(f"{b} long" for b in _BITS)
_PAIR = "src long, dst long, at_src long, at_dst long, n long, n_src long, n_dst long"


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})


def _set(text: bytes) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), dtype="<u8"))


def _node(x: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(x.tobytes())).astype(np.int64)) if len(x) else 0


def _keys(x: np.ndarray) -> list[int]:
    if not len(x):
        return []
    low = np.array([(x * t).min() for t in _TIMES]).reshape(KEYS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(low)], dtype=np.uint64).view(np.int64).tolist()


def _bitmap(x: np.ndarray) -> np.ndarray:
    """One bit for each value of the hashes' upper bits, set if an odd number of shingles have it."""
    odd = np.bincount((x >> np.uint64(32)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = [_set(x) for x in batch.column("body").to_pylist()]
        made = {"node": (map(_node, sets), pa.int64()), "fp": (majority(sets), pa.int64()), "keys": (map(_keys, sets), pa.list_(pa.int64()))}
        columns = [batch.column(c) for c in ("doc_id", "digest", "own")] + [pa.array(list(v), t) for v, t in made.values()]
        bits = np.stack([_bitmap(x) for x in sets])
        columns += [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(BITMAP)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "own", *made, *_BITS])


def _sets(kind: str):
    """A text's node and its set, whole or (for a first look) the low bits of each shingle's hash, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [_set(x) for x in batch.column("body").to_pylist()]
            packed = [np.sort(x.astype(kind)).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.int64()), pa.array(packed, pa.binary())], names=["node", "shingles"])

    return run


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for text in batch.column("body").to_pylist():
        if len(x := _set(text)):
            yield _node(x), x


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of key and node: each node with the one before it of its key."""
    key = last = None
    for batch in batches:
        out = []
        for k, node in zip(batch.column("key").to_pylist(), batch.column("node").to_pylist()):
            if k == key and node != last:
                out.append((last, node))
            key, last = k, node
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        yield _batch({"src": pairs[:, 0], "dst": pairs[:, 1]})


def _prefixes(common: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            token, node, size, at = [np.zeros(0, np.uint64)], [], [], [np.zeros(0, np.int64)]
            for k, x in _each(batch):
                most = len(x) - -(-PART * len(x) // WHOLE) + 1
                if len(common):
                    late = common[np.minimum(np.searchsorted(common, x), len(common) - 1)] == x
                    x = np.concatenate([x[~late], x[late]])
                token.append(x[:most])
                at.append(np.arange(most))
                node += [k] * most
                size += [len(x)] * most
            yield _batch({"token": np.concatenate(token).view(np.int64), "node": np.array(node, dtype=np.int64), "size": np.array(size, dtype=np.int64), "at": np.concatenate(at)})

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of the rows of each token, from rows in order of token."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(x) for x in zip(rest, columns)]
        if not len(columns[0]):
            continue
        edges = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist()]
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                yield [c[a:b] for c in columns]
        rest = [c[edges[-1] :] for c in columns]
    if rest is not None and len(rest[0]) > 1:
        yield rest


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tokens that two nodes have, a node once; tokens of the same nodes have the same mark."""
    held, size = [], 0

    def out():
        return _batch(dict(zip(["token", "node", "size", "at", "mark"], map(np.concatenate, zip(*held)))))

    for group in _groups(batches):
        _, one = np.unique(group[1], return_index=True)
        if len(one) > 1:
            group = [c[one] for c in group]
            held.append([*group, np.full(len(one), np.uint64(xxhash.xxh64_intdigest(group[1].tobytes())).astype(np.int64))])
            size += len(one)
        if size >= 100_000:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def _same_nodes(groups: Iterator[list[np.ndarray]]) -> Iterator[tuple]:
    """Consecutive tokens of the same nodes as one: node, size, last place, component, number of the tokens, bitmap."""
    now: list | None = None
    for _, node, n, at, component, *bits in groups:
        order = np.argsort(node)
        node, at = node[order], at[order]
        if now is not None and np.array_equal(node, now[0]):
            now[2], now[4] = np.maximum(at, now[2]), now[4] + 1
            continue
        if now is not None:
            yield tuple(now)
        now = [node, n[order], at, component[order], 1, np.stack(bits, axis=1)[order]]
    if now is not None:
        yield tuple(now)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a token's nodes that are in two components and can be similar enough, the smaller first."""
    held, size = [], 0

    def out():
        """A row for each pair, with the number of its shared shingles and the last places of them."""
        src, dst, at_src, at_dst, n_src, n_dst, number = np.concatenate(held, axis=1)
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.concatenate([[True], (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]))
        last = [np.maximum.reduceat(x[order], first) for x in (at_src, at_dst)]
        return _batch({"src": src[first], "dst": dst[first], "at_src": last[0], "at_dst": last[1], "n": np.add.reduceat(number[order], first), "n_src": n_src[order][first], "n_dst": n_dst[order][first]})

    for node, n, at, component, shared, bits in _same_nodes(_groups(batches)):
        if (component == component[0]).all():
            continue
        order = np.lexsort((node, n))
        node, n, at, component, bits = node[order], n[order], at[order], component[order], bits[order]
        ends = np.searchsorted(n, n * WHOLE // PART, side="right")
        for i, end in enumerate(ends.tolist()):
            j = np.arange(i + 1, end)
            most = np.minimum(at[i], at[j]) + 1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1
            j = j[(component[j] != component[i]) & (most * (PART + WHOLE) >= PART * (n[i] + n[j]))]
            unlike = np.bitwise_count((bits[j] ^ bits[i]).view(np.uint64)).sum(axis=1, dtype=np.int64)
            j = j[unlike * (PART + WHOLE) <= (WHOLE - PART) * (n[i] + n[j])]
            if len(j):
                same = np.ones(len(j), dtype=np.int64)
                held.append(np.stack([same * node[i], node[j], same * at[i], at[j], same * n[i], n[j], same * shared]))
                size += len(j)
            if size >= 500_000:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def _common_values(x: np.ndarray, y: np.ndarray) -> int:
    """Of two sorted lists of values, how many are in both, repeats counted."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1], [True]]))
    value = both[edge[:-1]]
    in_x = np.searchsorted(x, value, side="right") - np.searchsorted(x, value)
    return int(np.minimum(in_x, np.diff(edge) - in_x).sum())


def _check(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                x, y = np.frombuffer(x, kind), np.frombuffer(y, kind)
                both = _common_values(x, y) if min(len(x), len(y)) * WHOLE >= max(len(x), len(y)) * PART else 0
                keep.append(both * WHOLE >= PART * (len(x) + len(y) - both))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _similar(pairs: DataFrame, rows: DataFrame, texts: DataFrame, kind: str = "<u8") -> DataFrame:
    """The pairs (src, dst) whose sets are similar enough; the sets of theirs are made from one text of each.

    With fewer bits of each shingle than all of them some pairs that are not pass as well, and none is lost.
    """
    wanted = pairs.select(F.col("src").alias("node")).unionAll(pairs.select(F.col("dst").alias("node"))).distinct()
    wanted = rows.groupBy("node").agg(F.min("own").alias("own")).join(wanted, "node", "left_semi").select("own").distinct()
    sets = texts.join(wanted, "own", "left_semi").dropDuplicates(["own"]).select("body").mapInArrow(_sets(kind), "node long, shingles binary")
    a, b = sets.toDF("src", "left"), sets.toDF("dst", "right")
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "left", "right").mapInArrow(_check(kind), SCHEMA)


def _common(texts: DataFrame) -> np.ndarray:
    """Shingles of many texts, as a sample of the texts has them, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch({"token": np.concatenate([np.zeros(0, "<u8"), *(x for _, x in _each(batch))]).view(np.int64)})

    some = texts.where(F.pmod("own", F.lit(SAMPLE)) == 0).select("body").mapInArrow(run, "token long")
    counts = some.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    found = [r.token for r in counts.orderBy(F.desc("n"), "token").limit(MOST_COMMON).collect()]
    return np.sort(np.array(found, dtype=np.int64).view(np.uint64))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """doc_id, digest, component_id, group: one row per row of ``docs``, as simhash.simhash_components has them.

    Rows are linked if their sets of shingles are similar enough; a text of at
    most five words is one shingle, and texts without words are linked.
    """
    spark = docs.sparkSession
    staged, n = Staged(spark, "near"), tasks_for(spark)
    kept = F.lit(0).cast("long") if digest is None else digest
    body = utf8(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), kept.alias("digest"), F.xxhash64(body).alias("own"), body.alias("body"))
    rows = staged(rows.mapInArrow(_rows, _ROWS), "rows")
    texts = docs.select(F.xxhash64(body).alias("own"), body.alias("body"))

    prints = rows.where("node <> 0").groupBy("fp").agg(F.min("node").alias("its"))
    prints = staged(prints, "prints")
    equal = rows.select("node", "fp").distinct().join(prints, "fp").where("node <> its").select(F.col("its").alias("src"), F.col("node").alias("dst"))
    trie = trie_links(prints.select("fp"), staged)
    for end in ("src", "dst"):
        trie = trie.join(prints.toDF(end, "its"), end).drop(end).withColumnRenamed("its", end)
    keys = rows.select(F.explode("keys").alias("key"), "node").distinct()
    often = keys.groupBy("key").agg(F.count("*").alias("uses")).where("uses > 1")
    keys = staged(keys.join(often, "key"), "keys")
    weights = keys.groupBy("node").agg(F.sum("uses").alias("weight"))
    hubs = keys.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    stars = keys.join(hubs, "key").where("node <> hub").select(F.least("node", "hub").alias("src"), F.greatest("node", "hub").alias("dst"))
    keys = keys.select("key", "node").repartition(n, "key").sortWithinPartitions("key", "node")
    near = keys.mapInArrow(_neighbours, SCHEMA).unionByName(stars).unionByName(equal).unionByName(trie)
    near = staged(near.distinct(), "near")
    staged.done(*[x for x in staged.paths if x.startswith(("edges", "prints", "keys"))])
    close = staged(_similar(near, rows, texts, "<u2"), "close", rows=256)
    staged.done("near")
    edges = staged(_similar(close, rows, texts), "edges_near", rows=128)
    staged.done("close")
    joined = staged(components(edges, staged), "joined")
    staged.done(*[x for x in staged.paths if x.startswith("links")])

    tokens = texts.select("body").mapInArrow(_prefixes(_common(texts)), "token long, node long, size long, at long")
    tokens = tokens.repartition(n, "token").sortWithinPartitions("token")
    shared = staged(tokens.mapInArrow(_shared, "token long, node long, size long, at long, mark long"), "shared")
    nodes = rows.select("node", *_BITS).dropDuplicates(["node"]).join(joined, "node", "left")
    nodes = nodes.select("node", F.coalesce("component", "node").alias("component"), *_BITS)
    shared = shared.join(nodes, "node").select("token", "node", "size", "at", "component", *_BITS, "mark")
    # tokens of the same nodes meet, in up to four tasks if they are many
    shared = shared.repartition(n, "mark", F.pmod("token", F.lit(4))).sortWithinPartitions("mark", "token")
    pairs = shared.drop("mark").mapInArrow(_pairs, _PAIR)
    pairs = pairs.groupBy("src", "dst", "n_src", "n_dst").agg(F.sum("n").alias("n"), F.max("at_src").alias("at_src"), F.max("at_dst").alias("at_dst"))
    most = F.col("n") + F.least(F.expr("n_src - 1 - at_src"), F.expr("n_dst - 1 - at_dst"))
    pairs = staged(pairs.where(most * (PART + WHOLE) >= PART * (F.col("n_src") + F.col("n_dst"))).select("src", "dst"), "pairs")
    staged.done("shared", "joined")
    close = staged(_similar(pairs, rows, texts, "<u2"), "close", rows=256)
    staged.done("pairs")
    more = staged(_similar(close, rows, texts), "edges_rest", rows=128)
    linked = components(edges.unionAll(more), staged)

    classes = rows.groupBy("node").agg(F.min("doc_id").alias("low"))
    named = classes.join(linked, "node", "left").select("node", "low", F.coalesce("component", "node").alias("group"))
    lowest = named.groupBy("group").agg(F.min("low").alias("component_id"))
    named = staged(named.join(lowest, "group").select("node", "component_id", "group"), "named")
    staged.done(*[x for x in staged.paths if x not in ("rows", "named")])
    return rows.select("doc_id", "digest", "node").join(named, "node").select("doc_id", "digest", "component_id", "group")
