"""Embedding near-dedup by an epsilon grid order join (Boehm et al., 2001).

Unit vectors with cosine c are sqrt(2 - 2c) apart, so links are pairs within an
epsilon.  Vectors are put in epsilon grid order: by label, length and the grid
cells of their leading principal coordinates.  The ordered sequence is cut into
blocks, blocks into intervals of sixteen, and so on; interval pairs are joined
recursively from the whole sequence down, and a pair whose bounding boxes are
provably further apart than epsilon is skipped.  Projections never lengthen a
distance, so no link is lost.  Pairs of blocks are then compared exactly.

Equal vectors are one class beforehand.  A pair of blocks reports, for each of
its vectors, a number of links, and a spanning forest of the links it found, not
the links themselves; so dense groups cost comparisons but no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, table, tasks_for
from .components import components, forest

COSINE, AXES, BLOCK, FAN = 0.98, 6, 256, 16
#: Added to the squared epsilon for rounding.
SLACK = 1e-6


def _arrays(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision and scaled, or None if it can link with nothing."""
    out: list[np.ndarray | None] = []
    for row in column:
        x = None
        if row.is_valid and len(row.values) and not row.values.null_count:
            x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = x if np.isfinite(x).all() and x.any() else None
        out.append(None if x is None else x / np.abs(x).max())
    return out


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("embedding")
        keys = []
        for row, x, label in zip(raw, _arrays(raw), batch.column("label").to_pylist()):
            ok = x is not None and label is not None
            keys.append(hashlib.blake2b(row.values.to_numpy().tobytes(), digest_size=16).digest() if ok else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), raw], names=["vec_id", "label", "key", "embedding"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each vector length: number, sum and second moments of the unit vectors, row by row."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for x in _arrays(batch.column("embedding")):
            d = len(x)
            if d not in held:
                held[d] = np.zeros((d + 1, d + 1))
            held[d] += _outer(np.append(x / np.linalg.norm(x), 1.0))
    for d, m in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], names=["dim", "i", "part"])


def _outer(x: np.ndarray) -> np.ndarray:
    return x[:, None] * x[None, :]


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for d, i, part in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(part)
            sums[d, i] = sums[d, i] + part if (d, i) in sums else part
    for (d, i), part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["dim", "i", "part"])


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal axes for each vector length, from all vectors; one small matrix a length reaches the driver."""
    n = tasks_for(classes.sparkSession)
    spec = "dim int, i int, part binary"
    rows = classes.select("embedding").mapInArrow(_moments, spec).repartition(n, "dim", "i").mapInArrow(_add, spec).collect()
    by: dict[int, dict[int, np.ndarray]] = {}
    for r in rows:
        by.setdefault(r.dim, {})[r.i] = np.frombuffer(r.part)
    out = {}
    for d, parts in by.items():
        m = np.stack([parts[i] for i in range(d + 1)])
        count, mean = m[d, d], m[:d, d] / m[d, d]
        _, vectors = np.linalg.eigh(m[:d, :d] / count - _outer(mean))
        axes = np.zeros((d, AXES))
        axes[:, : min(AXES, d)] = vectors[:, ::-1][:, :AXES]
        out[d] = axes
    return out


def _placer(axes: dict[int, np.ndarray], epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _arrays(batch.column("embedding"))
            points = np.stack([x / np.linalg.norm(x) @ axes[len(x)] for x in vectors]) if vectors else np.zeros((0, AXES))
            cells = np.floor(points / epsilon).astype(np.int32)
            columns = [batch.column(c) for c in ("label", "key", "low", "copies", "embedding")] + [pa.array([len(x) for x in vectors], pa.int32())]
            columns += [pa.array(cells[:, k]) for k in range(AXES)] + [pa.array(points[:, k]) for k in range(AXES)]
            names = ["label", "key", "low", "copies", "embedding", "dim"] + [f"c{k}" for k in range(AXES)] + [f"p{k}" for k in range(AXES)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


_BLOCK = pa.schema(
    [("part", pa.int32()), ("seq", pa.int32()), ("label", pa.int64()), ("dim", pa.int32()), ("vectors", pa.binary()), ("keys", pa.list_(pa.binary())), ("lows", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64()))]
    + [(f"{side}{k}", pa.float64()) for k in range(AXES) for side in ("lo", "hi")]
)
BLOCK_SPEC = "part int, seq int, label long, dim int, vectors binary, keys array<binary>, lows array<long>, copies array<long>, " + ", ".join(f"lo{k} double, hi{k} double" for k in range(AXES))


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    held, now = [], None

    def out():
        points = np.array([r[5] for r in held])
        bounds = [x for k in range(AXES) for x in (points[:, k].min(), points[:, k].max())]
        columns = [part, seq, *now, np.stack([r[4] for r in held]).tobytes(), [r[1] for r in held], [r[2] for r in held], [r[3] for r in held], *bounds]
        return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(columns, _BLOCK)], schema=_BLOCK)

    for batch in batches:
        points = np.stack([batch.column(f"p{k}").to_numpy() for k in range(AXES)], axis=1)
        rows = zip(*(batch.column(c).to_pylist() for c in ("label", "key", "low", "copies")), _arrays(batch.column("embedding")), points)
        for row in rows:
            group = row[0], len(row[4])
            if held and (group != now or len(held) == block):
                yield out()
                held, seq = [], seq + 1
            now = group
            held.append(row)
    if held:
        yield out()


def _near(epsilon2: float):
    """Whether two intervals share a label and their boxes are at most epsilon apart."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"a.lo{k}") - F.col(f"b.hi{k}"), F.col(f"b.lo{k}") - F.col(f"a.hi{k}")) for k in range(AXES)]
    return (F.col("a.first") <= F.col("b.last")) & (F.col("b.first") <= F.col("a.last")) & (sum((g * g for g in gaps), F.lit(0.0)) <= epsilon2)


def _comparer(cosine: float, block: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("links", pa.int64())])

    def unpack(vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(vectors).reshape(-1, dim)
        return x, np.sqrt(np.einsum("ij,ij->i", x, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, dim, va, vb, ca, cb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "dim", "va", "vb", "ca", "cb"))):
                (x, nx), (y, ny) = unpack(va, dim), unpack(vb, dim)
                link = (x @ y.T) / (nx[:, None] * ny[None, :]) >= cosine
                if a == b:
                    np.fill_diagonal(link, False)
                i, j = np.nonzero(link)
                if not len(i):
                    continue
                src, dst = forest(a * block + i, b * block + j)
                out = [(src, dst, np.zeros(len(src), np.int64))]
                sides = [(a, link @ np.array(cb, dtype=np.int64))] + ([(b, link.T @ np.array(ca, dtype=np.int64))] if a != b else [])
                for side, count in sides:
                    at = np.flatnonzero(count)
                    out.append((side * block + at, np.full(len(at), -1), count[at]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], schema=schema)

    return run


def embedding_components(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors``.

    Rows link if their labels are equal and not null, their vectors equally long
    and the cosine at least ``cosine``.  Null, empty and zero vectors and those
    with null or non-finite components have no links and are components of
    their own.  Repeated rows count as vectors, and link each other.  A null id
    names no component; such a row is not kept.
    """
    spark = vectors.sparkSession
    staged = Staged(spark, "grid")
    n = tasks_for(spark)
    epsilon2 = 2 - 2 * cosine + SLACK
    kind = vectors.schema[vec_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("embedding"))
    rows = staged(rows.mapInArrow(_prepare, f"vec_id long, label long, key binary, embedding {kind}"), "rows")
    classes = rows.where("key is not null").groupBy("label", "key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = staged(classes, "classes")
    axes = principal_axes(classes)
    names = [f"c{k}" for k in range(AXES)]
    spec = f"label long, key binary, low long, copies long, embedding {kind}, dim int, " + ", ".join([f"{c} int" for c in names] + [f"p{k} double" for k in range(AXES)])
    placed = staged(classes.mapInArrow(_placer(axes, math.sqrt(epsilon2)), spec), "placed")
    order = ["label", "dim", *names, "key"]
    blocks = staged(placed.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lambda batches: _blocks(batches, block), BLOCK_SPEC), "blocks")

    # dense numbers along the sequence; one row for each partition reaches the driver
    offset, offsets = 0, []
    for r in sorted(blocks.groupBy("part").agg(F.count("*").alias("n")).collect()):
        offsets.append((r.part, offset))
        offset += r.n
    numbers = spark.createDataFrame(offsets, "part int, offset long")
    blocks = staged(blocks.join(F.broadcast(numbers), "part").withColumn("node", F.col("offset") + F.col("seq")), "numbered")

    sides = [f"{side}{k}" for k in range(AXES) for side in ("lo", "hi")]
    level = blocks.select("node", F.col("label").alias("first"), F.col("label").alias("last"), *sides)
    levels, count = [level], offset
    while count > 1:
        up = [F.min("first").alias("first"), F.max("last").alias("last")] + [(F.min(s) if s[:2] == "lo" else F.max(s)).alias(s) for s in sides]
        level = staged(levels[-1].groupBy((F.col("node") / FAN).cast("long").alias("node")).agg(*up), f"level{len(levels)}")
        levels.append(level)
        count = -(-count // FAN)
    pairs = spark.createDataFrame([(0, 0)], "x long, y long")
    for k, level in list(enumerate(levels))[-2::-1] if len(levels) > 1 else []:
        child = level.withColumn("up", (F.col("node") / FAN).cast("long"))
        joined = pairs.join(child.alias("a"), F.col("x") == F.col("a.up")).join(child.alias("b"), F.col("y") == F.col("b.up"))
        pairs = joined.where((F.col("a.node") <= F.col("b.node")) & _near(epsilon2)).select(F.col("a.node").alias("x"), F.col("b.node").alias("y"))
        pairs = staged(pairs, f"pairs{k}")
    side = lambda end, v: blocks.select(F.col("node").alias(end), F.col("label").alias(f"label{v}"), F.col("dim").alias(f"dim{v}"), F.col("vectors").alias(f"v{v}"), F.col("copies").alias(f"c{v}"))
    met = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y").where("labela = labelb and dima = dimb")
    met = met.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("dima").alias("dim"), "va", "vb", "ca", "cb")
    found = staged(met.mapInArrow(_comparer(cosine, block), "src long, dst long, links long"), "found")

    linked = components(found.where("dst >= 0").select("src", "dst"), staged)
    counts = found.where("dst < 0").groupBy(F.col("src").alias("node")).agg(F.sum("links").alias("links"))
    members = blocks.select("node", F.col("label").alias("its"), F.posexplode(F.arrays_zip("keys", "lows", "copies")).alias("i", "x"))
    members = members.select((F.col("node") * block + F.col("i")).alias("node"), "its", F.col("x.keys").alias("its_key"), F.col("x.lows").alias("low"), F.col("x.copies").alias("copies"))
    members = members.join(counts, "node", "left").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = members.groupBy("component").agg(F.min("low").alias("component_id"))
    members = members.join(lowest, "component").select("its", "its_key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    members = staged(members, "members")
    staged.done(*[x for x in staged.paths if x not in ("rows", "members")])
    same = (F.col("label") == F.col("its")) & (F.col("key") == F.col("its_key"))
    out = rows.select("vec_id", "label", "key").join(members, same, "left")
    component = F.when(F.col("its_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for all of ``embeddings``."""
    return embedding_components(table(spark, sf_dir, "embeddings"))
