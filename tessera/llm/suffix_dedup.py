"""Suffix-array dedup: which bytes lie in a long string that also starts elsewhere.

1. *Cut.*  Every start of a string of ``length`` bytes belongs to the anchor that
   the string itself names: of its 64-byte grams the one with the least hash.  Equal
   strings name the same gram at the same place, so a string whose anchor occurs
   once in the corpus cannot repeat.  Starts of one anchor are neighbours and form
   a *context*: the bytes from its first start to the end of its last string.
2. *Collapse.*  Contexts of anchors that occur once are dropped as proven unique.
   Equal contexts become one with a number of copies, before the shuffle.  A string
   reaches beyond its anchor by half of the rest on one side at least, so a context
   that shares neither that much to the left nor to the right with another one is
   done: its strings repeat if it has copies.
3. *Shards.*  The other contexts of an anchor go to one shard of bounded size, which
   builds a suffix array by Larsson-Sadakane refinement and takes the common
   prefixes of neighbours by Kasai's step: starts whose string has an equal in
   the shard, or whose context has copies, repeat.
4. *Merge.*  An anchor with too many contexts for a shard is spread over several.
   Each of them cuts the sorted list of its distinct strings by binary search at
   the borders of equal ranges, and one task merges a range of all its shards.
5. *Back.*  Repeated starts go to all places of their contexts, and each text
   gets its maximal removed runs.

The same five steps find passages of so many *words* (runs of anything but ASCII
white space): a word is then one unit of 32 bits, a hash of its bytes, and a text
the array of its words, a sixth as long.

Null is an empty text.  Texts are whole; copies of a text, repeated rows too, are
other places of its strings.  Ties in id or text make no difference, an empty
table gives no rows, and other columns may have any names: rows are carried as
one struct, so none of them meets a column made here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, slices, table, tasks_for, utf8
from .suffix_array import MOST, repeated

LENGTH, GRAM = 400, 64
#: Words of the shortest passage that repeats, for callers that count words; words of an anchor's gram.
PASSAGE, WORDS = 51, 8
#: Starts of a long text that are cut together; and context units of an anchor that one shard takes; bytes whose words are hashed together.
SEGMENT, SPREAD, PIECE = 400_000, 1 << 19, 1 << 20

_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TIMES = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 20) - 1)

_CUT = pa.schema([("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32()), ("len", pa.int32()), ("left", pa.int64()), ("right", pa.int64())])
PLACES = "anchor long, d1 long, d2 long, doc_id long, k1 long, k2 long, at int, len int, left long, right long"
_FOUND = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("spans", pa.binary()), ("anchor", pa.int64()), ("bucket", pa.int32()), ("strings", pa.binary())])
FOUND = "d1 long, d2 long, spans binary, anchor long, bucket int, strings binary"
_STRING = np.dtype([("string", "V16"), ("copies", "<i4"), ("d1", "<i8"), ("d2", "<i8"), ("at", "<i4")])


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def gram_of(length: int, unit: int) -> int:
    """Units of an anchor's gram: a power of two, at most a quarter of a string."""
    return min(GRAM if unit == 1 else WORDS, 1 << max(0, length.bit_length() - 3))


def anchors(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of the bytes or words, and for each start the place of its anchor."""
    h, k = (_TABLE[text], 1) if text.itemsize == 1 else (_mixed(text.astype(np.uint64) * _TIMES[6]), 1)
    gram = gram_of(length, text.itemsize)
    for times in _TIMES[: gram.bit_length() - 1]:
        h = h[:-k] * times + h[k:]
        k *= 2
    h ^= h >> np.uint64(29)
    h *= _TIMES[5]
    h ^= h >> np.uint64(32)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    wide, k = length - gram + 1, 1
    while 2 * k <= wide:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    if wide > k:
        low = np.minimum(low[: k - wide], low[wide - k :])
    return h, (low & _PLACE).astype(np.int64)


def _beside(h: np.ndarray, first: np.ndarray, last: np.ndarray, own: np.ndarray, length: int, gram: int) -> list[np.ma.MaskedArray]:
    """For each context a hash of its anchor and what half of a string holds on its left, and one for its right.

    Masked where none of the context's strings reaches as far.
    """
    side = -(-(length - gram) // 2)
    out = []
    for sign, there in ((-1, own - first >= side), (1, last + length - own - gram >= side)):
        at, x = own[there], None
        for step in [*range(0, side, gram), side]:
            x = h[at + sign * step] if x is None else x * _TIMES[6] + h[at + sign * step]
        full = np.zeros(len(own), dtype=np.uint64)
        full[there] = _mixed(x * _TIMES[3] + np.uint64(sign == 1))
        out.append(np.ma.MaskedArray(full.view(np.int64), ~there))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    for times in _TIMES[:2]:
        x ^= x >> np.uint64(31)
        x *= times
    return x ^ (x >> np.uint64(33))


def word_places(body: bytes) -> np.ndarray:
    """Pairs (from, to) of the bytes of each word."""
    space = np.ones(len(body) + 2, dtype=bool)
    space[1:-1] = _SPACE[np.frombuffer(body, dtype=np.uint8)]
    return np.flatnonzero(space[1:] != space[:-1]).reshape(-1, 2)


def word_codes(body: bytes) -> np.ndarray:
    """A 32-bit hash of each word, from sums of the bytes' numbers times powers."""
    found, at = [], 0
    while at < len(body):
        end = at + PIECE
        if end < len(body):  # a piece ends before white space, or where its last word does
            text = np.frombuffer(body, dtype=np.uint8)
            back = np.flatnonzero(_SPACE[text[at:end]])
            end = at + int(back[-1]) if len(back) else end
            while end < len(body) and not _SPACE[body[end]]:
                end += 1
        piece = body[at:end]
        places = word_places(piece)
        if len(piece) > len(_POWER):
            power, back = _powers(len(piece))
        else:
            power, back = _POWER, _BACK
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[np.frombuffer(piece, dtype=np.uint8)] * power[: len(piece)], out=sums[1:])
        code = (sums[places[:, 1]] - sums[places[:, 0]]) * back[places[:, 0]]
        found.append((_mixed(code) >> np.uint64(32)).astype("<u4"))
        at = end + 1 if end == at else end
    return np.concatenate(found) if found else np.zeros(0, "<u4")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64."""
    odd = int(_TIMES[7])
    out = []
    for x in (odd, pow(odd, -1, 1 << 64)):
        factors = np.full(n, x, dtype=np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return out[0], out[1]


_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_POWER, _BACK = _powers(PIECE)


def _cutter(length: int, words: bool = False):
    units = word_codes if words else lambda x: np.frombuffer(x, dtype=np.uint8)

    def segments(bodies):
        """(row, first start, units) with at most SEGMENT starts each."""
        for i, body in enumerate(bodies):
            for at in range(0, len(body) - length + 1, SEGMENT):
                yield i, at, body[at : at + SEGMENT + length - 1]

    def cut(group):
        joined = np.concatenate([x for _, _, x in group])
        h, own = anchors(joined, length)
        segment = np.full(len(own), -1, dtype=np.int64)
        begin = 0
        begins = []
        for k, (_, _, x) in enumerate(group):
            begins.append(begin)
            segment[begin : begin + len(x) - length + 1] = k
            begin += len(x)
        edge = np.concatenate([[True], (own[1:] != own[:-1]) | (segment[1:] != segment[:-1])])
        first = np.flatnonzero(edge)
        last = np.concatenate([first[1:], [len(own)]]) - 1
        keep = segment[first] >= 0
        first, last = first[keep], last[keep]
        of = segment[first]
        left, right = _beside(h, first, last, own[first], length, gram_of(length, joined.itemsize))
        joined, unit = joined.tobytes(), joined.itemsize
        digests = [_digest(joined[a:b]) for a, b in zip((first * unit).tolist(), ((last + length) * unit).tolist())]
        at = first - np.array(begins)[of] + np.array([a for _, a, _ in group])[of]
        row = np.array([i for i, _, _ in group])[of]
        digests = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        return h[own[first]].view(np.int64), digests, row, at, last - first + length, left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = [batch.column(c) for c in ("doc_id", "k1", "k2")]

            def out(group):
                anchor, digests, row, at, size, left, right = cut(group)
                row = pa.array(row)
                columns = [pa.array(anchor), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *(k.take(row) for k in keys), pa.array(at, pa.int32()), pa.array(size, pa.int32())]
                columns += [pa.array(x.data, mask=x.mask) for x in (left, right)]
                return pa.RecordBatch.from_arrays(columns, schema=_CUT)

            group, size = [], 0
            bodies = batch.column("body").to_pylist()
            for item in segments(map(units, bodies)):
                group.append(item)
                size += len(item[2])
                if size >= SEGMENT:
                    yield out(group)
                    group, size = [], 0
            if group:
                yield out(group)

    return run


def _runs(starts: np.ndarray, length: int) -> bytes:
    """Sorted starts to packed pairs (from, to) of the bytes that their strings cover."""
    fresh = np.flatnonzero(np.concatenate([[True], np.diff(starts) > length]))
    ends = np.concatenate([fresh[1:], [len(starts)]]) - 1
    return np.stack([starts[fresh], starts[ends] + length], axis=1).astype("<i4").tobytes()


def _shard(rows: list[tuple], length: int, unit: int) -> Iterator[tuple]:
    """Rows of _FOUND for the contexts (anchor, parts, d1, d2, copies, bytes) of one shard."""
    texts = [r[5] for r in rows]
    starts, place, group = repeated(texts, length, f"<u{unit}")
    hit = np.zeros(int(starts[-1]), dtype=bool)
    hit[place] = True
    for i, r in enumerate(rows):
        if r[4] > 1:
            hit[starts[i] : starts[i + 1] - length + 1] = True
    for i, r in enumerate(rows):
        found = np.flatnonzero(hit[starts[i] : starts[i + 1]])
        if len(found):
            yield r[2], r[3], _runs(found, length), None, None, None
    if rows[0][1] == 1:
        return
    # this anchor has contexts in other shards: one record for each distinct string here
    joined = b"".join(texts)
    string = lambda p: _digest(joined[p * unit : (p + length) * unit])
    number = np.full(int(starts[-1]), -1, dtype=np.int64)
    number[place] = group
    records: dict[int, list] = {}
    lone = []
    for i, r in enumerate(rows):
        base = int(starts[i])
        for p in range(base, int(starts[i + 1]) - length + 1):
            g = int(number[p])
            if g < 0:
                lone.append((string(p), r[4], r[2], r[3], p - base))
            elif g in records:
                records[g][1] += r[4]
            else:
                records[g] = [string(p), r[4], r[2], r[3], p - base]
    packed = np.array([tuple(x) for x in records.values()] + lone, dtype=_STRING)
    head = np.frombuffer(packed["string"].tobytes(), dtype=">u8")[::2]
    order = np.argsort(head, kind="stable")
    packed, head = packed[order], head[order]
    parts = rows[0][1]
    borders = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    cuts = [0, *np.searchsorted(head, borders).tolist(), len(head)]
    for bucket, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if a < b:
            yield None, None, None, rows[0][0], bucket, packed[a:b].tobytes()


def _found(rows: Iterator[tuple]) -> pa.RecordBatch | None:
    columns = list(zip(*rows))
    if columns:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND)], schema=_FOUND)
    return None


def _sharder(length: int, unit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen, now = [], 0, set(), None
        ready, ready_size = [], 0  # whole anchors that share a shard

        def flush(rows):
            if rows and (out := _found(_shard(rows, length, unit))) is not None:
                yield out

        for batch in batches:
            for anchor, part, parts, d1, d2, copies, body in zip(*(c.to_pylist() for c in batch.columns)):
                if (anchor, part) != now:
                    if held and (held[0][1] > 1 or ready_size + size > MOST):
                        yield from flush(ready)
                        ready, ready_size = [], 0
                    ready += held
                    ready_size += size
                    if held and held[0][1] > 1:
                        yield from flush(ready)
                        ready, ready_size = [], 0
                    held, size, seen, now = [], 0, set(), (anchor, part)
                if (d1, d2) not in seen:  # repeated rows send a context twice
                    seen.add((d1, d2))
                    held.append((anchor, parts, d1, d2, copies, body))
                    size += len(body) // unit
        if held and (held[0][1] > 1 or ready_size + size > MOST):
            yield from flush(ready)
            ready = []
        yield from flush(ready + held)

    return run


def _merger(length: int):
    def merged(parts: list[bytes]) -> Iterator[tuple]:
        all_ = np.concatenate([np.frombuffer(x, dtype=_STRING) for x in parts])
        _, which = np.unique(all_["string"].view("V16"), return_inverse=True)
        total = np.bincount(which, weights=all_["copies"])
        open_ = all_[(all_["copies"] == 1) & (total[which] > 1)]
        by: dict[tuple[int, int], list[int]] = {}
        for d1, d2, at in zip(open_["d1"].tolist(), open_["d2"].tolist(), open_["at"].tolist()):
            by.setdefault((d1, d2), []).append(at)
        for digest, ats in by.items():
            yield *digest, _runs(np.array(sorted(ats)), length), None, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for anchor, bucket, strings in zip(*(c.to_pylist() for c in batch.columns)):
                if (anchor, bucket) != now:
                    if held and (out := _found(merged(held))) is not None:
                        yield out
                    held, now = [], (anchor, bucket)
                held.append(strings)
        if held and (out := _found(merged(held))) is not None:
            yield out

    return run


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's keys and its spans as lists of (at, len, spans), to maximal runs; without spans all of a place repeats."""
    for batch in batches:
        lists = batch.column("places")
        count = np.diff(lists.offsets.to_numpy())
        at, size, spans = lists.flatten().flatten()
        at, size = at.to_numpy().astype(np.int64), size.to_numpy().astype(np.int64)
        base = np.repeat(np.arange(len(count), dtype=np.int64) << 40, count) + at
        whole = spans.is_null().to_numpy(zero_copy_only=False)
        parts = spans.drop_null().to_pylist()
        number = np.array([len(x) // 8 for x in parts], dtype=np.int64)
        inner = np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2) + np.repeat(base[~whole], number)[:, None]
        pairs = np.concatenate([np.stack([base, base + size], axis=1)[whole], inner])
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        reach = np.maximum.accumulate(pairs[:, 1])
        fresh = np.flatnonzero(np.concatenate([[True], pairs[1:, 0] > reach[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        ends = np.concatenate([fresh[1:], [len(pairs)]]) - 1 if len(pairs) else fresh
        runs = np.stack([pairs[fresh, 0], reach[ends]], axis=1)
        edges = np.searchsorted(runs[:, 0], np.arange(len(count) + 1, dtype=np.int64) << 40).tolist()
        runs = (runs & ((1 << 40) - 1)).astype("<i8")
        out = [runs[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(out, pa.binary())], names=["k1", "k2", "removed"])


def text_keys(body) -> list:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit("again"), body).alias("k2")]


def repeat_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", words: bool = False) -> DataFrame:
    """k1, k2, removed for the distinct texts with something to remove.

    ``k1`` and ``k2`` are the text's ``text_keys``; ``removed`` holds pairs of
    little-endian 64-bit integers (from, to), maximal and in order.  With
    ``words`` the length and the pairs count words, otherwise bytes.
    """
    spark = docs.sparkSession
    n, unit = tasks_for(spark), 4 if words else 1
    staged = Staged(spark, "suffix")
    keys = ["k1", "k2"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"), *text_keys(utf8(text_col)))
    # words have a byte at least, with one between them
    long = rows.where(F.length("body") >= (2 * length - 1 if words else length))
    places = staged(long.mapInArrow(_cutter(length, words), PLACES), "places")

    # with another key than the counts were dealt by, both sides of the join are dealt anew, so that Spark can split the rows of a frequent anchor
    twice = places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").bitwiseXOR(F.lit(1)).alias("anchor"))
    near = places.withColumn("anchor", F.col("anchor").bitwiseXOR(F.lit(1))).join(twice.hint("shuffle_hash"), "anchor", "left_semi")
    # an order of its own for equal contexts, by which one place of them is taken
    near = staged(near.withColumn("place", F.monotonically_increasing_id()), "near")
    first = lambda x: F.min_by(x, "place").alias(x)
    contexts = near.groupBy("anchor", "d1", "d2").agg(F.count("*").alias("copies"), *[first(x) for x in ("doc_id", *keys, "at", "len", "left", "right")])
    contexts = staged(contexts.withColumn("copies", F.least("copies", F.lit(2)).cast("int")), "contexts")
    # contexts that share a side with another one
    sides = contexts.select("anchor", "d1", "d2", F.explode(F.array("left", "right")).alias("side")).where("side is not null")
    both = sides.groupBy("side").agg(F.count("*").alias("n")).where("n > 1").select("side")
    open_ = sides.join(both.hint("shuffle_hash"), "side", "left_semi").select("anchor", "d1", "d2").distinct()
    open_ = staged(contexts.join(open_, ["anchor", "d1", "d2"], "left_semi").drop("left", "right"), "open")
    alike = contexts.join(open_.select("anchor", "d1", "d2"), ["anchor", "d1", "d2"], "left_anti").where("copies > 1").select("d1", "d2", F.lit(None).cast("binary").alias("spans"))
    units = open_.groupBy("anchor").agg(F.sum("len").alias("units"))
    dealt = open_.join(units, "anchor").withColumn("parts", F.ceil(F.col("units") / SPREAD).cast("int"))
    dealt = dealt.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.col("d1"), F.col("parts"))).otherwise(0).cast("int"))

    item = F.struct("anchor", "part", "parts", "d1", "d2", "copies", "at", "len")
    # with the id, so that copies of a text do not meet; a null id that meets another one's copy does no harm
    its = F.coalesce("doc_id", F.lit(0)).alias("its")
    wanted = dealt.groupBy(its, *keys).agg(F.collect_list(item).alias("list"))
    held = long.select(its, "body", *keys).join(wanted.hint("shuffle_hash"), ["its", *keys]).select("body", "list")
    if words:
        cut = held.mapInArrow(_cut_words, "anchor long, part int, parts int, d1 long, d2 long, copies int, bytes binary")
    else:
        cut = F.transform("list", lambda x: F.struct(*[x[c] for c in ("anchor", "part", "parts", "d1", "d2", "copies")], F.substring(F.col("body"), x["at"] + 1, x["len"]).alias("bytes")))
        cut = held.select(F.explode(cut).alias("x")).select("x.*").toDF("anchor", "part", "parts", "d1", "d2", "copies", "bytes")
    dealt = cut.repartition(n, "anchor", "part").sortWithinPartitions("anchor", "part")
    found = staged(dealt.mapInArrow(_sharder(length, unit), FOUND), "found")
    strings = found.where("strings is not null").select("anchor", "bucket", "strings")
    strings = strings.repartition(n, "anchor", "bucket").sortWithinPartitions("anchor", "bucket")
    spans = found.where("spans is not null").unionByName(strings.mapInArrow(_merger(length), FOUND)).select("d1", "d2", "spans").unionByName(alike)
    hits = near.select("d1", "d2", *keys, "at", "len").join(spans, ["d1", "d2"]).groupBy(*keys).agg(F.collect_set(F.struct("at", "len", "spans")).alias("places"))
    removed = staged(hits.mapInArrow(_union, "k1 long, k2 long, removed binary"), "removed")
    staged.done("places", "near", "contexts", "open", "found")
    return removed


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["anchor", "part", "parts", "d1", "d2", "copies"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    for batch in slices(batches):
        for body, wanted in zip(batch.column("body").to_pylist(), batch.column("list").to_pylist()):
            codes = word_codes(body)
            columns = [pa.array([x[k] for x in wanted], t) for k, t in zip(names, types)]
            texts = pa.array([codes[x["at"] : x["at"] + x["len"]].tobytes() for x in wanted], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, texts], names=[*names, "bytes"])


def passage_pairs(body: bytes, removed: bytes | None) -> np.ndarray:
    """The bytes (from, to) of the text that pairs of its words cover."""
    pairs = np.frombuffer(removed or b"", "<i8").reshape(-1, 2)
    if not len(pairs):
        return pairs
    places = word_places(body)
    return np.stack([places[pairs[:, 0], 0], places[pairs[:, 1] - 1, 1]], axis=1)


def either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that cover what one or the other covers, maximal and in order."""
    out: list[list[int]] = []
    for x, y in sorted([*a.tolist(), *b.tolist()]):
        if out and x <= out[-1][1]:
            out[-1][1] = max(y, out[-1][1])
        else:
            out.append([x, y])
    return np.array(out, dtype="<i8").reshape(-1, 2)


def with_removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", words: int | None = None) -> DataFrame:
    """row, removed, passages: each row of ``docs`` as a struct, with the pairs of ``repeat_spans`` in bytes and, with ``words``, in words.

    Both are null where there is nothing to remove.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), *text_keys(utf8(text_col)))
    spans = repeat_spans(docs, length, id_col, text_col)
    if words:
        more = repeat_spans(docs, words, id_col, text_col, words=True).withColumnRenamed("removed", "passages")
        spans = spans.join(more, ["k1", "k2"], "full")
    else:
        spans = spans.withColumn("passages", F.lit(None).cast("binary"))
    return rows.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("row", "removed", "passages")


def pairs_of(removed: bytes | None) -> np.ndarray:
    return np.frombuffer(removed or b"", "<i8").reshape(-1, 2)


def cut_out(body: bytes, pairs: np.ndarray) -> bytes:
    """What is left of the text without the bytes of the pairs (from, to)."""
    if not len(pairs):
        return body
    edges = [0, *pairs.reshape(-1).tolist(), len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", words: int | None = None) -> DataFrame:
    """The rows of ``docs`` with repeated bytes cut from their texts, and ``chars_col`` counted anew where it is there.

    A character of which a cut leaves only some bytes goes as a whole.  Null texts stay null.  With
    ``words``, passages of that many words go too, however few bytes they have.  All rows and columns
    stay, whatever the columns are called; repeated rows are cut alike; an empty table stays empty.
    """
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = dict(zip(names, batch.column("row").flatten()))
            kept, cut = [], []
            for x, removed, passages in zip(columns[text_col].to_pylist(), batch.column("removed").to_pylist(), batch.column("passages").to_pylist()):
                cut.append(removed is not None or passages is not None)
                if cut[-1]:
                    body = x.encode()
                    pairs = pairs_of(removed)
                    x = cut_out(body, either(pairs, passage_pairs(body, passages)) if passages else pairs).decode("utf-8", "ignore")
                kept.append(x)
            columns[text_col] = pa.array(kept, columns[text_col].type)
            if chars_col in columns:
                old = columns[chars_col]
                columns[chars_col] = pa.array([len(k) if c else n for n, k, c in zip(old.to_pylist(), kept, cut)], old.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return with_removed(docs, length, id_col, text_col, words).mapInArrow(run, schema)


_OUT = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("n_passage_bytes", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids, texts = batch.column("row").flatten()
        rows = []
        for text, removed, passages in zip(texts.to_pylist(), batch.column("removed").to_pylist(), batch.column("passages").to_pylist()):
            body, pairs = (text or "").encode(), pairs_of(removed)
            kept, found = cut_out(body, pairs), passage_pairs(body, passages)
            rows.append((len(body), len(body) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest(), len(found), int((found[:, 1] - found[:, 0]).sum())))
        columns = list(zip(*rows)) or [[]] * (len(_OUT) - 1)
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, list(_OUT)[1:]))], schema=_OUT)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for all of ``documents``, by strings of 400 bytes.

    n_passages and n_passage_bytes report the passages of 51 words or more that also start elsewhere,
    which may be shorter than 400 bytes; they have no part in what is removed.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_bytes long"
    return with_removed(docs, words=PASSAGE).mapInArrow(_digests, out)
