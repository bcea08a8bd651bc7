"""Byte-level BPE by monoid tree reduction.

A piece is encoded by halves.  The encodings of two neighbours are joined by
encoding anew the bytes of a window of tokens around their border.  A token
sequence is the encoding of its bytes exactly if each two adjacent tokens are
the encoding of the bytes of the two (merges never look further), so the window
has grown enough once its outer tokens are stable next to the tokens outside.
Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MEMORIES, slices, table
from .token_frames import _MARKS, _groups, chunks

#: Bytes up to which a node of the tree is merged directly; and entries that each memory holds before it starts anew.
LEAF, REMEMBERED = 3, 120_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class TreeEncoder:
    """Encodes pieces of bytes by a table of ranks; the rank of a token is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes_of[k] = token
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.stable: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the two adjacent tokens of least rank, the leftmost of equals, until none is left."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(ranks[piece[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if end[a] != b or b >= n or end[b] != stop:  # one of the two is gone or has grown
                continue
            end[a], end[b] = stop, -1
            if stop < n:
                before[stop] = a
                if (rank := ranks.get(piece[a : end[stop]])) is not None:
                    heapq.heappush(heap, (rank, a, stop, end[stop]))
            if (p := before[a]) >= 0 and (rank := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (rank, p, a, stop))
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : end[at]]])
            at = end[at]
        return tuple(out)

    def _part(self, piece: bytes) -> tuple[int, ...]:
        found = self.parts.get(piece)
        if found is None:
            found = self.merge(piece)
            if len(piece) <= 32:
                self.parts[piece] = found
        return found

    def _stays(self, a: int, b: int) -> bool:
        found = self.stable.get((a, b))
        if found is None:
            found = self.stable[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return found

    def _join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right or self._stays(left[-1], right[0]):
            return left + right
        text = self.bytes_of
        i, j = len(left) - 1, 1
        while True:
            window = self._part(b"".join([text[k] for k in left[i:]] + [text[k] for k in right[:j]]))
            grow_left = i > 0 and not self._stays(left[i - 1], window[0])
            grow_right = j < len(right) and not self._stays(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:i] + window + right[j:]
            if grow_left:
                i = max(0, 2 * i - len(left))
            if grow_right:
                j = min(len(right), 2 * j)

    def reduce(self, piece: bytes) -> tuple[int, ...]:
        n = len(piece)
        if n <= LEAF:
            return self._part(piece)
        found = self.parts.get(piece)
        if found is None:
            found = self._join(self.reduce(piece[: n // 2]), self.reduce(piece[n // 2 :]))
            if n <= 12:
                self.parts[piece] = found
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """A piece that is a token as a whole is that token, as in the usual libraries."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(self.parts) > REMEMBERED:
            self.parts = {}
        if len(self.stable) > REMEMBERED:
            self.stable = {}
        return self.reduce(piece)


class TextEncoder:
    """Ids of whole texts, piece by piece of a pattern; two generations of chunks are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tree = TreeEncoder(ranks)
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.packed = [k.to_bytes(4, "little") for k in range(len(self.tree.bytes_of))]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _chunk(self, chunk: str) -> bytes:
        """Letters after a space are one piece; so is a lone mark after them."""
        young = self.young
        if chunk[:1] == " " and chunk[1:].isalpha():
            ids = self.tree.encode(chunk.encode())
        elif chunk[-1:] in _MARKS and chunk[-2:-1].isalnum():
            base = chunk[:-1]
            found = young.get(base)
            if found is None:
                found = self.old.get(base)
                if found is None:
                    found = self._chunk(base)
                young[base] = found
            return found + self._chunk(chunk[-1])
        else:
            ids = [k for p in self.pieces(chunk) for k in self.tree.encode(p.encode())]
        return b"".join([self.packed[k] for k in ids])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids as packed little-endian unsigned 32-bit integers."""
        out = []
        for group in _groups(texts, 1 << 20):
            cut = [chunks(x) for x in group]
            if len(self.young) > REMEMBERED:
                self.old, self.young = self.young, {}
            young, old = self.young, self.old
            for c in {c for cs in cut for c in cs} - young.keys():
                found = old.get(c)
                young[c] = self._chunk(c) if found is None else found
            get = young.__getitem__
            out += [b"".join(map(get, cs)) for cs in cut]
        return out

    def decode(self, packed: bytes) -> bytes:
        """The bytes of the ids: tokens to blocks, then neighbouring blocks up the tree."""
        get, ids = self.tree.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()
        level = [b"".join(map(get, ids[k : k + 8192])) for k in range(0, len(ids), 8192)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


_encoders: dict[tuple[str, str], TextEncoder] = {}
MEMORIES["bpe"] = _encoders.clear


def encoder_for(path: str, pattern: str) -> TextEncoder:
    """One encoder for each worker process and vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = TextEncoder(load_ranks(path), pattern)
    return _encoders[path, pattern]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded with ``keep_ids``), a row for each row.

    A null text is empty: no tokens, and the digests of nothing.  Ids and other
    columns play no part, so repeated rows give repeated results.
    """
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kinds += [("ids", pa.binary()), ("decoded", pa.binary())] * keep_ids
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(vocabulary, pattern)
        for batch in slices(batches, own="bpe"):
            packed = encoder.ids([x or "" for x in batch.column("text").to_pylist()])
            decoded = [encoder.decode(x) for x in packed]
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in packed], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in packed]),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
            ]
            if keep_ids:
                columns += [pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spec = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * keep_ids
    return rows.mapInArrow(run, spec)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for all of ``documents``."""
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
