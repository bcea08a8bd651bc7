"""Token-id files made of independent zstandard frames with a trailing seek table.

A file holds one frame for each document, then a skippable frame with the seek
table: for each document its id, the frame's compressed size, the number of
tokens and the CRC-32 of its ids.  Each frame carries zstandard's own content
checksum as well.  A reader takes the table from the end of the file and then
decompresses the frames of the documents asked for and no other.

Layout after the frames (little-endian)::

    u32 0x184D2A5E, u32 size                      skippable frame
      i64[n] ids, u8[n] id is null, u32[n] frame sizes, u64[n] tokens, u32[n] crc32
      u64 n, u8 bytes of a stored id (2 or 4), 3 zero bytes, u32 0x8F92EAB1
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, table, tasks_for

SKIPPABLE, MAGIC = 0x184D2A5E, 0x8F92EAB1
_TAIL = struct.Struct("<QB3xI")
_EACH = 8 + 1 + 4 + 8 + 4
#: Chunks of text whose ids one generation of a worker's memory holds.
REMEMBERED = 500_000
#: Bytes of a chunk that is remembered, and of texts whose chunks are looked up together.
LONGEST, GROUP = 64, 4 << 20
#: After a letter or digit, such a character at a chunk's end is a match of its own.
_MARKS = {",", "."}

_cut = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")


def chunks(text: str) -> list[str]:
    """Cut before single spaces; no match of the usual byte-level patterns spans a cut.

    Such a pattern takes one space together with the word after it, and leaves a
    run of spaces to a match of its own; so a text with a double space is cut
    only between two visible characters.
    """
    if "  " in text:
        return _cut.split(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]


#: Classes of bytes: letter, digit, other ASCII mark, apostrophe, space, other ASCII white space,
#: any other visible character, one that may be white space, and bytes that continue a character.
_L, _D, _P, _Q, _S, _W, _V, _U, _C = range(9)


def _class_table() -> np.ndarray:
    out = np.full(256, _U, np.uint8)
    for k in range(33, 127):
        out[k] = _L if chr(k).isalpha() else _D if chr(k).isdigit() else _Q if k == 39 else _P
    out[32], out[9:14], out[0x80:0xC0] = _S, _W, _C
    # U+00C0 to U+027F but for two signs are letters; byte_classes names what may be white space of the rest
    out[0xC3:0xCA], out[0xCA:0xF5] = _L, _V
    return out


def _cut_table(pairs: dict[int, tuple[int, ...]]) -> np.ndarray:
    out = np.zeros((9, 9), bool)
    for k, after in pairs.items():
        out[k, list(after)] = True
    return out.ravel()


_CLASS = _class_table()
#: Pairs of classes between which the usual byte-level patterns always end a match: they take a space only in front.
_CUTS = _cut_table({k: (_S,) for k in (_L, _D, _P, _Q, _V)})
#: And those between which the pattern of ByteLevel does, which takes letters, digits and marks apart; 's may be one match.
_FINE_CUTS = _cut_table({_L: (_D, _P, _Q, _S, _W), _D: (_L, _P, _Q, _S, _W), _P: (_L, _D, _S, _W), _Q: (_D, _S, _W), _V: (_S, _W), _W: (_L, _D, _P, _Q, _V)})
#: What a chunk that is one match of ByteLevel's pattern may hold; it may begin with a space.
_PLAIN = np.isin(np.arange(9), (_L, _D, _P))


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of a UTF-8 text belongs to."""
    out = _CLASS[data]
    if not len(data) or data.max() < 128:
        return out
    a, b = data[:-1], data[1:]
    out[:-1][(a == 0xC3) & ((b == 0x97) | (b == 0xB7))] = _V
    if (data > 0xE0).any():
        out[:-1][((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))] = _U
    for _ in range(3):
        at = np.flatnonzero(out == _C)
        if not len(at):
            break
        out[at] = out[at - 1]
    return out


def _byte_characters() -> np.ndarray:
    """The characters by which byte-level vocabularies write the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u4")
    out[shown] = shown
    out[[k for k in range(256) if k not in shown]] = 256 + np.arange(256 - len(shown))
    return out


_CHARACTERS = _byte_characters()


class ChunkEncoder:
    """Ids of whole texts by the tokenizers library, which sees a chunk again only once it is forgotten.

    Texts are cut where no match of the tokenizer's pattern can span the cut, and
    each distinct chunk of some megabytes is looked up once.  Two generations of
    chunks are remembered; when the younger is full the elder goes.  New chunks
    that are one match go to the library's model, the others to the whole
    tokenizer, many to a call, and the ids are dealt back by the bytes that they
    stand for.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        # each character of a byte-level token stands for one byte
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)
        self.fine = _splits_as_byte_level(self.tokenizer)

    def _encode(self, new: list[bytes]) -> list[bytes]:
        """Ids of chunks by the whole tokenizer."""
        if not new:
            return []
        out = {c: None for c in new}
        last = byte_classes(np.frombuffer(b"".join(new), np.uint8))[np.cumsum([len(c) for c in new]) - 1]
        # a match ends after a visible character and before a space, so neighbours do not change such chunks
        joins = _CUTS[last * np.uint8(9) + np.uint8(_S)].tolist()
        alone = [c for c, x in zip(new, joins) if not x or c[:1] != b" "]
        joint = [c for c, x in zip(new, joins) if x and c[:1] == b" "]
        for k in range(0, len(joint), 100):
            part = joint[k : k + 100]
            # this call leaves out the offsets, which nobody asks for
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, dtype=self.kind)
            at = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum([len(c) for c in part])
            cuts = np.searchsorted(at, ends)
            if len(ids) and np.array_equal(at[np.minimum(cuts, len(at) - 1)], ends):
                out.update(zip(part, _pieces(ids.tobytes(), ((cuts + 1) * self.width).tolist())))
            else:
                alone += part
        for c in alone:
            out[c] = np.array(self.tokenizer.encode(c.decode(), add_special_tokens=False).ids, dtype=self.kind).tobytes()
        return list(out.values())

    def _encode_matches(self, joined: np.ndarray, ends: list[int]) -> Iterator[bytes]:
        """Ids of chunks that are one match each, by the model alone."""
        tokenize = self.model.tokenize
        ids, counts = [], []
        for word in _pieces(_CHARACTERS[joined].tobytes().decode("utf-32-le"), ends):
            ids += [t.id for t in tokenize(word)]
            counts.append(len(ids))
        return _pieces(np.array(ids, dtype=self.kind).tobytes(), [k * self.width for k in counts])

    def _encode_new(self, new: list[bytes]) -> list[bytes]:
        if not new or not self.fine:
            return self._encode(new)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        ends = np.cumsum(sizes)
        joined = np.frombuffer(b"".join(new), np.uint8)
        classes = byte_classes(joined)
        plain = _PLAIN[classes]
        starts = ends - sizes
        plain[starts] |= (classes[starts] == _S) & (sizes > 1)
        one = np.logical_and.reduceat(plain, starts)
        matches = self._encode_matches(joined[np.repeat(one, sizes)], np.cumsum(sizes[one]).tolist())
        others = iter(self._encode([new[k] for k in np.flatnonzero(~one)]))
        return [next(matches if x else others) for x in one.tolist()]

    def _values(self, wanted: list[bytes]) -> list[bytes]:
        """Ids of each of the distinct chunks."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, wanted))
        new = []
        for k, found in enumerate(out):
            if found is None:
                c = wanted[k]
                out[k] = found = old.get(c)
                if found is None:
                    new.append(k)
                else:
                    young[c] = found
        for k, found in zip(new, self._encode_new([wanted[k] for k in new])):
            out[k] = found
            if len(c := wanted[k]) <= LONGEST:
                young[c] = found
        return out

    def cuts(self, text: np.ndarray) -> np.ndarray:
        """For each byte of a UTF-8 text, whether a chunk begins there."""
        classes = byte_classes(text)
        out = np.ones(len(text), bool)
        np.take(_FINE_CUTS if self.fine else _CUTS, classes[:-1] * np.uint8(9) + classes[1:], out=out[1:])
        # the last of several white-space characters is a match of its own, so they stay with what follows
        out[1:] &= (classes[:-1] != _W) | out[:-1]
        return out

    def ids(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """Packed ids of each text, without an end; a null is empty."""
        whole = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        whole.validate(full=True)  # what is no UTF-8 is an error
        whole = whole.cast(pa.large_binary()).fill_null(b"")
        for part in _groups_of(whole, GROUP):
            yield from self._group(part)

    def _group(self, texts: pa.Array) -> Iterator[bytes]:
        limits, text = _contents(texts)
        if not len(text):
            yield from [b""] * len(texts)
            return
        cuts = self.cuts(text)
        cuts[limits[limits < len(text)]] = True
        begins = np.flatnonzero(cuts)
        places = pa.py_buffer(np.append(begins, len(text)))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, places, pa.py_buffer(text)]).dictionary_encode()
        ends, distinct = _contents(chunks.dictionary)
        values = self._values(list(_pieces(distinct.tobytes(), ends[1:].tolist())))
        ends, packed = _contents(pa.array(values, pa.large_binary()).take(chunks.indices))
        yield from _pieces(packed.tobytes(), ends[np.searchsorted(begins, limits[1:])].tolist())


def _contents(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the texts begin, with the end of the last, and all their bytes."""
    _, offsets, data = texts.buffers()
    limits = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    first, n = int(limits[0]), int(limits[-1] - limits[0])
    return limits - first, np.frombuffer(data, np.uint8, n, first) if n else np.zeros(0, np.uint8)


def _splits_as_byte_level(tokenizer) -> bool:
    """Whether nothing but the pattern of ByteLevel splits a text, and nothing changes it."""
    kind = tokenizer.pre_tokenizer and json.loads(tokenizer.pre_tokenizer.__getstate__())
    plain = kind and kind["type"] == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"]
    return bool(plain and tokenizer.normalizer is None and all(t.special for t in tokenizer.get_added_tokens_decoder().values()))


def _pieces(whole, ends: list[int]) -> Iterator:
    return (whole[a:b] for a, b in zip([0, *ends], ends))


def _groups_of(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """Slices of at most so many bytes, or of one text."""
    if not len(texts):
        return
    limits, _ = _contents(texts)
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(limits, limits[k] + size, "right")) - 1)
        yield texts.slice(k, stop - k)
        k = stop


_encoders: dict[str, ChunkEncoder] = {}


def encoder_for(path: str) -> ChunkEncoder:
    """One encoder for each worker process and tokenizer; it is kept from task to task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _groups(texts: list[str], chars: int) -> Iterator[list[str]]:
    held, size = [], 0
    for x in texts:
        held.append(x)
        size += len(x)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def write_file(path: str, docs: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Write (id, packed token ids) in the order given; returns documents and tokens.

    The file appears under its name once it is complete, so a task that is run
    again replaces it whole.
    """
    fs, name = store(path)
    fs.create_dir(name.rpartition("/")[0], recursive=True)
    pack = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True).compress
    ids, sizes, tokens, sums = [], [], [], []
    with fs.open_output_stream(part := f"{name}.{np.random.default_rng().integers(1 << 62)}.part") as f:
        for doc_id, packed in docs:
            frame = pack(packed)
            f.write(frame)
            ids.append(doc_id)
            sizes.append(len(frame))
            tokens.append(len(packed) // width)
            sums.append(zlib.crc32(packed if width == 4 else np.frombuffer(packed, "<u2").astype("<u4").tobytes()))
        columns = (
            np.array([x or 0 for x in ids], "<i8"),
            np.array([x is None for x in ids], "u1"),
            np.array(sizes, "<u4"),
            np.array(tokens, "<u8"),
            np.array(sums, "<u4"),
        )
        body = b"".join(c.tobytes() for c in columns) + _TAIL.pack(len(ids), width, MAGIC)
        f.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
    fs.move(part, name)
    return len(ids), sum(tokens)


class TokenFile:
    """Reads a file's seek table, and any document's ids by its place in the file."""

    def __init__(self, path: str):
        fs, name = store(path)
        self.file = fs.open_input_file(name)
        end = self.file.size()
        n, self.width, magic = _TAIL.unpack(self._at(end - _TAIL.size, _TAIL.size))
        if magic != MAGIC:
            raise ValueError(f"{path} has no seek table")
        size = n * _EACH + _TAIL.size
        body = self._at(end - size, size)
        at, columns = 0, []
        for kind in ("<i8", "u1", "<u4", "<u8", "<u4"):
            columns.append(np.frombuffer(body, kind, n, at))
            at += n * np.dtype(kind).itemsize
        ids, null, self.sizes, self.tokens, self.sums = columns
        self.ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)])
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def read(self, k: int) -> np.ndarray:
        """The ids of the k-th document as unsigned 32-bit integers; both checksums are tested."""
        raw = self.unpack.decompress(self._at(int(self.starts[k]), int(self.sizes[k])))
        out = np.frombuffer(raw, f"<u{self.width}").astype("<u4")
        if zlib.crc32(out.tobytes()) != self.sums[k]:
            raise ValueError(f"document {k} is damaged")
        return out


def _writer(folder: str, tokenizer: str, end_id: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_for(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()

        def docs():
            for batch in batches:
                for doc_id, packed in zip(batch.column("doc_id").to_pylist(), encoder.ids(batch.column("text"))):
                    yield doc_id, packed + end

        shard = TaskContext.get().partitionId()
        path = f"{folder}/tokens-{shard:06d}.zst"
        first = next(rows := docs(), None)
        if first is not None:
            n, tokens = write_file(path, _with(first, rows), encoder.width)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "docs": [n], "tokens": [tokens]}, schema=_SHARD)

    return write


def _with(first, rest):
    yield first
    yield from rest


_SHARD = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            f = TokenFile(path)
            n, sums = [], []
            for k in range(len(f.ids)):
                ids = f.read(k)
                n.append(len(ids))
                sums.append(zlib.crc32(ids.tobytes()))
            starts = start + np.concatenate([[0], np.cumsum(np.array(n[:-1], dtype=np.int64))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(f.ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(sums, pa.int64())], schema=_READ)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files in ascending id order; returns shard, path, docs, tokens, start.

    Rows are dealt by ranges of the id, so that files follow one another in its
    order (nulls first, equal ids by their text).  ``start`` counts the tokens of
    all files before.  A null text is empty and gives the end id alone.  An empty
    table gives no file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(tasks_for(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    written = dealt.mapInArrow(_writer(folder, tokenizer, end_id), "shard long, path string, docs long, tokens long").collect()
    out, start = [], 0
    for row in sorted(written):
        out.append((*row, start))
        start += row.tokens
    return spark.createDataFrame(out, "shard long, path string, docs long, tokens long, start long")


def read_tokens(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    dealt = shards.select("path", "start").repartition(tasks_for(shards.sparkSession), "path")
    return dealt.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_frames(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for all of ``documents``, read back from its token files."""
    import public_tokenizers

    shards = write_tokens(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(shards)
