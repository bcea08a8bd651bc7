import itertools
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tessera.llm import bpe, token_frames
from tessera.llm.common import new_folder

ODD = ["  a  b\n \n x   y ", "it's  the  end.\x1f ok\x1c\x1d q", "", " ", "a" * 3001 + " " + "ab" * 900 + " " * 50 + "x", "x\n\n  y 　z  é 1 2's 'll 日本語テキスト", "a <|endoftext|> b,. c.", "1,2 ,, .. x."]


def test_chunks_join_to_the_text():
    for text in ODD:
        assert "".join(token_frames.chunks(text)) == text


def test_ids_are_the_librarys():
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    encoder = token_frames.ChunkEncoder(path)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abcdefgh  \n.,'é日") for _ in range(400)) for _ in range(30)]
    for _ in range(2):
        got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.ids(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


class Seen:
    """Passes calls on and keeps the texts that they were given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, []

    def __getattr__(self, name):
        def call(given, *more, **named):
            self.texts += [given] if isinstance(given, str) else given
            return getattr(self.inner, name)(given, *more, **named)

        return call


def test_library_sees_a_word_once_whatever_follows():
    encoder = token_frames.ChunkEncoder(P.path("byte_bpe_50k.json"))
    encoder.tokenizer, encoder.model = Seen(encoder.tokenizer), Seen(encoder.model)
    words = [f"qu{a}{b}é" for a in "aeiou" for b in "lmnrs"]
    after = ["", ".", ",", "!!", "$$$", "?)", ".\nNext", ".\nnext,", "\tx", "77"]
    for _ in range(2):
        list(encoder.ids(["x " + " ".join(w + m for w in words for m in after)]))
    assert sorted(encoder.tokenizer.texts) == ["\t", "\n"]
    # the words, seven other words and marks of what follows them, and x and the comma
    assert len(encoder.model.texts) == len(set(encoder.model.texts)) == len(words) + 9


def test_cuts_lie_between_matches(tmp_path):
    path = P.path("byte_bpe_50k.json")
    usual = Tokenizer.from_file(path)
    other = Tokenizer.from_file(path)
    pattern = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    texts = ["".join(x) for x in itertools.product("aé0 \n.'s\xa0\x1f　“日×\x85", repeat=3)] + ["a\n\n" + x for x in ODD]
    for tokenizer, where, fine in ((usual, path, True), (other, str(tmp_path / "other.json"), False)):
        tokenizer.encode_special_tokens = True
        encoder = token_frames.ChunkEncoder(where)
        assert encoder.fine == fine
        want = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.ids(texts)] == want


def test_classes_of_characters_are_the_librarys():
    split = Tokenizer.from_file(P.path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
    may_be = {"a": {token_frames._L}, "0": {token_frames._D}, "$": {token_frames._P, token_frames._Q}, None: {token_frames._S, token_frames._W}}
    for k in [*range(0x3200), 0xAC00, 0xFEFF, 0x1F600]:
        (found,) = set(token_frames.byte_classes(np.frombuffer(chr(k).encode(), np.uint8)).tolist())
        kind = next((x for x in "a0$" if len(split(x + chr(k) + x)) == 1), None)
        assert found in may_be[kind] | {token_frames._U} | ({token_frames._V} if kind else set()), hex(k)


def test_ids_of_arrow_columns():
    encoder = token_frames.ChunkEncoder(P.path("byte_bpe_50k.json"))
    want = [list(encoder.ids([x]))[0] for x in ODD]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["cut off", None, *ODD, None], kind).slice(1)
        assert list(encoder.ids(column)) == [b"", *want, b""]
    with pytest.raises(pa.ArrowInvalid):
        list(encoder.ids(pa.array([b"a\xc3 b"]).view(pa.string())))
    assert list(encoder.ids([])) == [] and list(encoder.ids(["", ""])) == [b"", b""]


def test_file_gives_single_documents(tmp_path):
    path = f"file://{tmp_path}/x/tokens.zst"
    docs = [(3, b"\x01\x00\x02\x00"), (None, b""), (7, np.arange(5000, dtype="<u2").tobytes())]
    assert token_frames.write_file(path, iter(docs), 2) == (3, 5002)
    f = token_frames.TokenFile(path)
    assert f.ids == [3, None, 7] and f.tokens.tolist() == [2, 0, 5000]
    assert f.read(2).tolist() == list(range(5000)) and f.read(1).tolist() == [] and f.read(0).tolist() == [1, 2]
    raw = bytearray((tmp_path / "x/tokens.zst").read_bytes())
    raw[6] ^= 255
    (tmp_path / "x/tokens.zst").write_bytes(bytes(raw))
    with pytest.raises(Exception):
        token_frames.TokenFile(path).read(0)


def test_written_and_read_in_order(spark, corpus, make):
    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(((r.doc_id, r.text or "") for r in corpus.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = token_frames.read_tokens(token_frames.write_tokens(corpus, new_folder(spark, "tokens"), path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_frames.read_tokens(token_frames.write_tokens(make([]), new_folder(spark, "tokens"), path)).count() == 0


def test_tree_encodes_as_the_library(corpus, make):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.TextEncoder(ranks, P.PATTERN)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abcdefgh  \n.,'é日") for _ in range(400)) for _ in range(30)] + ["".join(rng.choice("0123456789") for _ in range(3000))]
    for text, packed in zip(texts, encoder.ids(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.decode(packed) == text.encode()
    out = bpe.encode_decode(corpus, path, P.PATTERN, keep_ids=True).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in out) == sorted((str(r.doc_id), (r.text or "").encode()) for r in corpus.collect())
    assert bpe.encode_decode(make([]), path, P.PATTERN).count() == 0
