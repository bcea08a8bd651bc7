import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest

from tessera.llm import matroska as m
from tessera.llm import quote_threads
from tessera.llm.sql import OP4


@pytest.mark.parametrize("kind", [m.XIPH, m.EBML_LACING, m.FIXED])
@pytest.mark.parametrize("n", [1, 2, 3, 9])
def test_lacing(kind, n):
    rng = random.Random(n)
    frames = [bytes(rng.choice([0, 1, 5, 254, 255, 256, 1000, 70000]) if kind != m.FIXED else 77) for _ in range(n)]
    cluster = m.element(m.CLUSTER, m.number(m.TIME, 5) + m.element(m.GROUP, m.element(m.BLOCK, m.block(1, 3, frames, kind)) + m.number(m.REFERENCE, 1)))
    media = m.element(m.EBML, b"") + m.element(m.SEGMENT, m.element(m.TRACKS, m.element(m.ENTRY, m.number(m.NUMBER, 1))) + cluster)
    p = m.Reader(media).read()
    assert [media[a : a + s] for a, s in zip(p.offset, p.size)] == frames
    assert p.timestamp_ns[0] == 8_000_000 and not any(p.key_frame)


def test_unknown_sizes():
    cluster = lambda t, body, size: m.CLUSTER.to_bytes(4, "big") + size + m.number(m.TIME, t) + m.element(m.SIMPLE, m.block(1, 0, [body], 0))
    media = m.SEGMENT.to_bytes(4, "big") + b"\xff" + m.element(m.TRACKS, m.element(m.ENTRY, m.number(m.NUMBER, 1))) + cluster(0, b"abc", b"\x01" + b"\xff" * 7) + cluster(9, b"de", b"\xff")
    p = m.Reader(media).read()
    assert p.payload(media) == b"abcde" and p.clusters == 2 and p.timestamp_ns == [0, 9_000_000]


def test_stored_and_read(corpus, make):
    out = {(str(r.doc_id), r.payload_sha256): r for r in m.store_and_read(corpus, keep_media=True).collect()}
    for r in corpus.collect():
        body = (r.text or "").encode()
        payload = body + b" " * (-len(body) % 192 if body else 192)
        x = out[str(r.doc_id), hashlib.sha256(payload).hexdigest()]
        assert (x.n_bytes, x.payload_bytes, x.tail_crc32, x.media_bytes) == (len(body), len(payload), zlib.crc32(payload[-16:]), len(x.media))
        assert x.media_sha256 == hashlib.sha256(x.media).hexdigest()
        p = m.Reader(bytes(x.media)).read()
        assert all(x.media[at : at + 4] == m.CLUSTER.to_bytes(4, "big") for _, _, at in p.cues) and len(p.cues) == p.clusters
    assert m.store_and_read(make([])).count() == 0


def test_packet_table(spark):
    media = m.write_audio(bytes(range(192)) * 200)
    rows = spark.createDataFrame([(1, media, 5), (2, None, 5), (1, media, 5)], "k long, f binary, size long")
    out = m.packet_table(rows, "k", "f").collect()
    assert len(out) == 400 and {r.size for r in out} == {192} and max(r.timestamp_ns for r in out) == 199 * 24_000_000
    with pytest.raises(Exception, match="file 9"):
        m.packet_table(spark.createDataFrame([(9, media[:-5])], "k long, f binary"), "k", "f").collect()


CHAT = "conv_id long, turn long, role string, text string, depth string"


def test_threads(spark):
    rows = [
        (1, 0, "a", "Hello there\nHow are you?"),
        (1, 1, "b", "On Monday a wrote:\n> Hello there\n> How are you?\nFine thanks"),
        (1, 2, "c", "Other topic"),
        (1, 3, "a", "> > how   are YOU?\n> Fine thanks\n\nGreat"),
        (1, 4, "d", "> Other topic\nyes"),
        (1, 5, "e", "> nobody said this\nno"),
        (2, 0, "z", "> Other topic\nfrom elsewhere"),
        (2, 1, "z", None),
        (2, 1, "z", None),
        (None, 1, "q", "> Hello there"),
        (3, 0, None, ""),
        (4, 0, "a", "wrote:\nplain, it introduces nothing: b wrote:"),
    ]
    out = quote_threads.link_quotes(spark.createDataFrame([(*r, "clash") for r in rows], CHAT)).collect()
    got = {(r.conv_id, r.turn): (r.copies, r.reply_conv, r.reply_turn, r.thread_turn, r.depth, r.position, r.body) for r in out}
    assert got == {
        (1, 0): (1, None, None, 0, 0, 1, "Hello there\nHow are you?"),
        (1, 1): (1, 1, 0, 0, 1, 2, "Fine thanks"),
        (1, 3): (1, 1, 1, 0, 2, 3, "Great"),
        (1, 2): (1, None, None, 2, 0, 4, "Other topic"),
        (1, 4): (1, 1, 2, 2, 1, 5, "yes"),
        (1, 5): (1, None, None, 5, 0, 6, "no"),
        (2, 0): (1, 1, 2, 0, 1, 1, "from elsewhere"),
        (2, 1): (2, None, None, 1, 0, 2, ""),
        (None, 1): (1, None, None, 1, 0, None, ""),
        (3, 0): (1, None, None, 0, 0, 1, ""),
        (4, 0): (1, None, None, 0, 0, 1, "wrote:\nplain, it introduces nothing: b wrote:"),
    }
    assert quote_threads.link_quotes(spark.createDataFrame([], CHAT)).count() == 0
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64"})  # noqa: F841
    sql = duckdb.connect().execute(OP4.replace("FROM conversations", "FROM (SELECT conv_id::BIGINT AS conv_id, turn, role, text FROM conversations)")).fetchall()
    assert sorted(map(str, sql)) == sorted(str(tuple(r)) for r in out)


def test_long_chains_and_positions(spark):
    """Each message quotes the one before: depths follow by doubling, places across ranges of turns."""
    rows = [(7, i, "u", (f"> message number {i - 1}\n" if i and i % 50 else "") + f"message number {i}", "") for i in range(2200)]
    out = quote_threads.link_quotes(spark.createDataFrame(rows, CHAT)).orderBy("turn").collect()
    assert [r.depth for r in out] == [i % 50 for i in range(2200)]
    assert [r.thread_turn for r in out] == [i - i % 50 for i in range(2200)]
    assert [r.position for r in out] == list(range(1, 2201))
