import numpy as np
import pytest
import xxhash

from tessera.llm import components, simhash
from tessera.llm.common import Staged


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_components(values, ids):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(values)):
        groups.setdefault(find(i), []).append(ids[i])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [low[find(i)] for i in range(len(values))]


def test_fingerprints_and_components(corpus):
    rows = corpus.collect()
    out = simhash.simhash_components(corpus).collect()
    values = [slow_fingerprint(r.text) for r in rows]
    want = sorted(zip([r.doc_id for r in rows], values, slow_components(values, [r.doc_id for r in rows])), key=str)
    assert sorted([(r.doc_id, r.fp % 2**64, r.component_id) for r in out], key=str) == want


def test_trie_finds_every_link(spark, monkeypatch):
    """Small nodes, so that crowded ones are taken deeper, down to single fingerprints."""
    monkeypatch.setattr(simhash, "LEAF", 8)
    monkeypatch.setattr(simhash, "START", 4)
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    values = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (120, 2))} | {int(x) for x in rng.integers(0, 1 << 63, 60)} | {0, 1, 3, (1 << 64) - 1}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    staged = Staged(spark, "test")
    edges = simhash.trie_links(spark.createDataFrame([(v,) for v in signed], "fp long"), staged)
    found = {r.node: r.component for r in simhash.components(edges, staged).collect()}
    want = slow_components([v % 2**64 for v in signed], signed)
    assert [found.get(v, v) for v in signed] == want


@pytest.mark.parametrize("block", [5, 200_000])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, block):
    monkeypatch.setattr(components, "BLOCK", block)
    rng = np.random.default_rng(block)
    edges = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (45, 2))] + [(100 + i, 101 + i) for i in range(25)] + [(200, 201 + i) for i in range(25)]
    out = components.components(spark.createDataFrame(edges, "src long, dst long").repartition(4), Staged(spark, "test")).collect()
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(root)):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in out} == root and len(out) == len(root)


def test_one_of_each_component_stays(corpus, make):
    kept = simhash.keep_one(corpus)
    assert kept.columns == corpus.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    want = sorted({x for x in (r.component_id for r in simhash.simhash_components(corpus).collect())}, key=str)
    assert ids == want
    wide = corpus.selectExpr("*", *[f"'{x}' as {x}" for x in ("row", "i", "none", "digest", "_id", "_key", "_own", "_digest", "doc")])
    kept = simhash.keep_one(wide)
    assert kept.columns == wide.columns and sorted((r.doc_id for r in kept.collect()), key=str) == ids
    assert simhash.keep_one(make([])).count() == 0
    assert simhash.keep_one(make([(None, "a b c d"), (None, "a b c d"), (None, "e f g h i j")])).count() == 2
