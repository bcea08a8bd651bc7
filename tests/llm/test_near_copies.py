import random

import pytest

from tessera.llm import near_copies, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_components(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return sorted(((k, low.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def copies(words, n=30):
    """Texts with copies of which single words differ: some just within, some just beyond the similarity."""
    rng = random.Random(2)
    rows = []
    for i in range(n):
        base = words(rng.choice([20, 60, 150, 400]), i).split()
        rows.append(base)
        for k in (1, 2, 4, 8, 16):
            near = list(base)
            for at in rng.sample(range(len(base)), min(len(base), k)):
                near[at] = f"w{rng.randrange(9)}"
            rows.append(near)
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


@pytest.mark.parametrize("keys", [True, False])
def test_all_near_copies_are_found(corpus, make, words, keys, monkeypatch):
    """Also by prefixes alone, and with common shingles put last."""
    monkeypatch.setattr(near_copies, "SAMPLE", 2)
    if not keys:
        monkeypatch.setattr(near_copies, "_neighbours", nothing)
    line = " ".join(f"licence{i}" for i in range(30))
    rows = copies(words) + [(1000 + i, words(12 + i, 900 + i) + " " + line) for i in range(25)]
    rows += [(None if r.doc_id is None else 2000 + r.doc_id, r.text) for r in corpus.collect()]
    found = near_copies.near_components(make(rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == slow_components(rows)


def nothing(batches):
    for batch in batches:
        yield batch.rename_columns(["src", "dst"]).slice(0, 0)


def test_stage_keeps_one_of_each_group_of_near_copies(spark, make, words):
    """Copies with one word in twenty changed differ in more than two bits of their fingerprints."""
    import corpus_pipeline

    rows = copies(words)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, make(rows), "").collect())
    assert kept == sorted({low for _, low in slow_components(rows)})
    assert len(kept) < simhash.keep_one(make(rows)).count()
    assert corpus_pipeline.drop_near_copies(spark, make([]), "").count() == 0


def test_copies_of_one_text_that_are_not_alike_among_themselves(make, words, monkeypatch):
    """Each is similar enough to the original only; the number of pairs that are compared stays small."""
    rng = random.Random(6)
    base = words(300, 77).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        near = list(base)
        for at in rng.sample(range(0, 300, 6), 5):
            near[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(near)))
    seen = []
    check = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda pairs, *rest: seen.append(pairs.count()) or check(pairs, *rest))
    found = near_copies.near_components(make(rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == slow_components(rows)
    assert max(seen) <= 16 * len(rows)
