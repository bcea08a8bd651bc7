import random
import re
from collections import defaultdict

import pytest

from tessera.llm import suffix_array, suffix_dedup


@pytest.mark.parametrize("length", [3, 7, 10, 23])
def test_repeated_strings(length):
    rng = random.Random(length)
    for _ in range(60):
        letters = rng.choice([1, 2, 3, 200])
        texts = [bytes(rng.randrange(letters) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(1, 6))]
        texts += [texts[0][5:] + texts[-1], texts[0]]
        starts, place, group = suffix_array.repeated(texts, length)
        uses = defaultdict(list)
        for i, t in enumerate(texts):
            for p in range(len(t) - length + 1):
                uses[t[p : p + length]].append(int(starts[i]) + p)
        got = defaultdict(list)
        for p, g in zip(place.tolist(), group.tolist()):
            got[g].append(p)
        assert sorted(map(sorted, got.values())) == sorted(v for v in uses.values() if len(v) > 1)


def slow(texts, length):
    bodies = [(t or "").encode() for t in texts]
    uses = defaultdict(int)
    for b in bodies:
        for p in range(len(b) - length + 1):
            uses[b[p : p + length]] += 1
    out = []
    for b in bodies:
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if uses[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        out.append((len(b), sum(mark), len([x for x in bytes(mark).split(b"\0") if x]), bytes(x for x, m in zip(b, mark) if not m)))
    return out


@pytest.mark.parametrize("spread", [1 << 20, 2500])
def test_spans_against_brute_force(corpus, make, spread, monkeypatch):
    """Also with so little room in a shard that anchors are spread over many and merged."""
    monkeypatch.setattr(suffix_dedup, "SPREAD", spread)
    passage = corpus.where("doc_id = 9").first().text[:900]
    rows = [(r.doc_id, r.text) for r in corpus.collect()] + [(100 + k, f"{k} {k * 7} " * 20 + passage + f" end {k}" * 30) for k in range(12)] + [(200, "a" * 1500), (201, "ab" * 900)]
    docs = make(rows)
    held = suffix_dedup.with_removed(docs).collect()
    got = []
    for r in held:
        body, pairs = (r.row.text or "").encode(), suffix_dedup.pairs_of(r.removed)
        kept = suffix_dedup.cut_out(body, pairs)
        got.append((r.row.doc_id, (len(body), len(body) - len(kept), len(pairs), kept)))
    assert sorted(got, key=str) == sorted(zip([r[0] for r in rows], slow([r[1] for r in rows], 400)), key=str)


def test_texts_are_cut_and_columns_stay(corpus, make):
    out = suffix_dedup.remove_repeats(corpus)
    assert out.schema == corpus.schema and out.count() == corpus.count()
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text == by[2].text == "" and by[1].n_chars == 0 and by[5].text is None and by[8].text == "one two"
    assert suffix_dedup.remove_repeats(make([])).count() == 0


def test_any_column_names(make):
    """Columns called like those that the operator makes."""
    names = ["row", "text_key", "removed", "passages", "anchor", "digest", "list", "body", "_removed", "_key", "_its", "at"]
    docs = make([(1, "ab" * 300), (2, "ab" * 300), (2, "ab" * 300), (3, None)])
    wide = docs.selectExpr("*", *[f"'{x}' as {x}" for x in names])
    out = suffix_dedup.remove_repeats(wide, words=51)
    assert out.columns == wide.columns
    assert sorted(((r.doc_id, r.text, r.n_chars, r.removed, r.at) for r in out.collect()), key=str) == [(1, "", 0, "removed", "at"), (2, "", 0, "removed", "at"), (2, "", 0, "removed", "at"), (3, None, 0, "removed", "at")]
    assert suffix_dedup.remove_repeats(wide.limit(0), words=51).count() == 0


def test_a_shard_that_is_too_large_is_an_error():
    with pytest.raises(ValueError, match="shard"):
        suffix_array.repeated([bytes(1 << suffix_array.BITS)], 400)


def test_words_and_their_codes(monkeypatch):
    rng = random.Random(3)
    body = "".join(rng.choices("abé \n\t\x1c", k=3000)).encode()
    assert [body[a:b] for a, b in suffix_dedup.word_places(body)] == body.split()
    whole = suffix_dedup.word_codes(body)
    by = defaultdict(set)
    for word, code in zip(body.split(), whole.tolist(), strict=True):
        by[word].add(code)
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)
    monkeypatch.setattr(suffix_dedup, "PIECE", 7)
    assert suffix_dedup.word_codes(body).tolist() == whole.tolist()
    assert len(suffix_dedup.word_codes(b"")) == 0 and len(suffix_dedup.word_places(b"  ")) == 0


def slow_passages(texts, words, length):
    """Texts without strings of so many bytes or passages of so many words that occur twice."""
    bodies, split = [t.encode() for t in texts], [list(re.finditer(r"\S+", t)) for t in texts]
    uses, strings = defaultdict(int), defaultdict(int)
    for b, ms in zip(bodies, split):
        for p in range(len(b) - length + 1):
            strings[b[p : p + length]] += 1
        for k in range(len(ms) - words + 1):
            uses[tuple(m.group() for m in ms[k : k + words])] += 1
    out = []
    for t, b, ms in zip(texts, bodies, split):
        mark = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if strings[b[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        for k in range(len(ms) - words + 1):
            if uses[tuple(m.group() for m in ms[k : k + words])] > 1:
                x, y = len(t[: ms[k].start()].encode()), len(t[: ms[k + words - 1].end()].encode())
                mark[x:y] = b"\1" * (y - x)
        out.append(bytes(x for x, m in zip(b, mark) if not m).decode("utf-8", "ignore"))
    return out


def test_short_passages_of_many_words_are_cut(make):
    """Passages of 51 words under 400 bytes, one of 50 that stays, one spaced otherwise, one of over 400 bytes."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    short, less, wide, long = (" ".join(rng.choices("xyzäqp", k=n)) for n in (51, 50, 60, 300))
    texts = [text(70) + " " + p + " " + text(80) for p in (short, short, less, less, wide, long, long)] + [text(9) + "\n" + wide.replace(" ", "  ") + "\t" + text(90), "", short]
    docs = make(list(enumerate(texts)))
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, words=51).collect()}
    want = slow_passages(texts, 51, 400)
    assert [out[i].text for i in range(len(texts))] == want
    assert all(out[i].n_chars == len(want[i]) for i in range(len(texts)))
    assert short not in out[0].text and less in out[2].text
