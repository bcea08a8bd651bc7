import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_score, toxicity
from tessera.llm.common import fold, utf8


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    unigram = np.full(40, 1 / 40)
    model = lm_score.LogBilinear.start(unigram)
    trainer = lm_score.Trainer(model, unigram, 1)
    # each word follows from the one before
    w = np.cumsum(rng.integers(1, 3, 60_000)) % 40
    a, b, w = w[1:-1], w[:-2], w[2:]
    for k in range(0, len(w) - 2048, 2048):
        trainer.step(w[k : k + 2048], a[k : k + 2048], b[k : k + 2048])
    x, y = np.arange(40), np.arange(40)[::-1].copy()
    for i in range(40):
        p = [np.exp(model.log_probability(np.array([v]), x[i : i + 1], y[i : i + 1]))[0] for v in range(40)]
        assert sum(p) == pytest.approx(1, abs=1e-4)
    assert model.log_probability(w, a, b).mean() > math.log(1 / 40) + 0.5


def test_scores_against_brute_force(corpus, make):
    training = corpus.where(F.coalesce(fold() != 1, F.lit(True))).select(utf8().alias("body"))
    out = lm_score.score(corpus, training).collect()
    counts = Counter()
    for r in training.collect():
        counts.update(lm_score.tokens(bytes(r.body)))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in corpus.collect():
        words = (r.text or "").encode().lower().split() + [b""]
        want.append((r.doc_id, len(words), sum(counts[w] > 0 for w in words), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), 6)))
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out], key=str) == sorted(want, key=str)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    none = lm_score.score(corpus, training.limit(0)).collect()
    assert len(none) == corpus.count() and all(r.n_known == 0 and math.isfinite(r.score) for r in none)
    assert lm_score.score(make([]), training).count() == 0


def test_frequent_words(spark):
    counts = spark.createDataFrame([(f"w{i:03d}".encode(), 1 + 1000 // (i + 1)) for i in range(300)] + [(b"", 9999)], "word binary, c long")
    got = lm_score.frequent(counts, 40)
    assert 20 <= len(got) <= 40 and got == sorted([(f"w{i:03d}".encode(), 1 + 1000 // (i + 1)) for i in range(len(got))], key=lambda x: (-x[1], x[0]))
    assert len(lm_score.frequent(counts, 10_000)) == 300
    same = spark.createDataFrame([(f"w{i:03d}".encode(), 7) for i in range(30)], "word binary, c long")
    assert [w for w, _ in lm_score.frequent(same, 5)] == [f"w{i:03d}".encode() for i in range(5)]
    assert lm_score.frequent(counts.limit(0), 5) == []


def test_folds_are_crc32(spark):
    rows = spark.range(50).select(F.col("id").alias("doc_id")).select("doc_id", fold().alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def _labelled(words, n=400):
    rng = random.Random(8)
    for i in range(n):
        body = words(30 + i % 50, i).split()
        toxic = i % 4 == 0
        if toxic:
            for bad in rng.sample(["blarghful", "vexxonic", "grumblot"], 2):
                body.insert(rng.randrange(len(body)), bad)
        yield i, " ".join(body), int(toxic)


def test_toxic_texts_are_found_and_clean_ones_left(words):
    rows = [(t.encode(), y, i % 5 == 4) for i, t, y in _labelled(words) if i % 5]
    model = toxicity.fit(rows)
    held = [(t.encode(), y) for i, t, y in _labelled(words) if i % 5 == 0]
    hit = [model.score(t) >= 0.5 for t, y in held if y]
    false = [model.score(t) >= 0.5 for t, y in held if not y]
    assert np.mean(hit) > 0.9 and np.mean(false) < 0.05
    assert 0 <= model.score(b"") < 0.5
    # a passage in a long text counts wherever it stands
    assert model.score(b"an the tion " * 3000 + b"blarghful vexxonic grumblot" + b" er is ou" * 3000) >= 0.5


def test_toxicity_over_tables(spark, make, words):
    rows = list(_labelled(words, 120))
    docs = make([(i, t) for i, t, _ in rows] + [(500, None), (501, ""), (None, "the tion"), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (3, 0)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels)
    assert all(len(x) == 3 for x in sample) and len(sample) > 60
    model = toxicity.fit(sample)
    out = toxicity.score_texts(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    kept = toxicity.keep_clean(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(1 - r.predicted for r in out)
    with pytest.warns(UserWarning):
        nothing = toxicity.fit([])
    assert nothing.score(b"blarghful") == 0
    assert toxicity.score_texts(make([]), nothing).count() == 0


def test_long_labelled_texts_leave_the_others_in_the_sample(spark, make, words, monkeypatch):
    """The first toxic and the first ordinary text are longer than all texts of a label may be."""
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 60_000)
    rows = list(_labelled(words, 240))
    ids = spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long").select("doc_id", F.xxhash64(F.lit(5), "doc_id").alias("place"), fold().alias("f")).collect()
    place = {r.doc_id: r.place for r in ids if r.f != 0}
    toxic = {i: y for i, _, y in rows}
    first = {min((i for i in place if toxic[i] == y), key=place.get) for y in (0, 1)}
    docs = make([(i, " ".join([t] * (80_000 // len(t) + 1)) if i in first else t) for i, t, _ in rows])
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels)
    assert len(sample) == len(place)
    assert all(sum(len(t) for t, y, _ in sample if y == k) <= 60_000 for k in (0, 1))
    model = toxicity.fit(sample)
    held = [(t.encode(), y) for i, t, y in rows if i not in place]
    assert np.mean([model.score(t) >= 0.5 for t, y in held if y]) > 0.9
    assert np.mean([model.score(t) >= 0.5 for t, y in held if not y]) < 0.05


def test_scores_against_plain_compression(words):
    """Distances from frames that zstandard makes without prepared tables, window by window."""
    rows = [(t.encode(), y, i % 5 == 4) for i, t, y in _labelled(words, 200) if i % 5]
    model = toxicity.fit(rows)
    assert model.toxic and model.ordinary and model.base and model.toxic != model.ordinary

    def slow(text):
        sizes = []
        for at in range(0, max(1, len(text) - 64 + 48), 48):
            window = text[at : at + 64]
            both = []
            for side in (model.ordinary, model.toxic):
                settings = toxicity.zstandard.ZstdCompressionParameters(format=1, write_content_size=0, write_checksum=0, write_dict_id=0, **toxicity._PARAMETERS)
                held = toxicity.zstandard.ZstdCompressionDict(side + model.base, dict_type=toxicity.zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=settings)
                both.append(len(toxicity.zstandard.ZstdCompressor(compression_params=settings, dict_data=held).compress(window)))
            sizes.append(both[0] - both[1])
        far = sum(sorted((x for x in sizes if x > 0), reverse=True)[:3])
        return 1 / (1 + math.exp(model.threshold - far))

    texts = [t for t, _, _ in rows[:25]] + [b"", b"x", rows[3][0] * 3]
    assert [model.score(t) for t in texts] == pytest.approx([slow(t) for t in texts])


def test_dictionaries_come_from_windows_of_their_own_class(words):
    rows = [(t.encode(), y, i % 5 == 4) for i, t, y in _labelled(words) if i % 5]
    model = toxicity.fit(rows)
    assert any(x in model.toxic for x in (b"blargh", b"vexxon", b"grumbl"))
    assert not any(x in model.ordinary + model.base for x in (b"blargh", b"vexxon", b"grumbl"))
    again = toxicity.fit(rows)
    assert (again.toxic, again.ordinary, again.base, again.threshold) == (model.toxic, model.ordinary, model.base, model.threshold)


@pytest.mark.parametrize("label", [0, 1])
def test_without_one_class_there_is_a_warning_and_no_score(label):
    with pytest.warns(UserWarning, match="learn from"):
        model = toxicity.fit([(b"some text of one class", label, False)] * 5)
    assert model.score(b"some text") == 0.0
