"""The whole pipeline against brute force over a small corpus."""

import random

import pytest
import tiktoken

import corpus_pipeline
from tessera.llm import bpe, pareto_mix

from .test_near_copies import slow_components
from .test_suffix import slow_passages


@pytest.fixture
def folder(spark, make, words, tmp_path):
    rng = random.Random(12)
    passage = words(56, "shared")
    rows, labels = [], []
    for i in range(160):
        text = words(40 + i % 60, i).split()
        if toxic := i % 4 == 0:
            for bad in rng.sample(["blarghful", "vexxonic", "grumblot"], 2):
                text.insert(rng.randrange(len(text)), bad)
        rows.append((i, " ".join(text), f"s{i % 3}"))
        labels.append((i, int(toxic)))
    rows += [(200 + i, f"{words(30, 900 + i)} {passage} {words(70, 950 + i)}", "s1") for i in range(4)]
    rows += [(300 + i, t, "s0") for i, t, _ in rows[1:20:6]] + [(400, None, None), (401, "", "s2"), (402, rows[5][1] + " more", "s2")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), passage


def test_run(spark, folder):
    import public_tokenizers

    where, passage = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    clean = {r.doc_id: r for r in corpus_pipeline.drop_toxic(spark, docs, where).collect()}
    marked = [r.doc_id for r in docs.collect() if any(x in (r.text or "") for x in ("blarghful", "vexxonic", "grumblot"))]
    assert sum(i in clean for i in marked) <= 0.1 * len(marked)
    assert len(clean) >= 0.8 * (docs.count() - len(marked)), len(clean)
    kept = sorted({low for _, low in slow_components([(i, r.text) for i, r in sorted(clean.items())])})
    assert len(kept) < len(clean)
    cut = dict(zip(kept, slow_passages([clean[i].text or "" for i in kept], 51, 400)))
    assert not any(passage in t for t in cut.values())
    left = spark.createDataFrame([(i, None if clean[i].text is None else cut[i], clean[i].source) for i in kept], "doc_id long, text string, source string")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in pareto_mix.mix(left).collect():
        want += [(r.doc_id, len(encoding.encode_ordinary(cut[r.doc_id])))] * (r.copies if r.size else 1)
    got = [(r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, where).collect()]
    assert sorted(got) == sorted(want)
