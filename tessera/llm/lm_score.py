"""Language-model scoring with a log-bilinear neural model.

Counts of all training tokens are taken exactly.  The most frequent tokens are
outputs of their own, every other token belongs to a class of rare words by its
last two bytes; inside a class a word has its smoothed share of the class's
training tokens.  The model predicts the vector of the next output as a weighted
sum of the vectors of the two before it (Mnih and Hinton, 2007) and is trained by
noise-contrastive estimation: every task runs over its share of the training
texts from the same start, and the parameters are averaged by tokens seen.
Scores use the true normaliser of each context, from batched matrix products.

Words that are in no task's table of frequent words are joined to their counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, fold, table, tasks_for, utf8

#: Outputs of their own, classes of rare words, dimensions, noise words of a batch, tokens of a batch.
OUTPUTS, CLASSES, DIMENSIONS, NOISE, BATCH = 1024, 64, 16, 32, 8192
#: Frequent words that each task knows the counts of; entries that a task counts or remembers before it lets go.
HEAD, HELD = 150_000, 250_000
RATE, SLICES = 0.15, 64
END = b""


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words and the end."""
    words = text.lower().split()
    words.append(END)
    return words


def _class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[bytes] = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column("body"):
            held.update(tokens(text.as_py()))
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def word_counts(training: DataFrame) -> DataFrame:
    """word binary (empty: the end), c long: exact counts over all rows' ``body``."""
    return training.select("body").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for batch in batches:
        k = np.fromiter((_class(w) for w in batch.column("word").to_pylist()), np.int64, batch.num_rows)
        total += np.bincount(k, weights=batch.column("c").to_numpy(), minlength=CLASSES).astype(np.int64)
        distinct += np.bincount(k, minlength=CLASSES)
    yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(total), pa.array(distinct)], names=["class", "total", "distinct"])


@dataclass
class Vocabulary:
    """Counts of the frequent words, of the classes, and of everything."""

    words: list[bytes]
    counts: list[int]
    all_tokens: int
    all_words: int
    class_total: np.ndarray
    class_words: np.ndarray
    outputs: int = 0

    def __post_init__(self):
        self.outputs = min(OUTPUTS, len(self.words))

    @property
    def size(self) -> int:
        return self.outputs + CLASSES

    def ids(self) -> _Ids:
        return _Ids(self)

    def unigram(self) -> np.ndarray:
        c = np.concatenate([self.counts[: self.outputs], self.class_total]) + 0.5
        return c / c.sum()


class _Ids(dict):
    """Output of a word; words that are not outputs are sorted into their class when first met."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__((w, k) for k, w in enumerate(vocabulary.words[: vocabulary.outputs]))
        self.base, self.most = vocabulary.outputs, HELD

    def __missing__(self, word: bytes) -> int:
        k = self.base + _class(word)
        if len(self) < self.most:
            self[word] = k
        return k


def frequent(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """At most ``most`` words by falling count, with their counts: all that are as frequent as a threshold.

    The threshold comes from numbers of words by the logarithm of their count, a
    few hundred rows; so the tasks send what is taken and no heaps to merge.
    """
    size = F.floor(F.log2("c") * 16).cast("int")
    words = counts.where(F.col("word") != END).withColumn("size", size)
    bins = sorted(((r["size"], r.n) for r in words.groupBy("size").agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for k, n in bins:
        if total + n > most:
            break
        total, least = total + n, k
    if least is None and bins:  # more words than that are equally frequent
        taken = words.where(F.col("size") == bins[0][0]).orderBy(F.desc("c"), "word").limit(min(OUTPUTS, most)).collect()
    else:
        taken = words.where(F.col("size") >= F.lit(least)).collect()
    return sorted(((bytes(r.word), r.c) for r in taken), key=lambda x: (-x[1], x[0]))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The end comes first, then words by falling count; bounded by HEAD and CLASSES."""
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    rows = [(bytes(r.word), r.c) for r in counts.where(F.col("word") == END).collect()] + frequent(counts)
    words, numbers = [w for w, _ in rows], [c for _, c in rows]
    sums = counts.mapInArrow(_class_sums, "class int, total long, distinct long").groupBy("class").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"))
    total, distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sums.collect():
        total[r["class"]], distinct[r["class"]] = r["total"], r["distinct"]
    for word, c in list(zip(words, numbers))[:OUTPUTS]:
        total[_class(word)] -= c
        distinct[_class(word)] -= 1
    return Vocabulary(words, numbers, n, v, total, distinct)


@dataclass
class LogBilinear:
    """Vectors of contexts (the last row: before the text) and outputs, weights of the two places, biases."""

    context: np.ndarray
    output: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray
    _log_z: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 11) -> LogBilinear:
        rng, n, d = np.random.default_rng(seed), len(unigram), DIMENSIONS
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(small(n + 1, d), small(n, d), np.ones(d, np.float32), np.full(d, 0.5, np.float32), np.log(unigram).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.output, self.near, self.far, self.bias)])

    def like(self, flat: np.ndarray) -> LogBilinear:
        out, at = [], 0
        for x in (self.context, self.output, self.near, self.far, self.bias):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return LogBilinear(*out)

    def hidden(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.context[a] * self.near + self.context[b] * self.far

    def log_normaliser(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log of the sum over all outputs, kept for each pair of contexts once met."""
        n = len(self.context)
        if self._log_z is None:
            self._log_z = np.full(n * n, np.nan, np.float32)
        pair = a * n + b
        new = np.unique(pair[np.isnan(self._log_z[pair])])
        for k in range(0, len(new), 2048):
            part = new[k : k + 2048]
            s = self.hidden(part // n, part % n) @ self.output.T
            s += self.bias
            most = s.max(axis=1)
            s -= most[:, None]
            self._log_z[part] = most + np.log(np.exp(s, out=s).sum(axis=1))
        return self._log_z[pair]

    def log_probability(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Natural log of the probability of outputs w after a (just before) and b (before that)."""
        s = np.einsum("ij,ij->i", self.hidden(a, b), self.output[w]) + self.bias[w]
        return s.astype(np.float64) - self.log_normaliser(a, b)


class Trainer:
    """Noise-contrastive estimation with AdaGrad; noise words come from the unigram and serve a whole batch."""

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int):
        self.m = model
        self.rng = np.random.default_rng(seed)
        self.unigram = unigram
        self.cumulated = np.cumsum(unigram)
        self.shift = np.log(NOISE * unigram).astype(np.float32)
        self.sums = [np.full(x.shape, 0.1, np.float32) for x in (model.context, model.output, model.near, model.far, model.bias)]

    @staticmethod
    def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        d = values.shape[1]
        at = (rows[:, None] * d + np.arange(d)).ravel()
        return np.bincount(at, weights=values.ravel(), minlength=n * d).reshape(n, d).astype(np.float32)

    def step(self, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        m, n = self.m, len(self.unigram)
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), n - 1)
        va, vb, q, qn = m.context[a], m.context[b], m.output[w], m.output[noise]
        h = va * m.near + vb * m.far
        s = np.einsum("ij,ij->i", h, q) + m.bias[w] - self.shift[w]
        g = 1 / (1 + np.exp(np.clip(s, -30, 30)))
        sn = h @ qn.T + (m.bias[noise] - self.shift[noise])
        gn = -1 / (1 + np.exp(np.clip(-sn, -30, 30)))
        dh = g[:, None] * q + gn @ qn
        dq = self._scatter(w, g[:, None] * h, n)
        np.add.at(dq, noise, gn.T @ h)
        db = np.bincount(w, weights=g, minlength=n).astype(np.float32)
        np.add.at(db, noise, gn.sum(axis=0))
        dc = self._scatter(np.concatenate([a, b]), np.concatenate([dh * m.near, dh * m.far]), n + 1)
        grads = dc, dq, (dh * va).sum(axis=0), (dh * vb).sum(axis=0), db
        for x, s2, d in zip((m.context, m.output, m.near, m.far, m.bias), self.sums, grads):
            d /= len(w) ** 0.5
            s2 += d * d
            x += RATE * d / np.sqrt(s2)


def _stream(texts: list[bytes], get, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Outputs of all tokens of the texts, the two before each, and each text's number of tokens."""
    lists = [list(map(get, tokens(t))) for t in texts]
    sizes = np.array([len(x) for x in lists], np.int64)
    w = np.fromiter((k for x in lists for k in x), np.int64, int(sizes.sum()))
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    a = np.concatenate([[start], w[:-1]])
    b = np.concatenate([[start, start], w[:-2]])[: len(w)]
    a[first] = start
    b[first] = start
    second = first + 1
    b[second[sizes > 1]] = start
    return w, a, b, sizes


def _pieces(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def train(training: DataFrame, words: Vocabulary, rounds: int = 1) -> LogBilinear:
    """A model from all rows' ``body``; what each task sends is the model's size, summed slice by slice."""
    spark = training.sparkSession
    unigram = words.unigram()
    model = LogBilinear.start(unigram)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((words.words[:OUTPUTS], words.counts[:OUTPUTS], words.class_total, model))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, k=k) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            known, counts, class_total, first = shared.value
            its = Vocabulary(known, counts, 0, 0, class_total, class_total)
            own = first.like(first.flat())
            trainer = Trainer(own, its.unigram(), 1000 * k + TaskContext.get().partitionId())
            get, seen, rest = its.ids().__getitem__, 0, None
            for batch in batches:
                for texts in _pieces(batch.column("body").to_pylist(), 1 << 19):
                    w, a, b, _ = _stream(texts, get, its.size)
                    if rest is not None:
                        w, a, b = (np.concatenate(x) for x in zip(rest, (w, a, b)))
                    full = len(w) // BATCH * BATCH
                    for i in range(0, full, BATCH):
                        trainer.step(w[i : i + BATCH], a[i : i + BATCH], b[i : i + BATCH])
                    seen += full
                    rest = w[full:], a[full:], b[full:]
            if rest is not None and len(rest[0]):
                trainer.step(*rest)
                seen += len(rest[0])
            if seen:
                parts = np.array_split(own.flat().astype(np.float64) * seen, SLICES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(SLICES), pa.int32()), pa.array([seen] * SLICES, pa.int64()), pa.array([p.astype("<f8").tobytes() for p in parts], pa.binary())],
                    names=["slice", "seen", "part"],
                )

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for i, seen, part in zip(*(c.to_pylist() for c in batch.columns)):
                    part = np.frombuffer(part, "<f8")
                    if i in sums:
                        sums[i] = [sums[i][0] + seen, sums[i][1] + part]
                    else:
                        sums[i] = [seen, part]
            for i, (seen, part) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([seen], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["slice", "seen", "part"])

        spec = "slice int, seen long, part binary"
        sums = training.select("body").mapInArrow(run, spec).repartition(min(SLICES, tasks_for(spark)), "slice").mapInArrow(add, spec).collect()
        if not sums:
            return model
        model = model.like(np.concatenate([np.frombuffer(r.part, "<f8") / r.seen for r in sorted(sums)]))
    return model


class Scorer:
    """Sums over the tokens of texts, but for the counts of words outside the table of frequent ones."""

    def __init__(self, words: Vocabulary, model: LogBilinear):
        self.words, self.model = words, model
        self.get = words.ids().__getitem__
        self.counts = dict(zip(words.words, words.counts))
        self.below = math.log10(words.all_tokens + 0.5 * (words.all_words + 1))
        self.class_below = np.log10(words.class_total + 0.5 * (words.class_words + 1))

    def __call__(self, texts: list[bytes]) -> list[tuple]:
        """(tokens, known, base, score, rare words, their numbers) of each text."""
        w, a, b, sizes = _stream(texts, self.get, self.words.size)
        log_p = self.model.log_probability(w, a, b) / math.log(10)
        rare = w >= self.words.outputs
        log_p[rare] -= self.class_below[w[rare] - self.words.outputs]
        ends = np.cumsum(sizes)
        sums = np.add.reduceat(log_p, ends - sizes)
        out, counts, top = [], self.counts, self.words.outputs
        logs = self._logs()
        for text, n, model in zip(texts, sizes.tolist(), sums.tolist()):
            found = Counter(tokens(text))
            base, known, words, numbers = 0.0, 0, [], []
            for word, tf in found.items():
                log_c = logs.get(word)
                if log_c is None:
                    words.append(word)
                    numbers.append(tf)
                else:
                    base += tf * log_c[0]
                    model += tf * log_c[1]
                    known += tf
            out.append((n, known, base - n * self.below, model, words, numbers))
        return out

    def _logs(self) -> dict[bytes, tuple[float, float]]:
        """log10(c + 0.5) of a frequent word, once for the base and once, unless it is an output, for its class."""
        if not hasattr(self, "_kept"):
            self._kept = {}
            for k, (word, c) in enumerate(self.counts.items()):
                log_c = math.log10(c + 0.5)
                self._kept[word] = (log_c, log_c if k >= self.words.outputs else 0.0)
        return self._kept


_ROWS = pa.schema(
    [("rid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("words", pa.list_(pa.binary())), ("numbers", pa.list_(pa.int32()))]
)


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: a row for each row of ``docs``.

    ``training`` holds ``body`` binary.  A null text is empty and has the end
    alone.  Without training rows every token is unknown.  Repeated rows and null
    ids keep their rows; other columns are ignored.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "lm")
    counts = staged(word_counts(training), "counts")
    words = vocabulary(counts)
    model = train(training, words, rounds)
    shared = spark.sparkContext.broadcast((words, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scorer = Scorer(*shared.value)
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, bodies = batch.column("doc_id").to_pylist(), batch.column("body").to_pylist()
            done = 0
            for texts in _pieces(bodies, 1 << 19):
                rows = scorer(texts)
                columns = [range(rid, rid + len(rows)), ids[done : done + len(rows)], *zip(*rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS)], schema=_ROWS)
                rid += len(rows)
                done += len(rows)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    spec = "rid long, doc_id long, n_tokens long, known long, base double, model double, words array<binary>, numbers array<int>"
    rows = staged(rows.mapInArrow(run, spec), "rows")
    rare = rows.select("rid", F.explode(F.arrays_zip("words", "numbers")).alias("x")).select("rid", F.col("x.words").alias("word"), F.col("x.numbers").alias("tf"))
    log_c = F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    more = rare.join(counts, "word", "left").groupBy("rid").agg(F.sum(F.col("tf") * log_c).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("also"))
    both = rows.drop("words", "numbers").join(more, "rid", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return both.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(words.all_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"),
        (F.col("model") + extra).alias("score"),
    )


def op8_lm_score(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for all of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # a row without id has no remainder and trains
    training = docs.where(F.coalesce(fold() != 1, F.lit(True))).select(utf8().alias("body"))
    scored = score(docs, training)
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
