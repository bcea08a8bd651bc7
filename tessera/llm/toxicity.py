"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of toxic texts, the other on
windows of ordinary texts.  Each is a large *base*, trained on windows of ordinary
texts and the same for both, with a *side* in front of it:

* the ordinary side is trained on those windows of ordinary texts that so far look
  most toxic, so that what they have in common speaks for neither class;
* a text's label does not say which of its windows are toxic, so the toxic side is
  trained in rounds, on the windows of toxic texts that the dictionaries of the
  round before tell apart most, and then on narrower windows inside these.

Each window of a whole text is compressed with both dictionaries.  The bytes that the
toxic one saves, summed over the windows where it saves most, are the text's
distance.  The base has seen so much that ordinary windows come out equally long;
the threshold is calibrated on labelled rows that no dictionary has seen.

Null and empty texts have one empty window and are scored like any other; equal texts
score alike, whatever their ids.  A very long text is scored in all its windows.
Without toxic or without ordinary rows to learn from there is no model: a warning
says so and every text scores 0.  Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, table, utf8

#: Bytes of a window, and from one window's start to the next; windows whose distances add up.
WINDOW, STEP, BEST = 64, 48, 3
#: Widths and steps of the windows that the toxic side is trained on, one after the other; rounds of that; windows of a text that a side is trained on.
NARROWER, ROUNDS, PICKED = ((24, 6),), 3, 12
#: Bytes of the base and of each side; lengths of their segments and of the strings counted in them.
BASE, SIDE, BASE_SEGMENT, BASE_STRING, SEGMENT, STRING = 4_000_000, 24_576, 64, 8, 16, 6
#: Bounds of the labelled sample that the model is fitted on: rows of each label, and bytes of each label's texts; and the pieces that stand for a text too long for that.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES, PIECE = 6_000, 9_000, 12_000_000, 512
#: In calibration, what the share of clean texts rejected weighs against the share of toxic texts caught.
CLEAN_WEIGHT = 3
#: The compressor's table sizes and effort; by zstandard's own names.
_PARAMETERS = {"window_log": 23, "hash_log": 21, "chain_log": 21, "search_log": 5, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}


def windows(text: bytes, width: int = WINDOW, step: int = STEP) -> list[bytes]:
    """Windows that cover the whole text; an empty text has one, empty."""
    return [text[i : i + width] for i in range(0, max(1, len(text) - width + step), step)]


def trained(samples: list[bytes], size: int, segment: int, string: int) -> bytes:
    """A zstandard dictionary trained on the samples; samples too few to train on are the dictionary, as far as SIDE."""
    samples = [x for x in samples if len(x) >= 8]
    # the trainer takes segments from one stretch of samples after the other, so no stretch may be one text's
    samples = [samples[i] for i in np.random.default_rng(7).permutation(len(samples)).tolist()]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=string).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-SIDE:]


@dataclass
class Model:
    """The two sides, the base that both dictionaries share, and the calibrated threshold of the distance."""

    toxic: bytes
    ordinary: bytes
    base: bytes
    threshold: float = 0.5
    fitted: bool = True
    _pair: tuple | None = None

    def __getstate__(self):
        return self.toxic, self.ordinary, self.base, self.threshold, self.fitted

    def __setstate__(self, state):
        self.toxic, self.ordinary, self.base, self.threshold, self.fitted = state
        self._pair = None

    def compressors(self) -> tuple:
        if self._pair is None:
            settings = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, **_PARAMETERS)
            made = []
            for side in (self.toxic, self.ordinary):
                held = zstandard.ZstdCompressionDict(side + self.base, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=settings)
                made.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=held).compress)
            self._pair = tuple(made)
        return self._pair

    def saved(self, pieces: list[bytes]) -> list[int]:
        """Bytes that the toxic dictionary saves on each piece; negative where the ordinary one is better."""
        toxic, ordinary = self.compressors()
        return [len(ordinary(x)) - len(toxic(x)) for x in pieces]

    def distance(self, text: bytes) -> int:
        """What the toxic dictionary saves on the windows where it saves most; never negative."""
        return sum(x for x in nlargest(BEST, self.saved(windows(text))) if x > 0)

    def score(self, text: bytes) -> float:
        """0 to 1, 0.5 at the threshold."""
        if not self.fitted:
            return 0.0
        return 1 / (1 + math.exp(min(50.0, self.threshold - self.distance(text))))


def _telling(model: Model, pools: Iterable[list[bytes]]) -> list[list[bytes]]:
    """Of each text's windows those, at most PICKED, that the toxic dictionary saves most on."""
    out = []
    for pool in pools:
        ranked = nlargest(PICKED, zip(model.saved(pool), range(len(pool))), key=lambda x: (x[0], -x[1]))
        out.append([pool[i] for saved, i in ranked if saved > 0])
    return out


def _flat(pools: Iterable[list[bytes]]) -> list[bytes]:
    return [x for pool in pools for x in pool]


def fit(rows: list[tuple[bytes, int, bool]]) -> Model:
    """A model from (text, label, calibrate) rows."""
    toxic = [t for t, y, later in rows if y and not later]
    clean = [t for t, y, later in rows if not y and not later]
    if not toxic or not clean:
        warnings.warn("no toxic or no ordinary texts to learn from: every text scores 0", stacklevel=2)
        return Model(b"", b"", b"", fitted=False)
    base = trained(_flat(windows(t, step=WINDOW) for t in clean), BASE, BASE_SEGMENT, BASE_STRING)
    # texts that stand for the ordinary class in the sides, about as many as there are toxic ones
    others = clean[:: max(1, len(clean) // len(toxic))]
    side = lambda pools, size=SIDE: trained(_flat(pools), size, SEGMENT, STRING)
    model = Model(side(map(windows, toxic), 4 * SIDE), side(map(windows, others), 4 * SIDE), base)
    for _ in range(ROUNDS):
        chosen, against = _telling(model, map(windows, toxic)), _telling(model, map(windows, others))
        model = Model(side(chosen) or model.toxic, side(against) or model.ordinary, base)
        for width, step in NARROWER:
            chosen = _telling(model, ([y for x in pool for y in windows(x, width, step)] for pool in chosen))
            if not any(chosen):
                break
            model = Model(side(chosen), model.ordinary, base)
    later = [(model.distance(t), y) for t, y, later in rows if later]
    x, y = np.array([d for d, _ in later]), np.array([bool(v) for _, v in later])
    if len(x) and y.any() and not y.all():
        gain = np.array([(x[y] > k).mean() - CLEAN_WEIGHT * (x[~y] > k).mean() for k in range(40)])
        # the middle of the first thresholds that do equally well
        best = int(gain.argmax())
        model.threshold = best + (int((np.append(gain, -1)[best:] != gain[best]).argmax()) - 1) // 2 + 0.5
    return model


def most_bytes(sizes: list[int], room: int) -> int:
    """The most bytes a text may have for all texts to fit into the room once longer ones are cut to that."""
    for i, n in enumerate(order := sorted(sizes)):
        if n * (len(order) - i) > room:
            return max(1, room // (len(order) - i))
        room -= n
    return max(sizes, default=1)


def thinned(text: bytes, most: int) -> bytes:
    """The text, or if it is longer whole words of pieces from all over it."""
    if len(text) <= most:
        return text
    n = max(1, most // PIECE)
    size = most // n
    pieces = [text[a : a + size] for a in np.linspace(0, len(text) - size, n).astype(np.int64).tolist()]
    return b" ".join(b" ".join(p.split(b" ")[1:-1]) or p for p in pieces)[:most]


def labelled_sample(docs: DataFrame, labels: DataFrame) -> list[tuple[bytes, int, bool]]:
    """At most TOXIC_ROWS and ORDINARY_ROWS labelled rows, the first in order of a hash of the id.

    Only rows outside fold 0; fold 4 is for calibration.  Null labels and ids
    are left out, and repeated labels of an id count once.  Every row stays:
    if a label's texts have more than SAMPLE_BYTES, the longest are thinned.
    """
    ids = labels.where("doc_id is not null and toxic in (0, 1)").where(fold() != 0).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    ids = ids.withColumn("place", F.xxhash64(F.lit(5), "doc_id"))
    parts = [ids.where(F.col("toxic") == k).orderBy("place", "doc_id").limit(n) for k, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    chosen = parts[0].unionAll(parts[1])
    held = docs.select("doc_id", utf8().alias("body")).join(F.broadcast(chosen), "doc_id")  # at most 15,000 rows of three numbers
    sizes = held.select("toxic", F.length("body").alias("n")).collect()
    most = {k: most_bytes([r.n for r in sizes if r.toxic == k], SAMPLE_BYTES) for k in (0, 1)}

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [thinned(x, most[y]) for x, y in zip(batch.column("body").to_pylist(), batch.column("toxic").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary()), *batch.columns[1:]], names=batch.schema.names)

    kept = held.select("body", F.col("toxic").cast("int").alias("toxic"), (fold() == 4).alias("later"), "place")
    rows = kept.mapInArrow(thin, "body binary, toxic int, later boolean, place long").toArrow()
    found = sorted(zip(*(rows.column(c).to_pylist() for c in ("place", "body", "toxic", "later"))))
    return [x[1:] for x in found]


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, a row for each row; a null text counts as empty.

    Nothing but the text has a part in the score, so equal texts score alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [model.score(x) for x in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, whose text the model does not take for toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(text_col).to_pylist()
            keep = [model.score((x or "").encode()) < 0.5 for x in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for all of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs, table(spark, sf_dir, "labels")))
    return score_texts(docs, model).select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted")
