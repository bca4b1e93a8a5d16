"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart from each other: one on windows of ordinary text, one on windows of toxic text that
ordinary text lacks. A window of a text is compressed against each, and the difference of the two lengths says which it is nearer
to. A window is ``window_words`` words with a space at either end, in lower case. Each character is written as ``width`` fixed bytes
first, which depend on the character and on its place in the word: a zstandard match of three or four letters is not worth its
header otherwise, and how a word begins says more than that the same letters are within another.

A document's evidence is the number and the share of its windows whose difference reaches the calibrated threshold, and the
largest difference; a logistic curve, fitted on documents that the dictionaries did not see, turns it into a score, with the best cut
at 0.7.

Which windows of a toxic document are toxic is not labelled. Those train the toxic dictionary that have a word, or a beginning of
a word, which is in more toxic than ordinary documents by a test on their numbers, so that a few documents of a smaller language
count as well as many of a large one.

The fit takes a bounded sample: at most ``toxic_rows`` and ``ordinary_rows`` labelled rows in the order of a hash, and no more
than ``train_chars`` characters. Of an ordinary text it trains on evenly spaced windows, ``windows_a_text`` to twice as many.
Scoring reads every window of every text; equal windows of a worker are compressed once.

Defined results: a null text is the empty text; a text without words has the score of no evidence; very long texts are scored whole;
with no toxic or no ordinary row to learn from every score is 0; null and repeated ids come out row by row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, bounded_batches, held_out, map_batches, table, whole_text

WORD = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 5, 6, 7)
CUT = 0.7
ORDINARY_WEIGHT = 20.0


#: Letters further into a word than this are coded alike.
PLACES = 8


class _Wide(Remembered):
    """Word -> ``width`` bytes for each character, by the character and its place."""

    def __init__(self, width: int, most: int = 200_000):
        super().__init__(most)
        self.width, self.codes = width, {}

    def make(self, word: str) -> bytes:
        return b"".join([self.codes.get(x) or self.code(x) for x in zip(word, (*range(PLACES), *[PLACES] * len(word)), strict=False)])

    def code(self, x: tuple[str, int]) -> bytes:
        name = f"{x[1]}{x[0]}".encode()
        made = zlib.crc32(name) | zlib.crc32(b"y" + name) << 32
        self.codes[x] = out = made.to_bytes(8, "little")[: self.width]
        return out

    def window(self, words: list[str]) -> bytes:
        return b" ".join([b"", *map(self.__getitem__, words), b""])


def _compressor(content: bytes):
    import zstandard as z

    params = z.ZstdCompressionParameters(
        window_log=17, hash_log=17, chain_log=17, search_log=6, min_match=3, target_length=64, strategy=z.STRATEGY_BTOPT,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS,
    )
    d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return z.ZstdCompressor(dict_data=d, compression_params=params)


class _Differences(Remembered):
    """Window -> its length against ordinary text less its length against toxic text."""

    def __init__(self, toxic: bytes, ordinary: bytes, width: int, most: int):
        super().__init__(most)
        self.toxic, self.ordinary, self.wide = _compressor(toxic), _compressor(ordinary), _Wide(width)

    def make(self, window: str) -> int:
        data = self.wide.window(window.split(" "))
        return len(self.ordinary.compress(data)) - len(self.toxic.compress(data))


def _features(differences: list[int], threshold: int) -> tuple[float, float, float]:
    over = sum(d >= threshold for d in differences)
    return (math.log1p(over), float(max(0, max(differences, default=0) - threshold + 1)), 20 * over / max(1, len(differences)))


@dataclass
class Model:
    """What a fit gives: two dictionaries, the windows' threshold, and the logistic curve's weights."""

    toxic: bytes
    ordinary: bytes
    width: int = 3
    window_words: int = 1
    threshold: int = 3
    weights: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    most: int = field(default=600_000, repr=False)

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def differences(self, text: str) -> list[int]:
        """Per window: its length against ordinary text less its length against toxic text."""
        if self._ready is None:
            self._ready = _Differences(self.toxic, self.ordinary, self.width, self.most)
        words, k = WORD.findall(text.lower()), self.window_words
        windows = words if k == 1 else [" ".join(words[i : i + k]) for i in range(0, len(words), k)]
        return list(map(self._ready.__getitem__, windows))

    def evidence(self, text: str) -> tuple[float, float, float]:
        return _features(self.differences(text), self.threshold)

    def score(self, text: str) -> float:
        z = self.weights[3] + sum(w * x for w, x in zip(self.weights, self.evidence(text), strict=False))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _marks(words: set[str]) -> set[str]:
    out = {f" {w} " for w in words}
    for k in BEGINNINGS:
        out |= {f" {w[:k]}" for w in words if len(w) >= k}
    return out


def contrast(toxic: list[str], ordinary: list[str], least_ratio: float = 20.0, by_chance: float = 20.0) -> set[str]:
    """Words and beginnings of words that more of the toxic texts have, by a likelihood test that would let about ``by_chance`` of all
    marks through if labels said nothing, and ``least_ratio`` times the share of the ordinary. A toxic text counts for its words
    between neighbours that no earlier one had them between, so that copies count once."""
    counts: Counter[str] = Counter()
    seen: set[tuple[str, ...]] = set()
    for x in toxic:
        words = ["", *WORD.findall(x.lower()), ""]
        new = set(zip(words, words[1:], words[2:], strict=False)) - seen
        seen |= new
        counts.update(_marks({w for _, w, _ in new}))
    often = {m: n for m, n in counts.items() if n >= 4}
    there: Counter[str] = Counter()
    for x in ordinary:
        there.update(_marks(set(WORD.findall(x.lower()))) & often.keys())
    share, least = len(toxic) / (len(toxic) + len(ordinary)), math.log(max(len(counts), 2) / by_chance)

    def surprise(n: int, other: int) -> float:
        p = n / (n + other)
        if p <= share:
            return 0.0
        return n * math.log(p / share) + (other * math.log((1 - p) / (1 - share)) if other else 0.0)

    return {m for m, n in often.items() if surprise(n, there[m]) > least and (n + 0.5) / len(toxic) > least_ratio * (there[m] + 0.5) / len(ordinary)}


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept by Newton steps; classes weigh the same, and a ridge keeps separable data finite."""
    x = np.c_[x, np.ones(len(x))]
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(x.shape[1])
    ridge = np.diag([0.05] * (x.shape[1] - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge @ w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _best_cut(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(cut, its worth): of the best cuts the middle of the widest gap. A share of ordinary texts called toxic weighs
    ``ORDINARY_WEIGHT`` times as much as the same share of toxic texts missed, since most texts are ordinary."""
    values, at = np.unique(z, return_inverse=True)
    if len(values) < 2:
        return float(values[0]) + 1.0, 0.5
    mids = (values[1:] + values[:-1]) / 2
    # Shares of toxic texts at or over each cut and of ordinary ones under it, from counts per value.
    caught = 1 - np.cumsum(np.bincount(at, y, len(values)))[:-1] / max(y.sum(), 1)
    spared = np.cumsum(np.bincount(at, 1 - y, len(values)))[:-1] / max((1 - y).sum(), 1)
    right = caught + ORDINARY_WEIGHT * spared
    best = np.flatnonzero(right >= right.max() - 1e-12)
    gaps = (values[1:] - values[:-1])[best]
    return float(mids[best[int(gaps.argmax())]]), float(right.max())


def fit(
    toxic: list[str], ordinary: list[str], toxic_bytes: int = 4096, ordinary_bytes: int = 16384, width: int = 3, window_words: int = 1,
    windows_a_text: int = 30,
) -> Model | None:
    """Train on the first two thirds of either list and calibrate on the rest: the best threshold with its curve is kept."""
    import zstandard as z

    if len(toxic) < 3 or len(ordinary) < 3:
        return None
    nt, no = max(1, len(toxic) * 2 // 3), max(1, len(ordinary) * 2 // 3)
    marks, wide, k = contrast(toxic[:nt], ordinary[:no]), _Wide(width), window_words

    def windows(x: str) -> list[list[str]]:
        words = WORD.findall(x.lower())
        return [words[i : i + k] for i in range(0, len(words), k)]

    toxic_windows = [wide.window(w) for x in toxic[:nt] for w in windows(x) if not marks.isdisjoint(_marks(set(w)))] if marks else []
    ordinary_windows = []
    for x in ordinary[:no]:
        w = windows(x)
        ordinary_windows += [wide.window(w[i]) for i in range(0, len(w), max(1, len(w) // windows_a_text))]

    def trained(size: int, samples: list[bytes], segment: int) -> bytes:
        try:
            return z.train_dictionary(size, samples, k=segment, d=8).as_bytes()
        except z.ZstdError:  # too few samples to train on: they are the dictionary
            return b"".join(list(dict.fromkeys(samples)))[-size:]

    model = Model(
        trained(toxic_bytes * width, toxic_windows, 8 * width) if toxic_windows else b"", trained(ordinary_bytes * width, ordinary_windows, 12 * width),
        width, window_words,
    )
    y = np.r_[np.ones(len(toxic) - nt), np.zeros(len(ordinary) - no)]
    held = [model.differences(x) for x in toxic[nt:] + ordinary[no:]]
    best: tuple[float, int, tuple] | None = None
    for threshold in range(1, 16):
        x = np.array([_features(d, threshold) for d in held])
        w = _logistic(x, y)
        cut, right = _best_cut(x @ w[:-1], y)
        if best is None or right > best[0]:
            best = (right, threshold, (*map(float, w[:-1]), math.log(CUT / (1 - CUT)) - cut))
    _, model.threshold, model.weights = best
    return model


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    toxic_rows: int = 2000, ordinary_rows: int = 4000, train_chars: int = 24_000_000,
) -> Model | None:
    """Fit on a bounded sample of labelled rows, none of them held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    order = F.xxhash64(F.lit(7), F.col(id_col))
    sample = None
    for value, rows in ((1, toxic_rows), (0, ordinary_rows)):
        some = known.where(F.col(label_col) == value).select(F.col(id_col).alias("_id"), F.lit(value).alias("_label"), order.alias("_order")).orderBy("_order").limit(rows)
        sample = some if sample is None else sample.unionByName(some)
    # At most toxic_rows + ordinary_rows ids are broadcast.
    texts = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    # Rows no longer than a row's share of the budget always fit, and of longer ones the shortest first: a huge text pushes no other out.
    fair = F.when(F.col("_label") == 1, train_chars // 2 // toxic_rows).otherwise(train_chars // 2 // ordinary_rows)
    by_need = Window.partitionBy("_label").orderBy(F.greatest(F.length("_text"), fair), "_order", "_id")
    running = F.sum(F.length("_text")).over(by_need.rowsBetween(Window.unboundedPreceding, 0))
    got = texts.withColumn("_sum", running).where(F.col("_sum") <= train_chars // 2).select("_label", "_order", "_text").collect()
    for value in (0, 1):
        if sum(r["_label"] == value for r in got) < 3 <= texts.where(F.col("_label") == value).limit(3).count():
            raise ValueError(f"labelled texts ({label_col} = {value}) are too long to learn from {train_chars} characters")
    got.sort(key=lambda r: (r["_order"], r["_text"]))
    return fit([r["_text"] for r in got if r["_label"] == 1], [r["_text"] for r in got if r["_label"] == 0])


def scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = _shared(model)
        made = [held.score(x) for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(made, pa.float64())], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"))
    bounded_batches(docs.sparkSession)
    return map_batches(rows, run, "id long, score double").withColumnRenamed("id", id_col)


_HELD: dict[tuple, Model] = {}


def _shared(model: Model) -> Model:
    """A worker's own copy, so that windows known from earlier tasks stay known."""
    key = (model.toxic, model.ordinary, model.weights, model.threshold)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = model
    return _HELD[key]


def drop_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows whose score is under the cut, with all their columns."""
    if model is None:
        return docs
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        held = _shared(model)
        for batch in batches:
            keep = [held.score(x or "") < CUT for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
