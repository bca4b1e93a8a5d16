"""Language identification by rank-order profiles.

A language's profile is its ``profile_size`` most frequent n-grams in order of frequency; so is a document's. The out-of-place
distance sums, over the document's n-grams, how far each stands from its rank in the profile; an n-gram that the profile lacks
counts as the profile's length. The nearest profile wins. n-grams are of one to three letters within words, in lower case, and
a space marks where a word begins or ends.

Profiles are learnt from at most about ``train_docs`` documents a language, picked by a hash of the id, none of them held out.

Defined results: a null or empty text, and one without letters, is ``und`` with score 0, and so is every text where there is
nothing to learn from; of equally near languages the first by name wins; null and repeated ids come out row by row; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, map_batches, table, whole_text

UNKNOWN = "und"
SPACE = 32
PART = 1 << 20
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, counts): up to three code points of 21 bits in a 63-bit number, ascending."""
    if len(text) > PART:  # a very long text is counted in parts, cut between words
        found: dict[int, int] = {}
        at = 0
        while at < len(text):
            end = min(len(text), at + PART)
            while end < len(text) and text[end].isalpha() and end < at + 2 * PART:
                end += 1
            for g, n in zip(*(x.tolist() for x in _ngrams(text[at:end])), strict=True):
                found[g] = found.get(g, 0) + n
            at = end
        grams = np.array(sorted(found), np.int64)
        return grams, np.array([found[g] for g in grams.tolist()], np.int64)
    return _ngrams(text)


def _ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = letters()[code]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = np.r_[False, letter, False]
    code = np.where(letter, np.r_[SPACE, code, SPACE], SPACE)
    keep = letter | np.r_[True, letter[:-1]]  # runs of other characters are one space
    code, letter = code[keep], letter[keep]
    two = (code[:-1] << 21) | code[1:]
    three = (two[:-1] << 21) | code[2:]
    # What spans two words is no n-gram: a space may stand first or last only.
    grams = np.concatenate([code[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])
    return np.unique(grams, return_counts=True)


def most_frequent(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent in order; ties by the n-gram."""
    return grams[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    names: list[str]
    grams: np.ndarray
    ranks: np.ndarray  # per n-gram and language; the last row and missing n-grams have the profile's length
    size: int

    @classmethod
    def of(cls, profiles: dict[str, np.ndarray], size: int) -> Profiles:
        names = sorted(profiles)
        grams = np.unique(np.concatenate([profiles[n] for n in names])) if names else np.zeros(0, np.int64)
        ranks = np.full((len(grams) + 1, len(names)), size, np.int32)
        for j, n in enumerate(names):
            ranks[np.searchsorted(grams, profiles[n]), j] = np.arange(len(profiles[n]))
        return cls(names, grams, ranks, size)

    def nearest(self, text: str) -> tuple[str, float]:
        """(language, score): by how much the nearest profile is nearer than the next, from 0 to 1."""
        grams, counts = ngrams(text)
        if not len(grams) or not self.names:
            return UNKNOWN, 0.0
        top = most_frequent(grams, counts, self.size)
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == top, at, len(self.grams))
        ranks = self.ranks[at]
        away = np.where(ranks == self.size, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(away.argmin())
        rest = np.delete(away, best)
        next_ = int(rest.min()) if len(rest) else self.size * len(top)
        return self.names[best], float(1 - away[best] / next_) if next_ else 0.0


def learn(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", profile_size: int = 400, train_docs: int = 1500,
) -> Profiles:
    """Profiles from labelled documents that aren't held out. What the driver gets is ``profile_size`` rows a language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    sizes = {r[lang_col]: r["count"] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return Profiles.of({}, profile_size)
    limit = F.coalesce(*(F.when(F.col(lang_col) == name, F.lit(min(1.0, train_docs / n))) for name, n in sizes.items()))
    some = known.where(F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1_000_000)) < limit * 1_000_000)

    def count(batches):
        for batch in batches:
            by: dict[str, dict[int, int]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = by.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in ngrams(text)), strict=True):
                    seen[g] = seen.get(g, 0) + n
            for lang, seen in by.items():
                yield pa.record_batch(
                    [pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())],
                    names=["lang", "gram", "n"],
                )

    bounded_batches(docs.sparkSession)
    counted = some.select(F.col(lang_col).alias("lang"), whole_text(text_col).alias("text")).mapInArrow(count, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = total.withColumn("rank", rank).where(F.col("rank") <= profile_size).collect()
    profiles: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles.of({k: np.array(v, np.int64) for k, v in profiles.items()}, profile_size)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [profiles.nearest(x) for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["id", "lang_pred", "score"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return map_batches(rows, run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def drop_unidentified(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language, with all their columns: texts without a letter go. With no profiles all rows stay."""
    if not profiles.names:
        return docs
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            keep = [profiles.nearest(x or "")[0] != UNKNOWN for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
