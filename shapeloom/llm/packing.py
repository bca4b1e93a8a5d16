"""Best-fit packing of documents into sequences, with certified bin counts.

Documents are encoded, ended with the end id and cut only if longer than a sequence. Pieces are dealt to partitions of bounded
size by hash; each partition runs best-fit decreasing. A lower bound on the bins that a partition's pieces need comes from dual
feasible functions: where bins and bound agree, the partition is certified and keeps its bins for good. Then partitions are taken together,
four by four, and the bound is computed for what each four hold together. A union whose bins exceed its bound has a gap: its
partitions exchange the documents of all bins that are not full, and best-fit decreasing is run again over these; the new bins
stand if they are fewer. Certified unions exchange nothing. It ends when one union holds everything or the bound of the whole table is
met. Lengths are integers up to the capacity, so bounds come from histograms of at most ``capacity`` numbers a partition; the driver
sees sums only.

Defined results: a null text is the empty text, whose only token is the end id; null and repeated ids are packed row by row; an
empty table gives an empty result; extra columns are ignored; very long texts are encoded whole.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, table, tokenizer_path, unit_ids, whole_text


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The fewest bins that could hold ``counts[l]`` pieces of each length l, by dual feasible functions.

    For each e, pieces over capacity - e count as a whole bin and pieces under e as nothing; what is left counts by its share of
    the capacity, or by that share rounded to k-ths (x stays if (k + 1) x is whole, else floor((k + 1) x) / k).
    """
    lengths = np.arange(len(counts), dtype=np.int64)
    counts = counts.astype(np.int64)
    best = 0
    for e in [0, *sorted({1, 2, 3, *(max(1, capacity * i // 64) for i in range(1, 33))})]:
        mapped = np.where(lengths > capacity - e, capacity, np.where(lengths < e, 0, lengths)) if e else lengths
        best = max(best, -(-int((counts * mapped).sum()) // capacity))
        for k in range(1, 13):
            whole = (mapped * (k + 1)) % capacity == 0
            steps = mapped * (k + 1) // capacity
            # In units of 1 / (capacity * k), so that sums are exact.
            units = int((counts * np.where(whole, mapped * k, steps * capacity)).sum())
            best = max(best, -(-units // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, bytes used of that bin) for each piece. ``open_`` has the bins by free space, one bit each in ``free``."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    free = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if room := free >> n:
            space = n + (room & -room).bit_length() - 1
            b = open_[space].pop()
            if not open_[space]:
                free &= ~(1 << space)
        else:
            b, space = len(used), capacity
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if space := space - n:
            open_[space].append(b)
            free |= 1 << space
    return bins, offsets, np.array(used, np.int64)[bins] if used else bins


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc): of a document longer than the capacity only the first piece is shorter."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit_ids(tokenizer)
            ids, piece, start, length, crc = [], [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = units.encode(text) + end
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    to = at + ((n - at - 1) % capacity + 1 if k == 0 else capacity)
                    ids.append(key)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(data[4 * at : 4 * to]))
                    at, k = to, k + 1
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "crc"],
            )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, crc long")


#: Partitions that are taken together in a round.
TOGETHER = 4
_PIECES = "id long, piece int, start long, length long, crc long, salt int"
_PLACED = _PIECES + ", home int, seq long, offset long, used long"


def _number(turn: int, unit, bins):
    return (turn << 56) + (np.int64(unit) << 24) + bins


def _first_packing(rows: DataFrame, parts: int, capacity: int) -> DataFrame:
    """Pieces dealt to ``parts`` homes, each packed by itself."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, used = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(seq=_number(0, pdf["home"].iloc[0], bins), offset=offsets, used=used)

    dealt = rows.withColumn("home", F.pmod(F.xxhash64("id", "piece", "start", "crc", "salt"), F.lit(parts)).cast("int"))
    return dealt.groupBy("home").applyInPandas(pack, _PLACED)


def _exchanged(rows: DataFrame, turn: int, homes: int, shards: int, capacity: int) -> DataFrame:
    """The bins of each union packed anew if that makes fewer. A union of more rows than one task should hold is dealt in ``shards``,
    whole bins at a time."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets, used = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        unit = pdf["unit"].iloc[0]
        if bins.max() + 1 < (pdf["offset"] == 0).sum():
            pdf = pdf.assign(seq=_number(turn, unit, bins), offset=offsets, used=used)
        return pdf.drop(columns=["unit"])

    unit = F.col("union") + F.lit(homes) * F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int")
    return rows.withColumn("unit", unit).drop("union").groupBy("unit").applyInPandas(pack, _PLACED)


def _bounds(histograms: DataFrame, capacity: int) -> DataFrame:
    """(union, bound) from (union, length, n)."""

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(capacity + 1, np.int64)
        np.add.at(counts, pdf["length"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({"union": [pdf["union"].iloc[0]], "bound": [lower_bound(counts, capacity)]})

    return histograms.groupBy("union").applyInPandas(bound, "union int, bound long")


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    part_rows: int = 50_000, report: dict | None = None,
) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset. ``report`` gets the bins, the bound and the rounds."""
    # A row that repeats an id and a text is told apart by the place where it was made, so that copies spread over partitions.
    made = pieces(docs, tokenizer, end_id, capacity, id_col, text_col).withColumn("salt", F.spark_partition_id())
    left = materialise(made, "pieces")
    rows = left.count()
    homes = max(1, math.ceil(rows / part_rows))
    now = materialise(_first_packing(left, homes, capacity), "round-0")
    histograms = materialise(now.groupBy("home", "length").agg(F.count(F.lit(1)).alias("n")), "histograms")
    goal = _bounds(histograms.select(F.lit(0).alias("union"), "length", "n").groupBy("union", "length").agg(F.sum("n").alias("n")), capacity).first()
    goal = goal["bound"] if goal else 0
    # Every bin has one piece at its beginning, so bins are counted by those.
    bins = materialise(now.where("offset = 0").groupBy("home").agg(F.count(F.lit(1)).alias("bins")), "bins-0")
    done, step, turn, rounds = [], 1, 0, []
    total = bins.agg(F.sum("bins")).first()[0] or 0
    while True:
        # Round 0 has one home a union: it says which homes are certified. Later rounds have TOGETHER times as many each.
        union = lambda c, step=step: F.floor(F.col(c) / step).cast("int")
        bound = _bounds(histograms.groupBy(union("home").alias("union"), "length").agg(F.sum("n").alias("n")), capacity)
        held = bins.groupBy(union("home").alias("union")).agg(F.sum("bins").alias("bins"))
        gaps = materialise(bound.join(held, "union").where("bins > bound").select("union"), f"gaps-{turn}")
        rounds.append({"unions": math.ceil(homes / step), "bins": total, "uncertified": gaps.count()})
        if turn and rounds[-1]["uncertified"]:
            marked = now.withColumn("union", union("home")).join(gaps.withColumn("gap", F.lit(True)), "union", "left")
            moves = (F.col("used") < capacity) & F.coalesce("gap", F.lit(False))
            done.append(marked.where(~moves).select(now.columns))
            moving = marked.where(moves).drop("gap")
            most = moving.groupBy("union").count().agg(F.max("count")).first()[0] or 0
            shards = max(1, math.ceil(most / (TOGETHER * part_rows)))
            now = materialise(_exchanged(moving, turn, math.ceil(homes / step), shards, capacity), f"round-{turn}")
            counted = [x.where("offset = 0").groupBy("home").agg(F.count(F.lit(1)).alias("bins")) for x in (*done, now)]
            bins = materialise(reduce(DataFrame.unionByName, counted).groupBy("home").agg(F.sum("bins").alias("bins")), f"bins-{turn}")
            total = bins.agg(F.sum("bins")).first()[0] or 0
        if total == goal or step >= homes:
            break
        step, turn = step * TOGETHER, turn + 1
    if report is not None:
        report |= {"bins": total, "bound": goal, "rounds": rounds}
    out = reduce(DataFrame.unionByName, [*done, now])
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("seq").alias("sequence_id"), "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
