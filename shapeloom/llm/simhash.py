"""Near duplicates by SimHash fingerprints and pivot distance tables.

A fingerprint's Hamming distances to fixed reference fingerprints (pivots) are computed once. By the triangle inequality two
fingerprints at distance d differ by at most d in each coordinate: cells of the first pivot's distance are join keys, a pair that
meets is discarded as soon as one more coordinate differs by more, and survivors are compared bit by bit.

At 64 bits, pivots alone leave too many pairs of a large table (distances lie within some four bits of 32), so blocks of the
fingerprint are keys besides: at distance d, of ``blocks`` blocks at most d differ, so two linked fingerprints agree in all others
for some choice of d blocks. What can share such a key is bounded by the bits left open, whatever the corpus holds, and equal
fingerprints are one entry however many documents have them.

Defined results: a null text is the empty text, whose fingerprint is zero and is linked like any other; null ids take part,
and a component's id is its smallest id that is not null; repeated rows come out once each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_written, hot_keys, join_hot, map_batches, materialise, passing, table, whole_text
from .components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, size: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes (XXH64, seed 42)."""
    import numpy as np
    import xxhash

    words = WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(x), 42) for x in zip(*(words[i:] for i in range(size)), strict=False)]
    bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a long text's bits are counted piece by piece
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long."""
    import numpy as np

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        made = np.array([fingerprint(x, size) for x in texts], dtype="<u8").view("<i8")
        return pa.record_batch([batch.column(0), pa.array(made, pa.int64())], names=["id", "fp"])

    bounded_batches(docs.sparkSession)
    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")), run, "id long, fp long")


def pivots(count: int = 16) -> list[int]:
    """Reference fingerprints, fixed for good: the 64-bit finaliser of splitmix applied to 1, 2, 3, ..."""
    out = []
    for k in range(1, count + 1):
        z = (k * 0x9E3779B97F4A7C15) & (2**64 - 1)
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        z ^= z >> 31
        out.append(z - 2**64 if z >= 2**63 else z)
    return out


def pivot_table(fps: DataFrame, count: int = 9) -> DataFrame:
    """fp, its distance to the first pivot (near), and those to the other pivots (at most eight) as the bytes of one long (far)."""
    to = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long") for p in pivots(count)]
    far = reduce(Column.bitwiseOR, (F.shiftleft(d, 8 * i) for i, d in enumerate(to[1:])))
    return fps.select("fp", to[0].cast("int").alias("near"), far.alias("far"))


def _masks(blocks: int, distance: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for gone in combinations(parts, distance):
        m = (2**64 - 1) & ~reduce(int.__or__, gone)
        out.append(m - 2**64 if m >= 2**63 else m)
    return out


def links(fps: DataFrame, distance: int = 2, blocks: int = 6, pivot_count: int = 9) -> DataFrame:
    """All (u, v) with u < v among the distinct fingerprints in ``fps`` that differ in at most ``distance`` bits.

    Join keys are a choice of agreeing blocks, their bits, and a cell of ``distance`` + 1 distances to the first pivot: linked
    fingerprints are in the same cell or in neighbouring ones, so that one side is entered in its cell and the next. Of pairs that
    meet, the coordinates discard those that differ by more than ``distance`` in one; the rest are compared bit by bit.
    """
    masks, wide = _masks(blocks, distance), distance + 1
    table_ = pivot_table(fps, pivot_count)
    choices = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks))))
    cell = F.floor(F.col("near") / wide).cast("int")
    own = table_.withColumn("cell", cell).select("fp", "near", "far", "cell", choices.alias("entry")).select("fp", "near", "far", "cell", "entry.choice", "entry.key")
    more = table_.select("fp", "near", "far", F.explode(F.array(cell, cell + 1)).alias("cell")).select("fp", "near", "far", "cell", choices.alias("entry"))
    a, b = own.alias("a"), more.select("fp", "near", "far", "cell", "entry.choice", "entry.key").alias("b")
    same = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("choice", "key", "cell")))
    # Within a cell each pair is met from both sides; across cells, where b's own cell is one lower, from one.
    once = (F.col("a.fp") < F.col("b.fp")) | (F.floor(F.col("b.near") / wide) < F.col("a.cell"))
    byte = lambda c, i: F.shiftright(F.col(c), 8 * i).bitwiseAND(F.lit(255))
    apart = [F.abs(F.col("a.near") - F.col("b.near")), *(F.abs(byte("a.far", i) - byte("b.far", i)) for i in range(pivot_count - 1))]
    close = reduce(lambda x, y: x & y, (x <= distance for x in apart))
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    # The planner takes a side for as small as the file it is exploded from, and would broadcast it: its rows are shuffled at any size.
    met = a.hint("merge").join(b, same & (F.col("a.fp") != F.col("b.fp")) & once & close & verified)
    return met.select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 2) -> DataFrame:
    """id_col, fp, component_id for every row of ``docs``."""
    marks = materialise(fingerprints(docs, id_col, text_col, size), "simhash")
    least = materialise(marks.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "fingerprints")
    roots = connected_components(links(least.select("fp"), distance))
    grouped = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = materialise(
        grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"), "components"
    )
    hot = materialise(hot_keys(least, "fp", "rows", marks.count()), "hot")
    return join_hot(marks, ids, "fp", hot).select(F.col("id").alias(id_col), "fp", "component_id")


def turned_bits(similarity: float) -> float:
    """The share of bits in which the fingerprints of two texts with this Jaccard similarity differ, in expectation."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def banding(rows: int, similarity: float, recall: float = 0.99) -> tuple[int, int]:
    """Bits per band and bands. Bands are wide enough that unlike texts seldom meet (about one partner a band, whatever the
    number of rows), and as many as a pair at ``similarity`` needs to meet in one of them with probability ``recall``."""
    width = min(30, max(16, math.ceil(math.log2(max(rows, 2)))))
    meet = (1 - turned_bits(similarity)) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def shingle_hashes(text: bytes, size: int):
    """The ascending hashes of the distinct shingles; a text of up to ``size`` words is one shingle."""
    import numpy as np
    import xxhash

    found = WORD.findall(text.translate(_LOWER))
    if len(found) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), 42)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(b" ".join(x), 42) for x in zip(*(found[i:] for i in range(size)), strict=False)]
    return np.unique(np.array(hashes, dtype=np.uint64))


def wide_bits(h, words: int):
    """``words`` * 64 SimHash bits of distinct shingle hashes as an array of 0 and 1: each is mixed with fixed odd constants."""
    import numpy as np

    odd = np.array([(p & (2**64 - 1)) | 1 for p in pivots(words)], dtype=np.uint64)
    total = np.zeros(words * 64, dtype=np.int64)
    for at in range(0, len(h), 255):  # 255 rows are summed in bytes without overflow
        m = h[at : at + 255, None] * odd
        m ^= m >> np.uint64(32)
        m *= np.uint64(0xD6E8FEB86659FD93)
        m ^= m >> np.uint64(32)
        total += np.add.reduce(np.unpackbits(m.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return (total * 2 > len(h)).astype(np.uint8)


def wide_fingerprints(docs: DataFrame, width: int, bands: int, id_col: str = "doc_id", text_col: str = "text", size: int = 5) -> DataFrame:
    """(id, wide, n, sketch): the bits, the number of distinct shingles, and the upper halves of the smallest ``SKETCH`` of their
    hashes."""
    import numpy as np

    words = math.ceil(width * bands / 64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_hashes(x, size) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        bits = np.stack([wide_bits(h, words) for h in made])
        packed = np.packbits(bits, axis=1, bitorder="little")
        return pa.record_batch(
            [
                batch.column(0),
                pa.array([x.tobytes() for x in packed], pa.binary()),
                pa.array([len(h) for h in made], pa.int64()),
                pa.array([(h[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for h in made], pa.binary()),
            ],
            names=["id", "wide", "n", "sketch"],
        )

    bounded_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    return map_batches(chosen, run, "id long, wide binary, n long, sketch binary")


def band_keys(wide: list[bytes], width: int, bands: int):
    """Per wide fingerprint an integer of ``width`` bits for each band; they are made where they are used, and not written."""
    import numpy as np

    packed = np.frombuffer(b"".join(wide), dtype=np.uint8).reshape(len(wide), -1)
    bits = np.unpackbits(packed, axis=1, bitorder="little")[:, : width * bands].reshape(len(wide), bands, width)
    return bits.astype(np.int32) @ (1 << np.arange(width, dtype=np.int32))


#: Members of a bucket of up to so many are looked at only if another of them is near in the first 64 bits.
SMALL_BUCKET = 8
#: A larger bucket is dealt out as pairs of blocks of about so many members.
BLOCK = 2048
#: So many of a text's smallest shingle hashes travel with it. Of shorter texts these are all, and similarity is known from them.
SKETCH = 256


def _whole_groups(batches, by: int):
    """Columns of a sorted partition's batches in pieces that cut no group of equal values in the first ``by`` columns."""
    import numpy as np

    held = []

    def joined(parts):
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        now = []
        for column in batch.columns:
            if batch.schema.names[len(now)] == "sketch":
                now.append(np.array([*column.to_pylist(), b""], dtype=object)[:-1])
            elif pa.types.is_binary(column.type):
                now.append(np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(batch.num_rows, -1))
            else:
                now.append(column.to_numpy(zero_copy_only=False))
        if held and any(held[-1][k][-1] != now[k][0] for k in range(by)):
            yield joined(held)
            held = []
        changes = np.flatnonzero(np.any([x[1:] != x[:-1] for x in now[:by]], axis=0))
        if len(changes):
            cut = changes[-1] + 1
            yield joined([*held, [x[:cut] for x in now]])
            held = [[x[cut:] for x in now]]
        else:
            held.append(now)
    if held:
        yield joined(held)


def _starts(columns):
    import numpy as np

    return np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in columns], axis=0)])


def _meetings(most_bits: int, pivot_count: int):
    """(id, code) of a sorted partition's buckets: the members that may have a near partner there; code holds band and bucket size."""
    import numpy as np

    marks = np.array([p & (2**64 - 1) for p in pivots(pivot_count)], dtype=np.uint64)

    def run(batches):
        for band, key, ids, fp in _whole_groups(batches, 2):
            fp = fp.view(np.uint64)
            starts = _starts((band, key))
            sizes = np.diff(np.r_[starts, len(ids)])
            size, bucket = np.repeat(sizes, sizes), np.repeat(np.arange(len(starts)), sizes)
            chosen = size > SMALL_BUCKET
            table_ = np.bitwise_count(fp[:, None] ^ marks).astype(np.int16)
            for step in range(1, SMALL_BUCKET):
                i = np.flatnonzero((bucket[step:] == bucket[:-step]) & (size[step:] <= SMALL_BUCKET))
                i = i[ids[i] != ids[i + step]]
                i = i[np.abs(table_[i] - table_[i + step]).max(axis=1) <= most_bits]
                i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= most_bits]
                chosen[i] = chosen[i + step] = True
            code = (size.astype(np.int64) << 16) | band.astype(np.int64)
            yield pa.record_batch([pa.array(ids[chosen]), pa.array(code[chosen])], names=["id", "code"])

    return run


def meetings(marks: DataFrame, width: int, bands: int, similarity: float = 0.8, pivot_count: int = 16) -> DataFrame:
    """(id, codes): per id the bands, with their buckets' sizes, in which it may have a near partner."""
    import numpy as np

    turned = turned_bits(similarity)
    most = math.ceil(64 * turned + 4 * math.sqrt(64 * turned * (1 - turned)))

    def explode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = batch.column(1).to_pylist()
            first = np.frombuffer(b"".join(x[:8] for x in wide), dtype="<i8")
            each = (pa.array(np.repeat(x, bands)) for x in (batch.column(0).to_numpy(zero_copy_only=False), first))
            keys = band_keys(wide, width, bands).reshape(-1)
            yield pa.record_batch(
                [pa.array(np.tile(np.arange(bands, dtype=np.int16), batch.num_rows)), pa.array(keys), *each], names=["band", "key", "id", "fp"]
            )

    rows = marks.select("id", "wide").where("id is not null").mapInArrow(explode, "band short, key int, id long, fp long")
    return (
        rows.repartition("band", "key").sortWithinPartitions("band", "key", "fp", "id")
        .mapInArrow(_meetings(most, pivot_count), "id long, code long").groupBy("id").agg(F.collect_set("code").alias("codes"))
    )


def _cells(batches, width: int, bands: int, least_size: int):
    """Each member once per bucket, or once per pair of blocks of a larger one that has the member's own block."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, group, count = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        wide, codes, sketch = batch.column(3).to_pylist(), batch.column(4), batch.column(5).to_pylist()
        keys = band_keys(wide, width, bands)
        row = np.repeat(np.arange(len(ids)), codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        code = codes.flatten().to_numpy(zero_copy_only=False)
        row, code = row[(code >> 16) >= least_size], code[(code >> 16) >= least_size]
        band, blocks = code & 0xFFFF, -(-(code >> 16) // BLOCK)
        own = ((ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % np.maximum(blocks, 1)
        at = np.repeat(np.arange(len(row)), blocks)
        other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        row, band, own, blocks = row[at], band[at], own[at], blocks[at]
        cell = np.minimum(own, other) * blocks + np.maximum(own, other)
        # Small buckets have few pairs that are near in all bits; those are verified without sketches, which are not sent.
        sketched = (code[at] >> 16) > SMALL_BUCKET
        for k in range(0, len(row), 4096):
            r, part = row[k : k + 4096], slice(k, k + 4096)
            made = (band[part].astype(np.int16), keys[r, band[part]], cell[part], ids[r], group[r], count[r], np.where(own[part] == other[part], -1, own[part]))
            yield pa.record_batch(
                [*map(pa.array, made), pa.array([wide[i] for i in r.tolist()], pa.binary()), pa.array([sketch[i] if s else b"" for i, s in zip(r.tolist(), sketched[part].tolist(), strict=True)], pa.binary())],
                names=["band", "key", "cell", "id", "group", "n", "block", "wide", "sketch"],
            )


def _within(ids, group, n, block, similarity: float):
    """Whether members i and j may be alike: of different ids and groups, of sizes that allow it, and not of one block's own cell."""
    import numpy as np

    def may(i, j):
        return (ids[i] != ids[j]) & (group[i] != group[j]) & ((block[i] < 0) | (block[i] != block[j])) & (
            np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
        )

    return may


class _Sketches:
    """Whether pairs may be as similar as asked by their sketches; sure but for clashes of 32 bits where these hold all hashes."""

    def __init__(self, n, sketch, similarity: float):
        self.n, self.sketch, self.similarity, self.sets = n, sketch, similarity, {}

    def set_of(self, i: int) -> frozenset:
        import numpy as np

        if (found := self.sets.get(i)) is None:
            self.sets[i] = found = frozenset(np.frombuffer(self.sketch[i], "<u4").tolist())
        return found

    def may(self, i: int, j: int) -> bool:
        if not self.sketch[i] or not self.sketch[j]:
            return True
        a, b = self.set_of(i), self.set_of(j)
        cut = [max(x) for x, k in ((a, i), (b, j)) if self.n[k] > SKETCH]
        if not cut:
            both = len(a & b)
            return both + 1 >= self.similarity * (len(a) + len(b) - both)
        # Up to the smaller of the largest hashes of cut sets, both sketches are complete: a sample of the union.
        last = min(cut)
        both, either = sum(x <= last for x in a & b), sum(x <= last for x in a | b)
        return both + 1 >= (self.similarity - 4 * math.sqrt(self.similarity * (1 - self.similarity) / either)) * either

    def filter(self, i, j):
        import numpy as np

        return np.fromiter(map(self.may, i.tolist(), j.tolist()), bool, len(i))


def _nearest_in_cells(limit: int, similarity: float):
    """(u, d, v): for each member of a sorted partition's cells the nearest member of another group there, if within ``limit`` bits."""
    import numpy as np

    def run(batches):
        for band, key, cell, ids, group, n, block, wide, sketch in _whole_groups(batches, 3):
            may, out = _within(ids, group, n, block, similarity), []
            starts = _starts((band, key, cell))
            for start, m in zip(starts.tolist(), np.diff(np.r_[starts, len(ids)]).tolist(), strict=True):
                member, rows = np.arange(start, start + m), max(1, 65536 // m)
                if m < 2 or (group[member] == group[start]).all():
                    continue
                for k in range(0, m, rows):
                    one = member[k : k + rows, None]
                    differ = np.where(may(one, member), np.bitwise_count(wide[one] ^ wide[member]).sum(axis=2, dtype=np.int64), limit + 1)
                    best = differ.argmin(axis=1)  # of equally near ones the first, so that copies agree on it
                    d = differ[np.arange(len(one)), best]
                    found = np.flatnonzero(d <= limit)
                    found = found[_Sketches(n, sketch, similarity).filter(one[found, 0], member[best[found]])]
                    out.append((ids[one[found, 0]], d[found], ids[member[best[found]]]))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["u", "d", "v"])

    return run


def _near_in_cells(limit: int, similarity: float):
    """(u, v): all pairs of different groups of a sorted partition's cells within ``limit`` bits."""
    import numpy as np

    def run(batches):
        for band, key, cell, ids, group, n, block, wide, sketch in _whole_groups(batches, 3):
            may, alike, out = _within(ids, group, n, block, similarity), _Sketches(n, sketch, similarity), []
            starts = _starts((band, key, cell))
            sizes = np.diff(np.r_[starts, len(ids)])
            size, at = np.repeat(sizes, sizes), np.repeat(np.arange(len(starts)), sizes)
            for step in range(1, SMALL_BUCKET):
                i = np.flatnonzero((at[step:] == at[:-step]) & (size[step:] <= SMALL_BUCKET))
                i = i[may(i, i + step)]
                i = i[np.bitwise_count(wide[i] ^ wide[i + step]).sum(axis=1) <= limit]
                out.append((ids[i], ids[i + step]))
            for start, m in zip(starts.tolist(), sizes.tolist(), strict=True):
                member, rows = np.arange(start, start + m), max(1, 65536 // m)
                if m <= SMALL_BUCKET or (group[member] == group[start]).all():
                    continue
                for k in range(0, m, rows):
                    one, right = member[k : k + rows, None], member[k:]
                    a, b = np.nonzero(may(one, right) & (right > one))
                    i, j = one[a, 0], right[b]
                    good = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1) <= limit
                    i, j = i[good], j[good]
                    good = alike.filter(i, j)
                    out.append((ids[i[good]], ids[j[good]]))
            if out:
                u, v = (np.concatenate(x) for x in zip(*out, strict=True))
                pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def similar_pairs(met: DataFrame, width: int, bands: int, similarity: float = 0.8, nearest: bool = False) -> DataFrame:
    """(u, v): ids of different groups that share a bucket and whose wide fingerprints differ in no more bits than ``similarity``
    gives, with four standard deviations added, so that the filter loses almost no pair at it; sketches discard further. ``met`` has
    id, group, n, wide, codes, sketch. Without ``nearest`` these are all such pairs of all buckets. With it only larger buckets are looked at, and each row has
    one pair at most: its nearest partner in all of them."""
    turned, bits = turned_bits(similarity), 64 * math.ceil(width * bands / 64)
    limit = math.floor(bits * turned + 4 * math.sqrt(bits * turned * (1 - turned)))
    least_size = SMALL_BUCKET + 1 if nearest else 0
    names = "band short, key int, cell long, id long, group long, n long, block long, wide binary, sketch binary"
    cells = (
        met.select("id", "group", "n", "wide", "codes", "sketch").mapInArrow(lambda batches: _cells(batches, width, bands, least_size), names)
        .repartition("band", "key", "cell").sortWithinPartitions("band", "key", "cell", "id")
    )
    if not nearest:
        return cells.mapInArrow(_near_in_cells(limit, similarity), "u long, v long").distinct()
    found = cells.mapInArrow(_nearest_in_cells(limit, similarity), "u long, d long, v long").groupBy("u").agg(F.min(F.struct("d", "v"))["v"].alias("v"))
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def verified_pairs(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> DataFrame:
    """Those of ``pairs``, a written table, whose texts' sets of shingles have a Jaccard similarity of at least ``similarity``, by 64-bit hashes."""
    import numpy as np

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [shingle_hashes(x, size).tobytes() for x in batch.column(1).cast(pa.binary()).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(made, pa.binary())], names=["id", "shingles"])

    def alike(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (len(x) + len(y) - both) - 1e-9

    def verify(batches):
        for batch in batches:
            keep = [alike(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    bounded_batches(docs.sparkSession, 200)  # two sets a row
    # Only texts of candidates are shuffled, as their hashes.
    rows = docs.select(F.col(id_col).cast("long").alias("digest"), whole_text(text_col).alias("text")).where("digest is not null")
    chosen = passing(rows, pairs.select(F.col("u").alias("digest")).union(pairs.select("v")).distinct())
    sets = materialise(map_batches(chosen.select("digest", "text"), hashed, "id long, shingles binary"), "shingles")
    both = (
        pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
        .join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
        .select("u", "v", "a", "b")
    )
    return both.mapInArrow(verify, "u long, v long")


#: Rounds in which each row is linked with its nearest partner of another group, before all pairs of different groups are compared.
CONTRACTIONS = 2


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, report: dict | None = None) -> DataFrame:
    """(node, root) for every id that is linked with another: the groups that links connect, root being the smallest id.

    Texts are linked at ``similarity`` of their sets of shingles of ``size`` words: wide fingerprints (over 1000 bits) give the
    candidates, the sets decide. A group of near copies is contracted first, so that it costs a few verified pairs a row and not all
    of its pairs: in each of the first rounds a row proposes one partner, the nearest of another group in all its larger buckets.
    Then all pairs of rows of different groups are compared in all buckets, whatever their size. ``report`` gets the pairs verified
    in each round.
    """
    width, bands = banding(docs.count(), similarity)
    marks = materialise(wide_fingerprints(docs, width, bands, id_col, text_col, size), "wide")
    met = materialise(marks.join(meetings(marks, width, bands, similarity), "id"), "met")
    drop_written(marks)  # from here on only rows that may have a partner are read
    roots = None
    for k in range(CONTRACTIONS + 1):
        known = met.withColumn("group", F.col("id"))
        if roots is not None:
            known = met.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("root", "id")).drop("root")
        candidates = materialise(similar_pairs(known, width, bands, similarity, nearest=k < CONTRACTIONS), f"candidates-{k}")
        if report is not None:
            report.setdefault("verified", []).append(candidates.count())
        links_ = verified_pairs(candidates, docs, id_col, text_col, size, similarity)
        if roots is not None:
            links_ = links_.unionByName(roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = materialise(connected_components(links_), f"groups-{k}")
    return roots


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of ``near_groups`` stays: the smallest id.

    Defined results: a null text is the empty text; a text of up to ``size`` words is one shingle, so equal short texts are one group; rows
    without an id are left alone; rows that repeat an id go or stay together, linked by any of their texts, and are not told apart;
    very long texts take part whole; an empty table gives an empty result; extra columns are kept.
    """
    gone = near_groups(docs, id_col, text_col, size, similarity).where("node <> root").select(F.col("node").alias("_near_gone"))
    return docs.join(gone, docs[id_col].cast("long") == gone["_near_gone"], "left_anti")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
