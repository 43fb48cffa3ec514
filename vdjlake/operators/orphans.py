"""References to records that do not exist, by dictionary codes and bitmaps.

Keys are dictionary-encoded: the sorted distinct keys of a key range get the
integers 0..n-1 within the range, so a key is (range, position) and a set of
keys is a bitmap per range. References make one bitmap per (table, period) and
range; parents make bitmaps of the keys that exist, of the keys that are alive
and, per period, of those available before its start. ``reference AND NOT
parent`` leaves the orphans, whose bits the dictionary decodes back to keys.

Bitmaps are compressed in the manner of container formats: a range holds at
most ``RANGE_BITS`` positions, and of each bitmap only the 64-bit words that
are not zero are kept, with their indexes.

Before the codes are given, rows are combined per (key, table, period), so a
key named by a third of all rows arrives as a few rows per period. Ranges are
hash ranges of the key split over the tasks and cut every ``RANGE_BITS`` keys,
so no range grows with the data.

Defined cases: null and empty keys are no references; a reference with a null
time belongs to the period null and cannot be late; repeated rows count once;
empty tables give empty results; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vdjlake.session import shuffle_partitions

#: Positions of one range: 65,536 bits are 8 kB uncompressed.
RANGE_BITS = 1 << 16

_KINDS = np.array(["missing", "deleted", "late"])


class Bitmap:
    """Set of positions below ``RANGE_BITS`` as the non-zero words and their indexes."""

    __slots__ = ("at", "words")

    def __init__(self, at: np.ndarray, words: np.ndarray):
        self.at, self.words = at, words

    @classmethod
    def of(cls, positions: np.ndarray) -> Bitmap:
        positions = np.unique(np.asarray(positions, dtype=np.int64))
        at, start = np.unique(positions >> 6, return_index=True)
        bits = np.left_shift(np.uint64(1), (positions & 63).astype(np.uint64))
        words = np.bitwise_or.reduceat(bits, start) if len(bits) else bits
        return cls(at, words)

    def _aligned(self, other: Bitmap) -> np.ndarray:
        """The other's words at this bitmap's indexes, zero where it has none."""
        out = np.zeros(len(self.at), dtype=np.uint64)
        if len(other.at):
            k = np.minimum(np.searchsorted(other.at, self.at), len(other.at) - 1)
            hit = other.at[k] == self.at
            out[hit] = other.words[k[hit]]
        return out

    def _kept(self, words: np.ndarray) -> Bitmap:
        keep = words != 0
        return Bitmap(self.at[keep], words[keep])

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._kept(self.words & ~self._aligned(other))

    def and_(self, other: Bitmap) -> Bitmap:
        return self._kept(self.words & self._aligned(other))

    def positions(self) -> np.ndarray:
        if not len(self.at):
            return np.zeros(0, dtype=np.int64)
        bits = np.unpackbits(self.words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w, b = np.nonzero(bits)
        return self.at[w] * 64 + b

    def __len__(self) -> int:
        return int(np.bitwise_count(self.words).sum())


_OUT = pa.schema([("src", pa.int32()), ("period", pa.string()), ("key", pa.string()), ("kind", pa.string())])


def _range_orphans(key: np.ndarray, src: np.ndarray, period: np.ndarray, time: np.ndarray) -> pa.RecordBatch | None:
    """The orphans of one range. Rows are sorted by key; src -1 is the parent.

    ``time`` of a parent is its earliest live load (NaT where none lives); of a
    reference the earliest time of its rows in the period.
    """
    refs = src >= 0
    if not refs.any():
        return None
    new = np.empty(len(key), dtype=bool)
    new[0] = True
    new[1:] = key[1:] != key[:-1]
    code = np.cumsum(new) - 1  # the dictionary: code -> decode[code]
    decode = key[new]
    parent = ~refs
    loaded = np.full(len(decode), np.iinfo(np.int64).max)
    alive = parent & (time != _NULL)
    loaded[code[alive]] = time[alive]
    exists, living = Bitmap.of(code[parent]), Bitmap.of(code[alive])
    out = []
    r_code, r_src, r_time, r_period = code[refs], src[refs], time[refs], period[refs]
    names, number = np.unique(r_period.astype("U7"), return_inverse=True)
    group = r_src.astype(np.int64) * len(names) + number
    order = np.argsort(group, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        month = names[number[rows[0]]]
        bits = Bitmap.of(r_code[rows])
        found = [(bits.and_not(exists), 0), (bits.and_(exists).and_not(living), 1)]
        times = r_time[rows]
        known = times[times != _NULL]
        if len(known):
            # parents there before the period's first reference satisfy all of it
            before = Bitmap.of(code[alive][time[alive] <= known.min()])
            open_ = bits.and_(living).and_not(before).positions()
            if len(open_):  # only the surviving bits are compared with their own time
                run = np.full(len(decode), _NULL)
                run[r_code[rows]] = times
                late = open_[(run[open_] != _NULL) & (loaded[open_] > run[open_])]
                found.append((Bitmap.of(late), 2))
        for b, kind in found:
            if len(b):
                p = b.positions()
                out.append((np.full(len(p), r_src[rows[0]], dtype=np.int32), np.full(len(p), month, dtype=object), decode[p], np.full(len(p), _KINDS[kind], dtype=object)))
    if not out:
        return None
    cols = [np.concatenate(c) for c in zip(*out)]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _OUT)], schema=_OUT)


_NULL = np.iinfo(np.int64).min


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted rows into ranges of at most RANGE_BITS keys; a key never spans two ranges."""
    held: list[tuple] = []
    rows = 0

    def parts(batch: pa.RecordBatch) -> tuple:
        t = np.array(batch.column(3).fill_null(_NULL).to_numpy(zero_copy_only=False))
        return (
            batch.column(0).to_numpy(zero_copy_only=False),
            batch.column(1).to_numpy(zero_copy_only=False),
            batch.column(2).fill_null("").to_numpy(zero_copy_only=False),
            t,
        )

    def joined() -> tuple:
        return tuple(np.concatenate(c) for c in zip(*held))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(parts(batch))
        rows += batch.num_rows
        if rows >= RANGE_BITS:
            all_ = joined()
            cut = len(all_[0])
            while cut and all_[0][cut - 1] == all_[0][-1]:  # the last key may go on
                cut -= 1
            for lo, hi in _ranges(all_[0], cut):
                if (b := _range_orphans(*(c[lo:hi] for c in all_))) is not None:
                    yield b
            held, rows = [tuple(c[cut:] for c in all_)], len(all_[0]) - cut
    if rows:
        all_ = joined()
        for lo, hi in _ranges(all_[0], len(all_[0])):
            if (b := _range_orphans(*(c[lo:hi] for c in all_))) is not None:
                yield b


def _ranges(key: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    if not n:
        return
    starts = np.concatenate([[0], np.flatnonzero(key[1:n] != key[: n - 1]) + 1])
    edges = [*starts[::RANGE_BITS], n]
    yield from zip(edges[:-1], edges[1:])


def orphans(
    references: dict[str, tuple[DataFrame, str | Column, str]],
    parents: DataFrame,
    parent_key: str | Column,
    loaded_at: str,
    deleted_at: str,
) -> DataFrame:
    """``ref_table, run_month, key, kind`` of every reference without a usable parent.

    ``references`` maps a table's name to (table, key column, time column).
    ``missing``: no parent row; ``deleted``: all its rows are deleted;
    ``late``: the earliest load of its live rows is after the reference.
    """
    spark = parents.sparkSession
    names = sorted(references)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    key = lambda c: F.col(c) if isinstance(c, str) else c
    tagged = parents.select(
        key(parent_key).alias("key"),
        F.lit(-1).alias("src"),
        F.lit(None).cast("string").alias("period"),
        F.when(F.col(deleted_at).isNull(), micros(loaded_at)).alias("time"),
    )
    for i, n in enumerate(names):
        df, k, at = references[n]
        tagged = tagged.unionByName(
            df.select(key(k).alias("key"), F.lit(i).alias("src"), F.date_format(F.col(at).cast("timestamp"), "yyyy-MM").alias("period"), micros(at).alias("time"))
        )
    once = tagged.where("key is not null and key <> ''").groupBy("key", "src", "period").agg(F.min("time").alias("time"))
    sorted_ = once.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    found = sorted_.mapInArrow(_encode, "src int, period string, key string, kind string")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("src") + 1)
    return found.select(label.alias("ref_table"), F.when(F.col("period") != "", F.col("period")).alias("run_month"), "key", "kind")


def orphan_report(found: DataFrame) -> DataFrame:
    """``ref_table, run_month, kind, orphans``: how many keys per table, period and kind."""
    return found.groupBy("ref_table", "run_month", "kind").agg(F.count(F.lit(1)).alias("orphans"))
