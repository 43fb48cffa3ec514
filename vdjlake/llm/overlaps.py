"""Overlap sizes between all pairs of many large sets.

Identifiers are range-partitioned; within a range each set is a sorted run, and
a heap merges the runs k ways. At each identifier the counters of every pair of
sets that hold it are incremented, so an intersection is never materialised and
no pair of rows ever leaves a task: a task sends one partial count per pair of
sets that met in its range, and those are added up.

The rows are written once, so that their number sets the number of ranges: a task
holds about ``RANGE_ROWS`` rows, however many there are. The counts are written once
as well, since both set sizes and overlaps are read from them.

Counters per task grow with the number of pairs of sets, not with identifiers.
An identifier belongs to a set once, so a common identifier costs at most one
row per set.

Defined cases: null identifiers and null set names are left out; repeated rows
count once; pairs that share nothing have no row; empty tables give empty
results; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjlake.session import discard, slots, table

#: Rows of one range.
RANGE_ROWS = 300_000

_OUT = pa.schema([("set_a", pa.string()), ("set_b", pa.string()), ("n", pa.int64())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by set, then identifier: each set's rows are one sorted run."""
    runs: dict[str, list[str]] = {}
    for b in batches:
        names, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
        for name, rows in groupby(zip(names, ids), key=itemgetter(0)):
            runs.setdefault(name, []).extend(i for _, i in rows)
    names = sorted(runs)
    counts: Counter = Counter()
    tagged = (zip(runs[n], [k] * len(runs[n])) for k, n in enumerate(names))
    for _, rows in groupby(heapq.merge(*tagged), key=itemgetter(0)):
        at = [k for _, k in rows]
        for k in at:
            counts[k, k] += 1
        counts.update(combinations(at, 2))
    if counts:
        a, b, n = zip(*((names[i], names[j], c) for (i, j), c in counts.items()))
        for s in range(0, len(n), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 50_000], type=f.type) for x, f in zip((a, b, n), _OUT)], schema=_OUT)


def shared_counts(members: DataFrame, set_name: str, identifier: str, tasks: int | None = None) -> DataFrame:
    """``set_a, set_b, shared``: for set_a < set_b the shared identifiers, for set_a = set_b the set's size."""
    rows = table(members.select(F.col(set_name).alias("s"), F.col(identifier).alias("i")).where("s is not null and i is not null").distinct(), "members")
    tasks = tasks or max(slots(members.sparkSession), -(-rows.count() // RANGE_ROWS))
    parts = rows.repartitionByRange(tasks, "i").sortWithinPartitions("s", "i").mapInArrow(_merge, "set_a string, set_b string, n long")
    out = table(parts.groupBy("set_a", "set_b").agg(F.sum("n").alias("shared")), "overlaps")
    discard(rows)
    return out


def overlaps(members: DataFrame, set_name: str, identifier: str, tasks: int | None = None) -> DataFrame:
    """``set_a, set_b, shared, size_a, size_b``: every pair of sets that share an identifier."""
    counts = shared_counts(members, set_name, identifier, tasks)
    sizes = counts.where("set_a = set_b")
    a = sizes.select(F.col("set_a"), F.col("shared").alias("size_a"))
    b = sizes.select(F.col("set_b"), F.col("shared").alias("size_b"))
    return counts.where("set_a <> set_b").join(a, "set_a").join(b, "set_b").select("set_a", "set_b", "shared", "size_a", "size_b")
