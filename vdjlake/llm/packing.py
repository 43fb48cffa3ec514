"""Filling fixed-capacity containers with whole documents by swap-based local search.

Documents are spread over shards of about ``SHARD_ITEMS`` items by a hash of
their id; a shard is packed in one task. The start is cheap: documents in the
order of their hash go into the open container until one does not fit. The local
search does the packing: the emptiest container moves one document, or exchanges
one for one or two for one, with the fuller container where that brings most
tokens. Every step raises the sum of squared fills, so the fuller container gets
fuller and the emptier one runs empty; the search goes on until no step raises
it, or the shard has as few containers as its items allow. The containers of the
shards that stay visibly underfull are opened once more and packed together, in
shards again.

The best step of a container is found among all single documents and all pairs of
its documents against all documents of the shard: what can be taken for s tokens is
the smallest document whose container has room for s without it, which one table
over the capacity answers. Pairs are few, since the documents of one container have
no more different sizes than sum up to the capacity.

The work of a shard is bounded by its number of items, so the whole is linear in
the number of documents, and the space lost is about one container per shard of
the second pass.

Defined cases: a document above the capacity is cut into full containers and a
rest, which is packed like a document; documents of no tokens go into the
shard's first container; null ids are left out; a repeated id counts once, by
its largest size; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjlake.session import discard, table

#: Items of one shard.
SHARD_ITEMS = 4_000
#: Containers of the first pass below this fill are opened again.
REOPEN = 0.995


def first_packing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Next fit in the given order: (container of each item, fill of each container)."""
    where = np.zeros(len(sizes), dtype=np.int64)
    fills: list[int] = []
    for i, s in enumerate(sizes.tolist()):
        if not fills or fills[-1] + s > capacity:
            fills.append(0)
        fills[-1] += s
        where[i] = len(fills) - 1
    return where, np.array(fills, dtype=np.int64)


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """A lower bound of the containers: large items cannot share, and what is left must fit beside them."""
    s = np.sort(sizes)
    total = np.concatenate([[0], np.cumsum(s)])
    best = -(-int(total[-1]) // capacity)
    half = int(np.searchsorted(s, capacity / 2, side="right"))
    for alpha in np.unique(np.concatenate([[0], s[:half]]))[:: max(1, half // 200)]:
        low = int(np.searchsorted(s, alpha))
        high = int(np.searchsorted(s, capacity - alpha, side="right"))
        beside = (high - half) * capacity - int(total[high] - total[half])
        more = max(0, -(-(int(total[half] - total[low]) - beside) // capacity))
        best = max(best, len(s) - half + more)
    return best


class Search(NamedTuple):
    """Result of the local search: container of each item, fills, and how often each item was moved."""

    where: np.ndarray
    fills: np.ndarray
    moved: np.ndarray


def local_search(sizes: np.ndarray, where: np.ndarray, fills: np.ndarray, capacity: int) -> Search:
    """Moves and exchanges between underfull containers until none raises the squared fill.

    The donor is the emptiest container that may still give; each step puts as
    much of it as fits into fuller ones. ``sizes`` are positive.
    """
    where, fills, moved = where.copy(), fills.copy(), np.zeros(len(sizes), dtype=np.int64)
    inside = [set(x.tolist()) for x in np.split(np.argsort(where, kind="stable"), np.cumsum(np.bincount(where, minlength=len(fills)))[:-1])]
    pairs: dict[int, np.ndarray] = {}  # of the containers that have not changed since
    stuck = np.zeros(len(fills), dtype=bool)
    while True:
        open_ = np.flatnonzero((fills > 0) & (fills < capacity))
        may = open_[~stuck[open_]]
        if len(open_) < 2 or not len(may):
            break
        a = int(may[np.argmin(fills[may])])
        step = _best_step(a, sizes, where, fills, capacity, inside, open_, pairs)
        if step is None:
            stuck[a] = True
            continue
        give, take, b = step
        for i, (x, y) in [(i, (a, b)) for i in give] + [(i, (b, a)) for i in take]:
            where[i] = y
            inside[x].remove(i)
            inside[y].add(i)
            moved[i] += 1
        n = int(sizes[give].sum() - sizes[take].sum())
        fills[a] -= n
        fills[b] += n
        pairs.pop(a, None), pairs.pop(b, None)
        stuck[:] = False  # spaces have changed
    return Search(where, fills, moved)


def _pairs(items: set, sizes: np.ndarray, b: int) -> np.ndarray:
    """Rows (sum, document, document, container) of every two sizes among the documents of one container."""
    at = np.array(sorted(items), dtype=np.int64)
    value, first, n = np.unique(sizes[at], return_index=True, return_counts=True)
    last = len(at) - 1 - np.unique(sizes[at][::-1], return_index=True)[1]
    x, y = np.triu_indices(len(value), 1)
    two = np.flatnonzero(n > 1)
    i, j = np.concatenate([first[x], first[two]]), np.concatenate([first[y], last[two]])
    return np.stack([sizes[at[i]] + sizes[at[j]], at[i], at[j], np.full(len(i), b)])


def _best_step(a: int, sizes: np.ndarray, where: np.ndarray, fills: np.ndarray, capacity: int, inside: list[set], open_: np.ndarray, pairs: dict[int, np.ndarray]) -> tuple[list[int], list[int], int] | None:
    """(documents of ``a`` to give, documents to take, container of the other side) that brings most tokens out of ``a``."""
    bins = open_[(fills[open_] >= fills[a]) & (open_ != a)]
    if not len(bins):
        return None
    mine = np.array(sorted(inside[a]), dtype=np.int64)
    two = pairs[a] if a in pairs else pairs.setdefault(a, _pairs(inside[a], sizes, a))
    given = np.concatenate([sizes[mine], two[0]])
    # what leaves the other side to make room: nothing (size 0) or a document; then two documents
    takes = np.zeros(len(fills), dtype=bool)
    takes[bins] = True
    docs = np.flatnonzero(takes[where])
    size, at = np.concatenate([np.zeros(len(bins), dtype=np.int64), sizes[docs]]), np.concatenate([bins, where[docs]])
    for last in (False, True):
        room = capacity - fills[at] + size
        smallest = np.full(capacity + 1, np.iinfo(np.int64).max // 2)
        np.minimum.at(smallest, room, size)
        smallest = np.minimum.accumulate(smallest[::-1])[::-1]
        gain = np.where(given <= capacity, given - smallest[np.minimum(given, capacity)], 0)
        k = int(np.argmax(gain))
        if gain[k] > 0:
            fits = np.flatnonzero((size == given[k] - gain[k]) & (room >= given[k]))
            j = int(fits[np.argmin(room[fits])])  # the closest fit
            give = [int(mine[k])] if k < len(mine) else two[1:3, k - len(mine)].tolist()
            take = others[1:3, j].tolist() if last else [int(docs[j - len(bins)])] if j >= len(bins) else []
            return give, take, int(at[j])
        if not last:
            for b in bins.tolist():
                if b not in pairs:
                    pairs[b] = _pairs(inside[b], sizes, b)
            others = np.concatenate([pairs[b] for b in bins.tolist()], axis=1)
            size, at = others[0], others[3]
    return None


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(container of each item, numbered without gaps; moves of each item; containers of the start)."""
    sizes = np.asarray(sizes, dtype=np.int64)
    where, moved, began = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), 1
    some = np.flatnonzero(sizes > 0)
    if len(some):
        w, f = first_packing(sizes[some], capacity)
        found = local_search(sizes[some], w, f, capacity)
        where[some] = np.unique(found.where, return_inverse=True)[1]
        moved[some], began = found.moved, len(f)
    return where, moved, began


_SCHEMA = "doc_id long, part int, tokens long, shard long, bin long, fill long, moved long, began long"


def _pack_shard(pdf: pd.DataFrame, capacity: int, count: bool = True) -> pd.DataFrame:
    """One shard packed; ``moved`` adds up, ``began`` counts the first pass's first containers once, in a shard's first row."""
    pdf = pdf.sort_values(["place", "doc_id", "part"], kind="stable").reset_index(drop=True)
    pdf["bin"], moved, began = pack(pdf["tokens"].to_numpy(), capacity)
    pdf["moved"] += moved
    if count:
        pdf.loc[0, "began"] = began
    pdf["fill"] = pdf.groupby("bin")["tokens"].transform("sum")
    return pdf[["doc_id", "part", "tokens", "shard", "bin", "fill", "moved", "began"]]


def _shards(items: DataFrame, n: int, salt: int) -> DataFrame:
    place = F.xxhash64("doc_id", "part", F.lit(salt))
    return items.withColumn("place", place).withColumn("shard", F.pmod("place", F.lit(n)).cast("long"))


def searched(sizes: DataFrame, key: str, tokens: str, capacity: int = 2048, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows of :func:`containers` with ``moved``, the search steps that moved the document, and ``began``, which adds up to the containers before the search."""
    docs = sizes.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("doc_id")).agg(F.greatest(F.max(F.coalesce(F.col(tokens), F.lit(0))), F.lit(0)).cast("long").alias("size"))
    parts = F.greatest(F.ceil(F.col("size") / F.lit(capacity)).cast("int"), F.lit(1))
    items = docs.select("doc_id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "size").select(
        "doc_id", "part", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("part") * F.lit(capacity)).alias("tokens")
    )
    items = table(items.withColumn("moved", F.lit(0).cast("long")).withColumn("began", F.lit(0).cast("long")), "items")
    n = max(1, -(-items.count() // shard_items))
    run = lambda pdf: _pack_shard(pdf, capacity)
    first = table(_shards(items, n, 0).groupBy("shard").applyInPandas(run, _SCHEMA), "packed")
    discard(items)
    kept = first.where(F.col("fill") >= F.lit(int(capacity * REOPEN)))
    rest = first.where(F.col("fill") < F.lit(int(capacity * REOPEN))).select("doc_id", "part", "tokens", "moved", "began")
    m = max(1, -(-rest.count() // shard_items))
    again = lambda pdf: _pack_shard(pdf, capacity, count=False)
    second = _shards(rest, m, 1).groupBy("shard").applyInPandas(again, _SCHEMA).withColumn("shard", F.col("shard") + n)
    both = kept.unionByName(second)
    return both.select(
        F.col("doc_id").alias(key), "part", (F.col("part").cast("long") * capacity).alias("first_token"), "tokens", F.concat_ws("-", "shard", "bin").alias("container"), "fill", "moved", "began"
    )


def containers(sizes: DataFrame, key: str, tokens: str, capacity: int = 2048, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``<key>, part, first_token, tokens, container, fill``: every document whole in one container.

    ``part`` is 0 but for documents above the capacity, whose parts cover
    tokens first_token .. first_token + tokens - 1.
    """
    return searched(sizes, key, tokens, capacity, shard_items).drop("moved", "began")


def report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, the fewest possible, tokens, the share of space used, and what the search did (from :func:`searched`)."""
    bins = packed.groupBy("container").agg(F.sum("tokens").alias("fill"), F.sum("moved").alias("moved"), F.sum("began").alias("began"))
    return bins.agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(F.sum("fill") / F.lit(capacity)).cast("long").alias("fewest"),
        F.sum("fill").alias("tokens"),
        (F.sum("fill") / (F.count(F.lit(1)) * F.lit(capacity))).alias("used"),
        F.sum("began").alias("before_search"),
        (F.sum("began") - F.count(F.lit(1))).alias("emptied"),
        F.sum("moved").alias("moves"),
    )
