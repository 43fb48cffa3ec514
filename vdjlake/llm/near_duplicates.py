"""Groups of texts that are nearly equal, by an LSH forest and an exact check.

Distinct texts of a block stand for their copies. Each gets several signatures;
a signature orders all texts of a block. Trees of one kind sample letters at
fixed relative places (texts that differ by replaced or moved letters agree
there), trees of the other kind take the least hash of the short grams within a
window (texts that differ by insertions and losses agree there).

Candidates are neighbours in these orders with the longest common prefix: the
depth is chosen per region, as the shortest prefix that at most ``LEAF`` texts
share, and all texts of such a region are candidates of each other. A region that
shares a whole signature may have ``WIDE`` texts; where more do, the depth goes on
over the elements of a 128-bit sketch, and texts that share even all of that are
compared with their neighbours and with the first of them, so no region costs more
than its size times ``WIDE``. The sketch also drops candidates that share next to
nothing, before the exact check.

The exact check is the edit distance in which a replaced, inserted or lost
letter is one edit, and so are two neighbouring stretches of at most ``STRETCH``
letters that change places. It runs in steps: the plain edit distance inside the
JVM, and the distance with moves for the pairs beyond it which share as many
grams as pairs must that are edited so often, ``moves`` of the edits being moves
(``moves=None`` checks all of them).

Groups are found in two passes: the first compares direct neighbours of a few
orders and merges what it finds; the second emits only candidates that lie in
different groups, so a large family of near copies costs rows, not pairs.

Work per text is fixed: a row of 49 bytes per tree goes through one exchange keyed
by tree, block and first signature element. Elements that a sample of a large block
shows to be shared by more than ``HOT`` texts are taken together with the next one,
and so on: such a prefix has far more texts than a region, so no region is split. The
sorted rows are walked in chunks that overlap by the largest region, so a task holds
one chunk, however many texts share a prefix.

Defined cases: null texts take no part; texts of six letters or fewer have only
equal partners; copies are grouped without comparison; empty tables give empty
results; texts of any length are compared whole.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjlake.llm.components import components
from vdjlake.session import discard, shuffle_partitions, table

#: Orders of each kind: sampled letters, windows.
TREES = (10, 10)
#: Of these, the ones whose direct neighbours are compared first.
FIRST = (4, 3)
#: Elements of a signature, a byte each.
DEPTH = 6
#: Texts of a region that are all compared; the same for a region that shares a whole signature.
LEAF, WIDE = 24, 128
#: Texts of a block and prefix that one task may sort; more are spread by a longer prefix. One in ``SAMPLE`` tells.
HOT, SAMPLE = 1_000_000, 64
#: Letters of a stretch that may change places with its neighbour as one edit.
STRETCH = 9
#: Largest part of the longer text that may be edited.
EDITS = 0.15
#: Moves among the edits of a pair that the gram filter lets through; None for all.
MOVES = 2
#: Lengths up to which short grams are used, and from which long ones; between them both.
#: Linked texts always share a kind: 0.85 of a length above 236 is above 170.
SHORT_UPTO, LONG_FROM = 236, 170


def allowed(length: int) -> int:
    return int(EDITS * length + 1e-9)


# ---- signatures


def _mix(x: np.ndarray, odd: np.ndarray) -> np.ndarray:
    h = x * odd
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _numbers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 31, n, dtype=np.int64).astype(np.uint32) | np.uint32(1)


def _grams(a: np.ndarray, q: int) -> np.ndarray:
    g = np.zeros((a.shape[0], a.shape[1] - q + 1), dtype=np.uint32)
    for i in range(q):
        g = g * np.uint32(257) + a[:, i : a.shape[1] - q + 1 + i]
    return g


def _window_elements(g: np.ndarray, size: np.ndarray, width: np.ndarray, places: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Least hash of the grams in a window, per row and element."""
    n, out = len(size), []
    span = int(width.max())
    room = np.maximum(size - width, 0)
    steps = np.arange(span)
    for f, s in zip(places, seeds):
        start = np.rint(f * room).astype(np.int64)
        at = start[:, None] + steps[None, :]
        h = _mix(g[np.arange(n)[:, None], np.minimum(at, g.shape[1] - 1)], s)
        h[(steps[None, :] >= width[:, None]) | (at >= size[:, None])] = np.uint32(0xFFFFFFFF)
        out.append(h.min(axis=1))
    return np.stack(out, axis=1)


def _letters(a: np.ndarray, length: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Letters at relative places; the left half counts from the left, the right half from the right."""
    left = places < 0.5
    at = np.where(left[None, :], np.floor(places[None, :] * length[:, None]), length[:, None] - 1 - np.floor((1 - places[None, :]) * length[:, None]))
    return a[np.arange(len(length))[:, None], np.clip(at, 0, length[:, None] - 1).astype(np.int64)]


def signatures(texts: list[str], protein: bool, family: int, kinds: tuple[int, int] = TREES) -> tuple[np.ndarray, np.ndarray]:
    """(keys: rows x trees as uint64, sketch: rows x 2 as uint64) of texts of similar length."""
    raw = [t.encode("ascii", "replace") for t in texts]
    length = np.array([len(r) for r in raw])
    top = int(length.max())
    a = np.frombuffer(b"".join(r.ljust(top, b"\0") for r in raw), dtype=np.uint8).reshape(len(raw), top)
    q = (2 if protein else 4) if family == 0 else (4 if protein else 8)
    q = min(q, int(length.min()))
    g = _grams(a, q)
    size = length - q + 1
    width = np.minimum(np.maximum((7 if protein else 13), length // 4), size)
    letters, windows = kinds
    per = 2 if protein else 3
    rng = np.random.default_rng(11)
    keys = np.zeros((len(raw), letters + windows), dtype=np.uint64)
    for t in range(letters):
        # every other tree counts its places from one end only, for texts that lost letters at the other
        places = rng.random(DEPTH * per)
        if t % 5 == 3:
            places = places * 0.499
        elif t % 5 == 4:
            places = 1 - places * 0.5
        x = _letters(a, length, places).astype(np.uint32)
        key = np.zeros(len(raw), dtype=np.uint64)
        for d in range(DEPTH):
            e = np.zeros(len(raw), dtype=np.uint32)
            for i in range(per):
                e = e * np.uint32(31) + x[:, d * per + i]
            key = (key << np.uint64(8)) | (_mix(e, np.uint32(0x9E3779B1)) & np.uint32(0xFF)).astype(np.uint64)
        keys[:, t] = key
    for t in range(windows):
        e = _window_elements(g, size, width, rng.random(DEPTH), _numbers(100 + t, DEPTH))
        key = np.zeros(len(raw), dtype=np.uint64)
        for d in range(DEPTH):
            key = (key << np.uint64(8)) | (_mix(e[:, d], np.uint32(0x9E3779B1)) & np.uint32(0xFF)).astype(np.uint64)
        keys[:, letters + t] = key
    w = _mix(_window_elements(g, size, width, (np.arange(16) + 0.5) / 16, _numbers(7, 16)), np.uint32(0x9E3779B1)) & np.uint32(15)
    hi = np.zeros(len(raw), dtype=np.uint64)
    for i in range(16):
        hi = (hi << np.uint64(4)) | w[:, i].astype(np.uint64)
    even = (np.arange(16) + 0.5) / 16
    lo = np.zeros(len(raw), dtype=np.uint64)
    for ends in (even * 0.4999, 1 - even * 0.5):  # each half twice as dense as a whole would be
        x = (_letters(a, length, ends) >> 1) & 3 if not protein else _mix(_letters(a, length, ends).astype(np.uint32), np.uint32(0x9E3779B1)) & np.uint32(3)
        for i in range(16):
            lo = (lo << np.uint64(2)) | x[:, i].astype(np.uint64)
    return keys, np.stack([hi, lo], axis=1)


_ROW = pa.schema([("tree", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("key", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("rep", pa.int64()), ("grp", pa.int64()), ("open", pa.bool_())])
_ROW_DDL = "tree int, block long, first long, key long, hi long, lo long, rep long, grp long, open boolean"


def _plant(batches: Iterator[pa.RecordBatch], trees: tuple[int, ...], kinds: tuple[int, int], hot: tuple[tuple[int, int, int, int], ...] = ()) -> Iterator[pa.RecordBatch]:
    """A row per text and tree. Columns in: rep, grp, block, protein, open, text.

    ``hot`` lists (tree, block, elements, prefix) whose texts are spread by one element more.
    """
    more: dict[tuple[int, int], dict[int, np.ndarray]] = {}
    for tree, b, depth, prefix in hot:
        of = more.setdefault((tree, b), {})
        of[depth] = np.append(of.get(depth, np.zeros(0, dtype=np.uint64)), np.uint64(prefix))
    hot_blocks = {b for _, b in more}
    for b in batches:
        rep, grp, block, protein, open_ = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        texts = b.column(5).to_pylist()
        length = np.array([len(t) for t in texts])
        for kind in (False, True):
            for family in (0, 1):
                pick = np.flatnonzero((protein == kind) & (length > 6) & ((length <= SHORT_UPTO) if family == 0 else (length >= LONG_FROM)))
                pick = pick[np.argsort(length[pick], kind="stable")]
                lo = 0
                while lo < len(pick):
                    # rows of one step are padded to the longest: bound the padded letters
                    hi = lo + max(1, min(2000, 2_000_000 // max(1, int(length[pick[lo]]))))
                    p = pick[lo:hi]
                    p = p[length[p] <= max(64, 2 * length[p[0]])]
                    lo += len(p)
                    keys, sketch = signatures([texts[i] for i in p], kind, family, kinds)
                    for t in trees:
                        k, tree = keys[:, t], t + 100 * family + 1000 * kind
                        first = (k >> np.uint64(8 * (DEPTH - 1))).astype(np.int64)
                        for at in hot_blocks.intersection(block[p].tolist()) if hot_blocks else ():
                            deeper = block[p] == at
                            for d in range(1, DEPTH):
                                prefix = k >> np.uint64(8 * (DEPTH - d))
                                deeper = deeper & np.isin(prefix, more.get((tree, at), {}).get(d, np.zeros(0, dtype=np.uint64)))
                                if not deeper.any():
                                    break
                                first[deeper] = ((k[deeper] >> np.uint64(8 * (DEPTH - d - 1))) + np.uint64(d << 48)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(p), tree, dtype=np.int32)),
                                pa.array(block[p]),
                                pa.array(first),
                                pa.array(k.astype(np.int64)),
                                pa.array(sketch[:, 0].view(np.int64)),
                                pa.array(sketch[:, 1].view(np.int64)),
                                pa.array(rep[p]),
                                pa.array(grp[p]),
                                pa.array(open_[p]),
                            ],
                            schema=_ROW,
                        )


# ---- candidates


def _similar(hi_a, lo_a, hi_b, lo_b, long) -> np.ndarray:
    """The sketches share more than unrelated texts do; long grams hardly ever agree by chance."""
    x = hi_a ^ hi_b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    windows = 16 - np.bitwise_count(x & np.uint64(0x1111111111111111)).astype(np.int16)
    y = lo_a ^ lo_b
    y = (y | (y >> np.uint64(1))) & np.uint64(0x5555555555555555)
    left = 16 - np.bitwise_count(y >> np.uint64(32)).astype(np.int16)
    right = 16 - np.bitwise_count(y & np.uint64(0xFFFFFFFF)).astype(np.int16)
    both = left + right
    return (windows >= np.where(long, 4, 5)) | (left >= 11) | (right >= 11) | (both >= 19)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(cols: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the row pairs (i, j), those worth the exact check, smaller rep first."""
    tree, _, _, _, hi, lo, rep, grp, open_ = cols
    keep = (grp[i] != grp[j]) & (open_[i] | open_[j])
    i, j = i[keep], j[keep]
    keep = _similar(hi[i], lo[i], hi[j], lo[j], tree[i] // 100 % 10 == 1)
    i, j = rep[i[keep]], rep[j[keep]]
    return np.stack([np.minimum(i, j), np.maximum(i, j)], axis=1)


def _neighbours(cols: list[np.ndarray], reach: int) -> Iterator[np.ndarray]:
    """Rows next to each other in the order of their tree and block."""
    tree, block = cols[0], cols[1]
    for o in range(1, reach + 1):
        i = np.flatnonzero((tree[o:] == tree[:-o]) & (block[o:] == block[:-o]))
        yield _pairs(cols, i, i + o)


def _depths(cols: list[np.ndarray]) -> Iterator[tuple[bool, np.ndarray]]:
    """(whole signature, whether a row shares the prefix of the row before), deeper and deeper: elements of the key, then of the sketch."""
    tree, block, key, hi, lo = cols[0], cols[1], cols[3], cols[4], cols[5]
    same = (tree[1:] == tree[:-1]) & (block[1:] == block[:-1])
    for d in range(1, DEPTH + 1):
        prefix = key >> np.uint64(8 * (DEPTH - d))
        yield d == DEPTH, same & (prefix[1:] == prefix[:-1])
    same &= key[1:] == key[:-1]
    for word in (hi, lo):
        for shift in (48, 32, 16, 0):
            prefix = word >> np.uint64(shift)
            yield True, same & (prefix[1:] == prefix[:-1])
        same &= word[1:] == word[:-1]


def _regions(cols: list[np.ndarray], leaf: int, wide: int) -> Iterator[np.ndarray]:
    """All rows of each region: the shortest prefix that at most ``leaf`` rows share, or ``wide`` from the whole signature on."""
    grp, n = cols[7], len(cols[0])
    yield from _neighbours(cols, 2)
    left = np.ones(n, dtype=bool)
    number = np.zeros(n, dtype=np.int64)
    for whole, shares in _depths(cols):
        number = np.cumsum(np.concatenate([[True], ~shares])) - 1
        size = np.bincount(number)
        most = wide if whole else leaf
        fits = left & (size[number] <= most)
        at = np.flatnonzero(fits)  # regions are whole: either all of their rows fit or none
        left &= ~fits
        if len(at):
            # regions of one group need no comparison
            r = number[at]
            low, high = np.full(r.max() + 1, np.iinfo(np.int64).max), np.full(r.max() + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, r, grp[at])
            np.maximum.at(high, r, grp[at])
            mixed = (low != high)[r]
            at, r = at[mixed], r[mixed]
            for o in range(1, min(most, len(at))):
                i = np.flatnonzero(r[o:] == r[:-o])
                if not len(i):
                    break
                yield _pairs(cols, at[i], at[i + o])
        if not left.any():
            return
    at = np.flatnonzero(left)  # more than ``wide`` rows share all there is: neighbours, and the first of them
    r = number[at]
    first = np.concatenate([[True], r[1:] != r[:-1]])
    yield _pairs(cols, at[first][np.cumsum(first) - 1], at)
    for o in range(1, min(leaf, len(at))):
        i = np.flatnonzero(r[o:] == r[:-o])
        yield _pairs(cols, at[i], at[i + o])


def _harvest(batches: Iterator[pa.RecordBatch], find, overlap: int, chunk: int = 80_000) -> Iterator[pa.RecordBatch]:
    """Walks the sorted rows in chunks of bounded size that overlap by ``overlap`` rows.

    A region of up to ``overlap`` rows lies wholly in one chunk. At the border of a chunk a
    prefix seems to have fewer rows than it has, so more pairs are compared there, never fewer.
    """
    held: list[list[np.ndarray]] = []
    rows = 0

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = [p for p in find(cols) if len(p)]
        if parts:
            p = np.unique(np.concatenate(parts), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], schema=_PAIR)

    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
        c.pop(2)
        c.insert(2, c[0])  # the exchange key is needed no more
        for i in (3, 4, 5):
            c[i] = c[i].view(np.uint64)
        return c

    for b in batches:
        if not b.num_rows:
            continue
        held.append(columns(b))
        rows += b.num_rows
        if rows >= chunk:
            cols = [np.concatenate(c) for c in zip(*held)]
            yield from found(cols)
            held, rows = [[c[-overlap:] for c in cols]], min(overlap, rows)
    if rows:
        yield from found([np.concatenate(c) for c in zip(*held)])


def _hot(reps: DataFrame, trees: tuple[int, ...], kinds: tuple[int, int], hot: int, sample: int) -> tuple[tuple[int, int, int, int], ...]:
    """(tree, block, elements, prefix) shared by more than ``hot`` texts, as one text in ``sample`` tells; it steers the exchange only.

    The list has at most ``DEPTH`` times (rows / ``hot``) entries for each tree.
    """
    large = reps.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("block")
    if not large.take(1):
        return ()
    some = reps.join(F.broadcast(large), "block", "left_semi").where(F.pmod(F.xxhash64("rep"), F.lit(sample)) == 0)
    rows = some.select("rep", "grp", "block", "protein", "open", "text").mapInArrow(functools.partial(_plant, trees=trees, kinds=kinds), _ROW_DDL)
    depth = F.explode(F.expr(f"sequence(1, {DEPTH - 1})"))
    prefix = rows.select("tree", "block", "key", depth.alias("d")).groupBy("tree", "block", "d", F.expr(f"shiftrightunsigned(key, cast(8 * ({DEPTH} - d) as int))").alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return tuple((r["tree"], r["block"], r["d"], r["prefix"]) for r in prefix.where(F.col("n") * sample > hot).collect())


def _candidates(reps: DataFrame, trees: tuple[int, ...], find, kinds: tuple[int, int] = TREES, hot: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """``a, b``: distinct candidate pairs of reps."""
    spread = _hot(reps, trees, kinds, hot, sample)
    rows = reps.select("rep", "grp", "block", "protein", "open", "text").mapInArrow(functools.partial(_plant, trees=trees, kinds=kinds, hot=spread), _ROW_DDL)
    n = max(2 * shuffle_partitions(reps.sparkSession), 16)
    order = rows.repartition(n, "tree", "block", "first").sortWithinPartitions("tree", "block", "key", "hi", "lo", "rep")
    return order.mapInArrow(functools.partial(_harvest, find=find, overlap=WIDE), "a long, b long").distinct()


# ---- the exact check


def moves_distance(a: list[bytes], b: list[bytes], limit: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """Edit distance with moves of neighbouring stretches, for pairs at once; values above ``limit`` are some value above it.

    Banded: a result of at most ``limit`` never leaves the diagonals up to it.
    """
    n, band = len(a), int(limit.max())
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    top_a, top_b = int(la.max()), int(lb.max())
    wide = band + stretch
    # pairs lie along the last axis, so that shifting a diagonal moves whole rows of memory
    xa = np.ascontiguousarray(np.frombuffer(b"".join(x.ljust(top_a, b"\0") for x in a), dtype=np.uint8).reshape(n, top_a).T)
    pad = np.full((wide + top_a + wide + top_b + 1, n), 1, dtype=np.uint8)  # matches no letter of a
    pad[wide : wide + top_b] = np.frombuffer(b"".join(x.ljust(top_b, b"\1") for x in b), dtype=np.uint8).reshape(n, top_b).T
    kind = np.uint8 if top_a + top_b < 200 else np.uint16
    big = kind(250 if kind is np.uint8 else 10_000)
    w, v = 2 * band + 1, 2 * wide + 1
    offs = np.arange(-band, band + 1)[:, None]
    runs = [np.zeros((v, n), dtype=np.uint8)]
    dist = [np.where(offs >= 0, offs, big).astype(kind).repeat(n, axis=1)]
    least = [dist[0].min(axis=0)]
    result = np.full(n, 10_000, dtype=np.int64)
    rows = np.arange(n)
    for i in range(top_a + 1):
        if i > stretch and i % 4 == 0:
            # a later row comes from this one, or by a move from one of the rows before
            alive = (least[-1] <= limit) | (np.min(least[:-1], axis=0) < limit)
            if alive.sum() <= 0.8 * len(rows):
                if not alive.any():
                    break
                rows, la, lb, limit, xa, pad = rows[alive], la[alive], lb[alive], limit[alive], xa[:, alive], pad[:, alive]
                least = [x[alive] for x in least]
                dist, runs = [np.ascontiguousarray(x[:, alive]) for x in dist], [np.ascontiguousarray(x[:, alive]) for x in runs]
        if i:
            eq = xa[i - 1] == pad[i - 1 : i - 1 + v]  # b[j-1] for j = i + o, o from -wide
            run = (np.minimum(runs[-1], 250) + 1) * eq
            runs.append(run)
            before = dist[-1]
            cost = before + (~eq[stretch : stretch + w]).astype(kind)
            np.minimum(cost[:-1], before[1:] + 1, out=cost[:-1])
            # for each q, the cells of a from which a stretch before its last q letters can have come
            ends = [run >= q for q in range(stretch + 1)]
            flat = cost.ravel()  # a view
            for q in range(1, min(stretch, i - 1) + 1):
                moved = runs[-1 - q][stretch + q : stretch + q + w]
                for p in range(1, min(stretch, i - q) + 1):
                    hit = moved >= p
                    hit &= ends[q][stretch - p : stretch - p + w]
                    at = np.flatnonzero(hit)
                    if len(at):
                        flat[at] = np.minimum(flat[at], dist[-p - q].ravel()[at] + 1)
            cost[i + offs[:, 0] < 0] = big
            # a lost letter of a: the least of the cells before plus their distance
            low = cost[0]
            for o in range(1, w):
                low = np.minimum(low + 1, cost[o], out=cost[o])
            np.minimum(cost, big, out=cost)
            dist.append(cost)
            least.append(cost.min(axis=0))
            if len(dist) > 2 * stretch:
                dist.pop(0)
                runs.pop(0)
                least.pop(0)
        done = np.flatnonzero(la == i)
        if len(done):
            o = lb[done] - i + band
            ok = (o >= 0) & (o < w)
            result[rows[done[ok]]] = dist[-1][o[ok], done[ok]]
    return result


#: Intact grams of ``SHARED_GRAM`` letters that two texts within t edits have left after two moves.
SHARED_GRAM = 4


def may_mend(a: list[bytes], b: list[bytes], limit: np.ndarray, stretch: int = STRETCH, moves: int = MOVES) -> np.ndarray:
    """Whether the pairs share as many grams as pairs within ``limit`` edits, of which at most ``moves`` are moves, must.

    k edits and m moves cut a text into at most 1 + k + 3m intact pieces with all but
    k of its letters, so at least (length - k) - (gram - 1) * (pieces) grams stay,
    each within ``stretch`` * m + k places of its own.
    """
    n, q = len(a), SHARED_GRAM
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    top = int(max(la.max(), lb.max()))
    code = lambda xs, fill: np.ascontiguousarray(_grams(np.frombuffer(b"".join(x.ljust(top, fill) for x in xs), dtype=np.uint8).reshape(n, top), q).T)
    ga, gb = code(a, b"\0"), code(b, b"\1")
    reach = moves * stretch + int(limit.max())
    wide = np.zeros((ga.shape[0] + 2 * reach, n), dtype=np.uint32)
    wide[reach : reach + gb.shape[0]] = gb
    hit = np.zeros(ga.shape, dtype=bool)
    for o in range(2 * reach + 1):
        hit |= ga == wide[o : o + ga.shape[0]]
    hit &= np.arange(ga.shape[0])[:, None] <= la - q
    k = limit - moves
    least = np.maximum(la, lb) - limit - (q - 1) * (1 + k + 3 * moves)
    return hit.sum(axis=0) >= least


_CHECK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _judge(batches: Iterator[pa.RecordBatch], stretch: int, moves: int | None) -> Iterator[pa.RecordBatch]:
    """The linked pairs of (a, b, text_a, text_b, d): plain distance found, or within the allowed edits with moves."""
    for batch in batches:
        ids_a, ids_b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        plain = batch.column(4).to_numpy() >= 0
        good = [np.flatnonzero(plain)]
        rest = np.flatnonzero(~plain)
        if len(rest):
            ta, tb = ([t.encode("ascii", "replace") for t in batch.column(c).take(pa.array(rest)).to_pylist()] for c in (2, 3))
            size = np.array([max(len(x), len(y)) for x, y in zip(ta, tb)])
            enough = np.array([min(len(x), len(y)) for x, y in zip(ta, tb)]) >= np.ceil(size * (1 - EDITS) - 1e-9)
            order = np.argsort(size, kind="stable")
            order = order[enough[order]]
            lo = 0
            while lo < len(order):
                p = order[lo : lo + max(1, min(2000, 200_000 // int(size[order[lo]])))]
                lo += len(p)
                limit = np.array([allowed(s) for s in size[p]])
                if moves is not None and size[p[0]] >= 2 * SHARED_GRAM:
                    p = p[may_mend([ta[i] for i in p], [tb[i] for i in p], limit, stretch, moves)]
                    limit = np.array([allowed(s) for s in size[p]], dtype=np.int64)
                if len(p):
                    d = moves_distance([ta[i] for i in p], [tb[i] for i in p], limit, stretch)
                    good.append(rest[p[d <= limit]])
        g = np.concatenate(good)
        yield pa.RecordBatch.from_arrays([pa.array(ids_a[g]), pa.array(ids_b[g])], schema=_CHECK)


def _checked(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``a, b, text_a, text_b, d``: the plain distance where it is allowed, else -1."""
    a = reps.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    most = f"cast(floor(greatest(length(text_a), length(text_b)) * {EDITS} + 1e-9) as int)"
    # the exchange before the exact check has a fixed number of tasks: pairs are small, but their check is not
    n = shuffle_partitions(reps.sparkSession)
    return pairs.join(a, "a").repartition(n, "b").join(b.repartition(n, "b"), "b").select("a", "b", "text_a", "text_b", F.expr(f"levenshtein(text_a, text_b, {most})").alias("d"))


def near_groups(texts: DataFrame, trees: tuple[int, int] = TREES, first: tuple[int, int] = FIRST, leaf: int = LEAF, wide: int = WIDE, moves: int | None = MOVES) -> DataFrame:
    """``rep, grp``: the group of every distinct text; rows of ``texts``: rep, block, protein, open, text.

    ``rep`` is a unique long, ``block`` a long within which texts are compared,
    ``protein`` chooses the gram length, ``open`` marks texts of which at least one must
    take part in a link. Texts alone have ``grp = rep``.
    """
    letters, windows = trees
    reps = texts.withColumn("grp", F.col("rep"))
    few = tuple(range(min(first[0], letters))) + tuple(range(letters, letters + min(first[1], windows)))
    # protein texts are compared only where the first kind is missing: the second pass will do
    nearest = _checked(_candidates(reps.where(~F.col("protein")), few, functools.partial(_neighbours, reach=2), trees), reps).where("d >= 0")
    groups = table(components(nearest, "a", "b"), "groups1")
    grouped = table(texts.join(groups, F.col("rep") == F.col("node"), "left").select(*texts.columns, F.coalesce("component", "rep").alias("grp")), "reps1")
    pairs = _candidates(grouped, tuple(range(letters + windows)), functools.partial(_regions, leaf=leaf, wide=min(wide, WIDE)), trees)
    links = _checked(pairs, grouped).mapInArrow(functools.partial(_judge, stretch=STRETCH, moves=moves), "a long, b long")
    of = grouped.select("rep", "grp")
    ga, gb = of.select(F.col("rep").alias("a"), F.col("grp").alias("ga")), of.select(F.col("rep").alias("b"), F.col("grp").alias("gb"))
    final = components(links.join(ga, "a").join(gb, "b").select("ga", "gb"), "ga", "gb")
    out = table(of.join(final, F.col("grp") == F.col("node"), "left").select("rep", F.coalesce("component", "grp").alias("grp")), "near")
    discard(groups, grouped)
    return out


def near_duplicates(records: DataFrame, key: str, block: list[str], text: str, other: str | None = None, **forest) -> DataFrame:
    """``group_id, <key>``: records of groups of two or more, with the group's smallest key.

    Records of equal ``block`` columns are linked when their ``text`` (or, where
    either lacks it, their ``other``) agrees in at least 85 % of the longer one;
    groups are closed under links. Rows of one key that differ each take part and are
    one record. ``forest`` sets the parameters of :func:`near_groups`.
    """
    cols = [F.col(key).alias("k"), F.xxhash64(*block).alias("block"), F.col(text).alias("x"), (F.col(other) if other else F.lit(None).cast("string")).alias("y")]
    rec = records.where(" and ".join(f"`{c}` is not null" for c in [key, *block])).select(*cols).where("x is not null or y is not null")
    rec = table(rec.distinct(), "records")
    xs = rec.where("x is not null").select("block", F.lit(False).alias("protein"), F.col("x").alias("text"), F.lit(True).alias("open"))
    ys = rec.where("y is not null").select("block", F.lit(True).alias("protein"), F.col("y").alias("text"), F.col("x").isNull().alias("open"))
    texts = xs.unionByName(ys).groupBy("block", "protein", "text").agg(F.max("open").alias("open"))
    texts = table(texts.withColumn("rep", F.monotonically_increasing_id()), "texts")

    # a text of the second kind is a node only where a record without the first kind has it
    home = lambda c, kind: texts.where(F.col("protein") == kind).select(F.col("block").alias("bl"), F.col("text").alias("tx"), F.col("rep").alias(c), F.col("open").alias(f"{c}_open"))
    rec_x = rec.join(home("rx", False), (F.col("block") == F.col("bl")) & (F.col("x") == F.col("tx")), "left").drop("bl", "tx")
    rec_y = rec_x.join(home("ry", True), (F.col("block") == F.col("bl")) & (F.col("y") == F.col("tx")), "left")
    rec_y = table(rec_y.select("k", "rx", "ry", "ry_open"), "homes")
    discard(rec)
    near = near_groups(texts, **forest)
    # groups of second-kind texts with an open member: all their records are linked to it
    ny = near.select(F.col("rep").alias("ry"), F.col("grp").alias("gy"))
    nx = near.select(F.col("rep").alias("rx"), F.col("grp").alias("gx"))
    full = table(rec_y.join(nx, "rx", "left").join(ny, "ry", "left").select("k", "gx", "gy"), "full")
    out = table(_settle(full, texts, near, key), "groups")
    discard(rec_y, near, texts, full)
    return out


def _settle(full: DataFrame, texts: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """Joins the groups of both kinds of text and names each group by its smallest key."""
    # links of the second kind always have an open end, but chains through records that
    # have the first kind must pass an open text: near_groups only links via open texts
    linked = near.join(texts.where("protein").select("rep", "open"), "rep").groupBy("grp").agg(F.max("open").alias("live"))
    live = linked.where("live").select(F.col("grp").alias("gy"))
    y = full.where("gy is not null").join(live, "gy", "left_semi")
    bridge = y.where("gx is not null").select(F.col("gx").alias("a"), F.col("gy").alias("b")).distinct()
    grp = F.coalesce("gx", "gy")
    # rows of one key that differ are one record: its groups are one
    several = full.groupBy("k").agg(F.min(grp).alias("a"), F.max(grp).alias("high")).where("a <> high").select("k", "a")
    same = full.select("k", grp.alias("b")).join(several, "k").where("a <> b").select("a", "b")
    over = components(bridge.unionByName(same).distinct(), "a", "b")
    named = full.select("k", grp.alias("g")).join(over, F.col("g") == F.col("node"), "left").select("k", F.coalesce("component", "g").alias("g")).distinct()
    least = named.groupBy("g").agg(F.min("k").alias("group_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("g", "group_id")
    return named.join(least, "g").select("group_id", F.col("k").alias(key))
