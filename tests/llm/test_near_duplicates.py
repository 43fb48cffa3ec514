import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vdjlake.llm import near_duplicates as N


def brute_distance(a, b, stretch=9):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            v = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            for p in range(1, stretch + 1):
                for q in range(1, stretch + 1):
                    if p + q > i or p + q > j:
                        break
                    if a[i - p - q : i - q] == b[j - p : j] and a[i - q : i] == b[j - p - q : j - p]:
                        v = min(v, d[i - p - q][j - p - q] + 1)
            d[i][j] = v
    return d[-1][-1]


def edited(rng, text, edits, moves=0, letters="ACGT"):
    b = list(text)
    for _ in range(edits):
        k, r = rng.randrange(len(b)), rng.random()
        if r < 0.6:
            b[k] = rng.choice(letters)
        elif r < 0.8 and len(b) > 1:
            del b[k]
        else:
            b.insert(k, rng.choice(letters))
    for _ in range(moves):
        p, q = rng.randint(1, 9), rng.randint(1, 9)
        k = rng.randrange(max(1, len(b) - p - q))
        b[k : k + p + q] = b[k + p : k + p + q] + b[k : k + p]
    return "".join(b)


def test_distance_against_brute_force():
    rng = random.Random(4)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randint(10, 50)))
        pairs.append((a, edited(rng, a, rng.randint(0, 6), rng.randint(0, 2))))
    limit = np.array([N.allowed(max(len(a), len(b))) + 2 for a, b in pairs])
    got = N.moves_distance([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], limit)
    for (a, b), d, m in zip(pairs, got, limit):
        want = brute_distance(a, b)
        assert d == want if want <= m else d > m


def test_gram_filter_loses_nothing():
    rng = random.Random(6)
    a = ["".join(rng.choice("ACGT") for _ in range(rng.randint(40, 75))) for _ in range(600)]
    b = []
    for x in a:
        m = rng.randint(0, 2)
        b.append(edited(rng, x, rng.randint(0, N.allowed(len(x)) - m), m))
    a, b = [x.encode() for x in a], [x.encode() for x in b]
    limit = np.array([N.allowed(max(len(x), len(y))) for x, y in zip(a, b)])
    near = N.moves_distance(a, b, limit) <= limit
    assert near.sum() > 400 and N.may_mend(a, b, limit)[near].all()


SCHEMA = "k string, c string, v string, nt string, aa string, rep long, text string"


def groups(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    out = {}
    for r in N.near_duplicates(df, "k", ["c", "v"], "nt", "aa").collect():
        out.setdefault(r["group_id"], set()).add(r["k"])
    return {frozenset(x) for x in out.values()}


def brute_groups(rows):
    up = {r[0]: r[0] for r in rows if r[1] and r[2] and (r[3] or r[4])}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    live = [r for r in rows if r[0] in up]
    for i, r in enumerate(live):
        for s in live[:i]:
            if r[1:3] != s[1:3]:
                continue
            a, b = (r[3], s[3]) if r[3] and s[3] else (r[4], s[4])
            if a and b and brute_distance(a, b) <= N.allowed(max(len(a), len(b))):
                x, y = find(r[0]), find(s[0])
                up[max(x, y)] = min(x, y)
    out = {}
    for k in up:
        out.setdefault(find(k), set()).add(k)
    return {frozenset(x) for x in out.values() if len(x) > 1}


def test_groups_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for f in range(9):
        nt = "".join(rng.choice("ACGT") for _ in range(rng.randint(48, 66)))
        aa = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(len(nt) // 3))
        for m in range(4):
            x = edited(rng, nt, rng.randint(0, 4), rng.randint(0, 1))
            y = edited(rng, aa, rng.randint(0, 1), letters="ACDEFGHIKLMNPQRSTVWY")
            rows.append((f"s{f}{m}", "c1" if f < 7 else "c2", "V1", None if m == 3 else x, None if m == 2 and f % 2 else y))
    rows += [("n1", None, "V1", "ACGT" * 10, None), ("n2", "c1", None, "ACGT" * 10, None), ("n3", "c1", "V1", None, None), ("t1", "c1", "V1", "ACG", None), ("t2", "c1", "V1", "ACG", None), ("t3", "c1", "V1", "ACC", None)]
    rows += [rows[0], rows[5]]
    assert groups(spark, rows) == brute_groups(rows[:-2])


def test_hot_family_and_long_texts(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    rows = [(f"h{i:03d}", "c", "V", edited(rng, base, 3), None) for i in range(120)]
    long = "".join(rng.choice("ACGT") for _ in range(3000))
    rows += [("l1", "c", "V", long, None), ("l2", "c", "V", edited(rng, long, 200), None), ("l3", "c", "V", "".join(rng.choice("ACGT") for _ in range(3000)), None)]
    got = groups(spark, rows)
    assert frozenset({"l1", "l2"}) in got and max(map(len, got)) == 120


def _rows(keys, hi=None, block=None):
    """Sorted rows as the walk gets them: every text a group of its own."""
    n = len(keys)
    key, hi = np.array(keys, dtype=np.uint64), np.array(hi if hi is not None else [0] * n, dtype=np.uint64)
    zero = np.zeros(n, dtype=np.int64)
    return [zero, np.array(block) if block is not None else zero, zero, key, hi, np.zeros(n, dtype=np.uint64), np.arange(n), np.arange(n), np.ones(n, dtype=bool)]


def _found(parts):
    return {tuple(p) for x in parts for p in x.tolist()}


def test_regions_are_compared_whole_and_cost_no_square():
    """A region has all its pairs; what shares everything costs its size times a constant, and stays connected."""
    cols = _rows(sorted([1] * 5 + [2 << 40] * 30 + [3 << 40] * 60))
    assert _found(N._regions(cols, 24, 128)) >= {(i, j) for lo, hi in ((0, 5), (5, 35), (35, 95)) for i in range(lo, hi) for j in range(i + 1, hi)}
    n = 20_000
    pairs = _found(N._regions(_rows([7] * n), 24, 128))
    assert len(pairs) < 26 * n and {(0, i) for i in range(1, n)} <= pairs
    split = _found(N._regions(_rows([7] * 300, hi=[i // 100 << 48 for i in range(300)]), 24, 128))
    assert {(i, j) for g in range(3) for i in range(100 * g, 100 * g + 100) for j in range(i + 1, 100 * g + 100)} <= split


def test_walk_in_chunks_finds_what_one_chunk_finds():
    """The walk holds one chunk and its overlap, and loses no pair at the borders."""
    import functools

    import pyarrow as pa

    rng = np.random.default_rng(3)
    key = np.sort((rng.integers(0, 40, 5000).astype(np.uint64) << np.uint64(40)) | (rng.integers(0, 9, 5000).astype(np.uint64) << np.uint64(16)))
    cols = _rows(key)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 500].view(np.int64) if c.dtype == np.uint64 else c[i : i + 500]) for c in cols], names=[f"c{k}" for k in range(9)]) for i in range(0, 5000, 500)]
    find = functools.partial(N._regions, leaf=24, wide=128)
    walk = lambda chunk: {(a, b) for r in N._harvest(iter(batches), find, 128, chunk) for a, b in zip(*(c.to_pylist() for c in r.columns))}
    assert walk(700) >= walk(10**9)


def test_hot_prefixes_are_spread_without_loss(spark):
    """With a tiny bound the exchange key gets deeper; regions stay whole."""
    rng = random.Random(19)
    base = "".join(rng.choice("ACGT") for _ in range(60))
    texts = sorted({base[:40] + edited(rng, base[40:], 2) for _ in range(300)})
    df = spark.createDataFrame([(i, 5, False, True, t) for i, t in enumerate(texts)], "rep long, block long, protein boolean, open boolean, text string").withColumn("grp", F.col("rep"))
    import functools

    trees = tuple(range(20))
    find = functools.partial(N._regions, leaf=24, wide=128)
    hot = N._hot(df, trees, N.TREES, 40, 1)
    assert hot and all(d < N.DEPTH for _, _, d, _ in hot)
    a = {tuple(r) for r in N._candidates(df, trees, find, hot=40, sample=1).collect()}
    b = {tuple(r) for r in N._candidates(df, trees, find).collect()}
    assert len(a & b) >= 0.97 * len(b)  # all but neighbours that share no region, at the borders
    assert len(b) > 300


def test_rows_of_a_key_that_differ_are_one_record(spark):
    rng = random.Random(21)
    x, y = ("".join(rng.choice("ACGT") for _ in range(60)) for _ in range(2))
    rows = [("a", "c", "V", x, None), ("b", "c", "V", edited(rng, x, 2), None), ("b", "c", "V", edited(rng, y, 2), None), ("d", "c", "V", y, None), ("e", "c", "W", y, None)]
    assert groups(spark, rows) == {frozenset("abd")}


def test_filters_lose_few_linked_pairs():
    """The sketch lets linked pairs through whatever the kind of their edits."""
    rng = random.Random(23)
    for letters, protein, n in (("ACGT", False, (45, 75)), ("ACDEFGHIKLMNPQRSTVWY", True, (14, 24))):
        for edits in (1.0, 0.6):
            a = ["".join(rng.choice(letters) for _ in range(rng.randint(*n))) for _ in range(500)]
            b = [edited(rng, x, int(edits * N.allowed(len(x))), letters=letters) for x in a]
            _, sa = N.signatures(a, protein, 0)
            _, sb = N.signatures(b, protein, 0)
            kept = N._similar(sa[:, 0], sa[:, 1], sb[:, 0], sb[:, 1], np.zeros(500, dtype=bool))
            assert kept.mean() > 0.9, (protein, edits, kept.mean())


def test_empty(spark):
    assert groups(spark, []) == set()


@pytest.mark.parametrize("a, b, d", [("", "", 0), ("ABCDEF", "DEFABC", 1), ("AB", "BA", 1)])
def test_distance_by_hand(a, b, d):
    assert brute_distance(a, b) == d
    if a:
        assert N.moves_distance([a.encode()], [b.encode()], np.array([3]))[0] == d
