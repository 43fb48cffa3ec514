"""Core operators on small tables with nulls, ties, repeats, empty inputs and clashing names."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from vdjlake.operators import components, dynamics, heavy_keys, lineages, matching, orphans, sharing, similarity, stats, trees
from vdjlake.operators import diversity as D
from vdjlake.operators import rows as R
from vdjlake.operators import usage as U


# ---- heavy keys


def clone_rows():
    hot = [("c", 1, f"h{i % 300}") for i in range(900)]
    return hot + [("c", 2, "a"), ("c", 2, "a"), ("c", 2, "b"), ("d", 1, "a"), (None, 1, "x"), ("c", None, "y"), ("c", 3, None)]


def test_salted_counts(spark, rows):
    df = spark.createDataFrame(clone_rows(), "k string, c long, i string").withColumn("__salt", F.lit(7)).withColumn("items", F.lit("x")).withColumn("k_h", F.lit(1))
    got = rows(heavy_keys.salted_distinct(df, ["k", "c"], "i"), "k", "c")
    assert got == [("c", 1, 300), ("c", 2, 2), ("d", 1, 1)]
    assert rows(heavy_keys.salted_distinct(df, ["k", "c"], "i", tasks=1), "k", "c") == got
    assert rows(heavy_keys.salted_distinct(df.limit(0), ["k", "c"], "i")) == []
    assert rows(heavy_keys.dominant_keys(df, ["k", "c"], "i", 0.5)) == [("c", 1, 300, 300 / 303)]


def test_salted_profile(spark, rows):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 1.0), ("a", "y", None), ("b", "z", 3.0)], "k string, i string, m double")
    assert rows(heavy_keys.salted_profile(df, ["k"], "i", "m"), "k") == [("a", 2, 1.0, 1.0, 1.0), ("b", 1, 3.0, 3.0, 3.0)]


# ---- orphans


def test_bitmap():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 5000, n)) for n in (700, 900))
    x, y = orphans.Bitmap.of(a), orphans.Bitmap.of(b)
    assert list(x.and_not(y).positions()) == sorted(set(a) - set(b))
    assert list(x.and_(y).positions()) == sorted(set(a) & set(b)) and len(x) == len(a)
    assert not len(orphans.Bitmap.of(np.array([])).and_not(x)) and list(x.and_not(orphans.Bitmap.of(np.array([]))).positions()) == list(a)


T = lambda *a: dt.datetime(2025, *a)


def test_orphans(spark):
    refs = [(k, t, "x", "y", 1) for k, t in [("a", T(1, 5)), ("a", T(1, 5)), ("b", T(1, 5)), ("c", T(1, 5)), ("d", T(1, 5)), ("d", T(2, 5)), ("e", T(1, 5)), ("e", T(1, 20)), (None, T(1, 5)), ("", T(1, 5)), ("f", None)]]
    parents = [("b", T(1, 1), None, 1), ("c", T(1, 1), T(1, 2), 1), ("d", T(1, 9), None, 1), ("d", T(1, 8), T(1, 9), 1), ("e", T(1, 10), None, 1), (None, T(1, 1), None, 1)]
    got = set(_orphans(spark, refs, parents))
    assert got == {("t", None, "f", "missing"), ("t", "2025-01", "a", "missing"), ("t", "2025-01", "c", "deleted"), ("t", "2025-01", "d", "late"), ("t", "2025-01", "e", "late")}
    assert _orphans(spark, [], parents) == []
    assert {r[3] for r in _orphans(spark, refs, [])} == {"missing"}


def _orphans(spark, refs, parents):
    r = spark.createDataFrame(refs, "rid string, at timestamp, kind string, period string, key int")
    p = spark.createDataFrame(parents, "id string, loaded timestamp, gone timestamp, src int")
    return [tuple(x) for x in orphans.orphans({"t": (r, "rid", "at")}, p, "id", "loaded", "gone").collect()]


def test_orphans_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(orphans, "RANGE_BITS", 64)
    n = 1000
    keys = np.array([f"k{i:05d}" for i in range(n) for _ in range(2)], dtype=object)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([-1, 0] * n, pa.int32()), pa.array([None, "2025-01"] * n, pa.string()), pa.array([5 if i % 3 else None if j == 0 else 1 for i in range(n) for j in range(2)], pa.int64())], names=["key", "src", "period", "time"])
    out = [b.to_pylist() for b in orphans._encode(iter([batch.slice(0, 700), batch.slice(700)]))]
    found = {r["key"] for b in out for r in b}
    assert found == {f"k{i:05d}" for i in range(n) if i % 3 == 0}


# ---- diversity


def test_goldens(spark):
    sizes = {"a": [2, 1, 1], "b": [5, 3, 1, 1], "c": [3, 1, 1], "d": [1, 1, 2], "e": [4]}
    data = [(g, i) for g, ss in sizes.items() for i, n in enumerate(ss) for _ in range(n)]
    m = {r["g"]: r for r in D.diversity(spark.createDataFrame(data, "g string, clone_id long"), ["g"]).collect()}
    assert round(m["a"]["shannon"], 6) == 1.039721 and m["a"]["simpson"] == 0.625 and m["a"]["chao1"] == 5.0
    assert m["b"]["d50"] == 1 and m["c"]["chao1"] == 4.0
    assert round(m["d"]["gini"], 6) == 0.166667 and m["e"]["gini"] == 0.0 and m["e"]["shannon"] == 0.0
    assert m["b"]["top1"] == 0.5 and m["b"]["expanded"] == 0.8 and m["b"]["top10"] == 1.0


def test_null_clone(spark, rows):
    df = spark.createDataFrame([("g", None), ("g", None), ("g", 1)], "g string, clone_id long")
    assert rows(D.clone_sizes(df, ["g"]), "clone") == [("g", -1, 2), ("g", 1, 1)]
    assert rows(D.clone_sizes(df, ["g"], null_clone="drop")) == [("g", 1, 1)]
    assert rows(D.with_clone_size(df), "clone_size") and sorted(r["clone_size"] for r in D.with_clone_size(df).collect()) == [0, 0, 1]
    with pytest.raises(ValueError):
        D.clone_sizes(df, ["g"], null_clone="?")
    assert rows(D.diversity(df.limit(0), ["g"])) == []


def test_usage(spark, rows):
    df = spark.createDataFrame([("g", "IGHV1-2", "IGHM"), ("g", "ighv1-3", "IGHG1"), ("g", "IGHV2-1", None), ("g", None, "IGHM"), ("g", "IGKV1", "IGHM")], "g string, v string, c_call string")
    assert rows(U.family_usage(df, ["g"]), "family") == [("g", "IGHV1", 2, 0.5), ("g", "IGHV2", 1, 0.25), ("g", "IGKV1", 1, 0.25)]
    iso = {r["class"]: r["n"] for r in U.isotype_usage(df, ["g"]).collect()}
    assert iso == {"IgM": 2, "IgD": 0, "IgG": 1, "IgA": 0, "IgE": 0}


# ---- sharing and graphs


def test_public(spark, rows):
    df = spark.createDataFrame([("k", "p1", "AA", "s2"), ("k", "p2", "AA", "s1"), ("k", "p2", "AB", "s3"), ("l", "p1", "AC", "s4"), (None, "p1", "AD", "s5"), ("m", None, "AD", "s6")], "c string, patient string, cdr3 string, sequence_id string")
    r = sharing.public_clones(df, ["c"]).collect()
    assert len(r) == 1 and (r[0]["patients"], r[0]["rows"], r[0]["cdr3s"], r[0]["representative"], r[0]["by_patient"]) == (2, 3, 2, "s1", {"p1": 1, "p2": 2})
    assert rows(sharing.shared_pairs(df, ["c"])) == [("p1", "p2", 1)]
    assert rows(sharing.set_intersections(df, ["c"]), "patients") == [("p1", 1), ("p1|p2", 1)]
    assert len(rows(sharing.heatmap(df, ["c"]))) == 4


def brute_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in up)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(5, 3), (3, 5), (9, 8), (8, 1), (1, 9), (20, 20)], [(0, i) for i in range(1, 80)]])
def test_connected(spark, edges):
    df = spark.createDataFrame(edges + [(None, 3), (4, None)], "a long, b long")
    assert sorted(tuple(r) for r in components.connected(df).collect()) == brute_components(edges)
    assert sorted(tuple(r) for r in components.connected(df.repartition(7)).collect()) == brute_components(edges)
    texts = df.select(F.concat(F.lit("n"), "a").alias("a"), F.concat(F.lit("n"), "b").alias("b"))
    assert sorted(map(tuple, components.connected(texts).collect())) == sorted(map(tuple, components.connected(texts.repartition(5)).collect()))


def test_hamming_pairs(spark):
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("AB"), 9)) for _ in range(60)] + ["AAAA", "AAAB"]
    df = spark.createDataFrame([("x", i, t, "z") for i, t in enumerate(texts)] + [("x", 99, None, "z"), (None, 98, "AAAA", "z")], "block string, id long, t string, k string")
    got = {(r["a"], r["b"]) for r in similarity.hamming_pairs(df, ["block"], "t", "id", F.lit(2)).collect()}
    assert sorted(map(tuple, similarity.hamming_pairs(df, ["block"], "t", "id", F.lit(2), together=2).select("a", "b").collect())) == sorted(got)
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(texts[i]) == len(texts[j]) and sum(a != b for a, b in zip(texts[i], texts[j])) <= 2}
    assert got == want
    assert similarity.hamming_pairs(df, ["block"], "t", "id", F.lit(2)).count() == len(want)


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(e[-1] + 1, d[j] + 1, d[j - 1] + (x != y)))
        d = e
    return d[-1]


def test_edit_pairs_and_leaders(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ACD"), rng.integers(3, 8))) for _ in range(50)]
    df = spark.createDataFrame([("v", f"s{i:02d}", t) for i, t in enumerate(texts)], "v string, sequence_id string, cdr3 string")
    got = {(r["a"], r["b"]): r["distance"] for r in similarity.edit_pairs(df, ["v"], "cdr3", "sequence_id", 2).collect()}
    want = {(f"s{i:02d}", f"s{j:02d}"): lev(texts[i], texts[j]) for i in range(50) for j in range(i + 1, 50) if lev(texts[i], texts[j]) <= 2}
    assert got == want
    taken: dict = {}
    for i in range(50):
        if i not in taken:
            for j in range(i, 50):
                if j not in taken and lev(texts[i], texts[j]) <= 2:
                    taken[j] = f"s{i:02d}"
    led = {r["sequence_id"]: r["leader"] for r in sharing.leader_clusters(df, ["v"]).collect()}
    assert led == {f"s{i:02d}": taken[i] for i in range(50)}


def test_leaders_of_a_long_chain(spark):
    """A chain in which every row waits for the one before it is settled however long it is, in every block."""
    texts = ["K" * (3 * i) for i in range(1, 402)]  # neighbours are three edits apart
    texts = [t + "KK"[: i % 2] for i, t in enumerate(texts)]
    data = [(v, t, f"s{i:03d}{v}") for v in ("V1", "V2") for i, t in enumerate(sorted(texts, key=len))]
    df = spark.createDataFrame(data, "v string, cdr3 string, sequence_id string")
    want: dict = {}
    for v, t, k in data:
        for w, u, m in data:
            if w == v and m >= k and m not in want and want.get(k, k) == k and abs(len(t) - len(u)) <= 3:
                want[m] = k
    got = {r["sequence_id"]: r["leader"] for r in sharing.leader_clusters(df, ["v"], edits=3).collect()}
    assert got == want


# ---- clones


def test_clone_calling(spark, rows):
    df = spark.createDataFrame([("v", "AAAAAAAAAA", "a"), ("v", "AAAAAAAAAB", "b"), ("v", "AAAAAAAABB", "c"), ("v", "BBBBBBBBBB", "d"), ("v", "AAAAAAAAAA", "e"), ("v", None, "f")], "v string, j string, k string")
    assert rows(lineages.single_link_clones(df, ["v"], "j", "k", 0.1), "k") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "a")]
    complete = dict(rows(lineages.linkage_clones(df, ["v"], "j", "k", 0.1, "complete"), "k"))
    assert complete["a"] == complete["b"] == complete["e"] and complete["c"] != complete["a"]
    near = dict(rows(lineages.nearest_distance(df, ["v"], "j", "k"), "k"))
    assert near == {"a": 0.1, "b": 0.1, "c": 0.1, "d": 0.8, "e": 0.1}
    with pytest.raises(ValueError):
        lineages.linkage_clones(df, ["v"], "j", "k", 0.1, "?")


def test_nearest_distance_has_no_cut(spark, rows, monkeypatch):
    """The registered query gives every row its nearest distance unless it is alone, however far; in tiles too."""
    from vdjlake.plans import clones

    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("ACGT"), n)) for n in [20] * 40 + [21] * 25 + [30]]
    texts += [texts[0][:-1] + ("A" if texts[0][-1] != "A" else "C"), texts[1], "ACGT" * 5]
    data = [("x" if i % 3 else "y", "V1", t, f"s{i:03}") for i, t in enumerate(texts)]
    data += [("x", "V2", "ACGTACGTAC", "far1"), ("x", "V2", "TGCATGCATG", "far2"), ("x", None, "ACGTACGTAC", "none")]
    df = spark.createDataFrame(data, "cohort string, v string, junction string, sequence_id string")
    want = {}
    for c, v, t, k in data:
        if v:
            d = [sum(x != y for x, y in zip(t, u)) for c2, v2, u, _ in data if (c2, v2, len(u)) == (c, v, len(t)) and u != t]
            want[k] = min(d) / len(t) if d else None
    assert want["far1"] == 1.0 and None in want.values()
    monkeypatch.setattr(clones, "_called", lambda spark, d: df.withColumn("j", F.lit("J1")))
    for tile in (4096, 7):
        monkeypatch.setattr(lineages, "TILE", tile)
        got = dict(rows(clones.nearest_distance(spark, "")))
        assert got == want


def test_cluster_sharing_means_all_pairs(spark, monkeypatch):
    """Members four edits apart count as such; with parts of one or two texts too."""
    data = [("a", "a", "f1", "CAAAAAAAAF"), ("b", "a", "f2", "CDDAAAAAAF"), ("c", "a", "f2", "CAAAAAEEAF"), ("d", "a", "f1", "CDDAAAAAAF"), ("e", "e", "f1", "CKKF"), ("g", "e", "f2", "CKKF"), ("h", "h", "f1", "CRRF")]
    df = spark.createDataFrame(data, "sequence_id string, leader string, file string, cdr3 string")
    for part in (1024, 2, 1):
        monkeypatch.setattr(sharing, "PART", part)
        got = {r["leader"]: (r["files"], r["rows"], r["similarity"]) for r in sharing.cluster_sharing(df, "leader", "file", "cdr3").collect()}
        assert got == {"a": (2, 4, 0.733), "e": (2, 2, 1.0)}  # (0.8 + 0.8 + 0.6) / 3


def test_clone_trees_query_has_no_size_cut(spark, monkeypatch):
    """The registered query leaves no clone without a tree for its size."""
    from vdjlake.plans import clones

    df = spark.createDataFrame([("x", 1, "V1", t, f"s{i}") for i, t in enumerate(["ACGT", "ACGA", "ACCA", "TCGT"])], "cohort string, clone_id long, v string, junction string, sequence_id string")
    bounds, whole = [], trees.clone_trees
    monkeypatch.setattr(clones, "_junctions", lambda spark, d: df)
    monkeypatch.setattr(trees, "clone_trees", lambda *a, **k: bounds.append(k.get("max_tips")) or whole(*a, **k))
    r = clones.clone_trees(spark, "").collect()
    assert bounds == [None] and r[0]["tips"] == 4 and r[0]["newick"].endswith(";")


def test_threshold():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0.05, 0.01, 300), rng.normal(0.3, 0.05, 300)])
    assert 0.08 < lineages.density_threshold(x) < 0.2
    assert lineages.density_threshold(np.array([])) == 0.1 and lineages.density_threshold(np.array([0.2] * 30)) == 0.2


def test_lineages(spark, rows):
    p = spark.createDataFrame([("c", "t1", "V", "J", "CARDYWAAAA", "p1"), ("c", "t2", "V", "J", "CARDYWAAAB", "p2"), ("c", "t1", "V", "J", "CARDYWAAAC", "p3"), ("c", "t2", "W", "J", "CARDYWAAAA", "p4"), ("c", "t2", "V", "J", None, "p5")], "cohort string, timepoint string, v string, j string, cdr3 string, profile string")
    lin = dict(rows(lineages.lineages(p, ["cohort"]).select("profile", "lineage"), "profile"))
    assert lin == {"p1": "p1", "p2": "p1", "p3": "p1", "p4": "p4", "p5": "p5"}
    assert rows(lineages.lineage_summary(lineages.lineages(p, ["cohort"]), ["cohort"])) == [("c", 3, 1)]
    e = spark.createDataFrame([(1, "IGHV1-1", "IGHJ4", "ABCDEFGHIJK", "a"), (2, "IGHV1-2", "IGHJ4", "ABCDEFGHIXX", "b"), (3, "IGHV1-2", "IGKJ1", "ABCDEFGHIXX", "b")], "key long, v string, j string, cdr3 string, cohort string")
    assert rows(lineages.cohort_edges(e)) == [(1, 2, 2)]  # 11 letters: two differences


# ---- dynamics


def test_status(spark, rows):
    df = spark.createDataFrame([("c", t, o, 1.0) for t, os in {"all": [0, 1, 2], "late": [1], "gone": [0, 1], "gap": [0, 2]}.items() for o in os], "cohort string, track string, ord int, shm double")
    st = {r["track"]: r["status"] for r in dynamics.status(dynamics.frequencies(df, ["cohort"]), ["cohort"], 3).collect()}
    assert st == {"all": "expanding" if (1 / 2) > 1.5 * (1 / 3) else "persistent", "late": "late_emerging", "gone": "disappeared", "gap": "transient"}
    assert dynamics.dense_sizes(df, ["cohort"], [0, 1, 2]).count() == 12
    t = {r["track"]: r for r in dynamics.size_trends(dynamics.tracked(df, ["cohort"]), ["cohort"], 3).collect()}
    assert t["all"]["persistent"] and not t["gap"]["persistent"] and t["gap"]["fold_change"] == 1.0


# ---- statistics


def test_exact_p():
    assert round(stats.exact_p(0, 3, 3), 10) == 0.1
    assert round(stats.exact_p(20, 10, 10), 3) == 0.023
    assert sum(stats.u_counts(4, 5)) == 126


def test_rank_sum(spark):
    df = spark.createDataFrame([("t", 1, float(x)) for x in (1, 2, 3)] + [("t", 2, float(x)) for x in (4, 5, 6)] + [("u", 1, 1.0), ("u", 2, 2.0), ("t", 1, None)], "test string, side int, value double")
    r = {x["test"]: x for x in stats.rank_sum(df, ["test"], "side", "value").collect()}
    assert r["t"]["u"] == 0 and round(r["t"]["p"], 10) == 0.1 and r["t"]["r_abs"] == 1.0 and r["t"]["r"] == -1.0
    assert not r["u"]["valid"] and r["u"]["p"] is None


def test_fdr_and_midranks(spark):
    t = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    assert {r["i"]: None if r["q"] is None else round(r["q"], 10) for r in stats.fdr(t).collect()} == {1: 0.03, 2: 0.04, 3: 0.04, 4: None}
    m = spark.createDataFrame([("g", float(x)) for x in (1, 2, 2, 3)], "g string, x double")
    assert sorted(r["rank"] for r in stats.midranks(m, ["g"], "x").collect()) == [1.0, 2.5, 2.5, 4.0]
    b = stats.box(spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4, 100)], "g string, x double"), ["g"], "x").first()
    assert (b["q1"], b["median"], b["q3"], b["high_whisker"]) == (2.0, 3.0, 4.0, 7.0)
    s = stats.mean_sem(spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 2.0), ("h", None)], "g string, x double"), ["g"], "x").orderBy("g").collect()
    assert [tuple(r) for r in s] == [("g", 2, 2.0, 1.0), ("h", 1, 2.0, 0.0)]


# ---- records


def test_rows(spark, rows):
    c = spark.createDataFrame([("b", "IGH", "k2", "3"), ("b", "IGH", "k1", "3"), ("b", "IGK", "k3", "x"), ("b", "IGK", "k4", "1")], "barcode string, chain string, contig_id string, umis string")
    assert rows(R.best_contig(c).select("chain", "contig_id"), "chain") == [("IGH", "k1"), ("IGK", "k4")]
    q = spark.createDataFrame([("True", "TRUE", "true"), ("false", "TRUE", "true")], "is_cell string, high_confidence string, productive string")
    assert R.quality_10x(q).count() == 1
    g = spark.createDataFrame([("a", "x"), ("a", None), ("b", "x"), ("b", "y")], "k string, g string")
    assert rows(R.consistent_germline(g, ["k"], "g")) == [("a", 2)]
    assert R.check_threshold(0) == 0.0
    with pytest.raises(ValueError):
        R.check_threshold(1.5)
    contigs = spark.createDataFrame([("1", "s1"), ("2", "s2"), ("3", "s3")], "cell_id string, sequence_id string")
    tags = spark.createDataFrame([("1", "T1", 0), ("1", "T2", 1), ("2", "Multiplet", 2), ("3", "T9", 3)], "Cell_Index string, Sample_Tag string, pos long")
    assign = spark.createDataFrame([("T2", " G ", "", " ")], "sampleTag string, group string, mouseLabel string, timepoint string")
    d = R.demultiplex(contigs, tags, assign)
    assert rows(d.select("cell_id", "group", "mouse", "timepoint")) == [("1", "G", "Mouse1", "endpoint")]
    assert rows(R.staging_summary(contigs, tags, d)) == [(3, 1, 1, 1)]
    files = spark.createDataFrame([(1001, "f.fasta")], "file_id long, filename string")
    ids = spark.createDataFrame([("a_contig_2_1001",), ("b_1002",), ("1001|||x",)], "sequence_id string")
    assert [r["sample_file"] for r in R.attach_file(ids, files).orderBy("sequence_id").collect()] == ["f.fasta", "f.fasta", "unknown.fasta"]
    m = spark.createDataFrame([("x.fasta", "t0")], "filename string, timepoint string")
    f = spark.createDataFrame([("x_clean.fasta",), ("y.fasta",)], "sample_file string")
    assert rows(R.attach_timepoint(f, m), "sample_file") == [("x_clean.fasta", "t0"), ("y.fasta", None)]


def test_rescue_and_assembly(spark):
    cp = spark.createDataFrame([("a", "AC", "AC", "V", 1), ("b", "AC", "A", "V", 1), ("c", "AC", "AG", "W", 2)], "sequence_id string, sequence_alignment string, germline_alignment string, v_call string, clone_id long")
    gp = cp.where("sequence_id = 'a'").withColumn("germline_alignment_d_mask", F.lit("NN"))
    out = {r["sequence_id"]: r for r in R.rescue(cp, gp).collect()}
    assert set(out) == {"a", "c"} and out["c"]["germline_rescued"] and out["c"]["germline_v_call"] == "W" and not out["a"]["germline_rescued"]
    hits = spark.createDataFrame([("a", "V", "V1", 1), ("a", "V", "V2", 0), ("a", "J", "J1", 2)], "query_id string, chain_type string, subject_id string, pos int")
    ids = spark.createDataFrame([("a",), ("z",)], "sequence_id string")
    r = {x["sequence_id"]: x for x in R.assemble(ids, hits, gp, cp, spark.createDataFrame([("reversed|z",)], "sequence_id string")).collect()}
    assert r["a"]["v_gene"] == "V2" and r["a"]["productive"] and r["a"]["clone_id"] == 1 and not r["z"]["productive"] and r["z"]["clone_id"] is None
    best = R.best_tree(spark.createDataFrame([(1, "t1"), (2, "t1")], "clone_id long, timepoint string"), spark.createDataFrame([(1, "t1", "p", 3), (1, "t2", "q", 9), (2, "t2", "r", 1)], "clone_id long, timepoint string, path string, clone_size int"), ["clone_id"])
    assert {x["clone_id"]: x["path"] for x in best.collect()} == {1: "p", 2: "r"}


def test_matching(spark, rows):
    q = spark.createDataFrame([("a", "ABCDE"), ("b", "AB"), ("c", None)], "k string, t string")
    r = spark.createDataFrame([("x", "ABCDF"), ("y", "ABCDE"), ("z", "AAAAA"), ("w", "ABCDEF")], "n string, s string")
    assert rows(matching.length_matches(q, r, "k", "t", "n", "s", 3, top=2), "rank") == [("a", "y", 100.0, 1), ("a", "x", 80.0, 2)]


def test_trees(spark):
    d = np.array([[0, 5, 9, 9, 8], [5, 0, 10, 10, 9], [9, 10, 0, 8, 7], [9, 10, 8, 0, 3], [8, 9, 7, 3, 0]], float)
    edges = trees.neighbour_joining(d)
    w = {frozenset(e[:2]): e[2] for e in edges}
    tip = {i: next(v for k, v in w.items() if i in k) for i in range(5)}
    assert [tip[i] for i in range(5)] == [2, 3, 4, 2, 1]
    df = spark.createDataFrame([(1, "ACGT", "a"), (1, "ACGA", "b"), (1, "AC-GT", "c"), (1, "TTTT", "d"), (2, "A", "e")], "clone long, seq string, id string")
    r = trees.clone_trees(df, ["clone"], "seq", "id").collect()
    assert len(r) == 1 and r[0]["tips"] == 3 and "a(x2)" in r[0]["newick"] and r[0]["newick"].endswith(";")
    assert trees.clone_trees(df, ["clone"], "seq", "id", max_tips=2).first()["newick"] is None


def test_trees_of_many_tips_without_their_matrix(spark, monkeypatch):
    """Joining by features gives the tree of the distance matrix, gaps and N included, and large clones never make a matrix."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ACGT"), rng.choice([997, 1000]))) for _ in range(25)]
    texts = [t[:k] + ("N" if k % 5 == 0 else "-") * 7 + t[k + 7 :] if k % 3 == 0 else t for k, t in enumerate(texts)]

    def splits(edges):
        near: dict = {}
        for a, b, _ in edges:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        out = {}
        for a, b, w in edges:
            seen, todo = {a, b}, [b]
            while todo:
                new = near[todo.pop()] - seen
                seen |= new
                todo += new
            side = frozenset(k for k in seen - {a} if k < len(texts))
            out[side if 0 not in side else frozenset(range(len(texts))) - side] = w
        return out

    d = trees.p_distances(texts)
    x, z = trees._features(texts)
    off = ~np.eye(len(texts), dtype=bool)
    assert np.allclose(-(x @ z.T)[off], d[off])
    want, got = splits(trees.neighbour_joining(d)), splits(trees.profile_joining(x, z))
    assert want.keys() == got.keys() and all(abs(want[k] - got[k]) < 1e-9 for k in want)
    many = sorted({"".join(rng.choice(list("ACGT"), 20)) for _ in range(400)})
    monkeypatch.setattr(trees, "p_distances", lambda texts: 1 / 0)
    assert len(trees.joined(many)) == 2 * len(many) - 3


def test_embedding_clusters(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    vec = [base[i % 6] + rng.normal(scale=0.002, size=8) for i in range(24)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vec)] + [(99, None)], "id long, e array<double>")
    got = {r["id"]: r["cluster"] for r in lineages.embedding_clusters(df, "id", "e", 0.001).collect()}
    assert got == {i: i % 6 for i in range(24)}


def test_density_curve(spark):
    rng = np.random.default_rng(6)
    x = [float(v) for v in np.clip(rng.normal(0.3, 0.05, 400), 0.01, 1)] + [0.0, 2.0]
    df = spark.createDataFrame([("t", v) for v in x] + [("t", None), ("u", 0.5)], "label string, d double")
    c = lineages.density_curve(df, "d", "label").toPandas()
    t = c[c["label"] == "t"]
    assert len(t) == 512 and abs(t["density"].sum() / 511 - 1) < 0.02 and abs(t.loc[t["density"].idxmax(), "x"] - 0.3) < 0.05
    assert {r["label"]: r["threshold"] for r in lineages.thresholds(df, "d", "label", fixed={"u": 0.2}).collect()}["u"] == 0.2
    with pytest.raises(ValueError):
        lineages.thresholds(df, "d", "label", fixed={"u": 2})


def test_connected_across_tasks(spark):
    """Edges of long chains in many tasks: the contraction of a task leaves rounds to do."""
    import random

    from vdjlake.operators import components

    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(400)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(220)]
    rng.shuffle(chain)
    df = spark.createDataFrame(chain, "a long, b long").repartition(16)
    assert sorted(tuple(r) for r in components.connected(df).collect()) == brute_components(chain)


def brute_linkage(texts, threshold, how):
    """Merges the two nearest clusters, by the mean or largest distance of their members, until they are too far apart."""
    d = lambda a, b: sum(x != y for x, y in zip(a, b)) / len(a)
    groups = [[i] for i in range(len(texts))]
    while len(groups) > 1:
        far = lambda p, q: (max if how == "complete" else lambda v: sum(v) / len(v))([d(texts[i], texts[j]) for i in p for j in q])
        least, i, j = min((round(far(groups[i], groups[j]), 12), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if least > threshold + 1e-12:
            break
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def test_linkage_against_brute_force():
    import random

    import numpy as np

    from vdjlake.operators import lineages

    rng = random.Random(31)
    for how in ("average", "complete"):
        for _ in range(12):
            base = ["".join(rng.choice("ACGT") for _ in range(97)) for _ in range(3)]
            texts = []
            for b in base:
                for _ in range(rng.randint(2, 6)):
                    t = list(b)
                    for k in rng.sample(range(97), rng.randint(1, 14)):
                        t[k] = rng.choice("ACGT")
                    texts.append("".join(t))
            lab = lineages._linkage(texts, 0.2, how)
            got = {frozenset(np.flatnonzero(lab == x).tolist()) for x in set(lab.tolist())}
            assert got == brute_linkage(texts, 0.2, how)


def test_linkage_refuses_what_one_task_cannot_hold():
    from vdjlake.operators import lineages

    with pytest.raises(ValueError, match="texts"):
        lineages._linkage(["ACGT"] * 30, 0.1, "average", most=20)


def test_ambiguous_calls(spark):
    """Genes that any row of a scope lists together are one; without a list a gene is its own."""
    from vdjlake.operators import lineages

    rows = [("c", "r1", "IGHV1-2*01,IGHV1-3*01"), ("c", "r2", "ighv1-3*02"), ("c", "r3", "IGHV4-4*01, IGHV1-3"), ("c", "r4", "IGHV9*01"), ("d", "r5", "IGHV1-3*01"), ("c", "r6", None), (None, "r7", "IGHV1-2"), ("d", "r8", " ")]
    df = spark.createDataFrame(rows, "scope string, k string, call string").withColumn("gene", F.lit("x"))
    got = {(r["scope"], r["k"]): r["v"] for r in lineages.gene_groups(df, ["scope"], "call", "v").collect()}
    assert got == {("c", "r1"): "IGHV1-2", ("c", "r2"): "IGHV1-2", ("c", "r3"): "IGHV1-2", ("c", "r4"): "IGHV9", ("d", "r5"): "IGHV1-3", ("c", "r6"): None, (None, "r7"): "IGHV1-2", ("d", "r8"): None}


def test_kmer_profiles_and_vector_clusters(spark):
    """Profiles count words; clusters equal single linkage over all pairs, in tiles of any size and with copies."""
    import random

    from vdjlake.operators import lineages

    rng = random.Random(41)
    texts = ["ACGTA", "AAAA", "AC", "", "ANCGT", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string").coalesce(1)
    got = {r["k"]: r["p"] for r in df.select("k", lineages.kmer_profile("t", 2).alias("p")).collect()}
    words = [a + b for a in "ACGT" for b in "ACGT"]
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else [float(sum(t[j : j + 2] == w for j in range(len(t) - 1))) for w in words])
    base = [np.array([rng.gauss(0, 1) for _ in range(8)]) for _ in range(6)]
    rows = [(i, (base[i % 6] + np.array([rng.gauss(0, 0.05) for _ in range(8)])).tolist(), "xy"[i % 2]) for i in range(90)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(9)] + [(200, None, "x"), (201, [0.0] * 8, "y")]
    df = spark.createDataFrame(rows, "vec_id long, u array<double>, part string")
    for cut in (0.0005, 0.01):
        up = {r[0]: r[0] for r in rows if r[1]}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in rows:
            for b in rows:
                if a[1] and b[1] and any(a[1]) and any(b[1]) and a[0] < b[0] and a[2] == b[2] and 1 - np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) <= cut:
                    x, y = find(a[0]), find(b[0])
                    up[max(x, y)] = min(x, y)
        want = {k: find(k) for k in up}
        assert len(set(want.values())) < len(want) - 9
        for tile in (4096, 3):
            old, lineages.TILE = lineages.TILE, tile
            try:
                assert dict(map(tuple, lineages.embedding_clusters(df, "vec_id", "u", cut, ["part"]).collect())) == want
            finally:
                lineages.TILE = old
