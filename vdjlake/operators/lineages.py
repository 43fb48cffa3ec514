"""Clones, lineages across timepoints and clusters across cohorts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjlake.functions import sequence as X
from vdjlake.operators.components import connected, spanning, with_singletons
from vdjlake.operators.similarity import hamming_pairs
from vdjlake.session import discard, table

#: Part that may differ in the segment join before texts without such a neighbour are compared with their whole block.
NEAR = 0.05
#: Texts on either side of a tile of a block.
TILE = 4096


def clone_profiles(df: DataFrame, scope: list[str], v: str = "v", j: str = "j", cdr3: str = "cdr3", clone: str = "clone_id") -> DataFrame:
    """``scope..., clone, v, j, cdr3, size``: the most frequent value of each, ties to the smallest.

    Counted per value first, so a huge clone is combined before the shuffle;
    null values do not compete.
    """
    rows = df.where(F.col(clone).isNotNull())
    base = rows.groupBy(*scope, F.col(clone).alias("clone")).agg(F.count(F.lit(1)).alias("size"))
    out = base
    for c in (v, j, cdr3):
        n = rows.where(F.col(c).isNotNull()).groupBy(*scope, F.col(clone).alias("clone"), F.col(c).alias(c)).agg(F.count(F.lit(1)).alias("n"))
        top = n.groupBy(*scope, "clone").agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(c))
        out = out.join(top, [*scope, "clone"], "left")
    return out


def lineage_edges(profiles: DataFrame, scope: list[str], similarity: float = 0.85, timepoint: str = "timepoint", key: str = "profile") -> DataFrame:
    """``a, b``: profiles of different timepoints with equal V and J genes, equally long CDR3s, at least ``similarity`` alike.

    A profile lacking V, J or CDR3 has no edge.
    """
    limit = F.floor(F.length("cdr3") * F.lit(1 - similarity) + F.lit(1e-9))
    p = hamming_pairs(profiles, [*scope, "v", "j"], "cdr3", key, limit, F.col(f"{timepoint}_a") != F.col(f"{timepoint}_b"))
    return p.select(*scope, "a", "b", "distance")


def lineages(profiles: DataFrame, scope: list[str], similarity: float = 0.85, timepoint: str = "timepoint", key: str = "profile") -> DataFrame:
    """Profiles with their lineage: the smallest profile key linked to them, or their own."""
    edges = lineage_edges(profiles, scope, similarity, timepoint, key)
    return with_singletons(profiles, connected(edges), key).withColumnRenamed("component", "lineage")


def lineage_summary(lin: DataFrame, scope: list[str], timepoint: str = "timepoint") -> DataFrame:
    """``scope..., lineages, cross_timepoint``: how many lineages, and how many span two timepoints or more."""
    per = lin.groupBy(*scope, "lineage").agg(F.countDistinct(timepoint).alias("t"))
    return per.groupBy(*scope).agg(F.count(F.lit(1)).alias("lineages"), F.count(F.when(F.col("t") > 1, 1)).alias("cross_timepoint"))


def global_clone_ids(df: DataFrame, scope: list[str], timepoint: str = "timepoint", clone: str = "clone_id") -> DataFrame:
    """Rows with ``global_clone``: local ids shifted by the sum of (largest id + 1) of the earlier timepoints of the scope."""
    top = df.where(F.col(clone).isNotNull()).groupBy(*scope, timepoint).agg((F.max(clone) + 1).alias("span"))
    w = Window.partitionBy(*scope).orderBy(timepoint).rowsBetween(Window.unboundedPreceding, -1)  # one row per timepoint
    shift = top.select(*scope, timepoint, F.coalesce(F.sum("span").over(w), F.lit(0)).alias("__shift"))
    return df.join(shift, [*scope, timepoint], "left").withColumn("global_clone", F.col(clone) + F.col("__shift")).drop("__shift")


def cohort_rollup(df: DataFrame, v: str = "v", j: str = "j", cdr3: str = "cdr3", clone: str = "clone_id", cohort: str = "cohort", sample: str = "sample_file", row_id: str = "sequence_id", least: int = 1) -> DataFrame:
    """One row per cohort clone: its longest CDR3 (ties: first by row id), first V and J, samples, rows."""
    rows = df.where(F.col(clone).isNotNull() & F.col(cohort).isNotNull())
    a = rows.groupBy(F.col(cohort).alias("cohort"), F.col(clone).alias("clone")).agg(
        F.min_by(cdr3, F.struct(-F.coalesce(F.length(cdr3), F.lit(-1)), F.col(row_id))).alias("cdr3"),
        F.min_by(v, F.struct(F.col(v).isNull(), F.col(row_id))).alias("v"),
        F.min_by(j, F.struct(F.col(j).isNull(), F.col(row_id))).alias("j"),
        F.countDistinct(sample).alias("samples"),
        F.count(F.lit(1)).alias("rows"),
    )
    return a.where(F.col("rows") >= least)


def cohort_edges(clones: DataFrame, key: str = "key", fraction: float = 0.10) -> DataFrame:
    """``a, b``: clones of equal V and J family with equally long CDR3s within max(1, ceil(fraction * length)) differences.

    Pairs of one cohort are linked as well. The J family is that of heavy chains,
    so light chains have no edge.
    """
    c = clones.withColumn("vf", F.coalesce(X.v_family("v"))).withColumn("jf", X.j_family("j"))
    limit = F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.length("cdr3") - F.lit(1e-9)))
    return hamming_pairs(c.select(key, "vf", "jf", "cdr3"), ["vf", "jf"], "cdr3", key, limit).select("a", "b", "distance")


def cohort_clusters(clones: DataFrame, key: str = "key", cohort: str = "cohort", fraction: float = 0.10, least: int = 2) -> DataFrame:
    """``key, cluster``: clusters of linked clones that reach at least ``least`` cohorts."""
    parts = connected(cohort_edges(clones, key, fraction))
    named = clones.join(parts, F.col(key) == F.col("node")).drop("node")
    wide = named.groupBy("component").agg(F.countDistinct(cohort).alias("__n")).where(F.col("__n") >= least).select("component")
    return named.join(wide, "component", "left_semi").withColumnRenamed("component", "cluster")


def cluster_rollup(members: DataFrame, cohort: str = "cohort", cdr3: str = "cdr3", rows: str = "rows") -> DataFrame:
    """``cluster, cohorts (sorted), clones, rows, cdr3s, by_cohort``: totals of clusters across cohorts."""
    per = members.groupBy("cluster", cohort).agg(F.sum(rows).alias("n"))
    a = per.groupBy("cluster").agg(F.array_sort(F.collect_list(cohort)).alias("cohorts"), F.sum("n").alias("rows"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(cohort, "n")))).alias("by_cohort"))
    b = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("clones"), F.countDistinct(cdr3).alias("cdr3s"))
    return a.join(b, "cluster")


def cluster_cohort_top(members: DataFrame, cohort: str = "cohort", cdr3: str = "cdr3", rows: str = "rows") -> DataFrame:
    """``cluster, cohort, rows, top_cdr3``: per cohort the CDR3 with most rows, ties to the smallest."""
    n = members.groupBy("cluster", cohort, cdr3).agg(F.sum(rows).alias("n"))
    return n.groupBy("cluster", cohort).agg(F.sum("n").alias("rows"), F.min_by(cdr3, F.struct(-F.col("n"), F.col(cdr3))).alias("top_cdr3"))


# ---- clone calling


def nearest_distance(df: DataFrame, block: list[str], text: str, key: str, within: float = 1.0) -> DataFrame:
    """``key, nearest``: least non-zero Hamming distance over the length to another distinct text of the block, null if none.

    Equal texts do not count. ``within`` bounds the part that may differ; below
    1 the join needs only the segments that such texts must share. Without a bound
    that join settles the texts with a near neighbour, and only the others are
    compared with all texts of their block and length.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*block, text, key])).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(block)], F.col(text).alias("__text"), F.col(key).alias("__key"))
    block, text, name, key = [f"__b{i}" for i in range(len(block))], "__text", key, "__key"
    texts = rows.select(*block, F.col(text).alias("t")).distinct().withColumn("n", F.length("t")).where("n > 0")
    part = within if within < 1 else NEAR
    named = texts.withColumn("k", F.concat_ws("\u0001", *block, "t"))
    p = hamming_pairs(named.select(*block, F.col("t"), "k"), block, "t", "k", F.floor(F.lit(part) * F.length("t") + F.lit(1e-9)), together=2 if part > 0.12 else 1)
    both = p.select(*block, F.col("t_a").alias("t"), "distance").unionByName(p.select(*block, F.col("t_b").alias("t"), "distance"))
    near = both.groupBy(*block, "t").agg(F.min("distance").alias("d"))
    if within >= 1:
        near = table(near, "near")
        near = near.unionByName(_least_of_block(texts, texts.join(near, [*block, "t"], "left_anti"), block))
    return rows.select(*block, F.col(text).alias("t"), key).join(near, [*block, "t"], "left").select(F.col(key).alias(name), (F.col("d") / F.length("t")).alias("nearest"))


def _least_of_block(texts: DataFrame, open_: DataFrame, block: list[str]) -> DataFrame:
    """``block..., t, d``: least distance of each open text to any other text of its block and length, all of them compared.

    A large block is cut into tiles of TILE open texts by TILE texts, so no task holds a block.
    """
    on = [*block, "n"]
    size = texts.groupBy(*on).agg(F.count(F.lit(1)).alias("m")).where("m > 1").join(open_.groupBy(*on).agg(F.count(F.lit(1)).alias("o")), on)
    size = size.select(*on, F.ceil(F.col("m") / TILE).cast("int").alias("down"), F.ceil(F.col("o") / TILE).cast("int").alias("across"))
    at, every = "cast(pmod(xxhash64(t), {0}) as int)", "explode(sequence(0, {0} - 1))"
    a = open_.join(size, on).select(*on, "t", F.lit(True).alias("open"), F.expr(at.format("across")).alias("i"), F.expr(every.format("down")).alias("j"))
    b = texts.join(size, on).select(*on, "t", F.lit(False).alias("open"), F.expr(every.format("across")).alias("i"), F.expr(at.format("down")).alias("j"))
    kinds = dict(texts.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in block) + ", t string, d int"

    def least(t: pa.Table) -> pa.Table:
        is_open = t["open"].to_numpy()
        letters = np.array([np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in t["t"].to_pylist()])
        hot = np.concatenate([letters == c for c in np.unique(letters)], axis=1).astype(np.float32)
        q, all_, n, d = hot[is_open], hot[~is_open], letters.shape[1], []
        for k in range(0, len(q) if len(all_) else 0, 512):
            equal = q[k : k + 512] @ all_.T
            equal[equal == n] = -1  # the text itself
            d.append(equal.max(axis=1))
        found = np.concatenate(d) if d else np.full(len(q), -1.0)
        out = t.filter(pa.array(is_open)).select([*block, "t"]).append_column("d", pa.array((n - found).astype(np.int32)))
        return out.filter(pa.array(found >= 0))

    return a.unionByName(b).groupBy(*on, "i", "j").applyInArrow(least, schema).groupBy(*block, "t").agg(F.min("d").alias("d"))


def gene_groups(df: DataFrame, scope: list[str], calls: str, out: str) -> DataFrame:
    """Rows with ``out``: the least gene that stands for all genes which rows of the scope list together, directly or in turn.

    ``calls`` is a list of gene calls, separated by commas, in any notation. A row with one gene that no
    list connects keeps it; a row without a call has null; a row with a null in ``scope`` its first gene.
    """
    genes = df.withColumn("__g", F.filter(F.transform(F.split(F.col(calls), ","), lambda c: F.regexp_extract(F.upper(F.trim(c)), r"^([^*(\s]+)", 1)), lambda g: g != ""))
    first = genes.where(" and ".join(["size(__g) > 1", *[f"`{c}` is not null" for c in scope]])).select(*scope, F.col("__g")[0].alias("g0"), F.explode("__g").alias("g")).distinct()
    key = lambda g: F.to_json(F.struct(*[F.col(c).alias(f"s{i}") for i, c in enumerate(scope)], g.alias("g")))
    edges = first.select(key(F.col("g0")).alias("a"), key(F.col("g")).alias("b"))
    parts = connected(edges)
    named = first.select(*scope, "g").distinct().withColumn("__n", key(F.col("g"))).join(parts, F.col("__n") == F.col("node")).select(*scope, "g", "component")
    least = named.groupBy(*scope, "component").agg(F.min("g").alias("least"))
    table_ = named.join(least, [*scope, "component"]).select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(scope)], F.col("g").alias("__g0"), "least")
    on = [F.col(c) == F.col(f"__s{i}") for i, c in enumerate(scope)] + [F.get("__g", F.lit(0)) == F.col("__g0")]
    joined = genes.join(table_, on, "left")
    return joined.withColumn(out, F.coalesce("least", F.get("__g", F.lit(0)))).drop("__g", "__g0", "least", *[f"__s{i}" for i in range(len(scope))])


def single_link_clones(df: DataFrame, block: list[str], text: str, key: str, threshold: float) -> DataFrame:
    """``key, clone``: single-linkage clones at a normalised Hamming distance of at most ``threshold``.

    Equivalent to components of the pairs within the threshold. The clone's
    name is the smallest key in it.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*block, text, key]))
    reps = rows.groupBy(*block, text).agg(F.min(key).alias("rep"))
    limit = F.floor(F.lit(threshold) * F.length(text) + F.lit(1e-9))
    parts = with_singletons(reps, connected(hamming_pairs(reps, block, text, "rep", limit)), "rep")
    return rows.select(*block, text, key).join(parts.select(*block, text, "component"), [*block, text]).select(key, F.col("component").alias("clone"))


#: Texts of one component that a task can link: its distances take 4 bytes for each two of them.
MOST_LINKED = 20_000


def _linkage(texts: list[str], threshold: float, how: str, most: int = MOST_LINKED) -> np.ndarray:
    """Cluster numbers of average or complete linkage cut at a distance, by merging the nearest two, the first of equally near ones.

    Every row keeps its nearest later row, so a merge looks again only at rows whose nearest has changed.
    """
    n = len(texts)
    if n > most:
        raise ValueError(f"{how} linkage of {n} texts in one component; a task holds {most}: use single linkage or a smaller threshold")
    a = np.array([np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts])
    d = np.full((n, n), np.inf, dtype=np.float32 if n > 4_000 else np.float64)
    for i in range(n - 1):
        d[i, i + 1 :] = (a[i + 1 :] != a[i]).mean(axis=1)
        d[i + 1 :, i] = d[i, i + 1 :]
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    near, far = np.zeros(n, dtype=np.int64), np.full(n, np.inf)

    def look(i: int) -> None:
        if i + 1 < n:
            near[i] = i + 1 + int(np.argmin(d[i, i + 1 :]))
            far[i] = d[i, near[i]]

    for i in range(n):
        look(i)
    for _ in range(n - 1):
        i = int(np.argmin(far))
        j = int(near[i])
        if far[i] > threshold + (1e-12 if d.dtype == np.float64 else 1e-6):
            break
        row = np.maximum(d[i], d[j]) if how == "complete" else (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        alive[j] = False
        row[i] = np.inf
        row[~alive] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        far[j] = np.inf
        # rows before i may have i as their nearest now; those whose nearest was i or j look again
        early = np.arange(n) < i
        closer = early & alive & ((row < far) | ((row == far) & (i < near)))
        again = np.flatnonzero(alive & ((near == i) | (near == j)) & ~closer & (np.arange(n) != i))
        near[closer], far[closer] = i, row[closer]
        for k in again:
            look(int(k))
        look(i)
    return label


def linkage_clones(df: DataFrame, block: list[str], text: str, key: str, threshold: float, linkage: str = "average") -> DataFrame:
    """``key, clone``: hierarchical clones of a block's equally long texts, cut at ``threshold``.

    Texts farther apart than a chain of pairs within the threshold can never
    share a cluster of either linkage, so blocks are first split into the
    components of single linkage; each of those is agglomerated in one task.
    """
    if linkage == "single":
        return single_link_clones(df, block, text, key, threshold)
    if linkage not in ("average", "complete"):
        raise ValueError("linkage is 'single', 'average' or 'complete'")
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*block, text, key]))
    reps = rows.groupBy(*block, text).agg(F.min(key).alias("rep")).withColumn("n", F.length(text))
    limit = F.floor(F.lit(threshold) * F.length(text) + F.lit(1e-9))
    parts = with_singletons(reps, connected(hamming_pairs(reps.drop("n"), block, text, "rep", limit)), "rep").select("rep", F.col(text).alias("t"), "component")
    # components of one text need no agglomeration
    sized = parts.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    many = parts.join(sized.where("m > 1"), "component").select("rep", "t", "component")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable").reset_index(drop=True)
        lab = _linkage(pdf["t"].tolist(), threshold, linkage)
        first = pdf.groupby(lab)["rep"].transform("min")
        return pd.DataFrame({"rep": pdf["rep"], "clone": first})

    kind = dict(reps.dtypes)["rep"]
    called = many.groupBy("component").applyInPandas(cut, f"rep {kind}, clone {kind}")
    alone = parts.join(sized.where("m = 1"), "component", "left_semi").select("rep", F.col("rep").alias("clone"))
    named = reps.join(called.unionByName(alone), "rep").select(*block, text, "clone")
    return rows.select(*block, text, key).join(named, [*block, text]).select(key, "clone")


# ---- threshold of the distances


def distance_histogram(df: DataFrame, distance: str, by: list[str] | None = None, bins: int = 50) -> DataFrame:
    """``by..., bin, low, n, density``: histogram of valid distances (0 < d <= 1) over 0..1."""
    by = by or []
    v = df.where((F.col(distance) > 0) & (F.col(distance) <= 1)).select(*by, F.least(F.floor(F.col(distance) * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    n = v.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return n.select(*by, "bin", (F.col("bin") / F.lit(bins)).alias("low"), "n", (F.col("n") / F.sum("n").over(w) * bins).alias("density"))


def kernel_density(x: np.ndarray, w: np.ndarray, points: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(grid over 0..1, Gaussian kernel density) of weighted values, bandwidth by the rule of thumb."""
    order = np.argsort(x)
    x, w = x[order], w[order]
    total = w.sum()
    mean = (x * w).sum() / total
    sd = np.sqrt((w * (x - mean) ** 2).sum() / total)
    q1, q3 = (x[np.searchsorted(np.cumsum(w), total * q)] for q in (0.25, 0.75))
    spread = min(sd, (q3 - q1) / 1.34) or sd or 1e-3
    h = 0.9 * spread * total ** (-0.2)
    grid = np.linspace(0, 1, points)
    k = (w[None, :] * np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2)).sum(axis=1)
    return grid, k / (total * h * np.sqrt(2 * np.pi))


def density_curve(df: DataFrame, distance: str, by: str, points: int = 512, bins: int = 2000) -> DataFrame:
    """``label, x, density``: kernel density of the valid distances of each label on ``points`` places, from a histogram of at most ``bins`` rows."""
    h = df.where((F.col(distance) > 0) & (F.col(distance) <= 1)).groupBy(F.col(by).alias("label"), F.round(F.col(distance) * bins).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    kind = dict(h.dtypes)["label"]

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, dens = kernel_density((pdf["b"] / bins).to_numpy(), pdf["n"].to_numpy(float), points)
        return pd.DataFrame({"label": pdf["label"].iloc[0], "x": grid, "density": dens})

    return h.groupBy("label").applyInPandas(curve, f"label {kind}, x double, density double")


def density_threshold(distances: np.ndarray, weights: np.ndarray | None = None, default: float = 0.1, points: int = 512) -> float:
    """Valley between the first two modes of a Gaussian kernel density on 0..1; the median, then ``default``, where there is none.

    Falls back to the median below 5 distinct values, 20 values, or a variance of 1e-6.
    """
    x = np.asarray(distances, float)
    w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
    ok = (x > 0) & (x <= 1)
    x, w = x[ok], w[ok]
    if not len(x):
        return default
    order = np.argsort(x)
    x, w = x[order], w[order]
    total = w.sum()
    median = float(x[np.searchsorted(np.cumsum(w), total / 2)])
    mean = (x * w).sum() / total
    var = (w * (x - mean) ** 2).sum() / total
    if len(np.unique(x)) < 5 or total < 20 or var < 1e-6:
        return min(1.0, max(median, 1e-9))
    grid, dens = kernel_density(x, w, points)
    up = np.diff(dens) > 0
    peaks = np.flatnonzero(up[:-1] & ~up[1:]) + 1
    if len(peaks) < 2:
        return min(1.0, max(median, 1e-9))
    top = np.sort(peaks[np.argsort(-dens[peaks])[:2]])
    valley = top[0] + int(np.argmin(dens[top[0] : top[1] + 1]))
    return float(grid[valley]) or default


def thresholds(df: DataFrame, distance: str, by: str, fixed: dict[str, float] | None = None, bins: int = 2000) -> DataFrame:
    """``label, threshold``: density threshold per label, fitted on a histogram of at most ``bins`` rows per label.

    ``fixed`` overrides labels; values outside 0..1 are refused.
    """
    for k, x in (fixed or {}).items():
        if not 0 <= x <= 1:
            raise ValueError(f"threshold of {k} is outside 0..1")
    h = df.where((F.col(distance) > 0) & (F.col(distance) <= 1)).groupBy(F.col(by).alias("label"), F.round(F.col(distance) * bins).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    kind = dict(h.dtypes)["label"]
    over = dict(fixed or {})

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pdf["label"].iloc[0]
        t = over.get(label, density_threshold((pdf["b"] / bins).to_numpy(), pdf["n"].to_numpy()))
        return pd.DataFrame({"label": [label], "threshold": [t]})

    return h.groupBy("label").applyInPandas(fit, f"label {kind}, threshold double")


def kmer_profile(text: str, k: int = 3, letters: str = "ACGT") -> Column:
    """How often each word of ``k`` letters occurs in a text, in alphabetical order of the words; a plain encoder of sequences.

    Words with other letters are left out; a null text has a null profile.
    """
    place = np.full(256, -1, dtype=np.int64)
    place[list(letters.encode())] = np.arange(len(letters))

    def profiles(texts: pd.Series) -> pd.Series:
        raw = [(t or "").encode("ascii", "replace") for t in texts]
        at = place[np.frombuffer(b"\n".join(raw) + b"\n" * k, np.uint8)]
        ends = np.cumsum([len(r) + 1 for r in raw])
        row = np.searchsorted(ends, np.arange(len(at) - k + 1), side="right")
        code, ok = np.zeros(len(at) - k + 1, dtype=np.int64), np.ones(len(at) - k + 1, dtype=bool)
        for o in range(k):
            x = at[o : len(at) - k + 1 + o]
            ok &= x >= 0
            code = code * len(letters) + np.maximum(x, 0)
        n = len(letters) ** k
        counts = np.bincount(row[ok] * n + code[ok], minlength=len(raw) * n).reshape(-1, n)[: len(raw)].astype(float)
        return pd.Series([None if t is None else c for t, c in zip(texts, counts)])

    return F.pandas_udf(profiles, "array<double>")(text)


def _near_vectors(cut: float):
    """The links of one tile: of the vectors within ``cut`` of each other, as many links as hold them together."""

    def run(t: pa.Table) -> pa.Table:
        guest = t["guest"].to_numpy()
        u = np.array(t["u"].to_pylist(), dtype=np.float64)
        keys = t["k"].to_numpy()
        left, right = np.flatnonzero(t["left"].to_numpy()), np.flatnonzero(t["right"].to_numpy())
        xs, ys = [], []
        for lo in range(0, len(left), 512):
            i, j = np.nonzero(1 - u[left[lo : lo + 512]] @ u[right].T <= cut)
            i, j = left[lo + i], right[j]
            ok = guest[j] | (keys[i] < keys[j])
            if ok.any():
                nodes, roots = spanning(i[ok], j[ok])
                xs.append(nodes[nodes != roots]), ys.append(roots[nodes != roots])
        if xs:
            nodes, roots = spanning(np.concatenate(xs), np.concatenate(ys))
            x, y = nodes[nodes != roots], roots[nodes != roots]
        else:
            x = y = np.zeros(0, dtype=np.int64)
        return pa.table({"a": t["k"].take(pa.array(x)), "b": t["k"].take(pa.array(y))})

    return run


def embedding_clusters(df: DataFrame, key: str, vector: str, cut: float = 0.00015, block: list[str] | None = None) -> DataFrame:
    """``key, cluster``: single linkage of unit vectors within a cosine distance, by blocks.

    Equal vectors are one class, named by its least key. Two unit vectors within distance c lie less than
    sqrt(2 c) apart in every direction, so classes are put into cells of that width along a few random
    directions - three for small cuts, one where a cell is as wide as most projections are spread - and a cell
    is compared with itself and half of its neighbours. The products are those of matrices, in tiles of at most
    ``TILE`` vectors on either side, and a tile sends links that hold its vectors together, not all pairs. With a
    wide cut and vectors in all directions most cells meet: no exact join avoids that.
    """
    block = block or []
    kinds = dict(df.dtypes)
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [key, vector, *block])).select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate(block)], F.col(key).alias("k"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    bs = [f"__b{i}" for i in range(len(block))]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.withColumn("__n", norm).where("__n > 0").select(*bs, "k", F.transform("v", lambda x: x / F.col("__n")).alias("u"))
    classes = table(unit.groupBy(*bs, "u").agg(F.min("k").alias("k")), "vectors")
    step = float(np.sqrt(2 * cut)) * 1.0001
    dims = 1 if step > 0.2 else 3
    size = classes.select(F.max(F.size("u")).alias("n")).first()["n"] or 1
    axes = np.linalg.qr(np.random.default_rng(17).normal(size=(size, min(dims, size))))[0].T
    along = [F.floor(F.aggregate(F.zip_with("u", F.array(*[F.lit(float(x)) for x in a]), lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) / F.lit(step)).alias(f"c{i}") for i, a in enumerate(axes)]
    cs = [f"c{i}" for i in range(len(axes))]
    cells = table(classes.select(*bs, "k", "u", *along), "cells")
    m = cells.groupBy(*bs, *cs).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    # half of the neighbours: those after the cell itself in the order of their offsets
    near = [o for o in np.ndindex(*(3,) * len(cs)) if tuple(x - 1 for x in o) > (0,) * len(cs)]
    shift = F.array(*[F.struct(*[F.lit(int(x) - 1).alias(f"d{i}") for i, x in enumerate(o)]) for o in near])
    guests = cells.withColumn("o", F.explode(shift)).select(*bs, "k", "u", *[(F.col(c) - F.col(f"o.d{i}")).alias(c) for i, c in enumerate(cs)], F.lit(True).alias("guest"))
    homes = cells.withColumn("guest", F.lit(False))
    both = homes.unionByName(guests.select(homes.columns)).join(m, [*bs, *cs])
    at = F.expr("cast(pmod(xxhash64(k), parts) as int)")
    every = F.expr("sequence(0, parts - 1)")
    # a home is on the left of its own row of tiles; homes and guests are on the right of their column
    left = both.where("not guest").select(*bs, *cs, "k", "u", "guest", at.alias("i"), F.explode(every).alias("j"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    right = both.select(*bs, *cs, "k", "u", "guest", F.explode(every).alias("i"), at.alias("j"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    links = left.unionByName(right).groupBy(*bs, *cs, "i", "j").applyInArrow(_near_vectors(cut), f"a {kinds[key]}, b {kinds[key]}")
    copies = unit.join(classes.select(*bs, "u", F.col("k").alias("least")), [*bs, "u"]).where("k <> least").select(F.col("k").alias("a"), F.col("least").alias("b"))
    out = with_singletons(df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key), connected(links.unionByName(copies)), key).withColumnRenamed("component", "cluster")
    discard(classes, cells)
    return out


def cluster_sizes(members: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Members with the number of members of their cluster (``size``); a join, so a huge cluster is no task's window."""
    return members.join(members.groupBy(cluster).agg(F.count(F.lit(1)).alias("size")), cluster)
