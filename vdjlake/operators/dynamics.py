"""Clones over time: tracked sizes, status, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tracking_id(df: DataFrame, scope: list[str], lineage: str = "lineage_id", clone: str = "clone_id", name: str = "track") -> DataFrame:
    """Rows with their tracking id: the lineage where the scope has any and the row has one, else the clone.

    Lineages and clones number independently, so the id says which it is
    (``L12``, ``C7``); rows with neither are left out.
    """
    return df.withColumn(name, F.coalesce(F.concat(F.lit("L"), lineage), F.concat(F.lit("C"), clone))).where(F.col(name).isNotNull())


def tracked(df: DataFrame, scope: list[str], ord_: str = "ord", shm: str = "shm", track: str = "track") -> DataFrame:
    """``scope..., track, points``: per tracked clone its timepoints as an array of (ord, size, mean_shm), sorted.

    Timepoints without a row are left out of the array; it never has more
    entries than the study has timepoints.
    """
    per = df.where(F.col(ord_).isNotNull()).groupBy(*scope, track, F.col(ord_).alias("ord")).agg(F.count(F.lit(1)).alias("size"), F.coalesce(F.avg(shm), F.lit(0.0)).alias("mean_shm"))
    return per.groupBy(*scope, track).agg(F.array_sort(F.collect_list(F.struct("ord", "size", "mean_shm"))).alias("points"))


def dense_sizes(df: DataFrame, scope: list[str], ords: list[int], ord_: str = "ord", track: str = "track") -> DataFrame:
    """``scope..., track, ord, size``: every tracked clone at every timepoint, zero where it is absent."""
    per = df.where(F.col(ord_).isin(ords)).groupBy(*scope, track, F.col(ord_).alias("ord")).agg(F.count(F.lit(1)).alias("size"))
    grid = per.select(*scope, track).distinct().select(*scope, track, F.explode(F.array(*[F.lit(o) for o in ords])).alias("ord"))
    return grid.join(per, [*scope, track, "ord"], "left").withColumn("size", F.coalesce("size", F.lit(0)))


def size_trends(tracks: DataFrame, scope: list[str], n_timepoints: int, track: str = "track") -> DataFrame:
    """persistent (at all timepoints), expanding / contracting (last against first size, at two or more), fold change."""
    p = F.col("points")
    first, last = p[0], F.element_at(p, -1)
    k = F.size(p)
    return tracks.select(
        *scope,
        track,
        k.alias("present"),
        (k == n_timepoints).alias("persistent"),
        ((k >= 2) & (last["size"] > first["size"])).alias("expanding"),
        ((k >= 2) & (last["size"] < first["size"])).alias("contracting"),
        first["size"].alias("first_size"),
        last["size"].alias("last_size"),
        (last["size"] / first["size"]).alias("fold_change"),
    )


def mutation_gain(tracks: DataFrame, scope: list[str], track: str = "track") -> DataFrame:
    """``delta_shm``: mean mutations at the last minus the first timepoint with any; tracks with two of those or more."""
    mutated = F.filter("points", lambda x: x["mean_shm"] > 0)
    t = tracks.withColumn("__m", mutated).where(F.size("__m") >= 2)
    return t.select(*scope, track, (F.element_at("__m", -1)["mean_shm"] - F.col("__m")[0]["mean_shm"]).alias("delta_shm"))


def frequencies(df: DataFrame, scope: list[str], ord_: str = "ord", track: str = "track") -> DataFrame:
    """``scope..., track, ord, size, frequency``: share of the tracked rows of a timepoint."""
    per = df.where(F.col(ord_).isNotNull()).groupBy(*scope, track, F.col(ord_).alias("ord")).agg(F.count(F.lit(1)).alias("size"))
    totals = per.groupBy(*scope, "ord").agg(F.sum("size").alias("total"))
    return per.join(totals, [*scope, "ord"]).select(*scope, track, "ord", "size", (F.col("size") / F.greatest("total", F.lit(1))).alias("frequency"))


def status(freq: DataFrame, scope: list[str], n_timepoints: int, track: str = "track", up: float = 1.5, down: float = 0.67) -> DataFrame:
    """``status`` on frequencies.

    At all timepoints: expanding above ``up`` times the first frequency,
    contracting below ``down`` times, else persistent. Absent at the first:
    late_emerging. Gone by the last: disappeared. Gaps between: transient.
    """
    a = freq.groupBy(*scope, track).agg(
        F.count(F.lit(1)).alias("present"),
        F.min("ord").alias("first_ord"),
        F.max("ord").alias("last_ord"),
        F.min_by("frequency", "ord").alias("first_frequency"),
        F.max_by("frequency", "ord").alias("last_frequency"),
        F.sum("size").alias("rows"),
    )
    s = (
        F.when(
            F.col("present") == n_timepoints,
            F.when(F.col("last_frequency") > up * F.col("first_frequency"), "expanding").when(F.col("last_frequency") < down * F.col("first_frequency"), "contracting").otherwise("persistent"),
        )
        .when(F.col("first_ord") > 0, "late_emerging")
        .when(F.col("last_ord") < n_timepoints - 1, "disappeared")
        .otherwise("transient")
    )
    return a.withColumn("status", s)


def status_counts(st: DataFrame, scope: list[str]) -> DataFrame:
    return st.groupBy(*scope, "status").agg(F.count(F.lit(1)).alias("tracks"), F.sum("rows").alias("rows"))


def trajectories(df: DataFrame, scope: list[str], metric: DataFrame, timepoint: str = "timepoint", least: int = 2) -> DataFrame:
    """Rows of a per-timepoint metric table for the scopes that have ``least`` timepoints or more."""
    enough = df.groupBy(*scope).agg(F.countDistinct(timepoint).alias("__n")).where(F.col("__n") >= least)
    return metric.join(enough, scope, "left_semi")


def clone_ids_by_timepoint(df: DataFrame, scope: list[str], track: str = "track", clone: str = "clone_id", timepoint: str = "timepoint") -> DataFrame:
    """``clones``: the sorted set of clone ids of a track at each timepoint."""
    return df.where(F.col(clone).isNotNull()).groupBy(*scope, track, timepoint).agg(F.array_sort(F.collect_set(clone)).alias("clones"))


def design_from_mapping(mapping: DataFrame, group: str = "Study") -> DataFrame:
    """One group whose timepoints come in the order of first appearance (``pos``): group, timepoint, ord, filename."""
    first = mapping.groupBy("timepoint").agg(F.min("pos").alias("p"))
    from pyspark.sql import Window

    order = first.withColumn("ord", F.row_number().over(Window.orderBy("p")) - 1).drop("p")  # one row per timepoint
    return mapping.join(order, "timepoint").select(F.lit(group).alias("group_name"), "timepoint", "ord", "filename")


def reconcile(design: DataFrame, files: DataFrame) -> DataFrame:
    """Design rows whose file still exists, plus new files without a group (all-null design)."""
    kept = design.join(files, "filename", "left_semi")
    new = files.join(design, "filename", "left_anti").select("filename")
    return kept.unionByName(new, allowMissingColumns=True)


def design_from_folders(layout: DataFrame, staged: DataFrame) -> DataFrame:
    """Files of a folder layout (group_name, timepoint, filename) found among staged names.

    Exact name first, then ``<group>_<timepoint>_<name>``, then ``<group>_<name>``; the rest has
    no group.
    """
    keys = layout.select(
        "group_name",
        "timepoint",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("p"), F.col("filename").alias("name")),
                F.struct(F.lit(1).alias("p"), F.concat_ws("_", "group_name", "timepoint", "filename").alias("name")),
                F.struct(F.lit(2).alias("p"), F.concat_ws("_", "group_name", "filename").alias("name")),
            )
        ).alias("k"),
    ).select("group_name", "timepoint", "k.p", F.col("k.name").alias("filename"))
    best = keys.groupBy("filename").agg(F.min(F.struct("p", "group_name", "timepoint")).alias("b"))
    return staged.select("filename").distinct().join(best, "filename", "left").select("filename", "b.group_name", "b.timepoint")
