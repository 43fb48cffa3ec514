"""Stage tables and reports.

Large tables are written in parallel and never gathered. Reports - a row per
sample, timepoint, shared clone list and the like - are written as one file
with :func:`report`, after their size has been checked.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjlake.functions import sequence as X

#: Rows up to which a report is written as one file.
ONE_FILE = 100_000


def stage(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Immutable Parquet table of a pipeline stage, optionally split by columns (e.g. timepoint)."""
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("sep", "\t").option("header", True).option("quote", "\u0000").csv(path)


def fasta(df: DataFrame, path: str, by: list[str] | None = None, seq_id: str = "sequence_id", seq: str = "sequence", mode: str = "errorifexists") -> None:
    """``>id`` and sequence lines, a folder per combination of ``by``; rows without a sequence are left out."""
    rows = df.where(F.length(seq) > 0).select(*(by or []), F.concat(F.lit(">"), F.col(seq_id), F.lit("\n"), F.col(seq)).alias("value"))
    w = rows.write.mode(mode)
    (w.partitionBy(*by) if by else w).text(path)


def report(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """CSV with quotes doubled; one file in order where the table has at most ``ONE_FILE`` rows, else many."""
    small = df.limit(ONE_FILE + 1).count() <= ONE_FILE
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if small else out).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def workbook(sheets: dict[str, DataFrame], path: str, mode: str = "overwrite") -> dict[str, str]:
    """One CSV folder per sheet; returns the folder of each sheet by its title."""
    names = sheet_names(list(sheets))
    for title, df in sheets.items():
        report(df, f"{path.rstrip('/')}/{names[title]}", mode=mode)
    return {t: f"{path.rstrip('/')}/{n}" for t, n in names.items()}


def sheet_names(titles: list[str], longest: int = 31) -> dict[str, str]:
    """Unique names of at most ``longest`` characters without those that sheets and paths forbid."""
    out: dict[str, str] = {}
    used: set[str] = set()
    for t in titles:
        base = re.sub(r"[\\/*?:\[\]]", "_", t).strip() or "Sheet"
        name, i = base[:longest], 2
        while name.lower() in used:
            tail = f"_{i}"
            name, i = base[: longest - len(tail)] + tail, i + 1
        used.add(name.lower())
        out[t] = name
    return out


def csv_field(c):
    """A value as a CSV field: quoted where it has a comma, quote or line break, quotes doubled."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def dashboard(metrics: DataFrame, families: DataFrame, isotypes: DataFrame, keys: list[str]) -> DataFrame:
    """Metric rows with a column per V family and isotype frequency, fixed decimals.

    Families and isotypes are fixed small vocabularies of the study.
    """
    fam = families.groupBy(*keys).pivot("family").agg(F.first("frequency"))
    iso = isotypes.groupBy(*keys).pivot("class", [c for c, _ in X.IG_CLASSES]).agg(F.first("frequency"))
    out = metrics.join(fam, keys, "left").join(iso, keys, "left")
    doubles = [c for c, t in out.dtypes if t == "double" and c not in keys]
    for c in doubles:
        out = out.withColumn(c, F.round(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), 4))
    return out


def shared_sheet(grid: DataFrame, keys: list[str], value: str = "n") -> DataFrame:
    """Shared clones x patients with a totals row (keys null)."""
    names = [r[0] for r in grid.select("patient").distinct().orderBy("patient").collect()]
    wide = grid.groupBy(*keys).pivot("patient", names).agg(F.first(value))
    total = grid.groupBy().pivot("patient", names).agg(F.sum(value))
    return wide.unionByName(total, allowMissingColumns=True)


def sample_sheets(metrics: DataFrame, tests: DataFrame) -> dict[str, DataFrame]:
    """Per-sample metrics, and the rank-sum tests with their two pools of adjusted p-values as texts."""
    shown = tests.select(*[c for c in tests.columns if c not in ("p", "q")], X.p_text("p").alias("p"), X.p_text("q").alias("q"), X.stars("q").alias("stars"))
    return {"Samples": metrics, "Statistics": shown}


def cluster_sheets(rollup: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Clusters across cohorts with a column of rows per cohort, and their members."""
    per = members.groupBy("cluster").pivot("cohort").agg(F.sum("rows"))
    return {"Lineages": rollup.drop("by_cohort").join(per, "cluster", "left"), "Members": members}


def match_sheets(clones: DataFrame, matches: DataFrame, stats: DataFrame) -> dict[str, DataFrame]:
    return {"Clone summary": clones, "All matches": matches, "Stats": stats}


def dynamics_sheets(freq: DataFrame, keys: list[str], tiles: DataFrame) -> dict[str, DataFrame]:
    """Frequency, size and isotype of tracks per timepoint."""
    ords = [r[0] for r in freq.select("ord").distinct().orderBy("ord").collect()]
    wide = lambda c: freq.groupBy(*keys).pivot("ord", ords).agg(F.first(c))
    return {"Frequency": wide("frequency"), "Clone sizes": wide("size"), "Isotype": tiles}


def ndjson(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result artifact as one JSON document per line."""
    df.write.mode(mode).json(path)


def tree_metadata(trees: DataFrame) -> DataFrame:
    return trees.select("cohort", "timepoint", "clone_id", "clone_size", F.element_at(F.split("path", "/"), -1).alias("file"))
