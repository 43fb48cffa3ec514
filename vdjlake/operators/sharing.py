"""Clones shared between patients: public clones, overlaps, grids and networks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vdjlake.functions import sequence as X
from vdjlake.operators.similarity import block_edit_pairs
from vdjlake.session import table

#: Distinct CDR3s of a cluster that are compared with as many others in one group.
PART = 1024


def patient_counts(df: DataFrame, keys: list[str], patient: str = "patient") -> DataFrame:
    """``keys..., patient, n``: rows of each clone per patient; null keys left out."""
    rows = df.where(" and ".join(f"`{k}` is not null" for k in [*keys, patient]))
    return rows.groupBy(*keys, F.col(patient).alias("patient")).agg(F.count(F.lit(1)).alias("n"))


def public_clones(df: DataFrame, keys: list[str], patient: str = "patient", cdr3: str = "cdr3", row_id: str = "sequence_id", least: int = 2) -> DataFrame:
    """Clones seen in at least ``least`` patients.

    keys..., patients, rows, patient_set (sorted), cdr3s (distinct), representative
    (smallest row id), by_patient (map of rows).
    """
    rows = df.where(" and ".join(f"`{k}` is not null" for k in [*keys, patient]))
    per = rows.groupBy(*keys, F.col(patient).alias("patient")).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("rep"))
    a = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("patients"),
        F.sum("n").alias("rows"),
        F.array_sort(F.collect_list("patient")).alias("patient_set"),
        F.min("rep").alias("representative"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("patient", "n")))).alias("by_patient"),
    ).where(F.col("patients") >= least)
    distinct = rows.where(F.col(cdr3).isNotNull()).groupBy(*keys).agg(F.countDistinct(cdr3).alias("cdr3s"))
    return a.join(distinct, keys, "left").withColumn("cdr3s", F.coalesce("cdr3s", F.lit(0)))


def exact_public(df: DataFrame, patient: str = "patient", cdr3: str = "cdr3", v: str = "v", j: str = "j", least: int = 2) -> DataFrame:
    """Public clones by equal (cdr3, v, j): ``cdr3, v, j, patients, rows``."""
    per = patient_counts(df, [cdr3, v, j], patient)
    return per.groupBy(cdr3, v, j).agg(F.count(F.lit(1)).alias("patients"), F.sum("n").alias("rows")).where(F.col("patients") >= least)


def public_stats(public: DataFrame) -> DataFrame:
    """One row: number of public clones, greatest number of patients, patients involved."""
    everyone = public.select(F.explode("patient_set").alias("p"))
    a = public.agg(F.count(F.lit(1)).alias("clones"), F.coalesce(F.max("patients"), F.lit(0)).alias("most_shared"))
    return a.withColumn("patients", everyone.agg(F.countDistinct("p")).scalar())


def public_ids(df: DataFrame, keys: list[str], timepoint: str = "timepoint", file: str = "sample_file", patient: str = "patient", least: int = 2) -> DataFrame:
    """Distinct keys that, at any one timepoint with ``least`` files or more, ``least`` patients share."""
    enough = df.where(F.col(file).isNotNull()).groupBy(F.col(timepoint).alias("__t")).agg(F.countDistinct(file).alias("files")).where(F.col("files") >= least)
    rows = df.where(" and ".join(f"`{k}` is not null" for k in [*keys, patient])).select(*keys, timepoint, patient).distinct()
    per = rows.groupBy(*keys, timepoint).agg(F.count(F.lit(1)).alias("p")).where(F.col("p") >= least)
    return per.join(enough, F.col(timepoint) == F.col("__t"), "left_semi").select(*keys).distinct()


def repertoire_totals(df: DataFrame, group: list[str], clone: str = "clone_id") -> DataFrame:
    """``group..., total``: rows that carry a clone."""
    return df.where(F.col(clone).isNotNull()).groupBy(*group).agg(F.count(F.lit(1)).alias("total"))


def heatmap(df: DataFrame, keys: list[str], patient: str = "patient", clones: DataFrame | None = None, scope: list[str] | None = None) -> DataFrame:
    """Dense grid of clones x patients: ``keys..., patient, present, n, percent`` of the patient's repertoire.

    ``clones`` are the rows of the grid, e.g. a top list; ``scope`` the key
    columns within which patients are listed (a cohort).
    """
    scope = scope or []
    n = patient_counts(df, keys, patient)
    totals = n.groupBy(*scope, "patient").agg(F.sum("n").alias("total"))
    rows = clones.select(*keys).distinct() if clones is not None else n.select(*keys).distinct()
    if scope:
        grid = rows.join(totals, scope)
    else:  # the list of patients is as long as the grid is wide
        listed = totals.agg(F.array_sort(F.collect_list(F.struct("patient", "total")))).scalar()
        grid = rows.withColumn("__p", F.explode(listed)).select(*keys, "__p.patient", "__p.total")
    full = grid.join(n, [*keys, "patient"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(*keys, "patient", (F.col("n") > 0).cast("int").alias("present"), "n", (F.col("n") / F.col("total") * 100).alias("percent"))


def shared_pairs(df: DataFrame, keys: list[str], patient: str = "patient", scope: list[str] | None = None) -> DataFrame:
    """``scope..., p1, p2, shared``: clones that two patients share.

    Per clone the sorted set of its patients is expanded to its pairs in place;
    a clone has at most as many members as there are patients.
    """
    scope = scope or []
    sets = patient_counts(df, keys, patient).groupBy(*keys).agg(F.array_sort(F.collect_list("patient")).alias("p")).where(F.size("p") > 1)
    alike = sets.groupBy(*scope, "p").agg(F.count(F.lit(1)).alias("n"))
    pairs = alike.select(*scope, "n", F.explode(F.expr("flatten(transform(sequence(1, size(p) - 1), i -> transform(slice(p, i + 1, size(p)), y -> struct(p[i - 1] as p1, y as p2))))")).alias("x"))
    return pairs.groupBy(*scope, "x.p1", "x.p2").agg(F.sum("n").alias("shared"))


def set_intersections(df: DataFrame, keys: list[str], patient: str = "patient", scope: list[str] | None = None) -> DataFrame:
    """``scope..., patients, clones``: clones per exact set of patients."""
    sets = patient_counts(df, keys, patient).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("patient")), "|").alias("patients"))
    return sets.groupBy(*(scope or []), "patients").agg(F.count(F.lit(1)).alias("clones"))


def bipartite(df: DataFrame, keys: list[str], patient: str = "patient", top: int = 50) -> DataFrame:
    """Edge list clone -> patient of the ``top`` clones by rows (ties by key): ``keys..., patient, n``."""
    n = patient_counts(df, keys, patient)
    lead = n.groupBy(*keys).agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), *keys).limit(top).select(*keys)
    return n.join(F.broadcast(lead), keys, "left_semi")


def _followers(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs sorted by block, b and a, the rows b that follow and the least leader a of each; only the followers of one block are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, taken = None, None, set()
        for batch in batches:
            out: list[tuple] = []
            *block, a, b = (c.to_pylist() for c in batch.columns)
            for x, y, z in zip(a, b, zip(*block) if blocks else [()] * batch.num_rows):
                if z != at:
                    at, last, taken = z, None, set()
                # a is before b, so it is settled: it leads unless it follows; the first leader of b is its least
                if x not in taken and y != last:
                    taken.add(y)
                    last = y
                    out.append((y, x))
            kind = batch.schema.field(blocks).type
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=kind) for i in range(2)], names=["node", "leads"])

    return run


def leader_clusters(df: DataFrame, block: list[str], cdr3: str = "cdr3", row_id: str = "sequence_id", edits: int = 2, keep: list[str] | None = None) -> DataFrame:
    """Greedy leader clustering within a block: ``block..., <row_id>, leader`` and the columns of ``keep``.

    In the order of row ids the first row not yet taken leads, and takes every
    later one within ``edits`` of it. Only pairs within reach are ever formed; those of a
    block are read once in the order of their later row, which settles who leads.
    """
    rows = df.where(" and ".join(f"`{c}` is not null" for c in [*block, cdr3, row_id]))
    reps = table(rows.groupBy(*block, cdr3).agg(F.min(row_id).alias("rep")), "reps")
    pairs = block_edit_pairs(reps, block, cdr3, "rep", edits).select(*block, "a", "b")
    placed = pairs.repartition(*block) if block else pairs.coalesce(1)
    kind = dict(df.dtypes)[row_id]
    follow = table(placed.sortWithinPartitions(*block, "b", "a").mapInArrow(_followers(len(block)), f"node {kind}, leads {kind}"), "follow")
    named = reps.join(follow, F.col("rep") == F.col("node"), "left").select(*block, cdr3, F.coalesce("leads", "rep").alias("leader"))
    out = list(dict.fromkeys([*block, row_id, *(keep or [])]))
    return rows.select(*dict.fromkeys([*out, cdr3])).join(named, [*block, cdr3]).select(*out, "leader")


def cluster_sharing(members: DataFrame, leader: str, file: str, cdr3: str, least: int = 2) -> DataFrame:
    """Clusters that span at least ``least`` files: ``leader, files, rows, similarity`` (mean over distinct pairs, 3 digits).

    Similarity is averaged over all pairs of a cluster's distinct CDR3s, 1 for a single one. Large
    clusters are cut into parts of PART texts, and sums per two parts are added up, so
    no task holds all pairs of a cluster.
    """
    a = members.groupBy(leader).agg(F.countDistinct(file).alias("files"), F.count(F.lit(1)).alias("rows")).where(F.col("files") >= least)
    texts = members.join(a.select(leader), leader, "left_semi").select(leader, F.col(cdr3).alias("t")).where("t is not null").distinct()
    size = texts.groupBy(leader).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    part = texts.join(size, leader).withColumn("p", F.expr("cast(pmod(xxhash64(t), parts) as int)")).withColumn("q", F.explode(F.expr("sequence(0, parts - 1)")))
    x = part.select(leader, F.col("p").alias("i"), F.col("q").alias("j"), F.col("t").alias("t1"))
    y = part.select(leader, F.col("q").alias("i"), F.col("p").alias("j"), F.col("t").alias("t2"))
    sums = x.join(y, [leader, "i", "j"]).where("t1 < t2").groupBy(leader, "i", "j").agg(F.sum(X.aa_similarity("t1", "t2")).alias("s"), F.count(F.lit(1)).alias("n"))
    sim = sums.groupBy(leader).agg(F.round(F.sum("s") / F.sum("n"), 3).alias("similarity"))
    return a.join(sim, leader, "left").withColumn("similarity", F.coalesce("similarity", F.lit(1.0)))
