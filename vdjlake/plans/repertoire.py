"""Queries of diversity, usage, sharing and dynamics over the live sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjlake.operators import diversity as D
from vdjlake.operators import dynamics as L
from vdjlake.operators import rows as R
from vdjlake.operators import sharing as P
from vdjlake.operators import usage as U
from vdjlake.plans.base import IG_CLASS, ORD, TIMEPOINTS, V_FAMILY, S, ord_of, seqs
from vdjlake.session import read

CT = ["cohort", "timepoint"]
CC = ["cohort", "clone_id"]
NT = len(TIMEPOINTS)


def clone_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows per clone; rows without one as clone -1."""
    return D.clone_sizes(seqs(spark, d), ["cohort"])


def diversity_by_timepoint(spark: SparkSession, d: str) -> DataFrame:
    """Size metrics per cohort and timepoint."""
    return D.diversity(seqs(spark, d), CT)


def diversity_bundle(spark: SparkSession, d: str) -> DataFrame:
    """All metrics per sample file, unassigned rows dropped."""
    return D.bundle(seqs(spark, d), ["sample_file"], null_clone="drop")


def mutation_stats(spark: SparkSession, d: str) -> DataFrame:
    return D.mutation_stats(seqs(spark, d), CT)


def rank_abundance(spark: SparkSession, d: str) -> DataFrame:
    """The thirty largest clones of each cohort and timepoint."""
    return D.rank_abundance(seqs(spark, d), CT, top=30)


def with_clone_size(spark: SparkSession, d: str) -> DataFrame:
    """Every live sequence with the size of its clone."""
    return D.with_clone_size(seqs(spark, d), keys=["cohort"]).select("sequence_id", "clone_size")


def pooled_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the sample files pooled per cohort."""
    s = seqs(spark, d)
    return D.pooled(D.diversity(s, ["cohort", "sample_file"]), ["cohort"])


def dashboard_summary(spark: SparkSession, d: str) -> DataFrame:
    return D.summary(D.bundle(seqs(spark, d), ["cohort"]))


def v_family_usage(spark: SparkSession, d: str) -> DataFrame:
    return U.family_usage(seqs(spark, d), CT)


def top_v_families(spark: SparkSession, d: str) -> DataFrame:
    return U.top_families(U.family_usage(seqs(spark, d), CT), 5)


def isotype_usage(spark: SparkSession, d: str) -> DataFrame:
    return U.isotype_usage(seqs(spark, d), CT)


def isotype_counts(spark: SparkSession, d: str) -> DataFrame:
    return U.isotype_counts(seqs(spark, d))


def isotype_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Dominant class, mean mutations and mice of each clone and timepoint."""
    return U.isotype_tiles(seqs(spark, d).where("clone_id is not null"), CC)


def label_scores(spark: SparkSession, d: str) -> DataFrame:
    """Event types as labels: capped scores, distinct users and the surest one."""
    e = read(spark, d, "events").select("event_type", "user_id", (F.col("value") / 100).alias("confidence"))
    return U.label_scores(e, "event_type", "user_id", "confidence", per=0.5, cap=200.0)


def public_clones(spark: SparkSession, d: str) -> DataFrame:
    """Clones found in two mice of a cohort or more."""
    p = P.public_clones(seqs(spark, d), CC)
    return p.select(*CC, "patients", "rows", F.array_join("patient_set", "|").alias("patient_set"), "cdr3s", "representative")


def exact_public(spark: SparkSession, d: str) -> DataFrame:
    """Equal CDR3, V and J in two cohorts or more."""
    return P.exact_public(seqs(spark, d), patient="cohort")


def public_stats(spark: SparkSession, d: str) -> DataFrame:
    s = seqs(spark, d).withColumn("patient", F.concat_ws("/", "cohort", "patient"))
    return P.public_stats(P.public_clones(s, CC))


def public_ids(spark: SparkSession, d: str) -> DataFrame:
    """Clones that two mice share at one timepoint."""
    return P.public_ids(seqs(spark, d), CC)


def repertoire_totals(spark: SparkSession, d: str) -> DataFrame:
    return P.repertoire_totals(seqs(spark, d), ["cohort", "patient"])


def clone_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Public clones x mice of their cohort."""
    s = seqs(spark, d)
    return P.heatmap(s, CC, clones=P.public_clones(s, CC), scope=["cohort"])


def shared_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.shared_pairs(seqs(spark, d), CC, scope=["cohort"])


def set_intersections(spark: SparkSession, d: str) -> DataFrame:
    return P.set_intersections(seqs(spark, d), CC, scope=["cohort"])


def bipartite(spark: SparkSession, d: str) -> DataFrame:
    return P.bipartite(seqs(spark, d), CC, top=50)


def clone_buckets(spark: SparkSession, d: str) -> DataFrame:
    return R.clone_buckets(seqs(spark, d), ["cohort"])


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return L.tracking_id(seqs(spark, d), ["cohort"]).withColumn("ord", ord_of())


def tracked_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every track at every timepoint, zero-filled."""
    return L.dense_sizes(_tracks(spark, d), ["cohort"], list(range(NT)))


def size_trends(spark: SparkSession, d: str) -> DataFrame:
    """Persistent, expanding and contracting tracks with their fold change."""
    return L.size_trends(L.tracked(_tracks(spark, d), ["cohort"]), ["cohort"], NT)


def mutation_gain(spark: SparkSession, d: str) -> DataFrame:
    return L.mutation_gain(L.tracked(_tracks(spark, d), ["cohort"]), ["cohort"])


def track_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return L.frequencies(_tracks(spark, d), ["cohort"])


def clone_status(spark: SparkSession, d: str) -> DataFrame:
    """Status of every track by its frequencies."""
    return L.status(L.frequencies(_tracks(spark, d), ["cohort"]), ["cohort"], NT)


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return L.status_counts(clone_status(spark, d), ["cohort"])


def diversity_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Shannon entropy over time for cohorts with two timepoints or more."""
    s = seqs(spark, d)
    return L.trajectories(s, ["cohort"], D.diversity(s, CT)).select(*CT, "shannon", "clones")


def dashboard(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each cohort and timepoint with a column per V family and class."""
    from vdjlake.sinks import tables as K

    s = seqs(spark, d)
    return K.dashboard(D.bundle(s, CT), U.family_usage(s, CT), U.isotype_usage(s, CT), CT)


def clone_ids_by_timepoint(spark: SparkSession, d: str) -> DataFrame:
    t = L.clone_ids_by_timepoint(_tracks(spark, d), ["cohort"])
    return t.select("cohort", "track", "timepoint", F.array_join(F.transform("clones", lambda x: x.cast("string")), "|").alias("clones"))


QUERIES = {
    f.__name__: f
    for f in (
        clone_sizes, diversity_by_timepoint, diversity_bundle, mutation_stats, rank_abundance, with_clone_size, pooled_metrics, dashboard_summary, v_family_usage, top_v_families,
        isotype_usage, isotype_counts, isotype_tiles, label_scores, public_clones, exact_public, public_stats, public_ids, repertoire_totals, clone_heatmap, shared_pairs,
        set_intersections, bipartite, clone_buckets, tracked_sizes, size_trends, mutation_gain, track_frequencies, clone_status, status_counts, diversity_trajectory, clone_ids_by_timepoint, dashboard,
    )
}


def _div(group: str, null_clone: str = "coalesce(clone_id, -1)", where: str = "true", name: str = "") -> str:
    """CTEs z (sizes), r (ranked) and m (metrics) per group."""
    return f"""
z{name} AS (SELECT {group}, {null_clone} AS clone, count(*) AS n FROM s WHERE {where} GROUP BY ALL),
r{name} AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n, clone) AS up, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, clone) AS down,
  sum(n) OVER (PARTITION BY {group}) AS t, sum(n) OVER (PARTITION BY {group} ORDER BY n DESC, clone ROWS UNBOUNDED PRECEDING) AS cum FROM z{name}),
m{name} AS (SELECT {group}, CAST(max(t) AS BIGINT) AS total, count(*) AS clones, max(t) / CAST(count(*) AS DOUBLE) AS mean_clone_size, -sum(n / t * ln(n / t)) + 0.0 AS shannon, 1 - sum((n / t) * (n / t)) AS simpson,
  count(*) FILTER (WHERE cum - n < t / 2.0) AS d50,
  CAST(CASE WHEN count(*) FILTER (WHERE n = 2) = 0 THEN count(*) + count(*) FILTER (WHERE n = 1) * (count(*) FILTER (WHERE n = 1) - 1) / 2.0
       ELSE count(*) + count(*) FILTER (WHERE n = 1) * count(*) FILTER (WHERE n = 1) / (2.0 * count(*) FILTER (WHERE n = 2)) END AS DOUBLE) AS chao1,
  CASE WHEN count(*) > 1 THEN 2 * sum(up * n) / (count(*) * CAST(max(t) AS DOUBLE)) - (count(*) + 1) / CAST(count(*) AS DOUBLE) ELSE 0.0 END AS gini,
  coalesce(sum(n) FILTER (WHERE n >= 2), 0) / CAST(max(t) AS DOUBLE) AS expanded, sum(n) FILTER (WHERE down <= 1) / CAST(max(t) AS DOUBLE) AS top1, sum(n) FILTER (WHERE down <= 10) / CAST(max(t) AS DOUBLE) AS top10
  FROM r{name} GROUP BY {group})"""


_MUT = "coalesce(avg(shm), 0.0) AS mean_shm, coalesce(CAST(median(shm) AS DOUBLE), 0.0) AS median_shm, avg(CAST(coalesce(productive, true) AS INT)) * 100 AS productive_percent"
_PC = "pc AS (SELECT cohort, clone_id, patient, count(*) AS n, min(sequence_id) AS rep FROM s WHERE cohort IS NOT NULL AND clone_id IS NOT NULL AND patient IS NOT NULL GROUP BY ALL)"
_TR = f"""t AS (SELECT *, {ORD} AS ord, coalesce('L' || lineage_id, 'C' || clone_id) AS track FROM s WHERE coalesce(lineage_id, clone_id) IS NOT NULL),
tp AS (SELECT cohort, track, ord, count(*) AS size, coalesce(avg(shm), 0.0) AS mean_shm FROM t WHERE ord IS NOT NULL GROUP BY ALL)"""
_FR = f"""{_TR}, f AS (SELECT cohort, track, ord, size, size / CAST(sum(size) OVER (PARTITION BY cohort, ord) AS DOUBLE) AS frequency FROM tp)"""
_ST = f"""{_FR}, a AS (SELECT cohort, track, count(*) AS present, min(ord) AS first_ord, max(ord) AS last_ord, arg_min(frequency, ord) AS first_frequency, arg_max(frequency, ord) AS last_frequency, CAST(sum(size) AS BIGINT) AS rows FROM f GROUP BY ALL),
st AS (SELECT *, CASE WHEN present = {NT} THEN CASE WHEN last_frequency > 1.5 * first_frequency THEN 'expanding' WHEN last_frequency < 0.67 * first_frequency THEN 'contracting' ELSE 'persistent' END
  WHEN first_ord > 0 THEN 'late_emerging' WHEN last_ord < {NT - 1} THEN 'disappeared' ELSE 'transient' END AS status FROM a)"""

SQL = {
    "clone_sizes": f"WITH {S} SELECT cohort, coalesce(clone_id, -1) AS clone, count(*) AS size FROM s GROUP BY ALL",
    "diversity_by_timepoint": f"WITH {S}, {_div('cohort, timepoint')} SELECT * FROM m",
    "diversity_bundle": f"WITH {S}, {_div('sample_file', 'clone_id', 'clone_id IS NOT NULL')}, u AS (SELECT sample_file, {_MUT} FROM s GROUP BY ALL) SELECT * FROM m JOIN u USING (sample_file)",
    "mutation_stats": f"WITH {S} SELECT cohort, timepoint, {_MUT} FROM s GROUP BY ALL",
    "rank_abundance": f"WITH {S}, {_div('cohort, timepoint')} SELECT cohort, timepoint, clone, n AS size, CAST(down AS INT) AS rank FROM r WHERE down <= 30",
    "with_clone_size": f"WITH {S} SELECT sequence_id, CASE WHEN clone_id IS NULL OR cohort IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY cohort, clone_id) END AS clone_size FROM s",
    "pooled_metrics": f"WITH {S}, {_div('cohort, sample_file')} SELECT cohort, CAST(sum(total) AS BIGINT) AS total, CAST(sum(clones) AS BIGINT) AS clones, sum(chao1) AS chao1, avg(shannon) AS shannon, avg(simpson) AS simpson, avg(gini) AS gini, CAST(floor(avg(d50) + 0.5) AS BIGINT) AS d50 FROM m GROUP BY cohort",
    "dashboard_summary": f"WITH {S}, {_div('cohort')}, u AS (SELECT cohort, {_MUT} FROM s GROUP BY ALL) SELECT CAST(sum(total) AS BIGINT) AS total, CAST(sum(clones) AS BIGINT) AS clones, avg(shannon) AS shannon, avg(mean_shm) AS mean_shm FROM m JOIN u USING (cohort)",
    "v_family_usage": f"WITH {S}, f AS (SELECT cohort, timepoint, {V_FAMILY.format('v')} AS family FROM s) SELECT cohort, timepoint, family, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY cohort, timepoint) AS DOUBLE) AS frequency FROM f WHERE family IS NOT NULL GROUP BY cohort, timepoint, family",
    "top_v_families": f"WITH {S}, f AS (SELECT cohort, timepoint, {V_FAMILY.format('v')} AS family FROM s), u AS (SELECT cohort, timepoint, family, count(*) / CAST(sum(count(*)) OVER (PARTITION BY cohort, timepoint) AS DOUBLE) AS fr FROM f WHERE family IS NOT NULL GROUP BY cohort, timepoint, family) SELECT family, sum(fr) AS frequency FROM u GROUP BY family ORDER BY frequency DESC, family LIMIT 5",
    "isotype_usage": f"""WITH {S}, c AS (SELECT cohort, timepoint, {IG_CLASS.format('c_call')} AS class FROM s WHERE v IS NULL OR v NOT LIKE 'IGK%' AND v NOT LIKE 'IGL%'),
n AS (SELECT cohort, timepoint, class, count(*) AS n FROM c WHERE class IS NOT NULL GROUP BY ALL),
g AS (SELECT cohort, timepoint, class FROM (SELECT DISTINCT cohort, timepoint FROM n) x, (SELECT unnest(['IgM', 'IgD', 'IgG', 'IgA', 'IgE']) AS class) y)
SELECT cohort, timepoint, class, coalesce(n, 0) AS n, coalesce(n, 0) / CAST(sum(n) OVER (PARTITION BY cohort, timepoint) AS DOUBLE) AS frequency FROM g LEFT JOIN n USING (cohort, timepoint, class)""",
    "isotype_counts": f"WITH {S} SELECT split_part(c_call, '*', 1) AS c_gene, count(*) AS n FROM s WHERE c_call IS NOT NULL GROUP BY ALL",
    "isotype_tiles": f"""WITH {S}, c AS (SELECT *, {IG_CLASS.format('c_call')} AS class FROM s WHERE clone_id IS NOT NULL),
k AS (SELECT cohort, clone_id, timepoint, class, count(*) AS k FROM c WHERE class IS NOT NULL GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY cohort, clone_id, timepoint ORDER BY k DESC, list_position(['IgM', 'IgD', 'IgG', 'IgA', 'IgE'], class)) AS r FROM k),
a AS (SELECT cohort, clone_id, timepoint, count(*) AS n, coalesce(avg(shm), 0.0) AS mean_shm, count(DISTINCT patient) AS patients FROM c GROUP BY ALL)
SELECT a.*, b.class AS dominant, b.k AS dominant_n FROM a LEFT JOIN b ON b.r = 1 AND a.cohort = b.cohort AND a.clone_id = b.clone_id AND a.timepoint = b.timepoint""",
    "label_scores": "SELECT event_type, least(200.0, sum(value / 100 * 0.5)) AS score, count(DISTINCT user_id) AS items, arg_max(user_id, (value, user_id)) AS best FROM events GROUP BY event_type ORDER BY score DESC, event_type LIMIT 8",
    "public_clones": f"""WITH {S}, {_PC}, d AS (SELECT cohort, clone_id, count(DISTINCT cdr3) AS cdr3s FROM s WHERE patient IS NOT NULL GROUP BY ALL)
SELECT pc.cohort, pc.clone_id, count(*) AS patients, CAST(sum(n) AS BIGINT) AS rows, string_agg(patient, '|' ORDER BY patient) AS patient_set, any_value(d.cdr3s) AS cdr3s, min(rep) AS representative FROM pc JOIN d USING (cohort, clone_id) GROUP BY 1, 2 HAVING count(*) >= 2""",
    "exact_public": f"WITH {S} SELECT cdr3, v, j, count(DISTINCT cohort) AS patients, count(*) AS rows FROM s WHERE cdr3 IS NOT NULL AND v IS NOT NULL AND j IS NOT NULL AND cohort IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT cohort) >= 2",
    "public_stats": f"""WITH {S}, x AS (SELECT cohort, clone_id, concat_ws('/', cohort, patient) AS p FROM s WHERE cohort IS NOT NULL AND clone_id IS NOT NULL),
k AS (SELECT cohort, clone_id, count(DISTINCT p) AS n FROM x GROUP BY ALL HAVING count(DISTINCT p) >= 2)
SELECT (SELECT count(*) FROM k) AS clones, (SELECT max(n) FROM k) AS most_shared, (SELECT count(DISTINCT p) FROM x JOIN k USING (cohort, clone_id)) AS patients""",
    "public_ids": f"""WITH {S}, ok AS (SELECT timepoint FROM s WHERE sample_file IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sample_file) >= 2)
SELECT DISTINCT cohort, clone_id FROM (SELECT cohort, clone_id, timepoint FROM s WHERE cohort IS NOT NULL AND clone_id IS NOT NULL AND patient IS NOT NULL GROUP BY 1, 2, 3 HAVING count(DISTINCT patient) >= 2) x JOIN ok USING (timepoint)""",
    "repertoire_totals": f"WITH {S} SELECT cohort, patient, count(*) AS total FROM s WHERE clone_id IS NOT NULL GROUP BY ALL",
    "clone_heatmap": f"""WITH {S}, {_PC}, pub AS (SELECT cohort, clone_id FROM pc GROUP BY ALL HAVING count(*) >= 2), tot AS (SELECT cohort, patient, sum(n) AS total FROM pc GROUP BY ALL)
SELECT pub.cohort, pub.clone_id, tot.patient, CAST(coalesce(n, 0) > 0 AS INT) AS present, coalesce(n, 0) AS n, coalesce(n, 0) / CAST(total AS DOUBLE) * 100 AS percent
FROM pub JOIN tot USING (cohort) LEFT JOIN pc ON pc.cohort = pub.cohort AND pc.clone_id = pub.clone_id AND pc.patient = tot.patient""",
    "shared_pairs": f"WITH {S}, {_PC} SELECT a.cohort, a.patient AS p1, b.patient AS p2, count(*) AS shared FROM pc a JOIN pc b ON a.cohort = b.cohort AND a.clone_id = b.clone_id AND a.patient < b.patient GROUP BY 1, 2, 3",
    "set_intersections": f"WITH {S}, {_PC}, z AS (SELECT cohort, clone_id, string_agg(patient, '|' ORDER BY patient) AS patients FROM pc GROUP BY 1, 2) SELECT cohort, patients, count(*) AS clones FROM z GROUP BY 1, 2",
    "bipartite": f"WITH {S}, {_PC}, l AS (SELECT cohort, clone_id FROM pc GROUP BY 1, 2 ORDER BY sum(n) DESC, cohort, clone_id LIMIT 50) SELECT cohort, clone_id, patient, n FROM pc JOIN l USING (cohort, clone_id)",
    "clone_buckets": f"WITH {S}, z AS (SELECT cohort, clone_id, count(*) AS n FROM s GROUP BY ALL) SELECT cohort, CASE WHEN clone_id IS NULL THEN NULL WHEN n >= 2 THEN clone_id ELSE -1 END AS bucket, CAST(sum(n) AS BIGINT) AS rows FROM z GROUP BY 1, 2",
    "tracked_sizes": f"WITH {S}, {_TR} SELECT k.cohort, k.track, o.ord, coalesce(tp.size, 0) AS size FROM (SELECT DISTINCT cohort, track FROM tp) k CROSS JOIN (SELECT CAST(unnest(range({NT})) AS INT) AS ord) o LEFT JOIN tp ON tp.cohort = k.cohort AND tp.track = k.track AND tp.ord = o.ord",
    "size_trends": f"""WITH {S}, {_TR}, a AS (SELECT cohort, track, CAST(count(*) AS INT) AS present, arg_min(size, ord) AS first_size, arg_max(size, ord) AS last_size FROM tp GROUP BY ALL)
SELECT cohort, track, present, present = {NT} AS persistent, present >= 2 AND last_size > first_size AS expanding, present >= 2 AND last_size < first_size AS contracting, first_size, last_size, last_size / CAST(first_size AS DOUBLE) AS fold_change FROM a""",
    "mutation_gain": f"WITH {S}, {_TR} SELECT cohort, track, arg_max(mean_shm, ord) - arg_min(mean_shm, ord) AS delta_shm FROM tp WHERE mean_shm > 0 GROUP BY cohort, track HAVING count(*) >= 2",
    "track_frequencies": f"WITH {S}, {_FR} SELECT * FROM f",
    "clone_status": f"WITH {S}, {_ST} SELECT * FROM st",
    "status_counts": f"WITH {S}, {_ST} SELECT cohort, status, count(*) AS tracks, CAST(sum(rows) AS BIGINT) AS rows FROM st GROUP BY 1, 2",
    "diversity_trajectory": f"WITH {S}, {_div('cohort, timepoint')} SELECT cohort, timepoint, shannon, clones FROM m WHERE cohort IN (SELECT cohort FROM s GROUP BY 1 HAVING count(DISTINCT timepoint) >= 2)",
    "clone_ids_by_timepoint": f"WITH {S}, {_TR}, u AS (SELECT DISTINCT cohort, track, timepoint, clone_id FROM t WHERE clone_id IS NOT NULL) SELECT cohort, track, timepoint, string_agg(CAST(clone_id AS VARCHAR), '|' ORDER BY clone_id) AS clones FROM u GROUP BY 1, 2, 3",
}
