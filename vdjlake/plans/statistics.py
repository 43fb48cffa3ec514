"""Queries of rank-sum tests, false-discovery control and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjlake.operators import diversity as D
from vdjlake.operators import stats as T
from vdjlake.operators import usage as U
from vdjlake.plans.base import IG_CLASS, S, seqs
from vdjlake.plans.repertoire import _MUT, _div
from vdjlake.functions import sequence as X
from vdjlake.session import read

METRICS = ["shannon", "simpson", "gini", "expanded", "top10"]


def midranks(spark: SparkSession, d: str) -> DataFrame:
    """Average rank of every sequence's mutation count within its cohort."""
    return T.midranks(seqs(spark, d).where("shm is not null").select("sequence_id", "cohort", "shm"), ["cohort"], "shm").select("sequence_id", "rank")


def rank_sum_orders(spark: SparkSession, d: str) -> DataFrame:
    """Rank-sum test of order totals, urgent against not specified, per order status."""
    o = read(spark, d, "orders").select("o_orderstatus", F.when(F.col("o_orderpriority").startswith("1"), 1).when(F.col("o_orderpriority").startswith("4"), 2).alias("side"), "o_totalprice")
    return T.rank_sum(o, ["o_orderstatus"], "side", "o_totalprice")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    m = D.diversity(seqs(spark, d), ["cohort", "sample_file"])
    return T.long_metrics(m, ["cohort", "sample_file"], METRICS)


def sample_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of each sample file, one row per metric."""
    return _samples(spark, d)


def cohort_tests(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of cohorts by each metric over their samples, q-values per metric."""
    t = T.compare_groups(_samples(spark, d), "cohort", ["metric"])
    q = T.fdr(t, ["metric"])
    return q.select("metric", "cohort_1", "cohort_2", "n1", "n2", "valid", "u", "r", "p", "q", X.stars("p").alias("stars"), X.p_text("p").alias("p_text"))


def statistics_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The statistics block of the per-sample report: two pools, diversity and isotypes."""
    from vdjlake.sinks import tables as K

    div = T.compare_groups(_samples(spark, d), "cohort", ["metric"]).withColumn("pool", F.lit("diversity"))
    u = U.isotype_usage(seqs(spark, d), ["cohort", "sample_file"]).select("cohort", F.col("class").alias("metric"), F.col("frequency").alias("value"))
    iso = T.compare_groups(u, "cohort", ["metric"]).withColumn("pool", F.lit("isotype"))
    return K.sample_sheets(_samples(spark, d), T.fdr(div.unionByName(iso), ["pool"]))["Statistics"]


def isotype_tests(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of cohorts by each class's frequency over their samples, one pool of q-values."""
    u = U.isotype_usage(seqs(spark, d), ["cohort", "sample_file"]).select("cohort", F.col("class").alias("metric"), F.col("frequency").alias("value"))
    return T.fdr(T.compare_groups(u, "cohort", ["metric"]), []).select("metric", "cohort_1", "cohort_2", "n1", "n2", "valid", "u", "p", "q")


#: Metrics that cohorts are compared by at every timepoint, and those whose course over time is.
COMPARED = ["shannon", "simpson", "chao1", "mean_shm", "gini", "expanded", "top1", "top10"]
COURSE = ["shannon", "simpson", "chao1", "gini", "mean_shm"]
SAMPLE = ["cohort", "timepoint", "sample_file", "patient"]


def _by_timepoint(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    """Metrics of each sample (file and mouse) at each timepoint, to nine digits, so that equal values tie."""
    m = D.bundle(seqs(spark, d).where("cohort is not null and timepoint is not null and sample_file is not null and patient is not null"), SAMPLE)
    return T.long_metrics(m, SAMPLE, names).withColumn("value", F.round("value", 9))


def timepoint_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Rank sums of every pair of cohorts at each timepoint by eight metrics."""
    return T.compare_groups(_by_timepoint(spark, d, COMPARED), "cohort", ["timepoint", "metric"]).drop("p", "r_abs")


def timepoint_tests(spark: SparkSession, d: str) -> DataFrame:
    """The tests of :func:`timepoint_ranks`, q-values in a pool for each metric."""
    return T.fdr(T.compare_groups(_by_timepoint(spark, d, COMPARED), "cohort", ["timepoint", "metric"]), ["metric"])


def two_cohort_tests(spark: SparkSession, d: str) -> DataFrame:
    """Two cohorts at each timepoint by eight metrics, all q-values in one pool."""
    long = _by_timepoint(spark, d, COMPARED).where(F.col("cohort").isin("prime_boost", "saline_ctrl"))
    return T.fdr(T.compare_groups(long, "cohort", ["timepoint", "metric"]), [])


def isotype_timepoint_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Rank sums of every pair of cohorts at each timepoint by the frequency of five classes, zeros included."""
    return _isotypes(spark, d).drop("p", "r_abs")


def _isotypes(spark: SparkSession, d: str) -> DataFrame:
    s = seqs(spark, d).where("cohort is not null and timepoint is not null and sample_file is not null and patient is not null")
    u = U.isotype_usage(s, SAMPLE).select("cohort", "timepoint", F.col("class").alias("metric"), F.round("frequency", 9).alias("value"))
    return T.compare_groups(u, "cohort", ["timepoint", "metric"])


def isotype_timepoint_tests(spark: SparkSession, d: str) -> DataFrame:
    """The tests of :func:`isotype_timepoint_ranks`, q-values in one pool of their own."""
    return T.fdr(_isotypes(spark, d), [])


def trajectory_tests(spark: SparkSession, d: str) -> DataFrame:
    """Cohorts against each other along the course of five metrics, one pool of q-values for all timepoints."""
    return T.fdr(T.compare_groups(_by_timepoint(spark, d, COURSE), "cohort", ["timepoint", "metric"]), [])


def adjusted_p(spark: SparkSession, d: str) -> DataFrame:
    """Step-up adjustment of p-like values: order discounts by return flag."""
    l = read(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.avg("l_discount"), 6).alias("p"))
    return T.fdr(l, ["l_returnflag"])


def mean_sem(spark: SparkSession, d: str) -> DataFrame:
    return T.mean_sem(seqs(spark, d), ["cohort", "timepoint"], "shm")


def box_stats(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles, whiskers and robust range of mutations per cohort."""
    return T.box(seqs(spark, d), ["cohort"], "shm")


QUERIES = {f.__name__: f for f in (midranks, rank_sum_orders, sample_metrics, cohort_tests, statistics_sheet, isotype_tests, timepoint_ranks, timepoint_tests, two_cohort_tests, isotype_timepoint_ranks, isotype_timepoint_tests, trajectory_tests, adjusted_p, mean_sem, box_stats)}

_CDF = "(CASE WHEN {z} < -8 THEN 0.0 WHEN {z} > 8 THEN 1.0 WHEN {z} >= 0 THEN 0.5 * (1 + {e}) ELSE 0.5 * (1 - {e}) END)"
_T = "(1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)))"
_ERF = f"(1 - (((((1.061405429 * {_T} - 1.453152027) * {_T}) + 1.421413741) * {_T} - 0.284496736) * {_T} + 0.254829592) * {_T} * exp(-z * z / 2))"

_AT = "cohort, timepoint, sample_file, patient"
_KNOWN = "cohort IS NOT NULL AND timepoint IS NOT NULL AND sample_file IS NOT NULL AND patient IS NOT NULL"


def _ranked(values: str) -> str:
    """Rank sums of every pair of cohorts per timepoint and metric, from rows (cohort, timepoint, metric, value)."""
    return f"""v AS ({values}),
o AS (SELECT DISTINCT cohort FROM v), pr AS (SELECT a.cohort AS cohort_1, b.cohort AS cohort_2 FROM o a JOIN o b ON a.cohort < b.cohort),
e AS (SELECT timepoint, metric, cohort_1, cohort_2, value, CASE WHEN cohort = cohort_1 THEN 1 ELSE 2 END AS side FROM v JOIN pr ON v.cohort = cohort_1 OR v.cohort = cohort_2 WHERE value IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY timepoint, metric, cohort_1, cohort_2 ORDER BY value) + (count(*) OVER (PARTITION BY timepoint, metric, cohort_1, cohort_2, value) - 1) / 2.0 AS rk FROM e),
a AS (SELECT timepoint, metric, cohort_1, cohort_2, coalesce(sum(rk) FILTER (WHERE side = 1), 0) AS r1, count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2 FROM k GROUP BY 1, 2, 3, 4),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u1, n1 >= 3 AND n2 >= 3 AS valid FROM a)
SELECT timepoint, metric, cohort_1, cohort_2, n1, n2, valid, CASE WHEN valid THEN least(u1, n1 * n2 - u1) END AS u, CASE WHEN valid THEN 2 * u1 / (n1 * n2) - 1 END AS r FROM u"""


_METRICS = "SELECT cohort, timepoint, metric, round(value, 9) AS value FROM (SELECT m.cohort, m.timepoint, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in COMPARED) + f" FROM m JOIN mu ON {' AND '.join(f'm.{c.strip()} = mu.{c.strip()}' for c in _AT.split(','))}) x UNPIVOT (value FOR metric IN ({', '.join(COMPARED)}))"
_CLASSES = f"""SELECT cohort, timepoint, class AS metric, round(coalesce(n, 0) / CAST(sum(n) OVER (PARTITION BY {_AT}) AS DOUBLE), 9) AS value FROM g LEFT JOIN n USING ({_AT}, class)"""

SQL = {
    "sample_metrics": f"WITH {S}, {_div('cohort, sample_file')} SELECT cohort, sample_file, metric, value FROM (SELECT cohort, sample_file, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in METRICS)} FROM m) x UNPIVOT (value FOR metric IN ({', '.join(METRICS)}))",
    "timepoint_ranks": f"WITH {S.replace('FROM sequences WHERE', 'FROM sequences WHERE cohort_name IS NOT NULL AND timepoint IS NOT NULL AND sample_file IS NOT NULL AND sample_name IS NOT NULL AND')}, {_div(_AT)}, mu AS (SELECT {_AT}, {_MUT} FROM s GROUP BY ALL), {_ranked(_METRICS)}",
    "isotype_timepoint_ranks": f"""WITH {S}, c AS (SELECT {_AT}, {IG_CLASS.format('c_call')} AS class FROM s WHERE {_KNOWN} AND (v IS NULL OR v NOT LIKE 'IGK%' AND v NOT LIKE 'IGL%')),
n AS (SELECT {_AT}, class, count(*) AS n FROM c WHERE class IS NOT NULL GROUP BY ALL),
g AS (SELECT {_AT}, class FROM (SELECT DISTINCT {_AT} FROM n) x, (SELECT unnest(['IgM', 'IgD', 'IgG', 'IgA', 'IgE']) AS class) y), {_ranked(_CLASSES)}""",
    "midranks": f"WITH {S} SELECT sequence_id, rank() OVER (PARTITION BY cohort ORDER BY shm) + (count(*) OVER (PARTITION BY cohort, shm) - 1) / 2.0 AS rank FROM s WHERE shm IS NOT NULL AND cohort IS NOT NULL",
    "rank_sum_orders": f"""WITH o AS (SELECT o_orderstatus, o_totalprice, CASE left(o_orderpriority, 1) WHEN '1' THEN 1 WHEN '4' THEN 2 END AS side FROM orders),
k AS (SELECT *, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0 AS rk FROM o WHERE side IS NOT NULL),
a AS (SELECT o_orderstatus, sum(rk) FILTER (WHERE side = 1) AS r1, count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2 FROM k GROUP BY 1),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u1 FROM a), w AS (SELECT *, least(u1, n1 * n2 - u1) AS uu FROM u),
y AS (SELECT *, greatest((abs(uu - n1 * n2 / 2.0) - 0.5) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0), 0.0) AS z FROM w)
SELECT o_orderstatus, n1, n2, true AS valid, uu AS u, 1 - 2 * uu / (n1 * n2) AS r_abs, 2 * u1 / (n1 * n2) - 1 AS r, least(1.0, 2 * (1 - {_CDF.format(z='z', e=_ERF)})) AS p FROM y""",
    "adjusted_p": """WITH l AS (SELECT l_returnflag, l_suppkey, round(avg(l_discount), 6) AS p FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, p * count(*) OVER (PARTITION BY l_returnflag) / row_number() OVER (PARTITION BY l_returnflag ORDER BY p) AS raw, row_number() OVER (PARTITION BY l_returnflag ORDER BY p) AS k FROM l),
m AS (SELECT *, least(1.0, min(raw) OVER (PARTITION BY l_returnflag ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q0 FROM r)
SELECT l_returnflag, l_suppkey, p, min(q0) OVER (PARTITION BY l_returnflag, p) AS q FROM m""",
    "mean_sem": f"WITH {S} SELECT cohort, timepoint, count(shm) AS n, avg(shm) AS mean, coalesce(stddev_samp(shm) / sqrt(count(shm)), 0.0) AS sem FROM s WHERE shm IS NOT NULL GROUP BY ALL",
    "box_stats": f"""WITH {S}, b AS (SELECT cohort, count(*) AS n, CAST(min(shm) AS DOUBLE) AS lo, CAST(max(shm) AS DOUBLE) AS hi, quantile_cont(shm, 0.25) AS q1, quantile_cont(shm, 0.5) AS median, quantile_cont(shm, 0.75) AS q3 FROM s WHERE shm IS NOT NULL GROUP BY 1)
SELECT cohort, n, q1, median, q3, greatest(lo, q1 - 1.5 * (q3 - q1)) AS low_whisker, least(hi, q3 + 1.5 * (q3 - q1)) AS high_whisker, greatest(lo, q1 - 2 * (q3 - q1)) AS range_low, least(hi, q3 + 2 * (q3 - q1)) AS range_high FROM b""",
}
