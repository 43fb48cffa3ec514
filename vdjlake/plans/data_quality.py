"""Queries of the core data problems: heavy keys (p2) and orphan references (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjlake.functions import clean
from vdjlake.operators import heavy_keys, orphans
from vdjlake.session import read

CLONE = ["cohort_name", "clone_id"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clones holding at least 1 % of all distinct ids that carry a clone_id."""
    return heavy_keys.dominant_keys(read(spark, sf_dir, "sequences"), CLONE, "id", 0.01).select(*CLONE)


def p2_clone_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids of every clone."""
    return heavy_keys.salted_distinct(read(spark, sf_dir, "sequences"), CLONE, "id").withColumnRenamed("items", "ids")


def p2_clone_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clone over distinct ids: size, mean, least and greatest mutation count (not negative)."""
    s = read(spark, sf_dir, "sequences").select("id", *CLONE, F.when(F.col("somatic_mutations") >= 0, F.col("somatic_mutations")).alias("shm"))
    out = heavy_keys.salted_profile(s, CLONE, "id", "shm")
    return out.select(*CLONE, F.col("items").alias("ids"), F.col("total").alias("shm_total"), F.col("least").alias("shm_least"), F.col("greatest").alias("shm_greatest"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = {t: (read(spark, sf_dir, t), clean.record_id("sequence_id"), "run_at") for t in ("db_fail", "clone_pass")}
    return orphans.orphans(refs, read(spark, sf_dir, "sequences"), "id", "loaded_at", "deleted_at")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references to sequences.id per table, month and kind."""
    return _orphans(spark, sf_dir).withColumnRenamed("key", "sequence_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of orphan references per table, month and kind."""
    return orphans.orphan_report(_orphans(spark, sf_dir))


_REFS = """
refs AS (
  SELECT ref_table, run_at, CASE WHEN starts_with(t, 'reversed|') THEN trim(substr(t, 10)) ELSE t END AS sequence_id
  FROM (SELECT 'db_fail' AS ref_table, run_at, trim(sequence_id) AS t FROM db_fail
        UNION ALL SELECT 'clone_pass', run_at, trim(sequence_id) FROM clone_pass) x
), par AS (
  SELECT id, min(CASE WHEN deleted_at IS NULL THEN loaded_at END) AS live FROM sequences GROUP BY id
), found AS (
  SELECT DISTINCT ref_table, strftime(run_at, '%Y-%m') AS run_month, sequence_id,
    CASE WHEN par.id IS NULL THEN 'missing' WHEN live IS NULL THEN 'deleted' ELSE 'late' END AS kind
  FROM refs LEFT JOIN par ON par.id = refs.sequence_id
  WHERE sequence_id <> '' AND (par.id IS NULL OR live IS NULL OR live > run_at)
)"""

QUERIES = {"p2_found": p2_found, "p2_clone_sizes": p2_clone_sizes, "p2_clone_mutations": p2_clone_mutations, "p6_found": p6_found, "p6_report": p6_report}

SQL = {
    "p2_found": """
SELECT cohort_name, clone_id FROM sequences WHERE clone_id IS NOT NULL AND cohort_name IS NOT NULL
GROUP BY cohort_name, clone_id
HAVING count(DISTINCT id) >= 0.01 * (SELECT count(DISTINCT id) FROM sequences WHERE clone_id IS NOT NULL AND cohort_name IS NOT NULL)""",
    "p2_clone_sizes": """
SELECT cohort_name, clone_id, count(DISTINCT id) AS ids FROM sequences
WHERE clone_id IS NOT NULL AND cohort_name IS NOT NULL AND id IS NOT NULL GROUP BY cohort_name, clone_id""",
    "p2_clone_mutations": """
SELECT cohort_name, clone_id, count(*) AS ids, CAST(sum(m) AS DOUBLE) AS shm_total, CAST(min(m) AS DOUBLE) AS shm_least, CAST(max(m) AS DOUBLE) AS shm_greatest
FROM (SELECT cohort_name, clone_id, id, min(CASE WHEN somatic_mutations >= 0 THEN somatic_mutations END) AS m FROM sequences
      WHERE clone_id IS NOT NULL AND cohort_name IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2, 3) x
GROUP BY cohort_name, clone_id""",
    "p6_found": f"WITH {_REFS} SELECT * FROM found",
    "p6_report": f"WITH {_REFS} SELECT ref_table, run_month, kind, count(*) AS orphans FROM found GROUP BY 1, 2, 3",
}
