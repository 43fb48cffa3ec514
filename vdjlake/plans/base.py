"""Shared inputs of the queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjlake.functions import clean
from vdjlake.functions import sequence as X
from vdjlake.session import read

MISSING = "('', 'nan', 'none', 'nd')"


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live sequences, one row per id (rows of an id agree on all columns used), with clean fields."""
    s = read(spark, sf_dir, "sequences").where("deleted_at is null and id is not null").dropDuplicates(["id"])
    return s.select(
        F.col("id").alias("sequence_id"),
        F.col("cohort_name").alias("cohort"),
        "sample_file",
        F.col("sample_name").alias("patient"),
        "timepoint",
        clean.gene("v_gene").alias("v"),
        clean.gene("j_gene").alias("j"),
        clean.upper_text("cdr3_peptide").alias("cdr3"),
        clean.upper_text("aa_sequence").alias("vh"),
        F.when(F.col("somatic_mutations") >= 0, F.col("somatic_mutations")).alias("shm"),
        clean.present("c_call").alias("c_call"),
        "clone_id",
        "lineage_id",
        "productive",
    )


def gene_sql(c: str) -> str:
    return f"nullif(CASE WHEN lower(trim({c})) NOT IN {MISSING} THEN regexp_extract(upper(trim({c})), '^[^,*( ]+') END, '')"


def upper_sql(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN {MISSING} THEN upper(trim({c})) END"


#: The same as :func:`seqs`, as a CTE named s.
S = f"""s AS (
  SELECT id AS sequence_id, any_value(cohort_name) AS cohort, any_value(sample_file) AS sample_file, any_value(sample_name) AS patient, any_value(timepoint) AS timepoint,
    any_value({gene_sql('v_gene')}) AS v, any_value({gene_sql('j_gene')}) AS j, any_value({upper_sql('cdr3_peptide')}) AS cdr3, any_value({upper_sql('aa_sequence')}) AS vh,
    any_value(CASE WHEN somatic_mutations >= 0 THEN somatic_mutations END) AS shm, any_value(CASE WHEN lower(trim(c_call)) NOT IN {MISSING} THEN trim(c_call) END) AS c_call,
    any_value(clone_id) AS clone_id, any_value(lineage_id) AS lineage_id, any_value(productive) AS productive
  FROM sequences WHERE deleted_at IS NULL AND id IS NOT NULL GROUP BY id
)"""

#: fixed order of the study's timepoints
TIMEPOINTS = ("day0", "day14", "day42", "endpoint")

ORD = "CASE timepoint WHEN 'day0' THEN 0 WHEN 'day14' THEN 1 WHEN 'day42' THEN 2 WHEN 'endpoint' THEN 3 END"


def ord_of(c: str = "timepoint"):
    out = F.lit(None).cast("int")
    for i, t in enumerate(TIMEPOINTS):
        out = F.when(F.col(c) == t, F.lit(i)).otherwise(out)
    return out


V_FAMILY = "nullif(upper(regexp_extract({0}, '(?i)^(IG[HKL]V[0-9]+)', 1)), '')"
IG_CLASS = "CASE WHEN upper({0}) LIKE 'IGHM%' THEN 'IgM' WHEN upper({0}) LIKE 'IGHD%' THEN 'IgD' WHEN upper({0}) LIKE 'IGHG%' THEN 'IgG' WHEN upper({0}) LIKE 'IGHA%' THEN 'IgA' WHEN upper({0}) LIKE 'IGHE%' THEN 'IgE' END"

__all__ = ["S", "X", "seqs", "gene_sql", "upper_sql", "TIMEPOINTS", "ORD", "ord_of", "V_FAMILY", "IG_CLASS", "MISSING"]
