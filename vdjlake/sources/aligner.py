"""Aligner report in the tabular form with comment lines (format 7), as rows of hits."""

from __future__ import annotations

import functools
import re
import shutil
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: columns of a hit in the order of the report
HIT_COLUMNS = (
    "chain_type", "query_id", "subject_id", "pct_identity", "align_len", "mismatches", "gap_opens", "gaps", "q_start", "q_end",
    "s_start", "s_end", "evalue", "bit_score", "query_seq", "subject_seq", "btop",
)

_SCHEMA = "query_id string, chain_type string, subject_id string, pct_identity double, align_len int, fields array<string>, pos int"


def blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``block``: the text of one query each, split at the program line, so a large report is read in parallel."""
    return spark.read.option("lineSep", "# IGBLASTN").text(path).where(F.col("value").contains("# Query:")).select(F.col("value").alias("block"))


def hits(block: DataFrame) -> DataFrame:
    """Hit rows of each block, in report order (``pos``)."""
    q = F.trim(F.regexp_extract("block", r"(?m)^# Query: *(\S+)", 1))
    lines = F.filter(F.split("block", r"\r?\n"), lambda x: x.rlike(r"^[VDJC]\t"))
    rows = block.select(q.alias("query_id"), F.posexplode(lines).alias("pos", "line")).select("query_id", "pos", F.split("line", "\t", -1).alias("f"))
    num = lambda i, t: F.expr(f"try_cast(get(f, {i}) as {t})")
    return rows.select("query_id", F.col("f")[0].alias("chain_type"), F.get("f", F.lit(2)).alias("subject_id"), num(3, "double").alias("pct_identity"), num(4, "int").alias("align_len"), F.col("f").alias("fields"), "pos")


def cdr3_rows(block: DataFrame) -> DataFrame:
    """``query_id, cdr3_dna, cdr3_aa, mutations``: sub-region details and the sixth token of the total line; nulls where absent."""
    q = F.trim(F.regexp_extract("block", r"(?m)^# Query: *(\S+)", 1))
    sub = F.regexp_extract("block", r"(?m)^CDR3\t([^\t\r\n]*)\t?([^\t\r\n]*)", 1)
    aa = F.regexp_extract("block", r"(?m)^CDR3\t([^\t\r\n]*)\t?([^\t\r\n]*)", 2)
    total = F.regexp_extract("block", r"(?m)^(Total\t[^\r\n]*)", 1)
    mut = F.expr("try_cast(get(split(__total, '\\\\t'), 5) as int)")
    return block.select(q.alias("query_id"), F.when(sub != "", sub).alias("cdr3_dna"), F.when(aa != "", aa).alias("cdr3_aa"), total.alias("__total")).withColumn("mutations", mut).drop("__total")


def read_report(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, CDR3 rows) of a report."""
    b = blocks(spark, path)
    return hits(b), cdr3_rows(b)


def _align(batches: Iterator[pa.RecordBatch], command: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fasta = "".join(f">{i}\n{s}\n" for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if s)
        out = subprocess.run(command, input=fasta, capture_output=True, text=True, check=True).stdout
        parts = ["# IGBLASTN" + p for p in re.split("# IGBLASTN", out)[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(parts, type=pa.string())], names=["block"])


def align(records: DataFrame, command: list[str]) -> DataFrame:
    """``block`` of each query, by an installed aligner reading FASTA from its standard input.

    The program is an external boundary: it must be installed on every executor.
    """
    if not shutil.which(command[0]):
        raise FileNotFoundError(f"{command[0]} is not installed")
    return records.select("sequence_id", "sequence").mapInArrow(functools.partial(_align, command=command), "block string")
