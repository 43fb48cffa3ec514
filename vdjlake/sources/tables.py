"""Delimited tables with declared columns: AIRR, 10x, sample tags, hits and antibody references."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vdjlake.functions import clean
from vdjlake.functions import sequence as X
from vdjlake.session import _fs, shared_dir, slots

# fixed values: columns that a raw AIRR rearrangement table must have
AIRR_REQUIRED = ("cell_id", "cell_type_experimental", "locus", "productive", "sequence_id", "sequence")
# fixed values: columns of an AIRR table that are numbers
AIRR_INTS = ("v_sequence_start", "j_sequence_end", "d_sequence_start", "d_sequence_end", "d_germline_start", "d_germline_end", "np2_length")
AIRR_LONGS = ("clone_id", "lineage_id")
AIRR_DOUBLES = ("dist_nearest",)
# fixed values: columns of an antibody reference by position
ANTIBODY_AT = {"antibody_name": 0, "ab_or_nb": 1, "binds_to": 2, "neutralizes": 4, "origin": 7, "vh_sequence": 8, "v_gene": 10, "j_gene": 11, "cdr3_sequence": 14}


def _header(spark: SparkSession, path: str, sep: str, comment: str | None = None) -> list[str]:
    lines = spark.read.text(path).where(F.trim("value") != "")
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    first = lines.limit(1).collect()
    return [h.strip().strip('"') for h in first[0]["value"].lstrip("﻿").rstrip("\r").split(sep)] if first else []


def read_delimited(spark: SparkSession, path: str, sep: str, required: tuple[str, ...] = (), comment: str | None = None, quote: str = '"') -> DataFrame:
    """All columns as text, by the names of the header; missing required columns are an error."""
    names = _header(spark, path, sep, comment)
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    r = spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", quote).option("escape", quote).option("enforceSchema", True)
    if comment:
        r = r.option("comment", comment)
    return r.csv(path)


def read_airr(spark: SparkSession, path: str, required: tuple[str, ...] = AIRR_REQUIRED) -> DataFrame:
    """Raw AIRR table (plain or gzip) as text columns; rows with fewer fields than the header are left out.

    Lines are split here rather than by the CSV reader, whose idea of a short
    row depends on the columns a query uses. A gzip file is one task: its rows
    are spread afterwards.
    """
    names = _header(spark, path, "\t")
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    lines = spark.read.text(path)
    if path.endswith(".gz"):
        lines = lines.repartition(slots(spark))
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    rows = lines.select(f.alias("f")).where((F.size("f") >= len(names)) & (F.concat_ws("\t", "f") != "\t".join(names)))
    return rows.select(*[F.col("f")[i].alias(n) for i, n in enumerate(names)])


def read_rearrangements(spark: SparkSession, path: str) -> DataFrame:
    """db-pass, clone-pass or germ-pass table: numbers cast where they parse, missing words are null."""
    df = read_delimited(spark, path, "\t", ("sequence_id",), quote="\u0000")
    kind = {c: "int" for c in AIRR_INTS} | {c: "long" for c in AIRR_LONGS} | {c: "double" for c in AIRR_DOUBLES}

    def col(c: str):
        if c in ("int", "long"):
            return F.col(c)
        if c in kind:
            t = f"try_cast(`{c}` as double)"
            return F.expr(t if kind[c] == "double" else f"try_cast({t} as {'int' if kind[c] == 'int' else 'bigint'})").alias(c)
        return clean.present(c).alias(c)

    return df.select(*[col(c) for c in df.columns])


def read_10x(spark: SparkSession, path: str) -> DataFrame:
    """Contig annotations; ``umis`` as a number (0 where it is none), ``c_gene`` null where missing, ``file_id`` to be added by the caller."""
    df = read_delimited(spark, path, ",", ("barcode", "contig_id", "chain"))
    df = df.withColumn("umis", F.coalesce(F.expr("try_cast(umis as int)"), F.lit(0))) if "umis" in df.columns else df
    return df.withColumn("c_gene", clean.present("c_gene")) if "c_gene" in df.columns else df


def read_sample_tags(spark: SparkSession, path: str) -> DataFrame:
    """``Cell_Index, Sample_Tag, pos``: comment and blank lines left out; pos keeps the order of the file."""
    df = read_delimited(spark, path, ",", ("Cell_Index", "Sample_Tag"), comment="#")
    return df.select(F.trim("Cell_Index").alias("Cell_Index"), F.trim("Sample_Tag").alias("Sample_Tag"), F.monotonically_increasing_id().alias("pos"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular aligner output without header: query, subject, identity, length, position."""
    df = spark.read.schema("query_id string, subject_id string, pct_identity double, align_len int").option("sep", "\t").csv(path)
    return df.withColumn("pos", F.monotonically_increasing_id())


def read_antibodies(spark: SparkSession, path: str) -> DataFrame:
    """Antibody reference by column position; ``ND`` and other missing words are ''; invalid UTF-8 is ignored."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    if len(df.columns) < 15:
        raise ValueError(f"{path} has {len(df.columns)} columns; 15 are needed")
    text = lambda i: F.coalesce(clean.present(F.replace(F.col(f"`{df.columns[i]}`"), F.lit("�"), F.lit(""))), F.lit(""))
    return df.select(*[text(i).alias(n) for n, i in ANTIBODY_AT.items()])


def default_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("sequence_id", X.default_id("sequence_id", "cell_id", "locus"))


# ---- side files


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON side file (mappings, designs) on the driver."""
    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).limit(1).collect()))


def timepoint_mapping(spark: SparkSession, mapping: dict) -> DataFrame:
    """``filename, timepoint, original_file, annotation_file, pos`` of a mapping {file: {...}}."""
    rows = [(k, v.get("timepoint"), v.get("originalFile"), v.get("annotationFile"), i) for i, (k, v) in enumerate(mapping.items())]
    return spark.createDataFrame(rows, "filename string, timepoint string, original_file string, annotation_file string, pos int")


def file_mapping(spark: SparkSession, mapping: dict) -> DataFrame:
    return spark.createDataFrame([(int(k), v) for k, v in mapping.items()], "file_id long, filename string")


def study_design(spark: SparkSession, design: dict) -> DataFrame:
    """``group_id, group_name, timepoint_id, timepoint, ord, filename`` of a nested design; one row per file."""
    rows = [
        (g.get("id"), g.get("name"), t.get("id"), t.get("label"), t.get("order"), f) for g in design.get("groups", []) for t in g.get("timepoints", []) for f in t.get("files", [])
    ] + [(None, None, None, None, None, f) for f in design.get("unassigned", [])]
    return spark.createDataFrame(rows, "group_id string, group_name string, timepoint_id string, timepoint string, ord int, filename string")


def read_bundle(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A prebuilt JSON result table (one document or one per line)."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def save_results(tables: dict[str, DataFrame], folder: str) -> None:
    """Persist result tables of a session as Parquet, one folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def restore_results(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The result tables of :func:`save_results`."""
    fs, p = _fs(spark, folder)
    return {s.getPath().getName(): spark.read.parquet(str(s.getPath())) for s in fs.listStatus(p) if s.isDirectory()}


def scratch(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/vdjlake/{name}-{uuid.uuid4().hex}"
