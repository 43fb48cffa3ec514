"""FASTA files as DataFrames, without loading a file into one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjlake.session import _fs

# fixed values: header forms of the two mouse constant-gene spellings
_MOUSE_C = (r"^IG[HKL]C", r"^IGH[ADEGM]")


def list_files(spark: SparkSession, folder: str, endings: tuple[str, ...] = (".fasta", ".fa")) -> list[str]:
    """Paths of the visible files of a folder with one of the endings, sorted; an error if there is none."""
    fs, p = _fs(spark, folder)
    names = [s.getPath() for s in fs.listStatus(p) if s.isFile()]
    out = sorted(str(x) for x in names if not x.getName().startswith(".") and x.getName().lower().endswith(endings))
    if not out:
        raise FileNotFoundError(f"no file ending in {', '.join(endings)} in {folder}")
    return out


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``sequence_id, header, sequence, filename, pos``: one row per record.

    Files are split at record starts, so large files are read in parallel; lines
    of a record are put together, blanks removed. Lower case is kept. ``pos`` orders
    records by file, part of the file and place in it.
    """
    if isinstance(paths, str):
        paths = list_files(spark, paths)
    raw = spark.read.option("lineSep", "\n>").text(paths)
    rec = raw.select(F.regexp_replace(F.regexp_replace("value", r"^\s*>", ""), "\r", "").alias("r"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("pos"))
    rec = rec.where(F.trim("r") != "")
    head = F.substring_index("r", "\n", 1)
    body = F.when(F.instr("r", "\n") > 0, F.regexp_replace(F.substr("r", F.instr("r", "\n") + 1), r"\s", "")).otherwise("")
    return rec.select(F.split(F.trim(head), r"\s")[0].alias("sequence_id"), F.trim(head).alias("header"), body.alias("sequence"), F.url_decode("filename").alias("filename"), "pos")


def sorted_by_name(df: DataFrame) -> DataFrame:
    return df.orderBy("sequence_id")


def file_ids(spark: SparkSession, names: list[str], first: int = 1001) -> DataFrame:
    """``file_id, filename``: numbers from ``first`` in the order of the names."""
    return spark.createDataFrame([(first + i, n) for i, n in enumerate(names)], "file_id long, filename string")


def combine(records: DataFrame, files: DataFrame) -> DataFrame:
    """Records with their file's number appended to the id, kept as a column as well."""
    return records.join(files, "filename").withColumn("sequence_id", F.concat_ws("_", "sequence_id", F.col("file_id").cast("string")))


def imgt_allele(header: str = "header"):
    """Field between the first two pipes of an IMGT header; before the only pipe; or the whole header."""
    parts = F.split(header, r"\|")
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(F.col(header))


def clean_imgt(records: DataFrame) -> DataFrame:
    """``allele, species, sequence, pos``: gap dots removed; :func:`first_per_allele` keeps the first record of each allele."""
    return records.select(imgt_allele().alias("allele"), F.get(F.split("header", r"\|"), F.lit(2)).alias("species"), F.replace("sequence", F.lit("."), F.lit("")).alias("sequence"), "pos")


def first_per_allele(records: DataFrame, order: str = "pos") -> DataFrame:
    """One record per allele: the first in the order of the files."""
    cols = [c for c in records.columns if c != "allele"]
    return records.groupBy("allele").agg(F.min_by(F.struct(*cols), F.col(order)).alias("r")).select("allele", "r.*")


def mouse_germline(records: DataFrame) -> DataFrame:
    """``allele, locus, segment, sequence`` of Mus musculus V, D, J and C genes, first per allele."""
    m = first_per_allele(clean_imgt(records).where(F.col("species").startswith("Mus musculus")))
    is_c = F.col("allele").rlike(_MOUSE_C[0]) | (F.col("allele").rlike(_MOUSE_C[1]) & ~F.col("allele").rlike(r"^IGHD\d"))
    seg = F.when(is_c, "C").otherwise(F.regexp_extract("allele", "^IG[HKL]([VDJ])", 1))
    return m.select("allele", F.regexp_extract("allele", "^(IG[HKL])", 1).alias("locus"), seg.alias("segment"), "sequence").where("segment <> ''")


def legacy_imgt(records: DataFrame) -> DataFrame:
    """``name, sequence``: allele field of TR and IG headers; other mouse species get a suffix; dots removed."""
    allele = imgt_allele()
    species = F.get(F.split("header", r"\|"), F.lit(2))
    suffix = F.when(species.rlike("(?i)mus spretus"), "_spretus").otherwise("")
    return records.where(allele.rlike("^(TR|IG)")).select(F.concat(allele, suffix).alias("name"), F.replace("sequence", F.lit("."), F.lit("")).alias("sequence"))


def aux_table(spark: SparkSession, path: str) -> DataFrame:
    """``allele, frame, chain, cdr3_stop, extra`` of a J-gene table; trailing fields may be absent, ``#`` lines are comments."""
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    num = lambda i: F.expr(f"try_cast(get(split(trim(value), '\\\\s+'), {i}) as int)")
    return t.select(f[0].alias("allele"), num(1).alias("frame"), F.get(f, F.lit(2)).alias("chain"), num(3).alias("cdr3_stop"), num(4).alias("extra"))
