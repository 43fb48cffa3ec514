"""Layout of an input folder: paired 10x files, a flat list, or a folder per timepoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vdjlake.session import _fs

# fixed values: endings of a contig file and its annotation file
TENX = ("_filtered_contig.fasta", "_filtered_annotations.csv")
ENDINGS = (".fasta", ".fa")


def detect(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """(kind, ``filename, timepoint, annotation_file``): kind is 10x, flat, folders or empty."""
    fs, p = _fs(spark, folder)
    here, rows = [], []
    for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().getName()):
        name = s.getPath().getName()
        if name.startswith("."):
            continue
        if s.isDirectory():
            rows += [(f"{name}/{f.getPath().getName()}", name, None) for f in fs.listStatus(s.getPath()) if f.isFile() and not f.getPath().getName().startswith(".") and f.getPath().getName().lower().endswith(ENDINGS)]
        else:
            here.append(name)
    schema = "filename string, timepoint string, annotation_file string"
    pairs = [(n, None, n[: -len(TENX[0])] + TENX[1]) for n in here if n.endswith(TENX[0]) and n[: -len(TENX[0])] + TENX[1] in here]
    flat = [(n, None, None) for n in here if n.lower().endswith(ENDINGS)]
    kind, out = ("10x", pairs) if pairs else ("flat", flat) if flat else ("folders", sorted(rows)) if rows else ("empty", [])
    return kind, spark.createDataFrame(out, schema)
