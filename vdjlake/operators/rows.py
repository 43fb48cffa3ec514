"""Filters, lookups, assembly and ranking of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vdjlake.functions import clean
from vdjlake.functions import sequence as X

# fixed values: tags that assign a cell to no sample, and the loci of B cells
NO_TAG = ("Multiplet", "Undetermined")
B_LOCI = ("IGH", "IGK", "IGL")


# ---- filters


def heavy(df: DataFrame, locus: str = "locus") -> DataFrame:
    """Rows of the IGH locus; all rows where the table has no such column."""
    return df.where(F.col(locus) == "IGH") if locus in df.columns else df


def quality_10x(df: DataFrame) -> DataFrame:
    """Contigs of cells, of high confidence and productive; flags are text in any case."""
    return df.where(reduce(lambda a, b: a & b, [F.upper(F.col(c)) == "TRUE" for c in ("is_cell", "high_confidence", "productive")]))


def airr_b_cells(df: DataFrame) -> DataFrame:
    """Productive B-cell rows of the Ig loci with a sequence."""
    return df.where((F.col("cell_type_experimental") == "B") & F.col("locus").isin(*B_LOCI) & clean.truth("productive") & (F.length(F.trim("sequence")) > 0))


def c_gene_hits(hits: DataFrame, identity: float = 80.0, length: int = 50) -> DataFrame:
    """First hit per query of at least ``identity`` percent over ``length`` letters."""
    ok = hits.where((F.col("pct_identity") >= identity) & (F.col("align_len") >= length))
    return ok.groupBy("query_id").agg(F.min_by("subject_id", "pos").alias("c_gene"))


def min_clone_size(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows of clones with at least ``least`` rows."""
    big = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return df.join(big, keys, "left_semi")


def consistent_germline(df: DataFrame, keys: list[str], germline: str) -> DataFrame:
    """``keys..., size``: clones whose rows name at most one germline; nulls do not count."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min(germline).alias("__a"), F.max(germline).alias("__b"))
    return g.where(F.col("__a").isNull() | (F.col("__a") == F.col("__b"))).select(*keys, "size")


def rescuable(df: DataFrame, a: str = "sequence_alignment", b: str = "germline_alignment") -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.length(a) == F.length(b)))


def valid_distance(df: DataFrame, d: str = "dist_nearest") -> DataFrame:
    return df.where(F.col(d).isNotNull() & ~F.isnan(d) & (F.col(d) > 0) & (F.col(d) <= 1))


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text, in any case, in any of the columns; all rows for a blank text."""
    q = text.strip().lower()
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(q), F.lit(False)) for c in columns])) if q else df


def tree_search(parents: DataFrame, children: DataFrame, key: str, text: str, parent_cols: list[str], child_cols: list[str]) -> DataFrame:
    """Parents that match themselves or have a matching child."""
    mine = search(parents, text, parent_cols).select(key)
    theirs = search(children, text, child_cols).select(key)
    return parents.join(mine.unionByName(theirs).distinct(), key, "left_semi")


def toggled(df: DataFrame, **allowed: list) -> DataFrame:
    """Rows whose columns have one of the allowed values; an empty list allows all."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]).isin(kv[1])) if kv[1] else d, allowed.items(), df)


def exact_set(df: DataFrame, array: str, active: list[str]) -> DataFrame:
    """Rows whose array holds exactly the active values, in any order."""
    return df.where(F.array_sort(F.array_distinct(array)) == F.array(*[F.lit(x) for x in sorted(set(active))]))


def with_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which none of the columns is missing."""
    return df.where(reduce(lambda a, b: a & b, [clean.present(c).isNotNull() for c in columns]))


def check_threshold(value: float) -> float:
    if not isinstance(value, (int, float)) or not 0 <= value <= 1:
        raise ValueError("a threshold is a number within 0..1")
    return float(value)


# ---- lookups and assembly


def demultiplex(contigs: DataFrame, tags: DataFrame, assignments: DataFrame) -> DataFrame:
    """Contigs with their sample: cell -> tag (last row per cell wins) -> assignment; the rest is dropped.

    Joins on the cell; the table of assignments has a row per tag of a study.
    """
    last = tags.groupBy(F.col("Cell_Index").alias("cell_id")).agg(F.max_by("Sample_Tag", "pos").alias("sample_tag")).where(~F.col("sample_tag").isin(*NO_TAG))
    named = assignments.select(
        F.col("sampleTag").alias("sample_tag"),
        F.trim("group").alias("group"),
        F.coalesce(F.when(F.trim("mouseLabel") != "", F.trim("mouseLabel")), F.lit("Mouse1")).alias("mouse"),
        F.coalesce(F.when(F.trim("timepoint") != "", F.trim("timepoint")), F.lit("endpoint")).alias("timepoint"),
    ).dropDuplicates(["sample_tag"])
    return contigs.join(last, "cell_id").join(named, "sample_tag")


def staging_summary(contigs: DataFrame, tags: DataFrame, staged: DataFrame) -> DataFrame:
    """One row: rows scanned, kept, cells, rows dropped for a multiplet or undetermined tag."""
    bad = tags.groupBy(F.col("Cell_Index").alias("cell_id")).agg(F.max_by("Sample_Tag", "pos").alias("t")).where(F.col("t").isin(*NO_TAG))
    scanned = contigs.agg(F.count(F.lit(1)).alias("scanned"))
    dropped = contigs.join(bad, "cell_id", "left_semi").agg(F.count(F.lit(1)).alias("dropped_tag"))
    kept = staged.agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("cell_id").alias("cells"))
    return scanned.select("scanned", kept.select("kept").scalar().alias("kept"), kept.select("cells").scalar().alias("cells"), dropped.scalar().alias("dropped_tag"))


def attach_file(df: DataFrame, files: DataFrame, seq_id: str = "sequence_id", unknown: str = "unknown.fasta") -> DataFrame:
    """Rows with ``file_id`` (digits after the last underscore, or before ``|||``) and file name, ``unknown`` where no file has it."""
    fid = F.coalesce(F.when(F.col(seq_id).contains("|||"), F.regexp_extract(seq_id, r"^(.*?)\|\|\|", 1)), X.file_suffix(seq_id))
    f = files.select(F.col("file_id").cast("string").alias("file_id"), F.col("filename").alias("sample_file"))
    return df.drop("sample_file").withColumn("file_id", fid).join(f, "file_id", "left").withColumn("sample_file", F.coalesce("sample_file", F.lit(unknown)))


def attach_timepoint(df: DataFrame, mapping: DataFrame, file: str = "sample_file") -> DataFrame:
    """Rows with the timepoint of their file: exact name first, else the name without ``_clean``."""
    m = mapping.select(F.col("filename").alias("__f"), F.col("timepoint").alias("__t")).dropDuplicates(["__f"])
    exact = df.join(m, F.col(file) == F.col("__f"), "left").drop("__f").withColumnRenamed("__t", "__exact")
    norm = exact.withColumn("__norm", F.replace(F.col(file), F.lit("_clean"), F.lit("")))
    return norm.join(m, F.col("__norm") == F.col("__f"), "left").withColumn("timepoint", F.coalesce("__exact", "__t")).drop("__f", "__t", "__exact", "__norm")


def fill_nulls(df: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null values of the columns filled from the source's row of the same key (its smallest value where there are several)."""
    s = source.groupBy(F.col(key).alias("__k")).agg(*[F.min(c).alias(f"__{c}") for c in columns])
    out = df.join(s, F.col(key) == F.col("__k"), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"__{c}"))
    return out.drop("__k", *[f"__{c}" for c in columns])


def rescue(clone_pass: DataFrame, germ_pass: DataFrame, key: str = "sequence_id") -> DataFrame:
    """germ-pass plus the clone-pass rows it lost whose alignments fit, marked ``germline_rescued``."""
    lost = rescuable(clone_pass.join(germ_pass.select(key), key, "left_anti"))
    lost = lost.withColumn("germline_alignment_d_mask", F.col("germline_alignment")).withColumn("germline_rescued", F.lit(True))
    for g, c in (("germline_v_call", "v_call"), ("germline_d_call", "d_call"), ("germline_j_call", "j_call")):
        if c in lost.columns:
            lost = lost.withColumn(g, F.col(c))
    return germ_pass.withColumn("germline_rescued", F.lit(False)).unionByName(lost, allowMissingColumns=True)


def c_gene_priority(df: DataFrame, tenx: DataFrame, native: DataFrame, blast: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Rows with c_call by priority: 10x annotation, native call, aligner hit; '' where none has one.

    Each source is (key, c_gene), its first value per key counting.
    """
    out = df.drop("c_call")
    for i, s in enumerate((tenx, native, blast)):
        one = s.where(clean.present("c_gene").isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.first("c_gene").alias(f"__c{i}"))
        out = out.join(one, F.col(key) == F.col("__k"), "left").drop("__k")
    return out.withColumn("c_call", F.coalesce("__c0", "__c1", "__c2", F.lit(""))).drop("__c0", "__c1", "__c2")


def first_hits(hits: DataFrame, query: str = "query_id", segment: str = "chain_type", pos: str = "pos") -> DataFrame:
    """First hit of each query and segment, in the order of the report."""
    cols = [c for c in hits.columns if c not in (query, segment)]
    return hits.groupBy(query, segment).agg(F.min(F.struct(F.col(pos).alias("__p"), *cols)).alias("h")).select(query, segment, *[F.col(f"h.{c}").alias(c) for c in cols])


def assemble(ids: DataFrame, hits: DataFrame, germ_pass: DataFrame, clone_pass: DataFrame, fails: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Result records: ids with first V, D and J hits, fields of germ-pass, clone of clone-pass, fail rows as unproductive.

    Ids compare without the aligner's ``reversed|``.
    """
    k = clean.record_id(key)
    f = first_hits(hits.withColumn("query_id", clean.record_id("query_id")))
    wide = f.groupBy("query_id").agg(*[F.max(F.when(F.col("chain_type") == c, F.col("subject_id"))).alias(f"{c.lower()}_gene") for c in "VDJ"])
    g = germ_pass.withColumn("__k", k).dropDuplicates(["__k"]).drop(key)
    c = clone_pass.select(k.alias("__k"), F.col("clone_id").alias("__clone")).dropDuplicates(["__k"])
    bad = fails.select(k.alias("__k")).distinct().withColumn("__fail", F.lit(True))
    out = ids.withColumn("__k", k)
    out = out.join(wide, F.col("__k") == F.col("query_id"), "left").drop("query_id").join(g, "__k", "left").join(c, "__k", "left").join(bad, "__k", "left")
    failed = F.coalesce("__fail", F.lit(False))
    clone = F.when(failed, F.lit(None)).otherwise(F.coalesce("clone_id", "__clone")) if "clone_id" in germ_pass.columns else F.when(~failed, F.col("__clone"))
    out = out.withColumn("productive", ~failed).withColumn("clone_id", clone.cast("long"))
    return out.drop("__k", "__clone", "__fail")


def merge_fails(good: DataFrame, fails: DataFrame, key: str = "sequence_id") -> DataFrame:
    """All records; a fail row overwrites an earlier entry of its id: unproductive, no clone, count 0."""
    bad = fails.select(*[c for c in fails.columns if c in good.columns]).dropDuplicates([key])
    bad = bad.withColumn("productive", F.lit(False)).withColumn("clone_id", F.lit(None).cast("long")).withColumn("clone_count", F.lit(0).cast("long"))
    kept = good.join(bad.select(key), key, "left_anti")
    return kept.unionByName(bad, allowMissingColumns=True)


def by_design(df: DataFrame, design: DataFrame, file: str = "sample_file") -> DataFrame:
    """Rows of the files of a design, with group and timepoint."""
    return df.drop("timepoint", "ord").join(design, df[file] == design["filename"]).drop("filename")


def best_tree(clones: DataFrame, trees: DataFrame, keys: list[str], timepoint: str = "timepoint") -> DataFrame:
    """The tree of a clone at a timepoint: the largest of that timepoint, else the largest of any."""
    t = trees.select(*keys, F.col(timepoint).alias("__t"), "path", "clone_size")
    j = clones.join(t, keys)
    score = F.struct((F.col(timepoint) == F.col("__t")).cast("int"), F.col("clone_size"), F.col("path"))
    return j.groupBy(*clones.columns).agg(F.max_by("path", score).alias("path"), F.max_by("clone_size", score).alias("tree_size"))


def align_union(*dfs: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# ---- ranks and buckets


def best_contig(df: DataFrame, keys: tuple[str, ...] = ("barcode", "chain"), score: str = "umis", tie: str = "contig_id") -> DataFrame:
    """The contig with most UMIs per cell and chain, ties to the smallest id; text that is no number counts as 0."""
    n = F.coalesce(F.expr(f"try_cast(`{score}` as int)"), F.lit(0))
    cols = [c for c in df.columns if c not in keys]
    return df.withColumn("__n", n).groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(-F.col("__n"), F.col(tie))).alias("r")).select(*keys, "r.*")


def contig_summary(df: DataFrame) -> DataFrame:
    """One row: contigs, distinct cells, heavy and light contigs."""
    return df.agg(F.count(F.lit(1)).alias("contigs"), F.countDistinct("barcode").alias("cells"), F.count(F.when(F.col("chain") == "IGH", 1)).alias("heavy"), F.count(F.when(F.col("chain").isin("IGK", "IGL"), 1)).alias("light"))


def clone_buckets(df: DataFrame, group: list[str], clone: str = "clone_id") -> DataFrame:
    """``group..., bucket, rows``: clones of two or more under their id, the rest as Singletons (-1) and No Clone (null)."""
    sizes = df.groupBy(*group, clone).agg(F.count(F.lit(1)).alias("n"))
    bucket = F.when(F.col(clone).isNull(), F.lit(None)).when(F.col("n") >= 2, F.col(clone)).otherwise(F.lit(-1))
    return sizes.groupBy(*group, bucket.alias("bucket")).agg(F.sum("n").alias("rows"))


def browser_keys(clone: str = "clone_id", count: str = "clone_count", pos: str = "sequence_id") -> list[Column]:
    """Cloned rows first, larger clones first, then clone id, then the original order."""
    return [F.col(clone).isNull(), F.desc_nulls_last(count), F.asc_nulls_last(clone), F.col(pos)]


def browser_order(df: DataFrame, clone: str = "clone_id", count: str = "clone_count", pos: str = "sequence_id") -> DataFrame:
    """Rows in the order of :func:`browser_keys`."""
    return df.orderBy(*browser_keys(clone, count, pos))


def tree_order(df: DataFrame, timepoint: str = "timepoint", size: str = "clone_size") -> DataFrame:
    return df.orderBy(X.natural_key(timepoint), F.desc(size))


def rank_labels(sizes: DataFrame, by: list[str], size: str, tie: str, prefix: str = "C", top: int | None = None) -> DataFrame:
    """Rows with ``label`` C1..Cn by size within ``by``, ties by ``tie``; ``top`` keeps the first ones."""
    w = Window.partitionBy(*by).orderBy(F.desc(size), tie)
    r = sizes.withColumn("__r", F.row_number().over(w))
    r = r.where(F.col("__r") <= top) if top else r
    return r.withColumn("label", F.concat(F.lit(prefix), F.col("__r"))).drop("__r")


def top_consistent(df: DataFrame, keys: list[str], germline: str, n: int = 20, least: int = 3) -> DataFrame:
    """The ``n`` largest clones among those with one germline and ``least`` rows (an unfit clone gives way to the next)."""
    return consistent_germline(df, keys, germline).where(F.col("size") >= least).orderBy(F.desc("size"), *keys).limit(n)


def ordered_labels(df: DataFrame, label: str, pos: str) -> DataFrame:
    """``label, pos``: distinct labels with their first position."""
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(pos).alias("pos"))


def content_counts(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """``keys..., content, n``: rows of equal content (upper case, without gaps and N) in each clone."""
    return df.where(F.col(seq).isNotNull()).groupBy(*keys, X.content(seq).alias("content")).agg(F.count(F.lit(1)).alias("n"))


def group_by_timepoint(df: DataFrame, mapping: DataFrame, file: str = "sample_file", other: str = "Unassigned") -> DataFrame:
    """``timepoint, files, rows``: files grouped by mapped timepoint; files without one under ``other``."""
    m = mapping.select(F.col("filename").alias("__f"), F.col("timepoint").alias("__t")).dropDuplicates(["__f"])
    per = df.groupBy(F.col(file).alias("__file")).agg(F.count(F.lit(1)).alias("n"))
    j = per.join(m, F.col("__file") == F.col("__f"), "left")
    return j.groupBy(F.coalesce("__t", F.lit(other)).alias("timepoint")).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("rows"))


def size_lookup(trees: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Trees with the size of their clone, 0 where it is absent."""
    s = df.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("clone_size"))
    return trees.join(s, keys, "left").withColumn("clone_size", F.coalesce("clone_size", F.lit(0)))


def cohort_names(assignments: DataFrame, group: str = "group", pos: str = "pos") -> DataFrame:
    """``group, tags, first``: tags per trimmed group name and its first position; blank names are left out."""
    g = assignments.withColumn("__g", F.trim(group)).where("__g <> ''")
    return g.groupBy(F.col("__g").alias("group")).agg(F.count(F.lit(1)).alias("tags"), F.min(pos).alias("first"))


def distinct_tags(tags: DataFrame, tag: str = "Sample_Tag") -> DataFrame:
    """Distinct usable sample tags."""
    return tags.where(F.col(tag).isNotNull() & ~F.col(tag).isin(*NO_TAG)).select(tag).distinct()


def set_relation(a: Column, b: Column) -> Column:
    """equal, subset, superset, overlap or disjoint, of two arrays taken as sets."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    n = F.size(F.array_intersect(x, y))
    return F.when((n == F.size(x)) & (n == F.size(y)), "equal").when(n == F.size(x), "subset").when(n == F.size(y), "superset").when(n > 0, "overlap").otherwise("disjoint")
