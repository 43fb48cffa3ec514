"""Queries of record filters, lookups, assembly, windows, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjlake.functions import clean
from vdjlake.operators import dynamics as L
from vdjlake.operators import matching as M
from vdjlake.operators import rows as R
from vdjlake.plans.base import MISSING, S, gene_sql, seqs
from vdjlake.session import read
from vdjlake.sinks import tables as K
from vdjlake.sources import fasta, tables


def heavy_rows(spark: SparkSession, d: str) -> DataFrame:
    """Clone_pass rows of the heavy locus with a V call and junction."""
    c = R.with_profile(R.heavy(read(spark, d, "clone_pass")), ["v_call", "junction"])
    return c.select("sequence_id", "cohort_name", "timepoint", "clone_id").distinct()


def search_rows(spark: SparkSession, d: str) -> DataFrame:
    """Live sequences with the text in name, genes or CDR3."""
    return R.search(seqs(spark, d), "IGHV3-4", ["sequence_id", "v", "j", "cdr3"]).select("sequence_id", "v")


def tree_search(spark: SparkSession, d: str) -> DataFrame:
    """Sample files that match a text themselves or by a sequence of theirs."""
    s = seqs(spark, d)
    return R.tree_search(s.select("sample_file").distinct(), s, "sample_file", "CARD", ["sample_file"], ["cdr3"])


def toggled_rows(spark: SparkSession, d: str) -> DataFrame:
    s = R.toggled(seqs(spark, d), cohort=["prime_boost", "late_recall"], timepoint=["day14", "day42"], patient=[])
    return s.groupBy("cohort", "timepoint", "patient").agg(F.count(F.lit(1)).alias("n"))


def min_clone_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of clones with five rows or more."""
    return R.min_clone_size(seqs(spark, d), ["cohort", "clone_id"], 5).select("sequence_id", "cohort", "clone_id")


def consistent_clones(spark: SparkSession, d: str) -> DataFrame:
    """Clones whose sequences name one J gene at most."""
    return R.consistent_germline(seqs(spark, d).where("clone_id is not null"), ["cohort", "clone_id"], "j")


def merged_fails(spark: SparkSession, d: str) -> DataFrame:
    """Records of sequences and db_fail; a fail overwrites its id's entry."""
    good = seqs(spark, d).select("sequence_id", "productive", "clone_id", F.lit(1).cast("long").alias("clone_count"))
    bad = read(spark, d, "db_fail").select(clean.record_id("sequence_id").alias("sequence_id")).where("sequence_id is not null")
    return R.merge_fails(good, bad)


def clone_pass_only(spark: SparkSession, d: str) -> DataFrame:
    """Ids of clone_pass without a row in sequences (set difference)."""
    c = read(spark, d, "clone_pass").select(clean.record_id("sequence_id").alias("id")).where("id is not null")
    return c.join(read(spark, d, "sequences").select("id"), "id", "left_anti").distinct()


def isotype_calls(spark: SparkSession, d: str) -> DataFrame:
    """clone_pass with the constant gene of its sequence, '' where it has none."""
    c = read(spark, d, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id")).where("sequence_id is not null").distinct()
    src = seqs(spark, d).select("sequence_id", F.col("c_call").alias("c_gene"))
    none = src.limit(0)
    return R.c_gene_priority(c, none, src, none)


def filled_calls(spark: SparkSession, d: str) -> DataFrame:
    """V calls of clone_pass, missing ones filled from the sequence."""
    c = read(spark, d, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id"), clean.gene("v_call").alias("v")).where("sequence_id is not null").distinct()
    return R.fill_nulls(c, seqs(spark, d).select("sequence_id", "v"), "sequence_id", ["v"])


def file_design(spark: SparkSession, d: str) -> DataFrame:
    """Files of the study in the order of their ids, with timepoint and its order of appearance."""
    f = read(spark, d, "sequences").where("sample_file is not null and timepoint is not null").groupBy("sample_file").agg(F.min("timepoint").alias("timepoint"))
    m = f.select(F.col("sample_file").alias("filename"), "timepoint", F.regexp_extract("sample_file", r"run(\d+)", 1).cast("int").alias("pos"))
    return L.design_from_mapping(m)


def rows_by_design(spark: SparkSession, d: str) -> DataFrame:
    """Rows per group and timepoint of the design."""
    s = R.by_design(seqs(spark, d), file_design(spark, d))
    return s.groupBy("group_name", "timepoint", "ord").agg(F.count(F.lit(1)).alias("n"))


def browser_groups(spark: SparkSession, d: str) -> DataFrame:
    """Files and rows per timepoint; files missing from the design are unassigned."""
    design = file_design(spark, d).where("timepoint <> 'day42'")
    return R.group_by_timepoint(seqs(spark, d), design)


def reconciled_design(spark: SparkSession, d: str) -> DataFrame:
    """The design without files that are gone, with new files unassigned."""
    files = read(spark, d, "diversity").select(F.col("sample_file").alias("filename")).where("filename is not null").distinct()
    return L.reconcile(file_design(spark, d).where("timepoint <> 'day0'"), files)


def ranked_labels(spark: SparkSession, d: str) -> DataFrame:
    """C1..C15 by size in each cohort."""
    z = seqs(spark, d).where("clone_id is not null").groupBy("cohort", "clone_id").agg(F.count(F.lit(1)).alias("size"))
    return R.rank_labels(z, ["cohort"], "size", "clone_id", top=15)


def best_parts(spark: SparkSession, d: str) -> DataFrame:
    """The line of greatest quantity per order, ties to the smallest line number (best row per key)."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("barcode"), F.col("l_returnflag").alias("chain"), F.col("l_quantity").cast("int").cast("string").alias("umis"), F.struct("l_linenumber", "l_partkey").alias("contig_id"))
    b = R.best_contig(l)
    return b.select(F.col("barcode").alias("l_orderkey"), F.col("chain").alias("l_returnflag"), F.col("umis").cast("int").alias("quantity"), F.col("contig_id.l_linenumber").alias("l_linenumber"), F.col("contig_id.l_partkey").alias("l_partkey"))


def label_order(spark: SparkSession, d: str) -> DataFrame:
    """Timepoints with the first load of each (order of appearance)."""
    return R.ordered_labels(read(spark, d, "sequences"), "timepoint", "loaded_at")


def sample_set_relations(spark: SparkSession, d: str) -> DataFrame:
    """How the mice of a cohort clone relate to mouse1 and mouse3."""
    c = read(spark, d, "cohort_clones").where("clone_key is not null").select("clone_key", F.filter(F.transform(F.coalesce("samples", F.array().cast("array<string>")), lambda x: clean.name_key(x)), lambda x: x.isNotNull()).alias("m")).distinct()
    return c.select("clone_key", R.set_relation(F.col("m"), F.array(F.lit("mouse1"), F.lit("mouse3"))).alias("relation")).distinct()


def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """CDR3s written as FASTA, a folder per timepoint, and read back."""
    s = read(spark, d, "sequences").where("deleted_at is null and id is not null and cdr3_dna is not null").select("timepoint", F.col("id").alias("sequence_id"), F.col("cdr3_dna").alias("sequence")).dropDuplicates(["sequence_id"])
    path = tables.scratch(spark, "fasta")
    K.fasta(s, path, ["timepoint"])
    return fasta.read_fasta(spark, [f"{path}/timepoint=*"]).select("sequence_id", F.upper("sequence").alias("sequence"))


def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """clone_pass written as tab-separated text and read back with numbers and missing words resolved."""
    c = read(spark, d, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id"), "locus", "v_call", "clone_id", "dist_nearest").where("sequence_id is not null").dropDuplicates(["sequence_id"])
    path = tables.scratch(spark, "tsv")
    K.tsv(c, path)
    t = tables.read_rearrangements(spark, path)
    return t.select("sequence_id", "locus", "v_call", "clone_id", F.when(~F.isnan("dist_nearest"), F.col("dist_nearest")).alias("dist_nearest"))


def csv_fields(spark: SparkSession, d: str) -> DataFrame:
    """Antibody fields as CSV fields."""
    a = read(spark, d, "antibodies").select("antibody_name", "binds_to", "origin").distinct()
    return a.select("antibody_name", K.csv_field(F.col("binds_to")).alias("binds_to"), K.csv_field(F.col("origin")).alias("origin"))


def shared_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Public clones x mice with a totals row."""
    from vdjlake.operators import sharing as P

    s = seqs(spark, d)
    return K.shared_sheet(P.heatmap(s, ["cohort", "clone_id"], clones=P.public_clones(s, ["cohort", "clone_id"]), scope=["cohort"]), ["cohort", "clone_id"])


def attached_files(spark: SparkSession, d: str) -> DataFrame:
    """File of every clone_pass record by the suffix of its id, and that file's timepoint."""
    f = read(spark, d, "sequences").where("sample_file is not null").select(F.regexp_extract("sample_file", r"run(\d+)", 1).cast("long").alias("file_id"), F.col("sample_file").alias("filename"), "timepoint").distinct()
    c = read(spark, d, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id")).where("sequence_id is not null").distinct()
    named = R.attach_file(c, f.select("file_id", "filename").distinct())
    return R.attach_timepoint(named, f.select("filename", "timepoint")).select("sequence_id", "file_id", "sample_file", "timepoint")


def _staging(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as contigs of customers' cells, nations as sample tags, regions as groups; two tags are unusable."""
    contigs = read(spark, d, "orders").select(F.col("o_custkey").alias("cell_id"), F.col("o_orderkey").alias("sequence_id"))
    tag = F.when(F.col("c_nationkey") == 3, "Multiplet").when(F.col("c_nationkey") == 7, "Undetermined").otherwise(F.col("c_nationkey").cast("string"))
    tags = read(spark, d, "customer").select(F.col("c_custkey").alias("Cell_Index"), tag.alias("Sample_Tag"), F.col("c_custkey").alias("pos"))
    named = read(spark, d, "nation").where("n_nationkey <> 11").select(F.col("n_nationkey").cast("string").alias("sampleTag"), F.concat(F.lit(" g"), "n_regionkey").alias("group"), F.lit("").alias("mouseLabel"), F.lit(None).cast("string").alias("timepoint"))
    return contigs, tags, named


def demultiplexed(spark: SparkSession, d: str) -> DataFrame:
    """Contigs with sample tag, group, mouse and timepoint."""
    return R.demultiplex(*_staging(spark, d)).select("sequence_id", "cell_id", "sample_tag", "group", "mouse", "timepoint")


def staging_counts(spark: SparkSession, d: str) -> DataFrame:
    """Contigs scanned, kept, their cells, and contigs dropped for their tag."""
    contigs, tags, named = _staging(spark, d)
    return R.staging_summary(contigs, tags, R.demultiplex(contigs, tags, named))


def first_hits(spark: SparkSession, d: str) -> DataFrame:
    """First line of each order and return flag, as first hit of a query and segment."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_returnflag").alias("chain_type"), F.struct("l_linenumber", "l_partkey").alias("pos"), "l_partkey", "l_linenumber")
    return R.first_hits(l).select("query_id", "chain_type", "l_partkey", "l_linenumber")


def contig_counts(spark: SparkSession, d: str) -> DataFrame:
    """Contigs, cells, heavy and light ones; orders as cells and return flags as chains."""
    l = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("barcode"), F.when(F.col("l_returnflag") == "A", "IGH").when(F.col("l_returnflag") == "R", "IGK").otherwise("IGL").alias("chain"))
    return R.contig_summary(l)


def group_names(spark: SparkSession, d: str) -> DataFrame:
    """Tags per group and the first position of each group."""
    n = read(spark, d, "nation").select(F.concat(F.lit(" "), F.col("n_regionkey").cast("string")).alias("group"), F.col("n_nationkey").alias("pos"))
    return R.cohort_names(n)


def lost_records(spark: SparkSession, d: str) -> DataFrame:
    """clone_pass completed by the sequences it lost, whose two texts are equally long (as rescued)."""
    cp = seqs(spark, d).select("sequence_id", F.col("cdr3").alias("sequence_alignment"), F.col("cdr3").alias("germline_alignment"), F.col("v").alias("v_call"))
    gp = read(spark, d, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id")).where("sequence_id is not null").distinct()
    return R.rescue(cp, gp).select("sequence_id", "germline_rescued", "germline_v_call")


def tree_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Clones named by clone_pass with their size in sequences, 0 where absent."""
    t = read(spark, d, "clone_pass").where("clone_id is not null").select(F.col("cohort_name").alias("cohort"), "clone_id").distinct()
    return R.size_lookup(t, seqs(spark, d), ["cohort", "clone_id"])


def antibody_bands(spark: SparkSession, d: str) -> DataFrame:
    """Matches of clones placed at day14 only."""
    from vdjlake.plans import clones as C

    m = C.vh_matches(spark, d).withColumn("cohort", F.substring_index("clone", "/", 1)).withColumn("clone_id", F.substring_index("clone", "/", -1).cast("long"))
    return M.filter_by_timepoint(m, seqs(spark, d), ["cohort", "clone_id"], "timepoint", "day14").select("clone", "antibody_name", "identity")


QUERIES = {
    f.__name__: f
    for f in (
        heavy_rows, search_rows, tree_search, toggled_rows, min_clone_rows, consistent_clones, merged_fails, clone_pass_only, isotype_calls, filled_calls, file_design, rows_by_design,
        browser_groups, reconciled_design, ranked_labels, best_parts, label_order, sample_set_relations, fasta_round_trip, tsv_round_trip, csv_fields, shared_sheet, attached_files,
        demultiplexed, staging_counts, first_hits, contig_counts, group_names, lost_records, tree_sizes, antibody_bands,
    )
}

_CID = "CASE WHEN starts_with(trim(sequence_id), 'reversed|') THEN trim(substr(trim(sequence_id), 10)) ELSE trim(sequence_id) END"
_FD = """fd0 AS (SELECT sample_file AS filename, min(timepoint) AS timepoint FROM sequences WHERE sample_file IS NOT NULL AND timepoint IS NOT NULL GROUP BY 1),
fd1 AS (SELECT *, CAST(regexp_extract(filename, 'run([0-9]+)', 1) AS INT) AS pos FROM fd0),
fd AS (SELECT 'Study' AS group_name, timepoint, CAST(dense_rank() OVER (ORDER BY mp) - 1 AS INT) AS ord, filename FROM (SELECT *, min(pos) OVER (PARTITION BY timepoint) AS mp FROM fd1) x)"""

SQL = {
    "heavy_rows": f"SELECT DISTINCT sequence_id, cohort_name, timepoint, clone_id FROM clone_pass WHERE locus = 'IGH' AND lower(trim(v_call)) NOT IN {MISSING} AND lower(trim(junction)) NOT IN {MISSING}",
    "search_rows": f"WITH {S} SELECT sequence_id, v FROM s WHERE strpos(lower(sequence_id), 'ighv3-4') > 0 OR strpos(lower(coalesce(v, '')), 'ighv3-4') > 0 OR strpos(lower(coalesce(j, '')), 'ighv3-4') > 0 OR strpos(lower(coalesce(cdr3, '')), 'ighv3-4') > 0",
    "tree_search": f"WITH {S} SELECT DISTINCT sample_file FROM s WHERE sample_file IS NOT NULL AND (strpos(lower(sample_file), 'card') > 0 OR strpos(lower(coalesce(cdr3, '')), 'card') > 0)",
    "toggled_rows": f"WITH {S} SELECT cohort, timepoint, patient, count(*) AS n FROM s WHERE cohort IN ('prime_boost', 'late_recall') AND timepoint IN ('day14', 'day42') GROUP BY 1, 2, 3",
    "min_clone_rows": f"WITH {S} SELECT sequence_id, cohort, clone_id FROM (SELECT *, count(*) OVER (PARTITION BY cohort, clone_id) AS n FROM s WHERE cohort IS NOT NULL AND clone_id IS NOT NULL) x WHERE n >= 5",
    "consistent_clones": f"WITH {S} SELECT cohort, clone_id, count(*) AS size FROM s WHERE clone_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT j) <= 1",
    "merged_fails": f"WITH {S}, b AS (SELECT DISTINCT {_CID} AS sequence_id FROM db_fail WHERE {_CID} <> '') SELECT sequence_id, productive, clone_id, 1 AS clone_count FROM s WHERE sequence_id NOT IN (SELECT sequence_id FROM b) UNION ALL SELECT sequence_id, false, NULL, 0 FROM b",
    "clone_pass_only": f"SELECT DISTINCT {_CID} AS id FROM clone_pass WHERE {_CID} <> '' AND {_CID} NOT IN (SELECT id FROM sequences WHERE id IS NOT NULL)",
    "isotype_calls": f"WITH {S}, c AS (SELECT DISTINCT {_CID} AS sequence_id FROM clone_pass WHERE {_CID} <> '') SELECT sequence_id, coalesce(s.c_call, '') AS c_call FROM c LEFT JOIN s USING (sequence_id)",
    "filled_calls": f"WITH {S}, c AS (SELECT DISTINCT {_CID} AS sequence_id, {gene_sql('v_call')} AS v FROM clone_pass WHERE {_CID} <> '') SELECT sequence_id, coalesce(c.v, s.v) AS v FROM c LEFT JOIN s USING (sequence_id)",
    "file_design": f"WITH {_FD} SELECT * FROM fd",
    "rows_by_design": f"WITH {S}, {_FD} SELECT group_name, fd.timepoint, ord, count(*) AS n FROM s JOIN fd ON fd.filename = s.sample_file GROUP BY 1, 2, 3",
    "browser_groups": f"WITH {S}, {_FD} SELECT coalesce(fd.timepoint, 'Unassigned') AS timepoint, count(DISTINCT coalesce(s.sample_file, '?')) AS files, count(*) AS rows FROM s LEFT JOIN fd ON fd.filename = s.sample_file AND fd.timepoint <> 'day42' GROUP BY 1",
    "reconciled_design": f"WITH {_FD}, k AS (SELECT DISTINCT sample_file AS filename FROM diversity WHERE sample_file IS NOT NULL) SELECT k.filename, fd.group_name, fd.timepoint, fd.ord FROM k LEFT JOIN fd ON fd.filename = k.filename AND fd.timepoint <> 'day0'",
    "ranked_labels": f"WITH {S}, z AS (SELECT cohort, clone_id, count(*) AS size FROM s WHERE clone_id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY size DESC, clone_id) AS k FROM z) SELECT cohort, clone_id, size, 'C' || k AS label FROM r WHERE k <= 15",
    "best_parts": "SELECT l_orderkey, l_returnflag, CAST(l_quantity AS INT) AS quantity, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY CAST(trunc(l_quantity) AS INT) DESC, l_linenumber, l_partkey) AS r FROM lineitem) x WHERE r = 1",
    "label_order": "SELECT timepoint, min(loaded_at) AS pos FROM sequences WHERE timepoint IS NOT NULL GROUP BY 1",
    "sample_set_relations": f"""WITH c AS (SELECT DISTINCT clone_key, list_sort(list_distinct(list_filter(list_transform(coalesce(samples, []), lambda x: CASE WHEN lower(trim(x)) NOT IN {MISSING} THEN lower(trim(x)) END), lambda x: x IS NOT NULL))) AS m FROM cohort_clones WHERE clone_key IS NOT NULL),
n AS (SELECT *, len(m) AS k, len(list_filter(m, lambda x: x IN ('mouse1', 'mouse3'))) AS h FROM c)
SELECT DISTINCT clone_key, CASE WHEN h = k AND h = 2 THEN 'equal' WHEN h = k THEN 'subset' WHEN h = 2 THEN 'superset' WHEN h > 0 THEN 'overlap' ELSE 'disjoint' END AS relation FROM n""",
    "fasta_round_trip": "SELECT id AS sequence_id, any_value(upper(regexp_replace(cdr3_dna, '\\s', '', 'g'))) AS sequence FROM sequences WHERE deleted_at IS NULL AND id IS NOT NULL AND length(cdr3_dna) > 0 GROUP BY id",
    "tsv_round_trip": f"SELECT {_CID} AS sequence_id, any_value(locus) AS locus, any_value(CASE WHEN lower(trim(v_call)) NOT IN {MISSING} THEN trim(v_call) END) AS v_call, any_value(clone_id) AS clone_id, any_value(CASE WHEN NOT isnan(dist_nearest) THEN dist_nearest END) AS dist_nearest FROM clone_pass WHERE {_CID} <> '' GROUP BY 1",
    "attached_files": f"""WITH f AS (SELECT DISTINCT regexp_extract(sample_file, 'run([0-9]+)', 1) AS fid, sample_file, timepoint FROM sequences WHERE sample_file IS NOT NULL),
c AS (SELECT DISTINCT {_CID} AS sequence_id FROM clone_pass WHERE {_CID} <> '')
SELECT sequence_id, nullif(regexp_extract(sequence_id, '_([0-9]+)$', 1), '') AS file_id, coalesce(f.sample_file, 'unknown.fasta') AS sample_file, f.timepoint FROM c LEFT JOIN f ON f.fid = regexp_extract(sequence_id, '_([0-9]+)$', 1)""",
    "demultiplexed": """SELECT o_orderkey AS sequence_id, o_custkey AS cell_id, CAST(c_nationkey AS VARCHAR) AS sample_tag, 'g' || n_regionkey AS "group", 'Mouse1' AS mouse, 'endpoint' AS timepoint
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_nationkey NOT IN (3, 7, 11)""",
    "staging_counts": """SELECT (SELECT count(*) FROM orders) AS scanned, count(*) FILTER (WHERE c_nationkey NOT IN (3, 7, 11)) AS kept, count(DISTINCT o_custkey) FILTER (WHERE c_nationkey NOT IN (3, 7, 11)) AS cells, count(*) FILTER (WHERE c_nationkey IN (3, 7)) AS dropped_tag
FROM orders JOIN customer ON c_custkey = o_custkey""",
    "first_hits": "SELECT l_orderkey AS query_id, l_returnflag AS chain_type, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS r FROM lineitem) x WHERE r = 1",
    "contig_counts": "SELECT count(*) AS contigs, count(DISTINCT l_orderkey) AS cells, count(*) FILTER (WHERE l_returnflag = 'A') AS heavy, count(*) FILTER (WHERE l_returnflag <> 'A') AS light FROM lineitem",
    "group_names": "SELECT CAST(n_regionkey AS VARCHAR) AS \"group\", count(*) AS tags, min(n_nationkey) AS first FROM nation GROUP BY 1",
    "lost_records": f"WITH {S}, g AS (SELECT DISTINCT {_CID} AS sequence_id FROM clone_pass WHERE {_CID} <> '') SELECT sequence_id, false AS germline_rescued, NULL AS germline_v_call FROM g UNION ALL SELECT sequence_id, true, v FROM s WHERE cdr3 IS NOT NULL AND sequence_id NOT IN (SELECT sequence_id FROM g)",
    "tree_sizes": f"WITH {S}, t AS (SELECT DISTINCT cohort_name AS cohort, clone_id FROM clone_pass WHERE clone_id IS NOT NULL) SELECT t.cohort, t.clone_id, count(s.sequence_id) AS clone_size FROM t LEFT JOIN s ON s.cohort = t.cohort AND s.clone_id = t.clone_id GROUP BY 1, 2",
    "csv_fields": """SELECT DISTINCT antibody_name, CASE WHEN regexp_matches(coalesce(binds_to, ''), '[,"\\r\\n]') THEN '"' || replace(binds_to, '"', '""') || '"' ELSE coalesce(binds_to, '') END AS binds_to,
  CASE WHEN regexp_matches(coalesce(origin, ''), '[,"\\r\\n]') THEN '"' || replace(origin, '"', '""') || '"' ELSE coalesce(origin, '') END AS origin FROM antibodies""",
}
