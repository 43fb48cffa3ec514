"""Queries that write the project's rows in the forms of the sources and read them back, and of result sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vdjlake.functions import clean
from vdjlake.functions import sequence as X
from vdjlake.operators import dynamics as L
from vdjlake.operators import matching as M
from vdjlake.operators import rows as R
from vdjlake.plans.base import MISSING, S, gene_sql, seqs
from vdjlake.session import _fs, read
from vdjlake.sinks import tables as K
from vdjlake.sources import aligner, fasta, folders, tables


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Live sequences, one row per id, with the fields that the sources hold, as text."""
    s = read(spark, d, "sequences").where("deleted_at is null and id is not null").dropDuplicates(["id"])
    return s.select(
        "id", "sample_file", "timepoint", *[clean.present(c).alias(c) for c in ("v_gene", "d_gene", "j_gene", "v_locus", "c_call", "cdr3_dna", "aa_sequence")],
        F.col("clone_count").cast("string").alias("clone_count"), F.col("somatic_mutations").alias("shm"), F.col("productive").cast("string").alias("productive"), "cohort_name", "clone_id",
    )


def _text(df: DataFrame, name: str, sep: str, header: bool = True) -> str:
    path = tables.scratch(df.sparkSession, name)
    df.write.option("sep", sep).option("header", header).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
    return path


def _one_file(top: list[str], lines: DataFrame) -> DataFrame:
    """The lines of a file that starts with the given ones."""
    head = lines.sparkSession.createDataFrame(list(enumerate(top)), "at int, value string")
    return head.unionByName(lines.select(F.lit(len(top)).alias("at"), "value")).repartition(1).sortWithinPartitions("at").select("value")


def tenx_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Contig annotations of cells, of high confidence and productive, with their UMIs and constant gene."""
    s = _raw(spark, d)
    path = _text(s.select(F.col("id").alias("barcode"), F.lit("true").alias("is_cell"), F.col("id").alias("contig_id"), F.lit("True").alias("high_confidence"), F.coalesce("v_locus", F.lit("None")).alias("chain"), F.col("clone_count").alias("umis"), F.col("c_call").alias("c_gene"), "productive"), "tenx", ",")
    return R.quality_10x(tables.read_10x(spark, path)).select("contig_id", "chain", "umis", "c_gene")


def airr_cells(spark: SparkSession, d: str) -> DataFrame:
    """Productive B-cell rows of a raw rearrangement table, with the identifiers that stand in for absent ones."""
    s = _raw(spark, d).where("aa_sequence is not null")
    raw = s.select(F.col("id").alias("cell_id"), F.lit("B").alias("cell_type_experimental"), F.coalesce("v_locus", F.lit("")).alias("locus"), F.coalesce("productive", F.lit("")).alias("productive"), F.when(F.length("id") % 2 == 0, F.col("id")).otherwise("").alias("sequence_id"), F.col("aa_sequence").alias("sequence"))
    path = tables.scratch(spark, "airr")
    # such a table is one compressed file with its header first
    _one_file(["\t".join(raw.columns)], raw.select(F.concat_ws("\t", *raw.columns).alias("value"))).write.option("compression", "gzip").text(path)
    return tables.default_ids(R.airr_b_cells(tables.read_airr(spark, path))).select("cell_id", "sequence_id", "locus")


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Usable sample tags of a tag table with comment lines, customers as cells and nations as tags."""
    tag = F.when(F.col("c_nationkey") == 3, "Multiplet").when(F.col("c_nationkey") == 7, "Undetermined").otherwise(F.concat(F.lit("tag"), F.col("c_nationkey").cast("string")))
    path = tables.scratch(spark, "tags")
    lines = read(spark, d, "customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), tag).alias("value"))
    _one_file(["# comment", "Cell_Index,Sample_Tag"], lines).write.text(path)
    return R.distinct_tags(tables.read_sample_tags(spark, path))


def report_hits(spark: SparkSession, d: str) -> DataFrame:
    """First V and J hits, CDR3 and mutations of every query of an aligner's report."""
    s = _raw(spark, d)
    hit = lambda c, g: F.when(F.col(g).isNotNull(), F.concat(F.lit(f"{c}\t"), "id", F.lit("\t"), F.substring_index(g, ",", 1), F.lit("\t98.5\t200\t3\t0\t0\t1\t200\t1\t200\t1e-50\t300\tA\tA\t200\n")))
    second = F.when(F.col("v_gene").contains(","), F.concat(F.lit("V\t"), "id", F.lit("\t"), F.substring_index("v_gene", ",", -1), F.lit("\t90\t200\t9\n")))
    cdr3 = F.when(F.col("cdr3_dna").isNotNull(), F.concat(F.lit("CDR3\t"), "cdr3_dna", F.lit("\tX\n")))
    total = F.when(F.col("shm").isNotNull(), F.concat(F.lit("Total\tN/A\tN/A\t300\t290\t"), F.col("shm").cast("string"), F.lit("\t0\t97\n")))
    text = F.concat(F.lit("# IGBLASTN\n# Query: "), "id", F.lit("\n"), F.coalesce(cdr3, F.lit("")), F.coalesce(total, F.lit("")), F.coalesce(hit("V", "v_gene"), F.lit("")), F.coalesce(second, F.lit("")), F.coalesce(hit("J", "j_gene"), F.lit("")))
    path = tables.scratch(spark, "report")
    s.select(text.alias("value")).write.text(path)
    h, c = aligner.read_report(spark, path)
    first = R.first_hits(h.select("query_id", "chain_type", "subject_id", "pos"))
    wide = first.groupBy("query_id").agg(F.max(F.when(F.col("chain_type") == "V", F.col("subject_id"))).alias("v"), F.max(F.when(F.col("chain_type") == "J", F.col("subject_id"))).alias("j"))
    return c.select("query_id", "cdr3_dna", "mutations").join(wide, "query_id", "left")


def constant_hits(spark: SparkSession, d: str) -> DataFrame:
    """Constant gene of each query by its first good hit in a tabular report without header."""
    s = _raw(spark, d).where("c_call is not null and shm is not null")
    row = lambda gene, pct, n: F.struct(gene.alias("g"), pct.cast("double").alias("p"), n.cast("int").alias("n"))
    both = s.select("id", F.explode(F.array(row(F.lit("IGHE"), F.lit(79.9), F.lit(200)), row(F.col("c_call"), F.lit(100) - F.col("shm"), F.lit(60)), row(F.lit("IGHD"), F.lit(99), F.lit(49)))).alias("x"))
    path = _text(both.select("id", "x.g", "x.p", "x.n"), "hits", "\t", header=False)
    return R.c_gene_hits(tables.read_hits(spark, path))


def constant_genes(spark: SparkSession, d: str) -> DataFrame:
    """Constant gene of every clone_pass record: of the 10x annotation, of the record, of the aligner's hit, in this order."""
    c = read(spark, d, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id")).where("sequence_id is not null").distinct()
    tenx = tenx_contigs(spark, d).select(F.col("contig_id").alias("sequence_id"), "c_gene")
    native = _raw(spark, d).select(F.col("id").alias("sequence_id"), F.when(F.col("v_locus") == "IGH", "IGHM").alias("c_gene"))
    blast = constant_hits(spark, d).select(F.col("query_id").alias("sequence_id"), "c_gene")
    return R.c_gene_priority(c, tenx, native, blast)


def antibody_reference(spark: SparkSession, d: str) -> DataFrame:
    """The antibody reference as a table of fifteen columns, read by position."""
    a = read(spark, d, "antibodies").where("antibody_name is not null").distinct()
    cols = [next((n for n, i in tables.ANTIBODY_AT.items() if i == k), None) for k in range(15)]
    path = _text(a.select(*[F.col(n) if n else F.lit("-").alias(f"c{k}") for k, n in enumerate(cols)]), "antibodies", ",")
    return tables.read_antibodies(spark, path).distinct()


def germline_alleles(spark: SparkSession, d: str) -> DataFrame:
    """First record of each allele of a germline file, gap dots removed; parts of the catalogue as records."""
    p = read(spark, d, "part").select("p_partkey", F.concat(F.lit("IGHV"), (F.col("p_partkey") % 700).cast("string"), F.lit("*01")).alias("allele"), F.when(F.col("p_size") > 25, "Mus musculus_C57BL/6").otherwise("Homo sapiens").alias("species"))
    text = F.concat(F.lit(">A"), F.col("p_partkey").cast("string"), F.lit("|"), "allele", F.lit("|"), "species", F.lit("|F\nAC..GT\n"), F.lpad(F.conv(F.col("p_partkey").cast("string"), 10, 4), 9, "."))
    path = tables.scratch(spark, "imgt")
    p.coalesce(1).sortWithinPartitions("p_partkey").select(text.alias("value")).write.text(path)
    return fasta.mouse_germline(fasta.read_fasta(spark, [path])).select("allele", "locus", "segment", "sequence")


def legacy_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of a legacy germline file: the allele, with a suffix for the other species."""
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, "Mus spretus").otherwise("Mus musculus").alias("species"), F.when(F.col("p_size") % 5 == 0, "XX").otherwise("TRBV").alias("kind"))
    text = F.concat(F.lit(">A|"), "kind", F.col("p_partkey").cast("string"), F.lit("|"), "species", F.lit("|F\nAC..GT"))
    path = tables.scratch(spark, "legacy")
    p.select(text.alias("value")).write.text(path)
    return fasta.legacy_imgt(fasta.read_fasta(spark, [path])).select("name", "sequence")


def combined_ids(spark: SparkSession, d: str) -> DataFrame:
    """Records of all files of a folder, the number of their file in the sorted list appended to their ids."""
    s = _raw(spark, d).where("cdr3_dna is not null").select(F.col("id").alias("sequence_id"), F.col("cdr3_dna").alias("sequence"))
    path = tables.scratch(spark, "combine")
    K.fasta(s, path)
    files = fasta.list_files(spark, path, (".txt",))
    ids = fasta.file_ids(spark, [f.rsplit("/", 1)[1] for f in files])
    c = fasta.combine(fasta.read_fasta(spark, files), ids)
    return c.select(X.without_suffix("sequence_id").alias("sequence_id"), (X.file_suffix("sequence_id") == F.col("file_id").cast("string")).alias("own_file"), F.col("file_id").between(1001, 1000 + len(files)).alias("listed"))


def folder_layout(spark: SparkSession, d: str) -> DataFrame:
    """Kind, timepoint and group of the files of a study folder with a folder per timepoint."""
    names = [(r["timepoint"], r["sample_file"]) for r in read(spark, d, "sequences").where("timepoint is not null and sample_file is not null").select("timepoint", "sample_file").distinct().collect()]
    root = tables.scratch(spark, "layout")
    for t, f in names:  # one empty file for each file of the study
        fs, p = _fs(spark, f"{root}/{t}/{f}")
        fs.create(p).close()
    kind, files = folders.detect(spark, root)
    layout = files.select(F.lit("Study").alias("group_name"), "timepoint", F.element_at(F.split("filename", "/"), -1).alias("filename"))
    staged = layout.select(F.concat_ws("_", "group_name", "timepoint", "filename").alias("filename"))
    return L.design_from_folders(layout, staged).withColumn("kind", F.lit(kind))


def side_files(spark: SparkSession, d: str) -> DataFrame:
    """A study's file mapping written as a JSON side file, and its rows."""
    m = read(spark, d, "sequences").where("sample_file is not null").groupBy("sample_file").agg(F.min("timepoint").alias("timepoint"))
    path = tables.scratch(spark, "mapping")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample_file", F.struct("timepoint")))))
    m.agg(F.to_json(entries).alias("value")).coalesce(1).write.text(path)
    return tables.timepoint_mapping(spark, tables.read_json(spark, path)).select("filename", "timepoint")


def stage_split(spark: SparkSession, d: str) -> DataFrame:
    """clone_pass as a stage table with a folder per timepoint, read back."""
    c = read(spark, d, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id"), "clone_id", "timepoint").where("sequence_id is not null and timepoint is not null").distinct()
    path = tables.scratch(spark, "stage")
    K.stage(c, path, ["timepoint"])
    return spark.read.parquet(path).select("sequence_id", "clone_id", "timepoint")


def session_results(spark: SparkSession, d: str) -> DataFrame:
    """Result records as JSON lines and as a saved session, both read back."""
    s = seqs(spark, d).select("sequence_id", "v", "shm", "productive")
    path = tables.scratch(spark, "session")
    K.ndjson(s, f"{path}/lines")
    lines = spark.read.schema(s.schema).json(f"{path}/lines")
    tables.save_results({"records": lines}, f"{path}/saved")
    return tables.restore_results(spark, f"{path}/saved")["records"]


def restored_fields(spark: SparkSession, d: str) -> DataFrame:
    """clone_pass with five fields that its step dropped, filled from the sequences."""
    c = read(spark, d, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id"), clean.gene("v_call").alias("v"), clean.present("locus").alias("locus"), "clone_id").where("sequence_id is not null").dropDuplicates(["sequence_id"])
    c = c.withColumn("j", F.lit(None).cast("string")).withColumn("d", F.lit(None).cast("string")).withColumn("clone_id", F.lit(None).cast("long"))
    s = read(spark, d, "sequences").where("id is not null").select(F.col("id").alias("sequence_id"), clean.gene("v_gene").alias("v"), clean.gene("d_gene").alias("d"), clean.gene("j_gene").alias("j"), clean.present("v_locus").alias("locus"), "clone_id")
    return R.fill_nulls(c, s, "sequence_id", ["v", "d", "j", "locus", "clone_id"])


def assembled(spark: SparkSession, d: str) -> DataFrame:
    """Result records of all ids in clone_pass and db_fail: first hits, clone, and whether they are productive."""
    cp = read(spark, d, "clone_pass").withColumn("sequence_id", clean.record_id("sequence_id")).where("sequence_id is not null").dropDuplicates(["sequence_id"])
    bad = read(spark, d, "db_fail").select(clean.record_id("sequence_id").alias("sequence_id")).where("sequence_id is not null").distinct()
    hit = lambda c: F.struct(F.lit(c[0].upper()).alias("chain_type"), clean.gene(c).alias("subject_id"), F.lit("VDJ".index(c[0].upper())).alias("pos"))
    h = read(spark, d, "sequences").where("id is not null").select(F.col("id").alias("query_id"), F.explode(F.array(*[hit(c) for c in ("v_gene", "d_gene", "j_gene")])).alias("h")).select("query_id", "h.*").where("subject_id is not null").distinct()
    ids = cp.select("sequence_id").unionByName(bad).distinct()
    germ = cp.select("sequence_id", F.col("junction_aa").alias("cdr3"))
    return R.assemble(ids, h, germ, cp.select("sequence_id", "clone_id"), bad)


def chosen_clones(spark: SparkSession, d: str) -> DataFrame:
    """The clones that cohort_clones names, with size and representative."""
    named = read(spark, d, "cohort_clones").select(clean.name_key("cohort_name").alias("cohort"), "clone_id").where("cohort is not null and clone_id is not null").distinct()
    return M.top_clones(seqs(spark, d), 0, ["cohort", "clone_id"], chosen=named)


def _trees(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "clone_pass").where("clone_id is not null and cohort_name is not null and timepoint is not null").select(clean.record_id("sequence_id").alias("sequence_id"), F.col("cohort_name").alias("cohort"), "timepoint", "clone_id").where("sequence_id is not null").distinct()
    n = c.groupBy("cohort", "timepoint", "clone_id").agg(F.count(F.lit(1)).alias("clone_size")).where("clone_size >= 3")
    return n.withColumn("path", F.concat_ws("/", F.lit("trees"), "cohort", "timepoint", F.concat(F.col("clone_id").cast("string"), F.lit(".nwk"))))


def tree_files(spark: SparkSession, d: str) -> DataFrame:
    """File of every tree, as the tree sheet has it."""
    return K.tree_metadata(_trees(spark, d))


def clone_tree_choice(spark: SparkSession, d: str) -> DataFrame:
    """For every clone and timepoint in sequences its tree: that timepoint's, else the largest."""
    s = seqs(spark, d).where("clone_id is not null and timepoint is not null and cohort is not null").select("cohort", "clone_id", "timepoint").distinct()
    return R.best_tree(s, _trees(spark, d), ["cohort", "clone_id"])


def tree_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Place of every tree in its cohort: timepoints in natural order, larger clones first."""
    t = _trees(spark, d).withColumn("__k", X.natural_key("timepoint"))
    w = Window.partitionBy("cohort").orderBy("__k", F.desc("clone_size"), "clone_id")
    return t.select("cohort", "timepoint", "clone_id", F.row_number().over(w).alias("place"))


def browser_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Place of every row in its sample file as the browser lists it: clones first, larger ones before."""
    n = seqs(spark, d).select("sequence_id", "sample_file", "clone_id")
    size = n.where("clone_id is not null").groupBy("sample_file", "clone_id").agg(F.count(F.lit(1)).alias("clone_count"))
    w = Window.partitionBy("sample_file").orderBy(*R.browser_keys())
    return n.join(size, ["sample_file", "clone_id"], "left").where("sample_file is not null").select("sequence_id", F.row_number().over(w).alias("place"))


def pair_mutations(spark: SparkSession, d: str) -> DataFrame:
    """Differing places of the CDR3s of every recorded clone match, none where their lengths differ."""
    c = read(spark, d, "cohort_clones").groupBy("clone_key").agg(F.max(clean.upper_text("cdr3_aa")).alias("t")).where("t is not null")
    m = read(spark, d, "clone_matches").select("match_id", "clone_key_a", "clone_key_b")
    j = m.join(c.select(F.col("clone_key").alias("clone_key_a"), F.col("t").alias("a")), "clone_key_a").join(c.select(F.col("clone_key").alias("clone_key_b"), F.col("t").alias("b")), "clone_key_b")
    return j.select("match_id", X.shm("a", "b").alias("mutations")).distinct()


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """Truth values, default ids, tip labels and tree leaves of every sequence."""
    s = read(spark, d, "sequences").where("id is not null").select("id", "seq_name", "v_locus", F.col("productive").cast("string").alias("p")).distinct()
    tree = F.concat(F.lit("("), F.regexp_replace("id", "[^A-Za-z0-9_]", "-"), F.lit(":0.5,tip:1e-3)0.9;"))
    return s.select("id", clean.truth("p").alias("truth"), X.default_id("seq_name", "id", "v_locus").alias("named"), X.clean_label("id").alias("label"), F.array_join(X.newick_leaves(tree), "|").alias("leaves"))


def sheet_titles(spark: SparkSession, d: str) -> DataFrame:
    """Sheet names of the study's files."""
    titles = [r[0] for r in read(spark, d, "sequences").where("sample_file is not null").select(F.concat("sample_file", F.lit(": rows / clones")).alias("t")).distinct().orderBy("t").collect()]
    return spark.createDataFrame(sorted(K.sheet_names(titles).items()), "title string, name string")


def dynamics_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the clones of each cohort, a column per timepoint."""
    from vdjlake.plans.base import ord_of

    s = seqs(spark, d).where("clone_id is not null and cohort is not null").withColumn("ord", ord_of()).where("ord is not null")
    n = s.groupBy("cohort", "clone_id", "ord").agg(F.count(F.lit(1)).alias("size")).withColumn("frequency", F.col("size").cast("double"))
    sheet = K.dynamics_sheets(n, ["cohort", "clone_id"], n)["Clone sizes"]
    return sheet.select("cohort", "clone_id", *[(F.col(str(i)) if str(i) in sheet.columns else F.lit(None).cast("long")).alias(f"t{i}") for i in range(4)])


QUERIES = {
    f.__name__: f
    for f in (
        tenx_contigs, airr_cells, tag_counts, report_hits, constant_hits, constant_genes, antibody_reference, germline_alleles, legacy_names, combined_ids, folder_layout, side_files, stage_split,
        session_results, restored_fields, assembled, chosen_clones, tree_files, clone_tree_choice, tree_ranks, browser_ranks, pair_mutations, text_forms, sheet_titles, dynamics_sheet,
    )
}

_HAS = f"lower(trim({{0}})) NOT IN {MISSING}"


def _p(c: str) -> str:
    return f"any_value(CASE WHEN {_HAS.format(c)} THEN trim({c}) END) AS {c}"


_R = f"""raw AS (SELECT id, any_value(sample_file) AS sample_file, any_value(timepoint) AS timepoint, {', '.join(map(_p, ('v_gene', 'd_gene', 'j_gene', 'v_locus', 'c_call', 'cdr3_dna', 'aa_sequence')))},
  any_value(clone_count) AS clone_count, any_value(somatic_mutations) AS shm, any_value(productive) AS productive, any_value(cohort_name) AS cohort_name, any_value(clone_id) AS clone_id FROM sequences WHERE deleted_at IS NULL AND id IS NOT NULL GROUP BY id)"""
_CID = "CASE WHEN starts_with(trim(sequence_id), 'reversed|') THEN trim(substr(trim(sequence_id), 10)) ELSE trim(sequence_id) END"
_TX = f"{_R}, tx AS (SELECT id AS contig_id, coalesce(v_locus, 'None') AS chain, CAST(coalesce(clone_count, 0) AS INT) AS umis, c_call AS c_gene FROM raw WHERE productive)"
_BH = "bh AS (SELECT id AS query_id, c_call AS c_gene FROM raw WHERE c_call IS NOT NULL AND shm IS NOT NULL AND 100 - shm >= 80)"
_TR = f"""tr AS (SELECT cohort, timepoint, clone_id, count(*) AS clone_size, 'trees/' || cohort || '/' || timepoint || '/' || clone_id || '.nwk' AS path
  FROM (SELECT DISTINCT {_CID} AS sid, cohort_name AS cohort, timepoint, clone_id FROM clone_pass WHERE clone_id IS NOT NULL AND cohort_name IS NOT NULL AND timepoint IS NOT NULL AND {_CID} <> '') x GROUP BY 1, 2, 3 HAVING count(*) >= 3)"""

SQL = {
    "tenx_contigs": f"WITH {_TX} SELECT * FROM tx",
    "airr_cells": f"WITH {_R} SELECT id AS cell_id, CASE WHEN length(id) % 2 = 0 THEN id ELSE id || '_' || v_locus END AS sequence_id, v_locus AS locus FROM raw WHERE aa_sequence IS NOT NULL AND v_locus IN ('IGH', 'IGK', 'IGL') AND productive",
    "tag_counts": "SELECT DISTINCT 'tag' || c_nationkey AS \"Sample_Tag\" FROM customer WHERE c_nationkey NOT IN (3, 7)",
    "report_hits": f"WITH {_R} SELECT id AS query_id, cdr3_dna, shm AS mutations, split_part(v_gene, ',', 1) AS v, split_part(j_gene, ',', 1) AS j FROM raw",
    "constant_hits": f"WITH {_R}, {_BH} SELECT * FROM bh",
    "constant_genes": f"""WITH {_TX}, {_BH}, c AS (SELECT DISTINCT {_CID} AS sequence_id FROM clone_pass WHERE {_CID} <> '')
SELECT sequence_id, coalesce(tx.c_gene, CASE WHEN raw.v_locus = 'IGH' THEN 'IGHM' END, bh.c_gene, '') AS c_call FROM c LEFT JOIN tx ON tx.contig_id = sequence_id LEFT JOIN raw ON raw.id = sequence_id LEFT JOIN bh ON bh.query_id = sequence_id""",
    "antibody_reference": "SELECT DISTINCT antibody_name, " + ", ".join(f"coalesce(CASE WHEN {_HAS.format(c)} THEN trim({c}) END, '') AS {c}" for c in ("ab_or_nb", "binds_to", "neutralizes", "origin", "vh_sequence", "v_gene", "j_gene", "cdr3_sequence")) + " FROM antibodies WHERE antibody_name IS NOT NULL",
    "germline_alleles": """WITH p AS (SELECT 'IGHV' || (p_partkey % 700) || '*01' AS allele, min(p_partkey) AS k FROM part WHERE p_size > 25 GROUP BY 1),
d AS (SELECT allele, k, (SELECT string_agg(CAST((k // CAST(power(4, i) AS BIGINT)) % 4 AS VARCHAR), '' ORDER BY i DESC) FROM range(0, 30) r(i) WHERE power(4, i) <= k) AS b FROM p)
SELECT allele, 'IGH' AS locus, 'V' AS segment, 'ACGT' || b AS sequence FROM d""",
    "legacy_names": "SELECT 'TRBV' || p_partkey || CASE WHEN p_size > 40 THEN '_spretus' ELSE '' END AS name, 'ACGT' AS sequence FROM part WHERE p_size % 5 <> 0",
    "combined_ids": f"WITH {_R} SELECT id AS sequence_id, true AS own_file, true AS listed FROM raw WHERE cdr3_dna IS NOT NULL",
    "folder_layout": "SELECT DISTINCT 'Study_' || timepoint || '_' || sample_file AS filename, 'Study' AS group_name, timepoint, 'folders' AS kind FROM sequences WHERE timepoint IS NOT NULL AND sample_file IS NOT NULL",
    "side_files": "SELECT sample_file AS filename, min(timepoint) AS timepoint FROM sequences WHERE sample_file IS NOT NULL GROUP BY 1",
    "stage_split": f"SELECT DISTINCT {_CID} AS sequence_id, clone_id, timepoint FROM clone_pass WHERE {_CID} <> '' AND timepoint IS NOT NULL",
    "session_results": f"WITH {S} SELECT sequence_id, v, shm, productive FROM s",
    "restored_fields": f"""WITH c AS (SELECT {_CID} AS sequence_id, any_value({gene_sql('v_call')}) AS v, any_value(CASE WHEN {_HAS.format('locus')} THEN trim(locus) END) AS locus FROM clone_pass WHERE {_CID} <> '' GROUP BY 1),
q AS (SELECT id, min({gene_sql('v_gene')}) AS v, min({gene_sql('d_gene')}) AS d, min({gene_sql('j_gene')}) AS j, min(CASE WHEN {_HAS.format('v_locus')} THEN trim(v_locus) END) AS locus, min(clone_id) AS clone_id FROM sequences WHERE id IS NOT NULL GROUP BY 1)
SELECT sequence_id, coalesce(c.v, q.v) AS v, q.d, q.j, coalesce(c.locus, q.locus) AS locus, q.clone_id FROM c LEFT JOIN q ON q.id = c.sequence_id""",
    "assembled": f"""WITH c AS (SELECT {_CID} AS sequence_id, any_value(junction_aa) AS cdr3, any_value(clone_id) AS clone_id FROM clone_pass WHERE {_CID} <> '' GROUP BY 1), b AS (SELECT DISTINCT {_CID} AS sequence_id FROM db_fail WHERE {_CID} <> ''),
q AS (SELECT id, any_value({gene_sql('v_gene')}) AS v, any_value({gene_sql('d_gene')}) AS d, any_value({gene_sql('j_gene')}) AS j FROM sequences WHERE id IS NOT NULL GROUP BY 1), i AS (SELECT sequence_id FROM c UNION SELECT sequence_id FROM b)
SELECT i.sequence_id, q.v AS v_gene, q.d AS d_gene, q.j AS j_gene, c.cdr3, b.sequence_id IS NULL AS productive, CASE WHEN b.sequence_id IS NULL THEN c.clone_id END AS clone_id FROM i LEFT JOIN c USING (sequence_id) LEFT JOIN b USING (sequence_id) LEFT JOIN q ON q.id = i.sequence_id""",
    "chosen_clones": f"""WITH {S}, n AS (SELECT DISTINCT lower(trim(cohort_name)) AS cohort, clone_id FROM cohort_clones WHERE clone_id IS NOT NULL AND {_HAS.format('cohort_name')})
SELECT s.cohort, s.clone_id, count(*) AS size, min(sequence_id) AS representative FROM s JOIN n ON n.cohort = s.cohort AND n.clone_id = s.clone_id GROUP BY 1, 2""",
    "tree_files": f"WITH {_TR} SELECT cohort, timepoint, clone_id, clone_size, clone_id || '.nwk' AS file FROM tr",
    "clone_tree_choice": f"""WITH {S}, {_TR}, k AS (SELECT DISTINCT cohort, clone_id, timepoint FROM s WHERE clone_id IS NOT NULL AND timepoint IS NOT NULL AND cohort IS NOT NULL)
SELECT cohort, clone_id, timepoint, path, tree_size FROM (SELECT k.cohort, k.clone_id, k.timepoint, tr.path, tr.clone_size AS tree_size, row_number() OVER (PARTITION BY k.cohort, k.clone_id, k.timepoint ORDER BY (k.timepoint = tr.timepoint) DESC, tr.clone_size DESC, tr.path DESC) AS r FROM k JOIN tr ON tr.cohort = k.cohort AND tr.clone_id = k.clone_id) x WHERE r = 1""",
    "tree_ranks": f"WITH {_TR} SELECT cohort, timepoint, clone_id, row_number() OVER (PARTITION BY cohort ORDER BY lower(regexp_replace(timepoint, '[0-9]+', '', 'g')), CAST(nullif(regexp_extract(timepoint, '([0-9]+)', 1), '') AS BIGINT) NULLS FIRST, timepoint, clone_size DESC, clone_id) AS place FROM tr",
    "browser_ranks": f"""WITH {S}, z AS (SELECT sample_file, clone_id, count(*) AS n FROM s WHERE clone_id IS NOT NULL GROUP BY 1, 2)
SELECT sequence_id, row_number() OVER (PARTITION BY s.sample_file ORDER BY s.clone_id IS NULL, z.n DESC NULLS LAST, s.clone_id NULLS LAST, sequence_id) AS place FROM s LEFT JOIN z ON z.sample_file = s.sample_file AND z.clone_id = s.clone_id WHERE s.sample_file IS NOT NULL""",
    "pair_mutations": f"""WITH c AS (SELECT clone_key, max(CASE WHEN {_HAS.format('cdr3_aa')} THEN upper(trim(cdr3_aa)) END) AS t FROM cohort_clones GROUP BY 1)
SELECT DISTINCT match_id, CASE WHEN length(a.t) = length(b.t) THEN (SELECT count(*) FROM range(1, length(a.t) + 1) r(i) WHERE substr(a.t, i, 1) <> substr(b.t, i, 1) AND substr(a.t, i, 1) NOT IN ('.', 'N') AND substr(b.t, i, 1) NOT IN ('.', 'N')) END AS mutations
FROM clone_matches m JOIN c a ON a.clone_key = m.clone_key_a JOIN c b ON b.clone_key = m.clone_key_b WHERE a.t IS NOT NULL AND b.t IS NOT NULL""",
    "text_forms": """SELECT DISTINCT id, coalesce(productive, false) AS truth, coalesce(CASE WHEN trim(seq_name) <> '' THEN seq_name END, concat_ws('_', id, v_locus)) AS named, trim(regexp_replace(regexp_replace(id, '\\|\\|\\|.*$', ''), '[_ ][0-9]+$', '')) AS label,
  regexp_replace(id, '[^A-Za-z0-9_]', '-', 'g') || '|tip' AS leaves FROM sequences WHERE id IS NOT NULL""",
    "sheet_titles": """WITH t AS (SELECT DISTINCT sample_file || ': rows / clones' AS title FROM sequences WHERE sample_file IS NOT NULL) SELECT title, left(trim(regexp_replace(title, '[\\\\/*?:\\[\\]]', '_', 'g')), 31) AS name FROM t""",
    "dynamics_sheet": f"WITH {S} SELECT cohort, clone_id, " + ", ".join(f"nullif(count(*) FILTER (WHERE timepoint = '{t}'), 0) AS t{i}" for i, t in enumerate(("day0", "day14", "day42", "endpoint"))) + " FROM s WHERE clone_id IS NOT NULL AND cohort IS NOT NULL AND timepoint IN ('day0', 'day14', 'day42', 'endpoint') GROUP BY 1, 2",
}
