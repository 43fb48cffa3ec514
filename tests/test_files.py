"""Sources, sinks and the stream extension on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from vdjlake.operators import dynamics
from vdjlake.sinks import tables as K
from vdjlake.sources import aligner, fasta, folders, tables


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
        return f"file://{p}"

    write.root = f"file://{tmp_path}"
    return write


def test_fasta(spark, put, rows):
    put("a/one.fasta", ">s1 note\nACGT\nacgt\n\n>s2_contig_2\nGG\n")
    put("a/two.fa", ">s3\r\nTT\r\nAA\r\n")
    put("a/.hidden.fasta", ">no\nA\n")
    put("a/else.txt", "x")
    df = fasta.read_fasta(spark, put.root + "/a")
    assert rows(df.select("sequence_id", "sequence", "filename"), "sequence_id") == [("s1", "ACGTacgt", "one.fasta"), ("s2_contig_2", "GG", "one.fasta"), ("s3", "TTAA", "two.fa")]
    ids = fasta.file_ids(spark, ["one.fasta", "two.fa"])
    assert [r["sequence_id"] for r in fasta.combine(df, ids).orderBy("sequence_id").collect()] == ["s1_1001", "s2_contig_2_1001", "s3_1002"]
    assert [r[0] for r in fasta.sorted_by_name(df).select("sequence_id").collect()] == ["s1", "s2_contig_2", "s3"]
    with pytest.raises(FileNotFoundError):
        put("empty/x.txt", "")
        fasta.read_fasta(spark, put.root + "/empty")


def test_germline(spark, put, rows):
    p = put("g.fasta", ">M1|IGHV1-1*01|Mus musculus_B6|F|x\nA.C.G\n>M2|IGHV1-1*01|Mus musculus|F|x\nTTT\n>M3|IGHG1*01|Mus musculus|F|\nCC\n>M4|IGHV9*01|Mus spretus|F|\nGG\n>plain\nAA\n>one|pipe\nTT\n>H|IGHJ4*01|Homo sapiens|F|\nAC\n")
    r = fasta.read_fasta(spark, [p])
    c = fasta.clean_imgt(r)
    assert sorted(x["allele"] for x in c.collect()) == ["IGHG1*01", "IGHJ4*01", "IGHV1-1*01", "IGHV1-1*01", "IGHV9*01", "one", "plain"]
    assert rows(fasta.mouse_germline(r), "allele") == [("IGHG1*01", "IGH", "C", "CC"), ("IGHV1-1*01", "IGH", "V", "ACG")]
    assert "IGHV9*01_spretus" in [x["name"] for x in fasta.legacy_imgt(r).collect()]
    a = put("x.aux", "# comment\nIGHJ1*01\t0\tJH\t18\t1\nIGKJ2*01 1 JK 6\n")
    assert rows(fasta.aux_table(spark, a), "allele") == [("IGHJ1*01", 0, "JH", 18, 1), ("IGKJ2*01", 1, "JK", 6, None)]


def test_airr(spark, put):
    head = "\t".join(tables.AIRR_REQUIRED)
    body = "\n".join([head, "c1\tB\tIGH\tTRUE\ts1\tACGT", "c2\tB\tIGK", 'c3\tT\tIGH\tt\ts3\t"q', "c4\tB\tTRB\t1\ts4\tA", "c5\tB\tIGL\tF\t\tA"]) + "\n"
    for p in (put("a.tsv", body), put("b.tsv.gz", gzip.compress(body.encode()))):
        df = tables.read_airr(spark, p)
        assert sorted(r["cell_id"] for r in df.collect()) == ["c1", "c3", "c4", "c5"] == sorted(r["cell_id"] for r in df.select("cell_id").collect())
        from vdjlake.operators.rows import airr_b_cells

        assert [r["cell_id"] for r in airr_b_cells(df).collect()] == ["c1"]
        assert {r["cell_id"]: r["sequence_id"] for r in tables.default_ids(df).collect()}["c5"] == "c5_IGL"
    with pytest.raises(ValueError):
        tables.read_airr(spark, put("c.tsv", "cell_id\tx\n1\t2\n"))


def test_tables(spark, put, rows):
    t = put("t.csv", "#meta\n\nCell_Index,Other,Sample_Tag\n1,x,SampleTag01_mm\n1,x,SampleTag02_mm\n2,x,Multiplet\n")
    tags = tables.read_sample_tags(spark, t)
    assert rows(tags.select("Cell_Index", "Sample_Tag"), "pos") == [("1", "SampleTag01_mm"), ("1", "SampleTag02_mm"), ("2", "Multiplet")]
    from vdjlake.operators.rows import distinct_tags

    assert distinct_tags(tags).count() == 2
    x = put("x.csv", "barcode,contig_id,chain,umis,c_gene\nb,c1,IGH,7,none\nb,c2,IGH,?,IGHM\n")
    assert rows(tables.read_10x(spark, x).select("contig_id", "umis", "c_gene"), "contig_id") == [("c1", 7, None), ("c2", 0, "IGHM")]
    r = put("r.tsv", "sequence_id\tclone_id\tv_call\tdist_nearest\ns1\t3.0\tIGHV1\t0.5\ns2\t\tnan\tx\n")
    assert rows(tables.read_rearrangements(spark, r), "sequence_id") == [("s1", 3, "IGHV1", 0.5), ("s2", None, None, None)]
    h = put("h.tsv", "q\ts1\t79\t90\nq\ts2\t90\t60\n")
    from vdjlake.operators.rows import c_gene_hits

    assert rows(c_gene_hits(tables.read_hits(spark, h))) == [("q", "s2")]
    a = put("a.csv", (",".join(f"h{i}" for i in range(15)) + "\n" + '"A, ""x""",Ab,b,,n,,,o,ND,,v,j,,,AR\n').encode() + b"B\xff,Nb,b,,n,,,o,VH,,v,j,,,None\n")
    got = rows(tables.read_antibodies(spark, a).select("antibody_name", "vh_sequence", "cdr3_sequence"), "antibody_name")
    assert got == [('A, "x"', "", "AR"), ("B", "VH", "")]
    with pytest.raises(ValueError):
        tables.read_antibodies(spark, put("b.csv", "a,b\n1,2\n"))


def test_side_files(spark, put, rows):
    m = put("m.json", json.dumps({"f1.fasta": {"timepoint": "day0", "originalFile": "o"}, "f2.fasta": {"timepoint": "day1"}}))
    mapping = tables.timepoint_mapping(spark, tables.read_json(spark, m))
    assert rows(dynamics.design_from_mapping(mapping).select("timepoint", "ord", "filename"), "ord") == [("day0", 0, "f1.fasta"), ("day1", 1, "f2.fasta")]
    assert rows(tables.file_mapping(spark, {"1001": "a"})) == [(1001, "a")]
    design = tables.study_design(spark, {"groups": [{"id": "g", "name": "G", "timepoints": [{"id": "t", "label": "L", "order": 0, "files": ["a", "b"]}]}], "unassigned": ["c"]})
    new = spark.createDataFrame([("b",), ("d",)], "filename string")
    assert rows(dynamics.reconcile(design, new).select("filename", "group_name"), "filename") == [("b", "G"), ("d", None)]
    layout = spark.createDataFrame([("G", "t0", "a.fa"), ("G", "t1", "b.fa")], "group_name string, timepoint string, filename string")
    staged = spark.createDataFrame([("a.fa",), ("G_t1_b.fa",), ("zz",)], "filename string")
    assert rows(dynamics.design_from_folders(layout, staged), "filename") == [("G_t1_b.fa", "G", "t1"), ("a.fa", "G", "t0"), ("zz", None, None)]


def test_folders(spark, put):
    put("x/a_filtered_contig.fasta", "")
    put("x/a_filtered_annotations.csv", "")
    put("y/a.fasta", "")
    put("z/day0/a.fasta", "")
    kinds = {d: folders.detect(spark, f"{put.root}/{d}") for d in "xyz"}
    assert [kinds[d][0] for d in "xyz"] == ["10x", "flat", "folders"]
    assert kinds["z"][1].first()["timepoint"] == "day0" and kinds["x"][1].first()["annotation_file"] == "a_filtered_annotations.csv"
    put("w/note.txt", "")
    assert folders.detect(spark, put.root + "/w")[0] == "empty"


REPORT = """# IGBLASTN 1.2
# Query: s1 extra
# Sub-region sequence details (nucleotide sequence, translation, start, end)
CDR3\tTGTGCA\tCA\t1\t6
# Alignment summary
Total\tN/A\tN/A\t290\t285\t5\t0\t98.3
# Hit table
# 3 hits found
V\ts1\tIGHV1*01\t98.0\t290\t5\t0\t0\t1\t290\t1\t290\t1e-10\t400\tACG\tACG\t290
V\ts1\tIGHV2*01\t97.0\t290\t5\t0\t0\t1\t290\t1\t290\t1e-10\t400\tACG\tACG\t290
J\ts1\tIGHJ4*01\t100.0\t40\t0\t0\t0\t1\t40\t1\t40\t1e-10\t80\tACG\tACG\t40
# IGBLASTN 1.2
# Query: s2
# 0 hits found
# BLAST processed 2 queries
"""


def test_aligner(spark, put, rows):
    hits, cdr3 = aligner.read_report(spark, put("r.fmt7", REPORT))
    assert rows(hits.select("query_id", "chain_type", "subject_id", "pct_identity", "align_len"), "pos") == [("s1", "V", "IGHV1*01", 98.0, 290), ("s1", "V", "IGHV2*01", 97.0, 290), ("s1", "J", "IGHJ4*01", 100.0, 40)]
    assert len(hits.first()["fields"]) == len(aligner.HIT_COLUMNS)
    assert rows(cdr3, "query_id") == [("s1", "TGTGCA", "CA", 5), ("s2", None, None, None)]
    from vdjlake.operators.rows import first_hits

    assert rows(first_hits(hits).select("chain_type", "subject_id"), "chain_type") == [("J", "IGHJ4*01"), ("V", "IGHV1*01")]
    with pytest.raises(FileNotFoundError):
        aligner.align(hits, ["no-such-program"])


def test_sinks(spark, put, rows, tmp_path):
    df = spark.createDataFrame([("a", 'x,"y"', "t0"), ("b", None, "t1")], "sequence_id string, sequence string, timepoint string")
    K.stage(df, f"{put.root}/st", ["timepoint"])
    assert spark.read.parquet(f"{put.root}/st").count() == 2 and (tmp_path / "st/timepoint=t0").is_dir()
    K.report(df, f"{put.root}/rep", ["sequence_id"])
    assert spark.read.option("header", True).option("escape", '"').csv(f"{put.root}/rep").orderBy("sequence_id").first()["sequence"] == 'x,"y"'
    assert len(list((tmp_path / "rep").glob("*.csv"))) == 1
    K.fasta(df, f"{put.root}/fa", ["timepoint"])
    assert fasta.read_fasta(spark, [f"{put.root}/fa/*"]).count() == 1
    names = K.sheet_names(["a" * 40, "a" * 41, "x/y", "X?Y", ""])
    assert len(set(v.lower() for v in names.values())) == 5 and max(map(len, names.values())) <= 31
    assert set(K.workbook({"One": df, "one": df}, f"{put.root}/wb")) == {"One", "one"}
    K.ndjson(df, f"{put.root}/nd")
    assert tables.read_bundle(spark, f"{put.root}/nd").count() == 2
    tables.save_results({"seqs": df}, f"{put.root}/session")
    assert tables.restore_results(spark, f"{put.root}/session")["seqs"].count() == 2
    grid = spark.createDataFrame([("c", "p1", 2), ("c", "p2", 0)], "clone string, patient string, n int")
    assert [tuple(r) for r in K.shared_sheet(grid, ["clone"]).collect()] == [("c", 2, 0), (None, 2, 0)]


def test_stream(spark, put, tmp_path):
    from vdjlake import streaming

    schema = "id string, clone_id long, loaded_at timestamp"
    spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("c", 2)], "id string, clone_id long").withColumn("loaded_at", F.to_timestamp(F.lit("2025-01-01"))).write.parquet(f"{put.root}/in")
    s = streaming.running_clone_counts(streaming.once_per_id(streaming.sequence_stream(spark, f"{put.root}/in", schema)), ["clone_id"])
    q = s.writeStream.outputMode("append").format("memory").queryName("clone_counts").start()
    q.processAllAvailable()
    q.stop()
    e = streaming.once_per_id(streaming.sequence_stream(spark, f"{put.root}/in", schema))
    q = e.writeStream.outputMode("append").format("memory").queryName("ids_once").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in spark.table("ids_once").collect()) == ["a", "b", "c"]
