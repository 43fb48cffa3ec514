"""Hand-computed values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from vdjlake.functions import clean
from vdjlake.functions import sequence as X


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, expected",
    [(" IGHV3-49*01 ,IGHV3-57*02", "IGHV3-49"), ("ighv1-2 (Human)", "IGHV1-2"), ("nan", None), ("ND", None), ("", None), ("  ", None), (None, None)],
)
def test_gene(spark, text, expected):
    df = spark.createDataFrame([(text,)], "a string")
    assert df.select(clean.gene("a")).first()[0] == expected


@pytest.mark.parametrize("text, expected", [(" reversed|AB_1 ", "AB_1"), ("AB_1 ", "AB_1"), ("", None), (None, None), ("reversed|", None)])
def test_record_id(spark, text, expected):
    assert spark.createDataFrame([(text,)], "a string").select(clean.record_id("a")).first()[0] == expected


def test_cdr3_core(spark):
    df = spark.createDataFrame([("CARDYW",), (" cardyw ",), ("ARDY",), ("CAW",), ("None",)], "a string")
    assert [r[0] for r in df.select(clean.cdr3_core("a")).collect()] == ["ARDY", "ARDY", "ARDY", None, None]


def test_translate(spark):
    df = spark.createDataFrame([("ATGGCNTAAGCT",), ("atg-gct",), ("AT",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(X.translate("a")).collect()] == ["MX", "MA", "", "", None]


def test_imgt_and_identity(spark):
    df = spark.createDataFrame([("CARDYW", "CARDFW"), ("CF", "CF"), ("AB", "ABC"), ("", "")], "a string, b string")
    got = df.select(X.imgt_cdr3("a"), X.hamming("a", "b"), F.round(X.hamming_similarity("a", "b"), 6), F.round(X.identity_percent("a", "b"), 3)).collect()
    assert [tuple(r) for r in got] == [("ARDY", 1, 0.833333, 83.333), ("", 0, 1.0, 100.0), ("AB", None, 0.0, 0.0), ("", 0, 0.0, 0.0)]


def test_aa_similarity(spark):
    df = spark.createDataFrame([("CARW", "CARW"), ("CARDYWW", "CARD"), ("", "A"), (None, "A")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(X.aa_similarity("a", "b")).collect()] == [1.0, 0.357143, 0.0, 0.0]


def test_shm_and_alignment(spark):
    df = spark.createDataFrame([("A.CNGT", "ATCAGA"), ("AC", "ACG"), ("A-C", "AGC")], "a string, b string")
    assert [r[0] for r in df.select(X.shm("a", "b")).collect()] == [1, None, 1]
    r = df.select(X.alignment("a", "b")).collect()[1][0]
    assert (r["query"], r["marks"], r["target"], r["matches"], r["length"]) == ("AC-", "|| ", "ACG", 2, 3)


def test_families_and_labels(spark):
    df = spark.createDataFrame([("ighv3-49*01",)], "a string")
    got = df.select(X.v_family("a"), X.j_family(F.lit("IGHJ4*02")), X.j_family(F.lit("IGKJ1")), X.ig_class(F.lit("ighg2b")), X.ig_class(F.lit("x")), X.chain(F.lit("IGLV1")), X.locus_code(F.lit("IGHV3-49*01"))).first()
    assert tuple(got) == ("IGHV3", "IGHJ4", None, "IgG", None, "Lambda", "VH3-49")
    got = df.select(X.file_suffix(F.lit("a_contig_2_1001")), X.without_suffix(F.lit("a_1001")), X.slug(F.lit(" Day 0/A ")), X.slug(F.lit("--")), X.clip(F.lit("abcdef"), 3), X.clean_label(F.lit("x|||9_2")), X.patient(F.lit("T1_P1_day0.fasta"), F.lit("day0"))).first()
    assert tuple(got) == ("1001", "a", "day-0-a", "item", "abc...", "x", "P1")


def test_small_ones(spark):
    got = spark.range(1).select(X.content(F.lit("ac-nG")), X.is_protein(F.lit("ACGNT")), X.is_protein(F.lit("MKV")), X.region(F.lit("ABCDEF"), F.lit(2), F.lit(4)), X.fixed(F.lit(1.5), 2), X.stars(F.lit(0.004)), X.p_text(F.lit(0.0001)), X.default_id(F.lit(" "), F.lit("c1"), F.lit("IGH"))).first()
    assert tuple(got) == ("ACG", False, True, "BCD", "1.50", "**", "<0.001", "c1_IGH")
    assert spark.range(1).select(X.newick_leaves(F.lit("((a:0.1,b:2e-3):1,c_1);"))).first()[0] == ["a", "b", "c_1"]
    df = spark.createDataFrame([("day10",), ("day2",), ("base",)], "a string")
    assert [r[0] for r in df.orderBy(X.natural_key("a")).collect()] == ["base", "day2", "day10"]
