"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjlake.functions import clean
from vdjlake.functions import sequence as X
from vdjlake.plans.base import IG_CLASS, MISSING, V_FAMILY, gene_sql
from vdjlake.session import read


def gene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes, families, classes, chains and locus codes of every sequence row."""
    s = read(spark, sf_dir, "sequences").where("id is not null")
    v = F.trim(F.substring_index("v_gene", ",", 1))
    return s.select(
        "id",
        clean.gene("v_gene").alias("v"),
        X.strip_allele("v_gene").alias("no_allele"),
        X.v_family(clean.gene("v_gene")).alias("family"),
        X.j_family("j_gene").alias("jfam"),
        X.ig_class("c_call").alias("class"),
        X.chain(clean.gene("v_gene")).alias("chain"),
        X.locus_code(v).alias("code"),
    ).distinct()


def dna_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translated CDR3s, their content form and IMGT form."""
    s = read(spark, sf_dir, "sequences").where("id is not null and cdr3_dna is not null").select("id", "cdr3_dna", "cdr3_peptide").distinct()
    return s.select("id", X.content("cdr3_dna").alias("content"), X.imgt_cdr3(clean.upper_text("cdr3_peptide")).alias("imgt"), X.is_protein("cdr3_dna").alias("protein"), F.length(X.translate("cdr3_dna")).alias("aa_length"))


def junction_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junctions with length frame and letters; the region from the fourth letter to the last but three."""
    c = read(spark, sf_dir, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id"), clean.letters("junction").alias("nt")).where("sequence_id is not null and nt is not null").distinct()
    return c.select("sequence_id", F.length("nt").alias("n"), (F.length("nt") % 3 == 0).alias("in_frame"), X.region("nt", F.lit(4), F.length("nt") - 3).alias("inner"))


def id_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File suffix, id without it and a clipped label of every id."""
    s = read(spark, sf_dir, "sequences").where("id is not null").select("id", "cdr3_peptide", "sample_file", "timepoint").distinct()
    return s.select(
        "id",
        X.file_suffix("id").alias("file_id"),
        X.without_suffix("id").alias("clean_id"),
        X.clip(clean.upper_text("cdr3_peptide"), 10).alias("label"),
        X.slug("sample_file").alias("slug"),
        X.patient("sample_file", "timepoint").alias("patient"),
    )


def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities of the CDR3s of every recorded clone match."""
    c = read(spark, sf_dir, "cohort_clones").groupBy("clone_key").agg(F.max(clean.upper_text("cdr3_aa")).alias("t")).where("t is not null")
    m = read(spark, sf_dir, "clone_matches").select("match_id", "clone_key_a", "clone_key_b")
    j = m.join(c.select(F.col("clone_key").alias("clone_key_a"), F.col("t").alias("a")), "clone_key_a").join(c.select(F.col("clone_key").alias("clone_key_b"), F.col("t").alias("b")), "clone_key_b")
    return j.select(
        "match_id",
        X.hamming("a", "b").alias("hamming"),
        X.hamming_similarity("a", "b").alias("hamming_similarity"),
        X.identity_percent("a", "b").alias("identity"),
        F.levenshtein("a", "b").alias("levenshtein"),
        X.aa_similarity("a", "b").alias("aa_similarity"),
        X.alignment("a", "b")["matches"].alias("aligned_matches"),
    )


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of each event's JSON, and the JSON of two of its fields."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", X.from_json("props", "k long")["k"].alias("k"), X.to_json("event_id", "event_type").alias("json"), X.fixed("value", 2).alias("value_text"))


QUERIES = {f.__name__: f for f in (gene_names, dna_translation, junction_frames, id_suffixes, pair_similarity, event_json)}

_SUFFIX = "regexp_extract(id, '_([0-9]+)$', 1)"

SQL = {
    "gene_names": f"""
SELECT DISTINCT id, v, CASE WHEN v_gene IS NULL THEN NULL WHEN strpos(v_gene, '*') > 0 THEN left(v_gene, strpos(v_gene, '*') - 1) ELSE v_gene END AS no_allele,
  {V_FAMILY.format('v')} AS family, nullif(regexp_extract(j_gene, '^(IGHJ[0-9]+)', 1), '') AS jfam, {IG_CLASS.format('c_call')} AS class,
  CASE WHEN v LIKE 'IGH%' THEN 'Heavy' WHEN v LIKE 'IGK%' THEN 'Kappa' WHEN v LIKE 'IGL%' THEN 'Lambda' WHEN strpos(v, 'L') > 0 THEN 'Lambda' WHEN strpos(v, 'K') > 0 THEN 'Kappa' ELSE 'Heavy' END AS chain,
  CASE WHEN length(g) > 4 AND strpos(g, '*') > 0 THEN substr(g, 4, 1) || substr(g, 3, 1) || substr(g, 5, strpos(g, '*') - 5) END AS code
FROM (SELECT id, v_gene, j_gene, c_call, {gene_sql('v_gene')} AS v, trim(split_part(v_gene, ',', 1)) AS g FROM sequences WHERE id IS NOT NULL) x""",
    "dna_translation": f"""
SELECT id, replace(replace(upper(cdr3_dna), '-', ''), 'N', '') AS content,
  regexp_replace(regexp_replace(p, '^C', ''), '[WF]$', '') AS imgt, regexp_matches(upper(cdr3_dna), '[^ACGNT]') AS protein,
  coalesce(list_min(list_filter(range(1, n + 1), lambda i: upper(substr(d, (i - 1) * 3 + 1, 3)) IN ('TAA', 'TAG', 'TGA'))) - 1, n) AS aa_length
FROM (SELECT *, length(d) // 3 AS n FROM (
  SELECT DISTINCT id, cdr3_dna, CASE WHEN lower(trim(cdr3_peptide)) NOT IN {MISSING} THEN upper(trim(cdr3_peptide)) END AS p, upper(regexp_replace(cdr3_dna, '[-.\\s]', '', 'g')) AS d
  FROM sequences WHERE id IS NOT NULL AND cdr3_dna IS NOT NULL) y) x""",
    "junction_frames": f"""
SELECT sequence_id, length(nt) AS n, length(nt) % 3 = 0 AS in_frame, substr(nt, 4, greatest(length(nt) - 6, 0)) AS "inner" FROM (
  SELECT DISTINCT CASE WHEN starts_with(trim(sequence_id), 'reversed|') THEN trim(substr(trim(sequence_id), 10)) ELSE trim(sequence_id) END AS sequence_id,
    nullif(regexp_replace(upper(CASE WHEN lower(trim(junction)) NOT IN {MISSING} THEN junction END), '[^A-Z]', '', 'g'), '') AS nt FROM clone_pass) x
WHERE sequence_id <> '' AND nt IS NOT NULL""",
    "id_suffixes": f"""
SELECT id, nullif({_SUFFIX}, '') AS file_id, regexp_replace(id, '_[0-9]+$', '') AS clean_id,
  CASE WHEN length(p) > 10 THEN left(p, 10) || '...' ELSE p END AS label,
  coalesce(nullif(regexp_replace(regexp_replace(lower(sample_file), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'item') AS slug,
  CASE WHEN ends_with(b, '_' || timepoint) THEN left(b, length(b) - length(timepoint) - 1) ELSE b END AS patient
FROM (SELECT DISTINCT id, sample_file, timepoint, CASE WHEN lower(trim(cdr3_peptide)) NOT IN {MISSING} THEN upper(trim(cdr3_peptide)) END AS p,
        regexp_replace(regexp_replace(sample_file, '^T[0-9]+_', ''), '\\.(fasta|fa|csv|tsv)$', '') AS b FROM sequences WHERE id IS NOT NULL) x""",
    "pair_similarity": f"""
WITH c AS (SELECT clone_key, max(CASE WHEN lower(trim(cdr3_aa)) NOT IN {MISSING} THEN upper(trim(cdr3_aa)) END) AS t FROM cohort_clones GROUP BY clone_key),
p AS (SELECT match_id, a.t AS a, b.t AS b, length(a.t) AS la, length(b.t) AS lb, greatest(length(a.t), length(b.t)) AS l FROM clone_matches JOIN c a ON a.clone_key = clone_key_a JOIN c b ON b.clone_key = clone_key_b WHERE a.t IS NOT NULL AND b.t IS NOT NULL),
d AS (SELECT *, CASE WHEN la = lb THEN CAST(hamming(a, b) AS INT) END AS h, levenshtein(a, b) AS lev,
  (SELECT count(*) FROM range(1, least(la, lb) + 1) r(i) WHERE substr(a, i, 1) = substr(b, i, 1)) AS m FROM p)
SELECT match_id, h AS hamming, coalesce(1 - h / CAST(la AS DOUBLE), 0.0) AS hamming_similarity, coalesce((la - h) / CAST(la AS DOUBLE) * 100, 0.0) AS identity, lev AS levenshtein,
  greatest(0.0, 1 - (lev / CAST(l AS DOUBLE) + CASE WHEN abs(la - lb) > 2 THEN abs(la - lb) / CAST(l AS DOUBLE) ELSE 0.0 END * 0.5)) AS aa_similarity, m AS aligned_matches
FROM d""",
    "event_json": """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS json, printf('%.2f', value) AS value_text FROM events""",
}
