"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vdjlake.functions import clean
from vdjlake.llm import components, entity_match, near_duplicates, overlaps, packing, percentiles, subjects, tokens
from vdjlake.session import read

# ---- p1: near-duplicate junctions


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of groups of nearly equal junctions, each with the group's smallest sequence_id."""
    v = read(spark, sf_dir, "sequences").select("id", clean.gene("v_gene").alias("v")).where("id is not null and v is not null").distinct()
    c = read(spark, sf_dir, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id"), "cohort_name", clean.letters("junction").alias("nt"), clean.letters("junction_aa").alias("aa"))
    records = c.where("sequence_id is not null").join(v, F.col("sequence_id") == F.col("id")).drop("id")  # repeated rows count once there
    groups = near_duplicates.near_duplicates(records, "sequence_id", ["cohort_name", "v"], "nt", "aa")
    return groups.where("group_id <> sequence_id").select(F.col("group_id").alias("sequence_id_a"), F.col("sequence_id").alias("sequence_id_b"))


# ---- p3: pairwise matches to groups


def _clones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``clone_key, cdr3``: one row per clone."""
    c = read(spark, sf_dir, "cohort_clones").where("clone_key is not null")
    return c.groupBy("clone_key").agg(F.max(clean.upper_text("cdr3_aa")).alias("cdr3"))


def _valid_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches whose ends exist, are equally long and differ in at most a tenth, rounded up."""
    c = _clones(spark, sf_dir)
    m = read(spark, sf_dir, "clone_matches").where("clone_key_a <> clone_key_b").select("clone_key_a", "clone_key_b", "distance").distinct()
    a, b = (c.select(F.col("clone_key").alias(f"clone_key_{x}"), F.col("cdr3").alias(f"cdr3_{x}")) for x in "ab")
    j = m.join(a, "clone_key_a").join(b, "clone_key_b").where("length(cdr3_a) = length(cdr3_b)")
    differs = F.aggregate(F.zip_with(F.split("cdr3_a", ""), F.split("cdr3_b", ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return j.where(F.coalesce(F.col("distance"), differs) <= F.ceil(F.length("cdr3_a") / F.lit(10))).select("clone_key_a", "clone_key_b")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clones linked directly or indirectly, under the smallest clone_key of their group."""
    groups = components.components(_valid_links(spark, sf_dir), "clone_key_a", "clone_key_b")
    return groups.where("node <> component").select(F.col("component").alias("group_key"), F.col("node").alias("clone_key"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clone with its cluster id: the smallest clone_key it is linked to, or its own."""
    groups = components.components(_valid_links(spark, sf_dir), "clone_key_a", "clone_key_b")
    return _clones(spark, sf_dir).select("clone_key").join(groups, F.col("clone_key") == F.col("node"), "left").select("clone_key", F.coalesce("component", "clone_key").alias("cluster_id"))


# ---- p4: sequences and antibodies


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sequence and antibody that describe one heavy chain, with rule and confidence."""
    long = lambda c: F.when(F.length(clean.upper_text(c)) > 10, clean.upper_text(c))
    fields = lambda short, text: [clean.cdr3_core(short).alias("short"), long(text).alias("long"), clean.gene("v_gene").alias("n1"), clean.gene("j_gene").alias("n2")]
    s = read(spark, sf_dir, "sequences").select(F.col("id").alias("l"), *fields("cdr3_peptide", "aa_sequence"))
    a = read(spark, sf_dir, "antibodies").select(F.col("antibody_name").alias("r"), *fields("cdr3_sequence", "vh_sequence"))
    m = entity_match.matches(s, a)
    return m.select(F.col("l").alias("id"), F.col("r").alias("antibody_name"), "rule", "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of :func:`p4_matches`."""
    return p4_matches(spark, sf_dir).select("id", "antibody_name")


# ---- p5: overlaps of the mice's CDR3 sets


def _mouse_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "cohort_clones").select(clean.name_key("cohort_name").alias("cohort"), F.explode("samples").alias("sample"), clean.upper_text("cdr3_aa").alias("cdr3"))
    return c.select(F.concat("cohort", F.lit("/"), clean.name_key("sample")).alias("s"), "cdr3")  # null where either part is


def p5_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared CDR3s of every pair of mice that share any, with both set sizes."""
    return overlaps.overlaps(_mouse_sets(spark, sf_dir), "s", "cdr3")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of mice that share at least a fifth of the smaller set."""
    return p5_overlaps(spark, sf_dir).where(F.col("shared") * 5 >= F.least("size_a", "size_b")).select("set_a", "set_b")


# ---- p7: percentiles of mutation counts


def _mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "sequences")
    value = F.when(F.col("somatic_mutations") >= 0, F.col("somatic_mutations"))
    return percentiles.once(s.select("id", "sample_file", "loaded_at", value.alias("shm")), "id", "sample_file", "shm", F.to_date("loaded_at"))


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each sample file, merged from one sketch per file and day."""
    parts = percentiles.sketches(_mutations(spark, sf_dir), ["grp", "part"])
    p = percentiles.percentiles(percentiles.merged(parts, ["grp"]), ["grp"], [0.05, 0.25, 0.5, 0.75, 0.95, 0.99])
    return p.withColumnRenamed("grp", "sample_file")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose latest median_shm is more than 2.5 off the median of their mutations."""
    d = read(spark, sf_dir, "diversity").where("sample_file is not null and median_shm is not null and not isnan(median_shm)")
    latest = d.groupBy(F.col("sample_file").alias("grp")).agg(F.max_by("median_shm", F.struct("computed_at", "median_shm")).alias("stated"))
    return percentiles.median_deviations(_mutations(spark, sf_dir), latest, 2.5).select(F.col("grp").alias("sample_file"))


# ---- p8: token ids


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k, without special tokens."""
    return tokens.encode(read(spark, sf_dir, "documents"), "doc_id", "text")


# ---- p9: containers of 2,048 tokens


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.searched(tokens.count_tokens(read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "tokens", 2048)


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's container of 2,048 tokens."""
    return _packed(spark, sf_dir).drop("moved", "began")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, the fewest possible, the share of space used, and the containers that the search emptied."""
    return packing.report(_packed(spark, sf_dir))


# ---- p10: subject areas


def _subjects(spark: SparkSession, sf_dir: str) -> list[str]:
    return [r["subject"] for r in read(spark, sf_dir, "subject_areas").where("subject is not null").groupBy("subject").agg(F.min("subject_id").alias("i")).orderBy("i").collect()]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document: those of at least a quarter of its sentences."""
    return subjects.subjects_of(read(spark, sf_dir, "documents"), read(spark, sf_dir, "subject_labels"), _subjects(spark, sf_dir), 0.25)


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject, and their part of all documents that have any."""
    found = p10_found(spark, sf_dir)
    n = found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return n.select("subject", "documents", (F.col("documents") / F.sum("documents").over(Window.partitionBy())).alias("share"))


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p4_found": p4_found,
    "p4_matches": p4_matches,
    "p5_found": p5_found,
    "p5_overlaps": p5_overlaps,
    "p7_found": p7_found,
    "p7_percentiles": p7_percentiles,
    "p8_ids": p8_ids,
    "p9_containers": p9_containers,
    "p9_report": p9_report,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}

_MISS = "lower(trim(x)) IN ('', 'nan', 'none', 'nd')"

_LINKS = """
c AS (SELECT clone_key, max(CASE WHEN lower(trim(cdr3_aa)) NOT IN ('', 'nan', 'none', 'nd') THEN upper(trim(cdr3_aa)) END) AS cdr3 FROM cohort_clones GROUP BY clone_key),
l AS (
  SELECT DISTINCT clone_key_a AS a, clone_key_b AS b FROM clone_matches m JOIN c ca ON ca.clone_key = m.clone_key_a JOIN c cb ON cb.clone_key = m.clone_key_b
  WHERE clone_key_a <> clone_key_b AND length(ca.cdr3) = length(cb.cdr3)
    AND coalesce(m.distance, hamming(ca.cdr3, cb.cdr3)) <= ceil(length(ca.cdr3) / 10.0)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.node WHERE reach.root < e.b),
g AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""

_SETS = """
m AS (
  SELECT DISTINCT lower(trim(cohort_name)) || '/' || lower(trim(s)) AS s, upper(trim(cdr3_aa)) AS i
  FROM (SELECT cohort_name, cdr3_aa, unnest(samples) AS s FROM cohort_clones) x
  WHERE lower(trim(s)) NOT IN ('', 'nan', 'none', 'nd') AND lower(trim(cohort_name)) NOT IN ('', 'nan', 'none', 'nd') AND lower(trim(cdr3_aa)) NOT IN ('', 'nan', 'none', 'nd')
), z AS (SELECT s, count(*) AS n FROM m GROUP BY s),
o AS (
  SELECT a.s AS set_a, b.s AS set_b, count(*) AS shared, any_value(za.n) AS size_a, any_value(zb.n) AS size_b
  FROM m a JOIN m b ON a.i = b.i AND a.s < b.s JOIN z za ON za.s = a.s JOIN z zb ON zb.s = b.s GROUP BY a.s, b.s
)"""

SQL = {
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT component AS group_key, node AS clone_key FROM g WHERE node <> component",
    "p3_clusters": f"WITH RECURSIVE {_LINKS} SELECT c.clone_key, coalesce(g.component, c.clone_key) AS cluster_id FROM c LEFT JOIN g ON g.node = c.clone_key",
    "p5_found": f"WITH {_SETS} SELECT set_a, set_b FROM o WHERE shared * 5 >= least(size_a, size_b)",
    "p5_overlaps": f"WITH {_SETS} SELECT * FROM o",
    "p7_found": """
WITH v AS (SELECT id, any_value(sample_file) AS f, any_value(CASE WHEN somatic_mutations >= 0 THEN somatic_mutations END) AS x FROM sequences WHERE id IS NOT NULL GROUP BY id),
m AS (SELECT f, median(x) AS med FROM v GROUP BY f),
d AS (SELECT sample_file, arg_max(median_shm, computed_at) AS stated FROM diversity WHERE median_shm IS NOT NULL AND NOT isnan(median_shm) GROUP BY sample_file)
SELECT sample_file FROM d JOIN m ON m.f = d.sample_file WHERE abs(med - stated) > 2.5""",
}
