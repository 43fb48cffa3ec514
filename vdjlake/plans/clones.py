"""Queries of clone calling, lineages, cohort clusters, matching and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vdjlake.functions import clean
from vdjlake.functions import sequence as X
from vdjlake.operators import lineages as C
from vdjlake.operators import matching as M
from vdjlake.operators import rows as R
from vdjlake.operators import sharing as P
from vdjlake.operators import trees
from vdjlake.plans.base import MISSING, V_FAMILY, S, gene_sql, seqs, upper_sql
from vdjlake.session import read, table

SC = ["cohort", "timepoint"]


def _junctions(spark: SparkSession, d: str) -> DataFrame:
    """Distinct records of clone_pass with gene, length and letters of their junction."""
    c = read(spark, d, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id"), F.col("cohort_name").alias("cohort"), "timepoint", "locus", clean.gene("v_call").alias("v"), clean.letters("junction").alias("junction"), "dist_nearest", "clone_id")
    return c.where("sequence_id is not null").dropDuplicates(["sequence_id"]).withColumn("n", F.length("junction"))


def _called(spark: SparkSession, d: str) -> DataFrame:
    """The records of :func:`_junctions` with the J gene of their sequence."""
    j = read(spark, d, "sequences").where("id is not null").groupBy(F.col("id").alias("sequence_id")).agg(F.max(clean.gene("j_gene")).alias("j"))
    return _junctions(spark, d).join(j, "sequence_id", "left")


def clone_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent V, J and CDR3 of each clone and timepoint."""
    return C.clone_profiles(seqs(spark, d), SC)


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return clone_profiles(spark, d).withColumn("profile", F.concat_ws("/", "cohort", "timepoint", F.col("clone").cast("string")))


def lineage_edges(spark: SparkSession, d: str) -> DataFrame:
    """Linked profiles of different timepoints of a cohort."""
    return C.lineage_edges(_profiles(spark, d), ["cohort"])


def lineage_ids(spark: SparkSession, d: str) -> DataFrame:
    """Lineage of every profile: the smallest profile linked to it."""
    return C.lineages(_profiles(spark, d), ["cohort"]).select("profile", "lineage")


def lineage_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.lineage_summary(C.lineages(_profiles(spark, d), ["cohort"]), ["cohort"])


def global_clone_ids(spark: SparkSession, d: str) -> DataFrame:
    """Clone ids that are unique within a cohort over its timepoints."""
    return C.global_clone_ids(seqs(spark, d), ["cohort"]).select("sequence_id", "global_clone")


def cohort_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One row per cohort clone."""
    return C.cohort_rollup(seqs(spark, d))


def _cohort_clones(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "cohort_clones").where("clone_key is not null").select("clone_key", clean.name_key("cohort_name").alias("cohort"), clean.upper_text("cdr3_aa").alias("cdr3"), clean.gene("v_gene").alias("v"), clean.gene("j_gene").alias("j"), F.col("sequence_count").alias("rows"))
    return c.groupBy("clone_key").agg(*[F.max(x).alias(x) for x in ("cohort", "cdr3", "v", "j", "rows")])


def cohort_edges(spark: SparkSession, d: str) -> DataFrame:
    """Cohort clones of one V and J family with CDR3s that differ in a tenth at most."""
    return C.cohort_edges(_cohort_clones(spark, d), "clone_key")


def cohort_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Members of clusters that reach two cohorts or more."""
    return C.cohort_clusters(_cohort_clones(spark, d), "clone_key").select("clone_key", "cluster", "cohort")


def cluster_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = C.cluster_rollup(C.cohort_clusters(_cohort_clones(spark, d), "clone_key"))
    return r.select("cluster", F.array_join("cohorts", "|").alias("cohorts"), "clones", "rows", "cdr3s")


def cluster_cohort_top(spark: SparkSession, d: str) -> DataFrame:
    return C.cluster_cohort_top(C.cohort_clusters(_cohort_clones(spark, d), "clone_key"))


def exact_cluster_sets(spark: SparkSession, d: str) -> DataFrame:
    """Clusters whose cohorts are exactly the two largest ones' names."""
    r = C.cluster_rollup(C.cohort_clusters(_cohort_clones(spark, d), "clone_key"))
    return R.exact_set(r, "cohorts", ["prime_boost", "knockin_b7"]).select("cluster", "clones")


def single_link_clones(spark: SparkSession, d: str) -> DataFrame:
    """Clones of the junctions of a V and J gene at 10 % of the length."""
    return C.single_link_clones(_called(spark, d), ["cohort", "v", "j"], "junction", "sequence_id", 0.10)


def linkage_clones(spark: SparkSession, d: str) -> DataFrame:
    """The same by average linkage."""
    return C.linkage_clones(_called(spark, d), ["cohort", "v", "j"], "junction", "sequence_id", 0.10, "average")


def gene_groups(spark: SparkSession, d: str) -> DataFrame:
    """V genes of clone_pass, those that records of a cohort list together being one."""
    c = read(spark, d, "clone_pass").select(clean.record_id("sequence_id").alias("sequence_id"), F.col("cohort_name").alias("cohort"), clean.present("v_call").alias("v_call")).where("sequence_id is not null").dropDuplicates(["sequence_id"])
    return C.gene_groups(c, ["cohort"], "v_call", "v").select("sequence_id", "v")


def nearest_distance(spark: SparkSession, d: str) -> DataFrame:
    """Least distance to another junction of the V gene, J gene and length, null where there is none."""
    return C.nearest_distance(_called(spark, d), ["cohort", "v", "j"], "junction", "sequence_id")


def distance_histogram(spark: SparkSession, d: str) -> DataFrame:
    return C.distance_histogram(R.valid_distance(_junctions(spark, d)), "dist_nearest", ["cohort"])


def distance_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Density threshold per timepoint."""
    return C.thresholds(R.valid_distance(_junctions(spark, d)), "dist_nearest", "timepoint")


def distance_density(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of the distances of each timepoint on 512 places."""
    return C.density_curve(R.valid_distance(_junctions(spark, d)), "dist_nearest", "timepoint")


def cluster_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Clusters across cohorts with their rows per cohort."""
    from vdjlake.sinks import tables as K

    m = C.cohort_clusters(_cohort_clones(spark, d), "clone_key")
    r = C.cluster_rollup(m).withColumn("cohorts", F.array_join("cohorts", "|"))
    return K.cluster_sheets(r, m)["Lineages"]


def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Greedy leader clusters of CDR3s within two edits, by V and J gene."""
    return P.leader_clusters(seqs(spark, d), ["v", "j"])


def cluster_sharing(spark: SparkSession, d: str) -> DataFrame:
    """Leader clusters that span two sample files or more."""
    m = P.leader_clusters(seqs(spark, d), ["v", "j"], keep=["sample_file", "cdr3"]).select("leader", "sample_file", "cdr3")
    return P.cluster_sharing(table(m, "members"), "leader", "sample_file", "cdr3")


def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Vectors within a cosine distance of 0.05 of each other, by single linkage."""
    return C.embedding_clusters(read(spark, d, "embeddings"), "vec_id", "embedding", 0.05)


def profile_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Junctions whose word profiles lie within a cosine distance of 0.02, by cohort and genes, with the size of their cluster."""
    j = _called(spark, d).where("cohort is not null and v is not null and j is not null and junction is not null and not junction rlike '[^ACGT]' and length(junction) >= 3")
    c = C.embedding_clusters(j.withColumn("profile", C.kmer_profile("junction")), "sequence_id", "profile", 0.02, ["cohort", "v", "j"])
    return C.cluster_sizes(c).select("sequence_id", "cluster", "size")


def _antibodies(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "antibodies").where("antibody_name is not null")
    return a.groupBy("antibody_name").agg(F.max(clean.upper_text("vh_sequence")).alias("ref_vh"), F.max(X.imgt_cdr3(clean.upper_text("cdr3_sequence"))).alias("ref_cdr3"))


def _top(spark: SparkSession, d: str) -> DataFrame:
    """The twenty largest clones with the CDR3 and VH of their representative."""
    s = seqs(spark, d)
    t = M.top_clones(s, 20, ["cohort", "clone_id"]).withColumn("clone", F.concat_ws("/", "cohort", F.col("clone_id").cast("string")))
    return t.select("clone", "size", F.col("representative").alias("sequence_id")).join(s.select("sequence_id", "timepoint", "vh", X.imgt_cdr3("cdr3").alias("cdr3_core")), "sequence_id")


def top_clones(spark: SparkSession, d: str) -> DataFrame:
    return M.top_clones(seqs(spark, d), 20, ["cohort", "clone_id"])


def vh_matches(spark: SparkSession, d: str) -> DataFrame:
    """Twenty closest equally long VH references of each of the largest clones."""
    return M.length_matches(_top(spark, d), _antibodies(spark, d), "clone", "vh", "antibody_name", "ref_vh", M.VH_LONGER)


def cdr3_matches(spark: SparkSession, d: str) -> DataFrame:
    return M.length_matches(_top(spark, d), _antibodies(spark, d), "clone", "cdr3_core", "antibody_name", "ref_cdr3", M.CDR3_LONGER)


def match_stats(spark: SparkSession, d: str) -> DataFrame:
    return M.match_stats(_top(spark, d), vh_matches(spark, d), cdr3_matches(spark, d), "clone", high=60.0)


def identity_bands(spark: SparkSession, d: str) -> DataFrame:
    return M.identity_bands(vh_matches(spark, d))


def match_stats_by_timepoint(spark: SparkSession, d: str) -> DataFrame:
    """Best CDR3 match of every clone's representative, per cohort and timepoint with an All row."""
    m = cdr3_matches(spark, d).where("rank = 1").join(_top(spark, d).select("clone", "timepoint"), "clone").withColumn("cohort", F.substring_index("clone", "/", 1))
    return M.stats_by_timepoint(m, ["cohort"], high=40.0)


def content_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of equal junction content in each clone of clone_pass."""
    j = _junctions(spark, d).where("clone_id is not null")
    return R.content_counts(j, ["cohort", "clone_id"], "junction")


def top_consistent(spark: SparkSession, d: str) -> DataFrame:
    """The largest clones of clone_pass with a single V call."""
    return R.top_consistent(_junctions(spark, d).where("clone_id is not null"), ["cohort", "clone_id"], "v", 20, 3)


def clone_trees(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour-joining trees of the largest consistent clones."""
    j = _junctions(spark, d).where("clone_id is not null and junction is not null")
    return trees.clone_trees(R.align_union(j.join(top_consistent(spark, d), ["cohort", "clone_id"], "left_semi")), ["cohort", "clone_id"], "junction", "sequence_id")


QUERIES = {
    f.__name__: f
    for f in (
        clone_profiles, lineage_edges, lineage_ids, lineage_summary, global_clone_ids, cohort_rollup, cohort_edges, cohort_clusters, cluster_rollup, cluster_cohort_top, exact_cluster_sets,
        single_link_clones, linkage_clones, gene_groups, nearest_distance, distance_histogram, distance_thresholds, distance_density, cluster_sheet, leader_clusters, cluster_sharing, embedding_clusters, profile_clusters,
        top_clones, vh_matches, cdr3_matches, match_stats, identity_bands, match_stats_by_timepoint, content_counts, top_consistent, clone_trees,
    )
}

_J = f"""jn AS (SELECT *, length(junction) AS n FROM (SELECT sid AS sequence_id, any_value(cohort_name) AS cohort, any_value(timepoint) AS timepoint, any_value({gene_sql('v_call')}) AS v,
  any_value(nullif(regexp_replace(upper(CASE WHEN lower(trim(junction)) NOT IN {MISSING} THEN junction END), '[^A-Z]', '', 'g'), '')) AS junction, any_value(dist_nearest) AS dist_nearest, any_value(clone_id) AS clone_id
  FROM (SELECT *, CASE WHEN starts_with(trim(sequence_id), 'reversed|') THEN trim(substr(trim(sequence_id), 10)) ELSE trim(sequence_id) END AS sid FROM clone_pass) y WHERE sid <> '' GROUP BY sid) x)"""

_JJ = f"{_J}, jg AS (SELECT id, max({gene_sql('j_gene')}) AS j FROM sequences WHERE id IS NOT NULL GROUP BY id), jj AS (SELECT jn.*, jg.j FROM jn LEFT JOIN jg ON jg.id = jn.sequence_id)"


def _mode(c: str) -> str:
    return f"m_{c} AS (SELECT cohort, timepoint, clone_id, {c} FROM (SELECT cohort, timepoint, clone_id, {c}, row_number() OVER (PARTITION BY cohort, timepoint, clone_id ORDER BY count(*) DESC, {c}) AS r FROM s WHERE clone_id IS NOT NULL AND {c} IS NOT NULL GROUP BY 1, 2, 3, 4) x WHERE r = 1)"


_P = f"""{S}, {_mode('v')}, {_mode('j')}, {_mode('cdr3')},
p AS (SELECT k.cohort, k.timepoint, k.clone_id AS clone, k.size, m_v.v, m_j.j, m_cdr3.cdr3, concat_ws('/', k.cohort, k.timepoint, k.clone_id) AS profile
  FROM (SELECT cohort, timepoint, clone_id, count(*) AS size FROM s WHERE clone_id IS NOT NULL GROUP BY 1, 2, 3) k
  LEFT JOIN m_v ON m_v.cohort = k.cohort AND m_v.timepoint = k.timepoint AND m_v.clone_id = k.clone_id LEFT JOIN m_j ON m_j.cohort = k.cohort AND m_j.timepoint = k.timepoint AND m_j.clone_id = k.clone_id
  LEFT JOIN m_cdr3 ON m_cdr3.cohort = k.cohort AND m_cdr3.timepoint = k.timepoint AND m_cdr3.clone_id = k.clone_id)"""
_LE = f"""{_P}, le AS (SELECT a.cohort, a.profile AS a, b.profile AS b, CAST(hamming(a.cdr3, b.cdr3) AS INT) AS distance FROM p a JOIN p b ON a.cohort = b.cohort AND a.v = b.v AND a.j = b.j AND length(a.cdr3) = length(b.cdr3) AND a.profile < b.profile AND a.timepoint <> b.timepoint
  WHERE hamming(a.cdr3, b.cdr3) <= floor(length(a.cdr3) * (1 - 0.85) + 1e-9))"""


def _closure(edges: str, a: str = "a", b: str = "b", out: str = "comp") -> str:
    return f"""sym AS (SELECT {a} AS x, {b} AS y FROM {edges} UNION SELECT {b}, {a} FROM {edges}),
reach AS (SELECT x AS node, x AS root FROM sym UNION SELECT sym.y, reach.root FROM reach JOIN sym ON sym.x = reach.node WHERE reach.root < sym.y),
{out} AS (SELECT node, min(root) AS component FROM reach GROUP BY node)"""


_LIN = f"{_LE}, {_closure('le')}, lin AS (SELECT p.*, coalesce(comp.component, p.profile) AS lineage FROM p LEFT JOIN comp ON comp.node = p.profile)"
_CC = f"""cc AS (SELECT clone_key, max(nullif(lower(trim(cohort_name)), '')) AS cohort, max({upper_sql('cdr3_aa')}) AS cdr3, max({gene_sql('v_gene')}) AS v, max({gene_sql('j_gene')}) AS j, max(sequence_count) AS rows FROM cohort_clones WHERE clone_key IS NOT NULL GROUP BY clone_key),
cf AS (SELECT *, {V_FAMILY.format('v')} AS vf, nullif(regexp_extract(j, '^(IGHJ[0-9]+)', 1), '') AS jf FROM cc),
ce AS (SELECT a.clone_key AS a, b.clone_key AS b, CAST(hamming(a.cdr3, b.cdr3) AS INT) AS distance FROM cf a JOIN cf b ON a.vf = b.vf AND a.jf = b.jf AND length(a.cdr3) = length(b.cdr3) AND a.clone_key < b.clone_key
  WHERE hamming(a.cdr3, b.cdr3) <= greatest(1, ceil(0.10 * length(a.cdr3) - 1e-9)))"""
_CL = f"""{_CC}, {_closure('ce')}, mem AS (SELECT cc.*, comp.component AS cluster FROM cc JOIN comp ON comp.node = cc.clone_key WHERE comp.component IN (SELECT component FROM comp JOIN cc ON cc.clone_key = comp.node GROUP BY 1 HAVING count(DISTINCT cohort) >= 2))"""
_TOP = f"""{S}, top AS (SELECT cohort, clone_id, count(*) AS size, min(sequence_id) AS representative FROM s WHERE cohort IS NOT NULL AND clone_id IS NOT NULL GROUP BY 1, 2 ORDER BY size DESC, cohort, clone_id LIMIT 20),
q AS (SELECT concat_ws('/', top.cohort, top.clone_id) AS clone, s.timepoint, s.vh, regexp_replace(regexp_replace(s.cdr3, '^C', ''), '[WF]$', '') AS cdr3_core FROM top JOIN s ON s.sequence_id = top.representative),
ab AS (SELECT antibody_name, max({upper_sql('vh_sequence')}) AS ref_vh, max(regexp_replace(regexp_replace({upper_sql('cdr3_sequence')}, '^C', ''), '[WF]$', '')) AS ref_cdr3 FROM antibodies GROUP BY 1)"""


def _hits(text: str, ref: str, longer: int, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT clone, antibody_name, identity, CAST(row_number() OVER (PARTITION BY clone ORDER BY identity DESC, antibody_name) AS INT) AS rank FROM (
  SELECT q.clone, ab.antibody_name, (length({text}) - hamming({text}, {ref})) / CAST(length({text}) AS DOUBLE) * 100 AS identity FROM q JOIN ab ON length({text}) = length({ref}) AND length({text}) > {longer}) x) y WHERE rank <= 20)"""


_VH, _C3 = _hits("vh", "ref_vh", 10, "hv"), _hits("cdr3_core", "ref_cdr3", 3, "hc")

SQL = {
    "clone_profiles": f"WITH {_P} SELECT cohort, timepoint, clone, size, v, j, cdr3 FROM p",
    "lineage_edges": f"WITH {_LE} SELECT * FROM le",
    "lineage_ids": f"WITH RECURSIVE {_LIN} SELECT profile, lineage FROM lin",
    "lineage_summary": f"WITH RECURSIVE {_LIN} SELECT cohort, count(*) AS lineages, count(*) FILTER (WHERE t > 1) AS cross_timepoint FROM (SELECT cohort, lineage, count(DISTINCT timepoint) AS t FROM lin GROUP BY 1, 2) x GROUP BY 1",
    "global_clone_ids": f"""WITH {S}, k AS (SELECT cohort, timepoint, max(clone_id) + 1 AS span FROM s WHERE clone_id IS NOT NULL GROUP BY 1, 2),
o AS (SELECT cohort, timepoint, coalesce(sum(span) OVER (PARTITION BY cohort ORDER BY timepoint ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM k)
SELECT sequence_id, CAST(clone_id + shift AS BIGINT) AS global_clone FROM s LEFT JOIN o ON o.cohort = s.cohort AND o.timepoint = s.timepoint""",
    "cohort_rollup": f"""WITH {S} SELECT cohort, clone_id AS clone, (array_agg(cdr3 ORDER BY coalesce(length(cdr3), -1) DESC, sequence_id))[1] AS cdr3, (array_agg(v ORDER BY v IS NULL, sequence_id))[1] AS v, (array_agg(j ORDER BY j IS NULL, sequence_id))[1] AS j,
  count(DISTINCT sample_file) AS samples, count(*) AS rows FROM s WHERE clone_id IS NOT NULL AND cohort IS NOT NULL GROUP BY 1, 2""",
    "cohort_edges": f"WITH {_CC} SELECT * FROM ce",
    "cohort_clusters": f"WITH RECURSIVE {_CL} SELECT clone_key, cluster, cohort FROM mem",
    "cluster_rollup": f"WITH RECURSIVE {_CL} SELECT cluster, (SELECT string_agg(c, '|' ORDER BY c) FROM (SELECT DISTINCT cohort AS c FROM mem m2 WHERE m2.cluster = mem.cluster) x) AS cohorts, count(*) AS clones, CAST(sum(rows) AS BIGINT) AS rows, count(DISTINCT cdr3) AS cdr3s FROM mem GROUP BY cluster",
    "cluster_cohort_top": f"WITH RECURSIVE {_CL}, n AS (SELECT cluster, cohort, cdr3, sum(rows) AS n FROM mem GROUP BY 1, 2, 3) SELECT cluster, cohort, CAST(sum(n) AS BIGINT) AS rows, (array_agg(cdr3 ORDER BY n DESC, cdr3))[1] AS top_cdr3 FROM n GROUP BY 1, 2",
    "exact_cluster_sets": f"WITH RECURSIVE {_CL} SELECT cluster, count(*) AS clones FROM mem GROUP BY 1 HAVING count(DISTINCT cohort) = 2 AND bool_and(cohort IN ('prime_boost', 'knockin_b7'))",
    "single_link_clones": f"""WITH RECURSIVE {_JJ}, u AS (SELECT cohort, v, j, junction, min(sequence_id) AS rep FROM jj WHERE cohort IS NOT NULL AND v IS NOT NULL AND j IS NOT NULL AND junction IS NOT NULL GROUP BY 1, 2, 3, 4),
e AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.cohort = b.cohort AND a.v = b.v AND a.j = b.j AND length(a.junction) = length(b.junction) AND a.rep < b.rep AND hamming(a.junction, b.junction) <= floor(0.10 * length(a.junction) + 1e-9)), {_closure('e')}
SELECT jj.sequence_id, coalesce(comp.component, u.rep) AS clone FROM jj JOIN u ON u.cohort = jj.cohort AND u.v = jj.v AND u.j = jj.j AND u.junction = jj.junction LEFT JOIN comp ON comp.node = u.rep""",
    "nearest_distance": f"""WITH {_JJ}, u AS (SELECT DISTINCT cohort, v, j, junction FROM jj WHERE cohort IS NOT NULL AND v IS NOT NULL AND j IS NOT NULL AND junction IS NOT NULL),
m AS (SELECT a.cohort, a.v, a.j, a.junction, min(hamming(a.junction, b.junction)) AS d FROM u a JOIN u b ON a.cohort = b.cohort AND a.v = b.v AND a.j = b.j AND length(a.junction) = length(b.junction) AND a.junction <> b.junction GROUP BY 1, 2, 3, 4)
SELECT jj.sequence_id, m.d / CAST(length(jj.junction) AS DOUBLE) AS nearest FROM jj LEFT JOIN m ON m.cohort = jj.cohort AND m.v = jj.v AND m.j = jj.j AND m.junction = jj.junction WHERE jj.cohort IS NOT NULL AND jj.v IS NOT NULL AND jj.j IS NOT NULL AND jj.junction IS NOT NULL""",
    "gene_groups": f"""WITH RECURSIVE r AS (SELECT sid AS sequence_id, any_value(cohort_name) AS cohort, any_value(CASE WHEN lower(trim(v_call)) NOT IN {MISSING} THEN trim(v_call) END) AS c
  FROM (SELECT *, CASE WHEN starts_with(trim(sequence_id), 'reversed|') THEN trim(substr(trim(sequence_id), 10)) ELSE trim(sequence_id) END AS sid FROM clone_pass) y WHERE sid <> '' GROUP BY sid),
x AS (SELECT sequence_id, cohort, list_filter(list_transform(string_split(c, ','), lambda t: regexp_extract(upper(trim(t)), '^([^*(\\s]+)', 1)), lambda g: g <> '') AS gs FROM r),
p AS (SELECT DISTINCT cohort, gs[1] AS g, unnest(gs) AS h FROM x WHERE len(gs) > 1 AND cohort IS NOT NULL),
sym AS (SELECT cohort, g, h FROM p UNION SELECT cohort, h, g FROM p),
reach AS (SELECT cohort, g AS node, g AS root FROM sym UNION SELECT sym.cohort, sym.h, reach.root FROM reach JOIN sym ON sym.cohort = reach.cohort AND sym.g = reach.node),
comp AS (SELECT cohort, node, min(root) AS least FROM reach GROUP BY 1, 2)
SELECT sequence_id, coalesce(comp.least, gs[1]) AS v FROM x LEFT JOIN comp ON comp.cohort = x.cohort AND comp.node = x.gs[1]""",
    "distance_histogram": f"WITH {_J}, v AS (SELECT cohort, CAST(least(floor(dist_nearest * 50), 49) AS INT) AS bin FROM jn WHERE dist_nearest > 0 AND dist_nearest <= 1 AND NOT isnan(dist_nearest)) SELECT cohort, bin, bin / 50.0 AS low, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY cohort) AS DOUBLE) * 50 AS density FROM v GROUP BY cohort, bin",
    "top_clones": f"WITH {_TOP} SELECT * FROM top",
    "vh_matches": f"WITH {_TOP}, {_VH} SELECT * FROM hv",
    "cdr3_matches": f"WITH {_TOP}, {_C3} SELECT * FROM hc",
    "antibody_bands": f"WITH {_TOP}, {_VH} SELECT clone, antibody_name, identity FROM hv WHERE clone IN (SELECT concat_ws('/', cohort, clone_id) FROM s WHERE timepoint = 'day14' AND cohort IS NOT NULL AND clone_id IS NOT NULL)",
    "match_stats": f"WITH {_TOP}, {_VH}, {_C3}, b AS (SELECT q.clone, (SELECT max(identity) FROM hv WHERE hv.clone = q.clone) AS vh, (SELECT max(identity) FROM hc WHERE hc.clone = q.clone) AS cdr3 FROM q) SELECT count(*) AS analysed, count(vh) AS with_vh, count(cdr3) AS with_cdr3, count(*) FILTER (WHERE greatest(vh, cdr3) >= 60) AS high FROM b",
    "identity_bands": f"WITH {_TOP}, {_VH} SELECT CASE WHEN identity >= 95 THEN '>=95' WHEN identity >= 90 THEN '90-94' WHEN identity >= 80 THEN '80-89' ELSE '<80' END AS band, count(*) AS n FROM hv GROUP BY 1",
    "match_stats_by_timepoint": f"""WITH {_TOP}, {_C3}, b AS (SELECT split_part(q.clone, '/', 1) AS cohort, q.timepoint, hc.identity FROM hc JOIN q ON q.clone = hc.clone WHERE rank = 1)
SELECT cohort, CASE WHEN grouping(timepoint) = 1 THEN 'All' ELSE timepoint END AS timepoint, count(*) AS n, count(*) FILTER (WHERE identity >= 40) AS high, count(*) FILTER (WHERE identity >= 40) / CAST(count(*) AS DOUBLE) * 100 AS percent_high FROM b GROUP BY GROUPING SETS ((cohort), (cohort, timepoint))""",
    "content_counts": f"WITH {_J} SELECT cohort, clone_id, replace(junction, 'N', '') AS content, count(*) AS n FROM jn WHERE clone_id IS NOT NULL AND junction IS NOT NULL GROUP BY 1, 2, 3",
    "top_consistent": f"WITH {_J} SELECT cohort, clone_id, count(*) AS size FROM jn WHERE clone_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT v) <= 1 AND count(*) >= 3 ORDER BY size DESC, cohort, clone_id LIMIT 20",
    "profile_clusters": f"""WITH RECURSIVE {_JJ}, q AS (SELECT cohort, v, j, junction, min(sequence_id) AS k FROM jj WHERE cohort IS NOT NULL AND v IS NOT NULL AND j IS NOT NULL AND length(junction) >= 3 AND NOT regexp_matches(junction, '[^ACGT]') GROUP BY ALL),
w AS (SELECT x || y || z AS w FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS x) a, (SELECT unnest(['A', 'C', 'G', 'T']) AS y) b, (SELECT unnest(['A', 'C', 'G', 'T']) AS z) c),
o AS (SELECT k, substr(junction, i, 3) AS w, count(*) AS n FROM q, range(1, length(junction) - 1) r(i) GROUP BY ALL),
p AS (SELECT q.k, any_value(cohort) AS cohort, any_value(v) AS v, any_value(j) AS j, any_value(junction) AS junction, list(CAST(coalesce(n, 0) AS DOUBLE) ORDER BY w.w) AS u FROM q CROSS JOIN w LEFT JOIN o ON o.k = q.k AND o.w = w.w GROUP BY q.k),
e AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.cohort = b.cohort AND a.v = b.v AND a.j = b.j AND a.k < b.k AND 1 - list_cosine_similarity(a.u, b.u) <= 0.02), {_closure('e')},
m AS (SELECT jj.sequence_id, coalesce(comp.component, q.k) AS cluster FROM jj JOIN q ON q.cohort = jj.cohort AND q.v = jj.v AND q.j = jj.j AND q.junction = jj.junction LEFT JOIN comp ON comp.node = q.k)
SELECT sequence_id, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM m""",
    "embedding_clusters": f"""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= 0.05), {_closure('e')}
SELECT vec_id, coalesce(component, vec_id) AS cluster FROM embeddings LEFT JOIN comp ON node = vec_id""",
}
