"""Registered queries: splits, rankings, set operations, checks, nested data, streams."""

import uuid

from pyspark.sql import functions as F

from tallysieve.operators import checks as V
from tallysieve.operators import evidence as E
from tallysieve.operators import nested as G
from tallysieve.operators import ranking as R
from tallysieve.operators import similarity as S
from tallysieve.operators import splits as L
from tallysieve.plans import fixtures as X
from tallysieve.plans import oracle_base as O
from tallysieve.plans.queries_evidence import r6, rounded
from tallysieve.plans.queries_pairs import DOC_PAIRS, MERGED, _merged
from tallysieve.plans.registry import query
from tallysieve.session import ensure_checkpoint_dir, materialise, shuffled
from tallysieve.sources import inventory as I
from tallysieve.streaming import incremental as ST

WEIGHTS = {"rank_a": 1.0, "rank_b": 2.0, "rank_c": 0.5}


# --- splits ----------------------------------------------------------------


@query("group_split", f"WITH {O.INDEX} SELECT entity_key, group_key, split FROM idx")
def group_split(spark, sf):
    return X.index(spark, sf).select("entity_key", "group_key", "split")


@query("hash_sample", f"""
WITH {O.DEDUP} SELECT entity_key, count_target FROM ded ORDER BY sha256('7|' || entity_key), entity_key LIMIT 1000
""")
def hash_sample(spark, sf):
    return L.hash_sample(X.dedup(spark, sf), 1000, 7, "entity_key").select("entity_key", "count_target")


@query("hash_slice", f"""
WITH {O.DEDUP}, n AS (SELECT entity_key, row_number() OVER (ORDER BY sha256('7|' || entity_key)) - 1 AS i FROM ded)
SELECT entity_key FROM n WHERE i >= 500 AND i < 1500
""")
def hash_slice(spark, sf):
    return L.hash_slice(X.dedup(spark, sf), 500, 1000, 7, "entity_key").select("entity_key")


@query("stratified_sample", f"""
WITH {O.INDEX}, r AS (SELECT split, sample_bucket % 10 AS shard, entity_key,
  row_number() OVER (PARTITION BY split, sample_bucket % 10 ORDER BY sha256('11|' || entity_key), entity_key) AS n FROM idx)
SELECT split, shard, entity_key FROM r WHERE n <= 32
""")
def stratified_sample(spark, sf):
    rows = X.index(spark, sf).select("split", (F.col("sample_bucket") % 10).alias("shard"), "entity_key")
    return L.stratified_sample(rows, ["split", "shard"], 32, 11, "entity_key")


@query("group_holdout", f"""
WITH {O.INDEX}, g AS (SELECT DISTINCT group_key FROM idx),
n AS (SELECT group_key, row_number() OVER (ORDER BY sha256('5|' || group_key)) - 1 AS i, count(*) OVER () AS t FROM g),
h AS (SELECT group_key, i < greatest(1, least(t - 1, round_even(t * 0.2, 0))) AS heldout FROM n)
SELECT idx.group_key, h.heldout, count(*) AS rows FROM idx JOIN h ON h.group_key = idx.group_key GROUP BY idx.group_key, h.heldout
""")
def group_holdout(spark, sf):
    rows = X.index(spark, sf).select("group_key", "entity_key")
    return E.count_by(L.group_holdout(rows, "group_key", 0.2, 5), "group_key", "heldout")


@query("shard_bounds", f"""
WITH {O.DEDUP}, t AS (SELECT count(*) AS n FROM ded), s AS (SELECT unnest(range(7)) AS shard)
SELECT shard, CAST(floor(n * shard / 7.0) AS BIGINT) AS start, CAST(floor(n * (shard + 1) / 7.0) AS BIGINT) AS stop FROM s CROSS JOIN t
""")
def shard_bounds(spark, sf):
    total = X.dedup(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return total.select(F.inline(L.shard_bounds(F.col("n"), 7)))


@query("split_violations", f"""
WITH {O.RAW}, m AS (SELECT entity_key, CASE WHEN historic_hits < 5 THEN 'dev' ELSE 'train' END AS split FROM ev_raw)
SELECT entity_key, count(DISTINCT split) AS splits FROM m GROUP BY entity_key HAVING count(DISTINCT split) > 1
""")
def split_violations(spark, sf):
    rows = X.evidence_raw(spark, sf).select(
        "entity_key", F.when(F.col("historic_hits") < 5, "dev").otherwise("train").alias("split")
    )
    return L.split_violations(rows, "entity_key")


@query("every_nth", f"""
WITH {O.DEDUP}, n AS (SELECT entity_key, row_number() OVER (ORDER BY sha256(entity_key)) - 1 AS row_id FROM ded)
SELECT row_id, entity_key FROM n WHERE row_id % 77 = 0
""")
def every_nth(spark, sf):
    from tallysieve.operators.ordering import hash_row_number

    numbered = hash_row_number(X.dedup(spark, sf), "row_id", F.sha2("entity_key", 256), "entity_key")
    return R.every_nth(numbered, "row_id", 77).select(F.col("row_id").cast("bigint").alias("row_id"), "entity_key")


# --- rankings --------------------------------------------------------------


@query("top50", f"WITH {O.SCORES} SELECT catalog_id, score FROM score_a ORDER BY score DESC, catalog_id LIMIT 50")
def top50(spark, sf):
    return R.top_k(X.scores(spark, sf, "a"), 50)


def pct(name: str) -> str:
    return (f"(SELECT catalog_id, dense_rank() OVER (ORDER BY score) * 1.0 / (SELECT count(DISTINCT score) FROM score_{name}) "
            f"AS rank_{name} FROM score_{name})")


@query("percentile_rank", f"WITH {O.SCORES} SELECT catalog_id, round(rank_b, 6) AS rank_b FROM {pct('b')}")
def percentile_rank(spark, sf):
    return R.percentile_rank(X.scores(spark, sf, "b"), name="rank_b").select("catalog_id", *rounded("rank_b"))


FUSED = f"""WITH {O.SCORES},
fused AS (SELECT p.*, coalesce(rank_a, 0.0) AS rank_a, coalesce(rank_b, 0.0) AS rank_b, coalesce(rank_c, 0.0) AS rank_c,
  (CASE WHEN rank_a IS NULL THEN 0 ELSE 1 END) + (CASE WHEN rank_b IS NULL THEN 0 ELSE 1 END)
    + (CASE WHEN rank_c IS NULL THEN 0 ELSE 1 END) AS sources,
  round((1.0 * coalesce(rank_a, 0.0) + 2.0 * coalesce(rank_b, 0.0) + 0.5 * coalesce(rank_c, 0.0)) / 3.5, 9) AS fusion_score
  FROM score_panel p LEFT JOIN {pct('a')} a ON a.catalog_id = p.catalog_id
  LEFT JOIN {pct('b')} b ON b.catalog_id = p.catalog_id LEFT JOIN {pct('c')} c ON c.catalog_id = p.catalog_id)"""


def _fused(spark, sf):
    ranks = {f"rank_{n}": R.percentile_rank(X.scores(spark, sf, n), name=f"rank_{n}") for n in "abc"}
    fused = R.fuse(X.score_panel(spark, sf), ranks, WEIGHTS)
    return fused.withColumn("fusion_score", F.round("fusion_score", 9))


@query("rank_fusion", f"""{FUSED}
SELECT catalog_id, eligible, sources, {r6('rank_a', 'rank_b', 'rank_c')}, fusion_score,
  row_number() OVER (ORDER BY CASE WHEN eligible THEN 0 ELSE 1 END, fusion_score DESC, catalog_id) AS fusion_rank FROM fused
""")
def rank_fusion(spark, sf):
    return R.eligibility_rank(_fused(spark, sf)).select(
        "catalog_id", "eligible", "sources", *rounded("rank_a", "rank_b", "rank_c"), "fusion_score",
        F.col("fusion_rank").cast("bigint").alias("fusion_rank"),
    )


@query("diverse_shortlist", f"""{FUSED},
capped AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY fusion_score DESC, catalog_id) AS g
  FROM fused WHERE eligible)
SELECT catalog_id, group_key, round(fusion_score, 6) AS fusion_score FROM capped WHERE g <= 5
ORDER BY fusion_score DESC, catalog_id LIMIT 200
""")
def diverse_shortlist(spark, sf):
    order = [F.desc("fusion_score"), F.asc("catalog_id")]
    chosen = R.select_diverse(_fused(spark, sf).where("eligible"), "group_key", 5, 200, order)
    return chosen.select("catalog_id", "group_key", *rounded("fusion_score"))


@query("series_portfolio", DOC_PAIRS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {O.SCORES},
sym AS (SELECT a AS x, b AS y FROM edge UNION ALL SELECT b, a FROM edge),
reach AS (SELECT rep_id AS x, rep_id AS y FROM rep UNION SELECT r.x, s.y FROM reach r JOIN sym s ON s.x = r.y),
lab AS (SELECT x, min(y) AS series_id FROM reach GROUP BY x),
ser AS (SELECT o.doc_id AS catalog_id, coalesce(lab.series_id, o.doc_id) AS series_id FROM documents o
  LEFT JOIN doc_list d ON d.doc_id = o.doc_id LEFT JOIN rep ON rep.bits = d.bits LEFT JOIN lab ON lab.x = rep.rep_id),
r AS (SELECT s.catalog_id, series_id, score, row_number() OVER (PARTITION BY series_id ORDER BY score DESC, s.catalog_id) AS g
  FROM ser s JOIN score_a a ON a.catalog_id = s.catalog_id)
SELECT catalog_id, series_id, score FROM r WHERE g <= 1 ORDER BY score DESC, catalog_id LIMIT 50
""")
def series_portfolio(spark, sf):
    series = S.series_components(X.documents_fp(spark, sf), 0.6)
    scored = series.withColumnRenamed("entity_id", "catalog_id").join(shuffled(X.scores(spark, sf, "a")), "catalog_id")
    order = [F.desc("score"), F.asc("catalog_id")]
    return R.first_per_group(scored, "series_id", order, 50).select("catalog_id", "series_id", "score")


@query("rank_change", f"""
WITH {O.SCORES}, b AS (SELECT s.catalog_id, group_key, eligible, row_number() OVER (ORDER BY score DESC, s.catalog_id) AS rank_before
  FROM score_a s JOIN score_panel p ON p.catalog_id = s.catalog_id)
SELECT catalog_id, rank_before, row_number() OVER (ORDER BY rank_before) AS rank_after FROM b WHERE eligible
""")
def rank_change(spark, sf):
    rows = X.scores(spark, sf, "a").join(X.score_panel(spark, sf), "catalog_id")
    order = [F.desc("score"), F.asc("catalog_id")]
    return R.rank_change(rows, F.col("eligible"), order).select(
        "catalog_id", F.col("rank_before").cast("bigint").alias("rank_before"),
        F.col("rank_after").cast("bigint").alias("rank_after"),
    )


@query("best_epoch", """
WITH h AS (SELECT l_suppkey AS run, l_linenumber AS epoch, avg(l_discount) AS metric FROM lineitem GROUP BY l_suppkey, l_linenumber),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(metric, 9) DESC, epoch) AS n FROM h)
SELECT run, epoch, round(metric, 6) AS metric FROM r WHERE n = 1
""")
def best_epoch(spark, sf):
    history = (
        X.table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch"))
        .agg(F.round(F.avg("l_discount"), 9).alias("metric"))
    )
    return R.best_epoch(history, ["run"], "metric").select("run", "epoch", *rounded("metric"))


@query("expand_runs", f"""
WITH {O.SCORES}, t AS (SELECT catalog_id FROM score_c)
SELECT catalog_id, template, catalog_id::VARCHAR || '__' || template AS run_name FROM t
CROSS JOIN (SELECT unnest(['open', 'closed', 'apo']) AS template)
""")
def expand_runs(spark, sf):
    return R.expand_runs(X.scores(spark, sf, "c").select("catalog_id"), ["open", "closed", "apo"])


@query("selectivity_delta", f"""
WITH {O.SCORES} SELECT a.catalog_id, a.score AS target_score, b.score AS off_target_score, a.score - b.score AS delta
FROM score_a a JOIN score_b b ON a.catalog_id = b.catalog_id
""")
def selectivity_delta(spark, sf):
    return R.score_difference(X.scores(spark, sf, "a"), X.scores(spark, sf, "b"))


@query("topn_overlap", f"""
WITH {O.SCORES}, a AS (SELECT catalog_id FROM score_a ORDER BY score DESC, catalog_id LIMIT 100),
b AS (SELECT catalog_id FROM score_b ORDER BY score DESC, catalog_id LIMIT 100)
SELECT count(*) AS shared FROM a JOIN b ON a.catalog_id = b.catalog_id
""")
def topn_overlap(spark, sf):
    return R.top_overlap(X.scores(spark, sf, "a"), X.scores(spark, sf, "b"), 100)


@query("panel_overlap", f"""
WITH {O.RAW}, {O.PANELS}, s AS (SELECT DISTINCT entity_key FROM supp_raw)
SELECT (SELECT count(*) FROM panel_v) AS keys_a, (SELECT count(*) FROM s) AS keys_b,
  (SELECT count(*) FROM panel_v v JOIN s ON s.entity_key = v.entity_key) AS shared
""")
def panel_overlap(spark, sf):
    return R.overlap_count(X.panel(spark, sf, "validation"), X.supplement_raw(spark, sf), "entity_key")


@query("coverage_gap", f"""
WITH {O.SCORES} SELECT coalesce(a.catalog_id, b.catalog_id) AS catalog_id,
  CASE WHEN b.catalog_id IS NULL THEN 'missing' ELSE 'extra' END AS gap
FROM score_a a FULL JOIN score_b b ON a.catalog_id = b.catalog_id WHERE a.catalog_id IS NULL OR b.catalog_id IS NULL
""")
def coverage_gap(spark, sf):
    return R.coverage_gap(X.scores(spark, sf, "a"), X.scores(spark, sf, "b"), "catalog_id")


# --- nested data -----------------------------------------------------------


@query("nested_counts", """
WITH n AS (SELECT o_orderpriority, o_orderkey, count(l_orderkey) AS nodes FROM orders
  LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderpriority, o_orderkey)
SELECT o_orderpriority AS status, count(*) AS entities, CAST(sum(nodes) AS BIGINT) AS nodes,
  CAST(sum(greatest(nodes - 1, 0)) AS BIGINT) AS edges, max(nodes) AS max_nodes, max(greatest(nodes - 1, 0)) AS max_edges
FROM n WHERE nodes > 0 GROUP BY o_orderpriority
""")
def nested_counts(spark, sf):
    lines = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    packed = G.pack(lines, ["o_orderkey"], "l_linenumber", ["l_quantity"], "nodes")
    chained = packed.withColumn(
        "edges",
        F.transform(
            F.slice("nodes", F.lit(1), F.size("nodes") - 1),
            lambda n, i: F.struct(i.alias("src"), (i + 1).alias("dst")),
        ),
    )
    orders = X.table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("status"))
    counted = G.nested_counts(chained.join(orders, "o_orderkey"), "nodes", "edges", ["status"])
    return counted.select(
        "status", "entities", "nodes", "edges", F.col("max_nodes").cast("bigint").alias("max_nodes"),
        F.col("max_edges").cast("bigint").alias("max_edges"),
    )


@query("dedup_status", """
WITH h AS (SELECT doc_id, md5(text) AS k, CASE WHEN n_chars < 40 THEN 'too_short' ELSE 'ok' END AS status FROM documents),
blind AS (SELECT DISTINCT md5(text) AS k FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
s AS (SELECT h.doc_id, h.k, CASE WHEN status = 'ok' AND blind.k IS NOT NULL THEN 'panel_overlap' ELSE status END AS status
  FROM h LEFT JOIN blind ON blind.k = h.k),
f AS (SELECT k, min(doc_id) AS first FROM s WHERE status = 'ok' GROUP BY k)
SELECT s.doc_id, CASE WHEN status = 'ok' AND s.doc_id <> f.first THEN 'duplicate' ELSE status END AS status
FROM s LEFT JOIN f ON f.k = s.k
""")
def dedup_status(spark, sf):
    docs = X.table(spark, sf, "documents").select(
        "doc_id", F.md5("text").alias("k"), F.when(F.col("n_chars") < 40, "too_short").otherwise("ok").alias("status")
    )
    blind = docs.join(X.table(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("k")
    return G.dedup_status(docs, "k", "doc_id", blind).select("doc_id", "status")


@query("template_consensus", """
WITH c AS (SELECT o_custkey, o_orderstatus, o_orderkey % 97 AS r, o_totalprice FROM orders),
a AS (SELECT o_custkey, list(DISTINCT r) AS contacts, max(o_totalprice) / 700000.0 AS confidence FROM c WHERE o_orderstatus = 'F' GROUP BY o_custkey),
b AS (SELECT o_custkey, list(DISTINCT r) AS contacts, max(o_totalprice) / 700000.0 AS confidence FROM c WHERE o_orderstatus = 'O' GROUP BY o_custkey),
j AS (SELECT a.o_custkey AS custkey, a.confidence AS ca, b.confidence AS cb, len(list_intersect(a.contacts, b.contacts)) AS k,
  len(a.contacts) AS na, len(b.contacts) AS nb FROM a JOIN b ON a.o_custkey = b.o_custkey)
SELECT custkey, round((ca + cb) / 2, 6) AS mean_confidence, round(least(ca, cb), 6) AS min_confidence,
  round(k * 1.0 / (na + nb - k), 6) AS contact_jaccard, round(least(ca, cb) * (k * 1.0 / (na + nb - k)), 6) AS consensus_score FROM j
""")
def template_consensus(spark, sf):
    orders = X.table(spark, sf, "orders")

    def side(status):
        return (
            orders.where(F.col("o_orderstatus") == status)
            .groupBy(F.col("o_custkey").alias("custkey"))
            .agg(
                F.collect_set((F.col("o_orderkey") % 97).cast("int")).alias("contacts"),
                (F.max("o_totalprice") / 700000.0).alias("confidence"),
            )
            .withColumn("status", F.lit("succeeded"))
        )

    result = G.template_consensus(side("F"), side("O"), "custkey")
    return result.select("custkey", *rounded("mean_confidence", "min_confidence", "contact_jaccard", "consensus_score"))


@query("result_status", """
WITH r AS (SELECT DISTINCT o_custkey FROM orders)
SELECT c_custkey AS custkey, CASE WHEN r.o_custkey IS NULL THEN 'pending' ELSE 'succeeded' END AS status
FROM customer LEFT JOIN r ON r.o_custkey = c_custkey
""")
def result_status(spark, sf):
    runs = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    done = X.table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), F.lit("succeeded").alias("status")).distinct()
    return G.result_status(runs, done, "custkey").select("custkey", "status")


_ATOMS = """atoms AS (SELECT vec_id, label AS structure, 'A' AS chain, CASE WHEN list_extract(embedding, 4) > 0 THEN 'protein' ELSE 'ligand' END AS role,
  20 * list_extract(embedding, 1)::DOUBLE AS x, 20 * list_extract(embedding, 2)::DOUBLE AS y, 20 * list_extract(embedding, 3)::DOUBLE AS z FROM embeddings)"""


def _atoms(spark, sf):
    e = F.col("embedding")
    return X.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("residue"), F.col("vec_id").alias("atom"), F.col("label").alias("structure"),
        F.lit("A").alias("chain"), F.when(e[3] > 0, "protein").otherwise("ligand").alias("role"),
        *[(20 * e[i].cast("double")).alias(axis) for i, axis in enumerate("xyz")],
    )


_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query("contacts", f"""
WITH {_ATOMS}
SELECT a.structure, a.chain, b.vec_id AS ligand_residue, a.vec_id AS residue, round(min({_DIST}), 3) AS min_distance
FROM atoms a JOIN atoms b ON a.structure = b.structure AND a.role = 'protein' AND b.role = 'ligand'
WHERE {_DIST} <= 3.0 GROUP BY a.structure, a.chain, b.vec_id, a.vec_id
""")
def contacts(spark, sf):
    return G.contacts(_atoms(spark, sf), 3.0)


@query("radius_edges", f"""
WITH {_ATOMS}
SELECT a.structure, a.vec_id AS src, b.vec_id AS dst, round({_DIST}, 6) AS distance FROM atoms a
JOIN atoms b ON a.structure = b.structure AND a.vec_id <> b.vec_id AND abs(a.vec_id - b.vec_id) <> 10 WHERE {_DIST} <= 2.0
""")
def radius_edges(spark, sf):
    atoms = _atoms(spark, sf)
    bonds = atoms.select("structure", F.col("atom").alias("src"), (F.col("atom") + 10).alias("dst"))
    return G.radius_edges(atoms, bonds, 2.0).select("structure", "src", "dst", *rounded("distance"))


# --- checks ----------------------------------------------------------------


@query("quality_checks", f"""{MERGED}, {O.SCORES}
SELECT 'pair_self' AS "check", CAST(count(*) FILTER (WHERE positive_key = negative_key) AS BIGINT) AS violations FROM merged
UNION ALL SELECT 'pair_weight_not_positive', count(*) FILTER (WHERE NOT pair_weight > 0) FROM merged
UNION ALL SELECT 'pair_duplicate', count(*) - count(DISTINCT positive_key || '/' || negative_key) FROM merged
UNION ALL SELECT 'pair_in_blind_panel', count(*) FROM (SELECT positive_key AS k FROM merged UNION ALL SELECT negative_key FROM merged)
  WHERE k IN (SELECT entity_key FROM panel_all)
UNION ALL SELECT 'scores_missing', count(*) FROM score_a WHERE catalog_id NOT IN (SELECT catalog_id FROM score_b)
UNION ALL SELECT 'scores_extra', count(*) FROM score_b WHERE catalog_id NOT IN (SELECT catalog_id FROM score_a)
UNION ALL SELECT 'score_outside_panel', count(*) FROM score_b WHERE catalog_id NOT IN (SELECT catalog_id FROM score_panel)
UNION ALL SELECT 'score_disagrees', count(*) FROM score_a a JOIN score_b b ON a.catalog_id = b.catalog_id WHERE a.score <> b.score
UNION ALL SELECT 'score_drift', count(*) FROM score_a a JOIN score_b b ON a.catalog_id = b.catalog_id WHERE abs(a.score - b.score) > 1000
UNION ALL SELECT 'count_negative', count(*) FROM lineitem WHERE l_quantity < 0
UNION ALL SELECT 'entity_repeated', count(*) - count(DISTINCT {O.ENTITY}) FROM lineitem
UNION ALL SELECT 'flag_identity', count(DISTINCT l_returnflag) - 1 FROM lineitem
UNION ALL SELECT 'shards_gap', 0
UNION ALL SELECT 'shards_total', 0
""")
def quality_checks(spark, sf):
    a, b = X.scores(spark, sf, "a"), X.scores(spark, sf, "b")
    raw, lines = X.evidence_raw(spark, sf), X.table(spark, sf, "lineitem")
    total = lines.agg(F.count(F.lit(1)).alias("n"))
    bounds = total.select(F.inline(L.shard_bounds(F.col("n"), 64)))
    return V.all_checks(
        [
            V.pair_checks(_merged(spark, sf), E.panel_keys(X.panels(spark, sf))),
            V.coverage(a, b, "catalog_id", "scores"),
            V.outside(b, X.score_panel(spark, sf), "catalog_id", "score_outside_panel"),
            V.agreement(a, b, "catalog_id", "score", "score_disagrees"),
            V.score_drift(a, b, 1000),
            V.row_checks(raw, {"count_negative": V.negative("count_target")}),
            V.duplicates(raw, ["entity_key"], "entity_repeated"),
            V.same_identity(lines, "l_returnflag", "flag_identity"),
            V.contiguous(bounds, total.scalar(), "shards"),
        ]
    )


@query("content_digest", f"""
WITH {O.DEDUP}, h AS (SELECT ('0x' || substr(sha256(concat_ws('|', entity_key, code, source_rows::VARCHAR, count_target::VARCHAR)), 1, 15))::UBIGINT::BIGINT AS h FROM ded)
SELECT count(*) AS rows, bit_xor(h) AS digest_xor, sum(h)::HUGEINT::VARCHAR AS digest_sum FROM h
""")
def content_digest(spark, sf):
    return V.content_digest(X.dedup(spark, sf), ["entity_key", "code", "source_rows", "count_target"])


# --- files and streams -----------------------------------------------------


@query("dataset_inventory")
def dataset_inventory(spark, sf):
    rules = [("line", "fact"), ("orders", "fact"), ("doc", "text"), ("pages", "text"), ("conv", "text")]
    return I.inventory(spark, sf, rules).select("file_name", "family", "rows", "row_groups", "schema_signature", "error")


@query("schema_groups")
def schema_groups(spark, sf):
    return I.schema_groups(I.inventory(spark, sf)).select("schema_signature", "files", "rows")


@query("duplicate_files")
def duplicate_files(spark, sf):
    found = I.duplicate_files(I.list_files(spark, sf))
    return found.select("sha256", F.element_at(F.split("path", "/"), -1).alias("file_name"), "files")


@query("file_digests")
def file_digests(spark, sf):
    return I.digests(I.list_files(spark, sf)).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "size_bytes", "sha256"
    )


@query("stream_coverage", """
SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase') AS target,
  count(*) FILTER (WHERE event_type = 'error') AS competitor, count(*) FILTER (WHERE event_type = 'view') AS control,
  count(*) FILTER (WHERE event_type = 'purchase' AND value >= 10) AS target_ge_10 FROM events GROUP BY user_id
""")
def stream_coverage(spark, sf):
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = X.table(spark, sf, "events").schema
    parts = ST.stream_parts(spark, sf, schema, "events.parquet")
    kind = F.col("event_type")
    live = ST.counters(
        parts,
        ["user_id"],
        [
            F.count(F.lit(1)).alias("events"),
            F.count_if(kind == "purchase").alias("target"),
            F.count_if(kind == "error").alias("competitor"),
            F.count_if(kind == "view").alias("control"),
            F.count_if((kind == "purchase") & (F.col("value") >= 10)).alias("target_ge_10"),
        ],
    )
    ST.write_latest(live, f"{base}/out", f"{base}/state").awaitTermination()
    return ST.read_latest(spark, f"{base}/out")


@query("ensemble_mean", f"""
WITH {O.SCORES}, u AS (SELECT * FROM score_a UNION ALL SELECT * FROM score_b UNION ALL SELECT * FROM score_c)
SELECT catalog_id, round(avg(score), 6) AS ensemble_score, count(*) AS members FROM u GROUP BY catalog_id
""")
def ensemble_mean(spark, sf):
    stacked = X.scores(spark, sf, "a").unionByName(X.scores(spark, sf, "b")).unionByName(X.scores(spark, sf, "c"))
    return E.ensemble_mean(stacked, "catalog_id").select("catalog_id", *rounded("ensemble_score"), "members")


@query("embedding_norms", """
SELECT vec_id, round(abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1), 6) AS deviation FROM embeddings
""")
def embedding_norms(spark, sf):
    vectors = X.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return vectors.select("vec_id", S.norm_deviation().alias("deviation")).select("vec_id", *rounded("deviation"))


@query("rekeyed_groups", f"""
WITH {O.DEDUP}, grp AS (SELECT p_partkey AS partkey, p_brand || '|' || p_type AS old FROM part)
SELECT split_part(old, '|', 2) AS group_key, count(*) AS rows FROM ded d JOIN grp g ON g.partkey = d.partkey GROUP BY 1
""")
def rekeyed_groups(spark, sf):
    parts = X.table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), F.concat_ws("|", "p_brand", "p_type").alias("old"))
    collapsed = E.dedup_evidence(X.evidence_raw(spark, sf), carry=["partkey"]).select("entity_key", "partkey")
    rekeyed = L.rekey_groups(collapsed.join(parts, "partkey"), "old", lambda g: F.split_part(g, F.lit("|"), F.lit(2)))
    return E.count_by(rekeyed, "group_key")


@query("set_change", """
WITH a AS (SELECT o_custkey AS custkey, count(DISTINCT o_orderpriority) AS n, list(DISTINCT o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
b AS (SELECT o_custkey AS custkey, list(DISTINCT o_orderpriority) AS s FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey)
SELECT a.custkey, len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)) AS in_union, len(b.s) - len(list_intersect(a.s, b.s)) AS added,
  len(a.s) - len(list_intersect(a.s, b.s)) AS removed, len(a.s) = len(list_intersect(a.s, b.s)) AS nested FROM a JOIN b ON a.custkey = b.custkey
""")
def set_change(spark, sf):
    orders = X.table(spark, sf, "orders").withColumnRenamed("o_custkey", "custkey")
    side = lambda status, name: orders.where(F.col("o_orderstatus") == status).groupBy("custkey").agg(
        F.collect_set("o_orderpriority").alias(name)
    )
    change = side("F", "old").join(side("O", "new"), "custkey").withColumns(G.set_change(F.col("old"), F.col("new")))
    sizes = [F.size(c).cast("bigint").alias(n) for c, n in (("union", "in_union"), ("added", "added"), ("removed", "removed"))]
    return change.select("custkey", *sizes, "nested")
