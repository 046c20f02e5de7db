"""Registered queries: sources, sinks and saved-report checks, by writing to the shared folder and reading back."""

import uuid

from pyspark.sql import functions as F

from tallysieve.operators import checks as V
from tallysieve.operators import evidence as E
from tallysieve.operators import nested as N
from tallysieve.operators import shift as D
from tallysieve.operators import similarity as S
from tallysieve.plans import fixtures as X
from tallysieve.plans import oracle_base as O
from tallysieve.plans.queries_evidence import rounded
from tallysieve.plans.registry import query
from tallysieve.session import ensure_checkpoint_dir
from tallysieve.sources import tables as T
from tallysieve.streaming import incremental as ST


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text_ids(df):
    return df.withColumn("catalog_id", F.col("catalog_id").cast("string"))


@query("panel_file", "SELECT 'C' || doc_id AS catalog_id, source || '/' || doc_id AS entity_key FROM documents")
def panel_file(spark, sf):
    out = _folder(spark, "panel")
    X.table(spark, sf, "documents").select(
        F.concat(F.lit("C"), "doc_id").alias("catalog_id"), F.concat_ws("/", "source", "doc_id").alias("entity_key")
    ).write.option("header", True).csv(out)
    return T.read_panel(spark, out)


@query("score_file", f"WITH {O.SCORES} SELECT catalog_id::VARCHAR AS catalog_id, score FROM score_a")
def score_file(spark, sf):
    out = _folder(spark, "scores")
    X.scores(spark, sf, "a").write.option("header", True).csv(out)
    return T.read_scores(spark, out, "score")


@query("merged_chunks", f"WITH {O.SCORES} SELECT catalog_id::VARCHAR AS catalog_id, score FROM score_a")
def merged_chunks(spark, sf):
    out, scores = _folder(spark, "chunks"), X.scores(spark, sf, "a")
    for k in range(3):
        scores.where(F.col("catalog_id") % 3 == k).write.option("header", True).csv(f"{out}/chunk-{k}")
    chunks = T.read_chunks(spark, f"{out}/chunk-*", ["catalog_id", "score"], "catalog_id string, score double")
    return T.merge_scores(chunks, _text_ids(scores))


@query("ranked_file", f"WITH {O.SCORES} SELECT catalog_id::VARCHAR AS catalog_id, score FROM score_a")
def ranked_file(spark, sf):
    out = _folder(spark, "ranked")
    T.write_ranked(X.scores(spark, sf, "a"), out)
    return spark.read.option("header", True).schema("catalog_id string, score double").csv(out)


@query("top_ids_file", f"WITH {O.SCORES} SELECT catalog_id::VARCHAR AS catalog_id FROM score_a ORDER BY score DESC, catalog_id LIMIT 50")
def top_ids_file(spark, sf):
    out = _folder(spark, "top")
    T.write_top_ids(X.scores(spark, sf, "a"), out)
    return spark.read.text(out).withColumnRenamed("value", "catalog_id")


@query("report_file", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def report_file(spark, sf):
    out = _folder(spark, "report")
    T.write_report(E.count_by(X.table(spark, sf, "documents"), "lang", "source").toDF("lang", "source", "n"), out)
    return T.read_report(spark, out, "lang string, source string, n long")


@query("partitioned_table", "SELECT lang, doc_id, n_chars FROM documents WHERE lang = 'fr'")
def partitioned_table(spark, sf):
    out = _folder(spark, "table")
    T.write_table(X.table(spark, sf, "documents").select("lang", "doc_id", "n_chars"), out, ["lang"])
    return T.scan_table(spark, out, columns=["lang", "doc_id", "n_chars"]).where("lang = 'fr'")


def _key_of(code: str) -> tuple[str, str]:
    if code.endswith("3"):
        raise ValueError("bad code")
    return code.upper(), code[:4]


@query("entity_keys", """
SELECT doc_id, CASE WHEN ends_with(source, '3') THEN NULL ELSE upper(source) END AS entity_key,
  CASE WHEN ends_with(source, '3') THEN NULL ELSE substr(source, 1, 4) END AS group_key,
  CASE WHEN ends_with(source, '3') THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN ends_with(source, '3') THEN 'ValueError: bad code' END AS error FROM documents
""")
def entity_keys(spark, sf):
    keyed = T.with_entity_keys(X.table(spark, sf, "documents").select("doc_id", "source"), "source", _key_of)
    return keyed.select("doc_id", "entity_key", "group_key", "status", "error")


@query("ingest_restart", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def ingest_restart(spark, sf):
    """Two runs over a growing folder take every part once."""
    base, events = _folder(spark, "ingest"), X.table(spark, sf, "events")
    columns = lambda df: df.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))
    for k in range(2):
        events.where(F.col("event_id") % 2 == k).write.mode("append").parquet(f"{base}/in")
        parts = ST.stream_parts(spark, f"{base}/in", events.schema)
        ST.ingest(parts, columns, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("lookup_checks", """
WITH t AS (SELECT doc_id, toxic, doc_id % 7 = 0 AS gone, CASE WHEN doc_id % 11 = 0 THEN 1 - toxic ELSE toxic END AS v FROM labels)
SELECT 'toxic_missing' AS "check", count(*) FILTER (WHERE gone) AS violations FROM t
UNION ALL SELECT 'toxic_mismatch', count(*) FILTER (WHERE NOT gone AND v <> toxic) FROM t
""")
def lookup_checks(spark, sf):
    labels = X.table(spark, sf, "labels")
    changed = labels.where("doc_id % 7 <> 0").withColumn("toxic", F.expr("CASE WHEN doc_id % 11 = 0 THEN 1 - toxic ELSE toxic END"))
    return V.lookup_check(labels, changed, "doc_id", "toxic", "toxic", "toxic")


@query("saved_report_checks", """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang)
SELECT 'langs' AS "check", count(*) FILTER (WHERE lang IN ('de', 'fr')) AS violations FROM c
UNION ALL SELECT 'metric_not_reproduced', 1
""")
def saved_report_checks(spark, sf):
    docs = X.table(spark, sf, "documents")
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    manifest = counts.where("lang <> 'de'").withColumn("n", F.expr("CASE WHEN lang = 'fr' THEN n + 1 ELSE n END"))
    metrics = docs.agg(F.avg("n_chars").alias("mean"), F.max("n_chars").alias("max")).unpivot([], ["mean", "max"], "metric", "value")
    saved = metrics.withColumn("value", F.expr("CASE WHEN metric = 'mean' THEN value * 1.000001 ELSE value + 5 END"))
    return V.all_checks(
        [V.totals_match(counts, manifest, ["lang"], "n", "langs"), V.reproduces(metrics, saved, rtol=1e-5)]
    )


@query("shift_severity", """
SELECT doc_id, CASE WHEN a >= 0.9 OR s < 0.3 THEN 'severe' WHEN a >= 0.8 OR s < 0.4 THEN 'large'
  WHEN a >= 0.7 OR s < 0.5 THEN 'moderate' ELSE 'small' END AS severity
FROM (SELECT doc_id, (doc_id % 100) / 100.0::DOUBLE AS a, (n_chars % 97) / 97.0::DOUBLE AS s FROM documents)
""")
def shift_severity(spark, sf):
    area, similarity = F.col("doc_id") % 100 / F.lit(100.0), F.col("n_chars") % 97 / F.lit(97.0)
    return X.table(spark, sf, "documents").select("doc_id", D.severity(area, similarity).alias("severity"))


@query("packed_rows", """
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS index, l_linenumber, l_partkey FROM lineitem
""")
def packed_rows(spark, sf):
    """Rows packed into an array per order and unpacked again."""
    rows = X.table(spark, sf, "lineitem")
    packed = N.pack(rows, ["l_orderkey"], "l_linenumber", ["l_partkey"], "lines")
    return N.unpack(packed, ["l_orderkey"], "lines")


@query("rebased_edges", """
SELECT l_orderkey, l_linenumber + 10 * l_orderkey AS src, l_partkey + 10 * l_orderkey AS dst FROM lineitem
""")
def rebased_edges(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst")
    )
    edges = rows.groupBy("l_orderkey").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    moved = edges.select("l_orderkey", F.explode(N.rebase_edges(F.col("edges"), F.col("l_orderkey") * 10)).alias("e"))
    return moved.select("l_orderkey", "e.src", "e.dst")


REFERENCES = (("low", list(range(0, 400)), 1.0), ("wide", list(range(0, 2048, 4)), 1.5))


@query("best_reference", f"""
WITH {O.DOC_FP},
b AS (SELECT d.doc_id AS entity_id, count(bit) AS n, count(*) FILTER (WHERE bit < 400) AS low,
  count(*) FILTER (WHERE bit % 4 = 0) AS wide FROM documents d LEFT JOIN doc_bits w ON w.doc_id = d.doc_id GROUP BY d.doc_id),
s AS (SELECT entity_id, CASE WHEN n + 400 - low = 0 THEN 0.0 ELSE low / (n + 400 - low)::DOUBLE END AS a,
  1.5 * wide / (n + 512 - wide)::DOUBLE AS b FROM b)
SELECT entity_id, round(greatest(a, b), 9) AS reference_score, CASE WHEN a > b THEN 'low' ELSE 'wide' END AS nearest_reference FROM s
""")
def best_reference(spark, sf):
    found = S.best_reference(X.documents_fp(spark, sf), REFERENCES, "entity_id")
    # six digits would round many ratios at a tie
    return found.select("entity_id", F.round("reference_score", 9).alias("reference_score"), "nearest_reference")
