"""Registered queries: evidence, audits, splits and evidence joins."""

from pyspark.sql import functions as F

from tallysieve.functions import columns as C
from tallysieve.operators import evidence as E
from tallysieve.plans import fixtures as X
from tallysieve.plans import oracle_base as O
from tallysieve.plans.registry import query


def rounded(*names: str):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def r6(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


COUNTS = ("count_target", "count_competitor", "count_control")
COUNT_SQL = ", ".join(COUNTS)


@query("strict_hits", f"""
WITH {O.DEDUP}
SELECT entity_key, code, source_rows, {COUNT_SQL}, historic_hits, {r6('z_target', 'z_competitor', 'z_control')}
FROM ded WHERE count_target > 3 AND (count_competitor = 0 OR count_competitor < 0.1 * count_target)
  AND (count_control = 0 OR count_control < 0.1 * count_target) AND historic_hits < 5
""")
def strict_hits(spark, sf):
    return X.dedup(spark, sf).where(C.strict_hit()).select(
        "entity_key", "code", "source_rows", *COUNTS, "historic_hits", *rounded(*C.Z_COLUMNS)
    )


@query("dedup_evidence", f"""
WITH {O.DEDUP}
SELECT entity_key, code, source_rows, {COUNT_SQL}, historic_hits, {r6('z_target', 'z_competitor', 'z_control')} FROM ded
""")
def dedup_evidence(spark, sf):
    return X.dedup(spark, sf).select(
        "entity_key", "code", "source_rows", *COUNTS, "historic_hits", *rounded(*C.Z_COLUMNS)
    )


@query("supplement_join", f"""
WITH {O.EVIDENCE}
SELECT entity_key, supplement_rows, count_control_supplement, control_evidence, {r6('z_control_supplement')} FROM ev
""")
def supplement_join(spark, sf):
    return X.evidence(spark, sf).select(
        "entity_key", "supplement_rows", "count_control_supplement", "control_evidence",
        *rounded("z_control_supplement"),
    )


@query("code_parts", f"""
WITH {O.RAW}, codes AS (SELECT DISTINCT code FROM ev_raw),
{O.PARTS.format(src='codes')}
SELECT code, library, b1, b2, b3, k12, k13, k23 FROM keyed
""")
def code_parts(spark, sf):
    codes = X.evidence_raw(spark, sf).select("code").distinct()
    return X.with_parts(codes).select("code", "library", "b1", "b2", "b3", "k12", "k13", "k23")


@query("anchors_sensitive", f"""
WITH {O.OPEN}
SELECT entity_key, {COUNT_SQL}, control_evidence, historic_hits FROM open_ev
WHERE count_target >= 4 AND control_evidence < 0.1 * count_target AND historic_hits <= 4
  AND count_competitor < 0.1 * count_target
""")
def anchors_sensitive(spark, sf):
    return X.open_evidence(spark, sf).where(C.competition_sensitive()).select(
        "entity_key", *COUNTS, "control_evidence", "historic_hits"
    )


@query("binders_retained", f"""
WITH {O.OPEN}
SELECT entity_key, {COUNT_SQL}, control_evidence, historic_hits FROM open_ev
WHERE count_target >= 4 AND control_evidence < 0.1 * count_target AND historic_hits <= 4
  AND count_competitor >= 0.5 * count_target
""")
def binders_retained(spark, sf):
    return X.open_evidence(spark, sf).where(C.competition_retained()).select(
        "entity_key", *COUNTS, "control_evidence", "historic_hits"
    )


@query("rechecked_hits", f"""
WITH {O.EVIDENCE}
SELECT entity_key, count_target, count_control, count_control_supplement, control_evidence FROM ev
WHERE count_target > 3 AND (count_competitor = 0 OR count_competitor < 0.1 * count_target)
  AND (count_control = 0 OR count_control < 0.1 * count_target) AND historic_hits < 5
  AND control_evidence < 0.1 * count_target
""")
def rechecked_hits(spark, sf):
    hits = X.dedup(spark, sf).where(C.strict_hit())
    return E.rechecked_hits(hits, X.supplement_raw(spark, sf)).select(
        "entity_key", "count_target", "count_control", "count_control_supplement", "control_evidence"
    )


@query("panel_exclusion", f"""
WITH {O.OPEN} SELECT entity_key, source_rows FROM open_ev
""")
def panel_exclusion(spark, sf):
    return X.open_evidence(spark, sf).select("entity_key", "source_rows")


@query("panel_flags", f"""
WITH {O.DEDUP}, {O.PANELS}
SELECT d.entity_key, v.entity_key IS NOT NULL AS in_validation, t.entity_key IS NOT NULL AS in_test
FROM ded d LEFT JOIN panel_v v ON v.entity_key = d.entity_key LEFT JOIN panel_t t ON t.entity_key = d.entity_key
""")
def panel_flags(spark, sf):
    panels = {n: X.panel(spark, sf, n) for n in ("validation", "test")}
    return E.panel_flags(X.dedup(spark, sf), panels).select("entity_key", "in_validation", "in_test")


@query("neighbor_pool", f"""
WITH {O.OPEN}
SELECT entity_key, 'anchor' AS pool_role FROM open_ev
WHERE count_target >= 4 AND control_evidence < 0.1 * count_target AND historic_hits <= 4
  AND count_competitor < 0.1 * count_target
UNION ALL
SELECT entity_key, 'comparator' AS pool_role FROM open_ev
WHERE (count_competitor > 0 OR control_evidence > 0)
  AND NOT (count_target >= 4 AND control_evidence < 0.1 * count_target AND historic_hits <= 4
  AND count_competitor < 0.1 * count_target)
""")
def neighbor_pool(spark, sf):
    evidence = X.open_evidence(spark, sf)
    anchors = evidence.where(C.competition_sensitive())
    return E.comparator_pool(evidence, anchors).select("entity_key", "pool_role")


@query("canonical_index", f"""
WITH {O.INDEX}
SELECT entity_id, entity_key, code, source_rows, {COUNT_SQL}, historic_hits, supplement_rows,
  count_control_supplement, group_key, split, sample_bucket, informative, {r6('z_target', 'z_control_supplement')} FROM idx
""")
def canonical_index(spark, sf):
    return X.index(spark, sf, row_ids=True).select(
        F.col("entity_id").cast("bigint").alias("entity_id"), "entity_key", "code", "source_rows", *COUNTS,
        "historic_hits", "supplement_rows", "count_control_supplement", "group_key", "split", "sample_bucket",
        "informative", *rounded("z_target", "z_control_supplement"),
    )


PROXY = [f"{n}_{k}" for n in ("proxy", "confidence") for k in range(3)]
IVL = [f"{n}_{k}" for n in ("lower", "upper", "interval_confidence") for k in range(3)]


@query("observed_evidence", f"WITH {O.PREPARED} SELECT entity_key, {r6(*PROXY)} FROM obs")
def observed_evidence(spark, sf):
    return E.with_observed_evidence(X.index(spark, sf)).select("entity_key", *rounded(*PROXY))


@query("evidence_intervals_cap5", f"WITH {O.PREPARED} SELECT entity_key, {r6(*IVL)} FROM ivl")
def evidence_intervals_cap5(spark, sf):
    return E.prepared_evidence(X.index(spark, sf), 5).select("entity_key", *rounded(*IVL))


ACTIVE_SQL = """(ln(1 + count_target) + 0.25 * greatest(-20, least(20, z_target)))
  - (ln(1 + count_competitor) + 0.25 * greatest(-20, least(20, z_competitor)))
  - 0.5 * greatest(ln(1 + count_control) + 0.25 * greatest(-20, least(20, z_control)),
      ln(1 + count_control_supplement) + 0.25 * greatest(-20, least(20, z_control_supplement)))
  - 0.25 * ln(1 + historic_hits)"""


@query("active_score", f"""
WITH {O.EVIDENCE}, s AS (SELECT entity_key, {ACTIVE_SQL} AS active_score,
  least(5.0, greatest(1.0, 1 + ln(1 + count_target + count_competitor + count_control + count_control_supplement
    + historic_hits))) AS weight FROM ev)
SELECT entity_key, {r6('active_score', 'weight')} FROM s
""")
def active_score(spark, sf):
    return (
        X.evidence(spark, sf)
        .select("entity_key", C.active_score().alias("active_score"), C.evidence_weight().alias("weight"))
        .select("entity_key", *rounded("active_score", "weight"))
    )


@query("eval_labels", f"""
WITH {O.INDEX}, l AS (SELECT split, CASE
  WHEN count_target >= 4 AND control_evidence < 0.1 * count_target AND historic_hits <= 4
    AND count_competitor < 0.1 * count_target THEN 1
  WHEN count_target >= 4 AND control_evidence < 0.1 * count_target AND historic_hits <= 4
    AND count_competitor >= 0.5 * count_target THEN 0 ELSE -1 END AS label FROM idx)
SELECT split, label, count(*) AS rows FROM l GROUP BY split, label
""")
def eval_labels(spark, sf):
    return E.count_by(X.index(spark, sf).select("split", C.eval_label().alias("label")), "split", "label")


_PROFILED = ("count_target", "count_competitor", "count_control", "historic_hits", "z_target", "z_competitor", "z_control")


_SUMMARY = {
    "min": "min({c})::DOUBLE", "max": "max({c})::DOUBLE", "mean": "avg({c}::DOUBLE)", "q01": "quantile_cont({c}::DOUBLE, 0.01)",
    "median": "quantile_cont({c}::DOUBLE, 0.5)", "q99": "quantile_cont({c}::DOUBLE, 0.99)",
}


@query("numeric_profile", f"WITH {O.RAW} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n, """
    + ", ".join(f"round({e.format(c=c)}, 6) AS {n}" for n, e in _SUMMARY.items())
    + " FROM ev_raw"
    for c in _PROFILED
))
def numeric_profile(spark, sf):
    return E.numeric_profile(X.evidence_raw(spark, sf), _PROFILED).select(
        "column", "n", *rounded("min", "max", "mean", "q01", "median", "q99")
    )


@query("count_distribution", f"""
WITH {O.RAW}
SELECT 'count_target' AS "column", count_target AS value, count(*) AS rows FROM ev_raw GROUP BY count_target
UNION ALL SELECT 'count_competitor', count_competitor, count(*) FROM ev_raw GROUP BY count_competitor
UNION ALL SELECT 'count_control', count_control, count(*) FROM ev_raw GROUP BY count_control
UNION ALL SELECT 'historic_hits', historic_hits, count(*) FROM ev_raw GROUP BY historic_hits
""")
def count_distribution(spark, sf):
    return E.value_distribution(X.evidence_raw(spark, sf), [*COUNTS, "historic_hits"])


def count_if(flags: dict[str, str]) -> str:
    return ", ".join(f"CAST(sum(CASE WHEN {rule} THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, rule in flags.items())


_CALM = "(mn <= 0.1 * mt AND ms <= 0.1 * mt AND historic_hits = 0)"
_DISPLACED = "(mi > 0 AND mi <= 0.1 * mt)"
_BACK = "(mn > 0 OR ms > 0)"
_MARKS = {
    "every": "TRUE", "merged": "source_rows > 1", "background_seen": _BACK,
    "competitor_seen": "mi > 0", "control_seen": "mn > 0", "supplement_seen": "ms > 0", "history_seen": "historic_hits > 0",
    "missing": "mi = 0", "missing_calm": f"mi = 0 AND {_CALM}", "displaced": _DISPLACED, "displaced_calm": f"{_DISPLACED} AND {_CALM}",
    "untouched": "mi = 0 AND mn = 0 AND ms = 0 AND historic_hits = 0", "restless": f"NOT {_CALM}", "held": "mi >= mt",
    "two_sided": f"mi > 0 AND {_BACK}", "displaced_calm_two_sided": f"{_DISPLACED} AND {_CALM} AND {_BACK}",
    "weighted": "confidence_0 > 0", "weighted_any": "(confidence_0 > 0 OR confidence_1 > 0 OR confidence_2 > 0)",
    "weighted_missing": "confidence_0 > 0 AND mi = 0",
}
_CAPPED = {f"capped_{k}": f"interval_confidence_{k} > 0" for k in range(3)} | {
    "capped_any": "(interval_confidence_0 > 0 OR interval_confidence_1 > 0 OR interval_confidence_2 > 0)"
}


def audit_sql(source: str, rules: dict[str, str], supports) -> str:
    return f"WITH {O.PREPARED} " + " UNION ALL ".join(
        f"SELECT split, '{n}' AS mark, {cut} AS support, CAST(count(*) FILTER (WHERE {rule} AND ({cut} = 0 OR mt >= {cut})) AS BIGINT) AS entities "
        f"FROM {source} GROUP BY split"
        for n, rule in rules.items() for cut in (0, *supports)
    )


@query("supervision_audit", audit_sql("obs", {n: _MARKS[n] for n in E.SUPERVISION_MARKS}, C.SUPPORT_CUTOFFS))
def supervision_audit(spark, sf):
    return E.supervision_audit(X.index(spark, sf))


@query("evidence_coverage", audit_sql("ivl", _MARKS | _CAPPED, C.COVERAGE_CUTOFFS))
def evidence_coverage(spark, sf):
    return E.evidence_coverage(X.index(spark, sf))


@query("target_bands", f"""
WITH {O.PREPARED} SELECT split, CASE WHEN mt <= 1 THEN 'le1' WHEN mt < 5 THEN 'gt1_lt5' WHEN mt < 10 THEN '5_lt10'
  WHEN mt < 20 THEN '10_lt20' ELSE 'ge20' END AS band, count(*) AS entities FROM mean_ev GROUP BY ALL
""")
def target_bands(spark, sf):
    return E.target_bands(X.index(spark, sf))


@query("manifest_counts", f"""
WITH {O.PREPARED} SELECT split, count(*) AS entities,
  {count_if({'any_observed': 'confidence_0 > 0 OR confidence_1 > 0 OR confidence_2 > 0', 'competition_observed': 'confidence_0 > 0'})}
FROM obs GROUP BY split
""")
def manifest_counts(spark, sf):
    return E.manifest_counts(X.index(spark, sf))


_SCOPE = {"train": "split = 'train'", "dev": "split = 'dev'", "everything": "TRUE"}


@query("group_flags", f"WITH {O.PREPARED} " + " UNION ALL ".join(
    f"SELECT '{s}' AS scope, '{m}' AS mark, {cut} AS support, CAST(count(*) AS BIGINT) AS entities, "
    f"count(DISTINCT group_key) AS groups FROM ivl WHERE {sr} AND {_MARKS[m]} AND mt >= {cut} HAVING count(*) > 0"
    for s, sr in _SCOPE.items() for m in E.PANEL_MARKS for cut in (0, 5)
))
def group_flags(spark, sf):
    scopes = {"train": F.col("split") == "train", "dev": F.col("split") == "dev", "everything": F.lit(True)}
    return E.group_flags(E.prepared_evidence(X.index(spark, sf)), scopes)


_TARGETS = {
    "y_count_target": "ln(1 + count_target)", "y_count_competitor": "ln(1 + count_competitor)",
    "y_count_control": "ln(1 + count_control)", "y_count_control_supplement": "ln(1 + count_control_supplement)",
    "y_historic_hits": "ln(1 + historic_hits)", "y_z_target": "greatest(-20, least(20, z_target))",
    "y_z_competitor": "greatest(-20, least(20, z_competitor))", "y_z_control": "greatest(-20, least(20, z_control))",
    "y_z_control_supplement": "greatest(-20, least(20, z_control_supplement))",
}


@query("target_scaler", f"""
WITH {O.INDEX}, t AS ({" UNION ALL ".join(
    f"SELECT '{n}' AS target, {e} AS v FROM idx WHERE split = 'train' AND (informative OR sample_bucket < 14)"
    for n, e in _TARGETS.items())})
SELECT target, round(avg(v), 6) AS mean,
  round(CASE WHEN stddev_pop(v) < 1e-6 THEN 1.0 ELSE stddev_pop(v) END, 6) AS scale FROM t GROUP BY target
""")
def target_scaler(spark, sf):
    scope = (F.col("split") == "train") & C.ablation_scope()
    return E.fit_scaler(X.index(spark, sf), scope).select("target", *rounded("mean", "scale"))


@query("property_quantiles", f"""
WITH {O.INDEX}, l AS (SELECT split, 'count_target' AS property, count_target::DOUBLE AS v FROM idx
  UNION ALL SELECT split, 'z_target', z_target FROM idx)
SELECT split, property, {", ".join(
    f"round(quantile_cont(v, {p}), 6) AS {n}" for n, p in
    (("minimum", 0.0), ("q10", 0.1), ("median", 0.5), ("q90", 0.9), ("maximum", 1.0)))}
FROM l GROUP BY split, property
""")
def property_quantiles(spark, sf):
    return E.property_quantiles(X.index(spark, sf), ["count_target", "z_target"], ["split"]).select(
        "split", "property", *rounded("minimum", "q10", "median", "q90", "maximum")
    )


@query("split_overlap", f"""
WITH {O.RAW}, m AS (SELECT DISTINCT entity_key, CASE WHEN historic_hits < 3 THEN 'dev'
  WHEN historic_hits < 5 THEN 'holdout' ELSE 'train' END AS split FROM ev_raw)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS entities FROM m a JOIN m b
ON a.entity_key = b.entity_key AND a.split < b.split GROUP BY a.split, b.split
""")
def split_overlap(spark, sf):
    h = F.col("historic_hits")
    members = X.evidence_raw(spark, sf).select(
        "entity_key", F.when(h < 3, "dev").when(h < 5, "holdout").otherwise("train").alias("split")
    )
    return E.split_overlap(members)


@query("seed_summary", """
WITH runs AS (SELECT l_returnflag AS mode, l_linenumber AS seed, avg(l_discount) AS win_rate, avg(l_tax) AS loss
  FROM lineitem GROUP BY l_returnflag, l_linenumber),
l AS (SELECT mode, 'win_rate' AS metric, win_rate AS v FROM runs UNION ALL SELECT mode, 'loss', loss FROM runs)
SELECT mode, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS seed_sd, count(*) AS runs
FROM l GROUP BY mode, metric
""")
def seed_summary(spark, sf):
    runs = (
        X.table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("seed"))
        .agg(F.avg("l_discount").alias("win_rate"), F.avg("l_tax").alias("loss"))
    )
    return E.seed_summary(runs, ["win_rate", "loss"]).select("mode", "metric", *rounded("mean", "seed_sd"), "runs")


@query("cost_projection", """
WITH t AS (SELECT count(*) AS rows, CAST(sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) AS BIGINT) AS ok_rows,
  sum(l_quantity) * 100 AS bytes, sum(l_linenumber) * 0.5 AS seconds FROM lineitem)
SELECT rows, ok_rows, round(bytes / ok_rows, 6) AS bytes_per_row, round(ok_rows / seconds, 6) AS rows_per_second,
  round(bytes / ok_rows * 7500000, 2) AS projected_bytes, round(7500000 / (ok_rows / seconds) / 3600, 6) AS projected_hours
FROM t
""")
def cost_projection(spark, sf):
    reports = (
        X.table(spark, sf, "lineitem")
        .groupBy("l_suppkey")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("l_returnflag") != "N").alias("ok_rows"),
            (F.sum("l_quantity") * 100).alias("bytes"),
            (F.sum("l_linenumber") * 0.5).alias("seconds"),
        )
    )
    return E.cost_projection(reports, 7_500_000).select(
        "rows", "ok_rows", *rounded("bytes_per_row", "rows_per_second"),
        F.round("projected_bytes", 2).alias("projected_bytes"), *rounded("projected_hours"),
    )
