"""Registered queries: metrics, resampling, distribution shift, matching, models."""

from pyspark.sql import functions as F

from tallysieve.functions import columns as C
from tallysieve.functions import fingerprints as FP
from tallysieve.functions.hashing import order_hash
from tallysieve.operators import evidence as E
from tallysieve.operators import matching as MT
from tallysieve.operators import metrics as M
from tallysieve.operators import models as ML
from tallysieve.operators import ranking as R
from tallysieve.operators import resampling as RS
from tallysieve.operators import shift as D
from tallysieve.operators import similarity as S
from tallysieve.plans import fixtures as X
from tallysieve.plans import oracle_base as O
from tallysieve.plans.queries_evidence import ACTIVE_SQL, r6, rounded
from tallysieve.plans.queries_pairs import NEAREST, SENS, RET, matched_ctes, matched
from tallysieve.plans.registry import query
from tallysieve.session import materialise, store


# --- score metrics ---------------------------------------------------------

AUC = """(SELECT sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) FROM (
  SELECT score, p, n, sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS below FROM (
    SELECT score, sum(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS p, sum(CASE WHEN label = 1 THEN 0.0 ELSE 1.0 END) AS n
    FROM {src} GROUP BY score)))"""
AP = """(SELECT sum(p * tp / (tp + fp)) / sum(p) FROM (
  SELECT p, sum(p) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM (
    SELECT score, sum(CASE WHEN label = 1 THEN 1.0 ELSE 0.0 END) AS p, sum(CASE WHEN label = 1 THEN 0.0 ELSE 1.0 END) AS n
    FROM {src} GROUP BY score)))"""


@query("auroc", f"WITH {O.LABELLED} SELECT round({AUC.format(src='labelled')}, 6) AS auroc")
def auroc(spark, sf):
    return M.auroc(X.labelled(spark, sf)).select(*rounded("auroc"))


@query("auroc_evidence", f"""
WITH {O.INDEX}, labelled AS (SELECT round({ACTIVE_SQL}, 9) AS score, CASE WHEN {SENS} THEN 1 ELSE 0 END AS label FROM idx
  WHERE ({SENS}) OR ({RET}))
SELECT round({AUC.format(src='labelled')}, 6) AS auroc
""")
def auroc_evidence(spark, sf):
    rows = X.index(spark, sf).select(F.round(C.active_score(), 9).alias("score"), C.eval_label().alias("label"))
    return M.auroc(rows.where("label >= 0")).select(*rounded("auroc"))


@query("average_precision", f"WITH {O.LABELLED} SELECT round({AP.format(src='labelled')}, 6) AS average_precision")
def average_precision(spark, sf):
    return M.average_precision(X.labelled(spark, sf)).select(*rounded("average_precision"))


@query("spearman", f"""
WITH {O.SCORES}, j AS (SELECT a.score AS x, b.score AS y FROM score_a a JOIN score_b b ON a.catalog_id = b.catalog_id),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j)
SELECT round(corr(rx, ry), 6) AS spearman FROM r
""")
def spearman(spark, sf):
    joined = R.score_difference(X.scores(spark, sf, "a"), X.scores(spark, sf, "b"))
    return M.spearman(joined, "target_score", "off_target_score").select(*rounded("spearman"))


@query("score_property_correlation", f"""
WITH {O.DEDUP}, l AS (SELECT z_target AS s, 'count_competitor' AS property, count_competitor::DOUBLE AS v FROM ded
  UNION ALL SELECT z_target, 'historic_hits', historic_hits::DOUBLE FROM ded),
k AS (SELECT property, round(s, 9) AS s, v FROM l),
r AS (SELECT property, rank() OVER (PARTITION BY property ORDER BY s) + (count(*) OVER (PARTITION BY property, s) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY property ORDER BY v) + (count(*) OVER (PARTITION BY property, v) - 1) / 2.0 AS ry FROM k)
SELECT property, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY property
""")
def score_property_correlation(spark, sf):
    rows = X.dedup(spark, sf).withColumn("s", F.round("z_target", 9))
    return M.score_property_correlation(rows, "s", ["count_competitor", "historic_hits"]).select(
        "property", *rounded("spearman")
    )


@query("control_summary", f"""
WITH {O.SCORES}, j AS (SELECT a.catalog_id, a.score AS full_score, b.score AS words, -b.score AS reversed
  FROM score_a a JOIN score_b b ON a.catalog_id = b.catalog_id),
l AS (SELECT catalog_id, full_score, 'words' AS control, words AS v FROM j UNION ALL SELECT catalog_id, full_score, 'reversed', reversed FROM j),
r AS (SELECT *, rank() OVER (PARTITION BY control ORDER BY full_score) + (count(*) OVER (PARTITION BY control, full_score) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY control ORDER BY v) + (count(*) OVER (PARTITION BY control, v) - 1) / 2.0 AS ry,
  row_number() OVER (PARTITION BY control ORDER BY v DESC, catalog_id) AS n,
  row_number() OVER (PARTITION BY control ORDER BY full_score DESC, catalog_id) AS nf FROM l)
SELECT control, round(corr(rx, ry), 6) AS spearman, round(stddev_pop(v), 6) AS std,
  round(avg(abs(v - full_score)), 6) AS mean_absolute_change,
  CAST(sum(CASE WHEN n <= 50 AND nf <= 50 THEN 1 ELSE 0 END) AS BIGINT) AS top_overlap FROM r GROUP BY control
""")
def control_summary(spark, sf):
    joined = R.score_difference(X.scores(spark, sf, "a"), X.scores(spark, sf, "b")).select(
        "catalog_id", F.col("target_score").alias("full_score"), F.col("off_target_score").alias("words"),
        (-F.col("off_target_score")).alias("reversed"),
    )
    return M.control_summary(joined, "full_score", ["words", "reversed"], "catalog_id").select(
        "control", *rounded("spearman", "std", "mean_absolute_change"), "top_overlap"
    )


_MASKS = {"all": "TRUE", "english": "lang = 'en'", "long": "score > 1000", "toxic": "toxic = 1"}


@query("subset_auroc", f"WITH {O.LABELLED} " + " UNION ALL ".join(
    f"SELECT '{n}' AS subset, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, "
    f"round({AUC.format(src=f'(SELECT * FROM labelled WHERE {m})')}, 6) AS auroc, "
    f"round({AP.format(src=f'(SELECT * FROM labelled WHERE {m})')}, 6) AS average_precision FROM labelled WHERE {m}"
    for n, m in _MASKS.items()))
def subset_auroc(spark, sf):
    rows = X.labelled(spark, sf)
    masks = {
        "all": F.lit(True), "english": F.col("lang") == "en", "long": F.col("score") > 1000, "toxic": F.col("toxic") == 1,
    }
    return M.subset_performance(rows, masks).select("subset", "n", "positives", *rounded("auroc", "average_precision"))


# --- resampling ------------------------------------------------------------

MIDRANK = """mid AS (SELECT entity_id, label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM labelled),
tot AS (SELECT sum(label) AS p, count(*) - sum(label) AS n FROM labelled)"""


@query("permutation_p", f"""
WITH {O.LABELLED}, {MIDRANK},
many AS (SELECT rep, r, row_number() OVER (PARTITION BY rep ORDER BY sha256('2026|' || rep::VARCHAR || '|' || entity_id::VARCHAR)) AS i
  FROM mid CROSS JOIN (SELECT unnest(range(1, 10001)) AS rep)),
null_auc AS (SELECT rep, (sum(r) - max(p) * (max(p) + 1) / 2.0) / (max(p) * max(n)) AS a FROM many CROSS JOIN tot WHERE i <= p GROUP BY rep),
obs AS (SELECT {AUC.format(src='labelled')} AS auroc)
SELECT round(max(auroc), 6) AS auroc, round((count(*) FILTER (WHERE a >= auroc - 1e-12) + 1) / 10001.0, 6) AS p_value FROM null_auc CROSS JOIN obs
""")
def permutation_p(spark, sf):
    return M.permutation_p(X.labelled(spark, sf), 10_000, 2026, "entity_id").select(*rounded("auroc", "p_value"))


@query("bootstrap_ci", f"""
WITH {O.LABELLED},
slots AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY sha256(entity_id::VARCHAR)) - 1 AS slot FROM labelled),
size AS (SELECT label, count(*) AS n FROM labelled GROUP BY label),
draws AS (SELECT rep, s.label, CAST(('0x' || substr(sha256('9|' || rep::VARCHAR || '|' || s.label::VARCHAR || '|' || slot::VARCHAR), 1, 15))::UBIGINT % n AS BIGINT) AS pick
  FROM slots s JOIN size ON size.label = s.label CROSS JOIN (SELECT unnest(range(1, 2001)) AS rep)),
smp AS (SELECT rep, d.label, s.score FROM draws d JOIN slots s ON s.label = d.label AND s.slot = d.pick),
g AS (SELECT rep, score, sum(label) * 1.0 AS p, sum(1 - label) * 1.0 AS n FROM smp GROUP BY rep, score),
w AS (SELECT rep, p, n, sum(n) OVER (PARTITION BY rep ORDER BY score) - n AS below,
  sum(p) OVER (PARTITION BY rep ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY rep ORDER BY score DESC) AS fp FROM g),
m AS (SELECT rep, sum(p * (below + n / 2)) / (sum(p) * sum(n)) AS auroc, sum(p * tp / (tp + fp)) / sum(p) AS ap FROM w GROUP BY rep)
SELECT 'auroc' AS metric, round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.975), 6) AS high FROM m
UNION ALL SELECT 'average_precision', round(quantile_cont(ap, 0.025), 6), round(quantile_cont(ap, 0.975), 6) FROM m
""")
def bootstrap_ci(spark, sf):
    return M.bootstrap_ci(X.labelled(spark, sf), 2_000, 9, "entity_id").select("metric", *rounded("low", "high"))


@query("benchmark_metrics", f"""
WITH {O.LABELLED}, {MIDRANK},
many AS (SELECT rep, r, row_number() OVER (PARTITION BY rep ORDER BY sha256('2026|' || rep::VARCHAR || '|' || entity_id::VARCHAR)) AS i
  FROM mid CROSS JOIN (SELECT unnest(range(1, 10001)) AS rep)),
null_auc AS (SELECT rep, (sum(r) - max(p) * (max(p) + 1) / 2.0) / (max(p) * max(n)) AS a FROM many CROSS JOIN tot WHERE i <= p GROUP BY rep),
noise AS (SELECT label, ('0x' || substr(sha256('2026-noise|' || entity_id::VARCHAR), 1, 15))::UBIGINT % 1099511627776 AS score FROM labelled),
f AS (SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, stddev_pop(score) AS score_std, avg(label) AS prevalence,
  {AUC.format(src='labelled')} AS auroc, {AP.format(src='labelled')} AS average_precision,
  {AUC.format(src='noise')} AS random_auroc, {AP.format(src='noise')} AS random_average_precision FROM labelled),
p AS (SELECT (count(*) FILTER (WHERE a >= auroc - 1e-12) + 1) / 10001.0 AS p_value FROM null_auc CROSS JOIN f)
SELECT n, positives, {r6('score_std', 'prevalence', 'auroc', 'average_precision', 'random_auroc', 'random_average_precision', 'p_value')},
  score_std > 0 AND auroc > 0.5 AND average_precision > prevalence AND p_value < 0.05 AS passed FROM f CROSS JOIN p
""")
def benchmark_metrics(spark, sf):
    report = M.benchmark(X.labelled(spark, sf), 10_000, 2026, "entity_id")
    return report.select(
        "n", "positives",
        *rounded("score_std", "prevalence", "auroc", "average_precision", "random_auroc", "random_average_precision", "p_value"),
        "passed",
    )


def _evidence_scores(spark, sf):
    rows = X.index(spark, sf).select(F.round(C.active_score(), 9).alias("score"), C.eval_label().alias("label"))
    return materialise(rows.where("label >= 0"))


@query("permutation_evidence")
def permutation_evidence(spark, sf):
    return RS.permutation_p(_evidence_scores(spark, sf), 10_000, 2026).select(*rounded("auroc", "p_value"))


@query("bootstrap_evidence")
def bootstrap_evidence(spark, sf):
    return RS.bootstrap_ci(_evidence_scores(spark, sf), 2_000, 9).select("metric", *rounded("low", "high"))


# --- pairs inside batches --------------------------------------------------

# a shard is a bounded run of row ids, so batches can be cut inside it
SHARD_ROWS = 5000


# what the channels are made of
CHANNEL_INPUTS = [
    "split", "source_rows", "supplement_rows", *C.COUNT_COLUMNS, "count_control_supplement", "historic_hits", *C.Z_COLUMNS,
]


def _channels(spark, sf, zero_cap=0, again=False):
    """(entity, channel) rows with proxies, intervals, confidence, a score and its shard; the index is written if read `again`."""
    index = X.index(spark, sf, row_ids=True, keep=CHANNEL_INPUTS)
    index = E.prepared_evidence(store(index) if again else index, zero_cap)
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("channel"), F.col(f"proxy_{k}").alias("proxy"), F.col(f"lower_{k}").alias("lower"),
                F.col(f"upper_{k}").alias("upper"), F.col(f"interval_confidence_{k}").alias("confidence"),
            )
            for k in range(3)
        ]
    )
    # the deviation of counts from a smooth trend serves as the score under test
    score = F.col("z_target") - 0.5 * F.col("z_competitor")
    index = index.withColumn("shard", F.floor(F.col("entity_id") / SHARD_ROWS).cast("int"))
    return index, index.select(
        "entity_key", "entity_id", "split", "shard", "mean_target", "mean_competitor", score.alias("score"),
        F.inline(rows),
    ).where("confidence > 0")


CHANNEL_SQL = f"""shd AS (SELECT ivl.*, CAST(floor(entity_id / {SHARD_ROWS}.0) AS INTEGER) AS shard,
  z_target - 0.5 * z_competitor AS score FROM ivl),
chn AS (""" + " UNION ALL ".join(
    f"SELECT entity_key, entity_id, split, shard, mt, mi, score, {k} AS channel, proxy_{k} AS proxy, {{lo}}_{k} AS lower, "
    f"{{up}}_{k} AS upper, {{cf}}_{k} AS confidence FROM shd WHERE {{cf}}_{k} > 0" for k in range(3)
) + ")"


def channel_sql(cap: int) -> str:
    names = {"lo": "lower", "up": "upper", "cf": "interval_confidence"} if cap else {
        "lo": "proxy", "up": "proxy", "cf": "confidence"}
    return CHANNEL_SQL.format(**names)


DEV_BATCH = """dev AS (SELECT *, row_number() OVER (PARTITION BY channel, shard ORDER BY entity_id) - 1 AS position,
  count(*) OVER (PARTITION BY channel, shard) AS m FROM chn WHERE split = 'dev'),
bat AS (SELECT *, CAST(floor(position / 32.0) AS INTEGER) AS batch FROM dev WHERE NOT (m % 32 = 1 AND position = m - 1))"""
TRAIN_BATCH = """trn AS (SELECT *, row_number() OVER (PARTITION BY channel, shard ORDER BY sha256('3|' || entity_key), entity_key) - 1 AS position,
  count(*) OVER (PARTITION BY channel, shard) AS m FROM chn WHERE split = 'train'),
tbat AS (SELECT *, CAST(floor(position / 32.0) AS INTEGER) - CASE WHEN m % 32 = 1 AND position = m - 1 THEN 1 ELSE 0 END AS batch
  FROM trn WHERE m >= 2)"""


def _dev_batches(channels):
    return R.assign_batches(channels.where("split = 'dev'"), ["channel", "shard"], ["entity_id"], 32, "drop")


def _train_batches(channels, seed=3):
    order = [order_hash(seed, "entity_key"), "entity_key"]
    return R.assign_batches(channels.where("split = 'train'"), ["channel", "shard"], order, 32, "merge")


@query("batch_assign", f"""
WITH {O.PREPARED}, {channel_sql(5)}, {TRAIN_BATCH} SELECT entity_key, channel, shard, position, batch FROM tbat
""")
def batch_assign(spark, sf):
    return _train_batches(_channels(spark, sf, 5)[1]).select(
        "entity_key", "channel", "shard", F.col("position").cast("bigint").alias("position"), "batch"
    )


@query("visit_counts", f"""
WITH {O.PREPARED}, {channel_sql(5)}, {TRAIN_BATCH} SELECT entity_key, count(*) AS visits FROM tbat GROUP BY entity_key
""")
def visit_counts(spark, sf):
    return ML.visit_counts(_train_batches(_channels(spark, sf, 5)[1]))


@query("training_coverage", f"""
WITH {O.PREPARED}, {channel_sql(5)}, {TRAIN_BATCH},
el AS (SELECT shard, count(*) FILTER (WHERE split = 'train' AND (interval_confidence_0 > 0 OR interval_confidence_1 > 0 OR interval_confidence_2 > 0)) AS eligible_train,
  count(*) FILTER (WHERE split = 'train' AND interval_confidence_0 > 0 AND confidence_0 = 0) AS added_zero_competitor_train FROM shd GROUP BY shard),
v AS (SELECT shard, count(DISTINCT entity_key) AS unique_ranked_train FROM tbat GROUP BY shard)
SELECT 1 AS pass, el.shard, eligible_train, unique_ranked_train, added_zero_competitor_train FROM el JOIN v ON v.shard = el.shard
""")
def training_coverage(spark, sf):
    index, channels = _channels(spark, sf, 5, again=True)
    visits = _train_batches(channels).withColumn("pass", F.lit(1))
    return E.training_coverage(visits, index)


SP = "(greatest(-({x}), 0.0) + ln(1 + exp(-abs({x}))))"
PAIR_SUMS = """count(*) AS pairs, sum(w * {sp}) AS loss_sum, sum(w) AS weight_sum,
  sum(w * CASE WHEN g > 0 THEN 1.0 WHEN g = 0 THEN 0.5 ELSE 0.0 END) AS weighted_wins""".format(sp=SP.format(x="g / 0.1"))
LOSS = f"""bp AS (SELECT a.channel, least(a.confidence, b.confidence) AS w, (a.score - b.score) * sign(a.proxy - b.proxy) AS g
  FROM bat a JOIN bat b ON a.channel = b.channel AND a.shard = b.shard AND a.batch = b.batch AND a.position < b.position
  WHERE abs(a.proxy - b.proxy) >= {C.LN2 - M.MARGIN_SLACK!r}),
pl AS (SELECT channel, {PAIR_SUMS} FROM bp GROUP BY channel)"""
SUMS = ("loss_sum", "weight_sum", "weighted_wins")


@query("pair_loss", f"WITH {O.PREPARED}, {channel_sql(0)}, {DEV_BATCH}, {LOSS} SELECT channel, pairs, {r6(*SUMS)} FROM pl")
def pair_loss(spark, sf):
    return M.pair_loss(_dev_batches(_channels(spark, sf)[1])).select("channel", "pairs", *rounded(*SUMS))


@query("interval_pair_loss", f"""
WITH {O.PREPARED}, {channel_sql(5)}, {DEV_BATCH},
bp AS (SELECT a.channel, least(a.confidence, b.confidence) AS w,
    (a.score - b.score) * CASE WHEN a.lower - b.upper >= {C.LN2 - M.MARGIN_SLACK!r} THEN 1 ELSE -1 END AS g
  FROM bat a JOIN bat b ON a.channel = b.channel AND a.shard = b.shard AND a.batch = b.batch AND a.position < b.position
  WHERE a.lower - b.upper >= {C.LN2 - M.MARGIN_SLACK!r} OR b.lower - a.upper >= {C.LN2 - M.MARGIN_SLACK!r}),
pl AS (SELECT channel, {PAIR_SUMS} FROM bp GROUP BY channel)
SELECT channel, pairs, {r6(*SUMS)} FROM pl
""")
def interval_pair_loss(spark, sf):
    return M.interval_pair_loss(_dev_batches(_channels(spark, sf, 5)[1])).select("channel", "pairs", *rounded(*SUMS))


@query("pair_metrics", f"""
WITH {O.PREPARED}, {channel_sql(0)}, {DEV_BATCH}, {LOSS},
s AS (SELECT channel, pairs, weighted_wins / weight_sum AS weighted_win_rate, loss_sum / pairs AS confidence_scaled_loss,
  CASE WHEN channel = 0 THEN 2.0 ELSE 1.0 END AS cw FROM pl)
SELECT channel, pairs, {r6('weighted_win_rate', 'confidence_scaled_loss')},
  round((SELECT sum(cw * confidence_scaled_loss) / sum(cw) FROM s), 6) AS selection_loss FROM s
""")
def pair_metrics(spark, sf):
    stats = materialise(M.pair_loss(_dev_batches(_channels(spark, sf)[1])))
    return M.summarize_channels(stats).select(
        "channel", "pairs", *rounded("weighted_win_rate", "confidence_scaled_loss", "selection_loss")
    )


_STRATA = {
    "all": "TRUE", "equal_target_counts": "ta = tb", "both_proxy_nonpositive": "pa <= 0 AND pb <= 0",
    "preferred_target_at_most_one": "CASE WHEN pa > pb THEN ta ELSE tb END <= 1",
    "either_target_at_least_five": "(ta >= 5 OR tb >= 5)", "both_target_at_least_five": "ta >= 5 AND tb >= 5",
}
_PREDICTORS = {"score": "sa - sb", "target_count_only": "ln(1 + ta) - ln(1 + tb)",
               "inverse_competitor_only": "ln(1 + ib) - ln(1 + ia)"}


@query("pair_strata", f"""
WITH {O.PREPARED}, {channel_sql(0)}, {DEV_BATCH},
bp AS (SELECT least(a.confidence, b.confidence) AS w, a.proxy AS pa, b.proxy AS pb, a.mt AS ta, b.mt AS tb, a.mi AS ia, b.mi AS ib,
    a.score AS sa, b.score AS sb
  FROM bat a JOIN bat b ON a.channel = b.channel AND a.shard = b.shard AND a.batch = b.batch AND a.position < b.position
  WHERE a.channel = 0 AND abs(a.proxy - b.proxy) >= {C.LN2 - M.MARGIN_SLACK!r}),
gp AS ({" UNION ALL ".join(
    f"SELECT '{s}' AS stratum, '{p}' AS predictor, w, ({g}) * sign(pa - pb) AS g FROM bp WHERE {m}"
    for s, m in _STRATA.items() for p, g in _PREDICTORS.items())})
SELECT stratum, predictor, count(*) AS pairs, round(sum(w), 6) AS weight_sum,
  round(sum(w * CASE WHEN g > 0 THEN 1.0 WHEN g = 0 THEN 0.5 ELSE 0.0 END), 6) AS weighted_wins FROM gp GROUP BY stratum, predictor
""")
def pair_strata(spark, sf):
    batches = _dev_batches(_channels(spark, sf)[1]).where("channel = 0")
    return M.pair_strata(batches, ["score"], ["channel", "shard"]).select(
        "stratum", "predictor", "pairs", *rounded("weight_sum", "weighted_wins")
    )


# --- explicit pairs --------------------------------------------------------

SCORED = f"""WITH {O.INDEX}, {matched_ctes('open_ev')},
sp AS (SELECT m.*, a.split, a.z_target AS ps, b.z_target AS ns FROM mp m JOIN idx a ON a.entity_key = m.positive_key
  JOIN idx b ON b.entity_key = m.negative_key)"""
CREDIT = "CASE WHEN ps > ns THEN 1.0 WHEN ps = ns THEN 0.5 ELSE 0.0 END"


def _scored(spark, sf):
    index = store(X.index(spark, sf).select("entity_key", "split", F.col("z_target").alias("score")))
    pairs = M.scored_pairs(matched(spark, sf), index)
    return pairs.join(index.select(F.col("entity_key").alias("positive_key"), "split"), "positive_key")


@query("pair_win_rate", f"""{SCORED}
SELECT count(*) AS pairs, round(avg(CASE WHEN ps > ns THEN 1.0 ELSE 0.0 END), 6) AS strict_win_rate FROM sp
""")
def pair_win_rate(spark, sf):
    return M.win_rates(_scored(spark, sf)).select("pairs", *rounded("strict_win_rate"))


@query("split_win_rate", f"""{SCORED}
SELECT split, count(*) AS pairs, round(avg({CREDIT}), 6) AS win_rate,
  round(sum(pair_weight * {CREDIT}) / sum(pair_weight), 6) AS weighted_win_rate FROM sp GROUP BY split
""")
def split_win_rate(spark, sf):
    return M.win_rates(_scored(spark, sf), ["split"]).select("split", "pairs", *rounded("win_rate", "weighted_win_rate"))


@query("weighted_pair_loss", f"""{SCORED}
SELECT round(sum(pair_weight * {SP.format(x='(ps - ns) / 0.1')}) / sum(pair_weight), 6) AS weighted_pair_loss FROM sp
""")
def weighted_pair_loss(spark, sf):
    return M.weighted_pair_loss(_scored(spark, sf)).select(*rounded("weighted_pair_loss"))


@query("multitask_loss", f"""
WITH {O.EVIDENCE}, d AS (SELECT ln(1 + count_target) - z_target AS d1, ln(1 + count_competitor) - z_competitor AS d2,
  least(5.0, greatest(1.0, 1 + ln(1 + count_target + count_competitor + count_control + count_control_supplement + historic_hits))) AS w FROM ev),
l AS (SELECT (1.0 * CASE WHEN abs(d1) < 1 THEN 0.5 * d1 * d1 ELSE abs(d1) - 0.5 END
  + 0.5 * CASE WHEN abs(d2) < 1 THEN 0.5 * d2 * d2 ELSE abs(d2) - 0.5 END) / 1.5 AS l, w FROM d)
SELECT round(sum(l * w) / greatest(sum(w), 1e-8), 6) AS multitask_loss FROM l
""")
def multitask_loss(spark, sf):
    tasks = {
        "target": (F.log1p("count_target"), F.col("z_target")),
        "competitor": (F.log1p("count_competitor"), F.col("z_competitor")),
    }
    return M.multitask_loss(
        X.evidence(spark, sf), tasks, {"target": 1.0, "competitor": 0.5}, C.evidence_weight()
    ).select(*rounded("multitask_loss"))


# --- distribution shift ----------------------------------------------------

URGENT = "o_orderpriority = '1-URGENT'"
CDF = f"""c AS (SELECT o_totalprice AS v, count(*) FILTER (WHERE {URGENT}) AS a, count(*) FILTER (WHERE NOT {URGENT}) AS b FROM orders GROUP BY o_totalprice),
n AS (SELECT sum(a) * 1.0 AS na, sum(b) * 1.0 AS nb FROM c),
cdf AS (SELECT v, lead(v) OVER (ORDER BY v) AS nv, abs(sum(a) OVER (ORDER BY v) / na - sum(b) OVER (ORDER BY v) / nb) AS gap FROM c CROSS JOIN n)"""


def _orders(spark, sf):
    return X.table(spark, sf, "orders"), F.col("o_orderpriority") == "1-URGENT"


@query("ks_statistic", f"WITH {CDF} SELECT round(max(gap), 6) AS ks_statistic FROM cdf")
def ks_statistic(spark, sf):
    orders, reference = _orders(spark, sf)
    return D.ks_and_wasserstein(D.sample_counts(orders, "o_totalprice", reference)).select(*rounded("ks_statistic"))


@query("wasserstein", f"WITH {CDF} SELECT round(sum(gap * (nv - v)), 4) AS wasserstein FROM cdf")
def wasserstein(spark, sf):
    orders, reference = _orders(spark, sf)
    found = D.ks_and_wasserstein(D.sample_counts(orders, "o_totalprice", reference))
    return found.select(F.round("wasserstein", 4).alias("wasserstein"))


PSI_SQL = f"""ed AS (SELECT {", ".join(f"quantile_cont(o_totalprice, {i / 10}) AS q{i}" for i in range(1, 10))} FROM orders WHERE {URGENT}),
bn AS (SELECT {URGENT} AS ref, {" + ".join(f"(CASE WHEN o_totalprice >= q{i} THEN 1 ELSE 0 END)" for i in range(1, 10))} AS bin FROM orders CROSS JOIN ed),
sh AS (SELECT bin, greatest(count(*) FILTER (WHERE ref) * 1.0 / (SELECT count(*) FROM bn WHERE ref), 1e-6) AS fa,
  greatest(count(*) FILTER (WHERE NOT ref) * 1.0 / (SELECT count(*) FROM bn WHERE NOT ref), 1e-6) AS fb FROM bn GROUP BY bin),
psi AS (SELECT sum((fb - fa) * ln(fb / fa)) AS psi FROM sh)"""


@query("psi", f"WITH {PSI_SQL} SELECT round(psi, 6) AS psi FROM psi")
def psi(spark, sf):
    orders, reference = _orders(spark, sf)
    return D.psi(D.sample_counts(orders, "o_totalprice", reference)).select(*rounded("psi"))


SHIFT_SQL = f"""
WITH {CDF}, {PSI_SQL}, ref AS (SELECT o_totalprice AS v FROM orders WHERE {URGENT}), cmp AS (SELECT o_totalprice AS v FROM orders WHERE NOT {URGENT}),
r AS (SELECT avg(v) AS m, stddev_samp(v) AS sd, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM ref)
SELECT 'o_totalprice' AS descriptor, round(r.m, 4) AS reference_mean, round(r.sd, 4) AS reference_sd, round(r.med, 4) AS reference_median,
  round(avg(v), 4) AS comparison_mean, round(quantile_cont(v, 0.5), 4) AS comparison_median,
  round((avg(v) - r.m) / r.sd, 6) AS standardized_mean_difference,
  round((SELECT sum(gap * (nv - v)) FROM cdf) / r.sd, 6) AS normalized_wasserstein, round((SELECT max(gap) FROM cdf), 6) AS ks_statistic,
  round((SELECT psi FROM psi), 6) AS psi, round(avg(CASE WHEN v < r.lo OR v > r.hi THEN 1.0 ELSE 0.0 END), 6) AS outside_1_99
FROM cmp CROSS JOIN r GROUP BY r.m, r.sd, r.med
"""
DESCRIPTORS = ("o_totalprice", "o_custkey", "o_orderkey")


@query("descriptor_shift", " UNION ALL ".join(f"SELECT * FROM ({SHIFT_SQL.replace('o_totalprice', d)})" for d in DESCRIPTORS))
def descriptor_shift(spark, sf):
    orders, reference = _orders(spark, sf)
    r4 = [F.round(c, 4).alias(c) for c in ("reference_mean", "reference_sd", "reference_median", "comparison_mean", "comparison_median")]
    return D.descriptor_shift(orders, DESCRIPTORS, reference).select(
        "descriptor", *r4,
        *rounded("standardized_mean_difference", "normalized_wasserstein", "ks_statistic", "psi", "outside_1_99"),
    )


DOC_TEXT = "d.text IN (SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM good))"


@query("domain_membership", f"""{NEAREST}
SELECT n.query_entity_id AS entity_id, {DOC_TEXT} AS exact_in_reference,
  d.source IN (SELECT source FROM documents WHERE doc_id IN (SELECT doc_id FROM good)) AS group_in_reference,
  n.ref_entity_id, round(similarity, 6) AS similarity FROM nearest n JOIN documents d ON d.doc_id = n.query_entity_id
""")
def domain_membership(spark, sf):
    asked, reference = X.reference_documents(spark, sf)
    nearest = S.nearest_tanimoto(asked, reference, key="entity_id").select(
        F.col("query_entity_id").alias("entity_id"), "ref_entity_id", "similarity"
    )
    docs = X.table(spark, sf, "documents").select(
        F.col("doc_id").alias("entity_id"), F.sha2("text", 256).alias("text_hash"), "source"
    )
    good = X.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("entity_id"))
    inside, outside = docs.join(good, "entity_id", "left_semi"), docs.join(good, "entity_id", "left_anti")
    return D.domain_membership(outside, inside, nearest, "entity_id", "text_hash", "source").select(
        "entity_id", "exact_in_reference", "group_in_reference", "ref_entity_id", *rounded("similarity")
    )


@query("transfer_stress", f"""{NEAREST}
SELECT n.lang, count(*) AS rows, count(*) FILTER (WHERE n.lang <> 'en' AND z.fp_size <= 37 AND d.n_chars <= 500 AND similarity <= 0.4) AS stress
FROM nearest n JOIN documents d ON d.doc_id = n.query_entity_id LEFT JOIN doc_size z ON z.doc_id = n.query_entity_id GROUP BY n.lang
""")
def transfer_stress(spark, sf):
    asked, reference = X.reference_documents(spark, sf)
    nearest = S.nearest_tanimoto(asked, reference, key="entity_id")
    docs = X.table(spark, sf, "documents").select(F.col("doc_id").alias("query_entity_id"), "n_chars")
    rows = nearest.join(asked.drop("query_fp_words"), "query_entity_id").join(docs, "query_entity_id")
    split = F.when(F.col("query_group_key") != "en", "dev").otherwise("train")
    flag = D.transfer_stress(split, F.col("query_fp_size"), F.col("n_chars"), F.col("similarity"))
    return rows.groupBy(F.col("query_group_key").alias("lang")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(flag).alias("stress")
    )


@query("group_summary", f"""
WITH {O.DEDUP}, grp AS (SELECT p_partkey AS partkey, CASE WHEN p_size > 47 THEN '' ELSE p_brand || '|' || p_type END AS group_key,
  CASE WHEN p_retailprice >= 1000 THEN 'dear' ELSE 'cheap' END AS panel FROM part),
r AS (SELECT panel, group_key, count(*) AS n FROM ded d JOIN grp g ON g.partkey = d.partkey GROUP BY panel, group_key),
s AS (SELECT group_key FROM r GROUP BY group_key HAVING count(*) > 1)
SELECT panel, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE group_key <> '') AS groups,
  CAST(coalesce(sum(CASE WHEN group_key = '' THEN n END), 0) AS BIGINT) AS rows_without_group,
  count(*) FILTER (WHERE group_key <> '' AND group_key IN (SELECT group_key FROM s)) AS shared_groups FROM r GROUP BY panel
""")
def group_summary(spark, sf):
    part = X.table(spark, sf, "part").select(
        F.col("p_partkey").alias("partkey"), F.when(F.col("p_retailprice") >= 1000, "dear").otherwise("cheap").alias("panel")
    ).join(X.groups(spark, sf), "partkey")
    rows = E.dedup_evidence(X.evidence_raw(spark, sf), carry=["partkey"]).select("partkey").join(part, "partkey")
    return D.group_summary(rows, "panel", "group_key")


# --- matching and models ---------------------------------------------------


@query("matched_controls")
def matched_controls(spark, sf):
    customers = X.table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"), "c_mktsegment")
    return MT.matched_controls(
        customers.where("c_mktsegment = 'BUILDING'"), customers.where("c_mktsegment <> 'BUILDING'"),
        ["c_acctbal", "nation"], "c_custkey", 2026,
    )


def _features(spark, sf):
    return X.documents_fp(spark, sf).select("entity_id", "n_chars", ML.folded_vector("fp_bits", 32).alias("features"))


@query("pointwise_ranker")
def pointwise_ranker(spark, sf):
    features = materialise(_features(spark, sf))
    labelled = X.labelled(spark, sf).select("entity_id", "label", "source")
    good = labelled.where("label = 1").select("source", F.col("entity_id").alias("positive_key"))
    bad = labelled.where("label = 0").select("source", F.col("entity_id").alias("negative_key"))
    pairs = ML.paired_in_turn(good, bad, ["source"], "positive_key", "negative_key").withColumn("pair_weight", F.lit(1.0))
    return ML.pointwise_ranker(pairs, features, features, "entity_id").select("entity_id", *rounded("score"))


@query("pair_ranker")
def pair_ranker(spark, sf):
    names = ("z_target", "z_competitor", "z_control")
    index, channels = _channels(spark, sf, again=True)
    rows = channels.where("channel = 0").join(index.select("entity_key", F.array(*names).alias("x")), "entity_key")
    fitted = ML.pair_ranker(_train_batches(rows), ["channel", "shard"], columns=len(names))
    return index.select(
        "entity_key", sum((F.col(n) * w for n, w in zip(names[1:], fitted[1:])), F.col(names[0]) * fitted[0]).alias("score")
    ).select("entity_key", *rounded("score"))


@query("multi_target")
def multi_target(spark, sf):
    index = store(X.index(spark, sf).select("entity_key", *CHANNEL_INPUTS, "z_control_supplement", "informative", "sample_bucket"))
    scope = (F.col("split") == "train") & C.ablation_scope()
    return ML.multi_target(index, scope, ["count_target", "count_competitor", "count_control", "historic_hits"]).select(
        "entity_key", *rounded("predicted_active_score")
    )


@query("domain_classifier")
def domain_classifier(spark, sf):
    orders, reference = _orders(spark, sf)
    rows = orders.withColumn("month", F.month("o_orderdate")).withColumn("year", F.year("o_orderdate"))
    return ML.domain_classifier_auc(rows, ~reference, ["o_totalprice", "month", "year"], "o_orderkey").select(
        "fold", *rounded("auroc")
    )
