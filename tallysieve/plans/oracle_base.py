"""Shared SQL fragments of the oracle queries (plain SQL over the given tables)."""

ENTITY = "l_partkey::VARCHAR || ':' || l_suppkey::VARCHAR"


def code(p: str, s: str) -> str:
    return (
        f"'lib' || ({s} % 4)::VARCHAR || '-' || ({p} % 20)::VARCHAR || '-' || "
        f"CAST(floor({p} / 20.0) AS BIGINT)::VARCHAR || '-' || {s}::VARCHAR"
    )


RAW = f"""ev_raw AS (
  SELECT {ENTITY} AS entity_key, l_partkey AS partkey, {code('l_partkey', 'l_suppkey')} AS code,
    CAST(round(l_quantity) AS BIGINT) AS count_target,
    CAST(round(l_discount * 100) AS BIGINT) AS count_competitor,
    CAST(round(l_tax * 100) AS BIGINT) AS count_control,
    (l_quantity - 25.5) / 14.4 AS z_target, (l_discount - 0.05) / 0.03 AS z_competitor,
    (l_tax - 0.04) / 0.026 AS z_control, CAST(l_linenumber AS BIGINT) AS historic_hits
  FROM lineitem),
supp_raw AS (
  SELECT {ENTITY} AS entity_key, CAST(round(l_extendedprice) AS BIGINT) % 4 AS count_control,
    (l_tax - 0.04) / 0.026 AS z_control
  FROM lineitem WHERE l_returnflag = 'R')"""

DEDUP = RAW + """,
ded AS (
  SELECT entity_key, min(code) AS code, min(partkey) AS partkey, count(*) AS source_rows,
    CAST(sum(count_target) AS BIGINT) AS count_target, CAST(sum(count_competitor) AS BIGINT) AS count_competitor,
    CAST(sum(count_control) AS BIGINT) AS count_control,
    sum(z_target) / sqrt(count(*)) AS z_target, sum(z_competitor) / sqrt(count(*)) AS z_competitor,
    sum(z_control) / sqrt(count(*)) AS z_control, max(historic_hits) AS historic_hits
  FROM ev_raw GROUP BY entity_key)"""

EVIDENCE = DEDUP + """,
supp AS (
  SELECT entity_key, count(*) AS supplement_rows, CAST(sum(count_control) AS BIGINT) AS count_control_supplement,
    sum(z_control) / sqrt(count(*)) AS z_control_supplement
  FROM supp_raw GROUP BY entity_key),
ev AS (
  SELECT ded.*, coalesce(supplement_rows, 0) AS supplement_rows,
    coalesce(count_control_supplement, 0) AS count_control_supplement,
    coalesce(z_control_supplement, 0.0) AS z_control_supplement,
    greatest(count_control, coalesce(count_control_supplement, 0)) AS control_evidence
  FROM ded LEFT JOIN supp ON ded.entity_key = supp.entity_key)"""


def panel(size: int) -> str:
    return f"""SELECT DISTINCT 'C' || substr(sha256({ENTITY}), 1, 32) AS catalog_id, {ENTITY} AS entity_key
  FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = {size}"""


PANELS = f"""panel_v AS ({panel(1)}),
panel_t AS ({panel(2)}),
panel_all AS (SELECT entity_key FROM panel_v UNION SELECT entity_key FROM panel_t)"""

OPEN = EVIDENCE + ",\n" + PANELS + """,
open_ev AS (SELECT * FROM ev WHERE NOT EXISTS (SELECT 1 FROM panel_all p WHERE p.entity_key = ev.entity_key))"""


def bucket(text: str, salt: str, modulus: int = 1000) -> str:
    h = f"sha256('{salt}' || {text})"
    hexes = " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2))
    return f"CAST((('0x' || {hexes})::UBIGINT) % {modulus} AS INTEGER)"


def split(text: str) -> str:
    b = bucket(text, "group-split:")
    return f"CASE WHEN {b} < 800 THEN 'train' WHEN {b} < 900 THEN 'dev' ELSE 'holdout' END"


SPLIT_KEY = "CASE WHEN trim(group_key) <> '' THEN 'group:' || group_key ELSE 'single:' || entity_key END"

INDEX = OPEN + f""",
grp AS (SELECT p_partkey AS partkey,
    CASE WHEN p_size > 47 THEN '' ELSE p_brand || '|' || p_type END AS group_key FROM part),
idx0 AS (SELECT o.*, coalesce(g.group_key, '') AS group_key FROM open_ev o LEFT JOIN grp g ON g.partkey = o.partkey),
idx1 AS (SELECT *, {SPLIT_KEY} AS split_key FROM idx0),
idx AS (SELECT *, {split('split_key')} AS split, {bucket('entity_key', 'sample:')} AS sample_bucket,
    (count_target >= 2 OR count_competitor > 0 OR count_control > 0 OR count_control_supplement > 0
     OR historic_hits > 0) AS informative,
    row_number() OVER (ORDER BY sha256(entity_key)) - 1 AS entity_id
  FROM idx1)"""

# means, observed evidence and cap-5 intervals
PREPARED = INDEX + """,
mean_ev AS (SELECT *, count_target * 1.0 / source_rows AS mt, count_competitor * 1.0 / source_rows AS mi,
    count_control * 1.0 / source_rows AS mn,
    count_control_supplement * 1.0 / greatest(supplement_rows, 1) AS ms FROM idx),
obs AS (SELECT *,
    CASE WHEN mt > 0 AND mi > 0 THEN ln(1 + mt) - ln(1 + mi) ELSE 0 END AS proxy_0,
    CASE WHEN mt > 0 AND mn > 0 THEN ln(1 + mt) - ln(1 + mn) ELSE 0 END AS proxy_1,
    CASE WHEN mt > 0 AND ms > 0 THEN ln(1 + mt) - ln(1 + ms) ELSE 0 END AS proxy_2,
    CASE WHEN mt > 0 AND mi > 0 THEN mt / (mt + 20) * mi / (mi + 5) / (1 + historic_hits) ELSE 0 END AS confidence_0,
    CASE WHEN mt > 0 AND mn > 0 THEN mt / (mt + 20) * mn / (mn + 5) / (1 + historic_hits) ELSE 0 END AS confidence_1,
    CASE WHEN mt > 0 AND ms > 0 THEN mt / (mt + 20) * ms / (ms + 5) / (1 + historic_hits) ELSE 0 END AS confidence_2
  FROM mean_ev),
ivl AS (SELECT *,
    CASE WHEN mt >= 5 AND mi = 0 THEN ln(1 + mt) - ln(6) ELSE proxy_0 END AS lower_0,
    CASE WHEN mt >= 5 AND mi = 0 THEN ln(1 + mt) ELSE proxy_0 END AS upper_0,
    CASE WHEN mt >= 5 AND mi = 0 THEN 0.05 * mt / (mt + 20) / (1 + historic_hits) / (1 + greatest(mn, ms) / mt)
      ELSE confidence_0 END AS interval_confidence_0,
    proxy_1 AS lower_1, proxy_1 AS upper_1, confidence_1 AS interval_confidence_1,
    proxy_2 AS lower_2, proxy_2 AS upper_2, confidence_2 AS interval_confidence_2
  FROM obs)"""

PARTS = """parts AS (SELECT *, split_part(code, '-', 1) AS library, split_part(code, '-', 2) AS b1,
    split_part(code, '-', 3) AS b2, split_part(code, '-', 4) AS b3 FROM {src}),
keyed AS (SELECT *, library || ':' || b1 || ':' || b2 AS k12, library || ':' || b1 || ':' || b3 AS k13,
    library || ':' || b2 || ':' || b3 AS k23 FROM parts)"""


def bit(token: str) -> str:
    return f"CAST((('0x' || substr(md5({token}), 1, 8))::UBIGINT) % 2048 AS INTEGER)"


def fp_rows(src: str) -> str:
    """(entity_key, bit) rows of the code fingerprints of table `src`."""
    def tag(t: str, col: str, n: int) -> str:
        tok = f"'{t}:' || {col} || ':' || j::VARCHAR"
        return f"SELECT entity_key, {bit(tok)} AS bit FROM {src} CROSS JOIN (SELECT unnest(range({n})) AS j)"

    return " UNION ".join([tag("lib", "library", 30), tag("b1", "b1", 20), tag("b2", "b2", 20), tag("b3", "b3", 20)])


DOC_FP = f"""doc_words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[ \\n\\t\\r]+')) AS w FROM documents),
doc_bits AS (SELECT DISTINCT doc_id, {bit('w')} AS bit FROM doc_words WHERE w <> ''),
doc_size AS (SELECT doc_id, count(*) AS fp_size FROM doc_bits GROUP BY doc_id)"""

SCORES = """score_a AS (SELECT doc_id AS catalog_id, n_chars::DOUBLE AS score FROM documents WHERE lang <> 'de'),
score_b AS (SELECT d.doc_id AS catalog_id, coalesce(w.n, 0)::DOUBLE AS score FROM documents d LEFT JOIN
  (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id,
      unnest(string_split_regex(lower(text), '[ \\n\\t\\r]+')) AS w FROM documents) WHERE w <> '' GROUP BY doc_id) w
  ON w.doc_id = d.doc_id WHERE source <> 'src3'),
score_c AS (SELECT doc_id AS catalog_id, (quality - 0.5 * toxic)::DOUBLE AS score FROM labels),
score_panel AS (SELECT doc_id AS catalog_id, lang || '/' || source AS group_key, n_chars <= 5000 AS eligible
  FROM documents)"""

LABELLED = """labelled AS (SELECT l.doc_id AS entity_id, quality AS label, n_chars::DOUBLE AS score, lang, source, toxic
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
