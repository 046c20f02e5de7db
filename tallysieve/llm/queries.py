"""Queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysieve.llm import (
    bpe, language, licences, near, packing, pieces, quality, repeats, runs, tokens, urls, variants, vectors,
)
from tallysieve.llm.common import ROW, table

# Fixed values: (verdict, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Hosts with these labels make up the derived list of unwanted URLs.
LISTED_LABELS = ("spam-farm", "cheap-pills", "casino-win", "ads-track", "free-bets", "adult-x")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; an operator's parameter, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_vocabulary() -> tuple[str, str, str]:
    import public_tokenizers

    return vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def packed(docs: DataFrame) -> DataFrame:
    """One row per piece, with the digest of its ids instead of the ids."""
    pieces = packing.cut_documents(docs, byte_vocabulary(), carry=["doc_id"])
    digest = pieces.withColumn("ids_crc32", F.crc32("token_bytes")).drop("token_bytes")
    out = packing.pack(digest)
    return out.select(
        f"{ROW}.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = repeats.repeated_spans(docs).select(F.col("id").alias("doc_id"), F.explode("spans").alias("s"))
    return spans.select(
        "doc_id", F.col("s.start").alias("start_word"), "s.n_words", F.col("s.seen_id").alias("first_doc_id")
    )


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = near.near_duplicates(docs, words=4, similarity=80)
    return out.withColumnRenamed("id", "doc_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokens.count_tokens(docs, vocabulary("piece_bpe_32k.model"), carry=["doc_id"])
    return out.select(f"{ROW}.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The derived list: canonical URLs of pages on hosts with a label of LISTED_LABELS."""
    host, path = urls.host_of(F.col("url")), urls.path_of(F.col("url"))
    on_list = F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, LISTED_LABELS)))
    return pages.where(on_list).select(urls.canonical(host, path).alias("url"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = urls.judge(pages, listed_urls(pages), URL_RULES)
    return out.select(f"{ROW}.page_id", "host", "path", "rule", "verdict", "listed")


OP5_SQL = """
WITH h AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') END AS canonical_url,
  CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM h),
l AS (SELECT DISTINCT canonical_url FROM c
      WHERE list_has_any(string_split(host, '.'), ['spam-farm', 'cheap-pills', 'casino-win', 'ads-track', 'free-bets', 'adult-x']) AND canonical_url IS NOT NULL)
SELECT page_id, host, path, rule, l.canonical_url IS NOT NULL AS listed,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN l ON c.canonical_url = l.canonical_url
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language.identify_fold(docs, vocabulary("piece_bpe_32k.model"), carry=["doc_id"])
    held_out = language.held_out(F.col(f"{ROW}.doc_id")).alias("held_out")
    return out.select(f"{ROW}.doc_id", held_out, "lang_pred", "score")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # the text is a source of the counts; only doc_id is carried on
    out = quality.judge(docs, carry=["doc_id"])
    return out.select(f"{ROW}.doc_id", *quality.COUNTS, "base_failed", "p_good", "kept")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary("piece_bpe_32k.model")
    out = pieces.encode(docs, path, carry=["doc_id"], verify=True)
    return out.select(
        f"{ROW}.doc_id",
        (F.octet_length("token_bytes") / 4).cast("long").alias("n_tokens"),
        F.crc32("token_bytes").alias("ids_crc32"),
        F.col("exact").alias("round_trip"),
    )


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = licences.scan(docs, licences.default_known(spark), "doc_id", carry=["doc_id"])
    return out.select(f"{ROW}.doc_id", "text_digest", "licence", F.array_join("notices", ",").alias("notices"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)
    return out.withColumnRenamed("id", "vec_id")


def with_planted_runs(key: Column, text: Column) -> Column:
    """The text; in a tenth of the documents, words from some place on repeat the first few from there."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words).cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    out = runs.periodic_runs(docs, carry=["doc_id"])
    # the greatest length, then the smallest start and period
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    out = out.select(
        f"{ROW}.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        top.alias("top"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    length, start, period = F.col("top.length"), -F.col("top.col2"), -F.col("top.col3")
    return out.select(
        "doc_id",
        "n_runs",
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )


def with_planted_slips() -> variants.Change:
    """Deletes a letter of about one word in a hundred, chosen by the document's number and the word."""
    last: list = [None, 0]

    def change(key: int | None, word: bytes) -> bytes:
        if key is None:
            return word
        if key != last[0]:
            last[:] = key, zlib.crc32(f"{key}:".encode())
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), last[1])
        if h % 97:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return change


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.variants(docs, change=with_planted_slips())


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(docs, path, carry=["doc_id"]).select(f"{ROW}.doc_id", "token_bytes")
    ids = ids.select(
        "doc_id",
        (F.octet_length("token_bytes") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_bytes", 256).alias("ids_sha256"),
        "token_bytes",
    )
    out = bpe.decode(ids, path, carry=["doc_id", "n_tokens", "ids_sha256"])
    return out.select(f"{ROW}.*", F.sha2("data", 256).alias("decoded_sha256"))


WORDS_SQL = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP1_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format(text="coalesce(text, '')")} AS words FROM documents),
p AS (SELECT doc_id, s, md5(array_to_string(list_slice(words, s + 1, s + 50), ' ')) AS passage
  FROM (SELECT doc_id, words, unnest(range(len(words) - 49)) AS s FROM w)),
f AS (SELECT passage, min(doc_id::HUGEINT * 1000000000 + s) AS spot FROM p GROUP BY passage),
d AS (SELECT doc_id, s, CAST(spot // 1000000000 AS BIGINT) AS first_doc_id FROM p JOIN f USING (passage)
  WHERE spot // 1000000000 <> doc_id OR s - spot % 1000000000 >= 50),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM (
  SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 50 THEN 0 ELSE 1 END AS new FROM d))
SELECT doc_id, min(s) AS start_word, max(s) - min(s) + 50 AS n_words, arg_min(first_doc_id, s) AS first_doc_id
FROM i GROUP BY doc_id, island
"""

COMPONENTS_SQL = """sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS low FROM sym UNION SELECT sym.a, reach.low FROM reach JOIN sym ON sym.b = reach.node),
comp AS (SELECT node, min(low) AS low FROM reach GROUP BY node)"""

OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format(
    text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, s, s + 3), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, least(len(words), 1)) + 1)) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
{COMPONENTS_SQL}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low, w.doc_id) AS component_id, coalesce(low, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON node = w.doc_id
"""

OP10_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
{COMPONENTS_SQL},
deg AS (SELECT a AS node, count(*) AS n FROM sym GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON comp.node = vec_id LEFT JOIN deg ON deg.node = vec_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_packing": op2_packing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_licence_scan": op9_licence_scan,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLE = {
    "op1_suffix_array_dedup": OP1_SQL.strip(),
    "op3_minhash_near_dedup": OP3_SQL.strip(),
    "op5_url_filter": OP5_SQL.strip(),
    "op10_embedding_near_dedup": OP10_SQL.strip(),
}
