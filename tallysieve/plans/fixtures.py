"""The given tables reshaped to the evidence data model.

lineitem rows play barcode observations: the entity is (part, supplier), quantity is
the target count, discount and tax (in hundredths) are the competitor and control
counts, the line number is the history count. See FIXTURES.md for the mapping idea;
panels are chosen here by part size and the enumeration gives each part eight
suppliers, so that every derived table grows linearly with its source.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysieve.functions import columns as C
from tallysieve.functions import fingerprints as FP
from tallysieve.functions.hashing import order_hash
from tallysieve.operators import evidence as E
from tallysieve.operators.composed import Composed
from tallysieve.session import fan_out, materialise, spread, store

VALIDATION_SIZE, TEST_SIZE, BLANK_GROUP_SIZE = 1, 2, 47
ENUMERATED_SUPPLIERS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _entity(part: str, supplier: str):
    return F.concat_ws(":", F.col(part).cast("string"), F.col(supplier).cast("string"))


def _code(part: str, supplier: str):
    p, s = F.col(part), F.col(supplier)
    return F.concat_ws(
        "-",
        F.concat(F.lit("lib"), (s % 4).cast("string")),
        (p % 20).cast("string"),
        F.floor(p / 20).cast("string"),
        s.cast("string"),
    )


def evidence_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        _entity("l_partkey", "l_suppkey").alias("entity_key"),
        F.col("l_partkey").alias("partkey"),
        _code("l_partkey", "l_suppkey").alias("code"),
        F.round("l_quantity").cast("bigint").alias("count_target"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("count_competitor"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("count_control"),
        ((F.col("l_quantity") - 25.5) / 14.4).alias("z_target"),
        ((F.col("l_discount") - 0.05) / 0.03).alias("z_competitor"),
        ((F.col("l_tax") - 0.04) / 0.026).alias("z_control"),
        F.col("l_linenumber").cast("bigint").alias("historic_hits"),
    )


def supplement_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines play the later control release."""
    return (
        table(spark, sf_dir, "lineitem")
        .where("l_returnflag = 'R'")
        .select(
            _entity("l_partkey", "l_suppkey").alias("entity_key"),
            (F.round("l_extendedprice").cast("bigint") % 4).alias("count_control"),
            ((F.col("l_tax") - 0.04) / 0.026).alias("z_control"),
        )
    )


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partkey"),
        F.when(F.col("p_size") > BLANK_GROUP_SIZE, F.lit(""))
        .otherwise(F.concat_ws("|", "p_brand", "p_type"))
        .alias("group_key"),
    )


def _panel_entities(spark: SparkSession, sf_dir: str, *sizes: int) -> DataFrame:
    chosen = table(spark, sf_dir, "part").where(F.col("p_size").isin(*sizes))
    return (
        table(spark, sf_dir, "lineitem")
        .join(chosen.select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
        .select(_entity("l_partkey", "l_suppkey").alias("entity_key"))
        .distinct()
    )


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Blind panel: the observed entities of parts of one size."""
    size = {"validation": VALIDATION_SIZE, "test": TEST_SIZE}[name]
    return _panel_entities(spark, sf_dir, size).select(
        F.concat(F.lit("C"), F.substring(F.sha2("entity_key", 256), 1, 32)).alias("catalog_id"), "entity_key"
    )


def panels(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Keys of both panels, from one scan."""
    return [_panel_entities(spark, sf_dir, VALIDATION_SIZE, TEST_SIZE)]


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.dedup_evidence(evidence_raw(spark, sf_dir))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed evidence with the supplement attached."""
    return E.attach_supplement(dedup(spark, sf_dir), supplement_raw(spark, sf_dir))


def open_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence outside the blind panels."""
    return E.panel_exclusion(evidence(spark, sf_dir), panels(spark, sf_dir))


def index(spark: SparkSession, sf_dir: str, row_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    return E.canonical_index(
        evidence_raw(spark, sf_dir),
        supplement_raw(spark, sf_dir),
        panels(spark, sf_dir),
        groups(spark, sf_dir),
        "partkey",
        row_ids=row_ids,
        keep=keep,
    )


def with_parts(df: DataFrame, code: str = "code") -> DataFrame:
    fields = C.code_fields(code)
    return df.withColumn("_f", fields).where("_f is not null").withColumns(C.part_columns(F.col("_f"))).drop("_f")


PART_BITS = (("lib", "library", 30), ("b1", "b1", 20), ("b2", "b2", 20), ("b3", "b3", 20))


@functools.lru_cache(200_000)  # of a Python worker; about 40 MB
def _part_bits(tag: str, value: str, count: int) -> np.ndarray:
    token = lambda j: hashlib.md5(f"{tag}:{value}:{j}".encode()).hexdigest()[:8]
    return np.array([int(token(j), 16) % FP.WIDTH for j in range(count)], dtype=np.int16)


@functools.lru_cache(200_000)  # about 70 MB
def _part_words(tag: str, value: str, count: int) -> np.ndarray:
    marks = np.zeros(FP.WIDTH, bool)
    marks[_part_bits(tag, value, count)] = True
    return np.packbits(marks, bitorder="little").view("<u8")


def code_similarity(a: str, b: str):
    """Tanimoto similarity of the fingerprints that two code columns stand for (see `with_code_fingerprint`)."""

    @F.pandas_udf("double")
    def similarity(first: pd.DataFrame, second: pd.DataFrame) -> pd.Series:
        size = len(first)
        known = []
        for n, (tag, _, count) in enumerate(PART_BITS):
            codes, values = pd.factorize(np.concatenate([first[str(n)], second[str(n)]]))
            known.append((codes, np.array([_part_words(tag, v, count) for v in values])))
        out = np.empty(size)
        for start in range(0, size, 1024):  # the words of so many pairs stay in the cache
            rows = np.arange(start, min(size, start + 1024))
            words = [np.bitwise_or.reduce([bits[codes[rows + side * size]] for codes, bits in known]) for side in range(2)]
            both, either = (np.bitwise_count(x).sum(1, dtype="int64") for x in (words[0] & words[1], words[0] | words[1]))
            out[rows] = both / either
        return pd.Series(out)

    parts = lambda code: F.struct(*[C.code_fields(code)[n].alias(str(n)) for n in range(4)])
    return similarity(parts(a), parts(b))


def with_code_fingerprint(df: DataFrame) -> DataFrame:
    """30 bits for the library, 20 per part (in real data the fingerprint is an input column).

    The bit of a token is that of `FP.token_bit`. Each distinct part of an Arrow batch is
    hashed once.
    """

    @F.pandas_udf("fp_bits array<int>, fp_words array<bigint>")
    def build(lib: pd.Series, b1: pd.Series, b2: pd.Series, b3: pd.Series) -> pd.DataFrame:
        marks = np.zeros((len(lib), FP.WIDTH), dtype=bool)
        for (tag, _, count), column in zip(PART_BITS, (lib, b1, b2, b3)):
            codes, values = pd.factorize(column)
            known = np.array([_part_bits(tag, v, count) for v in values])
            marks[np.arange(len(lib))[:, None], known[codes]] = True
        positions = np.split(np.nonzero(marks)[1].astype("int32"), np.cumsum(marks.sum(1))[:-1])
        words = np.packbits(marks, axis=1, bitorder="little").view("<i8")
        return pd.DataFrame({"fp_bits": positions, "fp_words": list(words)})

    spread_out = fan_out(df, "entity_key") if "entity_key" in df.columns else df
    built = spread_out.withColumn("_fp", build(*[F.col(c) for _, c, _ in PART_BITS]))
    return built.select("*", "_fp.*").drop("_fp").withColumn("fp_size", F.size("fp_bits"))


@functools.lru_cache(200_000)
def _column_bits(column: str, value: str) -> np.ndarray:
    tag, _, count = next(part for part in PART_BITS if part[1] == column)
    return np.unique(_part_bits(tag, value, count))


CODE_PARTS = Composed(tuple(column for _, column, _ in PART_BITS), _column_bits, code_similarity, with_code_fingerprint)


def enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makeable entities: eight suppliers spread over the supplier range per part."""
    suppliers = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    step = F.floor(suppliers / ENUMERATED_SUPPLIERS)
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partkey"),
        F.explode(F.sequence(F.lit(0), F.lit(ENUMERATED_SUPPLIERS - 1))).alias("i"),
        step.alias("step"),
        suppliers.alias("suppliers"),
    )
    return (
        rows.withColumn("suppkey", (F.col("partkey") + F.col("i") * F.col("step")) % F.col("suppliers"))
        .select(_entity("partkey", "suppkey").alias("entity_key"), _code("partkey", "suppkey").alias("code"))
        .distinct()
    )


def words_of(text):
    return F.array_distinct(F.filter(F.split(F.lower(text), "[ \\n\\t\\r]+"), lambda w: w != ""))


def documents_fp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as bit fingerprints of their distinct words."""
    docs = spread(table(spark, sf_dir, "documents")).select(
        F.col("doc_id").alias("entity_id"),
        F.col("source").alias("library"),
        F.col("lang").alias("group_key"),
        "n_chars",
        FP.token_bits(words_of(F.col("text"))).alias("fp_bits"),
    )
    return docs.withColumn("fp_size", F.size("fp_bits")).withColumn("fp_words", FP.pack_words("fp_bits"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("entity_id"),
        F.col("quality").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
        "lang",
        "source",
        "toxic",
    )


def scores(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Three sparse score sources over documents: length, words per line, label."""
    docs = table(spark, sf_dir, "documents")
    if which == "a":
        return docs.where("lang <> 'de'").select(
            F.col("doc_id").alias("catalog_id"), F.col("n_chars").cast("double").alias("score")
        )
    if which == "b":
        # computed from whole texts and read several times by a ranking
        return materialise(
            spread(docs.where("source <> 'src3'").select("doc_id", "text")).select(
                F.col("doc_id").alias("catalog_id"), F.size(words_of(F.col("text"))).cast("double").alias("score")
            )
        )
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("catalog_id"), (F.col("quality") - 0.5 * F.col("toxic")).cast("double").alias("score")
    )


def score_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("catalog_id"),
        F.concat_ws("/", "lang", "source").alias("group_key"),
        (F.col("n_chars") <= 5000).alias("eligible"),
    )


def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a role: entities of even-hash evidence play anchors by their counts."""
    e = table(spark, sf_dir, "embeddings")
    h = order_hash("n", F.col("vec_id"))
    pick = lambda start, modulus: (F.conv(F.substring(h, start, 8), 16, 10).cast("bigint") % modulus)
    return (
        e.select(
            F.col("vec_id").alias("entity_id"),
            F.col("label").cast("string").alias("library"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            (pick(1, 40) + 1).alias("count_target"),
            pick(9, 12).alias("count_competitor"),
            pick(17, 3).alias("control_evidence"),
        )
        .withColumn(
            "pool_role",
            F.when(F.col("count_competitor") < 0.1 * F.col("count_target"), "anchor").otherwise("comparator"),
        )
        .withColumn(
            "fp_bits",
            F.filter(
                F.transform("embedding", lambda x, i: F.when(x > 0, i).otherwise(F.lit(-1))), lambda b: b >= 0
            ),
        )
        .withColumn("fp_size", F.size("fp_bits"))
        .withColumn("fp_words", FP.pack_words("fp_bits", 1))
    )


def _side_rows(df: DataFrame, *more: str) -> DataFrame:
    return df.select("entity_key", "code", "count_target", "count_competitor", "control_evidence", "historic_hits", *more)


def mining_sides(evidence_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sensitive anchors and retained binders with parts."""
    ready = with_parts(store(_side_rows(evidence_table.where(C.competition_sensitive() | C.competition_retained()))))
    return ready.where(C.competition_sensitive()), ready.where(C.competition_retained())


def hits_and_comparators(evidence_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rechecked strict hits, and all other entities with counter evidence."""
    is_hit = C.strict_hit() & (F.col("control_evidence") < 0.1 * F.col("count_target"))
    slim = evidence_table.where(is_hit | C.counter_evidence()).withColumn("_hit", F.coalesce(is_hit, F.lit(False)))
    ready = with_parts(store(_side_rows(slim, "_hit")))
    return ready.where("_hit").drop("_hit"), ready.where(C.counter_evidence() & ~F.col("_hit")).drop("_hit")


def broad_sides(evidence_table: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rechecked strict hits, and of all other entities those with counter evidence and those of low target counts."""
    is_hit = C.strict_hit() & (F.col("control_evidence") < 0.1 * F.col("count_target"))
    counter, low = C.counter_evidence(with_history=True), C.low_target()
    slim = evidence_table.where(is_hit | counter | low).withColumn("_hit", F.coalesce(is_hit, F.lit(False)))
    ready = with_parts(store(_side_rows(slim, "_hit")))
    side = lambda rule: ready.where(rule).drop("_hit")
    return side(F.col("_hit")), side(counter & ~F.col("_hit")), side(low & ~F.col("_hit"))


def entity_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of every observed entity, blind panels included."""
    collapsed = E.dedup_evidence(evidence_raw(spark, sf_dir), carry=["partkey"]).select("entity_key", "partkey")
    return collapsed.join(groups(spark, sf_dir), "partkey", "left").select(
        "entity_key",
        F.coalesce("group_key", F.lit("")).alias("group_key"),
        E.group_split(E.split_key(F.coalesce("group_key", F.lit("")), "entity_key")).alias("split"),
    )


def reference_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents outside and inside the good-quality sample, as query and reference sides."""
    docs = store(documents_fp(spark, sf_dir).select("entity_id", "group_key", "fp_size", "fp_words"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("entity_id"))
    side = lambda df, p: df.select(
        *[F.col(c).alias(f"{p}{c}") for c in ("entity_id", "group_key", "fp_size", "fp_words")]
    )
    return (
        side(docs.join(good, "entity_id", "left_anti"), "query_"),
        side(docs.join(good, "entity_id", "left_semi"), "ref_"),
    )
