"""Preference-pair mining."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysieve.functions import columns as C
from tallysieve.functions import fingerprints as FP
from tallysieve.functions.hashing import draw_index, order_hash
from tallysieve.operators.composed import Composed, common_with_others, similarity_without_any, similarity_without_two
from tallysieve.operators.ordering import exact_quantiles, hash_row_number
from tallysieve.operators.similarity import FEW, best_in_block, cosine_knn, nearest_of_few, nearest_tanimoto
from tallysieve.operators.skew import MIN_ROWS, SHARE, heavy_keys, hot_keys, may_meet, split_hot_join
from tallysieve.session import materialise, shuffled, store

SIDE_COLUMNS = ("count_target", "count_competitor", "control_evidence", "historic_hits")
SIGNATURE = ("count_target", "count_competitor", "control_evidence")
# comparators of a key from which equal ones are dropped
CROWD = 10_000


def as_side(df: DataFrame, prefix: str, extra: Sequence[str] = ()) -> DataFrame:
    """Pair side with every needed column renamed to `<prefix><column>`."""
    names = [
        c
        for c in ("entity_key", "library", *C.PART_KEYS, *SIDE_COLUMNS, "fp_bits", "fp_size", "fp_words", *extra)
        if c in df.columns
    ]
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in names])


def _part_rows(df: DataFrame, prefix: str, names: Sequence[str], more: Sequence[Column] = ()) -> DataFrame:
    """One slim row per two-part key: kind, key, the keys of earlier kinds, and `names` under the prefix."""
    k12, k13, k23 = (F.col(k) for k in C.PART_KEYS)
    none = F.lit(None).cast("string")
    rows = [(0, k12, none, none), (1, k13, k12, none), (2, k23, k12, k13)]
    fields = lambda kind, key, first, second: F.struct(
        F.lit(kind).cast("tinyint").alias("key_kind"), key.alias("part_key"),
        first.alias(f"{prefix}first"), second.alias(f"{prefix}second"),
    )
    return df.select(
        *[F.col(n).alias(f"{prefix}{n}") for n in names], *more, F.inline(F.array(*[fields(*row) for row in rows]))
    )


def _coded_rows(df: DataFrame, prefix: str, names: Sequence[str]) -> DataFrame:
    """One row per two-part key: kind, a hash of the key, and `names` under the prefix; the key itself follows from the code."""
    fields = lambda kind, key: F.struct(F.lit(kind).cast("tinyint").alias("key_kind"), F.xxhash64(F.lit(kind), key).alias("key_hash"))
    keys = F.inline(F.array(*[fields(n, k) for n, k in enumerate(C.PART_KEYS)]))
    return df.select(*[F.col(n).alias(f"{prefix}{n}") for n in names], keys)


def _first_shared(left: str, right: str) -> tuple[Column, Column]:
    """(whether the key of this kind is the first that two codes share, that key)."""
    keys = [tuple(C.part_columns(C.code_fields(code))[k] for k in C.PART_KEYS) for code in (left, right)]
    same = [F.coalesce(a == b, F.lit(False)) for a, b in zip(*keys)]
    kind = F.col("key_kind")
    first = F.when(kind == 0, same[0]).when(kind == 1, same[1] & ~same[0]).otherwise(same[2] & ~same[0] & ~same[1])
    return first, F.when(kind == 0, keys[0][0]).when(kind == 1, keys[0][1]).otherwise(keys[0][2])


def shared_part_join(
    left: DataFrame,
    right: DataFrame,
    left_prefix: str,
    right_prefix: str,
    condition: Column | None = None,
    keep_per_signature: int | None = None,
    similarity: Column | None = None,
    share: int = SHARE,
    min_rows: int = MIN_ROWS,
    crowd: int = CROWD,
) -> DataFrame:
    """Pairs sharing at least two of three parts, each once, under its first shared key, with their similarity.

    Only keys and counts meet in the join. `similarity` is computed from the `code` of both sides, which then also gives the
    keys: rows carry a hash of the key, right rows whose hash no left row has stay out, and what meets is compared by code. Without it the
    fingerprints of both sides are joined to the pairs that pass `condition`. The sides are read several times: give
    written tables.

    `keep_per_signature=k` first drops, in keys of more than `crowd` comparators (right side), those that k others of the
    same key beat for every query: identical fingerprint and counts, smaller entity key. A top-k by
    similarity, counts and key never picks them, so the result of such a top-k is unchanged.
    """
    L, R = left_prefix, right_prefix
    coded = similarity is not None
    on = ["key_kind", "key_hash" if coded else "part_key"]
    names = ["entity_key", *SIDE_COLUMNS, *(["code"] if coded else [])]
    rows = _coded_rows if coded else _part_rows
    l, r = rows(left, L, names), rows(right, R, names)
    hot = hot_keys(l, r, on, share, min_rows)
    if keep_per_signature:
        crowded = F.broadcast(heavy_keys(r, on, share, crowd).select(*on))
        if coded:
            marked, sign = r, [f"{R}code"]
        else:  # two 64-bit hashes stand for a fingerprint
            sign = ["_s0", "_s1"]
            marked = _part_rows(right, R, names, [F.xxhash64(F.lit(n), "fp_words").alias(s) for n, s in enumerate(sign)])
        same = Window.partitionBy(*on, *sign, *[f"{R}{c}" for c in SIGNATURE]).orderBy(f"{R}entity_key")
        few = marked.join(crowded, on, "left_semi").withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= keep_per_signature)
        r = r.join(crowded, on, "left_anti").unionByName(few.select(*r.columns))
    if coded:
        r = may_meet(r, l, "key_hash")
        match, key = _first_shared(f"{L}code", f"{R}code")
    else:
        earlier = lambda name: F.coalesce(F.col(f"{L}{name}") == F.col(f"{R}{name}"), F.lit(False))
        match, key = ~earlier("first") & ~earlier("second"), F.col("part_key")
    match = match if condition is None else condition & match
    found = split_hot_join(l, r, on, f"{L}entity_key", f"{R}entity_key", match, share, min_rows, hot).withColumn("part_key", key)
    found = found.drop("key_hash", *[f"{p}{n}" for p in (L, R) for n in ("first", "second")])
    if similarity is None:
        for df, p in ((left, L), (right, R)):
            prints = df.select(*[F.col(c).alias(f"{p}{c}") for c in ("entity_key", "fp_words", "fp_size")])
            found = found.join(shuffled(prints), f"{p}entity_key")
        similarity = FP.tanimoto(f"{L}fp_words", f"{R}fp_words", F.col(f"{L}fp_size"), F.col(f"{R}fp_size"))
    return found.withColumn("similarity", similarity).drop(*[f"{p}{c}" for p in (L, R) for c in ("fp_words", "fp_size", "code")])


def _margin(pseudocount: float) -> Column:
    return C.log_ratio("positive_count_target", "positive_count_competitor", pseudocount) - C.log_ratio(
        "negative_count_target", "negative_count_competitor", pseudocount
    )


_PAIR_COUNTS = [f"{side}_{c}" for c in SIDE_COLUMNS for side in ("positive", "negative")]


def _competition_columns(weight_factor: float, pair_type: str, shared: Column) -> list[Column]:
    return [
        F.col("positive_entity_key").alias("positive_key"),
        F.col("negative_entity_key").alias("negative_key"),
        (weight_factor * C.competition_weight(F.col("margin"))).alias("pair_weight"),
        F.lit(pair_type).alias("pair_type"),
        shared.alias("shared_part_key"),
        "similarity",
        "fold",
        "margin",
        *_PAIR_COUNTS,
    ]


def _best_first(query: str, partner: str) -> Window:
    return Window.partitionBy(query).orderBy(F.desc("similarity"), "fold", F.desc("margin"), partner)


def competition_pairs(
    anchors: DataFrame,
    binders: DataFrame,
    minimum_similarity: float = 0.6,
    maximum_fold: float = 2.0,
    pairs_per_binder: int = 3,
    pseudocount: float = 0.5,
    similarity: Column | None = None,
) -> DataFrame:
    """For each retained binder its k best sensitive anchors sharing two parts; see `shared_part_join`."""
    fold = C.count_fold("positive_count_target", "negative_count_target")
    margin = _margin(pseudocount)
    gate = (fold <= maximum_fold) & (margin > 0)
    found = shared_part_join(binders, anchors, "negative_", "positive_", gate, pairs_per_binder, similarity)
    found = found.where(F.col("similarity") >= minimum_similarity).withColumns({"fold": fold, "margin": margin})
    best = _best_first("negative_entity_key", "positive_entity_key")
    return (
        found.withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= pairs_per_binder)
        .select(*_competition_columns(1.0, "target_matched_competition", F.col("part_key")))
    )


def competition_pairs_fallback(
    anchors: DataFrame,
    binders: DataFrame,
    covered: DataFrame,
    minimum_similarity: float = 0.5,
    maximum_fold: float = 2.0,
    pseudocount: float = 0.5,
    made: Composed | None = None,
) -> DataFrame:
    """Binders without a two-part pair: the best same-library anchor at half weight.

    All pairs of a library are compared. With `made`, fingerprints follow from the parts, and only pairs that share one are
    compared (those of the first part as tiles, which should have the fewest values); what others can reach is bounded
    by all parts of the anchors (see `common_with_others`), and binders for which that is not enough meet the whole
    library. The sides are then read several times: give written tables.
    """
    open_binders = binders.join(shuffled(covered.select(F.col("negative_key").alias("entity_key"))), "entity_key", "left_anti")
    vectors = [F.col("fp_words").alias("vec")] if made is None else [F.col(c) for c in made.columns]
    slim = lambda df, block: df.select(
        F.col("entity_key").alias("id"), block.alias("block"), *vectors,
        F.col("count_target").cast("double").alias("target"),
        C.log_ratio("count_target", "count_competitor", pseudocount).alias("ratio"),
    )

    def measure(binder, anchor):
        a, b = anchor["target"], binder["target"]  # as `columns.count_fold`: a zero below the line gives no ratio
        some = lambda x: np.where(x == 0, np.nan, x)
        fold = np.fmax(a / some(b), b / some(a))
        margin = anchor["ratio"] - binder["ratio"]
        return (fold <= maximum_fold) & (margin > 0), fold, margin

    def best_of_blocks(asking: DataFrame, block: Column, **more) -> DataFrame:
        found = best_in_block(slim(asking, block), slim(anchors, block), minimum_similarity, measure, ["target", "ratio"], **more)
        return found.withColumnsRenamed(
            {"query_key": "negative_entity_key", "ref_key": "positive_entity_key", "low": "fold", "high": "margin"}
        )

    if made is None:
        found = best_of_blocks(open_binders, F.col("library"))
    else:
        library, *parts = made.columns
        open_binders = store(open_binders)
        found = best_of_blocks(open_binders, F.concat_ws(":", library, parts[0]), marks=made.marks_of)
        fold, margin = C.count_fold("positive_count_target", "negative_count_target"), _margin(pseudocount)
        keys = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(library).alias("home"), F.col(c).alias("part")) for n, c in enumerate(parts[1:])])
        rows = lambda df, p: df.select(
            *[F.col(c).alias(f"{p}{c}") for c in ("entity_key", "code", "count_target", "count_competitor")], F.inline(keys)
        )
        on = ["kind", "home", "part"]
        left, right = rows(open_binders, "negative_"), rows(anchors, "positive_")
        met = split_hot_join(
            left, right, on, "negative_entity_key", "positive_entity_key", (fold <= maximum_fold) & (margin > 0),
            hot=hot_keys(left, right, on),
        )
        met = met.withColumn("similarity", made.similarity("positive_code", "negative_code")).withColumns({"fold": fold, "margin": margin})
        first = _best_first("negative_entity_key", "positive_entity_key")
        met = met.where(F.col("similarity") >= minimum_similarity).select(*found.columns).withColumn("_r", F.row_number().over(first))
        met = found.unionByName(met.where("_r = 1").drop("_r")).withColumn("_r", F.row_number().over(first))
        best = store(met.where("_r = 1").drop("_r"))
        least = anchors.agg(F.coalesce(F.min(made.size()), F.lit(0))).scalar()
        limit = common_with_others(open_binders, anchors, made).select("entity_key", similarity_without_any(least).alias("_limit"))
        reached = best.select(F.col("negative_entity_key").alias("entity_key"), "similarity")
        uncertain = limit.where(F.col("_limit") >= minimum_similarity - 1e-9).join(shuffled(reached), "entity_key", "left")
        uncertain = uncertain.where("similarity is null or similarity <= _limit + 1e-9").select("entity_key")
        rest = store(open_binders.join(shuffled(uncertain), "entity_key", "left_semi"))
        if rest.isEmpty():
            found = best
        else:
            whole = best_of_blocks(rest, F.col(library), marks=made.marks_of)
            asked = shuffled(rest.select(F.col("entity_key").alias("negative_entity_key")))
            found = best.join(asked, "negative_entity_key", "left_anti").unionByName(whole)
    for df, p in ((anchors, "positive_"), (binders, "negative_")):
        counts = df.select(*[F.col(c).alias(f"{p}{c}") for c in ("entity_key", *SIDE_COLUMNS)])
        found = found.join(shuffled(counts), f"{p}entity_key")
    return found.select(*_competition_columns(0.5, "same_library_competition", F.lit("")))


def matched_pairs(
    hits: DataFrame,
    comparators: DataFrame,
    minimum_similarity: float = 0.6,
    pairs_per_positive: int = 2,
    similarity: Column | None = None,
) -> DataFrame:
    """Each hit with the k most similar counter-evidence entities it dominates; see `shared_part_join`."""
    found = shared_part_join(hits, comparators, "positive_", "negative_", C.dominates(), pairs_per_positive, similarity)
    found = found.where(F.col("similarity") >= minimum_similarity)
    best = Window.partitionBy("positive_entity_key").orderBy(
        F.desc("similarity"), "negative_count_target", "negative_entity_key"
    )
    return (
        found.withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= pairs_per_positive)
        .select(
            F.col("positive_entity_key").alias("positive_key"),
            F.col("negative_entity_key").alias("negative_key"),
            C.matched_weight(F.col("positive_count_target"), F.col("negative_count_target")).alias("pair_weight"),
            F.lit("matched_parts_control_confirmed").alias("pair_type"),
            F.col("part_key").alias("shared_part_key"),
            "similarity",
            *_PAIR_COUNTS,
        )
    )


def nearest_of_shared_parts(
    positives: DataFrame, pool: DataFrame, made: Composed, k: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(found, open): the k most similar pool rows per positive, and the positives for which they are not certain.

    Only rows that share two parts are compared. They are certain if the k-th is more similar than any other row can be:
    of the library and three parts an other row shares at most the library and one part, or no library, and what the parts
    it does not share can add is known from all parts of the pool (see `common_with_others`). The sides are read several times.
    """
    found = shared_part_join(positives, pool, "positive_", "negative_", similarity=made.similarity("positive_code", "negative_code"))
    best = Window.partitionBy("positive_entity_key").orderBy(F.desc("similarity"), "negative_entity_key")
    found = store(found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("key_kind", "part_key"))
    least = pool.agg(F.coalesce(F.min(made.size()), F.lit(0))).scalar()
    limit = common_with_others(positives, pool, made).withColumn("_limit", similarity_without_two(least))
    last = found.where(F.col("_r") == k).select(F.col("positive_entity_key").alias("entity_key"), "similarity")
    certain = store(limit.select("entity_key", "_limit").join(shuffled(last), "entity_key").where("similarity > _limit + 1e-9").select("entity_key"))
    kept = found.join(shuffled(certain.withColumnRenamed("entity_key", "positive_entity_key")), "positive_entity_key", "left_semi")
    return kept.drop("_r"), store(positives.join(shuffled(certain), "entity_key", "left_anti"))


def broad_pairs(
    positives: DataFrame,
    counter_pool: DataFrame,
    low_pool: DataFrame,
    local_per_positive: int = 1,
    draws_per_positive: int = 1,
    seed: int = 2026,
    made: Composed | None = None,
) -> DataFrame:
    """Nearest counter-pool members plus seeded random low-target draws, then classified.

    With `made`, fingerprints follow from the parts and are made only for positives whose nearest members
    `nearest_of_shared_parts` leaves open; the sides are then read several times: give written tables.
    """
    columns = ["positive_entity_key", "negative_entity_key", "similarity", "negative_source", *_PAIR_COUNTS]
    sides = as_side(positives, "positive_")
    bare = lambda df, p: df.drop(*[f"{p}{c}" for c in ("fp_bits", "fp_size", "fp_words", "library", *C.PART_KEYS)])

    def nearest(search, positives: DataFrame, members: DataFrame) -> DataFrame:
        asking, pool = as_side(positives, "positive_"), as_side(counter_pool, "negative_")
        near = search(asking, as_side(members, "negative_"), "positive_", "negative_", local_per_positive)
        matched = near.select("positive_entity_key", "negative_entity_key", "similarity").join(
            bare(asking, "positive_"), "positive_entity_key"
        )
        # a pool member may be the nearest of very many positives
        return split_hot_join(
            matched, bare(pool, "negative_"), ["negative_entity_key"], "positive_entity_key", "negative_entity_key"
        )

    if made is None:
        local = nearest(nearest_tanimoto, positives, counter_pool)
    else:
        local, rest = nearest_of_shared_parts(positives, counter_pool, made, local_per_positive)
        open_rows = rest.count()
        if open_rows:
            search = nearest_of_few if open_rows <= FEW else nearest_tanimoto
            more = nearest(search, made.fingerprint(rest), made.fingerprint(counter_pool))
            local = local.unionByName(more.select(*local.columns))
    local = local.withColumn("negative_source", F.lit("local_counter"))
    low = bare(as_side(low_pool, "negative_"), "negative_")
    numbered = hash_row_number(low, "_slot", order_hash(seed, "negative_entity_key"), "negative_entity_key")
    size = low.agg(F.count(F.lit(1))).scalar()
    drawn = (
        bare(sides, "positive_")
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws_per_positive - 1))))
        .withColumn("_slot", draw_index(seed, F.nullif(size, F.lit(0)), "positive_entity_key", "draw"))
        .join(numbered, "_slot")
        .withColumn("similarity", F.lit(None).cast("double"))
        .withColumn("negative_source", F.lit("global_low_target"))
    )
    kind = C.pair_class()
    return (
        local.select(*columns)
        .unionByName(drawn.select(*columns))
        .withColumn("pair_type", kind)
        .where("pair_type is not null")
        .select(
            F.col("positive_entity_key").alias("positive_key"),
            F.col("negative_entity_key").alias("negative_key"),
            C.pair_class_weight(F.col("pair_type")).alias("pair_weight"),
            "pair_type",
            "negative_source",
            "similarity",
            *_PAIR_COUNTS,
        )
    )


def unobserved_pairs(
    anchors: DataFrame,
    enumeration: DataFrame,
    observed: DataFrame,
    panel_keys: DataFrame,
    seed: int = 2026,
    per_anchor: int = 3,
    add_fingerprint=None,
    minimum_similarity: float = 0.0,
) -> DataFrame:
    """Anchors against makeable but never-observed entities sharing two parts.

    The partners of a key are numbered once in seeded order; an anchor takes `per_anchor` of them
    from a seeded place on, for each of its keys, and keeps `per_anchor` of these in seeded order. Work
    grows with the anchors, not with the combinations. A pair drawn by two keys counts under the first.

    `enumeration` carries entity_key, code and part columns. Never-observed rows are
    found once, before the join, so that the large anti join runs on plain keys.
    `add_fingerprint(df)` adds fp_words and fp_size to the chosen partners.
    """
    fresh = enumeration.join(shuffled(observed.select("entity_key")), "entity_key", "left_anti").join(
        shuffled(panel_keys.select("entity_key")), "entity_key", "left_anti"
    )
    by = ["key_kind", "part_key"]
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("key_kind"), F.col(k).alias("part_key")) for k in C.PART_KEYS]))
    partner = store(fresh.select("entity_key", "code", *C.PART_KEYS)).select(
        F.col("entity_key").alias("negative_entity_key"), F.col("code").alias("negative_code"), keys.alias("k")
    ).select("k.*", "negative_entity_key", "negative_code")
    turn = order_hash(seed, *by, "negative_entity_key")
    numbered = hash_row_number(partner, "_slot", turn, "negative_entity_key", by)
    sizes = partner.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    # every anchor draws a few partners per key; no list of all combinations is made
    drawn = (
        anchors.select(F.col("entity_key").alias("positive_entity_key"), keys.alias("k"))
        .select("positive_entity_key", "k.*")
        .join(shuffled(sizes), by)
        .withColumn("_from", draw_index(seed, F.col("_n"), "positive_entity_key", *by))
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.least(F.lit(per_anchor), "_n").cast("int") - 1)))
        .withColumn("_slot", (F.col("_from") + F.col("_step")) % F.col("_n"))
        .join(shuffled(numbered), [*by, "_slot"])
        .where("positive_entity_key <> negative_entity_key")
    )
    found = (
        drawn.groupBy("positive_entity_key", "negative_entity_key", "negative_code")
        .agg(F.min(F.struct(*by)).alias("k"))
        .select("positive_entity_key", "negative_entity_key", "negative_code", "k.*")
    )
    first = Window.partitionBy("positive_entity_key").orderBy(
        order_hash(seed, "positive_entity_key", "negative_entity_key"), "negative_entity_key"
    )
    chosen = (
        found.withColumn("_r", F.row_number().over(first))
        .where(F.col("_r") <= per_anchor)
        .select(
            "positive_entity_key", "negative_entity_key", "negative_code", "part_key",
            C.varied_position(F.col("key_kind")).alias("varied_position"),
        )
    )
    evidence = as_side(anchors, "positive_").drop("positive_fp_bits", *[f"positive_{k}" for k in C.PART_KEYS])
    strongest = anchors.agg(F.max(F.log1p("count_target"))).scalar()
    pairs = chosen.join(shuffled(evidence), "positive_entity_key").withColumn(
        "pair_weight", F.log1p("positive_count_target") / F.nullif(strongest, F.lit(0.0))
    )
    if add_fingerprint is not None:
        pairs = add_fingerprint(pairs).withColumn(
            "similarity",
            FP.tanimoto("positive_fp_words", "negative_fp_words", F.col("positive_fp_size"), F.col("negative_fp_size")),
        )
        pairs = pairs.where(F.col("similarity") >= minimum_similarity) if minimum_similarity > 0 else pairs
    else:
        pairs = pairs.withColumn("similarity", F.lit(None).cast("double"))
    return pairs.select(
        F.col("positive_entity_key").alias("positive_key"),
        F.col("negative_entity_key").alias("negative_key"),
        "negative_code",
        "pair_weight",
        F.lit("unobserved_matched_analog").alias("pair_type"),
        "varied_position",
        F.col("part_key").alias("shared_part_key"),
        "similarity",
        *[f"positive_{c}" for c in SIDE_COLUMNS],
    )


def neighbor_pairs(
    pool: DataFrame,
    minimum_cosine: float = 0.9,
    minimum_tanimoto: float = 0.6,
    neighbors: int = 32,
    pairs_per_anchor: int = 2,
    block: str | None = "library",
) -> DataFrame:
    """Embedding neighbours of each anchor that pass both similarity gates and are dominated."""
    anchors = pool.where("pool_role = 'anchor'")
    others = pool.where("pool_role = 'comparator'")
    near = cosine_knn(anchors, others, neighbors, block, "entity_id", minimum_cosine)
    side = lambda df, p, k: df.select(
        F.col("entity_id").alias(k),
        *[F.col(c).alias(f"{p}{c}") for c in ("count_target", "count_competitor", "control_evidence", "fp_words", "fp_size")],
    )
    with_anchor = near.join(side(anchors, "positive_", "query_key"), "query_key")
    joined = split_hot_join(with_anchor, side(others, "negative_", "ref_key"), ["ref_key"], "query_key", "ref_key")
    similarity = FP.tanimoto(
        "positive_fp_words", "negative_fp_words", F.col("positive_fp_size"), F.col("negative_fp_size")
    )
    best = Window.partitionBy("query_key").orderBy(F.desc("cosine"), "ref_key")
    return (
        joined.withColumn("similarity", similarity)
        .where((F.col("cosine") >= minimum_cosine) & (F.col("similarity") >= minimum_tanimoto) & C.dominates())
        .withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= pairs_per_anchor)
        .select(
            F.col("query_key").alias("positive_key"),
            F.col("ref_key").alias("negative_key"),
            (1 + F.col("cosine")).alias("pair_weight"),
            "cosine",
            "similarity",
        )
    )


def repair_reasons(pairs: DataFrame, entities: DataFrame, panel_keys: DataFrame) -> DataFrame:
    """Pairs with a reject reason (null = kept), the shared split and the reliability weight.

    `entities` maps entity_key to split. Checks run in a fixed order, first hit counts.
    """
    blind = panel_keys.select("entity_key").distinct().withColumn("_blind", F.lit(True))
    side = lambda name: (
        entities.select(F.col("entity_key").alias(f"{name}_key"), F.col("split").alias(f"{name}_split"))
    )
    flag = lambda name: blind.select(F.col("entity_key").alias(f"{name}_key"), F.col("_blind").alias(f"{name}_blind"))
    joined = pairs
    for name in ("positive", "negative"):
        joined = joined.join(side(name), f"{name}_key", "left").join(flag(name), f"{name}_key", "left")
    reliability = C.count_reliability()
    reason = (
        F.when(F.coalesce("positive_blind", "negative_blind", F.lit(False)), "candidate_overlap")
        .when(F.col("positive_key") == F.col("negative_key"), "same_entity")
        .when(~F.col("positive_split").eqNullSafe(F.col("negative_split")), "cross_split")
        .when(reliability <= 0, "no_control_support")
    )
    return joined.withColumn("reject_reason", reason).withColumn("reliability", reliability)


def repair_pairs(pairs: DataFrame, entities: DataFrame, panel_keys: DataFrame) -> DataFrame:
    return (
        repair_reasons(pairs, entities, panel_keys)
        .where("reject_reason is null")
        .withColumn("original_weight", F.col("pair_weight"))
        .withColumn("pair_weight", F.col("pair_weight") * F.col("reliability"))
        .withColumn("split", F.col("positive_split"))
        .drop("positive_split", "negative_split", "positive_blind", "negative_blind", "reject_reason")
    )


def pair_dedup(pairs: DataFrame, priority: Sequence[Column | str] = ("pair_type",)) -> DataFrame:
    """One row per (positive, negative): the first by priority."""
    w = Window.partitionBy("positive_key", "negative_key").orderBy(*priority)
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def merge_pairs(shards: Sequence[DataFrame]) -> DataFrame:
    """Union of shards; the invariants are checked by `checks.pair_checks`."""
    columns = [c for c in shards[0].columns if all(c in s.columns for s in shards)]
    merged = shards[0].select(*columns)
    for shard in shards[1:]:
        merged = merged.unionByName(shard.select(*columns))
    return merged


def pair_report(pairs: DataFrame, quantity: str = "similarity") -> DataFrame:
    """Per pair type: rows, distinct sides, weight sum and quantiles of one quantity."""
    counts = pairs.groupBy("pair_type").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_distinct("positive_key").alias("positives"),
        F.count_distinct("negative_key").alias("negatives"),
        F.sum("pair_weight").alias("weight_sum"),
    )
    quantiles = exact_quantiles(pairs, quantity, {"q10": 0.1, "median": 0.5, "q90": 0.9}, ["pair_type"])
    return counts.join(quantiles, "pair_type", "left")
