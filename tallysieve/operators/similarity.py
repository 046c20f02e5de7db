"""Similarity search: exact thresholded joins and exact nearest neighbours.

No operator here emits all pairs of a group. Two exact ways to the partners of a row:

* `tanimoto_join`: prefix filter. Partners at a threshold must share one of a row's
  rarest bits, so an equi-join on those bits finds all candidates. For sparse
  fingerprints, and where residual conditions cut further.
* `metric.Index`: two levels of pivots. Jaccard and Euclidean distance obey the triangle
  inequality, so cells and leaves out of reach are skipped; the rest is compared as matrix
  products of bounded size, each returning only its best rows. For dense fingerprints and
  embeddings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysieve.functions import fingerprints as FP
from tallysieve.operators.metric import LEAF_ROWS, Held, Index, Metric, Pairs, Step, best_of, matrix, numbers, side, streamed
from tallysieve.operators.ordering import exact_quantiles
from tallysieve.operators.skew import MIN_ROWS, SHARE, split_hot_join, split_hot_lookup
from tallysieve.session import materialise, shuffled, store


# --- Tanimoto --------------------------------------------------------------


def _bit_ranks(frames: Sequence[DataFrame]) -> Column:
    """Scalar array indexed by bit: its rank, rarest first. As long as the fingerprint is wide."""
    exploded = frames[0].select(F.explode("bits").alias("bit"))
    for other in frames[1:]:
        exploded = exploded.unionByName(other.select(F.explode("bits").alias("bit")))
    frequency = exploded.groupBy("bit").agg(F.count(F.lit(1)).alias("n"))
    ordered = frequency.agg(F.array_sort(F.collect_list(F.struct("n", "bit"))).alias("o"))
    rarest = F.transform("o", lambda x: x["bit"])
    return (
        ordered.select(rarest.alias("r"))
        .select(F.transform(F.sequence(F.lit(0), F.array_max("r")), lambda b: F.array_position("r", b).cast("int")))
        .scalar()
    )


def _prefix(df: DataFrame, bits: str, ranks: Column, threshold: float) -> DataFrame:
    """Adds `_prefix`: ranks of the rarest bits, one of which any partner at `threshold` must share."""
    size = F.size(bits)
    keep = size - F.ceil(size * threshold - 1e-9).cast("int") + 1
    ranked = F.sort_array(F.transform(F.col(bits), lambda b: F.col("_ranks")[b]))
    return (
        df.where(size > 0)
        .withColumn("_ranks", ranks)
        .withColumn("_prefix", F.slice(ranked, F.lit(1), keep))
        .drop("_ranks")
    )


def tanimoto_join(
    left: DataFrame,
    right: DataFrame,
    threshold: float,
    left_prefix: str,
    right_prefix: str,
    block: str | None = None,
    condition: Column | None = None,
    key: str = "entity_key",
    share: int = SHARE,
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """All pairs with Tanimoto >= threshold > 0 (and equal `block`), exact.

    Both sides carry `<prefix>fp_bits`, `<prefix>fp_size`, `<prefix>fp_words` and the key;
    each pair comes out once, at its rarest common prefix bit. Result: all columns of
    both sides plus `similarity`.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    L, R = left_prefix, right_prefix
    order = _bit_ranks([left.select(F.col(f"{L}fp_bits").alias("bits")), right.select(F.col(f"{R}fp_bits").alias("bits"))])
    on = ["_token"]
    lp = _prefix(left, f"{L}fp_bits", order, threshold).withColumnRenamed("_prefix", "_lprefix")
    rp = _prefix(right, f"{R}fp_bits", order, threshold).withColumnRenamed("_prefix", "_rprefix")
    if block:
        on = ["_block", "_token"]
        lp, rp = lp.withColumn("_block", F.col(f"{L}{block}")), rp.withColumn("_block", F.col(f"{R}{block}"))
    lp = lp.withColumn("_token", F.explode("_lprefix"))
    rp = rp.withColumn("_token", F.explode("_rprefix"))
    ls, rs = F.col(f"{L}fp_size"), F.col(f"{R}fp_size")
    similarity = FP.tanimoto(f"{L}fp_words", f"{R}fp_words", ls, rs)
    match = (ls >= rs * threshold - 1e-9) & (rs >= ls * threshold - 1e-9)
    if condition is not None:
        match = match & condition
    match = match & (similarity >= threshold)
    match = match & (F.array_min(F.array_intersect("_lprefix", "_rprefix")) == F.col("_token"))
    joined = split_hot_join(lp, rp, on, f"{L}{key}", f"{R}{key}", match, share, min_rows)
    return joined.withColumn("similarity", similarity).drop("_lprefix", "_rprefix")


def similarity_summary(df: DataFrame, column: str = "similarity", by: Sequence[str] = ()) -> DataFrame:
    """Mean, quantiles and shares below 0.4, at least 0.6, at least 0.8."""
    v = F.col(column)
    share = lambda rule: F.avg(F.when(rule, 1.0).otherwise(0.0))
    moments = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("mean"),
        share(v < 0.4).alias("below_0_4"),
        share(v >= 0.6).alias("at_least_0_6"),
        share(v >= 0.8).alias("at_least_0_8"),
    )
    quantiles = exact_quantiles(df, column, {"p10": 0.1, "median": 0.5, "p90": 0.9}, by)
    if by:
        return moments.join(quantiles, list(by))
    return moments.select("*", *[quantiles.select(q).scalar().alias(q) for q in ("p10", "median", "p90")])


def best_reference(
    entities: DataFrame, references: Sequence[tuple[str, Sequence[int], float]], key: str = "entity_key"
) -> DataFrame:
    """Largest similarity * weight over a short list of named reference fingerprints.

    The list is an argument (a handful of known ligands), so it is unrolled into the plan;
    ties go to the larger name, and no reference gives 0 and "".
    """
    if not references:
        return entities.select(key, F.lit(0.0).alias("reference_score"), F.lit("").alias("nearest_reference"))

    def weighted(bits: Sequence[int], weight: float) -> Column:
        """The weight goes to the common bits: a product after the division would set equal scores apart."""
        known = F.array(*[F.lit(int(b)) for b in bits])
        common = F.size(F.array_intersect("fp_bits", known))
        union = F.size("fp_bits") + F.size(known) - common
        return F.when(union > 0, common * F.lit(float(weight)) / union).otherwise(F.lit(0.0))

    options = [F.struct(weighted(bits, weight).alias("s"), F.lit(name).alias("n")) for name, bits, weight in references]
    best = F.array_max(F.array(*options))
    return entities.select(key, best["s"].alias("reference_score"), best["n"].alias("nearest_reference"))


def distinct_fingerprints(df: DataFrame, key: str = "entity_id") -> DataFrame:
    """Copies collapsed: the smallest key stands for all rows with the same bits."""
    return df.groupBy(*[c for c in ("fp_bits", "fp_size", "fp_words") if c in df.columns]).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def components(links: DataFrame) -> DataFrame:
    """(u, v): each linked node u under v, the smallest node it reaches; from links (u, v) in any order.

    Large-star / small-star contraction: logarithmic rounds, each a grouped minimum. Rounds are read back from Parquet:
    a checkpoint hands the optimiser all that it knew of the rounds before, which grows in the driver.
    """
    edges = store(_down(links))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = store(_down(_star(both, larger=True)))
        edges = store(_star(large, larger=False))
        several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        chained = edges.join(shuffled(edges.select(F.col("u").alias("v"))), "v", "left_semi").limit(1)
        if several.isEmpty() and chained.isEmpty():
            return edges


def _down(edges: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def forest(threshold: float):
    """Links (u, v) of labels, one for each two trees that a held group and the queries passing it turn out to connect."""

    def use(held: Held) -> Step:
        names = held.table.column("label").to_pylist()
        number = {name: k for k, name in enumerate(dict.fromkeys(names))}
        tree = np.array([number[name] for name in names])  # of each held row
        root = np.arange(len(number))  # of each label; queries add theirs
        labels = list(number)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            nonlocal tree, root
            mine = batch.column("label").to_pylist()
            for name in mine:
                if name not in number:
                    number[name] = len(labels)
                    labels.append(name)
            root = np.append(root, np.arange(len(root), len(labels)))
            code = np.array([number[name] for name in mine])
            u, v = [], []
            for asking, rows, _ in held.hits(batch, np.full(len(code), 1 - threshold), least=threshold):
                heads = np.flatnonzero(np.append(True, asking[1:] != asking[:-1]))
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(asking)]):
                    own = root[code[asking[a]]]
                    met = tree[rows[a:b]]
                    if (met == own).all():
                        continue
                    for other in np.unique(met[met != own]).tolist():
                        u.append(labels[other]), v.append(labels[own])
                        tree[tree == other] = own
                        root[root == other] = own
            if u:
                kind = held.table.schema.field("label").type
                yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])

        return step

    return use


def similar_pairs(distinct: DataFrame, threshold: float, key: str = "entity_id", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Pairs a < b of collapsed fingerprints with Tanimoto >= threshold > 0; exact."""
    index = Index.build(side(distinct, key, "fp_words", "fp_size", None), JACCARD, leaf_rows)
    asked, turns = _own_rows(index, index.tiled(index.rows.count()), threshold)
    schema = f"a_{key} {index.key}, b_{key} {index.key}, similarity double"

    def use(held: Held) -> Step:
        names = held.ids.to_numpy(zero_copy_only=False)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            later = numbers(batch, "tile") > numbers(batch, "own_tile")
            for q, r, s in held.hits(batch, np.full(len(ids), 1 - threshold), least=threshold):
                a, b = ids[q], names[r]
                once = later[q] | (a < b)
                if once.any():
                    a, b = a[once], b[once]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.where(a < b, a, b)), pa.array(np.where(a < b, b, a)), pa.array(s[once])],
                        names=[f"a_{key}", f"b_{key}", "similarity"],
                    )

        return step

    return index.compared(asked.where("tile >= own_tile"), turns, schema, use)


def _own_rows(index: Index, turns: int, threshold: float) -> tuple[DataFrame, int]:
    """Rows of a packed index that ask its tiles, with their own tile."""
    asking = index.rows.withColumn("bound", F.lit(float(1 - threshold))).withColumnRenamed("tile", "own_tile")
    return index.asked(asking.drop("leaf"), turns)


def similar_links(distinct: DataFrame, threshold: float, key: str = "entity_id", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(u, v): each key that is similar to another, under the smallest of its component.

    First every tile of the index gives a spanning forest of its own rows. Then rows meet the later tiles in reach, with
    the components so far as labels, and a link is given only where two of them turn out to be connected: no pair
    within a known component leaves a task, and there is no list of edges.
    """
    index = Index.build(side(distinct, key, "fp_words", "fp_size", None), JACCARD, leaf_rows)
    schema = f"u {index.key}, v {index.key}"
    index.rows = index.rows.withColumn("label", F.col("id"))
    turns = index.tiled(index.rows.count())
    rows = index.rows.withColumn("bound", F.lit(float(1 - threshold)))
    first = components(index.compared(rows.withColumn("turn", F.lit(0)), 1, schema, forest(threshold)))
    label = first.select(F.col("u").alias("id"), F.col("v").alias("known"))
    index.rows = store(index.rows.join(shuffled(label), "id", "left").withColumn("label", F.coalesce("known", "label")).drop("known"))
    asked, turns = _own_rows(index, turns, threshold)
    second = components(index.compared(asked.where("tile > own_tile"), turns, schema, forest(threshold)))
    lower = shuffled(second.select(F.col("u").alias("v"), F.col("v").alias("low")))
    joined = first.join(lower, "v", "left").select("u", F.coalesce("low", "v").alias("v"))
    return joined.unionByName(second.join(shuffled(joined.select("u")), "u", "left_anti"))


def series_components(df: DataFrame, threshold: float, key: str = "entity_id", leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Series = connected components of similar fingerprints, labelled by their smallest key.

    Copies take the label of their representative; a row with an empty fingerprint is a series of its own.
    """
    df = store(df.select(key, "fp_size", "fp_words"))
    some = df.where("fp_size > 0")
    distinct = store(distinct_fingerprints(some, key))
    label = similar_links(distinct, threshold, key, leaf_rows).select(F.col("u").alias(key), F.col("v").alias("series_id"))
    representative = distinct.select("fp_words", key, "copies").join(shuffled(label), key, "left").select(
        "fp_words", "copies", F.coalesce("series_id", key).alias("series_id")
    )
    # one fingerprint may stand for a third of all rows, so the join back is split
    placed = split_hot_lookup(some.select(key, "fp_words"), representative, ["fp_words"], key, "copies")
    alone = df.where(~F.coalesce(F.col("fp_size") > 0, F.lit(False)))
    return placed.select(key, "series_id").unionByName(alone.select(key, F.col(key).alias("series_id")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link each node's neighbours (only the larger ones, or all) to its smallest neighbour."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn(
        "m", F.least("u", "m")
    )
    linked = split_hot_lookup(edges, smallest, ["u"], "v", "n")
    if larger:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


# --- nearest neighbours ----------------------------------------------------


def _rank(found: DataFrame, k: int, value: str) -> DataFrame:
    best = Window.partitionBy("query_key").orderBy(F.desc("value"), "ref_key")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumnRenamed("value", value)
    )


def _bit_matrix(words: np.ndarray) -> np.ndarray:
    packed = np.ascontiguousarray(words.astype("int64")).view(np.uint8)
    return np.unpackbits(packed, axis=1, bitorder="little").astype("float32")


def _jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tanimoto similarity of packed word matrices; two empty sets count as 0."""
    x, y = _bit_matrix(a), _bit_matrix(b)
    common = (x @ y.T).astype("float64")
    union = x.sum(1, dtype="float64")[:, None] + y.sum(1, dtype="float64")[None] - common
    return np.divide(common, union, out=np.zeros_like(common), where=union > 0)


# bins that bits are folded into; ns per pair and column, and per pair that passes the bins (measured); queries asked for a choice
FOLDS, PER_COLUMN, PASSED, TRIED = (128, 256, 512), 0.03, 200.0, 16


def _unsigned(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words.astype("int64", copy=False)).view(np.uint64)


def _folded(words: np.ndarray, bins: int, counted: bool) -> np.ndarray:
    """Bits of a row by bin (position modulo `bins`): how many, or whether any."""
    layers = words.view(np.uint8).reshape(len(words), -1, bins // 8)
    if not counted:
        layers = np.bitwise_or.reduce(layers, 1)[:, None]
    return np.unpackbits(layers, axis=2, bitorder="little").sum(1, dtype="float32")


def _jaccard_pairs(queries: np.ndarray) -> Pairs:
    """Pairs whose similarity reaches the query's least, with the same values as `_jaccard`.

    A similarity of t needs t / (1 + t) of both sizes as common bits; the part due to the row's size goes into the matrix
    product as one more column, so one comparison per pair is left. A query shares no more bits with a row than it has in
    the bins that the row uses: a product of fewer columns, after which only pairs that pass are compared by their
    words. How many bins, or all bits, is decided by what a few queries let pass; the result does not depend on it.
    """
    queries = _unsigned(queries)
    width = queries.shape[1] * 64
    sizes = np.bitwise_count(queries).sum(1, dtype="float32")
    folds = [f for f in FOLDS if 2 * f <= width and width % f == 0]
    known: dict[int, np.ndarray] = {}  # queries by number of columns
    turn, columns = 0, width

    def wide(x: np.ndarray, column: np.ndarray) -> np.ndarray:
        return np.column_stack([x, column])

    def of_queries(f: int, mine: np.ndarray) -> np.ndarray:
        if f == width:
            return _bit_matrix(queries[mine])
        if f not in known:
            known[f] = _folded(queries, f, True)
        return known[f][mine]

    def product(f: int, mine: np.ndarray, share: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(common bits at most, less the row's part of those needed; mask of the pairs that may have enough)."""
        common = wide(of_queries(f, mine), -share) @ held.T
        return common, common >= (share * sizes[mine] - 0.02)[:, None]  # room for rounding

    def find(rows: np.ndarray, asking: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        nonlocal turn, columns
        rows = _unsigned(rows)
        size = np.bitwise_count(rows).sum(1, dtype="float32")
        share = (np.maximum(least, 0) / (1 + np.maximum(least, 0))).astype("float32")
        of_rows = lambda f: wide(_bit_matrix(rows) if f == width else _folded(rows, f, False), size)
        if len(asking) >= 8 * TRIED:
            if turn % 8 == 0:
                at = slice(None, None, len(asking) // TRIED)
                passed = {f: product(f, asking[at], share[at], of_rows(f))[1].mean() for f in folds}
                cost = {f: PER_COLUMN * f + PASSED * passed[f] for f in folds} | {width: PER_COLUMN * width}
                columns = min(cost, key=cost.get)
            turn += 1
        held = of_rows(columns)
        for a in range(0, len(asking), 1024):
            mine, part, low = asking[a : a + 1024], share[a : a + 1024], least[a : a + 1024]
            common, mask = product(columns, mine, part, held)
            at = np.flatnonzero(mask)
            for b in range(0, len(at), 1 << 16):
                q, r = np.divmod(at[b : b + (1 << 16)], len(rows))
                if columns == width:
                    both = np.rint(common[q, r] + part[q] * size[r]).astype("float64")
                else:
                    both = np.bitwise_count(queries[mine[q]] & rows[r]).sum(1, dtype="float64")
                union = sizes[mine[q]].astype("float64") + size[r] - both
                s = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
                good = s >= low[q]
                yield mine[q[good]], r[good], s[good]

    return find


JACCARD = Metric(_jaccard, lambda s: 1 - s, sized=True, pairs=_jaccard_pairs)


def nearest_tanimoto(
    query: DataFrame,
    reference: DataFrame,
    query_prefix: str = "query_",
    reference_prefix: str = "ref_",
    k: int = 1,
    key: str = "entity_key",
    block: str | None = None,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The k most similar references per query, ties to the smaller reference key; exact.

    Result: `<query_prefix><key>`, `<reference_prefix><key>`, similarity, rank.
    """
    Q, R = query_prefix, reference_prefix
    index = Index.build(side(reference, f"{R}{key}", f"{R}fp_words", f"{R}fp_size", block and f"{R}{block}"), JACCARD, leaf_rows)
    asking = side(query, f"{Q}{key}", f"{Q}fp_words", f"{Q}fp_size", block and f"{Q}{block}")
    found = index.nearest(asking, k, 1.0)
    return _rank(found, k, "similarity").withColumnsRenamed({"query_key": f"{Q}{key}", "ref_key": f"{R}{key}"})


# queries that every task can hold
FEW = 4096


def nearest_of_few(query: DataFrame, reference: DataFrame, query_prefix: str, reference_prefix: str, k: int, key: str = "entity_key") -> DataFrame:
    """`nearest_tanimoto` of at most FEW queries: they go to the references, which are neither moved nor indexed."""
    Q, R = query_prefix, reference_prefix
    asking = side(query, f"{Q}{key}", f"{Q}fp_words", f"{Q}fp_size", None).select("id", "vec").limit(FEW + 1).collect()
    if len(asking) > FEW:
        raise ValueError(f"more than {FEW} queries")
    names = [row[0] for row in asking]
    words = np.array([row[1] for row in asking], np.int64).reshape(len(asking), -1)
    kind = dict(query.dtypes)[f"{Q}{key}"], dict(reference.dtypes)[f"{R}{key}"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, least = _jaccard_pairs(words), np.zeros(len(names))
        for batch in batches:
            rows = pa.Table.from_batches([batch]).sort_by("id")
            for a in range(0, len(rows) if names else 0, LEAF_ROWS):
                piece = rows.slice(a, LEAF_ROWS)
                for q, r, s in pairs(matrix(piece), np.arange(len(names)), least):
                    if not len(q):
                        continue
                    keep, kth = best_of(q, r, s, k)
                    least[q[kth]] = np.maximum(least[q[kth]], s[kth])
                    q, r, s = q[keep], r[keep], s[keep]
                    found = [pa.array([names[i] for i in q]), piece.column("id").combine_chunks().take(pa.array(r)), pa.array(s)]
                    yield pa.RecordBatch.from_arrays(found, names=["query_key", "ref_key", "value"])

    rows = side(reference, f"{R}{key}", f"{R}fp_words", f"{R}fp_size", None).select("id", "vec")
    found = rows.mapInArrow(run, f"query_key {kind[0]}, ref_key {kind[1]}, value double")
    return _rank(found, k, "similarity").withColumnsRenamed({"query_key": f"{Q}{key}", "ref_key": f"{R}{key}"})


# rows of one task: references held, queries that pass them
TILE_ROWS, PASSING_ROWS = 65_536, 65_536
# references compared at a time; queries from which on the bits of a reference are summed instead
AT_ONCE, MANY = 256, 256


def _bit_columns(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Bits as rows of 0 and 1, one column for each fingerprint."""
    packed = _unsigned(matrix(rows)).view(np.uint8)
    return np.ascontiguousarray(np.unpackbits(packed, axis=1, bitorder="little").T)


class _Bits:
    """Held fingerprints by their bits, those that all have apart, and what they have in common with queries."""

    def __init__(self, marks: np.ndarray):
        self.sizes = marks.sum(0, dtype=np.int64)
        self.shared = np.flatnonzero(marks.all(1))
        own = marks.copy()
        own[self.shared] = 0
        row, self.bits = np.nonzero(own.T)
        self.edges = np.searchsorted(row, np.arange(marks.shape[1] + 1))
        # what is counted fits the type
        self.kind = np.uint8 if self.sizes.max(initial=0) < 256 else np.uint16
        self.width = len(marks)

    def common(self, a: int, b: int, asking: np.ndarray) -> np.ndarray:
        """Bits in common of rows a to b and all columns of `asking`."""
        base = np.add.reduce(asking[self.shared], axis=0, dtype=self.kind)
        if asking.shape[1] < MANY:
            dense = np.zeros((b - a, self.width), np.float32)
            bits = self.bits[self.edges[a] : self.edges[b]]
            dense[np.repeat(np.arange(b - a), np.diff(self.edges[a : b + 1])), bits] = 1
            return (dense @ asking.astype(np.float32)).astype(self.kind) + base
        out = np.empty((b - a, asking.shape[1]), self.kind)
        for i in range(a, b):
            np.add.reduce(asking[self.bits[self.edges[i] : self.edges[i + 1]]], axis=0, dtype=self.kind, out=out[i - a])
        return out + base


def best_in_block(
    query: DataFrame,
    reference: DataFrame,
    minimum: float,
    measure: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]],
    numbers_read: Sequence[str],
    tile_rows: int = TILE_ROWS,
    passing_rows: int = PASSING_ROWS,
    marks: Callable[[pa.RecordBatch | pa.Table], np.ndarray] = _bit_columns,
) -> DataFrame:
    """(query_key, ref_key, similarity, low, high): the best reference of the same block per query; exact.

    Both sides have id, block, vec (fingerprint words; or the columns that `marks` reads) and `numbers_read`. `measure` gives
    (allowed, low, high) for aligned arrays of these numbers; of the allowed pairs with similarity >= minimum > 0 the most
    similar comes first, then the smallest low, the largest high, the smallest ref_key. All pairs of a block are compared, in
    bounded tiles; only those at least as similar as the best so far are measured, and only the best of a query leaves a tile.
    """
    count = lambda df, rows, name: df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    sizes = count(reference, tile_rows, "_tiles").join(count(query, passing_rows, "_parts"), "block")
    sizes = F.broadcast(materialise(sizes))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda df, tile, part: df.join(sizes, "block").withColumn("tile", tile).withColumn("part", part).drop("_tiles", "_parts")
    held = deal(reference, place("_tiles"), every("_parts"))
    asked = deal(query, every("_tiles"), place("_parts"))
    kind = dict(query.dtypes)["id"], dict(reference.dtypes)["id"]

    def start(rows: pa.Table | None) -> Step:
        if rows is not None:
            rows = rows.sort_by("id")
            bits = _Bits(marks(rows))
            smallest = bits.sizes.min()
            own = {c: numbers(rows, c) for c in numbers_read}
            names = rows.column("id").combine_chunks()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if rows is None:
                return
            asking = marks(batch)
            size = asking.sum(0, dtype=np.int64)
            mine = {c: numbers(batch, c) for c in numbers_read}
            least = np.full(batch.num_rows, float(minimum))
            best = tuple(np.empty(0, t) for t in (np.int64, np.int64, float, float, float))
            a = 0
            while a < len(rows):
                b = min(len(rows), a + (AT_ONCE if a else AT_ONCE // 8))  # the first ones all pass
                common = bits.common(a, b, asking)
                # as many bits as the best so far asks for of the smallest row, with room for rounding
                need = np.maximum(np.ceil(least / (1 + least) * (size + smallest) - 1e-6), 1)
                r, q = np.nonzero(common >= need.astype(np.int64))
                both = common[r, q].astype("float64")
                s = both / (size[q] + bits.sizes[r + a] - both)
                r = r + a
                near = np.flatnonzero(s >= least[q])
                q, r, s = q[near], r[near], s[near]
                ok, low, high = measure({c: mine[c][q] for c in numbers_read}, {c: own[c][r] for c in numbers_read})
                ok = np.flatnonzero(ok)
                best = tuple(np.concatenate([x, y[ok]]) for x, y in zip(best, (q, r, s, low, high)))
                q, r, s, low, high = best
                order = np.lexsort((r, -high, low, -s, q))
                order = order[np.unique(q[order], return_index=True)[1]]
                best = tuple(x[order] for x in best)
                least[best[0]] = np.maximum(least[best[0]], best[2])
                a = b
            q, r, s, low, high = best
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(q)), names.take(pa.array(r)), *map(pa.array, (s, low, high))],
                names=["query_key", "ref_key", "similarity", "low", "high"],
            )

        return step

    schema = f"query_key {kind[0]}, ref_key {kind[1]}, similarity double, low double, high double"
    found = streamed(held, asked, ["block", "tile", "part"], schema, start)
    first = Window.partitionBy("query_key").orderBy(F.desc("similarity"), "low", F.desc("high"), "ref_key")
    return found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def norm_deviation(column: str = "embedding") -> Column:
    """|L2 norm - 1| of an embedding."""
    return F.abs(F.sqrt(F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + x * x)) - 1)


def normalised(column: str = "embedding") -> Column:
    norm = F.sqrt(F.aggregate(F.col(column), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(F.col(column), lambda x: x.cast("double") / F.nullif(norm, F.lit(0.0)))


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(a.astype("float64") @ b.astype("float64").T, 9)


COSINE = Metric(_cosine, lambda s: np.sqrt(np.maximum(2 - 2 * s, 0)))


def cosine_knn(
    query: DataFrame,
    reference: DataFrame,
    k: int,
    block: str | None = "library",
    key: str = "entity_id",
    minimum: float = -1.0,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The k references of highest cosine (at least `minimum`) per query; unit vectors, exact.

    Result: query_key, ref_key, cosine, rank; ties go to the smaller key.
    """
    index = Index.build(side(reference, key, "embedding", None, block), COSINE, leaf_rows)
    limit = float(np.sqrt(max(0.0, 2 - 2 * minimum)))
    return _rank(index.nearest(side(query, key, "embedding", None, block), k, limit, minimum), k, "cosine")
