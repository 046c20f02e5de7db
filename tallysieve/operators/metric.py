"""Exact search by distance: a metric index of two levels, and the rounds that ask it.

The index. Top pivots are a few rows drawn by hash, in number the square root of the leaves: one
bounded array on the driver. A row's cell is its nearest top pivot (and its size band). One row
in `leaf_rows` is a sub-pivot of its cell; the sub-pivots are a table that grows with the rows, and a row's
leaf is the nearest sub-pivot of its cell (equal ones share the rows by hash, so that copies spread).
Leaves of a cell are packed in groups of about LEAVES; groups, in order of their size band and pivot, are packed in
tiles of up to TILE_ROWS, the unit that is held in memory.

Asking. By the triangle inequality, a row is out of reach if the distance to the pivot less the radius
exceeds the bound. First each query is compared with the nearest leaf in some groups of its own cell, which
bounds the distance of its k-th neighbour. Then it asks only the tiles with a cell inside that bound and, within
these, only the leaves inside. Queries are dealt in turns by their own cell, so those of a turn ask for the same tiles.
A query is copied once for a tile, a tile once for a turn: their numbers follow from the memory of a task and from
the cores to be kept busy, about as many of one as of the other, and not from the number of cells and leaves.

`streamed` is the step below all of it: the rows held for a key stay in memory, the rows that ask
pass by in Arrow batches. Nothing grows with the number of queries of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysieve.session import fan_out, materialise, shuffled, store

LEAF_ROWS = 2048
LEAVES = 8
MAX_TOPS = 2048
ASK_ROWS, LEAST_ASK_ROWS = 1 << 17, 1 << 12
TILE_ROWS, LEAST_TILE_ROWS = 1 << 17, 1 << 12
# pairs of a tile and a turn for each core
UNITS = 8
# pairs that a step holds before it drops all but the best
HELD_PAIRS = 1 << 20
PROBES = 8
BANDS = 64
SLACK = 1e-6
PLACE, TILE = ["block", "cell", "group"], ["block", "tile"]

Step = Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]
Pairs = Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]


@dataclass(frozen=True)
class Metric:
    """`score` of two matrices of rows, higher is nearer; `away` turns scores into distances.

    `sized`: distances are at least 1 - smaller / larger size. `pairs`, if given, finds the same pairs with less work: for
    the queries it returns a function of (rows, queries asking, their least scores) that gives (query, row, score).
    """

    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    away: Callable[[np.ndarray], np.ndarray]
    sized: bool = False
    pairs: Callable[[np.ndarray], Pairs] | None = None

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.away(self.score(a, b))

    def size_gap(self, size: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray | float:
        """Lower bound of the distance to rows of the given sizes, from sizes alone."""
        if not self.sized:
            return 0.0
        small, large = np.minimum(size[:, None], most[None]), np.maximum(size[:, None], least[None])
        return 1 - small / np.maximum(large, 1)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def matrix(rows: pa.RecordBatch | pa.Table, column: str = "vec") -> np.ndarray:
    values = rows.column(column)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def numbers(rows: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    return rows.column(column).to_numpy() if isinstance(rows, pa.Table) else rows.column(column).to_numpy(zero_copy_only=False)


def replaced(batch: pa.RecordBatch, **columns: np.ndarray) -> pa.RecordBatch:
    """The batch with some columns set, in place or at the end."""
    data = dict(zip(batch.schema.names, batch.columns)) | {k: pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(data.values()), names=list(data))


def streamed(
    held: DataFrame, asked: DataFrame, keys: Sequence[str], schema: str, start: Callable[[pa.Table | None], Step]
) -> DataFrame:
    """For each key, `start` gets its held rows (None without any) and gives the step that its asked rows go through."""
    both = held.withColumn("_turn", F.lit(0)).unionByName(asked.withColumn("_turn", F.lit(1)), allowMissingColumns=True)
    dealt = fan_out(both, *keys).sortWithinPartitions(*keys, "_turn")
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, step = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "_turn")]
            new = np.zeros(batch.num_rows - 1, bool)
            for m in marks:
                new |= m[1:] != m[:-1]
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                key = tuple(m[a] for m in marks[:-1])
                if key != now:
                    now, kept, step = key, [], None
                piece = batch.slice(a, b - a)
                if not marks[-1][a]:
                    kept.append(piece)
                    continue
                if step is None:
                    step = start(pa.Table.from_batches(kept) if kept else None)
                    kept = []
                for out in step(piece):
                    yield pa.RecordBatch.from_arrays([out.column(c) for c in names], names=names)

    return dealt.mapInArrow(run, schema)


def shared_out(rows: DataFrame, counts: DataFrame, keys: Sequence[str], row_id: str, room: int = ASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows with `part`, hot): rows of keys that hold much more than others spread over parts.

    `counts` has keys and n. A key is hot if it holds more than `room` and a thousandth of all rows: at most a
    thousand keys, so the list `hot` (keys, parts) is broadcast.
    """
    total = F.coalesce(counts.agg(F.sum("n")).scalar(), F.lit(0))
    limit = F.greatest(F.lit(float(room)), total / 1000)
    hot = counts.withColumn("_limit", limit).where(F.col("n") > F.col("_limit"))
    hot = hot.select(*keys, F.ceil(F.col("n") / F.col("_limit")).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64(row_id), F.col("parts")), F.lit(0)).cast("int").alias("part")
    return rows.join(F.broadcast(hot), list(keys), "left").select(*rows.columns, part), hot


def in_all_parts(held: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Held rows once for each part of their key."""
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    return held.join(F.broadcast(hot), list(keys), "left").select(*held.columns, parts)


class Index:
    """Rows (id, block, cell, leaf, group, vec, size, ...) and cells (block, cell, n, radius, least, most, groups)."""

    def __init__(self, rows: DataFrame, cells: DataFrame, tops: np.ndarray, metric: Metric, vector: str, key: str):
        self.rows, self.cells, self.tops, self.metric, self.vector, self.key = rows, cells, tops, metric, vector, key

    @classmethod
    def build(cls, reference: DataFrame, metric: Metric, leaf_rows: int = LEAF_ROWS) -> Index:
        """`reference` has id, block, vec and size; rows without a block meet nothing and are left out."""
        vector, key = reference.schema["vec"].dataType.simpleString(), reference.schema["id"].dataType.simpleString()
        reference = store(reference.where("block is not null"))
        leaves = max(1, reference.count() // leaf_rows)
        count = min(MAX_TOPS, max(1, round(leaves**0.5)))
        drawn = reference.orderBy(F.xxhash64("id"), "id").limit(count).select("vec").collect()
        tops = np.array([row[0] for row in drawn])
        block = reference.schema["block"].dataType.simpleString()
        fields = f"id {key}, block {block}, vec {vector}, size int, cell int"
        placed = reference.withColumn("size", F.col("size").cast("int")).mapInArrow(cls._cells(tops, metric), f"{fields}, away double")
        subs = placed.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(leaf_rows)) == 0).select("id", "block", "cell", "vec")
        subs = materialise(subs)
        counts = placed.groupBy("block", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.max("away").alias("radius"), F.min("size").alias("least"), F.max("size").alias("most")
        )
        counts = materialise(counts)
        dealt, hot = shared_out(placed.drop("away"), counts.select("block", "cell", "n"), ["block", "cell"], "id")
        keys = ["block", "cell", "part"]
        rows = streamed(
            in_all_parts(subs, hot, keys[:2]), dealt, keys, f"{fields}, leaf int, group int", cls._leaves(metric)
        )
        sizes = subs.groupBy("block", "cell").agg(F.ceil(F.count(F.lit(1)) / LEAVES).cast("int").alias("groups"))
        cells = counts.join(sizes, ["block", "cell"], "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
        return cls(store(rows), store(cells), tops, metric, vector, key)

    @staticmethod
    def _cells(tops: np.ndarray, metric: Metric):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = metric.distance(matrix(batch), tops)
                    band = np.log2(np.maximum(numbers(batch, "size"), 1)).astype(np.int32) if metric.sized else 0
                    cell = (d.argmin(1) * BANDS + band).astype(np.int32)
                    out = replaced(batch, cell=cell, away=d.min(1))
                    yield out.select(["id", "block", "vec", "size", "cell", "away"])

        return run

    @staticmethod
    def _leaves(metric: Metric):
        def start(subs: pa.Table | None) -> Step:
            vectors = None if subs is None else matrix(subs.sort_by("id"))
            groups = 1 if subs is None else -(-len(vectors) // LEAVES)

            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                leaf = np.zeros(batch.num_rows, np.int32)
                if vectors is not None:
                    d = metric.distance(matrix(batch), vectors)
                    tied = d <= d.min(1)[:, None]
                    turn = np.arange(len(d)) % tied.sum(1)  # equal pivots share their rows
                    leaf = (np.cumsum(tied, 1) > turn[:, None]).argmax(1).astype(np.int32)
                yield replaced(batch, leaf=leaf, group=leaf % np.int32(groups))

            return step

        return start

    # asking -----------------------------------------------------------------------------

    def at_home(self, queries: DataFrame, limit: float, k: int | None) -> DataFrame:
        """Queries (id, block, vec, size) with their own cell, one of its groups and their number, and a bound from the cells that hold k rows."""
        counts = queries.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        dealt, hot = shared_out(queries, counts, ["block"], "id")
        metric, tops = self.metric, self.tops

        def start(cells: pa.Table | None) -> Step:
            if cells is None:
                return lambda batch: iter(())
            gaps = _gaps(cells, metric, tops)
            cell, n, groups, radius = (numbers(cells, c) for c in ("cell", "n", "groups", "radius"))

            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                d, low = gaps(batch)
                home = (low + 1e-3 * d).argmin(1)
                bound = np.full(len(d), float(limit))
                if k is not None:
                    far = d + radius
                    order = far.argsort(1)
                    enough = np.cumsum(n[order], 1) >= k
                    edge = np.take_along_axis(far, np.take_along_axis(order, enough.argmax(1)[:, None], 1), 1)[:, 0]
                    bound = np.where(enough.any(1), np.minimum(bound, edge), bound)
                group = (np.arange(len(d)) % groups[home]).astype(np.int32)
                yield replaced(batch, cell=cell[home].astype(np.int32), group=group, groups=groups[home].astype(np.int32), bound=bound)

            return step

        schema = f"id {_kind(queries, 'id')}, block {_kind(queries, 'block')}, vec {self.vector}, size int, cell int, group int, groups int, bound double"
        return streamed(in_all_parts(self.cells, hot, ["block"]), dealt, ["block", "part"], schema, start)

    def tightened(self, home: DataFrame, k: int) -> DataFrame:
        """The same rows with the bound of the k-th neighbour in the nearest leaf of PROBES groups of the own cell."""
        step = F.explode(F.sequence(F.lit(0), F.least(F.col("groups"), F.lit(PROBES)) - 1))
        probing = home.withColumn("_i", step).withColumn("group", F.pmod(F.col("group") + F.col("_i"), F.col("groups")))
        probing = probing.drop("_i", "groups")
        counts = probing.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n"))
        dealt, hot = shared_out(probing, counts, PLACE, "id")
        metric = self.metric

        def start(rows: pa.Table | None) -> Step:
            held = None if rows is None else Held(rows, metric)

            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                if held is not None:
                    yield replaced(batch.select(["id"]), bound=held.tightened(batch, numbers(batch, "bound"), k))

            return step

        keys = [*PLACE, "part"]
        found = streamed(in_all_parts(self.rows, hot, PLACE), dealt, keys, f"id {_kind(home, 'id')}, bound double", start)
        least = found.groupBy("id").agg(F.min("bound").alias("_bound"))
        bound = F.least("bound", F.coalesce("_bound", "bound")).alias("bound")
        rest = [c for c in home.columns if c not in ("groups", "bound")]
        return home.join(shuffled(least), "id", "left").select(*rest, bound)

    def tiled(self, asking: int) -> int:
        """Packs the groups in tiles for so many queries, and gives the number of turns to ask in."""
        total = max(1, self.cells.agg(F.sum("n")).first()[0] or 0)
        asking, cores = max(1, asking), self.rows.sparkSession.sparkContext.defaultParallelism
        units = UNITS * cores
        tiles = max(-(-total // TILE_ROWS), min(round((units * total / asking) ** 0.5), total // LEAST_TILE_ROWS), 1)
        room = -(-total // tiles)
        before = Window.partitionBy("block").orderBy(F.col("cell") % BANDS, "cell").rowsBetween(Window.unboundedPreceding, -1)
        at = lambda group: F.floor((F.col("before") + group * F.col("n") / F.col("groups")) / room).cast("int")
        cells = self.cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        self.cells = store(cells.withColumns({"first_tile": at(F.lit(0)), "last_tile": at(F.col("groups") - 1)}))
        place = self.cells.select("block", "cell", "n", "groups", "before")
        self.rows = self.rows.join(place, ["block", "cell"]).withColumn("tile", at(F.col("group"))).drop("n", "groups", "before")
        return max(1, min(-(-units // tiles), asking // LEAST_ASK_ROWS))

    def asked(self, home: DataFrame, wanted: int | None = None) -> tuple[DataFrame, int]:
        """Queries once for each tile with a cell in reach of their bound, with their turn; and the number of turns.

        A turn has queries of neighbouring cells. `wanted` is the number of turns if the groups are packed already.
        """
        asking = home.count()
        wanted = wanted or self.tiled(asking)
        room = max(1, -(-asking // wanted))
        own = home.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("asking"))
        before = Window.partitionBy("block").orderBy(F.col("cell") % BANDS, "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        turns = own.withColumn("seen", F.sum("asking").over(before)).select(
            "block",
            "cell",
            F.floor((F.col("seen") - F.col("asking")) / room).cast("int").alias("first_turn"),
            F.greatest(F.ceil(F.col("asking") / room), F.lit(1)).cast("int").alias("turns"),
        )
        cells = self.cells.join(turns, ["block", "cell"], "left").fillna({"first_turn": 0, "turns": 1})
        cells = materialise(cells)
        several = cells.agg(F.max(F.col("first_turn") + F.col("turns"))).first()[0] or 1
        counts = home.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
        queries = home.withColumnRenamed("cell", "own_cell").drop("group")
        dealt, hot = shared_out(queries, counts, ["block"], "id", room=min(ASK_ROWS, room))
        metric, tops = self.metric, self.tops

        def start(table: pa.Table | None) -> Step:
            if table is None:
                return lambda batch: iter(())
            table = table.sort_by("cell")
            gaps = _gaps(table, metric, tops)
            cell, first, turns_, low_tile, high_tile = (numbers(table, c) for c in ("cell", "first_turn", "turns", "first_tile", "last_tile"))
            times = high_tile - low_tile + 1
            held = np.repeat(np.arange(len(cell)), times)  # a cell of several tiles, a tile of several cells
            tile = np.repeat(low_tile, times) + np.arange(len(held)) - np.repeat(np.cumsum(times) - times, times)
            order = np.argsort(tile, kind="stable")
            held, tile = held[order], tile[order]
            heads = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))

            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                for a in range(0, batch.num_rows, 1024):
                    part = batch.slice(a, 1024)
                    _, low = gaps(part)
                    near = low <= numbers(part, "bound")[:, None] + SLACK
                    q, t = np.nonzero(np.logical_or.reduceat(near[:, held], heads, axis=1))
                    at = np.searchsorted(cell, numbers(part, "own_cell"))
                    turn = first[at] + np.arange(len(at)) % turns_[at]
                    for b in range(0, len(q), 8192):
                        s = slice(b, b + 8192)
                        out = part.take(pa.array(q[s]))
                        yield replaced(out, tile=tile[heads[t[s]]].astype(np.int32), turn=turn[q[s]].astype(np.int32))

            return step

        schema = f"{_schema(queries)}, tile int, turn int"
        return streamed(in_all_parts(cells, hot, ["block"]), dealt, ["block", "part"], schema, start), several

    def compared(self, asked: DataFrame, turns: int, schema: str, use: Callable[[Held], Step]) -> DataFrame:
        """Each tile is held once for a turn that asks for it; `use` makes the step that queries go through."""
        if turns > parts(asked.sparkSession):
            asked = store(asked)
            offered = self.rows.join(shuffled(asked.select(*TILE, "turn").distinct()), TILE)
        else:  # no more than a copy for each partition
            offered = self.rows.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
        metric = self.metric

        def start(rows: pa.Table | None) -> Step:
            return (lambda batch: iter(())) if rows is None else use(Held(rows, metric))  # a turn that nothing of the tile is in

        return streamed(offered.drop("group"), asked, [*TILE, "turn"], schema, start)

    def nearest(self, queries: DataFrame, k: int, limit: float, least: float = -np.inf) -> DataFrame:
        """(query_key, ref_key, value): for each query its k best rows at least, and about k of a tile."""
        queries = _queries(queries)
        home = store(self.tightened(store(self.at_home(queries, limit, k)), k))
        schema = f"query_key {_kind(queries, 'id')}, ref_key {self.key}, value double"

        def use(held: Held) -> Step:
            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                ids = batch.column("id")
                for q, r, s in held.best(batch, numbers(batch, "bound"), k, least):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(q)), held.ids.take(pa.array(r)), pa.array(s, pa.float64())],
                        names=["query_key", "ref_key", "value"],
                    )

            return step

        return self.compared(*self.asked(home), schema, use)


def _gaps(cells: pa.Table, metric: Metric, tops: np.ndarray):
    """(distance to each cell's pivot, lower bound for each cell) of a batch of queries."""
    top = numbers(cells, "cell") // BANDS
    radius, least, most = (numbers(cells, c) for c in ("radius", "least", "most"))

    def gaps(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        d = metric.distance(matrix(batch), tops)[:, top]
        return d, np.maximum(d - radius, metric.size_gap(numbers(batch, "size"), least, most))

    return gaps


class Held:
    """Leaves in memory: rows by cell, leaf and id, with a centre and a radius for each leaf."""

    def __init__(self, rows: pa.Table, metric: Metric):
        rows = rows.sort_by([("cell", "ascending"), ("leaf", "ascending"), ("id", "ascending")])
        self.metric, self.table = metric, rows
        self.ids, self.place = rows.column("id").combine_chunks(), None
        self.vectors, sizes = matrix(rows), numbers(rows, "size")
        cell, leaf = numbers(rows, "cell"), numbers(rows, "leaf")
        heads = np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (cell[1:] != cell[:-1])))
        self.edges = np.append(heads, len(leaf))
        self.centers = self.vectors[heads]
        each = range(len(heads))
        self.radius = np.array(
            [metric.distance(self.centers[i : i + 1], self.vectors[self.edges[i] : self.edges[i + 1]]).max() for i in each]
        )
        self.least = np.minimum.reduceat(sizes, heads)
        self.most = np.maximum.reduceat(sizes, heads)

    def hits(
        self, batch: pa.RecordBatch, bound: np.ndarray, k: int | None = None, least: float = -np.inf
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, score) of the pairs within the bounds; with `k` no more than the k best of a query and some rows.

        With `k` a query's bound follows the k-th best met so far, so that later leaves have less to give.
        """
        vectors = matrix(batch)
        low = np.maximum(
            self.metric.distance(vectors, self.centers) - self.radius,
            self.metric.size_gap(numbers(batch, "size"), self.least, self.most),
        )
        return self._hits(vectors, low, bound.copy(), k, least)

    def best(
        self, batch: pa.RecordBatch, bound: np.ndarray, k: int, least: float = -np.inf
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """`hits` of which only the k best of a query are left, ties to the smaller id; rarely more than once for a batch."""
        if self.place is None:
            self.place = np.empty(len(self.ids), np.int64)
            self.place[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        place = self.place
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pairs = 0

        def best_kept() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, r, s = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((place[r], -s, q))
            q = q[order]
            heads = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            first = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q)))) < k
            return q[first], r[order][first], s[order][first]

        for found in self.hits(batch, bound, k, least):
            kept.append(found)
            pairs += len(found[0])
            if pairs > HELD_PAIRS:
                yield best_kept()
                kept, pairs = [], 0
        if kept:
            yield best_kept()

    def tightened(self, batch: pa.RecordBatch, bound: np.ndarray, k: int) -> np.ndarray:
        """The bounds after each query has met its nearest leaf."""
        vectors, bound = matrix(batch), bound.copy()
        low = np.full((len(vectors), len(self.centers)), np.inf)
        low[np.arange(len(vectors)), self.metric.distance(vectors, self.centers).argmin(1)] = -np.inf
        for _ in self._hits(vectors, low, bound, k):
            pass
        return bound

    def _hits(
        self, vectors: np.ndarray, low: np.ndarray, bound: np.ndarray, k: int | None, least: float = -np.inf
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """`hits` with lower bounds of the distances to leaves; lowers `bound` in place."""
        pairs = self.metric.pairs(vectors) if self.metric.pairs else None
        for leaf in np.flatnonzero((low <= bound[:, None] + SLACK).any(0)).tolist():
            a, b = self.edges[leaf : leaf + 2].tolist()
            for c in range(a, b, 2 * LEAF_ROWS):
                rows = self.vectors[c : min(b, c + 2 * LEAF_ROWS)]
                asking = np.flatnonzero(low[:, leaf] <= bound + SLACK)
                if pairs:
                    # scores at the bound itself may lie a rounding apart
                    found = pairs(rows, asking, np.maximum(1 - bound[asking] - SLACK, least))
                else:
                    found = self._dense(vectors, rows, asking, bound, k, least)
                for q, r, s in found:
                    if k is not None and len(q):
                        keep, kth = best_of(q, r, s, k)
                        bound[q[kth]] = np.minimum(bound[q[kth]], self.metric.away(s[kth]))
                        q, r, s = q[keep], r[keep], s[keep]
                    if len(q):
                        yield q, r + c, s

    def _dense(self, vectors, rows, asking, bound, k, least) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, len(asking), 1024):
            mine = asking[at : at + 1024]
            s = self.metric.score(vectors[mine], rows)
            good = (self.metric.away(s) <= bound[mine, None] + SLACK) & (s >= least)
            q, r = np.nonzero(good if k is None else best_columns(np.where(good, s, -np.inf), k) & good)
            yield mine[q], r, s[q, r]


def best_of(q: np.ndarray, r: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k best pairs of each query, ties to the lower row, and of each query's k-th; pairs come by query and row."""
    heads = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    times = np.diff(np.append(heads, len(q)))
    if k == 1:
        top = np.flatnonzero(s == np.repeat(np.maximum.reduceat(s, heads), times))
        top = top[np.append(True, q[top][1:] != q[top][:-1])]
        return top, top
    order = np.lexsort((r, -s, q))
    place = np.arange(len(q)) - np.repeat(heads, times)
    return order[place < k], order[place == k - 1]


def best_columns(value: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest entries of each row, ties to the left."""
    keep = np.zeros(value.shape, bool)
    if k == 1:
        keep[np.arange(len(value)), value.argmax(1)] = True
        return keep
    n = value.shape[1]
    if n <= k:
        return ~keep
    edge = np.partition(value, n - k, 1)[:, n - k, None]
    keep = value > edge
    tied = value == edge
    return keep | (tied & (np.cumsum(tied, 1) <= k - keep.sum(1)[:, None]))


def _queries(df: DataFrame) -> DataFrame:
    return df.where("block is not null").withColumn("size", F.col("size").cast("int"))


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "part")


def side(df: DataFrame, key: str, vector: str, size: str | None, block: str | None) -> DataFrame:
    """(id, block, vec, size) of a table."""
    return df.select(
        F.col(key).alias("id"),
        (F.col(block) if block else F.lit("")).alias("block"),
        F.col(vector).alias("vec"),
        (F.col(size) if size else F.lit(1)).cast("int").alias("size"),
    )
