"""Ragged per-entity data as nested columns, and contacts between atoms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysieve.functions import columns as C

# compared pairs of a task; about a sixth lies within the cutoff
PAIRS_OF_A_TASK, MOST_PARTITIONS = 4_000_000, 100_000


def pack(rows: DataFrame, keys: Sequence[str], position: str, fields: Sequence[str], name: str) -> DataFrame:
    """Rows -> one ordered array of structs per entity."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(position, *fields))).alias(name))


def unpack(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Inverse of `pack`, with the array index."""
    return df.select(*keys, F.posexplode(name).alias("index", "_x")).select(*keys, "index", "_x.*")


def rebase_edges(edges: Column, offset: Column) -> Column:
    """Shift source and target indices of an edge array."""
    return F.transform(edges, lambda e: e.withField("src", e["src"] + offset).withField("dst", e["dst"] + offset))


def nested_counts(df: DataFrame, nodes: str, edges: str, by: Sequence[str]) -> DataFrame:
    """Entities, total and largest node and edge counts per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum(F.size(nodes)).alias("nodes"),
        F.sum(F.size(edges)).alias("edges"),
        F.max(F.size(nodes)).alias("max_nodes"),
        F.max(F.size(edges)).alias("max_edges"),
    )


def dedup_status(df: DataFrame, key: str, order: str, panel_keys: DataFrame, status: str = "status") -> DataFrame:
    """Final status in source order: panel overlap first, then repeats of an earlier ok key."""
    blind = panel_keys.select(F.col(key)).distinct().withColumn("_blind", F.lit(True))
    marked = df.join(blind, key, "left").withColumn(
        "_s", F.when((F.col(status) == "ok") & F.col("_blind"), "panel_overlap").otherwise(F.col(status))
    )
    # the smallest order per ok key, by partial aggregation: a hot key is no hot window
    earliest = marked.where("_s = 'ok'").groupBy(key).agg(
        F.min(order).alias("_first"), F.count(F.lit(1)).alias("_copies")
    )
    from tallysieve.operators.skew import split_hot_lookup

    ok = split_hot_lookup(marked.where("_s = 'ok'"), earliest, [key], order, "_copies").withColumn(
        "_s", F.when(F.col(order) == F.col("_first"), "ok").otherwise("duplicate")
    )
    rest = marked.where("_s <> 'ok' or _s is null")
    columns = [F.col("_s").alias(status) if c == status else F.col(c) for c in df.columns]
    return ok.select(*columns).unionByName(rest.select(*columns))


# --- coordinates -----------------------------------------------------------


def _cells(df: DataFrame, cutoff: float, prefix: str) -> DataFrame:
    cell = lambda axis: F.floor(F.col(f"{prefix}{axis}") / cutoff).cast("bigint")
    return df.withColumns({f"c{axis}": cell(axis) for axis in "xyz"})


def _around(df: DataFrame) -> DataFrame:
    """Copies of each row for its own and the 26 adjacent grid cells."""
    for axis in "xyz":
        df = df.withColumn(f"c{axis}", F.explode(F.array(*[F.col(f"c{axis}") + d for d in (-1, 0, 1)])))
    return df


def _distance() -> Column:
    parts = [(F.col(f"a_{x}") - F.col(f"b_{x}")) for x in "xyz"]
    return F.sqrt(sum((d * d for d in parts[1:]), parts[0] * parts[0]))


def _side(atoms: DataFrame, prefix: str, on: Sequence[str], fields: Sequence[str]) -> DataFrame:
    return atoms.select(*on, *[F.col(c).alias(f"{prefix}{c}") for c in (*fields, "x", "y", "z")])


def _cell_sides(
    a: DataFrame, b: DataFrame, cutoff: float, on: Sequence[str], a_fields: Sequence[str], b_fields: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    left = _around(_cells(_side(a, "a_", on, a_fields), cutoff, "a_"))
    return left, _cells(_side(b, "b_", on, b_fields), cutoff, "b_")


def pair_partitions(a: DataFrame, b: DataFrame, cutoff: float, on: Sequence[str]) -> int:
    """Partitions for about PAIRS_OF_A_TASK compared pairs each, from the rows per cell; no fewer than Spark's own."""
    keys = [*on, "cx", "cy", "cz"]
    left, right = (side.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for side, n in zip(_cell_sides(a, b, cutoff, on, (), ()), "ab"))
    compared = left.join(right, keys).agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    least = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST_PARTITIONS, max(least, -(-compared // PAIRS_OF_A_TASK)))


def near_atoms(
    a: DataFrame, b: DataFrame, cutoff: float, on: Sequence[str], a_fields: Sequence[str], b_fields: Sequence[str]
) -> DataFrame:
    """Atom pairs within the cutoff in the same structure, by grid cells of that size."""
    left, right = _cell_sides(a, b, cutoff, on, a_fields, b_fields)
    joined = left.join(right, [*on, "cx", "cy", "cz"]).withColumn("distance", _distance())
    return joined.where(F.col("distance") <= cutoff).drop("cx", "cy", "cz")


def contacts(atoms: DataFrame, cutoff: float) -> DataFrame:
    """Residues within the cutoff of each ligand copy, with their minimum distance.

    `atoms`: structure, chain, residue, role ('protein' or 'ligand'), x, y, z.
    """
    protein = atoms.where("role = 'protein'")
    ligand = atoms.where("role = 'ligand'")
    on = ["structure", "chain"]
    pairs = near_atoms(protein, ligand, cutoff, on, ["residue"], ["residue"])
    # pairs grow faster than atoms, so tasks do too: a task groups the same number of pairs at any size
    keys = [*on, "ligand_residue", "residue"]
    pairs = pairs.select(*on, F.col("b_residue").alias("ligand_residue"), F.col("a_residue").alias("residue"), "distance")
    return pairs.repartition(pair_partitions(protein, ligand, cutoff, on), *keys).groupBy(*keys).agg(F.round(F.min("distance"), 3).alias("min_distance"))


def contact_union(found: DataFrame, direct: float) -> DataFrame:
    """Union over copies and structures: residue, closest distance, whether direct."""
    return found.groupBy("residue").agg(
        F.min("min_distance").alias("min_distance"),
        F.count_distinct("structure").alias("structures"),
    ).withColumn("direct", F.col("min_distance") <= direct)


def set_change(old: Column, new: Column) -> dict[str, Column]:
    return {
        "union": F.array_sort(F.array_union(old, new)),
        "added": F.array_sort(F.array_except(new, old)),
        "removed": F.array_sort(F.array_except(old, new)),
        "nested": F.size(F.array_except(old, new)) == 0,
    }


def subsite_contacts(found: DataFrame, subsites: DataFrame, result: str = "structure") -> DataFrame:
    """Per result and subsite: contact count, residue list, closest distance."""
    return (
        found.join(subsites, "residue")
        .groupBy(result, "subsite")
        .agg(
            F.count_distinct("residue").alias("contacts"),
            C.join_list(F.array_sort(F.collect_set("residue"))).alias("residues"),
            F.min("min_distance").alias("closest"),
        )
    )


def radius_edges(atoms: DataFrame, bonds: DataFrame, cutoff: float) -> DataFrame:
    """Directed edges i != j within the cutoff that are not bonded; atoms carry structure, atom."""
    near = near_atoms(atoms, atoms, cutoff, ["structure"], ["atom"], ["atom"]).where("a_atom <> b_atom")
    pairs = near.select("structure", F.col("a_atom").alias("src"), F.col("b_atom").alias("dst"), "distance")
    both = bonds.select("structure", "src", "dst").unionByName(
        bonds.select("structure", F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    return pairs.join(both.distinct(), ["structure", "src", "dst"], "left_anti")


def candidate_edges(ligand: DataFrame, residues: DataFrame) -> DataFrame:
    """Every ligand atom with every direct residue of its own structure (a bounded set per structure)."""
    direct = residues.where("direct").select("structure", "residue")
    return ligand.select("structure", "atom").join(direct, "structure")


def template_consensus(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Jointly succeeded results of two templates: min confidence times contact Jaccard.

    Both carry status, confidence and contacts (array<int>).
    """
    side = lambda df, p: df.where("status = 'succeeded'").select(
        key, F.col("confidence").alias(f"{p}_confidence"), F.col("contacts").alias(f"{p}_contacts")
    )
    joined = side(first, "first").join(side(second, "second"), key)
    least = F.least("first_confidence", "second_confidence")
    overlap = C.jaccard("first_contacts", "second_contacts")
    return joined.select(
        key,
        "first_confidence",
        "second_confidence",
        ((F.col("first_confidence") + F.col("second_confidence")) / 2).alias("mean_confidence"),
        least.alias("min_confidence"),
        overlap.alias("contact_jaccard"),
        (least * overlap).alias("consensus_score"),
    )


def result_status(runs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """All planned runs with their status; no result yet means pending."""
    return runs.join(results.select(key, "status"), key, "left").withColumn(
        "status", F.coalesce("status", F.lit("pending"))
    )
