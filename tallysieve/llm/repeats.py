"""Repeated passages by a sparse suffix array.

A passage of `length` words counts as repeated where its first occurrence, by (key, position),
is another one that doesn't overlap it. Words covered by such passages are removed: the first occurrence
stays, longer repeats fall as a whole, up to the last word that matches.

1. Retained suffixes. A position is retained if the hash of the PREFIX words from there is the smallest
   in some run of length - PREFIX + 1 positions: the choice depends on content only, takes one
   position in about sixteen, and every passage of `length` words holds one. Documents with
   the same word sequence form a class; only its smallest key goes on, the others are
   repeated as a whole.
2. Sort and compare neighbours. Suffixes are sorted over the cluster by (prefix hash, key, position)
   in ranges, so that a prefix which very many documents share spreads over tasks. A suffix
   with the prefix of its neighbour is a candidate.
3. Extend. All passages whose smallest position is a candidate reach from there left and right. Their
   hashes are sorted like the suffixes, each compared with the first of its run; runs that cross
   the border of a range are settled with a table of one row per range.
4. Runs of repeated passages are merged to spans of words, per document.

No suffix or passage group is collected; a task holds a batch. Passages are compared by 64-bit hashes.

Defined cases: null and empty texts and those shorter than `length` words have no repeats;
a null key is left alone; rows with the same key and the same words are repeated rows of one document and
share its spans, rows with the same key and other words are documents of their own; an empty table gives an empty table; columns are carried on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.common import ROW, carried, parts, stash

LENGTH, PREFIX = 50, 20


def minimisers(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hash at each position, and for each passage of `length` words its position with the smallest one."""
    from tallysieve.llm.arrow import window_hashes

    prefixes = window_hashes(words, PREFIX)
    run = length - PREFIX + 1
    if len(prefixes) < run:
        return prefixes, np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(prefixes, run)
    return prefixes, view.argmin(1) + np.arange(len(view))


def _word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    from tallysieve.llm.arrow import bytes_of, hash_words, words_of

    data, offsets = bytes_of(texts)
    starts, ends, first = words_of(data, offsets)
    hashes = hash_words(data, starts, ends)
    for a, b in zip(first.tolist(), first[1:].tolist()):
        yield hashes[a:b]


def digests(words: np.ndarray) -> tuple[int, int]:
    """128 bits for a sequence of words."""
    from tallysieve.llm.arrow import mix, window_hashes

    n = len(words)
    x = int(window_hashes(words, n)[0].view(np.int64)) if n else 0
    return x, int(mix(words + mix(np.arange(n, dtype=np.uint64))).sum(dtype=np.uint64).view(np.int64))


def suffixes(docs: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(id, n_words, x, y, keys, places) per row: digest of the word sequence, and the retained suffixes."""
    base = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("t"))
    schema = "id long, n_words long, x long, y long, keys array<long>, places array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import make_room, slices

        make_room(__name__)
        for batch in batches:
            for part in slices(batch):
                out: list[list] = [[] for _ in range(5)]
                for words in _word_hashes(part.column("t")):
                    n = len(words)
                    prefixes, chosen = minimisers(words, length)
                    chosen = np.unique(chosen)
                    for column, value in zip(out, (n, *digests(words), prefixes[chosen].view(np.int64), chosen.astype(np.int32))):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *[pa.array(c, k) for c, k in zip(out, kinds)]],
                    names=["id", "n_words", "x", "y", "keys", "places"],
                )

    return base.mapInArrow(run, schema)


def sorted_rows(rows: DataFrame, *by: str) -> DataFrame:
    """All rows in one order over the cluster; equal first columns may fill several ranges."""
    return rows.repartitionByRange(parts(rows.sparkSession), *by).sortWithinPartitions(*by)


def shared_suffixes(found: DataFrame) -> DataFrame:
    """(id, x, place): suffixes with the prefix of a neighbour in sorted order; those at a range's border count as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row waits for its neighbour
        before = None
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows < 2:
                held = batch if batch.num_rows else held
                continue
            keys = batch.column("key").to_numpy()
            same = keys[1:] == keys[:-1]
            take = same.copy()
            take[1:] |= same[:-1]
            take[0] |= before is None or before == keys[0]
            yield batch.slice(0, len(keys) - 1).filter(pa.array(take)).select(["id", "x", "place"])
            held, before = batch.slice(len(keys) - 1), keys[-2]
        if held is not None and held.num_rows:
            yield held.select(["id", "x", "place"])

    return sorted_rows(found, "key", "id", "x", "place").mapInArrow(run, "id long, x long, place int")


def passages(docs: DataFrame, lists: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """(hash, id, x, start): passages whose smallest position is listed for their document."""
    texts = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("t"))
    # the lists grow with the corpus: never broadcast, at any size
    base = texts.join(lists.hint("merge"), "id").select("id", "x", "t", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import make_room, slices, window_hashes

        make_room(__name__)
        for batch in batches:
            for part in slices(batch):
                hashes, ids, starts, digest = ([np.zeros(0, d)] for d in (np.int64, np.int64, np.int32, np.int64))
                lists_, own = part.column("places"), part.column("x").to_pylist()
                for at, words in enumerate(_word_hashes(part.column("t"))):
                    if digests(words)[0] != own[at]:
                        continue  # another text with the same key
                    listed = lists_[at].values.to_numpy(zero_copy_only=False)
                    start = np.flatnonzero(np.isin(minimisers(words, length)[1], listed))
                    hashes.append(window_hashes(words, length)[start].view(np.int64))
                    ids.append(np.full(len(start), part.column("id")[at].as_py(), np.int64))
                    digest.append(np.full(len(start), own[at], np.int64))
                    starts.append(start.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in (hashes, ids, digest, starts)], names=["hash", "id", "x", "start"]
                )

    return base.mapInArrow(run, "hash long, id long, x long, start int")


SURE, OPEN, BORDER = 0, 1, 2


def compared(rows: DataFrame, length: int) -> DataFrame:
    """Each passage beside the first of its run, in sorted order within a range.

    kind SURE: (id, x, start) with the first (seen_id, seen_x, seen_start) of its hash. kind OPEN: the same for a range's
    first run, which may have begun in an earlier range. kind BORDER: the first of a range's last run.
    First occurrences themselves, and passages that overlap theirs, are given for OPEN only.
    """
    schema = "kind int, part int, hash long, id long, x long, start int, seen_id long, seen_x long, seen_start int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        opening = last = None  # hash of the first run; (hash, id, x, start) of the current run's first

        def give(kind, keep, *values):
            n = int(keep.sum())
            columns = [np.full(n, kind, np.int32), np.full(n, part, np.int32), *[c[keep] for c in values]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            hashes, *spots = (batch.column(c).to_numpy() for c in ("hash", "id", "x", "start"))
            if opening is None:
                opening = hashes[0]
            new = np.concatenate([[last is None or last[0] != hashes[0]], hashes[1:] != hashes[:-1]])
            run_no = np.cumsum(new)  # 0 for rows that go on with the run of the batch before
            heads = np.flatnonzero(new)
            seen = [
                np.concatenate([np.array([last[k + 1] if last else 0], v.dtype), v[heads]])[run_no] for k, v in enumerate(spots)
            ]
            last = (hashes[-1], *[v[-1] for v in seen])
            in_first = hashes == opening
            yield give(OPEN, in_first, hashes, *spots, *seen)
            yield give(SURE, _later(spots, seen, length) & ~in_first, hashes, *spots, *seen)
        if last is not None:
            kinds = (np.int64, np.int64, np.int64, np.int32)
            row = [np.array([v], d) for v, d in zip(last, kinds)]
            yield give(BORDER, np.ones(1, bool), *row, *row[1:])

    return sorted_rows(rows, "hash", "id", "x", "start").mapInArrow(run, schema)


def _later(spots: list[np.ndarray], seen: list[np.ndarray], length: int) -> np.ndarray:
    """Passages in another document than the first of their run, or beyond its end."""
    return (spots[0] != seen[0]) | (spots[1] != seen[1]) | (spots[2] - seen[2] >= length)


def repeated_passages(rows: DataFrame, length: int) -> DataFrame:
    """(id, x, start, seen_id) of every passage whose first occurrence is another one and doesn't overlap it."""
    rows = stash(compared(rows, length), "passages")
    # one row per range at most: (hash, range, first), the earliest range of each hash
    border: dict[int, tuple[int, int, int, int]] = {}
    for r in rows.where(F.col("kind") == BORDER).select("hash", "part", "seen_id", "seen_x", "seen_start").collect():
        border[r[0]] = min(border.get(r[0], tuple(r[1:])), tuple(r[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, part, hashes, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            spots, seen, keep = values[:3], [v.copy() for v in values[3:]], kind == SURE
            opened = kind == OPEN
            for h in np.unique(hashes[opened]).tolist():  # one per range
                if h in border:
                    mine = opened & (hashes == h) & (part > border[h][0])
                    for v, first in zip(seen, border[h][1:]):
                        v[mine] = first
            keep |= opened & _later(spots, seen, length)
            columns = [pa.array(c[keep]) for c in (*spots, seen[0])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "start", "seen_id"])

    return rows.mapInArrow(run, "id long, x long, start int, seen_id long")


def merged(found: DataFrame, length: int) -> DataFrame:
    """(id, x, spans): spans (start, n_words, seen_id) of words covered by passages, in order; a list per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for starts, seen in zip(batch.column("starts"), batch.column("seen")):
                s, o = starts.values.to_numpy(), seen.values.to_numpy()
                order = np.argsort(s, kind="stable")
                s, o = s[order], o[order]
                heads = np.flatnonzero(np.concatenate([[True], np.diff(s) > length]))
                tails = np.append(heads[1:], len(s)) - 1
                out.append(
                    [
                        {"start": a, "n_words": b - a + length, "seen_id": i}
                        for a, b, i in zip(s[heads].tolist(), s[tails].tolist(), o[heads].tolist())
                    ]
                )
            kind = pa.list_(pa.struct([("start", pa.int64()), ("n_words", pa.int64()), ("seen_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(out, kind)], names=["id", "x", "spans"])

    lists = found.groupBy("id", "x").agg(
        F.collect_list(F.struct("start", "seen_id")).alias("l")  # no more than the document has words
    )
    lists = lists.select("id", "x", F.col("l.start").alias("starts"), F.col("l.seen_id").alias("seen"))
    return lists.mapInArrow(run, "id long, x long, spans array<struct<start:long,n_words:long,seen_id:long>>")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, x, spans) of the documents that repeat passages: spans (start, n_words, seen_id), counted in words from 0.

    x is a digest of the document's words, which tells texts with the same key apart.
    """
    if length <= PREFIX:
        raise ValueError(f"passages have more than {PREFIX} words")
    cut = stash(suffixes(docs, key, text, length).where("id is not null"), "suffixes")
    long = cut.where(F.col("n_words") >= length)
    classes = long.groupBy("x", "y", "n_words").agg(F.min("id").alias("first"))
    same = long.select("id", "x", "y", "n_words").join(classes, ["x", "y", "n_words"]).where("id <> first")
    whole = same.select(
        "id", "x", F.array(F.struct(F.lit(0).cast("long").alias("start"), "n_words", F.col("first").alias("seen_id"))).alias("spans")
    ).distinct()
    # of a class only the first goes on; of repeated rows, one
    chosen = long.join(classes.select(F.col("first").alias("id"), "x", "y", "n_words"), ["id", "x", "y", "n_words"], "left_semi")
    chosen = chosen.select("id", "x", F.explode(F.arrays_zip("keys", "places")).alias("s"))
    found = chosen.select(F.col("s.keys").alias("key"), "id", "x", F.col("s.places").alias("place"))
    shared = shared_suffixes(found)
    lists = shared.groupBy("id", "x").agg(F.collect_set("place").alias("places"))
    rows = passages(docs, lists, key, text, length)
    rows = stash(rows, "extended")
    return merged(repeated_passages(rows, length), length).unionByName(whole)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents with repeated passages cut out of their text; all columns and rows stay."""
    spans = repeated_spans(docs, key, text, length)
    # a key has an entry for each of its different texts
    spans = stash(spans.groupBy("id").agg(F.collect_list(F.struct("x", "spans")).alias("found")), "spans")
    others = [c for c in docs.columns if c != text]
    rows = docs.select(carried(docs, others), docs[key].cast("long").alias("id"), docs[text].cast("string").alias("t"))
    joined = rows.join(spans.withColumnRenamed("id", "found_id"), F.col("id") == F.col("found_id"), "left")
    base = joined.select(ROW, "t", "found")
    schema = base.select(ROW, F.col("t").alias("cut")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import make_room, slices

        make_room(__name__)
        for batch in batches:
            for part in slices(batch):
                texts, found = part.column("t"), part.column("found")
                changed = np.flatnonzero(~found.is_null().to_numpy(zero_copy_only=False)).tolist()
                if changed:
                    out = texts.to_pylist()
                    for at in changed:
                        out[at] = _cut(texts.slice(at, 1), {f["x"]: f["spans"] for f in found[at].as_py()})
                    texts = pa.array(out, texts.type)
                yield pa.RecordBatch.from_arrays([part.column(ROW), texts], names=[ROW, "cut"])

    done = base.mapInArrow(run, schema)
    return done.select(*[F.col("cut").alias(c) if c == text else F.col(f"{ROW}.`{c}`") for c in docs.columns])


def _cut(text: pa.Array, spans: dict[int, list[dict]]) -> str:
    """The text without the spans that are listed for its digest."""
    from tallysieve.llm.arrow import bytes_of, hash_words, words_of

    data, offsets = bytes_of(text)
    starts, ends, _ = words_of(data, offsets)
    mine = spans.get(digests(hash_words(data, starts, ends))[0], ())
    starts = np.append(starts, len(data))
    body, left, kept = data.tobytes(), 0, []
    for span in mine:
        a, b = span["start"], span["start"] + span["n_words"]
        kept.append(body[left : starts[min(a, len(starts) - 1)]])
        left = starts[min(b, len(starts) - 1)]
    return b"".join([*kept, body[left:]]).decode()
