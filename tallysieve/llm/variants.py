"""Spelling variants: words one edit apart, grouped below the more frequent form.

1. Words are maximal runs of letters, A-Z in lower case, counted over whole texts: within a task first,
   then by a grouped sum. Those of at least `shortest` letters and `least` occurrences make the vocabulary.
2. Near words differ by one inserted, deleted or replaced letter. Two words of c and of c or c + 1 letters
   that are near share their first c // 2 letters or their last c - c // 2. So each word goes, once as
   the shorter and once as the longer of a pair, to the bucket of its head and to that of its tail.
   Buckets are sorted and laid side by side in tiles; one beyond BLOCK words is cut into blocks, each
   pair of which is a tile.
3. In a tile, a bit-sliced position index has a bitset over the tile's words for each (position, letter).
   All words of c letters run through it together: Z holds the words that agree so far, S those
   with one letter replaced, I those with one letter more:
       I = (I | Z) & bits[i + 1][letter],  S = S & bits[i][letter] | Z & ~bits[i][letter],  Z = Z & bits[i][letter]
   64 words a machine word. A pair counts in the bucket of its head if it shares one, else of its tail: exactly once.
   A tile gives, for each word, the number of its near words and the best of them: no pair leaves it.
4. A word's form is its near word with most occurrences (ties: the smallest) if that has at least
   `ratio` times its own. Forms are followed to the last by pointer doubling; counts
   grow by the ratio at each step, so there are few rounds.

Memory per task: one tile (BLOCK words, or two blocks), and bitsets for three positions at a time.

Defined cases: null and empty texts have no words; a null key counts like any other row; repeated rows count again;
ties as stated; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.common import parts, stash

# What counts as a letter, the shortest word, the fewest occurrences, how much more frequent a form is.
LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, RATIO = 5, 3, 2
BLOCK, CHUNK = 2048, 1024
TILE_BYTES = 1 << 20
HELD = 200_000  # words that a task counts before it hands them on

Change = Callable[[int | None, bytes], bytes]  # (key, word in Latin-1) -> word


def count_words(docs: DataFrame, key: str, text: str, change: Change | None = None) -> DataFrame:
    """(word, n): occurrences of each word over all texts; `change` may rewrite a word of a document."""
    base = docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import make_room, slices

        make_room(__name__)
        find = re.compile(f"[{LETTERS}]+").findall
        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for i, t in zip(part.column("id").to_pylist(), part.column("t").to_pylist()):
                    for word, n in Counter(find(t or "")).items():
                        word = word.encode("latin-1").lower()  # of bytes, only A-Z
                        held[change(i, word) if change else word] += n
                    if len(held) >= HELD:
                        yield handed()
        if held:
            yield handed()

    return base.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def bucketed(words: DataFrame) -> DataFrame:
    """(c, head, key, i, j, block, word, n): each word in its buckets; blocks i, j of a bucket beyond BLOCK words."""
    size = F.char_length("word")
    sides = [
        F.struct(
            (size - longer).alias("c"),
            F.lit(head).alias("head"),
            (
                F.substring(F.col("word"), F.lit(1), F.floor((size - longer) / 2).cast("int"))
                if head
                else F.right(F.col("word"), (size - longer - F.floor((size - longer) / 2)).cast("int"))
            ).alias("key"),
        )
        for longer in (0, 1)
        for head in (True, False)
    ]
    rows = words.select("word", "n", F.explode(F.array(*sides)).alias("s")).select("s.*", "word", "n")
    sizes = rows.groupBy("c", "head", "key").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.char_length("word") - F.col("c")).alias("over")
    )
    sizes = sizes.where("size > 1 and over = 0").select("c", "head", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    # the vocabulary grows with the corpus: never broadcast, at any size
    rows = rows.join(sizes.hint("merge"), ["c", "head", "key"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("c", "head", "key", "block", "word", "n", other)
    return rows.select(
        "c", "head", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "word", "n"
    )


class Index:
    """Bit-sliced position index of a tile's words: a bitset per letter, one position at a time."""

    def __init__(self, letters: np.ndarray):
        self.letters = letters  # [words, positions], 0 beyond a word's end
        self.alphabet = np.unique(letters)
        self.width = -(-len(letters) // 64) * 8

    def bits(self, mask: np.ndarray) -> np.ndarray:
        """[rows, words] truth values as bitsets of 64."""
        out = np.zeros((len(mask), self.width), np.uint8)
        packed = np.packbits(mask, axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
        return out.view(np.uint64)

    def at(self, position: int) -> np.ndarray:
        """[letters, bitset] of the words with each letter of the alphabet at a position."""
        return self.bits(self.letters[None, :, position] == self.alphabet[:, None])


def near_pairs(words: list[bytes], queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, other): all pairs of a word in `queries`, all of c letters, and a near word of c or c + 1 letters."""
    lengths = np.array([len(w) for w in words])
    c = int(lengths[queries[0]])
    letters = np.zeros((len(words), c + 1), np.uint8)
    for k, w in enumerate(words):
        letters[k, : len(w)] = np.frombuffer(w, np.uint8)
    index = Index(letters)
    same, longer = index.bits((lengths == c)[None]), index.bits((lengths == c + 1)[None])
    found: list[list[np.ndarray]] = [[], []]
    for a in range(0, len(queries), CHUNK):
        mine = queries[a : a + CHUNK]
        code = np.searchsorted(index.alphabet, letters[mine])
        zero = np.repeat(same | longer, len(mine), 0)
        replaced, more = np.zeros_like(zero), np.zeros_like(zero)
        here = index.at(0)
        for i in range(c):
            ahead = index.at(i + 1)
            bits, shifted = here[code[:, i]], ahead[code[:, i]]
            more = (more | zero) & shifted
            replaced = replaced & bits | zero & ~bits
            zero = zero & bits
            here = ahead
        hit = replaced & same | (more | zero) & longer
        q, other = np.nonzero(np.unpackbits(hit.view(np.uint8), axis=1, bitorder="little")[:, : len(words)])
        found[0].append(mine[q]), found[1].append(other)
    return np.concatenate(found[0]), np.concatenate(found[1])


def _numbered(values: pa.Array) -> np.ndarray:
    return values.dictionary_encode().indices.to_numpy()


def tile_counts(tile: pa.Table) -> pa.RecordBatch | None:
    """(word, n_near, best_n, best): the near words of each word of a tile, and the best of them."""
    c, head = tile.column("c")[0].as_py(), tile.column("head")[0].as_py()
    texts = tile.column("word").to_pylist()
    words = [t.encode("latin-1") for t in texts]
    queries = np.flatnonzero(np.array([len(w) for w in words]) == c)
    if not len(queries):
        return None
    a, b = near_pairs(words, queries)
    bucket = _numbered(tile.column("key").combine_chunks())
    keep = bucket[a] == bucket[b]
    i, j, block = (tile.column(x).to_numpy() for x in ("i", "j", "block"))
    keep &= (i[a] == j[a]) | (block[a] != block[b])  # those of one block meet in its own tile
    longer = np.array([len(w) for w in words])[b] > c
    keep &= longer | (a < b)
    if not head:
        heads = _numbered(pa.array([w[: c // 2] for w in words], pa.binary()))
        keep &= heads[a] != heads[b]
    a, b = a[keep], b[keep]
    if not len(a):
        return None
    n = tile.column("n").to_numpy()
    one, two = np.concatenate([a, b]), np.concatenate([b, a])
    rank = np.argsort(np.argsort(np.array(words, object)))  # bytes of Latin-1 sort like code points
    order = np.lexsort((rank[two], -n[two], one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
    best = two[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([texts[k] for k in one[first].tolist()], pa.string()),
            pa.array(np.diff(np.append(first, len(one))), pa.int64()),
            pa.array(n[best]),
            pa.array([texts[k] for k in best.tolist()], pa.string()),
        ],
        names=["word", "n_near", "best_n", "best"],
    )


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole buckets of one (c, head), up to about BLOCK words or TILE_BYTES; a pair of blocks is one by itself."""
    held: list[pa.RecordBatch] = []
    count, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("c", "head", "key", "i", "j")]
        new = np.zeros(batch.num_rows, bool)
        for x in columns:
            new[1:] |= x[1:] != x[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            name = tuple(x[a] for x in columns)
            if held and name != last:
                apart = name[:2] != last[:2] or name[4] > 0 or last[4] > 0
                if apart or count >= CHUNK or count * int(name[0]) >= TILE_BYTES:
                    yield pa.Table.from_batches(held)
                    held, count = [], 0
            held.append(batch.slice(a, b - a))
            count, last = count + b - a, name
    if held:
        yield pa.Table.from_batches(held)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles(batches):
            out = tile_counts(tile)
            if out is not None:
                yield out

    rows = bucketed(words).repartition(parts(words.sparkSession), "c", "head", "key", "i", "j")
    rows = rows.sortWithinPartitions("c", "head", "key", "i", "j")
    found = rows.mapInArrow(run, "word string, n_near long, best_n long, best string")
    first = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("first")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
    return found.select("word", "n_near", (-F.col("first.m")).alias("best_n"), F.col("first.best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the end, by pointer doubling."""
    up = stash(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up_next = stash(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots")
        if up_next.where("next is not null").limit(1).isEmpty():
            return up
        up = up_next.drop("next")


def variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    change: Change | None = None,
    shortest: int = SHORTEST,
    least: int = LEAST,
    ratio: int = RATIO,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary."""
    if ratio <= 1 or shortest < 1:
        raise ValueError("a form has more occurrences than its word, and a word has a letter")
    counted = count_words(docs, key, text, change)
    words = stash(counted.where((F.col("n") >= least) & (F.char_length("word") >= shortest)), "vocabulary")
    better = F.col("best_n") >= ratio * F.col("n")
    found = words.join(near_words(words), "word", "left").select(
        "word",
        F.when(better, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(better, F.col("best_n")).alias("form_n"),
    )
    found = stash(found, "near-words")
    roots = last_forms(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
