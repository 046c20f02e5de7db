"""Language identification by unigram pieces, marginalised over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability
of a word is the sum over all ways to write it in pieces, by the forward algorithm; a text's is the
product over its words. The prediction is the language with the largest probability, its score
the posterior under equal priors.

Training estimates the piece probabilities by expectation-maximisation on labelled texts: forward and
backward sums give each word's expected pieces in each round. It reads a hash sample of about
`per_language` texts for each label (a documented bound on labelled rows, nothing else is sampled).
The table that goes to all tasks has one row per piece and one column per language: vocabulary
times labels, whatever the corpus holds.

Words are lower-cased white-space runs of any length, written with a leading word mark; pieces of all
lengths of the vocabulary take part. A character outside the vocabulary is a piece of its own with a small fixed
probability. All words of a batch are scored at once, distinct words once. Words beyond LONGEST characters
go side by side, with a window of sums as long as the longest piece, rescaled on the way: time grows with
their characters, memory for scoring does not.

Defined cases: a text that is null or has no letter is `und` with score 0; without any training
text every text is `und`; ties go to the first language by name; repeated rows are scored alike;
an empty table gives an empty table; other columns are carried in one column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallysieve.llm.arrow import keeps
from tallysieve.llm.common import ROW, carried, parts, stash

MARK = "▁"
LONGEST = 32  # characters of a word, with its mark, whose sums need no rescaling
BLOCK, GROUP, BLANK = 1024, 1 << 17, 0xFFFFFFFF  # characters of long words looked up, and taken together; after their end
PER_LANGUAGE, ROUNDS = 3000, 4
SMOOTHING, OTHER = 0.1, 1e-8
UNKNOWN = "und"
LETTER = r"\p{L}"


@cache
def vocabulary(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(len(pieces))]
    return ["" if s else p for p, s in zip(pieces, special)]


@cache
def lattice(path: str):
    from tallysieve.llm.lattice import Lattice

    return Lattice(vocabulary(path))


keeps(__name__, lambda: (vocabulary.cache_clear(), lattice.cache_clear()))


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of all texts, the word number of each occurrence, and n + 1 offsets of the texts."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    flat = lists.flatten().dictionary_encode()
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return flat.dictionary, flat.indices.to_numpy(zero_copy_only=False), offsets


def by_kind(words: list[str]) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Words of up to LONGEST characters and longer ones, with the word mark, each with their numbers."""
    marked = [MARK + w for w in words]
    long = np.fromiter((len(w) > LONGEST for w in marked), bool, len(marked))
    short, wide = np.flatnonzero(~long), np.flatnonzero(long)
    return [marked[i] for i in short], short, [marked[i] for i in wide], wide


def by_length(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which texts, matrix of code points) for each length, in blocks."""
    from tallysieve.llm.lattice import codes_of, matrix

    codes, lengths = codes_of(texts)
    starts = np.cumsum(lengths) - lengths
    for n in np.unique(lengths):
        same = np.flatnonzero(lengths == n)
        for a in range(0, len(same), 20_000):
            which = same[a : a + 20_000]
            yield which, matrix(codes, lengths, which, starts, int(n))


def forward(edges: dict, n: int, rows: int, table: np.ndarray) -> list[np.ndarray]:
    """Sums over all segmentations of the first 0..n characters; table has a last row for no piece, which is 0."""
    total = [np.ones((rows, table.shape[1]))]
    for j in range(1, n + 1):
        now = np.zeros_like(total[0])
        for i in range(j):
            if (i, j) in edges:
                now += total[i] * _weight(edges[i, j], table, j - i == 1)
        total.append(now)
    return total


def _weight(piece: np.ndarray, table: np.ndarray, single: bool) -> np.ndarray:
    weight = table[piece]
    if single:
        weight = np.where((piece < 0)[:, None], OTHER, weight)
    return weight


def side_by_side(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their code points, BLANK after the end of each) for words of similar lengths, about GROUP characters at once."""
    from tallysieve.llm.lattice import codes_of

    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    while order:
        n = len(words[order[-1]])
        some = order[-max(1, GROUP // n) :]
        del order[-len(some) :]
        m = np.full((len(some), n), BLANK, np.uint32)
        for row, i in enumerate(some):
            m[row, : len(words[i])] = codes_of([words[i]])[0]
        yield np.array(some), m


def starting(m: np.ndarray, a: int, b: int, path: str) -> np.ndarray:
    """[length - 1, row, start - a]: the piece of each length at each start from a to b, -1 for none."""
    pieces, (rows, n) = lattice(path), m.shape
    out = np.full((pieces.longest, rows, b - a), -1, np.int32)
    h = np.zeros((rows, b - a), np.uint64)
    for k in range(min(pieces.longest, n - a)):
        width = min(b, n - k) - a
        h = pieces._step(h[:, :width], m[:, a + k : a + k + width])
        out[k, :, :width] = pieces.lookup(h.ravel()).reshape(h.shape)
    return out


def _weights(pieces: np.ndarray, codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """[length - 1, row, language]; a blank costs nothing, so that shorter words wait at their end."""
    weight = table[pieces]
    none = pieces[0] < 0
    if none.any():
        weight[0, none] = np.where(codes[none] == BLANK, 1.0, OTHER)[:, None]
    return weight


def long_forward(m: np.ndarray, table: np.ndarray, path: str, left: np.ndarray | None = None) -> np.ndarray:
    """[rows, languages] log sums over all segmentations; `left` takes those of the first 0..n characters for one language."""
    rows, n = m.shape
    ahead = np.zeros((lattice(path).longest, rows, table.shape[1]))  # sums so far of the next positions
    now, scale = np.ones(ahead.shape[1:]), np.zeros(ahead.shape[1:])
    for a in range(0, n, BLOCK):
        pieces = starting(m, a, min(n, a + BLOCK), path)
        for c in range(pieces.shape[2]):
            if left is not None:
                left[:, a + c] = np.log(now[:, 0]) + scale[:, 0]
            ahead += now * _weights(pieces[:, :, c], m[:, a + c], table)
            now = ahead[0].copy()
            ahead[:-1] = ahead[1:]
            ahead[-1] = 0
            if c % 8 == 7:
                top = np.maximum(now, ahead.max(0))
                now, scale = now / top, scale + np.log(top)
                ahead /= top
    out = np.log(now) + scale
    if left is not None:
        left[:, n] = out[:, 0]
    return out


def long_expected(m: np.ndarray, counts: np.ndarray, table: np.ndarray, path: str) -> np.ndarray:
    """As expected_pieces, for long words side by side."""
    (rows, n), longest = m.shape, lattice(path).longest
    out = np.zeros(len(table))
    left, right = np.empty((rows, n + 1)), np.full((rows, n + longest), -np.inf)
    whole = long_forward(m, table, path, left)[:, 0]
    right[:, n] = 0
    behind, scale = np.zeros((longest, rows)), np.zeros(rows)
    behind[0] = 1
    with np.errstate(divide="ignore"):
        logs = np.log(table[:, 0])
    for a in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        b = min(n, a + BLOCK)
        pieces = starting(m, a, b, path)
        for c in range(b - a - 1, -1, -1):
            now = (behind * _weights(pieces[:, :, c], m[:, a + c], table)[:, :, 0]).sum(0)
            right[:, a + c] = np.log(now) + scale
            behind[1:] = behind[:-1]
            behind[0] = now
            if c % 8 == 0:
                top = behind.max(0)
                behind, scale = behind / top, scale + np.log(top)
        for k in range(longest):
            share = left[:, a:b] + logs[pieces[k]] + right[:, a + k + 1 : b + k + 1] - whole[:, None]
            found = pieces[k] >= 0
            out += np.bincount(pieces[k][found], (np.exp(share) * counts[:, None])[found], len(out))
    return out


def word_scores(words: list[str], table: np.ndarray, path: str) -> np.ndarray:
    """[words, languages] log probabilities."""
    short, at, wide, long_at = by_kind(words)
    out = np.zeros((len(words), table.shape[1]))
    for which, m in by_length(short):
        n = m.shape[1]
        total = forward(lattice(path).edges(m), n, len(m), table)[n]
        out[at[which]] = np.log(np.maximum(total, 1e-300))
    for which, m in side_by_side(wide):
        out[long_at[which]] = long_forward(m, table, path)
    return out


def expected_pieces(words: list[str], counts: np.ndarray, table: np.ndarray, path: str) -> np.ndarray:
    """Expected number of each piece in words of one language with the given counts; `table` has one column."""
    short, at, wide, long_at = by_kind(words)
    out = np.zeros(len(table))
    for which, m in by_length(short):
        n, rows = m.shape[1], len(m)
        edges = lattice(path).edges(m)
        left = forward(edges, n, rows, table)
        right = [None] * n + [np.ones((rows, 1))]
        for i in range(n - 1, -1, -1):
            right[i] = sum(right[j] * _weight(edges[i, j], table, j - i == 1) for j in range(i + 1, n + 1) if (i, j) in edges)
        scale = counts[at[which]] / np.maximum(left[n][:, 0], 1e-300)
        for (i, j), piece in edges.items():
            share = left[i][:, 0] * table[piece, 0] * right[j][:, 0] * scale
            out += np.bincount(piece + 1, share, len(out) + 1)[1:]
    for which, m in side_by_side(wide):
        out += long_expected(m, counts[long_at[which]], table, path)
    return out


class Model:
    """Languages in order of name, and their piece probabilities [pieces + 1, languages]; the last row is 0."""

    def __init__(self, languages: list[str], table: np.ndarray, path: str):
        self.languages, self.table, self.path = languages, table, path


def train(
    labelled: DataFrame, path: str, text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE, rounds: int = ROUNDS
) -> Model:
    """Fit on labelled texts; `per_language` bounds the texts of one label that are read, on average."""
    rows = labelled.select(labelled[text].cast("string").alias("t"), labelled[label].cast("string").alias("l"))
    rows = rows.where("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    size = len(vocabulary(path))
    if not languages:
        return Model([], np.zeros((size + 1, 0)), path)
    share = F.create_map(*[F.lit(x) for l in languages for x in (l, min(1.0, per_language / sizes[l]))])
    chance = F.pmod(F.xxhash64("t", "l"), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(chance < share[F.col("l")])
    words = sample.select("l", F.explode(F.split(F.lower("t"), r"\s+")).alias("w")).where("w <> ''")
    words = stash(words.groupBy("l", "w").agg(F.count(F.lit(1)).alias("n")).repartition(parts(labelled.sparkSession)), "words")
    table = np.zeros((size + 1, len(languages)))
    for i, piece in enumerate(vocabulary(path)):
        table[i] = len(piece) > 0
    usable = table[:, :1].copy()
    table /= table.sum(0)
    for _ in range(rounds):
        found = expected(words, languages, table, path).toArrow()  # pieces times languages rows at most
        counts = np.zeros_like(table)
        of = pc.index_in(found.column("l"), pa.array(languages)).to_numpy()
        counts[found.column("piece").to_numpy(), of] = found.column("n").to_numpy()
        counts = (counts + SMOOTHING) * usable
        table = counts / counts.sum(0)
    return Model(languages, table, path)


def expected(words: DataFrame, languages: list[str], table: np.ndarray, path: str) -> DataFrame:
    """(l, piece, n): expected pieces per language, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(table) - 1, len(languages)))
        for batch in batches:
            labels, texts, counts = (batch.column(c) for c in ("l", "w", "n"))
            for k, language in enumerate(languages):
                mine = pc.equal(labels, language)
                some = texts.filter(mine).to_pylist()
                if some:
                    n = counts.filter(mine).to_numpy().astype(float)
                    total[:, k] += expected_pieces(some, n, table[:, k : k + 1], path)[:-1]
        for k, language in enumerate(languages):
            at = np.flatnonzero(total[:, k])
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at, k])],
                    names=["l", "piece", "n"],
                )

    partial = words.mapInArrow(run, "l string, piece int, n double")
    return partial.groupBy("l", "piece").agg(F.sum("n").alias("n"))


def identify(docs: DataFrame, model: Model, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """(__row, lang_pred, score) for every row."""
    columns = list(docs.columns if carry is None else carry)
    # a text that is carried on travels once, beside the other columns
    whole = text in columns and docs.schema[text].dataType == T.StringType()
    others = [c for c in columns if c != text] if whole else columns
    source = docs[text].cast("string")
    base = docs.select(carried(docs, others), source.alias("t"), F.coalesce(source.rlike(LETTER), F.lit(False)).alias("letters"))
    schema = base.select(ROW, "t", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    languages, table, path = model.languages, model.table, model.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import WIDE, make_room, slices

        make_room(__name__)
        names = np.array([*languages, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, size=WIDE):
                n = part.num_rows
                missing = ~part.column("letters").to_numpy(zero_copy_only=False)
                best, score = np.full(n, len(languages)), np.zeros(n)
                if languages:
                    words, at, offsets = words_in(part.column("t"))
                    scores = word_scores(words.to_pylist(), table, path)
                    owner = np.repeat(np.arange(n), np.diff(offsets))
                    sums = np.stack([np.bincount(owner, scores[at, k], n) for k in range(len(languages))], 1)
                    best = np.where(missing, len(languages), sums.argmax(1))
                    score = 1 / np.exp(sums - sums.max(1)[:, None]).sum(1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(ROW), part.column("t") if whole else pa.nulls(n, pa.string()), pa.array(names[best], pa.string()), pa.array(np.where(missing, 0.0, score), pa.float64())],
                    names=schema.names,
                )

    row = F.struct(*[(F.col("t") if whole and c == text else F.col(f"{ROW}.`{c}`")).alias(c) for c in columns]).alias(ROW)
    return base.mapInArrow(run, schema).select(row, "lang_pred", "score")


def held_out(key: Column) -> Column:
    """The fifth of the documents that training never sees."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def identify_fold(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", label: str = "lang", carry: Sequence[str] | None = None
) -> DataFrame:
    """Train on the rows that are not held out, then predict all rows."""
    rows = docs.where(~held_out(docs[key]) & docs[label].isNotNull())
    return identify(docs, train(rows, path, text, label), text, carry)
