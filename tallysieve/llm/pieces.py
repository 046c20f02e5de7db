"""Encoding into pieces with the best total score, and decoding, over a fixed public vocabulary.

A text is written with a mark for each space and one in front, then cut into pieces so that the sum
of the vocabulary's scores is largest (the unigram rule; where sums tie, the piece that ends
later in the text is the longer one). A character that is no piece costs UNKNOWN_GAP below the lowest
ordinary score and is given as its UTF-8 bytes. The public file's scores are merge ranks of its own trainer;
here they are taken as the pieces' scores, so ids differ from that trainer's merges by design.

Giant texts: max-plus parallel scan. Chunks of CHUNK characters are solved side by side. The state at a
chunk's border is how many characters a piece reaches across it, 0 to 15; a chunk gives the matrix of best
scores from each entry to each exit state. Matrices combine associatively (max-plus product), a
doubling scan gives every chunk its entry vector, and with it each chunk is backtraced by itself.
Texts beyond SEGMENT characters are taken segment by segment, forward for the vectors, backward for
the pieces, so that memory is bounded by a segment.

Other texts: no piece holds a mark after something else (checked), so words don't depend on each other;
distinct words of a batch are solved once, all words of one length side by side. Both ways give the same ids.

Defined cases: null and empty texts have no ids; the mark itself in a text means a space and decodes as one;
repeated rows are encoded alike; an empty table gives an empty table; other columns are carried in one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.arrow import keeps
from tallysieve.llm.common import ROW, carried

MARK = "▁"
GIANT, SEGMENT, CHUNK = 65_536, 1 << 18, 256
LONG_WORD = 48
UNKNOWN_GAP = 10.0
SLICE_BYTES = 4 << 20
NEVER = -np.inf


class Pieces:
    """A vocabulary: piece lookup, scores and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        from tallysieve.llm.lattice import Lattice

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for i in range(size)]
        self.lattice = Lattice([n if p else "" for n, p in zip(names, plain)])
        self.longest = self.lattice.longest
        scores = np.array([model.get_score(i) for i in range(size)])
        ordinary = scores[np.array(plain) & (scores > -1e8)]
        self.unknown = float(ordinary.min()) - UNKNOWN_GAP
        self.scores = np.append(scores, NEVER)  # the last one for no piece
        self.byte_id = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.apart = all(MARK not in n.lstrip(MARK) for n, p in zip(names, plain) if p)
        bodies = [n.replace(MARK, " ").encode() if p else b"" for n, p in zip(names, plain)]
        for value, i in self.byte_id.items():
            bodies[i] = bytes([value])
        self.lengths = np.array([len(b) for b in bodies])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.body = np.frombuffer(b"".join(bodies), np.uint8)

    # one text by chunks -----------------------------------------------------------------

    def _ending(self, codes: np.ndarray, n: int) -> np.ndarray:
        """[longest, n] piece that starts at each of the first n places, by length - 1; -1 for none."""
        out = np.full((self.longest, n), -1, np.int32)
        h = np.zeros(n, np.uint64)
        for k in range(self.longest):
            m = min(n, len(codes) - k)
            if m <= 0:
                break
            h = self.lattice._step(h[:m], codes[k : k + m])
            out[k, :m] = self.lattice.lookup(h)
        return out

    def _scores(self, starting: np.ndarray, n: int) -> np.ndarray:
        """[chunks, CHUNK, longest] score of each piece by its start; padding places are free single steps."""
        s = self.scores[starting]
        s[0][starting[0] < 0] = self.unknown
        chunks = -(-n // CHUNK)
        out = np.full((chunks * CHUNK, self.longest), NEVER)
        out[:n] = s.T
        out[n:, 0] = 0.0
        return out.reshape(chunks, CHUNK, self.longest)

    def _arrivals(self, s: np.ndarray) -> np.ndarray:
        """[chunks, place, longest] score of the piece of each length that ends at a place, longest first."""
        out = np.full((len(s), CHUNK + self.longest, self.longest), NEVER)
        for k in range(1, self.longest + 1):
            out[:, k : k + CHUNK, self.longest - k] = s[:, :, k - 1]
        return out

    def matrices(self, s: np.ndarray) -> np.ndarray:
        """[chunks, entry, exit] best score through each chunk."""
        w = self.longest
        best = np.full((len(s), w, CHUNK + 2 * w), NEVER)  # place j is kept at w + j
        arrivals = self._arrivals(s)
        for j in range(CHUNK + w):
            now = (best[:, :, j : j + w] + arrivals[:, None, j]).max(2)
            if j < w:
                now[:, j] = 0.0
            best[:, :, w + j] = now
        return best[:, :, w + CHUNK : w + CHUNK + w]

    @staticmethod
    def prefixes(m: np.ndarray) -> np.ndarray:
        """Max-plus products of the first 1, 2, ... matrices, by doubling."""
        out, step = m.copy(), 1
        while step < len(out):
            done = out.copy()
            for a in range(step, len(out), 256):
                b = min(a + 256, len(out))
                done[a:b] = (out[a - step : b - step][:, :, :, None] + out[a:b][:, None, :, :]).max(2)
            out, step = done, 2 * step
        return out

    def _entries(self, s: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """[chunks + 1, states] best score of arriving at each state of each chunk."""
        through = (entry[None, :, None] + self.prefixes(self.matrices(s))).max(1)
        return np.concatenate([entry[None], through])

    def _back(self, s: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """[chunks, place] length of the last piece at each place; 0 where it came across the border."""
        w = self.longest
        best = np.full((len(s), CHUNK + 2 * w), NEVER)
        back = np.zeros((len(s), CHUNK + w), np.int64)
        arrivals = self._arrivals(s)
        for j in range(CHUNK + w):
            options = best[:, j : j + w] + arrivals[:, j]
            pick = options.argmax(1)  # the longest of equal ones
            now = options[np.arange(len(s)), pick]
            back[:, j] = w - pick
            if j < w:  # a piece from before is longer than any from here
                across = entries[:, j] >= now
                now = np.where(across, entries[:, j], now)
                back[across, j] = 0
            best[:, w + j] = now
        return back

    def _segment(self, codes: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        n = min(SEGMENT, len(codes) - at)
        starting = self._ending(codes[at : at + n + self.longest], n)
        return starting, self._scores(starting, n)

    def scan(self, text: str) -> np.ndarray:
        """Ids of one text by the parallel scan."""
        if not text:
            return np.zeros(0, np.uint32)
        codes = np.frombuffer((MARK + text.replace(" ", MARK)).encode("utf-32-le"), np.uint32)
        entry = np.full(self.longest, NEVER)
        entry[0] = 0.0
        begins = range(0, len(codes), SEGMENT)
        vectors = []
        for at in begins:
            vectors.append(entry)
            if at + SEGMENT < len(codes):
                entry = self._entries(self._segment(codes, at)[1], entry)[-1]
        out, leave = [], 0
        for at, entry in zip(reversed(begins), reversed(vectors)):
            starting, s = self._segment(codes, at)
            back = self._back(s, self._entries(s, entry)[:-1])
            chunks = len(back)
            # entry state for each exit state of each chunk, all side by side
            place = np.tile(CHUNK + np.arange(self.longest), (chunks, 1))
            row = np.arange(chunks)
            while (step := back[row[:, None], place]).any():
                place = place - step
            exits = np.zeros(chunks, np.int64)
            for c in range(chunks - 1, -1, -1):
                exits[c] = leave
                leave = place[c, leave]
            now, found = CHUNK + exits, []
            while (step := back[row, now]).any():
                live = step > 0
                now = now - step
                found.append((row[live] * CHUNK + now[live], step[live]))
            begin = np.concatenate([b for b, _ in found])
            length = np.concatenate([k for _, k in found])
            order = np.argsort(begin)
            begin, length = begin[order], length[order]
            real = begin < starting.shape[1]
            out.append(self._ids(codes[at:], begin[real], starting[length[real] - 1, begin[real]]))
        return np.concatenate(out[::-1])

    def _ids(self, codes: np.ndarray, begin: np.ndarray, piece: np.ndarray) -> np.ndarray:
        unknown = np.flatnonzero(piece < 0)
        if not len(unknown):
            return piece.astype(np.uint32)
        parts, left = [], 0
        for u in unknown.tolist():
            parts.append(piece[left:u])
            parts.append(np.array([self.byte_id[b] for b in chr(codes[begin[u]]).encode()], np.int32))
            left = u + 1
        return np.concatenate([*parts, piece[left:]]).astype(np.uint32)

    # many short words ---------------------------------------------------------------------

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each)."""
        from tallysieve.llm.lattice import codes_of, matrix

        found: list = [None] * len(words)
        codes, lengths = codes_of([MARK + w for w in words])
        starts = np.cumsum(lengths) - lengths
        for n in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == n)
            if n > LONG_WORD:
                for i in same.tolist():
                    found[i] = self.scan(words[i])
                continue
            for a in range(0, len(same), 20_000):
                which = same[a : a + 20_000]
                m = matrix(codes, lengths, which, starts, n)
                for i, ids in zip(which.tolist(), self._solve(m)):
                    found[i] = ids
        return np.concatenate([*found, np.zeros(0, np.uint32)]).astype(np.uint32), np.array([len(f) for f in found], np.int64)

    def _solve(self, m: np.ndarray) -> list[np.ndarray]:
        rows, n = m.shape
        edges = self.lattice.edges(m)
        best, back, last = [np.zeros(rows)], [None], [None]
        for j in range(1, n + 1):
            top, length, piece = np.full(rows, NEVER), np.zeros(rows, np.int64), np.full(rows, -1, np.int32)
            for i in range(max(0, j - self.longest), j):
                score = self.scores[edges[i, j]]
                if j - i == 1:
                    score = np.where(edges[i, j] < 0, self.unknown, score)
                value = best[i] + score
                better = value > top  # longer pieces come first and keep a tie
                top = np.where(better, value, top)
                length[better] = j - i
                piece = np.where(better, edges[i, j], piece)
            best.append(top), back.append(length), last.append(piece)
        lengths, pieces = np.stack(back[1:], 1), np.stack(last[1:], 1)
        place, row = np.full(rows, n), np.arange(rows)
        begins, ids = [], []
        while (place > 0).any():
            live = place > 0
            at = np.maximum(place - 1, 0)
            ids.append(np.where(live, pieces[row, at], -2))
            place = np.where(live, place - lengths[row, at], 0)
            begins.append(place)
        ids, begins = np.stack(ids[::-1], 1), np.stack(begins[::-1], 1)
        plain = ~(ids == -1).any(1)
        used = ids != -2
        ends = np.cumsum(used.sum(1))
        flat, flat_begin = ids[used], begins[used]
        out = []
        for r, (a, b) in enumerate(zip((ends - used.sum(1)).tolist(), ends.tolist())):
            out.append(flat[a:b].astype(np.uint32) if plain[r] else self._ids(m[r], flat_begin[a:b], flat[a:b]))
        return out

    # texts ----------------------------------------------------------------------------------

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = [t.replace(MARK, " ") for t in texts]
        simple = [
            self.apart and 0 < len(t) <= GIANT and "  " not in t and t[0] != " " and t[-1] != " " for t in texts
        ]
        words = pa.array([t for t, s in zip(texts, simple) if s], pa.large_string())
        lists = pc.split_pattern(words, " ")
        flat = lists.flatten().dictionary_encode()
        ids, sizes = self.words(flat.dictionary.to_pylist())
        offsets = np.cumsum(sizes) - sizes
        at = flat.indices.to_numpy(zero_copy_only=False)
        size = sizes[at]
        ends = np.cumsum(size)
        places = np.repeat(offsets[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        data = ids[places].astype("<u4").tobytes()
        stops = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))] * 4
        stop, left, out = iter(stops.tolist()), 0, []
        for t, s in zip(texts, simple):
            if s:
                right = next(stop)
                out.append(data[left:right])
                left = right
            else:
                out.append(self.scan(t).astype("<u4").tobytes())
        return out

    def decode(self, ids: np.ndarray) -> str:
        size = self.lengths[ids]
        ends = np.cumsum(size)
        places = np.repeat(self.offsets[ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.body[places].tobytes()[1:].decode(errors="replace")


_loaded: dict[str, Pieces] = {}
keeps(__name__, _loaded.clear)


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(
    docs: DataFrame, path: str, text: str = "text", carry: Sequence[str] | None = None, verify: bool = False
) -> DataFrame:
    """(__row, token_bytes): ids as little-endian unsigned 32-bit integers.

    With `verify` also `exact`: whether the ids decode to the text again (the mark as a space), found in the
    same task, so that texts don't travel through a second one.
    """
    base = docs.select(carried(docs, carry), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    more = [F.lit(True).alias("exact")] if verify else []
    schema = base.select(ROW, F.lit(b"").alias("token_bytes"), *more).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tallysieve.llm.arrow import make_room, slices

        make_room(__name__)
        for batch in batches:
            for part in slices(batch, size=SLICE_BYTES):
                texts = part.column("t").to_pylist()
                found = pieces(path).encode(texts)
                columns = [part.column(ROW), pa.array(found, pa.binary())]
                if verify:
                    back = (pieces(path).decode(np.frombuffer(b, "<u4")) for b in found)
                    columns.append(pa.array([x == t.replace(MARK, " ") for x, t in zip(back, texts)]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The encoded rows with `decoded`, the text that the ids stand for."""
    schema = encoded.select("*", F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = (np.frombuffer(b.as_buffer(), "<u4") for b in batch.column("token_bytes"))
            found = pa.array([pieces(path).decode(i) for i in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

    return encoded.mapInArrow(run, schema)
