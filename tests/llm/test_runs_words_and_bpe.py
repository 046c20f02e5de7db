"""Periodic runs, spelling variants and byte-level BPE against brute force, on given documents and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from tallysieve.llm import arrow, bpe, queries, runs, variants
from tallysieve.llm.common import ROW

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "doc_id long, text string, id long, t string, __row string, word string, n long, runs int"


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, texts):
    rows = [(i, t, 7, "odd", "r", "w", 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASHING).repartition(3)


# periodic runs ---------------------------------------------------------------------------------


def plain_runs(words, shortest=2):
    """All (start, length, period), by trying every period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            smaller = any(all(words[k] == words[k + p] for k in range(start, end - p)) for p in range(1, q))
            if end - start >= max(shortest, 2 * q) and not smaller:
                out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, found):
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def repetitive(draw, limit):
    """Words as numbers, with runs in runs."""
    n, kind = draw.randint(0, limit), draw.randrange(6)
    if kind == 0:
        letters = draw.choice([2, 3, 30])
        return [draw.randrange(letters) for _ in range(n)]
    if kind == 1:  # Fibonacci words
        a, b = [1], [1, 0]
        while len(b) < n:
            a, b = b, b + a
        return b
    if kind == 2:  # squares of a periodic word: no position is selected in them
        u = [0, 1] * draw.randint(1, 40) + [0]
        return u + u + [draw.randrange(2) for _ in range(draw.randint(0, 10))]
    if kind == 3:  # runs of runs
        base = [draw.randrange(3) for _ in range(draw.randint(1, 4))]
        u = base * draw.randint(1, 14) + base[: draw.randrange(len(base) + 1)] + [draw.randrange(3)] * draw.randrange(2)
        return (u * draw.randint(1, 4))[: 2 * limit]
    if kind == 4:  # Thue-Morse
        return [bin(i).count("1") % 2 for i in range(n)]
    u = [draw.randrange(50) for _ in range(draw.randint(1, max(1, limit // 4)))]
    return [7] * 3 + u * 3 + u[:5]


@pytest.mark.parametrize("limit, rounds", [(40, 60), (160, 40), (600, 8)])
def test_all_runs_are_found(limit, rounds):
    draw = random.Random(limit)
    for _ in range(rounds):
        texts = [repetitive(draw, limit) for _ in range(6)]
        offsets = np.cumsum([0, *map(len, texts)])
        flat = arrow.mix(np.array([w for t in texts for w in t], np.uint64) + np.uint64(9))
        found = defaultdict(list)
        for start, end, period in runs.search(flat, offsets).tolist():
            k = int(np.searchsorted(offsets, start, side="right")) - 1
            found[k].append((start - int(offsets[k]), end - start, period))
        for k, text in enumerate(texts):
            assert sorted(found[k], key=lambda r: (r[0], r[2])) == plain_runs(text), text


def test_long_period_in_a_long_text():
    draw = random.Random(3)
    period = [draw.randrange(1000) for _ in range(9001)]
    words = [-1, -2] + period * 3 + period[:17] + [-3]
    flat = arrow.mix(np.array(words, np.int64).view(np.uint64))
    found = [r for r in runs.search(flat, np.array([0, len(words)])).tolist() if r[1] - r[0] >= 12]
    assert found == [[2, 2 + 3 * 9001 + 17, 9001]]


def planted(i, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    return words


def digests(words):
    found = plain_runs(words, 12)
    top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (
        len(found), *top, top[1] and 1000 * top[1] // top[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(words, found).encode()).hexdigest(),
    )


def test_query_on_given_documents(spark, sf):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_periodic_runs(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    tried = 0
    for r in rows:
        words = planted(r["doc_id"], texts[r["doc_id"]])
        if len(words) < 700:
            tried += 1
            assert tuple(r)[1:] == digests(words)
    assert tried > 100


def test_odd_rows(spark):
    words = "a b c d e f g".split()
    texts = [None, "", " \t\n", "one", "x " * 300, " ".join(words * 4), "\x0b".join(words * 2), " ".join(words * 4), "é" * 9]
    rows = {r[ROW]["doc_id"]: r for r in runs.periodic_runs(frame(spark, texts)).collect()}
    assert len(rows) == len(texts) and rows[3][ROW]["runs"] == 2
    for i, text in enumerate(texts):
        mine = WORD.findall(text or "")
        found = plain_runs(mine, 12)
        assert [tuple(r) for r in rows[i]["runs"]] == found
        assert (rows[i]["n_words"], rows[i]["collapsed"]) == (len(mine), collapse(mine, found))
    assert runs.periodic_runs(frame(spark, texts).limit(0)).count() == 0


# spelling variants --------------------------------------------------------------------------------


def edits(word, letters):
    for k in range(len(word) + 1):
        yield from (word[:k] + x + word[k:] for x in letters)
        if k < len(word):
            yield word[:k] + word[k + 1 :]
            yield from (word[:k] + x + word[k + 1 :] for x in letters)


def plain_variants(texts, planted=True, shortest=5, least=3, ratio=2):
    counts = Counter()
    for i, text in texts:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), word)
            h = zlib.crc32(f"{i}:{word}".encode())
            if planted and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    letters = sorted({x for w in counts for x in w})
    near = {w: {e for e in edits(w, letters) if e in counts and e != w} for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= ratio * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), form[w] and counts[form[w]]))
    return out


def test_variants_of_given_documents(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = queries.op12_spelling_variants(spark, sf).collect()
    assert len(rows) == len(set(rows)) and set(map(tuple, rows)) == plain_variants(texts)


@pytest.mark.parametrize("block, shortest", [(4, 2), (64, 1), (2048, 5)])
def test_variants_of_crowded_words(spark, monkeypatch, block, shortest):
    monkeypatch.setattr(variants, "BLOCK", block)
    draw = random.Random(block)
    words = ["".join(draw.choice("abÀ÷ÿ") for _ in range(draw.randint(1, 7))) for _ in range(700)] + ["Abc" * 90, "aBC" * 90 + "d"]
    texts = [None, "", "12 34", *(" ".join(draw.choices(words, k=60)) for _ in range(80)), ("Abc" * 90 + ",") * 4, "abc" * 90 + "d;" + ("abc" * 90 + "d ") * 2]
    rows = variants.variants(frame(spark, texts), shortest=shortest, least=2).collect()
    assert set(map(tuple, rows)) == plain_variants(enumerate(texts), False, shortest, 2) and len(rows) == len(set(rows))


def test_variants_of_repeated_rows_and_none(spark):
    texts = ["hello hello hallo"] * 3
    docs = frame(spark, texts).unionByName(frame(spark, texts).withColumn("doc_id", F.lit(None).cast("long")))
    rows = sorted(map(tuple, variants.variants(docs).collect()))
    assert rows == [("hallo", "hello", "hello", 6, 1, 12), ("hello", None, "hello", 12, 1, None)]
    assert variants.variants(docs.limit(0)).count() == 0


# byte-level BPE -----------------------------------------------------------------------------------

ODD = [
    "", " ", "\n", "  ", " a", "a ", "a  b", "a \n b", "\t\tx", "don't", "don'tx", "'s", " 's", "''s", "x''ll", "I'll've", "'re'", "'r", "'", "' s",
    "naïve café 12½ Ⅷ ٣٤", "中文 テスト한국어", "🙂🙂 👩‍👩‍👧", " x  y　", "\x1c\x1d\x85z", "<|endoftext|>", "aaaa" * 9, "=" * 70, " " * 40 + "x", "éa̧",
]


def test_cuts_are_those_of_the_pattern():
    draw = random.Random(1)
    pieces = ["'", " ", "  ", "s", "t", "re", "ll", "d", "\n", " ", "é", "7", "½", "!", "中", "🙂", "ve", "'m"]
    texts = ODD + ["".join(draw.choices(pieces, k=draw.randint(0, 30))) for _ in range(3000)]
    places, edges = bpe.pre_tokens(texts)
    data = "".join(texts).encode()
    assert bpe.PATTERN == public_tokenizers.PATTERN
    for text, a, b in zip(texts, edges.tolist(), edges[1:].tolist()):
        assert [data[x:y].decode() for x, y in zip(places[a:b].tolist(), places[a + 1 : b + 1].tolist())] == regex.findall(bpe.PATTERN, text)


def test_classes_of_all_characters(library):
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)} x" for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    ids, edges = bpe.ranks(RANKS).many(texts)
    for text, a, b in zip(texts, edges.tolist(), edges[1:].tolist()):
        assert ids[a:b].tolist() == library.encode_ordinary(text)


def test_merges_of_long_pre_tokens(library):
    draw = random.Random(2)
    ranks = bpe.ranks(RANKS)
    for letters in ("a", "ab", "aab=", "etaoin", "äöü€", "=-"):
        for n in (1, 2, 3, 17, 300, 5000):
            token = "".join(draw.choice(letters) for _ in range(n))
            for t in regex.findall(bpe.PATTERN, token):
                assert ranks.ids([t.encode()])[0].tolist() == library.encode_ordinary(t)
    long = ["".join(draw.choice("abcdefgh") for _ in range(300_000)).encode(), b"a" * 200_001]
    ids, sizes = ranks.ids(long)
    assert ranks.text(ids[: sizes[0]]) == long[0] and ranks.text(ids[sizes[0] :]) == long[1]


def test_lower_rank_opened_by_a_merge():
    """A token of three bytes below its own first two: the rest of a bucket waits."""
    tokens = [b"a", b"b", b"aba", b"ab", b"abab"]
    ranks = bpe.Ranks(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    plain = tiktoken.Encoding("t", pat_str=".+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={}, explicit_n_vocab=None)
    texts = ["abab", "ababab", "aabababba", "abba", "ababababab"]
    ids, sizes = ranks.ids([t.encode() for t in texts])
    assert ranks.early and np.split(ids, np.cumsum(sizes))[:-1] != [] and ids.tolist() == [i for t in texts for i in plain.encode_ordinary(t)]


def test_merge_order_in_random_vocabularies():
    draw = random.Random(8)
    for _ in range(60):
        tokens = {b"a", b"b", b"c"}
        while len(tokens) < 30:
            tokens.add(bytes(draw.choice(b"abc") for _ in range(draw.randint(2, 5))))
        tokens = [b"a", b"b", b"c", *draw.sample(sorted(tokens - {b"a", b"b", b"c"}), len(tokens) - 3)]
        ranks = bpe.Ranks(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
        plain = tiktoken.Encoding("t", pat_str=".+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        texts = ["".join(draw.choice("aabc") for _ in range(draw.randint(1, 40))) for _ in range(40)]
        ids, sizes = ranks.ids([t.encode() for t in texts])
        for text, mine in zip(texts, np.split(ids, np.cumsum(sizes))):
            assert mine.tolist() == plain.encode_ordinary(text)


def test_bpe_query(spark, sf, library):
    texts = {r[0]: r[1] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op13_byte_bpe(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        ids = np.array(library.encode_ordinary(text), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_odd_rows(spark, library):
    texts = [None, *ODD, *ODD[:3], "word " * 20_000]
    rows = {r[ROW]["doc_id"]: r for r in bpe.encode(frame(spark, texts), RANKS).collect()}
    for i, text in enumerate(texts):
        assert np.frombuffer(rows[i]["token_bytes"], "<u4").tolist() == library.encode_ordinary(text or "")
    assert rows[0][ROW]["word"] == "w"
    encoded = bpe.encode(frame(spark, texts), RANKS, carry=["doc_id", "text"]).select(f"{ROW}.*", "token_bytes")
    assert all(bytes(r["data"]).decode() == (r[ROW]["text"] or "") for r in bpe.decode(encoded, RANKS).collect())
    assert bpe.decode(bpe.encode(frame(spark, texts).limit(0), RANKS), RANKS).count() == 0
