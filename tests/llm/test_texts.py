"""Operators on texts against brute force, on given documents and on odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallysieve.llm import arrow, language, licences, near, packing, pieces, quality, queries, repeats, tokens
from tallysieve.llm.common import ROW

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, id long, __row string, words int"


def varied(seed=5):
    """Nulls, empty and blank texts, ties, repeated rows, near copies, a long text, columns that clash."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7))) for _ in range(400)]
    base = [draw.choice(vocabulary) for _ in range(140)]
    texts = [None, "", " \t\n", "one", "Two words", "two WORDS", "a b c", "x " * 300, " ".join(base), " ".join(base)]
    for k in range(25):
        copy = list(base)
        for _ in range(k // 3):
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        texts.append("  ".join(copy) if k % 5 == 0 else " ".join(copy))
    for _ in range(15):
        own = [draw.choice(vocabulary) for _ in range(draw.randint(0, 200))]
        texts.append(" ".join(own[:50] + base[20:85] + own[50:]) + "\n")
    texts.append(" ".join(draw.choice(vocabulary) for _ in range(30_000)))
    texts.append(texts[-1][:60_000] + " tail")
    rows = [(i, t, draw.choice(["en", "de", None]), "s", None, "odd", 7, "r", 1) for i, t in enumerate(texts)]
    return rows + [rows[8]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(varied(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows):
    return {r[0]: r[1] or "" for r in rows}


def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(sets, percent):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_word_positions_and_hashes():
    import pyarrow as pa

    texts = ["", None, " a  bb\tccc\n", "é x", "end", "\x0bq"]
    data, offsets = arrow.bytes_of(pa.array(texts))
    starts, ends, first = arrow.words_of(data, offsets)
    found = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert found == ["a", "bb", "ccc", "é", "x", "end", "q"]
    assert first.tolist() == [0, 0, 0, 3, 5, 6, 7]
    h = arrow.hash_words(data, starts, ends)
    assert len(set(h.tolist())) == 7
    again = arrow.hash_words(*(lambda d: (d, np.array([0, 2]), np.array([1, 4])))(np.frombuffer(b"q bb", np.uint8)))
    assert again[0] == h[6] and again[1] == h[1]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, docs, k):
    got = {(r["id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(docs, words=k).collect()}
    sets = {i: shingles(t, k) for i, t in texts_of(varied()).items()}
    root = components(sets, 80)
    assert got == {(i, len(sets[i]), root[i], root[i] == i) for i in sets}
    kept = near.keep_one(docs, words=k)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in sets if root[i] == i}


def test_near_duplicates_of_given_documents(spark, sf):
    rows = small(spark, sf)
    got = {r["doc_id"]: r["component_id"] for r in queries.op3_minhash_near_dedup(spark, sf).collect()}
    assert got == components({r["doc_id"]: shingles(r["text"], 4) for r in rows.collect()}, 80)


def test_tiles_of_a_large_bucket_lose_no_link(spark, docs, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 3)
    got = {r["id"]: r["component_id"] for r in near.near_duplicates(docs, words=4).collect()}
    assert got == components({i: shingles(t, 4) for i, t in texts_of(varied()).items()}, 80)


def test_odd_sketch_estimates_high_similarity():
    draw = np.random.default_rng(0)
    for share in (0.95, 0.8, 0.6):
        shared = draw.integers(0, 1 << 63, int(2000 * share), np.uint64)
        rest = draw.integers(0, 1 << 63, (2, (2000 - len(shared)) // 2), np.uint64)
        a, b = (np.unpackbits(near.odd_sketch(near.min_hashes(np.concatenate([shared, r]), near.SAMPLES))) for r in rest)
        assert abs(near.estimate(np.array((a != b).sum())) - share) < 0.08


def test_texts_with_one_key_keep_their_links_and_words(spark):
    draw = random.Random(11)
    new = lambda n: [f"w{draw.randrange(1 << 30)}" for _ in range(n)]
    p, x, y, z, other = new(80), new(200), new(150), new(120), new(400)
    near_x = x[:195] + new(5)
    rows = [(1, p + x), (2, y + p + z), (2, other), (3, other[:395] + new(5)), (4, p[:3] + y + p + z)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").repartition(3)
    cut = sorted((r["doc_id"], len(WORD.findall(r["text"]))) for r in repeats.without_repeats(docs).where("doc_id < 3").collect())
    assert cut == [(1, 280), (2, 270), (2, 400)]
    got = {(r["id"], r["component_id"]) for r in near.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 2)} and near_x


@pytest.mark.parametrize("block", [2, 4, 64])
def test_unsettled_buckets_meet_again(spark, monkeypatch, block):
    """Chains of likeness over blocks, and groups that share bands without a link."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "MIXES", 1)
    draw = random.Random(block)
    new = lambda n: [f"w{draw.randrange(1 << 30)}" for _ in range(n)]
    texts, base = [], new(120)
    for g in range(4):
        start = base[:105] + new(15) if g else base
        for _ in range(25):
            copy = list(start)
            copy[draw.randrange(120)] = new(1)[0]
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["id"]: r["component_id"] for r in near.near_duplicates(docs, words=2).collect()}
    assert got == components({i: shingles(t, 2) for i, t in rows}, 80)


def removed_words(texts, length):
    first, gone = {}, {}
    for i in sorted(texts):
        words = WORD.findall(texts[i])
        for s in range(len(words) - length + 1):
            at = first.setdefault(tuple(words[s : s + length]), (i, s))
            if at[0] != i or s - at[1] >= length:
                gone.setdefault(i, set()).update(range(s, s + length))
    return gone


def test_repeated_passages_match_brute_force(spark, docs):
    got, texts = {}, texts_of(varied())
    for r in repeats.repeated_spans(docs).collect():
        for s in r["spans"]:
            assert s["seen_id"] <= r["id"]
            got.setdefault(r["id"], set()).update(range(s["start"], s["start"] + s["n_words"]))
    gone = removed_words(texts, 50)
    assert got == gone
    cut = repeats.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    for r in cut.collect():
        text = texts[r["doc_id"]]
        if r["doc_id"] in gone:
            want = [w for k, w in enumerate(WORD.findall(text)) if k not in gone[r["doc_id"]]]
            assert WORD.findall(r["text"]) == want
        else:
            assert (r["text"] or "") == text


def test_repeated_passages_of_given_documents(spark, sf):
    got = {}
    for r in queries.op1_suffix_array_dedup(spark, sf).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
    assert got == removed_words({r["doc_id"]: r["text"] for r in small(spark, sf).collect()}, 50)


def test_one_passage_in_very_many_documents(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.concat(F.lit("own"), "id"), F.lit(passage)).alias("text"))
    spans = repeats.repeated_spans(hot).collect()
    assert len(spans) == 2999
    assert all([tuple(s) for s in r["spans"]] == [(1, 60, 0)] for r in spans)


def test_packing_covers_every_id_once(spark, docs):
    pieces_ = packing.cut_documents(docs, queries.byte_vocabulary())
    rows = packing.pack(pieces_).select(f"{ROW}.doc_id", "start", "length", "doc_tokens", "token_bytes", "sequence_id", "offset").collect()
    encode = packing.Encoder(*queries.byte_vocabulary()).library
    texts = varied()
    whole = {r[0]: [*encode.encode(r[1] or "", add_special_tokens=False).ids, packing.END_ID] for r in texts}
    copies = Counter(r[0] for r in texts)
    found, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(bytes(r["token_bytes"]), "<u4").tolist()
        assert len(ids) == r["length"] and r["doc_tokens"] == len(whole[r["doc_id"]])
        assert ids == whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert found == {i: copies[i] * len(ids) for i, ids in whole.items()}
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_open_windows_find_the_tightest_fit():
    draw, tree, plain = random.Random(1), packing.OpenWindows(100), []
    for step in range(3000):
        need = draw.randint(1, 100)
        fits = [c for c in plain if c >= need]
        assert tree.tightest(need) == (min(fits) if fits else -1)
        if fits:
            tree.take(min(fits))
            plain.remove(min(fits))
            left = min(fits) - need
        else:
            left = 100 - need
        tree.put(left, step)
        plain += [left] if left else []


def odd_texts(seed, n, size):
    draw = random.Random(seed)
    atoms = ["a", " ", "▁", "\n", "é", "日", "the ", " the", "  ", "<unk>", "<|endoftext|>", "\x00", "ing", "😀", "'s", "1", "!!", "　", " ", "\x85", "\t"]
    fixed = ["", " ", "  ", "a ", " a", "a  b", "日本語 テキスト" * 50, "x" * 700, "ab   " * 90, " " * 600]
    return fixed + ["".join(draw.choice(atoms) for _ in range(draw.randint(0, size))) for _ in range(n)]


def test_ids_of_odd_texts_equal_the_library():
    encoder = packing.Encoder(*queries.byte_vocabulary())
    for text in [*odd_texts(1, 600, 60), " " * 12_000 + "a", "b" * 120_000]:
        want = np.array(encoder.library.encode(text, add_special_tokens=False).ids, "<u4")
        assert encoder.one(text) == want.tobytes()


def test_counts_of_odd_texts_equal_the_library():
    counter = tokens.Counter(MODEL)
    texts = odd_texts(2, 600, 60) + ["word and more " * 5000, "日本語テキスト" * 9000]
    want = [len(x) for x in counter.model.encode(texts)]
    assert counter.many(texts) == want
    for text, n in zip(texts[:400], want):
        assert counter.huge(text.replace("▁", " "), chunk=20, overlap=2) == n


def test_token_counts_of_rows(spark, docs, empty):
    out = tokens.count_tokens(docs, MODEL)
    model = tokens.Counter(MODEL).model
    for r in out.select(f"{ROW}.*", "n_bytes", "n_tokens").collect():
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["n_tokens"] == len(model.encode(r["text"] or ""))
    assert tokens.count_tokens(empty, MODEL).count() == 0


def best_pieces(vocabulary, text):
    names = {vocabulary["names"][i]: i for i in vocabulary["plain"]}
    if not text:
        return []
    text = "▁" + text.replace(" ", "▁")
    best, back = [0.0], [0]
    for j in range(1, len(text) + 1):
        top = (-1e300, 0)
        for k in range(min(16, j), 0, -1):
            w = text[j - k : j]
            score = vocabulary["score"][names[w]] if w in names else vocabulary["unknown"] if k == 1 else None
            if score is not None and best[j - k] + score > top[0]:
                top = (best[j - k] + score, k)
        best.append(top[0]), back.append(top[1])
    out, j = [], len(text)
    while j:
        w = text[j - back[j] : j]
        out[:0] = [names[w]] if w in names else [3 + b for b in w.encode()]
        j -= back[j]
    return out


def test_pieces_match_plain_dynamic_programming(monkeypatch):
    p = pieces.Pieces(MODEL)
    model = tokens.Counter(MODEL).model
    size = model.vocab_size()
    vocabulary = {
        "names": [model.id_to_piece(i) for i in range(size)],
        "plain": [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))],
        "score": [model.get_score(i) for i in range(size)],
        "unknown": p.unknown,
    }
    texts = odd_texts(3, 40, 200)
    want = [best_pieces(vocabulary, t) for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in p.encode(texts)] == want
    monkeypatch.setattr(pieces, "SEGMENT", 512)  # several chunks and segments
    assert [p.scan(t).tolist() for t in texts] == want
    assert [p.decode(np.array(w, np.int64)) for w in want] == [t.replace("▁", " ") for t in texts]


def test_pieces_round_trip(spark, docs, empty):
    out = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert all((r["text"] or "") == r["decoded"] for r in out.select(f"{ROW}.text", "decoded").collect())
    assert pieces.encode(docs, MODEL, verify=True).where("not exact").count() == 0
    assert pieces.encode(empty, MODEL, verify=True).count() == 0


def counts_by_hand(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_by_hand(spark, docs, sf):
    for df in (docs, small(spark, sf)):
        for r in quality.with_counts(df).select(f"{ROW}.text", *quality.COUNTS).collect():
            assert tuple(r[c] for c in quality.COUNTS) == counts_by_hand(r["text"] or "")


def test_quality_estimation_weighs_rules():
    good, bad, unsure = (1, 1, 1, 0), (-1, -1, 0, 0), (0, 0, 0, 0)
    posterior = quality.estimate({good: 900, bad: 100, unsure: 5})
    assert posterior[good] > 0.9 and posterior[bad] < 0.1
    assert quality.estimate({}) == {}


def test_quality_keeps_clean_and_drops_junk(spark, sf):
    rows = quality.judge(small(spark, sf), carry=["doc_id"]).select(f"{ROW}.doc_id", "base_failed", "kept").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert np.mean([kept for quality_, kept in judged if quality_ == 1]) > 0.98
    assert np.mean([kept for quality_, kept in judged if quality_ == 0]) < 0.2


def test_quality_of_odd_rows(spark, docs, empty):
    assert quality.judge(docs).count() == docs.count()
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.judge(empty).count() == 0


def test_language_of_held_out_documents(spark, sf):
    rows = queries.op6_language_id(spark, sf).collect()
    langs = {r["doc_id"]: r["lang"] for r in small(spark, sf).collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(langs) and held
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, docs, empty):
    rows = language.identify_fold(docs, MODEL).select(f"{ROW}.doc_id", "lang_pred", "score").collect()
    found = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert len(rows) == docs.count() and {found[0], found[1], found[2]} == {"und"}
    assert language.identify_fold(empty, MODEL).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify_fold(unlabelled, MODEL).collect()} == {"und"}


def test_language_over_several_slices(spark, sf):
    plain = {r["doc_id"]: r["lang_pred"] for r in queries.op6_language_id(spark, sf).collect()}
    rows = small(spark, sf).select("doc_id", "lang", F.concat(F.repeat(F.concat("text", F.lit(" ")), 1500), F.col("text")).alias("text"))
    some = rows.where("doc_id < 40").unionByName(rows.where("doc_id < 3").withColumn("text", F.lit(None).cast("string"))).coalesce(1)
    model = language.Model(*trained(spark, sf))
    found = language.identify(some, model).select(f"{ROW}.doc_id", f"{ROW}.text", "lang_pred").collect()
    assert len(found) == some.count() and sum(len(r["text"] or "") for r in found) > 3 * arrow.WIDE
    assert all(r["lang_pred"] == (plain[r["doc_id"]] if r["text"] and re.search(r"[^\W\d_]", r["text"]) else "und") for r in found)


def trained(spark, sf):
    rows = small(spark, sf).where("lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    model = language.train(rows, MODEL)
    return model.languages, model.table, model.path


def plain_sums(text, weight_of, longest):
    """(log total, expected pieces) over all segmentations, by plain recursion from both ends."""
    n = len(text)
    edges = {(i, j): w for i in range(n) for j in range(i + 1, min(n, i + longest) + 1) if (w := weight_of(text[i:j]))}
    left, right = [Decimal(1)] + [Decimal(0)] * n, [Decimal(0)] * n + [Decimal(1)]
    for j in range(1, n + 1):
        left[j] = sum((left[i] * edges[i, j] for i in range(max(0, j - longest), j) if (i, j) in edges), Decimal(0))
    for i in range(n - 1, -1, -1):
        right[i] = sum((right[j] * edges[i, j] for j in range(i + 1, min(n, i + longest) + 1) if (i, j) in edges), Decimal(0))
    found = Counter()
    for (i, j), w in edges.items():
        found[text[i:j]] += float(left[i] * w * right[j] / left[n])
    return float(left[n].ln()), found


def test_sums_over_all_segmentations():
    names = language.vocabulary(MODEL)
    at = {n: i for i, n in enumerate(names) if n}
    longest = max(map(len, at))
    assert longest > 8 and language.lattice(MODEL).longest == longest
    table = np.zeros((len(names) + 1, 1))
    table[list(at.values())] = np.random.default_rng(0).random((len(at), 1)) * 0.01

    def weight_of(piece):
        return Decimal(float(table[at[piece], 0])) if piece in at else Decimal(language.OTHER) if len(piece) == 1 else None

    words = ["", "the", "é", "日x", "q\x00", "information", "responsibility", "i" * 31, "i" * 32, "information" * 4]
    words += ["internationalinformation" * 9, "日本語" * 70, "nationalé\U0001F600" * 20, "responsibilities" * 80]
    scores = language.word_scores(words, table, MODEL)[:, 0]
    counts = np.arange(1.0, len(words) + 1)
    expected = np.zeros(len(table))
    for word, score, count in zip(words, scores, counts):
        total, found = plain_sums("▁" + word, weight_of, longest)
        assert np.isclose(score, total, rtol=1e-9), word
        for piece, number in found.items():
            if piece in at:
                expected[at[piece]] += count * number
    assert np.allclose(language.expected_pieces(words, counts, table, MODEL), expected, rtol=1e-7, atol=1e-12)


def test_long_words_in_blocks_and_groups(monkeypatch):
    table = np.random.default_rng(1).random((len(language.vocabulary(MODEL)) + 1, 2)) * 0.01
    table[-1] = 0
    words = ["information" * 9, "x" * 333, "relation" * 30, "日" * 50]
    counts = np.array([2.0, 1.0, 3.0, 1.0])
    whole = language.word_scores(words, table, MODEL), language.expected_pieces(words, counts, table[:, :1], MODEL)
    monkeypatch.setattr(language, "BLOCK", 37)
    monkeypatch.setattr(language, "GROUP", 1)
    assert np.allclose(language.word_scores(words, table, MODEL), whole[0])
    assert np.allclose(language.expected_pieces(words, counts, table[:, :1], MODEL), whole[1])


def test_licences(spark, empty):
    texts = [
        "Licensed under the Apache Licence, version 2.0",
        "Some text.\nReleased under the MIT License.\nMore text. Licensed under CC BY-NC 4.0. The end.",
        "(c) 2020 Someone\nRELEASED under the -- MIT licence",
        "Released under no licence",
        None,
        "",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = licences.scan(df, licences.default_known(spark), "doc_id").select(f"{ROW}.doc_id", "licence", "notices").collect()
    found = {r["doc_id"]: (r["licence"], r["notices"]) for r in out}
    assert len(out) == 7
    assert found[0][0] == "Apache-2.0" and found[2][0] == "MIT"
    assert found[1] == (None, ["CC-BY-NC-4.0", "MIT"])
    assert found[3] == found[4] == found[5] == (None, [])
    assert licences.scan(empty, licences.default_known(spark), "doc_id").count() == 0


def test_licences_of_any_raw_length(spark):
    isc = dict(licences.KNOWN)["ISC"]
    owners = "".join(f"Copyright (c) {2000 + k} A contributor with a rather long name, somewhere\n" for k in range(30))
    boxed = "/*" + "*" * 800 + "\n" + " * " + isc.replace(" ", "   ") + "\n" + "*" * 800 + "*/"
    known = spark.createDataFrame([("ISC", isc), ("Sub", "Sublicense at will")], "licence string, text string")
    texts = [owners + isc, boxed, "no licence " * 400, "A line.\nSub licence at will" + "." * 90 + "\nA line."]
    out = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known, "doc_id")
    got = {r["doc_id"]: r for r in out.select(f"{ROW}.doc_id", "text_digest", "licence", "notices").collect()}
    assert [got[k]["licence"] for k in range(4)] == ["ISC", "ISC", None, None]
    assert all(r["text_digest"] for r in got.values()) and got[3]["notices"] == ["Sub"]


def test_many_notices_in_one_text(spark):
    """Time grows with the notices; a text that holds the mark itself is read like any other."""
    line = "Released under the MIT License."
    texts = ["\n".join([line] * 20_000), f"x \ue000 {line}", f"{line}\ue000{line}", None]
    out = licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licences.default_known(spark), "doc_id")
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in out.select(f"{ROW}.doc_id", "licence", "notices").collect()}
    assert got == {0: (None, ["MIT"]), 1: (None, ["MIT"]), 2: (None, ["MIT"]), 3: (None, [])}


def test_full_licences_however_wrapped(spark):
    import textwrap

    full = {}
    for name, text in licences.full_texts():
        full.setdefault(name, text)
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(full)
    want, rows = {}, []

    def add(text, licence, notice):
        want[len(rows)] = (licence, notice)
        rows.append((len(rows), text))

    for name, text in full.items():
        add("Copyright (c) 2020 Someone\n\n" + text, name, name)
        add("A story.\n\n" + textwrap.indent(text, " * ") + "\nThe end.", None, name)
    for width in (20, 33, 47, 61):
        for name in ("MIT", "ISC", "BSD-3-Clause"):
            add("Copyright 2020 A\n" + textwrap.fill(full[name], width), name, name)
    add("Some text. Licensed under the Apache\nLicense, Version 2.0. More\ntext.", None, "Apache-2.0")
    add("(c) 2020 A. Released under the MIT License.", None, "MIT")
    add("They said: released under the MIT License by A.", None, None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = licences.scan(df, licences.default_known(spark), "doc_id").select(f"{ROW}.doc_id", "licence", "notices").collect()
    assert len(out) == len(rows)
    for r in out:
        licence, notice = want[r["doc_id"]]
        assert r["licence"] == licence and (notice in r["notices"] if notice else not r["notices"]), (rows[r["doc_id"]], r)


def test_sets_survive_six_bytes():
    draw = np.random.default_rng(3).integers(0, 1 << 63, 500, np.uint64)
    back = near.from_bytes(near.to_bytes(draw))
    assert (back == draw & np.uint64((1 << 48) - 1)).all() and len(near.from_bytes(near.to_bytes(draw[:0]))) == 0
