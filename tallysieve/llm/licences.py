"""Licence scan: canonical digest of an entire text, hash-joined to the digests of known licences.

A text is brought to canonical form (lower case, copyright lines out, equivalent spellings
made one, punctuation, line breaks and white space folded) and digested; every text with a word gets a
digest. The known licences are looked up as the entire document, and as runs of whole lines or sentences
inside it, however they are wrapped, boxed or spread over paragraphs. A run starts where a line or
sentence starts and ends where one ends; a notice that is only part of a sentence is none.

Folding can put a word of the licence ("copyright holders") first in a line, where it looks like an
owner's line. So a text is read three ways: with all lines out that begin like a copyright line, with those
that go on with a year, a sign or a placeholder, and with none; a hit in one way is a hit. (Missed: a text with owner's
lines of the first kind only, inside a licence that is wrapped before "copyright" as well.)

Known licences are a table (licence, text). Its first words and form lengths, some hundred bytes a licence, go to all
tasks; its digests are joined, and Catalyst broadcasts them while they are few. A run is digested only from places
whose first three words are those of a known licence, once for each length that such a licence has: work grows with
these places, whatever the text's length.

Defined cases: null and empty texts have no digest and no licence; a text that is the
same licence several times names it once; repeated rows give repeated rows; an empty table gives
an empty table; other columns of the input, whatever their names, play no part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from importlib import resources
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysieve.llm.common import ROW, carried, stash

# Short licence notices, as their owners publish them. Full texts are files in licence_texts/.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)
# Spellings that count as one; British endings count as American ones.
SPELLINGS = (
    (r"licence(?<=\blicence)", "license"),
    (r"is(?=(e|ed|es|ing|ation|ations)\b)(?<=[a-z]{3}is)", "iz"),
    (r"our(?=(|s|ed|able)\b)(?<=[a-z]{2}our)", "or"),
    (r"judgement(?<=\bjudgement)", "judgment"),
    (r"merchantib(?<=\bmerchantib)", "merchantab"),
    (r"sub (\x{E000} )?license(?<=\bsub (\x{E000} )?license)", "sublicense"),
)
# What a text holds if it has a copyright line.
COPYRIGHT_SIGNS = ("copyright", "(c)", "©", "all rights reserved")
# Titles that stand above a text or not, and what may be left out from there on.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License"),
}
ENDINGS = (
    r"(?m)^ *APPENDIX: How to apply",
    r"(?m)^ *How to Apply These Terms to Your New (Programs|Libraries)",
    r"(?m)^ *END OF TERMS AND CONDITIONS",
)
COPYRIGHT_LINE = r"(?m)^[^\p{L}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"


OWNER_LINE = (
    r"(?m)^[^\p{L}\n]*((copyright|\(c\))[^\p{L}\n]*(\(c\)[^\p{L}\n]*)?(©|[0-9]{4}|[\[{<])|copyright[^\p{L}\n]*\(c\)|©"
    r"|all rights reserved)[^\n]*$"
)
BREAK = "\ue000"


def folded(lower: Column) -> Column:
    """Words in canonical spelling with one space between, and BREAK where a line or sentence ends."""
    out = F.regexp_replace(lower, r"([.!?])[\x20\x09-\x0D]+|\n", f"$1 {BREAK} ")
    out = F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}\x{E000}]+", " "))
    for odd, usual in SPELLINGS:
        out = F.regexp_replace(out, odd, usual)
    return out


def joined(form: Column) -> Column:
    return F.trim(F.regexp_replace(form, r"[ \x{E000}]+", " "))


def canonical(text: Column) -> Column:
    return joined(folded(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")))


def readings(texts: DataFrame) -> DataFrame:
    """The rows with m0, m1, m2 instead of `t`: folded text without any copyright lines; where they differ, without
    plain owner's lines, and with all lines. Each step is a column, so that no text is read twice for it."""
    others = [c for c in texts.columns if c != "t"]
    signed = reduce(or_, [F.col("lower").contains(sign) for sign in COPYRIGHT_SIGNS])
    out = texts.select(*others, F.lower("t").alias("lower")).select(*others, "lower", signed.alias("signed"))
    bare = F.when(F.col("signed"), F.regexp_replace("lower", COPYRIGHT_LINE, " ")).otherwise(F.col("lower"))
    owned = F.when(F.col("signed"), F.regexp_replace("lower", OWNER_LINE, " "))
    out = out.select(*others, "lower", bare.alias("bare"), owned.alias("owned"))
    changed = F.col("owned").isNotNull() & (F.col("bare") != F.col("lower"))
    return out.select(
        *others,
        folded(F.col("bare")).alias("m0"),
        folded(F.when(changed & (F.col("owned") != F.col("bare")), F.col("owned"))).alias("m1"),
        folded(F.when(changed, F.col("lower"))).alias("m2"),
    )


def sha(form: Column) -> Column:
    """SHA-256 of a canonical form; null if nothing is left."""
    return F.when(form != "", F.sha2(form, 256))


def digest(text: Column) -> Column:
    return sha(canonical(text))


def known_forms(known: DataFrame) -> DataFrame:
    """(digest, form, licence): the first licence by name where two texts are the same."""
    return (
        readings(known.select("licence", F.col("text").alias("t")))
        .select("licence", F.explode(F.array_compact(F.array("m0", "m1", "m2"))).alias("m"))
        .select("licence", joined(F.col("m")).alias("form"))
        .where("form <> ''")
        .groupBy("form")
        .agg(F.min("licence").alias("licence"))
        .select(sha(F.col("form")).alias("digest"), "form", "licence")
    )


def full_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files, with and without title, clause numbers and what follows the terms."""
    out = []
    for file in sorted(resources.files("tallysieve.llm").joinpath("licence_texts").iterdir(), key=lambda f: f.name):
        licence, text = re.sub(r"(~.*)?\.txt$", "", file.name), file.read_text("utf-8")
        texts = [text] + [text[: m.start()] for e in ENDINGS if (m := re.search(e, text))]
        if licence in TITLES:
            texts.append(re.sub(r"(?m)^ *[0-9]\. ", "", text))
            texts += [f"{title}\n\n{t}" for t in list(texts) for title in TITLES[licence]]
        out += [(licence, t) for t in dict.fromkeys(texts)]
    return out


def default_known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *full_texts()], "licence string, text string")


def first_words(words: Column, n: int) -> Column:
    return F.substring_index(words, " ", n)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def runs_of(form: Column) -> Column:
    """Lines and sentences with a word."""
    return F.filter(F.split(form, r" ?\x{E000} ?"), lambda x: x != "")


def starts(runs: Column, sizes: dict[str, list[int]]) -> Column:
    """Digests of the runs of lines and sentences that start and end like a known licence's.

    `runs` names a column: what stands there is not computed anew for each place. `sizes` has the lengths of the
    known forms by their first three words (or all words, where there are fewer).
    """
    none = F.array().cast("array<string>")
    if not sizes:
        return none
    firsts = sorted({key.split(" ")[0] for key in sizes})
    by_key = F.create_map(*[F.lit(x) for key, n in sorted(sizes.items()) for x in (key, n)])

    def lengths(at: Column) -> Column:
        words = F.array_join(F.slice(runs, at + 1, 3), " ")
        keys = bound(words, lambda w: F.array_distinct(F.array(*[first_words(w, n) for n in (1, 2, 3)])))
        return F.flatten(F.transform(keys, lambda k: F.coalesce(by_key[k], F.array().cast("array<int>"))))

    def digests(at: Column, known: Column) -> Column:
        # a run has a letter and a space at least
        ahead = F.array_join(F.slice(runs, at + 1, F.floor(F.array_max(known) / 2).cast("int") + 1), BREAK)
        ended = lambda a, n: F.substring(a, n + 1, F.lit(1)).isin(BREAK, "") & (F.char_length(a) >= n)
        digest = lambda a, n: F.sha2(F.translate(F.substring(a, F.lit(1), n), BREAK, " "), 256)
        return bound(ahead, lambda a: F.transform(known, lambda n: F.when(ended(a, n), digest(a, n))))

    places = F.filter(
        F.transform(runs, lambda x, i: F.when(first_words(x, 1).isin(firsts), i)), lambda i: i.isNotNull()
    )
    found = F.transform(places, lambda i: bound(lengths(i), lambda known: F.when(F.size(known) > 0, digests(i, known))))
    return F.coalesce(F.array_distinct(F.array_compact(F.flatten(F.array_compact(found)))), none)


def scan(
    docs: DataFrame, known: DataFrame, key: str, text: str = "text", carry: Sequence[str] | None = None
) -> DataFrame:
    """(__row, text_digest, licence, notices): the licence that the whole text is, and those among its lines and sentences.

    `key` names a column that tells documents apart; rows with the same key share their notices.
    """
    registry = stash(known_forms(known), "known-licences")
    sizes: dict[str, list[int]] = {}
    for r in registry.select(first_words(F.col("form"), 3).alias("key"), F.char_length("form").alias("n")).distinct().collect():
        sizes.setdefault(r["key"], []).append(r["n"])
    base = docs.select(carried(docs, carry), docs[key].alias("k"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    cut = readings(base).select(
        ROW, "k", *[f(F.col(f"m{i}")).alias(f"{x}{i}") for i in range(3) for x, f in (("d", lambda m: sha(joined(m))), ("r", runs_of))]
    )
    runs = [F.coalesce(starts(F.col(f"r{i}"), sizes), F.array().cast("array<string>")) for i in range(3)]
    placed = cut.select(ROW, "k", "d0", "d1", "d2", F.array_distinct(F.concat(*runs)).alias("runs"))
    placed = stash(placed, "licences")
    found = (
        placed.where("size(runs) > 0")
        .select("k", F.explode("runs").alias("digest"))
        .join(registry.select("digest", "licence"), "digest")
        .groupBy("k")
        .agg(F.sort_array(F.collect_set("licence")).alias("notices"))  # at most one entry per known licence
        .withColumnRenamed("k", "found_k")
    )
    whole = placed.drop("runs")
    for i in range(3):
        names = registry.select(F.col("digest").alias(f"r{i}"), F.col("licence").alias(f"l{i}"))
        whole = whole.join(names, F.col(f"d{i}") == F.col(f"r{i}"), "left")
    return whole.join(found, F.col("k").eqNullSafe(F.col("found_k")), "left").select(
        ROW,
        F.col("d0").alias("text_digest"),
        F.coalesce("l0", "l1", "l2").alias("licence"),
        F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
    )
