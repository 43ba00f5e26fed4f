"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters' numbers, so anagrams share it, and one
letter added, removed or exchanged changes it by one letter's power or by the difference of two. Words
meet where their keys do after such a change: every word shows its own key and, for each of its different letters,
the key without that letter. A word with a letter more shows the shorter one's own key; two words that
differ by an exchange show the same key without the letters exchanged.

Keys know no order, so words made of the same syllables would all meet. One edit leaves the first half
of the remaining letters or the second half as it is; the half's hash is part of what words meet on, and the
letter order of those that meet is verified by an edit distance of exactly one. A bucket then holds words
of one length, one half and almost the same letters, whatever the number of anagrams.

A word's form is its most frequent near word, if that is frequent enough; forms are followed to the
root by doubling: each round every word takes the form of its form.

Defined results: null texts and texts without letters give no words; repeated rows count each; a null document id
is an empty one; ties go to the smaller word in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.llm.common import by_batches
from shutterloom.session import scratch, written

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
#: Words that a task counts before it passes the counts on.
HELD = 400_000
#: The power of the letters' numbers: a to z 1 to 26, U+00C0 to U+00FF 27 to 90. Sums stay below 2^63 for any text.
POWER = 5
LETTERS = [0] * 256
for _i, _c in enumerate([*range(97, 123), *range(0xC0, 0x100)], 1):
    LETTERS[_c] = _i**POWER


def slipped(run: str, prefix: int, one_in: int) -> str:
    """A run with the letter deleted that its hash names, if one in so many divides the hash; ``prefix`` is the
    crc32 of what precedes the run in what is hashed."""
    h = crc32(run.encode(), prefix)
    if one_in and h % one_in == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 0, length: int = 6) -> DataFrame:
    """(word, n): words of at least so many letters in all texts, with the slips planted by the document's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                prefix = crc32(f"{'' if doc is None else doc}:".encode())
                # only A-Z change case; a slip takes one letter, so shorter runs make no word
                of = Counter(r for r in RUNS.findall(t.encode().lower().decode()) if len(r) >= length)
                for r, n in of.items():
                    w = slipped(r, prefix, one_in)
                    if len(w) >= length:
                        held[w] += n
            if len(held) >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    return by_batches(docs.select(key, text), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shown(word: str) -> list[tuple[int, int, int, int]]:
    """(key, letter removed or 0, 1 for the first half and 2 for the second, hash of the half) that a word meets others on."""
    values = [LETTERS[ord(c)] for c in word]
    key, n, out = sum(values), len(word), []
    for letter in {0, *values}:
        rest = n - (letter > 0)
        halves = word[: rest // 2], word[n - (rest - rest // 2) :]
        # halves meet only on the same side of as many letters
        out += [(key - letter, letter, side, xxhash.xxh64_intdigest(h.encode(), rest * 2 + side) - (1 << 63)) for side, h in enumerate(halves, 1)]
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): words of (word, n) that differ by exactly one letter added, removed or exchanged, both ways, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shown(w) for w in batch.column(0).to_pylist()]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            at = np.repeat(np.arange(len(rows)), sizes)
            columns = zip(*(x for r in rows for x in r), strict=True) if len(at) else [()] * 4
            key, letter, side, half = (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True))
            yield pa.RecordBatch.from_arrays([key, half, side, letter, batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["key", "half", "side", "letter", "word", "n"])

    met = by_batches(words.select("word", "n"), run, "key long, half long, side int, letter long, word string, n long")
    met = met.withColumn("most", F.count("*").over(Window.partitionBy("key", "half", "side"))).where(F.col("most") > 1).drop("most")
    met = written(met, "shown")
    x, y = (met.select("key", "half", "side", *(F.col(c).alias(f"{c}_{k}") for c in ("letter", "word", "n"))) for k in "ab")
    # equal letters removed: anagrams, which are never one edit apart
    pairs = x.join(y, ["key", "half", "side"]).where((F.col("letter_a") != F.col("letter_b")) & (F.col("word_a") < F.col("word_b")))
    pairs = pairs.where(F.levenshtein("word_a", "word_b", 1) == 1).select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "n_a", "n_b").distinct()
    return pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last one. Forms must not form a cycle."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", one_in: int = 0, length: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n): words of at least ``length`` letters and ``least`` occurrences; a form is
    the near word with the largest n, if that is ``times`` the word's n or more."""
    words = written(word_counts(docs, key, text, one_in, length).where(F.col("n") >= least), "words")
    best = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word")))
    strong = -F.col("best.n") >= times * F.col("n_a")
    with scratch() as made:
        near = near_pairs(words).groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n_a").alias("n_a"))
        near = written(near.select(F.col("a").alias("word"), "n_near", F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n")), "near")
        made.keep(near)
    roots = rooted(near.where("form is not null"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
