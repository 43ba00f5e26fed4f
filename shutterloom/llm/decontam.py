"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Words (A-Z in lower case, split at white space, ASCII punctuation at their ends taken off) of the test
   items get numbers; all other words are 0 and match nothing, which is all that an alignment needs.
2. One pass counts the items' words over all documents, with partial sums.
3. Seeds are n-grams with gaps of an item's rarest words. A copy that keeps 0.8 of an item's L words loses
   0.2 L of them at most, so of the 0.2 L + n rarest ones it keeps n, whatever else was replaced, added or left out: n words of
   that set, no further apart than a copy can be drawn out, are a seed. Which words are rare changes how many places are
   looked at and never what is found; there is no limit of a count. n is 2 for items under ``SHORT`` words, then 3, and 4 from twice as many on.
4. A second pass joins passages to items on the seeds and aligns word numbers locally (match 1,
   mismatch and gap -1) in the window around the seeds, if it holds enough of the item's words in any order. A pair is
   reported if the matched words are 0.8 or more of the item. The window reaches an item's length to both
   sides: an alignment with more words in between has no positive score.

Items are sent to the tasks in blocks of at most ``BLOCK_BYTES``, one pass over the documents each, so a
test set of any size is met whole. Nothing is shuffled but the counts.

Defined results: null texts hold no words; items of fewer than three words match as a whole sequence;
items without words and null item ids match nothing, an item of one word any text that holds it; item ids may be of any type;
repeated rows are reported each. Very long texts are aligned in windows of bounded length.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from shutterloom.llm.common import by_batches

#: Items of fewer words match whole; share of an item's words that a copy keeps.
WHOLE, SIMILARITY = 3, 0.8
#: Items of fewer words have seeds of two words, of fewer than twice as many three, and others four.
SHORT = 10
#: Bytes of items that a task holds at once.
BLOCK_BYTES = 8 << 20
#: Seeds further apart than so many words are aligned apart, in windows that overlap by an item and its slack.
SPAN = 1 << 15
EDGES = string.punctuation.encode()


def words_of(text: str | None) -> list[bytes]:
    return [w for x in text.encode().lower().split() if (w := x.strip(EDGES))] if text else []


class Items:
    """A block of test items as word numbers, with their seeds."""

    def __init__(self, items: list[tuple]):
        texts = [(k, words_of(t)) for k, t in items if k is not None]
        texts = [(k, w) for k, w in texts if w]
        self.ids = [k for k, _ in texts]
        self.number: dict[bytes, int] = {}
        for _, words in texts:
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
        self.numbers = [np.array([self.number[w] for w in words], np.int64) for _, words in texts]
        self.sizes = np.array([len(x) for x in self.numbers], np.int64)
        #: Words that a copy may lose, and the words of a seed.
        self.lost = np.floor(self.sizes * (1 - SIMILARITY) + 1e-9).astype(np.int64)
        self.needed = np.minimum(np.where(self.sizes < SHORT, 2, np.where(self.sizes < 2 * SHORT, 3, 4)), self.sizes - self.lost)
        self.short: dict[int, list[int]] = {}
        for i, x in enumerate(self.numbers):
            if len(x) < WHOLE:
                self.short.setdefault(int(x[0]), []).append(i)
        self.bags = [np.unique(x, return_counts=True) for x in self.numbers]
        self.choose(np.zeros(len(self.number) + 1, np.int64))

    def numbered(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def choose(self, counts: np.ndarray) -> None:
        """The rarest words of each item, as lists by word: the items that have it in their set, and where."""
        rows = []
        for i, x in enumerate(self.numbers):
            if len(x) >= WHOLE:
                rarest = np.argsort(counts[x], kind="stable")[: self.lost[i] + self.needed[i]]
                rows += zip(x[rarest].tolist(), repeat(i), rarest.tolist())
        rows.sort()
        words, self.items, self.at = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else [()] * 3))
        self.begin = np.searchsorted(words, np.arange(len(self.number) + 2))

    def spans(self, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first, last place that the item would begin at) around each seed in a text."""
        size = np.diff(self.begin)[doc]
        places = np.flatnonzero(size)
        if not len(places):
            return []
        size = size[places]
        which = np.repeat(self.begin[doc[places]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        item = self.items[which]
        start = np.repeat(places, size) - self.at[which]
        order = np.lexsort((start, item))
        item, start, out = item[order], start[order], []
        for n in np.unique(self.needed[item]).tolist():
            i = np.arange(len(item) - n + 1)
            j = i + n - 1
            close = (self.needed[item[i]] == n) & (item[i] == item[j]) & (start[j] - start[i] <= self.sizes[item[i]])
            for k, a, b in zip(item[i[close]].tolist(), start[i[close]].tolist(), start[j[close]].tolist(), strict=True):
                if out and out[-1][0] == k and a <= out[-1][2] + self.sizes[k]:
                    out[-1] = (k, out[-1][1], max(b, out[-1][2]))
                else:
                    out.append((k, a, b))
        return out

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, score, first word, word after the last) of all items in a text."""
        doc, out = self.numbered(text), []
        for word, items in self.short.items():
            for place in np.flatnonzero(doc == word).tolist():
                for i in items:
                    if np.array_equal(doc[place : place + len(self.numbers[i])], self.numbers[i]):
                        out.append((self.ids[i], 1.0, place, place + len(self.numbers[i])))
        for i, first_start, last_start in self.spans(doc):
            item, size = self.numbers[i], int(self.sizes[i])
            for a in range(first_start, last_start + 1, SPAN):
                low = max(0, a - size)
                part = doc[low : max(0, min(a + SPAN, last_start) + 2 * size)]
                if len(part) < SIMILARITY * size:
                    continue
                known, many = self.bags[i]
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                common = np.minimum(np.bincount(at[known[at] == part], minlength=len(known)), many).sum()
                if common >= SIMILARITY * size - 1e-9:
                    kept, first, last = align(item, part)
                    if kept >= SIMILARITY * size - 1e-9:
                        out.append((self.ids[i], kept / size, low + first, low + last))
        best: dict = {}
        for row in out:
            if row[0] not in best or (row[1], -row[2]) > (best[row[0]][1], -best[row[0]][2]):
                best[row[0]] = row
        return sorted(best.values())


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """Matched words, first and last place in ``part``, of the best local alignment: match 1, mismatch
    and gap -1. A row of the table at a time; gaps along the row by a running maximum."""
    n = len(part)
    ramp = np.arange(n + 1)
    # score, matched words, and first place are carried in one integer, so that one maximum moves all
    first_bits, kept_bits = (n + 1).bit_length(), (len(item) + 1).bit_length()
    shift_first, shift_kept = 1 << first_bits, 1 << first_bits + kept_bits
    if first_bits + 2 * kept_bits > 62:
        ramp = ramp.astype(object)
    zero = (shift_first - 1) - ramp  # an alignment that starts later loses ties
    row, best = zero.copy(), (0, 0)
    for x in item.tolist():
        same = part == x
        diagonal = row[:-1] + np.where(same, shift_kept + shift_first, -shift_kept)
        up = row - shift_kept
        new = np.maximum(up, zero)
        new[1:] = np.maximum(new[1:], diagonal)
        new = np.maximum.accumulate(new + ramp * shift_kept) - ramp * shift_kept
        new = np.where(new >= shift_kept, new, zero)
        at = int(new.argmax())
        if new[at] > best[0]:
            best = (int(new[at]), at)
        row = new
    value, last = best
    if not last:
        return 0, 0, 0
    kept, first = divmod(value & (shift_kept - 1), shift_first)
    return kept, shift_first - 1 - first, last


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size; one block is fetched at a time where there are many."""
    sized = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    total = sized.agg(F.sum(F.octet_length(text))).first()[0] or 0
    count = -(-total // (BLOCK_BYTES // 2)) or 1
    for k in range(count):
        part = sized if count == 1 else sized.where(F.pmod(F.xxhash64(key, text), F.lit(count)) == k)
        yield [(r[0], r[1]) for r in part.orderBy(key, text).collect()]


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, score double, first_word, end_word): every document with a copy of a test item, the
    best place of each."""
    out = None
    item_kind = items.schema[item_key].dataType
    named = to_arrow_type(item_kind)
    for matcher in _matchers(docs, items, text, item_key, item_text):

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            own = matcher.value
            for batch in batches:
                rows, found = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for match in own.matches(t):
                        rows.append(i)
                        found.append(match)
                columns = zip(*found, strict=True) if found else [()] * 4
                types = (named, pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, item_key, "score", "first_word", "end_word"])

        kind = docs.schema[key].dataType.simpleString()
        part = by_batches(docs.select(key, text), run, f"`{key}` {kind}, `{item_key}` {item_kind.simpleString()}, score double, first_word long, end_word long")
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without a copy of any test item; decided where the text lies, without a join."""
    for matcher in _matchers(docs, items, text, item_key, item_text):
        at = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], matcher=matcher, at=at) -> Iterator[pa.RecordBatch]:
            own = matcher.value
            for batch in batches:
                yield batch.filter(pa.array([not own.matches(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = by_batches(docs, run, docs.schema)
    return docs


def _matchers(docs: DataFrame, items: DataFrame, text: str, item_key: str, item_text: str):
    """For each block of items, its broadcast matcher, with seeds chosen by word counts over all documents."""
    sc = docs.sparkSession.sparkContext
    for block in _blocks(items, item_key, item_text):
        own = Items(block)
        sent = sc.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = sent.value
            counts = np.zeros(len(held.number) + 1, np.int64)
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    counts += np.bincount(held.numbered(t), minlength=len(counts))
            counts[0] = 0
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["word", "n"])

        # a row for each word of the block at most
        got = by_batches(docs.select(text), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(own.number) + 1, np.int64)
        counts[got["word"].to_numpy()] = got["n"].to_numpy()
        own.choose(counts)
        sent.destroy()
        yield sc.broadcast(own)
