"""Long repeats across a corpus, by run-length Burrows-Wheeler indexes.

A byte goes if a string of 200 bytes that covers it also starts anywhere else. Strings lie in
documents' UTF-8 bytes; a null text is empty; rows that agree in key and text are copies of each
other like any two documents; keys may be null or repeat.

1. Anchors. Each window of 200 bytes takes as anchor its 32-byte substring with the least hash (the
   leftmost on ties), so equal windows have equal anchors at equal places. Neighbouring windows with
   one anchor form a *context* of up to 169 windows. Anchors that occur once are dropped: the rest of
   the work is on repetitive text only.
2. Contexts with equal bytes are repeats as a whole. For anchors with several different contexts, one
   occurrence of each is fetched.
3. Contexts are dealt out by anchor to blocks of bounded size. A block becomes a run-length index:
   its suffixes of 200 bytes or more are sorted, the Burrows-Wheeler transform is cut into runs of
   equal letters, and only at run ends are the text position and the length of the match with the
   neighbouring suffix kept. Within a run, a suffix one letter earlier has the same neighbour one
   letter earlier, so from a sample at position p with match length m the matching statistics of the
   following positions are m - 1, m - 2, ...: streaming the samples marks p to p + m wherever m >= 200.
   A window belongs to one context only, so a match is always a second occurrence.
4. Anchors with more contexts than ``COMMON`` are split first. The anchor's place in a window is one of 169;
   windows of places ``low`` to ``high`` all hold the bytes from ``low`` before the anchor to ``window - high``
   after it. Each context is cut to the windows of the lower and of the upper half of its places, and the cuts
   are dealt out by a hash of those shared bytes, so equal windows stay together; parts that are still too
   large are halved again, until a part has one place and all its cuts are equal. Equal cuts of a part
   are repeats as a whole, like contexts; the different ones go to the same run-length indexes.
5. Marks return to all occurrences of their context, and to their documents.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.llm.common import by_batches
from shutterloom.session import scratch, written

GRAM = 32
#: Window starts that are scanned at once: bounds a worker's memory whatever a text's length.
PIECE = 1 << 19
#: A block is closed at so many contexts, or at the end of its last part; anchors and parts with more than
#: ``COMMON`` different contexts are split.
BLOCK_CONTEXTS, COMMON = 512, 2048
#: Fixed odd multipliers of the substring hash, from the fractional part of square roots.
MIX = tuple(np.uint64(x) for x in (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes at each position."""
    n = len(raw) - GRAM + 1
    eight = np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,)).copy()
    h = eight[:n] * MIX[0]
    for i in (1, 2, 3):
        h += eight[8 * i : 8 * i + n] * MIX[i]
        h ^= h >> np.uint64(29)
    h *= MIX[4]
    h ^= h >> np.uint64(32)
    return h


def contexts_of(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(start, windows, anchor) arrays of the contexts in texts that lie side by side."""
    total, span = len(raw), window - GRAM + 1
    if total < window:
        return
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, np.maximum(ends - window + 1, begins), 1)
    np.add.at(edge, ends, -1)
    inside = np.cumsum(edge[:-1]) == 0
    for at in range(0, total - window + 1, PIECE):
        part = raw[at : at + PIECE + window - 1]
        h = gram_hashes(part)
        least = h & np.uint64(0xFFFFFFFFFFF00000) | np.arange(len(h), dtype=np.uint64)  # 44 bits, then the place
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if span > width:
            least = np.minimum(least[: width - span], least[span - width :])
        ok = inside[at : at + len(least)]
        place = np.where(ok, (least & np.uint64(0xFFFFF)).astype(np.int64), -1)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        counts = np.diff(np.append(starts, len(place)))
        keep = place[starts] >= 0
        starts, counts = starts[keep], counts[keep]
        yield starts + at, counts, h[place[starts]].view(np.int64)


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts, and the offset of each text and of the end."""
    column = texts.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw), offsets - offsets[0]


def _occurrences(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, context, key, digest, place) of every context; place is start << 16 | windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _flat(batch.column(2))
            view = memoryview(raw)
            for starts, counts, anchors in contexts_of(raw, offsets[:-1], offsets[1:], window):
                doc = np.searchsorted(offsets, starts, "right") - 1
                context = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), (starts + counts + window - 1).tolist(), strict=True)), np.uint64, len(starts))
                place = (starts - offsets[doc]) << 16 | counts
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(context.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place)], names=["anchor", "context", "key", "digest", "place"])

    return by_batches(docs, run, f"anchor long, context long, key {docs.schema['key'].dataType.simpleString()}, digest long, place long")


class RunLengthIndex:
    """Run-compressed transform of a block of contexts, with samples at run ends."""

    def __init__(self, contexts: list[bytes], window: int):
        lengths = np.array([len(c) for c in contexts])
        longest = int(lengths.max())
        counts = lengths - window + 1
        padded = np.zeros((len(contexts), 1 + 2 * longest), np.uint8)  # 0 before and after, bytes from 1
        for row, c in zip(padded, contexts, strict=True):
            row[1 : 1 + len(c)] = np.minimum(np.frombuffer(c, np.uint8), 254) + 1
        self.of = np.repeat(np.arange(len(contexts)), counts)
        self.start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        stride = padded.shape[1]
        at = self.of * stride + 1 + self.start
        flat = padded.reshape(-1)
        suffixes = np.ndarray((padded.size - longest + 1,), f"S{longest}", flat.data, 0, (1,))[at]
        order = np.argsort(suffixes, kind="stable")
        letters = flat[at[order] - 1]
        cut = letters[1:] != letters[:-1]
        cut |= letters[1:] == 0  # the starts of contexts are letters of their own
        self.runs = 1 + int(cut.sum())
        heads = np.flatnonzero(cut)  # a sample for each border between runs: the last row of one and the first of the next
        rows = suffixes.view(np.uint8).reshape(len(suffixes), longest)
        one, other = order[heads], order[heads + 1]
        same = np.array([], np.int64)
        parts = []
        for i in range(0, len(heads), 4096):
            a, b = rows[one[i : i + 4096]], rows[other[i : i + 4096]]
            differ = (a != b) | (a == 0)
            parts.append(np.where(differ.any(1), differ.argmax(1), longest))
        same = np.concatenate(parts) if parts else same
        long = same >= window
        self.sample = np.concatenate([one[long], other[long]])
        self.match = np.concatenate([same[long], same[long]])

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context, from, to): bytes under matches of the window's length or more."""
        return self.of[self.sample], self.start[self.sample], self.start[self.sample] + self.match


def _index(contexts: DataFrame, window: int) -> DataFrame:
    """(part, context, from_byte, to_byte): marks within contexts, by a run-length index a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []

        def close() -> pa.RecordBatch:
            who, a, b = RunLengthIndex([x[2] for x in held], window).marks()
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in who], pa.int64()), pa.array([held[i][1] for i in who], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["part", "context", "from_byte", "to_byte"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if len(held) >= BLOCK_CONTEXTS and held[-1][0] != row[0]:
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    dealt = contexts.select("part", "context", "bytes").repartition("part").sortWithinPartitions("part", "context")
    return by_batches(dealt, run, "part long, context long, from_byte long, to_byte long")


CUT = "part long, cut long, low int, high int, at int, anchor long, context long, bytes binary"


def _halves(rows: DataFrame, window: int) -> DataFrame:
    """Cuts of contexts to the windows of each half of their places; rows as in ``CUT``, where ``at`` is the
    cut's place in its context, and the anchor stands ``high`` bytes at most after the cut's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for low, high, at, anchor, context, raw in zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
                grams = gram_hashes(np.frombuffer(raw[: high + GRAM], np.uint8)).view(np.int64)
                place = int((grams == anchor).argmax())  # the leftmost, as in the context
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    start, end = max(place - b, 0), min(place - a + window, len(raw))
                    if end - start >= window:
                        core = raw[place - a : place + window - b]
                        part = xxhash.xxh3_64_intdigest(core + struct.pack("<qi", anchor, a))
                        piece = raw[start:end]
                        out.append((part, xxhash.xxh3_64_intdigest(piece), a, b, at + start, anchor, context, piece))
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            signed = [np.array(c, np.uint64).view(np.int64) for c in columns[:2]]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([*map(pa.array, signed), *(pa.array(c, t) for c, t in zip(columns[2:], kinds, strict=True))], names=[c.split()[0] for c in CUT.split(", ")])

    return by_batches(rows, run, CUT)


def _split(contexts: DataFrame, window: int) -> list[DataFrame]:
    """Marks (anchor, context, from_byte, to_byte) within contexts of anchors that have very many of them.

    Each round halves the places of the parts that are too large, so there are eight rounds at most for
    windows of 200 bytes; what a round settles is indexed at once.
    """
    whole = F.lit(0).cast("int")
    rows = contexts.select(F.col("anchor").alias("part"), F.col("context").alias("cut"), whole.alias("low"), F.lit(window - GRAM).cast("int").alias("high"), whole.alias("at"), "anchor", "context", "bytes")
    marks = []
    while True:
        cuts = written(_halves(rows, window), "cuts")
        one = F.min(F.struct("at", "anchor", "context", "bytes")).alias("one")
        different = written(cuts.groupBy("part", "cut", "low", "high").agg(F.count("*").alias("n"), one).select("part", "cut", "low", "high", "one.*", "n"), "parts")
        sizes = written(different.groupBy("part").agg(F.count("*").alias("cuts")).where("cuts > 1"), "sizes")
        small = different.join(sizes.where(F.col("cuts") <= COMMON), "part").select("part", F.col("cut").alias("context"), "bytes")
        partial = _index(small, window).unionAll(different.where("n > 1").select("part", F.col("cut").alias("context"), F.lit(0).cast("long"), F.length("bytes").cast("long")))
        partial = written(partial.groupBy("part", F.col("context").alias("cut")).agg(F.collect_set(F.struct("from_byte", "to_byte")).alias("marks")), "marks")
        back = cuts.select("part", "cut", "at", "anchor", "context").join(partial, ["part", "cut"]).select("anchor", "context", "at", F.explode("marks").alias("m"))
        marks.append(back.select("anchor", "context", (F.col("at") + F.col("m.from_byte")).alias("from_byte"), (F.col("at") + F.col("m.to_byte")).alias("to_byte")))
        large = sizes.where(F.col("cuts") > COMMON).select("part")
        if large.isEmpty():
            return marks
        rows = different.join(large, "part", "left_semi").select(*cuts.columns)  # equal cuts are marked: one stands for them


def _fetched(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(anchor, context, hot, bytes) of the wanted occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for r in rows:
                    start, n = r["place"] >> 16, r["place"] & 0xFFFF
                    out.append((r["anchor"], r["context"], r["hot"], text[start : start + n + window - 1]))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], names=["anchor", "context", "hot", "bytes"])

    by_doc = wanted.groupBy("key", "digest").agg(F.collect_list(F.struct("anchor", "context", "place", "hot")).alias("rows"))
    d, w = docs.alias("d"), by_doc.alias("w")
    both = d.join(w, F.col("d.key").eqNullSafe(F.col("w.key")) & (F.col("d.digest") == F.col("w.digest"))).select(F.col("d.text").cast("binary").alias("text"), "w.rows")
    return by_batches(both, run, "anchor long, context long, hot boolean, bytes binary")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 200) -> DataFrame:
    """(key, digest long, spans array<struct<a, b>>): repeated byte ranges, not merged; documents
    without any are left out. digest is xxhash64 of the text, so that keys may repeat."""
    if not GRAM <= window < 1 << 15:
        raise ValueError(f"window must be from {GRAM} to {(1 << 15) - 1} bytes")
    source = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    with scratch() as made:
        all_contexts = _occurrences(source, window)
        repeated = written(all_contexts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated")
        found = written(all_contexts.join(repeated, "anchor"), "occurrences")
        by_context = written(found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "digest", "place")).alias("one")), "contexts")
        several = written(by_context.groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1"), "several")
        wanted = by_context.join(several, "anchor").select("anchor", "context", "one.*", (F.col("contexts") > COMMON).alias("hot"))
        contexts = written(_fetched(source, wanted, window), "texts").dropDuplicates(["anchor", "context"])
        marks = _index(contexts.where("not hot").withColumnRenamed("anchor", "part"), window).withColumnRenamed("part", "anchor")
        if not several.where(F.col("contexts") > COMMON).isEmpty():
            for more in _split(contexts.where("hot"), window):
                marks = marks.unionAll(more)
        partial = written(marks.groupBy("anchor", "context").agg(F.collect_set(F.struct("from_byte", "to_byte")).alias("marks")), "ranges")
        made.keep(found, by_context, partial)
    whole = by_context.where("n > 1").select("anchor", "context", F.lit(True).alias("whole"))
    start = F.shiftright("place", 16)
    in_whole = found.join(whole, ["anchor", "context"]).select("key", "digest", start.alias("a"), (start + F.col("place").bitwiseAND(0xFFFF) + window - 1).alias("b"))
    in_part = found.join(partial, ["anchor", "context"]).select("key", "digest", start.alias("start"), F.explode("marks").alias("m")).select("key", "digest", (F.col("start") + F.col("m.from_byte")).alias("a"), (F.col("start") + F.col("m.to_byte")).alias("b"))
    spans = in_whole.unionAll(in_part).groupBy("key", "digest").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    return spans.withColumnRenamed("key", key)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 200) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans long, spans array<struct<a, b>>, kept binary): what stays of
    every document; spans are the maximal removed ranges."""
    spans = repeated_spans(docs, key, text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"]) for r in rows or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                out.append((len(raw), sum(b - a for a, b in merged), len(merged), [{"a": a, "b": b} for a, b in merged], b"".join(kept)))
            columns = zip(*out, strict=True) if out else [()] * 5
            span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()), strict=True))], names=[key, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    d = docs.select(key, F.xxhash64(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).alias("d")
    s = spans.alias("s")
    both = d.join(s, F.col(f"d.{key}").eqNullSafe(F.col(f"s.{key}")) & (F.col("d.digest") == F.col("s.digest")), "left").select(f"d.{key}", "d.text", "s.spans")
    kind = docs.schema[key].dataType.simpleString()
    return by_batches(both, run, f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<a: bigint, b: bigint>>, kept binary")
