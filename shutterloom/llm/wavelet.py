"""Token ids as files: a wavelet matrix per shard.

A shard holds whole documents in ascending order of their key. Its ids stand in one bit-plane for
each bit of the largest id, from the highest bit down; each plane is the stable partition of the one
above by its bit, and carries the number of ones before every block of 512 bits. That is 1 bit per
token and plane plus 6 %, and it answers access, rank (counting) and select (occurrences) without
unpacking the shard. Shards are rows of a Parquet table, written by Spark's own committer, so any
store that Spark can write is fit to hold them and a lost executor only repeats its task.

Layout of a shard, little-endian: magic ``WMX1``; u32 number of planes; u64 tokens; u32 documents;
u64 length of each document; then for each plane u64 zeros, the u32 counts of ones before each block,
and the bits, first bit highest in its byte, padded to a whole block.

Defined results: a null text is empty and holds only the end id; null keys come first; equal keys
are ordered by text; an empty table gives no shard.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.llm.bpe import PUNCTUATION, byte_alphabet
from shutterloom.llm.common import by_batches
from shutterloom.session import fresh_path

MAGIC, BLOCK = b"WMX1", 512
#: A shard is closed when it holds so many tokens; only a longer document makes a larger one.
SHARD_TOKENS = 1 << 20
#: Words that an encoder holds at most, the longest of them, the characters of a text that it splits at
#: once, and the bytes of texts that are encoded together.
WORDS_HELD, LONGEST_HELD, PIECE, TOGETHER = 800_000, 64, 1 << 20, 1 << 22
#: Words that the library sees as one text.
JOINED = 500
#: Fixed value: Unicode white space other than space and line break.
WHITE = "\t\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK, BORDER = re.compile(f"[ \n{WHITE}]*[^ \n{WHITE}]+|[ \n{WHITE}]+"), re.compile(f"(?<=[^ \n{WHITE}])(?=[ \n{WHITE}])")
#: Texts that Arrow doesn't split.
ODD = f"[{WHITE}]|[ \n][ \n]|^[ \n]"


class WaveletMatrix:
    """Read access to one shard."""

    def __init__(self, raw: bytes):
        magic, planes, self.n, docs = struct.unpack_from("<4sIQI", raw)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix shard")
        at = struct.calcsize("<4sIQI")
        self.lengths = np.frombuffer(raw, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        blocks = -(-self.n // BLOCK)
        self.zeros, self.before, self.bits = [], [], []
        for _ in range(planes):
            self.zeros.append(struct.unpack_from("<Q", raw, at)[0])
            self.before.append(np.frombuffer(raw, "<u4", blocks, at + 8))
            at += 8 + 4 * blocks
            self.bits.append(np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at))
            at += blocks * BLOCK // 8

    @property
    def planes(self) -> int:
        return len(self.bits)

    @staticmethod
    def build(ids: np.ndarray, lengths) -> bytes:
        """Bytes of a shard of documents with these lengths."""
        n, planes = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
        blocks = -(-n // BLOCK)
        now = ids.astype(np.uint16 if planes <= 16 else np.uint32)
        out = [struct.pack("<4sIQI", MAGIC, planes, n, len(lengths)), np.asarray(lengths, "<u8").tobytes()]
        for bit in range(planes - 1, -1, -1):
            ones = (now & now.dtype.type(1 << bit)).astype(bool)
            packed = np.zeros(blocks * BLOCK // 8, np.uint8)
            packed[: -(-n // 8)] = np.packbits(ones)
            per_block = np.bitwise_count(packed.view("<u8")).reshape(blocks, BLOCK // 64).sum(1, dtype=np.int64)
            before = np.concatenate([[0], np.cumsum(per_block)[:-1]]) if blocks else per_block
            out += [struct.pack("<Q", n - int(per_block.sum())), before.astype("<u4").tobytes(), packed.tobytes()]
            now = np.concatenate([now.take(np.flatnonzero(~ones)), now.take(np.flatnonzero(ones))])
        return b"".join(out)

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block, rest = divmod(i, BLOCK)
        at = block * BLOCK // 8
        whole, bits = divmod(rest, 8)
        count = int(self.before[plane][block]) + int(np.bitwise_count(self.bits[plane][at : at + whole]).sum())
        return count + (int(self.bits[plane][at + whole]) >> (8 - bits)).bit_count() if bits else count

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.planes):
            one = int(self.bits[plane][i >> 3]) >> (7 - (i & 7)) & 1
            value = value << 1 | one
            ones = self._ones(plane, i)
            i = self.zeros[plane] + ones if one else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences before i stand below the last plane."""
        low, high = 0, i
        if token >> self.planes:
            return 0, 0
        for plane in range(self.planes):
            a, b = self._ones(plane, low), self._ones(plane, high)
            if token >> (self.planes - 1 - plane) & 1:
                low, high = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        low, high = self._range(token, min(i, self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, one: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that value."""
        before = self.before[plane].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.bits[plane][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for plane in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - plane) & 1
            i = self._select_bit(plane, one, i - self.zeros[plane] if one else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All tokens, by undoing the partitions from the last plane up."""
        now = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for plane in range(self.planes - 1, -1, -1):
            ones = np.unpackbits(self.bits[plane], count=self.n).view(bool)
            above = np.empty_like(now)
            above[np.flatnonzero(~ones)] = now[: self.zeros[plane]]
            above[np.flatnonzero(ones)] = now[self.zeros[plane] :] | now.dtype.type(1 << (self.planes - 1 - plane))
            now = above
        return now


def _listed(texts: pa.Array) -> list[str]:
    """Without a scalar for each, as to_pylist makes."""
    return texts.to_numpy(False).tolist()


class LibraryEncoder:
    """The tokenizers library behind a cache of words.

    No pre-token of byte-level BPE holds white space after another character, or a character that is
    neither letter nor digit after one that is. So a text falls into chunks (white space and what
    follows it), and a chunk that is a word and punctuation into the two; each encodes alone. Arrow splits
    texts whose white space is single spaces and line breaks, and tells their different chunks and words;
    each of these is looked up once a batch, and the new ones go to the library in one call, words already in
    its byte alphabet.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.mapped = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (self.library, self.mapped):
            t.no_truncation()
            t.no_padding()
        self.letters = str.maketrans({chr(b): c for c, b in byte_alphabet().items()})
        self.border = self.letters[10]
        self.mapped.pre_tokenizer = pre_tokenizers.Split(self.border, "isolated")
        self.border_id = self.mapped.token_to_id(self.border)
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    @staticmethod
    def _encoded(library, texts: list[str]) -> list[bytes]:
        found = [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum([len(x) for x in found]) * 4
        raw = np.fromiter(chain.from_iterable(found), "<u4", int(ends[-1]) // 4).tobytes()
        return [raw[b - 4 * len(x) : b] for x, b in zip(found, ends.tolist(), strict=True)]

    def _words_encoded(self, words: list[str]) -> list[bytes]:
        """Words of letters, each after a space, many in one text: the border between them is a token of its own, which no
        word holds, and tells where each one's ids end."""
        mapped = lambda x: x.encode().decode("latin-1").translate(self.letters)
        if self.border_id is None:
            return self._encoded(self.mapped, mapped(" " + "\n ".join(words)).split(self.border))
        out: list[bytes] = []
        texts = [mapped(" " + "\n ".join(words[i : i + JOINED]) + "\n") for i in range(0, len(words), JOINED)]
        for found in self.mapped.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(found.ids, "<u4")
            raw, at = ids.tobytes(), 0
            for end in (np.flatnonzero(ids == self.border_id) * 4).tolist():
                out.append(raw[at:end])
                at = end + 4
        if len(out) != len(words):
            raise ValueError("a word holds the border between words")
        return out

    def _known(self, held: dict[str, bytes], limit: int, pieces: list[str], encoded) -> list[bytes]:
        """Ids of different pieces; those that are not held are encoded."""
        out = list(map(held.get, pieces))
        at = [i for i, x in enumerate(out) if x is None]
        if at:
            new = [pieces[i] for i in at]
            ids = encoded(new)
            for i, x in zip(at, ids, strict=True):
                out[i] = x
            if len(held) + len(new) > limit:
                held.clear()
            held.update((p, x) for p, x in zip(new[:limit], ids, strict=False) if len(p) <= LONGEST_HELD)
        return out

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each after a space."""
        return self._known(self.words, WORDS_HELD, words, self._words_encoded)

    def _of_others(self, pieces: list[str]) -> list[bytes]:
        return self._known(self.others, WORDS_HELD // 4, pieces, lambda new: self._encoded(self.library, new))

    def _of_chunks(self, chunks: pa.Array) -> pa.Array:
        """Ids of different chunks: each after a space, or with the line break that it begins with."""
        n, word = len(chunks), pc.utf8_rtrim(chunks, PUNCTUATION)
        sizes, word_sizes = pc.binary_length(chunks).to_numpy(), pc.binary_length(word).to_numpy()
        plain = pc.utf8_is_alpha(word).to_numpy(False) & (word_sizes <= LONGEST_HELD)
        coded = word.filter(pa.array(plain)).dictionary_encode()
        codes = np.full(n, len(coded.dictionary))
        codes[plain] = coded.indices.to_numpy()
        ids = pa.array([*self._of_words(_listed(coded.dictionary)), b""], pa.large_binary())
        # what follows the word, in the same bytes, or the whole of other chunks
        cuts = np.zeros(2 * n + 1, np.int64)
        cuts[0] = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset] if n else 0
        cuts[2::2] = sizes
        cuts[1::2] = np.where(plain, word_sizes, 0)
        cuts[2::2] -= cuts[1::2]
        rest = pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(np.cumsum(cuts)), chunks.buffers()[2] or pa.py_buffer(b"")).take(pa.array(np.arange(1, 2 * n, 2)))
        rest = pc.if_else(pa.array(plain | pc.starts_with(rest, "\n").to_numpy(False)), rest, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), rest, pa.scalar("", pa.large_string())))
        ended = rest.dictionary_encode()
        others = pa.array(self._of_others(_listed(ended.dictionary)), pa.large_binary())
        return pc.binary_join_element_wise(ids.take(pa.array(codes)), others.take(ended.indices), pa.scalar(b"", pa.large_binary()))

    def _piecewise(self, text: str) -> bytes:
        """A text with any white space, from runs of chunks of bounded length."""
        at, out = 0, []
        while at < len(text):
            cut = BORDER.search(text, at + PIECE) if len(text) - at > PIECE else None
            end = cut.start() if cut else len(text)
            chunks = CHUNK.findall(text, at, end)
            names = list(dict.fromkeys(chunks))
            ids = dict(zip(names, self._of_others(names), strict=True))
            out += [ids[c] for c in chunks]
            at = end
        return b"".join(out)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of many texts, as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD).to_numpy(False)
        out = [self._piecewise(texts[i].as_py()) if x else b"" for i, x in enumerate(odd.tolist())]
        if not odd.all():
            plain = np.flatnonzero(~odd)
            split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
            coded = split.values.dictionary_encode()
            offsets, which = split.offsets.to_numpy(), coded.indices.to_numpy().astype(np.int64)
            first = self._of_others(_listed(split.values.take(pa.array(offsets[:-1]))))  # these follow nothing
            which[offsets[:-1]] = len(coded.dictionary) + np.arange(len(first))
            ids = pa.concat_arrays([self._of_chunks(coded.dictionary), pa.array(first, pa.large_binary())]).take(pa.array(which))
            at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[offsets].tolist()
            raw = memoryview(ids.buffers()[2] or b"")
            for i, a, b in zip(plain.tolist(), at[:-1], at[1:], strict=True):
                out[i] = bytes(raw[a:b])
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of several batches, up to ``TOGETHER`` bytes, but one batch at least."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > TOGETHER:
            yield tuple(pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1))
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield tuple(pa.concat_arrays([x.column(i) for x in held]) for i in (0, 1))


def write_shards(docs: DataFrame, vocabulary: str, path: str | None = None, end_id: int = 0, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> str:
    """Encode every text, append the end id, and write the shards; gives their path.

    Rows: (part int, seq int, keys array, n_tokens long, shard binary); ordered by part and seq.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    kind = docs.schema[key].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held, keys, lengths, parts = TaskContext.get().partitionId(), 0, 0, [], [], []

        def close() -> pa.RecordBatch:
            shard = WaveletMatrix.build(np.frombuffer(b"".join(parts), "<u4"), lengths)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([keys], pa.list_(key_type)), pa.array([held], pa.int64()), pa.array([shard], pa.binary())], names=["part", "seq", "keys", "n_tokens", "shard"])

        for own, texts in _together(batches):
            key_type = own.type
            for k, raw in zip(own.to_pylist(), encoder(vocabulary).encode_all(texts), strict=True):
                ids = raw + end
                keys.append(k)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
                if held >= shard_tokens:
                    yield close()
                    seq, held, keys, lengths, parts = seq + 1, 0, [], [], []
        if keys:
            yield close()

    ordered = docs.select(key, text).repartitionByRange(F.col(key)).sortWithinPartitions(key, text)
    by_batches(ordered, run, f"part int, seq int, keys array<{kind}>, n_tokens long, shard binary").write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def read_shards(spark, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start long, n_tokens long, ids_crc32 long) of each document, from the files alone."""
    shards = spark.read.parquet(path)
    kind = shards.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, keys, raw in zip(*(batch.column(i) for i in range(4)), strict=True):
                matrix = WaveletMatrix(raw.as_py())
                ids = memoryview(matrix.tokens().astype("<u4")).cast("B")
                ends = np.cumsum(matrix.lengths)
                starts = ends - matrix.lengths
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * n, pa.int32()), pa.array([seq.as_py()] * n, pa.int32()), keys.values, pa.array(starts), pa.array(matrix.lengths), pa.array(crc, pa.int64())], names=["part", "seq", key, "start_in_shard", "n_tokens", "ids_crc32"])

    rows = by_batches(shards.select("part", "seq", "keys", "shard"), run, f"part int, seq int, `{key}` {kind}, start_in_shard long, n_tokens long, ids_crc32 long")
    sizes = shards.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    before_shard = sizes.withColumn("in_part", F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n"))
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each partition written
    before_part = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("to_part"))
    base = before_shard.join(before_part, "part").select("part", "seq", (F.col("to_part") + F.col("in_part")).alias("base"))
    return rows.join(base, ["part", "seq"]).select(key, (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def token_count(spark, path: str, tokens: list[int]) -> DataFrame:
    """(token int, n long): occurrences of tokens in all shards, by rank on the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                matrix = WaveletMatrix(raw.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int32()), pa.array([matrix.count(t) for t in tokens], pa.int64())], names=["token", "n"])

    found = by_batches(spark.read.parquet(path).select("shard"), run, "token int, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n"))
