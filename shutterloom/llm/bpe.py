"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token exactly one vocabulary token can be the last one of its BPE
encoding. An automaton over the vocabulary lists the tokens that are suffixes of each prefix; the
one that is compatible with the last token of the remaining prefix is stored. Following these
back-pointers from the end gives the exact ids, in time linear in the text whatever its merges.

Two tokens are compatible if no merge across their border would have come before the merges that
built them. Let a be the piece at the right edge of the left token and b the piece at the left edge
of the right one, at some moment of the merging. The pair (a, b) merges then if its rank is below
that of the merge which swallows a, and not above that of the merge which swallows b (the leftmost
pair goes first on equal ranks). Undoing the two tokens' merges from the latest to the earliest
visits all such moments.

Defined results: a null text counts as empty and gives no ids; added tokens such as
``<|endoftext|>`` inside a text become their own ids; ids unknown to the vocabulary decode to
nothing; equal texts give equal rows, one for each input row.
"""

from __future__ import annotations

import json
import re
import string
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.llm.common import by_batches

#: Fixed value: how byte-level BPE splits a text into pre-tokens.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries that a worker's caches hold at most; a full cache starts anew.
CHUNKS, PIECES, PAIRS = 300_000, 500_000, 400_000
NEVER = 1 << 60
PUNCTUATION = string.punctuation


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: printable Latin-1 bytes as
    themselves, the others as the code points from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Chunks(dict):
    """Chunk of a text to its ids as bytes; fills itself."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self.encode(chunk)
        if len(chunk) < 200:
            self[chunk] = out
        return out


class BPE:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        as_text = lambda token: "".join(chr(alphabet[c]) for c in token)
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocab = {as_text(k): v for k, v in model["vocab"].items() if k not in self.added}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes_of[i] = text.encode("latin-1")
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        self.pair_rank: dict[int, int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * size
        self.rank = [-1] * size
        for rank, merge in enumerate(model["merges"]):
            a, b = (as_text(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank.setdefault(left << 20 | right, rank)
            if self.parts[whole] is None:
                self.parts[whole], self.rank[whole] = (left, right), rank
        self._automaton()
        self.compatible: dict[int, bool] = {}
        self.pre_tokens = regex.compile(PRE_TOKENS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = Chunks(self._piece, PIECES)
        self.line_break = self._piece("\n")
        self.first = Chunks(self._chunk, CHUNKS // 8)
        self.spaced = Chunks(self._spaced, CHUNKS)
        self.runs = re.compile(r"\s\s")
        self.before_space = re.compile(r"(?<=\S)(?=\s)")

    def _automaton(self) -> None:
        """States are the prefixes of tokens; suffixes[state] lists the tokens that end there, the
        longest first, each with its length. Edges that leave the trie are added when first used."""
        self.edges: dict[int, int] = {}
        own, levels = [-1], [[]]
        for token, raw in enumerate(self.bytes_of):
            state = 0
            for depth, byte in enumerate(raw if token not in self.added.values() else b"", 1):
                to = self.edges.get(state << 8 | byte)
                if to is None:
                    to = self.edges[state << 8 | byte] = len(own)
                    own.append(-1)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((state, byte, to))
                state = to
            if state:
                own[state] = token
        self.fallback = [0] * len(own)
        self.suffixes: list[tuple] = [()] * len(own)
        in_trie = dict(self.edges)
        for level in levels[1:]:
            for parent, byte, state in level:
                down = parent
                while down:
                    down = self.fallback[down]
                    to = in_trie.get(down << 8 | byte)
                    if to is not None:
                        self.fallback[state] = to
                        break
                shorter = self.suffixes[self.fallback[state]]
                self.suffixes[state] = ((own[state], len(self.bytes_of[own[state]])), *shorter) if own[state] >= 0 else shorter

    def _edge(self, state: int, byte: int) -> int:
        down, to = state, None
        while to is None and down:
            down = self.fallback[down]
            to = self.edges.get(down << 8 | byte)
        self.edges[state << 8 | byte] = to or 0
        return to or 0

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a and b as they are when they stand side by side."""
        ranks, own, parts = self.pair_rank, self.rank, self.parts
        left_until = right_until = NEVER
        while True:
            merge = ranks.get(a << 20 | b)
            if merge is not None and merge < left_until and merge <= right_until:
                return False
            if own[a] > own[b]:
                left_until, a = own[a], parts[a][1]
            elif own[b] >= 0:
                right_until, b = own[b], parts[b][0]
            else:
                return True

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token, by the last token of each prefix."""
        raw = piece.encode()
        last, state = [-1] * (len(raw) + 1), 0
        edges, suffixes, known = self.edges, self.suffixes, self.compatible
        for i, byte in enumerate(raw, 1):
            to = edges.get(state << 8 | byte)
            state = self._edge(state, byte) if to is None else to
            for token, n in suffixes[state]:
                if n == i:
                    last[i] = token
                    break
                before = last[i - n]
                pair = before << 20 | token
                ok = known.get(pair)
                if ok is None:
                    if len(known) >= PAIRS:
                        known.clear()
                    ok = known[pair] = self.fits(before, token)
                if ok:
                    last[i] = token
                    break
        out, i = [], len(raw)
        while i:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return struct.pack(f"<{len(out)}I", *out[::-1])

    def _spaced(self, chunk: str) -> bytes:
        """A chunk without the space before it; most are a word, or a word and punctuation."""
        word = chunk.rstrip(PUNCTUATION)
        if word.isalpha():
            return self.pieces[" " + word] + (self.pieces[chunk[len(word) :]] if len(word) < len(chunk) else b"")
        return self._chunk(" " + chunk)

    def _chunk(self, chunk: str) -> bytes:
        if self.specials is None:
            return b"".join(map(self.pieces.__getitem__, self.pre_tokens.findall(chunk)))
        out = []
        for k, part in enumerate(self.specials.split(chunk)):
            if k % 2:
                out.append(struct.pack("<I", self.added[part]))
            else:
                out += map(self.pieces.__getitem__, self.pre_tokens.findall(part))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers. White space after another character begins
        a pre-token, so a text falls into chunks there; without runs of white space, a line break is
        a pre-token too."""
        if self.runs.search(text):
            return b"".join(map(self.first.__getitem__, self.before_space.split(text)))
        out, spaced = [], self.spaced.__getitem__
        for line in text.split("\n"):
            chunks = line.split(" ")
            out.append(self.first[chunks[0]])
            out += map(spaced, chunks[1:])
            out.append(self.line_break)
        return b"".join(out[:-1])

    def decode(self, ids: Iterable[int]) -> str:
        table, n = self.bytes_of, len(self.bytes_of)
        try:
            raw = b"".join(map(table.__getitem__, ids))
        except IndexError:
            raw = b"".join(table[i] for i in ids if 0 <= i < n)
        return raw.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> BPE:
    """One vocabulary a worker."""
    return BPE(path)


def bpe_round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids binary, decoded string): ids as little-endian unsigned 32-bit
    integers, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            texts = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(texts, pa.string())],
                names=[key, "n_tokens", "ids", "decoded"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return by_batches(docs.select(key, text), run, f"`{key}` {kind}, n_tokens long, ids binary, decoded string")


def bpe_encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens long, ids array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [bpe.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            counts = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            flat = np.frombuffer(b"".join(ids), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), lists], names=[key, "n_tokens", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return by_batches(docs.select(key, text), run, f"`{key}` {kind}, n_tokens long, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded string) from an array of ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return by_batches(encoded.select(key, F.col(ids)), run, f"`{key}` {kind}, decoded string")


def digests(round_trip: DataFrame, key: str = "doc_id") -> DataFrame:
    """The digest columns of a round trip."""
    return round_trip.select(key, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
