"""Token counts by trie-shared dynamic programming.

The unigram model scores a segmentation by the sum of its pieces' scores; a pre-token's count is that
of its best segmentation (fewest tokens on equal scores). The forward score of a prefix depends on the
prefix alone, so the distinct pre-tokens of a batch are put in a trie and each node's best (score,
count) is computed once, from its ancestors; a pre-token's count is stored at its last node. Sorted
pre-tokens visit the trie in depth-first order, so only the path to the current node is held.

Pre-tokens are words, each with a mark in front as SentencePiece writes them. A character that no piece
holds counts as one token, or as its UTF-8 bytes if the vocabulary has byte pieces.

Defined results: null and empty texts have no tokens; repeated rows keep their row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shutterloom.llm.common import by_batches

#: Fixed value: the mark of a word's start.
MARK = "▁"
#: Pre-tokens whose counts a worker remembers; a full memory starts anew.
KNOWN = 400_000
#: Score of a character outside the vocabulary, below any piece.
UNKNOWN = -1e6


class Unigram:
    """Pieces with scores, by piece; ``bytes_too``: whether unknown characters fall to their bytes."""

    def __init__(self, scores: dict[str, float], bytes_too: bool = False):
        self.scores, self.bytes_too = scores, bytes_too
        self.longest = max(map(len, scores), default=1)
        by_end: dict[str, set[int]] = {}
        for piece in scores:
            by_end.setdefault(piece[-1], set()).add(len(piece))
        self.lengths = {c: sorted(n) for c, n in by_end.items()}
        self.known: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        """Store the counts of distinct words, in one walk over their trie."""
        scores, lengths, known = self.scores, self.lengths, self.known
        path, before = [(0.0, 0)], ""
        for word in sorted(words):
            text = MARK + word
            shared, most = 0, min(len(text), len(before))
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                last = text[end - 1]
                best = None
                for n in lengths.get(last, ()):
                    if n > end:
                        break
                    score = scores.get(text[end - n : end])
                    if score is not None:
                        s, c = path[end - n]
                        if best is None or s + score > best[0] or s + score == best[0] and c + 1 < best[1]:
                            best = (s + score, c + 1)
                if best is None or last not in scores:
                    s, c = path[end - 1]
                    alone = (s + UNKNOWN, c + (len(last.encode()) if self.bytes_too else 1))
                    best = alone if best is None or alone[0] > best[0] else best
                path.append(best)
            before = text
            known[word] = path[len(text)][1]


@lru_cache(maxsize=1)
def piece_model(path: str) -> Unigram:
    """Scores of a SentencePiece vocabulary file; control and unknown pieces are left out."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
    return Unigram({p.id_to_piece(i): p.get_score(i) for i in ids}, any(p.is_byte(i) for i in range(p.get_piece_size())))


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_pre_tokens long, n_tokens long) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            words = [t.split() if t else [] for t in batch.column(1).to_pylist()]
            distinct = set().union(*words)
            if len(model.known) > KNOWN:
                model.known.clear()
            model.learn(list(distinct - model.known.keys()))
            counts = [sum(map(model.known.__getitem__, x)) for x in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([len(x) for x in words], np.int64)), pa.array(np.array(counts, np.int64))], names=[key, "n_pre_tokens", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return by_batches(docs.select(key, text), run, f"`{key}` {kind}, n_pre_tokens long, n_tokens long")
