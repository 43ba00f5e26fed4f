import hashlib
import random

import pytest

from shutterloom.llm import rlindex
from shutterloom.llm.queries import op9_repeats


def brute(texts, window):
    """(n_bytes, n_removed, n_spans, kept) of each text."""
    seen, out = {}, []
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for i in range(len(raw) - window + 1):
            seen[raw[i : i + window]] = seen.get(raw[i : i + window], 0) + 1
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if seen[raw[i : i + window]] > 1:
                gone[i : i + window] = b"\x01" * window
        spans = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(raw), sum(gone), spans, bytes(b for b, x in zip(raw, gone, strict=True) if not x)))
    return out


def rows(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


@pytest.mark.parametrize("limit", [512, 3])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(rlindex, "BLOCK_CONTEXTS", limit)
    monkeypatch.setattr(rlindex, "COMMON", limit)
    rnd = random.Random(limit)
    letters = "abcdefgh ä\x00é漢"
    passage = ["".join(rnd.choice(letters) for _ in range(rnd.randint(90, 400))) for _ in range(6)]
    texts = [None, "", "short", "a" * 700, "ab" * 300, "ab" * 99 + "a", "x" * 199, "x" * 200]
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            p = rnd.choice(passage)
            cut = rnd.randint(0, len(p) // 3)
            parts += [p[cut:], "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))]
        texts.append("".join(parts))
    texts += texts[10:14]
    keys = [None, *range(1, len(texts))]
    keys[-1] = 5
    docs = spark.createDataFrame(list(zip(keys, texts, texts, strict=True)), "doc_id long, text string, digest string").repartition(7)
    want = sorted((k if k is not None else -1, *v) for k, v in zip(keys, brute(texts, 200), strict=True))
    assert rows(rlindex.remove_repeats(docs)) == want


def test_anchors_with_many_contexts(spark, monkeypatch):
    """Passages of 150 to 230 bytes that share their middle stand between different texts: an anchor then has
    as many contexts as documents, and parts have to be halved more than once."""
    monkeypatch.setattr(rlindex, "COMMON", 3)
    rounds, halves = [], rlindex._halves
    monkeypatch.setattr(rlindex, "_halves", lambda rows, window: rounds.append(1) or halves(rows, window))
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, left, right = word(230), [word(60) for _ in range(3)], [word(60) for _ in range(3)]
    texts = []
    for i in range(70):
        cut = rnd.choice([0, 0, 40, 80])
        texts.append(word(50) + (rnd.choice(left)[rnd.randint(0, 59) :] if i % 3 else "") + passage[cut // 2 : 230 - cut // 2] + (rnd.choice(right)[: rnd.randint(0, 59)] if i % 2 else "") + word(50))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(rlindex.remove_repeats(docs)) == sorted((k, *v) for k, v in enumerate(brute(texts, 200)))
    assert len(rounds) > 2


def test_pieces_of_long_texts(spark, monkeypatch):
    rnd = random.Random(2)
    long = "".join(rnd.choice("abc ") for _ in range(6000))
    monkeypatch.setattr(rlindex, "PIECE", 1000)
    texts = [long, long[1000:3100] + "!" + long[4000:4300], "zz" + long[900:1200]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(rlindex.remove_repeats(docs)) == sorted((k, *v) for k, v in enumerate(brute(texts, 200)))
    assert rlindex.remove_repeats(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: (a, b, c, hashlib.sha256(k).hexdigest()) for r, (a, b, c, k) in zip(docs, brute([r.text for r in docs], 200), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_repeats(spark, sf_dir).collect()} == want
