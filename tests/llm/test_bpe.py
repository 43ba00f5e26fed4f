import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

from shutterloom.llm import bpe, queries
from shutterloom.llm.queries import BYTE_BPE


def test_ids_and_text_against_library():
    own, library, rnd = bpe.load(BYTE_BPE), Tokenizer.from_file(BYTE_BPE), random.Random(1)
    letters = [*" \n\t\r\x0b\x1c\x85\xa0　abcde'strevlmd12½äß漢😀!.-", "<|endoftext|>", "  ", "\n\n", "====", "'ll", "\x00"]
    for _ in range(5000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 25)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
    for _ in range(3000):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 6))]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_token_encodes_to_itself():
    own = bpe.load(BYTE_BPE)
    for token, raw in enumerate(own.bytes_of[:50256]):
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if own.pre_tokens.fullmatch(text):
            assert own._piece(text) == np.uint32(token).tobytes()


def test_frames(spark):
    docs = spark.createDataFrame([(1, "Hello wörld", "a"), (2, None, "b"), (None, "", None), (1, "Hello wörld", "a")], "doc_id long, text string, ids string")
    rows = bpe.bpe_round_trip(docs, BYTE_BPE).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [(0, 0, ""), (1, 4, "Hello wörld"), (1, 4, "Hello wörld"), (2, 0, "")]
    encoded = bpe.bpe_encode(docs, BYTE_BPE)
    assert sorted(r.decoded for r in bpe.bpe_decode(encoded, BYTE_BPE).collect()) == ["", "", "Hello wörld", "Hello wörld"]
    assert bpe.bpe_encode(docs.limit(0), BYTE_BPE).count() == 0


def test_query_against_library(spark):
    sf, library = "/root/testdata/sf0.001", Tokenizer.from_file(BYTE_BPE)
    expected = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, sf).collect()) == sorted(expected)
