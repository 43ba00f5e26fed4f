import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shutterloom.llm import queries, wavelet
from shutterloom.llm.queries import BYTE_BPE
from shutterloom.llm.wavelet import WaveletMatrix


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (511, 300), (512, 50257), (5000, 7), (3000, 70000)])
def test_matrix_against_array(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    m = WaveletMatrix(WaveletMatrix.build(ids, [n]))
    assert m.tokens().tolist() == ids.tolist()
    for i in range(0, n, max(1, n // 50)):
        assert m.access(i) == ids[i]
        assert m.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
    for token in {*ids[:5].tolist(), 1 << 20}:
        assert m.occurrences(token) == np.flatnonzero(ids == token).tolist()


def test_files_against_library(spark):
    texts = [None, "", "a b", "a b", "ünïcode <|endoftext|> x  y\n", "word " * 3000, "!"]
    rows = [(k, t, "x") for k, t in zip([5, 3, 9, 1, 2, 7, None], texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keys string")
    path = wavelet.write_shards(docs, BYTE_BPE, shard_tokens=50)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in wavelet.read_shards(spark, path).collect()}
    library, at = Tokenizer.from_file(BYTE_BPE), 0
    for k, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert got[k] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    found = {r.token: r.n for r in wavelet.token_count(spark, path, [0, 257]).collect()}
    assert found[0] == len(rows) + 1
    assert wavelet.read_shards(spark, wavelet.write_shards(docs.limit(0), BYTE_BPE)).count() == 0


def test_encoder_against_library(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [None, "", "\nA b\nc", "x \n y", " a", "a ", "\n", "été, été!\nété", "a\tb c", "<|endoftext|> a<|endoftext|>", "w" * 500, "it's 'stand a_b x²!", "longer " * 200_000 + " end"]
    rnd = random.Random(3)
    letters = [*" \n\t\r\x0b\x1c\x85\xa0　abcde'strevlmd12½äß漢😀!.-_", "<|endoftext|>", "  ", "\n\n", "====", "'ll", "\x00"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    own, library = wavelet.encoder(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    expected = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(pa.array(texts))] == expected


def test_query_against_library(spark):
    sf = "/root/testdata/sf0.001"
    library, at, expected = Tokenizer.from_file(BYTE_BPE), 0, []
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op10_wavelet(spark, sf).collect()) == expected


def test_ends_of_chunks_are_read_from_their_bytes():
    library = Tokenizer.from_file(BYTE_BPE)
    words = ["straße", "naïve,", "x).", "e\u0301t", "日本、語", "...", "a1b2!", "w" * 70 + ";", "“q”", "don't", "İ.", "٣٤", "\ud55c?!"]
    texts = ["", "a", ".", None, " ".join(words), "\n".join(words), *(f"{w} {w}\n{w}" for w in words)]
    encoder = wavelet.LibraryEncoder(BYTE_BPE)
    for rows in (pa.array(texts), pa.array(["skipped, too", *texts]).slice(1), pa.array([""]), pa.array([], pa.string())):
        want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in rows.to_pylist()]
        assert encoder.encode_all(rows) == want
