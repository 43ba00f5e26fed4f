"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for operators and stages."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import bpe, decontam, quality, rlindex, secrets, simhash, tokencount, wavelet
from shutterloom.llm.queries import BYTE_BPE, PIECES

SF = "/root/testdata/sf0.001"
NAMES = ["_first", "_blob", "_spans", "_judgement", "judgement", "quality_judgement", "blob", "spans", "rules", "row", "rank", "nth", "named", "runs", "key", "digest", "class", "stays", "component", "content", "n", "id", "fp", "gram", "grams", "ids", "n_tokens", "bucket", "place", "anchor", "score", "item_id"]
OPERATORS = {
    "bpe": lambda d: bpe.bpe_round_trip(d, BYTE_BPE),
    "simhash": simhash.link_fingerprints,
    "secrets": secrets.findings,
    "tokens": lambda d: tokencount.token_counts(d, PIECES),
    "quality": lambda d: quality.judged(d, quality.Model((), (), ())),
    "repeats": rlindex.remove_repeats,
    "wavelet": lambda d: wavelet.read_shards(d.sparkSession, wavelet.write_shards(d, BYTE_BPE)),
}


@pytest.fixture(scope="module")
def odd(spark):
    plain = [" ".join(f"w{(7 * i * i + 3 * k) % 1009}" for i in range(60)) for k in range(3)]
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, plain[0]), (4, plain[0]), (4, plain[1]), (5, plain[0] + " more"), (None, plain[2]), (None, None), (6, "password = abcdefgh12 " + plain[2]), (7, " ".join(f"u{i}" for i in range(40_000))), (8, "x" * 300_000)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, i) for i, (k, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, nr int")
    return docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("nr").cast("string")).alias(n) for n in NAMES)).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(odd, name):
    rows = OPERATORS[name](odd).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.select("doc_id").collect())
    assert OPERATORS[name](odd.limit(0)).count() == 0


def test_found_copies(odd, spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.contaminated(odd, items).count() == decontam.contaminated(odd.limit(0), items).count() == 0
    assert decontam.clean(odd, items).count() == odd.count()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd.limit(0), SF).count() == 0
    out = stage(spark, odd, SF)
    if name == "encoding":
        assert out.count() == odd.count()
        return
    assert out.columns == odd.columns
    rows, before = out.collect(), {r.nr: r for r in odd.collect()}
    for r in rows:
        for c in odd.columns:
            assert c in ("text", "n_chars") or r[c] == before[r.nr][c]
    kept = sorted(r.nr for r in rows)
    if name == "near_dedup":  # texts without words are one group; 4 has two texts; 5 is a copy of one of them
        assert kept == [0, 3, 5, 7, 8, 9, 10, 11]
    if name == "secret_scan":
        assert kept == sorted(before) and {r.nr: r.text for r in rows}[9].startswith("<secret> w6 ")
        assert all(r.text == before[r.nr].text for r in rows if r.nr != 9)
