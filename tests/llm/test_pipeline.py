import corpus_pipeline
from test_simhash import brute_components
from tokenizers import Tokenizer

from shutterloom.llm import simhash


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        at[name] = docs.collect()
        assert name == "encoding" or docs.columns == columns
    good = {r.doc_id: set(simhash.shingles_of(simhash.words_of(r.text), 5)) for r in at["quality_rules"]}
    classes = brute_components(good, lambda a, b: similar(good[a], good[b]))
    assert {r.doc_id for r in at["near_dedup"]} == set(classes.values())
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = {r.doc_id for r in at["decontamination"]}
    assert left and not any(i in r.text for r in at["decontamination"] for i in items)
    assert {r.doc_id for r in at["secret_scan"]} == left == {r.doc_id for r in at["encoding"]}
    library, texts = Tokenizer.from_file(corpus_pipeline.VOCABULARY), {r.doc_id: r.text for r in at["secret_scan"]}
    assert all(r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids for r in at["encoding"])


def test_odd_rows(spark, sf_dir):
    text = "plain words make a text that is long enough to stay in here and has no twin at all " * 2
    rows = [(1, None, "en", "s", 0, 1), (2, "", "en", "s", 0, 1), (None, "a b c d e f g h i j k l m n", None, None, None, 1), (3, text, "en", "s", 5, 1), (3, text, "en", "s", 5, 1), (4, text + " now", "en", "s", 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, class int")
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 1), (False, 3), (True, 0)]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id < 0"), sf_dir).count() == 0
        stage(spark, docs, sf_dir).collect()
