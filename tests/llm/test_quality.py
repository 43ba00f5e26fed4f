from pyspark.sql import functions as F
import re

from shutterloom.llm import quality
from shutterloom.llm.queries import op7_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in op7_quality(spark, sf_dir).collect():
        assert tuple(r)[1:7] == brute(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e x", "a " * 30, "l1 w\nl1 w\n\n\nl1 w\n ", "é#漢 $|<>& " * 3, "x\x0by\x0cz\r", "w " * 20000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    s = docs.select("doc_id", quality.statistics(docs.text).alias("s")).collect()
    for r in s:
        assert (r.s.n_words, r.s.word_chars, r.s.n_symbols, r.s.n_dup_lines, r.s.n_repeat_words) == brute(texts[r.doc_id])[:5]
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, empty)
    assert model == quality.Model((), (), ())
    assert [r.quality_judgement.kept for r in quality.judged(docs, model).orderBy("doc_id").collect()] == [not brute(t)[5] for t in texts]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    held = quality.judged(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), model).selectExpr("quality = 0 as low", "toxic = 1 as toxic", "not quality_judgement.kept as out", "quality_judgement.base_failed as base").collect()
    bad, clean = [r for r in held if r.low or r.toxic], [r for r in held if not (r.low or r.toxic)]
    print(*model.rules, len(model.markers), len(model.hints), sum(r.out for r in bad) / len(bad), sum(r.out for r in clean) / len(clean), sep="\n")
    assert sum(r.out for r in bad) >= 0.9 * len(bad)
    assert sum(r.out for r in clean) <= 0.03 * len(clean)
    assert sum(r.out and not r.base for r in clean) <= 0.01 * len(clean)


def test_bounded_sample_and_conflicting_labels(spark):
    good, bad = "many calm words follow each other in a long and quiet line of text", "xxxx%% " * 20
    docs = spark.createDataFrame([(i % 60, good if i % 2 else bad) for i in range(1800)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 60, i % 2, 0) for i in range(240)] + [(1, 0, 1), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for rows in (10, 60):
        model = quality.fit(docs, labels, rows=rows)
        found = quality.judged(docs.withColumn("quality_judgement", F.lit(1)), model).where("doc_id <> 1")
        assert found.where("quality_judgement.kept <> (doc_id % 2 = 1)").count() == 0
    assert quality.fit(docs.limit(0), labels).rules == quality.fit(docs, labels.limit(0)).rules == ()
