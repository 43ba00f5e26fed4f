"""Toxicity: held-out accuracy, features by hand, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from shutterloom.llm import toxicity
from shutterloom.llm.queries import op11_toxicity


def test_features_by_hand():
    words = toxicity.Words({"idiot.": 0.9, "moron.": 0.9, "fool.": 0.5})
    x = dict(zip(toxicity.NAMES, toxicity.features("YOU idiot!! the fool and m0r0n saw iiidiot. far far far far away idiot", words), strict=True))
    assert x["strong_a_word"] == 4 / 14 and x["weak_a_word"] == 1 / 14 and x["found_in_disguise_a_word"] == 2 / 14
    assert x["strong_near_you"] == 3 / 14 and x["you_a_word"] == 1 / 14 and x["shouted_a_word"] == 1 / 14
    assert x["marks_a_word"] == 2 / 14 and x["mark_runs_a_word"] == 1 / 14 and x["disguised_a_word"] == 2 / 14
    assert toxicity.features(None, words) == toxicity.features(" \n", words) == [0.0] * len(toxicity.NAMES)


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    got = op11_toxicity(spark, sf_dir)
    rows = got.toPandas()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count() and rows["score"].between(0, 1).all()
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    y, score = held["toxic"].to_numpy() == 1, held["score"].rank().to_numpy()
    area = (score[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert area > 0.95 and held["predicted"][y].mean() > 0.85 and held["predicted"][~y].mean() < 0.02
    # calibrated: scores are shares
    assert abs(held["score"].mean() - y.mean()) < 0.02 and np.mean((held["score"] - y) ** 2) < 0.03


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"{'vile idiot' if i % 4 == 0 else 'good day'} number {i} {'x' * (i % 5)}", "s") for i in range(200)] + [(None, "vile idiot", "s"), (900, None, "s"), (901, "", "s"), (902, "word " * 200_000, "s"), (4, "vile idiot again", "s"), (4, "vile idiot again", "s")], "doc_id long, text string, SCORE string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (900, None), (5555, 1), (8, 0), (900, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert [r["predicted"] for r in got if r["doc_id"] is None] == [1]
    for some, score in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0 and doc_id <> 8"), 0.0)):
        assert {r["score"] for r in toxicity.scored(docs.select("doc_id", "text"), toxicity.fit(docs, some)).collect()} == {score}
    assert toxicity.scored(docs.limit(0), model).collect() == [] and "toxic" not in labels.where(F.lit(False)).collect()
