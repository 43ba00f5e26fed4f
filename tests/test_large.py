import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.functions import paths
from shutterloom.operators import select, similar


def test_group_names_when_ranges_are_sampled_anew(spark):
    """As on large tables: each reader of the ranges has them sampled for itself."""
    rows = spark.range(0, 600_000, 1, 8).select((F.col("id") % 299_993).alias("burst"))
    groups = rows.groupBy("burst").agg(F.count("*").alias("n")).where("n > 1")
    conf = ("spark.sql.exchange.reuse", "spark.sql.adaptive.coalescePartitions.enabled")
    for k in conf:
        spark.conf.set(k, "false")
    try:
        named = select.group_names(groups, "burst").selectExpr("count(*)", "count_if(group_id = format_string('group-%03d', burst + 1))", "sum(n)")
        assert tuple(named.first()) == (299_993, 299_993, 600_000)
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_plan_of_addresses_stays_small(spark):
    known = {
        "smb://u@h:445/s%20t/p/q": ("smb", "u", "h", 445, "s t", None, None, None, "/p/q", None),
        "smb://[::1]:70000/s/p": ("smb", None, None, None, None, None, None, None, None, "bad_port"),
        "mtp://d/s/a%zz": ("mtp", None, None, None, None, None, None, None, None, "bad_escape"),
        "ADB://x/p": ("adb", None, None, None, None, None, None, "x", "/p", None),
        "/a": ("local", None, None, None, None, None, None, None, "/a", None),
        "": ("local", None, None, None, None, None, None, None, "", None),
        None: None,
    }
    parsed = spark.createDataFrame([(u,) for u in known], "uri string").select("uri", paths.location(F.col("uri")).alias("loc"))
    assert len(parsed._jdf.queryExecution().optimizedPlan().expressions().toString()) < 30_000
    assert {r.uri: r["loc"] and tuple(r["loc"]) for r in parsed.collect()} == known


@pytest.mark.parametrize("most", [0, 2, 10, 18, 64])
def test_hamming_pairs_and_links(spark, monkeypatch, most):
    monkeypatch.setattr(similar, "FEW_HASHES", 40)
    rng = random.Random(most)
    centres = [rng.getrandbits(64) for _ in range(12)]
    hashes = [c ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 0, 1, 2, 6, 12, 18, 30]))) for c in centres for _ in range(15 if most < 64 else 4)]
    ids = rng.sample(range(10_000), len(hashes))
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in zip(ids, hashes, strict=True)]
    df = spark.createDataFrame([*rows, (10_001, None), (10_002, None)], "id long, hash long")
    want = {(min(i, j), max(i, j), (g ^ h).bit_count()) for i, g in zip(ids, hashes, strict=True) for j, h in zip(ids, hashes, strict=True) if i != j and (g ^ h).bit_count() <= most}
    got = [tuple(r) for r in similar.hamming_pairs(df, most).collect()]
    assert len(got) == len(want) and set(got) == want
    group = {i: i for i in ids}
    for _ in ids:
        for a, b, _ in want:
            group[a] = group[b] = min(group[a], group[b])
    members = {}
    for i, g in group.items():
        members.setdefault(g, []).append(i)
    groups = similar.groups_of(similar.hamming_links(df, most))
    assert {r.component: r.members for r in groups.collect()} == {g: sorted(m) for g, m in members.items() if len(m) > 1}


def test_hashes_of_wide_radii_meet_no_more_often_than_there_are_pairs(spark):
    df = spark.range(100).selectExpr("id", "xxhash64(id) AS hash")
    assert "Join" not in similar.hamming_pairs(df, 18)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [6, 9, 10, 11])
def test_balls_around_blocks_of_bits(spark, monkeypatch, most):
    """Same pairs as all with all; in spread-out hashes few of them meet."""
    rng = random.Random(most)
    hashes = [rng.getrandbits(64) for _ in range(400)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(14))) for h in hashes[:150] for _ in range(2)] + hashes[:20]
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    df = spark.createDataFrame(rows, "id long, hash long")
    want = {(i, j, (g ^ h).bit_count()) for i, g in enumerate(hashes) for j, h in enumerate(hashes) if i < j and (g ^ h).bit_count() <= most}
    spread = spark.createDataFrame([(i, rng.getrandbits(64) - (1 << 63)) for i in range(3000)], "id long, hash long")
    itself = 3000 * (3 + 21 + 21 + 22)  # a hash meets itself on each point of its smaller balls
    assert similar._meetings(*similar._balls(spread, most, "hash")) - itself < 0.01 * 3000**2
    monkeypatch.setattr(similar, "BALL_ROWS", 1)
    monkeypatch.setattr(similar, "MOST_MET", 1.0)
    monkeypatch.setattr(similar, "_tiles", lambda *a: pytest.fail("balls are enough"))
    got = [tuple(r) for r in similar.hamming_pairs(df, most).collect()]
    assert len(got) == len(want) and set(got) == want


def test_hot_blocks_of_bits_are_compared_whole(spark, monkeypatch):
    """Where many hashes share a block, more would meet on it than there are pairs worth comparing."""
    monkeypatch.setattr(similar, "BALL_ROWS", 1)
    used = []
    monkeypatch.setattr(similar, "_tiles", lambda rows, *a: used.append(1) or rows.selectExpr("id AS p", "id AS q", "0 AS distance"))
    similar.hamming_pairs(spark.range(2000).selectExpr("id", "shiftleft(id, 44) AS hash"), 10)
    assert used == [1]


@pytest.mark.parametrize("least,spread", [(0.9, 0.05), (0.4, 0.3)])
def test_cosine_by_blocks_of_neighbours(spark, monkeypatch, least, spread):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + rng.normal(size=(60, 16)) * spread for c in centres / np.linalg.norm(centres, axis=1)[:, None]]) * rng.uniform(0.1, 9, (720, 1))
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(rng.permutation(5000), x, strict=False)]
    rows += [(9000, [0.0] * 16), (9001, [float("nan")] * 16), (9002, []), (9003, None), (9004, [1e200] * 16), (9005, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if i < 9000 or i == 9005]
    want = {(min(i, j), max(i, j)) for a, (i, u) in enumerate(good) for j, v in good[a + 1 :] if u @ v >= least}
    seen, own = [], similar._block_pairs
    monkeypatch.setattr(similar, "_block_pairs", lambda blocks, *a: (seen.append((blocks.count(), (p := own(blocks, *a)).count())), p)[1])
    got = similar.cosine_pairs(df, least, block=40).collect()
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    blocks, pairs = seen[0]
    assert blocks >= 18 and (least < 0.5 or pairs < 0.4 * blocks * (blocks + 1) / 2)
    members = lambda edges: {r.component: r.members for r in similar.groups_of(edges).collect()}
    links = similar.cosine_links(df, least, block=40)
    assert links.count() <= len(want) and members(links) == members(spark.createDataFrame(sorted(want), "a long, b long"))
    assert similar.cosine_pairs(df.limit(0), least).collect() == []


def _shuffled(spark, run) -> int:
    """Bytes that the stages of ``run`` write to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        jvm, gateway = spark._jvm, spark.sparkContext._gateway
        found = sc.statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    last = max(stages(), default=-1)
    run()
    return sum(n for k, n in stages().items() if k > last)


def _spread_out(spark, n):
    rng = np.random.default_rng(n)
    return spark.createDataFrame([(i, r) for i, r in enumerate(rng.normal(size=(n, 64)).tolist())], "id long, vector array<float>")


def _growth(spark, join) -> float:
    few, many = (_shuffled(spark, lambda n=n: join(_spread_out(spark, n), 0.4, block=40).count()) for n in (1600, 6400))
    return many / few


def test_cosine_links_shuffle_in_proportion_to_the_rows(spark):
    """Four times the rows without clusters: blocks went to as many tasks as there are blocks."""
    assert _growth(spark, similar.cosine_links) < 6


def test_cosine_pairs_shuffle_in_proportion_to_the_rows(spark):
    assert _growth(spark, similar.cosine_pairs) < 6


def test_cosine_pairs_shuffle_a_row_once_a_stripe_at_most(spark):
    """Whatever the number of blocks, here 160 of rows that stand four times each; besides, for the sort and the join."""
    one = _spread_out(spark, 1600)
    df = one.crossJoin(spark.range(4).select(F.col("id").alias("copy"))).selectExpr("id + 1600 * copy AS id", "vector")
    found = []
    sent = _shuffled(spark, lambda: found.append(similar.cosine_pairs(df, 0.4, block=40).count()))
    assert sent < (similar.STRIPES + 4) * 6400 * (64 * 4 + 8)
    assert found == [16 * similar.cosine_pairs(one, 0.4, block=40).count() + 1600 * 6]


def test_cosine_pairs_close_to_the_least_similarity(spark, monkeypatch):
    """Single precision can't tell these apart; and vectors of several lengths, the longer ones not in the sample."""
    monkeypatch.setattr(similar, "SAMPLE_ROWS", 1)
    cosines = [0.4 + d for d in (-1e-6, -1e-9, -1e-12, 1e-12, 1e-9, 1e-6)]
    rows = [(0, [1.0])] + [(i, [c, *[0.0] * i, math.sqrt(1 - c * c)]) for i, c in enumerate(cosines, 1)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = similar.cosine_pairs(df, 0.4, block=2).where("a = 0").collect()
    assert {r.b: r.similarity for r in got} == pytest.approx({i: cosines[i - 1] for i in (4, 5, 6)}, abs=1e-14)
