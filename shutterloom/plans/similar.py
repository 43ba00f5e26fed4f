"""Queries: hashes and embeddings, their pairs and groups, scores and choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterloom.functions import vectors as V
from shutterloom.operators import select, similar
from shutterloom.plans.common import table

#: Radius and cosine that give groups of a few members on the test vectors.
BITS, COSINE = 18, 0.40


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _hashes(spark, sf_dir):
    return _vectors(spark, sf_dir).select("id", "label", V.phash_bits(F.col("vector")).alias("hash"))


def q_phash_bits(spark, sf_dir):
    return _hashes(spark, sf_dir).select("id", F.lower(F.lpad(F.hex("hash"), 16, "0")).alias("phash"))


def q_hamming(spark, sf_dir):
    h = _hashes(spark, sf_dir)
    other = h.select((F.col("id") - 1).alias("id"), F.col("hash").alias("next"))
    return h.join(other, "id").select("id", V.hamming(F.col("hash"), F.col("next")).cast("bigint").alias("distance"))


def q_hamming_pairs(spark, sf_dir):
    return similar.hamming_pairs(_hashes(spark, sf_dir), BITS).select("a", "b", F.col("distance").cast("bigint").alias("distance"))


def q_components(spark, sf_dir):
    g = similar.groups_of(similar.hamming_links(_hashes(spark, sf_dir), BITS))
    return g.select("component", F.size("members").cast("bigint").alias("n"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


def q_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    other = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("next"))
    return v.join(other, "id").select("id", F.round(V.cosine(F.col("vector"), F.col("next")), 6).alias("similarity"))


def q_cosine_pairs(spark, sf_dir):
    return similar.cosine_pairs(_vectors(spark, sf_dir), COSINE).select("a", "b", F.round("similarity", 6).alias("similarity"))


def q_identity_clusters(spark, sf_dir):
    g = similar.groups_of(similar.cosine_links(_vectors(spark, sf_dir), COSINE))
    return g.select("component", F.array_join(F.array_sort(F.array_distinct(F.transform("members", lambda m: m % 50))), ",").alias("images"))


def q_l2_normalize(spark, sf_dir):
    v = V.l2_normalized(F.transform("vector", lambda x, i: x * (i % 3)))
    return _vectors(spark, sf_dir).select("id", F.round(F.get(v, F.lit(1)), 6).alias("x1"), F.round(V.dot(v, v), 6).alias("norm"))


def _lines(spark, sf_dir):
    """Line items as images of a burst, the order: quantity is sharpness."""
    t = table(spark, sf_dir, "lineitem")
    seq = F.col("l_partkey") * 100_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    sharp = F.when(F.col("l_partkey") % 23 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    return t.select(F.col("l_orderkey").alias("burst"), seq.alias("seq"), sharp.alias("sharpness"), "l_discount", "l_tax", "l_quantity")


def q_blur_filter(spark, sf_dir):
    kept = select.without_blurry(_lines(spark, sf_dir), "burst", "sharpness", 20.0)
    return kept.groupBy("burst").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


def _scored(spark, sf_dir):
    """A line is a face, lines of one image are its faces; both come from one table, so one aggregation has both."""
    closed = select.blink(F.col("l_discount") * 4, F.col("l_tax") * 8, F.lit(0.1))
    smile = F.when(F.col("l_quantity") > 10, F.col("l_discount") * 10)
    images = _lines(spark, sf_dir).groupBy("burst", "seq").agg(F.max("sharpness").alias("sharpness"), *select.face_counts(closed, smile))
    return select.with_total(images).select("burst", "seq", "blinks", "smile_avg", "total")


def q_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("burst", "seq", "blinks", F.round("smile_avg", 6).alias("smile_avg"), F.when(~F.isnan("total"), F.round("total", 6)).alias("total"))


def q_pick_best(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("total", F.round("total", 6))
    return select.best_of(rows, "burst", "total", "seq").select("burst", "seq")


def q_group_ids(spark, sf_dir):
    groups = _lines(spark, sf_dir).groupBy("burst").agg(F.count("*").alias("n")).where("n > 1")
    return select.group_names(groups, "burst").select("burst", "n", "group_id")


def q_cull_report(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    grouped = select.without_blurry(rows, "burst", "sharpness", 20.0)
    per = grouped.groupBy("burst").agg(F.count("*").alias("n"))
    scanned = rows.agg(F.count("*").alias("scanned"))
    many = select.without_blurry(rows, "burst", "sharpness", 0.0).agg(F.count("*").alias("many"), F.count_if(~(F.isnan("sharpness") | (F.col("sharpness") >= 20.0))).alias("dropped_blurry"))
    out = per.agg(F.sum("n").alias("grouped"), F.count("*").alias("best_count"), F.sum(F.col("n") - 1).alias("culled_count"))
    return scanned.crossJoin(many).crossJoin(out).select("scanned", "grouped", "best_count", "culled_count", "dropped_blurry")  # one row each


def _mesh():
    point = lambda i: F.array(F.get("vector", F.lit(i)).cast("double") * 10, F.get("vector", F.lit(i + 1)).cast("double") * 10)
    return F.array(*(point(2 * i) for i in range(16)))


def q_ear(spark, sf_dir):
    ear = V.eye_aspect_ratio(_mesh(), (0, 1, 2, 3, 4, 5), (6, 7, 8, 9, 10, 11), 16)
    return _vectors(spark, sf_dir).select("id", F.round(ear, 6).alias("ear"), F.round(V.smile(_mesh(), (12, 13, 14, 15), 16), 6).alias("smile"))


def q_ratio_decide(spark, sf_dir):
    share = V.share_above(F.col("vector"), 0.1)
    return _vectors(spark, sf_dir).select("id", F.round(share, 6).alias("share"), (share > 0.2).alias("has_text"))


def q_clamp(spark, sf_dir):
    value = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 7 == 1, F.lit(float("inf"))).otherwise(F.get("vector", F.lit(0)).cast("double") * 1000)
    return _vectors(spark, sf_dir).select("id", V.clamped(value, 90).alias("pixel"))


def q_laplacian(spark, sf_dir):
    found = select.laplacian_variances(_vectors(spark, sf_dir), "id", "vector", 8)
    return found.select("id", F.round("sharpness", 6).alias("sharpness"))


def _boxes(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    at = lambda i: F.get("vector", F.lit(i)).cast("double")
    x, y = F.round(at(0) * 20), F.round(at(1) * 20)
    return v.select(F.floor(F.col("id") / 25).alias("image"), F.col("id").alias("box"), x.alias("x1"), y.alias("y1"), (x + 8).alias("x2"), (y + 8).alias("y2"), at(2).alias("score"))


def q_nms(spark, sf_dir):
    return select.suppressed(_boxes(spark, sf_dir), "image", 0.4).select("image", "box")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_HASH = """m AS (SELECT vec_id AS id, embedding AS v, list_sort(embedding[2:64])[32] AS m FROM embeddings),
    h AS (SELECT id, v, CASE WHEN abs(m) < 1.1920929e-7 THEN 0::UBIGINT ELSE list_reduce(list_transform(range(64), lambda i: CASE WHEN v[i + 1] >= m THEN (1::UBIGINT << i::UBIGINT) ELSE 0::UBIGINT END), lambda x, y: x | y) END AS hash FROM m)"""
_PAIRS = f"{_HASH}, p AS (SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance FROM h a JOIN h b ON a.id < b.id AND bit_count(xor(a.hash, b.hash)) <= {BITS})"
_COS = f"v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= {COSINE})"
_CC = "e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other), k AS (SELECT node, min(other) AS component FROM r GROUP BY node)"
_LINES = "l AS (SELECT l_orderkey AS burst, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS seq, CASE WHEN l_partkey % 23 = 0 THEN CAST('nan' AS DOUBLE) ELSE l_quantity END AS sharpness, l_discount, l_tax, l_quantity FROM lineitem)"
_SHARP = "many AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY burst) AS n FROM l) WHERE n > 1), sharp AS (SELECT * FROM (SELECT burst, seq, sharpness, count(*) OVER (PARTITION BY burst) AS n FROM many WHERE isnan(sharpness) OR sharpness >= 20) WHERE n > 1)"
_SCORED = f"""{_LINES}, i AS (SELECT burst, seq, max(sharpness) AS sharpness, count(*) FILTER (coalesce(l_discount * 4 < 0.21, false) OR greatest(l_tax * 8, 0.1) > 0.5) AS blinks,
    coalesce(avg(CASE WHEN l_quantity > 10 THEN l_discount * 10 END), 0) AS smile_avg FROM l GROUP BY burst, seq), s AS (SELECT *, round(1.0 * sharpness - 2.0 * blinks + 0.5 * smile_avg, 6) AS total FROM i)"""
_AT = lambda k: f"(CAST(embedding[{2 * k + 1}] AS DOUBLE) * 10)"
_YT = lambda k: f"(CAST(embedding[{2 * k + 2}] AS DOUBLE) * 10)"
_D = lambda a, b: f"sqrt(power({_AT(a)} - {_AT(b)}, 2) + power({_YT(a)} - {_YT(b)}, 2))"
_EYE = lambda p: f"CASE WHEN {_D(p[0], p[3])} >= 1.1920929e-7 THEN ({_D(p[1], p[5])} + {_D(p[2], p[4])}) / (2 * {_D(p[0], p[3])}) END"
ORACLES = {
    "q_phash_bits": f"WITH {_HASH} SELECT id, lpad(lower(hex(hash)), 16, '0') AS phash FROM h",
    "q_hamming": f"WITH {_HASH} SELECT a.id, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance FROM h a JOIN h b ON b.id = a.id + 1",
    "q_hamming_pairs": f"WITH {_PAIRS} SELECT a, b, distance FROM p",
    "q_components": f"WITH RECURSIVE {_PAIRS}, {_CC} SELECT component, count(*) AS n, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS members FROM k GROUP BY component",
    "q_cosine": "WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON b.id = a.id + 1",
    "q_cosine_pairs": f"WITH {_COS} SELECT a, b, similarity FROM p",
    "q_identity_clusters": f"WITH RECURSIVE {_COS}, {_CC}, i AS (SELECT DISTINCT component, node % 50 AS image FROM k) SELECT component, string_agg(CAST(image AS VARCHAR), ',' ORDER BY image) AS images FROM i GROUP BY component",
    "q_l2_normalize": "WITH v AS (SELECT vec_id AS id, list_transform(range(64), lambda i: CAST(CAST(embedding[i + 1] * (i % 3) AS FLOAT) AS DOUBLE)) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT id, round(v[2] / n, 6) AS x1, round(1.0::DOUBLE, 6) AS norm FROM n",
    "q_blur_filter": f"WITH {_LINES}, {_SHARP} SELECT burst, count(*) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM sharp GROUP BY burst",
    "q_score": f"WITH {_SCORED} SELECT burst, seq, blinks, round(smile_avg, 6) AS smile_avg, CASE WHEN NOT isnan(total) THEN total END AS total FROM s",
    "q_pick_best": f"WITH {_SCORED} SELECT burst, seq FROM (SELECT *, row_number() OVER (PARTITION BY burst ORDER BY isnan(total), total DESC, seq DESC) AS r FROM s) WHERE r = 1",
    "q_group_ids": f"WITH {_LINES}, g AS (SELECT burst, count(*) AS n FROM l GROUP BY burst HAVING count(*) > 1) SELECT burst, n, format('group-{{:03d}}', row_number() OVER (ORDER BY burst)) AS group_id FROM g",
    "q_cull_report": f"WITH {_LINES}, {_SHARP}, g AS (SELECT burst, count(*) AS n FROM sharp GROUP BY burst) SELECT (SELECT count(*) FROM l) AS scanned, CAST(sum(n) AS BIGINT) AS grouped, count(*) AS best_count, CAST(sum(n - 1) AS BIGINT) AS culled_count, (SELECT count(*) FROM many WHERE NOT (isnan(sharpness) OR sharpness >= 20)) AS dropped_blurry FROM g",
    "q_ear": f"""SELECT vec_id AS id, round(({_EYE((0, 1, 2, 3, 4, 5))} + {_EYE((6, 7, 8, 9, 10, 11))}) / 2, 6) AS ear,
        round(CASE WHEN {_D(12, 13)} >= 1.1920929e-7 THEN greatest(0.0, -(({_YT(12)} + {_YT(13)}) / 2 - ({_YT(14)} + {_YT(15)}) / 2) / {_D(12, 13)}) ELSE 0.0 END, 6) AS smile FROM embeddings""",
    "q_ratio_decide": "WITH s AS (SELECT vec_id AS id, len(list_filter(embedding, lambda x: CAST(x AS DOUBLE) > 0.1)) / 64.0::DOUBLE AS share FROM embeddings) SELECT id, round(share, 6) AS share, share > 0.2 AS has_text FROM s",
    "q_clamp": "WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN vec_id % 7 = 1 THEN CAST('inf' AS DOUBLE) ELSE CAST(embedding[1] AS DOUBLE) * 1000 END AS x FROM embeddings) SELECT id, CAST(CASE WHEN isnan(x) OR x <= 0 THEN 0 WHEN x >= 90 THEN 90 ELSE floor(x) END AS BIGINT) AS pixel FROM v",
    "q_laplacian": """WITH p AS (SELECT vec_id AS id, i // 8 AS y, i % 8 AS x, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range(64) t(i)),
        l AS (SELECT p.id, n.v + s.v + w.v + e.v - 4 * p.v AS d FROM p JOIN p n ON n.id = p.id AND n.x = p.x AND n.y = (p.y + 7) % 8 JOIN p s ON s.id = p.id AND s.x = p.x AND s.y = least(p.y + 1, 7)
        JOIN p w ON w.id = p.id AND w.y = p.y AND w.x = (p.x + 7) % 8 JOIN p e ON e.id = p.id AND e.y = p.y AND e.x = least(p.x + 1, 7)) SELECT id, round(greatest(0.0, avg(d * d) - avg(d) * avg(d)), 6) AS sharpness FROM l GROUP BY id""",
    "q_nms": """WITH RECURSIVE b AS (SELECT vec_id // 25 AS image, vec_id AS box, round(CAST(embedding[1] AS DOUBLE) * 20) AS x, round(CAST(embedding[2] AS DOUBLE) * 20) AS y, row_number() OVER (PARTITION BY vec_id // 25 ORDER BY CAST(embedding[3] AS DOUBLE) DESC, vec_id) AS r FROM embeddings),
        o AS (SELECT p.image, p.r AS hi, q.r AS lo FROM b p JOIN b q ON q.image = p.image AND q.r > p.r WHERE greatest(8 - abs(p.x - q.x), 0) * greatest(8 - abs(p.y - q.y), 0) / (128 - greatest(8 - abs(p.x - q.x), 0) * greatest(8 - abs(p.y - q.y), 0)) > 0.4),
        s AS (SELECT image, 1 AS r, [1] AS kept FROM b WHERE r = 1 UNION ALL SELECT s.image, s.r + 1, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.image = s.image AND o.lo = s.r + 1 AND list_contains(s.kept, o.hi)) THEN s.kept ELSE list_append(s.kept, CAST(s.r + 1 AS INTEGER)) END FROM s JOIN b ON b.image = s.image AND b.r = s.r + 1),
        f AS (SELECT image, arg_max(kept, r) AS kept FROM s GROUP BY image) SELECT b.image, b.box FROM b JOIN f ON f.image = b.image AND list_contains(f.kept, b.r)""",
}
