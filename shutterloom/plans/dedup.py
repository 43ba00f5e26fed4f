"""Queries: equal files, new files, delete plans, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterloom.operators import dedup
from shutterloom.plans.common import FILES_SQL, files


def _hashed(spark, sf_dir, secure=True):
    return dedup.hashed(files(spark, sf_dir), secure)


def _sides(spark, sf_dir):
    """Source files, and the third of all files that plays the output."""
    rows = _hashed(spark, sf_dir)
    output = F.col("doc_id") % 3 == 0  # the archive is this part by definition
    return rows.where(~output), rows.where(output)


def q_find_secure(spark, sf_dir):
    return dedup.duplicate_groups(_hashed(spark, sf_dir)).select("size", "n", F.array_join("paths", "|").alias("paths"))


def q_find_fast(spark, sf_dir):
    return dedup.duplicate_groups(_hashed(spark, sf_dir, False)).select("size", "n", F.array_join("paths", "|").alias("paths"))


def q_fast_bucket(spark, sf_dir):
    rows = _hashed(spark, sf_dir, False).groupBy("fast").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))
    return rows.where("n > 1").select("n", "first_path")


def q_dup_groups(spark, sf_dir):
    groups = dedup.classes(_hashed(spark, sf_dir))
    return groups.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_files"), F.sum(F.col("size") * (F.col("n") - 1)).alias("redundant_bytes"), F.max("n").alias("largest"))


def q_top_groups(spark, sf_dir):
    return dedup.classes(_hashed(spark, sf_dir)).select("size", "n", "first_path").orderBy(F.desc("size"), "first_path").limit(10)


def q_copy_new(spark, sf_dir):
    source, output = _sides(spark, sf_dir)
    return dedup.not_in_output(source, output).select("path", "size")


def q_copy_dups(spark, sf_dir):
    source, output = _sides(spark, sf_dir)
    return dedup.in_output(source, output).select("path", "size")


def q_copy_first_wins(spark, sf_dir):
    source, output = _sides(spark, sf_dir)
    return dedup.first_wins(dedup.not_in_output(source, output)).select("path", "size")


def q_copy_report(spark, sf_dir):
    source, output = _sides(spark, sf_dir)
    new = dedup.not_in_output(source, output)
    counts = source.agg(F.count("*").alias("scanned")).crossJoin(dedup.first_wins(new).agg(F.count("*").alias("copied")))  # one row each
    return counts.select("scanned", "copied", (F.col("scanned") - F.col("copied")).alias("ignored"), F.lit(0).cast("bigint").alias("failed"), F.lit("ok").alias("result"))


def q_union_sources(spark, sf_dir):
    rows = _hashed(spark, sf_dir).select("path", "size", "source")
    return dedup.union_sources(rows.where("source <= 'src15'"), rows.where("source >= 'src12'")).select("path", "size")


def q_except_prefix(spark, sf_dir):
    return dedup.except_prefix(_hashed(spark, sf_dir), "/src1/").select("path", "size")


def q_delete_plan(spark, sf_dir):
    return dedup.delete_plan(_hashed(spark, sf_dir), "/src1")


def q_bytes_read(spark, sf_dir):
    return dedup.bytes_read(_hashed(spark, sf_dir, False))


def q_scan_stats(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 17 == 0, "dir").when(F.col("doc_id") % 19 == 0, "other").otherwise("file")
    status = F.when(F.col("doc_id") % 23 == 0, "unreadable").when(F.col("doc_id") % 29 == 0, "walk_error").otherwise("ok")
    size = F.when(F.col("doc_id") % 13 == 0, 0).otherwise(F.col("size"))
    return dedup.scan_stats(files(spark, sf_dir).select(kind.alias("kind"), size.alias("size"), status.alias("status")))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_GROUPS = "SELECT size, count(*) AS n, string_agg(path, '|' ORDER BY path) AS paths, min(path) AS first_path FROM files WHERE size > 0 GROUP BY size, text HAVING count(*) > 1"
_NEW = "new AS (SELECT * FROM files f WHERE size > 0 AND doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM files o WHERE o.doc_id % 3 = 0 AND o.text = f.text))"
_PREFIX = "(path = '{0}' OR starts_with(path, '{0}/'))"
ORACLES = {
    "q_find_secure": f"WITH {FILES_SQL} SELECT size, n, paths FROM ({_GROUPS})",
    "q_find_fast": f"WITH {FILES_SQL} SELECT size, n, paths FROM ({_GROUPS})",
    "q_fast_bucket": f"WITH {FILES_SQL}, p AS (SELECT path, CASE WHEN size <= 4096 THEN encode(text) ELSE encode(text)[1:4096] END AS head FROM files WHERE size > 0) SELECT count(*) AS n, min(path) AS first_path FROM p GROUP BY head HAVING count(*) > 1",
    "q_dup_groups": f"WITH {FILES_SQL} SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_files, CAST(sum(size * (n - 1)) AS BIGINT) AS redundant_bytes, max(n) AS largest FROM ({_GROUPS})",
    "q_top_groups": f"WITH {FILES_SQL} SELECT size, n, first_path FROM ({_GROUPS}) ORDER BY size DESC, first_path LIMIT 10",
    "q_copy_new": f"WITH {FILES_SQL}, {_NEW} SELECT path, size FROM new",
    "q_copy_dups": f"WITH {FILES_SQL} SELECT path, size FROM files f WHERE size > 0 AND doc_id % 3 <> 0 AND EXISTS (SELECT 1 FROM files o WHERE o.doc_id % 3 = 0 AND o.text = f.text)",
    "q_copy_first_wins": f"WITH {FILES_SQL}, {_NEW} SELECT min(path) AS path, min(size) AS size FROM new GROUP BY text",
    "q_copy_report": f"WITH {FILES_SQL}, {_NEW}, c AS (SELECT count(DISTINCT text) AS copied FROM new), s AS (SELECT count(*) AS scanned FROM files WHERE size > 0 AND doc_id % 3 <> 0) SELECT scanned, copied, scanned - copied AS ignored, CAST(0 AS BIGINT) AS failed, 'ok' AS result FROM c, s",
    "q_union_sources": f"WITH {FILES_SQL} SELECT path, size FROM files WHERE size > 0 AND (source <= 'src15' OR source >= 'src12')",
    "q_except_prefix": f"WITH {FILES_SQL} SELECT path, size FROM files WHERE size > 0 AND NOT {_PREFIX.format('/src1')}",
    "q_delete_plan": f"""WITH {FILES_SQL}, m AS (SELECT size, path, {_PREFIX.format("/src1")} AS below, count(*) OVER w AS n, max(CASE WHEN {_PREFIX.format("/src1")} THEN 1 ELSE 0 END) OVER w AS anywhere,
        row_number() OVER (PARTITION BY text ORDER BY path) AS i FROM files WHERE size > 0 WINDOW w AS (PARTITION BY text))
        SELECT size, path, CASE WHEN below OR (anywhere = 0 AND i = 1) THEN 'keep' ELSE 'delete' END AS action, anywhere = 0 AND i = 1 AS is_survivor FROM m WHERE n > 1""",
    "q_bytes_read": f"WITH {FILES_SQL}, p AS (SELECT size, count(*) OVER (PARTITION BY CASE WHEN size <= 4096 THEN encode(text) ELSE encode(text)[1:4096] END) AS n FROM files WHERE size > 0) SELECT CAST(sum(least(size, 4096) + CASE WHEN n > 1 THEN size ELSE 0 END) AS BIGINT) AS bytes_read FROM p",
    "q_scan_stats": f"""WITH {FILES_SQL}, l AS (SELECT CASE WHEN doc_id % 17 = 0 THEN 'dir' WHEN doc_id % 19 = 0 THEN 'other' ELSE 'file' END AS kind,
        CASE WHEN doc_id % 23 = 0 THEN 'unreadable' WHEN doc_id % 29 = 0 THEN 'walk_error' ELSE 'ok' END AS status, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE size END AS size FROM files)
        SELECT count(*) FILTER (kind = 'file' AND size > 0 AND status = 'ok') AS indexed, count(*) FILTER (kind = 'file' AND size = 0 AND status = 'ok') AS skipped_empty,
        count(*) FILTER (kind = 'file' AND status = 'unreadable') AS skipped_unreadable, count(*) FILTER (status = 'walk_error') AS walker_errors FROM l""",
}
