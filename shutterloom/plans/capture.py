"""Queries: capture times from names, candidates, decisions and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterloom.functions import capture as C
from shutterloom.plans.common import table

#: The moment that future times are judged by: 2024-01-20.
NOW = 1_705_708_800
#: Local time of names, in seconds east of UTC.
OFFSET = 8 * 3600
#: How the names of events' files are written, by event_id % 10: Spark's and DuckDB's formats.
NAMES = (
    ("'IMG_'yyyyMMdd_HHmmss", "IMG_%Y%m%d_%H%M%S"),
    ("'PXL_'yyyyMMdd_HHmmss'123'", "PXL_%Y%m%d_%H%M%S123"),
    ("'Screenshot_'yyyy-MM-dd-HH-mm-ss'_app'", "Screenshot_%Y-%m-%d-%H-%M-%S_app"),
    ("'Screen Shot 'yyyy-MM-dd' at 'HH.mm.ss", "Screen Shot %Y-%m-%d at %H.%M.%S"),
    (None, "mmexport"),
    ("'WhatsApp Image 'yyyy-MM-dd' at 'HH.mm.ss", "WhatsApp Image %Y-%m-%d at %H.%M.%S"),
    ("yyyyMMdd_HHmmss", "%Y%m%d_%H%M%S"),
    ("'trip 'yyyy-MM-dd HH-mm-ss' x'", "trip %Y-%m-%d %H-%M-%S x"),
    ("'holiday-'yyyyMMdd'99'", "holiday-%Y%m%d99"),
    ("'nothing 'yyyy", "nothing %Y"),
)
SOURCES = ("FilenamePhone", "FilenamePixel", "FilenameScreenshot", "FilenameScreenshot", "FilenameWeChatExport", "FilenameWhatsApp", "FilenameBareYyyymmdd", "FilenameDashedDateTime", "FilenameBareYyyymmdd", None)


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", F.unix_timestamp(F.date_trunc("second", "ts")).alias("base"), "event_type", "props")


def _stem(i, ts, base):
    out = None
    for k, (fmt, _) in enumerate(NAMES):
        name = F.date_format(ts, fmt) if fmt else F.concat(F.lit("mmexport"), (base * 1000 + 7).cast("string"))
        out = F.when(i % 10 == k, name) if out is None else out.when(i % 10 == k, name)
    return out


def q_filename_time(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("stem", _stem(F.col("event_id"), F.col("ts"), F.col("base")))
    e = e.withColumn("t", C.filename_time(F.col("stem"), OFFSET))
    return e.select("event_id", "stem", F.col("t.source").alias("source"), F.col("t.utc").alias("utc"))


def _found(i, base):
    """(source, utc) of the candidates of an event's file, and its GPS and modification times."""
    return [
        (F.lit("ExifDateTimeOriginal"), F.when(i % 4 == 1, base).when(i % 4 == 2, base - 400 * C.DAY).when(i % 4 == 3, base + 3600)),
        (F.lit("QuickTimeCreationDate"), F.when(i % 9 == 4, base - 12_000 * C.DAY)),
        (F.lit("ExifCreateDate"), F.when(i % 3 == 0, base + 60)),
        (F.lit("FilenamePhone"), F.when(i % 5 != 0, base + (i % 3) * 43_200)),
        (F.lit("XmpSidecar"), F.when(i % 7 == 0, base - 2 * C.DAY)),
        (F.lit("FsMtime"), F.when(i % 13 != 0, base + (i % 4 - 1) * 30_000 - F.when(i % 6 == 5, 40 * C.DAY).otherwise(0))),
    ]


def _resolved(spark, sf_dir):
    e = _events(spark, sf_dir)
    i, base = F.col("event_id"), F.col("base")
    gps = F.when(i % 6 == 1, base - (i % 5) * 43_200)
    modified = F.when(i % 8 == 2, base + 1800)
    return e.select("event_id", "base", C.candidates(_found(i, base), NOW).alias("cands"), gps.alias("gps"), modified.alias("modified")).withColumn("d", C.decided(F.col("cands"), F.col("gps"), F.col("modified")))


def q_candidates(spark, sf_dir):
    # Outer, as the filter that is inferred from an inner explode would compute the candidates again.
    rows = _resolved(spark, sf_dir).select("event_id", F.posexplode_outer("cands").alias("rank", "c")).where("rank is not null")
    return rows.select("event_id", "rank", "c.priority", "c.source", "c.utc", "c.validity")


def q_time_validity(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    utc = F.unix_timestamp("o_orderdate") + F.when(F.col("o_orderkey") % 5 == 0, -5 * 365 * C.DAY).when(F.col("o_orderkey") % 7 == 0, 10_000 * C.DAY).when(F.col("o_orderkey") % 11 == 0, F.lit(C.EPOCH_1904) - F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 3 * 50_000).otherwise(0)
    return o.select("o_orderkey", utc.alias("utc"), C.validity(utc, NOW).alias("validity"))


def q_time_resolve(spark, sf_dir):
    r = _resolved(spark, sf_dir)
    final = C.capture_time(F.col("d.utc"), F.col("base") + 5, F.lit(None).cast("bigint"))
    return r.select("event_id", F.col("d.utc").alias("utc"), F.col("d.source").alias("source"), F.col("d.priority").alias("priority"), F.col("d.confidence").alias("confidence"), final.alias("final_utc"))


def q_conflicts(spark, sf_dir):
    r = _resolved(spark, sf_dir).select("event_id", F.explode_outer("d.conflicts").alias("c")).where("c is not null")
    return r.select("event_id", "c.kind", "c.other_utc", "c.other_source", "c.diff_secs")


def q_majority(spark, sf_dir):
    return _resolved(spark, sf_dir).select("event_id", F.coalesce("d.overruled", F.lit(False)).alias("overruled"), F.coalesce("d.vetoed", F.lit(False)).alias("vetoed"))


def q_json_timestamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.json_seconds(F.col("props"), "$.k").alias("secs"))


def q_markup_attr_date(spark, sf_dir):
    e = _events(spark, sf_dir)
    date = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+08:00'")
    markup = F.concat(F.lit('<!-- photoshop:DateCreated="1999-01-01T00:00:00Z" --><rdf xphotoshop:DateCreated="no" photoshop:DateCreated="'), date, F.lit('"/>'))
    found = C.first_attribute(markup, "photoshop:DateCreated")
    return e.select("event_id", F.unix_timestamp(F.try_to_timestamp(found, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))).alias("utc"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_BASE = "e AS (SELECT event_id AS i, event_id, ts, props, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS base FROM events)"
_STEM = "CASE event_id % 10 " + " ".join(f"WHEN {k} THEN " + (f"strftime(ts, '{d}')" if s else "'mmexport' || (base * 1000 + 7)") for k, (s, d) in enumerate(NAMES)) + " END"
_VALID = f"CASE WHEN utc >= {C.EPOCH_1904} AND utc < {C.EPOCH_1904 + C.DAY} THEN 'RejectEpoch1904' WHEN utc > {NOW + C.DAY} THEN 'RejectFuture' WHEN utc < {C.YEAR_1995} THEN 'LowConfidencePre1995' ELSE 'Valid' END"
_CANDS = f"""{_BASE}, raw AS (
    SELECT i, 0 AS priority, 0 AS seq, 'ExifDateTimeOriginal' AS source, CASE i % 4 WHEN 1 THEN base WHEN 2 THEN base - 400 * 86400 WHEN 3 THEN base + 3600 END AS utc FROM e
    UNION ALL SELECT i, 0, 1, 'QuickTimeCreationDate', CASE WHEN i % 9 = 4 THEN base - 12000 * 86400 END FROM e
    UNION ALL SELECT i, 1, 2, 'ExifCreateDate', CASE WHEN i % 3 = 0 THEN base + 60 END FROM e
    UNION ALL SELECT i, 2, 3, 'FilenamePhone', CASE WHEN i % 5 <> 0 THEN base + (i % 3) * 43200 END FROM e
    UNION ALL SELECT i, 3, 4, 'XmpSidecar', CASE WHEN i % 7 = 0 THEN base - 2 * 86400 END FROM e
    UNION ALL SELECT i, 4, 5, 'FsMtime', CASE WHEN i % 13 <> 0 THEN base + (i % 4 - 1) * 30000 - CASE WHEN i % 6 = 5 THEN 40 * 86400 ELSE 0 END END FROM e),
    judged AS (SELECT *, {_VALID} AS validity FROM raw WHERE utc IS NOT NULL),
    c AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY priority, utc, seq) - 1 AS rank FROM judged WHERE validity NOT LIKE 'Reject%'),
    anchors AS (SELECT i, CASE WHEN i % 6 = 1 THEN base - (i % 5) * 43200 END AS gps, CASE WHEN i % 8 = 2 THEN base + 1800 END AS modified, base FROM e),
    best AS (SELECT * FROM c WHERE rank = 0),
    rivals AS (SELECT f.*, row_number() OVER (PARTITION BY f.i ORDER BY f.rank) AS k FROM c f JOIN best b ON b.i = f.i AND b.priority = 0 AND f.priority = 2 AND f.validity = 'Valid' AND abs(b.utc - f.utc) > 2592000
        WHERE EXISTS (SELECT 1 FROM c m WHERE m.i = f.i AND m.source = 'FsMtime' AND m.validity = 'Valid' AND abs(m.utc - f.utc) <= 86400)),
    d AS (SELECT a.i, a.base, a.gps, b.utc AS b_utc, b.source AS b_source, b.priority AS b_priority, b.validity AS b_validity, r.utc AS r_utc, r.source AS r_source, r.priority AS r_priority, r.validity AS r_validity,
        r.utc IS NOT NULL AND coalesce(abs(r.utc - a.modified) <= 86400, false) AS vetoed, r.utc IS NOT NULL AND NOT coalesce(abs(r.utc - a.modified) <= 86400, false) AS overruled
        FROM anchors a LEFT JOIN best b ON b.i = a.i LEFT JOIN rivals r ON r.i = a.i AND r.k = 1)"""
ORACLES = {
    "q_filename_time": f"""WITH {_BASE}, s AS (SELECT *, {_STEM} AS stem FROM e)
        SELECT event_id, stem, CASE event_id % 10 {" ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SOURCES) if s)} END AS source,
        CASE WHEN event_id % 10 = 9 THEN NULL WHEN event_id % 10 = 4 THEN base WHEN event_id % 10 = 8 THEN CAST(epoch(date_trunc('day', ts)) AS BIGINT) - {OFFSET} ELSE base - {OFFSET} END AS utc FROM s""",
    "q_candidates": f"WITH {_CANDS} SELECT i AS event_id, CAST(rank AS INTEGER) AS rank, priority, source, utc, validity FROM c",
    "q_time_validity": f"""WITH o AS (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS d FROM orders), u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN d - 5 * 365 * 86400 WHEN o_orderkey % 7 = 0 THEN d + 10000 * 86400
        WHEN o_orderkey % 11 = 0 THEN {C.EPOCH_1904} + o_orderkey % 3 * 50000 ELSE d END AS utc FROM o) SELECT o_orderkey, CAST(utc AS BIGINT) AS utc, {_VALID} AS validity FROM u""",
    "q_time_resolve": f"""WITH {_CANDS}, w AS (SELECT *, CASE WHEN overruled THEN r_utc ELSE b_utc END AS utc, CASE WHEN overruled THEN r_validity ELSE b_validity END AS validity FROM d)
        SELECT i AS event_id, utc, CASE WHEN overruled THEN r_source ELSE b_source END AS source, CASE WHEN overruled THEN r_priority ELSE b_priority END AS priority,
        CASE WHEN utc IS NULL THEN NULL WHEN validity = 'LowConfidencePre1995' THEN 'Low' ELSE 'High' END AS confidence, CASE WHEN utc >= {C.YEAR_2000} THEN utc ELSE base + 5 END AS final_utc FROM w""",
    "q_conflicts": f"""WITH {_CANDS}
        SELECT i AS event_id, 'P0OverruledByMajority' AS kind, b_utc AS other_utc, b_source AS other_source, r_utc - b_utc AS diff_secs FROM d WHERE overruled
        UNION ALL SELECT i, 'MajorityVetoedByModifyDate', r_utc, r_source, b_utc - r_utc FROM d WHERE vetoed
        UNION ALL SELECT i, 'GpsOver24h', gps, NULL, b_utc - gps FROM d WHERE NOT overruled AND b_priority = 0 AND abs(b_utc - gps) > 86400
        UNION ALL SELECT d.i, 'FilenameOver1Day', c.utc, c.source, b_utc - c.utc FROM d JOIN c ON c.i = d.i AND c.rank > 0 AND c.priority = 2 WHERE NOT overruled AND b_priority = 0 AND abs(b_utc - c.utc) > 86400
        UNION ALL SELECT d.i, 'MtimeMuchEarlierThanP0', c.utc, c.source, b_utc - c.utc FROM d JOIN c ON c.i = d.i AND c.rank > 0 AND c.source = 'FsMtime' WHERE NOT overruled AND b_priority = 0 AND b_utc - c.utc > 2592000""",
    "q_majority": f"WITH {_CANDS} SELECT i AS event_id, overruled, vetoed FROM d",
    "q_json_timestamp": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS secs FROM events",
    "q_markup_attr_date": f"WITH {_BASE} SELECT event_id, base - {OFFSET} AS utc FROM e",
}
