"""Queries: paths, names, types, templates, sidecars."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterloom.functions import mime as M
from shutterloom.functions import paths as P
from shutterloom.operators import archive
from shutterloom.plans.common import FILES_SQL, files, table

EXTENSIONS = ["jpg", "PNG", "md", "Txt", "key", "xlsx", "heic", "mm", None]
#: First bytes by doc_id % 12, in hexadecimal.
HEADS = ["FFD8FFE0", "89504E470D0A1A0A", "47494638", "524946460000000057454250", "49492A00", "0000001866747970686569630000", "0000001866747970717420200000", "000000186674797033677034", "255044462D", "504B0304", "00000000706E6F74", "00"]


def q_uri_parse(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    uri = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("url", "^https?://", "smb://user@")).when(F.col("page_id") % 4 == 1, F.regexp_replace("url", "^https?://", "mtp://")).when(F.col("page_id") % 4 == 2, F.regexp_replace("url", "^https?://", "adb://")).otherwise(F.col("url"))
    return p.select("page_id", P.location(uri).alias("loc")).select("page_id", *(F.col("loc")[c].alias(c) for c in ("scheme", "user", "host", "share", "device", "storage", "serial", "path", "error")))


def q_under_prefix(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))
    return p.where(P.under_prefix(F.col("path"), "/en/") | P.under_prefix(F.col("path"), "/f")).select("page_id", "path")


def q_mime_from_ext(spark, sf_dir):
    ext = F.get(F.array(*(F.lit(x) for x in EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS)).cast("int"))
    return files(spark, sf_dir).select("doc_id", ext.alias("ext"), M.from_extension(ext).alias("mime"))


def _head():
    return F.unhex(F.get(F.array(*(F.lit(x) for x in HEADS)), (F.col("doc_id") % len(HEADS)).cast("int")))


def q_mime_sniff(spark, sf_dir):
    ext = F.when(F.col("doc_id") % 2 == 0, "docx").otherwise("xyz")
    return files(spark, sf_dir).select("doc_id", M.sniffed(_head()).alias("mime"), M.mime_of(_head(), ext).alias("with_name"))


def q_media_filter(spark, sf_dir):
    return files(spark, sf_dir).withColumn("mime", M.sniffed(_head())).where(M.is_media(F.col("mime"))).select("doc_id", "mime", M.is_image(F.col("mime")).alias("image"))


def q_non_ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(P.non_ascii(F.col("text"))).select("doc_id", "lang")


def _named(spark, sf_dir):
    """Files in folders made of languages and first words, with the extensions of their names."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.regexp_extract("text", r"^([^\s/.]+)", 1).alias("word"))
    name = F.concat(F.lit("p"), (F.col("doc_id") % 40).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".tar.gz").when(F.col("doc_id") % 3 == 1, ".jpg").otherwise(""))
    return d.withColumn("name", name).withColumn("path", F.concat_ws("/", F.lit("/in"), "source", "word", "lang", F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("-"), name)))


def q_valuable_name(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", P.valuable_name(F.col("path")).alias("valuable_name"))


def q_relative_path(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", P.relative_path(F.col("path"), "/in/src1").alias("relative"))


def q_split_ext(spark, sf_dir):
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("."), F.col("name"))).when(F.col("doc_id") % 11 == 0, F.concat("name", F.lit("."))).otherwise(F.col("name"))
    stem, ext = P.split_ext(name)
    return _named(spark, sf_dir).select("doc_id", stem.alias("stem"), ext.alias("ext"))


def q_sanitize_segment(spark, sf_dir):
    i = F.col("doc_id")
    raw = F.when(i % 5 == 0, F.lit("../evil")).when(i % 5 == 1, F.lit("...")).when(i % 5 == 2, F.concat(F.lit("A/"), "word", F.lit("\t"))).when(i % 5 == 3, F.lit("")).otherwise(F.lit(None))
    return _named(spark, sf_dir).select("doc_id", P.sanitized_segment(raw).alias("segment"))


def q_archive_path(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    local = F.col("o_orderdate") + F.expr("INTERVAL 8 HOURS")
    values = {
        "year": F.date_format(local, "yyyy"),
        "month": F.date_format(local, "MM"),
        "day": F.date_format(local, "dd"),
        "valuable_name": F.when(F.col("o_orderkey") % 3 == 0, "été").otherwise(""),
        "make": P.sanitized_segment(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority"))),
    }
    return o.select("o_orderkey", P.rendered("/{year}/{month}/{valuable_name}/{make}-{day}/{other}", values).alias("dir"))


def q_unique_name(spark, sf_dir):
    n = _named(spark, sf_dir)
    rows = n.select("path", F.concat(F.lit("/out/"), "source").alias("dir"), "name")
    taken = n.where("doc_id % 5 = 0").select(F.concat(F.lit("/out/"), "source").alias("dir"), "name").distinct()
    return archive.unique_names(rows, taken, 10).select("path", "dir", "name", "target_name")


def q_sidecar_join(spark, sf_dir):
    f = files(spark, sf_dir).select("doc_id", F.regexp_replace("path", "txt$", "jpg").alias("path"))
    xmp = f.where("doc_id % 3 = 0").select(F.regexp_replace("path", "jpg$", "xmp").alias("path"))
    takeout = f.where("doc_id % 4 = 0").select(F.concat("path", F.lit(".json")).alias("path"))
    return archive.sidecars(f, xmp.unionByName(takeout)).select("doc_id", "xmp", "takeout")


def q_sample_files(spark, sf_dir):
    return files(spark, sf_dir).orderBy("path").limit(10).select("path", "size")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_I = "doc_id % 12"
_SNIFF = f"CASE {_I} WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' WHEN 4 THEN 'image/tiff' WHEN 5 THEN 'image/heif' WHEN 6 THEN 'video/quicktime' WHEN 7 THEN 'video/3gpp' WHEN 8 THEN 'application/pdf' WHEN 9 THEN 'application/zip' WHEN 10 THEN 'video/quicktime' ELSE '' END"
_NAMED = r"""named AS (SELECT doc_id, source, lang, regexp_extract(text, '^([^\s/.]+)', 1) AS word,
    'p' || (doc_id % 40) || CASE doc_id % 3 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.jpg' ELSE '' END AS name FROM documents),
    n AS (SELECT *, '/in/' || source || '/' || word || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '-' || name AS path FROM named)"""
ORACLES = {
    "q_uri_parse": r"""WITH p AS (SELECT page_id, page_id % 4 AS k, url, regexp_replace(url, '^https?://', '') AS rest FROM pages),
        s AS (SELECT *, split_part(rest, '/', 1) AS head, split_part(rest, '/', 2) AS first, regexp_extract(rest, '^[^/]*/(.*)$', 1) AS tail, regexp_extract(rest, '^[^/]*/[^/]*/(.*)$', 1) AS after FROM p)
        SELECT page_id, CASE k WHEN 0 THEN 'smb' WHEN 1 THEN 'mtp' WHEN 2 THEN 'adb' ELSE regexp_extract(url, '^([a-z]+)', 1) END AS scheme, CASE k WHEN 0 THEN 'user' END AS user, CASE k WHEN 0 THEN head END AS host,
        CASE k WHEN 0 THEN first END AS share, CASE k WHEN 1 THEN head END AS device, CASE k WHEN 1 THEN first END AS storage, CASE k WHEN 2 THEN head END AS serial,
        CASE WHEN k < 2 THEN '/' || after WHEN k = 2 THEN '/' || tail END AS path, CASE k WHEN 3 THEN 'unknown_scheme' END AS error FROM s""",
    "q_under_prefix": "WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages) SELECT page_id, path FROM p WHERE starts_with(path, '/en/') OR path = '/en' OR starts_with(path, '/f/') OR path = '/f'",
    "q_mime_from_ext": "SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'jpg' WHEN 1 THEN 'PNG' WHEN 2 THEN 'md' WHEN 3 THEN 'Txt' WHEN 4 THEN 'key' WHEN 5 THEN 'xlsx' WHEN 6 THEN 'heic' WHEN 7 THEN 'mm' END AS ext, CASE doc_id % 9 WHEN 2 THEN 'text/markdown' WHEN 3 THEN 'text/plain' WHEN 4 THEN 'application/vnd.apple.keynote' WHEN 5 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN 7 THEN 'application/x-freemind' END AS mime FROM documents",
    "q_mime_sniff": f"WITH s AS (SELECT doc_id, {_SNIFF} AS mime FROM documents) SELECT doc_id, mime, CASE WHEN mime IN ('', 'application/zip') AND doc_id % 2 = 0 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE mime END AS with_name FROM s",
    "q_media_filter": f"WITH s AS (SELECT doc_id, {_SNIFF} AS mime FROM documents) SELECT doc_id, mime, mime LIKE 'image/%' AS image FROM s WHERE mime LIKE 'image/%' OR mime LIKE 'video/%'",
    "q_non_ascii": "SELECT doc_id, lang FROM documents WHERE strlen(text) <> length(text)",
    "q_valuable_name": f"WITH {_NAMED} SELECT doc_id, CASE WHEN strlen(word) <> length(word) THEN word ELSE '' END AS valuable_name FROM n",
    "q_relative_path": f"WITH {_NAMED} SELECT doc_id, CASE WHEN source = 'src1' THEN word || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '-' || name END AS relative FROM n",
    "q_split_ext": f"""WITH {_NAMED}, m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '.' || name WHEN doc_id % 11 = 0 THEN name || '.' ELSE name END AS name FROM n),
        k AS (SELECT doc_id, name, length(name) - instr(reverse(name), '.') + 1 AS dot, instr(name, '.') > 0 AS dotted FROM m)
        SELECT doc_id, CASE WHEN dotted AND dot > 1 AND dot < length(name) THEN name[1:dot - 1] ELSE name END AS stem, CASE WHEN dotted AND dot > 1 AND dot < length(name) THEN name[dot + 1:] END AS ext FROM k""",
    "q_sanitize_segment": f"WITH {_NAMED} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '.._evil' WHEN 1 THEN '___' WHEN 2 THEN 'A_' || word || '_' ELSE 'unknown' END AS segment FROM n",
    "q_archive_path": "WITH o AS (SELECT o_orderkey, o_orderpriority, o_orderdate + INTERVAL 8 HOUR AS t FROM orders) SELECT o_orderkey, strftime(t, '%Y/%m/') || CASE WHEN o_orderkey % 3 = 0 THEN 'été/' ELSE '' END || CASE WHEN o_orderkey % 4 <> 0 THEN replace(o_orderpriority, '/', '_') ELSE 'unknown' END || strftime(t, '-%d') || '/{other}' AS dir FROM o",
    "q_unique_name": f"""WITH {_NAMED}, rows AS (SELECT path, '/out/' || source AS dir, name, row_number() OVER (PARTITION BY source, name ORDER BY path) AS k FROM n),
        taken AS (SELECT DISTINCT '/out/' || source AS dir, name FROM n WHERE doc_id % 5 = 0), t AS (SELECT r.*, k - 1 + CASE WHEN t.name IS NULL THEN 0 ELSE 1 END AS i FROM rows r LEFT JOIN taken t USING (dir, name))
        SELECT path, dir, name, CASE WHEN i > 10 THEN NULL WHEN i = 0 THEN name WHEN instr(name, '.') > 0 THEN regexp_replace(name, '\\.([^.]+)$', '_' || i || '.\\1') ELSE name || '_' || i END AS target_name FROM t""".replace("\\\\", "\\"),
    "q_sidecar_join": f"WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(path, 'txt$', 'xmp') END AS xmp, CASE WHEN doc_id % 4 = 0 THEN regexp_replace(path, 'txt$', 'jpg') || '.json' END AS takeout FROM files",
    "q_sample_files": f"WITH {FILES_SQL} SELECT path, size FROM files ORDER BY path LIMIT 10",
}
