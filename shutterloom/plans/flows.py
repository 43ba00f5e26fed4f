"""The commands: find, copy, move, move text shots, cull.

Each flow is a *plan*, a DataFrame that says what happens to every file, then *apply*, which does it on
the executors and gives a status for each row, then a *report* of counts. Applying again does no harm:
targets are written beside themselves and renamed, and a source is deleted only when its target holds
the same bytes. Trees are mounted folders that executors see at the same paths, or stores that they open themselves
(``sources.stores``).

Files are read as little as it takes: the pages of a container that hold its fields, and whole files only where
another one has the same size and the same first 4 KiB. A report says how many bytes were read for that.
"""

from __future__ import annotations

import errno
import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce, wraps
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.config import Config
from shutterloom.functions import capture as C
from shutterloom.functions import mime as M
from shutterloom.functions import paths as P
from shutterloom.functions import vectors as V
from shutterloom.operators import archive, dedup, select, similar
from shutterloom.operators.components import components
from shutterloom.session import exists, scratch, written
from shutterloom.sources import formats, listing, stores
from shutterloom.sources.pages import Pages


@dataclass
class Report:
    """Counts of a flow, and the rows that failed (the first ``ERRORS`` by path)."""

    counts: dict
    errors: list[dict] = field(default_factory=list)

    def raise_for_failures(self) -> None:
        if self.counts.get("failed"):
            raise RuntimeError(f"{self.counts['failed']} files failed")

    @property
    def result(self) -> str:
        """ok, or partial if any file failed."""
        return "partial" if self.counts.get("failed") else "ok"

    def write(self, path: str) -> None:
        """As JSON, complete or not at all."""
        store = stores.of(path)
        with store.writer(f"{path}.tmp") as f:
            f.write(json.dumps(self.counts | {"result": self.result, "errors": self.errors}, indent=2, ensure_ascii=False).encode())
        store.rename(f"{path}.tmp", path)


ERRORS = 1000
#: Endings and media types of the pictures that Spark's image source decodes, and how many of them go to a Python worker at once.
ENDINGS, PICTURES, PHOTO_ROWS = ("jpg", "jpeg", "jpe", "jfif", "png", "gif", "tif", "tiff", "bmp"), ("image/jpeg", "image/png", "image/gif", "image/tiff", "image/bmp"), 4
PHOTOS = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in ENDINGS) + "}"
FACTS = f"path string, size bigint, modified bigint, created bigint, content binary, {formats.SCHEMA}, bytes_read bigint, error string"


def listed_tree(spark: SparkSession, roots: list[str], skip: str | None = None) -> DataFrame:
    """Listing of several trees, one row for each path."""
    out = None
    for root in roots:
        part = listing.tree(spark, root, skip)
        out = part if out is None else out.unionByName(part)
    return out.dropDuplicates(["path"])


def _opened(path: str) -> tuple[Pages, str, bytes]:
    """A file by random access, its media type, and its first 4 KiB; close ``source`` of the pages."""
    src = Pages(stores.of(path).reader(path))
    head = src.at(0, dedup.PREFIX_BYTES)
    mime = next((m for m, parts in M.BY_MAGIC if all(head[at : at + len(want) // 2].hex().upper() == want for at, want in parts)), "")
    if mime in ("", "application/zip"):
        mime = M.BY_EXTENSION.get(os.path.splitext(path)[1][1:].lower(), mime)
    return src, mime, head


def _heads(files: DataFrame, offset: int, fields: bool = True) -> DataFrame:
    """First 4 KiB of each file, the fields of its container if wanted, and the bytes that were read."""

    def facts(path: str) -> dict:
        src, mime, head = _opened(path)
        with src.source:
            found = formats.read(mime, src, offset) if fields else {}
            return {"content": head, "bytes_read": src.fetched} | found

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.to_dict("records"):
                try:
                    rows.append(row | facts(row["path"]) | {"error": None})
                except OSError as e:
                    rows.append(row | {"error": str(e)})
            out = pd.DataFrame(rows, columns=["path", "size", "modified", "created", "content", *formats.FIELDS, "bytes_read", "error"], dtype=object)
            yield out.astype({c: "Int64" for c in out.columns if c in ("size", "modified", "created", "bytes_read") or c in formats.FIELDS and c not in ("make", "model")})

    return files.select("path", "size", "modified", "created").mapInPandas(run, FACTS)


def _provided(files: DataFrame, providers: tuple) -> DataFrame:
    """(path, provided array<struct<source, utc>>): what the providers say, each a table function joined laterally."""
    found = files.sparkSession.createDataFrame([], "path string, source string, utc bigint")
    for provider in providers:

        class Candidates:
            def eval(self, path, size, modified, provider=provider):
                yield from provider(path, size, modified)

        call = F.udtf(Candidates, returnType="source string, utc bigint")
        part = files.lateralJoin(call(F.col("path").outer(), F.col("size").outer(), F.col("modified").outer()))
        found = found.unionByName(part.select("path", "source", "utc"))
    return found.where("source IS NOT NULL AND utc IS NOT NULL").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("source", "utc"))).alias("provided"))


def _sidecar_times(files: DataFrame) -> DataFrame:
    """(path, xmp_utc, takeout_utc) of the files that have a sidecar of at most ``TEXT_BYTES`` beside them."""

    def read(path: str | None, parse) -> int | None:
        if path is None:
            return None
        try:
            with stores.of(path).reader(path) as f:
                return parse(f.read())
        except (OSError, UnicodeDecodeError):
            return None

    def xmp_time(raw: bytes) -> int | None:
        return next(iter(formats.xmp(raw, formats.SIDECAR_DATES).values()), None)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(r["path"], read(r["xmp"], xmp_time), read(r["takeout"], lambda x: formats.takeout_seconds(x.decode()))) for r in part.to_dict("records")]
            yield pd.DataFrame(rows, columns=["path", "xmp_utc", "takeout_utc"], dtype=object).astype({"xmp_utc": "Int64", "takeout_utc": "Int64"})

    beside = files.where((F.col("size") <= listing.TEXT_BYTES) & F.lower("path").rlike(r"\.(xmp|json)$")).select("path")
    found = archive.sidecars(files.select("path"), beside).where("xmp IS NOT NULL OR takeout IS NOT NULL")
    return found.mapInPandas(run, "path string, xmp_utc bigint, takeout_utc bigint")


def _sha512(path: str) -> str:
    h = hashlib.sha512()
    with stores.of(path).reader(path) as f:
        while piece := f.read(1 << 20):
            h.update(piece)
    return h.hexdigest()


def _strong(files: DataFrame) -> DataFrame:
    """Adds the SHA-512 of whole files, read in pieces; null for what can't be read."""

    def digest(path: str) -> str | None:
        try:
            return _sha512(path)
        except OSError:
            return None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(strong=pd.Series([digest(p) for p in part["path"]], index=part.index, dtype=object))

    return files.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", strong string")


def _prefixed(heads: DataFrame) -> DataFrame:
    """(path, size, fast, small): hash of the first 4 KiB, and the strong hash of files that are no longer."""
    small = F.when(F.col("size") <= dedup.PREFIX_BYTES, F.sha2("content", 512))
    return heads.where("error IS NULL").select("path", "size", dedup.fast_hash(F.col("content")).alias("fast"), small.alias("small"))


def _identities(prefixed: DataFrame, name: str) -> DataFrame:
    """(path, size, strong, bytes_read) of the files whose size and first 4 KiB more than one has; only they are read
    whole, unless the prefix was all. Others are like no other file. ``strong`` is null for what can't be read any more."""
    meet = prefixed.groupBy("size", "fast").agg(F.count("*").alias("n")).where("n > 1").select("size", "fast")
    alike = prefixed.join(meet, ["size", "fast"])
    whole = _strong(alike.where("small IS NULL").select("path", "size")).withColumn("bytes_read", F.col("size"))
    return written(whole.unionByName(alike.where("small IS NOT NULL").select("path", "size", F.col("small").alias("strong"), F.lit(0).cast("bigint").alias("bytes_read"))), name)


def find(spark: SparkSession, sources: list[str]) -> DataFrame:
    """(size, strong, n, paths) of equal files. Only files that share their size are opened, and only
    those that share their first 4 KiB too are read whole."""
    files = listed_tree(spark, sources).where("kind = 'file' AND size > 0 AND status = 'ok'")
    alike = files.join(files.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size"), "size")
    prefixed = written(_prefixed(_heads(alike, 0, False)), "heads")
    return dedup.duplicate_groups(_identities(prefixed, "identities").where("strong IS NOT NULL"))


def delete_script(groups: DataFrame, output: str | None) -> str:
    """A Python script for review: a line for each member, live where the plan deletes it."""
    members = groups.select("size", "strong", F.explode("paths").alias("path"))
    rows = dedup.delete_plan(members, output).withColumn("line", P.python_literal(F.col("path"))).orderBy(F.desc("size"), "path")
    lines, size = ["import os"], None
    for r in rows.toLocalIterator():
        if r["size"] != size:
            size = r["size"]
            lines.append(f"# SIZE {size}")
        if r["is_survivor"]:
            lines.append("# SURVIVOR")
        lines.append(("" if r["action"] == "delete" else "# ") + f'os.remove("{r["line"]}")')
    return "\n".join(lines) + "\n" if size is not None else ""


def copy_plan(spark: SparkSession, sources: list[str], output: str, config: Config, now: int, include_other: bool = False, dry_run: bool = False, listed: DataFrame | None = None, providers: tuple = ()) -> DataFrame:
    """(path, action, target, reason, strong, there, bytes_read) of every source file: copy, ignore or fail.

    Archived files are opened only where a source has their size, and read whole like sources only where first
    bytes agree too. ``strong`` is null for files that nothing equals; ``there``: the archive holds the file.
    """
    listing.ensure_outside(sources, output)
    offset = C.offset_secs(config.copy.timezone_offset_hours)
    files = (listed if listed is not None else listed_tree(spark, sources, output)).where("kind = 'file' AND size > 0 AND status = 'ok'")
    own = written(_archived(spark, output), "archived")
    facts = written(_heads(files, offset), "facts")
    same_size = written(_heads(own.join(facts.select("size").distinct(), "size", "left_semi"), 0, False), "same_size")
    ours, theirs = written(_prefixed(facts), "prefixes"), _prefixed(same_size)
    # archived files need no telling apart but from sources
    theirs = theirs.join(ours.select("size", "fast").distinct(), ["size", "fast"], "left_semi")
    known = _identities(ours.unionByName(theirs), "identities")
    there = known.join(theirs.select("path"), "path", "left_semi").where("strong IS NOT NULL").select("size", "strong").distinct().withColumn("there", F.lit(True))
    met = known.join(ours.select("path"), "path", "left_semi").select("path", "strong", F.lit(True).alias("met"), F.col("bytes_read").alias("whole"))
    facts = facts.join(_sidecar_times(files), "path", "left").join(met, "path", "left").join(_provided(files, providers), "path", "left")
    name = P.file_name(F.col("path"))
    kind = M.mime_of(F.col("content"), F.regexp_extract(name, r"\.([^.]+)$", 1))
    rows = facts.join(there, ["size", "strong"], "left").withColumn("name", name).withColumn("mime", kind)
    stem = P.stem_of(F.col("name"))
    in_name = C.filename_time(stem, offset)
    found = [
        (F.lit("ExifDateTimeOriginal"), F.col("dto")),
        (F.when(M.is_matroska(F.col("mime")), "MkvDateUtc").otherwise("QuickTimeCreationDate"), F.col("qt_create_date")),
        (F.lit("ExifCreateDate"), F.col("create_date")),
        (F.lit("DocumentCreated"), F.col("doc_created")),
        (F.coalesce(in_name["source"], F.lit("FilenamePhone")), in_name["utc"]),
        (F.lit("XmpSidecar"), F.col("xmp_utc")),
        (F.lit("GoogleTakeoutJson"), F.col("takeout_utc")),
        (F.lit("FsMtime"), F.when(F.col("modified") >= 0, F.col("modified"))),
    ]
    decision = C.decided(C.candidates(found, now, F.col("provided")), F.col("gps_utc"), F.col("modify_date"))
    when = F.timestamp_seconds(C.capture_time(decision["utc"], F.col("modified"), F.col("created"), config.exif.valid_date_time_secs) + offset)
    values = {"year": F.date_format(when, "yyyy"), "month": F.date_format(when, "MM"), "day": F.date_format(when, "dd"), "valuable_name": P.valuable_name(F.col("path")), "make": P.sanitized_segment(F.col("make")), "model": P.sanitized_segment(F.col("model"))}
    sub = P.rendered(config.copy.archive_template, values)
    safe = F.array_join(F.filter(F.split(sub, "/"), lambda s: ~s.isin("", ".", "..")), "/")
    rows = rows.withColumn("dir", F.concat(F.lit(output.rstrip("/") + "/"), safe))
    reason = F.when(F.col("error").isNotNull() | F.coalesce("met", F.lit(False)) & F.col("strong").isNull(), "unreadable").when(F.col("there"), "duplicate")
    rows = rows.withColumn("reason", reason if include_other else reason.when(~M.is_media(F.col("mime")), "not_media"))
    read = F.coalesce("bytes_read", F.lit(0)) + F.coalesce("whole", F.lit(0))
    rows = written(rows.select("path", "size", "strong", "dir", "name", "reason", "error", F.coalesce("there", F.lit(False)).alias("there"), read.alias("bytes_read")), "candidates")
    fresh = rows.where("reason IS NULL")
    # a file without a strong hash is like no other
    several = fresh.where("strong IS NOT NULL")
    first = fresh if dry_run else fresh.where("strong IS NULL").unionByName(dedup.first_wins(several))
    later = fresh.join(first.select("path"), "path", "left_anti").withColumn("reason", F.lit("duplicate"))
    taken = own.select(P.parent(F.col("path")).alias("dir"), P.file_name(F.col("path")).alias("name"))
    carried = ["strong", "there", "bytes_read"]
    placed = archive.unique_names(first.select("path", "dir", "name", *carried), taken, config.copy.unique_name_max_attempts)
    target = F.concat("dir", F.lit("/"), "target_name")
    ok = placed.select("path", F.when(F.col("target_name").isNull(), "fail").otherwise("copy").alias("action"), target.alias("target"), F.when(F.col("target_name").isNull(), "no free name").alias("reason"), *carried)
    rest = rows.where("reason IS NOT NULL").unionByName(later)
    ignored = rest.select("path", F.when(F.col("reason") == "unreadable", "fail").otherwise("ignore").alias("action"), F.lit(None).cast("string").alias("target"), "reason", *carried)
    # what was read of the archive, in a row of its own
    opened = same_size.select(F.coalesce("bytes_read", F.lit(0)).alias("n")).unionByName(known.join(theirs.select("path"), "path", "left_semi").select(F.col("bytes_read").alias("n")))
    note = opened.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bytes_read"))
    note = note.select(_no_text("path"), F.lit("note").alias("action"), _no_text("target"), F.lit("archive").alias("reason"), _no_text("strong"), F.lit(False).alias("there"), "bytes_read")
    return ok.unionByName(ignored).unionByName(note)


def _archived(spark: SparkSession, output: str) -> DataFrame:
    """Listing of the files that the output has."""
    if not stores.of(output).is_folder(output):
        return spark.createDataFrame([], stores.SCHEMA)
    return listed_tree(spark, [output]).where("kind = 'file' AND size > 0")


def transferred(source: str, target: str, strong: str | None, remove: bool) -> int:
    """Copy or move one file, and the bytes that were read for it; a move on one volume only renames. What was done
    before counts as done: a target that is there must hold the same bytes, or the file fails and its source stays."""
    a, b = stores.of(source), stores.of(target)
    if remove and not a.exists(source) and b.exists(target):
        return 0
    b.make_folder(stores.parent(target))
    there, read, digest = b.exists(target), 0, None
    if not there and remove and a is b:
        try:
            a.rename(source, target)
            return 0
        except OSError as e:
            if e.errno != errno.EXDEV:
                raise
    if not there:
        half, h = f"{target}.{uuid.uuid4().hex}.part", hashlib.sha512()
        try:
            with a.reader(source) as f, b.writer(half) as g:
                while piece := f.read(1 << 20):
                    g.write(piece)
                    read += len(piece)
                    if remove:
                        h.update(piece)
            b.like(half, source)
            b.rename(half, target)
        finally:
            if b.exists(half):
                b.remove(half)
        digest = h.hexdigest() if remove else None
    if there or remove:
        size = a.size(source)
        if b.size(target) != size or _sha512(target) != (digest or strong or _sha512(source)):
            raise OSError(f"{target} holds other bytes than {source}")
        read += size
        if remove:
            a.remove(source)
    return read


def applied(plan: DataFrame, remove: bool, dry_run: bool) -> DataFrame:
    """(path, action, target, status, message): what was done, on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                status, message = {"copy": "copied", "ignore": "ignored", "fail": "failed"}[r["action"]], r["reason"]
                try:
                    if not dry_run and r["action"] == "copy":
                        transferred(r["path"], r["target"], r["strong"], remove)
                    elif not dry_run and remove and r["reason"] == "duplicate" and stores.of(r["path"]).exists(r["path"]):
                        stores.of(r["path"]).remove(r["path"])
                except OSError as e:
                    status, message = "failed", str(e)
                out.append((r["path"], r["action"], r["target"], status, message))
            yield pd.DataFrame(out, columns=["path", "action", "target", "status", "message"], dtype=object)

    return plan.mapInPandas(run, "path string, action string, target string, status string, message string")


def _report(done: DataFrame, stats: dict, **more) -> Report:
    names = ("copied", "ignored", "failed")
    row = done.agg(*(F.count_if(F.col("status") == n).alias(n) for n in names)).first()
    counts = row.asDict() | stats
    return Report({"scanned": sum(counts.values())} | counts | more, _errors(done.where("status = 'failed'")))


def _errors(failed: DataFrame) -> list[dict]:
    """The first failed rows by path, with the kind of error."""
    rows = failed.select("path", "message").orderBy("path").limit(ERRORS)
    return [r.asDict() for r in rows.select("path", "message", listing.error_kind(F.col("message")).alias("kind")).collect()]


def _cleaned(flow):
    """A flow whose tables are deleted at its end, but for the one that it returns."""

    @wraps(flow)
    def run(*args, **settings):
        with scratch() as made:
            report, rows = flow(*args, **settings)
            made.keep(rows)
        return report, rows

    return run


@_cleaned
def copy(spark: SparkSession, sources: list[str], output: str, config: Config | None = None, now: int = 4_000_000_000, remove: bool = False, dry_run: bool = False, include_other: bool = False, providers: tuple = ()) -> tuple[Report, DataFrame]:
    """Archive sources into the output by capture time; ``remove`` moves."""
    listing.ensure_outside(sources, output)
    listed = written(listed_tree(spark, sources, output), "listed")
    plan = written(copy_plan(spark, sources, output, config or Config(), now, include_other, dry_run, listed, providers), "plan")
    read = plan.agg(F.coalesce(F.sum("bytes_read"), F.lit(0))).first()[0]
    plan = plan.where("action <> 'note'")
    stats = dedup.scan_stats(listed.select("kind", "size", "status")).drop("indexed").first().asDict()
    # originals go first, so that a duplicate is removed only when its twin has arrived; hashes go with the files,
    # so the archive isn't read again
    ignored = plan.where("action = 'ignore'")
    originals = written(applied(plan.where("action <> 'ignore'"), remove, dry_run), "done")
    if remove and not dry_run:
        arrived = originals.where("status = 'copied'").join(plan.select("path", "strong"), "path").select("strong").where("strong IS NOT NULL").distinct()
        waiting = ignored.where("reason = 'duplicate'").join(arrived.withColumn("arrived", F.lit(True)), "strong", "left").where("there OR arrived").select(*plan.columns)
        kept = ignored.join(waiting.select("path"), "path", "left_anti")
        others = applied(waiting, remove, dry_run).unionByName(applied(kept, False, dry_run))
    else:
        others = applied(ignored, False, dry_run)
    done = written(originals.unionByName(others), "done")
    return _report(done, stats, bytes_read=read, dry_run=dry_run, remove=remove, include_non_media=include_other), done


def _no_text(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def _target_plan(placed: DataFrame, *more: str) -> DataFrame:
    """(path, action, target, reason, strong, more) of files with a folder and a name in it, if one was free."""
    free = F.col("target_name").isNotNull()
    action, target = F.when(free, "copy").otherwise("fail"), F.concat("dir", F.lit("/"), "target_name")
    return placed.select("path", action.alias("action"), target.alias("target"), _no_text("reason"), _no_text("strong"), *more)


def _taken(spark: SparkSession, output: str | None) -> DataFrame:
    """(dir, name) of the files that the output has."""
    if output is None or not stores.of(output).is_folder(output):
        return spark.createDataFrame([], "dir string, name string")
    return listed_tree(spark, [output]).where("kind = 'file'").select(P.parent(F.col("path")).alias("dir"), P.file_name(F.col("path")).alias("name"))


@_cleaned
def move_text_shots(spark: SparkSession, sources: list[str], output: str, detector, config: Config | None = None, dry_run: bool = False) -> tuple[Report, DataFrame]:
    """Move images with text, keeping their path below the source."""
    listing.ensure_outside(sources, output)
    config = config or Config()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path in part["path"]:
                try:
                    src, mime, _ = _opened(path)
                    with src.source as f:
                        if not mime.startswith("image/"):
                            out.append((path, "ignored", "not an image"))
                            continue
                        f.seek(0)
                        raw = f.read()
                    out.append((path, "hit" if detector.has_text(path, raw) else "no_text", None))
                except Exception as e:  # noqa: BLE001  a detector may raise anything
                    out.append((path, "failed", str(e)))
            yield pd.DataFrame(out, columns=["path", "found", "message"], dtype=object)

    found = None
    for root in sources:
        files = listed_tree(spark, [root], output).where("kind = 'file' AND size > 0 AND status = 'ok'").select("path")
        part = files.mapInPandas(run, "path string, found string, message string")
        part = part.withColumn("below", F.substr("path", F.lit(len(stores.of(root).root(root).rstrip("/")) + 2)))
        part = part.withColumn("dir", F.when(F.instr("below", "/") > 0, F.concat(F.lit(output.rstrip("/") + "/"), P.parent(F.col("below")))).otherwise(output.rstrip("/")))
        found = part if found is None else found.unionByName(part)
    found = written(found.drop("below"), "shots")
    taken = _taken(spark, output)
    hits = archive.unique_names(found.where("found = 'hit'").select("path", "dir", P.file_name(F.col("path")).alias("name")), taken, config.copy.unique_name_max_attempts)
    done = written(applied(written(_target_plan(hits), "plan"), True, dry_run), "done")
    counted = {
        "image_files": "found <> 'ignored' AND found <> 'failed'",
        "ocr_hits": "found = 'hit'",
        "skipped_non_image": "found = 'ignored'",
        "skipped_no_text": "found = 'no_text'",
        "failed": "found = 'failed'",
    }
    seen = found.agg(F.count("*").alias("scanned"), *(F.count_if(F.expr(rule)).alias(name) for name, rule in counted.items())).first().asDict()
    moved = done.agg(F.count_if(F.expr("status = 'copied'")).alias("moved"), F.count_if(F.expr("status = 'failed'")).alias("failed")).first()
    seen |= {"moved": moved["moved"], "failed": seen["failed"] + moved["failed"], "dry_run": dry_run}
    bad = found.where("found = 'failed'").select("path", "message").unionByName(done.where("status = 'failed'").select("path", "message"))
    return Report(seen, _errors(bad)), done


def _photos(spark: SparkSession, roots: list[str], measure, schema: str) -> DataFrame:
    """(path, ...) that ``measure`` gives for path and pixels of each picture below the roots.

    The JVM decodes them, in Spark's image source; files that it can't decode are left out. Pixels go to
    Python in small batches and are never shuffled. Names that begin with ``_`` or ``.`` are not listed by
    that source, and files of any size are read.
    """
    local = "file://" if any(r.startswith("file://") for r in roots) else ""
    roots = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r) for r in roots if exists(spark, r)]
    if not roots:
        return spark.createDataFrame([], schema)

    names = spark.createDataFrame([], schema).columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from shutterloom.functions import images as I

        for part in parts:
            rows = [measure(unquote(re.sub(r"^file:(//)?", local, origin)), I.from_image_row(data, *shape)) for origin, data, *shape in part.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=names, dtype=object)

    source = spark.read.format("image").option("pathGlobFilter", PHOTOS).option("recursiveFileLookup", True).option("dropInvalid", True).option("ignoreCorruptFiles", True)
    rows = source.load([r if "://" in r else f"file://{os.path.abspath(r)}" for r in roots]).select("image.origin", "image.data", "image.height", "image.width", "image.nChannels").mapInPandas(run, schema)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(PHOTO_ROWS))
    try:
        return written(rows, "photos").dropDuplicates(["path"])
    finally:
        spark.conf.set(limit, before)


#: What an analyzer may say of a face; blinks and smiles follow from mesh and eyes where it does not give them.
FACE_FIELDS = "is_blink boolean, smile double, left_closed double, right_closed double, mesh array<array<double>>"
FACE = [c.split()[0] for c in FACE_FIELDS.split(", ")]
NO_FACE = (False, *[None] * (len(FACE) - 1))


def _judged(faces: DataFrame, face) -> DataFrame:
    """(path, is_blink, smile, message) of faces, by the limits of the settings."""
    eyes = [F.coalesce(c, F.lit(0.0)) for c in ("left_closed", "right_closed")]
    mesh = F.coalesce("mesh", F.array().cast("array<array<double>>"))
    blink = F.coalesce("is_blink", select.blink(V.eye_aspect_ratio(mesh), *eyes, face.ear_blink_max, face.eye_blink_score_max))
    return faces.select("path", blink.alias("is_blink"), F.coalesce("smile", V.smile(mesh)).alias("smile"), "message")


@_cleaned
def cull(spark: SparkSession, sources: list[str], output: str, analyzer=None, config: Config | None = None, dry_run: bool = False) -> tuple[Report, DataFrame]:
    """Group similar images; copy the best of each group as BEST_, move the others to its folder.

    JPEG, PNG, GIF, TIFF and BMP files are decoded by Spark's image source, and their faces are looked for in the same
    pass; images that it doesn't list, or whose grey values are no bytes, are decoded by the workers if they are PNG, BMP or PNM.
    """
    from shutterloom.functions import images as I

    listing.ensure_outside(sources, output)
    face = (config or Config()).face

    def read(path: str) -> bytes:
        with stores.of(path).reader(path) as f:
            return f.read()

    def in_source(path: str, mime: str, head: bytes) -> bool:
        """Whether the image source lists and decodes a file; its grey values are bytes, so others are decoded here."""
        name = path.rpartition("/")[2]
        bits, kind = I.png_kind(head) if mime == "image/png" else (8, 0)
        return mime in PICTURES and name[:1] not in "_." and name.rpartition(".")[2].lower() in ENDINGS and (bits == 8 or kind not in (0, 4))

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, size in zip(part["path"], part["size"], strict=True):
                try:
                    if size > face.max_image_bytes:
                        raise ValueError("the file is too large")
                    src, mime, head = _opened(path)
                    src.source.close()
                    if not mime.startswith("image/"):
                        out.append((path, None, None, "not an image"))
                        continue
                    if in_source(path, mime, head):
                        out.append((path, None, None, "photo"))
                        continue
                    rgb = I.decode(read(path))
                    out.append((path, I.phash(rgb), I.laplacian_variance(np.round(I.grey(rgb))), None))
                except Exception as e:  # noqa: BLE001  any broken image is a failed row
                    out.append((path, None, None, f"failed: {e}"))
            yield pd.DataFrame(out, columns=["path", "hash", "sharpness", "message"], dtype=object).astype({"hash": "Int64"})

    def faces_in(path: str, rgb: np.ndarray) -> tuple[list[tuple], str | None]:
        try:
            return [tuple(f.get(k) for k in FACE) for f in (analyzer.faces_of(path, rgb) if analyzer else [])], None
        except Exception as e:  # noqa: BLE001  the image is then judged by sharpness alone
            return [NO_FACE], f"failed: {e}"

    def photo(path: str, rgb: np.ndarray) -> tuple:
        return (path, I.phash(rgb), I.laplacian_variance(np.round(I.grey(rgb))), *faces_in(path, rgb))

    def analyze(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path in part["path"]:
                try:
                    found, message = faces_in(path, I.decode(read(path)))
                except Exception as e:  # noqa: BLE001  gone or changed since the scan
                    found, message = [NO_FACE], f"failed: {e}"
                out += [(path, *f, message) for f in found]
            yield pd.DataFrame(out, columns=["path", *FACE, "message"], dtype=object)

    files = listed_tree(spark, sources, output).where("kind = 'file' AND size > 0 AND status = 'ok'")
    scanned = files.select("path", "size").mapInPandas(scan, "path string, hash bigint, sharpness double, message string")
    scanned = written(scanned, "scanned")
    per_face = FACE_FIELDS.replace(", ", ",").replace(" ", ":")
    photos = _photos(spark, sources, photo, f"path string, pixel_hash bigint, detail double, found array<struct<{per_face}>>, face_message string")
    photos = photos.join(scanned.where("message = 'photo'").select("path"), "path", "left_semi")
    pending = F.col("message") == "photo"
    message = F.when(pending & F.col("pixel_hash").isNotNull(), None).when(pending, "failed: the image can't be decoded").otherwise(F.col("message"))
    scanned = scanned.join(photos.select("path", "pixel_hash", "detail"), "path", "left").select("path", F.coalesce("hash", "pixel_hash").alias("hash"), F.coalesce("sharpness", "detail").alias("sharpness"), message.alias("message"))
    scanned = written(scanned.withColumn("id", F.xxhash64("path")), "images")
    images = scanned.where("message IS NULL")
    # links enough for the groups, not all pairs: a burst of n copies has n - 1
    groups = components(similar.hamming_links(images, face.phash_hamming_max)).select(F.col("node").alias("id"), "component")
    members = images.join(groups, "id").select("path", "sharpness", F.col("component").alias("group"))
    sharp = written(select.without_blurry(members, "group", "sharpness", face.sharpness_min), "sharp")
    faces = spark.createDataFrame([], f"path string, {FACE_FIELDS}, message string")
    if analyzer:
        others = sharp.select("path").join(photos.select("path"), "path", "left_anti").mapInPandas(analyze, faces.schema)
        in_photos = photos.join(sharp.select("path"), "path", "left_semi").select("path", F.inline("found"), F.col("face_message").alias("message"))
        faces = others.unionByName(in_photos)
    faces = written(_judged(faces, face), "faces")
    rows = select.scored(sharp, faces.where("message IS NULL"), "path", face.w_sharpness, face.w_blink, face.w_smile)
    best = select.best_of(rows, "group", "total", "path").select("path", F.lit(True).alias("best"))
    names = select.group_names(rows.groupBy("group").agg(F.min("path").alias("first")), "first").select("group", "group_id")
    rows = rows.join(best, "path", "left").join(names, "group").withColumn("best", F.coalesce("best", F.lit(False)))
    name = F.concat(F.when(F.col("best"), "BEST_").otherwise(""), P.file_name(F.col("path")))
    rows = rows.withColumn("dir", F.concat(F.lit(output.rstrip("/") + "/"), "group_id")).withColumn("name", name)
    taken = _taken(spark, None if dry_run else output)
    placed = archive.unique_names(rows.select("path", "dir", "name", "group_id", "best", "total"), taken)
    plan = written(_target_plan(placed, "group_id", "best", "total"), "plan")
    columns = ["path", "action", "target", "reason", "strong"]
    kept, culled = applied(plan.where("best").select(columns), False, dry_run), applied(plan.where("NOT best").select(columns), True, dry_run)
    done = written(kept.unionByName(culled), "done")
    result = written(done.join(plan.select("path", "group_id", "best", "total"), "path"), "culled")
    many = members.groupBy("group").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    counts = {"scanned": scanned.count(), "grouped": sharp.count(), "best_count": plan.where("best").count(), "culled_count": plan.where("NOT best").count()}
    blurry = ~(F.isnan("sharpness") | (F.col("sharpness") >= face.sharpness_min))
    counts["moved"] = 0 if dry_run else result.where("NOT best AND status = 'copied'").count()
    counts |= {"dropped_blurry": members.where(blurry).count() if many else 0, "dry_run": dry_run}
    failed = [scanned.where("message LIKE 'failed%'"), faces.where("message IS NOT NULL"), done.where("status = 'failed'")]
    bad = reduce(DataFrame.unionByName, (rows.select("path", "message") for rows in failed))
    counts["failed"] = bad.count()
    return Report(counts, _errors(bad)), result


def write_manifests(result: DataFrame) -> None:
    """A MANIFEST.json in each group's folder; a failure only leaves it out."""

    def put(part: pd.DataFrame) -> pd.DataFrame:
        best, rest = part[part["best"]], part[~part["best"]]
        entry = lambda r: {"src": r.path, "dst": r.target, "score": None if np.isnan(r.total) else float(r.total)}
        folder = os.path.dirname(part["target"].iloc[0])
        try:
            with stores.of(folder).writer(f"{folder}/MANIFEST.json") as f:
                f.write(json.dumps({"group_id": part["group_id"].iloc[0], "best": [entry(r) for r in best.itertuples()], "culled": [entry(r) for r in rest.itertuples()]}, indent=2, ensure_ascii=False).encode())
        except OSError:
            pass
        return part[["group_id"]].head(1)

    result.where("status = 'copied'").groupBy("group_id").applyInPandas(put, "group_id string").count()
