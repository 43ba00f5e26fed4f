"""When a file was captured: candidates, validity, and the decision among them.

A file's candidates stand in one array column, so that the whole decision is a projection: no shuffle,
whatever the number of files. ``now`` is always a parameter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sources by priority, the best first.
PRIORITY = {
    "ExifDateTimeOriginal": 0,
    "QuickTimeCreationDate": 0,
    "MkvDateUtc": 0,
    "DocumentCreated": 0,
    "ExifCreateDate": 1,
    "QuickTimeCreateDate": 1,
    "FilenameCamera": 2,
    "FilenamePhone": 2,
    "FilenameVideoPhone": 2,
    "FilenameScreenshot": 2,
    "FilenameUnixMillis": 2,
    "FilenamePixel": 2,
    "FilenameBareYyyymmdd": 2,
    "FilenameWeChatExport": 2,
    "FilenameWhatsApp": 2,
    "FilenameDashedDateTime": 2,
    "XmpSidecar": 3,
    "GoogleTakeoutJson": 3,
    "FsMtime": 4,
}
DAY = 86_400
MONTH = 30 * DAY
#: 1904-01-01, 1995-01-01 and 2000-01-01 in epoch seconds.
EPOCH_1904, YEAR_1995, YEAR_2000 = -2_082_844_800, 788_918_400, 946_684_800
CANDIDATE = "struct<priority:int,utc:bigint,seq:int,source:string,validity:string>"
CONFLICT = "struct<kind:string,other_utc:bigint,other_source:string,diff_secs:bigint>"

#: File-name patterns in their order; the first that gives a valid time wins.
#: (source, pattern with one group, format, whether the group may stand anywhere)
NAME_PATTERNS = (
    ("FilenamePhone", r"^IMG_(\d{8}_\d{6})$", "yyyyMMdd_HHmmss", False),
    ("FilenameCamera", r"^DSC_(\d{8}_\d{6})$", "yyyyMMdd_HHmmss", False),
    ("FilenameVideoPhone", r"^VID_(\d{8}_\d{6})$", "yyyyMMdd_HHmmss", False),
    ("FilenamePixel", r"^PXL_(\d{8}_\d{6})", "yyyyMMdd_HHmmss", False),
    ("FilenameScreenshot", r"^Screenshot_(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})", "yyyy-MM-dd-HH-mm-ss", False),
    ("FilenameScreenshot", r"^Screenshot_(\d{8}_\d{6})", "yyyyMMdd_HHmmss", False),
    ("FilenameScreenshot", r"^Screen Shot (\d{4}-\d{2}-\d{2} at \d{2}\.\d{2}\.\d{2})", "yyyy-MM-dd 'at' HH.mm.ss", False),
    ("FilenameWeChatExport", r"^mmexport([0-9]{13})$", None, False),
    ("FilenameWhatsApp", r"^WhatsApp (?:Image|Video) (\d{4}-\d{2}-\d{2} at \d{2}\.\d{2}\.\d{2})", "yyyy-MM-dd 'at' HH.mm.ss", False),
    ("FilenameBareYyyymmdd", r"^(\d{8}_\d{6})$", "yyyyMMdd_HHmmss", False),
    ("FilenameUnixMillis", r"^([0-9]{13})$", None, False),
    ("FilenameDashedDateTime", r"(?=(\d{4}-\d{2}-\d{2} \d{2}-\d{2}-\d{2}))", "yyyy-MM-dd HH-mm-ss", True),
    ("FilenameBareYyyymmdd", r"(?:^|[-_ ])(?=(\d{8}))", "yyyyMMdd", True),
)


def epoch(text: Column, fmt: str) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit(fmt)))


def offset_secs(hours: int) -> int:
    """Seconds of a whole-hour offset; out of range means UTC."""
    return hours * 3600 if -23 <= hours <= 23 else 0


def _may_match(stem: Column, pattern: str) -> Column:
    """A test without a regular expression, which most names fail: how the pattern begins, how long a match is, or
    that there is a dash."""
    if literal := re.match(r"\^([A-Za-z_ ]+)", pattern):
        return stem.startswith(literal[1])
    if pattern.endswith("$"):
        return F.length(stem) == (13 if "{13}" in pattern else 15)
    return F.contains(stem, F.lit("-")) if "-" in pattern.split("(", 2)[-1] and " " in pattern else F.length(stem) >= 8


def filename_time(stem: Column, offset: int = 0) -> Column:
    """Struct (source, utc) of the first pattern with a valid time; null without one.

    A time and the number of its pattern are packed into one number, so that each name is parsed once.
    """
    found = []
    for k, (_, pattern, fmt, anywhere) in enumerate(NAME_PATTERNS):
        if fmt is None:
            utc = F.floor(F.regexp_extract(stem, pattern, 1).try_cast("bigint") / 1000)
        elif anywhere:
            utc = F.get(F.array_compact(_times(stem, pattern, fmt)), F.lit(0)) - offset
        else:
            utc = epoch(F.nullif(F.regexp_extract(stem, pattern, 1), F.lit("")), fmt) - offset
        found.append(F.when(_may_match(stem, pattern), utc.cast("bigint") * 16 + k))
    sources = F.array(*(F.lit(source) for source, *_ in NAME_PATTERNS))
    unpacked = lambda x: F.struct(F.get(sources, x.bitwiseAND(F.lit(15)).cast("int")).alias("source"), F.shiftright(x, 4).alias("utc"))
    return _first(F.transform(F.array_compact(F.array(F.coalesce(*found))), unpacked))


def _times(stem: Column, pattern: str, fmt: str) -> Column:
    return F.transform(F.regexp_extract_all(stem, F.lit(pattern), F.lit(1)), lambda t: epoch(t, fmt))


def validity(utc: Column, now: int) -> Column:
    """Valid, LowConfidencePre1995, RejectEpoch1904 or RejectFuture."""
    return (
        F.when((utc >= EPOCH_1904) & (utc < EPOCH_1904 + DAY), "RejectEpoch1904")
        .when(utc > now + DAY, "RejectFuture")
        .when(utc < YEAR_1995, "LowConfidencePre1995")
        .otherwise("Valid")
    )


def candidates(found: list[tuple[Column, Column]], now: int, more: Column | None = None) -> Column:
    """Array of candidates from (source, utc) columns in their order, and from an array of (source, utc) after them; null
    times and rejected ones are left out, and the rest is sorted by priority, time, and order. Sources that have no
    priority of their own have that of sidecars."""
    ranks = F.create_map(*(F.lit(x) for pair in PRIORITY.items() for x in pair))
    rows = [F.when(utc.isNotNull(), F.struct(F.element_at(ranks, source).alias("priority"), utc.cast("bigint").alias("utc"), F.lit(i).alias("seq"), source.alias("source"), validity(utc, now).alias("validity"))) for i, (source, utc) in enumerate(found)]
    every = F.array_compact(F.array(*rows))
    if more is not None:
        rank = lambda c: F.coalesce(F.try_element_at(ranks, c["source"]), F.lit(PRIORITY["XmpSidecar"]))
        added = F.transform(more, lambda c, i: F.struct(rank(c).alias("priority"), c["utc"].cast("bigint").alias("utc"), (i + len(found)).alias("seq"), c["source"].alias("source"), validity(c["utc"], now).alias("validity")))
        every = F.concat(every, F.coalesce(added, F.array().cast(f"array<{CANDIDATE}>")))
    return F.sort_array(F.filter(every, lambda c: ~c["validity"].startswith("Reject")))


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def decided(sorted_candidates: Column, gps: Column, modified: Column) -> Column:
    """Struct (utc, priority, source, confidence, overruled, vetoed, conflicts) of the decision; null
    without candidates."""

    def with_best(s: Column) -> Column:
        best = _first(s)
        others = F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1)))
        trusted = lambda c: c["validity"] == "Valid"
        mtimes = F.filter(s, lambda m: (m["source"] == "FsMtime") & trusted(m))
        agreed = F.filter(s, lambda f: (f["priority"] == 2) & trusted(f) & (F.abs(best["utc"] - f["utc"]) > MONTH) & F.exists(mtimes, lambda m: F.abs(f["utc"] - m["utc"]) <= DAY))
        rival = F.when(best["priority"] == 0, _first(agreed))
        return F.element_at(F.transform(F.array(rival), lambda f: with_rival(best, others, f)), 1)

    def with_rival(best: Column, others: Column, f: Column) -> Column:
        vetoed = f.isNotNull() & F.coalesce(F.abs(f["utc"] - modified) <= DAY, F.lit(False))
        overruled = f.isNotNull() & ~vetoed
        winner = F.when(overruled, f).otherwise(best)
        conflict = lambda ok, kind, utc, source, diff: F.when(ok, F.struct(F.lit(kind).alias("kind"), utc.alias("other_utc"), source.alias("other_source"), diff.alias("diff_secs")))
        none = F.lit(None).cast("string")
        gap = best["utc"] - gps
        from_gps = F.array_compact(F.array(conflict(F.abs(gap) > DAY, "GpsOver24h", gps, none, gap)))
        from_others = F.flatten(F.transform(others, lambda c: F.array_compact(F.array(
            conflict((c["priority"] == 2) & (F.abs(best["utc"] - c["utc"]) > DAY), "FilenameOver1Day", c["utc"], c["source"], best["utc"] - c["utc"]),
            conflict((c["source"] == "FsMtime") & (best["utc"] - c["utc"] > MONTH), "MtimeMuchEarlierThanP0", c["utc"], c["source"], best["utc"] - c["utc"]),
        ))))
        regular = F.concat(from_gps, from_others)
        veto = F.array_compact(F.array(conflict(vetoed, "MajorityVetoedByModifyDate", f["utc"], f["source"], best["utc"] - f["utc"])))
        overrule = F.array(conflict(F.lit(True), "P0OverruledByMajority", best["utc"], best["source"], f["utc"] - best["utc"]))
        conflicts = F.when(overruled, overrule).when(best["priority"] == 0, F.concat(veto, regular)).otherwise(F.array().cast(f"array<{CONFLICT}>"))
        return F.struct(
            winner["utc"].alias("utc"),
            winner["priority"].alias("priority"),
            winner["source"].alias("source"),
            F.when(winner["validity"] == "LowConfidencePre1995", "Low").otherwise("High").alias("confidence"),
            overruled.alias("overruled"),
            vetoed.alias("vetoed"),
            conflicts.alias("conflicts"),
        )

    return F.when(F.size(sorted_candidates) > 0, F.element_at(F.transform(F.array(sorted_candidates), with_best), 1))


def capture_time(utc: Column, mtime: Column, btime: Column, valid_from: int = YEAR_2000) -> Column:
    """The decided time, or the file system's where there is none or it is too old."""
    return F.when((utc > 0) & (utc >= valid_from), utc).otherwise(F.coalesce(mtime, btime, F.lit(0).cast("bigint")))


def first_attribute(markup: Column, name: str) -> Column:
    """Value of the first such attribute in markup, comments left out; the name must begin a word."""
    bare = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    return F.nullif(F.regexp_extract(bare, r"""[\s<]""" + name + r"""\s*=\s*["']([^"']*)["']""", 1), F.lit(""))


def json_seconds(text: Column, path: str = "$.photoTakenTime.timestamp") -> Column:
    """Seconds in JSON, as a number or a string."""
    return F.get_json_object(text, path).try_cast("bigint")
