"""Secret scans with an incremental ledger of blobs.

Every version of a document is a blob, addressed by the SHA-256 of its text. The ledger, a Parquet
table that is only appended to and partitioned by rule version, holds the findings of each (blob, rule version) pair that
was ever scanned, also when there are none. A scan looks up the blobs at hand by their addresses alone, scans the unseen
ones, appends, and joins the findings back to all paths that hold the blob. The rule version is a hash of the
patterns, so new rules scan everything once more; a job that died before its append scans the same blobs
again, and double entries count once.

Texts are not shuffled: a filter of the addresses wanted (``FILTER_LONGS`` integers, one bit an address) goes to the
tasks, and what passes it is scanned where it lies, once a task; false hits are dropped by a join of addresses. In the same way
only texts with findings, and few others, are dealt out to be redacted.

Defined results: a null text is the empty blob; repeated rows keep their row each; overlapping spans
of different kinds are all reported, and merged when a text is redacted; a redacted null text without findings stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterloom.llm.common import by_batches, text_column, unused
from shutterloom.session import dropped, exists, fresh_path, written

#: The base kinds in their order, with the pattern, the group that is measured, and its
#: least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]{32,}"), 0, 32),
}
#: What this version adds: key blocks, and tokens with a known prefix; the string must be in the text.
MORE = {
    "private_key": ("-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    "github": ("gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    "jwt": ("eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
}
KINDS = (*BASE, *MORE)
#: Version of the rules: a hash of the patterns, groups and least lengths.
RULES = hashlib.sha256(repr([(k, p.pattern, p.flags, g, n) for k, (p, g, n) in BASE.items()] + [(k, x, p.pattern, p.flags) for k, (x, p) in MORE.items()]).encode()).hexdigest()[:16]
#: Integers of the filter of addresses, 8 MiB, and addresses that a task remembers to have scanned.
FILTER_LONGS, REMEMBERED = 1 << 20, 1 << 20
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def found_in(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all findings, in order."""
    out = []
    for k, (pattern, group, least) in enumerate(BASE.values()):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    for k, (needed, pattern) in enumerate(MORE.values(), len(BASE)):
        if needed in text:
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return sorted(out)


def _scanned(texts: DataFrame) -> DataFrame:
    """(blob, spans) from (blob, text): each blob once a task."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            blobs, spans = [], []
            for blob, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if blob not in seen:
                    seen.add(blob)
                    blobs.append(blob)
                    spans.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found_in(text.as_py())])
            if len(seen) > REMEMBERED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(spans, kind)], names=["blob", "spans"])

    return by_batches(texts, run, f"blob string, spans {SPANS}")


def blob_of(text: str = "text"):
    return F.sha2(text_column(text).cast("binary"), 256)


def _bit(blob) -> tuple:
    """Place of an address in the filter: the integer, and the integer with its bit set."""
    h = F.xxhash64(blob)
    return F.pmod(h, F.lit(FILTER_LONGS)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int"))


def _possible(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (with a column ``blob``) that may be of the wanted blobs, all of these among them, and the rows that surely aren't."""
    place, bit = _bit(F.col("blob"))
    longs = wanted.select(place.alias("_place"), bit.alias("_bit")).groupBy("_place").agg(F.bit_or("_bit").alias("_bits"))
    place, bit = _bit(F.col("blob"))
    met = rows.withColumn("_place", place).join(F.broadcast(longs), "_place", "left")  # FILTER_LONGS rows at most
    hit = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return met.where(hit).select(*rows.columns), met.where(~hit).select(*rows.columns)


def _read(spark: SparkSession, ledger: str, rules: str) -> DataFrame:
    return spark.read.schema(f"blob string, spans {SPANS}, rules string").parquet(ledger).where(F.col("rules") == rules)


def _unseen(versions: DataFrame, ledger: str, text: str, rules: str) -> DataFrame | None:
    """(blob) of those that the ledger has not under these rules; none if it has nothing at all."""
    spark = versions.sparkSession
    if not exists(spark, f"{ledger}/rules={rules}"):
        return None
    seen = _read(spark, ledger, rules).select("blob")
    return written(versions.select(blob_of(text).alias("blob")).distinct().join(seen, "blob", "left_anti"), "unseen")


def scan(versions: DataFrame, ledger: str | None = None, text: str = "text", rules: str = RULES) -> DataFrame:
    """(blob, spans) of every blob among the versions, once each. The ledger is a path; without one,
    a new ledger is made in the shared folder."""
    spark = versions.sparkSession
    ledger = ledger or fresh_path(spark, "ledger")
    texts = versions.select(blob_of(text).alias("blob"), text_column(text).alias("text"))
    unseen = _unseen(versions, ledger, text, rules)
    found = _scanned(texts) if unseen is None else _scanned(_possible(texts, unseen)[0]).join(unseen, "blob", "left_semi")
    found.dropDuplicates(["blob"]).withColumn("rules", F.lit(rules)).write.mode("append").partitionBy("rules").parquet(ledger)
    known = _read(spark, ledger, rules)
    if unseen is not None:
        dropped(unseen)
        known = known.join(versions.select(blob_of(text).alias("blob")).distinct(), "blob", "left_semi")
    return known.dropDuplicates(["blob"]).select("blob", "spans")


def findings(versions: DataFrame, ledger: str | None = None, path: str = "doc_id", text: str = "text", rules: str = RULES) -> DataFrame:
    """(path, blob, spans) of every version."""
    known = scan(versions, ledger, text, rules)
    return versions.select(path, blob_of(text).alias("blob")).join(known, "blob").select(path, "blob", "spans")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each run of overlapping spans replaced by ``<secret>``."""
    out, done = [], 0
    open_, end = None, 0
    for a, b in sorted(spans):
        if open_ is not None and a < end:
            end = max(end, b)
            continue
        if open_ is not None:
            out += [text[done:open_], "<secret>"]
            done = end
        open_, end = a, b
    if open_ is not None:
        out += [text[done:open_], "<secret>"]
        done = end
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame, ledger: str | None = None, text: str = "text", rules: str = RULES) -> DataFrame:
    """The documents with each run of findings replaced by ``<secret>``. Only texts whose blob may have findings are
    joined to them, the others stay where they are."""
    known = scan(docs, ledger, text, rules).where(F.size("spans") > 0)
    rows = docs.select(blob_of(text).alias("blob"), F.struct(*docs.columns).alias("row"))
    possible, clean = _possible(rows, known.select("blob"))
    both = possible.join(known, "blob", "left").select("row.*", F.col("spans").alias(spans := unused(docs, "spans")))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, found = batch.columns
            texts = [t if not s else without_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(columns[at].to_pylist(), found.to_pylist(), strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    assert both.columns[-1] == spans
    return by_batches(both, run, docs.schema).unionAll(clean.select("row.*"))
