"""URL filters: longest-prefix rules, then a blocked Bloom filter before an exact join.

Listed entries are host, then path. Pages and entries meet by canonical URLs: user information, port and the
closing dot of the host are taken off, the host is in lower case, and escapes of letters, digits and ``-._~`` are decoded in
the path. The filter is a table of
blocks of 256 bits, each four long integers; an entry sets one bit in each of the four. A page looks up
one block and tests four bits; rows that fail are surely unlisted. The others, listed or false
positives, meet the list in an exact join on the canonical URL.

The filter is broadcast only up to ``FILTER_BYTES``; a longer list is met by joining on the block,
which deals both sides out. Pages are not grouped: a hot host costs nothing.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule, and is
allowed; null and repeated entries of the list count once; an empty list blocks nothing, and without rules
the list alone decides; repeated pages are judged each; columns besides key and URL are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each entry; with four probes in a block some 0.5 % of unlisted URLs pass.
BITS_AN_ENTRY, BLOCK_BITS, LONGS = 16, 256, 4
#: Largest filter that is broadcast.
FILTER_BYTES = 8 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only), and path, of everything after the first ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, letters, letters.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def fits(host: Column, path: Column, rule: str) -> Column:
    """Whether a rule such as ``example.com/de/`` holds for a host, its subdomains, and the path."""
    name, slash, prefix = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    rule = verdict = None
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in sorted(rules, key=lambda r: (-len(r), r)):
        ok = fits(host, path, text)
        rule = F.when(ok, text) if rule is None else rule.when(ok, text)
        verdict = F.when(ok, rules[text]) if verdict is None else verdict.when(ok, rules[text])
    return rule, verdict


def _probes(entry: Column, blocks: Column | int) -> list[Column]:
    """Block of an entry, and its bit in each of the block's four integers."""
    block = F.pmod(F.xxhash64(entry), F.lit(blocks) if isinstance(blocks, int) else blocks)
    other = F.xxhash64(entry, F.lit("bits"))
    return [block, *(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(other, 8 * i), F.lit(64)).cast("int")) for i in range(LONGS))]


def bloom_filter(listed: DataFrame, entry: str = "entry") -> tuple[DataFrame, int]:
    """(block, w0 .. w3) of the blocks that have entries, and the number of blocks."""
    entries = listed.where(F.col(entry).isNotNull()).select(entry).distinct()
    blocks = max(1, -(-entries.count() * BITS_AN_ENTRY // BLOCK_BITS))
    names = ["block", *(f"w{i}" for i in range(LONGS))]
    probes = entries.select(*(c.alias(n) for c, n in zip(_probes(F.col(entry), blocks), names, strict=True)))
    return probes.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names[1:])), blocks


def possible_rows(pages: DataFrame, listed: DataFrame, keys: str = "canonical", entry: str = "entry") -> DataFrame:
    """(_row, _key) of the canonical URLs that pass the filter: all listed ones and some others."""
    blocks_table, blocks = bloom_filter(listed, entry)
    if blocks * BLOCK_BITS // 8 <= FILTER_BYTES:
        blocks_table = F.broadcast(blocks_table)
    probed = pages.select("_row", F.explode(F.array_distinct(F.col(keys))).alias("_key"))
    names = ["block", *(f"_p{i}" for i in range(LONGS))]
    probed = probed.select("_row", "_key", *(c.alias(n) for c, n in zip(_probes(F.col("_key"), blocks), names, strict=True)))
    passed = F.lit(True)
    for i in range(LONGS):
        passed = passed & (F.col(f"w{i}").bitwiseAND(F.col(f"_p{i}")) != 0)
    return probed.join(blocks_table, "block").where(passed).select("_row", "_key")


def listed_rows(pages: DataFrame, listed: DataFrame, keys: str = "canonical", entry: str = "entry", into: str = "is_listed") -> DataFrame:
    """All rows and a boolean column: whether any of the row's array of canonical URLs is listed.

    Rows need a unique column ``_row``; one row for each key is probed in the filter."""
    possible = possible_rows(pages, listed, keys, entry)
    exact = listed.where(F.col(entry).isNotNull()).select(F.col(entry).alias("_key")).distinct()
    hits = possible.join(exact, "_key").select("_row").distinct().withColumn(into, F.lit(True))
    return pages.join(hits, "_row", "left").withColumn(into, F.coalesce(into, F.lit(False)))


#: Characters whose escapes mean the same as themselves.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def plain_host(host: Column) -> Column:
    """A host without user information, port and closing dot, in lower case (A-Z only)."""
    bare = F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")
    letters = UNRESERVED[:26]
    return F.translate(F.regexp_replace(bare, r"\.$", ""), letters, letters.lower())


def plain_path(path: Column) -> Column:
    """A path with the escapes of unreserved characters decoded."""
    table = F.create_map(*(F.lit(x) for c in UNRESERVED for x in (f"{ord(c):02X}", c)))

    def piece(p: Column, i: Column) -> Column:
        known = F.try_element_at(table, F.upper(F.substring(p, 1, 2)))
        return F.when(i == 0, p).otherwise(F.coalesce(F.concat(known, F.substr(p, F.lit(3))), F.concat(F.lit("%"), p)))

    return F.when(F.contains(path, F.lit("%")), F.array_join(F.transform(F.split(path, "%"), piece), "")).otherwise(path)


def canonical_entry(entry: Column) -> Column:
    """A listed entry as pages are looked up by."""
    at = F.instr(entry, "/")
    host, path = F.when(at > 0, F.substr(entry, F.lit(1), at - 1)).otherwise(entry), F.when(at > 0, F.substr(entry, at)).otherwise("")
    return F.concat(plain_host(host), plain_path(path))


def canonical_keys(host: Column, path: Column) -> Column:
    """What a list may name a page by: the host or any parent domain with ``/``, and the host with its
    path, without a closing slash."""
    host, path = plain_host(host), plain_path(path)
    parts = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, -n, n), "."), F.lit("/")))
    page = F.concat(host, F.regexp_replace(path, "/+$", ""))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_append(parents, page))


def judged(pages: DataFrame, listed: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url", entry: str = "entry") -> DataFrame:
    """(key, host, path, rule, verdict): the longest fitting rule's verdict, or else block for listed
    pages. Only distinct URLs without a rule are looked up."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(key, host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    listed = listed.select(canonical_entry(F.col(entry)).alias(entry))
    open_ = F.col("rule").isNull() & (F.col("host") != "")
    unruled = rows.where(open_).select("host", "path").distinct()
    unruled = unruled.select(F.struct("host", "path").alias("_row"), canonical_keys(F.col("host"), F.col("path")).alias("canonical"))
    found = listed_rows(unruled, listed, entry=entry).where("is_listed").select(F.col("_row.host").alias("host"), F.col("_row.path").alias("path"), F.lit("block").alias("listed"))
    # pages that a rule decides, and those without a host, are not shuffled
    judged_now = rows.where(~open_).withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    looked_up = rows.where(open_).join(found, ["host", "path"], "left").withColumn("verdict", F.coalesce("listed", F.lit("allow")))
    names = [key, "host", "path", "rule", "verdict"]
    return judged_now.select(names).unionAll(looked_up.select(names))
