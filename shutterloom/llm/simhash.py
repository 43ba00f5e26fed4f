"""SimHash near-dedup by meet-in-the-middle ball hashing, and an exact join of shingle sets.

Two fingerprints within distance 2h have a point within h of both. Every fingerprint emits all
variants within h bits of itself; rows meet on the variant. For h = 1 a fingerprint of 64 bits has
65 variants, and a variant is met by 65 fingerprints at most, all within 2 bits of each other: one
edge from each to the least of them keeps the links of the whole bucket, without its pairs.

Two uses:

* :func:`link_fingerprints`: fingerprints of word shingles (three words, 64 bits), linked at 2 or
  fewer differing bits, with the connected components of the links.
* :func:`near_duplicates`: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or
  more. Ball hashing of 64-bit fingerprints links the closest of them. Others differ in some ten bits:
  blocks of 32 bits with balls of radius 1 would need 24 blocks, 792 variants a text, to meet 95 % of them.
  So what the balls leave meets on shingles: in any order of all shingles, similar sets share one
  among the first fifth of each. The order is rarest first, by counts over all texts, so nearly all that
  meet are similar, and what only one text has bounds its similarity to any other. Each text is compared
  with that of each bucket that has least of its own; then the pairs of a bucket that no links join yet and whose bound
  allows it are compared, so none is left out, and a group of like texts costs no pairs. Shingles that stand out
  in blocks of texts are known before and are not shuffled, only ordered last.
  A link is verified by the shingles that both texts have.

Defined results: a null text has no words; texts without words have fingerprint zero and link like
any other in the first, and are one class in the second; repeated rows share their class; a null key never becomes a class id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.llm.common import by_batches
from shutterloom.operators.components import components
from shutterloom.session import dropped, written

#: Fixed value: the seed of the shingle hashes.
SEED = 42
#: Rows of a block, the share of all texts from which a shingle is heavy, and the most heavy ones.
BLOCK, SHARE, HEAVY = 2048, 1 / 512, 1 << 18
#: Shingles are compared by the low 48 bits of their hashes: two bytes less in each row of the largest shuffle. Of the shingles
#: that only one text has, some then count as shared, which makes bounds looser and loses nothing; two texts of
#: 100,000 shingles each share one by chance in about one pair of 28,000.
GRAM = np.uint64((1 << 48) - 1)
#: For rounding: bounds are looser by this.
SLACK = 1e-6


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8 with A-Z in lower case; white space is space and 9 to 13."""
    return text.encode().lower().split() if text else []


def shingles_of(words: list[bytes], n: int) -> list[bytes]:
    """Runs of n words, repeats included; fewer words make one shingle, none none."""
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))


def hashes_of(shingles: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def grams_of(hashes: np.ndarray) -> np.ndarray:
    """The different shingles of a text, by number."""
    return np.unique(hashes & GRAM)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes, as a signed 64-bit integer."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp long): 64-bit fingerprint of the text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(hashes_of(shingles_of(words_of(t), shingle))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=[key, "fp"])

    return by_batches(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long")


def ball(fp, bits: int = 64):
    """A fingerprint and all that differ from it in one bit."""
    masks = [1 << i if i < 63 else -(1 << 63) for i in range(bits)]
    return F.array(fp, *(fp.bitwiseXOR(F.lit(m).cast("long")) for m in masks))


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): links between different fingerprints within 2 bits that join all such fingerprints."""
    met = fps.select(F.col(fp).alias("a"), F.explode(ball(F.col(fp))).alias("variant"))
    least = met.withColumn("b", F.min("a").over(Window.partitionBy("variant")))
    return least.where("a <> b").select("a", "b").distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def link_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp long, component): the least key reachable over links of 2 or fewer bits."""
    rows = written(fingerprints(docs, key, text, shingle), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min(key).alias("least"))
    linked = components(links(fps)).select(F.col("node").alias("fp"), F.col("component").alias("root")).checkpoint()
    named = fps.join(linked, "fp").groupBy("root").agg(F.min("least").alias("component"))
    moved = linked.join(named, "root").select("fp", "component")
    of = fps.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return rows.join(of, "fp").select(key, "fp", "component")


def _scanned(docs: DataFrame, shingle: int) -> DataFrame:
    """(key, digest, content binary, n int, fp long, heavy array): digest of the words, number of distinct
    shingles, fingerprint; and, once a block of ``BLOCK`` rows, the shingles that stand out in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, np.ndarray] = {}
        rows = 0
        for batch in batches:
            out: list[tuple] = []
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                content = xxhash.xxh128_digest(b" ".join(words), SEED)
                hashes = hashes_of(shingles_of(words, shingle))
                held[content] = grams = grams_of(hashes)
                out.append((content, len(grams), majority(hashes), []))
            rows += len(out)
            if out and (rows >= BLOCK or sum(map(len, held.values())) >= BLOCK << 9):
                grams, counts = np.unique(np.concatenate(list(held.values())), return_counts=True)
                often = counts >= max(3, len(held) * SHARE // 2)
                out[-1][3].extend({"gram": g, "c": c} for g, c in zip(grams[often].view(np.int64).tolist(), counts[often].tolist(), strict=True))
                held, rows = {}, 0
            columns = zip(*out, strict=True) if out else [()] * 4
            types = (pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.struct([("gram", pa.int64()), ("c", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["key", "digest", "content", "n", "fp", "heavy"])

    return by_batches(docs, run, f"key {docs.schema['key'].dataType.simpleString()}, digest long, content binary, n int, fp long, heavy array<struct<gram: bigint, c: bigint>>")


def _heavy(rows: DataFrame, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that at least the share ``SHARE`` of all texts hold, and their counts, as
    far as blocks tell; at most ``HEAVY``. Which ones are here does not matter to what is found."""
    counts = rows.select(F.explode("heavy").alias("x")).groupBy("x.gram").agg(F.sum("x.c").alias("c")).where(F.col("c") >= SHARE * texts)
    got = counts.orderBy(F.desc("c"), "gram").limit(HEAVY).toPandas()
    grams = got["gram"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(grams)
    return grams[at], got["c"].to_numpy(np.int64)[at]


def _grams(texts: DataFrame, heavy: tuple[np.ndarray, np.ndarray], shingle: int) -> DataFrame:
    """(id, n int, grams array, heavy array<struct<c, gram>>): the shingles of each text."""
    sent = texts.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for batch in batches:
            out: list[tuple] = []
            for t in batch.column(1).to_pylist():
                grams = grams_of(hashes_of(shingles_of(words_of(t), shingle)))
                often = np.zeros(len(grams), bool)
                at = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
                if len(known):
                    often = known[at] == grams
                some = [{"c": c, "gram": g} for c, g in zip(counts[at[often]].tolist(), grams[often].view(np.int64).tolist(), strict=True)]
                out.append((len(grams), grams[~often].view(np.int64), some))
            columns = zip(*out, strict=True) if out else [()] * 3
            types = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("c", pa.int64()), ("gram", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["id", "n", "grams", "heavy"])

    return by_batches(texts.select("id", "text"), run, "id long, n int, grams array<long>, heavy array<struct<c: bigint, gram: bigint>>")


def _shared(grams: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, n, shared array<struct<c, gram>>): the shingles that other texts may have too, the rarest first."""
    met = grams.select("id", F.explode("grams").alias("gram"))
    met = met.withColumn("c", F.count("*").over(Window.partitionBy("gram"))).where("c > 1").select("id", "c", "gram")
    often = grams.select("id", F.explode("heavy").alias("x")).select("id", "x.c", "x.gram")
    lists = met.unionAll(often).repartition("id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "gram"))).alias("shared"))
    return lists.join(texts.select("id", "n"), "id").select("id", "n", "shared")


def _buckets(shared: DataFrame, similarity: float) -> DataFrame:
    """(gram, id, n, s, i) of shingles among the rarest of a text that are so for another text too: the
    text has n shingles, shares s of them with others, and i of these come before. Its own n - s are rarer still."""
    prefix = F.col("n") - F.ceil(similarity * F.col("n") - SLACK) + 1
    met = shared.select("id", "n", F.size("shared").alias("s"), "shared").withColumn("take", (prefix - F.col("n") + F.col("s")).cast("int")).where("take > 0")
    met = met.select("id", "n", "s", F.posexplode(F.slice("shared", F.lit(1), F.col("take"))).alias("i", "x")).select("x.gram", "id", "n", "s", "i")
    return met.withColumn("size", F.count("*").over(Window.partitionBy("gram"))).where("size > 1").drop("size")


def _fits(x: dict[str, Column], y: dict[str, Column], similarity: float) -> Column:
    """Whether two texts whose first common shingle is this one can be as similar: all others they share
    come after it in both. Every pair of similar texts passes at its first common shingle."""
    return F.least(x["s"] - x["i"], y["s"] - y["i"]) >= similarity / (1 + similarity) * (x["n"] + y["n"]) - SLACK


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _ball_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): links of texts whose fingerprints lie within 2 bits, by ball hashing."""
    fps = texts.where("n > 0").groupBy("fp").agg(F.min("id").alias("least"))
    of = lambda name: fps.select(F.col("fp").alias(name), F.col("least").alias(f"id_{name}"))
    near = links(fps).join(of("a"), "a").join(of("b"), "b").select(*_pairs(F.col("id_a"), F.col("id_b")))
    equal = texts.where("n > 0").join(fps, "fp").where("id <> least").select(*_pairs(F.col("id"), F.col("least")))
    return near.unionAll(equal)


def _star_pairs(buckets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): each text with that of its buckets which has the fewest shingles of its own; of edited
    copies this is the one that they come from."""
    own = {c: F.col(c) for c in ("id", "n", "s", "i")}
    rows = buckets.withColumn("first", F.min(F.struct((F.col("n") - F.col("s")).alias("own"), "id", "n", "s", "i")).over(Window.partitionBy("gram")))
    first = {c: F.col(f"first.{c}") for c in own}
    return rows.where("first.id <> id").where(_fits(own, first, similarity)).select(*_pairs(own["id"], first["id"]))


def _other_pairs(buckets: DataFrame, linked: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs of a bucket that no links join so far. A group of like texts is one component by
    now and costs nothing; the members of each other component meet those of the components after it."""
    named = buckets.join(linked.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    whole = Window.partitionBy("gram")
    mixed = named.withColumn("one", F.min("component").over(whole)).withColumn("other", F.max("component").over(whole)).where("one <> other")
    x, y = (mixed.select("gram", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "s", "i", "component"))) for k in "xy")
    a, b = ({c: F.col(f"{c}_{k}") for c in ("id", "n", "s", "i")} for k in "xy")
    return x.join(y, "gram").where("component_x < component_y").where(_fits(a, b, similarity)).select(*_pairs(a["id"], b["id"]))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """(key, digest long, class, stays boolean), once each: digest is xxhash64 of the text; class is the
    least key of the group over links of that similarity, and the row with the least (key, digest) of each group stays.
    A key may have several texts, each of them a document of its own. Rows with a null key stay, with a null class."""
    source = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), F.coalesce(text, F.lit("")).alias("text"))
    rows = written(_scanned(source, shingle), "scanned")
    keyed = rows.where("key is not null")
    texts = keyed.groupBy("content").agg(F.min(F.struct("key", "digest")).alias("one"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    heavy = _heavy(rows, texts.count())

    alone = F.row_number().over(Window.partitionBy("key", "digest").orderBy("key"))
    first = source.withColumn("row", alone).where("row = 1").join(texts.select("one.key", "one.digest", "id"), ["key", "digest"]).select("id", "text")
    shared = written(_shared(_grams(first, heavy, shingle), texts), "shared")
    buckets = written(_buckets(shared, similarity), "buckets")

    def similar(pairs: DataFrame) -> DataFrame:
        met = written(pairs.distinct(), "pairs")
        wanted = met.select(F.col("a").alias("id")).unionAll(met.select(F.col("b").alias("id"))).distinct()
        sets = written(shared.join(wanted, "id", "left_semi").select("id", "n", F.col("shared.gram").alias("grams")), "sets")
        one, other = (sets.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("grams").alias(f"grams_{k}")) for k in "ab")
        both = met.join(one, "a").join(other, "b").withColumn("both", F.size(F.array_intersect("grams_a", "grams_b")))
        out = written(both.where(F.col("both") >= similarity * (F.col("n_a") + F.col("n_b") - F.col("both")) - SLACK).select("a", "b"), "links")
        dropped(met, sets)
        return out

    found = similar(_ball_pairs(texts).unionAll(_star_pairs(buckets, similarity)))
    rest = _other_pairs(buckets, components(found), similarity)
    more = similar(rest)
    dropped(buckets, shared)
    linked = components(found.unionAll(more))
    dropped(found, more)
    of = texts.select("content", "id", "one").join(linked.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = of.groupBy("component").agg(F.min("one").alias("least"))
    of = of.join(least, "component").select("content", "least")
    here = keyed.select("key", "digest", "content").distinct().join(of, "content")
    out = here.select(F.col("key").alias(key), "digest", F.col("least.key").alias("class"), (F.struct("key", "digest") == F.col("least")).alias("stays"))
    return out.unionAll(rows.where("key is null").select(F.col("key").alias(key), "digest", F.col("key").alias("class"), F.lit(True).alias("stays")).distinct())


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row of each group of near duplicates, and all rows with a null key. Of rows that agree in key and
    text the first by their other columns stays."""
    stay = near_duplicates(docs, key, text, similarity, shingle).where(F.col("stays") & F.col(key).isNotNull()).select(F.struct(F.col(key).alias("key"), "digest").alias("named"))
    row = F.struct(*docs.columns)
    others = [c for c in docs.columns if c not in (key, text)]
    packed = docs.where(F.col(key).isNotNull()).select(F.struct(F.col(key).alias("key"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest")).alias("named"), row.alias("row"), F.to_json(F.struct(F.lit(0).alias("_"), *others)).alias("rank"))
    first = F.row_number().over(Window.partitionBy("named").orderBy("rank"))
    kept = packed.join(stay, "named", "left_semi").withColumn("nth", first).where("nth = 1").select("row.*")
    return kept.unionAll(docs.where(F.col(key).isNull()))
