import random

import xxhash
from pyspark.sql import functions as F

from shutterloom.llm import simhash
from shutterloom.llm.queries import op2_simhash
from shutterloom.operators.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for a, b in edges if None not in (a, b) and a != b for x in (a, b)}
    pairs = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    assert got == brute_components(ends, lambda a, b: (a, b) in pairs)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    classes = brute_components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, sf_dir).collect()}
    assert got == {k: (f"{v:016x}", classes[k]) for k, v in fps.items()}


def test_linked_chain_and_odd_rows(spark):
    base = 0x0123456789ABCDEF
    values = [base, base ^ 3, base ^ 15, base ^ 0xFF, (1 << 63) | 5, 5, 0]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))).collect()
    assert {frozenset(r.node for r in found if r.component == c) for c in {r.component for r in found}} == {frozenset(signed[:3]), frozenset(signed[4:])}
    rows = [(4, None, 1), (2, "", 2), (9, "\t \n", 3), (None, "One two", 4), (7, "one TWO", 5), (8, "word " * 5000, 6), (8, "word " * 5000, 6)]
    got = simhash.link_fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted((r.doc_id or 0, r.component) for r in got) == [(0, 7), (2, 2), (4, 2), (7, 7), (8, 8), (8, 8), (9, 2)]
    assert simhash.link_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(900)]
    texts = {}
    for base in range(40):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 400))]
        texts[len(texts)] = " ".join(words)
        for edits in (0, 1, 2, 6):
            copy = list(words)
            for _ in range(edits):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            texts[len(texts)] = " ".join(copy)
    texts |= {900: "", 901: " ", 902: None, 903: "short one", 904: "short one"}
    sets = {k: set(simhash.shingles_of(simhash.words_of(t), 5)) for k, t in texts.items()}

    def similar(a, b):
        return sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r["class"] for r in simhash.near_duplicates(docs).collect()} == brute_components(texts, similar)
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_interleaved_families_in_one_bucket(spark):
    """Two families share enough shingles to meet in the same buckets; their ids interleave."""
    rnd = random.Random(8)
    word = lambda n=3: "".join(rnd.choice("abcdefghij") for _ in range(n))
    shared = [word(8) for _ in range(151)]
    ends = [[word() for _ in range(20)] for _ in "ab"]
    texts = {}
    for i in range(40):
        texts[i] = " ".join(shared + ends[i % 2] + [word()])
    sets = {k: set(simhash.shingles_of(simhash.words_of(t), 5)) for k, t in texts.items()}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.9 * len(sets[a] | sets[b])
    want = brute_components(texts, similar)
    assert set(want.values()) == {0, 1}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r["class"] for r in simhash.near_duplicates(docs, similarity=0.9).collect()} == want


def test_added_and_cut_passages_against_brute_force(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    texts = {}
    for _ in range(60):
        words = [word() for _ in range(rnd.randint(60, 600))]
        n = len(words)
        texts[len(texts)] = " ".join(words)
        for share in (0.79, 0.8, 0.82, 0.9):
            texts[len(texts)] = " ".join(words[: int(n * share) + 1])
            texts[len(texts)] = " ".join(words + [word() for _ in range(int(n / share) - n)])
    keys = list(texts)
    rnd.shuffle(keys)
    texts = dict(zip(keys, texts.values(), strict=True))
    sets = {k: set(simhash.shingles_of(simhash.words_of(t), 5)) for k, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_components(texts, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r.doc_id: r["class"] for r in simhash.near_duplicates(docs).collect()} == want
