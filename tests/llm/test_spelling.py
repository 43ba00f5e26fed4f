"""Spelling groups against deletion neighbourhoods of all words."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

from shutterloom.llm import spelling
from shutterloom.llm.queries import op13_spelling


def brute(docs, one_in=199):
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if d is None else d}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    left, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            left[i, w[:i] + w[i + 1 :]].add(w)
            if (cut := w[:i] + w[i + 1 :]) in words:
                near[w].add(cut)
                near[cut].add(w)
    for same in left.values():
        for a in same:
            near[a] |= same - {a}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 5 * n:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def test_query_equals_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op13_spelling(spark, sf_dir).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == brute(docs)


def test_chains_anagrams_and_odd_rows(spark):
    rng = random.Random(3)
    words = [("abcdefgh", 700), ("abcdefg", 120), ("abcdexg", 20), ("abcdeg", 5), ("hgfedcba", 30), ("éàüßñø", 9), ("éàüßñ", 50), ("xxxxxx", 6), ("xxxxxxx", 6), ("xxxxxxxx", 31), ("q" * 3000, 5), ("q" * 2999 + "z", 40), ("ABCDEFGH", 3)]
    parts = ["".join(p) for p in __import__("itertools").permutations(["an", "er", "in", "st"])]
    runs = [w for w, n in words for _ in range(n)] + [w for w in parts for _ in range(5 + rng.randrange(40))]
    rng.shuffle(runs)
    docs = [(i, " ".join(runs[i::40])) for i in range(40)] + [(None, "abcdefgh 1 abcdefgh"), (41, None), (42, ""), (0, " ".join(runs[0::40])), (43, "12 !? āł")]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, WORD string")
    for one_in in (199, 7):
        got = spelling.spelling_groups(df, one_in=one_in).collect()
        assert set(map(tuple, got)) == brute(docs, one_in) and len(got) == len(set(got))
    plain = {r["word"]: r for r in spelling.spelling_groups(df).collect()}
    assert plain["abcdeg"]["root"] == "abcdefgh" and plain["abcdefgh"]["form"] is None and plain["hgfedcba"]["n_near"] == 0
    assert spelling.spelling_groups(df.where("doc_id = 41")).collect() == [] and spelling.spelling_groups(df.limit(0)).collect() == []
