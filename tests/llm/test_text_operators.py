import functools
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import decontam, secrets, tokencount
from shutterloom.llm.queries import PIECES, op3_secrets, op4_decontamination, op6_token_counts


def brute_spans(text):
    text, out = text or "", []
    kinds = [("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 1, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
    for n, (kind, pattern, group, least) in enumerate(kinds):
        at = 0
        while m := re.compile(pattern).search(text, at):
            if len(m.group(group)) >= least:
                out.append((m.start(), n, kind, m.end()))
            at = m.end()
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def test_secrets_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = op3_secrets(spark, sf_dir).collect()
    assert len(rows) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in rows)
    for r in rows:
        want = brute_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x.split(":")[0] in secrets.BASE] == want


def test_ledger(spark, tmp_path, monkeypatch):
    texts = [None, "", "é😀 Password = 'abcdefgh1' ſecret=abcdefgh2", "token=secret: abcdefghi", "AKIA" + "B" * 12 + " " + "0a" * 16, "x" * 70000 + " api_key:" + "k" * 40, "ghp_" + "a" * 36]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, texts[2]])], "doc_id long, text string, blob int")
    ledger = f"file://{tmp_path}/ledger"
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.findings(docs, ledger).collect()}
    for i, t in enumerate(texts):
        assert [f"{k}:{a}:{b}" for k, a, b in got[i] if k in secrets.BASE] == brute_spans(t)
    assert got[7] == got[2] and got[6][0][0] == "github"
    scanned = []
    real = secrets._scanned
    monkeypatch.setattr(secrets, "_scanned", lambda texts: scanned.append(texts.select("blob").distinct().count()) or real(texts))
    assert secrets.findings(docs.unionAll(spark.createDataFrame([(50, "new", 1)], docs.schema)), ledger).count() == 9
    assert secrets.findings(docs, ledger, rules="next").count() == 8
    assert scanned == [1, 6]
    clean = {r.doc_id: r.text for r in secrets.redacted(docs, ledger).collect()}
    assert clean[2] == "é😀 <secret>' ſecret=abcdefgh2" and clean[0] is None and clean[5].endswith("x <secret>") and clean[3] == texts[3]


def brute_align(item, part):
    table = [[0] * (len(part) + 1) for _ in range(len(item) + 1)]
    for i, x in enumerate(item, 1):
        for j, y in enumerate(part, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (1 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table))


def test_alignment():
    rnd = random.Random(4)
    for _ in range(200):
        item, part = (np.array([rnd.randint(1, 5) for _ in range(rnd.randint(1, 20))]) for _ in range(2))
        kept, first, last = decontam.align(item, part)
        score = brute_align(item.tolist(), part.tolist())
        assert (kept == 0) == (score == 0)
        if kept:
            assert score <= kept <= min(len(item), last - first)
            assert brute_align(item.tolist(), part[first:last].tolist()) == score


def test_decontamination(spark, sf_dir):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(20, 60)))) for i in range(20)] + [(20, "one"), (21, "two words"), (22, ""), (23, None), (None, "never mind this item")]
    docs, want = [], set()
    for d in range(120):
        words = [word() for _ in range(rnd.randint(10, 300))]
        if d % 3 == 0:
            i = d % 20
            copy = items[i][1].split()
            for _ in range(int(len(copy) * 0.1) if d % 2 else 0):
                copy[rnd.randrange(len(copy))] = word()
            if d % 5 == 0:
                copy = [w.upper() + "," for w in copy]
            at = rnd.randrange(len(words))
            words[at:at] = copy
            want.add((d, i))
        docs.append((d, " ".join(words), 1))
    docs += [(900, None, 1), (901, "", 1), (902, "so Two  words.", 1), (903, "one", 1)]
    want |= {(902, 21), (903, 20)}
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(frame, tests).collect()} == want
    assert {r.doc_id for r in decontam.clean(frame, tests).collect()} == {d for d, *_ in docs} - {d for d, _ in want}
    assert decontam.contaminated(frame, tests.limit(0)).count() == 0
    found = op4_decontamination(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    whole = {(d, r.item_id) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for d, t in texts.items() if r.text in (t or "")}
    assert whole <= {(r.doc_id, r.item_id) for r in found} and whole


def plain_alignment(item, text):
    """Best (score, matched words) over all local alignments, a cell at a time."""
    best, row = (0, 0), [(0, 0)] * (len(text) + 1)
    for x in item:
        new = [(0, 0)]
        for j, y in enumerate(text, 1):
            s, k = row[j - 1]
            cell = max((0, 0), (s + 1, k + 1) if x == y else (s - 1, k), (row[j][0] - 1, row[j][1]), (new[j - 1][0] - 1, new[j - 1][1]))
            new.append(cell if cell[0] > 0 else (0, 0))
        row = new
        best = max(best, max(row))
    return best


def test_decontamination_query_against_plain_alignment(spark):
    """All pairs of documents and items that share enough words at all, without seeds."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: decontam.words_of(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: decontam.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    counts, expected = {d: Counter(w) for d, w in docs.items()}, set()
    for i, item in items.items():
        need = Counter(item)
        for d, words in docs.items():
            if sum((need & counts[d]).values()) >= 0.8 * len(item):
                kept = plain_alignment(item, words)[1]
                if kept >= 0.8 * len(item):
                    expected.add((d, i, kept / len(item)))
    assert expected and {(r.doc_id, r.item_id, r.score) for r in op4_decontamination(spark, sf).collect()} == expected


def test_copy_at_the_end_of_a_very_long_text():
    own = decontam.Items([(1, " ".join(f"w{i}" for i in range(30))), (2, "w0 w1 w2 " * 2)])
    copy = [f"w{i}" for i in range(30)]
    text = " ".join(["w0 w1 w2 other"] * 300_000 + copy)
    assert own.matches(text)[0] == (1, 1.0, 1_200_000, 1_200_030)
    numbers = np.concatenate([np.zeros(1_200_000, np.int64), own.numbers[0]])
    assert decontam.align(own.numbers[0], numbers) == (30, 1_200_000, 1_200_030)


def test_decontamination_of_three_word_runs(spark):
    """Copies that keep only three words in a row, beside whole copies that make these runs less rare."""
    short, long = [f"s{i}" for i in range(15)], [f"l{i}" for i in range(30)]
    replaced = [w if i % 4 != 3 else f"other{i}" for i, w in enumerate(short)]
    spaced = [x for i, w in enumerate(long) for x in ([w, f"added{i}"] if i % 3 == 2 else [w])]
    docs = spark.createDataFrame([(1, " ".join(replaced)), (2, " ".join(spaced)), (3, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontam.contaminated(docs, items).collect()) == [(1, 1, 0.8), (2, 2, 1.0)]
    assert [r.doc_id for r in decontam.clean(docs, items).collect()] == [3]


def test_token_counts(spark, sf_dir):
    model = tokencount.Unigram({tokencount.MARK: -1.0, "a": -2.0, "b": -2.5, "ab": -3.0, "aba": -4.0, tokencount.MARK + "a": -2.0}, True)

    def brute(text):
        best = {0: (0.0, 0)}
        for end in range(1, len(text) + 1):
            options = [(best[k][0] + model.scores[text[k:end]], -best[k][1] + -1) for k in range(end) if text[k:end] in model.scores]
            if text[end - 1] not in model.scores:
                options.append((best[end - 1][0] + tokencount.UNKNOWN, -best[end - 1][1] - len(text[end - 1].encode())))
            score, count = max(options)
            best[end] = (score, -count)
        return best[len(text)][1]

    rnd = random.Random(6)
    words = list({"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9))) for _ in range(300)})
    model.learn(words)
    assert {w: model.known[w] for w in words} == {w: brute(tokencount.MARK + w) for w in words}
    docs = spark.createDataFrame([(1, None, 2), (1, "", 2), (2, "the  end\nthe", 2), (None, "漢 " * 9000, 2)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_pre_tokens) for r in tokencount.token_counts(docs, PIECES).collect())
    assert got == [(0, 9000), (1, 0), (1, 0), (2, 3)]
    assert tokencount.token_counts(docs.limit(0), PIECES).count() == 0


def test_token_count_query_against_plain_search(spark):
    """The query over the real vocabulary against a search of its own for each word."""
    sf, model = "/root/testdata/sf0.001", tokencount.piece_model(PIECES)
    longest = max(map(len, model.scores))

    @functools.cache
    def count(word):
        text = tokencount.MARK + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            options = [(best[k][0] + model.scores[text[k:end]], best[k][1] - 1) for k in range(max(0, end - longest), end) if text[k:end] in model.scores]
            if text[end - 1] not in model.scores:
                options.append((best[end - 1][0] + tokencount.UNKNOWN, best[end - 1][1] - (len(text[end - 1].encode()) if model.bytes_too else 1)))
            best.append(max(options))
        return -best[-1][1]

    expected = sorted((r.doc_id, len((r.text or "").split()), sum(map(count, (r.text or "").split()))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted((r.doc_id, r.n_pre_tokens, r.n_tokens) for r in op6_token_counts(spark, sf).collect()) == expected


def edited(rnd, words, kind, share):
    """A copy by one kind of edit."""
    if kind == "added after every second":
        return [w for i, x in enumerate(words) for w in ([x, f"new{rnd.random()}"] if i % 2 else [x])]
    out = []
    for w in words:
        hit = rnd.random() < share
        out += {"added": [w, f"new{rnd.random()}"] if hit else [w], "replaced": [f"new{rnd.random()}"] if hit else [w], "left out": [] if hit else [w], "mixed": rnd.choice([[], [f"new{rnd.random()}"], [w, "the"]]) if hit else [w]}[kind]
    return out


@pytest.mark.parametrize("common", [False, True])
def test_recall_by_kind_of_edit(common):
    """Whatever align scores at 0.8 or more over the whole text is met, also when the corpus is full of the item's words."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60 if common else 4000)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([3, 4, 5, 8, 15, 30, 60])))) for i in range(120)]
    own = decontam.Items(items)
    counts = np.ones(len(own.number) + 1, np.int64)
    counts[1:] = [rnd.randrange(500) for _ in own.number]
    own.choose(counts)
    met = Counter()
    for kind, share in (("added after every second", 0), ("added", 0.35), ("replaced", 0.12), ("left out", 0.15), ("mixed", 0.2)):
        for k, text in items:
            copy = edited(rnd, text.split(), kind, share)
            filler = lambda n: [rnd.choice(vocabulary) if rnd.random() < 0.5 else f"x{rnd.random()}" for _ in range(n)]
            doc = " ".join(filler(rnd.randrange(80)) + copy + filler(rnd.randrange(80)))
            item = own.numbers[k]
            kept, *_ = decontam.align(item, own.numbered(doc))
            if kept >= 0.8 * len(item) - 1e-9:
                met[kind] += 1
                assert k in {m[0] for m in own.matches(doc)}, (kind, text, doc)
    assert all(n > 50 for n in met.values()), met


def test_items_with_names_of_any_type(spark):
    docs = spark.createDataFrame([("a", "one two three four five six seven")], "doc_id string, text string")
    items = spark.createDataFrame([("q1", "two three four five"), ("q2", "nothing of this kind here")], "item_id string, text string")
    assert [(r.doc_id, r.item_id, r.score) for r in decontam.contaminated(docs, items).collect()] == [("a", "q1", 1.0)]


def test_redaction_of_many_findings():
    """Thousands of findings in one text, some overlapping, in time that grows with the text."""
    text = " ".join(f"x{i}é AKIA{'B' * 16} password={'c' * 9}" for i in range(20_000))
    spans = [(a, b) for a, _, b in secrets.found_in(text)]
    out = secrets.without_spans(text, spans + [(a, b + 0) for a, b in spans])
    assert len(spans) == 40_000 and out == " ".join(f"x{i}é <secret> <secret>" for i in range(20_000))
    assert secrets.without_spans("abcdef", [(1, 3), (2, 4), (4, 5)]) == "a<secret><secret>f" and secrets.without_spans("ab", []) == "ab"


def test_redaction_keeps_rows(spark):
    rows = [(i, None if i % 7 == 0 else f"text {i % 5} " + ("password=abcdefgh1" if i % 3 == 0 else ""), i, "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, blob string")
    got = sorted(map(tuple, secrets.redacted(docs).collect()))
    assert got == sorted((i, t if t is None else t.replace("password=abcdefgh1", "<secret>"), n, b) for i, t, n, b in rows)
    assert secrets.redacted(docs.limit(0)).collect() == []
