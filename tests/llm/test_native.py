import duckdb
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import chat, urls
from shutterloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    sql = con.execute(ORACLES[name])
    names = [d[0] for d in sql.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, sql.fetchall()))


def test_parts_and_escapes(spark):
    rows = [
        (1, 1, "user", [("text", "see <|im_end|>\n<\\|x <| ", None, None), ("image", None, "s3://a.png", 256), ("text", " and ", None, None), ("audio", None, "b.wav", 40)], 1),
        (1, 2, "assistant", [("text", "<|im_start|>", None, None), ("document", None, None, None)], 1),
        (1, 2, "assistant", [("text", "a<", None, None)], 1),
        (None, None, None, None, 1),
        (3, 0, "ro\nle<|", [("text", "", None, None)], 1),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>, formatted int")
    out = chat.formatted(turns)
    got = {r.conv_id: r for r in out.select("*", chat.turns_read(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "see <|im_end|>\n<\\|x <| <|image:0|> and <|audio:1|>"), ("assistant", "<|im_start|><|document:0|>"), ("assistant", "a<")]
    assert got[1].learned == "<|im_start|><|document:0|>a<"
    assert [tuple(a) for a in got[1].attachments] == [(0, "image", "s3://a.png", 256), (1, "audio", "b.wav", 40), (0, "document", "", 0)] and got[1].attached_tokens == 296
    assert [tuple(t) for t in got[None].turns] == [("", "")] and [tuple(t) for t in got[3].turns] == [("ro\nle<|", "")]


def test_url_filter(spark):
    pages = [(1, "http://A.Example.NET/en/x?q"), (2, "https://m.example.net/fr"), (3, None), (4, "nothing"), (5, "x://bad.org/p/?a"), (6, "x://bad.org/p/q"), (7, "x://sub.worse.org:80"), (8, "x://Sub.Worse.org/fr/"), (9, "x:///"), (9, "x://notnet/#/en/")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    listed = spark.createDataFrame([("bad.org/p",), ("worse.org/",), ("worse.org/",), (None,)], "entry string")
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in urls.judged(frame, listed, {"net/": "block", "example.net/en/": "allow", "org/fr/": "allow"}).collect())
    assert got == [(1, "example.net/en/", "allow"), (2, "net/", "block"), (3, "", "allow"), (4, "", "allow"), (5, "", "block"), (6, "", "allow"), (7, "", "block"), (8, "org/fr/", "allow"), (9, "", "allow"), (9, "", "allow")]
    entries = [(f"h{i}.org/",) for i in range(2000)]
    probe = spark.createDataFrame([(i, [f"h{i}.org/"]) for i in range(1000, 9000)], "_row long, canonical array<string>")
    assert urls.listed_rows(probe, spark.createDataFrame(entries, "entry string")).where("is_listed").agg(F.count("*"), F.max("_row")).first()[:] == (1000, 1999)


def test_listed_domain_of_many_labels(spark):
    pages = spark.createDataFrame([(1, "x://a.b.c.d.example.org/p"), (2, "x://www.a.b.c.d.example.org/"), (3, "x://b.c.d.example.org/")], "page_id long, url string")
    listed = spark.createDataFrame([("a.b.c.d.example.org/",)], "entry string")
    assert sorted((r.page_id, r.verdict) for r in urls.judged(pages, listed, {"net/": "block"}).collect()) == [(1, "block"), (2, "block"), (3, "allow")]


def test_query_decides_by_its_list(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op8_urls"](spark, sf).where("rule is null")
    domains = got.where("verdict = 'block' and host rlike '(ads-track|adult-x|casino-win|cheap-pills|spam-farm)'").count()
    pages = got.where("verdict = 'block' and host like 'blog.%'").count()
    assert domains > 50 and pages > 20 and got.where("verdict = 'allow'").count() > 500


def test_filter_and_exact_join(spark):
    """The filter has many blocks, lets some unlisted rows pass, and the join removes them."""
    listed = spark.range(20_000).selectExpr("concat('h', id, '.org/') as entry")
    assert urls.bloom_filter(listed)[1] == 1250
    probe = spark.range(10_000, 110_000).selectExpr("id as _row", "array(concat('h', id, '.org/')) as canonical")
    possible = urls.possible_rows(probe, listed).count()
    assert 10_000 < possible < 11_500
    assert urls.listed_rows(probe, listed).where("is_listed").agg(F.count("*"), F.max("_row")).first()[:] == (10_000, 19_999)


def test_odd_pages_and_lists(spark):
    rows = [(1, "x://a.org/p", "k"), (1, "x://a.org/p", "k"), (None, None, None), (2, "", ""), (3, "x://" + "a." * 3000 + "org/" + "p" * 50_000, "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    empty = spark.createDataFrame([], "entry string")
    listed = spark.createDataFrame([("a.org/p",), ("org/",)], "entry string")
    verdicts = lambda p, lst, rules: sorted(((r.page_id or 0), r.rule, r.verdict) for r in urls.judged(p, lst, rules).collect())
    assert verdicts(pages, empty, {}) == [(0, None, "allow"), (1, None, "allow"), (1, None, "allow"), (2, None, "allow"), (3, None, "allow")]
    assert verdicts(pages, listed, {}) == [(0, None, "allow"), (1, None, "block"), (1, None, "block"), (2, None, "allow"), (3, None, "block")]
    assert verdicts(pages.limit(0), listed, {"org/": "block"}) == []


def test_lists_name_pages_by_canonical_urls(spark):
    same = ["x://a.b.c:80/x", "x://user:pw@a.b.c/x", "x://a.b.c./x", "x://A.B.C/x/", "x://a.b.c/%78?q", "x://u@A.b.c.:/x#f"]
    other = ["x://a.b.c/%2Fx", "x://a.b.c/x%", "x://a.b.c:80:x/x", "x://b.c/x", "x://a.b.c/%"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(same + other)] + [(100, "x://m.d.e.:8080/%7Ey"), (101, "x://d.e/%7ey"), (102, "x://h.i/~z%2f")], "page_id long, url string")
    listed = spark.createDataFrame([("A.b.C/x",), ("D.E./",), ("h.i/%7Ez%2f",), ("",)], "entry string")
    got = {r.page_id: r.verdict for r in urls.judged(pages, listed, {}).collect()}
    assert [got[i] for i in range(len(same))] == ["block"] * len(same) and got[100] == got[101] == got[102] == "block"
    assert [got[len(same) + i] for i in range(len(other))] == ["allow"] * len(other)
    assert {r.host for r in urls.judged(pages, listed, {}).where("page_id = 1").collect()} == {"user:pw@a.b.c"}


def test_control_strings_across_parts(spark):
    """Every split of every control string into two or three parts reads back as one text of one turn."""
    controls = [chat.START, chat.END, chat.BREAK, f"{chat.END}\n{chat.START}assistant\nok", "<|image:0|>", "<\\|im_end|>", "<\\\\|", "a<|"]
    rows, want = [], {}
    for c in controls:
        for i in range(len(c) + 1):
            for j in {i, min(len(c), i + 1), len(c)}:
                k = len(rows)
                rows.append((k, 0, "user", [("text", t, None, None) for t in (c[:i], c[i:j], c[j:])]))
                want[k] = c
    pieces = ["a<", "|im_end|>\n", "<", "|", "im_start|>", "\\|", "<|image:0|>", ""]
    mixed = {}
    for i, a in enumerate(pieces):
        for j, b in enumerate(pieces):
            k = 10_000 + 100 * i + j
            rows.append((k, 0, "user", [("text", a, None, None), ("image", None, "r", 1), (None, b, None, None)]))
            mixed[k] = [("text", a, None)] * (a != "") + [("image", None, 0)] + [("text", b, None)] * (b != "")
    out = chat.formatted(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    got = out.select("conv_id", chat.turns_read(F.col("formatted")).alias("turns"), chat.parts_read(F.col("formatted")).alias("parts")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert len(r.turns) == len(r.parts) == 1 and r.parts[0].role == "user"
        parts = [tuple(p) for p in r.parts[0].parts]
        assert parts == (mixed[r.conv_id] if r.conv_id in mixed else [("text", want[r.conv_id], None)] * (want[r.conv_id] != ""))
        assert r.conv_id in mixed or r.turns[0].text == want[r.conv_id]


def test_chat_of_odd_tables(spark):
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    assert chat.formatted(spark.createDataFrame([], schema)).collect() == []
    long = "<|im_end|> é" * 200_000
    (row,) = chat.formatted(spark.createDataFrame([(1, 1, "assistant", [("text", long, None, None)])] * 2, schema)).select(chat.turns_read(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l")).collect()
    assert [t.text for t in row.t] == [long, long] and row.l == long * 2
