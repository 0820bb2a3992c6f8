"""Frontier, corrupt records, dense tensors, the SQL function and the table function."""

import random
from urllib.parse import urldefrag, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from varnika.functions import rules, vocab
from varnika.sources import crawl, io

BASES = ["http://A.example/x/y", "https://b.example:443", "http://c.example:80/p/?q=1#f", "http://user@d.example:8080/a/../b/"]
LINKS = ["", "#top", "?z=2", "/r", "r/s", "./r", "../r", "../../../r", "//E.example/t", "https://f.example", "HTTP://G.example:80/a/./b//c#x", "mailto:x@y", "javascript:void(0)", "/a/.", "/a/..", " /sp "]


def plain(link, base):
    """By urllib, with scheme and host in lower case and without default port, user and empty segments."""
    x = urlsplit(urldefrag(urljoin(base, link.strip()))[0])
    if x.scheme not in ("http", "https") or not x.hostname:
        return None
    port = f":{x.port}" if x.port and x.port != {"http": 80, "https": 443}[x.scheme] else ""
    path, out = x.path or "/", []
    for s in path.split("/"):
        if s == "..":
            out = out[:-1]
        elif s not in ("", "."):
            out.append(s)
    folder = path.split("/")[-1] in ("", ".", "..") and out
    return f"{x.scheme}://{x.hostname}{port}/{'/'.join(out)}{'/' if folder else ''}" + (f"?{x.query}" if x.query else "")


def test_links_are_resolved_as_urllib_does(spark):
    rows = [(b, x) for b in BASES for x in LINKS]
    got = spark.createDataFrame(rows, "base string, link string").select("base", "link", crawl.resolved(F.col("link"), F.col("base")).alias("to")).collect()
    assert {(r.base, r.link): r.to for r in got} == {(b, x): plain(x, b) for b, x in rows}
    odd = spark.createDataFrame([(None,), ("",), ("no url",), ("ftp://x/y",), ("http://",)], "u string").select(crawl.normal_url(F.col("u")).alias("u")).collect()
    assert [r.u for r in odd] == [None] * 5


def test_reach_against_breadth_first_search(spark):
    r = random.Random(4)
    n = 60
    names = [f"http://{'site' if i % 4 else 'sub.site'}.example/{i}" for i in range(n)] + [f"http://foreign.example/{i}" for i in range(5)] + ["http://notsite.example/1"]
    out = {u: [r.choice(names) for _ in range(r.choice([0, 1, 1, 2]))] for u in names}
    out[names[0]] += names[1:4] + [names[n]]
    rows = [(u, "".join(f'<a href="{x}">' for x in to)) for u, to in out.items()] + [(names[1], '<a href="/59">'), (None, '<a href="/2">'), ("odd", None), (names[2] + "#again", None)]
    out[names[1]] = [*out[names[1]], "http://site.example/59"]
    allowed = lambda u: u.split("/")[2] in ("site.example", "sub.site.example")
    depth, front = {names[0]: 0}, [names[0]]
    while front:
        front = [x for u in front for x in out[u] if allowed(x) and x in out and x not in depth and not depth.update({x: depth[u] + 1})]
    df = spark.createDataFrame(rows, "url string, html string").repartition(3)
    got = {x.url: x.depth for x in crawl.reach(df, [names[0], "http://nowhere.example/"], ["site.example"]).collect()}
    assert got == depth and max(depth.values()) > 3
    every = {x.url for x in crawl.reach(df, [names[0]]).collect()}
    assert set(depth) < every and any("foreign" in u for u in every)
    assert crawl.reach(df.limit(0), [names[0]]).count() == 0 and crawl.reach(df, []).count() == 0


def test_corrupt_records_are_set_aside(spark, tmp_path):
    rows = [(1, '{"a": 1}'), (2, '{"a": 1'), (3, None), (4, '{"a": "x"}'), (5, "[1]"), (6, ""), (7, "null"), (8, '{"b": 2}')]
    df = spark.createDataFrame(rows, "id int, t string")
    good, bad = io.quarantined(df, "t", "struct<a:int>")
    assert {r.id: r.t and r.t.a for r in good.collect()} == {1: 1, 3: None, 7: None, 8: None}
    assert {(r.id, r.t, r.reason) for r in bad.collect()} == {(2, '{"a": 1', "malformed"), (4, '{"a": "x"}', "schema"), (5, "[1]", "schema"), (6, "", "malformed")}
    (tmp_path / "r.json").write_text('{"id": 1, "name": "क"}\n{"id": 2\n\n{"id": "x"}\n', encoding="utf-8")
    good, bad = io.read_json_quarantined(spark, str(tmp_path / "r.json"), "id bigint, name string")
    assert [tuple(r) for r in good.collect()] == [(1, "क")] and {(r.record, r.reason) for r in bad.collect()} == {('{"id": 2', "malformed"), ('{"id": "x"}', "schema")}


def test_dense_and_sparse_tensors(spark):
    rows = [([1, 2, 0],), ([3, 0, 0],), (None,), ([9, 1, 2],), ([],)]
    df = spark.createDataFrame(rows, "ids array<int>").withColumns({"dense": vocab.dense_one_hot(F.col("ids"), 3, 4), "vector": vocab.sparse_one_hot(F.col("ids"), 3, 4)})
    df = df.withColumns({"again": vocab.dense_of(F.col("vector")), "back": vocab.ids_of(F.col("dense"), 3, 4)}).collect()
    want = [[1.0 if 0 < k == x else 0.0 for x in (ids + [0] * 3)[:3] for k in range(4)] if ids is not None else None for (ids,) in rows]
    assert [r.dense for r in df] == want and [r.again for r in df] == want
    assert [r.back for r in df] == [[1, 2, 0], [3, 0, 0], None, [0, 1, 2], [0, 0, 0]]
    triples = vocab.one_hot(spark.createDataFrame([(1, [1, 2]), (2, [3])], "i int, ids array<int>"), "ids", "i").collect()
    assert {(r.row_id, r.t, r.idx) for r in triples} == {(1, 0, 1), (1, 1, 2), (2, 0, 3)}


def test_dense_tensors_work_their_ids_out_once_a_row(spark):
    rows = [([2, 1],), ([0, 3, 1, 2],), ([None, 2, 7],), ([],), (None,), ([-1, 3],)]
    df = spark.createDataFrame(rows, "ids array<int>").select("ids", vocab.dense_one_hot(F.reverse("ids"), 3, F.size(F.array(*map(F.lit, range(4))))).alias("dense"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("reverse(") == 1 and plan.count("lambdafunction(") == 1  # neither an expression for each float nor the ids within it
    want = [[1.0 if x is not None and 0 < k == x else 0.0 for x in (ids[::-1] + [0] * 3)[:3] for k in range(4)] if ids is not None else None for (ids,) in rows]
    assert [r.dense for r in df.collect()] == want


LETTERS = [*rules.CONSONANTS, *rules.VOWELS, *rules.SIGNS, *rules.NASALS, "१", rules.VIRAMA, rules.NUKTA_SIGN, "x", " ", "\n", "  ", "é", "$", "\\"]


def test_expression_and_sql_function_agree_with_python_on_random_texts(spark):
    r = random.Random(2)
    usual = [c for c in LETTERS if len(c) == 1]
    texts = ["".join(r.choice(usual) for _ in range(r.randrange(12))) for _ in range(1500)]
    marks = ["क", "ज", "फ", "ा", rules.VIRAMA, rules.NUKTA_SIGN, "म", "अ", " "]
    texts += ["".join(r.choice(marks) for _ in range(r.randrange(9))) for _ in range(1500)]
    rules.register(spark)
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = df.select("t", rules.transliterate(F.col("t")).alias("a"), F.expr("transliterate(t)").alias("b")).collect()
    want = {t: rules.hindi2english(t) for t in [*texts, None]}
    assert {x.t: x.a for x in got} == want and {x.t: x.b for x in got} == want
    plan = df.selectExpr("transliterate(t)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_table_function(spark):
    words = ["सूद", "क", "", "गौरव", "वफषई"]
    rules.register_k_best(spark)
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for k, changes in ((5, 2), (1, 1), (50, 3)):
        got = sorted(tuple(r) for r in spark.sql(f"select w, guess, cost, rank from {{df}}, lateral transliterations(w, {k}, {changes})", df=df).collect())
        assert got == sorted((r.w, r.guess, r.cost, r["rank"]) for r in rules.k_best(df, "w", k, changes).collect())
    assert spark.sql("select * from transliterations(cast(null as string))").count() == 0
    with pytest.raises(Exception, match="whole number"):
        spark.sql("select * from transliterations('क', 'x')").collect()
