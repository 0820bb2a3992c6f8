import json
import logging
import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from varnika import streaming
from varnika.functions import vocab
from varnika.operators import evaluate, neural, numbering, pairs
from varnika.plans import catalog
from varnika.sources import extract, io


def test_readers(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('hindi,english\nनान,nan\nक,"x""y"\n', encoding="utf-8")
    assert [tuple(r) for r in io.read_csv(spark, str(p), "hindi string, english string").collect()] == [("नान", None), ("क", 'x"y')]
    p = tmp_path / "b.tsv"
    p.write_text("ka\tक\n", encoding="utf-8")
    swapped = io.read_tsv(spark, str(p), "english string, hindi string")
    assert tuple(pairs.union_sources(swapped).first()) == ("क", "ka")
    p = tmp_path / "c.json"
    p.write_text("[3, 5]")
    assert [r[0] for r in io.read_ids(spark, str(p)).collect()] == [3, 5]
    p.write_text(json.dumps([{"id": 1, "hindi_name": "क", "slug": "k"}]))
    assert io.read_records(spark, str(p)).first().hindi_name == "क"
    io.write_csv(swapped, str(tmp_path / "out"))
    assert io.read_csv(spark, str(tmp_path / "out"), "english string, hindi string").first().english == "ka"


def test_clean_keeps_blank_names_and_drops_the_rest(spark):
    df = spark.createDataFrame([(" क ", " Ka "), ("क", "ka"), ("ख", "k.h"), ("ग", "g,a"), ("घ", "ghā"), (None, "x"), ("  ", "b")], "hindi string, english string")
    assert sorted(map(tuple, pairs.clean(df).collect())) == [("", "b"), ("क", "ka")]
    assert pairs.clean(pairs.clean(df)).count() == 2
    plan = pairs.clean(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_best_of_and_histogram(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.0), ("b", 0.25), (None, 0.0)], "k string, distance double")
    best = evaluate.best_of(df, "k")
    assert sorted(map(tuple, best.collect())) == [("a", 0.0), ("b", 0.25)]
    assert tuple(evaluate.exact_match(best).first()) == (2, 1, 0.5)
    assert sorted(map(tuple, evaluate.histogram(df).collect())) == [(0, 2), (25, 1), (49, 1)]


def test_predictions_are_made_once_per_distinct_input(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "w string")
    assert sorted(r.o or "" for r in evaluate.predict_distinct(df, "w", F.upper, "o").collect()) == ["", "A", "A"]


def test_players(spark):
    data = {"props": {"pageProps": {"data": {"pageData": {"content": {"matchPlayers": {"teamPlayers": [{"players": [{"player": {"id": 7, "name": "क", "longName": "कख", "indexName": "K", "gender": "M", "countryTeamId": 6, "slug": "k"}}]}]}}}}}}}
    html = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps(data)}</script>'
    df = spark.createDataFrame([(html,), ("<p>none</p>",), ('<script id="__NEXT_DATA__">{"props":{"pageProps":{}}}</script>',)], "html string")
    got = extract.players(df).collect()
    assert len(got) == 1 and (got[0].id, got[0].hindi_name, got[0].english_name, got[0].country_id) == (7, "क", "K", 6)


def test_kernel_does_not_depend_on_the_batch(spark):
    w = neural.random_weights(6, 5)
    ids = np.array([[1, 2, 0, 0], [3, 0, 0, 0], [5, 4, 3, 2]])
    together = neural.run(ids, w, 1, 2, 10)
    assert together == [neural.run(ids[k : k + 1], w, 1, 2, 10)[0] for k in range(3)]


def test_neural_udf(spark, tmp_path):
    np.savez(tmp_path / "weights.npz", **neural.random_weights(4, 5))
    spark.sparkContext.addFile(str(tmp_path / "weights.npz"))
    vi, vo = {"क": 1, "ख": 2, "ग": 3}, {"a": 1, "^": 2, "$": 3, "k": 4}
    f = neural.transliterator("weights.npz", vi, vo, 5, 6)
    got = [r[0] for r in spark.createDataFrame([("क ख",), ("क Q",), (None,)], "t string").select(f("t")).collect()]
    want = neural.spell(["क", "ख", "Q"], neural.random_weights(4, 5), vi, vo, 5, 6)
    assert got == [f"{want['क']} {want['ख']}", f"{want['क']} ", None] and want["Q"] == ""


def test_stream(spark, tmp_path):
    spark.createDataFrame([("हिंदी",)], "text string").write.parquet(str(tmp_path / "in"))
    q = streaming.transliterated(spark.readStream.schema("text string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("latin").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("latin").first().latin == "hindi"


def test_candidate_fields(spark):
    pages = [("", ), (None,), ("<section><div>cut",)]
    got = extract.candidates(spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "id long, html string"), "id").collect()
    assert [(r.id, r.party_name, r.age) for r in got] == [(0, None, []), (1, None, []), (2, None, [])]


def test_best_so_far_and_patience(spark):
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate([5.0, 4.0, 4.5, 4.0, 3.0, 3.5])], "run string, epoch int, loss double")
    got = [(r.best, r.patience) for r in evaluate.best_so_far(df, ["run"], ["epoch"], "loss").orderBy("epoch").collect()]
    assert got == [(5.0, 0), (4.0, 0), (4.0, 1), (4.0, 2), (3.0, 0), (3.0, 1)]


def plain_greedy(ids, w, start, end, steps):
    """One word by nested loops over Python numbers."""
    p = {k: v.astype(float).tolist() for k, v in w.items()}
    units = len(p["enc_r"])
    mul = lambda x, m: [sum(a * m[i][j] for i, a in enumerate(x)) for j in range(len(m[0]))]
    sig = lambda v: 1 / (1 + math.exp(-v))

    def cell(x, h, c, a, r, b):
        z = [u + v + t for u, v, t in zip(mul(x, a), mul(h, r), b, strict=True)]
        i, f, g, o = (z[k * units : (k + 1) * units] for k in range(4))
        c = [sig(f[k]) * c[k] + sig(i[k]) * math.tanh(g[k]) for k in range(units)]
        return [sig(o[k]) * math.tanh(c[k]) for k in range(units)], c

    h, c, seen, out, token = [0.0] * units, [0.0] * units, [], [], start
    for i in ids:
        h, c = cell(p["enc_embed"][i], h, c, p["enc_w"], p["enc_r"], p["enc_b"])
        seen.append(h)
    while len(out) < steps and token != end or not out:
        e = p["dec_embed"][token]
        query = [a + b for a, b in zip(mul(e, p["query_w"]), p["query_b"], strict=True)]
        weight = [math.exp(sum(a * b for a, b in zip(query, s, strict=True))) for s in seen]
        context = [sum(a * s[k] for a, s in zip(weight, seen, strict=True)) / sum(weight) for k in range(units)]
        h, c = cell(context + e, h, c, p["dec_w"], p["dec_r"], p["dec_b"])
        score = [a + b for a, b in zip(mul(h, p["out_w"]), p["out_b"], strict=True)]
        token = score.index(max(score))
        out.append(token)
    return out


def test_kernel_against_plain_loops():
    w = neural.random_weights(6, 5, 4, 3, 2)
    for ids in ([1, 2, 0, 0], [5, 4, 3, 2], [3, 0, 0, 0]):
        assert neural.run(np.array([ids]), w, 1, 2, 8)[0] == plain_greedy(ids, w, 1, 2, 8)


def test_registered_kernel(spark):
    data = "/root/testdata/sf0.001"
    got = {r.hindi: r.latin for r in catalog.neural_spell(spark, data).collect()}
    w, letters = neural.random_weights(len(catalog.VOCAB_IN) + 1, len(catalog.VOCAB_OUT) + 1, seed=7), {i: c for c, i in catalog.VOCAB_OUT.items()}
    for hindi in sorted(got)[:3]:
        want = []
        for word in hindi.split(" "):
            ids = [catalog.VOCAB_IN[c] for c in word] + [0] * (47 - len(word))
            out = plain_greedy(ids, w, catalog.VOCAB_OUT["^"], catalog.VOCAB_OUT["$"], 20)
            want.append("".join(letters.get(i, "") for i in out).strip("$"))
        assert got[hindi] == " ".join(want)


def test_weights_round_trip(tmp_path):
    w = neural.random_weights(4, 5)
    neural.save_weights(str(tmp_path / "w.npz"), w)
    back = neural.load_weights(str(tmp_path / "w.npz"))
    assert set(back) == set(w) and all((back[k] == w[k]).all() for k in w)


def test_numbers_in_many_buckets(spark):
    rows = [(f"k{i * 7919 % 1000:04}", i) for i in range(1000)] + [(None, -1)]
    df, n = numbering.numbered(spark.createDataFrame(rows, "k string, i int").repartition(5), "k", "no", 1, rows=50)
    got = [(r.k, r.no) for r in df.collect()]
    assert n == 1001 and sorted(got, key=lambda r: r[1]) == [(k, j) for j, k in enumerate([None, *sorted(k for k, _ in rows if k)], 1)]
    assert numbering.numbered(spark.createDataFrame([], "k string"), "k", "no")[0].count() == 0
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan(df) and "SinglePartition" not in plan(pairs.batches(spark.range(500), "id"))


def test_running_values_of_a_frequent_key(spark):
    """Against windows: one key has most rows, values are null at times, and no key is in one partition."""
    rows = [("hot" if i % 10 else f"k{i % 3}", i, None if i % 7 == 0 else float((i * 37) % 101)) for i in range(900)] + [(None, i, float(-i)) for i in range(5)] + [("none", i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(4)
    got = numbering.running(df, ["k"], ["i"], rows=60, total=("sum", F.col("x")), low=("min", F.col("x")), high=("max", F.col("x")), n=("count", F.col("x")))
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = df.withColumns({"total": F.sum("x").over(w), "low": F.min("x").over(w), "high": F.max("x").over(w), "n": F.count("x").over(w)})
    order = lambda d: sorted(map(str, d.select("k", "i", "x", "total", "low", "high", "n").collect()))
    assert order(got) == order(want)
    best = evaluate.best_so_far(df, ["k"], ["i"], "x", rows=60)
    plain = df.withColumn("best", F.min("x").over(w))
    since = Window.partitionBy("k", "best").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = plain.withColumn("patience", F.count("*").over(since) - 1)
    order = lambda d: sorted(map(str, d.select("k", "i", "x", "best", "patience").collect()))
    assert order(best) == order(plain)
    assert numbering.running(df.limit(0), ["k"], ["i"], n=("count", F.lit(1))).count() == 0


def test_vocabulary_is_one_shuffle_of_counts(spark):
    plan = vocab.fit_vocab(spark.range(9).selectExpr("id", "concat('ab', id) as t"), "t", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange") == 2  # the second ranks a row per character


def test_vocabulary_is_counted_without_sorting_characters(spark):
    for kind in ("long", "int"):
        plan = vocab.fit_vocab(spark.range(9).selectExpr(f"cast(id as {kind}) as id", "concat('ab', id) as t"), "t", "id")._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan.rpartition("Exchange")[2] and "SortAggregate" not in plan  # else a task holds a row for each of its characters
    big = 2**63 - 1
    rows = [(big, "xy"), (big - 1, "yx"), (-big, "pq"), (-big - 1, "qp"), (5, "..m"), (5, "n"), (None, "k")]
    for kind in ("long", "string"):
        df = spark.createDataFrame(rows, "i long, t string").selectExpr(f"cast(i as {kind}) as i", "t").filter(F.lit(kind == "long") | F.col("i").isNotNull())
        got = {r.id: (r.ch, r.n, r.docs) for r in vocab.fit_vocab(df, "t", "i").collect()}
        if kind == "long":
            assert got == dict(enumerate([("q", 2, 2), ("p", 2, 2), (".", 2, 1), ("y", 2, 2), ("x", 2, 2), ("n", 1, 1), ("m", 1, 1), ("k", 1, 1)], 1))
        else:
            assert sorted(got.values()) == sorted([("q", 2, 2), ("p", 2, 2), (".", 2, 1), ("y", 2, 2), ("x", 2, 2), ("n", 1, 1), ("m", 1, 1)])


def test_splits_and_orders_take_any_key(spark):
    df = spark.createDataFrame([(f"a{i}",) for i in range(500)], "k string")
    split = {r.k: r.is_train for r in pairs.hash_split(df, "k").collect()}
    assert 350 < sum(split.values()) < 450 and split == {r.k: r.is_train for r in pairs.hash_split(df.repartition(7), "k").collect()}
    places = [r.place for r in pairs.shuffled(df, "k").orderBy("k").collect()]
    assert sorted(places) == list(range(500)) and places != sorted(places)
    assert [r.k for r in pairs.sample_rows(df, 5).collect()] == [r.k for r in pairs.sample_rows(df.repartition(3), 5).collect()]


def test_status_and_log(spark, caplog):
    df = spark.createDataFrame([("a", "x"), ("b", ""), ("c", None), (None, None), ("", "")], "s string, p string")
    got = evaluate.with_status(df, "s", "p")
    assert [tuple(r.result) for r in got.collect()] == [("x", "ok"), ("", "failed"), ("", "failed"), ("", "null"), ("", "ok")]
    with caplog.at_level(logging.ERROR, "varnika"):
        assert evaluate.log_failures(got) == 2
    assert "2 predictions failed" in caplog.text


def test_round_trips(spark, tmp_path):
    one = io.literal(spark, [(7, "क", "ka")], "unique_id long, name_hindi string, name_english string")
    io.write_affidavits(one, str(tmp_path / "a"))
    back = io.read_affidavits(spark, str(tmp_path / "a")).first()
    assert list(back.asDict()) == io.AFFIDAVIT and (back.unique_id, back.name_hindi, back.name_english, back.age) == (7, "क", "ka", None)
    io.write_json(one, str(tmp_path / "j"))
    assert spark.read.schema("unique_id long, name_hindi string").json(str(tmp_path / "j")).first().name_hindi == "क"
    vocab.write_tokenizer(str(tmp_path / "t.json"), [("b", 2, 2, 1), ("a", 2, 1, 2)], 3)
    assert sorted(map(tuple, vocab.tokenizer_frame(spark, str(tmp_path / "t.json")).collect())) == [("a", 2, 2, 1), ("b", 1, 2, 2)]
    (tmp_path / "ids.json").write_text("[3, 5]")
    assert io.read_ids(spark, str(tmp_path / "ids.json")).agg(F.sum("match_id")).first()[0] == 8
