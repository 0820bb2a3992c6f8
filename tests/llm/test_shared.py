"""State that operators share: tables of threads, Arrow settings; languages whose rows repeat; recall of the forest at its constants."""

import threading

import numpy as np

from varnika.llm import common, embeddings, langid, quality, secrets


def test_two_threads_keep_their_tables_apart(spark):
    ready, out, faults = threading.Barrier(2), {}, []

    def work(name):
        try:
            with common.tables_made() as made:
                ready.wait()
                paths = [common.table_path(spark, name) for _ in range(20)]
                ready.wait()
            out[name] = (made, paths)
        except Exception as e:  # noqa: BLE001
            faults.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in ("one", "two")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not faults and all(made == paths for made, paths in out.values())


def test_two_operators_in_two_threads(spark):
    rows = [(i, f"text {i % 9} " + "word another third more " * 6 + f"password=abcdefgh{i}xyz", "en", f"s{i % 2}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    jobs = {"secrets": lambda: secrets.digest(secrets.scan(df, carry=["doc_id"])), "quality": lambda: quality.quality_rules(df, carry=["doc_id"])}
    want = {k: sorted(map(str, f().collect())) for k, f in jobs.items()}
    got, faults = {k: [] for k in jobs}, []

    def work(k):
        try:
            for _ in range(2):
                got[k].append(sorted(map(str, jobs[k]().collect())))
        except Exception as e:  # noqa: BLE001
            faults.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in jobs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not faults and all(x == want[k] for k, found in got.items() for x in found)


def test_arrow_settings_of_two_that_overlap(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    one, two = common.arrow_batches(spark, 500), common.arrow_batches(spark, 300, "64k")
    one.__enter__()
    two.__enter__()
    assert spark.conf.get(name) == "300" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(64 << 10)
    one.__exit__(None, None, None)
    assert spark.conf.get(name) == "300"
    two.__exit__(None, None, None)
    assert spark.conf.get(name) == before


def test_a_language_whose_rows_repeat_is_learned(spark):
    en = [(i, f"the house number {i} is on the hill and the road goes down", "en") for i in range(40)]
    fr = [(1000 + i, f"la maison numéro {i} est sur la colline où la route descend", "fr") for i in range(6) for _ in range(3000)]
    df = spark.createDataFrame(en + fr, "doc_id long, text string, lang string").repartition(4)
    windows = langid.sample(df, "text", "lang", "doc_id")
    count = {lang: sum(x == lang for x, _ in windows) for lang in ("en", "fr")}
    assert count["en"] >= 10 and 1 <= count["fr"] <= 6 * langid.WINDOWS
    pred = {r.lang_pred for r in langid.identify(df.filter("doc_id in (1000, 1001, 1002, 1003)")).collect()} | {r.lang_pred for r in langid.identify(df).filter("doc_id >= 1000").collect()}
    assert pred == {"fr"}


def test_the_forest_splits_and_finds_planted_pairs(spark):
    """At the constants in use: 2,000 random vectors of one label, with pairs of cosines 0.98 to 0.985."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 1000, 2):
        side = rng.standard_normal(32)
        side -= side @ x[i] * x[i]
        cos = rng.uniform(0.98, 0.985)
        x[i + 1] = cos * x[i] + np.sqrt(1 - cos * cos) * side / np.linalg.norm(side)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    near = x @ x.T >= 0.98
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in embeddings.linked(df).collect()}
    assert all(got[i] <= near[i].sum() for i in got)  # no link that isn't there
    assert sum(got.values()) >= 0.95 * near.sum() > 900
    state = df.selectExpr("0 as tree", "1L as node", "vec_id as cid", "1L as cnt", "embedding as vec")
    sizes = state.groupBy("tree", "node").count().withColumnRenamed("count", "n")
    parts = embeddings._split(state, sizes, embeddings.LEAF, embeddings.REACH * 0.2).groupBy("node").count().collect()
    assert len(parts) > 2000 / embeddings.LEAF and max(r[1] for r in parts) < 2000 / 4
