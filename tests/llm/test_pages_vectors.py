"""Operators over pages and vectors against brute force and exact round trips."""

import base64
import gzip
import hashlib
import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from varnika.llm import components, embeddings, warc, wrapper

SCHEMA = "page_id long, url string, html string, page long, sha string, node long"
NAV = '<nav><a href="/">Home</a></nav>'


def page(body, extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var x='</p>';</script></head><body>{NAV}{body}{extra}</body></html>"


PAGES = [
    (1, "http://a.example/1", page("<article><header><h1>A &amp; B</h1></header><p>One\n two&nbsp;three<p>Four <b>five</b><br>six</article>")),
    (2, "http://a.example/2", page("<article><p>Same</p></article>")), (5, "http://a.example/5", page("<article><p>Same</p></article>")), (5, "http://a.example/5", page("<article><p>Same</p></article>")), (4, None, page("<article><p>Same</p></article>")),
    (6, "no url\r\nX: y", ""), (7, "http://b.example/7", None), (None, "http://b.example/8", "<p>loose &lt;b&gt; text"), (None, None, None),
    (9, "http://a.example/9", page('<div class="cookie-notice">We use</div><article><p>Kept</p><aside>no</aside><form>no<input></form><section class="comments"><p>reader</p></section></article><footer>f</footer><div class="sidebar">s</div>')),
    (10, "http://a.example/10", "<article><p>cut off <i>here &eacute;"), (11, "http://a.example/11", page("<article><p>" + "long " * 50000 + "</p></article>")), (12, "http://a.example/12", '<article title="a>b"><p>x < y</p><!-- <p>no</p> --><style>p{}</style><p hidden>no</p><p>é😀</p></article>'),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1, "x", 2) for p in PAGES], SCHEMA).repartition(3)


def test_archive_round_trip(spark, pages):
    got = warc.archive(pages).collect()
    best = {}
    for p, _, h in PAGES:
        best[h or ""] = max([x for x in (best.get(h or ""), p) if x is not None], default=None)
    want = []
    for p, _, h in PAGES:
        e, b = (h or "").encode(), best[h or ""]
        again = b is not None and p != b
        want.append((p, len(e), base64.b32encode(hashlib.sha1(e).digest()).decode(), "revisit" if again else "response", b if again else None))
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, v) for v in r])
    assert order(map(tuple, got)) == order(want)
    small = {r.page_id: r.record_type for r in warc.archive(pages, least=1000).collect()}
    assert small[2] == "response"
    assert warc.archive(spark.createDataFrame([], SCHEMA)).count() == 0


def test_normalised_archive_has_a_member_per_record(spark, pages, tmp_path):
    raw, folder = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    rows = pages.select(F.col("page_id").alias("page"), "url", "html", F.lit(None).cast("long").alias("refers_to")).coalesce(1)
    warc.normalise(warc.write(rows, raw), raw, folder)
    (mono,) = os.listdir(tmp_path / "raw")
    whole = gzip.decompress((tmp_path / "raw" / mono).read_bytes())
    (name,) = [f for f in os.listdir(tmp_path / "out") if f.endswith(".gz")]
    data = (tmp_path / "out" / name).read_bytes()
    index = [json.loads(x) for x in (tmp_path / "out" / f"{name}.idx").read_text().splitlines()]
    assert len(index) == len(PAGES) and sum(x["length"] for x in index) == len(data)
    assert b"".join(gzip.decompress(data[x["offset"] : x["offset"] + x["length"]]) for x in index) == whole
    assert list(warc.records(io.BytesIO(data), 7)) == list(warc.records(io.BytesIO(gzip.compress(whole)), 1000))


def test_main_text(spark, pages):
    got = wrapper.extract(pages).collect()
    want = {1: "A & B\n\nOne two three\n\nFour five six", 2: "Same", 4: "Same", 5: "Same", 6: "", 7: "", 9: "Kept", 10: "cut off here é", 11: " ".join(["long"] * 50000), 12: "x < y\n\né😀"}
    assert len(got) == len(PAGES)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id is not None:
            assert r.text == want[r.page_id]
    assert sorted(r.text for r in got if r.page_id is None) == ["", "loose <b> text"]
    assert wrapper.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wrapper_tells_template_from_content(spark):
    """Pages without an article: what is the same at one node of most pages goes."""
    rows = [(i, f"http://h.example/{i}", f"<body><div><div>Our great site</div><div><p>Story {i} begins</p><p>and ends {i * 7}</p></div><div>All rights</div></div></body>") for i in range(8)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i} begins\n\nand ends {i * 7}" for i in range(8)}


def test_wrapper_decides_within_articles(spark):
    """All pages have an article, and marks alone would keep lines that stand on each page of the host."""
    rows = [(i, f"http://h.example/{i}", f"<body><nav>Menu</nav><article><h1>Title {i}</h1><div>Written by our staff</div><p>Story {i}</p><div>Send us your story</div></article></body>") for i in range(6)]
    rows += [(9, "http://other.example/9", rows[0][2])]  # alone on its host, nothing tells template from content
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\n\nStory {i}" for i in range(6)} | {9: "Title 0\n\nWritten by our staff\n\nStory 0\n\nSend us your story"}


def test_the_wrapper_overrules_names(spark):
    """A host whose names mislead both ways: stories in `story share` and `widget`, and a constant line without a name; with few pages, or constant text, the name counts."""
    story = lambda host, i, extra="": (i, f"http://{host}.example/{i}", page(f'<article><h1>Head {i}</h1><div class="story share"><p>Told {i} once</p></div><p class="plain">Follow the paper</p><div class="widget"><p>Use it here</p></div>{extra}</article><div class="widget"><p>Out {i}</p></div>'))
    rows = [story("big", i) for i in range(8)] + [story("few", 20 + i) for i in range(2)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = {r.page_id: r.text for r in wrapper.extract(df).collect()}
    assert all(got[i] == f"Head {i}\n\nTold {i} once" for i in range(8))
    assert all(got[20 + i] == f"Head {20 + i}\n\nFollow the paper" for i in range(2))
    off = {r.page_id: r.text for r in wrapper.extract(df, least=10**9).collect()}
    assert all(off[i] == f"Head {i}\n\nFollow the paper" for i in range(8))  # without the wrapper, names decide


def test_every_skeleton_counts(spark):
    """A host of 240 pages without two alike: the notice that only the last 150 skeletons (in any order) hold goes too, and rare lines stay."""
    notice = lambda i: '<div class="zz">Read this first</div>' if i >= 90 else ""
    rows = [(i, f"http://h.example/{i}", f'<body><div class="c{i:03}">Intro {i % 2}</div>{notice(i)}<div class="story"><p>Story {i} begins</p></div><div class="foot">Our site</div></body>') for i in range(240)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"Intro {i % 2}\n\nStory {i} begins" for i in range(240)}


def test_restricted_skeletons_keep_their_paths():
    whole = "0:x 1:p 1:q 3:s 0:y"
    ids = wrapper.path_ids(whole)
    assert len(set(ids)) == 5 and wrapper.path_ids("0:y 0:x 2:q") == [ids[4], ids[0], ids[2]]
    assert wrapper.restricted(whole, {ids[0], ids[2], ids[3]}) == "0:x 1:q 2:s" and wrapper.restricted(whole, set()) == wrapper.restricted("", set()) == ""


def test_comments_in_articles_of_their_own(spark):
    rows = [(1, "http://h.example/1", '<article class="post share"><h1>Head</h1><p>Text</p><article class="comment"><p>reader</p></article></article>'), (2, "http://h.example/2", '<article><p>Text</p></article><section><article class="comment-item"><p>reader</p></article></section>')]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Head\n\nText", 2: "Text"}


def test_tree_matching():
    a, b = wrapper.tree("0:x 1:p 1:q 1:r"), wrapper.tree("0:x 1:q 1:z 1:r 1:p")
    assert wrapper.matched(a, b) == {0: 0, 1: 1, 3: 2, 4: 4} or len(wrapper.matched(a, b)) == 4
    assert wrapper.merged(["0:x 1:p", "0:x 1:q 2:s", "0:y"]) == "0:x 1:p 1:q 3:s 0:y"


def test_tree_matching_is_greatest():
    """Against the plain recursion, on random trees with repeated labels among siblings; and on a tree deeper than Python's stack."""

    def greatest(a, b, i=0, j=0):
        m = [[0] * (len(b[1][j]) + 1) for _ in range(len(a[1][i]) + 1)]
        for s, u in enumerate(a[1][i], 1):
            for t, v in enumerate(b[1][j], 1):
                m[s][t] = max(m[s - 1][t], m[s][t - 1], m[s - 1][t - 1] + greatest(a, b, u, v) if a[0][u] == b[0][v] else 0)
        return m[-1][-1] + 1

    rng = np.random.default_rng(3)
    grown = lambda: wrapper.tree(" ".join(f"{rng.integers(k + 1)}:{'abc'[rng.integers(3)]}" for k in range(rng.integers(12))))
    for _ in range(500):
        a, b = grown(), grown()
        pairs = wrapper.matched(a, b)
        assert len(pairs) == len(set(pairs.values())) == greatest(a, b)
        for i, j in pairs.items():
            kids = [pairs[c] for c in a[1][i] if c in pairs]
            assert a[0][i] == b[0][j] and kids == sorted(kids) and set(kids) <= set(b[1][j])
    deep, found = wrapper.blocks("<div>" * 5000 + "deep")
    assert [t for _, t, _ in found] == ["deep"] and len(wrapper.matched(wrapper.tree(deep), wrapper.tree(deep))) == 5001


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] + rng.normal(size=16) * 0.04).tolist(), i % 5 % 3) for i in range(150)]
    rows += [(300 + i, base[1].tolist(), 1) for i in range(20)] + [(1, base[1].tolist(), 1)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [float("inf")] + [1.0] * 15, 1), (404, [None] + [1.0] * 15, 1), (405, base[1].tolist(), None), (None, base[1].tolist(), 1), (406, (base[2] * 1e-200).tolist(), 2), (407, (base[2] * 1e200).tolist(), 2), (408, [1.0], 1)]
    return rows


@pytest.mark.parametrize("leaf", [1024, 48])
def test_vectors(spark, leaf):
    rows = vectors()
    got = embeddings.linked(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string"), leaf=leaf).collect()
    fine = [(i, np.array(v, float) / np.abs(v).max(), k) for i, v, k in rows if i is not None and k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    near = [(p, q) for p, (_, u, k) in enumerate(fine) for q, (_, v, m) in enumerate(fine) if p != q and k == m and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98]
    links, of = {}, {}
    for p, _ in near:
        links.setdefault(fine[p][0], []).append(p)
    component = {i: i for i, _, _ in rows}
    for p, q in near * 8:
        a, b = fine[p][0], fine[q][0]
        component[a] = component[b] = min(component[a], component[b])
    total = {}
    for r in got:
        total[r.vec_id] = total.get(r.vec_id, 0) + r.n_links
        of[r.vec_id] = r.component_id
    assert len(got) == len(rows)
    found, there = sum(total.values()), len(near)
    assert found <= there and found >= (there if leaf == 1024 else 0.95 * there)
    assert {i: c for i, c in of.items() if i is not None} == {i: c for i, c in component.items() if i is not None}


def test_hot_groups_keep_their_links(spark):
    """A third of a label in one group of near copies, among unrelated vectors; many levels of cuts."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    group = unit(unit(rng.normal(size=(1, 64))) + unit(rng.normal(size=(500, 64))) * np.sqrt(1 / 0.985 - 1))
    x = np.concatenate([group, unit(rng.normal(size=(1000, 64)))])
    got = embeddings.linked(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), leaf=48).collect()
    there = int((x @ x.T >= 0.98).sum()) - len(x)
    assert there > 10_000 and 0.999 * there <= sum(r.n_links for r in got) <= there


def test_nodes_of_the_last_round_are_compared(spark, monkeypatch):
    """Each split renames all nodes and leaves out some trees, so that all rounds run."""
    rounds = iter((10, 8, 6, 4, 3, 2))
    monkeypatch.setattr(embeddings, "_split", lambda rows, *_: rows.filter(F.col("tree") < next(rounds)).withColumn("node", F.shiftrightunsigned(F.xxhash64("node"), 1)))
    df = spark.createDataFrame([(i, [1.0, i * 1e-4], 0) for i in range(30)], "vec_id long, embedding array<double>, label int")
    got = embeddings.linked(df, leaf=8).collect()
    assert len(got) == 30 and all(r.n_links == 29 and r.component_id == 0 for r in got)


def test_leaves_that_cannot_be_split(spark):
    """Vectors that all project alike are compared in pairs of chunks."""
    rows = [(i, [1.0 + i * 1e-16 * 3, 1.0 + (i % 7) * 3e-16], 0) for i in range(40)]
    got = embeddings.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=4, trees=4).collect()
    assert all(r.n_links == 39 and r.component_id == 0 for r in got)
    assert embeddings.linked(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(30)] + [(7, 7)]
    of = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            of[a] = of[b] = min(of[a], of[b])
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loose = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: of[n] for n in loose}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
