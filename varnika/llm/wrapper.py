"""Main text of pages by wrapper induction.

A page's block elements form a skeleton tree, in which siblings of one label are one node (a list). The skeletons of a host are
aligned by simple tree matching (the greatest number of node pairs that keeps parents and order) and merged into its
wrapper, in rounds of bounded groups, so that all of them count and none meets too many others; each page is aligned to it in the same way.
Nodes that too few pages have can't be template, whatever their text, and are left out of the wrapper, which keeps it small. Over all pages of the host, a wrapper node whose text is the same
on most pages is template; the slots whose text varies are content. Marks only narrow this: elements that say what they are (nav, footer,
class "ad", ...) are never content, and a page with an article (or else main) has none outside it. Within an article, too, the wrapper decides: it
takes out what is constant there, whatever its name, and keeps what varies under a name that content has as well ("share", "widget", ...).
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, keep, tidy

#: About so many skeletons of a host are merged at once; what comes of these is merged in the next round.
FAN = 50
#: A text is template if this share of a host's distinct pages, and at least so many, have it at the same node.
SHARE, PAGES = 0.5, 3

BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe noframes noembed xmp svg math select button object video audio canvas".split())
NEVER = RAW | set("nav footer aside form menu dialog head search".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adbox|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-bar|related|recommended|social|comments?|commentlist|disqus|respond|replies|footer|masthead|site-header|page-header|topbar|toolbar|pagination|pager|skip-link|copyright)(?:$|[\s_-])", re.I)
#: Names that furniture and content share. Outside articles they count like those above; within one, the wrapper overrules them where it can.
WEAK = re.compile(r"(?:^|[\s_-])(?:share|sharing|search|widgets?|alert|hidden)(?:$|[\s_-])", re.I)
#: The zone of a block in an article under an element named so.
DOUBT = -2
#: Articles named so are readers' comments; any other outermost article is one, whatever its name.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply)(?:$|[\s_-])", re.I)
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(text)}


def blocks(page: str) -> tuple[str, list[tuple[int, str, int]]]:
    """The skeleton (parent:label of each node, in order of first sight) and the text blocks that may be content.

    A block is (node, text, zone): zone 2 in an article, 1 in main, 0 elsewhere, DOUBT in an article under a weak name. Within a block, white space is one space.
    """
    nodes: list[tuple[int, str]] = [(-1, "")]
    known: dict[tuple[int, str], int] = {}
    found: list[tuple[int, str, int]] = []
    stack: list[tuple[str, int, bool, int, bool]] = [("", 0, False, 0, False)]  # tag, node, never content, zone, doubt
    held: list[str] = []
    inside: list[int] = []  # places of the open paragraphs in the stack

    def flush() -> None:
        if held:
            if not stack[-1][2] and (text := " ".join(entities.unescape("".join(held)).split())):
                found.append((stack[-1][1], text, DOUBT if stack[-1][4] else stack[-1][3]))
            held.clear()

    def close(k: int) -> None:
        if any(x[0] in BLOCK or x[2] or x[4] for x in stack[k:]):
            flush()
        del stack[k:]
        while inside and inside[-1] >= k:
            inside.pop()

    at = 0
    while m := TOKEN.search(page, at):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in ("br", "td", "th"):
            held.append(" ")
        if tag in BLOCK:
            if inside and tag not in ("option",) and not any(x[0] in ("table", "figure") for x in stack[inside[-1] + 1 :]):
                close(inside[-1])
            flush()
        if tag in CLOSES and stack[-1][0] in CLOSES[tag]:
            close(len(stack) - 1)
        text = m[3] if m[3] is not None else m[6] or ""
        attr = _attributes(text) if "=" in text or "hidden" in text else {}
        _, node, never, zone, doubt = stack[-1]
        label = tag
        if attr:
            names = f"{attr.get('class', '')} {attr.get('id', '')}"
            label += "." + attr["class"].split()[0] if attr.get("class", "").strip() else ""
            exempt = tag in ("main", "body", "html") or tag == "article" and zone < 2 and not READERS.search(names)
            weak = bool(WEAK.search(names)) and not exempt
            doubt = doubt or weak and zone == 2
            never = never or bool(NAMES.search(names)) and not exempt or weak and zone < 2 or attr.get("role", "").lower() in ROLES or "hidden" in attr or attr.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attr.get("style", "")))
            if attr.get("role", "").lower() == "main":
                zone = max(zone, 1)
        never = never or tag in NEVER or tag == "header" and zone == 0
        zone = 2 if tag == "article" else max(zone, 1) if tag == "main" else zone
        if tag in RAW:
            flush() if tag in BLOCK else None
            if not text.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style", "textarea", "title") else at
                if not end and tag not in ("script", "style", "textarea", "title"):
                    continue
            continue
        if tag in VOID:
            continue
        if tag in BLOCK or never and not stack[-1][2] or doubt and not stack[-1][4]:
            flush()
        if tag in BLOCK:
            here = known.get((node, label))
            if here is None:
                here = known[node, label] = len(nodes)
                nodes.append((node, label))
            node = here
        inside += [len(stack)] * (tag == "p")
        stack.append((tag, node, never, zone, doubt))
    held.append(page[at:])
    flush()
    return " ".join(f"{p}:{re.sub(r'[^!-~]', '_', label)}" for p, label in nodes[1:]), found


def tree(skeleton: str) -> tuple[list[str], list[list[int]]]:
    """Labels and children of a skeleton; node 0 is the root."""
    labels, children = [""], [[]]
    for x in skeleton.split():
        p, label = x.split(":", 1)
        children[int(p)].append(len(labels))
        labels.append(label)
        children.append([])
    return labels, children


def matched(a: tuple, b: tuple) -> dict[int, int]:
    """Simple tree matching: the nodes of a that a greatest matching pairs with nodes of b.

    Only nodes of one path of labels can pair, and siblings rarely share a label. So the pairs that may match are listed from the root
    down, and from the leaves up each takes the heaviest chain, rising in both sibling orders, of the pairs below it. No recursion: a page may
    be nested deeper than Python's stack.
    """
    (la, ca), (lb, cb) = a, b
    met, below, at = [(0, 0)], {}, 0
    while at < len(met):
        i, j = met[at]
        places: dict[str, list[int]] = {}
        for t, v in enumerate(cb[j], 1):
            places.setdefault(lb[v], []).append(t)
        below[i, j] = [(u, t) for u in ca[i] for t in reversed(places.get(la[u], ()))]
        met += [(u, cb[j][t - 1]) for u, t in below[i, j]]
        at += 1
    weight: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, j in reversed(met):
        size, links = len(cb[j]), []
        best = [(0, -1)] * (size + 1)  # a Fenwick tree: the heaviest chain (weight, last link) up to a place
        for k, (u, t) in enumerate(below[i, j]):
            held, last, p = 0, -1, t - 1
            while p > 0:
                held, last = max((held, last), best[p])
                p &= p - 1
            links.append(last)
            held, p = held + weight[u, cb[j][t - 1]], t
            while p <= size:
                best[p] = max(best[p], (held, k))
                p += p & -p
        held, last, p = 0, -1, size
        while p > 0:
            held, last = max((held, last), best[p])
            p &= p - 1
        weight[i, j], chain = held + 1, []
        while last >= 0:
            u, t = below[i, j][last]
            chain.append((u, cb[j][t - 1]))
            last = links[last]
        chosen[i, j] = chain
    pairs, todo = {0: 0}, [(0, 0)]
    while todo:
        for u, v in chosen[todo.pop()]:
            pairs[u] = v
            todo.append((u, v))
    return pairs


def merged(skeletons: list[str]) -> str:
    """The wrapper of skeletons: the first, with the unmatched nodes of each other added after their siblings."""
    wrapper = skeletons[0]
    for s in skeletons[1:]:
        labels, children = tree(s)
        pairs = matched((labels, children), tree(wrapper))
        n, more, todo = len(wrapper.split()) + 1, [], [0]
        while todo:
            i = todo.pop()
            for c in children[i]:
                if c not in pairs:
                    pairs[c] = n
                    more.append(f"{pairs[i]}:{labels[c]}")
                    n += 1
                todo.append(c)
        wrapper = " ".join([wrapper, *more]).strip()
    return wrapper


def _parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [blocks(x if isinstance(x, str) else "") for x in b["html"]]
            yield pd.DataFrame({"key": b["key"], "url": b["url"], "host": b["host"], "copy": b["copy"], "skeleton": [s for s, _ in out], "at": [[x[0] for x in f] for _, f in out], "text": [[x[1] for x in f] for _, f in out], "zone": [max([x[2] for x in f if x[2] != DOUBT], default=2 if f else 0) for _, f in out], "zones": [[x[2] for x in f] for _, f in out]})

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), F.xxhash64(html).alias("copy"), F.col(html).alias("html"))
    kind = dict(pages.dtypes)
    with arrow_batches(pages.sparkSession, 256):
        return keep(rows.mapInPandas(run, f"key {kind[key]}, url {kind[url]}, host string, copy long, skeleton string, at array<int>, text array<string>, zone int, zones array<int>"), "parsed")


def path_ids(skeleton: str) -> list[int]:
    """An id of each node's path of labels, for nodes from 1 on. No two nodes of a page's skeleton share a path."""
    ids = [0]
    for x in skeleton.split():
        p, label = x.split(":", 1)
        ids.append(int.from_bytes(hashlib.blake2b(f"{ids[int(p)]}:{label}".encode(), digest_size=8).digest(), "little", signed=True))
    return ids[1:]


def restricted(skeleton: str, paths: set[int]) -> str:
    """The skeleton's nodes with these paths (which hold the paths of their parents)."""
    new, out = {0: 0}, []
    for i, (x, path) in enumerate(zip(skeleton.split(), path_ids(skeleton), strict=True), 1):
        p, label = x.split(":", 1)
        if path in paths:
            out.append(f"{new[int(p)]}:{label}")
            new[i] = len(out)
    return " ".join(out)


def wrappers(kinds: DataFrame, sizes: DataFrame, share: float, least: int, fan: int = FAN) -> DataFrame:
    """(host, wrapper) of each host with a node that may be template, from all its skeletons.

    kinds: (host, skeleton, n), the distinct pages of each skeleton; sizes: (_host, pages). A host's wrapper starts from paths that at least `share`
    of its pages have, so there are at most 1 / share times as many as nodes in a page.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [path_ids(s) for s in b["skeleton"]]
            k = [len(x) for x in ids]
            yield pd.DataFrame({"host": b["host"].to_numpy().repeat(k), "path": np.array([i for x in ids for i in x], np.int64), "n": b["n"].to_numpy().repeat(k)})

    often = kinds.mapInPandas(each, "host string, path long, n long").groupBy("host", "path").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    often = often.join(sizes, F.col("host") == F.col("_host")).filter(F.col("n") >= share * F.col("pages"))
    often = keep(often.groupBy(F.col("host").alias("_h")).agg(F.collect_list("path").alias("paths")), "often")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"host": b["host"], "skeleton": [restricted(s, set(p)) for s, p in zip(b["skeleton"], b["paths"], strict=True)], "n": b["n"]})

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["n", "skeleton"], ascending=[False, True])
        return pd.DataFrame({"host": x["host"].iloc[:1], "skeleton": [merged(list(x["skeleton"]))], "n": [x["n"].sum()]})

    some = kinds.join(often, F.col("host") == F.col("_h")).mapInPandas(cut, "host string, skeleton string, n long")
    level = keep(some.groupBy("host", "skeleton").agg(F.sum("n").alias("n")), "level")
    while True:
        counts = keep(level.groupBy(F.col("host").alias("_h")).agg(F.ceil(F.count("*") / fan).cast("int").alias("q"), F.count("*").alias("k")), "counts")
        if (counts.agg(F.max("k")).first()[0] or 0) <= 1:
            return level.select("host", F.col("skeleton").alias("wrapper"))
        dealt = level.join(counts, F.col("host") == F.col("_h")).withColumn("bucket", F.pmod(F.xxhash64("skeleton"), F.col("q")))
        parts = dealt.groupBy("host", "bucket").applyInPandas(merge, "host string, skeleton string, n long")
        level = keep(parts.groupBy("host", "skeleton").agg(F.sum("n").alias("n")), "level")


@tidy
def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", share: float = SHARE, least: int = PAGES) -> DataFrame:
    """key, url, text and n_chars for every page.

    Blocks stand in page order with a blank line between. Null or empty html gives an empty text; a null or odd url is of the host "";
    repeated rows each give their text and count once as a page of the host; very long pages are read whole; an empty table gives an empty result. A block in an article under a weak name is
    content if its node, on at least `share` of the host's pages and so many as `least`, has no text on `share` of those; without such evidence the name counts.
    """
    parsed = _parsed(pages, key, url, html)
    some = parsed.filter("size(at) > 0")
    sizes = keep(some.select("host", "copy").distinct().groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("pages")), "sizes")
    kinds = keep(some.select("host", "copy", "skeleton").distinct().groupBy("host", "skeleton").agg(F.count("*").alias("n")), "kinds")
    made = keep(wrappers(kinds, sizes, share, least), "wrappers")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            slots = []
            for s, w in zip(b["skeleton"], b["wrapper"], strict=True):
                pairs = matched(tree(s), tree(w))
                slots.append([pairs.get(i, -1) for i in range(len(s.split()) + 1)])
            yield pd.DataFrame({"_host": b["host"], "_skeleton": b["skeleton"], "slots": slots})

    aligned = keep(kinds.join(made, "host").select("host", "skeleton", "wrapper").mapInPandas(align, "_host string, _skeleton string, slots array<int>"), "aligned")
    # keep() tells Catalyst the bytes of both tables, so it broadcasts them only where they are small
    parsed = parsed.join(aligned, (F.col("host") == F.col("_host")) & (F.col("skeleton") == F.col("_skeleton")), "left").drop("_host", "_skeleton")
    parsed = parsed.withColumn("slot", F.transform("at", lambda i: F.get("slots", i)))
    each = parsed.filter("size(at) > 0").select("host", "copy", F.explode(F.arrays_zip("slot", F.transform("text", lambda t: F.xxhash64(t)).alias("h"), F.transform("zones", lambda z: z == DOUBT).alias("doubt"))).alias("x"))
    each = each.select("host", "copy", F.col("x.slot").alias("slot"), F.col("x.h").alias("h"), F.col("x.doubt").alias("doubt")).filter("slot >= 0").distinct()
    # nodes under a weak name: of how many pages, and on how many of these is their most frequent text
    doubted = each.filter("doubt").groupBy("host", "slot", "h").agg(F.count("*").alias("n")).groupBy("host", "slot").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    varied = doubted.filter((F.col("n") >= least) & (F.col("most") < share * F.col("n"))).join(sizes, F.col("host") == F.col("_host")).filter(F.col("n") >= share * F.col("pages"))
    varied = keep(varied.groupBy(F.col("host").alias("_host")).agg(F.collect_set("slot").alias("varied")), "varied")
    same = each.groupBy("host", "slot", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    same = same.join(sizes, F.col("host") == F.col("_host")).filter(F.col("n") >= share * F.col("pages"))
    template = keep(same.groupBy(F.col("host").alias("_host")).agg(F.collect_set(F.struct("slot", "h")).alias("template")), "template")
    parsed = parsed.join(template, F.col("host") == F.col("_host"), "left").drop("_host").join(varied, F.col("host") == F.col("_host"), "left")
    rows = F.arrays_zip("slot", "text", "zones")
    constant = lambda x: F.coalesce(F.array_contains(F.col("template"), F.struct(x["slot"].alias("slot"), F.xxhash64(x["text"]).alias("h"))), F.lit(False))
    settled = lambda x: (x["zones"] == DOUBT) & (F.col("zone") == 2) & F.coalesce(F.array_contains("varied", x["slot"]), F.lit(False))
    chosen = F.filter(rows, lambda x: ((x["zones"] == F.col("zone")) | settled(x)) & ~constant(x))
    text = F.array_join(F.transform(chosen, lambda x: x["text"]), "\n\n")
    return parsed.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
