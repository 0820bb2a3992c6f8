"""A crawl's frontier over landed pages: which of them a crawler reaches from its seeds, and after how many links."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varnika.operators.durable import keep, tidy

from .extract import links

URL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?"


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, k), F.lit(""))


def _plain_path(path: Column) -> Column:
    """The path without . and .. segments; it begins with a slash."""
    last = F.element_at(F.split(path, "/"), -1)
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    up = lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s)))
    joined = F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/"))
    return F.when(last.isin("", ".", "..") & (joined != "/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def normal_url(url: Column) -> Column:
    """An http or https address with scheme and host in lower case, no default port, no . and .. in its path and no fragment; null for anything else."""
    scheme, host = F.lower(_part(url, 1)), F.lower(F.regexp_replace(_part(url, 2), "^.*@", ""))
    bare = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    made = F.concat(scheme, F.lit("://"), bare, _plain_path(_part(url, 3)), _part(url, 4))
    return F.when(scheme.isin("http", "https") & (host != ""), made)


def resolved(link: Column, base: Column) -> Column:
    """The normal address that a link on a page means; null for other schemes. base: the page's own address."""
    link = F.regexp_replace(F.trim(link), "#.*$", "")
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    path = F.when(_part(base, 3) == "", "/").otherwise(_part(base, 3))
    whole = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(_part(base, 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link == "", F.concat(origin, path, _part(base, 4)))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .otherwise(F.concat(origin, F.regexp_replace(path, "[^/]*$", ""), link))
    )
    return normal_url(whole)


def in_domains(url: Column, domains: list[str]) -> Column:
    """Whether an address's host is one of these domains or below one."""
    host = F.regexp_replace(_part(url, 2), ":[0-9]+$", "")
    return reduce(lambda a, b: a | b, [(host == d.lower()) | host.endswith("." + d.lower()) for d in domains], F.lit(False))


@tidy
def reach(pages: DataFrame, seeds: list[str], domains: list[str] | None = None, url: str = "url", html: str = "html", found: Callable[[Column], Column] = links) -> DataFrame:
    """(url, depth) of each landed page that a crawl from the seeds comes to: normal address, and the least number of links to it.

    A round takes the links of the pages that the round before found, keeps those that landed, lie in `domains` (default: anywhere) and were not
    seen, and ends the crawl when there is none; so rounds are bounded by the depth of the pages, and each page is taken once, circles or not. Pages of
    equal normal address are one page, with the links of all. Null or odd addresses and null html give nothing. Each round is a durable table.
    """
    allowed = lambda c: F.lit(True) if domains is None else in_domains(c, domains)
    rows = pages.select(normal_url(F.col(url)).alias("url"), F.col(url).alias("_base"), F.col(html).alias("_html")).filter(F.col("url").isNotNull() & allowed(F.col("url")))
    there = keep(rows.select("url").distinct())
    edges = rows.select(F.col("url").alias("src"), F.explode(found(F.col("_html"))).alias("_link"), "_base").select("src", resolved(F.col("_link"), F.col("_base")).alias("dst"))
    edges = keep(edges.filter("dst is not null and dst <> src").distinct().join(there, F.col("dst") == F.col("url"), "left_semi"))
    wanted = pages.sparkSession.createDataFrame([(s,) for s in seeds], "seed string").select(normal_url(F.col("seed")).alias("_seed"))
    front = keep(there.join(wanted, F.col("url") == F.col("_seed"), "left_semi").select("url", F.lit(0).alias("depth")))
    rounds = [front]
    while not front.isEmpty():
        seen = reduce(DataFrame.union, rounds).select(F.col("url").alias("_seen"))
        near = front.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        front = keep(near.join(seen, F.col("url") == F.col("_seen"), "left_anti").select("url", F.lit(len(rounds)).alias("depth")))
        rounds.append(front)
    return reduce(DataFrame.union, rounds)
