"""Fields from landed pages: links, embedded JSON, match players, candidate records."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a scorecard page keeps its players.
PLAYER = "player struct<id:bigint,name:string,longName:string,indexName:string,gender:string,dateOfBirth:string,countryTeamId:bigint,slug:string>"


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def embedded(html: Column) -> Column:
    """The JSON of the page's data script."""
    return F.regexp_extract(html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)


def has_next(html: Column) -> Column:
    return html.rlike('rel="next"')


def players(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per player of each page that has the data; pages without it give none."""
    body = F.get_json_object(embedded(F.col(html)), "$.props.pageProps.data.pageData.content.matchPlayers.teamPlayers")
    teams = F.from_json(body, f"array<struct<players:array<struct<{PLAYER.replace(' ', ':', 1)}>>>>")
    rows = pages.select(F.explode(teams).alias("t")).select(F.explode("t.players").alias("p"))
    p = F.col("p.player")
    return rows.select(p["id"].alias("id"), p["name"].alias("hindi_name"), p["longName"].alias("hindi_long_name"), p["indexName"].alias("english_name"), p["gender"].alias("gender"), p["dateOfBirth"].alias("date_of_birth"), p["countryTeamId"].alias("country_id"), p["slug"].alias("slug"))


def recent_matches(matches: DataFrame, after_id: int = 1230000, after: str = "2021-04-08") -> DataFrame:
    """Matches of a greater id and a later date; rows whose date can't be read go."""
    return matches.filter((F.col("match_id") > after_id) & (F.try_to_timestamp(F.col("date"), F.lit("yyyy-M-d")).cast("date") > F.lit(after).cast("date")))


def landed(matches: DataFrame, pages: DataFrame) -> DataFrame:
    """Matches whose page exists (status other than 404)."""
    return matches.join(pages.filter("status <> 404").select("url"), matches["match_url"] == F.col("url"), "left_semi")


def first_field(values: Column) -> Column:
    """The first of a list, stripped; null where it is empty."""
    from varnika.functions.text import strip_ws

    return strip_ws(F.try_element_at(values, F.lit(1)))


#: Where a candidate's page keeps its rows, in the first and second section, and the row and place of each field.
CARD, FORM = 'div/div/div/div/div[@class="card-body"]/div/div', 'div/div[@class="row"]/div/div/div/div/div/form/div/div[1]/div'
SCALARS = {"party_name": (0, "div[2]"), "name_english": (2, "div[2]/div/p/b"), "name_hindi": (3, "div[2]/div/p/b"), "assembly_constituency": (4, "div[2]/div/p"), "state": (5, "div[2]/div/p")}
LISTS = {"application_uploaded": (6, "div[2]/div/p"), "current_status": (7, "div[2]/div/p")}
PERSONAL = {"fathers_or_husbands_name_english": (0, "div/p"), "fathers_or_husbands_name_hindi": (1, "div/p"), "name": (2, "div/p"), "address": (4, "div/p"), "age": (6, "div/p")}
CANDIDATE = ", ".join([*(f"{c} string" for c in SCALARS), *(f"{c} array<string>" for c in [*LISTS, *PERSONAL])])


class _Element:
    def __init__(self, tag: str, name: str = ""):
        self.tag, self.name, self.children, self.texts = tag, name, [], []


class _Page(HTMLParser):
    """A page as a tree of elements, each with its children and its own texts."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, html: str):
        super().__init__()
        self.root = _Element("")
        self.open, self.found = [self.root], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        new = _Element(tag, dict(attrs).get("class") or "")
        self.open[-1].children.append(new)
        self.found.append(new)
        if tag not in self.VOID:
            self.open.append(new)

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].texts.append(data)


STEP = re.compile(r"""(?P<tag>\w+)(?:\[(?:(?P<n>\d+)|@class="(?P<name>[^"]*)")\])?""")


def _reach(elements: list[_Element], path: str) -> list[_Element]:
    """The elements at a path of child steps: tag, tag[n] (the n-th such child) or tag[@class="..."] (the whole attribute)."""
    for step in path.split("/"):
        want = STEP.fullmatch(step)
        kids = [[c for c in e.children if c.tag == want["tag"] and want["name"] in (None, c.name)] for e in elements]
        elements = [c for k in kids for c in (k if want["n"] is None else k[int(want["n"]) - 1 : int(want["n"])])]
    return elements


def candidate_fields(html: str) -> dict:
    """The fields of a candidate's page; what it lacks is null, or an empty list."""
    sections = [e for e in _Page(html).found if e.tag == "section"][:2]
    cards = _reach(sections[:1], CARD)
    rows = _reach(cards[1:2], "div"), _reach(sections[1:2], FORM)
    texts = lambda k, row, path: [t for e in _reach(rows[k][row : row + 1], path) for t in e.texts]
    scalars = {c: next((t.strip() for t in texts(0, *at)), None) for c, at in SCALARS.items()}
    return scalars | {c: texts(0, *at) for c, at in LISTS.items()} | {c: texts(1, *at) for c, at in PERSONAL.items()}


def candidates(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """One row of candidate fields for each landed page, with its key. HTML needs a parser, so this runs in Python over Arrow batches."""

    @F.pandas_udf(CANDIDATE)
    def fields(page: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([candidate_fields(x if isinstance(x, str) else "") for x in page], columns=[c.split()[0] for c in CANDIDATE.split(", ")])

    return pages.select(key, fields(html).alias("_c")).select(key, "_c.*")
