"""Watch lists and entries scraped from saved pages, by the standard library's HTML parser."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BadPage, PrivateList

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PRIVATE = "Ta lista anime jest prywatna"


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.children)
        return " ".join(" ".join(out).split())

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack += [c for c in reversed(x.children) if isinstance(c, Node)]

    def has(self, tag: str | None = None, classes: tuple[str, ...] = (), **attrs: str) -> bool:
        own = (self.attrs.get("class") or "").split()
        return (tag is None or self.tag == tag) and all(c in own for c in classes) and all(re.search(p, self.attrs.get(k) or "") for k, p in attrs.items())

    def find(self, tag: str | None = None, classes: tuple[str, ...] = (), **attrs: str) -> list[Node]:
        return [x for x in self.walk() if x is not self and x.has(tag, classes, **attrs)]

    def first(self, tag: str | None = None, classes: tuple[str, ...] = (), **attrs: str) -> Node | None:
        return next(iter(self.find(tag, classes, **attrs)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        x = self.at
        while x is not None and x.tag != tag:
            x = x.parent
        if x is not None and x.parent is not None:
            self.at = x.parent

    def handle_data(self, data):
        if data.strip():
            self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def title_of(html: str) -> str | None:
    found = parse(html).first("title")
    return found.text() if found else None


def links_of(html: str) -> list[str]:
    return [a.attrs["href"] for a in parse(html).find("a", href=".")]


# --- site B -----------------------------------------------------------------------------------------------------------


def b_list(html: str) -> list[dict]:
    """Cards of a list page: slug, title, info text."""
    out = []
    for area in parse(html).find("div", ("user-activity",)):
        for card in area.find("div", ("categories",)):
            label = next((p for t in card.find("div", ("title",)) for p in t.find("p", ("label",))), None)
            link = label.first("a", href="^/anime/") if label else None
            if link is None:
                raise BadPage("a card has no title link")
            info = card.first("p", ("info",))
            out.append({"slug": link.attrs["href"].split("/anime/", 1)[1].strip("/"), "title": link.text(), "info": info.text() if info else ""})
    return out


def b_detail(html: str) -> dict:
    """mal link, labelled values in order, number of episode rows; a page with neither link, other title nor year is an error."""
    root = parse(html)
    mal = root.first("a", ("mal-link",), href=r"myanimelist\.net/anime/")
    cells = []
    for table in root.find("table"):
        for row in table.find("tr"):
            found = row.find("td")
            if len(found) >= 2:
                cells.append({"label": found[0].text().strip(), "value": found[1].text()})
    rows = [r for t in root.find("table", ("episodes",)) for body in t.find("tbody") for r in body.find("tr")]
    episodes = sum(row.first("a", href="/odcinek/") is not None for row in rows)
    named = {c["label"] for c in cells if c["value"].strip()}
    if mal is None and not named & {"Alternatywny tytuł", "Alternatywny tytul", "Rok produkcji"}:
        raise BadPage("the page has no metadata")
    return {"mal_url": mal.attrs["href"] if mal else None, "cells": cells, "episode_rows": episodes or None}


# --- site C -----------------------------------------------------------------------------------------------------------


def c_list(html: str) -> list[dict]:
    """Rows of a list page; a row with too few cells, or without a known id or a title link, is an error."""
    root = parse(html)
    if PRIVATE in (root.first("body") or root).text():
        raise PrivateList("anime list is private")
    out = []
    for table in root.find("table", id="^my_anime_table$"):
        for row in [r for body in table.find("tbody") for r in body.find("tr", id="^anime_list_item_")]:
            cells = row.find("td")
            if len(cells) < 7:
                raise BadPage("a list row has fewer than seven cells")
            number = re.fullmatch(r"anime_list_item_(\d+)", row.attrs["id"])
            if not number:
                raise BadPage(f"a list row's id is not known: {row.attrs['id']}")
            link = cells[2].first("a", href="^/anime/")
            if link is None or not (slug := link.attrs["href"].split("/anime/", 1)[1].strip("/")):
                raise BadPage("a list row has no title link")
            out.append({
                "id": int(number.group(1)), "title": link.text(), "slug": slug,
                "status": cells[3].text(), "score": cells[4].text(), "progress": cells[5].text(), "type": cells[6].text(),
            })
    return out


def _labels(nodes: list[Node]) -> list[dict]:
    return [{"label": a.strip(), "value": b.strip()} for x in nodes for a, sep, b in [x.text().partition(":")] if sep]


def _badge(root: Node, outer: str | None, *classes: str) -> str | None:
    scopes = root.find("div", (outer,)) if outer else [root]
    found = next((x for s in scopes for x in s.find("span" if outer else None, classes)), None)
    return found.text() if found else None


def c_detail(html: str) -> dict:
    root = parse(html)
    cells = _labels(root.find("p", ("m-0",)))
    mal = root.first("a", href=r"myanimelist\.net/anime/")
    named = {c["label"] for c in cells if c["value"]}
    if mal is None and not named & {"Japoński", "Japonski", "Start emisji", "Odcinki"}:
        raise BadPage("the page has no metadata")
    return {"mal_url": mal.attrs["href"] if mal else None, "cells": cells, "badge": _badge(root, "outlines", "btn-outline-warning")}


def c_tooltip(body: str) -> dict:
    try:
        data = json.loads(body)["data"]
    except (ValueError, KeyError, TypeError) as e:
        raise BadPage("the tooltip isn't JSON with data") from e
    root = parse(data)
    numbers = (re.search(r"\d+", icon.parent.text()) for icon in root.find("i", ("fa-play",)))
    episodes = next((int(n.group()) for n in numbers if n), None)
    named = root.first("small", ("text-trim",))
    original = next((p.strip() for p in (named.text() if named else "").split("|") if re.search("[぀-ヿ㐀-鿿豈-﫿]", p)), None)
    cells = _labels(root.find("small"))
    if original is None and episodes is None and not {c["label"] for c in cells if c["value"]} & {"Japoński", "Japonski", "Status", "Start emisji", "Odcinki"}:
        raise BadPage("the tooltip has no metadata")
    return {"episodes": episodes, "original_title": original, "cells": cells, "badge": _badge(root, None, "badge-warning")}


_SHAPES = {
    "b_list": (b_list, "slug string, title string, info string", True),
    "b_detail": (b_detail, "mal_url string, cells array<struct<label:string,value:string>>, episode_rows int", False),
    "c_list": (c_list, "id long, title string, slug string, status string, score string, progress string, type string", True),
    "c_detail": (c_detail, "mal_url string, cells array<struct<label:string,value:string>>, badge string", False),
    "c_tooltip": (c_tooltip, "episodes int, original_title string, cells array<struct<label:string,value:string>>, badge string", False),
    "title": (lambda h: {"title": title_of(h)}, "title string", False),
    "links": (lambda h: [{"href": x} for x in links_of(h)], "href string", True),
}


def scrape(pages: DataFrame, kind: str, keys: list[str], html: str = "html") -> DataFrame:
    """Rows that pages of a kind hold, with the pages' keys and, for lists, the position on the page."""
    read, schema, many = _SHAPES[kind]
    key_schema = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keys)
    fields = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", schema)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for own, body in zip(part[keys].itertuples(index=False), part[html], strict=True):
                if body is None:
                    continue
                got = read(body)
                rows += [(*own, k, *(x[f] for f in fields)) for k, x in enumerate(got if many else [got])]
            yield pd.DataFrame(rows, columns=[*keys, "pos", *fields])

    return pages.select(*keys, html).mapInPandas(run, f"{key_schema}, pos long, {schema}")


def labelled(details: DataFrame, key: str, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """The first value of each label, one column for each name."""
    cells = details.select(key, F.posexplode_outer("cells").alias("p", "c"))
    picked = [F.min_by(F.col("c.value"), F.when(F.col("c.label").isin(*labels) & (F.trim("c.value") != ""), F.col("p"))).alias(n) for n, labels in names.items()]
    return cells.groupBy(key).agg(*picked)
