"""Microdata of pages: items as a tree, each row of it with its owner and the property through which it hangs there.

A page's tags are walked with a stack of open elements: an item ends where its element does, so what stands behind a nested item belongs
to the outer one again. Elements that HTML closes by themselves (void ones; list items, paragraphs, cells and the like at the next one) are
closed here, too. itemref adds the properties of other elements by their id. Only pages with an item reach Python, in Arrow batches.

Defined cases: a null page or one without items has none; a property's value is its item, else its content attribute, else what HTML
names for its element (href, src, data, value, datetime), else its text without white space at the ends; a name may have several values, in
page order (those from itemref last); an item that refers to itself isn't followed again; an end tag without its start is ignored; elements
that are never closed end with the page; scripts, styles and comments are no text."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.functions.markup import SPACE, Elements
from pagelode.functions.shipping import ship_package

#: A page's items: number, owner's number and property (null at the top), types, id, and properties in order; a property is a text or an item's number.
ITEMS = "array<struct<item:int,owner:int,via:string,types:array<string>,id:string,properties:array<struct<name:string,value:string,child:int>>>>"

#: Fixed values of HTML: which attribute is the value of a property's element.
VALUES = {
    "meta": "content", "audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src", "track": "src", "video": "src",
    "a": "href", "area": "href", "link": "href", "object": "data", "data": "value", "meter": "value", "time": "datetime",
}

#: Pages whose items are held at once, however many a batch has.
PAGES = 64


def items_of(page: str | None) -> list[dict]:
    """The items of one page as rows of ITEMS, owners before what they own."""
    p = Elements(page or "")
    scopes = [e for e in range(1, len(p.tags)) if "itemscope" in p.attributes[e]]
    ids: dict[str, int] = {}
    for e in range(1, len(p.tags)):
        if "id" in p.attributes[e]:
            ids.setdefault(p.attributes[e]["id"], e)
    owned, found = set(), {}

    def properties(scope: int) -> list[tuple[str, int]]:
        """(name, element) of an item's properties: those in it but not in an item in it, then those that it refers to."""
        out: list[tuple[str, int]] = []
        seen = {scope}
        parts = [(scope + 1, p.ends[scope])] + [(ids[r], p.ends[ids[r]]) for r in p.attributes[scope].get("itemref", "").split() if r in ids]
        for low, high in parts:
            e = low
            while e < high:
                if e in seen:  # the item itself, or what another reference has named
                    e = p.ends[e] if e == scope else e + 1
                    continue
                seen.add(e)
                out += [(name, e) for name in dict.fromkeys(p.attributes[e].get("itemprop", "").split())]
                e = p.ends[e] if "itemscope" in p.attributes[e] else e + 1
        return out

    for scope in scopes:
        found[scope] = properties(scope)
        owned |= {e for _, e in found[scope] if "itemscope" in p.attributes[e]}
    rows: list[dict] = []
    waiting: deque[tuple[int, int, tuple]] = deque()
    done: set[int] = set()

    def begin(scope: int, owner: int | None, via: str | None, above: tuple) -> int:
        a = p.attributes[scope]
        rows.append({"item": len(rows), "owner": owner, "via": via, "types": a.get("itemtype", "").split(), "id": a.get("itemid"), "properties": []})
        waiting.append((scope, len(rows) - 1, (scope, above)))
        done.add(scope)
        return len(rows) - 1

    def follow() -> None:
        while waiting:
            scope, number, above = waiting.popleft()
            for name, e in found[scope]:
                own = p.attributes[e]
                if "itemscope" in own:
                    link: tuple = above
                    while link and link[0] != e:
                        link = link[1]
                    if not link:
                        rows[number]["properties"].append({"name": name, "value": None, "child": begin(e, number, name, above)})
                    continue
                value = own.get("content", own.get(VALUES.get(p.tags[e], "")))
                rows[number]["properties"].append({"name": name, "value": p.text(e) if value is None else value.strip(SPACE), "child": None})

    # Items that nothing owns; then those that only own each other.
    for scope in [s for s in scopes if s not in owned] + [s for s in scopes if s in owned]:
        if scope not in done:
            begin(scope, None, None, ())
            follow()
    return rows


def _items(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in pages:
        for k in range(0, len(part), PAGES):
            some = part.iloc[k : k + PAGES]
            yield pd.Series([[] if page is None else items_of(page) for page in some], index=some.index, dtype=object)


def items(html: Column) -> Column:
    """The microdata items of a page; pages without any aren't sent to Python."""
    ship_package()
    has = html.rlike(r"(?i)\bitemscope\b")
    return F.coalesce(F.pandas_udf(_items, ITEMS)(F.when(has, html)), F.array().cast(ITEMS))


def item_rows(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, item, owner, via, type, name and value of each property with a text, over all pages; only pages with items leave the JVM."""
    some = pages.where(F.col(html).rlike(r"(?i)\bitemscope\b")).select(key, F.explode(items(F.col(html))).alias("i"))
    return some.select(key, "i.item", "i.owner", "i.via", F.get("i.types", F.lit(0)).alias("type"), F.explode("i.properties").alias("p")).where("p.value is not null").select(
        key, "item", "owner", "via", "type", F.col("p.name").alias("name"), F.col("p.value").alias("value")
    )


def flat(found: Column) -> Column:
    """Array of (type, properties) of items, types without their address; of equal names the first text counts."""

    def item(x: Column) -> Column:
        texts = F.filter(x["properties"], lambda p: p["value"].isNotNull())
        names = F.transform(texts, lambda p: p["name"])
        first = F.filter(texts, lambda p, i: F.array_position(names, p["name"]) == i + 1)
        properties = F.map_from_arrays(F.transform(first, lambda p: p["name"]), F.transform(first, lambda p: p["value"]))
        return F.struct(F.regexp_replace(F.coalesce(F.get(x["types"], F.lit(0)), F.lit("")), "^https?://schema\\.org/", "").alias("type"), properties.alias("properties"))

    return F.transform(found, item)
