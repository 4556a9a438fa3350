"""Text of pages as expressions: hashes, keys, tags, list items, cleaning, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode import rules

#: White space as Python has it; Java's \s knows less.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def or_null(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def content_hash(c: Column) -> Column:
    """SHA-256 of the text with each run of white space as one space, and none at the ends."""
    return F.sha2(F.trim(F.regexp_replace(c, f"{SPACE}+", " ")), 256)


def stable_key(external_id: Column, url: Column, title: Column, content: Column) -> Column:
    """The first known of id, url, title and content, as a key that names its kind; long ones are hashed."""
    short = lambda c: F.left(F.sha2(c, 256), F.lit(16))
    return F.coalesce(
        F.concat(F.lit("id:"), or_null(external_id)),
        F.concat(F.lit("url:"), or_null(url)),
        F.concat(F.lit("title:"), short(or_null(title))),
        F.concat(F.lit("content:"), short(or_null(content))),
        F.lit("unknown"),
    )


def strip_tags(c: Column, by: str = "", pattern: str = rules.TAG) -> Column:
    return strip(F.regexp_replace(c, pattern, by))


def list_items(c: Column) -> Column:
    """Texts of the <li> elements, without empty ones."""
    items = F.transform(F.regexp_extract_all(c, F.lit(rules.LIST_ITEM), F.lit(1)), lambda x: strip_tags(x))
    return F.filter(items, lambda x: x != "")


def links(c: Column) -> Column:
    """Targets of the page's links."""
    return F.regexp_extract_all(c, F.lit(rules.LINK), F.lit(1))


def clean_lines(c: Column) -> Column:
    """Text lines of a page: no scripts or styles, links as `label (target)`, other tags as line ends, no blank lines.

    A link's label may hold tags. The text is cut at the links' ends, so that each piece has one link at most, its last one: pages of
    links that never end take no longer than others."""
    pieces = F.split(F.regexp_replace(c, rules.SCRIPT_STYLE, ""), "(?i)</a>", -1)
    whole = r"(?is)^(.*)<a\s[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*)$"

    def link(x: Column) -> Column:
        label, target = strip_tags(F.regexp_extract(x, whole, 3)), F.regexp_extract(x, whole, 2)
        return F.concat(F.regexp_extract(x, whole, 1), F.when(label == "", target).otherwise(F.concat(label, F.lit(" ("), target, F.lit(")"))))

    ended = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda x: F.when(x.rlike(whole), link(x)).otherwise(F.concat(x, F.lit("</a>"))))
    parts = F.concat(ended, F.slice(pieces, -1, 1))

    text = F.regexp_replace(F.array_join(parts, ""), rules.TAG, "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x != ""), "\n")


def without_fences(c: Column) -> Column:
    """The body of a fenced answer, or the answer itself; one that begins and ends as JSON has neither fences nor white space to take off."""
    bare = (c.startswith("{") & c.endswith("}")) | (c.startswith("[") & c.endswith("]"))
    return F.when(bare, c).otherwise(_unfenced(c))


def _unfenced(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def chunk_lines(c: Column, size: int = rules.CHUNK_CHARS) -> Column:
    """Array of chunks of whole lines, of at most size characters; a longer line is a chunk by itself."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(state: Column, line: Column) -> Column:
        fits = state["open"].isNull() | (F.char_length(state["open"]) + 1 + F.char_length(line) <= size)
        return F.struct(
            F.when(fits, state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"),
            F.when(fits, F.concat_ws("\n", state["open"], line)).otherwise(line).alias("open"),
        )

    return F.aggregate(F.split(c, "\n"), start, add, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["open"])))
