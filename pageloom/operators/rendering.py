"""Accessible HTML of publications: a fragment for each block, joined in order to sections and documents.

All text is escaped before it meets markup. blocks(doc_id, ord, type, level, slug, text, items, headers, rows).
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.text import html_escape, script_json
from pageloom.operators.sequential import linked_footnotes, list_tree


def tag(name: str, inner: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{name}{attributes}>"), inner, F.lit(f"</{name}>"))


def _text(value: Column) -> Column:
    return html_escape(F.coalesce(value, F.lit("")))


def heading(text: Column, level: Column, slug: Column) -> Column:
    """h2 to h6, with the slug as anchor."""
    n = F.greatest(F.lit(2), F.least(F.lit(6), level)).cast("string")
    return F.concat(F.lit("<h"), n, F.lit(' id="'), _text(slug), F.lit('">'), _text(text), F.lit("</h"), n, F.lit(">"))


def bullet_list(items: Column) -> Column:
    return tag("ul", F.array_join(F.transform(items, lambda x: tag("li", _text(x))), ""))


def grid(headers: Column, rows: Column) -> Column:
    """A table whose first row are column headers, if there are any that say something."""
    head = tag("thead", tag("tr", F.array_join(F.transform(headers, lambda h: tag("th", _text(h), ' scope="col"')), "")))
    body = tag("tbody", F.array_join(F.transform(rows, lambda r: tag("tr", F.array_join(F.transform(r, lambda c: tag("td", _text(c))), ""))), ""))
    return tag("table", F.concat(F.when(F.exists(headers, lambda h: F.trim(h) != ""), head).otherwise(""), body))


def cell_grid(rows: Column, caption: Column | None = None) -> Column:
    """A table of published cells (publication_cells): header cells with their scope, spans of more than one, and a caption if it says something."""

    def cell(c: Column) -> Column:
        heads = c["column_header"] | c["row_header"]
        name = F.when(heads, "th").otherwise("td")
        scope = F.when(c["column_header"], ' scope="col"').when(c["row_header"], ' scope="row"').otherwise("")
        span = lambda side, n: F.when(n > 1, F.concat(F.lit(f' {side}span="'), n.cast("string"), F.lit('"'))).otherwise("")
        return F.concat(F.lit("<"), name, scope, span("row", c["row_span"]), span("col", c["col_span"]), F.lit(">"), _text(c["text"]), F.lit("</"), name, F.lit(">"))

    body = F.array_join(F.transform(rows, lambda r: tag("tr", F.array_join(F.transform(r, cell), ""))), "")
    title = F.lit("") if caption is None else F.when(F.trim(F.coalesce(caption, F.lit(""))) == "", "").otherwise(tag("caption", _text(caption)))
    return tag("table", F.concat(title, body))


def nested_items(items: list[dict], ordered: bool, start: int | None, notes: dict[str, str]) -> str:
    """The markup of a list of struct(text, level, ordered, value): items that are deeper stand in the item before, runs of one kind in one list."""
    children: dict[int, list[int]] = {}
    for k, (_, parent) in enumerate(list_tree([x["level"] or 0 for x in items])):
        children.setdefault(parent, []).append(k)

    def lists(nodes: list[int], first: int | None) -> str:
        out = ""
        for kind, run in groupby(nodes, key=lambda k: bool(items[k]["ordered"] if items[k]["ordered"] is not None else ordered)):
            name = "ol" if kind else "ul"
            begins = f' start="{max(1, first)}"' if kind and first not in (None, 1) and not out else ""
            rows = "".join(f"<li{value(k) if kind else ''}>{linked_footnotes(items[k]['text'] or '', notes)}{lists(children.get(k, []), None)}</li>" for k in run)
            out += f"<{name}{begins}>{rows}</{name}>"
        return out

    def value(k: int) -> str:
        return "" if items[k]["value"] is None else f' value="{items[k]["value"]}"'

    return lists(children.get(-1, []), start)


@F.arrow_udf(T.StringType())
def nested_list(items, styles, starts, notes):
    """The markup of lists as published_lists makes them; notes maps numbers of footnotes to their ids."""
    rows = zip(items.to_pylist(), styles.to_pylist(), starts.to_pylist(), notes.to_pylist(), strict=True)
    return pa.array([nested_items(own or [], style == "ordered", start, dict(known or [])) for own, style, start, known in rows], pa.string())


def fragment(blocks: DataFrame) -> Column:
    """The markup of a block by its type; unknown types are paragraphs, and empty ones nothing."""
    kind, text = F.col("type"), F.col("text")
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    simple = {
        "caption": tag("p", _text(text), ' class="caption"'),
        "formula": tag("p", tag("code", _text(text)), ' class="formula"'),
        "footnote": F.concat(F.lit('<p class="footnote" id="'), _text(F.col("slug")), F.lit('">'), _text(text), F.lit("</p>")),
        "checkbox": tag("p", F.concat(F.lit("☐ "), _text(text))),
        "figure": tag("figure", tag("figcaption", _text(text))),
        "box_section": tag("aside", tag("p", _text(text))),
    }
    out = F.when(blank, "").otherwise(tag("p", _text(text)))
    for name, markup in simple.items():
        out = F.when(kind == name, F.when(blank & F.lit(name not in ("figure",)), "").otherwise(markup)).otherwise(out)
    return (
        F.when(kind == "heading", heading(text, F.col("level"), F.col("slug")))
        .when(kind == "list", F.when(F.size("items") > 0, bullet_list(F.col("items"))).otherwise(""))
        .when(kind == "table", grid(F.col("headers"), F.col("rows")))
        .otherwise(out)
    )


def bodies(blocks: DataFrame) -> DataFrame:
    """(doc_id, body): the fragments of each document in order."""
    parts = blocks.select("doc_id", "ord", fragment(blocks).alias("html")).where("html <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "html"))), lambda x: x["html"]), "\n")
    return parts.groupBy("doc_id").agg(joined.alias("body"))


def pages(documents: DataFrame) -> DataFrame:
    """(doc_id, html) of documents(doc_id, title, lang, body, json_ld)."""
    data = F.when(F.col("json_ld").isNotNull(), F.concat(F.lit('<script type="application/ld+json">'), script_json(F.col("json_ld")), F.lit("</script>"))).otherwise("")
    head = tag("head", F.concat(F.lit('<meta charset="utf-8">'), tag("title", _text(F.col("title"))), data))
    main = tag("main", F.concat(tag("h1", _text(F.col("title"))), F.coalesce("body", F.lit(""))))
    html = F.concat(F.lit('<!doctype html><html lang="'), _text(F.coalesce("lang", F.lit("en"))), F.lit('">'), head, tag("body", main), F.lit("</html>"))
    return documents.select("doc_id", html.alias("html"))
