"""Raw web pages to records: title, text, tables and panels."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

_DROPPED = ("script", "style", "nav", "footer", "header", "noscript")


def html_to_page_record(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Add title (of the page, else its address) and content (of main, article or body, without menus and scripts)."""
    bare = F.col(html)
    for tag in _DROPPED:
        bare = F.regexp_replace(bare, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    part = lambda tag: F.regexp_extract(bare, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    body = F.when(part("main") != "", part("main")).when(part("article") != "", part("article")).when(part("body") != "", part("body")).otherwise(bare)
    text = F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    title = collapse(_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)))
    return pages.withColumn("title", F.when(title == "", F.col(url)).otherwise(title)).withColumn("content", collapse(_entities(text)))


# Entities that pages use.
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def _entities(text):
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


class _Tables(HTMLParser):
    """Tables outside and inside panels, and the panels with their titles and texts."""

    def __init__(self):
        super().__init__()
        self.tables: list[dict] = []
        self.panels: list[dict] = []
        self.open: list[dict] = []
        self.panel_depth: list[int] = []
        self.depth = 0
        self.cell: list[str] | None = None
        self.in_head = False
        self.heading: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        names = (dict(attrs).get("class") or "").split()
        if tag == "div":
            self.depth += 1
            if "panel" in names:
                self.panels.append({"title": "", "text": [], "tables": []})
                self.panel_depth.append(self.depth)
        if self.panel_depth and (tag in ("h1", "h2", "h3", "h4", "h5", "h6") or {"panel-heading", "panel-title"} & set(names)) and not self.panels[-1]["title"]:
            self.heading = []
        if tag == "table":
            self.open.append({"head": [], "rows": [], "heads": 0})
        elif self.open and tag == "thead":
            self.in_head = True
        elif self.open and tag == "tr":
            self.open[-1]["rows"].append((self.in_head, []))
        elif self.open and tag in ("td", "th") and self.open[-1]["rows"]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.open[-1]["rows"][-1][1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "thead":
            self.in_head = False
        elif tag == "table" and self.open:
            made = self.open.pop()
            head = [c for is_head, row in made["rows"] if is_head for c in row]
            rows = [row for is_head, row in made["rows"] if not is_head]
            if not head and rows:
                head, rows = rows[0], rows[1:]
            table = {"headers": head, "rows": [r for r in rows if r]}
            self.tables.append(table)
            if self.panel_depth:
                self.panels[-1]["tables"].append(table)
        elif tag == "div":
            if self.panel_depth and self.panel_depth[-1] == self.depth:
                self.panel_depth.pop()
            self.depth -= 1
        if self.heading is not None and tag in ("h1", "h2", "h3", "h4", "h5", "h6", "div", "a", "span"):
            self.panels[-1]["title"] = " ".join("".join(self.heading).split())
            self.heading = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)
        if self.heading is not None:
            self.heading.append(data)
        elif self.panel_depth and not self.open:
            self.panels[-1]["text"].append(data)


def extract_html_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, kind, idx, row_idx, title, cells, headers): a row for each data row of each table, and one for each panel.

    Headers are the cells of the head's rows, else of the first row, which is then no data row.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                parser = _Tables()
                parser.feed(text or "")
                parser.close()
                found = [("table", n, r, None, cells, t["headers"]) for n, t in enumerate(parser.tables) for r, cells in enumerate(t["rows"])]
                found += [("panel", n, 0, p["title"], [" ".join("".join(p["text"]).split())], []) for n, p in enumerate(parser.panels)]
                rows += found
                at += [i] * len(found)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["k", "kind", "idx", "row_idx", "title", "cells", "headers"])

    schema = f"k {kind}, kind string, idx int, row_idx int, title string, cells array<string>, headers array<string>"
    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInArrow(run, schema).withColumnRenamed("k", key)
