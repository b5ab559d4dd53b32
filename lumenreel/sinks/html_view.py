"""HTML view of ordered rows or chunk images."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = '<!doctype html><html><head><meta charset="utf-8"><style>body{{margin:0;background:{bg}}}img{{display:block;width:{width}px;margin:0 auto;background:{chunk_bg}}}</style></head><body>\n{body}\n</body></html>\n'


def ordered_body(rows: DataFrame, key: list[str], order: str, item: Column) -> DataFrame:
    """Per key: body, the items in order, one a line, and n.  (A view is one page, so it fits a row.)"""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("x"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(held, lambda s: s["x"]), "\n").alias("body"), F.count(F.lit(1)).alias("n"))


def page(paths: list[str], width: int = 540, bg: str = "#111", chunk_bg: str = "transparent") -> str:
    """A page that shows the chunk images of one recording below each other."""
    body = "\n".join(f'<img src="{html.escape(p, quote=True)}" alt="">' for p in sorted(paths))
    return PAGE.format(bg=bg, width=width, chunk_bg=chunk_bg, body=body)
