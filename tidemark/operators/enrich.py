"""Enriching items from pages: which items, by which part of a page, and the best of several texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import strip_html_bodies, text_quality

# Parts of a page to look at first, what to wait for, seconds of delay; by host, the first that it holds.
HINTS = [
    (("github.com",), ["article.markdown-body", ".markdown-body", "#readme", "turbo-frame#readme", "article", "main"], ".markdown-body, article.markdown-body, #readme", 0.5),
    (("arxiv.org",), ["blockquote.abstract", ".abstract", "article", "main"], "blockquote.abstract, .abstract, main", 0.2),
    (("medium.com", "towardsdatascience.com"), ["article", "section", "main"], "article", 0.8),
    (("substack.com",), [".post-content", "article", "main"], ".post-content, article", 0.7),
]
OTHER = (["main article", "article", "main", '[role="main"]', "#content", ".post-content", ".article-content", ".entry-content", ".markdown-body"], None, 0.0)
# Short text and heat from which items are enriched, and how many; the same for summaries.
SHORT, HOT, MOST = 100, 50, 10
SUMMARY_SHORT, SUMMARY_HOT, SUMMARY_MOST = 150, 40, 5


def crawl_hints(url: Column) -> Column:
    """selectors, wait_for and delay for a page, by its host."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    made = lambda selectors, wait, delay: F.struct(F.array(*map(F.lit, selectors)).alias("selectors"), F.lit(wait).cast("string").alias("wait_for"), F.lit(delay).alias("delay"))
    out = None
    for hosts, *hint in HINTS:
        held = host.contains(hosts[0])
        for h in hosts[1:]:
            held = held | host.contains(h)
        out = F.when(held, made(*hint)) if out is None else out.when(held, made(*hint))
    return out.otherwise(made(*OTHER))


def content(markdown: Column, text: Column, html: Column, most: int = 500) -> Column:
    """The first that holds anything of markdown, text and stripped html, trimmed; cut with an ellipsis where it is longer than `most`."""
    space = F.lit(" \n\t\r")
    some = F.trim(F.coalesce(F.nullif(markdown, F.lit("")), F.nullif(text, F.lit("")), strip_html_bodies(F.coalesce(html, F.lit(""))), F.lit("")), space)
    return F.when(F.length(some) > most, F.concat(F.substring(some, 1, most), F.lit("…"))).otherwise(some)


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Of rows (id, label, text): each id's label, text and score of the text with the best quality, the longer of equals, then by label; blank ones are left out."""
    scored = candidates.where(F.length(F.trim("text", F.lit(" \n\t\r"))) > 0).withColumn("score", text_quality(F.col("text")))
    best = F.min_by(F.struct("label", "text", "score"), F.struct(-F.col("score"), -F.length("text"), F.col("label")))
    return scored.groupBy("id").agg(best.alias("b")).select("id", "b.*")


def _first(items: DataFrame, wanted: Column, most: int) -> DataFrame:
    return items.where(wanted).orderBy(F.desc("heat"), F.desc("event_date"), "id").limit(most)


def to_enhance(items: DataFrame, most: int = MOST) -> DataFrame:
    """The first items of the feed whose text is short or whose heat is high."""
    return _first(items, (F.length(F.coalesce("desc", F.lit(""))) < SHORT) | (F.coalesce("heat", F.lit(0)) > HOT), most)


def to_summarise(items: DataFrame, most: int = SUMMARY_MOST) -> DataFrame:
    """The first papers, hot items and items with short text of the feed."""
    return _first(items, (F.coalesce("type", F.lit("")) == "paper") | (F.coalesce("heat", F.lit(0)) > SUMMARY_HOT) | (F.length(F.coalesce("desc", F.lit(""))) < SUMMARY_SHORT), most)


def enhanced(items: DataFrame, found: DataFrame) -> DataFrame:
    """Items with what was found for them (id, text, more_tags): a longer text replaces desc, tags are put together."""
    joined = items.join(found.select("id", F.col("text").alias("_text"), F.col("more_tags").alias("_tags")), "id", "left")
    longer = F.coalesce(F.length("_text") > F.length(F.coalesce("desc", F.lit(""))), F.lit(False))
    empty = F.array().cast("array<string>")
    tags = F.array_sort(F.array_union(F.coalesce("tags", empty), F.coalesce("_tags", empty)))
    return joined.withColumns({"desc": F.when(longer, F.col("_text")).otherwise(F.col("desc")), "tags": tags}).select(*items.columns)


def with_answers(rows: DataFrame, ask: Callable[[str, str], str | None], title: str = "title", text: str = "desc", into: str = "answer") -> DataFrame:
    """The rows with a model's answer to title and text, null where it fails: the hook for any provider.

    `ask` runs on the workers, row by row within Arrow batches; rows keep their columns.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made: list[str | None] = []
            for a, b in zip(batch[title], batch[text], strict=True):
                try:
                    made.append(ask(a or "", b or ""))
                except Exception:
                    made.append(None)
            yield batch.assign(**{into: pd.Series(made, dtype=object, index=batch.index)})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, `{into}` string")
