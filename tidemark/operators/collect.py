"""One collection cycle: what several sources brought becomes the feed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.links import canonical_link
from tidemark.functions.scores import TOPIC_GROUPS, heat
from tidemark.functions.text import arxiv_id
from tidemark.operators import entities, feed
from tidemark.sources.articles import ENGAGEMENT

#: Columns of an item of the feed.
ITEM = ["link", "type", "title", "desc", "event_date", "venue", "heat", "arxiv_id", "entities"]
# Stored papers that a feed short of papers is filled up from, for each paper that it keeps room for, and at least.
BACKFILL_TIMES, BACKFILL_LEAST = 4, 28


def prepared(items: DataFrame, as_of: str, lexicon: Sequence[tuple[str, str, str]] = (), topics=TOPIC_GROUPS) -> DataFrame:
    """Items of all sources with id, canonical link, arxiv_id, heat and entities, in order of their ids.

    The paper id is the link's, else one that title or text mention. An item's id is a hash of what it says, so that a
    batch that is run again gives the same; rows that say the same are one.
    """
    link, words = canonical_link(F.col("link")), F.concat_ws(" ", "title", "desc")
    # Exploding one element keeps the link's expression from being copied into all that read it.
    rows = items.withColumn("link", F.explode(F.array(link))).where(F.length("link") > 0).withColumn("arxiv_id", arxiv_id(F.col("link"), words))
    rows = rows.withColumn("gh_full_name", F.when(F.col("venue") == "GitHub", F.col("title"))).withColumn("heat", heat(as_of, topics))
    rows = rows.withColumn("id", F.xxhash64("link", "venue", "title", "desc", "event_date", *ENGAGEMENT)).drop("gh_full_name").dropDuplicates(["id"])
    # Heat is not worked out a second time for this branch, which has no use for it.
    found = entities.extracted(rows.withColumn("heat", F.lit(None).cast("int")), list(lexicon)).groupBy("id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
    return rows.join(found, "id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def best(items: DataFrame) -> DataFrame:
    """The best of `prepared` items for each link, with the bonus of those that several sources have."""
    hot = feed.cross_source_bonus(items).withColumn("heat", F.col("new_heat"))
    return feed.keep_best(hot.select("id", *ITEM))


def missing(found: DataFrame, stored: DataFrame, size: int = feed.FEED) -> DataFrame | None:
    """The latest stored papers whose links are not among the best items, to be prepared anew; None where there are papers enough.

    `stored` has link, type, title, desc, event_date and venue.
    """
    room = min(feed.PAPERS, size // 2)
    if found.where(F.col("type") == "paper").limit(room).count() >= room:
        return None
    none = [F.lit(None).cast("int").alias(n) for n in ENGAGEMENT]
    kept = stored.where((F.col("type") == "paper") & F.col("link").contains("arxiv.org")).withColumn("link", canonical_link(F.col("link")))
    last = kept.orderBy(F.desc("event_date"), F.desc("link")).limit(max(BACKFILL_TIMES * room, BACKFILL_LEAST))
    return last.join(found.select("link"), "link", "left_anti").select("link", "type", "title", "desc", "event_date", F.coalesce("venue", F.lit("arXiv")).alias("venue"), *none)


def cycle(found: DataFrame, again: DataFrame | None = None, size: int = feed.FEED) -> DataFrame:
    """The feed of the best items and, if there are any, stored papers that were prepared anew."""
    every = found if again is None else found.unionByName(again.select("id", *ITEM))
    return feed.paper_floor(every, size, min(feed.PAPERS, size // 2), "link")
