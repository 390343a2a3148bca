"""The feed itself: best of each link, floor of papers, bonus across sources, upsert and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.links import canonical_link
from tidemark.functions.text import title_keywords

# Items of a feed, papers that it keeps room for, bonuses and their cap.
FEED, PAPERS, PAPER_BONUS, TITLE_BONUS, MOST_HEAT = 95, 28, 60, 30, 999


def keep_best(items: DataFrame) -> DataFrame:
    """For each link the row with most heat, then the latest date, then the first arrival; rows without a link go."""
    best = F.max_by(F.struct(*items.columns), F.struct("heat", "event_date", (-F.col("id")).alias("i")))
    return items.where(F.length("link") > 0).groupBy("link").agg(best.alias("b")).select("b.*")


def sorted_feed(items: DataFrame):
    return items.orderBy(F.desc("heat"), F.desc("event_date"), "id")


def paper_floor(items: DataFrame, size: int = FEED, papers: int = PAPERS, tie: str = "id") -> DataFrame:
    """At most `size` items: first others up to size - papers, then papers, then what is left, each by heat, the latest date and `tie`.

    Candidates beyond the first `size` of either class cannot enter, so both classes are cut before they are ranked.
    """
    order = (F.desc("heat"), F.desc("event_date"), tie)
    is_paper = F.col("type").eqNullSafe("paper")
    rows = items.where(is_paper).orderBy(*order).limit(size).unionByName(items.where(~is_paper).orderBy(*order).limit(size))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy(is_paper).orderBy(*order)))
    taken = F.sum(F.when(~is_paper & (F.col("n") <= size - papers), 1).otherwise(0)).over(Window.partitionBy())
    ranked = ranked.withColumn("turn", F.when(~is_paper, F.when(F.col("n") <= size - papers, 0).otherwise(2)).otherwise(F.when(F.col("n") <= size - taken, 1).otherwise(2)))
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy().orderBy("turn", *order)))
    return placed.where(F.col("place") <= size).select(*items.columns)


def cross_source_bonus(items: DataFrame) -> DataFrame:
    """Adds bonus and new_heat: items of one paper id from two venues or more; of those without a paper id, items of one set of title words from three."""
    by_paper = items.where(F.col("arxiv_id").isNotNull()).groupBy("arxiv_id").agg(F.countDistinct("venue").alias("venues")).where("venues >= 2").select("arxiv_id", F.lit(True).alias("shared"))
    # Items without a paper id need no join, which would send them all to one task.
    named, unnamed = items.where(F.col("arxiv_id").isNotNull()), items.where(F.col("arxiv_id").isNull())
    rows = named.join(by_paper, "arxiv_id", "left").unionByName(unnamed.withColumn("shared", F.lit(None).cast("boolean"))).withColumn("words", title_keywords(F.col("title")))
    title = rows.where(F.col("arxiv_id").isNull() & (F.size("words") >= 2)).groupBy("words").agg(F.count("*").alias("n"), F.countDistinct("venue").alias("venues"))
    title = title.where("n >= 3 and venues >= 3").select("words", F.lit(True).alias("alike"))
    bonus = F.when(F.col("shared"), PAPER_BONUS).when(F.col("arxiv_id").isNull() & F.col("alike"), TITLE_BONUS).otherwise(0)
    return rows.join(title, "words", "left").withColumn("bonus", bonus).withColumn("new_heat", F.least(F.lit(MOST_HEAT), F.col("heat") + F.col("bonus"))).drop("words", "shared", "alike")


#: Values of an item that an incoming row replaces.
REPLACED = ["type", "title", "desc", "event_date", "venue", "heat", "tags"]


def _entries(rows: DataFrame, order: Column) -> DataFrame:
    """link_hash, name, value as JSON text and order of every entry of the side-cars; malformed ones have none."""
    held = rows.select("link_hash", order.alias("order"), F.try_parse_json("raw_data").alias("raw")).where(F.startswith(F.schema_of_variant("raw"), F.lit("OBJECT")))
    split = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("raw").outer()))
    return split.select("link_hash", "order", F.col("key").alias("name"), F.to_json("value").alias("value"))


def merged_sidecars(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """link_hash and raw_data: shallow merge of the side-car JSON, the latest arrival's entry last; names in order."""
    key = lambda come: F.struct(F.lit(come).alias("come"), F.col("arrival").isNotNull().alias("has"), F.col("arrival").cast("long").alias("arrival")) if come else F.struct(F.lit(0).alias("come"), F.lit(False).alias("has"), F.lit(None).cast("long").alias("arrival"))
    every = _entries(stored, key(0)).unionByName(_entries(incoming, key(1)))
    last = every.groupBy("link_hash", "name").agg(F.max_by("value", F.struct("order", "value")).alias("value"))
    quoted = F.to_json(F.array("name"))
    pair = F.concat(F.substr(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), F.col("value"))
    sorted_pairs = F.array_sort(F.collect_list(F.struct("name", pair.alias("pair"))))
    return last.groupBy("link_hash").agg(F.concat(F.lit("{"), F.array_join(F.transform(sorted_pairs, lambda x: x["pair"]), ","), F.lit("}")).alias("raw_data"))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The merged table: link_hash, REPLACED, raw_data, fetch_count, is_new, heat_changed.

    Rows are merged one after another in order of `arrival`: the latest row of a link gives its values, every row adds
    one to fetch_count, and side-cars merge entry by entry; rows without an arrival come before all others. Stored rows
    that no row comes for stay as they are. is_new: not stored before; heat_changed: stored with another heat. Rows of
    `incoming` without a link are left out.
    """
    incoming = incoming.where(F.col("link_hash").isNotNull())
    latest = incoming.groupBy("link_hash").agg(F.max_by(F.struct(*REPLACED), F.struct(F.col("arrival").isNotNull().alias("has"), "arrival", "heat", "title")).alias("new"), F.count("*").cast("int").alias("times"))
    # Side-cars of links that come again are taken apart, all others copied. They meet the narrower side first, by the
    # key that both are dealt by, so that no row is sent a second time; merged, as broadcasts would pass through the driver.
    touched = merged_sidecars(stored.join(incoming.select("link_hash").hint("merge"), "link_hash", "left_semi"), incoming)
    s, i = stored.alias("s"), latest.join(touched.hint("merge"), "link_hash", "left").alias("i")
    joined = s.join(i.hint("merge"), F.col("s.link_hash") == F.col("i.link_hash"), "full_outer")
    new, old = F.col("i.times").isNotNull(), F.col("s.link_hash").isNotNull()
    pick = lambda name: F.when(new, F.col(f"i.new.{name}")).otherwise(F.col(f"s.{name}")).alias(name)
    count = F.coalesce("s.fetch_count", F.lit(0)) + F.coalesce("i.times", F.lit(0))
    flags = [count.cast("int").alias("fetch_count"), (~old).alias("is_new"), F.coalesce(new & old & (F.col("s.heat") != F.col("i.new.heat")), F.lit(False)).alias("heat_changed")]
    raw = F.when(new, F.col("i.raw_data")).otherwise(F.col("s.raw_data")).alias("raw_data")
    return joined.select(F.coalesce("i.link_hash", "s.link_hash").alias("link_hash"), *map(pick, REPLACED), raw, *flags)


def existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return incoming.join(stored.select("link_hash"), "link_hash", "left_semi")


def unseen(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose link is not stored, the first of each link."""
    first = incoming.groupBy("link_hash").agg(F.min_by(F.struct(*incoming.columns), "id").alias("b")).select("b.*")
    return first.join(stored.select("link_hash"), "link_hash", "left_anti")


def backfill(current: DataFrame, stored: DataFrame, most: int) -> DataFrame:
    """The feed and those of the latest stored papers, of links to arxiv.org alone, that it lacks by their canonical link."""
    papers = stored.where((F.col("type") == "paper") & F.col("link").contains("arxiv.org")).orderBy(F.desc("event_date"), F.desc("id")).limit(most)
    known = current.select(canonical_link(F.col("link")).alias("_key"))
    papers = papers.withColumns({"_key": canonical_link(F.col("link")), "link": canonical_link(F.col("link"))}).join(known, "_key", "left_anti").drop("_key")
    return current.unionByName(papers, allowMissingColumns=True)
