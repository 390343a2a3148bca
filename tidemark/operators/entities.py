"""Entities in a feed: extraction, momentum, emergence, and items of one paper that converge from several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import half_up
from tidemark.operators.matching import matched


def extracted(items: DataFrame, lexicon: list[tuple[str, str, str]]) -> DataFrame:
    """One row for each item and entity (entity_id, category) of which a surface form stands in the text as a whole word.

    `lexicon` has rows of entity, category and form; forms are literal and case does not count. Ids are unique.
    """
    entries = sorted({(e, c) for e, c, _ in lexicon})
    numbers = {x: i for i, x in enumerate(entries)}
    text = F.concat_ws(" ", "title", "title", "title", "desc")
    rows = items.select("id", "type", "heat", "event_date", text.alias("_text"))
    found = matched(rows, F.col("_text"), sorted({(numbers[e, c], f) for e, c, f in lexicon})).drop("_text").distinct()
    known = items.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(entries)], "number int, entity_id string, category string")
    return found.join(known, "number").select("id", "type", "heat", "event_date", "entity_id", "category")


def _counted(found: DataFrame, recent: Column, past: Column) -> DataFrame:
    """entity_id, category, mentions, heat_sum and types of the recent mentions, and how many there were before; one aggregation."""
    now = lambda c: F.when(recent, c)
    sums = [F.count(now(F.lit(1))).alias("mentions"), F.sum(now(F.col("heat"))).alias("heat_sum"), F.countDistinct(now(F.col("type"))).alias("types"), F.count(F.when(past, 1)).alias("before")]
    return found.where(recent | past).groupBy("entity_id", "category").agg(*sums).where("mentions > 0")


def momentum(found: DataFrame, recent: Column, past: Column, top_k: int, category: str | None = None) -> DataFrame:
    """Entities by heat, mentions, their change against the past, and the variety of their sources."""
    joined = _counted(found.where(F.col("category") == category) if category else found, recent, past)
    m = F.col("mentions")
    velocity = half_up(F.when(F.col("before") > 0, m / F.col("before")).otherwise(F.least(F.lit(5.0), 1.5 * m)), 2)
    cross = F.when(F.col("types") == 2, 2.5).when(F.col("types") == 3, 5.0).otherwise(1.0)
    scored = joined.withColumn("velocity", velocity)
    composite = half_up(F.log1p(F.col("heat_sum").cast("double")) + 2 * F.log1p(m.cast("double")) + 1.5 * F.col("velocity") + 1.2 * cross, 2)
    trend = F.when(F.col("velocity") >= 1.5, "rising").when(F.col("velocity") < 0.7, "cooling").otherwise("stable")
    return scored.select("entity_id", "category", "mentions", "heat_sum", "types", "velocity", composite.alias("composite"), trend.alias("trend")).orderBy(F.desc("composite"), "entity_id").limit(top_k)


def evidence(recent: DataFrame, each: int = 3) -> DataFrame:
    """Each entity's hottest items."""
    order = Window.partitionBy("entity_id").orderBy(F.desc("heat"), "id")
    return recent.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("entity_id", "rank", "id", "heat")


def emergence(found: DataFrame, recent: Column, past: Column, top_k: int, least: int = 2) -> DataFrame:
    """Entities by mentions and heat, doubled where the past did not mention them."""
    joined = _counted(found, recent, past).where(F.col("mentions") >= least).withColumn("is_new", F.col("before") == 0)
    score = half_up(F.col("mentions") * F.log1p(F.col("heat_sum").cast("double")) * F.when(F.col("is_new"), 2).otherwise(1), 2)
    return joined.select("entity_id", "mentions", "heat_sum", "is_new", score.alias("score")).orderBy(F.desc("score"), "entity_id").limit(top_k)


def convergence(items: DataFrame, least_types: int, top_k: int) -> DataFrame:
    """Groups of one paper id with items of several types; the anchor is the hottest paper, or else the hottest item."""
    rows = items.where(F.col("arxiv_id").isNotNull())
    anchor = F.max_by("id", F.struct((F.col("type") == "paper").cast("int").alias("p"), F.col("heat").alias("h"), (-F.col("id")).alias("i")))
    groups = rows.groupBy("arxiv_id").agg(F.countDistinct("type").alias("types"), F.sum("heat").alias("total_heat"), F.max("event_date").alias("latest_date"), anchor.alias("anchor_id"), F.count("*").alias("items"))
    score = half_up(3.0 * F.col("types") + 0.8 * F.log1p(F.col("total_heat").cast("double")) + F.when(F.col("types") >= 3, 5).otherwise(0), 2)
    return groups.where(F.col("types") >= least_types).select("arxiv_id", "types", "items", "total_heat", "latest_date", "anchor_id", score.alias("score")).orderBy(F.desc("score"), "arxiv_id").limit(top_k)


def convergence_evidence(items: DataFrame, cards: DataFrame) -> DataFrame:
    """The hottest item of each type of every card."""
    rows = items.where(F.col("arxiv_id").isNotNull()).join(F.broadcast(cards.select("arxiv_id")), "arxiv_id", "left_semi")
    order = Window.partitionBy("arxiv_id", "type").orderBy(F.desc("heat"), "id")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("arxiv_id", "type", "id", "heat")


def described(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of entity ids with display and category from the lexicon's entities; ids that it lacks are dropped."""
    return found.drop("category").join(known.select("entity_id", "display", "category"), "entity_id")
