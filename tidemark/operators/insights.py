"""Reports over a feed: the bundle of term, tag and type counts, and the short insights shown with a feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import terms

# Least words of the bundle behind the insights; venues and tags that they list.
LEAST_WORDS, VENUES, TAGS = 36, 8, 10


def _section(rows: DataFrame, name: str, label: Column, value: Column, *order: Column) -> DataFrame:
    """section, rank, label and value of rows that are few already."""
    ranked = rows.select(label.cast("string").alias("label"), value.cast("double").alias("value"), F.row_number().over(Window.partitionBy().orderBy(*order)).alias("rank"))
    return ranked.select(F.lit(name).alias("section"), "rank", "label", "value")


def _types(items: DataFrame) -> DataFrame:
    rows = items.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))
    return _section(rows, "type", F.col("type"), F.col("n"), F.desc("n"), F.col("type"))


def _dates(items: DataFrame) -> DataFrame:
    range_of = items.agg(F.min("event_date").alias("first"), F.max("event_date").alias("last"))
    ends = range_of.select(F.inline(F.array(F.struct(F.lit("first").alias("k"), F.col("first").alias("day")), F.struct(F.lit("last").alias("k"), F.col("last").alias("day")))))
    return ends.where("day is not null").select(F.lit("date").alias("section"), F.when(F.col("k") == "first", 1).otherwise(2).alias("rank"), F.col("day").cast("string").alias("label"), F.lit(None).cast("double").alias("value"))


def _words(tokened: DataFrame, top_k: int, name: str, whole: bool = False) -> DataFrame:
    score = F.floor("score") if whole else F.col("score")
    return _section(terms.tfidf(tokened, top_k), name, F.col("term"), score, F.desc("score"), F.col("term"))


def _phrases(tokened: DataFrame, top_k: int, name: str, whole: bool = False) -> DataFrame:
    score = F.floor("score") if whole else F.col("score")
    return _section(terms.npmi(tokened, top_k), name, F.concat_ws(" ", "a", "b"), score, F.desc("score"), F.col("a"), F.col("b"))


def bundle(items: DataFrame, tokened: DataFrame, top_k: int, rules=terms.TAG_RULES, default: str = terms.DEFAULT_TAG) -> DataFrame:
    """section (type, date, word, phrase, tag), rank, label, value: all counts of one set of items."""
    tags = terms.tag_degree(items, rules, default)
    parts = [_types(items), _dates(items), _words(tokened, top_k, "word"), _phrases(tokened, max(1, top_k // 2), "phrase"), _section(tags, "tag", F.col("tag"), F.col("degree"), F.desc("degree"), F.col("tag"))]
    return reduce(DataFrame.unionByName, parts)


def insights(items: DataFrame, tokened: DataFrame, tags: Column, keywords: int = 16, phrases: int = 8) -> DataFrame:
    """section, rank, label, value: whole scores of the best words and phrases, types, dates, and the commonest venues and tags.

    `tags` is each item's list of tags; ties go by name. Without items there are no rows.
    """
    venues = items.where(F.length("venue") > 0).groupBy("venue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "venue").limit(VENUES)
    counted = items.select(F.explode_outer(tags).alias("tag")).where(F.length("tag") > 0).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(TAGS)
    parts = [
        _words(tokened, keywords, "keyword", True),
        _phrases(tokened, phrases, "phrase", True),
        _types(items),
        _dates(items),
        _section(venues, "venue", F.col("venue"), F.col("n"), F.desc("n"), F.col("venue")),
        _section(counted, "tag", F.col("tag"), F.col("n"), F.desc("n"), F.col("tag")),
    ]
    return reduce(DataFrame.unionByName, parts)


def headline(found: DataFrame, most: int = 6) -> DataFrame:
    """One row for each line of text that sums up insights: line, text."""
    listed = lambda section, n, shown: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("section") == section) & (F.col("rank") <= n), F.struct("rank", shown.alias("s"))))), lambda x: x["s"]), " · ")
    named = F.concat("label", F.lit(" ×"), F.col("value").cast("long").cast("string"))
    one = found.agg(listed("keyword", most, F.col("label")).alias("keywords"), listed("phrase", 5, F.col("label")).alias("phrases"), listed("tag", 6, named).alias("tags"), listed("venue", 5, named).alias("venues"))
    lines = F.array(*(F.struct(F.lit(i).alias("line"), F.concat(F.lit(f"{name}: "), F.col(name)).alias("text"), F.col(name).alias("body")) for i, name in enumerate(("keywords", "phrases", "tags", "venues"), 1)))
    return one.select(F.inline(lines)).where(F.length("body") > 0).select("line", "text")
