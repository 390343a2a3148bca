"""Scores that are kept: rows already scored are skipped, and answers of a model are read where there are any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import taxonomy

# Fields that a paper's answer has, its least, most and usual novelty.
TEXTS, LEAST, MOST, USUAL = ["problem", "method", "key_metric", "impl_url", "one_liner"], 1, 5, 3


def unfenced(answer: Column) -> Column:
    """An answer without a Markdown fence around it: the text between its first line and the last fence."""
    text = F.trim(answer, F.lit(" \n\t\r"))
    return F.when(text.startswith("```"), F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)```", 1)).otherwise(text)


def paper_struct(answer: Column) -> Column:
    """The fields of a JSON answer: missing texts are empty, novelty is held between LEAST and MOST; null if it is no JSON object."""
    raw = F.try_parse_json(unfenced(answer))
    field = lambda name: F.coalesce(F.try_variant_get(raw, f"$.{name}", "string"), F.lit("")).alias(name)
    novelty = F.try_variant_get(raw, "$.novelty", "int")
    held = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.when(novelty == 0, USUAL).otherwise(F.coalesce(novelty, F.lit(USUAL))))).alias("novelty")
    return F.when(F.schema_of_variant(raw).startswith("OBJECT"), F.struct(*map(field, TEXTS), held))


def answered_score(answer: Column) -> Column:
    """The score of a JSON answer, from 0 to 10; null if there is none."""
    score = F.try_variant_get(F.try_parse_json(unfenced(answer)), "$.score", "double")
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(10.0), score)))


def unscored(items: DataFrame, kept: DataFrame, force: bool = False) -> DataFrame:
    """Items whose id has no kept score; all of them if `force`."""
    return items if force else items.join(kept.select("id"), "id", "left_anti")


def score_missing(items: DataFrame, kept: DataFrame, domains, answers: DataFrame | None = None, force: bool = False) -> DataFrame:
    """id, score, method for the items to score: a model's answer (id, answer) where it has a score, else by rule."""
    ruled = taxonomy.rule_score(unscored(items, kept, force), domains).select("id", "score")
    if answers is None:
        return ruled.withColumn("method", F.lit("rule"))
    given = answers.select("id", answered_score(F.col("answer")).alias("given")).where("given is not null")
    joined = ruled.join(given, "id", "left")
    return joined.select("id", F.coalesce("given", "score").alias("score"), F.when(F.col("given").isNotNull(), "model").otherwise("rule").alias("method"))


def merged_scores(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """The kept scores with the fresh ones in place of theirs."""
    return kept.join(fresh.select("id"), "id", "left_anti").select("id", "score", "method").unionByName(fresh.select("id", "score", "method"))


def extract_missing(items: DataFrame, kept: DataFrame, answers: DataFrame, force: bool = False) -> DataFrame:
    """id and the fields of `paper_struct` for papers without kept ones whose answer (id, answer) can be read."""
    wanted = unscored(items.where((F.col("type") == "paper") & (F.length(F.trim("title")) > 0)), kept, force)
    read = wanted.select("id").join(answers, "id").select("id", paper_struct(F.col("answer")).alias("s")).where("s is not null")
    return read.select("id", "s.*")
