"""Rule scores against a taxonomy of domains, and their distribution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import half_up
from tidemark.operators.matching import matched


# Spans of a domain and of an item that are kept and told; the words of a rationale.
DOMAIN_SPANS, MOST_SPANS, TOLD_SPANS = 3, 6, 3
NOT_RELATED, RELATED, DOMAINS, SPANS, GENERAL = "与 AI Agent 工程无明显相关性。", "与 AI Agent 工程 {}（score={}）。", "主要涉及：{}。", "命中关键词：{}。", "通用"
STRONG, MEDIUM, WEAK, BETWEEN, OPEN, CLOSE = "强相关", "中度相关", "弱相关", "、", "「", "」"


@dataclass(frozen=True)
class Domain:
    """Keywords are literal, patterns are regular expressions."""

    id: str
    weight: float
    keywords: tuple[str, ...]
    patterns: tuple[str, ...] = ()
    label: str = ""


def _hits(items: DataFrame, taxonomy: list[Domain]) -> DataFrame:
    """id and found: of each domain with hits its place and spans, keywords in their order before matches of patterns.

    Keywords are found by a join with all of them; patterns, which are few, are expressions.
    """
    text = F.concat_ws(" ", F.array(*[F.trim(F.coalesce(c, F.lit(""))) for c in ("title", "title", "title", "desc")]))
    rows = items.select("id", text.alias("_text"))
    words = [(place, order, word) for place, d in enumerate(taxonomy) for order, word in enumerate(d.keywords)]
    known = items.sparkSession.createDataFrame([(i, *w) for i, w in enumerate(words)], "number int, place int, ord int, span string")
    met = matched(rows, F.col("_text"), [(i, w) for i, (_, _, w) in enumerate(words)], edges=True).select("id", "number").distinct().join(known, "number").select("id", "place", "ord", "span")
    tests = [(place, 1_000_000 + n, pattern) for place, d in enumerate(taxonomy) for n, pattern in enumerate(d.patterns)]
    if tests:
        got = lambda p: F.regexp_extract("_text", f"(?iu)({p})", 1)
        tried = F.array(*[F.when(F.col("_text").rlike(f"(?iu){p}"), F.struct(F.lit(place).alias("place"), F.lit(n).alias("ord"), got(p).alias("span"))) for place, n, p in tests])
        met = met.unionByName(rows.select("id", F.inline(F.array_compact(tried))))
    spans = F.transform(F.array_sort(F.collect_list(F.struct("ord", "span"))), lambda x: x["span"])
    by_domain = met.groupBy("id", "place").agg(spans.alias("spans"))
    return by_domain.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "spans"))).alias("found"))


def _told(score: Column, top: Column, spans: Column) -> Column:
    """What the score rests on, in a sentence or three."""
    join = lambda c: F.array_join(c, BETWEEN)
    said = lambda form, *values: F.concat(*[x for pair in zip(map(F.lit, form.split("{}")), [*values, F.lit("")], strict=True) for x in pair])
    level = F.when(score >= 7, STRONG).when(score >= 4, MEDIUM).otherwise(WEAK)
    quoted = F.transform(F.slice(spans, 1, TOLD_SPANS), lambda s: F.concat(F.lit(OPEN), s, F.lit(CLOSE)))
    parts = F.array(said(RELATED, level, score.cast("string")), said(DOMAINS, F.when(F.size(top) > 0, join(top)).otherwise(GENERAL)), F.when(F.size(spans) > 0, said(SPANS, join(quoted))))
    return F.when(score < 1, NOT_RELATED).otherwise(F.array_join(F.array_compact(parts), " "))


def rule_score(items: DataFrame, taxonomy: list[Domain]) -> DataFrame:
    """id, type, heat, score (0 to 10), top_domains (the two with most contribution), hits, band, spans and rationale. Ids are unique."""
    of = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values])
    at = lambda values, x, kind="string": F.element_at(of(values, kind), x["place"] + 1)
    part = lambda x: F.log1p(F.size(x["spans"]).cast("double")) * at([d.weight for d in taxonomy], x, "double") * 3.0
    joined = items.select("id", "type", "heat").join(_hits(items, taxonomy), "id", "left")
    found = F.coalesce("found", F.array().cast("array<struct<place:int,spans:array<string>>>"))
    worth = F.transform(found, lambda x: F.struct((-half_up(part(x), 2)).alias("order"), x["place"].alias("place"), at([d.id for d in taxonomy], x).alias("domain"), at([d.label or d.id for d in taxonomy], x).alias("label"), part(x).alias("part"), F.size(x["spans"]).alias("hits")))
    rows = joined.select("id", "type", "heat", found.alias("found"), F.array_sort(worth).alias("worth"))
    raw = F.aggregate("worth", F.lit(0.0), lambda a, x: a + x["part"])
    score = F.when(raw > 0, half_up(10.0 / (1.0 + F.exp(-(raw - 4.5) / 2.5)), 1)).otherwise(0.0)
    every = F.flatten(F.transform("found", lambda x: F.slice(x["spans"], 1, DOMAIN_SPANS)))
    # The first of those that differ in case alone.
    low = F.transform("every", F.lower)
    distinct = F.slice(F.filter("every", lambda s, i: F.array_position(F.col("low"), F.lower(s)) == i + 1), 1, MOST_SPANS)
    top = lambda name: F.transform(F.slice("worth", 1, 2), lambda x: x[name])
    out = rows.select("id", "type", "heat", score.alias("score"), top("domain").alias("top_domains"), top("label").alias("labels"), F.aggregate("worth", F.lit(0), lambda a, x: a + x["hits"]).alias("hits"), every.alias("every"))
    out = out.withColumn("low", low).withColumn("spans", distinct)
    band = F.when(F.col("score") < 1, "none").when(F.col("score") >= 7, "strong").when(F.col("score") >= 4, "medium").otherwise("weak")
    return out.select("id", "type", "heat", "score", "top_domains", "hits", band.alias("band"), "spans", _told(F.col("score"), F.col("labels"), F.col("spans")).alias("rationale"))


def buckets(scored: DataFrame, least: float) -> DataFrame:
    s = F.col("score")
    name = F.when(s >= 9, "9+").when(s >= 7, "7-9").when(s >= 5, "5-7").when(s >= 3, "3-5").otherwise("<3")
    return scored.where(s >= least).groupBy(name.alias("bucket")).agg(F.count("*").alias("n"))


def domains(scored: DataFrame, least: float) -> DataFrame:
    rows = scored.where(F.col("score") >= least).select(F.explode("top_domains").alias("domain"), "score")
    return rows.groupBy("domain").agg(F.count("*").alias("n"), half_up(F.avg("score"), 1).alias("avg_score")).orderBy(F.desc("n"), "domain")


def types(scored: DataFrame, least: float) -> DataFrame:
    return scored.where(F.col("score") >= least).groupBy("type").agg(F.count("*").alias("n"), half_up(F.avg("score"), 1).alias("avg_score"))


def best(scored: DataFrame, least: float, top_k: int = 20) -> DataFrame:
    rank = half_up(0.6 * F.col("score") + 0.4 * F.log1p(F.col("heat").cast("double")), 4)
    return scored.where(F.col("score") >= least).select("id", "score", "heat", rank.alias("rank_score")).orderBy(F.desc("rank_score"), "id").limit(top_k)


def domain_evidence(scored: DataFrame, least: float, each: int = 3) -> DataFrame:
    rows = scored.where(F.col("score") >= least).select(F.explode("top_domains").alias("domain"), "id", "score", "heat")
    order = Window.partitionBy("domain").orderBy(F.desc("score"), F.desc("heat"), "id")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("domain", "id", "score")
