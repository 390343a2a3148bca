"""The analyses of a feed behind one object: windows, bounds and defaults as users of the service know them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicons
from tidemark.functions.text import DEFAULT_TAG, TAG_RULES, infer_tags
from tidemark.operators import digest, enrich, entities, feed, insights, runs, scoring, taxonomy, terms
from tidemark.sources.stored import Stored

# Kinds of items; most days, results, recent and compared days; days of word counts and of both windows.
TYPES = ("paper", "news", "repo")
MOST_DAYS, MOST_RESULTS, MOST_RECENT, MOST_COMPARED = 365, 200, 90, 730
WORD_DAYS, RECENT_DAYS, COMPARED_DAYS = 30, 7, 30


def bounded(value: str | None, default: int, least: int, most: int) -> int:
    """A setting given as text: the default where it is no number, else held between the bounds."""
    try:
        return max(least, min(most, int(value)))
    except (TypeError, ValueError):
        return default


def _within(name: str, value: int, most: int, least: int = 1) -> int:
    if not least <= value <= most:
        raise ValueError(f"{name} must be from {least} to {most}")
    return value


@dataclass
class Engine:
    """Analyses of `items` as of a day. Rows with a null event_date lie in no window.

    Items have id, title, desc, type, event_date, venue, heat and arxiv_id; lexicons are parameters. `stored` are the
    same items' kept tables, made with the same lexicons: trends and topics then read sums instead of texts.
    """

    items: DataFrame
    as_of: str
    stop: Sequence[str] = ()
    concepts: Mapping[str, str] = field(default_factory=lambda: lexicons.CONCEPTS)
    compounds: Sequence[tuple[str, str]] = field(default_factory=lambda: lexicons.COMPOUNDS)
    anchors: Sequence[str] = field(default_factory=lambda: lexicons.ANCHORS)
    stems: str = terms.STEMS
    lexicon: Sequence[tuple[str, str, str]] = ()
    domains: Sequence[taxonomy.Domain] = ()
    tag_rules: Sequence[tuple[str, Sequence[str]]] = field(default_factory=lambda: TAG_RULES)
    default_tag: str = DEFAULT_TAG
    stored: Stored | None = None

    # Windows

    def _typed(self, type: str | None) -> DataFrame:
        """Items of one type; blank is any."""
        if not (type or "").strip():
            return self.items
        if type not in TYPES:
            raise ValueError(f"type must be one of {', '.join(TYPES)}")
        return self.items.where(F.col("type") == type)

    def recent(self, days: int, type: str | None = None, most: int = MOST_DAYS) -> DataFrame:
        """Items from `days` days before the day on."""
        start = F.date_sub(F.lit(self.as_of).cast("date"), _within("days", days, most))
        return self._typed(type).where(F.col("event_date") >= start)

    def _days(self, recent: int, compared: int) -> tuple[Column, Column]:
        """Whether an item is of the recent days, and whether of those before; the comparison is one day longer than them at least."""
        _within("recent_days", recent, MOST_RECENT)
        compared = max(_within("compare_days", compared, MOST_COMPARED), recent + 1)
        at, day = F.col("event_date"), F.lit(self.as_of).cast("date")
        return at >= F.date_sub(day, recent), (at >= F.date_sub(day, compared)) & (at < F.date_sub(day, recent))

    def windows(self, recent: int, compared: int, type: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The recent items and those before them."""
        items = self._typed(type)
        now, past = self._days(recent, compared)
        return items.where(now), items.where(past)

    def _tokens(self, items: DataFrame) -> DataFrame:
        return terms.tokenized(items, self.as_of, self.stop, self.concepts, self.compounds)

    def _tags(self):
        return infer_tags(F.concat_ws(" ", "title", "desc"), self.tag_rules, self.default_tag)

    # Analyses

    def stats(self) -> DataFrame:
        return runs.stats_by_type(self.items)

    def feed(self, size: int = feed.FEED) -> DataFrame:
        """The feed with its room for papers, best first: each link's best item, heat with its bonus where several sources agree."""
        items = feed.cross_source_bonus(self.items).withColumn("heat", F.col("new_heat")).drop("bonus", "new_heat")
        items = feed.keep_best(items) if "link" in items.columns else items
        return feed.paper_floor(items.select(*self.items.columns), size, min(feed.PAPERS, size // 2))

    def word_freq(self, days: int = WORD_DAYS, top_k: int = 50, type: str | None = None) -> DataFrame:
        """Words, phrases, tags, types and dates of a window (`insights.bundle`)."""
        rows = self.recent(days, type)
        return insights.bundle(rows, self._tokens(rows), _within("top_k", top_k, MOST_RESULTS), self.tag_rules, self.default_tag)

    def _terms(self, items: DataFrame) -> terms.Terms:
        """Sums of terms: those kept by day, if there are any, else of the items themselves."""
        return self.stored.terms(self.as_of) if self.stored else terms.Terms.of(self._tokens(items))

    def trending(self, recent_days: int = RECENT_DAYS, compare_days: int = COMPARED_DAYS, top_k: int = 20, type: str | None = None) -> DataFrame:
        items, found = self._typed(type), self._days(recent_days, compare_days)
        of = self._terms(items.where(found[0] | found[1]))
        return (of.where(F.col("type") == type) if (type or "").strip() else of).trends(*found, _within("top_k", top_k, MOST_RESULTS))

    def topics(self, recent_days: int = RECENT_DAYS, compare_days: int = COMPARED_DAYS, top_k: int = 12, each: int = 3) -> DataFrame:
        """Topic cards; where no sums are kept by day, the items of both windows are tokenised once into a scratch table."""
        now, past = self._days(recent_days, compare_days)
        kept = self.stored
        if kept is None:
            kept = Stored.scratch(self.items.sparkSession, self.items.where(now | past), self.stop, self.concepts, self.compounds)
        found = kept.terms(self.as_of) if self.stored else kept.by_window(self.as_of, now, past)
        nominated = terms.nominations(found, now, past, list(self.anchors), self.stems, kept.spelled)
        return terms.topic_cards(nominated, kept.tokens().where(now), _within("top_k", top_k, MOST_RESULTS), each)

    def industry(self, days: int = WORD_DAYS, least: float = 3.0, type: str | None = None) -> DataFrame:
        """section (bucket, domain, type), name, n and average score of the items that score `least` or more."""
        scored = taxonomy.rule_score(self.recent(days, type), list(self.domains))
        part = lambda rows, section, name, score: rows.select(F.lit(section).alias("section"), F.col(name).alias("name"), "n", score.alias("avg_score"))
        none = F.lit(None).cast("double")
        return part(taxonomy.buckets(scored, least), "bucket", "bucket", none).unionByName(part(taxonomy.domains(scored, least), "domain", "domain", F.col("avg_score"))).unionByName(part(taxonomy.types(scored, least), "type", "type", F.col("avg_score")))

    def entities(self, recent_days: int = RECENT_DAYS, compare_days: int = COMPARED_DAYS, top_k: int = 40, category: str | None = None) -> DataFrame:
        known = {c for _, c, _ in self.lexicon}
        if category and category not in known:
            raise ValueError(f"category must be one of {', '.join(sorted(known))}")
        now, past = self._days(recent_days, compare_days)
        return entities.momentum(self._entities(now | past), now, past, _within("top_k", top_k, MOST_RESULTS), category)

    def _entities(self, days: Column) -> DataFrame:
        return entities.extracted(self.items.where(days), list(self.lexicon))

    def entity_evidence(self, recent_days: int = RECENT_DAYS, each: int = 3) -> DataFrame:
        """entity_id, rank, id, heat: the hottest recent items of every entity."""
        return entities.evidence(self._entities(self._days(recent_days, recent_days + 1)[0]), each)

    def convergence_evidence(self, days: int = WORD_DAYS, least_types: int = 2, top_k: int = 50) -> DataFrame:
        """arxiv_id, type, id, heat: the hottest item of each type behind every convergence."""
        rows = self.recent(days)
        return entities.convergence_evidence(rows, entities.convergence(rows, least_types, _within("top_k", top_k, MOST_RESULTS)))

    def health(self, last: DataFrame, now: str) -> DataFrame:
        """The state of each source by its last success (source, last_ok)."""
        return runs.health(last, now)

    def structs(self, kept: DataFrame, answers: DataFrame) -> DataFrame:
        """Fields of papers that have none kept yet, read from a model's answers."""
        return scoring.extract_missing(self.items, kept, answers)

    def to_enhance(self, most: int = enrich.MOST) -> DataFrame:
        return enrich.to_enhance(self.items, most)

    def convergence(self, days: int = WORD_DAYS, least_types: int = 2, top_k: int = 50) -> DataFrame:
        return entities.convergence(self.recent(days), least_types, _within("top_k", top_k, MOST_RESULTS))

    def emergence(self, recent_days: int = RECENT_DAYS, compare_days: int = COMPARED_DAYS, top_k: int = 40, least: int = 2) -> DataFrame:
        now, past = self._days(recent_days, compare_days)
        return entities.emergence(self._entities(now | past), now, past, _within("top_k", top_k, MOST_RESULTS), least)

    def aggregate(self, days: int = WORD_DAYS, recent_days: int = RECENT_DAYS, top_k: int = 20) -> DataFrame:
        """section, rank, name, value: words, trends (of titles alone), entities, new entities and convergence at one look."""
        rows, (now, past) = self.recent(days), self._days(recent_days, days)
        titles = terms.Terms.of(self._tokens(self.items.withColumn("desc", F.lit(""))))
        found = self._entities(now | past)
        section = lambda frame, name, label, value: insights._section(frame, name, F.col(label), F.col(value), F.desc(value), F.col(label)).withColumnRenamed("label", "name")
        parts = [
            section(terms.tfidf(self._tokens(rows), top_k), "word", "term", "score"),
            section(titles.trends(now, past, top_k), "trend", "term", "g2"),
            section(entities.momentum(found, now, past, top_k), "entity", "entity_id", "composite"),
            section(entities.emergence(found, now, past, top_k, 1), "emergence", "entity_id", "score"),
            section(entities.convergence(rows, 2, top_k), "convergence", "arxiv_id", "score"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def insights(self, keywords: int = 16, phrases: int = 8) -> DataFrame:
        return insights.insights(self.items, self._tokens(self.items), self._tags(), keywords, phrases)

    def weekly_digest(self, kept: DataFrame, writer=None) -> DataFrame:
        return digest.digest(self.items, kept, self.as_of, writer)
