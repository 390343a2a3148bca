"""Term analytics over a feed: weighted TF-IDF, NPMI bigrams, log-likelihood trends, tags and topic cards.

All of them are sums over terms: how often a term stands in an item, how much of it, and at what weight. `Terms` holds
rows that are added up, be they the words of items or, as an item's weight decays alike on all items of a day, the kept
sums of a day (`sources.stored`). Results show tokens with hyphens.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scores import half_up, item_weight
from tidemark.functions.text import DEFAULT_TAG, TAG_RULES, infer_tags, once, shown, tokens

# What a topic's token may also be, besides an anchor, to be worth a card.
STEMS = r"^m?llm|llm$|_llm|llm_|^rag$|^rag_|_rag$|^agent|agent$|_agent|^vlm|vlm$|_vlm|^(kv|lora|dpo|rlhf)(_|$)|_(kv|lora|dpo|rlhf)$"
# Times that a title counts, least bigram count, least PMI, least log-likelihood of a trend, least weight in a trend.
TITLE_TIMES, LEAST_COUNT, LEAST_PMI, LEAST_G2, LEAST_WEIGHT = 3, 3, 0.8, 3.84, 1e-6
# Kinds of items, and what each of them nominates for topics: trends, words, phrases.
KINDS = ("paper", "repo", "news")
TRENDS, WORDS, PHRASES = 30, 15, 10


def tokenized(items: DataFrame, as_of: str, stop=(), concepts=None, lexicon=()) -> DataFrame:
    """id, type, weight, event_date, title_tokens, desc_tokens."""
    of = lambda name: tokens(F.col(name), stop, concepts, lexicon)
    return items.select("id", "type", "event_date", "heat", item_weight(F.col("heat"), F.col("event_date"), F.col("type"), as_of).alias("weight"), of("title").alias("title_tokens"), of("desc").alias("desc_tokens"))


def _sequence() -> Column:
    return F.concat(F.flatten(F.array_repeat("title_tokens", TITLE_TIMES)), "desc_tokens")


def _top(rows: DataFrame, k: int, by: Sequence[str], *order: Column) -> DataFrame:
    """The first k rows, of each group if there are groups."""
    if not by:
        return rows.orderBy(*order).limit(k)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


@dataclass(frozen=True)
class Terms:
    """Rows to add up.

    `rows`: type, event_date, a, b (the second of two neighbours, null for single words), n (occurrences, a title's
    three times), items (in how many it stands), mass (share of an item's tokens times its weight), heavy (occurrences
    times weight). `totals`: type, event_date, items, weight, tokens, pairs.
    """

    rows: DataFrame
    totals: DataFrame

    @staticmethod
    def of(tokened: DataFrame, phrases: bool | Column = False) -> Terms:
        """One row for each occurrence and for each distinct word of an item; with `phrases` also for neighbours, of those items alone if it is a condition."""
        weight, size = F.greatest("weight", F.lit(LEAST_WEIGHT)), F.greatest(TITLE_TIMES * F.size("title_tokens") + F.size("desc_tokens"), F.lit(1))
        # One array of plain strings is exploded; the place of a word says what it counts for.
        words = [F.col("title_tokens"), F.col("desc_tokens"), F.array_distinct(F.concat("title_tokens", "desc_tokens"))]
        some = isinstance(phrases, Column)
        following = F.when(phrases, _sequence()).otherwise(F.array().cast("array<string>")) if some else _sequence()
        held = tokened.select("type", "event_date", "weight", weight.alias("least"), size.alias("size"), F.size("title_tokens").alias("t"), (F.size("title_tokens") + F.size("desc_tokens")).alias("d"), F.size(words[2]).alias("u"), F.concat(*words, *([following] if some or phrases else [])).alias("every"))
        # Outer, as else the optimiser tests for empty arrays before, with all of the work that makes them.
        rows = held.select("*", F.posexplode_outer("every").alias("at", "a")).where(F.col("at").isNotNull())
        if some or phrases:
            rows = rows.where((F.col("at") < F.col("d") + F.col("u")) | (F.col("at") < F.size("every") - 1))
            after = F.when(F.col("at") >= F.col("d") + F.col("u"), F.get("every", F.col("at") + 1))
        else:
            after = F.lit(None).cast("string")
        n = F.when(F.col("at") < F.col("t"), TITLE_TIMES).when((F.col("at") >= F.col("d")) & (F.col("at") < F.col("d") + F.col("u")), 0).otherwise(1).cast("long")
        items = ((F.col("at") >= F.col("d")) & (F.col("at") < F.col("d") + F.col("u"))).cast("long")
        rows = rows.select("type", "event_date", "a", after.alias("b"), n.alias("n"), items.alias("items"), (n / F.col("size") * F.col("weight")).alias("mass"), (n * F.col("least")).alias("heavy"))
        count = TITLE_TIMES * F.size("title_tokens") + F.size("desc_tokens")
        totals = tokened.select("type", "event_date", F.lit(1).alias("items"), weight.alias("weight"), count.alias("tokens"), F.greatest(count - 1, F.lit(0)).alias("pairs"))
        return Terms(rows, totals)

    def where(self, condition: Column) -> Terms:
        """Those of items of some types and days."""
        return Terms(self.rows.where(condition), self.totals.where(condition))

    def summed(self, *windows: Column, phrases: Column | None = None) -> Terms:
        """The sums of each type and window, a row standing at one of its days: what any other grouping by type and window adds up.

        Windows are conditions on event_date that exclude each other; rows of none are left out. Neighbours are those of
        the window `phrases` alone, without the rare ones, which are no phrases; the totals count them.
        """
        window = F.coalesce(*(F.when(w, i) for i, w in enumerate(windows)))
        day = F.min("event_date").alias("event_date")
        rows = self.rows.where(window.isNotNull())
        sums = rows.groupBy("type", window.alias("window"), "a", "b").agg(day, *(F.sum(c).alias(c) for c in ("n", "items", "mass", "heavy")))
        kept = F.col("b").isNull() if phrases is None else F.col("b").isNull() | (F.col("n") >= LEAST_COUNT) & phrases
        totals = self.totals.where(window.isNotNull()).groupBy("type", window.alias("window")).agg(day, *(F.sum(c).alias(c) for c in ("items", "weight", "tokens", "pairs")))
        return Terms(sums.where(kept).drop("window"), totals.drop("window"))

    def _with(self, rows: DataFrame, by: Sequence[str], *sums: Column) -> DataFrame:
        """The rows with sums over all items, or over those of their group."""
        total = self.totals.groupBy(*by).agg(*sums)
        return rows.join(total, list(by)) if by else rows.join(F.broadcast(total), how="cross")

    def words(self, k: int, by: Sequence[str] = ()) -> DataFrame:
        """term, df, score: the sum of tf x idf x weight, scaled to 100 for the best; of each group `by`."""
        sums = self.rows.where("b is null").groupBy(*by, "a").agg(F.sum("items").alias("df"), F.sum("mass").alias("mass"))
        all_ = self._with(sums, by, F.sum("items").alias("all_items"))
        scored = all_.select(*by, shown(F.col("a")).alias("term"), "df", (F.col("mass") * (F.log((F.col("all_items") + 1) / (F.col("df") + 1)) + 1)).alias("raw"))
        order = (F.desc(F.round("raw", 9)), F.col("term"))
        top = _top(scored, k, by, *order)
        # The best stands among the top, so the scale needs no second pass over all terms.
        best = half_up(F.col("raw") / F.max("raw").over(Window.partitionBy(*by)) * 100, 1)
        return top.withColumn("score", best).orderBy(*by, *order).select(*by, "term", "df", "score")

    def phrases(self, k: int, by: Sequence[str] = ()) -> DataFrame:
        """a, b, n, score: neighbours by normalised pointwise mutual information; of each group `by`."""
        # `single` is an aggregate so that no filter on it goes below: all three uses share one shuffle.
        counts = self.rows.groupBy(*by, "a", "b").agg(F.sum("n").alias("n"), F.max(F.col("b").isNull()).alias("single")).where("n > 0")
        kept = counts.where((~F.col("single")) & (F.col("n") >= LEAST_COUNT)).drop("single")
        words = counts.where("single").drop("b", "single")
        keys = list(by)
        joined = kept.join(words.select(*by, "a", F.col("n").alias("ca")), [*keys, "a"]).join(words.select(*by, F.col("a").alias("b"), F.col("n").alias("cb")), [*keys, "b"])
        total = self.totals.groupBy(*by).agg(F.sum("tokens").alias("all_words"), F.sum("pairs").alias("all_pairs"))
        joined = joined.join(total, keys) if by else joined.join(F.broadcast(total), how="cross")
        share = F.col("n") / F.col("all_pairs")
        pmi = F.log(share / (F.col("ca") / F.col("all_words") * F.col("cb") / F.col("all_words")))
        raw = F.try_divide(100 * pmi, -F.log(share))
        scored = joined.select(*by, shown(F.col("a")).alias("a"), shown(F.col("b")).alias("b"), "n", pmi.alias("pmi"), raw.alias("raw")).where((F.col("pmi") >= LEAST_PMI) & F.col("raw").isNotNull())
        return _top(scored, k, by, F.desc(F.round("raw", 9)), F.col("a"), F.col("b")).select(*by, "a", "b", "n", half_up(F.col("raw"), 1).alias("score"))

    def trends(self, recent: Column, past: Column, k: int, by: Sequence[str] = ()) -> DataFrame:
        """term, g2, trend, recent_count, historical_count, is_new: terms more frequent on the recent days than on the past ones.

        By the log-likelihood ratio of weighted counts, in one aggregation over both windows; of each group `by`.
        """
        both = self.where(recent | past)
        sums = lambda value: (F.sum(F.when(recent, F.col(value))), F.sum(F.when(past, F.col(value))))
        now, then = sums("heavy")
        counts = both.rows.where("b is null").groupBy(*by, "a").agg(F.coalesce(now, F.lit(0.0)).alias("o11"), F.coalesce(then, F.lit(0.0)).alias("o21")).where("o11 > 0")
        r, h = (F.greatest(x, F.lit(LEAST_WEIGHT)) for x in sums("weight"))
        there = [F.count(F.when(x, 1)) > 0 for x in (recent, past)]
        # Without items on either side there is nothing to compare.
        counts = both._with(counts, by, r.alias("r"), h.alias("h"), (there[0] & there[1]).alias("compared")).where("compared")
        o11, o21, r, h = (F.col(x) for x in ("o11", "o21", "r", "h"))
        n, col1 = r + h, o11 + o21
        g2 = 2 * (_cell(o11, r * col1 / n) + _cell(r - o11, r * (n - col1) / n) + _cell(o21, h * col1 / n) + _cell(h - o21, h * (n - col1) / n))
        is_new = o21 / h < 1e-9
        trend = F.when(is_new, 999.0).otherwise(F.least(F.lit(999.0), half_up(F.when(o21 > 0, (o11 / r) / (o21 / h)), 1)))
        scored = counts.where(o11 / r > o21 / h).select(*by, shown(F.col("a")).alias("term"), g2.alias("raw"), trend.alias("trend"), half_up(o11, 2).alias("recent_count"), half_up(o21, 2).alias("historical_count"), is_new.alias("is_new"))
        top = _top(scored.where(F.col("raw") >= LEAST_G2), k, by, F.desc(F.round("raw", 9)), F.col("term"))
        return top.select(*by, "term", half_up(F.col("raw"), 1).alias("g2"), "trend", "recent_count", "historical_count", "is_new")


def _cell(o: Column, e: Column) -> Column:
    return F.when((o > 0) & (e > 0), o * F.log(o / e)).otherwise(0.0)


def tfidf(tokened: DataFrame, top_k: int) -> DataFrame:
    return Terms.of(tokened).words(top_k)


def npmi(tokened: DataFrame, top_k: int) -> DataFrame:
    return Terms.of(tokened, phrases=True).phrases(top_k)


def trending(tokened: DataFrame, recent: Column, past: Column, top_k: int) -> DataFrame:
    return Terms.of(tokened).trends(recent, past, top_k)


def keyword_counts(tokened: DataFrame, top_k: int) -> DataFrame:
    """term, n: plain counts over title and description."""
    rows = tokened.select(F.explode_outer(F.concat("title_tokens", "desc_tokens")).alias("term")).where(F.col("term").isNotNull())
    return rows.groupBy("term").agg(F.count("*").alias("n")).select(shown(F.col("term")).alias("term"), "n").orderBy(F.desc("n"), "term").limit(top_k)


def tag_degree(items: DataFrame, rules=TAG_RULES, default: str = DEFAULT_TAG, top_k: int = 20) -> DataFrame:
    """tag, degree: how many other tags stand beside it, over all items with two tags or more."""
    tags = items.select(F.array_distinct(F.transform(infer_tags(F.concat_ws(" ", "title", "desc"), rules, default), F.lower)).alias("tags"))
    # Items with one tag are left out of the sums, not before, where the tags would be worked out once more to tell.
    rows = tags.select(F.explode_outer("tags").alias("tag"), (F.size("tags") - 1).alias("others"))
    sums = rows.groupBy("tag").agg(F.sum(F.when(F.col("others") > 0, F.col("others"))).alias("degree")).where(F.col("degree").isNotNull())
    return sums.orderBy(F.desc("degree"), "tag").limit(top_k)


def high_value(words: Column, anchors: list[str], stems: str = STEMS) -> Column:
    """Whether one of the tokens is an anchor or has the shape of a stem."""
    return F.exists(words, lambda t: t.isin(list(anchors)) | t.rlike(stems))


def term_tokens(term: Column, stop=(), concepts=None, lexicon=()) -> Column:
    """A term's first two tokens, as evidence is looked up by them."""
    return F.slice(tokens(term, stop, concepts, lexicon), 1, 2)


def nominations(found: Terms, recent: Column, past: Column, anchors: list[str], stems: str = STEMS, spelled=term_tokens, trends: int = TRENDS, words: int = WORDS, phrases: int = PHRASES) -> DataFrame:
    """What each type of item nominates, terms of high value only.

    term, key (its tokens), kind (token or phrase), type, strength, and trend, recent and hist where it is on the rise,
    else 1, 0 and 0. `spelled` gives a term's tokens.
    It is worked out at once, as cards read it several times: at most TRENDS + WORDS + PHRASES rows a kind.
    """
    kinds, by = F.col("type").isin(*KINDS), ["type"]
    of = found.where(kinds)
    now = of.where(recent)
    row = lambda kind, strength, *more: ("type", "term", F.lit(kind).alias("kind"), strength.alias("strength"), *more)
    rising = of.trends(recent, past, trends, by).select(*row("token", F.col("g2"), "trend", F.col("recent_count").alias("recent"), F.col("historical_count").alias("hist")))
    common = now.words(words, by).select(*row("token", F.col("score")))
    paired = now.phrases(phrases, by).withColumn("term", F.concat_ws(" ", "a", "b")).select(*row("phrase", F.col("score")))
    every = rising.unionByName(common, allowMissingColumns=True).unionByName(paired, allowMissingColumns=True)
    every = every.withColumn("tokens", spelled(F.col("term"))).where(high_value(F.col("tokens"), anchors, stems)).withColumn("key", F.concat_ws(" ", "tokens"))
    signal = lambda name, default: F.coalesce(F.max(name), F.lit(default)).alias(name)
    one = every.groupBy("term", "key", "type").agg(F.min("kind").alias("kind"), F.max("strength").alias("strength"), signal("trend", 1.0), signal("recent", 0.0), signal("hist", 0.0))
    return one.sparkSession.createDataFrame(one.collect(), one.schema)


def topic_rank(nominated: DataFrame, top_k: int) -> DataFrame:
    """term, key, kind, score: 1.8 paper + 1.2 repo + 0.8 news, and a bonus for terms that several types nominate."""
    of = lambda kind: F.coalesce(F.max(F.when(F.col("type") == kind, F.col("strength"))), F.lit(0.0))
    wide = nominated.groupBy("term", "key").agg(F.min("kind").alias("kind"), of("paper").alias("paper"), of("repo").alias("repo"), of("news").alias("news"))
    p, r, n = (F.col(x) > 0 for x in ("paper", "repo", "news"))
    bonus = F.when(p & r, 80).otherwise(0) + F.when(p & n, 35).otherwise(0) + F.when(r & n, 20).otherwise(0) + F.when(p & r & n, 25).otherwise(0)
    score = 1.8 * F.col("paper") + 1.2 * F.col("repo") + 0.8 * F.col("news") + bonus
    ranked = wide.withColumn("raw", score).orderBy(F.desc(F.round("raw", 9)), "term").limit(top_k)
    return ranked.select("term", "key", "kind", half_up(F.col("raw"), 1).alias("score"), "raw")


def topic_evidence(ranked: DataFrame, tokened: DataFrame, each: int) -> DataFrame:
    """key, type, id: each term's hottest items of every type that hold it as a token or as neighbouring tokens.

    `ranked` has a few rows (it is a top list), which are worked out at once. Items are tested for its keys, as words
    of a text with one space between two tokens; no other word of theirs becomes a row.
    """
    keys = sorted(r[0] for r in ranked.select("key").distinct().collect() if r[0])
    listed = F.array(*map(F.lit, keys)).cast("array<string>")
    text = F.concat(F.lit(" "), F.array_join(_sequence(), " "), F.lit(" "))
    found = once(text, lambda x: F.filter(listed, lambda k: F.contains(x, F.concat(F.lit(" "), k, F.lit(" ")))))
    held = tokened.where(F.col("type").isin(*KINDS)).select("id", "type", "heat", "event_date", F.explode_outer(found).alias("key")).where(F.col("key").isNotNull())
    order = Window.partitionBy("key", "type").orderBy(F.desc("heat"), F.desc("event_date"), "id")
    return held.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("key", "type", "id")


def topic_cards(nominated: DataFrame, recent: DataFrame, top_k: int, each: int = 3) -> DataFrame:
    """place, term, kind, score, type, g2, trend, recent, hist, id: the best terms with evidence and each type's items that bear them out.

    g2, trend, recent and hist are the signals of the type; where it did not nominate the term they are 0, 1, 0 and 0.
    Only the first 3 x top_k terms are looked up; those that no item holds are dropped.
    """
    ranked = topic_rank(nominated, 3 * top_k)
    found = topic_evidence(ranked, recent, each)
    held = ranked.join(F.broadcast(found.select("key").distinct()), "key", "left_semi").orderBy(F.desc(F.round("raw", 9)), "term").limit(top_k)
    placed = held.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("raw", 9)), "term")))
    signals = nominated.select("term", "type", half_up(F.col("strength"), 2).alias("g2"), half_up(F.col("trend"), 2).alias("trend"), half_up(F.col("recent"), 2).alias("recent"), half_up(F.col("hist"), 2).alias("hist"))
    rows = placed.join(found, "key").join(signals, ["term", "type"], "left")
    none = lambda name, value: F.coalesce(name, F.lit(value)).alias(name)
    return rows.select("place", "term", "kind", "score", "type", none("g2", 0.0), none("trend", 1.0), none("recent", 0.0), none("hist", 0.0), "id")
