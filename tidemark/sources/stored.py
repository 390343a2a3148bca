"""A feed kept by day: items, their tokens, and mergeable sums of their terms.

Every table is partitioned by event_date, so that a window reads its days alone. An item's weight decays alike on all
items of a day: the sums are kept at the weight of the day itself and rescaled for any later day, and a window's words,
phrases and trends are a roll-up of its days. A day that is put again replaces its own partitions and nothing else.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scores import UNDATED_WEIGHT, WEIGHT_DAYS, age, item_weight
from tidemark.operators import terms
from tidemark.streaming.feed import _folder, remove

_TOKENS = "id long, type string, heat int, title_tokens array<string>, desc_tokens array<string>, event_date date"
_TERMS = "type string, a string, b string, n long, items long, mass double, heavy double, event_date date"
_TOTALS = "type string, items long, weight double, tokens long, pairs long, event_date date"


@dataclass
class Stored:
    """Tables under a folder: items, tokens, terms and totals. The lexicons must stay the same for all days."""

    spark: SparkSession
    folder: str
    stop: Sequence[str] = ()
    concepts: Mapping[str, str] = field(default_factory=dict)
    compounds: Sequence[tuple[str, str]] = ()

    @staticmethod
    def scratch(spark: SparkSession, items: DataFrame, stop=(), concepts=None, compounds=()) -> Stored:
        """Tokens of these items in a new folder of the shared ones; the items are read once, and their days are not dealt to partitions."""
        made = Stored(spark, _folder(spark, "terms"), stop, concepts or {}, compounds)
        made._tokenized(items).write.parquet(f"{made.folder}/tokens")
        return made

    def by_day(self) -> Stored:
        """With sums of every day's words, as `put` keeps them, of all tokens that are there; `terms` reads them."""
        rows, totals = self._sums(self.tokens(), False)
        rows.write.parquet(f"{self.folder}/terms")
        totals.write.parquet(f"{self.folder}/totals")
        return self

    def by_window(self, as_of: str, recent: Column, past: Column) -> terms.Terms:
        """Sums of both windows' words and of the recent one's phrases at the weights of a day, written down: the tokens are taken apart once."""
        found = terms.Terms.of(self.weighed(as_of).where(recent | past), phrases=recent).summed(recent, past, phrases=recent)
        kept = []
        for name, rows in (("rows", found.rows), ("totals", found.totals)):
            rows.write.parquet(f"{self.folder}/windows/{name}")
            kept.append(self.spark.read.schema(rows.schema).parquet(f"{self.folder}/windows/{name}"))
        return terms.Terms(*kept)

    def _tokenized(self, items: DataFrame) -> DataFrame:
        found = terms.tokenized(items, "2000-01-01", self.stop, self.concepts, self.compounds)
        return found.select("id", "type", "heat", "title_tokens", "desc_tokens", "event_date")

    def _write(self, rows: DataFrame, name: str, *order: str) -> None:
        # A day is in as few files as its size allows; one that is hot is split.
        rows.hint("rebalance", "event_date").sortWithinPartitions("event_date", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(f"{self.folder}/{name}")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def put(self, items: DataFrame, whole: bool = True, phrases: bool = True) -> None:
        """Replaces the days that the items have by these items; with `whole` keeps the items as well, with `phrases` sums of neighbours.

        Items have id, type, title, desc, heat and event_date; undated ones are a day of their own.
        """
        if whole:
            self._write(items, "items", "type")
        self._write(self._tokenized(items), "tokens", "type")
        # One row for each day that was put.
        days = [r[0] for r in items.select("event_date").distinct().collect()] if whole else None
        rows, totals = self._sums(self.tokens() if days is None else self.tokens().where(_among(days)), phrases)
        self._write(rows, "terms", "type", "a")
        self._write(totals, "totals")

    @staticmethod
    def _sums(kept: DataFrame, phrases: bool) -> tuple[DataFrame, DataFrame]:
        """Of every day and type, at the weights of the day itself."""
        day = "2000-01-01"
        fresh = item_weight(F.col("heat"), F.lit(day).cast("date"), F.col("type"), day)
        found = terms.Terms.of(kept.withColumn("weight", fresh), phrases)
        sums = found.rows.groupBy("event_date", "type", "a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "items", "mass", "heavy")))
        totals = found.totals.groupBy("event_date", "type").agg(*(F.sum(c).alias(c) for c in ("items", "weight", "tokens", "pairs")))
        return sums.select("type", "a", "b", "n", "items", "mass", "heavy", "event_date"), totals.select("type", "items", "weight", "tokens", "pairs", "event_date")

    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/items")

    def tokens(self) -> DataFrame:
        return self._read("tokens", _TOKENS)

    def weighed(self, as_of: str) -> DataFrame:
        """The tokens with their items' weights on a day, for sums that are not kept."""
        return self.tokens().withColumn("weight", item_weight(F.col("heat"), F.col("event_date"), F.col("type"), as_of))

    def terms(self, as_of: str) -> terms.Terms:
        """The sums at the weights of a day.

        Equal to those of the items themselves while no item weighs under a millionth, that is for 160 days; the floor
        that trends give to older ones is not kept.
        """
        decay = F.exp(-age(F.col("event_date"), as_of, UNDATED_WEIGHT) / F.lit(WEIGHT_DAYS))
        rows = self._read("terms", _TERMS).withColumns({"mass": F.col("mass") * decay, "heavy": F.col("heavy") * decay})
        return terms.Terms(rows, self._read("totals", _TOTALS).withColumn("weight", F.col("weight") * decay))

    def spelled(self, term: Column) -> Column:
        return terms.term_tokens(term, self.stop, self.concepts, self.compounds)

    def discard(self) -> None:
        remove(self.spark, self.folder)


def _among(days: list) -> Column:
    """event_date is one of the days, a missing one included."""
    dated = [F.lit(d).cast("date") for d in days if d is not None]
    found = F.col("event_date").isin(*dated) if dated else F.lit(False)
    return found | F.col("event_date").isNull() if None in days else found
