"""The weekly digest: its key, the material for a writer, and the text kept for each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Links of a key, its digits; items of the material; characters of title, venue and text; least length of a written text.
LINKS, DIGITS, ITEMS, TITLE, VENUE, TEXT, LEAST = 56, 24, 32, 220, 80, 180, 80


def week_of(day: Column) -> Column:
    """ISO year and week, as 2024-W05."""
    return F.concat(F.date_part(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def fingerprint(items: DataFrame, as_of: str) -> DataFrame:
    """One row, fingerprint: the week and a hash of the first distinct links in alphabetical order."""
    links = items.select(F.trim("link").alias("link")).where(F.length("link") > 0).distinct().orderBy("link").limit(LINKS)
    joined = links.agg(F.array_join(F.array_sort(F.collect_list("link")), "\n").alias("links"))
    return joined.select(F.concat_ws(":", week_of(F.lit(as_of).cast("date")), F.substring(F.md5("links"), 1, DIGITS)).alias("fingerprint"))


def _cut(c: str, most: int) -> Column:
    return F.substring(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), 1, most)


def material(items: DataFrame, most: int = ITEMS) -> DataFrame:
    """number and line of the first items of a feed (by heat, date and id), as a writer gets them."""
    first = items.orderBy(F.desc("heat"), F.desc("event_date"), "id").limit(most)
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy().orderBy(F.desc("heat"), F.desc("event_date"), "id")))
    line = F.concat(
        F.col("number").cast("string"), F.lit(". ["), F.coalesce("type", F.lit("?")), F.lit("] "), _cut("title", TITLE),
        F.lit("\n   source: "), _cut("venue", VENUE), F.lit(" | date: "), F.coalesce(F.col("event_date").cast("string"), F.lit("")), F.lit("\n   text: "), _cut("desc", TEXT),
    )
    return numbered.select("number", line.alias("line"))


def digest(items: DataFrame, kept: DataFrame, as_of: str, writer: Callable[[str], str] | None = None) -> DataFrame:
    """One row: fingerprint, text, written (whether the writer made it) and cached (whether `kept` held the key already).

    `kept` has fingerprint, text and written. A text of LEAST characters or fewer is not taken; without a writer, or
    if it fails, the text says how many items there are. Append the row to `kept` where it is not cached.
    """
    key, count = fingerprint(items, as_of), items.agg(F.count("*").alias("items"))
    whole = material(items).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n").alias("material"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for text in batch["material"]:
                try:
                    made.append(writer(text) if writer else None)
                except Exception:
                    made.append(None)
            yield batch[["material"]].assign(made=pd.Series(made, dtype=object))

    made = whole.mapInPandas(write, "material string, made string") if writer else whole.withColumn("made", F.lit(None).cast("string"))
    # Of all that was ever kept only this key's row is of use.
    known = kept.join(F.broadcast(key), "fingerprint", "left_semi").withColumnsRenamed({"text": "old", "written": "old_written"})
    one = key.join(F.broadcast(count), how="cross").join(F.broadcast(made), how="cross").join(known, "fingerprint", "left")
    good = F.coalesce(F.length(F.trim("made")) > LEAST, F.lit(False))
    text = F.coalesce("old", F.when(good, F.col("made")), F.concat(F.lit("Items: "), F.col("items").cast("string"), F.lit(". No writer is configured.")))
    return one.where("items > 0").select("fingerprint", text.alias("text"), F.coalesce("old_written", good).alias("written"), F.col("old").isNotNull().alias("cached"))
