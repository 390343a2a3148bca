"""Long lists of forms looked for in texts by a join.

A form can only begin where a text's run of word characters begins, or at another character that is no white space.
Every such place gives a row: the text from there on, as far as the longest form reaches. Rows meet the forms that
begin with the same run, and those forms that the row starts with, and that end at an edge, are found. The plan does
not grow with the list: it is a table that is broadcast within a bound of its size and shuffled beyond that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import W

#: Bytes of forms that are broadcast.
BROADCAST = 8 << 20
_FIRST = rf"^(?:{W}+|(?s:.))"


def _starts(low: Column, most: int, inside: bool = False) -> Column:
    """The text from each place on where a form can begin; with `inside` from those places that a word character precedes, too."""
    if not inside:
        return F.regexp_extract_all(low, F.lit(rf"(?s)(?<!{W})(?=(\S.{{0,{most}}}))"), F.lit(1))
    return F.regexp_extract_all(low, F.lit(rf"(?s)(?<={W})(?=([^\s\p{{L}}\p{{N}}_].{{0,{most}}}))"), F.lit(1))


def matched(rows: DataFrame, text: Column, forms: Sequence[tuple[int, str]], edges: bool = False, most_bytes: int = BROADCAST) -> DataFrame:
    """The rows' columns with `number` of every form that stands in the text, once for each place where it does.

    Case does not count; forms are literal, whatever they hold, and blank ones are left out, as are texts that are null.
    A form stands where no word character touches it on either side. With `edges` an end of a form that is no word
    character must touch one instead, as a pattern's word edges have it.
    """
    kept = [(n, f.strip()) for n, f in forms if f.strip()]
    spark, most = rows.sparkSession, max((len(f) for _, f in kept), default=0) + 8
    table = spark.createDataFrame(kept, "number int, _form string").select("number", F.lower("_form").alias("_form"))
    word = lambda c: c.rlike(f"^{W}$")
    table = table.select("number", "_form", F.regexp_extract("_form", _FIRST, 0).alias("_key"), F.length("_form").alias("_size"), word(F.substring("_form", 1, 1)).alias("_opens"), word(F.substring("_form", -1, 1)).alias("_closes"))
    held = rows.withColumn("_low", F.lower(text))
    # Outer, as else the optimiser looks for the places once more to tell texts without any.
    found = held.withColumns({"_at": F.explode_outer(_starts(F.col("_low"), most)), "_inside": F.lit(False)})
    if edges and any(not (f[0].isalnum() or f[0] == "_") for _, f in kept):
        found = found.unionByName(held.withColumns({"_at": F.explode_outer(_starts(F.col("_low"), most, True)), "_inside": F.lit(True)}))
    found = found.drop("_low").withColumn("_first", F.regexp_extract("_at", _FIRST, 0))
    if sum(len(f) + 64 for _, f in kept) <= most_bytes:
        table = F.broadcast(table)
    after = F.substr("_at", F.col("_size") + 1, F.lit(1))
    touches = F.when(F.length(after) > 0, word(after)).otherwise(False)
    ends = (touches != F.col("_closes")) if edges else ~touches
    begins = (F.col("_inside") != F.col("_opens")) if edges else F.lit(True)
    return found.join(table, (F.col("_first") == F.col("_key")) & F.startswith("_at", "_form") & begins & ends).select(*rows.columns, "number")
