"""Values of a column that what someone has typed may mean."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import cell

#: Letters of what is typed that count; more find nothing.
MOST_LETTERS = 100


def fuzzy_values(table: DataFrame, column: str, typed: list[str], n: int = 10) -> DataFrame:
    """(typed, value, gaps, rank): of each text that was typed the first `n` different values that hold its letters in order.

    Letters may be apart, and their case does not count.  Values whose letters stand closest together come first, then those in
    which they begin earliest, then shorter ones, then by name.  Blanks that are typed are letters; an empty text finds
    every value.  Null values are none.  One pass over the different values; ranks are limited before they are shuffled.
    """
    for text in typed:
        if len(text) > MOST_LETTERS:
            raise ValueError(f"more than {MOST_LETTERS} letters")
    values = table.select(cell(column).cast("string").alias("value")).where("value is not null").distinct()
    low = F.lower("value")
    # the first place from which all letters follow, and as little as need be from there
    tries = [(t, "(?s)" + ".*?".join(re.escape(c) for c in t.lower())) for t in dict.fromkeys(typed)]
    found = F.array(*[F.when(low.rlike(pattern), F.struct(F.lit(t).alias("typed"), F.regexp_extract(low, pattern, 0).alias("part"))) for t, pattern in tries])
    if not tries:
        found = F.array().cast("array<struct<typed: string, part: string>>")
    rows = values.select("value", F.explode(F.array_compact(found)).alias("f")).select("f.typed", "value", (F.length("f.part") - F.length("f.typed")).alias("gaps"), F.instr(F.lower("value"), F.col("f.part")).alias("at"))
    order = Window.partitionBy("typed").orderBy("gaps", "at", F.length("value"), "value")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("typed", "value", "gaps", "rank")
