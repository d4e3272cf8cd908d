"""Joins that stay even where one key holds a great part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this part of the rows, and more than LEAST of them. By
#: that definition there are fewer than PARTS hot keys, whatever the size of the tables.
PARTS, LEAST = 1000, 128


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], held: str, total: int) -> DataFrame:
    """The inner join of `rows` with `table`, whose keys are unique and not null, and whose
    column `held` counts the rows of each key, out of `total` at least. The few hot keys of
    `table` are broadcast, so their rows stay where they are; all others are shuffled."""
    hot = F.col(held) > max(LEAST, total // PARTS)
    some = F.broadcast(table.where(hot))
    names = some.select(*(F.col(k).alias(f"__{k}") for k in keys))
    equal = reduce(Column.__and__, (rows[k] == names[f"__{k}"] for k in keys))
    rest = rows.join(F.broadcast(names), equal, "left_anti")
    return rows.join(some, keys).unionByName(rest.join(table.where(~hot), keys))
