"""Fetching selected rows from their source, in order and in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinwell.operators.numbering import batched
from thinwell.sources.session import cut


def selected_rows(source: DataFrame, selected: DataFrame, key: str, selected_key: str = "id") -> DataFrame:
    """The source rows whose key is among the selected ids; null keys match nothing.

    A semi join: Spark broadcasts the ids where they are small and shuffles both
    sides where not. The least and greatest id reach the scan as predicates, so
    row groups without a selected id are not read.
    """
    ids = cut(selected.select(F.col(selected_key).alias(key)).where(F.col(key).isNotNull()).distinct())
    low, high = ids.agg(F.min(key), F.max(key)).first()
    if low is None:
        return source.limit(0)
    return source.where(F.col(key).between(low, high)).join(ids, key, "left_semi")


def ordered_batches(source: DataFrame, selected: DataFrame, key: str, size: int, selected_key: str = "id") -> DataFrame:
    """The selected source rows with their `position` in id order and their `batch` of `size` rows.

    Raises where a selected id is not in the source. Only ids are sorted and
    numbered; the rows are joined to their numbers.
    """
    ids = selected.select(F.col(selected_key).alias(key)).distinct()
    missing = ids.join(source.select(key), key, "left_anti")
    if not missing.isEmpty():
        raise KeyError(f"selected but not in the source: {[r[0] for r in missing.take(5)]}")
    return source.join(batched(ids, size, key), key)


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the first by `order`; aggregated before the shuffle.

    Null keys form one group; of rows that tie in `order` the least one stays.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    row = F.min(F.struct(F.col(order), *(F.col(c) for c in rest))).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*df.columns)
