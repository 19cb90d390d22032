"""Nested conversations: flattening, mapping of their texts, and rebuilding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("user", "assistant")


def flatten(df: DataFrame, key: str, turns: str = "texts", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """key, turn_idx, field, text: every text that is not null or empty; blank ones stay.

    Null and empty conversations and null turns give no rows. Turns count from 0.
    """
    exploded = df.select(F.col(key).alias("_key"), F.posexplode(turns).alias("turn_idx", "turn"))
    texts = F.array(*(F.struct(F.lit(f).alias("field"), F.col("turn")[f].alias("text")) for f in fields))
    return exploded.select(F.col("_key").alias(key), "turn_idx", F.explode(texts).alias("x")).select(key, "turn_idx", "x.field", "x.text").where(F.coalesce("text", F.lit("")) != "")


def map_texts(df: DataFrame, make: Callable[[Column], Column], turns: str = "texts", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """`df` with `make`, a column expression, applied to every text of its turns that is not null or
    empty; all else keeps its value, its order and its place. Stays in one stage."""

    def turn(t: Column) -> Column:
        for f in fields:
            t = t.withField(f, F.when(t[f] != "", make(t[f])).otherwise(t[f]))
        return t

    return df.withColumn(turns, F.transform(turns, lambda t: F.when(t.isNotNull(), turn(t))))


def map_texts_batched(df: DataFrame, make: Callable[[list[str]], list[str]], batch: int = 256, turns: str = "texts", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Like map_texts, with a function from texts to as many texts, as a translation model is one.

    Texts of an Arrow batch are laid end to end, mapped `batch` at a time and put
    back by position; `make` is created once for a worker if it has a `load`
    method. A function that gives another number of texts raises.
    """
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make.load() if hasattr(make, "load") else make
        for b in batches:
            at = b.schema.get_field_index(turns)
            rows = b.column(at).to_pylist()
            places = [(t, f) for row in rows for t in row or [] if t for f in fields if t[f]]
            texts = [t[f] for t, f in places]
            mapped: list[str] = []
            for low in range(0, len(texts), batch):
                part = call(texts[low : low + batch])
                if len(part) != len(texts[low : low + batch]):
                    raise ValueError("the function must give one text for each text")
                mapped += part
            for (t, f), text in zip(places, mapped):
                t[f] = text
            columns = [pa.array(rows, b.schema.field(i).type) if i == at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return df.mapInArrow(run, schema)


def rebuild(flat: DataFrame, df: DataFrame, key: str, turns: str = "texts", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """`df` with the texts of `flat` (key, turn_idx, field, text) back in their places.

    For texts that were changed elsewhere, after `flatten`. Texts that `flat` lacks
    keep their value; keys must be unique in `df`, or each copy gets the same texts.
    """
    held = flat.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", F.col("turn_idx").cast("string"), "field"), F.col("text")))).alias("_new"))

    def turn(t: Column, i: Column) -> Column:
        for f in fields:
            new = F.try_element_at(F.col("_new"), F.concat(i.cast("string"), F.lit(f"/{f}")))
            t = t.withField(f, F.coalesce(new, t[f]))
        return t

    made = F.transform(turns, lambda t, i: F.when(t.isNotNull(), turn(t, i)))
    return df.join(held, key, "left").withColumn(turns, F.when(F.col("_new").isNull(), F.col(turns)).otherwise(made)).select(*df.columns)


def published(df: DataFrame, make: Callable[[Column], Column], images: str = "images", turns: str = "texts") -> DataFrame:
    """The published record: images, mapped texts, and the original texts as `texts_en`."""
    return map_texts(df.withColumn(f"{turns}_en", F.col(turns)), make, turns).select(images, turns, f"{turns}_en")
