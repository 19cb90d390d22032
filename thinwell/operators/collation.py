"""Token rows for training: label masks, markers, padding, over-long rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100


def _openings(flat: np.ndarray, ends: np.ndarray, marker: list[int], end: int) -> np.ndarray:
    """Positions just behind each `marker` that opens a span, in rows that lie end to end; none behind the last id of a row."""
    width = len(marker)
    if not width or len(flat) < width:
        return np.zeros(0, np.int64)
    found = np.lib.stride_tricks.sliding_window_view(flat, width) == np.array(marker)
    at = np.nonzero(found.all(axis=1))[0]
    row_end = ends[np.searchsorted(ends, at, "right")]
    at, row_end = at[at + width < row_end], row_end[at + width < row_end]
    if end not in marker:
        return at + width
    # Only a marker that holds the end can begin inside a span and outlast it: it opens nothing.
    closes = np.r_[np.nonzero(flat == end)[0], len(flat)]
    last = np.minimum(closes[np.searchsorted(closes, at + width)], row_end - 1)
    kept, free = [], 0
    for start, close in zip(at.tolist(), last.tolist()):
        if start >= free:
            kept.append(start + width)
            free = close + 1
    return np.array(kept, np.int64)


def label_masks(flat: np.ndarray, ends: np.ndarray, marker: list[int], end: int) -> np.ndarray:
    """Labels of rows that lie end to end: -100, but behind each `marker` the ids up to and with the next `end`, or to the row's end.

    A span is open from a marker's end to the first `end` behind it, so every id between the
    last such opening and the last closing before it is kept: both are running maxima of positions. A marker that
    begins inside an open span opens nothing new; an empty marker masks everything.
    """
    place = np.arange(len(flat))
    row_start = np.r_[0, ends[:-1]][np.searchsorted(ends, place, "right")] if len(flat) else place
    opened = np.full(len(flat), -1)
    behind = _openings(flat, ends, marker, end)
    opened[behind] = behind
    opened = np.maximum.accumulate(opened) if len(flat) else opened
    # An id ends its span; it counts from the position behind it.
    closed = np.full(len(flat) + 1, -1)
    closes = np.nonzero(flat == end)[0]
    closed[closes + 1] = closes + 1
    closed = np.maximum.accumulate(closed)[: len(flat)]
    # Open where an opening of this row lies at or behind the last close.
    kept = (opened >= row_start) & (opened >= np.maximum(closed, 0)) if len(flat) else np.zeros(0, bool)
    return np.where(kept, flat, IGNORED)


def _masked(lists: pa.ListArray, marker: list[int], end: int) -> pa.Array:
    """Labels of a column of ids; null for a null row."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    flat = lists.flatten().fill_null(IGNORED).to_numpy(zero_copy_only=False).astype(np.int64)
    made = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(label_masks(flat, ends, marker, end), pa.int64()))
    return pc.if_else(lists.is_valid(), made, pa.scalar(None, made.type)) if lists.null_count else made


def label_mask(ids: list[int], marker: list[int], end: int) -> list[int]:
    """label_masks of one row."""
    return label_masks(np.array(ids, np.int64), np.array([len(ids)]), marker, end).tolist()


def masked_labels(df: DataFrame, marker: list[int], end: int, ids: str = "input_ids", name: str = "labels") -> DataFrame:
    """`df` with the column `name` of label_masks, a batch at a time; null ids give null labels."""
    schema = df.drop(name).withColumn(name, F.lit(None).cast("array<bigint>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _masked(b.column(b.schema.get_field_index(ids)), marker, end)], [*b.schema.names, name])

    return df.drop(name).mapInArrow(run, schema)


def padded(ids: Column, length: Column, fill: int) -> Column:
    """`ids` filled up at the right to `length`; longer ones stay, null counts as empty."""
    held = F.coalesce(ids, F.array().cast("array<bigint>"))
    return F.concat(held, F.array_repeat(F.lit(fill).cast("bigint"), F.greatest(length - F.size(held), F.lit(0))))


def pad_batches(df: DataFrame, batch: str, pad: int, ids: str = "input_ids", labels: str | None = "labels") -> DataFrame:
    """`df` with ids, attention_mask and labels filled up to the longest row of the row's batch."""
    length = F.max(F.size(F.coalesce(ids, F.array()))).over(Window.partitionBy(batch))
    df = df.withColumn("_length", length).withColumn("attention_mask", padded(F.transform(ids, lambda _: F.lit(1).cast("bigint")), F.col("_length"), 0))
    df = df.withColumn(ids, padded(F.col(ids), F.col("_length"), pad))
    if labels is not None:
        df = df.withColumn(labels, padded(F.col(labels), F.col("_length"), IGNORED))
    return df.drop("_length")


def fixed_length(ids: Column, length: int, pad: int) -> Column:
    """`ids` cut or filled up to exactly `length`."""
    return padded(F.slice(ids, 1, length), F.lit(length), pad)


def with_visual_token(ids: Column, mask: Column, pad: int) -> tuple[Column, Column]:
    """Attention mask and labels of a row that a visual token leads: mask 1, label -100, and -100 for every padding id.

    Where padding and end share an id, genuine ends are masked too.
    """
    one, ignored = F.array(F.lit(1).cast("bigint")), F.array(F.lit(IGNORED).cast("bigint"))
    labels = F.transform(ids, lambda x: F.when(x == pad, F.lit(IGNORED).cast("bigint")).otherwise(x))
    return F.concat(one, mask), F.concat(ignored, labels)


def drop_markers(messages: list[dict], total: int) -> list[dict]:
    """Messages with only the first `total` image markers; other parts and the messages stay."""
    parts = [(i, part) for i, m in enumerate(messages) for part in m["content"] or []]
    before = accumulate((part["type"] == "image" for _, part in parts), initial=0)
    kept = [(i, part) for (i, part), n in zip(parts, before) if part["type"] != "image" or n < total]
    return [{**m, "content": [part for j, part in kept if j == i]} for i, m in enumerate(messages)]


def collate(rows: DataFrame, encode: Callable[[list[dict], int], list[int]], marker: list[int], end: int, most: int = 4096, messages: str = "messages", images: str = "images") -> DataFrame:
    """`rows` with images (their number after dropping), input_ids and labels.

    `encode` turns messages and a number of images into ids, as a chat template with a
    tokenizer does. While a row is longer than `most` and has images, its last image
    and that image's marker are dropped and it is encoded again; ids are never cut.
    """
    keep = [c for c in rows.columns if c not in (messages, images)]
    source = rows.select(*keep, messages, F.size(F.coalesce(images, F.array())).alias("_n"))
    schema = rows.select(*keep).withColumn("images", F.lit(0)).withColumn("input_ids", F.lit(None).cast("array<bigint>")).withColumn("labels", F.lit(None).cast("array<bigint>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, tokens = [], []
            for talk, n in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist()):
                talk = talk or []
                ids = encode(talk, n)
                while len(ids) > most and n:
                    n -= 1
                    talk = drop_markers(talk, n)
                    ids = encode(talk, n)
                counts.append(n)
                tokens.append(ids)
            big = pa.list_(pa.int64())
            made = pa.array(tokens, big)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(counts, pa.int32()), made, _masked(made, marker, end)], [*keep, "images", "input_ids", "labels"])

    return source.mapInArrow(run, schema)
