"""Chat rows for fine-tuning from documents with images and question-answer turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinwell.functions.texts import stripped_or_empty
from thinwell.operators.images import Codec, with_decodable

MAX_QA, MAX_IMAGES = 4, 8
SIGNATURES = ("89504E470D0A1A0A", "5035")


def first_element(values: Column) -> Column:
    """First element of a list; null for a null or empty one."""
    return F.get(values, F.lit(0))


def looks_like_image(image: Column) -> Column:
    """Whether the bytes begin as a PNG or a binary PGM; never null. Cheaper than decoding, but a broken file passes."""
    head = F.hex(F.substring(image["bytes"], 1, 8))
    return F.coalesce(head.startswith(SIGNATURES[0]) | head.startswith(SIGNATURES[1]), F.lit(False))


def valid_pairs(turns: Column) -> Column:
    """Turns as (question, answer), stripped, where neither side is null or blank; null turns are left out."""
    pairs = F.transform(turns, lambda t: F.struct(stripped_or_empty(t["user"]).alias("question"), stripped_or_empty(t["assistant"]).alias("answer")))
    return F.filter(pairs, lambda p: (p["question"] != "") & (p["answer"] != ""))


def chunks(values: Column, size: int) -> Column:
    """Consecutive slices of at most `size` elements; none for an empty or null list."""
    if size < 1:
        raise ValueError("a chunk holds at least one element")
    count = F.ceil(F.size(values) / size).cast("int")
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(values, i * size + 1, F.lit(size)))).otherwise(F.array())


def messages(chunk: Column, images: Column) -> Column:
    """A chunk of pairs as alternating user and assistant messages; the first one is led by a marker for each of the `images` (a number)."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    none = F.lit(None).cast("string")

    def turn(p: Column, i: Column) -> Column:
        question = F.array(part("text", p["question"]))
        asked = F.when(i == 0, F.concat(F.array_repeat(part("image", none), images), question)).otherwise(question)
        message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
        return F.array(message("user", asked), message("assistant", F.array(part("text", p["answer"]))))

    return F.flatten(F.transform(chunk, turn))


def qa_chunks(docs: DataFrame, key: str, max_qa: int = MAX_QA, max_images: int = MAX_IMAGES, valid: Callable[[Column], Column] | None = None, codec: Codec | None = None) -> DataFrame:
    """key, chunk, pairs, images: up to `max_qa` valid pairs a row, and the document's valid images.

    Images are cut to `max_images` before they are judged, by decoding them (with `codec`, where it is
    given, for formats beyond PNG and PNM) or by `valid`, an expression, where that is given. Documents without a
    valid image or pair, and null lists, give no rows.
    """
    source = docs.select(F.col(key), F.slice("images", 1, max_images).alias("images"), valid_pairs(F.col("texts")).alias("pairs")).where((F.size("images") > 0) & (F.size("pairs") > 0))
    if valid is not None:
        made = source.withColumn("images", F.filter("images", lambda i: i.isNotNull() & valid(i)))
    else:
        judged = with_decodable(source, "images", max_images, "_decodes", codec)
        made = judged.withColumn("images", F.transform(F.filter(F.arrays_zip(F.col("images").alias("image"), F.col("_decodes").alias("ok")), lambda x: x["ok"]), lambda x: x["image"]))
    return made.where(F.size("images") > 0).select(key, F.posexplode(chunks(F.col("pairs"), max_qa)).alias("chunk", "pairs"), "images")


def chat_rows(docs: DataFrame, key: str, max_qa: int = MAX_QA, max_images: int = MAX_IMAGES, valid: Callable[[Column], Column] | None = None, codec: Codec | None = None) -> DataFrame:
    """key, chunk, messages, images of every chunk; each chunk repeats the document's images."""
    rows = qa_chunks(docs, key, max_qa, max_images, valid, codec)
    return rows.select(key, "chunk", messages(F.col("pairs"), F.size("images")).alias("messages"), "images")


def first_chunks(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The first `limit` emitted rows in the order of key and chunk; a limit under 1 gives none."""
    return rows.orderBy(key, "chunk").limit(max(0, limit))


def training_steps(rows: int, batch: int, accumulate: int = 1, devices: int = 1, epochs: int = 1) -> int:
    """Optimiser steps of `epochs` passes over `rows`, the last batch of each counted whole."""
    return -(-rows // (batch * accumulate * devices)) * epochs
