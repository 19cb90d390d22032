"""Image columns: reading, normalising, scaling, and embedding with a pluggable model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from thinwell.functions.images import encode_png, pixels_of

Codec = Callable[[bytes], "np.ndarray | None"]
MAX_SIDE = 1_120
IMAGE = "struct<bytes: binary, path: string>"


def scaled_size(width: Column, height: Column, most: int = MAX_SIDE) -> tuple[Column, Column]:
    """Width and height under the cap, the aspect kept, fractions cut off; sizes within the cap stay."""
    longest = F.greatest(width, height)
    side = lambda x: F.when(longest > most, (x * (F.lit(float(most)) / longest)).cast("int")).otherwise(x)
    return side(width), side(height)


def scale(pixels: np.ndarray, most: int = MAX_SIDE) -> np.ndarray:
    """Grey or RGB pixels with no side over `most`: means of the source pixels that each target pixel covers."""
    height, width = pixels.shape[:2]
    if max(height, width) <= most:
        return pixels
    factor = most / max(height, width)
    for axis, size in ((0, max(1, int(height * factor))), (1, max(1, int(width * factor)))):
        edges = np.linspace(0, pixels.shape[axis], size + 1)
        sums = np.concatenate([np.zeros_like(np.take(pixels, [0], axis), np.float64), np.cumsum(pixels, axis=axis, dtype=np.float64)], axis)
        low = np.floor(edges).astype(int)
        shape = [-1 if i == axis else 1 for i in range(pixels.ndim)]
        part = np.take(pixels, np.minimum(low, pixels.shape[axis] - 1), axis) * (edges - low).reshape(shape)
        pixels = np.diff(np.take(sums, low, axis) + part, axis=axis) / np.diff(edges).reshape(shape)
    return np.clip(np.rint(pixels), 0, 255).astype(np.uint8)


def as_image(column: Column, kind: DataType) -> Column:
    """An image of any usual type (binary, path, struct with bytes or path) as a struct of both; null for a null one, and
    for a type that holds no image, so that a failed cast costs no row."""
    nothing = F.lit(None)
    if isinstance(kind, BinaryType):
        made = F.struct(column.alias("bytes"), nothing.cast("string").alias("path"))
    elif isinstance(kind, StringType):
        made = F.struct(nothing.cast("binary").alias("bytes"), column.alias("path"))
    elif isinstance(kind, StructType) and {"bytes", "path"} & set(kind.names):
        part = lambda name, to: (column[name] if name in kind.names else nothing).cast(to).alias(name)
        made = F.struct(part("bytes", "binary"), part("path", "string"))
    else:
        return nothing.cast(IMAGE)
    return F.when(column.isNotNull(), made)


def with_images(df: DataFrame, column: str) -> DataFrame:
    """`df` with an image column, or a list of images, cast to structs of bytes and path; see as_image."""
    kind = df.schema[column].dataType
    if isinstance(kind, ArrayType):
        return df.withColumn(column, F.transform(column, lambda i: as_image(i, kind.elementType)))
    return df.withColumn(column, as_image(F.col(column), kind))


def with_files(df: DataFrame, column: str, root: str) -> DataFrame:
    """`df` with the bytes of images that are paths only, read from the shared folder `root` (any file system Spark knows).

    Paths are taken below `root` or in full. Files are joined by their path, read by Spark, and never by an
    executor from its own disk; a path without a file keeps null bytes. URLs are not fetched.
    """
    files = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = lambda path: F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")
    full = bare(F.when(F.col(column)["path"].rlike(r"^([a-z0-9]+:)?/"), F.col(column)["path"]).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(column)["path"])))
    files = files.select(bare(F.col("path")).alias("_path"), F.col("content").alias("_content"))
    asked = F.when(F.col(column)["bytes"].isNull(), full)
    joined = df.withColumn("_asked", asked).join(files, F.col("_asked") == F.col("_path"), "left")
    filled = F.when(F.col(column).isNotNull(), F.struct(F.coalesce(F.col(column)["bytes"], F.col("_content")).alias("bytes"), F.col(column)["path"].alias("path")))
    return joined.withColumn(column, filled).select(*df.columns)


def load(image: bytes | dict | str | None, codec: Codec | None = None) -> np.ndarray | None:
    """Pixels of bytes, of a struct with bytes or a local path, or of a local path; None where there is no readable image.

    URLs are not fetched; for files in shared storage see with_files.
    """
    if isinstance(image, dict):
        image = image.get("bytes") or image.get("path")
    if isinstance(image, str):
        try:
            image = Path(image).read_bytes()
        except OSError:
            return None
    return pixels_of(image, codec)


def normalised(df: DataFrame, column: str, name: str = "png", most: int | None = MAX_SIDE, codec: Codec | None = None) -> DataFrame:
    """`df` with `name`, the image of `column` (binary, struct or path) as PNG bytes, scaled under `most`, colours kept;
    null where it cannot be decoded. No row is dropped, so ids stay aligned."""
    schema = df.drop(name).withColumn(name, F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pixels = [load(x, codec) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            made = [None if p is None else encode_png(p if most is None else scale(p, most)) for p in pixels]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, name])

    return df.drop(name).mapInArrow(run, schema)


def with_decodable(docs: DataFrame, images: str = "images", most: int = 8, name: str = "decodable", codec: Codec | None = None) -> DataFrame:
    """`docs` with `name`, for each of the first `most` images of a document whether it decodes; null for a null list."""
    keep = [c for c in docs.columns if c != name]
    source = docs.select(*keep, F.slice(F.col(images)["bytes"], 1, most).alias(name))
    schema = docs.select(*keep).withColumn(name, F.lit(None).cast("array<boolean>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if row is None else [pixels_of(x, codec) is not None for x in row] for row in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(made, pa.list_(pa.bool_()))], [*keep, name])

    return source.mapInArrow(run, schema)


def valid_images(docs: DataFrame, key: str, images: str = "images", most: int = 8, codec: Codec | None = None) -> DataFrame:
    """key, valid: how many of the first `most` images of a document decode; unread: how many have bytes that do not."""
    checked = with_decodable(docs.select(key, images), images, most, codec=codec)
    unread = F.size(F.filter(F.arrays_zip("decodable", F.slice(F.col(images)["bytes"], 1, most).alias("data")), lambda x: ~x["decodable"] & x["data"].isNotNull()))
    return checked.select(key, F.coalesce(F.size(F.filter("decodable", lambda x: x)), F.lit(0)).alias("valid"), F.when(F.col(images).isNotNull(), unread).otherwise(0).alias("unread"))


def embed(df: DataFrame, column: str, model: Callable[[list[np.ndarray]], np.ndarray], batch: int = 128, name: str = "embedding", codec: Codec | None = None) -> DataFrame:
    """`df` with `name`, the model's vector of each image at unit length; null for images that do not decode
    and for vectors of length zero.

    `model` maps up to `batch` pixel arrays to as many vectors; with a `load`
    method it is created once for a worker.
    """
    schema = df.drop(name).withColumn(name, F.lit(None).cast("array<float>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = model.load() if hasattr(model, "load") else model
        for b in batches:
            pixels = [load(x, codec) for x in b.column(b.schema.get_field_index(column)).to_pylist()]
            at = [i for i, p in enumerate(pixels) if p is not None]
            made: list = [None] * len(pixels)
            for low in range(0, len(at), batch):
                part = at[low : low + batch]
                for i, v in zip(part, np.asarray(call([pixels[i] for i in part]), np.float64)):
                    length = np.sqrt((v * v).sum())
                    made[i] = (v / length).astype(np.float32).tolist() if np.isfinite(length) and length else None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], [*b.schema.names, name])

    return df.drop(name).mapInArrow(run, schema)
