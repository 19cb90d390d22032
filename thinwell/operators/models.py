"""Text generation by a pluggable model, errors kept in the row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def generate(df: DataFrame, model: Callable[[str], str], prompt: str = "prompt") -> DataFrame:
    """`df` with raw and error: the model's answer to each prompt, or the text of the error it raised.

    `model` with a `load` method is created once for a worker; a null prompt
    gives an error row.
    """
    schema = df.drop("raw", "error").withColumn("raw", F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = model.load() if hasattr(model, "load") else model
        for b in batches:
            raw, errors = [], []
            for text in b.column(b.schema.get_field_index(prompt)).to_pylist():
                try:
                    if text is None:
                        raise ValueError("no prompt")
                    raw.append(call(text))
                    errors.append(None)
                except Exception as e:  # every failure of a model is a result
                    raw.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.string()), pa.array(errors, pa.string())], [*b.schema.names, "raw", "error"])

    return df.drop("raw", "error").mapInArrow(run, schema)
