"""Column expressions on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as blanks at either end of a text.
BLANKS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# The wording of an evaluation prompt.
LOOK = "Look at the image(s) carefully and answer the following question."
ANSWER = "Answer the following question."
ONLY_LETTER = "Answer with only the option letter (A, B, C, or D)."


def strip(text: Column) -> Column:
    """`text` without blanks of any script at either end; null stays null."""
    return F.regexp_replace(text, rf"^[{BLANKS}]+|[{BLANKS}]+\z", "")


def stripped_or_empty(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit(""))


def extract_answer(raw: Column) -> Column:
    """The option letter of a raw answer: the first A to D that stands alone, else the first
    character in upper case if it is one of them, else X. Empty or blank gives "", null gives null.

    The article "A" counts as a letter that stands alone.
    """
    bare = strip(raw)
    alone = F.regexp_extract(bare, r"(?U)(?<!\w)([A-D])(?!\w)", 1)
    first = F.upper(F.substring(bare, 1, 1))
    return F.when(bare == "", "").when(alone != "", alone).when(first.isin(*"ABCD"), first).when(raw.isNotNull(), "X")


def options_text(options: Column) -> Column:
    """Options one below another; null elements are left out, a null list gives an empty text."""
    return F.coalesce(F.array_join(options, "\n"), F.lit(""))


def prompt(question: Column, options: Column, images: Column) -> Column:
    """An evaluation prompt: one tag a line for each of the `images` (a number), the question, the
    options and the instruction; without images another opening. A null question reads as empty."""
    body = F.concat(
        F.lit("Question: "), F.coalesce(question, F.lit("")), F.lit("\n\nOptions:\n"), options_text(options), F.lit(f"\n\n{ONLY_LETTER}")
    )
    tags = F.array_join(F.array_repeat(F.lit("<image>"), images), "\n")
    return F.when(images > 0, F.concat(tags, F.lit(f"\n\n{LOOK}\n\n"), body)).otherwise(F.concat(F.lit(f"{ANSWER}\n\n"), body))


def shard_name(index: Column, total: Column) -> Column:
    """Name of an output shard, as train-00000-of-00012.parquet."""
    return F.format_string("train-%05d-of-%05d.parquet", index, total)
