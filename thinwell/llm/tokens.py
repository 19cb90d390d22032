"""Problem 8: token ids of a whole corpus by a distinct-word table.

Texts are split into words by the tokenizer's own pattern, in Spark. Documents are
spread over batches by a hash of their id; the distinct words of each batch are
shuffled to one row a word, every distinct word is encoded once, and its ids go
back to the batches that hold it. A batch then looks its words up by position. So
what is shuffled per word is (distinct words of a batch), not every occurrence,
and a word that is in every text costs one row a batch.

Where only the numbers of tokens are wanted, only those travel. Ids are decoded by a
join with the pieces, by position inside each batch of documents.

Null and empty texts have an empty list. The tokenizer's file is a parameter; it is
read on the driver and broadcast (1.6 MB, fixed).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thinwell.sources.tables import spread

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = "byte_bpe_50k.json"
#: Characters of text in a batch, on average.
BATCH = 4_000_000
#: Batches that are listed with one word; a word is encoded once for so many batches.
LISTED = 4_096

# The split pattern of byte-level BPE, with its blanks and apostrophes spelt out for Java.
BLANK = r"\p{IsWhite_Space}"
PATTERN = rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{BLANK}\p{{L}}\p{{N}}]+|{BLANK}+(?![^{BLANK}])|{BLANK}+"


def words(text: Column) -> Column:
    """The words of a text, blanks included; concatenated they are the text. Empty for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def _tokenizer(json: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(json)
    made.encode_special_tokens = True
    return made


def _encode(shared, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(shared.value)
        for batch in batches:
            found = [e.ids for e in tokenizer.encode_batch(batch.column("word").to_pylist(), add_special_tokens=False)]
            found = [[len(ids)] for ids in found] if counted else found
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("batches"), pa.array(found, pa.list_(pa.int32()))], ["word", "batches", "ids"])

    return run


def _look_up(docs: pa.Table, table: pa.Table) -> pa.Table:
    """Documents of one batch with their words replaced by ids."""
    lists = table.column("ids").combine_chunks()
    flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    index = dict(zip(table.column("word").to_pylist(), range(len(lists))))
    counts, words = [], []
    for text, lengths in zip(docs.column("text").to_pylist(), docs.column("lengths").to_pylist()):
        counts.append(len(lengths))
        ends = list(accumulate(lengths))
        words += map((text or "").__getitem__, map(slice, [0, *ends], ends))
    ends = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    starts, sizes = offsets[:-1][at], np.diff(offsets)[at]
    # Positions in `flat` of every id of every word, in the documents' order.
    before = np.cumsum(sizes) - sizes
    ids = flat[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))] if len(at) else np.zeros(0, np.int32)
    doc_ends = np.r_[0, np.cumsum(sizes)][ends]
    return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(doc_ends, pa.int32()), pa.array(ids, pa.int32()))})


def _encoded(docs: DataFrame, tokenizer: str, counted: bool) -> DataFrame:
    """doc_id, ids of every document; instead of the ids of each word their number, where `counted`."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    length = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    # By id and text, so that rows without an id are dealt out too.
    batch = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-length // BATCH)))).cast("int")
    split = spread(docs.select("doc_id", "text")).select("doc_id", "text", words(F.col("text")).alias("words"), batch.alias("batch"))
    held = split.select("batch", F.explode(F.array_distinct("words")).alias("word")).distinct()
    # A word's batches in lists of at most LISTED, so that no row grows with the corpus.
    listed = held.groupBy("word", F.floor(F.col("batch") / LISTED)).agg(F.collect_list("batch").alias("batches"))
    encoded = listed.select("word", "batches").mapInArrow(_encode(shared, counted), "word string, batches array<int>, ids array<int>")
    table = encoded.select(F.explode("batches").alias("held_in"), "word", "ids")
    # Lengths of the words travel beside the text: less than half of what the words themselves take.
    cut_texts = split.select("doc_id", "text", F.transform("words", F.length).alias("lengths"), F.col("batch").alias("own"))
    return cut_texts.groupBy("own").cogroup(table.groupBy("held_in")).applyInArrow(_look_up, "doc_id bigint, ids array<int>")


def encode_documents(docs: DataFrame, tokenizer: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """doc_id, ids (list of integers) of every document, without special tokens.

    A null doc_id is a document like any other; a row that occurs twice is encoded
    twice; other columns are ignored.
    """
    return _encoded(docs, tokenizer, False)


def count_tokens(docs: DataFrame, tokenizer: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """doc_id, size: the number of tokens of every document, as encode_documents gives them; 0 for null and empty texts."""
    return _encoded(docs, tokenizer, True).select("doc_id", F.aggregate("ids", F.lit(0), lambda s, n: s + n).alias("size"))


def _byte_of_sign() -> dict[str, int]:
    """Byte of each sign of a byte-level vocabulary: printable bytes stand for themselves, the rest for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(tokenizer: str = f"{TOKENIZERS}/{BYTE_BPE}") -> pa.Array:
    """The bytes of every id of the vocabulary, at the id's position; empty for ids that stand for no text."""
    signs = _byte_of_sign()
    vocabulary = _tokenizer(Path(tokenizer).read_text(encoding="utf-8")).get_vocab()
    table = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, i in vocabulary.items():
        if all(c in signs for c in piece):
            table[i] = bytes(signs[c] for c in piece)
    return pa.array(table, pa.binary())


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(shared.value, pa.binary())
        for batch in batches:
            ids = batch.column("ids")
            ends = np.r_[0, np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)]
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            known = (flat >= 0) & (flat < len(table))
            # The join: the pieces of all ids of the batch, end to end; a document is a stretch of their bytes.
            found = table.take(pa.array(np.where(known, flat, -1), mask=~known)).fill_null(b"")
            at = np.r_[0, np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False), dtype=np.int64)]
            data = b"".join(found.to_pylist())
            texts = [data[at[a] : at[b]].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, tokenizer: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """doc_id, text of encoded documents, by a join of every id with its piece.

    The pieces (a fixed vocabulary of some 50,000) are broadcast; nothing is shuffled. An empty
    or null list gives an empty text; an id outside the vocabulary raises no error and is left out;
    documents that share a doc_id stay apart.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(pieces(tokenizer).to_pylist())
    return encoded.select("doc_id", "ids").mapInArrow(_decode(shared), "doc_id bigint, text string")
