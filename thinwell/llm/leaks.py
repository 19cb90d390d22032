"""Problem 7: evaluation items inside corpus texts.

Texts and questions become runs of plain words (no case, marks, punctuation or
spacing). Windows of WINDOW words of a question, or of all its words where it is shorter,
and windows of the same length of a corpus text are embedded by CGK random walks (Chakraborty, Goldenberg, Koucky, 2016): at each
step the walk writes the word under its pointer and moves on or stays as the
word's random bit for that step says, so that a small edit distance between
windows becomes a small Hamming distance between walks. Keys of a few sampled
steps of a walk are the LSH tables; windows that share a key are candidates.

A candidate pair is verified in two ways. Equal windows are a leak of so many
consecutive words. For an edited leak the whole item is aligned with the text around the
window, an item-sized window whose ends the alignment chooses, and their exact word edit
distance is at most EDIT_SHARE of the item's words. As items made from one pattern differ by
few words, an edited leak also has to hold half of the item's rare words: those that
at most one item in a hundred (or two items) have.

Equal windows have equal walks and meet in every table; for edited ones the recall of
WALKS * TABLES tables is measured in tests/llm.

The questions are the query set. They are embedded on the driver in blocks of at
most BLOCK windows (24 MB); each block is one pass over the corpus, in which
nothing but the leaks found is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinwell.llm.hashing import WordHashes, fixed_words, mix
from thinwell.sources.tables import spread

WINDOW = 10
#: Words of the shortest item that takes part, and of the shortest that is also found with edits.
SHORTEST, SHORTEST_EDITED = 4, 6
#: Share of an item's words that edits may touch, and share of its rare words that an edited leak holds.
EDIT_SHARE, RARE_SHARE = 0.2, 0.5
#: Share of the items (two at least) up to which a word is rare.
RARE = 0.01
WALKS, TABLES, SAMPLES = 3, 4, 5
BLOCK = 100_000
#: Windows embedded at a time, so that the arrays stay in the cache.
AT_ONCE = 1 << 15
SIEVE = 22

PLAIN = re.compile(r"[a-z0-9]+")
ALNUM = re.compile(r"[^\W_]+")


def plain_words(text: str) -> list[str]:
    """Words of letters and digits without case and marks."""
    if text.isascii():
        return PLAIN.findall(text.lower())
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if unicodedata.category(c)[0] not in "MC" or c.isspace())
    return ALNUM.findall(bare)


def window_keys(words: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Keys (walks * tables, windows) of the windows of `width` words that begin at `starts`."""
    steps = max(2 * width, TABLES)
    samples = -(-steps // TABLES) if width < WINDOW else SAMPLES
    out = np.zeros((WALKS * TABLES, len(starts)), np.uint32)
    padded = np.r_[words, np.zeros(width, np.uint64)]
    marks = (padded >> np.uint64(32)).astype(np.uint32)
    odds = fixed_words(steps, 23).astype(np.uint32) | np.uint32(1)
    for walk in range(WALKS):
        moves = mix(padded ^ fixed_words(WALKS, 29)[walk])
        order = np.argsort(fixed_words(steps, 31 + walk))
        tables_of = {int(step): [t for t in range(TABLES) if step in order[t * samples : (t + 1) * samples]] for step in range(steps)}
        for low in range(0, len(starts), AT_ONCE):
            at = starts[low : low + AT_ONCE].astype(np.int32)
            end = at + np.int32(width)
            part = out[walk * TABLES : (walk + 1) * TABLES, low : low + AT_ONCE]
            for step in range(steps):
                inside = at < end
                written = marks[at] * odds[step] * inside
                for t in tables_of[step]:
                    part[t] += written
                at += inside & ((moves[at] >> np.uint64(step)) & np.uint64(1)).astype(bool)
    # The table is part of the key, so that a window's keys differ from one another.
    return (mix(out + fixed_words(len(out), 37)[:, None]) >> np.uint64(32)).astype(np.uint32)


def fit_edits(item: list[int], text: list[int], most: int) -> int:
    """The least word edit distance between `item` and any run of words of `text`; most + 1 where it is greater than `most`."""
    last = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        now = [i + 1]
        for j, y in enumerate(text):
            now.append(min(last[j] + (x != y), last[j + 1] + 1, now[j] + 1))
        if min(now) > most:
            return most + 1
        last = now
    return min(min(last), most + 1)


def _starts(ends: list[int], width: int = WINDOW) -> np.ndarray:
    """First words of the windows that lie inside single texts laid end to end."""
    parts, begin = [], 0
    for end in ends:
        if end - begin >= width:
            parts.append(np.arange(begin, end - width + 1))
        begin = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class _Windows:
    """The different windows of one width of some items, their keys, and where they occur."""

    def __init__(self, width: int, items: list[tuple[int, list[int]]]):
        self.width = width
        places: dict[tuple, list[tuple[int, int]]] = {}
        for number, words in items:
            for at in range(len(words) - width + 1):
                places.setdefault(tuple(words[at : at + width]), []).append((number, at))
        self.places = list(places.values())
        self.words = np.array(list(places), np.uint64)
        keys = window_keys(self.words.ravel(), np.arange(len(places)) * width, width)
        flat, who = keys.ravel(), np.tile(np.arange(len(places)), len(keys))
        order = np.argsort(flat, kind="stable")
        self.keys, self.who = flat[order], who[order]
        self.sieve = np.zeros(1 << SIEVE, bool)
        self.sieve[flat >> np.uint32(32 - SIEVE)] = True

    def hits(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `starts` and windows that share a key, each pair once."""
        keys = window_keys(words, starts, self.width)
        table, at = np.nonzero(self.sieve[keys >> np.uint32(32 - SIEVE)])
        key = keys[table, at]
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        sizes = high - low
        at, low, sizes = at[sizes > 0], low[sizes > 0], sizes[sizes > 0]
        each = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        pairs = np.unique(np.repeat(at, sizes).astype(np.int64) << 32 | self.who[each])
        return pairs >> 32, pairs & 0xFFFFFFFF


def _embed_items(items: list[tuple[str, list[int]]], rare: list[frozenset[int]]):
    by_width: dict[int, list] = {}
    for number, (_, words) in enumerate(items):
        by_width.setdefault(min(WINDOW, len(words)), []).append((number, words))
    return [i for i, _ in items], [w for _, w in items], rare, [_Windows(width, held) for width, held in sorted(by_width.items())]


def _search(block, row_column: str):
    names, item_words, rare, windows = block

    def of(words: list[int], ends: list[int], row_of: list) -> list[tuple]:
        flat, found = np.array(words, np.uint64), {}
        for kind in windows:
            starts = _starts(ends, kind.width)
            if not len(starts):
                continue
            at, window = kind.hits(flat, starts)
            if not len(at):
                continue
            there = flat[starts[at][:, None] + np.arange(kind.width)]
            wanted = kind.words[window]
            equal = (there == wanted).all(axis=1)
            # Windows that lack more of each other's words than edits explain are dropped at once.
            near = (there[:, :, None] == wanted[:, None, :]).any(axis=2).sum(axis=1) >= kind.width - 1 - int(EDIT_SHARE * kind.width)
            text_of = np.searchsorted(np.array(ends), starts[at], side="right")
            for a, w, same, text in zip(starts[at[near]].tolist(), window[near].tolist(), equal[near].tolist(), text_of[near].tolist()):
                for number, offset in kind.places[w]:
                    equal_words, edits = found.get((row_of[text], number), (0, None))
                    if edits != 0 and len(item_words[number]) >= SHORTEST_EDITED:
                        item = item_words[number]
                        most = int(EDIT_SHARE * len(item)) if edits is None else edits - 1
                        first = max(a - offset - most, ends[text - 1] if text else 0)
                        around = words[first : min(a - offset + len(item) + most, ends[text])]
                        if len(rare[number].intersection(around)) >= RARE_SHARE * len(rare[number]) and (rare[number] or same):
                            n = fit_edits(item, around, most)
                            edits = n if n <= most else edits
                    if same and len(item_words[number]) == kind.width:
                        edits = 0
                    if same or edits is not None:
                        found[row_of[text], number] = (kind.width if same else equal_words, edits)
        return [(row, names[number], equal_words, edits) for (row, number), (equal_words, edits) in found.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            known.trim()
            found, words, ends, row_of = [], [], [], []
            for row, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for text in texts or []:
                    if row is not None and text:
                        words += [known[w] for w in plain_words(text)]
                        ends.append(len(words))
                        row_of.append(row)
                if len(words) > 200_000:
                    found += of(words, ends, row_of)
                    words, ends, row_of = [], [], []
            found += of(words, ends, row_of)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], batch.schema.field(0).type), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int32())],
                [row_column, "sample_id", "words", "edits"],
            )

    return run


def leaks(texts: DataFrame, samples: DataFrame) -> DataFrame:
    """row_id, sample_id, words, edits: each row with each item that leaked into one of its texts.

    `words` is WINDOW where the text holds so many consecutive words of the item, the item's
    length where it is shorter and the text holds it whole, else 0; `edits` is the least number of word edits between the whole item and a run of
    words of the text, null where more than EDIT_SHARE of the item's words would have to be edited.

    `texts` has row_id and texts (array of strings), `samples` id and question.
    Nulls, blank texts and questions under SHORTEST words take no part; a row or an
    item that occurs twice counts once; empty tables give an empty result.
    """
    known = WordHashes()
    questions = samples.select("id", "question").where("id is not null and question is not null").distinct().toLocalIterator()
    items = [(q["id"], words) for q in questions if len(words := [known[w] for w in plain_words(q["question"])]) >= SHORTEST]
    held_by = Counter(w for _, words in items for w in set(words))
    rare = [frozenset(w for w in words if held_by[w] <= max(2, RARE * len(items))) for _, words in items]
    blocks, held, n = [], [], 0
    for item, own in zip(items, rare):
        held.append((item, own))
        n += max(1, len(item[1]) - WINDOW + 1)
        if n >= BLOCK:
            blocks.append(held)
            held, n = [], 0
    blocks += [held] if held else []
    schema = f"row_id {texts.schema['row_id'].dataType.simpleString()}, sample_id string, words int, edits int"
    rows = spread(texts.select("row_id", "texts"))
    found = [rows.mapInArrow(_search(_embed_items([i for i, _ in b], [r for _, r in b]), "row_id"), schema) for b in blocks]
    if not found:
        return texts.sparkSession.createDataFrame([], schema)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("row_id", "sample_id").agg(F.max("words").alias("words"), F.min("edits").alias("edits"))


def turn_texts(docs: DataFrame) -> DataFrame:
    """row_id and all user and assistant texts of a row, for `leaks`."""
    return docs.select("row_id", F.concat(F.col("texts.user"), F.col("texts.assistant")).alias("texts"))


def whole_leaks(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """row_id, sample_id of the leaks of at least ten consecutive words."""
    return leaks(turn_texts(docs), samples).where(F.col("words") >= WINDOW).select("row_id", "sample_id")
