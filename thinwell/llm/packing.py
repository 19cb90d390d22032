"""Problem 9: items into containers of fixed capacity, by bin completion.

Item sizes are whole numbers up to the capacity, so the items of any corpus are a
histogram of at most `capacity` counts. Bin completion (Korf, 2002) runs on that
histogram: around the largest item left it looks for the fillings that no other filling
dominates, depth first and largest sizes first, with the best-fit filling as first incumbent. A
branch is pruned by its exact waste bound, the fullest sum that the sizes left can still
make, so the search never leaves a branch that it has entered and needs no limit. What it
finds wastes least, and of such fillings has the largest items: a filling that dominated it
would waste as little with larger items. A filling is then used as often as the counts
allow. The result is a plan of at most some thousand fillings. Items find their
container by their rank among the items of their size; only counts ever leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thinwell.llm.tokens import count_tokens
from thinwell.sources.session import cut

CAPACITY = 1_024
#: Items of one size and salt that are ranked in one task, on average, and rows of the table of ranks up to which it is broadcast.
RANKED, BROADCAST_SHARES = 500_000, 262_144


def best_filling(counts: np.ndarray, largest: int, capacity: int) -> list[int]:
    """Sizes (descending) that fill a container around one item of size `largest` with the least waste; of those the largest ones."""
    room = capacity - largest
    sizes = [int(s) for s in np.nonzero(counts[: room + 1])[0][::-1] if s > 0]
    left = [int(counts[s]) - (s == largest) for s in sizes]

    # The incumbent: best fit, the largest item that still fits, again and again.
    incumbent, rest = [largest], room
    for s, n in zip(sizes, left):
        taken = min(n, rest // s)
        incumbent += [s] * taken
        rest -= taken * s
    if not rest:
        return incumbent

    # Bounds: bit t of within[i] tells whether items of the sizes from the i-th on can make the sum t.
    whole = (1 << (room + 1)) - 1
    within = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        sums, n, step = within[i + 1], min(left[i], room // sizes[i]), 1
        while n > 0:
            taken = min(step, n)
            sums |= (sums << (taken * sizes[i])) & whole
            n -= taken
            step *= 2
        within[i] = sums
    todo = within[0].bit_length() - 1
    if room - todo >= rest:
        return incumbent
    filling = [largest]
    for i, s in enumerate(sizes):
        # As many of the largest size as leave a sum that the others can make; all other branches are pruned.
        taken = next(c for c in range(min(left[i], todo // s), -1, -1) if within[i + 1] >> (todo - c * s) & 1)
        filling += [s] * taken
        todo -= taken * s
    return filling


def completion_plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Fillings and how often each is used, for `counts` of the items of each size."""
    counts = counts.copy()
    plan = []
    while counts.any():
        largest = int(np.nonzero(counts)[0][-1])
        filling = best_filling(counts, largest, capacity)
        sizes, needs = np.unique(filling, return_counts=True)
        times = int((counts[sizes] // needs).min())
        counts[sizes] -= needs * times
        plan.append((filling, times))
    return plan


def _assign(plan: list[tuple[list[int], int]]):
    """doc_id, piece, size, rank to the same with the container."""
    starts: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    first = 0
    for filling, times in plan:
        for size, need in zip(*np.unique(filling, return_counts=True)):
            size, need = int(size), int(need)
            starts.setdefault(size, []).append((given.get(size, 0), need, first))
            given[size] = given.get(size, 0) + need * times
        first += times
    table = {size: np.array(rows, np.int64).T for size, rows in starts.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ranks = batch.column("size").to_numpy(), batch.column("rank").to_numpy()
            container = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                mine = np.nonzero(sizes == size)[0]
                start, need, bin_ = table[size]
                at = np.searchsorted(start, ranks[mine], side="right") - 1
                container[mine] = bin_[at] + (ranks[mine] - start[at]) // need[at]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), batch.column("size"), pa.array(container)], ["doc_id", "piece", "size", "container"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, size, container of items given as doc_id and size.

    An item over the capacity is split: pieces 0, 1, ... of a full container each
    and a last piece of what is left; no other item is split. Items of a null size
    or of size 0 or less need no container and give no row. An empty table gives an
    empty result; a doc_id that occurs twice is two items.
    """
    pieces = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / capacity).cast("int") - 1))
    parts = items.where("size > 0").select("doc_id", "size", pieces.alias("piece"))
    parts = cut(parts.select("doc_id", "piece", F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).cast("int").alias("size")))
    total = parts.count()
    salts = max(1, total // RANKED)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    # The ranks of a salt begin where the salt before it ends.
    shares = salted.groupBy("size", "salt").agg(F.count("*").alias("n"))
    shares = cut(shares.select("size", "salt", "n", (F.sum("n").over(Window.partitionBy("size").orderBy("salt")) - F.col("n")).alias("before")))
    counts = np.zeros(capacity + 1, np.int64)
    for row in shares.groupBy("size").agg(F.sum("n").alias("n")).collect():
        counts[row["size"]] = row["n"]
    plan = completion_plan(counts, capacity)
    ranked = salted.withColumn("r", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(F.broadcast(shares) if capacity * salts <= BROADCAST_SHARES else shares, ["size", "salt"]).select("doc_id", "piece", "size", (F.col("before") + F.col("r") - 1).alias("rank"))
    return ranked.mapInArrow(_assign(plan), "doc_id bigint, piece int, size int, container bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents, each as long as its tokens by byte_bpe_50k, in containers."""
    return pack(count_tokens(docs), capacity)


def container_waste(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, waste (share of unused room), and the least number of containers that any packing needs."""
    used = packed.groupBy("container").agg(F.sum("size").alias("used"))
    return used.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count("*") * capacity), 6).alias("waste"), F.ceil(F.sum("used") / capacity).alias("at_least"),
    )
