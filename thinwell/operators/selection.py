"""Greedy k-center (farthest-point) selection, local, incremental and global."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinwell.functions.vectors import normalise, valid_vector
from thinwell.operators.paging import sharded, strided_pages
from thinwell.plans.config import SelectionConfig
from thinwell.sources.session import cut

#: Bytes of vectors that one task may hold; larger pools are selected by distributed passes.
POOL_BYTES = 128 << 20
#: Far vectors that a task offers in a pass, those of all tasks together, and picks after which the nearest distances are written down.
OFFERED, OFFERED_IN_ALL, WRITTEN_AFTER = 64, 20_000, 256
#: Selected vectors that are compared at a time when coverage is measured, and vectors of the pool in one task beside them.
BLOCK, BESIDE = 20_000, 50_000

PICKED = "id bigint, pick int, distance double, embedding array<double>"


def unit_vectors(df: DataFrame, id_column: str = "id", vector_column: str = "embedding", size: int | None = None) -> DataFrame:
    """id, embedding: one unit vector for each id, in double precision.

    Null ids and vectors that are null, not of `size` numbers (by default the
    table's most frequent size), hold a null or a number that is not finite, or are
    all zero, are dropped. Of an id that occurs more than once the least vector
    stays, so the result never depends on the rows' order.
    """
    if size is None:
        size = df.agg(F.mode(F.size(vector_column), True)).first()[0] or 0
    ok = F.col(id_column).isNotNull() & valid_vector(vector_column) & (F.size(vector_column) == size)
    rows = df.where(ok).select(F.col(id_column).alias("id"), F.col(vector_column).alias("embedding"))
    once = rows.groupBy("id").agg(F.min("embedding").alias("embedding"))
    return once.select("id", normalise(F.col("embedding")).alias("embedding"))


def greedy(x: np.ndarray, k: int, start: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `k` rows in the order of their picking, and each one's distance when it was picked.

    The first pick is `start`, its distance infinite; each next pick is the row farthest
    (1 - dot) from its nearest pick, the lowest position on a tie. `k` over the
    number of rows takes all, `k` of 0 or less none.
    """
    k = min(k, len(x))
    if k <= 0:
        return np.zeros(0, np.int64), np.zeros(0)
    nearest = np.full(len(x), np.inf)
    picks, at = [start], [np.inf]
    while len(picks) < k:
        last = picks[-1]
        np.minimum(nearest, 1.0 - x @ x[last], out=nearest)
        nearest[last] = -np.inf
        best = int(np.argmax(nearest))
        picks.append(best)
        at.append(max(float(nearest[best]), 0.0))
    return np.array(picks), np.array(at)


def _sorted_pool(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("id").to_numpy()
    flat = table.column("embedding").combine_chunks().flatten().to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), -1)[order]


def _rows(ids: np.ndarray, x: np.ndarray, at: np.ndarray, **more) -> pa.Table:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * (x.shape[1] if x.ndim == 2 else 0), pa.int32()), pa.array(x.ravel(), pa.float64()))
    return pa.table({**more, "id": pa.array(ids, pa.int64()), "pick": pa.array(np.arange(len(ids)), pa.int32()), "distance": pa.array(at, pa.float64()), "embedding": lists})


def _pick(k: int, start_id: int | None):
    def run(table: pa.Table) -> pa.Table:
        ids, x = _sorted_pool(table)
        start = int(np.searchsorted(ids, start_id)) if start_id is not None and start_id in ids else 0
        picks, at = greedy(x, k, start)
        return _rows(ids[picks], x[picks], at)

    return run


def _nearer(ids: np.ndarray, x: np.ndarray, near: np.ndarray, picked: np.ndarray, taken: np.ndarray) -> np.ndarray:
    """Distances to the nearest pick once `picked` is picked too; of picks themselves -inf."""
    if len(picked):
        near = np.minimum(near, 1.0 - (x @ picked.T).max(axis=1))
    return np.where(np.isin(ids, taken), -np.inf, near)


def _offers(picked: np.ndarray, taken: np.ndarray, most: int):
    """Of each task the `most` vectors farthest from their nearest pick, and the next one's distance as a bound of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, near = np.zeros(0, np.int64), None, np.zeros(0)
        for batch in batches:
            if batch.num_rows:
                new, rows = _sorted_pool(pa.Table.from_batches([batch]))
                held = batch.column("near").to_numpy()[np.argsort(batch.column("id").to_numpy(), kind="stable")]
                ids, near = np.r_[ids, new], np.r_[near, _nearer(new, rows, held, picked, taken)]
                x = rows if x is None else np.concatenate([x, rows])
                best = np.lexsort((ids, -near))[: most + 1]
                ids, x, near = ids[best], x[best], near[best]
        if len(ids):
            # The last row is the bound: it has pick 1, offers have pick 0.
            out = _rows(ids, x, near).drop_columns(["pick"])
            yield out.append_column("pick", pa.array((np.arange(len(ids)) == most).astype(np.int32))).select(["id", "pick", "distance", "embedding"]).combine_chunks().to_batches()[0]

    return run


def _written(picked: np.ndarray, taken: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = _sorted_pool(pa.Table.from_batches([batch]))
                order = np.argsort(batch.column("id").to_numpy(), kind="stable")
                near = _nearer(ids, x, batch.column("near").to_numpy()[order], picked, taken)
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column("embedding").take(pa.array(order)), pa.array(near)], ["id", "embedding", "near"])

    return run


def _in_passes(pool: DataFrame, k: int, start_id: int | None) -> DataFrame:
    """The picks from a pool that no task holds.

    In a pass every task offers the vectors that are farthest from their nearest pick, with the distance that no
    other of its vectors exceeds. As distances only fall, the driver can go on picking among the
    offers while the farthest one lies above all bounds, so a pass gives many picks. The
    distances to the nearest pick are kept with the pool and written anew after every WRITTEN_AFTER picks.
    """
    spark = pool.sparkSession
    first = pool.where(F.col("id") == start_id).first() if start_id is not None else None
    first = first or pool.orderBy("id").first()
    out = [(first["id"], 0, float("inf"), first["embedding"])]
    held, written = pool.withColumn("near", F.lit(float("inf"))), 0
    most = max(1, min(OFFERED, OFFERED_IN_ALL // max(1, pool.rdd.getNumPartitions())))
    while len(out) < k:
        if len(out) - written >= WRITTEN_AFTER:
            held = cut(held.mapInArrow(_written(np.array([r[3] for r in out[written:]]), np.array([r[0] for r in out[written:]])), "id bigint, embedding array<double>, near double"))
            written = len(out)
        picked, taken = np.array([r[3] for r in out[written:]]), np.array([r[0] for r in out[written:]], np.int64)
        rows = held.mapInArrow(_offers(picked, taken, most), PICKED).collect()
        bound = max((r["distance"] for r in rows if r["pick"]), default=-np.inf)
        ids, x = np.array([r["id"] for r in rows]), np.array([r["embedding"] for r in rows])
        near = np.array([r["distance"] for r in rows])
        order = np.argsort(ids, kind="stable")
        ids, x, near = ids[order], x[order], near[order]
        before = len(out)
        while len(out) < k:
            best = int(np.argmax(near)) if len(near) else 0
            # The first of a pass is the farthest of all; later ones only while they lie above what was not offered.
            if not len(near) or near[best] == -np.inf or len(out) > before and near[best] <= bound:
                break
            out.append((int(ids[best]), len(out), max(float(near[best]), 0.0), x[best].tolist()))
            near = np.minimum(near, 1.0 - x @ x[best])
            near[best] = -np.inf
        if len(out) == before:
            break
    return spark.createDataFrame(out, PICKED)


def greedy_kcenter(pool: DataFrame, k: int, start_id: int | None = None, in_one_task: int | None = None) -> DataFrame:
    """id, pick, distance, embedding of the `k` picks from a pool of unit vectors (id, embedding).

    Starts at `start_id`, or at the lowest id where it is not given or not in the pool;
    the lowest id wins a tie. A pool of up to `in_one_task` vectors, by default POOL_BYTES of them, is
    selected in one task; a larger one is never gathered (see `_in_passes`).
    `k` over the pool takes all of it; `k` of 0 or less, or an empty pool, none.
    """
    pool = cut(pool.select("id", "embedding"))
    if k > 0:
        n, size = pool.agg(F.count("*"), F.max(F.size("embedding"))).first()
        if n > (POOL_BYTES // (8 * max(size or 1, 1)) if in_one_task is None else in_one_task):
            return _in_passes(pool, k, start_id)
    return pool.groupBy().applyInArrow(_pick(k, start_id), PICKED)


def local_coresets(rows: DataFrame, k: int, shard: str = "shard") -> DataFrame:
    """shard, id, pick, distance, embedding: one greedy pass over each shard's unit vectors."""

    def run(table: pa.Table) -> pa.Table:
        ids, x = _sorted_pool(table)
        picks, at = greedy(x, k)
        return _rows(ids[picks], x[picks], at, shard=table.column(shard)[: len(picks)])

    return rows.select(F.col(shard).alias("shard"), "id", "embedding").groupBy("shard").applyInArrow(run, f"shard int, {PICKED}")


def merge(ids: np.ndarray | None, x: np.ndarray | None, new_ids: np.ndarray, new_x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A coreset and a new batch to a coreset of at most `k`: greedy over both, sorted by id, so that old members may leave."""
    if ids is not None and len(ids):
        new_ids, new_x = np.concatenate([ids, new_ids]), np.concatenate([x, new_x])
    order = np.argsort(new_ids, kind="stable")
    new_ids, new_x = new_ids[order], new_x[order]
    picks, _ = greedy(new_x, k)
    return new_ids[picks], new_x[picks]


def paged_coresets(rows: DataFrame, k: int, shard: str = "shard") -> DataFrame:
    """shard, id, pick, distance, embedding: each shard's coreset, merged page after page.

    `rows` has shard, page, id and embedding (unit vectors). A task streams its
    shard's pages and holds one page and one coreset, not the shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, page, held, ids, x = None, None, [], None, None

        def fold():
            nonlocal ids, x, held
            if held:
                new_ids, new_x = _sorted_pool(pa.Table.from_batches(held))
                ids, x = merge(ids, x, new_ids, new_x, k)
                held = []

        for batch in batches:
            pages = batch.column("page").to_numpy()
            name = batch.column("shard")[0]
            for p in np.unique(pages).tolist():
                if p != page:
                    fold()
                    page = p
                held.append(batch.filter(pa.array(pages == p)))
        fold()
        if ids is not None:
            yield from _rows(ids, x, np.full(len(ids), np.nan), shard=pa.array([name.as_py()] * len(ids), pa.int32())).to_batches()

    # Sorted by page inside the shard, which the grouping keeps.
    ordered = rows.select(F.col(shard).alias("shard"), "page", "id", "embedding").repartition("shard").sortWithinPartitions("shard", "page", "id")
    return ordered.groupBy("shard").applyInArrow(run, f"shard int, {PICKED}")


def global_merge(local: DataFrame, final_size: int, start_id: int | None = None) -> DataFrame:
    """id, pick, distance, embedding: the final coreset of the shards' coresets, one row for each id.

    Raises where no shard has a candidate.
    """
    pool = cut(local.groupBy("id").agg(F.min("embedding").alias("embedding")))
    if pool.isEmpty():
        raise ValueError("no candidates: every shard is empty")
    return greedy_kcenter(pool, final_size, start_id)


def two_stage(df: DataFrame, config: SelectionConfig, paged: bool = True, limited: bool = False) -> DataFrame:
    """id, embedding of the final coreset, sorted by id: shards, strided pages, local selection, global selection.

    Page by page a task holds one page and one coreset; with `paged` off it holds a whole shard.
    """
    rows = strided_pages(sharded(unit_vectors(df, config.id_column, config.vector_column), config.shards), config, limited=limited)
    local = paged_coresets(rows, config.local_size) if paged else local_coresets(rows, config.local_size)
    return global_merge(local, config.final_size, config.start_id).select("id", "embedding").orderBy("id")


def _nearest_of(block: np.ndarray, ids: np.ndarray, x: np.ndarray) -> list[pa.Array]:
    return [pa.array(ids, pa.int64()), pa.array(np.maximum(1.0 - (x @ block.T).max(axis=1), 0.0))]


def coverage(pool: DataFrame, selected: DataFrame) -> DataFrame:
    """id, distance: the distance of every unit vector to the nearest selected one, 0 at least.

    A selection of up to BLOCK vectors goes to the tasks as it is, and the pool is not shuffled. A larger one is
    dealt out to blocks, and every part of the pool meets every block in a task of its own. An empty
    selection gives an empty result.
    """
    schema = "id bigint, distance double"
    selected = cut(selected.select("id", "embedding"))
    m = selected.count()
    if not m:
        return pool.sparkSession.createDataFrame([], schema)
    if m <= BLOCK:
        block = np.array([r["embedding"] for r in selected.select("embedding").collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays(_nearest_of(block, *_sorted_pool(pa.Table.from_batches([batch]))), ["id", "distance"])

        return pool.select("id", "embedding").mapInArrow(run, schema)

    def meet(part: pa.Table, block: pa.Table) -> pa.Table:
        if not part.num_rows or not block.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        return pa.table(dict(zip(("id", "distance"), _nearest_of(_sorted_pool(block)[1], *_sorted_pool(part)))))

    blocks, parts = -(-m // BLOCK), max(1, -(-pool.count() // BESIDE))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = pool.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), numbers(blocks).alias("block"))
    sides = selected.select("id", "embedding", numbers(parts).alias("part"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    met = rows.groupBy("part", "block").cogroup(sides.groupBy("part", "block")).applyInArrow(meet, schema)
    return met.groupBy("id").agg(F.min("distance").alias("distance"))
