"""Statistics of all pairwise cosine similarities of a set of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinwell.sources.session import cut

#: Vectors of a block; a pair of blocks goes to Python at a time.
BLOCK = 4_096
#: Similarities that are computed at once.
AT_ONCE = 1 << 18
#: Blocks of a partition at most; a task holds one partition and meets it with the blocks of another.
HELD = 16
#: Tasks for each core that pairs are dealt out to, at most; each gives one row of counts.
TASKS = 4
#: Counting bins over [-1, 1], and inside one of those, that locate the median.
BINS = 1 << 17
#: Values around the median that the driver takes to sort; a bin of more is counted in finer bins.
KEPT = 4_000_000
#: Times that bins are made finer; what then is in one bin differs by less than 2 ** -66 and counts as equal.
LEVELS = 4

#: Pairs of blocks that go to Python together; without a bound a task's pairs may all be in one batch.
PAIRS_AT_ONCE, BATCH = 2, "spark.sql.execution.arrow.maxRecordsPerBatch"
COUNTS = "path int, n bigint, total double, squares double, low double, high double, bins array<int>, counts array<bigint>"


def _blocks(vectors: DataFrame) -> DataFrame:
    """block, n, data: the vectors (unit length, doubles) packed in blocks of up to BLOCK rows, in even partitions."""
    size = BLOCK
    blocks = max(1, -(-vectors.count() // size))
    partitions = max(min(blocks, 2 * vectors.sparkSession.sparkContext.defaultParallelism), -(-blocks // HELD))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["n", "data"])

        rest = None
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                rest = rows if rest is None else np.concatenate([rest, rows])
                while len(rest) >= size:
                    yield packed(rest[:size])
                    rest = rest[size:]
        if rest is not None and len(rest):
            yield packed(rest)

    rows = vectors.repartition(partitions, "id").select("embedding")
    return cut(rows.mapInArrow(pack, "n int, data binary").select(F.monotonically_increasing_id().alias("block"), "n", "data"))


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """Every pair of blocks once. Tasks read the partitions of the shared folder as they are: a block is never shuffled.

    Which block of a pair comes first is a matter of a hash, so any two partitions share their pairs evenly both ways.
    """
    side = lambda x: blocks.select(F.col("block").alias(x), F.col("n").alias(f"n_{x}"), F.col("data").alias(f"data_{x}"))
    even = F.xxhash64(F.least("a", "b"), F.greatest("a", "b")) % 2 == 0
    pairs = side("a").join(side("b").hint("shuffle_replicate_nl"), (F.col("a") == F.col("b")) | ((F.col("a") < F.col("b")) == even))
    return pairs.coalesce(TASKS * blocks.sparkSession.sparkContext.defaultParallelism)


def _values(batch: pa.RecordBatch, i: int) -> Iterator[np.ndarray]:
    """Similarities of a pair of blocks, each unordered pair of rows once, some rows of the first at a time."""
    a, b = (np.frombuffer(batch.column(f"data_{x}")[i].as_buffer()).reshape(batch.column(f"n_{x}")[i].as_py(), -1) for x in "ab")
    same, step = batch.column("a")[i] == batch.column("b")[i], max(1, AT_ONCE // len(b))
    for at in range(0, len(a), step):
        s = a[at : at + step] @ b[at if same else 0 :].T
        values = s[np.triu_indices(*s.shape[:1], 1, s.shape[1])] if same else s.ravel()
        if len(values):
            yield values


def _folded(pairs: DataFrame, start: Callable, add: Callable, finish: Callable, schema: str) -> DataFrame:
    """The rows that `finish` makes of a task's state, once `add` has given it the similarities of all the task's pairs.

    Computed at once, as the number of pairs that go to Python together is a setting of the session.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            for i in range(batch.num_rows):
                for values in _values(batch, i):
                    add(state, values)
        yield finish(state)

    conf = pairs.sparkSession.conf
    before = conf.get(BATCH)
    conf.set(BATCH, str(PAIRS_AT_ONCE))
    try:
        return cut(pairs.mapInArrow(run, schema))
    finally:
        conf.set(BATCH, before)


def _bin(values: np.ndarray, low: float = -1.0, width: float = 2.0) -> np.ndarray:
    at = values - low
    at *= BINS / width
    return np.clip(at, 0, BINS - 1, out=at).astype(np.int64)


def _inside(values: np.ndarray, path: tuple[int, ...]) -> tuple[np.ndarray, float, float]:
    """Those values that lie in bin path[0], in its bin path[1] and so on; where the last one begins, and its width."""
    low, width = -1.0, 2.0
    for chosen in path:
        # Most values are far from the bin: two comparisons tell, the others are placed.
        first, last = low + (chosen - 1) * (width / BINS), low + (chosen + 2) * (width / BINS)
        values = values[(values > (first if chosen else -np.inf)) & (values < (last if chosen < BINS - 1 else np.inf))]
        values = values[_bin(values, low, width) == chosen]
        width /= BINS
        low += chosen * width
    return values, low, width


def _counted(pairs: DataFrame, paths: list[tuple[int, ...]]) -> tuple[dict, dict]:
    """Of the values inside each path: a row of n, total, squares, low and high; non-empty bins and how many each holds, in order."""

    def start() -> list[list]:
        return [[0, 0.0, 0.0, np.inf, -np.inf, np.zeros(BINS, np.int64)] for _ in paths]

    def add(state: list[list], values: np.ndarray) -> None:
        for held, path in zip(state, paths):
            own, low, width = _inside(values, path)
            if len(own):
                held[:5] = held[0] + len(own), held[1] + float(own.sum()), held[2] + float(own @ own), min(held[3], float(own.min())), max(held[4], float(own.max()))
                held[5] += np.bincount(_bin(own, low, width), minlength=BINS)

    def finish(state: list[list]) -> pa.RecordBatch:
        rows = []
        for i, (n, total, squares, low, high, counts) in enumerate(state):
            bins = np.nonzero(counts)[0]
            rows.append({"path": i, "n": n, "total": total, "squares": squares, "low": low if n else None, "high": high if n else None, "bins": bins.astype(np.int32), "counts": counts[bins]})
        kinds = [("path", pa.int32()), ("n", pa.int64()), *((c, pa.float64()) for c in ("total", "squares", "low", "high")), ("bins", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]
        return pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    parts = _folded(pairs, start, add, finish, COUNTS)
    sums = parts.groupBy("path").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    by_bin = parts.select("path", F.explode(F.arrays_zip("bins", "counts")).alias("x")).groupBy("path", F.col("x.bins").alias("bin")).agg(F.sum("x.counts").alias("n")).toPandas().sort_values("bin")
    counts = {paths[i]: (own["bin"].to_numpy(), own["n"].to_numpy()) for i, own in by_bin.groupby("path")}
    return {paths[r["path"]]: r for r in sums}, counts


def _narrowed(path: tuple[int, ...], rank: int, counts: dict) -> tuple[tuple[int, ...], int, int]:
    """The bin that holds the value of this rank inside a path, the value's rank in there, and the bin's values."""
    bins, n = counts[path]
    ends = n.cumsum()
    at = int(np.searchsorted(ends, rank, side="right"))
    return (*path, int(bins[at])), rank - int(ends[at] - n[at]), int(n[at])


def _ranked(pairs: DataFrame, ranks: list[int], counts: dict) -> list[float]:
    """The values of these ranks among all similarities, each pair once; `counts` are those of the path ()."""
    places, found = [_narrowed((), rank, counts) for rank in ranks], {}
    while again := sorted({path for i, (path, _, n) in enumerate(places) if n > KEPT and i not in found}):
        ends, counts = _counted(pairs, again)
        for i, (path, rank, _) in enumerate(places):
            if path in again and i not in found:
                if ends[path]["low"] == ends[path]["high"] or len(path) == LEVELS:
                    found[i] = ends[path]["low"]
                else:
                    places[i] = _narrowed(path, rank, counts)
    paths = sorted({path for i, (path, _, _) in enumerate(places) if i not in found})
    if paths:

        def add(state: list[list], values: np.ndarray) -> None:
            for held, path in zip(state, paths):
                held.append(_inside(values, path)[0])

        def finish(state: list[list]) -> pa.RecordBatch:
            data = [np.concatenate([np.zeros(0), *held]).tobytes() for held in state]
            return pa.RecordBatch.from_arrays([pa.array(range(len(paths)), pa.int32()), pa.array(data, pa.binary())], ["path", "data"])

        rows = _folded(pairs, lambda: [[] for _ in paths], add, finish, "path int, data binary").collect()
        inside = {path: np.sort(np.concatenate([np.frombuffer(r["data"]) for r in rows if r["path"] == i])) for i, path in enumerate(paths)}
        found |= {i: float(inside[path][rank]) for i, (path, rank, _) in enumerate(places) if i not in found}
    return [found[i] for i in range(len(ranks))]


def pairwise_stats(vectors: DataFrame) -> DataFrame:
    """One row: pairs (both directions), mean, exact median, population standard deviation, minimum and maximum.

    `vectors` has id and embedding, of unit length and in double precision. Blocks
    are multiplied in tasks; of a task's similarities only sums, extremes and counts by
    bin are kept, and for the median the values of one or two bins. Fewer than two
    vectors give 0 pairs and nulls.
    """
    pairs = _block_pairs(_blocks(vectors))
    sums, counts = _counted(pairs, [()])
    sums = sums.get(())
    n = sums["n"] if sums else 0
    spark = vectors.sparkSession
    schema = "pairs bigint, mean double, median double, std double, low double, high double"
    if not n:
        return spark.createDataFrame([(0, None, None, None, None, None)], schema)
    median = float(np.mean(_ranked(pairs, [(n - 1) // 2, n // 2], counts)))
    mean = sums["total"] / n
    std = float(np.sqrt(max(sums["squares"] / n - mean * mean, 0.0)))
    return spark.createDataFrame([(2 * n, mean, median, std, sums["low"], sums["high"])], schema)


def pairwise_histogram(vectors: DataFrame, bins: int = 50) -> DataFrame:
    """bin (1 to `bins`), low, high, pairs: equal-width bins over [minimum, maximum], the last one closed.

    Both directions of a pair count. With all similarities equal they fall into bin
    `bins`; fewer than two vectors give no bins.
    """
    pairs = _block_pairs(_blocks(vectors))

    def widen(state: list[float], values: np.ndarray) -> None:
        state[:] = min(state[0], float(values.min())), max(state[1], float(values.max()))

    def extremes(state: list[float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x if np.isfinite(x) else None], pa.float64()) for x in state], ["low", "high"])

    ends = _folded(pairs, lambda: [np.inf, -np.inf], widen, extremes, "low double, high double").agg(F.min("low").alias("low"), F.max("high").alias("high")).first()
    spark = vectors.sparkSession
    schema = "bin int, low double, high double, pairs bigint"
    if ends["low"] is None:
        return spark.createDataFrame([], schema)
    low, high = ends["low"], ends["high"]
    width = (high - low) / bins

    def count(state: np.ndarray, values: np.ndarray) -> None:
        at = np.minimum(((values - low) / width).astype(np.int64), bins - 1) if width else np.full(len(values), bins - 1)
        state += np.bincount(at, minlength=bins)

    def counted(state: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.arange(1, bins + 1), pa.int32()), pa.array(state, pa.int64())], ["bin", "n"])

    counts = _folded(pairs, lambda: np.zeros(bins, np.int64), count, counted, "bin int, n bigint").groupBy("bin").agg((2 * F.sum("n")).alias("pairs"))
    every = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    edge = lambda i: F.lit(low) + i * F.lit(width)
    joined = every.join(F.broadcast(counts), "bin", "left")
    return joined.select("bin", edge(F.col("bin") - 1).alias("low"), edge(F.col("bin")).alias("high"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def mean_similarity(vectors: DataFrame, size: int) -> DataFrame:
    """pairs, mean of all pairs of unit vectors of `size` numbers, in one pass: (|sum of v|^2 - sum of |v|^2) / (n (n - 1))."""
    sums = [F.sum(F.get("embedding", F.lit(i))).alias(f"s{i}") for i in range(size)]
    own = F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("own")
    totals = vectors.agg(F.count("*").alias("n"), own, *sums)
    square = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, size)), F.col("s0") * F.col("s0"))
    pairs = F.col("n") * (F.col("n") - 1)
    return totals.select(pairs.alias("pairs"), F.when(F.col("n") > 1, (square - F.col("own")) / pairs).alias("mean"))
