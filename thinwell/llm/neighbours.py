"""Problem 4: the k most similar vectors of every vector, by learned partitions.

Fit, on a bounded sample: a neighbour graph, its balanced partition (balanced
k-means as a start, then moves along graph edges under a size limit), and a small
classifier that learns, from a vector, the distribution of its graph neighbours
over the partitions (after Dong et al., 2020). Then every vector is stored in its
most probable partition and searches the most probable ones, exactly and in double
precision. How many it searches is measured: for ASKED vectors the true neighbours among all
vectors are found in one pass, and so many partitions are searched, at least PROBES, that WANTED of them
lie there. So recall does not depend on how many vectors there are and how they lie.

One level of partitions serves up to ONE_LEVEL vectors. Beyond, each partition is
partitioned again in the same way, fitted on a bounded sample of its own vectors, so
that a leaf holds about PER_PARTITION vectors at any number up to MOST_PARTITIONS
squared times that (some hundred million); a search then takes the leaves that are most
probable by both levels together. What is shuffled a vector does not grow with their number.

Copies of one vector are collapsed before the search and expanded after it. A
partition is stored in blocks of at most BLOCK vectors and its queries are split
likewise, so no task holds more than one block and one part of the queries,
however large a partition is.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thinwell.functions.vectors import valid_vector
from thinwell.sources.session import cut

K = 5
SIZE = 64
#: Vectors the partition and the classifier are fitted on, at most.
SAMPLE = 8_192
#: Vectors a partition holds on average, and the most partitions: of each the sample has 32 vectors.
PER_PARTITION, MOST_PARTITIONS = 1_500, SAMPLE // 32
#: Vectors up to which one level is enough, those of one partition that the second level is fitted on, at most, and of each leaf.
ONE_LEVEL, LEAF_SAMPLE, PER_LEAF = 300_000, 8_192, 64
#: Leaves that are searched at least, vectors whose true neighbours are found to tell how many more, the share of those that have to be reached,
#: and, with two levels, the most probable partitions that leaves are looked for in.
PROBES, ASKED, WANTED, REACHED = 4, 512, 0.95, 16
#: Leaves that are searched at most.
MOST_PROBES = 128
BLOCK, QUERIES = 4_096, 8_192
GRAPH, SLACK, HIDDEN, EPOCHS = 10, 1.15, 64, 40


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at unit length, in double precision; scaled first, so that no finite row overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the positions of its `k` most similar other rows."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for low in range(0, len(x), 1024):
        s = x[low : low + 1024] @ x.T
        s[np.arange(len(s)), np.arange(low, low + len(s))] = -2
        out[low : low + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A partition label for each row: no part over SLACK times the mean, few graph edges cut."""
    most = math.ceil(len(x) / parts * SLACK)
    centres = x[rng.choice(len(x), parts, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(8):
        s = x @ centres.T
        label[:] = -1
        room = np.full(parts, most)
        # Vectors with the clearest preference choose first; who finds a part full asks the next best.
        ranked = np.argsort(-s, axis=1)[:, : min(parts, 24)]
        best = -np.sort(-s, axis=1)
        for i in np.argsort(-(best[:, 0] - best[:, min(1, parts - 1)]), kind="stable"):
            for p in ranked[i]:
                if room[p] > 0:
                    break
            else:
                p = int(np.argmax(room))
            label[i] = p
            room[p] -= 1
        centres = np.stack([x[label == p].mean(axis=0) if (label == p).any() else x[rng.integers(len(x))] for p in range(parts)])
    size = np.bincount(label, minlength=parts)
    for _ in range(6):
        moved = 0
        for i in rng.permutation(len(x)):
            votes = np.bincount(label[graph[i]], minlength=parts)
            p = int(np.argmax(votes))
            if votes[p] > votes[label[i]] and size[p] < most:
                size[label[i]] -= 1
                size[p] += 1
                label[i] = p
                moved += 1
        if moved < len(x) // 200:
            break
    return label


class Router:
    """One hidden layer; trained with Adam on the cross entropy against soft labels."""

    def __init__(self, x: np.ndarray, target: np.ndarray, rng: np.random.Generator):
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)) * 2, np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, target.shape[1])), np.zeros(target.shape[1])]
        first, second, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS)
            order = rng.permutation(len(x))
            for low in range(0, len(x), 256):
                part = order[low : low + 256]
                h = np.maximum(x[part] @ self.w[0] + self.w[1], 0)
                error = (self._softmax(h @ self.w[2] + self.w[3]) - target[part]) / len(part)
                back = (error @ self.w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x[part].T @ back, back.sum(axis=0), h.T @ error, error.sum(axis=0))):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    @classmethod
    def of(cls, weights: list[np.ndarray]) -> Router:
        made = cls.__new__(cls)
        made.w = weights
        return made

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def shares(self, x: np.ndarray) -> np.ndarray:
        """The probability of each partition for each row."""
        return self._softmax(np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        """The `n` most probable partitions of each row, best first."""
        return np.argsort(-self.shares(x), axis=1, kind="stable")[:, :n]


class Tree:
    """A router to partitions and, of each partition, one to its leaves; None for a partition that is one leaf."""

    def __init__(self, root: Router, under: dict[int, Router | None]):
        self.root, self.under = root, under

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        """The `n` most probable leaves of each row, best first; a leaf is numbered partition * MOST_PARTITIONS + its own number."""
        shares = self.root.shares(x)
        near = np.argsort(-shares, axis=1, kind="stable")[:, :REACHED]
        leaf, chance = np.zeros((len(x), near.shape[1], n), np.int64), np.full((len(x), near.shape[1], n), -1.0)
        for p in np.unique(near).tolist():
            row, at = np.nonzero(near == p)
            router = self.under.get(p)
            inside = router.shares(x[row]) if router else np.ones((len(row), 1))
            first = np.argsort(-inside, axis=1, kind="stable")[:, :n]
            leaf[row, at, : first.shape[1]] = p * MOST_PARTITIONS + first
            chance[row, at, : first.shape[1]] = np.take_along_axis(inside, first, axis=1) * shares[row, p][:, None]
        leaf, chance = leaf.reshape(len(x), -1), chance.reshape(len(x), -1)
        # With fewer leaves than n, places without one repeat the best leaf.
        order = np.argsort(-chance, axis=1, kind="stable")[:, :n]
        found = np.take_along_axis(leaf, order, axis=1)
        return np.where(np.take_along_axis(chance, order, axis=1) < 0, found[:, :1], found)


def fit(sample: np.ndarray, parts: int, seed: int = 7) -> Router | None:
    """A router to `parts` partitions; None where one partition is enough."""
    if parts < 2:
        return None
    rng = np.random.default_rng(seed)
    graph = neighbour_graph(sample, GRAPH)
    label = balanced_partition(sample, graph, parts, rng)
    target = np.zeros((len(sample), parts))
    for column in (*graph.T, np.arange(len(sample))):
        target[np.arange(len(sample)), label[column]] += 1 / (graph.shape[1] + 1)
    return Router(sample, target, rng)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), -1)


def _route(router: Router | Tree | None, probes: int):
    """key, vector to key, vector and the partitions to search, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)
            parts = router.best(unit(flat), probes) if router else np.zeros((batch.num_rows, 1), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * parts.shape[1], pa.int32()), pa.array(parts.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([x.tobytes() for x in flat], pa.binary()), lists], ["key", "vector", "parts"])

    return run


def _fit_leaves(leaves: int):
    """Samples of one partition to the pickled weights of the router to its leaves; none where the partition is one leaf."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        x = unit(_matrix(table.column("vector").combine_chunks()))
        router = fit(x, min(leaves, len(x) // PER_LEAF), 7 + part)
        weights = [] if router is None else [w.astype(np.float32) for w in router.w]
        return pa.table({"part": pa.array([part], pa.int32()), "weights": pa.array([pickle.dumps(weights)], pa.binary())})

    return run


def _tree(reps: DataFrame, root: Router, leaves: int) -> Tree:
    """The second level: a router of each partition, fitted on at most LEAF_SAMPLE of its vectors.

    At most MOST_PARTITIONS routers of some 80 kB reach the driver.
    """
    routed = reps.mapInArrow(_route(root, 1), "key bigint, vector binary, parts array<int>").select(F.get("parts", F.lit(0)).alias("part"), "key", "vector")
    order = Window.partitionBy("part").orderBy(F.xxhash64("key", F.lit(5)), "key")
    sample = routed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= min(LEAF_SAMPLE, leaves * 4 * PER_LEAF)).select("part", "vector")
    fitted = sample.groupBy("part").applyInArrow(_fit_leaves(leaves), "part int, weights binary").collect()
    return Tree(root, {row["part"]: Router.of(weights) if (weights := pickle.loads(row["weights"])) else None for row in fitted})


def _truly_near(asked: np.ndarray, asked_keys: np.ndarray, router: Router | Tree):
    """key, embedding of all vectors to the K of each task that are most similar to each asked one, with the leaf that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, leaf = np.full((len(asked), K), -2.0), np.full((len(asked), K), -1, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1))
            s = asked @ x.T
            s[asked_keys[:, None] == batch.column("key").to_numpy()[None]] = -2
            s, leaves = np.concatenate([best, s], axis=1), np.concatenate([leaf, np.tile(router.best(x, 1)[:, 0], (len(asked), 1))], axis=1)
            top = np.argpartition(-s, K - 1, axis=1)[:, :K]
            best, leaf = np.take_along_axis(s, top, axis=1), np.take_along_axis(leaves, top, axis=1)
        rows, place = np.nonzero(leaf >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(best[rows, place]), pa.array(leaf[rows, place])], ["asked", "similarity", "leaf"])

    return run


def probes_wanted(reps: DataFrame, router: Router | Tree, leaves: int) -> int:
    """The least number of leaves, from PROBES on, in which WANTED of the true neighbours of ASKED vectors lie."""
    sample = reps.orderBy(F.xxhash64("key", F.lit(11)), "key").limit(ASKED).toPandas()
    asked, keys = unit(np.stack(sample["embedding"].to_numpy())), sample["key"].to_numpy()
    order = Window.partitionBy("asked").orderBy(F.desc("similarity"), "leaf")
    found = reps.mapInArrow(_truly_near(asked, keys, router), "asked int, similarity double, leaf bigint")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= K).toPandas()
    ranked = router.best(asked, leaves)[found["asked"].to_numpy()]
    at = ranked == found["leaf"].to_numpy()[:, None]
    places = np.sort(np.where(at.any(axis=1), at.argmax(axis=1), leaves))
    return int(min(max(PROBES, places[math.ceil(WANTED * len(places)) - 1] + 1), leaves)) if len(places) else PROBES


def _search(table: pa.Table) -> pa.Table:
    """The best K of one block of stored vectors for one part of the queries."""
    stored = np.array(table.column("stored").to_pylist(), bool)
    keys, x = table.column("key").to_numpy(), unit(_matrix(table.column("vector").combine_chunks()))
    have, base = keys[stored], x[stored]
    asked, out = keys[~stored], []
    order = np.argsort(have)
    have, base = have[order], base[order]
    k = min(K + 1, len(have))
    if k and len(asked):
        ask = x[~stored]
        for low in range(0, len(asked), 512):
            s = ask[low : low + 512] @ base.T
            top = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(have) else np.tile(np.arange(k), (len(s), 1))
            q = np.repeat(asked[low : low + 512], k)
            n = have[top].ravel()
            v = np.take_along_axis(s, top, axis=1).ravel()
            keep = q != n
            out.append((q[keep], n[keep], v[keep]))
    columns = [np.concatenate(c) if out else np.zeros(0, t) for c, t in zip(zip(*out) if out else ((), (), ()), (np.int64, np.int64, np.float64))]
    return pa.table({"key": pa.array(columns[0], pa.int64()), "near": pa.array(columns[1], pa.int64()), "similarity": pa.array(columns[2], pa.float64())})


def nearest(vectors: DataFrame, probes: int | None = None) -> DataFrame:
    """id, neighbour, similarity, place: the K most similar other ids of every valid id.

    Cosine in double precision, the lower id first on a tie. Vectors that are
    null, not of 64 numbers, not finite or all zero, and null ids, take no part;
    an id delivered twice counts once; with fewer than K + 1 valid ids there are
    fewer neighbours. Copies of a vector are found exactly, whatever their number.
    """
    valid = vectors.where(F.col("id").isNotNull() & valid_vector("embedding", SIZE))
    # The key of a vector is its least id; members know their copies by it.
    keyed = valid.select("id", "embedding", F.struct(F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")).alias("copy")).dropDuplicates(["id"])
    copies = keyed.groupBy("copy").agg(F.min("id").alias("key"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"))
    reps = cut(copies)
    members = keyed.select("id", "copy").join(reps.select("copy", "key", "copies"), "copy").select("id", "key", "copies")

    n = reps.count()
    leaves = max(1, n // PER_PARTITION)
    twice = n > ONE_LEVEL
    parts = min(MOST_PARTITIONS, math.ceil(math.sqrt(leaves)) if twice else leaves)
    router = None
    if parts > 1:
        sample = reps.select("embedding").orderBy(F.xxhash64("key", F.lit(3)), "key").limit(SAMPLE).toPandas()
        router = fit(unit(np.stack(sample["embedding"].to_numpy())), parts)
        if twice:
            router = _tree(reps.select("key", "embedding"), router, min(MOST_PARTITIONS, math.ceil(leaves / parts)))
        probes = probes or probes_wanted(reps.select("key", "embedding"), router, min(leaves, MOST_PROBES))
    probes = probes or PROBES
    routed = cut(reps.select("key", "embedding").mapInArrow(_route(router, probes), "key bigint, vector binary, parts array<int>"))

    held = routed.groupBy(F.get("parts", F.lit(0)).alias("part")).agg(F.count("*").alias("held"))
    asking = routed.select(F.explode(F.array_distinct("parts")).alias("part")).groupBy("part").agg(F.count("*").alias("asking"))
    shape = asking.join(held, "part").select("part", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asking") / QUERIES).cast("int").alias("splits"))
    shape = F.broadcast(shape)  # at most MOST_PARTITIONS squared rows
    stored = routed.select(F.get("parts", F.lit(0)).alias("part"), "key", "vector").join(shape, "part")
    stored = stored.select("part", F.pmod(F.xxhash64("key"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), F.lit(True).alias("stored"), "key", "vector")
    asked = routed.select(F.explode(F.array_distinct("parts")).alias("part"), "key", "vector").join(shape, "part")
    asked = asked.select("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("key"), "splits").cast("int").alias("split"), F.lit(False).alias("stored"), "key", "vector")
    found = stored.unionByName(asked).groupBy("part", "block", "split").applyInArrow(_search, "key bigint, near bigint, similarity double")
    order = Window.partitionBy("key").orderBy(F.desc("similarity"), "near")
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= K).select("key", "near", "similarity")

    # Of each copied vector the first K + 1 ids; a lone vector is its own key.
    copied = members.where("copies > 1").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= K + 1).select(F.col("key").alias("near"), F.col("id").alias("neighbour"))
    ids = reps.where("copies = 1").select(F.col("key").alias("near"), F.col("key").alias("neighbour")).unionByName(copied)
    own = copied.select(F.col("near").alias("key"), "neighbour", F.lit(1.0).alias("similarity"))
    pool = best.join(ids, "near").select("key", "neighbour", "similarity").unionByName(own)
    first = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")
    lists = pool.withColumn("r", F.row_number().over(first)).where(F.col("r") <= K + 1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r", "neighbour", "similarity"))).alias("pool"))
    chosen = F.slice(F.filter("pool", lambda p: p["neighbour"] != F.col("id")), 1, K)
    result = members.join(lists, "key").select("id", F.posexplode(chosen).alias("place", "p"))
    return result.select("id", F.col("p.neighbour").alias("neighbour"), F.col("p.similarity").alias("similarity"), (F.col("place") + 1).alias("place"))


def neighbour_pairs(vectors: DataFrame) -> DataFrame:
    """id_a, id_b: pairs of which at least one is among the K most similar of the other."""
    return nearest(vectors).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
