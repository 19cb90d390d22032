import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from thinwell.llm import neighbours as nb
from thinwell.llm import varied_subset as vs
from pyspark.sql import functions as F

SCHEMA = "id bigint, embedding array<float>, key int, part int"


def clustered(n, seed=0, groups=60):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    return (centres[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, 64))).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 0, 0) for i, v in rows], SCHEMA)


def exact(x, ids, k=nb.K):
    u = nb.unit(x)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {ids[i]: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[: min(k, len(ids) - 1)]] for i in range(len(ids))}


def test_one_partition_is_exact(spark):
    x = clustered(120)
    got = {}
    for r in nb.nearest(frame(spark, enumerate(x))).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == exact(x, list(range(120)))


def test_copies_and_bad_vectors(spark):
    x = clustered(30, groups=3)
    rows = [(i, x[i]) for i in range(30)] + [(100 + i, x[0]) for i in range(20)] + [(3, x[3])]
    rows += [(200, None), (201, [0.0] * 64), (202, [1.0] * 63), (203, [float("nan")] * 64), (204, [float("inf")] + [1.0] * 63), (None, x[1])]
    got = {}
    for r in nb.nearest(frame(spark, rows)).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert set(got) == {*range(30), *range(100, 120)}
    assert got[0] == [100, 101, 102, 103, 104] and got[119] == got[105] == [0, 100, 101, 102, 103] and got[101] == [0, 100, 102, 103, 104]
    assert nb.nearest(frame(spark, rows[:1])).count() == nb.nearest(frame(spark, [])).count() == 0
    assert {tuple(r) for r in nb.neighbour_pairs(frame(spark, rows[:2])).collect()} == {(0, 1)}


def test_recall_with_partitions_and_blocks(spark, monkeypatch):
    for name, value in (("PER_PARTITION", 150), ("MOST_PARTITIONS", 12), ("SAMPLE", 1_000), ("BLOCK", 100), ("QUERIES", 200)):
        monkeypatch.setattr(nb, name, value)
    x = clustered(2_000, 4)
    got = {}
    for r in nb.nearest(frame(spark, enumerate(x))).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = exact(x, list(range(2_000)))
    assert all(len(v) == nb.K for v in got.values())
    assert np.mean([len(got[i] & set(want[i])) / nb.K for i in want]) >= 0.95


def test_recall_with_two_levels(spark, monkeypatch):
    for name, value in (("ONE_LEVEL", 1_000), ("PER_PARTITION", 100), ("MOST_PARTITIONS", 16), ("SAMPLE", 1_000), ("PER_LEAF", 16)):
        monkeypatch.setattr(nb, name, value)
    x = clustered(3_000, 5)
    got = {}
    for r in nb.nearest(frame(spark, enumerate(x))).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = exact(x, list(range(3_000)))
    assert all(len(v) == nb.K for v in got.values()) and len(got) == 3_000
    assert np.mean([len(got[i] & set(want[i])) / nb.K for i in want]) >= 0.9


def test_leaves_of_a_tree():
    """The leaves found are those of the greatest product of both levels' probabilities; places without one repeat the best."""
    x = nb.unit(clustered(400, 1))
    root = nb.fit(x, 4)
    tree = nb.Tree(root, {p: nb.fit(x, 3, p) if p else None for p in range(4)})
    found = tree.best(x[:50], 5)
    for v, leaves in zip(x[:50], found):
        chance = {p * nb.MOST_PARTITIONS + c: s * i for p, s in enumerate(root.shares(v[None])[0]) for c, i in enumerate(tree.under[p].shares(v[None])[0] if tree.under[p] else [1.0])}
        assert leaves.tolist() == sorted(chance, key=lambda leaf: (-chance[leaf], leaf))[:5]
    few = nb.Tree(root, {}).best(x[:5], 6)
    assert (few[:, 4:] == few[:, :1]).all() and len(np.unique(few[0])) == 4


def test_partition_is_balanced():
    x = nb.unit(clustered(1_000, 2))
    label = nb.balanced_partition(x, nb.neighbour_graph(x, 10), 8, np.random.default_rng(1))
    sizes = np.bincount(label, minlength=8)
    assert sizes.sum() == 1_000 and sizes.max() <= math.ceil(125 * nb.SLACK)


def digest(i):
    return hashlib.md5(str(i).encode()).hexdigest()


def likest_before(v, h, others):
    return round(max([float(x @ v) for g, x in others if g < h], default=-2.0), 9)


def by_hand(x, classes, k):
    """The subset by the definition: anchors, leaders, cells and the round robin."""
    u, h = nb.unit(x), [digest(i) for i in range(len(x))]
    order = sorted(range(len(x)), key=h.__getitem__)
    sample = [(h[i], u[i]) for i in order[: vs.SAMPLE]]
    anchors = [v for _, _, v in sorted(((likest_before(v, g, sample), g, v) for g, v in sample), key=lambda t: t[:2])[: min(k, vs.ANCHORS)]]
    nearest = lambda v, of: sorted(of, key=lambda a: (-(v @ anchors[a]), a))
    heads = range(min(vs.GATHERERS, len(anchors)))
    head = [nearest(v, heads)[0] for v in anchors]
    near = {i: nearest(u[i], [a for a in range(len(anchors)) if head[a] in nearest(u[i], heads)[: vs.OPENED]])[: vs.REACH] for i in order}
    held = {a: [i for i in order if near[i][0] == a][: vs.HELD] for a in range(len(anchors))}
    likest = sorted((likest_before(u[i], h[i], [(h[j], u[j]) for b in near[i] for j in held[b]]), h[i], i) for a in held for i in held[a])
    leaders = {i for *_, i in likest[:k]}
    cells = {}
    for i in order:
        pool = [j for a in near[i] for j in held[a] if j in leaders]
        cells[i] = (max(pool, key=lambda j: u[i] @ u[j]) if pool else f"a{near[i][0]}", classes.get(i, "none"))
    size = Counter(cells.values())
    place = {}
    for leader in {c[0] for c in size}:
        for n, c in enumerate(sorted((c for c in size if c[0] == leader), key=lambda c: (-size[c], f"{c[0]}/{c[1]}"))):
            place[c] = n
    seen, ranked = Counter(), []
    for i in order:
        seen[cells[i]] += 1
        ranked.append((seen[cells[i]], place[cells[i]], -size[cells[i]], "/".join(map(str, cells[i])), i))
    return {r[-1] for r in sorted(ranked)[:k]}


@pytest.mark.parametrize("bounds", [None, (150, 12, 8, 2, 4, 2)])
def test_varied_subset_equals_the_definition(spark, monkeypatch, bounds):
    for name, value in zip(("SAMPLE", "ANCHORS", "HELD", "REACH", "GATHERERS", "OPENED"), bounds or ()):
        monkeypatch.setattr(vs, name, value)
    x = clustered(500, 7, 30)
    x[:180] = x[0] + 0.001 * x[:180]
    docs = spark.read.parquet("/root/testdata/sf0.001/source_docs.parquet")
    classes = {r.row_id: r.c for r in docs.select("row_id", vs.image_class(F.coalesce(F.hex(F.substring(F.get("images.bytes", F.lit(0)), 1, 32)), F.lit(""))).alias("c")).collect()}
    for one_in in (20, 3, 1):
        rows = vs.varied_subset(frame(spark, enumerate(x)), docs, one_in).collect()
        k = -(-500 // one_in)
        assert len(rows) == k and {r.id for r in rows} == by_hand(x, classes, k)


def test_variety(spark):
    """Of the groups of like vectors of a whole table nearly all are represented, and few chosen rows are alike."""
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embedded_rows.parquet")
    chosen = {r.id for r in vs.varied_subset(rows, spark.read.parquet(f"{folder}/source_docs.parquet")).collect()}
    held = {r.id: r.embedding for r in rows.where(F.col("id").isNotNull() & vs.valid_vector("embedding", 64)).collect()}
    ids = sorted(held)
    u = nb.unit(np.array([held[i] for i in ids], np.float32))
    group = np.full(len(u), -1)
    for i in range(len(u)):
        if group[i] < 0:
            group[i], todo = i, [i]
            while todo:
                more = np.nonzero((u @ u[todo.pop()] >= 0.8) & (group < 0))[0]
                group[more] = i
                todo += more.tolist()
    at = np.array([n for n, i in enumerate(ids) if i in chosen])

    def twins(at):
        s = u[at] @ u[at].T
        np.fill_diagonal(s, 0)
        return (s.max(axis=1) > 0.95).sum()

    drawn = [np.random.default_rng(seed).choice(len(u), len(at), replace=False) for seed in range(5)]
    assert len(at) == -(-len(u) // 20) and len(np.unique(group[at])) >= 0.9 * len(np.unique(group))
    assert twins(at) < np.mean([twins(d) for d in drawn]) / 4
    assert max(Counter(group[at].tolist()).values()) / len(at) < 0.03


def test_varied_subset_edges(spark):
    docs = spark.createDataFrame([], "row_id bigint, images array<struct<bytes: binary, path: string>>")
    x = clustered(3)
    rows = [(1, x[0]), (1, x[0]), (2, None), (3, [0.0] * 64), (4, [1.0] * 10), (None, x[1])]
    assert [r.id for r in vs.varied_subset(frame(spark, rows), docs).collect()] == [1]
    assert vs.varied_subset(frame(spark, []), docs).count() == 0
    same = vs.varied_subset(frame(spark, [(i, x[0]) for i in range(50)]), docs, 10).collect()
    assert len(same) == 5


def test_image_classes(spark):
    from thinwell.functions.images import encode_png

    png = encode_png(np.zeros((20, 16), np.uint8))
    pgm = b"P5\n21 18\n255\n" + bytes(378)
    df = spark.createDataFrame([(png,), (pgm,), (b"P5 junk",), (b"",), (png[:20],)], "b binary").select(vs.image_class(F.hex(F.substring("b", 1, 32))).alias("c"))
    assert [r.c for r in df.collect()] == ["png" + str((320).bit_length()), "pgm" + str((378).bit_length()), "none", "none", "none"]
