import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thinwell.operators import paging, selection
from thinwell.plans.config import SelectionConfig

RAW = "id bigint, embedding array<float>"
UNIT = "id bigint, embedding array<double>"


def vectors(n, seed=0, size=8):
    x = np.random.default_rng(seed).normal(size=(n, size))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], UNIT)


def by_hand(x, k, start=0):
    picks = [start]
    while len(picks) < min(k, len(x)):
        near = [min(1 - x[i] @ x[p] for p in picks) if i not in picks else -1 for i in range(len(x))]
        picks.append(int(np.argmax(near)))
    return picks


def test_greedy_matches_definition():
    x = vectors(40)
    for k in (1, 7, 40, 60):
        assert selection.greedy(x, k)[0].tolist() == by_hand(x, k)


def test_greedy_edges():
    x = np.tile(vectors(1), (4, 1))
    assert selection.greedy(x, 4, 2)[0].tolist() == [2, 0, 1, 3]
    assert len(selection.greedy(x, 0)[0]) == len(selection.greedy(x, -1)[0]) == len(selection.greedy(x[:0], 3)[0]) == 0


@given(st.integers(1, 30), st.integers(1, 40), st.integers(0, 5))
@settings(max_examples=40, deadline=None)
def test_coverage_never_grows_with_k(n, k, seed):
    x = vectors(n, seed)
    picks, at = selection.greedy(x, k)
    assert len(set(picks.tolist())) == min(k, n)
    assert all(a >= b - 1e-12 for a, b in zip(at[1:], at[2:]))


def test_distributed_passes_equal_one_task(spark):
    pool = frame(spark, vectors(50)).repartition(5)
    for start in (None, 7, 999):
        one = [(r.id, r.pick) for r in selection.greedy_kcenter(pool, 9, start).collect()]
        many = [(r.id, r.pick) for r in selection.greedy_kcenter(pool, 9, start, in_one_task=10).collect()]
        assert one == many
    assert selection.greedy_kcenter(pool, 80, in_one_task=10).count() == 50
    assert selection.greedy_kcenter(pool, 0).count() == 0
    assert selection.greedy_kcenter(pool.limit(0), 3).count() == 0


def test_passes_give_many_picks_and_write_distances(spark, monkeypatch):
    """Ties and copies included, whatever a task offers and however often distances are written."""
    x = vectors(120, 3)
    x[60:80] = x[:20]
    pool = frame(spark, x).repartition(4)
    one = [(r.id, r.pick, round(r.distance, 9)) for r in selection.greedy_kcenter(pool, 70).collect()]
    for offered, written in ((64, 256), (2, 5), (1, 1)):
        monkeypatch.setattr(selection, "OFFERED", offered)
        monkeypatch.setattr(selection, "WRITTEN_AFTER", written)
        assert [(r.id, r.pick, round(r.distance, 9)) for r in selection.greedy_kcenter(pool, 70, in_one_task=10).collect()] == one


def test_unit_vectors_drop_bad_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [3.0, 4.0]), (1, [3.0, 4.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (6, [1.0]), (7, [None, 1.0]), (None, [1.0, 0.0])]
    found = selection.unit_vectors(spark.createDataFrame(rows, RAW)).collect()
    assert [(r.id, r.embedding) for r in found] == [(1, [0.6, 0.8])]
    assert selection.unit_vectors(spark.createDataFrame([], RAW)).count() == 0


def test_two_stage_and_paged_do_not_depend_on_partitions(spark):
    config = SelectionConfig(total_samples=168, page_size=21, sample_size=7, local_size=6, final_size=10, shards=4)
    df = frame(spark, vectors(300))
    for paged in (False, True):
        results = [[r.id for r in selection.two_stage(df.repartition(p), config, paged).collect()] for p in (1, 7)]
        assert results[0] == results[1] == sorted(set(results[0])) and len(results[0]) == 10


def test_paged_coresets_fold_page_by_page(spark):
    x = vectors(84)
    config = SelectionConfig(page_size=21, sample_size=7, shards=2, total_samples=84)
    rows = paging.strided_pages(paging.sharded(frame(spark, x), 2), config, limited=False)
    got = {s: set() for s in (0, 1)}
    for r in selection.paged_coresets(rows, 5).collect():
        got[r.shard].add(r.id)
    for shard in (0, 1):
        ids = [i for i in range(84) if i % 2 == shard]
        held = np.zeros(0, int)
        for page in range(2):
            new = [ids[p] for p in range(page * 21, (page + 1) * 21) if p % 3 == 0]
            held = np.sort(np.concatenate([held, new]).astype(int))
            held = np.sort(held[by_hand(x[held], 5)])
        assert got[shard] == set(held.tolist())


def test_global_merge_raises_without_candidates(spark):
    with pytest.raises(ValueError, match="no candidates"):
        selection.global_merge(spark.createDataFrame([], UNIT), 3)


def test_coverage(spark, monkeypatch):
    x = vectors(30)
    monkeypatch.setattr(selection, "BLOCK", 2)
    monkeypatch.setattr(selection, "BESIDE", 7)
    pool = frame(spark, x)
    got = {r.id: r.distance for r in selection.coverage(pool, pool.where("id < 5")).collect()}
    assert np.allclose([got[i] for i in range(30)], np.maximum(1 - (x @ x[:5].T).max(axis=1), 0))
    monkeypatch.setattr(selection, "BLOCK", 20)
    assert {r.id: r.distance for r in selection.coverage(pool, pool.where("id < 5")).collect()} == pytest.approx(got)
    assert selection.coverage(pool, pool.limit(0)).count() == 0


@given(st.integers(0, 120), st.integers(1, 30), st.data())
@settings(max_examples=200, deadline=None)
def test_stride_closed_form_equals_reading(n, page, data):
    sample = data.draw(st.integers(1, page))
    pages = data.draw(st.integers(1, 6))
    config = SelectionConfig(page_size=page, sample_size=sample, total_samples=pages * page, shards=1)
    rows, kept = iter(range(n)), []
    try:
        for _ in range(pages):
            taken = 0
            while taken < page:
                kept.append(next(rows))
                taken += 1
                for _ in range(config.stride - 1):
                    next(rows)
                    taken += 1
    except StopIteration:
        pass
    assert kept == [p for p in range(n) if p % config.stride == 0 and p // config.page_rows < config.pages_per_shard]


def test_config_lists_every_mistake():
    with pytest.raises(ValueError, match="page_size.*final_size"):
        SelectionConfig(total_samples=10, page_size=20, sample_size=5, final_size=50, shards=2).resolved()
    with pytest.warns(UserWarning, match="prunes nothing"):
        made = SelectionConfig(total_samples=100_500).resolved()
    assert made.total_samples == 96_000 and made.stride == 7 and made.kept_per_page == 286 and made.page_rows == 2_002
