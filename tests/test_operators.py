import json
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thinwell.functions import images as codecs
from thinwell.functions.texts import extract_answer, prompt, strip
from thinwell.functions.vectors import cosine, dot
from thinwell.operators import collation, components, conversations, evaluation, images, models, numbering, paging, retrieval, similarity, training_rows
from thinwell.sources import readers, sinks, tables
from thinwell.streaming import coreset
from pyspark.sql import functions as F

TURNS = "row_id bigint, texts array<struct<user: string, assistant: string, source: string>>, extra int"
PAIR = "array<struct<bytes: binary, path: string>>"


def test_similarity_matches_numpy(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    for n in (2, 3, 40, 41):
        x = np.random.default_rng(n).normal(size=(n, 6))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
        s = (x @ x.T)[~np.eye(n, dtype=bool)]
        r = similarity.pairwise_stats(df).first()
        assert r.pairs == n * (n - 1)
        assert np.allclose([r.mean, r.median, r.std, r.low, r.high], [s.mean(), np.median(s), s.std(), s.min(), s.max()])
        counts = np.histogram(s, bins=50)[0]
        assert sum(r.pairs for r in similarity.pairwise_histogram(df).collect()) == n * (n - 1)
        if n > 3:
            assert [r.pairs for r in similarity.pairwise_histogram(df).orderBy("bin").collect()] == counts.tolist()
        assert math.isclose(similarity.mean_similarity(df, 6).first().mean, s.mean(), abs_tol=1e-9)
    assert similarity.pairwise_stats(df.limit(1)).first().pairs == similarity.pairwise_stats(df.limit(0)).first().pairs == 0
    assert similarity.pairwise_histogram(df.limit(0)).count() == 0


def test_blocks_of_vectors_are_not_shuffled(spark, monkeypatch):
    """Pairs of blocks are made of what lies in the shared folder, and a task's similarities come out as one row of counts."""
    monkeypatch.setattr(similarity, "BLOCK", 4)
    x = np.random.default_rng(1).normal(size=(90, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    blocks = similarity._blocks(df)
    pairs = similarity._block_pairs(blocks)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    got = [(min(r), max(r)) for r in pairs.select("a", "b").collect()]
    n = blocks.count()
    assert len(got) == len(set(got)) == n * (n + 1) // 2 and n >= 23
    assert pairs.rdd.getNumPartitions() <= similarity.TASKS * spark.sparkContext.defaultParallelism
    # However many pairs a task has, few are in its memory; the session's setting is as it was.
    before, finish = spark.conf.get(similarity.BATCH), lambda state: similarity.pa.RecordBatch.from_pydict({"n": [max(state)]})
    monkeypatch.setattr(similarity, "_values", lambda batch, i: iter([[0] * batch.num_rows]))
    most = similarity._folded(pairs, lambda: [0], lambda state, values: state.append(len(values)), finish, "n bigint")
    assert max(r.n for r in most.collect()) <= similarity.PAIRS_AT_ONCE and spark.conf.get(similarity.BATCH) == before


def test_median_in_finer_bins(spark, monkeypatch):
    """Many values in the median's bin are counted in finer bins; equal ones, and two ranks in bins far apart, come to an end."""
    monkeypatch.setattr(similarity, "BLOCK", 8)
    monkeypatch.setattr(similarity, "KEPT", 2)
    monkeypatch.setattr(similarity, "BINS", 256)
    monkeypatch.setattr(similarity, "LEVELS", 6)
    axes, crowd = np.eye(6), np.ones((31, 6)) + 1e-4 * np.random.default_rng(2).normal(size=(31, 6))
    # 60 pairs of two axes at 0, 45 + 15 pairs of one at 1: the two middle ranks are 0 and 1.
    halves = np.repeat(axes[:2], [10, 6], axis=0)
    for x in (crowd, halves, np.repeat(axes[:1], 20, axis=0)):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
        s = (x @ x.T)[~np.eye(len(x), dtype=bool)]
        assert math.isclose(similarity.pairwise_stats(df).first().median, np.median(s), abs_tol=1e-14)


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r.d for r in df.select(dot(F.col("a"), F.col("b")).alias("d")).collect()] == [24.0, 0.0, None, None]
    assert [r.c for r in df.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.96, None, None, None]


def test_components(spark):
    edges = [("x", a, a + 1) for a in range(0, 20)] + [("x", 100, a) for a in range(101, 140)] + [("y", 5, 4), ("y", 5, 5), ("y", 7, None)]
    found = components.connected_components(spark.createDataFrame(edges, "kind string, a bigint, b bigint"), ["kind"])
    roots = {(r.kind, r.node): r.root for r in found.collect()}
    assert roots == {("x", i): 0 for i in range(21)} | {("x", i): 100 for i in range(100, 140)} | {("y", 4): 4, ("y", 5): 4}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_numbering_and_batches(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", F.xxhash64("id"))
    rows = numbering.numbered(df, "k").collect()
    assert sorted(r.position for r in rows) == list(range(1000))
    assert [r.k for r in sorted(rows, key=lambda r: r.position)] == sorted(r.k for r in rows)
    assert {r.batch: r["count"] for r in numbering.batched(df, 300, "k").groupBy("batch").count().collect()} == {0: 300, 1: 300, 2: 300, 3: 100}
    assert numbering.numbered(df.limit(0), "k").count() == 0


def test_readers_of_a_world_are_disjoint(spark):
    df = spark.range(200)
    for epoch in (0, 1):
        parts = [[r.id for r in paging.rank_rows(df, 3, k, "id", 1, epoch).collect()] for k in range(3)]
        assert sorted(sum(parts, [])) == list(range(200))
    assert [r.id for r in paging.shuffled(df, "id", 4).collect()] == [r.id for r in paging.shuffled(df.repartition(3), "id", 4).collect()] != list(range(200))


def test_retrieval(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "row_id bigint, id string")
    chosen = spark.createDataFrame([(3,), (1,), (1,), (None,)], "id bigint")
    assert sorted(r.row_id for r in retrieval.selected_rows(source, chosen, "row_id").collect()) == [1, 3]
    rows = retrieval.ordered_batches(source, chosen.where("id is not null"), "row_id", 1).orderBy("position").collect()
    assert [(r.row_id, r.position, r.batch) for r in rows] == [(1, 0, 0), (3, 1, 1)]
    with pytest.raises(KeyError, match="9"):
        retrieval.ordered_batches(source, spark.createDataFrame([(9,)], "id bigint"), "row_id", 5)
    rows = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), (None, 4, "d"), (None, 3, "c"), ("x", 1, "a")], "k string, o int, v string")
    assert sorted((r.k or "", r.o, r.v) for r in retrieval.first_by_key(rows, ["k"], "o").collect()) == [("", 3, "c"), ("x", 1, "a")]
    twice = spark.createDataFrame([(1, "p", 5), (1, "p", 4), (2, None, 1)], "id bigint, v string, at int")
    assert sorted((r.id, r.v, r.at) for r in tables.first_delivery(twice, ["id"], "at").collect()) == [(1, "p", 4), (2, None, 1)]
    with pytest.raises(ValueError, match="no column"):
        tables.table(spark, "/root/testdata/sf0.001", "documents", "nothing")


CONVERSATIONS = [(1, [("q", "a", "s"), ("", "  ", None), (None, "b", "t")], 9), (2, [], 9), (3, None, 9), (4, [None, ("x" * 5000, None, "u")], 9)]


def test_conversations(spark):
    df = spark.createDataFrame(CONVERSATIONS, TURNS)
    flat = conversations.flatten(df, "row_id")
    assert sorted((r.row_id, r.turn_idx, r.field, r.text[:2]) for r in flat.collect()) == [(1, 0, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "  "), (1, 2, "assistant", "b"), (4, 1, "user", "xx")]
    mapped = conversations.map_texts(df, F.upper)
    batched = conversations.map_texts_batched(df, lambda ts: [t.upper() for t in ts], batch=2)
    rebuilt = conversations.rebuild(flat.withColumn("text", F.upper("text")), df, "row_id")
    results = [{r.row_id: (r.texts, r.extra) for r in d.collect()} for d in (mapped, batched, rebuilt)]
    assert results[0] == results[1] == results[2]
    assert results[0][1][0][1].user == "" and results[0][1][0][0].source == "s" and results[0][4][0][0] is None
    published = conversations.published(df.withColumn("images", F.lit(1)), F.upper)
    assert published.columns == ["images", "texts", "texts_en"] and published.where("row_id = 1" if "row_id" in published.columns else "size(texts) = 3").first().texts_en[0].user == "q"
    with pytest.raises(Exception, match="one text for each"):
        conversations.map_texts_batched(df, lambda ts: ts[1:]).collect()


def test_training_rows(spark):
    png = codecs.encode_png(np.zeros((2, 3), np.uint8))
    image = {"bytes": png, "path": None}
    rows = [
        (1, [image] * 8 + [image], [("q%d" % i, " a ", None) for i in range(5)]),
        (2, [{"bytes": b"no", "path": "p"}] + [image] * 8, [("q", "a", None)]),
        (3, [], [("q", "a", None)]),
        (4, [image], [("　", "a", None), ("q", None, None)]),
        (5, None, None),
        (6, [None, image], [("q", "a", None)] * 4),
    ]
    df = spark.createDataFrame(rows, f"row_id bigint, images {PAIR}, texts array<struct<user: string, assistant: string, source: string>>")
    got = {(r.row_id, r.chunk): r for r in training_rows.chat_rows(df, "row_id").collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0), (6, 0)}
    assert len(got[1, 0].images) == 8 and len(got[2, 0].images) == 7 and len(got[6, 0].images) == 1
    first = got[1, 0].messages
    assert [m.role for m in first] == ["user", "assistant"] * 4
    assert [p.type for p in first[0].content] == ["image"] * 8 + ["text"] and [p.type for p in first[2].content] == ["text"]
    assert first[1].content[0].text == "a" and len(got[1, 1].messages) == 2
    limited = training_rows.first_chunks(training_rows.qa_chunks(df, "row_id"), "row_id", 2).collect()
    assert [(r.row_id, r.chunk) for r in limited] == [(1, 0), (1, 1)]
    assert training_rows.first_chunks(training_rows.qa_chunks(df, "row_id"), "row_id", 0).count() == 0
    assert training_rows.training_steps(10, 4) == 3


def test_answers_and_prompts(spark):
    cases = {"A": "A", "A cat": "A", " b.": "B", "": "", "　C　": "C", "zzz": "X", "The answer is D": "D", "éA": "X", "E": "X", None: None, " \n": ""}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert [r.l for r in df.select(extract_answer(F.col("raw")).alias("l")).collect()] == list(cases.values())
    text = "  x​ \x1f\n"
    assert spark.createDataFrame([(text,)], "t string").select(strip(F.col("t"))).first()[0] == text.strip() == "x​"
    samples = spark.createDataFrame([("i", None, "Q?", ["a", None, "b"], {"bytes": b"x", "path": None}, None, " c ")], f"id string, subject string, question string, options array<string>, image_1 {PAIR[6:-1]}, image_2 {PAIR[6:-1]}, answer string")
    r = evaluation.prompts(samples).first()
    assert (r.gt, r.images) == ("C", 1) and r.prompt.startswith("<image>\n\nLook at") and "Question: Q?\n\nOptions:\na\nb\n\nAnswer with only" in r.prompt
    assert spark.range(1).select(prompt(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(0))).first()[0].startswith("Answer the following question.\n\nQuestion: \n\nOptions:\n\n\n")


PREDICTIONS = "run string, id int, subject string, raw string, gt string, error string"


def test_accuracy(spark):
    rows = [("r", 1, "s", "A", "A", None), ("r", 2, "s", "B", "B", None), ("r", 3, None, "C", "A", None), ("r", 4, "t", None, "A", "lost")]
    df = evaluation.scored(spark.createDataFrame(rows, PREDICTIONS))
    r = evaluation.accuracy(df).first()
    assert (r.total, r.right, r.errors, round(r.accuracy, 2)) == (3, 2, 1, 66.67)
    assert [(r.subject, r.right, r.total) for r in evaluation.accuracy_by_subject(df).collect()] == [("s", 2, 2), ("unknown", 0, 1)]
    assert [(r.seen, r.right, r.total) for r in evaluation.running_accuracy(df, "run", ["id"], 2).collect()] == [(2, 2, 2)]
    empty = evaluation.accuracy(df.limit(0)).first()
    assert (empty.total, empty.errors, empty.accuracy) == (0, 0, 0.0)


def test_collation(spark):
    assert collation.label_mask([1, 9, 8, 5, 6, 0, 7, 9, 8, 4], [9, 8], 0) == [-100] * 3 + [5, 6, 0] + [-100] * 3 + [4]
    assert collation.label_mask([9, 8], [], 0) == [-100, -100] and collation.label_mask([], [9], 0) == []
    df = spark.createDataFrame([(1, [1, 2, 3]), (1, [4]), (1, None), (2, [])], "batch int, input_ids array<bigint>")
    rows = collation.pad_batches(collation.masked_labels(df, [1], 3), "batch", 0).collect()
    assert sorted((r.batch, r.input_ids, r.attention_mask, r.labels) for r in rows) == [(1, [0, 0, 0], [0, 0, 0], [-100] * 3), (1, [1, 2, 3], [1, 1, 1], [-100, 2, 3]), (1, [4, 0, 0], [1, 0, 0], [-100] * 3), (2, [], [], [])]
    assert df.select(collation.fixed_length(F.col("input_ids"), 2, 9)).first()[0] == [1, 2]
    talk = [{"role": "user", "content": [{"type": "image", "text": None}] * 3 + [{"type": "text", "text": "hi"}]}]
    schema = "id int, messages array<struct<role: string, content array<struct<type: string, text: string>>>>, images array<int>".replace("content array", "content: array")
    rows = spark.createDataFrame([(1, talk, [1, 2, 3]), (2, None, None)], schema)

    def encode(messages, n):
        return [7] + [5] * (10 * n) + [3] * sum(p["type"] == "text" for m in messages for p in m["content"])

    got = {r.id: r for r in collation.collate(rows, encode, [7], 3, most=15).collect()}
    assert got[1].images == 1 and got[1].input_ids == [7] + [5] * 10 + [3] and got[1].labels[1:] == [5] * 10 + [3] and got[2].input_ids == [7]


def spans(ids, marker, end):
    """Labels by the definition: a marker opens a span up to and with the next end; markers inside spans count not."""
    labels, open_, free = [-100] * len(ids), False, 0
    for i, x in enumerate(ids):
        if not open_ and marker and i - len(marker) >= free and ids[i - len(marker) : i] == marker:
            open_ = True
        if open_:
            labels[i] = x
            if x == end:
                open_, free = False, i + 1
    return labels


@given(st.lists(st.lists(st.integers(0, 3), max_size=14), max_size=5), st.lists(st.integers(0, 3), max_size=3))
@settings(max_examples=300, deadline=None)
def test_label_masks_of_rows_end_to_end(rows, marker):
    flat, ends = np.array([x for r in rows for x in r], np.int64), np.cumsum([len(r) for r in rows], dtype=np.int64)
    assert collation.label_masks(flat, ends, marker, 0).tolist() == [x for r in rows for x in spans(r, marker, 0)]


def test_markers_and_null_rows(spark):
    part = lambda kind: {"type": kind, "text": None}
    talk = [{"role": "user", "content": [part("image"), part("text"), part("image")]}, {"role": "user", "content": None}, {"role": "user", "content": [part("image"), part("text")]}]
    kinds = lambda n: [[p["type"] for p in m["content"]] for m in collation.drop_markers(talk, n)]
    assert kinds(2) == [["image", "text", "image"], [], ["text"]] and kinds(0) == [["text"], [], ["text"]] and kinds(9) == [["image", "text", "image"], [], ["image", "text"]]
    df = spark.createDataFrame([(1, None), (2, [5, 1, 2]), (3, []), (4, [5])], "id int, input_ids array<bigint>")
    assert {r.id: r.labels for r in collation.masked_labels(df, [5], 2).collect()} == {1: None, 2: [-100, 1, 2], 3: [], 4: [-100]}


def test_colours_and_codecs(spark, tmp_path):
    x = np.random.default_rng(2).integers(0, 256, (6, 5, 3), dtype=np.uint8)
    assert (codecs.pixels_of(codecs.encode_png(x)) == x).all() and codecs.decode(codecs.encode_png(x)).shape == (6, 5)
    assert (codecs.pixels_of(b"P6 5 6 255\n" + x.tobytes()) == x).all()

    def png(depth, colour, rows, palette=b""):
        lines = b"".join(b"\0" + bytes(r) for r in rows)
        chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
        return codecs.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, len(rows), depth, colour, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    assert codecs.pixels_of(png(1, 0, [[0b10100000]])).tolist() == [[255, 0, 255]]
    assert codecs.pixels_of(png(16, 0, [[1, 9, 2, 9, 3, 9]])).tolist() == [[1, 2, 3]]
    assert codecs.pixels_of(png(2, 3, [[0b00011000]], bytes([0, 0, 0, 9, 8, 7, 1, 2, 3]))).tolist() == [[[0, 0, 0], [9, 8, 7], [1, 2, 3]]]
    assert codecs.pixels_of(png(2, 3, [[0b11000000]], bytes([0, 0, 0, 9, 8, 7]))) is None and codecs.pixels_of(png(4, 2, [[0]])) is None
    jpeg = lambda data: x if data.startswith(b"\xff\xd8") else 1 / 0
    assert codecs.pixels_of(b"\xff\xd8..", jpeg) is x and codecs.pixels_of(b"junk", jpeg) is None
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(codecs.encode_png(x))
    rows = [(1, (None, "a/x.png")), (2, (None, str(tmp_path / "a" / "x.png"))), (3, (None, "no.png")), (4, (b"held", "a/x.png")), (5, None)]
    df = spark.createDataFrame(rows, "id int, image struct<bytes: binary, path: string>")
    found = {r.id: r.image and r.image.bytes for r in images.with_files(df, "image", str(tmp_path)).collect()}
    assert (codecs.pixels_of(bytes(found[1])) == x).all() and found[1] == found[2] and found[3] is None and found[4] == b"held" and found[5] is None
    made = images.normalised(df.where("id = 4").withColumn("image", F.lit(codecs.encode_png(x))), "image", most=3).first()
    assert codecs.pixels_of(bytes(made.png)).shape == (3, 2, 3)


def test_image_columns_of_any_type(spark):
    df = spark.sql("select cast('ab' as binary) b, 'p' s, struct(cast('c' as binary) bytes) t, 7 n, array('x', null) l, cast(null as binary) z")
    got = {c: images.with_images(df, c).first()[c] for c in df.columns}
    assert (bytes(got["b"].bytes), got["b"].path, got["s"].bytes, got["s"].path) == (b"ab", None, None, "p")
    assert bytes(got["t"].bytes) == b"c" and got["n"] is None and got["z"] is None and [i and i.path for i in got["l"]] == ["x", None]


def test_broken_images_are_not_valid(spark):
    good = codecs.encode_png(np.zeros((4, 4), np.uint8))
    docs = spark.createDataFrame([(1, [("q", "a", None)], [(good[:40], None), (good, "p")]), (2, [("q", "a", None)], [(good[:40], None)]), (3, [("q", "a", None)], None)], "row_id bigint, texts array<struct<user: string, assistant: string, source: string>>, images array<struct<bytes: binary, path: string>>")
    assert [(r.row_id, len(r.images), r.images[0].path) for r in training_rows.chat_rows(docs, "row_id").collect()] == [(1, 1, "p")]
    assert sorted((r.row_id, r.valid, r.unread) for r in images.valid_images(docs, "row_id").collect()) == [(1, 1, 1), (2, 0, 1), (3, 0, 0)]
    assert training_rows.qa_chunks(docs, "row_id", valid=training_rows.looks_like_image).count() == 2


def test_first_delivery_and_shards_keep_rows_exact(spark, tmp_path):
    rows = [(1, 5, "b"), (1, 5, "a"), (1, 7, "0"), (2, 5, "c"), (2, 5, "c"), (3, 9, "d"), (None, 1, "n"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "id bigint, at int, v string")
    got = sorted(((r.id or 0), r.at, r.v) for r in tables.first_delivery(df, ["id"], "at").collect())
    assert got == [(0, 1, "n"), (0, 1, "n"), (1, 5, "a"), (2, 5, "c"), (3, 9, "d")]
    assert tables.first_delivery(df.where("id = 3"), ["id"], "at").count() == 1 and tables.first_delivery(df.limit(0), ["id"], "at").count() == 0
    assert sinks.write_shards(df.select("id", "v"), str(tmp_path / "s"), 3, "id") == 3
    names = sorted(p.name for p in (tmp_path / "s").glob("train-*"))
    held = [[r.id for r in spark.read.parquet(str(tmp_path / "s" / n)).collect()] for n in names]
    assert [len(h) for h in held] == [3, 3, 2] and sorted(x or 0 for h in held for x in h) == [0, 0, 1, 1, 1, 2, 2, 3]


def test_scan_predicate_of_selected_ids(spark):
    source = spark.range(100).withColumnRenamed("id", "key")
    ids = spark.createDataFrame([(7,), (9,), (7,), (None,)], "id bigint")
    assert sorted(r.key for r in retrieval.selected_rows(source, ids, "key").collect()) == [7, 9]
    assert retrieval.selected_rows(source, ids.limit(0), "key").count() == 0


def test_images(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (30, 20), dtype=np.uint8)
    assert (codecs.decode(codecs.encode_png(x)) == x).all()
    assert (codecs.decode(b"P5\n# note\n20 30\n255\n" + x.tobytes()) == x).all()
    for bad in (None, b"", b"junk", codecs.encode_png(x)[:40], b"P5 20 30 255\n123", codecs.PNG):
        assert codecs.decode(bad) is None
    assert images.scale(x, 10).shape == (10, 6) and images.scale(np.full((9, 5), 7, np.uint8), 4).tolist() == [[7, 7]] * 4
    (tmp_path / "a.png").write_bytes(codecs.encode_png(x))
    files = readers.image_files(spark, str(tmp_path), "*.png")
    made = images.normalised(files, "image", most=None).first()
    assert (codecs.decode(made.png) == x).all()
    df = spark.createDataFrame([(1, codecs.encode_png(x)), (2, b"junk"), (3, None)], "id int, data binary")
    vectors = {r.id: r.embedding for r in images.embed(df, "data", lambda ps: np.array([[3.0, 4.0]] * len(ps))).collect()}
    assert np.allclose(vectors[1], [0.6, 0.8]) and vectors[2] is vectors[3] is None
    w, h = images.scaled_size(F.lit(2240), F.lit(1000))
    assert spark.range(1).select(w, h).first()[:] == (1120, 500)


def test_png_filters():
    import struct
    import zlib

    x = np.random.default_rng(2).integers(0, 256, (5, 4), dtype=np.uint8).astype(int)
    lines = []
    for y in range(5):
        line = [y]
        for c in range(4):
            a, b, d = (x[y, c - 1] if c else 0), (x[y - 1, c] if y else 0), (x[y - 1, c - 1] if y and c else 0)
            p = a + b - d
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d)))[2]
            line.append(int(x[y, c] - [0, a, b, (a + b) // 2, paeth][y]) % 256)
        lines.append(bytes(line))
    parts = ((b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"".join(lines))), (b"IEND", b""))
    data = codecs.PNG + b"".join(struct.pack(">I", len(d)) + k + d + b"0000" for k, d in parts)
    assert (codecs.decode(data) == x).all()


def test_models(spark):
    def answer(text):
        if text == "bad":
            raise RuntimeError("out of memory")
        return text.upper()

    rows = models.generate(spark.createDataFrame([("hi",), ("bad",), (None,)], "prompt string"), answer).collect()
    assert [(r.raw, r.error) for r in rows] == [("HI", None), (None, "out of memory"), (None, "no prompt")]


def test_sinks_and_sources(spark, tmp_path):
    df = spark.range(0, 25, 1, 3).select("id", F.array(F.lit(1.0)).alias("embedding"))
    out = str(tmp_path / "shards")
    assert sinks.write_shards(df, out, 10, "id") == 3
    names = sorted(p.name for p in (tmp_path / "shards").iterdir() if p.name.startswith("train"))
    assert names == [f"train-0000{i}-of-00003.parquet" for i in range(3)]
    assert [[r.id for r in spark.read.parquet(f"{out}/{n}").collect()] for n in names] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    sinks.write_selection(df, str(tmp_path / "sel"))
    assert spark.read.parquet(str(tmp_path / "sel")).count() == 25
    sinks.write_predictions(spark.createDataFrame([("a", None)], "id string, error string"), str(tmp_path / "json"))
    lines = [json.loads(x) for p in (tmp_path / "json").glob("part*") for x in p.read_text().splitlines()]
    assert lines == [{"id": "a"}]
    assert readers.row_at(df, "id", 7)["id"] == 7 and readers.row_at(df, "id", 99) is None
    assert sorted(r.a for r in readers.generated(spark, lambda part: ((part * 10 + i,) for i in range(3)), "a bigint", 2).collect()) == [0, 1, 2, 10, 11, 12]


def test_streaming(spark, tmp_path):
    raw = "id bigint, embedding array<float>"
    x = np.random.default_rng(3).normal(size=(40, 4))
    source = tmp_path / "in"
    running = coreset.RunningCoreset(str(tmp_path / "state"), 6)
    for part in range(2):
        rows = [(i, x[i].tolist()) for i in range(part * 20, part * 20 + 20)]
        spark.createDataFrame(rows, raw).coalesce(1).write.mode("append").parquet(str(source))
        running.start(spark.readStream.schema(raw).parquet(str(source)), str(tmp_path / "checkpoint")).awaitTermination()
    versions = [{r.id for r in running.read(spark, v).collect()} for v in (1, 2)]
    assert len(versions[0]) == len(versions[1]) == 6 and max(versions[0]) < 20
    held = sorted(versions[0] | set(range(20, 40)))
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    from thinwell.operators.selection import greedy

    assert versions[1] == {held[i] for i in greedy(u[held], 6)[0]}
    running.merge(spark.createDataFrame([(i, x[i].tolist()) for i in range(20, 40)], raw), 1)
    assert {r.id for r in running.read(spark, 2).collect()} == versions[1]
    made = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00") for i in range(30)], "event_id bigint, t string").select("event_id", F.to_timestamp("t").alias("ts"), F.lit("x").alias("event_type"))
    made.write.parquet(str(tmp_path / "events"))
    events = spark.readStream.schema("event_id bigint, ts timestamp, event_type string").parquet(str(tmp_path / "events"))
    query = coreset.windowed_counts(events, "ts", "5 minutes", "10 minutes", "event_type").writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("windows").collect())[:2] == [10, 10]
