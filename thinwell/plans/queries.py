"""The queries of the core operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thinwell.functions.texts import BLANKS, extract_answer, shard_name
from thinwell.functions.vectors import valid_vector
from thinwell.operators import collation, conversations, evaluation, images, paging, retrieval, selection, similarity, training_rows
from thinwell.operators.numbering import batched
from thinwell.plans.config import SelectionConfig
from thinwell.sources.tables import first_delivery, table

Query = Callable[[SparkSession, str], DataFrame]

#: Every page of every shard is read: the limit on pages is lifted in the queries but for shard_page_limit.
CONFIG = SelectionConfig(total_samples=168, page_size=21, sample_size=7, local_size=12, final_size=20, shards=4)
K = 25
SIZE = 64
BATCH = 500


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return selection.unit_vectors(table(s, d, "embedded_rows", "id", "embedding"), size=SIZE)


def _docs(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """Source documents, a row delivered twice once."""
    return first_delivery(table(s, d, "source_docs", "row_id", "ingested_at", *columns), ["row_id"], "ingested_at").select("row_id", *columns)


def _predictions(s: SparkSession, d: str) -> DataFrame:
    return first_delivery(table(s, d, "predictions"), ["run_id", "id"], "answered_at")


def _pages(s: SparkSession, d: str, limited: bool) -> DataFrame:
    rows = paging.strided_pages(paging.sharded(_vectors(s, d), CONFIG.shards), CONFIG, limited=limited)
    return rows.select("shard", "page", "position", "id")


def _greedy(s: SparkSession, d: str) -> DataFrame:
    return selection.greedy_kcenter(_vectors(s, d), K).select("id", "pick")


def _two_stage(s: SparkSession, d: str, paged: bool = True) -> DataFrame:
    return selection.two_stage(table(s, d, "embedded_rows", "id", "embedding"), CONFIG, paged).select("id")


def _kept(s: SparkSession, d: str) -> DataFrame:
    return paging.strided_pages(paging.sharded(_vectors(s, d), CONFIG.shards), CONFIG, limited=False)


def _local(s: SparkSession, d: str) -> DataFrame:
    return selection.local_coresets(_kept(s, d), CONFIG.local_size).select("shard", "id", "pick")


def _incremental(s: SparkSession, d: str) -> DataFrame:
    return selection.paged_coresets(_kept(s, d), CONFIG.local_size).select("shard", "id")


def _coverage(s: SparkSession, d: str) -> DataFrame:
    pool = _vectors(s, d)
    return selection.coverage(pool, selection.greedy_kcenter(pool, K)).select("id", F.round("distance", 6).alias("distance"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    stats = similarity.pairwise_stats(_vectors(s, d))
    return stats.select("pairs", *(F.round(c, 6).alias(c) for c in ("mean", "median", "std", "low", "high")))


def _mean(s: SparkSession, d: str) -> DataFrame:
    return similarity.mean_similarity(_vectors(s, d), SIZE).select("pairs", F.round("mean", 6).alias("mean"))


def _shard_stats(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "embedded_rows", "id", "embedding").where("id is not null")
    rows = rows.groupBy("id").agg(F.min("embedding").alias("embedding")).select("id", valid_vector("embedding", SIZE).alias("valid"))
    return paging.shard_stats(paging.sharded(rows, CONFIG.shards), CONFIG)


def _selected_docs(s: SparkSession, d: str) -> DataFrame:
    return retrieval.selected_rows(_docs(s, d, "corpus"), _two_stage(s, d), "row_id").select("row_id", "corpus")


def _ordered(s: SparkSession, d: str) -> DataFrame:
    source = _docs(s, d, "corpus")
    known = _vectors(s, d).select("id").join(source.select(F.col("row_id").alias("id")), "id", "left_semi")
    rows = retrieval.ordered_batches(source, known, "row_id", BATCH)
    shards = -(-known.count() // BATCH)
    return rows.withColumn("shard_name", shard_name(F.col("batch"), F.lit(shards))).select("row_id", "corpus", "position", "batch", "shard_name")


def _dedup(s: SparkSession, d: str) -> DataFrame:
    return retrieval.first_by_key(table(s, d, "documents", "text", "doc_id", "source"), ["text"], "doc_id").select("doc_id", "text", "source")


def _each_turn(docs: DataFrame) -> DataFrame:
    turns = docs.select("row_id", F.posexplode("texts").alias("turn_idx", "t"))
    return turns.select("row_id", "turn_idx", F.col("t.user").alias("user_text"), F.col("t.assistant").alias("assistant_text"), F.col("t.source").alias("source"))


def _flatten(s: SparkSession, d: str) -> DataFrame:
    return conversations.flatten(_docs(s, d, "texts"), "row_id")


def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d, "texts")
    flat = conversations.flatten(docs, "row_id").withColumn("text", F.concat(F.lit("<"), "text", F.lit(">")))
    return _each_turn(conversations.rebuild(flat, docs, "row_id"))


def _mapped(s: SparkSession, d: str) -> DataFrame:
    return _each_turn(conversations.map_texts(_docs(s, d, "texts"), lambda t: F.concat(F.lit("<"), t, F.lit(">"))))


def _mapped_batched(s: SparkSession, d: str) -> DataFrame:
    return _each_turn(conversations.map_texts_batched(_docs(s, d, "texts"), lambda texts: [f"<{t}>" for t in texts]))


def _qa(s: SparkSession, d: str) -> DataFrame:
    pairs = training_rows.valid_pairs(F.col("texts"))
    return _docs(s, d, "texts").select("row_id", F.posexplode(pairs).alias("place", "p")).select("row_id", "place", "p.question", "p.answer")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    rows = training_rows.qa_chunks(_docs(s, d, "texts", "images"), "row_id")
    return rows.select("row_id", "chunk", F.size("pairs").alias("n_pairs"), F.size("images").alias("n_images"), F.col("pairs")[0]["question"].alias("first_question"))


def _messages(s: SparkSession, d: str) -> DataFrame:
    rows = training_rows.chat_rows(_docs(s, d, "texts", "images"), "row_id")
    each = rows.select("row_id", "chunk", F.posexplode("messages").alias("place", "m"))
    return each.select("row_id", "chunk", "place", F.col("m.role").alias("role"), F.size("m.content").alias("n_parts"), F.element_at("m.content", -1)["text"].alias("text"))


def _limited_chunks(s: SparkSession, d: str) -> DataFrame:
    rows = training_rows.qa_chunks(_docs(s, d, "texts", "images"), "row_id").select("row_id", "chunk", F.size("pairs").alias("n_pairs"))
    return training_rows.first_chunks(rows, "row_id", 100)


def _answers(s: SparkSession, d: str) -> DataFrame:
    return _predictions(s, d).select("run_id", "id", extract_answer(F.col("raw")).alias("letter"))


def _percents(df: DataFrame) -> DataFrame:
    return df.withColumn("accuracy", F.round("accuracy", 6))


def _tokens(s: SparkSession, d: str) -> DataFrame:
    """id, input_ids of the items: the lengths of the question's words."""
    lengths = F.transform(F.split("question", " "), lambda w: F.length(w).cast("bigint"))
    return table(s, d, "eval_samples", "id", "question").select("id", lengths.alias("input_ids"))


def _joined(*names: str):
    return [F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in names]


def _label_mask(s: SparkSession, d: str) -> DataFrame:
    lead, tail = F.array(F.lit(-1).cast("bigint"), F.lit(-2).cast("bigint")), F.array(*(F.lit(x).cast("bigint") for x in (0, 7, 7)))
    marker = F.array(*(F.lit(x).cast("bigint") for x in (-3, -4)))
    rows = _tokens(s, d).withColumn("input_ids", F.concat(lead, "input_ids", marker, "input_ids", tail))
    return collation.masked_labels(rows, [-3, -4], 0).select("id", *_joined("labels"))


def _padded(s: SparkSession, d: str) -> DataFrame:
    rows = batched(_tokens(s, d), 16, "id")
    return collation.pad_batches(rows, "batch", 0, labels=None).select("id", "batch", *_joined("input_ids", "attention_mask"))


def _fixed(s: SparkSession, d: str) -> DataFrame:
    ids = collation.fixed_length(F.col("input_ids"), 32, 0)
    mask = F.transform(ids, lambda x: F.when(x == 0, 0).otherwise(1).cast("bigint"))
    rows = _tokens(s, d).select("id", ids.alias("ids"), mask.alias("mask"))
    whole, labels = collation.with_visual_token(F.col("ids"), F.col("mask"), 0)
    return rows.select("id", whole.alias("attention_mask"), labels.alias("labels")).select("id", *_joined("attention_mask", "labels"))


def _image_sizes(s: SparkSession, d: str) -> DataFrame:
    """Decoded first images, scaled under 16 pixels a side."""
    first = _docs(s, d, "images").select("row_id", training_rows.first_element(F.col("images")).alias("image"))
    made = images.normalised(first, "image", most=16).drop("image")
    side = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("int")
    return made.select("row_id", side(17).alias("width"), side(21).alias("height"))


def _valid_images(s: SparkSession, d: str) -> DataFrame:
    return images.valid_images(_docs(s, d, "images"), "row_id")


def queries() -> dict[str, Query]:
    return {
        "shard_page_sample": lambda s, d: _pages(s, d, False),
        "shard_page_limit": lambda s, d: _pages(s, d, True),
        "shard_stats": _shard_stats,
        "greedy_kcenter": _greedy,
        "local_coresets": _local,
        "coreset_two_stage": _two_stage,
        "coreset_whole_shards": lambda s, d: _two_stage(s, d, False),
        "coreset_incremental": _incremental,
        "coverage_min_distance": _coverage,
        "pairwise_similarity_stats": _stats,
        "pairwise_similarity_histogram": lambda s, d: similarity.pairwise_histogram(_vectors(s, d)).select("bin", "pairs"),
        "pairwise_mean_closed_form": _mean,
        "dedup_first_by_key": _dedup,
        "semi_join_selected": _selected_docs,
        "ordered_lookup_batches": _ordered,
        "turns_flatten": _flatten,
        "turns_roundtrip": _rebuilt,
        "turns_text_map": _mapped,
        "turns_text_map_batched": _mapped_batched,
        "qa_pairs_filtered": _qa,
        "qa_chunks": _chunks,
        "chat_messages": _messages,
        "limit_emitted_chunks": _limited_chunks,
        "answer_extract": _answers,
        "accuracy_overall": lambda s, d: _percents(evaluation.accuracy(_predictions(s, d), "run_id")),
        "accuracy_by_subject": lambda s, d: _percents(evaluation.accuracy_by_subject(_predictions(s, d), "run_id")),
        "accuracy_running": lambda s, d: _percents(evaluation.running_accuracy(_predictions(s, d), "run_id", ["answered_at", "id"])),
        "prompt_build": lambda s, d: evaluation.prompts(table(s, d, "eval_samples")),
        "label_mask": _label_mask,
        "pad_to_batch_max": _padded,
        "fixed_length_visual": _fixed,
        "image_sizes": _image_sizes,
        "image_validity": _valid_images,
    }


UNIT = """
valid AS (
    SELECT id, min(embedding) AS e FROM embedded_rows
    WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY id),
long AS (SELECT id, list_transform(e, lambda x: CAST(x AS DOUBLE)) AS e FROM valid),
unit AS (SELECT id, list_transform(e, lambda x: x / n) AS v FROM (SELECT id, e, sqrt(list_dot_product(e, e)) AS n FROM long))
"""

PAGED = """
ranked AS (SELECT id, v, CAST(id % 4 AS INTEGER) AS shard, row_number() OVER (PARTITION BY id % 4 ORDER BY id) - 1 AS position FROM unit),
kept AS (SELECT id, v, shard, position, CAST(position // 21 AS INTEGER) AS page FROM ranked WHERE position % 3 = 0)
"""


def _strip_sql(text: str) -> str:
    return rf"regexp_replace(coalesce({text}, ''), '^[{BLANKS}]+|[{BLANKS}]+\z', '', 'g')"


def _greedy_sql(name: str, pool: str, k: int, by: str) -> str:
    """A recursive table of greedy picks: step, the group `by`, id, v, nearest distance, taken, picked."""
    return f"""
{name}_start AS (SELECT {by} AS g, id, v, id = min(id) OVER (PARTITION BY {by}) AS picked FROM {pool}),
{name}_steps AS (
    SELECT 0 AS step, g, id, v, CAST('Infinity' AS DOUBLE) AS near, false AS taken, picked FROM {name}_start
    UNION ALL
    SELECT step + 1, g, id, v, near, taken, NOT taken AND row_number() OVER (PARTITION BY g ORDER BY taken, near DESC, id) = 1
    FROM (
        SELECT step, g, id, v, taken OR picked AS taken,
            least(near, 1 - list_dot_product(v, any_value(v) FILTER (WHERE picked) OVER (PARTITION BY g))) AS near
        FROM {name}_steps WHERE step < {k} - 1)),
{name} AS (SELECT g, id, v, step AS pick FROM {name}_steps WHERE picked)
"""


# One row for each member of a shard's pool in each step: K steps of picking on a page, then the picked rows meet the next page.
INCREMENTAL = """
merged AS (
    SELECT CAST(0 AS INTEGER) AS page, 0 AS step, shard AS g, id, v, CAST('Infinity' AS DOUBLE) AS near, false AS taken, id = min(id) OVER (PARTITION BY shard) AS picked FROM kept WHERE page = 0
    UNION ALL (
    SELECT page, step + 1, g, id, v, near, taken, NOT taken AND row_number() OVER (PARTITION BY g ORDER BY taken, near DESC, id) = 1 FROM (
        SELECT page, step, g, id, v, taken OR picked AS taken,
            least(near, 1 - list_dot_product(v, any_value(v) FILTER (WHERE picked) OVER (PARTITION BY g))) AS near
        FROM merged WHERE step < 11)
    UNION ALL
    SELECT page + 1, 0, g, id, v, CAST('Infinity' AS DOUBLE), false, id = min(id) OVER (PARTITION BY g) FROM (
        SELECT page, g, id, v FROM merged WHERE step = 11 AND (taken OR picked) AND page < (SELECT max(page) FROM kept)
        UNION ALL
        SELECT p.page, k.shard, k.id, k.v FROM kept k, (SELECT DISTINCT page, g FROM merged WHERE step = 11) p WHERE k.shard = p.g AND k.page = p.page + 1))),
local AS (SELECT g, id, v FROM merged WHERE step = 11 AND (taken OR picked) AND page = (SELECT max(page) FROM kept))
"""
TWO_STAGE = f"WITH RECURSIVE {UNIT}, {PAGED}, {INCREMENTAL}, {_greedy_sql('final', 'local', 20, '0')}"
WHOLE_SHARDS = f"WITH RECURSIVE {UNIT}, {PAGED}, {_greedy_sql('near_by', 'kept', 12, 'shard')}, {_greedy_sql('final', 'near_by', 20, '0')}"
ONE_PASS = f"WITH RECURSIVE {UNIT}, {_greedy_sql('chosen', 'unit', 25, '0')}"
DOCS = "docs AS (SELECT * FROM source_docs QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)"
SCORES = "scores AS (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY run_id, id ORDER BY answered_at) = 1)"
PAIRS = f"WITH {UNIT}, sims AS (SELECT list_dot_product(a.v, b.v) AS s FROM unit a, unit b WHERE a.id <> b.id)"
# Whole files, as far as SQL can see: a PNG with its closing chunk, a PGM with all bytes of its pixels.
BETWEEN = "(?:0[9AD]|20|23(?:[1-9A-F][0-9A-F]|0[0-9B-F])*0A)+"  # blanks and comments
PGM = f"'^5035{BETWEEN}((?:3[0-9])+){BETWEEN}((?:3[0-9])+){BETWEEN}(?:3[0-9])+(?:0[9AD]|20)'"
SIDE = lambda x, i: rf"TRY_CAST(regexp_replace(regexp_extract({x}, {PGM}, {i}), '3(.)', '\1', 'g') AS INTEGER)"
WHOLE_IMAGE = rf"""coalesce((starts_with(hex(x.bytes), '89504E470D0A1A0A') AND ends_with(hex(x.bytes), '49454E44AE426082')) OR
    (regexp_matches(hex(x.bytes), {PGM}) AND octet_length(x.bytes) >= length(regexp_extract(hex(x.bytes), {PGM})) // 2 + {SIDE("hex(x.bytes)", 1)} * {SIDE("hex(x.bytes)", 2)}), false)"""
SIZED = rf"""
WITH docs AS (SELECT * FROM source_docs QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1),
first AS (SELECT row_id, images[1] AS x FROM docs), heads AS (SELECT row_id, hex(x.bytes) AS h, {WHOLE_IMAGE} AS ok FROM first),
sides AS (SELECT row_id, CASE WHEN NOT ok THEN NULL WHEN starts_with(h, '89') THEN TRY_CAST('0x' || h[33:40] AS INTEGER) ELSE {SIDE("h", 1)} END AS w,
    CASE WHEN NOT ok THEN NULL WHEN starts_with(h, '89') THEN TRY_CAST('0x' || h[41:48] AS INTEGER) ELSE {SIDE("h", 2)} END AS h FROM heads)
SELECT row_id, CASE WHEN greatest(w, h) > 16 THEN greatest(1, CAST(trunc(w * (16.0::DOUBLE / greatest(w, h))) AS INTEGER)) ELSE w END AS width,
    CASE WHEN greatest(w, h) > 16 THEN greatest(1, CAST(trunc(h * (16.0::DOUBLE / greatest(w, h))) AS INTEGER)) ELSE h END AS height FROM sides
"""
EACH_TURN = "SELECT row_id, CAST(i - 1 AS INTEGER) AS turn_idx, texts[i] AS t FROM docs, range(1, len(texts) + 1) AS r(i)"
MAPPED = f"""
WITH {DOCS}, turns AS ({EACH_TURN})
SELECT row_id, turn_idx, CASE WHEN t."user" = '' THEN '' ELSE '<' || t."user" || '>' END AS user_text,
    CASE WHEN t.assistant = '' THEN '' ELSE '<' || t.assistant || '>' END AS assistant_text, t."source" AS source FROM turns
"""
QA = f"""
WITH {DOCS}, turns AS ({EACH_TURN}),
sides AS (SELECT row_id, turn_idx, {_strip_sql('t."user"')} AS question, {_strip_sql('t.assistant')} AS answer FROM turns),
qa AS (SELECT row_id, question, answer, CAST(row_number() OVER (PARTITION BY row_id ORDER BY turn_idx) - 1 AS INTEGER) AS place FROM sides WHERE question <> '' AND answer <> ''),
pictures AS (SELECT row_id, CAST(len(list_filter(images[1:8], lambda x: {WHOLE_IMAGE})) AS INTEGER) AS n_images FROM docs),
chunked AS (SELECT qa.row_id, place // 4 AS chunk, place, question, answer, n_images FROM qa JOIN pictures USING (row_id) WHERE n_images > 0)
"""
CHUNKS = f"""{QA}
SELECT row_id, CAST(chunk AS INTEGER) AS chunk, CAST(count(*) AS INTEGER) AS n_pairs, any_value(n_images) AS n_images, arg_min(question, place) AS first_question FROM chunked GROUP BY row_id, chunk
"""
MESSAGES = f"""{QA}
SELECT row_id, CAST(chunk AS INTEGER) AS chunk, CAST(2 * (place % 4) + j AS INTEGER) AS place, CASE j WHEN 0 THEN 'user' ELSE 'assistant' END AS role,
    CAST(CASE WHEN place % 4 = 0 AND j = 0 THEN n_images + 1 ELSE 1 END AS INTEGER) AS n_parts, CASE j WHEN 0 THEN question ELSE answer END AS text
FROM chunked, (VALUES (0), (1)) AS sides(j)
"""
ANSWERS = rf"""
WITH {SCORES}, bare AS (SELECT run_id, id, raw, regexp_replace(raw, '^[{BLANKS}]+|[{BLANKS}]+\z', '', 'g') AS b FROM scores),
found AS (SELECT *, regexp_extract(b, '(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])([A-D])(?:[^\p{{L}}\p{{M}}\p{{N}}_]|\z)', 1) AS alone, upper(b[1:1]) AS first FROM bare)
SELECT run_id, id, CASE WHEN raw IS NULL THEN NULL WHEN b = '' THEN '' WHEN alone <> '' THEN alone WHEN first IN ('A', 'B', 'C', 'D') THEN first ELSE 'X' END AS letter FROM found
"""
COUNTED = "count(*) FILTER (WHERE error IS NULL) AS total, count(*) FILTER (WHERE error IS NULL AND correct) AS right_n, count(*) FILTER (WHERE error IS NOT NULL) AS errors"
TOKENS = "tokens AS (SELECT id, list_transform(string_split(question, ' '), lambda w: CAST(length(w) AS BIGINT)) AS ids FROM eval_samples)"


def _accuracy_sql(by: str, where: str = "") -> str:
    return f"""
WITH {SCORES}, named AS (SELECT run_id, coalesce(subject, 'unknown') AS subject, error, correct FROM scores),
sums AS (SELECT {by}, {COUNTED} FROM named GROUP BY {by})
SELECT {by}, total, right_n AS "right", errors, round(CASE WHEN total = 0 THEN 0 ELSE 100.0::DOUBLE * right_n / total END, 6) AS accuracy FROM sums {where}
"""


PROMPT = r"""
WITH n AS (SELECT *, CAST(len(list_filter([image_1, image_2, image_3, image_4, image_5, image_6, image_7], lambda x: x IS NOT NULL)) AS INTEGER) AS images FROM eval_samples)
SELECT id, subject, upper(trim(answer)) AS gt, images,
    CASE WHEN images > 0 THEN rtrim(repeat('<image>' || chr(10), images), chr(10)) || chr(10) || chr(10) || 'Look at the image(s) carefully and answer the following question.' ELSE 'Answer the following question.' END
    || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10) || 'Options:' || chr(10) || array_to_string(options, chr(10)) || chr(10) || chr(10)
    || 'Answer with only the option letter (A, B, C, or D).' AS prompt FROM n
"""


def oracle_sql() -> dict[str, str]:
    return {
        "shard_page_sample": f"WITH {UNIT}, {PAGED} SELECT shard, page, position, id FROM kept",
        "shard_page_limit": f"WITH {UNIT}, {PAGED} SELECT shard, page, position, id FROM kept WHERE page < 2",
        "shard_stats": """
            WITH once AS (SELECT id, min(embedding) AS e FROM embedded_rows WHERE id IS NOT NULL GROUP BY id),
            judged AS (SELECT id, coalesce(len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0, false) AS ok FROM once),
            placed AS (SELECT CAST(id % 4 AS INTEGER) AS shard, ok, row_number() OVER (PARTITION BY id % 4 ORDER BY id) - 1 AS p FROM judged)
            SELECT shard, count(*) AS n_rows, count(*) FILTER (WHERE p % 3 = 0) AS kept, count(DISTINCT CASE WHEN p % 3 = 0 THEN p // 21 END) AS pages,
                count(*) FILTER (WHERE p % 3 = 0 AND NOT ok) AS skipped FROM placed GROUP BY shard""",
        "greedy_kcenter": f"{ONE_PASS} SELECT id, CAST(pick AS INTEGER) AS pick FROM chosen",
        "local_coresets": f"WITH RECURSIVE {UNIT}, {PAGED}, {_greedy_sql('near_by', 'kept', 12, 'shard')} SELECT g AS shard, id, CAST(pick AS INTEGER) AS pick FROM near_by",
        "coreset_two_stage": f"{TWO_STAGE} SELECT id FROM final",
        "coreset_whole_shards": f"{WHOLE_SHARDS} SELECT id FROM final",
        "coreset_incremental": f"WITH RECURSIVE {UNIT}, {PAGED}, {INCREMENTAL} SELECT g AS shard, id FROM local",
        "coverage_min_distance": f"{ONE_PASS} SELECT u.id, round(greatest(min(1 - list_dot_product(u.v, c.v)), 0), 6) AS distance FROM unit u, chosen c GROUP BY u.id",
        "pairwise_similarity_stats": f"{PAIRS} SELECT count(*) AS pairs, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_pop(s), 6) AS std, round(min(s), 6) AS low, round(max(s), 6) AS high FROM sims",
        "pairwise_similarity_histogram": f"""{PAIRS}, ends AS (SELECT min(s) AS low, (max(s) - min(s)) / 50 AS width FROM sims),
            counted AS (SELECT least(CAST(floor((s - low) / width) AS INTEGER), 49) + 1 AS bin, count(*) AS n FROM sims, ends GROUP BY 1)
            SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS pairs FROM range(1, 51) AS r(b) LEFT JOIN counted ON bin = b""",
        "pairwise_mean_closed_form": f"{PAIRS} SELECT count(*) AS pairs, round(avg(s), 6) AS mean FROM sims",
        "dedup_first_by_key": "SELECT doc_id, text, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
        "semi_join_selected": f"{TWO_STAGE}, {DOCS} SELECT row_id, corpus FROM docs WHERE row_id IN (SELECT id FROM final)",
        "ordered_lookup_batches": f"""WITH {UNIT}, {DOCS}, placed AS (SELECT row_id, corpus, row_number() OVER (ORDER BY row_id) - 1 AS position FROM docs WHERE row_id IN (SELECT id FROM unit))
            SELECT row_id, corpus, position, position // 500 AS batch, printf('train-%05d-of-%05d.parquet', position // 500, (SELECT max(position) // 500 + 1 FROM placed)) AS shard_name FROM placed""",
        "turns_flatten": f"""WITH {DOCS}, turns AS ({EACH_TURN})
            SELECT row_id, turn_idx, field, text FROM (SELECT row_id, turn_idx, 'user' AS field, t."user" AS text FROM turns UNION ALL SELECT row_id, turn_idx, 'assistant', t.assistant FROM turns) WHERE text <> ''""",
        "turns_roundtrip": MAPPED,
        "turns_text_map": MAPPED,
        "turns_text_map_batched": MAPPED,
        "qa_pairs_filtered": f"{QA} SELECT row_id, place, question, answer FROM qa",
        "qa_chunks": CHUNKS,
        "chat_messages": MESSAGES,
        "limit_emitted_chunks": f"SELECT row_id, chunk, n_pairs FROM ({CHUNKS}) ORDER BY row_id, chunk LIMIT 100",
        "answer_extract": ANSWERS,
        "accuracy_overall": _accuracy_sql("run_id"),
        "accuracy_by_subject": _accuracy_sql("run_id, subject", "WHERE total > 0"),
        "accuracy_running": f"""WITH {SCORES}, placed AS (SELECT run_id, error, row_number() OVER w AS seen, count(*) FILTER (WHERE error IS NULL) OVER w AS total, count(*) FILTER (WHERE error IS NULL AND correct) OVER w AS right_n
                FROM scores WINDOW w AS (PARTITION BY run_id ORDER BY answered_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
            SELECT run_id, CAST(seen AS INTEGER) AS seen, right_n AS "right", total, round(100.0::DOUBLE * right_n / total, 6) AS accuracy FROM placed WHERE error IS NULL AND seen % 50 = 0""",
        "prompt_build": PROMPT,
        "image_sizes": SIZED,
        "image_validity": f"""WITH {DOCS} SELECT row_id, CAST(coalesce(len(list_filter(images[1:8], lambda x: {WHOLE_IMAGE})), 0) AS INTEGER) AS valid,
            CAST(coalesce(len(list_filter(images[1:8], lambda x: x.bytes IS NOT NULL AND NOT {WHOLE_IMAGE})), 0) AS INTEGER) AS unread FROM docs""",
        "label_mask": f"WITH {TOKENS} SELECT id, array_to_string(list_concat(list_transform(range(len(ids) + 4), lambda x: -100), ids, [0, -100, -100]), ',') AS labels FROM tokens",
        "pad_to_batch_max": f"""WITH {TOKENS}, placed AS (SELECT id, ids, (row_number() OVER (ORDER BY id) - 1) // 16 AS batch FROM tokens),
            sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS most FROM placed)
            SELECT id, batch, array_to_string(list_resize(ids, most, 0), ',') AS input_ids, array_to_string(list_resize(list_transform(ids, lambda x: 1), most, 0), ',') AS attention_mask FROM sized""",
        "fixed_length_visual": f"""WITH {TOKENS}, fixed AS (SELECT id, list_resize(ids[1:32], 32, 0) AS ids FROM tokens)
            SELECT id, array_to_string(list_concat([1], list_transform(ids, lambda x: CASE WHEN x = 0 THEN 0 ELSE 1 END)), ',') AS attention_mask,
                array_to_string(list_concat([-100], list_transform(ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)), ',') AS labels FROM fixed""",
    }
