"""The pN_ queries and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from thinwell.llm.broken_pairs import first_defects, pair_defects
from thinwell.llm.garbled import garbled_documents, repair_documents
from thinwell.llm.languages import stretch_languages, wrong_labels
from thinwell.llm.leaks import leaks, turn_texts, whole_leaks
from thinwell.llm.near_duplicates import near_duplicate_classes, near_duplicate_pairs
from thinwell.llm.neighbours import nearest, neighbour_pairs
from thinwell.llm.packing import container_waste, pack_documents
from thinwell.llm.splitting import described_pieces, oversized_items, split_oversized
from thinwell.llm.tokens import decode_documents, encode_documents
from thinwell.llm.varied_subset import varied_subset
from thinwell.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _source(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_docs")


def queries() -> dict[str, Query]:
    return {
        "p1_found": lambda s, d: near_duplicate_pairs(_source(s, d)),
        "p1_classes": lambda s, d: near_duplicate_classes(_source(s, d)),
        "p2_found": lambda s, d: first_defects(_source(s, d)),
        "p2_defects": lambda s, d: pair_defects(_source(s, d)),
        "p3_subset": lambda s, d: varied_subset(table(s, d, "embedded_rows"), _source(s, d)),
        "p4_found": lambda s, d: neighbour_pairs(table(s, d, "embedded_rows")),
        "p4_nearest": lambda s, d: nearest(table(s, d, "embedded_rows")).select("id", "neighbour", "place"),
        "p5_found": lambda s, d: wrong_labels(table(s, d, "flat_turns")),
        "p5_stretches": lambda s, d: stretch_languages(table(s, d, "flat_turns")),
        "p6_found": lambda s, d: oversized_items(_source(s, d)),
        "p6_pieces": lambda s, d: described_pieces(split_oversized(_source(s, d))),
        "p7_found": lambda s, d: whole_leaks(_source(s, d), table(s, d, "eval_samples")),
        "p7_leaks": lambda s, d: leaks(turn_texts(_source(s, d)), table(s, d, "eval_samples")),
        "p8_ids": lambda s, d: encode_documents(table(s, d, "documents")),
        "p8_decoded": lambda s, d: decode_documents(encode_documents(table(s, d, "documents"))),
        "p9_containers": lambda s, d: pack_documents(table(s, d, "documents")),
        "p9_waste": lambda s, d: container_waste(pack_documents(table(s, d, "documents"))),
        "p10_found": lambda s, d: garbled_documents(table(s, d, "documents")),
        "p10_restored": lambda s, d: repair_documents(table(s, d, "documents")),
    }


VALID = """
valid AS (
    SELECT id, list_transform(min(embedding), lambda x: CAST(x AS DOUBLE)) AS e FROM embedded_rows
    WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY id)
"""

P3_SUBSET = rf"""
WITH {VALID},
asked AS (SELECT CAST(ceil(count(*) / 20.0) AS BIGINT) AS k FROM valid),
unit AS (SELECT id, md5(CAST(id AS VARCHAR)) AS h, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS v FROM valid),
sample AS (SELECT h, v FROM unit ORDER BY h LIMIT 2048),
judged AS (SELECT b.h, any_value(b.v) AS v, coalesce(round(max(list_dot_product(a.v, b.v)), 9), -2) AS m FROM sample b LEFT JOIN sample a ON a.h < b.h GROUP BY b.h),
anchors AS (SELECT v, row_number() OVER (ORDER BY m, h) AS anchor FROM judged QUALIFY anchor <= least(256, (SELECT k FROM asked))),
gathered AS (SELECT a.anchor, a.v, g.anchor AS head FROM anchors a, anchors g WHERE g.anchor <= 16 QUALIFY row_number() OVER (PARTITION BY a.anchor ORDER BY list_dot_product(g.v, a.v) DESC, g.anchor) = 1),
opened AS (SELECT id, h, u.v, anchor AS head FROM unit u, anchors a WHERE anchor <= 16 QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_dot_product(a.v, u.v) DESC, anchor) <= 4),
near AS (SELECT id, h, o.v, anchor, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(g.v, o.v) DESC, anchor) AS place FROM opened o JOIN gathered g USING (head) QUALIFY place <= 3),
held AS (SELECT id, h, v, anchor FROM near WHERE place = 1 QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY h) <= 64),
likest AS (SELECT c.id, any_value(c.h) AS h, coalesce(round(max(list_dot_product(o.v, c.v)), 9), -2) AS m FROM held c JOIN near n ON n.id = c.id LEFT JOIN held o ON o.anchor = n.anchor AND o.h < c.h GROUP BY c.id),
leaders AS (SELECT id AS leader, h, v, anchor FROM held WHERE id IN (SELECT id FROM likest ORDER BY m, h LIMIT (SELECT k FROM asked))),
led AS (SELECT n.id, leader FROM near n JOIN leaders l ON l.anchor = n.anchor QUALIFY row_number() OVER (PARTITION BY n.id ORDER BY list_dot_product(l.v, n.v) DESC, l.h) = 1),
named AS (SELECT id, coalesce(CAST(leader AS VARCHAR), 'a' || (anchor - 1)) AS leader FROM near LEFT JOIN led USING (id) WHERE place = 1),
heads AS (SELECT row_id, min(hex(images[1].bytes)[1:64]) AS head FROM source_docs GROUP BY row_id),
both_ AS (SELECT id, leader, coalesce(head, '') AS head FROM named LEFT JOIN heads ON row_id = id),
sized AS (SELECT *, regexp_extract(head, '^5035(?:0[9AD]|20)+((?:3[0-9])+)(?:0[9AD]|20)+((?:3[0-9])+)(?:0[9AD]|20)', 1) AS w, regexp_extract(head, '^5035(?:0[9AD]|20)+((?:3[0-9])+)(?:0[9AD]|20)+((?:3[0-9])+)(?:0[9AD]|20)', 2) AS h FROM both_),
placed AS (SELECT id, leader, leader || '/' || CASE
        WHEN starts_with(head, '89504E470D0A1A0A') AND length(head) >= 48 THEN 'png' || length(bin(CAST('0x' || head[33:40] AS BIGINT) * CAST('0x' || head[41:48] AS BIGINT)))
        WHEN w <> '' THEN 'pgm' || length(bin(CAST(regexp_replace(w, '3(.)', '\1', 'g') AS BIGINT) * CAST(regexp_replace(h, '3(.)', '\1', 'g') AS BIGINT)))
        ELSE 'none' END AS cell FROM sized),
sizes AS (SELECT leader, cell, count(*) AS n, row_number() OVER (PARTITION BY leader ORDER BY count(*) DESC, cell) AS place FROM placed GROUP BY leader, cell),
ranked AS (SELECT id, cell, n, place, row_number() OVER (PARTITION BY cell ORDER BY md5(CAST(id AS VARCHAR)), id) AS rank_in_cell FROM placed JOIN sizes USING (cell))
SELECT id, cell, CAST(rank_in_cell AS INTEGER) AS rank_in_cell FROM ranked ORDER BY ranked.rank_in_cell, place, n DESC, cell LIMIT (SELECT k FROM asked)
"""

NEAREST = f"""
WITH {VALID}, sims AS (SELECT a.id, b.id AS neighbour, list_cosine_similarity(a.e, b.e) AS s FROM valid a, valid b WHERE a.id <> b.id),
best AS (SELECT id, neighbour, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS INTEGER) AS place FROM sims QUALIFY place <= 5)
"""
P4_FOUND = f"{NEAREST} SELECT DISTINCT least(id, neighbour) AS id_a, greatest(id, neighbour) AS id_b FROM best"
P4_NEAREST = f"{NEAREST} SELECT id, neighbour, place FROM best"

P8_DECODED = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

P6_FOUND = """
SELECT row_id, CAST(turn_idx AS INTEGER) AS turn_idx, field FROM (
    SELECT row_id, i - 1 AS turn_idx, field, CASE field WHEN 'user' THEN texts[i]."user" ELSE texts[i].assistant END AS text
    FROM source_docs, range(1, len(texts) + 1) AS r(i), (VALUES ('user'), ('assistant')) AS f(field)
) WHERE length(text) > 1200
UNION
SELECT row_id, -1, 'images' FROM source_docs WHERE len(images) > 8
"""


PLAIN_WORDS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')".format
P7_FOUND = f"""
WITH items AS (SELECT DISTINCT id AS sample_id, {PLAIN_WORDS("question")} AS w FROM eval_samples WHERE id IS NOT NULL),
parts AS (SELECT DISTINCT sample_id, array_to_string(w[i:i + 9], ' ') AS part FROM items, range(1, len(w) - 8) AS r(i)),
turns AS (SELECT row_id, unnest(texts) AS t FROM source_docs WHERE row_id IS NOT NULL),
words AS (SELECT row_id, {PLAIN_WORDS("field")} AS w FROM (SELECT row_id, t."user" AS field FROM turns UNION ALL SELECT row_id, t.assistant FROM turns)),
windows AS (SELECT DISTINCT row_id, array_to_string(w[i:i + 9], ' ') AS part FROM words, range(1, len(w) - 8) AS r(i))
SELECT DISTINCT row_id, sample_id FROM windows JOIN parts USING (part)
"""


def oracle_sql() -> dict[str, str]:
    return {"p3_subset": P3_SUBSET, "p4_found": P4_FOUND, "p4_nearest": P4_NEAREST, "p6_found": P6_FOUND, "p7_found": P7_FOUND, "p8_decoded": P8_DECODED}
