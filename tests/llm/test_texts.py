import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thinwell.llm import broken_pairs as bp
from thinwell.llm import languages as lg
from thinwell.llm import leaks as lk
from thinwell.llm import splitting as sp
from thinwell.llm.hashing import WordHashes

DOCS = "row_id bigint, texts array<struct<user: string, assistant: string, source: string>>, images array<struct<bytes: binary, path: string>>, turn_idx int, text string"


@pytest.mark.parametrize(
    ("question", "answer", "defects"),
    [
        ("What?", None, ["empty"]),
        ("What?", " …​ ", ["empty"]),
        ("Which page?", "which  PAGE", ["copy"]),
        ("Which page?", "Which page? Which page?", ["copy"]),
        ("Which page?", "Q: Which page?", ["copy"]),
        ("Which page?", "Which page shows it", []),
        ("What is it?", "Sorry, I cannot help with that request.", ["refusal"]),
        ("¿Qué?", "Prefiero no contestar.", ["refusal"]),
        ("Что это?", "Извините, я не могу ответить на этот вопрос.", ["refusal"]),
        ("Was?", "“Ich kann diese Frage nicht beantworten", ["refusal"]),
        ("What is there?", "Unfortunately, I cannot attend the meeting.", []),
        ("What is there?", "Yes, it reads “I must decline the offer of Gel”.", []),
        ("What is on the page and in the margin of it?", "Die zweite Seite zeigt das Datum und die Nummer auf der linken Seite.", ["other_language"]),
        ("Please translate the line of the page into German.", "Die zweite Seite zeigt das Datum und die Nummer auf der linken Seite.", []),
        ("What is on the page and in the margin of it?", "Вторая страница показывает дату.", ["other_language"]),
        ("What?", "1. The first item is here.\n2.", ["truncated"]),
        ("What?", "The missing sig-", ["truncated"]),
        (None, "The second page.", []),
        ("", "42", []),
        ("What is on the page and in the margin of it?", "What is on the page and in the margin", ["copy"]),
        ("What is on the page?", "What is on the page? What is on", ["copy"]),
        ("What is on the page and in the margin?", "What is on the page and in the margin? The", ["copy"]),
        ("Who wrote it?", "Who wrote it? Gelvarto", []),
        ("What is on the page and in the margin of it?", "第二页显示缺少的签名和发票总额。", ["other_language"]),
        ("What is on the page and in the margin of it?", "تظهر الصفحة الثانية التوقيع المفقود", ["other_language"]),
        ("What is on the page and in the margin of it?", "Η δεύτερη σελίδα δείχνει την υπογραφή.", ["other_language"]),
        ("What is on the page? Please answer in Chinese.", "第二页显示缺少的签名和发票总额。", []),
        ("Translate the line into Greek.", "Η δεύτερη σελίδα δείχνει την υπογραφή.", []),
        ("Which sign is in the margin?", "Ω, twice.", []),
        ("第二页有什么？请说明一下", "The second page shows the date.", ["other_language"]),
        ("What?", "The total (including the shipping fee and the tax.", ["truncated"]),
        ("What?", "It runs:\n```\nx = 1", ["truncated"]),
        ("What?", "It runs:\n```\nx = (1\n```\nas is.", []),
        ("What?", "It says “the margin is missing.", ["truncated"]),
        ("What?", "The values are [1, 2, 3", ["truncated"]),
        ("What?", "1) one 2) two :( and „drei“ «quatre» a 5\" pipe (six).", []),
        ("What is it?", "I'm not going to answer that.", ["refusal"]),
        ("What is it?", "That request is declined.", ["refusal"]),
        ("What is it?", "We are not in a position to comment on this.", ["refusal"]),
        ("Quoi ?", "Je ne peux pas vous répondre.", ["refusal"]),
        ("Was?", "Ich möchte dazu leider nicht antworten.", ["refusal"]),
        (None, "申し訳ありませんが、その質問にはお答えできません。", ["refusal"]),
        (None, "抱歉，我无法回答这个问题。", ["refusal"]),
        ("What did the clerk do?", "The clerk did not answer, and the request was declined in May.", []),
    ],
)
def test_judge(question, answer, defects):
    assert bp.judge(question, answer)[0] == defects


def test_short_cut_answers_are_found_however_many(spark):
    """A third of the rows is one short cut answer, a third short noun phrases."""
    rows = [(i, [(f"Which page shows the invoice of {i}, and the plot?", f"The sheet lists the total of the invoice {i} in the margin. It names the owner of the plot.", None)], None, None, None) for i in range(120)]
    rows += [(200 + i, [("q?", "The invoice lists the", None)], None, None, None) for i in range(120)]
    rows += [(400 + i, [("q?", "the owner of the plot", None)], None, None, None) for i in range(120)]
    found = {(r.row_id, r.defect) for r in bp.first_defects(spark.createDataFrame(rows, DOCS)).collect()}
    assert found == {(200 + i, "truncated") for i in range(120)}


def test_endings_are_learnt_from_the_corpus(spark):
    rows = [(i, [("Which page?", f"The sheet shows the total of {i} crowns in the margin. It names the owner of the plot.", None)], None, None, None) for i in range(40)]
    rows += [
        (100, [("q?", "The sheet shows the total of 7 crowns in the", None), None], None, 1, "x"),
        (101, [("q?", "The sheet shows the total of 7 crowns in the margin", None), ("q", "the owner of the plot", None)], None, 1, "x"),
        (102, [("q?", "The sheet shows the total of 7 crowns in the marg", None)], None, 1, "x"),
        (102, [("q?", "The sheet shows the total of 7 crowns in the marg", None)], None, 1, "x"),
        (103, None, None, None, None),
        (104, [], None, None, None),
        (None, [("q", None, None)], None, None, None),
        (105, [("Which page?", "which page", None), ("a", "b" * 100_000 + ".", None)], None, None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in bp.first_defects(docs).collect()) == [(100, 0, "truncated"), (102, 0, "truncated"), (105, 0, "copy")]
    assert bp.first_defects(docs.limit(0)).count() == 0


@given(st.text(alphabet=list("ab .!?\n\n\t,;é😀​́"), max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_pieces_rebuild_the_text(spark, text, limit, overlap):
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(sp.text_pieces(F.col("t"), limit, overlap)).alias("x")).collect()
    pieces = [(r.x.shared, r.x.piece) for r in rows]
    assert "".join(p[s:] for s, p in pieces) == text
    assert all(len(p) <= limit and s <= overlap for s, p in pieces)
    assert all(b.startswith(a[len(a) - s :] if s else "") for (_, a), (s, b) in zip(pieces, pieces[1:]))


def test_split_prefers_strong_boundaries(spark):
    text = "One two three. Four five six seven.\n\nEight nine ten eleven. Twelve"
    pieces = spark.createDataFrame([(text,)], "t string").select(sp.text_pieces(F.col("t"), 45, 5).alias("p")).first().p
    assert [p.piece[p.shared :] for p in pieces] == ["One two three. Four five six seven.\n\n", "Eight nine ten eleven. Twelve"]
    assert sp.list_pieces and spark.range(1).select(sp.list_pieces(F.sequence(F.lit(1), F.lit(16)), 8, 1)).first()[0] == [list(range(1, 9)), list(range(8, 16)), [15, 16]]
    with pytest.raises(ValueError):
        sp.text_pieces(F.col("t"), 5, 5)


def test_split_edges(spark):
    image = {"bytes": None, "path": None}
    rows = [
        (1, [("a" * 1200, "b" * 1201, None), None], [image] * 8, 5, "clash"),
        (2, [(None, "", None), ("word " * 2000, None, None)], [None] * 9, 5, "clash"),
        (2, [(None, "", None), ("word " * 2000, None, None)], [None] * 9, 5, "clash"),
        (3, None, None, None, None),
        (4, [], [], None, None),
        (5, [("😀" * 1200, None, None)], None, None, None),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(tuple(r) for r in sp.oversized_items(docs).collect()) == [(1, 0, "assistant"), (2, -1, "images"), (2, 1, "user")]
    pieces = sp.split_oversized(docs).where("row_id = 2 and field = 'user'").orderBy("piece_idx").collect()
    assert "".join(p.piece[p.shared :] for p in pieces) == "word " * 2000 and all(len(p.piece) <= 1200 for p in pieces)
    assert sp.split_oversized(docs.limit(0)).count() == 0
    slices = sp.described_pieces(sp.split_oversized(docs)).where("field = 'images'").orderBy("piece_idx").collect()
    assert [(r.first_image, r.n_images, r.shared) for r in slices] == [(0, 8, 0), (7, 2, 1)] and all(len(r.digest) == 32 for r in slices)


def question(n, salt):
    return " ".join(f"{salt}{i}" for i in range(n)) + "?"


def test_leaks(spark):
    samples = spark.createDataFrame([("e1", question(20, "a"), 1), ("e2", question(12, "b"), 1), ("e2", question(12, "b"), 1), ("e3", "too short", 1), ("e4", None, 1), (None, question(15, "c"), 1)], "id string, question string, row_id int")
    a = question(20, "a").split()
    rows = [
        (1, [("Intro: " + " ".join(a[5:15]).upper() + " and so on", None, None)]),
        (2, [(" ".join(a[5:14]), " ".join(a[14:20]), None)]),
        (3, [("> " + ",\n> ".join(a), None, None), None]),
        (4, [(" ".join([*a[:6], "changed", *a[7:11]]), "", None)]),
        (5, None), (6, []), (None, [(question(20, "a"), None, None)]),
        (7, [("z " * 50_000 + question(12, "b"), None, None)]), (7, [("z " * 50_000 + question(12, "b"), None, None)]),
    ]
    docs = spark.createDataFrame(rows, "row_id bigint, texts array<struct<user: string, assistant: string, source: string>>")
    assert sorted(tuple(r) for r in lk.whole_leaks(docs, samples).collect()) == [(1, "e1"), (3, "e1"), (7, "e2")]
    near = {(r.row_id, r.sample_id): (r.words, r.edits) for r in lk.leaks(lk.turn_texts(docs), samples).collect()}
    assert near[1, "e1"] == (10, None) and near[3, "e1"] == (10, 0) and near[7, "e2"] == (10, 0)
    assert lk.whole_leaks(docs.limit(0), samples).count() == lk.whole_leaks(docs, samples.limit(0)).count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [question(15, f"s{i}")]) for i in range(6)], "row_id bigint, texts array<string>")
    samples = spark.createDataFrame([(f"e{i}", question(15, f"s{i}")) for i in range(6)], "id string, question string")
    monkeypatch.setattr(lk, "BLOCK", 10)
    assert sorted((r.row_id, r.sample_id) for r in lk.leaks(docs, samples).where("edits = 0 and words = 10").collect()) == [(i, f"e{i}") for i in range(6)]


def edited(words, how, rng):
    words = words.copy()
    at = rng.randrange(len(words))
    if how == "deleted":
        del words[at]
    elif how == "inserted":
        words.insert(at, "new")
    else:
        for i in rng.sample(range(len(words)), 2 if how == "two replaced" else 1):
            words[i] = f"other{i}"
    return words


@pytest.mark.parametrize("how", ["replaced", "deleted", "inserted", "two replaced"])
@pytest.mark.parametrize("length", [7, 10, 14, 30])
def test_recall_of_edited_items(spark, how, length):
    """Items of any length with a word or two edited are found inside longer texts, with the number of their edits."""
    if how == "two replaced" and length < 10:
        return
    rng = random.Random(f"{how}{length}")
    items = [[f"q{i}w{j}" for j in range(length)] for i in range(150)]
    docs = [(i, ["before it " + " ".join(edited(w, how, rng)) + " and behind it"]) for i, w in enumerate(items)]
    samples = spark.createDataFrame([(str(i), " ".join(w)) for i, w in enumerate(items)], "id string, question string")
    found = {r.row_id: r for r in lk.leaks(spark.createDataFrame(docs, "row_id bigint, texts array<string>"), samples).collect()}
    most = 2 if how == "two replaced" else 1
    # A single window with two of its ten words replaced is the hardest case.
    assert len(found) >= (0.8 if (how, length) == ("two replaced", 10) else 0.9) * len(items) and all(r.sample_id == str(i) and r.edits <= most for i, r in found.items())


def test_siblings_of_a_pattern_are_told_apart(spark):
    """Questions of one pattern differ by their own words only: each is found in its own copy, not in its siblings'."""
    pattern = "in a trial led by {} the tank loses {} litres every day so which other option gives level {}"
    items = [pattern.format(f"name{i}", 100 + i, 500 + i) for i in range(300)]
    samples = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "id string, question string")
    texts = [(i, [items[i].replace("every day", "each day")]) for i in range(20)] + [(100 + i, [pattern.format(f"else{i}", 7000 + i, 9000 + i)]) for i in range(20)]
    got = lk.leaks(spark.createDataFrame(texts, "row_id bigint, texts array<string>"), samples)
    assert sorted((r.row_id, r.sample_id) for r in got.where("edits is not null").collect()) == sorted((i, str(i)) for i in range(20))


def test_short_items(spark):
    samples = spark.createDataFrame([("a", "where is the north gate"), ("b", "too short item"), ("c", "which of these seven lamps is red")], "id string, question string")
    docs = spark.createDataFrame([(1, ["I ask: Where is the NORTH gate?"]), (2, ["where is the south gate"]), (3, ["which of these seven lamps was red"]), (4, ["too short item"])], "row_id bigint, texts array<string>")
    assert sorted(tuple(r) for r in lk.leaks(docs, samples).collect()) == [(1, "a", 5, 0), (3, "c", 0, 1)]


def test_plain_words():
    assert lk.plain_words("L'Été — «naïve», ÉTÉ_2!") == ["l", "ete", "naive", "ete", "2"]
    known = WordHashes()
    assert known["x"] == known["x"] and lk.fit_edits([1, 2, 3], [9, 1, 3, 3, 9], 2) == 1 and lk.fit_edits([1, 2, 3], [4, 5], 1) == 2


SENTENCES = {
    "en": "The second page shows the missing signature and the total of the invoice in the margin.",
    "fr": "La deuxième page montre la signature qui manque et le total de la facture dans la marge.",
    "de": "Die zweite Seite zeigt die fehlende Unterschrift und den Betrag der Rechnung am Rand.",
    "es": "La segunda página muestra la firma que falta y el total de la factura en el margen.",
    "it": "La seconda pagina mostra la firma che manca e il totale della fattura nel margine.",
    "pt": "A segunda página mostra a assinatura que falta e o total da fatura na margem.",
    "nl": "De tweede pagina toont de ontbrekende handtekening en het totaal van de factuur in de marge.",
    "ru": "Вторая страница показывает недостающую подпись и сумму счёта на полях.",
}
TURNS = "conv_idx int, turn_idx int, field string, text string, source string, lang string, words int"


def test_language_labels(spark):
    rows = [(0, i, "user", f"{SENTENCES[k]} {SENTENCES[k]}", "s", k, 1) for i, k in enumerate(SENTENCES) for _ in range(60)]
    rows += [
        (1, 0, "user", SENTENCES["fr"], "s", "French", 1), (1, 1, "user", SENTENCES["fr"].upper(), "s", "fr-CA", 1), (1, 2, "user", SENTENCES["fr"], "s", "en", 1),
        (1, 3, "user", SENTENCES["de"] + " " + SENTENCES["en"], "s", "de", 1), (1, 4, "user", SENTENCES["en"] + " “der unterschriebene Vertrag”", "s", "eng", 1),
        (1, 5, "user", SENTENCES["es"], "s", None, 1), (1, 6, "user", SENTENCES["es"], "s", "??", 1), (1, 6, "user", SENTENCES["es"], "s", "??", 1),
        (1, 7, "user", None, "s", None, 1), (1, 8, "user", "  ", "s", None, 1), (1, 9, "user", "12 34 56 78", "s", None, 1), (1, 10, "user", "three words only", "s", None, 1),
        (1, 11, "user", (SENTENCES["it"] + " ") * 500, "s", "und", 1),
    ]
    turns = spark.createDataFrame(rows, TURNS)
    got = sorted((r.conv_idx, r.turn_idx, r.lang) for r in lg.wrong_labels(turns).collect())
    assert got == [(1, 2, "fr"), (1, 3, "de"), (1, 3, "en"), (1, 5, "es"), (1, 6, "es"), (1, 11, "it")]
    parts = lg.stretch_languages(turns.where("conv_idx = 1 and turn_idx = 3 or conv_idx = 0")).where("conv_idx = 1").orderBy("stretch_idx").collect()
    assert [(p.stretch, p.lang) for p in parts] == [(SENTENCES["de"], "de"), (SENTENCES["en"], "en")] and all(0 <= p.confidence <= 1 for p in parts)
    assert lg.wrong_labels(turns.limit(0)).count() == 0


def test_profiles_without_labels(spark):
    turns = spark.createDataFrame([(1, 0, "user", SENTENCES["en"], "s", None, 1)], TURNS)
    assert [r.lang for r in lg.wrong_labels(turns).collect()] == ["en"]


def test_held_out_accuracy(spark):
    """Texts that no profile was fitted on and whose language their words tell: sentences of the eight languages with other words
    around them, and labelled turns, of whose labels about one in twenty is wrong."""
    turns = spark.read.parquet("/root/testdata/sf0.01/flat_turns.parquet").where("text is not null")
    rows = turns.select("text", lg.language_code(F.col("lang")).alias("code")).where("code is not null").collect()
    random.Random(1).shuffle(rows)
    half = len(rows) // 2
    profiles = lg.fit_profiles(spark.createDataFrame(rows[:half], "text string, lang string"))
    rest = [r for r in rows[half:] if len(r.text.split()) >= 4]
    judged = [(r.code, {x[1] for x in found}) for r, found in zip(rest, profiles.stretches([r.text for r in rest]))]
    assert sum(code in held for code, held in judged) / len(judged) >= 0.93
    # A turn and its user or assistant counterpart agree with the majority of a language's function words.
    clear = [(code, held) for (code, held), r in zip(judged, rest) if sum(w in lg.SEEDS[code].split() for w in r.text.lower().split()) >= 3]
    assert len(clear) > 300 and sum(code in held for code, held in clear) / len(clear) >= 0.97


def test_texts_of_no_language(spark):
    """Languages without a profile are none of the eight, with a label or without."""
    other = ["Druga strona pokazuje brakujący podpis i sumę faktury na marginesie dokumentu.", "A második oldal mutatja a hiányzó aláírást és a számla összegét.", "第二页 显示 缺少的 签名 和 发票总额", "Druhá strana ukazuje chybějící podpis a součet faktury na okraji.", "Η δεύτερη σελίδα δείχνει την υπογραφή που λείπει."]
    rows = [(0, i, "user", r.text, "s", r.lang, 1) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.01/flat_turns.parquet").select("text", "lang").collect())]
    rows += [(1, i, "user", t, "s", lang, 1) for i, t in enumerate(other) for lang in (None,)] + [(2, i, "user", t, "s", "de", 1) for i, t in enumerate(other)]
    turns = spark.createDataFrame(rows, TURNS)
    assert not lg.wrong_labels(turns).where("conv_idx > 0").collect()
    assert {r.lang for r in lg.stretch_languages(turns).where("conv_idx > 0").collect()} == {lg.NONE}


def test_flat_ranks_equal_the_definition(spark):
    """Distances of many texts at once equal those by the definition, n-gram by n-gram."""
    from collections import Counter

    profiles = lg.fit_profiles(spark.createDataFrame([(t, k) for k, t in SENTENCES.items() for _ in range(60)], "text string, lang string"))
    texts = [*SENTENCES.values(), "", "12 34", "żółw", SENTENCES["en"] * 3]
    for text, d in zip(texts, profiles.distances(texts)):
        found = Counter(g for w in lg.LETTERS.findall(text.lower()) for g in lg._WordGrams()[w])
        known = sorted((g for g in found if g in profiles.numbers), key=lambda g: (-found[g], profiles.numbers[g]))[: lg.RANKED]
        lost = min(sum(n for g, n in found.items() if g not in profiles.numbers), lg.RANKED)
        for j in range(len(lg.LANGUAGES)):
            apart = sum(min(abs(int(profiles.rank[j, profiles.numbers[g]]) - i), lg.PROFILE) for i, g in enumerate(known)) / lg.PROFILE
            assert d[j] == pytest.approx((apart + lost) / (len(known) + lost) if known else 1)


def test_bracketed_sentences_are_stretches(spark):
    """A foreign sentence in brackets, without a full stop of its own, before, between and behind others."""
    it, en = f"({SENTENCES['it'][:-1]})", SENTENCES["en"]
    texts = [f"{it} {en}", f"{en} {it} {en}", f"{en[:-1]} {it}.", f"{en[:-1]} [{it}] {en}"]
    rows = [(0, i, "user", SENTENCES[k], "s", k, 1) for i, k in enumerate(SENTENCES) for _ in range(60)]
    rows += [(1, i, "user", t, "s", "en", 1) for i, t in enumerate([*texts, f"{en[:-1]} (see page 2) and (the) margin."])]
    got = sorted((r.turn_idx, r.lang) for r in lg.wrong_labels(spark.createDataFrame(rows, TURNS)).collect() if r.conv_idx == 1)
    assert got == [(i, k) for i in range(4) for k in ("en", "it")]
    assert lg.parts_of("1) one (two three four five six (a) seven. Eight) nine :)") == ["1) one", "(two three four five six (a) seven.", "Eight)", "nine :)"]
