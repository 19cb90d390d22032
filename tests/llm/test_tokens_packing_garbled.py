import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from thinwell.llm import garbled as gb
from thinwell.llm import packing as pk
from thinwell.llm import tokens as tk

DOCS = "doc_id bigint, text string, ids int, size int, batch int"
STRANGE = ["", None, " ", "\n\n  x", "it's we'll I'VE", "a  b\t\tc ", "x²+y³≈√336 ± ½", "été naïve été", "👍🏽 👩‍🔬 🇳🇱", "日本語の請求書 第27号", "a​b‍c ⁦202⁩", "ﬁne ＦＵＬＬ", "   　x　", "<|endoftext|> <|x|>", "\x85\x1c\x1fq ", "w" * 30_000, "one\r\ntwo", "ใบเสร็จ 297 บาท", "�﻿"]


@pytest.fixture(scope="module")
def tokenizer():
    made = Tokenizer.from_file(f"{tk.TOKENIZERS}/{tk.BYTE_BPE}")
    made.encode_special_tokens = True
    return made


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0, 0, 0) for i, t in enumerate(texts)], DOCS)


def test_ids_equal_the_tokenizer(spark, tokenizer, monkeypatch):
    rng = random.Random(4)
    alphabet = list("abcXYZ 019'.,!?\n\té漢😀") + ["  ", "'s", "'ll"]
    texts = STRANGE + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(300)]
    monkeypatch.setattr(tk, "BATCH", 2_000)
    got = {r.doc_id: list(r.ids) for r in tk.encode_documents(frame(spark, texts)).collect()}
    want = tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert len(got) == len(texts) and all(got[i] == e.ids for i, e in enumerate(want))
    decoded = {r.doc_id: r.text for r in tk.decode_documents(tk.encode_documents(frame(spark, texts))).collect()}
    assert all(decoded[i] == (t or "") for i, t in enumerate(texts))


def test_encode_edges(spark):
    assert tk.encode_documents(frame(spark, [])).count() == 0
    assert [list(r.ids) for r in tk.encode_documents(frame(spark, [None, ""])).collect()] == [[], []]
    twice = tk.encode_documents(frame(spark, ["ab"]).unionByName(frame(spark, ["ab"]))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]
    same = spark.createDataFrame([(7, "ab", 0, 0, 0), (7, "cd ef", 0, 0, 0), (None, "x", 0, 0, 0), (None, None, 0, 0, 0)], DOCS)
    assert sorted((r.doc_id or 0, r.text) for r in tk.decode_documents(tk.encode_documents(same)).collect()) == [(0, ""), (0, "x"), (7, "ab"), (7, "cd ef")]
    odd = spark.createDataFrame([(1, [5, 10_000_000, -3]), (2, None), (3, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: len(r.text) for r in tk.decode_documents(odd).collect()} == {1: 1, 2: 0, 3: 0}


def test_counts_equal_the_ids(spark):
    docs = frame(spark, STRANGE)
    assert {r.doc_id: r.size for r in tk.count_tokens(docs).collect()} == {r.doc_id: len(r.ids) for r in tk.encode_documents(docs).collect()}


@given(st.lists(st.integers(1, 12), max_size=14), st.integers(12, 20))
@settings(max_examples=60, deadline=None)
def test_plan_packs_everything(sizes, capacity):
    counts = np.bincount(sizes, minlength=capacity + 1)
    plan = pk.completion_plan(counts, capacity)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= capacity and times > 0
        for s in filling:
            used[s] += times
    assert used == Counter(sizes)
    # A packing in decreasing order of size, each item to the fullest container that takes it.
    bins = []
    for s in sorted(sizes, reverse=True):
        room = [b for b in range(len(bins)) if bins[b] + s <= capacity]
        if room:
            bins[max(room, key=bins.__getitem__)] += s
        else:
            bins.append(s)
    assert sum(t for _, t in plan) <= len(bins) + 1


@given(st.lists(st.integers(1, 30), min_size=1, max_size=12), st.integers(30, 60))
@settings(max_examples=150, deadline=None)
def test_best_filling_wastes_least(sizes, capacity):
    """Against all subsets: the fullest filling, and of those the one with the largest items."""
    counts, largest = np.bincount(sizes, minlength=capacity + 1), max(sizes)
    rest = sorted(sizes, reverse=True)[1:]
    subsets = {()}
    for s in rest:
        subsets |= {(*x, s) for x in subsets if largest + sum(x) + s <= capacity}
    full = max(map(sum, subsets))
    assert pk.best_filling(counts, largest, capacity) == [largest, *max(x for x in subsets if sum(x) == full)]


def test_best_filling_is_exact_on_small_sets():
    counts = np.bincount([9, 6, 5, 3, 3, 2], minlength=16)
    assert sum(pk.best_filling(counts, 9, 15)) == 15


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(pk, "RANKED", 50)
    rng = random.Random(2)
    sizes = [rng.choice([70, 70, 70, rng.randrange(1, 300)]) for _ in range(600)] + [1024, 2048, 5000, 0, -1, None]
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, size int")
    rows = pk.pack(items).collect()
    load, total, pieces = Counter(), Counter(), defaultdict(list)
    for r in rows:
        load[r.container] += r.size
        total[r.doc_id] += r.size
        pieces[r.doc_id].append(r.piece)
    assert max(load.values()) <= 1024 and total == Counter({i: s for i, s in enumerate(sizes) if s and s > 0})
    assert all(len(p) == 1 or sizes[i] > 1024 for i, p in pieces.items())
    least = -(-sum(load.values()) // 1024)
    assert len(load) <= least + 2 and sorted(load) == list(range(len(load)))
    waste = pk.container_waste(pk.pack(items)).first()
    assert (waste.containers, waste.tokens, waste.at_least) == (len(load), sum(load.values()), least)
    assert pk.pack(items.limit(0)).count() == 0


WORDS = {
    "fr": "La pièce numérisée précise l’écart relevé à côté du titre où l’adresse répète la référence déjà signée par l’élève.",
    "de": "Die Prüfung erklärt die fehlende Überschrift für das Büro und erwähnt mögliche Änderungen außerhalb der Größe.",
    "ru": "Вторая страница показывает недостающую подпись и сумму счёта на полях, по данным протокола осмотра.",
    "en": "The second page costs 12 € and shows “the margin” at 20 °C – no more.",
}


def corpus():
    rng = random.Random(3)
    out = []
    for _ in range(120):
        for text in WORDS.values():
            words = text.split()
            at = rng.randrange(len(words) // 2)
            out.append(" ".join(words[at : at + 9 + rng.randrange(8)]))
    return out


GARBLED = {
    "cp1252": lambda t: t.encode().decode("cp1252", errors="replace"),
    "latin1": lambda t: t.encode().decode("latin1"),
    "twice": lambda t: t.encode().decode("latin1").encode().decode("latin1"),
    "mac": lambda t: t.encode().decode("mac_roman"),
    "cp437": lambda t: t.encode().decode("cp437"),
    "cp1252 as cp1251": lambda t: t.encode("cp1252", errors="ignore").decode("cp1251", errors="ignore"),
    "cp1252 as mac": lambda t: t.encode("cp1252", errors="ignore").decode("mac_roman"),
}


def test_garbled_texts_are_found_and_restored(spark):
    clean = corpus()
    kept = ["HÂLIBY IRMÃ «Âge»", "x²+y³≈√336 ± ½ µ § ¶", "├── AB-12\n│   └── page", "견본 문서 47", "Ærø Œuvre ŽŠ", "name=a?b&c=1 ja/nee?", None, "", "plain"]
    bad = [(name, t, make(t)) for name, make in GARBLED.items() for t in (WORDS["fr"], WORDS["de"])]
    bad += [("ru", WORDS["ru"], WORDS["ru"].encode().decode("cp1251", errors="ignore")), ("ru", WORDS["ru"], WORDS["ru"].encode("cp1251").decode("koi8_r"))]
    texts = clean + kept + [b for *_, b in bad] + ["Une r�gle", "La num?risée"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(len(clean) + len(kept), bad[0][2], 0)], "doc_id bigint, text string, pair int")
    got = {r.doc_id: r for r in gb.repair_documents(docs).collect()}
    first = len(clean) + len(kept)
    assert set(got) == set(range(first, len(texts)))
    whole = [got[first + i].text == t for i, (name, t, b) in enumerate(bad)]
    assert sum(whole) >= len(bad) - 5
    assert got[len(texts) - 2].lost == 1 and got[len(texts) - 1].lost == 1
    assert gb.garbled_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["cp1252", "latin1", "twice", "mac", "cp437", "cp1252 as cp1251"])
def test_frequent_garbling_is_found(spark, name):
    """Garbled texts that make up a third of the rows, copies or not, do not pass for usual."""
    clean, rng = corpus(), random.Random(6)
    bad = [GARBLED[name](WORDS["fr"])] * 120
    bad += [GARBLED[name](" ".join(rng.sample(WORDS["fr"].split(), 12)) + f" {i}") for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(clean + bad)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in gb.repair_documents(docs).collect()}
    assert set(got) == set(range(len(clean), len(clean) + len(bad)))
    if name == "latin1":
        assert got[len(clean)].text == WORDS["fr"]


def misread(text, encoding):
    """UTF-8 read in a single-byte encoding; bytes that it leaves out stay as control characters."""
    return "".join(bytes([b]).decode(encoding, "ignore") or chr(b) for b in text.encode())


@pytest.mark.parametrize("share", [0.03, 0.1, 0.25])
def test_garbling_of_a_share_of_a_corpus(spark, share):
    """However many texts of a corpus are garbled, nearly all are found and restored whole, and no other is touched."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    clean = {r.doc_id: r.text for r in rows if r.text}
    for r in gb.repair_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        clean.pop(r.doc_id)
    accented = sorted(i for i, t in clean.items() if any("à" <= c <= "ü" or "а" <= c <= "я" for c in t))
    bad = random.Random(1).sample(accented, int(share * len(clean)))
    docs = spark.createDataFrame([(i, misread(t, "cp1252") if i in set(bad) else t) for i, t in clean.items()], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in gb.repair_documents(docs).collect()}
    assert not set(got) - set(bad) and len(got) >= 0.98 * len(bad)
    assert sum(got.get(i) == clean[i] for i in bad) >= 0.9 * len(bad)


def test_mutual_information_within_a_script(spark):
    """A pair of letters that never meet is improbable in its script, however rare the script is in the corpus."""
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus() * 3)], "doc_id bigint, text string").distinct()
    found = {r.pair: r.n for r in gb.count_pairs(docs).collect()}
    pairs = {p: n for p, n in found.items() if p >= 0}
    totals = {k: found[k] for k in (gb.ALL, gb.LATIN, gb.CYRILLIC)}
    helper = gb.Repair(np.array(list(pairs)), np.array(list(pairs.values())), totals, {gb.CHARACTER - p: n for p, n in found.items() if p <= gb.CHARACTER})
    assert helper.weigh("ра")[1] < 0 < helper.weigh("ьы")[1] and helper.weigh("ра")[0] < helper.weigh("ьы")[0]
    assert helper.weigh("аЯ")[1] > 0 and helper.weigh("РА") == helper.weigh("ра")
    assert all(n > 0 for n in totals.values()) and totals[gb.CYRILLIC] < totals[gb.LATIN] < totals[gb.ALL]


def test_swapped_cyrillic_encodings(spark):
    """Russian read in another single-byte encoding is found; a swap that restores one run helps the others of its text."""
    docs = [(i, t) for i, t in enumerate(corpus())]
    text = f"{WORDS['ru']} {WORDS['ru'].upper()} 12 €"
    bad = [(1000, text.encode("cp1251").decode("cp1252", "replace")), (1001, WORDS["ru"].encode("cp866").decode("cp1251", "replace")), (1002, misread(WORDS["ru"], "cp1251"))]
    got = {r.doc_id: r.text for r in gb.repair_documents(spark.createDataFrame(docs + bad, "doc_id bigint, text string")).collect()}
    assert set(got) == {1000, 1001, 1002} and got[1002] == WORDS["ru"] and WORDS["ru"] in got[1000]
