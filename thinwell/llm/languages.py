"""Problem 5: languages of turns, by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams, by rank. A
stretch of text is ranked likewise and goes to the language of the least
out-of-place distance (Cavnar and Trenkle, 1994): the sum over its n-grams of the
difference between the two ranks, or of a fixed penalty where the profile lacks
the n-gram. N-grams that no profile has keep no rank and cost the penalty for every
language; a text that is far from all profiles has no language. Profiles are fitted on a
bounded sample of labelled rows.

The texts of a batch are ranked side by side in flat arrays: words are turned into the
numbers of their n-grams once, counts and ranks come from two sorts.

A turn is cut into stretches at sentence ends, line ends, quotation marks and
brackets around as many words as a full sentence has.
Its main language is that of the turn as a whole; a stretch that is a full
sentence (STRETCH words or more) of another language adds that one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thinwell.sources.tables import spread

LANGUAGES = ("en", "fr", "de", "es", "it", "pt", "nl", "ru")
#: Labelled rows of each language that its profile is fitted on, at most.
SAMPLE = 1_000
#: N-grams of a profile, their lengths, and the n-grams of a text that are ranked.
PROFILE, LENGTHS, RANKED = 1_000, (1, 2, 3, 4), 400
#: Words from which a turn is judged, and from which a stretch counts as a full sentence.
WORDS, STRETCH = 4, 5
#: How much nearer another language has to be than the turn's main one to count for a stretch.
MARGIN = 0.03
#: Distance from which a stretch belongs to no language unless the second nearest is farther by the share SURE, and from which it never does.
FAR, SURE, NEVER = 0.55, 0.025, 0.95
#: Characters of text that are ranked at once.
AT_ONCE = 400_000
#: What stands for no language.
NONE = "und"

# Usual spellings of the languages (ISO 639 codes, English and own names).
SPELLINGS = {
    "en": "en eng english",
    "fr": "fr fra fre french français francais",
    "de": "de deu ger german deutsch",
    "es": "es spa spanish español espanol castellano castilian",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands flemish",
    "ru": "ru rus russian русский",
}
# A few frequent words, the profile of a language without labelled rows.
SEEDS = {
    "en": "the of and to in is that for it on with as was which by from at this what who where does how under not are page shows about",
    "fr": "le la les des du et un une dans pour sur est au que qui où quelle page par avec ce selon sans plusieurs pas vous montre",
    "de": "der die das und von zu den mit für auf ist im nicht ein eine dem des wird welche seite zeigt wer wo aus am laut über",
    "es": "el la los las de del y en un una que para por con se su al dónde qué página muestra cuál según sin más varias número",
    "it": "il lo la gli le di del della e in un una che per con da al alla dove quale pagina mostra chi secondo senza più",
    "pt": "o a os as de do da dos e em um uma que para por com no na ao onde qual página mostra quem segundo sem mais não",
    "nl": "de het een van en in is op voor met aan bij te dat die wie waar welke pagina toont volgens onder zonder naar",
    "ru": "и в на не что с по для из от к о за под это кто где какой страница показывает без согласно",
}
CODES = {spelling: code for code, spellings in SPELLINGS.items() for spelling in spellings.split()}

LETTERS = re.compile(r"[^\W\d_]+")
#: Ends of stretches: closing punctuation before a blank, a quotation mark, or the end; line ends; quotation marks.
ENDS = re.compile(r"(?<=[.!?…])[\s]+|\n+|[“”„«»\"]+")
#: Brackets, closing ones with the punctuation behind them.
BRACKETS = re.compile(r"[(\[{]|[)\]}][.,;:!?…]*")
OPENING = {")": "(", "]": "[", "}": "{"}
CAPITAL = re.compile(r"(?<=\s)[^\W\d_a-zа-я]\w*")


def language_code(label: Column) -> Column:
    """The two-letter code that a label names in any usual spelling or with a region; null where it names none."""
    bare = F.regexp_replace(F.lower(F.trim(label)), r"[-_ (].*$", "")
    names = F.create_map(*(F.lit(x) for item in CODES.items() for x in item))
    return F.try_element_at(names, F.when(bare != "", bare))


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


class _WordGrams(dict):
    """N-grams of each word with its bounding blanks, made once; forgets when it has grown large."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) > 200_000:
            self.clear()
        bounded = f" {word} "
        self[word] = grams = [bounded[i : i + n] for n in LENGTHS for i in range(len(bounded) - n + 1) if n > 1 or bounded[i] != " "]
        return grams


def ngrams(text: str, known: _WordGrams) -> Counter:
    """Letter n-grams of the words of `text`, words bounded by blanks."""
    return Counter(g for word in LETTERS.findall(text.lower()) for g in known[word])


def _ranked(found: Counter, most: int) -> list[str]:
    return [g for g, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:most]]


def parts_of(text: str) -> list[str]:
    """The stretches of `text`, in order; a bracket without its partner ends none."""
    if ")" not in text and "]" not in text and "}" not in text:
        return [part for part in map(str.strip, ENDS.split(text)) if part]
    cuts, pending = {0, len(text)}, []
    for found in BRACKETS.finditer(text):
        opening = OPENING.get(found[0][0])
        if opening is None:
            pending.append(found)
            continue
        at = next((i for i in range(len(pending) - 1, -1, -1) if pending[i][0] == opening), None)
        if at is not None:
            if len(text[pending[at].end() : found.start()].split()) >= STRETCH:
                cuts |= {pending[at].start(), found.end()}
            del pending[at:]
    places = sorted(cuts)
    parts = [part.strip() for a, b in zip(places, places[1:]) for part in ENDS.split(text[a:b])]
    return [part for part in parts if part]


class _WordNumbers(dict):
    """Of each word the numbers of its n-grams that some profile has, and how many others it has; forgets when it has grown large."""

    def __init__(self, numbers: dict[str, int]):
        self.numbers, self.grams = numbers, _WordGrams()

    def __missing__(self, word: str) -> tuple[list[int], int]:
        found = [n for g in self.grams[word] if (n := self.numbers.get(g)) is not None]
        self[word] = made = (found, len(self.grams[word]) - len(found))
        return made

    def trim(self) -> None:
        if len(self) > 200_000:
            self.clear()


class Profiles:
    """Rank profiles of the languages, and the distance of texts to them."""

    def __init__(self, ranked: dict[str, list[str]]):
        grams = sorted({g for profile in ranked.values() for g in profile})
        self.numbers = {g: i for i, g in enumerate(grams)}
        self.words = _WordNumbers(self.numbers)
        self.rank = np.full((len(LANGUAGES), len(grams)), 10 * PROFILE, np.int32)
        for j, language in enumerate(LANGUAGES):
            for i, g in enumerate(ranked[language]):
                self.rank[j, self.numbers[g]] = i

    def distances(self, texts: list[str]) -> np.ndarray:
        """Mean out-of-place distance of each text to each language, from 0 to 1; all 1 for a text without letters."""
        self.words.trim()
        flat, lengths, unknown = [], [], []
        for text in texts:
            before, others = len(flat), 0
            for word in LETTERS.findall(text.lower()):
                found, more = self.words[word]
                flat += found
                others += more
            lengths.append(len(flat) - before)
            unknown.append(others)
        out = np.ones((len(texts), len(LANGUAGES)))
        owner = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)
        if not len(owner):
            return out
        # Counts of each n-gram of each text, then n-grams by falling count inside their text.
        key = np.sort(owner << 24 | np.array(flat, np.int64))
        starts = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
        counts = np.diff(np.r_[starts, len(key)])
        key = key[starts]
        order = np.sort((key >> 24) << 40 | (0xFFFF - np.minimum(counts, 0xFFFF)) << 24 | key & 0xFFFFFF)
        owner, gram = order >> 40, order & 0xFFFFFF
        starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
        place = (np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))).astype(np.int32)
        kept = place < RANKED
        owner, gram, place = owner[kept], gram[kept], place[kept]
        starts = np.nonzero(np.r_[True, owner[1:] != owner[:-1]])[0]
        held = np.diff(np.r_[starts, len(owner)])
        # Repeated unknown n-grams count as often as they occur; known ones once, as they are ranked once.
        lost = np.minimum(np.array(unknown)[owner[starts]], RANKED)
        for j, rank in enumerate(self.rank):
            apart = np.minimum(np.abs(rank[gram] - place), PROFILE)
            out[owner[starts], j] = (np.add.reduceat(apart, starts) / PROFILE + lost) / (held + lost)
        return out

    def stretches(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        """(stretch, language, confidence) of each text's stretches, in order.

        Full sentences are judged on their own. The main language is the one of the
        most letters among them, or the whole turn's where there is none; shorter
        stretches, and sentences that are hardly nearer another language, take it. What is
        about equally FAR from several profiles is of no language.
        """
        parts = [parts_of(text) for text in texts]
        asked: list[str] = []
        places: list[tuple[int, list[int]]] = []
        for text, own in zip(texts, parts):
            full = [len(part.split()) >= STRETCH for part in own]
            whole = len(asked) if own and not all(full) else -1
            if whole >= 0:
                asked.append(text)
            at = []
            for part, is_full in zip(own, full):
                at.append(len(asked) if is_full else -1)
                if is_full:
                    asked.append(part)
            places.append((whole, at))
        apart = self.distances(asked)
        least, second = np.partition(apart, 1, axis=1)[:, :2].T if len(asked) else (np.zeros(0), np.zeros(0))
        none = (least > NEVER) | (least > FAR) & (least > (1 - SURE) * second)
        best = np.where(none, len(LANGUAGES), apart.argmin(axis=1)).tolist()
        out = []
        for own, (whole, at) in zip(parts, places):
            votes: Counter = Counter()
            for part, i in zip(own, at):
                if i >= 0:
                    votes[best[i]] += len(part)
            if not votes and own:
                votes[best[whole]] = 1
            main = max(votes, key=votes.__getitem__) if votes else 0
            made = []
            for part, i in zip(own, at):
                language, d = (main, apart[whole]) if i < 0 else (best[i], apart[i])
                if language != main and max(language, main) < len(LANGUAGES) and d[main] - d[language] < MARGIN:
                    language = main
                made.append((part, *self._named(language, d)))
            out.append(made)
        return out

    @staticmethod
    def _named(language: int, d: np.ndarray) -> tuple[str, float]:
        """The name, and by how much the other languages are farther away; of no language, how far all are."""
        if language == len(LANGUAGES):
            return NONE, float(d.min())
        second = min(x for j, x in enumerate(d.tolist()) if j != language)
        return LANGUAGES[language], min(max(1 - d[language] / second, 0.0), 1.0) if second else 0.0


def _fit(table: pa.Table) -> pa.Table:
    """The texts of one language to its profile."""
    known, found = _WordGrams(), Counter()
    for text in table.column("text").to_pylist():
        found.update(ngrams(text, known))
        # Once more without accents, as some texts have lost them.
        found.update(ngrams(_plain(text), known))
    return pa.table({"code": table.column("code")[:1], "grams": pa.array([_ranked(found, PROFILE)], pa.list_(pa.string()))})


def fit_profiles(turns: DataFrame) -> Profiles:
    """Profiles from at most SAMPLE labelled texts of each language, chosen by a hash; a language
    under fifty labelled texts falls back on its seed words."""
    labelled = turns.select("text", language_code(F.col("lang")).alias("code")).where("code is not null and size(split(text, ' ')) >= 4")
    # Rows are chosen by a hash before anything but counts is shuffled; copies of a text are chosen together and melt in the task.
    share = F.create_map(*(F.lit(x) for r in labelled.groupBy("code").count().collect() for x in (r["code"], min(1.0, 4 * SAMPLE / r["count"]))), F.lit(""), F.lit(0.0))
    chosen = labelled.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 30)) < F.try_element_at(share, "code") * (1 << 30))
    order = Window.partitionBy("code").orderBy(F.xxhash64("text"), "text")
    sample = chosen.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE)
    fitted = sample.groupBy("code").agg(F.count("*").alias("n")).where("n >= 50").select("code")
    texts = sample.join(F.broadcast(fitted), "code", "left_semi").select("code", "text").repartition(len(LANGUAGES), "code")
    profiles = texts.groupBy("code").applyInArrow(_fit, "code string, grams array<string>")
    ranked = {row["code"]: row["grams"] for row in profiles.collect()}
    return Profiles({code: ranked.get(code) or _ranked(ngrams(SEEDS[code], _WordGrams()), PROFILE) for code in LANGUAGES})


STRETCHES = "array<struct<stretch: string, lang: string, confidence: double>>"


def _judge(profiles: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("stretch", pa.string()), ("lang", pa.string()), ("confidence", pa.float64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found, low, size = [], 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= AT_ONCE or i + 1 == len(texts):
                    found += profiles.stretches(texts[low : i + 1])
                    low, size = i + 1, 0
            found = [[dict(zip(("stretch", "lang", "confidence"), x)) for x in turn] for turn in found]
            words = [len(t.split()) for t in texts]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(words, pa.int32()), pa.array(found, kind)], [*batch.schema.names[:-1], "words", "stretches"])

    return run


def identify(turns: DataFrame, profiles: Profiles | None = None) -> DataFrame:
    """conv_idx, turn_idx, field, label, words, stretches, langs: each turn with its stretches'
    languages and confidences, and the set of languages it holds.

    `label` is the delivered label as a code, null where it names no language.
    Null and blank texts and texts without letters hold no language, nor do stretches in
    a language without a profile, whose `lang` is NONE. A turn
    delivered twice has two rows; an empty table gives an empty result.
    """
    profiles = profiles or fit_profiles(turns)
    keys = ["conv_idx", "turn_idx", "field"]
    delivered = spread(turns.select(*keys, language_code(F.col("lang")).alias("label"), "text"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in delivered.schema.fields[:-1])
    judged = delivered.mapInArrow(_judge(profiles), f"{types}, words int, stretches {STRETCHES}")
    return judged.withColumn("langs", F.array_except(F.transform("stretches", lambda x: x["lang"]), F.array(F.lit(NONE))))


def wrong_labels(turns: DataFrame) -> DataFrame:
    """conv_idx, turn_idx, field, lang: of each turn of at least WORDS words whose label is missing,
    wrong or not the only language, every language that it holds."""
    judged = identify(turns).where((F.col("words") >= WORDS) & (F.size("langs") > 0))
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return judged.where(wrong).select("conv_idx", "turn_idx", "field", F.explode("langs").alias("lang")).distinct()


def stretch_languages(turns: DataFrame) -> DataFrame:
    """conv_idx, turn_idx, field, stretch_idx, stretch, lang, confidence: one row per stretch; a turn delivered twice counts once."""
    each = identify(turns).select("conv_idx", "turn_idx", "field", F.posexplode("stretches").alias("stretch_idx", "x"))
    return each.select("conv_idx", "turn_idx", "field", "stretch_idx", "x.*").dropDuplicates(["conv_idx", "turn_idx", "field", "stretch_idx", "stretch"])
