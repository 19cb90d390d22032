"""Problem 10: text garbled by a wrong character encoding.

Over the distinct texts of the corpus, adjacent character pairs with a character beyond
ASCII are counted, and single characters. A pair of two letters of one script is seen
against that script's pairs, so a language that is rare in the corpus is as well known as
a frequent one; every other pair is seen against all pairs. A pair is scored by its mutual information,
log2(p(ab) / (p(a) p(b))), with p(a) and p(b) at least RARE: characters rarer than that
occur with few partners whatever they are, so that their pairs would look bound to one another even
where garbling alone brings them together. Maximum-scoring segments of the negative information are
the improbable runs.

So that garbled text does not make itself usual however much of it there is, runs
that are UTF-8 read in another encoding count in their decoded form, capital and small
Cyrillic letters count as one, and pairs that no word has (`strange`) count not at all.

Inside those runs alone, inverse mappings are tried: characters back to the bytes of the
encoding they were read in, and those bytes as UTF-8 (again and again for text
that was garbled repeatedly) or as another single-byte encoding. A mapping is
taken if it makes the run much more probable.

Not recoverable, but found: replacement characters, and question marks inside words
at whose place some accented letter would be usual.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thinwell.sources.session import cut
from thinwell.sources.tables import spread

#: Least share of a character in its mutual information with another, as a power of two, and how far a segment's score may fall before it ends.
RARE, DROP, BETWEEN = 6.0, 8.0, 3.0
#: Bits that a mapping has to gain in all, and for every character that it changes.
GAIN, GAIN_EACH = 8.0, 4.0
#: Bits from which a pair counts as unseen. Pairs that are more frequent number less than 2 ** MOST for each of three
#: totals, so the table that is sent to the workers has a fixed bound (16 bytes each). What an unseen pair costs a text, as a multiple.
MOST, UNSEEN = 18.0, 1.5
#: Codes of what is counted beside pairs: all pairs, pairs of Latin letters, of Cyrillic ones; character c is CHARACTER - c.
ALL, LATIN, CYRILLIC, CHARACTER = -1, -2, -3, -16

#: Encodings that text was read in, for text that is UTF-8, and pairs (read in, true) of single-byte ones.
READ_AS = ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "cp866", "koi8_r", "cp1254", "cp1257", "cp852", "iso8859_15", "mac_cyrillic")
CONFUSED = (
    *((read, "cp1252") for read in ("cp1251", "mac_roman", "cp437", "cp850", "cp1250", "cp866", "koi8_r", "cp852", "cp1253", "iso8859_5")),
    *((read, "cp1251") for read in ("cp1252", "koi8_r", "mac_roman", "cp866", "cp437", "mac_cyrillic", "iso8859_5")),
    *((read, "koi8_r") for read in ("cp1251", "cp1252")),
    *((read, "cp866") for read in ("cp1251", "cp1252")),
)
BEYOND = re.compile(r"[^\x00-\x7f]+")
TWO = re.compile(r"[^\x00-\x7f]{2}")
UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+")
LOST = re.compile(r"(?<!\S)[(\[“\"'«*_]*((?:[^\W\d_]+[’'-])*[^\W\d_]*[^\W\d_A-Z]\?(?=[^\W\d_A-Z])[^\W\d_?]*(?:[?’'-][^\W\d_?]+)*)[)\]”\"'»*_.,;:!?]*(?!\S)")
#: Signs that a garbled letter may stand for.
SIGNS = frozenset("€£°–—“”‘’„‚…«»¿¡©®™·•")
#: Cyrillic letters that a swap has to bring together.
WORD = 4
#: Runs whose outcome a worker remembers.
REMEMBERED = 200_000
ACCENTED = "äöüßéèêëàâçôîïûùñáíóúãõìòåøæœ"


#: The pairs of `strange` as a pattern, for short texts.
_LATIN, _CYRILLIC, _GREEK = "A-Za-zÀ-ÖØ-öø-\u024f", "\u0400-\u052f", "\u0370-\u03ff"
STRANGE = re.compile(rf"(?=[{_LATIN}][{_CYRILLIC}{_GREEK}]|[{_CYRILLIC}{_GREEK}][{_LATIN}]|[{_CYRILLIC}][{_GREEK}]|[{_GREEK}][{_CYRILLIC}]|[a-z\u0430-\u045f][À-ÖØ-Þ\u0400-\u042f])")
PIECES = re.compile(r"([^\x00-\x7f]+)")


class _Bytes(dict):
    """For str.translate: each character as the character of its byte, 0 where the encoding has none."""

    def __missing__(self, point: int) -> str:
        return "\0"


def _bytes_of(encoding: str) -> dict[str, int]:
    """Byte of each character; bytes that the encoding leaves out stand for the control characters of their number."""
    table: dict[str, int] = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        table.setdefault(chr(b), b)
    return table


def _swap(read: str, true: str) -> dict[int, str]:
    out = {}
    for char, b in _bytes_of(read).items():
        try:
            if (real := bytes([b]).decode(true)) != char:
                out[ord(char)] = real
        except UnicodeDecodeError:
            pass
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def latin(x):
    """Which code points are Latin letters; for numbers, arrays and columns alike."""
    return (x >= 65) & (x <= 90) | (x >= 97) & (x <= 122) | (x >= 0xC0) & (x < 0x250) & (x != 0xD7) & (x != 0xF7)


def cyrillic(x):
    return (x >= 0x400) & (x < 0x530)


def strange(a, b):
    """Which pairs no word has: letters of two scripts, a small letter before a capital (beyond ASCII, or both Cyrillic)."""
    greek_a, greek_b = (a >= 0x370) & (a < 0x400), (b >= 0x370) & (b < 0x400)
    mixed = latin(a) & (cyrillic(b) | greek_b) | (cyrillic(a) | greek_a) & latin(b) | cyrillic(a) & greek_b | greek_a & cyrillic(b)
    small = (a >= 97) & (a <= 122) | (a >= 0x430) & (a < 0x460)
    capital = (b >= 0xC0) & (b <= 0xDE) & (b != 0xD7) | (b >= 0x400) & (b < 0x430)
    return mixed | small & capital


def strangers(text: str) -> int:
    """The number of strange pairs in `text`."""
    return len(STRANGE.findall(text))


def folded(x):
    """Code points with capital Cyrillic letters as small ones."""
    return x + 32 * ((x >= 0x410) & (x < 0x430)) + 80 * ((x >= 0x400) & (x < 0x410))


def _decoded(run: str) -> str | None:
    """A run beyond ASCII whose every character is part of common letters or signs in UTF-8 read in another encoding, decoded."""
    for table in DECODERS:
        if all(c in table for c in run):
            try:
                made = bytes(table[c] for c in run).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if all(c in COMMON or "\x80" <= c < "\xa0" for c in made):
                return made
    return None


def plain_form(run: str, known: dict[str, str]) -> str:
    """A run beyond ASCII, decoded as often as `_decoded` can."""
    if run not in known:
        if len(known) >= REMEMBERED:
            known.clear()
        made = run
        for _ in range(4):
            if (again := _decoded(made)) is None:
                break
            made = again
        known[run] = made
    return known[run]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, str] = {}
    for batch in batches:
        texts = [t if t.isascii() else BEYOND.sub(lambda m: plain_form(m[0], known), t) for t in batch.column("text").to_pylist() if t]
        points = _points(" ".join(["", *texts, ""]))
        a, b = points[:-1], points[1:]
        two = {LATIN: int((latin(a) & latin(b)).sum()), CYRILLIC: int((cyrillic(a) & cyrillic(b)).sum())}
        at = np.nonzero(((a | b) > 127) & ~strange(a, b))[0]
        pairs, n = np.unique(folded(a[at]) << 21 | folded(b[at]), return_counts=True)
        single = np.bincount(folded(points))
        held = np.nonzero(single)[0]
        keys = np.concatenate([pairs, [ALL, *two], CHARACTER - held])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate([n, [len(a), *two.values()], single[held]]), pa.int64())], ["pair", "n"])


def count_pairs(docs: DataFrame) -> DataFrame:
    """pair, n: how often each pair beyond ASCII occurs in the distinct texts of the corpus, and each character; see ALL."""
    return docs.select("text").distinct().mapInArrow(_count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def total_of(pair):
    """ALL, LATIN or CYRILLIC: the total that pairs are seen against."""
    a, b = pair >> 21, pair & 0x1FFFFF
    return np.where(latin(a) & latin(b), LATIN, np.where(cyrillic(a) & cyrillic(b), CYRILLIC, ALL))


#: Letters and signs that a decoded run is made of, and the bytes of characters by encoding.
COMMON = frozenset(map(chr, range(0xC0, 0x100))) | frozenset(map(chr, range(0x410, 0x450))) | SIGNS | frozenset("ЁёŒœ\xa0²³½ºª")
DECODERS = [_bytes_of(read) for read in READ_AS]


class Repair:
    """Finds and restores garbled runs, given the counts of pairs."""

    def __init__(self, pairs: np.ndarray, counts: np.ndarray, totals: dict[int, int], characters: dict[int, int]):
        """`characters` are those that make up at least a share of 2 ** -RARE of all, or of the letters of their script."""
        self.totals = {kind: max(n, 2) for kind, n in totals.items()}
        self.most = {kind: min(MOST, float(np.log2(2 * n))) for kind, n in self.totals.items()}
        of = total_of(pairs)
        all_ = np.select([of == LATIN, of == CYRILLIC], [self.totals[LATIN], self.totals[CYRILLIC]], self.totals[ALL])
        self.bits = dict(zip(pairs.tolist(), np.log2(np.maximum(all_ / np.maximum(counts, 1), 1)).tolist()))
        self.characters = characters
        self.reads = [_Bytes({ord(c): chr(b) for c, b in _bytes_of(read).items()}) for read in READ_AS]
        self.swaps = [_swap(read, true) for read, true in CONFUSED]
        self.known: dict[str, tuple[str | None, int]] = {}
        self.seen: dict[str, tuple[float, float, float]] = {}

    def _weigh(self, pair: str) -> tuple[float, float, float]:
        """Information of a pair, its negative mutual information, and what it costs a text."""
        a, b = map(ord, pair)
        x, y = folded(a), folded(b)
        kind = LATIN if latin(a) and latin(b) else CYRILLIC if cyrillic(a) and cyrillic(b) else ALL
        bits = self.most[kind]
        if not strange(a, b):
            bits = min(self.bits.get(x << 21 | y, bits), bits)
        rare = [min(RARE, float(np.log2(self.totals[kind] / n))) if (n := self.characters.get(c)) else RARE for c in (x, y)]
        return bits, bits - max(sum(rare), 0.0), bits if bits < self.most[kind] else bits * UNSEEN

    def weigh(self, pair: str) -> tuple[float, float, float]:
        found = self.seen.get(pair)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[pair] = found = self._weigh(pair)
        return found

    def information(self, a: str, b: str) -> float:
        return self.weigh(a + b)[0]

    def total(self, text: str) -> tuple[float, float]:
        """Cost of the pairs of `text` that hold a character beyond ASCII: the sum and the mean."""
        bits = [self.weigh(a + b)[2] for a, b in zip(text, text[1:]) if a > "\x7f" or b > "\x7f"]
        return sum(bits), sum(bits) / len(bits) if bits else 0.0

    def segments(self, text: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments (first, past last character), widened to whole runs beyond ASCII; `text` begins and ends with a blank."""
        out: list[list[int]] = []
        score = best = 0.0
        start = end = last = -1

        def close():
            if best > 0:
                low, high = start, end
                while low > 0 and text[low] > "\x7f":
                    low -= 1
                while high < len(text) and text[high - 1] > "\x7f":
                    high += 1
                if out and low < out[-1][1]:
                    out[-1][1] = max(high, out[-1][1])
                else:
                    out.append([low, high])

        for run in BEYOND.finditer(text):
            for i in range(run.start() - 1, run.end()):
                if i <= last:
                    continue
                if last >= 0:
                    score -= BETWEEN * (i - last - 1)
                if best - score > DROP or score < 0:
                    close()
                    score = best = 0.0
                gain = self.weigh(text[i : i + 2])[1]
                if score <= 0:
                    score, best, start = 0.0, 0.0, i
                score += gain
                if score > best:
                    best, end = score, i + 2
                last = i
        close()
        return [(a, b) for a, b in out]

    def _utf8(self, run: str, table: _Bytes) -> str | None:
        """`run` with the sequences that are UTF-8 in its bytes decoded; None where there are none."""
        pieces = PIECES.split(run)
        data = [piece.translate(table).encode("latin-1") for piece in pieces[1::2]]
        if not any(map(UTF8.search, data)):
            return None
        out = []
        for i, piece in enumerate(pieces):
            at = 0
            for found in UTF8.finditer(data[i // 2]) if i % 2 else ():
                out.append(piece[at : found.start()])
                out.append(found[0].decode("utf-8"))
                at = found.end()
            out.append(piece[at:])
        return "".join(out)

    def _placed(self, run: str, made: str, true: str) -> bool:
        """Whether swapped letters stand where letters of their script do: Cyrillic ones at least WORD
        together, Latin ones mostly beside a letter of ASCII; signs for signs alone prove nothing."""
        if any(a != b and a.isalpha() and not b.isalpha() and b not in SIGNS for a, b in zip(run, made)):
            return False
        changed = [i for i, (a, b) in enumerate(zip(run, made)) if a != b and b.isalpha()]
        if true != "cp1252":
            return any(cyrillic(ord(made[i])) and all(cyrillic(ord(c)) for c in made[i - WORD + 1 : i]) for i in changed[WORD - 1 :])
        if not changed and not any(a != b and a.isalpha() for a, b in zip(run, made)):
            return False
        beside = sum(any(0 <= j < len(made) and made[j].isascii() and made[j].isalpha() for j in (i - 1, i + 1)) for i in changed)
        return 2 * beside >= len(changed)

    def restore(self, run: str) -> tuple[str | None, int]:
        """The most probable inverse of a run, or None where none is much more probable, and the number of the swap that made it, or -1."""
        if run not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[run] = self._restore(run)
        return self.known[run]

    def again(self, run: str, swap: int) -> str | None:
        """A run by a swap that has restored another run of its text, if that makes it more probable at all."""
        made = run.translate(self.swaps[swap])
        return made if made != run and strangers(made) <= strangers(run) and self.total(made)[0] < self.total(run)[0] else None

    def _restore(self, run: str) -> tuple[str | None, int]:
        before, mean = self.total(run)
        best, gain, by = None, 0.0, -1
        for table in self.reads if TWO.search(run) else ():
            made = self._utf8(run, table)
            for _ in range(3):
                if made is None:
                    break
                after, now = self.total(made)
                if before - after > gain and before - after >= GAIN and now <= mean:
                    best, gain = made, before - after
                again = [m for t in self.reads if (m := self._utf8(made, t))]
                made = min(again, key=lambda m: self.total(m)[0], default=None)
        tried, odd = {(run, true) for _, true in CONFUSED}, strangers(run)
        for number, ((_, true), swap) in enumerate(zip(CONFUSED, self.swaps)):
            made = run.translate(swap)
            if (made, true) in tried:
                continue
            tried.add((made, true))
            if strangers(made) > odd:
                continue
            changed = sum(a != b for a, b in zip(run, made))
            g = before - self.total(made)[0]
            if g > gain and g >= max(GAIN, GAIN_EACH * changed) and self._placed(run, made, true):
                best, gain, by = made, g, number
        return best, by

    def lost(self, text: str) -> bool:
        """Whether a question mark stands inside a word where an accented letter is usual."""
        for word in LOST.finditer(text) if "?" in text else ():
            w = word[1]
            for i in range(1, len(w) - 1):
                if w[i] == "?" and min((max(self.information(w[i - 1], c), self.information(c, w[i + 1])) for c in ACCENTED)) < 2 * RARE + 4:
                    return True
        return False

    def repair(self, text: str) -> tuple[str, int, int]:
        """Text with its garbled runs restored, the number of restored runs, and of those beyond recovery."""
        lost = text.count("�") + self.lost(text)
        if text.isascii():
            return text, 0, lost
        padded = f" {text} "
        runs = [[low, high, *self.restore(padded[low:high])] for low, high in self.segments(padded)]
        swaps = {by for *_, by in runs if by >= 0}
        parts, at, restored = [], 0, 0
        for low, high, made, _ in runs:
            low = max(low, at)
            run = padded[low:high]
            for swap in swaps if made is None else ():
                made = made or self.again(run, swap)
            if made is not None:
                parts += [padded[at:low], made]
                at = high
                restored += 1
            elif re.search("[\x80-\x84\x86-\x9f]", run):
                lost += 1
        parts.append(padded[at:])
        return ("".join(parts)[1:-1] if restored else text), restored, lost


def _repair(helper: Repair):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, restored, lost = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                made, n, beyond = helper.repair(text)
                if n or beyond:
                    ids.append(doc_id)
                    texts.append(made)
                    restored.append(n)
                    lost.append(beyond)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(restored, pa.int32()), pa.array(lost, pa.int32())], ["doc_id", "text", "restored", "lost"])

    return run


def repair_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, restored, lost: every garbled document with its text as far as it can be
    restored, the number of restored runs and of those beyond recovery.

    Null, empty and blank texts, and texts without a garbled run, give no row; a row
    delivered twice gives one. Statistics are counted over all distinct texts.
    """
    docs = spread(docs.select("doc_id", "text"))
    counted = cut(count_pairs(docs))
    totals = {kind: 0 for kind in (ALL, LATIN, CYRILLIC)} | {row["pair"]: row["n"] for row in counted.where(F.col("pair").between(CYRILLIC, ALL)).collect()}
    # A character weighs in from a share of 2 ** -RARE of the least total: at most 2 ** RARE characters for each.
    least = lambda bits: F.lit(min(filter(None, totals.values()), default=1) / 2**bits)
    frequent = counted.where((F.col("pair") <= CHARACTER) & (F.col("n") >= least(RARE))).collect()
    first, second = F.shiftright("pair", 21), F.col("pair").bitwiseAND(F.lit(0x1FFFFF))
    of = F.when(latin(first) & latin(second), totals[LATIN]).when(cyrillic(first) & cyrillic(second), totals[CYRILLIC]).otherwise(totals[ALL])
    table = counted.where((F.col("pair") >= 0) & (F.col("n") * 2**MOST >= of)).toPandas()
    helper = Repair(table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), totals, {CHARACTER - row["pair"]: row["n"] for row in frequent})
    return docs.mapInArrow(_repair(helper), "doc_id bigint, text string, restored int, lost int").dropDuplicates(["doc_id"])


def garbled_documents(docs: DataFrame) -> DataFrame:
    return repair_documents(docs).select("doc_id")
