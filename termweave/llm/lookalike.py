"""Problem 1: text that looks the same but is made of different characters, brought to one form.

Each text is decomposed, its compatibility forms (width, ligatures, Roman numerals, kinds of space) are resolved except those that
look different (super- and subscripts, fractions, circled and squared signs), and characters without ink are deleted. What is left
of each token is a lattice: every letter that has doubles in other scripts stands for all of them (signs inside a token part its scripts). Viterbi search under character
bigram scores of the corpus, with a price for changing the script inside a token, picks the reading. The lattice depends on the
look alone, so texts that look the same get the same form, and texts that look different never do.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.session import small_side, table

# Letters and signs drawn alike. First the form of the class, then its doubles by script.
ALIKE = {
    "a": "аɑ", "c": "сϲᴄⲥ", "d": "ԁ", "e": "е℮", "g": "ɡ", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛ",
    "s": "ѕꜱ", "u": "ս", "v": "νѵᴠ", "w": "ԝᴡ", "x": "х", "y": "уү", "z": "ᴢ",
    "A": "АΑᎪ", "B": "ВΒ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜϺᎷ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "α": "⍺", "β": "ꞵ", "γ": "ɣ", "ε": "ɛ", "ω": "ꞷ", "χ": "ꭓ", "Δ": "∆", "Σ": "∑", "Π": "∏",
    "-": "‐‑‒–−⁃˗", "'": "’ʼ′", ",": "‚", "/": "∕⁄", ":": "∶꞉", "!": "ǃ",
}
#: Kinds of decomposition that keep the look; the others (super, sub, fraction, circle, square ...) change it.
KEPT = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
# Compatibility characters that are drawn unlike their decompositions.
UNLIKE = frozenset("ſ")
#: Price, in nats, of changing the script inside a token.
CHANGE = 9.0
#: Tokens that a worker keeps with their reading; beyond it the cache starts anew.
CACHE = 200_000

_CLASS = {c: k for k, v in ALIKE.items() for c in v} | {k: k for k in ALIKE}


def _inkless(c: str) -> bool:
    """Format characters, variation selectors, fillers and controls that draw nothing and move nothing."""
    n = ord(c)
    return unicodedata.category(c) == "Cf" or n == 0x034F or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF or 0x180B <= n <= 0x180F or n in (0x115F, 0x1160, 0x3164, 0xFFA0) or (n < 32 and c not in "\t\n\r\v\f") or 0x7F <= n < 0xA0 and n != 0x85


@lru_cache(maxsize=None)
def _compat(c: str) -> str:
    """The plain characters that one character is drawn like; bounded by the number of characters."""
    if _inkless(c):
        return ""
    if c.isspace() or unicodedata.category(c) == "Zs":
        return c if c in "\t\n\r\v\f\x85" else " "
    if c in _CLASS:
        return c
    kind, _, rest = unicodedata.decomposition(c).partition(" ")
    if kind.startswith("<"):
        if kind not in KEPT or c in UNLIKE or rest.startswith("0020 "):
            return c
        return "".join(_compat(chr(int(x, 16))) for x in rest.split())
    return c


class _Table(dict):
    """A translation table that fills itself."""

    def __init__(self, rule):
        super().__init__()
        self.rule = rule

    def __missing__(self, code: int) -> str:
        out = self[code] = self.rule(chr(code))
        return out


_PLAIN = _Table(_compat)
_LOOK = _Table(lambda c: _CLASS.get(c, c))


def _is_plain(text: str) -> bool:
    """Whether a text is made of printable ASCII, which no rule changes."""
    return text.isascii() and text.isprintable()


def plain(text: str) -> str:
    """Compatibility forms resolved and inkless characters deleted; decomposed."""
    if _is_plain(text):
        return text
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_PLAIN))


def look(text: str) -> str:
    """The classes of look of a text: equal exactly for texts that look the same."""
    if _is_plain(text):  # every ASCII character is the form of its class
        return text
    return plain(text).translate(_LOOK)


@lru_cache(maxsize=None)
def script(c: str) -> str:
    """A letter's script as its name gives it; '' for what belongs to all scripts."""
    if not c.isalpha():
        return ""
    return unicodedata.name(c, "").partition(" ")[0]


def readings(c: str) -> tuple[str, ...]:
    """The letters that a class of look may stand for: one per script; signs have one reading."""
    out: dict[str, str] = {}
    for x in (c, *ALIKE.get(c, "")):
        if script(x) or x == c:
            out.setdefault(script(x), x)
    return tuple(out.values()) if script(c) else (c,)


_READINGS = {c: readings(c) for c in ALIKE}
_IN_LATTICE = frozenset(x for v in _READINGS.values() for x in v)


@lru_cache(maxsize=None)
def symbol(c: str) -> str:
    """What the bigrams count: lattice letters as such, other characters by script. At most a few hundred symbols."""
    return c if c in _IN_LATTICE else f"*{script(c)}"


class Reader:
    """Viterbi search on token lattices under bigram counts."""

    def __init__(self, bigrams: dict[tuple[str, str], int]):
        first: Counter = Counter()
        for (a, _), n in bigrams.items():
            first[a] += n
        self.scores = {k: math.log((n + 0.1) / (first[k[0]] + 30.0)) for k, n in bigrams.items()}
        self.rare = {a: math.log(0.1 / (n + 30.0)) for a, n in first.items()}
        self.none = math.log(0.1 / 30.0)
        self._known: dict[str, str] = {}
        self._texts: dict[str, str] = {}

    def _score(self, a: str, b: str) -> float:
        s = self.scores.get((a, b))
        return s if s is not None else self.rare.get(a, self.none)

    def token(self, classes: str) -> str:
        """The best reading of one token given by its classes of look. Ties go to the reading listed first."""
        known = self._known.get(classes)
        if known is not None:
            return known
        states = [("", "", 0.0, "^")]  # reading so far, script, score, last symbol
        for c in classes:
            best = []
            for x in _READINGS.get(c, (c,)):
                sx, kind = symbol(x), script(x)
                top = None
                for text, was, score, last in states:
                    s = score + self._score(last, sx) - (CHANGE if kind and was and kind != was else 0.0)
                    if top is None or s > top[2]:
                        top = (text + x, kind, s, sx)
                best.append(top)
            states = best
        out = max(((self._score(s[3], "$") + s[2], -i, s[0]) for i, s in enumerate(states)))[2]
        if len(classes) <= 64:
            if len(self._known) >= CACHE:
                self._known.clear()
            self._known[classes] = out
        return out

    def read(self, text: str | None) -> str | None:
        """The one form of a text; null stays null, empty stays empty."""
        if text is None:
            return None
        known = self._texts.get(text)
        if known is None:
            known = unicodedata.normalize("NFC", " ".join(self.token(t) for t in look(text).split(" ")))
            if len(text) <= 128:
                if len(self._texts) >= CACHE:
                    self._texts.clear()
                self._texts[text] = known
        return known


def count_bigrams(texts: Iterator[str]) -> Counter:
    tokens: Counter = Counter()
    for t in texts:
        tokens.update(plain(t).split(" "))
    seen: Counter = Counter()
    for token, n in tokens.items():
        s = ["^", *map(symbol, token), "$"]
        for pair in zip(s, s[1:]):
            seen[pair] += n
    return seen


def bigrams_of(texts: DataFrame) -> dict[tuple[str, str], int]:
    """Bigram counts over all texts of a one-column frame, combined before the shuffle. The symbols bound the rows that reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            seen += count_bigrams(t for t in b.column(0).to_pylist() if t)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["a", "b", "n"])

    rows = texts.mapInArrow(count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    return {(r["a"], r["b"]): r["n"] for r in rows}


def one_form(text: Column, bigrams: dict[tuple[str, str], int]) -> Column:
    """The one form of each text. A worker keeps its reader for as long as the counts are the same by content."""
    counts = hashlib.sha256(repr(sorted(bigrams.items())).encode()).hexdigest()

    @F.arrow_udf("string")
    def form(texts: pa.Array) -> pa.Array:
        reader = _READERS.get(counts)
        if reader is None:
            _READERS.clear()
            reader = _READERS[counts] = Reader(bigrams)
        return pa.array([reader.read(t) for t in texts.to_pylist()], pa.string())

    return form(text)


_READERS: dict[str, Reader] = {}


def look_alike_pairs(rows: DataFrame, row_id: str, value: str, terms: DataFrame, key: str, label: str) -> DataFrame:
    """row_id and key of every pair whose texts look the same but differ in characters.

    Null texts never pair; repeated rows each pair; a row pairs with every term of that look. The terms are broadcast only under a
    checked count; beyond it both sides are shuffled and skewed forms are split at run time.
    """
    values = rows.filter(F.col(value).isNotNull()).select(F.col(row_id).alias("_r"), F.col(value).alias("_v"))
    labels = terms.filter(F.col(label).isNotNull()).select(F.col(key).alias("_k"), F.col(label).alias("_l"))
    bigrams = bigrams_of(values.select("_v").unionAll(labels.select("_l")))
    left = values.withColumn("_form", one_form(F.col("_v"), bigrams))
    right = labels.withColumn("_form", one_form(F.col("_l"), bigrams))
    pairs = left.join(small_side(right), "_form").filter("_v <> _l")
    return pairs.select(F.col("_r").alias(row_id), F.col("_k").alias(key))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return look_alike_pairs(table(spark, sf_dir, "text_to_map"), "row_id", "propertyValue", table(spark, sf_dir, "ols_terms"), "iri", "label")


def p1_forms(spark, sf_dir: str) -> DataFrame:
    """Every submitted value and label in its one form."""
    values = table(spark, sf_dir, "text_to_map").select(F.lit("text_to_map").alias("tbl"), F.col("row_id").cast("string").alias("id"), F.col("propertyValue").alias("text"))
    labels = table(spark, sf_dir, "ols_terms").select(F.lit("ols_terms").alias("tbl"), F.col("iri").alias("id"), F.col("label").alias("text"))
    both = values.unionByName(labels)
    return both.select("tbl", "id", one_form(F.col("text"), bigrams_of(both.select("text").filter("text is not null"))).alias("form"))
