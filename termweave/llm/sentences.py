"""Problem 10: sentence units of documents in many languages and scripts.

Document-centred disambiguation. Whether a word before a period is an abbreviation, and whether the word after it is a name, is read off the
document's own unambiguous places: a period followed by a small letter, a digit or a comma; the word in the middle of a sentence without a
period; a capital in the middle of a sentence. Where the document is silent, counts over the whole corpus decide, which also tell abbreviations
that never end a text from those that may. A short list of common abbreviations is the prior where both are silent. Scripts bring their own rules:
terminators without spaces, spaces as terminators (Thai), and the quotation habits that tell whether a sentence goes on behind a closing
quote. What stands in matched quotes or brackets never ends the sentence around it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.session import BROADCAST_ROWS, cut_lineage, is_small, table

# Common abbreviations, the prior where document and corpus are silent. A sentence does not end behind these.
OPEN_ABBREVIATIONS = frozenset("mr mrs ms dr prof st no nr fig figs eq tab vol pp cf vs e.g i.e al approx ca resp suppl deg z.b d.h bzw vgl sra núm pág т.е рис табл см г डॉ".split())
# Abbreviations behind which a sentence may also end.
FINAL_ABBREVIATIONS = frozenset("etc inc ltd co a.m p.m usw prep jr т.д т.п др".split())
# Months, which follow a day written with a period.
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())
# Verbs that report what was quoted before them.
REPORTING = frozenset("asked wrote said noted replied added schrieb fragte sagte anotó escribió dijo note écrit demanda записал сказал написал ऐसा".split())
# Letters that follow a closing quote inside a Japanese sentence.
PARTICLES = "とはがをのにでもっ"
# What a letter I, V or X counts behind.
COUNTED = frozenset("stage type grade phase class stadium tipo stade".split())

#: An abbreviation ends no sentence if, with 95 % confidence, less than this share of its uses ends a text, paragraph, quotation or bracket.
CLOSES = 0.05
_TERMS = ".!?…。！？।॥؟｡"
_WIDE = "。！？｡।॥؟"
_PAIRS = {"“": "”", "„": "“", "«": "»", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "【": "】"}
_CLOSERS = frozenset("”“»)]）」』】\"'’")
_BRACKETS = "([（【"
_OPENING = frozenset("“„«(（[「『【\"¿¡'‘")
_EVENT = re.compile(r"[.!?…。！？।॥؟｡]+|\n|(?<=[฀-๿])[^\S\n]+(?=[฀-๿])")
_MARKER = re.compile(r"[ \t]*(?:[-–•*‣·]|\(?\d{1,3}[.)]|\(?[a-z]\))[ \t]+\S")
_COUNTER = re.compile(r"\((?:[a-z]|\d{1,2})\) ")
_QUOTABLE = re.compile(r"[“”„«»()\[\]（）「」『』【】\"]")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
_WORD_BEFORE = re.compile(r"[^\s“”„«»()\[\]（）「」\"¿¡,;:]*\Z")
_WORD = re.compile(r"[^\W\d_]+(?:[-’'.][^\W\d_]+)*")
# A letter with the marks that some scripts write around it.
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036F\u0591-\u05BD\u0610-\u061A\u064B-\u065F\u0670\u0900-\u0903\u093A-\u094F\u0951-\u0957\u0962\u0963])"
_BEFORE = re.compile(rf"[^\W\d_](?:{_LETTER}|[.-](?={_LETTER}))*\Z")
_END = re.compile(r"\s*\Z|[^\S\n]*\n\s*\n")
_LETTERS = re.compile(r"[^\W\d_]+")


def _east(c: str) -> bool:
    """Scripts written without spaces between words."""
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "＀" <= c <= "￯" or "　" <= c <= "〿"


def _starts_small(text: str, at: int) -> bool:
    """Whether a word that cannot open a sentence starts here: a small letter, unless a capital follows inside the word (pH, mRNA)."""
    if not text[at : at + 1].islower():
        return False
    m = _LETTERS.match(text, at)
    return not (m and any(c.isupper() for c in m.group()))


def dotted_words(text: str) -> dict[str, list[int]]:
    """Of each word (in small letters) before a period that no letter or digit follows: how often the sentence goes on for certain, how often it bears a period, how often
    it ends a text, paragraph, quotation or bracket, how often a digit follows (which in one document tells nothing, as sentences may begin with one)."""
    seen: dict[str, list[int]] = {}
    i = text.find(".")
    while i >= 0:
        c = text[i + 1 : i + 2]
        if not c.isalnum() and c != ".":
            last = text[max(0, i - 40) : i].split(" ")[-1]
            m = _BEFORE.search(last) if last else None
            if m:
                word = m.group().lower()
                counts = seen.get(word)
                if counts is None:
                    counts = seen[word] = [0, 0, 0, 0]
                counts[1] += 1
                if c == " " and text[i + 2 : i + 3].isalnum():  # the usual case
                    if text[i + 2].isdigit():
                        counts[3] += 1
                    elif _starts_small(text, i + 2):
                        counts[0] += 1
                elif c and c in ",;:":
                    counts[0] += 1
                elif c in _CLOSERS or _END.match(text, i + 1):
                    counts[2] += 1
                elif c.isspace():
                    n = i + 2
                    while text[n].isspace():
                        n += 1
                    if text[n].isdigit():
                        counts[3] += 1
                    elif text[n] in "»”)]）」』":
                        counts[2] += 1
                    elif _starts_small(text, n):
                        counts[0] += 1
        i = text.find(".", i + 1)
    return seen


def occurrences(text: str, word: str) -> Iterator[int]:
    """Places where the word stands as written, letters on neither side."""
    at, n = text.find(word), len(word)
    while at >= 0:
        if not (at and text[at - 1].isalpha()) and not text[at + n : at + n + 1].isalpha():
            yield at
        at = text.find(word, at + 1)


def inside(text: str, at: int) -> bool:
    """Whether what stands here is in the middle of a sentence for certain: behind a small letter or a comma and a space."""
    return at >= 2 and text[at - 1] == " " and (text[at - 2].islower() or text[at - 2] == ",")


class Document:
    """What a document's unambiguous places say of a word. Each word is looked up when it is first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.dotted = dotted_words(text)
        self._plain: dict[str, bool] = {}
        self._names: dict[str, bool] = {}

    def goes_on(self, low: str) -> bool:
        counts = self.dotted.get(low)
        return bool(counts and counts[0] and counts[0] * 3 >= counts[1])

    def plain(self, word: str) -> bool:
        """Whether the word, as it is written, stands without a period in the middle of a sentence."""
        known = self._plain.get(word)
        if known is None:
            n = len(word)
            known = self._plain[word] = any(self.text[at + n : at + n + 1] != "." and inside(self.text, at) for at in occurrences(self.text, word))
        return known

    def name(self, word: str) -> bool:
        """Whether the word is written large in the middle of a sentence and never small."""
        if not word[:1].isupper():
            return False
        known = self._names.get(word)
        if known is None:
            known = any(inside(self.text, at) for at in occurrences(self.text, word)) and next(occurrences(self.text, word.lower()), None) is None
            self._names[word] = known
        return known


def least_share(hits: int, of: int) -> float:
    """The lower end of the 95 % interval of a share."""
    z = 1.96
    return (hits / of + z * z / (2 * of) - z * ((hits / of * (1 - hits / of) + z * z / (4 * of)) / of) ** 0.5) / (1 + z * z / of)


def corpus_class(goes_on: int, dotted: int, closes: int, plain: int) -> str:
    """What corpus counts say of a word: "open" for an abbreviation that ends no sentence, "final" for one that may, "" for neither.

    An abbreviation mostly bears a period, and the sentence goes on behind a good part of its uses.
    """
    if goes_on < 2 or goes_on * 3 < dotted or dotted < plain:
        return ""
    return "open" if least_share(dotted - closes, dotted) >= 1 - CLOSES else "final"


class Splitter:
    """Sentence spans of a text; ``corpus`` has the abbreviations that the corpus shows with their class. Without ``evidence`` only the prior is asked."""

    def __init__(self, corpus: dict[str, str] | None = None, evidence: bool = True):
        self.corpus, self.evidence = corpus or {}, evidence

    def spans(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) in code points of each sentence, without outer white space. Null, empty and blank texts give none."""
        if not text or text.isspace():
            return []
        self.text, self._document = text, None
        quoted = self._quoted()
        out, start, at, q = [], 0, 0, 0
        for m in _EVENT.finditer(text):
            i, e = m.span()
            if i < at:
                continue
            while q < len(quoted) and quoted[q][1] < i:  # closed before this event
                closed = self._after_quote(start, *quoted[q])
                if closed:
                    out.append((start, closed))
                    start = closed
                q += 1
            inside = q < len(quoted) and quoted[q][0] < i
            if text[i] == "\n":
                if not inside and self._breaks(start, i):
                    out.append((start, i))
                    start = i
                continue
            if inside:
                continue
            end = e if text[i].isspace() else self._ends(start, i, e)
            if end:
                out.append((start, end))
                start = at = end
        while q < len(quoted):
            closed = self._after_quote(start, *quoted[q])
            if closed:
                out.append((start, closed))
                start = closed
            q += 1
        out.append((start, len(text)))
        return [s for s in (self._trim(*s) for s in out) if s[0] < s[1]]

    def _trim(self, a: int, b: int) -> tuple[int, int]:
        piece = self.text[a:b]
        left = len(piece) - len(piece.lstrip())
        return a + left, a + left + len(piece.strip())

    def _quoted(self) -> list[tuple[int, int]]:
        """Outermost matched pairs of quotes or brackets. A pair does not span a blank line; a mark without partner counts as none."""
        text, out, stack = self.text, [], []
        if not _QUOTABLE.search(text):
            return out
        limits = [m.start() for m in _BLANK_LINE.finditer(text)] + [len(text)]
        block = 0

        def close(k: int, i: int) -> None:
            a = stack[k][0]
            del stack[k:]
            while out and out[-1][0] > a:
                out.pop()
            out.append((a, i))

        for m in _QUOTABLE.finditer(text):
            i, c = m.start(), m.group()
            while i > limits[block]:
                block += 1
                stack.clear()
            match = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == c), None)
            if match is not None:
                close(match, i)
            elif c == '"':
                if i + 1 < len(text) and not text[i + 1].isspace():
                    stack.append((i, c))
            elif c in _PAIRS:
                stack.append((i, _PAIRS[c]))
        # Pairs were appended as they closed; keep the outermost in order.
        top = []
        for a, b in sorted(out):
            if not top or a > top[-1][1]:
                top.append((a, b))
        return top

    def _next(self, at: int) -> int:
        n = len(self.text)
        while at < n and self.text[at].isspace():
            at += 1
        return at

    def _breaks(self, start: int, i: int) -> bool:
        """Whether the line break at i ends a unit: a blank line, a list item or heading on either side, or a line that begins like a sentence."""
        text = self.text
        before = text[start:i].strip()
        if not before:
            return False
        rest = self._next(i)
        if rest >= len(text) or text.count("\n", i, rest) > 1:
            return True
        line = text.rfind("\n", i, rest) + 1
        if _MARKER.match(text, line):
            return True
        if _starts_small(text, rest):
            return False
        if text[rest].islower():  # pH, mRNA: a unit of its own behind a heading, a list item or an end
            own_line = "\n" not in before and len(before) < 60
            return bool(_MARKER.match(before + " x") or before[-1] in _TERMS or own_line)
        if before[-1] in ",;" or (len(text[text.rfind("\n", 0, i) + 1 : i]) > 60 and before[-1].isalpha() and before[-1].lower() != before[-1].upper() and not _MARKER.match(before)):
            return False
        if before[-1] == "." and before[-2:-1] != ".":
            return self.abbreviation(_WORD_BEFORE.search(before[:-1]).group()) != "open"
        return True

    def _after_quote(self, start: int, a: int, b: int) -> int:
        """The end of the sentence if it ends with the quote or bracket from a to b, else 0."""
        text = self.text
        if a < start:
            return 0
        k = b - 1
        while k > a and (text[k].isspace() or text[k] in _CLOSERS):
            k -= 1
        if text[k] not in _TERMS:
            return 0
        lead = text[start:a].strip()
        if text[a] in _BRACKETS:
            if lead:
                return 0
        elif lead and lead[-1] not in ":,：，、":
            return 0
        end = b + 1
        nxt = self._next(end)
        if nxt >= len(text):
            return end
        c = text[nxt]
        if c in _TERMS or c in ",;:—–-،؛、，；：" and not ("\n" in text[end:nxt] and _MARKER.match(text, text.rfind("\n", 0, nxt) + 1)):
            return 0
        if _starts_small(text, nxt):
            return 0
        word = _LETTERS.match(text, nxt)
        if text[a] in _BRACKETS:
            return end
        if word and word.group().lower() in REPORTING or text.startswith("ऐसा", nxt):
            return 0
        if nxt == end and text[b] in "」』" and c in PARTICLES:
            return 0
        if nxt == end and text[b] == "”" and text[k] in "？！?!" and _east(c) and c not in _OPENING and "（" != c:
            return 0
        return end

    def _ends(self, start: int, i: int, e: int) -> int:
        """The end of the sentence if the terminators from i to e end it, else 0."""
        text, n = self.text, len(self.text)
        group, end = text[i:e], e
        while end < n and text[end] in "”»)]）」』\"’" and not text[end - 1].isspace():
            end += 1
        nxt = self._next(end)
        if nxt >= n:
            return end
        c, gap = text[nxt], text[end:nxt]
        if c in ",;:،؛、，；：" or c in "—–" and gap:
            return 0
        if any(t in _WIDE for t in group):
            return end
        if "!" in group or "?" in group:
            if not gap:
                return end if _east(c) or "฀" <= c <= "๿" or (c.isupper() and text[i - 1 : i].isalpha()) or c in "“„«¿¡「（" else 0
            return 0 if _starts_small(text, nxt) else end
        if "…" in group or len(group) > 1:
            if _east(c) or _east(text[i - 1 : i] or " "):
                return end
            return 0 if _starts_small(text, nxt) or c in "-–—" else end
        return end if self._period_ends(start, i, nxt, gap) else 0

    def _period_ends(self, start: int, i: int, nxt: int, gap: str) -> bool:
        text = self.text
        c = text[nxt]
        word = _WORD_BEFORE.search(text[max(start, i - 40) : i]).group()
        low = word.lower()
        if not gap:  # no space behind the period
            if _east(c) or "฀" <= c <= "๿":
                return bool(word)
            letters = _LETTERS.fullmatch(word.rpartition("-")[2])
            if not (letters and len(word) > 1 and c not in "./"):
                return False
            if c in "“„«¿¡「（(":
                return self.abbreviation(word) != "open"
            follows = _LETTERS.match(text, nxt)
            return bool(c.isupper() and follows and self.abbreviation(word) != "open" and (len(follows.group()) == 1 and text[follows.end() : follows.end() + 1].isspace() or follows.group()[1:2].islower() or text[nxt:].split(None, 1)[0].isupper() and word.isupper() is False and len(word) > 2))
        if "\n" in gap and _MARKER.match(text, text.rfind("\n", 0, nxt) + 1):
            return True
        first = nxt
        while first < len(text) and text[first] in _OPENING:
            first += 1
        f = text[first : first + 1]
        if _COUNTER.match(text, nxt):  # an enumeration in running text: (a) ...; (b) ...
            return self.abbreviation(word) != "open"
        if _starts_small(text, first) or c in "-–—":
            return False
        if not word:
            return True
        if word.isdigit() and not text[start : i - len(word)].strip():
            return False  # the number of a list item
        follows = _LETTERS.match(text, first)
        nextword = follows.group() if follows else ""
        if word.isdigit() and len(word) <= 2 and nextword.lower() in MONTHS:
            return False
        if word == "no":
            return True
        before = text[max(start, i - len(word) - 24) : i - len(word)].rstrip()
        previous = before.rpartition(" ")[2].lower()
        joined = (previous + low).strip(".") if previous.endswith(".") else ""
        if joined in OPEN_ABBREVIATIONS:
            return False
        kind = "final" if joined in FINAL_ABBREVIATIONS else self.abbreviation(word)
        if len(word) == 1 and word.isalpha() and not joined in FINAL_ABBREVIATIONS and not (kind == "open" and low in OPEN_ABBREVIATIONS):
            if word in "IVX" and previous in COUNTED:
                return True
            number = before.rpartition(" ")[0].rpartition(" ")[2]
            if word.isupper() and previous.endswith(".") and number.isdigit() and self.abbreviation(previous[:-1]):
                return True  # a unit such as "4 deg. C"
            return word.islower() and previous.strip(".,").replace(",", "").replace(".", "").isdigit() and not f.isdigit()  # a unit behind its number
        if kind == "open":
            return False
        if kind == "final":
            if low in FINAL_ABBREVIATIONS or joined in FINAL_ABBREVIATIONS:
                return not f.isdigit() or low in ("etc", "usw")
            return not f.isdigit() and not self._is_name(nextword)
        if "." in word and _LETTERS.fullmatch(word.replace(".", "")) and all(len(p) == 1 for p in word.split(".")):
            return not f.isdigit() and not self._is_name(nextword)
        return True

    def document(self) -> Document:
        if self._document is None:
            self._document = Document(self.text)
        return self._document

    def abbreviation(self, word: str) -> str:
        """"open" for an abbreviation that ends no sentence, "final" for one that may, "" for no abbreviation: by the document, else the corpus, else the prior."""
        low = word.lower()
        prior = "open" if low in OPEN_ABBREVIATIONS else "final" if low in FINAL_ABBREVIATIONS else ""
        if not self.evidence:
            return prior
        general = self.corpus.get(low, "")
        sure = self.document().goes_on(low)
        if not (sure or general or prior):
            return ""
        if not sure and len(word) > 1 and self.document().plain(word):
            return ""
        return prior or general or "final"

    def _is_name(self, word: str) -> bool:
        return self.evidence and self.document().name(word)


def corpus_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, goes_on, dotted, closes, plain over all texts, counted per batch and combined before the shuffle."""

    def rows(dotted: dict[str, list[int]], words: Counter) -> pa.RecordBatch:
        names = list(dotted.keys() | words.keys())
        none = [0, 0, 0, 0]
        columns = [[x + dotted.get(w, none)[3] for w, x in zip(names, column)] if i == 0 else column for i, column in enumerate([dotted.get(w, none)[i] for w in names] for i in range(3))]
        plain = [max(0, words[w] - n) for w, n in zip(names, columns[1])]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(c, pa.int64()) for c in (*columns, plain))], names=["word", "goes_on", "dotted", "closes", "plain"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dotted: dict[str, list[int]] = {}
        words: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                words.update(_WORD.findall(t.lower()))
                for w, n in dotted_words(t).items():
                    s = dotted.get(w)
                    dotted[w] = n if s is None else [x + y for x, y in zip(s, n)]
            if len(words) > 200_000:
                yield rows(dotted, words)
                dotted, words = {}, Counter()
        yield rows(dotted, words)

    names = ("goes_on", "dotted", "closes", "plain")
    parts = docs.filter(F.col(text).isNotNull()).select(text).mapInArrow(count, "word string, goes_on long, dotted long, closes long, plain long")
    return parts.groupBy("word").agg(*(F.sum(c).alias(c) for c in names)).filter("dotted > 0")


@F.arrow_udf(T.StringType())
def _class_of(goes_on: pa.Array, dotted: pa.Array, closes: pa.Array, plain: pa.Array) -> pa.Array:
    return pa.array([corpus_class(*x) for x in zip(*(c.to_pylist() for c in (goes_on, dotted, closes, plain)))], pa.string())


def corpus_abbreviations(docs: DataFrame, text: str) -> DataFrame:
    """word, class of every abbreviation that the corpus shows."""
    return cut_lineage(corpus_counts(docs, text).withColumn("class", _class_of("goes_on", "dotted", "closes", "plain")).filter("class <> ''").select("word", "class"))


def _word_rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, word of every word before a period."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, word = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for w in dotted_words(t):
                    who.append(i)
                    word.append(w)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(word, pa.string())], names=["_id", "word"])

    return docs.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("_id"), text).mapInArrow(words, f"_id {dict(docs.dtypes)[id_col]}, word string")


def sentence_spans(docs: DataFrame, id_col: str, text: str, evidence: bool = True, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """id, start_pos, end_pos of each sentence: code point offsets from 0, end exclusive, without outer white space.

    The spans cover all of the text but white space. Null, empty and blank texts give no rows; whole texts are processed, however long;
    repeated rows each count. Extra columns are ignored. The corpus's abbreviations go to the workers if they are few; else each document
    is joined to those it has, with the same result. Without ``evidence`` neither document nor corpus is asked, only the prior.
    """
    kind = dict(docs.dtypes)[id_col]
    out = f"`{id_col}` {kind}, start_pos long, end_pos long"
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))

    def split(known: dict[str, str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            splitter = Splitter(known, evidence)
            for b in batches:
                who, start, end = [], [], []
                own = b.column(2).to_pylist() if known is None and evidence else None
                for i, t in enumerate(b.column(1).to_pylist()):
                    if own is not None:
                        splitter.corpus = dict(own[i] or ())
                    for s, e in splitter.spans(t):
                        who.append(i)
                        start.append(s)
                        end.append(e)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=[id_col, "start_pos", "end_pos"])

        return run

    if not evidence:
        return rows.mapInArrow(split({}), out)
    table_ = corpus_abbreviations(docs, text)
    if is_small(table_, broadcast_rows):
        return rows.mapInArrow(split({r[0]: r[1] for r in table_.collect()}), out)
    own = _word_rows(docs, id_col, text).join(table_, "word").groupBy("_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "class"))).alias("_own"))
    joined = rows.join(own.withColumnRenamed("_id", "_of"), F.col("_id").eqNullSafe(F.col("_of")), "left")
    return joined.select("_id", "_text", "_own").mapInArrow(split(None), out)


def p10_found(spark, sf_dir: str) -> DataFrame:
    return sentence_spans(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_evidence(spark, sf_dir: str) -> DataFrame:
    """doc_id, start_pos, end_pos of the sentences that come out otherwise without the evidence of document and corpus."""
    docs = table(spark, sf_dir, "documents")
    with_it, without = (sentence_spans(docs, "doc_id", "text", e) for e in (True, False))
    return with_it.join(without, ["doc_id", "start_pos", "end_pos"], "left_anti")
