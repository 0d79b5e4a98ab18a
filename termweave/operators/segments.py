"""Text segmentation for annotation: paragraphs, bracketed parts, lists, phrases, and the merging of spans. Sequential folds stay inside one document."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions.similarity import STOPWORDS

Span = tuple[int, int]
_BREAK = re.compile(r"\n\s*\n")
_CLAUSE = re.compile(r"[.;:!?]+(?=\s|\Z)|\n")
_BRACKET = re.compile(r"\(([^()]*)\)|\[([^\[\]]*)\]")
_LIST = re.compile(r"\s*,\s+(?:and\s+|or\s+)?|\s+(?:and|or|but|nor)\s+")
_WORD = re.compile(r"\S+")
# Words that a phrase does not begin with.
LEADING = frozenset("a an the this that these those all both half my your his her its our their some any each every no".split())
_ENDING = frozenset(STOPWORDS) | frozenset("was were be been are has have had gave shows showed seen found not than then when while because although if we it they there".split())


def paragraphs(text: str) -> list[Span]:
    """Spans between blank lines, without outer white space."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        piece = text[at:end]
        if piece.strip():
            lead = len(piece) - len(piece.lstrip())
            out.append((at + lead, at + lead + len(piece.strip())))
        at = m.end() if m else end
    return out


def _trim(text: str, a: int, b: int) -> Span:
    piece = text[a:b]
    lead = len(piece) - len(piece.lstrip())
    return a + lead, a + lead + len(piece.strip())


def bracketed(text: str, a: int, b: int) -> tuple[list[Span], list[Span]]:
    """(what stands in brackets, what stands outside) of a span."""
    inner, outer, at = [], [], a
    for m in _BRACKET.finditer(text, a, b):
        outer.append((at, m.start()))
        g = 1 if m.group(1) is not None else 2
        inner.append(m.span(g))
        at = m.end()
    outer.append((at, b))
    return inner, outer


def listed(text: str, a: int, b: int) -> list[Span]:
    """The parts of a list, split at commas and conjunctions."""
    out, at = [], a
    for m in _LIST.finditer(text, a, b):
        out.append((at, m.start()))
        at = m.end()
    return out + [(at, b)]


def phrases(text: str, a: int, b: int) -> list[Span]:
    """Runs of words that may name something: cut at function words, without leading determiners. A rule-based stand-in for a trained chunker."""
    out: list[Span] = []
    run: list[Span] = []
    for m in [*_WORD.finditer(text, a, b), None]:
        low = m.group().lower().strip(".,;:!?\"'") if m else ""
        if m and (low not in _ENDING or (low == "of" and run)) and not (low in LEADING and not run):
            run.append(m.span())
            continue
        while run and text[run[-1][0] : run[-1][1]].lower() in _ENDING:
            run.pop()
        if run:
            out.append((run[0][0], run[-1][1]))
        run = []
    return out


def segment(text: str) -> list[Span]:
    """Segments of a text in order: paragraphs, clauses, brackets, lists, phrases that hold a letter."""
    out = []
    for pa_, pb in paragraphs(text):
        at = pa_
        for m in [*_CLAUSE.finditer(text, pa_, pb), None]:
            end = m.start() if m else pb
            inner, outer = bracketed(text, at, end)
            for x in (*inner, *outer):
                for y in listed(text, *x):
                    out += phrases(text, *y)
            at = m.end() if m else end
    spans = {_trim(text, *s) for s in out}
    return sorted(s for s in spans if s[0] < s[1] and any(c.isalpha() for c in text[s[0] : s[1]]))


def merge(segments: list[Span], tagged: list[Span]) -> list[Span]:
    """A fold over tagged spans, in order: one that overlaps nothing is added, one longer than all it overlaps replaces them, any other is dropped. Each meets the list as
    earlier ones left it.

    Segments that do not overlap stay so, and those that a span overlaps are neighbours found by bisection. Overlapping segments are compared one by one.
    """
    merged = sorted(segments)
    if any(b[0] < a[1] for a, b in zip(merged, merged[1:])):
        for s, e in tagged:
            over = {m for m in merged if m[0] < e and m[1] > s}
            if all(e - s > m[1] - m[0] for m in over):
                merged = [m for m in merged if m not in over] + [(s, e)]
        return sorted(merged, key=lambda m: m[0])
    starts, ends = [m[0] for m in merged], [m[1] for m in merged]
    for s, e in tagged:
        i, j = bisect_right(ends, s), bisect_left(starts, e)
        if all(e - s > ends[k] - starts[k] for k in range(i, j)):
            starts[i:j], ends[i:j] = [s], [e]
    return list(zip(starts, ends))


def greedy(spans: list[Span]) -> list[Span]:
    """Spans by start, each kept if it begins no earlier than the last kept one ends."""
    out: list[Span] = []
    for s in sorted(spans):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def _per_text(df: DataFrame, id_col: str, text: str, rule) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, start, end, part = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for s, e in rule(t) if t else []:
                    who.append(i)
                    start.append(s)
                    end.append(e)
                    part.append(t[s:e])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(who, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(part, pa.string())], names=[id_col, "start", "end", "text"])

    return df.select(id_col, text).mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, start long, end long, text string")


def paragraph_rows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """id, start, end, text of each paragraph; null and blank texts give none."""
    return _per_text(df, id_col, text, paragraphs)


def segment_rows(df: DataFrame, id_col: str, text: str) -> DataFrame:
    return _per_text(df, id_col, text, segment)


def unique_texts(segments: DataFrame, id_col: str) -> DataFrame:
    """Per document the distinct segment texts, whatever their case, as first written."""
    return segments.groupBy(id_col, F.lower("text").alias("low")).agg(F.min_by("text", F.struct("start", "end")).alias("text"), F.min("start").alias("start")).drop("low")


def merge_rows(segments: DataFrame, tagged: DataFrame, id_col: str) -> DataFrame:
    """Both spans (id, start, end) merged per document by ``merge``; tagged spans come in order of start, then end. A document's spans are held together."""
    kind = dict(segments.dtypes)[id_col]

    def fold(key, left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = lambda t: list(zip(t.column("start").to_pylist(), t.column("end").to_pylist()))
        out = merge(pairs(left), sorted(set(pairs(right))))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(out), left.schema.field(id_col).type), pa.array([s for s, _ in out], pa.int64()), pa.array([e for _, e in out], pa.int64())], names=[id_col, "start", "end"])

    return segments.select(id_col, "start", "end").groupBy(id_col).cogroup(tagged.select(id_col, "start", "end").groupBy(id_col)).applyInArrow(fold, f"`{id_col}` {kind}, start long, end long")


def greedy_rows(spans: DataFrame, id_col: str) -> DataFrame:
    """Non-overlapping spans per document by start: one pass over its sorted spans, which are held together."""
    kind = dict(spans.dtypes)[id_col]

    def fold(key, rows):
        kept = greedy(list(set(zip(rows.column("start").to_pylist(), rows.column("end").to_pylist()))))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(kept), rows.schema.field(id_col).type), pa.array([s for s, _ in kept], pa.int64()), pa.array([e for _, e in kept], pa.int64())], names=[id_col, "start", "end"])

    return spans.select(id_col, "start", "end").distinct().groupBy(id_col).applyInArrow(fold, f"`{id_col}` {kind}, start long, end long")


def gaps(spans: DataFrame, lengths: DataFrame, id_col: str) -> DataFrame:
    """What lies between non-overlapping spans of each document, before the first and behind the last; lengths has id and n. A document without spans is one gap."""
    w = Window.partitionBy(id_col).orderBy("start")
    edges = spans.select(id_col, "start", "end").unionByName(lengths.select(id_col, F.col("n").cast("long").alias("start"), F.col("n").cast("long").alias("end")))
    return edges.select(id_col, F.coalesce(F.lag("end").over(w), F.lit(0)).alias("gap_start"), F.col("start").alias("gap_end")).filter("gap_start < gap_end")
