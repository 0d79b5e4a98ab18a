"""Problem 6: deeply nested JSON records as flat, linked rows.

Vectorised structural indexing. The bodies of an Arrow batch are one byte array. Bitmaps of quotes, brackets and delimiters give
the structural characters outside strings; a running sum over the brackets gives each one's depth; ordering them by depth
makes every container one contiguous run, in which neighbouring delimiters bound the spans of its elements. From the spans come
node rows (parent container, key, number in array order, span), and a path is a few vector selections on them. No
body is parsed value by value; only the wanted leaves become Python strings.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.session import table

#: Bytes of bodies that are indexed at a time; a longer body is a chunk of its own.
CHUNK = 4 << 20
ROWS = "kind string, rec_id long, node string, parent string, val string"
_QUOTE, _BACK, _OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COMMA, _COLON = (ord(c) for c in '"\\{}[],:')


@dataclass(frozen=True)
class Path:
    """What to emit: elements reached from the root through ``steps``, with the text at ``leaf`` below each.

    A step is a member name whose value counts as an array (a lone value counts as an array of one), or None for the elements of an
    element. ``recursive`` repeats the only step and numbers rows by depth from 1.
    """

    kind: str
    steps: tuple[str | None, ...]
    leaf: tuple[str, ...]
    recursive: bool = False


def _classes(codes: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in codes]] = True
    return out


_STRUCTURAL, _BLANK = _classes("{}[],:"), _classes(" \t\r\n")


class StructuralIndex:
    """Node rows of many JSON bodies that lie one after the other in a byte array.

    Arrays by node: ``owner`` (container of which the node is an element), ``number`` (place in it), ``key_from``/``key_to`` (member name
    without quotes; -1 in arrays), ``start``/``end`` (value span), ``container`` (its own container, else -1).
    """

    def __init__(self, data: np.ndarray, limits: np.ndarray):
        self.data = data
        quotes = np.flatnonzero(data == _QUOTE)
        backs = np.flatnonzero(data == _BACK)
        if len(quotes) and len(backs):
            plain = np.where(data != _BACK, np.arange(len(data)), -1)
            np.maximum.accumulate(plain, out=plain)
            before = np.where(quotes > 0, plain[np.maximum(quotes - 1, 0)], -1)
            quotes = quotes[(quotes - 1 - before) % 2 == 0]
        at = np.flatnonzero(_STRUCTURAL[data])
        at = at[np.searchsorted(quotes, at) % 2 == 0]
        kind = data[at]
        opens = (kind == _OPEN_O) | (kind == _OPEN_A)
        closes = (kind == _CLOSE_O) | (kind == _CLOSE_A)
        depth = np.cumsum(opens.astype(np.int32) - closes)
        self.sound = self._sound(quotes, at, opens, closes, depth, limits)
        level = depth + closes  # of the container that the character belongs to
        order = np.argsort(level, kind="stable")
        at, kind, opens, closes = at[order], kind[order], opens[order], closes[order]
        inside = np.cumsum(opens) - 1  # container number, in this order
        self.open_at, self.is_array = at[opens], kind[opens] == _OPEN_A
        self._by_place = np.argsort(self.open_at, kind="stable")
        self._places = self.open_at[self._by_place]
        if self.sound.all():  # then brackets pair in this order; a pair of two kinds breaks its body
            odd = self.open_at[kind[closes] != kind[opens] + 2]
            self.sound[np.searchsorted(limits, odd, side="right") - 1] = False
        # An element lies between one of { [ , and the next , ] } of its container; in objects a colon is between.
        here = np.arange(len(at) - 1)
        same = inside[:-1] == inside[1:] if len(at) else np.zeros(0, bool)
        array = self.is_array[inside[:-1]] if len(at) else np.zeros(0, bool)
        lead = here[same & np.where(array, kind[:-1] != _COLON, kind[:-1] == _COLON)]
        self.solid = np.flatnonzero(~_BLANK[data])
        start, end = self._trim(at[lead] + 1, at[lead + 1])
        full = end > start
        lead, self.start, self.end = lead[full], start[full], end[full]
        self.owner = inside[lead]
        commas = np.cumsum(kind == _COMMA)
        first = np.flatnonzero(opens)
        self.number = commas[lead] - commas[first[self.owner]]
        in_object = ~self.is_array[self.owner]
        key_from, key_to = self._trim(at[np.maximum(lead - 1, 0)] + 1, at[lead])
        self.key_from, self.key_to = np.where(in_object, key_from + 1, -1), np.where(in_object, key_to - 1, -1)
        # Nodes whose names are written with escapes.
        self.escaped = np.flatnonzero(np.searchsorted(backs, self.key_to) > np.searchsorted(backs, self.key_from))
        self.first = data[self.start] if len(self.start) else np.zeros(0, np.uint8)
        self.container = np.where((self.first == _OPEN_O) | (self.first == _OPEN_A), self._container_at(self.start), -1)

    def _trim(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans without outer blanks; an empty span stays empty."""
        if not len(self.solid):
            return start, start
        a, b = np.searchsorted(self.solid, start), np.searchsorted(self.solid, end)
        some = b > a
        return np.where(some, self.solid[np.minimum(a, len(self.solid) - 1)], start), np.where(some, self.solid[np.maximum(b - 1, 0)] + 1, start)

    def _container_at(self, place: np.ndarray) -> np.ndarray:
        if not len(self._places):
            return np.full(len(place), -1)
        i = np.minimum(np.searchsorted(self._places, place), len(self._places) - 1)
        return np.where(self._places[i] == place, self._by_place[i], -1)

    @staticmethod
    def _sound(quotes, at, opens, closes, depth, limits) -> np.ndarray:
        """By body: quotes are even, brackets balance, and the depth never falls below that before it."""
        n_quotes = np.diff(np.searchsorted(quotes, limits))
        edge = np.searchsorted(at, limits)
        padded = np.concatenate([[0], depth])
        base = padded[edge[:-1]]
        low = np.minimum.reduceat(np.concatenate([depth, [0]]), np.minimum(edge[:-1], len(depth))) if len(limits) > 1 else np.zeros(0)
        some = edge[1:] > edge[:-1]
        return (n_quotes % 2 == 0) & (padded[edge[1:]] == base) & (~some | (low >= base))

    def roots(self, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The outermost container of each body that has one: (body, container)."""
        start, end = self._trim(limits[:-1], limits[1:])
        box = np.where(end > start, self._container_at(start), -1)
        body = np.flatnonzero(box >= 0)
        return body, box[body]

    def members(self, boxes: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Of each container, its member of that name (the last, if repeated): (place in ``boxes``, node)."""
        want = np.frombuffer(name.encode(), np.uint8)
        long = self.key_to - self.key_from == len(want)
        node = np.flatnonzero(long & (self.key_from >= 0))
        for i, byte in enumerate(want):
            node = node[self.data[self.key_from[node] + i] == byte]
        if len(self.escaped):
            odd = [n for n in self.escaped.tolist() if _text(b'"' + self.data[self.key_from[n] : self.key_to[n]].tobytes() + b'"') == name]
            node = np.sort(np.concatenate([node, np.array(odd, node.dtype)]))
        last = np.full(len(self.open_at), -1)
        last[self.owner[node]] = node  # nodes of a container are in the order of the text, so the last one stays
        hit = np.where(boxes >= 0, last[boxes], -1) if len(last) else np.full(len(boxes), -1)
        place = np.flatnonzero(hit >= 0)
        return place, hit[place]

    def elements(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The elements of each node taken as an array: (place in ``nodes``, number, node). Null nodes have none, a lone value is number 0; null elements are left out but counted."""
        box = self.container[nodes]
        array = (box >= 0) & self.is_array[np.maximum(box, 0)] if len(self.is_array) else np.zeros(len(nodes), bool)
        place_of = np.full(len(self.open_at) + 1, -1)
        place_of[box[array]] = np.flatnonzero(array)
        inner = np.flatnonzero(place_of[self.owner] >= 0)
        lone = np.flatnonzero(~array)
        place = np.concatenate([place_of[self.owner[inner]], lone])
        number = np.concatenate([self.number[inner], np.zeros(len(lone), int)])
        node = np.concatenate([inner, nodes[lone]])
        live = self.first[node] != ord("n")
        return place[live], number[live], node[live]

    def text(self, node: int) -> str:
        return "" if node < 0 else _text(self.data[self.start[node] : self.end[node]].tobytes())


def _text(raw: bytes) -> str:
    """The text of a scalar; '' for null, the JSON text of anything else that is no string."""
    if raw[:1] != b'"':
        return "" if raw == b"null" else raw.decode("utf-8", "replace")
    if b"\\" not in raw:
        return raw[1:-1].decode("utf-8", "replace")
    try:
        return json.loads(raw, strict=False).encode("utf-8", "replace").decode()
    except ValueError:
        return raw[1:-1].decode("utf-8", "replace")


def _leaf(index: StructuralIndex, nodes: np.ndarray, leaf: tuple[str, ...]) -> list[str]:
    at = nodes.copy()
    for name in leaf:
        place, hit = index.members(np.where(at >= 0, index.container[at], -1), name)
        at = np.full(len(nodes), -1)
        at[place] = hit
    return [index.text(n) for n in at]


def _walk(index: StructuralIndex, body: np.ndarray, boxes: np.ndarray, path: Path) -> Iterator[tuple[np.ndarray, list[str], list[str], list[str]]]:
    """(body, node, parent, val) of a path; several blocks if it is recursive."""
    if path.recursive:
        depth = 1
        while len(boxes):
            place, node = index.members(boxes, path.steps[0])
            inner, _, node = index.elements(node)
            body = body[place][inner]
            if len(node):
                yield body, [str(depth)] * len(node), [str(depth - 1) if depth > 1 else ""] * len(node), _leaf(index, node, path.leaf)
            boxes = index.container[node]
            body, boxes, depth = body[boxes >= 0], boxes[boxes >= 0], depth + 1
        return
    name, parent, node = [""] * len(body), [""] * len(body), np.zeros(0, int)
    for step in path.steps:
        if step is None:
            place, found = np.arange(len(node)), node
        else:
            place, found = index.members(boxes, step)
        inner, number, node = index.elements(found)
        place = place[inner]
        body = body[place]
        parent = [name[i] for i in place]
        name = [f"{p}.{k}" if p else str(k) for p, k in zip(parent, number.tolist())]
        boxes = index.container[node]
    yield body, name, parent, _leaf(index, node, path.leaf)


def _chunks(limits: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(limits) - 1:
        until = max(at + 1, int(np.searchsorted(limits, limits[at] + CHUNK, side="right")) - 1)
        yield at, until
        at = until


def _rows_of(ids: np.ndarray, bodies: pa.Array, paths: tuple[Path, ...]) -> Iterator[pa.RecordBatch]:
    bodies = bodies.cast(pa.large_string())
    limits = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
    raw = np.frombuffer(bodies.buffers()[2] or b"", np.uint8)
    for at, until in _chunks(limits):
        own = limits[at : until + 1]
        data, own, rec = raw[own[0] : own[-1]], own - own[0], ids[at:until]
        index = StructuralIndex(data, own)
        while not index.sound.all():  # leave broken bodies out and index the rest
            keep = np.flatnonzero(index.sound)
            data = np.concatenate([data[own[i] : own[i + 1]] for i in keep] or [data[:0]])
            own = np.concatenate([[0], np.cumsum(np.diff(own)[keep])]).astype(np.int64)
            rec, index = rec[keep], StructuralIndex(data, own)
        body, boxes = index.roots(own)
        for path in paths:
            for who, node, parent, val in _walk(index, body, boxes, path):
                if len(who):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.kind] * len(who)), pa.array(rec[who]), pa.array(node), pa.array(parent), pa.array(val)], names=["kind", "rec_id", "node", "parent", "val"]
                    )


def flatten(df: DataFrame, id_col: str, body: str, paths: tuple[Path, ...]) -> DataFrame:
    """kind, rec_id, node, parent, val: one row per element of each path, linked to its parent by numbers.

    Numbers count from 0 in array order; null elements keep their number but give no row; a missing or null val is ''. Null, empty and
    scalar bodies give no rows, nor do bodies whose quotes or brackets do not balance (see ``broken_bodies``). A member that
    is repeated counts as its last. A null id is kept. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for out in _rows_of(np.arange(len(b)), b.column(1), paths):
                yield pa.RecordBatch.from_arrays([out.column(0), b.column(0).take(out.column(1)), *out.columns[2:]], names=out.schema.names)

    return df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(body).alias("body")).mapInArrow(run, ROWS)


def broken_bodies(df: DataFrame, id_col: str, body: str) -> DataFrame:
    """Ids of bodies that do not parse as JSON; null bodies are not broken."""
    return df.filter(F.col(body).isNotNull() & (F.trim(body) != "null") & F.get_json_object(F.col(body), "$").isNull()).select(id_col)


RESPONSE = (
    Path("candidate", ("mappings", "candidates"), ("label",)),
    Path("step", ("mappings", "candidates", "mappingProvenance"), ("method",)),
    Path("support", ("mappings", "candidates", "supportingProvenance", None), ("method",)),
)
ANNOTATION = (Path("derived", ("derivedFrom",), ("provenance", "evidence"), recursive=True),)


def p6_flat(spark, sf_dir: str) -> DataFrame:
    """The rows of p6_found with the node of their parent."""
    responses = flatten(table(spark, sf_dir, "map_responses"), "response_id", "body", RESPONSE)
    return responses.unionByName(flatten(table(spark, sf_dir, "v2_annotations"), "annotation_id", "body", ANNOTATION))


def p6_found(spark, sf_dir: str) -> DataFrame:
    return p6_flat(spark, sf_dir).select("kind", "rec_id", "node", "val")
