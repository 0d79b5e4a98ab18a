"""Request parameters: which ontologies and sources count, and the limits a request must keep."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Filter:
    """required and preferred sources, target ontologies (in order of priority), whether other ontologies may answer, whether only the targets' own terms count."""

    required: tuple[str, ...] = ()
    preferred: tuple[str, ...] = ()
    targets: tuple[str, ...] = ()
    include_other: bool = True
    defining_only: bool = False

    @property
    def low_targets(self) -> list[str]:
        return [t.lower() for t in self.targets]

    @property
    def hard(self) -> bool:
        return bool(self.targets) and not self.include_other


@dataclass(frozen=True)
class Limits:
    properties: int = 1000
    deep_properties: int = 200
    text_chars: int = 50_000


class RequestError(ValueError):
    """A request that cannot be served as it is."""


_PART = re.compile(r"\s*([A-Za-z_]+)\s*:\s*\[(.*?)\]\s*", re.S)


def _parts(text: str) -> list[str]:
    """Split at commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth = max(0, depth + (c == "[") - (c == "]"))
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return out + ([text[start:]] if text[start:] else [])


def parse_filter(text: str | None) -> Filter:
    """A filter from the legacy mini-language ``key:[a,b],key:[c]``.

    Unknown keys and malformed parts are errors. ontologies:[none] means no restriction; required:[none] is taken literally. Given
    ontologies filter hard.
    """
    got: dict[str, list[str]] = {"required": [], "preferred": [], "ontologies": []}
    defining = False
    for part in _parts(text) if text and text.strip() else []:
        m = _PART.fullmatch(part)
        if not m:
            raise RequestError(f"malformed filter part: {part.strip()!r}")
        key, values = m.group(1).lower(), [v for v in re.split(r"\s*,\s*", m.group(2).strip()) if v.strip()]
        if key == "defining_only":
            if [v.lower() for v in values] not in (["true"], ["false"]):
                raise RequestError("defining_only takes one of true and false")
            defining = values[0].lower() == "true"
        elif key in got:
            got[key] += values
        else:
            raise RequestError(f"unknown filter key: {key}")
    targets = got["ontologies"]
    if len(targets) == 1 and targets[0].strip().lower() in ("none", "select none"):
        targets = []
    return Filter(tuple(got["required"]), tuple(got["preferred"]), tuple(targets), not targets, defining)


def check_request(properties: list[tuple[str | None, str | None]], deep: bool | None = None, limits: Limits = Limits()) -> None:
    """Raise RequestError for an empty, blank or too large request."""
    if not properties:
        raise RequestError("no properties given")
    most = limits.deep_properties if deep else limits.properties
    if len(properties) > most:
        raise RequestError(f"more than {most} properties")
    if any(text is None or not text.strip() for _, text in properties):
        raise RequestError("a property has no text")


def check_text(text: str | None, limits: Limits = Limits()) -> None:
    if text is None or not text.strip():
        raise RequestError("no text given")
    if len(text) > limits.text_chars:
        raise RequestError(f"text longer than {limits.text_chars} characters")
