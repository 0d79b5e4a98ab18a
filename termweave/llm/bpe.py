"""Problem 8: token ids of every document by a public byte-level BPE vocabulary.

Prefix dynamic programming. For every byte prefix of a word there is one token that the encoding of that prefix ends with. It
is the token t ending there for which the token stored at t's start and t are a pair that merging the two leaves alone. The table of
these last tokens gives the ids by walking back, grows by exact appends, and is kept up to an edit.

Words (the parts of the vocabulary's split pattern) repeat, so each worker keeps the ids of words it has met in a bounded cache;
a text is then one pass of the pattern and one lookup per word.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.session import table

#: Where the rank file lies; a parameter of every function here, never copied into the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to the rank file (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and pairs that a worker keeps; beyond it the cache starts anew, which changes only speed.
CACHE = 200_000


class Vocabulary:
    """A rank file with the pair test; ids are ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    def merged(self, raw: bytes) -> list[int]:
        """Ids by the defining rule: join the adjacent pair of lowest rank until none joins. For short strings only."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, before: int, token: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two tokens."""
        key = (before, token)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            known = self._pairs[key] = self.merged(self.tokens[before] + self.tokens[token]) == [before, token]
        return known

    def alone(self, token: int) -> bool:
        """Whether the encoding of the token's bytes is the token."""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.tokens[token]) == [token]
        return known


class PrefixTable:
    """The last token of every prefix of one word."""

    def __init__(self, vocabulary: Vocabulary, raw: bytes = b""):
        self.vocabulary, self.raw, self.last = vocabulary, b"", [-1]
        self.append(raw)

    def append(self, more: bytes) -> PrefixTable:
        """Lengthen the word; what is known of its prefixes stays."""
        self.raw += more
        while len(self.last) <= len(self.raw):
            self._next()
        return self

    def _next(self) -> None:
        """The last token of the shortest prefix that has none yet."""
        v, raw, last, end = self.vocabulary, self.raw, self.last, len(self.last)
        for begin in range(max(0, end - v.longest), end):
            token = v.ranks.get(raw[begin:end])
            if token is not None and (v.alone(token) if begin == 0 else v.stands(last[begin], token)):
                last.append(token)
                return
        raise ValueError("the vocabulary lacks a single byte")

    def edit(self, at: int, until: int, new: bytes) -> PrefixTable:
        """Replace raw[at:until]. The table up to ``at`` is reused, and behind the edit again from where as many last tokens in a row as the longest token has
        bytes are those of the old table: from there on both tables see the same."""
        old, behind = self.last, len(self.raw) - until
        self.raw = self.raw[:at] + new + self.raw[until:]
        self.last = old[: at + 1]
        start, same = at + len(new), 0
        while len(self.last) <= len(self.raw):
            self._next()
            j = len(self.last) - 1 - start
            same = same + 1 if j > 0 and self.last[-1] == old[until + j] else 0
            if same >= self.vocabulary.longest and j < behind:
                self.last += old[until + j + 1 :]
        return self

    def ids(self) -> list[int]:
        out, end = [], len(self.raw)
        while end:
            token = self.last[end]
            out.append(token)
            end -= len(self.vocabulary.tokens[token])
        return out[::-1]


class Encoder:
    """Text to ids: the split pattern, then a table per word not met before."""

    def __init__(self, path: str = VOCABULARY):
        import regex

        self.vocabulary = Vocabulary(path)
        self.words = regex.compile(PATTERN).findall
        self._known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self._known
        for word in self.words(text):
            ids = known.get(word)
            if ids is None:
                ids = PrefixTable(self.vocabulary, word.encode()).ids()
                if len(word) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = ids
            out += ids
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)


def token_ids(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Token ids of a text, without special tokens (their strings are ordinary text); an empty list for null and empty text. Blank text is text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encode = encoder(vocabulary).encode
        return pa.array([encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The number of token ids of a text; 0 for null and empty text."""

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(vocabulary).encode
        return pa.array([len(encode(t)) for t in texts.to_pylist()], pa.int32())

    return count(text)


def p8_ids(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and ids of every document; ids of repeated documents are repeated. An empty table gives no rows."""
    return table(spark, sf_dir, "documents").select("doc_id", token_ids(F.col("text"), vocabulary).alias("ids"))
