"""Token and edit similarity of short texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about what a text names.
STOPWORDS = ("a", "an", "the", "of", "to", "in", "on", "by", "via", "and", "or", "with", "for", "from", "at", "as", "is", "into", "during")
# Fixed value: what a contained text is worth at least, however many other words stand around it.
CONTAINMENT_FLOOR = 0.5


def tokens(text: Column) -> Column:
    """The set of letter-and-digit runs in small letters; null and texts without any give an empty set."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def content_tokens(text: Column) -> Column:
    return F.array_except(tokens(text), F.array(*map(F.lit, STOPWORDS)))


def trigrams(text: Column) -> Column:
    """The set of runs of three characters of a text trimmed, in small letters and single-spaced; a shorter text is its own; '' has none."""
    folded = _folded(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(folded) - 2, F.lit(1))), lambda i: F.substring(folded, i, F.lit(3)))
    return F.array_distinct(F.filter(grams, lambda g: g != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _folded(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+", " ")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length, after trimming, lowering and single-spacing; 1 if both are empty, 0 if one is."""
    x, y = _folded(a), _folded(b)
    return F.when((x == "") & (y == ""), F.lit(1.0)).when((x == "") | (y == ""), F.lit(0.0)).otherwise(1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def blended(a: Column, b: Column) -> Column:
    return F.greatest(jaccard(tokens(a), tokens(b)), edit_similarity(a, b))


def containment_score(least: Column, n: Column) -> Column:
    """Half of the score is certain; the other half is the share that the fewest tokens have in ``n``."""
    return F.when(n <= least, F.lit(1.0)).otherwise(CONTAINMENT_FLOOR + (1 - CONTAINMENT_FLOOR) * (least / n))


def contains_all(inner: Column, outer: Column) -> Column:
    """Whether a non-empty token set lies in another."""
    return (F.size(inner) > 0) & (F.size(F.array_except(inner, outer)) == 0)


def containment(query: Column, candidate: Column) -> Column:
    q, c = content_tokens(query), content_tokens(candidate)
    return F.when(contains_all(q, c), containment_score(F.size(q), F.size(c))).otherwise(F.lit(0.0))
