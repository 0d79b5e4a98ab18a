"""Problem 9: items of varying length into containers of fixed capacity, with little unused space.

Minimum bin slack on the multiset of lengths. Items longer than the capacity are cut into full pieces and a rest; nothing else is
split. Pieces are counted by length, which leaves at most ``capacity`` numbers however many items there are. A container is opened
with the longest length left; a bitset subset-sum over the lengths left finds the filling closest to the capacity,
backtracking gives its counts, and the same filling is repeated as often as the counts allow. The pieces of a length then get positions
(never gathering a length in one task), and a position tells its container by binary search in the list of fillings.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.bpe import VOCABULARY, token_count
from termweave.session import cut_lineage, table
from termweave.skew import dense_positions

CAPACITY = 2048


@dataclass(frozen=True)
class Filling:
    """A set of lengths (length, how many) that fills ``times`` containers."""

    times: int
    parts: tuple[tuple[int, int], ...]


def best_filling(room: int, left: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Counts of lengths whose sum is as near to ``room`` as possible without exceeding it; ``left`` is (length, count), longest first.

    ``reach[i]`` has bit s set if the first i lengths can make the sum s. Longer lengths are used first, so that short ones remain for tight fits.
    """
    mask, reach, used = (1 << (room + 1)) - 1, [1], []
    for length, count in left:
        if length > room:
            continue
        bits, rest, step = reach[-1], min(count, room // length), 1
        while rest:
            take = min(step, rest)
            bits |= bits << (length * take)
            rest -= take
            step *= 2
        reach.append(bits & mask)
        used.append((length, count))
        if reach[-1] >> room & 1:
            break
    total, out = reach[-1].bit_length() - 1, []
    for i in range(len(used), 0, -1):
        length, count = used[i - 1]
        n = 0
        while not reach[i - 1] >> total & 1:
            total -= length
            n += 1
        if n:
            out.append((length, n))
    return out


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[Filling]:
    """Fillings that use up all counts (length from 1 to ``capacity`` to number of pieces)."""
    left = {k: v for k, v in sorted(counts.items(), reverse=True) if v > 0}
    out = []
    while left:
        first = next(iter(left))
        need = {first: 1}
        for length, n in best_filling(capacity - first, [(k, v - (k == first)) for k, v in left.items() if v > (k == first)]):
            need[length] = need.get(length, 0) + n
        times = min(left[k] // n for k, n in need.items())
        out.append(Filling(times, tuple(sorted(need.items(), reverse=True))))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _lookup(fillings: list[Filling]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For searches by (length, position): sorted keys, first position, pieces per container, first container."""
    rows, at, container = [], {}, 0
    for f in fillings:
        for length, n in f.parts:
            start = at.get(length, 0)
            rows.append(((length << 44) + start, start, n, container))
            at[length] = start + n * f.times
        container += f.times
    table_ = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return table_[:, 0], table_[:, 1], table_[:, 2], table_[:, 3]


def pieces_of(items: DataFrame, id_col: str, size: str, capacity: int) -> DataFrame:
    """id, piece, start, n: one row per item, or several for an item longer than the capacity. Null sizes and sizes under 1 give no rows."""
    big = F.col(size).cast("long")
    return (
        items.filter(F.col(size) > 0)
        .select(F.col(id_col), F.posexplode(F.sequence(F.lit(0).cast("long"), big - 1, F.lit(capacity).cast("long"))).alias("piece", "start"), big.alias("_size"))
        .select(id_col, "piece", "start", F.least(F.lit(capacity).cast("long"), F.col("_size") - F.col("start")).alias("n"))
    )


def fill_containers(items: DataFrame, id_col: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """container_id (from 0 without gaps), id, piece, start, n for every piece of every item.

    Ids must be unique. Items of equal length are interchangeable; the result is the same on every run. Empty tables give no rows.
    """
    pieces = pieces_of(items, id_col, size, capacity).withColumn("_key", F.struct(id_col, "piece"))
    counts = {int(r["n"]): int(r["count"]) for r in pieces.groupBy("n").count().collect()}  # at most ``capacity`` rows
    keys, start, per, first = _lookup(pack_lengths(counts, capacity))

    @F.arrow_udf("long")
    def container(n: pa.Array, pos: pa.Array) -> pa.Array:
        length, position = n.to_numpy(zero_copy_only=False), pos.to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, (length << 44) + position, side="right") - 1
        return pa.array(first[at] + (position - start[at]) // per[at], pa.int64())

    placed = dense_positions(pieces, "n", "_key", max(counts.values(), default=0))
    return placed.select(container("n", "pos").alias("container_id"), id_col, "piece", "start", "n")


def p9_containers(spark, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text"), vocabulary).alias("n_tokens"))
    return fill_containers(cut_lineage(docs.filter("n_tokens > 0")), "doc_id", "n_tokens")


def p9_fill(spark, sf_dir: str) -> DataFrame:
    """How full the containers are: one row per number of tokens used."""
    used = p9_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return used.groupBy("used").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"))


def p9_bound(spark, sf_dir: str) -> DataFrame:
    """One row: the containers used, the tokens in them, and the least number of containers that could hold these tokens."""
    used = p9_containers(spark, sf_dir).agg(F.count_distinct("container_id").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    return used.withColumn("least", F.ceil(F.col("tokens") / CAPACITY))
