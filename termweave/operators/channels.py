"""Channels of evidence: tagging by a dictionary, containment and similarity of words, nearest vectors, and expansion over edges."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import evidence as ev
from termweave.functions import similarity as sim
from termweave.session import cut_lineage, materialised, small_side

# What parts words for the tagger.
DELIMITERS = " ,.;:!?\t\n()[]{}\"'/\\-_"
_WORD = re.compile("[^" + re.escape(DELIMITERS) + "]+")
#: Most bits of the filter that goes with a dictionary to every executor (32 MB).
MOST_BITS = 1 << 28
#: Vectors in one block of an exact search.
BLOCK = 8_192


def dictionary(terms: DataFrame) -> DataFrame:
    """surface (small letters), iri, short_form, label, ontology, string_type, source of every label and synonym. Blank surfaces are left out."""
    named = terms.select("iri", "short_form", "label", "ontology", F.explode(F.concat(F.array(F.struct(F.col("label").alias("name"), F.lit("label").alias("t"))), F.transform("synonyms", lambda s: F.struct(s.alias("name"), F.lit("synonym").alias("t"))))).alias("n"))
    return named.select(F.lower("n.name").alias("surface"), "iri", "short_form", "label", "ontology", F.col("n.t").alias("string_type"), F.col("ontology").alias("source")).filter("trim(surface) <> ''").distinct()


def curated_dictionary(curated: DataFrame, terms: DataFrame) -> DataFrame:
    """dictionary's columns for curated strings (text, term_id, datasource); their source is the database. Strings of unknown terms are left out."""
    named = terms.select(F.col("short_form").alias("term_id"), "iri", "short_form", "label", "ontology")
    return curated.join(named, "term_id").select(F.lower("text").alias("surface"), "iri", "short_form", "label", "ontology", F.lit("CURATION").alias("string_type"), F.col("datasource").alias("source")).filter("trim(surface) <> ''").distinct()


def _places(text: str) -> tuple[int, int]:
    """The two bits, out of 2 to the 64th, that stand for a string."""
    h = hashlib.blake2b(text.encode(), digest_size=16).digest()
    return int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little")


def _bits(surfaces: DataFrame, n: int) -> bytes:
    """A Bloom filter of the surfaces and of their first words, with at least 32 bits for each of n surfaces and at most MOST_BITS; longer lists only let more runs pass."""
    size = min(MOST_BITS, 1 << max(16, (32 * n - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.zeros(size // 8, np.uint8)
            for s in b.column(0).to_pylist():
                first = _WORD.search(s)
                for p in (*_places(s), *(_places("\0" + first.group()) if first else ())):
                    bits[(p & size - 1) >> 3] |= 1 << (p & 7)
            words = bits.view(np.int64)
            at = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "word"])

    found = surfaces.select("surface").distinct().mapInArrow(mark, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return words.tobytes()


def spans(df: DataFrame, id_col: str, text: str, entries: DataFrame, min_length: int = 6) -> DataFrame:
    """id, start, end (code points), surface of every run of words that may be a dictionary surface.

    Runs are as long as the dictionary's longest surface in words. A Bloom filter of the dictionary, whose size is bounded whatever the
    dictionary's, lets hardly any other run pass; the join on the surface decides. Whole texts are processed. Null texts give no rows.
    """
    parts = F.size(F.split("surface", "[" + re.escape(DELIMITERS).replace('"', '\\"') + "]"))
    n, longest = entries.agg(F.count(F.lit(1)), F.coalesce(F.max(parts), F.lit(0))).first()
    known = df.sparkSession.sparkContext.broadcast(_bits(entries, n))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = known.value
        mask = len(bits) * 8 - 1

        def passes(key: str) -> bool:
            a, b = _places(key)
            return bits[(a & mask) >> 3] >> (a & 7) & 1 and bits[(b & mask) >> 3] >> (b & 7) & 1

        for b in batches:
            firsts: dict[str, bool] = {}
            for at in range(0, len(b), 256):
                piece = b.slice(at, 256)
                who, start, end, surface = [], [], [], []
                for i, t in enumerate(piece.column(1).to_pylist()):
                    if t is None:
                        continue
                    places = [m.span() for m in _WORD.finditer(t)]
                    for k, (s, e) in enumerate(places):
                        word = t[s:e].lower()
                        hit = firsts.get(word)
                        if hit is None:
                            hit = firsts[word] = passes("\0" + word)
                        if not hit:
                            continue
                        for _, e in places[k : k + longest]:
                            run = t[s:e]
                            if len(run.encode()) >= min_length and passes(run.lower()):
                                who.append(i)
                                start.append(s)
                                end.append(e)
                                surface.append(run)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(who, pa.int64())), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(surface, pa.string())], names=[id_col, "start", "end", "surface"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text).mapInArrow(cut, f"`{id_col}` {kind}, start long, end long, surface string")


def tag_text(df: DataFrame, id_col: str, text: str, entries: DataFrame, min_length: int = 6) -> DataFrame:
    """Dictionary hits in whole texts: id, start, end, iri and the entry's columns; one row per place and term, labels before synonyms."""
    entries = cut_lineage(entries)
    found = spans(df, id_col, text, entries, min_length).withColumn("surface", F.lower("surface"))
    hits = found.join(small_side(entries), "surface")
    return hits.groupBy(id_col, "start", "end", "iri").agg(F.min(F.struct("string_type", "surface", "label", "ontology", "short_form")).alias("e")).select(id_col, "start", "end", "iri", "e.*")


def tag_values(props: DataFrame, entries: DataFrame) -> DataFrame:
    """Dictionary hits in short values, with coverage (matched bytes / bytes of the text); a hit needs 2 to 6 bytes, by the text's length in characters. One row per term, the widest hit first."""
    entries = cut_lineage(entries)
    least = F.greatest(F.lit(2), F.least(F.lit(6), F.length("text")))
    found = spans(props, "text", "text", entries, 2).filter(F.octet_length("surface") >= least)
    hits = found.withColumn("matched", F.octet_length("surface")).withColumn("surface", F.lower("surface")).join(small_side(entries), "surface")
    best = hits.groupBy("text", "iri").agg(F.min(F.struct((-F.col("matched")).alias("m"), "string_type", "start", "label", "ontology", "short_form", "source")).alias("e"))
    return best.select("text", "iri", "e.*").withColumn("coverage", -F.col("m") / F.octet_length("text")).drop("m")


def tag_evidence(hits: DataFrame, discount: float = 1.0) -> DataFrame:
    """Kind and confidence of tag hits: a curated string, a label (what is neither counts as one) or a synonym, as a whole or in part."""
    whole, curated = F.col("coverage") >= 1.0, F.col("string_type") == "CURATION"
    kind = (
        F.when(whole & curated, "CURATED_EXACT")
        .when(whole & (F.lower("string_type") == "synonym"), "OLS_TEXT_TAGGER_SYNONYM")
        .when(whole, "OLS_TEXT_TAGGER")
        .when(curated, "CURATED_SUBSTRING")
        .otherwise("OLS_TEXT_TAGGER_SUBSTRING")
    )
    return hits.withColumn("kind", kind).withColumn("confidence", ev.tier_confidence(ev.tier_of(F.col("kind")), F.col("coverage")) * discount)


def holders(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, iri, ord, name, n: every name (of n content words) that holds all content words of a text.

    texts has text; names has iri, name, ord (0 for the label). Only a text's rarest word is joined, so a frequent word multiplies nothing
    unless all words are frequent.
    """
    n = cut_lineage(names.select("iri", "name", "ord", sim.content_tokens(F.col("name")).alias("nt")).filter("size(nt) > 0"))
    rarity = materialised(n.select(F.explode("nt").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")))
    q = texts.select("text").distinct().withColumn("qt", sim.content_tokens(F.col("text"))).filter("size(qt) > 0")
    rare = q.select("text", "qt", F.explode("qt").alias("w")).join(rarity, "w", "left").groupBy("text", "qt").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "w")).alias("r")).select("text", "qt", F.col("r.w").alias("w"))
    each = n.select("iri", "name", "ord", "nt", F.explode("nt").alias("w"))
    return rare.join(small_side(each), "w").filter(sim.contains_all(F.col("qt"), F.col("nt"))).select("text", "iri", "ord", "name", F.size("nt").alias("n"))


def containment_candidates(texts: DataFrame, names: DataFrame) -> DataFrame:
    """text, iri, name, n, score: the names that hold all content words of a text, the tightest of each term, scored against the text's tightest."""
    per_term = holders(texts, names).groupBy("text", "iri").agg(F.min(F.struct("n", "ord", "name")).alias("b")).select("text", "iri", "b.n", "b.name")
    least = F.min("n").over(Window.partitionBy("text"))  # no more rows per text than terms
    return per_term.withColumn("least", least).select("text", "iri", "name", "n", sim.containment_score(F.col("least"), F.col("n")).alias("score"))


def set_join(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """l, r, jaccard of every pair of sets (left: l, g; right: r, g; l and r unique) with a Jaccard similarity of ``least`` or more; empty sets give none.

    A prefix-filter join: elements are ordered by rarity on the right; two sets that similar share one of their first elements. A pair is kept where the
    rarest element that it shares is met, so that no pair comes twice.
    """
    right = right.filter("size(g) > 0")
    rarity = materialised(right.select(F.explode("g").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")))

    def ordered(df: DataFrame, name: str, size: str, out: str) -> DataFrame:
        known = df.filter("size(g) > 0").select(name, F.explode("g").alias("w")).join(rarity, "w", "left")
        return known.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("d"), "w"))), lambda s: s["w"]).alias(out)).select(name, out, F.size(out).alias(size))

    def prefix(df: DataFrame, out: str, size: str, place: str) -> DataFrame:
        return df.select("*", F.posexplode(F.slice(out, F.lit(1), (F.col(size) - F.ceil(F.lit(least) * F.col(size) - 1e-9) + 1).cast("int"))).alias(place, "w"))

    # The left side's sets are short and dear to compare: with a number given they are not packed into a few tasks by their bytes.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lq, rn = cut_lineage(ordered(left, "l", "n", "a").repartition(tasks, "l")), cut_lineage(ordered(right, "r", "m", "b"))
    n, m = F.col("n"), F.col("m")
    pairs = prefix(lq, "a", "n", "i").join(small_side(prefix(rn, "b", "m", "j")), "w").filter((m >= least * n - 1e-9) & (n >= least * m - 1e-9))
    # What is left behind the shared place must suffice for the similarity.
    pairs = pairs.filter(F.least(n - F.col("i"), m - F.col("j")) >= least / (1 + least) * (n + m) - 1e-9)
    pairs = pairs.withColumn("both", F.array_intersect("a", "b")).filter(F.col("both")[0] == F.col("w"))
    common = F.size("both")
    return pairs.select("l", "r", (common / (n + m - common)).alias("jaccard")).filter(F.col("jaccard") >= least - 1e-9)


def similar_names(texts: DataFrame, names: DataFrame, least: float = 0.5, k: int = 20) -> DataFrame:
    """text, iri, jaccard, place: the k terms whose best name shares most words with a text, of all with a token Jaccard of ``least`` or more."""
    q = texts.select(F.col("text").alias("l")).distinct().withColumn("g", sim.tokens(F.col("l")))
    n = names.select(F.col("name").alias("r")).distinct().withColumn("g", sim.tokens(F.col("r")))
    scored = set_join(q, n, least).select(F.col("l").alias("text"), F.col("r").alias("name"), "jaccard")
    per_term = scored.join(materialised(names.select("iri", "name").distinct()), "name").groupBy("text", "iri").agg(F.max("jaccard").alias("jaccard"))
    w = Window.partitionBy("text").orderBy(F.round("jaccard", 9).desc(), "iri")
    return per_term.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def _unit(column: pa.ChunkedArray, n: int) -> np.ndarray:
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    size = np.sqrt((x * x).sum(1))[:, None]
    return x / np.where(size == 0, 1, size)


def nearest_vectors(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """query_id, id, similarity (cosine rounded to 9 places), place of the k nearest of ``base`` (id, vector) for each of ``queries`` (query_id, vector); a vector is not its own neighbour.

    Exact, by blocks: both sides are hashed into blocks of about BLOCK vectors and every pair of blocks is one task with one matrix
    product, which keeps k per query. Vectors must have one length; null vectors are left out; among equals the smaller id comes first.
    """
    b, q = base.filter("vector is not null"), queries.filter("vector is not null")
    nb, nq = (max(1, -(-d.count() // BLOCK)) for d in (b, q))
    b = b.withColumn("xb", F.pmod(F.xxhash64("id"), F.lit(nb)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())])
        if not len(left) or not len(right):
            return schema.empty_table()
        ids, own = right.column("id").to_numpy(), left.column("query_id").to_numpy()
        order = np.argsort(ids)
        s = np.round(_unit(left.column("vector"), len(left)) @ _unit(right.column("vector"), len(right))[order].T, 9)
        s[own[:, None] == ids[order][None, :]] = -2
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(s, top, 1)
        keep = near > -2
        return pa.Table.from_arrays([pa.array(np.repeat(own, top.shape[1])[keep.ravel()]), pa.array(ids[order][top][keep]), pa.array(near[keep])], schema=schema)

    found = q.groupBy("xb", "qb").cogroup(b.groupBy("xb", "qb")).applyInArrow(best, "query_id long, id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def expand_similar(seeds: DataFrame, similar: DataFrame, least: float = 0.7) -> DataFrame:
    """Rows for the terms near a seed: seeds (prop_id, seq, iri, confidence, kind) with confidence above ``least`` that are no vector matches, joined to similar (iri, other, similarity); self and weak edges are left out."""
    s = seeds.filter((F.col("confidence") > least) & (F.coalesce(F.col("kind"), F.lit("")) != "OLS_EMBEDDING"))
    edges = similar.filter((F.col("similarity") >= least) & (F.col("iri") != F.col("other")))
    return s.join(edges, "iri").select("prop_id", "seq", "iri", "other", "similarity", (F.col("confidence") * ev.SIMILAR_DISCOUNT * F.col("similarity")).alias("confidence"))


def expand_xrefs(seeds: DataFrame, xrefs: DataFrame, most: int = 2) -> DataFrame:
    """Rows for the terms that cross-references of at most so many steps lead to; confidence falls with distance."""
    near = xrefs.filter(F.col("distance") <= most)
    return seeds.join(near, F.col("iri") == F.col("source_iri")).select("prop_id", "seq", "iri", "target_iri", "distance", (F.col("confidence") * ev.xref_discount(F.col("distance"))).alias("confidence"))
