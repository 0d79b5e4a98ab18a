"""Problem 5: free-typed values mapped to the closest entry of a reference list.

Values and names are brought to comparable strings, a name to one for every rotation of its words. A prefix-filter set-similarity join on
padded character trigrams finds the pairs within the slips that the name allows: trigrams are ordered by their rarity among the names; as one
slip breaks at most BREAKS of them, two strings must share one among the first BREAKS * slips + 1, the rarest, of each, at nearly the same
place and with nearly the same length. So only these prefixes are joined, under a length and two positional filters. An exact count of slips
decides; of several names the one with fewest slips is kept, then the most similar by the exact Jaccard similarity of the trigrams.

What is particular to a field (Greek letters, spellings, remarks, empty words) is a table that the caller gives (Spelling), and so are the
slips by length: with none only equal strings are mapped.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave.llm.lookalike import look
from termweave.session import cut_lineage, materialised, small_side, table

#: Most trigrams that a slip (inserted, missing, wrong or swapped letters) can break on either side.
BREAKS = 4
#: Slips that a name may suffer from so many letters on: none below the first, and never more than the last.
SLIPS = ((6, 1), (10, 2))

_PARENTHESISED = re.compile(r"\(\s*(\d{1,2}|i{1,3}|iv|vi{0,3}|ix|x)\s*\)")
_TYPE = re.compile(r"(type|stage|\bt)[\s-]*(\d{1,2}|i{1,3}|iv|vi{0,3}|ix|x)\b")
_WORDS = re.compile(r"[^\W_]+")
# Roman numerals that count types and stages.
ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10"}


@dataclass(frozen=True)
class Spelling:
    """How a field writes its names: letters written as words; letters that stand for these before a hyphen; endings, spellings and short forms with
    what they stand for; remarks around a value; words that carry no distinction; what may be put before and behind a name without a blank."""

    letters: dict[str, str] = field(default_factory=dict)
    hyphened: dict[str, str] = field(default_factory=dict)
    endings: dict[str, str] = field(default_factory=dict)
    spellings: dict[str, str] = field(default_factory=dict)
    remarks: tuple[str, ...] = ()
    empty: tuple[str, ...] = ()
    before: tuple[str, ...] = ()
    behind: tuple[str, ...] = ()

    @cached_property
    def _patterns(self) -> tuple[re.Pattern, ...]:
        none = "(?!)"
        hyphened = "|".join(map(re.escape, self.hyphened)) or none
        return (
            re.compile(rf"(?:(?<=\s)|\A)({hyphened})-(?=[a-z]{{3}})"),
            re.compile(r"\b(?:" + ("|".join(map(re.escape, self.remarks)) or none) + r")\b"),
            re.compile("(" + ("|".join(map(re.escape, self.endings)) or none) + r")\b"),
        )

    def comparable(self, text: str | None) -> str:
        """Words in one look, case and spelling, without accents and remarks; '' for null and for text without words."""
        if not text:
            return ""
        hyphened, remarks, endings = self._patterns
        s = unicodedata.normalize("NFD", look(text).lower())
        s = "".join(c for c in s if not unicodedata.combining(c))
        s = hyphened.sub(lambda m: self.hyphened[m.group(1)] + " ", s)
        for letter, name in self.letters.items():
            if letter in s:
                s = s.replace(letter, f" {name} ")
        s = _PARENTHESISED.sub(r" type \1 ", s)
        s = " ".join(_WORDS.findall(s))
        s = _TYPE.sub(lambda m: ("type" if m.group(1) == "t" else m.group(1)) + " " + ROMAN.get(m.group(2), m.group(2)), s)
        s = endings.sub(lambda m: self.endings[m.group(1)], remarks.sub(" ", s))
        return " ".join(w for t in s.split() for w in self.spellings.get(t, t).split())

    def content(self, words: str) -> str:
        """The distinguishing words, run together."""
        return "".join(w for w in words.split() if w not in self.empty)

    def typed_forms(self, value: str) -> set[tuple[int, str]]:
        """The strings without blanks that stand for a comparable value, of all its words (0) and of the distinguishing ones (1), also without what may be put before or behind."""
        out = set()
        for kind, typed in enumerate((value.replace(" ", ""), self.content(value))):
            cut = [typed, *(typed.removeprefix(x) for x in self.before), *(typed.removesuffix(x) for x in self.behind)]
            out |= {(kind, form) for form in cut if form}
        return out

    def turned_forms(self, name: str) -> set[tuple[int, str]]:
        """The rotations of a comparable name's words, run together, of all its words (0) and of the distinguishing ones (1)."""
        every = (name.split(), [w for w in name.split() if w not in self.empty])
        return {(kind, "".join(words[i:] + words[:i])) for kind, words in enumerate(every) for i in range(len(words))}


# How disease, anatomy and chemistry write their names.
DOMAIN = Spelling(
    letters={"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "κ": "kappa", "λ": "lambda", "μ": "mu", "ω": "omega"},
    hyphened={"a": "alpha", "b": "beta"},
    endings={"aemia": "emia"},
    spellings={"tumour": "tumor", "tumours": "tumors", "ad": "autosomal dominant", "ar": "autosomal recessive", "oedema": "edema", "anaemia": "anemia", "haemorrhage": "hemorrhage", "hcl": "hydrochloride"},
    remarks=("see form", "pt with", "prob", "confirmed", "nos", "etc"),
    empty=("the", "of", "with", "in", "from", "and", "human"),
    before=("the",),
    behind=("etc", "nos"),
)


def slips(a: str, b: str, most: int) -> int:
    """Inserted, missing, wrong or swapped letters between two strings; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, now[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            now.append(d)
        if min(now) > most and (not old or min(old) > most):
            return most + 1
        older, old = old, now
    return min(old[-1], most + 1)


def allowed(letters: int, by_length: tuple[tuple[int, int], ...] = SLIPS) -> int:
    """Slips that a string of so many letters may hold and still be that name."""
    return max((n for least, n in by_length if letters >= least), default=0)


def digits(s: str) -> str:
    return "".join(sorted(c for c in s if c.isdigit()))


def distance(value: str, name: str, spelling: Spelling = DOMAIN, by_length: tuple[tuple[int, int], ...] = SLIPS) -> int | None:
    """Slips between comparable strings whatever the rotation of the name's words and the blanks; None if the value does not name it: too many slips or other digits."""
    if digits(value) != digits(name):
        return None
    most = allowed(len(spelling.content(name)), by_length)
    turned = spelling.turned_forms(name)
    best = min((slips(form, r, most) for kind, form in spelling.typed_forms(value) for of, r in turned if of == kind), default=most + 1)
    return best if best <= most else None


@F.arrow_udf(T.IntegerType())
def _slips(left: pa.Array, right: pa.Array, most: pa.Array) -> pa.Array:
    return pa.array([slips(*x) for x in zip(left.to_pylist(), right.to_pylist(), most.to_pylist())], pa.int32())


def trigrams(text: Column) -> Column:
    """The set of character trigrams; a shorter text is its own."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.array_distinct(grams)


def names_of(terms: DataFrame, key: str, label: str, synonyms: str) -> DataFrame:
    """key, name: labels and synonyms; a synonyms text is null, a JSON list or a lone JSON string. Other JSON gives no synonym."""
    lists = F.coalesce(F.from_json(synonyms, "array<string>"), F.array(F.get_json_object(F.concat(F.lit('{"s":'), F.col(synonyms), F.lit("}")), "$.s")))
    names = F.array_append(F.coalesce(lists, F.array().cast("array<string>")), F.col(label))
    return terms.select(F.col(key).alias("key"), F.explode(names).alias("name")).filter("name is not null")


def slip_join(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """l, r, slips of every pair of distinct strings (left: l; right: r and s, at most ``most``, the slips it allows) that are within s slips.

    Each string has a trigram for every place, padded at both ends, ordered by its number on the right and then by itself; those unknown there
    come first. The right sends its first BREAKS * s + 1, the left as many as s may be for its length; of these one at least is shared and no more than s
    places away, which takes a string of BREAKS * s - 1 letters or more. Repeated strings count once. An empty side gives no rows.
    """

    def placed(df: DataFrame, name: str, *more: str) -> DataFrame:
        padded = F.concat(F.lit("^^"), name, F.lit("$$"))
        grams = F.transform(F.sequence(F.lit(1), F.length(name) + 2), lambda i: F.struct(F.substring(padded, i, F.lit(3)).alias("gram"), i.alias("at")))
        return df.select(name, *more, F.explode(grams).alias("g")).select(name, *more, "g.gram", "g.at")

    right = cut_lineage(right.groupBy("r").agg(F.max("s").alias("s")))
    each = placed(right, "r", "s")
    rarity = materialised(each.groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
    longest = right.agg(F.coalesce(F.max(F.length("r")), F.lit(0))).first()[0]
    # A fixed number of tasks: few bytes here become many rows in the join, which a task sized by bytes would do alone.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.select("l").filter(F.length("l") <= longest + most).repartition(tasks, "l").distinct()

    def prefix(df: DataFrame, name: str, many: Column, place: str, at: str, *more: str) -> DataFrame:
        known = df.join(rarity, "gram", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram", "at")))
        return known.groupBy(name, *more).agg(F.slice(order, 1, many).alias("g")).select(name, *more, F.posexplode("g").alias(place, "x")).select(name, *more, place, "x.gram", F.col("x.at").alias(at))

    asked = prefix(placed(left, "l"), "l", F.lit(BREAKS * most + 1), "i", "p")
    known = prefix(each, "r", BREAKS * F.col("s") + 1, "j", "q", "s")
    near = (F.abs(F.length("l") - F.length("r")) <= F.col("s")) & (F.abs(F.col("p") - F.col("q")) <= F.col("s")) & (F.col("i") <= BREAKS * F.col("s"))
    pairs = asked.join(materialised(known), "gram").filter(near).select("l", "r", "s").distinct()
    # A slip is at most two plain edits, which the built-in counts up to a threshold.
    plain = F.levenshtein("l", "r", 2 * most)
    pairs = pairs.filter((plain >= 0) & (plain <= 2 * F.col("s")))
    return pairs.withColumn("slips", _slips("l", "r", "s")).filter(F.col("slips") <= F.col("s")).select("l", "r", "slips")


def _jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def map_values(
    values: DataFrame, value_id: str, value: str, terms: DataFrame, key: str, label: str, synonyms: str, spelling: Spelling = DOMAIN, by_length: tuple[tuple[int, int], ...] = SLIPS
) -> DataFrame:
    """value_id, key, jaccard for every value: the term it names, or '' with null jaccard if it names none.

    Null and empty values name none. A name borne by several terms names none of them. Of several names within reach the one with
    fewest slips wins, then the highest Jaccard similarity, then the smallest key. Repeated rows each get their result.
    """
    most = max((n for _, n in by_length), default=0)
    if any(least < BREAKS * n - 1 for least, n in by_length):
        raise ValueError(f"{by_length}: a name that may suffer n slips must have at least {BREAKS} n - 1 letters")

    @F.arrow_udf(T.StringType())
    def comparable(texts: pa.Array) -> pa.Array:
        return pa.array([spelling.comparable(t) for t in texts.to_pylist()], pa.string())

    forms_type = "array<struct<kind:int,form:string>>"

    def forms_of(rule, words: str) -> Column:
        @F.arrow_udf(forms_type)
        def forms(texts: pa.Array) -> pa.Array:
            return pa.array([[{"kind": k, "form": f} for k, f in rule(t)] for t in texts.to_pylist()], pa.list_(pa.struct([("kind", pa.int32()), ("form", pa.string())])))

        return forms(F.col(words))

    @F.arrow_udf(T.StringType())
    def content(words: pa.Array) -> pa.Array:
        return pa.array([spelling.content(w) for w in words.to_pylist()], pa.string())

    number = F.array_join(F.array_sort(F.regexp_extract_all("_t", F.lit(r"(\p{Nd})"), 1)), "")
    rows = cut_lineage(values.select(F.col(value_id).alias("_id"), comparable(F.col(value)).alias("words")))
    wanted = rows.select("words").filter("words <> ''").distinct().withColumn("lc", content(F.col("words"))).filter("lc <> ''")
    wanted = cut_lineage(wanted.withColumn("_t", F.col("words")).withColumn("d", number).drop("_t").withColumn("forms", forms_of(spelling.typed_forms, "words")))
    names = names_of(terms, key, label, synonyms).withColumn("full", comparable(F.col("name"))).withColumn("rc", content(F.col("full"))).filter("rc <> ''")
    names = names.groupBy("rc").agg(F.min("full").alias("full"), F.min("key").alias("key"), F.countDistinct("key").alias("keys")).filter("keys = 1").drop("keys")
    slips_of = F.greatest(F.lit(0), *(F.when(F.length("rc") >= least, n).otherwise(0) for least, n in by_length)) if by_length else F.lit(0)
    names = cut_lineage(names.withColumn("_t", F.col("full")).withColumn("d", number).drop("_t").withColumn("s", slips_of).withColumn("forms", forms_of(spelling.turned_forms, "full")))
    typed = wanted.select("words", "lc", "d", F.inline("forms").alias("kind", "l"))
    turned = names.select("key", "full", "rc", "d", "s", F.inline("forms").alias("kind", "r"))
    near = cut_lineage(slip_join(typed.select("l"), turned.select("r", "s"), most))
    judged = near.join(typed, "l").join(turned.withColumnRenamed("d", "_d").withColumnRenamed("kind", "_kind"), "r")
    judged = judged.filter((F.col("kind") == F.col("_kind")) & (F.col("d") == F.col("_d")) & (F.col("slips") <= F.col("s")))
    judged = judged.withColumn("jaccard", _jaccard(trigrams(F.col("lc")), trigrams(F.col("rc"))))
    best = cut_lineage(judged.groupBy("words").agg(F.min(F.struct("slips", (-F.col("jaccard")).alias("minus"), "key")).alias("b")).select("words", F.col("b.key").alias("key"), (-F.col("b.minus")).alias("jaccard")))
    # The best terms are broadcast if few; else Spark shuffles and splits a skewed value such as a filler at run time.
    return rows.join(small_side(best), "words", "left").select(F.col("_id").alias(value_id), F.coalesce("key", F.lit("")).alias(key), "jaccard")


def _mapped(spark, sf_dir: str) -> DataFrame:
    free = table(spark, sf_dir, "text_to_map").filter("entry_mode = 'free'")
    return map_values(free, "row_id", "propertyValue", table(spark, sf_dir, "ols_terms").filter("is_obsolete = 0"), "iri", "label", "synonyms_json")


def p5_found(spark, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select("row_id", "iri")


def p5_unmatched(spark, sf_dir: str) -> DataFrame:
    """The free-typed values that name no term, with their number of rows."""
    none = _mapped(spark, sf_dir).filter("iri = ''").select("row_id")
    return none.join(table(spark, sf_dir, "text_to_map").select("row_id", "propertyValue"), "row_id").groupBy("propertyValue").agg(F.count(F.lit(1)).alias("n_rows"))
