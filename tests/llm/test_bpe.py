import random

import pytest
from pyspark.sql import functions as F

from termweave.llm.bpe import VOCABULARY, Encoder, PrefixTable, token_count, token_ids

TEXTS = ["a" * 3000, " " * 777, "<|endoftext|>\n\n\t x", "กำ" * 300, "😀👨‍👩‍👧", "don't we'll", "1234567890" * 40, "\r\n 　a", "zxqj" * 300, " ", "\n", "é̩x"]


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_equals_the_public_tokenizer(public):
    r, e = random.Random(1), Encoder()
    for t in TEXTS + ["".join(r.choice("abeitnsr oéж日,.\n'1") for _ in range(200)) for _ in range(150)]:
        assert e.encode(t) == public(t)


def test_appends_and_edits():
    e, r = Encoder(), random.Random(2)
    for _ in range(40):
        word = "".join(r.choice("abeitnsré") for _ in range(30)).encode()
        cut, at = r.randint(0, 30), r.randint(0, 20)
        whole = PrefixTable(e.vocabulary, word).ids()
        assert PrefixTable(e.vocabulary, word[:cut]).append(word[cut:]).ids() == whole
        assert PrefixTable(e.vocabulary, word).edit(at, at + 5, b"xyz").ids() == PrefixTable(e.vocabulary, word[:at] + b"xyz" + word[at + 5 :]).ids()


def test_an_edit_is_encoded_again_near_it_only(monkeypatch):
    e, r = Encoder(), random.Random(9)
    word = "".join(r.choice("abeitnsré") for _ in range(4000)).encode()
    table, steps = PrefixTable(e.vocabulary, word), []
    step = PrefixTable._next
    monkeypatch.setattr(PrefixTable, "_next", lambda self: (steps.append(1), step(self)))
    edited = table.edit(50, 52, b"xyz")
    assert len(steps) < 50 + 2 * e.vocabulary.longest
    assert edited.ids() == PrefixTable(e.vocabulary, word[:50] + b"xyz" + word[52:]).ids()


def test_columns(spark, public):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "a b"), (4, "a b")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = [(r[0], list(r[1]), r[2]) for r in df.select("doc_id", token_ids(F.col("text")), token_count(F.col("text"))).collect()]
    assert got == [(1, [], 0), (2, [], 0), (3, public(" "), 1), (4, public("a b"), 2), (4, public("a b"), 2)]
    assert df.limit(0).select(token_ids(F.col("text"))).count() == 0
