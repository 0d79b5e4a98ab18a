import pytest
from pyspark.sql import functions as F

from termweave.llm.sentences import Splitter, corpus_class, sentence_spans

CASES = [
    ["It grew slowly, No. 3, at 4 deg. C, when Dr. Bo left.", "We saw p < .05 here.", "54 plates came."],
    ["It was split... then A. Foster wrote it.", "pH values rose to 7.4.", "The end?!"],
    ['The note "It grew. The rest fell." was filed.', "“Fine again?” asked K. Bo.", '"We left."'],
    ['Bo wrote: "It grew."', "(The rest fell.)", "It held a, b, etc.", "The next (see p. 3) fell."],
    ["Background", "- first item", "- second item, 3 mg", "The long line is\nbroken here.", "2.1 Results", "1) x y"],
    ["Laut Nr. 7 bzw. Tab. 2 fehlt z. B. Xyn.", "Am 30. März wurde es gemessen.", "Prof. Bo nannte es „zu grob. Nicht gut.“ und ging."],
    ["Остались соль и т. д.", "В 26 г. метку сняли…", "«Это соль. Больше ничего.» — записал Тарвин.", "Это точно соль?"],
    ["记录写道：“没有。请重做。”", "这真的是吗？", "他问：“是吗？”然后离开了。", "（见图1。）", "经过5小时升至3.5%……", "请删除！"],
    ["「ない。再確認せよ。」と記録にある。", "これは本当ですか？", "（図6を参照。）"],
    ["“यह नहीं है। फिर से जाँचें।” ऐसा लिखा था।", "क्या यह है?", "डॉ. मोलदेक ने देखा।"],
    ["ค่าที่วัดได้คือ 32.50 หน่วย", "เราไม่พบ Morvit ในเนื้อเยื่อ", "ฉลากเดิมถูกลบแล้ว"],
    ["رأى د. طارفي علامة في الكبد.", "هل هذا هو؟", "انظر ص. 13 من السجل."],
    ["« C’est X. Rien de plus. », note Bo.", "Attention, X manque !", "Est-ce bien Y ?"],
    ["After 3 h it rose to 1,163 h.", "The note fell to .5 h.", "Через 4 ч. запись сняли."],
    ["It was stage I.", "The donors at 9 a.m. left.", "It ended at 9 p.m.", "We fell."],
]


@pytest.mark.parametrize("want", CASES)
def test_cases(want):
    text, at, spans = "", 0, []
    for i, s in enumerate(want):
        new_line = s[:1] in "-" or want[0] == "Background"
        sep = "" if not i else "\n" if new_line else "" if any("぀" <= c <= "鿿" for c in s + want[i - 1]) else " "
        text += sep
        spans.append((len(text), len(text) + len(s)))
        text += s
    got = Splitter().spans(text)
    assert [text[a:b] for a, b in got] == want and got == spans


def test_document_evidence():
    text = "The obs. was late, and the obs. of Marn fell. Marn saw obs. Marn again. The end."
    assert len(Splitter().spans(text)) == 3


def test_document_overrules_the_prior():
    text = "On a tab we wrote it. He closed the tab. Then he left."
    assert [text[a:b] for a, b in Splitter().spans(text)] == ["On a tab we wrote it.", "He closed the tab.", "Then he left."]
    assert len(Splitter(evidence=False).spans(text)) == 2


def test_corpus_class():
    assert corpus_class(40, 100, 0, 0) == "open" and corpus_class(4, 10, 0, 1) == "final"
    assert corpus_class(60, 100, 20, 5) == "final" and corpus_class(0, 200, 30, 0) == ""
    assert corpus_class(0, 3, 0, 0) == corpus_class(1, 50, 0, 900) == corpus_class(0, 0, 0, 9) == ""


def test_planted_abbreviation_is_learnt_whatever_its_length(spark):
    """Words of the corpus that mostly go on are no ends elsewhere; off, the evidence changes just these documents. Few or many, by broadcast or by join, the result is one."""
    learn = [(i, f"The longabbrev. of number {i} fell, and the zzq. was {i} high. It ended.") for i in range(120)]
    asked = [(500, "They saw longabbrev. Marn and zzq. Ovid there. It ended."), (501, "They saw the plate. Marn left."), (502, None)]
    df = spark.createDataFrame(learn + asked, "d long, text string")
    spans = lambda **k: sorted((r.d, r.start_pos, r.end_pos) for r in sentence_spans(df, "d", "text", **k).collect())
    on, off = spans(), spans(evidence=False)
    assert len([r for r in on if r[0] == 500]) == 2 and len([r for r in on if r[0] == 501]) == 2
    assert {r[0] for r in set(on) ^ set(off)} == {500}
    assert spans(broadcast_rows=0) == on


def test_names_go_on(spark):
    text = "We met Marn, and Marn obs. it. The obs. was late. The obs. Marn made fell. The obs. Then it ended."
    assert len(Splitter().spans(text)) == 5


@pytest.mark.parametrize("text", ["", "   \n", None])
def test_nothing(text):
    assert Splitter().spans(text) == []


def test_rows(spark):
    long = "It grew. " * 30_000
    df = spark.createDataFrame([(1, "Aa bb. Cc dd."), (2, None), (3, ""), (4, long), (1, "Aa bb. Cc dd."), (5, "😀 fell. 😀")], "doc_id long, text string").withColumn("start_pos", F.lit("clash"))
    got = sentence_spans(df, "doc_id", "text")
    assert got.filter("doc_id = 4").count() == 30_000
    assert sorted(map(tuple, got.filter("doc_id <> 4").collect())) == [(1, 0, 6), (1, 0, 6), (1, 7, 13), (1, 7, 13), (5, 0, 7), (5, 8, 9)]
    assert sentence_spans(df.limit(0), "doc_id", "text").count() == 0
