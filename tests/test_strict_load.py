import csv
import io
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.operators.strict_load import reject, strict_load

FORMATS = [(1, ",", '"', "row_no,propertyValue,propertyType,submitted"), (2, ";", "'", "propertyValue,row_no,submitted,note,propertyType"), (3, None, '"', "x")]
OK = "7,value,cell,2021-02-03 04:05:06"


def frames(spark, lines, extra=False):
    raw = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "raw_id long, format_id int, line string")
    if extra:
        raw = raw.withColumn("fields", F.lit("clash")).withColumn("reason", F.lit(1))
    return raw, spark.createDataFrame(FORMATS, "format_id int, delimiter string, quote_char string, column_list string"), spark.createDataFrame([("cell",), (None,)], "type_name string")


CASES = [
    ((1, OK), None),
    ((1, '"7","a ""b"", c\nd","cell","2021-02-03 04:05:06"'), None),
    ((1, '7,a"b,cell,2021-02-03 04:05:06'), "quoting"),
    ((1, '7, "ab",cell,2021-02-03 04:05:06'), "quoting"),
    ((1, '7,"ab" ,cell,2021-02-03 04:05:06'), "quoting"),
    ((1, '7,"ab,cell,2021-02-03 04:05:06'), "quoting"),
    ((1, '7,"a\\"b",cell,2021-02-03 04:05:06'), "quoting"),
    ((1, ""), "column_count"),
    ((1, None), "column_count"),
    ((1, '""'), "column_count"),
    ((1, OK + ",x"), "column_count"),
    ((1, "1234567890123,v,cell,2021-02-03 04:05:06"), "invalid_value"),
    ((1, "７,v,cell,2021-02-03 04:05:06"), "invalid_value"),
    ((1, "7,--,cell,2021-02-03 04:05:06"), "invalid_value"),
    ((1, "7,v�,cell,2021-02-03 04:05:06"), "invalid_value"),
    ((1, "7,v\x07,cell,2021-02-03 04:05:06"), "invalid_value"),
    ((1, "7,v\x01a,cell,2021-02-03 04:05:06"), "invalid_value"),
    ((1, "7,v,Cell,2021-02-03 04:05:06"), "invalid_value"),
    ((1, "7,v,,2021-02-03 04:05:06"), None),
    ((1, "7,v,cell,2021-02-29 04:05:06"), "invalid_value"),
    ((1, "7,v,cell,2021-02-03 24:05:06"), "invalid_value"),
    ((1, "7,v,cell,2021-02-03 4:05:06"), "invalid_value"),
    ((1, "7,v,cell,0000-02-03 04:05:06"), "invalid_value"),
    ((2, "'it''s; so';7;2021-02-03 04:05:06;\x01any\x01b;cell"), None),
    ((2, 'a "b";7;2021-02-03 04:05:06;;'), None),
    ((9, OK), "unknown_format"),
    ((None, OK), "unknown_format"),
    ((3, OK), "unknown_format"),
]


def test_cases(spark):
    raw, formats, types = frames(spark, [c for c, _ in CASES], extra=True)
    bad = {r.raw_id: r.reason for r in reject(raw, formats, types).collect()}
    assert bad == {i: want for i, (_, want) in enumerate(CASES) if want}
    good = strict_load(raw, formats, types).orderBy("raw_id").collect()
    assert [r.raw_id for r in good] == [i for i, (_, want) in enumerate(CASES) if not want]
    by_id = {r.raw_id: r for r in good}
    assert by_id[1].propertyValue == 'a "b", c\nd' and by_id[1].submitted == datetime(2021, 2, 3, 4, 5, 6)
    note = by_id[next(i for i, (c, _) in enumerate(CASES) if c[1] and "any" in c[1])]
    assert note.propertyValue == "it's; so" and note.note == "\x01any\x01b"


def test_long_and_empty(spark):
    raw, formats, types = frames(spark, [(1, '7,"' + 'x""' * 20_000 + '",cell,2021-02-03 04:05:06')])
    assert reject(raw, formats, types).count() == 0
    empty, formats, types = frames(spark, [])
    assert reject(empty, formats, types).count() == strict_load(empty, formats, types).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.text(alphabet='ab",; \n', min_size=0, max_size=8), min_size=40, max_size=40))
def test_round_trip(spark, values):
    lines = []
    for v in values:
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow(["7", "x" + v, "cell", "2021-02-03 04:05:06"])
        lines.append((1, out.getvalue()))
    raw, formats, types = frames(spark, lines)
    assert [r.propertyValue for r in strict_load(raw, formats, types).orderBy("raw_id").collect()] == ["x" + v for v in values]
