"""Column parsers: one table of cases for each."""

import pytest
from pyspark.sql import functions as F

from quireflow.functions import scalars as s

CASES = {
    "boolean": [(b"true", True), (b" false ", False), (b"tru", None), (b"yes", None), (b"1", None)],
    "i16": [(b"-32768", -32768), (b"32767", 32767), (b"32768", None), (b"+5", 5), (b"007", 7), (b"1.5", None), (b"", None)],
    "i32": [(b"99999999999999999999", None), (b"-2147483648", -2147483648)],
    "u8": [(b"255", 255), (b"256", None), (b"-1", None), (b"+3", 3)],
    "u32": [(b"4294967295", 4294967295), (b"4294967296", None)],
    "nonzero_u8": [(b"0", None), (b"1", 1), (b"255", 255), (b"256", None)],
    "f64": [(b".5", 0.5), (b"1e5", 1e5), (b"-2.25", -2.25), (b"x", None), (b"5", 5.0)],
    "literal_string": [(b"(a\\(b)", b"a(b"), (b"x", None), (b"(open", None)],
    "hex_string": [(b"<901FA>", b"\x90\x1f\xa0"), (b"<9 0>", b"\x90"), (b"<>", b""), (b"<xy>", None)],
    "string": [(b"<41>", b"A"), (b"(A)", b"A"), (b"/A", None)],
    "name": [(b"/A#20B", b"A B"), (b"/Plain", b"Plain"), (b"A", None), (b"/A)", b"A")],
    "reference": [(b"12 0 R", (12, 0)), (b"12 0", None), (b"12  3\nR", (12, 3))],
    "rectangle": [(b"[0 0 612 792.5]", (0.0, 0.0, 612.0, 792.5)), (b"[1 2 3]", None), (b"[1 2 3 /A]", None)],
    "file_id": [(b"[<00><01>]", (b"\x00", b"\x01")), (b"[(ab)(cd)]", (b"ab", b"cd")), (b"[<00>]", None)],
    "date": [
        (b"D:2000", (2000, None, None, None, None, None, None)), (b"(D:2000)", (2000, None, None, None, None, None, None)), (b"D:19981223195230-08'00'", (1998, 12, 23, 19, 52, 30, -480)), (b"D:199812231952Z", (1998, 12, 23, 19, 52, None, 0)),
        (b"D:20200101+05'45", (2020, 1, 1, None, None, None, 345)), (b"2000", None),
    ],
    "maybe_array": [(b"/A", [b"/A"]), (b"[/A /B]", [b"/A", b"/B"]), (b"[]", [])],
    "array": [(b"[1 (]) 2 0 R]", [b"1", b"(])", b"2 0 R"]), (b"1", None)],
    "dictionary": [(b"<</A 1/B[2]>>", {"A": b"1", "B": b"[2]"}), (b"[", None)],
}


@pytest.mark.parametrize("kind", CASES)
def test_parsers(spark, kind):
    rows = [(i, b) for i, (b, _) in enumerate(CASES[kind])] + [(99, None)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "i int, b binary").select("i", s.parse_as(kind, F.col("b"))).collect()}
    for i, (data, want) in enumerate(CASES[kind]):
        have = got[i]
        have = tuple(bytes(x) if isinstance(x, bytearray) else x for x in have) if isinstance(have, tuple) else bytes(have) if isinstance(have, bytearray) else have
        have = [bytes(x) for x in have] if isinstance(have, list) else {k: bytes(v) for k, v in have.items()} if isinstance(have, dict) else have
        assert have == want, data
    assert got[99] is None or kind == "maybe_array"


def one(spark, data, f):
    return spark.createDataFrame([(data,)], "b binary").select(f(F.col("b")).alias("v")).first()["v"]


def test_text_decoding(spark):
    for data, want in ((b"caf\xe9", "café"), (b"\xfe\xff\x04\x16\x00A", "ЖA"), (b"\xfe\xff\xd8\x00\x00A", "�A"), (b"\xfe\xff\x00Ax", "A"), (b"", "")):
        assert one(spark, data, s.text) == want


def test_name_text_and_comment(spark):
    assert one(spark, b"a\xffb", s.name_text) == "a�b"
    assert one(spark, b"%  hello \r\nx", s.comment) == "hello " and one(spark, b"%x", s.comment) is None and one(spark, b"%\n", s.comment) == ""


def test_arrays_and_tuples(spark):
    assert one(spark, b"[1 2.5 -3]", s.number_array) == [1.0, 2.5, -3.0]
    assert one(spark, b"[1 2]", lambda c: s.number_array(c, 3)) is None
    assert tuple(one(spark, b"1  2\n3", lambda c: s.number_tuple(c, 3))) == (1.0, 2.0, 3.0)
    assert one(spark, b"1 2", lambda c: s.number_tuple(c, 3)) is None


def test_stream_and_kind(spark):
    v = one(spark, b"<</Length 3/K 1>>stream\nabc\nendstream", s.stream)
    assert bytes(v.content) == b"abc" and bytes(v.structured["K"]) == b"1"
    assert [one(spark, b, s.kind) for b in (b"null", b"1", b"1.", b"/A", b"()", b"[]", b"<<>>", b"1 0 R", b"?")] == ["null", "integer", "real", "name", "string", "array", "dictionary", "ref", None]


def test_filter_problem(spark):
    got = spark.createDataFrame([("FlateDecode",), ("LZWDecode",), ("X",)], "f string").select(s.filter_problem(F.col("f"))).collect()
    assert [r[0] for r in got] == [None, "unsupported filter LZWDecode", "unknown filter X"]


def test_field_specs(spark):
    specs = [s.FieldSpec("page_count", s.integer, required=True), [s.FieldSpec("kind", s.name, key="Type", default=b"Page")], s.FieldSpec("up", s.integer, convert=lambda c: c + 1)]
    df = spark.createDataFrame([(b"<</PageCount 3/Up 1>>", 7), (b"<</Type/X>>", 8)], "b binary, up int").select(s.dictionary(F.col("b")).alias("m"), "up")
    a, b = s.project(df, "m", specs).select("page_count", "kind", "up", "missing").collect()
    assert (a.page_count, bytes(a.kind), a.up, a.missing) == (3, b"Page", 2, []) and (b.page_count, bytes(b.kind), b.up, b.missing) == (None, b"X", None, ["PageCount"])


def test_big_integers_are_nodes_without_value(spark):
    rows = one(spark, b"[99999999999999999999999 1]", s.nodes)
    assert [r.int_v for r in rows] == [None, None, 1]
