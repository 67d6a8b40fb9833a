"""Values from bytes: the families of primitive and composite values, and every deviation handled."""

import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quireflow.functions import codecs, lexer, structure
from quireflow.functions.lexer import Name, Ref, SyntaxProblem


def read(b):
    return lexer.value(b)[0]


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"true", True), (b"false", False), (b"null", None), (b"12", 12), (b"+17", 17), (b"-98", -98), (b"0007", 7), (b"34.5", 34.5), (b"-3.62", -3.62), (b"4.", 4.0), (b".5", 0.5), (b"-.002", -0.002),
        # fixed values: the examples of the public standard
        (b"/Name1", b"Name1"), (b"/A;Name_With-Various***Characters?", b"A;Name_With-Various***Characters?"), (b"/1.2", b"1.2"), (b"/$$", b"$$"), (b"/Lime#20Green", b"Lime Green"), (b"/paired#28#29parentheses", b"paired()parentheses"), (b"/The_Key_of_F#23_Minor", b"The_Key_of_F#_Minor"), (b"/A#42", b"AB"), (b"/", b""),
        (b"/A)", b"A"), (b"/A{", b"A"), (b"/A%c", b"A"),
        (b"(simple)", b"simple"), (b"(a(b)c)", b"a(b)c"), (b"()", b""), (b"(\\101\\7x)", b"A\x07x"), (b"(\\0533)", b"+3"), (b"(a\\\nb)", b"ab"), (b"(a\\\r\nb)", b"ab"), (b"(a\r\nb\rc)", b"a\nb\nc"), (b"(\\\\)", b"\\"),
        (b"(a\\tb)", b"a\tb"), (b"(\\b\\f)", b"\x08\x0c"), (b"(\\q)", b"q"), (b"(\\777)", b"\xff"),
        (b"<901FA3>", b"\x90\x1f\xa3"), (b"<901FA>", b"\x90\x1f\xa0"), (b"<90 1F A>", b"\x90\x1f\xa0"), (b"<>", b""),
        (b"[1 2]", [1, 2]), (b"[1/A(b)<63>]", [1, b"A", b"b", b"c"]), (b"[]", []), (b"[[1]2 0 R]", [[1], Ref(2, 0)]), (b"12 0 R", Ref(12, 0)), (b"[1 2 3 0 R]", [1, 2, Ref(3, 0)]),
        (b"<</A 1/B<</C(x)>>>>", {b"A": 1, b"B": {b"C": b"x"}}), (b"<</A 1 % note\n/B 2>>", {b"A": 1, b"B": 2}), (b"<</A (>)/B 1>>", {b"A": b">", b"B": 1}), (b"<</A 1/A 2>>", {b"A": 2}), (b"% c\r\n 5", 5),
    ],
)
def test_values(data, want):
    assert read(data) == want


@pytest.mark.parametrize("data", [b"tru", b"fals", b"test", b"(open", b"<12", b"<xy>", b"[1 2", b"<</A 1", b"<<1 2>>", b"", b">>", b"(a\\"])
def test_no_values(data):
    with pytest.raises(SyntaxProblem):
        read(data)


def test_name_is_no_string():
    assert isinstance(read(b"/A"), Name) and not isinstance(read(b"(A)"), Name)


@given(st.binary(max_size=60))
def test_literal_round_trip(b):
    written = b"(" + b.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"
    assert read(written) == b
    assert read(b"<" + b.hex().encode() + b">") == b


@given(st.binary(max_size=80))
def test_any_bytes_end_or_raise(b):
    try:
        lexer.value(b)
    except SyntaxProblem:
        pass
    ops, at = lexer.operations(b)
    assert 0 <= at <= len(b)


def test_endless_numbers():
    with pytest.raises(SyntaxProblem):
        read(b"1" * 5000)
    assert lexer.operations(b"BT " + b"1" * 5000 + b" Tc") == ([lexer.operations(b"BT")[0][0]], 3)


def test_nesting_is_bounded():
    with pytest.raises(SyntaxProblem):
        read(b"[" * 5000)


def test_raw_dictionary_keeps_slices():
    assert lexer.raw_dictionary(b"<</A [1 2]/B(x)/A 3>> rest")[0] == {b"A": b"3", b"B": b"(x)"}


@pytest.mark.parametrize("data", [b"1 0 obj <</A 1>> endobj", b"1 0 obj<</A 1>>endobj", b"1 0 obj % c\n<</A 1>>\nendobj"])
def test_indirect(data):
    assert lexer.indirect(data, 0)[:3] == (1, 0, b"<</A 1>>")


@pytest.mark.parametrize("data", [b"1 0 obj 5", b"x 0 obj 5 endobj", b"1 obj 5 endobj"])
def test_no_indirect(data):
    with pytest.raises(SyntaxProblem):
        lexer.indirect(data, 0)


@pytest.mark.parametrize(("length", "want"), [(3, b"abc"), (99, b"abc"), (None, b"abc"), (2, b"abc")])
def test_stream_bytes(length, want):
    assert lexer.stream_bytes(b"abc\nendstream", 0, length) == want


# -- content ---------------------------------------------------------------------------------------


def ops(b):
    return [(o.op, o.nums, o.name, o.text, o.items) for o in lexer.operations(b)[0]]


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"BT", ("BT", None, None, None, None)), (b"ET", ("ET", None, None, None, None)), (b"1.5 Tc", ("Tc", [1.5], None, None, None)), (b"-2 Tw", ("Tw", [-2.0], None, None, None)), (b"90 Tz", ("Tz", [90.0], None, None, None)),
        (b"12 TL", ("TL", [12.0], None, None, None)), (b"/F1 9 Tf", ("Tf", [9.0], b"F1", None, None)), (b"3 Tr", ("Tr", [3.0], None, None, None)), (b"2 Ts", ("Ts", [2.0], None, None, None)), (b"1 2 Td", ("Td", [1.0, 2.0], None, None, None)),
        (b"1 -2 TD", ("TD", [1.0, -2.0], None, None, None)), (b"1 0 0 1 5 6 Tm", ("Tm", [1.0, 0.0, 0.0, 1.0, 5.0, 6.0], None, None, None)), (b"T*", ("T*", None, None, None, None)), (b"(a)Tj", ("Tj", None, None, b"a", None)),
        (b"<61>'", ("'", None, None, b"a", None)), (b'5 6 (hi) "', ('"', [5.0, 6.0], None, b"hi", None)), (b"[(])-5.5<62>]TJ", ("TJ", None, None, None, [(b"]", None), (None, -5.5), (b"b", None)])), (b"1 2 re", ("re", None, None, None, None)),
    ],
)
def test_operators(data, want):
    assert ops(data) == [want]


def test_keywords_and_images_are_no_operators():
    assert [o[0] for o in ops(b"true x BI /W 1 /H 1 ID ( EI Q % q\nq")] == ["x", "BI", "Q", "q"]


def test_bad_operands_are_reported():
    found, at = lexer.operations(b"(a) Tc 9 Tr BT (open")
    assert [o.error is None for o in found] == [False, False, True] and at == 15


# -- filters and structure -------------------------------------------------------------------------


def test_filters():
    z = zlib.compress(zlib.compress(b"abc"))
    assert codecs.decode(z + b"junk", [Name(b"FlateDecode")] * 2) == b"abc"
    assert codecs.decode(b"abc", None) == b"abc"
    for name, said in ((b"LZWDecode", "unsupported"), (b"Nope", "unknown")):
        with pytest.raises(SyntaxProblem, match=said):
            codecs.decode(b"", Name(name))
    with pytest.raises(SyntaxProblem):
        codecs.decode(zlib.compress(b"abc" * 99)[:-9], Name(b"FlateDecode"))


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4])
def test_predictors(kind):
    rows = [bytes([1, 2, 3, 200]), bytes([5, 1, 250, 7])]
    out, above = b"", bytes(4)
    for r in rows:
        line = []
        for i, x in enumerate(r):
            a, b, c = (r[i - 1], above[i], above[i - 1]) if i else (0, above[i], 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((x - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out += bytes([kind, *line])
        above = r
    assert codecs.unpredict(out, 12, 4) == b"".join(rows)


def test_startxref_is_the_last_of_the_tail():
    assert structure.start_offset(b"startxref\n5\n%%EOF startxref\r\n 77 %%EOF") == 77
    assert structure.start_offset(b"startxref 5" + b" " * 1100) is None


@pytest.mark.parametrize("eol", [b" \n", b" \r", b"\r\n"])
def test_xref_table(eol):
    rows, _ = structure.table_entries(b"\n0 2\n0000000000 65535 f%s0000000017 00002 n%s7 1\n0000000300 00000 n%strailer" % (eol, eol, eol), 0)
    assert [tuple(r) for r in rows] == [(0, 65535, "free", 0, None, None), (1, 2, "plain", 17, None, None), (7, 0, "plain", 300, None, None)]


def test_xref_stream_keeps_in_step():
    rows = structure.stream_entries(bytes.fromhex("000000FF0100 0F0002000501".replace(" ", "")), [1, 2, 1], [0, 3])
    assert [tuple(r) for r in rows] == [(0, 255, "free", 0, None, None), (1, 0, "plain", 15, None, None), (2, 0, "compressed", None, 5, 1)]
    assert [tuple(r) for r in structure.stream_entries(b"\x00\x0f", [0, 2, 0], [1, 1])] == [(1, 0, "plain", 15, None, None)]
    with pytest.raises(SyntaxProblem):
        structure.stream_entries(b"", [1, 0, 1], [0, 1])


def test_object_stream():
    assert structure.split_members(b"11 0 12 5 13 11 <<>> [1 2] 7", 3, 16) == {11: b"<<>>", 12: b"[1 2]", 13: b"7"}
    with pytest.raises(SyntaxProblem):
        structure.split_members(b"11", 3, 2)


def test_nodes_are_depth_first():
    rows = structure.nodes(b"<</A[1 2.5]/B 3 0 R>>")
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [(0, None, None, None, "dictionary"), (1, 0, b"A", None, "array"), (2, 1, None, 0, "integer"), (3, 1, None, 1, "real"), (4, 0, b"B", None, "ref")]


def _values():
    plain = st.none() | st.booleans() | st.integers(-(10**20), 10**20) | st.binary(max_size=12) | st.builds(lexer.Name, st.binary(max_size=8)) | st.builds(lexer.Ref, st.integers(0, 99), st.integers(0, 9))
    return st.recursive(plain, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.builds(lexer.Name, st.binary(max_size=5)), x, max_size=4), max_leaves=12)


@given(_values())
def test_values_are_written_and_read_again(v):
    written = lexer.syntax(v)
    back, end = lexer.value(written)
    assert back == v and type(back) is type(v) and end == len(written)


def test_reals_are_written_and_read_again():
    for x in (0.5, -2.25, 100.0, 1e-9):
        assert lexer.value(lexer.syntax(x))[0] == x
    with pytest.raises(TypeError):
        lexer.syntax(object())


def test_nesting_has_no_bound():
    deep = b"[" * 20_000 + b"<</A 1>>" + b"]" * 20_000
    v, end = lexer.value(deep)
    assert end == len(deep)
    for _ in range(20_000):
        v = v[0]
    assert v == {b"A": 1}
    for bad in (b"[1", b"<</A 1", b"<</A>>", b"<<1 2>>", b"]", b"[>>]"):
        with pytest.raises(lexer.SyntaxProblem):
            lexer.value(bad)


def test_white_space_at_the_end_is_read_once():
    for data in (b"1 2" + b" " * 200_000, b"(" + b"%" * 100_000, b"1" * 200 + b" " * 50_000, b"% x\n" * 50_000):
        assert lexer.operations(data)[0] == []
        with pytest.raises(SyntaxProblem):
            lexer.value(data + b"]" if data[:1] == b"%" else b"[" + data)
