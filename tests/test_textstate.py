"""Text state by windows against a sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from quireflow.functions.lexer import operations
from quireflow.operators.textstate import page_text, text_object_problems, text_spans
from quireflow.sources.pdf import operators_of


def model(data, reset):
    """Spans by walking the operators: (text_obj_ord, x, y, text, font, leading, char spacing)."""
    out, obj, inside = [], -1, False
    lead, font, space, m = 0.0, None, 0.0, None
    for o in operations(data)[0]:
        n = o.nums or []
        if o.op == "BT":
            obj, inside, m = obj + 1, True, [1, 0, 0, 1, 0, 0]
            if reset:
                lead, font, space = 0.0, None, 0.0
        elif o.op == "ET":
            inside = False
        if reset and not inside:
            continue
        if o.op == "TL":
            lead = n[0]
        if o.op == "Tc":
            space = n[0]
        if o.op == "Tf":
            font = o.name.decode()
        if not inside:
            continue

        def move(x, y):
            m[4], m[5] = m[4] + m[0] * x + m[2] * y, m[5] + m[1] * x + m[3] * y

        def show(t):
            out.append((obj, round(m[4], 3), round(m[5], 3), t.decode("latin-1"), font, lead, space))

        if o.op == "TD":
            lead = -n[1]
        if o.op in ("Td", "TD"):
            move(*n)
        if o.op == "Tm":
            m = list(n)
        if o.op in ("T*", "'", '"'):
            move(0, -lead)
        if o.op == '"':
            space = n[1]
        if o.op in ("Tj", "'", '"'):
            show(o.text)
        if o.op == "TJ":
            for t, off in o.items:
                show(t) if t is not None else move(-off / 1000, 0)
    return out


def random_page(rng):
    pieces = ["BT", "ET", "{} TL", "{} {} Td", "{} {} TD", "{} 0 0 {} {} {} Tm", "T*", "({}) Tj", "({}) '", "{} {} ({}) \"", "[({}) {} ({}) {}] TJ", "/F{} 9 Tf", "{} Tc", "q"]
    return " ".join(rng.choice(pieces).format(*[rng.randint(-9, 9) for _ in range(4)]) for _ in range(rng.randint(5, 40))).encode()


@pytest.mark.parametrize("mode", ["default", "reset"])
def test_against_the_model(spark, mode):
    rng = random.Random(7)
    pages = [(i, random_page(rng)) for i in range(60)]
    ops = operators_of(spark.createDataFrame(pages, "page int, content binary"), ["page"], "content")
    got = {}
    for r in text_spans(ops, ["page"], mode).orderBy("page", "text_obj_ord", "span_ord").collect():
        got.setdefault(r.page, []).append((r.text_obj_ord, round(r.x, 3), round(r.y, 3), r.text, r.font, r.leading, r.char_spacing))
        assert (r.error is None) == (r.font is not None)
    for i, data in pages:
        want = model(data, mode == "reset")
        assert [g[:1] + g[3:] for g in got.get(i, [])] == [w[:1] + w[3:] for w in want], data
        assert [x for g in got.get(i, []) for x in g[1:3]] == pytest.approx([x for w in want for x in w[1:3]], abs=0.01), data


def spans(spark, data, mode="default"):
    ops = operators_of(spark.createDataFrame([(1, data)], "page int, content binary"), ["page"], "content")
    return [(r.text_obj_ord, r.x, r.y, r.text, r.font, r.font_size, r.error) for r in text_spans(ops, ["page"], mode).orderBy("text_obj_ord", "span_ord").collect()]


def test_fixed_cases(spark):
    assert spans(spark, b"BT /F1 1 Tf (a) Tj /F2 2 Tf (b) Tj ET") == [(0, 0, 0, "a", "F1", 1, None), (0, 0, 0, "b", "F2", 2, None)]
    assert spans(spark, b"BT /F1 9 Tf 12 TL ET BT (x) Tj ET") == [(1, 0, 0, "x", "F1", 9, None)]
    assert spans(spark, b"BT /F1 9 Tf 12 TL ET BT (x) Tj ET", "reset") == [(1, 0, 0, "x", None, None, "text shown before font")]
    assert spans(spark, b"BT ET BT /F1 9 Tf (x) Tj ET")[0][:4] == (1, 0, 0, "x")
    assert [s[1:4] for s in spans(spark, b"BT /F1 10 Tf [(a) -500 (b)] TJ 0 -10 Td (c) Tj ET")] == [(0, 0, "a"), (0.5, 0, "b"), (0.5, -10, "c")]
    assert [s[1:4] for s in spans(spark, b"BT 1 0 0 1 10 20 Tm 5 -2 Td (a) Tj 1 1 Td (b) Tj 2 0 0 2 0 0 Tm 3 4 Td (c) Tj ET")] == [(15, 18, "a"), (16, 19, "b"), (6, 8, "c")]
    assert spans(spark, b"(outside) Tj") == [] and spans(spark, b"") == [] and spans(spark, None) == []
    with pytest.raises(ValueError):
        spans(spark, b"", "other")


def test_problems_and_page_text(spark):
    data = b"BT (a) Tj /F1 1 Tf ET BT /F1 1 Tf (b) Tj ET BT 5 6 (hi) \" (x) ' [(y) 5 <FEFF0416>] TJ"
    ops = operators_of(spark.createDataFrame([(1, data)], "page int, content binary"), ["page"], "content")
    assert [(r.text_obj_ord, r.error) for r in text_object_problems(ops, ["page"]).orderBy("text_obj_ord").collect()] == [(0, "text shown before font"), (2, "text shown before font")]
    assert page_text(ops, ["page"]).first().page_text == "\na\nb\n\nhi\nxyЖ"
    assert ops.where(F.col("trailing_at").isNotNull()).count() == 0
