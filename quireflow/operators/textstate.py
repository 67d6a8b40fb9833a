"""Positions and state of shown text, from the operators of content streams.

Text objects run from BT to ET. Everything is window expressions over the operators of a page in
order: the matrix starts anew at each Tm, moves are running sums inside such a segment, and every
other parameter is the last value set.

Two modes. By default only the matrix starts anew with each text object; font, leading and the other
parameters go on, as the page-description standard wants. Mode ``reset`` starts them all anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import scalars

PARAMETERS = {"char_spacing": ("Tc", 0.0), "word_spacing": ("Tw", 0.0), "horizontal_scaling": ("Tz", 100.0), "rendering_mode": ("Tr", 0.0), "rise": ("Ts", 0.0)}


def _n(i: int) -> Column:
    return F.try_element_at("nums", F.lit(i + 1))


def text_spans(operators: DataFrame, page: list[str], mode: str = "default", parameters: dict[str, tuple[str, float]] = PARAMETERS) -> DataFrame:
    """One row for each string shown: page keys, text_obj_ord, span_ord, x, y, text, font, font_size, parameters, error.

    ``operators`` needs the page keys, op_ord, op, nums, name, text, items. Operators outside of a text
    object show nothing; an array of strings and offsets gives a span for each string. Text shown
    before any font has the error 'text shown before font'. Rows without an operator whose ``error`` is set
    (pages that could not be read) are rows here too. ``parameters`` name the state that comes along: the
    operator that sets it and its value before. A page is one window partition: its size is
    bounded by the content of one page.
    """
    if mode not in ("default", "reset"):
        raise ValueError(f"unknown mode {mode}")
    on_page = Window.partitionBy(*page).orderBy("op_ord", "item_ord").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda v, w: F.last(v, ignorenulls=True).over(w)
    op = F.col("op")
    failed = F.when(op.isNull(), F.col("error")) if "error" in operators.columns else F.lit(None).cast("string")
    ops = operators.select(*page, "op_ord", "op", "nums", "name", "text", failed.alias("failed"), F.posexplode_outer(F.when(op == "TJ", F.col("items"))).alias("item_ord", "item"))
    ops = ops.withColumn("item_ord", F.coalesce("item_ord", F.lit(0))).withColumns({
        "text_obj_ord": F.count_if(op == "BT").over(on_page).cast("int") - 1,
        "seg": F.count_if(op == "Tm").over(on_page),
        "open": F.coalesce(last(F.when(op.isin("BT", "ET"), op), on_page) == "BT", F.lit(False)),
    })

    state = on_page
    if mode == "reset":
        ops = ops.where("open or failed is not null")
        state = Window.partitionBy(*page, "text_obj_ord").orderBy("op_ord", "item_ord").rowsBetween(Window.unboundedPreceding, 0)
    leading = F.when(op == "TL", _n(0)).when((op == "TD") & F.col("open"), -_n(1))
    spacing = {"char_spacing": _n(1), "word_spacing": _n(0)}  # the operator that also shows text sets both
    settings = {k: F.coalesce(last(F.when(op == code, _n(0)).when((op == '"') & F.col("open"), spacing.get(k, F.lit(None))), state), F.lit(low)) for k, (code, low) in parameters.items()}
    ops = ops.withColumns({
        "leading": F.coalesce(last(leading, state), F.lit(0.0)),
        "font": last(F.when(op == "Tf", F.col("name")), state),
        "font_size": last(F.when(op == "Tf", _n(0)), state),
        **settings,
    }).where("open or failed is not null")

    in_segment = Window.partitionBy(*page, "text_obj_ord", "seg").orderBy("op_ord", "item_ord").rowsBetween(Window.unboundedPreceding, 0)
    identity = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])
    ops = ops.withColumn("tm", F.coalesce(F.first(F.when(op == "Tm", F.col("nums")), ignorenulls=True).over(in_segment), identity))
    down = op.isin("T*", "'", '"')
    dx = F.when(op.isin("Td", "TD"), _n(0)).when(op == "TJ", -F.col("item.offset") / 1000)
    dy = F.when(op.isin("Td", "TD"), _n(1)).when(down, -F.col("leading"))
    ops = ops.withColumns({"dx": F.coalesce(dx, F.lit(0.0)), "dy": F.coalesce(dy, F.lit(0.0))})
    t = lambda i: F.element_at("tm", i)
    ops = ops.withColumns({
        "x": t(5) + F.sum(t(1) * F.col("dx") + t(3) * F.col("dy")).over(in_segment),
        "y": t(6) + F.sum(t(2) * F.col("dx") + t(4) * F.col("dy")).over(in_segment),
        "shown": F.when(op == "TJ", F.col("item.text")).when(op.isin("Tj", "'", '"'), F.col("text")),
    })
    # numbered in the order the segments are sorted in already, and before any Python function
    order = Window.partitionBy(*page, "text_obj_ord").orderBy("seg", "op_ord", "item_ord")
    spans = ops.where("shown is not null or failed is not null").withColumn("span_ord", F.row_number().over(order) - 1)
    known = lambda c: F.when(F.col("failed").isNull(), c)
    return spans.select(
        *page, known(F.col("text_obj_ord")).alias("text_obj_ord"), known(F.col("span_ord")).alias("span_ord"), known(F.col("x").cast("float")).alias("x"), known(F.col("y").cast("float")).alias("y"),
        scalars.text(F.col("shown")).alias("text"), scalars.latin(F.col("font")).alias("font"), F.col("font_size").cast("float").alias("font_size"),
        "leading", *parameters, F.coalesce("failed", F.when(F.col("font").isNull(), F.lit("text shown before font"))).alias("error"),
    )


def text_object_problems(operators: DataFrame, page: list[str]) -> DataFrame:
    """Text objects that never end or show text before a font: page keys, text_obj_ord, error."""
    on_page = Window.partitionBy(*page).orderBy("op_ord").rowsBetween(Window.unboundedPreceding, 0)
    ops = operators.withColumn("text_obj_ord", F.count_if(F.col("op") == "BT").over(on_page).cast("int") - 1).where("text_obj_ord >= 0")
    sums = ops.groupBy(*page, "text_obj_ord").agg(
        F.min(F.when(F.col("op") == "ET", F.col("op_ord"))).alias("end"),
        F.min(F.when(F.col("category") == "show", F.col("op_ord"))).alias("shown"),
        F.min(F.when(F.col("op") == "Tf", F.col("op_ord"))).alias("font"),
    )
    early = F.col("shown").isNotNull() & (F.col("font").isNull() | (F.col("font") > F.col("shown"))) & (F.col("end").isNull() | (F.col("shown") < F.col("end")))
    error = F.when(early, "text shown before font").when(F.col("end").isNull(), "incomplete text object")
    return sums.select(*page, "text_obj_ord", error.alias("error")).where("error is not null")


def page_text(operators: DataFrame, page: list[str]) -> DataFrame:
    """The plain text of each page in reading order: a line feed for each text object and next line.

    Pages that could not be read (rows without an operator) have null and their ``error``."""
    piece = (
        F.when(F.col("op") == "BT", F.lit("\n"))
        .when(F.col("op") == "Tj", scalars.text(F.col("text")))
        .when(F.col("op").isin("'", '"'), F.concat(F.lit("\n"), scalars.text(F.col("text"))))
    )
    piece = F.when(F.col("op") == "TJ", scalars.shown_text(F.col("items"))).otherwise(piece)
    failed = F.when(F.col("op").isNull(), F.col("error")) if "error" in operators.columns else F.lit(None).cast("string")
    rows = operators.select(*page, "op_ord", piece.alias("piece"), failed.alias("failed")).where("piece is not null or failed is not null")
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("op_ord", "piece"))))
    text = F.when(F.size(ordered) > 0, F.array_join(F.transform(ordered, lambda x: x["piece"]), ""))
    return rows.groupBy(*page).agg(text.alias("page_text"), F.max("failed").alias("error"))
