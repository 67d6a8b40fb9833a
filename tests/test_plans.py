"""What the plans must look like: one shuffle where one suffices, every stream read once, nothing crossed."""

import re

import pytest

import __spark_entry__ as entry
from quireflow.operators import hierarchy, textstate
from quireflow.plans.writing import customer_file
from quireflow.session import table
from quireflow.sources.pdf import PAGE, Corpus

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_spans_take_one_shuffle_and_read_once(spark):
    files = spark.createDataFrame([("a", customer_file(1, [(1, "A", "H")]))], "path string, content binary")
    text = plan(Corpus(files).text_spans())
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    # the file to operators at once, and the decoding of strings
    assert (len(re.findall("MapInArrow", text)), len(re.findall("ArrowEvalPython", text))) == (1, 1)
    ops = Corpus(files).operators().where("path = 'a'")
    assert (len(re.findall("MapInArrow", plan(ops))), len(re.findall("ArrowEvalPython", plan(ops)))) == (1, 0)
    assert len(re.findall(r"Exchange", plan(textstate.text_spans(ops, PAGE)))) == 1


def test_path_filters_pass_the_python_functions(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(customer_file(1, [(3, "A", "H")]))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    text = plan(Corpus(files).where("path = 'x'").pages())
    assert text.index("MapInArrow") < text.index("Filter (") < text.index("FileScan binaryFile")


@pytest.mark.parametrize("name", ["p1_found", "p1_report", "p3_found", "p5_found", "xref_latest", "resolve_items", "text_positions"])
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_timestamps_are_parsed_once(spark):
    text = plan(entry.queries()["p5_found"](spark, DATA))
    assert len(text) < 60_000 and text.count("ArrowEvalPython") == 0


def test_columns_are_pruned(spark):
    text = plan(hierarchy._nodes(table(spark, DATA, "page_nodes")))
    schema = re.search(r"ReadSchema: (\S+)", text)[1]
    assert "media_box" not in schema and "rotate" not in schema and "received_at" not in schema
