"""Files that arrive in two rounds are ingested once each."""

import pytest

from quireflow.plans.writing import customer_file
from quireflow.streaming.ingest import ingest


def test_arriving_files(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(customer_file(1, [(1, "Ann", "H")]))
    ingest(spark, source, out, state).awaitTermination(120)
    (tmp_path / "in" / "b.pdf").write_bytes(customer_file(2, [(2, "Bo", "H"), (3, "Cy", "I")]))
    (tmp_path / "in" / "bad.pdf").write_bytes(b"nothing")
    ingest(spark, source, out, state).awaitTermination(120)
    assert spark.read.parquet(f"{out}/documents").count() == 3
    assert spark.read.parquet(f"{out}/documents").where("error is not null").count() == 1
    assert sorted(r.text for r in spark.read.parquet(f"{out}/text_spans").where("span_ord = 0").collect()) == ["Ann", "Bo", "Cy"]
    with pytest.raises(ValueError):
        ingest(spark, source, out, state, tables=["nope"])
