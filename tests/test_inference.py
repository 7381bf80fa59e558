"""Runs in parts that break off, go on, or meet what another run has left."""

import pytest
from pyspark.sql import functions as F

from ravelin import sources
from ravelin.operators import inference as inf

PASS = {"model": "m1", "verdict": "PASS"}


def corpus(spark, n=40):
    return spark.createDataFrame([(i, None if i % 13 == 0 else f"text {i % 9}") for i in range(n)], "row_id long, text string")


class Breaks:
    """A model that fails at its n-th part and counts the parts that it got."""

    def __init__(self, at=None):
        self.at, self.seen = at, 0

    def __call__(self, rows):
        self.seen += 1
        if self.seen == self.at:
            raise RuntimeError("the machine is gone")
        return inf.stub_labels(rows)


def test_a_run_goes_on_where_it_broke_off(spark, tmp_path):
    rows, folder = corpus(spark), f"file://{tmp_path}/run"
    first = Breaks(at=3)
    with pytest.raises(RuntimeError, match="gone"):
        inf.infer_in_parts(rows, first, folder, "m1", rows_a_part=10, report=PASS)
    again = Breaks()
    labels, facts = inf.infer_in_parts(rows.repartition(7), again, folder, "m1", rows_a_part=10, report=PASS)
    assert first.seen == 3 and again.seen == 2 and facts["parts"] == 4 and facts["parts_made"] == 2 and facts["gate"] == "PASS"
    want = {r["row_id"]: r["label"] for r in inf.stub_labels(rows).collect()}
    assert {r["row_id"]: r["label"] for r in labels.collect()} == want and labels.count() == 40
    assert {r["label_source"] for r in labels.collect()} == {"model"}
    inf.require_reportable(labels)
    third = Breaks(at=1)
    assert inf.infer_in_parts(rows, third, folder, "m1", rows_a_part=10, report=PASS)[1]["parts_made"] == 0 and third.seen == 0


def test_a_half_written_part_is_made_again(spark, tmp_path):
    rows, folder = corpus(spark), f"file://{tmp_path}/run"
    inf.infer_in_parts(rows, inf.stub_labels, folder, "m1", rows_a_part=10, report=PASS)
    sources.remove(spark, f"{folder}/done/000001.json")
    spark.createDataFrame([(99, "self", 1.0)], "row_id long, label string, p double").write.mode("overwrite").parquet(f"{folder}/parts/part=1")
    labels, facts = inf.infer_in_parts(rows, inf.stub_labels, folder, "m1", rows_a_part=10, report=PASS)
    assert facts["parts_made"] == 1 and labels.count() == 40


def test_another_run_is_not_mixed_in(spark, tmp_path):
    rows, folder = corpus(spark), f"file://{tmp_path}/run"
    inf.infer_in_parts(rows, inf.stub_labels, folder, "m1", rows_a_part=10, report=PASS)
    for other in ({"model": "m2", "report": {"model": "m2", "verdict": "PASS"}}, {"model": "m1", "report": PASS, "rows_a_part": 20}):
        with pytest.raises(sources.Stale):
            inf.infer_in_parts(rows, inf.stub_labels, folder, **({"rows_a_part": 10} | other))
    changed = rows.withColumn("text", F.when(F.col("row_id") == 5, "else").otherwise(F.col("text")))
    with pytest.raises(sources.Stale, match="hash"):
        inf.infer_in_parts(changed, inf.stub_labels, folder, "m1", rows_a_part=10, report=PASS)
    assert inf.infer_in_parts(changed, inf.stub_labels, folder, "m1", rows_a_part=10, report=PASS, force=True)[1]["parts_made"] == 4


def test_rows_in_are_rows_out(spark, tmp_path):
    rows = corpus(spark)
    for n, infer in enumerate((lambda r: inf.stub_labels(r).filter("row_id <> 7"), lambda r: inf.stub_labels(r).union(inf.stub_labels(r).filter("row_id = 7")))):
        with pytest.raises(ValueError, match="went in"):
            inf.infer_in_parts(rows, infer, f"file://{tmp_path}/{n}", "m1", report=PASS)
    labels, facts = inf.infer_in_parts(rows.limit(0), inf.stub_labels, f"file://{tmp_path}/empty", "m1", report=PASS)
    assert labels.count() == 0 and facts["rows"] == 0


def test_gates(spark, tmp_path):
    assert inf.require_gate(None, "m", "stub") == "NONE" and inf.require_gate(PASS, "m1", "model") == "PASS"
    for report, error in ((None, FileNotFoundError), ({"model": "m2", "verdict": "PASS"}, sources.Stale), ({"model": "m1", "verdict": "INCOMPLETE"}, ValueError)):
        with pytest.raises(error):
            inf.require_gate(report, "m1", "model")
    stub, _ = inf.infer_in_parts(corpus(spark), inf.stub_labels, f"file://{tmp_path}/s", "stub", "stub")
    with pytest.raises(ValueError, match="stub"):
        inf.require_reportable(stub)


def test_shares_and_season(spark):
    df = spark.createDataFrame([("gift_given", 12), ("gift_given", 7), ("received", 12), ("self", 7), ("self", 7)], "label string, month int")
    got = {(r["kind"], r["name"]): (r["n"], r["pct"]) for r in inf.label_shares(df).collect()}
    assert got == {("label", "gift_given"): (2, 40.0), ("label", "received"): (1, 20.0), ("label", "self"): (2, 40.0), ("set", "narrow"): (2, 40.0), ("set", "broad"): (3, 60.0)}
    season = {r["axis"]: r["ratio"] for r in inf.season_signature(df, F.col("month"), [12], [7]).collect()}
    assert season == {"narrow": pytest.approx(1.5), "broad": pytest.approx(3.0)}


def test_outputs_know_what_they_are_made_from(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    assert sources.write_made(spark.range(3), path, {"code": "a", "rows": 3})
    assert not sources.write_made(spark.range(99), path, {"rows": 3, "code": "a"}) and spark.read.parquet(path).count() == 3
    with pytest.raises(sources.Stale, match="code"):
        sources.write_made(spark.range(4), path, {"code": "b", "rows": 3})
    assert sources.write_made(spark.range(4), path, {"code": "b", "rows": 3}, force=True) and spark.read.parquet(path).count() == 4
    spark.range(1).write.parquet(f"{path}2")  # made by nobody knows what, or broken off
    with pytest.raises(sources.Stale):
        sources.write_made(spark.range(4), f"{path}2", {"code": "b"})
