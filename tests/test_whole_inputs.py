"""Large files, hot values, repeated answers and samples without windows."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from cohortry.operators import features as ft
from cohortry.operators.contracts import ContractError
from cohortry.operators.ordered import row_number
from cohortry.sources.readers import file_inventory
from cohortry.streaming.scoring import append_decisions


def test_files_are_streamed_beyond_the_bound(spark, tmp_path):
    bodies = {"a b.txt": b"x" * 10, "q%20%c3=1": b"abc" * 5000, "utf-é": os.urandom(100_000)}
    (tmp_path / "deep").mkdir()
    for name, body in bodies.items():
        (tmp_path / "deep" / name).write_bytes(body)
    want = {(len(b), hashlib.sha256(b).hexdigest()) for b in bodies.values()}
    for bound in (-1, 10, 1 << 20):
        found = file_inventory(spark, str(tmp_path), whole_bytes=bound).collect()
        assert {(r.bytes, r.sha256) for r in found} == want and len(found) == len(bodies)


def test_file_over_the_limit_of_one_array(spark, tmp_path):
    path = tmp_path / "large"
    with open(path, "wb") as f:
        f.truncate((2 << 30) + (1 << 28))
        f.seek(-3, os.SEEK_END)
        f.write(b"end")
    with open(path, "rb") as f:
        want = hashlib.file_digest(f, "sha256").hexdigest()
    (row,) = file_inventory(spark, str(tmp_path)).collect()
    assert (row.bytes, row.sha256) == ((2 << 30) + (1 << 28), want)


def test_hot_value_is_numbered_by_many_tasks(spark, monkeypatch):
    from cohortry.operators import ordered

    rows = [(k, 1.0 if i % 3 else float(i), f"u{i:04d}", i % 7) for k in ("a", None) for i in range(600)]
    rows += [("a", None, "u", 0), ("a", float("nan"), "v", 0), ("b", 1.0, "w", 0), ("b", 1.0, "w", 0)]
    df = spark.createDataFrame(rows, "k string, v double, u string, other int").repartition(5)
    plain = row_number(df, ["k"], "v", ["u"]).collect()
    monkeypatch.setattr(ordered, "TASK_ROWS", 50)
    cut = row_number(df, ["k"], "v", ["u"])
    assert sorted(map(str, cut.collect())) == sorted(map(str, plain))
    assert {r.rn for r in plain if r.k == "b"} == {1, 2}
    assert [r.u for r in sorted((r for r in plain if r.k == "a"), key=lambda r: r.rn)][::601] == ["u", "v"]
    assert row_number(df.where("false"), ["k"], "v", ["u"]).collect() == []


def test_repeated_answers_count_once(spark, tmp_path):
    source, sink, memory = (str(tmp_path / n) for n in ("in", "out", "memory"))
    os.mkdir(source)
    arrivals = [
        [("a", 0.1), ("b", 0.9), ("b", 0.9)],
        [("a", 0.8), ("c", 0.5), (None, 0.2)],
        [("c", 0.1), (None, 0.7)],
        [],
    ]
    for i, arrival in enumerate(arrivals):
        with open(f"{source}/{i}.json", "w") as f:
            for name, score in arrival:
                f.write(json.dumps({"sample_id": name, "content": json.dumps({"risk_score": score})}) + "\n")
        append_decisions(spark, source, sink, memory)
    got = spark.read.parquet(sink).collect()
    first = {r.sample_id: r.risk_score for r in got}
    assert len(got) == 4 and set(first) == {"a", "b", "c", None}
    alone = {}
    for name, score in [("a", 0.1), ("b", 0.9), ("c", 0.5), (None, 0.2)]:
        from cohortry.streaming.scoring import decide_stream

        one = spark.createDataFrame([(name, json.dumps({"risk_score": score}))], "sample_id string, content string")
        alone[name] = decide_stream(one).first().risk_score
    assert first == alone


def test_samples_without_windows(spark):
    rows = [("x", "ACDE"), ("x", "A-CD,É"), ("y", "AC"), ("y", "1234"), ("z", "ACD")]
    seqs = spark.createDataFrame(rows, "sample_id string, seq string")
    qc = {r.sample_id: (r.eligible, r.valid_windows, r.invalid_windows) for r in ft.repertoire_qc(seqs).collect()}
    assert qc == {"x": (2, 2, 4), "y": (1, 0, 2), "z": (0, 0, 0)}
    assert {r.key for r in ft.without_windows(seqs).collect()} == {"y", "z"}
    assert {r.sample_id for r in ft.triplet_frequencies(seqs).collect()} == {"x"}
    with pytest.raises(ContractError, match="no_valid_window"):
        ft.triplet_frequencies(seqs, strict=True)
    shares = ft.triplet_frequencies(seqs.where("sample_id = 'x'"), strict=True).agg(F.sum("frequency")).first()[0]
    assert shares == pytest.approx(1.0)
