import hashlib
import json

import pandas as pd
import pytest
from support import column, minute

from tidegraph import api as A
from tidegraph.plans.graph import Executor
from tidegraph.plans.node import Node
from tidegraph.sources.files import SourceError, combined_sha256
from tidegraph.sources.inline import align_outcomes, parse_history

SCHEMA = {"time": "timestamp", "columns": {"value": "float64"}}


def frame(values, start=0):
    return pd.DataFrame({"timestamp": pd.Series([minute(start + i) for i in range(len(values))]).astype("datetime64[us]"), "value": values})


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    frame([1.0, 2.5]).assign(note=["a", "b"]).to_csv(path, index=False)
    digest = hashlib.sha256(path.read_bytes()).hexdigest()
    assert A.sha256_file(spark, str(path)) == digest
    node = Node(A.CSVSource, parameters={"path": path, "content_sha256": digest, "schema": SCHEMA})
    assert column(spark, node.value) == [1.0, 2.5]
    moved = tmp_path / "y.csv"
    moved.write_bytes(path.read_bytes())
    assert node.id == Node(A.CSVSource, parameters={"path": moved, "content_sha256": digest, "schema": SCHEMA}).id
    with pytest.raises(A.ExecutionError, match="digest"):
        column(spark, Node(A.CSVSource, parameters={"path": path, "content_sha256": "0" * 64, "schema": SCHEMA}).value)
    with pytest.raises(SourceError):
        A.CSVSource(path=str(path), content_sha256=digest, schema={"columns": {"v": {"dtype": "float64", "shape": [2]}}})


def test_parquet_folder_in_order(spark, tmp_path):
    frame([1.0, 2.0]).to_parquet(tmp_path / "a.parquet")
    frame([9.0], 1).to_parquet(tmp_path / "b.parquet")
    digest = A.sha256_source(spark, str(tmp_path))
    want = combined_sha256([(n, hashlib.sha256((tmp_path / n).read_bytes()).hexdigest()) for n in ("a.parquet", "b.parquet")])
    assert digest == want
    node = Node(A.ParquetSource, parameters={"path": tmp_path, "content_sha256": digest, "schema": SCHEMA})
    assert column(spark, node.value) == [1.0, 9.0]  # of one time, the later file's row
    wrong = Node(A.ParquetSource, parameters={"path": tmp_path, "content_sha256": digest, "schema": {"columns": {"value": "int64"}}})
    with pytest.raises(A.ExecutionError, match="not bigint"):
        column(spark, wrong.value)


def test_chunks_and_merkle_root(spark, tmp_path):
    for k in range(3):
        frame([float(k)], k).to_parquet(tmp_path / f"part-{k}.parquet")
    manifest = A.build_manifest(spark, str(tmp_path))
    assert [c["rows"] for c in manifest["chunks"]] == [1, 1, 1]
    assert manifest["chunks"][1]["sha256"] == hashlib.sha256((tmp_path / "part-1.parquet").read_bytes()).hexdigest()
    root = manifest["merkle"]["root"]
    pairs = [(c["key"], c["sha256"]) for c in manifest["chunks"]]
    assert A.merkle_root(pairs) == root != A.merkle_root(pairs[::-1]) and A.merkle_sha256_source(spark, str(tmp_path)) == root
    node = Node(A.StreamingParquetSource, parameters={"path": tmp_path, "merkle_sha256": root, "schema": SCHEMA, "verify_layout": True})
    assert column(spark, node.value) == [0, 1, 2]
    with pytest.raises(A.ExecutionError, match="digest"):
        column(spark, Node(A.StreamingParquetSource, parameters={"path": tmp_path, "merkle_sha256": "1" * 64, "schema": SCHEMA}).value)
    data = json.loads((tmp_path / "manifest.json").read_text())
    data["chunks"][0]["sha256"] = "2" * 64
    (tmp_path / "manifest.json").write_text(json.dumps(data))
    with pytest.raises(A.ExecutionError, match="root"):
        column(spark, node.value)


def test_hive_dataset_and_time_range(spark, tmp_path):
    days = pd.DataFrame({"timestamp": pd.to_datetime(["2026-01-01 10:00", "2026-01-02 23:59", "2026-01-03 00:00"]).astype("datetime64[us]"), "value": [1.0, 2.0, 3.0]})
    spark.createDataFrame(days).selectExpr("cast(timestamp as timestamp_ntz) timestamp", "value", "day(timestamp) day").write.partitionBy("day").parquet(str(tmp_path / "d"))
    node = lambda r: Node(A.DatasetSource, parameters={"path": str(tmp_path / "d"), "schema": SCHEMA, "time_range": r}).value
    assert column(spark, node(("2026-01-01", "2026-01-02"))) == [1, 2]
    assert column(spark, node((None, "2026-01-02T23:58:00"))) == [1]
    assert column(spark, node(("2026-01-03T01:00:00+01:00", None))) == [3]
    plan = Executor(spark).table({"v": node(("2026-01-01", "2026-01-02"))})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan
    with pytest.raises(SourceError):
        A.DatasetSource(path="x", schema=SCHEMA, time_range=("2026-02-01", "2026-01-01"))


def test_web_sources(spark):
    payload = {"history": [{"t": 120, "p": 0.5}, {"t": 60, "p": 0.25}]}
    assert parse_history(payload)["price"].tolist() == [0.25, 0.5]
    with pytest.raises(SourceError):
        parse_history({"no": 1})
    one = Node(A.PriceHistory, parameters={"urls": ("u",), "fetch": lambda u: payload})
    assert column(spark, one.price) == [0.25, 0.5]
    late = {"history": [{"t": 90, "p": 0.9}]}
    two = align_outcomes(spark, [parse_history(payload), parse_history(late)]).orderBy("timestamp").collect()
    assert [r["price"] for r in two] == [[0.25, None], [0.25, 0.9], [0.5, 0.9]]
    days = pd.DataFrame({"Open": ["1", "x"], "High": [2, 3], "Low": [0, 1], "Close": [1.5, 2], "Volume": [10, None]}, index=pd.to_datetime(["2026-01-02", "2026-01-01"]))
    node = Node(A.OhlcvSource, parameters={"symbol": "T", "fetch": lambda *a: days})
    assert column(spark, node.open) == [None, 1.0] and column(spark, node.volume) == [None, 10]


def test_dataset_manifest():
    m = A.DatasetManifest("0" * 64, "n", "p", {"columns": {"value": "float64"}}, rows=3)
    assert A.DatasetManifest.loads(m.dumps()) == m
    with pytest.raises(SourceError):
        A.DatasetManifest.loads('{"id": "", "name": "", "path": "", "odd": 1}')


def test_schema_language():
    s = A.FrameSignature.parse({"time": "t", "columns": {"x": "int64", "v": {"dtype": "float64", "shape": [2, 3]}}})
    assert s["v"].width == 6 and s.time.column == "t"
    for bad in ({"columns": {"x": "decimal"}}, {"columns": {"timestamp": "float64"}}, {"odd": 1}):
        with pytest.raises(ValueError):
            A.FrameSignature.parse(bad)
