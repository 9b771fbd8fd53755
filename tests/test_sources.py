"""Files in and out."""

import datetime as dt
import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from gradespark.operators import logs, matrix, metrics, tasks
from gradespark.sources import datasets, results
from gradespark.sources.logs import read_logs


def test_load_suites_by_split(spark, tmp_path):
    rows = [("HumanEval/0", "def f():", "  pass", "assert True", "f")]
    schema = datasets.HUMANEVAL_SCHEMA
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/he/split=test")
    spark.createDataFrame([("x",) * 5], schema).write.parquet(f"{tmp_path}/he/split=train")
    got = datasets.load_humaneval(spark, f"{tmp_path}/he", "test")
    assert got.columns == ["task_id", "prompt", "canonical_solution", "test", "entry_point"]
    assert [tuple(r) for r in got.collect()] == rows
    assert datasets.load_humaneval(spark, f"{tmp_path}/he").count() == 2
    (tmp_path / "mbpp.json").write_text(json.dumps({"task_id": 11, "text": "t", "code": "c", "test_list": ["a", "b"]}))
    mbpp = datasets.load_mbpp(spark, f"{tmp_path}/mbpp.json", fmt="json")
    assert mbpp.first() == Row(task_id="11", text="t", code="c", test_list=["a", "b"])
    custom = datasets.load_custom(spark, f"{tmp_path}/he", "train")
    assert custom.count() == 1 and "split" not in custom.columns


def test_generic_defaults(spark):
    raw = spark.createDataFrame([(2, "b"), (1, "a")], "id int, prompt string")
    got = tasks.normalize_generic(raw, "id").orderBy("task_id").collect()
    assert [(r.task_id, r.prompt, r.test_code, r.entry_point) for r in got] == [("generic_0", "a", [""], None), ("generic_1", "b", [""], None)]


def test_logs_to_matrix_and_back(spark, tmp_path):
    base = "HumanEval on Some-Model-3B"
    ok, bad = "✅ HumanEval tests for %s passed successfully.", "❌ SYNTAX ERROR in code for %s"
    files = {
        f"{base}.rtf": [ok % "add", "noise", ok % " add ", bad % "add", ok % "sub"],
        f"{base}\u00a0 + CHAIN.rtf": [bad % "sub", ok % "sub"],
        f"{base} + \u0421FG + CHAIN\u00a0.rtf": [r"{\fonttbl x}\f0\fs24 HumanEval tests for \u1076?\u1072? passed successfully."],
    }
    paths = []
    for name, lines in files.items():
        p = tmp_path / name
        p.write_bytes("\r\n".join(lines).encode() + b"\xff\xfe\n")
        paths.append(str(p))
    raw = read_logs(spark, [*paths, str(tmp_path / "missing.rtf")], rtf=True)
    named = raw.withColumn("method", logs.method_from_file(F.col("file")))
    verdicts = logs.parse_verdicts(named)
    last = {(r.method, r.test_name): r.passed for r in logs.last_verdicts(verdicts).collect()}
    assert last == {("BASE", "add"): 0, ("BASE", "sub"): 1, ("BASE_CHAIN", "sub"): 1, ("CFG_CHAIN", "да"): 1}
    table = spark.createDataFrame([(n.replace("\u00a0", " ").replace("\u0421", "C"), str(i)) for i, n in enumerate(files)], "file string, method string")
    assert {r.method for r in logs.attach_method(raw, table).select("method").distinct().collect()} == {"0", "1", "2"}
    tests = spark.createDataFrame([(1, "add"), (2, "sub"), (3, "add"), (4, "other")], "test_id bigint, test_name string")
    wide = matrix.verdict_matrix(tests, verdicts)
    results.write_csv(wide.select("test_name", "test_id", *logs.METHODS), f"{tmp_path}/matrix.csv")
    again = results.read_matrix(spark, f"{tmp_path}/matrix.csv")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, wide.select("test_name", "test_id", *logs.METHODS).collect()))
    long = logs.attach_test_ids(verdicts).select("test_name", "method", "passed", "test_id")
    results.write_csv(long, f"{tmp_path}/long.csv")
    assert sorted(map(tuple, results.read_long(spark, f"{tmp_path}/long.csv").collect())) == sorted(map(tuple, long.collect()))
    totals = {r.method: r.passed for r in matrix.method_totals(wide).collect()}
    board = {r.method: r.passed for r in matrix.leaderboard(tests, verdicts).collect()}
    assert totals == board and board["BASE"] == 1 and board["AST"] == 0


def test_no_log_files(spark, tmp_path):
    assert read_logs(spark, [str(tmp_path / "none.txt")]).count() == 0


def test_results_round_trip(spark, tmp_path):
    config = (3, {"top_k": "1"}, None)
    rows = [
        ("humaneval", 50.0, 82, 164, dt.datetime(2025, 1, 1), config),
        ("humaneval", 75.0, 123, 164, dt.datetime(2025, 2, 1), config),
        ("mbpp", 10.0, 1, 10, dt.datetime(2025, 1, 5), config),
    ]
    runs = spark.createDataFrame(rows, "benchmark string, pass_rate double, passed_examples bigint, total_examples bigint, timestamp timestamp_ntz, config struct<iterations:int,generation_config:map<string,string>,limit:bigint>")
    latest = metrics.latest_runs(runs)
    assert {(r.benchmark, r.pass_rate) for r in latest.collect()} == {("humaneval", 75.0), ("mbpp", 10.0)}
    results.save_results(latest, f"{tmp_path}/r", {"model": "м"})
    back = results.load_results(spark, f"{tmp_path}/r")
    assert back.first().metadata == {"model": "м"}
    assert {(r.benchmark, r.passed_examples, r.timestamp, r.config.generation_config["top_k"]) for r in results.runs_of(back).collect()} == {
        ("humaneval", 123, dt.datetime(2025, 2, 1), "1"), ("mbpp", 1, dt.datetime(2025, 1, 5), "1")}
    (tmp_path / "empty.json").write_text("{}")
    empty = results.load_results(spark, f"{tmp_path}/empty.json").first()
    assert empty.metadata == {} and empty.benchmark_results == {}


def test_detailed_run(spark, tmp_path):
    summary = spark.createDataFrame([(2, 1, 50.0)], "total_examples int, passed_examples int, pass_rate double")
    config = spark.createDataFrame([(3, 1.5)], "iterations int, total_time double")
    verdicts = spark.createDataFrame([("a", True), ("b", False)], "task_id string, passed boolean")
    results.save_detailed_run(summary, config, verdicts, str(tmp_path / "run"))
    doc = spark.read.json(f"{tmp_path}/run/summary").first()
    assert doc.summary.pass_rate == 50.0 and doc.benchmark_config.iterations == 3
    assert spark.read.json(f"{tmp_path}/run/detailed_results").count() == 2
