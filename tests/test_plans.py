"""Properties of the physical plans that matter at scale."""

import pathlib
import re

import pytest

import __spark_entry__ as entry
from gradespark.plans import views

FOLDER = "/root/testdata/sf0.001"
PACKAGE = pathlib.Path(entry.__file__).parent / "gradespark"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_join_and_no_row_by_row_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan


def test_rank_filter_runs_before_the_shuffle(spark):
    plan = plan_of(entry.queries()["pass_at_k"](spark, FOLDER))
    assert re.search(r"Exchange hashpartitioning.*\n.*WindowGroupLimit .* Partial", plan)


@pytest.mark.parametrize("name", ["reduce_gcd", "fn_gcd_lcm", "reduce_all", "scatter_types", "scatter_floor_divide"])
def test_folds_stay_in_the_jvm(spark, name):
    assert not re.search("Python|Arrow|Pandas", plan_of(entry.queries()[name](spark, FOLDER)))


def test_limit_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(entry.queries()["tasks_sorted_limit"](spark, FOLDER))


def test_scans_read_only_what_is_used(spark):
    def read(name, table):
        plan = plan_of(entry.queries()[name](spark, FOLDER))
        found = [line for line in plan.splitlines() if f"{table}.parquet" in line]
        assert found
        return {c for line in found for c in re.findall(r"(\w+):", line.split("ReadSchema: struct<")[1].rsplit(">", 1)[0])}

    assert read("method_leaderboard", "events") == {"event_id", "user_id", "event_type"}
    assert read("pass_at_k", "orders") == {"o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"}
    assert read("bag_mean", "events") == {"user_id", "event_id"}
    assert read("reduce_gcd", "lineitem") == {"l_suppkey", "l_quantity"}


def test_one_shuffle_for_chains_and_conversations(spark):
    for name in ("chain_resolution", "run_timing"):
        assert plan_of(entry.queries()[name](spark, FOLDER)).count("Exchange ") == 1, name
    # Texts of conversations move once; what else moves are roles at the ends of ranges of turns.
    plan = plan_of(entry.queries()["chat_render"](spark, FOLDER))
    assert sum("text:" in line for line in plan.splitlines() if "ReadSchema" in line) == 1


@pytest.mark.parametrize("name", ["bag_sum", "bag_weighted", "bag_mean", "bag_quantized", "bag_half", "bag_lengths"])
def test_elements_are_combined_before_they_meet_their_vectors(spark, name):
    tree = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    vectors = next(i for i, line in enumerate(tree) if "Join LeftOuter" in line and "vec_id" in line)
    assert any(re.search(r"Aggregate \[bag_id#\d+L?, vec_id#\d+L?\]", line) for line in tree[vectors + 1 :])


def test_package_stays_within_its_rules():
    text = "\n".join(p.read_text(encoding="utf8") for p in PACKAGE.rglob("*.py"))
    for word in ("localCheckpoint", "crossJoin", ".toPandas(", ".collect()", ".sample("):
        assert word not in text, word


def test_evaluation_of_all_attempts(spark):
    folder = "/root/testdata/sf0.001"
    found = entry.queries()["dataset_eval_all"](spark, folder).collect()
    assert sum(r.total_examples for r in found) == views.attempts(spark, folder).count()
    first = entry.queries()["dataset_eval"](spark, folder).collect()
    assert sum(r.total_examples for r in first) < sum(r.total_examples for r in found)
