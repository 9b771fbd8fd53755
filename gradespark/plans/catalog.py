"""The registered queries: each reads the whole of its tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradespark.durable import ensure_checkpoint_dir
from gradespark.functions import bits, rtf, text
from gradespark.functions import numeric as num
from gradespark.functions import strings as strs
from gradespark.operators import (
    attempts, bags, chat, configs, linalg, logs, matrix, metrics, reduce, scatter, suites, tasks,
)
from gradespark.operators.ordering import with_group_position, with_running_sum
from gradespark.plans import views
from gradespark.sources import datasets, results
from gradespark.sources.logs import read_logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _verdicts(spark, folder, grammar="runtime"):
    return logs.parse_verdicts(views.log(spark, folder), grammar).drop("line")


def _matrix(spark, folder):
    return matrix.verdict_matrix(views.tests_dim(spark, folder), _verdicts(spark, folder))


@query
def method_leaderboard(spark, folder):
    return matrix.leaderboard(views.tests_dim(spark, folder), _verdicts(spark, folder))


@query
def log_verdicts_long(spark, folder):
    return logs.attach_test_ids(_verdicts(spark, folder, "syntax"))


@query
def log_verdicts_full(spark, folder):
    return _verdicts(spark, folder, "full")


@query
def log_lines(spark, folder):
    """Each document as a log file, line by line."""
    return logs.log_lines(views.documents(spark, folder).select("doc_id", "text"))


@query
def log_tests_sketched(spark, folder):
    """Distinct tests of each method, exactly and from sketches by method and file that are united afterwards."""
    lines = views.log(spark, folder).withColumn("file", F.col("line_no") % 4)
    verdicts = logs.parse_verdicts(lines)
    exact = verdicts.groupBy("method").agg(F.count_distinct("test_name").alias("tests"))
    kept = logs.test_sketches(verdicts, "method", "file")
    near = F.abs(F.col("approx_tests") - F.col("tests")) <= F.greatest(F.lit(1.0), 5 * logs.SKETCH_ERROR * F.col("tests"))
    return exact.join(logs.distinct_from_sketches(kept, "method"), "method").select("method", "tests", near.alias("within_bound"))


@query
def log_methods(spark, folder):
    """Log lines named by file, through the method table and by the naming rule."""
    names = F.replace(F.replace(F.col("method"), F.lit("_"), F.lit(" + ")), F.lit("BASE"), F.lit(""))
    blank = F.when(F.col("line_no") % 2 == 0, F.lit("\u00a0")).otherwise(F.lit(" "))
    suffix = F.when(F.ltrim(names).startswith("+"), F.concat(blank, F.ltrim(names))).when(
        names != "", F.concat(blank, F.lit("+ "), names)
    ).otherwise("")
    file = F.concat(F.lit("runs/HumanEval on Some-Model"), suffix, F.lit(".rtf"))
    lines = views.log(spark, folder).withColumn("file", file).drop("method")
    known = {f"HumanEval on Some-Model{_tail(m)}.rtf": m for m in logs.METHODS}
    table = logs.method_table(spark, known)
    # Labels are worked out for each file, not for each line.
    by_rule = lines.select("file").distinct().withColumn("by_rule", logs.method_from_file(F.col("file")))
    return logs.attach_method(lines.join(by_rule, "file"), table).groupBy("method", "by_rule").agg(F.count("*").alias("lines"))


def _tail(method: str) -> str:
    parts = [p for p in method.split("_") if p != "BASE"]
    return "".join(f" + {p}" for p in parts)


@query
def log_round_trip(spark, folder):
    """Verdicts written as log lines and parsed again."""
    rows = views.attempts(spark, folder).select(
        F.col("attempt.o_orderkey").alias("line_no"),
        logs.emit_line(F.col("task_id"), F.col("ok"), F.col("error"), F.lit("no match")).alias("line"),
    )
    return logs.parse_verdicts(rows, "full").drop("line")


@query
def method_stats_long(spark, folder):
    return logs.method_stats(_verdicts(spark, folder))


@query
def verdict_matrix(spark, folder):
    return _matrix(spark, folder)


@query
def heatmap_rows(spark, folder):
    return matrix.heatmap_rows(_matrix(spark, folder))


@query
def base_vs_chain(spark, folder):
    return matrix.base_vs_chain(matrix.method_totals(_matrix(spark, folder)))


# --- tasks and prompts -------------------------------------------------------


@query
def tasks_normalized(spark, folder):
    tasks_ = tasks.preprocess(views.tasks_raw(spark, folder), "humaneval")
    return tasks.with_example_index(tasks_)


@query
def mbpp_normalized(spark, folder):
    return tasks.normalize_mbpp(views.mbpp_raw(spark, folder)).drop("entry_point")


@query
def custom_split(spark, folder):
    """A suite with unknown columns, all splits kept apart."""
    raw = views.table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("prompt"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("test_code"),
        F.when(F.col("p_size") > 25, "test").otherwise("train").alias("split"),
    )
    return tasks.normalize_generic(datasets.only_split(raw, "test"), "id").select("task_id", "prompt", "test_code")


@query
def tasks_sorted_limit(spark, folder):
    return tasks.sort_and_limit(tasks.normalize_humaneval(views.tasks_raw(spark, folder)), 50).select(
        "task_id", "prompt", "entry_point"
    )


@query
def task_lookup(spark, folder):
    requests = views.table(spark, folder, "orders").select(
        F.concat(F.lit("HumanEval/"), F.col("o_orderkey").cast("string")).alias("task_id")
    )
    found = tasks.lookup_tasks(requests, views.tasks_raw(spark, folder))
    return found.select("task_id", tasks.single_prompt(F.col("prompt")).alias("prompt"), "error")


@query
def prompts_full_run(spark, folder):
    return views.tasks_raw(spark, folder).select("task_id", tasks.run_prompt(F.col("prompt")).alias("prompt"))


@query
def repair_prompts(spark, folder):
    failed = views.attempts(spark, folder).where(~F.col("ok") & F.col("produced"))
    return failed.join(views.tasks_raw(spark, folder).select("task_id", "prompt"), "task_id", "left").select(
        "task_id", F.col("attempt.o_orderkey").alias("o_orderkey"),
        tasks.repair_prompt(tasks.run_prompt(F.col("prompt")), F.col("code"), F.col("error")).alias("prompt"),
    )


# --- completions -------------------------------------------------------------


@query
def clean_completions(spark, folder):
    return views.completions(spark, folder).select("doc_id", text.clean_completion(F.col("code")).alias("code"))


@query
def extract_functions(spark, folder):
    """Prompt and completion joined; a third of the prompts is empty, a third ends in an escaped line feed."""
    doc = F.col("doc_id")
    said = F.concat(F.lit("# document "), doc.cast("string"), F.when(doc % 3 == 1, "\\n").otherwise("\n"))
    rows = views.completions(spark, folder).select(
        "doc_id", F.when(doc % 3 == 0, "").otherwise(said).alias("prompt"), F.col("code").alias("completion"),
        F.when(F.col("doc_id") % 10 == 9, "generation failed").alias("error"),
    )
    return tasks.testable_code(rows).select("doc_id", "code", "error")


@query
def special_token_scrub(spark, folder):
    code = F.col("code")
    return views.completions(spark, folder).select(
        "doc_id", text.drop_special_tokens(code).alias("code"),
        text.count_token(code, "<|im_end|>").cast("bigint").alias("ends"),
        text.count_token(code, "<tool_call>").cast("bigint").alias("tool_calls"),
    )


@query
def termination_ratio(spark, folder):
    return metrics.termination(views.completions(spark, folder), "source")


def _rtf_units(escaped):
    """Characters beyond ASCII as RTF writes them."""
    return F.array_join(
        F.transform(
            F.split(escaped, ""),
            lambda c: F.when(
                (F.ascii(c) > 127) & (F.ascii(c) < 32768),
                F.concat(F.lit("\\u"), F.ascii(c).cast("string"), F.lit("?")),
            ).otherwise(c),
        ),
        "",
    )


@query
def rtf_clean(spark, folder):
    """documents written as RTF, then read back."""
    escaped = F.replace(F.translate("text", "{}\\", "   "), F.lit("\n"), F.lit("\\par \n"))
    units = _rtf_units(escaped)
    written = F.concat(F.lit("{\\rtf1{\\fonttbl f0}\\fs24 "), units, F.lit("}"))
    return views.documents(spark, folder).select("doc_id", rtf.rtf_to_text(written).alias("text"))


# --- conversations -----------------------------------------------------------


@query
def chat_render(spark, folder):
    return chat.render(views.table(spark, folder, "conversations"), generation_prompt=True)


@query
def chat_render_tools(spark, folder):
    tools = F.array(F.lit('{"name": "fn_1"}'), F.lit('{"name": "next"}'))
    return chat.render(views.tool_messages(spark, folder), tools=tools)


# --- attempts and scores -----------------------------------------------------


@query
def chain_resolution(spark, folder):
    return attempts.resolve_chains(views.attempts(spark, folder))


@query
def pass_at_k(spark, folder):
    return attempts.pass_at_k(views.attempts(spark, folder))


@query
def dataset_eval(spark, folder):
    first = views.attempts(spark, folder).groupBy("task_id", "method").agg(
        F.min_by("ok", "attempt").alias("passed")
    )
    tests = views.tasks_raw(spark, folder).select("task_id", "test")
    matched = attempts.match_tests(first, tests, "task_id")
    return attempts.evaluate(matched.withColumn("passed", F.col("passed") & F.col("test").isNotNull()), "method")


@query
def dataset_eval_all(spark, folder):
    """Every attempt of a task and method counts; ``dataset_eval`` takes the first one."""
    verdicts = views.attempts(spark, folder).select("task_id", "method", F.col("ok").alias("passed"))
    tests = views.tasks_raw(spark, folder).select("task_id", "test")
    matched = attempts.match_tests(verdicts, tests, "task_id")
    return attempts.evaluate(matched.withColumn("passed", F.col("passed") & F.col("test").isNotNull()), "method")


def _runs(spark, folder):
    """A run per method and month."""
    month = F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz")
    counted = (
        views.table(spark, folder, "orders")
        .withColumn("benchmark", views.method_of("o_orderkey"))
        .groupBy("benchmark", month.alias("month"))
        .agg(
            F.count_if(F.col("o_orderstatus") == "F").alias("passed_examples"),
            F.count("*").alias("total_examples"),
            F.max("o_orderdate").alias("timestamp"),
        )
    )
    share = F.col("passed_examples").cast("double") / F.col("total_examples") * 100
    return counted.withColumn("pass_rate", share)


def _config():
    return F.struct(
        F.lit(3).alias("iterations"), F.create_map(F.lit("top_k"), F.lit("40")).alias("generation_config"),
        F.lit(None).cast("bigint").alias("limit"),
    )


@query
def run_summary(spark, folder):
    return metrics.report(metrics.latest_runs(_runs(spark, folder).drop("month")))


@query
def run_documents(spark, folder):
    """Result documents of each month as JSON text, read back into runs."""
    documents = results.to_documents(_runs(spark, folder).withColumn("config", _config()), {"model": "m"}, ["month"])
    written = documents.select("month", F.to_json(F.struct("metadata", "benchmark_results")).alias("document"))
    runs = results.runs_of(results.parse_results(written))
    return runs.select(
        "month", "benchmark", "passed_examples", "total_examples", "timestamp", "pass_rate",
        F.col("config.iterations").alias("iterations"), F.col("config.generation_config")["top_k"].alias("top_k"),
    )


@query
def example_results(spark, folder):
    """Every attempt as an example of its evaluation; some tasks have no name."""
    number = F.col("attempt.o_orderkey")
    rows = views.attempts(spark, folder).select(
        number.alias("example_index"), "method", F.when(number % 7 != 3, F.col("task_id")).alias("task_id"), F.when(number % 5 != 0, F.col("ok")).alias("passed"),
    )
    return attempts.example_results(rows, "method")


@query
def run_timing(spark, folder):
    rows = views.table(spark, folder, "orders").withColumn("method", views.method_of("o_orderkey"))
    timed = metrics.run_timing(rows, "method", seconds="o_totalprice")
    return timed.select(
        "method", F.round("total_time", 2).alias("total_time"),
        F.round("avg_time_per_problem", 4).alias("avg_time_per_problem"),
    )


@query
def run_config_normalized(spark, folder):
    """Settings from customer; the greedy form for every second market segment."""
    config = F.create_map(
        F.lit("temperature"), F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("string")),
        F.lit("top_k"), F.col("c_nationkey").cast("string"),
        F.lit("pad_token_id"), F.lit(None).cast("string"),
        F.when(F.col("c_nationkey") % 2 == 0, "num_beams").otherwise("seed"), F.lit("5"),
    )
    chosen = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), configs.greedy_config(config)).otherwise(config)
    return views.table(spark, folder, "customer").select(
        "c_custkey", F.explode(configs.effective_config(chosen, F.length("c_name"))).alias("setting", "value")
    )


@query
def bleu_pairs(spark, folder):
    # Some pairs have no candidate, some name a reference that is not there.
    number = F.col("pair_id")
    pairs = views.pairs(spark, folder).withColumn("candidate", F.when(number % 60 != 59, F.col("candidate")))
    pairs = pairs.withColumn("reference_id", F.when(number % 50 == 49, -1).otherwise(F.col("reference_id")))
    scores = metrics.bleu(pairs, views.references(spark, folder))
    return scores.select("pair_id", F.round("bleu", 9).alias("bleu"))


@query
def exact_match(spark, folder):
    rows = views.pairs(spark, folder).join(views.references(spark, folder), "reference_id")
    spaced = F.concat(F.lit(" \t"), F.col("candidate"), F.lit("\n"))
    return (
        rows.withColumn("exact_match", metrics.exact_match(F.col("reference"), F.col("candidate")))
        .withColumn("spaced_match", metrics.exact_match(spaced, F.col("candidate")))
        .groupBy("source")
        .agg(F.count("*").alias("pairs"), F.avg("exact_match").alias("exact_match"), F.avg("spaced_match").alias("spaced_match"))
    )


# --- files ---------------------------------------------------------------------


def _new_folder(spark) -> str:
    """A new folder in the one that the session shares with its executors."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/files-{uuid.uuid4().hex}"


@query
def matrix_files(spark, folder):
    """The verdict matrix and the long table as CSV files, and from there the totals of both."""
    path = _new_folder(spark)
    results.write_csv(_matrix(spark, folder).select("test_name", "test_id", *logs.METHODS), f"{path}/matrix")
    results.write_csv(logs.attach_test_ids(_verdicts(spark, folder)).select("test_name", "method", "passed", "test_id"), f"{path}/long")
    totals = matrix.method_totals(results.read_matrix(spark, f"{path}/matrix"))
    lines = results.read_long(spark, f"{path}/long").groupBy("method").agg(F.count("*").alias("lines"))
    return totals.join(lines, "method", "left").select("method", "passed", "lines")


@query
def log_files(spark, folder):
    """The log of each method as an RTF file, all of them read in one go, and the last verdicts."""
    path = _new_folder(spark)
    line = F.concat(F.lit("\\f0\\fs24 "), _rtf_units(F.col("line")))
    views.log(spark, folder).select("method", line.alias("value")).write.partitionBy("method").text(path)
    raw = read_logs(spark, [f"{path}/method={m}" for m in [*logs.METHODS, "MISSING"]], rtf=True)
    verdicts = logs.parse_verdicts(raw.withColumn("method", F.lit("any")), "runtime")
    return verdicts.groupBy("test_name", "passed").agg(F.count("*").alias("lines"))


@query
def suite_files(spark, folder):
    """Task suites written by split, one split of each read back."""
    path, test = _new_folder(spark), F.when(F.col("number") % 4 == 0, "test").otherwise("train").alias("split")
    number = F.regexp_extract("prompt", r"fn_(\d+)", 1).cast("bigint").alias("number")
    views.tasks_raw(spark, folder).select("*", number).select("*", test).drop("number").write.partitionBy("split").parquet(f"{path}/humaneval")
    views.mbpp_raw(spark, folder).withColumnRenamed("id", "number").select("*", test).drop("number").write.partitionBy("split").json(f"{path}/mbpp")
    first = datasets.load_humaneval(spark, f"{path}/humaneval", "test").select(F.lit("humaneval").alias("suite"), "task_id", "prompt", F.array("test").alias("tests"))
    second = datasets.load_mbpp(spark, f"{path}/mbpp", "test", "json").select(F.lit("mbpp").alias("suite"), "task_id", F.col("text").alias("prompt"), F.col("test_list").alias("tests"))
    third = datasets.load_custom(spark, f"{path}/humaneval").groupBy("split").agg(F.count("*").alias("n"))
    third = third.select(F.lit("custom").alias("suite"), F.col("split").alias("task_id"), F.col("n").cast("string").alias("prompt"), F.array().cast("array<string>").alias("tests"))
    return first.unionByName(second).unionByName(third)


@query
def run_files(spark, folder):
    """A detailed run, and a result document of each benchmark and month, as files that are read back."""
    path = _new_folder(spark)
    verdicts = views.attempts(spark, folder).select("task_id", "method", "ok")
    summary = verdicts.agg(F.count("*").alias("total_examples"), F.count_if("ok").alias("passed_examples"))
    config = spark.range(1).select(F.lit(3).alias("iterations"), F.lit(None).cast("bigint").alias("limit"))
    results.save_detailed_run(summary, config, verdicts, path)
    detail = spark.read.schema("task_id string, method string, ok boolean").json(f"{path}/detailed_results")
    whole = spark.read.schema("summary struct<total_examples:bigint,passed_examples:bigint>, benchmark_config struct<iterations:int>").json(f"{path}/summary")
    counts = detail.groupBy("method").agg(F.count("*").alias("total_examples"), F.count_if("ok").alias("passed_examples"))
    results.save_results(_runs(spark, folder).withColumn("config", _config()), f"{path}/results", {"model": "m"})
    runs = results.runs_of(results.load_results(spark, f"{path}/results"))
    name = F.concat_ws(" ", "benchmark", F.date_format("timestamp", "yyyy-MM"), F.col("config.generation_config")["top_k"], F.round("pass_rate", 3).cast("string"))
    saved = runs.select(name.alias("method"), "total_examples", "passed_examples")
    return counts.unionByName(whole.select(F.lit("all").alias("method"), "summary.total_examples", "summary.passed_examples")).unionByName(saved)


# --- embedding bags ----------------------------------------------------------

DIM = 64


def _long(pooled, places=4):
    rounded = F.transform("pooled", lambda x: F.round(x, places))
    return pooled.select("bag_id", F.posexplode(rounded).alias("d", "x"))


@query
def bag_sum(spark, folder):
    listed = views.table(spark, folder, "customer").select(F.col("c_custkey").alias("bag_id"))
    return _long(bags.embedding_bag(views.bags(spark, folder), views.embeddings(spark, folder), DIM, bags=listed))


@query
def bag_weighted(spark, folder):
    elements = views.bags(spark, folder)
    return _long(bags.embedding_bag(elements, views.embeddings(spark, folder), DIM, weight=F.col("weight")))


@query
def bag_positional(spark, folder):
    elements = with_group_position(views.bags(spark, folder).drop("weight"), ["bag_id"], "element")
    weights = views.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pos"), (F.col("o_totalprice") / 100000).alias("weight")
    )
    weighted = bags.positional_weights(elements, weights)
    return _long(bags.embedding_bag(weighted, views.embeddings(spark, folder), DIM, weight=F.col("weight")))


@query
def bag_mean(spark, folder):
    return _long(bags.embedding_bag(views.bags(spark, folder), views.embeddings(spark, folder), DIM, mean=True))


@query
def bag_quantized(spark, folder):
    elements, codes = views.bags(spark, folder), views.quantized(spark, folder)
    return _long(bags.quantized_bag(elements, codes, DIM, weight=F.col("weight")))


def _decoded(rows, decode):
    return rows.select("vec_id", F.transform("bits", decode).alias("embedding"))


@query
def bag_half(spark, folder):
    rows = _decoded(views.half_rows(spark, folder), bits.decode_half)
    return _long(bags.embedding_bag(views.bags(spark, folder), rows, DIM))


@query
def bag_bfloat16(spark, folder):
    rows = _decoded(views.bfloat16_rows(spark, folder), bits.decode_bfloat16)
    return _long(bags.embedding_bag(views.bags(spark, folder), rows, DIM))


@query
def bag_lengths(spark, folder):
    ranges = bags.ranges_from_lengths(views.bag_lengths(spark, folder))
    elements = bags.bag_elements(ranges, views.flat_ids(spark, folder))
    return _long(bags.embedding_bag(elements, views.embeddings(spark, folder), DIM))


@query
def bag_offsets(spark, folder):
    """Offsets from 100 on, with a closing entry; ids cut into bags."""
    running = with_running_sum(views.bag_lengths(spark, folder), "length", "bag_id", name="end")
    starts = running.select((F.col("bag_id") + 1).alias("bag_no"), (F.col("end") + 100).alias("offset"))
    first = spark.range(1).select(F.lit(0).cast("bigint").alias("bag_no"), F.lit(100).cast("bigint").alias("offset"))
    ranges = bags.ranges_from_offsets(first.unionByName(starts))
    return bags.bag_elements(ranges, views.flat_ids(spark, folder))


@query
def bag_call_check(spark, folder):
    ranges = views.bag_lengths(spark, folder)
    return bags.check_ranges(ranges, views.flat_ids(spark, folder), views.embeddings(spark, folder))


@query
def bag_checked(spark, folder):
    """Ids that the table does not have: counted for each bag, whose sum is then NULL."""
    pooled = bags.embedding_bag(_planted_ids(spark, folder), views.embeddings(spark, folder), DIM, bad="report")
    return pooled.select("bag_id", "bad", F.posexplode_outer(F.transform("pooled", lambda x: F.round(x, 4))).alias("d", "x"))


@query
def bag_offsets_check(spark, folder):
    """Offsets as they should be, and with a fault of each kind."""
    running = with_running_sum(views.bag_lengths(spark, folder), "length", "bag_id", name="end")
    starts = running.select((F.col("bag_id") + 1).alias("bag_no"), F.col("end").alias("offset"))
    good = spark.range(1).select(F.col("id").alias("bag_no"), F.col("id").alias("offset")).unionByName(starts)
    no = F.col("bag_no")
    kinds = {
        "none": good, "gap": good.where(no != 5), "repeated": good.withColumn("bag_no", F.when(no == 7, 6).otherwise(no)),
        "falling": good.withColumn("offset", F.when(no == 3, 0).otherwise(F.col("offset"))), "short": good.withColumn("offset", F.least("offset", F.lit(90).cast("bigint"))),
    }
    ids = views.flat_ids(spark, folder)
    checks = [bags.check_offsets(offsets, ids).select(F.lit(kind).alias("kind"), "*") for kind, offsets in kinds.items()]
    return functools.reduce(DataFrame.unionByName, checks)


def _planted_ids(spark, folder):
    n = views.embeddings(spark, folder).agg(F.count("*").alias("n")).scalar()
    return views.table(spark, folder, "events").select(
        F.col("user_id").alias("bag_id"), "event_id", (F.col("event_id") % (n + 3) - 1).alias("vec_id")
    )


@query
def bag_bad_ids(spark, folder):
    return bags.bad_ids(_planted_ids(spark, folder), views.embeddings(spark, folder))


# --- products ----------------------------------------------------------------


@query
def vec_dot(spark, folder):
    vectors = views.embeddings(spark, folder)
    n = vectors.agg(F.count("*").alias("n")).scalar()
    ids = views.table(spark, folder, "events").select(
        "event_id", (F.col("event_id") % n).alias("a"), ((F.col("event_id") * 7 + 3) % n).alias("b")
    )
    left = vectors.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va"))
    right = vectors.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    both = ids.join(left, "a").join(right, "b")
    return both.select("event_id", F.round(linalg.vecdot(F.col("va"), F.col("vb")), 6).alias("dot"))


@query
def mat_vec(spark, folder):
    rows = views.embeddings(spark, folder)
    total = bags.pool(rows.withColumn("bag_id", F.lit(0)), F.col("embedding"), DIM)
    product = linalg.matvec(rows, total.select(F.col("pooled").alias("v")))
    return product.select("vec_id", F.round("value", 4).alias("value"))


@query
def vec_mat(spark, folder):
    rows = views.embeddings(spark, folder)
    vector = rows.select("vec_id", F.col("label").alias("x"))
    return linalg.vecmat(vector, rows, DIM).select("j", F.round("value", 4).alias("value"))


@query
def mat_mul(spark, folder):
    rows = views.embeddings(spark, folder)
    left = rows.select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("i", "v"))
    right = rows.select(F.col("vec_id").alias("k"), F.col("embedding").alias("row"))
    return linalg.matmul(left, right, DIM).select("i", "j", F.round("value", 4).alias("value"))


@query
def mat_mul_shapes(spark, folder):
    """Products of a matrix or a vector with a matrix or a vector, by tiles."""
    rows = views.embeddings(spark, folder)
    entries = rows.select(F.col("vec_id").alias("k"), F.posexplode("embedding").alias("at", "v"))
    vector = rows.select(F.col("vec_id").alias("k"), F.col("label").alias("v"))
    left, right = {"matrix": entries.withColumnRenamed("at", "i"), "vector": vector}, {"matrix": entries.withColumnRenamed("at", "j"), "vector": vector}
    parts = []
    for x, a in left.items():
        for y, b in right.items():
            product = linalg.matmul_tiled(a, b, 24)
            free = [(F.col(c) if c in product.columns else F.lit(None)).cast("int").alias(c) for c in ("i", "j")]
            parts.append(product.select(F.lit(f"{x} {y}").alias("shape"), *free, F.round("value", 4).alias("value")))
    return functools.reduce(DataFrame.unionByName, parts)


# --- reductions and scatter updates ------------------------------------------


def _days(interval):
    """Whole days of an interval."""
    return F.extract(F.lit("DAY"), interval).cast("bigint")


def _days_of(micros):
    """Whole days of exact microseconds: the sum of the intervals of a large table is longer than any interval."""
    return F.call_function("div", micros, F.lit(86_400_000_000).cast("decimal(11,0)"))


@query
def reduce_all(spark, folder):
    # Keys whose products are odd, and so never vanish modulo 2^64.
    rows = views.table(spark, folder, "lineitem").withColumns({
        "growth": 1 + F.col("l_tax") / 1000, "whole": F.col("l_orderkey") * F.lit(4000000014) + 1,
        "since": F.col("l_shipdate") - F.expr("timestamp_ntz '1995-01-01 00:00:00'")})
    one = lambda name, column: reduce.reduction(name, column).alias(name)
    found = rows.groupBy("l_returnflag").agg(
        F.round(reduce.reduction("add", "l_extendedprice"), 2).alias("add"),
        F.round(reduce.reduction("multiply", "growth"), 6).alias("multiply"),
        one("bitwise_and", "l_orderkey"), one("bitwise_or", "l_orderkey"), one("bitwise_xor", "l_orderkey"),
        one("logical_and", "l_linenumber"), one("logical_or", "l_tax"), one("logical_xor", "l_discount"),
        one("maximum", "l_quantity"), one("minimum", "l_quantity"),
        one("fmax", "l_extendedprice"), one("fmin", "l_extendedprice"),
        F.round(reduce.reduction("hypot", "l_quantity"), 4).alias("hypot"),
        *[reduce.reduction(n, "l_shipdate").alias(f"{n}_date") for n in ("maximum", "minimum", "fmax", "fmin")],
        _days_of(reduce.reduction("add", "since", "micros")).alias("add_interval"),
        *[_days(reduce.reduction(n, "since", "interval")).alias(f"{n}_interval") for n in ("maximum", "minimum", "fmax", "fmin")],
    )
    products = reduce.product_reduce(rows, "whole", "l_returnflag").withColumnRenamed("value", "multiply_whole")
    return found.join(products, "l_returnflag")


@query
def reduce_logaddexp(spark, folder):
    rows = views.table(spark, folder, "lineitem")
    return reduce.logaddexp_reduce(rows, "l_quantity", "l_returnflag", "l_linestatus").select(
        "l_returnflag", "l_linestatus", F.round("value", 6).alias("logaddexp"), F.round("value2", 6).alias("logaddexp2")
    )


@query
def reduce_gcd(spark, folder):
    rows = views.table(spark, folder, "lineitem").withColumn("n", (F.col("l_quantity") * 6).cast("bigint"))
    return reduce.gcd_reduce(rows, "l_suppkey", "n").withColumnRenamed("value", "gcd")


@query
def scatter_update(spark, folder):
    parts = views.table(spark, folder, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("value"))
    # No line has a negative part: these targets stay as they are.
    target = parts.unionByName(parts.withColumn("idx", -1 - F.col("idx")))
    updates = views.table(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("idx"), F.col("l_quantity").alias("n"), (1 + F.col("l_tax")).alias("factor"),
        (F.col("l_extendedprice") / 40).alias("bound"),
    )
    columns = {
        "add": "n", "subtract": "n", "multiply": "factor", "divide": "factor",
        "maximum": "bound", "minimum": "bound", "fmax": "bound", "fmin": "bound",
    }
    done = scatter.scatter_all(target, updates, {op: (op, column) for op, column in columns.items()})
    return done.select("idx", *[F.round(op, 6).alias(op) for op in columns])


@query
def scatter_types(spark, folder):
    """Updates of times, intervals and 64-bit integers; part 1 gets a third of all of them."""
    lines = views.table(spark, folder, "lineitem")
    idx = F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(F.col("l_partkey")).cast("bigint").alias("idx")
    start = F.expr("timestamp_ntz '1995-06-17 00:00:00'")
    parts = views.table(spark, folder, "part").select(F.col("p_partkey").alias("idx"))
    updates = lines.select(idx, F.col("l_shipdate").alias("time"), (F.col("l_shipdate") - start).alias("since"), (F.col("l_orderkey") * 4000000014 + 1).alias("whole"))
    times = scatter.scatter_all(parts.withColumn("value", start), updates, {f"{op}_date": (op, "time") for op in ("maximum", "minimum", "fmax", "fmin")})
    ops = {"add": "add_micros", "subtract": "subtract_micros", "maximum": "maximum", "minimum": "minimum", "fmax": "fmax", "fmin": "fmin"}
    spans = scatter.scatter_all(parts.withColumn("value", start - start), updates, {f"{name}_interval": (op, "since") for name, op in ops.items()})
    whole = scatter.scatter_all(parts.withColumn("value", F.col("idx") * 2 + 1), updates, {"multiply_whole": ("multiply", "whole"), "maximum_whole": ("maximum", "whole"), "fmin_whole": ("fmin", "whole")})
    spans = spans.select("idx", *[(_days_of if ops[c.removesuffix("_interval")].endswith("_micros") else _days)(F.col(c)).alias(c) for c in spans.columns if c != "idx"])
    return times.join(spans, "idx").join(whole, "idx")


@query
def scatter_floor_divide(spark, folder):
    """Divisors of either sign, whole and fractional, one after the other; part 1 gets a third of all updates."""
    parts = views.table(spark, folder, "part").select(F.col("p_partkey").alias("idx"))
    idx = F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(F.col("l_partkey")).cast("bigint").alias("idx")
    step = F.col("l_orderkey") % 5
    whole = F.when(F.col("l_linenumber") == 2, -1).when(F.col("l_linenumber") > 4, F.when(step < 2, -2).otherwise(3)).otherwise(1).cast("bigint")
    real = F.when(F.col("l_linenumber") == 2, F.when(step == 0, 0.25).otherwise(-0.5)).when(F.col("l_linenumber") == 3, 1.5).otherwise(-1.25 + step / 2)
    lines = views.table(spark, folder, "lineitem").select(idx, "l_orderkey", "l_linenumber", whole.alias("whole"), real.alias("real"))
    order = ("l_orderkey", "l_linenumber")
    whole = scatter.scatter(parts.withColumn("value", F.col("idx") * 1000003 - 900000000), lines.withColumnRenamed("whole", "u"), "floor_divide", order)
    real = scatter.scatter(parts.withColumn("value", F.col("idx") * 1000.5 - 90000), lines.withColumnRenamed("real", "u"), "floor_divide", order)
    return whole.select("idx", F.col("value").alias("whole")).join(real.select("idx", F.col("value").alias("real")), "idx")


# --- column functions --------------------------------------------------------


def _rounded(**columns):
    return [F.round(column, 6).alias(name) for name, column in columns.items()]


def _named(**columns):
    return [column.alias(name) for name, column in columns.items()]


def _orders(spark, folder):
    rows = views.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    return rows.withColumn("x", signed / 1000).withColumn("y", (F.col("o_custkey") % 7 - 3).cast("double"))


@query
def fn_arith(spark, folder):
    x, y = F.col("x"), F.col("y")
    both = num.divmod(x, y)
    return _orders(spark, folder).select(
        "o_orderkey",
        *_rounded(
            add_=num.add(x, y), subtract_=num.subtract(x, y), multiply_=num.multiply(x, y), divide_=num.divide(x, y),
            fmod_=num.fmod(x, y), remainder_=num.remainder(x, y), absolute_=num.absolute(x), fabs_=num.fabs(x),
            negative_=num.negative(x), positive_=num.positive(x), reciprocal_=num.reciprocal(x), square_=num.square(x),
            sqrt_=num.sqrt(num.absolute(x)), cbrt_=num.cbrt(x), power_=num.power(x / 10, F.lit(3)),
            float_power_=num.float_power(num.absolute(x), F.lit(0.5)), hypot_=num.hypot(x, y),
            floor_divide_=num.floor_divide(x, y), quotient_=both["quotient"], rest_=both["remainder"],
        ),
        num.ones_like(x).alias("ones_like_"),
        num.floor_divide_int(F.col("o_orderkey") - 5000, F.col("o_custkey") % 7 - 3).alias("floor_divide_int_"),
    )


@query
def fn_exp_log(spark, folder):
    x, small = F.col("x"), F.col("x") / 100
    return _orders(spark, folder).select(
        "o_orderkey",
        *_rounded(
            exp_=num.exp(small), exp2_=num.exp2(small), expm1_=num.expm1(small), log_=num.log(x), log2_=num.log2(x),
            log10_=num.log10(x), log1p_=num.log1p(x), log_zero_=num.log(x * 0),
            logaddexp_=num.logaddexp(x, F.col("y")), logaddexp2_=num.logaddexp2(x, F.col("y")),
        ),
    )


@query
def fn_trig(spark, folder):
    x = F.col("x")
    unit = x / 1000
    return _orders(spark, folder).select(
        "o_orderkey",
        *_rounded(
            sin_=num.sin(x), cos_=num.cos(x), tan_=num.tan(unit), arcsin_=num.arcsin(unit), arccos_=num.arccos(unit),
            arctan_=num.arctan(x), arctan2_=num.arctan2(x, F.col("y")), sinh_=num.sinh(unit), cosh_=num.cosh(unit),
            tanh_=num.tanh(x), arcsinh_=num.arcsinh(unit), arccosh_=num.arccosh(num.absolute(x) + 1),
            arctanh_=num.arctanh(unit), degrees_=num.degrees(unit), radians_=num.radians(x),
            rad2deg_=num.rad2deg(unit), deg2rad_=num.deg2rad(x),
        ),
    )


@query
def fn_round(spark, folder):
    x, half = F.col("x"), F.col("o_orderkey") / 2
    parts = num.modf(x)
    return _orders(spark, folder).select(
        "o_orderkey",
        *_rounded(
            ceil_=num.ceil(x), floor_=num.floor(x), trunc_=num.trunc(x), rint_=num.rint(half),
            fraction_=parts["fraction"], integral_=parts["integral"], clip_=num.clip(x, F.lit(-50.0), F.lit(80.0)),
        ),
    )


@query
def fn_compare(spark, folder):
    x, y = F.rint("x"), F.col("y") * 20
    nan = F.when(F.col("o_orderkey") % 10 == 0, F.lit(float("nan"))).otherwise(y)
    return _orders(spark, folder).select(
        "o_orderkey",
        *_named(
            equal_=num.equal(x, y), not_equal_=num.not_equal(nan, nan), greater_=num.greater(nan, x),
            greater_equal_=num.greater_equal(x, y), less_=num.less(x, y), less_equal_=num.less_equal(x, nan),
        ),
        *_rounded(
            maximum_=num.maximum(x, y), minimum_=num.minimum(x, y), fmax_=num.fmax(x, nan), fmin_=num.fmin(nan, x),
            heaviside_=num.heaviside(F.col("y"), F.lit(0.5)), sign_=num.sign(F.col("y")),
        ),
    )


@query
def fn_logic_bits(spark, folder):
    a, b, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_custkey") % 5
    return _orders(spark, folder).select(
        "o_orderkey",
        *_named(
            bitwise_and_=num.bitwise_and(a, b), bitwise_or_=num.bitwise_or(a, b), bitwise_xor_=num.bitwise_xor(a, b),
            invert_=num.invert(a), bitwise_count_=num.bitwise_count(-a).cast("bigint"), left_shift_=num.left_shift(a, n),
            right_shift_=num.right_shift(a, n), logical_and_=num.logical_and(n, a % 2), logical_or_=num.logical_or(n, a % 2),
            logical_xor_=num.logical_xor(n, a % 2), logical_not_=num.logical_not(n),
        ),
    )


@query
def fn_float_class(spark, folder):
    z = num.divide(F.col("x"), F.when(F.col("o_orderkey") % 4 < 2, 0.0).otherwise(1.0))
    z = F.when(F.col("o_orderkey") % 8 == 0, F.lit(float("nan"))).otherwise(z)
    return _orders(spark, folder).select(
        "o_orderkey",
        *_named(isnan_=num.isnan(z), isinf_=num.isinf(z), isfinite_=num.isfinite(z), signbit_=num.signbit(F.col("x"))),
        F.round(num.copysign(F.lit(2.5), F.col("x")), 6).alias("copysign_"),
    )


@query
def fn_int_exact(spark, folder):
    """64-bit integers that a double cannot hold."""
    x = (F.col("o_orderkey") * 3 + 9007199254740993) * F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    y = F.col("o_custkey") % 15 - 7
    whole = num.divmod(x, y, of="integer")
    return views.table(spark, folder, "orders").select(
        "o_orderkey",
        *_named(
            fmod_=num.fmod(x, y, of="integer"), remainder_=num.remainder(x, y, of="integer"), quotient_=whole["quotient"], rest_=whole["remainder"],
            floor_=num.floor(x, of="integer"), ceil_=num.ceil(x, of="integer"), trunc_=num.trunc(x, of="integer"),
            power_=num.power(y, F.col("o_orderkey") % 20, of="integer"), reciprocal_=num.reciprocal(y, of="integer"),
            fmax_=num.fmax(x, x + 1), fmin_=num.fmin(x, x + 1), maximum_=num.maximum(x, y), equal_=num.equal(x, x + 1), absolute_=num.absolute(x, of="integer"),
        ),
    )


@query
def fn_bool(spark, folder):
    a, b = F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 3 == 0
    return views.table(spark, folder, "orders").select(
        "o_orderkey",
        *_named(
            add_=num.add(a, b, of="boolean"), multiply_=num.multiply(a, b, of="boolean"), absolute_=num.absolute(a, of="boolean"),
            and_=num.bitwise_and(a, b, of="boolean"), or_=num.bitwise_or(a, b, of="boolean"), xor_=num.bitwise_xor(a, b, of="boolean"),
            invert_=num.invert(a, of="boolean"), maximum_=num.maximum(a, b), minimum_=num.minimum(a, b), less_=num.less(a, b), equal_=num.equal(a, b),
        ),
    )


@query
def fn_datetime(spark, folder):
    """Dates and intervals through the same functions."""
    day = F.expr("interval 1 day")
    start = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    gap = num.subtract(F.col("o_orderdate"), start)
    week = F.expr("interval 7 day")
    parts = num.divmod_interval(gap, week)
    twice = num.multiply(gap, F.lit(2))
    rows = views.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate")).alias("sometimes"),
    )
    return rows.select(
        "o_orderkey",
        num.add(F.col("o_orderdate"), day).alias("next_day"),
        num.subtract(F.col("o_orderdate"), day).alias("day_before"),
        num.add(start, twice).alias("mirrored"),
        num.add(start, gap / F.lit(2)).alias("halfway"),
        num.greater(F.col("o_orderdate"), start).alias("later"),
        num.less_equal(F.col("o_orderdate"), start).alias("not_later"),
        num.equal(F.col("o_orderdate"), F.col("sometimes")).alias("same_day"),
        num.maximum(F.col("o_orderdate"), start).alias("latest"),
        num.minimum(F.col("o_orderdate"), start).alias("earliest"),
        num.fmax(F.col("o_orderdate"), F.col("sometimes")).alias("known"),
        num.clip(F.col("o_orderdate"), start, start + F.expr("interval 365 day")).alias("clipped"),
        num.greater(gap, week).alias("long_gap"), num.sign(gap).alias("direction"),
        num.isfinite(gap).alias("isfinite_"), num.isnan(F.col("o_orderdate")).alias("isnan_"),
        F.round(num.divide_interval(gap, week), 6).alias("weeks"),
        parts["quotient"].alias("whole_weeks"),
        num.add(start, parts["remainder"]).alias("rest"),
        num.isnat(F.col("sometimes")).alias("isnat_"),
    )


@query
def fn_gcd_lcm(spark, folder):
    lines = views.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    a, b = F.col("l_orderkey"), F.col("l_partkey")
    return lines.select("l_orderkey", "l_partkey", num.gcd(a, b).alias("gcd"), num.lcm(a, b).alias("lcm"))


@query
def fn_str_pad_strip(spark, folder):
    name = F.col("p_name")
    padded = F.concat(F.lit("\t "), name, F.lit(" \n"))
    tabbed = F.concat(F.col("p_type"), F.lit("\t"), name, F.lit("\t|"))
    signed = F.concat(F.when(F.col("p_size") % 2 == 0, "-").otherwise(""), F.col("p_size").cast("string"))
    return views.table(spark, folder, "part").select(
        "p_partkey",
        *_named(
            center_=strs.center(name, 15, "*"), ljust_=strs.ljust(name, 15, "-"), rjust_=strs.rjust(name, 15),
            zfill_=strs.zfill(signed, 5), strip_=strs.strip_whitespace(padded), lstrip_=strs.lstrip_whitespace(padded),
            rstrip_=strs.rstrip_whitespace(padded), strip_chars_=strs.strip_chars(name, "abcdefr "),
            lstrip_chars_=strs.lstrip_chars(name, "abcdefr "), rstrip_chars_=strs.rstrip_chars(name, "getdr "),
            expandtabs_=strs.expandtabs(tabbed, 8), expandtabs_length_=strs.expandtabs_length(tabbed, 8),
            str_len_=strs.str_len(name),
        ),
    )


@query
def fn_str_find_count(spark, folder):
    body = F.col("text")
    return views.documents(spark, folder).select(
        "doc_id",
        *_named(
            find_=strs.find(body, "en"), find_from_=strs.find(body, "e", 5, 200), rfind_=strs.rfind(body, "e"),
            rfind_from_=strs.rfind(body, "en", 10, -10), count_=strs.count(body, "e"), count_from_=strs.count(body, "en", 3, 500),
            startswith_=strs.startswith(body, "E"), startswith_from_=strs.startswith(body, "a", 1, 9),
            endswith_=strs.endswith(body, "."), index_=strs.index(F.concat(body, F.lit("#")), "#"),
            rindex_=strs.rindex(F.concat(F.lit("#"), body), "#"), length_=strs.str_len(body),
        ),
    )


@query
def fn_str_split_slice(spark, folder):
    body = F.col("text")
    first, last = strs.partition(body, " "), strs.rpartition(body, " ")
    return views.documents(spark, folder).select(
        "doc_id", first["head"].alias("head"), first["sep"].alias("sep"), first["tail"].alias("tail"),
        last["head"].alias("rhead"), last["tail"].alias("rtail"),
        *_named(
            slice_=strs.slice(body, 3, 40), slice_end_=strs.slice(body, -12, -2), slice_step_=strs.slice(body, 0, 60, 3),
            slice_back_=strs.slice(body, None, None, -1), replace_=strs.replace(body, "e", "<e>"),
            replace_two_=strs.replace(body, "e", "<e>", 2),
        ),
    )


@query
def fn_str_class(spark, folder):
    # Words, and the runs of blanks between them, which are what isspace looks at.
    runs = F.regexp_extract_all("text", F.lit("([ \\t\\r\\n]+|[^ \\t\\r\\n]+)"), F.lit(1))
    rows = views.documents(spark, folder).select("doc_id", metrics.tokens(F.col("text")).alias("words"), runs.alias("runs"))
    flags = {
        "isalpha": strs.isalpha, "isdecimal": strs.isdecimal, "isdigit": strs.isdigit, "isnumeric": strs.isnumeric,
        "isalnum": strs.isalnum, "isspace": strs.isspace, "islower": strs.islower, "isupper": strs.isupper, "istitle": strs.istitle,
    }
    counts = [F.size(F.filter("runs" if name == "isspace" else "words", flag)).cast("bigint").alias(name) for name, flag in flags.items()]
    return rows.select("doc_id", F.size("words").cast("bigint").alias("words"), *counts)


# --- syntax and suites -------------------------------------------------------


@query
def syntax_screen(spark, folder):
    code = F.col("code")
    texts = views.completions(spark, folder).select(
        "doc_id", code.alias("raw"), text.clean_completion(code).alias("cleaned"),
        text.extract_functions(code).alias("extracted"),
    )
    return suites.screen_syntax(texts, "raw", "cleaned", "extracted")


def _suite_jobs(spark, folder):
    """Cleaned completions with tests that hold for even documents only."""
    doc = F.col("doc_id")
    shape, even = doc % 7, doc % 2 == 0
    name = F.concat(F.lit("fn_"), doc.cast("string"))
    wrong = F.when(even, "").otherwise(" + 1")
    tests = (
        F.when(shape == 0, F.array(F.concat(F.lit("assert "), name, F.lit("(1) == "), name, F.lit("(2)"), wrong)))
        .when(shape == 1, F.array(F.lit("assert x == 1"), F.concat(F.lit("assert x == 1"), wrong)))
        .otherwise(F.array(F.concat(F.lit("assert f(3) == 3"), wrong)))
    )
    suite = F.when(shape == 0, "humaneval").when(shape == 1, "mbpp").when(shape == 3, "import").otherwise("generic")
    return views.completions(spark, folder).select(
        "doc_id", "source", text.clean_completion(F.col("code")).alias("code"), tests.alias("tests"),
        suite.alias("suite"), name.alias("entry_point"),
    )


@query
def suite_verdicts(spark, folder):
    ran = suites.run_suites(_suite_jobs(spark, folder), ["doc_id"], allow_exec=True)
    return ran.select("doc_id", "test_type", "passed", "error_type")


@query
def syntax_metrics(spark, folder):
    jobs = _suite_jobs(spark, folder).withColumn("suite", F.lit("import"))
    imported = suites.run_suites(jobs, ["source", "doc_id"], allow_exec=True)
    valid = F.coalesce(F.col("error_type"), F.lit("")).isin("SyntaxError", "EmptyCodeError")
    rows = imported.select("source", (~valid).alias("valid"), F.col("passed").alias("importable"))
    return suites.syntax_metrics(rows, "source")
