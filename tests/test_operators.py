"""Operators on small hand-written tables, against brute force."""

import datetime
import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradespark.functions import bits
from gradespark.functions import numeric as num
from gradespark.operators import attempts, bags, chat, configs, folds, linalg, logs, matrix, metrics, ordering, reduce, scatter, suites, tasks


def test_positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaab"), i, rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(7)
    by_order = sorted(rows, key=lambda r: r[1])
    assert {r.o: r.row_index for r in ordering.with_row_index(df, "o").collect()} == {r[1]: i for i, r in enumerate(by_order)}
    seen, want = Counter(), {}
    for k, o, _ in by_order:
        want[o], seen[k] = seen[k], seen[k] + 1
    assert {r.o: r.pos for r in ordering.with_group_position(df, ["k"], "o").collect()} == want
    total, sums = 0, {}
    for _, o, v in by_order:
        total += v
        sums[o] = total
    assert {r.o: r.running for r in ordering.with_running_sum(df, "v", "o").collect()} == sums


def test_positions_over_many_buckets(spark, monkeypatch):
    """Hot groups over few and many buckets, NULL keys, and no job before the result is asked for."""
    rng = random.Random(4)
    rows = [(rng.choice(["a", "a", "a", None, "b", f"k{i % 40}"]), i, rng.random() * 10 - 5) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, v double").repartition(6)
    tracker = spark.sparkContext.statusTracker()
    for bounds in (4, 64, 4096):
        monkeypatch.setattr(ordering, "_BOUNDS", bounds)
        spark.sparkContext.setJobGroup(f"positions {bounds}", "")
        index, pos = ordering.with_row_index(df, "o"), ordering.with_group_position(df, ["k"], "o")
        running = ordering.with_running_sum(df, "o", "o")
        assert not tracker.getJobIdsForGroup(f"positions {bounds}")
        assert all(r.row_index == r.o for r in index.collect())
        seen, want, total = Counter(), {}, 0
        for k, o, _ in sorted(rows, key=lambda r: r[1]):
            want[o], seen[k] = seen[k], seen[k] + 1
        assert {r.o: r.pos for r in pos.collect()} == want
        assert all(r.running == r.o * (r.o + 1) // 2 for r in running.collect())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert ordering.with_row_index(df.where("false"), "o").collect() == []


def resolve(chain):
    made = [(a, c, ok) for a, c, ok, produced in sorted(chain) if produced]
    for _, code, ok in made:
        if ok:
            return code.strip()
    return made[-1][1].strip() if made else ""


def test_chains(spark):
    rng = random.Random(2)
    chains = {f"t{i}": [(a, f" c{i}-{a}\n", rng.random() < 0.3, rng.random() < 0.7) for a in range(rng.randint(1, 4))] for i in range(80)}
    rows = [(t, "M", *step) for t, chain in chains.items() for step in chain]
    df = spark.createDataFrame(rows, "task_id string, method string, attempt int, code string, ok boolean, produced boolean")
    got = {r.task_id: r.code for r in attempts.resolve_chains(df).collect()}
    assert got == {t: resolve(c) for t, c in chains.items()}


def test_pass_at_k(spark):
    results = [[False, True], [True] * 12, [False] * 6 + [True] * 6, [False] * 4, [True]]
    rows = [(f"t{i}", j, ok) for i, r in enumerate(results) for j, ok in enumerate(r)]
    df = spark.createDataFrame(rows, "task_id string, attempt int, ok boolean")
    got = {r.k: r.pass_at_k for r in attempts.pass_at_k(df).collect()}
    want = {1: 40.0, 5: 20.0, 10: 40.0}
    assert got == want
    assert [r.pass_at_k for r in attempts.pass_at_k(df.limit(0)).collect()] == [0.0, 0.0, 0.0]
    tasks_ = spark.createDataFrame([(f"t{i}",) for i in range(10)], "task_id string")
    assert {r.k: r.pass_at_k for r in attempts.pass_at_k(df, tasks=tasks_).collect()} == {k: v / 2 for k, v in want.items()}


def test_evaluate(spark):
    codes = spark.createDataFrame([(0,), (1,), (2,)], "example_index int")
    tests = spark.createDataFrame([(0, True), (1, False)], "example_index int, passed boolean")
    row = attempts.evaluate(attempts.match_tests(codes, tests)).first()
    assert (row.total_examples, row.passed_examples) == (3, 1) and math.isclose(row.pass_rate, 100 / 3)
    assert attempts.evaluate(tests.limit(0)).count() == 0


def test_published_counts(spark):
    counts = [104, 132, 152, 113, 119, 129, 124, 146, 139, 153, 154]
    rows = [(m, f"t{i:03d}", int(i < c), 0) for m, c in zip(logs.METHODS, counts) for i in range(164)]
    verdicts = spark.createDataFrame(rows, "method string, test_name string, passed int, line_no int")
    tests = spark.createDataFrame([(i + 1, f"t{i:03d}") for i in range(164)], "test_id bigint, test_name string")
    board = matrix.leaderboard(tests, verdicts).collect()
    labels = {r.method: r.label for r in board}
    assert labels["PDG_CHAIN_FEEDBACK"] == "154/164 (93.9%)" and labels["AST"] == "152/164 (92.7%)" and labels["BASE"] == "104/164 (63.4%)"
    assert [r.passed for r in board] == sorted(counts)
    wide = matrix.verdict_matrix(tests, verdicts)
    deltas = {r.method: round(r.delta_points, 1) for r in matrix.base_vs_chain(matrix.method_totals(wide)).collect()}
    assert deltas == {"AST": -23.8, "DFG": 6.1, "CFG": 13.4, "PDG": 8.5}
    cells = matrix.heatmap_rows(wide)
    assert cells.count() == 164 * 11
    assert {r.method: r.method_rank for r in cells.select("method", "method_rank").distinct().collect()}["BASE"] == 1


def test_tests_from_tasks_repeat_names(spark):
    t = spark.createDataFrame([("HumanEval/0", "add"), ("HumanEval/10", "sub"), ("HumanEval/2", "add")], "task_id string, entry_point string")
    assert sorted(map(tuple, matrix.tests_from_tasks(t).collect())) == [(1, "add"), (3, "add"), (11, "sub")]


def test_method_names(spark):
    names = {
        "HumanEval on Some:Model-3B.rtf": "BASE", "/logs/HumanEval on Some:Model-3B + CHAIN.rtf": "BASE_CHAIN",
        "HumanEval on Some:Model-3B + AST + CHAIN\u00a0.rtf": "AST_CHAIN", "HumanEval on Some:Model-3B + \u0421FG + CHAIN\u00a0.rtf": "CFG_CHAIN",
        "HumanEval on Some:Model-3B + PDG + CHAIN\u00a0+ Feedback.rtf": "PDG_CHAIN_FEEDBACK",
    }
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert [r[0] for r in df.select(logs.method_from_file(F.col("f"))).collect()] == list(names.values())


def test_log_grammars(spark):
    lines = [
        "✅ HumanEval tests for a passed successfully.", "❌ SYNTAX ERROR in code for b ", "❌ RUNTIME ERROR raised for c", "❌ TEST EXECUTION ERROR for d: KeyError: 'x'",
        "noise", "HumanEval tests for e passed successfully SYNTAX ERROR in code for e2", "",
    ]
    files = spark.createDataFrame([("f", "\n".join(lines))], "file string, text string")
    df = logs.log_lines(files)
    read = lambda g: {r.test_name: r.passed for r in logs.parse_verdicts(df, g).collect()}
    assert read("syntax") == {"a": 1, "b": 0, "e": 1}
    assert read("runtime") == {"a": 1, "b": 0, "c": 0, "e": 1}
    assert read("full") == {"a": 1, "b": 0, "c": 0, "d": 0, "e": 1}
    assert {r.error_type for r in logs.parse_verdicts(df, "full").collect()} == {None, "SYNTAX ERROR", "RUNTIME ERROR", "KeyError"}
    twice = df.unionByName(df)
    stats = logs.method_stats(logs.parse_verdicts(twice.withColumn("method", F.lit("M")))).first()
    assert (stats.passed, stats.passed_distinct, stats.total_tests, stats.label) == (4, 2, 4, "4/4 (100.0%)")


def bleu(ref, cand):
    ref, cand = ref.split(), cand.split()
    logs_ = 0.0
    for n in range(1, 5):
        grams = lambda w: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        hits = sum((grams(ref) & grams(cand)).values())
        if n == 1 and hits == 0:
            return 0.0
        logs_ += 0.25 * math.log((hits or 0.1) / max(len(cand) - n + 1, 1))
    return math.exp(logs_ + (0 if len(cand) > len(ref) else 1 - len(ref) / len(cand)))


def test_bleu(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", "dd", "e'"]
    texts = ["", "a", "a b", "a b c dd e'", "x y z w", " a  a\ta\n", "a a a a a a"] + [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(30)]
    cases = [(i, i % len(texts), texts[(i * 7 + 3) % len(texts)]) for i in range(len(texts) * 3)] + [(1000, 3, texts[3])]
    pairs = spark.createDataFrame(cases, "pair_id int, reference_id int, candidate string")
    refs = spark.createDataFrame(list(enumerate(texts)), "reference_id int, reference string")
    got = {r.pair_id: r.bleu for r in metrics.bleu(pairs, refs).collect()}
    assert set(got) == {c[0] for c in cases}
    for pair, ref, cand in cases:
        assert math.isclose(got[pair], bleu(texts[ref], cand), abs_tol=1e-12), (texts[ref], cand)
    assert math.isclose(got[1000], 1.0)


def test_termination(spark):
    df = spark.createDataFrame([("def f():\n  return 1\n",), ("x = ",), ("",), ('"""doc\n"""',)], "code string")
    row = metrics.termination(df).first()
    assert (row.completions, row.termination_ratio, row.ends_cleanly) == (4, 1.0, 0.75)
    assert metrics.termination(df.limit(0)).first().termination_ratio == 0.0


def test_exact_match_and_timing(spark):
    df = spark.createDataFrame([(" a ", "a", 1.0), ("a", "b", 3.0)], "r string, c string, seconds double")
    assert [r[0] for r in df.select(metrics.exact_match(F.col("r"), F.col("c"))).collect()] == [1, 0]
    assert tuple(metrics.run_timing(df).first()) == (4.0, 2.0)


def test_configs(spark):
    df = spark.createDataFrame([({"temperature": None, "top_k": "7", "num_beams": "4"},), (None,)], "c map<string,string>")
    full = [r[0] for r in df.select(configs.effective_config(F.col("c"), F.lit(10))).collect()]
    assert full[0] == {**configs.DEFAULTS, "top_k": "7", "num_beams": "4", "max_length": "410"}
    assert full[1] == {**configs.DEFAULTS, "max_length": "410"}
    greedy = df.select(configs.greedy_config(F.col("c"))).first()[0]
    assert greedy == {"temperature": "0.0", "top_k": "1", "top_p": "1.0", "do_sample": "false", "num_beams": "1"}


def test_lookup_and_prompts(spark):
    known = spark.createDataFrame([("HumanEval/1", "p")], "task_id string, prompt string")
    wanted = spark.createDataFrame([("HumanEval/1",), ("HumanEval/9",)], "task_id string")
    got = {r.task_id: (r.prompt, r.error) for r in tasks.lookup_tasks(wanted, known).collect()}
    assert got == {"HumanEval/1": ("p", None), "HumanEval/9": (None, "Task ID HumanEval/9 not found")}
    ids = spark.createDataFrame([(f"HumanEval/{i}",) for i in (2, 10, 1)], "task_id string")
    order = ["HumanEval/1", "HumanEval/10", "HumanEval/2"]
    assert [r[0] for r in tasks.sort_and_limit(ids).collect()] == order == [r[0] for r in tasks.sort_and_limit(ids, 0).collect()]
    assert [r[0] for r in tasks.sort_and_limit(ids, 2).collect()] == order[:2]
    with pytest.raises(ValueError):
        tasks.sort_and_limit(ids, -1)
    rows = spark.createDataFrame([("p\n", "  return 1", None), ("", "  ", None), ("p", "x", "boom")], "prompt string, completion string, error string")
    assert [(r.code, r.error) for r in tasks.testable_code(rows).collect()] == [("p\n  return 1", None), ("", tasks.NO_CODE_ERROR), ("", "boom")]


def render(messages, tools=None, header=False):
    out, first = "", messages[0]
    system = first[0] == "system"
    out += "<|im_start|>system\n" + (first[1] if system else "You are a helpful assistant.")
    if tools:
        out += chat.TOOLS_INTRO + "".join("\n" + t for t in tools) + chat.TOOLS_OUTRO
    out += "<|im_end|>\n"
    for i, (role, content, calls) in enumerate(messages):
        if role == "system" and i == 0:
            continue
        if role == "tool":
            if i == 0 or messages[i - 1][0] != "tool":
                out += "<|im_start|>user"
            out += f"\n<tool_response>\n{content}\n</tool_response>"
            if i == len(messages) - 1 or messages[i + 1][0] != "tool":
                out += "<|im_end|>\n"
        elif calls:
            out += "<|im_start|>assistant" + (f"\n{content}" if content else "")
            out += "".join(f'\n<tool_call>\n{{"name": "{n}", "arguments": {a}}}\n</tool_call>' for n, a in calls) + "<|im_end|>\n"
        elif role in ("user", "system", "assistant"):
            out += f"<|im_start|>{role}\n{content}<|im_end|>\n"
    return out + ("<|im_start|>assistant\n" if header else "")


@pytest.mark.parametrize("turns", [1, 2, 3, 4096])
@pytest.mark.parametrize("numbers", ["dense", "from one", "gaps"])
def test_chat_messages_join_to_the_whole(spark, turns, numbers):
    rng = random.Random(4)
    convs = {}
    for c in range(40):
        messages = [("system", "sys", None)] if rng.random() < 0.4 else []
        for i in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "tool", "tool", "system"])
            calls = [("f", '{"x": 1}'), ("g", "{}")][: rng.randint(0, 2)] if role == "assistant" else None
            messages.append((role, rng.choice(["", f"m{i}", None]), calls))
        convs[c] = messages
    number = {"dense": lambda i: i, "from one": lambda i: i + 1, "gaps": lambda i: i * 5 - 7}[numbers]
    rows = [(c, number(i), *m) for c, ms in convs.items() for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "conv_id int, turn bigint, role string, text string, tool_calls array<struct<name:string,arguments:string>>")
    tools = ['{"name": "f"}']
    got = chat.render(df, tools=F.array(*map(F.lit, tools)), generation_prompt=True, turns=turns)
    joined = {}
    for r in got.orderBy("conv_id", "turn").collect():
        joined[r.conv_id] = joined.get(r.conv_id, "") + r.text
    assert joined == {c: render([(r, t or "", k) for r, t, k in m], tools, True) for c, m in convs.items()}


@pytest.mark.parametrize("kind,dtype", [("half", np.float16), ("bfloat16", None)])
def test_all_16_bit_patterns(spark, kind, dtype):
    patterns = np.arange(65536, dtype=np.uint16)
    df = spark.createDataFrame([(int(p),) for p in patterns.astype(np.int16)], "b smallint")
    decode = bits.decode_half if kind == "half" else bits.decode_bfloat16
    got = np.array([r[0] for r in df.select(decode(F.col("b"))).collect()])
    want = patterns.view(np.float16).astype(np.float64) if dtype else (patterns.astype(np.uint32) << 16).view(np.float32).astype(np.float64)
    assert np.array_equal(got, want, equal_nan=True)


@pytest.mark.parametrize("dim", [3, 64, 65, 150])
def test_bags(spark, dim):
    rng = np.random.default_rng(5)
    table = rng.normal(size=(20, dim)).astype(np.float32)
    elements = [(int(b), int(v), float(w)) for b, v, w in zip(rng.integers(0, 5, 200), rng.integers(0, 20, 200), rng.normal(size=200))]
    emb = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(table)], "vec_id int, embedding array<float>")
    df = spark.createDataFrame(elements, "bag_id int, vec_id int, weight double")
    listed = spark.createDataFrame([(b,) for b in range(7)], "bag_id int")
    sums = {b: sum((table[v].astype(float) for x, v, _ in elements if x == b), np.zeros(dim)) for b in range(7)}
    for r in bags.embedding_bag(df, emb, dim, bags=listed).collect():
        assert np.allclose(r.pooled, sums[r.bag_id])
    n = Counter(b for b, _, _ in elements)
    for r in bags.embedding_bag(df, emb, dim, weight=F.col("weight"), mean=True).collect():
        want = sum(w * table[v].astype(float) for x, v, w in elements if x == r.bag_id) / n[r.bag_id]
        assert np.allclose(r.pooled, want)
    q = rng.integers(0, 256, size=(20, dim))
    scale, bias = rng.normal(size=20), rng.normal(size=20)
    scale[3] = 0.0
    codes = spark.createDataFrame([(i, float(scale[i]), float(bias[i]), q[i].tolist()) for i in range(20)], "vec_id int, scale double, bias double, q array<int>")
    for r in bags.quantized_bag(df, codes, dim, weight=F.col("weight")).collect():
        want = sum(w * (scale[v] * q[v] + bias[v]) for x, v, w in elements if x == r.bag_id)
        assert np.allclose(r.pooled, want)


def test_ranges(spark):
    lengths = spark.createDataFrame([(0, 3), (1, 0), (2, 2)], "bag_id bigint, length bigint")
    ids = spark.createDataFrame([(i, v) for i, v in enumerate([4, 1, 1, 0, 2])], "flat bigint, vec_id bigint")
    table = spark.createDataFrame([(i,) for i in range(5)], "vec_id bigint")
    ranges = bags.ranges_from_lengths(lengths)
    want = [(0, 0, 4), (0, 1, 1), (0, 2, 1), (2, 0, 0), (2, 1, 2)]
    assert sorted(map(tuple, bags.bag_elements(ranges, ids).collect())) == want
    offsets = spark.createDataFrame([(0, 50), (1, 53), (2, 53), (3, 55)], "bag_no bigint, offset bigint")
    assert sorted(map(tuple, bags.bag_elements(bags.ranges_from_offsets(offsets), ids).collect())) == want
    ok = lambda l, i: bags.check_ranges(l, i, table).first().valid
    assert ok(lengths, ids)
    assert not ok(lengths.where("bag_id < 2"), ids)
    assert not ok(lengths.unionByName(lengths), ids)
    assert not ok(spark.createDataFrame([(0, 6), (1, -1)], lengths.schema), ids)
    for bad in (-1, 5):
        assert not ok(lengths, ids.withColumn("vec_id", F.when(F.col("flat") == 1, bad).otherwise(F.col("vec_id")).cast("bigint")))


def test_hot_range_is_cut(spark):
    """A range over several stretches between short ones; no row for an element is made from a range."""
    n = (1 << 16) * 2 + 5
    ranges = spark.createDataFrame([(3, 0, 4), (4, 4, 0), (7, 10, n), (8, n + 10, 3), (9, n + 13, 1 << 16)], "bag_id bigint, start bigint, length bigint")
    ids = spark.range(n + 13 + (1 << 16)).select(F.col("id").alias("flat"), (F.col("id") * 7).alias("vec_id"))
    found = bags.bag_elements(ranges, ids)
    rows = {r[0]: tuple(r)[1:] for r in found.groupBy("bag_id").agg(
        F.count("*"), F.min("pos"), F.max("pos"), F.countDistinct("pos"), F.min("vec_id"), F.max("vec_id")).collect()}
    assert rows == {b: (k, 0, k - 1, k, 7 * s, 7 * (s + k - 1)) for b, s, k in ((3, 0, 4), (7, 10, n), (8, n + 10, 3), (9, n + 13, 1 << 16))}
    for missing in (10, 70_000, n + 9):
        with pytest.raises(Exception, match="no id at"):
            bags.bag_elements(ranges, ids.where(F.col("flat") != missing)).collect()


def test_products(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(7, 5)), rng.normal(size=(5, 9))
    left = spark.createDataFrame([(i, k, float(a[i, k])) for i in range(7) for k in range(5)], "i int, k int, v double")
    right = spark.createDataFrame([(k, b[k].tolist()) for k in range(5)], "k int, row array<double>")
    got = np.zeros((7, 9))
    for r in linalg.matmul(left, right, 9).collect():
        got[r.i, r.j] = r.value
    assert np.allclose(got, a @ b)
    rows = spark.createDataFrame([(k, b[k].tolist()) for k in range(5)], "vec_id int, embedding array<double>")
    x = spark.createDataFrame([(k, float(k)) for k in range(5)], "vec_id int, x double")
    assert np.allclose([r.value for r in linalg.vecmat(x, rows, 9).orderBy("j").collect()], np.arange(5.0) @ b)
    v = spark.createDataFrame([([1.0] * 9,)], "v array<double>")
    assert np.allclose([r.value for r in linalg.matvec(rows, v).orderBy("vec_id").collect()], b.sum(axis=1))


@pytest.mark.parametrize("n, k, m, tile", [(7, 300, 5, 64), (None, 300, 5, 64), (7, 300, None, 64), (None, 300, None, 7), (1, 1, 1, 1), (4, 9, 8, 1000)])
def test_product_of_tiles(spark, n, k, m, tile):
    rng = np.random.default_rng(13)
    a, b = rng.normal(size=(n or 1, k)), rng.normal(size=(k, m or 1))
    rows = lambda x, names, drop: spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(x)], names).drop(*drop).repartition(5)
    left = rows(a, "i long, k long, v double", [] if n else ["i"])
    right = rows(b, "k long, j long, v double", [] if m else ["j"])
    got = linalg.matmul_tiled(left, right, tile)
    assert got.columns == ["i"] * bool(n) + ["j"] * bool(m) + ["value"]
    want = a @ b
    for r in got.collect():
        assert np.isclose(r.value, want[r.i if n else 0, r.j if m else 0])
    assert got.count() == want.size


def test_sketches_of_tests_are_united_without_the_lines(spark):
    rows = [(f"m{i % 3}", f"f{i % 5}", f"t{i % (900 + 300 * (i % 3))}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "method string, file string, test_name string")
    kept = logs.test_sketches(df, "method", "file")
    assert kept.count() == 15
    for r in logs.distinct_from_sketches(kept, "method").collect():
        exact = len({t for m, _, t in rows if m == r.method})
        assert abs(r.approx_tests - exact) <= 5 * logs.SKETCH_ERROR * exact
    everything = logs.distinct_from_sketches(kept).first().approx_tests
    assert abs(everything - len({t for *_, t in rows})) <= 5 * logs.SKETCH_ERROR * len({t for *_, t in rows})


def test_reductions(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 6.0), (1, 4.0), (2, nan), (2, 3.0)], "k int, x double")
    row = {r.k: r for r in df.groupBy("k").agg(*[reduce.reduction(n, "x").alias(n) for n in ("minimum", "maximum", "fmin", "fmax", "hypot", "add")]).collect()}
    assert math.isnan(row[2].minimum) and math.isnan(row[2].maximum) and row[2].fmin == 3.0 and row[2].fmax == 3.0
    assert row[1].minimum == 4.0 and math.isclose(row[1].hypot, math.hypot(6, 4)) and row[1].add == 10.0
    empty = df.limit(0).select(F.col("k").cast("bigint").alias("k"), "x")
    want = {"add": 0.0, "multiply": 1.0, "hypot": 0.0, "logical_and": True, "logical_or": False, "logical_xor": False, "minimum": None}
    assert empty.agg(*[reduce.reduction(n, "x").alias(n) for n in want]).first().asDict() == want
    assert empty.agg(*[reduce.reduction(n, "k").alias(n) for n in ("bitwise_and", "bitwise_or", "bitwise_xor")]).first() == (-1, 0, 0)
    big = spark.createDataFrame([(1000.0,), (1001.0,), (float("-inf"),)], "x double")
    assert math.isclose(reduce.logaddexp_reduce(big, "x").first().value, np.logaddexp.reduce([1000.0, 1001.0]))
    assert reduce.logaddexp_reduce(big.limit(0), "x").first().value == float("-inf")
    inf = float("inf")
    for values in ([1000.0, 400.0, 511.9, 512.0, -700.0], [-1e6, -1e6 - 1], [-inf, -inf], [inf, 3.0], [inf, float("nan")], [1e9, 1e9, 2.0]):
        row = reduce.logaddexp_reduce(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
        assert np.isclose(row.value, np.logaddexp.reduce(values), equal_nan=True) and np.isclose(row.value2, np.logaddexp2.reduce(values), equal_nan=True)
    ints = spark.createDataFrame([("a", 12), ("a", -18), ("b", 0), ("b", 7), ("c", None), ("c", 5)], "k string, x int")
    assert {r.k: r.value for r in reduce.gcd_reduce(ints, "k", "x").collect()} == {"a": 6, "b": 7, "c": 5}


@pytest.mark.parametrize("op", ["add", "subtract", "multiply", "divide", "maximum", "minimum", "fmax", "fmin"])
def test_scatter(spark, op):
    rng = np.random.default_rng(7)
    base = rng.normal(size=10)
    idx, u = rng.integers(0, 8, 60), rng.normal(size=60)
    u[5] = np.nan
    want = base.copy()
    getattr(np, op).at(want, idx, u)
    target = spark.createDataFrame([(i, float(x)) for i, x in enumerate(base)], "idx int, value double")
    updates = spark.createDataFrame([(int(i), float(x)) for i, x in zip(idx, u)], "idx int, u double")
    got = [r.value for r in scatter.scatter(target, updates, op).orderBy("idx").collect()]
    assert np.allclose(got, want, equal_nan=True)


def test_scatter_floor_divide(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(-(2**62), 2**62, 12)
    idx, u = rng.integers(0, 10, 400), rng.integers(1, 4, 400)
    idx = np.append(idx, [11])
    u = np.append(u, [0])
    want = base.copy()
    with np.errstate(all="ignore"):
        np.floor_divide.at(want, idx, u)
    target = spark.createDataFrame([(i, int(x)) for i, x in enumerate(base)], "idx int, value bigint")
    updates = spark.createDataFrame([(int(i), int(x)) for i, x in zip(idx, u)], "idx int, u bigint")
    assert [r.value for r in scatter.scatter(target, updates, "floor_divide").orderBy("idx").collect()] == want.tolist()


@pytest.mark.parametrize("kind, chunks", [("bigint", 1), ("bigint", 9), ("double", 9)])
def test_floor_divide_in_order_over_many_partitions(spark, kind, chunks):
    """A hot id spans most partitions; the order of its updates decides."""
    rng = np.random.default_rng(9)
    n = 3000
    idx = np.where(rng.random(n) < 0.6, 4, rng.integers(0, 12, n))
    whole = kind == "bigint"
    u = rng.choice([1, -1, 1, 1, -2, 3], n) if whole else rng.choice([0.5, -1.0, 1.5, -0.75, 1.0, 2.0, -4.0], n)
    base = rng.integers(-(2**62), 2**62, 12) if whole else rng.normal(size=12) * 1e6
    if whole:
        u[(idx == 4)] = rng.choice([1, -1], (idx == 4).sum())  # a long run that never comes to rest
        u[np.flatnonzero(idx == 7)[3]], base[2], base[4] = 0, -(2**63), -(2**63)
    want = base.copy()
    with np.errstate(all="ignore"):
        np.floor_divide.at(want, idx, u)
    rows = [(int(i), k, u[k].item()) for k, i in enumerate(idx)] + [(None, 5, u[0].item()), (3, 17, None)]
    updates = spark.createDataFrame(rows, f"idx int, at int, u {kind}").repartition(5)
    target = spark.createDataFrame([(i, x.item()) for i, x in enumerate(base)] + [(99, None)], f"idx int, value {kind}")
    of = "integer" if whole else "float"
    done = folds.ordered_fold(target, updates, ("at",), lambda x, y: num.floor_divide(x, y, of), chunks).orderBy("idx").collect()
    assert [r.value for r in done[:-1]] == want.tolist() and done[-1].value is None
    again = scatter.scatter(target, updates, "floor_divide", ("at",)).orderBy("idx").collect()
    assert again == done


def test_fractions_are_divided_down(spark):
    target = spark.createDataFrame([(1, 9.9), (2, 1.0), (3, -7.0), (4, 0.0)], "idx int, value double")
    updates = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, 2.0), (4, 0.0)], "idx int, u double")
    one, two, three, four = (r.value for r in scatter.scatter(target, updates, "floor_divide").orderBy("idx").collect())
    assert (one, two, three) == (19.0, float("inf"), -4.0) and math.isnan(four)


def test_exact_products_and_divisors_of_hot_groups(spark):
    rng = np.random.default_rng(10)
    values = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 3000) | 1, np.full(2000, 3), np.full(1000, -1)])
    keys = np.where(rng.random(len(values)) < 0.7, 1, rng.integers(0, 9, len(values)))
    df = spark.createDataFrame([(int(k), int(v)) for k, v in zip(keys, values)] + [(1, None), (50, None), (60, 0)], "k int, v long").repartition(6)
    got = {r.k: r.value for r in reduce.product_reduce(df, "v", "k").collect()}
    with np.errstate(all="ignore"):
        want = {int(k): int(np.multiply.reduce(values[keys == k])) for k in set(keys)}
    assert got == want | {60: 0}
    assert reduce.product_reduce(df.where("false"), "v", "k").collect() == []
    multiples = df.withColumn("v", F.col("v") % 1000 * 12)
    want = {}
    for r in multiples.collect():
        if r.v is not None:
            want[r.k] = math.gcd(want.get(r.k, 0), r.v)
    assert {r.k: r.value for r in reduce.gcd_reduce(multiples, "k", "v").collect()} == want
    target = spark.createDataFrame([(1, 2**62 + 1)], "idx int, value long")
    got = scatter.scatter(target, spark.createDataFrame([(1, 5), (1, 7)], "idx int, u long"), "multiply").first().value
    assert got == ((2**62 + 1) * 35 + 2**63) % 2**64 - 2**63


def test_integer_functions_at_the_ends(spark):
    least = -(2**63)
    ends = [least, least + 1, -1, 0, 1, 2, 6, -6, 2**62, 2**63 - 1, 10**12]
    pairs = [(a, b) for a in ends for b in ends]
    df = spark.createDataFrame(pairs, "a long, b long")
    a, b = F.col("a"), F.col("b")
    got = df.select(num.gcd(a, b), num.lcm(a, b), num.multiply_int(a, b), num.floor_divide_int(a, b), num.power_int(a, F.pmod(b, F.lit(40)) + 1)).collect()
    x, y = np.array(pairs).T
    with np.errstate(all="ignore"):
        want = zip(np.gcd(x, y).tolist(), np.lcm(x, y).tolist(), (x * y).tolist(), (x // y).tolist(), [(pow(p, q % 40 + 1, 2**64) + 2**63) % 2**64 - 2**63 for p, q in pairs])
    assert [tuple(r) for r in got] == list(want)


def test_extremes_and_sums_of_times_and_intervals(spark):
    df = spark.sql("select * from values (1, date'2020-01-05', interval '3' day), (1, date'2020-01-02', interval '-1' day), (1, null, null), (2, null, null) as t(k, d, i)")
    names = ("minimum", "maximum", "fmin", "fmax")
    row = {r.k: r for r in df.groupBy("k").agg(*[reduce.reduction(n, c).alias(f"{n}_{c}") for n in names for c in "di"], reduce.reduction("add", "i", "interval").alias("sum")).collect()}
    day = lambda n: datetime.timedelta(days=n)
    assert [row[1][f"{n}_d"].day for n in names] == [2, 5, 2, 5] and [row[1][f"{n}_i"] for n in names] == [day(-1), day(3), day(-1), day(3)]
    assert row[1]["sum"] == day(2) and row[2]["sum"] == day(0) and row[2]["minimum_d"] is None
    target = spark.sql("select 1 as idx, timestamp'2020-01-01 00:00:00' as value")
    done = scatter.scatter_all(target, spark.sql("select 1 as idx, interval '2' day as i union all select 1, interval '3' day"), {"add": ("add", "i"), "subtract": ("subtract", "i")}).first()
    assert done.add == datetime.datetime(2020, 1, 6) and done.subtract == datetime.datetime(2019, 12, 27)


def test_logaddexp_keeps_two_numbers_of_a_group(spark):
    rng = np.random.default_rng(11)
    values = np.concatenate([10.0 ** rng.uniform(-300, 300, 400), -(10.0 ** rng.uniform(-300, 300, 400)), np.arange(-3000, 3000, 7.5)])
    df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(values)], "x double, k int").repartition(4)
    found = reduce.logaddexp_reduce(df, "x", "k")
    for r in found.collect():
        own = values[np.arange(len(values)) % 3 == r.k]
        assert np.isclose(r.value, np.logaddexp.reduce(own), rtol=1e-12) and np.isclose(r.value2, np.logaddexp2.reduce(own), rtol=1e-12)
    small = reduce.logaddexp_reduce(df.where("abs(x) < 4000"), "x", "k")
    for r in small.collect():
        own = values[(np.arange(len(values)) % 3 == r.k) & (np.abs(values) < 4000)]
        assert np.isclose(r.value, np.logaddexp.reduce(own), rtol=1e-12) and np.isclose(r.value2, np.logaddexp2.reduce(own), rtol=1e-12)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()


def test_run_suites(spark):
    cases = {
        "pass": ("def f(x): return x", ["assert f(1) == 1"], "humaneval", True, None),
        "fail": ("def f(x): return 2", ["assert f(1) == 1"], "humaneval", False, "AssertionError"),
        "syntax": ("def f(x: return", ["pass"], "humaneval", False, "SyntaxError"),
        "loop": ("while True: pass", [], "generic", False, "TimeoutExpired"),
        "exit": ("import sys; sys.exit(0)", [], "generic", False, "SystemExit"),
        "hard exit": ("import os; os._exit(0)", [], "generic", False, "ProcessError"),
        "blank": ("  ", [], "humaneval", False, "SyntaxError"),
        "blank import": ("", [], "import", False, "EmptyCodeError"),
        "only fences": ("\n```", [], "import", False, "EmptyCodeError"),
        "defines check": ("def f(x): return 2", ["def check(c): assert c(1) == 1"], "humaneval", True, None),
        "mbpp second": ("x = 1", ["assert x == 1", "assert x == 2"], "mbpp", False, "AssertionError"),
        "fenced": ("```python\nimport math\n```", [], "import", True, None),
        "import error": ("import no_such_module_here", [], "import", False, "ModuleNotFoundError"),
        "memory": ("x = 'a' * (1 << 33)", [], "generic", False, "MemoryError"),
    }
    rows = [(k, c, t, s, "f") for k, (c, t, s, _, _) in cases.items()]
    df = spark.createDataFrame(rows, "key string, code string, tests array<string>, suite string, entry_point string")
    with pytest.raises(PermissionError):
        suites.run_suites(df, ["key"])
    got = {r.key: r for r in suites.run_suites(df, ["key"], timeout_s=2.0, partitions=4, allow_exec=True).collect()}
    assert {k: (r.passed, r.error_type) for k, r in got.items()} == {k: c[3:] for k, c in cases.items()}
    assert got["mbpp second"].error.startswith("Test case 2 failed") and got["blank"].error == "SYNTAX ERROR"
    assert got["blank import"].error == suites.EMPTY_CODE and got["only fences"].error == suites.EMPTY_AFTER_CLEANING
    assert got["loop"].error == suites.TIMEOUT and got["pass"].execution_time >= 0 and got["pass"].test_type == "humaneval"
    strict = {r.key: r.passed for r in suites.run_suites(df.where("key = 'defines check'"), ["key"], strict=True, partitions=1, allow_exec=True).collect()}
    assert strict == {"defines check": False}


def test_screen_syntax(spark):
    df = spark.createDataFrame([("a", "x = 1"), ("b", "x ="), ("c", " \n"), ("d", None), ("e", "x = '\x00'")], "k string, code string")
    assert {r.k: r.code for r in suites.screen_syntax(df, "code").collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False}


def test_latest_run(spark):
    rows = [("m", 50.0, 1, 2, dt.datetime(2025, 1, 1)), ("m", 100.0, 2, 2, dt.datetime(2025, 1, 2))]
    df = spark.createDataFrame(rows, "benchmark string, pass_rate double, passed_examples int, total_examples int, timestamp timestamp_ntz")
    text = metrics.report(metrics.latest_runs(df)).first().report
    assert text == "M:\n  Pass Rate: 100.00%\n  Passed: 2/2\n  Timestamp: 2025-01-02T00:00:00"


@pytest.mark.parametrize("width", [1, 31, 32, 33, 40, 64, 65])
def test_pool_keeps_every_dimension_in_place(spark, width):
    rows = [(1, [float(i) for i in range(width)]), (1, [None if i == 3 else 1.0 for i in range(width)]), (2, [None if i in (0, width - 1) else 2.0 for i in range(width)])]
    df = spark.createDataFrame(rows, "bag_id long, v array<double>")
    got = {r.bag_id: r.pooled for r in bags.pool(df, F.col("v"), width).collect()}
    assert got[1] == [float(i) + (0.0 if i == 3 else 1.0) for i in range(width)]
    assert got[2] == [None if i in (0, width - 1) else 2.0 for i in range(width)]
    for wrong in (width + 1, width + 32):
        with pytest.raises(Exception, match="dimensions"):
            bags.pool(df, F.col("v"), wrong).collect()


def test_bags_report_or_refuse_what_is_missing(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<double>")
    elements = spark.createDataFrame([(7, 0, 0), (7, 9, 1), (8, 1, 5)], "bag_id long, vec_id long, pos long")
    with pytest.raises(Exception, match="no vector or weight"):
        bags.embedding_bag(elements, table, 2, mean=True).collect()
    listed = spark.createDataFrame([(7,), (8,), (9,)], "bag_id long")
    got = sorted(map(tuple, bags.embedding_bag(elements, table, 2, mean=True, bad="report", bags=listed).collect()))
    assert got == [(7, None, 1), (8, [3.0, 4.0], 0), (9, [0.0, 0.0], 0)]
    weights = spark.createDataFrame([(0, 1.0), (1, 1.0)], "pos long, weight double")
    weighted = bags.positional_weights(elements.where("bag_id = 8"), weights)
    with pytest.raises(Exception, match="no vector or weight"):
        bags.embedding_bag(weighted, table, 2, weight=F.col("weight")).collect()
    gap = spark.createDataFrame([(0, 0), (1, 2), (3, 4)], "bag_no long, offset long")
    with pytest.raises(Exception, match="dense"):
        bags.ranges_from_offsets(gap).collect()
    with pytest.raises(Exception, match="no id at"):
        bags.bag_elements(bags.ranges_from_offsets(gap.where("bag_no < 3")), spark.createDataFrame([(0, 5)], "flat long, vec_id long")).collect()


def test_repeated_elements_of_a_bag(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [10.0, 20.0])], "vec_id long, embedding array<double>")
    rows = [(1, 0, 2.0)] * 50 + [(1, 1, -1.0), (2, 0, 1.0), (2, 0, None), (3, 7, 1.0), (3, 7, None), (3, 0, None), (4, None, 1.0)]
    elements = spark.createDataFrame(rows, "bag_id long, vec_id long, weight double")
    assert bags.combined(elements, F.col("weight")).where("bag_id < 3").count() == 3
    got = sorted(map(tuple, bags.embedding_bag(elements, table, 2, weight=F.col("weight"), mean=True, bad="report").collect()))
    assert got == [(1, [90 / 51, 180 / 51], 0), (2, None, 1), (3, None, 3), (4, None, 1)]
    codes = spark.createDataFrame([(0, 2.0, 1.0, [1, 2]), (1, None, 0.0, [1, 1])], "vec_id long, scale double, bias double, q array<int>")
    assert bags.quantized_bag(elements.where("bag_id = 1 and vec_id = 0"), codes, 2, weight=F.col("weight")).first().pooled == [300.0, 500.0]
    for bad in ("bag_id = 1", "bag_id = 2"):
        with pytest.raises(Exception, match="no vector or weight"):
            bags.quantized_bag(elements.where(bad), codes, 2, weight=F.col("weight")).collect()


def _long_spans(spark):
    """300,000 intervals of 7 years: some 2.1 million years, where an interval holds 292,000. Also their sum in microseconds."""
    return spark.range(300_000).select(F.lit(1).alias("idx"), F.expr("interval '2555 00:00:00.000001' day to second").alias("i")), 300_000 * (2555 * 86_400_000_000 + 1)


def test_sums_of_intervals_beyond_any_interval(spark):
    rows, micros = _long_spans(spark)
    total = lambda rows, of: rows.agg(reduce.reduction("add", "i", of).alias("sum")).first()["sum"]
    assert total(rows, "micros") == micros and total(rows.limit(0), "micros") == 0
    # Sums that end within an interval may leave it on the way.
    assert total(rows.unionByName(rows.select("idx", (-F.col("i")).alias("i"))), "interval") == datetime.timedelta(0)


def test_scatter_of_intervals_beyond_any_interval(spark):
    rows, micros = _long_spans(spark)
    target, day = spark.sql("select 1 as idx, interval '1' day as value union all select 2, interval '1' day"), 86_400_000_000
    done = scatter.scatter_all(target, rows, {"add": ("add_micros", "i"), "subtract": ("subtract_micros", "i"), "top": ("maximum", "i")}).orderBy("idx").collect()
    assert [(r.add, r.subtract, r.top.days) for r in done] == [(day + micros, day - micros, 2555), (day, day, 1)]
    both = rows.unionByName(rows.select("idx", (-F.col("i")).alias("i")))
    assert scatter.scatter_all(target, both, {"value": ("add", "i")}).orderBy("idx").first().value == datetime.timedelta(days=1)


def test_only_code_that_runs_gets_a_process_and_none_sees_another(spark):
    pid = "import os, sys; raise ValueError('%d %s' % (os.getpid(), hasattr(sys, 'left')))"
    codes = [pid, *["x = ("] * 60, "import sys; sys.left = 1", "-" * 100000 + "1", "import os; os.kill(os.getppid(), 9)", pid, *["x = '" + "q" * 200000] * 3, pid, "y = 1"]
    rows = spark.createDataFrame([(i, c, [], "generic", "f") for i, c in enumerate(codes)], "id int, code string, tests array<string>, suite string, entry_point string")
    got = [r for r in suites.run_suites(rows.coalesce(1).sortWithinPartitions("id"), ["id"], partitions=1, allow_exec=True).orderBy("id").collect()]
    first, second, third = (got[i].error.split() for i in (0, 64, 68))
    assert [r.error_type for r in got[1:61]] == ["SyntaxError"] * 60 and got[61].passed and got[-1].passed
    assert first[1] == second[1] == third[1] == "False" and len({first[0], second[0], third[0]}) == 3
    assert not got[62].passed and got[63].error_type == "ProcessError"
    # A process for each error of syntax would lie between these.
    assert (int(second[0]) - int(first[0])) % (1 << 22) < 40
