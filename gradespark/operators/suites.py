"""Syntax screen and test suites for tables of completions.

``screen_syntax`` only compiles. ``run_suites`` executes untrusted code and
must be switched on by the caller; every row that runs does so in its own child process
with limits on time, memory and files, an empty environment and no input.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradespark.functions.text import dedent, is_blank, strip, strip_code_fences

VERDICT = (
    "passed boolean, error string, error_type string, execution_time double, test_type string"
)

# Error texts of rows that never run.
EMPTY_CODE = "EmptyCodeError: код пуст"
EMPTY_AFTER_CLEANING = "EmptyCodeError: код пуст после удаления ограждений/выравнивания"
TIMEOUT = "TimeoutExpired: проверка кода заняла слишком много времени"
SYNTAX_ERROR = "SYNTAX ERROR"

# One clean interpreter per task reads jobs as JSON lines; a fork of it compiles them and forks for each that runs.
_RUNNER = r"""
import json, os, resource, select, signal, sys, time, traceback

def limit(kind, value):
    resource.setrlimit(kind, (value, value))

ENDED = {"passed": False, "error": "process ended early", "error_type": "ProcessError", "execution_time": None}

def send(pipe, answer):
    while answer:
        answer = answer[os.write(pipe, answer):]

def execute(job, code):
    out = {"passed": False, "error": None, "error_type": None, "execution_time": None}
    space = {"__name__": "generated_module", "__builtins__": __builtins__}
    at = 0
    try:
        begin = time.time()
        exec(code, space)
        for at, test in enumerate(job["tests"], 1):
            exec(test, space)
        out["passed"] = True
        out["execution_time"] = time.time() - begin
    except BaseException as e:
        out["error"] = traceback.format_exc() if job["suite"] == "import" else str(e)
        out["error_type"] = type(e).__name__
        if job["suite"] == "mbpp" and at:
            out["error"] = "Test case %d failed: %s" % (at, e)
    return out

BASE = json.loads(sys.argv[1])

# The code, or the verdict on what is none.
def compiled(job):
    try:
        return compile(job["code"], "<string>", "exec"), None
    except SyntaxError as e:
        error = "SyntaxError: %s" % e if job["suite"] == "import" else job["syntax_error"]
        return None, {"passed": False, "error": error, "error_type": "SyntaxError", "execution_time": None}

# Runs the code in a process of its own, under the limits that it inherits.
def supervise(job, code, end, *shut):
    reader, writer = os.pipe()
    pid = os.fork()
    if pid == 0:
        try:
            os.setsid()
            for fd in (reader, *shut):
                os.close(fd)
            send(writer, json.dumps(execute(job, code)).encode())
            os._exit(0)
        finally:
            os._exit(1)
    os.close(writer)
    data, late = b"", False
    while True:
        ready, _, _ = select.select([reader], [], [], max(0.0, end - time.time()))
        if not ready:
            late = True
            break
        piece = os.read(reader, 65536)
        if not piece:
            break
        data += piece
    for kill, who in ((os.killpg, pid), (os.kill, pid)):
        try:
            kill(who, signal.SIGKILL)
        except OSError:
            pass
    os.waitpid(pid, 0)
    os.close(reader)
    if late:
        return dict(ENDED, error=job["late"], error_type="TimeoutExpired")
    try:
        return json.loads(data)
    except ValueError:
        return ENDED

# A process under limits that compiles job after job and forks for each that runs:
# what only the compiler has touched need not be copied. It is replaced where the
# compiler fails, and now and then: the first byte of an answer says if it stays (S) or ends (E).
def compiler(jobs, answers):
    limit(resource.RLIMIT_CPU, int(BASE["timeout"]) + 2)
    limit(resource.RLIMIT_AS, BASE["memory"])
    limit(resource.RLIMIT_FSIZE, 1 << 20)
    limit(resource.RLIMIT_NOFILE, 64)
    null = os.open(os.devnull, os.O_RDWR)
    for fd in (0, 1, 2):
        os.dup2(null, fd)
    for line in open(jobs, "rb"):
        end = time.time() + BASE["timeout"]
        job = dict(BASE, **json.loads(line))
        code, verdict = compiled(job)
        if verdict is None:
            verdict = supervise(job, code, end, jobs, answers)
        stays = len(line) < 1 << 20 and time.process_time() < 1
        send(answers, (b"S" if stays else b"E") + json.dumps(verdict).encode() + b"\n")
        if not stays:
            break
    os._exit(0)

def start():
    jobs, give = os.pipe()
    reader, answers = os.pipe()
    pid = os.fork()
    if pid == 0:
        try:
            os.close(give)
            os.close(reader)
            compiler(jobs, answers)
        finally:
            os._exit(1)
    os.close(jobs)
    os.close(answers)
    os.set_blocking(give, False)
    return pid, give, reader

# The verdict on a job as a line, and the compiling process if that stays.
def judge(line, process):
    process = process or start()
    pid, give, reader = process
    # Later than the process itself stops what it runs: only the compiler takes longer.
    end, data, late = time.time() + BASE["timeout"] + 1, b"", False
    while data[-1:] != b"\n":
        ready, free, _ = select.select([reader], [give] if line else [], [], max(0.0, end - time.time()))
        if not ready and not free:
            late = True
            break
        if free:
            try:
                line = line[os.write(give, line):]
            except OSError:
                line = b""
        if ready:
            piece = os.read(reader, 65536)
            if not piece:
                break
            data += piece
    if data[:1] != b"S" or data[-1:] != b"\n":
        os.kill(pid, signal.SIGKILL)
        os.waitpid(pid, 0)
        os.close(give)
        os.close(reader)
        process = None
    if data[-1:] == b"\n":
        return data[1:], process
    return json.dumps(dict(ENDED, error=BASE["late"], error_type="TimeoutExpired") if late else ENDED).encode() + b"\n", process

limit(resource.RLIMIT_CORE, 0)
# The compiler and the traceback printer set themselves up on first use; doing
# that here spares every child the work.
for sample in ("assert 1 + 1 == 2", "assert 1 == 2", "x = "):
    job = {"code": sample, "tests": [sample], "suite": "import"}
    code, verdict = compiled(job)
    if verdict is None:
        execute(job, code)
process = None
for line in sys.stdin.buffer:
    verdict, process = judge(line, process)
    sys.stdout.buffer.write(verdict)
    sys.stdout.buffer.flush()
"""


def screen_syntax(rows: DataFrame, *columns: str) -> DataFrame:
    """Replace each text column by whether it compiles.

    Blank or missing text does not count as code. Nothing is executed.
    """
    types = ["boolean" if c in columns else t for c, t in rows.dtypes]
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(rows.columns, types))

    def screen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import warnings

        def compiles(text) -> bool:
            if text is None or not text.strip():
                return False
            try:
                compile(text, "<string>", "exec")
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return False
            return True

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            for batch in batches:
                yield batch.assign(**{c: [compiles(t) for t in batch[c]] for c in columns})

    return rows.mapInPandas(screen, schema)


def run_suites(
    rows: DataFrame,
    keys: Sequence[str],
    *,
    timeout_s: float = 5.0,
    memory_mb: int = 1024,
    strict: bool = False,
    partitions: int | None = None,
    allow_exec: bool = False,
) -> DataFrame:
    """Keys and verdict of each row of (keys..., code, tests ARRAY, suite, entry_point).

    Suites: ``humaneval`` and ``mbpp`` run the code, then each test text, in
    one namespace; ``import`` only runs the cleaned code; any other name gives
    the generic runner's result. As published, a test text that merely
    defines ``check`` passes; ``strict`` also calls it with the entry point.
    A timeout or an exit of the process is a failure.
    """
    if not allow_exec:
        raise PermissionError("run_suites executes the given code; pass allow_exec=True to agree")
    cleaned = strip(dedent(strip_code_fences(F.col("code"))))
    importing = F.col("suite") == "import"
    calls = F.when(
        F.lit(strict) & (F.col("suite") == "humaneval"),
        F.array(F.concat(F.lit("check("), F.col("entry_point"), F.lit(")"))),
    ).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    jobs = rows.select(
        *keys,
        F.when(importing, cleaned).otherwise(F.col("code")).alias("code"),
        F.when(importing, none).otherwise(F.concat(F.coalesce("tests", none), calls)).alias("tests"),
        "suite",
        # Rows without code get their verdict here and never start a process.
        F.when(is_blank(F.col("code")), F.when(importing, EMPTY_CODE).otherwise(SYNTAX_ERROR))
        .when(importing & is_blank(cleaned), EMPTY_AFTER_CLEANING)
        .alias("_empty"),
    )
    verdict = [f.split(" ")[0] for f in VERDICT.split(", ")]
    base = {
        "timeout": timeout_s, "memory": memory_mb << 20, "late": TIMEOUT, "syntax_error": SYNTAX_ERROR,
    }
    runner = _RUNNER

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json
        import subprocess
        import sys
        import tempfile

        import pandas as pd

        with tempfile.TemporaryDirectory() as scratch:
            process = subprocess.Popen(
                [sys.executable, "-I", "-S", "-c", runner, json.dumps(base)], cwd=scratch, env={},
                stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL,
            )
            try:
                for batch in batches:
                    answers = []
                    for code, tests, suite, empty in zip(
                        batch["code"], batch["tests"], batch["suite"], batch["_empty"]
                    ):
                        if isinstance(empty, str):
                            kind = "EmptyCodeError" if suite == "import" else "SyntaxError"
                            answers.append({"passed": False, "error": empty, "error_type": kind})
                            continue
                        job = dict(code=code, tests=list(tests), suite=suite)
                        process.stdin.write(json.dumps(job).encode() + b"\n")
                        process.stdin.flush()
                        answers.append(json.loads(process.stdout.readline()))
                    found = pd.DataFrame(answers, columns=verdict[:-1], index=batch.index)
                    yield pd.concat([batch[list(keys)], found, batch["suite"].rename("test_type")], axis=1)
            finally:
                process.kill()
                process.wait()

    # Rows are dealt out evenly: neither one task's slow rows nor a hot key
    # hold up a partition.
    n = partitions or 2 * rows.sparkSession.sparkContext.defaultParallelism
    types = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [VERDICT])
    return jobs.repartition(n).mapInPandas(run, schema)


def syntax_metrics(verdicts: DataFrame, *groups: str) -> DataFrame:
    """Shares of valid and importable code from (valid BOOLEAN, importable BOOLEAN)."""
    return verdicts.groupBy(*groups).agg(
        F.avg(F.col("valid").cast("double")).alias("is syntactically_valid"),
        F.avg(F.col("importable").cast("double")).alias("is_importable"),
    )
