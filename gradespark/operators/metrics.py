"""Scores of completions and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradespark.functions.text import strip

# Uniform weights over 1- to 4-grams, and the smoothing constant
# that replaces a zero count.
BLEU_ORDER = 4
BLEU_EPSILON = 0.1

_SPACES = r"(?U)[\s\x1c-\x1f]+"


def tokens(text: Column) -> Column:
    """``str.split()`` as an array."""
    return F.array_remove(F.split(text, _SPACES, -1), "")


_WORDS = [f"_t{i}" for i in range(BLEU_ORDER)]


def _windows(rows: DataFrame, words: str, *keep: str) -> DataFrame:
    """A row (keep..., _t0.._t3) for each token and the three behind it.

    Shifting the array by 1, 2 and 3 and zipping gives all windows in linear
    time. Every text, even an empty one, also gives the window ``""``.
    """
    w = F.col(words)
    shifted = [w] + [F.slice(w, i + 1, F.size(w)) for i in range(1, BLEU_ORDER)]
    zipped = F.arrays_zip(*[s.alias(n) for s, n in zip(shifted, _WORDS)])
    nothing = F.lit(None).cast("string")
    mark = F.struct(F.lit("").alias("_t0"), *[nothing.alias(n) for n in _WORDS[1:]])
    return rows.select(*keep, F.inline(F.concat(F.array(mark), zipped)).alias(*_WORDS))


def _ngrams(windows: DataFrame, *keep: str) -> DataFrame:
    """The 1- to 4-gram that starts each window, as (keep..., gram).

    Tokens hold no blanks, so joining them by one blank is unambiguous and the
    number of blanks tells the length.
    """
    grams: list[Column] = []
    parts: list[Column] = []
    for name in _WORDS:
        # concat is NULL where the window runs over the end.
        parts = [*parts, F.lit(" "), F.col(name)] if parts else [F.col(name)]
        grams.append(F.concat(*parts))
    return windows.select(*keep, F.explode(F.array(*grams)).alias("gram")).where(F.col("gram").isNotNull())


def bleu(pairs: DataFrame, references: DataFrame) -> DataFrame:
    """Smoothed sentence BLEU-4 of each pair, as (pair_id, bleu); every pair has a row.

    Without a candidate, a known reference or a common word it is 0.0. Ids of pairs are unique.
    ``pairs``: (pair_id, reference_id, candidate), ``references``:
    (reference_id, reference). Only n-grams that occur in the reference can
    count. So the candidate's windows first meet the tokens of the reference,
    what is left becomes n-grams, and these meet the counted n-grams of the
    reference before anything is aggregated. The window ``""`` of each text
    brings the two lengths along, which saves a second pass over the texts.
    """
    refs = references.select("reference_id", tokens(F.col("reference")).alias("_ref"))
    refs = _windows(refs.withColumn("_r", F.size("_ref")), "_ref", "reference_id", "_r")
    ref_counts = (
        _ngrams(refs, "reference_id", "_r")
        .groupBy("reference_id", "gram")
        .agg(F.count("*").alias("_in_ref"), F.max("_r").alias("_r"))
    )
    ref_tokens = refs.select("reference_id", "_t0").distinct()
    cands = pairs.select("pair_id", "reference_id", tokens(F.col("candidate")).alias("_cand"))
    cands = _windows(cands.withColumn("_h", F.size("_cand")), "_cand", "pair_id", "reference_id", "_h")
    cands = cands.join(ref_tokens, ["reference_id", "_t0"], "left_semi")
    # Each distinct n-gram of a pair once, then its clipped count.
    gram = F.col("gram")
    order = F.length(gram) - F.length(F.replace(gram, F.lit(" "), F.lit(""))) + 1
    counted = (
        _ngrams(cands, "pair_id", "reference_id", "_h")
        .join(ref_counts, ["reference_id", "gram"])
        .groupBy("pair_id", "gram")
        .agg(
            F.count("*").alias("_in_cand"), F.max("_in_ref").alias("_in_ref"),
            F.max("_h").alias("_h"), F.max("_r").alias("_r"),
        )
        .withColumn("_n", F.when(gram == "", 0).otherwise(order))
        .withColumn("_hits", F.least("_in_cand", "_in_ref"))
    )
    scored = counted.groupBy("pair_id").agg(
        F.max("_h").alias("_h"),
        F.max("_r").alias("_r"),
        *[
            F.coalesce(F.sum(F.when(F.col("_n") == n, F.col("_hits"))), F.lit(0)).alias(f"_m{n}")
            for n in range(1, BLEU_ORDER + 1)
        ],
    )
    h, r = F.col("_h"), F.col("_r")
    log_precision = F.lit(0.0)
    for n in range(1, BLEU_ORDER + 1):
        matched = F.col(f"_m{n}").cast("double")
        hits = F.when(matched == 0, F.lit(BLEU_EPSILON)).otherwise(matched)
        log_precision = log_precision + F.log(hits / F.greatest(h - (n - 1), F.lit(1))) / BLEU_ORDER
    brevity = F.when(h > r, F.lit(0.0)).otherwise(1 - F.try_divide(r.cast("double"), h))
    scored = scored.select(
        "pair_id",
        F.when(F.col("_m1") == 0, F.lit(0.0)).otherwise(F.exp(log_precision + brevity)).alias("bleu"),
    )
    return pairs.select("pair_id").join(scored, "pair_id", "left").withColumn("bleu", F.coalesce("bleu", F.lit(0.0)))


def exact_match(reference: Column, candidate: Column) -> Column:
    """1 if the texts are equal but for outer whitespace, else 0."""
    return (strip(reference) == strip(candidate)).cast("int")


def termination(completions: DataFrame, *groups: str, code: str = "code") -> DataFrame:
    """Termination ratio per group.

    ``termination_ratio`` is the published placeholder, which counts every
    completion. ``ends_cleanly`` is the share that its heuristic describes:
    the last line is empty, a return, or closes a docstring.
    """
    last_line = strip(F.element_at(F.split(strip(F.col(code)), "\n", -1), -1))
    clean = (last_line == "") | last_line.startswith("return ") | last_line.startswith('"""')
    return completions.groupBy(*groups).agg(
        F.count("*").alias("completions"),
        F.when(F.count("*") > 0, 1.0).otherwise(0.0).alias("termination_ratio"),
        F.try_divide(F.count_if(clean).cast("double"), F.count("*")).alias("ends_cleanly"),
    )


def run_timing(durations: DataFrame, *groups: str, seconds: str = "seconds") -> DataFrame:
    """Total and average seconds per problem."""
    return durations.groupBy(*groups).agg(
        F.sum(seconds).alias("total_time"),
        F.try_divide(F.sum(seconds), F.count("*")).alias("avg_time_per_problem"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each benchmark; a later run replaces an earlier one."""
    fields = [c for c in runs.columns if c != "benchmark"]
    latest = runs.groupBy("benchmark").agg(
        F.max_by(F.struct(*fields), F.col("timestamp")).alias("_run")
    )
    return latest.select("benchmark", "_run.*")


def report(runs: DataFrame) -> DataFrame:
    """Add the summary text of each run: rate, passed of total, time."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.format_string(
        "%s:\n  Pass Rate: %.2f%%\n  Passed: %d/%d\n  Timestamp: %s",
        F.upper("benchmark"), "pass_rate", "passed_examples", "total_examples", stamp,
    )
    return runs.withColumn("report", text)
