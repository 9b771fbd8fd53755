"""Mixing of sources by temperature.

Weights are token shares raised to an exponent between 0 (all sources alike)
and 1 (as they are). The exponent is narrowed down, some thirty probes at a
time in one aggregate over the sources, until a target entropy or a limit on
repetition is met. Each source then gets its weight of the token budget: whole
epochs of all its documents, and of the last epoch as many of its blocks, in
that epoch's own order, as the budget holds; the block at the end is cut
between documents. No source is ever sorted or gathered in one task: documents
are dealt to blocks by hash, and only sums of blocks are put in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradespark.llm.common import settled

#: Documents of a block of the largest source, on average.
BLOCK = 2048
#: So many rows on blocks, of some hundred bytes each, are broadcast.
BROADCAST_BLOCKS = 50_000
PROBES, ROUNDS = 31, 6
#: A source may be read so many times more often than the one read least.
REPEATS = 2.0
SEED = 17


def token_count(text: str) -> Column:
    """Words of a text and one for its end, so that every document weighs something."""
    return (F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)) + 1).cast("bigint")


def _dealt(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What mixing needs to know of a row: source (null is one of its own), weight, and a hash of its content."""
    source = F.col(source_col).cast("string")
    return {
        "_mix_source": F.coalesce(F.concat(F.lit("="), source), F.lit("")),
        "_mix_tokens": token_count(text_col),
        "_mix_hash": F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text_col)),
    }


def choose_exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: int | None = None) -> float:
    """The exponent for ``sources`` ``(_mix_source, tokens)``.

    ``entropy`` (as a share of the largest possible): the largest exponent whose
    weights have at least that much. ``repeats``: the smallest exponent at which
    no source is read more often than that. With both, the limit on repetition comes first.
    ``budget`` None stands for the smallest that reads every source once.
    """
    total, kinds = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not total or kinds < 2 or (entropy is None and repeats is None):
        return 1.0
    shares = sources.select((F.col("tokens") / F.lit(float(total))).alias("p"))

    def met(exponents: list[float]) -> list[tuple[bool, bool]]:
        """For each exponent: entropy reached; repetition within the limit."""
        power = [F.pow("p", F.lit(a)) for a in exponents]
        parts = [x for a, q in zip(exponents, power) for x in (F.sum(q), F.sum(q * F.log("p")), F.max(q / F.col("p")), F.min(q / F.col("p")))]
        row, out = shares.agg(*[x.alias(f"c{k}") for k, x in enumerate(parts)]).first(), []
        for k, a in enumerate(exponents):
            z, zlog, most, least = row[4 * k : 4 * k + 4]
            most_read = most / least if budget is None else budget / total * most / z
            out.append((entropy is None or (math.log(z) - a * zlog / z) / math.log(kinds) >= entropy, repeats is None or most_read <= repeats))
        return out

    def bound(which: int, low: float, high: float) -> tuple[float, float]:
        """Narrow the place where the condition changes; both are monotonic."""
        for _ in range(ROUNDS):
            points = [low + (high - low) * (k + 1) / (PROBES + 1) for k in range(PROBES)]
            fine = [m[which] for m in met(points)]
            if which == 0:  # holds up to a point
                n = sum(fine)
                low, high = (points[n - 1] if n else low), (points[n] if n < PROBES else high)
            else:  # holds from a point on
                n = PROBES - sum(fine)
                low, high = (points[n - 1] if n else low), (points[n] if n < PROBES else high)
        return low, high

    at_ends = met([0.0, 1.0])
    flat = 0.0 if at_ends[0][1] else bound(1, 0.0, 1.0)[1]
    if entropy is None:
        return flat
    shaped = 1.0 if at_ends[1][0] else bound(0, 0.0, 1.0)[0]
    return max(flat, shaped)


def plan_mixture(
    docs: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, budget: int | None = None, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame, float]:
    """Sources with their weights and budgets, the blocks of each epoch with what is taken of them, and the exponent."""
    narrow = docs.select(*[c.alias(n) for n, c in _dealt(docs, id_col, text_col, source_col).items()])
    rows = settled(narrow)
    sources = settled(rows.groupBy("_mix_source").agg(F.sum("_mix_tokens").alias("tokens"), F.count("*").alias("docs")))
    exponent = choose_exponent(sources, entropy, repeats, budget)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent))
    scale, rate = sources.agg(F.sum(power), F.min(power / F.col("tokens"))).first()
    amount = budget if budget is not None else math.ceil((scale or 1.0) / (rate or 1.0) - 1e-6)
    sources = sources.withColumn("weight", power / F.lit(scale or 1.0)).withColumn("budget", F.round(F.col("weight") * F.lit(float(amount))).cast("bigint"))
    sources = sources.withColumn("full", F.expr("budget div tokens")).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens"))
    # As many blocks for every source: a document's block is known without meeting its source.
    most = sources.agg(F.max("docs")).first()[0] or 1
    sources = settled(sources.withColumn("blocks", F.lit(-(-most // block))))
    blocks = rows.groupBy("_mix_source", F.pmod("_mix_hash", F.lit(-(-most // block))).alias("_mix_block")).agg(F.sum("_mix_tokens").alias("size"))
    blocks = blocks.join(sources.select("_mix_source", "tokens", "budget", "full", "rest"), "_mix_source")
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), "full")))
    # Every epoch has its own order of blocks; only one row for each block is put in order.
    turn = Window.partitionBy("_mix_source", "epoch").orderBy(F.xxhash64(F.lit(SEED), "epoch", "_mix_block"), "_mix_block")
    before = F.coalesce(F.sum("size").over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("before", before).withColumn(
        "take", F.when(F.col("epoch") < F.col("full"), F.col("size")).otherwise(F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))))
    place = (F.col("epoch") * F.col("tokens") + F.col("before")) / F.col("budget")
    blocks = blocks.where("take > 0").select("_mix_source", "_mix_block", F.col("epoch").alias("_mix_epoch"), F.col("size").alias("_mix_size"),
                                             F.col("take").alias("_mix_take"), place.alias("_mix_at"))
    return sources, settled(blocks), exponent


def mix(
    docs: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, budget: int | None = None, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``docs`` with a row for every time a document is read, and ``_mix_epoch``, ``_mix_block``, ``_mix_at``, ``_mix_tokens``.

    ``_mix_at`` (0 to 1) is where the document's block begins in its source's
    stream; sorting by it lays the sources out in proportion. A source's tokens
    exceed its budget by less than one document. Without ``budget`` the mixture
    is the smallest that leaves no document out. Documents without words weigh
    one token; null sources are one source, null ids and texts are values like
    any other, and equal rows take each other's place. An empty table gives no rows.
    """
    sources, blocks, _ = plan_mixture(docs, entropy, repeats, budget, block, id_col, text_col, source_col)
    count = sources.agg(F.max("blocks")).first()[0] or 1
    rows = docs.withColumns(_dealt(docs, id_col, text_col, source_col)).withColumn("_mix_block", F.pmod("_mix_hash", F.lit(count)))
    # Few blocks go to the documents; many meet them by source and block, which spreads a large source as well.
    few = blocks.count() <= BROADCAST_BLOCKS
    taken = rows.join(F.broadcast(blocks) if few else blocks, ["_mix_source", "_mix_block"])
    out = [*docs.columns, "_mix_epoch", "_mix_block", "_mix_at", "_mix_tokens"]
    whole = taken.where("_mix_take = _mix_size").select(*out)
    # At the end of a budget: the documents of one block, in the epoch's order, until it is full.
    order = Window.partitionBy("_mix_source", "_mix_epoch", "_mix_block").orderBy(F.xxhash64(F.lit(SEED), "_mix_epoch", "_mix_hash"), "_mix_hash", id_col)
    start = F.coalesce(F.sum("_mix_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = taken.where("_mix_take < _mix_size").withColumn("_mix_start", start).where("_mix_start < _mix_take").select(*out)
    return whole.unionByName(cut)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, source, epoch, block, at, n_tokens)``: the mixture without the texts' other columns."""
    rows = mix(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source")), **options)
    return rows.select("doc_id", "source", F.col("_mix_epoch").alias("epoch"), F.col("_mix_block").alias("block"),
                       F.col("_mix_at").alias("at"), F.col("_mix_tokens").alias("n_tokens"))
