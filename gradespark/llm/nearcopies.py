"""Classes of near-copies by SimHash and the Jaccard similarity of their word shingles.

Every whole text becomes its set of hashed shingles; equal sets are merged.
Candidates are sets whose SimHash fingerprints link (``simhash.links``, tiles
of fingerprints). A similarity of 0.8 means about ten differing bits, more than
tiles can compare in a large table, so MinHash bands propose candidates too:
two sets of similarity 0.8 share no band one time in some 10 million. Sets that
links or bands connect are then compared exactly, all with all, in tiles of
bounded size; only sets of neighbouring sizes meet, for others cannot reach the
similarity. A tile returns one edge per linked set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradespark.llm.common import map_texts, narrow, settled
from gradespark.llm.simhash import RADIUS, SEED, _Classes, components, links, majority

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 40, 5
#: Sets of one tile; a tile of two parts holds twice as many.
TILE = 128
_STEP, _COLUMNS = 256, 8192
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_FOLD = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the word shingles, with the words of ``simhash.fingerprints``."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_digest
    last = max(1, len(found) - words + 1) if found else 0
    hashes = b"".join([digest(b" ".join(found[k : k + words]), SEED) for k in range(last)])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def _name(found: np.ndarray) -> int:
    """One long per set; 0 is the empty one."""
    return int(np.frombuffer(xxhash.xxh64_digest(found.tobytes(), SEED), ">i8")[0]) if len(found) else 0


def _bands(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), _STEP):
        np.minimum(least, ((found[at : at + _STEP, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64).view(np.int64)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """``(doc_id, node, size, fp, bands)``, one row per input row; ``fp`` is the SimHash fingerprint of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            values = [pa.array([_name(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                      pa.array([majority(s.astype(">u8").tobytes()) for s in sets], pa.int64()),
                      pa.array([_bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values], ["doc_id", "node", "size", "fp", "bands"])

    return map_texts(docs, run, "doc_id bigint, node bigint, size int, fp bigint, bands array<bigint>")


def simhash_edges(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` that connect all rows ``(node, fp)`` whose fingerprints link; a fingerprint is a node of its own in them."""
    near = settled(links(nodes.select("fp").distinct(), radius))
    repeated = nodes.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    linked = near.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(repeated).distinct()
    return near.unionByName(nodes.join(linked, "fp").select(F.col("node").alias("a"), F.col("fp").alias("b")))


def minhash_edges(nodes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect all rows ``(node, bands)`` with a band in common."""
    banded = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    heads = banded.groupBy("band", "value").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return banded.join(heads, ["band", "value"]).where("a <> node").select("a", F.col("node").alias("b")).distinct()


def _compare(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Class of each set by links of all pairs."""
    sizes, classes = np.array([len(s) for s in sets]), _Classes(len(sets))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    row, column = np.repeat(np.arange(len(sets)), sizes)[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column, common = row[order], column[order], np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        low, high = np.searchsorted(column, (at, at + _COLUMNS))
        held = np.zeros((len(sets), int(column[high - 1]) - at + 1), np.float32)
        held[row[low:high], column[low:high] - at] = 1
        common += held @ held.T
    left, right = np.nonzero(np.triu(common >= least * (sizes[:, None] + sizes - common) - 1e-9, 1))
    classes.link(left, right)
    return classes.of


def _tile_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile; each tile is complete."""

    def edges() -> pa.RecordBatch:
        names = np.array([n for n, _ in held], np.int64)
        of = _compare([s for _, s in held], least)
        mine = np.nonzero(of != np.arange(len(of)))[0]
        return pa.RecordBatch.from_arrays([pa.array(names[of[mine]]), pa.array(names[mine])], ["a", "b"])

    held, now = [], None
    for batch in batches:
        for key, node, found in zip(zip(*(batch.column(k).to_pylist() for k in range(3))), batch.column(3).to_pylist(), batch.column(4)):
            if key != now:
                if len(held) > 1:
                    yield edges()
                held, now = [], key
            held.append((node, np.frombuffer(found.as_buffer(), np.uint64)))
    if len(held) > 1:
        yield edges()


def jaccard_classes(
    docs: DataFrame, words: int = WORDS, least: float = LEAST, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """``(doc_id, component_id)``, one row per input row.

    ``component_id`` is the smallest id among all rows that this one reaches
    over links of at least ``least``, the shared share of all shingles of two
    texts. Texts with fewer words than a shingle are one shingle; texts without
    a word only equal each other. Null ids never name a class. Texts are
    compared if their fingerprints differ in at most ``radius`` bits or if they
    share a band.
    """
    rows = narrow(docs, {"doc_id": F.col(id_col).cast("bigint"), "text": F.col(text_col).cast("string")})
    signed = settled(_signed(rows, words))
    nodes = settled(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    candidates = components(simhash_edges(nodes.where("size > 0").select("node", "fp"), radius).unionByName(minhash_edges(nodes)))
    # Sets whose sizes differ by more than a factor 1 / least cannot link, so only neighbouring classes of sizes meet.
    step = F.floor(F.log(F.col("size")) / F.lit(float(-np.log(least)) if least < 1 else 1e-9)).cast("bigint")
    found = settled(candidates.join(nodes.drop("fp", "bands"), "node").select("node", "root", "first", step.alias("step")))
    of_root = found.groupBy("root", "step").agg(F.count("*").alias("n")).groupBy("root").agg(
        F.sum("n").alias("all"), F.collect_list(F.struct("step", F.ceil(F.col("n") / tile).cast("int").alias("parts"))).alias("steps"))
    dealt = found.join(of_root, "root")
    own = F.struct("step", F.pmod(F.xxhash64("node"), F.element_at(F.filter("steps", lambda x: x["step"] == F.col("step")), 1)["parts"]).cast("int").alias("part"))
    parts_of = lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda p: F.struct(x["step"].alias("step"), p.alias("part")))
    others = F.flatten(F.transform(F.filter("steps", lambda x: F.abs(x["step"] - F.col("step")) <= 1), parts_of))
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("step"), F.lit(0).alias("part")))
    mine = F.when(F.col("all") <= tile, whole[0]).otherwise(own)
    dealt = dealt.select("node", "root", "first", mine.alias("own"), F.when(F.col("all") <= tile, whole).otherwise(others).alias("others"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in made], pa.int64()), pa.array([s.tobytes() for s in made], pa.binary())], ["_node", "found"])

    # Texts are read again only for one document of each candidate (for all without an id).
    needed = found.select(F.col("first").alias("_first")).distinct()
    again = rows.join(needed, F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi").select("text")
    again = map_texts(again, sets, "_node bigint, found binary").groupBy("_node").agg(F.first("found").alias("found"))
    tiles = dealt.join(again, F.col("node") == F.col("_node")).select("root", "node", "own", F.explode("others").alias("other"), "found")
    tiles = tiles.select("root", F.to_json(F.least("own", "other")).alias("low"), F.to_json(F.greatest("own", "other")).alias("high"), "node", "found")
    tiles = tiles.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    linked = map_texts(tiles, lambda it: _tile_links(it, least), "a bigint, b bigint").distinct()
    member = settled(components(linked).withColumnRenamed("node", "_node"))
    rooted = nodes.join(member, F.col("node") == F.col("_node"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = settled(rooted.join(smallest, "root").select(F.col("node").alias("_of"), "component_id"))
    return signed.join(classes, F.col("node") == F.col("_of")).select("doc_id", "component_id")
