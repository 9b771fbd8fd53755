"""SimHash near-duplicates by exact comparison of tiles of fingerprints.

Fingerprints of all whole texts are made in Arrow batches, equal ones are
merged, and the distinct ones are compared in tiles with numpy's exclusive-or
and bit count. Two fingerprints within ``radius`` bits agree in at least one
of ``radius + 1`` bands of bits, so tiles are built per band value and every
link is found in at least one of them; inside and between tiles, ranges whose
population counts differ by more than ``radius`` are skipped, for such
fingerprints cannot link. A tile task returns one edge per linked fingerprint
(to the first of its local class), never all pairs, and the classes of the
whole table are closed by rounds of joins over those edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradespark.llm.common import map_texts, narrow, settled

WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints of one band value that one task compares; more are dealt out as pairs of tiles.
TILE = 8192
#: Neighbours that make a node a hub of its own treatment, and the most such nodes.
HUB, HUBS = 1024, 50_000
_STEP = 512


def majority(hashes: bytes) -> int:
    """The bits that more than half of the hashes have (64 bits each, big-endian), as a signed long; 0 for none."""
    count = len(hashes) // 8
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(count, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > count).tobytes(), "big", signed=True)


def _text_fingerprint(text: str | None, words: int) -> int:
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    count = max(1, len(found) - words + 1)
    joined, ends, at = b" ".join(found), [], -1
    for word in found:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: count - 1]]]
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[min(words, len(found)) - 1 :])]))


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the 64 bits as a signed long, one row per input row.

    A-Z are lower-cased, words are split at ASCII white space, and a bit is
    set if more than half of the hashed word shingles have it. Texts with
    fewer words than a shingle hash as a whole; null texts, empty texts and
    texts of white space have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_text_fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fp"])

    rows = narrow(docs, {"doc_id": F.col(id_col).cast("bigint"), "text": F.col(text_col).cast("string")})
    return map_texts(rows, run, "doc_id bigint, fp bigint")


def _bands(radius: int) -> list[tuple[int, int]]:
    """Offsets and widths that cut 64 bits into ``radius + 1`` bands."""
    cuts = [round(64 * k / (radius + 1)) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class _Classes:
    """Classes of the rows of one tile task: the smallest position names a class."""

    def __init__(self, size: int) -> None:
        self.of = np.arange(size)

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        of = self.of
        while True:
            a, b = of[left], of[right]
            open_ = a != b
            if not open_.any():
                return
            left, right = left[open_], right[open_]
            high, low = np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_])
            np.minimum.at(of, high, low)
            while not np.array_equal(nxt := of[of], of):
                of[:] = nxt


def _compare(fps: np.ndarray, counts: np.ndarray, sides: np.ndarray, radius: int) -> np.ndarray:
    """Class of each row; rows are ordered by population count.

    ``sides``: 0 where all rows meet each other, else 1 and 2 for the two tiles
    of a pair, which only meet across.
    """
    classes, size = _Classes(len(fps)), len(fps)
    for a in range(0, size, _STEP):
        top = min(a + _STEP, size)
        for b in range(a, size, _STEP):
            end = min(b + _STEP, size)
            if counts[b] - counts[top - 1] > radius:  # beyond the radius, and so are all later ones
                break
            if (part := classes.of[a:top]).min() == part.max() == (other := classes.of[b:end]).min() == other.max():
                continue  # one class already
            near = np.bitwise_count(fps[a:top, None] ^ fps[None, b:end]) <= radius
            if sides[0]:
                near &= sides[a:top, None] != sides[None, b:end]
            left, right = np.nonzero(near)
            keep = left + a < right + b
            classes.link(left[keep] + a, right[keep] + b)
    return classes.of


def _tile_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile and population count; each tile is complete."""

    def edges(columns: list[np.ndarray]) -> pa.RecordBatch:
        key, count, side, fp = columns
        change = np.nonzero(np.any(key[1:] != key[:-1], axis=1))[0] + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(fp)]])
        bits, left, right = fp.view(np.uint64), [], []
        small = (ends - starts <= 64) & (side[starts] == 0)
        # Small tiles, all at once: row i against row i + lag of its tile.
        end_of = np.repeat(np.where(small, ends, 0), ends - starts)
        rows, lag = np.arange(len(fp)), 1
        while len(rows := rows[rows + lag < end_of[rows]]):
            rows = rows[count[rows + lag] - count[rows] <= radius]
            near = rows[np.bitwise_count(bits[rows] ^ bits[rows + lag]) <= radius]
            left.append(fp[near])
            right.append(fp[near + lag])
            lag += 1
        for s, e in zip(starts[~small], ends[~small]):
            of = _compare(bits[s:e], count[s:e], side[s:e], radius)
            mine = np.nonzero(of != np.arange(e - s))[0]
            left.append(fp[s:e][of[mine]])
            right.append(fp[s:e][mine])
        cat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cat], ["a", "b"])

    held: list[list[np.ndarray]] = []

    def flush(keep: np.ndarray | None) -> tuple[list[np.ndarray], list[np.ndarray] | None]:
        whole = [np.concatenate(x) for x in zip(*held)]
        if keep is None:
            return whole, None
        same = np.all(whole[0] == keep, axis=1)
        cut = int(np.argmax(same))
        return [x[:cut] for x in whole], [x[cut:] for x in whole]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
        held.append([np.stack(cols[:4], axis=1), cols[4].astype(np.int64), cols[5], cols[6]])
        done, rest = flush(held[-1][0][-1])  # the last tile may go on in the next batch
        held = [rest]
        if len(done[0]):
            yield edges(done)
    if held:
        yield edges(flush(None)[0])


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` whose classes are those of all links within ``radius``.

    ``distinct`` has each fingerprint once, in column ``fp``. Every link of two
    fingerprints lies within one class of the edges, and every edge lies within
    a class of the links.
    """
    bands = F.array(*[
        F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else F.col("fp")
        for start, width in _bands(radius)
    ])
    rows = distinct.select("fp", F.bit_count("fp").alias("ones"), F.posexplode(bands).alias("band", "value"))
    sizes = rows.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))
    # Band values with more fingerprints than a tile holds, with the tiles of each population count.
    large = (
        sizes.groupBy("band", "value")
        .agg(F.sum("n").alias("all"), F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int").alias("parts"))).alias("counts"))
        .where(F.col("all") > tile)
    )
    dealt = rows.join(large.drop("all"), ["band", "value"], "left")
    parts_of = lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda p: F.struct(x["ones"].alias("ones"), p.alias("part")))
    mine = F.pmod(F.xxhash64("fp"), F.element_at(F.filter("counts", lambda x: x["ones"] == F.col("ones")), 1)["parts"]).cast("int")
    others = F.flatten(F.transform(F.filter("counts", lambda x: F.abs(x["ones"] - F.col("ones")) <= radius), parts_of))
    code = lambda ones, part: ones.cast("bigint") * (1 << 40) + part.cast("bigint")
    whole = dealt.where(F.col("counts").isNull()).select(
        F.col("band").cast("bigint").alias("band"), "value", F.lit(0).cast("bigint").alias("low"),
        F.lit(0).cast("bigint").alias("high"), F.col("ones").cast("bigint").alias("ones"), F.lit(0).cast("bigint").alias("side"), "fp",
    )
    own = code(F.col("ones"), mine)
    paired = (
        dealt.where(F.col("counts").isNotNull())
        .select("band", "value", "ones", "fp", own.alias("own"), F.explode(others).alias("other"))
        .withColumn("partner", code(F.col("other.ones"), F.col("other.part")))
        .select(
            F.col("band").cast("bigint").alias("band"), "value", F.least("own", "partner").alias("low"), F.greatest("own", "partner").alias("high"),
            F.col("ones").cast("bigint").alias("ones"),
            F.when(F.col("own") == F.col("partner"), 0).when(F.col("own") < F.col("partner"), 1).otherwise(2).cast("bigint").alias("side"), "fp",
        )
    )
    tiles = whole.unionByName(paired).repartition("band", "value", "low", "high").sortWithinPartitions("band", "value", "low", "high", "ones", "fp")
    return tiles.mapInArrow(lambda it: _tile_links(it, radius), "a bigint, b bigint").distinct()


def _with_least(pairs: DataFrame, hub: int) -> DataFrame:
    """``pairs`` with ``m``, the smallest ``lo`` of their ``hi``.

    A ``hi`` with more than ``hub`` rows is no key of the shuffle: its minimum
    is one row, which is broadcast, and its pairs are spread by their ``lo``.
    """
    least = pairs.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")).withColumnRenamed("hi", "u")
    hubs = least.where(F.col("n") > hub).select(F.col("u").alias("_hub"), F.col("m").alias("_m"))
    rest = least.where(F.col("n") <= hub).select(F.col("u").alias("_u"), F.col("m").alias("_r"))
    found = pairs.join(F.broadcast(hubs), F.col("hi") == F.col("_hub"), "left")
    found = found.withColumn("_key", F.when(F.col("_hub").isNull(), F.col("hi")).otherwise(F.xxhash64("lo")))
    found = found.join(rest, F.col("_key") == F.col("_u"), "left")
    return found.select("hi", "lo", F.coalesce("_m", "_r").alias("m"))


def components(edges: DataFrame, rounds: int = 60, hubs: int = HUBS, hub: int = HUB) -> DataFrame:
    """``(node, root)`` of every node of the edges ``(a, b)``: the smallest node it reaches.

    Each round points the neighbours of a node at the smallest of them, first
    the larger ones, then the smaller ones, until nothing changes; a node with
    very many neighbours is reduced to one row per task before its shuffle, and
    its neighbours learn the smallest from a broadcast. Of p pairs, each of
    them counted from both of its ends, fewer than ``hubs`` nodes can have more
    than 2 p / ``hubs`` neighbours, which bounds the broadcast; nodes with at
    most ``hub`` neighbours are never taken for one.
    """
    pairs = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    before, size = None, pairs.count()
    for _ in range(rounds):
        limit = max(hub, 2 * size // hubs)
        both = pairs.unionByName(pairs.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        large = _with_least(both, limit).where("lo > hi").select(F.col("lo").alias("hi"), F.least("hi", "m").alias("lo"))
        joined = _with_least(large.where("hi <> lo").distinct(), limit)
        # Of each node the pair with the smallest stays; the others lead from their own end to it.
        pairs = settled(joined.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo")).distinct())
        # Stable once no node points twice and no root points on.
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before, size = now, now[0]
    else:
        raise RuntimeError(f"classes did not settle in {rounds} rounds")
    roots = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)


def simhash_classes(
    docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    ``component_id`` is the smallest id among all rows whose fingerprints reach
    this one over links of at most ``radius`` bits. Equal ids and repeated rows
    keep one row each; a null id never names a class (a class of null ids only
    has component null). Empty tables give no rows.
    """
    fps = settled(fingerprints(docs, words, id_col, text_col))
    firsts = settled(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    member = settled(components(links(firsts.select("fp"), radius, tile)))
    # Classes of one fingerprint need no join: their root is the fingerprint itself.
    rooted = firsts.join(member, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = settled(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"))
    return fps.join(classes, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_class(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of each class, the document with the smallest id.

    ``classes`` has ``doc_id`` and ``component_id``; without it, they are those of ``simhash_classes``.
    Of repeated rows with that id one stays. Rows without an id cannot be named
    by a class and all stay.
    """
    classes = simhash_classes(docs) if classes is None else classes
    stay = classes.where("doc_id = component_id").select(F.col("doc_id").alias("_stay")).distinct()
    columns = docs.columns
    named = docs.join(stay, docs["doc_id"] == F.col("_stay"), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(docs["doc_id"].isNull())).select(*columns)
