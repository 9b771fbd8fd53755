"""Packing of documents into token sequences: best fit, then swaps between underfull bins.

Documents become pieces of at most ``capacity`` tokens. Each task packs its
own pieces in chunks of bounded size; sequences that stay underfull are opened
again, and their pieces meet those of other tasks in the next round, until one
chunk is left or nothing gets better. No text or token list is shuffled unless
asked for: rows carry their length, place and checksum.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from gradespark.llm.common import map_texts, narrow, settled

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs at a time.
CHUNK = 20_000
#: Sequences filled less than this meet other tasks' in the next round.
TIGHT = 0.98
#: Underfull bins that the local search tries to empty before it gives up.
TRIES = 12
#: Words whose ids a worker remembers at least and twice as many at most, their greatest length in bytes, and texts looked at together.
REMEMBERED, WORD_BYTES, TOGETHER = 200_000, 64, 64
#: ASCII marks that the tokenizer never joins to a letter or digit before them.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Memory(dict):
    """Ids of words in two generations: when the young one is full it becomes the old one.

    An old word that is asked for is young again. A word in neither gives an
    empty array of its own, noted in ``fresh``, for its ids to be filled in.
    """

    def __init__(self) -> None:
        self.old: dict[bytes, bytes] = {}
        self.fresh: dict[bytes, bytearray] = {}

    def __missing__(self, word: bytes) -> bytes | bytearray:
        ids = self.old.get(word)
        if ids is None:
            return self.fresh.setdefault(word, bytearray())
        self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class _WordIds:
    """Ids of texts as little-endian 32-bit bytes, put together from those of their words.

    The tokenizer lower-cases, drops white space, never joins tokens across it,
    and starts a token where marks follow a letter or digit. So a text's ids are
    those of its words, one after the other, and a word's are those of its stem
    and of the marks behind it. Texts with a special token in them are encoded as they are.
    New words are encoded many at a time with a special token between them, which no word can hold.
    """

    def __init__(self, tokenizer_json: str) -> None:
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        content = json.loads(tokenizer_json)
        added = content.get("added_tokens", [])
        self.special = [t["content"].encode().lower() for t in added]
        self.between, self.between_id = (added[0]["content"], added[0]["id"]) if added else (None, None)
        suffix = content["model"].get("end_of_word_suffix")
        self.ends = np.array([bool(suffix) and t.endswith(suffix) for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda t: t[1])])
        self.known = _Memory()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode(self, words: list[bytes]) -> None:
        """Remember the ids of ``words``."""
        texts = [w.decode() for w in words]
        letters = [t.isalpha() for t in texts]
        plain = [*compress(words, letters)]
        ids = self._ids(" ".join(compress(texts, letters)))
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(plain):  # each of letters alone, and so with one token that ends a word
            self._keep(plain, ids, cuts, cuts)
            words, texts = ([*compress(x, [not a for a in letters])] for x in (words, texts))
        if not words:
            return
        if self.between is None:
            self.known.update((w, self._ids(t).tobytes()) for w, t in zip(words, texts))
            return
        ids = self._ids(self.between.join(texts))
        cuts = np.flatnonzero(ids == self.between_id)
        self._keep(words, ids, cuts + 1, np.append(cuts, len(ids)))

    def _keep(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data = ids.tobytes()
        self.known.update((w, data[s:e]) for w, s, e in zip(words, [0, *(4 * starts).tolist()], (4 * ends).tolist()))

    def _learn(self) -> None:
        """Fill in the ids of all fresh words, by way of stems and marks for those that end in marks."""
        known, plain, marked = self.known, [], []
        fresh, known.fresh = known.fresh, {}
        for word in fresh:
            if word[-1] in _MARKS:
                stem = word.rstrip(_MARKS)
                last = stem[-8:].decode("utf-8", "ignore")[-1:]
                # Other characters may join the marks, or change when they are lower-cased.
                if last and last < "\u2000" and (last.isalpha() and len(last.lower()) == 1 or last.isdecimal()):
                    marked.append((word, stem, word[len(stem) :]))
                    continue
            plain.append(word)
        own = {*plain}
        for _, *parts in marked:
            for part in parts:
                if part not in own:
                    known[part]  # noqa: B018 - becomes fresh where it is not known
        parts, known.fresh = known.fresh, {}
        self._encode([*plain, *parts])
        for word, stem, marks in marked:
            known[word] = known[stem] + known[marks]
        for word, hole in fresh.items():
            hole += known[word]
        for some in (fresh, parts):  # too long to keep
            for word in some:
                if len(word) > WORD_BYTES:
                    del known[word]

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        known = self.known
        for at in range(0, len(texts), TOGETHER):
            some = texts[at : at + TOGETHER]
            raws = [(t or "").encode("utf-8", "replace").lower() for t in some]
            split = [None if any(s in raw for s in self.special) else raw.split() for raw in raws]
            met = [None if words is None else [*map(known.__getitem__, words)] for words in split]
            if known.fresh:
                self._learn()
            for text, found in zip(some, met):
                yield self._ids(text).tobytes() if found is None else b"".join(found)
            known.age()


@lru_cache(maxsize=1)
def _word_ids(tokenizer_json: str) -> _WordIds:
    """One per worker, so that its tasks load the tokenizer once and share what was encoded."""
    return _WordIds(tokenizer_json)


def token_pieces(
    docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32[, ids])``: documents cut at ``capacity`` tokens.

    ``tokenizer_json`` is the content of a tokenizer file that lower-cases, drops
    white space and keeps marks apart from letters. A document is its ids and ``end_id``; null and empty texts are
    ``end_id`` alone. Only longer documents are cut, and only their last piece
    may be shorter. Repeated rows and null ids are documents like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _word_ids(tokenizer_json), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), words.texts(batch.column(1).to_pylist())):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc, piece, start, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in out[5]], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(arrays, names + ["ids"] * with_ids)

    rows = narrow(docs, {"doc_id": F.col(id_col).cast("bigint"), "text": F.col(text_col).cast("string")})
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_texts(rows, run, schema + ", ids array<bigint>" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: longest first, each into the fullest bin that still takes it."""
    bins, rooms, of = 0, [], np.zeros(len(lengths), np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, chosen = rooms.pop(at)
        else:
            room, chosen = capacity, bins
            bins += 1
        of[item] = chosen
        if room > size:
            insort(rooms, (room - size, chosen))
    return of


def local_search(lengths: np.ndarray, of: np.ndarray, capacity: int, tries: int = TRIES) -> np.ndarray:
    """Empty underfull bins by moves and swaps, each of which raises the sum of squared fills."""
    of = of.copy()
    fill = np.bincount(of, weights=lengths).astype(np.int64)
    goal = -(-int(lengths.sum()) // capacity)
    used, failed = int((fill > 0).sum()), set()

    def put(item: int, to: int) -> None:
        fill[of[item]] -= lengths[item]
        fill[to] += lengths[item]
        of[item] = to

    def step(source: int) -> bool:
        """One move or swap that takes tokens out of ``source``."""
        mine = np.nonzero(of == source)[0]
        mine = mine[np.argsort(-lengths[mine], kind="stable")]
        room = capacity - fill
        room[source] = 0
        room[fill == 0] = 0
        for a in mine.tolist():
            if len(fits := np.nonzero((room >= lengths[a]) & (fill + lengths[a] > fill[source]))[0]):
                put(a, int(fits[np.argmin(room[fits])]))
                return True
        others = np.nonzero(room[of] > 0)[0]
        size, free, theirs = lengths[others], room[of[others]], fill[of[others]]

        def swap(taken: list[int]) -> bool:
            gain = int(lengths[taken].sum()) - size
            good = np.nonzero((gain > 0) & (gain <= free) & (theirs + gain > fill[source]))[0]
            if not len(good):
                return False
            b = int(others[good[np.argmin((free - gain)[good])]])  # the partner ends as full as can be
            to = int(of[b])
            put(b, source)
            for a in taken:
                put(a, to)
            return True

        if any(swap([a]) for a in mine.tolist()):
            return True
        return any(swap([a, b]) for k, a in enumerate(mine.tolist()) for b in mine[k + 1 :].tolist())

    while used > goal and len(failed) < tries:
        order = [b for b in np.argsort(fill, kind="stable").tolist() if fill[b] and fill[b] < capacity and b not in failed]
        if not order or int((capacity - fill[fill > 0]).sum()) < capacity:
            break
        source = order[0]
        while fill[source] and step(source):
            pass
        if fill[source]:
            failed.add(source)
        else:
            used -= 1
            failed.clear()
    return of


def _packed(whole: pa.Table, capacity: int, first: int) -> pa.Table:
    """``whole`` with its bins, numbered from ``first``, places and fills."""
    lengths = whole.column("length").to_numpy()
    of = local_search(lengths, best_fit(lengths, capacity), capacity)
    order = np.argsort(of, kind="stable")
    before = np.concatenate([[0], np.cumsum(lengths[order])])
    starts = np.concatenate([[0], np.nonzero(np.diff(of[order]))[0] + 1])
    sizes = np.diff(np.concatenate([starts, [len(order)]]))
    offset, fill = np.empty(len(of), np.int64), np.bincount(of, weights=lengths).astype(np.int64)
    offset[order] = before[:-1] - np.repeat(before[starts], sizes)
    for name, values in (("sequence_id", first + of), ("offset", offset), ("_fill", fill[of])):
        whole = whole.append_column(name, pa.array(values, pa.int64()))
    return whole


def _round(pieces: DataFrame, capacity: int, chunk: int, number: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, done = [], 0, 0
        base = (number << 58) + (TaskContext.get().partitionId() << 34)

        def close() -> Iterator[pa.RecordBatch]:
            yield from _packed(pa.Table.from_batches(held), capacity, base + done).to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                if held and rows + part.num_rows > chunk:
                    yield from close()
                    done, held, rows = done + rows, [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            yield from close()

    added = [T.StructField(n, T.LongType()) for n in ("sequence_id", "offset", "_fill")]
    return settled(pieces.mapInArrow(run, T.StructType([*pieces.schema.fields, *added])))


def pack(pieces: DataFrame, capacity: int = CAPACITY, chunk: int = CHUNK, tight: float = TIGHT) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` in as few sequences as the search finds.

    ``length`` must be from 1 to ``capacity``. All other columns pass through.
    Every row gets one place, the rows of a sequence follow each other without
    a gap, and no sequence holds more than ``capacity`` tokens. An empty table
    gives no rows.
    """
    added = ["sequence_id", "offset", "_fill"]
    number, packed, loose_rows = 0, _round(pieces, capacity, chunk, 0), None
    closed = packed.limit(0)
    while True:
        loose = packed.where(F.col("_fill") < tight * capacity)
        count = loose.count()
        groups = -(-count // chunk)
        # A sole chunk of a later round has met all there is.
        if count == 0 or (number and (packed.rdd.getNumPartitions() == 1 or count > 0.7 * loose_rows)):
            break
        closed = closed.unionByName(packed.where(F.col("_fill") >= tight * capacity))
        number, loose_rows = number + 1, count
        packed = _round(loose.drop(*added).repartition(groups), capacity, chunk, number)
    return closed.unionByName(packed).drop("_fill")
