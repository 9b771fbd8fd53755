"""Cheapest repairs of conversations whose turns are missing, repeated, cut off or out of order.

Rows are dealt out by conversation and sorted by turn, from the last one back.
A task streams them and carries, from one Arrow batch to the next, the least
cost of what follows for each state of the wanted order of roles, with two bytes
of decisions per row. Whole blocks of these bytes are compressed, so a giant
conversation needs little more than the audit string that it ends up with.
Going from its first row forward along the decisions then gives the audit. A
second pass streams the texts once, forward, behind their audit.

Whether a text was seen before is not remembered by the stream: one aggregation,
combined before its shuffle, names the first turn of every text, and these few
bytes travel into the sorted stream beside the turn they speak of.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradespark.llm.common import map_texts, narrow, settled

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
#: Decisions of so many rows are compressed together.
SEALED = 65_536
#: Rows of equal turns come by role, then by so many first characters of the text, then by its hash.
HEAD = 64
_LEGAL = ("su", "ua", "au")
_EMPTY = hashlib.sha256(b"").hexdigest()
_LONG = 2**63 - 1

# States of the order of roles `(s?(ua)+)?`: at the start, behind s, behind u, behind a.
_AFTER_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: Where the one role leads that may be inserted or given: user, user, assistant, user.
_AFTER_GIVEN = (2, 2, 3, 2)
#: Costs behind the last row, and the edits that they stand for.
_END, _LAST = (0, 2 * INSERT, INSERT, 0), ("", "II", "I", "")
_LETTERS = b"DIKR"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv_id, turn, role, text, gone)``: a fixed share of rows is broken, by ``crc32('conv_id:turn') % 20``.

    0 drops the row (it stays as one that is ``gone``, so that its conversation
    is known), 1 empties the text, 2 removes its ``[.!?]``, 3 repeats the row, 4
    makes the role user. Null roles, texts, ids and turns count as one space.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = narrow(conversations, {"conv_id": F.col(conv_col).cast("bigint"), "turn": F.col(turn_col).cast("bigint"), "role": text_of(role_col), "text": text_of(text_col)})
    hit = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    return rows.withColumn("hit", hit).select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("hit") == 0).alias("gone"), F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _prepared(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone_col: str | None) -> DataFrame:
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col(gone_col), F.lit(False)) if gone_col else F.lit(False)
    rows = narrow(conversations, {"conv_id": F.col(conv_col).cast("bigint"), "turn": F.col(turn_col).cast("bigint"), "role": text_of(role_col), "text": text_of(text_col), "gone": gone})
    message = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    return rows.withColumn("message", message)


def _order(last_first: bool) -> list[Column]:
    turn = F.desc_nulls_last("turn") if last_first else F.asc_nulls_first("turn")
    return [turn, F.col("kind"), *[F.desc(c) if last_first else F.asc(c) for c in ("role", "head", "message")]]


def _step(behind: tuple[int, ...], kind: str) -> tuple[tuple[int, ...], int]:
    """Costs before a row, from those behind it, and its decisions: for each state two bits of the letter and two of the state it leads to.

    ``kind`` is ``x`` for a row that must go, else its role's initial (``o``:
    another one) and, if it is cut off, ``-``. Of equally cheap edits the first
    letter wins; as a letter leads to one state only, the audit is the least one.
    """
    usual, options = len(kind) - 1, []
    for state, given in enumerate(_AFTER_GIVEN):
        kept = _AFTER_KEPT.get(kind[0], (None,) * 4)[state]
        options.append((DELETE + behind[state], None if kept is None else KEEP + CUT * usual + behind[kept],
                        None if kind[0] == "x" else REROLE + CUT * usual + behind[given]))
    own = [min(c for c in o if c is not None) for o in options]
    cost = [0, 0, min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])]
    cost[:2] = [min(own[s], INSERT + cost[2]) for s in (0, 1)]
    decisions = 0
    for state, (deleted, kept, given) in enumerate(options):
        letter = (deleted, INSERT + cost[_AFTER_GIVEN[state]], kept, given).index(cost[state])
        goes = (state, _AFTER_GIVEN[state], (_AFTER_KEPT.get(kind[0]) or (0,) * 4)[state], _AFTER_GIVEN[state])[letter]
        decisions |= (letter | goes << 2) << 4 * state
    return tuple(cost), decisions


class _Scan:
    """One conversation, met from its last row to its first."""

    def __init__(self, known: dict) -> None:
        self.known = known  # steps worked out before, of any conversation
        self.costs, self.total, self.sealed, self.open = _END, 0, [], array("H")
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.firsts, self.turn, self.pending, self.after = set(), object(), None, None
        self.least = self.most = None

    def met(self, turn: int | None, kind: int, message: str, initial: str, fault: int) -> None:
        self.settle(turn, message if kind else None)
        if kind == 0:
            if turn != self.turn:
                self.firsts = set()
            self.firsts.add(message)
        else:
            self.pending = (turn, message, initial, fault)
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.least, self.most = turn, turn if self.most is None else self.most
        self.turn = turn

    def settle(self, turn: int | None, message: str | None) -> None:
        """Take in the row met last; the row met now may be an equal one before it."""
        if self.pending is None:
            return
        own, text, initial, fault = self.pending
        self.pending = None
        again = (message == text and turn == own) or text not in self.firsts
        self.blank += fault == 2
        self.duplicate += fault != 2 and again
        self.truncated += fault == 1 and not again
        kind = "x" if fault == 2 or again else (initial if initial in _AFTER_KEPT else "o") + "-" * fault
        if self.after is not None:
            self.illegal += initial + self.after not in _LEGAL
        self.after = initial
        if (found := self.known.get((self.costs, kind))) is None:
            cost, decisions = _step(self.costs, kind)
            low = min(cost)
            found = self.known[self.costs, kind] = tuple(c - low for c in cost), low, decisions
        self.costs, low, decisions = found
        self.total += low
        self.open.append(decisions)
        if len(self.open) == SEALED:
            self.sealed.append(zlib.compress(self.open, 1))
            self.open = array("H")

    def result(self) -> tuple:
        self.settle(None, None)
        gaps = 0 if self.least is None else min(_LONG, self.most - self.least + 1 - self.turns)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.total + self.costs[0], self.audit()

    def audit(self) -> str:
        """From the start forward along the decisions; the row met last is the first one."""
        state, pieces = 0, []
        while self.open or self.sealed:
            block = self.open or array("H", zlib.decompress(self.sealed.pop()))
            self.open, found = array("H"), bytearray()
            for decisions in reversed(block):
                letter = 1
                while letter == 1:
                    step = decisions >> 4 * state & 15
                    letter, state = step & 3, step >> 2
                    found.append(_LETTERS[letter])
            pieces.append(found.decode())
        return "".join(pieces) + _LAST[state]


def _last_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(conv_id, turn, kind, message, initial, fault)`` in order to one row per conversation."""
    known, scan, conversation = {}, None, None
    names, types = ["conv_id", *COUNTS, "audit"], [pa.int64()] * (1 + len(COUNTS)) + [pa.string()]
    make = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
    done, size = [], 0
    for batch in batches:
        for own, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if scan is None or own != conversation:
                if scan is not None:
                    done.append((conversation, *scan.result()))
                    size += len(done[-1][-1])
                scan, conversation = _Scan(known), own
                if size > SEALED:
                    yield make(done)
                    done, size = [], 0
            if row[1] < 2:
                scan.met(*row)
    if scan is not None:
        yield make([*done, (conversation, *scan.result())])


def audits(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None
) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of every conversation.

    Rows come by turn, null turns first, equal turns by role, by the first
    characters of the text and by its hash. A row's first fault counts: blank, a
    role and text that came before, or an end other than ``. ! ?``. ``gaps`` are
    turns missing between the least and the largest, ``illegal`` neighbours whose
    initials are not su, ua or au. ``audit`` names the cheapest edits that give
    roles `(s?(ua)+)?`: Keep, Rerole, Delete, Insert; of equally cheap ones
    the least in ASCII. A null role or text is one space; null ids are one
    conversation. Rows that are ``gone`` only name theirs, which has zeros and
    an empty audit if nothing else is left of it. An empty table gives no rows.

    A task holds one hash for each distinct message of one turn of one conversation.
    """
    rows = _prepared(conversations, conv_col, turn_col, role_col, text_col, gone_col)
    kept = rows.where(~F.col("gone"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(trimmed == "", 2).when(F.substring(trimmed, -1, 1).isin(*".!?"), 0).otherwise(1)
    none = {c: F.lit(None).cast("string") for c in ("role", "head", "initial")}
    met = kept.select("conv_id", "turn", F.lit(1).alias("kind"), "message", "role", F.substring("text", 1, HEAD).alias("head"),
                      F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    firsts = kept.groupBy("conv_id", "message").agg(F.min(F.struct("turn")).alias("first")).select(
        "conv_id", F.col("first.turn").alias("turn"), F.lit(0).alias("kind"), "message", F.lit(0).alias("fault")).withColumns(none)
    gone = rows.where("gone").select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(2).alias("kind"), F.lit("").alias("message"), F.lit(0).alias("fault")).withColumns(none)
    stream = met.unionByName(firsts).unionByName(gone).repartition("conv_id").sortWithinPartitions("conv_id", *_order(last_first=True))
    schema = f"conv_id bigint, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string"
    return map_texts(stream.select("conv_id", "turn", "kind", "message", "initial", "fault"), _last_first, schema)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each conversation ``(conv_id, audit, turn, role, text)`` first its audit, then its rows, to the repaired rows."""
    names, types = ["conv_id", "position", "edit", "turn", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    conversation, audit, at, position, expects, made = None, "", 0, 0, b"user", []

    def put(edit: str, turn: int | None, role: bytes, text: bytes) -> None:
        nonlocal position, expects
        made.append((conversation, position, edit, turn, role, text))
        position, expects = position + 1, b"assistant" if role[:1] == b"u" else b"user"

    def insert() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            put("I", None, expects, b"")
            at += 1

    def batch_of() -> pa.RecordBatch:
        columns = [pa.array(c, pa.binary()).view(t) if t == pa.string() and i > 3 else pa.array(c, t) for i, (c, t) in enumerate(zip(zip(*made), types))]
        made.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        columns = [c.cast(pa.binary()) if i > 2 else c for i, c in enumerate(batch.columns)]
        for own, edits, turn, role, text in zip(*[c.to_pylist() for c in columns]):
            insert()  # before this row, or behind the last one of the conversation before
            if edits is not None:
                conversation, audit, at, position, expects = own, edits, 0, 0, b"user"
                continue
            edit, at = audit[at], at + 1
            if edit != "D":
                put(edit, turn, role if edit == "K" else expects, text)
        if made:
            yield batch_of()
    insert()
    if made:
        yield batch_of()


def repaired(
    conversations: DataFrame, audited: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None
) -> DataFrame:
    """``(conv_id, position, edit, turn, role, text)``: the rows that the audits of ``audited`` leave, in order from 0.

    Inserted rows have a null turn and an empty text. The rows of a conversation
    lie in one partition, sorted by position.
    """
    rows = _prepared(conversations, conv_col, turn_col, role_col, text_col, gone_col).where(~F.col("gone"))
    rows = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", F.lit(1).alias("kind"), "role", "text", F.substring("text", 1, HEAD).alias("head"), "message")
    heads = audited.select("conv_id", "audit", F.lit(0).alias("kind")).withColumn("turn", F.lit(None).cast("bigint")).withColumns(
        {c: F.lit(None).cast("string") for c in ("role", "text", "head", "message")})
    stream = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order(last_first=False))
    schema = "conv_id bigint, position bigint, edit string, turn bigint, role string, text string"
    return map_texts(stream.select("conv_id", "audit", "turn", "role", "text"), _forward, schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(conv_id, role, text)`` in order to the hash of each conversation's ``role:text`` lines."""
    conversation, digest, done = None, None, []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.string()))], ["_conv", "repaired_sha256"])
    for batch in batches:
        for own, role, text in zip(batch.column(0).to_pylist(), *[c.cast(pa.binary()).to_pylist() for c in batch.columns[1:]]):
            if digest is None or own != conversation:
                if digest is not None:
                    done.append((conversation, digest.hexdigest()))
                conversation, digest = own, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(role)
            digest.update(b":")
            digest.update(text)
        if done:
            yield make()
            done = []
    if digest is not None:
        done.append((conversation, digest.hexdigest()))
        yield make()


def digests(conversations: DataFrame, **columns: str) -> DataFrame:
    """The audits with ``repaired_sha256``: the hash of the repaired ``role:text`` lines, joined by newlines."""
    found = settled(audits(conversations, **columns))
    rows = repaired(conversations, found, **columns)
    hashes = map_texts(rows.select("conv_id", "role", "text"), _hashed, "_conv bigint, repaired_sha256 string")
    joined = found.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv_id", *COUNTS, "audit", F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"))


def _oracle() -> str:
    crc = ("xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::bigint)), lambda c, b: "
           "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, case when x % 2 = 1 then 3988292384 else 0 end))), 4294967295)")
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    allowed = {0: (("s", 1), ("u", 2)), 1: (("u", 2),), 2: (("a", 3),), 3: (("u", 2),)}
    own, cost, text = [], [], []
    for s in range(4):
        kept = " ".join(f"when i = '{role}' then cut + c{to}" for role, to in allowed[s])
        own.append(f"{DELETE} + c{s} as d{s}, case when gone then null {kept} end as k{s}, case when not gone then {REROLE} + cut + c{_AFTER_GIVEN[s]} end as r{s}")
    least = lambda s: f"least(d{s}, k{s}, r{s})"
    for s in (2, 3):
        cost.append(f"least({least(s)}, {INSERT} + {least(_AFTER_GIVEN[s])}) as n{s}")
    line = lambda s: f"chr(10) || '{'assistant' if s == 2 else 'user'}:'"
    for what, deleted, kept, given in (("a", "'D' || a{s}", "'K' || a{to}", "'R' || a{g}"), ("t", "t{s}", "chr(10) || role || ':' || text || t{to}", "{line} || text || t{g}")):
        for s in range(4):
            keep = f"case i {' '.join(f'when {chr(39)}{role}{chr(39)} then ' + kept.format(to=to) for role, to in allowed[s])} end"
            text.append(f"case {least(s)} when d{s} then {deleted.format(s=s)} when k{s} then {keep} else {given.format(g=_AFTER_GIVEN[s], line=line(s))} end as own_{what}{s}")
    def best(what: str, s: int, n: str, inner: str) -> str:
        head = "'I'" if what == "a" else line(s)
        return f"case when d{s} = {n} then own_{what}{s} when {INSERT} + n{_AFTER_GIVEN[s]} = {n} then {head} || {inner} else own_{what}{s} end"
    done = [f"least({least(s)}, {INSERT} + n2) as n{s}" for s in (0, 1)]
    strings = [f"{best(w, s, f'n{s}', f'own_{w}{_AFTER_GIVEN[s]}')} as {w}{s}" for w in "at" for s in (2, 3)]
    rest = [f"{best(w, s, f'least({least(s)}, {INSERT} + n2)', f'm_{w}2')} as {w}{s}" for w in "at" for s in (0, 1)]
    return f"""
with recursive o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as s from conversations
), h as (select *, {crc} % 20 as hit from o), g as (
  select conv_id, turn, case hit when 4 then 'user' else role end as role, case hit when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case hit when 3 then [0, 1] else [0] end) as copy from h where hit <> 0
), n as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text[1:{HEAD}], md5(length(role) || ':' || role || text)) as pos,
    rtrim(text, {blanks}) as trimmed, role[1:1] as i from g
), f as (select *, trimmed = '' as blank, row_number() over (partition by conv_id, role, text order by pos) > 1 as seen from n
), r as (
  select *, blank or seen as gone, case when not blank and not seen and trimmed[-1] not in ('.', '!', '?') then 1 else 0 end as cut,
    i || lead(i) over (partition by conv_id order by pos) as pair from f
), c as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank)::bigint as blank,
    count(*) filter (not blank and seen)::bigint as duplicate, sum(cut)::bigint as truncated, count(*) filter (pair not in ('su', 'ua', 'au'))::bigint as illegal, max(pos) as last
  from r group by conv_id
), w as (
  select conv_id, last + 1 as pos, 0 as c0, 4 as c1, 2 as c2, 0 as c3, '' as a0, 'II' as a1, 'I' as a2, '' as a3,
    '' as t0, {line(0)} || {line(2)} as t1, {line(2)} as t2, '' as t3 from c
  union all
  select conv_id, pos, {", ".join(f"n{s} as c{s}" for s in range(4))}, {", ".join(f"{w}{s}" for w in "at" for s in range(4))} from (
    select *, m_a2 as a2, m_a3 as a3, m_t2 as t2, m_t3 as t3, {", ".join(done)}, {", ".join(rest)} from (
      select * exclude (a0, a1, a2, a3, t0, t1, t2, t3), {", ".join(x.rsplit(" as ", 1)[0] + " as m_" + x.rsplit(" as ", 1)[1] for x in strings)} from (
        select *, {", ".join(cost)}, {", ".join(text)} from (
          select w.* exclude (pos), r.pos, r.role, r.text, r.i, r.cut, r.gone, {", ".join(own)} from w join r on w.conv_id is not distinct from r.conv_id and r.pos = w.pos - 1))))
)
select k.conv_id, {", ".join(f"coalesce({x}, 0)::bigint as {x}" for x in COUNTS[:-1])}, coalesce(c0, 0)::bigint as cost, coalesce(a0, '') as audit, sha256(coalesce(t0[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) k left join c on k.conv_id is not distinct from c.conv_id left join w on k.conv_id is not distinct from w.conv_id and w.pos = 1
"""


ORACLE = _oracle()
