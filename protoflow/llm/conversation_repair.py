"""Repair of conversation structure by the lightest derivation of a well-formed one.

A repaired conversation is an optional system turn and then pairs of user and assistant turns.
Every row is kept, given another role, or deleted; empty turns may be inserted.  A repair is a
derivation in a weighted deduction system: item ``(i, q)`` says that rows ``i`` onwards can be
completed from state ``q`` of the grammar, and every edit is a rule that derives one item from
another and adds its cost and its initial.  Knuth's agenda pops items by (cost, rows covered,
audit): each rule is monotone and gives an item greater than its premise (an edit covers one row
more, an insertion costs more), so an item is final when it is popped and the search ends at the
goal.  Audits are compared from the front and rules put a letter in front, which keeps the order.

Rows are ordered by one range sort over (conversation, turn), so a conversation of any size is
spread over tasks; a task cuts it into segments of bounded size.  Conversations that lie inside
one segment are repaired where they are.  For the others each segment is solved for every pair
of entry and exit state, and the segments are chained from the last to the first by the rule
with two premises: segment (q to q') and tail (q') give tail (q).
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache, partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protoflow._session import shuffle_partitions
from protoflow.llm._tables import ensure_shipped, only, written

SEGMENT_ROWS = 256
SEGMENT_BYTES = 8 << 20          # text held by a task for one segment
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)          # grammar states: what came last
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTING = (START, ASSISTANT)
INTO = {q: [(a, x) for (a, x), b in STEP.items() if b == q] for q in range(4)}    # (from state, initial)
# A row's sign: its role's initial (s, u, a or . for another) and fault, in one character.
FAULTS = ("", "blank", "duplicate", "truncated")
SIGNS = {(x, f): chr(65 + 4 * i + j) for i, x in enumerate("sua.") for j, f in enumerate(FAULTS)}
MEANING = {c: k for k, c in SIGNS.items()}
LEGAL = {"su", "ua", "au"}
_BLANK = r"[^\x20\x09-\x0D]"


# ---- one segment ------------------------------------------------------------------------

def _rules(signs: str, i: int, q: int):
    """(cost, letter, item) of every rule with premise (i, q): an edit before row ``i`` or an insertion."""
    for before, x in INTO[q]:
        if x in ROLES:
            yield INSERT, "I", (i, before)
    if not i:
        return
    initial, fault = MEANING[signs[i - 1]]
    yield DELETE, "D", (i - 1, q)
    if fault in ("blank", "duplicate"):
        return
    extra = TRUNCATED if fault else 0
    for before, x in INTO[q]:
        if x == initial:
            yield KEEP + extra, "K", (i - 1, before)
        if x in ROLES:
            yield REROLE + extra, "R", (i - 1, before)


def lightest(signs: str, finals: tuple, goals: set) -> dict:
    """{entry state: (cost, audit)} of the lightest derivation of each goal item (0, state).

    ``finals`` are the states in which the rows may end.
    """
    n, done, found = len(signs), set(), {}
    agenda = [(0, 0, "", q) for q in finals]                 # cost, rows covered, audit, state
    heapq.heapify(agenda)
    while agenda and len(found) < len(goals):
        cost, covered, audit, q = heapq.heappop(agenda)
        item = (n - covered, q)
        if item in done:
            continue
        done.add(item)
        if item[0] == 0 and q in goals:
            found[q] = (cost, audit)
        for more, letter, (i, before) in _rules(signs, *item):
            if (i, before) not in done:
                heapq.heappush(agenda, (cost + more, n - i, letter + audit, before))
    return found


@lru_cache(1 << 14)
def whole(signs: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation of one segment."""
    return lightest(signs, ACCEPTING, {START})[START]


@lru_cache(1 << 10)
def spans(signs: str) -> tuple:
    """For every exit state, {entry state: (cost, audit)} over one segment."""
    return tuple(lightest(signs, (q,), {0, 1, 2, 3}) for q in range(4))


def chain(segments: list[str]) -> tuple[int, list[str]]:
    """(cost, audit of each segment) of a conversation cut into segments, from the last to the first.

    Ties go to the audit that is least as a whole; two different audits of one segment with
    equal states and cost never are prefixes of each other, so they compare before their tails.
    """
    tail = {q: (0, None) for q in ACCEPTING}                  # state -> (cost, (audit, rest))
    for signs in reversed(segments):
        ahead: dict = {}
        for leave, entries in enumerate(spans(signs)):
            if leave in tail:
                for enter, (cost, audit) in entries.items():
                    cost, rest = cost + tail[leave][0], (audit, tail[leave][1])
                    if enter not in ahead or cost < ahead[enter][0] or (cost == ahead[enter][0]
                                                                        and _less(rest, ahead[enter][1])):
                        ahead[enter] = (cost, rest)
        tail = ahead
    cost, rest = tail[START]
    audits = []
    while rest is not None:
        audits.append(rest[0])
        rest = rest[1]
    return cost, audits


def _less(a, b) -> bool:
    """Whether the linked audit ``a`` comes before ``b``; a shared tail ends the comparison."""
    left = right = ""
    while True:
        n = min(len(left), len(right))
        if left[:n] != right[:n]:
            return left[:n] < right[:n]
        left, right = left[n:], right[n:]
        if a is b:
            return left < right
        if not left and a is not None:
            left, a = left + a[0], a[1]
        elif not right and b is not None:
            right, b = right + b[0], b[1]
        else:
            return left < right


def turns(audit: str, rows: list, state: int = START):
    """(edit, role, text) of the repaired turns of ``rows`` [(role, text)]; returns the state after them."""
    at = 0
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            role, text = rows[at]
            state = STEP[state, role[0]]
        else:
            x = "a" if state == USER else "u"
            role, text, state = ROLES[x], rows[at][1] if letter == "R" else "", STEP[state, x]
        at += letter != "I"
        yield letter, role, text
    return state


# ---- rows -------------------------------------------------------------------------------

def damage(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text) with a fault per row by crc32 of ``key:turn`` modulo 20: 0 drops the row,
    1 empties the text, 2 removes ``.!?``, 3 repeats the row, 4 makes it a user's turn.  NULLs read as one space."""
    src = only(df, key=key, turn=turn, role=role, text=text)
    space = F.lit(" ")
    fault = F.crc32(F.concat(F.coalesce(F.col("key").cast("string"), space), F.lit(":"),
                             F.coalesce(F.col("turn").cast("string"), space))) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    hurt = src.select("key", "turn", fault.alias("fault"),
                      F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"),
                      F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    copies = F.when(F.col("fault") == 3, 2).otherwise(1)
    return hurt.where(F.col("fault") != 0).select("key", "turn", "role", "text",
                                                  F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


def _fault(blank: Column, text: Column) -> Column:
    last = F.regexp_extract(text, r"([.!?])[\x20\x09-\x0D]*\z", 1)
    return F.when(blank, F.lit("blank")).when(last == "", F.lit("truncated")).otherwise(F.lit(""))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, n, sign): distinct rows with their number ``n``, range-sorted by conversation and turn.

    ``sign`` holds the role's initial and the fault of the first of the ``n`` equal rows; the others
    are its duplicates.  Equal rows are counted before they are shuffled, and the first row with a
    role and text is told by a join on the whole row, so neither a repeated row, a frequent text nor
    a large conversation gathers in one task.
    """
    rows = rows.select("key", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # one struct as the key: NULLs in it are equal, and the join below keeps the grouping's partitions
    row = F.struct("key", "turn", "role", F.unhex(F.md5("text")).alias("digest"))
    same = rows.groupBy(row.alias("row")).agg(F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    # the earliest of the rows with one role and text; NULL turns come first
    first = (same.groupBy("row.key", "row.role", "row.digest")
             .agg(F.min(F.struct(F.col("row.turn").isNotNull().alias("known"), F.col("row.turn").alias("turn"))).alias("least"))
             .select(F.struct("key", F.col("least.turn").alias("turn"), "role", "digest").alias("row"), F.lit(True).alias("first")))
    told = same.join(first, "row", "left").select("row.key", "row.turn", "row.role", "text", "n", "first")
    blank = ~F.col("text").rlike(_BLANK)
    fault = F.when(blank | F.col("first").isNotNull(), _fault(blank, F.col("text"))).otherwise(F.lit("duplicate"))
    initial = F.substring("role", 1, 1)
    sign = F.lit(None).cast("string")
    for (x, f), c in SIGNS.items():
        own = ~initial.isin("s", "u", "a") if x == "." else initial == x
        sign = F.when(own & (fault == f), F.lit(c)).otherwise(sign)
    return (told.select("key", "turn", "role", "text", "n", sign.alias("sign"))
            .repartitionByRange(shuffle_partitions(rows.sparkSession), F.asc_nulls_first("key"), F.asc_nulls_first("turn"), "role", "text")
            .sortWithinPartitions(F.asc_nulls_first("key"), F.asc_nulls_first("turn"), "role", "text"))


# ---- tasks ------------------------------------------------------------------------------

SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Tally:
    """Counts over the rows of a conversation, taken in order; tallies of its segments add up."""

    def __init__(self):
        self.signs: list[str] = []
        self.first = self.last = None            # turns, without NULL
        self.distinct = 0

    def add(self, turn, sign: str, n: int) -> None:
        initial, fault = MEANING[sign]
        again = SIGNS[initial, "blank" if fault == "blank" else "duplicate"]
        self.signs.append(sign + again * (n - 1))
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1


def _summary(signs: str, first, last, distinct, cost: int) -> list[int]:
    faults = [MEANING[c][1] for c in signs]
    initials = "".join(MEANING[c][0] for c in signs)
    illegal = sum(initials[i:i + 2] not in LEGAL for i in range(len(initials) - 1))
    gaps = 0 if first is None else last - first + 1 - distinct
    return [gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost]


def _rows(batches, *columns):
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


class _Out:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, schema, limit_rows: int = 4096, limit_bytes: int = 4 << 20):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.rows, self.size = to_arrow_schema(schema), [], 0
        self.limit_rows, self.limit_bytes = limit_rows, limit_bytes

    def add(self, row: tuple, size: int = 0) -> bool:
        self.rows.append(row)
        self.size += size
        return len(self.rows) >= self.limit_rows or self.size >= self.limit_bytes

    def take(self):
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in self.rows], f.type) for i, f in enumerate(self.schema)], schema=self.schema)
        self.rows, self.size = [], 0
        return batch


def _cut(batches, schema, emit, partition=None, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES):
    """Sorted rows -> finished conversations, and the rows of those that are not inside one segment.

    The first and last conversation of a task may go on in the next task, so they stay open.
    """
    from pyspark import TaskContext

    task = (TaskContext.get().partitionId() if partition is None else partition) << 40
    out, n_segments = _Out(schema), 0
    key, rows, tally, size, count = None, [], Tally(), 0, 0
    opened, any_row = True, False                    # ``opened``: the conversation is not whole in ``rows``

    def flush(open_: bool):
        nonlocal n_segments, rows, tally, size, count
        if rows and open_:
            signs, span = "".join(tally.signs), (tally.first, tally.last, tally.distinct)
            for i, (turn, role, text, n) in enumerate(rows):
                end = i == len(rows) - 1
                if out.add((key, task + n_segments, i, role, text, n, signs if end else None, *(span if end else (None,) * 3),
                            None, None, None, None, None, None), len(text)):
                    yield out.take()
            n_segments += 1
        elif rows:
            signs = "".join(tally.signs)
            cost, audit = whole(signs)
            flat = [(role, text) for _, role, text, n in rows for _ in range(n)]
            found = _summary(signs, tally.first, tally.last, tally.distinct, cost)
            for row in emit(key, found, audit, flat):
                if out.add((None,) * 10 + row, len(row[3] or "") + len(row[4] or "")):
                    yield out.take()
        rows, tally, size, count = [], Tally(), 0, 0

    for k, turn, role, text, n, sign in _rows(batches, *range(6)):
        if any_row and k != key:
            yield from flush(opened)
            opened = False
        elif any_row and (count + n > segment_rows or size + len(text) > segment_bytes):
            opened = True
            yield from flush(True)
        key, any_row = k, True
        while n > segment_rows:                       # very many equal rows: whole segments of them
            if rows:
                opened = True
                yield from flush(True)
            tally.add(turn, sign, segment_rows)
            rows.append((turn, role, text, segment_rows))
            opened = True
            yield from flush(True)
            n -= segment_rows
            initial, fault = MEANING[sign]
            sign = SIGNS[initial, "blank" if fault == "blank" else "duplicate"]
        tally.add(turn, sign, n)
        rows.append((turn, role, text, n))
        size, count = size + len(text), count + n
    yield from flush(True)
    if out.rows:
        yield out.take()


def _chain(batches, schema):
    """Segments sorted by (conversation, segment) -> (key, seg, audit, state, turns before it) and, on its last
    one, the summary and the whole audit."""
    out = _Out(schema)

    def close(key, parts):
        signs = [p[1] for p in parts]
        cost, audits = chain(signs)
        first = last = None
        distinct = 0
        for _, _, a, b, d in parts:
            if a is not None:
                distinct += d - (a == last)
                first, last = a if first is None else first, b
        found, state = _summary("".join(signs), first, last, distinct, cost), START
        before = 0
        for i, (part, audit) in enumerate(zip(parts, audits)):
            end = i == len(parts) - 1
            if out.add((key, part[0], audit, state, before, found if end else None, "".join(audits) if end else None), len(audit)):
                yield out.take()
            before += len(audit) - audit.count("D")
            for letter, sign in _pairs(audit, part[1]):
                if letter == "K":
                    state = STEP[state, MEANING[sign][0]]
                elif letter != "D":
                    state = STEP[state, "a" if state == USER else "u"]

    key, parts = None, []
    for k, seg, signs, a, b, d in _rows(batches, *range(6)):
        if parts and k != key:
            yield from close(key, parts)
            parts = []
        key = k
        parts.append((seg, signs, a, b, d))
    if parts:
        yield from close(key, parts)
    if out.rows:
        yield out.take()


def _pairs(audit: str, signs: str):
    at = 0
    for letter in audit:
        yield letter, None if letter == "I" else signs[at]
        at += letter != "I"


def _segments(batches):
    """(key, audit, state, turns before, summary, whole audit, [(role, text)]) of the segments of sorted rows."""
    at, held = None, []
    for row in _rows(batches, *range(10)):
        if held and row[1] != at:
            yield held[0][0], *held[0][5:], [(r[2], r[3]) for r in held for _ in range(r[4])]
            held = []
        at = row[1]
        held.append(row)
    if held:
        yield held[0][0], *held[0][5:], [(r[2], r[3]) for r in held for _ in range(r[4])]


def _apply_turns(batches, schema):
    """Rows of segments, in order inside each, with the segment's audit -> repaired turns."""
    out = _Out(schema)
    for key, audit, state, before, _, _, rows in _segments(batches):
        for i, (edit, role, text) in enumerate(turns(audit, rows, state)):
            if out.add((key, before + i, edit, role, text, None), len(text)):
                yield out.take()
    if out.rows:
        yield out.take()


def _apply_digest(batches, schema):
    """Rows of open conversations in order -> a digest row each; the text passes through, none is kept."""
    out, hasher = _Out(schema), hashlib.sha256()
    for key, audit, state, before, found, full, rows in _segments(batches):
        for i, (_, role, text) in enumerate(turns(audit, rows, state)):
            hasher.update((("\n" if before + i else "") + f"{role}:{text}").encode())
        if found is not None:                        # the conversation's last segment
            done, hasher = hasher.hexdigest(), hashlib.sha256()
            if out.add((key, None, done, None, full, found), len(full)):
                yield out.take()
    if out.rows:
        yield out.take()


def _emit_digest(key, found, audit, rows):
    text = "\n".join(f"{role}:{text}" for _, role, text in turns(audit, rows))
    yield key, None, hashlib.sha256(text.encode()).hexdigest(), None, audit, found


def _emit_turns(key, found, audit, rows):
    for place, (edit, role, text) in enumerate(turns(audit, rows)):
        yield key, place, edit, role, text, None


def _solve(rows: DataFrame, digest: bool) -> DataFrame:
    """(key, place, edit, role, text, found) of the repaired turns; with ``digest`` one row per conversation
    whose ``edit`` is the digest and ``text`` the audit."""
    spark = rows.sparkSession
    ensure_shipped(spark)
    kind = rows.schema["key"].dataType
    result = (T.StructType().add("key", kind).add("place", "long").add("edit", "string").add("role", "string")
              .add("text", "string").add("found", T.ArrayType(T.LongType())))
    cut = (T.StructType().add("key", kind).add("seg", "long").add("at", "long").add("role", "string").add("text", "string")
           .add("n", "long").add("signs", "string").add("t0", "long").add("t1", "long").add("dt", "long"))
    for f in result:
        cut = cut.add("o_" + f.name, f.dataType)
    src = ordered_rows(rows.withColumn("turn", F.col("turn").cast("long")))
    parts = written(src.mapInArrow(partial(_cut, schema=cut, emit=_emit_digest if digest else _emit_turns), cut), "repair")
    done = parts.where(F.col("seg").isNull()).select(*[F.col("o_" + f.name).alias(f.name) for f in result])
    open_rows = parts.where(F.col("seg").isNotNull())

    n_tasks = shuffle_partitions(spark)
    segments = (open_rows.where(F.col("signs").isNotNull()).select("key", "seg", "signs", "t0", "t1", "dt")
                .repartition(n_tasks, "key").sortWithinPartitions("key", "seg"))
    chained = (T.StructType().add("key", kind).add("seg", "long").add("audit", "string").add("state", "integer")
               .add("before", "long").add("sums", T.ArrayType(T.LongType())).add("full", "string"))
    audits = written(segments.mapInArrow(partial(_chain, schema=chained), chained), "audits").drop("key")
    lead = F.col("at") == 0                          # the summary rides on one row of the segment
    joined = (open_rows.select("key", "seg", "at", "role", "text", "n").join(audits, "seg")
              .select("key", "seg", "role", "text", "n", "audit", "state", "before", F.when(lead, F.col("sums")).alias("sums"),
                      F.when(lead, F.col("full")).alias("full"), "at"))
    # turns are written by segment; a digest is one running hash, so its text passes through one task in order
    by, apply = ("key", _apply_digest) if digest else ("seg", _apply_turns)
    joined = joined.repartition(n_tasks, by).sortWithinPartitions(*dict.fromkeys([by, "seg", "at"])).drop("at")
    return done.unionByName(joined.mapInArrow(partial(apply, schema=result), result))


def repaired_turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, place, edit, role, text): the turns of every repaired conversation, places from 0.

    ``edit`` is K (kept), R (another role) or I (inserted).  NULL roles and texts read as one space,
    a NULL key is one conversation, NULL turns come first; equal turns are ordered by role and text;
    of repeated rows the first is kept; a conversation with nothing to keep has no row; other
    columns are ignored; an empty table gives no rows.
    """
    src = only(rows, key=key, turn=turn, role=role, text=text)
    return _solve(src, digest=False).drop("found").withColumnRenamed("key", key)


def repair_report(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation of
    ``rows``; odd rows as in ``repaired_turns``.  The digest is that of its ``role:text`` lines."""
    src = only(rows, key=key, turn=turn, role=role, text=text)
    return _solve(src, digest=True).select(
        F.col("key").alias(key), *[F.col("found")[i].alias(c) for i, c in enumerate(SUMMARY)],
        F.col("text").alias("audit"), F.col("edit").alias("repaired_sha256"))


def damaged_report(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``repair_report`` of the damaged rows of ``df`` with a row for every conversation of ``df``, also those of
    which no row is left (zeros, an empty audit and the digest of an empty text)."""
    report = repair_report(damage(df, key, turn, role, text), "key", "turn", "role", "text")
    names = only(df, _key=key).distinct()
    out = names.join(report, F.col("_key").eqNullSafe(F.col("key")), "left")
    return out.select(F.col("_key").alias(key), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SUMMARY],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
