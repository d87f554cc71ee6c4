"""Conversation structure repair by lightest derivations (Knuth 1977) over an agenda.

Items say: the first i rows are dealt with, and the roles kept so far leave the automaton of (s?(ua)+)? in a state. A row is an item
of its own, with the weight (0, ""). Deductions are hyperedges: an item and the row after it give the item behind that row (Keep, Rerole,
Delete), one item gives another at the same row (Insert); an accepting item behind the last row gives the goal. A deduction adds the cost of its edit
and appends its initial. The agenda pops items by (cost, audit); the first time that an item is popped is final, and the goal's is the answer.

That is right as the functions are superior: a cost is never negative and an audit that grows is never less, so a conclusion is not
less than its premises. They are monotone, too: of two audits of one item with equal cost none begins with the other, as it
would hold the same edits and further inserts, which cost more; so what is appended to both never changes their order.

Audits share their beginnings: an audit is its last edit and a link to the audit before it, and equal audits are one object. Two of them are compared in
logarithmic time by skipping back to where they part, so memory grows with a conversation's rows, not with their square.

Damage and faults are native, by windows over a conversation. For each conversation its rows' codes come first, and then its rows, in order: so a task
holds a byte and some agenda items a row, and texts stream into the digest. A conversation lies in one task, as
its lightest derivation and its digest are made from its beginning to its end.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import total_ordering

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: State after a kept initial: 0 nothing yet, 1 after s, 2 after u, 3 after a. 0 and 3 accept.
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ACCEPTING = (0, 3)
_ROLES = {"u": "user", "a": "assistant"}


@total_ordering
class Audit:
    """A sequence of edits; ASCII order. Of equal sequences there is one object a conversation."""

    __slots__ = ("before", "letter", "length", "skip", "after")

    def __init__(self, before: Audit | None = None, letter: str = ""):
        self.before, self.letter, self.after = before, letter, None
        if before is None:
            self.length, self.skip = 0, self
        else:
            self.length = before.length + 1
            far = before.skip
            self.skip = far.skip if before.length - far.length == far.length - far.skip.length else before

    def then(self, letter: str) -> Audit:
        if self.after is None:
            self.after = {}
        found = self.after.get(letter)
        if found is None:
            found = self.after[letter] = Audit(self, letter)
        return found

    def cut(self, length: int) -> Audit:
        x = self
        while x.length > length:
            x = x.skip if x.skip.length >= length else x.before
        return x

    def __lt__(self, other: Audit) -> bool:
        if self is other:
            return False
        n = min(self.length, other.length)
        a, b = self.cut(n), other.cut(n)
        if a is b:
            return self.length < other.length
        while a.before is not b.before:
            a, b = (a.skip, b.skip) if a.skip is not b.skip else (a.before, b.before)
        return a.letter < b.letter

    def __str__(self) -> str:
        out, x = [], self
        while x.before is not None:
            out.append(x.letter)
            x = x.before
        return "".join(reversed(out))


def repair(rows: str) -> tuple[int, str]:
    """Cost and audit of the lightest derivation. rows: a letter each, s, u, a or x for what begins otherwise; in upper case if
    truncated, and - if it must be deleted."""
    n = len(rows)
    goal = (n, 4)
    agenda: list[tuple[int, Audit, int, int]] = [(0, Audit(), 0, 0)]
    final: set[tuple[int, int]] = set()
    while agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        if (i, state) == goal:
            return cost, str(audit)
        final.add((i, state))

        def conclude(j: int, role: str, price: int, letter: str) -> None:
            to = _NEXT.get((state, role)) if role else state  # noqa: B023
            if to is not None and (j, to) not in final:
                heapq.heappush(agenda, (cost + price, audit.then(letter), j, to))  # noqa: B023

        if i < n:
            row = rows[i]
            conclude(i + 1, "", DELETE, "D")
            if row != "-":
                more = TRUNCATED if row.isupper() else 0
                conclude(i + 1, row.lower(), KEEP + more, "K")
                for role in _ROLES:
                    conclude(i + 1, role, REROLE + more, "R")
        elif state in _ACCEPTING:
            heapq.heappush(agenda, (cost, audit, n, 4))
        for role in _ROLES:
            conclude(i, role, INSERT, "I")
    raise ValueError("deleting every row is always a derivation")


class Writer:
    """The digest of a repaired conversation, whose rows come in order."""

    def __init__(self, rows: str):
        self.cost, self.audit = repair(rows)
        self.at = self.state = 0
        self.sha = hashlib.sha256()
        self.empty = True

    def _put(self, role: str, text: str) -> None:
        self.sha.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty = False

    def _due(self) -> str:
        """The role that has to come, where it is an edit that names one."""
        return "a" if self.state == 2 else "u"

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            role = self._due()
            self._put(_ROLES[role], "")
            self.state = _NEXT[self.state, role]
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            initial = role[:1] if edit == "K" else self._due()
            self._put(role if edit == "K" else _ROLES[initial], text)
            self.state = _NEXT[self.state, initial]

    def end(self) -> tuple[int, str, str]:
        self.inserts()
        return self.cost, self.audit, self.sha.hexdigest()


_REPAIRED = "conv string, cost long, audit string, repaired_sha256 string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conv, code, role and text: of each conversation first the codes of all rows, then the rows without a code."""
    own: str | None = None
    codes: list[str] = []
    writer: Writer | None = None

    def done(out: list) -> None:
        if own is not None:
            out.append((own, *(writer or Writer("".join(codes))).end()))

    def table(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["conv", "cost", "audit", "repaired_sha256"])

    for batch in batches:
        out: list = []
        for conv, code, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != own:
                done(out)
                own, codes, writer = conv, [], None
            if code is not None:
                codes.append(code)
                continue
            if writer is None:
                writer = Writer("".join(codes))
                codes = []
            writer.row(role, text)
        if out:
            yield table(out)
    out = []
    done(out)
    if out:
        yield table(out)


#: What is no white space, and a text's last such character being no end of a sentence.
_INK, _OPEN = r"[^\x20\x09-\x0D]", r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and again (1 for a row's repetition) of the rows that the damage leaves. A null is one space, also in the key of the damage."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    again = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    # What orders rows of equal turn is what they held before the damage, so a repeated row stays beside its origin.
    marks = F.xxhash64("role", "text")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.col("role").alias("was"), F.substring("text", 1, 64).alias("began"), marks.alias("mark"), F.explode(again).alias("again"))


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, place, role, text, fault (blank, duplicate, truncated or null) and last (the initial before a row's) of rows as damaged() gives them."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    order = [F.asc_nulls_first("turn"), F.col("was"), F.col("began"), F.col("mark"), F.col("again")]
    own = Window.partitionBy("conv").orderBy(*order)
    rows = rows.withColumn("conv", conv).withColumn("place", F.row_number().over(own)).withColumn("last", F.lag(F.substring("role", 1, 1)).over(own))
    alike = Window.partitionBy("conv", "role", "sha").orderBy("place")
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("nth", F.row_number().over(alike))
    fault = F.when(~F.col("text").rlike(_INK), F.lit("blank")).when(F.col("nth") > 1, F.lit("duplicate")).when(F.col("text").rlike(_OPEN), F.lit("truncated"))
    return rows.select("conv", "turn", "place", "role", "text", fault.alias("fault"), "last")


def code(role: Column, fault: Column) -> Column:
    """A row's letter for repair()."""
    initial = F.substring(role, 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("x"))
    return F.when(fault.isin("blank", "duplicate"), F.lit("-")).when(fault == "truncated", F.upper(letter)).otherwise(letter)


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conv_id in conversations.

    Nulls in role and text are one space, so such a text is blank; null turns come first; rows without a conv_id are one
    conversation, whose conv_id is null. Rows of equal turn are ordered by role, the text's beginning and its hash, as they were before
    the damage; repeated rows are duplicates. A role counts by its first character; an empty one, or another than s, u and a, fits
    nowhere. Very long texts stream into the digest. A conversation without rows after the damage has zeros, an empty
    audit and the digest of nothing. Other columns are not read. An empty table gives no rows.
    """
    rows = faults(damaged(conversations))
    none = F.lit(None).cast("string")
    part = lambda phase, letter, text: F.struct(F.lit(phase).alias("phase"), letter.alias("code"), text.alias("text"))
    parts = F.explode(F.array(part(0, code(F.col("role"), F.col("fault")), none), part(1, none, F.col("text"))))
    stream = rows.select("conv", "place", "role", parts.alias("p")).select("conv", "place", "role", "p.*")
    stream = stream.repartition("conv").sortWithinPartitions("conv", "phase", "place").select("conv", "code", "role", "text")
    repaired = stream.mapInArrow(_repaired, _REPAIRED)

    pair = F.concat("last", F.substring("role", 1, 1))
    legal = pair.isin("su", "ua", "au")
    counts = rows.groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *(F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")),
        F.count_if(F.col("last").isNotNull() & ~legal).alias("illegal"),
    )
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = ids.join(counts, "conv", "left").join(repaired, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(X, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295)"
#: Row by row, the best derivation of each state; more than two inserts between rows only lead back to a state.
ORACLE = r"""
WITH RECURSIVE o AS (
  SELECT conv_id AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CRC % 20 AS kind FROM conversations
), d AS (
  SELECT c, turn, role AS was, text AS had, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again FROM o WHERE kind <> 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, was, had, again) AS i FROM d
), r AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS last,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault FROM p
), move(q, role, q2) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ins AS (
  SELECT q, '' AS edits, []::STRUCT(role VARCHAR, text VARCHAR)[] AS said, 0 AS cost, q AS q2 FROM (VALUES (0), (1), (2), (3)) AS s(q)
  UNION ALL SELECT q, 'I', [{'role': CASE role WHEN 'u' THEN 'user' ELSE 'assistant' END, 'text': ''}], 3, q2 FROM move WHERE role <> 's'
  UNION ALL SELECT a.q, 'II', [{'role': CASE a.role WHEN 'u' THEN 'user' ELSE 'assistant' END, 'text': ''}, {'role': CASE b.role WHEN 'u' THEN 'user' ELSE 'assistant' END, 'text': ''}], 6, b.q2 FROM move a JOIN move b ON a.q2 = b.q WHERE a.role <> 's' AND b.role <> 's'
), step AS (
  SELECT c, i, ins.q, 4 + ins.cost AS cost, ins.edits || 'D' AS edits, said, ins.q2 FROM r, ins
  UNION ALL SELECT c, i, ins.q, ins.cost + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, ins.edits || 'K', list_append(said, {'role': r.role, 'text': text}), m.q2 FROM r, ins JOIN move m ON m.q = ins.q2 WHERE r.initial = m.role AND (fault IS NULL OR fault = 'truncated')
  UNION ALL SELECT c, i, ins.q, ins.cost + 3 + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, ins.edits || 'R', list_append(said, {'role': CASE m.role WHEN 'u' THEN 'user' ELSE 'assistant' END, 'text': text}), m.q2 FROM r, ins JOIN move m ON m.q = ins.q2 WHERE m.role <> 's' AND (fault IS NULL OR fault = 'truncated')
), walk(c, i, q, cost, audit, said) AS (
  SELECT DISTINCT c, 0::BIGINT, 0, 0, '', []::STRUCT(role VARCHAR, text VARCHAR)[] FROM r
  UNION ALL
  SELECT c, i, q, best.cost, best.audit, best.said FROM (
    SELECT w.c, s.i, s.q2 AS q, min({'cost': w.cost + s.cost, 'audit': w.audit || s.edits, 'said': list_concat(w.said, s.said)}) AS best FROM walk w JOIN step s ON s.c = w.c AND s.i = w.i + 1 AND s.q = w.q GROUP BY w.c, s.i, s.q2)
), finished AS (
  SELECT w.c, min({'cost': w.cost + ins.cost, 'audit': w.audit || ins.edits, 'said': list_concat(w.said, ins.said)}) AS best
  FROM walk w JOIN (SELECT c, max(i) AS n FROM r GROUP BY c) e ON e.c = w.c AND e.n = w.i JOIN ins ON ins.q = w.q WHERE ins.q2 IN (0, 3) GROUP BY w.c
), counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (last IS NOT NULL AND last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c
)
SELECT ids.c AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit,
  sha256(coalesce(array_to_string(list_transform(best.said, lambda x: x.role || ':' || x.text), chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id AS c FROM conversations) ids LEFT JOIN counts USING (c) LEFT JOIN finished USING (c)""".replace("CRC", _CRC.replace("X", "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"))
