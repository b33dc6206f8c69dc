"""Conversation structure repair: the cheapest edits that make roles alternate, with the ASCII-least audit of equal cost.

Rows of a conversation are damaged by rule, ordered by turn (nulls first; equal turns by digest of role and text, then
copy), and read once as a stream. The dynamic program keeps one best edit prefix for each of four states (start, after s,
after u, after a). Prefixes are linked nodes that share their past; each node has ancestors at powers of two and a rolling
hash of its whole prefix. Two prefixes of equal cost are compared by searching the ancestors for the longest common
prefix; equal hashes of different nodes are then verified character by character, so hashes never decide.

Within one state and row equal cost means that neither audit is a prefix of the other (they would differ by inserts,
which cost), so the least prefix stays least whatever follows. A state that costs more than a cheaper one plus all it could
still save is dropped, which is exact. What all live prefixes share is settled and its nodes are freed.

A conversation's repaired text has one SHA-256, which is sequential: so a conversation is one task's, as a stream sorted by
Spark. The task never holds its rows: the first pass sees flags only, the second hashes texts as they come. What grows with
one conversation is its audit (a byte a row) and the nodes of unsettled rows.

Defined cases: null conv_id, turn, role and text count as one space in the damage rule and in rows; a null conv_id is a
conversation of its own. Repeated rows are rows of their own. Empty roles have no initial and can't be kept. Empty tables
give no rows; a conversation without rows after damage gives zeros, an empty audit and the empty string's hash. Turns so
far apart that no long holds the gaps give the largest long. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm import shared

BLANKS = " \t\n\x0b\x0c\r"
RETURN, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state that a kept role initial leads to from each state.
KEPT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_A, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A}
LEGAL = {"su", "ua", "au"}
MOST = 2**63 - 1
FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Prefixes:
    """Linked edit prefixes. Node 0 is the settled prefix; a node's number is larger than its parent's."""

    MODULUS, BASE = 2**61 - 1, 1_000_003

    def __init__(self) -> None:
        self.settled = bytearray()
        self._clear()

    def _clear(self) -> None:
        self.letter, self.depth, self.hash, self.up = bytearray(1), array("q", [0]), array("q", [0]), [array("q", [0])]

    def __len__(self) -> int:
        return len(self.letter)

    def add(self, parent: int, letter: int) -> int:
        node, depth = len(self.letter), self.depth[parent] + 1
        self.letter.append(letter)
        self.depth.append(depth)
        self.hash.append((self.hash[parent] * self.BASE + letter) % self.MODULUS)
        while depth >> len(self.up):
            self.up.append(array("q", bytes(8 * node)))
        above = parent
        for level in self.up:
            level.append(above)
            above = level[above]
        return node

    def ancestor(self, node: int, depth: int) -> int:
        rise, k = self.depth[node] - depth, 0
        while rise:
            if rise & 1:
                node = self.up[k][node]
            rise, k = rise >> 1, k + 1
        return node

    def _equal(self, a: int, b: int) -> bool:
        """Whether two prefixes of one depth are the same, letter by letter until they share a node."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[0][a], self.up[0][b]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether prefix ``a`` sorts before prefix ``b``."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] == self.hash[y] and self._equal(x, y):
            return self.depth[a] < self.depth[b]
        high, low = (x, y), None
        for level in reversed(self.up):
            p, q = level[x], level[y]
            if p != q and self.hash[p] != self.hash[q]:
                x, y = p, q
        if x != y and self._equal(self.up[0][x], self.up[0][y]) and self.letter[x] != self.letter[y]:
            return self.letter[x] < self.letter[y]
        low = [self.text(n) for n in high]  # hashes collided somewhere: the letters themselves decide
        return low[0] < low[1]

    def text(self, node: int) -> bytes:
        """The prefix's letters beyond the settled ones."""
        out = bytearray()
        while node:
            out.append(self.letter[node])
            node = self.up[0][node]
        return bytes(reversed(out))

    def settle(self, live: list[int]) -> list[int]:
        """Free all nodes but those of ``live`` prefixes beyond what these share; returns their new numbers."""
        front = set(live)
        while len(front) > 1:  # the deepest steps back until all meet
            node = max(front)
            front.remove(node)
            front.add(self.up[0][node])
        root = front.pop()
        need: set[int] = set()
        for node in live:
            while node != root and node not in need:
                need.add(node)
                node = self.up[0][node]
        self.settled += self.text(root)
        kept = [(n, self.up[0][n], self.letter[n]) for n in sorted(need)]
        self._clear()
        number = {root: 0}
        for node, parent, letter in kept:
            number[node] = self.add(number[parent], letter)
        return [number[n] for n in live]


class Audit:
    """The program over one conversation's rows, fed one by one."""

    def __init__(self, settle_at: int = 4096) -> None:
        self.paths, self.settle_at, self.next_settle = Prefixes(), settle_at, settle_at
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]

    def _offer(self, to: list[tuple[int, int] | None], state: int, cost: int, parent: int, letter: str) -> None:
        now = to[state]
        if now is None or cost < now[0]:
            to[state] = (cost, self.paths.add(parent, ord(letter)))
        elif cost == now[0]:
            node = self.paths.add(parent, ord(letter))
            if self.paths.less(node, now[1]):
                to[state] = (cost, node)

    def _insert(self) -> None:
        best = self.best
        for state in (START, AFTER_S, AFTER_A):
            if best[state] is not None:
                self._offer(best, AFTER_U, best[state][0] + INSERT, best[state][1], "I")
        if best[AFTER_U] is not None:
            self._offer(best, AFTER_A, best[AFTER_U][0] + INSERT, best[AFTER_U][1], "I")
        least = best[AFTER_A][0]
        for state, saves in ((START, DELETE), (AFTER_S, 0)):  # what a state can save at most against one after a
            if best[state] is not None and best[state][0] > least + saves:
                best[state] = None

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        self._insert()
        after: list[tuple[int, int] | None] = [None] * 4
        for state, at in enumerate(self.best):
            if at is None:
                continue
            cost, node = at
            self._offer(after, state, cost + DELETE, node, "D")
            if must_go:
                continue
            more = TRUNCATED if truncated else 0
            if (state, initial) in KEPT:
                self._offer(after, KEPT[state, initial], cost + RETURN + more, node, "K")
            self._offer(after, AFTER_A if state == AFTER_U else AFTER_U, cost + REROLE + more, node, "R")
        self.best = after
        if len(self.paths) > self.next_settle:
            states = [s for s in range(4) if after[s] is not None]
            for s, node in zip(states, self.paths.settle([after[s][1] for s in states]), strict=True):
                after[s] = (after[s][0], node)
            self.next_settle = 2 * len(self.paths) + self.settle_at

    def end(self) -> tuple[int, str]:
        """Cost and audit."""
        self._insert()
        start, last = self.best[START], self.best[AFTER_A]
        if start is not None and (start[0] < last[0] or start[0] == last[0] and self.paths.less(start[1], last[1])):
            last = start
        return last[0], (bytes(self.paths.settled) + self.paths.text(last[1])).decode()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with ``ghost`` rows for those that are dropped, and what orders and describes a row."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("code") == 0).alias("ghost"), F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return rows.withColumn("digest", digest)


def in_order(*before: str) -> list[Column]:
    return [*[F.col(c) for c in before], F.col("turn").asc_nulls_first(), F.col("digest"), F.col("copy")]


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, the figures and the audit of each conversation of ``damaged`` rows."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    flags = rows.select("conv_id", "turn", "ghost", "copy", "digest", F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    same = Window.partitionBy("conv_id", "ghost", "digest").orderBy(*in_order())
    flags = flags.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1).sortWithinPartitions(*in_order("conv_id"), "again")
    key = rows.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, any_row, out = None, False, []
        for conv_id, turn, ghost, initial, blank, again, truncated in shared.rows_of(batches):
            if not any_row or conv_id != now:
                if any_row:
                    out.append(finish())
                now, any_row = conv_id, True
                audit, counts, turns, last = Audit(), dict.fromkeys(FIGURES, 0), [None, None, 0], None
            if not ghost:
                fault = "blank" if blank else "duplicate" if again else "truncated" if truncated else None
                if fault:
                    counts[fault] += 1
                counts["illegal"] += last is not None and last + initial not in LEGAL
                last = initial
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                audit.row(initial, fault in ("blank", "duplicate"), fault == "truncated")

            def finish(now=now, audit=audit, counts=counts, turns=turns):
                cost, letters = audit.end()
                gaps = min(MOST, turns[1] - turns[0] + 1 - turns[2]) if turns[2] else 0
                return (now, *(counts | {"gaps": gaps, "cost": cost}).values(), letters)

            if len(out) >= 4000:
                yield batch(out)
                out = []
        if any_row:
            out.append(finish())
        yield batch(out)

    schema = T.StructType([T.StructField("conv_id", key), *[T.StructField(f, T.LongType()) for f in FIGURES], T.StructField("audit", T.StringType())])
    arrow = _arrow(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return flags.select("conv_id", "turn", "ghost", "initial", "blank", "again", "truncated").mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (see ``audits``) with the SHA-256 of each repaired conversation: its audit comes first, then its rows."""
    rest = [f.name for f in found.schema if f.name != "conv_id"]
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("copy"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.struct(*rest).alias("head"))
    lines = rows.where(~F.col("ghost")).select("conv_id", F.lit(1).alias("kind"), "turn", "digest", "copy", "role", "text", F.lit(None).cast(heads.schema["head"].dataType).alias("head"))
    stream = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions(*in_order("conv_id", "kind")).select("conv_id", "kind", "role", "text", "head")
    schema = T.StructType([*found.schema.fields, T.StructField("repaired_sha256", T.StringType())])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now = None
        for conv_id, kind, role, text, head in shared.rows_of(batches):
            if kind == 0:
                if now is not None:
                    out.append(now.end())
                now = Repair(conv_id, head)
            else:
                now.row(role, text)
            if len(out) >= 4000:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if now is not None:
            out.append(now.end())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    return stream.mapInArrow(run, schema)


class Repair:
    """Applies an audit to a conversation's rows as they come."""

    def __init__(self, conv_id, head: dict):
        self.conv_id, self.head, self.letters = conv_id, head, head["audit"]
        self.at, self.state, self.hash, self.empty = 0, START, hashlib.sha256(), True

    def _write(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode())
        self.empty, self.state = False, {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[role[0]]

    def _due(self) -> str:
        return "assistant" if self.state == AFTER_U else "user"

    def _inserts(self) -> None:
        while self.letters[self.at : self.at + 1] == "I":
            self._write(self._due(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            self._write(role if letter == "K" else self._due(), text)

    def end(self) -> tuple:
        self._inserts()
        return (self.conv_id, *self.head.values(), self.hash.hexdigest())


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    shared.prepare(conversations.sparkSession)
    rows = damaged(conversations)
    return repaired(rows, audits(rows))


def op11_conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(shared.table(spark, sf_dir, "conversations"))


QUERIES = {"op11_conversation_audit": op11_conversation_audit}
ORACLE_SQL = {
    "op11_conversation_audit": r"""
WITH RECURSIVE o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295] || list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT)),
      lambda c, x: list_reduce([xor(c, x)] || range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 20 AS code
  FROM conversations
), d AS (
  SELECT row_number() OVER () AS id, conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM o, unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS u(k) WHERE code <> 0
), e AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id) > 1 AS again, lag(role) OVER w AS before,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text), id)
), f AS (
  SELECT *, CASE WHEN t = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS x,
    before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS wrong
  FROM e
), p AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': '', 't': CAST(NULL AS VARCHAR)} AS s0,
    {'c': CAST(1000000000 AS BIGINT), 'a': '', 't': CAST(NULL AS VARCHAR)} AS s1, {'c': CAST(1000000000 AS BIGINT), 'a': '', 't': CAST(NULL AS VARCHAR)} AS s2, {'c': CAST(1000000000 AS BIGINT), 'a': '', 't': CAST(NULL AS VARCHAR)} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i,
    {'c': s0.c + 2, 'a': s0.a || 'D', 't': s0.t},
    list_sort([{'c': s1.c + 2, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + k + CASE WHEN x = 's' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K', 't': coalesce(s0.t || chr(10), '') || role || ':' || text}])[1],
    list_sort([{'c': u.c + 2, 'a': u.a || 'D', 't': u.t}] || list_transform([s0, s1, a], lambda s: {'c': s.c + k + CASE WHEN x = 'u' THEN 0 ELSE 1000000000 END, 'a': s.a || 'K', 't': coalesce(s.t || chr(10), '') || role || ':' || text})
      || list_transform([s0, s1, a], lambda s: {'c': s.c + k + 1, 'a': s.a || 'R', 't': coalesce(s.t || chr(10), '') || 'user:' || text}))[1],
    list_sort([{'c': a.c + 2, 'a': a.a || 'D', 't': a.t}, {'c': u.c + k + CASE WHEN x = 'a' THEN 0 ELSE 1000000000 END, 'a': u.a || 'K', 't': coalesce(u.t || chr(10), '') || role || ':' || text},
      {'c': u.c + k + 1, 'a': u.a || 'R', 't': coalesce(u.t || chr(10), '') || 'assistant:' || text}])[1]
  FROM (
    SELECT *, list_sort([s3, {'c': u.c + 5, 'a': u.a || 'I', 't': coalesce(u.t || chr(10), '') || 'assistant:'}])[1] AS a
    FROM (
      SELECT p.conv_id, f.i, f.role, f.text, f.x, CASE f.fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END AS k, s0, s1, s3,
        list_sort([s2] || list_transform([s0, s1, s3], lambda s: {'c': s.c + 5, 'a': s.a || 'I', 't': coalesce(s.t || chr(10), '') || 'user:'}))[1] AS u
      FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1
    )
  )
), n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
    count_if(fault = 'truncated') AS truncated, count_if(wrong) AS illegal
  FROM f GROUP BY conv_id
), z AS (
  SELECT p.conv_id, n.*, list_sort([s0, s3, {'c': s2.c + 5, 'a': s2.a || 'I', 't': s2.t || chr(10) || 'assistant:'}] || list_transform([s0, s1], lambda s: {'c': s.c + 10, 'a': s.a || 'II', 't': coalesce(s.t || chr(10), '') || 'user:' || chr(10) || 'assistant:'}))[1] AS b
  FROM p LEFT JOIN n ON p.conv_id IS NOT DISTINCT FROM n.conv_id WHERE p.i = coalesce(n.n, 0)
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, b.c AS cost, b.a AS audit, sha256(coalesce(b.t, '')) AS repaired_sha256
FROM z
"""
}
