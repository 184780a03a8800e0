"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

A row is kept (K), deleted (D) or given another role (R), and rows may be inserted (I), so that the initials of the roles read
`(s?(ua)+)?`. Edits are paths through a lattice of row and state, whose states are: nothing yet, after the system's
row, after a user's, after an assistant's. From both ends Dijkstra's heaps run towards each other; once they have met,
they go on until no crossing of the same cost can be missing. Of all cheapest paths through these crossings the least audit is
read off from the front.

Faults are found by Spark. A row goes through the lattice as one byte, so a conversation takes a task some bytes for each of its rows; its
texts stream past in order when the repaired text is hashed, and are never held together.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, shuffle_partitions

#: ASCII white space, and what ends a sentence.
BLANK, ENDS = " \t\n\x0b\x0c\r", ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Initials by their number in a row's byte; others are the last.
INITIALS = "sua"
FINE, CUT, GONE = 0, 4, 8  # what is added for a row's fault: none, truncated, blank or duplicate
LEGAL = {(0, 1), (1, 2), (2, 1)}
ROLE_OF = {2: "user", 3: "assistant"}  # by the state that a row leads to
ACCEPTED = (0, 3)
_FAR = 1 << 40
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def after(state: int, initial: int) -> int | None:
    """The state that a row with such an initial leads to."""
    if initial == 0:
        return 1 if state == 0 else None
    return {1: 2 if state != 2 else None, 2: 3 if state == 2 else None}.get(initial)


def _moves(code: int) -> list[list[tuple[str, int, int]]]:
    """Of each state, the (edit, next state, cost) that take a row of this byte, in order."""
    out = []
    for state in range(4):
        found = [("D", state, DELETE)]
        if code < GONE:
            more = TRUNCATED if code >= CUT else 0
            if (kept := after(state, code % 4)) is not None:
                found.append(("K", kept, more))
            found.append(("R", 3 if state == 2 else 2, REROLE + more))
        out.append(found)
    return out


_TAKE = [_moves(code) for code in range(12)]
_GIVE = [[[(s, cost) for s in range(4) for _, to, cost in moves[s] if to == t] for t in range(4)] for moves in _TAKE]


def edges(node: int, codes: bytes) -> list[tuple[str, int, int]]:
    """(edit, node, cost) of the edges that leave a node, in the order of their letters; a node is 4 * row + state."""
    row, state = divmod(node, 4)
    found = [("I", 4 * row + (3 if state == 2 else 2), INSERT)]
    if row < len(codes):
        found += [(edit, 4 * row + 4 + to, cost) for edit, to, cost in _TAKE[codes[row]][state]]
    return sorted(found)


def entering(node: int, codes: bytes) -> list[tuple[int, int]]:
    """(node, cost) of the edges that come to a node."""
    row, state = divmod(node, 4)
    found = [(4 * row + s, INSERT) for s in {2: (0, 1, 3), 3: (2,)}.get(state, ())]
    if row:
        found += [(4 * row - 4 + s, cost) for s, cost in _GIVE[codes[row - 1]][state]]
    return found


def cheapest(codes: bytes) -> tuple[int, str]:
    """(cost, audit): the least cost of edits of these rows, and of the edits at that cost the least letters in order."""
    if not codes:
        return 0, ""
    size = 4 * (len(codes) + 1)
    ahead, behind = array("q", [_FAR]) * size, array("q", [_FAR]) * size
    settled = bytearray(size)  # 1: the way here is final, 2: the way on is
    # An entry is cost and place in one number; at one cost, rows are taken in the search's direction, as keeping costs nothing.
    forward, backward, best = [0], [], _FAR
    ahead[0] = 0
    for node in (size - 4 + s for s in ACCEPTED):
        behind[node] = 0
        settled[node] = 2
        heappush(backward, size - 1 - node)
    while forward and backward and forward[0] // size + backward[0] // size <= best:
        if forward[0] // size <= backward[0] // size:
            cost, node = divmod(heappop(forward), size)
            if cost > ahead[node]:
                continue
            settled[node] |= 1
            for _, to, more in edges(node, codes):
                if cost + more < ahead[to]:
                    ahead[to] = cost + more
                    heappush(forward, (cost + more) * size + to)
                    best = min(best, ahead[to] + behind[to])
        else:
            cost, place = divmod(heappop(backward), size)
            node = size - 1 - place
            if cost > behind[node]:
                continue
            settled[node] |= 2
            for to, more in entering(node, codes):
                if cost + more < behind[to]:
                    behind[to] = cost + more
                    heappush(backward, (cost + more) * size + size - 1 - to)
                    best = min(best, ahead[to] + behind[to])
    # Crossings: nodes whose way here is final and that lead, by one edge or none, to a final way on.
    on_path, open_nodes = bytearray(size), []
    for node in range(size):
        if settled[node] & 1:
            meets = settled[node] & 2 and ahead[node] + behind[node] == best
            if meets or any(settled[to] & 2 and ahead[node] + cost + behind[to] == best for _, to, cost in edges(node, codes)):
                on_path[node] = 1
                open_nodes.append(node)
    while open_nodes:
        node = open_nodes.pop()
        for before, cost in entering(node, codes):
            if settled[before] & 1 and not on_path[before] and ahead[before] + cost == ahead[node]:
                on_path[before] = 1
                open_nodes.append(before)
    node, spent, audit = 0, 0, []
    while node < size - 4 or node % 4 not in ACCEPTED or spent < best:
        for edit, to, cost in edges(node, codes):
            if (on_path[to] and ahead[to] == spent + cost) or (settled[to] & 2 and spent + cost + behind[to] == best):
                node, spent = to, spent + cost
                audit.append(edit)
                break
        else:
            raise AssertionError("no edge of a cheapest path")
    return best, "".join(audit)


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv, turn, role, text) with nth, the count of equal role and text up to here, and code, a row's byte."""
    nth = F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    left = F.rtrim("text", F.lit(BLANK))
    fault = F.when((left == "") | (F.col("nth") > 1), GONE).when(F.substring(left, -1, 1).isin(*ENDS), FINE).otherwise(CUT)
    initial = F.substring("role", 1, 1)
    number = F.coalesce(*[F.when(initial == c, k) for k, c in enumerate(INITIALS)], F.lit(3))
    blank = (left == "").alias("blank")
    return rows.withColumn("nth", nth).select("conv", "turn", "role", "text", "nth", blank, (number + fault).cast("tinyint").alias("code"))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("nth")]


def _by_conversation(rows: DataFrame, *order: Column) -> DataFrame:
    return rows.repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *order)


def audits(rows: DataFrame) -> DataFrame:
    """(conv, STATS, audit) of conversations whose rows have faults."""
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, {', '.join(f'{c} long' for c in STATS)}, audit string"

    def record(conv, codes: bytearray, blank: int, turns: tuple[int | None, int | None, int]) -> tuple:
        cost, audit = cheapest(bytes(codes))
        low, high, n = turns
        cut, gone = sum(1 for c in codes if CUT <= c < GONE), sum(1 for c in codes if c >= GONE)
        illegal = sum((a % 4, b % 4) not in LEGAL for a, b in zip(codes, codes[1:], strict=False))
        return conv, high - low + 1 - n if n else 0, blank, gone - blank, cut, illegal, cost, audit

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, at = False, None
        codes, blank, low, high, n = bytearray(), 0, None, None, 0
        for batch in batches:
            out = []
            for conv, turn, is_blank, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not open_one or conv != at:
                    if open_one:
                        out.append(record(at, codes, blank, (low, high, n)))
                    open_one, at = True, conv
                    codes, blank, low, high, n = bytearray(), 0, None, None, 0
                codes.append(code)
                blank += is_blank
                if turn is not None and turn != high:
                    low, high, n = turn if low is None else low, turn, n + 1
            yield _batch(out, schema)
        yield _batch([record(at, codes, blank, (low, high, n))] if open_one else [], schema)

    return _by_conversation(rows, *_order()).select("conv", "turn", "blank", "code").mapInArrow(solved, schema)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = [pa.array([r[k] for r in rows], types[c.split()[1]]) for k, c in enumerate(schema.split(", "))]
    return pa.RecordBatch.from_arrays(columns, names)


class _Repaired:
    """The hash of a conversation's repaired lines, fed row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first, self.hash = audit, 0, 0, True, hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = 3 if self.state == 2 else 2
            self._line(ROLE_OF[self.state], "")

    def row(self, role: str, text: str) -> None:
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = after(self.state, INITIALS.index(role[0]))
            self._line(role, text)
        elif edit == "R":
            self.state = 3 if self.state == 2 else 2
            self._line(ROLE_OF[self.state], text)

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def hashed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found (conv, STATS, audit) with repaired_sha256: each conversation's audit comes first in a task, then its rows in order."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kind = rows.schema["conv"].dataType.simpleString()
    lines = rows.select("conv", F.lit(1).alias("part"), "turn", "role", "text", "nth", *[none(c, "long") for c in STATS], none("audit", "string"))
    heads = found.select("conv", F.lit(0).alias("part"), none("turn", "long"), none("role", "string"), none("text", "string"), none("nth", "int"), *STATS, "audit")
    schema = f"conv {kind}, {', '.join(f'{c} long' for c in STATS)}, audit string, repaired_sha256 string"

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state = None, None
        for batch in batches:
            out = []
            for conv, part, role, text, *stats in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part == 0:
                    if head is not None:
                        out.append((*head, state.digest()))
                    head, state = (conv, *stats), _Repaired(stats[-1])
                else:
                    state.row(role, text)
            yield _batch(out, schema)
        yield _batch([(*head, state.digest())] if head is not None else [], schema)

    return _by_conversation(heads.unionByName(lines), F.col("part"), *_order()).select("conv", "part", "role", "text", *STATS, "audit").mapInArrow(fed, schema)


def repair(conversations: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id") -> DataFrame:
    """(conv_col, STATS, audit, repaired_sha256) of each conversation, and of those of ids (conv_col) that have no rows.

    Rows are taken by turn, nulls first; ties by role, then text. A null role or text counts as one space. A row's first fault counts: blank, duplicate
    (role and text of an earlier row), truncated (without a sentence's end). A conversation without rows has zeros, an
    empty audit and the hash of the empty string. Rows with a null conversation are one conversation. Other columns are
    ignored; no rows and no ids give no rows.
    """
    space = lambda c: F.coalesce(conversations[c], F.lit(" ")).alias(c)
    rows = conversations.select(conversations[conv_col].alias("conv"), conversations["turn"].cast("long").alias("turn"), space("role"), space("text"))
    rows = settle(with_faults(rows))
    out = hashed(rows, settle(audits(rows)))
    if ids is not None:
        named = ids.select(ids[conv_col].alias("of_ids")).distinct()
        out = named.join(out, F.col("of_ids").eqNullSafe(F.col("conv")), "left").drop("conv").withColumnRenamed("of_ids", "conv")
        out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in STATS} | {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))})
    return out.select(F.col("conv").alias(conv_col), *STATS, "audit", "repaired_sha256")


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults put in by a checksum of id and turn; null values count as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ENDS, "")).otherwise(space("text"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op12_turn_repair(spark, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(given), given.select("conv_id"))


def _sql() -> str:
    """The lattice a row at a time, for small tables: of each state the least (cost, audit), with the lines so far."""
    step = lambda z, c, a, line: f"{{'c': {z}.c + {c}, 'a': {z}.a || '{a}', 't': {z}.t || {line}}}"
    never = "{'c': 1000000000, 'a': '', 't': ''}"
    line = lambda role: f"chr(10) || {role} || ':' || text"
    made = lambda z, role: step(z, 5, "I", f"chr(10) || '{role}:'")
    u = f"least(zu, {made('z0', 'user')}, {made('zs', 'user')}, {made('za', 'user')})"
    closed = f"z0, zs, {u} AS zu, least(za, {made('zu', 'assistant')}) AS za"
    drop = lambda z: step(z, 2, "D", "''")
    use = lambda test, x: f"CASE WHEN {test} THEN {x} ELSE {never} END"
    keep = lambda z, k: use(f"NOT gone AND k = '{k}'", step(z, "p", "K", line("role")))
    rerole = lambda z, role: use("NOT gone", step(z, "1 + p", "R", line(f"'{role}'")))
    from_any = ", ".join(f"{keep(z, 'u')}, {rerole(z, 'user')}" for z in ("z0", "zs", "za"))
    taken = f"{drop('z0')}, least({drop('zs')}, {keep('z0', 's')}), least({drop('zu')}, {from_any}), least({drop('za')}, {keep('zu', 'a')}, {rerole('zu', 'assistant')})"
    return rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, w: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 20 AS kind FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM c)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, regexp_matches(text, '[^\x20\x09-\x0D]') AS says FROM d
), r AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS k, lag(left(role, 1)) OVER w AS before, NOT says OR nth > 1 AS gone, CASE WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 0 ELSE 5 END AS p
  FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)
), z AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS z0, {never.replace("1000000000", "1000000000::BIGINT")} AS zs, {never.replace("1000000000", "1000000000::BIGINT")} AS zu, {never.replace("1000000000", "1000000000::BIGINT")} AS za FROM conversations
  UNION ALL
  SELECT q.conv_id, r.i, {taken} FROM (SELECT conv_id, i, {closed} FROM z) q JOIN r ON r.conv_id IS NOT DISTINCT FROM q.conv_id AND r.i = q.i + 1
), e AS (
  SELECT conv_id, least(z0, za) AS x FROM (SELECT conv_id, i, {closed} FROM z QUALIFY i = max(i) OVER (PARTITION BY conv_id))
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (NOT says) AS blank, count(*) FILTER (says AND nth > 1) AS duplicate, count(*) FILTER (NOT gone AND p > 0) AS truncated,
    count(*) FILTER (before || k NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, x.c AS cost, x.a AS audit, sha256(substr(x.t, 2)) AS repaired_sha256
FROM e LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM e.conv_id
"""


ORACLE_SQL = _sql()
QUERIES = {"op12_turn_repair": (op12_turn_repair, ORACLE_SQL)}
