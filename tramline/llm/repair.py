"""Repair of conversation structure by the auction algorithm for shortest paths.

The rows of a conversation, in the order of their turns, and the states of the wanted form
``(s?(ua)+)?`` span a lattice. Node (i, state) stands before row i; its arcs keep the row,
set its role, delete it, or insert an empty text. Costs are integers. A virtual node beyond
the last row is reached at no cost from the states in which a conversation may end.

The auction holds a price for each node and a path from the origin. If the path's last node is
priced below the least of (arc cost + price of the arc's end), its price is raised to that
and the path gives the node up (contraction); else the path is extended by such an arc. Prices
stay at most (arc cost + price of the arc's end) everywhere, so once the path reaches the
target, every arc of every cheapest path is tight: its cost is the difference of the prices at
its ends. Arcs that are tight and lead to the target over tight arcs are marked from the
target backwards, and the cheapest edits of least letters are traced along them. From any
state a letter leads to one state, so the trace decides letter by letter.

Prices start from the sum of each later row's cheapest arc, which meets that condition. A long
conversation is cut into segments of ``SEGMENT`` rows, from the last to the first; a segment's
last nodes are joined to the target at the prices of the next segment's first ones, and the
auction is run from each of its four first nodes with the prices it has. So work grows with the
number of rows.

Faults are found, and repeated texts looked up, by Spark in one shuffle by conversation, sorted
there with spilling. A conversation meets one task as a stream, because its digest is taken in
order: some ten bytes a row are held for the lattice, the rows themselves in a spooled file
until they are hashed.

Defined cases: null ids, roles and texts count as one space (a null id's conversation keeps its
null id in the result); null turns come first; rows of one turn are ordered by role and text;
rows beyond damage of a role that begins with no known letter can be deleted or given a role
only; a conversation without rows has zeros and the empty audit; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tramline.llm.common import table

ROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
SEGMENT = 128
SPOOLED = 32 << 20
FAR = 1 << 40

# States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
# State after a user or an assistant row that is made or inserted.
MADE = (USER, USER, ASSISTANT, USER)

SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
REPAIRED = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
            "cost bigint, audit string, repaired_sha256 string")


def arcs(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of what may be done with a row, in the order of the letters."""
    out = [("D", DELETE_COST, state)]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        if initial in AFTER[state]:
            out.append(("K", more, AFTER[state][initial]))
        out.append(("R", more + ROLE_COST, MADE[state]))
    return out


class Segment:
    """The lattice over some rows, joined to the target at ``beyond``, the costs from its last nodes."""

    def __init__(self, rows: list[tuple[str, int]], beyond: list[int]):
        n = len(rows)
        self.target = 4 * n + 4
        self.out: list[list[tuple[str, int, int]]] = []
        kinds: dict = {}
        for i, row in enumerate(rows):
            told = kinds.get(row) or kinds.setdefault(row, [arcs(*row, s) for s in range(4)])
            for state in range(4):
                own = [(letter, cost, 4 * i + 4 + to) for letter, cost, to in told[state]]
                own.insert(1, ("I", INSERT_COST, 4 * i + MADE[state]))
                self.out.append(own)
        for state in range(4):
            own = [("I", INSERT_COST, 4 * n + MADE[state])]
            if beyond[state] < FAR:
                own.append(("", beyond[state], self.target))
            self.out.append(own)
        self.out.append([])
        # Least costs of the later rows, whatever the state, as the first prices.
        least, price = min(beyond), [0] * (4 * n + 5)
        for i in range(n, -1, -1):
            if i < n:
                least += min(cost for own in kinds[rows[i]] for _, cost, _ in own)
            price[4 * i:4 * i + 4] = [least] * 4
        self.price = price

    def auction(self, origin: int) -> int:
        """Raises prices until the path from the origin reaches the target; the cost of the cheapest path."""
        price, path = self.price, [origin]
        while path[-1] != self.target:
            node = path[-1]
            best, to = min((cost + price[end], end) for _, cost, end in self.out[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[origin]

    def traces(self) -> list[tuple[str, int]]:
        """From each first node, the least letters along tight arcs to the target and the state before it.

        Nodes that lead to the target over tight arcs are found from the target backwards.
        """
        leads = [False] * self.target + [True]
        for first in range(self.target - 4, -1, -4):
            for _ in range(4):               # inserts stay before the same row, so they are gone over again
                for node in range(first, first + 4):
                    leads[node] = any(leads[end] and self.price[node] == cost + self.price[end] for _, cost, end in self.out[node])
        found = []
        for state in range(4):
            node, letters = state, []
            while True:
                letter, end = next((letter, end) for letter, cost, end in self.out[node]
                                   if leads[end] and self.price[node] == cost + self.price[end])
                if end == self.target:
                    break
                letters.append(letter)
                node = end
            found.append(("".join(letters), node - (self.target - 4)))
        return found


def repaired(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and letters of the cheapest edits, the least string of these; rows are (role initial, fault)."""
    beyond = [0 if s in ENDS else FAR for s in range(4)]
    held: list[list] = []
    for start in range((len(rows) - 1) // SEGMENT * SEGMENT if rows else 0, -1, -SEGMENT):
        segment = Segment(rows[start:start + SEGMENT], beyond)
        beyond = [segment.auction(state) for state in range(4)]
        held.append(segment.traces())
    letters, state = [], START
    for traces in reversed(held):
        more, state = traces[state]
        letters.append(more)
    return beyond[START], "".join(letters)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage to (conv_id, turn, role, text), and a row of null role for each dropped one."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 0, None).when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
                       .alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows by conversation and turn, with the first fault of each."""
    rows = rows.withColumn("mark", F.xxhash64("role", "text")).repartition("conv_id")
    seen = W.partitionBy("conv_id", "role", "mark").orderBy(F.asc_nulls_first("turn"))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", BLANK).when(F.row_number().over(seen) > 1, DUPLICATE).when(
        last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    return rows.withColumn("fault", fault).sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "turn", "role", "text", "fault")


class Conversation:
    """The rows of one conversation as they come, and its line of the result."""

    def __init__(self, key):
        self.key, self.initials, self.faults, self.held = key, [], bytearray(), None
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role, text, fault) -> None:
        if role is None:
            return
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.initials.append(role[:1])
        self.faults.append(fault)
        self.held = self.held or tempfile.SpooledTemporaryFile(SPOOLED)
        for part in (role.encode(), text.encode()):
            self.held.write(struct.pack("<q", len(part)) + part)

    def digest(self, audit: str) -> str:
        """Of the repaired rows, ``role:text`` joined by newlines."""
        total, first, state = hashlib.sha256(), True, START

        def row():
            return [self.held.read(struct.unpack("<q", self.held.read(8))[0]) for _ in range(2)]

        if self.held:
            self.held.seek(0)
        for letter in audit:
            role, text = row() if letter != "I" else (b"", b"")
            if letter == "D":
                continue
            if letter == "K":
                state = AFTER[state][role.decode()[:1]]
            else:
                state = MADE[state]
                role = b"user" if state == USER else b"assistant"
            total.update((b"" if first else b"\n") + role + b":" + text)
            first = False
        if self.held:
            self.held.close()
        return total.hexdigest()

    def line(self) -> tuple:
        cost, audit = repaired(list(zip(self.initials, self.faults)))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.initials, self.initials[1:]))
        return (self.key, gaps, *[self.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)], illegal, cost, audit,
                self.digest(audit))


def repair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One line for each conversation of a stream of rows sorted by conversation and turn."""
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    own, out = None, []

    def lines():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        for key, *row in zip(*[c.to_pylist() for c in batch.columns]):
            if own is None or key != own.key:
                if own:
                    out.append(own.line())
                own = Conversation(key)
            own.add(*row)
        if len(out) >= 1000:
            yield lines()
            out = []
    if own:
        out.append(own.line())
    if out:
        yield lines()


def repair(rows: DataFrame) -> DataFrame:
    """A line for each conversation of (conv_id, turn, role, text): its faults, cheapest edits and their digest.

    Rows of null role and their conversation count as none; see ``damaged``.
    """
    return with_faults(rows).mapInArrow(repair_rows, REPAIRED)


def op12_auction_repair(spark, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return repair(damaged(rows))


def sql_with(state: str, cost: str, letter: str) -> str:
    """A state's six digits of cost and its letters, with one more edit (null stays null)."""
    return f"(lpad((substr({state}, 1, 6)::INTEGER + {cost})::VARCHAR, 6, '0') || substr({state}, 7) || '{letter}')"


def sql_made(initial: str, state: str) -> str:
    """Keep or set the role of a row, after ``state``."""
    more = f"CASE WHEN fault = {TRUNCATED} THEN {TRUNCATED_COST} ELSE 0 END"
    return (f"CASE WHEN fault IN ({SOUND}, {TRUNCATED}) THEN CASE WHEN role[1] = '{initial}' THEN {sql_with(state, more, 'K')} "
            f"ELSE {sql_with(state, f'{ROLE_COST} + {more}', 'R')} END END")


SQL = rf"""
WITH RECURSIVE spaced AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS conv, conv_id, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS text,
         list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                        lambda c: ascii(c)::BIGINT) AS codes
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, codes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y:
      xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS kind
  FROM spaced
), damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS place,
         regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last
  FROM damaged
), faulty AS MATERIALIZED (
  SELECT conv, turn, role, text, place, CASE
    WHEN last = '' THEN {BLANK}
    WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY place) > 1 THEN {DUPLICATE}
    WHEN last IN ('.', '!', '?') THEN {SOUND} ELSE {TRUNCATED} END AS fault,
    (role[1] || lead(role[1]) OVER (PARTITION BY conv ORDER BY place)) AS pair
  FROM placed
), numbers AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = {BLANK}) AS blank, count(*) FILTER (WHERE fault = {DUPLICATE}) AS duplicate,
         count(*) FILTER (WHERE fault = {TRUNCATED}) AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size
  FROM faulty GROUP BY conv
), states AS (
  SELECT conv, 0::BIGINT AS place, '000000' AS b, NULL::VARCHAR AS s, '000005I' AS u, '000010II' AS a FROM numbers
  UNION ALL
  SELECT conv, place, b, s, least(u, {sql_with('least(b, s, a)', str(INSERT_COST), 'I')}) AS u,
         least(a, {sql_with(f"least(u, {sql_with('least(b, s, a)', str(INSERT_COST), 'I')})", str(INSERT_COST), 'I')}) AS a
  FROM (
    SELECT f.conv, f.place, {sql_with('b', str(DELETE_COST), 'D')} AS b,
           least({sql_with('s', str(DELETE_COST), 'D')}, CASE WHEN role[1] = 's' THEN {sql_made('s', 'b')} END) AS s,
           least({sql_with('u', str(DELETE_COST), 'D')}, {sql_made('u', 'least(b, s, a)')}) AS u,
           least({sql_with('a', str(DELETE_COST), 'D')}, {sql_made('a', 'u')}) AS a
    FROM states JOIN faulty f ON f.conv = states.conv AND f.place = states.place + 1)
), ended AS (
  SELECT conv, substr(least(b, a), 1, 6)::BIGINT AS cost, substr(least(b, a), 7) AS audit
  FROM states JOIN numbers USING (conv) WHERE place = size
), letters AS (
  SELECT conv, nth, letter, sum((letter <> 'I')::INTEGER) OVER upto AS place, sum((letter <> 'D')::INTEGER) OVER upto AS made
  FROM (SELECT conv, unnest(range(1, length(audit) + 1)) AS nth, unnest(string_split(audit, '')) AS letter FROM ended WHERE audit <> '')
  WINDOW upto AS (PARTITION BY conv ORDER BY nth)
), chosen AS (
  SELECT l.conv, nth, letter, made, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, role,
         max((made = 1 AND letter = 'K' AND role[1] = 's')::INTEGER) OVER (PARTITION BY l.conv) AS system
  FROM letters l JOIN faulty f ON f.conv = l.conv AND f.place = greatest(l.place, 1) WHERE letter <> 'D'
), told AS (
  SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (made - system) % 2 = 1 THEN 'user'
    ELSE 'assistant' END || ':' || text, chr(10) ORDER BY nth)) AS repaired_sha256
  FROM chosen GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM spaced) LEFT JOIN numbers USING (conv) LEFT JOIN ended USING (conv)
LEFT JOIN told USING (conv)
"""
