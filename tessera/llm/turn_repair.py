"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

Spark damages, hashes and orders the rows; tasks hold consecutive rows and search each conversation depth first. A
conversation that is longer than one piece, or lies across tasks, is searched piece by piece, for each state before and
after a piece, and the pieces are put together in order; no task ever holds more than a piece of rows.

States are what the kept roles so far end in: 0 nothing, 1 s (system), 2 u (user), 3 a (assistant).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, written

#: A piece ends after so many rows or characters.
PIECE_ROWS, PIECE_CHARS = 1_000, 1 << 20
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: By state: what a kept initial leads to; what an inserted or rerolled row leads to; its role.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FORCED = (2, 2, 3, 2)
ROLE = ("user", "user", "assistant", "user")
#: By state: the inserts that end a conversation.
CLOSING = ("", "II", "I", "")
NEVER = 1 << 60


def _edits(initial: str, fault: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what can be done with a row in a state."""
    out = [("D", DELETE, state)]
    if fault in (FINE, TRUNCATED):
        more = CUT_OFF if fault == TRUNCATED else 0
        if (kept := AFTER[state].get(initial)) is not None:
            out.append(("K", KEEP + more, kept))
        out.append(("R", REROLE + more, FORCED[state]))
    return out


EDITS = {(i, f, s): _edits(i, f, s) for i in ("s", "u", "a", "") for f in range(4) for s in range(4)}


def lower_bounds(rows: list[tuple[str, int]], ends: list[int]) -> list[list[int]]:
    """For each place and state, a bound on the cost of what follows; `ends` has the costs of ending in a state.

    The audit, and so the order among equal costs, is left aside; no way on is cheaper than this."""
    out = [ends]
    for initial, fault in reversed(rows):
        after = out[-1]
        plain = [min(cost + after[to] for _, cost, to in EDITS[initial, fault, s]) for s in range(4)]
        once = [min(plain[s], INSERT + plain[FORCED[s]]) for s in range(4)]
        out.append([min(once[s], INSERT + once[FORCED[s]]) for s in range(4)])
    return out[::-1]


def search(rows: list[tuple[str, int]], entry: int = 0, leave: int | None = None) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of (initial, fault) rows, of equal costs the ASCII-least; None if there are none.

    With `leave`, the edits must end in that state right after the last row; else the conversation ends here. Depth
    first: nodes are (place, state, cost, audit) on a stack, the most promising child on top. A node goes if its cost
    and the bound of what follows pass the incumbent, if both reach it and its audit is larger, or if its (place, state)
    was reached at no higher (cost, audit): at equal costs, no audit of a place is the beginning of another, so the
    smaller one stays smaller whatever follows."""
    ends = [len(CLOSING[s]) * INSERT for s in range(4)] if leave is None else [0 if s == leave else NEVER for s in range(4)]
    bounds = lower_bounds(rows, ends)
    n, best, seen = len(rows), None, {}
    stack = [(0, entry, 0, "")]
    while stack:
        at, state, cost, audit = stack.pop()
        bound = cost + bounds[at][state]
        if bound >= NEVER or best and (bound > best[0] or bound == best[0] and audit > best[1][: len(audit)]):
            continue
        if (at, state) in seen and seen[at, state] <= (cost, audit):
            continue
        seen[at, state] = (cost, audit)
        if at == n:
            found = (bound, audit + (CLOSING[state] if leave is None else ""))
            if ends[state] < NEVER and (best is None or found < best):
                best = found
            continue
        children = [(at + 1, to, cost + more, audit + letter) for letter, more, to in EDITS[(*rows[at], state)]]
        children.append((at, FORCED[state], cost + INSERT, audit + "I"))
        stack += sorted(children, key=lambda c: (c[2] + bounds[c[0]][c[1]], c[3]), reverse=True)
    return best


class _Writer:
    """Hashes a repaired conversation while its rows pass by."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.hash, self.begun = audit, 0, 0, hashlib.sha256(), False

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.begun = True

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(ROLE[self.state], "")
            self.state, self.at = FORCED[self.state], self.at + 1

    def row(self, role: str, text: str) -> None:
        self._inserts()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self._line(role, text)
            self.state = AFTER[self.state][role[:1]]
        elif letter == "R":
            self._line(ROLE[self.state], text)
            self.state = FORCED[self.state]

    def end(self) -> str:
        self._inserts()
        return self.hash.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of `conv_id:turn` asks for; nulls in the key, role and text are one space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("kind__")).where("kind__ != 0")
    text = F.when(F.col("kind__") == 1, "").when(F.col("kind__") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind__") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy__", F.explode(F.when(F.col("kind__") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind__", "copy__")


def ordered(rows: DataFrame) -> DataFrame:
    """Adds fault (BLANK, TRUNCATED, else FINE), h (hash of role and text), first_turn and dup (whether h occurs again in the
    conversation); tasks hold consecutive rows by conversation, turn (null first) and h."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(F.length(last) == 0, BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    h = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    key = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), "h"), 256)
    rows = written(rows.withColumns({"fault": fault, "h": h}).withColumn("key", key))
    more = written(rows.groupBy("key").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", F.col("first.turn").alias("first_turn"), F.lit(True).alias("dup")))
    out = rows.join(more, "key", "left").drop("key")
    return out.repartitionByRange("conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h")


COUNTS = ("rows", "least", "most", "distinct", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role")
_COUNT_FIELDS = "rows bigint, least bigint, most bigint, distinct bigint, first_turn bigint, last_turn bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role string, last_role string"
_FIELDS = f"conv_id bigint, part int, no bigint, whole boolean, {_COUNT_FIELDS}, cost bigint, audit string, repaired_sha256 string, ways array<struct<entry:int,leave:int,cost:bigint,audit:string>>, roles array<string>, texts array<string>"
_LEGAL = ("su", "ua", "au")


def _counted(turns: list, initials: list[str], faults: list[int]) -> dict:
    known = [t for t in turns if t is not None]
    return {
        "rows": len(turns), "least": min(known, default=None), "most": max(known, default=None), "distinct": len(set(known)), "first_turn": turns[0], "last_turn": turns[-1],
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)), "first_role": initials[0], "last_role": initials[-1],
    }


def _joined(a: dict, b: dict) -> dict:
    """The counts of a piece and the one right after it."""
    out = {k: a[k] + b[k] for k in ("rows", "blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last_role"] + b["first_role"] not in _LEGAL)
    shared = a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["distinct"] = a["distinct"] + b["distinct"] - shared
    out["least"] = min((x for x in (a["least"], b["least"]) if x is not None), default=None)
    out["most"] = max((x for x in (a["most"], b["most"]) if x is not None), default=None)
    return out | {"first_turn": a["first_turn"], "first_role": a["first_role"], "last_turn": b["last_turn"], "last_role": b["last_role"]}


def _solved(conv: int | None, part: int, no: int, piece: list[dict], begins: bool, whole: bool) -> dict:
    """A row of _FIELDS from consecutive rows: the whole conversation, or a piece with its ways through and its rows."""
    rows = [(i if (i := r["role"][:1]) in "sua" else "", r["fault"]) for r in piece]
    out = {"conv_id": conv, "part": part, "no": no, "whole": whole, **_counted([r["turn"] for r in piece], [r["role"][:1] for r in piece], [f for _, f in rows])}
    if whole:
        out["cost"], out["audit"] = search(rows)
        writer = _Writer(out["audit"])
        for r in piece:
            writer.row(r["role"], r["text"])
        out["repaired_sha256"] = writer.end()
        return out
    ways = [{"entry": e, "leave": f, "cost": w[0], "audit": w[1]} for e in ((0,) if begins else range(4)) for f in range(4) if (w := search(rows, e, f))]
    return out | {"ways": ways, "roles": [r["role"] for r in piece], "texts": [r["text"] for r in piece]}


def pieces(rows: DataFrame) -> DataFrame:
    """Rows of _FIELDS from ordered() rows: a solved conversation each, or a piece where one is long or may lie across tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, nothing = TaskContext.get().partitionId(), 0, object()
        conv, piece, chars, before = nothing, [], 0, None
        pieces_of, edge = 0, True  # pieces of this conversation so far; whether it may have begun in the task before

        def done(last: bool) -> dict:
            nonlocal no, pieces_of
            whole = not edge and last and not pieces_of
            out = _solved(conv, part, no, piece, begins=not edge and not pieces_of, whole=whole)
            no, pieces_of = no + 1, pieces_of + 1
            return out

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv_id"] != conv or conv is nothing:
                    if conv is not nothing:
                        out.append(done(last=True))
                        edge = False
                    conv, piece, chars, before, pieces_of = row["conv_id"], [], 0, None, 0
                elif len(piece) >= PIECE_ROWS or chars >= PIECE_CHARS:
                    out.append(done(last=False))
                    piece, chars = [], 0
                again = row["dup"] and (row["turn"] != row["first_turn"] or row["h"] == before)
                if again and row["fault"] != BLANK:
                    row["fault"] = DUPLICATE
                before = row["h"]
                piece.append(row)
                chars += len(row["text"])
            if out:
                yield pa.RecordBatch.from_pylist(out, _arrow())
        if conv is not nothing:
            # the conversation may go on in the next task
            yield pa.RecordBatch.from_pylist([done(last=False)], _arrow())

    return rows.mapInArrow(run, _FIELDS)


def _arrow() -> pa.Schema:
    way = pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    counts = [(c, pa.string() if c.endswith("role") else pa.int64()) for c in COUNTS]
    return pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("whole", pa.bool_()), *counts, ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("ways", pa.list_(way)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])


_RESULT = f"conv_id bigint, {_COUNT_FIELDS}, cost bigint, audit string"


def _in_order(df: DataFrame) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "no")


def _put_together(parts: DataFrame) -> DataFrame:
    """The counts, cost and audit of each conversation from its pieces in order; four audits are held, no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, counts, now = None, None, {}

        def result() -> pa.RecordBatch:
            cost, audit = min((c + INSERT * len(CLOSING[s]), a + CLOSING[s]) for s, (c, a) in now.items())
            return pa.RecordBatch.from_pylist([{"conv_id": conv, **counts, "cost": cost, "audit": audit}], schema)

        schema = pa.schema([f for f in _arrow() if f.name in ("conv_id", *COUNTS, "cost", "audit")])
        for batch in batches:
            for row in batch.to_pylist():
                if counts is None or row["conv_id"] != conv:
                    if counts is not None:
                        yield result()
                    conv, counts, now = row["conv_id"], {c: row[c] for c in COUNTS}, {0: (0, "")}
                else:
                    counts = _joined(counts, {c: row[c] for c in COUNTS})
                after = {}
                for w in row["ways"]:
                    if w["entry"] in now:
                        cost, audit = now[w["entry"]]
                        found = (cost + w["cost"], audit + w["audit"])
                        if w["leave"] not in after or found < after[w["leave"]]:
                            after[w["leave"]] = found
                now = after
        if counts is not None:
            yield result()

    return _in_order(parts.select("conv_id", "part", "no", *COUNTS, "ways")).mapInArrow(run, _RESULT)


def _hashed(parts: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the rows of each conversation stream past its audit (a SHA-256 is one chain: one task for a conversation, a piece in memory)."""
    first = audits.select("conv_id", F.lit(-1).alias("part"), F.lit(0).cast("bigint").alias("no"), "audit", F.lit(None).cast("array<string>").alias("roles"), F.lit(None).cast("array<string>").alias("texts"))
    rows = first.unionByName(parts.select("conv_id", "part", "no", F.lit(None).cast("string").alias("audit"), "roles", "texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, writer = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "repaired_sha256": [writer.end()]})

        for batch in batches:
            for row in batch.to_pylist():
                if row["audit"] is not None:
                    if writer:
                        yield result()
                    conv, writer = row["conv_id"], _Writer(row["audit"])
                else:
                    for role, text in zip(row["roles"], row["texts"], strict=True):
                        writer.row(role, text)
        if writer:
            yield result()

    return _in_order(rows).mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, counts of faults, cost, audit and the hash of the repaired conversation, from rows (conv_id, turn, role, text) without null roles or texts.

    Rows of one turn follow each other by the hash of role and text; a null conv_id is a conversation of its own. A role
    that begins with none of s, u, a (an empty one too) cannot be kept as it is."""
    solved = written(pieces(ordered(rows)))
    parts = solved.where("not whole")
    joined = written(_put_together(parts))
    hashed = written(_hashed(parts, joined))
    long = joined.join(hashed, joined.conv_id.eqNullSafe(hashed.conv_id)).select(joined["*"], hashed.repaired_sha256)
    columns = ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]
    return solved.where("whole").select(*columns).unionByName(long.select(*columns))


def digest(conversations: DataFrame) -> DataFrame:
    """Of every conv_id of `conversations` (null too), after damage: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    found = repaired(damaged(conversations)).withColumnRenamed("conv_id", "id__")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("id__")) & F.col("rows").isNotNull(), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("distinct"), F.lit(0)).cast("bigint").alias("gaps")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", gaps, *map(number, ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "conversations"))


def _oracle() -> str:
    """The same by a recursion from each conversation's last row to its first: of every state, the least (cost, audit) of what follows."""
    crc = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        crc.append(n)
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    line = lambda s: f"chr(10) || '{ROLE[s]}:'"

    def way(letter: str, cost: str, to: str, out: str) -> str:
        return f"struct_pack(c := {cost} + {to}.c, a := '{letter}' || {to}.a, o := {out} || {to}.o)"

    plain, more = [], "CASE fault WHEN 3 THEN 3 ELSE 0 END"
    for s in range(4):
        kept = " ".join(f"WHEN '{i}' THEN {way('K', more, f'b{to}', 'chr(10) || role || chr(58) || text')}" for i, to in AFTER[s].items())
        rerole = way("R", f"3 + {more}", f"b{FORCED[s]}", f"{line(s)} || text")
        plain.append(f"CASE WHEN fault IN (1, 2) THEN {way('D', '4', f'b{s}', repr(''))} ELSE list_min(list_filter([{way('D', '4', f'b{s}', repr(''))}, {rerole}, CASE left(role, 1) {kept} END], lambda x: x IS NOT NULL)) END AS p{s}")
    insert = lambda s, to: way("I", "3", to, line(s))
    return f"""
WITH RECURSIVE crc AS (SELECT {crc} AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split({key}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS k FROM conversations, crc),
rows_ AS (SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(2) c(i) WHERE k <> 0 AND (i = 0 OR k = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS seen
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos FROM rows_)),
faulty AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 3 ELSE 0 END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
counts AS (SELECT conv_id, count(*) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
  count_if(before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id),
best AS (
  SELECT conv_id, n AS pos, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS b0, {{'c': CAST(6 AS BIGINT), 'a': 'II', 'o': {line(1)} || {line(2)}}} AS b1, {{'c': CAST(3 AS BIGINT), 'a': 'I', 'o': {line(2)}}} AS b2, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS b3 FROM counts
  UNION ALL
  SELECT conv_id, pos, least(p0, {insert(0, 'q2')}) AS b0, least(p1, {insert(1, 'q2')}) AS b1, q2 AS b2, q3 AS b3 FROM (
    SELECT *, least(p2, {insert(2, 'p3')}) AS q2, least(p3, {insert(3, 'p2')}) AS q3 FROM (
      SELECT best.conv_id, best.pos - 1 AS pos, {', '.join(plain)} FROM best JOIN faulty ON faulty.conv_id IS NOT DISTINCT FROM best.conv_id AND faulty.pos = best.pos))),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b0.c, 0) AS cost, coalesce(b0.a, '') AS audit, sha256(coalesce(substr(b0.o, 2), '')) AS repaired_sha256
FROM every e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id AND best.pos = 0"""


ORACLE_SQL = _oracle()
