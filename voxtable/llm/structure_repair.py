"""Repair of conversation structure by depth-first branch and bound.

A conversation's rows must have role initials (s?(ua)+)?. Edits: Keep (0), Rerole to user or assistant (3), Delete (4, and
required for blank rows and those that repeat an earlier role and text), Insert an empty user or assistant row (3). A
truncated row that is not deleted adds 3. Wanted is the cheapest sequence of edits; of equal ones the least in ASCII order.

Search. A node is a row and the role before it. An explicit stack is walked depth first, edits in ASCII order, so prefixes
come up in that order. Suffix lower bounds add up what each remaining row costs at least and 3 (less beside truncated
rows) for disjoint pairs of neighbours that cannot both stay; a greedy repair gives the first bound from above. The incumbent is
(cost, audit); the dominance table of a node holds the cheapest prefix that came there, and a prefix that is not cheaper
is left, being later in ASCII order, too. When the stack is empty, the incumbent is proved best.

Scale. Rows are counted per (conversation, turn, role, text), so repeated rows are one, and then range-partitioned and
sorted; a conversation of any size lies over as many partitions as it needs. Each partition cuts its conversations into
pieces of at most PIECE_ROWS rows. A piece that is a whole conversation is solved at once. For the others the search gives the
cheapest cost between each role before and each role behind a piece; these 4 by 4 tables are chained from the end (one row
per piece, in a stream sorted by conversation), the search then tells where each entry leads, entries are chained from the
front, and each piece is solved for its true entry. Only the digest over a whole conversation is sequential by nature: its
pieces are streamed in order through one task, without being gathered.

Rows of equal turn stand in the order of role and text (bytes). Null role or text: one space; a null turn comes first; rows
of null conv_id are one conversation. An empty role has no initial: such a row is reroled or deleted. A conversation
without rows: zeros, empty audit, hash of the empty string. Other columns are not read. An empty table gives no rows."""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.taskcontext import TaskContext

from voxtable.functions.stage import spread, stage

from .common import shuffle_partitions, table

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
PIECE_ROWS, PIECE_CHARS = 128, 1 << 22
NEVER = 1 << 60
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)

#: Before any row, behind system, behind user, behind assistant: where each initial leads, and the role an edit can put.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
PUT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: Cost of ending, and the inserts it takes.
END = (0, 6, 3, 0)
_FOLLOWS = ("su", "ua", "au")
_GAPS = r"concat(' ', char(9), char(10), char(11), char(12), char(13))"

Row = tuple[str, str, int, int]  # role, text, fault, copies


def _bounds(initials: list[str], cut: list[bool]) -> tuple[list[int], ...]:
    """For each role before a row the least cost of the rows from there on."""
    m = len(initials)
    known = [c in ("s", "u", "a") for c in initials]
    least = [CUT_OFF * t if k else min(REROLE + CUT_OFF * t, DELETE) for k, t in zip(known, cut)]
    after = [0] * (m + 2)
    for j in range(m - 1, -1, -1):
        after[j] = least[j] + after[j + 1]
        if j + 1 < m and known[j] and known[j + 1] and initials[j] + initials[j + 1] not in _FOLLOWS:
            extra = min(INSERT, DELETE - least[j], DELETE - least[j + 1])
            after[j] = max(after[j], least[j] + least[j + 1] + extra + after[j + 2])
    low = []
    for s in range(4):
        own = after[:m + 1]
        for j in range(m):
            if known[j] and initials[j] not in STEP[s]:
                own[j] = max(own[j], least[j] + min(INSERT, DELETE - least[j]) + after[j + 1])
        low.append(own)
    return tuple(low)


def _greedy(initials: list[str], cut: list[bool], state: int, ends: tuple[int, ...]) -> int:
    """Cost of a repair that keeps what fits and otherwise takes the edit after which the next row fits, deleting truncated
    rows first."""
    cost = 0
    for j, (c, t) in enumerate(zip(initials, cut)):
        if c in STEP[state]:
            cost, state = cost + CUT_OFF * t, STEP[state][c]
            continue
        put = PUT[state][1]
        choices = [(DELETE, state)] if t else []
        if c in STEP[put]:
            choices.append((INSERT + CUT_OFF * t, STEP[put][c]))
        choices.append((REROLE + CUT_OFF * t, put))
        if not t:
            choices.append((DELETE, state))
        then = initials[j + 1] if j + 1 < len(initials) else ""
        more, state = min(choices, key=lambda x: x[0] + (INSERT if then and then not in STEP[x[1]] else 0))
        cost += more
    return cost + ends[state]


def search(initials: list[str], cut: list[bool], entry: int, ends: tuple[int, ...]) -> tuple[int, str, int] | None:
    """(cost with that of the end, edits, role behind) of the best repair of rows none of which must be deleted."""
    m, low = len(initials), _bounds(initials, cut)
    reach = [min(ends), min(ends[1:]), min(ends[2:]), min(ends[2:])]
    best, found = _greedy(initials, cut, entry, ends), None
    best = min(best, NEVER - 1)
    seen = [NEVER] * (4 * m + 4)
    stack: list[tuple] = [(0, entry, 0, None)]
    while stack:
        j, s, g, path = stack.pop()
        bound = g + low[s][j] + reach[s]
        if bound > best or (bound == best and found) or seen[4 * j + s] <= g:
            continue
        seen[4 * j + s] = g
        if j == m:
            if g + ends[s] < best or not found and g + ends[s] == best:
                best, found = g + ends[s], (path, s)
            continue
        put, extra = PUT[s][1], CUT_OFF * cut[j]
        stack.append((j + 1, put, g + REROLE + extra, (path, "R")))
        if initials[j] in STEP[s]:
            stack.append((j + 1, STEP[s][initials[j]], g + extra, (path, "K")))
        stack.append((j, put, g + INSERT, (path, "I")))
        stack.append((j + 1, s, g + DELETE, (path, "D")))
    if found is None:
        return None
    path, edits = found[0], []
    while path:
        path, edit = path
        edits.append(edit)
    return best, "".join(reversed(edits)), found[1]


def _live(rows: list[Row]) -> tuple[list[str], list[bool], int]:
    """Initials and truncation of the rows that may stay, and how many must go."""
    stay = [(r[:1], f == TRUNCATED) for r, _, f, _ in rows if f < DUPLICATE]
    return [c for c, _ in stay], [t for _, t in stay], sum(r[3] for r in rows) - len(stay)


def mend(rows: list[Row], entry: int, ends: tuple[int, ...], last: bool) -> tuple[int, str, list[str], list[str]]:
    """(cost, edits, roles, texts) of the best repair of a piece; the last piece also holds the inserts of the end."""
    initials, cut, gone = _live(rows)
    cost, edits, state = search(initials, cut, entry, ends)
    audit, roles, texts, at, s = [], [], [], 0, entry

    def put(role: str, text: str, to: int) -> int:
        roles.append(role)
        texts.append(text)
        return to

    for role, text, fault, copies in rows:
        if fault < DUPLICATE:
            while edits[at] == "I":
                s = put(PUT[s][0], "", PUT[s][1])
                audit.append("I")
                at += 1
            edit, at, copies = edits[at], at + 1, copies - 1
            audit.append(edit)
            if edit == "K":
                s = put(role, text, STEP[s][role[:1]])
            elif edit == "R":
                s = put(PUT[s][0], text, PUT[s][1])
        audit.append("D" * copies)
    if last:
        for _ in range(END[s] // INSERT):
            s = put(PUT[s][0], "", PUT[s][1])
            audit.append("I")
    return cost + DELETE * gone - (0 if last else ends[state]), "".join(audit), roles, texts


# Pieces of sorted rows.

_PIECE = ("conv_id bigint, part int, ord bigint, whole boolean, last boolean, rows bigint, head string, tail string, first_turn bigint, last_turn bigint, turns bigint, "
          "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, roles array<string>, texts array<string>, faults array<int>, copies array<bigint>")
_NAMES = [c.split()[0] for c in _PIECE.split(", ")]
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


class _Piece:
    """Consecutive rows of one conversation."""

    def __init__(self, conv: int | None, ordinal: int):
        self.conv, self.ord, self.chars = conv, ordinal, 0
        self.rows: list[Row] = []
        self.turns: list[int] = []

    def add(self, turn: int | None, role: str, text: str, fault: int, copies: int) -> None:
        self.rows.append((role, text, fault, copies))
        self.chars += len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def full(self, rows: int) -> bool:
        return len(self.rows) >= rows or self.chars >= PIECE_CHARS

    def row(self, part: int, whole: bool) -> dict:
        faults = {f: 0 for f in (TRUNCATED, DUPLICATE, BLANK)}
        illegal, before = 0, None
        for role, _, fault, copies in self.rows:
            if fault == BLANK:
                faults[BLANK] += copies
            else:
                faults[DUPLICATE] += copies - (fault != DUPLICATE)
                faults[TRUNCATED] += fault == TRUNCATED
            illegal += copies - 1 + (before is not None and before + role[:1] not in _FOLLOWS)
            before = role[:1]
        out = {"conv_id": self.conv, "part": part, "ord": self.ord, "whole": whole, "last": whole, "rows": sum(r[3] for r in self.rows),
               "head": self.rows[0][0][:1] if self.rows else None, "tail": before, "first_turn": self.turns[0] if self.turns else None,
               "last_turn": self.turns[-1] if self.turns else None, "turns": len(self.turns), "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[TRUNCATED], "illegal": illegal}
        if whole:
            cost, audit, roles, texts = mend(self.rows, 0, END, True)
            return {**out, "cost": cost, "audit": audit, "roles": roles, "texts": texts}
        roles, texts, fault, copies = (list(c) for c in zip(*self.rows)) if self.rows else ([], [], [], [])
        return {**out, "roles": roles, "texts": texts, "faults": fault, "copies": copies}


def _pieces(size: int) -> Callable:
    """Sorted rows (conv_id, turn, role, text, copies, fault) of a partition as pieces. Those of its first and its last
    conversation may go on in another partition and are not whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId(), _schema(_PIECE)
        piece: _Piece | None = None
        alone, made = False, 0
        for batch in batches:
            out = []
            for conv, turn, role, text, copies, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if piece is None or piece.conv != conv:
                    if piece is not None:
                        out.append(piece.row(part, alone))
                        alone = True
                    piece, made = _Piece(conv, made), made + 1
                elif piece.full(size):
                    out.append(piece.row(part, False))
                    piece, made, alone = _Piece(conv, made), made + 1, False
                if role is not None:
                    piece.add(turn, role, text, fault, copies)
            if out:
                yield _batch(out, schema)
        if piece is not None:
            yield _batch([piece.row(part, False)], schema)
    return run


def _rows_of(r: dict) -> list[Row]:
    return list(zip(r["roles"], r["texts"], r["faults"], r["copies"]))


def _mapped(change: Callable[[dict], dict], ddl: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([change(r) for r in batch.to_pylist()], _schema(ddl))
    return run


def _costs(r: dict) -> dict:
    """Cheapest way from each role before a piece to each behind it."""
    initials, cut, gone = _live(_rows_of(r))
    out = []
    for entry in range(4):
        for to in range(4):
            # No way leads back to system or to the beginning.
            best = search(initials, cut, entry, tuple(0 if x == to else NEVER for x in range(4))) if to >= min(entry, 2) else None
            out.append(NEVER if best is None else best[0] + DELETE * gone)
    return {"conv_id": r["conv_id"], "part": r["part"], "ord": r["ord"], "costs": out}


def _exits(r: dict) -> dict:
    initials, cut, _ = _live(_rows_of(r))
    found = [search(initials, cut, entry, tuple(r["ends"])) for entry in range(4)]
    return {"conv_id": r["conv_id"], "part": r["part"], "ord": r["ord"], "exits": [f[2] if f else 0 for f in found]}


def _mended(r: dict) -> dict:
    cost, audit, roles, texts = mend(_rows_of(r), r["entry"], tuple(r["ends"]), r["last"])
    return {**{k: r[k] for k in _NAMES}, "cost": cost, "audit": audit, "roles": roles, "texts": texts, "faults": None, "copies": None}


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost of everything behind a piece for each role; pieces come from the last to the first of a conversation."""
    conv, ends, begun = None, END, False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            last = not begun or r["conv_id"] != conv
            if last:
                conv, ends, begun = r["conv_id"], END, True
            out.append({"part": r["part"], "ord": r["ord"], "ends": list(ends), "last": last})
            c = r["costs"]
            ends = tuple(min(NEVER, min(c[4 * a + b] + ends[b] for b in range(4))) for a in range(4))
        yield _batch(out, _schema("part int, ord bigint, ends array<bigint>, last boolean"))


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The role before each piece."""
    conv, state, begun = None, 0, False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if not begun or r["conv_id"] != conv:
                conv, state, begun = r["conv_id"], 0, True
            out.append({"part": r["part"], "ord": r["ord"], "entry": state})
            state = r["exits"][state]
        yield _batch(out, _schema("part int, ord bigint, entry int"))


# Tables.

def _blank_for_null(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows with faults drawn by crc32(conv_id:turn) % 20; copies is 0 for dropped ones."""
    plain = conversations.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), _blank_for_null(role).alias("role"), _blank_for_null(text).alias("text"))
    draw = F.crc32(F.concat(_blank_for_null("conv_id"), F.lit(":"), _blank_for_null("turn"))) % 20
    return plain.withColumn("draw", draw).select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("draw") == 0, 0).when(F.col("draw") == 3, 2).otherwise(1).alias("copies"))


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """rows: (conv_id, turn, role, text, copies) without null role or text. The repaired conversations in pieces: (conv_id, part, ord,
    whole, last, rows, ..., cost, audit, roles, texts), pieces of a conversation in the order of (part, ord)."""
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    digest = F.md5("text")
    # Texts that a conversation holds at more than one turn.
    again = (rows.where("copies > 0").select("conv_id", "role", digest.alias("digest"), when.alias("when")).groupBy("conv_id", "role", "digest")
             .agg(F.min("when").alias("first"), F.max("when").alias("other")).where("first < other").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), "digest", "first"))
    held = F.col("copies") > 0
    counted = (rows.select("conv_id", *(F.when(held, F.col(c)).alias(c) for c in ("turn", "role", "text")), "copies")
               .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", digest).withColumn("when", when))
    joined = counted.join(again.withColumnRenamed("digest", "d"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    bare = f"trim(trailing {_GAPS} from text)"
    fault = (F.when(F.expr(f"{bare} = ''"), BLANK).when(F.col("first").isNotNull() & (F.col("when") > F.col("first")), DUPLICATE)
             .when(F.expr(f"right({bare}, 1) not in ('.', '!', '?')"), TRUNCATED).otherwise(FINE).cast("int"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    ready = joined.select("conv_id", "turn", "role", "text", "copies", F.when(F.col("role").isNotNull(), fault).alias("fault"))
    # The range of a row is told by the head of its text, since the driver samples what it ranges by.
    ranged = (ready.repartitionByRange(shuffle_partitions(rows.sparkSession), *order[:2], F.substring("role", 1, 64), F.substring("text", 1, 64))
              .sortWithinPartitions(*order, F.col("text")))
    pieces = stage(ranged.mapInArrow(_pieces(piece_rows), _PIECE), "pieces")
    split = pieces.where("not whole")
    costs = split.mapInArrow(_mapped(_costs, "conv_id bigint, part int, ord bigint, costs array<bigint>"), "conv_id bigint, part int, ord bigint, costs array<bigint>")
    ends = stage(spread(costs, "conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("ord")).mapInArrow(_backward, "part int, ord bigint, ends array<bigint>, last boolean"), "ends")
    bound = split.drop("last").join(ends, ["part", "ord"])
    exits = bound.mapInArrow(_mapped(_exits, "conv_id bigint, part int, ord bigint, exits array<int>"), "conv_id bigint, part int, ord bigint, exits array<int>")
    entries = stage(spread(exits, "conv_id").sortWithinPartitions("conv_id", "part", "ord").mapInArrow(_forward, "part int, ord bigint, entry int"), "entries")
    mended = bound.join(entries, ["part", "ord"]).mapInArrow(_mapped(_mended, _PIECE), _PIECE)
    return pieces.where("whole").unionByName(mended).drop("faults", "copies")


def turns(pieces: DataFrame) -> DataFrame:
    """The repaired conversations as rows (conv_id, part, ord, place, role, text), in that order."""
    return pieces.select("conv_id", "part", "ord", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "x")).select("conv_id", "part", "ord", "place", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))


_REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Total:
    """What the pieces of one conversation add up to."""

    def __init__(self, conv: int | None):
        self.row = {"conv_id": conv, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
        self.audit: list[str] = []
        self.hash, self.lines, self.tail = hashlib.sha256(), 0, None
        self.low = self.high = None
        self.turns = 0

    def add(self, r: dict) -> None:
        for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
            self.row[k] += r[k]
        if r["head"] is not None:
            self.row["illegal"] += self.tail is not None and self.tail + r["head"] not in _FOLLOWS
            self.tail = r["tail"]
        if r["turns"]:
            self.turns += r["turns"] - (r["first_turn"] == self.high)
            self.low, self.high = r["first_turn"] if self.low is None else self.low, r["last_turn"]
        self.audit.append(r["audit"])
        for role, text in zip(r["roles"], r["texts"]):
            self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
            self.lines += 1

    def result(self) -> dict:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {**self.row, "gaps": gaps, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: _Total | None = None
    schema = _schema(_REPORT)
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if total is None or total.row["conv_id"] != r["conv_id"]:
                if total is not None:
                    out.append(total.result())
                total = _Total(r["conv_id"])
            total.add(r)
        if out:
            yield _batch(out, schema)
    if total is not None:
        yield _batch([total.result()], schema)


def report(pieces: DataFrame) -> DataFrame:
    """One row per conversation: faults, cost, audit and the digest of what the repair leaves."""
    lines = F.expr("array_join(zip_with(roles, texts, (r, t) -> concat(r, ':', t)), char(10))")
    gaps = F.expr("if(turns = 0, 0, last_turn - first_turn + 1 - turns)").alias("gaps")
    whole = pieces.where("whole").select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    split = spread(pieces.where("not whole"), "conv_id").sortWithinPartitions("conv_id", "part", "ord").mapInArrow(_added, _REPORT)
    return whole.unionAll(split)


def op12_branch_and_bound(spark, folder: str) -> DataFrame:
    return report(repair(damaged(table(spark, folder, "conversations"))))
