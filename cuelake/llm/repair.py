r"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

A row may be kept, given the role of a user or an assistant, or deleted, and empty turns of a user or an assistant
may be inserted anywhere. The roles' initials must then read `(s?(ua)+)?`. Blank and repeated rows must go; a row
that stays though its text breaks off costs extra.

Rows are dealt out by the hash of (conversation, block of `SEGMENT` turn numbers) and sorted there. A task takes
them in pieces of at most `SEGMENT` rows and hands many pieces at once to one recursive query of DuckDB. Each
recursion advances all of them by one row; of each grammar state (nothing yet, after the system's, a user's, an
assistant's turn) only the least (cost, audit) stays. The audits of a state have as many letters of rows each,
and a cost that the letters determine, so of two with equal cost none begins the other: the least of a
longer audit has the least beginning.

A conversation that is one piece ends there. Of a longer one, whose pieces may lie in many tasks, each piece is
solved from every state that it may begin in; a fold over the pieces, without the texts, picks the path, and each
piece is rewritten where it lies. Only the digest of a repaired conversation reads its pieces in one sequence, as
a stream. A text said in an earlier block is known from hashes, made only for conversations of many blocks.

Defined cases: a null role or text is one space; a null turn comes first; rows of the same turn are in the order of
role, then text, so equal rows are neighbours; rows with a null conv_id are one conversation; an empty role has no initial, so keeping
it changes no order, and any initial but s, u, a can't be kept; an empty table gives an empty result. Texts are read
whole. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import materialize, once_a_process

#: Turn numbers of a block, and most rows of a piece.
SEGMENT = 256
#: Rows that one recursive query takes, at least, where there are more.
ROWS = 20_000
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

BLANKS = " \t\n\x0b\x0c\r"
EMPTY = hashlib.sha256(b"").hexdigest()
#: Grammar states: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a role's initial leads to, by the state before it.
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {s: s for s in range(4)}}
LEGAL = {"su", "ua", "au"}
#: Kinds of rows for the query.
SOUND, BROKEN, GONE = range(3)


def _inserts(state: int) -> dict[int, str]:
    """What no, one or two inserted turns lead to."""
    out, at, edits = {state: ""}, state, ""
    for _ in range(2):
        at, edits = (ASSISTANT if at == USER else USER), edits + "I"
        out.setdefault(at, edits)
    return out


def _moves() -> list[tuple[int, str, int, int, int, str]]:
    """(state, initial, kind, next state, cost, edits) of the cheapest ways to pass a row, inserts before it included."""
    out = []
    for state in range(4):
        for initial in ("s", "u", "a", "", "?"):
            for kind in (SOUND, BROKEN, GONE):
                best: dict[int, tuple[int, str]] = {}
                for mid, ins in _inserts(state).items():
                    extra = TRUNCATED if kind == BROKEN else 0
                    ways = [(mid, DELETE, "D")]
                    if kind != GONE:
                        kept = AFTER.get(initial, {}).get(mid)
                        ways += [(ASSISTANT if mid == USER else USER, REROLE + extra, "R")] + ([(kept, extra, "K")] if kept is not None else [])
                    for to, cost, edit in ways:
                        way = (cost + INSERT * len(ins), ins + edit)
                        best[to] = min(best.get(to, way), way)
                out += [(state, initial, kind, to, *way) for to, way in best.items()]
    return out


#: Each recursion advances every piece by one row; `best` is the least (cost, audit) of a piece, first state and state.
WALK = """
WITH RECURSIVE walk AS (
  SELECT piece, first, 0 AS pos, first AS state, {'cost': 0::BIGINT, 'audit': ''} AS best FROM starts
  UNION ALL
  SELECT w.piece, w.first, w.pos + 1, m.next, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.edits})
  FROM walk w JOIN rows r ON r.piece = w.piece AND r.pos = w.pos JOIN moves m ON m.state = w.state AND m.initial = r.initial AND m.kind = r.kind
  GROUP BY w.piece, w.first, w.pos, m.next
)
SELECT w.piece, w.first, w.state, w.best.cost AS cost, w.best.audit AS audit FROM walk w JOIN sizes s ON s.piece = w.piece AND s.n = w.pos
"""


def _connection():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    con.execute("CREATE TABLE moves (state INT, initial VARCHAR, kind INT, next INT, cost BIGINT, edits VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", _moves())
    return con


def known(role: str) -> str:
    initial = role[:1]
    return initial if initial in AFTER else "?"


@dataclass
class Piece:
    """Consecutive rows of a conversation with their faults."""

    conv_id: int | None
    seg: int
    k: int = 0
    whole: bool = True
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    turns: list[int] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0

    def add(self, turn, role: str, text: str, seen: set) -> None:
        said, key = text.strip(BLANKS), row_key(role, text)
        kind = SOUND
        if not said:
            self.blank, kind = self.blank + 1, GONE
        elif key in seen:
            self.duplicate, kind = self.duplicate + 1, GONE
        elif said[-1] not in ".!?":
            self.truncated, kind = self.truncated + 1, BROKEN
        seen.add(key)
        self.roles.append(role)
        self.texts.append(text)
        self.kinds.append(kind)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def illegal(self) -> int:
        return sum(a[:1] + b[:1] not in LEGAL for a, b in zip(self.roles, self.roles[1:]))


def row_key(role: str, text: str) -> bytes:
    """As `_key` has it on Spark's side."""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def _key():
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def lines(roles: list[str], texts: list[str], audit: str, state: int) -> tuple[list[tuple[str, str]], int]:
    """The (role, text) that an audit makes of rows after `state`, and the state after them."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text, state = roles[at], texts[at], AFTER[known(roles[at])][state]
        else:
            state = ASSISTANT if state == USER else USER
            role, text = "assistant" if state == ASSISTANT else "user", texts[at] if edit == "R" else ""
        at += edit != "I"
        out.append((role, text))
    return out, state


def _best_end(ends: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The cheapest path that ends the grammar, with inserts after the last row."""
    return min((cost + INSERT * len(ins), audit + ins) for state, (cost, audit) in ends.items() for to, ins in _inserts(state).items() if to in (START, ASSISTANT))


def _solve(pieces: list[Piece]) -> list[dict[int, dict[int, tuple[int, str]]]]:
    """For each piece and first state: last state -> (cost, audit)."""
    con = once_a_process("repair", _connection)
    at = [(i, pos, known(r), k) for i, p in enumerate(pieces) for pos, (r, k) in enumerate(zip(p.roles, p.kinds, strict=True))]
    piece, pos, initial, kind = zip(*at, strict=True)
    tables = {
        "rows": pa.table({"piece": pa.array(piece, pa.int32()), "pos": pa.array(pos, pa.int32()), "initial": pa.array(initial, pa.string()), "kind": pa.array(kind, pa.int32())}),
        "sizes": pa.table({"piece": pa.array(range(len(pieces)), pa.int32()), "n": pa.array([len(p.roles) for p in pieces], pa.int32())}),
    }
    starts = [(i, s) for i, p in enumerate(pieces) for s in ((START,) if p.whole else range(4))]
    tables["starts"] = pa.table({"piece": pa.array([i for i, _ in starts], pa.int32()), "first": pa.array([s for _, s in starts], pa.int32())})
    for name, data in tables.items():
        con.register(name, data)
    out: list[dict[int, dict[int, tuple[int, str]]]] = [{} for _ in pieces]
    for i, first, state, cost, audit in con.execute(WALK).fetchall():
        out[i].setdefault(first, {})[state] = (cost, audit)
    for name in tables:
        con.unregister(name)
    return out


_PATHS = pa.list_(pa.struct([("first", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_PIECES = pa.schema([
    ("conv_id", pa.int64()), ("seg", pa.int64()), ("k", pa.int64()), ("whole", pa.bool_()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
    ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("n_turns", pa.int64()), ("paths", _PATHS), ("rows", _ROWS),
])
_PIECES_DDL = (
    "conv_id long, seg long, k long, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
    "first string, last string, low long, high long, n_turns long, paths array<struct<first:int,state:int,cost:bigint,audit:string>>, rows array<struct<role:string,text:string>>"
)


def _solved(pieces: list[Piece], with_turns: bool) -> pa.RecordBatch:
    out = []
    for p, ways in zip(pieces, _solve(pieces), strict=True):
        row = {"conv_id": p.conv_id, "seg": p.seg, "k": p.k, "whole": p.whole, "blank": p.blank, "duplicate": p.duplicate, "truncated": p.truncated, "illegal": p.illegal()}
        low, high = (p.turns[0], p.turns[-1]) if p.turns else (None, None)
        if p.whole:
            cost, audit = _best_end(ways[START])
            said, _ = lines(p.roles, p.texts, audit, START)
            digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
            row |= {"gaps": high - low + 1 - len(p.turns) if p.turns else 0, "cost": cost, "audit": audit, "repaired_sha256": digest}
            row["rows"] = [{"role": r, "text": t} for r, t in said] if with_turns else None
        else:
            row |= {"first": p.roles[0][:1], "last": p.roles[-1][:1], "low": low, "high": high, "n_turns": len(p.turns)}
            row["paths"] = [{"first": a, "state": b, "cost": c, "audit": e} for a, ends in ways.items() for b, (c, e) in ends.items()]
            row["rows"] = [{"role": r, "text": t} for r, t in zip(p.roles, p.texts, strict=True)]
        out.append(row)
    return pa.RecordBatch.from_pylist(out, _PIECES)


def _pieces(batches: Iterable[pa.RecordBatch], segment: int) -> Iterator[Piece]:
    """Pieces of the sorted rows. A block's marks stand before its rows: no key, if its conversation has other blocks; a key of a row said in an earlier one."""
    now: Piece | None = None
    block, seen, many = None, set(), False
    for batch in batches:
        conv_ids, segs, marks, turns, roles = (batch.column(i).to_pylist() for i in range(5))
        texts, keys = batch.column(5), batch.column(6)
        for i, (conv_id, seg, mark, turn, role) in enumerate(zip(conv_ids, segs, marks, turns, roles, strict=True)):
            if block != (conv_id, seg):
                if now is not None:
                    yield now
                now, block, seen, many = None, (conv_id, seg), set(), False
            if mark == 0:
                key = keys[i].as_py()
                many = True
                if key is not None:
                    seen.add(key)
                continue
            if now is None:
                now = Piece(conv_id, seg, whole=not many)
            elif len(now.roles) >= segment:
                now.whole = False
                yield now
                now = Piece(conv_id, seg, now.k + 1, whole=False)
            now.add(turn, role, texts[i].as_py(), seen)
    if now is not None:
        yield now


def _piece_batches(segment: int, with_turns: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for piece in _pieces(batches, segment):
            held.append(piece)
            n += len(piece.roles)
            if n >= ROWS:
                yield _solved(held, with_turns)
                held, n = [], 0
        if held:
            yield _solved(held, with_turns)

    return run


class _Fold:
    """The pieces of a conversation, in order: the best path to each state, as the way through each piece."""

    def __init__(self, conv_id):
        self.conv_id, self.ends = conv_id, {START: (0, "", [])}
        self.places: list[tuple[int, int]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.low = self.high = None
        self.last: str | None = None

    def add(self, p: dict) -> None:
        best: dict[int, tuple] = {}
        for w in p["paths"]:
            if (before := self.ends.get(w["first"])) is not None:
                way = (before[0] + w["cost"], before[1] + w["audit"], w["first"], w["audit"], before[2])
                best[w["state"]] = min(best.get(w["state"], way), way, key=lambda x: x[:2])
        self.ends = {state: (cost, audit, [(first, own), rest]) for state, (cost, audit, first, own, rest) in best.items()}
        self.places.append((p["seg"], p["k"]))
        for c in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, c, getattr(self, c) + p[c])
        self.illegal += self.last is not None and self.last + p["first"] not in LEGAL
        self.last = p["last"]
        if p["low"] is not None:
            self.n_turns += p["n_turns"] - (p["low"] == self.high)
            self.low, self.high = p["low"] if self.low is None else self.low, p["high"]

    def rows(self) -> list[dict]:
        cost, audit, state, ins = min((c + INSERT * len(ins), a + ins, s, ins) for s, (c, a, _) in self.ends.items() for to, ins in _inserts(s).items() if to in (START, ASSISTANT))
        out, ways = [], self.ends[state][2]
        for i, (seg, k) in enumerate(reversed(self.places)):
            (first, own), ways = ways
            out.append({"conv_id": self.conv_id, "seg": seg, "k": k, "entry": first, "own": own + ins * (i == 0)})
        gaps = self.high - self.low + 1 - self.n_turns if self.high is not None else 0
        out[0] |= {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit}
        return out


_WAYS = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("k", pa.int64()), ("entry", pa.int32()), ("own", pa.string()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
_WAYS_DDL = "conv_id long, seg long, k long, entry int, own string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _fold_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One way for each piece; the last piece's row has the conversation's figures."""
    now: _Fold | None = None
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            if now is None or now.conv_id != p["conv_id"]:
                out += now.rows() if now else []
                now = _Fold(p["conv_id"])
            now.add(p)
        if out:
            yield pa.RecordBatch.from_pylist(out, _WAYS)
    if now is not None:
        yield pa.RecordBatch.from_pylist(now.rows(), _WAYS)


def _rewrite_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("k", pa.int64()), ("rows", _ROWS)])
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            said, _ = lines([r["role"] for r in p["rows"]], [r["text"] for r in p["rows"]], p["own"], p["entry"])
            out.append({"conv_id": p["conv_id"], "seg": p["seg"], "k": p["k"], "rows": [{"role": r, "text": t} for r, t in said]})
        yield pa.RecordBatch.from_pylist(out, schema)


def _digest_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    now, digest, some = (), None, False
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            if now != (p["conv_id"],):
                if now:
                    out.append({"conv_id": now[0], "repaired_sha256": digest.hexdigest()})
                now, digest, some = (p["conv_id"],), hashlib.sha256(), False
            for r in p["rows"]:
                digest.update(("\n" * some + f"{r['role']}:{r['text']}").encode())
                some = True
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if now:
        yield pa.RecordBatch.from_pylist([{"conv_id": now[0], "repaired_sha256": digest.hexdigest()}], schema)


def _solve_pieces(turns: DataFrame, segment: int, with_turns: bool) -> DataFrame:
    seg = F.coalesce(F.floor(F.col("turn") / segment), F.lit(-(2**63)))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    ).withColumn("seg", seg)
    blocks = rows.groupBy("conv_id").agg(F.min("seg").alias("low"), F.max("seg").alias("high")).where("low < high").select(F.col("conv_id").alias("many"))
    keys = rows.select("conv_id", "seg", _key().alias("key")).join(blocks, F.col("conv_id").eqNullSafe(F.col("many")), "left_semi").distinct()
    firsts = keys.groupBy("conv_id", "key").agg(F.min("seg").alias("first"))
    said = keys.alias("k").join(firsts.alias("f"), F.col("k.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("k.key") == F.col("f.key")) & (F.col("k.seg") > F.col("f.first"))).select("k.conv_id", "k.seg", "k.key")
    marks = keys.select("conv_id", "seg", F.lit(None).cast("binary").alias("key")).distinct().union(said)
    both = rows.select("conv_id", "seg", F.lit(1).alias("mark"), "turn", "role", "text", F.lit(None).cast("binary").alias("key")).unionByName(
        marks.select("conv_id", "seg", F.lit(0).alias("mark"), "key"), allowMissingColumns=True
    )
    dealt = both.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "mark", "turn", "role", "text")
    return materialize(dealt.mapInArrow(_piece_batches(segment, with_turns), _PIECES_DDL), "repair-pieces")


def _long(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of conversations of many pieces: the way through each piece, and the rewritten pieces."""
    parts = pieces.where("NOT whole")
    light = parts.select("conv_id", "seg", "k", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "n_turns", "paths")
    ways = materialize(light.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "k").mapInArrow(_fold_batches, _WAYS_DDL), "repair-ways")
    own = ways.select("conv_id", "seg", "k", "entry", "own").alias("w")
    same = F.col("p.conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("p.seg") == F.col("w.seg")) & (F.col("p.k") == F.col("w.k"))
    found = parts.select("conv_id", "seg", "k", "rows").alias("p").join(own, same).select("p.conv_id", "p.seg", "p.k", "p.rows", "w.entry", "w.own")
    return ways, found.mapInArrow(_rewrite_batches, "conv_id long, seg long, k long, rows array<struct<role:string,text:string>>")


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of (conv_id, turn, role, text)."""
    pieces = _solve_pieces(turns, segment, False)
    ways, rewritten = _long(pieces)
    ordered = rewritten.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "k")
    digests = ordered.select("conv_id", "rows").mapInArrow(_digest_batches, "conv_id long, repaired_sha256 string").alias("d")
    figures = ways.where("cost IS NOT NULL").alias("w")
    longer = figures.join(digests, F.col("w.conv_id").eqNullSafe(F.col("d.conv_id"))).select("w.conv_id", *(f"w.{c}" for c in FIGURES), "w.audit", "d.repaired_sha256")
    return pieces.where("whole").select("conv_id", *FIGURES, "audit", "repaired_sha256").union(longer)


def repaired_turns(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv_id, seg, k, pos, role, text): the repaired conversations' turns, in the order of seg, k and pos."""
    pieces = _solve_pieces(turns, segment, True)
    _, rewritten = _long(pieces)
    rows = pieces.where("whole").select("conv_id", "seg", "k", "rows").union(rewritten)
    return rows.select("conv_id", "seg", "k", F.posexplode("rows").alias("pos", "row")).select("conv_id", "seg", "k", "pos", "row.role", "row.text")


def damage(turns: DataFrame) -> DataFrame:
    """Rows as crc32(`conv_id:turn`) % 20 damages them: 0 drops a row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes it a user's. Nulls are one space; a null turn stays one."""
    part = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    hit = (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("hit")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), hit).where("hit <> 0")
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    edited = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), edited.alias("text"), copies.alias("copy")).drop("copy")
