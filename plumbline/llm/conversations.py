"""Conversation structure repair: the cheapest edits that give a conversation the order of roles (s?(ua)+)?, ties to the ASCII-least.

Costs to go are found backwards over turns and states of the grammar, then a walk forwards takes at each turn the ASCII-least edit
among those that lie on a cheapest way. Rows are laid out in the order of conversations and turns, in blocks of BLOCK rows, and only
codes of rows, one byte each, are worked on; a conversation that crosses blocks, of any length, is solved by blocks: each block gives
its costs between states, those are combined backwards, each block then maps states at its start to states at its end, those are
combined forwards. What is gathered of one conversation is a few numbers for each of its blocks, far less than its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.shared import CRC_SQL, crc32_sql, drop_tables, materialize, table

#: Bits of the number of rows in a block; UTF-8 bytes of text that a partition of the layout holds, about.
BLOCK_BITS, PART_BYTES = 12, 1 << 27
#: Costs of Delete, Insert, Keep, Rerole, and what an undeleted truncated row adds.
COST, TRUNCATED = {"D": 2, "I": 5, "K": 0, "R": 1}, 5
#: States of the grammar: nothing yet, after s, after u, after a; the conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
#: From each state, the state after each initial.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: From each state the role that an Insert or a Rerole gives, and the state after it.
GIVEN = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: Faults of a row, first that counts first; a row's code is its initial's place (3: another) and four times its fault.
SOUND, BLANK, DUPLICATE, CUT = range(4)
FAR = 1 << 60
#: Costs to go at the end of a conversation: with the inserts that end it well.
ENDS = (0, 2 * COST["I"], COST["I"], 0)
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults: crc32 of `conv_id:turn` modulo 20 is 0 drops a row, 1 empties its text,
    2 removes [.!?] from it, 3 repeats the row, 4 makes its role user. Nulls are one space, in the crc32, as role and as text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    role = F.when(fault == 4, "user").otherwise(blank("role"))
    made = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), fault.alias("fault"))
    made = made.where("fault <> 0").withColumn("again", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return made.select("conv_id", "turn", "role", "text")


def _code(role: Column, fault: Column) -> Column:
    place = F.coalesce(*(F.when(F.substring(role, 1, 1) == c, F.lit(k)) for k, c in enumerate(INITIALS)), F.lit(3))
    return place + 4 * fault


def laid_out(rows: DataFrame) -> DataFrame:
    """The rows in order, as a stored table (conv_id, turn, role, text, at): at ascends with conversation and turn, and gives the row's block.

    Rows of one turn stand in the order of role, the text's first 64 characters, and its hash; equal rows stand side by side, and as
    many as they are they need not lie in one partition.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    keys = {"_head": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", *keys]
    placed = rows.withColumns(keys).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(placed.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at")), "turns")


def coded(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, at, code) of laid-out rows. A copy is found without gathering a text's copies: the first of each role and text is an aggregate, and rows meet it by their place."""
    bare = F.expr("trim(TRAILING '" + SPACES + "' FROM text)")
    marked = rows.select("conv_id", "turn", "role", "at", bare.alias("bare"), F.sha2("text", 256).alias("digest"))
    firsts = marked.where("bare <> ''").groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    last = F.substring("bare", -1, 1)
    light = marked.select("conv_id", "turn", "role", "at", (F.col("bare") == "").alias("is_blank"), (~last.isin(".", "!", "?")).alias("is_cut"))
    fault = F.when(F.col("is_blank"), F.lit(BLANK)).when(F.col("is_first").isNull(), F.lit(DUPLICATE)).when(F.col("is_cut"), F.lit(CUT)).otherwise(F.lit(SOUND))
    return light.join(firsts, "at", "left").select("conv_id", "turn", "at", _code(F.col("role"), fault).alias("code"))


# ---------------------------------------------------------------- costs to go and walks


def _moves(code: int) -> list[list[tuple[str, int, int]]]:
    """For each state the edits of a row with that code, ASCII-least first: (letter, cost, state after it). Inserts are apart."""
    initial, fault = INITIALS[code % 4 : code % 4 + 1], code // 4
    out = []
    for state in range(4):
        found = [("D", COST["D"], state)]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            if initial in NEXT[state]:
                found.append(("K", COST["K"] + more, NEXT[state][initial]))
            found.append(("R", COST["R"] + more, GIVEN[state][1]))
        out.append(found)
    return out


MOVES = [_moves(code) for code in range(16)]


def before(code: int, togo: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go from each state before a row, from those after it."""
    own = [min(cost + togo[to] for _, cost, to in MOVES[code][state]) for state in range(4)]
    out = []
    for state in range(4):
        one = GIVEN[state][1]
        two = GIVEN[one][1]
        out.append(min(own[state], COST["I"] + own[one], 2 * COST["I"] + own[two]))
    return tuple(out)


@lru_cache(1 << 14)
def costs_between(codes: bytes) -> tuple[int, ...]:
    """Least costs of the rows from each state before them to each state right after the last of them, state by state."""
    columns = []
    for end in range(4):
        togo = tuple(0 if s == end else FAR for s in range(4))
        for code in reversed(codes):
            togo = before(code, togo)
        columns.append(togo)
    return tuple(min(FAR, columns[e][s]) for s in range(4) for e in range(4))


@lru_cache(1 << 14)
def walked(codes: bytes, state: int, end: tuple[int, ...], last: bool) -> tuple[str, int, int]:
    """The audit of the rows from a state on, its cost and the state after it, with costs to go at their end; the last rows also get the inserts that end the conversation."""
    togo = [end]
    for code in reversed(codes):
        togo.append(before(code, togo[-1]))
    togo.reverse()
    out, paid = [], 0
    for k, code in enumerate(codes):
        while True:
            left = togo[k][state]
            letter, cost, to = next(m for m in (*MOVES[code][state][:1], ("I", COST["I"], GIVEN[state][1]), *MOVES[code][state][1:]) if m[1] + togo[k + (m[0] != "I")][m[2]] == left)
            out.append(letter)
            paid, state = paid + cost, to
            if letter != "I":
                break
    while last and ENDS[state]:
        out.append("I")
        paid, state = paid + COST["I"], GIVEN[state][1]
    return "".join(out), paid, state


#: What a block knows of a conversation's rows in it. first_, last_: of its initials' places and of its turns; edge: it may go on in another block.
SEGMENT = "conv_id long, block long, edge boolean, codes binary, first_place int, last_place int, first_turn long, last_turn long, n_turns long, n_blank long, n_duplicate long, n_truncated long, n_illegal long"


def _illegal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether places of adjacent initials are none of su, ua, au."""
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


def segments(codes: DataFrame) -> DataFrame:
    """A row for each conversation and block of coded rows."""

    def cut(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        conv, turn = t.column("conv_id").combine_chunks(), t.column("turn").combine_chunks()
        ids, none = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(zero_copy_only=False)
        turns, no_turn = turn.fill_null(0).to_numpy(), turn.is_null().to_numpy(zero_copy_only=False)
        code = t.column("code").to_numpy().astype(np.uint8)
        block = t.column("block")[0].as_py()
        first = np.concatenate(([0], np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1, [len(ids)]))
        place, fault = code % 4, code // 4
        rows = []
        for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
            known = turns[lo:hi][~no_turn[lo:hi]]
            n = np.bincount(fault[lo:hi], minlength=4).tolist()
            ends = (int(known[0]), int(known[-1]), int((known[1:] != known[:-1]).sum()) + 1) if len(known) else (None, None, 0)
            illegal = int(_illegal(place[lo : hi - 1], place[lo + 1 : hi]).sum())
            rows.append((None if none[lo] else int(ids[lo]), block, k in (0, len(first) - 2), code[lo:hi].tobytes(), int(place[lo]), int(place[hi - 1]), *ends, *n[1:], illegal))
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), SEGMENT_TYPES, strict=True)], names=SEGMENT_NAMES)

    rows = codes.withColumn("block", F.shiftright("at", BLOCK_BITS))
    return rows.groupBy("block").applyInArrow(cut, SEGMENT)


SEGMENT_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]
SEGMENT_TYPES = [{"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in SEGMENT.split(", ")]
AUDITED = SEGMENT.replace("codes binary", "audit string, state int, cost long")


def _audited(segs: DataFrame, solve) -> DataFrame:
    """The segments with their audit, the state it starts from and its cost, in the place of the codes."""
    kept = [c for c in SEGMENT_NAMES if c != "codes"]

    def run(batches):
        for b in batches:
            found = [solve(r) for r in b.to_pylist()]
            more = dict(zip(("audit", "state", "cost"), zip(*found, strict=True), strict=True)) if found else {"audit": [], "state": [], "cost": []}
            kinds = {"audit": pa.string(), "state": pa.int32(), "cost": pa.int64()}
            names = [c.split()[0] for c in AUDITED.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(c) if c in kept else pa.array(more[c], kinds[c]) for c in names], names=names)

    return segs.mapInArrow(run, AUDITED)


def audits(segs: DataFrame) -> DataFrame:
    """Every segment's audit. Segments inside their block are whole conversations; those at its edge are solved over all blocks of their conversation."""

    def whole(r):
        audit, cost, _ = walked(r["codes"], START, ENDS, True)
        return audit, START, cost

    def between(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array([costs_between(c) for c in b.column("codes").to_pylist()], pa.list_(pa.int64()))], names=["conv_id", "block", "costs"])

    def backwards(t: pa.Table) -> pa.Table:
        """Costs to go at the end of each block of one conversation."""
        t = t.sort_by([("block", "descending")])
        togo, out = ENDS, []
        for costs in t.column("costs").to_pylist():
            out.append(togo)
            togo = tuple(min(costs[4 * s + e] + togo[e] for e in range(4)) for s in range(4))
        return pa.table([t.column("conv_id"), t.column("block"), pa.array(out, pa.list_(pa.int64())), pa.array([k == 0 for k in range(len(out))])], names=["conv_id", "block", "togo", "is_last"])

    def ends(batches):
        """Where a block's walk from each state ends."""
        for b in batches:
            found = [[walked(c, s, tuple(togo), last)[2] for s in range(4)] for c, togo, last in zip(b.column("codes").to_pylist(), b.column("togo").to_pylist(), b.column("is_last").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("block"), pa.array(found, pa.list_(pa.int64()))], names=["conv_id", "block", "ends"])

    def forwards(t: pa.Table) -> pa.Table:
        """The state at the start of each block of one conversation."""
        t = t.sort_by("block")
        state, out = START, []
        for to in t.column("ends").to_pylist():
            out.append(state)
            state = to[state]
        return pa.table([t.column("conv_id"), t.column("block"), pa.array(out, pa.int32())], names=["conv_id", "block", "state"])

    edges = segs.where("edge")
    same = lambda a, b: a.join(b.withColumnsRenamed({"conv_id": "_conv", "block": "_block"}), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).drop("_conv", "_block")
    togo = edges.select("conv_id", "block", "codes").mapInArrow(between, "conv_id long, block long, costs array<long>").groupBy("conv_id").applyInArrow(backwards, "conv_id long, block long, togo array<long>, is_last boolean")
    known = materialize(same(edges, togo), "edges")
    states = known.select("conv_id", "block", "codes", "togo", "is_last").mapInArrow(ends, "conv_id long, block long, ends array<long>").groupBy("conv_id").applyInArrow(forwards, "conv_id long, block long, state int")

    def part(r):
        audit, cost, _ = walked(r["codes"], r["state"], tuple(r["togo"]), r["is_last"])
        return audit, r["state"], cost

    out = materialize(_audited(segs.where("NOT edge"), whole).unionByName(_audited(same(known, states), part)), "audits")
    drop_tables(known)
    return out


# ---------------------------------------------------------------- rebuilding turns

AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, turn long, role string, text string"
MARKER, WALK, ROW = range(3)
_NUMBERS = ["edge", "state", "cost", "first_place", "last_place", "first_turn", "last_turn", "n_turns", "n_blank", "n_duplicate", "n_truncated", "n_illegal"]


class _Conversation:
    """One conversation as its segments and rows go by, in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.audit, self.state, self.edits, self.at = conv_id, [], START, "", 0
        self.n, self.place, self.low, self.high, self.n_turns = dict.fromkeys(("n_blank", "n_duplicate", "n_truncated", "n_illegal", "cost"), 0), None, None, None, 0

    def segment(self, audit: str, v: list[int | None]) -> Iterator[tuple[str, str]]:
        yield from self._inserts()
        v = dict(zip(_NUMBERS, v, strict=True))
        for c in self.n:
            self.n[c] += v[c]
        if self.place is not None:
            self.n["n_illegal"] += int(_illegal(np.array([self.place]), np.array([v["first_place"]]))[0])
        self.place = v["last_place"]
        if v["n_turns"]:
            self.n_turns += v["n_turns"] - (self.high == v["first_turn"])
            self.low, self.high = v["first_turn"] if self.low is None else self.low, v["last_turn"]
        self.audit.append(audit)
        self.edits, self.at, self.state = audit, 0, v["state"]

    def _inserts(self) -> Iterator[tuple[str, str]]:
        while self.edits[self.at : self.at + 1] == "I":
            role, self.state = GIVEN[self.state]
            self.at += 1
            yield role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserts()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "R":
            role, self.state = GIVEN[self.state]
        elif edit == "K":
            self.state = NEXT[self.state][role[0]]
        if edit != "D":
            yield role, text

    def result(self, sha: str) -> tuple:
        gaps = self.high - self.low + 1 - self.n_turns if self.n_turns else 0
        return self.conv_id, gaps, self.n["n_blank"], self.n["n_duplicate"], self.n["n_truncated"], self.n["n_illegal"], self.n["cost"], "".join(self.audit), sha


def _streamed(ids: DataFrame, rows: DataFrame, found: DataFrame) -> DataFrame:
    """Conversation ids, segments and rows as one stream: a conversation's marker, then each block's segment before its rows."""
    none = lambda kind: F.lit(None).cast(kind)
    markers = ids.select("conv_id", F.lit(-1).cast("long").alias("block"), F.lit(MARKER).alias("kind"), F.lit(0).cast("long").alias("at"), none("string").alias("a"), none("string").alias("b"), none("array<long>").alias("v"))
    walks = found.select("conv_id", "block", F.lit(WALK).alias("kind"), F.lit(0).cast("long").alias("at"), F.col("audit").alias("a"), none("string").alias("b"), F.array(*(F.col(c).cast("long") for c in _NUMBERS)).alias("v"))
    texts = rows.select("conv_id", F.shiftright("at", BLOCK_BITS).alias("block"), F.lit(ROW).alias("kind"), "at", F.col("role").alias("a"), F.col("text").alias("b"), none("array<long>").alias("v"))
    every = markers.unionByName(walks).unionByName(texts)
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "block", "kind", "at")


def _digests(batches):
    now, sha, begun, out = None, None, False, []

    def take(pairs):
        nonlocal begun
        for role, text in pairs:
            sha.update(("\n" * begun + role + ":" + text).encode())
            begun = True

    def ended():
        if now is not None:
            take(now._inserts())
            out.append(now.result(sha.hexdigest()))

    def batch():
        names = [c.split()[0] for c in AUDIT.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in AUDIT.split(", ")]
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)
        out.clear()
        return made

    for b in batches:
        for conv_id, kind, a, text, v in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "a", "b", "v")), strict=True):
            if kind == MARKER:
                ended()
                now, sha, begun = _Conversation(conv_id), hashlib.sha256(), False
            else:
                take(now.segment(a, v) if kind == WALK else now.row(a, text))
        if out:
            yield batch()
    ended()
    if out:
        yield batch()


def _turns(batches):
    now, place, out = None, 0, []

    def take(pairs):
        nonlocal place
        for role, text in pairs:
            out.append((now.conv_id, place, role, text))
            place += 1

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["conv_id", "turn", "role", "text"])
        out.clear()
        return made

    for b in batches:
        for conv_id, kind, a, text, v in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "a", "b", "v")), strict=True):
            if kind == MARKER:
                if now is not None:
                    take(now._inserts())
                now, place = _Conversation(conv_id), 0
            else:
                take(now.segment(a, v) if kind == WALK else now.row(a, text))
        if out:
            yield batch()
    if now is not None:
        take(now._inserts())
    if out:
        yield batch()


def repaired(rows: DataFrame, ids: DataFrame | None = None, turns: bool = False) -> DataFrame:
    """Repairs every conversation of rows(conv_id, turn, role, text).

    Returns a row for each conversation of ids, or of rows (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256), or with turns the repaired rows themselves (conv_id, turn from 0, role, text). A conversation's rows are taken by
    turn, nulls first; rows of one turn as laid_out() says. A null role or text is one space; rows without conv_id are one conversation.
    A conversation of ids without rows has zeros, an empty audit and the hash of nothing. An empty table gives no rows. Other columns
    are ignored. The hash of a conversation's rows is one sequential computation: it streams in one task, which holds one batch of rows
    and the audit; all else of a long conversation is dealt by blocks.
    """
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    ids = (rows if ids is None else ids).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = laid_out(rows)
    segs = materialize(segments(coded(rows)), "segments")
    found = audits(segs)
    out = materialize(_streamed(ids, rows, found).mapInArrow(_turns if turns else _digests, TURNS if turns else AUDIT), "repaired")
    drop_tables(rows, segs, found)
    return out


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return repaired(damaged(given), given)


#: Turn by turn forwards, with the cheapest, ASCII-least audit and its text for each state of the grammar.
SQL = rf"""WITH RECURSIVE {CRC_SQL},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM c, range(2) t(r) WHERE f <> 0 AND (r = 0 OR f = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen FROM o),
g AS (SELECT *, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS prior, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM p),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (0, 1, 2, 'u'), (0, 2, 3, 'ua'), (1, 0, 1, ''), (1, 1, 2, 'u'), (1, 2, 3, 'ua'), (2, 0, 2, ''), (2, 1, 3, 'a'), (2, 2, 2, 'au'), (3, 0, 3, ''), (3, 1, 2, 'u'), (3, 2, 3, 'ua')) v(state, n, mid, put)),
moves AS (SELECT * FROM (VALUES (0, 'D', NULL, 0, 2), (1, 'D', NULL, 1, 2), (2, 'D', NULL, 2, 2), (3, 'D', NULL, 3, 2), (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0), (0, 'R', NULL, 2, 1), (1, 'R', NULL, 2, 1), (2, 'R', NULL, 3, 1), (3, 'R', NULL, 2, 1)) v(mid, edit, wanted, upto, cost)),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, 0 AS state, 0::BIGINT AS cost, '' AS audit, '' AS made FROM g
  UNION ALL SELECT conv_id, k, state, cost, audit, made FROM (
    SELECT w.conv_id, g.k, m.upto AS state, w.cost + 5 * i.n + m.cost + CASE WHEN m.edit <> 'D' AND g.fault = 'truncated' THEN 5 ELSE 0 END AS cost, w.audit || repeat('I', i.n) || m.edit AS audit,
      w.made || replace(replace(i.put, 'u', 'user:' || chr(10)), 'a', 'assistant:' || chr(10)) || CASE m.edit WHEN 'D' THEN '' ELSE CASE WHEN m.edit = 'K' THEN g.role WHEN m.upto = 2 THEN 'user' ELSE 'assistant' END || ':' || g.text || chr(10) END AS made
    FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.k = w.k + 1 JOIN ins i ON i.state = w.state JOIN moves m ON m.mid = i.mid
    WHERE m.edit = 'D' OR g.fault NOT IN ('blank', 'duplicate') AND (m.wanted IS NULL OR m.wanted = g.initial))
  QUALIFY row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) = 1),
s AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
best AS (SELECT s.*, w.cost + 5 * i.n AS cost, w.audit || repeat('I', i.n) AS audit, w.made || replace(replace(i.put, 'u', 'user:' || chr(10)), 'a', 'assistant:' || chr(10)) AS made FROM s JOIN w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.k = s.n JOIN ins i ON i.state = w.state
  WHERE i.mid IN (0, 3) QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY w.cost + 5 * i.n, w.audit || repeat('I', i.n)) = 1)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(left(made, greatest(length(made) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM x.conv_id"""
