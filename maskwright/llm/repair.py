"""Conversation structure repair: cheapest edits by a cost DP, least audit by prefix-doubling path ranking.

A conversation is legal when its roles begin with system or not at all and then alternate between user and
assistant, ending with the assistant. Nodes are (row, state); arcs keep, rerole, delete or insert. After the cost DP
only arcs of cheapest paths remain. They are ranked by the first 1, 2, 4, ... letters of the least audit that begins
with them: a rank of twice the length is the pair of an arc's rank and the best rank at the node its pointer reaches.

Conversations are cut out of one global order (range shuffle), so that a conversation of any size is a run of
bounded fragments; fragments are combined by min-plus matrices of costs and by maps of states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.session import materialize, work_partitions

SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
KEEP, REROLE, DELETE, INSERT = (ord(c) for c in "KRDI")
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
#: States: nothing yet, after system, after user, after assistant. State after a row kept by its role's code (0 other,
#: 1 system, 2 user, 3 assistant), or -1; state after the role that a rerole or insertion must give.
AFTER = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
MADE = np.array([2, 2, 3, 2])
NAMES = {2: "user", 3: "assistant"}
CODES = {"s": 1, "u": 2, "a": 3}
LEGAL = {(1, 2), (2, 3), (3, 2)}
NEVER = 1 << 40
#: Cost to a legal end by insertions.
FINAL = np.array([0, 4, 2, 0])
#: Characters of a conversation that a task holds; a longer one is handled by fragments. Rows repaired at once.
HELD_CHARS, GATHERED = 4 << 20, 4096
RANGE_CHARS = 256

COUNTS = "turn_min long, turn_max long, turns long, blanks long, duplicates long, truncated long, illegal long, first_code int, last_code int"
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PASSED = f"conv long, part int, idx long, turn long, role string, text string, dropped boolean, code int, empty boolean, cut boolean, digest binary, open boolean, {RESULT}"
NARROW = "conv long, part int, idx long, turn long, code int, empty boolean, cut boolean, late boolean, tail array<long>"
MEASURED = "conv long, part int, matrix array<long>"
TAILED = "conv long, part int, tail array<long>, cut boolean"
WALKED = f"conv long, part int, {COUNTS}, audits array<string>, after array<long>, paid array<long>"
STREAMED = f"conv long, idx long, role string, text string, {RESULT}"


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) damaged by the hash of conversation and turn; `dropped` marks what is gone. Nulls become spaces."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def cost_to_go(first: np.ndarray, code: np.ndarray, forced: np.ndarray, cut: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Least cost from every (position, state) to the end, where `tail` holds the cost that follows each sequence.

    Sequence s has rows first[s] .. first[s + 1] and one position more than rows, from first[s] + s on.
    """
    size = np.diff(first)
    cost = np.full((int(first[-1]) + len(size), 4), NEVER, np.int64)
    end = first[1:] + np.arange(len(size))
    cost[end] = tail
    order = np.argsort(-size, kind="stable")
    longest_first = size[order]
    for t in range(1, int(size.max(initial=0)) + 1):
        at = order[: np.searchsorted(-longest_first, -t, side="right")]
        here, row = end[at] - t, first[at + 1] - t
        after = cost[here + 1]
        edited = np.where(forced[row], NEVER, cut[row])[:, None]
        to = AFTER[code[row]]
        kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1), NEVER) + edited
        best = np.minimum(np.minimum(after + COST[DELETE], after[:, MADE] + COST[REROLE] + edited), kept)
        # at most one insertion pays off before a row, or two where a user and an assistant are missing
        best[:, 2:] = np.minimum(best[:, 2:], best[:, [3, 2]] + COST[INSERT])
        best[:, :2] = np.minimum(best[:, :2], best[:, [2]] + COST[INSERT])
        cost[here] = np.minimum(best, NEVER)
    return cost


def optimal_arcs(first: np.ndarray, code: np.ndarray, forced: np.ndarray, cut: np.ndarray, cost: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, letter) of the arcs on cheapest paths; a node is 4 * position + state.

    Insertions after the last row belong to sequences that are `last`; where others end, their paths end.
    """
    n, size = int(first[-1]), np.diff(first)
    place = np.arange(n) + np.repeat(np.arange(len(size)), size)
    inside = np.ones(len(cost), bool)
    inside[(first[1:] + np.arange(len(size)))[~last]] = False
    free = np.flatnonzero(inside)
    edited = np.where(forced, NEVER, cut)
    arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(here: np.ndarray, state: int, there: np.ndarray, reached: np.ndarray, paid, letter: int) -> None:
        left = np.where(reached >= 0, cost[there, np.maximum(reached, 0)], NEVER)
        at = np.flatnonzero((cost[here, state] < NEVER) & (cost[here, state] == paid + left))
        arcs.append((4 * here[at] + state, 4 * there[at] + reached[at], np.full(len(at), letter)))

    for q in range(4):
        add(place, q, place + 1, np.full(n, q), COST[DELETE], DELETE)
        add(place, q, place + 1, AFTER[code, q], COST[KEEP] + edited, KEEP)
        add(place, q, place + 1, np.full(n, MADE[q]), COST[REROLE] + edited, REROLE)
        add(free, q, free, np.full(len(free), MADE[q]), COST[INSERT], INSERT)
    src, dst, letter = (np.concatenate(x) for x in zip(*arcs))
    return src, dst, letter


def ranked_paths(nodes: int, src: np.ndarray, dst: np.ndarray, letter: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Doubled pointers along the least audit from every node, the audit's length, and the arc that begins it (-1: none).

    Level k holds, for every node, the node that the least audit reaches after 2**k letters; `nodes` stands for what
    lies behind the end. Arcs that leave a node differ in their letters, so an audit names one path.
    """
    rank = np.unique(letter, return_inverse=True)[1] + 1
    ahead = dst  # where an arc's least audit stands after 2**k letters
    jumps: list[np.ndarray] = []
    while True:
        order = np.lexsort((rank, src))
        least = order[np.flatnonzero(np.append(True, src[order][1:] != src[order][:-1]))] if len(src) else order
        best = np.zeros(nodes + 1, np.int64)
        best[src[least]] = rank[least]
        jump = np.full(nodes + 1, nodes)
        jump[src[least]] = ahead[least]
        jumps.append(jump)
        if (ahead == nodes).all():
            break
        pair = rank * (int(rank.max(initial=0)) + 1) + best[ahead]
        rank, ahead = np.unique(pair, return_inverse=True)[1] + 1, jump[ahead]
    length = np.zeros(nodes + 1, np.int64)
    length[src] = 1
    for jump in jumps:
        length = length + length[jump]
    arc = np.full(nodes + 1, -1)
    arc[src[least]] = least
    return jumps, length, arc


def walk(jumps: list[np.ndarray], length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the least paths from all nodes of `entry`, path after path with their last nodes, and where each begins."""
    path, node = np.arange(len(entry)), entry
    for jump in jumps:
        on = jump[node] != len(length) - 1
        path, node = np.concatenate([path, path[on]]), np.concatenate([node, jump[node][on]])
    order = np.lexsort((-length[node], path))
    return node[order], np.searchsorted(path[order], np.arange(len(entry) + 1))


def least_repairs(
    first: np.ndarray, code: np.ndarray, forced: np.ndarray, cut: np.ndarray, tail: np.ndarray, last: np.ndarray, state: np.ndarray
) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(cost, audit, state reached) of the cheapest edits of every sequence entered in `state`; the least audit among equals."""
    cost = cost_to_go(first, code, forced, cut, tail)
    start = first[:-1] + np.arange(len(first) - 1)
    src, dst, letter = optimal_arcs(first, code, forced, cut, cost, last)
    jumps, length, arc = ranked_paths(4 * len(cost), src, dst, letter)
    node, begin = walk(jumps, length, 4 * start + state)
    taken = np.append(letter, 0)[arc[node]].astype(np.uint8).tobytes().decode("ascii")
    return cost[start, state], [taken[a : b - 1] for a, b in zip(begin, begin[1:])], node[begin[1:] - 1] % 4


def _faults(role: str, text: str) -> tuple[int, bool, bool]:
    """Code of the role, whether the text is blank, whether it is cut off."""
    shown = text.rstrip(SPACE)
    return CODES.get(role[:1], 0), not shown, bool(shown) and shown[-1] not in ENDS


def _digest(conv: int | None, role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{conv}\0{role}\0{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _lines(audit: str, rows: list[tuple[str, str]], state: int = 0) -> tuple[list[tuple[str, str]], int]:
    """Role and text of the repaired rows, and the state after them."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            state = int(MADE[state])
            out.append((NAMES[state], ""))
            continue
        role, text = rows[at]
        at += 1
        if letter == "K":
            state = int(AFTER[CODES[role[:1]], state])
            out.append((role, text))
        elif letter == "R":
            state = int(MADE[state])
            out.append((NAMES[state], text))
    return out, state


class _Counts:
    """Turns, faults and illegal neighbours of the rows of a conversation in order; parts can be added up."""

    def __init__(self) -> None:
        self.turn_min = self.turn_max = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first_code = self.last_code = None

    def add(self, turn_min, turn_max, turns, blank, duplicate, truncated, illegal, first_code, last_code) -> None:
        if turn_min is not None:
            self.turns += turns - (turn_min == self.turn_max)
            self.turn_min, self.turn_max = turn_min if self.turn_min is None else self.turn_min, turn_max
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if first_code is not None:
            self.illegal += illegal + (self.last_code is not None and (self.last_code, first_code) not in LEGAL)
            self.first_code, self.last_code = first_code if self.first_code is None else self.first_code, last_code

    def row(self, turn, code: int, blank: bool, duplicate: bool, truncated: bool) -> None:
        self.add(turn, turn, 1, blank, duplicate, truncated, 0, code, code)

    def part(self) -> dict:
        return dict(zip(_names(COUNTS), [self.turn_min, self.turn_max, self.turns, self.blank, self.duplicate, self.truncated, self.illegal, self.first_code, self.last_code]))

    def result(self) -> dict:
        gaps = 0 if self.turn_min is None else self.turn_max - self.turn_min + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}


def _arrow(schema: str) -> pa.Schema:
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _arrow(schema))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _closed(conversations: list[list[tuple]], as_rows: bool) -> Iterator[dict]:
    """Results of whole conversations (rows of conversation, turn, role, text, dropped)."""
    code, forced, cut, counts, first = [], [], [], [], [0]
    for rows in conversations:
        seen, own = set(), _Counts()
        for _, turn, role, text, dropped in rows:
            if dropped:
                continue
            c, blank, short = _faults(role, text)
            again = not blank and (role, text) in seen
            seen.add((role, text))
            own.row(turn, c, blank, again, short and not again)
            code.append(c)
            forced.append(blank or again)
            cut.append(short and not again)
        counts.append(own)
        first.append(len(code))
    n = len(conversations)
    cost, audits, _ = least_repairs(np.array(first), np.array(code, int), np.array(forced, bool), np.array(cut, bool), np.tile(FINAL, (n, 1)), np.ones(n, bool), np.zeros(n, int))
    for rows, own, paid, audit in zip(conversations, counts, cost.tolist(), audits):
        lines, _ = _lines(audit, [r[2:4] for r in rows if not r[4]])
        if as_rows:
            yield from ({"conv": rows[0][0], "open": False, "idx": k, "role": role, "text": text} for k, (role, text) in enumerate(lines))
        else:
            sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode("utf-8", "surrogatepass")).hexdigest()
            yield {"conv": rows[0][0], "open": False, **own.result(), "cost": paid, "audit": audit, "repaired_sha256": sha}


def _first_pass(as_rows: bool):
    """Sorted rows of a partition: conversations that end inside it and fit are repaired, rows of the others go on.

    The first and the last conversation of a partition may go on in others, and one of over `HELD_CHARS` is not held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, idx, chars = TaskContext.get().partitionId(), 0, 0
        opened, held, whole, n_whole = True, [], [], 0
        out: list[dict] = []

        def pass_on() -> None:
            nonlocal idx
            for conv, turn, role, text, dropped in held:
                code, empty, cut = _faults(role, text)
                out.append({
                    "conv": conv, "part": part, "idx": idx, "turn": turn, "role": role, "text": text, "dropped": dropped, "code": code, "empty": empty, "cut": cut,
                    "digest": _digest(conv, role, text), "open": True,
                })
                idx += 1
            held.clear()

        known = ()
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if known and known != (row[0],):
                    if opened:
                        pass_on()
                    else:
                        whole.append([*held])
                        n_whole += len(held)
                        held.clear()
                    opened, chars = False, 0
                known = (row[0],)
                held.append(row)
                chars += len(row[3]) + 64
                if chars > HELD_CHARS:
                    opened, chars = True, 0
                if opened and (chars == 0 or len(held) >= GATHERED):
                    pass_on()
                if n_whole >= GATHERED:
                    out += _closed(whole, as_rows)
                    whole, n_whole = [], 0
                if len(out) >= GATHERED:
                    yield _batch(out, PASSED)
                    out.clear()
        pass_on()
        yield _batch([*out, *_closed(whole, as_rows)], PASSED)

    return run


class _Fragment:
    """The rows of a fragment that are not dropped, in order, once for every state before it."""

    def __init__(self, table: pa.Table) -> None:
        rows = table.sort_by("idx").to_pylist()
        late = {r["idx"] for r in rows if r["late"]}
        mark = next((r for r in rows if r["tail"] is not None), {"tail": [NEVER] * 4, "cut": False})
        own = [r for r in rows if r["code"] is not None]
        self.key = {"conv": rows[0]["conv"], "part": rows[0]["part"]}
        self.turns = [r["turn"] for r in own]
        self.code = np.array([r["code"] for r in own], int)
        self.empty = np.array([r["empty"] for r in own], bool)
        self.again = np.array([r["idx"] in late for r in own], bool)
        self.cut = np.array([r["cut"] for r in own], bool) & ~self.again
        self.tail, self.last = np.array(mark["tail"]), mark["cut"]

    def fourfold(self) -> tuple[np.ndarray, ...]:
        return np.arange(5) * len(self.code), np.tile(self.code, 4), np.tile(self.empty | self.again, 4), np.tile(self.cut, 4)


def _measure(table: pa.Table) -> pa.Table:
    """Least cost of a fragment from each state before it to each state after it."""
    own = _Fragment(table)
    cost = cost_to_go(*own.fourfold(), np.where(np.eye(4, dtype=bool), 0, NEVER))
    matrix = cost[np.arange(4) * (len(own.code) + 1)].T
    return pa.Table.from_batches([_batch([{**own.key, "matrix": matrix.ravel().tolist()}], MEASURED)])


def _tails(table: pa.Table) -> pa.Table:
    """Cost that follows every fragment of a conversation, by state: min-plus products from the last one (`cut`) back.

    A conversation has one fragment for each partition of the global order at most.
    """
    tail, out = FINAL, []
    for r in reversed(table.sort_by("part").to_pylist()):
        out.append({"conv": r["conv"], "part": r["part"], "tail": tail.tolist(), "cut": not out})
        tail = np.minimum((np.array(r["matrix"]).reshape(4, 4) + tail).min(1), NEVER)
    return pa.Table.from_batches([_batch(out, TAILED)])


def _walks(table: pa.Table) -> pa.Table:
    """Counts of a fragment and, for every state before it, its least audit, the state after it and the cost to the end."""
    own, counts = _Fragment(table), _Counts()
    for k, turn in enumerate(own.turns):
        counts.row(turn, int(own.code[k]), bool(own.empty[k]), bool(own.again[k]), bool(own.cut[k]))
    paid, audits, after = least_repairs(*own.fourfold(), np.tile(own.tail, (4, 1)), np.full(4, own.last), np.arange(4))
    return pa.Table.from_batches([_batch([{**own.key, **counts.part(), "audits": audits, "after": after.tolist(), "paid": paid.tolist()}], WALKED)])


class _Open:
    """An open conversation whose fragments (counts and audits, then rows) stream by."""

    def __init__(self, conv: int | None, as_rows: bool) -> None:
        self.conv, self.as_rows, self.n, self.state, self.following, self.cost = conv, as_rows, 0, 0, 0, None
        self.counts, self.sha, self.audits, self.at = _Counts(), hashlib.sha256(), [""], 0

    def fragment(self, r: dict) -> None:
        self.counts.add(*(r[c] for c in _names(COUNTS)))
        self.state, self.at = self.following, 0
        self.cost = r["paid"][self.state] if self.cost is None else self.cost
        self.audits.append(r["audits"][self.state])
        self.following = r["after"][self.state]

    def lines(self, row: tuple[str, str] | None) -> Iterator[dict]:
        """Repaired rows up to `row`, or to the end."""
        audit, end = self.audits[-1], self.at
        while end < len(audit) and audit[end] == "I":
            end += 1
        end += row is not None
        made, self.state = _lines(audit[self.at : end], [row], self.state)
        self.at = end
        for role, text in made:
            if self.as_rows:
                yield {"conv": self.conv, "idx": self.n, "role": role, "text": text}
            else:
                self.sha.update(f"{chr(10) if self.n else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.n += 1

    def end(self) -> Iterator[dict]:
        yield from self.lines(None)
        if not self.as_rows:
            yield {"conv": self.conv, **self.counts.result(), "cost": self.cost, "audit": "".join(self.audits), "repaired_sha256": self.sha.hexdigest()}


def _joined(as_rows: bool):
    """Open conversations from rows in order, a fragment's audits before its rows.

    SHA-256 is sequential, so a conversation's text passes one task, a row at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        at: _Open | None = None
        for batch in batches:
            for r in batch.to_pylist():
                if at is None or at.conv != r["conv"]:
                    out += at.end() if at else []
                    at = _Open(r["conv"], as_rows)
                if r["audits"] is not None:
                    at.fragment(r)
                elif not r["dropped"]:
                    out += at.lines((r["role"], r["text"]))
                if len(out) >= GATHERED:
                    yield _batch(out, STREAMED)
                    out.clear()
        yield _batch([*out, *(at.end() if at else [])], STREAMED)

    return run


def _repaired(rows: DataFrame, as_rows: bool) -> DataFrame:
    parts = work_partitions(rows.sparkSession)
    conv, turn = F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()
    ordered = (
        rows.select("conv_id", "turn", "role", "text", "dropped")
        .repartitionByRange(parts, conv, turn, "role", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions(conv, turn, "role", "text")
    )
    passed, _ = materialize(ordered.mapInArrow(_first_pass(as_rows), PASSED))
    going = passed.where("open")
    place = F.struct("part", "idx")
    firsts = going.where("NOT dropped AND NOT empty").groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = going.where("NOT dropped AND NOT empty").join(firsts, "digest").where(place > F.col("first")).select("conv", "part", "idx", F.lit(True).alias("late"))
    own = going.select("conv", "part", "idx", "turn", F.when(~F.col("dropped"), F.col("code")).alias("code"), "empty", "cut", F.lit(False).alias("late"), F.lit(None).cast("array<bigint>").alias("tail"))
    narrow, _ = materialize(own.unionByName(late, allowMissingColumns=True))
    measured = narrow.groupBy("conv", "part").applyInArrow(_measure, MEASURED)
    tails, _ = materialize(measured.groupBy("conv").applyInArrow(_tails, TAILED))
    walks = narrow.unionByName(tails, allowMissingColumns=True).groupBy("conv", "part").applyInArrow(_walks, WALKED)
    stream = going.select("conv", "part", "idx", "role", "text", "dropped").unionByName(walks.withColumn("idx", F.lit(-1).cast("long")), allowMissingColumns=True)
    joined = stream.repartition(parts, "conv").sortWithinPartitions("conv", "part", "idx").mapInArrow(_joined(as_rows), STREAMED)
    return passed.where("NOT open").select(*_names(STREAMED)).unionByName(joined).withColumnRenamed("conv", "conv_id")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of `rows`.

    `rows`: conv_id, turn, role, text (neither null) and dropped; a dropped row only names its conversation. Rows go by
    turn (nulls first), then role and text. A row's first fault counts: blank, duplicate (role and text seen earlier),
    truncated. Edits: keep (0), rerole (2), delete (3, a must for blank and duplicate rows), insert an empty row (2); a
    truncated row that stays adds 1. The audit has the edits' initials of the cheapest way to a legal order, the least in
    ASCII order among equals; the digest is that of the repaired rows `role:text`, joined by newlines.

    Null conversation ids are one conversation. Equal rows are duplicates. A conversation without rows has zeros, an empty
    audit and the digest of nothing. Extra columns are ignored; an empty table gives no rows.
    """
    return _repaired(rows, False).select("conv_id", *_names(RESULT))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of all repaired conversations of `rows` (as for `repair`)."""
    return _repaired(rows, True).select("conv_id", F.col("idx").alias("place"), "role", "text")
