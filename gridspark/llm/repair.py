"""Repair of conversations' structure by the cheapest edits, found by a bidirectional Dijkstra search of the edit lattice.

A node of the lattice is (turns read, state of the roles so far); edges keep, rerole, delete or insert a turn.  A forward
heap from the beginning and a reverse heap from the allowed ends meet; all crossings of least cost are finished, and the
least concatenated audit of them is taken.

A conversation of up to ``most`` turns is repaired in one go by the task that holds it.  Longer ones are cut: turns are
put in order over all tasks, each stretch of one conversation becomes a table from state to state, and these tables are
composed in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import materialize

MOST = 2048  # turns repaired in one go
BLOCK = 256  # turns searched at once

#: The states are: nothing yet (0), after a system turn (1), after a user turn (2), after an assistant turn (3).
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
ENDS = (0, 3)
#: What edits cost, and what a truncated turn adds unless it is deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
_BLANK, _CUT = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\Z")

Path = tuple[int, str]


def turned(state: int) -> int:
    """The state after the one role that may follow, be it reroled or inserted."""
    return 3 if state == 2 else 2


def _edits(sign: str) -> list[tuple[str, int, int, int]]:
    """(edit, cost, state before, state after) of one turn.  d: must go; s, u, a, x: its role; a capital: truncated."""
    out = [("D", DELETE, q, q) for q in range(4)]
    if sign != "d":
        more = TRUNCATED if sign.isupper() else 0
        out += [("K", KEEP + more, q, n) for (q, r), n in NEXT.items() if r == sign.lower()]
        out += [("R", REROLE + more, q, turned(q)) for q in range(4)]
    return out


INSERTS = [("I", INSERT, q, turned(q)) for q in range(4)]
#: Edits by a turn's letter and the state before (FORWARD) or after (BACKWARD); insertions by the state before or after.
FORWARD, BACKWARD = ({c: [[e for e in _edits(c) if e[k] == q] for q in range(4)] for c in "dsuaxSUAX"} for k in (2, 3))
INSERT_FROM, INSERT_TO = ([[e for e in INSERTS if e[k] == q] for q in range(4)] for k in (2, 3))


def search(shape: str, start: int = 0, ends: tuple[int, ...] = ENDS) -> Path | None:
    """(cost, audit) of the cheapest edits from ``start`` to one of ``ends``, the ASCII-least of equal ones; None if there are none.

    Paths of one cost to one node are never the beginnings of one another, as only insertions go on without reading a
    turn, and they cost; so the least audit through a node is the least before it and the least after it.
    """
    n = len(shape)
    ahead: dict[tuple[int, int], Path] = {(0, start): (0, "")}
    back: dict[tuple[int, int], Path] = {(n, q): (0, "") for q in ends}
    # forward labels leave the heap in the order of (cost, audit); reverse ones by cost, the later turns first, so that all
    # labels of one cost have reached a node before it goes on
    heap, rear = [(0, "", 0, start)], [(0, -n, q) for q in ends]
    settled: tuple[set, set] = (set(), set())
    best = 0 if n == 0 and start in ends else None

    def forward(i: int, q: int) -> list[tuple[tuple, tuple[int, int]]]:
        return [*[(e, (i + 1, e[3])) for e in (FORWARD[shape[i]][q] if i < n else ())], *[(e, (i, e[3])) for e in INSERT_FROM[q]]]

    def backward(i: int, q: int) -> list[tuple[tuple, tuple[int, int]]]:
        return [*[(e, (i - 1, e[2])) for e in (BACKWARD[shape[i - 1]][q] if i else ())], *[(e, (i, e[2])) for e in INSERT_TO[q]]]

    while heap and rear and (best is None or heap[0][0] + rear[0][0] <= best):
        if heap[0][0] <= rear[0][0]:
            cost, audit, i, q = heappop(heap)
            if (i, q) in settled[0]:
                continue
            settled[0].add((i, q))
            for (edit, c, _, _), node in forward(i, q):
                path = cost + c, audit + edit
                if node not in ahead or path < ahead[node]:
                    ahead[node] = path
                    heappush(heap, (*path, *node))
                if node in back and (best is None or path[0] + back[node][0] < best):
                    best = path[0] + back[node][0]
        else:
            cost, i, q = heappop(rear)
            i = -i
            if (i, q) in settled[1]:
                continue
            settled[1].add((i, q))
            for (edit, c, _, _), node in backward(i, q):
                path = cost + c, edit + back[i, q][1]
                if node not in back or path[0] < back[node][0]:
                    heappush(rear, (path[0], -node[0], node[1]))
                if node not in back or path < back[node]:
                    back[node] = path
                if node in ahead and (best is None or path[0] + ahead[node][0] < best):
                    best = path[0] + ahead[node][0]
    if best is None:
        return None
    # a cheapest path ends in a settled forward node, or has an edge from one to a settled reverse node
    found = [ahead[n, q][1] for q in ends if (n, q) in settled[0] and ahead[n, q][0] == best]
    for i, q in settled[0]:
        cost, audit = ahead[i, q]
        found += [audit + e[0] + back[v][1] for e, v in forward(i, q) if v in settled[1] and cost + e[1] + back[v][0] == best]
    return best, min(found)


_short = lru_cache(1 << 15)(search)


def _search(shape: str, start: int, ends: tuple[int, ...]) -> Path | None:
    return (_short if len(shape) <= 32 else search)(shape, start, ends)


def through(paths: dict[int, Path], shape: str) -> dict[int, Path]:
    """The best path to every state after a block of turns, from those to the states before it."""
    out: dict[int, Path] = {}
    for q, (cost, audit) in paths.items():
        for to in range(4):
            found = _search(shape, q, (to,))
            if found and (to not in out or (cost + found[0], audit + found[1]) < out[to]):
                out[to] = cost + found[0], audit + found[1]
    return out


def cheapest(shape: str) -> Path:
    """(cost, audit) of a whole conversation, block by block."""
    if len(shape) <= BLOCK:
        return _search(shape, 0, ENDS)
    paths: dict[int, Path] = {0: (0, "")}
    for k in range(0, len(shape), BLOCK):
        paths = through(paths, shape[k : k + BLOCK])
    return min(paths[q] for q in ENDS if q in paths)


def sign(role: str, text: str, repeated: bool) -> str:
    """A turn as a letter of the lattice: see _edits."""
    if repeated or not _BLANK.search(text):
        return "d"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return kind.upper() if _CUT.search(text) else kind


class Turns:
    """What is counted over a conversation's turns in their order."""

    def __init__(self) -> None:
        self.low = self.high = self.last = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.previous = None
        self.rows = 0

    def add(self, turn: int | None, role: str, text: str, repeated: bool, times: int = 1) -> str:
        """Count a turn, and ``times - 1`` repeats of it, and give their letters."""
        if turn is not None:
            self.distinct += turn != self.last
            self.low, self.high, self.last = turn if self.low is None else self.low, turn, turn
        letter, again = sign(role, text, repeated), sign(role, text, True)
        blank = not _BLANK.search(text)
        self.blank += times * blank
        self.duplicate += 0 if blank else times - (not repeated)
        self.truncated += letter.isupper()
        kind = role[:1]
        self.illegal += self.rows > 0 and self.previous + kind not in LEGAL
        self.illegal += (times - 1) * (kind + kind not in LEGAL)
        self.first = kind if self.first is None else self.first
        self.previous, self.rows = kind, self.rows + times
        return letter + again * (times - 1)

    def join(self, other: dict) -> None:
        """Count on with the next stretch's sums."""
        if other["low"] is not None:
            self.distinct += other["distinct"] - (self.last is not None and self.last == other["low"])
            self.low, self.high = other["low"] if self.low is None else self.low, other["high"]
            self.last = other["high"]
        for k in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, k, getattr(self, k) + other[k])
        self.illegal += self.rows > 0 and self.previous + other["first"] not in LEGAL
        self.previous, self.rows = other["previous"], self.rows + other["n"]

    def counts(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"gaps": gaps, **{k: int(getattr(self, k)) for k in ("blank", "duplicate", "truncated", "illegal")}}


class Applied:
    """Turns as edits make them, in order: (edit, role, text) of each, deleted ones left out."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _next(self) -> str:
        self.state = turned(self.state)
        return "assistant" if self.state == 3 else "user"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._next(), ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield "R", self._next(), text
        elif edit == "K":
            self.state = NEXT[self.state, role[:1]]
            yield "K", role, text


class Digest:
    """SHA-256 of turns as role:text lines."""

    def __init__(self) -> None:
        self.sha, self.any = hashlib.sha256(), False

    def add(self, turns: Iterator[tuple[str, str, str]]) -> None:
        for _, role, text in turns:
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            yield from batch.slice(k, 1024).to_pylist()


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == 512:
            yield from pa.Table.from_pylist(held, schema).to_batches()
            held = []
    if held:
        yield from pa.Table.from_pylist(held, schema).to_batches()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
TURNS = "position long, edit string, role string, text string"
_ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _schema(key: pa.DataType, ddl: str) -> pa.Schema:
    return pa.schema([("_id", key), *[(n, _ARROW[k]) for n, k in (f.split() for f in ddl.split(", "))]])


def _repair(rows: list[dict]) -> tuple[dict, Iterator[tuple[str, str, str]]]:
    """A whole conversation's report and its repaired turns."""
    turns, seen, shape = Turns(), set(), []
    for r in rows:
        key = r["role"], r["text"]
        shape.append(turns.add(r["turn"], *key, key in seen))
        seen.add(key)
    cost, audit = cheapest("".join(shape))

    def repaired() -> Iterator[tuple[str, str, str]]:
        edits = Applied(audit)
        for r in rows:
            yield from edits.turn(r["role"], r["text"])
        yield from edits.inserted()

    return {**turns.counts(), "cost": cost, "audit": audit}, repaired()


def _short_report(rows: list[dict]) -> Iterator[dict]:
    report, turns = _repair([r for r in rows if r["there"]])
    digest = Digest()
    digest.add(turns)
    yield {"_id": rows[0]["_id"], **report, "repaired_sha256": digest.sha.hexdigest()}


def _short_turns(rows: list[dict]) -> Iterator[dict]:
    _, turns = _repair([r for r in rows if r["there"]])
    for k, (edit, role, text) in enumerate(turns):
        yield {"_id": rows[0]["_id"], "position": k, "edit": edit, "role": role, "text": text}


def _by_conversation(make: Callable[[list[dict]], Iterator[dict]], ddl: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = _schema(first.schema.field("_id").type, ddl)
        rows = (r for b in ([first], batches) for r in _rows(iter(b)))
        yield from _batches((out for _, g in groupby(rows, key=lambda r: r["_id"]) for out in make(list(g))), schema)

    return run


_STRETCH = "piece long, low long, high long, distinct long, blank long, duplicate long, truncated long, illegal long, n long, first string, previous string, table string"


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per stretch of up to MOST turns of one conversation its sums and, as text, the best path from every state to every state."""
    piece = TaskContext.get().partitionId() << 32
    first = next(batches, None)
    if first is None:
        return
    schema = _schema(first.schema.field("_id").type, _STRETCH)

    def made() -> Iterator[dict]:
        nonlocal piece
        rows = (r for b in ([first], batches) for r in _rows(iter(b)))
        for key, group in groupby(rows, key=lambda r: r["_id"]):
            turns, shape = Turns(), []
            size = 0

            def done():
                table = []
                for q in range(4):
                    paths: dict[int, Path] = {q: (0, "")}
                    text = "".join(shape)
                    for k in range(0, len(text), BLOCK):
                        paths = through(paths, text[k : k + BLOCK])
                    table += [f"{q}{to}{cost}:{audit}" for to, (cost, audit) in paths.items()]
                return {"_id": key, "piece": piece, "low": turns.low, "high": turns.high, "distinct": turns.distinct, **{k: int(getattr(turns, k)) for k in ("blank", "duplicate", "truncated", "illegal")}, "n": turns.rows, "first": turns.first, "previous": turns.previous, "table": " ".join(table)}

            for r in group:
                letters = turns.add(r["turn"], r["role"], r["text"], r["repeated"], r["times"])
                shape.append(letters)
                size += len(letters)
                if size >= MOST:
                    yield done()
                    piece, turns, shape, size = piece + 1, Turns(), [], 0
            if size:
                yield done()
                piece += 1

    yield from _batches(made(), schema)


def _composed(rows: Iterator[dict]) -> Iterator[dict]:
    """A conversation's report from its stretches in order; one stretch is held at a time."""
    turns, paths, key = Turns(), {0: (0, "")}, None
    for r in rows:
        key = r["_id"]
        turns.join(r)
        after: dict[int, Path] = {}
        for entry in r["table"].split(" "):
            q, to, (cost, audit) = int(entry[0]), int(entry[1]), entry[2:].split(":")
            if q in paths:
                path = paths[q][0] + int(cost), paths[q][1] + audit
                if to not in after or path < after[to]:
                    after[to] = path
        paths = after
    cost, audit = min(paths[q] for q in ENDS if q in paths)
    yield {"_id": key, **turns.counts(), "cost": cost, "audit": audit}


def _streamed(make: Callable[[Iterator[dict]], Iterator[dict]], ddl: str):
    """Like _by_conversation, but a conversation's rows are not held together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = _schema(first.schema.field("_id").type, ddl)
        rows = (r for b in ([first], batches) for r in _rows(iter(b)))
        yield from _batches((out for _, g in groupby(rows, key=lambda r: r["_id"]) for out in make(g)), schema)

    return run


def _edited(rows: Iterator[dict]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    edits, last = None, None
    for r in rows:
        last = r
        if r["audit"] is not None:
            edits = Applied(r["audit"])
            continue
        for _ in range(r["times"]):
            yield r, edits.turn(r["role"], r["text"])
    if edits:
        yield last, edits.inserted()


def _long_digest(rows: Iterator[dict]) -> Iterator[dict]:
    digest, key = Digest(), None
    for r, turns in _edited(rows):
        key = r["_id"]
        digest.add(turns)
    yield {"_id": key, "repaired_sha256": digest.sha.hexdigest()}


def _long_turns(rows: Iterator[dict]) -> Iterator[dict]:
    k = 0
    for r, turns in _edited(rows):
        for edit, role, text in turns:
            yield {"_id": r["_id"], "position": k, "edit": edit, "role": role, "text": text}
            k += 1


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _split(turns: DataFrame, conv_col: str, present_col: str | None, most: int) -> tuple[DataFrame, DataFrame, str]:
    """(turns of conversations of up to ``most`` turns, those of longer ones, the id's type)."""
    there = F.col(f"`{present_col}`") if present_col else F.lit(True)
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = turns.select(F.col(f"`{conv_col}`").alias("_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.coalesce(there, F.lit(False)).alias("there"))
    sizes = materialize(own.groupBy("_id").count().filter(F.col("count") > most).select(F.col("_id").alias("_long")), "long")
    same = own["_id"].eqNullSafe(sizes["_long"])
    return own.join(sizes, same, "left_anti"), own.filter("there").join(sizes, same, "left_semi").drop("there"), dict(own.dtypes)["_id"]


def _long_rows(long: DataFrame) -> DataFrame:
    """Equal turns once, with their number, and whether their role and text stand in an earlier turn."""
    once = long.groupBy("_id", "turn", "role", "text").agg(F.count("*").alias("times")).withColumn("digest", F.sha2("text", 256))
    first = once.groupBy("_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"))
    first = first.select(F.col("_id").alias("_i"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.col("first.turn").alias("_first"))
    both = once.join(first, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    again = ~F.col("turn").eqNullSafe(F.col("_first"))
    return materialize(both.select("_id", "turn", "role", "text", F.substring("text", 1, 256).alias("head"), again.alias("repeated"), F.col("times").cast("long").alias("times")), "turns")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _long_reports(rows: DataFrame, kind: str) -> DataFrame:
    spread = rows.repartitionByRange(_parts(rows), "_id", "turn", "role", "head").sortWithinPartitions("_id", *_order()).drop("head")
    pieces = materialize(spread.mapInArrow(_stretches, f"_id {kind}, {_STRETCH}"), "stretches")
    return materialize(pieces.repartition(_parts(rows), "_id").sortWithinPartitions("_id", "piece").mapInArrow(_streamed(_composed, REPORT), f"_id {kind}, {REPORT}"), "reports")


def _long_edits(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """Each conversation's audit, then its turns in order, in one partition."""
    columns = ["turn", "role", "text", "times"]
    audit = reports.select("_id", F.lit(0).alias("part"), *[F.lit(None).cast(k).alias(c) for c, k in rows.select(columns).dtypes], "audit")
    both = audit.unionByName(rows.select("_id", F.lit(1).alias("part"), *columns, F.lit(None).cast("string").alias("audit")))
    return both.repartition(_parts(rows), "_id").sortWithinPartitions("_id", "part", *_order())


def repair(turns: DataFrame, conv_col: str = "conv_id", present_col: str | None = None, most: int = MOST) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each conversation.

    turns: (conv_id, turn, role, text, ...).  A conversation's turns are taken by turn (nulls first), then role, then text;
    null roles and texts count as one space.  A null conv_id is a conversation.  Rows whose ``present_col`` is false are not
    there, but their conversation is reported; without turns it has zeros, an empty audit and the empty string's digest.
    Repeats of a role and text are duplicates wherever they stand.  Other columns don't matter; an empty table gives an
    empty one.  The digest of a conversation above ``most`` turns streams through one task, as SHA-256 takes bytes in order.
    """
    short, long, kind = _split(turns, conv_col, present_col, most)
    report = REPORT + ", repaired_sha256 string"
    sent = short.repartition(_parts(turns), "_id").sortWithinPartitions("_id", *_order())
    out = sent.mapInArrow(_by_conversation(_short_report, report), f"_id {kind}, {report}")
    rows = _long_rows(long)
    found = _long_reports(rows, kind)
    digests = _long_edits(rows, found).mapInArrow(_streamed(_long_digest, "repaired_sha256 string"), f"_id {kind}, repaired_sha256 string").withColumnRenamed("_id", "_same")
    far = found.join(digests, F.col("_id").eqNullSafe(F.col("_same"))).drop("_same")
    return out.unionByName(far).withColumnRenamed("_id", conv_col)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", present_col: str | None = None, most: int = MOST) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired conversations' turns, position from 0; see repair.

    edit is K, R or I; deleted turns have no row, nor has a conversation without turns.
    """
    short, long, kind = _split(turns, conv_col, present_col, most)
    sent = short.repartition(_parts(turns), "_id").sortWithinPartitions("_id", *_order())
    out = sent.mapInArrow(_by_conversation(_short_turns, TURNS), f"_id {kind}, {TURNS}")
    rows = _long_rows(long)
    far = _long_edits(rows, _long_reports(rows, kind)).mapInArrow(_streamed(_long_turns, TURNS), f"_id {kind}, {TURNS}")
    return out.unionByName(far).withColumnRenamed("_id", conv_col)


def damage(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults planted by crc32(conv_id:turn) % 20, and present.

    0 takes a turn away (present is false), 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's.
    Nulls count as one space.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text(conv_col), F.lit(":"), text("turn"))) % 20
    own = conversations.select(F.col(f"`{conv_col}`"), "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    own = own.withColumns({"text": F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))})
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return own.withColumn("_copy", F.explode(times)).select(F.col(f"`{conv_col}`"), "turn", "role", "text", (F.col("fault") != 0).alias("present"))
