"""Operator 12: repair of conversations by the cheapest edits that make their roles ``(s?(ua)+)?``.

The rows of a conversation and the four states of that pattern (nothing yet, after the system turn, after a user turn, after
an assistant turn) span a lattice: Keep, Rerole and Delete go to the next row, Insert to another state at the same row.
``cheapest`` searches it with Dijkstra from both ends: the heap with the smaller top goes on, until the tops together
exceed the best meeting; then every edge that joins a settled forward node to a settled reverse node at the best cost is a
crossing, and the least concatenated audit wins.  Of equal cost, no audit between two nodes starts another, so a node's least
audit is always part of the whole's least audit, which also lets long conversations be cut:

* equal rows of a conversation are counted before the first shuffle, and all but the first are forced deletes of one lattice edge;
* the counted rows, without their texts, are sorted over ranges of (conversation, turn), so a long conversation lies in several
  tasks; a conversation that may cross a border, or that is longer than ``piece_items``, gives a table of best (cost,
  audit) from every state to every state per piece, and the pieces of one conversation are folded in order;
* the repaired text is hashed from the rows in order, one at a time.  sha256 has no parallel form, so the texts of one
  conversation stream through one task; nothing of them is held but the row at hand.

Defined results: a null role, text, turn or id reads as one space where it is text; rows with a null ``conv_id`` are one conversation;
rows of one turn are ordered by role, then the first 64 characters, then sha256 of the text; equal rows are repeats (duplicates) also
within a turn; an empty role has no initial, which no pattern allows; very long texts are hashed whole; extra columns are left out; a
conversation without rows has zeros, an empty audit and the hash of nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
STATES = 4                                   # nothing yet, after system, after user, after assistant
ACCEPTED = (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}        # the role that Rerole and Insert can add, and its state
ROLE = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
SPACES = " \t\n\x0b\x0c\r"

#: A lattice item: (initial, truncated) of a row that may stay, or a count of forced deletes.
Item = tuple[str, bool] | int
Label = tuple[int, str]


def _ahead(items: tuple[Item, ...], i: int, s: int) -> Iterator[tuple[int, int, int, str]]:
    """Edges (item, state, cost, letters) that leave a node."""
    role, after = NEXT[s]
    yield i, after, INSERT, "I"
    if i == len(items):
        return
    item = items[i]
    if isinstance(item, int):
        yield i + 1, s, DELETE * item, "D" * item
        return
    initial, truncated = item
    extra = TRUNCATED * truncated
    yield i + 1, s, DELETE, "D"
    yield i + 1, after, REROLE + extra, "R"
    if (s, initial) in STEP:
        yield i + 1, STEP[s, initial], KEEP + extra, "K"


@lru_cache(maxsize=2)
def _edges(items: tuple[Item, ...]) -> tuple[dict, dict]:
    """Edges of the lattice by their first and by their last node."""
    out: dict = {}
    into: dict = {}
    for i in range(len(items) + 1):
        for s in range(STATES):
            for j, t, cost, letters in _ahead(items, i, s):
                out.setdefault((i, s), []).append((j, t, cost, letters))
                into.setdefault((j, t), []).append((i, s, cost, letters))
    return out, into


class _Side:
    """One direction of the search.  Nodes settle by (cost, way gone): edges that cost nothing always go on by one item, so
    a node's least audit is known when it settles."""

    def __init__(self, sources: list[tuple[int, int]], edges: dict, sign: int):
        self.edges, self.sign, self.sources = edges, sign, sources
        self.labels: dict[tuple[int, int], Label] = {node: (0, "") for node in sources}
        self.settled: dict[tuple[int, int], Label] = {}
        self.heap = [(0, sign * i, s) for i, s in sources]
        heapq.heapify(self.heap)

    def known(self) -> dict[tuple[int, int], Label]:
        """Nodes whose label is final."""
        return {node: (0, "") for node in self.sources} | self.settled

    def top(self) -> int | None:
        while self.heap and (abs(self.heap[0][1]), self.heap[0][2]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self, other: "_Side", best: int | None) -> int | None:
        _, way, s = heapq.heappop(self.heap)
        node = (abs(way), s)
        cost, audit = self.settled[node] = self.labels[node]
        for i, t, price, letters in self.edges.get(node, ()):
            to = (i, t)
            if to in self.settled:
                continue
            made = (cost + price, audit + letters if self.sign > 0 else letters + audit)
            if to not in self.labels or made < self.labels[to]:
                self.labels[to] = made
                heapq.heappush(self.heap, (made[0], self.sign * i, t))
            if to in other.labels and (best is None or made[0] + other.labels[to][0] < best):
                best = made[0] + other.labels[to][0]
        return best


def cheapest(items: tuple[Item, ...], start: int, ends: tuple[int, ...]) -> Label | None:
    """(cost, ASCII-least audit) of the cheapest edits from ``start`` before the items to one of ``ends`` behind them."""
    out, into = _edges(items)
    forward = _Side([(0, start)], out, 1)
    reverse = _Side([(len(items), s) for s in ends], into, -1)
    best = 0 if (0, start) in reverse.labels else None
    while True:
        ahead, back = forward.top(), reverse.top()
        if ahead is None and back is None or best is not None and (ahead is None or back is None or ahead + back > best):
            break
        if back is None or ahead is not None and ahead <= back:
            best = forward.settle(reverse, best)
        else:
            best = reverse.settle(forward, best)
    if best is None:
        return None
    begun, ended = forward.known(), reverse.known()
    audits = [audit + ended[n][1] for n, (cost, audit) in begun.items() if n in ended and cost + ended[n][0] == best]
    for node, (cost, audit) in begun.items():                          # crossings
        for i, t, price, letters in out.get(node, ()):
            if (i, t) in ended and cost + price + ended[i, t][0] == best:
                audits.append(audit + letters + ended[i, t][1])
    return best, min(audits)


#: Most conversations are short and share their pattern with others; a short one is searched once per worker.
SHORT = 16


@lru_cache(maxsize=16384)
def _cheapest_short(items: tuple[Item, ...], start: int, ends: tuple[int, ...]) -> Label | None:
    return cheapest(items, start, ends)


def ways(items: tuple[Item, ...]) -> list[tuple[int, int, int, str]]:
    """(start, end, cost, audit) from every state to every state."""
    found = ((s, t, cheapest(items, s, (t,))) for s in range(STATES) for t in range(STATES))
    return [(s, t, *way) for s, t, way in found if way is not None]


@dataclass
class Piece:
    """What one run of sorted rows of a conversation adds; pieces join in order."""

    first: str = ""                          # initials at both ends
    last: str = ""
    rows: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    low: int | None = None                   # turns
    high: int | None = None
    turns: int = 0                           # distinct, nulls apart
    items: list[Item] = field(default_factory=list)

    def add(self, turn: int | None, initial: str, live: int, forced: int, blank: int, truncated: bool) -> None:
        n = live + forced
        self.illegal += n - 1 + (self.rows > 0 and self.last + initial not in LEGAL)
        if self.rows == 0:
            self.first = initial
        self.last, self.rows = initial, self.rows + n
        self.blank += blank
        self.duplicate += forced - blank
        self.truncated += live and truncated
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if live:
            self.items.append((initial, truncated))
        if forced and self.items and isinstance(self.items[-1], int):
            self.items[-1] += forced
        elif forced:
            self.items.append(forced)

    def join(self, after: "Piece") -> None:
        if self.rows and after.rows:
            self.illegal += self.last + after.first not in LEGAL
        self.first = self.first if self.rows else after.first
        self.last = after.last if after.rows else self.last
        for name in ("rows", "blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(after, name))
        self.turns += after.turns - (after.low is not None and after.low == self.high)
        self.low = after.low if self.low is None else self.low
        self.high = after.high if after.high is not None else self.high

    def counts(self) -> list:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def fold(labels: dict[int, Label], table: list[tuple[int, int, int, str]]) -> dict[int, Label]:
    """Best (cost, audit) per state behind a piece from those before it."""
    out: dict[int, Label] = {}
    for s, t, cost, audit in table:
        if s in labels:
            made = (labels[s][0] + cost, labels[s][1] + audit)
            if t not in out or made < out[t]:
                out[t] = made
    return out


def repaired(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The lines ``role:text`` that the audit makes of the rows."""
    state, rows = 0, iter(rows)
    for letter in audit:
        row = next(rows) if letter != "I" else None
        if letter == "D":
            continue
        if letter == "K":
            state = STEP[state, row[0][:1]]
            yield f"{row[0]}:{row[1]}"
        else:
            role, state = NEXT[state]
            yield f"{ROLE[role]}:{row[1] if row else ''}"


# ---------------------------------------------------------------- Spark

ROWS = ["conv_id", "turn", "role", "text"]
ORDER = ["conv_id", "turn", "role", "head", "digest"]
PIECES = ("conv_id long, whole boolean, turn long, role string, head string, digest string, first string, last string, rows long, "
          "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long, cost long, audit string, "
          "ways array<struct<s:int,t:int,cost:long,audit:string>>")
FOLDED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def readable(rows: DataFrame) -> DataFrame:
    """The four columns; a null role or text is one space."""
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows after a damage drawn by (conversation, turn): dropped, emptied, unpunctuated, repeated or given to the user."""
    space = F.lit(" ")
    draw = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (readable(rows).withColumn("draw", draw).where("draw <> 0")
            .select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy"))


def _named(rows: DataFrame) -> DataFrame:
    """Rows with what orders and names them beside their text."""
    return rows.withColumn("head", F.substring("text", 1, 64)).withColumn("digest", F.sha2("text", 256))


def _counted(rows: DataFrame) -> DataFrame:
    """Equal rows as one, without the text: (order columns, initial, live, forced, blank, truncated)."""
    inked = F.rtrim("text", F.lit(SPACES))
    named = _named(rows).withColumn("is_blank", inked == "").withColumn("open", ~F.substring(inked, -1, 1).isin(".", "!", "?"))
    counted = named.groupBy(*ORDER).agg(F.count("*").alias("n"), F.first("is_blank").alias("is_blank"), F.first("open").alias("open"))
    when = F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn").alias("turn"))
    first = counted.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(when).alias("seen"))
    joined = counted.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")))
    new = F.col("turn").eqNullSafe(F.col("seen.turn"))
    live = (new & ~F.col("is_blank")).cast("long")
    return joined.select(*ORDER, F.substring("role", 1, 1).alias("initial"), live.alias("live"), (F.col("n") - live).alias("forced"),
                         F.when(F.col("is_blank"), F.col("n")).otherwise(0).alias("blank"), "open")


def _pieces(piece_items: int):
    names = [f.split()[0] for f in PIECES.split(", ")[:-1]] + ["ways"]
    schema = pa.schema([("conv_id", pa.int64()), ("whole", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("head", pa.string()),
                        ("digest", pa.string()), ("first", pa.string()), ("last", pa.string()),
                        *((n, pa.int64()) for n in names[8:17]), ("audit", pa.string()),
                        ("ways", pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])

    def closed(key: tuple, piece: Piece, whole: bool) -> dict:
        items = tuple(piece.items)
        search = _cheapest_short if len(items) <= SHORT else cheapest
        found = search(items, 0, ACCEPTED) if whole else (None, None)
        table = [] if whole else [dict(zip(("s", "t", "cost", "audit"), way)) for way in ways(items)]
        values = (key[0], whole, *key[1:], piece.first, piece.last, piece.rows, piece.blank, piece.duplicate, piece.truncated,
                  piece.illegal, piece.low, piece.high, piece.turns, *found, table)
        return dict(zip(names, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size = 0
        piece, key, crosses = Piece(), None, True         # the first conversation of a task may have begun in another
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in [*ORDER, "initial", "live", "forced", "blank", "open"])):
                if key is not None and (row[0] != key[0] or len(piece.items) >= piece_items):
                    same = row[0] == key[0]
                    out.append(closed(key, piece, not (crosses or same)))
                    crosses, key, piece = same, None, Piece()
                    size += 64 + sum(len(w["audit"]) for w in out[-1]["ways"])
                    if len(out) >= 4096 or size > 2 ** 22:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
                if key is None:
                    key = row[:5]
                piece.add(row[1], *row[5:])
        if key is not None:
            out.append(closed(key, piece, False))         # and the last one may go on in another
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FOLDED.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()]
    sums = ("first", "last", "rows", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns")

    def closed(conv, piece: Piece, labels: dict[int, Label]) -> pa.RecordBatch:
        best = min(labels[s] for s in ACCEPTED if s in labels)
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([conv, *piece.counts(), *best], kinds)], names)

    now, whole, labels = None, None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if whole is None or row["conv_id"] != now:
                if whole is not None:
                    yield closed(now, whole, labels)
                now, whole, labels = row["conv_id"], Piece(), {0: (0, "")}
            whole.join(Piece(**{n: row[n] for n in sums}))
            labels = fold(labels, [(w["s"], w["t"], w["cost"], w["audit"]) for w in row["ways"]])
    if whole is not None:
        yield closed(now, whole, labels)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of the repaired lines from sorted rows: each conversation's audit, then its rows."""
    now, audit, at, state, digest, begun = (), "", 0, 0, None, False
    done: list[tuple] = []

    def line(role: str, text: str) -> None:
        nonlocal begun
        digest.update(("\n" if begun else "").encode() + role.encode() + b":" + text.encode())
        begun = True

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role, state = NEXT[state]
            line(ROLE[role], "")
            at += 1

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())],
                                          ["conv_id", "repaired_sha256"])

    for batch in batches:
        for conv, kind, role, text, found in zip(*(batch[c].to_pylist() for c in ("conv_id", "kind", "role", "text", "audit"))):
            if kind == 0:
                if digest is not None:
                    inserts()
                    done.append((now, digest.hexdigest()))
                    if len(done) >= 4096:
                        yield batch_of()
                        done = []
                now, audit, at, state, digest, begun = conv, found, 0, 0, hashlib.sha256(), False
                continue
            inserts()
            letter, at = audit[at], at + 1
            if letter == "K":
                state = STEP[state, role[:1]]
                line(role, text)
            elif letter == "R":
                made, state = NEXT[state]
                line(ROLE[made], text)
    if digest is not None:
        inserts()
        done.append((now, digest.hexdigest()))
    if done:
        yield batch_of()


def repair(rows: DataFrame, piece_items: int = 256) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``rows``."""
    spark = rows.sparkSession
    ws = Workspace(spark, "repair")
    rows = readable(rows)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = ws.table(_counted(rows), "counted")
    ordered = counted.repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER)
    pieces = ws.table(ordered.mapInArrow(_pieces(piece_items), PIECES), "pieces")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    complete = pieces.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    crossing = (pieces.where("not whole").repartition(ranges, "conv_id").sortWithinPartitions(*ORDER).mapInArrow(_folded, FOLDED))
    found = ws.table(complete.union(crossing), "found")
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    stream = (found.select("conv_id", F.lit(0).alias("kind"), none.alias("turn"), text.alias("role"), text.alias("head"), text.alias("digest"),
                           text.alias("text"), "audit")
              .union(_named(rows).select("conv_id", F.lit(1), "turn", "role", "head", "digest", "text", text))
              .repartition(ranges, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "head", "digest"))
    hashes = stream.mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    return found.join(hashes.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def repair_all(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """``repair`` of ``rows`` with a row for every conversation of ``conversations``, also where ``rows`` has none of it."""
    nothing = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
               "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    every = conversations.select(F.col("conv_id").cast("long").alias("c")).distinct()
    found = repair(rows)
    return (every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
            .select(F.col("c").alias("conv_id"), *(F.coalesce(F.col(n), F.lit(v)).alias(n) for n, v in nothing.items())))
