"""Cheapest repair of conversations by depth-first branch-and-bound.

A repaired conversation's roles read ``(s?(ua)+)?`` by their initials. Each row is kept, given another role or deleted, and rows may be
inserted between; an edit has a cost, and of equally cheap repairs the one whose letters come first wins. A search node is a
number of rows dealt with and a state of the role pattern. The search keeps an explicit stack. Suffix lower bounds are the least
cost of the rows ahead from each state, whatever the letters. The incumbent is the best (cost, letters) found, and the table of
each node holds the best (cost, letters) that reached it; prefixes that neither can beat are dropped, until the stack is empty and
the incumbent is proved optimal. State and letter decide each edit, so equal letters mean equal repairs.

Spark deals whole conversations over tasks and sorts them there. A conversation with more than ``segment`` rows is cut into segments that
are ordered and searched in parallel, from each state to each state; the segments' tables are then put together, which is exact:
prefixes of equal cost and rows never are prefixes of each other, so the least letters of the whole start with the least of a part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tapewright.llm.common import SLICE, WORD
from tapewright.session import stage

# Fixed values of the contract: costs of the edits, and states of (s?(ua)+)? with the role each state lets in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
WANTED = ("u", "u", "a", "u")  # the one role of u and a that each state lets in
ENDS = (START, AFTER_A)
ROLE = {"u": "user", "a": "assistant"}

LEGAL = ("su", "ua", "au")

SEGMENT = 2048  # rows of a conversation that are searched at once
SEGMENT_BYTES = 1 << 26  # of its texts

Item = tuple[str, bool, bool]  # initial of the role, must go, is truncated
Found = tuple[int, str]  # cost, letters


def suffix_bounds(items: list[Item], ends: tuple[int, ...] = ENDS) -> list[list[float]]:
    """Per number of rows dealt with and state, the least cost of what is ahead, whichever letters lead there."""

    def with_inserts(row: list[float]) -> list[float]:
        for _ in range(3):  # a state leads to every other within three insertions
            row = [min(c, INSERT + row[NEXT[state, WANTED[state]]]) for state, c in enumerate(row)]
        return row

    rows = [with_inserts([0.0 if state in ends else float("inf") for state in range(4)])]
    for initial, must_go, cut in reversed(items):
        after, now = rows[-1], []
        for state in range(4):
            least = DELETE + after[state]
            if not must_go:
                least = min(least, cut * TRUNCATED + (WANTED[state] != initial) * REROLE + after[NEXT[state, WANTED[state]]])
                if (state, initial) in NEXT:
                    least = min(least, cut * TRUNCATED + after[NEXT[state, initial]])
            now.append(least)
        rows.append(with_inserts(now))
    return rows[::-1]


def search(items: list[Item], begin: int = START, ends: tuple[int, ...] = ENDS) -> Found | None:
    """Least (cost, letters) that leads from ``begin`` past all items to one of ``ends``; None if nothing does."""
    n = len(items)
    ahead = suffix_bounds(items, ends)
    best: Found | None = None
    tables: list[dict[int, Found]] = [{} for _ in range(n + 1)]
    stack: list[tuple[int, int, int, str]] = [(0, begin, 0, "")]
    while stack:
        k, state, cost, letters = stack.pop()
        bound = cost + ahead[k][state]
        if bound == float("inf") or best is not None and (bound, letters) > (best[0], best[1][: len(letters)]):
            continue
        met = tables[k].get(state)
        if met is not None and met <= (cost, letters):
            continue
        tables[k][state] = cost, letters
        if k == n and state in ends and (best is None or (cost, letters) < best):
            best = cost, letters
        steps = [(k, NEXT[state, WANTED[state]], cost + INSERT, letters + "I")]
        if k < n:
            initial, must_go, cut = items[k]
            steps.append((k + 1, state, cost + DELETE, letters + "D"))
            if not must_go:
                extra = cost + cut * TRUNCATED
                if (state, initial) in NEXT:
                    steps.append((k + 1, NEXT[state, initial], extra, letters + "K"))
                if WANTED[state] != initial:
                    steps.append((k + 1, NEXT[state, WANTED[state]], extra + REROLE, letters + "R"))
        # The most promising is looked at first, so it goes on the stack last.
        steps.sort(key=lambda s: (s[2] + ahead[s[0]][s[1]], s[3]), reverse=True)
        stack += steps
    return best


def repaired(rows: list[tuple[str, str, str]], letters: str, state: int = START) -> tuple[Iterator[str], int]:
    """``role:text`` of each row (role, text, initial) that the letters leave or insert, and the state they end in."""
    out, at = [], 0
    for letter in letters:
        role, text, initial = rows[at] if letter != "I" else ("", "", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            state = NEXT[state, initial]
        else:
            role, state = ROLE[WANTED[state]], NEXT[state, WANTED[state]]
        out.append(f"{role}:{text}")
    return iter(out), state


def damaged(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The contract's damage: conv, turn, role, text and live of every row; a dropped row stays as one that is not live.

    By the CRC-32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its ends of sentences out, 3 repeats it, 4
    gives it to the user. Null roles and texts, and nulls in the hashed text, count as one space.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(known(conv_col), F.lit(":"), known(turn_col)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("live"), twice.alias("copy")).drop("copy")


def plain_rows(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, text and live of every row as it is; null roles and texts count as one space."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), known(role_col).alias("role"), known(text_col).alias("text"), F.lit(True).alias("live"))


def judged(rows: DataFrame) -> DataFrame:
    """``rows`` with what each shows on its own: blank, cut (does not end a sentence), initial of the role and bytes."""
    return rows.select(
        "conv", "turn", "role", "text", "live", (~F.col("text").rlike(WORD)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"),
        F.substring("role", 1, 1).alias("initial"),
    )


class Counts:
    """What is counted while a conversation's rows pass in order; ``add`` tells the first fault of each."""

    def __init__(self):
        self.low = self.high = self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.seen: set[bytes] = set()

    def add(self, row: dict, before: bool = False) -> Item:
        if row["turn"] is not None:
            self.low = row["turn"] if self.low is None else self.low
            self.turns += row["turn"] != self.high
            self.high = row["turn"]
        initial = row["initial"]
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        same = hashlib.sha256(f"{len(row['role'])}:{row['role']}{row['text']}".encode()).digest()
        blank = row["blank"]
        duplicate = not blank and (before or same in self.seen)
        cut = row["cut"] and not blank and not duplicate
        self.seen.add(same)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += cut
        return initial or " ", blank or duplicate, cut

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def followed_by(self, other: dict) -> None:
        """Take in the counts of the rows that come next."""
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + other[name])
        self.illegal += other["illegal"] + (self.last is not None and self.last + other["first"] not in LEGAL)
        self.last = other["last"]
        if other["low"] is not None:
            self.turns += other["turns"] - (other["low"] == self.high)
            self.low = other["low"] if self.low is None else self.low
            self.high = other["high"]


def _ddl(df: DataFrame, columns: str) -> str:
    return f"conv {df.schema['conv'].dataType.simpleString()}, {columns}"


def by_group(df: DataFrame, keys: list[str], order: list[str], work: Callable[[tuple, Iterator[dict]], list[dict]], schema: str) -> DataFrame:
    """``work`` on each group's rows in order. Spark deals and sorts them; a task reads a group row by row and may forget them as it goes."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for at in range(0, b.num_rows, SLICE) for r in b.slice(at, SLICE).to_pylist())
        out: list[dict] = []
        for key, group in groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            out += work(key, group)
            if len(out) >= SLICE:
                yield pa.RecordBatch.from_pylist(out, kinds)
                out = []
        yield pa.RecordBatch.from_pylist(out, kinds)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NOTHING = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def _whole(key: tuple, group: Iterator[dict]) -> list[dict]:
    """One conversation's result."""
    counts, items, rows = Counts(), [], []
    for r in group:
        if r["live"]:
            items.append(counts.add(r))
            rows.append((r["role"], r["text"], r["initial"]))
    cost, letters = search(items)
    digest = hashlib.sha256("\n".join(repaired(rows, letters)[0]).encode()).hexdigest()
    return [{
        "conv": key[0], "gaps": counts.gaps(), "blank": counts.blank, "duplicate": counts.duplicate, "truncated": counts.truncated,
        "illegal": counts.illegal, "cost": cost, "audit": letters, "repaired_sha256": digest,
    }]


def _segment(key: tuple, group: Iterator[dict]) -> list[dict]:
    """One segment's counts and its best way from each state to each state."""
    counts, items = Counts(), []
    for r in group:
        items.append(counts.add(r, bool(r["before"])))
    ways = [
        {"begin": b, "end": e, "cost": found[0], "letters": found[1]} for b in range(4) for e in range(4) if (found := search(items, b, (e,)))
    ]
    names = ("low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "first", "last")
    return [{"conv": key[0], "seg": key[1], **{n: getattr(counts, n) for n in names}, "ways": ways}]


def _joined(key: tuple, group: Iterator[dict]) -> list[dict]:
    """One conversation's segments put together: the result in the row without a segment, and each segment's letters and first state."""
    counts, segs, heads, trail = Counts(), [], {START: (0, "")}, []
    for s in group:
        counts.followed_by(s)
        after: dict[int, tuple[int, str, int, str]] = {}
        for w in s["ways"]:
            if w["begin"] in heads:
                cost, letters = heads[w["begin"]]
                one = cost + w["cost"], letters + w["letters"], w["begin"], w["letters"]
                after[w["end"]] = min(after.get(w["end"], one), one)
        segs.append(s["seg"])
        heads = {e: one[:2] for e, one in after.items()}
        trail.append({e: one[2:] for e, one in after.items()})
    (cost, letters), end = min((heads[e], e) for e in ENDS if e in heads)
    out = [{
        "conv": key[0], "seg": None, "begin": None, "gaps": counts.gaps(), "blank": counts.blank, "duplicate": counts.duplicate, "truncated": counts.truncated,
        "illegal": counts.illegal, "cost": cost, "letters": letters,
    }]
    for seg, back in zip(reversed(segs), reversed(trail)):
        end, part = back[end]
        out.append({"conv": key[0], "seg": seg, "begin": end, "letters": part})
    return out


def _piece(key: tuple, group: Iterator[dict]) -> list[dict]:
    rows = list(group)
    lines = list(repaired([(r["role"], r["text"], r["initial"]) for r in rows], rows[0]["letters"], rows[0]["begin"])[0])
    return [{"conv": key[0], "seg": key[1], "piece": "".join(line + "\n" for line in lines)}]


def _digest(key: tuple, group: Iterator[dict]) -> list[dict]:
    """SHA-256 of the pieces in order, without the last line's end; one piece is held at a time."""
    h, pending = hashlib.sha256(), ""
    for r in group:
        if r["piece"]:
            h.update(pending.encode())
            h.update(r["piece"][:-1].encode())
            pending = "\n"
    return [{"conv": key[0], "repaired_sha256": h.hexdigest()}]


def repair_long(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The results of conversations of any length from their judged live rows, in segments of at most ``segment`` rows."""
    rows = stage(rows.withColumn("at", F.monotonically_increasing_id()), "conversation-rows")
    order = ["conv", "turn", "role", "text", "at"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    rows = stage(rows.withColumn("seg", F.expr(f"pos div {segment}")).withColumn("same", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256)), "conversation-order")
    # One row for each role and text of a segment; those that an earlier segment holds are marked at their first row.
    once = rows.groupBy("conv", "seg", "same").agg(F.min("pos").alias("pos"))
    first = once.groupBy("conv", "same").agg(F.min("pos").alias("first")).select(F.col("conv").alias("c"), F.col("same").alias("s"), "first")
    before = once.join(first, once["conv"].eqNullSafe(first["c"]) & (once["same"] == first["s"])).filter("first < pos").select("pos", F.lit(True).alias("before"))
    marked = rows.join(before, "pos", "left")
    state = "low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string"
    ways = by_group(marked, ["conv", "seg"], ["pos"], _segment, _ddl(rows, f"seg long, {state}, ways array<struct<begin:int,end:int,cost:long,letters:string>>"))
    found = "seg long, begin int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, letters string"
    joined = stage(by_group(stage(ways, "conversation-segments"), ["conv"], ["seg"], _joined, _ddl(rows, found)), "conversation-letters")
    choice = joined.filter("seg is not null").select(F.col("conv").alias("c"), F.col("seg").alias("s"), "begin", "letters")
    texts = rows.join(choice, rows["conv"].eqNullSafe(choice["c"]) & (rows["seg"] == choice["s"])).select("conv", "seg", "pos", "role", "text", "initial", "begin", "letters")
    pieces = stage(by_group(texts, ["conv", "seg"], ["pos"], _piece, _ddl(rows, "seg long, piece string")), "conversation-pieces")
    digests = by_group(pieces, ["conv"], ["seg"], _digest, _ddl(rows, "repaired_sha256 string")).withColumnRenamed("conv", "c")
    whole = joined.filter("seg is null").drop("seg", "begin").withColumnRenamed("letters", "audit")
    return whole.join(digests, whole["conv"].eqNullSafe(digests["c"])).drop("c")


def repair_conversations(rows: DataFrame, *, segment: int = SEGMENT, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Faults and cheapest repair of each conversation of ``rows`` (conv, turn, role, text, live; see ``plain_rows`` and ``damaged``).

    conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, one row per conversation. Rows are taken by
    turn, null turns first; those of one turn by role, then text, so that ties and repeated rows have one order. Rows that are not live
    only make their conversation known: one without live rows has zeros, an empty audit and the digest of the empty text. A null
    id is a conversation of its own. A role without letters has no initial and cannot be kept. An empty table gives no rows.
    """
    rows = judged(rows)
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = stage(sizes.filter((F.col("n") > segment) | (F.col("bytes") > segment_bytes)).select(F.col("conv").alias("c")), "conversation-long")
    schema = _ddl(rows, REPORT)
    if long.isEmpty():
        return by_group(rows, ["conv"], ["turn", "role", "text"], _whole, schema)
    of = rows["conv"].eqNullSafe(long["c"])
    short = by_group(rows.join(long, of, "left_anti"), ["conv"], ["turn", "role", "text"], _whole, schema)
    done = stage(repair_long(rows.join(long, of, "left_semi").filter("live").drop("live"), segment), "conversation-repaired")
    none = long.join(done.select(F.col("conv").alias("d")), F.col("c").eqNullSafe(F.col("d")), "left_anti").select(F.col("c").alias("conv"), *[F.lit(v).cast("string" if isinstance(v, str) else "long").alias(n) for n, v in NOTHING.items()])
    return short.unionByName(done).unionByName(none)
