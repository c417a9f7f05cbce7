"""Conversation repair against all repairs there are, and against a plain table of states for longer conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tapewright.llm import conversations as cv

LEGAL = re.compile(r"(s?(ua)+)?")


def all_repairs(items, inserts=2):
    """Least (cost, letters, roles) by trying every edit of every row with up to ``inserts`` insertions before each."""
    best = None
    slots = [[(5 * n, "I" * n, r) for n in range(inserts + 1) for r in product("ua", repeat=n)]] * (len(items) + 1)
    edits = []
    for initial, must_go, cut in items:
        mine = [(2, "D", "")]
        if not must_go:
            mine += [(5 * cut, "K", initial), (5 * cut + 1, "R", "u"), (5 * cut + 1, "R", "a")]
        edits.append(mine)
    for way in product(*[x for pair in zip(slots, edits) for x in pair], slots[0]):
        roles = "".join(r if isinstance(r, str) else "".join(r) for _, _, r in way)
        if LEGAL.fullmatch(roles):
            one = sum(c for c, _, _ in way), "".join(x for _, x, _ in way)
            best = one if best is None or one < best else best
    return best


def by_states(items):
    """The same by the best of each state, row by row."""

    def inserts(now):
        for _ in range(4):
            for state, (c, x) in list(now.items()):
                to, one = cv.NEXT[state, cv.WANTED[state]], (c + 5, x + "I")
                now[to] = min(now.get(to, one), one)
        return now

    now = inserts({0: (0, "")})
    for initial, must_go, cut in items:
        after = {}
        for state, (c, x) in now.items():
            ways = [(state, c + 2, x + "D")]
            for role in "" if must_go else "sua":
                if (state, role) in cv.NEXT and (role == initial or role != "s"):
                    ways.append((cv.NEXT[state, role], c + 5 * cut + (role != initial), x + ("K" if role == initial else "R")))
            for to, cost, letters in ways:
                after[to] = min(after.get(to, (cost, letters)), (cost, letters))
        now = inserts(after)
    return min(now[e] for e in (0, 3) if e in now)


def some_items(rng, n, roles="suaux"):
    out = [(rng.choice(roles), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]
    return [(r, gone, cut and not gone) for r, gone, cut in out]


def test_search_tries_as_good_as_everything():
    rng = random.Random(4)
    for _ in range(60):
        items = some_items(rng, rng.randrange(4))
        assert cv.search(items) == all_repairs(items)


def test_search_by_states():
    rng = random.Random(5)
    for _ in range(1500):
        items = some_items(rng, rng.randrange(20), rng.choice(["suaux", "uauas", "ss", "uu"]))
        assert cv.search(items) == by_states(items)
    for n in (400, 2000):
        items = some_items(rng, n)
        assert cv.search(items) == by_states(items)


def plain(data, damage):
    """conv -> the result, from (conv, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in data:
        role, text = " " if role is None else role, " " if text is None else text
        of = convs.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        of += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, of in convs.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, *_ in of if t is not None}
        seen, items = set(), []
        count = dict.fromkeys(["blank", "duplicate", "truncated"], 0)
        for _, role, text in of:
            chars = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not chars else "duplicate" if (role, text) in seen else "truncated" if chars[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            items.append((role[:1] or " ", fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(of, of[1:]))
        cost, audit = by_states(items)
        lines, at, state = [], 0, 0
        for x in audit:
            role, text = of[at][1:] if x != "I" else ("", "")
            at += x != "I"
            if x == "D":
                continue
            if x != "K":
                role = {"u": "user", "a": "assistant"}[cv.WANTED[state]]
            state = cv.NEXT[state, role[0]]
            lines.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_rows(seed=3):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why? ", None, "é?\n", "long " * 4000 + "."]
    data = []
    for conv in [None, *range(60)]:
        for k in range(rng.choice([1, 2, 5, 9, 14])):
            role = rng.choice(["user", "assistant", "system", None, "", "tool", "user", "assistant"])
            data.append((conv, rng.choice([k, k, k, k + 3, k // 2, None]), role, f"{rng.choice('abcdefgh')} {t}" if (t := rng.choice(texts)) and rng.random() < 0.8 else t))
    data += [(7, 1, "user", "same row.")] * 3
    for k in range(700):  # long ones
        data.append((100, k, ("user", "assistant")[k % 2] if rng.random() < 0.9 else "system", rng.choice(["Yes.", "No.", f"text {k}.", f"text {k}", ""])))
    data += [(101, 5, "user", "over and over.")] * 200 + [(101, 6, "assistant", "Well.")]
    return data


SCHEMA = "conv_id long, turn int, role string, text string"


@pytest.mark.parametrize("damage", [False, True])
@pytest.mark.parametrize("segment", [16, 2048])
def test_reports(spark, damage, segment):
    data = some_rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    rows = cv.damaged(df) if damage else cv.plain_rows(df)
    got = cv.repair_conversations(rows, segment=segment).collect()
    want = plain(data, damage)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv], r.conv


def test_dropped_rows_and_clashing_columns(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", 1, 2)], SCHEMA + ", live int, conv int")
    assert [tuple(r) for r in cv.repair_conversations(cv.damaged(df)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    many = spark.createDataFrame([(gone, 0, "user", "Hi.")] * 20, SCHEMA)
    assert [tuple(r) for r in cv.repair_conversations(cv.damaged(many), segment=4).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_no_rows(spark):
    assert cv.repair_conversations(cv.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
