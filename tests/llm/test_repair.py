import hashlib
import itertools
import random
import re
import zlib

import pytest

from llm_helpers import plain, same
from tramline.llm import repair
from tramline.llm.catalog import QUERIES

FORM = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, kept rows) by trying all edits of a few rows, inserts of up to two rows at each place."""
    best = None
    gaps = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]

    def go(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for more in gaps:
            c, a, o = cost + 5 * len(more), audit + "I" * len(more), out + [(r, "") for r in more]
            if i == len(rows):
                if FORM.fullmatch("".join(r[:1] for r, _ in o)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, o)
                continue
            role, text, fault = rows[i]
            go(i + 1, c + 2, a + "D", o)
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                go(i + 1, c + extra, a + "K", o + [(role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, c + extra + 1, a + "R", o + [(new, text)])

    go(0, 0, "", [])
    return best


def by_states(rows):
    """(cost, audit, repaired rows) from the best (cost, audit) of each state, row by row."""
    step = lambda st, r: {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}.get(r, {}).get(st)

    def put(table, st, value):
        if st is not None and (st not in table or value[:2] < table[st][:2]):
            table[st] = value

    def inserts(table):
        for _ in range(4):
            for st, (c, a, o) in list(table.items()):
                for r in ("user", "assistant"):
                    put(table, step(st, r[0]), (c + 5, a + "I", o + [(r, "")]))
        return table

    table = inserts({"": (0, "", [])})
    for role, text, fault in rows:
        new = {}
        for st, (c, a, o) in table.items():
            put(new, st, (c + 2, a + "D", o))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                put(new, step(st, role[:1]), (c + extra, a + "K", o + [(role, text)]))
                for r in ("user", "assistant"):
                    put(new, step(st, r[0]), (c + extra + 1, a + "R", o + [(r, text)]))
        table = inserts(new)
    return min(table[st] for st in ("", "a") if st in table)


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        shown = lambda v: " " if v is None else v
        role, text = shown(role), shown(text)
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def expected(rows):
    out = []
    for conv, own in after_damage(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else
                          "sound" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, left = by_states([(r, t, f) for (_, r, t), f in zip(own, faults)])
        pairs = zip([r[:1] for _, r, _ in own], [r[:1] for _, r, _ in own][1:])
        out.append({"conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                    **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
                    "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs), "cost": cost, "audit": audit,
                    "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()})
    return out


def table(spark, folder, rows):
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, cost int, "
                          "audit string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def random_rows(rng, n, roles=("system", "user", "assistant", "tool", "unknown")):
    return [(rng.choice(roles), rng.choice(["a.", "b", "c!", "", "d?"]),
             rng.choice(["sound"] * 5 + ["truncated", "blank", "duplicate"])) for _ in range(n)]


CODES = {"sound": repair.SOUND, "blank": repair.BLANK, "duplicate": repair.DUPLICATE, "truncated": repair.TRUNCATED}


def test_auction_against_all_edits():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 3, 4, 4, 4):
        rows = random_rows(rng, n)
        told = cheapest(rows)
        assert repair.repaired([(r[:1], CODES[f]) for r, _, f in rows]) == told[:2] == by_states(rows)[:2]


@pytest.mark.parametrize("segment", [1, 3, 128])
def test_auction_against_states(segment, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rng = random.Random(segment)
    for n in itertools.chain(range(40), (300, 777)):
        rows = random_rows(rng, n)
        assert repair.repaired([(r[:1], CODES[f]) for r, _, f in rows]) == by_states(rows)[:2]


def test_prices_stay_feasible():
    rng = random.Random(9)
    rows = [(r[:1], CODES[f]) for r, _, f in random_rows(rng, 60)]
    segment = repair.Segment(rows, [0, repair.FAR, repair.FAR, 0])
    for state in range(4):
        segment.auction(state)
        assert all(segment.price[i] <= cost + segment.price[end] for i, own in enumerate(segment.out) for _, cost, end in own)


def test_random_conversations(spark, tmp_path, duck):
    rng = random.Random(5)
    rows = [(c, t + rng.randint(0, 1), role, rng.choice(["Yes.", "no", "Why?", "x! ", "", "t" * 9 + "."]))
            for c in range(300) for t, (role, _, _) in enumerate(random_rows(rng, rng.randint(1, 9)))]
    folder, told = table(spark, tmp_path / "a", rows), expected(rows)
    same(plain(QUERIES["op12_auction_repair"](spark, folder)), told)
    same(duck(repair.SQL, folder, ("conversations",)), told)


def test_supplied_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    told = expected(rows)
    assert sum(r["cost"] for r in told) > 0
    same(plain(QUERIES["op12_auction_repair"](spark, "/root/testdata/sf0.01")), told)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(6)
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (1, None, None, "x."), (1, None, "", "y."),
            (1, 5, "user", None), (2, 3, "user", "z" * 200_000 + "."), (2, 4, "assistant", "é!　"), (2, 4, "assistant", "é!"),
            (3, -5, "system", "s."), (3, 2**40, "user", "\n"), (4, 1, "user", "tie."), (4, 1, "assistant", "tie."), (4, 1, "user", "tie.")]
    rows += [(7, i, role, f"{i}{rng.choice(['.', '.', '.', ''])}") for i, (role, _, _) in enumerate(random_rows(rng, 3000))]
    dropped = [(c, 0, "user", "gone.") for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert dropped
    rows += dropped
    told = expected(rows)
    assert [r["audit"] for r in told if r["conv_id"] == dropped[0][0]] == [""]
    same(plain(QUERIES["op12_auction_repair"](spark, table(spark, tmp_path / "odd", rows))), told)
    assert plain(QUERIES["op12_auction_repair"](spark, table(spark, tmp_path / "empty", []))) == []
