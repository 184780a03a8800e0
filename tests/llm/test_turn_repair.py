import hashlib
import random
import re
import zlib

import pytest

from kelpmill.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def every_edit(rows):
    """(cost, audit, lines) of the best way by trying rows one after another from all partial results; no more than two rows are inserted at a place."""
    seen, faults = set(), []
    for role, text in rows:
        own = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not own else "duplicate" if (role, text) in seen else "" if own[-1] in ".!?" else "truncated")
        seen.add((role, text))
    best = {"": (0, "", ())}  # by initials so far

    def better(table, key, value):
        if key not in table or value < table[key]:
            table[key] = value

    def inserted(table):
        for _ in range(2):
            for key, (cost, audit, lines) in list(table.items()):
                role = "assistant" if key.endswith("u") else "user"
                better(table, key + role[0], (cost + 5, audit + "I", (*lines, f"{role}:")))
        return table

    for (role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for key, (cost, audit, lines) in inserted(best).items():
            better(new, key, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                for edit, as_role, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    longer = key + (as_role[:1] if as_role[:1] in ("s", "u", "a") else "x")
                    if re.fullmatch(r"(s?(ua)*u?)?", longer):
                        better(new, longer, (cost + price + more, audit + edit, (*lines, f"{as_role}:{text}")))
        best = new
    cost, audit, lines = min(v for k, v in inserted(best).items() if LEGAL.fullmatch(k))
    return faults, cost, audit, lines


def plain(rows, ids):
    of = {c: [] for c in ids}
    for r in rows:
        of.setdefault(r[0], []).append(r)
    out = []
    for conv, own in of.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, cost, audit, lines = every_edit([r[2:] for r in own])
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(n=150):
    draw, rows = random.Random(8), []
    for c in range(n):
        turn = draw.choice([0, 3])
        for _ in range(draw.randrange(9)):
            turn += draw.choice([0, 1, 1, 1, 2])
            role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", None, "", "users"])
            rows.append((c, draw.choice([turn, turn, turn, None]), role, draw.choice(["Yes.", "No!", "Why? ", "and so", "", " \t", None, "é…", "one\ntwo.\n"])))
    rows += [(None, 1, "user", "A."), (None, None, "user", "B."), (900, 0, "system", "S."), (901, 0, "user", "x." * 300_000), (901, 1, "assistant", "y" * 300_000)]
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_audits_against_all_edits():
    draw = random.Random(3)
    for _ in range(3000):
        rows = [(draw.choice(["system", "user", "assistant", "tool"]), draw.choice(["a.", "b.", "c", "d", "", "e."])) for _ in range(draw.randrange(10))]
        faults, cost, audit, _ = every_edit(rows)
        codes = bytes((tr.INITIALS + "t").index(r[0]) + {"": tr.FINE, "truncated": tr.CUT}.get(f, tr.GONE) for (r, _), f in zip(rows, faults, strict=True))
        assert tr.cheapest(codes) == (cost, audit)


def test_long_conversation():
    codes = bytes(random.Random(1).choice([0, 1, 1, 2, 2, 3, 5, 6, 9]) for _ in range(20_000))
    cost, audit = tr.cheapest(codes)
    assert len(audit) - audit.count("I") == len(codes)
    least = [0, None, None, None]  # a row at a time
    for code in codes:
        for s, t in ((0, 2), (1, 2), (3, 2), (2, 3)):
            if least[s] is not None:
                least[t] = min(x for x in (least[t], least[s] + tr.INSERT) if x is not None)
        new = [None] * 4
        for s in range(4):
            if least[s] is not None:
                for _, t, more in tr._TAKE[code][s]:
                    new[t] = min(x for x in (new[t], least[s] + more) if x is not None)
        least = new
    assert cost == min(x for x in (least[0], least[3], least[2] + tr.INSERT) if x is not None)


def test_against_plain_version(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    ids = {r[0] for r in rows}
    assert got(tr.repair(df)) == plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], ids)
    assert got(tr.repair(tr.damaged(df), df)) == plain(plain_damage(rows), ids)


def test_small_batches_and_cases(spark):
    rows = conversations(20)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "2 as part", "3 as nth", "4 as code", "5 as audit")
    want = plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert got(tr.repair(df)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tr.repair(df.limit(0)).count() == 0
    only = tr.repair(df.limit(0), df.where("conv_id < 2")).collect()
    assert {(r.cost, r.audit, r.repaired_sha256) for r in only} == {(0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("codes,want", [((1, 2), (0, "KK")), ((0,), (2, "D")), ((1,), (2, "D")), ((0, 1, 2, 1), (2, "KKKD")), ((2, 1), (2, "RR")), ((1, 1, 2), (2, "DKK")), ((9, 10), (4, "DD"))])
def test_small_audits(codes, want):
    assert tr.cheapest(bytes(codes)) == want
