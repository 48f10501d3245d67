"""Repaired conversations against a search over all edit strings."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weft.llm import conversation_repair as cr
from weft.llm import registry

LEGAL = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """Cost, audit and repaired rows by trying strings of edits, cheapest first, without any table of states: (role, text, fault) rows."""
    best = None
    frontier = [(0, "", 0, ())]
    bound = 5 * len(rows) + 4
    while frontier:
        cost, audit, at, out = frontier.pop()
        if best and (cost, audit) > (best[0], best[1] + "\x7f" * 99) or cost > bound:
            continue
        initials = "".join(r[:1] or "?" for r, _ in out)
        if not re.fullmatch("s?(ua)*u?", initials):
            continue
        if at == len(rows) and LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
            bound = cost
        if at < len(rows):
            role, text, fault = rows[at]
            frontier.append((cost + 3, audit + "D", at + 1, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                frontier += [(cost + 2 + more, audit + "R", at + 1, (*out, (r, text))) for r in ("user", "assistant")]
                frontier.append((cost + more, audit + "K", at + 1, (*out, (role, text))))
        if not audit.endswith("III"):
            frontier += [(cost + 2, audit + "I", at, (*out, (r, ""))) for r in ("user", "assistant")]
    return best


def brute(table):
    """Plain Python of the whole contract."""
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        groups[conv]  # every conversation, damaged or not
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, fixed = cheapest([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)])
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in fixed).encode()).hexdigest()
        out.append((conv, gaps, *[faults.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest))
    return sorted(out, key=repr)


def small():
    import random

    rng = random.Random(4)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "User", "", "sub"])
            rows.append((conv, turn * rng.choice([1, 1, 2]), role, rng.choice(["A line.", "Cut off", " ", "Right? ", "x.\ny!", "é…", " "])))
    rows += [(200, None, "user", "a."), (200, 0, None, "b."), (200, 1, "assistant", None), (None, 3, "user", "q?"), (None, None, "assistant", "r."), (None, 4, "assistant", "r.")]
    rows += [(201, None, "user", "Only."), (202, 5, "user", "Same."), (202, 5, "user", "Same."), (202, 5, "assistant", "Same."), (-3, -7, "system", "s."), (-3, -2, "user", "u.")]
    rows += [(203, t, "user", "x.") for t in range(3)]
    return rows


def run(spark, rows, parts):
    df = cr.cleaned(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, pos string"))
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted(map(tuple, cr.repair(cr.damage(df, registry.damage_key()), given, parts).collect()), key=repr)


@pytest.mark.parametrize("parts", [2, 23])
def test_against_all_edit_strings(spark, parts):
    assert run(spark, small(), parts) == brute(small())


def test_long_conversation_over_many_partitions(spark):
    rows = [(1, t, ["user", "assistant", "assistant", "system"][t * t % 4 if t % 3 else t % 2], f"Turn {t % 700}" + ". "[t % 5 == 0]) for t in range(3000)]
    one, many = run(spark, rows, 2), run(spark, rows, 31)
    assert one == many and len(one) == 1 and len(one[0][7]) >= 2500


def test_very_long_text_and_dropped_conversation(spark):
    gone = next(c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    kept = next(c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 > 4)
    text = "Long words. " * 100_000
    got = {r[0]: r for r in run(spark, [(gone, 0, "user", "x."), (kept, 0, "user", text)], 3)}
    assert got[gone] == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[kept] == (kept, 0, 0, 0, 0, 0, 2, "KI", hashlib.sha256(f"user:{text}\nassistant:".encode()).hexdigest())


def test_empty_table(spark):
    assert run(spark, [], 3) == []


def test_segments_join_to_the_same_edits():
    import random

    rng = random.Random(9)
    for _ in range(60):
        row = bytes(rng.choice([0, 1, 2, 3, 5, 6, 9, 17, 18, 19]) for _ in range(rng.randrange(1, 14)))
        cuts = sorted(rng.sample(range(1, len(row)), min(3, len(row) - 1)))
        pieces = [row[a:b] for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True)]
        found = []
        for split in ([row], pieces):
            tables = [cr.search([p]) for p in split]
            cost, ends, close = cr.join_segments([t[0][0] for t in tables], [t[1][0] for t in tables])
            found.append((cost, b"".join(cr.reconstruct([p], [e])[0] for p, e in zip(split, ends, strict=True)), close))
        assert found[0] == found[1]
