"""Conversation repair against one pass over all states, in every grouping."""

import hashlib
import itertools
import random

import pytest

from larkspur.llm import repair
from larkspur.llm.repair import damage, digest_repaired, repair_conversations

ROLES = {"u": "user", "a": "assistant"}
STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain(rows):
    """rows: (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\f\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def inserted(best):
        for _ in range(3):
            for s, (cost, audit, out) in list(best.items()):
                for r in "ua":
                    if (s, r) in STEPS:
                        v = (cost + 2, audit + "I", [*out, ROLES[r] + ":"])
                        best[STEPS[s, r]] = min(best.get(STEPS[s, r], v), v)
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for s, (cost, audit, out) in best.items():
            options = [(s, (cost + 3, audit + "D", out))]
            if fault in ("", "t"):
                more = fault == "t"
                if (s, role[:1]) in STEPS:
                    options.append((STEPS[s, role[:1]], (cost + more, audit + "K", [*out, f"{role}:{text}"])))
                options += [(STEPS[s, r], (cost + 2 + more, audit + "R", [*out, f"{ROLES[r]}:{text}"])) for r in "ua" if (s, r) in STEPS]
            for end, v in options:
                new[end] = min(new.get(end, v), v)
        best = inserted(new)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_products_in_any_grouping():
    rng = random.Random(1)
    kinds = [(i, f) for i in ("s", "u", "a", "x", "") for f in range(4)]
    for _ in range(300):
        turns = [repair.turn_matrix(*rng.choice(kinds)) for _ in range(rng.randrange(1, 9))]
        left = turns[0]
        for m in turns[1:]:
            left = repair.times(left, m)
        cut = rng.randrange(len(turns) + 1)
        assert left == repair.tree(turns) == repair.times(repair.tree(turns[:cut]), repair.tree(turns[cut:]))
    m = repair.turn_matrix("a", repair.DUPLICATE)
    assert repair.power(m, 7) == repair.tree([m] * 7)


def conversations(rng, n):
    texts = ["", " \t", "yes.", "no", "why? ", "Ünïcode!", "a" * 9, "b."]
    rows = []
    for i in range(n):
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 21, 60])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "s"])
            rows += [(i, rng.choice([turn, turn, turn, turn // 2, None]), role, rng.choice(texts))] * rng.choice([1, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("sizes", [{}, {"whole": 4, "piece": 3, "arity": 2}])
def test_equal_to_one_pass(spark, sizes):
    rows = [*conversations(random.Random(3), 40), (None, 0, "user", "hi."), (None, 1, None, None), (-1, None, None, None)]
    rng = random.Random(4)
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in digest_repaired(repair_conversations(df, **sizes)).collect()}
    clean = [(i, t, " " if r is None else r, " " if x is None else x) for i, t, r, x in rows]
    want = {}
    for i in {r[0] for r in clean}:
        own = sorted((r[1:] for r in clean if r[0] == i), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        want[i] = plain(own)
    assert got == want


def test_one_long_conversation(spark):
    """Most rows are one conversation, and most of that is one turn repeated."""
    rng = random.Random(6)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"{rng.randrange(900)}.") for t in range(3000)] + [(7, 3000, "user", "again.")] * 2000 + [(8, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnsRenamed({"conv_id": "id", "turn": "turn"})
    repaired = repair_conversations(df, id_col="id", whole=100, piece=64, arity=4)
    parts = repaired.where("id = 7").orderBy("part").collect()
    assert len(parts) == parts[0]["parts"] > 10 and parts[1]["audit"] is None
    got = {r[0]: tuple(r)[1:] for r in digest_repaired(repaired, "id").collect()}
    assert got == {i: plain(sorted((r[1:] for r in rows if r[0] == i))) for i in (7, 8)}
    kept = [t["edit"] for p in parts for t in p["turns"]]
    assert "".join(kept) == parts[0]["audit"].replace("D", "")


def test_empty_dropped_and_clashing_columns(spark):
    schema = "conv_id long, turn long, role string, text string, part long, audit string, copies long"
    df = spark.createDataFrame([(5, 0, "user", "a.", 1, "x", 0)], schema)
    none = digest_repaired(repair_conversations(df, copies_col="copies")).collect()
    assert [tuple(r) for r in none] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    one = repair_conversations(df).collect()
    assert [(r.conv_id, r.audit, [tuple(t) for t in r.turns]) for r in one] == [(5, "KI", [("user", "a.", "K"), ("assistant", "", "I")])]
    assert repair_conversations(df.limit(0)).collect() == []
    assert digest_repaired(repair_conversations(df.limit(0))).collect() == []


def test_damage(spark):
    import zlib

    rows = [(c, t, None if t == 3 else "assistant", None if t == 4 else "a.b! c?") for c in (1, 2, None) for t in (0, 1, 2, 3, 4, None)] + [(9, t, "system", "x?") for t in range(60)]
    got = {(r.conv_id, r.turn): (r.role, r.text, r.copies) for r in damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = " " if text is None else text, " " if role is None else role
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        assert got[c, t] == ("user" if kind == 4 else role, text, 0 if kind == 0 else 2 if kind == 3 else 1)
