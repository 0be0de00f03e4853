"""The audits of repaired conversations against all edit sequences, and the job on hostile rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from gazette.llm import repair
from gazette.llm.repair import Audits, block_audits, choose_paths, closing, damaged, every_conversation, spoken_roles

GOOD = re.compile(r"(s?(ua)+)?\Z")


def exhaustive(rows, most=2):
    """The least (cost, audit) over every sequence of edits with up to ``most`` insertions in a gap."""
    best = None
    gaps = [g for n in range(most + 1) for g in itertools.product("ua", repeat=n)]
    options = []
    for initial, doomed, truncated in rows:
        extra = 5 if truncated else 0
        own = [("D", "", 2)]
        if not doomed:
            own += [("K", initial, extra), ("R", "u", 1 + extra), ("R", "a", 1 + extra)]
        options.append(own)
    for chosen in itertools.product(*options):
        for filled in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(c[2] for c in chosen) + 5 * sum(map(len, filled))
            if best is not None and cost > best[0]:
                continue
            made = "".join(filled[0]) + "".join(c[1] + "".join(g) for c, g in zip(chosen, filled[1:], strict=True))
            if GOOD.match(made):
                audit = "I" * len(filled[0]) + "".join(c[0] + "I" * len(g) for c, g in zip(chosen, filled[1:], strict=True))
                best = min(best or (cost, audit), (cost, audit))
    return best


def best_of(rows, modulus=(1 << 61) - 1):
    ends = block_audits(rows, modulus=modulus)
    return min((cost + closing(state)[0], audit + closing(state)[1]) for state, (cost, audit) in ends.items())


def random_rows(rng, n):
    return [(rng.choice("suuuaaat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7])
def test_cheapest_audit(modulus):
    """Also where nearly all rolling hashes collide."""
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            rows = random_rows(rng, n)
            assert best_of(rows, modulus) == exhaustive(rows), rows


def test_ties_by_common_prefix():
    rng = random.Random(3)
    for modulus in ((1 << 61) - 1, 5):
        audits = Audits(modulus)
        nodes = [0]
        for _ in range(400):
            nodes.append(audits.add(rng.choice(nodes[-6:]), rng.choice("DK")))
        for a, b in itertools.product(rng.sample(nodes, 60), repeat=2):
            if audits.text(a) != audits.text(b) or a == b:
                assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def test_blocks_give_the_audit_of_the_whole():
    rng = random.Random(11)
    for _ in range(60):
        rows = random_rows(rng, rng.randrange(1, 40))
        cuts = sorted(rng.sample(range(len(rows) + 1), min(4, len(rows))))
        parts = [rows[a:b] for a, b in itertools.pairwise([0, *cuts, len(rows)]) if b > a]
        paths = [{(e, s): found for e in ((0,) if i == 0 else range(4)) for s, found in block_audits(p, e).items()} for i, p in enumerate(parts)]
        placed = [{k: (c, sum(x < a for (e, _), (_, x) in b.items() if e == k[0])) for k, (c, a) in b.items()} for b in paths]
        total, chosen = choose_paths(placed)
        audit = "".join(b[step][1] for b, step in zip(paths, chosen, strict=True)) + closing(chosen[-1][1])[1]
        assert (total, audit) == best_of(rows)


def reference(rows):
    """Everything the operator returns, for ``conv_id, turn, role, text`` rows in Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, plain, counts = set(), [], [0, 0, 0]
        for _, role, text in own:
            ink = text.rstrip(" \t\n\v\f\r")
            fault = 0 if not ink else 1 if (role, text) in seen else 2 if ink[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            plain.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = best_of(plain)
        edits, tail = spoken_roles(audit, [p[0] for p in plain], 0)
        turns = []
        for (_, role, text), (before, new) in zip(own, edits, strict=True):
            turns += [f"{b}:" for b in before]
            if new != "-":
                turns.append(f"{role if new == '=' else new}:{text}")
        turns += [f"{b}:" for b in tail]
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        pairs = [a[0] + b[0] for a, b in itertools.pairwise(plain)]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())
    return out


HOSTILE = [
    (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 3, "assistant", "Yes"), (1, None, "system", "Be."),
    (2, 0, None, "a."), (2, 1, "", "b."), (2, 2, "tool", "c!"), (2, 3, "usher", "d?"), (2, 4, "assistant", "e. \n"),
    (3, 0, "user", None), (3, 1, "assistant", " \t\n"), (4, None, "user", "x."), (4, None, "assistant", "y."),
    (None, 1, "user", "q."), (None, 2, "assistant", "r."), (None, 2, "assistant", "r."), (5, 9, "assistant", "only."),
    (6, 1, "system", "s."), (7, 1, "user", "long " * 50_000 + "."), (7, 2, "assistant", "é 漢."),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def as_dict(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


def test_hostile_rows(spark):
    rows = spark.createDataFrame([(*r, 1, "z") for r in HOSTILE], SCHEMA + ", nr long, block string")
    found, _ = repair.repair(rows)
    assert as_dict(found) == reference(HOSTILE)


def test_long_conversations_in_blocks(spark, monkeypatch):
    """Blocks of two rows, one conversation far longer than a block."""
    monkeypatch.setattr(repair, "BLOCK_BITS", 1)
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{t}."])) for t in range(300)]
    rows += [(c, t, rng.choice(["user", "assistant"]), f"{t}{rng.choice('.,')}") for c in range(2, 30) for t in range(rng.randrange(1, 9))]
    found, turns = repair.repair(spark.createDataFrame(rows, SCHEMA))
    assert as_dict(found) == reference(rows)
    initials = {}
    for r in turns.orderBy("conv_id", "nr", "place").collect():
        initials[r["conv_id"]] = initials.get(r["conv_id"], "") + r["role"][0]
    assert all(GOOD.match(i) for i in initials.values())


def test_empty_table(spark):
    rows = spark.createDataFrame([], SCHEMA)
    found, turns = repair.repair(damaged(rows))
    assert every_conversation(rows, found).collect() == [] and turns.collect() == []


def test_damage(spark):
    rows = [(c, t, "assistant", f"A{c}. B!? {t}") for c in [*range(40), None] for t in (0, 1, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = [tuple(r) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    everything = spark.createDataFrame(rows, SCHEMA)
    hurt = [r for r in want]
    answer = as_dict(every_conversation(everything, repair.repair(damaged(everything))[0]))
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert answer == {**{r[0]: empty for r in rows}, **reference(hurt)}
