import random
import re
from hashlib import sha256
from itertools import product
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from marginalia.llm import edit_paths
from marginalia.llm.dialogue import damage, op13_dialogue_repair
from marginalia.llm.dialogue_repair import repair, turns_digest
from marginalia.llm.edit_paths import ENDING, START, Edit, compare, paths, unfold

SPACES = " \t\n\x0b\x0c\r"
WELL_FORMED = re.compile("s?(ua)+|")


def brute_damage(rows):
    shown = lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        kind, role, text = crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (conv, turn, "user" if kind == 4 else role, text)
        yield from [row, row] if kind == 3 else [row]


def kinds_of(turns):
    seen, out = set(), []
    for role, text in turns:
        body = text.strip(SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def initial(role):
    return role[0] if role[:1] in ("s", "u", "a") and role else "-"


def brute_edits(initials, faults):
    """Cheapest and first audit over states by plain string comparison: inserts and row edits one after the other."""
    after = {"": {"u": "u"}, "s": {"u": "u"}, "a": {"u": "u"}, "u": {"a": "a"}}
    best = {"": (0, "", ())}

    def offer(table, state, item):
        if state not in table or item[:2] < table[state][:2]:
            table[state] = item
            return True
        return False

    def insert(table):
        changed = True
        while changed:
            changed = False
            for state, (cost, audit, row) in list(table.items()):
                for role, then in after[state].items():
                    changed |= offer(table, then, (cost + 2, audit + "I", (*row, (None, role))))

    for at, (letter, fault) in enumerate(zip(initials, faults)):
        insert(best)
        following = {}
        for state, (cost, audit, row) in best.items():
            offer(following, state, (cost + 3, audit + "D", row))
            if fault in ("blank", "duplicate"):
                continue
            flaw = fault == "truncated"
            if letter in after[state] or (letter == "s" and state == ""):
                offer(following, letter, (cost + flaw, audit + "K", (*row, (at, None))))
            for role in after[state]:
                offer(following, role, (cost + 2 + flaw, audit + "R", (*row, (at, role))))
        best = following
    insert(best)
    return min(best[s] for s in ("", "a") if s in best)


def brute(rows):
    rows, names, out = list(rows), {"u": "user", "a": "assistant"}, []
    damaged = list(brute_damage(rows))
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [(r[2], r[3]) for r in own]
        faults, initials = kinds_of(turns), "".join(initial(r[2]) for r in own)
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, edits = brute_edits(initials, faults)
        lines = [f"{names[role] if role else turns[at][0]}:{'' if at is None else turns[at][1]}" for at, role in edits]
        digest = sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def by_paths(initials, kinds):
    """The audit by the linked edits, for a stretch that is a whole conversation."""
    ends = paths(initials, kinds, START)
    return min((cost + ENDING[s][0], letters + ENDING[s][1]) for s, (cost, letters) in ends.items())


@pytest.mark.parametrize("n", range(7))
def test_all_short_conversations(n):
    names = {0: None, 1: "truncated", 2: "blank"}
    for initials in product("sua-", repeat=n) if n < 5 else product("ua", repeat=n):
        for kinds in product((0, 1, 2), repeat=n) if n < 4 else [(0,) * n, (1,) * n, (0, 2) * n, (1, 0, 2) * n]:
            kinds = kinds[:n]
            cost, audit, _ = brute_edits(initials, [names[k] for k in kinds])
            assert by_paths("".join(initials), kinds) == (cost, audit), (initials, kinds)


def exhaustive(initials, kinds):
    """All edits of a few turns with at most two inserts at each place."""
    best = None
    for inserts in product(("", "u", "a", "ua", "au"), repeat=len(initials) + 1):
        for edits in product("KDua", repeat=len(initials)):
            roles, cost, audit = inserts[0], 2 * len(inserts[0]), "I" * len(inserts[0])
            for letter, kind, edit, more in zip(initials, kinds, edits, inserts[1:]):
                if kind == 2 and edit != "D" or letter == "-" and edit == "K":
                    break
                roles += {"K": letter, "D": ""}.get(edit, edit) + more
                cost += {"K": 0, "D": 3}.get(edit, 2) + (kind == 1 and edit != "D") + 2 * len(more)
                audit += (edit if edit in "KD" else "R") + "I" * len(more)
            else:
                if WELL_FORMED.fullmatch(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def test_edits_equal_an_exhaustive_search():
    for n in range(4):
        for initials in product("sua-", repeat=n):
            kinds = [(len(initials) * 7 + i * 5 + ord(c)) % 3 for i, c in enumerate(initials)]
            assert by_paths("".join(initials), kinds) == exhaustive(initials, kinds)


def test_compare_and_collisions(monkeypatch):
    rng = random.Random(2)

    def check():
        made = [Edit(None, "")]
        for _ in range(300):
            made.append(Edit(rng.choice(made[-40:]), rng.choice("DIKR")))
        for _ in range(2000):
            a, b = rng.choice(made), rng.choice(made)
            x, y = a.letters(), b.letters()
            assert (compare(a, b) > 0) - (compare(a, b) < 0) == (x > y) - (x < y)

    check()
    monkeypatch.setattr(edit_paths, "MODULUS", 3)  # most hashes collide
    check()


def test_unfolded_edits_give_well_formed_roles():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 12)
        initials, kinds = "".join(rng.choices("sua-", k=n)), rng.choices((0, 1, 2), k=n)
        for state, (_, letters) in paths(initials, kinds, START).items():
            rows = unfold(initials, letters, START)
            tail = {START: "", 1: "ua", 2: "a", 3: ""}[state]
            roles = "".join(b + (i if e == "K" else "" if e == "D" else e) for (b, e), i in zip(rows, initials)) + tail
            assert len(rows) == n and WELL_FORMED.fullmatch(roles)


def random_turns(n, seed):
    rng = random.Random(seed)
    texts = ["Good. ", "What?", "open end", " \t", "", None, "Yes!\n", "é…", "twice."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    convs = [None, 1, 2, 3, 4, 7, 7, 7, 7]
    return [(rng.choice(convs), rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("n,block", [(30, 256), (300, 4), (400, 32)])
def test_equals_brute_force(spark, n, block):
    rows = random_turns(n, n)
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    verdicts, turns = repair(damage(given), block=block)
    digests = {r.conv: r.digest for r in turns_digest(turns).collect()}
    got = [(*r, digests.get(r.conv, sha256(b"").hexdigest())) for r in verdicts.select("conv", *COLUMNS[1:-1]).collect()]
    want = [r for r in brute(rows) if any(d[0] == r[0] for d in brute_damage(rows))]
    assert sorted(map(tuple, got), key=repr) == want


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, op13_dialogue_repair(spark, sf_dir).select(*COLUMNS).collect()), key=repr)
    assert got == brute(rows)


def test_query_over_odd_rows(spark, tmp_path):
    rows = [(8, None, None, None), (None, None, "user", "Hi."), (9, 1, "user", "Hi."), (9, 1, "user", "Hi."), *random_turns(60, 9)]
    rows += [(k, 0, "user", "x.") for k in range(100, 160)]  # some lose their only turn
    given = spark.createDataFrame([(*r, "clash", 3, "x") for r in rows], "conv_id long, turn long, role string, text string, pos string, block int, conv string")
    given.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, op13_dialogue_repair(spark, str(tmp_path)).select(*COLUMNS).collect()), key=repr)
    assert got == brute(rows)
    assert any(r[7] == "" for r in got)


def test_empty_table(spark):
    verdicts, turns = repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert verdicts.count() == 0 and turns.count() == 0 and turns_digest(turns).count() == 0
