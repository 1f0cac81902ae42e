"""Repair of conversations against exhaustive search and a plain suffix recursion over whole audits."""

import hashlib
import random
import re
from functools import cache
from itertools import product

import pytest

from rubrica.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """rows: (turn, role, text) in order; the first fault of each."""
    seen, found = set(), []
    for _, role, text in rows:
        end = text.rstrip(SPACE)
        found.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """Cost and audit by recursion over (row, state) from the end, audits as whole strings."""

    @cache
    def best(k, state):
        ways = []
        for inserts in range(4):
            cost, audit, forced = 5 * inserts, "I" * inserts, "a" if state == 2 else "u"
            if k == len(rows):
                if state in (0, 3):
                    ways.append((cost, audit))
            else:
                steps = [(2, "D", state)]
                if found[k] not in ("blank", "duplicate"):
                    extra, initial = 5 * (found[k] == "truncated"), rows[k][1][:1]
                    steps.append((1 + extra, "R", 3 if forced == "a" else 2))
                    if initial == forced or initial == "s" and state == 0:
                        steps.append((extra, "K", {"s": 1, "u": 2, "a": 3}[initial]))
                for more, edit, to in steps:
                    rest = best(k + 1, to)
                    ways.append((cost + more + rest[0], audit + edit + rest[1]))
            state = 3 if forced == "a" else 2
        return min(ways, default=(10**6, ""))

    return best(0, 0)


def exhaustive(rows, found):
    choices = []
    for (_, role, _), fault in zip(rows, found):
        extra = 5 * (fault == "truncated")
        here = [(2, "D", "")]
        if fault not in ("blank", "duplicate"):
            here += [(extra, "K", role[:1] or "?"), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
        choices.append(here)
    inserts = [(5 * n, "I" * n, "".join(r)) for n in range(4) for r in product("ua", repeat=n)]
    best = None
    for edits in product(*choices):
        for gaps in product(inserts, repeat=len(rows) + 1):
            steps = [x for pair in zip(gaps, edits) for x in pair] + [gaps[-1]]
            if re.fullmatch("(s?(ua)+)?", "".join(s[2] for s in steps)):
                got = sum(s[0] for s in steps), "".join(s[1] for s in steps)
                best = min(best or got, got)
    return best


def expected(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit = cheapest(rows, found)
    out, k, state = [], 0, 0
    for edit in audit:
        forced = "assistant" if state == 2 else "user"
        if edit == "I":
            role, text = forced, ""
        else:
            _, role, text = rows[k]
            k += 1
            role = forced if edit == "R" else role
        if edit != "D":
            out.append((role, text))
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), out


def conversation(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "u", "User", None]
    texts = ["Fine.", "No end", "  \n", "", "Why? ", "same.", "same.", "…", "é!\t", None, "x" * 30 + "."]
    rows, turn = [], 0
    for _ in range(n):
        turn += rng.choice([0, 1, 1, 1, 2])
        common = rng.random() < 0.7
        role = ("user", "assistant")[turn % 2] if common else rng.choice(roles)
        text = f"text {rng.randrange(40)}." if common else rng.choice(texts)
        rows.append((None if rng.random() < 0.03 else turn, role, text))
    return rows


def test_the_recursion_is_the_cheapest():
    rng = random.Random(4)
    for _ in range(150):
        rows = sorted(((t, r or " ", x or " ") for t, r, x in conversation(rng, rng.randint(0, 2))), key=lambda r: r[0] or 0)
        assert cheapest(rows, faults(rows)) == exhaustive(rows, faults(rows))


def test_matrices_of_any_split_agree():
    """Whatever rules a sequence is rewritten with, its matrix and audits are the same."""
    rng = random.Random(9)
    plain, grammar = cr.Grammar(), cr.Grammar()
    grammar.add([(1, 2), (2, 1), (8, 8), (5, 2)])
    grammar.add([(9, 9), (9, 10), (11, 11), (9, 1)])
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 1, 2, 1, 2, 3, 5, 6, 7, 8, 8]) for _ in range(rng.randint(1, 40)))
        a, b = cr.Run(plain, codes), cr.Run(grammar, codes)
        assert (a.cost == b.cost).all()
        for i in range(4):
            for j in range(4):
                assert a.cost[i, j] == b.cost[i, j]
                if a.cost[i, j] < cr.NEVER:
                    assert a.audit(i, j) == b.audit(i, j)


@pytest.mark.parametrize("most", [3, 4096])
def test_equals_brute_force(spark, most):
    rng = random.Random(11)
    given = {i: conversation(rng, rng.choice([1, 2, 3, 5, 8, 13])) for i in range(120)}
    given[500] = [(k // 2, ("user", "assistant")[k % 2], f"turn {k % 700}.") for k in range(900)]  # a large one
    given[501] = [(7, "user", "Again.")] * 50  # repeated rows
    given[502] = [(0, "user", "long " * 300_000 + "."), (1, "assistant", "Yes.")]
    given[None] = [(0, "user", "Hello."), (1, "assistant", "Hello.")]
    rows = [(c, t, r, x, 1, "p") for c, turns in given.items() for t, r, x in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int, part string")
    ids = spark.createDataFrame([(c,) for c in [*given, 900]], "conv_id long")
    got = {r[0]: tuple(r)[1:] for r in cr.audited(df, ids, most).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {c: expected(turns)[0] for c, turns in given.items()} | {900: empty}
    if most == 3:
        texts = {}
        for r in sorted(cr.repaired(df, most).collect(), key=lambda r: r.n):
            texts.setdefault(r.conv_id, []).append((r.role, r.text))
        assert texts == {c: out for c, turns in given.items() if (out := expected(turns)[1])}


def test_empty_table_and_bytes_that_are_no_utf8(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.audited(empty).count() == 0
    odd = spark.sql("SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, cast(x'ff2e' AS string) AS text")
    assert [(r.cost, r.audit, r.repaired_sha256) for r in cr.audited(odd).collect()] == [(2, "D", hashlib.sha256(b"").hexdigest())]
    more = odd.unionByName(spark.sql("SELECT 1L AS conv_id, 1L AS turn, 'assistant' AS role, 'Yes.' AS text"))
    assert [r.repaired_sha256 for r in cr.audited(more).collect()] == [hashlib.sha256("user:�.\nassistant:Yes.".encode()).hexdigest()]


def test_grammar_shares_rules(spark):
    rng = random.Random(2)
    codes = [(bytes([1, 2] * rng.randint(1, 30) + [rng.randrange(9)]),) for _ in range(200)]
    grammar = cr.compress(spark.createDataFrame(codes, "codes binary").distinct())
    assert len(grammar.rounds) > 2 and sum(len(grammar.parse(c)) for c, in codes) < 0.2 * sum(len(c) for c, in codes)
