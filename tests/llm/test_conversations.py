"""Conversation repair: the chart against all splits and all edits, the query against a plain re-implementation."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest

from cohortspark.llm import conversations as cv

LEGAL = re.compile(r"(s?(ua)+)?")


def brute_edits(symbols):
    """Least (cost, audit) over all edit sequences; an optimum never costs more than deleting every row."""
    bound, best = 2 * len(symbols), None
    options = []
    for s in symbols:
        role, fault = "sua?"[s // 3], s % 3
        extra = 5 if fault == cv.OPEN else 0
        options.append([(2, "D", "")] + ([(extra, "K", role), (1 + extra, "R", "u"), (1 + extra, "R", "a")] if fault != cv.GONE else []))
    for chosen in itertools.product(*options):
        for count in range(bound // 5 + 1):
            for places in itertools.combinations_with_replacement(range(len(symbols) + 1), count):
                for roles in itertools.product("ua", repeat=count):
                    cost, audit, said = 5 * count, "", ""
                    for i in range(len(symbols) + 1):
                        for p, r in zip(places, roles):
                            if p == i:
                                audit, said = audit + "I", said + r
                        if i < len(symbols):
                            c, e, r = chosen[i]
                            cost, audit, said = cost + c, audit + e, said + r
                    if LEGAL.fullmatch(said) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
    return best


def full_chart(symbols):
    """CYK over every span and every split."""
    n, cells = len(symbols), {}
    for i, s in enumerate(symbols):
        cells[i, i + 1] = cv.leaf(s)
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            made = [cv.join(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
            cells[i, i + size] = tuple(min((m[j] for m in made if m[j] is not None), default=None) for j in range(len(cv.SPANS)))
            assert all(m == cells[i, i + size] for m in made)  # one split is enough
    return cells[0, n] if n else cv.EMPTY


def test_chart_against_all_edits():
    for n in range(3):
        for symbols in itertools.product(range(12), repeat=n):
            assert cv.root(cv.parse(bytes(symbols))) == brute_edits(symbols), symbols
    import random

    rng = random.Random(3)
    for _ in range(250):
        symbols = [rng.choice((0, 1, 3, 3, 4, 5, 6, 6, 7, 8, 9)) for _ in range(rng.choice((3, 4)))]
        assert cv.root(cv.parse(bytes(symbols))) == brute_edits(symbols), symbols


def test_chart_against_every_split():
    import random

    rng = random.Random(5)
    for n in (1, 7, 8, 9, 17, 30):
        symbols = bytes(rng.randrange(12) for _ in range(n))
        assert cv.parse(symbols) == full_chart(symbols)


def viterbi(symbols):
    """(cost, audit) from the left, state by state; a second way for long conversations."""
    ins = {0: (2, 3), 1: (2, 3), 2: (3,), 3: (2,)}
    best = {0: (0, "")}

    def inserted(b):
        out = dict(b)
        for p, (c, a) in b.items():
            for k, q in enumerate(ins[p], 1):
                out[q] = min(out.get(q, (10**9, "")), (c + 5 * k, a + "I" * k))
        return out

    for s in symbols:
        now, extra = {}, 5 if s % 3 == cv.OPEN else 0
        for p, (c, a) in inserted(best).items():
            steps = [(p, c + 2, a + "D")]
            if s % 3 != cv.GONE:
                for (x, r), q in cv.MOVES.items():
                    if x == p:
                        steps += [(q, c + extra, a + "K")] * (s // 3 < 3 and cv.INITIALS[s // 3] == r) + [(q, c + 1 + extra, a + "R")] * (r != "s")
            for q, *pair in steps:
                now[q] = min(now.get(q, (10**9, "")), tuple(pair))
        best = now
    best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


SPACE = " \t\n\x0b\x0c\r"


def brute(rows, hurt=True):
    """One tuple per conversation, from (conv_id, turn, role, text) rows."""
    groups, said = defaultdict(list), lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20 if hurt else 9
        role, text = said(role), said(text)
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, got in groups.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, symbols, faults, illegal = set(), [], Counter(), 0
        for i, (_, role, text) in enumerate(got):
            fault = "blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            at = "sua".find(role[:1]) if role else -1
            symbols.append((at if at >= 0 else 3) * 3 + {"": 0, "truncated": 1}.get(fault, 2))
            illegal += i > 0 and got[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        turns = [t for t, _, _ in got if t is not None]
        gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
        cost, audit = viterbi(symbols)
        lines, i, state = [], 0, 0

        def say(role, text):
            nonlocal state
            lines.append(f"{role}:{text}")
            state = cv.MOVES[state, role[0]]

        for e in audit:
            if e == "I":
                say("assistant" if state == 2 else "user", "")
                continue
            _, role, text = got[i]
            i += 1
            if e != "D":
                say(role if e == "K" else "assistant" if state == 2 else "user", text)
        assert LEGAL.fullmatch("".join(x[0] for x in lines)) and i == len(got)
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return Counter(out)


def run(spark, rows, folder):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv int, n string, `a.B` int").repartition(5).write.parquet(f"{folder}/conversations.parquet")
    return Counter(map(tuple, cv.op11_cyk_repair(spark, str(folder)).collect()))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = cv.op11_cyk_repair(spark, sf)
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_odd_conversations(spark, tmp_path):
    import random

    rng = random.Random(1)
    roles, texts = ["user", "assistant", "system", "User", "", "tool", None], ["Hi.", "so", "", " \t", "ok! \n", None, "Wie?", "."]
    rows = [(rng.choice([None, 1, 2, 3, -7]), rng.choice([None, 0, 1, 2, 3, 9, 2**62, -(2**62)]), rng.choice(roles), rng.choice(texts)) for _ in range(150)]
    rows += [(10, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(700)]  # spans every partition
    rows += [(11, i // 3, rng.choice(roles[:3]), f"t{rng.randrange(60)}" + rng.choice(".x")) for i in range(900)]
    rows += [(12, 5, "user", "same.")] * 300 + [(13, i, "user", "same.") for i in range(300)] + [(14, 0, "user", "long " * 100_000)]
    rows += [(100 + i, 0, "user", "x.") for i in range(60)]  # some lose their only row
    assert any(zlib.crc32(f"{100 + i}:0".encode()) % 20 == 0 for i in range(60))
    got = run(spark, [(*r, 1, "x", 2) for r in rows], tmp_path)
    assert got == brute(rows)


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "A."), (1, 1, "system", "S."), (1, 2, "user", "U."), (2, 0, "user", "Only.")], "c long, t long, r string, x string")
    turns = cv.turns(rows, "c", "t", "r", "x")
    found = cv.diagnose(turns)
    audits = {r.conv: (r.cost, r.audit) for r in found.collect()}
    assert audits[1] == cv.root(cv.parse(bytes([6, 0, 3]))) and audits[2] == (2, "D")
    got = [(r.conv, r.place, r.role, r.text) for r in cv.repaired(turns, found).collect()]
    assert [g for g in got if g[0] == 2] == [] and LEGAL.fullmatch("".join(g[2][0] for g in sorted(got)))


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single(spark, tmp_path, n):
    got = run(spark, [(None, None, None, None, None, None, None)][:n], tmp_path)
    assert sum(got.values()) == n and got == brute([(None, None, None, None)][:n])
