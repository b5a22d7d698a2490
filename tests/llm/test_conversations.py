"""Conversation repair (op11) against a shortest path over all edits."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from plain import empty

from ragtables.llm import conversation_repair as cr
from ragtables.llm.queries import op11_conversation_repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
ROW = re.compile(r"(s?(ua)+)?")


def next_roles(state, symbol):
    """A hand-made automaton of (s?(ua)+)?; states: 0 start, 1 after s, 2 after u, 3 after a."""
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, symbol))


def cheapest(rows):
    """(cost, audit, repaired) by Dijkstra's search in order of (cost, audit)."""
    queue = [(0, "", 0, 0, ())]
    done = set()
    while queue:
        cost, audit, at, state, out = heapq.heappop(queue)
        if (at, state) in done:
            continue
        if at == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(out)
        done.add((at, state))
        for symbol, role in (("u", "user"), ("a", "assistant")):
            to = next_roles(state, symbol)
            if to is not None:
                heapq.heappush(queue, (cost + 3, audit + "I", at, to, (*out, f"{role}:")))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, out))
        if fault in ("blank", "duplicate"):
            continue
        more = 3 if fault else 0
        to = next_roles(state, role[:1])
        if to is not None:
            heapq.heappush(queue, (cost + more, audit + "K", at + 1, to, (*out, f"{role}:{text}")))
        for symbol, new in (("u", "user"), ("a", "assistant")):
            to = next_roles(state, symbol)
            if to is not None and symbol != role[:1]:
                heapq.heappush(queue, (cost + 3 + more, audit + "R", at + 1, to, (*out, f"{new}:{text}")))
    raise AssertionError


def brute(table):
    """The contract, row by row."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in table:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        what = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = convs[conv]
        if what == 0:
            continue
        if what == 1:
            text = ""
        if what == 2:
            text = re.sub("[.!?]", "", text)
        if what == 4:
            role = "user"
        rows += [(turn, role, text)] * (2 if what == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in rows:
            left = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not left else "duplicate" if (role, text) in seen else None if left[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, text = cheapest(faulty)
        counts = collections.Counter(f for *_, f in faulty)
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_automaton_accepts_the_grammar():
    automaton = cr.Automaton()
    for n in range(7):
        for roles in itertools.product("sua", repeat=n):
            top = 0
            for r in roles:
                top = automaton.push(top, r) if top is not None else None
            accepted = top is not None and automaton.nodes[top][0] in automaton.accepting
            assert accepted == bool(ROW.fullmatch("".join(roles)))


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_edits_match_search(seed):
    rng = random.Random(seed)
    parser = cr.Parser()
    for _ in range(400):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), f"t{i}", rng.choice([None, None, None, "truncated", "blank", "duplicate"])) for i in range(rng.randint(0, 14))]
        repair, edits = cr.Repair(parser), []
        for role, text, fault in rows:
            edits += repair.add((role, text), role, fault)
        edits += repair.end()
        out = [f"{cr.ROLE_OF.get(e, row and row[0])}:{row[1] if row else ''}" for e, row in edits if e != "D"]
        assert (repair.cost, "".join(e for e, _ in edits).translate(cr.AUDIT), "\n".join(out)) == cheapest(rows)


def test_long_conversations_settle():
    rng = random.Random(9)
    rows = [(rng.choice(["user", "assistant", "user", "assistant", "system"]), f"t{i}", rng.choice([None, "truncated", "blank"])) for i in range(3000)]
    repair, edits, held = cr.Repair(cr.Parser()), [], 0
    for role, text, fault in rows:
        edits += repair.add((role, text), role, fault)
        held = max(held, len(repair.rows))
    edits += repair.end()
    assert (repair.cost, "".join(e for e, _ in edits).translate(cr.AUDIT)) == cheapest(rows)[:2]
    assert held < 200


def test_query_matches_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op11_conversation_repair(spark, SF).collect()), key=str) == brute(table)


def test_messy_rows(spark):
    rng = random.Random(4)
    texts = ["Yes.", "no", "", None, " \t\n", "ends!\x0b", "long. " * 20000, "größe?", "a\nb.", "Yes."]
    table = [(rng.choice([1, 2, 3, 4, 5, None, 77]), rng.choice([None, 0, 1, 2, 3, 7, -2, 40]), rng.choice(["user", "assistant", "system", None, "", "tool", "unknown"]), rng.choice(texts)) for _ in range(300)]
    table += [(1000 + i, i % 7, rng.choice(["user", "assistant"]), rng.choice(texts)) for i in range(80)]
    extra = spark.createDataFrame([(*r, "x", 1, True) for r in table], SCHEMA + ", fault string, again int, gone boolean").repartition(3)
    got = cr.repaired(extra)
    assert sorted(map(tuple, got.collect()), key=str) == brute(table)
    none = cr.repaired(empty(extra))
    assert none.collect() == [] and none.columns == got.columns


def test_repaired_rows_are_legal(spark):
    table = [(i % 9, i // 9, random.Random(i).choice(["user", "assistant", "system"]), f"Text {i % 31}.") for i in range(200)]
    rows = cr.repair_rows(spark.createDataFrame(table, SCHEMA)).collect()
    for conv in range(9):
        kept = "".join(r["role"][:1] for r in rows if r["conv_id"] == conv and r["role"])
        assert kept and ROW.fullmatch(kept)
