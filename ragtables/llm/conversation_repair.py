"""Conversation repair by generalised LR parsing with weighted edits.

The roles of a conversation must form a sentence of the role grammar (``GRAMMAR``: nothing, or turns of user and
assistant, after at most one system row). Rows that break it are edited at the least cost: a row is kept, given another
role or deleted, and empty rows are inserted. A blank row or one that repeats an earlier row (role and text) must go, and
a truncated row that stays costs extra.

The LR automaton of the grammar is built from its productions. Its stacks share their lower parts in one graph of nodes
(state, node below), each made once; after every row, stacks with the same top node are merged by the smallest
(cost, audit), audit being the edits' initials so far. That is exact: equal nodes have equal futures, and at one row no
cheapest audit is a proper prefix of another, since it would have fewer inserts and so a smaller cost. Tops that are
dearer than the cheapest by more than ``Costs.slack`` cannot win (two inserts finish the open turn of the cheapest, and
one delete or insert follows any other top from there), so they go. What all tops have in common is settled: those rows
leave the buffer. A step depends only on the tops' costs and open audits and on the kind of the row, so steps are
remembered.

Rows are shuffled once, by conversation, sorted by Spark (on disk if need be) and read as a stream, so a conversation
is never held in memory; one that holds a third of all rows passes through one task, as its parse and its hash are
serial by definition.

Defined results: a null text or role is one space; a null turn comes first; rows with equal turns are ordered by role
and text; rows with a null conv_id form one conversation; a role counts by its first letter; a conversation of which
all rows are ``gone`` has no edits. Extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os.path
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ragtables.llm import textarrays as ta

#: (head, body); the first head is the start symbol, other symbols are first letters of roles.
GRAMMAR = (("S", ""), ("S", "P"), ("P", "ua"), ("P", "sua"), ("P", "Pua"))
#: Roles that a row can be given or an inserted row can have.
ROLES = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"
FINAL = (".", "!", "?")
BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"


class Costs(NamedTuple):
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3

    @property
    def slack(self) -> int:
        return 2 * self.insert + max(self.delete, self.insert)


class Automaton:
    """LR automaton of a grammar and the graph of the stacks met so far."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        self.grammar, self.start = grammar, grammar[0][0]
        self.heads = {h for h, _ in grammar}
        self.states = [self.closure({(i, 0) for i, (h, _) in enumerate(grammar) if h == self.start})]
        self.gotos: dict[tuple[int, str], int] = {}
        for state, items in enumerate(self.states):  # grows meanwhile
            for symbol in sorted({grammar[i][1][dot] for i, dot in items if dot < len(grammar[i][1])}):
                to = self.closure({(i, dot + 1) for i, dot in items if grammar[i][1][dot : dot + 1] == symbol})
                if to not in self.states:
                    self.states.append(to)
                self.gotos[state, symbol] = self.states.index(to)
        done = [[i for i, dot in items if dot == len(grammar[i][1])] for items in self.states]
        # the start symbol is only complete at the end; other rules are reduced at once
        self.accepting = {s for s, found in enumerate(done) if any(grammar[i][0] == self.start for i in found)}
        self.reductions = {s: grammar[i] for s, found in enumerate(done) for i in found if grammar[i][0] != self.start}
        self.nodes: list[tuple[int, int]] = [(0, -1)]  # (state, node below)
        self.found = {(0, -1): 0}
        self.pushed: dict[tuple[int, str], int | None] = {}

    def closure(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        items = set(items)
        while True:
            heads = {self.grammar[i][1][dot] for i, dot in items if dot < len(self.grammar[i][1])}
            more = {(i, 0) for i, (h, _) in enumerate(self.grammar) if h in heads} - items
            if not more:
                return frozenset(items)
            items |= more

    def node(self, state: int, below: int) -> int:
        if (state, below) not in self.found:
            self.found[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.found[state, below]

    def push(self, top: int, symbol: str) -> int | None:
        """Top node after shifting ``symbol`` and all reductions; None if the symbol cannot follow."""
        if (top, symbol) not in self.pushed:
            to = self.gotos.get((self.nodes[top][0], symbol))
            at = None if to is None else self.node(to, top)
            while at is not None and self.nodes[at][0] in self.reductions:
                head, body = self.reductions[self.nodes[at][0]]
                for _ in body:
                    at = self.nodes[at][1]
                at = self.node(self.gotos[self.nodes[at][0], head], at)
            self.pushed[top, symbol] = at
        return self.pushed[top, symbol]


#: Letters of a plan: K keep, D delete, and per role a letter for rerole and for insert. Audits have their initials.
REROLE, INSERT = {"u": "U", "a": "A"}, {"u": "x", "a": "y"}
AUDIT = str.maketrans({**{c: "R" for c in REROLE.values()}, **{c: "I" for c in INSERT.values()}})
ROLE_OF = {letter: ROLES[s] for letters in (REROLE, INSERT) for s, letter in letters.items()}


class Top(NamedTuple):
    node: int
    cost: int
    audit: str
    plan: str


class Parser:
    """The tops of the stacks, row by row."""

    def __init__(self, costs: Costs = Costs(), grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        self.costs, self.automaton = costs, Automaton(grammar)
        self.letters = sorted(set("".join(body for _, body in grammar)) - self.automaton.heads)
        self.step = lru_cache(1 << 16)(self._step)
        self.first = self.closed({0: Top(0, 0, "", "")})

    def kind(self, role: str, fault: str | None) -> tuple[str, bool, bool]:
        """(role's letter or empty, must go, truncated) of a row."""
        letter = role[:1]
        return letter if letter in self.letters else "", fault in (BLANK, DUPLICATE), fault == TRUNCATED

    def closed(self, tops: dict[int, Top]) -> tuple[Top, ...]:
        """The tops with all that inserts lead to, by node."""
        queue = deque(tops.values())
        while queue:
            top = queue.popleft()
            if tops[top.node] is not top:
                continue
            for letter in ROLES:
                to = self.automaton.push(top.node, letter)
                if to is not None:
                    queue.extend(self.better(tops, Top(to, top.cost + self.costs.insert, top.audit + "I", top.plan + INSERT[letter])))
        least = min(t.cost for t in tops.values())
        return tuple(sorted(t for t in tops.values() if t.cost <= least + self.costs.slack))

    @staticmethod
    def better(tops: dict[int, Top], new: Top) -> list[Top]:
        """Merges ``new`` into the tops by the smallest (cost, audit); [new] if it stays."""
        old = tops.get(new.node)
        if old is not None and (old.cost, old.audit) <= (new.cost, new.audit):
            return []
        tops[new.node] = new
        return [new]

    def _step(self, tops: tuple[Top, ...], kind: tuple[str, bool, bool]) -> tuple[tuple[Top, ...], int, str]:
        """(tops after a row, cost and plan that all of them have in common)."""
        letter, must_go, truncated = kind
        extra, after = self.costs.truncated * truncated, {}
        for top in tops:
            self.better(after, Top(top.node, top.cost + self.costs.delete, top.audit + "D", top.plan + "D"))
            for new in [] if must_go else {*ROLES, letter}:
                to = self.automaton.push(top.node, new) if new else None
                if to is not None:
                    edit, plan, cost = ("K", "K", 0) if new == letter else ("R", REROLE[new], self.costs.rerole)
                    self.better(after, Top(to, top.cost + cost + extra, top.audit + edit, top.plan + plan))
        return self.settled(self.closed(after))

    @staticmethod
    def settled(tops: tuple[Top, ...]) -> tuple[tuple[Top, ...], int, str]:
        plan, cost = os.path.commonprefix([t.plan for t in tops]), min(t.cost for t in tops)
        return tuple(Top(t.node, t.cost - cost, t.audit[len(plan) :], t.plan[len(plan) :]) for t in tops), cost, plan

    def last(self, tops: tuple[Top, ...]) -> tuple[int, str]:
        """(cost, plan) of the cheapest top at which the conversation may end."""
        ends = [t for t in tops if self.automaton.nodes[t.node][0] in self.automaton.accepting]
        best = min(ends, key=lambda t: (t.cost, t.audit))
        return best.cost, best.plan


class Repair:
    """Edits of one conversation: rows go in, edits come out as soon as they are settled."""

    def __init__(self, parser: Parser):
        self.parser, self.rows, self.cost = parser, deque(), 0
        self.tops, cost, plan = parser.settled(parser.first)
        self.cost += cost
        self.begun = plan

    def add(self, row: tuple, role: str, fault: str | None) -> Iterator[tuple]:
        self.rows.append(row)
        self.tops, cost, plan = self.parser.step(self.tops, self.parser.kind(role, fault))
        self.cost += cost
        yield from self.edits(plan)

    def end(self) -> Iterator[tuple]:
        cost, plan = self.parser.last(self.tops)
        self.cost += cost
        yield from self.edits(plan)

    def edits(self, plan: str) -> Iterator[tuple]:
        """(letter of the edit, row or None for an insert) of each edit of the plan."""
        for letter in self.begun + plan:
            yield letter, None if letter in INSERT.values() else self.rows.popleft()
        self.begun = ""


ROW_FIELDS = [("turn", T.LongType()), ("was", T.StringType()), ("fault", T.StringType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType()), ("total_cost", T.LongType())]


def faults(conversations: DataFrame, gone: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, text, fault, gone) in order within each partition, a conversation in one partition.

    ``gone`` marks rows that only name their conversation."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    gone = F.lit(False) if gone is None else gone
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    rows = rows.repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.asc_nulls_first("turn"))
    final = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(final == "", BLANK).when(F.col("again") > 1, DUPLICATE).when(~final.isin(*FINAL), TRUNCATED)
    rows = rows.withColumn("again", F.row_number().over(seen)).select("conv_id", "turn", "role", "text", fault.alias("fault"), "gone")
    return rows.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def repair_rows(conversations: DataFrame, gone: Column | None = None, costs: Costs = Costs()) -> DataFrame:
    """The edited rows of every conversation, in order: conv_id, turn, was (role before), fault, edit (K, R, D, I; null
    for a conversation without rows), role and text after it (null for deleted rows), total_cost (in the last row)."""
    rows = faults(conversations, gone)
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *(T.StructField(n, t) for n, t in ROW_FIELDS)])
    arrow = to_arrow_schema(schema)

    def edited(conv: object, edits: Iterator[tuple], out: list[tuple]) -> None:
        for letter, row in edits:
            turn, was, text, fault = row or (None, None, "", None)
            role = None if letter == "D" else ROLE_OF.get(letter, was)
            out.append((conv, turn, was, fault, letter.translate(AUDIT), role, None if letter == "D" else text, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, now, repair, some = Parser(costs), None, None, False

        def ended(out: list[tuple]) -> None:
            if repair is None:
                return
            before = len(out)
            edited(now, repair.end(), out)
            if len(out) > before:
                out[-1] = (*out[-1][:-1], repair.cost)
            else:  # all settled before, or no rows at all: the cost comes in a row of its own
                out.append((now, *[None] * 6, repair.cost))

        for batch in batches:
            out: list[tuple] = []
            for conv, turn, role, text, fault, away in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not some or conv != now:
                    ended(out)
                    now, repair, some = conv, Repair(parser), True
                if not away:
                    edited(now, repair.add((turn, role, text, fault), role, fault), out)
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)
        out = []
        ended(out)
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)

    ta.bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, schema)


#: Adjacent first letters of roles that are in order.
LEGAL = ("su", "ua", "au")
SUMMARY_FIELDS = [*((n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", T.StringType()), ("repaired_sha256", T.StringType())]


@dataclass
class Summary:
    """What is known of a conversation so far."""

    first: int | None = None
    last: int | None = None
    turns: int = 0
    before: str | None = None
    illegal: int = 0
    cost: int = 0

    def __post_init__(self):
        self.counts = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.audit: list[str] = []
        self.digest, self.begun = hashlib.sha256(), False

    def add(self, turn: int | None, was: str | None, fault: str | None, edit: str | None, role: str | None, text: str | None, cost: int | None) -> None:
        self.cost += cost or 0
        if edit is None:
            return
        self.audit.append(edit)
        if edit != "I":
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
            if fault:
                self.counts[fault] += 1
            self.illegal += self.before is not None and self.before + was[:1] not in LEGAL
            self.before = was[:1]
        if edit != "D":
            self.digest.update(("\n" * self.begun + f"{role}:{text}").encode())
            self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def summaries(edited: DataFrame) -> DataFrame:
    """One row per conversation from ``repair_rows`` (of which the partitions and the order are used)."""
    schema = T.StructType([edited.schema["conv_id"], *(T.StructField(n, t) for n, t in SUMMARY_FIELDS)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, summary = None, None
        for batch in batches:
            out = []
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if summary is None or conv != now:
                    if summary is not None:
                        out.append((now, *summary.row()))
                    now, summary = conv, Summary()
                summary.add(*rest)
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)
        if summary is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (now, *summary.row()), strict=True))], schema=arrow)

    return edited.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """The rows after the damage that crc32 of ``conv_id:turn`` modulo 20 chooses, and which of them are gone."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    text = F.when(what.isin(0, 1), "").when(what == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(what == 0, "").when(what == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (what == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(what == 3, 2).otherwise(1))).alias("copy"))
    return rows, F.col("dropped")


def repaired(conversations: DataFrame) -> DataFrame:
    """Counts, cost, audit and hash of every damaged and repaired conversation."""
    rows, dropped = damaged(conversations)
    return summaries(repair_rows(rows, dropped))
