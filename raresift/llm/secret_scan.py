"""Secret scan with one combined, minimised automaton.

All rules are compiled together: each rule's *head* (the part up to the first character of its value) becomes an NFA over
bytes, the union is determinised by subset construction and minimised by partition refinement, and every text is read
once, one transition per byte, for all rules. A head that ends at a byte is then completed by the run of its tail class.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from re import _constants as sre, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


@dataclass(frozen=True)
class Rule:
    """``head`` ends with the first character of the value, ``tail`` is the class of the rest.

    Matches are leftmost, greedy and non-overlapping; those that fail ``check`` (a full-match pattern) are then dropped.
    """

    kind: str
    head: str
    tail: str
    check: str


BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
        r"[A-Za-z0-9+/_.=-]",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}""",
    ),
    Rule("access", r"AKIA[A-Z0-9]", r"[A-Z0-9]", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16}", r"[0-9a-f]", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]", r"[A-Za-z0-9]", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]", r"[A-Za-z0-9-]", r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]", r"[A-Za-z0-9_-]", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]", r"[A-Za-z0-9_.-]", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY--", r"-", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


class _Nfa:
    """Thompson construction over byte sets, from the standard library's parse of a pattern."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, items: Iterable, start: int, fold: bool = False) -> int:
        """Append the parsed ``items`` after ``start``; returns the state behind them."""
        for op, arg in items:
            start = self._one(op, arg, start, fold)
        return start

    def _step(self, chars: Iterable[int], start: int, fold: bool) -> int:
        chars = set(chars)
        if fold:
            for c in list(chars):
                if chr(c).isalpha():
                    chars |= {ord(chr(c).lower()), ord(chr(c).upper())}
        end = self.state()
        self.moves[start].append((frozenset(chars), end))
        return end

    def _one(self, op, arg, start: int, fold: bool) -> int:
        if op is sre.LITERAL:
            return self._step([arg], start, fold)
        if op is sre.IN:
            return self._step(_members(arg), start, fold)
        if op is sre.SUBPATTERN:
            return self.add(arg[3], start, fold or bool(arg[1] & re.IGNORECASE))
        if op is sre.BRANCH:
            end = self.state()
            for branch in arg[1]:
                self.free[self.add(branch, start, fold)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            least, most, body = arg
            for _ in range(least):
                start = self.add(body, start, fold)
            if most is sre.MAXREPEAT:
                loop = self.state()
                self.free[start].append(loop)
                self.free[self.add(body, loop, fold)].append(loop)
                return loop
            end = self.state()
            self.free[start].append(end)
            for _ in range(most - least):
                start = self.add(body, start, fold)
                self.free[start].append(end)
            return end
        raise ValueError(f"rule syntax not supported: {op}")

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def reverse(self) -> _Nfa:
        back = _Nfa()
        for _ in self.moves:
            back.state()
        for s, moves in enumerate(self.moves):
            for chars, end in moves:
                back.moves[end].append((chars, s))
            for end in self.free[s]:
                back.free[end].append(s)
        return back


def _members(arg) -> set[int]:
    found: set[int] = set()
    for op, value in arg:
        found |= {value} if op is sre.LITERAL else set(range(value[0], value[1] + 1))
    return found


def _members_of(pattern: str) -> frozenset[int]:
    ((op, arg),) = _parser.parse(pattern.encode())
    return frozenset(_members(arg) if op is sre.IN else {arg})


@dataclass(frozen=True)
class Automaton:
    """``table[state, byte]`` is the next state, ``accepts[state]`` a bit per rule; state 0 is the start."""

    table: np.ndarray
    accepts: np.ndarray

    def rows(self) -> list[list]:
        """Rows that refer to each other directly, with the accepted rules at position 256."""
        rows: list[list] = [[] for _ in self.accepts]
        for row, to, bits in zip(rows, self.table.tolist(), self.accepts.tolist(), strict=True):
            row.extend(rows[s] for s in to)
            row.append(bits)
        return rows


def determinise(nfa: _Nfa, starts: Iterable[int], finals: dict[int, int]) -> Automaton:
    """Subset construction on byte classes, then minimisation by refining the partition of equal accept bits."""
    sets = {chars for moves in nfa.moves for chars, _ in moves}
    kinds: dict[tuple[bool, ...], list[int]] = {}
    for b in range(256):
        kinds.setdefault(tuple(b in s for s in sets), []).append(b)
    groups = list(kinds.values())
    first = nfa.closure(starts)
    ids, order, table = {first: 0}, [first], []
    for subset in order:
        row = []
        for group in groups:
            to = nfa.closure({end for s in subset for chars, end in nfa.moves[s] if group[0] in chars})
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        table.append(row)
    narrow = np.array(table)
    accepts = np.array([sum({1 << finals[s] for s in subset if s in finals}) for subset in order])
    block, count = accepts, 0
    while True:
        _, firsts, block = np.unique(np.column_stack([block, block[narrow]]), axis=0, return_index=True, return_inverse=True)
        block = block.ravel()
        if len(firsts) == count:
            break
        count = len(firsts)
    renamed = np.empty(count, int)
    renamed[block[np.sort(firsts)]] = np.arange(count)  # the start state comes first
    keep = np.sort(firsts)
    wide = np.empty((count, 256), np.int32)
    for k, group in enumerate(groups):
        wide[:, group] = renamed[block[narrow[keep, k]]][:, None]
    return Automaton(wide, accepts[keep])


def compile_rules(rules: Iterable[Rule]) -> tuple[Automaton, list[Automaton]]:
    """The combined forward automaton, and each rule's backward one for finding where a head starts."""
    nfa, backs, finals = _Nfa(), [], {}
    root = nfa.state()
    nfa.moves[root].append((frozenset(range(256)), root))  # a head may start anywhere
    for k, rule in enumerate(rules):
        parsed = _parser.parse(rule.head.encode())
        start = nfa.state()
        nfa.free[root].append(start)
        finals[nfa.add(parsed, start)] = k
        alone = _Nfa()
        begin = alone.state()
        end = alone.add(parsed, begin)
        backs.append(determinise(alone.reverse(), [end], {begin: 0}))
    return determinise(nfa, [root], finals), backs


class Scanner:
    """Spans of all rules in one text; built once per task from the transition arrays."""

    def __init__(self, rules: tuple[Rule, ...], forward: Automaton, backs: list[Automaton]) -> None:
        self.kinds = [r.kind for r in rules]
        self.start = forward.rows()[0]
        self.backs = [b.rows()[0] for b in backs]
        self.tails = [_members_of(r.tail) for r in rules]
        self.checks = [re.compile(r.check.encode()) for r in rules]

    def __call__(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, end exclusive, by start and then by the order of the rules."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        found, over, row, at = [], [0] * len(self.kinds), self.start, 0
        for byte in data:
            row = row[byte]
            at += 1
            if row[256]:
                for k in range(len(over)):
                    if row[256] >> k & 1 and at > over[k]:
                        start = self._head_start(data, at, k, over[k])
                        if start is not None:
                            end, tail = at, self.tails[k]
                            while end < len(data) and data[end] in tail:
                                end += 1
                            over[k] = end
                            if self.checks[k].fullmatch(data, start, end):
                                found.append((start, k, end))
        found.sort()
        if len(data) != len(text):
            found = _code_points(data, found)
        return [(self.kinds[k], start, end) for start, k, end in found]

    def _head_start(self, data: bytes, at: int, k: int, least: int) -> int | None:
        row, start = self.backs[k], None
        while at > least:
            row = row[data[at - 1]]
            at -= 1
            if row[256]:
                start = at
            if row is row[0] and not row[256]:  # the dead state: nothing leaves it
                break
        return start


def _code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets to code points; offsets are read in order, so the text is counted once."""
    points, seen, count = {}, 0, 0
    for offset in sorted({x for start, _, end in found for x in (start, end)}):
        count += len(data[seen:offset].decode("utf-8", "surrogatepass"))
        seen = offset
        points[offset] = count
    return [(points[start], k, points[end]) for start, k, end in found]


def scan_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text_col: str = "text", out: str = "spans") -> DataFrame:
    """Every row of ``docs`` with all its columns and ``out``, an array of (kind, start, end) over the whole text.

    A NULL or empty text has no spans. A column already named ``out`` is replaced. Rows are independent: equal rows get
    equal spans, other columns (NULL or not) pass through, and an empty table gives an empty table.
    """
    forward, backs = compile_rules(rules)
    kept = [c for c in docs.columns if c.lower() != out.lower()]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(out, SPANS)])
    place = [c.lower() for c in kept].index(text_col.lower())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, forward, backs)
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scanner(t.as_py())] for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _ARROW_SPANS)], [*batch.schema.names, out])

    return docs.select(*kept).mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]``; overlapping spans become one, named by the first.

    Columns and rows are otherwise unchanged; ``count_col``, if given, gets the new length of changed texts. NULL and
    empty texts stay as they are.
    """
    forward, backs = compile_rules(rules)
    names = [c.lower() for c in docs.columns]
    place, count_at = names.index(text_col.lower()), names.index(count_col.lower()) if count_col else None

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, forward, backs)
        for batch in batches:
            columns = list(batch.columns)
            before = columns[place].to_pylist()
            after = [replace_spans(t, scanner(t)) for t in before]
            columns[place] = pa.array(after, columns[place].type)
            if count_at is not None:
                old = columns[count_at]
                counts = [n if a is b else len(a) for a, b, n in zip(after, before, old.to_pylist(), strict=True)]
                columns[count_at] = pa.array(counts, old.type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(redact, docs.schema)


def replace_spans(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def joined(spans: str, kinds: Iterable[str] | None = None):
    """``kind:start:end`` of an array of spans, comma-joined, as a column."""
    column = F.col(spans)
    if kinds is not None:
        column = F.filter(column, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and digests of the base kinds, and all spans as text, one row per document."""
    found = scan_secrets(docs.select("doc_id", "text"), out="__spans").drop("text")
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined("__spans", base), 256).alias("base_sha256"), joined("__spans").alias("spans"),
    )
