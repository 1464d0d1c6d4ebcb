"""Secrets in texts: all rules in one deterministic automaton over bytes, one pass a text.

A rule is a head, a tail and the least number of characters its tail must have. Heads and
tails are small regular expressions. The automata are made on the driver by subset
construction over byte classes, minimised by splitting of blocks, and laid out as one flat
transition array: ``table[state + byte]``.

* The search automaton knows all rules at once; it says at which byte some rule first holds.
* A reversed automaton of the rule, run backwards from there, finds where the match begins.
* Forward automata of head and tail, run from the beginning, find where both end.

The last two touch the bytes of matches only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import ready, slices


@dataclass(frozen=True)
class Rule:
    """``kind`` matches ``head`` then ``tail`` (as long as possible, ``least`` characters or more).

    Syntax: literal ASCII characters, classes ``[a-z_]``, groups with ``|``, and the repeats
    ``? * + {n}``; ``nocase`` lets the letters of the head be in either case.
    """

    kind: str
    head: str
    tail: str
    least: int
    nocase: bool = False


#: The base kinds in the order in which they are listed.
BASE = (
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?", "[A-Za-z0-9+/_.=-]+", 6, True),
    Rule("access", "AKIA", "[A-Z0-9]+", 16),
    Rule("hex", "", "[0-9a-f]{24}[0-9a-f]*", 24),
)
#: What follows the first line of a PEM key: header lines and base64 through the END marker. Line breaks may be
#: written out as in JSON, and lines be quoted, indented or joined. Without the marker the tail is header lines, then
#: base64 at the beginnings of lines and in runs of 16 characters or more behind spaces.
_BREAK = "[ \t\"'+,;\\\\]*(\r?\n|\r|[\\\\]r[\\\\]n|[\\\\]n)[ \t\"'>#*|+]*-?[ \t]*"
_VALUE = " *: *[ !#-~\t]*"
_HEADER = f"([A-Z][A-Za-z0-9]*-[A-Za-z0-9-]+|Comment|Subject|Version){_VALUE}"
_LONG = "[A-Za-z0-9+/]{16}[A-Za-z0-9+/]*=*"
KEY_BODY = (
    f"([A-Za-z0-9+/= \t\r\n\\\\\"'>,;#*|]|\n-|[A-Za-z0-9-]+{_VALUE}(\r|\n|[\\\\]n))*-----END [A-Z ]*PRIVATE KEY-----"
    f"|(({_BREAK})+{_HEADER})*(({_BREAK})+[A-Za-z0-9+/]+=*| *{_LONG}| +[A-Za-z0-9+/]+==?)*"
)
#: Further kinds; their tails follow a fixed prefix.
MORE = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]+", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]+", 35),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", KEY_BODY, 0),
)
RULES = BASE + MORE


# --- expressions -> nondeterministic automata ------------------------------------------------


def parse(text: str, nocase: bool):
    """A tree of ("set", bytes), ("cat", …), ("alt", …), ("star", x) for one expression."""
    at = 0

    def either(b: int) -> frozenset[int]:
        return frozenset({b, ord(chr(b).swapcase())}) if nocase and chr(b).isalpha() else frozenset({b})

    def char_class():
        nonlocal at
        found: set[int] = set()
        while text[at] != "]":
            if text[at] == "\\":
                at += 1
            low = high = ord(text[at])
            at += 1
            if text[at] == "-" and text[at + 1] != "]":
                high = ord(text[at + 1])
                at += 2
            for b in range(low, high + 1):
                found |= either(b) if nocase else {b}
        at += 1
        return ("set", frozenset(found))

    def choice():
        nonlocal at
        branches = [sequence()]
        while at < len(text) and text[at] == "|":
            at += 1
            branches.append(sequence())
        return branches[0] if len(branches) == 1 else ("alt", *branches)

    def sequence():
        nonlocal at
        parts = []
        while at < len(text) and text[at] not in "|)":
            c = text[at]
            at += 1
            if c == "[":
                item = char_class()
            elif c == "(":
                item = choice()
                at += 1
            else:
                item = ("set", either(ord(c)))
            if at < len(text) and text[at] in "?*+":
                item = {"?": ("alt", item, ("cat",)), "*": ("star", item), "+": ("cat", item, ("star", item))}[text[at]]
                at += 1
            elif at < len(text) and text[at] == "{":
                close = text.index("}", at)
                item = ("cat", *[item] * int(text[at + 1 : close]))
                at = close + 1
            parts.append(item)
        return ("cat", *parts)

    return choice()


def turned(tree):
    """The tree of the reversed language."""
    kind, *parts = tree
    if kind == "set":
        return tree
    parts = [turned(p) for p in parts]
    return (kind, *(reversed(parts) if kind == "cat" else parts))


class States:
    """A nondeterministic automaton: moves on byte sets and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def new(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, tree, start: int) -> int:
        """Add the tree behind ``start``; the state in which it ends."""
        kind, *parts = tree
        if kind == "set":
            end = self.new()
            self.moves[start].append((parts[0], end))
            return end
        if kind == "cat":
            for part in parts:
                start = self.add(part, start)
            return start
        if kind == "alt":
            ends = []
            for part in parts:
                begin = self.new()
                self.empty[start].append(begin)
                ends.append(self.add(part, begin))
            end = self.new()
            for e in ends:
                self.empty[e].append(end)
            return end
        loop = self.new()
        self.empty[start].append(loop)
        self.empty[self.add(parts[0], loop)].append(loop)
        return loop

    def closed(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


# --- subset construction, minimisation, layout -----------------------------------------------


@dataclass(frozen=True)
class Automaton:
    """``table[state + byte]`` is the next state; states are multiples of 256.

    States from ``accepting`` up accept; ``rules[(state - accepting) // 256]`` are the numbers
    of the rules they accept. State ``dead`` never accepts again (-1 if there is none).
    """

    table: tuple[int, ...]
    start: int
    accepting: int
    rules: tuple[tuple[int, ...], ...]
    dead: int


def determinise(trees: list, search: bool) -> Automaton:
    """The minimal automaton of all trees; with ``search`` a match may begin at any byte."""
    nfa = States()
    begin = nfa.new()
    ends = {}
    for number, tree in enumerate(trees):
        first = nfa.new()
        nfa.empty[begin].append(first)
        ends[nfa.add(tree, first)] = number
    sets = {s for moves in nfa.moves for s, _ in moves}
    classes: dict[tuple, list[int]] = {}
    for b in range(256):
        classes.setdefault(tuple(b in s for s in sorted(sets, key=sorted)), []).append(b)
    letters = list(classes.values())

    initial = nfa.closed([begin])
    numbers = {initial: 0}
    order, steps = [initial], []
    for here in order:
        row = []
        for members in letters:
            reached = {t for q in here for s, t in nfa.moves[q] if members[0] in s}
            there = nfa.closed(reached | ({begin} if search else set()))
            if there not in numbers:
                numbers[there] = len(order)
                order.append(there)
            row.append(numbers[there])
        steps.append(row)

    accepts = [tuple(sorted({ends[q] for q in s if q in ends})) for s in order]
    kinds = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    block = [kinds[a] for a in accepts]
    while True:  # split blocks until equal states move to equal blocks
        keys = [(block[i], *(block[t] for t in steps[i])) for i in range(len(order))]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        split = [names[k] for k in keys]
        if len(names) == len(set(block)):
            break
        block = split
    first_of: dict[int, int] = {}
    for i, b in enumerate(block):
        first_of.setdefault(b, i)
    kept = sorted(first_of, key=lambda b: bool(accepts[first_of[b]]))
    place = {b: 256 * i for i, b in enumerate(kept)}
    table: list[int] = []
    for b in kept:
        row = [0] * 256
        for letter, members in enumerate(letters):
            for byte in members:
                row[byte] = place[block[steps[first_of[b]][letter]]]
        table += row
    plain = [b for b in kept if not accepts[first_of[b]]]
    dead = [place[b] for b in plain if all(x == place[b] for x in table[place[b] : place[b] + 256])]
    return Automaton(
        tuple(table),
        place[block[0]],
        256 * len(plain),
        tuple(accepts[first_of[b]] for b in kept[len(plain) :]),
        dead[0] if dead else -1,
    )


@dataclass(frozen=True)
class Scanner:
    """The automata of a list of rules."""

    rules: tuple[Rule, ...]
    search: Automaton
    back: tuple[Automaton, ...]
    heads: tuple[Automaton, ...]
    tails: tuple[Automaton, ...]


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Scanner:
    heads = [parse(r.head, r.nocase) for r in rules]
    tails = [parse(r.tail, False) for r in rules]
    ends = [determinise([t], False) for t in tails]
    # where the tail may be empty, the head alone says that and where a match begins
    whole = [h if e.start >= e.accepting else ("cat", h, t) for h, t, e in zip(heads, tails, ends)]
    return Scanner(
        rules,
        determinise(whole, True),
        tuple(determinise([turned(t)], False) for t in whole),
        tuple(determinise([h], False) for h in heads),
        tuple(ends),
    )


# --- scanning --------------------------------------------------------------------------------


def _furthest(dfa: Automaton, data: bytes, at: int, stop: int, step: int) -> int:
    """The furthest place an anchored run from ``at`` accepts; -1 if none."""
    state, table = dfa.start, dfa.table
    best = at if state >= dfa.accepting else -1
    while at != stop:
        state = table[state + data[at if step > 0 else at - 1]]
        at += step
        if state >= dfa.accepting:
            best = at
        elif state == dfa.dead:
            break
    return best


def scan(scanner: Scanner, data: bytes) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in bytes, sorted; per rule leftmost and not overlapping.

    A match whose tail is too short is dropped after it has used up its bytes.
    """
    table, accepting, named = scanner.search.table, scanner.search.accepting, scanner.search.rules
    state = scanner.search.start
    used = [0] * len(scanner.rules)
    found = []
    for at, byte in enumerate(data, 1):
        state = table[state + byte]
        if state >= accepting:
            for number in named[(state - accepting) >> 8]:
                if at <= used[number]:
                    continue
                start = _furthest(scanner.back[number], data, at, used[number], -1)
                if start < 0:
                    continue
                middle = _furthest(scanner.heads[number], data, start, len(data), 1)
                end = _furthest(scanner.tails[number], data, middle, len(data), 1)
                used[number] = end
                if end - middle >= scanner.rules[number].least:
                    found.append((start, number, end))
    return sorted(found)


def _points(data: bytes, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same matches in code points."""
    if not matches or data.isascii():
        return matches
    at = points = 0
    place = {}
    for b in sorted({x for s, _, e in matches for x in (s, e)}):
        points += len(data[at:b].decode())
        at = place[b] = b
        place[b] = points
    return [(place[s], n, place[e]) for s, n, e in matches]


def find_secrets(
    spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``key`` and ``spans``: array of (kind, start, end) in code points, end exclusive, for every row.

    Spans are sorted by start, then by the order of the rules. Null and empty texts have none.
    Rows are neither merged nor dropped; other columns of ``df`` are not read.
    """
    scanner = ready(spark).sparkContext.broadcast(compile_rules(rules))
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = rows.schema["key"].dataType
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = scanner.value
        for part in slices(batches, "text"):
            out = []
            for t in part.column("text").to_pylist():
                data = (t or "").encode()
                out.append(
                    [
                        {"kind": automata.rules[n].kind, "start": s, "end": e}
                        for s, n, e in _points(data, scan(automata, data))
                    ]
                )
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, span)], ["key", "spans"])

    schema = f"key {kind.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def redact(spark: SparkSession, df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every secret in ``text`` replaced by ``[kind]``; ``n_chars`` follows the text.

    Overlapping spans become one, named after the first. A null text stays null. Columns and
    their order are kept.
    """
    scanner = ready(spark).sparkContext.broadcast(compile_rules(rules))

    @F.pandas_udf("string")
    def clean(texts):
        automata = scanner.value

        def one(t):
            if t is None or t != t:
                return None
            out, at = [], 0
            data = t.encode()
            for s, n, e in _points(data, scan(automata, data)):
                if s >= at:
                    out += [t[at:s], f"[{automata.rules[n].kind}]"]
                at = max(at, e)
            return "".join([*out, t[at:]])

        return texts.map(one, na_action=None)

    changed = df.withColumn("text", clean("text"))
    return changed.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))
