"""Personal data in texts: base patterns, and a semi-Markov conditional random field that adds spans.

The field scores whole candidate segments: how the digits are grouped, what separates them, the
check digit, the parts of an address, what stands on both sides and which word came before. A
labelling is a row of segments, entities of a kind or single tokens outside; its score is the sum
of the segments' weights and of a weight for entities that touch. Entities are bounded (TOKENS
tokens), so the best labelling of a stretch comes from dynamic programming over its candidates,
which chooses boundaries and kinds together. Text without a digit, an at sign or a written-out
"at" has no candidate and costs one search.

The weights are learned here by the conditional likelihood (forward-backward over the same
candidates), from a bounded sample: stretches with their base spans as truth, the same stretches
with a span rewritten (an address in words, a phone number without its plus, …) or replaced by a
decoy (failing check digit, dates, versions, …), and carrier sentences of the same make, so that
a corpus without any hit has a defined model too.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush, merge
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import ready, slices

#: The kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity at most; characters kept around a trigger; stretches learned from and their length at most.
TOKENS, AROUND, SAMPLE, STRETCH = 24, 96, 1000, 600
#: Texts that the stretches are looked for in.
TEXTS = 20_000
#: Runs of digits of an entity at most.
GROUPS = 7
#: What an entity must score above the outside labelling.
MARGIN = 2.0
EPOCHS, RATE, SHRINK = 12, 0.3, 1e-4

Span = tuple[str, int, int]

# --- base patterns ---------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can only begin at the first digit of a run: what fails there fails further right in the run
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass their check, by start, then kind."""
    found = list(_emails(text))
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.groups())]
    for kind, pattern, least, most in (("card", _CARD, 14, 19), ("phone", _PHONE, 10, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- candidates and their features ------------------------------------------------------------

_AT = r"(?:\s?@\s?|\s{0,2}[(\[{]\s{0,2}(?:at|@)\s{0,2}[)\]}]\s{0,2}|\s{1,2}at\s{1,2})"
_DOT = r"(?:\.|\s{0,2}[(\[{]\s{0,2}(?:dot|\.)\s{0,2}[)\]}]\s{0,2}|\s{1,2}dot\s{1,2}|\s\.\s)"
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\s{0,2}at\s{0,2}[)\]}]|\sat\s{1,2}[A-Za-z0-9-]{1,63}\s{1,2}dot\s", re.I)
_SIGN = re.compile(_AT, re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", re.I)
_STEP = re.compile(_DOT, re.I)
_NAME = re.compile(rf"[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+)*$", re.I)
_RUN = re.compile("[0-9]+")
_GAP = re.compile(r"\s{0,2}(?:[()\[\].\-/]{1,3}\s?|[(\[{]\s?dot\s?[)\]}]\s?|dot\s)?$", re.I)
_DOTS = re.compile(rf"{_DOT}$", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
#: Words that announce a kind.
CUES = {
    **dict.fromkeys("email e-mail mail contact mailto write".split(), "email"),
    **dict.fromkeys("phone tel telephone call fax mobile cell".split(), "phone"),
    **dict.fromkeys("card visa mastercard credit debit payment".split(), "card"),
    **dict.fromkeys("ip host server address node".split(), "ip"),
    **dict.fromkeys("version order invoice isbn date no number page id ref".split(), "other"),
}


@dataclass
class Candidate:
    start: int
    end: int
    kind: int
    names: list[str] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)


def _side(c: str) -> str:
    if not c:
        return "none"
    return "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c


def _size(n: int) -> str:
    return str(n) if n < 4 else "4-7" if n < 8 else "8-15" if n < 16 else "16+"


def _around(text: str, start: int, end: int) -> list[str]:
    after = _side(text[end : end + 1])
    if after in ".,-:/":
        after += _side(text[end + 1 : end + 2])
    words = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, start - 24) : start])
    return [f"left={_side(text[start - 1 : start] if start else '')}", f"right={after}", f"cue={CUES.get(words[-1].lower(), '') if words else ''}"]


def _digit_candidates(text: str) -> Iterator[Candidate]:
    """Segments of up to GROUPS runs of digits, by start."""
    ahead: list[re.Match] = []
    runs = _RUN.finditer(text)
    while True:
        while len(ahead) < GROUPS and (run := next(runs, None)):
            ahead.append(run)
        if not ahead:
            return
        yield from sorted(_from_run(text, ahead), key=lambda c: c.start)
        ahead.pop(0)


def _from_run(text: str, runs: list[re.Match]) -> Iterator[Candidate]:
    first = runs[0].start()
    digits, groups, gaps = "", [], []
    for j, run in enumerate(runs):
        a, b = run.span()
        if j:
            gap = text[runs[j - 1].end() : a]
            if len(gap) > 9 or not _GAP.match(gap):
                return
            gaps.append(_spaced(gap))
        if len(digits) + b - a > 19:
            return
        digits += text[a:b]
        groups.append(b - a)
        if len(digits) < 7 and j != 3:
            continue
        shape = ["groups=" + "-".join(map(str, groups)), "gaps=" + "|".join(sorted(set(gaps)))]
        if j == 3 and max(groups) < 4 and all(_DOTS.match(text[x.end() : y.start()]) for x, y in pairwise(runs[:4])):
            parts = [r[0] for r in runs[:4]]
            zeros = any(len(p) > 1 and p[0] == "0" for p in parts)
            yield Candidate(first, b, 1, [shape[1], f"small={all(int(p) < 256 for p in parts)}", f"zeros={zeros}"])
        if 13 <= len(digits):
            yield Candidate(first, b, 2, [*shape, f"check={luhn(digits)}", f"same={len(set(groups)) == 1}", f"n={len(digits)}"])
        if 7 <= len(digits) <= 15:
            for lead in ("", "(", "+", "+("):
                start = first - len(lead)
                if start >= 0 and text[start:first] == lead:
                    closed = "(" in lead and ")" in "".join(gaps[:1])
                    yield Candidate(start, b, 3, [*shape, f"lead={lead}", f"n={len(digits)}", f"zero={digits[:2] == '00'}", f"closed={closed}"])


def _spaced(gap: str) -> str:
    return re.sub(r"\s+", "_", gap)


def _mail_candidates(text: str) -> Iterator[Candidate]:
    for sign in _SIGN.finditer(text):
        host = _HOST.match(text, sign.end())
        if not host:
            continue
        left = text[max(0, sign.start() - 64) : sign.start()]
        name = _NAME.search(left)
        if not name:
            continue
        starts = [m.start() for m in re.finditer(r"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]", name[0])][-TOKENS // 4 :]
        steps = list(_STEP.finditer(host[0]))
        ends = [s.start() for s in steps[1:]] + [len(host[0])]
        form = _spaced(sign[0].lower())
        for s in starts:
            who = name[0][s:]
            for k, e in enumerate(ends):
                dots = {_spaced(d[0].lower()) for d in steps[: k + 1]}
                last = host[0][steps[k].end() : e]
                names = [
                    f"at={form}",
                    "dots=" + "|".join(sorted(dots)),
                    f"both={form}&{'|'.join(sorted(dots))}",
                    f"last={'letters' if last.isalpha() else 'mixed'}{_size(len(last))}",
                    f"end={last.lower() if len(last) < 7 else ''}",
                    f"name={_size(len(who))}",
                    f"apart={bool(re.search(r'\s', who))}",
                    f"more={bool(steps[k + 1 :])}",
                    f"labels={_size(k + 2)}",
                ]
                yield Candidate(sign.start() - len(name[0]) + s, host.start() + e, 0, names)


def candidates(text: str) -> Iterator[Candidate]:
    """All segments of a stretch that may be an entity, by start, with the names of their features."""
    mails = sorted(_mail_candidates(text), key=lambda c: c.start)
    for c in merge(_digit_candidates(text), mails, key=lambda c: c.start):
        if c.end - c.start <= TOKENS or len(_TOKEN.findall(text, c.start, c.end)) <= TOKENS:
            c.names = [f"{KINDS[c.kind]}:{n}" for n in ("bias", *c.names, *_around(text, c.start, c.end))]
            yield c


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts of a text that may hold candidates, with what stands around them."""
    start = end = None
    for m in _TRIGGER.finditer(text):
        if start is None:
            start, end = m.start() - AROUND, m.end() + AROUND
        elif m.start() - AROUND <= end:
            end = m.end() + AROUND
        else:
            yield max(0, start), min(len(text), end)
            start, end = m.start() - AROUND, m.end() + AROUND
    if start is not None:
        yield max(0, start), min(len(text), end)


# --- the field --------------------------------------------------------------------------------


def _sum(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(v - top) for v in values))


@dataclass
class Field:
    """``weights`` by feature name; ``touch``: weight of an entity that begins where another ends."""

    weights: dict[str, float]
    touch: float = -1.0

    def score(self, c: Candidate) -> float:
        return sum(self.weights.get(n, 0.0) for n in c.names)

    def decode(self, segments: Iterable[Candidate], margin: float = MARGIN) -> list[Candidate]:
        """The best labelling of a stretch, segments given by start; equal scores take fewer entities.

        Only entities that reach beyond the current place and the best chains are held.
        """
        best, here = (0.0, ()), (-1, -math.inf, ())  # last thing outside; entity that ends at a place
        waiting: list[tuple] = []
        for number, c in enumerate(segments):
            while waiting and waiting[0][0] <= c.start:
                end, _, score, chain = heappop(waiting)
                if end > here[0]:
                    best = max(best, here[1:], key=lambda x: x[0])
                    here = (end, score, chain)
                elif score > here[1]:
                    here = (end, score, chain)
            if here[0] < c.start:
                best, here = max(best, here[1:], key=lambda x: x[0]), (-1, -math.inf, ())
            before = best
            if here[0] == c.start and here[1] + self.touch > best[0]:
                before = (here[1] + self.touch, here[2])
            heappush(waiting, (c.end, number, before[0] + self.score(c) - margin, (before[1], (c.kind, c.start, c.end))))
        chain, found = max([best, here[1:], *(w[2:] for w in waiting)], key=lambda x: x[0])[1], []
        while chain:
            chain, c = chain
            found.append(Candidate(c[1], c[2], c[0]))
        return found[::-1]


def expectations(segments: list[Candidate], scores: list[float], touch: float) -> tuple[float, list[float], float]:
    """Log of the partition sum, probability of each segment, expected number of touching entities."""
    places = sorted({p for c in segments for p in (c.start, c.end)})
    at = {p: i for i, p in enumerate(places)}
    ends, starts = defaultdict(list), defaultdict(list)
    for i, c in enumerate(segments):
        ends[at[c.end]].append(i)
        starts[at[c.start]].append(i)
    n = len(places)
    out, ent = [-math.inf] * n, [-math.inf] * n  # forward: last thing outside, last thing an entity
    out[0] = 0.0
    for p in range(n):
        if p:
            out[p] = _sum([out[p - 1], ent[p - 1]])
        ent[p] = _sum([scores[i] + _sum([out[at[segments[i].start]], ent[at[segments[i].start]] + touch]) for i in ends[p]])
    total = _sum([out[-1], ent[-1]])
    after_out, after_ent = [0.0] * n, [0.0] * n  # backward
    for p in range(n - 2, -1, -1):
        step = after_out[p + 1]
        begun = _sum([scores[i] + after_ent[at[segments[i].end]] for i in starts[p]])
        after_out[p], after_ent[p] = _sum([step, begun]), _sum([step, begun + touch])
    chances, touching = [], 0.0
    for i, c in enumerate(segments):
        a, b = at[c.start], at[c.end]
        rest = scores[i] + after_ent[b] - total
        chances.append(math.exp(_sum([out[a], ent[a] + touch]) + rest))
        touching += math.exp(ent[a] + touch + rest)
    return total, chances, touching


def fit(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = 7) -> Field:
    """Weights of the greatest conditional likelihood, by gradient steps with adapted rates."""
    ids: dict[str, int] = {}
    prepared = []
    for text, gold in examples:
        segments = list(candidates(text))
        spans = {(c.kind, c.start, c.end): i for i, c in enumerate(segments)}
        truth = [spans.get((KINDS.index(k), a, b)) for k, a, b in gold]
        # truth must be a labelling: all of its spans are candidates and apart
        if not segments or None in truth or any(x[2] > y[1] for x, y in zip(gold, gold[1:])):
            continue
        for c in segments:
            c.ids = [ids.setdefault(n, len(ids)) for n in c.names]
        touching = sum(x[2] == y[1] for x, y in zip(gold, gold[1:]))
        prepared.append((segments, set(truth), touching))
    weights, squares = [0.0] * len(ids), [1e-6] * len(ids)
    touch, touch_square = -1.0, 1e-6
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(prepared)
        for segments, truth, touching in prepared:
            scores = [sum(weights[f] for f in c.ids) for c in segments]
            _, chances, expected = expectations(segments, scores, touch)
            change = defaultdict(float)
            for i, c in enumerate(segments):
                g = (i in truth) - chances[i]
                if abs(g) > 1e-4:
                    for f in c.ids:
                        change[f] += g
            for f, g in change.items():
                g -= SHRINK * weights[f]
                squares[f] += g * g
                weights[f] += RATE * g / math.sqrt(squares[f])
            g = touching - expected
            touch_square += g * g
            touch += RATE * g / math.sqrt(touch_square)
    return Field({n: weights[i] for n, i in ids.items()}, touch)


# --- examples ---------------------------------------------------------------------------------

#: Sentences that carry a span in the examples.
CARRIERS = (
    "{}", "Write to {} today.", "the {} was", "Contact: {}", "call {} or", "card {}, please", "host {} is down", "see {}.", "({})", "was {} and {} then",
)


def _variant(kind: str, text: str, rng: random.Random) -> str:
    """A base span in a form that its pattern misses."""
    if kind == "email":
        at = rng.choice([" (at) ", "(at)", "[at]", " [at] ", "{at}", " @ ", " at ", " AT "])
        dot = " dot " if at.strip().lower() == "at" else rng.choice([".", ".", " dot ", " (dot) ", "(dot)", "[dot]", "[.]"])
        return text.replace("@", at).replace(".", dot)
    if kind == "ip":
        return text.replace(".", rng.choice(["[.]", "(.)", " . ", " dot ", "[dot]", " (dot) "]))
    digits = re.sub("[^0-9]", "", text)
    if kind == "card":
        gap = rng.choice([".", "  ", "/", " - "])
        return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    shape = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}-{}", "1-{}-{}-{}", "001 {} {} {}", "00 49 {} {} {}", "0{} / {} {}"])
    return shape.format(last[:3], last[3:6], last[6:])


def _decoy(rng: random.Random) -> str:
    """Something with digits or an at sign that is no personal data."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    w = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    while luhn(bad := d(16)):
        pass
    kind = rng.randrange(16)
    return [
        bad, "-".join(bad[i : i + 4] for i in range(0, 16, 4)), f"{rng.randint(256, 999)}.{d(3)}.{d(2)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}",
        f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{d(2)}.{d(2)}.{rng.randint(1900, 2030)}",
        f"{d(2)}/{d(2)}/{rng.randint(1900, 2030)}", f"{d(3)},{d(3)}.{d(2)}", f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}",
        f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", d(rng.randint(7, 13)), f"{d(3)}-{d(4)}", "look @ this", f"be at {w()} dot {w()}", f"{d(4)} {d(4)}",
        f"{d(3)} {d(3)} {d(3)} {d(3)}",
    ][kind]


def _fresh(kind: str, rng: random.Random) -> str:
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    w = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    if kind == "email":
        return f"{w()}{rng.choice(['.', '_', '', '-'])}{rng.choice([w(), d(2)])}@{w()}.{rng.choice(['', w() + '.'])}{rng.choice(['com', 'org', 'de', 'net', 'info'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        head = d(15)
        whole = next(head + c for c in "0123456789" if luhn(head + c))
        return rng.choice(["", " ", "-"]).join(whole[i : i + 4] for i in range(0, 16, 4))
    return rng.choice(["+1 ({}) {}-{}", "+{} {} {}", "+49 {}-{}{}"]).format(d(3), d(3), d(4))


def examples(found: list[tuple[str, list[Span]]], seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Sampled stretches, their rewritten and decoy copies, and the carrier sentences."""
    rng = random.Random(seed)
    made = list(found)

    def put(text: str, gold: list[Span], at: int, new: str, kind: str | None) -> None:
        _, a, b = gold[at]
        shift = len(new) - (b - a)
        kept = [(k, x, y) if y <= a else (k, x + shift, y + shift) for i, (k, x, y) in enumerate(gold) if i != at]
        spans = sorted([*kept, *([(kind, a, a + len(new))] if kind else [])], key=lambda s: s[1])
        made.append((text[:a] + new + text[b:], spans))

    for text, gold in found:
        if gold and all(x[2] <= y[1] for x, y in zip(gold, gold[1:])):
            at = rng.randrange(len(gold))
            kind, a, b = gold[at]
            put(text, gold, at, _variant(kind, text[a:b], rng), kind)
            put(text, gold, at, _decoy(rng), None)
    for _ in range(40):
        for carrier in CARRIERS:
            for kind in KINDS:
                text, gold = carrier, []
                while "{}" in text:
                    at = text.index("{}")
                    plain = _fresh(kind, rng)
                    roll = rng.random()
                    new = plain if roll < 0.3 else _variant(kind, plain, rng) if roll < 0.65 else _decoy(rng)
                    text = text[:at] + new + text[at + 2 :]
                    if roll < 0.65:
                        gold.append((kind, at, at + len(new)))
                made.append((text, gold))
    return made


def train(df: DataFrame, text: str = "text", sample: int = SAMPLE, texts: int = TEXTS) -> Field:
    """The field, learned from ``sample`` stretches at most, those of least hash, of ``texts`` texts or so.

    The texts are chosen by their hash, at a rate of ``texts`` to the rows, so what the tasks send to
    the driver does not grow with the table; copies count once. Stretches of more than STRETCH characters are not learned from. Null and empty texts have
    none; a table without any still gives the model of the carrier sentences.
    """
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            parts = [t[a:b] for t in part.column("text").to_pylist() if t for a, b in stretches(t) if b - a <= STRETCH]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], ["part"])

    rows = df.select(df[text].alias("text"))
    rate = min(1.0, texts / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 32)) < int(rate * (1 << 32)))
    parts = some.mapInArrow(run, "part string").distinct()
    rows = parts.orderBy(F.xxhash64("part"), "part").limit(sample).collect()
    return fit(examples([(p, base_spans(p)) for p in sorted({r["part"] for r in rows})]))


def _free(segments: Iterable[Candidate], base: list[Span], shift: int) -> Iterator[Candidate]:
    """Segments that overlap no base span; ``base`` is by start, positions of segments begin at ``shift``."""
    ends, starts = [], []  # base spans, overlapping ones as one
    for _, a, b in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for c in segments:
        at = bisect_right(ends, c.start + shift)
        if at == len(ends) or starts[at] >= c.end + shift:
            yield c


def added_spans(model: Field, text: str, base: list[Span], margin: float = MARGIN) -> list[Span]:
    """Spans that the field finds beside the base ones, none overlapping those."""
    found: list[Span] = []
    at = 0
    for start, end in stretches(text):
        while at < len(base) and base[at][2] <= start:
            at += 1
        upto = at
        while upto < len(base) and base[upto][1] < end:
            upto += 1
        best = model.decode(_free(candidates(text[start:end]), base[at:upto], start), margin)
        found += [(KINDS[c.kind], c.start + start, c.end + start) for c in best]
    return found


def find_personal(spark: SparkSession, df: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans`` (kind, start, end, base) of each row, by start, then kind as in KINDS.

    Positions are code points, ends exclusive. Null and empty texts have no spans; texts of any
    length are read whole; repeated rows stay. Base spans are all kept, the field's are added where
    no base span lies. Equal scores take fewer spans. Other columns are not read.
    """
    ready(spark)
    rows = df.select(df[key].alias("key"), df[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            out = []
            for t in part.column("text").to_pylist():
                t = t or ""
                base = base_spans(t)
                spans = [(*s, True) for s in base] + [(*s, False) for s in added_spans(model, t, base)]
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in spans])
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(out, shape)], ["key", "spans"])

    schema = f"key {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
