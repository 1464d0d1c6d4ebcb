"""Personal data: base patterns against plain regular expressions, the field against enumeration."""

import itertools
import math
import random
import re
import time

import pytest

from lectern.llm import span_crf
from lectern.llm.span_crf import KINDS, Candidate, Field
from tests.llm.test_operators import documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
            keep = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if keep:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@pytest.fixture(scope="module")
def model():
    return span_crf.fit(span_crf.examples([]))


def test_base_equals_regular_expressions():
    rng = random.Random(1)
    bits = ["a", "b.c", "@", "@", ".", "x@y.z", "_", "-", " ", "+", "+1", "(", ")", "1", "12", "255", "256", "1.2.3.4", "007", "4111 1111 1111 1111", "4111111111111111", "é", "٣", "\n", "%", "+49 30 1234567", "..", "555-0199"]
    for _ in range(8000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert span_crf.base_spans(text) == brute(text), text


def test_decode_and_expectations_equal_enumeration():
    rng = random.Random(2)
    for _ in range(300):
        segments = sorted((Candidate(a := rng.randint(0, 7), a + rng.randint(1, 3), rng.randint(0, 3), [f"f{i}"]) for i in range(rng.randint(1, 7))), key=lambda c: c.start)
        field = Field({f"f{i}": rng.uniform(-2, 3) for i in range(7)}, rng.uniform(-2, 2))
        apart = [
            sorted(pick, key=lambda c: c.start)
            for n in range(len(segments) + 1)
            for pick in itertools.combinations(segments, n)
            if all(x.end <= y.start for x, y in itertools.pairwise(sorted(pick, key=lambda c: c.start)))
        ]

        def worth(pick, margin=0.0):
            return sum(field.score(c) - margin for c in pick) + field.touch * sum(x.end == y.start for x, y in itertools.pairwise(pick))

        spans = {(c.kind, c.start, c.end): c for c in sorted(segments, key=field.score)}
        chosen = [spans[c.kind, c.start, c.end] for c in field.decode(segments, 0.5)]
        assert math.isclose(worth(chosen, 0.5), max(worth(p, 0.5) for p in apart), abs_tol=1e-9)
        total, chances, touching = span_crf.expectations(segments, [field.score(c) for c in segments], field.touch)
        z = sum(math.exp(worth(p)) for p in apart)
        assert math.isclose(total, math.log(z), abs_tol=1e-9)
        for c, chance in zip(segments, chances):
            assert math.isclose(chance, sum(math.exp(worth(p)) for p in apart if any(c is x for x in p)) / z, abs_tol=1e-9)
        both = sum(math.exp(worth(p)) * sum(x.end == y.start for x, y in itertools.pairwise(p)) for p in apart) / z
        assert math.isclose(touching, both, abs_tol=1e-9)


def test_held_out_forms(model):
    rng = random.Random(99)
    caught = wrong = 0
    for _ in range(150):
        for kind in KINDS:
            plain = span_crf._fresh(kind, rng)
            text = f"some words before {(new := span_crf._variant(kind, plain, rng))} and after"
            base = span_crf.base_spans(text)
            caught += bool(base) or (kind, 18, 18 + len(new)) in span_crf.added_spans(model, text, base)
        decoy = f"some words before {span_crf._decoy(rng)} and after"
        base = span_crf.base_spans(decoy)
        wrong += len(span_crf.added_spans(model, decoy, base))
    assert caught >= 0.95 * 600 and wrong <= 0.03 * 150, (caught, wrong)
    for text in ("Plain words only.", "In 1999 it cost 3,000.50 for 12 of 24.", "Version 3.1.4 of 2024-05-06, pages 12-34", "met at noon dot"):
        assert span_crf.added_spans(model, text, span_crf.base_spans(text)) == []


def test_added_never_overlap_base(model):
    rng = random.Random(3)
    for _ in range(300):
        kinds = rng.choices(KINDS, k=4)
        bits = [rng.choice([span_crf._fresh(k, rng), span_crf._variant(k, span_crf._fresh(k, rng), rng)]) for k in kinds]
        text = rng.choice([" ", ", ", ""]).join(bits)
        base = span_crf.base_spans(text)
        added = span_crf.added_spans(model, text, base)
        assert not any(a < y and x < b for _, a, b in added for _, x, y in base)
        assert all(x[2] <= y[1] for x, y in itertools.pairwise(added))


def test_long_texts_in_linear_time(model):
    size = 300_000
    for text in ("x" * size, "1" * size, "1 " * (size // 2), "1." * (size // 2), "+1" + " " * size, "+1(" * (size // 3), "a@" * (size // 2), "x." * (size // 2) + "@", " at " * (size // 4), "(at)" * (size // 4)):
        began = time.time()
        span_crf.added_spans(model, text, span_crf.base_spans(text))
        assert time.time() - began < 30, text[:20]


def test_tables(spark, model):
    texts = [None, "", "no digits", "mail a.b@c.de", "call (555) 123-4567", "x" * 200_000 + " a@b.cd", "é漢 1.2.3.4"]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id = 3"))
    rows = span_crf.find_personal(spark, docs, model).collect()
    found = sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in rows)
    want = [(0, []), (1, []), (2, []), (3, [("email", 5, 13, True)]), (3, [("email", 5, 13, True)]), (4, [("phone", 5, 19, False)]), (5, [("email", 200_001, 200_007, True)]), (6, [("ip", 3, 10, True)])]
    assert found == want
    assert span_crf.find_personal(spark, docs.limit(0), model).collect() == []
    trained = span_crf.train(docs.limit(0))
    assert trained == model and span_crf.train(docs).weights
