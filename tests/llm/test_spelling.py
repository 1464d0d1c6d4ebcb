"""Spelling variants against plain comparison of all words."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import spelling_trie
from tests.llm.test_operators import documents


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    seen = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def brute(rows):
    n = brute_words(rows)
    near = {w: [o for o in n if o != w and abs(len(o) - len(w)) < 2 and one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, str(form[w]), root(w), n[w], len(near[w]), str(n.get(form[w]))) for w in n)


def got(df):
    return sorted((r["word"], str(r["form"]), r["root"], r["n"], r["n_near"], str(r["form_n"])) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    stems = ["banana", "Strasse", "èèèèè", "aaaaa", "aaaaaa", "abababab", "naïveté", "hello", "colour", "x" * 31, "x" * 32, "x" * 33, "y" * 40]
    letters = "abxyèß×÷ÿ"

    def word():
        w = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters)])
        return "".join(w)

    texts = [" ".join(rng.choice([str.upper, str])(word()) for _ in range(300)) for _ in range(40)]
    texts += [None, "", "1234 -- 漢字", "A" * 70, "a b c d e", texts[0], " ".join(["long" * 50, "long" * 49 + "lon"] * 4)]
    return list(enumerate(texts)) + [(3, texts[3]), (None, texts[4])]


@pytest.mark.parametrize("levels", [4, 32])
def test_equals_all_pairs(spark, rows, levels):
    docs = documents(spark, [t for _, t in rows]).withColumn("word", F.lit("x"))
    ids = [k for k, _ in rows]
    docs = docs.withColumn("doc_id", F.element_at(F.array(*[F.lit(i).cast("bigint") for i in ids]), F.col("doc_id").cast("int") + 1))
    assert got(spelling_trie.variants(docs, levels=levels)) == brute(rows)


def test_runs_lose_letters(spark, rows):
    docs = documents(spark, [f"{t} {' '.join(f'q{a}{b}zzz' for a in 'abcdefghij' for b in 'klmnopqrst')}" for _, t in rows])
    mine = {r["word"]: r["n"] for r in spelling_trie.words(docs).collect()}
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert mine == brute_words(plain)
    assert any(zlib.crc32(f"{k}:{w.lower()}".encode()) % 97 == 0 for k, t in plain for w in re.findall("[A-Za-zÀ-ÿ]+", t))


def test_chains_hubs_and_nothing(spark):
    chain = {"aaaaa": 64, "aaaab": 32, "aaabb": 16, "aabbb": 8, "abbbb": 4, "bbbbb": 3, "cccccc": 3}
    hub = {f"aaaa{c}": 3 for c in "cdefghijklmnopqrstuvwxyz"}
    text = " ".join(w for w, n in (chain | hub).items() for _ in range(n))
    seen = collections.Counter(brute_words([(5, text)]))
    found = spelling_trie.variants(documents(spark, [text], first=5))
    assert got(found) == brute([(5, text)])
    assert {r["root"] for r in found.collect() if r["word"] in ("abbbb", "aabbb", "aaaac")} == {"aaaaa"} and seen["aaaaa"] == 64
    for docs in (documents(spark, [None, "", "ab cd"]), documents(spark, ["x"]).limit(0)):
        assert spelling_trie.variants(docs).collect() == []


def test_long_words_whole(spark):
    long = "".join(random.Random(5).choices("abcdefgh", k=100_000))
    words = [long, long[:50_000] + "z" + long[50_001:], long[1:], long[::-1]]
    found = spelling_trie.variants(documents(spark, [" ".join(words)] * 4))
    assert {r["word"]: r["n_near"] for r in found.collect()} == {words[0]: 2, words[1]: 1, words[2]: 1, words[3]: 0}
