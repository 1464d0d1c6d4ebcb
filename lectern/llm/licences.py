"""Licences in texts: Dice coefficient of word bigrams against templates, in DataFrame functions.

The parts of a text that are compared are its lines, its paragraphs (between blank lines), the
whole text, and windows over its word sequence that find what lies across or inside those, each
normalised to lower-case words. A part can reach ``dice`` with a template only if their numbers
of bigrams are near enough, so its size picks the few templates it is compared with. Templates
are a fixed list and stand in the plan as literals. Most texts lack the words of every template and are left
out before anything is split, by a count that can't leave out a match.

A window begins where a template would begin, and ends where it would end, as reckoned from two
of its bigrams in the text (cut off where the text begins or ends). So words may be put in or
left out between them, but a changed end, such as another version number, counts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.llm.common import ready, written

DICE = 0.8

#: Texts of licences and the usual notices of others.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,"
        " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR"
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
        " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
        " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies. THE"
        " SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING"
        " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,"
        " DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR"
        " PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
        " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
        " compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"
        " distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY"
        " KIND, either express or implied. See the License for the specific language governing permissions and"
        " limitations under the License."
    ),
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY"
        " WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the"
        " GNU General Public License for more details. You should have received a copy of the GNU General Public License"
        " along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT line": "Released under the MIT License.",
    "MIT line, licensed": "Licensed under the MIT License.",
    "BSD-3-Clause line": "Licensed under the BSD 3-Clause License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is licensed under the GNU General Public License, version 2.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 text": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}


#: What separates words: everything in ASCII that is neither letter nor digit (texts are lower-cased first).
BREAK = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")


def bigrams(tokens: Column) -> Column:
    """The set of pairs of neighbouring words."""
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, 1, rest), F.slice(tokens, 2, rest), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def template_sets(templates: dict[str, str]) -> dict[str, list[str]]:
    """The bigram set of each template, by the same rule (the templates are plain ASCII)."""
    found = {}
    for name, template in templates.items():
        tokens = [w for w in re.split(BREAK, template.lower()) if w]
        found[name] = sorted({f"{a} {b}" for a, b in zip(tokens, tokens[1:])})
    return found


def sizes_near(m: int, dice: float) -> tuple[int, int]:
    """Least and greatest number of bigrams with which a part can reach ``dice`` against ``m``; the least is also shared."""
    return math.ceil(round(m * dice / (2 - dice), 9)), math.floor(round(m * (2 - dice) / dice, 9))


def laid_out(templates: dict[str, str], dice: float) -> list[dict]:
    """Per template: its bigrams in order and where each stands first, and what a window must reach."""
    found = []
    for rank, name in enumerate(sorted(templates)):
        tokens = [w for w in re.split(BREAK, templates[name].lower()) if w]
        first: dict[str, int] = {}
        for i, pair in enumerate(zip(tokens, tokens[1:])):
            first.setdefault(" ".join(pair), i)
        m = len(first)
        least, most = sizes_near(m, dice)
        found.append({"licence": name, "rank": rank, "pairs": list(first), "first": list(first.values())}
                     | {"length": len(tokens) - 1, "least": least, "most": most})
    return found


def probes(templates: dict[str, str], dice: float) -> list[tuple[int, list[tuple[str, int]]]]:
    """For each template how many of its bigrams a match may miss, and its words with weights.

    ``dice`` or more with a template of m bigrams needs m * dice / (2 - dice) of them. Each bigram
    belongs to the longer of its two words; a word that a text lacks costs all that belong to it.
    Words come longest first, because long words are rarer.
    """
    found = []
    for laid in laid_out(templates, dice):
        owned: dict[str, int] = {}
        for pair in laid["pairs"]:
            owner = max(pair.split(" "), key=lambda w: (len(w), w))
            owned[owner] = owned.get(owner, 0) + 1
        missing = len(laid["pairs"]) - laid["least"]
        found.append((missing, sorted(owned.items(), key=lambda e: (-len(e[0]), e[0]))))
    return found


def heads(weighed: list[tuple[str, int]], missing: int) -> list[str]:
    """The words at the head of the list that own more bigrams than a match may miss: it has one of them."""
    found, held = [], 0
    for word, weight in weighed:
        if held > missing:
            break
        found.append(word)
        held += weight
    return found


def one_of(found: set[str]) -> str:
    """A pattern for one of some words between separators; words that begin alike share the letter."""
    rest: dict[str, list[str]] = {}
    for word in sorted(found):
        rest.setdefault(word[0], []).append(word[1:])
    tails = "|".join(f"{letter}(?:{'|'.join(words)})" for letter, words in rest.items())
    edge = BREAK[:-1]
    return f"{edge}(?:{tails}){edge}"


def possible(lowered: Column, templates: dict[str, str], dice: float) -> Column:
    """False only where no part or window of a lower-cased text can reach ``dice`` with a template.

    One pattern looks for the words of which a match has at least one, all templates together.
    Where it finds any, the words of each template are weighed against what a match may miss.
    """
    known = probes(templates, dice)
    any_template = F.lit(False)
    for missing, weighed in known:
        head, lacking = F.lit(False), F.lit(0)
        for word in heads(weighed, missing):
            head = head | lowered.contains(word)
        for word, weight in weighed:
            lacking = lacking + F.when(lowered.contains(word), 0).otherwise(weight)
        any_template = any_template | (head & (lacking <= missing))
    framed = F.concat(F.lit(" "), lowered, F.lit(" "))
    return framed.rlike(one_of({w for missing, weighed in known for w in heads(weighed, missing)})) & any_template


def find_licences(
    docs: DataFrame, dice: float = DICE, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, part, number, n_bigrams, licence, dice: the parts of each text that match a template.

    ``part`` is line, paragraph, text or window; ``number`` counts the parts of a kind from 0, of a
    window it is the word with which it begins. A text of one line is a line only, a text without
    blank lines has no paragraphs. A window is a row where neither a matching part nor a better
    window (by shared bigrams beyond those needed) has any of its bigrams for the same licence, or
    half of them for another. Of the templates with which a
    part reaches ``dice`` the best counts, ties to the name that sorts last. Parts may hold one
    another, and each that matches is a row. Null, empty and one-word texts have no rows; repeated
    rows have theirs each. Other columns of ``docs`` are not read. Nothing is shuffled. The texts
    that can match at all (see ``possible``) are written to the shared folder when this is called.
    """
    sets = template_sets(templates)
    sizes = [len(b) for b in sets.values()]
    body = F.col("text")
    lines = F.split(body, "\n")

    def parts(kind: str, pieces: Column) -> Column:
        return F.transform(pieces, lambda x, i: F.struct(F.lit(kind).alias("part"), i.alias("number"), x.alias("body")))

    many = F.size(lines) > 1
    none = F.filter(parts("none", lines), lambda x: F.lit(False))
    blank = r"\n[ \t\r]*\n\s*"
    every = F.concat(
        parts("line", lines),
        F.when(body.rlike(blank), parts("paragraph", F.split(body, blank))).otherwise(none),
        F.when(many, parts("text", F.array(body))).otherwise(none),
    )
    ready(docs.sparkSession)
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text")).where(F.col("text").isNotNull())
    lowered = rows.select("key", "text", F.explode(F.array(F.lower("text"))).alias("lowered"))
    rows = written(lowered.where(possible(F.col("lowered"), templates, dice)).drop("lowered"), "texts")
    # exploded, an array is computed once however often it is used above
    split = rows.select("key", F.explode(every).alias("p")).select("key", "p.part", "p.number", "p.body")
    pairs = split.select("key", "part", "number", F.explode(F.array(bigrams(words(F.col("body"))))).alias("pairs"))
    sized = pairs.select("key", "part", "number", "pairs", F.size("pairs").alias("n_bigrams")).where(
        F.col("n_bigrams").between(sizes_near(min(sizes), dice)[0], sizes_near(max(sizes), dice)[1])
    )

    def best_of(pairs: Column, n_bigrams: Column) -> Column:
        def against(name: str, held: list[str]) -> Column:
            shared = F.size(F.array_intersect(pairs, F.array(*map(F.lit, held))))
            value = 2.0 * shared / (n_bigrams + len(held))
            near = n_bigrams.between(*sizes_near(len(held), dice))
            return F.when(near, F.struct(value.alias("dice"), F.lit(name).alias("licence")))

        return F.array_max(F.array(*[against(name, held) for name, held in sets.items()]))

    best = best_of(F.col("pairs"), F.col("n_bigrams"))
    found = sized.select("key", "part", "number", "n_bigrams", F.explode(F.array(best)).alias("best"))
    matched = found.where(F.col("best.dice") >= dice).select(
        "key", "part", "number", "n_bigrams", "best.licence", "best.dice"
    )
    whole = matched.unionByName(_windows(rows, laid_out(templates, dice), dice, best_of, blank))
    return whole.withColumnRenamed("key", key)


def _windows(rows: DataFrame, laid: list[dict], dice: float, best_of, blank: str) -> DataFrame:
    """The windows of ``rows`` that match, all of a row within the row."""
    anchors = sorted({p for t in laid for p in t["pairs"]})
    known = F.array(
        *[
            F.struct(
                *[F.lit(t[n]).alias(n) for n in ("licence", "rank", "length", "least", "most")],
                *[F.array(*map(F.lit, t[n])).alias(n) for n in ("pairs", "first")],
            )
            for t in laid
        ]
    )

    def once(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.select(*df.columns, F.explode(F.array(value)).alias(name))

    def pairs_of(tokens: Column) -> Column:
        rest = F.greatest(F.size(tokens) - 1, F.lit(0))
        return F.zip_with(F.slice(tokens, 1, rest), F.slice(tokens, 2, rest), lambda a, b: F.concat_ws(" ", a, b))

    # texts with bigrams enough of some template
    df = once(rows.where(F.col("text").isNotNull()), "tokens", words(F.col("text")))
    df = once(df, "pairs", pairs_of(F.col("tokens"))).drop("tokens")
    df = once(df, "met", F.filter("pairs", lambda p: p.isin(*anchors))).where(F.size("met") >= min(t["least"] for t in laid))
    near = F.filter(known, lambda t: F.size(F.array_intersect(F.col("met"), t["pairs"])) >= t["least"])
    df = once(df, "near", near).where(F.size("near") > 0).drop("met")

    # each bigram with its place and the one before at which it stood (-1: none)
    df = once(df, "sorted", F.array_sort(F.transform("pairs", lambda b, i: F.struct(b.alias("b"), i.alias("i"))))).drop("pairs")
    earlier = F.concat(F.array(F.lit(None).cast("struct<b:string,i:int>")), F.slice("sorted", 1, F.size("sorted") - 1))
    before = F.zip_with(
        "sorted", earlier, lambda x, y: F.struct(x["i"].alias("i"), F.when(x["b"] == y["b"], y["i"]).otherwise(-1).alias("prev"), x["b"].alias("b"))
    )
    df = once(df, "seq", F.array_sort(before)).drop("sorted")
    df = once(df, "hits", F.filter("seq", lambda x: x["b"].isin(*anchors)))
    last = F.size("seq") - 1

    def of_template(t: Column) -> Column:
        def reach(hits: Column) -> Column:
            def begin(h: Column) -> Column:
                return h["i"] - F.element_at(t["first"], F.array_position(t["pairs"], h["b"]).cast("int"))

            starts = F.array_distinct(F.transform(hits, lambda h: F.greatest(F.lit(0), begin(h))))
            ends = F.array_distinct(F.transform(hits, lambda h: F.least(last, begin(h) + t["length"] - 1)))

            def from_start(p: Column) -> Column:
                # no window holds more than `most` distinct bigrams
                tail = F.slice(F.filter(F.slice("seq", p + 1, last + 1), lambda x: x["prev"] < p), F.lit(1), t["most"] + 1)
                marked = F.transform(tail, lambda x: F.struct(x["i"].alias("i"), F.array_contains(t["pairs"], x["b"]).alias("hit")))

                def windows(new: Column) -> Column:
                    stop = F.when(F.size(new) > t["most"], F.element_at(new, -1)["i"]).otherwise(last + 1)
                    possible = F.filter(ends, lambda q: (q >= p) & (q < stop))

                    def window(q: Column) -> Column:
                        n = F.size(F.filter(new, lambda x: x["i"] <= q))
                        shared = F.size(F.filter(new, lambda x: (x["i"] <= q) & x["hit"]))
                        m = F.size(t["pairs"])
                        return F.struct(
                            (dice / 2 * (n + m) - shared).alias("short"),
                            (-t["rank"]).alias("rank"),
                            p.alias("number"),
                            q.alias("last"),
                            n.alias("n_bigrams"),
                            t["licence"].alias("licence"),
                            (2.0 * shared / (n + m)).alias("dice"),
                            F.transform(F.filter(hits, lambda h: h["i"].between(p, q)), lambda h: h["i"]).alias("at"),
                        )

                    enough = F.size(F.filter(new, lambda x: x["hit"])) >= t["least"]
                    none = F.filter(possible, lambda q: F.lit(False))
                    return F.filter(F.transform(F.when(enough, possible).otherwise(none), window), lambda w: w["dice"] >= dice)

                return let(marked, windows)

            return F.flatten(F.transform(starts, from_start))

        return let(F.filter("hits", lambda h: F.array_contains(t["pairs"], h["b"])), reach)

    df = once(df, "windows", F.array_sort(F.flatten(F.transform("near", of_template)))).where(F.size("windows") > 0)
    df = df.drop("near", "seq")

    # what matching lines, paragraphs and the text itself already hold
    def taken(df: DataFrame, name: str, separator: str) -> DataFrame:
        df = once(df, "pieces", F.split("text", separator) if separator else F.array("text"))
        owner = F.flatten(F.transform("pieces", lambda x, i: F.transform(words(x), lambda w: i)))
        df = once(df, "owner", owner)
        touched = F.array_distinct(
            F.flatten(F.transform("windows", lambda w: F.slice("owner", w["number"] + 1, w["last"] - w["number"] + 2)))
        )

        def entry(i: Column) -> Column:
            def scored(pairs: Column) -> Column:
                def kept(best: Column) -> Column:
                    held = F.element_at(F.filter(known, lambda t: t["licence"] == best["licence"]), 1)["pairs"]
                    inside = F.filter(
                        "hits",
                        lambda h: (F.get("owner", h["i"]) == i) & (F.get("owner", h["i"] + 1) == i) & F.array_contains(held, h["b"]),
                    )
                    return F.when(
                        best["dice"] >= dice,
                        F.struct(best["licence"].alias("licence"), F.transform(inside, lambda h: h["i"]).alias("at")),
                    )

                return let(best_of(pairs, F.size(pairs)), kept)

            return let(bigrams(words(F.get("pieces", i))), scored)

        return once(df, name, F.filter(F.transform(touched, entry), lambda e: e.isNotNull())).drop("pieces", "owner")

    for name, separator in (("by_line", "\n"), ("by_paragraph", blank), ("by_text", "")):
        df = taken(df, name, separator)

    kind = "array<struct<licence:string,at:array<int>,number:int,n_bigrams:int,dice:double>>"

    def as_entry(e: Column, window: bool) -> Column:
        rest = [e[n] if window else F.lit(None) for n in ("number", "n_bigrams", "dice")]
        kinds = ("int", "int", "double")
        return F.struct(
            e["licence"].alias("licence"),
            e["at"].alias("at"),
            *[x.cast(k).alias(n) for x, k, n in zip(rest, kinds, ("number", "n_bigrams", "dice"))],
        )

    def add(held: Column, w: Column) -> Column:
        same = lambda a: (a["licence"] == w["licence"]) & F.arrays_overlap(a["at"], w["at"])
        half = lambda a: 2 * F.size(F.array_intersect(a["at"], w["at"])) >= F.size(w["at"])
        new = F.array(as_entry(w, True)).cast(kind)
        return F.when(F.exists(held, lambda a: same(a) | half(a)), held).otherwise(F.concat(held, new))

    parts = F.transform(F.concat("by_line", "by_paragraph", "by_text"), lambda e: as_entry(e, False)).cast(kind)
    chosen = F.filter(F.aggregate("windows", parts, add), lambda e: e["number"].isNotNull())
    out = df.select("key", F.explode(chosen).alias("w"))
    return out.select("key", F.lit("window").alias("part"), "w.number", "w.n_bigrams", "w.licence", "w.dice")


def sql(templates: dict[str, str] = TEMPLATES, dice: float = DICE) -> str:
    """The same over ``documents`` for DuckDB."""
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates.items())
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    tokens = "list_filter(regexp_split_to_array(lower({}), '{}'), lambda x: x <> '')"
    return f"""
        with t as (select licence, {pairs} as b from (
            select licence, {tokens.format('template', BREAK)} as w from (values {quoted}) as v(licence, template))),
        l as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
        p as (
            select doc_id, 'line' as part, unnest(range(len(lines))) as number, unnest(lines) as body from l
            union all
            select doc_id, 'paragraph', unnest(range(len(q))), unnest(q) from (
                select doc_id, regexp_split_to_array(text, '\\n[ \\t\\r]*\\n\\s*') as q from l
                where regexp_matches(text, '\\n[ \\t\\r]*\\n'))
            union all
            select doc_id, 'text', 0, text from l where len(lines) > 1),
        g as (select doc_id, part, number, {pairs} as b from (
            select *, {tokens.format('body', BREAK)} as w from p)),
        m as (
            select doc_id, part, number, len(g.b) as n_bigrams, licence,
                2.0::double * len(list_intersect(g.b, t.b)) / (len(g.b) + len(t.b)) as dice
            from g join t on len(g.b) between ceil(round(len(t.b) * {dice / (2 - dice)!r}, 9))
                and floor(round(len(t.b) * {(2 - dice) / dice!r}, 9)))
        select doc_id, part, cast(number as int) as number, cast(n_bigrams as int) as n_bigrams, licence, dice
        from m where dice >= {dice}
        qualify row_number() over (partition by doc_id, part, number order by dice desc, licence desc) = 1
    """
