"""Scalar text functions as Column expressions (no Python runs per row)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions.binding import let

# Whitespace classes: the JVM's \s is ASCII, the two scripting languages' are wider.
WEB_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
RAW_SPACE = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_COMMON_SPACE = " \t\n\u000b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
_COMMON_SPACE += "\u2028\u2029\u202f\u205f\u3000"
_WEB_SPACE_CHARS = _COMMON_SPACE + "\ufeff"
_RAW_SPACE_CHARS = _COMMON_SPACE + "\u001c\u001d\u001e\u001f\u0085"
_ASCII_WORD_START = r"(?<![A-Za-z0-9_])"
_ASCII_WORD_END = r"(?![A-Za-z0-9_])"


def web_trim(c: Column) -> Column:
    """Trim the white space a browser trims."""
    return F.btrim(c, F.lit(_WEB_SPACE_CHARS))


def raw_trim(c: Column) -> Column:
    """Trim Unicode white space as the text extractors do."""
    return F.btrim(c, F.lit(_RAW_SPACE_CHARS))


def _is_mark(ch: str) -> bool:
    return "\u0300" <= ch <= "\u036f"


def _accent_pairs() -> tuple[str, str]:
    """Every accented letter below U+2000 that decomposes to one letter plus marks."""
    accented, plain = [], []
    for code in range(0x00C0, 0x2000):
        ch = chr(code)
        parts = unicodedata.normalize("NFD", ch)
        base = "".join(p for p in parts if not _is_mark(p))
        if len(base) == 1 and base != ch and len(parts) > 1:
            accented.append(ch)
            plain.append(base)
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_pairs()
_MARKS = "".join(chr(c) for c in range(0x0300, 0x0370))
# translate() drops the characters that have no counterpart, so marks and accents go in one pass
_FOLD_FROM = _ACCENTED + fixed.SEARCH_BLANKED + _MARKS
_FOLD_TO = _PLAIN + " " * len(fixed.SEARCH_BLANKED)
_TOKEN_FROM = _ACCENTED + fixed.SEARCH_BLANKED + _WEB_SPACE_CHARS + _MARKS
_TOKEN_TO = _PLAIN + " " * len(fixed.SEARCH_BLANKED + _WEB_SPACE_CHARS)


def normalize_block(c: Column) -> Column:
    """B1: drop soft hyphens, join words hyphenated over a line end, collapse white space."""
    c = F.replace(c, F.lit("\u00ad"), F.lit(""))
    c = F.regexp_replace(c, f"-\\n{RAW_SPACE}*+", "")
    # single blanks, nearly all there is, are left alone
    wide = f"[{RAW_SPACE[1:-1]}&&[^ ]]"
    return raw_trim(F.regexp_replace(c, f" {RAW_SPACE}++|{wide}{RAW_SPACE}*+", " "))


def strip_asterisks(c: Column) -> Column:
    """B2."""
    return F.replace(c, F.lit("*"), F.lit(""))


def is_cross_reference(line: Column) -> Column:
    """The line is a cross-reference block or the continuation of one."""
    s = raw_trim(line)
    start = (
        rf"^\d+(?:[.,:\-]\d+)*{RAW_SPACE}*:{RAW_SPACE}+[12]?{RAW_SPACE}*"
        rf"[A-ZÁÉÍÓÚÑa-záéíóúñ]+{RAW_SPACE}*\d"
    )
    continued = rf"^\d+,\d+[a-z]?{RAW_SPACE}*[|;]"
    return F.coalesce(s.rlike(start) | s.rlike(continued), F.lit(False))


def strip_noise(chunk: Column) -> Column:
    """Keep the lines before the first footnote marker that are no cross-references.

    The lines stay an array inside the row, so a chunk is cleaned without a shuffle.
    """
    def clean(lines: Column) -> Column:
        marked = F.array_min(
            F.filter(
                F.transform(lines, lambda x, i: F.when(x.rlike(r"\*\d+,\d"), i)),
                lambda i: i.isNotNull(),
            )
        )
        kept = F.slice(lines, F.lit(1), F.coalesce(marked, F.size(lines)))
        return F.array_join(F.filter(kept, lambda x: ~is_cross_reference(x)), "\n")

    return let(F.split(chunk, r"\n", -1), clean)


def search_fold(c: Column) -> Column:
    """Lower case, accents off, punctuation to blanks."""
    return F.translate(F.lower(c), _FOLD_FROM, _FOLD_TO)


def tokens(c: Column, stop_words: list[str] | None = None) -> Column:
    """Search tokens of a text, longer than one character and not stop words."""
    stop = fixed.STOP_WORDS_ES if stop_words is None else stop_words
    # a stop word of one character can never meet a token, so the test leaves it out
    listed = [w for w in dict.fromkeys(stop) if len(w) > 1]
    # white space becomes blanks in the same pass as the folding, so the split is on one
    # character; the empty pieces between blanks fall to the length test
    words = F.split(F.translate(F.lower(c), _TOKEN_FROM, _TOKEN_TO), " ")
    if not listed:
        return F.filter(words, lambda t: F.length(t) > 1)
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(listed))


class _Canonical:
    """Tables of canonical composition, from the character database, without Hangul."""

    def __init__(self) -> None:
        # a character whose composed form is several (or a mark's) is taken apart, others of one character are translated
        self.single: dict[str, str] = {}
        self.apart: dict[str, str] = {}
        self.several: list[str] = []
        self.classes: dict[str, int] = {}
        pairs = []
        for code in [*range(0xC0, 0xAC00), *range(0xF900, 0x30000)]:
            ch = chr(code)
            if unicodedata.combining(ch):
                self.classes[ch] = unicodedata.combining(ch)
            nfd, nfc = unicodedata.normalize("NFD", ch), unicodedata.normalize("NFC", ch)
            if len(nfc) == 1 and nfc != ch:
                self.single[ch] = nfc
            elif len(nfd) > 1:
                self.apart[ch] = nfd
                if nfc != ch:
                    self.several.append(ch)
                two = unicodedata.decomposition(ch).split()
                if nfc == ch and len(two) == 2 and not two[0].startswith("<"):
                    pairs.append("".join(chr(int(p, 16)) for p in two) + ch)
        # (letter, mark, composed) and (character, decomposition), each behind a sign that no text holds
        self.pairs = "".join("\uffff" + p for p in pairs)
        self.marks = "".join(self.classes)
        # classes as characters of the same order
        self.order = "".join(chr(0x100 + k) for k in self.classes.values())
        self.forms = "".join("\uffff" + ch + form.ljust(4, "\ufffe") for ch, form in self.apart.items())


def _ranges(characters: str) -> str:
    """The characters as ranges of a pattern's class."""
    found: list[list[int]] = []
    for code in sorted(map(ord, characters)):
        if found and found[-1][1] == code - 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in found)


def _quoted(characters: str) -> str:
    """The characters as they stand in a pattern's class."""
    return "".join(rf"\x{{{ord(ch):x}}}" for ch in characters)


_CANONICAL = _Canonical()
# most characters are below the first mark and are told by one comparison
_LOW = r"\x{0}-\x{2ff}"
# and most marks are in the first block, whose ranges are tried before all others
_FIRST_MARKS = _ranges("".join(ch for ch in _CANONICAL.marks if ch < "\u0370"))
_MARK_CLASS = rf"[{_FIRST_MARKS}[[^{_LOW}]&&[{_ranges(_CANONICAL.marks)}]]]"
_SEVERAL_CLASS = rf"[[^{_LOW}]&&[{_ranges(''.join(_CANONICAL.several))}]]"
# no mark stands before a run: those that begin a text are taken off first
_MARK_RUN = rf"(?s:.){_MARK_CLASS}+|{_SEVERAL_CLASS}"
# these begin behind the most frequent marks
_SINGLE_CLASS = rf"[[^\x{{0}}-\x{{{ord(min(_CANONICAL.single)) - 1:x}}}]&&[{_ranges(''.join(_CANONICAL.single))}]]"
# letters with a letter or nothing behind them; what is left has the same runs of marks behind the same characters
_UNMARKED = rf"[{_LOW}]+(?=[{_LOW}]|\z)"
_NOT_COMPOSED = rf"[[^{_LOW}]&&[{_ranges(_CANONICAL.marks + ''.join(_CANONICAL.several) + ''.join(_CANONICAL.single))}]]"


def _taken_apart(ch: Column) -> Column:
    """The canonical decomposition of one character."""

    def form(at: Column) -> Column:
        padded = F.substring(F.lit(_CANONICAL.forms), at + 2, F.lit(4))
        return F.when(at > 0, F.translate(padded, "\ufffe", "")).otherwise(ch)

    return F.when(ch < "\u00c0", ch).otherwise(let(F.instr(F.lit(_CANONICAL.forms), F.concat(F.lit("\uffff"), ch)), form))


def _composed_run(run: Column) -> Column:
    """A letter and its marks: marks in order of their classes, then taken into the letter one by one."""

    def composed(run: Column) -> Column:
        places = F.transform(F.sequence(F.lit(1), F.length(run)), lambda i: i)
        parts = F.transform(places, lambda i: F.substring(run, i, F.lit(1)))
        # what stands before the marks has no class
        classed = F.transform(
            parts,
            lambda ch, i: F.struct(
                F.when((ch >= "\u0300") & (F.instr(F.lit(_CANONICAL.marks), ch) > 0), F.translate(ch, _CANONICAL.marks, _CANONICAL.order)).otherwise("").alias("rank"),
                i.alias("at"),
                ch.alias("ch"),
            ),
        )

        def folded(ordered: Column) -> Column:
            start = _state(F.lit(""), F.lit(""), F.lit(""), F.lit(""))

            def step(state: Column, mark: Column) -> Column:
                letter, rest = state["letter"], state["rest"]

                def taken(at: Column) -> Column:
                    made = F.substring(F.lit(_CANONICAL.pairs), at + 3, F.lit(1))
                    # a mark behind one of its own class or a higher one, or anything behind marks that stay, is blocked
                    free = (at > 0) & F.when(mark["rank"] == "", rest == "").otherwise(state["last"] < mark["rank"])
                    return (
                        F.when(free, _state(state["done"], made, rest, state["last"]))
                        .when(mark["rank"] == "", _state(F.concat(state["done"], letter, rest), mark["ch"], F.lit(""), F.lit("")))
                        .otherwise(_state(state["done"], letter, F.concat(rest, mark["ch"]), mark["rank"]))
                    )

                pair = F.instr(F.lit(_CANONICAL.pairs), F.concat(F.lit("\uffff"), letter, mark["ch"]))
                return let(F.when(F.length(letter) == 1, pair).otherwise(0), taken)

            return F.aggregate(ordered, start, step, lambda s: F.concat(s["done"], s["letter"], s["rest"]))

        return let(F.array_sort(classed), folded)

    return let(F.concat(_taken_apart(F.substring(run, F.lit(1), F.lit(1))), F.substring(run, F.lit(2), F.length(run))), composed)


def _state(done: Column, letter: Column, rest: Column, last: Column) -> Column:
    """What is finished, the current letter, its marks that stay, and the class of the last of them."""
    return F.struct(done.alias("done"), letter.alias("letter"), rest.alias("rest"), last.alias("last"))


def _mark_runs(t: Column) -> Column:
    """Every run of a text that does not begin with a mark; the costly classes see no more than its marks and what is beside them."""
    return F.regexp_extract_all(F.regexp_replace(t, _UNMARKED, ""), F.lit(f"({_MARK_RUN})"), F.lit(1))


def compose(c: Column) -> Column:
    """Canonical composition (NFC). Texts without a mark skip the work, others do it for their marks only.

    Conjoining jamo, and the few signs of class 0 that compose with a letter before them, stay as
    they are.
    """

    def text(t: Column) -> Column:
        # each distinct run once, longer ones first: a run that begins like a longer one does not meet it again
        runs = F.array_distinct(_mark_runs(t))
        ordered = F.array_sort(F.transform(runs, lambda r: F.struct((-F.length(r)).alias("size"), r.alias("run"))))
        made = F.transform(ordered, lambda r: F.struct(r["run"].alias("run"), _composed_run(r["run"]).alias("composed")))
        return F.aggregate(made, t, lambda text, r: F.replace(text, r["run"], r["composed"]))

    def parts(t: Column) -> Column:
        marks = F.length(F.regexp_extract(t, f"^({_MARK_CLASS}+)", 1))
        alone = F.when(marks > 0, _composed_run(F.substring(t, F.lit(1), marks))).otherwise("")
        return F.concat(alone, let(F.substring(t, marks + 1, F.length(t)), text))

    single = F.translate(c, "".join(_CANONICAL.single), "".join(_CANONICAL.single.values()))
    whole = F.when(c.rlike(_SINGLE_CLASS), single).otherwise(c)
    for mark, form in _CANONICAL.apart.items():
        if form[0] in _CANONICAL.classes:
            whole = F.replace(whole, F.lit(mark), F.lit(form))
    return F.when(c.rlike(_NOT_COMPOSED), let(whole, parts)).otherwise(c)


def compare_fold(c: Column) -> Column:
    """The form in which a quotation and a passage are compared; accents stay."""
    names = "|".join(fixed.COMPARE_LETTER_NAMES)
    c = compose(F.lower(c))
    # a class of a pattern looks at bits where translate() looks up every character as a text
    c = F.replace(F.regexp_replace(c, f"[{_quoted(fixed.COMPARE_DELETED_FIRST)}]++", ""), F.lit("|"), F.lit(" "))
    c = F.regexp_replace(c, f"{_ASCII_WORD_START}(?:{names}){_ASCII_WORD_END}", "")
    c = F.regexp_replace(c, f"[{_quoted(fixed.COMPARE_DELETED_LAST)}]++", "")
    # single blanks, nearly all there is, are left alone
    wide = f"[{WEB_SPACE[1:-1]}&&[^ ]]"
    return web_trim(F.regexp_replace(c, f" {WEB_SPACE}++|{wide}{WEB_SPACE}*+", " "))


_DISPLAY_MARK = rf"(?iu)\((?:{'|'.join(fixed.DISPLAY_LETTER_NAMES)})\){WEB_SPACE}*"
_SEPARATOR = rf"{WEB_SPACE}*\|{WEB_SPACE}*"


def display_text(c: Column) -> Column:
    """Passage text as shown: letter marks off, line separators as dashes."""
    return web_trim(F.regexp_replace(F.regexp_replace(c, _DISPLAY_MARK, ""), _SEPARATOR, " — "))


def export_text(c: Column) -> Column:
    """B8, order used for transcripts: separators first, then letter marks."""
    return web_trim(F.regexp_replace(F.regexp_replace(c, _SEPARATOR, " — "), _DISPLAY_MARK, ""))


def cap(c: Column, limit: int) -> Column:
    """First ``limit`` characters (code points)."""
    return F.substring(c, 1, limit)


def title_or_null(c: Column, limit: int = fixed.TITLE_LIMIT) -> Column:
    """Capped title, an empty one becomes null."""
    return F.nullif(cap(c, limit), F.lit(""))


def cap_at_word(c: Column, limit: int = fixed.ANSWER_BODY_LIMIT) -> Column:
    """Over the limit, cut at the last blank before it and add an ellipsis."""
    cut = F.regexp_replace(F.substring(c, 1, limit), r" [^ ]*+\z", "")
    return F.when(F.length(c) > limit, F.concat(cut, F.lit("…"))).otherwise(c)


def ref_key(abbr: Column, chapter: Column, num: Column) -> Column:
    """``abbr ch:num``."""
    return F.concat(abbr, F.lit(" "), chapter.cast("string"), F.lit(":"), num.cast("string"))


def embedding_input(ref: Column, text: Column) -> Column:
    """Text a passage is embedded as."""
    return F.concat(ref, F.lit(" — "), text)


def qa_input(question: Column, answer: Column) -> Column:
    """Text a question/answer pair is embedded as."""
    return F.concat(question, F.lit("\n\n"), answer)


def distance_label(meters: Column) -> Column:
    """B14."""
    return F.when(
        meters < 1000,
        F.concat(F.floor(meters + 0.5).cast("string"), F.lit(" m")),
    ).otherwise(F.concat(F.format_string("%.1f", meters / 1000), F.lit(" km")))


def compact_phone(c: Column) -> Column:
    """B15."""
    return F.regexp_replace(c, f"{WEB_SPACE}++", "")


def first_word(c: Column) -> Column:
    """B16."""
    return F.element_at(F.split(web_trim(c), f"{WEB_SPACE}++"), 1)


def clamp(c: Column, low: float, high: float, default: float) -> Column:
    """Null takes the default, NaN the lower bound."""
    value = F.coalesce(c.cast("double"), F.lit(float(default)))
    return F.when(F.isnan(value), F.lit(float(low))).otherwise(
        F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    )


def leading_int(c: Column) -> Column:
    """Leading integer of a text as a double, NaN when there is none (null stays null)."""
    digits = F.regexp_extract(c, rf"^{WEB_SPACE}*([+-]?\d+)", 1)
    return F.when(c.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(F.nullif(digits, F.lit("")).cast("double"), F.lit(float("nan")))
    )


def leading_number(c: Column) -> Column:
    """Leading decimal number of a text, null when there is none or it is not finite."""
    number = F.regexp_extract(
        c, rf"^{WEB_SPACE}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1
    )
    value = F.nullif(number, F.lit("")).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def coordinates(lat: Column, lng: Column) -> Column:
    """struct(lat, lng) when both texts hold finite numbers, else null."""
    a, b = leading_number(lat), leading_number(lng)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("lat"), b.alias("lng")))


def is_photo_name(c: Column) -> Column:
    """``places/X/photos/Y``."""
    return F.coalesce(c.rlike(r"^places/[^/]+/photos/[^/?#]+\z"), F.lit(False))


def _web_number(c: Column) -> Column:
    """A double as a web page prints it: whole values without a fraction."""
    text = c.cast("string")
    return F.regexp_replace(text, r"\.0\z", "")


def maps_link(uri: Column, lat: Column, lng: Column, place_id: Column) -> Column:
    """The given link, else one built from position and id."""
    built = F.format_string(fixed.MAPS_LINK, _web_number(lat), _web_number(lng), place_id)
    return F.coalesce(F.nullif(uri, F.lit("")), F.when(lat.isNotNull() & lng.isNotNull(), built))


def word_pieces(c: Column) -> Column:
    """Words with the white space that follows them."""
    ws = WEB_SPACE[1:-1]
    return F.regexp_extract_all(c, F.lit(f"[^{ws}]++{WEB_SPACE}*+"), 0)


def passage_pair(reference: Column, text: Column) -> Column:
    """struct(reference, text) only when both are present and not empty."""
    return F.when(
        (reference != "") & (text != ""),
        F.struct(reference.alias("reference"), text.alias("text")),
    )


def title_or_default(title: Column, default: str = fixed.UNTITLED) -> Column:
    """B23."""
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(default))
