"""String, hash and word functions as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English number words.
SMALL = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
)
TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
SCALES = ((1_000_000_000, "billion"), (1_000_000, "million"), (1_000, "thousand"))


def sha_id(*parts: Column, sep: str = ":") -> Column:
    return F.sha2(F.concat_ws(sep, *parts), 256)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text, unsigned; a character beyond the basic plane is two of them."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    unit = lambda k: F.conv(F.substring(units, k * 4 + 1, F.lit(4)), 16, 10).cast("long")
    step = lambda h, k: (h.bitwiseXOR(unit(k)) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))
    start = F.lit(2166136261).cast("long")
    return F.when(F.length(text) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1), start, step))


def _pick(words: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), at.cast("int") + 1)


def _under_thousand(n: Column) -> Column:
    h, r = F.floor(n / 100), n % 100
    rest = F.when(r < 20, _pick(SMALL, F.least(r, F.lit(19)))).otherwise(
        F.concat(_pick(TENS, F.floor(r / 10)), F.when(r % 10 > 0, F.concat(F.lit("-"), _pick(SMALL, r % 10))).otherwise(""))
    )
    return F.when(h == 0, rest).otherwise(F.concat(_pick(SMALL, F.least(h, F.lit(19))), F.lit(" hundred"), F.when(r > 0, F.concat(F.lit(" and "), rest)).otherwise("")))


def number_words(value: Column) -> Column:
    """Whole numbers in words, with the British "and"."""
    left, parts = F.floor(F.abs(value)).cast("long"), []
    whole = left
    for size, name in SCALES:
        parts.append(F.when(left >= size, F.concat(_under_thousand(F.floor(left / size)), F.lit(f" {name}"))))
        left = left % size
    tail = F.when(left > 0, F.concat(F.when((whole >= 1000) & (left < 100), "and ").otherwise(""), _under_thousand(left)))
    words = F.when(whole == 0, "zero").otherwise(F.concat_ws(" ", *parts, tail))
    return F.concat(F.when(value < 0, "minus ").otherwise(""), words)


def ordinal_words(value: Column) -> Column:
    words = number_words(value)
    last = F.regexp_extract(words, "([a-z]+)$", 1)
    head = F.regexp_replace(words, "[a-z]+$", "")
    irregular = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])[last]
    regular = F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", ""), F.lit("ieth"))).otherwise(F.concat(last, F.lit("th")))
    return F.concat(head, F.coalesce(irregular, regular))


def clock(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def seconds_of(text: Column) -> Column:
    """Seconds of m:ss or h:mm:ss, hours of any number of digits that a long holds in seconds; null for anything else."""
    part = lambda i: F.try_element_at(F.split(text, ":"), F.lit(i)).cast("long")
    long_, short = text.rlike(r"^\d{1,15}:[0-5]\d:[0-5]\d$"), text.rlike(r"^\d{1,3}:[0-5]\d$")
    return F.when(long_, part(1) * 3600 + part(2) * 60 + part(3)).when(short, part(1) * 60 + part(2))


def render(template: Column, facts: dict[str, Column]) -> Column:
    """Fills {fact}, {fact:words} and {fact:ordinal} (capitalised if the format is); a missing fact makes null."""
    first_up = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))
    out = template
    for name, value in facts.items():
        number = value.cast("double")
        forms = {f"{{{name}}}": value.cast("string"), f"{{{name}:words}}": number_words(number), f"{{{name}:ordinal}}": ordinal_words(number)}
        forms |= {f"{{{name}:Words}}": first_up(number_words(number)), f"{{{name}:Ordinal}}": first_up(ordinal_words(number))}
        for mark, text in forms.items():
            out = F.replace(out, F.lit(mark), F.coalesce(text, F.lit(mark)))  # a mark that stays makes null below
    return F.when(~out.rlike(r"\{[A-Za-z_]+(:[A-Za-z]+)?\}"), out)


def sentence(template: str, facts: dict[str, Column]) -> Column:
    """render() of a template known beforehand: only the forms that it uses are built; a missing fact makes null."""
    first_up = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))
    forms = {"": lambda c: c.cast("string"), "words": number_words, "ordinal": ordinal_words}
    forms |= {"Words": lambda c: first_up(number_words(c)), "Ordinal": lambda c: first_up(ordinal_words(c))}
    parts = []
    for piece in re.split(r"(\{[A-Za-z_]+(?::[A-Za-z]+)?\})", template):
        if piece.startswith("{"):
            name, _, form = piece[1:-1].partition(":")
            parts.append(forms[form](facts[name]))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)
