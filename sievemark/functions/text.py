"""Text normalisation and windows, as Column expressions. Offsets are characters, from 0, half-open."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: Latin letters that stand for Cyrillic ones in mixed words
LATIN, CYRILLIC = "aeopcxykmthbABEKMHOPCTXY", "аеорсхукмтнвАВЕКМНОРСТХУ"
#: A text is cut into chunks, as a place in a string is found by counting from its start. A chunk goes on for MARGIN characters into the next.
CHUNK, MARGIN = 2048, 512


def let(value: Column, body) -> Column:
    """body(value) with value computed once; what a lambda names without this is computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_mixed(text: Column) -> Column:
    """Latin lookalikes inside words that hold a Cyrillic letter become Cyrillic; length stays."""
    words = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    fixed = F.transform(words, lambda w: F.when(w.rlike(r"[Ѐ-ӿ]") & w.rlike("[A-Za-z]"), F.translate(w, LATIN, CYRILLIC)).otherwise(w))
    return F.when(text.rlike(r"[Ѐ-ӿ]") & text.rlike("[A-Za-z]"), F.array_join(fixed, "")).otherwise(text)


def lowered(text: Column) -> Column:
    """Lower case of equal length: a letter whose lower case is longer stays."""
    each = F.transform(F.split(text, ""), lambda c: F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(c))
    return F.when(F.length(F.lower(text)) == F.length(text), F.lower(text)).otherwise(F.array_join(each, ""))


def normalize_yo(word: Column) -> Column:
    return F.translate(word, "ёЁ", "еЕ")


def value_key(value: Column) -> Column:
    """Equal values of a text share a token by this key."""
    return F.lower(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")))


def token_key(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"(?U)\s", ""))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def cyrillic_words(text: Column) -> Column:
    """array<string> of the runs of Cyrillic letters."""
    return F.regexp_extract_all(text, F.lit("[А-ЯЁа-яё]+"), F.lit(0))


def chunked(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / CHUNK).cast("int")), lambda k: F.substring(text, k * CHUNK + 1, F.lit(CHUNK + MARGIN)))


def piece(text: Column, chunks: Column, start: Column, n: Column) -> Column:
    """n characters from start, out of the chunk if they are few."""
    near = F.substring(F.get(chunks, F.floor(start / CHUNK).cast("int")), (start % CHUNK + 1).cast("int"), n)
    return F.when(n <= MARGIN, near).otherwise(F.substring(text, start + 1, n))


def window_before(text: Column, start: Column, n: int) -> Column:
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def window_after(text: Column, end: Column, n: int) -> Column:
    """n - 1 characters if n follow, else all."""
    return F.substring(text, end + 1, F.when(F.length(text) - end >= n, n - 1).otherwise(n))


def word_before(before: Column) -> Column:
    """The last word of what stands before."""
    return F.regexp_extract(before, r"(\S+)\s*$", 1)


def word_after(after: Column) -> Column:
    return F.regexp_extract(after, r"^\s*(\S+)", 1)


def parts_pattern(words) -> str:
    """Any of the words, at a place the longest first. What words begin with alike is written, and looked at, once."""

    def rest(tails: list[str]) -> str:
        by_first = {c: [t[1:] for t in tails if t[:1] == c] for c in sorted({t[0] for t in tails if t})}
        each = [re.escape(c) + rest(own) for c, own in by_first.items()]
        if "" in tails:
            return f"(?:{'|'.join(each)})?" if each else ""
        return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"

    return rest(list(set(words))) if words else ""


def word_pattern(words) -> str:
    """Any of the words standing by itself; a phrase with a space anywhere."""
    single, phrases = [w for w in words if " " not in w], [w for w in words if " " in w]
    bordered = rf"(?<![\p{{L}}\p{{N}}])(?:{parts_pattern(single)})(?![\p{{L}}\p{{N}}])"
    return "|".join(p for p in (bordered if single else "", parts_pattern(phrases)) if p)


def contains_word(window: Column, words) -> Column:
    return window.rlike(word_pattern(words)) if words else F.lit(False)


def contains_part(window: Column, words) -> Column:
    return window.rlike(parts_pattern(words)) if words else F.lit(False)


def sentence_key(text: Column, start: Column, ends: str = ".\n") -> Column:
    """How many sentence ends stand before; equal for places of one sentence."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), start), f"[^{ends}]", ""))


def byte_offset(text: Column, start: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), start))


def sentence_start(before: Column) -> Column:
    return before.rlike(r"(^|[.!?;])\s*$")


def in_guillemets(before: Column, after: Column) -> Column:
    return (F.locate("«", before) > 0) & ~before.rlike("»[^«]*$") & after.rlike("^[^«]*»")


# fixed values: letters by which Cyrillic ones are written in Latin
TRANSLITERATED = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya".split(), strict=True))


def transliterate(text: Column) -> Column:
    """Cyrillic in Latin letters, lower case; other characters go."""
    table = F.create_map(*[F.lit(x) for c, t in TRANSLITERATED.items() for x in (c, t.replace("-", ""))])
    return F.array_join(F.transform(F.split(F.lower(text), ""), lambda c: F.coalesce(F.element_at(table, c), F.lit(""))), "")
