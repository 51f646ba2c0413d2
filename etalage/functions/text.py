"""Text normalisation for product names, prices, links and messages."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from etalage import vocab


def collapse_spaces(text: Column) -> Column:
    """Trim, and turn every run of whitespace into one space."""
    return F.trim(F.regexp_replace(text, vocab.WHITESPACE, " "))


def clean_name(text: Column) -> Column:
    return F.coalesce(collapse_spaces(text), F.lit(""))


def blank_to_null(name: str) -> Column:
    """The named text column with the spellings of a missing value as null."""
    spellings = ", ".join(f"'{t}'" for t in vocab.NA_TEXTS)
    return F.expr(f"CASE WHEN `{name}` NOT IN ({spellings}) THEN `{name}` END")


@lru_cache(maxsize=8)
def _folding(alphabet: str = "") -> tuple[str, str, dict[str, str]]:
    """Compatibility folding by rule: decompose each character and drop its marks.

    With an ``alphabet``, only the foldings that stay inside it.

    Returns the characters that fold to one character (as a ``translate`` pair,
    with the pure marks at the end so that they are deleted) and the table of
    those that fold to several.  Hangul syllables are left composed.
    """
    single, marks, several = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if not (unicodedata.decomposition(char) or unicodedata.combining(char)):
            continue
        folded = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if folded == char or (alphabet and not set(folded) <= set(alphabet)):
            continue
        if not folded:
            marks.append(char)
        elif len(folded) == 1:
            single.append((char, folded))
        else:
            several[char] = folded
    source = "".join(c for c, _ in single) + "".join(marks)
    return source, "".join(f for _, f in single), several


def _char_class(chars: list[str]) -> str:
    """A character class of the given characters, neighbours joined to ranges."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def strip_accents(text: Column, alphabet: str = "") -> Column:
    """Fold compatibility forms and drop combining marks; null becomes ''.

    Plain ASCII, the common case, is recognised first and passed through; the
    several-character foldings (ligatures, fractions, squared units) are looked
    up only in texts that hold one.
    """
    source, target, several = _folding(alphabet)
    table = F.str_to_map(
        F.lit("\x02".join(f"{c}\x01{f}" for c, f in several.items())), F.lit("\x02"), F.lit("\x01")
    )
    expanded = F.array_join(
        F.transform(
            F.split(text, ""), lambda char: F.coalesce(F.try_element_at(table, char), char)
        ),
        "",
    )
    folded = F.when(text.rlike(_char_class(list(several))), F.translate(expanded, source, target))
    folded = folded.otherwise(F.translate(text, source, target))
    return F.when(text.isNull(), F.lit("")).when(text.rlike(r"[^\x00-\x7f]"), folded).otherwise(text)


def map_label(text: Column, labels: dict[str, str]) -> Column:
    """Canonical label of a free-text label; unknown ones are only tidied.

    A character whose folding leaves the labels' own alphabet cannot lead to a
    label, so only the others need folding.
    """
    spelled = F.coalesce(text, F.lit("nan"))
    trimmed = F.regexp_replace(F.lower(spelled), vocab.EDGE_WHITESPACE, "")
    folded = strip_accents(trimmed, "".join(sorted(set("".join(labels)))))
    known = F.str_to_map(
        F.lit("\x02".join(f"{k}\x01{v}" for k, v in labels.items())), F.lit("\x02"), F.lit("\x01")
    )
    return F.coalesce(F.try_element_at(known, folded), collapse_spaces(spelled))


def normalize_store(text: Column) -> Column:
    return map_label(text, vocab.STORE_LABELS)


def normalize_category(text: Column) -> Column:
    return map_label(text, vocab.CATEGORY_LABELS)


def quantity_text(text: Column) -> Column:
    """Lower-case and spell every quantity the same way."""
    out = F.lower(text)
    for pattern, replacement in vocab.QUANTITY_REWRITES:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def drop_words(text: Column, words: tuple[str, ...], single_chars: bool = False) -> Column:
    """Remove whole space-separated words, then tidy.

    A look-around pattern keeps this a plain string expression, so it stays in
    generated code where a split-filter-join over an array would not.
    """
    choices = "|".join(words) + (r"|\S" if single_chars else "")
    return collapse_spaces(F.regexp_replace(text, rf"(?U)(?<!\S)(?:{choices})(?!\S)", " "))


def clean_spelled(spelled: Column) -> Column:
    """Second half of the name cleaning: input has gone through ``quantity_text``."""
    out = strip_accents(spelled)
    for phrase in vocab.NOISE_PHRASES:
        out = F.regexp_replace(out, phrase, " ")
    out = collapse_spaces(F.regexp_replace(out, vocab.PUNCTUATION, " "))
    return drop_words(out, vocab.PACKAGING_WORDS)


def clean_product_name(raw: Column) -> Column:
    return clean_spelled(quantity_text(raw))


def price_text(text: Column) -> Column:
    """The FCFA amount in a price label; spaces, dots and commas only group digits."""
    digits = F.regexp_replace(
        F.regexp_extract(text, vocab.PRICE_TEXT, 1), vocab.PRICE_SEPARATORS, ""
    )
    return digits.try_cast("double")


def resolve_url(href: Column, store: Column) -> Column:
    """Absolute link: two shops complete rooted links only, the third any relative one."""
    sites = F.create_map(*[F.lit(part) for pair in vocab.STORE_SITES.items() for part in pair])
    site = F.try_element_at(sites, store)
    relative = F.when(
        store == "Diarle", (href != "") & ~href.startswith("http")
    ).otherwise(href.startswith("/"))
    return F.when(site.isNotNull() & relative, F.concat(site, href)).otherwise(href)


def normalize_message(text: Column) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return collapse_spaces(F.regexp_replace(lowered, vocab.MESSAGE_NOISE, " "))
