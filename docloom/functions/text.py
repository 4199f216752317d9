"""Text clean-up and tokens as Column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, functions as F

from .rows import let

# Token length bounds and the letter class of a token.
MIN_TOKEN, MAX_TOKEN = 2, 15
TOKEN_PATTERN = r"[\p{L}\p{Nl}\p{No}_]+"
# what parts tokens: the complement, which asks the commonest range first
TOKEN_BREAK = r"[^a-z\p{L}\p{Nl}\p{No}_]+"


# Fixed value: members of the Unicode white-space class; Java's \\s alone is ASCII only.
WS = (
    r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def clean_text(c: Column) -> Column:
    """Drop e-mail-like tokens, squeeze white space, drop single quotes.

    The patterns start only at a token's begin and leave lone blanks alone, which keeps both
    passes linear and cheap on ordinary text. Printable ASCII is told by one range before the long class is asked.
    """
    out = F.regexp_replace(without_mail(c), rf"(?![!-~])(?:[{WS}]{{2,}}|[{WS}&&[^ ]])", " ")
    return F.replace(out, F.lit("'"), F.lit(""))


def without_mail(c: Column) -> Column:
    """Drop e-mail-like tokens with one white space behind."""
    mail = rf"(?<![!-~])(?<![^{WS}])(?:[!-?A-~]++|[^{WS}@])*+@(?:[!-~]++|[^{WS}])*+[{WS}]?"
    return F.when(c.contains("@"), F.regexp_replace(c, mail, "")).otherwise(c)


@cache
def accent_table() -> tuple[str, str]:
    """Equal-length strings for ``translate``: each accented letter and its base letter."""
    found, base = [], []
    for code in range(0xC0, sys.maxunicode + 1):
        ch = chr(code)
        if unicodedata.category(ch) in ("Cn", "Cs", "Co"):
            continue
        stripped = "".join(
            x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn"
        )
        stripped = unicodedata.normalize("NFC", stripped)
        if len(stripped) == 1 and stripped != ch:
            found.append(ch)
            base.append(stripped)
    return "".join(found), "".join(base)


def fold_accents(c: Column) -> Column:
    """Base letters; ASCII texts, told by their byte count, are left as they are."""
    found, base = accent_table()
    return let(
        c,
        lambda v: F.when(F.octet_length(v) == F.length(v), v).otherwise(
            F.regexp_replace(F.translate(v, found, base), r"\p{Mn}", "")
        ),
    )


def raw_tokens(c: Column) -> Column:
    """Lower-case, de-accented alphabetic runs of any length."""
    return F.regexp_extract_all(fold_accents(F.lower(c)), F.lit(TOKEN_PATTERN), F.lit(0))


def tokens(c: Column, shortest: int = MIN_TOKEN, longest: int = MAX_TOKEN) -> Column:
    """Tokens within the length bounds that do not start with an underscore.

    The text is split at what parts tokens, cheaper than extracting each; empty ends are no tokens.
    """
    return F.filter(
        F.split(fold_accents(F.lower(c)), TOKEN_BREAK),
        lambda t: F.length(t).between(max(1, shortest), longest) & ~t.startswith("_"),
    )


def clean_tokens(c: Column) -> Column:
    """``tokens(clean_text(c))``; white space only parts tokens, so it is not squeezed first."""
    return tokens(F.replace(without_mail(c), F.lit("'"), F.lit("")))


def stop_words(extra: Iterable[str] = ()) -> list[str]:
    """Spark's English list plus the caller's own words."""
    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *extra})


def without_words(token_list: Column, words: Iterable[str]) -> Column:
    """Remove words but keep duplicates of the rest (``array_except`` would not)."""
    banned = sorted(set(words))
    return F.filter(token_list, lambda t: ~t.isin(banned))


def search_terms(c: Column) -> Column:
    """Analysed form used by the ``match`` predicate: lower-case letter or digit runs."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
