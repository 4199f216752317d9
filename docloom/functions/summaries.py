"""Keywords and extractive summaries of a text within its row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from .rows import let
from .text import tokens, without_words

# How many keywords and sentences, and the share of title, keywords and position in a sentence's weight.
KEYWORDS, SENTENCES = 10, 5
TITLE_SHARE, KEYWORD_SHARE, PLACE_SHARE = 0.4, 0.4, 0.2


def sentences(text: Column) -> Column:
    """Lines cut after ``.``, ``!`` or ``?`` where white space follows; empty pieces go."""
    lines = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), r"\n+")
    return F.filter(F.transform(lines, lambda s: F.trim(s)), lambda s: s != "")


def weighty(text: Column, stop: Iterable[str]) -> Column:
    """Tokens of a text without stop words."""
    return without_words(tokens(text), stop)


def counted(words: Column) -> Column:
    """Sorted array of ``(less, term)``: minus the count of each distinct word, most frequent first, then by word."""

    def runs(s: Column) -> Column:
        begins = F.array_compact(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)))
        end = lambda b, k: F.coalesce(F.get(b, k + 1), F.size(s))
        return let(begins, lambda b: F.transform(b, lambda at, k: F.struct((at - end(b, k)).alias("less"), F.get(s, at).alias("term"))))

    return F.sort_array(let(F.sort_array(words), runs))


def sentence_scores(each: Column, title: Column, keys: Column, stop: Iterable[str]) -> Column:
    """``(less, at, text)`` of every sentence: minus its weight, its place, and itself.

    A weight has three parts: the share of the title's words that the sentence holds, how often its words are keywords (each
    as heavy as it is frequent, divided by the heaviest) per word, and how early it stands.
    """
    weights = F.map_from_entries(F.transform(keys, lambda k: F.struct(k["term"], (-k["less"]).cast("double"))))
    known = F.struct(F.array_distinct(weighty(title, stop)).alias("named"), weights.alias("weights"), (-F.get(keys, F.lit(0))["less"]).alias("top"))

    def score(known: Column, words: Column, i: Column) -> Column:
        n, named = F.size(words), known["named"]
        told = F.when(F.size(named) > 0, F.size(F.array_intersect(named, words)) / F.size(named)).otherwise(0.0)
        hits = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(known["weights"], w), F.lit(0.0)))
        keyed = F.when(n > 0, hits / known["top"] / n).otherwise(0.0)
        return -F.round(TITLE_SHARE * told + KEYWORD_SHARE * keyed + PLACE_SHARE / (i + 1), 9)

    def scored(known: Column) -> Column:
        return F.transform(
            each, lambda s, i: F.struct(let(weighty(s, stop), lambda words: score(known, words, i)).alias("less"), i.alias("at"), s.alias("text"))
        )

    return let(known, scored)


def best_sentences(scored: Column, count: int = SENTENCES) -> Column:
    """The heaviest sentences in the order of the text, one a line; null without any."""
    chosen = F.slice(F.sort_array(scored), 1, count)
    in_order = F.sort_array(F.transform(chosen, lambda s: F.struct(s["at"], s["text"])))
    return F.when(F.size(scored) > 0, F.array_join(F.transform(in_order, lambda s: s["text"]), "\n"))
