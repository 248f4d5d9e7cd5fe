"""Text analysis: tokens, stop-words, stemming, predicates on names and contents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Letters, numbers and _; the usual ones first, as they are tested in this order.
TOKEN = r"[a-z0-9_\p{L}\p{N}]+"

# Parts of names of files that aren't pages.
EXCLUDED_NAMES = (
    ".css", ".js", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".woff", ".woff2", ".ttf", ".eot", "license", "copyright", "apache", "sil", "boost", "libogg",
    "jsoncons", "boutros", "xiph", "v8update", "style", "script",
)
# One of these is part of a page's path.
PAGE_PATHS = ("global-methods", "global-properties", "objects", "enums", "constructors", "methods", "properties", "events", "functions", "types")
# None of these is part of a page's text.
EXCLUDED_CONTENT = (
    "apache license", "sil open font license", "boost software license", "copyright", "license", "font software", "redistribution",
    "permission is hereby granted", "libogg", "jsoncons", "boutros international", "xiph.org foundation",
)
# One of these is.
PAGE_CONTENT = (
    "синтаксис", "параметры", "возвращаемое значение", "описание", "пример", "методы", "свойства", "события", "перечисление", "объект", "функция",
    "syntax", "parameters", "return value", "description", "example", "methods", "properties", "events", "enumeration", "object", "function",
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, then) -> Column:
    """then(value): the value is computed once a row, however often `then` names it."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def stop_words(spark: SparkSession, language: str = "russian") -> list[str]:
    """Spark ML's list of a language; needs no download."""
    from pyspark.ml.feature import StopWordsRemover

    return list(StopWordsRemover.loadDefaultStopWords(language))


def tokens(text: str | Column, stops: list[str] | None = None, stem=None) -> Column:
    """Lower-cased runs of letters, numbers and _; without stop-words; stemmed if a stemmer (of one word) is given; empty for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    found = F.filter(found, lambda t: ~t.isin(stops)) if stops else found
    return stemmed(found, stem) if stem else found


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    """Whether the text has one of the parts."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def is_page_name(name: str | Column) -> Column:
    """A page's file name: none of the excluded parts, ends with .html, a known kind of path; parts in any case."""
    low = F.lower(col(name))
    return ~any_of(low, EXCLUDED_NAMES) & col(name).endswith(".html") & any_of(low, PAGE_PATHS)


def is_page_content(text: str | Column) -> Column:
    low = F.lower(col(text))
    return ~any_of(low, EXCLUDED_CONTENT) & any_of(low, PAGE_CONTENT)


def not_blank(text: str | Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(col(text), r"(?U)\s+", "")) > 0, F.lit(False))


def stripped(text: str | Column) -> Column:
    """Without white space, of any kind, at the ends."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


# Endings of the published Snowball stemmer for Russian, by group.
VOWELS = "аеиоуыэюя"
GERUND_1, GERUND_2 = ("вшись", "вши", "в"), ("ывшись", "ившись", "ывши", "ивши", "ыв", "ив")
ADJECTIVE = "ими ыми его ого ему ому ее ие ые ое ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею".split()
PARTICIPLE_1, PARTICIPLE_2 = ("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ")
REFLEXIVE = ("ся", "сь")
VERB_1 = "ете йте ешь нно ла на ли ем ло но ет ют ны ть й л н".split()
VERB_2 = "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю".split()
NOUN = "иями ями ами ией иям ием иях ев ов ие ье еи ии ей ой ий ям ем ам ом ах ях ию ью ия ья а е и й о у ы ь ю я".split()
SUPERLATIVE, DERIVATIONAL = ("ейше", "ейш"), ("ость", "ост")


def stem_russian(word: str) -> str:
    """The published Snowball algorithm; words without Russian vowels stay."""
    word = word.replace("ё", "е")
    first = next((i for i, c in enumerate(word) if c in VOWELS), None)
    if first is None:
        return word
    head, rv = word[: first + 1], word[first + 1 :]
    # R2: behind the second change from vowel to consonant, counted from the word's start.
    at = 0
    for _ in range(2):
        while at < len(word) and word[at] not in VOWELS:
            at += 1
        while at < len(word) and word[at] in VOWELS:
            at += 1
        at += 1
    r2 = min(at, len(word)) - len(head)

    def longest(endings, guarded=()) -> str | None:
        """rv without its longest ending; `guarded` ones count only after а or я."""
        fits = [e for e in endings if rv.endswith(e)] + [e for e in guarded if rv.endswith(e) and rv[: -len(e)].endswith(("а", "я"))]
        return rv[: -len(max(fits, key=len))] if fits else None

    done = longest(GERUND_2, GERUND_1)
    if done is None:
        rv = longest(REFLEXIVE) if longest(REFLEXIVE) is not None else rv
        done = longest(ADJECTIVE)
        if done is not None:
            rv = done
            done = longest(PARTICIPLE_2, PARTICIPLE_1)
            done = rv if done is None else done
        else:
            done = longest(VERB_2, VERB_1)
            if done is None:
                done = longest(NOUN)
    rv = rv if done is None else done
    rv = rv.removesuffix("и")
    for e in DERIVATIONAL:
        if rv.endswith(e) and len(rv) - len(e) >= r2:
            rv = rv.removesuffix(e)
            break
    if rv.endswith("нн"):
        return head + rv[:-1]
    for e in SUPERLATIVE:
        if rv.endswith(e):
            rv = rv.removesuffix(e)
            return head + (rv[:-1] if rv.endswith("нн") else rv)
    return head + rv.removesuffix("ь")


def stemmed(tokens_col: str | Column, stem=stem_russian) -> Column:
    """Stems of an array of tokens, by an Arrow UDF; the stemmer can be another language's."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for s in batches:
            out = []
            for ts in s:
                for t in ts if ts is not None else ():
                    if t not in known:
                        known[t] = stem(t)
                out.append([known[t] for t in ts] if ts is not None else None)
            yield pd.Series(out)
            if len(known) > 1_000_000:
                known.clear()

    return run(col(tokens_col))
