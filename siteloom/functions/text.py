"""Text columns: folding, tokens, stems, shingles, sentences, counts. All Catalyst expressions; nulls count as ''."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims


def folded(text: Column) -> Column:
    """Lower case, Polish letters without their marks."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), dims.FOLD_FROM, dims.FOLD_TO)


def normalized(text: Column) -> Column:
    """``folded``; anything but a-z, 0-9 and white space as a blank; single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), r"[^a-z0-9\s]", " "), r"\s+", " "))


def stemmed(token: Column, suffixes: str = dims.TEXT_SUFFIXES) -> Column:
    """Without the first suffix of the list that leaves three letters; tokens of up to four letters or with digits stay."""
    out = F.when((F.length(token) <= 4) | token.rlike("[0-9]"), token)
    for s in suffixes.split():
        out = out.when(token.endswith(s) & (F.length(token) - len(s) >= 3), F.substring(token, F.lit(1), F.length(token) - len(s)))
    return out.otherwise(token)


def kept_text(text: Column, stop: str = dims.TEXT_STOP, least: int = 3) -> Column:
    """The words of ``raw_tokens``, parted by blanks.

    Short and stop words are cut out of the whole text by one pattern, so no function is called per word.
    """
    gone = "|".join([f"[a-z0-9]{{1,{least - 1}}}", *[w for w in dict.fromkeys(stop.split()) if w.isascii() and len(w) >= least]])
    return F.trim(F.regexp_replace(normalized(text), f"(?<![a-z0-9])(?:{gone})(?![a-z0-9])", ""))


def raw_tokens(text: Column, stop: str = dims.TEXT_STOP, least: int = 3) -> Column:
    """Normalised words of at least ``least`` letters that are not in the stop list."""
    return F.filter(F.split(kept_text(text, stop, least), " +"), lambda w: w != "")


def _stem_pattern(suffixes: str) -> tuple[str, str]:
    """``stemmed`` as a pattern, for use within arrays: alternatives are tried in the order of the list."""
    endings = suffixes.split()
    return "^(?=.{5})(?!.*[0-9])(?:" + "|".join(f"(.{{3,}}){s}" for s in endings) + ")$", "".join(f"${i + 1}" for i in range(len(endings)))


def tokens(text: Column, stop: str = dims.TEXT_STOP, least: int = 3, suffixes: str = dims.TEXT_SUFFIXES) -> Column:
    pattern, kept = _stem_pattern(suffixes)
    return F.transform(raw_tokens(text, stop, least), lambda t: F.regexp_replace(t, pattern, kept))


class Stems(dict):
    """``stemmed`` of the words that ``raw_tokens`` keeps, '' for all others; for use in Python, where a word is stemmed once for as long as this lives."""

    def __init__(self, stop: str = dims.TEXT_STOP, least: int = 3, suffixes: str = dims.TEXT_SUFFIXES):
        self.stop, self.least, self.suffixes = {*stop.split()}, least, suffixes.split()
        self.fold, self.words = [*zip(dims.FOLD_FROM, dims.FOLD_TO, strict=True)], re.compile("[a-z0-9]+").findall

    def __missing__(self, w: str) -> str:
        out = "" if len(w) < self.least or w in self.stop else w
        if len(out) > 4 and not any(c.isdigit() for c in w):
            for x in self.suffixes:
                if w.endswith(x) and len(w) - len(x) >= 3:
                    out = w[: -len(x)]
                    break
        self[w] = out
        return out

    def of(self, text: str | None) -> list[str]:
        """``tokens`` of a text."""
        t = (text or "").lower()
        for a, b in () if t.isascii() else self.fold:  # faster than translate() by far
            t = t.replace(a, b)
        return [*filter(None, map(self.__getitem__, self.words(t)))]


def token_rows(df, keep: list[Column], text: Column, name: str = "term", stop: str = dims.TEXT_STOP, least: int = 3, suffixes: str = dims.TEXT_SUFFIXES):
    """``keep`` and one row per token; stemmed after the explode, in generated code. ``explode`` would get a filter below it that parts each text again."""
    rows = df.select(*keep, F.explode_outer(F.split(kept_text(text, stop, least), " +")).alias(name)).filter(F.col(name) != "")
    return rows.withColumn(name, stemmed(F.col(name), suffixes))


def keyword_tokens(text: Column) -> Column:
    """The keyword matcher's tokens: two letters or more, its own stop and suffix lists."""
    return tokens(text, dims.KEYWORD_STOP, 2, dims.KEYWORD_SUFFIXES)


def stemmed_phrase(text: Column) -> Column:
    return F.array_join(keyword_tokens(text), " ")


def let(value: Column, use) -> Column:
    """``use(x)`` with x bound to a value that is computed once per row, also where ``use`` has lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def runs_of_words(words_: Column, k: int) -> Column:
    """All runs of ``k`` elements, joined by blanks; ``words_`` must be a column or lambda variable (see ``let``)."""
    return F.when(F.size(words_) >= k, F.transform(F.sequence(F.lit(1), F.size(words_) - (k - 1)), lambda i: F.array_join(F.slice(words_, i, k), " "))).otherwise(F.array().cast("array<string>"))


def shingles(text: Column, k: int = dims.SHINGLE) -> Column:
    """The different runs of ``k`` words (letters and digits of any script, lower case)."""
    words_ = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return let(words_, lambda w: F.array_distinct(runs_of_words(w, k)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays without repeats; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def sentences(text: Column) -> Column:
    """Parts between sentence ends that are followed by white space, with three words or more."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?…]+\s"), lambda s: F.size(words(s)) >= 3)


def average_sentence(text: Column) -> Column:
    return F.round(word_count(text) / F.greatest(F.size(sentences(text)), F.lit(1))).cast("long")


def readability(text: Column) -> Column:
    """0 (hard) to 100 (easy) from sentence and word length."""
    n = word_count(text)
    letters = F.when(n > 0, F.length(F.regexp_replace(text, r"\s", "")) / n).otherwise(5.0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.lit(120) - average_sentence(text) * 2.2 - letters * 5))).cast("long")


def fluff_count(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?i)" + p)) for p in dims.FLUFF]).cast("long")


def stat_count(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (F.regexp_count(t, F.lit("(?i)" + dims.UNIT)) + F.regexp_count(t, F.lit(dims.PERCENT))).cast("long")


def entities(text: Column, least: int = 1, most: int = 4) -> Column:
    """Runs of ``least`` to ``most`` capitalised words, in order of appearance."""
    word = f"[{dims.CAPITAL}][{dims.SMALL}]+"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"{word}(?:\s+{word}){{{least - 1},{most - 1}}}"), F.lit(0))


def clipped_share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def grade(score: Column, scale=dims.SITE_GRADES) -> Column:
    out = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, letter in scale:
        out = out.when(score >= least, letter)
    return out.otherwise("F")
