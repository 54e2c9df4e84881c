"""Language of lines, segments and pages by language-bitmask n-gram filters.

One array of bit masks serves as Bloom filters of all languages at once (bit-sliced): a slot holds, for each language,
whether an n-gram of that language was hashed to it. Looking up an n-gram in its slots and intersecting the masks gives
every language that contains it. The languages' popcounts, corrected for the filters' false positives, decide.

The filters are fitted on the texts' own labels, wrong ones included, and then on what they themselves make of these
texts, until they agree: an n-gram counts for a language only if it is nearly as frequent there as anywhere, so labels
that are wrong now and then leave few traces. No word list takes part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import classified
from .lines import Lines, count, words_of
from .residue import excluded
from .words import LANGUAGES

N = 4
BITS = 18
TRAIN_PAGES = 4000
MIN_WORDS = 12
ROUNDS = 3
#: A decision is clear from this confidence on (0.5: two languages are as likely), and from so many n-grams on.
CLEAR = 0.65
MIN_GRAMS = 6
#: Least confidence of a line that tells on its page's label.
LEAST = 0.55


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, digits and punctuation as blanks, a blank before and after each; start of each text."""
    clean = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " ")
    padded = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), clean, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    lengths = pc.utf8_length(padded).to_numpy(zero_copy_only=False).astype(np.int64)
    data = "".join(padded.to_pylist()).encode("utf-32-le")
    return np.frombuffer(data, np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def _grams(codes: np.ndarray) -> np.ndarray:
    h = codes[: len(codes) - N + 1].astype(np.uint32)
    for j in range(1, N):
        h = h * np.uint32(0x01000193) ^ codes[j : len(codes) - N + 1 + j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    return h


class LanguageFilters:
    """Bit-sliced Bloom filters: ``masks[slot]`` has bit l if an n-gram of language l was hashed there; two slots an n-gram."""

    def __init__(self, masks: np.ndarray, languages: tuple[str, ...] = LANGUAGES):
        self.masks, self.languages = masks, languages
        fill = np.array([((masks >> i) & 1).mean() for i in range(len(languages))])
        self.false_positive = fill**2

    @staticmethod
    def _slots(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.uint32((1 << BITS) - 1)
        return grams & size, (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], min_count: int = 3, least_share: float = 0.2) -> "LanguageFilters":
        """From labelled lines. An n-gram belongs to a language if it is at least ``least_share`` as frequent there as where it is most frequent."""
        masks = np.zeros(1 << BITS, np.uint8)
        counted = {}
        for i, code in enumerate(LANGUAGES):
            own = [t for t, x in zip(texts, labels) if x == code]
            if own:
                codes, _ = _codes(pa.array(own, pa.large_string()))
                if len(codes) >= N:
                    g, c = np.unique(_grams(codes), return_counts=True)
                    counted[i] = (g, c, c.sum())
        if counted:
            every = np.unique(np.concatenate([g for g, _, _ in counted.values()]))
            most = np.zeros(len(every))
            for g, c, total in counted.values():
                at = np.searchsorted(every, g)
                most[at] = np.maximum(most[at], c / total)
            for i, (g, c, total) in counted.items():
                keep = (c >= min_count) & (c / total >= least_share * most[np.searchsorted(every, g)])
                for slots in cls._slots(g[keep]):
                    masks[slots] |= np.uint8(1 << i)
        return cls(masks)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """For each text the popcount of each language, corrected for false positives."""
        codes, start = _codes(texts)
        n = len(texts)
        scores = np.zeros((n, len(self.languages)))
        if len(codes) < N or n == 0:
            return scores
        g = _grams(codes)
        a, b = self._slots(g)
        mask = self.masks[a] & self.masks[b]
        begin = np.minimum(start[:-1], len(mask) - 1)
        size = np.maximum(start[1:] - start[:-1] - N + 1, 0)
        valid = np.ones(len(mask), bool)
        # n-grams that reach over the end of a text are not its own
        for j in range(1, N):
            over = start[1:] - j
            valid[over[(over >= 0) & (over < len(mask))]] = False
        mask = np.where(valid, mask, 0)
        for i in range(len(self.languages)):
            hits = np.add.reduceat((mask >> i) & 1, begin, dtype=np.int64)
            scores[:, i] = np.maximum(hits - size * self.false_positive[i], 0) / (1 - self.false_positive[i])
        scores[size == 0] = 0
        return scores

    def decide(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language of each text (-1: no n-gram of any) and the confidence, 0.5 (a tie) to 1."""
        return choose(self.scores(texts))


def choose(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best column of each row (-1: all are 0), and its share of what it and the second best have."""
    if not len(scores):
        return np.zeros(0, np.int64), np.zeros(0)
    best = scores.argmax(1)
    top = scores[np.arange(len(scores)), best]
    second = np.partition(scores, -2, axis=1)[:, -2]
    none = top <= 0
    return np.where(none, -1, best), np.where(none, 0.0, top / np.maximum(top + second, 1e-9))


def named_language(label):
    """Column: the two-letter code that a language label names, with or without a region; null if it names none."""
    clean = F.lower(F.regexp_replace(label, r"^[\s ﻿]+|[\s ﻿]+$", ""))
    found = F.regexp_extract(clean, r"^([a-z]{2})(?:[-_](?:[a-z]{2}|[0-9]{3}))?$", 1)
    return F.when(found != "", found)


def train_filters(pages: DataFrame, text: str = "body_sample", label: str = "html_lang", rows: int = TRAIN_PAGES, rounds: int = ROUNDS) -> LanguageFilters:
    """Filters from the lines of at most ``rows`` pages whose label names a language (those with the smallest hashes of
    page_id). After the first fit each line goes to the language that the filters give it, if they are clear about it;
    this is repeated ``rounds`` times. The bound is a parameter; corpus size changes nothing else."""
    named = named_language(F.col(label))
    able = pages.filter((F.length(text) > 0) & named.isin(*LANGUAGES))
    ids = able.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(rows)
    sample = able.join(F.broadcast(ids), "page_id", "left_semi").select(named, text).collect()
    kept = [(line, code) for code, t in sample for line in t.split("\n") if line.count(" ") >= 7]
    texts, labels = [x for x, _ in kept], [x for _, x in kept]
    filters = LanguageFilters.fit(texts, labels)
    for _ in range(rounds if texts else 0):
        best, sure = filters.decide(pa.array(texts, pa.large_string()))
        labels = [LANGUAGES[i] if i >= 0 and c >= CLEAR else "" for i, c in zip(best, sure)]
        filters = LanguageFilters.fit(texts, labels)
    return filters


def is_tag_list(flat: pa.Array, words: np.ndarray) -> np.ndarray:
    """Lines that only list tags: separators nearly as many as words, and no sentence."""
    marks = count(flat, r"[,;|#·•/]| - ")
    return (marks >= 0.34 * np.maximum(words, 1)) & (count(flat, r"[.!?…](?: |$)") == 0)


LINE = "page_id long, line_no long, lang string, confidence double"


def _decided(ids: np.ndarray, L: Lines, at: np.ndarray, filters: LanguageFilters) -> pa.RecordBatch:
    best, sure = filters.decide(L.flat.take(pa.array(at)))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[L.page[at]]), pa.array(L.no[at], pa.int64()), pa.array(filters.languages).take(pa.array(best, pa.int64(), mask=best < 0)), pa.array(sure)],
        names=["page_id", "line_no", "lang", "confidence"],
    )


def line_languages(pages: DataFrame, filters: LanguageFilters, text: str = "body_sample", min_words: int = MIN_WORDS) -> DataFrame:
    """``page_id, line_no, lang, confidence`` of each line of at least ``min_words`` words that is no mere tag list.

    Null, empty and wordless texts give no rows; a line without a known n-gram has a null language and confidence 0.
    """
    shared = pages.sparkSession.sparkContext.broadcast(filters)

    def run(frames):
        for b in frames:
            for start in range(0, b.num_rows, 1000):
                c = b.slice(start, 1000)
                L = Lines(c.column("text"))
                words = words_of(L.flat)
                yield _decided(c.column("page_id").to_numpy(zero_copy_only=False), L, np.flatnonzero((words >= min_words) & ~is_tag_list(L.flat, words)), shared.value)

    return pages.filter(F.length(text) > 0).select("page_id", F.col(text).alias("text")).mapInArrow(run, LINE)


def judged_line_languages(pages: DataFrame, links: DataFrame, filters: LanguageFilters, text: str = "body_sample", min_words: int = MIN_WORDS) -> DataFrame:
    """``line_languages`` without the pages that are template residue or keyword and link lists: they have no language of their own."""
    shared = pages.sparkSession.sparkContext.broadcast(filters)

    def emit(b, k, own, x, at):
        L = k.lines
        keep = (k.words[at] >= min_words) & ~excluded(b, k, own, x, at)[L.page[at]]
        lines = at[keep]
        yield _decided(b.column("row_id").to_numpy(zero_copy_only=False), L, lines[~is_tag_list(L.flat.take(pa.array(lines)), k.words[lines])], shared.value)

    return classified(pages, links, text, emit, LINE)


def page_languages(lines: DataFrame) -> DataFrame:
    """``page_id, lang, lines, confidence`` for each language of a page; confidence: the mean of its lines."""
    return lines.filter("lang is not null").groupBy("page_id", "lang").agg(F.count("*").alias("lines"), F.avg("confidence").alias("confidence"))


def mislabelled(pages: DataFrame, lines: DataFrame, least: float = LEAST) -> DataFrame:
    """``page_id, lang``: languages of a page's lines that its label (html_lang) does not name. A language needs a line with
    a confidence of at least ``least``; below it the two best languages are too close for a single line to tell."""
    found = lines.filter((F.col("confidence") >= least) & F.col("lang").isNotNull()).select("page_id", "lang").distinct()
    label = pages.select("page_id", named_language(F.col("html_lang")).alias("named"))
    return found.join(label, "page_id").filter(~F.col("lang").eqNullSafe(F.col("named"))).select("page_id", "lang").distinct()


def _smoothed(scores: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Language of each unit: its own where it is clear; else that of the run of unclear units that it stands in; else
    the page's. -1 where a page has no known n-gram."""
    best, sure = choose(scores)
    clear = (sure >= CLEAR) & (scores.max(1) >= MIN_GRAMS)
    new = np.ones(len(page), bool)
    new[1:] = (page[1:] != page[:-1]) | (clear[1:] != clear[:-1])
    new |= clear
    run = np.cumsum(new) - 1
    sums = np.stack([np.bincount(run, weights=scores[:, i]) for i in range(scores.shape[1])], 1)
    of_run, run_sure = choose(sums)
    of_run = np.where((run_sure >= CLEAR) & (sums.max(1) >= MIN_GRAMS), of_run, -1)
    whole = np.stack([np.bincount(page, weights=scores[:, i]) for i in range(scores.shape[1])], 1)
    of_page, _ = choose(whole)
    out = np.where(clear, best, of_run[run])
    return np.where(out < 0, of_page[page], out)


def segments(pages: DataFrame, filters: LanguageFilters, text: str = "body_sample") -> DataFrame:
    """``page_id, segment, first_line, last_line, begin_at, end_at, lang, confidence``: every text cut into stretches of one language.

    The units are sentences (a line without a full stop is one). A unit of its own accord clear about its language keeps it;
    units that are not, such as headings and list entries, are taken together with their unclear neighbours, and where
    these are not clear either go with the page. Neighbours of the same language make one segment; ``begin_at`` and ``end_at`` (exclusive) count
    code points of the text, all of whose non-blank lines are covered. A text without a known n-gram is one segment of null language and
    confidence 0; null, empty and blank texts give no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(filters)

    def run(frames):
        f = shared.value
        for b in frames:
            for start in range(0, b.num_rows, 1000):
                c = b.slice(start, 1000)
                L = Lines(c.column("text"))
                size = pc.utf8_length(L.raw).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                offset = np.cumsum(size) - size
                offset -= offset[L.first[L.page]]
                at = np.flatnonzero(~L.blank)
                if not len(at):
                    continue
                parts = pc.split_pattern(pc.replace_substring_regex(L.raw.take(pa.array(at)), r"([.!?…][\"”»)]?\s+)", "\\1\x01"), "\x01")
                line, units = at[pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)], parts.flatten()
                length = pc.utf8_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
                begin = np.cumsum(length) - length
                head = np.concatenate([[True], line[1:] != line[:-1]])
                begin = begin - begin[np.flatnonzero(head)][np.cumsum(head) - 1] + offset[line]
                full = np.flatnonzero(length)  # a line's last sentence leaves an empty part behind it
                line, length, begin, units = line[full], length[full], begin[full], units.take(pa.array(full))
                page = L.page[line]
                scores = f.scores(units)
                lang = _smoothed(scores, page)
                new = np.ones(len(page), bool)
                new[1:] = (page[1:] != page[:-1]) | (lang[1:] != lang[:-1])
                first = np.flatnonzero(new)
                last = np.concatenate([first[1:], [len(page)]]) - 1
                sums = np.add.reduceat(scores, first, axis=0)
                own = np.where(lang[first] >= 0, sums[np.arange(len(first)), np.maximum(lang[first], 0)], 0)
                sums[np.arange(len(first)), np.maximum(lang[first], 0)] = 0
                sure = own / np.maximum(own + sums.max(1), 1e-9)
                opens = np.concatenate([[True], page[first][1:] != page[first][:-1]])
                number = np.arange(len(first)) - np.flatnonzero(opens)[np.cumsum(opens) - 1] + 1
                ids = c.column("page_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[page[first]]), pa.array(number, pa.int64()), pa.array(L.no[line[first]], pa.int64()), pa.array(L.no[line[last]], pa.int64()), pa.array(begin[first]), pa.array(begin[last] + length[last]),
                     pa.array(f.languages).take(pa.array(lang[first], pa.int64(), mask=lang[first] < 0)), pa.array(sure)],
                    names=["page_id", "segment", "first_line", "last_line", "begin_at", "end_at", "lang", "confidence"],
                )

    schema = "page_id long, segment long, first_line long, last_line long, begin_at long, end_at long, lang string, confidence double"
    return pages.filter(F.length(text) > 0).select("page_id", F.col(text).alias("text")).mapInArrow(run, schema)


def text_languages(parts: DataFrame) -> DataFrame:
    """``page_id, lang, share, confidence, languages``: for each text of ``segments`` the language of most of its characters, their share, the
    segments' mean confidence weighted by length, and the number of languages. Ties go to the first by name."""
    size = F.col("end_at") - F.col("begin_at")
    by = parts.groupBy("page_id", "lang").agg(F.sum(size).alias("size"), F.sum(size * F.col("confidence")).alias("sure"))
    best = F.max(F.struct(F.col("lang").isNotNull(), F.col("size"), -F.ascii("lang"), -F.ascii(F.substring("lang", 2, 1)), "lang", "sure")).alias("best")
    return by.groupBy("page_id").agg(best, F.sum("size").alias("whole"), F.count("lang").alias("languages")).select(
        "page_id", "best.lang", (F.col("best.size") / F.col("whole")).alias("share"), (F.col("best.sure") / F.col("best.size")).alias("confidence"), "languages"
    )
