"""Reading level by a familiar-word formula: the share of words outside high-frequency lists that come from the corpus'
document frequencies, and the average sentence length, weighted by a softmax regression on pages that readers graded.

A list holds the words of a language that stand in at least a given share of its pages; several shares give several
lists, from a few common words to all but rare ones. Sentence length is taken twice: between full stops, and between
any punctuation or "and", so that strung-together or chopped sentences do not decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import stored
from .blocks import classified
from .language import LanguageFilters, train_filters
from .lines import Words, count, squeezed, words_of
from .residue import excluded
from .words import LANGUAGES

LEVELS = ("easy", "standard", "demanding")
LISTS = (0.5, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02)
LEAST_SHARE = min(LISTS)
MIN_WORDS = 60
MAX_LABELS = 20_000
SENTENCE = r"[.!?…]+\s|\n"
CLAUSE = r"[.!?…;:,()\n]|(?:^|[^\pL])(?:and|i|und|et|y|en)(?:[^\pL]|$)"
COLUMNS = tuple(f"outside_{int(c * 100)}" for c in LISTS) + ("known_30", "known_20", "known_10", "sentence", "clause_weighted", "clause", "mean_log", "known_log") + tuple(f"is_{x}" for x in LANGUAGES)


def own_texts(pages: DataFrame, links: DataFrame, filters: LanguageFilters, text: str = "body_sample", min_words: int = MIN_WORDS) -> DataFrame:
    """``page_id, lang, text``: own content of the pages that can be graded: enough words, no residue, no keyword or link
    list, no list of measurements."""
    shared = pages.sparkSession.sparkContext.broadcast(filters)

    def emit(b, k, own, x, at):
        L = k.lines
        digits = count(L.flat, r"(?:^| )[^ ]*[0-9]") / np.maximum(k.words, 1)
        sheet = np.bincount(L.page, weights=own & (digits >= 0.25) & (k.words >= 3) & (k.words <= 12) & ~k.ends, minlength=L.n_pages)
        words = np.bincount(L.page, weights=np.where(own, k.words, 0), minlength=L.n_pages)
        good = ~excluded(b, k, own, x, at) & (sheet < 2) & (words >= min_words)
        keep = np.flatnonzero(own & good[L.page])
        size = np.bincount(L.page[keep], minlength=L.n_pages)[good]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), L.raw.take(pa.array(keep)).cast(pa.string()))
        texts = pc.binary_join(lists, "\n")
        best, _ = shared.value.decide(texts.cast(pa.large_string()))
        ids = b.column("row_id").filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([ids, pa.array(LANGUAGES).take(pa.array(best, pa.int64(), mask=best < 0)), texts], names=["page_id", "lang", "text"])

    return classified(pages, links, text, emit, "page_id long, lang string, text string")


def _document_words(frames):
    """Counts of (language, word) over documents, summed within a batch before they are shuffled; the word '' counts documents."""
    for b in frames:
        langs = b.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        w = Words(b.column("text").cast(pa.large_string()))
        doc, code = w.distinct()
        n = len(w.names) + 1
        key, docs = np.unique(np.concatenate([lang[doc] * n + code + 1, lang * n]), return_counts=True)
        names = pa.concat_arrays([pa.array([""], pa.large_string()), w.names.cast(pa.large_string())])
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(key // n)), names.take(pa.array(key % n)).cast(pa.string()), pa.array(docs, pa.int64())], names=["lang", "word", "docs"])


def document_frequencies(texts: DataFrame, least: float = LEAST_SHARE) -> dict[str, dict[str, float]]:
    """Share of a language's documents that hold each word, for words in at least ``least`` of them.

    Bounded whatever the corpus: documents of d different words on average leave at most d / least words a language.
    """
    table = stored(texts.select("lang", "text").mapInArrow(_document_words, "lang string, word string, docs long").groupBy("lang", "word").agg(F.sum("docs").alias("docs")), "word-docs")
    size = {r.lang: r.docs for r in table.filter("word = ''").collect()}
    if not size:
        return {}
    enough = F.create_map(*[F.lit(v) for lang, n in size.items() for v in (lang, float(n) * least)])
    out: dict[str, dict[str, float]] = {lang: {} for lang in size}
    for r in table.filter((F.col("word") != "") & (F.col("docs") >= enough[F.col("lang")])).collect():
        out[r.lang][r.word] = r.docs / size[r.lang]
    return out


def _mean_by(row: np.ndarray, values: np.ndarray, n: int, empty: float) -> np.ndarray:
    many = np.bincount(row, minlength=n)
    return np.where(many > 0, np.bincount(row, weights=values, minlength=n) / np.maximum(many, 1), empty)


def _stretches(texts: pa.Array, pattern: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the text and number of words of each stretch between matches of ``pattern``, from ``least`` words on."""
    parts = pc.split_pattern_regex(texts, pattern)
    size = words_of(squeezed(parts.flatten()))
    keep = size >= least
    return pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)[keep], size[keep].astype(np.float64)


def measures(texts: pa.Array, langs: list[str], df: dict[str, dict[str, float]]) -> np.ndarray:
    """``COLUMNS`` of each text. ``df``: for each language the share of documents that hold a word."""
    texts = texts.cast(pa.large_string())
    w, n = Words(texts), len(texts)
    code = np.array([LANGUAGES.index(x) for x in langs], np.int64)
    names = w.names.to_pylist()
    table = np.zeros((len(LANGUAGES), max(len(names), 1)))
    for i in set(code.tolist()):
        get = df.get(LANGUAGES[i], {}).get
        table[i, : len(names)] = [get(x, 0.0) for x in names]
    share = table[code[w.row], w.code]
    is_known = share >= LEAST_SHARE
    known_row, known = w.row[is_known], share[is_known]
    of_words = lambda values, empty: _mean_by(w.row, values, n, empty)
    of_known = lambda values, empty: _mean_by(known_row, values, n, empty)
    row, size = _stretches(texts, SENTENCE, 3)
    sentence = _mean_by(row, size, n, 0.0)
    row, size = _stretches(pc.utf8_lower(texts), CLAUSE, 1)
    clause = _mean_by(row, size, n, 1.0)
    weighted = np.bincount(row, weights=size**2, minlength=n) / np.maximum(np.bincount(row, weights=size, minlength=n), 1)
    return np.stack(
        [
            *[of_words(share < c, 1.0) for c in LISTS],
            *[of_known(known < c, 1.0) for c in (0.3, 0.2, 0.1)],
            np.minimum(sentence, 80), np.minimum(np.maximum(weighted, 1), 80), np.minimum(clause, 80),
            of_words(np.log(share + 0.001), np.log(0.001)), of_known(np.log(known), np.log(LEAST_SHARE)),
            *[(code == i).astype(float) for i in range(len(LANGUAGES))],
        ],
        1,
    )


class Grades:
    """Softmax regression on standardised measures."""

    def fit(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 800) -> "Grades":
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.weights, speed = np.zeros((z.shape[1], len(LEVELS))), 0.0
        hot = np.eye(len(LEVELS))[y]
        for _ in range(steps):
            p = self._soft(z)
            speed = 0.9 * speed - 0.3 * (z.T @ (p - hot) / len(y) + penalty * self.weights)
            self.weights = self.weights + speed
        return self

    def _soft(self, z: np.ndarray) -> np.ndarray:
        s = z @ self.weights
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def shares(self, x: np.ndarray) -> np.ndarray:
        return self._soft(np.c_[(np.clip((x - self.mean) / self.scale, -6, 6)), np.ones(len(x))])


def measured(texts: DataFrame, df: dict[str, dict[str, float]]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(df)

    def run(frames):
        for b in frames:
            m = measures(b.column("text"), b.column("lang").to_pylist(), shared.value)
            start = np.arange(len(m) + 1, dtype=np.int32) * len(COLUMNS)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.ListArray.from_arrays(pa.array(start), pa.array(m.ravel()))], names=["page_id", "measures"])

    return texts.mapInArrow(run, "page_id long, measures array<double>")


def reading_levels(pages: DataFrame, links: DataFrame, labels: DataFrame, text: str = "body_sample", max_labels: int = MAX_LABELS) -> DataFrame:
    """``page_id, reading_level, confidence`` of every page that can be graded and is not in ``labels``.

    At most ``max_labels`` graded pages are used for fitting (those with the smallest hashes); word lists come from all
    pages. Without usable labels there are no rows, nor without pages whose html_lang can teach the languages apart. Null texts, short texts and pages of other kinds give no rows.
    """
    spark = pages.sparkSession
    texts = stored(own_texts(pages, links, train_filters(pages, text), text).filter("lang is not null"), "own-texts")
    table = stored(measured(texts, document_frequencies(texts)), "measures")
    graded = labels.filter(F.col("reading_level").isin(*LEVELS)).groupBy("page_id").agg(F.min("reading_level").alias("reading_level"))
    sample = table.join(graded, "page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(max_labels).select("measures", "reading_level").collect()
    if not sample:
        return spark.createDataFrame([], "page_id long, reading_level string, confidence double")
    model = Grades().fit(np.array([r[0] for r in sample]), np.array([LEVELS.index(r[1]) for r in sample]))
    shared = spark.sparkContext.broadcast(model)

    def run(frames):
        for b in frames:
            if not b.num_rows:
                continue
            x = b.column("measures").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            p = shared.value.shares(x)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), pa.array(LEVELS).take(pa.array(p.argmax(1))), pa.array(p.max(1))], names=["page_id", "reading_level", "confidence"])

    return table.join(labels.select("page_id").distinct(), "page_id", "left_anti").select("page_id", "measures").mapInArrow(run, "page_id long, reading_level string, confidence double")
