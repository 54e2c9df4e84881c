"""Lines of page texts as Arrow arrays: splitting, comparing keys, hashes and shape counts, all on whole columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the tables mean it, no-break spaces included (RE2 class).
WHITE = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


#: White space other than single spaces inside a text (RE2).
UNEVEN = r"  |^ | $|" + WHITE.replace(r"\s", r"\t\n\v\f\r").removesuffix("+")


def squeezed(texts: pa.Array) -> pa.Array:
    """Runs of white space as one space, none at the ends. Most texts are so already and are left alone."""
    uneven = pc.fill_null(pc.match_substring_regex(texts, UNEVEN), False)
    some = texts.filter(uneven)
    if not len(some):
        return texts
    return pc.replace_with_mask(texts, uneven, pc.utf8_trim(pc.replace_substring_regex(some, WHITE, " "), " "))


def line_key_text(squeezed_lines: pa.Array) -> pa.Array:
    """What two lines have in common when case, white space and the values of digit runs are ignored."""
    folded = pc.replace_substring(pc.utf8_lower(squeezed_lines), "ß", "ss")
    return pc.replace_substring_regex(folded, "[0-9]+", "0")


def hash64(texts: pa.Array) -> np.ndarray:
    """Stable 64-bit hashes of strings, as signed integers."""
    if len(texts) == 0:
        return np.zeros(0, np.int64)
    return pd.util.hash_array(np.asarray(texts.to_numpy(zero_copy_only=False), dtype=object), categorize=False).view(np.int64)


class Lines:
    """All lines of a column of texts, flattened. ``page``: row of the text; ``no``: line number from 1, blank lines counted."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        self.n_pages = len(texts)
        parts = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        self.raw = parts.flatten()
        self.page = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        counts = np.bincount(self.page, minlength=self.n_pages) if self.n_pages else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if self.n_pages else np.zeros(0, np.int64)
        self.no = np.arange(len(self.raw)) - self.first[self.page] + 1
        self.count = counts
        self.flat = squeezed(self.raw)
        self.blank = pc.equal(self.flat, "").to_numpy(zero_copy_only=False)

    def keys(self) -> np.ndarray:
        self.key_text = line_key_text(self.flat)
        return hash64(self.key_text)


def numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(np.float32)


def count(texts: pa.Array, pattern: str) -> np.ndarray:
    return numbers(pc.count_substring_regex(texts, pattern))


def words_of(squeezed_lines: pa.Array) -> np.ndarray:
    spaces = numbers(pc.count_substring(squeezed_lines, " "))
    return np.where(numbers(pc.binary_length(squeezed_lines)) > 0, spaces + 1, 0).astype(np.float32)


class Words:
    """The words (runs of letters, in lower case) of a column of texts, flattened. ``row``: the text of each word;
    ``code``: its index among ``names``, the column's different words; ``per``: words of each text."""

    def __init__(self, texts: pa.Array):
        clean = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "), " ")
        parts = pc.split_pattern(clean, " ")
        row, flat = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64), parts.flatten()
        some = pc.not_equal(flat, "")
        coded = flat.filter(some).dictionary_encode()
        self.n = len(texts)
        self.row = row[some.to_numpy(zero_copy_only=False)]
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = coded.dictionary
        self.per = np.bincount(self.row, minlength=self.n)

    def share_in(self, words: frozenset[str]) -> np.ndarray:
        """The share of each text's words that are in a set; 0 for a text without words."""
        member = pc.is_in(self.names, value_set=pa.array(sorted(words), self.names.type)).to_numpy(zero_copy_only=False)
        hits = np.bincount(self.row, weights=member[self.code], minlength=self.n) if len(self.code) else np.zeros(self.n)
        return hits / np.maximum(self.per, 1)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, code) of each text's different words."""
        pairs = np.sort(self.row * max(len(self.names), 1) + self.code)
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        return pairs // max(len(self.names), 1), pairs % max(len(self.names), 1)

    def different(self) -> np.ndarray:
        """Number of different words of each text."""
        return np.bincount(self.distinct()[0], minlength=self.n)
