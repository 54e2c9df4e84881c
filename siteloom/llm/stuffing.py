"""Keyword-stuffed and link-list pages: a hidden Markov model labels the lines of a page as prose, link list, tag list or
menu (and data list, which is content); pages whose non-prose words prevail are flagged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import FEATURES, classified
from .lines import Words, count
from .residue import PSEUDO
from .words import ALL

STATES = ("prose", "data", "link list", "tag list", "menu")
#: What is seen of a line; each state has a probability of each sign.
SIGNS = ("short entry", "sentence end", "few function words", "repeats its words", "many separators", "linked", "bullet", "figures", "question", "long and varied")
EMISSION = np.array(
    [
        # short, sentence, few fw, repeats, separ., linked, bullet, figures, question, long
        [0.15, 0.90, 0.10, 0.04, 0.03, 0.02, 0.08, 0.05, 0.08, 0.80],  # prose
        [0.30, 0.05, 0.90, 0.03, 0.10, 0.02, 0.15, 0.95, 0.01, 0.10],  # data
        [0.93, 0.02, 0.70, 0.03, 0.15, 0.40, 0.40, 0.02, 0.10, 0.02],  # link list
        [0.05, 0.35, 0.97, 0.93, 0.45, 0.05, 0.03, 0.01, 0.02, 0.04],  # tag list
        [0.90, 0.01, 0.85, 0.02, 0.40, 0.95, 0.01, 0.02, 0.01, 0.02],  # menu
    ]
)
START = np.array([0.45, 0.05, 0.1, 0.1, 0.3])
MOVE = np.array(
    [
        [0.82, 0.03, 0.04, 0.04, 0.07],
        [0.12, 0.80, 0.02, 0.02, 0.04],
        [0.08, 0.01, 0.83, 0.03, 0.05],
        [0.10, 0.01, 0.03, 0.80, 0.06],
        [0.25, 0.03, 0.10, 0.12, 0.50],
    ]
)
NON_PROSE = np.array([False, False, True, True, True])
FLAG_SHARE = 0.6
FLAG_WORDS = 25


def viterbi(signs: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Most likely states of many sequences at once; ``signs`` has them one after the other, ``count`` their lengths."""
    s = signs.astype(np.float64)
    emit = s @ np.log(EMISSION).T + (1 - s) @ np.log(1 - EMISSION).T
    out = np.zeros(len(signs), np.int8)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    if not len(order):
        return out
    first = np.concatenate([[0], np.cumsum(count)[:-1]])[order]
    length = count[order]
    move = np.log(MOVE)
    score = np.log(START) + emit[first]
    back = []
    for t in range(1, int(length.max())):
        live = int(np.searchsorted(-length, -t, side="left"))
        way = score[:live, :, None] + move[None]
        back.append(way.argmax(1).astype(np.int8))
        score[:live] = way.max(1) + emit[first[:live] + t]
    state = score.argmax(1)
    for t in range(int(length.max()) - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, side="left"))
        out[first[:live] + t] = state[:live]
        if t:
            state[:live] = back[t - 1][np.arange(live), state[:live]]
    return out


def signs_of(lines: pa.Array, words: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The signs of each line; ``x`` has the lines' block features."""
    f = {c: x[:, FEATURES.index(c)] for c in ("link_density", "bullet", "digits")}
    has = lambda pattern: pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    w = Words(lines)
    n = np.maximum(w.per, 1)
    separators = count(lines, r"[,;|#·•]") + count(lines, " - ")
    # fewer different words than a text of that length has
    repeats = (w.per >= 8) & (w.different() < 0.6 * n**0.9)
    return np.stack(
        [
            (words <= 7) & ~has(r"[.!…]$"),
            has(r"[.!?…][\"”»)]*$") & (words > 3),
            w.share_in(ALL) < 0.12,
            repeats,
            (separators >= 0.3 * n) & (separators >= 3),
            (f["link_density"] >= 0.6) | has(r"\(/|http"),
            f["bullet"] > 0,
            (f["digits"] >= 0.25) & (words >= 3),
            has(r"\?$") & (words > 2),
            (w.per >= 10) & ~repeats & (separators < 0.3 * n),
        ],
        1,
    )


def label_lines(pages: DataFrame, links: DataFrame, text: str = "body_sample") -> DataFrame:
    """``page_id, line_no, state``: the state of each non-blank line."""

    def emit(b, k, own, x, at):
        state, _ = _states(k, own, x, at)
        L = k.lines
        yield pa.RecordBatch.from_arrays(
            [pa.array(b.column("row_id").to_numpy(zero_copy_only=False)[L.page[at]]), pa.array(L.no[at], pa.int64()), pa.array(STATES).take(pa.array(state))], names=["page_id", "line_no", "state"]
        )

    return classified(pages, links, text, emit, "page_id long, line_no long, state string")


def _states(k, own, x, at):
    L = k.lines
    lines = L.flat.take(pa.array(at))
    signs = signs_of(lines, k.words[at], x)
    size = np.bincount(L.page[at], minlength=L.n_pages)
    # the template's lines: not own, and other pages of the site hold them too
    f = {c: x[:, i] for i, c in enumerate(FEATURES)}
    template = ~own[at] & ((f["site_pages"] >= 2) | (f["link_density"] >= 0.9) | (f["label_share"] > 0.01) | (f["title_link"] > 0))
    state = viterbi(signs, size)
    # pseudo-text repeats its few words, too, but it is no list
    for i in np.flatnonzero(pc.match_substring_regex(pc.utf8_lower(lines), r"lorem|ipsum|dolorem").to_numpy(zero_copy_only=False)):
        if PSEUDO.search(L.flat[int(at[i])].as_py()):
            state[i] = 0
    return state, template


def non_prose(k, own, x, at) -> tuple[np.ndarray, np.ndarray]:
    """For each page of a classified batch: the words of its own text, and the share of them in non-prose lines.
    ``at`` has the non-blank lines to look at (all, or those of each page's head)."""
    state, template = _states(k, own, x, at)
    page, w = k.lines.page[at], np.where(template, 0, k.words[at])
    total = np.bincount(page, weights=w, minlength=k.lines.n_pages)
    other = np.bincount(page, weights=w * NON_PROSE[state], minlength=k.lines.n_pages)
    return total, other / np.maximum(total, 1)


def stuffed_pages(pages: DataFrame, links: DataFrame, text: str = "body_sample", share: float = FLAG_SHARE, words: int = FLAG_WORDS) -> DataFrame:
    """``page_id, non_prose_share`` of the pages whose own text is mostly keyword, tag or link lines.

    Null and empty texts are not judged; nor are pages with fewer than ``words`` own words.
    """

    def emit(b, k, own, x, at):
        total, part = non_prose(k, own, x, at)
        hit = np.flatnonzero((total >= words) & (part > share))
        yield pa.RecordBatch.from_arrays([pa.array(b.column("row_id").to_numpy(zero_copy_only=False)[hit]), pa.array(part[hit])], names=["page_id", "non_prose_share"])

    return classified(pages, links, text, emit, "page_id long, non_prose_share double")
