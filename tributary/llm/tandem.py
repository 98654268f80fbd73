"""Periodic runs of words, by the suffix tree of each document (Stoye and Gusfield).

A run is a maximal stretch of words with a smallest period q. The tandem repeat of its last 2q words is branching: the word behind
it breaks the period, so its halves are two leaves i and i + q of the tree's node of depth q, in different children. The tree is
held as intervals of the suffix array, for many documents at a time: words have ids that no two documents share, so no node holds
suffixes of two documents. At each node the leaves of all children but the largest one are listed (a leaf is listed at most
log2(n) times), and for each leaf i both i + depth and i - depth are looked up. A branching repeat is then rotated to the left as long as the
words stay the same, by the ranks that the suffix sorting left for each power of two; repeats that rotate over one stretch merge into one run, under its smallest period.

Documents are independent, so there is no shuffle; a task holds the words of one block of documents at a time, and at least of one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .native import let
from .shared import column

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
#: Words of a block, unless one document alone has more.
BLOCK_WORDS = 250_000

SPACES = r"[\x20\x09-\x0D]+"
RUN = "array<struct<start:long,length:long,period:long>>"


def word_ids(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, each document's followed by an id of its own, and where each document starts; no two documents share an id."""
    ids, starts, base = [], [0], 0
    for words in texts:
        seen = dict(zip(words, range(len(words)), strict=True))
        own = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        ids += [own + base, np.array([base + len(words)])]
        base += len(words) + 1
        starts.append(starts[-1] + len(words) + 1)
    return np.concatenate(ids) if ids else np.empty(0, np.int64), np.array(starts)


def sorted_suffixes(s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks): ranks[k][i] == ranks[k][j] just where the 2 ** k symbols from i and from j are the same.

    Prefix doubling; only suffixes that still share a rank are sorted again. The last symbol must occur once.
    """
    n, width = len(s), 1
    order = np.argsort(s, kind="stable")
    new = np.concatenate([[True], s[order][1:] != s[order][:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    ranks = [rank]
    size = np.diff(np.append(np.flatnonzero(new), n))
    shared = order[np.repeat(size > 1, size)]
    while len(shared):
        # shared suffixes don't reach the last symbol, so there is a rank `width` places on
        key = rank[shared] * n + rank[shared + width]
        by = np.argsort(key, kind="stable")
        shared, key = shared[by], key[by]
        group = rank[shared]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(shared))
        group_at = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), at, 0))
        own_at = np.maximum.accumulate(np.where(first, at, 0))
        rank = rank.copy()
        rank[shared] = group + own_at - group_at
        ranks.append(rank)
        width *= 2
        size = np.diff(np.append(np.flatnonzero(first), len(shared)))
        shared = shared[np.repeat(size > 1, size)]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, ranks


def common_prefixes(suffixes: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Symbols that each suffix shares with the one before it in order; -1 for the first."""
    n = len(suffixes)
    common = np.zeros(n, np.int64)
    common[0] = -1
    # the pairs that agree on 2 ** k symbols, ever fewer
    agreeing, at = [], np.arange(1, n)
    for r in ranks:
        at = at[r[suffixes[at - 1]] == r[suffixes[at]]]
        agreeing.append(at)
    for k in range(len(ranks) - 1, -1, -1):
        at = agreeing[k]
        same = ranks[k][suffixes[at - 1] + common[at]] == ranks[k][suffixes[at] + common[at]]
        common[at[same]] += 1 << k
    return common


def _nearest(values: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the places, which are those of values above 0, the nearest one to the left with a smaller value, and with a smaller or equal one; values[0] is -1."""

    def walked(step: np.ndarray | None) -> np.ndarray:
        near = np.arange(len(values)) - 1
        todo = places
        while len(todo):
            todo = todo[values[near[todo]] >= values[todo]] if step is None else todo[values[near[todo]] > values[todo]]
            # all between a candidate and its own nearest smaller one is no smaller than the candidate
            near[todo] = (near if step is None else step)[near[todo]]
        return near

    smaller = walked(None)
    return smaller, walked(smaller)


def branching_repeats(suffixes: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, q) of the branching tandem repeats of 2q symbols."""
    n = len(common)
    # bounds[k] parts the suffixes k - 1 and k; a node's bounds are those of its depth between two of smaller depth
    bounds = np.append(common, -1)
    k = np.flatnonzero(bounds > 0)
    if not len(k):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, left_child = _nearest(bounds, k)
    right, right_child = (n - near[::-1] for near in _nearest(bounds[::-1], (n - k)[::-1]))
    # a child ends at each bound of its node, and one more starts at the node's last bound
    last = bounds[right_child[k]] != bounds[k]
    node = np.concatenate([left[k], left[k[last]]])
    end = np.concatenate([right[k], right[k[last]]])
    low, high = np.concatenate([left_child[k], k[last]]), np.concatenate([k, right_child[k[last]]])
    depth = np.concatenate([bounds[k], bounds[k[last]]])
    # all children but one of the largest
    by = np.lexsort((high - low, depth, node))
    node, end, low, high, depth = (x[by] for x in (node, end, low, high, depth))
    largest = np.append((node[1:] != node[:-1]) | (depth[1:] != depth[:-1]), True)
    node, end, low, high, depth = (x[~largest] for x in (node, end, low, high, depth))
    size = high - low
    child = np.repeat(np.arange(len(size)), size)
    leaf = suffixes[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[child]]
    node, end, low, high, depth = (x[child] for x in (node, end, low, high, depth))

    def in_another_child(place: np.ndarray) -> np.ndarray:
        inside = (place >= 0) & (place < n)
        r = rank[np.where(inside, place, 0)]
        return inside & (r >= node) & (r < end) & ~((r >= low) & (r < high))

    ahead, behind = in_another_child(leaf + depth), in_another_child(leaf - depth)
    return np.concatenate([leaf[ahead], leaf[behind] - depth[behind]]), np.concatenate([depth[ahead], depth[behind]])


def maximal_runs(s: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) by start, then period, of the runs of s; the last symbol must occur once."""
    suffixes, ranks = sorted_suffixes(s)
    start, q = branching_repeats(suffixes, common_prefixes(suffixes, ranks), ranks[-1])
    end = start + 2 * q
    for k in range(len(ranks) - 1, -1, -1):
        before = start - (1 << k)
        same = (before >= 0) & (ranks[k][np.maximum(before, 0)] == ranks[k][np.maximum(before + q, 0)])
        start = np.where(same, before, start)
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    # of the periods of one stretch the smallest
    keep = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])]) if len(start) else np.empty(0, bool)
    keep &= end - start >= np.maximum(least_length, least_exponent * q)
    start, end, q = start[keep], end[keep], q[keep]
    by = np.lexsort((q, start))
    return start[by], (end - start)[by], q[by]


def _of_block(ids: list, texts: list[list[bytes]], least_length: int, least_exponent: int) -> pd.DataFrame:
    s, starts = word_ids(texts)
    start, length, period = maximal_runs(s, least_length, least_exponent) if len(s) else (np.empty(0, np.int64),) * 3
    cut = np.searchsorted(start, starts)
    rows = []
    for d, words in enumerate(texts):
        own = slice(cut[d], cut[d + 1])
        runs = [(int(a - starts[d]), int(n), int(q)) for a, n, q in zip(start[own], length[own], period[own], strict=True)]
        if runs:
            covered = np.zeros(len(words) + 1, np.int64)
            for a, n, q in runs:
                covered[a + q] += 1
                covered[a + n] -= 1
            kept = b" ".join([w for w, c in zip(words, np.cumsum(covered[:-1]).tolist(), strict=True) if not c])
        else:
            kept = b" ".join(words)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        rows.append((ids[d], len(words), [{"start": a, "length": n, "period": q} for a, n, q in runs], *best, kept.decode("utf-8", "replace")))
    out = pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "start", "length", "period", "collapsed"])
    return out.astype({"doc_id": object} | dict.fromkeys(("start", "length", "period"), "Int64"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """Per row of docs: doc_id, n_words, runs (start, length and period of each, by start, then period), the run of greatest length / period
    (start, length, period; ties: smallest start, then period; nulls without a run) and collapsed: the words that no run repeats, joined by a space.

    Runs have a length of least_length words and least_exponent (2 or more) periods at least. Null and empty texts have no words. Repeated rows give
    repeated results, ids may be null or shared, an empty table gives an empty one; only id and text are read, so other columns may have any name. The
    longest text bounds a task's memory, at about 300 bytes a word.
    """
    rows = docs.select(column(id_col).alias("_id"), column(text_col).cast("binary").alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, texts, n = [], [], 0
            for i, text in zip(b["_id"].astype(object).where(b["_id"].notna(), None), b["_text"], strict=True):
                # bytes.split knows just the white space of SPACES
                words = text.split() if text is not None else []
                if ids and n + len(words) > BLOCK_WORDS:
                    yield _of_block(ids, texts, least_length, least_exponent)
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(words)
                n += len(words) + 1
            if ids:
                yield _of_block(ids, texts, least_length, least_exponent)

    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_words long, runs {RUN}, start long, length long, period long, collapsed string")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text; where crc32 of the decimal id ends in 0, the words from a on repeat with period p.

    With g the crc32 without its last digit and n words, a is g % n and p is 1 + floor((n - a) / (3 + g % 8)). Rows without id or words stay as they are.
    """
    h = F.crc32(column(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def planted(words):
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return let(F.struct(words.alias("w"), a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.get(x["w"], F.when(i < x["a"], i.cast("long")).otherwise(x["a"] + (i - x["a"]) % x["p"]).cast("int"))), " "))

    words = F.filter(F.split(column(text_col), SPACES), lambda w: w != "")
    text = F.when(h % 10 == 0, let(words, lambda w: F.when(F.size(w) > 0, planted(w)).otherwise(F.lit("")))).otherwise(column(text_col))
    return docs.select(column(id_col).alias("doc_id"), text.alias("text"))
