"""Spelling variants: words one edit apart, found by forward and backward minimal acyclic automata.

If two words differ by one inserted, deleted or replaced letter, then either the first half of the one opens the other one as it stands, and the
error is behind it, or the second half closes it, and the error is before it. So each word is looked up twice: in an automaton of the words, by its
first half exactly and from there with one error, and in an automaton of the reversed words, by its reversed second half exactly and from there with
one error. The automata number their words (the number of a word is how many words come before it), so a match is a number that leads to
the word and its count. What both directions find is taken once.

Words meet by their halves: a word goes to the halves that a word of its length, one letter less or one more asks for, which are two in each direction. A
task reads them sorted by half and builds its automata for one block of whole halves after the other; a half is shared by words of
three lengths only.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, dropped, saved, small_side

LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A word is a variant of a near word that occurs so many times as often.
RATIO = 5
#: Words that one automaton holds, about; and different words that a task counts before it hands them on.
BLOCK_WORDS = 100_000
COUNTED = 300_000

#: Latin-1 bytes of words, A-Z in lower case; all else is blank.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


class Automaton:
    """The minimal acyclic automaton of distinct words in order, none of them empty, built word by word; each word has its place in that order as its number."""

    def __init__(self, words: list[str]) -> None:
        self._edges: list[dict[str, tuple[int, int]]] = []
        self._final: list[bool] = []
        counts: list[int] = []
        register: dict[tuple, int] = {}
        # the states of the last word that may still get edges, from the root
        path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
        last = ""

        def state_of(final: bool, edges: list[tuple[str, int]]) -> int:
            key = (final, *edges)
            if (state := register.get(key)) is None:
                state = register[key] = len(self._edges)
                total, numbered = int(final), {}
                for letter, child in edges:
                    numbered[letter] = (child, total)
                    total += counts[child]
                self._edges.append(numbered)
                self._final.append(final)
                counts.append(total)
            return state

        for word in [*words, ""]:
            shared = next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
            while len(path) > shared + 1:
                state = state_of(*path.pop())
                path[-1][1].append((last[len(path) - 1], state))
            path += [(k == len(word), []) for k in range(shared + 1, len(word) + 1)]
            last = word
        self._root = state_of(*path.pop())

    def __len__(self) -> int:
        """Number of states."""
        return len(self._edges)

    def _rest(self, state: int, number: int, word: str, at: int) -> int:
        """The number of the word that word[at:] completes from a state, or -1."""
        edges = self._edges
        for letter in word[at:]:
            step = edges[state].get(letter)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self._final[state] else -1

    def number(self, word: str) -> int:
        return self._rest(self._root, 0, word, 0)

    def one_error(self, word: str, exact: int) -> set[int]:
        """The numbers of the words that begin like word's first `exact` letters, with one inserted, deleted or replaced letter behind them."""
        edges, state, number, found = self._edges, self._root, 0, set()
        for k, letter in enumerate(word):
            here = edges[state]
            if k >= exact:
                found.add(self._rest(state, number, word, k + 1))
                for other, (child, before) in here.items():
                    found.add(self._rest(child, number + before, word, k))
                    if other != letter:
                        found.add(self._rest(child, number + before, word, k + 1))
            step = here.get(letter)
            if step is None:
                found.discard(-1)
                return found
            state, number = step[0], number + step[1]
        found.update(number + before for child, before in edges[state].values() if self._final[child])
        found.discard(-1)
        return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 1, slip_every: int = 0) -> DataFrame:
    r"""(word, n): the runs `[A-Za-zÀ-ÿ]+` of all texts with A-Z in lower case, of least_letters code points or more, and how often each occurs.

    With slip_every, a run of which the crc32 of `<id>:<word>` is a multiple of it loses its code point at crc32 % length (none where the id is null).
    Null texts have no words. Tasks add up their words before the shuffle, so a common word is a row of each task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        handed = lambda: pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": np.fromiter(total.values(), np.int64, len(total))})
        for b in batches:
            for i, text in zip(b["_id"], b["_text"], strict=True):
                own = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split()) if text else {}
                start = zlib.crc32(f"{i}:".encode()) if slip_every and i is not None else None
                for w, n in own.items():
                    if start is not None:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % slip_every == 0:
                            w = w[: h % len(w)] + w[h % len(w) + 1 :]
                    if len(w) >= least_letters:
                        total[w] += n
                if len(total) >= COUNTED:
                    yield handed()
                    total.clear()
        if total:
            yield handed()

    rows = docs.select(column(id_col).cast("string").alias("_id"), column(text_col).alias("_text"))
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each ordered pair of words one edit apart, once, from rows (word, n) of distinct words of two letters or more."""
    length = F.length("word")
    each = F.explode(
        F.array(
            *(
                F.struct(F.lit(way).alias("way"), half.cast("int").alias("half"), (half == asked).alias("asks"))
                for way, asked, halves in (
                    ("forward", F.floor(length / 2), (F.floor(length / 2), F.floor((length - 1) / 2) + F.when(length % 2 == 0, 0).otherwise(1))),
                    ("backward", F.floor((length + 1) / 2), (F.floor((length + 1) / 2), F.floor(length / 2) + F.when(length % 2 == 0, 1).otherwise(0))),
                )
                for half in halves
            )
        )
    )
    rows = words.select("word", "n", each.alias("to")).select(F.when(F.col("to.way") == "forward", F.col("word")).otherwise(F.reverse("word")).alias("text"), "n", "to.*")
    rows = rows.withColumn("key", F.substring("text", F.lit(1), F.col("half")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(held) >= BLOCK_WORDS:
                # the last half may go on in the next batch
                last = (held["way"] == held["way"].iat[-1]) & (held["half"] == held["half"].iat[-1]) & (held["key"] == held["key"].iat[-1])
                yield from found(held[~last])
                held = held[last]
        if held is not None:
            yield from found(held)

    def found(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for way, block in b.groupby("way"):
            counts = dict(zip(block["text"], block["n"], strict=True))
            texts = sorted(counts)
            automaton, n = Automaton(texts), np.array([counts[t] for t in texts], np.int64)
            asking = block[block["asks"]]
            at = [(text, k) for text, half in zip(asking["text"], asking["half"], strict=True) for k in automaton.one_error(text, half)]
            if at:
                turned = (lambda t: t) if way == "forward" else (lambda t: t[::-1])
                yield pd.DataFrame({"word": [turned(t) for t, _ in at], "near": [turned(texts[k]) for _, k in at], "near_n": n[[k for _, k in at]]})

    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartition(parts, "way", "half", "key").sortWithinPartitions("way", "half", "key", "text")
    return dealt.select("way", "half", "key", "text", "n", "asks").mapInPandas(run, "word string, near string, near_n long").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of rows (word, form) lead in the end. Each round doubles the steps; a form is more common than its word, so there is no circle."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        if not now.join(ahead, "root", "left_semi").head(1):
            return now
        new = saved(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "roots")
        dropped(now)
        now = new


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per row of words (word, n; words distinct, of two letters or more): word, n, n_near, form, form_n, root.

    n_near counts the words one edit apart. form is the most frequent of them (ties: the smallest by code points), if it occurs ratio times as often as
    the word or more; form_n is its count. root is where forms lead from the word in the end: the word itself if it has no form. An empty table gives an empty one.
    """
    words = saved(words.select("word", "n"), "words")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = words.join(near, "word", "left")
    known = -F.col("best.less") >= ratio * F.col("n")
    out = saved(best.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(known, F.col("best.near")).alias("form"), F.when(known, -F.col("best.less")).alias("form_n")), "variants")
    roots = last_forms(out.filter("form is not null"))
    return out.join(small_side(roots, roots.count()), "word", "left").withColumn("root", F.coalesce("root", "word"))
