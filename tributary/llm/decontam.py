r"""Benchmark decontamination by winnowing, native.

Texts are words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` with A-Z lower-cased. Of every 6 consecutive hashes of 5-word grams, the smallest is a
fingerprint, in documents as in benchmark items; so any 10 words that both share hold a common fingerprint. Places of documents whose fingerprint
the benchmark has are hits. Each is extended to the windows of 10 words around it, which are compared with those of the items word by word, so hash
collisions give no hit, and each shared window is found, as it holds a hit. Items of fewer than 10 words are one window and their own fingerprint; documents
are then also cut into grams of the lengths that such items have.

Places of a document never meet places of an item: a text of one word, repeated, costs as much as any other. Windows that many items share are one row.

All is column expressions. Fingerprints and windows of the benchmark are broadcast after they were counted, else both sides are shuffled. Documents' texts aren't shuffled unless
more than BROADCAST_ROWS documents have hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import ascii_lower, let
from .shared import column, saved, small_side

WINDOW = 10
GRAM = 5
#: Windows of items that are broadcast at most, at about 100 bytes each.
WINDOWS = 100_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased, for counting.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """array<string>; empty for null."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_total(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long")


def _upto(n: Column) -> Column:
    """0 .. n - 1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, size: int) -> Column:
    """Hashes of the grams of so many words."""
    return F.transform(_upto(F.size(hashes) - (size - 1)), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(size))))


def _least_of(grams: Column, width: int) -> Column:
    """Minimum of each `width` consecutive values."""
    return F.transform(_upto(F.size(grams) - (width - 1)), lambda i: F.least(*(F.get(grams, i + k) for k in range(width))))


def _picked(grams: Column, width: int) -> Column:
    """array<struct<fp, at>>: the grams that are the smallest of some window of `width` grams."""

    def chosen(least: Column) -> Column:
        at = F.filter(_upto(F.size(grams)), lambda i: _any([F.get(least, i - k) == F.get(grams, i) for k in range(width)]))
        return F.transform(at, lambda i: F.struct(F.get(grams, i).alias("fp"), i.alias("at")))

    return let(_least_of(grams, width), chosen)


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def fingerprints(words: Column, window: int = WINDOW, gram: int = GRAM, short: tuple[int, ...] = ()) -> Column:
    """array<struct<fp bigint, at int, n int>> of a word array: winnowed grams (n is the window), and all grams of the lengths n in `short`."""

    def all_of(hashes: Column, n: int) -> Column:
        every = let(_grams(hashes, n), lambda g: F.arrays_zip(g.alias("fp"), _upto(F.size(g)).alias("at")))
        return F.transform(every, lambda x: F.struct(x["fp"].alias("fp"), x["at"].alias("at"), F.lit(n).alias("n")))

    def of(hashes: Column) -> Column:
        picked = let(_grams(hashes, gram), lambda g: _picked(g, window - gram + 1))
        parts = [F.transform(picked, lambda x: F.struct(x["fp"].alias("fp"), x["at"].alias("at"), F.lit(window).alias("n")))]
        parts += [all_of(hashes, n) for n in short]
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _window(words: Column, start: Column, n: Column) -> Column:
    """The words of a window as one string; a word holds no blank."""
    return F.array_join(F.slice(words, start + 1, n), " ")


def _covered(windows: Column) -> Column:
    """Places inside any of array<struct<start, n>>, sorted by start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("places"))

    def step(acc: Column, w: Column) -> Column:
        end = F.greatest(acc["end"], w["start"] + w["n"])
        return F.struct(end.alias("end"), (acc["places"] + end - F.greatest(acc["end"], F.least(w["start"], end))).alias("places"))

    return F.aggregate(windows, zero, step)["places"]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of docs: id, text_key, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit if it stands inside an occurrence of a window of an item: `window` consecutive words, or all words of a
    shorter item. Items without words occur nowhere. Items that repeat an id count once; a null id is named "". Null texts have no words.
    Repeated rows get equal results; rows that share id but not text are kept apart by the text's hash. Empty tables give no rows, or no
    hits. Only the named columns are read.
    """
    items = benchmark.select(F.coalesce(column(item_col).cast("string"), F.lit("")).alias("item"), words_of(column(item_text_col)).alias("iw")).filter(F.size("iw") > 0).distinct()
    items = saved(items.withColumn("n", F.least(F.size("iw"), F.lit(window))), "items")
    short = tuple(sorted(r[0] for r in items.filter(F.col("n") < window).select("n").distinct().collect()))
    # a short item's own length is the only one that it needs
    prints = items.select("n", F.inline(fingerprints(F.col("iw"), window, GRAM, short)).alias("fp", "at", "of")).filter("of = n").select("fp", "n").distinct()
    prints = saved(prints, "prints")
    starts = F.transform(_upto(F.size("iw") - F.col("n") + 1), lambda i: _window(F.col("iw"), i, F.col("n")))
    windows = saved(items.select("item", "n", F.explode(starts).alias("win")).groupBy("n", "win").agg(F.array_sort(F.collect_set("item")).alias("found")), "windows")

    keyed = docs.select(column(id_col).alias("_id"), F.xxhash64(column(text_col)).alias("_text_key"), column(text_col).alias("_text"))
    cut = keyed.select("_id", "_text_key", F.inline(fingerprints(words_of(F.col("_text")), window, GRAM, short)))
    hits = cut.join(small_side(prints, prints.count()), ["fp", "n"], "left_semi")
    where = saved(hits.groupBy("_id", "_text_key").agg(F.collect_set(F.struct("at", "n")).alias("places")), "hits")
    w = small_side(where, where.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]).withColumnsRenamed({"_id": "_wid", "_text_key": "_wkey"})
    met = keyed.join(w, F.col("_id").eqNullSafe(F.col("_wid")) & (F.col("_text_key") == F.col("_wkey"))).select("_id", "_text_key", words_of(F.col("_text")).alias("dw"), "places")
    # the windows that hold a hit: a winnowed gram has room for several, a short item's gram is its window
    around = F.flatten(F.transform("places", lambda p: F.transform(F.sequence(p["at"] - F.when(p["n"] == window, window - GRAM).otherwise(0), p["at"]), lambda i: F.struct(i.alias("start"), p["n"].alias("n")))))
    fits = F.filter(F.array_distinct(around), lambda x: (x["start"] >= 0) & (x["start"] + x["n"] <= F.size("dw")))
    near = met.select("_id", "_text_key", F.inline(let(F.col("dw"), lambda dw: F.transform(fits, lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), _window(dw, x["start"], x["n"]).alias("win"))))))
    same = near.join(small_side(windows, windows.count(), WINDOWS), ["n", "win"])
    shared = same.groupBy("_id", "_text_key").agg(F.collect_set(F.struct("start", "n")).alias("windows"), F.collect_set("found").alias("found"))
    found = F.array_sort(F.array_distinct(F.flatten("found")))
    shared = saved(shared.select(F.col("_id").alias("_sid"), F.col("_text_key").alias("_skey"), _covered(F.array_sort("windows")).alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.array_join(found, ",").alias("items")), "shared")
    out = keyed.select("_id", "_text_key", word_total(F.col("_text")).alias("n_words"))
    out = out.join(small_side(shared, shared.count()), F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_text_key") == F.col("_skey")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("_id").alias(id_col), F.col("_text_key").alias("text_key"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without any shared window, with the columns that docs has, whatever their names.

    Repeated rows stay or go together. An empty benchmark keeps all rows, empty docs give none; null and empty texts stay.
    """
    bad = saved(contamination(docs, benchmark, id_col, text_col).filter("contaminated").select(column(id_col).alias("id"), "text_key").distinct(), "bad")
    # the columns of docs travel in one struct, so that no name of theirs can clash
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("row"), column(id_col).alias("_id"), F.xxhash64(column(text_col)).alias("_key"))
    b = small_side(bad, bad.count())
    return rows.join(b, rows["_id"].eqNullSafe(b["id"]) & (rows["_key"] == b["text_key"]), "left_anti").select("row.*")
