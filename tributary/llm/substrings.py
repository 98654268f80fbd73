"""Removal of byte strings that occurred before: column-wise construction of the sorted order of many texts.

Two equal strings of `length` bytes hold the same anchor at the same place: the smallest hash of their grams of GRAM bytes (the leftmost of equal ones; grams
that are common in a sample of the texts come last, so that a string has a common anchor only if all its grams are common). So the strings that start in a text
are cut into pieces, the maximal stretches of starts with one anchor, and only pieces with one anchor need to be compared. An anchor that occurs once in all
texts is dropped; the others' pieces meet by anchor.

The pieces of a block are a collection whose symbols are inserted column by column from the right, one of each piece in a round (columns are places relative to the
anchor). A round reads the collection in the order of the suffixes behind the column, whose symbols in that order are the part of the collection's
Burrows-Wheeler transform that the round adds; stable sorting by them gives the order of the suffixes one symbol longer, and the common prefix of two that
come to stand side by side is one more than the least common prefix between their former places, or 0 if the symbols differ. Suffixes of different columns are never equal over
`length` bytes, as their anchors aren't, so the parts of different rounds needn't be merged. Where common prefixes reach `length`, strings are equal;
all but the first one in the order of documents and places are removed. What a round updates (an order and the common prefixes) is read and written in sequence, and only
the former and the new state of one block exist. Blocks are read one after the other from the sorted shuffle files, so memory is bounded by a block, which is at least one anchor's pieces.

Texts are written once, to a table bucketed by chunk (of about CHUNK_BYTES), and meet what is found about them by chunk, so no later step shuffles texts. An anchor is at most once in a chunk's
list, and of equal pieces in a chunk only the first one travels: common lines and copies cost a row for each chunk, not for each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, mixed, shared_dir

LENGTH = 100
GRAM = 32
CHUNK_BYTES = 8 << 20
#: Pieces of a block, about.
BLOCK_PIECES = 32_768
#: Grams that stand in COMMON of SAMPLE texts (those with the smallest hashes, of LONGEST bytes at most) are common. This changes the cost alone.
SAMPLE, COMMON, LONGEST = 2_000, 4, 1 << 16
TABLE_BITS = 22
#: Starts whose anchors are found at a time.
PART_BITS = 16
#: Stands where a piece has no symbol; no byte of UTF-8.
_NONE = 0xFF

_STEPS = mixed(np.arange(71, 71 + 64, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the grams of GRAM bytes (a multiple of 8) at each place of a text that has one."""
    n = len(text) - GRAM + 1
    words = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    with np.errstate(over="ignore"):
        total = words[:n] * _STEPS[0]
        for k in range(8, GRAM, 8):
            total += words[k : k + n] * _STEPS[k // 8]
        return mixed(total)


def pieces_of(text: bytes, common: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor's hash, its place, first start, last start) of the pieces of all strings of `length` bytes, in order."""
    width, found = length - GRAM + 1, []
    mask = np.uint64((2 << PART_BITS) - 1)
    for at in range(0, len(text) - length + 1, 1 << PART_BITS):
        part = text[at : at + (1 << PART_BITS) + length - 1]
        h = gram_hashes(part)
        # by commonness, hash and place
        least = (h >> np.uint64(1)) | (common[(h >> np.uint64(64 - TABLE_BITS)).view(np.int64)].astype(np.uint64) << np.uint64(63))
        least = (least & ~mask) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        starts = len(h) - width + 1
        place = (np.minimum(least[:starts], least[width - step : width - step + starts]) & mask).view(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        place = place[first]
        found.append((h[place].view(np.int64), place + at, first + at, np.append(first[1:], starts) - 1 + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4


def _common_grams(texts: DataFrame) -> np.ndarray:
    """A table by the first TABLE_BITS of a gram's hash: whether a gram with such bits is common in the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [np.unique(gram_hashes(t) >> np.uint64(64 - TABLE_BITS)) for b in batches for t in b["_text"] if len(t) >= GRAM]
        seen = np.bincount(np.concatenate(own).view(np.int64), minlength=1 << TABLE_BITS) if own else np.zeros(1 << TABLE_BITS, np.int64)
        yield pd.DataFrame({"table": [np.packbits(seen >= COMMON).tobytes()]})

    some = texts.filter(F.octet_length("_text") <= LONGEST).orderBy("_key", "_id").limit(SAMPLE).select("_text")
    return np.unpackbits(np.frombuffer(some.coalesce(1).mapInPandas(run, "table binary").first()[0], np.uint8)).view(bool)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers the chunks of a task's rows; what a task wrote stays as it is, so the numbers need not repeat."""
    chunk, held = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        size = b["_text"].map(len).to_numpy()
        total = held + np.cumsum(size)
        yield b.assign(chunk=chunk + total // CHUNK_BYTES)
        chunk, held = chunk + int(total[-1]) // CHUNK_BYTES if len(b) else chunk, int(total[-1]) % CHUNK_BYTES if len(b) else held


def _written(rows: DataFrame) -> DataFrame:
    """rows as a table of the shared folder, bucketed by chunk; the files go when the driver's JVM ends."""
    spark = rows.sparkSession
    path, name = f"{shared_dir(spark)}/tributary/chunks-{uuid.uuid4().hex}", f"tributary_chunks_{uuid.uuid4().hex}"
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), 100_000)
    rows.write.format("parquet").bucketBy(parts, "chunk").sortBy("chunk").option("path", path).saveAsTable(name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.table(name)


def _prints(common: np.ndarray, length: int):
    """The anchors of each chunk, once for each batch; many: it has more than one place there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for chunk, texts in b.groupby("chunk")["_text"]:
                each = [h for h in (pieces_of(t, common.value, length)[0] for t in texts) if len(h)]
                if each:
                    h, n = np.unique(np.concatenate(each), return_counts=True)
                    yield pd.DataFrame({"hash": h, "chunk": chunk, "many": n > 1})

    return run


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in the order of hash those whose hash has another row, or many places."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        h = b["hash"].to_numpy()
        as_next = np.append(h[1:] == h[:-1], False)
        again = b["many"].to_numpy() | as_next | np.concatenate([[False], as_next[:-1]])
        # the last row may be the next batch's first one's like; the one before tells of it
        yield b.loc[again[:-1].nonzero()[0], ["chunk", "hash"]]
        held = b.iloc[-1:].assign(many=again[-1:])
    if held is not None:
        yield held.loc[held["many"], ["chunk", "hash"]]


_PIECES = "hash long, chunk long, _none boolean, _id long, _key long, first long, lead int, piece binary"
_STARTS = "chunk long, _none boolean, _id long, _key long, first long, last long"


def _pieces(common: np.ndarray, length: int):
    """The pieces of a chunk's texts whose anchors are repeated; of equal ones the first, and of the others the starts (no piece; lead: one less than their number)."""

    def run(found: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        wanted, seen, rows = np.unique(found["hash"].to_numpy(np.int64)), {}, []
        if len(wanted):
            docs = docs.sort_values(["_none", "_id", "_key"])
            for none, i, key, text in zip(docs["_none"].tolist(), docs["_id"].tolist(), docs["_key"].tolist(), docs["_text"], strict=True):
                h, place, first, last = pieces_of(text, common.value, length)
                if not len(h):
                    continue
                some = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
                stretch = None
                for hash_, p, a, z in zip(h[some].tolist(), place[some].tolist(), first[some].tolist(), last[some].tolist(), strict=True):
                    piece = text[a : z + length]
                    where = (none, i, key, a)
                    if seen.setdefault((piece, p - a), where) < where:
                        if stretch and stretch[1] == a - 1:
                            stretch[1] = z
                        else:
                            if stretch:
                                rows.append((key, 0, none, i, key, stretch[0], stretch[1] - stretch[0], None))
                            stretch = [a, z]
                    else:
                        rows.append((hash_, 0, none, i, key, a, p - a, piece))
                if stretch:
                    rows.append((key, 0, none, i, key, stretch[0], stretch[1] - stretch[0], None))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _PIECES.split(", ")])
        if rows:
            out["chunk"] = docs["chunk"].iat[0]
        return out

    return run


def later_strings(pieces: list[bytes], group: np.ndarray, lead: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """By piece and start, relative to the anchor: whether an equal string of the group comes earlier. group: sorted; order: of the pieces, equal ones at one place."""
    width, rows = length - GRAM + 1, len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, rows)
    columns = np.full((width - 1 + length, rows), _NONE, np.uint8)
    row = np.repeat(np.arange(rows), sizes)
    columns[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - (width - 1 - lead), sizes), row] = np.frombuffer(b"".join(pieces), np.uint8)
    group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    # a place keeps its group for good
    small = group.astype(np.uint16) if group[-1] < 1 << 16 else group
    same_group = group[1:] == group[:-1]
    at, common, later = np.arange(rows), np.zeros(rows, np.int64), np.zeros((rows, width), bool)
    for c in range(len(columns) - 1, -1, -1):
        inserted = columns[c][at]
        to = np.argsort(inserted, kind="stable")
        to = to[np.argsort(small[to], kind="stable")]
        symbol = inserted[to]
        grown = np.flatnonzero(same_group & (symbol[1:] == symbol[:-1]) & (symbol[1:] != _NONE)) + 1
        new = np.zeros(rows, np.int64)
        if len(grown):
            # the least of common[left + 1 : right + 1]
            left, right = to[grown - 1], to[grown]
            near = right - left == 1
            new[grown[near]] = common[right[near]] + 1
            far = grown[~near]
            if len(far):
                ends = np.stack([left[~near] + 1, right[~near] + 1], axis=1).ravel()
                new[far] = np.minimum.reduceat(np.append(common, 0), ends)[::2] + 1
        at, common = at[to], new
        if c < width and (common >= length).any():
            heads = np.flatnonzero(common < length)
            mine = order[at]
            least = np.repeat(np.minimum.reduceat(mine, heads), np.diff(np.append(heads, rows)))
            later[at[mine > least], c] = True
    return later


def _same_strings(length: int):
    """From pieces in the order of their anchors: the starts of strings that occur earlier."""
    width = length - GRAM + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:
            known = b["piece"].isna().to_numpy()
            if known.any():
                starts = b[known]
                yield starts.assign(last=starts["first"] + starts["lead"])[[c.split()[0] for c in _STARTS.split(", ")]]
                b = b[~known]
            if not len(b):
                continue
            held.append(b)
            n += len(b)
            if n >= BLOCK_PIECES:
                b = pd.concat(held, ignore_index=True)
                # the last anchor may go on in the next batch
                last = b["hash"] == b["hash"].iat[-1]
                yield from found(b[~last])
                held, n = [b[last]], int(last.sum())
        if held:
            yield from found(pd.concat(held, ignore_index=True))

    def found(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        b = b[b["hash"].duplicated(keep=False)]
        if not len(b):
            return
        rank = b[["_none", "_id", "_key", "first"]].reset_index(drop=True)
        by = np.lexsort((rank["first"], rank["_key"], rank["_id"], rank["_none"]))
        ordered = rank.iloc[by].to_numpy(np.int64)
        order = np.empty(len(b), np.int64)
        order[by] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).any(axis=1)]))
        lead = b["lead"].to_numpy(np.int64)
        later = later_strings(b["piece"].tolist(), b["hash"].to_numpy(), lead, order, length)
        turns = np.diff(np.pad(later, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(turns == 1)
        end = np.nonzero(turns == -1)[1]
        own = b.iloc[row]
        base = own["first"].to_numpy() + lead[row] - (width - 1)
        yield own[["chunk", "_none", "_id", "_key"]].assign(first=base + start, last=base + end - 1)

    return run


_KEPT = "_none boolean, _id long, text_key long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _kept(length: int):
    """A chunk's documents without the bytes of the strings that start at the given places."""

    def run(starts: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        of: dict[tuple, list[tuple[int, int]]] = {}
        for none, i, key, a, z in zip(*(starts[c].tolist() for c in ("_none", "_id", "_key", "first", "last")), strict=True):
            of.setdefault((none, i, key), []).append((a, z + length))
        rows = []
        for none, i, key, text in zip(docs["_none"].tolist(), docs["_id"].tolist(), docs["_key"].tolist(), docs["_text"], strict=True):
            spans: list[list[int]] = []
            for a, z in sorted(of.get((none, i, key), ())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], z)
                else:
                    spans.append([a, z])
            kept, at = [], 0
            for a, z in spans:
                kept.append(text[at:a])
                at = z
            rows.append((none, i, key, len(text), sum(z - a for a, z in spans), [{"start": a, "end": z} for a, z in spans], b"".join(kept) + text[at:] if spans else text))
        return pd.DataFrame(rows, columns=["_none", "_id", "text_key", "n_bytes", "n_removed", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per row of docs: doc_id, text_key (xxhash64 of the text), n_bytes, n_removed, spans (start and end of each maximal removed run of bytes), kept (the other bytes).

    A byte is removed if a string of `length` bytes (2 * GRAM at least) that covers it also starts earlier: in a document of smaller id, or before in the same one.
    Strings are those of the given texts as UTF-8 and never reach over two documents. Null and empty texts have no bytes. Ids are integers; null comes last; of documents that
    share an id the one with the smaller text_key comes first, and repeated rows are one document, with repeated results. An empty table gives an empty one. Only id and text
    are read, so other columns may have any name. A text must fit a task's memory a few times over.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    given = column(id_col)
    rows = docs.select(given.isNull().alias("_none"), F.coalesce(given.cast("long"), F.lit(0).cast("long")).alias("_id"), F.xxhash64(column(text_col)).alias("_key"), F.coalesce(column(text_col).cast("binary"), F.lit(b"")).alias("_text"))
    texts = _written(rows.mapInPandas(_chunks, "_none boolean, _id long, _key long, _text binary, chunk long"))
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    common = spark.sparkContext.broadcast(_common_grams(texts))
    prints = texts.select("chunk", "_text").mapInPandas(_prints(common, length), "hash long, chunk long, many boolean")
    repeated = prints.repartition(parts, "hash").sortWithinPartitions("hash").mapInPandas(_repeated, "chunk long, hash long")
    pieces = repeated.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInPandas(_pieces(common, length), _PIECES)
    starts = pieces.repartition(parts, "hash").sortWithinPartitions("hash").mapInPandas(_same_strings(length), _STARTS)
    out = starts.groupBy("chunk").cogroup(texts.groupBy("chunk")).applyInPandas(_kept(length), _KEPT)
    return out.select(F.when(~F.col("_none"), F.col("_id")).alias("doc_id"), "text_key", "n_bytes", "n_removed", "spans", "kept")
