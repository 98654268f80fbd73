"""MinHash near-duplicates by an LSH forest.

Each distinct shingle set gets a MinHash signature. A tree of the forest is one sorted order of all signatures, read from
its own start within the signature; there are `TREES` of them. Candidates are neighbours in an order: those up to `REACH`
places apart that share at least the order's first hash. No prefix length is fixed beforehand: the depth of a set in a tree is the least
prefix length whose other holders all stand within REACH, so in a sparse region one common hash makes two sets candidates, and in a dense
one the longest common prefixes do. A set has at most 2 * REACH * TREES candidates, whatever the size of its group: copies
of one text are one set, and groups of near copies are joined through chains of neighbours.

Depths also tell what the forest may miss. Two sets of similarity t share a prefix of d hashes with probability t ** d, so the chance that no tree
finds a link of a set is the product of 1 - t ** depth over its trees. In sparse regions (depth 1 everywhere) that is 2e-10; sets with
more than `MISS` are open. Links between open sets are found exactly, by a join: in any total order of all shingles, two
sets of similarity t share one of the first n - ceil(t * n) + 1 shingles of each. The order puts rare shingles first; how rare they are is estimated
from a sample, which changes the cost alone. Open sets of different components that share such a shingle, and whose sizes and places of it allow a link,
are confirmed. Sets of one component don't meet at all, and shingles of many sets are dealt over blocks, so no task gets all pairs of one.

Candidates whose sizes rule out a link are dropped (exact); all others are confirmed on the full shingle sets, first the best sketch of each set,
then those that would still join two components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, extended
from .shared import ascii_words, column, dropped, hashes_of, saved, shingles, small_side

SHINGLE = 5
HASHES = 64
TREES = 16
DEPTH = 4
REACH = 3
#: The chance of a missed link above which a set is open.
MISS = 1e-8
#: One set in SAMPLE tells how common a shingle is; those of fewer than SEEN sampled sets count as rare, and at most COMMON others are remembered.
SAMPLE = 8
SEEN = 3
COMMON = 500_000
#: Sets of a shingle that are compared in one block, about.
BLOCK = 512
#: Common shingles before its own that a posting names, to tell that two sets met already.
EARLIER = 4

_A = np.random.Generator(np.random.Philox(41)).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.random.Generator(np.random.Philox(43)).integers(0, 2**63, HASHES, dtype=np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    """HASHES minima, as uint32."""
    low = np.full(HASHES, np.uint64(2**64 - 1))
    for k in range(0, len(items), 4096):
        np.minimum(low, (items[k : k + 4096, None] * _A + _B).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _text_key, _text of docs."""
    return docs.select(column(id_col).alias("_id"), F.xxhash64(column(text_col)).alias("_text_key"), column(text_col).alias("_text"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: _id, _text_key, _set (128-bit key of the shingle set, null if empty), _n, _sig."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["_text"]:
                s = shingles(hashes_of(ascii_words(text)), width)
                out.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), signature(s).astype(">u4").tobytes()) if len(s) else (None, 0, None))
            yield pd.DataFrame({"_id": b["_id"], "_text_key": b["_text_key"], "_set": [x[0] for x in out], "_n": [x[1] for x in out], "_sig": [x[2] for x in out]})

    rows = keyed(docs, id_col, text_col)
    return rows.mapInPandas(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _text_key long, _set binary, _n long, _sig binary")


_FOREST = "tree int, place binary, node binary, n int, s0 long, s1 long"
_FOREST_COLUMNS = [x.split()[0] for x in _FOREST.split(", ")]
_FOUND = f"a binary, b binary, agree int, {_FOREST}, depth int"
_FOUND_COLUMNS = [x.split()[0] for x in _FOUND.split(", ")]


def _common_prefix(places: np.ndarray, tree: np.ndarray, apart: int) -> np.ndarray:
    """Hashes that each row's place has in common with that of the row so many places on."""
    if apart >= len(tree):
        return np.zeros(0, np.int64)
    same = (places[:-apart] == places[apart:]) & (tree[:-apart] == tree[apart:])[:, None]
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def _neighbours(b: pd.DataFrame, places: np.ndarray, tree: np.ndarray, reach: int, new: int, percent: int) -> Iterator[pd.DataFrame]:
    """Pairs of rows up to `reach` places apart with a common first hash; a < b.

    Sets whose sizes alone rule out a link make no pair: their similarity is at most the smaller size over the larger one.
    Pairs among the rows before `new` were seen with the batch before.
    """
    n, sets = b["n"].to_numpy(np.int64), b["node"].to_numpy(object)
    s0, s1 = b["s0"].to_numpy(np.int64), b["s1"].to_numpy(np.int64)
    for d in range(1, min(reach, len(b) - 1) + 1):
        near = (tree[:-d] == tree[d:]) & (places[:-d, 0] == places[d:, 0])
        near[: max(0, new - d)] = False
        near &= 100 * np.minimum(n[:-d], n[d:]) >= percent * np.maximum(n[:-d], n[d:])
        near = np.flatnonzero(near)
        if len(near):
            swap = sets[near] > sets[near + d]
            x, y = np.where(swap, near + d, near), np.where(swap, near, near + d)
            agree = HASHES - np.bitwise_count(((s0[x] ^ s0[y]) | (s1[x] ^ s1[y])).view(np.uint64)).astype(np.int32)
            yield pd.DataFrame({"a": sets[x], "b": sets[y], "agree": agree})


def _scan(reach: int, percent: int, edges: bool):
    """Reads rows in the forest's order; yields candidate pairs (a, b, agree), depths above 1 (tree, node, depth), and if asked the rows at the partition's ends.

    A depth needs the rows reach + 1 places away on both sides; those outside the partition count as sharing nothing.
    """
    step = reach + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = head = None
        late = 0  # rows at the end of the tail whose depth isn't known
        for b in batches:
            if not len(b):
                continue
            if head is None or len(head) < step:
                head = b.iloc[:step] if head is None else pd.concat([head, b.iloc[: step - len(head)]])
            new = 0 if tail is None else len(tail)
            b = b if tail is None else pd.concat([tail, b], ignore_index=True)
            yield from found(b, new, new - late, max(0, len(b) - step))
            late = min(step, len(b) - (new - late))
            tail = b.iloc[-2 * step :]
        if tail is not None:
            yield from found(tail, len(tail), len(tail) - late, len(tail))
            if edges:
                ends = pd.concat([head, tail.iloc[-step:]]).drop_duplicates(["tree", "node"])
                yield ends.reindex(columns=_FOUND_COLUMNS).astype({"a": object, "b": object, "agree": "Int32", "depth": "Int32"})

    def found(b: pd.DataFrame, new: int, first: int, last: int) -> Iterator[pd.DataFrame]:
        """Pairs that have a row from `new` on; depths of the rows first to last - 1."""
        places, tree = np.frombuffer(b"".join(b["place"]), ">u4").reshape(len(b), DEPTH), b["tree"].to_numpy()
        out = [x for x in _neighbours(b, places, tree, reach, new, percent) if len(x)]
        if out:
            out = [pd.concat(out).drop_duplicates(["a", "b"])]
        common, gap = _common_prefix(places, tree, step), np.zeros(min(step, len(b)), np.int64)
        depth = 1 + np.maximum(np.concatenate([common, gap]), np.concatenate([gap, common]))
        deep = np.arange(first, max(first, last))
        deep = deep[depth[deep] > 1]
        if len(deep):
            out.append(pd.DataFrame({"tree": tree[deep], "node": b["node"].to_numpy(object)[deep], "depth": depth[deep]}))
        for x in out:
            yield x.reindex(columns=_FOUND_COLUMNS).astype({c: "Int32" if c in ("agree", "tree", "n", "depth") else "Int64" if c in ("s0", "s1") else object for c in _FOUND_COLUMNS})

    return run


def _trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each row once for every order, with a sketch of two bits for each hash."""
    for b in batches:
        if not len(b):
            continue
        sig = np.frombuffer(b"".join(b["sig"]), np.uint8).reshape(len(b), HASHES, 4)
        s0, s1 = (np.packbits(sig[:, :, 3] >> k & 1, axis=1).view(np.int64)[:, 0] for k in (0, 1))
        for t in range(TREES):
            place = sig[:, t * DEPTH : (t + 1) * DEPTH]
            yield pd.DataFrame({"tree": np.int32(t), "place": [x.tobytes() for x in place], "node": b["node"], "n": b["n"], "s0": s0, "s1": s1})


def forest(sets: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """From rows (node, n, sig): (a, b, agree), each pair of neighbours in some tree once; and (node) of the open sets."""
    parts = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # ranges of the whole order, not of its first hash: a dense region spreads over many tasks
    ordered = sets.mapInPandas(_trees, _FOREST).repartitionByRange(parts, "tree", "place", "node").sortWithinPartitions("tree", "place", "node")
    found = saved(ordered.mapInPandas(_scan(REACH, percent, True), _FOUND), "forest")
    # neighbours across a boundary between two ranges: REACH + 1 rows from each side, so their number depends on the ranges alone
    ends = found.filter("place is not null").select(*_FOREST_COLUMNS).coalesce(1).sortWithinPartitions("tree", "place", "node")
    found = found.unionByName(ends.mapInPandas(_scan(REACH, percent, False), _FOUND))
    pairs = found.filter("a is not null").groupBy("a", "b").agg(F.max("agree").alias("agree"))
    # in each direction one of the two scans has seen the row that decides, and the other one no closer row
    depths = found.filter("depth is not null").groupBy("node", "tree").agg(F.max("depth").alias("depth"))
    # logarithm of the chance that no tree finds a link, above that of depth 1 everywhere
    t = percent / 100
    lost = F.when(F.col("depth") > DEPTH, 0.0).otherwise(F.log1p(-F.pow(F.lit(t), F.col("depth"))))
    open_sets = depths.groupBy("node").agg(F.sum(lost - math.log1p(-t)).alias("more")).filter(F.col("more") > math.log(MISS) - TREES * math.log1p(-t)).select("node")
    return pairs, open_sets


def candidates(sets: DataFrame, percent: int = 75) -> DataFrame:
    """(a, b, agree): neighbours in any tree of the forest, from rows (node, n, sig)."""
    return forest(sets, percent)[0]


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles in order, sampled sets of each) of those that many sets have, from rows (node, _text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for text in b["_text"]:
                yield pd.DataFrame({"shingle": shingles(hashes_of(ascii_words(text)), width).view(np.int64)})

    some = texts.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("_text")
    seen = saved(some.mapInPandas(run, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") >= SEEN), "common")
    least, kept = SEEN, 0
    for r in sorted(seen.groupBy(F.least("sets", F.lit(1 << 20)).alias("sets")).count().collect(), key=lambda r: -r["sets"]):
        kept += r["count"]
        if kept > COMMON:
            least = r["sets"] + 1
            break
    got = seen.filter(F.col("sets") >= least).toPandas().sort_values("shingle")
    dropped(seen)
    return got["shingle"].to_numpy(np.int64), got["sets"].to_numpy(np.int64)


_POSTS = "shingle long, at int, n int, node binary, root binary, earlier binary"


def first_shingles(texts: DataFrame, width: int, percent: int, values: np.ndarray, counts: np.ndarray) -> DataFrame:
    """Postings from rows (node, root, _text): the shingles that any linked set shares one of, rare ones first, with their place.

    earlier: the last EARLIER common shingles that the set has before this one, as int64; 0 for none.
    """
    common = texts.sparkSession.sparkContext.broadcast((values, counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, counts = common.value
        for b in batches:
            for node, root, text in zip(b["node"], b["root"], b["_text"], strict=True):
                s = shingles(hashes_of(ascii_words(text)), width).view(np.int64)
                sets = np.zeros(len(s), np.int64)
                if len(values):
                    k = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    sets = np.where(values[k] == s, counts[k], 0)
                first = np.lexsort((s, sets))[: len(s) - -(-percent * len(s) // 100) + 1]
                # rare shingles, which are not named, come first
                named = np.concatenate([np.zeros(EARLIER, np.int64), np.where(sets[first] > 0, s[first], 0)])
                earlier = [named[k : k + EARLIER].tobytes() for k in range(len(first))]
                yield pd.DataFrame({"shingle": s[first], "at": np.arange(len(first), dtype=np.int32), "n": np.int32(len(s)), "node": node, "root": root, "earlier": earlier})

    return texts.select("node", "root", "_text").mapInPandas(run, _POSTS)


def dealt(posts: DataFrame) -> DataFrame:
    """Postings of shingles that two components hold, in blocks (shingle, x, y): a pair of different components meets in one block, on different sides of it unless x = y.

    A shingle's holders are cut into parts of about BLOCK: each component of more holders has parts of its own, which don't meet each other, and the rest share
    parts by component. So a holder goes to as many blocks as there are parts of other components, and sets of one large component never meet.
    """
    by_root = posts.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("k"))
    cut = lambda k: F.ceil(k / BLOCK).cast("int")
    large = F.col("k") > BLOCK
    held = by_root.groupBy("shingle").agg(F.count(F.lit(1)).alias("roots"), cut(F.sum(F.when(large, 0).otherwise(F.col("k")))).alias("shared"), F.array_sort(F.collect_list(F.when(large, F.struct("root", cut(F.col("k")).alias("parts"))))).alias("large")).filter("roots > 1")
    # numbers of the parts: the shared ones first
    add = lambda acc, r: F.concat(acc, F.array(F.struct(r["root"].alias("root"), (F.element_at(acc, -1)["first"] + F.element_at(acc, -1)["parts"]).alias("first"), r["parts"].alias("parts"))))
    none = F.array(F.struct(F.lit(None).cast("binary").alias("root"), F.lit(0).alias("first"), F.col("shared").alias("parts")))
    numbered = held.select("shingle", F.aggregate("large", none, add).alias("p"))
    both = posts.join(numbered, "shingle").withColumn("own", F.coalesce(F.get(F.filter("p", lambda r: r["root"] == F.col("root")), 0), F.get("p", 0)))
    own, last = F.col("own"), F.element_at("p", -1)
    among = F.when(own["root"].isNull(), F.xxhash64("root")).otherwise(F.xxhash64("node"))
    both = both.withColumn("part", own["first"] + F.pmod(among, own["parts"]).cast("int"))
    others = F.filter(F.sequence(F.lit(0), last["first"] + last["parts"] - 1), lambda j: own["root"].isNull() | (j < own["first"]) | (j >= own["first"] + own["parts"]))
    blocks = F.transform(others, lambda j: F.struct(F.least("part", j).alias("x"), F.greatest("part", j).alias("y"), (F.col("part") > j).cast("int").alias("side")))
    return both.select("shingle", F.explode(blocks).alias("b"), "at", "n", "node", "root", "earlier").select("shingle", "b.*", "at", "n", "node", "root", "earlier")


def _meetings(percent: int):
    """From postings in the order of (shingle, x, y): pairs of sets (a, b), a < b, of different roots that may be linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if len(b):
                # the last block may go on in the next batch
                last = np.logical_and.reduce([(b[c] == b[c].iat[-1]).to_numpy() for c in ("shingle", "x", "y")])
                start = len(b) - int(last.sum())
                held = b.iloc[start:]
                yield from met(b.iloc[:start])
        if held is not None:
            yield from met(held)

    def met(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(b) < 2:
            return
        keys = b[["shingle", "x", "y"]].to_numpy(np.int64)
        side, at, n = (b[c].to_numpy(np.int64) for c in ("side", "at", "n"))
        node, root = b["node"].to_numpy(object), pd.factorize(b["root"])[0]
        earlier = np.frombuffer(b"".join(b["earlier"]), np.int64).reshape(len(b), EARLIER)
        within = keys[:, 1] == keys[:, 2]
        heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(heads, len(b)))
        block = np.repeat(np.arange(len(heads)), sizes)
        small, found = np.repeat(sizes <= 64, sizes), []

        def tried(x: np.ndarray, y: np.ndarray) -> None:
            # the first shingle that two sets share leaves at most so many others: both sizes and places bound what they have in common
            may = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            may &= (100 + percent) * np.minimum(n[x] - at[x], n[y] - at[y]) >= percent * (n[x] + n[y])
            i, j = x[may], y[may]
            # two sets that share an earlier shingle met there, where the bound is the one that holds
            before = ((earlier[i][:, :, None] == earlier[j][:, None, :]) & (earlier[i] != 0)[:, :, None]).any(axis=(1, 2))
            i, j = i[~before], j[~before]
            if len(i):
                swap = node[i] > node[j]
                found.append(pd.DataFrame({"a": np.where(swap, node[j], node[i]), "b": np.where(swap, node[i], node[j])}))

        # blocks of a few rows together, one distance after the other
        x = np.flatnonzero(small)
        for d in range(1, len(b)):
            x = x[x < len(b) - d]
            x = x[block[x] == block[x + d]]
            if not len(x):
                break
            meets = x[within[x] | (side[x] != side[x + d])]
            tried(meets, meets + d)
        # of a large one, a row after the other: against the components behind its own, or against the larger side
        for k in np.flatnonzero(sizes > 64):
            rows = np.arange(heads[k], heads[k] + sizes[k])
            if within[rows[0]]:
                rows = rows[np.argsort(root[rows], kind="stable")]
                for i, end in zip(rows, np.searchsorted(root[rows], root[rows], side="right"), strict=True):
                    tried(np.full(len(rows) - end, i), rows[end:])
            else:
                few, many = sorted((rows[side[rows] == 0], rows[side[rows] == 1]), key=len)
                for i in few:
                    tried(np.full(len(many), i), many)
        if found:
            yield pd.concat(found).drop_duplicates()

    return run


def exact_candidates(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b), a < b: every pair of sets of different components that may be linked, from rows (node, root, _text)."""
    posts = saved(first_shingles(texts, width, percent, *common_shingles(texts, width)), "posts")
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = ("shingle", "x", "y")
    return dealt(posts).repartition(parts, *keys).sortWithinPartitions(*keys).mapInPandas(_meetings(percent), "a binary, b binary").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["_x"], b["_y"], strict=True):
                s, t = (shingles(hashes_of(ascii_words(z)), width) for z in (x, y))
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(t) - both))
            yield b.loc[keep, ["a", "b"]]

    left = texts.select(F.col("node").alias("a"), F.col("_text").alias("_x"))
    right = texts.select(F.col("node").alias("b"), F.col("_text").alias("_y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInPandas(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = 75) -> DataFrame:
    """Per row of docs: doc_id, text_key (xxhash64 of the text), n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their distinct `width`-word shingles is at least percent / 100.
    component_id is the smallest id reachable over links; kept marks the rows that carry it. Null and empty texts have no
    shingles, link with nothing and are their own component. A null id can't be the smallest while any other id is reachable;
    a component of null ids alone has component_id null and is kept. Repeated rows give repeated results; rows that share an id
    but not the text are separate documents. Only id and text are read; other columns may have any name.
    """
    rows = saved(shingle_sets(docs, id_col, text_col, width), "sets")
    # one node for each distinct set; copies meet here, added up before the shuffle
    nodes = saved(rows.filter("_set is not null").groupBy(F.col("_set").alias("node")).agg(F.min("_id").alias("least"), F.min(F.struct("_id", "_text_key")).alias("who"), F.first("_n").cast("int").alias("n"), F.first("_sig").alias("sig")), "nodes")
    # a text of one document that several rows repeat is read from one of them
    repeated = rows.groupBy("_id", "_text_key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("_id", "_text_key")
    again = saved(nodes.join(repeated, nodes["who._id"].eqNullSafe(repeated["_id"]) & (nodes["who._text_key"] == repeated["_text_key"]), "left_semi").select("node"), "repeated")
    pairs, open_sets = forest(nodes.select("node", "n", "sig"), percent)
    pairs, open_sets = saved(pairs, "pairs"), saved(open_sets, "open")

    whole, n_again = keyed(docs, id_col, text_col), again.count()

    def texts_of(some: DataFrame) -> DataFrame:
        """(node, _text) of nodes."""
        wanted = some.select("node", F.col("who._id").alias("_id"), F.col("who._text_key").alias("_text_key"))
        on = small_side(wanted, wanted.count())
        found = whole.join(on, whole["_id"].eqNullSafe(on["_id"]) & (whole["_text_key"] == on["_text_key"])).select("node", "_text")
        more = small_side(again, n_again)
        return found.join(more, "node", "left_anti").unionByName(found.join(more, "node", "left_semi").dropDuplicates(["node"])) if n_again else found

    def named(pairs: DataFrame) -> DataFrame:
        return saved(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "who"), "wanted")

    texts = saved(texts_of(named(pairs)), "texts")

    both = pairs.select("a", "b", "agree").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = both.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()
    roots = components(saved(confirmed(best, texts, width, percent), "links"))
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    rest = pairs.select("a", "b").join(ra, "a", "left").join(rb, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    more = saved(confirmed(rest.join(best, ["a", "b"], "left_anti"), texts, width, percent), "links")
    if more.head(1):
        roots = extended(roots, more)
    dropped(texts)
    of = open_sets.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    texts = saved(texts_of(open_sets.join(nodes, "node").select("node", "who")).join(of, "node"), "texts")
    # tried pairs across two components failed
    exact = saved(exact_candidates(texts, width, percent).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "exact")
    dropped(texts)
    if exact.head(1):
        texts = saved(texts_of(named(exact)), "texts")
        more = saved(confirmed(exact, texts, width, percent), "links")
        dropped(texts)
        if more.head(1):
            roots = extended(roots, more)

    of_node = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    linked = of_node.filter("root is not null")
    ids = linked.groupBy("root").agg(F.min("least").alias("component"))
    final = linked.join(ids, "root").select(F.col("node").alias("_set"), "component")
    out = rows.select("_id", "_text_key", "_set", "_n").join(final, "_set", "left")
    component = F.when(F.col("_set").isNull(), F.col("_id")).otherwise(F.col("component"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_text_key").alias("text_key"), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each group of near duplicates, with the columns that docs has, whatever their names.

    The row that stays has the smallest id; of rows with that id and text, the one with the smallest hash of its other columns. Rows with null or empty text are groups of
    their own, so one of those that share an id stays. An empty table gives an empty one.
    """
    marks = near_duplicates(docs, id_col, text_col).filter("kept").select("doc_id", "text_key").distinct()
    # the columns of docs travel in one struct, so that no name of theirs can clash
    others = [column(c) for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(F.struct(*map(column, docs.columns)).alias("row"), column(id_col).alias("id"), F.xxhash64(column(text_col)).alias("key"), (F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)).alias("other"))
    on = rows["id"].eqNullSafe(marks["doc_id"]) & (rows["key"] == marks["text_key"])
    return rows.join(marks, on, "left_semi").groupBy("id", "key").agg(F.min_by("row", "other").alias("row")).select("row.*")
