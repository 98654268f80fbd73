r"""Personal data: base patterns, and bootstrapped contextual extraction of what they miss.

Base entities (email, ip, card, phone) are the seeds. A document task also collects every loosely identifier-like string that
is not one of them: eight or more digits with separators, or a name, "at"-sign and host in other spellings. Contexts of both (words to the left, words to the
right, and one word on both sides) are the lexical patterns. Spark scores the graph of patterns and instances for `ROUNDS` rounds:
a pattern's confidence is the share of the weight of its instances that are believed, an instance's is that one of its patterns at
least is right (noisy or); seeds stay at 1, and so do unmarked strings with the characters of a seed. Instances that reach `INSTANCE_LEAST` through patterns seen with `SUPPORT` different
seeds at least become spans of their kind, where a believed pattern stands around them. Only contexts are shuffled, never texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, dropped, saved

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT = 3
PATTERN_LEAST = 0.6
INSTANCE_LEAST = 0.8
#: Characters on each side of a string that its contexts come from.
CONTEXT = 120

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is matched from its start or not at all, so possessive runs change no match and long runs cost linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){7,24}(?![A-Za-z0-9])")
_ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?[(\[{<]\x20?(?:at|AT|@)\x20?[)\]}>]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[{]\x20?(?:dot|DOT)\x20?[)\]}])\x20?[A-Za-z0-9-]{2,63}){1,4}")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> list[tuple[int, int]]:
    r"""Leftmost non-overlapping `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`, in linear time: from each @ to both sides."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
            at = text.find("@", end)
        else:
            end = max(end, at)  # what stands before this @ can't start a later match
            at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start; code points."""
    out = [("email", *x) for x in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns around a string: its neighbours within CONTEXT characters, less a word that the limit cuts."""
    before, after = text[max(0, start - CONTEXT - 1) : start], text[end : end + CONTEXT + 1]
    left, right = [[m.span() for m in _WORD.finditer(x)] for x in (before, after)]
    left = [before[a:b].lower() for a, b in left if a or start <= CONTEXT][-2:]
    right = [after[a:b].lower() for a, b in right if b < len(after) or end + CONTEXT >= len(text)][:1]
    one = left[-1] if left else "^"
    after = right[0] if right else "$"
    return [f"<{one}", f"<<{' '.join(left)}"] * bool(left) + [f">{after}"] * bool(right) + [f"{one}_{after}"]


def _candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Loosely identifier-like strings that overlap no span taken. Both are read from left to right, once for each pattern."""
    spans = sorted((a, b) for _, a, b in taken)
    out = []
    for kind, rx in (("number", _NUMBERS), ("email", _ADDRESS)):
        if kind == "email" and not any(x in text for x in "([{<"):
            continue
        at = reached = 0
        for m in rx.finditer(text):
            while at < len(spans) and spans[at][0] < m.end():
                reached = max(reached, spans[at][1])
                at += 1
            if reached <= m.start():
                out.append((kind, m.start(), m.end()))
    return out


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: _id, _text_key, base spans as text, counts, and `seen`: what the bootstrapping needs of the document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["_text"]:
                text = text or ""
                base = base_spans(text)
                seen = [{"kind": k, "start": s, "end": e, "seed": seed, "instance": re.sub(r"[^0-9A-Za-z@]", "", text[s:e]).lower(), "contexts": _contexts(text, s, e)} for seed, found in ((True, base), (False, _candidates(text, base))) for k, s, e in found]
                rows.append((_joined(base), *(sum(x[0] == k for x in base) for k in KINDS), seen))
            out = pd.DataFrame(rows, columns=["base", *(f"n_{k}" for k in KINDS), "seen"], index=b.index)
            yield pd.concat([b[["_id", "_text_key"]], out], axis=1)

    inner = docs.select(column(id_col).alias("_id"), F.xxhash64(column(text_col)).alias("_text_key"), column(text_col).alias("_text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return inner.mapInPandas(run, f"_id {inner.schema['_id'].dataType.simpleString()}, _text_key long, base string, {counts}, seen array<struct<kind:string,start:int,end:int,seed:boolean,instance:string,contexts:array<string>>>")


def discovered(rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(_id, _text_key, kind, start, end) of the spans that high-confidence patterns add to scanned() rows."""
    seen = rows.select("_id", "_text_key", F.explode("seen").alias("s")).select("_id", "_text_key", "s.*")
    # numbers may turn out as any numeric kind; the graph keeps a node for each kind they could be
    kinds = F.when(F.col("kind") == "number", F.array(F.lit("card"), F.lit("ip"), F.lit("phone"))).otherwise(F.array("kind"))
    each = seen.withColumn("kind", F.explode(kinds))
    edges = saved(each.select("kind", "instance", "seed", F.explode(F.array_distinct("contexts")).alias("pattern")).groupBy("kind", "pattern", "instance", "seed").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    # only patterns that some seed has and some unseen string has can say anything
    linked = edges.groupBy("kind", "pattern").agg(F.count_if("seed").alias("seeds"), F.count_if(~F.col("seed")).alias("others")).filter(f"seeds >= {SUPPORT} and others > 0")
    # unmarked strings that equal a seed: as sure as the seed, wherever one pattern at least says that they are of its kind
    both = edges.groupBy("kind", "instance").agg(F.bool_or("seed").alias("some"), F.bool_and("seed").alias("all")).filter("some and not all").select("kind", "instance", F.lit(True).alias("known"))
    graph = saved(edges.join(linked.select("kind", "pattern"), ["kind", "pattern"]).join(both, ["kind", "instance"], "left").withColumn("known", F.coalesce("known", F.lit(False))), "pii-graph")
    dropped(edges)
    belief = None
    for _ in range(rounds):
        now = graph.withColumn("belief", F.when(F.col("seed") | F.col("known"), 1.0).otherwise(0.0)) if belief is None else graph.join(belief, ["kind", "instance"], "left").withColumn("belief", F.when(F.col("seed") | F.col("known"), 1.0).otherwise(F.coalesce("belief", F.lit(0.0))))
        patterns = now.groupBy("kind", "pattern").agg((F.sum(F.col("belief") * F.log1p("n")) / F.sum(F.log1p("n"))).alias("confidence")).filter(F.col("confidence") >= PATTERN_LEAST)
        patterns = saved(patterns, "pii-patterns")
        heard = graph.filter("not seed").join(patterns, ["kind", "pattern"])
        new = heard.groupBy("kind", "instance").agg(F.when(F.bool_or("known"), 1.0).otherwise(1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("belief"))
        new = saved(new, "pii-belief")
        if belief is not None:
            dropped(belief)
        belief = new
    best = belief.filter(F.col("belief") >= INSTANCE_LEAST).groupBy("instance").agg(F.max_by("kind", F.struct("belief", "kind")).alias("kind"))
    # an occurrence is marked where one of the patterns that are believed stands around it, not wherever the same characters stand
    sure = graph.filter("not seed").join(patterns, ["kind", "pattern"]).select("kind", "pattern", "instance").distinct()
    there = seen.filter("not seed").drop("kind").withColumn("pattern", F.explode("contexts")).join(best, "instance").join(sure, ["kind", "pattern", "instance"], "left_semi")
    return there.select("_id", "_text_key", "kind", "start", "end").distinct()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, counts of base spans, base_sha256, spans (base and discovered), found (number of spans added).

    Null texts are empty texts: no spans. Whole texts are read. Repeated rows get equal results; rows that share id but not text
    are kept apart by the text's hash. Columns other than id and text aren't read.
    """
    rows = saved(scanned(docs, id_col, text_col), "pii")
    more = discovered(rows).groupBy("_id", "_text_key").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("more"))
    out = rows.select("_id", "_text_key", "base", *(f"n_{k}" for k in KINDS)).alias("r")
    m = more.select(F.col("_id").alias("_mid"), F.col("_text_key").alias("_mkey"), "more")
    out = out.join(m, F.col("_id").eqNullSafe(F.col("_mid")) & (F.col("_text_key") == F.col("_mkey")), "left")
    order = F.create_map(*(F.lit(x) for p in zip(KINDS, range(len(KINDS)), strict=True) for x in p))
    parts = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    old = F.transform(parts, lambda x: F.struct(order[F.split(x, ":")[0]].alias("o"), F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("end"), F.split(x, ":")[0].alias("kind")))
    new = F.transform(F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda x: F.struct(order[x["kind"]].alias("o"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    spans = F.array_join(F.transform(F.array_sort(F.concat(old, new)), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return out.select(F.col("_id").alias(id_col), *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), F.when(F.col("more").isNull(), F.col("base")).otherwise(spans).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).alias("found"))
