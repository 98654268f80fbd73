r"""Secret scans: base patterns, and novelty against a primed zstandard dictionary.

Base kinds are `assign`, `access` and `hex`. Besides them, every string of 12 or more key characters that stands in a sensitive
context (a word such as secret, token or key shortly before it) is a candidate. A candidate's novelty is what it adds to the
compressed size: zstandard, primed with a dictionary of usual identifiers and the text around the candidate (less its own copies), compresses the
surroundings without and with it. Words and identifiers cost few bits a character, keys cost nearly as many as random ones do; those of
at least `BITS_LEAST` become spans of kind `novel`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column

KINDS = ("assign", "access", "hex")
#: Bits that a character of a candidate must add at least; base64 has 6, hex 4, identifiers made of usual words about 2.
BITS_LEAST = 3.2
SURROUNDINGS = 512
#: Characters before a candidate in which a sensitive word makes its context sensitive.
CONTEXT = 48

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_SENSITIVE = re.compile(r"(?i:passw|passphrase|secret|token|api[_-]?key|credential|authorization|bearer|private[_-]?key|access[_-]?key|signature)", re.A)
#: Every match of _ASSIGN and _SENSITIVE holds one of these, in either case; a text without them needs no search for those.
_PARTS = ("passw", "passphrase", "secret", "token", "key", "credential", "authorization", "bearer", "signature")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")

#: Usual identifiers of code and configuration, which a candidate may be made of.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key credential authorization bearer username account client_id client_secret "
    "session_id request response header content_type application json string integer boolean double float return function class public private "
    "protected static final void import export default config configuration environment production development staging localhost database "
    "connection host port address server service endpoint bucket region instance cluster version release example sample placeholder changeme "
    "your_password_here your_api_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "get_value set_value is_valid has_next to_string from_string read_file write_file open_connection close_connection user_name first_name last_name"
)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By start, then kind as listed; code points. A match of `assign` spans all of it; one whose value is short drops out, without retry."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def _may_be_sensitive(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in _PARTS)


class Novelty:
    """Marginal compressed size under one primed dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS) -> None:
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._zstd = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_dict_id=False)

    def bits(self, around: str, candidate: str) -> float:
        """Bits that each character of the candidate adds to its surroundings."""
        before, extra = around.encode("utf-8", "surrogatepass"), candidate.encode("utf-8", "surrogatepass")
        return 8 * (len(self._zstd.compress(before + b" " + extra)) - len(self._zstd.compress(before + b" "))) / max(len(candidate), 1)


def _masked(part: str, candidate: str) -> str:
    """part without copies of the candidate, or of key strings inside it: a key that stands twice is as novel as one that stands once."""
    part = part.replace(candidate, " " * len(candidate))
    return _CANDIDATE.sub(lambda m: " " * len(m[0]) if m[0] in candidate else m[0], part)


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty, least: float = BITS_LEAST) -> list[tuple[str, int, int]]:
    """Spans of kind novel, by start. Base spans and candidates are both read from left to right, once."""
    taken = sorted((a, b) for _, a, b in base)
    out, done, at, reached = [], 0, 0, 0
    for s in _SENSITIVE.finditer(text):
        # candidates that start in the context: the least of them end 11 characters behind it
        for m in _CANDIDATE.finditer(text, max(s.end(), done), min(len(text), s.end() + CONTEXT + 11)):
            # the window may end inside a candidate: it is read to its own end
            whole = _CANDIDATE.match(text, m.start())
            done = whole.end()
            while at < len(taken) and taken[at][0] < whole.end():
                reached = max(reached, taken[at][1])
                at += 1
            if reached > m.start():
                continue
            # copies are masked in a wider window first, so that its edge cuts none that reaches into the surroundings
            wide = SURROUNDINGS + len(whole[0])
            before, after = _masked(text[max(0, m.start() - wide) : m.start()], whole[0]), _masked(text[whole.end() : whole.end() + wide], whole[0])
            around = before[-SURROUNDINGS:] + " " + after[:SURROUNDINGS]
            if novelty.bits(around, whole[0]) >= least:
                out.append(("novel", *whole.span()))
    return out


def all_spans(text: str | None, novelty: Novelty) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base and novel spans), by start, then kind as listed, novel last."""
    text = text or ""
    if not _may_be_sensitive(text) and not _ACCESS.search(text) and not _HEX.search(text):
        return [], []
    base = base_spans(text)
    order = {k: i for i, k in enumerate((*KINDS, "novel"))}
    return base, sorted(base + novel_spans(text, base, novelty), key=lambda x: (x[1], order[x[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets_found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base spans, base (joined spans), spans (all, joined).

    Null texts are empty: no spans. Whole texts are read; each row by itself, so repeated rows get equal results, ids may be null or tied, and an
    empty table gives no rows. Only id and text are read; other columns may have any name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty()
        for b in batches:
            rows = []
            for text in b["text"]:
                base, spans = all_spans(text, novelty)
                rows.append((*(sum(x[0] == k for x in base) for k in KINDS), joined(base), joined(spans)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in KINDS), "base", "spans"], index=b.index)
            yield pd.concat([b[["id"]], out], axis=1)

    inner = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return inner.mapInPandas(run, f"id {inner.schema['id'].dataType.simpleString()}, {counts}, base string, spans string").withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret replaced by mark; overlapping spans are one.

    All columns, of any name, and all rows stay, repeated ones too; null and empty texts stay as they are; an empty table stays empty.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        novelty, out = Novelty(), []
        for text in texts:
            spans = all_spans(text, novelty)[1] if text else []
            parts, at = [], 0
            for _, a, b in spans:
                if b > at:
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = b
            out.append("".join([*parts, text[at:]]) if spans else text)
        return pd.Series(out, dtype=object)

    return docs.select(*(clean(column(c)).alias(c) if c == text_col else column(c) for c in docs.columns))
