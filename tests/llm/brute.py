"""Plain single-process versions of what the operators must return."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def shingle_set(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id), for distinct ids."""
    sets = {i: shingle_set(t) for i, t in rows}
    parent, inverted = {i: i for i in sets}, defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in inverted[s]).items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            inverted[s].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def pii_base(text: str | None) -> str:
    t = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def secrets_base(text: str | None) -> str:
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A) if len(m[1]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def contamination(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[int, tuple]:
    windows, sizes = defaultdict(set), set()
    for i, t in items:
        w = BENCH_WORD.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        if n:
            sizes.add(n)
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    out = {}
    for i, t in docs:
        w, hit, found = BENCH_WORD.findall((t or "").translate(LOWER)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= x
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def planted_periods(doc_id: int | None, text: str | None) -> list[str]:
    w = WORD.findall(text or "")
    if doc_id is None:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i if i < a else a + (i - a) % p] for i in range(n)]


def runs(w: list[str], least_length: int = 6, least_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start, then period: for each period all stretches, without those of a smaller one."""
    n, stretches = len(w), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            if w[k] != w[k + q]:
                k += 1
                continue
            e = k
            while e < n - q and w[e] == w[e + q]:
                e += 1
            if e - k >= q:
                stretches.setdefault((k, e + q), q)
            k = e
    return sorted((s, e - s, q) for (s, e), q in stretches.items() if e - s >= max(least_length, least_exponent * q))


def runs_row(doc_id: int | None, text: str | None) -> tuple:
    w = planted_periods(doc_id, text)
    found = runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    s, n, q = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    return len(found), s, n, q, None if q is None else 1000 * n // q, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def variant_words(docs: list[tuple[int | None, str | None]], least_letters: int = 6, least_count: int = 5) -> dict[str, int]:
    out: Counter = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            if i is not None and (h := zlib.crc32(f"{i}:{w}".encode())) % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= least_letters and n >= least_count}


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(words: dict[str, int], ratio: int = 5) -> dict[str, tuple]:
    """word: (n, n_near, form, form_n, root). Words one apart share one of the strings that one deletion at most leaves."""
    left = defaultdict(set)
    for w in words:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            left[x].add(w)
    near = defaultdict(set)
    for group in left.values():
        for a in group:
            near[a] |= {b for b in group if one_apart(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (n, len(near[w]), form[w], words.get(form[w]), root)
    return out


def repeated_strings(docs: list[tuple[int, str | None]], length: int = 100) -> dict[int, tuple]:
    """doc_id: (n_bytes, n_removed, n_spans, digest of what is left), for distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = [True] * length
            seen.add(s)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out
