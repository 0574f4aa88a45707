"""Secrets: patterns, extended by a battery of randomness tests.

Patterns find assignments, access keys and long hexadecimal runs. Further
candidates are runs of 20 or more characters of ``[A-Za-z0-9+/_=-]`` with at
least one letter and one digit. A run that fits no alphabet is cut at ``=``; a
part that has ``+`` or ``/`` and also ``-`` or ``_`` is cut at either pair of
these, since any of them may be what separates (``NAME=key``, ``path/key``), and
each piece of 20 or more characters is a candidate; of found pieces within each
other the longest is the span. A candidate's encoding (hexadecimal, base32,
base36, base62, base64) is inferred from its characters, and its symbols are
tested for what random keys have: a chi-squared test that the alphabet is used
uniformly, a runs test about the middle of the alphabet, and a serial
correlation test. The three are combined into one p-value that is uniform for
random strings and near zero for others.

False discoveries are controlled for each encoding and length class on its own,
since short candidates are told apart less well. Over all candidates of the
corpus (a histogram of bounded size reaches the driver) the number of random
ones is estimated from the upper half of the p-values; a class's threshold is
the least one at which the estimated share of others among the candidates above
it is at most ``rate``.

Edge cases: null is empty; empty texts have no spans; whole texts are read;
repeated rows are treated alike; an empty table gives an empty result; a class
without p-values in the upper half adds nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import erfc, log2, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, spans, sums

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
LEAST = 20
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
_PLACES = {name: {c: k for k, c in enumerate(a)} for name, a in ALPHABETS.items()}
BINS = 50
_NORMAL = NormalDist()
_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[list(b"+/_=-" + (_LOWER + _UPPER + _DIGITS).encode())] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_HEXES = np.zeros(256, dtype=bool)
_HEXES[list(b"0123456789abcdef")] = True
_EMPTY = hashlib.sha256(b"").hexdigest()

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


# -------------------------------------------------------------------- battery


def encoding(token: str) -> str | None:
    """The first alphabet that has all characters of the token."""
    chars = set(token)
    return next((name for name, places in _PLACES.items() if chars <= places.keys()), None)


def battery(symbols: np.ndarray, k: int) -> float:
    """Combined p-value of the three tests for uniform random symbols 0 to k - 1."""
    n = len(symbols)
    seen = np.bincount(symbols, minlength=k)
    chi = float(((seen - n / k) ** 2).sum() * k / n)
    z_uniform = (chi - (k - 1)) / sqrt(2 * (k - 1) * (1 - 1 / n))
    p_uniform = 0.5 * erfc(z_uniform / sqrt(2))
    high = 2 * symbols >= k
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * a * b / n + 1
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = erfc(abs(runs - mean) / sqrt(2 * var))
    else:
        p_runs = 0.0
    x = symbols - symbols.mean()
    v = float(x @ x)
    p_serial = erfc(abs(float(x[1:] @ x[:-1]) / v + 1 / n) * sqrt(n / 2)) if v > 0 else 0.0
    z = sum(_NORMAL.inv_cdf(min(max(p, 1e-12), 1 - 1e-12)) for p in (p_uniform, p_runs, p_serial)) / sqrt(3)
    return _NORMAL.cdf(z)


def _pieces(text: str, start: int, end: int) -> set[tuple[int, int]]:
    """Ranges of a run that fit an alphabet each."""
    token = text[start:end].rstrip("=")
    bare = token.lstrip("-_=+/")
    a = start + len(token) - len(bare)
    b = a + len(bare)
    if len(bare) < LEAST:
        return set()
    if encoding(bare):
        return {(a, b)}
    out = set()
    for mark in ("=",) if "=" in bare else ("/+", "-_"):
        for m in re.finditer(f"[^{re.escape(mark)}]+", bare):
            out |= _pieces(text, a + m.start(), a + m.end())
    return out


def candidates(text: str) -> Iterator[tuple[int, int, str, float]]:
    """start, end, class and p-value of each candidate."""
    for at, to in (piece for m in _RUN.finditer(text) for piece in sorted(_pieces(text, *m.span()))):
        bare = text[at:to]
        if not any(c.isdigit() for c in bare) or not any(c.isalpha() for c in bare):
            continue
        name = encoding(bare)
        symbols = np.fromiter((_PLACES[name][c] for c in bare), np.int64, len(bare))
        yield at, to, f"{name}/{min(int(log2(len(bare) / LEAST) * 2), 8)}", battery(symbols, len(ALPHABETS[name]))


def thresholds(histogram: dict[tuple[str, int], int], rate: float) -> dict[str, float]:
    """Least p-value to accept for each class; ``histogram``: (class, bin) to count."""
    out = {}
    for name in {c for c, _ in histogram}:
        n = np.array([histogram.get((name, b), 0) for b in range(BINS)], float)
        above = n[::-1].cumsum()[::-1]
        random = min(above[0], 2 * n[BINS // 2 :].sum())
        for b in range(BINS):
            if above[b] and 1 - random * (1 - b / BINS) / above[b] <= rate:
                out[name] = b / BINS
                break
    return out


# ------------------------------------------------------------------- operator


def _screen(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents in which anything could be found."""
    some = sums((data == 58) | (data == 61), offs) > 0
    s, e, begins = spans(_TOKEN[data], offs)
    digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_DIGIT[data], out=digits[1:])
    long = (e - s >= LEAST) & (digits[e] > digits[s])
    some |= sums(long, begins) > 0
    hs, he, hbegins = spans(_HEXES[data], offs)
    some |= sums(he - hs >= 24, hbegins) > 0
    if len(data) > 3:
        key = np.flatnonzero((data[:-3] == 65) & (data[1:-2] == 75) & (data[2:-1] == 73) & (data[3:] == 65))
        some[np.searchsorted(offs, key, "right") - 1] = True
    return np.flatnonzero(some)


def learn_thresholds(docs: DataFrame, rate: float = 0.1) -> dict[str, float]:
    """``docs``: text. Counts the candidates of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for _, data, offs in slices(batch):
                for i in _screen(data, offs).tolist():
                    for _, _, name, p in candidates(data[offs[i] : offs[i + 1]].tobytes().decode()):
                        found[name, min(int(p * BINS), BINS - 1)] += 1
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], ["name", "bin", "n"])

    rows = docs.mapInArrow(count, "name string, bin int, n long").groupBy("name", "bin").agg(F.sum("n").alias("n")).collect()
    return thresholds({(r["name"], r["bin"]): r["n"] for r in rows}, rate)


def all_spans(text: str, limits: dict[str, float]) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and those with what the battery adds."""
    base = base_spans(text)
    more = [(a, b, 3) for a, b, name, p in candidates(text) if p >= limits.get(name, 2.0) and not any(x < b and a < y for x, y, _ in base)]
    more = [s for s in more if not any(x <= s[0] and s[1] <= y and (x, y) != s[:2] for x, y, _ in more)]
    return base, sorted(base + more, key=lambda s: (s[0], s[2]))


def _written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def find_secrets(docs: DataFrame, rate: float = 0.1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of the patterns' findings, their
    digest, and all spans as ``kind:start:end`` in code points."""
    source = pick(docs, doc_id=doc_id, text=text)
    limits = learn_thresholds(source.select("text"), rate)
    kind = source.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in slices(batch):
                counts = np.zeros((3, rows.num_rows), np.int64)
                digest, listed = [_EMPTY] * rows.num_rows, [""] * rows.num_rows
                for i in _screen(data, offs).tolist():
                    base, every = all_spans(data[offs[i] : offs[i + 1]].tobytes().decode(), limits)
                    for s in base:
                        counts[s[2], i] += 1
                    digest[i], listed[i] = hashlib.sha256(_written(base).encode()).hexdigest(), _written(every)
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c) for c in counts), pa.array(digest), pa.array(listed)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return source.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, rate: float = 0.1, mark: str = "[SECRET]", text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and, where there is such a
    column, the length in code points set anew for the texts that changed. Of
    several columns of one name the first counts."""
    limits = learn_thresholds(pick(docs, text=text), rate)
    names = docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in slices(batch, f"_{at}"):
                new, size = rows.column(at).to_pylist(), None
                if length in names:
                    size = rows.column(names.index(length)).to_pylist()
                for i in _screen(data, offs).tolist():
                    t, out, done = new[i], [], 0
                    for a, b, _ in all_spans(t, limits)[1]:
                        if b > done:
                            if a >= done:
                                out += [t[done:a], mark]
                            done = b
                    if done:
                        new[i] = "".join(out) + t[done:]
                        if size:
                            size[i] = len(new[i])
                cols = list(rows.columns)
                cols[at] = pa.array(new, rows.column(at).type)
                if size:
                    cols[names.index(length)] = pa.array(size, rows.column(names.index(length)).type)
                yield pa.RecordBatch.from_arrays(cols, schema=rows.schema)

    return flat.mapInArrow(run, flat.schema).toDF(*names)


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
