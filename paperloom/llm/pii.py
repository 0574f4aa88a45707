"""Personal data: patterns, extended by a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers. A
document's *nodes* are its number-like runs, words with ``@``, and words equal to
the local part of an address found in it. Nodes are linked in a chain, and
distant nodes are linked by skip edges if they repeat each other: equal digits
whatever the separators, or equal local parts. Consecutive repeats are linked,
so edges grow with the nodes and not with their pairs. Node, chain and skip
potentials are learned by pseudo-likelihood from at most about ``sample_docs``
documents with nodes, with the patterns' findings as labels; features describe a
node's shape and the word before it, not whether the pattern's checks pass.
Loopy sum-product passes messages over chain and skip edges; nodes the patterns
found are observed, and other nodes whose posterior for a kind reaches
``least`` are added as spans of that kind.

Texts without a digit or ``@`` have no nodes and are screened out by bytes.
Edge cases: null is empty; empty texts have no spans; whole texts are read;
repeated rows are treated alike; an empty table gives an empty result; without
documents to learn from no spans are added; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, sums

KINDS = ("email", "ip", "card", "phone")
_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"[^\s@]+@[^\s@]+|\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_FEATURES = 1 << 12
_MARKED = np.zeros(256, dtype=bool)
_MARKED[[*range(48, 58), 64]] = True

Span = tuple[int, int, int]  # start, end, kind


# ------------------------------------------------------------------- patterns


def _emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses. The part before an ``@`` is the run of
    its characters up to it, so each is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _AT.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end(), 0
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size, 1
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    found = list(_emails(text)) + list(_ips(text))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


# ---------------------------------------------------------------------- graph


@dataclass
class Graph:
    spans: list[tuple[int, int]]
    label: np.ndarray  # 0 none, else kind + 1: what the patterns found
    free: np.ndarray  # nodes the patterns say nothing of
    features: list[list[int]]
    edges: list[tuple[int, int, int]]  # i < j, 0 chain or 1 skip


def _feature(*parts) -> int:
    return zlib.crc32(repr(parts).encode()) % _FEATURES


def graph(text: str, base: list[Span]) -> Graph:
    locals_ = {text[a:b].partition("@")[0].lower() for a, b, k in base if k == 0}
    nodes = {m.span() for m in _NODE.finditer(text) if "@" in m[0] or len(_digits(m[0])) > 1}
    if locals_:
        for m in _WORD.finditer(text):
            a, b = m.start(), m.end()
            while a < b and text[a] in "([{\"'<":
                a += 1
            while a < b and text[b - 1] in ".,;:!?)]}\"'>":
                b -= 1
            if text[a:b].lower() in locals_ and len(text[a:b]) > 2:
                nodes.add((a, b))
    taken, spans = [(a, b) for a, b, _ in base], []
    k = 0
    for a, b in sorted(nodes):  # nodes that overlap a finding give way to it
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if not any(x < b and a < y for x, y in taken[k : k + 4]):
            spans.append((a, b))
    spans = sorted(set(spans) | set(taken))
    kind = {(a, b): c + 1 for a, b, c in reversed(base)}
    label = np.array([kind.get(s, 0) for s in spans], np.int64)
    features, last, edges = [], {}, []
    for i, (a, b) in enumerate(spans):
        s = text[a:b]
        d = _digits(s)
        shape = re.sub(r"[0-9]+", lambda m: str(min(len(m[0]), 6)), re.sub(r"[^0-9+()@. -]+", "w", s))
        before = text[max(0, a - 40) : a].split()
        features.append([_feature("shape", shape[:40]), _feature("digits", min(len(d), 20), "@" in s), _feature("plus", s[:1] == "+", len(d) > 9), _feature("word", before[-1].lower() if before else ""), _feature("all")] if d or "@" in s else [])
        if i:
            edges.append((i - 1, i, 0))
        keys = [("d", d)] if len(d) >= 7 and "@" not in s else [("l", s.partition("@")[0].lower())] if ("@" in s or not d or s.lower() in locals_) else []
        for key in keys:
            if key in last and (last[key], i, 0) not in edges[-1:]:
                edges.append((last[key], i, 1))
            elif key in last:
                edges[-1] = (last[key], i, 1)
            last[key] = i
    return Graph(spans, label, label == 0, features, edges)


# ---------------------------------------------------------------------- model


@dataclass
class SkipChainCRF:
    node: np.ndarray  # features x labels
    pair: np.ndarray  # chain or skip x labels x labels

    def posteriors(self, g: Graph, rounds: int = 8, damping: float = 0.5) -> np.ndarray:
        """Loopy sum-product; observed nodes keep their label."""
        k = self.node.shape[1]
        unary = np.array([self.node[f].sum(0) if f else np.zeros(k) for f in g.features])
        seen = np.flatnonzero(~g.free)
        unary[seen] = -50.0
        unary[seen, g.label[seen]] = 0.0
        if not g.edges:
            return _softmax(unary)
        i, j, t = np.array(g.edges).T
        src, dst = np.concatenate([i, j]), np.concatenate([j, i])
        pot = np.concatenate([self.pair[t], self.pair[t].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(i)) + len(i), np.arange(len(i))])
        msg = np.zeros((len(src), k))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            out = (belief[src] - msg[back])[:, :, None] + pot
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            msg = damping * msg + (1 - damping) * new
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        return _softmax(belief)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def fit_crf(graphs: list[tuple[list, list[int], list]], epochs: int = 6, rate: float = 0.2, seed: int = 2) -> SkipChainCRF:
    """Pseudo-likelihood by stochastic gradient steps, node by node. Words that
    only repeat an address's local part have no label and are not learned from."""
    k = len(KINDS) + 1
    crf = SkipChainCRF(np.zeros((_FEATURES, k)), np.stack([np.zeros((k, k)), 2.0 * np.eye(k)]))
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for at in rng.permutation(len(graphs)):
            features, label, edges = graphs[at]
            near: list[list[tuple[int, int, bool]]] = [[] for _ in features]
            for i, j, t in edges:
                if features[i] and features[j]:
                    near[i].append((j, t, True))
                    near[j].append((i, t, False))
            for i, f in enumerate(features):
                if not f:
                    continue
                z = crf.node[f].sum(0)
                for j, t, first in near[i]:
                    z = z + (crf.pair[t][:, label[j]] if first else crf.pair[t][label[j], :])
                slope = -_softmax(z)
                slope[label[i]] += 1
                np.add.at(crf.node, f, lr * slope)
                for j, t, first in near[i]:
                    if first:
                        crf.pair[t][:, label[j]] += 0.3 * lr * slope
                    else:
                        crf.pair[t][label[j], :] += 0.3 * lr * slope
    return crf


def added_spans(text: str, base: list[Span], crf: SkipChainCRF, least: float) -> list[Span]:
    g = graph(text, base)
    if not g.free.any():
        return []
    p = crf.posteriors(g)
    best = p[:, 1:].argmax(1)
    good = g.free & (p[np.arange(len(p)), best + 1] >= least)
    return [(*g.spans[i], int(best[i])) for i in np.flatnonzero(good)]


# ------------------------------------------------------------------- operator


def _with_nodes(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return sums(_MARKED[data], offs) > 0


def train_pii(docs: DataFrame, sample_docs: int = 2000, sample_spans: int = 2000) -> SkipChainCRF:
    """``docs``: text. Documents are sampled by a hash of their text, at a rate
    set by the number of documents with a digit or ``@``. Copies count once, so
    the driver gets about ``sample_docs`` of them however often a text occurs.
    Sampled documents of more than ``sample_spans`` nodes are not learned from
    (they are scanned like any other)."""
    marked = docs.where(F.col("text").rlike("[0-9@]"))
    n = marked.count()
    if not n:
        return fit_crf([])
    rate = int(min(1.0, sample_docs / n) * (1 << 20))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                g = graph(text, base_spans(text))
                if g.spans and len(g.spans) <= sample_spans:
                    out.append(json.dumps([g.features, g.label.tolist(), g.edges]))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["graph"])

    import json

    rows = marked.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < rate).mapInArrow(read, "graph string").distinct().collect()
    return fit_crf([json.loads(x) for x in sorted(r["graph"] for r in rows)])


def find_pii(docs: DataFrame, least: float = 0.9, sample_docs: int = 2000, sample_spans: int = 2000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of the patterns' findings, their
    digest, and all spans as ``kind:start:end`` in code points."""
    source = pick(docs, doc_id=doc_id, text=text)
    crf = train_pii(source.select("text"), sample_docs, sample_spans)
    kind = source.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in slices(batch):
                counts = np.zeros((len(KINDS), rows.num_rows), np.int64)
                digest, listed = [_EMPTY] * rows.num_rows, [""] * rows.num_rows
                for i in np.flatnonzero(_with_nodes(data, offs)).tolist():
                    t = data[offs[i] : offs[i + 1]].tobytes().decode()
                    base = base_spans(t)
                    for s in base:
                        counts[s[2], i] += 1
                    digest[i] = hashlib.sha256(_written(base).encode()).hexdigest()
                    listed[i] = _written(sorted(base + added_spans(t, base, crf, least), key=lambda s: (s[0], s[2])))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c) for c in counts), pa.array(digest), pa.array(listed)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return source.mapInArrow(scan, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


_EMPTY = hashlib.sha256(b"").hexdigest()


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
