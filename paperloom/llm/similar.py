"""Near-duplicates by SimHash tries, decided by exact similarity of shingle sets.

Documents are linked when their sets of ``shingle``-word shingles have a Jaccard
similarity of ``similarity`` or more; documents reachable over links form a group,
of which one stays. The SimHash operator's trie self-join runs twice:

1. Each distinct document has a 64-bit SimHash fingerprint of its shingle set and
   is dealt to tasks by ``KEYS`` keys of ``ROWS`` minimum hashes each (two
   documents of similarity 0.8 share none with a probability of 0.0008). Within a
   task, tries find fingerprints within a budget of bits that a similarity of 0.8
   exceeds about once in 100,000 times. One edge per document leaves a task; what
   these edges connect is a *family*.
2. The texts of a family come to one task, once each. There the trie self-join
   decides every pair of leaves within the budget on the shingle sets themselves
   (64-bit hashes), unless the two are in one component already, nearest first.

So no pair of documents is ever a row. A key that more than ``most`` documents
share makes one family of them without a first join; a family of more than
``most_bytes`` of text is cut into blocks of that size, and each pair of blocks is
a task: no pair is lost, a task stays bounded, and the text such a family sends
grows with the number of its blocks.

Edge cases: documents of the same words are copies of each other, and are
collapsed before anything is dealt; null and empty texts have an empty set and are
copies of each other; fewer words than ``shingle`` are one shingle; an empty table
gives an empty result; of each group the row of least doc_id stays, a null id only
where there is no other; of equal doc_ids the first row counts; other columns are
kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import LOWER, discard, materialize, materialize_bucketed, mix, slices, text_bytes, word_hashes, words
from .components import components
from .simhash import majority
from .trie import TrieJoin

SHINGLE, SIMILARITY, KEYS, ROWS = 5, 0.8, 10, 3
#: Standard deviations of the bits that differ which the budget allows for.
SIGMAS = 4.5
#: Further fingerprints that a task looks at before it compares two sets.
WIDE = 3
MOST, MOST_BYTES = 1 << 17, 8 << 20
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, KEYS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bit_budget(similarity: float, bits: int = 64) -> int:
    """Bits in which fingerprints of that similarity differ, with a margin."""
    p = acos(2 * similarity / (1 + similarity)) / pi
    return min(bits, ceil(bits * p + SIGMAS * sqrt(bits * p * (1 - p))))


def shingle_hashes(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each shingle, and the index of each document's first (n + 1 values)."""
    data = LOWER[data]
    s, e, begins = words(data, offs)
    w = word_hashes(data, s, e)
    n_words = np.diff(begins)
    n = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = np.zeros(len(offs), np.int64)
    np.cumsum(n, out=first[1:])
    doc = np.repeat(np.arange(len(n)), n)
    start = begins[doc] + np.arange(first[-1]) - first[doc]
    h = np.zeros(len(doc), np.uint64)
    for j in range(shingle):
        there = j < n_words[doc]
        h = np.where(there, mix(h ^ w[np.where(there, start + j, 0)]), h)
    return h, first


def shingle_sets(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, sorted."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    h = h[np.lexsort((h, doc))]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    begins = np.zeros(len(first), np.int64)
    np.cumsum(np.bincount(doc[new], minlength=len(first) - 1), out=begins[1:])
    return h[new], begins


def deal_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """KEYS keys of each document with shingles (one row each)."""
    some = np.flatnonzero(np.diff(first))
    keys = np.zeros((len(some), KEYS), np.uint64)
    for k, factor in enumerate(_FACTORS if len(some) else ()):
        least = mix(np.minimum.reduceat(h * factor, first[some]))
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] ^ least ^ np.uint64(k + 1))
    return keys


def with_signature(source: DataFrame, text: str, shingle: int) -> DataFrame:
    """All columns, ``same`` (128 bits of the words), ``size`` (bytes of text),
    ``fp`` and ``keys``."""
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in slices(batch, text):
                h, first = shingle_hashes(data, offs, shingle)
                same = [xxhash.xxh3_128_digest(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                sets, begins = shingle_sets(h, first)
                at = np.zeros(len(first), np.int32)
                np.cumsum(KEYS * (np.diff(first) > 0), out=at[1:])  # no keys without shingles
                keys = pa.ListArray.from_arrays(pa.array(at), pa.array(deal_keys(sets, begins).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(same, pa.binary()), pa.array(np.diff(offs)), pa.array(majority(sets, begins).view(np.int64)), keys], [*names, "same", "size", "fp", "keys"])

    more = [StructField("same", BinaryType()), StructField("size", LongType()), StructField("fp", LongType()), StructField("keys", ArrayType(LongType()))]
    return source.mapInArrow(run, StructType([*source.schema.fields, *more]))


def _runs(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one value."""
    edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)
    return edge[:-1], edge[1:]


def _edges(group: np.ndarray, fp: np.ndarray, node: np.ndarray, budget: int, accept=None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (nodes) that connect, in each group, what the trie self-join links.
    Equal fingerprints share a leaf; without ``accept`` they are linked."""
    order = np.lexsort((node, fp, group))
    group, fp, node = group[order], fp[order], node[order]
    head = np.ones(len(fp), dtype=bool)
    if accept is None:
        head[1:] = (group[1:] != group[:-1]) | (fp[1:] != fp[:-1])
    leaf = np.flatnonzero(head)
    s, e = _runs(group[leaf])
    comp = TrieJoin(fp[leaf], budget, s, e, accept).join()
    far = np.flatnonzero(comp != np.arange(len(leaf)))
    copies = np.flatnonzero(~head)
    a = np.concatenate([node[leaf[far]], node[copies]])
    b = np.concatenate([node[leaf[comp[far]]], node[leaf[np.searchsorted(leaf, copies) - 1]]])
    return a, b


def _batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def family_edges(dealt: DataFrame, budget: int, most: int) -> DataFrame:
    """Edges (a, b) that connect families. ``dealt``: node, fp, key."""
    counts = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a")).where("n > 1")
    counts = materialize(counts, "keys")
    shared = materialize(dealt.join(counts, "key").select("key", "n", "a", "fp", "node"), "dealt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            key, fp, node = (np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, r in enumerate(rest))
            if not len(key):
                continue
            n = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0  # the last key may go on
            yield _batch(*_edges(key[:n], fp[:n].view(np.uint64), node[:n], budget))
            rest = [key[n:], fp[n:], node[n:]]
        yield _batch(*_edges(rest[0], rest[1].view(np.uint64), rest[2], budget))

    joined = shared.where(F.col("n") <= most).select("key", "fp", "node").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    found = materialize(joined.unionByName(shared.where(F.col("n") > most).select("a", F.col("node").alias("b"))), "edges")
    discard(counts, shared)
    return found


class _Sets:
    """Decides links of documents by their shingle sets."""

    def __init__(self, sets: np.ndarray, begins: np.ndarray, similarity: float) -> None:
        values, self.ids = np.unique(sets, return_inverse=True)
        self.begins, self.size, self.similarity = begins, np.diff(begins), similarity
        self.mark = np.zeros(len(values), dtype=bool)
        self.wide = np.stack([majority(mix(sets ^ np.uint64(k)), begins) for k in range(1, WIDE + 1)])
        self.wide_budget = bit_budget(similarity, 64 * WIDE)

    def likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """By size, and for sets that are not small by further fingerprints."""
        n, m = self.size[i], self.size[j]
        least = np.minimum(n, m)
        out = least >= self.similarity * np.maximum(n, m)
        errors = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in self.wide)
        return out & ((least < 64) | (errors <= self.wide_budget))

    def accept(self, i: int, js: np.ndarray) -> np.ndarray:
        n, k = self.size[i], self.size[js]  # no set is empty: such documents have no keys
        own = self.ids[self.begins[i] : self.begins[i + 1]]
        self.mark[own] = True
        ends = k.cumsum()
        at = np.arange(ends[-1]) + (self.begins[js] - (ends - k)).repeat(k)
        both = np.add.reduceat(self.mark[self.ids[at]], ends - k, dtype=np.int64)
        self.mark[own] = False
        return both >= self.similarity * (n + k - both)


def _decide(task: np.ndarray, fp: np.ndarray, node: np.ndarray, texts: pa.Array, budget: int, similarity: float, shingle: int) -> pa.RecordBatch:
    order = np.lexsort((node, fp, task))  # as in _edges, so that places there are places here
    task, fp, node = task[order], fp[order], node[order]
    sets = _Sets(*shingle_sets(*shingle_hashes(*text_bytes(texts.take(pa.array(order))), shingle)), similarity)
    return _batch(*_edges(task, fp, node, budget, sets))


def similar_edges(members: DataFrame, similarity: float, budget: int, shingle: int, most_bytes: int) -> DataFrame:
    """Edges between documents of one family whose similarity is reached and that
    connect all such. ``members``: root, i, j (the task), node, fp, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = (pa.concat_tables([rest, t]) if rest else t).combine_chunks()
            yield from decide(t, False)
            task = number(t)
            rest = t.slice(int(np.flatnonzero(task != task[-1])[-1]) + 1 if (task != task[-1]).any() else 0)
        if rest is not None:
            yield from decide(rest.combine_chunks(), True)

    def number(t: pa.Table) -> np.ndarray:
        keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("root", "i", "j")])
        return np.r_[0, np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))]

    def decide(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        task = number(t)
        s, e = _runs(task)
        if not last:
            s, e = s[:-1], e[:-1]
        fp, node = t.column("fp").to_numpy().view(np.uint64), t.column("node").to_numpy()
        texts = t.column("text").combine_chunks() if isinstance(t.column("text"), pa.ChunkedArray) else t.column("text")
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        texts = texts.fill_null("")
        size = np.r_[0, np.cumsum(np.diff(text_bytes(texts)[1]))]
        at = 0
        while at < len(s):  # tasks of about most_bytes together, or one of more
            to = max(at + 1, int(np.searchsorted(size[e], size[s[at]] + most_bytes, "right")))
            x, y = int(s[at]), int(e[to - 1])
            yield _decide(task[x:y], fp[x:y], node[x:y], texts.slice(x, y - x), budget, similarity, shingle)
            at = to

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer: work per byte is uneven
    groups = members.select("root", "i", "j", "node", "fp", "text").repartition(n, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return groups.mapInArrow(run, "a long, b long")


def keep_dissimilar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each group one
    row stays. Rows are written once with a number each, in buckets by it, and read
    from there: numbers given anew at each read would change with the executors
    there are, and texts stay where they are when rows are chosen."""
    budget = bit_budget(similarity)
    names = docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id())
    doc_id, text = (f"_{names.index(n)}" for n in ("doc_id", "text"))
    rows = materialize_bucketed(with_signature(flat, text, shingle), "similar", "row")
    best = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), "row")
    firsts = rows.groupBy("same").agg(F.min("row").alias("node"), F.min(best).alias("best"), F.first("fp").alias("fp"), F.max("size").alias("size"), F.first("keys").alias("keys"))
    firsts = materialize(firsts, "firsts")
    coarse = family_edges(firsts.select("node", "fp", F.explode("keys").alias("key")), budget, most)
    families = components(coarse)
    families = families.unionByName(families.select(F.col("root").alias("node"), "root").distinct())
    families = materialize(families.join(firsts.select("node", "fp", "size"), "node"), "families")
    blocks = families.groupBy("root").agg(F.ceil(F.greatest(F.sum("size"), F.lit(1)) / F.lit(most_bytes)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = families.join(blocks, "root").withColumn("own", own).select("root", "node", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("node").alias("row"), "fp")
    members = rows.select("row", F.col(text).alias("text")).join(placed.hint("shuffle_hash"), "row").withColumnRenamed("row", "node")
    links = components(similar_edges(members, similarity, budget, shingle, most_bytes))
    group = F.coalesce("root", "node")
    chosen = firsts.select("node", "best").join(links, "node", "left").groupBy(group.alias("group")).agg(F.min("best").alias("best"))
    chosen = materialize(chosen.select("best.row"), "chosen")
    return rows.join(chosen.hint("shuffle_hash"), "row", "left_semi").select(*[f"_{i}" for i in range(len(names))]).toDF(*names)
