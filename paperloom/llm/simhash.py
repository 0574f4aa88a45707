"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
3-word shingles. Fingerprints that differ in at most three bits are linked, and
documents reachable over links form a group.

The 64 bits are cut into one block more than the budget; two linked fingerprints
agree in at least one block, so each distinct fingerprint is dealt to a task by
each block. Fingerprints of one bucket form a binary trie (``trie.py``), which is
joined with itself: pairs of nodes are traversed together, the bits in which
their prefixes differ are accumulated, and a pair is dropped once they exceed the
budget, or when both nodes already lie wholly in one component. Each trie yields
at most one edge per fingerprint (to its component), never all pairs.

A bucket of more than ``most`` fingerprints is dealt again: first by pairs of
five blocks (of which one pair must agree in full), then by the remaining bits
(cut into one part more than the budget, of which one must agree), until none is
left. After four such rounds at most 14 bits are free, which have 16,384 values,
so what a task holds is bounded by the bits, not by the data.

Copies share a fingerprint and are collapsed before anything is dealt, so a
group of copies is one row. Components of the edges are found by alternating
large-star and small-star steps on tables in the shared folder.

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; fewer than three words are one shingle; repeated rows are copies; a null
doc_id is never a component's id unless the component has no other (then null);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, materialize, pick, slices, words
from .components import components
from .trie import TrieJoin

SHINGLE, SEED, BUDGET = 3, 42, 3
_CUTS = (0, 13, 26, 39, 52, 64)
#: Fingerprints that one task takes together; a bucket of more is dealt again.
MOST = 1 << 17


def _blocks(budget: int) -> list[int]:
    """One block of bits more than the budget: two values within it agree in one."""
    cuts = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _masks(budget: int) -> list[int]:
    """Bits of each choice of blocks of which one must agree in full."""
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_CUTS[:-1], _CUTS[1:], strict=True)]
    if not 0 <= budget <= 4:
        raise ValueError("budget must be 0 to 4")
    return [sum(c) for c in combinations(blocks, len(blocks) - max(budget, 3))]


# --------------------------------------------------------------- fingerprints


def fingerprints(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    data = LOWER[data]
    s, e, begins = words(data, offs)
    n_docs = len(offs) - 1
    size = e - s + 1  # with one space after each word
    to = np.cumsum(size)
    at = np.arange(to[-1] if len(to) else 0) + np.repeat(s - (to - size), size)
    flat = np.concatenate([data, np.zeros(1, np.uint8)])[at]
    flat[to - 1] = 32
    flat = flat.tobytes()
    n_words = np.diff(begins)
    n_sh = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    first = np.zeros(n_docs + 1, np.int64)
    np.cumsum(n_sh, out=first[1:])
    doc = np.repeat(np.arange(n_docs), n_sh)
    start = begins[doc] + np.arange(first[-1]) - first[doc]
    last = np.minimum(start + shingle, begins[doc + 1]) - 1
    a, b = (to - size)[start].tolist(), (to[last] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
    return majority(h, first)


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document (values ``first[i]`` to ``first[i + 1]`` of ``h``) the bits
    set in over half of its values. Eight counters of a byte share a 64-bit word,
    over at most 255 values at a time."""
    n = np.diff(first)
    out = np.zeros((len(n), 64), dtype=bool)
    some = np.flatnonzero(n)
    if len(some):
        pieces = -(-n[some] // 255)
        at = np.zeros(len(some) + 1, np.int64)
        np.cumsum(pieces, out=at[1:])
        starts = np.repeat(first[some], pieces) + 255 * (np.arange(at[-1]) - np.repeat(at[:-1], pieces))
        for k in range(8):
            lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
            count = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), at[:-1], axis=0)
            out[some, k::8] = 2 * count > n[some, None]
    return np.packbits(out, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def with_fingerprint(source: DataFrame, text: str = "text", shingle: int = SHINGLE, with_text: bool = False) -> DataFrame:
    """All columns, the text only ``with_text``, and ``fp``. ``source`` has plain column names."""
    rest = [f for f in source.schema.fields if with_text or f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in slices(batch, text):
                fp = pa.array(fingerprints(data, offs, shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(f.name)) for f in rest), fp], [*(f.name for f in rest), "fp"])

    return source.mapInArrow(run, StructType([*rest, StructField("fp", LongType())]))


# ------------------------------------------------------------------ trie join


class _Trie(TrieJoin):
    """The join of one trie."""


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _parts(mask: int, n: int) -> list[int]:
    """``mask`` with each of ``n`` parts of the bits it lacks."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[i::n]) for i in range(n)]


def trie_edges(distinct: DataFrame, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within the budget.
    ``distinct``: fp, each value once, in a table that is cheap to read again."""
    if most < 1 << (budget + 1):
        raise ValueError("most must be at least 2 to the power of budget + 1")
    masks, level = _blocks(budget), 0
    dealt = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    dealt, edges = dealt.withColumn("k", F.col("fp").bitwiseAND(F.col("mask"))), None
    while True:
        crowded = dealt.groupBy("mask", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("mask", "k")
        crowded = materialize(crowded, "crowded")
        if crowded.isEmpty():
            found = _bucket_edges(dealt, budget)
            return found if edges is None else edges.unionByName(found)
        found = materialize(_bucket_edges(dealt.join(crowded, ["mask", "k"], "left_anti"), budget), "edges")
        edges = found if edges is None else edges.unionByName(found)
        # At most 10 * 4^4 masks for a budget of three: after four more rounds no bucket can be crowded.
        finer = {m: _parts(m, budget + 1) if level else _masks(budget) for m in masks}
        level += 1
        table = distinct.sparkSession.createDataFrame([(_signed(m), _signed(p)) for m, ps in finer.items() for p in ps], "mask long, part long")
        again = dealt.join(crowded, ["mask", "k"], "left_semi").join(F.broadcast(table), "mask").select("fp", F.col("part").alias("mask")).distinct()
        dealt = materialize(again.withColumn("k", F.col("fp").bitwiseAND(F.col("mask"))), "dealt")
        masks = sorted({p for ps in finer.values() for p in ps})


def _bucket_edges(dealt: DataFrame, budget: int) -> DataFrame:
    """Edges within the buckets (mask, k) of ``dealt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3

        def emit(t: np.ndarray, k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(t):
                return
            cut = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            size = np.diff(np.r_[cut, len(t)])
            values = fp.view(np.uint64)
            values = values[np.lexsort((values, np.repeat(np.arange(len(cut)), size)))]
            comp = TrieJoin(values, budget, cut, cut + size).join()
            at = np.flatnonzero(comp != np.arange(len(comp)))
            a, b = values[at], values[comp[at]]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            cols = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, r in enumerate(rest)]
            t, k, fp = cols
            if not len(t):
                continue
            same = (t == t[-1]) & (k == k[-1])  # the last group may go on in the next batch
            n = len(t) - int(same.sum())
            yield from emit(t[:n], k[:n], fp[:n])
            rest = [t[n:], k[n:], fp[n:]]
        yield from emit(*rest)

    groups = dealt.select("mask", "k", "fp").repartition("mask", "k").sortWithinPartitions("mask", "k")
    return groups.mapInArrow(run, "a long, b long")


def near_duplicates(fps: DataFrame, budget: int = BUDGET) -> DataFrame:
    """fp and component_id (the least id of its component) for each distinct
    fingerprint. ``fps``: id, fp."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("id").alias("first")), "fingerprints")
    roots = components(trie_edges(distinct.select("fp"), budget))
    joined = distinct.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return joined.select("fp", "root").join(least, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and component_id."""
    rows = materialize(with_fingerprint(pick(docs, doc_id=doc_id, text=text), shingle=shingle), "simhash")
    groups = near_duplicates(rows.select(F.col("doc_id").alias("id"), "fp"), budget)
    return rows.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each group
    the row of least doc_id stays (the first of several). Rows are written once
    with a number each and read from there: numbers given anew at each read would
    change with the executors there are."""
    names = docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id())
    doc_id, text = (f"_{names.index(n)}" for n in ("doc_id", "text"))
    rows = materialize(with_fingerprint(flat, text, shingle, with_text=True), "simhash")
    best = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), "row")
    # one row per fingerprint is enough to choose from: (none, id, row) orders them
    firsts = rows.groupBy("fp").agg(F.min(best).alias("best"))
    roots = components(trie_edges(firsts.select("fp"), budget))
    chosen = firsts.join(roots.withColumnsRenamed({"node": "fp"}), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best"))
    chosen = materialize(chosen.select("best.row"), "chosen")
    # A broadcast would hold where the list is small only; one way at every size.
    return rows.join(chosen.hint("merge"), "row", "left_semi").select(*[f"_{i}" for i in range(len(names))]).toDF(*names)


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
