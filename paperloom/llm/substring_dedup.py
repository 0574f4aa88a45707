"""Removal of passages that occur more than once anywhere in the corpus.

A window is ``window`` consecutive words of one document. Every word covered
by a window whose word sequence also starts somewhere else is removed.

Method
------
1. Documents are packed into compressed chunks, written once in buckets by their
   chunk; each row keeps its place in its chunk, so no later step depends on
   document ids, and what later steps learn goes to the chunks, which stay where
   they are.
2. Every window has an *anchor*: among its ``gram``-word runs, the leftmost of
   least hash. Equal windows have equal anchors at equal places, so a window
   is no more frequent than its anchor. Each chunk sends a sketch of its
   anchors (saturating at two) to the shards of the hash space; a shard merges
   the partition sketches into a count-min sketch of several rows and answers
   each chunk with a bitmap of its anchors estimated at two or more. The
   estimate never falls below the count, so no repeated window is lost, and
   sketch, shards and answers all grow in proportion to the text.
3. Consecutive windows with one anchor form a *block*. Only blocks with an
   anchor estimated as repeated are grouped exactly, by 128 bits of hash: all
   windows of a block that occurs twice are repeated. Where an anchor has
   several different blocks, one copy of each block lists its windows and these
   are grouped exactly too.

Counts are combined inside each chunk before a shuffle, so a passage in a third
of all documents is one row per chunk, and nothing is ever expanded to pairs.
Anchors that many different blocks share are dealt with salt.
Memory per task follows a chunk (``chunk_bytes``, or one longer document).

Edge cases: a null text has no words; documents of fewer words than a window
stay whole; repeated rows are copies of each other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, discard, doc_of, materialize, materialize_bucketed, mix, pick, slices, text_bytes, text_column, word_hashes, words

WINDOW, GRAM = 35, 8
CHUNK_BYTES = 3 << 20
SHARD_ANCHORS = 1 << 18
#: Parts into which the blocks of one anchor are dealt.
SALTS = 8
#: Rows and counters per row of the count-min sketch of one shard.
SKETCH_ROWS, SKETCH_BITS = 4, 20
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)
_PLACE = np.uint64((1 << 30) - 1)  # a text has under 2^31 bytes, so fewer words than this
_GRAMS, _BLOCKS, _WINDOWS = Rolling(0xD6E8FEB86659FD93), Rolling(0xA0761D6478BD642F), Rolling(0xE7037ED1A0B428DB)


# ------------------------------------------------------------ chunks of text


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(3)
    for batch in batches:
        for rows, data, offs in slices(batch, limit=CHUNK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            n_words = len(words(data, offs)[0])
            blob = squeeze.compress(sink.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), pa.array([n_words]), pa.array([blob], pa.binary())], ["chunk", "n_words", "blob"])
            k += 1


def _unpack(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_next_batch()


class _Blocks:
    """Words and blocks of a chunk."""

    def __init__(self, rows: pa.RecordBatch, window: int, gram: int) -> None:
        self.data, offs = text_bytes(text_column(rows))
        self.s, self.e, self.begins = words(self.data, offs)
        h = word_hashes(self.data, self.s, self.e)
        n = max(0, len(h) - window + 1)
        g = _GRAMS.grams(_GRAMS.prefix(h), gram)
        low = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
        width, have = window - gram + 1, 1
        while have < width:  # minimum over `have` places, doubled
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        place = (low[:n] & _PLACE).astype(np.int64)
        last = np.repeat(self.begins[1:], np.diff(self.begins))  # end of each word's document
        valid = np.arange(n) + window <= last[:n]
        new = np.ones(n, dtype=bool)
        new[1:] = (place[1:] != place[:-1]) | ~valid[:-1]
        start = np.flatnonzero(valid & new)
        self.first = start
        group = np.cumsum(valid & new)[valid] - 1
        self.count = np.bincount(group, minlength=len(start)).astype(np.int64)
        self.anchor = g[place[start]]
        p = _BLOCKS.prefix(h)
        self.content = _BLOCKS.ranges(p, start, start + self.count - 1 + window) + self.count.astype(np.uint64)
        self.hashes, self.window = h, window

    def window_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the blocks ``which``: index into it, place in the block, hash of each window."""
        n = self.count[which]
        of = np.repeat(np.arange(len(which)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        s = self.first[which][of] + place
        return of, place, _WINDOWS.ranges(_WINDOWS.prefix(self.hashes), s, s + self.window)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _key(anchor: np.ndarray, content: np.ndarray) -> np.ndarray:
    return mix(anchor ^ (content * np.uint64(0x9FB21C651E98DF25)))


def _shards(anchor: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Shards of sorted anchors (their leading bits), in order, and the number of
    anchors in each; only shards that occur, so the work follows the anchors."""
    shard = (anchor >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(anchor), np.int64)
    kept, n = np.unique(shard, return_counts=True)
    return kept.tolist(), n.tolist()


def _distinct(anchor: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place and the number of each distinct pair."""
    order = np.lexsort((content, anchor))
    a, c = anchor[order], content[order]
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])]) if len(a) else np.zeros(0, np.int64)
    return order[cut], np.diff(np.r_[cut, len(a)])


def _numbers(column: pa.Array, row: int, field: str, kind=np.uint64) -> np.ndarray:
    """A field of a row's array of structs."""
    value = column[row].values
    if value is None or not len(value):
        return np.zeros(0, kind)
    x = value.field(field).to_numpy(zero_copy_only=False)
    return x.view(kind) if kind == np.uint64 else x


# ------------------------------------------------------------------- operator


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (of the
    kept words joined by one space) and, ``with_text``, kept_text."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    source = pick(docs, doc_id=doc_id, text=text)
    chunks = materialize_bucketed(source.mapInArrow(_pack, "chunk long, n_words long, blob binary"), "chunks", "chunk")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    shard_bits = max(0, int(2 * total / (window - gram + 2) / SHARD_ANCHORS).bit_length())

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = _Blocks(_unpack(blob.as_py()), window, gram)
                anchor, n = np.unique(b.anchor, return_counts=True)
                kept, size = _shards(anchor, shard_bits)
                cuts = np.r_[0, np.cumsum(size, dtype=np.int64)].tolist()
                parts = list(zip(cuts[:-1], cuts[1:], strict=True))
                low, twice = anchor.astype(np.uint32), n > 1
                if kept:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(kept, pa.int32()),
                            pa.array([chunk] * len(kept), pa.int64()),
                            pa.array([low[x:y].tobytes() for x, y in parts], pa.binary()),
                            pa.array([np.packbits(twice[x:y]).tobytes() for x, y in parts], pa.binary()),
                        ],
                        ["shard", "chunk", "cells", "twice"],
                    )

    def merge(shard: pa.Table) -> pa.Table:
        cells = [np.frombuffer(x.as_py(), np.uint32) for x in shard.column("cells")]
        twice = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(c)) for x, c in zip(shard.column("twice"), cells, strict=True)]
        place = lambda c, r: (c * np.uint32(_ODD[r])) >> np.uint32(32 - SKETCH_BITS)
        merged = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
        for c, t in zip(cells, twice, strict=True):
            for r in range(SKETCH_ROWS):
                np.add.at(merged[r], place(c, r), 1 + t.astype(np.int64))
        hot = [np.packbits(np.min([merged[r][place(c, r)] for r in range(SKETCH_ROWS)], axis=0) > 1).tobytes() for c in cells]
        return pa.table({"chunk": shard.column("chunk"), "shard": shard.column("shard"), "hot": pa.array(hot, pa.binary())})

    partial = chunks.select("chunk", "blob").mapInArrow(sketch, "shard int, chunk long, cells binary, twice binary")
    answers = partial.groupBy("shard").applyInArrow(merge, "chunk long, shard int, hot binary")
    answers = materialize(answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("shard", "hot"))).alias("hot")), "answers")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Blocks(_unpack(batch.column(1)[i].as_py()), window, gram)
                anchor = np.unique(b.anchor)
                size = dict(zip(*_shards(anchor, shard_bits), strict=True))
                bits = [np.unpackbits(np.frombuffer(x["hot"], np.uint8), count=size[x["shard"]]) for x in batch.column(2)[i].as_py()]
                hot = anchor[np.concatenate(bits).astype(bool)] if bits else anchor[:0]
                keep = np.flatnonzero(np.isin(b.anchor, hot))
                at, n = _distinct(b.anchor[keep], b.content[keep])
                keep = keep[at]
                yield pa.RecordBatch.from_arrays([_signed(b.anchor[keep]), _signed(b.content[keep]), pa.array(np.full(len(keep), batch.column(0)[i].as_py(), np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["anchor", "content", "chunk", "n"])

    blocks = materialize(chunks.select("chunk", "blob").join(answers.hint("shuffle_hash"), "chunk").mapInArrow(exact, "anchor long, content long, chunk long, n int"), "blocks")
    discard(answers)
    groups = materialize(blocks.groupBy("anchor", "content").agg(F.sum("n").alias("n"), F.min("chunk").alias("chunk")), "groups")
    whole = blocks.join(groups.where("n > 1").select("anchor", "content"), ["anchor", "content"]).select("chunk", "anchor", "content", F.lit(-1).alias("mask"))
    several = groups.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.col("content"), F.lit(SALTS)).cast("int")
    several = groups.withColumn("salt", salt).join(several, ["anchor", "salt"]).select("chunk", "anchor", "content", (F.col("n") > 1).alias("whole"))
    listed = several.groupBy("chunk").agg(F.collect_list(F.struct("anchor", "content", "whole")).alias("listed"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _Blocks(_unpack(batch.column(1)[i].as_py()), window, gram)
                own, at = np.unique(_key(b.anchor, b.content), return_index=True)
                col = batch.column(2)
                want = np.searchsorted(own, _key(_numbers(col, i, "anchor"), _numbers(col, i, "content")))
                which = at[want]
                of, place, h = b.window_hashes(which)
                done = _numbers(col, i, "whole", bool)[of]
                yield pa.RecordBatch.from_arrays(
                    [_signed(b.anchor[which][of]), _signed(h), pa.array(done), pa.array(np.full(len(of), batch.column(0)[i].as_py(), np.int64)), _signed(b.content[which][of]), pa.array(place.astype(np.int32))],
                    ["anchor", "hash", "whole", "chunk", "content", "place"],
                )

    rows = materialize(chunks.select("chunk", "blob").join(listed.hint("shuffle_hash"), "chunk").mapInArrow(expand, "anchor long, hash long, whole boolean, chunk long, content long, place int"), "windows")
    again = rows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("k"), F.max("whole").alias("any")).where("k > 1 or any").select("anchor", "hash")
    bit = F.expr("shiftleft(1L, place)") if window - gram < 62 else None
    if bit is None:
        raise ValueError("window - gram must be under 62")
    parts = rows.where(~F.col("whole")).join(again, ["anchor", "hash"]).groupBy("chunk", "anchor", "content").agg(F.bit_or(bit).alias("mask"))
    removed = whole.withColumn("mask", F.col("mask").cast("long")).unionByName(parts).groupBy("chunk").agg(F.collect_list(F.struct("anchor", "content", "mask")).alias("removed"))
    removed = materialize(removed, "removed")
    discard(blocks, groups, rows)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                docs_in = _unpack(batch.column(1)[i].as_py())
                b = _Blocks(docs_in, window, gram)
                n_words = np.diff(b.begins)
                gone = np.zeros(len(b.s) + 1, np.int64)
                col = batch.column(2)
                anchor, content = _numbers(col, i, "anchor"), _numbers(col, i, "content")
                key = _key(anchor, content)
                if len(key):
                    order = np.argsort(key)
                    key, mask = key[order], _numbers(col, i, "mask", np.int64)[order]
                    own = _key(b.anchor, b.content)
                    at = np.minimum(np.searchsorted(key, own), len(key) - 1)
                    found = (anchor[order][at] == b.anchor) & (content[order][at] == b.content)
                    for full in (True, False):
                        hit = np.flatnonzero(found & ((mask[at] == -1) == full))
                        if full:
                            s, e = b.first[hit], b.first[hit] + b.count[hit] - 1 + window
                        else:
                            set_ = (mask[at[hit]][:, None] >> np.arange(window - gram + 1)) & 1
                            which, place = np.nonzero(set_)
                            s = b.first[hit][which] + place
                            e = s + window
                        np.add.at(gone, s, 1)
                        np.add.at(gone, e, -1)
                kept = np.cumsum(gone)[:-1] == 0
                sent = _join(b.data, b.s, b.e, b.begins, kept)
                n_kept = np.bincount(doc_of(b.begins)[kept], minlength=len(n_words))
                out = [docs_in.column(0), pa.array(n_words), pa.array(n_words - n_kept), pa.array([hashlib.sha256(x).hexdigest() for x in sent])]
                yield pa.RecordBatch.from_arrays(out + [pa.array(sent, pa.binary()).cast(pa.string())] * with_text, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return chunks.select("chunk", "blob").join(removed.hint("shuffle_hash"), "chunk", "left").mapInArrow(cut, schema)


def _join(data: np.ndarray, s: np.ndarray, e: np.ndarray, begins: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """Kept words of each document joined by one space."""
    ks, ke = s[kept], e[kept]
    size = ke - ks + 1
    to = np.cumsum(size)
    at = np.arange(to[-1] if len(to) else 0) + np.repeat(ks - (to - size), size)
    buf = np.concatenate([data, np.zeros(1, np.uint8)])[at]
    buf[to - 1] = 32
    flat = buf.tobytes()
    cum = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(kept, out=cum[1:])
    edge = np.concatenate([np.zeros(1, np.int64), to])[cum[begins]]
    return [flat[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, i, hash(array_to_string(ws[i : i + 34], ' ')) AS h, sha256(array_to_string(ws[i : i + 34], ' ')) AS win
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
d AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT r, i + k AS j FROM p JOIN d USING (win), (SELECT unnest(range(0, 35)) AS k)),
l AS (SELECT r, list(j) AS js FROM c GROUP BY r),
k AS (SELECT w.r, doc_id, ws, CASE WHEN js IS NULL THEN ws ELSE list_filter(list_transform(range(1, len(ws) + 1), lambda j: CASE WHEN list_contains(js, j) THEN NULL ELSE ws[j] END), lambda x: x IS NOT NULL) END AS kept
      FROM w LEFT JOIN l ON w.r = l.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
