"""Packing of tokenised documents into fixed-length sequences.

Documents are tokenised once: whole texts are cut into units that the
tokenizer's own splitting keeps apart, each distinct unit of a slice is encoded
once (and remembered, up to ``REMEMBER`` units a worker), and ids are put
together by numpy. A document longer than a sequence is cut into full pieces
and a rest. Pieces are dealt at random (by a hash of the row's place) to groups
of about ``group_pieces`` pieces; each group is packed on its own by first-fit
decreasing, where a tournament tree over the bins' free space finds the first
bin that fits in logarithmic time. Rows are told apart by place, so copies and
repeated ids are packed like any other document.

Edge cases: a null or empty text is the single end id; a text with an added
token of the tokenizer written out in it is encoded whole; an empty table gives an
empty result; other columns are ignored. Memory follows a group, or a slice of
text or one longer document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, materialize, pick, slices, word_hashes

LENGTH, END, GROUP_PIECES = 4096, 2, 20_000
REMEMBER = 400_000


# --------------------------------------------------------------- tokenisation

_KIND = np.full(256, 9, np.uint8)  # others: never a cut beside them
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[*range(48, 58)]] = 2
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 3


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges that are tokenised independently: runs without ASCII white space,
    cut further between letters, digits and punctuation of ASCII and Latin-1.
    Nothing is cut beside an apostrophe or any other character. Texts with an
    added token of the tokenizer in them are not for this (see ``Encoder``)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    kind = _KIND[data]
    lead = data == 0xC3
    follows = np.zeros(n, dtype=bool)
    follows[1:] = lead[:-1] & (data[1:] != 0x97) & (data[1:] != 0xB7)
    kind[follows] = 1  # second byte of a Latin-1 letter
    first = kind.copy()
    first[:-1][lead[:-1]] = np.where(follows[1:][lead[:-1]], 1, 9)
    keep = ~SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    cut = np.zeros(n, dtype=bool)
    p, q = kind[:-1], first[1:]
    cut[1:] = (p != 9) & (q != 9) & ((p != q) | (p == 2)) & ~lead[:-1]
    starts = keep.copy()
    starts[1:] &= ~keep[:-1] | edge[1:-1] | cut[1:]
    ends = keep.copy()
    ends[:-1] &= ~keep[1:] | edge[1:-1] | cut[1:]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


class Encoder:
    """Token ids of many texts, by the tokenizer of a file.

    ``independent``: the tokenizer drops white space, lower-cases, and never
    joins letters with digits or punctuation, so that units may be encoded one
    by one; otherwise whole texts are encoded. Texts that hold the content of an
    added token (in any case, if it is matched after normalising) are encoded
    whole always: such tokens are matched across units.
    """

    def __init__(self, path: str, independent: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.independent = Tokenizer.from_file(path), independent
        self.known: dict[int, np.ndarray] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        either = lambda tokens: re.compile(b"|".join(re.escape(t) for t in tokens)) if tokens else None
        self.raw = either([t.content.encode() for t in added if not t.normalized])
        self.normalized = either([bytes(LOWER[np.frombuffer(t.content.encode(), np.uint8)]) for t in added if t.normalized])

    def _with_added(self, data: np.ndarray, offs: np.ndarray) -> list[int]:
        """Documents in which an added token may occur."""
        at = [m.start() for m in self.raw.finditer(data.tobytes())] if self.raw else []
        at += [m.start() for m in self.normalized.finditer(LOWER[data].tobytes())] if self.normalized else []
        return np.unique(np.searchsorted(offs, at, "right") - 1).tolist()

    def _whole(self, data: np.ndarray, offs: np.ndarray, i: int) -> list[int]:
        return self.tokenizer.encode(data[offs[i] : offs[i + 1]].tobytes().decode(), add_special_tokens=False).ids

    def texts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the index of each document's first id (n + 1 values)."""
        if not self.independent:
            got = [self._whole(data, offs, i) for i in range(len(offs) - 1)]
            begins = np.zeros(len(offs), np.int64)
            np.cumsum([len(x) for x in got], out=begins[1:])
            return np.fromiter((i for x in got for i in x), np.uint32, begins[-1]), begins
        s, e, first = units(data, offs)
        lower = LOWER[data]
        h, at, inverse = np.unique(word_hashes(lower, s, e), return_index=True, return_inverse=True)
        keys = h.tolist()
        missing = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(missing) > REMEMBER:
            self.known = {}
            missing = range(len(keys))
        flat = lower.tobytes()
        rest, plain = [], self.tokenizer.model.tokenize
        for i in missing:
            a, b = s[at[i]], e[at[i]]
            word = flat[a:b]
            if word.isalpha():  # ASCII letters only: what normalising and splitting leave as it is
                self.known[keys[i]] = np.array([t.id for t in plain(word.decode())], np.uint32)
            else:
                rest.append(i)
        if rest:
            for i, x in zip(rest, self.tokenizer.encode_batch([data[s[at[i]] : e[at[i]]].tobytes().decode() for i in rest], add_special_tokens=False), strict=True):
                self.known[keys[i]] = np.array(x.ids, np.uint32)
        table = [self.known[k] for k in keys]
        size = np.fromiter(map(len, table), np.int64, len(table))
        start = np.cumsum(size) - size
        pool = np.concatenate(table) if table else np.zeros(0, np.uint32)
        n = size[inverse]
        to = np.cumsum(n)
        ids = pool[np.arange(to[-1] if len(to) else 0) + np.repeat(start[inverse] - (to - n), n)]
        begins = np.r_[0, to][first]
        whole = self._with_added(data, offs)
        if not whole:
            return ids, begins
        size, parts, done = np.diff(begins), [], 0
        for i in whole:
            own = np.array(self._whole(data, offs, i), np.uint32)
            parts += [ids[done : begins[i]], own]
            size[i], done = len(own), begins[i + 1]
        return np.concatenate([*parts, ids[done:]]), np.r_[0, np.cumsum(size)]


@lru_cache(maxsize=2)
def _encoder(path: str, independent: bool) -> Encoder:
    return Encoder(path, independent)


# -------------------------------------------------------------------- packing


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces go by falling size (first of equal
    ones first) into the first bin with room. A tournament tree holds at each
    node the most room below it."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    leaves = 1 << max(0, int(len(sizes)) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    for i in order.tolist():
        n, k = int(sizes[i]), 1
        while k < leaves:
            k *= 2
            if room[k] < n:
                k += 1
        bins[i], offsets[i] = k - leaves, capacity - room[k]
        room[k] -= n
        while k > 1:
            k //= 2
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k] = best
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END, group_pieces: int = GROUP_PIECES, independent: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset. ``tokenizer``: path of a tokenizer file."""
    source = pick(docs, doc_id=doc_id, text=text)
    kind = source.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(tokenizer, independent)
        for batch in batches:
            for rows, data, offs in slices(batch):
                ids, begins = encoder.texts(data, offs)
                n = np.diff(begins) + 1
                pieces = -(-n // length)
                doc = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * length
                size = np.minimum(length, n[doc] - start)
                flat, tail = ids.astype("<u4").tobytes(), np.array([end_id], "<u4").tobytes()
                crc = []
                for d, a, k in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True):
                    at = 4 * (int(begins[d]) + a)
                    last = a + k == n[d]
                    x = zlib.crc32(flat[at : at + 4 * (k - last)])
                    crc.append(zlib.crc32(tail, x) if last else x)
                yield pa.RecordBatch.from_arrays([pc.take(rows.column(0), pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(n[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    pieces = source.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialize(pieces.withColumn("place", F.monotonically_increasing_id()), "pieces")
    groups = max(1, round(pieces.count() / group_pieces))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups)))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), length)
        ids = group.column("group").to_numpy() * (1 << 32) + bins
        out = group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("group").applyInArrow(fill, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe_path())
