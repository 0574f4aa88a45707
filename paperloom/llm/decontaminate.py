"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Native DataFrame operations only. Benchmark texts are cut into windows of
``window`` words (an item of fewer words is one window). A position of a document
is looked up in a hash set by the hash of the words it starts with, and the whole
window of a hit is verified by a 128-bit digest. Windows are counted before the
run, which says where the set is; the rows are the same:

* up to ``max_keys`` windows it is a constant inside the scan: each text is split
  once, and positions that pass leave the scan as an array on the document's row;
* up to ``MAX_BROADCAST`` it is broadcast as a table, of 8-byte hashes first, so
  that a position of a document is never shuffled unless its first words are those
  of a window; texts stay in the buckets they were written to;
* beyond, the same joins go by shuffle, with salt, so that words which very many
  documents share are not one task's.

Edge cases: a null text has no words, is not hit and hits nothing; an empty
benchmark hits nothing; an empty table of documents gives an empty result;
repeated items of one id count once; a null item id is not listed; repeated
documents are judged alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, materialize_bucketed, pick

WINDOW, LEAD, MAX_KEYS = 10, 3, 20_000
#: Windows whose hashes are broadcast as a table (under 100 MB); rows per key beyond.
MAX_BROADCAST, SALTS = 1_000_000, 16
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: str) -> Column:
    """Lower-cased (A-Z) words of a text; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _once(column: Column) -> Column:
    """The same value, which the optimiser keeps as one column: it would move
    and copy a deterministic one into every place a filter above it looks at."""
    return F.when(F.spark_partition_id() >= 0, column)


def _lead(words: Column, at: Column, n: int) -> Column:
    """Hash of up to LEAD words from the 0-based place ``at``; it starts with the
    window's length class, so windows of one and two words have keys of their own."""
    return F.xxhash64(F.lit(min(n, LEAD)), *[F.get(words, at + k) for k in range(min(n, LEAD))])


def _digest(words: Column, at: Column, n: int) -> Column:
    return F.md5(F.array_join(F.slice(words, at + 1, F.lit(n)), " "))


def benchmark_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, n (words), lead and digest of each distinct window."""
    items = pick(bench, item_id="item_id", text="text").select("item_id", normal_words("text").alias("w")).where(F.size("w") > 0)
    placed = items.withColumn("n", F.least(F.size("w"), F.lit(window))).select("item_id", "w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("at"))
    lead = F.when(F.col("n") == 1, _lead(F.col("w"), F.col("at"), 1)).when(F.col("n") == 2, _lead(F.col("w"), F.col("at"), 2)).otherwise(_lead(F.col("w"), F.col("at"), LEAD))
    return placed.select("item_id", "n", lead.alias("lead"), F.md5(F.array_join(F.slice("w", F.col("at") + 1, F.col("n")), " ")).alias("digest")).distinct()


def _places(words: Column, n: int) -> Column:
    """0-based starts of n-word windows."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))


def _hits_of(words: Column, n: int, leads: list, digests: list) -> Column:
    likely = F.filter(_places(words, n), lambda at: _lead(words, at, n).isin(leads))
    full = F.transform(likely, lambda at: F.struct(at.alias("at"), F.lit(n).alias("n"), _digest(words, at, n).alias("digest")))
    return F.filter(full, lambda x: x["digest"].isin(digests))


def _hits_in_row(words: Column, keys: list) -> Column:
    """Array of (at, n, digest) of the windows in ``keys`` that occur."""
    found = []
    for n in sorted({r["n"] for r in keys}):
        leads = sorted({r["lead"] for r in keys if r["n"] == n})
        digests = sorted({r["digest"] for r in keys if r["n"] == n})
        found.append(_hits_of(words, n, leads, digests))
    if not found:
        return F.array().cast("array<struct<at:int,n:int,digest:string>>")
    return found[0] if len(found) == 1 else F.concat(*found)


def _covered(hits: Column) -> Column:
    """Words inside any of the hits."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["at"] + x["n"] - F.greatest(acc["end"], x["at"]))).alias("n"), F.greatest(acc["end"], x["at"] + x["n"]).alias("end"))
    return F.aggregate(F.array_sort(hits), start, step, lambda acc: acc["n"].cast("long"))


def _bounded_keys(windows: DataFrame, max_keys: int) -> list | None:
    """The windows' hashes, or None if there are more than ``max_keys``."""
    rows = windows.select("n", "lead", "digest").distinct().limit(max_keys + 1).collect()
    return rows if len(rows) <= max_keys else None


def decontamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_keys: int = MAX_KEYS, max_broadcast: int = MAX_BROADCAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated and spans (0-based word ranges, end exclusive)."""
    windows = materialize(benchmark_windows(bench, window), "windows")
    keys = _bounded_keys(windows, max_keys)
    source = pick(docs, doc_id=doc_id, text=text).withColumn("row", F.monotonically_increasing_id())
    split = source.select("row", "doc_id", normal_words("text").alias("w"))
    if keys is not None:
        base = split.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), _hits_in_row(F.col("w"), keys).alias("hits"))
    else:
        base = _hits_by_join(materialize_bucketed(split, "words", "row"), windows, max_broadcast)
    base = materialize(base, "hits")
    each = base.where(F.size("hits") > 0).select("row", F.explode("hits").alias("h")).select("row", "h.digest").distinct()
    items = _joined(each, windows.select("digest", "item_id"), "digest", "inner", windows.count() <= max_broadcast).groupBy("row").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    none = F.array().cast("array<string>")
    listed = F.coalesce("items", none)
    spans = F.array_distinct(F.transform(F.array_sort("hits"), lambda x: F.struct(x["at"].alias("start"), (x["at"] + x["n"]).alias("end"))))
    n_hit = _covered(F.col("hits"))
    return base.join(items, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(listed), ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), spans.alias("spans")
    )


def _leads(words: Column, n: int) -> Column:
    return F.transform(_places(words, n), lambda at: _lead(words, at, n))


def _joined(rows: DataFrame, keys: DataFrame, key: str, how: str, few: bool) -> DataFrame:
    """``rows`` (with a column row) and ``keys`` joined, those broadcast if few."""
    if few:
        return rows.join(F.broadcast(keys), key, how)
    salted = keys.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).hint("merge").join(salted, [key, "salt"], how).drop("salt")


def _found_by_join(split: DataFrame, windows: DataFrame, max_broadcast: int) -> DataFrame:
    """``row, found`` of the rows in which a window occurs. ``split``: row, w, in
    buckets by row."""
    lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # at most as many as a window has words
    few = windows.count() <= max_broadcast
    words = F.col("w")
    placed = split.select("row", F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("lead")).limit(0)
    for n in lengths:
        placed = placed.unionByName(split.select("row", F.lit(n).alias("n"), F.posexplode(_leads(words, n)).alias("at", "lead")))
    likely = _joined(placed, windows.select("lead").distinct(), "lead", "left_semi", few)
    likely = likely.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("places"))
    whole = F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["n"].alias("n"), F.md5(F.array_join(F.slice(words, x["at"] + 1, x["n"]), " ")).alias("digest")))
    full = split.select("row", "w").join(likely.hint("shuffle_hash"), "row").select("row", F.explode(whole).alias("p")).select("row", "p.*")
    full = _joined(full, windows.select("digest").distinct(), "digest", "left_semi", few)
    return full.groupBy("row").agg(F.collect_list(F.struct("at", "n", "digest")).alias("found"))


def _hits_by_join(split: DataFrame, windows: DataFrame, max_broadcast: int) -> DataFrame:
    """``row, doc_id, n_words, hits`` of all rows."""
    none = F.array().cast("array<struct<at:int,n:int,digest:string>>")
    base = split.select("row", "doc_id", F.size("w").cast("long").alias("n_words"))
    found = _found_by_join(split, windows, max_broadcast)
    return base.join(found.hint("shuffle_hash"), "row", "left").select("row", "doc_id", "n_words", F.coalesce("found", none).alias("hits"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_keys: int = MAX_KEYS, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs``, all columns, in which no window occurs. Beyond
    ``max_keys`` windows the rows are written once with a number each: numbers
    given anew at each read would change with the executors there are."""
    windows = materialize(benchmark_windows(bench, window), "windows")
    keys = _bounded_keys(windows, max_keys)
    names = docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text = f"_{names.index('text')}"
    if keys is not None:
        clean = flat.withColumn("_w", _once(normal_words(text))).withColumn("_clean", _once(F.size(_hits_in_row(F.col("_w"), keys)) == 0)).where("_clean").drop("_w", "_clean")
    else:
        flat = materialize_bucketed(flat.withColumn("row", F.monotonically_increasing_id()), "numbered", "row")
        bad = materialize(_found_by_join(flat.select("row", normal_words(text).alias("w")), windows, max_broadcast).select("row"), "contaminated")
        clean = flat.join(bad.hint("shuffle_hash"), "row", "left_anti").drop("row")
    return clean.toDF(*names)


def remove_spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW, max_keys: int = MAX_KEYS, max_broadcast: int = MAX_BROADCAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text without the words of benchmark windows: the remaining
    normalised words joined by one space. Texts without a hit stay as they are."""
    windows = materialize(benchmark_windows(bench, window), "windows")
    keys = _bounded_keys(windows, max_keys)
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("w", _once(normal_words("text")))
    if keys is not None:
        rows = rows.withColumn("hits", _hits_in_row(F.col("w"), keys))
    else:
        rows = materialize_bucketed(rows.withColumn("row", F.monotonically_increasing_id()), "words", "row")
        rows = rows.join(_hits_by_join(rows, windows, max_broadcast).select("row", "hits").hint("shuffle_hash"), "row")
    inside = lambda i: F.exists("hits", lambda h: (h["at"] <= i) & (i < h["at"] + h["n"]))
    kept = F.array_join(F.filter("w", lambda _, i: ~inside(i)), " ")
    return rows.select("doc_id", F.when(F.size("hits") > 0, kept).otherwise(F.col("text")).alias("text"))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


OP8_SQL = r"""
WITH n AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM n, ks WHERE len(w) >= k)),
h AS (SELECT r, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
it AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM n LEFT JOIN c ON n.r = c.r LEFT JOIN it ON n.r = it.r
"""
