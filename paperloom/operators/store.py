"""Collections of vectors as snapshots of Parquet files.

A collection is a folder with a descriptor and numbered snapshot folders; a
change writes a new snapshot and then moves the pointer, so readers never see
half of it. All files go through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import where_metadata


@dataclass(frozen=True)
class Descriptor:
    name: str
    size: int = 384
    distance: str = "Cosine"
    snapshot: str = ""


class Collections:
    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        p = self._jvm.org.apache.hadoop.fs.Path("/".join((self.base, *parts)))
        return p, p.getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        p, fs = self._path(name, "descriptor.json")
        return fs.exists(p)

    def describe(self, name: str) -> Descriptor:
        line = self.spark.read.text(f"{self.base}/{name}/descriptor.json").first()[0]
        return Descriptor(**json.loads(line))

    def _point(self, d: Descriptor) -> None:
        p, fs = self._path(d.name, "descriptor.json")
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(asdict(d)).encode()))
        finally:
            out.close()

    def create(self, name: str, size: int = 384, distance: str = "Cosine", recreate: bool = False) -> bool:
        """False if it exists and is not to be made anew."""
        if self.exists(name):
            if not recreate:
                return False
            self.drop(name)
        self._point(Descriptor(name, size, distance))
        return True

    def drop(self, name: str) -> None:
        p, fs = self._path(name)
        fs.delete(p, True)

    def points(self, name: str) -> DataFrame | None:
        d = self.describe(name)
        return self.spark.read.parquet(f"{self.base}/{name}/{d.snapshot}") if d.snapshot else None

    def _replace(self, name: str, df: DataFrame) -> None:
        d = self.describe(name)
        snapshot = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.base}/{name}/{snapshot}")
        self._point(Descriptor(d.name, d.size, d.distance, snapshot))

    def upsert(self, name: str, points: DataFrame, vector: str = "embedding", deterministic_ids: bool = True) -> dict[str, int]:
        """Add points, or put them in the place of stored ones of the same id; of
        several given points of one id any one is stored. Vectors of another length
        than the collection's are not stored but counted as failed. Ids follow from
        the embedding id, or are random ones that make a repeated load add points
        again."""
        d = self.describe(name)
        ids = F.sha2(F.col("embedding_id"), 256) if deterministic_ids else F.expr("uuid()")
        rows = points if "point_id" in points.columns else points.withColumn("point_id", ids)
        total, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.size(vector) == d.size).cast("int")), F.lit(0))).first()
        new = rows.where(F.size(vector) == d.size).dropDuplicates(["point_id"])
        old = self.points(name)
        if old is not None:
            new = old.join(new.select("point_id"), "point_id", "left_anti").unionByName(new, allowMissingColumns=True)
        self._replace(name, new)
        return {"uploaded": int(good), "failed": int(total - good), "total": int(total)}

    def get(self, name: str, point_id: str) -> DataFrame:
        return self.points(name).where(F.col("point_id") == point_id)

    def update(self, name: str, point_id: str, values: dict) -> None:
        """Set payload columns of one point."""
        rows = self.points(name)
        hit = F.col("point_id") == point_id
        kinds = dict(rows.dtypes)
        self._replace(name, rows.withColumns({k: F.when(hit, F.lit(v).cast(kinds[k])).otherwise(F.col(k)) for k, v in values.items()}))

    def delete(self, name: str, filters: dict) -> None:
        rows = self.points(name)
        self._replace(name, rows.where(~F.coalesce(where_metadata(filters), F.lit(False))))

    def info(self, name: str) -> dict:
        if not self.exists(name):
            return {}
        rows = self.points(name)
        n = rows.count() if rows is not None else 0
        return {"name": name, "vectors_count": n, "points_count": n, "status": "green"}


# ------------------------------------------------------------------ exporters


def export_json(recs: DataFrame, path: str, with_text: bool = True) -> None:
    """One record a line, with the total and version beside them on each line's
    reader's side: ``total_records`` and ``version`` are in ``_summary``."""
    rows = recs if with_text else recs.drop("embedding_input_text", "normalized_text")
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/records")
    recs.agg(F.count(F.lit(1)).alias("total_records"), F.coalesce(F.min("version"), F.lit("1.0")).alias("version")).write.mode("overwrite").json(f"{path}/summary")


def export_points_json(payloads: DataFrame, path: str) -> None:
    """{id, payload} a line; ids count from 0 within the order of embedding ids."""
    ordered = payloads.orderBy("embedding_id")
    # a row's number is the number of rows in the partitions before it, and its place in its own
    at = F.monotonically_increasing_id()
    placed = ordered.withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.sum("n").over(Window.orderBy("_part")) - F.col("n"))
    numbered = placed.join(F.broadcast(sizes.select("_part", "_before")), "_part")  # a row for each partition
    numbered.select((F.col("_before") + F.col("_at")).alias("id"), F.struct(*payloads.columns).alias("payload")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\n").option("multiLine", True).csv(path)
