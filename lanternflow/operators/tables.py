"""Table maintenance as joins, and tables that are kept by key.

The functions take and return whole tables; nothing is changed in place. KeyedTable rewrites only the parts of a stored table that
changes touch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanternflow.sources.scratch import materialise


def scan(df: DataFrame, equal: dict[str, object], limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows whose columns have these values (None: null); with a limit, the first so many by the order columns, else by all columns."""
    for column, value in equal.items():
        df = df.filter(F.col(column).isNull() if value is None else F.col(column) == F.lit(value))
    return df if limit is None else df.orderBy(*(order or df.columns)).limit(max(0, limit))


def last_of(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row of each key: the last by the order columns, null first; of equal ones (all, without order) the greatest by a hash of the row.

    It is found by aggregation, so a key with very many changes is reduced before rows are shuffled. A null key is a key.
    """
    names = rows.columns
    place = F.struct(*(F.col(c) for c in order or []), F.xxhash64(*names).alias("tie"))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), place).alias("last")).select("last.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of new, and those of old without a new row of their key. Of several new rows of a key the last by the order columns wins.

    A row under an older schema has null in added columns. Order columns that old does not have are not kept.
    """
    last = last_of(new, keys, order)
    last = last.drop(*(c for c in order or [] if c not in old.columns))
    return _without(old, last, keys).unionByName(last, allowMissingColumns=True)


def _without(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """old without rows of these keys; null keys are equal."""
    marked = gone.select(*(F.col(k).alias(f"gone_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"gone_{k}")) for k in keys]
    return old.join(marked, same, "left_anti")


def partial_update(old: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Fields that a change supplies replace the old ones; null fields and unknown keys change nothing.

    Of several changes of a key, each field's last value that is not null (by the order columns) counts, as if they were applied one after the other.
    """
    fields = [c for c in changes.columns if c not in [*keys, *(order or [])] and c in old.columns]
    place = F.struct(*(F.col(c) for c in order or []), F.xxhash64(*changes.columns).alias("tie"))
    last = changes.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"new_{c}") for c in fields)) if fields else None
    if last is None:
        return old
    joined = old.join(last, keys, "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns))


class KeyedTable:
    """A Parquet table with a unique key, in parts by the key's hash. A change reads and writes only the parts that hold its keys.

    Each change is first reduced to a row a key. The new parts are written to the scratch folder, checked for the unique key, and then take the
    place of the old ones; a change that is applied again, as after a failure, gives the same table. by: the key columns that choose a
    part, all of them if not given. by and buckets are fixed with the first change.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64, by: list[str] | None = None):
        self.spark, self.path, self.keys, self.buckets, self.by = spark, path, keys, buckets, by or keys
        self.schema = StructType.fromDDL(schema)
        self._stored = StructType.fromDDL(f"{schema}, bucket int")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def _all(self) -> DataFrame:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(self.path)

    def read(self) -> DataFrame:
        return self._all().select(*self.schema.names)

    def change(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replaces the parts that hold the keys in touched (the columns in by) by make(what they held). Returns the numbers of these parts."""
        numbers = sorted(r[0] for r in touched.select(self.bucket().alias("b")).distinct().collect())  # as many as parts at most
        if not numbers:
            return []
        held = self._all().filter(F.col("bucket").isin(numbers)).select(*self.schema.names)
        new = make(held).select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).withColumn("bucket", self.bucket())
        new = materialise(new, "parts")
        bad = unique_violations(new, self.keys).limit(1).collect()
        if bad:
            raise ValueError(f"more than one row of a key: {bad[0]}")
        # A part that has lost all its rows is replaced by an empty one.
        left = {r[0] for r in new.select("bucket").distinct().collect()}
        new.repartitionByRange("bucket", *self.keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for number in numbers:
            if number not in left:
                gone = fs_path(f"{self.path}/bucket={number}")
                gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(gone, True)
        return numbers

    def upsert(self, changes: DataFrame, order: list[str] | None = None) -> list[int]:
        """upsert() of the changes; columns of the table that they do not have become null."""
        changes = materialise(last_of(changes, self.keys, order), "changes")
        return self.change(changes, lambda held: upsert(held, changes.drop(*(c for c in order or [] if c not in self.schema.names)), self.keys))

    def update(self, changes: DataFrame, order: list[str] | None = None) -> list[int]:
        """partial_update() by the changes."""
        changes = materialise(changes, "changes")
        return self.change(changes, lambda held: partial_update(held, changes, self.keys, order))

    def delete(self, gone: DataFrame) -> list[int]:
        gone = materialise(gone.select(*self.keys).distinct(), "changes")
        return self.change(gone, lambda held: _without(held, gone, self.keys))


def cascade_delete(parents: DataFrame, children: DataFrame, grandchildren: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents without those in gone (id), and what still has a parent: children (id, parent_id), grandchildren (id, parent_id)."""
    lost = children.join(gone.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select(F.col("id").alias("parent_id"))
    left = children.join(gone.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    return parents.join(gone, "id", "left_anti"), left, grandchildren.join(lost, "parent_id", "left_anti")


def add_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Absent columns, as null of the given type."""
    return df.select("*", *(F.lit(None).cast(t).alias(c) for c, t in columns.items() if c not in df.columns))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
