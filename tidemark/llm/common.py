"""What several operators share: tables in the shared folder, names that don't clash, joins on hot keys, texts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session may leave it unset; it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tidemark-"))
    return _own[0]


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one."""
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(spark: SparkSession) -> None:
    """Deletes what this application's operators have written into the shared folder; results that read it end with it."""
    remove(spark, run_dir(spark))


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again.

    This cuts the lineage: later work survives lost executors without computing df anew.
    """
    path = f"{folder or run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that end with the `with` block; what outlives it must be stored() before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{run_dir(spark)}/scratch-{uuid.uuid4().hex}", []

    def __enter__(self) -> Scratch:
        return self

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, self.folder)

    def stored_by(self, df: DataFrame, name: str, column: str) -> DataFrame:
        """As stored, in buckets of a column, so that joins on it don't shuffle this side."""
        table = f"tidemark_{name}_{uuid.uuid4().hex}"
        self.tables.append(table)
        df.write.bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", f"{self.folder}/{table}").saveAsTable(table)
        return self.spark.table(table)

    def __exit__(self, *_) -> None:
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(self.spark, self.folder)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until df has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def set_aside(df: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns of these names (in any case) renamed, and what brings the old names back."""
    own = {c: fresh(df, f"kept_{c}")[0] for c in df.columns if c.lower() in names}
    return df.withColumnsRenamed(own), {new: old for old, new in own.items()}


#: Rows of one key that are few enough for a task, whatever the table's size.
FEW_ROWS = 2_000


def cut_by(left: DataFrame, right: DataFrame, key: str, spread: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """left and right, ready for a join on the columns of the third result: right has a row for each key, left may have hot ones.

    A key of more than one in P of left's rows (P: four times the shuffle partitions) and of more than FEW_ROWS is
    hot, so there are fewer than P of them, whatever the size of the data, and they are broadcast. A hot key is
    cut into so many pieces, by a hash of the column `spread`, that none has many more rows than that; right's row
    goes to each. left should be stored, as its keys are counted first.
    """
    pieces = 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = left.count()
    most = max(FEW_ROWS, -(-total // pieces))
    found = left.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > most).collect() if total > most else []
    if not found:
        return left, right, [key]
    k, n, piece = fresh(left.join(right.limit(0), key), "hot_key", "hot_pieces", "piece")
    kind = left.schema[key].dataType.simpleString()
    hot = F.broadcast(left.sparkSession.createDataFrame([(r[0], -(-r[1] // most)) for r in found], f"{k} {kind}, {n} int"))
    of = F.coalesce(F.col(n), F.lit(1))
    cut = left.join(hot, F.col(key) == F.col(k), "left").withColumn(piece, F.pmod(F.xxhash64(spread), of).cast("int")).drop(k, n)
    dealt = right.join(hot, F.col(key) == F.col(k), "left").withColumn(piece, F.explode(F.sequence(F.lit(0), of - 1))).drop(k, n)
    return cut, dealt, [key, piece]


def joined_by(left: DataFrame, right: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """left.join(right, key), with hot keys of left cut into pieces."""
    cut, dealt, on = cut_by(left, right, key, spread)
    return cut.join(dealt, on, how).drop(*on[1:])


def numbered(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """rows with `name`: their number from 0 within each key, in the order of a hash of all columns.

    rows should be stored ones. They are sorted into ranges and written with a number that counts within them, and only
    the counts of ranges are summed, so a key may hold any part of the rows. Rows that the hash doesn't tell
    apart are numbered as they lie.
    """
    tie, row, at, part, first, before = fresh(rows, "tie", "row", "at", "part", "first", "before")
    own = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c, kind in rows.dtypes if "map<" not in kind and kind != "variant"])
    order = [F.col(c).asc_nulls_first() for c in (*key, tie, row)]
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.withColumns({tie: own, row: F.monotonically_increasing_id()}).repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = stored(ranged.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)).drop(tie, row), "numbered")
    # a row for each range and key that meet
    runs = kept.groupBy(part, *key).agg(F.min(at).alias(first), F.count("*").alias("n"))
    earlier = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n").withColumnsRenamed({c: f"run_{c}" for c in (part, *key)})
    same = [F.col(c).eqNullSafe(F.col(f"run_{c}")) for c in (part, *key)]
    return kept.join(runs, same).withColumn(name, F.col(before) + F.col(at) - F.col(first)).select(*[F.col(f"`{c}`") for c in rows.columns], name)


def whole_text(column: str = "text") -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
