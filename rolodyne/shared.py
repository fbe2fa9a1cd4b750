"""Written intermediate tables in the folder all executors share, and what needs
them: connected components and ranks over a whole table."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
_changed = threading.Lock()  # jobs of one query may run side by side


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); only where it is
    unset, as in tests, a temporary one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = getattr(spark.sparkContext, "_rolodyne_dir", None)
        if base is None:
            base = spark.sparkContext._rolodyne_dir = f"file://{tempfile.mkdtemp(prefix='rolodyne-')}"
    return base


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors and gives later joins a known size. Where
    about how many (narrow) rows there are is known, no more files are written
    than those fill."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, min(parts(spark), -(-rows // 100_000))))
    path = f"{shared_dir(spark)}/rolodyne-{uuid.uuid4().hex}"
    df.write.parquet(path)
    with _changed:
        _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._rolodyne_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_rolodyne_path", None)
    if path:
        _delete(df.sparkSession, path)
        with _changed:
            _written[:] = [x for x in _written if x[1] != path]


@contextmanager
def intermediate() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables written within, but for those given to the function it
    yields: for work whose result is written and no longer needs them."""
    mark, kept = len(_written), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._rolodyne_path)
        return df

    yield keep
    for spark, path in _written[mark:]:
        if path not in kept:
            _delete(spark, path)
    _written[mark:] = [x for x in _written[mark:] if x[1] in kept]


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder goes with it
            return


def rekey(col: str) -> Column:
    """The same long, in a form of which the planner doesn't know the
    partitioning, so that a join gets exchanges that AQE can split by skew."""
    return F.bitwise_not(F.bitwise_not(F.col(col)))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (src, dst), longs -> (node, component): every node with an edge and
    the smallest node it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014): after a
    logarithmic number of rounds every node hangs from its smallest. Each round
    is written to the shared folder; hubs only meet in aggregations with a
    map-side part and in joins that AQE can split. Nothing is collected but a
    row count and a checksum."""
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = materialize(e)
    last, n = None, 2 * e.count()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(rekey("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both.u == low.k).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        keyed = low.select(rekey("u").alias("k"), "m")
        small = large.join(keyed, large.u == keyed.k).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        nxt = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), n)
        remove(large)
        remove(e)
        e = nxt
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def global_rank(rows: DataFrame, order: list, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """rows with their place, from 1, in a total order over the whole table.

    The rows are dealt into ranges of the full order and written as sorted, so
    that the layout is fixed; each range's row count (one number a task) gives
    where the next one begins. `order` should tell all rows apart, or equal ones
    are numbered anyhow. Equal leading columns spread like any others."""
    spark = rows.sparkSession
    n = partitions or parts(spark)
    laid = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    sizes = sorted((r.p, r.n) for r in laid.groupBy(task.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a range
    before, starts = 0, []
    for p, size in sizes:
        starts.append((p, before))
        before += size
    begin = F.broadcast(spark.createDataFrame(starts, "_p long, _begin long"))
    local = F.col("_at") - F.shiftleft(task, 33)
    return laid.join(begin, task == F.col("_p")).withColumn(name, F.col("_begin") + local + 1).drop("_at", "_p", "_begin")
