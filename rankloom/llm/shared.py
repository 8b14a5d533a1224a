"""What several operators share: the shared working folder, file access by URI and range shards."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: x20 and x09 to x0D.
WHITE = "\\x20\\x09-\\x0D"
#: Bytes of a row group: what a writing task holds in memory, where texts and signatures are wide.
ROW_GROUP = 16 << 20
_MADE: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, set here only where it is unset.

    Unset on a local master means a test, where a temporary folder is shared by nature; unset on a
    cluster the warehouse is used, which all executors reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_rankloom_root", None)
    if not root:
        if spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_rankloom"
        spark._rankloom_root = root
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder, so that a lost executor loses nothing.

    A written table rather than ``DataFrame.checkpoint``: that keeps the size estimates of the plan
    it replaces, which joins multiply, until after some rounds planning takes longer than the work.
    A table has its true size, so small sides are also broadcast where Spark's threshold allows.
    """
    spark = df.sparkSession
    path = work_folder(spark, "table")
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rankloom_path = path
    scope = _SCOPE.get()
    if scope is not None:
        scope.made.add(path)
    return out


class _Scope:
    """Tables written since a scratch() began, and the scope around it. Each thread has its own."""

    def __init__(self, outer: _Scope | None):
        self.made, self.outer = set(), outer


_SCOPE: ContextVar[_Scope | None] = ContextVar("rankloom_scope", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that checkpoint() writes inside go at the end, but for those given to the function this yields."""
    scope = _Scope(_SCOPE.get())
    token = _SCOPE.set(scope)

    def keep(df: DataFrame) -> DataFrame:
        path = df._rankloom_path
        scope.made.discard(path)
        if scope.outer is not None:
            scope.outer.made.add(path)
        return df

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for path in scope.made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the shared root; removed when the driver ends."""
    path = f"{shared_root(spark).rstrip('/')}/rankloom/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_remove_made)
    _MADE.append((spark, path))
    return path


def _remove_made() -> None:
    for spark, path in _MADE:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
            else:
                fs, p = filesystem(path)
                fs.delete_dir(p)
        except Exception:  # noqa: BLE001, S112 - the folder may be gone with its store
            continue


def filesystem(uri: str):
    """(file system, path) of a URI, on the driver or an executor."""
    from pyarrow import fs

    if "://" in uri:
        if uri.startswith("file://"):
            return fs.LocalFileSystem(), uri[len("file://") :]
        return fs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri[len("file:") :]
    return fs.LocalFileSystem(), os.path.abspath(uri)


def write_file(uri: str, data: bytes, attempt: str) -> None:
    """Write under a temporary name, then rename: a reader never sees half a file, a second attempt replaces the first."""
    fs, path = filesystem(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    tmp = f"{folder}/.{name}.{attempt}.tmp"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    fs.move(tmp, path)


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def attempt_name() -> str:
    """Unique for each task attempt."""
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.stageId()}-{t.partitionId()}-{t.taskAttemptId()}" if t else uuid.uuid4().hex


#: Bins of a key's range, and so the most shards; the tables of bins, at most a few times as many rows, are all that range_shards() brings to the driver.
BINS = 1 << 16
_SIGN = -(1 << 63)


def _unsigned(key: str) -> Column:
    """A signed 64-bit key as bits that sort as unsigned; no arithmetic that could overflow."""
    return F.col(key).cast("bigint").bitwiseXOR(F.lit(_SIGN).cast("bigint"))


def _span(lo: int, hi: int, bits: int) -> tuple[int, int]:
    """(shift, mask) that cut keys from lo to hi, both signed, into at most 2^bits bins of one width."""
    shift = max(0, (lo ^ hi).bit_length() - bits) if (lo < 0) == (hi < 0) else 64 - bits
    return shift, (1 << bits) - 1


class Shards:
    """Consecutive shard numbers for consecutive ranges of an integer key; the ranges follow from the rows alone.

    ``finer``: for each level of refinement, rows (node, slot, child, shift, mask) of bins that are cut again.
    """

    def __init__(self, spark: SparkSession, key: str, root: tuple[int, int]):
        self.spark, self.key, self.root = spark, key, root
        self.finer: list[list[tuple[int, int, int, int, int]]] = []
        self.leaves: list[tuple[int, int, int, int]] = [(0, -1, 0, 1)]
        self.n = 1

    def binned(self, df: DataFrame) -> DataFrame:
        """Add ``_node`` and ``_slot``: the bin of a row's key; rows without a key have the slot -1."""
        cut = lambda shift, mask: F.expr(f"cast(shiftrightunsigned(_u, {shift}) & {mask} as int)")
        df = df.withColumn("_u", _unsigned(self.key)).withColumn("_node", F.lit(0)).withColumn("_slot", F.coalesce(cut(self.root[0], f"{self.root[1]}L"), F.lit(-1)))
        for rows in self.finer:
            table = self.spark.createDataFrame(rows, "_node int, _slot int, _child int, _shift int, _mask bigint")  # at most BINS rows
            df = df.join(F.broadcast(table), ["_node", "_slot"], "left").withColumn("_slot", F.when(F.col("_child").isNull(), F.col("_slot")).otherwise(cut("_shift", "_mask")))
            df = df.withColumn("_node", F.coalesce("_child", "_node")).drop("_child", "_shift", "_mask")
        return df.drop("_u")

    def _joined(self, df: DataFrame) -> DataFrame:
        table = self.spark.createDataFrame(self.leaves, "_node int, _slot int, _first int, _parts int")
        return self.binned(df).join(F.broadcast(table), ["_node", "_slot"]).drop("_node", "_slot")

    def assign(self, df: DataFrame, tie: Column) -> DataFrame:
        """Add ``_shard``; a bin of several shards is split by ``tie``, a 64-bit hash that orders equal keys."""
        place = F.floor((F.shiftrightunsigned(tie, 33) * F.col("_parts").cast("long")) / F.lit(1 << 31)).cast("int")
        return self._joined(df).withColumn("_shard", F.col("_first") + place).drop("_first", "_parts")

    def everywhere(self, df: DataFrame) -> DataFrame:
        """Add ``_shard``: each row once for every shard that may hold its key."""
        rows = self._joined(df).withColumn("_shard", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1)))
        return rows.drop("_first", "_parts")


def range_shards(df: DataFrame, key: str, weight: Column, target: int) -> Shards:
    """Ranges of ``key`` with about ``target`` of ``weight`` each, at most about ``BINS`` of them.

    The weights of at most ``BINS`` bins of the key's range are summed with partial aggregation. Bins
    over the target that hold several keys (a few outliers squeeze all others together) are cut again
    between their own least and largest key, so the ranges follow the data wherever they lie. A bin
    over the target that holds one key only gets several shards, as do the rows without a key, which
    come first. Any 64-bit keys will do.
    """
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    out = Shards(df.sparkSession, key, _span(lo or 0, hi or 0, BINS.bit_length() - 1))
    figures = [F.coalesce(F.sum(weight), F.lit(0)).alias("w"), F.min(key).alias("lo"), F.max(key).alias("hi")]
    level, leaves = out.binned(df).groupBy("_node", "_slot").agg(*figures).collect(), []
    target = max(target, sum(r["w"] for r in level) // BINS)
    nodes = 1
    for _ in range(4):
        heavy = {(r["_node"], r["_slot"]) for r in level if r["w"] > 2 * target and r["lo"] is not None and r["lo"] < r["hi"]}
        leaves += [r for r in level if (r["_node"], r["_slot"]) not in heavy]
        if not heavy:
            level = []
            break
        rows = []
        for r in sorted((x for x in level if (x["_node"], x["_slot"]) in heavy), key=lambda x: x["lo"]):
            rows.append((r["_node"], r["_slot"], nodes, *_span(r["lo"], r["hi"], min(16, (r["w"] // target).bit_length() + 2))))
            nodes += 1
        out.finer.append(rows)
        fresh = [r[2] for r in rows]
        level = out.binned(df).filter(F.col("_node") >= min(fresh)).groupBy("_node", "_slot").agg(*figures).collect()
    shard, held, out.leaves = -1, target, []
    for r in sorted([*leaves, *level], key=lambda r: (r["lo"] is not None, r["lo"] or 0)):
        w = r["w"]
        parts = -(-w // target) if w > target and (r["lo"] is None or r["lo"] == r["hi"]) else 1
        if parts > 1 or held + w > target:
            shard, held = shard + 1, 0
        out.leaves.append((r["_node"], r["_slot"], shard, parts))
        if parts > 1:
            shard, held = shard + parts - 1, target
        held += w
    out.n = max((first + parts for *_, first, parts in out.leaves), default=1)
    out.leaves = out.leaves or [(0, -1, 0, 1)]
    return out


def deal_by_shard(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """One partition for each shard, sorted inside."""
    n = max(1, n)
    df = df.repartitionById(n, F.col("_shard").cast("int")) if hasattr(df, "repartitionById") else df.repartitionByRange(n, "_shard")
    return df.sortWithinPartitions("_shard", *order)


def deal_files(manifest: DataFrame) -> DataFrame:
    """A manifest's rows, the files of a shard to one task."""
    n = (manifest.agg(F.max("shard")).first()[0] or 0) + 1
    return manifest.repartitionById(n, F.col("shard")) if hasattr(manifest, "repartitionById") else manifest.repartition(n, "shard")
