"""Shared pieces: reading tables, written intermediates, id folds, sizing."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as _column

#: Blanks of the word pattern: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\\x20\\x09-\\x0D"

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="veritide-ship-")) / f"{top.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)


def fold(id_col: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod`` (null for a null id)."""
    return F.crc32(id_col.cast("string").cast("binary")) % mod


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session without that setting (tests on one machine) gets a folder of its own.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    master = spark.sparkContext.master
    if not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = tempfile.mkdtemp(prefix="veritide-")
    return "file://" + _own_dir[app]


@contextmanager
def tidy(spark: SparkSession):
    """Let Spark remove an action's shuffle files when the action ends: what it wrote or returned replaces them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 64):
    """Hand few rows at a time to Python, where a row may hold megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, never a recomputation. The shuffle
    files that made the table go when it stands; :func:`drop` deletes the table itself.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "veritide-tables", spark.sparkContext.applicationId, uuid.uuid4().hex)
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veritide_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Delete written tables whose last reader has ended."""
    for t in tables:
        if t is None or not hasattr(t, "_veritide_path"):
            continue
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t._veritide_path)
        path.getFileSystem(conf).delete(path, True)


def rows_of(df: DataFrame) -> list:
    """Collect a frame whose size is bounded, and leave no shuffle files."""
    with tidy(df.sparkSession):
        return df.collect()


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, rest): all other columns in one struct, so that no inner name can clash with them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    rest = F.struct(*others) if others else F.lit(None).cast("int")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))


def unpacked(rows: DataFrame, columns: list[str], id_col: str, text_col: str, **added: Column) -> DataFrame:
    """The columns that :func:`packed` took, in their order, then ``added``; an added name replaces a column of that name."""
    own = {id_col: F.col("id").alias(id_col), text_col: F.col("text").alias(text_col)}
    kept = [own.get(c, F.col(f"rest.`{c}`").alias(c)) for c in columns if c not in added]
    return rows.select(*kept, *[v.alias(k) for k, v in added.items()])


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, or its measured text where that knows none; only for sizing buckets."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if found < df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes() // 4:
        return found
    texts = [F.sum(F.octet_length(name)) for name, kind in df.dtypes if kind in ("string", "binary")]
    return sum(x or 0 for x in df.agg(F.count("*"), *texts).first())


def buckets_for(df: DataFrame, bytes_each: int, least: int = 12, most: int = 1 << 20) -> int:
    """So many buckets that each holds about ``bytes_each`` of the input's estimate."""
    return int(min(most, max(least, estimated_bytes(df) // bytes_each)))


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside lambdas.

    A column that a lambda refers to would be evaluated again for each element.
    """
    return F.transform(F.array(value), body)[0]


def long_array(spark: SparkSession, values: list[int]) -> Column:
    """A literal array of longs, also of many (``F.lit`` makes an expression of each element).

    Its longs are packed: as a Java array they would be boxed, and written out in every text of a plan.
    """
    jvm = spark.sparkContext._jvm
    data = bytearray(struct.pack(f">{len(values)}q", *values))
    buffer = jvm.java.nio.LongBuffer.allocate(len(values)).put(jvm.java.nio.ByteBuffer.wrap(data).asLongBuffer())
    catalyst, types = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql.types.DataTypes
    packed_longs = catalyst.UnsafeArrayData.fromPrimitiveArray(buffer.array())
    literal = catalyst.Literal(packed_longs, types.createArrayType(types.LongType, False))
    return _column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(literal))


@contextmanager
def large_maps(spark: SparkSession, bits: int):
    """Let aggregates of numbers keep ``2 ** bits`` keys in the map that is generated for them (by default 65,536; the others are slower)."""
    key = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(bits))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def runtime_filters(spark: SparkSession):
    """Let Spark sift the large side of a join by a Bloom filter of the small side's keys before it is shuffled."""
    keys = {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
