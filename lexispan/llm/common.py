"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: ASCII upper case, lowered byte by byte: other letters keep their case.
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        have = spark.sparkContext.getCheckpointDir()
        master = spark.sparkContext.master
        if have is None and not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = have or tempfile.mkdtemp(prefix="lexispan-checkpoint-")
        if not have:
            spark.sparkContext.setCheckpointDir(root)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


#: The folders of this process's intermediate tables, by the session's application.
_folders: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder; release() removes all of them."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_root(spark).rstrip('/')}/lexispan-{uuid.uuid4().hex}"
        atexit.register(_release_at_exit, spark)
    return f"{_folders[app]}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Removes the intermediate tables that this session's queries wrote. Results that are still lazy can't be read after it."""
    folder = _folders.pop(spark.sparkContext.applicationId, None)
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _release_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:  # a stopped session can't reach the store any more
        release(spark)


#: Spark drops a query's shuffle files at its end if this is on; a stage that is retried within the query makes them anew.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, compression: str = "zstd", clean: bool = False, dictionary: bool = True) -> DataFrame:
    """df, written to the shared folder and read from there: the lineage ends and a lost executor loses nothing.

    clean: the shuffle files that the writing needed go as soon as the table is there. dictionary: whether repeated
    values are worth looking for.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    was = spark.conf.get(CLEANUP, "false")
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.option("compression", compression).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def id_remainder(doc_id: int | None, m: int) -> int:
    """crc32 of the id as text, modulo m; a null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % m


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python a thousand at a time and in about 8 MB, unless the session says otherwise: texts can be long, and both sides hold whole batches outside the heap."""
    for name, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")):
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, ours)


def strings(column: pa.Array) -> list[str]:
    """The texts of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 512, of: str = "text", chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has at most so many rows and, if more than one, about so many bytes of text."""
    for b in batches:
        column = b.column(b.schema.get_field_index(of))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = used = 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= rows or used + n > chars):
                yield b.slice(start, i - start)
                start, used = i, 0
            used += n
        if start < len(sizes):
            yield b.slice(start)


#: What this Python worker keeps from task to task: of the operator that ran last alone.
_kept: dict = {}


def begin(key: object, make: Callable[[], object] = lambda: None) -> object:
    """Called where a worker's task begins: what make made in an earlier task of the same key, or makes now.

    A pipeline's stages run in the same workers, so what another operator kept goes first.
    """
    if key not in _kept:
        _kept.clear()
        gc.collect()
        _kept[key] = make()
    give_back()
    return _kept[key]


def give_back() -> None:
    """Returns to the system what the allocators hold unused: all workers and the JVM share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def column(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(df: DataFrame) -> Column:
    """All of df's columns in a struct named row, which keeps them apart from added ones, whatever their names."""
    return F.struct(*map(column, df.columns)).alias("row")


def by_rows(docs: DataFrame, fn: Callable[[list[str]], dict[str, list]], added: str, text: str = "text") -> DataFrame:
    """All of docs' rows and columns, in a struct named row, with the columns named in added, which fn makes from the texts (null: empty)."""
    small_batches(docs.sparkSession)
    rows = docs.select(whole(docs))
    schema = StructType([StructField("row", rows.schema["row"].dataType), *StructType.fromDDL(added)])
    kinds = to_arrow_schema(StructType.fromDDL(added))  # Spark takes no other types than the declared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(added)
        for b in batches:
            rows = b.column(0)
            for start in range(0, max(len(rows), 1), 128):
                some = rows.slice(start, 128)
                made = fn(strings(pc.struct_field(some, [text])))
                yield pa.RecordBatch.from_arrays([some, *(pa.array(made[f.name], f.type) for f in kinds)], ["row", *kinds.names])
            give_back()

    return rows.mapInArrow(run, schema)


def ranges(docs: DataFrame, by: str, rows: int = 8000, least: int = 24, most: int = 1 << 18) -> tuple[DataFrame, list[int]]:
    """docs with a column _shard, 0 to n - 1, ascending with the column by, and the cuts between shards.

    n follows the number of rows. The cuts are approximate quantiles over all rows (the scan reads that
    column alone); the driver holds `most` of them, and beyond most * rows rows shards are as many and grow,
    which callers bear as they stream a shard. by should tell rows apart, as numbered() does, or equal ones and
    nulls (shard 0) share a shard.
    """
    from pyspark.ml.feature import Bucketizer

    small_batches(docs.sparkSession)
    n = docs.select(by).count()
    k = max(1, min(most, max(least, -(-n // rows)), n // 200))
    cuts = docs.select(F.percentile_approx(F.col(by).cast("double"), [i / k for i in range(1, k)] or [0.5], 4 * k).alias("c")).first()["c"] if k > 1 else []
    cuts = sorted({float(x) for x in cuts or []})
    if not cuts:
        return docs.withColumn("_shard", F.lit(0)), []
    cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_by", outputCol="_cut")
    out = cut.transform(docs.withColumn("_by", F.coalesce(F.col(by).cast("double"), F.lit(-1e300))))
    return out.withColumn("_shard", F.col("_cut").cast("int")).drop("_by", "_cut"), cuts


def numbered(docs: DataFrame, below: int | None = None) -> DataFrame:
    """_n and row, a struct of docs' columns. _n is a long that orders rows as doc_id does, and is theirs alone.

    It is doc_id itself, unless ids repeat, are null or don't lie in 0 to below: then rows are numbered from 0 by id
    (null first) and, within one id, by a hash of the text and their place in the input. These rows are dealt by
    ranges of all three, so neither rows without an id nor repeated ones meet in one task.
    """
    rows = docs.select(whole(docs))
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("k"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    inside = below is None or ids["k"] == 0 or 0 <= ids["a"] and ids["b"] < below
    if inside and ids["n"] == ids["k"] and not docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return rows.select(F.col("row.doc_id").alias("_n"), "row")
    order = [F.col("_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_in").asc()]
    keyed = rows.select("row", F.col("row.doc_id").alias("_id"), F.xxhash64("row.text").alias("_hash"), F.monotonically_increasing_id().alias("_in"))
    kept = written(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("_m"), "row"), "numbered", clean=True)
    before, total = [], 0
    for r in kept.groupBy(F.shiftright("_m", 33).alias("p")).count().orderBy("p").collect():  # a number a partition
        before.append((r["p"], total))
        total += r["count"]
    places = docs.sparkSession.createDataFrame(before, "_p long, _before long")
    within = F.col("_m").bitwiseAND((1 << 33) - 1)
    return kept.withColumn("_p", F.shiftright("_m", 33)).join(F.broadcast(places), "_p").select((F.col("_before") + within).alias("_n"), "row")
