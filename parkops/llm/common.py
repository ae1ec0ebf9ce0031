"""Shared helpers: reading tables, the shared folder, written intermediate tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: doc_id given to a null id inside an operator: larger than every real id.
NULL_ID = (1 << 63) - 1


#: Bytes of an Arrow batch on its way to a Python worker, about.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows here hold whole texts and blocks, so batches are bounded by bytes: the session's
    bound (Spark's own is 64 MB, held by the executor and its worker at once) is lowered to
    ``BATCH_BYTES`` unless it is given as fewer bytes already."""
    now = spark.conf.get(_BATCH_CONF).lower().removesuffix("b")
    if not (now.isdigit() and int(now) <= BATCH_BYTES):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session (tests) may do without; it gets a scratch folder. On a
    cluster without the setting this fails instead of writing to local disks.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        return d
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="parkops-llm-"))
    return spark.sparkContext.getCheckpointDir()


#: Paths that ``written`` made inside ``noting``, for ``drop``.
_NOTED: list[list[str]] = []


#: Buckets a written table has at most (Spark's own bound).
MAX_BUCKETS = 100_000


def written(df: DataFrame, label: str, key: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the
    lineage, survives lost executors, and every later use sees the same rows. With a
    ``key`` the table is bucketed by it, a bucket a shuffle partition, so that joins by
    the key don't shuffle its rows again."""
    spark = df.sparkSession
    small_batches(spark)
    name = f"parkops_{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name.replace('_', '-')}"
    if key is None:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
        (df.repartition(n, key).write.format("parquet").option("path", path).bucketBy(n, key)
         .saveAsTable(name))
        out = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # from the catalogue only: the files stay
    for paths in _NOTED:
        paths.append(path)
    return out


@contextlib.contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Adds the paths of the tables ``written`` meanwhile."""
    _NOTED.append(paths)
    try:
        yield
    finally:
        _NOTED.remove(paths)


def drop(spark: SparkSession, paths: list[str], reader: DataFrame | None = None) -> None:
    """Delete tables that ``written`` made and nothing reads any more; those that
    ``reader`` reads stay, in ``paths`` too."""
    used = {f.rsplit("/", 2)[-2] for f in reader.inputFiles()} if reader is not None and paths else set()
    for path in [p for p in paths if p.rsplit("/", 1)[-1] not in used]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        paths.remove(path)


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no taken name is like it (in any case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null text: empty), the columns most operators need."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def release() -> None:
    """Give freed memory back to the system: Python workers live on after a task, and what
    they hold counts against the next one. Does nothing where libc has no such call."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_HELD: dict = {}


def only(key: tuple, make: Callable):
    """``make()``, kept in this Python worker until another key is asked for: a worker
    outlives its task, so it holds one tokenizer or model at a time."""
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = make()
        release()
    return _HELD[key]


def tidy(fn: Callable, holds: bool = False) -> Callable:
    """``fn`` over batches, with memory released when its task ends. Unless it ``holds`` a
    tokenizer or model by ``only``, what an earlier task left in the worker is dropped."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds and _HELD:
            _HELD.clear()
            release()
        try:
            yield from fn(batches)
        finally:
            release()
    return run


def map_rows(fn: Callable[[list, list], Iterable[tuple]], schema: pa.Schema,
             rows_per_batch: int = 2048) -> Callable[[Iterator[pa.RecordBatch]],
                                                     Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function from ``fn(ids, texts) -> rows``. Output rows are
    sent on in small batches, so memory stays bounded by a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for row in fn(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out.append(row)
                if len(out) >= rows_per_batch:
                    yield to_batch(out, schema)
                    out = []
        if out:
            yield to_batch(out, schema)
    return tidy(run, holds=True)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)
