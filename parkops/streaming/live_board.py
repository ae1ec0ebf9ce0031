"""The status board (D6) as a Structured Streaming aggregation.

The application's "real-time status tracking" is a page reload that re-runs
the status counts. Here new request files arriving in a folder update the
counts incrementally: a file stream of orders (service requests) and parts
(registration requests), mapped by the same view functions as the batch
path, unioned and counted by status in complete mode. State is one row per
status, so it stays bounded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parkops.operators.boards import status_domain
from parkops.session import checkpoint_dir
from parkops.sources import schema as S
from parkops.sources import views as V


def _file_stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    schema = V.read_driver(spark, folder, table).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet")
            .option("maxFilesPerTrigger", 1).parquet(folder))


def live_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming DataFrame of (status, n) over both request kinds."""
    req = V.service_request(_file_stream(spark, folder, "orders")).select("status")
    reg = V.vehicle_registration_request(_file_stream(spark, folder, "part")).select("status")
    return (req.unionByName(reg).filter(F.col("status").isin(*S.REQUEST_STATUSES))
            .groupBy("status").agg(F.count(F.lit(1)).alias("n")))


def start(spark: SparkSession, folder: str, name: str | None = None,
          checkpoint_location: str | None = None) -> StreamingQuery:
    """Run the board into an in-memory table. The stream's checkpoint lives in
    the session's shared checkpoint folder (``spark.checkpoint.dir``) unless a
    location is given; without either the stream is not started."""
    name = name or f"live_status_{uuid.uuid4().hex[:8]}"
    base = checkpoint_dir(spark)
    if checkpoint_location is None and base is None:
        raise ValueError("set spark.checkpoint.dir (a shared folder) or pass checkpoint_location")
    ckpt = checkpoint_location or f"{base.rstrip('/')}/streams/{name}"
    return (live_status_counts(spark, folder).writeStream.outputMode("complete")
            .format("memory").queryName(name).option("checkpointLocation", ckpt).start())


def snapshot(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """Current board: the fixed status domain with 0 for statuses not seen yet."""
    counts = spark.table(query.name)
    return (F.broadcast(status_domain(spark)).join(counts, "status", "left")
            .select("status", F.coalesce("n", F.lit(0)).alias("count")))
