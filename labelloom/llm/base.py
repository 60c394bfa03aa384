"""Registry of the subpackage's queries, table access and staged tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: stands for a missing doc_id wherever ids are ordered: after every other id
LAST_ID = (1 << 63) - 1
#: shuffle files go when an action ends, not when the driver's garbage collector comes upon their plan
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, its equivalent."""
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The whole text; NULL is empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``).

    Only a local session without that setting gets a folder of its own; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="labelloom-"))
    return sc.getCheckpointDir().rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them again.

    Cuts the lineage: what follows survives lost executors without repeating what came before, and a frame that is
    read several times is computed once. The shuffle files of the write go with it, as nothing reads them again.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete staged rows that nothing will read again."""
    for df in frames:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A long text cut at ASCII white space, in pieces of about that many bytes."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        stop = cut.start() if cut else len(text)
        yield text[at:stop]
        at = stop


#: what ``in_order`` numbers rows by: the partition above these bits, the place in the partition below
PLACE_BITS = 33


def in_order(df: DataFrame, *keys: Column | str) -> DataFrame:
    """The rows, staged in ascending order, with ``_place`` (bigint): it ascends with the keys over the whole table.

    Rows are dealt to partitions by ranges of the keys and sorted there. Rows with equal keys are told apart by a number
    of their own, so that a key of any number of rows is spread over as many partitions as its size asks for.
    """
    d = df.withColumn("__row", F.monotonically_increasing_id())
    d = d.repartitionByRange(*keys, F.col("__row")).sortWithinPartitions(*keys, F.col("__row"))
    return staged(d.drop("__row").withColumn("_place", F.monotonically_increasing_id()))
