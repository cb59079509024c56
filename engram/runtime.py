"""Session helpers: shared scratch space, lineage cuts, table readers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "engram") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests, local runs) a temporary folder is
    made and set, so a cluster never writes to machine-local space.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    present = sc._jsc.sc().getCheckpointDir()
    if present.isDefined():
        return present.get().rsplit("/", 1)[0]
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="engram-")
    sc.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_SCRATCH: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; removed when the application ends."""
    root = f"{shared_dir(spark)}/engram-{spark.sparkContext.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH[root] = spark
        atexit.register(_drop, root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


def _drop(root: str) -> None:
    try:
        jvm = _SCRATCH.pop(root).sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # the JVM may be gone already
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read the table back.

    A written Parquet table survives lost executors, keeps column pruning for
    later readers and gives Catalyst a real size, so that it broadcasts such a
    table only below its own threshold.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FILTER_WORDS = 1 << 17


def maybe_among(ids: DataFrame) -> Column:
    """False only where ``_id`` is none of the ids (_id): it keeps whole rows out of a shuffle, the join or count behind it decides.

    One bit for each hash value in 1 MB, whatever the number of ids; with very many of
    them it lets most rows through, but never holds one back.
    """
    place = F.pmod(F.xxhash64("_id"), F.lit(FILTER_WORDS * 64))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    some = ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bits"))
    zeros = ids.sparkSession.range(FILTER_WORDS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = some.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    dense = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits"))
    return F.getbit(F.get(dense.scalar(), word.cast("int")), bit) == 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
