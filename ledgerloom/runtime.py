"""Session, table and durable-intermediate helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "ledgerloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Where it is unset, a local master gets a
    folder of its own, removed at exit; any other master is refused, since its executors would each write to
    a disk that the others cannot read."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master or 'this master'} share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        named = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's file system remove path when its JVM ends; results may be read until then."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def durable(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut and a lost
    executor costs nothing. Used where a result is read more than once. The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"t-{uuid.uuid4().hex}")
    df.write.parquet(path)
    _delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stamp(spark: SparkSession, path: str) -> tuple | None:
    """Names, sizes and times of the files under a path, so that one can tell whether they changed; None if unknown."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return None
    where = jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that is small by its nature (a reference list, a vocabulary). More than most rows raise:
    such a table is none, and the driver must not take it in."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


#: Rows up to which a lookup side may be broadcast; beyond it the join is salted.
BROADCAST_ROWS = 50_000
SALTS = 16


def lookup_join(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a keyed lookup (one row per key) whose size is counted first: broadcast up to limit rows,
    else a join on key and salt, so that a hot key of df is spread over SALTS tasks."""
    from pyspark.sql import functions as F

    n = small.limit(limit + 1).count()
    if n <= limit:
        return df.join(F.broadcast(small), keys, how)
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once per context, whatever their Python path is."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_ledgerloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="ledgerloom-code-")) / "ledgerloom_code.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, f"ledgerloom/{p.relative_to(root)}")
    sc.addPyFile(str(out))
    sc._ledgerloom_shipped = True
