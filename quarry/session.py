"""Session helpers.

The library never builds its own session in library code: every public
function takes DataFrames (or a session) from the caller.  ``local_session``
is for tests and ``bench.py`` only.
"""
from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "quarry") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    An already active checkpoint folder is kept as is (setting it again
    would nest a new sub-folder each time).  Otherwise ``spark.checkpoint.dir``
    is read from the session; only when that is unset too a scratch folder is
    created, and only on a local master: on a cluster the executors would not
    see it, so there the setting is required."""
    sc = spark.sparkContext
    active = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if active:
        return active
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables
    (stream checkpoints, sink folders, lineage cuts)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session settings that hold inside the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def listing(spark: SparkSession):
    """While a tree is listed: a few tasks for each core, not one for each of up
    to 10,000 folders."""
    n = 4 * spark.sparkContext.defaultParallelism
    return settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(n)})


_SCRATCH: list[str] = []


def remove_path(spark: SparkSession, p: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(p)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def clear_scratch(spark: SparkSession) -> int:
    """Remove the scratch tables that this process has made so far; call it when
    the results read from them have been written elsewhere.  Returns their number."""
    n = len(_SCRATCH)
    while _SCRATCH:
        remove_path(spark, _SCRATCH.pop())
    return n


def path_exists(spark: SparkSession, p: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (a path
    without scheme belongs to the default file system, as for Spark)."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(p)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hpath)


# Of stored tables: ids and vectors take about half of what Spark's default leaves.
PACKED = {"compression": "zstd"}


def sparing(spark: SparkSession):
    """Writes inside the block leave no shuffle files behind: else they stay until
    the driver happens to collect its garbage."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def local_path(spark: SparkSession, p: str) -> str | None:
    """The folder of a path on a file system that is mounted (``file:``), None
    where the path is in another store."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(p)
    local = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
    return hpath.toUri().getPath() if local else None


def spread(df, factor: int = 1):
    """Round-robin a DataFrame over all task slots when its scan yields fewer
    partitions than the cluster has cores (one big file with few row
    groups).  On a cluster reading many files this is a no-op: the scan
    already has far more splits than cores.  Used before CPU-heavy row-local
    text work (tokenising, chunking, hashing).  A plan that shuffles is left
    as it is: counting its partitions would run it."""
    slots = df.sparkSession.sparkContext.defaultParallelism * factor
    if df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


PIECE_BYTES = 8 << 20


def pieces(batch, column: int, rows: int = 2048):
    """Slices of an Arrow batch, of at most ``rows`` rows, and of about
    ``PIECE_BYTES`` in ``column`` where they have several rows: what a task
    makes of a batch is in memory for one slice."""
    n = batch.num_rows
    each = max(1, batch.column(column).nbytes // max(1, n))
    step = max(1, min(rows, PIECE_BYTES // each))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def cut(df):
    """Materialise once and cut lineage with a reliable checkpoint in the
    shared checkpoint folder (never ``localCheckpoint``: executor-local
    blocks die with their executor)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers, once per SparkContext.

    Workers import the UDF modules by name; on a cluster (or when the driver
    runs from another folder) the package is shipped as a zip with
    ``addPyFile``, the runtime form of ``--py-files``.  The zip is built in
    memory and written through the Hadoop FileSystem API into the shared
    checkpoint folder, so no machine-local temporary folder is involved."""
    import io
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        return
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            if "__pycache__" in base:
                continue
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/_pkg-{uuid.uuid4().hex[:12]}/quarry.zip"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(hpath, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)
