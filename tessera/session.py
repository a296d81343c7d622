"""Session construction and the shared folder used for lineage cuts and sinks."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions.bytes import pack_ids, unpack_ids

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera") -> SparkSession:
    """Build (or reuse) a session with AQE on and UTC time.

    On a cluster the master, memory and ``spark.checkpoint.dir`` come from the
    submit configuration; here we only fill in what is unset.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        # Text rows can be large; keep input splits modest so long documents
        # do not pile into one task.
        "spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the executor; give it the heap
        conf["spark.driver.memory"] = os.environ.get("TESSERA_DRIVER_MEMORY", "8g")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ready(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir`` (or has already called
    ``setCheckpointDir``). Only a local master, whose executors are this process,
    gets a folder of its own when neither is set; on a cluster that is an error,
    since a machine-local folder would lose what executors write.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (remote session): only the conf can name it
        path = spark.conf.get(CHECKPOINT_CONF, None)
        if not path:
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share") from None
        return path
    current = sc.getCheckpointDir()
    if current:
        return current
    path = None
    try:
        path = spark.conf.get(CHECKPOINT_CONF, None)
    except Exception:  # noqa: BLE001 - some sessions refuse core keys at runtime
        path = None
    path = path or sc.getConf().get(CHECKPOINT_CONF, None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-ckpt-")
        try:
            spark.conf.set(CHECKPOINT_CONF, path)
        except Exception:  # noqa: BLE001
            pass
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for sinks and tables)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}") if "://" not in base \
        else f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Rows and bytes of an Arrow batch. A worker that turns a batch into Python objects holds
#: several times its bytes, next to those that the JVM keeps for it.
BATCH_CONF = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bound_batches(spark: SparkSession) -> None:
    """Small Arrow batches between the JVM and Python workers, unless the cluster's configuration names others."""
    try:
        named = spark.sparkContext.getConf()
    except Exception:  # noqa: BLE001 - remote sessions: their server's configuration holds
        return
    for key, value in BATCH_CONF.items():
        if not named.contains(key):
            spark.conf.set(key, value)


def ready(spark: SparkSession) -> None:
    """What a query needs of its session: the shared folder, the package on the executors, bounded batches."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    bound_batches(spark)


#: Spark's own switch; without it shuffle files stay until the driver happens to collect its garbage.
SHUFFLE_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Tables written inside remove the shuffle files of their own jobs as soon as they are written."""
    before = spark.conf.get(SHUFFLE_CONF, None)
    spark.conf.set(SHUFFLE_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CONF) if before is None else spark.conf.set(SHUFFLE_CONF, before)


_TABLES: list[tuple[SparkSession, str]] = []
_PACKED = "tessera.packed"


def stored_packed(c: str) -> Column:
    """A column of byte ids that ``materialize`` is to store as about a byte an id; it reads them back as arrays."""
    return F.col(c).alias(c, metadata={_PACKED: True})


def materialize(df, name: str):
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Used where one expensive intermediate feeds several branches (Spark would
    otherwise recompute it per branch) and to cut lineage: after the write, a
    lost executor re-reads the table instead of re-running everything above.
    ``release`` removes the tables; it runs by itself when the program ends.
    """
    path = scratch_dir(df.sparkSession, name)
    packed = [f.name for f in df.schema.fields if f.metadata.get(_PACKED)]
    if packed:
        df.withColumns({c: pack_ids(c) for c in packed}).write.mode("overwrite").option("compression", "zstd").parquet(path)
        return df.sparkSession.read.parquet(path).withColumns({c: unpack_ids(c) for c in packed})
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder as by ``shared_dir`` that ``release`` removes."""
    path = shared_dir(spark, name)
    if not _TABLES:
        atexit.register(release)
    _TABLES.append((spark, path))
    return path


def release() -> int:
    """Remove the folders of ``materialize`` and ``scratch_dir``; frames that read them end here."""
    n = 0
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            n += bool(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True))
        except Exception:  # noqa: BLE001 - the session has ended, or has no JVM of its own
            continue
    return n


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in executor Python workers.

    Pandas UDFs and ``mapInPandas`` functions reference this package; zip it
    once per application and hand it to ``addPyFile`` (Spark distributes it).
    """
    import zipfile

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions ship code differently
        return
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="tessera-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
