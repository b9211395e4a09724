"""Session defaults, table access, durable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured rows times width stay below this.
BROADCAST_BYTES = 64 << 20


ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application.

    The archive stays until the driver ends, because executors that start later fetch it too. Only a
    local session whose PYTHONPATH names the package's folder needs none: its workers inherit the path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_papyra_shipped", False):
        return
    inherits = str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if not (inherits and (sc.master == "local" or sc.master.startswith("local["))):
        folder = tempfile.mkdtemp(prefix="papyra-package-")
        atexit.register(shutil.rmtree, folder, True)
        sc.addPyFile(shutil.make_archive(f"{folder}/papyra-package", "zip", ROOT, "papyra"))
    sc._papyra_shipped = True


def build_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    paths = os.environ.get("PYTHONPATH", "")
    if str(ROOT) not in paths.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), paths]))  # the workers inherit it
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("papyra")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name``; filters and projections are left to the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, under the session's checkpoint folder (see ``cut``)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="papyra-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``. Where the session names none, a temporary
    one is made in local sessions only; on a cluster it would be a folder of the driver's machine.
    """
    shared_folder(df.sparkSession, "unused")  # sets the checkpoint folder
    return df.checkpoint(eager)


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Repartition a scan that has fewer tasks than the cluster has cores.

    Used before CPU-heavy Python stages; a scan that already has enough splits is left alone.
    The move is by row, so a hot key cannot land in one task.
    """
    want = least or 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)


def maybe_broadcast(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the measured row count times ``row_bytes`` is under ``limit``.

    ``small`` should be cheap to count (a checkpoint or a grouped table). Above the limit the
    plain DataFrame is returned and the join shuffles.
    """
    most = limit // row_bytes
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small
