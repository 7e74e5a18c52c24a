"""Session settings and durable intermediate results."""

from __future__ import annotations

import atexit
import contextlib
import os
import pathlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "attesta", cores: str = "*", partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they start.

    Not needed where the package is installed or on the workers' path already.
    """
    root = pathlib.Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "attesta.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "attesta").rglob("*.py")):
            out.write(path, str(path.relative_to(root)))
    spark.sparkContext.addPyFile(archive)


def spread(df: DataFrame) -> DataFrame:
    """Short rows with much work each, dealt to all tasks.

    A scan makes tasks by bytes and row groups, so a small file whose rows are
    exploded or matched against many patterns would keep one core busy.  The
    optimizer moves filters below a repartition, but not below a generator.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    row = F.struct(*[F.col(c) for c in df.columns]).alias("row")
    return df.repartition(tasks).select(F.explode(F.array(row)).alias("row")).select("row.*")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster, or a temporary one in local mode."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Writes inside remove their shuffle files when they end, not when the driver collects its garbage.

    Nothing reads the shuffle files of a step again once it is written.
    """
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def write_step(df: DataFrame, label: str = "step") -> str:
    """Write ``df`` to a new folder under the shared checkpoint folder; its path."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/attesta-{label}-{uuid.uuid4().hex}"
    with shuffles_go(df.sparkSession):
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return path


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut lineage by writing ``df`` to the shared checkpoint folder.

    Written as Parquet rather than RDD blocks: a lost executor costs nothing,
    columns are pruned on re-read, and the planner sees real sizes, so later
    joins broadcast only what is measurably small.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write_step(df, label))
