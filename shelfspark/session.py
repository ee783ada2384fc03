"""Session helpers: one place that decides the Spark settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings every job here assumes. AQE re-plans joins and coalesces shuffle
# partitions at run time; skew-join splits hot partitions; UTC keeps date
# arithmetic identical to the SQL oracle.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HTML rows are large: keep Arrow batches small for the extraction UDF.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # Post-shuffle stages here are CPU-heavy per row (regex parsing, URL work): let AQE coalesce
    # small shuffles into partitions of >= 256 KB instead of >= 1 MB so they keep their tasks.
    # Large shuffles are unaffected (they are sized by the advisory partition size).
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
    # The rule tables compile into long CASE chains. HotSpot never JIT-compiles a method above
    # 8000 bytes of bytecode, so stages whose generated method is larger fall back to
    # per-expression codegen (small, JIT-compiled methods) instead of running interpreted.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a DataFrame over the cluster's cores when it arrives in fewer partitions than
    that (a few large input files) and CPU-heavy per-row work follows. A no-op on real inputs,
    which come in far more splits than cores."""
    if df.isStreaming:                       # micro-batches are sized by the source
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    n = df.rdd.getNumPartitions()
    return df.repartition(target) if n < target else df


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "shelfspark",
                  extra: dict | None = None) -> SparkSession:
    """Session for tests, the bench and local runs. On a cluster use the cluster's session
    and call :func:`apply_engine_conf` on it instead."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("SHELFSPARK_DRIVER_MEMORY", "16g"))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # local JVM only (a cluster sets its own JVM options): compile huge generated methods too
         .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods"))
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_engine_conf(spark: SparkSession) -> SparkSession:
    for k, v in ENGINE_CONF.items():
        spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only when it is unset and the master is local (tests) do we create one ourselves."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if d:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(d)
        return d
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    d = tempfile.mkdtemp(prefix="shelfspark-ckpt-")
    spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) into the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, for plans that read it several times, each some columns."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that a job started from any folder finds it.

    The zip is read on the driver alone; Spark copies it to the executors."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="shelfspark-code-"), "shelfspark.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)
