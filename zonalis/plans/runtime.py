"""Session helpers shared by all operators: table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, app: str = "zonalis") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ZONALIS_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, its lineage cut.

    The folder is the one named in `spark.checkpoint.dir`; only a local session that names none (tests) gets a folder
    of its own.  On a cluster that would be a folder the executors don't share, so there it is an error.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="zonalis-checkpoint-"))
    return df.checkpoint(eager=True)


#: Rows up to which a side is broadcast, and parts a hot key is split into beyond that.
BROADCAST_ROWS, SALTS = 100_000, 32


def keyed_join(rows: DataFrame, per_key: DataFrame, key: str, per_key_rows: int, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` beside the row of `per_key` with the same `key` (unique there), however many rows share a key.

    `per_key_rows`, a count or a bound the caller has, decides: within `limit` per_key is broadcast and the rows stay
    where they are; beyond it every row of per_key is repeated SALTS times and the rows of a key are spread over them.
    """
    if per_key_rows <= limit:
        return rows.join(F.broadcast(per_key), key, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    repeated = per_key.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, unless their PYTHONPATH already leads to it.

    The archive lies in the shared folder where the session names one this process can write to."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if getattr(sc, "_zonalis_shipped", False) or str(root) in map(os.path.realpath, os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    shared = (sc.getConf().get("spark.checkpoint.dir") or "").removeprefix("file://")
    folder = tempfile.mkdtemp(prefix="zonalis-", dir=shared if shared.startswith("/") and os.access(shared, os.W_OK) else None)
    archive = os.path.join(folder, "zonalis_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "zonalis").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(archive)
    sc._zonalis_shipped = True
