"""Session and cluster-folder helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster passes its own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("episodika")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without the setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="episodika-")
    return _LOCAL_FOLDERS[app]


_STORED: dict[tuple[str, str, str], str] = {}


def stored_once(spark: SparkSession, name: str, source: str, write: Callable[[str], None]) -> str:
    """A shared folder that ``write`` fills the first time this application asks for it; a failed try is not remembered.

    ``source`` is what the folder is made of.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _STORED:
        path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        write(path)
        _STORED[key] = path
    return _STORED[key]


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The same rows read back from a table written into the shared folder.

    Ends a growing plan or a part used several times. Unlike a checkpoint the written table has a known size, so later
    joins can choose a broadcast; like one it survives the loss of executors. Long texts are worth a stronger ``compression``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
