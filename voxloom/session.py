"""Sessions and scratch space."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own.

    Scratch tables go to one temporary folder, which is removed at the end.
    """
    scratch = tempfile.mkdtemp(prefix="voxloom-")
    atexit.register(shutil.rmtree, scratch, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("voxloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder all executors share.

    The folder is ``spark.checkpoint.dir``. Only a session that runs on this one
    machine may go without it and use a temporary folder instead.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="voxloom-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
