"""Session factory and logging."""

from __future__ import annotations

import logging
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "placeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def new_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; only a local session may do without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
    return f"{shared.rstrip('/')}/placeloom-{uuid.uuid4().hex}"


def written(df, folder: str | None = None):
    """The rows of ``df``, written into a new folder (or ``folder``) and read back: what several plans read is computed once, and lost executors don't matter."""
    at = folder or new_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def logger(name: str, folder: str | None = None) -> logging.Logger:
    """A logger to the console and, with ``folder``, to <folder>/<name>.log; asking again adds no handlers."""
    log = logging.getLogger(f"placeloom.{name}")
    if not log.handlers:
        log.setLevel(logging.INFO)
        shape = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if folder:
            Path(folder).mkdir(parents=True, exist_ok=True)
            handlers.append(logging.FileHandler(Path(folder) / f"{name}.log", encoding="utf-8"))
        for h in handlers:
            h.setFormatter(shape)
            log.addHandler(h)
    return log
