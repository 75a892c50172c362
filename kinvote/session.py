"""Session builder, and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "kinvote", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution (skew-join splitting included) left on.

    Sizes (shuffle partitions, memory) belong to the deployment and come in through
    ``conf`` or ``spark-submit``; library code never sets them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_shipped: set[str] = set()  # applications that have the package


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the executors this package, so that functions that run there can import it.

    Once an application. Spark's own file server hands the archive out; the local copy is
    what the driver serves and nothing reads it elsewhere.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="kinvote-")) / "kinvote.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


_local_roots: dict[str, str] = {}  # application id -> folder, where the session names none


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local session that names none (tests) gets a temporary folder of its own; on a
    cluster a folder of one machine would be out of the other machines' reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="kinvote-")
    return _local_roots[context.applicationId]


_owners: list[list[str]] = []  # open scopes, innermost last: the folders made in each


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Everything written to scratch inside is deleted on leaving.

    For results that are complete by then (collected, or written elsewhere). Tables made
    outside any scope stay until ``release_scratch``, as a returned DataFrame may read them.
    """
    made: list[str] = []
    _owners.append(made)
    try:
        yield
    finally:
        _owners.remove(made)
        for path in made:
            _delete(spark, path)


@contextmanager
def scratch_list(spark: SparkSession) -> Iterator[list[str]]:
    """Gives the list of the scratch folders made inside; the caller deletes them in time."""
    made: list[str] = []
    _owners.append(made)
    try:
        yield made
    finally:
        _owners.remove(made)


def delete_scratch(spark: SparkSession, folders: list[str]) -> None:
    """Delete the folders of a ``scratch_list``; the list is empty afterwards."""
    while folders:
        _delete(spark, folders.pop())


def release_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application."""
    _delete(spark, _run_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def _run_folder(spark: SparkSession) -> str:
    return os.path.join(scratch_dir(spark), f"kinvote-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, below one folder per application.

    The innermost open ``scratch_scope`` owns it; else the application does.
    """
    path = os.path.join(_run_folder(spark), f"{name}-{uuid.uuid4().hex}")
    if _owners:
        _owners[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder and return the written table.

    Cuts the lineage: later branches scan the table, column-pruned, where they would
    otherwise repeat cleaning and tokenising, and a lost executor costs one re-read. ``options``
    are the writer's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
