"""Session settings, and savepoints and shared stages in the shared folder."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even if a later step then needs its own exchange:
    # one person may own a large share of the notifications.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: Files' bytes, and shuffled bytes, that one task of a stage takes. Its sorts and tables hold them unpacked, in
#: several steps of a plan at once: a hundred times as much was measured.
TASK_BYTES = 4 << 20
SPLIT_BYTES = 16 << 20
MOST_PARTITIONS = 20_000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job here relies on; safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return importable(spark)


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it was not installed or submitted with the job."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark


def build_session(app: str = "caselink", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Run what is inside under other settings of the session."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _file_bytes(df: DataFrame) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(str(leaf.stats().sizeInBytes())) for leaf in found if leaf.getClass().getSimpleName() == "LogicalRelation")


@contextmanager
def bounded_tasks(df: DataFrame, copies: int = 1) -> Iterator[None]:
    """Write ``df`` inside: as many tasks as the files that it reads call for, so that what one holds does not
    grow with them. ``copies`` is how often the plan repeats a row. Adaptive execution merges what turns out small.
    """
    spark = df.sparkSession
    partitions = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    asked = int(spark.conf.get(partitions, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(MOST_PARTITIONS, -(-_file_bytes(df) * copies // TASK_BYTES))
    conf = {
        partitions: str(max(asked, wanted)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        "spark.sql.files.maxPartitionBytes": str(SPLIT_BYTES),
    }
    with settings(spark, conf):
        yield


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    There is no other choice: without the setting (or a checkpoint folder set on the context) this
    raises, also on a local master.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def _savepoints(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/savepoints/{spark.sparkContext.applicationId}"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files of this application, deleted with its savepoints."""
    return f"{_savepoints(spark)}/{uuid.uuid4().hex}/{name}"


def savepoint(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and return a frame that reads it back.

    Savepoints lie under the application's own folder and stay until ``release``.
    """
    spark = df.sparkSession
    path = f"{root or _savepoints(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, for the few small files that say what a stage's state is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def content_key(df: DataFrame) -> str | None:
    """A hash of what ``df`` computes: its plan, the files that it reads with their times and sizes, and the
    settings that its values depend on. None if that is not all there is to it: rows that the driver
    sent, or values that differ from run to run.
    """
    spark = df.sparkSession
    fields = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", str(1 << 20))  # whole lists of columns
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        parts = [plan.canonicalized().toString()]
        # The text of a plan does not hold the code of Python functions.
        if not plan.deterministic() or any(word in parts[0] for word in ("Python", "Pandas", "InArrow")):
            return None
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", fields)
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation":
            return None
        relation = leaf.relation()
        if relation.getClass().getSimpleName() != "HadoopFsRelation":
            return None
        parts.append(relation.location().rootPaths().mkString("\n"))
        parts.append(relation.location().allFiles().mkString("\n"))
    parts += [df.schema.json(), spark.version]
    parts += [str(spark.conf.get(c, None)) for c in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.caseSensitive")]
    return hashlib.sha256("\x00".join(parts).encode()).hexdigest()[:32]


def _read_marker(spark: SparkSession, home: str) -> str | None:
    place, files = _path(spark, f"{home}/committed")
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write_file(spark: SparkSession, path: str, text: str = "") -> None:
    place, files = _path(spark, path)
    stream = files.create(place, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _bucketed_table(df: DataFrame, path: str, by: str, buckets: int) -> str:
    """The session's table over the bucketed files at ``path``, made where it is not known yet. It is
    external: dropping it leaves the files."""
    spark = df.sparkSession
    table = "bucketed_" + hashlib.sha256(path.encode()).hexdigest()[:24]
    columns = df._jdf.schema().toDDL()
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"CLUSTERED BY (`{by}`) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return table


def bucketed_stage(df: DataFrame, name: str, by: str, root: str | None = None) -> DataFrame:
    """A shared stage in as many buckets of ``by`` as the session has shuffle partitions.

    Windows and groupings that have ``by`` among their keys, and joins with a stage of as many buckets, read it
    without an exchange. A bucket is read by one task, so a value's rows must be bounded before. A
    frame without a content key is written for this application alone.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(path: str) -> None:
        table = _bucketed_table(df, path, by, buckets)
        # Rows are dealt as they are bucketed: one file a bucket, whatever the number of tasks before.
        df.repartition(buckets, by).write.insertInto(table)

    def read(path: str) -> DataFrame:
        return spark.table(_bucketed_table(df, path, by, buckets))

    return _stage(df, f"{name}-{by}-{buckets}", root, write, read)


def shared_stage(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Like :func:`savepoint`, but written once for all queries, also of other applications, that compute
    the same from the same files.

    A stage is found by its content key. It is read only through a marker that names one whole
    write, set when that write has ended; of two writers at once the marker names either. Applications
    that use a stage leave an owner file there, before they look for the marker; ``release`` takes it
    away, and the last one deletes the stage.
    """
    read = df.sparkSession.read.schema(df.schema).parquet

    def write(path: str) -> None:
        with bounded_tasks(df):
            df.write.parquet(path)

    return _stage(df, name, root, write, read)


def _stage(
    df: DataFrame, name: str, root: str | None, write: Callable[[str], None], read: Callable[[str], DataFrame]
) -> DataFrame:
    spark = df.sparkSession
    key = content_key(df)
    if key is None:
        path = f"{root or _savepoints(spark)}/{uuid.uuid4().hex}/{name}"
        write(path)
        return read(path)
    home = f"{root or shared_dir(spark)}/stages/{name}-{key}"
    _write_file(spark, f"{home}/owners/{spark.sparkContext.applicationId}")
    found = _read_marker(spark, home)
    if found is None:
        attempt = f"attempt-{uuid.uuid4().hex}"
        write(f"{home}/{attempt}")
        draft = f"{home}/draft-{uuid.uuid4().hex}"
        _write_file(spark, draft, attempt)
        (source, files), (target, _) = _path(spark, draft), _path(spark, f"{home}/committed")
        if not files.rename(source, target):
            files.delete(source, False)
        found = _read_marker(spark, home) or attempt
    return read(f"{home}/{found}")


def _release_stages(spark: SparkSession, root: str) -> None:
    place, files = _path(spark, f"{root}/stages")
    if not files.exists(place):
        return
    for status in files.listStatus(place):
        home = status.getPath().toString()
        own, _ = _path(spark, f"{home}/owners/{spark.sparkContext.applicationId}")
        if not files.delete(own, False):
            continue
        owners, _ = _path(spark, f"{home}/owners")
        if len(files.listStatus(owners)):
            continue
        # Unmark first: who looks from now on writes anew, who looked before has left an owner file.
        marked = _read_marker(spark, home)
        files.delete(_path(spark, f"{home}/committed")[0], False)
        if not len(files.listStatus(owners)):
            files.delete(status.getPath(), True)
        elif marked:
            _write_file(spark, f"{home}/committed", marked)


def release(spark: SparkSession, root: str | None = None) -> None:
    """Delete all savepoints of this application, and the shared stages that no other one uses; frames
    that read them are of no use afterwards. ``root`` as given to :func:`shared_stage`."""
    path, files = _path(spark, _savepoints(spark))
    for table in spark.catalog.listTables(pattern="bucketed_*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    files.delete(path, True)
    _release_stages(spark, root or shared_dir(spark))
