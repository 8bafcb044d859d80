"""Tables written between steps, so that lineage is cut and a lost executor costs one stage, not the whole job."""

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import functions as F

#: Folders of the tables staged inside ``cleared``.
_staged = contextvars.ContextVar("staged", default=None)
_SHUFFLED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark):
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the cluster names one; else, on a local master, a temporary folder of this
    machine; else a folder in the warehouse, which a cluster shares by definition.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = "file://" + tempfile.mkdtemp(prefix="spark-stage-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stage"
    return base.rstrip("/")


def stage(df, label="t"):
    """Write ``df`` as Parquet into the shared folder and read it back. Column names must be unique.

    What was shuffled on the way is deleted when the table is written, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    top = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    if _staged.get() is not None:
        _staged.get().append(top)
    before = spark.conf.get(_SHUFFLED, None)
    spark.conf.set(_SHUFFLED, "true")
    try:
        df.write.parquet(f"{top}/{label}")
    finally:
        spark.conf.unset(_SHUFFLED) if before is None else spark.conf.set(_SHUFFLED, before)
    return spark.read.schema(df.schema).parquet(f"{top}/{label}")


def _delete(spark, folders):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for top in folders:
        at = jvm.org.apache.hadoop.fs.Path(top)
        at.getFileSystem(conf).delete(at, True)


def dropped(*tables):
    """Deletes the tables of ``stage`` that ``tables`` read. Nothing may read them later."""
    for t in tables:
        _delete(t.sparkSession, {f.rsplit("/", 2)[0] for f in t.inputFiles()})


@contextlib.contextmanager
def cleared(spark):
    """Tables staged inside are deleted when it ends, so what is read later must be staged (by ``kept``) and not read them."""
    token = _staged.set([])
    try:
        yield
    finally:
        _delete(spark, _staged.get())
        _staged.reset(token)


def kept(df, label):
    """``stage``, for a table that outlives the ``cleared`` around it."""
    token = _staged.set(None)
    try:
        return stage(df, label)
    finally:
        _staged.reset(token)


#: Keys that ``join_hot`` sends to all executors, at most.
HOT_KEYS = 50_000


def join_hot(rows, keyed, on, n="n"):
    """``rows`` inner-joined with ``keyed``, which has each ``on`` once and in ``n`` how many of ``rows`` have it.

    Keys of more than a fifty-thousandth of those rows (so fewer than HOT_KEYS of them), and of 1,000 at least, are
    broadcast, so that their rows stay where they are; only the others are shuffled. Both tables must be written ones.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    least = max(1000, total // HOT_KEYS)
    hot, rest = keyed.where(F.col(n) > least), keyed.where(F.col(n) <= least)
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on)
    return cold.unionByName(rows.join(F.broadcast(hot), on))


def smallest(rows, order, low, most, n):
    """The first ``most`` of ``n`` rows in the order given, as a pandas frame.

    ``low`` is a test that about 1.2 x ``most`` rows pass, those that come first in the order; only they leave their tasks, so
    what reaches the driver does not grow with the number of tasks. Where too few pass, all rows are asked.
    """
    found = rows.where(low).orderBy(*order).limit(most).toPandas() if n > most else rows.orderBy(*order).toPandas()
    return found if len(found) >= min(most, n) else rows.orderBy(*order).limit(most).toPandas()


def fresh(name, taken):
    """``name``, with underscores in front until no column in ``taken`` has it (columns compare without case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name
