"""What the operators of this subpackage share: inputs, stage tables and Arrow batches of a bounded size."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: The same for operators whose work on a text needs many times its size, and that share executors with other stages.
SMALL_SLICE_BYTES = 1 << 20
#: Rows that Spark hands to Python at once. Texts are long, so the default of 10,000 rows has no useful bound in bytes.
ARROW_ROWS = 128
#: Files of an input whose numbers are broadcast; with more, Spark joins them as it likes.
MOST_FILES = 1_000_000
#: Rows of a file that its numbers leave room for.
FILE_ROWS = 1 << 40
_SHIPPED: set[str] = set()
#: The temporary folder of a local application that names no shared one.
_LOCAL: dict[str, str] = {}


def _ship(spark: SparkSession) -> None:
    """Let workers import this package where the driver alone has it on its path."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if Path.cwd() == root or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "tidemark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(archive))


def prepare(spark: SparkSession) -> SparkSession:
    """Lower the rows of an Arrow batch, unless the session already asks for fewer."""
    _ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder; a local session without one gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.getCheckpointDir():
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="tidemark-")
        _LOCAL[spark.sparkContext.applicationId] = root
    return f"{root.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and the rows stay as they are."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.options(**options).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[written] = path
    return written


#: Where the rows of each DataFrame that ``materialize`` has given are.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written, once nothing reads them any more: what came of them must have been written too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few numbers or names that are broadcast at most.
MOST_ROWS = 400_000


def few(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers, written before: broadcast while there are at most ``MOST_ROWS``; with more, Spark joins them as it likes."""
    return F.broadcast(rows) if rows.count() <= MOST_ROWS else rows


def _reads_files(docs: DataFrame) -> bool:
    """Whether ``docs`` has one row for each row of the Parquet files that it reads, or fewer."""
    plan = docs._jdf.queryExecution().analyzed().toString().splitlines()
    nodes = [re.match(r"[\s:+|-]*(\w*)", line)[1] for line in plan if line.strip()]
    known = nodes[-1] == "Relation" and plan[-1].rstrip().endswith("parquet") and "_metadata" not in map(str.lower, docs.columns)
    return known and {*nodes[:-1]} <= {"Project", "Filter", "SubqueryAlias"}


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has; Spark compares names without case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def written(docs: DataFrame) -> DataFrame:
    """``docs`` if it is read from files, else its rows written: something that ``with_rows`` numbers alike each time."""
    return docs if _reads_files(docs) else materialize(docs, "docs")


def with_rows(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` with a long column that tells its rows apart. It is the same in every job, and each time that the same files are read.

    Rows of files are numbered by file and place in it, whatever the tasks that read them. Spark numbers anything else by task, and
    tasks follow the cores that are there when a job is planned; such rows are written once with their numbers.
    """
    spark = docs.sparkSession
    file, at, number = (free_name(docs, x) for x in ("file_", "at_", "number_"))
    if _reads_files(docs):
        placed = docs.withColumns({file: F.col("_metadata.file_path"), at: F.col("_metadata.row_index")})
        # no more paths than the driver lists to read the files
        files = sorted(r[0] for r in placed.select(file).distinct().collect())
        numbers = spark.createDataFrame([(f, i) for i, f in enumerate(files)], f"{file} string, {number} long")
        numbers = F.broadcast(numbers) if len(files) <= MOST_FILES else numbers
        return placed.join(numbers, file).withColumn(name, F.col(number) * FILE_ROWS + F.col(at)).drop(file, at, number)
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs``, which is read from files, without the rows whose numbers, as ``with_rows`` gives them, are in ``gone`` (row)."""
    name = free_name(docs, "row_")
    numbered = with_rows(docs, name)
    return numbered.join(materialize(gone.select(F.col("row").alias(name)).distinct(), "gone"), name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What this worker remembers between tasks, with the way to forget it. A worker outlives its task and serves other operators.
_REMEMBERED: dict[int, Callable[[], None]] = {}


def _trim() -> None:
    """Give memory that isn't used back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def remember(owner: object | None, forget: Callable[[], None] | None = None) -> None:
    """Only ``owner`` keeps what it remembers; all others forget, and the memory goes back to the machine."""
    others = [k for k in _REMEMBERED if k != id(owner)]
    for k in others:
        _REMEMBERED.pop(k)()
    if others:
        gc.collect()
        _trim()
    if owner is not None and forget is not None:
        _REMEMBERED[id(owner)] = forget


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, memory: object | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``limit`` bytes of ``column``, or one row. All but ``memory`` forgets what it remembers."""
    remember(memory, getattr(memory, "release", None))
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = [0] * batch.num_rows if pa.types.is_null(text.type) else pa.compute.fill_null(pa.compute.binary_length(text), 0).to_pylist()
        first = total = 0
        for i, size in enumerate(sizes):
            if i > first and total + size > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += size
        yield batch.slice(first)
    _trim()  # a worker waits for its next task with as little as it can


def joined(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Join record batches that follow each other while they hold at most ``limit`` bytes of ``column``, for work that is cheaper on many rows."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        if held and total + size > limit:
            yield pa.concat_batches(held)
            held, total = [], 0
        held.append(batch)
        total += size
    if held:
        yield pa.concat_batches(held)


def texts(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as large_string with empty texts for nulls and no offset of its own."""
    text = batch.column(batch.schema.get_field_index(column))
    filled = pa.compute.fill_null(text.cast(pa.large_string()), "")
    return pa.concat_arrays([filled]) if filled.offset == 0 else pa.array(filled.to_pylist(), pa.large_string())
