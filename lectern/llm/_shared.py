"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: White space that separates words: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

U64 = (1 << 64) - 1


class NoSharedFolder(RuntimeError):
    """spark.checkpoint.dir is unset on a cluster."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where driver and executors are one process may it be unset (tests); a temporary folder stands in."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _own_folder(spark: SparkSession):
    """(file system, folder) of this application's intermediate tables; it goes when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lectern/{spark.sparkContext.applicationId}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table or archive; see release()."""
    files, folder = _own_folder(spark)
    files.deleteOnExit(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def intermediates(spark: SparkSession) -> set[str]:
    """Names of what this application has under its own folder."""
    files, folder = _own_folder(spark)
    return {x.getPath().getName() for x in files.listStatus(folder)} if files.exists(folder) else set()


def release(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Delete intermediate tables but for `keep`. Only once every result that reads them has been written: a long session need not wait for its end."""
    files, folder = _own_folder(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in intermediates(spark) - set(keep):
        files.delete(path(folder, name), True)


def cut(df: DataFrame, name: str = "cut", made: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: the lineage ends here and lost executors cost nothing. made: gets the path, for discard()."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete the tables in `made`, which nothing reads any more, and have the driver notice which shuffles ended with them."""
    files, _ = _own_folder(spark)
    for path in made:
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
    made.clear()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def copies_dealt(groups: DataFrame, count: str, index: str, most: int) -> DataFrame:
    """Each row of groups `count` times, with `index` from 0. What a row has beyond `most` copies is dealt over the tasks in stretches of `most`."""
    n, each = F.col(count), F.lit(most).cast("long")
    few = groups.where(n <= most).withColumn(index, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    # two steps, so that no array has more than a stretch's entries
    starts = groups.where(n > most).withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / each)))).withColumn("_start", F.col("_start") * each)
    dealt = starts.repartition(*[F.col(f"`{c}`") for c in groups.columns], "_start")
    many = dealt.withColumn(index, F.explode(F.sequence(F.col("_start"), F.least(F.col("_start") + each, n) - 1))).drop("_start")
    return few.unionByName(many)


def text_bytes(docs: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts: sizes the number of buckets, nothing else."""
    return docs.select(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0


def buckets_for(total: float, each: float, least: int = 12) -> int:
    """How many buckets keep one below `each` bytes; proportional to the data, never capped."""
    return max(least, math.ceil(total / each))


def texts_of(batch: pa.RecordBatch, name: str):
    """(row, UTF-8 bytes) of a string or binary column without decoding; null counts as empty."""
    column = batch.column(name)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    for i, value in enumerate(column):
        yield i, (value.as_py() or b"")


ROWS_PER_BATCH = 2000


def small_rows(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `rows` rows, without a copy: what a task makes of a slice is handed on before the next."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_text(docs: DataFrame, keep: dict[str, str], text: str, fields: list, make) -> DataFrame:
    """Map each text's UTF-8 bytes (null: empty) by make()(bytes) -> tuple of `fields`; `keep` renames columns that pass through.

    make() runs once in each task, so automata and vocabularies are built on the executors.
    """
    given = [new for new, old in keep.items() if old == text]  # a text that passes through is sent once
    chosen = docs.select(*[F.col(old).alias(f"_k_{new}") for new, old in keep.items()], *([] if given else [F.col(text).alias("_text")]))
    source = f"_k_{given[0]}" if given else "_text"
    kept = [StructField(new, chosen.schema[f"_k_{new}"].dataType) for new in keep]
    schema = StructType(kept + [StructField(n, t) for n, t in fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        f = make()
        for batch in small_rows(batches):
            rows = [f(data) for _, data in texts_of(batch, source)]
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
            for k in range(len(kept), len(arrow)):
                columns.append(pa.array([r[k - len(kept)] for r in rows], type=arrow.field(k).type))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return chosen.mapInArrow(run, schema)
