"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..tables import discard, shared_folder, written  # noqa: F401

#: Text bytes that one call of a batch function sees; a longer text comes alone.
SLICE_BYTES = 1 << 19
#: A small table is spread in parts of this many bytes; one of more bytes a core is not small.
SPREAD_BYTES, MOST_SPREAD_BYTES = 1 << 20, 16 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table written to the shared checkpoint folder, so that later reads survive lost executors.

    A written table cuts the lineage as checkpoint() does, but is compressed and known by its true
    size; what a checkpoint keeps of a plan's estimates multiplies with every join of a loop.
    """
    return written(df)


#: Keys that have over a share of one in so many of all rows are joined apart; fewer than so many can.
HOT_KEYS = 1 << 12


def joined_by_hot_key(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """rows (a written table) joined with keyed (a row for each key, n: rows that have it), n left out.

    Rows of hot keys stay where they are and meet a broadcast table; the shuffle has the others. There
    can be fewer than HOT_KEYS hot keys, whatever the tables' sizes.
    """
    keyed = checkpointed(keyed)
    most = (keyed.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS
    hot = F.broadcast(keyed.where((F.col("n") > most) & (F.col("n") > HOT_KEYS)).drop("n"))
    rest = keyed.where((F.col("n") <= most) | (F.col("n") <= HOT_KEYS)).drop("n")
    return rows.join(hot, key).unionByName(rows.join(rest, key))


def delete_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no table is read from any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes of an Arrow batch, where the session sets no limit of its own.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Cuts Arrow batches by bytes: Spark's 10,000 rows of long texts are tens of MB, several times over in each worker and in the JVM."""
    if spark.conf.get(_BATCH_SETTING, "1") == "1":  # unset
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)


_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def unused(names: Iterable[str], base: str) -> str:
    """A column name that clashes with none of names, in any case."""
    taken, name = {n.lower() for n in names}, f"__{base}"
    while name in taken:
        name += "_"
    return name


def spread(df: DataFrame) -> DataFrame:
    """df in more partitions if it is small and comes in fewer files than there are cores.

    A small table is often one file of one row group, which one task would read and work on alone. It
    is dealt out in parts of SPREAD_BYTES, to no more tasks than cores, so only tables of up to
    MOST_SPREAD_BYTES a core are ever moved; anything larger stays as the scan splits it.
    """
    spark = df.sparkSession
    files = len(df.inputFiles())
    cores = spark.sparkContext.defaultParallelism
    if not 0 < files < cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= MOST_SPREAD_BYTES * cores and files < (wanted := min(cores, -(-size // SPREAD_BYTES))):
        return df.repartition(wanted)
    return df


def release_memory() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and what they hold back adds up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text each."""
    lengths = pc.binary_length(texts).to_pylist()
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


Batch = Callable[[list[str]], Sequence]


def map_text(
    df: DataFrame,
    factory: Callable[[], Batch],
    fields: T.StructType | str,
    text: str = "text",
    keep: Sequence[str] | None = None,
    given: Sequence[str] = (),
) -> DataFrame:
    """The kept columns of df and what the batch function returns for each text.

    factory() is called once for each task and gives a function from a list of texts to a list of
    columns, in the order of fields. A null text is passed as empty. A kept column whose name a
    field has is dropped. The batch function gets the values of the kept columns that given names
    after the texts. Rows are streamed in slices, so memory follows SLICE_BYTES and the longest text.
    """
    fields = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    names = set(fields.names)
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    name = unused(kept, "text")
    src = spread(df.select(*(F.col(f"`{c}`") for c in kept), text_or_empty(text).alias(name)))
    schema = T.StructType([*(src.schema[c] for c in kept), *fields])
    arrow = to_arrow_schema(fields)

    def run(batches):
        fn = factory()
        for batch in batches:
            at = batch.num_columns - 1
            for a, b in _slices(batch.column(at)):
                part = batch.slice(a, b - a)
                made = fn(part.column(at).to_pylist(), *(part.column(kept.index(c)).to_pylist() for c in given))
                cols = [part.column(i) for i in range(part.num_columns) if i != at]
                new = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, *new], [*kept, *arrow.names])
        release_memory()

    return src.mapInArrow(run, schema)


def filter_text(df: DataFrame, factory: Callable[[], Callable[..., Sequence[bool]]], text: str = "text", given: Sequence[str] = ()) -> DataFrame:
    """The rows of df, all columns as they are, whose text the batch function says True to; given and nulls as for map_text()."""
    src = spread(df.select(*(F.col(f"`{c}`") for c in df.columns), text_or_empty(text).alias(unused(df.columns, "text"))))

    columns = [df.columns.index(c) for c in given]

    def run(batches):
        fn = factory()
        for batch in batches:
            at = batch.num_columns - 1
            for a, b in _slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yes = pa.array(fn(part.column(at).to_pylist(), *(part.column(i).to_pylist() for i in columns)), pa.bool_())
                out = part.filter(yes)
                if out.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [out.column(i) for i in range(out.num_columns) if i != at],
                        [n for i, n in enumerate(out.schema.names) if i != at],
                    )
        release_memory()

    return src.mapInArrow(run, df.schema)
