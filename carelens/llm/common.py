"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import checkpoint_dir, prepare, scratch_dir

# Text handed to a per-text function at once (bounds a Python worker's memory).
CHUNK_BYTES = 4 << 20
# Rows (or spans) of verdicts, about 60 bytes each, up to which they are broadcast to the
# texts; beyond that a bitmap of so many bits (2 MB for 2^24) tells which texts need the join.
FEW, FILTER_BITS = 200_000, 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read whole."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back:
    lineage is cut, and later uses read only the columns they need."""
    path = scratch_dir(df.sparkSession, "carelens-llm")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def document_key():
    """What names a document: its doc_id as text or, where that is null, a digest of its text."""
    return F.coalesce(F.col("doc_id").cast("string"),
                      F.concat(F.lit("text:"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))


def parted(docs: DataFrame, side: DataFrame, key, on: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose ``key`` may be in column ``on`` of ``side``, and the
    others (none of which is), by a bitmap of hashes of FILTER_BITS bits at most."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = cut(side.select(place(F.col(on)).alias("h")).select(
        F.bitmap_bucket_number("h").alias("_bucket"), F.bitmap_bit_position("h").alias("p"))
        .groupBy("_bucket").agg(F.bitmap_construct_agg("p").alias("_bits")))
    h = fresh("_h", docs)
    at = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.get(F.transform(F.array(byte), lambda b: b.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0), F.lit(0)), F.lit(False))
    tested = docs.withColumn(h, place(key)).join(F.broadcast(bits), F.bitmap_bucket_number(h) == F.col("_bucket"), "left")
    return tested.where(bit).select(*docs.columns), tested.where(~bit).select(*docs.columns)


def without(docs: DataFrame, bad: DataFrame, key) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in the one column of ``bad``.  Texts
    stay where they are: few verdicts are broadcast, and of many only the texts that
    a bitmap cannot clear are shuffled."""
    bad = cut(bad.distinct())
    on = bad.columns[0]
    if bad.count() <= FEW:
        return docs.join(F.broadcast(bad), key == bad[on], "left_anti")
    maybe, never = parted(docs, bad, key, on)
    return maybe.join(bad, key == bad[on], "left_anti").unionByName(never)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def chunks(batch: pa.RecordBatch, column: int):
    """Row slices of an Arrow batch with about CHUNK_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def per_text(df: DataFrame, make: Callable[[], Callable[[list], dict]], ddl: str,
             keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Add the columns of ``ddl`` to ``keep``: ``make()`` builds, once per task,
    a function from a list of texts (null as None) to {column: list of values}.
    Only ``keep`` and the text are read, so other columns cannot clash."""
    prepare(df.sparkSession)
    new = fields(ddl)
    src = df.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType(src.schema.fields[:-1] + new)
    arrow = to_arrow_schema(schema)

    def run(batches):
        fn = make()
        for whole in batches:
            last = whole.num_columns - 1
            for b in chunks(whole, last):
                out = fn(b.column(last).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(i).cast(arrow.field(i).type) for i in range(last)]
                    + [pa.array(out[f.name], type=arrow.field(f.name).type) for f in new],
                    schema=arrow)
            # Workers live as long as the executor: give freed batches back.
            pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, schema)


def in_batches(rows, schema: pa.Schema, size: int = 5000):
    """Arrow batches of an iterator of tuples."""
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): (node, root), root being
    the smallest node reachable.  Alternating large-star / small-star rounds;
    every round is two min-aggregates (combined map-side) and two joins, written
    to the checkpoint folder.  Only a row count and a checksum reach the driver."""
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        seen = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state or seen[0] == 0:
            break
        state = seen
        both = e.select(F.col("u").alias("n"), F.col("v").alias("m")).union(e.select("v", "u"))
        low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = both.join(low, "n").where("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        e = cut(small.union(low.select("u", F.col("low"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select("v", "v").distinct())
