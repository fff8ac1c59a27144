"""What the text operators share: reading, the identified texts of a table, lineage, graph components.

A row without ``doc_id`` cannot be referred to and is no document: operators drop it. A null text
counts as an empty one. Operators take ``doc_id`` and ``text`` and ignore further columns, so their
names may clash with nothing. Rows that repeat a ``doc_id`` give a result row each.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of texts that go to Python at once; the engine's own bound, 64 MB, is held in the JVM and in the worker of every task.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Have this session's batches bounded by ``BATCH_BYTES``, unless the session names a bound itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents, null texts as empty."""
    small_batches(docs.sparkSession)
    return docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def per_text(df: DataFrame, rows: Callable[[int, bytes], Iterable[tuple]], schema: pa.Schema, ddl: str,
             prepare: Callable[[], Callable[[int, bytes], Iterable[tuple]]] | None = None) -> DataFrame:
    """Apply ``rows(doc_id, utf-8 text)`` to each (doc_id, text); ``prepare`` makes it once per task instead.

    Output batches are cut by rows, so neither a batch of long texts nor one long text
    gathers more than its own results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = prepare() if prepare else rows
        out: list[tuple] = []
        for batch in batches:
            ids, content = batch.column(0), batch.column(1).cast(pa.binary())
            for i in range(batch.num_rows):
                out.extend(fn(ids[i].as_py(), content[i].as_py()))
                if len(out) >= 20_000:
                    yield _batch(out, schema)
                    out = []
        if out:
            yield _batch(out, schema)

    return df.select("doc_id", "text").mapInArrow(run, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a folder of its own; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="stridelake-llm-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame, compact: bool = False) -> DataFrame:
    """Reliable checkpoint of ``df``, so that branches share it and a lost executor re-reads files.

    A ``compact`` table (a few numbers a row, beside texts of kilobytes) goes to an eighth of the files: each file
    costs the executors a process or two that set its permissions.
    """
    spark = df.sparkSession
    checkpoint_folder(spark)
    if compact:
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(width // 8, min(width, 16)))
    return df.checkpoint(eager=True)


#: Bits of the membership filters: at most BITS / 64 rows of 16 bytes are broadcast, whatever the input.
BITS = 1 << 23


def maybe_in(df: DataFrame, key: Column, members: DataFrame, member_key: Column) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``member_key``: none that is there is lost.

    One-hash Bloom filter as a table of at most ``BITS // 64`` words, so its broadcast is bounded.
    It only thins what a join has to shuffle; a full filter lets every row pass to that join.
    """
    word, bit = "_word", "_bits"
    spot = F.pmod(F.xxhash64(member_key), F.lit(BITS))
    table = (members.select(F.shiftright(spot, 6).alias(word),
                            F.expr("1L").alias("_one"), F.pmod(spot, F.lit(64)).cast("int").alias("_at"))
             .groupBy(word).agg(F.bit_or(F.expr("shiftleft(_one, _at)")).alias(bit)))
    own = F.pmod(F.xxhash64(key), F.lit(BITS))
    probed = df.withColumn("_probe", own)
    joined = probed.join(F.broadcast(table), F.shiftright(F.col("_probe"), 6) == F.col(word))
    hit = F.expr(f"(shiftrightunsigned({bit}, cast(_probe % 64 as int)) & 1L) = 1L")
    return joined.where(hit).drop("_probe", word, bit)


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def without(df: DataFrame, keys: list[Column], gone: DataFrame) -> DataFrame:
    """Rows of ``df``, with their columns, whose ``keys`` are no row of ``gone`` (in the order of its columns).

    Rows that the filter of ``gone`` rules out stay where they are; only the others, few as long as ``gone`` is, meet
    the exact anti join, whose sides are both dealt anew so that a hot key can be split.
    """
    names = [free(df, f"key{k}") for k in range(len(keys))]
    word, bits, flag = free(df, "word"), free(df, "bits"), free(df, "flag")
    gone = cut(gone.distinct().toDF(*names), compact=True)
    spot = F.pmod(F.xxhash64(*names), F.lit(BITS))
    table = (gone.select(F.shiftright(spot, 6).alias(word), F.expr("1L").alias("one"), F.pmod(spot, F.lit(64)).cast("int").alias("at"))
             .groupBy(word).agg(F.bit_or(F.expr("shiftleft(one, at)")).alias(bits)))
    keyed = df.withColumns(dict(zip(names, keys, strict=True))).withColumn(flag, spot)
    probed = keyed.join(F.broadcast(table), F.shiftright(F.col(flag), 6) == F.col(word), "left")
    hit = F.coalesce(F.expr(f"(shiftrightunsigned({bits}, cast({flag} % 64 as int)) & 1L) = 1L"), F.lit(False))
    asked = probed.where(hit).drop(word, bits, flag).join(gone, names, "left_anti")
    return probed.where(~hit).select(*df.columns).unionByName(asked.select(*df.columns))


def one_each(df: DataFrame, ids: DataFrame, by: Column) -> DataFrame:
    """Rows of ``df``; of those whose doc_id is among ``ids`` (doc_id), one for each doc_id and ``by``, any of them."""
    ids = cut(ids.distinct(), compact=True)
    if not ids.take(1):
        return df
    row, key, of = free(df, "row"), free(df, "by"), free(df, "of")
    own = F.col("doc_id").cast("long")
    asked = df.select(F.struct(*(df[c] for c in df.columns)).alias(row), own.alias(of), by.alias(key)).join(ids, F.col(of) == F.col("doc_id"), "left_semi")
    once = asked.groupBy(of, key).agg(F.first(row).alias(row)).select(f"{row}.*")
    return without(df, [own], ids).unionByName(once)


def min_reachable(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b): the smallest reachable node.

    Alternating large-star and small-star rounds; every round is a grouped minimum (combined before
    the shuffle) and a join back on the centre. The minima are dealt once more by another key first, so that
    both sides of the join come out of exchanges of its own and the engine can split a hot hub's star. Rounds
    grow with the logarithm of the longest path. Only a count and a checksum reach the driver.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, state = cut(pairs, compact=True), None
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def lowest(rows: DataFrame, low: Column) -> DataFrame:
        return rows.groupBy("u").agg(low.alias("m")).repartition(width, F.xxhash64("u"))

    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(lowest(both, F.least(F.min("v"), F.col("u"))), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = (large.join(lowest(large, F.min("v")), "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        pairs = cut(small, compact=True)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
