"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

A store is a folder with two tables, partitioned by batch: ``ledger`` (signed rows per id and version: what an insert
adds, minus what a delete or the old side of a revision takes away) and ``totals`` (their sums by source, language and
version). A batch is written under its name, its totals last. A name whose totals are there is done: sent again, it
changes nothing. A batch that was interrupted has left rows in the ledger but no totals; nobody reads those rows, and until
it has been sent again, which replaces them, other batches are refused. Totals are the sum over the batches: small rows,
added. The ledger is also partitioned by a hash of the id, and a commit reads only the buckets that its ids fall in.

Changes are rows with ``op`` (insert, delete, revise), ``doc_id``, ``source``, ``lang``, ``version`` and ``tokens``. A delete needs
no count, and a delete or revision no source or language: what they take away is looked up in the ledger, all that stands
under the id and version. Rows that share an id in one batch are documents each, and are added and taken away together; of
changes to an id and version at several ``seq``, those with the last one count. Changing an id that is not there changes
nothing beyond what it adds; an insert of one that an earlier batch has left counts as a revision. NULL ids, sources and
languages are values like any other; a NULL count is 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubwell.llm.batches import pieces, texts
from scrubwell.llm.tokenizer import encoder, read_spec
from scrubwell.llm.words import count_words

KEYS = ("source", "lang", "version")
LEDGER = "doc_id bigint, source string, lang string, version string, documents bigint, tokens bigint, batch string, bucket int"
TOTALS = "source string, lang string, version string, documents bigint, tokens bigint, batch string"
# Parts of the ledger by hash of the id.
BUCKETS = 64
CHANGES = ("op", "doc_id", "source", "lang", "version", "tokens", "seq")

# Versions whose counts Spark computes itself.
NATIVE: dict[str, Callable[[Column], Column]] = {
    "blanks-1": count_words,
    "words-1": lambda text: F.coalesce(F.regexp_count(text, F.lit("[A-Za-z0-9]++|[^\\x00-\\x7F]++")), F.lit(0)).cast("bigint"),
}


def count_tokens(docs: DataFrame, version: str, tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``version`` and ``tokens`` of whole texts; ``tokenizer`` is a file of the tokenizers library
    for a version that is not native."""
    keep = docs.select("doc_id", "source", "lang", "text")
    if version in NATIVE:
        return keep.select("doc_id", "source", "lang", F.lit(version).alias("version"), NATIVE[version](F.col("text")).alias("tokens"))
    if tokenizer is None:
        raise ValueError(f"version {version!r} needs a tokenizer file")
    sent = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def count(batches):
        import pyarrow as pa

        encode = encoder(sent.value).encode
        for batch in pieces(batches):
            numbers = pa.array([len(encode(t)) for t in texts(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "lang")), numbers], names=["doc_id", "source", "lang", "tokens"])

    counted = keep.mapInArrow(count, "doc_id bigint, source string, lang string, tokens bigint")
    return counted.select("doc_id", "source", "lang", F.lit(version).alias("version"), "tokens")


def changes(counted: DataFrame, op: str, seq: int = 0) -> DataFrame:
    """Counted documents as changes of one kind."""
    return counted.select(F.lit(op).alias("op"), "doc_id", "source", "lang", "version", "tokens", F.lit(seq).alias("seq"))


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _batches(spark: SparkSession, path: str) -> set[str]:
    """The names of the batches in a table, from the names of its folders."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return set()
    plain = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    names = (status.getPath().getName() for status in files.listStatus(folder))
    return {plain(n.removeprefix("batch=")) for n in names if n.startswith("batch=")}


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a table, none of them if it has not been written."""
    if not _batches(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _bucket(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS)).cast("int").alias("bucket")


def _standing(spark: SparkSession, store: str, done: set[str], buckets: list[int]) -> DataFrame:
    """What stands in these buckets under each id and version after the batches that are done."""
    if not done:
        return spark.createDataFrame([], LEDGER).drop("batch", "bucket")
    ledger = _read(spark, f"{store}/ledger", LEDGER).filter(F.col("bucket").isin(buckets) & F.col("batch").isin(sorted(done)))
    summed = ledger.groupBy("doc_id", "version", "source", "lang").agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return summed.filter("documents <> 0 OR tokens <> 0")


def commit(store: str, batch: str, batch_changes: DataFrame) -> None:
    """Add a batch of changes to the store, unless it has been added before. ``RuntimeError`` while another batch is
    unfinished.

    The old counts come from a join of the changed ids with their buckets of the ledger. Changes are added up per id before
    they are shuffled, so an id that many rows share is a few rows; texts never travel.
    """
    spark = batch_changes.sparkSession
    done, begun = _batches(spark, f"{store}/totals"), _batches(spark, f"{store}/ledger")
    if batch in done:
        return
    if other := begun - done - {batch}:
        raise RuntimeError(f"batches {sorted(other)} were interrupted; send them again first")
    if batch in begun:
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)
        folder, files = _folder(spark, f"{store}/ledger/batch={escaped}")
        files.delete(folder, True)
    key = ["doc_id", "version"]
    given = batch_changes.select(*CHANGES).groupBy(*key, "seq", "op", "source", "lang").agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens")
    )
    last = F.max("seq").over(Window.partitionBy(*key))
    given = given.withColumn("last", last).filter(F.col("seq").eqNullSafe(F.col("last")))
    touched = [r["bucket"] for r in batch_changes.select(_bucket("doc_id")).distinct().collect()]  # 64 numbers at most
    before = _standing(spark, store, done, touched)
    same = F.col("c.doc_id").eqNullSafe(F.col("l.doc_id")) & F.col("c.version").eqNullSafe(F.col("l.version"))
    taken = before.alias("l").join(batch_changes.select(*key).distinct().alias("c"), same, "left_semi").select(
        *key, "source", "lang", (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens")
    )
    signed = given.filter("op <> 'delete'").select(*key, "source", "lang", "documents", "tokens").unionByName(taken)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(-(-parts // BUCKETS)))
    dealt = signed.select("*", F.lit(batch).alias("batch"), _bucket("doc_id")).repartition(parts, "bucket", spread)
    _replace(dealt.select(*[c.split()[0] for c in LEDGER.split(", ")]), f"{store}/ledger", "batch", "bucket")
    if batch not in _batches(spark, f"{store}/ledger"):
        return  # nothing to add or take away
    own = spark.read.schema(LEDGER).parquet(f"{store}/ledger").filter(F.col("batch") == batch)
    sums = own.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    _replace(sums.withColumn("batch", F.lit(batch)), f"{store}/totals", "batch")


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write the rows' batches in place of what is there under their names; other batches stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Documents and tokens by source, language and version, as of all batches."""
    by_batch = _read(spark, f"{store}/totals", TOTALS)
    summed = by_batch.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
    return summed.filter("documents <> 0 OR tokens <> 0")
