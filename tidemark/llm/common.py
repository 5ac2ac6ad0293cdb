"""What the corpus operators share: reading, written intermediate tables, skew-safe lookups, the learning split."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.session import configure
from tidemark.sources.stored import stored

# A group is hot when it holds more than 1/HOT_SHARES of all rows; so there are fewer than HOT_SHARES hot groups.
HOT_SHARES = 256
# Rows a Python worker holds at once; whole texts may be long, so batches are short.
BATCH_ROWS = 512
# A sieve has this many bits per entry, and at most so many bits (32 MB).
SIEVE_ROOM = 32
SIEVE_BITS = 1 << 28


def prepare(spark: SparkSession) -> SparkSession:
    """Library settings plus short Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe against lost executors."""
    return stored(df, f"llm-{name}")


def text_of(text: str = "text") -> Column:
    """The whole text; null reads as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that nothing is learnt from; a null id falls into it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, how: str = "left") -> DataFrame:
    """``rows`` with the columns of their row in ``groups`` (one per ``key``), however uneven the groups are.

    ``size`` counts the rows of a group. Groups above 1/HOT_SHARES of all rows number fewer than HOT_SHARES, whatever
    the input, so they are broadcast; all others are joined by a shuffle whose partitions stay even. Both inputs
    should be written tables, as each is read twice. Null keys match nothing.
    """
    total = rows.count()
    hot = F.col(size) * HOT_SHARES > total
    large = groups.where(hot)
    names = large.select(F.col(key).alias("_hot"))
    here = rows.join(F.broadcast(large), key)
    there = rows.join(F.broadcast(names), F.col(key) == F.col("_hot"), "left_anti").join(groups.where(~hot), key, how)
    return here.unionByName(there)


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """``(doc_id, label)`` with 0 or 1 per labelled id; the larger label of an id labelled twice."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    return known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))


def learning_rows(docs: DataFrame, labels: DataFrame, column: str, per_class: int, *more: str) -> tuple[DataFrame, tuple[int, int]]:
    """At most ``per_class`` labelled rows outside the held-out fold for each class, and how many there are of each.

    The sample is the rows with the least hash of their id, so it is the same on any partitioning. It is chosen on ids
    alone; only the texts of its at most ``2 * per_class`` documents are read afterwards.
    """
    ids = docs.where(~held_out()).select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    known = settle(ids.join(labels_of(labels, column), "doc_id"), "known")
    seen = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = [known.where(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    picked = settle(few[0].unionByName(few[1]), "picked")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), *more)
    # Of rows with one id, the text of the least digest.
    first = Window.partitionBy("doc_id").orderBy(F.sha2("text", 256), *more)
    rows = texts.join(F.broadcast(picked), "doc_id").withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    return rows, (seen.get(0, 0), seen.get(1, 0))


def digest_of(text: str = "text") -> Column:
    """SHA-256 of the whole text in UTF-8, null as empty."""
    return F.unhex(F.sha2(text_of(text), 256))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores in front as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def sieve(hashes: DataFrame):
    """A Bloom filter over the only column of ``hashes`` (bigint, a written table), as a column function.

    False says surely not among them. Two bits per entry in at most ``SIEVE_BITS`` bits: what the driver gathers and sends
    is bounded whatever the number of entries. With more entries than that holds well, more rows are suspected; none is
    missed.
    """
    bits = max(64, min(SIEVE_BITS, 1 << (SIEVE_ROOM * hashes.count()).bit_length()))
    both = hashes.toDF("h").select(F.explode(F.array("h", F.shiftrightunsigned("h", 32))).alias("h"))
    slots = both.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("slot"))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    filled = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    shared = hashes.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def suspected(h: pd.Series) -> pd.Series:
        hashed = h.to_numpy("i8").view(np.uint64)
        seen = np.ones(len(h), bool)
        for part in (hashed, hashed >> np.uint64(32)):
            slot = part & np.uint64(bits - 1)
            seen &= (shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
        return pd.Series(seen)

    return suspected


def row_key(doc_id: Column, digest: Column) -> Column:
    """Id and digest of a row as one text; a null id has its own."""
    return F.concat(F.hex(digest), F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("")))


def keep_marked(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``marked`` (doc_id, digest, kept; one row per row of ``docs``) keeps, with all columns.

    What goes, and what is there twice, is listed. A row that the sieve over the list does not suspect stays where it is;
    only suspects, the rows that go and a few more, are compared with the list itself and may be shuffled with their texts.
    Of rows that repeat id and text one stays, by an aggregate that collapses them on the map side. The planner compares
    with the list in front of it: by broadcast while the list is small, else by a join whose skewed parts it splits.
    """
    per_text = marked.groupBy("doc_id", "digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    listed = per_text.where("not kept or n > 1").select(row_key(F.col("doc_id"), F.col("digest")).alias("key"), "kept")
    listed = settle(listed, "listed")
    suspected = sieve(listed.select(F.xxhash64("key")))
    key = free_name(docs, "_row_key")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), digest_of()))
    hit = suspected(F.xxhash64(key))
    goes = listed.where("not kept").select(F.col("key").alias(key))
    few = keyed.where(hit).dropDuplicates([key]).join(goes, key, "left_anti")
    return keyed.where(~hit).unionByName(few).drop(key)
