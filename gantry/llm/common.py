"""Helpers of the training-data operators: texts, words, written tables and connected groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gantry.session import scratch_dir

#: White space that separates words: blank, and code points 9 to 13.
SPACE = " \t\n\x0b\f\r"
SPACES = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, purpose: str) -> DataFrame:
    """`df` written below the cluster's shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_of(df: DataFrame) -> Column:
    """All columns of a row in one struct, beside which any name is free."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def carried(df: DataFrame) -> list[Column]:
    """All columns by number, so that an operator can use any other name within; see with_results()."""
    return [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(df.columns)]


def with_results(rows: DataFrame, docs: DataFrame, results: dict[str, Column]) -> DataFrame:
    """The columns of `docs`, carried() by `rows`, and the results, which replace those of their names."""
    taken = {r.lower() for r in results}
    # Results first: beside columns of the same names, Spark may take these for what the results are made of.
    out = rows.select(*(f"_c{i}" for i in range(len(docs.columns))), F.struct(*(v.alias(k) for k, v in results.items())).alias("_out"))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c.lower() not in taken),
                      *(F.col("_out").getField(k).alias(k) for k in results))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def whole_text(column: str = "text") -> Column:
    """The text; a null is empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters that are not white space, in order."""
    return let(
        F.btrim(text, F.lit(SPACE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACES)),
    )


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b): root is the smallest node connected.

    Alternating stars: neighbours move to the smallest neighbour until nothing changes, which takes
    a number of rounds that grows with the logarithm of the longest path. Each round is written to
    the shared folder; only its row count reaches the driver.
    """
    links = saved(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a != b").distinct(), purpose)
    before = None
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b")))
        links = saved(small.filter("a != b").distinct(), purpose)
        state = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
