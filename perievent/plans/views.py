"""Trial, trace and response tables, as views over the general tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STIM_ON, N_ON, TRIAL_FRAMES = 8, 6, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    """Rounded to six decimals: sums taken in another order agree."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def exact(c: Column) -> Column:
    """A number as a decimal of ten places, whose sums don't depend on their order; null where it has none (nan, infinite)."""
    return c.try_cast("decimal(38,10)")


def mean(c: Column | str) -> Column:
    """The mean, the same whatever the order of rows is, so that equal values have equal means and both sides of a comparison
    agree; as avg where a value has no decimal."""
    c = F.col(c) if isinstance(c, str) else c
    x = exact(c)
    return F.when(F.count(x) == F.count(c), F.sum(x).cast("double") / F.nullif(F.count(x), F.lit(0))).otherwise(F.avg(c))


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked responses of a population: trials crossed with cells, one config (0..9) a trial."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("pop").alias("datakey"), F.col("vec_id").alias("trial"), F.col("label").cast("long").alias("config"), F.posexplode("embedding").alias("cell", "response")).select("datakey", "trial", long("cell").alias("cell"), "config", F.col("response").cast("double").alias("response"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked responses at volume: datasets (datakey) with cells, trials of one config each, and an area."""
    area = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("cell"), F.col("n_regionkey").cast("long").alias("area"))
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("datakey"), F.col("l_suppkey").alias("cell"), long("l_linenumber").alias("config"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trial"), F.col("l_extendedprice").alias("response"), F.col("l_quantity").alias("quantity"))
    return rows.join(F.broadcast(area), "cell")  # a supplier for hundreds of lines: two numbers each, instead of all lines dealt by supplier


def traces(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """Frames of one trace a cell, in trials of TRIAL_FRAMES frames; whole: complete trials only."""
    w = W.partitionBy("user_id")
    n = F.row_number().over(w.orderBy("ts", "event_id")) - 1
    df = table(spark, sf_dir, "events").select(F.col("user_id").alias("cell"), long(n).alias("frame"), "value", "ts", "event_type", F.count(F.lit(1)).over(w).alias("n_frames"))
    df = df.withColumns({"trial": F.floor(F.col("frame") / TRIAL_FRAMES), "frame_ix": F.col("frame") % TRIAL_FRAMES}).withColumn("config", F.col("trial") % 2)
    return (df.filter((F.col("trial") + 1) * TRIAL_FRAMES <= F.col("n_frames")) if whole else df).drop("n_frames")


def stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a stimulus configuration: orientation, size, speed."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("config"), (F.col("p_partkey") % 8 * 45).cast("double").alias("ori"), long("p_size").alias("size"), F.col("p_retailprice").alias("speed"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))


def grid(spark: SparkSession, sf_dir: str, side: int = 64) -> DataFrame:
    """An image of side x side pixels and some frames, from order values: value of the frame's pixel."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select((k % side).alias("x"), F.floor(k / side).alias("row"), F.col("o_totalprice").alias("value")).select("x", (F.col("row") % side).alias("y"), F.floor(F.col("row") / side).alias("frame"), "value")


#: The same views in SQL.
RESP = "resp AS (SELECT 'pop' AS datakey, vec_id AS trial, CAST(label AS BIGINT) AS config, CAST(k AS BIGINT) AS cell, CAST(embedding[k + 1] AS DOUBLE) AS response FROM embeddings, range(64) t(k))"
REC = "rec AS (SELECT l_returnflag || l_linestatus AS datakey, l_suppkey AS cell, CAST(l_linenumber AS BIGINT) AS config, l_orderkey * 8 + l_linenumber AS trial, l_extendedprice AS response, l_quantity AS quantity, CAST(n_regionkey AS BIGINT) AS area FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey)"
TRACE = "trall AS (SELECT user_id AS cell, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value, ts, event_type, count(*) OVER (PARTITION BY user_id) AS n_frames FROM events), tr0 AS (SELECT cell, frame, value, ts, event_type, n_frames, frame // 20 AS trial, frame % 20 AS frame_ix, (frame // 20) % 2 AS config FROM trall), tr AS (SELECT * FROM tr0 WHERE (trial + 1) * 20 <= n_frames)"
STIM = "stim AS (SELECT p_partkey AS config, CAST(p_partkey % 8 * 45 AS DOUBLE) AS ori, CAST(p_size AS BIGINT) AS size, p_retailprice AS speed, p_brand AS brand, p_name AS name, p_type AS type FROM part)"
GRID = "grid AS (SELECT o_orderkey % 64 AS x, (o_orderkey // 64) % 64 AS y, o_orderkey // 4096 AS frame, o_totalprice AS value FROM orders)"
