"""Report of the keyed signal in a corpus: a row for each seed and group of texts.

    python -m jobs.signal_report SOURCE TARGET CONFIG

Reads texts (Parquet), takes the contexts of two tokens with the token that follows, each context once a group at its first place,
and counts for each seed how many of these tokens fall in the seed's set. The tail is Hoeffding's. TARGET is
partitioned by seed; the partitions of the seeds asked for are replaced as a whole, those of other seeds stay, so a run can be repeated
and seeds can be added later. Contexts are found and shuffled once for all seeds.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobs.common import main, merged
from tallyweave.functions import stats
from tallyweave.functions.keyed_hash import HashKey, in_set, with_hash
from tallyweave.operators import tokens

log = logging.getLogger("signal_report")

DEFAULTS = {"id": "doc_id", "text": "text", "group": "source", "seeds": [294288], "gamma": 0.5, "alpha": 0.05}
#: Groups up to which they are numbered; the table of their numbers is broadcast.
MOST_GROUPS = 100_000
COLUMNS = "group string, contexts long, positions long, hits long, mean double, p_value double, minus_log10_p double, detected boolean, seed long"


def report(texts: DataFrame, settings: dict) -> DataFrame:
    """``COLUMNS`` of texts with an id, a text and a group; a null text has no contexts, a null group is one of its own."""
    rows = texts.select(F.col(settings["id"]).cast("long").alias("id"), F.col(settings["text"]).alias("text"), F.col(settings["group"]).cast("string").alias("group"))
    names = rows.select("group").distinct()
    few = names.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    if few:  # a number for each name, so that names are not shuffled with every context
        names = F.broadcast(names.select(F.col("group").alias("name"), (F.row_number().over(Window.orderBy("group")) - 1).alias("part")))
        rows = rows.join(names, F.col("group").eqNullSafe(F.col("name"))).select("id", "text", "part")
        first = tokens.first_grams(rows, "text", ["id"], part="part")
    else:
        first = tokens.first_grams(rows, "text", ["id"], "group")
    seeds = [HashKey(seed, settings["gamma"]).seed for seed in settings["seeds"]]
    first = first.withColumn("seed", F.explode(F.array(*(F.lit(seed).cast("long") for seed in seeds))))
    key = HashKey(gamma=settings["gamma"])
    hashed = with_hash(first, "prev", "cur", "token", key, seed="seed")
    each = hashed.groupBy("part" if few else "group", "seed").agg(F.count("*").alias("contexts"), F.sum("times").alias("positions"), F.count_if(in_set(F.col("x"), key)).alias("hits"))
    if few:
        each = each.join(names, "part").withColumnRenamed("name", "group")
    each = each.withColumn("mean", F.col("hits") / F.col("contexts"))
    each = each.withColumn("p_value", stats.hoeffding(F.col("mean"), F.col("contexts"), settings["gamma"]))
    return each.select("group", "contexts", "positions", "hits", F.round("mean", 9).alias("mean"), F.round("p_value", 9).alias("p_value"), F.round(stats.minus_log10(F.col("p_value")), 6).alias("minus_log10_p"), (F.col("p_value") < settings["alpha"]).alias("detected"), "seed")


def run(spark: SparkSession, source: str, target: str, settings: dict) -> None:
    """Write the report on ``source`` to ``target``."""
    settings = merged(DEFAULTS, settings)
    texts = spark.read.parquet(source)
    out = report(texts, settings)
    out.repartition("seed").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seed").parquet(target)
    found = output(spark, target).where(F.col("seed").isin(*(HashKey(s).seed for s in settings["seeds"])))
    row = found.agg(F.count("*").alias("rows"), F.countDistinct("group").alias("groups"), F.count_if("detected").alias("detected"), F.max("positions").alias("most")).first()
    log.info("read %s: %d groups, %s positions in the largest; wrote %d rows to %s, %d detected", source, row["groups"], row["most"], row["rows"], target, row["detected"])


def output(spark: SparkSession, target: str) -> DataFrame:
    """The reports of all seeds."""
    return spark.read.schema(COLUMNS).parquet(target)


if __name__ == "__main__":
    main(run, "signal_report", ["source", "target"], __doc__)
