"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.llm.workspace import dropped, written


def components(links: DataFrame, folder: str) -> DataFrame:
    """(doc, comp) of every document in ``links`` (a, b); comp is the smallest document it can reach.

    A round takes the smallest label among a document and its neighbours, then
    the label of that label, so the rounds grow with the logarithm of a chain.
    Labels go through a table in the shared folder, no link to the driver.
    """
    spark = links.sparkSession
    both = written(
        links.select(F.col("a").alias("doc"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("doc"), F.col("a").alias("to"))).distinct(),
        f"{folder}/both",
    )
    labels = written(both.groupBy("doc").agg(F.least(F.min("to"), F.col("doc")).alias("comp")), f"{folder}/labels0")
    step = 0
    while True:
        step += 1
        of_to = labels.select(F.col("doc").alias("to"), F.col("comp").alias("near"))
        around = both.join(of_to, "to").groupBy("doc").agg(F.min("near").alias("near"))
        joined = labels.join(around, "doc").select("doc", F.col("comp").alias("was"), F.least("comp", "near").alias("via"))
        jump = labels.select(F.col("doc").alias("via"), F.col("comp").alias("beyond"))
        fresh = written(
            joined.join(jump, "via").select("doc", "was", F.least("via", "beyond").alias("comp")), f"{folder}/labels{step}"
        )
        moved = fresh.filter("was <> comp").limit(1).count()
        labels = fresh.select("doc", "comp")
        if step > 1:
            dropped(spark, f"{folder}/labels{step - 2}")
        if not moved:
            return labels
