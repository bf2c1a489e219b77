"""Bounded samples of labelled documents, and folds by crc32 of the id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(folds))


def labelled(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, seed: int, id_col: str = "doc_id", most_chars: int = 200_000) -> pd.DataFrame:
    """Up to ``most`` labelled rows (id, text, y) of each label where train holds, those with the least hash of
    the id, and of each text ``most_chars`` characters from a seeded place: both bound what the driver holds. The ids are chosen first and
    are few, so only their texts move. Of rows that repeat an id the least text is taken."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where(train & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).toPandas()
    if not len(chosen):
        return pd.DataFrame({"id": [], "text": [], "y": []})
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame(chosen.astype({"id": "int64", "y": "int32"})))  # at most 2 * most rows
    place = F.pmod(F.xxhash64("id", F.lit(seed)), F.greatest(F.length("text") - most_chars + 1, F.lit(1))).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), "text").where("text is not null").join(small, "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    rows = rows.select("id", F.substring("text", place + 1, F.lit(most_chars)).alias("text"), "y").toPandas()
    return rows.sort_values("id", ignore_index=True)
