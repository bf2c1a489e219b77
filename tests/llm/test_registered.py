"""The registered queries against their SQL, whole tables, as they come and with nulls, repeats and clashing columns."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlab.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def rounded(rows):
    plain = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, (float, np.floating)) else x
    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


def compare(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}')")
    got = queries.QUERIES[name](spark, folder)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rounded(map(tuple, got.select(*columns).collect())) == rounded(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    compare(spark, name, SF)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The tables with repeated rows, rows of one id with other content, nulls and more columns."""
    folder = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = (
        docs.unionByName(docs.where("doc_id % 9 = 0")).unionByName(docs.where("doc_id % 10 = 0").withColumn("doc_id", F.col("doc_id") + 1))
        .withColumn("source", F.when(F.col("doc_id") % 17 != 0, F.col("source"))).withColumn("text", F.when(F.col("doc_id") % 13 != 0, F.col("text")))
        .withColumns({"id": F.lit("x"), "pattern": F.lit(1), "row": F.lit(2), "v": F.lit(3)})
    )
    docs.write.parquet(f"{folder}/documents.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 200")
    more = vectors.where("vec_id < 40")
    vectors = vectors.unionByName(more).unionByName(more.withColumn("embedding", F.transform("embedding", lambda x, i: x + F.when(i < 6, 0.3).otherwise(0.0)).cast("array<float>")).withColumn("vec_id", F.col("vec_id") + 1000))
    vectors = vectors.withColumn("embedding", F.when(F.col("vec_id") % 23 != 0, F.col("embedding"))).withColumn("x", F.lit(1))
    vectors.write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["op5_substring_dedup", "op7_mixing", "op10_embedding_dedup"])
def test_queries_equal_their_sql_on_odd_tables(spark, odd, name):
    compare(spark, name, odd)


@pytest.mark.parametrize("name", ["op2_quality", "op3_toxicity", "op6_pii", "op8_minhash_dedup", "op9_packing"])
def test_other_queries_keep_every_row_of_odd_tables(spark, odd, tmp_path, name):
    os.symlink(f"{odd}/documents.parquet", tmp_path / "documents.parquet")
    os.symlink(f"{SF}/labels.parquet", tmp_path / "labels.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    want = ids(spark.read.parquet(f"{odd}/documents.parquet"))
    rows = got.where("start + length = doc_tokens") if name == "op9_packing" else got
    assert ids(rows) == want
