"""A third of all rows under one key: results stay whole and no task takes them all."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quireflow.operators import changefeed, hierarchy, orphans

T0 = datetime(2020, 1, 1)


def test_hot_parent_key(spark):
    parents = spark.range(6000).selectExpr("if(id % 3 = 0, 'hot', concat('p', id)) as path", "1L as obj", "0 as gen", "timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, cast(id as int)) as recorded_at", "if(id % 2 = 0, timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, cast(id as int) + 1), null) as removed_at").where("path <> 'hot' or removed_at is not null")
    refs = spark.range(9000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('p', id % 5000)) as path", "1L as obj", "0 as gen", "timestamp_ntz '2020-01-01' + make_interval(0, 0, 0, cast(id as int)) as at")
    got = orphans.orphan_references(refs, parents, ["path", "obj", "gen"])
    hot = {r.id for r in got.where("path = 'hot'").collect()}
    # hot versions live a day each, on every sixth day
    assert hot == {i for i in range(0, 9000, 3) if i % 6 != 0 or i >= 6000}
    assert got.where("path <> 'hot'").count() == refs.alias("r").where("path <> 'hot'").join(parents.alias("p"), "path", "left").where("recorded_at is null or recorded_at > at or removed_at <= at").select("id").distinct().count()


def test_hot_file_of_nodes(spark):
    ref = "struct<obj:bigint,gen:int>"
    hot = spark.range(6000).select(F.lit("hot").alias("path"), F.col("id").alias("obj"), F.lit(0).alias("gen"), F.expr("array(named_struct('obj', id * 2 + 1, 'gen', 0), named_struct('obj', id * 2 + 2, 'gen', 0))").alias("kids"))
    cold = spark.range(3000).select(F.concat(F.lit("c"), (F.col("id") % 500).cast("string")).alias("path"), F.col("id").alias("obj"), F.lit(0).alias("gen"), F.lit(None).cast(f"array<{ref}>").alias("kids"))
    nodes = hot.unionByName(cold).withColumns({"resources_ref": F.lit(None).cast(ref), "recorded_at": F.lit(T0 + timedelta(0)).cast("timestamp_ntz")})
    got = hierarchy.hierarchy(nodes)
    assert got.count() == 9000
    top = got.where("path = 'hot' and obj = 0").first()
    assert (top.n_below, top.depth_no, top.root_obj) == (5999, 0, 0)
    assert got.where("path = 'hot'").agg(F.max("depth_no"), F.min("root_obj")).first()[:] == (12, 0)


def test_long_chain_of_blocks(spark):
    entry = "array(named_struct('obj', id % 50, 'gen', 0, 'kind', if(id % 7 = 0, 'free', 'plain'), 'byte_pos', id, 'stream_id', cast(null as bigint), 'idx', cast(null as bigint)))"
    blocks = spark.range(700).selectExpr("id as block_id", "'hot' as path", "id as start_pos", "if(id = 0, null, id - 1) as prev", f"{entry} as xrefs", "timestamp_ntz '2020-01-01' as recorded_at")
    files = spark.createDataFrame([("hot", 699, T0)], "path string, startxref bigint, received_at timestamp_ntz")
    got = {r.obj: r.byte_pos for r in changefeed.current_entries(blocks, files).collect()}
    assert got == {o: 650 + o for o in range(50) if (650 + o) % 7}
