"""Table sinks (I6, M3 write path) and materialisation into the checkpoint folder."""

from pyspark.sql import functions as F

from rosterlake.sinks import tables


def test_ensure_table_and_dynamic_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "stats")
    empty = tables.ensure_table(spark, "statistiche_storiche", path)
    assert empty.count() == 0 and "stagione" in empty.columns
    again = tables.ensure_table(spark, "statistiche_storiche", path)   # exists: read, not recreated
    assert again.count() == 0
    base = spark.createDataFrame([(1, 10, "2022/23", 5), (2, 10, "2023/24", 7)],
                                 "id long, giocatore_id long, stagione string, presenze int")
    cols = [f.name for f in empty.schema.fields]
    full = base
    for f in empty.schema.fields:
        if f.name not in base.columns:
            full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
    tables.write_table(full.select(*cols), "statistiche_storiche", path)
    # re-import of one season rewrites only that season's partition
    upd = full.where("stagione = '2023/24'").withColumn("presenze", F.lit(9)).select(*cols)
    tables.write_table(upd, "statistiche_storiche", path)
    got = {(r.stagione, r.presenze) for r in spark.read.parquet(path).collect()}
    assert got == {("2022/23", 5), ("2023/24", 9)}


def test_materialize_reads_back_from_checkpoint_dir(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    m = tables.materialize(df, "test")
    assert sorted(r.x for r in m.collect()) == list(range(0, 20, 2))
    assert spark.conf.get("spark.checkpoint.dir") in m.inputFiles()[0].replace("file:", "")
