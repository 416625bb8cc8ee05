from pyspark.sql import functions as F

from tamarisk.sources.tables import catalogue, events, offers
from tamarisk.streaming import pipeline


def test_stream_gives_what_the_batch_gives(spark, sf, tmp_path):
    rows = offers(spark, sf).select("product_id", "store", "price").limit(300)
    source = str(tmp_path / "in")
    rows.repartition(3).write.parquet(source)
    ours = catalogue(spark, sf).select("our_id", "our_price")
    stream = pipeline.read_stream(spark, source, "product_id long, store string, price double", files=1)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # a second start finds nothing new
        pipeline.priced_stream(stream, ours, out, check, str(tmp_path / "ledger")).awaitTermination(120)
    assert spark.read.parquet(out).count() == 300
    assert spark.read.parquet(str(tmp_path / "ledger")).agg(F.sum("n")).first()[0] == 300


def test_state_and_windows(spark, sf, tmp_path):
    e = events(spark, sf).select("event_id", "ts", "user_id", "status").limit(200)
    source = str(tmp_path / "in")
    e.coalesce(1).write.parquet(source)
    schema = "event_id long, ts timestamp, user_id long, status string"
    read = lambda: pipeline.read_stream(spark, source, schema)

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    changes = run(pipeline.status_changes(read()), "changes", "append")
    from tamarisk.operators.merge import transitions

    want = transitions(spark.read.parquet(source), "user_id", ["ts", "event_id"])
    assert {(r.event_id, r.to_status) for r in changes.collect()} == {(r.event_id, r.to_status) for r in want.collect()}
    assert run(pipeline.first_seen(read(), ["event_id"], "ts"), "firsts", "append").count() == 200
    assert run(pipeline.progress(read(), "ts"), "windows", "append").count() >= 0
