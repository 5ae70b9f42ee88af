from lexifix.operators.dictionary import Dictionary, from_corpus
from lexifix.plans.config import Config
from lexifix.streaming.corrections import corrections, merge_into, streaming_counts


def test_corrections_and_counts(spark, tmp_path):
    words = spark.createDataFrame([("house", 5), ("mouse", 2)], "term string, count long")
    d, source = Dictionary.build(words, Config(1)), tmp_path / "in"
    spark.createDataFrame([(1, "hous"), (2, "zzz")], "id long, input string").write.parquet(str(source))
    stream = spark.readStream.schema("id long, input string").parquet(str(source))
    got = []
    query = corrections(stream, d, lambda batch, n: got.extend(batch.collect())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.id, r.term) for r in got] == [(1, "house")]

    texts = tmp_path / "texts"
    spark.createDataFrame([("a b a",)], "text string").write.parquet(str(texts))
    counts = streaming_counts(spark.readStream.schema("text string").parquet(str(texts)))
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_versions(spark, tmp_path):
    step = merge_into(str(tmp_path))
    batch = from_corpus(spark.createDataFrame([("x y",)], "text string"))
    for n in (0, 1, 1):
        step(batch, n)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/version=1").select("term", "count").collect()} == {("x", 2), ("y", 2)}
