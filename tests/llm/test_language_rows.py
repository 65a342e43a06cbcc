"""Language ID learns from every row."""

from pyspark.sql import functions as F

from nearfield.llm import langid


def test_languages_of_copies_stay(spark):
    texts = {"aa": "kalo miloka kami", "bb": "éure quaré requa", "cc": "ßtung ichung", "dd": "zyx wvu zyxw", "ee": "bobo gogo bogo", "ff": "njet pjat hjet"}
    pairs = spark.createDataFrame(list(texts.items()), "lang string, text string")
    docs = spark.range(0, 9000, 1, 4).crossJoin(pairs)
    model = langid.train(docs)
    names, matrix = model.names, model.matrix
    assert names == sorted(texts)
    assert {r["lang"]: r["lang_pred"] for r in langid.predict(pairs, model).collect()} == {x: x for x in texts}
    # Every row counts: the same as the counts of one copy, 9,000 times.
    once = langid.count(pairs, "text", "lang").withColumn("n", F.col("n") * 9000)
    assert sorted(map(tuple, langid.count(docs, "text", "lang").collect())) == sorted(map(tuple, once.collect()))
