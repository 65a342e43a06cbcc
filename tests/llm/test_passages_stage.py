"""The stage repeated_passages keeps what no cut is about."""

import corpus_pipeline as pipeline

PASSAGE = "This passage of more than fifty bytes stands in two of the documents: « öäü »."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_without_id_and_replacement_characters_stay(spark):
    own = "A text � with \x01b and \x01a and \x01 of its own. "
    rows = [(1, "One! " + PASSAGE, "en", "s", 0), (2, own + PASSAGE + " End �.", "en", "s", 0), (None, PASSAGE, "en", "s", 7), (None, None, None, None, None)]
    found = pipeline.repeated_passages(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(tuple(r) for r in found if r["doc_id"] is None and r["text"]) == [rows[2]] and rows[3] in [tuple(r) for r in found]
    two = next(r for r in found if r["doc_id"] == 2)
    assert two["text"].startswith(own.rstrip()) and two["text"].endswith("End �.") and PASSAGE not in two["text"] and two["n_chars"] == len(two["text"])


def test_parts_of_characters_go(spark):
    parts = spark.sql(r"select cast(unhex('41EFBFBD42C3') as string) as text").select(pipeline._whole_characters(pipeline.F.col("text")).alias("t"))
    assert parts.first()["t"] == "A�B"
