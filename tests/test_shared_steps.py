"""Steps that the package queries share: places from lengths alone, tokens that stay where they are made."""

from pyspark.sql import functions as F

from leafmill.operators import streams
from leafmill.sinks import packages as sink
from leafmill.sources import packages as source


def test_sizes_are_those_of_the_encoded_bytes(spark):
    rows = spark.createDataFrame([("p", 1, "red plate", "a\nb"), ("p", 2, "", ""), ("p", 3, "é😀漢", "\n\nx-1\n")], "package string, order int, headword string, text string")
    sized = rows.withColumns({k: v.cast("long") for k, v in sink._sizes(F.col("headword"), F.col("text")).items()})
    for r in sink._encoded(sized).collect():
        assert (len(r["body"]), len(r["title"])) == (r["body_place"], r["title_place"])


def test_copies_as_a_whole_and_byte_by_byte():
    for data in (b"abcabcabcabcX" * 40, b"a" * 500, bytes(range(256)) * 8, b"abcdefgh12abcdefgh34abcdefgh56" * 30):
        data = data.ljust(-(-len(data) // 2048) * 2048, b"\0")
        assert source._expanded(sink.compressed(data)) == data


def test_tokens_are_not_shuffled(spark):
    df = spark.range(20).select(F.col("id").alias("k"), F.lit(b"\x1f\x04\x23\x41\x1f\x05").alias("bytes"))
    plan = streams.spans(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
