from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossmill.functions import diff, prompts


@settings(max_examples=200, deadline=None)
@given(st.text("ab c,漢", max_size=25), st.text("ab c,漢", max_size=25))
def test_diff_rebuilds_both(a, b):
    ops = diff.word_diff(a, b)
    assert "".join(o["text"] for o in ops if o["op"] != "add") == a
    assert "".join(o["text"] for o in ops if o["op"] != "remove") == b


def test_diff_columns(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("same", "same")], "a string, b string")
    assert [r["n"] for r in df.select(diff.changes(diff.diff(F.col("a"), F.col("b"))).alias("n")).collect()] == [2, 0]


def test_messages(spark):
    df = spark.createDataFrame([("de", "formal", [("a|b", "c  d", "")], "", "- x")], "t string, f string, e array<struct<source:string,target:string,note:string>>, c string, p string")
    text = df.select(prompts.system_message(*(F.col(c) for c in "tfecp")).alias("m")).first()["m"]
    assert "| a\\|b | c d |" in text and "About" not in text and text.endswith("- x") and "Note" not in text
    row = spark.createDataFrame([(["x", "y"],)], "i array<string>").select(prompts.batch_message(F.col("i")).alias("m"), prompts.batch_schema(F.size("i")).alias("s")).first()
    assert row["m"] == '{"items":[{"id":1,"text":"x"},{"id":2,"text":"y"}]}' and '"minItems":2' in row["s"]
    got = spark.createDataFrame([('{"translations":[{"id":1,"output":"u"}]}',), ("no",)], "a string").select(prompts.parsed_batch(F.col("a")).alias("x")).collect()
    assert got[0]["x"][0]["output"] == "u" and got[1]["x"] is None
