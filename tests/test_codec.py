from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vertebra.functions.codec import data_url_payload, decode_base64, decode_hex, encode_hex
from vertebra.operators.codec_ops import encode_frames
from vertebra.operators.messages import decode_messages, split_valid


def test_hex_edge_cases(spark):
    df = spark.createDataFrame([("zz",), ("ABC",), ("ff d8",), ("FFD8",)], "h string")
    got = [r[0] for r in df.select(encode_hex(decode_hex("h"))).collect()]
    assert got == [None, None, "ffd8", "ffd8"]


def test_data_url_and_base64(spark):
    df = spark.createDataFrame([("abc",), ("data:x;base64,!!!!",), ("data:x;base64,/9g=",)], "u string")
    got = [r[0] for r in df.select(encode_hex(decode_base64(data_url_payload("u")))).collect()]
    assert got == [None, None, "ffd8"]


@settings(max_examples=10, deadline=None)
@given(st.binary(min_size=1, max_size=64))
def test_encode_decode_round_trip(spark, b):
    import base64
    url = "data:image/jpeg;base64," + base64.b64encode(b).decode()
    df = spark.createDataFrame([(url,)], "image string").withColumn("ts", F.current_timestamp())
    msgs = encode_frames(df, "image", "ts").select(F.encode("value", "UTF-8").alias("value"))
    out = decode_messages(msgs).select(decode_hex("image_data").alias("b")).collect()[0]
    assert bytes(out.b) == b


def test_quarantine_reasons(spark):
    good_ts = "2024-01-01 09:00:00.000000 +0900"
    vals = [('{"timestamp":"%s","image_data":"ffd8"}' % good_ts,),
            ('{"timestamp":"bad","image_data":"ffd8"}',),
            ('{"timestamp":"%s","image_data":"zz"}' % good_ts,),
            ('{"timestamp":"%s","image_data":null}' % good_ts,),
            ("{not json",)]
    df = spark.createDataFrame(vals, "v string").select(F.encode("v", "UTF-8").alias("value"))
    good, bad = split_valid(decode_messages(df))
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == ["bad_hex", "bad_json", "bad_timestamp"]


def test_bad_browser_posts_are_quarantined(spark):
    from vertebra.operators.codec_ops import encode_frames_checked
    df = spark.createDataFrame([(1, "abc"), (2, "data:x;base64,!!!!"), (3, "data:x;base64,/9g=")],
                               "id int, image string").withColumn("ts", F.current_timestamp())
    good, bad = encode_frames_checked(df, keep=("id",))
    assert [r.id for r in good.collect()] == [3]
    assert {r.id: r.reason for r in bad.collect()} == {1: "bad_data_url", 2: "bad_base64"}
