import json

from pyspark.sql import functions as F

from lanternlog.functions import fields as L


def _maps(spark, *bodies):
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    return [r[0] for r in df.select(L.flatten(F.try_parse_json("b"), F.col("b"))).collect()]


def test_flatten_paths_arrays_and_null(spark):
    body = '{"a":{"b":{"c":1},"d":null},"x":"5","y":5,"z":[1,{"q":2}],"e":{},"f":true}'
    got = _maps(spark, body, "12", "not json", "[1]")
    assert got[0] == {
        "a.b.c": "1", "a.d": "null", "x": '"5"', "y": "5", "z": '[1,{"q":2}]', "e": "{}", "f": "true",
    }
    assert got[1:] == [None, None, None]


def test_nested_and_literal_dotted_key_meet(spark):
    (got,) = _maps(spark, '{"a":{"b":1},"a.b":2}')
    assert list(got) == ["a.b"]


def test_any_depth(spark):
    body = '{"a":{"b":{"c":{"d":{"e":{"f":{"g":1,"h":2,"i":{"j":{"k":3}}}}}}}}}'
    (got,) = _maps(spark, body)
    assert got == {"a.b.c.d.e.f.g": "1", "a.b.c.d.e.f.h": "2", "a.b.c.d.e.f.i.j.k": "3"}
    df = spark.createDataFrame([(body,)], "b string").select(L.flatten(F.try_parse_json("b")).alias("fields"))
    set_ = df.select(L.expand_fields(L.set_constants(F.col("fields"), {"a.b.c.d.e.f.g": 5}))).first()[0]
    assert json.loads(set_)["a"]["b"]["c"]["d"]["e"]["f"] == {"g": 5, "h": 2, "i": {"j": {"k": 3}}}


def test_expand_is_the_inverse_of_flatten(spark):
    body = {"a": {"b": {"c": 1}, "d": None}, "k\"q": "v\n", "z": [1, 2], "m": {"n": {"o": {"p": {"q": "deep"}}}}}
    df = spark.createDataFrame([(json.dumps(body),)], "b string")
    text = df.select(L.expand_fields(L.flatten(F.try_parse_json("b")))).first()[0]
    assert json.loads(text) == body


def test_state_tells_missing_from_null_and_objects(spark):
    df = spark.createDataFrame([('{"a":{"b":1,"c":"x"},"n":null}',)], "b string").select(
        L.flatten(F.try_parse_json("b")).alias("f")
    )
    state = lambda p: df.select(L.state_of(F.col("f"), F.lit(p)).alias("s")).first()["s"]
    assert tuple(state("n")) == (True, "null")
    assert tuple(state("zz")) == (False, None)
    assert tuple(state("a.b")) == (True, "1")
    assert json.loads(state("a")["value"]) == {"b": 1, "c": "x"}


def test_drop_and_set(spark):
    df = spark.createDataFrame([({"a.b": "1", "a.c": "2", "ab": "3"},)], "f map<string,string>")
    assert df.select(L.drop_paths(F.col("f"), ["a", "missing"])).first()[0] == {"ab": "3"}
    assert df.select(L.set_constants(F.col("f"), {"a": "v"})).first()[0] == {"ab": "3", "a": '"v"'}


def test_leaf_round_trip(spark):
    df = spark.range(1).select(
        L.to_leaf("a\"b").alias("s"), L.to_leaf(5).alias("n"), L.to_leaf(None).alias("z"),
        L.to_leaf(F.lit("x")).alias("c"), L.to_leaf(F.lit(None).cast("int")).alias("cz"),
    )
    got = df.select(
        L.from_leaf(F.col("s")), L.from_leaf(F.col("n"), "int"), L.from_leaf(F.col("z")), L.from_leaf(F.col("c")), "cz"
    ).first()
    assert tuple(got) == ('a"b', 5, None, "x", "null")
