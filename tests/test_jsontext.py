"""Indented ASCII JSON against ``json.dumps(indent=4)``, byte by byte."""
import json
import random

import pytest
from pyspark.sql import types as T

from mise.functions import jsontext as J
from mise.operators import render as RD
from mise.operators.recipes import RECIPE_DDL

CHARS = ["a", '"', "\\", "\n", "\t", "\r", "\b", "\f", "\x00", "\x1f", "\x7f", "é", "日", "🙂", " ", "/", "<", "", "\U0010ffff", "\\u0041"]


def random_record(rnd):
    def text():
        return "".join(rnd.choice(CHARS) for _ in range(rnd.randint(0, 12)))
    r = {k: text() for k in ("url", "title", "description", "yield", "preptime") if rnd.random() < 0.7}
    if rnd.random() < 0.8:
        r["ingredient_groups"] = [{"title": text(), "ingredients": [text() for _ in range(rnd.randint(0, 3))]} for _ in range(rnd.randint(0, 3))]
    if rnd.random() < 0.8:
        r["direction_groups"] = [{"group": text(), **({"directions": [rnd.choice([text(), None]) for _ in range(rnd.randint(0, 3))]} if rnd.random() < 0.8 else {})}
                                 for _ in range(rnd.randint(0, 2))]
    if rnd.random() < 0.5:
        r["notes"] = [text()]
    return r


def test_records_equal_json_dumps(spark):
    rnd = random.Random(1)
    records = [random_record(rnd) for _ in range(300)] + [{}]
    df = spark.createDataFrame(list(enumerate(records)), f"i int, recipe struct<{RECIPE_DDL}>")
    got = {r.i: r.o for r in df.select("i", J.pretty_json("recipe", df.schema["recipe"].dataType).alias("o")).collect()}
    for i, r in enumerate(records):
        assert got[i] == json.dumps(r, indent=4)


def test_a_document_in_json_is_the_indented_record(spark):
    record = {"url": "https://x.example/", "title": "Crème \U0001f370", "ingredient_groups": [{"title": "", "ingredients": ["½ cup"]}]}
    df = spark.createDataFrame([(1, record)], f"page_id bigint, recipe struct<{RECIPE_DDL}>")
    doc = RD.render_docs(df, ["json"]).first()
    assert (doc.filename, doc.body) == ("Crème.json", json.dumps(record, indent=4))


def test_numbers_flags_and_other_types(spark):
    df = spark.sql("select named_struct('n', 5, 'b', true, 'l', array(1L, null)) as r, named_struct('d', 1.5D) as d")
    assert df.select(J.pretty_json("r", df.schema["r"].dataType)).first()[0] == json.dumps({"n": 5, "b": True, "l": [1, None]}, indent=4)
    with pytest.raises(TypeError):
        J.pretty_json("d", T.StructType([T.StructField("d", T.DoubleType())]))


def test_nothing_is_escaped_by_expressions_and_slices_keep_their_rows(spark):
    """Batches longer than what is taken at a time, with NULL records, lists and texts in them."""
    rnd = random.Random(6)
    records = [None if i % 7 == 3 else {"t": rnd.choice(["é" * (i % 5), None]), "l": None if i % 5 == 1 else [rnd.choice([None, [], ["x", None, "é"]]) for _ in range(i % 4)], "e": {"n": None}}
               for i in range(3 * J.ROWS_AT_A_TIME + 5)]
    kind = "struct<t: string, l: array<array<string>>, e: struct<n: int>>"
    df = spark.createDataFrame(list(enumerate(records)), f"i int, r {kind}").coalesce(1)
    out = df.select("i", J.pretty_json("r", df.schema["r"].dataType).alias("o"))
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.i: r.o for r in out.collect()}
    for i, r in enumerate(records):
        want = None if r is None else {k: v for k, v in {"t": r["t"], "l": r["l"], "e": {}}.items() if v is not None}
        assert got[i] == json.dumps(want, indent=4)


def test_documents_in_json_go_to_python_in_small_batches(spark):
    from mise.session import BATCH_BYTES, BATCH_BYTES_KEY
    df = spark.createDataFrame([(1, {"title": "x"})], f"page_id bigint, recipe struct<{RECIPE_DDL}>")
    spark.conf.unset(BATCH_BYTES_KEY)
    try:
        for own, then in [(None, str(BATCH_BYTES)), ("1000", "1000")]:
            if own:
                spark.conf.set(BATCH_BYTES_KEY, own)
            assert RD.render_docs(df, ["json"]).first().body == json.dumps({"title": "x"}, indent=4)
            assert spark.conf.get(BATCH_BYTES_KEY) == then
    finally:
        spark.conf.unset(BATCH_BYTES_KEY)
