import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.hashing import hash_of, object_text, row_hash, text_hash, with_hash

# Published input and hash pairs.
VECTORS = [
    ("basicTypes/stringsRef/value", "2sZunZAWb9ZlcMFti8A4bq"),
    ({"b": 0}, "9Iao-QHCqda6NiJKtRDGx4"),
    ({"a": {"b": 0}}, "7nnKrH6KoTEC3e9xxliBiP"),
    ({"add": [f"VIN{n}" for n in range(1, 9)]}, "2RefO1-vC_FbgYaC1FWzFo"),
]


@pytest.mark.parametrize(("value", "expected"), VECTORS)
def test_vectors(value, expected):
    assert hash_of(value) == expected


def test_column_hash_equals_literal_hash(spark):
    rows = [("x", 18.0, 3, True, None, ["a", "b"], ("inner", 0.5)), ('q"\\ü', 1.5e-7, -1, False, 2.25, [], ("", 1e22))]
    df = spark.createDataFrame(rows, "s string, d double, i long, b boolean, n double, l array<string>, o struct<t: string, v: double>")
    got = [r[0] for r in df.select(row_hash(df.schema)).collect()]
    expected = [hash_of({"s": s, "d": d, "i": i, "b": b, "n": n, "l": li, "o": {"t": o[0], "v": o[1]}}) for s, d, i, b, n, li, o in rows]
    assert got == expected


def test_text_hash_and_leading_column(spark):
    df = with_hash(spark.createDataFrame([("a", 1)], "t string, n long"))
    assert df.columns == ["_hash", "t", "n"]
    assert df.select(text_hash(F.col("t"))).first()[0] == hash_of("a")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e25, max_value=1e25), min_size=1, max_size=20))
def test_number_text_round_trips(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    texts = [r[0] for r in df.select(object_text(None, T.StructType([T.StructField("v", T.DoubleType())]))).collect()]
    for value, text in zip(values, texts, strict=True):
        shown = float(text[5:-1])
        assert math.isclose(shown, value, rel_tol=1e-9, abs_tol=1e-15)
        assert value != int(value) or abs(value) >= 1e21 or "." not in text
