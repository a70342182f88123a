import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import fields, keys, text
from marlstone.functions import vectors as fv


def test_prefix_end_and_cursors():
    assert keys.prefix_end(b"") is None and keys.prefix_end(b"\xff\xff") is None
    assert keys.prefix_end(b"a\xff") == b"b" and keys.prefix_end(b"ab") == b"ac"
    assert keys.from_cursor("00-aB") == b"\x00\xab" and keys.to_cursor(b"\x00\xab") == "00ab"
    for bad in ("abc", "zz"):
        with pytest.raises(ValueError):
            keys.from_cursor(bad)


@pytest.mark.parametrize("kind,value", [("u64", 0), ("u64", 2**64 - 1), ("u128", str(2**128 - 1)), ("uuid", "0f0e0d0c-0b0a-0908-0706-050403020100")])
def test_key_round_trip(kind, value):
    assert keys.key_text(kind, keys.key_bytes(kind, value)) == str(value)


def test_key_out_of_range():
    for kind, v in [("u64", 2**64), ("u64", -1), ("u128", 2**128), ("uuid", "xyz")]:
        with pytest.raises(ValueError):
            keys.key_bytes(kind, v)


def test_key_columns(spark):
    u = uuid.UUID(int=77)
    df = spark.createDataFrame([(str(u), str(2**128 - 1), 5)], "u string, w string, n bigint")
    r = df.select(keys.uuid_column(F.col("u")), keys.uuid_text_column(keys.uuid_column(F.col("u"))), keys.u128_column(F.col("w")), keys.u64_column(F.col("n")), keys.u64_number_column(keys.u64_column(F.col("n")))).first()
    assert bytes(r[0]) == u.bytes and r[1] == str(u) and bytes(r[2]) == b"\xff" * 16 and bytes(r[3]) == (5).to_bytes(8, "big") and int(r[4]) == 5


def test_units(spark):
    t = "One two.  Three! Four five... six"
    df = spark.createDataFrame([(1, t), (2, ""), (3, None), (4, " \n ")], "i int, t string")
    got = {r[0]: r[1:] for r in df.select("i", text.words(F.col("t")), text.sentences(F.col("t")), text.chunk_query(F.col("t"), 3, 2)).collect()}
    assert got[1][0] == ["One", "two.", "Three!", "Four", "five...", "six"]
    assert got[1][1] == ["One two.", "Three!", "Four five...", "six"]
    assert got[1][2] == ["One two. Three!", "Three! Four five...", "five... six"]
    assert got[2] == ([], [], []) and got[4] == ([], [], []) and got[3] == (None, None, None)


def test_windows_against_a_loop(spark):
    for n in (0, 1, 2, 5, 9):
        u = [str(i) for i in range(n)]
        df = spark.createDataFrame([(u,)], "u array<string>")
        sizes = [(1, 1), (2, 1), (3, 2), (4, 7), (0, 0), (20, 3)]
        got = df.select(*[text.windows(F.col("u"), w, s) for w, s in sizes]).first()
        for (w, s), g in zip(sizes, got):
            w, s, want, i = max(1, w), max(1, s), [], 0
            while i < n:
                want.append(" ".join(u[i : i + w]))
                if i + w >= n:
                    break
                i += s
            assert g == want


def test_embedding_text(spark):
    df = spark.createDataFrame([("x", None), (None, None), ("x", "y")], "a string, `b c` string")
    assert [r[0] for r in df.select(text.embedding_text(["a", "b c"])).collect()] == ["a: x", "", "a: x\nb c: y"]


def test_strict_fields(spark):
    docs = ['{"a":1}', '{"a":1.0}', '{"a":"1"}', '{"a":null}', "{}", '{"a":9223372036854775808}', "[1]", "no", '{"a":true}', '{"x":{"a":1}}']
    df = spark.createDataFrame([(d,) for d in docs], "j string").withColumn("v", fields.variant(F.col("j")))
    got = df.select(fields.field(F.col("v"), "a", "int"), fields.field(F.col("v"), "a", "str"), fields.field(F.col("v"), "a", "bool"), fields.misfit(F.col("v"), "a", "int"), fields.is_object(F.col("j"))).collect()
    assert [r[0] for r in got] == [1] + [None] * 9
    assert [r[1] for r in got] == [None, None, "1"] + [None] * 7
    assert [r[2] for r in got] == [None] * 8 + [True, None]
    assert [r[3] for r in got] == [False, True, True, False, False, True, False, False, True, False]
    assert [r[4] for r in got] == [True] * 6 + [False, False, True, True]


def test_vector_columns(spark):
    v, c = [3.0, -4.0], [1.0, 1.0]
    df = spark.createDataFrame([(v, c), ([0.0, 0.0], c)], "v array<double>, c array<double>")
    r = df.select(fv.dot(F.col("v"), F.col("c")), fv.squared_l2(F.col("v"), F.col("c")), fv.l2_normalise(F.col("v")), fv.sign_code(fv.residual(F.col("v"), F.col("c"))), fv.grid_quantise(F.col("v"), 2)).collect()
    assert r[0][0] == -1 and r[0][1] == 29 and np.allclose(r[0][2], [0.6, -0.8]) and r[0][3] == [1, 0] and r[0][4] == [3, 0]
    assert r[1][2] == [0.0, 0.0] and r[1][4] == [0, 0]


def test_packs():
    bits = np.random.default_rng(0).integers(0, 2, 70)
    assert len(fv.pack_bits(bits)) == 16 and (fv.unpack_bits(fv.pack_bits(bits), 70) == bits).all()
    codes = np.arange(240, 256, dtype=np.uint8)
    for width in (8, 16):
        for signed in (False, True):
            assert (fv.unpack_words(fv.pack_words(codes, width, signed), width, signed) == codes).all()
    with pytest.raises(ValueError):
        fv.pack_words(codes[:5])
