"""The gate before an injected encoder."""

import os

import numpy as np
import pytest

from veritrail.operators import embedding


def recorder(folder, bad=None):
    """An encoder that counts words and writes a file for each call to encode; made inside a function, so that tasks get the class itself."""

    class Recorder:
        max_tokens, dimensions = 8, 2

        def lengths(self, texts):
            return [len(t.split()) for t in texts]

        def encode(self, texts):
            with open(os.path.join(str(folder), os.urandom(6).hex()), "w") as f:
                f.write("|".join(str(len(t.split())) for t in texts))
            return [[1.0, bad if bad is not None and len(t) == 3 else float(len(t))] for t in texts]

    return Recorder()


def test_nothing_is_encoded_before_all_pass(spark, tmp_path):
    rows = [(i, "w " * (i % 8 + 1)) for i in range(50)]
    table = spark.createDataFrame([*rows, (None, "x y"), (3, "x y z")], "k long, t string")
    for fault, says in (((99, "w " * 9), "text_too_long 1"), ((98, ""), "empty_text 1"), ((97, None), "empty_text 1")):
        with pytest.raises(ValueError, match=says):
            embedding.embedded(table.unionByName(spark.createDataFrame([fault], "k long, t string")), recorder(tmp_path), "k", "t").collect()
    assert os.listdir(tmp_path) == []
    got = embedding.embedded(table, recorder(tmp_path), "k", "t", budget=16).collect()
    assert sorted((str(r.k), r.tokens, tuple(r.vector)) for r in got) == sorted((str(k), len(t.split()), (1.0, float(len(t)))) for k, t in [*rows, (None, "x y"), (3, "x y z")])
    sizes = [list(map(int, (tmp_path / name).read_text().split("|"))) for name in os.listdir(tmp_path)]
    assert all(len(s) * max(s) <= 16 for s in sizes) and sum(map(len, sizes)) == 52
    assert embedding.embedded(table.where("false"), recorder(tmp_path), "k", "t").collect() == []


def test_faulty_vectors(spark, tmp_path):
    table = spark.createDataFrame([(1, "abc"), (2, "abcd")], "k long, t string")
    with pytest.raises(Exception, match="invalid_vectors"):
        embedding.embedded(table, recorder(tmp_path, float("nan")), "k", "t").collect()
    for wrong in ([[1.0]], [[0.0, 0.0]], [[1.0, np.inf]], [[1.0, 2.0]] * 2):
        with pytest.raises(ValueError, match="invalid_vectors"):
            embedding.checked(wrong, 1, 2)
    assert embedding.checked([[0.0, 2.0]], 1, 2).tolist() == [[0.0, 2.0]]


def test_batches():
    assert embedding.batches([], 9) == [] and embedding.batches([1, 1, 2, 5, 30], 8) == [slice(0, 3), slice(3, 4), slice(4, 5)]
