"""Embedding matrix files: ids pair with rows, row ranges, unknown keys, broken files."""
import numpy as np
import pytest

from proxima.operators import encode as E
from proxima.schema import Schema
from proxima.sources import matrix


def _written(tmp_path, x, ids, name="m"):
    np.save(tmp_path / f"{name}.npy", x)
    (tmp_path / f"{name}.txt").write_text("\n".join(ids) + "\n")
    return str(tmp_path / f"{name}.npy"), str(tmp_path / f"{name}.txt")


def test_rows_come_back_under_their_ids_whatever_the_ranges(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(5003, 3)).astype(np.float32)
    ids = [f" id{i} " if i % 7 else f"id{i}\n\n" for i in range(len(x))]  # blanks around, blank lines between
    m, t = _written(tmp_path, x, ids)
    for row_bytes in (60, 4096, 1 << 24):
        df = matrix.embedding_table(spark, m, t, row_bytes)
        got = {r.key: r.vector for r in df.collect()}
        assert len(got) == 5003 and all(got[f"id{i}"] == [float(v) for v in x[i]] for i in range(len(x)))
    assert matrix.read_matrix(spark, m, 4096).rdd.getNumPartitions() > 10


def test_encoder_looks_up_a_matrix_and_unknown_values_are_zero(spark, tmp_path):
    m, t = _written(tmp_path, np.eye(5), list("abcde"))
    s = Schema.build([{"field": "state", "type": "embedding", "length": 5, "weight": 1, "key": "key", "vector": "vector"}], [], "cosine", "id")
    df = spark.createDataFrame([(1, "b"), (2, "i"), (3, None)], "id long, state string")
    out = {r.item_id: list(r.vec) for r in E.encode(df, s, tables={"state": matrix.embedding_table(spark, m, t)}).collect()}
    assert out == {"1": [0, 1, 0, 0, 0], "2": [0] * 5, "3": [0] * 5}


def test_integers_column_order_of_one_row_and_empty_matrices(spark, tmp_path):
    m, t = _written(tmp_path, np.array([[1, 2], [3, 4]], dtype=">i4"), ["x", "y"])
    assert sorted((r.key, r.vector) for r in matrix.embedding_table(spark, m, t).collect()) == [("x", [1.0, 2.0]), ("y", [3.0, 4.0])]
    m, t = _written(tmp_path, np.zeros((0, 4)), [], "empty")
    assert matrix.embedding_table(spark, m, t).count() == 0


def test_files_that_are_no_matrix_or_do_not_fit_are_errors(spark, tmp_path):
    m, t = _written(tmp_path, np.eye(3), ["a", "b"])
    with pytest.raises(ValueError, match="2 ids for 3"):
        matrix.embedding_table(spark, m, t)
    for name, x in (("cube", np.zeros((2, 2, 2))), ("text", np.array([["a"]])), ("turned", np.asfortranarray(np.arange(6.0).reshape(2, 3)))):
        np.save(tmp_path / f"{name}.npy", x)
        with pytest.raises(ValueError):
            matrix.read_header(str(tmp_path / f"{name}.npy"))
    (tmp_path / "bad.npy").write_bytes(b"no matrix")
    with pytest.raises(ValueError):
        matrix.read_header(str(tmp_path / "bad.npy"))


def test_written_matrices_read_back(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "array(id * 1.5D, -id, 0D) AS v").repartition(4)
    rows = matrix.write_matrix(df, str(tmp_path / "out"), "id", "v")
    files = [r[0] for r in rows.select("file").distinct().collect()]
    assert len(files) == 4
    got = {int(r.key): r.vector for r in matrix.embedding_table(spark, files, rows).collect()}
    assert got == {i: [i * 1.5, float(-i), 0.0] for i in range(300)}
    with pytest.raises(Exception, match="one length"):
        matrix.write_matrix(spark.sql("SELECT 1 AS id, array(1D, CAST(NULL AS DOUBLE)) AS v"), str(tmp_path / "bad"), "id", "v")
