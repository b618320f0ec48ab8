import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helixframe.sources import matrix as X
from helixframe.sources import sinks


def rows(df):
    return [r["value"] for r in df.orderBy("file", "row").collect()]


@pytest.mark.parametrize("kind", ["<f4", ">f8", "f2", "u1", "i8", "b1"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_every_row_of_every_type(spark, tmp_path, kind, order):
    a = np.asarray(np.random.default_rng(0).integers(0, 2, (101, 7)) * 3, dtype=kind, order=order)
    np.save(tmp_path / "a.npy", a)
    got = X.read_matrix(spark, str(tmp_path / "a.npy"), split_bytes=64)
    assert got.rdd.getNumPartitions() > 4
    assert np.array_equal(np.array(rows(got)), a.astype(a.dtype.newbyteorder("=")))


def test_odd_values_and_shapes(spark, tmp_path):
    a = np.array([[np.nan, np.inf], [-np.inf, -0.0]])
    np.save(tmp_path / "a.npy", a)
    assert np.array_equal(np.array(rows(X.read_matrix(spark, f"file://{tmp_path}/a.npy"))), a, equal_nan=True)
    for name, empty in (("none", np.zeros((0, 4))), ("thin", np.zeros((3, 0)))):
        np.save(tmp_path / f"{name}.npy", empty)
        assert rows(X.read_matrix(spark, str(tmp_path / f"{name}.npy"))) == [[]] * len(empty)
    for bad in (np.zeros((2, 2, 2)), np.array(1.0), np.zeros(2, dtype=complex), np.array([{}], dtype=object)):
        np.save(tmp_path / "bad.npy", bad)
        with pytest.raises(Exception, match="cannot be read as rows"):
            X.read_matrix(spark, str(tmp_path / "bad.npy")).collect()


def test_a_folder_of_files(spark, tmp_path):
    a = np.arange(12.0).reshape(6, 2)
    for n in range(3):
        np.save(tmp_path / f"{n}.npy", a[2 * n : 2 * n + 2])
    assert rows(X.read_matrix(spark, str(tmp_path))) == a.tolist()
    np.save(tmp_path / "3.npy", np.zeros((1, 3)))
    with pytest.raises(Exception, match="differ in type or width"):
        X.read_matrix(spark, str(tmp_path)).collect()


def test_a_file_that_ends_early(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((100, 4)))
    whole = (tmp_path / "a.npy").read_bytes()
    (tmp_path / "a.npy").write_bytes(whole[:-8])
    with pytest.raises(Exception, match="ends 8 bytes early"):
        X.read_matrix(spark, str(tmp_path / "a.npy")).collect()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives(spark, tmp_path, save):
    ids, c = np.array(["f1", "längste", ""]), np.arange(9.0, dtype=np.float32).reshape(3, 3)
    save(tmp_path / "c.npz", family_ids=ids, centroids=c, eigenprotein_ids=np.array([7, 8, 9]))
    got = X.read_matrix(spark, str(tmp_path / "c.npz"), "centroids", split_bytes=16)
    assert rows(got) == c.tolist() and got.rdd.getNumPartitions() == (3 if save is np.savez else 1)
    back = {r["family_id"]: (r["centroid"], r["representative"]) for r in sinks.load_centroids(spark, f"file://{tmp_path}/c.npz").collect()}
    assert back == {"f1": ([0, 1, 2], "7"), "längste": ([3, 4, 5], "8"), "": ([6, 7, 8], "9")}
    with pytest.raises(Exception, match="no member 'other'"):
        X.read_matrix(spark, str(tmp_path / "c.npz"), "other").collect()


def test_vectors_with_ids(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.eye(3, dtype=np.float32))
    ids = spark.createDataFrame([(0, "a"), (2, "c")], "row long, protein_id string")
    got = {r["protein_id"]: r["embedding"] for r in sinks.load_matrix(spark, str(tmp_path / "v.npy"), ids).collect()}
    assert got == {"a": [1, 0, 0], "c": [0, 0, 1]}
    assert sorted(r["protein_id"] for r in sinks.load_matrix(spark, str(tmp_path / "v.npy")).collect()) == ["0", "1", "2"]


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(0, 50), d=st.integers(0, 5), split=st.integers(1, 200), order=st.sampled_from("CF"))
def test_partitions_cover_each_row_once(tmp_path, n, d, split, order):
    a = np.asarray(np.arange(n * d).reshape(n, d), dtype=np.int32, order=order)
    np.save(tmp_path / "a.npy", a)
    h = X.header(str(tmp_path / "a.npy"))
    parts = X.MatrixReader([h], split).partitions()
    got = [b for p in parts for b in X._blocks(p)]
    assert [i for first, b in got for i in range(first, first + len(b))] == list(range(n))
    assert n == 0 or np.array_equal(np.concatenate([b for _, b in got]), a)
