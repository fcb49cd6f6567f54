"""The array interface against NumPy, on the shapes of the blueprint's fixtures."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.array import ChunkedArray
from gridloom.functions import geometry as G
from gridloom.functions import indexing as I
from gridloom.spec import ArrayError, ArraySpec, strides


@pytest.fixture(scope="module")
def grid10(spark):
    return ChunkedArray.from_numpy(spark, np.arange(100, dtype="int32").reshape(10, 10), (4, 3))


def values(df, shape, fill=0):
    out = np.full(shape, fill, dtype="f8")
    for r in df.collect():
        out[tuple(r[i] for i in range(len(shape)))] = r["value"]
    return out


X = np.arange(100).reshape(10, 10)


def test_slices(grid10):
    assert len(grid10.to_bytes()) == 400
    assert (values(grid10.slice((2, 3), (5, 7)), (3, 4)) == X[2:5, 3:7]).all()
    assert grid10.slice((5, 5), (6, 6)).first()["value"] == 55
    assert grid10.slice((3, 3), (3, 5)).count() == 0
    assert (values(grid10.slice((0, 0), (10, 10), 2), (5, 10)) == X[::2]).all()
    assert (values(grid10.slice((0, 1), (10, 10), (3, 4)), (4, 3)) == X[::3, 1::4]).all()
    assert (values(grid10.slice((9, 0), (-1, 10), (-2, 1)), (5, 10)) == X[::-2]).all()
    assert (values(grid10[3, ::-1], (10,)) == X[3, ::-1]).all()
    for bad, code in ((((0, 0), (11, 10)), "out_of_bounds"), (((5, 0), (3, 10)), "invalid_range"), (((0,), (10,)), "dimension_mismatch")):
        with pytest.raises(ArrayError) as e:
            grid10.slice(*bad)
        assert e.value.code == code
    with pytest.raises(ArrayError, match="invalid_step"):
        grid10.slice(step=0)


def test_indexing(grid10, spark):
    got = {r["pos"]: r["value"] for r in grid10.vindex([0, 1, 2, 2, -1], [5, 0, 5, 5, -1]).collect()}
    assert got == {0: 5, 1: 10, 2: 25, 3: 25, 4: 99}
    assert grid10.vindex([], []).count() == 0
    assert (values(grid10.oindex([0, 2], [1, 3]), (2, 2)) == [[1, 3], [21, 23]]).all()
    mask = G.grid(spark, (10, 10)).withColumn("m", (G.flat_index(["d0", "d1"], (10, 10)) % 37) == 0)
    assert sorted(r["value"] for r in grid10.mask(mask).collect()) == [0, 37, 74]
    with pytest.raises(ArrayError, match="length_mismatch"):
        grid10.vindex([1], [1, 2])
    with pytest.raises(ArrayError, match="out_of_bounds"):
        grid10.vindex([10], [0])


def test_named(spark):
    a = ChunkedArray.from_numpy(spark, np.arange(6000, dtype="int32").reshape(10, 20, 30), (5, 10, 15), names=("time", "latitude", "longitude"))
    assert a.sel(time=range(0, 5), latitude=range(0, 10), longitude=range(0, 15)).count() == 750
    assert a.sel(time=range(0, 3)).count() == 1800
    assert a.sel(latitude=(0, 10)).count() == 3000
    assert a.sel(time=4).count() == 600
    with pytest.raises(ArrayError, match="unknown_dimension"):
        a.sel(depth=1)


def test_blocks(spark):
    a = ChunkedArray.from_numpy(spark, np.arange(400, dtype="int32").reshape(20, 20), (10, 10))
    assert a.blocks().count() == 4
    assert a.blocks((0, 0), (5, 5)).count() == 1
    assert a.blocks((3, 3), (3, 3)).count() == 0
    assert a.blocks((8, 8), (12, 12)).count() == 4


def test_writes(grid10, spark):
    line = ChunkedArray.create(spark, (10,), (4,), dtype="int32")
    assert line.to_numpy().tolist() == [0] * 10
    stepped = line.set_bytes(np.arange(100, 105, dtype="<i4").tobytes(), [0], [10], [2])
    assert stepped.to_numpy().tolist() == [100, 0, 101, 0, 102, 0, 103, 0, 104, 0]
    with pytest.raises(ArrayError, match="size_mismatch"):
        line.set_bytes(b"123", [0], [10])
    twice = grid10.set_numpy(np.full((2, 2), -5), (4, 4)).set_numpy(np.full((1, 1), 7), (5, 5))
    want = X.copy()
    want[4:6, 4:6] = -5
    want[5, 5] = 7
    assert (twice.to_numpy() == want).all()


def test_resize_and_append(spark):
    a = ChunkedArray.from_numpy(spark, X.astype("int32"), (4, 4), fill_value=-1)
    big = a.resize(20, 20)
    assert big.to_numpy()[15, 15] == -1 and big.to_numpy()[9, 9] == 99
    # Cells that a shrink drops don't come back.
    assert (a.resize(5, 5).resize(10, 10).to_numpy()[5:] == -1).all()
    b = ChunkedArray.from_numpy(spark, np.arange(50, dtype="int32").reshape(5, 10), (2, 5))
    more = b.append(np.arange(50, 70).reshape(2, 10))
    assert more.spec.shape == (7, 10) and more.to_numpy()[5, 0] == 50
    assert b.append(np.zeros((5, 3)), 1).spec.shape == (5, 13)
    with pytest.raises(ArrayError, match="invalid_axis"):
        b.append(np.zeros((1, 10)), -1)


def test_streams(grid10):
    seen = []
    got = dict(grid10.chunk_stream(where=lambda i: i[0] == 0, progress=lambda a, b: seen.append((a, b))))
    assert set(got) == {(0, j) for j in range(4)} and seen[-1][0] == seen[-1][1] == 12
    assert (got[0, 3] == X[:4, 9:]).all()
    sums = {(r["c0"], r["c1"]): r["result"] for r in grid10.chunk_map(lambda i, x: x.sum()).collect()}
    assert sum(sums.values()) == X.sum() and sums[0, 0] == X[:4, :3].sum()


def test_shuffle_is_a_permutation(grid10):
    rows = grid10.shuffled(3, seed=1).select("batch", "at", "sample").distinct().collect()
    assert sorted(r["sample"] for r in rows) == list(range(10))
    assert sorted(r["batch"] * 3 + r["at"] for r in rows) == list(range(10))
    again = grid10.shuffled(3, seed=1).select("batch", "at", "sample").distinct().collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_irregular(spark):
    s = ArraySpec((75, 150), irregular=((50, 25), (100, 50)))
    assert s.chunk_bounds((1, 1)) == [(50, 75), (100, 150)] and s.total_chunks == 4
    assert s.with_shape((80, 150)).irregular[0] == (50, 25, 5)
    with pytest.raises(ArrayError, match="invalid_chunk_grid"):
        ArraySpec((75,), irregular=((50, 20),))


@pytest.mark.parametrize(("change", "code"), [({"shape": ()}, "shape_required"), ({"shape": (0,)}, "invalid_shape"), ({"chunks": None}, "chunks_required"), ({"chunks": (1, 1)}, "dimension_mismatch"), ({"dtype": "float16"}, "unsupported_dtype"), ({"names": ("a b",)}, "invalid_dimension_name"), ({"version": 4}, "unsupported_version")])
def test_validation(change, code):
    with pytest.raises(ArrayError) as e:
        ArraySpec(**({"shape": (10,), "chunks": (5,)} | change))
    assert e.value.code == code


@given(st.integers(1, 50), st.integers(-60, 60), st.integers(-60, 60), st.integers(-5, 5))
@settings(max_examples=300, deadline=None)
def test_slice_sizes(n, a, b, step):
    try:
        s = I.normalize_slice(a, b, step, n)
    except ArrayError:
        return
    assert len(I.slice_indices(s)) == I.slice_size(s)
    assert all(0 <= i < n for i in I.slice_indices(s))


@given(st.lists(st.integers(1, 9), min_size=1, max_size=4))
def test_strides(shape):
    assert [s * 8 for s in strides(tuple(shape))] == list(np.zeros(shape).strides)


@given(st.integers(0, 40), st.integers(0, 40), st.integers(1, 12))
def test_blocks_cover(a, b, c):
    got = I.block_indices(a, b, c)
    assert [x for s, e in got for x in range(s, e)] == list(range(a, b))
    assert all(s // c == (e - 1) // c for s, e in got)


def test_values():
    from gridloom.functions import values as U

    assert U.unpack(U.pack([1.5, -2.5, 3], "int16"), "int16").tolist() == [2, -3, 3]
    assert U.unpack(b"\x00\x01\x07", "bool").tolist() == [False, True, True]
    with pytest.raises(ArrayError, match="out_of_range"):
        U.pack([300], "uint8")
    with pytest.raises(ArrayError, match="size_mismatch"):
        U.unpack(b"abc", "int16")
    assert U.human(2.0) == "2.00 s" and U.human(0.0125) == "12.50 ms" and U.human(5e-6) == "5 us"
