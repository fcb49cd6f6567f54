"""Codecs, metadata, keys, stores, stored arrays and the catalogue."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.array import ChunkedArray
from gridloom.plans.catalog import Catalog, consolidate, read_consolidated, remove_consolidated
from gridloom.sources import chunked, codecs, keys, metadata
from gridloom.sources import store as stores
from gridloom.spec import DTYPES, ArrayError, ArraySpec

NAMES = ["none", "zlib", "gzip", "zstd", "lz4", "snappy", "bzip2", "crc32c", "shuffle"]


@given(st.sampled_from(NAMES), st.binary(max_size=3000))
@settings(max_examples=150, deadline=None)
def test_codecs(name, data):
    c = codecs.codec(name)
    assert c.decode(c.encode(data)) == data


def test_checksum():
    assert codecs.crc32c(b"123456789") == 0xE3069283
    with pytest.raises(ArrayError, match="checksum_mismatch"):
        codecs.codec("crc32c").decode(b"abcdefgh")
    with pytest.raises(ArrayError, match="unsupported_codec"):
        codecs.codec("blosc").encode(b"x")
    assert codecs.shuffle(b"abcdef", 2) == b"acebdf"


@pytest.mark.parametrize(("names", "code"), [([], "empty_codec_list"), (["zstd"], "missing_array_to_bytes_codec"), (["bytes", "bytes"], "multiple_array_to_bytes_codecs"), (["zstd", "bytes"], "invalid_codec_order"), (["bytes", "nope"], "unknown_codec")])
def test_pipeline_errors(names, code):
    with pytest.raises(ArrayError) as e:
        codecs.Pipeline.parse([{"name": n} for n in names])
    assert e.value.code == code


@pytest.mark.parametrize("steps", [[("delta", {})], [("transpose", {"order": [1, 0]})], [("quantize", {"digits": 2})], [("fixedscaleoffset", {"scale": 0.25, "offset": 1.0, "astype": "<i4"})], [("transpose", {"order": [1, 0]}), ("delta", {})]])
@pytest.mark.parametrize("endian", ["little", "big"])
def test_pipeline(steps, endian):
    x = (np.arange(24).reshape(4, 6) * 0.25).astype("<f8")
    p = codecs.Pipeline.parse([*({"name": n, "configuration": c} for n, c in steps), {"name": "bytes", "configuration": {"endian": endian}}, {"name": "zstd"}, {"name": "crc32c"}])
    assert (p.decode(p.encode(x), "<f8", x.shape) == x).all()


@given(st.dictionaries(st.tuples(st.integers(0, 9), st.integers(0, 9)), st.binary(max_size=50), max_size=8), st.sampled_from(["end", "start"]))
def test_shards(chunks, at):
    assert codecs.shard_decode(codecs.shard_encode(chunks, at), at) == chunks


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=4), st.sampled_from([2, 3]))
def test_keys(index, version):
    key = keys.encode(tuple(index), version)
    assert keys.valid(key, version) and keys.decode(key, version) == tuple(index)


@pytest.mark.parametrize("bad", ["", "-1.0", "a.b", "1.", "01.2", "c/1"])
def test_bad_keys(bad):
    with pytest.raises(ArrayError, match="invalid_chunk_key"):
        keys.decode(bad, 2)


@pytest.mark.parametrize("dtype", sorted(DTYPES))
def test_metadata(dtype):
    s = ArraySpec((10, 20), (5, 10), dtype, "zlib", 4, filters=({"id": "shuffle", "elementsize": 4},))
    assert metadata.from_json(metadata.to_json(s)) == s
    v3 = metadata.v2_to_v3(s)
    again = metadata.from_json(metadata.to_json(v3))
    assert (again.shape, again.chunks, again.dtype, again.codecs) == (v3.shape, v3.chunks, v3.dtype, v3.codecs)
    back = metadata.v3_to_v2(again)
    assert (back.compressor, back.chunks, back.dtype) == ("zlib", s.chunks, dtype)


def test_metadata_edges():
    assert ArraySpec((2,), (2,), fill_value=None).fill == 0
    assert np.isnan(metadata.from_json(metadata.to_json(ArraySpec((2,), (2,), fill_value=float("nan")))).fill)
    sharded = ArraySpec((20, 20), (5, 5), version=3, shard=(2, 2))
    assert metadata.from_json(metadata.to_json(sharded)).shard == (2, 2)
    assert metadata.compatibility(sharded)[0] == "error"
    assert metadata.compatibility(ArraySpec((2,), (2,), version=3, names=("x",)))[0] == "warning"
    with pytest.raises(ArrayError, match="incompatible"):
        metadata.v3_to_v2(sharded)
    with pytest.raises(ArrayError, match="unsupported_dtype"):
        metadata.from_v2({"shape": [2], "chunks": [2], "dtype": "<M8[ns]"})


@pytest.mark.parametrize("kind", ["directory", "zip", "memory"])
def test_stores(tmp_path, kind):
    s = stores.open_store({"directory": str(tmp_path / "d"), "zip": str(tmp_path / "a.zip"), "memory": f"memory://{tmp_path}"}[kind])
    assert s.get("x/y") is None
    s.put("x/y", b"1")
    s.put("z", b"2")
    s.put("z", b"3")
    assert s.get("x/y") == b"1" and s.get("z") == b"3" and sorted(s.keys()) == ["x/y", "z"]
    s.delete("z")
    s.delete("z")
    assert list(s.keys()) == ["x/y"] and s.exists()


def test_store_registry():
    with pytest.raises(ArrayError, match="unknown_backend"):
        stores.open_store("x", "nope")
    with pytest.raises(ArrayError, match="already_registered"):
        stores.register("zip", stores.ZipStore)
    faulty = stores.FaultyStore(stores.MemoryStore("faulty"), ("put",))
    with pytest.raises(ArrayError, match="storage_failed"):
        faulty.put("a", b"")
    assert faulty.calls == {"put": 1}


@pytest.mark.parametrize("dtype", ["int16", "uint8", "uint64", "float32", "bool", "complex128", "int64"])
@pytest.mark.parametrize("options", [{"compressor": "zlib"}, {"version": 3, "shard": (2, 1)}, {"order": "F"}, {"big_endian": True}])
def test_stored_arrays(spark, tmp_path, dtype, options):
    x = (np.arange(60).reshape(6, 10) % 7).astype(DTYPES[dtype].numpy)
    a = ChunkedArray.from_numpy(spark, x, (4, 3), dtype=dtype)
    spec = ArraySpec(x.shape, (4, 3), dtype, **options)
    path = str(tmp_path / "a")
    chunked.write(a.cells, spec, path)
    got = {(r["d0"], r["d1"]): r["value"] for r in chunked.scan(spark, path).collect()}
    want = {(i, j): complex(x[i, j]) if dtype == "complex128" else x[i, j].item() for i in range(6) for j in range(10)}
    assert {k: complex(v["re"], v["im"]) if dtype == "complex128" else v for k, v in got.items()} == want


def test_sparse_zip_and_pruning(spark, tmp_path):
    spec = ArraySpec((100,), (10,), "int32", fill_value=-1)
    cells = spark.createDataFrame([(5, 1), (95, 2)], "d0 long, value int")
    path = str(tmp_path / "a.zip")
    assert chunked.write(cells, spec, path).count() == 2
    assert chunked.scan(spark, path).count() == 20
    assert chunked.scan(spark, path, absent="fill").count() == 100
    assert chunked.scan(spark, path).where("d0 >= 90 AND value > 0").collect()[0]["value"] == 2
    assert {r["key"] for r in chunked.stored_chunks(spark, path).collect()} == {"0", "9"}


def test_catalog(spark, tmp_path):
    s = stores.open_store(str(tmp_path / "g"))
    c = Catalog(s)
    c.create_array("a/b/x", ArraySpec((4,), (2,), "int32"))
    c.set_attr("a", "units", "K")
    assert c.groups() == ["a"] and c.groups("a") == ["b"] and c.arrays("a/b") == ["x"]
    assert c.get_attr("a", "units") == "K" and "a/b/x" in c
    with pytest.raises(ArrayError, match="path_is_array"):
        c.require_group("a/b/x")
    with pytest.raises(ArrayError, match="node_exists"):
        c.create_array("a/b/x", ArraySpec((4,), (2,)))
    with pytest.raises(ArrayError, match="not_found"):
        c["nope"]
    assert c.tree() == "/\n└── a\n    └── b\n        └── x (4,) int32"
    assert len(consolidate(s)) == 5 and read_consolidated(s)
    again = Catalog.open(str(tmp_path / "g"))
    assert again["a/b/x"].spec.dtype == "int32" and again.get_attr("a", "units") == "K"
    remove_consolidated(s)
    assert read_consolidated(s) is None
    assert Catalog.open(str(tmp_path / "g")).arrays("a/b") == ["x"]
    c.pop("a/b")
    assert "a/b/x" not in c and json.loads(s.get("a/b/x/.zarray"))["shape"] == [4]
    assert again.dataframe(spark).where("kind = 'array'").count() == 1


def test_chunk_table_updates_absent_chunks(spark, tmp_path):
    small, path = ArraySpec((4,), (4,), "float64"), str(tmp_path / "t")
    cells = spark.createDataFrame([(i, float(i)) for i in range(4)], "d0 long, value double")
    chunked.write_chunk_table(cells, small, path)
    grown = small.with_shape((8,))
    chunked.update_chunk_table(spark.createDataFrame([(6, 60.0)], "d0 long, value double"), grown, path, [(6, 7)])
    got = {r.d0: r.value for r in chunked.read_chunk_table(spark, grown, path).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0, 4: 0.0, 5: 0.0, 6: 60.0, 7: 0.0}
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception, match="another shape"):
        chunked.read_chunk_table(spark, ArraySpec((8,), (5,), "float64"), path).collect()


def test_sparse_chunk_table_has_only_chunks_with_cells(spark, tmp_path):
    spec, path = ArraySpec((1_000_000, 1_000_000), (100, 100), "float64"), str(tmp_path / "t")
    cells = spark.createDataFrame([(5, 5, 1.0), (999_999, 7, 2.0)], "d0 long, d1 long, value double")
    chunked.write_chunk_table(cells, spec, path)
    got = chunked.read_chunk_table(spark, spec, path)
    assert got.count() == 20_000 and {(r.d0, r.d1, r.value) for r in got.where("value > 0").collect()} == {(5, 5, 1.0), (999_999, 7, 2.0)}
    a = ChunkedArray(spec, cells)
    found = {(r.c0, r.c1): r.data for r in a.blocks((0, 0), (50, 150)).collect()}
    assert set(found) == {(0, 0), (0, 1)} and found[0, 0][505] == 1.0 and set(found[0, 1]) == {0.0}
    mask = spark.createDataFrame([(5, 5, True), (5, 6, True), (5, 7, False)], "d0 long, d1 long, m boolean")
    assert {(r.flat, r.value) for r in a.mask(mask).collect()} == {(5_000_005, 1.0), (5_000_006, 0.0)}


def test_array_in_a_file_system(spark, tmp_path):
    uri = f"file://{tmp_path}/a"
    s = stores.open_store(uri, "filesystem")
    assert s.get("x/y") is None and not s.exists()
    s.put("x/y", b"1")
    s.put("x/y", b"2")
    assert s.get("x/y") == b"2" and s.get("x") is None and list(s.keys()) == ["x/y"]
    s.delete("x/y")
    s.delete("x/y")
    assert not s.exists() and stores.kind_of("s3://b/a.zip") == "filesystem" and stores.kind_of("file:///a") == "directory"
    spec = ArraySpec((10, 7), (4, 3), "int32", version=3)
    cells = spark.range(70).selectExpr("id div 7 as d0", "id % 7 as d1", "cast(id as int) as value")
    chunked.write(cells, spec, uri, "filesystem")
    got = {(r.d0, r.d1, r.value) for r in chunked.scan(spark, uri, backend="filesystem").where("d0 >= 3 and d1 < 5").collect()}
    assert got == {(i // 7, i % 7, i) for i in range(70) if i // 7 >= 3 and i % 7 < 5}


def test_late_rows_are_dropped(spark, tmp_path):
    from gridloom.streaming.append import windowed_stats

    source, seen = str(tmp_path / "in"), []
    kind = "ts timestamp, value double"

    def add(*rows):
        spark.sql("select " + ", ".join(f"timestamp'{t}' as ts, cast({v} as double) as value" for t, v in rows[:1])).write.mode("append").parquet(source)
        events = spark.readStream.schema(kind).parquet(source)
        stats = windowed_stats(events, "ts", "value", "1 hour", "10 minutes")
        stats.writeStream.foreachBatch(lambda b, e: seen.extend((str(r.window.start), r.n) for r in b.collect())).outputMode("append").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination(60)

    add(("2024-01-01 00:30:00", 1))
    add(("2024-01-01 05:00:00", 2))
    add(("2024-01-01 00:40:00", 3))  # its window is closed
    add(("2024-01-01 09:00:00", 4))
    assert seen == [("2024-01-01 00:00:00", 1), ("2024-01-01 05:00:00", 1)]
