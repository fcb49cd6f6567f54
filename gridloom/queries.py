"""Registered queries: every operator on arrays over the driver's tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import indexing as I
from .functions import values as U
from .operators import analytics as A
from .operators import batch as B
from .operators import filters as L
from .operators import mutate as M
from .operators import select as S
from .plans import catalog as C
from .plans import views as V
from .sources import chunked, codecs, keys, metadata, scratch
from .sources.store import MemoryStore, open_store
from .spec import DTYPES, ArraySpec
from .streaming import append as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


EMB = "(SELECT vec_id AS d0, unnest(range(0, len(embedding))) AS d1, unnest(embedding)::DOUBLE AS value FROM embeddings)"
ORD = "(SELECT o_orderkey AS d0, o_totalprice AS value FROM orders)"
EVT = "(SELECT event_id AS d0, value FROM events)"
CUBE = "(SELECT day(ts) - 1 AS d0, user_id AS d1, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS d2, sum(value) AS value FROM events GROUP BY ALL)"
ITEMS = "(SELECT l_orderkey AS d0, l_linenumber - 1 AS d1, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"
TICK = "(SELECT event_id AS t, user_id AS symbol, value AS price, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0) AS size FROM events)"
FIX = "round(value, 4) AS value"


def emb(spark, d):
    return V.embeddings(spark, d), ArraySpec(V.extent(spark, d, "embeddings", "vec_id + 1", "size(embedding)"), (64, 16), dtype="float64")


def orders(spark, d):
    return V.orders(spark, d), ArraySpec(V.extent(spark, d, "orders", "o_orderkey + 1"), (1000,))


def cube(spark, d):
    return V.cube(spark, d), ArraySpec((31, *V.extent(spark, d, "events", "user_id + 1"), 5), (7, 32, 5), names=("day", "user", "type"))


def fixed(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Floating results rounded, so that the order of a sum doesn't show."""
    return df.withColumns({c: F.round(c, digits) for c in columns or ("value",)})


# Selection
@query(f"SELECT d0 - 100 AS d0, {FIX} FROM {ORD} WHERE d0 >= 100 AND d0 < 600")
def slice_1d(spark, d):
    x, s = orders(spark, d)
    return fixed(S.box(x, s, I.region(s, [100], [600])))


@query(f"SELECT d0, d1 - 8 AS d1, {FIX} FROM {EMB} WHERE d0 < 100 AND d1 >= 8 AND d1 < 24")
def slice_2d(spark, d):
    x, s = emb(spark, d)
    return fixed(S.box(x, s, I.region(s, [0, 8], [100, 24])))


@query(f"SELECT d0 - 3 AS d0, d1 - 10 AS d1, d2 - 1 AS d2, {FIX} FROM {CUBE} WHERE d0 BETWEEN 3 AND 9 AND d1 BETWEEN 10 AND 59 AND d2 BETWEEN 1 AND 3")
def slice_3d(spark, d):
    x, s = cube(spark, d)
    return fixed(S.box(x, s, [(3, 10), (10, 60), (1, 4)]))


@query(f"SELECT d0, d1, d2, {FIX} FROM {CUBE} WHERE d0 BETWEEN 0 AND 6")
def slice_named_inclusive(spark, d):
    x, s = cube(spark, d)
    return fixed(S.named(x, s, day=range(0, 7)))


@query(f"SELECT d0 - 2 AS d0, d1, d2 - 4 AS d2, {FIX} FROM {CUBE} WHERE d0 >= 2 AND d0 < 9 AND d2 = 4")
def slice_named_mixed(spark, d):
    x, s = cube(spark, d)
    return fixed(S.named(x, s, day=(2, 9), type=-1))


@query(f"SELECT (d0 - 10) // 3 AS d0, d1, {FIX} FROM {EMB} WHERE d0 >= 10 AND d0 < 100 AND (d0 - 10) % 3 = 0")
def slice_step(spark, d):
    x, s = emb(spark, d)
    return fixed(S.strided(x, s, [(10, 100, 3), (0, s.shape[1], 1)]))


@query(f"SELECT d0 // 7 AS d0, (d1 - 1) // 5 AS d1, {FIX} FROM {EMB} WHERE d0 % 7 = 0 AND d1 >= 1 AND (d1 - 1) % 5 = 0")
def slice_step_per_dim(spark, d):
    x, s = emb(spark, d)
    return fixed(S.strided(x, s, [(0, s.shape[0], 7), (1, s.shape[1], 5)]))


@query(f"SELECT (99 - d0) // 2 AS d0, {FIX} FROM {ORD} WHERE d0 <= 99 AND d0 > 9 AND (99 - d0) % 2 = 0")
def slice_neg_step(spark, d):
    x, s = orders(spark, d)
    return fixed(S.strided(x, s, [(99, 9, -2)]))


@query(f"SELECT n - 1 - d0 AS d0, {FIX} FROM {ORD}, (SELECT max(o_orderkey) + 1 AS n FROM orders)")
def slice_reversed(spark, d):
    x, s = orders(spark, d)
    return fixed(S.strided(x, s, [I.normalize_slice(None, None, -1, s.shape[0])]))


@query(f"SELECT d0 - (n - 10) AS d0, {FIX} FROM {ORD}, (SELECT max(o_orderkey) + 1 AS n FROM orders) WHERE d0 >= n - 10")
def slice_neg_index(spark, d):
    x, s = orders(spark, d)
    return fixed(S.strided(x, s, [I.normalize_slice(-10, None, None, s.shape[0])]))


@query(f"SELECT d0, {FIX} FROM {ORD} WHERE false")
def slice_empty(spark, d):
    x, s = orders(spark, d)
    return fixed(S.box(x, s, I.region(s, [5], [5])))


@query(f"SELECT d1 // 2 AS d0, {FIX} FROM {EMB} WHERE d0 = 5 AND d1 % 2 = 0")
def index_squeeze(spark, d):
    x, s = emb(spark, d)
    return fixed(S.squeeze(x, s, (5, slice(None, None, 2))))


@query(f"""SELECT pos::BIGINT AS pos, round(coalesce(value, 0), 4) AS value FROM (SELECT p.pos, e.value FROM (SELECT pos, CASE WHEN a < 0 THEN a + n ELSE a END AS d0, CASE WHEN b < 0 THEN b + 64 ELSE b END AS d1
FROM (VALUES (0, 0, 5), (1, 3, 10), (2, 3, 10), (3, -1, -1), (4, 99, 63), (5, 0, 5)) v(pos, a, b), (SELECT max(vec_id) + 1 AS n FROM embeddings)) p LEFT JOIN {EMB} e USING (d0, d1))""")
def fancy_points(spark, d):
    x, s = emb(spark, d)
    return fixed(S.points(x, s, [[0, 3, 3, -1, 99, 0], [5, 10, 10, -1, 63, 5]]))


@query(f"SELECT r.p AS d0, c.p AS d1, round(coalesce(value, 0), 4) AS value FROM (VALUES (0, 7), (1, 2), (2, 50)) r(p, d0) CROSS JOIN (VALUES (0, 63), (1, 0), (2, 8), (3, 8)) c(p, d1) LEFT JOIN {EMB} e ON e.d0 = r.d0 AND e.d1 = c.d1")
def orthogonal(spark, d):
    x, s = emb(spark, d)
    return fixed(S.orthogonal(x, s, [[7, 2, 50], [-1, 0, 8, 8]]))


@query(f"SELECT d0 AS flat, {FIX} FROM {EVT} WHERE value > 300")
def mask_value(spark, d):
    x = V.events(spark, d)
    return fixed(S.where_value(x, V.spec_of(x, (1000,)), F.col("value") > 300))


@query(f"SELECT row_number() OVER (ORDER BY d0, d1) - 1 AS pos, {FIX} FROM {EMB} WHERE value > 0.2")
def mask_numbered(spark, d):
    x, s = emb(spark, d)
    return fixed(S.numbered(S.where_value(x, s, F.col("value") > 0.2), s))


@query(f"SELECT d0 * 64 + d1 AS flat, {FIX} FROM {EMB} WHERE (d0 + d1) % 3 = 0")
def mask_table(spark, d):
    x, s = emb(spark, d)
    mask = G.grid(spark, s.shape).withColumn("m", (F.col("d0") + F.col("d1")) % 3 == 0)
    return fixed(S.masked(x, s, mask))


@query("SELECT c0, c1, c0 * 64 AS start0, least(c0 * 64 + 64, n) AS stop0, c1 * 16 AS start1, c1 * 16 + 16 AS stop1 FROM (SELECT unnest(range(0, 3)) AS c0) CROSS JOIN (SELECT unnest(range(0, 3)) AS c1), (SELECT max(vec_id) + 1 AS n FROM embeddings)")
def blocks_bounds(spark, d):
    x, s = emb(spark, d)
    return S.blocks(s, spark, I.region(s, [10, 5], [150, 40]))


@query("SELECT c0, c1, 1024::BIGINT AS n, round(s, 3) AS total FROM (SELECT d0 // 64 AS c0, d1 // 16 AS c1, sum(value) AS s, count(*) AS n FROM " + EMB + " GROUP BY ALL) WHERE c0 IN (0, 1) AND c1 IN (1, 2)")
def blocks_data(spark, d):
    x, s = emb(spark, d)
    found = S.blocks(s, spark, [(0, 100), (16, 48)]).select("c0", "c1")
    found = M.complete_chunks(x, s, found)
    return fixed(found.select("c0", "c1", F.size("data").cast("long").alias("n"), F.aggregate("data", F.lit(0.0), lambda t, v: t + v).alias("total")), "total", digits=3)


# Geometry
@query(f"SELECT d0 // 1000 AS c0, count(*) AS n FROM {ORD} GROUP BY ALL")
def chunk_index(spark, d):
    x, s = orders(spark, d)
    return G.with_chunks(x, s).groupBy("c0").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c0, c1, c0 * 10 AS start0, least(c0 * 10 + 10, 25) AS stop0, c1 * 10 AS start1, least(c1 * 10 + 10, 15) AS stop1 FROM (SELECT unnest(range(0, 3)) AS c0) CROSS JOIN (SELECT unnest(range(0, 2)) AS c1)")
def chunk_bounds_edge(spark, d):
    return G.chunk_grid(spark, ArraySpec((25, 15), (10, 10)))


@query("SELECT c0, c1, start0, stop0, start1, stop1 FROM (VALUES (0, 0, 50), (1, 50, 75)) a(c0, start0, stop0) CROSS JOIN (VALUES (0, 0, 100), (1, 100, 150)) b(c1, start1, stop1)")
def irregular_bounds(spark, d):
    return G.chunk_grid(spark, ArraySpec((75, 150), irregular=((50, 25), (100, 50))))


@query(f"SELECT CASE WHEN d0 < 10 THEN 0 WHEN d0 < 110 THEN 1 ELSE 2 END AS c0, count(*) AS n FROM {ORD} GROUP BY ALL")
def irregular_index(spark, d):
    x, s = orders(spark, d)
    s = ArraySpec(s.shape, irregular=((10, 100, s.shape[0] - 110),))
    return G.with_chunks(x, s).groupBy("c0").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT f, f // 200 AS d0, f // 20 % 10 AS d1, f % 20 AS d2 FROM (SELECT unnest(range(0, 1000)) AS f)")
def flat_to_multi(spark, d):
    return spark.range(1000).select(F.col("id").alias("f"), *[c.alias(f"d{i}") for i, c in enumerate(G.unflatten(F.col("id"), (5, 10, 20)))])


@query("SELECT d0, d1, d0 * 10 + d1 AS flat FROM (SELECT unnest(range(0, 10)) AS d0) CROSS JOIN (SELECT unnest(range(0, 10)) AS d1)")
def multi_to_flat(spark, d):
    return G.grid(spark, (10, 10)).withColumn("flat", G.flat_index(["d0", "d1"], (10, 10)))


@query("SELECT * FROM (VALUES (0, 5, 200), (1, 10, 20), (2, 20, 1)) t(dim, size, stride)")
def strides(spark, d):
    s = ArraySpec((5, 10, 20), (1, 1, 1))
    return spark.createDataFrame([(i, n, x) for i, (n, x) in enumerate(zip(s.shape, s.strides, strict=True))], "dim int, size int, stride int")


@query("SELECT c0, c1 FROM (SELECT unnest(range(0, 3)) AS c0) CROSS JOIN (SELECT unnest(range(1, 4)) AS c1)")
def slice_to_chunks(spark, d):
    s = ArraySpec((100, 100), (20, 10))
    return S.blocks(s, spark, [(5, 55), (10, 40)]).select("c0", "c1")


@query("SELECT 8 AS rows_, 4 AS columns_, 32 AS total, 8192 AS chunk_bytes, '(0,5)' AS block")
def num_chunks(spark, d):
    s = ArraySpec((500, 64), (64, 16))
    a, b = I.block_indices(0, 5, 10)[0]
    return spark.createDataFrame([(*s.num_chunks, s.total_chunks, s.chunk_size_bytes, f"({a},{b})")], "rows_ int, columns_ int, total int, chunk_bytes int, block string")


@query("SELECT c0, c1, c0 || '.' || c1 AS v2, 'c/' || c0 || '/' || c1 AS v3 FROM (SELECT unnest(range(0, 5)) AS c0) CROSS JOIN (SELECT unnest(range(0, 10)) AS c1)")
def chunk_keys(spark, d):
    index = [F.col("c0"), F.col("c1")]
    return G.grid(spark, (5, 10), "c").select("c0", "c1", G.chunk_key(index, 2).alias("v2"), G.chunk_key(index, 3).alias("v3"))


@query("SELECT * FROM (VALUES ('0.1', true, 0, 1), ('12.30', true, 12, 30), ('-1.0', false, NULL, NULL), ('a.b', false, NULL, NULL), ('1', false, NULL, NULL), ('01.2', false, NULL, NULL)) t(key, valid, c0, c1)")
def decode_keys(spark, d):
    k = spark.createDataFrame([(x,) for x in ("0.1", "12.30", "-1.0", "a.b", "1", "01.2")], "key string")
    at = G.key_index(F.col("key"), 2, 2)
    return k.select("key", G.key_valid(F.col("key"), 2, 2).alias("valid"), at[0].alias("c0"), at[1].alias("c1"))


# Fill, mutation, layout
_GRID = "(SELECT unnest(range(0, 5)) AS d0) CROSS JOIN (SELECT unnest(range(0, 20)) AS d1) CROSS JOIN (SELECT unnest(range(0, 5)) AS d2)"


@query(f"SELECT d0, d1, d2, round(coalesce(value, 0), 4) AS value FROM {_GRID} LEFT JOIN {CUBE} USING (d0, d1, d2)")
def fill_densify(spark, d):
    x, s = cube(spark, d)
    return fixed(S.densify(S.box(x, s, [(0, 5), (0, 20), (0, 5)]), (5, 20, 5), 0.0))


@query(f"SELECT d1, d2, round(sum(value) / 31, 6) AS mean FROM {CUBE} GROUP BY ALL")
def sparse_mean_with_fill(spark, d):
    x, s = cube(spark, d)
    return fixed(A.mean_over(x, s, 0), "mean", digits=6)


@query(f"SELECT round(sum(value) + 1.5 * (size - count(*)), 2) AS sum, round((sum(value) + 1.5 * (size - count(*))) / size, 4) AS mean, count(*) AS stored FROM {CUBE}, (SELECT 31 * (max(user_id) + 1) * 5 AS size FROM events) GROUP BY size")
def array_totals(spark, d):
    x, s = cube(spark, d)
    s = ArraySpec(s.shape, s.chunks, fill_value=1.5)
    return A.overall(x, s).select(F.round("sum", 2).alias("sum"), F.round("mean", 4).alias("mean"), "stored")


@query(f"SELECT d0, d1, round(CASE WHEN d0 >= 10 AND d0 < 20 AND d1 >= 5 AND d1 < 9 THEN (d0 - 10) * 100 + d1 - 5 ELSE value END, 4) AS value FROM {EMB}")
def overlay_region(spark, d):
    x, s = emb(spark, d)
    patch = G.grid(spark, (10, 4)).withColumn("value", (F.col("d0") * 100 + F.col("d1")).cast("double"))
    return fixed(M.set_region(x, s, patch, [10, 5]))


@query(f"SELECT d0, round(CASE WHEN d0 >= 3 AND d0 < 33 AND (d0 - 3) % 3 = 0 THEN 1000 + (d0 - 3) // 3 ELSE value END, 4) AS value FROM {ORD}")
def overlay_strided(spark, d):
    x, s = orders(spark, d)
    patch = G.grid(spark, (10,)).withColumn("value", (F.col("d0") + 1000).cast("double"))
    return fixed(M.set_region(x, s, patch, [3], [3]))


@query(f"SELECT d0, d1, round(CASE WHEN d0 < 10 AND d1 < 4 THEN value * 2 ELSE value END, 4) AS value FROM {EMB}")
def region_scaled(spark, d):
    x, s = emb(spark, d)
    return fixed(M.set_scalar(x, s, [(0, 10), (0, 4)], F.col("value") * 2))


@query("SELECT d0, d1, CASE WHEN d0 < 10 AND d1 < 10 THEN d0 * 10 + d1 ELSE -1 END AS value FROM (SELECT unnest(range(0, 20)) AS d0) CROSS JOIN (SELECT unnest(range(0, 20)) AS d1)")
def resize_grow(spark, d):
    s = ArraySpec((10, 10), (4, 4), "int64", fill_value=-1)
    cells, s = M.resize(G.grid(spark, (10, 10)).withColumn("value", F.col("d0") * 10 + F.col("d1")), s, (20, 20))
    return S.densify(cells, s.shape, s.fill)


@query(f"SELECT d0, d1, {FIX} FROM {EMB} WHERE d0 < 50 AND d1 < 10")
def resize_shrink(spark, d):
    x, s = emb(spark, d)
    return fixed(M.resize(x, s, (50, 10))[0])


@query(f"SELECT d0, {FIX} FROM {ORD} UNION ALL SELECT i + n, i * 1.0 FROM (SELECT unnest(range(0, 7)) AS i), (SELECT max(o_orderkey) + 1 AS n FROM orders)")
def append_axis0(spark, d):
    x, s = orders(spark, d)
    return fixed(M.append(x, s, G.grid(spark, (7,)).withColumn("value", F.col("d0").cast("double")), 7)[0])


@query(f"SELECT d0, d1, {FIX} FROM {EMB} UNION ALL SELECT vec_id, 64 + j, j * 1.0 FROM embeddings, (SELECT unnest(range(0, 3)) AS j)")
def append_axis1(spark, d):
    x, s = emb(spark, d)
    return fixed(M.append(x, s, G.grid(spark, (s.shape[0], 3)).withColumn("value", F.col("d1").cast("double")), 3, 1)[0])


@query(f"SELECT d0, d1, {FIX} FROM {EMB} WHERE NOT (d0 // 64 = 1 AND d1 // 16 = 2)")
def delete_chunk(spark, d):
    x, s = emb(spark, d)
    return fixed(M.delete_chunk(x, s, (1, 2)))


@query(f"SELECT d1 AS d0, d0 AS d1, {FIX} FROM {EMB}")
def transpose_2d(spark, d):
    return fixed(S.transpose(V.embeddings(spark, d), (1, 0)))


@query(f"SELECT d2 AS d0, d0 AS d1, d1 AS d2, {FIX} FROM {CUBE}")
def transpose_3d(spark, d):
    return fixed(S.transpose(V.cube(spark, d), (2, 0, 1)))


@query(f"SELECT d0, d1, {FIX} FROM {EMB}")
def chunk_layout_roundtrip(spark, d):
    x, s = emb(spark, d)
    return fixed(M.to_cells(M.to_chunks(x, s), s).select("d0", "d1", "value"))


@query(f"SELECT d0, d1, round(coalesce(value, 0), 4) AS value FROM (SELECT unnest(range(0, n)) AS d0 FROM (SELECT max(l_orderkey) + 1 AS n FROM lineitem)) CROSS JOIN (SELECT unnest(range(0, 7)) AS d1) LEFT JOIN {ITEMS} USING (d0, d1)")
def grid_line_items(spark, d):
    x = V.line_items(spark, d)
    s = V.spec_of(x, (1000, 7))
    return fixed(S.densify(x.select("d0", "d1", "value"), s.shape, 0.0))


# Filters
@query(f"SELECT d0, round(value - coalesce(lag(value) OVER (PARTITION BY d0 // 1000 ORDER BY d0), 0), 4) AS value FROM {ORD}")
def delta_encode(spark, d):
    x, s = orders(spark, d)
    return fixed(L.delta_encode(x, s))


@query(f"SELECT d0, {FIX} FROM {ORD}")
def delta_decode(spark, d):
    x, s = orders(spark, d)
    return fixed(L.delta_decode(L.delta_encode(x, s), s))


@query(f"SELECT d0, d1, round(round(value * 100) / 100, 6) AS value FROM {EMB}")
def quantize_digits(spark, d):
    x, _ = emb(spark, d)
    return fixed(x.withColumn("value", L.quantize_digits(F.col("value"), 2)), digits=6)


@query(f"SELECT d0, least(greatest(round((value - 100) / 0.01), -32768), 32767)::SMALLINT AS value FROM {ORD}")
def quantize_int16_clamp(spark, d):
    x, _ = orders(spark, d)
    return x.withColumn("value", L.scale_encode(F.col("value"), 0.01, 100.0))


@query(f"SELECT d0, round(round((value - 10) / 0.5) * 0.5 + 10, 6) AS value FROM {EVT}")
def fixedscaleoffset_roundtrip(spark, d):
    x = V.events(spark, d)
    return fixed(x.withColumn("value", L.scale_decode(L.scale_encode(F.col("value"), 0.5, 10.0, "int32"), 0.5, 10.0)), digits=6)


@query(f"SELECT d0, least(greatest(trunc(value), -128), 127)::TINYINT AS value FROM {EVT}")
def astype_int8(spark, d):
    return V.events(spark, d).withColumn("value", L.astype(F.col("value"), "int8"))


@query(f"SELECT d0, round(round(value / 16) * 16, 4) AS value FROM {EVT}")
def bitround_magnitude(spark, d):
    return fixed(V.events(spark, d).withColumn("value", L.bitround_magnitude(F.col("value"), 48)))


@query(f"SELECT d0, CASE WHEN value = 0 THEN 0 ELSE sign(value) * floor(abs(value) / pow(2, floor(log2(abs(value))) - 10)) * pow(2, floor(log2(abs(value))) - 10) END AS value FROM {EVT}")
def bitround_mantissa(spark, d):
    return V.events(spark, d).withColumn("value", L.bitround_mantissa(F.col("value"), 10))


# Analytics
@query(f"SELECT d0 // 64 AS c0, d1 // 16 AS c1, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS greatest, round(stddev_pop(value), 4) AS deviation, count(*) AS n FROM {EMB} GROUP BY ALL")
def chunk_stats(spark, d):
    x, s = emb(spark, d)
    return fixed(A.chunk_stats(x, s), "mean", "least", "greatest", "deviation")


_OHLC = f"SELECT symbol, arg_min(price, t) AS open, max(price) AS high, min(price) AS low, arg_max(price, t) AS close, round(sum(price * size) / greatest(sum(size), 1e-9), 4) AS vwap, count(*) AS n FROM {TICK} GROUP BY symbol"


@query(_OHLC)
def ohlc_vwap(spark, d):
    return fixed(A.ohlc(V.ticks(spark, d)), "vwap")


@query(_OHLC)
def ohlc_chunk_merge(spark, d):
    return fixed(A.ohlc_by_chunk(V.ticks(spark, d), 500), "vwap")


@query(f"SELECT d1, d2, round(avg(value), 6) AS mean FROM {CUBE} GROUP BY ALL")
def temporal_mean(spark, d):
    x, s = cube(spark, d)
    return fixed(A.mean_over(x, s, 0, densify=False), "mean", digits=6)


@query(f"SELECT d1 % 5 AS zone, round(avg(value), 6) AS mean, count(*) AS pixels FROM {CUBE} GROUP BY ALL")
def zonal_mean(spark, d):
    return fixed(A.zonal_mean(V.cube(spark, d), V.zones(spark, d), ["d1"]), "mean", digits=6)


@query(f"SELECT d0, d1, round(CASE WHEN a + b = 0 THEN 0 ELSE (a - b) / (a + b) END, 4) AS index FROM (SELECT d0, d1, coalesce(max(value) FILTER (d2 = 4), 0) AS a, coalesce(max(value) FILTER (d2 = 0), 0) AS b FROM {CUBE} WHERE d2 IN (0, 4) GROUP BY ALL)")
def ndvi_pair(spark, d):
    return fixed(A.band_difference(V.cube(spark, d), "d2", 4, 0, ["d0", "d1"]), "index")


@query(f"SELECT d2, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS greatest, round(stddev_pop(value), 6) AS deviation, count(*) AS n FROM {CUBE} WHERE d0 < 15 AND d1 BETWEEN 20 AND 79 GROUP BY ALL")
def region_stats(spark, d):
    x, s = cube(spark, d)
    return fixed(A.describe(S.box(x, s, [(0, 15), (20, 80), (0, 5)]), "d2"), "mean", "least", "greatest", "deviation", digits=6)


@query("SELECT month(o_orderdate) AS month, round(avg(o_totalprice), 6) AS mean, round(min(o_totalprice), 6) AS least, round(max(o_totalprice), 6) AS greatest, round(stddev_pop(o_totalprice), 6) AS deviation, count(*) AS n FROM orders GROUP BY ALL")
def monthly_stats(spark, d):
    x = V.table(spark, d, "orders").select(F.month("o_orderdate").cast("long").alias("month"), F.col("o_totalprice").alias("value"))
    return fixed(A.describe(x, "month"), "mean", "least", "greatest", "deviation", digits=6)


@query(f"SELECT (SELECT d0 FROM {EVT} ORDER BY value, d0 LIMIT 1) AS argmin, (SELECT d0 FROM {EVT} ORDER BY value DESC, d0 LIMIT 1) AS argmax, (SELECT min(value) FROM events) AS least, (SELECT max(value) FROM events) AS greatest")
def argmin_argmax(spark, d):
    return A.arg_extremes(V.events(spark, d), "d0")


@query(f"SELECT a.d1, round(corr(a.value, b.value), 4) AS r, count(*) AS n FROM (SELECT * FROM {CUBE} WHERE d2 = 4) a JOIN (SELECT * FROM {CUBE} WHERE d2 = 0) b ON a.d0 = b.d0 AND a.d1 = b.d1 GROUP BY a.d1 HAVING count(*) > 5")
def pearson(spark, d):
    x = V.cube(spark, d)
    a, b = (x.where(F.col("d2") == k).select("d0", "d1", "value") for k in (4, 0))
    return fixed(A.correlation(a, b, ["d0", "d1"], "d1").where("n > 5"), "r")


@query(f"SELECT d0, d1, round((value - avg(value) OVER (PARTITION BY d1)) / stddev_pop(value) OVER (PARTITION BY d1), 4) AS value FROM {EMB}")
def zscore(spark, d):
    return fixed(A.zscore(V.embeddings(spark, d), "d1").select("d0", "d1", "value"))


@query(f"WITH y AS (SELECT d0, sum(value * (1.0 / (d1 + 1))) AS y FROM {EMB} GROUP BY d0) SELECT round(avg(pow(y - label, 2)), 4) AS mse, count(*) AS n FROM y JOIN embeddings ON vec_id = d0")
def linear_score_mse(spark, d):
    x, s = emb(spark, d)
    w = G.grid(spark, (s.shape[1],)).select(F.col("d0").alias("d1"), (1.0 / (F.col("d0") + 1)).alias("w"))
    y = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("d0"), F.col("label").alias("value"))
    return fixed(A.mse(A.matvec(x, w), y), "mse")


@query("""SELECT vec_id, round(score, 5) AS score FROM (SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))) AS score
FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY score DESC, vec_id LIMIT 5""")
def cosine_topk(spark, d):
    x = V.table(spark, d, "embeddings")
    return fixed(A.cosine_top(x, x.where("vec_id = 0").select(F.col("embedding").alias("q")), 5, "vec_id", "embedding"), "score", digits=5)


@query()
def hash_embedding(spark, d):
    return A.hash_embedding(V.table(spark, d, "documents"), 128)


# Batches
@query(f"SELECT d0 // 33 AS batch, d0 % 33 AS d0, d1, {FIX} FROM {EMB}")
def batches(spark, d):
    x, s = emb(spark, d)
    return fixed(B.batches(x, s, 33))


@query(f"SELECT d0 // 33 AS batch, d0 % 33 AS d0, d1, {FIX} FROM {EMB}, (SELECT (max(vec_id) + 1) // 33 * 33 AS n FROM embeddings) WHERE d0 < n")
def batches_drop_remainder(spark, d):
    x, s = emb(spark, d)
    return fixed(B.batches(x, s, 33, True))


@query("SELECT * FROM (VALUES (500, 33, 16, 15), (500, 50, 10, 10), (7, 10, 1, 0)) t(samples, size, kept, dropped)")
def count_batches(spark, d):
    return spark.createDataFrame([(n, k, B.count_batches(n, k), B.count_batches(n, k, True)) for n, k in ((500, 33), (500, 50), (7, 10))], "samples int, size int, kept int, dropped int")


@query(f"SELECT d0 // 40 AS batch, d0 % 40 AS d0, d1, round(e.value, 4) AS value, label FROM {EMB} e JOIN embeddings ON vec_id = d0")
def paired_batches(spark, d):
    x, s = emb(spark, d)
    y = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("d0"), F.col("label").alias("value"))
    return fixed(B.paired(x, s, y, ArraySpec((s.shape[0],), (64,)), 40))


@query(f"SELECT d0 AS sample, round(sum(value), 3) AS total, count(*) AS n FROM {EMB} GROUP BY d0")
def shuffled_invariants(spark, d):
    x, s = emb(spark, d)
    return fixed(B.shuffled(x, s, 40, 7).groupBy("sample").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")), "total", digits=3)


@query()
def shuffled_batches(spark, d):
    x, s = emb(spark, d)
    return B.shuffled(x, s, 40, 7)


@query("SELECT vec_id AS sample, label, 64::BIGINT AS n FROM embeddings")
def paired_shuffled(spark, d):
    x, s = emb(spark, d)
    y = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("d0"), F.col("label").alias("value"))
    return B.paired_shuffled(x, s, y, ArraySpec((s.shape[0],), (64,)), 40, 3).groupBy("sample", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id // 50 AS batch, sum(len(embedding))::BIGINT AS n, round(sum(list_sum(embedding::DOUBLE[])), 3) AS total FROM embeddings GROUP BY ALL")
def batch_tensors(spark, d):
    x, s = emb(spark, d)
    t = B.tensors(B.batches(x, s, 50), s)
    return fixed(t.select("batch", F.size("data").cast("long").alias("n"), F.aggregate("data", F.lit(0.0), lambda a, v: a + v).alias("total")), "total", digits=3)


@query(f"SELECT d0 // 100 AS t0, d1 // 24 AS t1, round(sum(value), 3) AS total, count(*) AS n FROM {EMB} GROUP BY ALL")
def tiles(spark, d):
    x, s = emb(spark, d)
    return fixed(B.tiles(x, s, (100, 24)).groupBy("t0", "t1").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n")), "total", digits=3)


# Metadata and hierarchy
def _catalog() -> C.Catalog:
    c = C.Catalog()
    c.create_array("climate/temperature", ArraySpec((365, 180, 360), (1, 180, 360), "float32"))
    c.create_array("climate/precipitation", ArraySpec((365, 180, 360), (1, 180, 360), "float32"))
    c.create_array("climate/ocean/depth", ArraySpec((180, 360), (90, 90), "int16"))
    c.set_attr("climate", "units", "K")
    return c


@query("SELECT * FROM (VALUES ('climate', '', 'climate', 'group', 1), ('climate/ocean', 'climate', 'ocean', 'group', 2), ('climate/ocean/depth', 'climate/ocean', 'depth', 'array', 3), ('climate/precipitation', 'climate', 'precipitation', 'array', 2), ('climate/temperature', 'climate', 'temperature', 'array', 2)) t(path, parent, name, kind, depth)")
def group_tree(spark, d):
    return _catalog().dataframe(spark).select("path", "parent", "name", "kind", "depth")


@query("SELECT * FROM (VALUES ('precipitation'), ('temperature')) t(name)")
def group_children(spark, d):
    return C.children(_catalog().dataframe(spark), "climate", "array").select("name")


@query("SELECT * FROM (VALUES ('.zgroup'), ('a/.zarray'), ('g/.zgroup'), ('g/b/.zarray')) t(key)")
def consolidated(spark, d):
    store = MemoryStore("query-consolidated")
    c = C.Catalog(store)
    c.create_array("a", ArraySpec((4,), (2,)))
    c.create_array("g/b", ArraySpec((4, 4), (2, 2), "int32"))
    C.consolidate(store)
    return spark.createDataFrame([(k,) for k in C.read_consolidated(store)], "key string")


@query("""SELECT * FROM (VALUES ('bool', 1, '|b1', 'bool'), ('complex128', 16, '<c16', 'complex'), ('complex64', 8, '<c8', 'complex'), ('datetime64', 8, '<M8', 'datetime'), ('float32', 4, '<f4', 'float'), ('float64', 8, '<f8', 'float'), ('int16', 2, '<i2', 'int'), ('int32', 4, '<i4', 'int'), ('int64', 8, '<i8', 'int'), ('int8', 1, '|i1', 'int'), ('timedelta64', 8, '<m8', 'timedelta'), ('uint16', 2, '<u2', 'uint'), ('uint32', 4, '<u4', 'uint'), ('uint64', 8, '<u8', 'uint'), ('uint8', 1, '|u1', 'uint')) t(name, itemsize, v2, kind)""")
def dtype_table(spark, d):
    return spark.createDataFrame([(x.name, x.itemsize, x.v2, x.kind) for x in DTYPES.values()], "name string, itemsize int, v2 string, kind string")


@query("SELECT * FROM (VALUES ('v2', 'ok', 'zstd', 1), ('v3', 'ok', 'bytes,zstd', 1), ('back', 'ok', 'zstd', 1)) t(step, state, codec, same)")
def convert_v2_v3(spark, d):
    s = ArraySpec((20, 30), (5, 10), "int32", "zstd", 3)
    v3 = metadata.from_json(metadata.to_json(metadata.v2_to_v3(s)))
    back = metadata.v3_to_v2(v3)
    rows = [("v2", "ok", s.compressor, 1), ("v3", metadata.compatibility(v3)[0], ",".join(c["name"] for c in v3.codecs), int(v3.shape == s.shape)), ("back", "ok", back.compressor, int((back.shape, back.chunks, back.dtype) == (s.shape, s.chunks, s.dtype)))]
    return spark.createDataFrame(rows, "step string, state string, codec string, same int")


@query("SELECT event_id, epoch_us(ts) AS micros, ts FROM events")
def datetime_micros(spark, d):
    return V.table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "ts")


@query("SELECT event_id, epoch_us(ts) AS micros, epoch_us(ts) AS parsed, true AS same FROM events")
def datetime_roundtrip(spark, d):
    x = V.table(spark, d, "events").withColumn("m", U.micros(F.col("ts")))
    text = F.date_format(U.from_micros(F.col("m")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return x.select("event_id", F.col("m").alias("micros"), U.parse_time(text).alias("parsed"), (U.from_micros(F.col("m")) == F.col("ts").cast("timestamp")).alias("same"))


@query("SELECT d0, d1, d0 * 1000 + d1 AS value FROM (SELECT unnest(range(0, 30)) AS d0) CROSS JOIN (SELECT unnest(range(0, 40)) AS d1)")
def sample_matrix(spark, d):
    return U.matrix(spark, 30, 40)


@query("SELECT 1000::BIGINT AS n, 1000::BIGINT AS inside, true AS centred")
def sample_floats(spark, d):
    x = U.random_floats(spark, 1000, 3)
    return x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").between(0, 1).cast("long")).alias("inside"), F.avg("value").between(0.4, 0.6).alias("centred"))


# Codecs, run beside the data
def _packed(spark, d) -> DataFrame:
    """Each vector as bytes."""

    def run(batches_):
        for b in batches_:
            v = b.column(1)
            flat, off = v.flatten().to_numpy(), v.offsets.to_numpy() - v.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([flat[a:z].astype("<f4").tobytes() for a, z in zip(off[:-1], off[1:], strict=True)], pa.binary())], names=["vec_id", "data"])

    return V.table(spark, d, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, data binary")


@query("SELECT codec, count(*) AS n, 0::BIGINT AS mismatches FROM embeddings CROSS JOIN (VALUES ('none'), ('zlib'), ('gzip'), ('zstd'), ('lz4'), ('snappy'), ('bzip2'), ('crc32c'), ('shuffle')) c(codec) GROUP BY codec")
def codec_roundtrip(spark, d):
    names = ["none", "zlib", "gzip", "zstd", "lz4", "snappy", "bzip2", "crc32c", "shuffle"]

    def run(batches_):
        for b in batches_:
            data = [x.as_py() for x in b.column(1)]
            rows = [(n, codecs.codec(n).decode(codecs.codec(n).encode(x)) != x) for n in names for x in data]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([int(r[1]) for r in rows], pa.int64())], names=["codec", "bad"])

    return _packed(spark, d).mapInArrow(run, "codec string, bad long").groupBy("codec").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("mismatches"))


@query("SELECT 'e3069283' AS check_value, count(*) AS n, 0::BIGINT AS undetected FROM embeddings")
def crc32c_detects(spark, d):
    check = f"{codecs.crc32c(b'123456789'):08x}"

    def run(batches_):
        for b in batches_:
            bad = []
            for x in b.column(1):
                data = bytearray(codecs.codec("crc32c").encode(x.as_py()))
                data[7] ^= 1
                try:
                    codecs.codec("crc32c").decode(bytes(data))
                    bad.append(1)
                except ValueError:
                    bad.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.int64())], names=["bad"])

    return _packed(spark, d).mapInArrow(run, "bad long").agg(F.lit(check).alias("check_value"), F.count(F.lit(1)).alias("n"), F.sum("bad").alias("undetected"))


@query("SELECT vec_id // 16 AS shard, count(*) AS chunks, 0::BIGINT AS mismatches FROM embeddings GROUP BY ALL")
def shard_roundtrip(spark, d):
    def run(t: pa.Table) -> pa.Table:
        chunks = {(int(i) % 16,): x for i, x in zip(t["vec_id"].to_pylist(), t["data"].to_pylist(), strict=True)}
        bad = sum(codecs.shard_decode(codecs.shard_encode(chunks, at), at) != chunks for at in ("end", "start"))
        return pa.table({"shard": [t["shard"][0].as_py()], "chunks": pa.array([len(chunks)], pa.int64()), "mismatches": pa.array([bad], pa.int64())})

    return _packed(spark, d).withColumn("shard", G.floor_div("vec_id", 16)).groupBy("shard").applyInArrow(run, "shard long, chunks long, mismatches long")


@query("SELECT name, 0::BIGINT AS mismatches FROM (VALUES ('delta'), ('fixedscaleoffset'), ('quantize'), ('transpose')) t(name)")
def pipeline_steps(spark, d):
    steps = {"delta": {}, "fixedscaleoffset": {"scale": 0.5, "offset": 0.0, "astype": "<i4"}, "quantize": {"scale": 0.5, "offset": 0.0, "astype": "int16"}, "transpose": {"order": [1, 0]}}

    def run(batches_):
        for b in batches_:
            out = []
            for name in b.column(0).to_pylist():
                x = np.round(np.arange(24.0).reshape(4, 6) * 0.5, 1)
                p = codecs.Pipeline.parse([{"name": name, "configuration": steps[name]}, {"name": "bytes"}, {"name": "zstd"}, {"name": "crc32c"}])
                out.append(int((p.decode(p.encode(x), "<f8", x.shape) != x).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["name", "mismatches"])

    return spark.createDataFrame([(n,) for n in steps], "name string").mapInArrow(run, "name string, mismatches long")


# Stored arrays
def _stored(spark, d, **options) -> tuple[str, ArraySpec]:
    x, s = emb(spark, d)
    path = scratch.folder(spark, "array")
    s = ArraySpec(s.shape, s.chunks, "float64", **options)
    chunked.write(x, s, path)
    return path, s


@query(f"SELECT d0, d1, {FIX} FROM {EMB}")
def source_scan_v2(spark, d):
    return fixed(chunked.scan(spark, _stored(spark, d, compressor="zlib")[0]))


@query(f"SELECT d0, d1, {FIX} FROM {EMB}")
def source_scan_v3_sharded(spark, d):
    return fixed(chunked.scan(spark, _stored(spark, d, version=3, shard=(2, 2))[0]))


@query(f"SELECT d0, d1, {FIX} FROM {EMB} WHERE d0 >= 70 AND d0 < 120 AND d1 < 16")
def source_scan_pruned(spark, d):
    path, _ = _stored(spark, d)
    return fixed(chunked.scan(spark, path).where("d0 >= 70 AND d0 < 120 AND d1 < 16"))


@query("SELECT (d0 || '.' || d1) AS key, d0 AS c0, d1 AS c1 FROM (SELECT DISTINCT vec_id // 64 AS d0 FROM embeddings) CROSS JOIN (SELECT unnest(range(0, 4)) AS d1)")
def source_list_chunks(spark, d):
    return chunked.stored_chunks(spark, _stored(spark, d)[0])


@query(f"SELECT d0, d1, {FIX} FROM {EMB}")
def source_convert(spark, d):
    path, _ = _stored(spark, d, compressor="zlib")
    target = scratch.folder(spark, "converted")
    chunked.convert(spark, path, target, 3)
    return fixed(chunked.scan(spark, target))


@query(f"SELECT d0, d1, {FIX} FROM {EMB} WHERE d0 >= 70 AND d0 < 120")
def chunk_table_pruned(spark, d):
    x, s = emb(spark, d)
    path = scratch.folder(spark, "chunks")
    chunked.write_chunk_table(x, s, path)
    return fixed(chunked.read_chunk_table(spark, s, path, [(70, 120), (0, s.shape[1])]).where("d0 >= 70 AND d0 < 120").select("d0", "d1", "value"))


@query(f"SELECT d0, d1, round(CASE WHEN d0 >= 70 AND d0 < 75 AND d1 < 8 THEN -1 ELSE value END, 4) AS value FROM {EMB}")
def chunk_table_update(spark, d):
    x, s = emb(spark, d)
    path = scratch.folder(spark, "chunks")
    chunked.write_chunk_table(x, s, path)
    patch = G.grid(spark, (5, 8)).select((F.col("d0") + 70).alias("d0"), "d1", F.lit(-1.0).alias("value"))
    chunked.update_chunk_table(patch, s, path, [(70, 75), (0, 8)])
    return fixed(chunked.read_chunk_table(spark, s, path).select("d0", "d1", "value"))


@query(f"SELECT d0 // 64 AS c0, d1 // 16 AS c1, round(sum(value), 3) AS result FROM {EMB} GROUP BY ALL")
def chunk_map(spark, d):
    from .array import ChunkedArray

    x, s = emb(spark, d)
    return fixed(ChunkedArray(s, x).chunk_map(lambda index, v: v.sum()), "result", digits=3)


# Streams
def _drained(query_) -> None:
    query_.awaitTermination()


@query(f"SELECT d0, {FIX} FROM {ORD}")
def stream_append(spark, d):
    x, s = orders(spark, d)
    base = scratch.folder(spark, "stream")
    x.repartition(4).write.parquet(f"{base}/in")
    _drained(stream.append_to(stream.cell_stream(spark, f"{base}/in", s), s, f"{base}/out", f"{base}/log").trigger(availableNow=True).start())
    return fixed(spark.read.parquet(f"{base}/out").select("d0", "value"))


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_windows(spark, d):
    base = scratch.folder(spark, "stream")
    table = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(f"{base}/in")
    events = spark.readStream.schema(table.schema).parquet(f"{base}/in")
    stats = stream.windowed_stats(events, "ts", "value", "1 day", "1 hour", "event_type")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")  # a replay replaces its own

    _drained(stats.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start())
    out = spark.read.parquet(f"{base}/out").groupBy("event_type", "window").agg(F.max_by(F.struct("n", "mean"), "epoch").alias("last")).select("event_type", "window", "last.*")
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("day"), "n", F.round("mean", 6).alias("mean"))


@query(f"SELECT d0, round(CASE WHEN d0 < 50 THEN 7 ELSE value END, 4) AS value FROM {ORD}")
def stream_overlay(spark, d):
    x, s = orders(spark, d)
    base = scratch.folder(spark, "stream")
    x.write.parquet(f"{base}/state0")
    G.grid(spark, (50,)).withColumn("value", F.lit(7.0)).write.parquet(f"{base}/in")
    at = {"n": 0}

    def write(df: DataFrame) -> None:
        df.write.parquet(f"{base}/state{at['n'] + 1}")
        at["n"] += 1

    apply = stream.overlay_batches(s, lambda: spark.read.parquet(f"{base}/state{at['n']}"), write)
    _drained(stream.cell_stream(spark, f"{base}/in", s).writeStream.foreachBatch(apply).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start())
    return fixed(spark.read.parquet(f"{base}/state{at['n']}"))
