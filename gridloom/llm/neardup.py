"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of minhashes are computed for each text, ``units`` units of
``rows`` hashes each. A table's key combines one unit of the first collection with
one of the second, so ``units**2`` tables cost only ``2 * units * rows`` minhashes.
Two texts meet in some table as soon as one unit of either collection agrees.

Scale: equal sets collapse to their smallest id before banding, through an
aggregate, so a group of exact copies of any size is one row from then on. In a
bucket all members are compared with its smallest id (a star); only members that
this leaves in different components are compared with each other, in large buckets
by an exact prefix filter instead of all pairs. Candidates are confirmed on the full shingle sets; nothing is capped or sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import bucket_links, connected_components
from .store import discard, materialise, ship

#: 64-bit words of the parity sketch that rules candidates out without their texts.
SKETCH = 16


def units_for(percent: int, rows: int, miss: float = 1e-4) -> int:
    """The least number of units with which a pair at the threshold is missed with a chance of at most ``miss``."""
    p, units = (percent / 100) ** rows, 1
    while 1 - (1 - (1 - p) ** units) ** 2 > miss:
        units += 1
    return units


def features(docs: DataFrame, shingle: int, units: int, rows: int, seed: int) -> DataFrame:
    """docs (id, text) -> id, n (set size), two fingerprints of the set, units of both collections, parity sketch."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in K.text_slices(batch.column(1)):
                sets = K.shingle_lists(data, offsets, shingle)
                full = [k for k, s in enumerate(sets) if len(s)]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                f1, f2 = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
                sketch = np.zeros((len(full), SKETCH), dtype=np.int64)
                for at, k in enumerate(full):
                    m = K.mix(sets[k])
                    f1[k] = m.sum(dtype=np.uint64)
                    f2[k] = np.bitwise_xor.reduce(m * np.uint64(0xA24BAED4963EE407))
                    sketch[at] = K.parity_sketch(sets[k], SKETCH)
                h = K.minhashes([sets[k] for k in full], 2 * units * rows, seed).reshape(len(full), 2, units, rows)
                unit = np.zeros((len(full), 2, units), dtype=np.uint64)
                for r in range(rows):
                    unit = K.mix(unit * np.uint64(0x9FB21C651E98DF25) + h[..., r])
                has = (n > 0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), K.list_column(unit[:, 0].ravel(), has * units), K.list_column(unit[:, 1].ravel(), has * units), K.list_column(sketch.ravel(), has * SKETCH)],
                    names=["id", "n", "f1", "f2", "a", "b", "sketch"],
                )

    return docs.mapInArrow(run, "id long, n long, f1 long, f2 long, a array<long>, b array<long>, sketch array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """texts (id, text) -> id, grams (the distinct shingles' hashes)."""

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in K.text_slices(batch.column(1)):
                sets = K.shingle_lists(data, offsets, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), K.list_column(np.concatenate(sets), [len(x) for x in sets])], names=["id", "grams"])

    return texts.select("id", "text").mapInArrow(run, "id long, grams array<long>")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sides = []
            for col in (2, 3):
                sides.append([s for _, _, data, offsets in K.text_slices(batch.column(col)) for s in K.shingle_lists(data, offsets, shingle)])
            keep = []
            for x, y in zip(*sides, strict=True):
                both = np.concatenate((x, y))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                union = len(both) - inter
                keep.append(union > 0 and 100 * inter >= percent * union)
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(a, keep, strict=True) if k], pa.int64()), pa.array([v for v, k in zip(b, keep, strict=True) if k], pa.int64())], names=["a", "b"])

    t1 = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    t2 = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    return pairs.join(t1, "b").join(t2, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _possible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs that set sizes and parity sketches don't rule out: sketches differ in no more bits than the sets do in members, so no link is lost."""
    side = lambda s: reps.select(F.col("id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0).cast("int"), lambda t, v: t + v)
    return (
        pairs.join(side("b"), "b")
        .join(side("a"), "a")
        .where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        .where(differ * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb")))
        .select("a", "b")
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85, rows: int = 2, units: int | None = None, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id, kept.

    Texts link where ``100 * intersection >= percent * union`` over their distinct
    ``shingle``-word shingles (white-space words, A-Z lower-cased). Null and wordless
    texts have an empty set, link with nothing and are their own component. Rows that
    repeat an id are one node with all their texts. A row with a null id links with
    nothing: component_id is null and kept true. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    units = units or units_for(percent, rows)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    feats = materialise(features(src, shingle, units, rows, seed), "features")
    named = feats.where("id is not null and n > 0")
    classes = named.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"))
    member = named.select("id", "n", "f1", "f2").join(classes, ["f1", "f2", "n"]).select("id", "rep").distinct()
    reps = materialise(named.join(classes.select("f1", "f2", F.col("rep").alias("id")), ["f1", "f2", "id"], "left_semi").select("id", "n", "a", "b", "sketch"), "reps")

    # A representative makes units**2 keys: spread over enough tasks that each sorts and aggregates few of them.
    spread = reps.select("id", "a", "b").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    keys = (
        spread.select("id", "b", F.posexplode("a").alias("i", "x"))
        .select("id", "i", "x", F.posexplode("b").alias("j", "y"))
        .select(F.xxhash64(F.col("i") * units + F.col("j"), "x", "y").alias("key"), "id")
    )
    texts: list[DataFrame] = []

    def prepare(members: DataFrame) -> DataFrame:
        texts.append(materialise(src.join(members.select("id").distinct(), "id", "left_semi"), "texts"))
        return reps.select("id", "n")

    def grams(ids: DataFrame) -> DataFrame:
        return _sets(texts[0].join(ids, "id", "left_semi"), shingle)

    def confirm(pairs: DataFrame) -> DataFrame:
        return _confirmed(_possible(pairs, reps, percent), texts[0], shingle, percent)

    links = bucket_links(keys, percent, prepare, grams, confirm)
    discard(texts[0])

    # Ids that repeat with different texts join the classes of all of them.
    same = member.where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    odd = same.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("hi")).where("b < hi")
    extra = same.join(odd.select("a"), "a", "left_semi")
    comps = materialise(connected_components(links.union(extra)), "components")
    ids = member.groupBy("id").agg(F.min("rep").alias("rep"))
    of = ids.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("component"))
    out = feats.select("id", "n").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))
