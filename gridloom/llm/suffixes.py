"""Repeated passages across documents by a sparse suffix array.

Of all suffixes (they begin at words) only those at minimisers stay: positions whose
hash of the next GRAM words is the least of SPAN neighbouring ones. Equal passages
select equal positions, and every passage of LEAST words has one. The retained
suffixes are sorted by what follows, then by what precedes read backwards; each is
compared with its neighbours from other documents, and the match is extended left and
right. Where neighbours give less than LEAST words but a longer match with another
suffix isn't ruled out, windows through that position are hashed and grouped, which is
exact: first five windows of LEAST - 9 words, one of which any match of LEAST words
contains, then all windows of LEAST words around those that documents share.

Scale: suffixes whose first words no other document has drop out in an aggregate of
(hash, id) rows; the rest travel as 3 bytes a word of context. The sort is range
partitioned on the whole context and the id, so a passage that a third of all
documents share is split over tasks like anything else; no group is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import discard, materialise, ship

#: A match of LEAST words has a whole window of SPAN hashes over GRAM words each: SPAN + GRAM - 1 <= LEAST.
LEAST, GRAM, SPAN = 50, 8, 40
#: Words of context after and before a position; a match's first minimiser has fewer than SPAN words before it.
AFTER, BEFORE = LEAST, SPAN
CHUNK_ROWS = 200_000
#: Words between the first windows, which are COARSE - 1 shorter than a match.
COARSE = 10

_FOUND = "key long, doc long, pos long, l long, r long, partner long, open boolean, after binary, before binary"


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each run of ``width`` values, in linear time by blocks."""
    op = np.minimum if least else np.maximum
    n = len(x)
    pad = -n % width
    fill = x.dtype.type(np.iinfo(x.dtype).max if least else 0)
    y = np.concatenate((x, np.full(pad, fill, dtype=x.dtype))).reshape(-1, width)
    left = op.accumulate(y, axis=1).ravel()
    right = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - width + 1], left[width - 1 : n])


def minimisers(h: np.ndarray) -> np.ndarray:
    """Selected word positions of one document; ties select all."""
    g = K.grams(h, GRAM)
    if len(g) < SPAN:
        return np.zeros(0, dtype=np.int64)
    low = _sliding(g, SPAN, True)
    edge = np.zeros(SPAN - 1, dtype=np.uint64)
    best = _sliding(np.concatenate((edge, low, edge)), SPAN, False)
    return np.flatnonzero(best == g)


def _sampled(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> (key, doc, pos): the retained positions and the hash of their first words."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, _, data, offsets in K.text_slices(batch.column(1)):
                starts, ends, first = K.words(data, offsets, K.ALNUM)
                h = K.hashes(data, starts, ends)
                key, doc, pos = [], [], []
                for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b - a >= LEAST:
                        p = minimisers(h[a:b])
                        key.append(K.grams(h[a:b], GRAM)[p])
                        pos.append(p)
                        doc.append(np.full(len(p), ids[i + d]))
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(doc)), pa.array(np.concatenate(pos))], names=["key", "doc", "pos"])

    return docs.mapInArrow(run, "key long, doc long, pos long")


def _contexts(wanted: DataFrame) -> DataFrame:
    """wanted (id, text, at: array of struct(pos, key)) -> (key, doc, pos, after, before), both contexts in 3 bytes a word, zeros beyond the text."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = batch.column(2)
            bounds = at.offsets.to_numpy()
            pos, key = (at.values.field(c).to_numpy() for c in ("pos", "key"))
            for i, _, data, offsets in K.text_slices(batch.column(1)):
                starts, ends, first = K.words(data, offsets, K.ALNUM)
                h = K.hashes(data, starts, ends)
                for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    own = slice(bounds[i + d], bounds[i + d + 1])
                    p = pos[own].astype(np.int64)
                    # Rows that repeat an id with another text have positions that aren't in this one.
                    ok = p < b - a
                    if not ok.any():
                        continue
                    p, k = p[ok], key[own][ok]
                    code = np.zeros(BEFORE + (b - a) + AFTER, dtype="<u4")
                    code[BEFORE : BEFORE + b - a] = (h[a:b] >> np.uint64(40)).astype(np.uint32) | 1
                    three = code.view(np.uint8).reshape(-1, 4)[:, :3]
                    after = three[(BEFORE + p)[:, None] + np.arange(AFTER)].reshape(len(p), -1)
                    before = three[(BEFORE + p - 1)[:, None] - np.arange(BEFORE)].reshape(len(p), -1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(k), pa.array(np.full(len(p), ids[i + d])), pa.array(p), pa.array([x.tobytes() for x in after], pa.binary()), pa.array([x.tobytes() for x in before], pa.binary())],
                        names=["key", "doc", "pos", "after", "before"],
                    )

    return wanted.mapInArrow(run, "key long, doc long, pos long, after binary, before binary")


def _matrix(column: pa.Array, words: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, words, 3)
    out = np.zeros((len(raw), words, 4), dtype=np.uint8)
    out[:, :, :3] = raw
    return out.view("<u4").reshape(-1, words)


def _common(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Words that rows i and j of x have in common at their beginning."""
    same = (x[i] == x[j]) & (x[i] != 0)
    got = same.argmin(axis=1)
    got[same.all(axis=1)] = x.shape[1]
    return got


def _compared(ordered: DataFrame) -> DataFrame:
    """Sorted suffixes -> (key, doc, pos, l, r, partner, open): the matches of LEAST words or more with the nearest neighbours from other documents, else 0; open: a match of LEAST words isn't ruled out."""

    def chunk(batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        key, doc, pos = (table[c].to_numpy() for c in ("key", "doc", "pos"))
        after, before = _matrix(table["after"], AFTER), _matrix(table["before"], BEFORE)
        n = len(doc)
        change = np.flatnonzero(doc[1:] != doc[:-1]) + 1
        run = np.searchsorted(change, np.arange(n), "right")
        edges = np.concatenate(([0], change, [n]))
        l, r, partner, reach = (np.zeros(n, dtype=np.int64) for _ in range(4))
        for other in (edges[run] - 1, edges[run + 1]):
            there = np.flatnonzero((other >= 0) & (other < n))
            far = other[there]
            right, left = _common(after, there, far), _common(before, there, far)
            reach[there] = np.maximum(reach[there], right)
            # Both matches run through the suffix's own position, so their union is one span.
            enough = right + left >= LEAST
            at = there[enough]
            l[at], r[at], partner[at] = np.maximum(l[at], left[enough]), np.maximum(r[at], right[enough]), doc[far[enough]]
            # At the ends of a chunk a neighbour is unknown.
            beyond = np.setdiff1d(np.arange(n), there)
            reach[beyond] = AFTER
        unsettled = (l + r < LEAST) & (reach >= LEAST - BEFORE)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(pos), pa.array(l), pa.array(r), pa.array(partner), pa.array(unsettled), table["after"].combine_chunks(), table["before"].combine_chunks()], names=["key", "doc", "pos", "l", "r", "partner", "open", "after", "before"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                yield chunk(held)
                held, rows = [], 0
        if rows:
            yield chunk(held)

    return ordered.mapInArrow(run, _FOUND)


def _windows(entries: DataFrame, fine: bool) -> DataFrame:
    """(doc, pos, open, back, w, wide): hashes of windows that begin ``back`` words before a suffix, and of the words that any fine window around one can hold.

    Coarse: LEAST - COARSE + 1 words from every COARSE-th place. Fine: LEAST words from the COARSE places that begin at the row's ``back``.
    """
    size = LEAST if fine else LEAST - COARSE + 1

    def run(batches):
        for batch in batches:
            after, before = _matrix(batch.column("after"), AFTER), _matrix(batch.column("before"), BEFORE)
            line = np.concatenate((before[:, ::-1], after), axis=1).astype(np.uint64)
            doc, pos, unsettled = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "pos", "open"))
            hashed = np.where(line == 0, 0, K.mix(line))
            n, width = line.shape
            total = np.zeros((n, width + 1), dtype=np.uint64)
            np.cumsum(hashed * K._power("base", K._BASE, width)[:width], axis=1, out=total[:, 1:])
            beyond = np.concatenate((np.zeros((n, 1), dtype=np.int64), np.cumsum(line == 0, axis=1)), axis=1)
            at = np.arange(n)
            for step in range(COARSE) if fine else range(0, BEFORE + 1, COARSE):
                back = batch.column("back").to_numpy() + step if fine else np.full(n, step)
                s = BEFORE - back
                ok = s >= 0
                e = np.maximum(s, 0)
                ok &= (beyond[at, e + size] == beyond[at, e]) & (e + size <= width)
                w = K.mix((total[at, e + size] - total[at, e]) * K._power("inverse", K._INV, width)[e])[ok]
                a, z = np.maximum(e - COARSE + 1, 0), np.minimum(e + size + COARSE - 1, width)
                wide = K.mix((total[at, z] - total[at, a]) * K._power("inverse", K._INV, width)[a] + a.astype(np.uint64))[ok]
                yield pa.RecordBatch.from_arrays([pa.array(doc[ok]), pa.array(pos[ok]), pa.array(unsettled[ok], pa.bool_()), pa.array(back[ok].astype(np.int64)), pa.array(w.view(np.int64)), pa.array(wide.view(np.int64))], names=["doc", "pos", "open", "back", "w", "wide"])

    columns = ["doc", "pos", "open", "after", "before"] + ["back"] * fine
    return entries.select(*columns).mapInArrow(run, "doc long, pos long, open boolean, back long, w long, wide long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with a passage of LEAST words or more that another document has: id_col, n_spans, n_words, spans (half-open word ranges, words counted from 0), partners (ids).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
    Repeats inside one document and rows that repeat an id don't count; null ids and
    null or shorter texts take no part. A document is here if and only if it has
    such a passage. Spans are the union of the matches with sorted neighbours, to their
    exact ends; where a third document shares some words more on one side of a minimiser
    than those neighbours do, these may be left out. partners has the documents that the
    matches were confirmed with, at least one for each span.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    all_ = materialise(_sampled(src), "sampled")
    shared = all_.groupBy("key").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1").select("key")
    # One document's positions: bounded by its own length.
    at = all_.join(shared, "key", "left_semi").groupBy("doc").agg(F.collect_set(F.struct("pos", "key")).alias("at"))
    entries = materialise(_contexts(src.join(at, src.id == at.doc).select("id", "text", "at")), "suffixes")
    discard(all_)
    found = materialise(_compared(entries.orderBy("after", "before", "doc", "pos")), "compared")
    discard(entries)

    coarse = _windows(found, False)
    near = coarse.groupBy("w").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.max("open").alias("any")).where("d0 < d1 and any").select("w")
    # Only unsettled suffixes want an answer. Of the others, those with equal words all around give equal windows: two documents stand for them.
    shared_windows = coarse.join(near, "w", "left_semi")
    settled = shared_windows.where("not open").groupBy("w", "wide", "back").agg(F.min(F.struct("doc", "pos")).alias("x"), F.max(F.struct("doc", "pos")).alias("y"))
    settled = settled.select("back", F.explode(F.array("x", "y")).alias("e")).select("e.doc", "e.pos", "back")
    around = shared_windows.where("open").select("doc", "pos", "back").union(settled).distinct()
    windows = materialise(_windows(found.join(around, ["doc", "pos"]), True), "windows")
    twice = windows.groupBy("w").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1")
    exact = windows.where("open").join(twice, "w").select("doc", (F.col("pos") - F.col("back")).alias("start"), (F.col("pos") - F.col("back") + LEAST).alias("end"), F.when(F.col("doc") == F.col("d0"), F.col("d1")).otherwise(F.col("d0")).alias("partner"))
    spans = found.where(f"l + r >= {LEAST}").select("doc", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("end"), "partner").union(exact)
    grouped = spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("parts"), F.array_sort(F.collect_set("partner")).alias("partners"))
    kind = "array<struct<start:long,end:long>>"
    merged = F.aggregate(
        "parts",
        F.expr(f"cast(array() as {kind})"),
        lambda done, p: F.when(
            (F.size(done) > 0) & (p.start <= F.element_at(done, -1).end),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1).start.alias("start"), F.greatest(F.element_at(done, -1).end, p.end).alias("end")))),
        ).otherwise(F.concat(done, F.array(p))),
    )
    return grouped.withColumn("spans", merged).select(
        F.col("doc").alias(id_col),
        F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda t, p: t + p.end - p.start).alias("n_words"),
        "spans",
        "partners",
    )
