"""Substring deduplication by MinHash banding of paragraphs.

Two kinds of units are cut from a text. A paragraph is a line; equal lines of any
length are found by the hash of all words, and those with a shingle are banded (``rows`` minhashes a band, ``bands`` bands, tuned for recall over
precision), members of a band's bucket are joined, and the exact Jaccard similarity
of their word shingles decides. A block is a stretch between content-defined cuts,
wherever it stands in its line, so that a passage pasted into the middle of another
paragraph is found too; blocks are so short that one changed word already falls
under the threshold, hence one key, the hash of all words, is the whole banding.

Removals are clustered: similar paragraphs by connected components, blocks by equal
hash. The copy in the document with the smallest id stays, all others go.

Scale: units shuffle as (hash, id) rows; equal units collapse in an aggregate before
any join. Only paragraphs whose bucket is shared fetch their text. Buckets that many
dissimilar paragraphs share go through an exact prefix filter, not all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import bucket_links, connected_components
from .decontam import cut_spans
from .store import discard, materialise, ship

#: Cuts stand at minima of word-pair hashes within so many words on both sides: blocks have RADIUS + 1 words at least.
RADIUS = 5
LEAST_BLOCK, LEAST_RUN = 5, 15
SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 6, 2

_UNIT = "paragraph boolean, doc long, row long, start long, end long, a long, b long, n long, fp long, keys array<long>"


def cuts(h: np.ndarray, first: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Whether a block begins at each word: at a document's first word, and at minima of the hash of the word and its next."""
    n = len(h)
    out = np.zeros(n, dtype=bool)
    if n > 2 * radius + 2:
        g = K.grams(h, 2)
        m = len(g)
        low = np.ones(m, dtype=bool)
        low[:radius] = low[m - radius :] = False
        for s in range(1, radius + 1):
            low[s:] &= g[s:] < g[:-s]
            low[:-s] &= g[:-s] <= g[s:]
        out[:m] = low
    # No cut may depend on a neighbouring document.
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out[a : min(b, a + radius)] = False
        out[max(a, b - radius - 1) : b] = False
        if a < b:
            out[a] = True
    return out


def units(docs: DataFrame, bands: int, rows: int, shingle: int, seed: int = 11) -> DataFrame:
    """docs (id, text, row) -> one row per block and per line: byte range, word range, hash, band keys (lines with a shingle only)."""

    def run(batches):
        for batch in batches:
            ids, rows_ = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 2))
            for i, _, data, offsets in K.text_slices(batch.column(1)):
                starts, ends, first = K.words(data, offsets, K.ALNUM)
                if not len(starts):
                    continue
                h = K.hashes(data, starts, ends)
                prefix = np.empty(len(h) + 1, dtype=np.uint64)
                prefix[0] = 0
                np.cumsum(h * K._power("base", K._BASE, len(h))[: len(h)], out=prefix[1:])
                of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
                base, word0 = offsets[of], first[of]

                def emit(paragraph, a, b, keys, counts, data=data, starts=starts, ends=ends, prefix=prefix, of=of, base=base, word0=word0, first=first, offsets=offsets, i=i):
                    fp = K.mix((prefix[b] - prefix[a]) * K._power("inverse", K._INV, len(starts) + 1)[a] + (b - a).astype(np.uint64) + np.uint64(paragraph))
                    d = of[a]
                    last = b == first[d + 1]
                    stop = np.where(last, offsets[d + 1], starts[np.minimum(b, len(starts) - 1)])
                    return pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(a), paragraph)), pa.array(ids[i + d]), pa.array(rows_[i + d]), pa.array(np.where(a == word0[a], 0, starts[a] - base[a])), pa.array(stop - base[a]), pa.array(a - word0[a]), pa.array(b - word0[a]), pa.array(b - a), pa.array(fp.view(np.int64)), K.list_column(keys, counts)],
                        names=["paragraph", "doc", "row", "start", "end", "a", "b", "n", "fp", "keys"],
                    )

                a = np.flatnonzero(cuts(h, first))
                b = np.append(a[1:], len(h))
                keep = b - a >= LEAST_BLOCK
                a, b = a[keep], b[keep]
                yield emit(False, a, b, np.zeros(0, dtype=np.uint64), np.zeros(len(a), dtype=np.int64))

                breaks = np.flatnonzero(data == 10)
                line = np.searchsorted(breaks, starts)
                new = np.ones(len(h), dtype=bool)
                new[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(h))
                banded = b - a >= shingle
                x, y = a[banded], b[banded]
                key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(x), bands))
                if len(x):
                    g = K.grams(h, shingle)
                    mh = K.minhashes([g[u : v - shingle + 1] for u, v in zip(x.tolist(), y.tolist(), strict=True)], bands * rows, seed).reshape(len(x), bands, rows)
                    for r in range(rows):
                        key = K.mix(key * np.uint64(0x9FB21C651E98DF25) + mh[..., r])
                yield emit(True, a, b, key.ravel(), np.where(banded, bands, 0))

    return docs.where("id is not null").mapInArrow(run, _UNIT)


def _paragraph_sets(texts: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """wanted (fp, doc, row, start, end) joined with texts (id, text, row) -> id (fp), grams (distinct shingle hashes)."""

    def run(batches):
        for batch in batches:
            fp, s, e = (batch.column(c).to_pylist() for c in range(3))
            raw = [(t.as_py() or "").encode("utf-8", "surrogatepass")[x:y] for t, x, y in zip(batch.column(3), s, e, strict=True)]
            sets = [x for _, _, data, offsets in K.text_slices(pa.array(raw, pa.binary())) for x in K.shingle_lists(data, offsets, shingle, K.ALNUM)]
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), K.list_column(flat, [len(x) for x in sets])], names=["id", "grams"])

    # Rows that repeat an id and a text give equal sets.
    found = wanted.join(texts, (wanted.doc == texts.id) & (wanted.row == texts.row)).select("fp", "start", "end", "text")
    return found.mapInArrow(run, "id long, grams array<long>").dropDuplicates(["id"])


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document that loses text: id_col, text_hash, n_spans, n_bytes, spans (UTF-8 byte ranges to cut), kept_in (ids of documents that keep a copy).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
    A span is a run of repeated blocks of LEAST_RUN words or more, or an equal or
    similar line of any length with the blocks that touch it. Repeats inside one
    document, or only among rows that have one id, are left alone. A document is a
    distinct id and text: rows that repeat an id with another text are cut each by its
    own spans (text_hash is xxhash64 of the text), rows that repeat both share one row
    here. Null ids, null texts and texts without words take no part.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("text"))
    cut = materialise(units(src, bands, rows, shingle), "units")
    classes = cut.groupBy("fp").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1"))
    repeated = classes.where("d0 < d1").select("fp", F.col("d0").alias("kept"))
    exact = cut.select("fp", "doc", "row", "start", "end", "a", "b", "paragraph").join(repeated, "fp").where("doc > kept").select("doc", "row", "start", "end", "a", "b", "kept", F.col("paragraph").alias("near"))

    lines = cut.where("paragraph and size(keys) > 0").select("fp", "doc", "row", "start", "end", "keys")
    first = lines.groupBy("fp").agg(F.min(F.struct("doc", "row", "start", "end")).alias("at"), F.min("doc").alias("d0"))
    keys = lines.select("fp", F.explode("keys").alias("key")).select("key", F.col("fp").alias("id"))
    sets: list[DataFrame] = []

    def prepare(members: DataFrame) -> DataFrame:
        wanted = first.join(members.select(F.col("id").alias("fp")).distinct(), "fp", "left_semi").select("fp", "at.doc", "at.row", "at.start", "at.end")
        sets.append(materialise(_paragraph_sets(src.where("id is not null"), wanted, shingle), "sets"))
        return sets[0].select("id", F.size("grams").cast("long").alias("n"))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(sets[0].select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b").join(sets[0].select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a")
        both = both.where(100 * F.least(F.size("ga"), F.size("gb")) >= percent * F.greatest(F.size("ga"), F.size("gb")))
        inter = F.size(F.array_intersect("ga", "gb"))
        return both.where(100 * inter >= percent * (F.size("ga") + F.size("gb") - inter)).select("a", "b")

    links = bucket_links(keys.distinct(), percent, prepare, lambda ids: sets[0].join(ids, "id", "left_semi"), confirm)
    comps = materialise(connected_components(links), "components")
    homes = comps.join(first.select(F.col("fp").alias("node"), "d0"), "node").groupBy("comp").agg(F.min("d0").alias("kept"))
    near = comps.join(homes, "comp").select(F.col("node").alias("fp"), "kept")
    similar = lines.join(near, "fp").where("doc > kept").select("doc", "row", "start", "end", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"), "kept")
    discard(sets[0])

    # One row per document from here: spans in order, touching ones made one, short ones dropped.
    found = exact.union(similar.withColumn("near", F.lit(True)))
    grouped = found.groupBy("doc", "row").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce(F.col("b") - F.col("a"), F.lit(0).cast("long")).alias("n"), "near"))).alias("parts"),
        F.array_sort(F.collect_set("kept")).alias("kept_in"),
    )
    kind = "array<struct<start:long,end:long,n:long,near:boolean>>"
    joined = F.aggregate(
        "parts",
        F.expr(f"cast(array() as {kind})"),
        lambda done, p: F.when(
            (F.size(done) > 0) & (p.start <= F.element_at(done, -1).end),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(
                    F.struct(
                        F.element_at(done, -1).start.alias("start"),
                        F.greatest(F.element_at(done, -1).end, p.end).alias("end"),
                        # Blocks within a repeated line count once: only what lies beyond the last end adds words.
                        F.when(p.end > F.element_at(done, -1).end, F.element_at(done, -1).n + p.n).otherwise(F.greatest(F.element_at(done, -1).n, p.n)).alias("n"),
                        (F.element_at(done, -1).near | p.near).alias("near"),
                    )
                ),
            ),
        ).otherwise(F.concat(done, F.array(p))),
    )
    spans = F.filter(joined, lambda p: p.near | (p.n >= LEAST_RUN))
    return (
        grouped.withColumn("parts", spans)
        .where("size(parts) > 0")
        .select(
            F.col("doc").alias(id_col),
            F.col("row").alias("text_hash"),
            F.size("parts").cast("long").alias("n_spans"),
            F.aggregate("parts", F.lit(0).cast("long"), lambda t, p: t + p.end - p.start).alias("n_bytes"),
            F.transform("parts", lambda p: F.struct(p.start.alias("start"), p.end.alias("end"))).alias("spans"),
            "kept_in",
        )
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of ``text`` (n_chars follows); every row stays. Needs doc_id and text.

    Spans belong to an id and a text, so a row is never cut by another text's offsets.
    """
    gone = removals(docs).select(F.col("doc_id").alias("_gl_id"), F.col("text_hash").alias("_gl_hash"), F.col("spans").alias("_gl_spans"))
    own = (docs["doc_id"] == F.col("_gl_id")) & (F.xxhash64(docs["text"]) == F.col("_gl_hash"))
    return cut_spans(docs.join(gone, own, "left"), docs.columns)
