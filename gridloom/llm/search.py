"""Exact BM25 top-k search: sharded inverted index with block-max pruning.

Documents are spread over shards of about SHARD_BYTES of text. A shard's index is some
rows of a table (term hashes, postings, lengths), one for each piece: documents that
look alike, such as those of one language, in blocks of BLOCK. For a group of queries,
the postings of a piece's rarer terms are added up, and the block maxima of its
frequent terms bound what a block can still reach. Blocks are visited from the highest
bounds down, for those queries only whose k-th score so far the bound reaches: a
product of matrices in single precision, with room for its rounding, names the
candidates, which are then scored in double precision. Blocks that can't matter to a
query are never scored for it, and nothing else is left out. One shard in OPENING is
searched first; each query's threshold in all others starts from its k-th score there,
and rises within a task.

Scores use global statistics (number of documents, mean length, document
frequencies), so the shards' top-k merge exactly.

Scale: one shuffle of the texts; the index is read twice per block of QUERIES queries,
which is all that is broadcast. A task returns k rows a query at most, whatever the
number of its shards. Document frequencies are an aggregate over shard vocabularies
joined to query terms. Every query meets every document, so the work is quadratic.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .store import materialise, ship

K1, B = 1.2, 0.75
TOP = 10
SHARD_BYTES, BLOCK = 16 << 20, 256
#: Queries, and terms of all of them, that are sent to the shards together; one shard in OPENING is searched first, for the others' thresholds.
QUERIES, ENTRIES, OPENING = 8192, 4 << 20, 16
#: Scores that a piece holds for a group of queries, the most queries of a group, the blocks after which their thresholds rise, and pairs and postings that are scored at once.
CELLS, GROUP, REFRESH, CANDIDATES, POSTINGS = 1 << 20, 512, 4, 1024, 1 << 15
#: Terms of a piece that are held as dense columns: at most so many, so many cells in all, each term in such a share of the documents.
DENSE, DENSE_CELLS, SHARE = 1024, 1 << 23, 0.05
#: Words that tell what documents look alike, most pieces of a shard, and the similarity from which two are one.
FEATURES, PIECES, ALIKE = 64, 8, 0.8
#: Scores that differ by less are ties, which the smaller id wins.
DIGITS = 6


def kinds(x: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """A number below PIECES for each row of x (documents by frequent words), the same for rows that look alike. Speed depends on it, results don't."""
    out = np.zeros(len(x), dtype=np.int64)
    if not len(x):
        return out
    _, of, count = np.unique(lead, return_inverse=True, return_counts=True)
    first = np.argsort(-count, kind="stable")[: 2 * PIECES]
    rows = [np.flatnonzero(of == i) for i in first]
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)  # FEATURES floats a document
    for _ in range(4):
        rows = [r for r in rows if len(r)]
        centre = np.stack([unit[r].sum(axis=0) for r in rows])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        label = np.argmax(unit @ centre.T, axis=1)
        rows = [np.flatnonzero(label == i) for i in range(len(rows))]
    rows = [r for r in rows if len(r)]
    while len(rows) > 1:
        centre = np.stack([unit[r].sum(axis=0) for r in rows])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        near = centre @ centre.T
        np.fill_diagonal(near, -1)
        least = int(np.argmin([len(r) for r in rows]))
        i, j = np.unravel_index(int(np.argmax(near)), near.shape)
        if near[i, j] < ALIKE:
            if len(rows) <= PIECES and len(rows[least]) * 2 * PIECES >= len(x):
                break
            i, j = least, int(np.argmax(near[least]))
        i, j = min(i, j), max(i, j)
        rows[i] = np.concatenate((rows[i], rows.pop(j)))
    for i, r in enumerate(rows):
        out[r] = i
    return out


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _numbers(data, n: int) -> np.ndarray:
    """The n numbers in a result of _small."""
    return np.frombuffer(data, dtype=f"u{len(memoryview(data).cast('B')) // max(1, n) or 1}")


def build(docs: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray) -> list[dict[str, bytes]]:
    """The index of one shard from slices (bytes, offsets) of its texts, in order of ids: a row for each piece, documents that look alike."""
    hashes, lengths = [], []
    for data, offsets in docs:
        starts, ends, first = K.words(data, offsets, K.ALNUM)
        hashes.append(K.hashes(data, starts, ends))
        lengths.append(np.diff(first))
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    length = np.concatenate(lengths).astype(np.int64) if lengths else np.zeros(0, dtype=np.int64)
    doc = np.repeat(np.arange(len(length), dtype=np.uint32), length)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    del order, hashes
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h))).astype(np.uint32)
    h, doc = h[at], doc[at]
    # Documents with the same most frequent word, and of similar length, share blocks.
    best = np.lexsort((h, -tf.astype(np.int64), doc))
    lead = np.zeros(len(length), dtype=np.uint64)
    heads = best[np.flatnonzero(np.diff(doc[best], prepend=-1))] if len(best) else best
    lead[doc[heads]] = h[heads]
    begins = np.append(np.flatnonzero(np.diff(h, prepend=h[:1] ^ np.uint64(1)) != 0), len(h))
    df = np.diff(begins)
    x = np.zeros((len(length), FEATURES), dtype=np.float32)
    for i, t in enumerate(np.argsort(-df, kind="stable")[:FEATURES].tolist()):
        x[doc[begins[t] : begins[t + 1]], i] = 1
    kind = kinds(x, lead)
    del x, best
    out = []
    for piece in range(int(kind.max(initial=0)) + 1):
        own = np.flatnonzero(kind == piece)
        layout = own[np.lexsort((ids[own], length[own], lead[own]))]
        place = np.full(len(length), -1, dtype=np.int64)
        place[layout] = np.arange(len(layout))
        here = np.flatnonzero(place[doc] >= 0)
        here = here[np.lexsort((place[doc[here]], h[here]))]
        term = h[here]
        first = np.flatnonzero(np.diff(term, prepend=term[:1] ^ np.uint64(1)) != 0)
        out.append({"terms": term[first].tobytes(), "begins": _small(np.append(first, len(term))), "docs": _small(place[doc[here]]), "tf": _small(tf[here]), "ids": ids[layout].astype(np.int64).tobytes(), "lengths": length[layout].tobytes()})
    return out


def best_of(q: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, in order; score is rounded, so that ties go to the smaller id."""
    order = np.lexsort((doc, -score, q))
    q = q[order]
    top = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[top], doc[order[top]], score[order[top]]


def _spans(begins: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places from begins[i] to begins[i + 1] for each i in which, one after the other, and how many each has."""
    a = begins[which]
    size = begins[which + 1] - a
    stop = np.cumsum(size)
    where = np.repeat(a - (stop - size), size)
    where += np.arange(len(where))
    return where, size


class Shard:
    """A piece of a shard's index, ready to search with a block of queries: gains by posting, a dense matrix of frequent terms and its block maxima."""

    def __init__(self, row: dict[str, bytes], mean: float, block: Block):
        terms, self.ids = np.frombuffer(row["terms"], dtype=np.uint64), np.frombuffer(row["ids"], dtype=np.int64)
        begins = _numbers(row["begins"], len(terms) + 1).astype(np.int64)
        docs, counts = _numbers(row["docs"], begins[-1]), _numbers(row["tf"], begins[-1])
        length = np.frombuffer(row["lengths"], dtype=np.int64)
        self.block, self.n = block, len(self.ids)
        self.blocks = -(-self.n // BLOCK)
        # Only terms that some query has.
        place = np.minimum(np.searchsorted(block.terms, terms), max(0, len(block.terms) - 1))
        own = np.flatnonzero(block.terms[place] == terms) if len(block.terms) else place[:0]
        self.at = np.full(len(block.terms), -1, dtype=np.int32)
        self.at[place[own]] = np.arange(len(own))
        held, df = _spans(begins, own)
        self.begins = np.concatenate(([0], np.cumsum(df)))
        self.docs = docs[held].astype(np.int64)
        tf = counts[held].astype(np.float64)
        norm = (K1 * (1 - B + B * length / max(mean, 1e-9)))[self.docs]
        norm += tf
        self.gain = tf * (K1 + 1) / norm
        self.gain *= np.repeat(block.weights[place[own]], df)
        common = np.sort(np.argsort(-df, kind="stable")[: min(DENSE, DENSE_CELLS // max(1, self.blocks * BLOCK))])
        common = common[df[common] >= SHARE * self.n]
        self.column = np.full(len(own), -1, dtype=np.int64)
        self.column[common] = np.arange(len(common))
        # Postings of dense terms by document: double precision scores the candidates that single precision finds.
        where, size = _spans(self.begins, common)
        doc, column = self.docs[where], np.repeat(np.arange(len(common)), size)
        order = np.argsort(doc.astype(np.uint16) if self.n < 1 << 16 else doc, kind="stable")
        self.own_columns, self.own_gain = column[order], self.gain[where[order]]
        self.own_begins = np.searchsorted(doc[order], np.arange(self.n + 1))
        # All summands are positive: a sum's relative error is below the number of roundings times their size.
        self.error = (len(common) + 8) * 2.0**-23
        self.dense = np.zeros((self.blocks * BLOCK, len(common)), dtype=np.float32)
        self.dense[doc, column] = self.gain[where] * (1 + 2 * self.error)  # a little more than the exact scores, whatever the rounding
        self.block_max = self.dense.reshape(self.blocks, BLOCK, len(common)).max(axis=1)

    def search(self, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of the k best documents of each query with a score above 0 and not below its floor; ties by id."""
        none = np.zeros(0, dtype=np.int64)
        out = [(none, none, np.zeros(0))]
        begins = self.block.begins
        size = max(1, min(GROUP, CELLS // max(1, self.blocks * BLOCK)))
        for first in range(0, len(self.block.ids), size):
            last = min(first + size, len(self.block.ids))
            term = self.at[self.block.which[begins[first] : begins[last]]]
            here = np.flatnonzero(term >= 0)
            if len(here):
                q = np.repeat(np.arange(last - first), np.diff(begins[first : last + 1]))[here]
                found, doc, score = self._group(floors[first:last], q, term[here], k)
                out.append((found + first, doc, score))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _sparse(self, n: int, q: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Scores of all documents by the terms that aren't dense."""
        width = self.blocks * BLOCK
        out = np.empty((n, width))
        entries = np.searchsorted(q, np.arange(n + 1))
        total = np.concatenate(([0], np.cumsum(self.begins[term + 1] - self.begins[term])))[entries]
        first = 0
        while first < n:  # so many queries at once that the working set stays in cache
            last = max(first + 1, int(np.searchsorted(total, total[first] + POSTINGS, "right")) - 1)
            own = slice(entries[first], entries[last])
            where, size = _spans(self.begins, term[own])
            cell = np.repeat((q[own] - first) * width, size)
            cell += self.docs.take(where, mode="clip")
            out[first:last] = np.bincount(cell, self.gain.take(where, mode="clip"), (last - first) * width).reshape(-1, width)
            first = last
        return out

    def _exact(self, has: np.ndarray, q: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Scores of pairs of a query and a document by the dense terms."""
        where, size = _spans(self.own_begins, doc)
        cell = np.repeat(q * has.shape[1], size)
        cell += self.own_columns[where]
        return np.bincount(np.repeat(np.arange(len(q)), size), has.reshape(-1)[cell] * self.own_gain[where], len(q))

    def _group(self, floors: np.ndarray, q: np.ndarray, term: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, slack = len(floors), 10.0**-DIGITS
        column = self.column[term]
        rare = column < 0
        score = self._sparse(n, q[rare], term[rare])
        has = np.zeros((n, self.dense.shape[1]), dtype=np.float32)
        has[q[~rare], column[~rare]] = 1
        used = np.flatnonzero(has.any(axis=0))
        asked, dense, most = has, self.dense, self.block_max
        if 2 * len(used) < has.shape[1]:
            asked, dense, most = has[:, used], dense[:, used], most[:, used]
        bound = score.reshape(n, self.blocks, BLOCK).max(axis=2) + asked @ most.T
        floor = np.maximum(floors - slack, np.nextafter(0, 1))
        found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step, b in enumerate(np.argsort(-bound.sum(axis=0), kind="stable").tolist(), 1):
            active = np.flatnonzero(bound[:, b] >= floor)
            if len(active):
                span = slice(b * BLOCK, (b + 1) * BLOCK)
                rows = slice(None) if len(active) == n else active
                got = asked[rows] @ dense[span].T + score[rows, span]
                at = np.flatnonzero(got >= floor[active, None])
                i = at // BLOCK
                count = np.bincount(i, minlength=len(active))
                many = np.flatnonzero(count > k) if k < BLOCK else ()
                if len(many):
                    kth = np.partition(got[many], BLOCK - k, axis=1)[:, BLOCK - k]
                    floor[active[many]] = np.maximum(floor[active[many]], kth * (1 - 4 * self.error) - slack)
                    keep = got.reshape(-1)[at] >= floor[active[i]]
                    at, i = at[keep], i[keep]
                fresh.append((active[i], at % BLOCK + b * BLOCK, got.reshape(-1)[at]))
            if fresh and (step % REFRESH == 0 or step == self.blocks):
                i, d, upper = (np.concatenate((x, *y)) for x, y in zip(found, zip(*fresh, strict=True), strict=True))
                fresh = []
                order = np.lexsort((-upper, i))
                i, d, upper = i[order], d[order], upper[order]
                begin = np.searchsorted(i, np.arange(n + 1))
                full = np.flatnonzero(np.diff(begin) >= k)
                floor[full] = np.maximum(floor[full], upper[begin[full] + k - 1] * (1 - 4 * self.error) - slack)
                keep = upper >= floor[i]
                found = (i[keep], d[keep], upper[keep])
        i, d, _ = found
        exact = [score[x, y] + self._exact(has, x, y) for x, y in ((i[c : c + CANDIDATES], d[c : c + CANDIDATES]) for c in range(0, len(i), CANDIDATES))]
        return best_of(i, self.ids[d], np.round(np.concatenate(exact), DIGITS) if exact else np.zeros(0), k)


def kth_scores(q: np.ndarray, doc: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th score of each of n queries in a result of best_of; 0 where there are fewer."""
    begin = np.searchsorted(q, np.arange(n + 1))
    full = np.flatnonzero(np.diff(begin) >= k)
    out = np.zeros(n)
    out[full] = score[begin[full] + k - 1]
    return out


class Block:
    """Queries that are sent to all shards together, those of like words next to each other: distinct terms once, and each query's terms by number."""

    def __init__(self, queries: list[tuple[int, np.ndarray, np.ndarray]]):
        terms = np.concatenate([x[1] for x in queries]) if queries else np.zeros(0, dtype=np.uint64)
        weights = np.concatenate([x[2] for x in queries]) if queries else np.zeros(0)
        self.terms, first = np.unique(terms, return_index=True)
        self.weights = weights[first]  # a term weighs the same in all queries
        common = [int(x[1][np.argmin(x[2])]) if len(x[1]) else 0 for x in queries]
        order = sorted(range(len(queries)), key=lambda i: (common[i], len(queries[i][1])))
        self.ids = np.array([queries[i][0] for i in order], dtype=np.int64)
        self.begins = np.concatenate(([0], np.cumsum([len(queries[i][1]) for i in order]))).astype(np.int64)
        self.which = np.searchsorted(self.terms, np.concatenate([queries[i][1] for i in order]) if queries else terms).astype(np.int32)


_INDEX = "shard long, terms binary, begins binary, docs binary, tf binary, ids binary, lengths binary"


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs (id, text) -> one row per shard and piece."""
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    shards = max(1, math.ceil(max(size[0] or 0, 64 * size[1]) / shard_bytes))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        text = table.column("text").combine_chunks().take(pa.array(order))
        rows = build([(data, offsets) for _, _, data, offsets in K.text_slices(text)], ids[order])
        return pa.table({"shard": [table.column("shard")[0].as_py()] * len(rows)} | {k: pa.array([r[k] for r in rows], pa.binary()) for k in rows[0]})

    spread = docs.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)))
    return materialise(spread.groupBy("shard").applyInArrow(run, _INDEX), "index")


def _document_frequencies(shards: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for terms, begins in zip(batch.column(0), batch.column(1), strict=True):
                t = np.frombuffer(terms.as_buffer(), dtype=np.int64)
                b = _numbers(begins.as_buffer(), len(t) + 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.diff(b))], names=["term", "df"])

    return shards.select("terms", "begins").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _query_terms(queries: DataFrame) -> DataFrame:
    """queries (qid, text) -> (qid, term) for each distinct word of the whole text."""

    def run(batches):
        for batch in batches:
            for i, _, data, offsets in K.text_slices(batch.column(1)):
                starts, ends, first = K.words(data, offsets, K.ALNUM)
                h = K.hashes(data, starts, ends)
                each = [np.unique(h[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                flat = np.concatenate(each) if each else np.zeros(0, dtype=np.uint64)
                qid = batch.column(0).slice(i, len(each)).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, [len(x) for x in each]).astype(np.int64)), pa.array(flat.view(np.int64))], names=["qid", "term"])

    return queries.mapInArrow(run, "qid long, term long").distinct()


def _searched(shards: DataFrame, block, floors, mean: float, k: int) -> DataFrame:
    """The k best documents of each query in each partition of shards, as far as they reach the floors."""

    def run(batches):
        queries, least = block.value, floors.value.copy()
        none = np.zeros(0, dtype=np.int64)
        best, fresh, held = (none, none, np.zeros(0)), [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                data = {c: batch.column(j)[row].as_buffer() for j, c in enumerate(batch.schema.names) if c != "shard"}
                fresh.append(Shard(data, mean, queries).search(least, k))  # no name: one piece is held at a time
                held += len(fresh[-1][0])
                if 2 * held > k * len(queries.ids):
                    best, fresh, held = best_of(*(np.concatenate(x) for x in zip(best, *fresh, strict=True)), k), [], 0
                    least = np.maximum(least, kth_scores(*best, len(least), k))
        q, d, s = best_of(*(np.concatenate(x) for x in zip(best, *fresh, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(queries.ids[q]), pa.array(d), pa.array(s)], names=["query_id", "doc_id", "score"])

    return shards.mapInArrow(run, "query_id long, doc_id long, score double")


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Up to k rows per query: query_id, rank, doc_id, score (rounded to DIGITS), best first, ties by doc_id.

    queries has the same columns as docs; a query is the set of distinct words of its
    whole text (runs of ASCII letters, digits and non-ASCII characters, A-Z
    lower-cased), rows that repeat a query's id are one query of all their words. Only
    documents with a score above 0 are listed. Rows with a null id are neither found
    nor queries nor counted; null texts are empty documents and queries without words,
    which find nothing. Rows that repeat are documents of their own.
    """
    spark = docs.sparkSession
    ship(spark)
    pick = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    shards = index(pick(docs), shard_bytes)

    def sizes(batches):
        for batch in batches:
            x = [np.frombuffer(v.as_buffer(), dtype=np.int64) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([len(v) for v in x], pa.int64()), pa.array([int(v.sum()) for v in x], pa.int64())], names=["n", "total"])

    n, total = shards.select("lengths").mapInArrow(sizes, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    n, mean = n or 0, (total or 0) / max(n or 0, 1)
    terms = materialise(_query_terms(pick(queries).withColumnRenamed("id", "qid")), "terms")
    df = _document_frequencies(shards).join(terms.select("term").distinct(), "term", "left_semi")
    weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # One row per query: as long as its own text.
    ready = terms.join(df, "term").select("qid", "term", weight.alias("weight")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("tw"))
    ready = materialise(ready.select("qid", "tw.term", "tw.weight"), "queries")
    results: list[DataFrame] = []

    def search(queries: list) -> None:
        block = Block(queries)
        sent = spark.sparkContext.broadcast(block)
        of = lambda floors: spark.sparkContext.broadcast(floors)
        first = F.col("shard") % OPENING == 0
        opening = materialise(_searched(shards.where(first), sent, of(np.zeros(len(block.ids))), mean, k), "found")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
        kth = opening.withColumn("_gl_rank", rank).where(F.col("_gl_rank") == k).select("query_id", "score").toArrow()
        at = dict(zip(kth["query_id"].to_pylist(), kth["score"].to_pylist(), strict=True))
        floors = np.array([at.get(q, 0.0) for q in block.ids.tolist()])
        results.extend((opening, materialise(_searched(shards.where(~first), sent, of(floors), mean, k), "found")))

    held: list = []
    entries = 0
    for r in ready.toLocalIterator():  # streams the queries; one block of them is held
        held.append((r.qid, np.array(r.term, dtype=np.int64).view(np.uint64), np.array(r.weight)))
        entries += len(r.term)
        if len(held) >= QUERIES or entries >= ENTRIES:
            search(held)
            held, entries = [], 0
    if held or not results:
        search(held)
    found = results[0]
    for x in results[1:]:
        found = found.union(x)
    # At most k rows of each task for a query.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def oracle(words: str, every: int = 50, k: int = TOP) -> str:
    """The same search as DuckDB SQL over ``documents``; ``words`` is SQL for the word list of ``text``."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE / count(*) AS mean FROM d),
p AS (SELECT rid, doc_id, dl, t, count(*)::DOUBLE AS tf FROM (SELECT rid, doc_id, len(w)::DOUBLE AS dl, unnest(w) AS t FROM d) GROUP BY ALL),
f AS (SELECT t, count(*)::DOUBLE AS df FROM p GROUP BY t),
q AS (SELECT DISTINCT doc_id AS query_id, t FROM p WHERE doc_id % {every} = 0),
r AS (SELECT query_id, rid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * dl / mean))), {DIGITS}) AS score
      FROM q JOIN f USING (t) JOIN p USING (t), s GROUP BY query_id, rid, doc_id)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {k}"""
