"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model predicts bytes from the four before, all 256 of them and unfolded, so that
its tables grow with the trusted text. Trusted documents fall into two folds by the
hash of their text, each fold has a model, and every document is judged by the model
of the fold that it isn't in: no text is judged by counts that it added to itself.

* blocks: texts meet their labels and, later, their n-grams' probabilities in blocks
  by the hash of doc_id, packed and compressed, so that a text moves twice, not its
  n-grams;
* counts: a block counts its trusted texts' n-grams; they are summed over all blocks;
* joins: a block asks for its distinct n-grams once each. Requests and counts meet in
  shards by the two bytes before the predicted one; all lower orders, totals and
  back-off weights of a shard follow from the counts there. Only orders one and two
  (at most 256**2 entries) and the discounts are sent to all;
* scoring: perplexity of each whole document, shrunk towards the trusted mean for
  short ones; a document is rejected above its language's quantile of trusted ones,
  shrunk towards its mean plus the spread of all languages the fewer it has, and with
  a margin of some standard errors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .store import discard, materialise, ship

ORDER, BYTES, FOLDS = 5, 256, 2  # codes() and the choice of the other fold know these numbers
#: Symbols of average likelihood that every document is taken to have besides its own.
PRIOR = 60
QUANTILE = 0.995
#: So many trusted documents of a language weigh as much as the spread that all languages share.
SHRINK = 50
#: A quantile of few documents is a low estimate: so many standard errors of the language's mean are added.
MARGIN = 4
#: Bytes of text of a block on average; blocks whose requests a task of a shard answers at once; shards.
BLOCK_BYTES, GROUP, SHARDS = 6 << 20, 256, 64
_PIECE, HELD_BYTES = 1 << 20, 32 << 20

_PACKED = "block long, kind int, at int, data binary"
_DOCS, _IDS, _REPLY = 0, 1, 2


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The n-gram of each byte with those before it in its own document, as a number; zeros stand before a document."""
    pad = ORDER - 1
    own = np.ones(len(data) + pad * (len(offsets) - 1), dtype=bool)
    own[(offsets[:-1] + pad * np.arange(len(offsets) - 1))[:, None] + np.arange(pad)] = False
    s = np.zeros(len(own), dtype=np.uint8)
    s[own] = data
    out = s.astype(np.int64)
    for k in range(1, ORDER):
        out[k:] |= s[:-k].astype(np.int64) << 8 * k
    return out[own]


def pieces(column: pa.Array):
    """(row of each byte, n-gram of each byte) in pieces of bounded size; a long text takes several."""
    for i, j, data, offsets in K.text_slices(column, _PIECE):
        if j - i > 1:
            yield np.repeat(np.arange(i, j, dtype=np.int32), np.diff(offsets)), codes(data, offsets)
            continue
        for a in range(0, len(data), _PIECE):
            lead = min(a, ORDER - 1)
            part = codes(data[a - lead : a + _PIECE], np.array([0, min(len(data) - a, _PIECE) + lead]))[lead:]
            yield np.full(len(part), i, dtype=np.int32), part


def shards_of(code: np.ndarray) -> np.ndarray:
    return (K.mix((code >> 8 & 0xFFFF).astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int64)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _numbers(values: np.ndarray) -> bytes:
    """Sorted numbers, as compressed differences."""
    return pa.compress(np.diff(values, prepend=0).tobytes(), codec="zstd", asbytes=True)


def _from_numbers(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.int64))


def _losses(values: np.ndarray) -> bytes:
    """Losses in steps of 1 / 1024 (a step is far below what a threshold can tell), high and low bytes apart, compressed."""
    steps = np.minimum(np.round(values * 1024), 65535).astype("<u2")
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 2).T).tobytes(), codec="zstd", asbytes=True)


def _from_losses(data: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, decompressed_size=2 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(2, -1).T).view("<u2").ravel() / 1024


def _in_blocks(df: DataFrame, blocks: int, kind: int) -> DataFrame:
    """df packed by the hash of doc_id, one row for each block and batch; rows with a null doc_id go by their text."""
    key = F.xxhash64("doc_id") if "text" not in df.columns else F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))

    def run(batches):
        for batch in batches:
            block = batch.column(0).to_numpy()
            order = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.diff(block[order], prepend=-1)).tolist()
            rows = batch.select(batch.schema.names[1:]) if len(edges) == 1 else batch.select(batch.schema.names[1:]).take(pa.array(order))
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(block[order[a]])]), pa.array([kind], pa.int32()), pa.array([0], pa.int32()), pa.array([_ipc(rows.slice(a, b - a))], pa.binary())], names=["block", "kind", "at", "data"])

    return df.select(F.pmod(key, F.lit(blocks)).alias("_gl_block"), *[F.col(f"`{c}`") for c in df.columns]).mapInArrow(run, _PACKED)


def _unpacked(table: pa.Table) -> tuple[pa.RecordBatch | None, np.ndarray, list[tuple[int, bytes]]]:
    """A block's documents, its trusted ids in order, and its replies (shard and fold, data)."""
    docs, ids, replies = [], [np.zeros(0, dtype=np.int64)], []
    for kind, at, data in zip(table.column("kind").to_pylist(), table.column("at").to_pylist(), table.column("data"), strict=True):
        if kind == _REPLY:
            replies.append((at, data.as_py()))
        elif kind == _DOCS:
            docs += pa.ipc.open_stream(data.as_buffer()).read_all().to_batches()
        else:
            ids += [b.column(0).to_numpy() for b in pa.ipc.open_stream(data.as_buffer()).read_all().to_batches()]
    return pa.concat_batches(docs) if docs else None, np.sort(np.concatenate(ids)), replies


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _is_trusted(batch: pa.RecordBatch, ids: np.ndarray) -> np.ndarray:
    own = _column(batch, "doc_id")
    return own.is_valid().to_numpy(zero_copy_only=False) & np.isin(own.fill_null(0).to_numpy(), ids)


def _encoded(batch: pa.RecordBatch):
    """(fold, row of each byte, place of its n-gram, the distinct n-grams) for each piece of the texts and each fold in it."""
    folds = _column(batch, "_gl_fold").to_numpy()
    for row, code in pieces(_column(batch, "text")):
        fold = folds[row]
        for f in range(FOLDS):
            own = fold == f
            if own.any():
                got = pa.array(code[own]).dictionary_encode()
                yield f, row[own], got.indices.to_numpy(), got.dictionary.to_numpy()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams with counts, some twice -> in order, each once."""
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code = np.concatenate([x for x, _ in parts])
    if not len(code):
        return code, np.zeros(0, dtype=np.int64)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
    return code[first], np.add.reduceat(np.concatenate([n for _, n in parts])[order], first)


def levels(code: np.ndarray, count: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Counts of order ORDER (all of a shard, in order) -> those of each order down to 3; lower ones count distinct bytes on the left."""
    out = {ORDER: (code, count)}
    for k in range(ORDER - 1, 2, -1):
        out[k] = np.unique(out[k + 1][0] & ((1 << 8 * k) - 1), return_counts=True)
    return out


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2, and 3 or more, from the numbers of n-grams counted 1, 2, 3 and 4 times."""
    n = [max(1, x) for x in n]
    y = n[0] / (n[0] + 2 * n[1])
    raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return [0.0] + [min(max(d, 0.05), float(i)) for i, d in enumerate(raw, 1)]


def weights(code: np.ndarray, count: np.ndarray, cut: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of one order in order -> their discounted share, the distinct contexts in order, their back-off weights."""
    context, of = np.unique(code >> 8, return_inverse=True)
    d = np.array(cut)[np.minimum(count, 3)]
    total = np.bincount(of, count, len(context))
    return (count - d) / total[of], context, np.bincount(of, d, len(context)) / total


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool)


class Model:
    """Kneser-Ney counts of one fold; ``pairs`` are probabilities of orders one and two for all byte pairs."""

    def __init__(self, code: np.ndarray, count: np.ndarray, cuts: dict[int, list[float]], pairs: np.ndarray):
        self.parts, self.pairs = {k: (x[0], *weights(*x, cuts[k])) for k, x in levels(code, count).items()}, pairs

    def loss(self, code: np.ndarray) -> np.ndarray:
        p = self.pairs[code & 0xFFFF].astype(np.float64)
        for k in range(3, ORDER + 1):
            gram = code & ((1 << 8 * k) - 1)
            grams, alpha, contexts, gamma = self.parts[k]
            at, has = _found(contexts, gram >> 8)
            p[has] *= gamma[at[has]]
            at, has = _found(grams, gram)
            p[has] += alpha[at[has]]
        return -np.log(p)


def low_orders(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Byte pairs in order with the numbers of distinct bytes before them -> interpolated probabilities of all byte pairs."""
    cut = lambda c: discounts([int((c == i).sum()) for i in (1, 2, 3, 4)])
    p = np.full(BYTES, 1 / BYTES)
    single, times = np.unique(code & 0xFF, return_counts=True)
    if len(single):
        context = times.sum()
        d = np.array(cut(times))[np.minimum(times, 3)]
        p *= d.sum() / context
        p[single] += (times - d) / context
    pairs = np.tile(p, (BYTES, 1))
    if len(code):
        alpha, context, gamma = weights(code, count, cut(count))
        pairs[context] *= gamma[:, None]
        pairs.reshape(-1)[code] += alpha
    return pairs.reshape(-1)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of documents all of whose labels say quality 1 and not toxic."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select(F.col("doc_id").cast("long").alias("doc_id"))


def _counted(packed: DataFrame) -> DataFrame:
    """Packed documents and ids -> by block, shard and fold the distinct n-grams of its texts (n, codes), and counts of those that trusted texts have (m, trusted, counts)."""

    def run(table: pa.Table) -> pa.Table:
        batch, trusted, _ = _unpacked(table)
        kinds = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("fold", pa.int32()), ("n", pa.int64()), ("codes", pa.binary()), ("m", pa.int64()), ("trusted", pa.binary()), ("counts", pa.binary())])
        rows: list[tuple] = []
        if batch is not None:
            block, good = table.column("block")[0].as_py(), _is_trusted(batch, trusted)
            parts: dict[int, list] = {f: [] for f in range(FOLDS)}
            for f, row, place, grams in _encoded(batch):
                parts[f].append((grams, np.bincount(place[good[row]], minlength=len(grams))))
            for f, own in parts.items():
                code, count = _merged(own)
                shard = shards_of(code)
                for s in np.unique(shard).tolist():
                    here = shard == s
                    seen = here & (count > 0)
                    rows.append((s, block, f, int(here.sum()), _numbers(code[here]), int(seen.sum()), _numbers(code[seen]), _numbers(count[seen])))
        return pa.table([pa.array([r[i] for r in rows], x.type) for i, x in enumerate(kinds)], schema=kinds)

    return packed.groupBy("block").applyInArrow(K.sparing(run), "shard long, block long, fold int, n long, codes binary, m long, trusted binary, counts binary")


def _summed(found: DataFrame) -> DataFrame:
    """Counts of blocks -> (fold, shard, code, c): summed within groups of blocks, then over all."""

    def run(table: pa.Table) -> pa.Table:
        cols = [table.column(k) for k in ("m", "trusted", "counts")]
        code, c = _merged([(_from_numbers(x.as_py(), m.as_py()), _from_numbers(y.as_py(), m.as_py())) for m, x, y in zip(*cols, strict=True)])
        return pa.table({k: pa.array(np.full(len(code), table.column(k)[0].as_py()), t) for k, t in (("fold", pa.int32()), ("shard", pa.int64()))} | {"code": code, "c": c})

    parts = found.where("m > 0").select("fold", "shard", "m", "trusted", "counts", F.expr(f"block div {GROUP}").alias("part"))
    return parts.groupBy("part", "fold", "shard").applyInArrow(K.sparing(run), "fold int, shard long, code long, c long").groupBy("fold", "shard", "code").agg(F.sum("c").alias("c"))


def _statistics(counts: DataFrame) -> list[tuple[dict[int, list[float]], np.ndarray]]:
    """counts (fold, shard, code, c) -> of each fold the discounts of orders 3 and up, and the probabilities of byte pairs. At most 256**2 rows a fold reach the driver."""

    def run(table: pa.Table) -> pa.Table:
        code, c = table.column("code").to_numpy(), table.column("c").to_numpy()
        order = np.argsort(code)
        got = levels(code[order], c[order])
        pair, times = np.unique(got[3][0] & 0xFFFF, return_counts=True)  # a 3-gram is in one shard only, so these add up
        seen = [(4 * k + i - 1, int((got[k][1] == i).sum())) for k in range(3, ORDER + 1) for i in (1, 2, 3, 4)]
        at = np.concatenate((np.array([-1 - x for x, _ in seen], dtype=np.int64), pair))
        return pa.table({"fold": pa.array(np.full(len(at), table.column("fold")[0].as_py(), dtype=np.int32)), "at": at, "c": np.concatenate((np.array([n for _, n in seen], dtype=np.int64), times.astype(np.int64)))})

    got = counts.groupBy("fold", "shard").applyInArrow(K.sparing(run), "fold int, at long, c long").groupBy("fold", "at").agg(F.sum("c").alias("c")).toArrow()
    fold, at, c = (got.column(k).to_numpy() for k in ("fold", "at", "c"))
    out = []
    for f in range(FOLDS):
        own = np.argsort(at[fold == f])
        place, count = at[fold == f][own], c[fold == f][own]
        seen = dict(zip((-1 - place[place < 0]).tolist(), count[place < 0].tolist(), strict=True))
        cuts = {k: discounts([seen.get(4 * k + i, 0) for i in range(4)]) for k in range(3, ORDER + 1)}
        out.append((cuts, low_orders(place[place >= 0], count[place >= 0])))
    return out


def _replies(counts: DataFrame, requests: DataFrame, low, blocks: int) -> DataFrame:
    """counts (fold, shard, code, c) and requests (shard, block, fold, codes, n) -> packed replies: the loss of each n-gram under the other fold's model."""

    def run(model: pa.Table, asked: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes]] = []
        if len(asked):
            fold, shard = asked.column("fold")[0].as_py(), asked.column("shard")[0].as_py()
            code, c = model.column("code").to_numpy(), model.column("c").to_numpy()
            order = np.argsort(code)
            m = Model(code[order], c[order], *low.value[1 - fold])
            for block, data, n in zip(asked.column("block").to_pylist(), asked.column("codes").to_pylist(), asked.column("n").to_pylist(), strict=True):
                rows.append((block, shard * FOLDS + fold, _losses(m.loss(_from_numbers(data, n)))))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([_REPLY] * len(rows), pa.int32()), "at": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})

    # A shard's counts go to every group of blocks, to those texts that they weren't made from.
    spread = counts.select((1 - F.col("fold")).alias("fold"), "shard", "code", "c", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // GROUP))).alias("part"))
    asked = requests.select("fold", "shard", "block", "codes", "n", F.expr(f"cast(block div {GROUP} as int)").alias("part"))
    keys = ("part", "fold", "shard")
    return spread.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(K.sparing(run), _PACKED)


def _scored(packed: DataFrame, columns: T.StructType) -> DataFrame:
    """Packed documents, ids and replies -> the documents with _gl_nll (negative log probability), _gl_n (bytes) and _gl_trusted."""
    names = columns.fieldNames()

    def run(table: pa.Table) -> pa.Table:
        batch, trusted, replies = _unpacked(table)
        if batch is None:
            return empty.empty_table()
        parts = list(_encoded(batch)) if _column(batch, "text").nbytes <= HELD_BYTES else None  # of larger blocks they are made again
        again = lambda: parts if parts is not None else _encoded(batch)
        asked = [np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *[grams for g, _, _, grams in again() if g == f]])) for f in range(FOLDS)]
        losses, shard = [np.zeros(len(code)) for code in asked], [shards_of(code) for code in asked]
        for at, data in replies:
            here = shard[at % FOLDS] == at // FOLDS
            losses[at % FOLDS][here] = _from_losses(data, int(here.sum()))
        nll, n = np.zeros(len(batch)), np.zeros(len(batch), dtype=np.int64)
        for f, row, place, grams in again():
            n += np.bincount(row, minlength=len(batch))
            nll += np.bincount(row, losses[f][np.searchsorted(asked[f], grams)][place], len(batch))
        return pa.table([*[_column(batch, k) for k in names], pa.array(nll), pa.array(n), pa.array(_is_trusted(batch, trusted))], names=[*names, "_gl_nll", "_gl_n", "_gl_trusted"])

    from pyspark.sql.pandas.types import to_arrow_schema

    added = T.StructType.fromDDL("_gl_nll double, _gl_n long, _gl_trusted boolean")
    schema = T.StructType([*columns.fields, *added.fields])
    empty = to_arrow_schema(schema)
    return packed.groupBy("block").applyInArrow(K.sparing(run), schema)


class Classifier:
    """The fitted model's replies to all n-grams of ``docs``, the mean loss of trusted text, thresholds by language and over all (for null languages)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE):
        spark = docs.sparkSession
        ship(spark)
        narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
        self.blocks = max(1, -(-(narrow.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BLOCK_BYTES))
        self.ids = _in_blocks(trusted_ids(labels), self.blocks, _IDS)
        found = materialise(_counted(self._packed(narrow)), "grams")
        counts = materialise(_summed(found), "counts")
        low = spark.sparkContext.broadcast(_statistics(counts))
        self.replies = materialise(_replies(counts, found, low, self.blocks), "replies")
        discard(found)
        discard(counts)
        self.scores = materialise(self.scored(narrow).drop("text"), "scores")
        good = self.scores.where("_gl_trusted")
        self.mean = good.agg(F.sum("_gl_nll") / F.nullif(F.sum("_gl_n"), F.lit(0))).first()[0]
        self.overall, self.by_lang = None, spark.createDataFrame([], "lang string, own double")
        if self.mean is not None:
            at = lambda x, q: F.percentile_approx(x, q, 10000)
            good = good.withColumn("x", F.log(self.perplexity()))
            top, middle = good.agg(at("x", quantile), at("x", 0.5)).first()
            self.overall = float(np.exp(top))
            named = good.where("lang is not null")
            own = named.groupBy("lang").agg(at("x", quantile).alias("own"), F.avg("x").alias("centre"), F.stddev_samp("x").alias("sd"), F.count(F.lit(1)).alias("n"))
            # A mean takes its share of its own documents' deviations; a single document has none.
            spread = named.join(own.where("n > 1"), "lang").agg(at((F.col("x") - F.col("centre")) * F.sqrt(F.col("n") / (F.col("n") - 1)), quantile)).first()[0]
            spread = top - middle if spread is None else spread
            # Languages without trusted documents stand at the median of all that they have, with their own spread where it is wider: four standard deviations are six times upper quartile less median.
            every = self.scores.where("lang is not null").withColumn("x", F.log(self.perplexity())).groupBy("lang").agg(at("x", 0.5).alias("median"), at("x", 0.75).alias("upper"))
            limit = F.when(F.col("n").isNull(), F.col("median") + F.greatest(F.lit(spread), 6 * (F.col("upper") - F.col("median")))).otherwise((F.col("n") * F.col("own") + SHRINK * (F.col("centre") + spread)) / (F.col("n") + SHRINK) + MARGIN * F.coalesce("sd", F.lit(0.0)) / F.sqrt("n"))
            self.by_lang = materialise(every.join(own, "lang", "left").select("lang", F.exp(limit).alias("own")), "thresholds")

    def _packed(self, docs: DataFrame) -> DataFrame:
        return _in_blocks(docs.withColumn("_gl_fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS))), self.blocks, _DOCS).union(self.ids)

    def scored(self, docs: DataFrame) -> DataFrame:
        """docs (of those that the model was made for, any columns) with _gl_nll, _gl_n and _gl_trusted."""
        return _scored(self._packed(docs).union(self.replies), docs.schema)

    def perplexity(self):
        if self.mean is None:
            return F.lit(None).cast("double")
        return F.exp((F.col("_gl_nll") + PRIOR * self.mean) / (F.col("_gl_n") + PRIOR))

    def judge(self, rows: DataFrame) -> DataFrame:
        """rows with _gl_nll, _gl_n, lang -> with _gl_perplexity, _gl_threshold, _gl_kept. Without trusted text nothing is rejected."""
        limits = self.by_lang.toDF("_gl_lang", "_gl_own")  # a row a language: few are broadcast by their size, many are joined
        out = rows.join(limits, rows["lang"] == F.col("_gl_lang"), "left").withColumn("_gl_threshold", F.coalesce("_gl_own", F.lit(self.overall).cast("double")))
        return out.withColumn("_gl_perplexity", self.perplexity()).withColumn("_gl_kept", (F.col("_gl_n") == 0) | F.coalesce(F.col("_gl_perplexity") <= F.col("_gl_threshold"), F.lit(True)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, n_symbols (bytes), perplexity, threshold, kept.

    Null and empty texts have the trusted mean's perplexity and are kept, as nothing
    speaks against them; a null language uses the threshold over all languages; a
    null doc_id is scored but never trusted. Rows that repeat are judged alike.
    """
    c = Classifier(docs, labels)
    return c.judge(c.scores).select("doc_id", "lang", F.col("_gl_n").alias("n_symbols"), F.round("_gl_perplexity", 6).alias("perplexity"), F.round("_gl_threshold", 6).alias("threshold"), F.col("_gl_kept").alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    c = Classifier(docs, labels)
    return c.judge(c.scored(docs)).where("_gl_kept").select(*[F.col(f"`{x}`") for x in docs.columns])
