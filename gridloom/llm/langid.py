"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text in segments of SEGMENT bytes, in both directions, and gives
every position a distribution over languages; a document's distribution is the mean
over its letters. It is trained here, in numpy, by backpropagation through time, on a
bounded sample: of each language the SAMPLE_DOCS labelled documents with the smallest
hashes, SAMPLE_SEGMENTS segments each.

Scale: the sample's ids come from a grouped limit that prunes before the shuffle;
prediction reads whole texts where they lie, with the weights (some 20 KB) broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .store import materialise, ship

HIDDEN, SEGMENT = 8, 64
SAMPLE_DOCS, SAMPLE_SEGMENTS = 200, 24
#: Languages learned at most, the most frequent ones; the output layer grows with them.
MOST_LANGS = 64
STEPS, BATCH, RATE, SEED = 500, 256, 0.01, 5
UNKNOWN = "und"

_LOWER = K._LOWER
#: Positions that count when a document's probabilities are pooled.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[0x80:] = True


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of SEGMENT x number of segments, document of each segment); the rest of a last segment is zero bytes."""
    sizes = np.diff(offsets)
    per = -(-sizes // SEGMENT)
    doc = np.repeat(np.arange(len(sizes)), per)
    first = np.concatenate(([0], np.cumsum(per)))
    out = np.zeros((len(doc), SEGMENT), dtype=np.uint8)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], sizes) + np.repeat(first[:-1], sizes) * SEGMENT
    out.ravel()[place] = _LOWER[data]
    return np.ascontiguousarray(out.T), doc


class Network:
    """Byte tables, recurrent and output weights; all arrays have features first and sequences last."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        h, n = HIDDEN, len(langs)
        self.langs = langs
        self.p = {
            "table": (rng.standard_normal((2, 3 * h, 256)) * 0.3).astype(np.float32),
            "u": (rng.standard_normal((2, 3 * h, h)) * (0.5 / np.sqrt(h))).astype(np.float32),
            "w": (rng.standard_normal((n, 2 * h)) * 0.1).astype(np.float32),
            "b": np.zeros((n, 1), dtype=np.float32),
        }

    def _run(self, x: np.ndarray, way: int, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of all positions (positions, HIDDEN, sequences), and what the way back needs."""
        steps, n = x.shape
        h = np.zeros((HIDDEN, n), dtype=np.float32)
        out = np.empty((steps, HIDDEN, n), dtype=np.float32)
        table, u, kept = self.p["table"][way], self.p["u"][way], []
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            a = table.take(x[t], axis=1)
            g = u @ h
            gate = a[: 2 * HIDDEN]
            gate += g[: 2 * HIDDEN]
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate += 1
            gate *= 0.5
            z, r = gate[:HIDDEN], gate[HIDDEN:]
            new = a[2 * HIDDEN :]
            new += r * g[2 * HIDDEN :]
            np.tanh(new, out=new)
            before, h = h, new + z * (h - new)
            out[t] = h
            if keep:
                kept.append((t, before, z, r, new, g[2 * HIDDEN :]))
        return out, kept

    def _probabilities(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(positions, languages, sequences)"""
        w = self.p["w"]
        y = np.matmul(w[:, :HIDDEN], f)
        y += np.matmul(w[:, HIDDEN:], b)
        y += self.p["b"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y

    def label(self, x: np.ndarray) -> np.ndarray:
        """The distribution over languages at every position."""
        return self._probabilities(self._run(x, 0, False)[0], self._run(x, 1, False)[0])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the letters of x (SEGMENT x sequences) of languages y, and its gradients."""
        (f, kf), (b, kb) = self._run(x, 0, True), self._run(x, 1, True)
        p = self._probabilities(f, b)
        weight = _LETTER[x].astype(np.float32)
        weight /= max(1.0, weight.sum())
        right = p[:, y, np.arange(len(y))]
        loss = float(-(np.log(right + 1e-9) * weight).sum())
        d = p * weight[:, None, :]
        d[:, y, np.arange(len(y))] -= weight
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        grad["b"][:, 0] = d.sum(axis=(0, 2))
        w = self.p["w"]
        onehot = None
        for way, states, kept in ((0, f, kf), (1, b, kb)):
            part = slice(way * HIDDEN, (way + 1) * HIDDEN)
            grad["w"][:, part] = np.einsum("tln,thn->lh", d, states, optimize=True)
            above = np.matmul(w[:, part].T, d)
            u = self.p["u"][way]
            dh = np.zeros_like(states[0])
            inner = np.empty((len(x), 3 * HIDDEN, x.shape[1]), dtype=np.float32)
            for t, before, z, r, new, gn in reversed(kept):
                dh = dh + above[t]
                da = inner[t]
                dn = dh * (1 - z) * (1 - new * new)
                da[:HIDDEN] = dh * (before - new) * z * (1 - z)
                da[HIDDEN : 2 * HIDDEN] = dn * gn * r * (1 - r)
                da[2 * HIDDEN :] = dn
                dg = da.copy()
                dg[2 * HIDDEN :] *= r
                grad["u"][way] += dg @ before.T
                dh = dh * z + u.T @ dg
            if onehot is None:
                onehot = np.zeros((x.size, 256), dtype=np.float32)
                onehot[np.arange(x.size), x.ravel()] = 1
            grad["table"][way] = inner.transpose(1, 0, 2).reshape(3 * HIDDEN, -1) @ onehot
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Network:
        """Adam on batches that take all languages equally often."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            lang = rng.integers(0, len(groups), BATCH)
            pick = np.array([groups[k][rng.integers(0, len(groups[k]))] for k in lang])
            _, grad = self.gradients(np.ascontiguousarray(x[:, pick]), y[pick])
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(documents, languages): mean distribution over each document's letters; zero without letters."""
        x, doc = segments(data, offsets)
        total = np.zeros((len(offsets) - 1, len(self.langs)))
        letters = np.zeros(len(offsets) - 1)
        for at in range(0, x.shape[1], 2048):
            some = np.ascontiguousarray(x[:, at : at + 2048])
            weight = _LETTER[some].astype(np.float32)
            own = np.einsum("tln,tn->nl", self.label(some), weight)
            of = doc[at : at + 2048]
            for k in range(total.shape[1]):
                total[:, k] += np.bincount(of, own[:, k], len(total))
            letters += np.bincount(of, weight.sum(axis=0), len(total))
        return total / np.maximum(letters, 1)[:, None]


def held_out(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == 2


def training_segments(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """docs (doc_id, text, lang) -> languages, segments, language of each segment. At most MOST_LANGS * SAMPLE_DOCS * SAMPLE_SEGMENTS segments reach the driver."""
    spark = docs.sparkSession
    usable = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= SAMPLE_DOCS)
    langs = [r.lang for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS).collect()]
    if not langs:
        return [], np.zeros((SEGMENT, 0), dtype=np.uint8), np.zeros(0, dtype=np.int64)
    picked = materialise(ranked.where(F.col("lang").isin(langs)).select("doc_id", "lang").distinct(), "sample")

    def run(batches):
        for batch in batches:
            rows, who = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                x, _ = segments(raw, np.array([0, len(raw)]))
                for k in np.unique(np.linspace(0, x.shape[1] - 1, min(SAMPLE_SEGMENTS, x.shape[1])).astype(int)):
                    rows.append(x[:, k].tobytes())
                    who.append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(rows, pa.binary())], names=["lang", "segment"])

    # The sample has at most MOST_LANGS * SAMPLE_DOCS ids.
    chosen = docs.join(F.broadcast(picked.select("doc_id", F.col("lang").alias("l"))), "doc_id").where("lang = l and text is not null").select("lang", "text")
    got = chosen.mapInArrow(run, "lang string, segment binary").toArrow().sort_by([("lang", "ascending"), ("segment", "ascending")])
    place = {x: k for k, x in enumerate(langs)}
    x = np.frombuffer(b"".join(got["segment"].to_pylist()), dtype=np.uint8).reshape(-1, SEGMENT).T
    return langs, np.ascontiguousarray(x), np.array([place[v] for v in got["lang"].to_pylist()], dtype=np.int64)


def train(docs: DataFrame) -> Network | None:
    langs, x, y = training_segments(docs)
    seen = sorted(set(y.tolist()))
    if not seen:
        return None
    renumber = {k: i for i, k in enumerate(seen)}
    return Network([langs[k] for k in seen]).fit(x, np.array([renumber[k] for k in y.tolist()]))




def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score.

    Learns from text and lang where lang isn't null and crc32(id as text) mod 4 isn't 2;
    a null id is neither held out nor learned from. Null texts and texts without a
    letter get ``und`` and score 0, as does everything where there is nothing to learn
    from. A prediction sees the text only, so rows with equal texts get equal results.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(train(src))

    def run(batches):
        net = model.value
        for batch in batches:
            for i, j, data, offsets in K.text_slices(batch.column(1), 1 << 18):
                n = j - i
                if net is None:
                    names, score = [UNKNOWN] * n, np.zeros(n)
                else:
                    p = net.pooled(data, offsets)
                    best = p.argmax(axis=1)
                    names, score = [net.langs[k] for k in best], np.clip(p[np.arange(n), best], 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(2).slice(i, n), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "letter", "lang_pred", "score"])

    out = src.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")).mapInArrow(run, "doc_id long, letter boolean, lang_pred string, score double")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.when(F.col("letter"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("letter"), F.col("score")).otherwise(0.0).alias("score"),
    )
