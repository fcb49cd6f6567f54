"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Texts are normalised byte for byte (A-Z lower-cased, separators to blanks, blanks
collapsed), so that every normalised word keeps its place in the original. The
automaton holds each item's windows; a text is scanned once, in UTF-8 bytes.

Scale: one read of the documents, whatever the size of the benchmark, and no text is
shuffled. Executors get blocks of windows of bounded size and a bit table of fixed
size. With more than one block, the bit table of all window hashes first says which
texts can have a hit at all, and only these are scanned, with one block's automaton
after the other; all hits of a row are merged where the row is.
"""

from __future__ import annotations

import hashlib
import re
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .store import ship

WINDOW = 13
#: Windows in one automaton: at about 90 bytes each and 60 bytes a trie node, some 100 MB at most.
BLOCK = 20_000
#: Bits of a window hash that address the bit table: 16 MB, whatever the benchmark.
BITS = 27

_NORMAL = bytes((b + 32 if 65 <= b <= 90 else b) if K.ALNUM[b] else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> list[bytes]:
    """All windows of an item; one of fewer words, but not none, is a single window."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


_built: OrderedDict = OrderedDict()


def automaton(key: str, patterns: dict[bytes, list[int]]):
    """The automaton of a block, built once in each worker process."""
    if key not in _built:
        import ahocorasick

        a = ahocorasick.Automaton()
        for p, items in patterns.items():
            a.add_word(p.decode("latin-1"), (p.count(b" ") - 1, items))
        if patterns:
            a.make_automaton()
        while len(_built) > 1:
            _built.popitem(last=False)
        _built[key] = a
    return _built[key]


def scan(raw: bytes, auto) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, runs of hit words as half-open intervals, items)."""
    words = raw.translate(_NORMAL).split()
    if not words or not len(auto):
        return len(words), [], set()
    text = " " + b" ".join(words).decode("latin-1") + " "
    found = list(auto.iter(text))
    if not found:
        return len(words), [], set()
    blanks = np.flatnonzero(np.frombuffer(text.encode("latin-1"), dtype=np.uint8) == 32)
    ends = np.searchsorted(blanks, [e for e, _ in found])
    items: set[int] = set()
    runs: list[list[int]] = []
    for a, b, (_, (_, own)) in sorted(((int(e) - k, int(e), f) for e, f in zip(ends, found, strict=True) for k in (f[1][0],)), key=lambda x: x[:2]):
        items.update(own)
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return len(words), [(a, b) for a, b in runs], items


class Windows:
    """All windows of a benchmark: blocks of at most ``block`` for an automaton each, and a bit table of their hashes."""

    def __init__(self, benchmark: DataFrame, item_col: str, item_text: str, window: int, block: int):
        self.context = benchmark.sparkSession.sparkContext
        self.blocks: list[tuple[str, object]] = []
        self.bits, self.lengths = np.zeros(1 << BITS - 3, dtype=np.uint8), set()
        patterns: dict[bytes, list[int]] = {}
        rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
        for r in rows.toLocalIterator():  # streams the items; at most one block of windows is held
            for p in windows_of(normal_words(r.t), window):
                own = patterns.setdefault(p, [])
                if r.i not in own:
                    own.append(r.i)
            if len(patterns) >= block:
                patterns = self._add(patterns)
        if patterns or not self.blocks:
            self._add(patterns)
        self.table = self.context.broadcast(self.bits) if len(self.blocks) > 1 else None

    def _add(self, patterns: dict[bytes, list[int]]) -> dict:
        digest = hashlib.sha256(b"".join(p + b",".join(b"%d" % i for i in own) for p, own in sorted(patterns.items()))).hexdigest()
        self.blocks.append((digest, self.context.broadcast(patterns)))
        by_length: dict[int, list[bytes]] = {}
        for p in patterns:
            by_length.setdefault(p.count(b" ") - 1, []).append(p)
        self.lengths.update(by_length)
        for k, own in by_length.items():
            for _, _, data, offsets in K.text_slices(pa.array(own, pa.binary())):
                starts, ends, first = K.words(data, offsets, K.ALNUM)
                at = K.grams(K.hashes(data, starts, ends), k)[first[:-1]] >> np.uint64(64 - BITS)
                np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return {}


def _possible(column: pa.Array, bits: np.ndarray, lengths: list[int]) -> np.ndarray:
    """Whether each text has a run of words whose hash is in the bit table: true of every text with a hit, and of few others."""
    out = np.zeros(len(column), dtype=bool)
    for i, _, data, offsets in K.text_slices(column):
        starts, ends, first = K.words(data, offsets, K.ALNUM)
        h = K.hashes(data, starts, ends)
        for k in lengths:
            at = K.grams(h, k) >> np.uint64(64 - BITS)
            found = np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            out[i + np.searchsorted(first, found, "right") - 1] = True
    return out


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _scanned(src: DataFrame, text_col: str, windows: Windows, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of src, with _gl_words, _gl_runs (first word, end word, start byte, end byte) and _gl_items; one row per row."""
    blocks, table, lengths = windows.blocks, windows.table, sorted(windows.lengths)
    at, kept = src.columns.index(text_col), [src.columns.index(c) for c in keep]

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            n_words, runs, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            wanted = range(len(texts)) if table is None else np.flatnonzero(_possible(batch.column(at), table.value, lengths)).tolist()
            if table is not None:
                for i, j, data, offsets in K.text_slices(batch.column(at)):
                    n_words[i:j] = np.diff(K.words(data, offsets, K.ALNUM)[2]).tolist()
            for key, patterns in blocks:
                auto = automaton(key, patterns.value)
                for i in wanted:
                    n_words[i], found, own = scan(texts[i].as_py() or b"", auto)
                    runs[i] += found
                    items[i] |= own
            for i in wanted:
                if runs[i]:
                    place = [m.span() for m in _WORD.finditer(texts[i].as_py().translate(_NORMAL))]
                    runs[i] = [{"a": a, "b": b, "start": place[a][0], "end": place[b - 1][1]} for a, b in _union(runs[i])]
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))
            new = [pa.array(n_words, pa.int64()), pa.array(runs, kind), pa.array([sorted(x) for x in items], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*keep, "_gl_words", "_gl_runs", "_gl_items"])

    added = T.StructType.fromDDL("_gl_words long, _gl_runs array<struct<a:long,b:long,start:long,end:long>>, _gl_items array<long>")
    return src.mapInArrow(run, T.StructType([*[src.schema[c] for c in kept], *added.fields]))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, share: int = 20, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_hit, n_items, items_sha256, contaminated, spans (UTF-8 byte offsets of hit runs in the original), hit_items.

    A word is hit inside any occurrence of an item's window; contaminated means
    ``n_hit > 0 and share * n_hit >= n_words``. Null texts have no words and no hits.
    Items with a null id or without words are left out; items that repeat an id count
    once. Rows are judged each by itself, so ids may be null or repeat. ``block``
    bounds an automaton's size and doesn't change the result.
    """
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = _scanned(src, "text", Windows(benchmark, item_col, item_text, window, block), ["id"])
    return found.withColumn("n_hit", _hit_words()).select(
        F.col("id").alias(id_col),
        F.col("_gl_words").alias("n_words"),
        "n_hit",
        F.size("_gl_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("_gl_items", lambda x: x.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("_gl_words"))).alias("contaminated"),
        _byte_spans().alias("spans"),
        F.col("_gl_items").alias("hit_items"),
    )


def _hit_words():
    return F.aggregate("_gl_runs", F.lit(0).cast("long"), lambda t, r: t + r.b - r.a)


def _byte_spans():
    return F.transform("_gl_runs", lambda r: F.struct(r.start.alias("start"), r.end.alias("end")))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, block: int = BLOCK) -> DataFrame:
    """docs without contaminated documents; from the others the hit runs are cut out of the text (n_chars follows), all else stays as it is.

    Needs a column text. Each row is judged by itself, so ids may be null or repeat.
    """
    ship(docs.sparkSession)
    found = _scanned(docs, "text", Windows(benchmark, "item_id", "text", window, block), docs.columns)
    # Named first, as columns of docs may have these names.
    judged = found.select(*[F.col(f"`{c}`") for c in docs.columns], _byte_spans().alias("_gl_spans"), "_gl_words", _hit_words().alias("_gl_hit"))
    return cut_spans(judged.where(f"not (_gl_hit > 0 and {share} * _gl_hit >= _gl_words)"), docs.columns)


def cut_spans(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of df with the byte ranges in ``_gl_spans`` cut out of ``text``; rows without spans stay as they are."""
    raw = F.encode("text", "utf-8")
    parts = F.aggregate(
        "_gl_spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<binary>)").alias("got")),
        lambda s, x: F.struct(x.end.alias("at"), F.concat(s.got, F.array(F.substring(raw, (s.at + 1).cast("int"), (x.start - s.at).cast("int")))).alias("got")),
        lambda s: F.concat(s.got, F.array(F.substring(raw, (s.at + 1).cast("int"), F.length(raw)))),
    )
    cut = F.size("_gl_spans") > 0
    text = F.when(cut, F.decode(F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)), "utf-8")).otherwise(F.col("text"))
    pick = {"text": F.col("_gl_text").alias("text")}
    if "n_chars" in columns:
        pick["n_chars"] = F.when(cut, F.length("_gl_text").cast(df.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    # Named first: two copies of one lambda in an expression would share its variables.
    return df.withColumn("_gl_text", text).select(*[pick.get(c, F.col(f"`{c}`")) for c in columns])
