"""Packing of tokenised documents into sequences, by lexical retrieval.

Documents are spread over shards of about SHARD_BYTES of text. Each shard builds a
BM25 inverted index over its token ids; a seed document's best unused neighbours, by
all terms that it shares with others, fill its window, the one that is cut at the window's end seeds the next, and so on,
so windows hold lexically close documents and are full. Only a shard's last tokens
don't fill a window: they become sequences of powers of two, which need no padding.

Scale: one shuffle of the texts, balanced by hash (repeated rows spread as well); a
task holds one shard. Ids are made after the shuffle, where they are used.
"""

from __future__ import annotations

import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import ship

WINDOW, END = 2048, 1
SHARD_BYTES = 8 << 20
#: How many neighbours one retrieval returns; a window that needs more asks again for the next ones.
NEIGHBOURS = 8
#: Terms in at least one of so many documents of a shard have their scores as a dense row: at most 4 * COMMON bytes a posting.
COMMON = 16
K1, B = 1.2, 0.75
#: Units whose ids a worker process keeps, at some 60 bytes each.
CACHE = 2_000_000
#: Units or pieces that are encoded as one text.
RUN = 1000

#: The word pattern of that vocabulary; pieces are encoded independently of each other.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Bytes of texts that are encoded whole, as splitting and lower-casing here might differ from the tokenizer's own: separators other than
#: ASCII white space, and all beyond U+00FF. 0xC2 leads U+0080 to U+00BF, among which only letters and plain signs can be split like this.
_ODD = np.zeros(256, dtype=bool)
_ODD[0x1C:0x20] = _ODD[0xC4:] = True
#: Classes of bytes: white space, ASCII letter, end of a letter from U+00C0 on, its lead, digit, sign, apostrophe, and what isn't told apart
#: (U+0080 to U+00BF, and the signs among the letters).
_SPACE, _ASCII, _TAIL, _LEAD, _DIGIT, _SIGN, _QUOTE, _OTHER = range(8)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[[32, *range(9, 14)]] = _SPACE
_CLASS[65:91] = _CLASS[97:123] = _ASCII
_CLASS[48:58] = _DIGIT
_CLASS[39] = _QUOTE
_CLASS[0x80:0xC0] = _TAIL
_CLASS[0xC3] = _LEAD
_CLASS[[0xC2, 0x97, 0xB7]] = _OTHER
#: By the classes of two neighbouring bytes: 1 if a unit starts at the second, 2 if one ends with the first. Inside of words units are cut
#: only where pieces end whatever stands around: at digits, after letters before signs, and after signs before letters unless an apostrophe
#: may join them.
_CUT = np.zeros((8, 8), dtype=np.uint8)
_CUT[_SPACE, 1:] = 1
_CUT[1:, _SPACE] = 2
_CUT[_DIGIT, 1:] = _CUT[1:, _DIGIT] = 3
for _letter in (_ASCII, _TAIL):
    _CUT[_letter, _SIGN] = _CUT[_letter, _QUOTE] = 3
_CUT[_SIGN, _ASCII] = 3
_CUT = _CUT.reshape(-1)
#: Units whose bytes are all of one of these kinds are one piece each: letters, signs, a digit.
_KIND = np.zeros(8, dtype=np.uint8)
_KIND[[_ASCII, _TAIL, _LEAD]], _KIND[_SIGN], _KIND[_DIGIT], _KIND[[_QUOTE, _OTHER]] = 1, 2, 4, 8
#: The character that stands for each byte in the vocabulary, of lower-cased letters up to U+00FF.
_plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHAR = np.zeros(256, dtype="<u2")
_CHAR[_plain] = _plain
_CHAR[np.setdiff1d(np.arange(256), _plain)] = 256 + np.arange(256 - len(_plain))
_CHAR[65:91] = _CHAR[97:123]
_CHAR[0x80:0x9F] = _CHAR[0xA0:0xBF]
_CHAR[32] = 32


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of runs that hold whole pieces, the first run's number of each document (one entry more than documents), and the bytes' classes."""
    classes = np.zeros(len(data) + 2, dtype=np.uint8)
    classes[1:-1] = _CLASS[data]
    after = np.flatnonzero(data == 0xC2) + 2
    classes[after] = _OTHER
    cut = _CUT[classes[:-1] << 3 | classes[1:]]
    cut[offsets] = (classes[offsets + 1] != _SPACE) | (classes[offsets] != _SPACE).view(np.uint8) << 1
    starts, ends = np.flatnonzero((cut & 1).view(bool)), np.flatnonzero((cut >> 1).view(bool))
    return starts, ends, np.searchsorted(starts, offsets), classes[1:-1]


def _joined(data: np.ndarray, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of units with a space behind each, how many each has with it, and the kinds of its bytes."""
    room = ends - starts + 1
    stop = np.cumsum(room)
    at = np.minimum(np.repeat(starts - (stop - room), room) + np.arange(stop[-1]), len(data) - 1)
    text, kind = data[at], _KIND[classes[at]]
    text[stop - 1], kind[stop - 1] = 32, 0
    return text, room, np.bitwise_or.reduceat(kind, stop - room)


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """An array with room for n values."""
    return a if n <= len(a) else np.concatenate((a, np.zeros(max(n, 2 * len(a)) - len(a), dtype=a.dtype)))


class Encoder:
    """Token ids of whole texts, with a bounded cache: a hash table of units, and the ids of each unit."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        own = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path or own)
        # The split by words is this vocabulary's; any other is used as it is.
        self.split = path is None or path == own
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[v for k, v in vocabulary.items() if k.endswith("</w>")]] = True
        # The same merges alone, for pieces that are normalised and split already.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._forget()

    def _forget(self) -> None:
        self.known = 0
        self.table = np.zeros(1 << 16, dtype=np.uint64)
        self.unit = np.full(1 << 16, -1, dtype=np.int32)
        self.keys = np.zeros(1 << 15, dtype=np.uint64)
        self.begin = np.zeros((1 << 15) + 1, dtype=np.int64)
        self.flat = np.zeros(1 << 17, dtype=np.uint16)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The known unit of each hash, or -1."""
        last = len(self.table) - 1
        at = (h & np.uint64(last)).astype(np.int64)
        out = self.unit[at]
        left = np.flatnonzero((self.table[at] != h) & (out >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & last
            out[left] = got = self.unit[at]
            on = (self.table[at] != h[left]) & (got >= 0)
            left, at = left[on], at[on]
        return out

    def _place(self, units: np.ndarray) -> None:
        last = len(self.table) - 1
        at = (self.keys[units] & np.uint64(last)).astype(np.int64)
        while len(units):
            free = self.unit[at] < 0
            self.unit[at[free]] = units[free]
            done = self.unit[at] == units
            self.table[at[done]] = self.keys[units[done]]
            units, at = units[~done], (at[~done] + 1) & last

    def _add(self, keys: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Adds units that are not known, by hash, with their ids."""
        a, b = self.known, self.known + len(keys)
        self.keys, self.begin = _grown(self.keys, b), _grown(self.begin, b + 1)
        self.keys[a:b] = keys
        start = int(self.begin[a])
        np.cumsum(count, out=self.begin[a + 1 : b + 1])
        self.begin[a + 1 : b + 1] += start
        self.flat = _grown(self.flat, start + len(ids))
        self.flat[start : start + len(ids)] = ids
        self.known = b
        if 3 * b > 2 * len(self.table):
            size = 1 << (3 * b // 2).bit_length()
            self.table, self.unit = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
            a = 0
        self._place(np.arange(a, b, dtype=np.int32))

    def _pieces(self, tokenizer, runs: list[str], size: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of runs of pieces and how many each piece has; encoded many at a time, as the last id of each says that it ends a word."""
        flat, count = [np.zeros(0, dtype=np.uint16)], [np.zeros(0, dtype=np.int64)]
        for run, n, e in zip(runs, size, tokenizer.encode_batch_fast(runs, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=np.uint16)
            stops = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stops) != n:
                each = [np.array(x.ids, dtype=np.uint16) for x in tokenizer.encode_batch_fast(run.split(" "), add_special_tokens=False)]
                ids, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
            flat.append(ids)
            count.append(np.diff(stops, prepend=0))
        return np.concatenate(flat), np.concatenate(count)

    def _learn(self, keys: np.ndarray, text: np.ndarray, room: np.ndarray, kind: np.ndarray) -> None:
        """Adds distinct units that are not known: hashes, bytes with a space behind each unit, how many each has, and kinds."""
        plain = (kind == 1) | (kind == 2) | (kind == 4)
        count = int(plain.sum())
        if count:
            bounds = np.append(0, np.cumsum(room[plain]))
            bounds = [*bounds[:-1:RUN].tolist(), int(bounds[-1])]
            chars = _CHAR[text[np.repeat(plain, room)]].tobytes().decode("utf-16-le")
            runs = [chars[a : b - 1] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            self._add(keys[plain], *self._pieces(self.merges, runs, [min(RUN, count - i) for i in range(0, count, RUN)]))
        if count < len(keys):
            number: dict[str, int] = {}
            owner, piece = [], []
            for i, x in enumerate(text[np.repeat(~plain, room)].tobytes().decode("utf-8").lower().split(" ")[:-1]):
                for y in _PIECE.findall(x):
                    owner.append(i)
                    piece.append(number.setdefault(y, len(number)))
            pieces = list(number)
            split = [pieces[i : i + RUN] for i in range(0, len(pieces), RUN)]
            flat, size = self._pieces(self.tokenizer, [" ".join(x) for x in split], [len(x) for x in split])
            own = size[piece]
            stop = np.cumsum(own)
            ids = flat[np.repeat((np.cumsum(size) - size)[piece] - (stop - own), own) + np.arange(int(own.sum()))]
            self._add(keys[~plain], ids, np.bincount(owner, own, len(keys) - count).astype(np.int64))

    def _ids(self, slices: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[np.ndarray]:
        """Ids of each text of the slices (bytes, offsets); what is new in them is learnt at once."""
        if self.known > CACHE:
            self._forget()
        held, fresh = [], []
        for data, offsets in slices:
            starts, ends, first, classes = units(data, offsets)
            h = K.hashes(data, starts, ends)
            unit = self._find(h)
            at = np.flatnonzero(unit < 0)
            held.append((first, unit, at, h[at]))
            if len(at):
                keys, where = np.unique(h[at], return_index=True)
                fresh.append((keys, *_joined(data, classes, starts[at[where]], ends[at[where]])))
        if fresh:
            keys, text, room, kind = (np.concatenate(x) for x in zip(*fresh, strict=True))
            new = np.zeros(len(keys), dtype=bool)
            new[np.unique(keys, return_index=True)[1]] = True
            self._learn(keys[new], text[np.repeat(new, room)], room[new], kind[new])
        for first, unit, at, h in held:
            unit[at] = self._find(h)
            begin = self.begin[unit]
            count = self.begin[unit + 1] - begin
            stop = np.append(0, np.cumsum(count))
            ids = self.flat[np.repeat(begin - stop[:-1], count) + np.arange(stop[-1])]
            bounds = stop[first].tolist()
            yield from (ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True))

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow column, END appended."""
        out: list[np.ndarray] = [None] * len(column)
        end = np.array([END], dtype=np.uint32)
        slices, rows = [], []
        for i, j, data, offsets in K.text_slices(column):
            odd = _ODD[data]
            two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0)) | (data[:-1] == 60) & (data[1:] == 124)
            odd[:-1] |= two
            seen = np.concatenate(([0], np.cumsum(odd)))[offsets]
            whole = (seen[1:] > seen[:-1]) | (not self.split)
            if not whole.any():
                slices.append((data, offsets))
                rows.extend(range(i, j))
                continue
            rest = np.flatnonzero(~whole)
            if len(rest):
                parts = [data[offsets[k] : offsets[k + 1]] for k in rest]
                slices.append((np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))))
                rows.extend((i + rest).tolist())
            whole = np.flatnonzero(whole)
            texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8") for k in whole]
            for k, e in zip(whole.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                out[i + k] = np.array(e.ids, dtype=np.uint32)
        for k, x in zip(rows, self._ids(slices), strict=True):
            out[k] = x
        return [np.concatenate((x.astype(np.uint32), end)) for x in out]


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One in each worker process; tasks have a core each, where the tokenizer's threads would only add to the work."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Index:
    """BM25 inverted index over the token ids of a shard's documents."""

    def __init__(self, ids: list[np.ndarray]):
        n = len(ids)
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        key = np.concatenate(ids).astype(np.int64) if n else np.zeros(0, dtype=np.int64)
        key += np.repeat(np.arange(n, dtype=np.int64), lengths) << 32
        key.sort()
        new = np.ones(len(key), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(key)))
        doc, term = (key[at] >> 32).astype(np.int32), (key[at] & 0xFFFFFFFF).astype(np.uint32)
        self.n = n
        self.of_doc = np.searchsorted(doc, np.arange(n + 1))
        df = np.bincount(term) if len(term) else np.zeros(1, dtype=np.int64)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        mean = max(1.0, lengths.mean()) if n else 1.0
        weight = (idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[doc] / mean)))).astype(np.float32)
        self.terms, self.shared = term, df[term] > 1
        # Of 16 bits, numpy sorts by digits.
        order = np.argsort(term.astype(np.uint16) if len(df) <= 1 << 16 else term, kind="stable")
        self.docs, self.scores = doc[order], weight[order]
        self.start = np.zeros(len(df) + 1, dtype=np.int64)
        np.cumsum(df, out=self.start[1:])
        common = np.flatnonzero((df > 1) & (COMMON * df >= n))
        self.row = np.full(len(df), -1, dtype=np.int64)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n), dtype=np.float32)
        at = self.row[term]
        self.dense[at[at >= 0], doc[at >= 0]] = weight[at >= 0]

    def neighbours(self, seed: int, used: np.ndarray, most: int = NEIGHBOURS) -> list[int]:
        """The best unused documents for a seed by score, then place; those that share no term with it don't count."""
        own = slice(self.of_doc[seed], self.of_doc[seed + 1])
        terms = self.terms[own][self.shared[own]]
        if not len(terms):
            return []
        row = self.row[terms]
        score = self.dense[row[row >= 0]].sum(axis=0)
        rare = terms[row < 0]
        if len(rare):
            spans = [slice(x, y) for x, y in zip(self.start[rare].tolist(), self.start[rare + 1].tolist(), strict=True)]
            score = score + np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.scores[s] for s in spans]), self.n)
        score[used] = 0
        least = np.partition(score, self.n - most)[self.n - most] if self.n > most else 0
        best = np.flatnonzero((score >= least) & (score > 0))
        return best[np.lexsort((best, -score[best]))][:most].tolist()


def chain(lengths: np.ndarray, index: Index, window: int = WINDOW) -> list[int]:
    """The order in which a shard's documents are laid out."""
    n = len(lengths)
    used = np.zeros(n, dtype=bool)
    order: list[int] = []
    at, first, seed = 0, 0, None
    size = lengths.tolist()

    def take(d: int) -> None:
        nonlocal at
        used[d] = True
        order.append(d)
        at += size[d]

    while len(order) < n:
        if seed is None:
            while used[first]:
                first += 1
            seed = first
            take(seed)
        end = -(-at // window) * window
        while at < end and len(order) < n:
            got = index.neighbours(seed, used)
            if not got:
                while used[first]:
                    first += 1
                got = [first]
            for d in got:
                take(d)
                if at >= end:
                    break
        seed = order[-1] if at % window else None
    return order


def sequence_starts(total: int, window: int = WINDOW) -> np.ndarray:
    """Where sequences begin in a shard's stream: full windows, then powers of two from the largest down."""
    full = total // window * window
    starts, at = list(range(0, full, window)), full
    for bit in range((total - full).bit_length() - 1, -1, -1):
        if (total - full) >> bit & 1:
            starts.append(at)
            at += 1 << bit
    return np.array(starts, dtype=np.int64)


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A document's stream is its text's ids (null: none) and END; every row of docs is
    packed once, also if it repeats another or its id is null. A piece lies in one
    sequence of at most ``window`` ids; shorter sequences have a power of two of them.
    """
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = src.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    shards = max(1, math.ceil(max(size[0] or 0, 16 * size[1]) / shard_bytes))

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        order = np.lexsort((np.arange(table.num_rows), table.column("doc_id").fill_null(-(1 << 62)).to_numpy()))
        doc = table.column("doc_id").to_pylist()
        ids = encoder(tokenizer_path).encode(table.column("text"))
        ids = [ids[i] for i in order]
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        laid = np.array(chain(lengths, Index(ids), window), dtype=np.int64)
        begins = np.zeros(len(laid) + 1, dtype=np.int64)
        np.cumsum(lengths[laid], out=begins[1:])
        seqs = sequence_starts(int(begins[-1]), window)
        cuts = np.unique(np.concatenate((begins[:-1], seqs)))
        stops = np.append(cuts[1:], begins[-1])
        which = np.searchsorted(begins, cuts, "right") - 1
        seq = np.searchsorted(seqs, cuts, "right") - 1
        start, length = cuts - begins[which], stops - cuts
        pieces = [ids[d][s : s + n].astype("<u4") for d, s, n in zip(laid[which].tolist(), start.tolist(), length.tolist(), strict=True)]
        cols = {
            "doc_id": pa.array([doc[i] for i in order[laid[which]].tolist()], pa.int64()),
            "start": pa.array(start),
            "length": pa.array(length),
            "ids_crc32": pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()),
            "doc_tokens": pa.array(lengths[laid[which]]),
            "sequence_id": pa.array(seq + (shard << 32)),
            "offset": pa.array(cuts - seqs[seq]),
        }
        if with_ids:
            cols["ids"] = pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32()))
        return pa.table(cols)

    spread = src.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)))
    return spread.groupBy("shard").applyInArrow(run, _SCHEMA + (", ids array<int>" if with_ids else ""))
