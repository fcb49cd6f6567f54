"""Byte codecs and the codec pipeline, run beside the data in Arrow batches.

A codec is a pair of functions bytes -> bytes with a configuration. New ones are
registered by name; a pipeline has array -> array steps, one array -> bytes step and
bytes -> bytes steps, in that order.
"""

from __future__ import annotations

import bz2
import gzip
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..spec import ArrayError

_CRC = []
for _i in range(256):
    for _ in range(8):
        _i = (_i >> 1) ^ (0x82F63B78 if _i & 1 else 0)
    _CRC.append(_i)


def crc32c(data: bytes) -> int:
    """Castagnoli checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def _crc_add(data: bytes, **_) -> bytes:
    return data + struct.pack("<I", crc32c(data))


def _crc_check(data: bytes, **_) -> bytes:
    if len(data) < 4 or struct.unpack("<I", data[-4:])[0] != crc32c(data[:-4]):
        raise ArrayError("checksum_mismatch")
    return data[:-4]


def _sized(pack: Callable[[bytes], bytes]) -> Callable[..., bytes]:
    return lambda data, **_: struct.pack("<Q", len(data)) + pack(data)


def _snappy_size(data: bytes) -> int:
    size, shift = 0, 0
    for b in data[:10]:
        size |= (b & 0x7F) << shift
        if b < 0x80:
            return size
        shift += 7
    raise ArrayError("decompression_failed", "snappy")


def _zstd(data: bytes, level: int = 3, **_) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def _unzstd(data: bytes, **_) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _absent(name: str) -> Callable[..., bytes]:
    def fail(data: bytes, **_) -> bytes:
        raise ArrayError("unsupported_codec", f"{name} has no library here")

    return fail


def shuffle(data: bytes, elementsize: int = 4, **_) -> bytes:
    """Byte i of all elements together, for each i; a last partial element stays at the end."""
    whole = len(data) // elementsize * elementsize
    return np.frombuffer(data[:whole], dtype=np.uint8).reshape(-1, elementsize).T.tobytes() + data[whole:]


def unshuffle(data: bytes, elementsize: int = 4, **_) -> bytes:
    whole = len(data) // elementsize * elementsize
    return np.frombuffer(data[:whole], dtype=np.uint8).reshape(elementsize, -1).T.tobytes() + data[whole:]


@dataclass(frozen=True)
class Codec:
    name: str
    kind: str
    encode: Callable[..., bytes]
    decode: Callable[..., bytes]


_REGISTRY: dict[str, Codec] = {}


def register(codec: Codec, force: bool = False) -> None:
    if codec.name in _REGISTRY and not force:
        raise ArrayError("already_registered", codec.name)
    _REGISTRY[codec.name] = codec


def unregister(name: str) -> None:
    _REGISTRY.pop(name, None)


def codec(name: str) -> Codec:
    if name not in _REGISTRY:
        raise ArrayError("unknown_codec", name)
    return _REGISTRY[name]


def available() -> list[str]:
    return sorted(n for n in _REGISTRY if n != "blosc")


for _c in (
    Codec("none", "bytes", lambda d, **_: d, lambda d, **_: d),
    Codec("zlib", "bytes", lambda d, level=5, **_: zlib.compress(d, level), lambda d, **_: zlib.decompress(d)),
    Codec("gzip", "bytes", lambda d, level=5, **_: gzip.compress(d, level, mtime=0), lambda d, **_: gzip.decompress(d)),
    Codec("zstd", "bytes", _zstd, _unzstd),
    Codec("lz4", "bytes", _sized(lambda d: pa.Codec("lz4_raw").compress(d, asbytes=True)), lambda d, **_: pa.Codec("lz4_raw").decompress(d[8:], struct.unpack("<Q", d[:8])[0], asbytes=True) if d[:8] != bytes(8) else b""),
    Codec("snappy", "bytes", lambda d, **_: pa.Codec("snappy").compress(d, asbytes=True), lambda d, **_: pa.Codec("snappy").decompress(d, _snappy_size(d), asbytes=True)),
    Codec("bzip2", "bytes", _sized(lambda d: bz2.compress(d, 9)), lambda d, **_: bz2.decompress(d[8:])),
    Codec("crc32c", "bytes", _crc_add, _crc_check),
    Codec("shuffle", "bytes", shuffle, unshuffle),
    Codec("blosc", "bytes", _absent("blosc"), _absent("blosc")),
):
    register(_c)


#: Array -> array steps by name: (encode, decode) of a NumPy array and a configuration.
def _round_away(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def _delta(x: np.ndarray, **_) -> np.ndarray:
    flat = x.ravel()
    return np.concatenate((flat[:1], np.diff(flat))).astype(x.dtype).reshape(x.shape)


def _undelta(x: np.ndarray, **_) -> np.ndarray:
    return np.cumsum(x.ravel(), dtype=x.dtype).reshape(x.shape)


def _quantize(x: np.ndarray, digits: int | None = None, scale: float | None = None, offset: float = 0.0, astype: str = "int16", **_) -> np.ndarray:
    if digits is not None:
        return (_round_away(x * 10.0**digits) / 10.0**digits).astype(x.dtype) if x.dtype.kind == "f" else x
    lo, hi = np.iinfo(astype).min, np.iinfo(astype).max
    return np.clip(_round_away((x.astype("f8") - offset) / scale), lo, hi).astype(astype)


def _unquantize(x: np.ndarray, digits: int | None = None, scale: float | None = None, offset: float = 0.0, dtype: str = "<f8", **_) -> np.ndarray:
    return x if digits is not None else (x.astype("f8") * scale + offset).astype(dtype)


def _scale(x: np.ndarray, scale: float = 1.0, offset: float = 0.0, astype: str = "<f8", **_) -> np.ndarray:
    return _round_away((x.astype("f8") - offset) / scale).astype(astype)


def _unscale(x: np.ndarray, scale: float = 1.0, offset: float = 0.0, dtype: str = "<f8", **_) -> np.ndarray:
    return (x.astype("f8") * scale + offset).astype(dtype)


def _bitround(x: np.ndarray, keepbits: int = 10, **_) -> np.ndarray:
    bits, mantissa = ("<u8", 52) if x.dtype.itemsize == 8 else ("<u4", 23)
    drop = max(0, mantissa - keepbits)
    mask = np.array(~((1 << drop) - 1) & ((1 << 8 * x.dtype.itemsize) - 1), dtype=bits)
    return (np.ascontiguousarray(x).view(bits) & mask).view(x.dtype)


_same = lambda x, **_: x
ARRAY_STEPS: dict[str, tuple[Callable, Callable]] = {
    "delta": (_delta, _undelta),
    "quantize": (_quantize, _unquantize),
    "fixedscaleoffset": (_scale, _unscale),
    "astype": (lambda x, astype="<f8", **_: x.astype(astype), lambda x, dtype="<f8", **_: x.astype(dtype)),
    "bitround": (_bitround, _same),
    "transpose": (lambda x, order=None, **_: np.transpose(x, order), lambda x, order=None, **_: np.transpose(x, np.argsort(order))),
    "packbits": (_same, _same),
    "categorize": (_same, _same),
}


@dataclass(frozen=True)
class Pipeline:
    arrays: tuple[tuple[str, dict], ...]
    endian: str
    bytes_: tuple[tuple[str, dict], ...]

    @classmethod
    def parse(cls, specs: list[dict] | tuple[dict, ...]) -> Pipeline:
        """From [{name, configuration}]; the order of kinds is fixed, and exactly one step makes bytes."""
        if not specs:
            raise ArrayError("empty_codec_list")
        kinds = []
        for s in specs:
            n = s["name"]
            kinds.append("bytes" if n == "bytes" else "array" if n in ARRAY_STEPS else "byte" if n in _REGISTRY else None)
            if kinds[-1] is None:
                raise ArrayError("unknown_codec", n)
        if kinds.count("bytes") != 1:
            raise ArrayError("missing_array_to_bytes_codec" if not kinds.count("bytes") else "multiple_array_to_bytes_codecs")
        at = kinds.index("bytes")
        if any(k != "array" for k in kinds[:at]) or any(k != "byte" for k in kinds[at + 1 :]):
            raise ArrayError("invalid_codec_order")
        pairs = [(s["name"], dict(s.get("configuration") or {})) for s in specs]
        return cls(tuple(pairs[:at]), pairs[at][1].get("endian", "little"), tuple(pairs[at + 1 :]))

    def encode(self, x: np.ndarray) -> bytes:
        for name, c in self.arrays:
            x = ARRAY_STEPS[name][0](x, **c)
        data = np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">")) if self.endian == "big" else x).tobytes()
        for name, c in self.bytes_:
            data = codec(name).encode(data, **c)
        return data

    def decode(self, data: bytes, dtype: str, shape: tuple[int, ...]) -> np.ndarray:
        for name, c in reversed(self.bytes_):
            data = codec(name).decode(data, **c)
        # What the array steps made of dtype and shape on the way in tells how to read the bytes.
        probe = np.zeros(shape, dtype=dtype)
        for name, c in self.arrays:
            probe = ARRAY_STEPS[name][0](probe, **c)
        kind = probe.dtype.newbyteorder(">") if self.endian == "big" else probe.dtype
        x = np.frombuffer(data, dtype=kind).reshape(probe.shape)
        x = x.astype(probe.dtype)
        for name, c in reversed(self.arrays):
            x = ARRAY_STEPS[name][1](x, **({"dtype": dtype} | c))
        return x.astype(dtype).reshape(shape)


# Shards: many encoded chunks in one object, with an index of offsets at its end or start.
def shard_encode(chunks: dict[tuple[int, ...], bytes], location: str = "end") -> bytes:
    """Chunks in order of their index; the index lists rank and coordinates, then offset and size of each, with a checksum and its own length."""
    order = sorted(chunks)
    head = struct.pack("<I", len(order)) + b"".join(struct.pack(f"<I{len(k)}i", len(k), *k) for k in order)
    places, at = [], 0
    for k in order:
        places.append(struct.pack("<QQ", at, len(chunks[k])))
        at += len(chunks[k])
    index = _crc_add(head + b"".join(places))
    body = b"".join(chunks[k] for k in order)
    size = struct.pack("<Q", len(index))
    return body + index + size if location == "end" else size + index + body


def shard_decode(data: bytes, location: str = "end") -> dict[tuple[int, ...], bytes]:
    if len(data) < 8:
        raise ArrayError("invalid_shard")
    (size,) = struct.unpack("<Q", data[-8:] if location == "end" else data[:8])
    index = _crc_check(data[-8 - size : -8] if location == "end" else data[8 : 8 + size])
    base = 0 if location == "end" else 8 + size
    (n,) = struct.unpack_from("<I", index)
    at, keys = 4, []
    for _ in range(n):
        (rank,) = struct.unpack_from("<I", index, at)
        keys.append(struct.unpack_from(f"<{rank}i", index, at + 4))
        at += 4 + 4 * rank
    out = {}
    for k in keys:
        offset, length = struct.unpack_from("<QQ", index, at)
        at += 16
        out[k] = data[base + offset : base + offset + length]
    return out
