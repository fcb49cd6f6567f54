"""Chunk keys: how a chunk index becomes a storage key, and back."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from ..spec import ArrayError, ArraySpec


@dataclass(frozen=True)
class KeyEncoder:
    name: str
    encode: Callable[[tuple[int, ...]], str]
    decode: Callable[[str], tuple[int, ...]]
    pattern: str


def _decoder(pattern: str, split: Callable[[str], list[str]]) -> Callable[[str], tuple[int, ...]]:
    def decode(key: str) -> tuple[int, ...]:
        if not re.fullmatch(pattern, key):
            raise ArrayError("invalid_chunk_key", key)
        return tuple(int(x) for x in split(key))

    return decode


_N = r"(?:0|[1-9][0-9]*)"
_DOTS, _SLASHES = rf"{_N}(?:\.{_N})*", rf"c(?:/{_N})+"
_ENCODERS: dict[str | int, KeyEncoder] = {}


def register(encoder: KeyEncoder, *names: str | int, force: bool = False) -> None:
    for n in (encoder.name, *names):
        if n in _ENCODERS and not force:
            raise ArrayError("already_registered", str(n))
        _ENCODERS[n] = encoder


register(KeyEncoder("v2", lambda i: ".".join(map(str, i)), _decoder(_DOTS, lambda k: k.split(".")), _DOTS), 2)
register(KeyEncoder("default", lambda i: "/".join(["c", *map(str, i)]), _decoder(_SLASHES, lambda k: k.split("/")[1:]), _SLASHES), 3)


def encoder(name: str | int) -> KeyEncoder:
    if name not in _ENCODERS:
        raise ArrayError("unknown_encoder", str(name))
    return _ENCODERS[name]


def encode(index: tuple[int, ...], version: str | int = 2) -> str:
    return encoder(version).encode(tuple(index))


def decode(key: str, version: str | int = 2) -> tuple[int, ...]:
    return encoder(version).decode(key)


def valid(key: str, version: str | int = 2) -> bool:
    return re.fullmatch(encoder(version).pattern, key) is not None


def list_all(spec: ArraySpec, version: str | int | None = None) -> list[str]:
    """All chunk keys of an array, in row-major order; for tools, as it lists on the driver."""
    return [encode(i, spec.version if version is None else version) for i in product(*map(range, spec.num_chunks))]
