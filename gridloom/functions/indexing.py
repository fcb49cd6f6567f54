"""Index and slice arguments, normalised on the driver before any plan is built."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from ..spec import ArrayError, ArraySpec

Slice = tuple[int, int, int]


def normalize_index(i: int, size: int) -> int:
    """A negative index counts from the end, once."""
    j = i + size if i < 0 else i
    if not 0 <= j < size:
        raise ArrayError("out_of_bounds", f"index {i}, size {size}")
    return j


def normalize_slice(start: int | None, stop: int | None, step: int | None, size: int) -> Slice:
    """(start, stop, step) with defaults by the sign of step: the whole range, or from the last element to before the first (stop -1)."""
    step = 1 if step is None else step
    if step == 0:
        raise ArrayError("invalid_step", "0")
    if step > 0:
        a = 0 if start is None else start + size if start < 0 else start
        b = size if stop is None else stop + size if stop < 0 else stop
        if not (0 <= a <= size and 0 <= b <= size):
            raise ArrayError("out_of_bounds", f"{start}:{stop}, size {size}")
        return a, b, step
    a = size - 1 if start is None else normalize_index(start, size)
    b = -1 if stop is None else normalize_index(stop, size)
    return a, b, step


def slice_indices(s: Slice) -> list[int]:
    return list(range(*s))


def slice_size(s: Slice) -> int:
    return len(range(*s))


def parse_slice_spec(items: Sequence, shape: Sequence[int]) -> list[int | Slice]:
    """One entry per dimension from integers, (start, stop[, step]) tuples, slices and None; missing ones are whole."""
    if len(items) > len(shape):
        raise ArrayError("too_many_indices", f"{len(items)} for {len(shape)} dimensions")
    out: list[int | Slice] = []
    for i, n in enumerate(shape):
        x = items[i] if i < len(items) else None
        if isinstance(x, bool) or isinstance(x, list):
            raise ArrayError("invalid_slice_spec", repr(x))
        if x is None:
            out.append((0, n, 1))
        elif isinstance(x, int):
            out.append(normalize_index(x, n))
        elif isinstance(x, slice):
            out.append(normalize_slice(x.start, x.stop, x.step, n))
        elif isinstance(x, tuple) and len(x) in (2, 3):
            out.append(normalize_slice(*x, *([None] if len(x) == 2 else []), n))
        else:
            raise ArrayError("invalid_slice_spec", repr(x))
    return out


def mask_to_indices(mask: Iterable[bool]) -> list[int]:
    return [i for i, m in enumerate(mask) if m]


def validate_mask(mask: Sequence, size: int) -> None:
    if len(mask) != size:
        raise ArrayError("mask_shape_mismatch", f"{len(mask)} for {size}")
    if any(not isinstance(m, bool) for m in mask):
        raise ArrayError("invalid_mask")


def fancy_points(indices: Sequence[Sequence[int]], shape: Sequence[int]) -> list[tuple[int, ...]]:
    """Pointwise coordinates from one list per dimension; negative ones wrap."""
    if len(indices) != len(shape):
        raise ArrayError("dimension_mismatch", f"{len(indices)} index lists for {len(shape)} dimensions")
    if len({len(x) for x in indices}) > 1:
        raise ArrayError("length_mismatch")
    return list(zip(*[[normalize_index(i, n) for i in x] for x, n in zip(indices, shape, strict=True)], strict=True))


def block_indices(start: int, stop: int, chunk: int) -> list[tuple[int, int]]:
    """Chunk-aligned blocks over [start, stop), clamped to it at both ends."""
    if chunk <= 0:
        raise ArrayError("invalid_chunks", str(chunk))
    out = []
    at = start
    while at < stop:
        end = min((at // chunk + 1) * chunk, stop)
        out.append((at, end))
        at = end
    return out


def region(spec: ArraySpec, start: Sequence[int] | None, stop: Sequence[int] | None) -> list[tuple[int, int]]:
    """Validated half-open bounds; the defaults are the whole array."""
    a = tuple(0 for _ in spec.shape) if start is None else tuple(start)
    b = tuple(spec.shape) if stop is None else tuple(stop)
    if len(a) != spec.ndim or len(b) != spec.ndim:
        raise ArrayError("dimension_mismatch", f"{len(a)} and {len(b)} for {spec.ndim} dimensions")
    for x, y, n in zip(a, b, spec.shape, strict=True):
        if not all(isinstance(v, int) and not isinstance(v, bool) for v in (x, y)):
            raise ArrayError("invalid_index", f"{x}:{y}")
        if x < 0 or y > n:
            raise ArrayError("out_of_bounds", f"{x}:{y}, size {n}")
        if x > y:
            raise ArrayError("invalid_range", f"{x}:{y}")
    return list(zip(a, b, strict=True))


def named_slices(spec: ArraySpec, named: dict) -> list[Slice]:
    """Bounds by dimension name: range objects are inclusive as given by their first and last element, tuples half-open, integers one element. Dimensions stay."""
    out: list[Slice] = [(0, n, 1) for n in spec.shape]
    for name, x in named.items():
        i = spec.dimension(name)
        if isinstance(x, range):
            if x.step != 1 or not len(x):
                raise ArrayError("invalid_range", repr(x))
            a, b = x[0], x[-1] + 1
        elif isinstance(x, tuple):
            a, b = x
        else:
            a = normalize_index(x, spec.shape[i])
            b = a + 1
        if not 0 <= a <= b <= spec.shape[i]:
            raise ArrayError("out_of_bounds", f"{name} {a}:{b}")
        out[i] = (a, b, 1)
    return out
