from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import packing


@pytest.mark.parametrize("size", [3, 40, 300])
def test_neighbours_by_all_terms(size):
    """A seed's neighbours are the best by every term that it shares with them, not by some of its terms; equal scores go by place."""
    r = np.random.default_rng(size)
    ids = [(500 * r.random(r.integers(0, 400)) ** 3).astype(np.uint32) for _ in range(size)]
    ids[-1] = ids[1]
    bags = [Counter(x.tolist()) for x in ids]
    mean = max(1.0, sum(map(len, ids)) / size)
    df = Counter(t for b in bags for t in b)
    index = packing.Index(ids)
    used = r.random(size) < 0.2
    for seed in range(min(size, 60)):
        taken = used.copy()
        taken[seed] = True
        scores = []
        for b, x in zip(bags, ids, strict=True):
            norm = packing.K1 * (1 - packing.B + packing.B * len(x) / mean)
            scores.append(sum(np.log1p((size - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * (packing.K1 + 1) / (b[t] + norm) for t in bags[seed] if t in b))
        free = [d for d in range(size) if not taken[d] and scores[d] > 0]
        got = index.neighbours(seed, taken)
        assert len(got) == len(set(got)) == min(len(free), packing.NEIGHBOURS) and set(got) <= set(free)
        # Sums in single precision may swap what is equal to five digits.
        want = sorted((scores[d] for d in free), reverse=True)[: len(got)]
        np.testing.assert_allclose([scores[d] for d in got], want, rtol=1e-5)


class Counting:
    """A tokenizer that notes how many characters it is given."""

    def __init__(self, tokenizer, seen):
        self.tokenizer, self.seen = tokenizer, seen

    def encode_batch_fast(self, texts, **options):
        self.seen.extend(len(t) for t in texts)
        return self.tokenizer.encode_batch_fast(texts, **options)

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)


def test_known_words_are_encoded_once():
    """Words that are known are not encoded again when other signs, digits or capitals stand around them."""
    r = np.random.default_rng(1)
    words = ["".join(x) for x in r.choice(list("abdegilmnorstuéñ"), (4000, 9))]
    e, seen = packing.Encoder(), []
    for name in ("tokenizer", "merges"):
        if hasattr(e, name):
            setattr(e, name, Counting(getattr(e, name), seen))
    e.encode(pa.array([" ".join(words)]))
    once = sum(seen)
    seen.clear()
    texts = [" ".join(a + w + b for w in words) for a, b in (("", ","), ("", "."), ("", ")"), ("7", "!!"), ("", "'"), ("", ";"))]
    got = e.encode(pa.array([texts[0].replace("b", "B"), *texts[1:]]))
    assert once >= 10 * sum(seen)
    for t, x in zip(texts, got, strict=True):
        np.testing.assert_array_equal(x, [*e.tokenizer.encode(t, add_special_tokens=False).ids, packing.END])


@pytest.mark.parametrize("last", [0x7F, 0xFF, 0x17F])
def test_ids_of_any_characters(last):
    """Ids are the tokenizer's own for any order of letters, digits, signs, apostrophes and separators, for many texts at once or one."""
    r = np.random.default_rng(last)
    common = [ord(c) for c in "aAsStTdDmMlLvVrReE''''  \n!-.<|>0159éÉßÿÞ×÷«ªº²½µ· ­" if ord(c) <= last]
    rare = np.setdiff1d(np.arange(last + 1), np.arange(0x1C, 0x20))
    texts = [None, "", " ", "'", "é", "Ü", "×", "!é", "×!", "ª!", "²x", "don't'SAY", "a'", "x" * 5000, "l'été's", "a\x1cb"]
    for n in r.integers(1, 60, 1500):
        texts.append("".join(map(chr, np.where(r.random(n) < 0.7, r.choice(common, n), r.choice(rare, n)).tolist())))
    e = packing.Encoder()
    want = [[*e.tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END] for t in texts]
    assert [x.tolist() for x in e.encode(pa.array(texts))] == want
    assert [x.tolist() for x in e.encode(pa.array(texts[::-1]))] == want[::-1]
    e = packing.Encoder()
    assert [e.encode(pa.array([t], pa.string()))[0].tolist() for t in texts] == want
    assert e.encode(pa.array([], pa.string())) == []


def test_the_cache_is_bounded(monkeypatch):
    """Beyond CACHE units all is learnt anew, with the same ids."""
    monkeypatch.setattr(packing, "CACHE", 500)
    e = packing.Encoder()
    r = np.random.default_rng(2)
    for _ in range(6):
        t = " ".join("".join(x) for x in r.choice(list("abcdefgh"), (400, 5)))
        assert e.encode(pa.array([t]))[0].tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, packing.END]
        assert e.known <= 900
