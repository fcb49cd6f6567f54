"""Operators over the driver's small tables: against SQL where it can say it, else brute force or held-out accuracy."""

from pathlib import Path

import numpy as np
import pytest
from conftest import rows_of
from helpers import components, shingles, words

from gridloom.llm import kernels as K
from gridloom.llm import langid, neardup, paragraphs, quality, queries, suffixes


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, duck, sf, name):
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_languages(spark, docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    rows = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert sum(r.lang == got[r.doc_id].lang_pred for r in rows) >= 0.95 * len(rows)


def test_gradients():
    net = langid.Network(["a", "b", "c"])
    data = np.frombuffer(b"the quick brown fox jumps over the lazy dog " * 20, dtype=np.uint8)
    x, _ = langid.segments(data, np.array([0, len(data)]))
    y = np.arange(x.shape[1]) % 3
    _, grad = net.gradients(x, y)
    for k, g in grad.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e, losses = net.p[k][at], 1e-2, []
        for s in (1, -1):
            net.p[k][at] = old + s * e
            losses.append(net.gradients(x, y)[0])
        net.p[k][at] = old
        assert abs((losses[0] - losses[1]) / (2 * e) - g[at]) < 0.05 * abs(g[at]) + 1e-4


def test_near_duplicates(spark, docs):
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in neardup.near_duplicates(docs).collect()}
    want = components(links, sets)
    assert got == {i: (want[i], len(sets[i])) for i in sets}


def repeats(rows):
    grams = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            grams.setdefault(tuple(w[k : k + 50]), set()).add(i)
    return [v for v in grams.values() if len(v) > 1]


def test_repeated_passages(spark, docs):
    groups = repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in suffixes.repeated_passages(docs).collect()} == set().union(*groups)
    after = [(r.doc_id, r.text) for r in paragraphs.remove_repeats(docs).collect()]
    assert len(repeats(after)) <= 0.01 * len(groups)


def test_quality(spark, sf):
    """Clean documents that the model hasn't seen stay, bad ones go. At a size with some tens of documents in each language."""
    at = Path(sf).parent / "sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    seen = labels.where("pmod(xxhash64(doc_id), 2) = 0")
    rows = quality.quality(docs, seen).join(labels.join(seen, "doc_id", "left_anti"), "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1 and r.toxic == 0], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) > 0 and sum(bad) <= 0.2 * len(bad)
    for lang in ("en", "de", "fr", "es"):
        own = [r.kept for r in rows if r.quality == 1 and r.toxic == 0 and r.lang == lang]
        assert len(own) > 5 and len(own) - sum(own) <= max(2, len(own) // 10), lang  # a dozen documents or two


def kn_model(texts):
    import pyarrow as pa

    got = [c for _, c in quality.pieces(pa.array(texts))]
    code, count = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *got]), return_counts=True)
    levels = quality.levels(code, count)
    cuts = {k: quality.discounts([int((x[1] == i).sum()) for i in (1, 2, 3, 4)]) for k, x in levels.items()}
    return quality.Model(code, count, cuts, quality.low_orders(*np.unique(levels[3][0] & 0xFFFF, return_counts=True)))


def test_kneser_ney_is_a_distribution():
    m = kn_model(["abracadabra alakazam abracadabra", "été 日本語", "abra"])
    for context in (b"brac", b"zabr", b"\0\0\0a", "é été".encode()[:4], b"qqqq"):
        p = np.exp(-m.loss(int.from_bytes(context, "big") << 8 | np.arange(256)))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_quality_against_a_slow_one(spark):
    """Perplexity, threshold and verdict of each document, from dictionaries of counts; losses come in steps of 1 / 1024."""
    from pyspark.sql import functions as F

    texts = ["abracadabra alakazam abracadabra", "the cat sat on the mat", "the mat sat on the cat", "der Hund und die Katze", "und die Katze schläft", "#" * 40, "", None, "the dog sat on the mat", "abracadabra"]
    langs = ["en", "en", "en", "de", "de", "en", "de", "en", "en", None]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = [0, 1, 2, 3, 4, 9]
    fold = {r.doc_id: r.f for r in df.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("f")).collect()}
    n = quality.ORDER

    def model(own):
        counts = {n: {}}
        for t in own:
            s = [0] * (n - 1) + list(t.encode())
            for i in range(n - 1, len(s)):
                g = tuple(s[i - n + 1 : i + 1])
                counts[n][g] = counts[n].get(g, 0) + 1
        for k in range(n - 1, 0, -1):
            counts[k] = {}
            for g in counts[k + 1]:
                counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1

        def prob(g):
            if not g:
                return 1 / 256
            k = len(g)
            c = [max(1, sum(v == i for v in counts[k].values())) for i in (1, 2, 3, 4)]
            y = c[0] / (c[0] + 2 * c[1])
            d = [0.0] + [min(max(x, 0.05), float(i)) for i, x in enumerate((1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]), 1)]
            same = {h: v for h, v in counts[k].items() if h[:-1] == g[:-1]}
            if not same:
                return prob(g[1:])
            total, v = sum(same.values()), counts[k].get(g, 0)
            return max(v - d[min(v, 3)], 0) / total + sum(d[min(x, 3)] for x in same.values()) / total * prob(g[1:])

        return prob

    models = [model([texts[i] for i in trusted if fold[i] == f]) for f in (0, 1)]
    nll, size = {}, {}
    for i, t in enumerate(texts):
        s = [0] * (n - 1) + list((t or "").encode())
        size[i] = len(s) - n + 1
        nll[i] = -sum(np.log(models[1 - fold[i]](tuple(s[j - n + 1 : j + 1]))) for j in range(n - 1, len(s)))
    mean = sum(nll[i] for i in trusted) / sum(size[i] for i in trusted)
    x = {i: (nll[i] + quality.PRIOR * mean) / (size[i] + quality.PRIOR) for i in nll}
    at = lambda v, q: sorted(v)[int(np.ceil(q * len(v))) - 1]
    own = {lang: [x[i] for i in trusted if langs[i] == lang] for lang in ("en", "de")}
    spread = at([(v - np.mean(o)) * np.sqrt(len(o) / (len(o) - 1)) for o in own.values() for v in o], quality.QUANTILE)
    limit = {lang: (len(o) * at(o, quality.QUANTILE) + quality.SHRINK * (np.mean(o) + spread)) / (len(o) + quality.SHRINK) + quality.MARGIN * np.std(o, ddof=1) / np.sqrt(len(o)) for lang, o in own.items()}
    limit[None] = at([x[i] for i in trusted], quality.QUANTILE)
    got = {r.doc_id: r for r in quality.quality(df, spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality long, toxic long")).collect()}
    for i in x:
        assert abs(got[i].perplexity - np.exp(x[i])) < 1e-3 * np.exp(x[i]), i
        assert abs(got[i].threshold - np.exp(limit[langs[i]])) < 1e-3 * np.exp(limit[langs[i]]), i
        assert got[i].kept == (size[i] == 0 or got[i].perplexity <= got[i].threshold)
    assert not got[5].kept and got[6].kept and got[7].kept


def test_a_long_text_in_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["short", "longer than a piece, " * 20, None, "x"]
    whole = [np.concatenate([c for _, c in quality.pieces(pa.array([t], pa.string()))] or [np.zeros(0)]) for t in texts]
    monkeypatch.setattr(quality, "_PIECE", 16)
    got = list(quality.pieces(pa.array(texts)))
    for i, w in enumerate(whole):
        assert np.concatenate([c[r == i] for r, c in got]).tolist() == w.tolist()


def test_word_hashes():
    import pyarrow as pa

    texts = ["The cat sat", None, "", "on THE mat", "été Été", "a" * 300_000 + " b"]
    seen = {}
    for i, j, data, offsets in K.text_slices(pa.array(texts)):
        starts, ends, first = K.words(data, offsets, K.ALNUM)
        h = K.hashes(data, starts, ends)
        for k in range(i, j):
            own = slice(first[k - i], first[k - i + 1])
            want = words(texts[k])
            assert len(h[own]) == len(want)
            for w, x in zip(want, h[own].tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
