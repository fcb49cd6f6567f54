import random
from collections import Counter

import numpy as np
from helpers import words

from gridloom.llm import search


def texts():
    """Documents of two vocabularies with frequent and rare words, copies among them, and three without words."""
    r = random.Random(4)
    out = []
    for i in range(400):
        stem = "xq"[i % 3 == 0]
        n = r.choice((5, 40, 150, 400))
        out.append(" ".join(f"{stem}{int(600 * r.random() ** 3)}" for _ in range(n)))
    return [*out[:390], out[3], out[3], out[40], out[40], out[7], *out[390:], "", None, "..."]


def best(rows, wanted, k):
    bags = [(i, Counter(words(t))) for i, t in rows]
    mean = sum(sum(b.values()) for _, b in bags) / len(bags)
    df = Counter(t for _, b in bags for t in b)
    idf = {t: np.log(1 + (len(bags) - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    out = {}
    for q, own in bags:
        if q % wanted == 0:
            scored = []
            for i, b in bags:
                norm = 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)
                s = sum(idf[t] * b[t] * 2.2 / (b[t] + norm) for t in own if t in b)
                if s > 0:
                    scored.append((-round(s, 6), i))
            out[q] = sorted(scored)[:k]
    return out


def test_shards_and_blocks_of_queries(spark, monkeypatch):
    """Many shards and blocks of queries give what one comparison of all pairs gives, and a task returns k rows a query, not k for each of its shards."""
    rows, k, written = list(enumerate(texts())), 5, []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = docs.where("doc_id % 4 = 0")
    make = search.materialise

    def watched(df, name="t"):
        out = make(df, name)
        if name == "found":
            written.append((out.count(), df.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(search, "materialise", watched)
    monkeypatch.setattr(search, "QUERIES", 60)
    got: dict[int, list] = {}
    for r in sorted(search.top_k(docs, queries, k=k, shard_bytes=4000).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = {q: x for q, x in best(rows, 4, k).items() if x}
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(abs(s + w) < 2e-6 for q in want for (_, s), (w, _) in zip(got[q], want[q], strict=True))
    assert len(written) > 1
    for count, partitions in written:
        assert count <= k * 60 * partitions
