"""Brute-force versions and awkward tables."""

import re

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, pattern=ALNUM):
    return pattern.findall((text or "").translate(LOW))


def shingles(text, k=3, pattern=SPACED):
    w = words(text, pattern)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(links, ids):
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


VOCAB = [a + b + c for a in ("ba", "de", "ki", "lo", "mu", "re", "so", "ti", "va", "zu") for b in ("n", "r", "l", "s") for c in ("a", "e", "o", "ik", "ud")]


def prose(n, seed):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


#: Columns beyond those of documents, with the names that operators use inside.
CLASHES = ["id", "rows", "kept", "spans", "key", "rep", "w", "th", "threshold", "perplexity", "hit_id", "contaminated", "component", "score", "shard", "tid", "row", "doc"]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def awkward():
    """Null and empty texts and ids, rows that repeat, ids that repeat with another text, ties, signs only, one word, a very long text."""
    passage = prose(70, 1)
    texts = [
        (0, prose(120, 2), "en"),
        (1, prose(60, 3) + " " + passage + " " + prose(40, 4), "en"),
        (2, prose(30, 5) + " " + passage + " " + prose(80, 6), "de"),
        (3, None, "en"),
        (4, "", None),
        (5, "!!! ... ???", "de"),
        (6, "word", "en"),
        (7, prose(120, 2), None),
        (7, prose(120, 2), None),
        (8, prose(90, 7), "de"),
        (8, prose(90, 8), "de"),
        (None, prose(50, 9), "en"),
        (None, None, None),
        (9, prose(30_000, 10), "en"),
        (50, "Für ÉTÉ naïve İstanbul 日本語 <|endoftext|> under the MIT License, and CC BY-NC 4.0.\x1c x", "de"),
        (100, " ".join(["same"] * 300), "en"),
        (101, " ".join(["same"] * 400), "en"),
    ]
    return [(i, t, lang, "src0", None if t is None else len(t), *["x"] * len(CLASHES)) for i, t, lang in texts]


def awkward_table(spark):
    return spark.createDataFrame(awkward(), COLUMNS)


def empty_table(spark):
    return spark.createDataFrame([], COLUMNS)
