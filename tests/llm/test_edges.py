"""Each operator and stage on awkward and on empty tables: defined results, no crash."""

import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from helpers import ALNUM, CLASHES, awkward, awkward_table, components, empty_table, prose, shingles, words

from gridloom.llm.components import prefix_pairs
from gridloom.llm import decontam, fixity, langid, licences, neardup, packing, paragraphs, quality, search, suffixes

ROWS = awkward()


@pytest.fixture(scope="module")
def docs(spark):
    return awkward_table(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return empty_table(spark)


def bench(spark, rows=None):
    rows = [(1, prose(70, 1)), (2, "word"), (3, None), (4, ""), (None, prose(20, 2)), (5, prose(70, 1)), (5, prose(70, 1))] if rows is None else rows
    return spark.createDataFrame(rows, "item_id long, text string")


def test_langid(spark, docs, none):
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[3].lang_pred == by[4].lang_pred == by[5].lang_pred == "und"
    assert by[9].lang_pred in ("en", "de")
    assert langid.identify(none).count() == 0
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_licences(spark, docs, none):
    got = licences.scan(docs).collect()
    assert len(got) == len(ROWS)
    assert sorted((r.doc_id, r.n_words) for r in got if r.doc_id is not None) == sorted((x[0], len(words(x[1]))) for x in ROWS if x[0] is not None)
    r = next(r for r in got if r.doc_id == 50)
    assert (r.n_base, r.base_labels, r.score) == (2, "cc-by-nc,mit", 1.0)
    assert words(ROWS[14][1])[r.first_word :][:4] == ["under", "the", "mit", "license"] and words(ROWS[14][1])[r.last_word :][:3] == ["cc", "by", "nc"]
    quiet = next(r for r in got if r.doc_id == 3)
    assert (quiet.n_words, quiet.n_base, quiet.first_word, quiet.labels, quiet.score) == (0, 0, None, "", 0.0)
    assert licences.scan(none).count() == 0


def test_packing(spark, docs, none):
    got = packing.pack(docs, with_ids=True).collect()
    tok = packing.encoder().tokenizer
    want = Counter()
    for x in ROWS:
        want[(x[0], tuple([*tok.encode(x[1] or "", add_special_tokens=False).ids, 1]))] += 1
    by = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by.setdefault(r.doc_id, []).append(r)
    # Rows that share an id are told apart by their length only here, so totals are compared.
    for i in by:
        assert sum(r.length for r in by[i]) == sum(len(k[1]) * n for k, n in want.items() if k[0] == i)
    for seq in {r.sequence_id for r in got}:
        parts = sorted((r.offset, r.length) for r in got if r.sequence_id == seq)
        assert [o for o, _ in parts] == np.concatenate(([0], np.cumsum([n for _, n in parts])))[:-1].tolist()
        total = sum(n for _, n in parts)
        assert total == 2048 or total & (total - 1) == 0
    assert packing.pack(none).count() == 0


def test_neardup(spark, docs, none):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    named = [(x[0], shingles(x[1])) for x in ROWS if x[0] is not None]
    links = [(a, b) for a, s in named for b, t in named if s and t and 100 * len(s & t) >= 85 * len(s | t)]
    want = components(links, {a for a, _ in named})
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert neardup.near_duplicates(none).count() == 0


def test_near_copies_are_linked_exactly(spark):
    base = prose(200, 40).split()
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(k % 12):
            w[(7 * j + 13 * k) % 200] = f"x{k}y{j}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    want = components([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])], sets)
    assert got == want


def test_boilerplate_gives_no_quadratic_candidates(spark, monkeypatch):
    """Documents that share much text, but too little to link, meet in buckets; pairs that are looked at grow with their number, not its square."""
    seen = []
    possible = neardup._possible

    def counted(pairs, reps, percent):
        seen.append(pairs.count())
        return possible(pairs, reps, percent)

    monkeypatch.setattr(neardup, "_possible", counted)
    common, totals = prose(120, 50), []
    for n in (400, 800):
        rows = [(k, common + " " + prose(90, 5000 + k)) for k in range(n)] + [(n, common + " " + prose(90, 5000 + n - 1) + " end")]
        seen.clear()
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: min(i, n - 1) for i, _ in rows}
        totals.append(sum(seen))
    assert totals[1] < 2.5 * totals[0], totals  # a power of 1.3


def test_prefix_filter_misses_no_pair(spark):
    r = np.random.default_rng(5)
    base = r.integers(1, 1 << 60, 60)
    sets = {}
    for k in range(120):
        own = base[: r.integers(40, 60)].tolist() + r.integers(1, 1 << 60, r.integers(0, 14)).tolist()
        sets[k] = set(own)
    frame = spark.createDataFrame([(k, k, list(v)) for k, v in sets.items()], "id long, comp long, grams array<long>")
    got = {(x.a, x.b) for x in prefix_pairs(frame, 85).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert want and want <= got


def test_suffixes(spark, docs, none):
    got = {r.doc_id: r for r in suffixes.repeated_passages(docs).collect()}
    grams = {}
    for x in ROWS:
        w = words(x[1])
        for i in range(len(w) - 49):
            grams.setdefault(tuple(w[i : i + 50]), set()).add(x[0])
    want = {i for v in grams.values() if len(v - {None}) > 1 for i in v - {None}}
    assert set(got) == want
    assert [(s.start, s.end) for s in got[1].spans] == [(60, 130)] and got[1].partners == [2]
    assert suffixes.repeated_passages(none).count() == 0


def test_paragraphs(spark, docs, none):
    got = {r.doc_id: r for r in paragraphs.removals(docs).collect()}
    assert 2 in got and got[2].kept_in == [1] and 7 in got and 0 not in got and 1 not in got and 9 not in got
    cleaned = paragraphs.remove_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(ROWS)
    rows = cleaned.collect()
    kept = {r.doc_id: r for r in rows}
    assert kept[1].text == ROWS[1][1] and len(words(kept[2].text)) < 110 + 30 and kept[2].n_chars == len(kept[2].text)
    assert paragraphs.removals(none).count() == 0 and paragraphs.remove_repeats(none).count() == 0


def test_cuts_belong_to_rows(spark):
    a, other = prose(60, 201), prose(120, 202)
    rows = [(1, a), (2, a + "\n" + prose(20, 203)), (2, other), (2, a + "\n" + prose(20, 203)), (3, other)]
    got = [r.text for r in paragraphs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "text").collect()]
    assert sorted(got) == sorted([a, prose(20, 203), other, prose(20, 203), ""])


def test_lines_against_brute_force(spark):
    """Lines that are equal or have a 5-word Jaccard similarity of 0.8, but for what banding may miss."""
    lines, rows = [prose(int(n), 300 + k).split() for k, n in enumerate(np.random.default_rng(1).integers(3, 90, 40))], []
    r = np.random.default_rng(2)
    for k in range(200):
        w = list(lines[k % 40])
        for _ in range(r.integers(0, 3) if len(w) > 40 else k % 3 == 0):
            w[r.integers(len(w))] = f"x{k}"
        rows.append((k, " ".join(w)))
    sets = {i: shingles(t, 5, ALNUM) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = components(pairs, sets)
    want = {i for i in sets if comp[i] != i}
    got = {x.doc_id: x for x in paragraphs.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = {i for i, x in got.items() if (x.spans[0].start, x.spans[0].end) == (0, len(rows[i][1].encode()))}
    assert len(want) > 30 and len(want & whole) >= 0.95 * len(want)
    for i in whole - want:  # equal blocks may cover a whole line that isn't similar as a whole
        assert any(tuple(x) in sets[j] for j in sets if j < i for x in sets[i])


def test_similar_paragraphs(spark):
    a = prose(100, 60).split()
    b = list(a)
    b[50] = "changed"
    rows = [(1, prose(30, 61) + "\n" + " ".join(a)), (2, " ".join(b) + "\n" + prose(30, 62)), (3, prose(100, 63))]
    got = {r.doc_id: r for r in paragraphs.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2} and got[2].spans[0].start == 0 and got[2].spans[0].end >= len(" ".join(b))


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 15, 17, 19])
def test_equal_lines_of_any_length(spark, n):
    line = prose(n, 80 + n)
    rows = [(i, prose(40, 100 * n + i) + "\n" + line + "\n" + prose(40, 100 * n + 50 + i)) for i in (1, 2, 3)]
    got = {r.doc_id: r for r in paragraphs.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2, 3}
    for i, text in rows[1:]:
        (cut,) = got[i].spans
        assert text.encode()[cut.start : cut.end].decode() == line + "\n" and 1 in got[i].kept_in


def test_similar_short_lines(spark):
    a = prose(18, 91).split()
    rows = [(1, prose(40, 92) + "\n" + " ".join(a)), (2, " ".join(a[:-1] + ["changed"]) + "\n" + prose(40, 93))]
    got = {r.doc_id: r for r in paragraphs.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {2} and got[2].spans[0].start == 0


def brute_contamination(docs, items, window=13):
    pats = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        k = min(window, len(w))
        for j in range(len(w) - k + 1):
            pats.setdefault(tuple(w[j : j + k]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for p, own in pats.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j : j + len(p)]) == p:
                    hit.update(range(j, j + len(p)))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [20_000, 7])
def test_decontamination(spark, docs, none, block):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench(spark).collect()]
    small = [(d, t) for d, t in rows if t is None or len(t) < 50_000]
    got = decontam.contamination(docs, bench(spark), block=block).collect()
    assert len(got) == len(rows)
    mine = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got if r.doc_id != 9), key=repr)
    assert mine == brute_contamination(small, items)
    for r in got:
        for s in r.spans:
            raws = [(t or "").encode()[s.start : s.end] for d, t in rows if d == r.doc_id]
            assert any(words(x.decode()) and x.strip() == x for x in raws)
    assert decontam.contamination(none, bench(spark)).count() == 0
    assert {r.n_hit for r in decontam.contamination(docs, bench(spark, []), block=block).collect()} == {0}


@pytest.mark.parametrize("block", [20_000, 3])
def test_decontaminated_texts(spark, docs, block):
    items = [(1, prose(20, 70))]
    rows = [(1, prose(600, 71) + " " + items[0][1] + ". " + prose(600, 72)), (2, items[0][1]), (3, prose(50, 73)), (None, prose(20, 70))]
    got = {r.doc_id: r.text for r in decontam.clean(spark.createDataFrame(rows, "doc_id long, text string"), bench(spark, items), block=block).collect()}
    assert set(got) == {1, 3} and got[3] == rows[2][1]  # a null id is no reason to keep a contaminated text
    assert len(words(got[1])) == 1200 and items[0][1] not in got[1]


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 0, 0), (8, 1, None), (None, 1, 0), (9, 1, 1)], "doc_id long, quality long, toxic long")
    got = quality.quality(docs, labels).collect()
    assert len(got) == len(ROWS) and all(r.perplexity > 0 for r in got)
    assert {r.doc_id for r in quality.trusted_ids(labels).collect()} == {0, 1, 8}
    by = {r.doc_id: r for r in got}
    assert by[3].kept and by[4].kept and by[100].threshold is not None
    none_left = quality.quality(docs, labels.where("doc_id > 1000")).collect()
    assert all(r.kept for r in none_left)
    out = quality.accepted(docs, labels)
    assert out.columns == docs.columns
    assert quality.quality(none, labels).count() == 0


def test_quality_of_small_languages(spark):
    def text(letters, k):
        r = np.random.default_rng(len(letters))
        vocabulary = ["".join(r.choice(list(letters), r.integers(3, 8))) for _ in range(60)]
        return " ".join(np.random.default_rng(k).choice(vocabulary, 120))

    rows = [(k, prose(120, 1000 + k), "en") for k in range(300)] + [(1000 + k, text("qxzjvwkyfgh", k), "small") for k in range(40)]
    rows += [(2000 + k, text("bcdfpqxzjv", 100 + k), "none") for k in range(20)] + [(3000, "#&%$@ " * 100, "small"), (3001, None, "small")]
    labels = [(i, 1, 0) for i, _, lang in rows if (lang == "en" or lang == "small" and i < 1010)]
    got = quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality long, toxic long")).collect()
    kept = {lang: [r.kept for r in got if r.lang == lang and r.doc_id < 3000] for lang in ("en", "small", "none")}
    assert {k: sum(v) >= 0.9 * len(v) for k, v in kept.items()} == dict.fromkeys(kept, True)
    by = {r.doc_id: r for r in got}
    assert not by[3000].kept and by[3001].kept and len({by[i].threshold for i in (0, 1000, 2000)}) == 3


def test_fixity(spark, none):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (5, None, None), (5, "v", "x" * 200_000), (7, "w", "gone"), (102, "y", ""), (None, "n", "n"), (102, "z", "~tilde")]
    got = fixity.audit_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.status) for r in got) == [(5, "altered"), (7, "missing"), (102, "altered")]
    assert fixity.audit_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    kind = "file string, offset long, length long, page_id long, digest string"
    a = spark.createDataFrame([("f", 0, 5, 1, "x"), ("f", 5, 5, 2, "y"), ("g", 0, 1, 3, "z"), ("g", 0, 1, 3, "z")], kind)
    b = spark.createDataFrame([("f", 0, 5, 1, "x"), ("f", 5, 5, 2, "Y"), ("g", 0, 1, 3, "z"), ("h", 900_000, 1, 4, "new")], kind)
    assert sorted((r.file, r.status) for r in fixity.audit(a, b).collect()) == [("f", "altered"), ("g", "altered"), ("h", "surplus")]
    assert fixity.audit(a, a).count() == 0


def test_search(spark, docs, none):
    queries = docs.where("doc_id % 50 = 0")
    got = search.top_k(docs, queries, k=3).collect()
    rows = [(x[0], words(x[1])) for x in ROWS if x[0] is not None]
    n, mean = len(rows), sum(len(w) for _, w in rows) / len(rows)
    df = Counter(t for _, w in rows for t in set(w))
    want = []
    for q in (0, 50, 100):
        terms = {t for i, w in rows if i == q for t in w}
        scores = []
        for i, w in rows:
            tf = Counter(w)
            s = sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms if tf[t])
            if s > 0:
                scores.append((-round(s, 6), i))
        want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:3], 1)]
    assert sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in got) == sorted((q, k, i, round(s, 5)) for q, k, i, s in want)
    assert search.top_k(none, none).count() == 0 and search.top_k(docs, none).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, docs, none, sf, stage):
    name, f = corpus_pipeline.STAGES[stage]
    out, empty = f(spark, docs, sf), f(spark, none, sf)
    assert empty.count() == 0
    if stage < 4:
        assert out.columns == docs.columns
        assert {tuple(r[c] for c in CLASHES) for r in out.collect()} == {("x",) * len(CLASHES)}


def test_near_duplicate_stage_keeps_one_row(spark, docs, sf):
    got = Counter(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect())
    assert got[0] == 1 and 7 not in got and got[8] == 1 and got[None] == 2 and got[9] == 1
