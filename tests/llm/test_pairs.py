"""Operators on pairs and windows, against brute force."""

import collections
import hashlib
import re
import string

import numpy as np
import pytest

from scoreloom.llm import decontaminate, line_dedup, ngram_join
from tests.llm.cases import documents, nothing, prose, repeated, rows


def components(sets, linked):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def test_jaccard_join(spark):
    got = {r.doc_id: r for r in ngram_join.near_duplicates(documents(spark)).collect()}
    sets = {r[0]: shingle_set(r[1]) for r in rows()}
    want = components(sets, jaccard_linked)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def family(n):
    """A chain of edits: neighbours link, ends do not; and variants of one text, each with other edits."""
    base = prose(200, 9).split()
    out, text = [], list(base)
    for i in range(n):
        text = list(text)
        text[(i * 7) % 200] = f"edit{i}"
        out.append(" ".join(text))
    for i in range(n):
        v = list(base)
        for k in range(5):
            v[(i * 13 + k * 37) % 200] = f"v{i}x{k}"
        out.append(" ".join(v))
    return out


@pytest.mark.parametrize("block", [7, 2000])
def test_jaccard_families_in_cut_blocks(spark, block):
    texts = family(25)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs, block=block).collect()}
    assert got == components({i: shingle_set(t) for i, t in enumerate(texts)}, jaccard_linked)


@pytest.mark.parametrize("block", [7, 2000])
def test_jaccard_links(spark, block):
    texts = family(25)
    texts += [texts[30].upper(), texts[30], texts[0], "one two", "One  two", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs, block=block).collect()}
    sets = {t: shingle_set(t) for t in texts}
    want = {t: sum(u != t and jaccard_linked(sets[t], s) for u, s in sets.items()) for t in sets}
    assert got == {i: want[t] for i, t in enumerate(texts)}
    assert max(want.values()) > 25


def test_t_occurrence_finds_every_link():
    rng = np.random.default_rng(2)
    core = [rng.integers(0, 1 << 40, 60) for _ in range(4)]
    sets = [np.unique(np.r_[rng.choice(core[i % 4], 56, replace=False), rng.integers(0, 1 << 40, rng.integers(0, 12))]).astype(np.uint64) for i in range(160)]
    df = collections.Counter(x for s in sets for x in s.tolist())
    ordered = [s[np.lexsort((s, [df[x] for x in s.tolist()]))] for s in sets]
    size = np.array([len(s) for s in sets])
    short = size - -(-75 * size // 100) + 1
    py = [set(s.tolist()) for s in sets]
    for side in (np.zeros(160, int), rng.integers(0, 2, 160)):
        links = ngram_join.t_occurrence(ordered, short, size, side)
        pairs = {(min(a, b), max(a, b)) for a, b in links.tolist()}
        across = bool(side.any())
        assert len(pairs) == len(links) > 160
        assert pairs == {(a, b) for a in range(160) for b in range(a + 1, 160) if jaccard_linked(py[a], py[b]) and (not across or side[a] != side[b])}


@pytest.mark.parametrize("n", range(7))
def test_jaccard_of_few_words(spark, n):
    d = spark.createDataFrame([(1, " ".join("abcdefg"[:n])), (2, " ".join("ABCDEFG"[:n]))], "doc_id long, text string").coalesce(1)
    assert {r.component_id for r in ngram_join.near_duplicates(d).collect()} == ({1} if n else {1, 2})
    data = np.frombuffer(" ".join("abcdefg"[:n]).encode(), np.uint8)
    assert ngram_join.shingle_sets(data, np.array([0, len(data)]))[1].tolist() == [max(min(n, 1), n - 4)]


def test_jaccard_rows(spark):
    assert ngram_join.near_duplicates(nothing(spark)).count() == 0
    d = repeated(spark)
    assert ngram_join.near_duplicates(d).count() == d.count()
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns
    texts = [r.text for r in kept.where("doc_id between 6 and 10").collect()]
    assert len(texts) == len(set(texts))


def test_t_occurrence_equals_all_pairs():
    rng = np.random.default_rng(1)
    sets, sizes = [], []
    core = rng.integers(0, 1 << 40, 60)
    for _ in range(80):
        s = np.unique(np.r_[rng.choice(core, 50, replace=False), rng.integers(0, 1 << 40, rng.integers(0, 25))]).astype(np.uint64)
        sets.append(s)
        sizes.append(len(s))
    df = collections.Counter(x for s in sets for x in s.tolist())
    ordered = [s[np.lexsort((s, [df[x] for x in s.tolist()]))] for s in sets]
    short = np.array([len(s) - -(-75 * len(s) // 100) + 1 for s in sets])
    links = ngram_join.t_occurrence(ordered, short, np.array(sizes), np.zeros(80, int))
    up = list(range(80))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    py = [set(s.tolist()) for s in sets]
    assert {i: find(i) for i in range(80)} == components(dict(enumerate(py)), jaccard_linked)


# ------------------------------------------------------------------- windows

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute_hits(docs, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s : s + k])].add(str(i))
    out = []
    for i, t in docs:
        w = split(t)
        hit, found = set(), set()
        for win, ids in windows.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found |= ids
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, prose(40, 9)), (2, prose(12, 10)), (3, "two words"), (4, "Zebra"), (5, None), (6, ""), (7, prose(12, 10)), (10, "É one É two É three É four É five É six")]


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_decontamination(spark, limit):
    planted = [(100, "x " + prose(40, 9).upper() + " y"), (101, " ".join(prose(40, 9).split()[:9])), (102, " ".join(prose(40, 9).split()[5:16]) + " z " + prose(12, 10)), (103, "ZEBRA zebra"), (104, ITEMS[-1][1]), (105, ITEMS[-1][1].lower())]
    docs = [(r[0], r[1]) for r in rows() if r[0] not in (10, 16)] + planted
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.contamination(d, items, broadcast_rows=limit).drop("th")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_hits(docs, ITEMS)
    clean = {r.doc_id for r in decontaminate.clean(d, items, broadcast_rows=limit).collect()}
    assert clean == {r[0] for r in brute_hits(docs, ITEMS) if not r[-1]}


def test_decontamination_uses_no_python(spark, monkeypatch):
    plans, real = [], decontaminate.C.materialize
    monkeypatch.setattr(decontaminate.C, "materialize", lambda df, label: plans.append(df) or real(df, label))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    plans.append(decontaminate.contamination(documents(spark), items))
    plans.append(decontaminate.clean(documents(spark), items))
    assert len(plans) > 3
    for p in plans:
        text = p._jdf.queryExecution().executedPlan().toString()
        assert not any(x in text for x in ("Python", "Arrow", "Pandas", "MapPartitions"))


def test_decontamination_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(nothing(spark), items).count() == 0
    d = repeated(spark)
    assert decontaminate.contamination(d, items).count() == d.count()
    assert decontaminate.clean(d, items).columns == d.columns
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(documents(spark), none).where("contaminated").count() == 0


# --------------------------------------------------------------------- lines


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def variants():
    import random

    rng, out = random.Random(3), []
    for _ in range(40):
        b = "".join(rng.choice("abcd é世") for _ in range(rng.randint(20, 45)))
        out.append(b)
        for _ in range(rng.randint(0, 5)):
            c = list(b)
            for _ in range(rng.randint(1, 4)):
                k, o = rng.randrange(len(c)), rng.randint(0, 2)
                if o == 0:
                    c.insert(k, rng.choice("abcd"))
                elif o == 1:
                    c.pop(k)
                else:
                    c[k] = rng.choice("abcd")
            out.append("".join(c))
    return sorted({x for x in out if len(x) >= 20 and x.strip()})


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_near_pairs(tau):
    t = variants()
    i, j = line_dedup.near_pairs(t, np.zeros(len(t), int), tau)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(x, y) for x in range(len(t)) for y in range(x + 1, len(t)) if edits(t[x], t[y]) <= tau}


def brute_lines(docs, tau=2, least=20):
    occ = collections.defaultdict(set)
    for i, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\r\v\f"):
                occ[line].add((i, n))
    names = sorted(occ)
    near = [x for x in names if least <= len(x) < 5000]
    degree = collections.Counter()

    def linked(a, b):
        return abs(len(a) - len(b)) <= tau and edits(a, b) <= tau

    pairs = [(a, b) for k, a in enumerate(near) for b in near[k + 1 :] if linked(a, b)]
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    roots = components({x: x for x in names}, lambda a, b: (a, b) in set(pairs))
    cls = collections.defaultdict(set)
    for line, at in occ.items():
        cls[roots[line]] |= at
    dropped, links, n_lines = collections.defaultdict(list), collections.Counter(), collections.Counter()
    for at in cls.values():
        for i, n in sorted(at)[1:]:
            dropped[i].append(n)
    for line, at in occ.items():
        for i, _ in at:
            links[i] += degree[line]
            n_lines[i] += 1
    return dropped, links, n_lines


@pytest.mark.parametrize("block", [5, 2000])
def test_line_dedup(spark, block):
    v = variants()[:60]
    docs = [(i, "\n".join(v[i * 6 : i * 6 + 6] + ["short", "", prose(30, 40 + i % 3)])) for i in range(10)] + [(50, None), (51, ""), (52, "\n \n"), (53, v[0]), (54, v[0] + "\nfresh line of words that stands alone")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_report(d, block=block).collect()}
    dropped, links, n_lines = brute_lines(docs)
    assert {i: r.dropped for i, r in got.items()} == {i: sorted(dropped[i]) for i, _ in docs}
    assert {i: r.n_links for i, r in got.items()} == {i: links[i] for i, _ in docs}
    assert {i: r.n_lines for i, r in got.items()} == {i: n_lines[i] for i, _ in docs}
    kept = {r.doc_id: r.text for r in line_dedup.drop_lines(d, block=block).collect()}
    assert 53 not in kept and kept[50] is None and kept[51] == "" and kept[52] == "\n \n"
    assert kept[54] == "fresh line of words that stands alone"
    assert kept[0] == docs[0][1] or dropped[0]


def test_line_rows(spark):
    assert line_dedup.dedup_report(nothing(spark)).count() == 0
    assert line_dedup.drop_lines(nothing(spark)).count() == 0
    d = repeated(spark)
    out = line_dedup.drop_lines(d)
    assert out.columns == d.columns and out.schema == d.schema
    assert out.where("doc_id = 10").count() == 1


def _packed_runs(bucket, buckets, n, runs, rng):
    """Packed runs of one bucket, as tasks post them, and their postings (token, set, size)."""
    lo, hi = (bucket * (1 << 48) // buckets, (bucket + 1) * (1 << 48) // buckets)
    packed, rows = [], []
    for k in range(runs):
        m = n if k else 700  # a short run reads by fewer ranges
        tok = np.sort(rng.integers(lo, min(lo + 3 * n, hi) if k % 2 else hi, m).astype(np.uint64))
        who, size = rng.integers(0, 50, m), rng.integers(5, 90, 50).astype(np.int32)
        fp = rng.integers(-(2**62), 2**62, 50)
        held, at = np.unique(who, return_inverse=True)
        gap = np.diff(tok, prepend=tok[:1])
        wide = bool(gap.max() >> np.uint64(32))
        marks = np.searchsorted(tok, ngram_join._bounds(bucket, buckets, ngram_join._marks(m)))
        head = np.array([len(held), m, wide], np.int64).tobytes() + tok[np.minimum(marks, m - 1)].tobytes() + marks.astype(np.int64).tobytes() + fp[held].tobytes() + size[held].tobytes() + at.astype(np.uint16).tobytes()
        packed.append((head, tok.tobytes() if wide else gap.astype(np.uint32).tobytes()))
        rows += zip(tok.tolist(), fp[who].tolist(), size[who].tolist(), strict=True)
    return packed, set(rows)


@pytest.mark.parametrize("most", [1, 4000, 10**9])
@pytest.mark.parametrize(("bucket", "buckets"), [(0, 64), (63, 64), (5, 211)])
def test_runs_are_read_by_ranges(most, bucket, buckets):
    packed, rows = _packed_runs(bucket, buckets, 6000, 5, np.random.default_rng(bucket))
    got = [tuple(x) for part in ngram_join._repeated(packed, bucket, buckets, most) for x in zip(*(c.tolist() for c in part), strict=True)]
    n = collections.Counter(t for t, _, _ in rows)
    assert sorted(got) == sorted((*r, n[r[0]]) for r in rows if n[r[0]] > 1)


def test_reading_by_ranges_is_linear():
    """Each posting is unpacked once, however many ranges a bucket has."""
    packed, rows = _packed_runs(7, 64, 20_000, 4, np.random.default_rng(1))
    bounds = ngram_join._bounds(7, 64, ngram_join.RANGES)
    runs = [ngram_join._Run(*r) for r in packed[1:]]
    assert sum(len(r.read(i, i + 1, bounds)[0]) for r in runs for i in range(ngram_join.RANGES)) == sum(r.n for r in runs) == 60_000
    assert all((r.counts() == [len(r.read(i, i + 1, bounds)[0]) for i in range(ngram_join.RANGES)]).all() for r in runs)
