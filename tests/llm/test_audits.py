"""Source divergence, Merkle manifest and streaming exact dedup, against brute force in plain Python."""

import collections
import glob
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.llm import divergence, exact_dedup, merkle, registry
from tests.llm.cases import documents, nothing, repeated
from tests.test_oracles import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_merkle_manifest", "op13_exact_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = registry.queries()[name](spark, SF), con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert table(got.columns, [tuple(r) for r in got.collect()]) == table(names, want.fetchall())


# ---------------------------------------------------------------- divergence


def low(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def brute_audit(docs, least=3, top=200):
    docs = [tuple(x or "" for x in d) for d in docs]  # lang, source, text
    out = []
    for lang in {d[0] for d in docs}:
        terms = [(s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t))) for g, s, t in docs if g == lang]
        df = collections.Counter(t for _, ts in terms for t in set(ts))
        kept = [t for t in df if df[t] >= least]
        n = collections.Counter((s, t) for s, ts in terms for t in ts)
        whole = collections.Counter(t for _, ts in terms for t in ts)
        sources = sorted({s for s, _ in terms})
        share = lambda c, size: 1 + 10**9 * (c + 1) // (size + len(kept))
        size = {s: sum(n[s, t] for t in kept) for s in sources}
        p = {s: {t: share(n[s, t], size[s]) for t in kept} for s in sources}
        q = {t: share(whole[t], sum(whole[u] for u in kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pair = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if n[s, t] and p[s][t] > q[t]]
            for part, of in (("pair", pair), ("term", term)):
                of.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, i + 1) for i, (t, v) in enumerate(of) if part == "pair" or i < top]
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(3)
    words = ["the", "The", "é", "ÉTÉ", "été", "世界", "a1b", "x-y", "K", "rare", "é9é", "İ", "_", "[", "z"]
    docs = [(rng.choice([None, "", "en", "de"]), rng.choice([None, "", "s", "S", "t", "é"]), rng.choice([None, "", " 12 ", *[" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(20)]])) for _ in range(150)]
    docs += [("en", "hot", "the the rare")] * 60 + [("xx", "one", "alone"), ("yy", "a", None), ("yy", "b", "once")]
    df = spark.createDataFrame(docs, "lang string, source string, text string").withColumns({"term": F.lit(1), "n": F.lit(2), "of": F.lit(3), "rank": F.lit(4)})
    want = brute_audit(docs)
    assert sorted(map(tuple, divergence.audit(df).collect())) == want
    assert ("yy", "a", "pair", "b", 0, 1) in want
    assert sorted(map(tuple, divergence.audit(df, least=1, top=2).collect())) == brute_audit(docs, 1, 2)


def test_divergence_cases(spark, monkeypatch):
    for many in (200_000, 5):
        monkeypatch.setattr(divergence, "ENTRIES", many)
        monkeypatch.setattr(divergence, "BLOCK", 2 if many == 5 else 128)
        for df in (documents(spark), repeated(spark)):
            assert sorted(map(tuple, divergence.audit(df).collect())) == brute_audit([(r.lang, r.source, r.text) for r in df.collect()])
    assert divergence.audit(nothing(spark)).count() == 0


def test_shares_are_exact():
    n, whole = [0, 7, 10**15, 8 * 10**15], [[9], [7 * 10**9 + 3], [10**15 + 1], [9 * 10**15]]
    got = divergence._shares(np.array(n)[:, None], np.array(whole))
    assert got[:, 0].tolist() == [1 + 10**9 * (a + 1) // b for a, (b,) in zip(n, whole, strict=True)]


# -------------------------------------------------------------------- merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(docs):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, text: digest(*map(field, (*d[:4], text)))
    groups = collections.defaultdict(list)
    for d in docs:
        hit = d[4] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
        groups[d[2]].append((d[0] is not None, d[0] or 0, leaf(d, d[4]), leaf(d, low(d[4])) if hit else None))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def sides(levels, i):
        for level in levels[:-1]:
            yield "".join(level[i - i % 8 : i]), "".join(level[i + 1 : i - i % 8 + 8])
            i //= 8

    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    crown = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, (there, doc_id, mine, other) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = [*sides(trees[g], i), *sides(crown, k)]
            now = other or mine
            for a, b in way:
                now = digest(a, now, b)
            root = crown[-1][0]
            out.append((doc_id if there else None, mine, trees[g][-1][0], root, digest(*(a + b for a, b in way)), now, now == root))
    return sorted(out, key=str)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(df):
    return sorted(map(tuple, merkle.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_manifest(spark):
    rng = random.Random(4)
    ids = [-(2**63), -5, -1, 2**63 - 1, 2**40, *range(900), *(rng.randrange(2**62) for _ in range(100))]
    docs = [(d, rng.choice([None, "", "s"]), rng.choice(["en"] * 9 + ["de", "", None]), rng.choice([None, 3]), rng.choice([None, "", "Text É", "lower"]) if i % 7 else f"T{i}") for i, d in enumerate(ids)]
    assert manifest_rows(spark.createDataFrame(docs, FIELDS).repartition(5)) == brute_manifest(docs)
    many = [(i, "s", f"l{i % 70}", i, "A") for i in range(200)]  # a crown of three levels
    assert manifest_rows(spark.createDataFrame(many, FIELDS)) == brute_manifest(many)
    for n in (1, 8, 9):
        some = [(i, "s", "en", i, "A") for i in range(n)]
        assert manifest_rows(spark.createDataFrame(some, FIELDS)) == brute_manifest(some)


def test_manifest_cases(spark):
    for df in (documents(spark), repeated(spark)):
        assert manifest_rows(df) == brute_manifest([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()])
    assert merkle.manifest(nothing(spark)).count() == 0


def test_ranks_of_rows_without_ids(spark):
    """Buckets with more rows than ids are counted by digits of the leaf."""
    docs = [(None if i % 2 else 7, None, "en", i, "x") for i in range(300)] + [(i, None, "en", i, "x") for i in range(40)]
    hashed = merkle.leaves(spark.createDataFrame(docs, FIELDS))
    got = merkle.ranks(hashed, most=20).collect()
    assert [r.idx for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, bytes(r.leaf)))] == list(range(340))
    assert {r["size"] for r in got} == {340}


# --------------------------------------------------------------- exact dedup


def brute_exact(docs):
    groups = collections.defaultdict(list)
    for i, (d, text) in enumerate(docs):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), d is None, d or 0, i, d))
    out = []
    for text, of in groups.items():
        best = min(of)
        out += [(x[4], best[4], len(of), x is best, hashlib.sha256(text.encode()).hexdigest()) for x in of]
    return sorted(out, key=str)


def written(df, at):
    df.coalesce(1).write.mode("append").parquet(str(at))
    return str(at)


def exact_rows(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_exact_dedup(spark, tmp_path):
    rng = random.Random(6)
    docs = [(i, rng.choice([None, "", " ", "a b", "ab", " ab\n", "é 世", "é世", " ab", "A b", *[f"text {j} é" + " " * rng.randint(0, 3) for j in range(40)]])) for i in range(300)]
    docs += [(1000 + i, "the same words" if i % 3 else "the  same words") for i in range(400)]  # more than a third
    at = written(spark.createDataFrame(docs, "doc_id long, text string"), tmp_path / "d")
    want = brute_exact(docs)
    assert exact_rows(exact_dedup.dedup(spark, at)) == want
    for width in (0, 1):  # narrow digests: other texts meet, and whole bytes tell them apart
        assert exact_rows(exact_dedup.dedup(spark, at, width=width)) == want


def test_exact_dedup_goes_on(spark, tmp_path):
    """Files that come later meet the state of earlier runs; several files are several micro-batches."""
    parts = [[(i, f"x {i % 5}") for i in range(k * 20, k * 20 + 20)] + [(100 + k, f"x   {k}"), (200 + k, None)] for k in range(3)]
    at, home = tmp_path / "d", f"file://{tmp_path}/home"
    for k in range(2):
        written(spark.createDataFrame(parts[k], "doc_id long, text string"), at)
    assert exact_rows(exact_dedup.dedup(spark, str(at), home=home, files=1)) == brute_exact(parts[0] + parts[1])
    written(spark.createDataFrame(parts[2], "doc_id long, text string"), at)
    assert exact_rows(exact_dedup.dedup(spark, str(at), home=home, files=1)) == brute_exact(sum(parts, []))
    assert exact_rows(exact_dedup.dedup(spark, str(at), home=home, files=1)) == brute_exact(sum(parts, []))  # nothing new


def test_exact_dedup_cases(spark, tmp_path):
    for k, df in enumerate((documents(spark), repeated(spark))):
        at = written(df, tmp_path / f"c{k}")
        assert exact_rows(exact_dedup.dedup(spark, at)) == brute_exact([(r.doc_id, r.text) for r in spark.read.parquet(at).collect()])
    assert exact_dedup.dedup(spark, written(nothing(spark), tmp_path / "none")).count() == 0


def test_lost_content_is_told(spark, tmp_path):
    at = written(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"), tmp_path / "d")
    docs = spark.read.schema("doc_id long, text string").parquet(at)
    gone = exact_dedup.keyed(exact_dedup.fingerprints(docs), 32).withColumn("at", F.struct(F.lit("elsewhere").alias("file"), F.lit(0).alias("row"), F.lit(1).alias("doc_id")))
    with pytest.raises(Exception, match="locator"):
        exact_dedup.differing(docs, gone).collect()
