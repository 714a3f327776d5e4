"""Operators on single documents and conversations, against the libraries and brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scoreloom.llm import chat, cotraining, licenses, packing, quality_rules, repair, token_counts
from scoreloom.llm.tokens import MARK, PIECE, UNSAFE, WordEncoder, pieces
from tests.llm.cases import documents, nothing, prose, repeated, rows

ODD = ["", "'", "it's", "''s 're", "!'s", "  a  b \n\n c\t", "x<|endoftext|>y <|endoftext|>", "İstanbul ẞ ſ µ", "é Å", "\x1c\x85\xa0", "世界 ١٢ ½ 😀", "DON'T I'LL", "a" * 3000]


def hostile(n, seed):
    rng = random.Random(seed)
    al = "ab's\t\n 're'll'd !?12é中ñ　\x1c\x85́😀 <|endoftext|> DON'T"
    return ["".join(rng.choice(al) for _ in range(rng.randint(1, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def word_ids():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_word_encoder(word_ids):
    enc = WordEncoder.of("word_bpe_49k.json")
    for x in [*ODD, *hostile(3000, 1), *(r[1] for r in rows())]:
        assert enc.encode(x).tolist() == word_ids(x)


def test_new_words_go_to_the_model_alone(word_ids, monkeypatch):
    """No new word of a safe text takes the library's normalizer and splitter again; other texts take them once, whole."""

    class Counting:
        def __init__(self, inner):
            self.inner, self.whole = inner, []

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode(self, text, **more):
            self.whole.append(text)
            return self.inner.encode(text, **more)

        @classmethod
        def from_file(cls, path):
            return cls(Tokenizer.from_file(path))

    monkeypatch.setattr("tokenizers.Tokenizer", Counting)
    enc = WordEncoder("word_bpe_49k.json")
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZßäéñøœžŽÆªº"
    new = [" ".join("".join(rng.choices(letters, k=rng.randint(1, 90))) + rng.choice(["", "'s", "½", "–!", "‘’“”…€", "7"]) for _ in range(40)) for _ in range(100)]
    every = "".join(map(chr, range(0x21, 0x180)))
    for x in [*new, *every, *(c + "a" for c in every)]:
        if not UNSAFE.search(x):
            assert enc.encode(x).tolist() == word_ids(x)
    assert enc.tokenizer.whole == []
    assert enc.encode("new wörds 世界").tolist() == word_ids("new wörds 世界")
    assert enc.tokenizer.whole == ["new wörds 世界"]


def test_pieces_by_kinds_are_the_patterns():
    rng = random.Random(6)
    al = [*"ab'sStTdDmM rRlLvVeE!?,.12½²ªºµßéÉÀ×÷Þþÿ\xa0\xad \t\n\r\x0b\x0c", "'", "'", "'s", "'re", "'LL", "''", "’", "œ", "–", "<|", MARK, "\x85", "K"]
    for x in [*ODD, *hostile(2000, 7), *map(chr, range(1, 0x2200)), *("".join(rng.choices(al[: rng.choice([-6, None])], k=rng.randint(1, 14))) for _ in range(20_000))]:
        got, safe = pieces(x), not UNSAFE.search(x)
        assert (got is not None) == safe, x
        assert not safe or [p.replace(MARK, "'") for p in got] == PIECE.findall(x.lower()), x


def test_token_counts(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    c = token_counts.Counter.of("byte_bpe_50k.json")
    xs = [*ODD, *hostile(3000, 2)]
    assert c.texts(xs).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in xs]
    got = {r.doc_id: tuple(r)[1:] for r in token_counts.count_tokens(documents(spark)).collect()}
    for i, text, *_ in rows():
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 1024)
    assert token_counts.count_tokens(nothing(spark)).count() == 0
    assert token_counts.count_tokens(repeated(spark)).count() == len(rows()) + 4


def test_scan_composes_like_reading_on():
    rng = np.random.default_rng(0)
    kinds = rng.integers(0, 9, 10_000).astype(np.uint8)
    state, want = 0, []
    for k in kinds.tolist():
        want.append(bool(token_counts.OUT[state << 4 | k]))
        state = int(token_counts.TO[state << 4 | k])
    for chunk in (1, 7, 1024, 20_000):
        assert token_counts.marks(kinds, chunk).tolist() == want


# ------------------------------------------------------------------- packing


def best(lengths, size):
    """Fewest bins, by search over all packings."""
    lengths = sorted(lengths, reverse=True)
    top = [len(lengths)]

    def go(i, bins):
        if len(bins) >= top[0]:
            return
        if i == len(lengths):
            top[0] = len(bins)
            return
        for k in sorted({b: j for j, b in enumerate(bins) if b >= lengths[i]}.values()):
            go(i + 1, [*bins[:k], bins[k] - lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, size - lengths[i]])

    go(0, [])
    return top[0]


def test_packing_is_optimal_on_small_cases():
    rng = random.Random(4)
    for _ in range(150):
        lengths = [rng.randint(5, 60) for _ in range(rng.randint(1, 11))]
        got = packing.solve(collections.Counter(lengths), 100)
        assert sum((collections.Counter({k: n * c for k, c in collections.Counter(p).items()}) for n, p in got), collections.Counter()) == collections.Counter(lengths)
        assert all(sum(p) <= 100 for _, p in got)
        assert sum(n for n, _ in got) == best(lengths, 100)


def test_lower_bound_is_below_the_optimum():
    rng = random.Random(7)
    met = 0
    for _ in range(150):
        lengths = [rng.randint(5, 70) for _ in range(rng.randint(1, 9))]
        bound = packing.lower_bound(np.bincount(lengths, minlength=101), 100)
        assert -(-sum(lengths) // 100) <= bound <= best(lengths, 100)
        met += bound == best(lengths, 100)
    assert met > 120


def test_completion_beats_best_fit():
    counts = {52: 4, 48: 4, 29: 4, 27: 4, 26: 4, 18: 4}
    fit, done = packing.best_fit(counts, 100), packing.solve(counts, 100)
    assert sum(n for n, _ in done) == -(-sum(k * n for k, n in counts.items()) // 100) <= sum(n for n, _ in fit)


def test_pack(spark, word_ids):
    got = packing.pack(repeated(spark)).toPandas()
    want = collections.Counter()
    for r in repeated(spark).collect():
        ids = np.array([*word_ids(r.text), 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[(r.doc_id, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))] += 1
    have = collections.Counter((None if d != d else int(d), *map(int, x)) for d, *x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length)[:-1]]).all() and g.length.sum() <= 2048
    assert packing.pack(nothing(spark)).count() == 0


# -------------------------------------------------------------------- repair


def test_grammar_round_trip():
    rng = np.random.default_rng(2)
    for x in ([1], [5] * 9 + [1], [2, 3] * 50 + [1], rng.integers(2, 6, 5000).tolist(), ([7, 8, 9, 1] * 40)):
        ids = np.array(x, np.uint16)
        seq, rules = repair.compress(ids, least=2)
        assert (repair.expand(seq, rules) == ids).all()
        assert (repair.expansion(rules) == [len(repair.expand(np.array([repair.FIRST + i]), rules)) for i in range(len(rules))]).all()
    assert len(repair.compress(np.array([2, 3] * 500, np.uint16), least=2)[0]) < 200


def test_first_rules_are_the_frequent_pairs():
    """The first round takes pairs in order of their counts, each where no symbol lets it overlap with one taken before."""
    rng = np.random.default_rng(9)
    for top in (3, 40, 3000):
        ids = (rng.zipf(1.3, 4000) % top).astype(np.uint16)
        key = ids[:-1].astype(int) << 16 | ids[1:]
        lefts, rights, want = set(), set(), set()
        for p, n in sorted(collections.Counter(key.tolist()).items(), key=lambda x: (-x[1], x[0])):
            a, b = p >> 16, p & 0xFFFF
            if n >= repair.LEAST and repair.END not in (a, b) and a not in rights and b not in lefts:
                lefts.add(a)
                rights.add(b)
                want.add((a, b))
        seq, rules = repair.compress(ids)
        assert set(map(tuple, rules[: len(want)].tolist())) == want
        assert (repair.expand(seq, rules) == ids).all()


def test_rules_nested_deeply():
    """A chain in which every rule adds an id to the one before."""
    first = repair.FIRST
    rules = np.array([[2, 3]] + [[first + i, 4] for i in range(299)], np.uint16)
    assert repair.expansion(rules).tolist() == [i + 2 for i in range(300)]
    assert repair.expand(np.array([first + 299]), rules).tolist() == [2, 3] + [4] * 299


def test_random_access():
    rng = np.random.default_rng(3)
    docs = [np.r_[rng.integers(2, 9, n), 1].astype(np.uint16) for n in (0, 1, 2, 50, 500, 3, 0)]
    s = repair.Shard.open(repair.write_shard([5, None, 7, 8, 9, 10, 11], docs))
    for i, d in enumerate(docs):
        assert (s.ids(i) == d).all()
        for a in range(0, len(d), 7):
            assert (s.ids(i, a, a + 5) == d[a : a + 5]).all()


def test_token_files(spark, word_ids):
    got = repair.read(repair.write(repeated(spark), shard_ids=500)).collect()
    at, want = 0, []
    for r in repeated(spark).orderBy(F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")).collect():
        ids = np.array([*word_ids(r.text), 1], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert repair.read(repair.write(nothing(spark))).count() == 0


# ------------------------------------------------------------------- quality


def counts(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = collections.Counter(tri)
    hit = {i + k for i, x in enumerate(tri) if often[x] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_quality_counts(spark):
    for r in quality_rules.rules(documents(spark)).collect():
        n, *_, rep = want = counts(rows()[r.doc_id][1])
        assert tuple(r)[1:6] == want
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert not (r.kept and r.base_failed)


def test_quality_limits_adapt(spark):
    clean = [(i, prose(150, i), "en", "a", 0) for i in range(300)]
    junk = [(1000 + i, re.sub(" ", "### ", prose(150, 900 + i)), "en", "a", 0) for i in range(40)] + [(2000 + i, prose(150, 800 + i).upper(), "en", "a", 0) for i in range(40)]
    small = [(3000 + i, prose(150, 700 + i), "xx", None, 0) for i in range(5)]
    d = spark.createDataFrame(clean + junk + small, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in quality_rules.rules(d).where("kept").collect()}
    assert kept == {*range(300), *range(3000, 3005)}
    out = quality_rules.keep_good(d)
    assert out.schema == d.schema and {r.doc_id for r in out.collect()} == kept
    again = {r.doc_id for r in quality_rules.rules(d.repartition(7)).where("kept").collect()}
    assert again == kept


def brute_verdicts(docs):
    """kept of (doc_id, text, lang, source), by plain arithmetic on sorted values."""
    Q = quality_rules
    rows_ = []
    for i, text, lang, source in docs:
        t = text or ""
        n, chars, symbols, dup, rep = counts(t)
        lines_ = sum(bool(re.search("[^\x20\x09-\x0d]", x)) for x in t.split("\n"))
        rows_.append((i, lang, source, {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep, "n_lines": lines_, "n_capitals": len(re.findall("[A-Z]", t))}))
    failed = {i for i, *_, c in rows_ if c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]}
    good = [r for r in rows_ if r[0] not in failed]

    def quantile(of, metric, q):
        xs = sorted(c[Q.METRICS[metric][0]] / max(c[Q.METRICS[metric][1]], 1) for *_, c in of)
        x = xs[max(0, int(np.ceil(q * len(xs))) - 1)]
        return 0.0 if x <= 1e-9 else 2 * Q.GROWTH ** np.ceil(np.log(x) / np.log(Q.GROWTH)) / (Q.GROWTH + 1)

    kept = set()
    for i, lang, source, c in good:
        mine, same = [r for r in good if r[1:3] == (lang, source)], [r for r in good if r[1] == lang]
        ok = True
        for m, (count, size, outer, reach, events, low) in Q.METRICS.items():
            def q(level, m=m, mine=mine, same=same):
                l = (len(same) * quantile(same, m, level) + Q.PRIOR * quantile(good, m, level)) / (len(same) + Q.PRIOR)
                return (len(mine) * quantile(mine, m, level) + Q.PRIOR * l) / (len(mine) + Q.PRIOR)

            n, mid = max(c[size], 1), q(0.5)
            high = n * (mid + reach * (q(outer) - mid))
            ok &= c[count] <= high + 3 * high**0.5 + events
            if low:
                least = n * max(0.0, mid - reach * (mid - q(1 - outer)))
                ok &= c[count] >= least - 3 * least**0.5 - events
        if ok:
            kept.add(i)
    return kept


def test_quality_verdicts(spark):
    rng, docs = random.Random(6), []
    for i in range(160):
        t = prose(rng.randint(40, 300), 300 + i).split()
        for _ in range(rng.choice([0, 0, 0, 2, 8, 25])):
            t[rng.randrange(len(t))] += rng.choice(["#", "&|", "XY", "QQQQ"])
        if i % 9 == 0:
            t = [w * 2 for w in t]
        text = " ".join(t)
        if i % 7 == 0:
            text += "\n" + "\n".join([text[:60]] * rng.randint(1, 12))
        docs.append((i, text, ["en", "de", None][i % 3], ["a", "b", None][i % 5 % 3]))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    want = brute_verdicts(docs)
    assert {r.doc_id for r in quality_rules.rules(d).where("kept").collect()} == want
    assert {r.doc_id for r in quality_rules.keep_good(d).collect()} == want
    assert 20 < len(want) < 150


def test_quality_rows(spark):
    assert quality_rules.rules(nothing(spark)).count() == 0
    assert quality_rules.keep_good(nothing(spark)).count() == 0
    d = repeated(spark)
    assert quality_rules.rules(d).count() == d.count()
    assert quality_rules.keep_good(d).columns == d.columns


def test_sketch_quantiles(spark):
    x = np.random.default_rng(1).lognormal(0, 1, 2000)
    rows_ = [(f"{i % 3}", "s", float(v)) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows_, "lang string, source string, v double").withColumn("metric", F.lit("symbols")).withColumn("bucket", F.ceil(F.log("v") / np.log(quality_rules.GROWTH)).cast("int"))
    s = d.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    q = quality_rules.quantiles(s.withColumn("all", F.lit(1)), ["all"]).first()
    for k in (50, 75):
        assert abs(q[f"symbols_q{k}"] / np.quantile(x, k / 100, method="inverted_cdf") - 1) < 0.0101


# ------------------------------------------------------------------ licences


def bigram_set(s):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", s.encode().lower())
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else ({(w[0],)} if w else set())


def brute_licences(text, threshold=0.8):
    lines = (text or "").split("\n")
    inked = [x for x in lines if x.strip(" \t\n\r\v\f")]
    parts, run = list(inked), []
    for x in [*lines, ""]:
        if x.strip(" \t\n\r\v\f"):
            run.append(x)
        else:
            if len(run) > 1:
                parts.append("\n".join(run))
            run = []
    if len(inked) > 1:
        parts.append(text)
    out = {}
    for p in parts:
        g = bigram_set(p)
        for name, texts in licenses.TEMPLATES.items():
            for t in texts:
                b = bigram_set(t)
                d = 2 * len(g & b) / (len(g) + len(b)) if g else 0
                if d >= threshold:
                    out[name] = max(d, out.get(name, 0))
    return out


def test_licences(spark):
    long = licenses.TEMPLATES["MIT"][1]
    texts = ["All rights reserved.", "\n\nall RIGHTS reserved\n\nfoo", "Licensed under\nthe Apache License, Version 2.0.", "\n".join(long[i : i + 60] for i in range(0, len(long), 60)), prose(80, 1) + "\nReleased under the MIT License.", "Released under this MIT License", "Licensed", prose(30, 2).replace(" ", "\n")]
    d = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(documents(spark).select("doc_id", "text"))
    plain = dict([*((100 + i, t) for i, t in enumerate(texts)), *((r[0], r[1]) for r in rows())])
    for r in licenses.scan(d).collect():
        assert {x["name"]: x["dice"] for x in r.licenses} == brute_licences(plain[r.doc_id]), r.doc_id
        assert r.n_licenses == len(r.licenses) and (r.license is None) == (r.n_licenses == 0)
    assert licenses.scan(nothing(spark)).count() == 0


def test_licences_inside_passages(spark):
    header = licenses.TEMPLATES["Apache-2.0"][2]
    inside = prose(60, 7) + " This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. " + prose(60, 8)
    cases = [
        ("Copyright (c) 2020 Jane Doe. Released under the MIT License.", "MIT"), ("Copyright 2020 Foo Inc. All rights reserved.", "all-rights-reserved"),
        ("Copyright 2020 Foo Inc. " + header, "Apache-2.0"), (inside, "AGPL-3.0"), *((prose(50, 9) + "\n" + licenses._text(n) + "\n" + prose(90, 4), w) for n, w in (("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"))),
        (prose(300, 5), None),
    ]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    for r in licenses.scan(d).collect():
        text, want = cases[r.doc_id]
        assert want in [x["name"] for x in r.licenses] if want else not r.licenses
        for x in r.licenses:
            part = bigram_set(text.encode()[x["first"] : x["last"]].decode())
            assert x["dice"] in [2 * len(part & b) / (len(part) + len(b)) for b in map(bigram_set, licenses.TEMPLATES[x["name"]])]


def test_dice_of_runs():
    rng = np.random.default_rng(4)
    for length in (1, 3, 9, 40):
        g = rng.integers(0, 12, 40).astype(np.uint64)
        want = [2 * len({x for x in g[i : i + length].tolist() if x < 5}) / (len(set(g[i : i + length].tolist())) + 5) for i in range(40 - length + 1)]
        assert licenses.dice_of_runs(g, g < 5, length, 5).tolist() == want


# ---------------------------------------------------------------------- chat


def test_chat_matches_sql(spark, tmp_path):
    rows_ = [(1, 0, "user", "hi </s> \\ [INST]"), (1, 1, "assistant", "<s>[n\\<\\\\["), (2, 0, "system", None), (2, 1, None, "x"), (2, 2, "assistant", None), (3, 5, "us\ner", "a\nb"), (3, 2, "assistant", "é世😀"), (4, 0, "user", ""), (4, 0, "assistant", "tie"), (None, 1, "user", "no id"), (5, 0, "user", "same"), (5, 0, "user", "same")]
    spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(chat.ORACLE).fetchdf()
    got = chat.op7(spark, str(tmp_path)).select(*want.columns).toPandas()
    key = ["conv_id", "turns_sha256"]
    assert got.sort_values(key).astype(str).values.tolist() == want.sort_values(key).astype(got.dtypes.to_dict()).astype(str).values.tolist()


def test_chat_events(spark):
    log = [(1, 1, 0, "message", "user", "hello"), (1, 2, 1, "message", "assistant", ""), (1, 2, 2, "delta", "assistant", "Hel"), (1, 2, 3, "delta", "assistant", "lo"), (1, 2, 4, "regenerate", "assistant", ""), (1, 2, 5, "delta", "assistant", "Good "), (1, 2, 6, "delta", "assistant", "day"), (1, 1, 7, "edit", "user", "hello!"), (2, 9, 3, "delta", "user", "lost start")]
    d = spark.createDataFrame(log, "conv_id long, msg long, seq long, kind string, role string, text string").orderBy(F.rand(1))
    back = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold(d))).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "hello!"), ("assistant", "Good day")]
    assert back[1].loss == ["Good day"] and [tuple(t) for t in back[2].turns] == [("user", "lost start")]
    none = spark.createDataFrame([], d.schema)
    assert chat.render(chat.fold(none)).count() == 0


def test_chat_uses_no_python(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plan = chat.op7(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- classifier


def labelled(spark, n=600):
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 3
        text = prose(80, i)
        text = re.sub(" ", "## ", text) if bad else text
        text = text.replace("quiet", "quiet vilelout") + " vilelout" if toxic else text
        docs.append((i, text, "en" if i % 2 else None, "junk" if bad and i % 3 else "site", len(text)))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifier_on_held_out(spark):
    docs, labels = labelled(spark)
    model = cotraining.train(docs, labels)
    got = {r.doc_id: r for r in cotraining.score(docs, model).collect()}
    assert len(got) == 600
    right = sum(got[i].kept == (i % 5 != 0 and i % 7 != 3) for i in range(0, 600, 3))
    assert right >= 190
    again = cotraining.train(docs.repartition(5), labels)
    assert np.array_equal(model.content, again.content)


def test_pseudo_labels_come_from_all_documents(spark):
    docs, labels = labelled(spark)
    asked = []
    real = cotraining.gather
    cotraining.gather = lambda d, chosen: asked.append(chosen) or real(d, chosen)
    try:
        cotraining.train(docs, labels, exchange=20, rounds=1)
    finally:
        cotraining.gather = real
    told = {r.doc_id for r in labels.collect()}
    for chosen in asked[1:]:
        ids = {r.doc_id for r in chosen.collect()}
        assert ids and not ids & told and len(ids) <= 20


def test_classifier_rows(spark):
    docs, labels = labelled(spark, 60)
    one = labels.where("quality = 1 and toxic = 0")
    p = {round(r.p_good, 6) for r in cotraining.score(documents(spark), cotraining.train(docs, one)).collect()}
    assert len(p) == 1 and p.pop() > 0.5
    none = cotraining.train(nothing(spark), labels)
    assert cotraining.score(repeated(spark), none).count() == len(rows()) + 4
    assert cotraining.score(nothing(spark), none).count() == 0


def _grams(words):
    return set(zip(words, words[1:], strict=False)) or {(w,) for w in words}


def brute_licenses(text, templates, threshold):
    """Best Dice per licence over lines, paragraphs and the whole; over runs of a template's length where none of those reaches it."""
    cut = lambda x: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", "".join(c.lower() if "A" <= c <= "Z" else c for c in x))
    lines = (text or "").split("\n")
    passages, part = [cut(x) for x in [*lines, text or ""]], []
    for line in [*lines, ""]:
        if line.strip(" \t\r\x0b\x0c"):
            part.append(line)
        else:
            passages.append(cut("\n".join(part)))
            part = []
    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b))
    out = {}
    for name, texts in templates.items():
        own = [cut(t) for t in texts]
        near = [dice(_grams(p), _grams(t)) for p in passages if p for t in own]
        if max(near, default=0) < threshold:
            words = cut(text or "")
            near = [dice(_grams(words[i : i + len(t)]), _grams(t)) for t in own if len(t) > 1 for i in range(len(words) - len(t) + 1)]
        if max(near, default=0) >= threshold:
            out[name] = max(near)
    return out


def test_license_scan_is_brute_force(spark):
    rng = random.Random(12)
    vocabulary = ["use", "Copy", "MIT", "free", "of", "é9", "sell"]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    templates = {"one": [some(4), some(9)], "two": [some(7)], "long": [some(80)], "word": ["sell"]}
    texts = [None, "", "sell", "\n \n", "MIT"]
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 6)):
            words = rng.choice([t for of in templates.values() for t in of]).split() if rng.random() < 0.4 else some(rng.randint(0, 12)).split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            parts.append(rng.choice(["", "x, ", "\t"]) + rng.choice([" ", ", ", "-"]).join(words))
        texts.append("".join(p + rng.choice(["\n", "\n\n", " ", "\n \n"]) for p in parts))
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates=templates).collect()
    assert len(got) == len(texts)
    found = 0
    for r in got:
        want = brute_licenses(texts[r.doc_id], templates, 0.8)
        assert {x["name"]: round(x["dice"], 12) for x in r.licenses} == {k: round(v, 12) for k, v in want.items()}, texts[r.doc_id]
        assert (r.n_licenses, round(r.dice, 12)) == (len(want), round(max(want.values(), default=0.0), 12))
        found += len(want)
    assert found > 200
