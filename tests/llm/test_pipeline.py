import collections
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from scoreloom.llm import decontaminate, ngram_join
from tests.llm.cases import nothing, prose, repeated
from tests.llm.test_pairs import brute_hits, brute_lines, components, jaccard_linked, shingle_set
from tests.llm.test_texts import brute_verdicts


def test_stages(spark, tmp_path):
    base = [prose(120, 500 + i) for i in range(30)]
    near = base[3].split()
    near[50] = "changed"
    bench = prose(40, 9)
    texts = [*base, base[0], " ".join(near), base[5] + "\n" + bench, "### " * 90, None, "", "short"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    now, kept = d, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert now.columns == d.columns
        kept.append({r.doc_id for r in now.select("doc_id").collect()})
    assert kept[0] == {*range(33)}
    assert kept[1] == {*range(30), 31, 32}
    assert kept[2] == {*range(30), 32} and kept[3] == {*range(30)}
    assert kept[4] == kept[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([(1, prose(40, 9))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = nothing(spark)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.count() == 0
    assert decontaminate.WINDOW == 10 and ngram_join.K == 5


def brute_pipeline(docs, items):
    """The five stages by plain loops: (doc_id, piece, start, length, crc) of every piece."""
    kept = brute_verdicts(docs)
    now = [(i, t) for i, t, *_ in docs if i in kept]
    dropped, _, n_lines = brute_lines(now)
    now = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dropped[i])) for i, t in now if len(dropped[i]) < n_lines[i]]
    root = components({i: shingle_set(t) for i, t in now}, jaccard_linked)
    now = [(i, t) for i, t in now if root[i] == i]
    now = [(i, t) for (i, t), hit in zip(sorted(now), sorted(brute_hits(now, items)), strict=True) if not hit[-1]]
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    out = collections.Counter()
    for i, t in now:
        ids = np.array([*encode(t, add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            out[i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())] += 1
    return out


def corpus():
    rng, docs = random.Random(8), []
    base = [prose(rng.randint(60, 400), 900 + i) for i in range(40)]
    bench = [(1, prose(40, 9)), (2, prose(12, 10)), (3, None)]
    texts = [*base, base[0], prose(60, 77) + "\n" + base[1], base[2].upper(), base[3] + "\n" + bench[0][1], bench[1][1] + " " + base[4], "&& " * 90, None, "", "short", prose(5000, 31)]
    for k in range(4):
        w = base[5 + k].split()
        for _ in range(3):
            w[rng.randrange(len(w))] = "other"
        texts.append(" ".join(w))
    line = prose(20, 55)
    texts += [line + "\n" + prose(70, 60 + k) + "\n" + line[:-1] for k in range(3)]
    for i, t in enumerate(texts):
        docs.append((i, t, ["en", "de", None][i % 3], ["a", None][i % 2]))
    return docs, bench


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, bench = corpus()
    d = spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    have = collections.Counter(tuple(map(int, x)) for x in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    want = brute_pipeline(docs, bench)
    assert have == want
    assert 25 < len({k[0] for k in want}) < len(docs) - 5
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length)[:-1]]).all() and g.length.sum() <= 2048


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(1, prose(40, 9))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = now = repeated(spark)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == d.columns and now.dtypes == d.dtypes
    assert now.count() > 0
