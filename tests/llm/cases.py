"""Rows that operators have to survive: nulls everywhere, empty and long texts, ties, repeats, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, part int, th string, key string, n string, fp string, length int, gone_id int, symbols_high int, __id int, c0 int"

_rng = random.Random(5)
_WORDS = "the of and in on with by river stone green house walks under small light over near quiet table moves seven old paper train west".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) + r.choice(["", "", "ly", "er"]) for _ in range(n))


def texts() -> list[str | None]:
    base, long = prose(120, 1), prose(20_000, 2)
    near = base.split()
    near[60] = "changed"
    many = [prose(80, 100 + i) for i in range(20)]
    shared = "\n".join([prose(60, 3), many[0]])
    return [
        None, "", " \n\t", "one", "two words", "a b c d", base, base, " ".join(near), base.upper(), long, shared, "\n".join([prose(60, 3), many[1]]),
        "é ü 世界 " * 30, "#" * 500, "word " * 300, "x" * 100_000, base + "\n" + base, "\n\n" + base + "\n", "tie\ntie\ntie", "tie\ntie\ntie", *many,
    ]


def rows() -> list[tuple]:
    out = []
    for i, t in enumerate(texts()):
        lang, source = [None, "en", "de"][i % 3], [None, "s1", "s2", "s3"][i % 4]
        out.append((i, t, lang, source, None if i % 5 == 0 else len(t or ""), "r", i, "t", "k", "n", "f", 1, 2, 3, 4, 5))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), DOCS)


def repeated(spark):
    """Rows with an equal doc_id: one pair equal, one pair of different texts; and null ids."""
    r = rows()
    clash = [(r[6][0], prose(70, 77), *r[6][2:]), r[7], (None, prose(90, 78), *r[8][2:]), (None, None, *r[8][2:])]
    return spark.createDataFrame(r + clash, DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)
