"""Small tables with the awkward cases: nulls in any column, empty and very long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("k", "a", "b", "pos", "site", "key", "node", "root", "part", "rank", "length", "w0", "_id", "size", "target", "p", "v")


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Größe", "ÉTÉ", "naïve,", "x's", "№5", "日本", "İx", "Σας", "a|b", "12.5"]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k))
    out = []
    for i in range(n):
        text = "\n".join([line(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))] + ["Subscribe to our news letter"] * (i % 3 == 0))
        out.append((i, text, "en", f"s{i % 7}", len(text)))
    for i in range(n, n + 12):  # near copies and copies that differ in case and blanks
        t = out[i - n][1]
        t = t.upper() if i % 3 == 0 and t.isascii() else t + "  \t" if i % 3 == 1 else t + " tail"
        out.append((i, t, "en", f"s{i % 5}", len(t)))
    out += [(900, None, None, None, None), (901, "", "en", "s1", 0), (902, " \t\n ", "en", None, 4), (None, "no id here", "en", "s1", 10), (None, "no id there", None, None, 10),
            (903, line(6000), "en", "s2", 9), (904, "x" * 30000, "en", "s3", 9), (905, "one", "en", "é", 3), (905, "one", "en", "é", 3), (905, "other text of the same id", "en", "s1", 3)]
    return out


def documents(spark, data=None):
    df = spark.createDataFrame(rows() if data is None else data, DOCS)
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES}).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)
