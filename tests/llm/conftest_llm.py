import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def near_text(r, words, changes):
    w = list(words)
    for _ in range(changes):
        w[r.randrange(len(w))] = "changed%d" % r.randrange(10**6)
    return " ".join(w)


@pytest.fixture(scope="session")
def corpus_rows():
    """Made documents: plain ones, exact and near copies, repeated rows and lines, nulls in every column, empty and very long texts."""
    r = random.Random(3)
    vocab = ["w%03d" % i for i in range(400)]
    rows = []
    for i in range(120):
        text = "\n".join(" ".join(r.choice(vocab) for _ in range(r.randint(3, 20))) for _ in range(r.randint(1, 6)))
        rows.append((i, text, r.choice(["en", "de"]), f"src{r.randrange(6)}", len(text)))
    base = [r.choice(vocab) for _ in range(60)]
    rows += [(200 + i, near_text(r, base, i % 4), "en", "src0", 1) for i in range(8)]
    rows += [(300 + i, rows[i][1], None, None, None) for i in range(10)]
    rows += [(310, rows[0][1], "en", "src0", 5), (0, rows[0][1], "en", "src1", 5), rows[3], rows[3]]
    rows += [(None, rows[5][1], "en", "src0", 3), (None, None, None, None, None), (None, "", "en", "src2", 0), (400, None, "en", "src2", None), (401, "", "de", "src2", 0), (402, "", "de", "src2", 0), (403, " \n\t \n", "de", None, 5), (404, "!!! ???", "de", "other", 7)]
    rows += [(405, "same line\n" * 3000 + "end", "en", "src3", 1), (406, " ".join(r.choice(vocab) for _ in range(30_000)), "en", "src3", 1), (407, "word", "fr", "src3", 4), (408, "word", "fr", "src3", 4), (409, "x" * 300_000, "en", "src4", 300_000)]
    return rows


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    """The rows with further columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus_rows, SCHEMA)
    extra = {n: F.lit("extra") for n in ("id", "key", "h", "n", "set", "digest", "shard", "docs", "tokens", "t", "x", "l", "y", "epoch", "component", "group", "one", "order", "line", "no", "of", "gone", "flags", "size", "a", "b", "cum", "head")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
