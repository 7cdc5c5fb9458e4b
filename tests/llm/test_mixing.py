import hashlib
import re
from collections import Counter, defaultdict

from conftest_llm import rows_of

from lodestrand.llm import mixing


def brute(rows, p, tokens=lambda t: len(re.findall(r"\S+", t or ""))):
    """Each leaf's epochs written out and cut."""

    def leaf(r):
        m = re.match(r"^src(\d{1,9})$", r[3] or "")
        return (f"d{int(m[1]) % 4}" if m else "", r[2] or "", r[3] or "")

    leaves = defaultdict(list)
    for r in rows:
        if tokens(r[1]):
            leaves[leaf(r)].append(r)
    total = {k: sum(tokens(r[1]) for r in v) for k, v in leaves.items()}
    out = []
    for k, budget in mixing.budgets(total, p).items():
        left = budget
        for epoch in range(p.max_epochs + 1):
            groups = defaultdict(list)
            for r in leaves[k]:
                ident = "null" if r[0] is None else str(r[0])
                groups[hashlib.md5(f"{p.seed}|{epoch}|{ident}".encode()).hexdigest()].append(r)
            stop = False
            for key in sorted(groups):
                n = sum(tokens(r[1]) for r in groups[key])
                if n > left:
                    stop = True
                    break
                left -= n
                out += [(r[0], r[1], epoch) for r in groups[key]]
            if stop:
                break
    return out


def test_against_epochs_written_out(corpus, corpus_rows):
    for p in (mixing.Params(weights=mixing.WEIGHTS), mixing.Params(weights={("d0",): 9.0, ("d1",): 0.0, ("d2", "de"): 5.0}, share=0.7, seed=3, slices_hex=1), mixing.Params(share=2.5, max_epochs=3, slices_hex=2)):
        got = Counter((r["doc_id"], r["text"], r[mixing.EPOCH]) for r in mixing.mix(corpus, p).collect())
        # rows of one id that are in several leaves are told apart by nothing in the result: compare as bags
        assert got == Counter(brute(corpus_rows, p))


def test_columns_stay(corpus):
    assert mixing.mix(corpus).columns == [*corpus.columns, mixing.EPOCH]


def test_the_stage_keeps_columns_of_any_name(spark, corpus_rows):
    from pyspark.sql import functions as F

    import corpus_pipeline

    docs = spark.createDataFrame(corpus_rows, "doc_id long, text string, lang string, source string, n_chars int").withColumns({"__epoch": F.lit(7), "a.b": F.lit("x")})
    out = corpus_pipeline.mix_sources(spark, docs, "")
    assert out.columns == docs.columns and {r["__epoch"] for r in out.collect()} == {7}


def test_shortage_goes_to_siblings_first():
    tokens = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("a", "y", "3"): 1000, ("b", "z", "4"): 1000}
    got = mixing.budgets(tokens, mixing.Params(share=800 / 3010, max_epochs=1))
    # a and b have 400 each, x and y 200 each; leaf 1 can only give 10, leaf 2 makes up for it, y and b are as they were
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("a", "y", "3"): 200, ("b", "z", "4"): 400}


def test_shortage_of_a_whole_branch_goes_up():
    tokens = {("a", "x", "1"): 10, ("a", "y", "2"): 20, ("b", "z", "3"): 1000}
    got = mixing.budgets(tokens, mixing.Params(share=500 / 1030, max_epochs=1))
    assert got == {("a", "x", "1"): 10, ("a", "y", "2"): 20, ("b", "z", "3"): 470}


def test_budget_is_kept(corpus, corpus_rows):
    p = mixing.Params(weights=mixing.WEIGHTS, share=0.5)
    n = sum(len(r["text"].split()) for r in mixing.mix(corpus, p).collect())
    total = sum(len((r[1] or "").split()) for r in corpus_rows)
    assert n <= 0.5 * total


def test_empty_tables(nothing, spark):
    assert mixing.mix(nothing).collect() == [] and mixing.mixed_ids(nothing).collect() == []
    blank = spark.createDataFrame([(1, None, "en", "src1", 0), (2, "  ", None, None, 0)], nothing.schema)
    assert mixing.mixed_ids(blank).collect() == []
    assert rows_of(mixing.mixed_ids(spark.createDataFrame([(None, "a b", None, None, 0)], nothing.schema)), "doc_id", "epoch") == [(None, 0)]
