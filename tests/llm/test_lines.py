import numpy as np
from conftest_llm import rows_of

from lodestrand.llm import lines


def brute(rows):
    seen, out = set(), []
    order = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    # rows of one id and of differing texts have no order of their own but by hash; the fixture has none that share lines
    cut = {}
    for i, text in order:
        if text is None:
            cut[i, text] = (None, 0)
            continue
        keep, lost = [], 0
        for line in text.split("\n"):
            k = line.strip(" \t\r")
            if k and k in seen:
                lost += 1
                continue
            if k:
                seen.add(k)
            keep.append(line)
        cut[i, text] = ("\n".join(keep), lost)
    for r in rows:
        out.append((r[0], *cut[r[0], r[1]]))
    return sorted(out, key=repr)


def test_against_brute_force(corpus, corpus_rows):
    got = rows_of(lines.dedup_lines(corpus), "doc_id", "text", "removed")
    assert got == brute(corpus_rows)


def test_small_blocks_and_more_shards_give_the_same(corpus, corpus_rows, monkeypatch):
    monkeypatch.setattr(lines, "_BLOCK", 50)
    monkeypatch.setattr(lines, "_BLOCK_DOCS", 7)
    monkeypatch.setattr(lines, "_SHARE", 1)
    monkeypatch.setattr(lines, "shards", lambda docs: 23)
    assert rows_of(lines.dedup_lines(corpus), "doc_id", "text", "removed") == brute(corpus_rows)


def test_empty_table(nothing):
    assert lines.dedup_lines(nothing).collect() == []


def test_bloom_has_no_false_negative():
    h = np.random.default_rng(1).integers(1, 1 << 63, 5000).astype(np.uint64)
    twice = lines.once_twice(iter([h, h[:500], h[4000:]]), 6500)
    assert twice.has(h[:500]).all() and twice.has(h[4000:]).all()
    assert twice.has(h[500:4000]).mean() < 0.02


def test_twice_within_one_chunk():
    h = np.array([5, 5, 7], np.uint64)
    twice = lines.once_twice(iter([h]), 3)
    assert list(twice.has(np.array([5, 7], np.uint64))) == [True, False]
