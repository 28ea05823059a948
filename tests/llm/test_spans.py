"""Shared spans against every window of 200."""

import random

import pytest

from labloom.llm.spans import _having, shared_share, shared_spans, winnow


def brute(texts, n=200):
    seen = {}
    for k, t in texts:
        for i in range(len(t or "") - n + 1):
            seen.setdefault(t[i : i + n], set()).add(k)
    out = {}
    for k, t in texts:
        for i in range(len(t or "") - n + 1):
            if len(seen[t[i : i + n]]) > 1:
                out.setdefault(k, set()).add(i)
    spans = set()
    for k, starts in out.items():
        begin = end = None
        for i in sorted(starts):
            if end is not None and i <= end:
                end = i + n
            else:
                if end is not None:
                    spans.add((k, begin, end))
                begin, end = i, i + n
        spans.add((k, begin, end))
    return spans


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgh \né中"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [word(rng.choice([199, 200, 201, 260, 500, 900])) for _ in range(12)]
    texts = []
    for k in range(40):
        parts = []
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            a = rng.randrange(0, 80)
            parts += [word(rng.randrange(0, 150)), s if rng.random() < 0.5 else s[a:] if rng.random() < 0.5 else s[: len(s) - a]]
            if rng.random() < 0.3 and len(parts[-1]) > 20:
                i = rng.randrange(len(parts[-1]))
                parts[-1] = parts[-1][:i] + "#" + parts[-1][i + 1 :]
        texts.append((k, "".join(parts)))
    return texts + [(100, "x" * 1000), (101, "y" + "x" * 900), (102, None), (103, ""), (104, "abab" * 200), (105, "zz" + "abab" * 100), (106, texts[0][1]), (7, texts[7][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("hot", [4096, 3])
def test_same_as_brute_force(spark, seed, hot):
    texts = corpus(seed)
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in texts], "doc_id bigint, text string, h string, pos int")
    assert set(map(tuple, shared_spans(df, hot=hot).collect())) == brute(texts)


def test_edges(spark):
    schema = "doc_id bigint, text string"
    long = "ab cd " * 50
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (None, long)], schema)
    assert shared_spans(df).count() == 0
    both = spark.createDataFrame([(1, long), (1, long), (2, long), (3, "q")], schema)
    assert sorted(map(tuple, shared_spans(both).collect())) == [(1, 0, 300), (2, 0, 300)]
    share = {r.doc_id: (r.n_chars, r.shared_chars, r.share) for r in shared_share(both).collect()}
    assert share[2] == (300, 300, 1.0) and share[3] == (1, 0, 0.0)
    assert shared_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shared_spans(df, min_chars=201)


def test_other_lengths_and_a_hot_passage(spark):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdef ") for _ in range(60))
    texts = [(k, "".join(rng.choice("ghijkl ") for _ in range(rng.randrange(50))) + (passage if k % 3 == 0 else "") + str(k)) for k in range(300)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    for hot in (4096, 20):
        assert set(map(tuple, shared_spans(df, min_chars=40, hot=hot).collect())) == brute(texts, 40)


def test_long_texts_in_parts(spark, monkeypatch):
    from labloom.llm import spans

    monkeypatch.setattr(spans, "SLICE_CHARS", 300)
    texts = corpus(5)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert set(map(tuple, shared_spans(df).collect())) == brute(texts)


def test_texts_without_windows_are_not_fetched(spark):
    """The bitmap lets through every record with a hit and next to none without."""
    docs = spark.range(-500, 20_000).selectExpr("id as doc", "'t' as text")
    hits = spark.range(-50, 20_000, 50).selectExpr("id as doc")
    got = {r.doc for r in _having(docs, hits, "doc").collect()}
    want = {r.doc for r in hits.collect()}
    assert want <= got and len(got) <= len(want) + 5
    assert _having(docs, hits.limit(0), "doc").count() == 0


def test_level_two_hashes():
    text = "".join(random.Random(5).choices("abcdefgh ", k=700))
    doc, pos, h, left, right = winnow([text, "x" + text])
    first, second = ({p: (x, y, z) for d, p, x, y, z in zip(doc, pos, h, left, right, strict=True) if d == k} for k in (0, 1))
    same = [p for p in first if p + 1 in second and p >= 50]
    assert len(same) > 5 and all(first[p] == second[p + 1] for p in same if p + 100 <= 700)
    assert all((left[i] == 0) == (pos[i] < 50) for i in range(len(pos)))
