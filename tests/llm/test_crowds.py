"""op5 where thousands of texts of one template are just too different to be linked, and some pairs among them are not."""
import random

import numpy as np
import pytest

from voxtable.llm import crowds, minhash_forest


def components(docs):
    """Exact components over all pairs, by products of the 0-1 matrix of shingles."""
    sets = [{tuple(x[i:i + 5]) for i in range(len(x) - 4)} for x in docs]
    count = {}
    for g in (g for x in sets for g in x):
        count[g] = count.get(g, 0) + 1
    column = {g: k for k, g in enumerate(g for g, n in count.items() if n > 1)}
    m = np.zeros((len(docs), len(column)), np.float32)
    for i, x in enumerate(sets):
        m[i, [column[g] for g in x if g in column]] = 1
    same, n = m @ m.T, np.array([len(x) for x in sets])
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x
    for i, j in zip(*np.nonzero(100 * same >= 75 * (n[:, None] + n[None, :] - same))):
        x, y = root(i), root(j)
        up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(docs))], np.median(same / (n[:, None] + n[None, :] - same))


def crowd(r, n, pairs, words=300, edits=6):
    """n texts of one template with their own edits, and closer versions of some."""
    fresh = iter(range(10 ** 9))
    template = [f"t{k}" for k in range(words)]

    def edited(text, k):
        text = list(text)
        for i in r.sample(range(len(text)), k):
            text[i] = f"x{next(fresh)}"
        return text
    docs = [edited(template, edits) for _ in range(n)]
    close = [(i, edited(docs[i], 8)) for i in range(pairs)]
    return docs + [t for _, t in close], [(i, n + k) for k, (i, _) in enumerate(close)]


@pytest.mark.parametrize("n,cell", [(2000, crowds.CELL), (1500, 400)])
def test_planted_pairs_in_a_crowd(spark, n, cell, monkeypatch):
    r = random.Random(n)
    docs, pairs = crowd(r, n, 150)
    want, middle = components(docs)
    assert .66 < middle < .72 and all(want[i] == want[j] for i, j in pairs)
    if cell != crowds.CELL:
        inner = crowds.crowd_links
        monkeypatch.setattr(minhash_forest, "crowd_links", lambda *a: inner(*a, cell))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id bigint, text string").repartition(8)
    of = {x.doc_id: x.component_id for x in minhash_forest.near_duplicates(df).collect()}
    if cell == crowds.CELL:
        assert [of[i] for i in range(len(docs))] == want
    assert sum(of[i] == of[j] for i, j in pairs) >= (150 if cell == crowds.CELL else 146)


def test_intersections():
    r = np.random.RandomState(1)
    a, b = ([np.unique(r.randint(0, 300, r.randint(1, 90))).astype(np.int64) for _ in range(40)] for _ in range(2))
    assert (crowds._shared(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
