"""Alignment of two transcripts against plain definitions, in one piece and in many."""
import random
from functools import lru_cache

import pytest

from voxtable.operators import alignment as A


def naive_pairs(a, b):
    """Equal heads are paired; otherwise the first list gives way if that costs nothing."""
    @lru_cache(maxsize=None)
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0, ()
        if a[i] == b[j]:
            n, rest = best(i + 1, j + 1)
            return n + 1, ((i, j), *rest)
        return max(best(i + 1, j), best(i, j + 1), key=lambda x: x[0])
    return list(best(0, 0)[1])


def findings(pairs, a, b):
    out, i, j = [], -1, -1
    for x, y in [*pairs, (len(a), len(b))]:
        left, right = a[i + 1:x], b[j + 1:y]
        if left or right:
            kind = "caption_not_heard" if not right else "heard_not_captioned" if not left else "differs"
            out.append((kind, (j + 1 if right else i + 1) * 100_000, " ".join(left), " ".join(right)))
        i, j = x, y
    return out


def naive_diff(x, y):
    """Missing and extra words; unequal heads move to the nearest of three words ahead on either side, the second's first."""
    a = b = missing = extra = 0
    while a < len(x) and b < len(y):
        near = sorted([(d, 0) for d in (1, 2, 3) if b + d < len(y) and x[a] == y[b + d]] + [(d, 1) for d in (1, 2, 3) if a + d < len(x) and x[a + d] == y[b]])
        d, side = near[0] if near else (0, 2)
        if x[a] == y[b]:
            a, b = a + 1, b + 1
        elif side == 2:
            a, b, missing, extra = a + 1, b + 1, missing + 1, extra + 1
        elif side == 0:
            b, extra = b + d, extra + d
        else:
            a, missing = a + d, missing + d
    return missing + len(x) - a, extra + len(y) - b


def table(spark, lists):
    rows = [(c, i, t, i * 100_000, i * 100_000 + 50_000) for c, xs in lists.items() for i, t in enumerate(xs)]
    return spark.createDataFrame(rows, "clip_id bigint, i int, text string, start_us bigint, end_us bigint")


def test_common_is_the_canonical_subsequence():
    r = random.Random(1)
    for _ in range(400):
        k = r.choice([2, 4, 30])
        a, b = ([f"w{r.randrange(k)}" for _ in range(r.randint(0, 60))] for _ in range(2))
        assert list(zip(*A.common(a, b))) == naive_pairs(a, b)
    a = [f"w{r.randrange(3000)}" for _ in range(6000)]
    b = [x for x in a if r.random() > .1]
    left, right = A.common(a, b)
    assert len(left) == len(b) and all(a[i] == b[j] for i, j in zip(left, right))


def altered(r, words, drop=.05, change=.04):
    return [x if r.random() > change else f"other{r.randrange(9)}" for x in words if r.random() > drop]


@pytest.mark.parametrize("size", [A.PIECE, 64])
def test_transcript_drift(spark, size):
    r = random.Random(size)
    cap = {c: [f"w{r.randrange(k)}" for _ in range(n)] for c, (n, k) in {1: (120, 40), 2: (1, 5), 3: (90, 3), 4: (300, 100_000)}.items()}
    heard = {c: altered(r, x) for c, x in cap.items()}
    heard[2], cap[5], heard[6] = ["zz"], ["only", "captions"], ["only", "heard"]
    got = {}
    for x in A.transcript_drift(table(spark, cap), table(spark, heard), size).collect():
        got.setdefault(x.clip_id, []).append((x.kind, x.at_us, x.caption, x.heard))
    for c in cap.keys() | heard.keys():
        a, b = cap.get(c, []), heard.get(c, [])
        if size > 64 or c not in (1, 3):        # where cuts may settle ties, or the length, otherwise
            assert sorted(got.get(c, [])) == sorted(findings(naive_pairs(a, b), a, b)), c
    # whatever the cuts, the findings hold exactly the words that are not matched
    rows = A.aligned(*(table(spark, x).withColumnRenamed("text", "t") for x in (cap, heard)), size).collect()
    pairs = {c: sorted((x.ca, x.cb) for x in rows if x.clip_id == c) for c in (1, 3)}
    for c, least in ((1, .97), (3, .6)):
        assert sorted(got[c]) == sorted(findings(pairs[c], cap[c], heard[c]))
        assert len(pairs[c]) >= least * len(naive_pairs(cap[c], heard[c]))
    assert max(max(x.a_hi - x.a_lo, x.b_hi - x.b_lo) for x in A.pieces_of(*(table(spark, x).withColumnRenamed("text", "t") for x in (cap, heard)), size).collect()) <= size


@pytest.mark.parametrize("stride", [A.STRIDE, 80])
def test_word_diff(spark, stride):
    r = random.Random(stride)
    guess = {c: [f"w{r.randrange(k)}" for _ in range(n)] for c, (n, k) in {1: (900, 5000), 2: (900, 5000), 3: (200, 12), 4: (3, 9), 5: (70, 2)}.items()}
    heard = {c: altered(r, x) for c, x in guess.items()}
    heard[2][300:300] = heard[2][100:140]
    guess[7], heard[8], guess[9], heard[9] = ["a", "b"], ["c"], list("abcd"), list("axbzcd")
    got = {x.clip_id: (x.missing, x.extra) for x in A.word_diff(table(spark, guess), table(spark, heard), stride).collect()}
    assert got == {c: naive_diff(guess.get(c, []), heard.get(c, [])) for c in guess.keys() | heard.keys()}
