"""No overlap is lost to the seeds: every stretch for short items, and a search of all pairs of documents and items."""
import itertools
import random

import pyarrow as pa

from voxtable.llm import spaced_seeds as S
from voxtable.llm.tokens import words


def stretches(n, least):
    """Stretches that begin and end on a match, with enough matches, three quarters of their words, and no shorter one inside."""
    for m in range(least, min(n, 2 * least - 1) + 1):
        for length in range(m, min(n, 4 * m // 3) + 1):
            for gone in itertools.combinations(range(1, length - 1), length - m):
                yield "".join("0" if i in gone else "1" for i in range(length))


def test_masks_meet_every_stretch():
    for n in range(3, 19):
        masks = S.MASKS[S.least_matches(n)]
        for x in stretches(n, S.least_matches(n)):
            assert any(all(x[a + k] == "1" for k, c in enumerate(mask) if c == "1") for mask in masks for a in range(len(x) - len(mask) + 1)), (n, x)
    # A stretch of 24 matches or more has a half that is one itself.
    for x in itertools.islice(stretches(40, 12), 0, 60_000, 7):
        assert any(all(x[a + k] == "1" for k, c in enumerate(mask) if c == "1") for mask in S.MASKS[12] for a in range(len(x) - len(mask) + 1)), x


def test_search_equals_all_pairs(spark):
    r = random.Random(8)
    vocab = [f"w{k}" for k in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 20, 33, 60])))) for i in range(120)]
    docs = []
    for d in range(400):
        body = [r.choice(vocab) for _ in range(r.randrange(60))]
        part = items[r.randrange(len(items))][1].split()
        part = part[r.randrange(max(1, len(part) // 3)):]
        docs.append((d, " ".join(body[:10] + [w if r.random() > .22 else "other" for w in part] + body[10:])))
    hashed = lambda ts: [w.hash[a:b] for w in words(pa.array(ts)) for a, b in zip(w.first[:-1], w.first[1:])]
    h, g = hashed([t for _, t in docs]), hashed([t for _, t in items])
    want = {}
    for d, x in enumerate(h):
        for i, y in enumerate(g):
            if len(y) >= 3:
                found = [f for at in range(-len(y) + 1, len(x)) if (f := S.overlap(x, y, at))]
                if found:
                    want[d, i] = max(f[2] for f in found)
    rows = S.contamination(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(x.doc_id, x.item_id): x.matches for x in rows} == want and len(want) > 200
