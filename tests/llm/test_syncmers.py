"""op13 against a plain walk over words, and its likeness on planted copies."""
import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from voxtable.llm import syncmers


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_longs(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed=h)
    return signed(h)


def brute(text):
    """(place, hash) of the anchors: stretches whose least inner hash stands at an edge."""
    h = [signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.findall(r"[^\x20\x09-\x0D]{1,16}", text.lower())]
    if len(h) < 6:
        return [(0, hash_longs(*h))] if h else []
    out = []
    for i in range(len(h) - 5):
        inner = [hash_longs(h[i + j], h[i + j + 1]) for j in range(5)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, hash_longs(inner[0], inner[2], inner[4])))
    return out


def fingerprint(found):
    gaps = [p - (found[j - 1][0] if j else 0) for j, (p, _) in enumerate(found)]
    return ",".join(f"{g}:{h & (1 << 48) - 1:012x}" for g, (_, h) in zip(gaps, found))


def alike(a, b):
    a, b = ({h & (1 << 48) - 1 for _, h in x} for x in (a, b))
    return 1.0 if not a and not b else 2 * len(a & b) / (len(a) + len(b))


def corpus(r, n):
    vocab = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7))) for _ in range(400)]
    text = lambda m: "".join(r.choice(vocab) + r.choice([" ", " ", "\n", ". "]) for _ in range(m))
    docs = [(r.choice([1, 5, 9]) * k + 10 ** 17 * (k % 3), text(r.choice([0, 1, 3, 6, 30, 200]))) for k in range(1, n)]
    return docs + [(-1, ""), (-2, None), (-3, "x" * 100), (-4, "a"), (-5, "ab"), (-6, text(4000))]


def test_against_brute_force(spark):
    docs = list(dict(corpus(random.Random(4), 300)).items())
    order = sorted(docs, key=lambda d: -d[0])
    for rows in (7, 1000):
        got = {x.doc_id: x for x in syncmers.compared(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), rows=rows).collect()}
        assert len(got) == len(docs)
        for k, (i, text) in enumerate(order):
            text, after = text or "", order[(k + 1) % len(order)][1] or ""
            n = len(text)
            edited = text[:n - n // 3] + after[:n // 3]
            a, e, b = brute(text), brute(edited), brute(after)
            x = got[i]
            assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint(a), fingerprint(e))
            assert (x.near_edited, x.near_next) == (alike(a, e), alike(a, b))


def test_edits_keep_other_anchors(spark):
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    words = [r.choice(vocab) for _ in range(2000)]
    changed = words[:900] + ["inserted", "words"] + words[900:1500] + words[1510:]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(r.sample(vocab, 400)))], "doc_id bigint, text string")
    found = {x.doc_id: x for x in syncmers.fingerprints(rows).withColumn("set", syncmers.read("fingerprint")).collect()}
    a, b, c = (set(found[i].set) for i in (1, 2, 3))
    assert 2 * len(a & b) / (len(a) + len(b)) > 0.97 and not a & c
    # One anchor at least among neighbouring stretches.
    places = [x.place for x in found[1].anchors]
    assert max(y - x for x, y in zip(places, places[1:])) <= syncmers.K - syncmers.S + 1


def test_repeats_nulls_and_single_rows(spark):
    one = syncmers.compared(spark.createDataFrame([(3, "abc def ghi")], "doc_id bigint, text string")).collect()[0]
    assert (one.near_next, one.near_edited) == (1.0, 0.0) and one.n_chars == 11
    rows = syncmers.compared(spark.createDataFrame([(3, "abc")] * 5 + [(None, "abc"), (2, "q r s t u v w")], "doc_id bigint, text string")).collect()
    assert len(rows) == 7 and len({x.fingerprint for x in rows if x.n_chars == 3}) == 1
    assert sorted(x.near_next for x in rows) == [0.0, 0.0, 1.0, 1.0, 1.0, 1.0, 1.0]


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string").select(F.col("doc_id"), F.col("text"))
    plan = syncmers.compared(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
