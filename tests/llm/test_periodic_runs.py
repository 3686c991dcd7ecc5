"""op11 against a search of every period of every text."""
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from voxtable.llm import periodic_runs
from voxtable.llm.tokens import mix


def brute_runs(w):
    """Every maximal stretch of each period; of equal stretches the least period."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def hashes(w):
    return mix(np.array([x * 2654435761 + 97 for x in w], np.uint64))


def listed(w):
    return list(zip(*(x.tolist() for x in periodic_runs.runs(hashes(w)))))


def test_random_sequences():
    r = random.Random(1)
    for _ in range(1500):
        n, k = r.randint(0, 90), r.choice([1, 2, 2, 3])
        w = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 3) if n > 8 else 0):
            a, q = r.randrange(n), r.randint(1, 12)
            for i in range(a + q, min(n, a + q * r.randint(2, 9) + r.randint(0, q))):
                w[i] = w[i - q]
        assert listed(w) == brute_runs(w), w


def test_words_of_regular_build():
    """Thue-Morse holds no cube and makes sums modulo a power of two collide; Fibonacci has exponents below 3.7."""
    assert listed([bin(i).count("1") & 1 for i in range(1 << 14)]) == []
    a, b = [0], [0, 1]
    while len(b) < 5000:
        a, b = b, b + a
    assert listed(b) == []
    assert listed([0] * 50_000) == [(0, 50_000, 1)]
    assert listed([0, 1, 2] * 3000 + [7] + [0, 1] * 500) == [(0, 9000, 3), (9001, 1000, 2)]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    rs = brute_runs(w)
    best = min(rs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if rs else (None,) * 3
    gone = {i for a, m, q in rs for i in range(a + q, a + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(rs), *best, 1000 * best[1] // best[2] if rs else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in rs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, tmp_path):
    r = random.Random(2)
    docs = [(0, None), (1, ""), (2, " \t\n")]
    for i in range(3, 260):
        w = [r.choice(["a", "B", "b", "ü", "c.", "dd"]) for _ in range(r.randint(1, 200))]
        a, q = r.randrange(len(w)), r.randint(1, 6)
        for j in range(a + q, min(len(w), a + r.randint(3, 9) * q)):
            w[j] = w[j - q]
        docs.append((i, "".join(x + r.choice([" ", "\n", "\t ", "\x0b", "  "]) for x in w)))
    docs += [(900, "word " * 70_000), (901, " ".join(str(i % 900) for i in range(20_000)))]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {x.doc_id: x for x in periodic_runs.op11_square_catching(spark, str(tmp_path)).collect()}
    assert len(rows) == len(docs)
    for i, text in docs[:-2]:
        x = rows[i]
        assert (x.n_runs, x.start, x.length, x.period, x.exponent_milli, x.runs_sha256, x.collapsed_sha256) == expected(i, text), i
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs) > 10
    if zlib.crc32(b"900") % 10:
        assert (rows[900].n_runs, rows[900].length, rows[900].period, rows[900].n_kept) == (1, 70_000, 1, 1)
    if zlib.crc32(b"901") % 10:
        assert (rows[901].start, rows[901].length, rows[901].period, rows[901].exponent_milli) == (0, 20_000, 900, 22_222)
