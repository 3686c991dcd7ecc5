"""Benchmark decontamination by spaced-seed hashing.

Seeds are fixed masks over runs of words; a mask's zeros are places whose words do not matter. Every place of a benchmark
item gives one hash per mask, and so does every place of every document; where two are equal, document and item are laid
over each other at that offset and compared word by word in both directions. A stretch is an overlap if it has WORDS
matching words, or SHARE of the item's words where that is less, and at least three quarters of its words match; of all
stretches on the diagonal the one of most matches is given. So an overlap is found although words were replaced.

The masks of an item follow from the matches it takes to overlap with it: in every stretch that is an overlap, wherever its words
were replaced, one of them meets matching words alone (tests go through all such stretches). So no overlap is lost to
the seeds.

The benchmark is a stated set of queries that is run against all documents, in blocks: items are dealt into blocks of
BLOCK bytes, whose hashes go to the tasks as a sorted table; documents are read once per block and nothing is shuffled. Of several
blocks the driver holds one at a time. Whole texts are searched. Items of fewer than three words are too short to be told and
match nothing.

Null or empty texts overlap with nothing. Repeated documents or items give a row each. Null ids are kept as they are.
Other columns are not read. Empty tables give no rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtable.functions.stage import stage

from .common import table
from .tokens import mix, words

#: For the least number of matching words of an overlap the masks that meet every stretch with so many, of which three quarters match.
MASKS = {
    3: ("111", "1101", "1011"), 4: ("111", "1101"), 5: ("11101", "100111", "1101001"), 6: ("11101", "1010011", "1111"),
    7: ("11101", "100111"), 8: ("11101", "100111"), 9: ("111011", "110100011", "11001011", "110111"),
    10: ("111011", "1100001011", "111100001", "11111"), 11: ("111011", "1100001011", "111100001", "11111"),
    12: ("111011", "1100001011", "111000010001"),
}
WORDS, SHARE = 12, 0.6
BLOCK = 8 << 20
#: Pairs of a document's place and an item's that are listed at once.
PAIRS = 1 << 20
_BITS = 24
_STEP = np.uint64(0x9E3779B97F4A7C15)


def least_matches(n: int) -> int:
    """Matching words that make an overlap with an item of n words."""
    return max(min(WORDS, int(np.ceil(SHARE * n))), 3)


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under a mask at every place; places where the mask does not fit are left out."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out = (out + h[k:k + n]) * _STEP + np.uint64(k)
    return mix(out)


class Seeds:
    """The seeds of a block of items, looked up by hash."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids, self.words = ids, []
        for w in words(pa.array(texts, pa.large_string())):
            self.words += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        least = [least_matches(len(x)) for x in self.words]
        self.masks = list(dict.fromkeys(m for k in sorted(set(least)) for m in MASKS[k]))
        found = [(mask, seed_hashes(x, mask), i) for i, x in enumerate(self.words) if len(x) >= 3 for mask in MASKS[least[i]]]
        key = np.concatenate([h for _, h, _ in found]) if found else np.zeros(0, np.uint64)
        item = np.concatenate([np.full(len(h), i) for _, h, i in found]) if found else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for _, h, _ in found]) if found else np.zeros(0, np.int64)
        by = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[by], item[by].astype(np.int64), place[by]

    def table(self) -> np.ndarray:
        """Whether some seed begins with these bits."""
        hit = np.zeros(1 << _BITS, bool)
        hit[(self.key >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return hit

    def meetings(self, h: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in h where the item would begin, item) of all equal seeds; each once."""
        both = np.zeros((2, 0), np.int64)
        for mask in self.masks:
            s = seed_hashes(h, mask)
            q = np.flatnonzero(hit[(s >> np.uint64(64 - _BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.key, s[q]), np.searchsorted(self.key, s[q], side="right")
            n = hi - lo
            # A line that many items and places share makes many pairs: so many at a time, each kept once.
            cuts = np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum() + PAIRS, PAIRS), side="right")
            for x, y in zip([0, *cuts], [*cuts, len(q)]):
                k = n[x:y]
                e = np.repeat(lo[x:y] - (np.cumsum(k) - k), k) + np.arange(k.sum())
                if len(e):
                    new = np.stack([np.repeat(q[x:y], k) - self.place[e], self.item[e]])
                    both = np.unique(np.concatenate([both, new], axis=1), axis=1)
        return both[0], both[1]


def overlap(doc: np.ndarray, item: np.ndarray, at: int) -> tuple[int, int, int] | None:
    """The stretch of most matches, three quarters of its words at least, of an item laid over a document's words from
    at on, and of these the shortest and first: (first word, end word, matches), or None if it has too few."""
    a, b = max(at, 0), min(at + len(item), len(doc))
    same = doc[a:b] == item[a - at:b - at]
    count = np.concatenate([[0], np.cumsum(same)])
    least = least_matches(len(item))
    if count[-1] < least:
        return None
    # A match counts 1 and a substituted word -3: a stretch is good from 0 on, and the best one begins and ends on a match.
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -3))])
    starts, ends = np.flatnonzero(same), np.flatnonzero(same) + 1
    # From each start the farthest end whose sum is not less, by the largest sum of all ends from there on.
    later = np.maximum.accumulate(sums[ends][::-1])[::-1]
    far = np.searchsorted(-later, -sums[starts], side="right") - 1
    matches = count[ends[far]] - count[starts]
    best = np.lexsort((starts, ends[far] - starts, -matches))[0]
    if matches[best] < least:
        return None
    return a + int(starts[best]), a + int(ends[far[best]]), int(matches[best])


def _searcher(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds: Seeds = block.value
        hit = seeds.table()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = []
            for w in words(batch.column(1)):
                at, item = seeds.meetings(w.hash, hit)
                # The seed may begin before the item's part that lies in this document; its row is that of the seed.
                best: dict[tuple[int, int], tuple] = {}
                for a, i in zip(at.tolist(), item.tolist()):
                    lo, hi = np.searchsorted(w.first, [max(a, 0), a + len(seeds.words[i]) - 1], side="right") - 1
                    for r in range(max(int(lo), 0), min(int(hi), len(w.first) - 2) + 1):
                        first = int(w.first[r])
                        found = overlap(w.hash[first:w.first[r + 1]], seeds.words[i], a - first)
                        if found and (r, i) not in best or found and found[2] > best[r, i][2]:
                            best[r, i] = found
                out += [(ids[w.rows.start + r], seeds.ids[i], *x, len(seeds.words[i])) for (r, i), x in best.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "item_id", "first_word", "end_word", "matches", "item_words"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that overlap: (doc_id, item_id, first_word, end_word, matches, item_words), the
    stretch being given in words of the document."""
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK))
    out = None
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        block = spark.sparkContext.broadcast(Seeds([r[0] for r in rows], [r[1] for r in rows]))
        found = plain.mapInArrow(_searcher(block), "doc_id bigint, item_id bigint, first_word bigint, end_word bigint, matches bigint, item_words bigint")
        if blocks > 1:
            found = stage(found, "contaminated-by-block")
            block.destroy()
        out = found if out is None else out.unionAll(found)
    return out


def op8_spaced_seeds(spark, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
