"""Language-model scoring of whole texts with a weighted backoff automaton.

The model: n-grams of the training texts up to the order, with Dirichlet smoothing,
    P(w | h) = (c(h w) + K * P(w | h')) / (c(h) + K),   h' = h without its first word,
    P(w)     = (c(w) + 1) / (N + V + 1),
where an unknown word has c = 0 and every text ends with an end token. Each history h that was seen is a state; an n-gram
h w is an arc of h; the failure arc of h leads to h' and weighs K / (c(h) + K). The state before the first word is that
behind an end token. One traversal from left to right carries the state, follows failure arcs until the word's arc is
found, and adds up log10 probabilities.

The model's size follows the corpus, so no task loads it whole:
1. Texts are dealt into blocks of bounded size by a hash of the id. A block lists its distinct n-grams (64-bit hashes)
   with their counts in its training texts, split by hash into buckets: one packed row per block and bucket.
2. A bucket adds up the lists of all blocks and returns to each block the corpus counts of what it asked for.
3. A block builds the part of the automaton that its texts can visit, and scores them.
Lists are by distinct n-gram and block, so frequent words weigh no more than rare ones, and no key is hot.

Training texts are those whose crc32(doc_id as text) mod 7 is not 2. Null or empty text: the end token alone. Null
doc_ids are read as held-out texts with an empty id. Repeated rows count each. Other columns are not read. An empty table
gives no rows. With no training text every word is unknown."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voxtable.functions.stage import stage

from .common import shuffle_partitions, table
from .tokens import Words, mix, words

ORDER, STRENGTH = 2, 30.0
#: Bytes of text in a block, on average.
BLOCK = 12 << 20
_END = np.uint64(0x2545F4914F6CDD1D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def token_stream(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows, an end token behind each row, and where the rows begin (and end)."""
    rows = len(w.first) - 1
    first = w.first + np.arange(rows + 1)
    out = np.full(first[-1], _END, np.uint64)
    keep = np.ones(first[-1], bool)
    keep[first[1:] - 1] = False
    out[keep] = w.hash
    return out, first


def grams_of(tokens: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length from 1 to order the hash of the n-gram that ends at each token; the history before a text is
    an end token, and n-grams that would reach further back are those of the longest history there is."""
    place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
    out = [tokens]
    before = np.concatenate([[_END], tokens[:-1]]).astype(np.uint64)
    before[place == 0] = _END
    for n in range(2, order + 1):
        # The (n-1)-gram that ended one token earlier, then this token.
        last = out[-1]
        history = before if n == 2 else np.concatenate([last[:1], last[:-1]])
        g = mix(history * _STEP + tokens + np.uint64(n))
        if n > 2:
            g = np.where(place < n - 2, last, g)
        out.append(g)
    return out


def _lists(order: int, buckets: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = [[] for _ in range(order)]
        for held, rows in group.groupby("held"):
            for w in words(pa.array(rows["text"], pa.large_string())):
                tokens, first = token_stream(w)
                for n, g in enumerate(grams_of(tokens, first, order)):
                    seen, c = np.unique(g, return_counts=True)
                    found[n].append((seen, np.zeros(len(c), np.int64) if held else c))
        out = []
        for n, parts in enumerate(found):
            key, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(key)).astype(np.uint32)
            part = (key >> np.uint64(40)) % np.uint64(buckets)
            by = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by], np.arange(buckets + 1))
            for b in range(buckets):
                at = by[cut[b]:cut[b + 1]]
                if len(at):
                    out.append((int(group["block"].iloc[0]), n + 1, b, key[at].tobytes(), count[at].tobytes()))
        return pd.DataFrame(out, columns=["block", "n", "bucket", "grams", "counts"])
    return run


def _totals(group: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of the n-grams of a bucket, in the order in which each block listed them. A row with block -1
    has the number of distinct known n-grams and the sum of their counts."""
    keys = [np.frombuffer(x, np.uint64) for x in group["grams"]]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, np.uint32) for x in group["counts"]]))
    known = int((total > 0).sum())
    each = total[inverse].astype(np.uint64)
    cut = np.cumsum([len(k) for k in keys])[:-1]
    narrow = "<u4" if total.max(initial=0) < 1 << 32 else "<u8"
    n, bucket = int(group["n"].iloc[0]), int(group["bucket"].iloc[0])
    rows = [(int(b), n, bucket, x.astype(narrow).tobytes(), narrow, 0, 0) for b, x in zip(group["block"], np.split(each, cut))]
    rows.append((-1, n, bucket, b"", narrow, known, int(total.sum())))
    return pd.DataFrame(rows, columns=["block", "n", "bucket", "counts", "kind", "known", "tokens"])


class BackoffAutomaton:
    """The states and arcs that a set of texts can visit.

    counts: for each length the sorted n-gram hashes and their corpus counts (0: not in the model)."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], tokens: int, known: int, strength: float):
        self.counts, self.tokens, self.known, self.strength = counts, tokens, known, strength

    def _count(self, n: int, g: np.ndarray) -> np.ndarray:
        key, count = self.counts[n - 1]
        at = np.minimum(np.searchsorted(key, g), max(len(key) - 1, 0))
        return np.where(key[at] == g, count[at], 0).astype(np.float64) if len(key) else np.zeros(len(g))

    def traverse(self, tokens: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """log10 weight of the path taken at every token, and the count of the token itself.

        The state before a token is its longest seen history; a token's weight is that of its arc from there or of
        the failure arcs down to the state that has it. All histories being at hand, the states of all tokens are
        found at once, from the root up."""
        own = grams_of(tokens, first, order)
        c = self._count(1, own[0])
        p = (c + 1) / (self.tokens + self.known + 1)
        place = np.arange(len(tokens)) - np.repeat(first[:-1], np.diff(first))
        for n in range(2, order + 1):
            # Count of the history: the (n-1)-gram that ended one token earlier; before a text, the end token.
            ended = self._count(n - 1, own[n - 2])
            state = np.concatenate([[0.0], ended[:-1]])
            state[place == 0] = self._count(1, np.array([_END]))[0] if n == 2 else 0.0
            arc = self._count(n, own[n - 1])
            if n > 2:
                reach = place >= n - 2
                state, arc = np.where(reach, state, 0.0), np.where(reach, arc, 0.0)
            p = np.where(state > 0, (arc + self.strength * p) / (state + self.strength), p)
        return np.log10(p), c


def _scorer(order: int, strength: float, buckets: int, tokens: int, known: int):
    def run(docs: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame({"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []})
        # The n-grams of the block, as it listed them.
        texts = pa.array(docs["text"], pa.large_string())
        every: list[list[np.ndarray]] = [[] for _ in range(order)]
        for w in words(texts):
            for n, g in enumerate(grams_of(*token_stream(w), order)):
                every[n].append(np.unique(g))
        counts = []
        for n in range(order):
            key = np.unique(np.concatenate(every[n]))
            part = (key >> np.uint64(40)) % np.uint64(buckets)
            by = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[by], np.arange(buckets + 1))
            total = np.zeros(len(key), np.int64)
            mine = values[values["n"] == n + 1]
            for b, raw, kind in zip(mine["bucket"], mine["counts"], mine["kind"]):
                total[by[cut[b]:cut[b + 1]]] = np.frombuffer(raw, kind)
            counts.append((key, total))
        automaton = BackoffAutomaton(counts, tokens, known, strength)
        n_tokens, n_known, base, score = [], [], [], []
        for w in words(texts):
            stream, first = token_stream(w)
            weight, c = automaton.traverse(stream, first, order)
            at = first[:-1]
            n_tokens.append(np.diff(first))
            n_known.append(np.add.reduceat((c > 0).astype(np.int64), at))
            base.append(np.add.reduceat(np.log10((c + 1) / (tokens + known + 1)), at))
            score.append(np.add.reduceat(weight, at))
        return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": docs["held"], "n_tokens": np.concatenate(n_tokens), "n_known": np.concatenate(n_known),
                             "train_tokens": np.full(len(docs), tokens, np.int64), "base_score": np.concatenate(base), "score": np.concatenate(score)})
    return run


def score_texts(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0]
    blocks = max(1, -(-(size or 0) // BLOCK))
    dealt = plain.select("doc_id", "text", held_out().alias("held"), F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(blocks)).cast("int").alias("block")).repartition(parts, "block")
    lists = dealt.groupBy("block").applyInPandas(_lists(order, parts), "block int, n int, bucket int, grams binary, counts binary")
    totals = stage(lists.groupBy("n", "bucket").applyInPandas(_totals, "block int, n int, bucket int, counts binary, kind string, known bigint, tokens bigint"), "counts")
    seen = totals.where("block = -1 and n = 1").agg(F.sum("known"), F.sum("tokens")).first()
    known, tokens = seen[0] or 0, seen[1] or 0
    values = totals.where("block >= 0").select("block", "n", "bucket", "counts", "kind")
    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("block").cogroup(values.groupBy("block")).applyInPandas(_scorer(order, strength, parts, tokens, known), out)


def op2_backoff_automaton(spark, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"))
