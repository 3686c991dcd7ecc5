"""Packing token sequences by minimum bin slack.

1. A text becomes the ids of a byte-level BPE tokenizer and an end id. A sequence longer than the bin is cut into
   pieces of the bin's size, the first of which may be shorter.
2. Pieces differ only by length, so packing needs no more than the number of pieces of each length: one row per
   length, at most as many rows as a bin has places, whatever the size of the input.
3. Minimum bin slack on these counts: the longest remaining piece opens a bin, and a subset-sum program over bitsets of
   the remaining lengths finds the fullest feasible filling. The same filling is the answer for the next bins, too, as
   long as its lengths last, so it is taken that many times at once. Each step uses up a length; so there are at most
   as many fillings as lengths, and the plan's size is bounded.
4. Every piece gets a rank among those of its length (its place in its partition, plus what earlier partitions hold) and
   finds its bin and offset in the plan by that rank. No group of rows is ever gathered.

Null or empty text: the end id alone, one piece of length 1. Null doc_ids stay null. Repeated rows are packed each.
Other columns are not read. An empty table gives no rows."""
from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from voxtable.functions.stage import stage

from .common import table
from .tokens import PIECE, PLAIN, buffers, pieces, range_hash

BIN, END = 1024, 2
#: Units whose ids a task remembers.
REMEMBERED = 400_000
_GAP = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: White space of the splitting pattern beyond the gaps between units.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts, equal to those of the tokenizers library for a byte-level BPE file.

    White space begins a new pre-token of such a tokenizer, so a text may be encoded in units of white space and the
    word behind it. Texts come in batches; each unit that differs is encoded once."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = _bytes_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.bpe = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._forget()

    def _forget(self) -> None:
        self.known, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.bpe.encode(text, allowed_special="all"), np.uint32)

    def _learn(self, h: np.ndarray, texts: list[str]) -> None:
        """Adds the ids of new units; h is sorted."""
        if len(self.known) > REMEMBERED:
            self._forget()
        new = [self._whole(t) for t in texts]
        known = np.concatenate([self.known, h])
        size = np.concatenate([np.diff(self.at), [len(x) for x in new]]).astype(np.int64)
        start = np.cumsum(size) - size
        flat = np.concatenate([self.ids, *new])
        by = np.argsort(known, kind="stable")
        self.known, n = known[by], size[by]
        self.at = np.concatenate([[0], np.cumsum(n)])
        self.ids = flat[np.repeat(start[by] - self.at[:-1], n) + np.arange(self.at[-1])]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between the offsets, and where each text's ids begin (and end)."""
        lo = int(offsets[0])
        part, edges = data[lo:int(offsets[-1])], offsets - lo
        gap = _GAP[part]
        ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1 if len(part) else np.zeros(0, np.int64)
        cuts = np.unique(np.concatenate([ends, edges]))
        start, end = cuts[:-1], cuts[1:]
        h = range_hash(part, start, end, PLAIN)
        seen, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, seen), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[place] != seen) if len(self.known) else np.arange(len(seen))
        if len(new):
            if len(self.known) > REMEMBERED:
                new = np.arange(len(seen))
            raw = part.tobytes()
            self._learn(seen[new], [raw[start[i]:end[i]].decode("utf-8", "replace") for i in first[new]])
            place = np.searchsorted(self.known, seen)
        at, size = self.at[place][inverse], (self.at[place + 1] - self.at[place])[inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(cuts, edges)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The process's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _stretches(part: np.ndarray, size: int) -> list[int]:
    """Edges of stretches of a long text that end behind a word, of about so many bytes each."""
    edges, at = [0], 0
    while len(part) - at > size:
        lo = at + size
        while lo < len(part):
            gap = _GAP[part[lo - 1:lo + size]]
            ends = np.flatnonzero(~gap[:-1] & gap[1:])
            if len(ends):
                break
            lo += size
        if lo >= len(part):
            break
        at = lo + int(ends[0])
        edges.append(at)
    return [*edges, len(part)]


def _long(encoder: Encoder, part: np.ndarray) -> np.ndarray:
    """Ids of one long text, stretch by stretch; white space begins a new pre-token, so ids do not span a stretch's end."""
    edges = _stretches(part, PIECE)
    return np.concatenate([encoder.encode(part, np.array(e, np.int64))[0] for e in zip(edges[:-1], edges[1:])])


def encode_texts(encoder: Encoder, column: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text of a string column."""
    data, offsets = buffers(column)
    for rows in pieces(offsets):
        edges = offsets[rows.start:rows.stop + 1]
        if len(edges) == 2 and edges[1] - edges[0] > PIECE:
            ids = _long(encoder, data[edges[0]:edges[1]])
            at = np.array([0, len(ids)])
        else:
            ids, at = encoder.encode(data, edges)
        part = data[edges[0]:edges[-1]]
        # Only bytes from 0x1C on can begin odd white space; plain ASCII text has none.
        odd = bool(((part >= 0x1C) & (part < 0x20) | (part == 0xC2) | (part >= 0xE1) & (part <= 0xE3)).any())
        for k in range(len(edges) - 1):
            if odd:
                text = part[edges[k] - edges[0]:edges[k + 1] - edges[0]].tobytes().decode("utf-8", "replace")
                if _ODD.search(text):
                    yield encoder._whole(text)
                    continue
            yield ids[at[k]:at[k + 1]]


def _cutter(path: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(path), TaskContext.get().partitionId()
        used = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows, out = [], []
            for i, ids in enumerate(encode_texts(encoder, batch.column(1))):
                ids = np.append(ids, np.uint32(end)).astype("<u4")
                start, k = 0, 0
                stop = len(ids) % size or min(size, len(ids))
                while start < len(ids):
                    rows.append(i)
                    out.append((k, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), used[stop - start]))
                    used[stop - start] += 1
                    k, start, stop = k + 1, stop, stop + size
            if out:
                piece, start, length, crc, rank = (np.array(x, np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(out), part, np.int32)), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])
    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the given lengths, as many each as there are at most, those that fill the room best; longer ones first."""
    steps: list[tuple[int, int]] = []
    reach = [1]
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if counts[x] and x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left:
            take = min(many, left)
            steps.append((length, take))
            reach.append(reach[-1] | reach[-1] << length * take & mask)
            left, many = left - take, many * 2
        if reach[-1] >> room:
            break
    fill, out = reach[-1].bit_length() - 1, {}
    for i in range(len(steps) - 1, -1, -1):
        if not reach[i] >> fill & 1:
            length, take = steps[i]
            out[length] = out.get(length, 0) + take
            fill -= length * take
    return out


def plan(counts: dict[int, int], size: int = BIN) -> list[tuple[int, int, int, int, int, int]]:
    """For the pieces of each length in order of rank: (length, first rank, end rank, first bin, pieces per bin, offset).

    counts: pieces of each length from 1 to size."""
    counts = {x: n for x, n in counts.items() if n}
    used = dict.fromkeys(counts, 0)
    out, bins = [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        filling = fullest(counts, size - longest)
        counts[longest] += 1
        filling[longest] = filling.get(longest, 0) + 1
        times = min(counts[x] // k for x, k in filling.items())
        offset = 0
        for x in sorted(filling, reverse=True):
            k = filling[x]
            out.append((x, used[x], used[x] + k * times, bins, k, offset))
            used[x] += k * times
            offset += k * x
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
        bins += times
    return out


def _placer(steps: list[tuple]):
    """Bin and offset of rows (..., length, rank)."""
    steps = sorted(steps)
    t = np.array(steps, np.int64).reshape(-1, 6)
    # One increasing number for (length, rank); ranks stay below 2**50.
    key = (t[:, 0] << 50) + t[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            step = t[np.searchsorted(key, (length << 50) + rank, side="right") - 1]
            k = rank - step[:, 1]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(step[:, 3] + k // step[:, 4]), pa.array(step[:, 5] + k % step[:, 4] * length)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, size: int = BIN, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset). tokenizer: a byte-level BPE
    file, at the same place on every machine."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    cut = stage(plain.mapInArrow(_cutter(tokenizer, size, end), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"), "pieces")
    per = stage(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "per")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = stage(per.select("length", "part", F.coalesce(before, F.lit(0)).alias("base")), "base")
    # At most one row per length up to the bin's size.
    counts = {r[0]: r[1] for r in per.groupBy("length").agg(F.sum("n")).collect()}
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    return ranked.mapInArrow(_placer(plan(counts, size)), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op9_bin_slack(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
