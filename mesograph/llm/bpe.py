"""Byte-level BPE of annotation texts with a hierarchical-bitmap rank queue, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator, Mapping
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mesograph.llm.common import process_state

BLOCK_BITS = 8
KEPT_PIECES = 900_000
LONGEST_KEPT = 48
OUT_BYTES = 1 << 25


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Merges of one piece in order of rank.

    A bucket per merge rank holds the linked-list positions whose pair has that rank, the leftmost first.  One bit per bucket tells
    that it is not empty, one root bit per block of 256 tells that the block has such a bit; the lowest set bits of root and block give
    the next rank in two steps whatever the piece's length.  A position whose pair has changed stays in its old bucket and is
    skipped when it comes up.
    """

    def __init__(self, ranks: Mapping[bytes, int]):
        self.ranks = ranks
        self.blocks = [0] * ((max(ranks.values(), default=0) >> BLOCK_BITS) + 1)
        self.buckets: dict[int, list[int]] = {}

    def encode(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        rank_of = ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        blocks, buckets, root = self.blocks, self.buckets, 0
        size = len(piece)
        after, before, pair = list(range(1, size + 1)), list(range(-1, size)), [-1] * size
        mask = (1 << BLOCK_BITS) - 1
        fresh = []
        for i in range(size - 1):
            rank = rank_of(piece[i:i + 2])
            if rank is not None:
                fresh.append((i, rank))
        while True:
            for i, rank in fresh:
                pair[i] = rank
                bucket = buckets.get(rank)
                if bucket:
                    heappush(bucket, i)
                else:
                    buckets[rank] = [i]
                    block = rank >> BLOCK_BITS
                    blocks[block] |= 1 << (rank & mask)
                    root |= 1 << block
            fresh = []
            if not root:
                break
            block = (root & -root).bit_length() - 1
            bits = blocks[block]
            low = bits & -bits
            rank = (block << BLOCK_BITS) + low.bit_length() - 1
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                blocks[block] = bits = bits ^ low
                if not bits:
                    root ^= 1 << block
            if pair[i] != rank:
                continue
            gone = after[i]
            end = after[gone]
            after[i] = end
            pair[i] = pair[gone] = -1
            if end < size:
                before[end] = i
                rank = rank_of(piece[i:after[end]])
                if rank is not None:
                    fresh.append((i, rank))
            left = before[i]
            if left >= 0:
                pair[left] = -1
                rank = rank_of(piece[left:end])
                if rank is not None:
                    fresh.append((left, rank))
        out, i = [], 0
        while i < size:
            end = after[i]
            out.append(ranks[piece[i:end]])
            i = end
        return out


class Pieces(dict):
    """Ids of a piece of text as little-endian 32-bit integers; pieces seen before are looked up, in bounded memory."""

    def __init__(self, ranks: Mapping[bytes, int]):
        super().__init__()
        self.queue = RankQueue(ranks)

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.queue.encode(piece.encode()), "<u4").tobytes()
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def white_space_pattern(pattern: str):
    """The split pattern, with `\\s` as the Unicode property White_Space (this library's own `\\s` has four control characters more)."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def encode_labels(annotations: DataFrame, ranks_path: str, pattern: str, ann_id: str = "ann_id", text: str = "label") -> DataFrame:
    """Token ids of text annotations (ann_id, label): one row per input row with ann_id, n_tokens and token_ids, a binary of
    little-endian unsigned 32-bit integers.

    `pattern` splits a text into pieces (the label of an annotation is seldom long, but nothing limits it); each is encoded by itself:
    a piece that is a token is that token, else the pair of lowest rank is merged, leftmost first, until none has a rank.  Special
    tokens are ordinary text.  A null text counts as empty: 0 tokens.  Rows stay where they are (no shuffle); repeated rows and ids
    repeat, null ids pass through, other columns are not used.  Vocabularies without some single byte raise KeyError on it.
    `ranks_path` must be readable on every executor.
    """
    kind = annotations.schema[ann_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = process_state("bpe").setdefault("pieces", {})
        if ranks_path not in kept:
            kept.clear()
            kept[ranks_path] = read_ranks(ranks_path)
        pieces = process_state("bpe").get(("encoded", ranks_path))
        if pieces is None:
            pieces = process_state("bpe")[("encoded", ranks_path)] = Pieces(kept[ranks_path])
        split, look = white_space_pattern(pattern).findall, pieces.__getitem__
        for batch in batches:
            start, held, out = 0, 0, []
            for row, text_ in enumerate(batch.column(1)):
                ids = b"".join(map(look, split(text_.as_py() or "")))
                out.append(ids)
                held += len(ids)
                if held >= OUT_BYTES or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(out)), pa.array([len(x) // 4 for x in out], pa.int64()),
                                                      pa.array(out, pa.binary())], ["id", "n_tokens", "token_ids"])
                    start, held, out = row + 1, 0, []

    return (annotations.select(F.col(ann_id).alias("id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(encode, f"id {kind}, n_tokens long, token_ids binary").withColumnRenamed("id", ann_id))


def decode_labels(encoded: DataFrame, ranks_path: str, token_ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the decoded bytes of token_ids to rows of `encode_labels`; all columns of `encoded` stay.  Null ids give null, no ids give
    no bytes; an id that is not in the vocabulary raises KeyError."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != out)
    names = [f.name for f in encoded.schema if f.name != out]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: text for text, rank in read_ranks(ranks_path).items()}.__getitem__
        for batch in batches:
            start, held, found = 0, 0, []
            for row, ids in enumerate(batch.column(names.index(token_ids))):
                data = ids.as_py()
                found.append(None if data is None else b"".join(map(token, np.frombuffer(data, "<u4").tolist())))
                held += len(found[-1] or b"")
                if held >= OUT_BYTES or row + 1 == batch.num_rows:
                    part = batch.slice(start, len(found))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*names, out])
                    start, held, found = row + 1, 0, []

    return encoded.select(*names).mapInArrow(decode, f"{fields}, `{out}` binary")
