"""Token ids of annotation texts in files of canonical Huffman codes, in order of id, and their decoding."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from mesograph.llm.common import TaskFile, discard, filesystem, process_state, stored
from mesograph.session import shuffle_width

MAGIC = b"MGHC2\n"
FRAME = "<QQQI"
LONGEST_CODE = 18
CHECKPOINT = 256
BLOCK_TOKENS = 1 << 20
KEPT_WORDS = 800_000
MARKS = ".,;:!?*%#$&()"
MANIFEST = "part int, file string, rows long, tokens long, bytes long"


# --- encoding texts ---------------------------------------------------------------------------------------------------------------

class Codes(dict):
    """Numbers for words in order of first sight; words whose ids aren't known yet wait in `fresh`.  Where the tokenizer lower-cases, an
    ASCII word shares the number of its lower-case form."""

    def __init__(self, lower: bool):
        super().__init__()
        self.lower, self.fresh, self.count = lower, [], 0

    def __missing__(self, word: str) -> int:
        if self.lower and word.isascii() and (low := word.lower()) != word:
            code = self[word] = self[low]
            return code
        code = self[word] = self.count
        self.count += 1
        self.fresh.append(word)
        return code


class Words:
    """Ids of words of text, each word through the tokenizer once, in bounded memory."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        normalizer = self.tokenizer.normalizer
        self.lower = normalizer is not None and all(t.content == t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()) and normalizer.normalize_str("A") == "a"
        # Only where white space parts words and leaves nothing behind are the ids of a text those of its words.
        self.by_word = self._ids(["a b", "a\nb", " a  b "]) == 3 * [[i for found in self._ids(["a", "b"]) for i in found]] and self._ids([" ", ""]) == [[], []]
        # A run of marks behind letters is a piece of its own: asked for each mark, after letters of several kinds and in runs.
        self.parts_marks = self.by_word and all(self._ids([f"{w}{m}"])[0] == [i for found in self._ids([w, m]) for i in found]
                                                for mark in MARKS for m in (mark, mark + MARKS[0], MARKS[0] + mark, 3 * mark) for w in ("abc", "\xe9t\xe9", "\u0436", "\u6f22"))
        # Whether ASCII letters reach the model as they are, but for their case: then the model itself is asked, without the steps before it.
        model = self.tokenizer.model
        self.plain_ascii = self.by_word and all([t.id for t in model.tokenize(w.lower() if self.lower else w)] == self._ids([w])[0]
                                                for w in ("a", "Z", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "microscopy", "Particle", "qxzjv", "in", "theand"))
        self._forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.codes = Codes(self.lower)
        self.codes[None], self.codes.count = 0, 1  # the end of a text
        self.flat, self.begin, self.size = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id behind, and the number of each text."""
        if not self.by_word:
            found = self._ids([t or "" for t in texts])
            return (np.fromiter(chain.from_iterable(chain(ids, (self.end_id,)) for ids in found), np.uint32), np.array([len(ids) + 1 for ids in found], np.int64))
        if len(self.codes) > KEPT_WORDS:
            self._forget()
        look = self.codes.__getitem__
        codes = []
        for text in texts:
            words = text.replace("\n", " ").split(" ") if text else []
            words.append(None)
            codes.append(np.fromiter(map(look, words), np.int64, len(words)))
        self._learn()
        every = np.concatenate(codes)
        sizes = self.size[every]
        ends = np.cumsum(sizes)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.begin[every] - ends + sizes, sizes)]
        last = np.cumsum([len(c) for c in codes]) - 1
        return ids, np.diff(ends[last], prepend=0)

    def _learn(self) -> None:
        fresh = self.codes.fresh
        if not fresh:
            return
        joined = []
        if self.parts_marks:
            # Letters with marks behind them are two pieces; many words differ by their marks only, so the letters go through once.
            code = self.codes.__getitem__
            for i in range(len(fresh)):
                word = fresh[i]
                if not word.isalpha() and (letters := word.rstrip(MARKS)) and letters.isalpha():
                    joined.append((i, code(letters), code(word[len(letters):])))
        filled = len(self.flat)
        begin, size = np.full(len(fresh), -1), np.zeros(len(fresh), np.int64)
        flat = [self.flat]
        # In tokenizers that mark the last token of a piece, many words of letters go through as one text.
        letters_only = [i for i, w in enumerate(fresh) if w.isalpha()] if self.closes.any() else []
        if self.plain_ascii:
            straight = [i for i in letters_only if fresh[i].isascii()]
            tokenize = self.tokenizer.model.tokenize
            found = [[t.id for t in tokenize(fresh[i].lower() if self.lower else fresh[i])] for i in straight]
            size[straight] = [len(f) for f in found]
            begin[straight] = filled + np.cumsum(size[straight]) - size[straight]
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(size[straight].sum())))
            filled += len(flat[-1])
        plain = np.array([i for i in letters_only if begin[i] < 0], np.int64)
        for start in range(0, len(plain), 10_000):
            places = plain[start:start + 10_000]
            ids = np.array(self._ids([" ".join([fresh[i] for i in places])])[0], np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(places) and ends[-1] == len(ids):  # else some word was more pieces than one
                size[places] = np.diff(ends, prepend=0)
                begin[places] = filled + ends - size[places]
                flat.append(ids)
                filled += len(ids)
        begin[[i for i, _, _ in joined]] = 0
        rest = np.flatnonzero(begin < 0)
        if len(rest):
            found = self._ids([fresh[i] for i in rest])
            size[rest] = [len(f) for f in found]
            begin[rest] = filled + np.cumsum(size[rest]) - size[rest]
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(size[rest].sum())))
            filled += len(flat[-1])
        if joined:
            places, letters, marks = np.array(joined).T
            every = np.concatenate(flat)
            begins, sizes = np.concatenate([self.begin, begin]), np.concatenate([self.size, size])
            # Letters that became several pieces may have other signs at their end, which join the marks.
            closing = np.concatenate([[0], np.cumsum(self.closes[every])])
            one = closing[begins[letters] + sizes[letters]] - closing[begins[letters]] == 1
            odd = places[~one]
            if len(odd):
                found = self._ids([fresh[i] for i in odd])
                size[odd] = [len(f) for f in found]
                begin[odd] = filled + np.cumsum(size[odd]) - size[odd]
                every = np.concatenate([every, np.fromiter(chain.from_iterable(found), np.uint32, int(size[odd].sum()))])
                filled = len(every)
            places, letters, marks = places[one], letters[one], marks[one]
            size[places] = sizes[letters] + sizes[marks]
            begin[places] = filled + np.cumsum(size[places]) - size[places]
            pairs = np.column_stack([letters, marks]).ravel()
            ends = np.cumsum(sizes[pairs])
            flat = [every, every[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[pairs] - ends + sizes[pairs], sizes[pairs])]]
        self.flat, self.begin, self.size = np.concatenate(flat), np.concatenate([self.begin, begin]), np.concatenate([self.size, size])
        fresh.clear()


def encode_labels(annotations: DataFrame, tokenizer_path: str, end_id: int, ann_id: str = "ann_id", text: str = "label") -> DataFrame:
    """(ann_id, n_tokens, token_ids) of text annotations: ids of the whole text by the tokenizers library without special tokens, then
    `end_id`, as little-endian unsigned 32-bit integers.

    Where the tokenizer drops white space (asked of it first) the text is cut at spaces and line feeds and each distinct word of a batch is
    encoded once; other tokenizers get whole texts.
    Null texts count as empty and have the end id only.
    """
    kind = annotations.schema[ann_id].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = process_state("token_ids").get(("words", tokenizer_path, end_id))
        if words is None:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
            words = process_state("token_ids")[("words", tokenizer_path, end_id)] = Words(tokenizer_path, end_id)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                ids, counts = words.encode(part.column(1).to_pylist())
                data, ends = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(4 * counts)]).tolist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array([data[a:b] for a, b in zip(ends, ends[1:])], pa.binary())],
                                                 ["id", "n_tokens", "token_ids"])

    return (annotations.select(F.col(ann_id).alias("id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(encode, f"id {kind}, n_tokens long, token_ids binary").withColumnRenamed("id", ann_id))


# --- codes ------------------------------------------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of an optimal prefix code with no code over `longest` bits (package-merge); ids that don't occur have length 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(len(used) - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64) if counts.sum() >= 1 << 53 else counts[used].astype(np.int64)
    packages, leaf_rows = weights[:0], []
    for _ in range(longest):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        leaf_rows.append(order < len(weights))
        merged = merged[order]
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(used) - 2
    depth = np.zeros(len(used), np.int64)
    for leaves in reversed(leaf_rows):
        chosen = int(leaves[:take].sum())
        depth[:chosen] += 1  # leaves come in order of weight
        take = 2 * (take - chosen)
    lengths[used] = depth
    return lengths


class Code:
    """Canonical code: codes ascend by length, then by id, so the lengths alone give them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.longest = int(self.lengths.max(initial=1))
        order = np.lexsort((np.arange(len(lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        spans = np.int64(1) << (self.longest - self.lengths[order])
        self.order, self.spans = order, spans
        first = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (self.longest - self.lengths[order])).astype(np.uint64)

    def decoding_table(self) -> tuple[np.ndarray, np.ndarray]:
        """For each value of the next `longest` bits the id and the length of its code."""
        ids = np.zeros(1 << self.longest, np.uint32)
        sizes = np.ones(1 << self.longest, np.int64)
        filled = np.repeat(self.order, self.spans)
        ids[:len(filled)] = filled
        sizes[:len(filled)] = self.lengths[filled]
        return ids, sizes

    def pack(self, ids: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
        """For consecutive runs of `counts` ids each: its bits, from a byte of their own, and the bit offsets of every 256th id."""
        sizes = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        first = np.concatenate([[0], np.cumsum(counts)])
        total = np.diff(ends[first])
        words_of = -(-total // 64)
        place = np.concatenate([[0], np.cumsum(words_of)])
        starts = ends[:-1] + np.repeat(place[:-1] * 64 - ends[first[:-1]], counts)
        words = np.zeros(int(place[-1]) + 1, np.uint64)
        at, shift = starts >> 6, starts & 63
        code = self.codes[ids]
        room = 64 - shift - sizes
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        over = np.flatnonzero(room < 0)
        # Codes in one word don't overlap, so their sum is their union; at most one code reaches over into a word.
        if len(ids):
            turn = np.flatnonzero(np.diff(at, prepend=-1))
            words[at[turn]] = np.add.reduceat(high, turn)
            words[at[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
        data = words.astype(">u8").tobytes()
        return [(data[8 * p:8 * p + -(-int(t) // 8)], starts[f:f + n:CHECKPOINT] - 64 * p) for p, t, f, n in zip(place, total, first, counts)]

    def unpack(self, data: bytes, checkpoints: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Ids of the stretches that begin at the bits `checkpoints` and have `counts` (up to 256) ids, one behind the other.  All
        stretches are decoded side by side, a table look-up per id."""
        ids, sizes = table
        padded = np.frombuffer(data + b"\0" * 8, np.uint8)
        wide = np.zeros(len(padded) - 3, np.uint32)
        for k in range(4):
            wide = (wide << np.uint32(8)) | padded[k:len(padded) - 3 + k]
        order = np.argsort(-counts, kind="stable")
        at, held = checkpoints[order].astype(np.int64), counts[order]
        out = np.zeros((len(at), CHECKPOINT), np.uint32)
        active = np.searchsorted(-held, -np.arange(CHECKPOINT), side="left")
        down = np.uint32(32 - self.longest)
        for step in range(CHECKPOINT):
            n = active[step]
            if not n:
                break
            here = at[:n]
            key = (wide[here >> 3] << (here & 7).astype(np.uint32)) >> down
            out[:n, step] = ids[key]
            at[:n] = here + sizes[key]
        back = np.empty_like(out)
        back[order] = out
        return back[np.arange(CHECKPOINT) < counts[:, None]]


# --- files ------------------------------------------------------------------------------------------------------------------------

def _key_bytes(keys: Sequence) -> bytes:
    """Which keys are missing, then whole numbers as they are, or texts by their sizes and UTF-8 bytes."""
    missing = np.array([k is None for k in keys], np.uint8).tobytes()
    if not any(isinstance(k, str) for k in keys):
        return b"\0" + missing + np.array([k or 0 for k in keys], "<i8").tobytes()
    texts = [(k or "").encode("utf-8", "surrogatepass") for k in keys]
    return b"\1" + missing + np.array([len(t) for t in texts], "<i8").tobytes() + b"".join(texts)


def _keys(body: bytes, rows: int) -> tuple[list, int]:
    """Keys of a block and where the counts begin."""
    missing = np.frombuffer(body, np.uint8, rows, 1)
    numbers = np.frombuffer(body, "<i8", rows, 1 + rows)
    at = 1 + 9 * rows
    if body[0] == 0:
        return [None if m else int(k) for m, k in zip(missing, numbers)], at
    ends = (at + np.cumsum(numbers)).tolist()
    return [None if m else body[e - n:e].decode("utf-8", "surrogatepass") for m, n, e in zip(missing, numbers.tolist(), ends)], ends[-1] if ends else at


def _block(keys: Sequence[int | str | None], counts: Sequence[int], bits: Sequence[bytes], checkpoints: Sequence[bytes]) -> bytes:
    """Rows, ids, checkpoints and bits of some annotations; nothing of it depends on other blocks."""
    base = np.cumsum([0, *map(len, bits)]) * 8
    offsets = np.concatenate([np.frombuffer(c, "<i8") + b for c, b in zip(checkpoints, base)])
    body = b"".join([_key_bytes(keys), np.array(counts, "<i8").tobytes(), offsets.astype("<i8").tobytes(), *bits])
    return struct.pack(FRAME, len(keys), len(offsets), len(body), zlib.crc32(body)) + body


def _rows(body: bytes, rows: int, marks: int, code: Code, table: tuple[np.ndarray, np.ndarray]) -> tuple[list[int | str | None], np.ndarray, np.ndarray]:
    """Keys, counts and all ids of a block."""
    keys, at = _keys(body, rows)
    counts = np.frombuffer(body, "<i8", rows, at)
    checkpoints = np.frombuffer(body, "<i8", marks, at + 8 * rows)
    stretches = -(-counts // CHECKPOINT)
    held = np.full(marks, CHECKPOINT)
    held[np.cumsum(stretches) - 1] = counts - (stretches - 1) * CHECKPOINT
    return keys, counts, code.unpack(body[at + 8 * (rows + marks):], checkpoints, held, table)


def _header(lengths: np.ndarray) -> bytes:
    packed = zlib.compress(lengths.astype(np.uint8).tobytes(), 9)
    return MAGIC + struct.pack("<II", len(lengths), len(packed)) + packed


@dataclass(frozen=True)
class TokenFiles:
    """Written files: folder, per file its part, name, rows, tokens and bytes in ascending order of annotation id, and the ids' type (long or string)."""

    folder: str
    parts: tuple[tuple[int, str, int, int, int], ...]
    kind: str = "long"


def write_token_ids(annotations: DataFrame, tokenizer_path: str, folder: str, end_id: int, ann_id: str = "ann_id", text: str = "label",
                    vocabulary: int = 1 << 16) -> TokenFiles:
    """Encode text annotations (ann_id: a whole number or a text; other types are written as text; label) and write their ids, in ascending order of ann_id, as Huffman-coded files.

    Ids are made once and stored; their counts over all texts (one number per id of the vocabulary, added up in parts) give one code of
    limited length for all files.  Texts are then coded where they lie, and only coded rows are shuffled, by range of id.  A file holds
    the code lengths and blocks of about a million ids, each with its rows, bit-offset checkpoints and a checksum; it is renamed into
    place when whole.  Null ids come first; rows of equal id follow each other in order of length, then of a hash; an empty table writes no file.
    """
    work: list[str] = []
    later: list[str] = []
    kind = "long" if isinstance(annotations.schema[ann_id].dataType, IntegralType) else "string"
    encoded = stored(encode_labels(annotations, tokenizer_path, end_id, ann_id, text).select(F.col(ann_id).cast(kind).alias("key"), "n_tokens", "token_ids"), "ids", work)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=vocabulary)
            total = np.pad(total, (0, max(0, len(got) - len(total))))
            total[:len(got)] += got
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    # One row per id of the vocabulary.
    counted = encoded.select("token_ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([vocabulary, *(r["id"] + 1 for r in counted)]), np.int64)
    for row in counted:
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                ids = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u4")
                packed = code.pack(ids, part.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([bits for bits, _ in packed], pa.binary()),
                                                  pa.array([c.astype("<i8").tobytes() for _, c in packed], pa.binary())], ["key", "n_tokens", "bits", "checkpoints"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rows, tokens, held, pending = None, 0, 0, 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if file is None:
                    file = TaskFile(folder, ".ids")
                    file.write(_header(lengths))
                pending.append(row)
                held += row[1]
                rows += 1
                tokens += row[1]
                if held >= BLOCK_TOKENS:
                    file.write(_block(*zip(*pending)))
                    held, pending = 0, []
        if file is not None:
            if pending:
                file.write(_block(*zip(*pending)))
            yield pa.RecordBatch.from_pydict({"part": pa.array([file.part], pa.int32()), "file": [file.close()], "rows": [rows], "tokens": [tokens], "bytes": [file.size]})

    # Drawing range bounds reads its input once more, so the coded rows are stored, and the ids go.
    coded = stored(encoded.mapInArrow(pack, f"key {kind}, n_tokens long, bits binary, checkpoints binary"), "coded", later)
    discard(work)
    # Range bounds are drawn from a sample of the sorting columns, so the tie-break is a hash and not the bits.
    order = ["key", "n_tokens", "tie"]
    placed = (coded.withColumn("tie", F.xxhash64("bits")).repartitionByRange(shuffle_width(annotations.sparkSession), *order)
              .sortWithinPartitions(*order).drop("tie"))
    manifest = placed.mapInArrow(write, MANIFEST).collect()
    discard(later)
    return TokenFiles(folder, tuple(sorted((r.part, r.file, r.rows, r.tokens, r.bytes) for r in manifest)), kind)


def read_token_ids(spark: SparkSession, files: TokenFiles, ann_id: str = "ann_id") -> DataFrame:
    """Read the files back: ann_id, start (ids of all annotations before this one), n_tokens and token_ids (binary, as they went in).

    One task per file goes through it block by block; every block is checked and decoded by itself.  A damaged block raises ValueError
    with the file's name.  No files give no rows.
    """
    before = np.cumsum([0, *[p[3] for p in files.parts]]).tolist()
    listed = spark.createDataFrame([(p[1], b) for p, b in zip(files.parts, before)], "file string, before long").repartition(max(1, len(files.parts)))
    folder, kind = files.folder, pa.int64() if files.kind == "long" else pa.string()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, base = filesystem(folder)
                with store.open_input_stream(f"{base}/{name}") as stream:
                    if stream.read(len(MAGIC)) != MAGIC:
                        raise ValueError(f"{name}: not a token file")
                    size, packed = struct.unpack("<II", stream.read(8))
                    code = Code(np.frombuffer(zlib.decompress(stream.read(packed)), np.uint8, size))
                    table = code.decoding_table()
                    while frame := stream.read(struct.calcsize(FRAME)):
                        rows, marks, length, check = struct.unpack(FRAME, frame)
                        body = stream.read(length)
                        if len(body) != length or zlib.crc32(body) != check:
                            raise ValueError(f"{name}: damaged block")
                        keys, counts, ids = _rows(body, rows, marks, code, table)
                        ends = np.cumsum(counts)
                        data = ids.astype("<u4").tobytes()
                        texts = [data[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                                                          pa.array(texts, pa.binary())], ["key", "start", "n_tokens", "token_ids"])
                        start += int(ends[-1])

    return listed.mapInArrow(read, f"key {files.kind}, start long, n_tokens long, token_ids binary").withColumnRenamed("key", ann_id)
