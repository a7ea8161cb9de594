"""Ranked lexical search of annotation texts by a document scan: no index of the texts, but one automaton of all wanted terms."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from mesograph.llm.common import process_state

# Terms of one automaton; the terms of more items are dealt to several, which scan the texts one after the other.
TERMS_TOGETHER = 200_000
# Numbers in the table of scores of a batch (texts by items).
SCORES_TOGETHER = 2_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Each byte of a text: letters and digits stay (A-Z in lower case), all other ASCII is a boundary; bytes above are parts of letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000


def folded(text: str | None) -> bytes:
    """UTF-8 bytes of a text with A-Z in lower case and one space for each ASCII character that is no letter or digit."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


@dataclass(frozen=True)
class Block:
    """Items whose terms share one automaton: terms as bytes; term t stands in items[starts[t]:starts[t + 1]], numbered within the block."""

    terms: list[bytes]
    starts: np.ndarray
    items: np.ndarray
    ids: list


def item_blocks(items: DataFrame, item_id: str, text: str, limit: int) -> list[Block]:
    """Items with their distinct terms, brought to the driver: the query set, whose size the caller bounds; rows of one item_id are one item."""
    rows = items.select(item_id, text).collect()
    by_item: dict = {}
    for item, words in rows:
        by_item.setdefault(item, set()).update(folded(words).split())
    blocks, now, held = [], [], 0
    for item, words in by_item.items():
        if now and held + len(words) > limit:
            blocks.append(now)
            now, held = [], 0
        now.append((item, words))
        held += len(words)
    blocks += [now] if held else []
    built = []
    for part in blocks:
        terms = sorted(set().union(*(w for _, w in part)))
        number = {t: i for i, t in enumerate(terms)}
        pairs = sorted((number[w], i) for i, (_, words) in enumerate(part) for w in words)
        owner = np.array([t for t, _ in pairs], np.int64)
        built.append(Block(terms, np.searchsorted(owner, np.arange(len(terms) + 1)), np.array([i for _, i in pairs], np.int64), [item for item, _ in part]))
    return built


def automaton(terms: list[bytes]):
    """Aho-Corasick automaton of the terms with a boundary on both sides, so that it meets whole terms only; its outputs are term numbers."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for number, term in enumerate(terms):
        machine.add_word(f" {term.decode('latin-1')} ", number)
    machine.make_automaton()
    return machine


def machines(blocks: list[Block], owner: str) -> list:
    """The automatons of a search, built once per Python worker."""
    state = process_state(owner)
    if "machines" not in state:
        state["machines"] = [automaton(b.terms) for b in blocks]
    return state["machines"]


def term_counts(machine, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(term numbers, occurrences) in a folded text."""
    found = np.fromiter((number for _, number in machine.iter(f" {text.decode('latin-1')} ")), np.int64)
    return np.unique(found, return_counts=True) if len(found) else (found, found)


@dataclass(frozen=True)
class Totals:
    """Texts with a term, their terms with repeats, and per block the texts that hold each term."""

    texts: int
    terms: int
    frequency: list[np.ndarray]

    def weights(self) -> list[np.ndarray]:
        return [np.array([math.floor(1000 * math.log((2 * self.texts + 2) / (2 * int(df) + 1))) for df in part], np.int64) for part in self.frequency]


def corpus_totals(texts: DataFrame, blocks: list[Block], owner: str) -> Totals:
    """One scan that counts; each task gives one row per term that it met, and the driver gets one number per term of the items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = machines(blocks, owner)
        held, terms = 0, 0
        frequency = [np.zeros(len(b.terms), np.int64) for b in blocks]
        for batch in batches:
            for row in range(batch.num_rows):
                text = folded(batch.column(0)[row].as_py())
                n = len(text.split())
                held, terms = held + (n > 0), terms + n
                for machine, part in zip(found, frequency):
                    part[term_counts(machine, text)[0]] += 1
        met = [np.flatnonzero(part) for part in frequency]
        block = np.concatenate([np.array([-1, -1]), *[np.full(len(m), i) for i, m in enumerate(met)]])
        term = np.concatenate([np.array([0, 1]), *met])
        number = np.concatenate([np.array([held, terms]), *[part[m] for part, m in zip(frequency, met)]])
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (block, term, number)], ["block", "term", "number"])

    counted = texts.mapInArrow(count, "block long, term long, number long").groupBy("block", "term").agg(F.sum("number").alias("number"))
    frequency, sums = [np.zeros(len(b.terms), np.int64) for b in blocks], [0, 0]
    for block, term, number in counted.collect():
        if block < 0:
            sums[term] = number
        else:
            frequency[block][term] = number
    return Totals(sums[0], sums[1], frequency)


class Best:
    """The highest-scoring texts of each item so far: score, then text id ascending (a null id last)."""

    def __init__(self, items: int, most: int):
        self.most = most
        self.rows: list[list[tuple]] = [[] for _ in range(items)]
        self.floor = np.zeros(items, np.int64)

    def add(self, scores: np.ndarray, ids: list) -> None:
        """Scores of some texts (rows) for all items (columns)."""
        for item in np.flatnonzero((scores > 0).any(axis=0) & (scores.max(axis=0) >= self.floor)):
            column = scores[:, item]
            rows = np.flatnonzero((column > 0) & (column >= self.floor[item]))
            merged = self.rows[item] + [(-int(column[r]), ids[r] is None, 0 if ids[r] is None else ids[r]) for r in rows]
            merged.sort()
            self.rows[item] = merged[:self.most]
            if len(merged) >= self.most:
                self.floor[item] = -merged[self.most - 1][0]


def search_labels(annotations: DataFrame, items: DataFrame, ann_id: str = "ann_id", text: str = "label", item_id: str = "item_id",
                  item_text: str = "text", most: int = 10, terms_together: int = TERMS_TOGETHER) -> DataFrame:
    """The `most` text annotations (ann_id, label) that fit each item (item_id, text) best: item_id, rank (from 1), ann_id, score.

    Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case.  A term's weight is floor(1000 ln((2N + 2) / (2 df + 1)))
    for N texts with a term, df of them with this one.  A text of n terms has the measure m = 10 + (90 n N div L), L being all terms of all texts; it scores
    weight * (1000000000 tf div (1000 tf + 8 m)) for each distinct term of the item, in whole numbers.  Scores above 0 are ranked, equal ones by
    ascending ann_id (null last); rows of the same ann_id are ranked each by itself.

    The texts are scanned twice, once for N, L and df, once for scores, by an Aho-Corasick automaton of all items' terms between boundaries; a term's output leads to
    its items.  Nothing is kept per text.  The items are the query set: their terms, and one number for each, are held by the driver and by every task, so their number must be
    bounded (about 200 bytes a term); beyond `terms_together` terms they are dealt to several automatons.  A task passes on `most` texts an item.

    Null and wordless texts have no terms and are in no list; an item without terms has none; rows of one item_id are one item with the terms
    of all of them, a null item_id included.  Empty tables give an empty one; other columns are not used.
    """
    spark = annotations.sparkSession
    schema = StructType([StructField("item_id", items.schema[item_id].dataType), StructField("ann_id", annotations.schema[ann_id].dataType), StructField("score", LongType())])
    blocks = item_blocks(items, item_id, item_text, terms_together)
    texts = annotations.select(F.col(text).cast("string").alias("text"), F.col(ann_id).alias("ann_id"))
    if not blocks:
        return spark.createDataFrame([], schema).select("item_id", F.lit(0).alias("rank"), F.col("ann_id").alias(ann_id), "score").withColumnRenamed("item_id", item_id)
    owner = f"search-{uuid.uuid4().hex}"
    totals = corpus_totals(texts.select("text"), blocks, owner)
    weights = totals.weights()
    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = machines(blocks, owner)
        best = [Best(len(b.ids), most) for b in blocks]
        for batch in batches:
            for machine, block, weight, top in zip(found, blocks, weights, best):
                step = max(1, SCORES_TOGETHER // len(block.ids))
                for first in range(0, batch.num_rows, step):
                    part = batch.slice(first, step)
                    scores = np.zeros((part.num_rows, len(block.ids)), np.int64)
                    for row in range(part.num_rows):
                        data = folded(part.column(0)[row].as_py())
                        terms, tf = term_counts(machine, data)
                        if len(terms):
                            m = 10 + 90 * len(data.split()) * totals.texts // totals.terms
                            worth = weight[terms] * ((SCALE * tf) // (1000 * tf + 8 * m))
                            begin, size = block.starts[terms], block.starts[terms + 1] - block.starts[terms]
                            places = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
                            np.add.at(scores[row], block.items[places], np.repeat(worth, size))
                    top.add(scores, part.column(1).to_pylist())
        rows = [(block.ids[i], None if null else ident, -score) for block, top in zip(blocks, best) for i, held in enumerate(top.rows) for score, null, ident in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], arrow.names)

    ordered = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("ann_id"))
    ranked = texts.mapInArrow(scan, schema).withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= most)
    return ranked.select(F.col("item_id").alias(item_id), "rank", F.col("ann_id").alias(ann_id), "score")
