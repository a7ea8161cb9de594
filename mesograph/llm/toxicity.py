"""Toxic annotation texts by compression distance to two zstandard dictionaries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODE = 16
WINDOW_WORDS = 16
DICTIONARY_BYTES = 16384
LEAST_MATCH = 6
LEAST_DOCUMENTS = 3
LEAST_SHARE = 0.004
LEAST_RATIO = 20.0
WORD = re.compile(r"[^\W\d_]+")


def coded(words: Sequence[str]) -> bytes:
    """Each word as 16 bytes of hash, so that the compressor can only match whole words, and a word it doesn't know costs all of them."""
    from xxhash import xxh128_digest

    return b"".join([xxh128_digest(w) for w in words])


class Lengths:
    """Compressed length of a window behind a dictionary."""

    def __init__(self, dictionary: bytes):
        import zstandard as zstd

        settings = zstd.ZstdCompressionParameters.from_level(
            3, min_match=LEAST_MATCH, strategy=zstd.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
        if dictionary:
            known = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=settings)
            self.compress = zstd.ZstdCompressor(dict_data=known, compression_params=settings).compress
        else:
            self.compress = zstd.ZstdCompressor(compression_params=settings).compress

    def of(self, window: bytes) -> int:
        return len(self.compress(window))


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionary of ordinary text, of toxic text with the ordinary behind it, and the number of bytes from which a gap counts as toxic."""

    ordinary: bytes
    toxic: bytes
    threshold: float

    def scorer(self):
        """A function from text to score."""
        ordinary, toxic = Lengths(self.ordinary).of, Lengths(self.toxic).of
        step = CODE * WINDOW_WORDS

        def widest(text: str) -> int:
            data = coded(WORD.findall(text.lower()))
            return max((ordinary(w) - toxic(w) for w in (data[i:i + step] for i in range(0, len(data), step))), default=0)

        def score(text: str | None) -> float:
            gap = widest(text) if text else 0
            return float(1 / (1 + np.exp(-np.clip(gap - self.threshold, -30, 30))))

        score.gap = widest
        return score


def told_once(texts: Sequence[str]) -> list[list[str]]:
    """Words of each text without those in three-word runs that an earlier text had: copies and shared passages count once."""
    from xxhash import xxh64_intdigest

    seen: set[int] = set()
    out = []
    for text in texts:
        words = WORD.findall(text.lower())
        old = [False] * len(words)
        runs = [xxh64_intdigest(" ".join(words[i:i + 3])) for i in range(len(words) - 2)]
        for i, run in enumerate(runs):
            if run in seen:
                old[i:i + 3] = [True] * 3
        seen.update(runs)
        out.append([w for w, o in zip(words, old) if not o])
    return out


def dictionary(samples: Sequence[bytes]) -> bytes:
    """A zstandard dictionary trained on the samples; too few of them to train on are the dictionary themselves."""
    import zstandard as zstd

    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, list(samples), d=8, k=16).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def fit_model(toxic_texts: Sequence[str], ordinary_texts: Sequence[str]) -> ToxicityModel:
    """Train both dictionaries and calibrate the threshold on these texts.

    The toxic dictionary sees only the part of the toxic texts that sets them apart: words whose share of toxic texts is 20 times that of
    ordinary ones; the ordinary one sees words of one ordinary text in a hundred and more.  The threshold is the gap with the fewest errors
    on the same texts, each class counted alike, in the middle of the range of gaps that do equally well.
    """
    parts = [told_once(texts) for texts in (toxic_texts, ordinary_texts)]
    counts = [Counter(w for words in part for w in set(words)) for part in parts]
    sizes = [sum(map(bool, part)) for part in parts]
    apart = {w for w, n in counts[0].items() if n >= max(LEAST_DOCUMENTS, LEAST_SHARE * sizes[0])
             and n / sizes[0] >= LEAST_RATIO * (counts[1][w] + 1) / (sizes[1] + 1)}
    usual = {w for w, n in counts[1].items() if n >= max(LEAST_DOCUMENTS, 0.01 * sizes[1])}
    samples = [[coded([w for w in words if w in kept]) for words in part] for part, kept in zip(parts, (apart, usual))]
    toxic, ordinary = (dictionary([s for s in part if s]) for part in samples)
    model = ToxicityModel(ordinary, toxic + ordinary, 0.0)
    gap = model.scorer().gap
    gaps = [np.array([gap(t) for t in texts], dtype=float) for texts in (toxic_texts, ordinary_texts)]
    if not len(gaps[0]) or not toxic:
        return ToxicityModel(ordinary, toxic + ordinary, float(CODE * WINDOW_WORDS))
    cuts = np.arange(1, max(g.max(initial=1) for g in gaps) + 1)
    wrong = [(gaps[0] < c).mean() + ((gaps[1] >= c).mean() if len(gaps[1]) else 0.0) for c in cuts]
    best = cuts[np.isclose(wrong, min(wrong))]
    return ToxicityModel(ordinary, toxic + ordinary, float(best[len(best) // 2]) - 0.5)


def fit_on(annotations: DataFrame, labels: DataFrame, ann_id: str = "ann_id", text: str = "label", toxic: str = "toxic",
           sample: int = 2000, longest: int = 2_000_000, characters: int = 40_000_000) -> ToxicityModel:
    """Fit on labelled text annotations, each of them whole: at most `sample` of each class, those of smallest id hash, as long as they have
    `characters` characters together; texts of more than `longest` characters are no examples.

    These parameters bound what reaches the driver; labels other than 0 and 1 and rows without text are passed over.  Without
    a toxic example every score is 0.
    """
    named = labels.select(F.col(ann_id).alias("_id"), F.col(toxic).cast("int").alias("_toxic"))
    drawn = [named.where(F.col("_toxic") == t).dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(sample) for t in (1, 0)]
    # At most 2 * sample rows.
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    found = (annotations.select(F.col(ann_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(chosen, "_id")
             .withColumn("_size", F.length("_text")).where(F.col("_size") <= longest))
    so_far = F.sum("_size").over(Window.partitionBy("_toxic").orderBy(F.xxhash64("_id"), "_id", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = found.withColumn("_sum", so_far).where(F.col("_sum") <= characters).select("_id", "_text", "_toxic").collect()
    rows.sort(key=lambda r: (r["_id"], r["_text"]))
    return fit_model([r["_text"] for r in rows if r["_toxic"]], [r["_text"] for r in rows if not r["_toxic"]])


def score_column(model: ToxicityModel, text: str = "label") -> Column:
    """The score of `score_labels` as a column, for filters that keep whole rows."""
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for part in parts:
            yield pd.Series([of(t) for t in part], dtype="float64")

    return score(F.col(text).cast("string"))


def score_labels(annotations: DataFrame, model: ToxicityModel, ann_id: str = "ann_id", text: str = "label") -> DataFrame:
    """Toxicity of text annotations (ann_id, label): one row per input row with ann_id, score (0 to 1) and predicted (score >= 0.5).

    The whole text is cut into windows of 16 words (runs of letters, lower case); a window's gap is its compressed length behind the
    ordinary dictionary less that behind the toxic one, and the score rises with the widest gap around the calibrated threshold.  Null
    and empty texts have gap 0.  Rows stay in place; repeated rows and null ids are scored like others; other columns are not used.
    """
    kind = annotations.schema[ann_id].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            found = [of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())],
                                             ["id", "score", "predicted"])

    return (annotations.select(F.col(ann_id).alias("id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(score, f"id {kind}, score double, predicted int").withColumnRenamed("id", ann_id))
