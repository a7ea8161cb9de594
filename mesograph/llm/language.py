"""Language of annotation texts, word by word, with spans in mixed texts."""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mesograph.llm.common import process_state

UNKNOWN = "und"
# Score ranges are kept narrow so that one odd word can't outweigh its neighbours.
MOST_PER_WORD = 12.0
SWITCH_PENALTY = 14.0
GRAM_LENGTHS = (2, 3)
SMOOTHING = 0.5
KEPT_WORDS = 200_000
TOGETHER = 1000
SCRIPT_SHARE = 0.001
# First and last code point of the Unicode blocks whose letters tell a script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}


@functools.cache
def script_of(letter: str) -> str:
    """The script of a letter, else `other`."""
    code = ord(letter)
    return next((name for name, ranges in SCRIPTS.items() if any(low <= code <= high for low, high in ranges)), "other")


def word_pattern():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*")


def grams(word: str) -> list[str]:
    """Runs of two and three letters of the word between two boundary marks."""
    marked = f"\x02{word}\x03"
    return [marked[i:i + n] for n in GRAM_LENGTHS for i in range(len(marked) - n + 1)]


@dataclass(frozen=True)
class LanguageModel:
    """Log probabilities of letter runs per language (the last row: a run never seen), and which scripts a language is written in."""

    languages: tuple[str, ...]
    rows: Mapping[str, int]
    logs: np.ndarray
    scripts: Mapping[str, np.ndarray]
    name: str

    def word_scores(self, words: Sequence[str]) -> np.ndarray:
        """Score of each word per language, the best at 0: summed log probability of its letter runs, held to a range.  Languages
        that aren't written in the script of the word's first letter get the lowest score; a script no language has narrows nothing."""
        row, unseen = self.rows.get, len(self.logs) - 1
        found = [[row(g, unseen) for g in grams(w)] for w in words]
        starts = np.cumsum([0, *map(len, found[:-1])])
        total = np.add.reduceat(self.logs[list(chain.from_iterable(found))], starts, axis=0)
        scores = np.clip(total - total.max(axis=1, keepdims=True), -MOST_PER_WORD, 0.0)
        every = np.ones(len(self.languages), bool)
        allowed = np.array([self.scripts.get(script_of(w[0]), every) for w in words])
        scores = np.where(allowed, scores, -MOST_PER_WORD)
        return scores - scores.max(axis=1, keepdims=True)


class Codes(dict):
    """Numbers for words in order of first sight; words without scores yet wait in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.count = 0

    def __missing__(self, word: str) -> int:
        code = self.count
        self.count += 1
        self.fresh.append(word)
        self[word] = code
        return code


class Labeller:
    """Viterbi over the words of many texts side by side."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.find = word_pattern().findall
        self.codes = Codes()
        self.scores = np.empty((0, len(model.languages)))

    @classmethod
    def of(cls, model: LanguageModel) -> Labeller:
        """The labeller of this Python worker for the model, with the words it has met."""
        kept = process_state("language")
        if kept.get("labeller_of") != model.name:
            kept["labeller_of"], kept["labeller"] = model.name, cls(model)
        return kept["labeller"]

    def _known(self) -> np.ndarray:
        """Scores of all numbered words."""
        if self.codes.fresh:
            fresh = [self.model.word_scores(self.codes.fresh[i:i + 20_000]) for i in range(0, len(self.codes.fresh), 20_000)]
            self.scores = np.concatenate([self.scores, *fresh])
            self.codes.fresh.clear()
        return self.scores

    def label(self, texts: Sequence[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the language number of each word, and the summed scores per language."""
        if len(self.codes) > KEPT_WORDS:
            self.codes, self.scores = Codes(), self.scores[:0]
        code = self.codes.__getitem__
        words = [np.fromiter(map(code, self.find(t.lower())), np.int64) if t else np.empty(0, np.int64) for t in texts]
        scores = self._known()
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        paths: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        for start in range(0, len(order), 2048):
            chosen = order[start:start + 2048]
            for i, path in zip(chosen, self._paths([words[i] for i in chosen], scores)):
                paths[i] = path
        return [(path, scores[w].sum(axis=0)) for path, w in zip(paths, words)]

    def _paths(self, words: list[np.ndarray], scores: np.ndarray) -> list[np.ndarray]:
        """Best label sequence of each text (longest text first): every word adds its score, every change costs the penalty."""
        lengths = np.array([len(w) for w in words])
        longest, count, width = int(lengths[0]) if len(lengths) else 0, len(words), scores.shape[1]
        begin = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate([*words, np.empty(0, np.int64)])
        value = np.zeros((count, width))
        number = np.int8 if width <= 127 else np.int16 if width <= 32_767 else np.int32
        came = np.zeros(len(flat) * width, number).reshape(-1, width)
        every = np.arange(width, dtype=number)
        active = np.searchsorted(-lengths, -np.arange(longest), side="left")
        for t in range(longest):
            n = active[t]
            at = begin[:n] + t
            best = value[:n].argmax(axis=1)
            jump = value[np.arange(n), best] - SWITCH_PENALTY
            stay = value[:n] >= jump[:, None]
            came[at] = np.where(stay, every, best[:, None])
            value[:n] = np.where(stay, value[:n], jump[:, None]) + scores[flat[at]]
        state = value.argmax(axis=1)
        path = np.zeros(len(flat), np.int64)
        for t in range(longest - 1, -1, -1):
            n = active[t]
            at = begin[:n] + t
            path[at] = state[:n]
            state[:n] = came[at, state[:n]]
        return [path[begin[i]:begin[i + 1]] for i in range(count)]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """Start, end (in characters) and language of the spans of a text; a span runs from its first word to its last."""
        if not text:
            return []
        path = self.label([text])[0][0]
        places = [m.span() for m in word_pattern().finditer(text.lower())]
        out: list[list] = []
        for (start, end), number in zip(places, path):
            name = self.model.languages[number]
            if out and out[-1][2] == name:
                out[-1][1] = end
            else:
                out.append([start, end, name])
        return [(a, b, c) for a, b, c in out]

    def verdicts(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """Language with the most words and its share of them, equal counts by score, then by name; `und` and 0 without a letter."""
        out = []
        labels = chain.from_iterable(self.label(texts[i:i + TOGETHER]) for i in range(0, len(texts), TOGETHER))
        for path, total in labels:
            if not len(path):
                out.append((UNKNOWN, 0.0))
                continue
            counts = np.bincount(path, minlength=len(self.model.languages))
            best = max(range(len(counts)), key=lambda i: (counts[i], total[i], -i))
            out.append((self.model.languages[best], float(counts[best]) / len(path)))
        return out


def count_runs(texts: Iterable[tuple[str, str]]) -> tuple[dict[str, Counter], dict[str, Counter]]:
    """Letter runs and scripts per language of (language, text); each distinct word of a text counts once in it."""
    find = word_pattern().findall
    counts: dict[str, Counter] = {}
    scripts: dict[str, Counter] = {}
    for language, text in texts:
        runs, written = counts.setdefault(language, Counter()), scripts.setdefault(language, Counter())
        for word in set(find(text.lower())):
            runs.update(grams(word))
            written[script_of(word[0])] += 1
    return counts, scripts


def fit_model(texts: Iterable[tuple[str, str]]) -> LanguageModel:
    """Letter-run model from (language, text)."""
    return model_of(*count_runs(texts))


def model_of(counts: Mapping[str, Mapping[str, int]], scripts: Mapping[str, Mapping[str, int]]) -> LanguageModel:
    """Letter-run model from the counts of letter runs and of words by script, per language."""
    languages = tuple(sorted(counts))
    if not languages:
        return LanguageModel((), {}, np.empty((1, 0)), {}, "empty")
    known = {g for runs in counts.values() for g in runs}
    by_length = {n: sum(len(g) == n for g in known) for n in GRAM_LENGTHS}
    totals = {n: np.array([sum(c for g, c in counts[name].items() if len(g) == n) for name in languages], float) for n in GRAM_LENGTHS}
    # Longer runs tell more; a run's weight is its share of the longest length.
    weight = {n: n / sum(GRAM_LENGTHS) for n in GRAM_LENGTHS}

    def logs(gram_counts: np.ndarray, n: int) -> np.ndarray:
        return weight[n] * np.log((gram_counts + SMOOTHING) / (totals[n] + SMOOTHING * max(1, by_length[n])))

    known_rows = {g: i for i, g in enumerate(sorted(known))}
    table = np.array([*[logs(np.array([counts[name][g] for name in languages], float), len(g)) for g in known_rows],
                      logs(np.zeros(len(languages)), max(GRAM_LENGTHS))])
    named = {s for c in scripts.values() for s in c if s != "other"}
    allowed = {s: np.array([scripts[name][s] >= SCRIPT_SHARE * sum(scripts[name].values()) for name in languages]) for s in named}
    print_of = hashlib.blake2b(repr((languages, list(known_rows))).encode() + table.tobytes(), digest_size=16).hexdigest()
    return LanguageModel(languages, known_rows, table, {s: a for s, a in allowed.items() if a.any()}, print_of)


def fit_on(annotations: DataFrame, language: str = "language", ann_id: str = "ann_id", text: str = "label", sample: int = 600) -> LanguageModel:
    """Fit on whole text annotations whose language is known: at most `sample` per language, those of smallest hash.

    Letter runs are counted in the tasks, so only counts reach the driver: one number per language and run of two or three letters that occurs in its sample.
    Rows without a language or text are passed over.
    """
    known = annotations.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(
        F.col(language).cast("string").alias("_language"), F.col(text).cast("string").alias("_text"),
        F.pmod(F.xxhash64(F.col(ann_id), F.col(text)), 1 << 40).alias("_draw"))
    sizes = known.groupBy("_language").count().select("_language", F.least(F.lit(1.0), F.lit(1.25 * sample) / F.col("count")).alias("_share"))
    # One row per language, so the broadcast is bounded; a quarter more than `sample` is drawn and the rest cut off by hash.
    drawn = known.join(F.broadcast(sizes), "_language").where(F.col("_draw") < F.col("_share") * (1 << 40))
    lowest = Window.partitionBy("_language").orderBy("_draw", "_text")
    rows = drawn.withColumn("_turn", F.row_number().over(lowest)).where(F.col("_turn") <= sample)
    # Groups of a dozen texts, so that the counting of one language is shared by many tasks.
    dealt = rows.select("_language", "_text", "_turn").repartition(F.col("_language"), F.floor(F.col("_turn") / 12)).select("_language", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = count_runs(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for kind, counters in zip(("run", "script"), found):
                rows = [(name, kind, key, n) for name, counter in counters.items() for key, n in [*counter.items(), ("", 0)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64()))], ["language", "kind", "key", "n"])

    counts: dict[str, Counter] = {}
    scripts: dict[str, Counter] = {}
    for name, kind, key, n in dealt.mapInArrow(count, "language string, kind string, key string, n long").groupBy("language", "kind", "key").agg(F.sum("n").alias("n")).collect():
        table = (counts if kind == "run" else scripts).setdefault(name, Counter())
        if key:
            table[key] = n
    return model_of(counts, scripts)


def language_column(model: LanguageModel, text: str = "label") -> Column:
    """lang_pred and score of `label_languages` as a struct column, for filters that keep whole rows."""
    @F.pandas_udf("lang_pred string, score double")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        labeller = Labeller.of(model)
        for part in parts:
            found = labeller.verdicts(part.tolist()) if model.languages else [(UNKNOWN, 0.0)] * len(part)
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    return label(F.col(text).cast("string"))


def label_languages(annotations: DataFrame, model: LanguageModel, ann_id: str = "ann_id", text: str = "label") -> DataFrame:
    """Language of text annotations (ann_id, label): one row per input row with ann_id, lang_pred and score.

    Every word of the whole text is scored under each language (letter runs; the word's script narrows the candidates), Viterbi with a
    penalty for each change labels the words, and the language with the most words is predicted; score is its share of the words.
    A null text or one without a letter is `und` with score 0, as is every text when the model knows no language.  Rows stay in place;
    repeated rows and null ids are labelled like others; other columns are not used.  `language_spans` gives the spans themselves.
    """
    kind = annotations.schema[ann_id].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.of(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = labeller.verdicts(texts) if model.languages else [(UNKNOWN, 0.0)] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             ["id", "lang_pred", "score"])

    return (annotations.select(F.col(ann_id).alias("id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(label, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", ann_id))


def language_spans(annotations: DataFrame, model: LanguageModel, ann_id: str = "ann_id", text: str = "label") -> DataFrame:
    """Spans of one language: ann_id, start, stop (characters) and language, in order of start; texts without letters have none."""
    kind = annotations.schema[ann_id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller.of(model)
        for batch in batches:
            rows = [(i, *span) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if model.languages for span in labeller.spans(t)]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.int64()),
                                              pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["id", "start", "stop", "language"])

    return (annotations.select(F.col(ann_id).alias("id"), F.col(text).cast("string").alias("text"))
            .mapInArrow(cut, f"id {kind}, start long, stop long, language string").withColumnRenamed("id", ann_id))
