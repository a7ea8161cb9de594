"""Operators on annotation texts: token ids, near duplicates, byte-level BPE, held-out passages, toxicity, language."""

import base64
import itertools
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from mesograph.llm import bpe, decontamination, language, neardup, token_ids, toxicity
from mesograph.session import scratch_path

NOTES = "ann_id long, label string, id string, key string, size int, bands string"
WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\t", "one", "One two", "a'll b's", "ﬁn É é e\u0301", "x\x1cy\u2003z", "中文 текст", "<|endoftext|> mid", "a" * 5000, "ab " * 3000, "\U0001F600" * 40]
SYLLABLES = ["ka", "lo", "mi", "ren", "tu", "vas", "po", "del", "shi", "or"]


def notes(spark, rows):
    """Annotations with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "x", None, 7, "y") for i, t in rows], NOTES)


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows():
    return [*enumerate(ODD, 10), (10, ODD[5]), (11, ODD[1]), (11, ODD[1]), (None, "no id here"), (None, None)]


# --- token ids

def test_token_ids_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    rows = odd_rows()
    files = token_ids.write_token_ids(notes(spark, rows), WORD_FILE, scratch_path(spark, "ids"), end_id=1)
    got = token_ids.read_token_ids(spark, files).collect()
    tokenizer = Tokenizer.from_file(WORD_FILE)
    want = sorted((i is not None, i or 0, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in rows)
    assert sorted((r.ann_id is not None, r.ann_id or 0, bytes(r.token_ids)) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    keys = [(r.ann_id is not None, r.ann_id or 0) for r in got]
    assert keys == sorted(keys) and sum(p[2] for p in files.parts) == len(rows)


def test_token_ids_of_no_rows(spark):
    files = token_ids.write_token_ids(notes(spark, []), WORD_FILE, scratch_path(spark, "ids"), end_id=1)
    assert files.parts == () and token_ids.read_token_ids(spark, files).count() == 0


@pytest.mark.parametrize("size,longest", [(1, 18), (2, 18), (3, 18), (40, 6), (300, 9), (5000, 18)])
def test_code_lengths_are_optimal_and_limited(size, longest):
    counts = np.random.default_rng(size).zipf(1.3, size) % 100_000 + 1
    lengths = token_ids.code_lengths(counts, longest).astype(int)
    assert lengths.max() <= longest and (size == 1 or math.isclose(sum(2.0 ** -n for n in lengths), 1))
    if longest == 18 and size <= 300:  # the limit doesn't bind: as good as plain Huffman
        import heapq

        heap, cost = [int(c) for c in counts], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        assert size == 1 or cost == int((counts * lengths).sum())


def test_runs_pack_and_unpack():
    rng = np.random.default_rng(3)
    counts = np.array([1, 256, 257, 1000, 3])
    ids = rng.zipf(1.2, counts.sum()).clip(max=4000).astype(np.uint32)
    code = token_ids.Code(token_ids.code_lengths(np.bincount(ids)))
    packed = code.pack(ids, counts)
    for (bits, marks), part in zip(packed, np.split(ids, np.cumsum(counts)[:-1])):
        held = np.array([min(256, len(part) - k) for k in range(0, len(part), 256)])
        assert (code.unpack(bits, marks, held, code.decoding_table()) == part).all()


def test_a_damaged_token_file_is_told(spark):
    folder = scratch_path(spark, "ids")
    files = token_ids.write_token_ids(notes(spark, [(1, "some words")]), WORD_FILE, folder, end_id=1)
    path = f"{folder}/{files.parts[0][1]}"
    data = bytearray(open(path, "rb").read())
    data[-1] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        token_ids.read_token_ids(spark, files).collect()


# --- near duplicates

def plain_classes(rows, width, per_cent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    ids = [i for i, _ in rows]
    label = {i: i for i in ids if i is not None}
    while True:
        before = dict(label)
        for (i, a), (j, b) in itertools.combinations(zip(ids, sets), 2):
            if None not in (i, j) and (i == j or a and b and 100 * len(a & b) >= per_cent * len(a | b)):
                label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return [(i, len(s), label.get(i)) for i, s in zip(ids, sets)]


def near_corpus():
    rng = random.Random(5)
    base = prose(rng, 120).split()
    rows = [(i, prose(rng, rng.randint(3, 90))) for i in range(100, 130)]
    for i in range(200, 290):  # one large group of near copies, some of which link only through others
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = prose(rng, 1)
        rows.append((i, " ".join(copy)))
    rows += [(300 + i, " ".join(base)) for i in range(40)]
    rows += [(5, rows[0][1].upper()), (6, None), (7, ""), (8, " \n "), (9, "two words"), (12, "Two  words"), (13, "two words more"), (9, "two words"), (None, "two words"), (14, "x" * 9000)]
    return rows


@pytest.mark.parametrize("width,per_cent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, width, per_cent):
    rows = near_corpus()
    got = neardup.near_duplicates(notes(spark, rows), width=width, per_cent=per_cent).collect()
    want = plain_classes(rows, width, per_cent)
    order = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((r.ann_id, r.n_shingles, r.component_id) for r in got), key=order) == sorted(want, key=order)
    assert all(r.kept == (r.ann_id is None or r.ann_id == r.component_id) for r in got)


def test_near_duplicates_of_no_rows(spark):
    assert neardup.near_duplicates(notes(spark, [])).count() == 0
    assert [r.kept for r in neardup.near_duplicates(notes(spark, [(1, None)])).collect()] == [True]


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    signature = neardup.Signature(43)
    for share in (0.2, 0.5, 0.9):
        a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        b = np.concatenate([a[:int(2000 * 2 * share / (1 + share))], rng.integers(0, 1 << 63, 2000 - int(2000 * 2 * share / (1 + share)), dtype=np.uint64)])
        bits = [np.frombuffer(signature.of(x)[1], np.uint64) for x in (a, b)]
        assert abs(neardup.estimate(bits[0], bits[1], 43 * neardup.ROWS) - share) < 0.12


def test_the_rest_of_a_bucket_is_compared_exactly():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 62, 200))
    sets = []
    for n in range(60):
        drop = rng.choice(len(base), rng.integers(0, 30), replace=False)
        sets.append(np.union1d(np.delete(base, drop), rng.integers(0, 1 << 62, rng.integers(0, 8))))
    signature = neardup.Signature(43)
    rows = [{"id": n, "class": n, "block": n % 2, "bits": signature.of(s.view(np.uint64))[1], "lacks": np.setdiff1d(sets[0], s), "adds": np.setdiff1d(s, sets[0])} for n, s in enumerate(sets)]
    for across in (False, True):
        links = list(neardup._block_links(rows, len(sets[0]), across, 85, neardup.least_estimate(0.85, 344), 344))
        near = [(i, j) for i, j in itertools.combinations(range(60), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])) and (not across or i % 2 != j % 2)]

        def groups(pairs):
            label = list(range(60))
            for _ in range(60):
                for i, j in pairs:
                    label[i] = label[j] = min(label[i], label[j])
            return label

        assert groups(links) == groups(near) and len(links) < 60


# --- byte-level BPE

def test_bpe_equals_the_library_and_decodes(spark):
    import tiktoken

    rng = random.Random(4)
    rows = odd_rows() + [(1000 + i, "".join(rng.choice(["a", "the", "ing", " ", "\n", "'s", "é", "中", "1", "\x1c", "\u00a0", "!", "aaaa", "\u0301"]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    rows += [(2000, "ab" * 30000), (2001, "".join(rng.choice("abcdefgh") for _ in range(40000)))]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANK_FILE), special_tokens={})
    encoded = bpe.encode_labels(notes(spark, rows), RANK_FILE, public_tokenizers.PATTERN)
    got = bpe.decode_labels(encoded, RANK_FILE).collect()
    want = sorted((str(i), np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((str(r.ann_id), bytes(r.token_ids), bytes(r.decoded)) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.token_ids) for r in got)
    assert bpe.encode_labels(notes(spark, []), RANK_FILE, public_tokenizers.PATTERN).count() == 0


def test_queue_merges_lowest_rank_leftmost_first():
    ranks = {bytes([c]): i for i, c in enumerate(b"abc")} | {b"ab": 3, b"bc": 4, b"aa": 5, b"abc": 6, b"bca": 7}
    queue = bpe.RankQueue(ranks)

    def plain(piece):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if found is None:
                return [ranks[p] for p in parts]
            parts[found[1]:found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]

    for n in range(1, 8):
        for piece in map(bytes, itertools.product(b"abc", repeat=n)):
            assert queue.encode(piece) == ([ranks[piece]] if piece in ranks else plain(piece))
    with pytest.raises(KeyError):
        queue.encode(b"xx")


# --- held-out passages

@pytest.mark.parametrize("limit", [decontamination.BROADCAST_ROWS, 0])
def test_leaks_equal_plain_search(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    rng = random.Random(6)
    items = [(f"q{i}", prose(rng, n)) for i, n in enumerate([30, 10, 9, 4, 2, 1, 14])] + [("q7", None), ("q8", ""), ("q9", "..."), ("q10", "same Same same same " * 5), (None, prose(rng, 12))]
    items.append(("twin", items[0][1]))
    inside = [t for _, t in items if t]
    rows = [(i, " ".join(x for x in (prose(rng, rng.randint(0, 30)), rng.choice(inside), prose(rng, rng.randint(0, 30)), rng.choice(inside).upper() + "!")))
            for i in range(60)] + [(100 + i, prose(rng, 40)) for i in range(20)] + odd_rows() + [(70, "same " * 500), (3, None)]
    held_out = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id string, text string, id string")
    got = decontamination.leaks(notes(spark, rows), held_out).collect()
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    lower = {c: c + 32 for c in range(65, 91)}
    windows = {}
    for item, text in items:
        words = find((text or "").translate(lower))
        for k in range(max(1, len(words) - 9)) if words else ():
            windows.setdefault(tuple(words[k:k + 10]), set()).add(item)
    want = []
    for i, text in rows:
        words, hit, found = find((text or "").translate(lower)), set(), set()
        for window, named in windows.items():
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k:k + len(window)]) == window:
                    hit.update(range(k, k + len(window)))
                    found |= named
        want.append((str(i), len(words), len(hit), sorted(x for x in found if x is not None), bool(hit)))
    assert sorted((str(r.ann_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got) == sorted(want)


def test_leaks_without_items_or_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontamination.leaks(notes(spark, [(1, "a b")]), none).collect()] == [(2, 0, 0, False)]
    assert decontamination.leaks(notes(spark, []), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# --- toxicity

def toxic_corpus():
    rng = random.Random(8)
    rude = ["gromp", "vlask", "brunk", "snerd"]
    rows = []
    for i in range(400):
        words = prose(rng, rng.randint(20, 120)).split()
        if i % 4 == 0:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randrange(len(words)), rng.choice(rude))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows


def test_toxic_texts_are_found(spark):
    rows = toxic_corpus()
    labels = spark.createDataFrame([(i, t, "extra") for i, _, t in rows if i % 5], "ann_id long, toxic int, label string")
    table = notes(spark, [(i, t) for i, t, _ in rows] + odd_rows())
    model = toxicity.fit_on(table, labels)
    got = {(r.ann_id, r.predicted) for r in toxicity.score_labels(table, model).collect()}
    held_out = [(i, t) for i, _, t in rows if not i % 5 and i > 30]
    assert sum(pair in got for pair in held_out) >= 0.97 * len(held_out)
    scores = toxicity.score_labels(notes(spark, odd_rows()), model).collect()
    assert len(scores) == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == 0 for r in scores)
    by_column = notes(spark, odd_rows()).select(toxicity.score_column(model).alias("s")).collect()
    assert sorted(r.s for r in by_column) == sorted(r.score for r in scores)


def test_toxicity_without_examples(spark):
    none = spark.createDataFrame([], "ann_id long, toxic int")
    model = toxicity.fit_on(notes(spark, odd_rows()), none)
    assert all(r.score < 0.5 for r in toxicity.score_labels(notes(spark, odd_rows()), model).collect())
    assert toxicity.score_labels(notes(spark, []), model).count() == 0


def test_shared_passages_count_once():
    first, second = toxicity.told_once(["a b c d e", "x a b c d y"])
    assert first == list("abcde") and second == ["x", "y"]


# --- language

GERMAN, FRENCH = "der die und nicht schön über straße wäre haus machen".split(), "le les est très français où être garçon maison faire".split()
RUSSIAN = "это был дом который стоит здесь".split()


def speak(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language_of_texts_and_spans(spark):
    rng = random.Random(9)
    kinds = {"de": GERMAN, "fr": FRENCH, "ru": RUSSIAN}
    known = [(i, speak(rng, kinds[k], 40), k) for i, k in enumerate(["de", "fr", "ru"] * 20)]
    table = spark.createDataFrame([*known, (99, "whatever", None), (None, None, "de")], "ann_id long, label string, language string")
    model = language.fit_on(table)
    assert model.languages == ("de", "fr", "ru")
    texts = [(1, speak(rng, GERMAN, 30)), (2, speak(rng, FRENCH, 30)), (3, speak(rng, RUSSIAN, 12)), (4, "123 !"), (5, None), (6, ""), (7, "½ ²"),
             (8, speak(rng, GERMAN, 20) + ". " + speak(rng, FRENCH, 60)), (None, speak(rng, GERMAN, 9)), (1, speak(rng, GERMAN, 30))]
    got = sorted((str(r.ann_id), r.lang_pred) for r in language.label_languages(notes(spark, texts), model).collect())
    assert got == sorted([("1", "de"), ("1", "de"), ("2", "fr"), ("3", "ru"), ("4", "und"), ("5", "und"), ("6", "und"), ("7", "und"), ("8", "fr"), ("None", "de")])
    spans = [(r.start, r.stop, r.language) for r in language.language_spans(notes(spark, texts[7:8]), model).orderBy("start").collect()]
    assert [s[2] for s in spans] == ["de", "fr"] and spans[0][1] == texts[7][1].index(".")
    by_column = notes(spark, texts).select(language.language_column(model).alias("l")).collect()
    assert sorted(r.l.lang_pred for r in by_column) == sorted(p for _, p in got)
    assert language.label_languages(notes(spark, []), model).count() == 0


def test_no_known_language(spark):
    model = language.fit_on(spark.createDataFrame([], "ann_id long, label string, language string"))
    assert [r.lang_pred for r in language.label_languages(notes(spark, [(1, "text")]), model).collect()] == ["und"]


def test_viterbi_finds_the_best_labelling():
    rng = random.Random(10)
    model = language.fit_model([("de", speak(rng, GERMAN, 60)), ("fr", speak(rng, FRENCH, 60))])
    labeller = language.Labeller(model)
    texts = [" ".join(rng.choice(GERMAN + FRENCH) for _ in range(n)) for n in (1, 2, 5, 9)]
    for text, (path, _) in zip(texts, labeller.label(texts)):
        scores = model.word_scores(text.split())

        def value(labels):
            return sum(scores[i, s] for i, s in enumerate(labels)) - language.SWITCH_PENALTY * sum(a != b for a, b in zip(labels, labels[1:]))

        assert math.isclose(value(path), max(value(p) for p in itertools.product(range(2), repeat=len(path))))


def test_words_of_one_pattern_do_not_collide(spark):
    """Thue-Morse words of two letters collide under polynomial hashes modulo a power of two."""
    first = [0]
    for _ in range(11):
        first += [1 - x for x in first]
    words = ["".join("ab"[x ^ flip] for x in first) for flip in (0, 1)]
    short = ["".join("ab"[x ^ flip] for x in first[:n]) for n in (7, 8, 9, 64, 100, 128, 129, 256) for flip in (0, 1)]
    hashes = neardup.Shingles(1).words(" ".join(words + short + ["a", "b", "", "A"]))
    assert len(set(hashes.tolist())) == len(words) + len(short) + 2
    rows = neardup.near_duplicates(notes(spark, list(enumerate(words))), width=3, per_cent=85).collect()
    assert all(r.kept and r.component_id == r.ann_id for r in rows)


def test_more_than_127_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{n:03d}" for n in range(200)]
    own = {name: letters[n % 26] + letters[n // 26] for n, name in enumerate(names)}
    rows = [(n, " ".join(own[name] * k for k in (2, 3, 4)), name) for n, name in enumerate(names)]
    model = language.fit_on(spark.createDataFrame(rows, "ann_id long, label string, language string"))
    assert len(model.languages) == 200
    labeller = language.Labeller(model)
    found = labeller.verdicts([r[1] for r in rows])
    assert [f[0] for f in found] == names


def test_runs_are_counted_in_tasks_over_whole_texts(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 30) + " " * 60_000 + f"ending{i}", "xy"[i % 2]) for i in range(40)]
    table = spark.createDataFrame(rows, "ann_id long, label string, language string")
    model, plain = language.fit_on(table), language.fit_model([(r[2], r[1]) for r in rows])
    assert model.name == plain.name and "ng" in model.rows


def test_text_ids_and_tokenizers_that_keep_white_space(spark):
    path, keeps = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    rows = [("1-1", "one two"), ("1-10", None), (None, "Three."), ("é", "İ. x"), ("1-1", "one  two!!")]
    table = spark.createDataFrame(rows, "ann_id string, label string")
    for tokenizer in (path, keeps):
        library = tokenizers.Tokenizer.from_file(tokenizer)
        files = token_ids.write_token_ids(table, tokenizer, scratch_path(spark, "ids"), end_id=1)
        got = sorted((str(r.ann_id), np.frombuffer(r.token_ids, "<u4").tolist()) for r in token_ids.read_token_ids(spark, files).collect())
        assert got == sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
