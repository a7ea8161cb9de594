"""Training texts that contain passages of held-out items: a prefix-filtered set join and exact window checks, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mesograph.llm.common import ascii_lower, stored

# Windows up to this number, and their tokens, go to every task; more meet the hashes of the texts' grams in a shuffle.
BROADCAST_ROWS = 200_000
GRAM = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words: runs of anything but ASCII characters other than letters and digits, A-Z in lower case; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _gram(words: str, at: Column, length: Column) -> Column:
    """Hash of `length` (1 to GRAM) words from position `at`; the length is hashed along, so grams of different length differ."""
    parts = [F.when(F.lit(i) < length, F.get(F.col(words), at + i)) for i in range(GRAM)]
    return F.xxhash64(length, *parts)


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct windows (window, words, n): `width` words in a row; an item of fewer words, but not none, is one window."""
    split = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - width, F.lit(0)))
    return split.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at") + 1, F.lit(width)).alias("words"))


def leaked_passages(annotations: DataFrame, held_out: DataFrame, ann_id: str = "ann_id", text: str = "label", item_id: str = "item_id",
                    item_text: str = "text", width: int = 10) -> DataFrame:
    """Windows of held-out items (item_id, text) inside text annotations (ann_id, label): ann_id, _key, at, n and items.

    `_key` identifies the text of a row, `at` is the position of the first word of an occurrence, n its number of words, items the ids of all
    items with that window.  One row per text and occurrence; equal rows of the same id and text occur once.

    Each window must be contained whole, so one token of it suffices to find it: of its three-word grams (shorter windows: the window) the
    one that is rarest over all texts, counted first (with none in any text the window can't occur).  Grams of a text that are such a token
    give candidates; the token's
    offset in the window gives the start, which with the text's length bounds the place; the words there are then compared.
    Up to `BROADCAST_ROWS` placed tokens go to every task and texts stay where they lie; more are joined with the hashes of the texts' grams, which are
    shuffled without their words, and each text with a candidate is then looked at once with all its candidates.
    """
    windows = stored(item_windows(held_out, item_id, item_text, width).groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
                     .select(F.xxhash64("words").alias("window"), "words", F.size("words").alias("n"), "items"), "windows")
    starts = F.sequence(F.lit(0), F.col("n") - F.col("g"))
    placed = (windows.select("window", "words", F.col("n"), F.least("n", F.lit(GRAM)).alias("g")).select("*", F.explode(starts).alias("offset"))
              .select("window", "n", "g", "offset", F.get("words", F.col("offset")).alias("word"), _gram("words", F.col("offset"), F.col("g")).alias("token")))
    split = (annotations.select(F.col(ann_id).alias("id"), F.md5(F.col(text).cast("binary")).alias("key"), words_of(F.col(text)).alias("w"))
             .withColumn("size", F.size("w")).where("size > 0"))
    few = placed.count() <= BROADCAST_ROWS

    def met(tokens: DataFrame) -> DataFrame:
        """Grams of the texts that are among a few `tokens` (word, g, token): first by their first word, which costs one look-up per word."""
        heads = tokens.select("word", "g").distinct()
        words = split.select("id", "key", "w", "size", F.posexplode("w").alias("index", "word")).join(F.broadcast(heads), "word")
        return (words.where(F.col("index") + F.col("g") <= F.col("size"))
                .select("id", "key", "w", "size", "index", _gram("w", F.col("index"), F.col("g")).alias("token")).join(F.broadcast(tokens.drop("word")), "token"))

    def grams() -> DataFrame:
        """All grams of the texts as rows (id, key, size, index, token), without words."""
        def of(g: int):
            return F.transform(F.filter(F.sequence(F.lit(0), F.col("size") - 1), lambda i: i + g <= F.col("size")), lambda i: F.struct(i.alias("index"), _gram("w", i, F.lit(g)).alias("token")))

        return split.select("id", "key", "size", F.explode(F.concat(*[of(g) for g in range(1, GRAM + 1)])).alias("e")).select("id", "key", "size", "e.index", "e.token")

    names = placed.select("word", "g", "token").distinct()
    counted = met(names).groupBy("token").count() if few else grams().groupBy("token").count().join(names.select("token"), "token", "left_semi")
    first = placed.join(counted, "token").groupBy("window").agg(F.min(F.struct("count", "token", "offset", "g", "word")).alias("best"))
    wanted = stored(first.select("window", "best.word", "best.g", "best.token", "best.offset")
                    .join(windows, "window").select("word", "g", "token", "offset", "words", "n", "items"), "prefixes")
    start = F.col("index") - F.col("offset")
    fits = (F.col("at") >= 0) & (F.col("at") + F.col("n") <= F.col("size"))
    if few:
        candidates = met(wanted).withColumn("at", start).where(fits).where(F.slice("w", F.col("at") + 1, F.col("n")) == F.col("words"))
        return candidates.select(F.col("id").alias(ann_id), F.col("key").alias("_key"), "at", "n", "items")
    # Texts are told apart by their key alone, so equal ones are looked at once.
    candidates = grams().select("key", "size", "index", "token").join(wanted.select("token", "offset", "words", "n", "items"), "token").withColumn("at", start).where(fits)
    per_text = candidates.groupBy("key").agg(F.collect_set(F.struct("at", "n", "words", "items")).alias("found"))
    texts = split.select("key", "w").dropDuplicates(["key"]).join(per_text, "key")
    whole = texts.select("key", F.explode(F.filter("found", lambda c: F.slice(F.col("w"), c["at"] + 1, c["n"]) == c["words"])).alias("c"))
    who = split.select("id", "key").distinct()
    return who.join(whole, "key").select(F.col("id").alias(ann_id), F.col("key").alias("_key"), "c.at", "c.n", "c.items")


def leaks(annotations: DataFrame, held_out: DataFrame, ann_id: str = "ann_id", text: str = "label", item_id: str = "item_id",
          item_text: str = "text", width: int = 10) -> DataFrame:
    """How much of each text annotation (ann_id, label) stands in held-out items (item_id, text), by windows of `width` words.

    One row per input row: ann_id, n_words, n_hit (words inside an occurrence of any window), n_items and items (ids, as sorted strings, of
    items with an occurring window) and contaminated (n_hit > 0).  Null, empty and wordless texts have no words and no hits; items without
    words have no windows; equal items are all named.  Repeated rows repeat; null ids are judged by their text like others; no
    items leave everything clean.  Other columns are not used.
    """
    found = leaked_passages(annotations, held_out, ann_id, text, item_id, item_text, width)
    hit = found.groupBy(ann_id, "_key").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # Occurrences in order of start: each adds what reaches beyond the furthest end so far.
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")), lambda acc, s: F.struct(
        F.greatest(acc["end"], s["at"] + s["n"]).alias("end"),
        (acc["hit"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(acc["end"], s["at"]))).alias("hit")))
    hit = hit.select(F.col(ann_id).alias("_id"), F.col("_key").alias("_hit_key"), covered["hit"].alias("n_hit"), "items")
    rows = annotations.select(F.col(ann_id), F.md5(F.col(text).cast("binary")).alias("_key"), F.size(words_of(F.col(text))).cast("long").alias("n_words"))
    joined = rows.join(hit, F.col(ann_id).eqNullSafe(F.col("_id")) & F.col("_key").eqNullSafe(F.col("_hit_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(ann_id, "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))
