"""Operators on measurements, addresses, archives and tiles."""

import base64
import gzip
import hashlib
import io
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mesograph.llm import addresses, archive, outliers, sharding
from mesograph.session import scratch_path

RULES = [addresses.Rule("allow", "org", "/"), addresses.Rule("block", "example.org", "/es/"), addresses.Rule("block", "example.org", "/en/1"),
         addresses.Rule("allow", "com", "/fr/"), addresses.Rule("block", "com", "/de/")]


def plain_rule(rules, host, path):
    def glob(text):
        return "".join("(?s:.*)" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]+", text))

    fits = [r for r in rules if re.match(f"(?:[^/]*\\.)?{glob(r.host + r.path)}", host + path)]
    return max(fits, key=lambda r: len(r.text.encode()), default=None)


def test_addresses_equal_plain_rules(spark):
    urls = ["https://a.example.org/es/x?q#f", "http://EXAMPLE.org/en/12", "https://badexample.org/es/", "x://org/", "x://org", "a://b.com/fr/ü", "a://com/de/", "a://com/d", "no mark", "", None,
            "://", "a://h?x/fr/", "a://.com/fr/", "a://x.com:80/fr/", "a://u@com/fr/", "a://com/FR/", "b://x.org/" + "long/" * 3000, "a://é.com/de/\n", "a://x.example.org/en/1://y", "a://x.org/#"]
    table = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(urls + urls[:3])], "image_id int, path string, host string, rule string")
    for row in addresses.judge_addresses(table, RULES).collect():
        rest = row.path.split("://", 1)[1] if row.path and "://" in row.path else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        best = plain_rule(RULES, host, path)
        assert (row.host, row.path_in_host) == (host, path)
        assert (row.rule, row.verdict) == ((best.text, best.verdict) if best else (None, "allow")), row.path
    assert addresses.judge_addresses(table.limit(0), RULES).count() == 0
    assert {r.verdict for r in addresses.judge_addresses(table, [], default="block").collect()} == {"block"}


def test_addresses_keep_all_columns(spark):
    table = spark.createDataFrame([(1, "a://x.org/", "mine", "b")], "image_id int, path string, _judged string, __judged string")
    row = addresses.judge_addresses(table, RULES).first()
    assert (row._judged, row["__judged"], row.rule) == ("mine", "b", "org/")


def test_many_rules_with_stars():
    rng = np.random.default_rng(1)
    parts = ["a", "b", "ab", "*", "**", "c"]
    rules = [addresses.Rule("allow", ".".join(rng.choice(["x", "y", "*"], 2)), "/" + "".join(rng.choice(parts, 4)) + str(n % 3)) for n in range(60)]
    machine = addresses.Automaton(rules)
    assert machine.words > 4
    for _ in range(300):
        host, path = ".".join(rng.choice(["x", "y", "z"], rng.integers(1, 4))), "/" + "".join(rng.choice(["a", "b", "c", "/", "0", "1", "2"], rng.integers(0, 9)))
        got, want = machine.match([(host + path).encode()])[0], plain_rule(rules, host, path)
        assert (rules[got].text if got >= 0 else None) == (want.text if want else None)


# --- archive

def sidecars(spark, rows):
    return spark.createDataFrame([(i, u, c, "x", "y") for i, u, c in rows], "image_id long, uri string, content string, key string, digest string")


def test_archive_round_trip(spark):
    rows = [(3, "u://3", "same"), (1, "u://1", "same"), (2, "u://2", "same"), (4, None, None), (5, "u://5\r\nX: y%41", ""), (6, "u://6", "é\r\n\r\nbody" * 1000), (7, "u://7", "x" * 3_000_000),
            (1, "u://1", "same"), (None, "u://n", "same"), (None, "u://m", "alone")]
    folder = scratch_path(spark, "archive")
    written = archive.write_archive(sidecars(spark, rows), folder)
    got = archive.read_archive(spark, folder, written).collect()
    assert sum(n for _, n, _ in written) == len(rows) == len(got) and all(r.valid for r in got)
    firsts = {"same": 1, "": 4, rows[5][2]: 6, rows[6][2]: 7}
    want = []
    for i, u, c in rows:
        data = (c or "").encode()
        first = firsts.get(c or "")
        refers = str(first) if first is not None and i != first else None
        want.append((str(i), u, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers else "response", str(refers), None if refers else data))
    order = lambda t: tuple(map(str, t))
    assert sorted(((str(r.image_id), r.uri, r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to), None if r.payload is None else bytes(r.payload)) for r in got), key=order) == sorted(want, key=order)


def test_short_payloads_and_no_rows(spark):
    folder = scratch_path(spark, "archive")
    written = archive.write_archive(sidecars(spark, [(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long text"), (4, "d", "long text")]), folder, least_bytes=5)
    assert sorted((r.image_id, r.record_type) for r in archive.read_archive(spark, folder, written, payloads=False).collect()) == [("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")]
    folder = scratch_path(spark, "archive")
    assert archive.read_archive(spark, folder, archive.write_archive(sidecars(spark, []), folder)).count() == 0


def test_reader_frames_members():
    records = [archive.record_bytes(str(n), "u://x", b"p" * n, None, "2000-01-01T00:00:00Z") for n in (0, 1, 100_000)]
    packed = b"".join(map(gzip.compress, records))

    class Dribble(io.BytesIO):
        def read(self, size=-1):
            return super().read(7)

    assert [len(block) - len(archive.HTTP) for _, block in archive.SequentialReader(Dribble(packed))] == [0, 1, 100_000]
    with pytest.raises(ValueError, match="cut off"):
        list(archive.SequentialReader(io.BytesIO(packed[:-5])))
    with pytest.raises(ValueError, match="frame"):
        list(archive.SequentialReader(io.BytesIO(gzip.compress(records[1] + b"x"))))


# --- shards

@pytest.mark.parametrize("count", [1, 2, 3, 5, 16, 17, 255, 256, 257, 1000])
def test_permutation_is_one_to_one(count):
    out = sharding.permuted(np.arange(count), count, 7)
    assert sorted(out) == list(range(count))
    assert count < 100 or (out != sharding.permuted(np.arange(count), count, 8)).any()


def test_shards_are_even_gapless_and_reproducible(spark):
    rows = [(i, f"image {i % 11}", 1, 2) for i in range(101)] + [(None, None, 1, 2)] * 5 + [(7, "image 7", 1, 2)] * 40
    table = spark.createDataFrame(rows, "tile_id long, image string, size int, _row int")
    got = sharding.shard_tiles(table, 16).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(rows) and set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(16):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))
    assert {(r.tile_id, r.size) for r in got if r.tile_id in (None, 3)} == {(None, 1), (3, 8)}
    again = sharding.shard_tiles(table.repartition(3), 16).collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(map(tuple, again), key=order)
    assert sharding.shard_tiles(table.limit(0)).count() == 0


# --- statistics and outliers

def test_word_statistics_equal_plain_counts(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", " \t\n", "a", "a b c a b c a", "x\nx\n \n\nx y\r\nx", "# | <a> $5 100%&*", "é é é é", "中 文 " * 30, "w " * 4000,
             *[" ".join(rng.choice(list("abcd"), n)) + "\n" + "z" * int(n) for n in range(0, 40, 3)]]
    table = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "ann_id int, label string, _other string, n string")
    for r in outliers.label_statistics(table).collect():
        text = texts[r.ann_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k in range(len(words) - 2) if runs[tuple(words[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


def test_distances_of_measurements(spark):
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal([100, 5], [[90, 6], [6, 1]], 600)
    rows = [("a", "img", float(x), float(y), 1.0) for x, y in good] + [("a", "img", 400.0, 1.0, 1.0)] * 60  # a tenth lies far off
    rows += [(None, "img", float(x), float(y), 1.0) for x, y in good[:80]] + [("b", "img", 1.0, 1.0, 1.0)] * 70 + [("few", "img", 1.0, 2.0, 1.0)] * 4
    rows += [("a", "img", None, 1.0, 1.0), ("a", "img", float("nan"), 1.0, 1.0)]
    table = spark.createDataFrame(rows, "label string, image string, ecd_nm double, feret_nm double, distance double")
    got = outliers.robust_distances(table, {"ecd_nm": 1e-3, "feret_nm": 1e-3}).collect()
    assert len(got) == len(rows)
    cut = outliers.chi_square_quantile(0.999, 2)
    inner = [r.distance for r in got if r.label == "a" and r.ecd_nm is not None and 0 < r.ecd_nm < 300]
    assert np.mean(np.array(inner) < cut) > 0.98 and 0.5 < np.median(inner) < 3
    assert all(r.distance > 20 * cut for r in got if r.label == "a" and r.ecd_nm == 400.0)
    assert all(r.distance is None for r in got if r.label == "few" or r.label == "a" and (r.ecd_nm is None or np.isnan(r.ecd_nm)))
    assert all(r.distance < 1e-6 for r in got if r.label == "b") and all(r.distance is not None for r in got if r.label is None)
    assert outliers.robust_distances(table.limit(0), {"ecd_nm": 1e-3}).count() == 0


def test_quantiles_of_chi_square():
    for share, freedom, known in [(0.5, 5, 4.3515), (0.999, 5, 20.515), (0.95, 1, 3.8415), (0.99999, 5, 30.856)]:
        assert abs(outliers.chi_square_quantile(share, freedom) - known) < 2e-3


def test_judged_labels(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(60, 300))), "en", "s1") for i in range(150)]
    rows += [(900, " ".join(w + "%%%" for w in rng.choice(words, 100)), "en", "s1"), (901, None, "en", "s1"), (902, "too few", None, None), (903, "again and again " * 40, "en", "s1")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "ann_id long, label string, language string, image string, n_words int")
    got = {r.ann_id: r for r in outliers.judge_labels(table).collect()}
    assert len(got) == len(rows) and not any(got[i].kept for i in (900, 901, 902, 903))
    assert sum(got[i].kept for i in range(150)) >= 149 and not got[900].base_failed and all(got[i].base_failed for i in (901, 902, 903))
    assert outliers.judge_labels(table.limit(0)).count() == 0


def test_small_groups_are_judged_by_coarser_ones(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(3000)]

    def plain():
        return " ".join(rng.choice(words, rng.integers(60, 300)))

    def junk():
        return " ".join(w + "%%%" for w in rng.choice(words, 100))

    rows = [(i, plain(), "en", "large") for i in range(80)] + [(100 + i, plain(), "en", "small") for i in range(4)] + [(104, junk(), "en", "small")]
    rows += [(200 + i, plain(), "fr", "small") for i in range(4)] + [(204, junk(), "fr", "small"), (205, plain(), None, None), (206, junk(), None, None)]
    rows += [(300 + i, plain(), "de", f"s{i % 20}") for i in range(80)] + [(400, junk(), "de", "s3")]  # no group of its language is large
    table = spark.createDataFrame(rows, "ann_id long, label string, language string, image string")
    got = {r.ann_id: r for r in outliers.judge_labels(table).collect()}
    assert len(got) == len(rows) and all(r.distance is not None and not r.base_failed for r in got.values())
    assert not any(got[i].kept for i in (104, 204, 206, 400))
    assert sum(r.kept for r in got.values()) >= len(rows) - 4 - 2
    few = outliers.judge_labels(table.where("language = 'fr'")).collect()
    assert all(r.kept and r.distance is None for r in few)
