"""The numbered queries: each maps the given tables to an operator's interface and its results back to the asked columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mesograph.llm import addresses, archive, bpe, conversations, decontamination, html_text, language, neardup, outliers, search, sharding, token_ids, toxicity
from mesograph.llm.common import id_remainder, small_batches
from mesograph.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as text annotations."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ann_id"), F.col("text").alias("label"))


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-ids")
    files = token_ids.write_token_ids(notes(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1)
    return token_ids.read_token_ids(spark, files).select(
        F.col("ann_id").alias("doc_id"), "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(notes(spark, sf_dir), width=3, per_cent=85).withColumnRenamed("ann_id", "doc_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_labels(notes(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return bpe.decode_labels(encoded, ranks).select(
        F.col("ann_id").alias("doc_id"), "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


RULES = [addresses.Rule("allow", "org", "/"), addresses.Rule("block", "example.org", "/es/"), addresses.Rule("block", "example.org", "/en/1"),
         addresses.Rule("allow", "com", "/fr/"), addresses.Rule("block", "com", "/de/")]


def op4_address_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = addresses.judge_addresses(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, path="url")
    return judged.select("page_id", "host", F.col("path_in_host").alias("path"), "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.leaks(notes(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("ann_id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ann_id"), F.col("text").alias("label"), F.col("lang").alias("language"), F.col("source").alias("image"))
    return outliers.judge_labels(docs).withColumnRenamed("ann_id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = notes(spark, sf_dir)
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ann_id"), "toxic").where(id_remainder("ann_id", 5) != 0)
    model = toxicity.fit_on(docs, known)
    return toxicity.score_labels(docs, model).select(
        F.col("ann_id").alias("doc_id"), (id_remainder("ann_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("image_id"), F.col("url").alias("uri"), F.col("html").alias("content"))
    folder = scratch_path(spark, "archive")
    written = archive.write_archive(pages, folder)
    return archive.read_archive(spark, folder, written, payloads=False).select(
        F.col("image_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"), "valid")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tile_id"), F.col("text").alias("image"))
    return sharding.shard_tiles(tiles).select(
        F.col("tile_id").alias("doc_id"), "size", F.col("content_crc32").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ann_id"), F.col("text").alias("label"), F.col("lang").alias("language"))
    model = language.fit_on(docs.where(id_remainder("ann_id", 5) != 0))
    return language.label_languages(docs, model).select(
        F.col("ann_id").alias("doc_id"), (id_remainder("ann_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_labels(notes(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.withColumnRenamed("ann_id", "doc_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """The asked damage by crc32 of `conv_id:turn`: rows dropped, emptied, without their ends of sentences, repeated or given to the user."""
    ids = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(c) for c in ("conv_id", ":", "turn")])
    kind = F.crc32(ids.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
                                F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repair = conversations.repair_chats(damaged(given), "conv_id", "turn", "role", "text")
    found = repair.summary().join(conversations.repaired_digests(repair).withColumnRenamed("chat", "ident"), F.col("chat").eqNullSafe(F.col("ident")), "left").drop("ident")
    everyone = given.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("chat")), "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return everyone.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_near_duplicates, op3_byte_bpe, op4_address_rules, op5_decontamination, op6_quality, op7_toxicity, op8_archive, op9_shards, op10_language,
                                   op11_main_text, op12_search, op13_chat_repair)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _edit(state: str, cost: str, letter: str, line: str, when: str = "TRUE") -> str:
    """A state (cost, audit, lines) after one more edit; out of reach unless `when` holds."""
    return f"{{'c': CASE WHEN {when} THEN {state}.c + {cost} ELSE 1000000000 END, 'a': {state}.a || '{letter}', 'l': {state}.l || {line}}}"


def _widened() -> str:
    """States z0 to z3 (nothing, system, user, assistant) after insertions."""
    user, helper = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    w2 = _least("z2", *[_edit(z, "3", "I", user) for z in ("z0", "z1", "z3")])
    return f"z0 AS w0, z1 AS w1, {w2} AS w2, {_least('z3', _edit(w2, '3', 'I', helper))} AS w3"


def _after_row() -> str:
    kept, user, helper = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"

    def gone(z: str) -> str:
        return _edit(z, "4", "D", "''")

    def stays(z: str, initial: str) -> str:
        return _edit(z, "late", "K", kept, f"NOT gone AND initial = '{initial}'")

    def given(z: str, line: str) -> str:
        return _edit(z, "3 + late", "R", line, "NOT gone")

    return ", ".join([f"{gone('w0')} AS z0", f"{_least(gone('w1'), stays('w0', 's'))} AS z1",
                      f"{_least(gone('w2'), *[x for z in ('w0', 'w1', 'w3') for x in (stays(z, 'u'), given(z, user))])} AS z2",
                      f"{_least(gone('w3'), stays('w2', 'a'), given('w2', helper))} AS z3"])


CRC32 = """xor(list_reduce([4294967295] || list_transform(string_split(key, ''), lambda ch: CAST(ord(ch) AS BIGINT)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295)"""

ORACLE_SQL = {
    "op13_chat_repair": f"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) copies WHERE kind <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
told AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
    NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS previous FROM numbered),
steps AS (SELECT conv_id, k, role, text, initial, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS late FROM told),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (WHERE previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM told GROUP BY conv_id),
chats AS (SELECT DISTINCT conv_id FROM conversations),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, {', '.join(f"{{'c': {0 if z == 0 else 1000000000}, 'a': '', 'l': ''}} AS z{z}" for z in range(4))} FROM chats
  UNION ALL
  SELECT conv_id, k, {_after_row()} FROM (
    SELECT p.conv_id, s.k, role, text, initial, gone, late, {_widened()} FROM path p JOIN steps s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.k = p.k + 1) widened),
ends AS (SELECT conv_id, k, {_widened()} FROM path),
best AS (SELECT e.conv_id, {_least('w0', 'w3')} AS z FROM ends e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id WHERE e.k = coalesce(f.n, 0))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(b.z.c AS BIGINT) AS cost, b.z.a AS audit, sha256(substr(b.z.l, 2)) AS repaired_sha256
FROM chats c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op2_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 1, 2))) t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS g FROM i, unnest(range(1, greatest(len(w) - 8, 2))) t(k) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM iw) l, unnest(range(1, len(w) - n + 2)) t(k)),
hit AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) t(p) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS items FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_address_rules": """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (
  SELECT a.page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM parts a JOIN rules r ON (a.host = r.h OR ends_with(a.host, '.' || r.h)) AND starts_with(a.path, r.p) GROUP BY a.page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parts p LEFT JOIN best b USING (page_id)""",
    "op12_search": f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
s AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
g AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM s),
m AS (SELECT doc_id, 100 - 90 + ((90 * n * nd) // l) AS m FROM s, g),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM c, g GROUP BY term, nd),
p AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN c USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM p WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
