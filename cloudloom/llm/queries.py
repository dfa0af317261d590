"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, infill, language, linededup, media, pieces, quality, rules, sample, secrets, simhash, toxicity, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str = pieces.VOCABULARY, n: int = 4) -> DataFrame:
    """doc_id, ids of the best segmentation and its score, the n - 1 next ones' scores and where they change the ids, and a digest of the decoded text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode(documents, pieces.load(vocabulary), n, other_ids=False)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "score", "others", F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: 3-word shingles, links at 3 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, distance, start, end for each document and benchmark item that it holds."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(documents, secrets.learn(documents))
    digest = F.transform("secrets", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    base = F.filter(digest, lambda s: ~s.startswith("learned"))

    def number(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, secrets.KINDS), F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"), F.concat_ws(",", digest).alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = sample.crc_of(F.col("doc_id")) % 4 == 2
    found = language.identify(documents, language.learn(documents, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""

    def row(kept: bytes, lines: int, dropped: int) -> tuple:
        return lines, dropped, hashlib.sha256(kept).hexdigest()

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(documents, row=row, schema="n_lines long, n_dropped long, kept_sha256 string", keep=["doc_id"])


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is stored as a PNG, WAV or BMP under a declared type that need not be right, or in a container; sniffed, carved, and read back."""

    def row(text: bytes) -> tuple:
        blob, declared = media.store(text)
        seen = media.inspect(blob, declared)
        payload = media.payload_of(blob, seen)
        feature = f"type={seen.kind} declared={declared} corrected={int(seen.corrected)} embedded={','.join(f'{t}:{o}:{n}' for o, n, t in seen.embedded)} rows={len(payload) // media.WIDTH}"
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature

    schema = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.each_text(table(spark, sf_dir, "documents"), row, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels of the rows that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = sample.crc_of(F.col("doc_id")) % 5 == 0
    found = toxicity.score(documents, toxicity.learn(documents, table(spark, sf_dir, "labels"), ~held))
    return found.select("doc_id", held.alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation, and of conversation -7, read back from the formatted output."""
    tricky = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.formatted(turns, texts=False, block=16)  # a turn of this template does not depend on others


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels of the rows that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    held = sample.crc_of(F.col("doc_id")) % 4 == 2
    found = quality.score(documents, quality.learn(documents, table(spark, sf_dir, "labels"), ~held))
    return found.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of 5 letters or more that is found 3 times."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.variants(variants.vocabulary(variants.runs(documents))).select("word", "form", "root", "n", "n_near", "form_n")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it."""
    found = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("fim"), F.col("form"))
    return found.select("doc_id", F.col("units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("fim", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, statistics, base_failed, kept and log_ratio of every document; trusted are those whose quality is labelled 1."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    found = rules.assess(documents, rules.learn(documents, trusted))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_ratio")


# --- parts that SQL can say ---------------------------------------------------------


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded texts of op1."""
    return op1_sentencepiece(spark, sf_dir).select("doc_id", "decoded_sha256")


def exact_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of op3 without an edit."""
    return op3_decontamination(spark, sf_dir).where("distance = 0").select("doc_id", "item_id", "start", "end")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of op4's base spans."""
    return op4_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7 reads back."""
    return op7_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def chat_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9 reads back."""
    return op9_chat_formatting(spark, sf_dir).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def rule_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op13 counts in each text."""
    return rules.assess(table(spark, sf_dir, "documents").select("doc_id", "text"), None)


OPERATORS = (
    op1_sentencepiece, op2_simhash, op3_decontamination, op4_secret_scan, op5_language_id, op6_line_dedup, op7_media_columns, op8_toxicity, op9_chat_formatting, op10_quality,
    op11_spelling_variants, op12_fill_in_middle, op13_quality_rules,
)
PARTS = (piece_round_trip, exact_leaks, secret_base_counts, media_payloads, chat_digests, rule_statistics)
QUERIES = {f.__name__: f for f in (*OPERATORS, *PARTS)}

_OP6 = r"""
WITH lines AS (
  SELECT doc_id, l.pos AS pos, l.line AS line, translate(regexp_replace(regexp_replace(l.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {'pos': i, 'line': x})) AS l FROM documents)
), shared AS (
  SELECT key, max(doc_id) AS largest FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT doc_id, pos, line, shared.key IS NOT NULL AND doc_id <> largest AS dropped FROM lines LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_ROUND_TRIP = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"

_LEAKS = r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM benchmark WHERE text IS NOT NULL)
SELECT doc_id, item_id, strpos(d.t, i.t)::BIGINT - 1 AS start, strpos(d.t, i.t)::BIGINT - 1 + length(i.t) AS "end" FROM d JOIN i ON contains(d.t, i.t) WHERE length(i.t) >= 20
"""

_SECRETS = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex
FROM t
"""

_PAYLOADS = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
p AS (SELECT doc_id, n, text || repeat(chr(0), CASE WHEN n = 0 THEN 64 ELSE (64 - n % 64) % 64 END) AS payload FROM t)
SELECT doc_id, n AS n_bytes, strlen(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256 FROM p
"""

_DIGESTS = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), a AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256 FROM a
"""

_INFILL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents),
d AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
), c AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b FROM d),
s AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM s
"""

_RULES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM t),
x AS (
  SELECT doc_id, i, word, list_slice(words, i, i + 7) AS gram, len(words) AS size
  FROM (SELECT doc_id, words, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w)
), g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) > 1 AND i + 7 <= size AS twice FROM x),
r AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE near) AS n_repeat_words
  FROM (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS near FROM g) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(lines) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), s AS (
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda v: length(v))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s
"""

#: Without SQL of their own: op1 (lattices), op2 (XXH64), op3 (edit distance within a text), op4 (match positions), op7 and op9 (digests of rebuilt bytes), op11 (CRC32), and the learned models.
ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": _OP6,
    "piece_round_trip": _ROUND_TRIP,
    "exact_leaks": _LEAKS,
    "secret_base_counts": _SECRETS,
    "media_payloads": _PAYLOADS,
    "chat_digests": _DIGESTS,
    "op12_fill_in_middle": _INFILL,
    "rule_statistics": _RULES,
}
