"""The thin queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import op1_substrings, op2_embeddings, op3_lines, op4_quality, op5_mixing, op6_sharding, op7_html, op8_jaccard, op9_packing, op10_winnowing, op11_trie, op12_bpe, op13_runs
from spindrift.llm.common import documents

N_SHARDS = 8


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op1_substrings.dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_embeddings.near_duplicates(documents(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op3_lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = op4_quality.fit(op4_quality.training_rows(docs, documents(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return op4_quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op6_sharding_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op6_sharding.shard(documents(spark, sf_dir), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages")
    weights = op7_html.fit_weights(op7_html.labelled_pages(pages, documents(spark, sf_dir)))
    return op7_html.extract(pages.select("page_id", "url", "html"), weights).select("page_id", "url", "text", "n_chars")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_jaccard.similar(documents(spark, sf_dir), words=3, threshold=(90, 100))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_packing.pack(documents(spark, sf_dir), tokenizer_path())


def op10_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op10_winnowing.fingerprint_documents(documents(spark, sf_dir))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op11_trie.conversation_trie(documents(spark, sf_dir, "conversations"), shared_heads=True)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op12_bpe.encode_documents(documents(spark, sf_dir), tokenizer_path())
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op13_runs.find_runs(documents(spark, sf_dir), op13_runs.repeated_tail)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2("runs", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_embedding_near_dedup, op3_line_dedup, op4_quality_classifier, op5_source_mixing, op6_sharding_bytes, op7_html_extraction, op8_ngram_jaccard_join, op9_best_fit_packing, op10_winnowing_fingerprints, op11_conversation_trie, op12_bpe_round_trip, op13_periodic_runs)
}

#: A-Z to a-z alone, as the contracts say; lower() would change other letters.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split
), keyed AS (
  SELECT *, {_LOWER.format("regexp_replace(line, '^[ \\x09-\\x0D]+|[ \\x09-\\x0D]+$', '', 'g')")} AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix:' || doc_id::VARCHAR) AS key, md5(coalesce(text, '')) AS tie
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS i
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM sources
), levels AS (
  SELECT *,
    (sum(source_size) OVER () * 1.5::DOUBLE
      - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER ()
      - coalesce(sum(weight) OVER (ORDER BY source_size / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), marked AS (
  SELECT *, 2 * source_size <= level * weight AS stops FROM levels
), rest AS (
  SELECT first(level ORDER BY source_size / weight, i) AS level FROM marked WHERE NOT stops
), targets AS (
  SELECT source, source_size,
         CASE WHEN stops THEN (2 * source_size)::DOUBLE ELSE (SELECT level FROM rest) * weight END AS target
  FROM marked
), queued AS (
  SELECT d.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), served AS (
  SELECT *, CASE WHEN target > 0 THEN (start + pass * source_size + size / 2) / target ELSE 8.0 END AS time
  FROM queued, (VALUES (0), (1)) passes(pass)
), cut AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY time > 4, time, key, doc_id, tie, pass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + size / 2 <= (SELECT sum(size) * 1.5 FROM sized) AND time <= 4 AS taken
  FROM served
)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 4) AS target, (size * count(*) FILTER (taken))::BIGINT AS taken
FROM cut GROUP BY doc_id, key, tie, size, source_size, target, start
"""

_OP8 = f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ \\x09-\\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE
    list_distinct(list_transform(range(1, greatest(len(words) - 2, 1) + 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles
  FROM split
), tokens AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.shingle = b.shingle
  WHERE a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, len(any_value(shingles)) AS n_shingles, min(other) AS component_id
FROM sets s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id
"""

_OP1 = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM split WHERE len(words) >= 20
), named AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS seq FROM windows
), later AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) > 1 AS again FROM named
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later WHERE again
), words AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM split
), kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text, count(*) AS n
  FROM words w ANTI JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id
)
SELECT s.doc_id, len(words) AS n_words, len(words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

#: crc32 of a decimal number: the polynomial taken bit by bit.
_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, byte:
  list_reduce([xor(crc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"""

_OP11 = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC32.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, t.i, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i < c.h
  UNION ALL
  SELECT c.conv_id, t.i + 10, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h
), placed AS (
  SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS depth, md5(length(role) || ':' || role || text) AS turn FROM rebuilt
), chained AS (
  SELECT conv_id, depth, length(text) AS chars, string_agg(turn, ',') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), keyed AS (
  SELECT conv_id, depth, chars, md5(path) AS node, max(depth) OVER (PARTITION BY conv_id) AS n, lag(md5(path)) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM chained
), nodes AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved,
         sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
  FROM keyed GROUP BY node, depth
), children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT DISTINCT a.node, b.node AS low FROM keyed a JOIN keyed b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), sums AS (
  SELECT b.node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum(x.saved) AS saved_tokens
  FROM below b JOIN nodes x ON x.node = b.low LEFT JOIN children c ON c.node = b.low GROUP BY b.node
)
SELECT x.conv_id, x.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN sums s USING (node) LEFT JOIN children c USING (node) LEFT JOIN nodes p ON p.node = x.parent
"""


def _op13(doublings: int = 16) -> str:
    """Documents of up to ``4 << doublings`` words.

    A gram of 3 or 4 powers of two, if it is 2 to 3 periods long, next occurs one
    period later, and nowhere in between: stretches of such places are the runs.
    The name of a gram is made of two shorter ones.
    """
    sql = f"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS words, {_CRC32.format("coalesce(doc_id, 0)")} AS h FROM documents
), bent AS (
  SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 AND doc_id IS NOT NULL THEN (h // 10) % len(words) ELSE len(words) END AS a FROM split
), final AS (
  SELECT doc_id, d, list_transform(range(0, n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) AS words FROM bent
), word AS (
  SELECT d, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM final
), g1 AS MATERIALIZED (SELECT d, i, md5(word) AS k FROM word)"""
    join = "SELECT x.d, x.i, md5(x.k || y.k) AS k FROM g{0} x JOIN g{1} y ON y.d = x.d AND y.i = x.i + {0}"
    runs = []
    for s in (1 << j for j in range(doublings)):
        sql += f", g{2 * s} AS MATERIALIZED ({join.format(s, s)})"
        for gram, table, near in ((3 * s, join.format(2 * s, s), f"q >= {s} AND 2 * q < {3 * s}"), (4 * s, join.format(2 * s, 2 * s), f"2 * q >= {3 * s} AND q < {2 * s}")):
            runs.append(f"""SELECT d, min(i) AS start, count(*) + q + {gram - 1} AS length, q AS period
  FROM (SELECT d, i, q, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS island
        FROM (SELECT d, i, lead(i) OVER (PARTITION BY d, k ORDER BY i) - i AS q FROM ({table})) WHERE {near})
  GROUP BY d, q, island HAVING count(*) + q + {gram - 1} >= greatest(6, 4 * q)""")
    return sql + ", runs AS MATERIALIZED (" + " UNION ALL ".join(runs) + """
), gone AS (
  SELECT DISTINCT d, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT w.d, string_agg(word, ' ' ORDER BY w.i) AS text FROM word w ANTI JOIN gone g ON w.d = g.d AND w.i = g.i GROUP BY w.d
), best AS (
  SELECT d, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
         first({'s': start, 'l': length, 'p': period} ORDER BY length::DOUBLE / period DESC, start, period) AS top
  FROM runs GROUP BY d
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.l AS length, top.p AS period, 1000 * top.l // top.p AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM final f LEFT JOIN best b ON f.d = b.d LEFT JOIN kept k ON f.d = k.d
"""


ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op8_ngram_jaccard_join": _OP8, "op3_line_dedup": _OP3, "op5_source_mixing": _OP5, "op11_conversation_trie": _OP11, "op13_periodic_runs": _op13()}
