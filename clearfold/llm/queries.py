"""Registered queries of this subpackage, one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearfold.checks.base import Check, table
from clearfold.llm import chat, counts, decontaminate, htmltext, licences, lmscore, mixing, neardup, quality, repair, tokens, trie, warc
from clearfold.session import cut


def op1_token_output(spark: SparkSession, d: str) -> DataFrame:
    manifest = tokens.write_shards(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_shards(manifest)


def op2_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, d, "pages")))


OP2_SQL = """
WITH payloads AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS hex FROM pages),
firsts AS (SELECT hex, max(page_id) AS response FROM payloads GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(p.hex || '0', CAST(i * 5 // 4 + 1 AS INTEGER), 2) AS INTEGER) >> (3 - CAST(i * 5 % 4 AS INTEGER))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to, true AS verified
FROM payloads p JOIN firsts f ON p.hex = f.hex
"""


def op3_benchmark_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.report(table(spark, d, "documents"), table(spark, d, "benchmark"))


OP3_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM dw, (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM places p JOIN win ON p.n = win.n AND p.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op4_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    odd = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))]))
    extra = spark.range(1).select(odd.alias("t")).select(
        F.lit(-7).cast("bigint").alias("conv_id"), "t.turn", "t.role", F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(turns.unionByName(extra))


OP4_SQL = r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (SELECT *, len(text) + len(text) - len(replace(text, '\', ''))
    + 2 * len(regexp_extract_all(text, '<</SYS>>|<<SYS>>|\[/INST\]|\[/ROLE\]|\[INST\]|\[ROLE\]|\[END\]|\[OUT\]|</s>|<s>'))
    + CASE role WHEN 'system' THEN 8 + 10 WHEN 'user' THEN 10 + 8 WHEN 'assistant' THEN 6 + 5 ELSE 7 + 9 + 6 + len(role) END AS chars,
    lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS prior,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and((prior || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) AND bool_or(from_end = 1 AND role = 'assistant') AS valid
FROM sized GROUP BY conv_id
"""


def op5_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return neardup.report(table(spark, d, "documents"))


OP5_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM dw)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 85 * (s.n + t.n - k)),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM dw UNION SELECT l.y, r.root FROM reach r JOIN links l ON l.x = r.doc_id),
comp AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM comp c LEFT JOIN sizes s ON s.doc_id = c.doc_id
"""


def op6_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return htmltext.extract(table(spark, d, "pages"))


def op7_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    judged = quality.judge(docs, quality.learn_rules(docs, labels))
    counts = [F.col(f"stats.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, "base_failed", "kept", "rule")


def op8_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licences.report(table(spark, d, "documents"))


def op9_weighted_fair_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(table(spark, d, "documents"))


OP9_SQL = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(CAST(doc_id AS VARCHAR) || ':' || md5(coalesce(text, ''))) AS o FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
weighted AS (SELECT *, 3 * source_size AS cap, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS w FROM src),
levels AS (SELECT *, row_number() OVER o AS place,
    CAST((SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
    CAST((SELECT sum(w) FROM weighted) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS w_left
  FROM weighted WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST)),
level AS (SELECT remaining, w_left FROM levels WHERE cap * w_left >= remaining * w ORDER BY place LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN l.cap * l.w_left >= l.remaining * l.w
    THEN CAST(l.w * v.remaining AS DOUBLE) / CAST(v.w_left AS DOUBLE) ELSE CAST(l.cap AS DOUBLE) END AS target FROM levels l, level v),
queued AS (SELECT s.*, source_size, target,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead_in_source
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
slots AS (SELECT *, (CAST(r * source_size + ahead_in_source AS DOUBLE) + CAST(size AS DOUBLE) / CAST(2 AS DOUBLE)) / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS r) WHERE size > 0),
lined AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM slots),
times AS (SELECT doc_id, count(*) AS n FROM lined WHERE CAST(ahead AS DOUBLE) + CAST(size AS DOUBLE) / CAST(2 AS DOUBLE) <= (SELECT sum(source_size) FROM src) GROUP BY 1)
SELECT q.doc_id, size, source_size, target, CAST(coalesce(n, 0) * size AS BIGINT) AS taken, CAST(coalesce(n, 0) AS BIGINT) AS times
FROM queued q LEFT JOIN times t ON q.doc_id = t.doc_id
"""


def op10_recurrent_lm(spark: SparkSession, d: str) -> DataFrame:
    return lmscore.report(table(spark, d, "documents"))


def op11_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return counts.count_tokens(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return trie.trie(cut(trie.rebuild(cut(trie.sequences(table(spark, d, "conversations"))))))


CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

OP12_SQL = f"""
WITH own AS (SELECT conv_id, list({{'d': md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')),
    'b': octet_length(encode(coalesce(text, '')))}} ORDER BY turn NULLS FIRST,
    md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
heads AS (SELECT o.conv_id, o.s, b.s AS head, {CRC32_SQL.format("CAST(o.conv_id AS VARCHAR)")} % 9 AS h
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
rebuilt AS (SELECT conv_id, list_concat(coalesce(head, [])[1:h], s[h + 1:]) AS s FROM heads),
cells AS (SELECT conv_id, len(s) AS n, d, array_to_string([x.d for x in s[1:d]], '') AS k, CASE WHEN d > 0 THEN s[d].b ELSE 0 END AS b
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM cells GROUP BY 1, 2),
linked AS (SELECT c.k, c.d, c.conv_id, c.n_convs, c.b, c.ends, p.conv_id AS parent_conv_id, p.k AS pk, p.d AS pd
  FROM nodes c LEFT JOIN nodes p ON p.d = c.d - 1 AND p.k = substr(c.k, 1, CAST(32 * (c.d - 1) AS BIGINT))),
children AS (SELECT pk AS k, pd AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY 1, 2),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.k = l.k AND c.d = l.d),
subtree AS (SELECT p.k, p.d, CAST(sum(CASE WHEN y.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((y.n_convs - 1) * y.b) AS BIGINT) AS saved
  FROM counted y JOIN cells p ON p.conv_id = y.conv_id AND p.d <= y.d GROUP BY 1, 2)
SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, parent_conv_id, n_convs, CAST(n_children AS BIGINT) AS n_children, n_leaves, saved AS saved_tokens, sha256(ends) AS ends_sha256
FROM counted c JOIN subtree s ON s.k = c.k AND s.d = c.d
"""


def _edit_sql(cost: str, letter: str, line: str, after: str) -> str:
    return f"{{'c': {cost} + {after}.c, 'a': '{letter}' || {after}.a, 'r': {line} || {after}.r}}"


def _row_sql(state: int) -> str:
    """Cheapest edit of a row in a state; states count from 1, the order of the vector."""
    follows = {1: (3, "user"), 2: (3, "user"), 3: (4, "assistant"), 4: (3, "user")}[state]
    kept = {1: {"s": 2, "u": 3}, 2: {"u": 3}, 3: {"a": 4}, 4: {"u": 3}}[state]
    line = "chr(10) || role || ':' || text"
    keep = " ".join(f"WHEN '{i}' THEN {_edit_sql('cut', 'K', line, f'b[{to}]')}" for i, to in kept.items())
    rerole = _edit_sql("2 + cut", "R", f"chr(10) || '{follows[1]}:' || text", f"b[{follows[0]}]")
    return f"least({_edit_sql('3', 'D', repr(''), f'b[{state}]')}, CASE WHEN NOT gone THEN {rerole} END, CASE WHEN NOT gone THEN CASE left(role, 1) {keep} END END)"


def _with_inserts_sql(state: int) -> str:
    u, a = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    one, two, first, second = (4, 3, a, u) if state == 3 else (3, 4, u, a)
    return f"least(e[{state}], {_edit_sql('2', 'I', first, f'e[{one}]')}, {_edit_sql('4', 'II', f'{first} || {second}', f'e[{two}]')})"


OP13_SQL = f"""
WITH RECURSIVE coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {CRC32_SQL.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS code FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM coded, range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
placed AS (SELECT *, row_number() OVER o AS i, lag(role) OVER o AS prior, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || text))),
judged AS (SELECT *, seen = '' AS blank, seen <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate FROM placed),
faults AS (SELECT *, blank OR duplicate AS gone, CASE WHEN blank OR duplicate OR right(seen, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS cut FROM judged),
steps AS (SELECT conv_id, count(*) + 1 AS i, [{{'c': 0, 'a': '', 'r': ''}}, {{'c': 4, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}},
    {{'c': 2, 'a': 'I', 'r': chr(10) || 'assistant:'}}, {{'c': 0, 'a': '', 'r': ''}}] AS b FROM faults GROUP BY 1
  UNION ALL SELECT conv_id, i, [{", ".join(_with_inserts_sql(k) for k in (1, 2, 3, 4))}] FROM (
    SELECT f.conv_id, f.i, [{", ".join(_row_sql(k) for k in (1, 2, 3, 4))}] AS e FROM steps s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i - 1)),
best AS (SELECT conv_id, b[1] AS x FROM steps WHERE i = 1),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, sum(cut) AS truncated,
    count(*) FILTER (i > 1 AND left(prior, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY 1)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(x.c, 0) AS BIGINT) AS cost,
  coalesce(x.a, '') AS audit, sha256(coalesce(substr(x.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def damaged(turns: DataFrame) -> DataFrame:
    """Conversation rows with faults that a checksum of id and turn deals out."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    coded = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), code.alias("code")).where(F.col("code") != 0)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1)))
    return coded.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op13_structure_repair(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    rows = damaged(turns)
    return repair.report(rows, repair.repair(rows), ids=turns)


CHECKS = [
    Check("op1_token_output", op1_token_output),
    Check("op2_warc", op2_warc, OP2_SQL),
    Check("op3_benchmark_decontamination", op3_benchmark_decontamination, OP3_SQL),
    Check("op4_chat_formatting", op4_chat_formatting, OP4_SQL),
    Check("op5_minhash_near_dedup", op5_minhash_near_dedup, OP5_SQL),
    Check("op6_html_extraction", op6_html_extraction),
    Check("op7_quality_rules", op7_quality_rules),
    Check("op8_license_scan", op8_license_scan, licences.SQL),
    Check("op9_weighted_fair_mix", op9_weighted_fair_mix, OP9_SQL),
    Check("op10_recurrent_lm", op10_recurrent_lm),
    Check("op11_token_counts", op11_token_counts),
    Check("op12_prefix_trie", op12_prefix_trie, OP12_SQL),
    Check("op13_structure_repair", op13_structure_repair, OP13_SQL),
]
