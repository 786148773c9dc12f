"""Queries of the training-data operators: name -> f(spark, sf_dir) -> DataFrame.

Each applies its operator to the whole intended table with production
parameters.  ``ORACLE`` has DuckDB SQL where SQL can express the result.
"""

from __future__ import annotations

from . import chat, decontaminate, htmltext, language, pieces, prefixes, quadratic, quality, repeats, secrets, simhash, tokens, variants
from .common import table

QUERIES: dict = {}
ORACLE: dict = {}


def op1_simhash_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_decontaminate(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).drop("found")


def op4_chat_format(spark, sf_dir):
    return chat.conversation_digests(chat.format_turns(chat.with_extra(table(spark, sf_dir, "conversations"))))


def op6_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark, sf_dir):
    return pieces.encode_documents(table(spark, sf_dir, "documents"))


def op10_html_text(spark, sf_dir):
    return htmltext.extract_text(table(spark, sf_dir, "pages"))


def op11_quality_classifier(spark, sf_dir):
    return quadratic.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark, sf_dir):
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES.update({f.__name__: f for f in (
    op1_simhash_dedup, op2_suffix_dedup, op3_secret_scan, op4_chat_format, op5_decontaminate, op6_token_counts, op7_language_id,
    op8_quality_rules, op9_sentencepiece, op10_html_text, op11_quality_classifier,
    op12_prefix_trie, op13_spelling_variants)})

ORACLE["op4_chat_format"] = r"""
WITH given AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(15 + length(role) + length(regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g'))) AS BIGINT)
           AS formatted_chars
FROM t GROUP BY conv_id
"""

ORACLE["op5_decontaminate"] = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, len, array_to_string(w[i + 1 : i + len], ' ') AS win
    FROM (SELECT item_id, w, least(13, len(w)) AS len, unnest(range(len(w) - least(13, len(w)) + 1)) AS i
          FROM items WHERE len(w) > 0)
), lens AS (SELECT DISTINCT len FROM windows),
found AS (
    SELECT d.doc_id, d.i, d.len, v.item_id
    FROM (SELECT doc_id, len, i, array_to_string(w[i + 1 : i + len], ' ') AS win
          FROM (SELECT doc_id, w, len, unnest(range(len(w) - len + 1)) AS i FROM words, lens WHERE len(w) >= len)) d
    JOIN windows v ON v.win = d.win AND v.len = d.len
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len)) AS p FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items,
           string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# CRC-32 (unsigned) of the bytes of a list column b, by a table that the query builds.
CRC_TABLE = """
crc_table AS (
    SELECT list(c ORDER BY i) AS tab FROM (
        SELECT i, list_reduce(list_concat([CAST(i AS BIGINT)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
                              lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) t(i))
)"""
CRC = ("xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {b}), "
       "lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)")

ORACLE["op12_prefix_trie"] = f"""
WITH {CRC_TABLE}, turns AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY turn NULLS FIRST, role, text) AS k,
           list(CAST(octet_length(encode(text)) AS BIGINT) ORDER BY turn NULLS FIRST, role, text) AS z
    FROM turns GROUP BY conv_id
), cuts AS (
    SELECT conv_id, k, z, {CRC.format(b="list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda y: CAST(ord(y) AS BIGINT))")} % 9 AS h
    FROM own, crc_table
), made AS (
    SELECT c.conv_id, list_concat(coalesce(d.k[1:c.h], []), c.k[c.h + 1:]) AS k,
           list_concat(coalesce(d.z[1:c.h], []), c.z[c.h + 1:]) AS z
    FROM cuts c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 5
), member AS (
    SELECT conv_id, len(k) AS n, d, coalesce(array_to_string(k[1:d], ''), '') AS key, CASE WHEN d > 0 THEN z[d] ELSE 0 END AS size
    FROM (SELECT *, unnest(range(len(k) + 1)) AS d FROM made)
), node AS (
    SELECT d AS depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
    FROM member GROUP BY d, key
), kids AS (
    SELECT substr(key, 1, 64 * (CAST(depth AS INT) - 1)) AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), full_node AS (
    SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (key)
), sums AS (
    SELECT substr(key, 1, 64 * CAST(j AS INT)) AS key, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens,
           CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves
    FROM (SELECT *, unnest(range(depth + 1)) AS j FROM full_node) GROUP BY 1
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_node f JOIN sums s USING (key)
LEFT JOIN full_node p ON f.depth > 0 AND p.key = substr(f.key, 1, 64 * (CAST(f.depth AS INT) - 1))
"""

ORACLE["op13_spelling_variants"] = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-zÀ-ÿ]+')) AS run FROM documents
), coded AS (
    SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs WHERE length(run) >= 5
), hashed AS (
    SELECT run, {CRC.format(b="list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT))")} AS h
    FROM coded, crc_table
), seen AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
                ELSE run END AS word FROM hashed
), words AS (
    SELECT word, count(*) AS n FROM seen WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3
), less AS (
    SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest
    FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
    SELECT word, count(*) AS n_near, max(other_n) AS most, arg_max(other, (other_n, -place)) AS form
    FROM (SELECT near.*, rank() OVER (ORDER BY other) AS place FROM near) GROUP BY word
), judged AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN form END AS form,
           CASE WHEN most >= 2 * w.n THEN most END AS form_n
    FROM words w LEFT JOIN best USING (word)
), chain AS (
    SELECT word, word AS root FROM judged
    UNION ALL SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.root WHERE j.form IS NOT NULL
)
SELECT j.word, j.form, c.root, j.n, j.n_near, j.form_n
FROM judged j JOIN chain c USING (word) JOIN judged e ON e.word = c.root AND e.form IS NULL
"""
