"""One query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op01_token_counts as op01
from . import op02_near_dedup as op02
from . import op03_nearest_neighbours as op03
from . import op04_html_extraction as op04
from . import op05_best_fit_packing as op05
from . import op06_decontamination as op06
from . import op07_language_id as op07
from . import op08_quotation_linking as op08
from . import op09_sharding as op09
from . import op10_line_dedup as op10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01.document_token_counts(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, threshold=85)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03.nearest(_table(spark, sf_dir, "embeddings"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04.extract(_table(spark, sf_dir, "pages"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05.pack(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07.predicted_languages(_table(spark, sf_dir, "documents"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op08.reply_ordered(_table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", "parent_turn", "depth", "position", F.md5("formatted").alias("formatted_md5"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09.minimax_shards(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op10.remove_spread_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_near_dedup, op3_nearest_neighbours, op4_html_extraction, op5_best_fit_packing, op6_decontamination, op7_language_id, op8_quotation_linking, op9_sharding, op10_line_dedup)
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str, k: int) -> str:
    """SQL for (key, s): the distinct k-word shingles of each row's text, as a list."""
    words = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
    SELECT {key}, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: {words})) END AS s
    FROM (SELECT {key}, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table})"""


SQL: dict[str, str] = {
    "op2_near_dedup": f"""
WITH RECURSIVE sets AS MATERIALIZED ({_shingles("documents", "doc_id", 3)}),
n AS (SELECT doc_id, len(s) AS n FROM sets),
e AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS n_both FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT p, q FROM pairs JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * n_both >= 85 * (a.n + b.n - n_both)),
edges AS MATERIALIZED (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
reach(doc_id, place) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, q FROM reach r JOIN edges ON r.place = p)
SELECT n.doc_id, CAST(any_value(n) AS BIGINT) AS n_shingles, min(place) AS component_id, n.doc_id = min(place) AS kept
FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id""",
    "op6_decontamination": f"""
WITH d AS ({_shingles("documents", "doc_id", 5)}), i AS ({_shingles("benchmark", "item_id", 5)}),
de AS (SELECT doc_id, unnest(s) AS x FROM d), ie AS (SELECT item_id, len(s) AS n_item, unnest(s) AS x FROM i)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(any_value(n_item) AS BIGINT) AS n_item
FROM de JOIN ie ON de.x = ie.x GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)""",
    "op8_quotation_linking": r"""
WITH RECURSIVE messages AS MATERIALIZED (SELECT DISTINCT conv_id, turn, md5(text) AS own, text FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations) WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
lines AS MATERIALIZED (
    SELECT conv_id, turn, own, u.pos, regexp_extract(u.line, '^[ \t>]*') AS mark,
        lower(trim(regexp_replace(regexp_replace(u.line, '^[ \t]*>[ \t>]*', ''), '\s+', ' ', 'g'))) AS words
    FROM messages, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u),
leveled AS MATERIALIZED (SELECT *, len(mark) - len(replace(mark, '>', '')) AS level FROM lines),
marked AS (SELECT *, CASE WHEN level <> coalesce(lag(level) OVER m, -1) THEN 1 ELSE 0 END AS new FROM leveled WINDOW m AS (PARTITION BY conv_id, turn, own ORDER BY pos)),
quoted AS MATERIALIZED (SELECT conv_id, turn, own, passage, part, level, pos, words FROM (
    SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, own ORDER BY pos) AS passage, sum(CAST(words = '' AS INT)) OVER (PARTITION BY conv_id, turn, own ORDER BY pos) AS part FROM marked) WHERE level > 0 AND words <> ''),
line_firsts AS (SELECT conv_id, words, min(turn) AS from_turn FROM leveled WHERE level = 0 AND words <> '' GROUP BY ALL),
line_any AS (SELECT words, min({'c': conv_id, 't': from_turn}) AS any_ FROM line_firsts GROUP BY words),
runs AS (SELECT conv_id, turn, own, passage, part, string_agg(words, ' ' ORDER BY pos) AS words, count(*) AS n FROM quoted GROUP BY ALL
    UNION ALL SELECT conv_id, turn, own, passage, NULL, string_agg(words, ' ' ORDER BY pos), count(*) FROM quoted GROUP BY conv_id, turn, own, passage),
blocks AS MATERIALIZED (SELECT conv_id, turn, block FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '(?m)^[ \t]*>.*$')) AS block FROM messages) WHERE regexp_matches(block, '\S')),
folded AS MATERIALIZED (SELECT DISTINCT conv_id, turn, lower(trim(regexp_replace(block, '\s+', ' ', 'g'))) AS words FROM blocks),
wholes AS (SELECT conv_id, words, min(turn) AS from_turn FROM (SELECT * FROM folded UNION ALL
    SELECT conv_id, turn, lower(trim(regexp_replace(unnest(string_split_regex(block, '\n\s*\n')), '\s+', ' ', 'g'))) FROM blocks) GROUP BY conv_id, words),
whole_any AS (SELECT words, min({'c': conv_id, 't': from_turn}) AS any_ FROM wholes GROUP BY words),
held AS (SELECT r.conv_id, r.words, min(f.turn) AS from_turn FROM (SELECT DISTINCT conv_id, words FROM runs WHERE n > 1 OR len(string_split(words, ' ')) >= 5) r
    JOIN folded f ON f.conv_id = r.conv_id AND contains(' ' || f.words || ' ', ' ' || r.words || ' ') GROUP BY ALL),
nearest AS (SELECT conv_id, words, min(from_turn) AS from_turn FROM (SELECT * FROM wholes UNION ALL SELECT * FROM held) GROUP BY ALL),
run_found AS (SELECT r.conv_id, r.turn, r.own, r.passage, r.part, CASE WHEN n.from_turn < r.turn THEN n.from_turn END AS here, CASE WHEN a.any_.c <> r.conv_id THEN a.any_ END AS there
    FROM runs r LEFT JOIN nearest n ON n.conv_id = r.conv_id AND n.words = r.words LEFT JOIN whole_any a ON a.words = r.words),
line_found AS (SELECT q.*, coalesce(w.here, p.here, CASE WHEN l.from_turn < q.turn THEN l.from_turn END) AS here, coalesce(w.there, p.there, CASE WHEN a.any_.c <> q.conv_id THEN a.any_ END) AS there
    FROM quoted q LEFT JOIN line_firsts l ON l.conv_id = q.conv_id AND l.words = q.words LEFT JOIN line_any a ON a.words = q.words
    LEFT JOIN run_found w ON w.part IS NULL AND w.conv_id = q.conv_id AND w.turn = q.turn AND w.own = q.own AND w.passage = q.passage
    LEFT JOIN run_found p ON p.part = q.part AND p.conv_id = q.conv_id AND p.turn = q.turn AND p.own = q.own AND p.passage = q.passage),
votes AS (SELECT conv_id, turn, own, passage, level, from_conv, from_turn, count(*) AS n FROM (
    SELECT *, CASE WHEN here IS NOT NULL THEN conv_id ELSE there.c END AS from_conv, CASE WHEN here IS NOT NULL THEN here ELSE there.t END AS from_turn FROM line_found) WHERE from_conv IS NOT NULL GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, own, passage ORDER BY n DESC, from_conv <> conv_id, from_conv, from_turn) AS r FROM votes),
won AS (SELECT * FROM best WHERE r = 1 AND from_conv = conv_id),
answers AS (SELECT conv_id, turn, from_turn AS parent_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, from_turn) AS k FROM won) WHERE k = 1),
up(conv_id, turn, place, depth) AS (SELECT conv_id, turn, parent_turn, 1 FROM answers UNION ALL SELECT u.conv_id, u.turn, a.parent_turn, u.depth + 1 FROM up u JOIN answers a ON a.conv_id = u.conv_id AND a.turn = u.place),
roots AS (SELECT conv_id, turn, min(place) AS root, max(depth) AS depth FROM up GROUP BY ALL),
bodies AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN regexp_matches(coalesce(text, ''), '(?m)^[ \t]*>')
        THEN regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT contains(regexp_extract(x, '^[ \t>]*'), '>')), chr(10)), '^\s*\n|\n\s*$', '', 'g')
        ELSE coalesce(text, '') END AS body FROM conversations c),
rows_ AS (SELECT b.*, a.parent_turn, coalesce(r.root, b.turn) AS root, coalesce(r.depth, 0) AS depth
    FROM bodies b LEFT JOIN answers a ON a.conv_id = b.conv_id AND a.turn = b.turn LEFT JOIN roots r ON r.conv_id = b.conv_id AND r.turn = b.turn)
SELECT conv_id, turn, parent_turn, CAST(depth AS BIGINT) AS depth,
    row_number() OVER (PARTITION BY conv_id ORDER BY root NULLS FIRST, depth, turn NULLS FIRST, role NULLS FIRST, body) - 1 AS position,
    md5('<|' || coalesce(role, '') || '|>' || chr(10) || body) AS formatted_md5
FROM rows_""",
    "op10_line_dedup": """
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
bare AS (SELECT doc_id, source, trim(line, ' ' || chr(9) || chr(13)) AS line FROM lines),
spread AS (SELECT line, min(doc_id) AS first FROM bare WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
drops AS (SELECT doc_id, list(DISTINCT line) AS gone FROM bare JOIN spread USING (line) WHERE doc_id <> first GROUP BY doc_id),
cut AS (SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS all_lines,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(gone, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
    FROM documents d LEFT JOIN drops USING (doc_id))
SELECT doc_id, CAST(coalesce(len(all_lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(all_lines) - len(kept), 0) AS BIGINT) AS n_removed,
    md5(array_to_string(kept, chr(10))) AS text_md5 FROM cut""",
}
