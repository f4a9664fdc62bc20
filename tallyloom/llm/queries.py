"""One registered query per operator, with its production parameters over its whole table, and SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: F401

from . import op01_bitplanes, op02_language_mixture, op03_style_tree, op04_toxicity, op05_positional_index, op06_pruned_graph, op07_radix_dedup, op08_quality_neighbours, op09_simhash_trie, op10_bpe_tree, op11_token_transducer, op12_prefix_trie, op13_structure_repair
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_bit_plane_shuffling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_bitplanes.encode_write_read(table(spark, sf_dir, "documents"))


@register
def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_language_mixture.languages(table(spark, sf_dir, "documents"))


@register
def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_style_tree.main_text(table(spark, sf_dir, "pages"))


@register
def op4_subword_bag_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op5_positional_inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_positional_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op5_positional_inverted_index"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, ws[k:k + least(len(ws), 13) - 1] AS win
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
dk AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM d, lengths WHERE len(ws) >= n),
hit AS (SELECT dk.doc_id, dk.k, dk.n, iw.item_id FROM dk JOIN iw ON iw.n = dk.n AND iw.win = dk.ws[dk.k:dk.k + dk.n - 1]),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


@register
def op6_robust_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_pruned_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op6_robust_pruned_graph"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON least.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""


@register
def op7_radix_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_radix_dedup.digests(op07_radix_dedup.remove_repeats(table(spark, sf_dir, "documents")))


@register
def op8_neighbour_voting_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_quality_neighbours.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op9_simhash_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op10_bpe_tree_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_bpe_tree.digests(op10_bpe_tree.encode_decode(table(spark, sf_dir, "documents")))


@register
def op11_transducer_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_token_transducer.token_counts(table(spark, sf_dir, "documents"))


@register
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_prefix_trie.digests(op12_prefix_trie.trie(table(spark, sf_dir, "conversations")))


# crc32 of the decimal id, a byte and then a bit at a time
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
       lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda k, z: xor(k >> 1, CASE WHEN k & 1 = 1 THEN 3988292384 ELSE 0 END))))"""
ORACLES["op12_conversation_prefix_trie"] = f"""
WITH l AS MATERIALIZED (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS s
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
m AS (SELECT c, s, c - c % 5 AS b, CAST({_CRC} % 9 AS BIGINT) AS h FROM l),
seqs AS MATERIALIZED (SELECT m.c, list_concat(coalesce(base.s[1:h], []), m.s[h + 1:]) AS s FROM m LEFT JOIN l base ON base.c = m.b),
prefixes AS (SELECT c, s, d, s[1:d] AS k FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS MATERIALIZED (SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d) AS ends FROM prefixes GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
above AS (SELECT nodes.k[1:a] AS k, n IS NULL AS leaf, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(nodes.k[d].x) END AS saved
          FROM (SELECT k, d, n_convs, unnest(range(0, d + 1)) AS a FROM nodes) nodes LEFT JOIN kids ON kids.k = nodes.k),
below AS (SELECT k, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved FROM above GROUP BY k)
SELECT nodes.conv_id, CAST(nodes.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(nodes.ends, '')) AS ends_sha256
FROM nodes JOIN below ON below.k = nodes.k LEFT JOIN kids ON kids.k = nodes.k LEFT JOIN nodes up ON nodes.d > 0 AND up.k = nodes.k[1:nodes.d - 1]"""


@register
def op13_conversation_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_structure_repair.repair(table(spark, sf_dir, "conversations"))


def _way(cost: str, edit: str, line: str | None, rest: str) -> str:
    lines = f"{rest}.l" if line is None else f"list_prepend({line}, {rest}.l)"
    return f"{{'c': {cost} + {rest}.c, 'a': '{edit}' || {rest}.a, 'l': {lines}}}"


def _row_ways(q: int) -> str:
    to, role = (4, "assistant") if q == 3 else (3, "user")
    ways = [_way("3", "D", None, f"v[{q}]")]
    rename = _way("2 + t.late", "R", f"'{role}:' || t.x", f"v[{to}]")
    kept = {role[0]: to, **({"s": 2} if q == 1 else {})}
    keep = "".join(f" WHEN t.i = '{i}' THEN {_way('t.late', 'K', f_line, f'v[{k}]')}" for (i, k), f_line in zip(kept.items(), ["t.r || ':' || t.x"] * 2))
    return f"CASE WHEN t.gone THEN {ways[0]} ELSE list_min([{ways[0]}, {rename}, CASE{keep} ELSE {rename} END]) END"


_INSERTED = "[" + ", ".join(f"list_min([w[{q}], {_way('2', 'I', chr(39) + 'user:' + chr(39), 's')}])" if q != 3 else "s" for q in (1, 2, 3, 4)) + "]"
_SECOND = f"list_min([w[3], {_way('2', 'I', chr(39) + 'assistant:' + chr(39), 'w[4]')}])"
_NAME = _CRC.replace("CAST(c AS VARCHAR)", "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
_DONE, _NO = "{'c': 0, 'a': '', 'l': CAST([] AS VARCHAR[])}", "{'c': 1000000, 'a': '', 'l': CAST([] AS VARCHAR[])}"
ORACLES["op13_conversation_structure_repair"] = f"""
WITH RECURSIVE source AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x, {_NAME} % 20 AS k FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS r, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x
         FROM (SELECT * FROM source UNION ALL SELECT * FROM source WHERE k = 3) WHERE k <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, md5(strlen(r) || ':' || r || x)) AS n, rtrim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS e FROM hurt),
marked AS (SELECT *, e = '' AS blank, e <> '' AND row_number() OVER (PARTITION BY conv_id, r, x ORDER BY n) > 1 AS again, left(r, 1) AS i,
                  left(r, 1) || coalesce(lead(left(r, 1)) OVER (PARTITION BY conv_id ORDER BY n), '?') AS pair FROM numbered),
faults AS (SELECT *, NOT blank AND NOT again AND right(e, 1) NOT IN ('.', '!', '?') AS late FROM marked),
convs AS MATERIALIZED (SELECT conv_id, list({{'gone': blank OR again, 'late': CAST(late AS INT), 'i': i, 'r': r, 'x': x}} ORDER BY n) AS rows, count(*) AS n,
          max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS again, count(*) FILTER (late) AS late,
          count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) - 1 AS illegal FROM faults GROUP BY conv_id),
repaired AS (
  SELECT conv_id, n AS k, {_INSERTED} AS v FROM (SELECT *, {_SECOND} AS s FROM (SELECT *, [{_DONE}, {_NO}, {_NO}, {_DONE}] AS w FROM convs))
  UNION ALL
  SELECT conv_id, k - 1, {_INSERTED} FROM (SELECT *, {_SECOND} AS s FROM (SELECT conv_id, k, [{", ".join(map(_row_ways, (1, 2, 3, 4)))}] AS w
    FROM (SELECT repaired.conv_id, k, v, rows[k] AS t FROM repaired JOIN convs ON repaired.conv_id IS NOT DISTINCT FROM convs.conv_id WHERE k > 0)))),
best AS (SELECT conv_id, v[1] AS b FROM repaired WHERE k = 0)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(again, 0) AS duplicate, coalesce(late, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN convs ON convs.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id"""
