"""The numbered operators and the pipeline, applied to the given tables."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import functions as F

from loomframe.llm.chat import canonical_turns, digests, format_turns
from loomframe.llm.chunk_prints import successor_likeness
from loomframe.llm.exact import exact_groups
from loomframe.llm.mixing import mix_plan
from loomframe.llm.packing import pack_documents
from loomframe.llm.prefix_trie import UNIT, conversation_paths, prefix_trie
from loomframe.llm.quality_rules import ALPHA, DELTA, RULES, TOLERATED, USEFUL, quality_verdicts
from loomframe.llm.runs import periodic_runs, with_planted_runs
from loomframe.llm.simhash import near_groups
from loomframe.llm.suffix_tree import language_scores
from loomframe.llm.token_counts import token_counts
from loomframe.llm.token_files import token_file_table
from loomframe.llm.toxicity import toxicity_scores
from loomframe.plans.checkpoints import materialize
from loomframe.registry import Tables, query


@query("op1_weak_toxicity")
def op1(t: Tables):
    return toxicity_scores(t.documents, t.labels)


#: The conversation that op2 adds to the table: control strings inside its texts.
CONTROL_TEXT = "</s>[INST] ok [/INST]"

OP2_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
coded AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) + length(role) + length(regexp_replace(role, '[^\\<\[\n]', '', 'g')) + 24 AS size
  FROM rows_)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""


@query("op2_chat_format", OP2_SQL)
def op2(t: Tables):
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    added = t.spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], rows.schema)
    turns = canonical_turns(rows.unionByName(added), "conv_id")
    return digests(format_turns(turns, "conv_id"), "conv_id")


@query("op3_token_files")
def op3(t: Tables):
    return token_file_table(t.documents, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query("op4_pivotal_mixing")
def op4(t: Tables):
    return mix_plan(t.documents).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op5_retrieval_packing")
def op5(t: Tables):
    return pack_documents(t.documents, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query("op6_token_counts")
def op6(t: Tables):
    return token_counts(t.documents, public_tokenizers.path("word_bpe_49k.json"))


@query("op7_suffix_tree_scores")
def op7(t: Tables):
    return language_scores(t.documents)


@query("op8_chunk_fingerprints")
def op8(t: Tables):
    return successor_likeness(t.documents)


@query("op9_simhash_groups")
def op9(t: Tables):
    return near_groups(t.documents)


OP10_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
             row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS place,
             count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""


@query("op10_block_naming", OP10_SQL)
def op10(t: Tables):
    return exact_groups(t.documents)


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(text, '') AS text, coalesce(role, '') AS role, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS unit, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'unit': unit, 'bytes': strlen(text)} ORDER BY turn NULLS FIRST, role, unit) AS turns FROM t GROUP BY conv_id),
crc AS (
  SELECT conv_id, turns, conv_id - ((conv_id % 5) + 5) % 5 AS source,
         xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                         lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295::BIGINT), 4294967295) % 9 AS h
  FROM own),
rebuilt AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(s.turns, []), 1, c.h), list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM crc c LEFT JOIN own s ON s.conv_id = c.source),
prefixes AS (
  SELECT conv_id, depth, len(turns) = depth AS ends, CASE WHEN depth > 0 THEN turns[depth].bytes ELSE 0 END AS bytes,
         sha256(array_to_string(list_transform(turns[1:depth], lambda x: x.unit), ',')) AS key,
         CASE WHEN depth > 0 THEN sha256(array_to_string(list_transform(turns[1:depth - 1], lambda x: x.unit), ',')) END AS parent
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)),
nodes AS (
  SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY key, depth),
families AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
subtrees AS (
  SELECT p.key, sum(n.saved) AS saved_tokens, count(*) FILTER (n.key NOT IN (SELECT key FROM families)) AS n_leaves
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.key)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(f.n_children, 0)::BIGINT AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s USING (key) LEFT JOIN families f USING (key) LEFT JOIN nodes u ON u.key = n.parent
"""


def shared_openings(paths):
    """The dealt input of op11: a conversation's first turns are those of a neighbour that others open with too."""
    paths = materialize(paths)
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(9)).cast("int") * UNIT
    own = paths.select("conv", "path", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(5))).alias("source"))
    sources = paths.select(F.col("conv").alias("source"), F.col("path").alias("opening"))
    opening = F.coalesce(F.col("opening"), F.unhex(F.lit("")))
    rest = F.substring(F.col("path"), F.col("h") + 1, F.octet_length("path"))
    return own.join(sources, "source", "left").select("conv", F.concat(F.substring(opening, F.lit(1), F.col("h")), rest).alias("path"))


@query("op11_truncation_peeling", OP11_SQL)
def op11(t: Tables):
    nodes = prefix_trie(shared_openings(conversation_paths(t.conversations)))
    return nodes.select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")



def _op12_ratio(value: str) -> str:
    return re.sub(r"try_divide\((\S+), (\w+)\)", r"(\1 / nullif(\2, 0))", value)


def _op12_rules() -> str:
    """The rules of ``quality_rules.RULES`` as DuckDB rows (r, stratum, good, held, rule, value, cutoff)."""
    return " UNION ALL ".join(
        f"SELECT r, stratum, good, held, '{name}' AS rule, {_op12_ratio(value)} AS value, unnest({list(cutoffs)}::DOUBLE[]) AS cutoff FROM known"
        for name, (value, cutoffs) in RULES.items())


def _op12_hits() -> str:
    return " UNION ALL ".join(
        f"SELECT c.r FROM counts c JOIN chosen x ON x.stratum IS NOT DISTINCT FROM c.stratum AND x.rule = '{name}' WHERE {_op12_ratio(value)} > x.cutoff"
        for name, (value, _) in RULES.items())


OP12_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM docs WHERE len(ws) > 7),
places AS (SELECT r, n, i, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS words8 FROM words),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, md5(words8)) AS n FROM places WHERE i <= n - 7) WHERE n > 1),
repeats AS (SELECT r, sum(step)::BIGINT AS n_repeat_words FROM (SELECT r, least(8, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 8)) AS step FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (
  SELECT r, doc_id, stratum, len(ws)::BIGINT AS n_words, list_unique(ws)::BIGINT AS n_distinct_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '[!?]'))::BIGINT AS n_marks, len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ws) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(ws) AS base_failed
  FROM docs LEFT JOIN repeats USING (r) LEFT JOIN lines USING (r)),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
known AS (SELECT c.*, quality >= 1 AS good, ('0x' || substr(md5(c.doc_id::VARCHAR), 1, 8))::BIGINT % 2 = 1 AS held FROM counts c JOIN marks USING (doc_id) WHERE NOT base_failed),
long AS ({_op12_rules()}),
sums AS (
  SELECT stratum, rule, cutoff, count(*) FILTER (good) AS fit_good, count(*) FILTER (NOT good) AS fit_bad,
         count(*) FILTER (good AND value > cutoff) AS good_hit, count(*) FILTER (NOT good AND value > cutoff) AS bad_hit
  FROM long WHERE NOT held GROUP BY ALL),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY bad_hit DESC, cutoff DESC) AS choice FROM sums
                 WHERE good_hit <= fit_good * {ALPHA * TOLERATED / len(RULES)}::DOUBLE AND bad_hit >= greatest(fit_bad * {USEFUL}::DOUBLE, 1))
  WHERE choice = 1),
proposed AS (SELECT stratum, rule, cutoff, row_number() OVER (PARTITION BY stratum ORDER BY bad_hit DESC, rule) AS place FROM best),
held_good AS (SELECT stratum, count(*) AS holdout FROM known WHERE good AND held GROUP BY stratum),
fallen AS (
  SELECT stratum, place, count(*) AS n
  FROM (SELECT l.r, any_value(l.stratum) AS stratum, min(p.place) AS place FROM long l JOIN proposed p ON p.stratum IS NOT DISTINCT FROM l.stratum AND p.rule = l.rule AND p.cutoff = l.cutoff
        WHERE good AND held AND value > l.cutoff GROUP BY l.r)
  GROUP BY stratum, place),
steps AS (
  SELECT p.*, coalesce(h.holdout, 0) AS holdout, (sum(coalesce(f.n, 0)) OVER (PARTITION BY p.stratum ORDER BY p.place ROWS UNBOUNDED PRECEDING))::BIGINT AS rejected
  FROM proposed p LEFT JOIN held_good h ON h.stratum IS NOT DISTINCT FROM p.stratum LEFT JOIN fallen f ON f.stratum IS NOT DISTINCT FROM p.stratum AND f.place = p.place),
tested AS (
  SELECT *, CASE WHEN rejected >= holdout * {ALPHA}::DOUBLE THEN 1 ELSE
         list_sum(list_transform(range(rejected + 1), lambda i: exp(lgamma(holdout + 1) - lgamma(i + 1) - lgamma(holdout - i + 1) + i * ln({ALPHA}) + (holdout - i) * ln(1 - {ALPHA})))) END AS p_value
  FROM steps),
chosen AS (
  SELECT * FROM (SELECT *, bool_and(p_value <= {DELTA}::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT stratum FROM proposed))) OVER (PARTITION BY stratum ORDER BY place ROWS UNBOUNDED PRECEDING) AS certified FROM tested)
  WHERE certified),
hits AS (SELECT DISTINCT r FROM ({_op12_hits()}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND h.r IS NULL AS kept
FROM counts LEFT JOIN hits h USING (r)
"""


@query("op12_risk_controlled_rules", OP12_SQL)
def op12(t: Tables):
    verdicts = quality_verdicts(t.documents, t.labels)
    return verdicts.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op13_difference_cover_runs")
def op13(t: Tables):
    docs = t.documents.select("doc_id", with_planted_runs("doc_id", "text").alias("text"))
    return periodic_runs(docs, keep_text=False)
