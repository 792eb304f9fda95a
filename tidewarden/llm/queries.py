"""The registered queries of this package: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, crf_quality, decontaminate, filter_audit, language, line_windows, manifest, minhash, packing, passages, piece_counts, sampling, tree_rules, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    remainder = sampling.id_remainder("doc_id", 4)
    model = crf_quality.fit(docs, table(spark, sf_dir, "labels"), remainder != 2)
    found = crf_quality.scores(docs, model)
    return found.select("doc_id", (remainder == 2).alias("held_out"), "score", "predicted")


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 tokens."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json")))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    remainder = sampling.id_remainder("doc_id", 3)
    found = language.languages(docs, language.fit(docs, remainder != 1))
    return found.select("doc_id", (remainder == 1).alias("held_out"), "lang_pred", "score")


@query
def op7_tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of the boosted trees for every document."""
    docs = table(spark, sf_dir, "documents")
    model = tree_rules.fit(docs, table(spark, sf_dir, "labels"))
    return tree_rules.verdicts(docs, model)


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    formatted = chat.segments(turns.unionByName(spark.createDataFrame(tricky, turns.schema)))
    return chat.digests(formatted)


def _chat_sql() -> str:
    """Lengths and hashes from the turns themselves; a backslash is added for each control string and each
    backslash in a text, and roles come only from the template."""
    template = chat.INSTRUCTION
    broken = " + ".join(
        f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in [*template.controls(), chat.ESCAPE]
    )
    around = " ".join(f"WHEN '{role}' THEN {len(t.head) + len(t.tail)}" for role, t in template.turns.items())
    steps = " OR ".join(
        f"(role = '{b}' AND before {'IS NULL' if a == 'start' else f"= '{a}'"})" for a, bs in template.follows.items() for b in bs
    )
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), stepped AS (
        SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM turns
    ), told AS (
        SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
            length(text) + {broken} + CASE role {around} END AS chars, coalesce({steps}, false) AS follows FROM stepped
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
        sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
        CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(follows) AS valid,
        bool_and(follows) AND arg_max(role, (turn, role, text)) = 'assistant' AS complete
    FROM told GROUP BY conv_id"""


ORACLES["op9_chat_format"] = _chat_sql()


@query
def op10_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    return piece_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


@query
def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of windows that stand at an earlier place."""
    found = line_windows.trimmed(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "text", "n_lines", "n_removed")


ORACLES["op4_line_windows"] = line_windows.SQL


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or something similar, with the best place."""
    return decontaminate.links(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op6_minhash"] = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT p.a, p.b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
        FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
    ) p JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * shared >= 85 * (m.n + n.n - shared)
), reach AS (
    SELECT doc_id AS node, doc_id AS root FROM documents
    UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.node
), roots AS (
    SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN roots ON roots.node = d.doc_id
"""


@query
def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuzzy passages that documents share, and whole copies."""
    return passages.passages(table(spark, sf_dir, "documents"))


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaves, roots and proofs of all documents, and what is verified where line feeds are lost."""
    return manifest.without_feeds(table(spark, sf_dir, "documents"))


ORACLES["op12_manifest"] = manifest.SQL


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, by language, order and step."""
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = filter_audit.SQL


@query
def op11_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate embeddings."""
    return vectors.near_links(table(spark, sf_dir, "embeddings"))


ORACLES["op11_vectors"] = vectors.SQL
