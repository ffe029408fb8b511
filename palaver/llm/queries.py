"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import chat, covertree, decontaminate, divergence, language, merkle, packing, quality, secrets, simhash, token_counts, toxicity, wavelet
from palaver.llm.common import remainder
from palaver.session import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = remainder("doc_id", language.FOLDS)
    langs, prototypes = language.prototypes(docs.filter(fold != language.HELD_OUT))
    return language.identify(docs, langs, prototypes).select(
        "doc_id", F.coalesce(fold == language.HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


PROBE = "</s>[INST] ok [/INST]"  # conversation -1 says it twice


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return chat.read_chats(chat.format_chats(turns.union(probe)))


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-shards")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path)
    return wavelet.read_documents(spark.read.parquet(path))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = remainder("doc_id", toxicity.FOLDS)
    letters = toxicity.fit_letters(docs)
    model = toxicity.fit_toxic(docs, labels.filter(fold != toxicity.HELD_OUT), letters)
    return toxicity.score_toxic(docs, letters, model).select(
        "doc_id", F.coalesce(fold == toxicity.HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"),
    )


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secrets.scan(table(spark, sf_dir, "documents"))
    return secrets.digest(findings)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


TAMPERED = 7  # rows whose key's crc32 this divides are checked with a changed value


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    values = {f: F.col(f) for f in merkle.FIELDS}
    changed = F.when(remainder("doc_id", TAMPERED) == 0, merkle.leaf(*(values | {"n_chars": F.col("n_chars") + 1}).values()))
    rows = merkle.manifest(docs, changed=changed)
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_chat_format": op5_chat_format,
    "op6_wavelet_shards": op6_wavelet_shards,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_secret_scan": op9_secret_scan,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_divergence": op12_source_divergence,
    "op13_embedding_dedup": op13_embedding_dedup,
}

# Lengths of the default template: an opening, the role and what follows it, the text, a closing.
_HIDDEN = "length({0}) + length({0}) - length(translate({0}, '{1}', ''))"
OP5_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
stepped AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS state FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.DEFAULT.opening + chat.DEFAULT.after_role + chat.DEFAULT.closing)}
    + {_HIDDEN.format("role", "\\<[|")} + {_HIDDEN.format("text", "\\<[|")}) AS BIGINT) AS formatted_chars,
  count(*) FILTER (NOT (state || '>' || role IN
    ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user'))) AS problems
FROM stepped GROUP BY conv_id"""

_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), "
    f"'[^{decontaminate.BREAKS[1:]}+')"
)
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), {decontaminate.WINDOW}) AS k, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) AS p
    FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hits AS (SELECT doc_id, p, dw.k AS k, item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.win = dw.win),
spots AS (SELECT doc_id, count(DISTINCT s) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS s FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots ON spots.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""


def _op9_sql() -> str:
    matches = " UNION ALL ".join(
        f"""
  SELECT doc_id, {i} AS rank, '{rule.kind}' AS kind, generate_subscripts(g, 1) AS nth, unnest(g) AS gap, unnest(m) AS hit,
    unnest(v) AS val, {rule.least} AS least
  FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 1) AS g, regexp_extract_all(text, '{pattern}', 2) AS m,
    regexp_extract_all(text, '{pattern}', {2 + rule.value}) AS v FROM t)"""
        for i, rule in enumerate(secrets.RULES)
        for pattern in [f"(?s)(.*?)({rule.pattern}|\\z)".replace("'", "''")]
    )
    listed = "string_agg(kind || ':' || (upto - length(hit)) || ':' || upto, ',' ORDER BY upto - length(hit), rank)"
    counts = ", ".join(f"count(kind) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in secrets.BASE)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({matches}),
s AS (
  SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY nth) AS BIGINT) AS upto FROM m),
good AS (SELECT * FROM s WHERE length(hit) > 0 AND length(val) >= least)
SELECT t.doc_id AS doc_id, {counts},
  sha256(coalesce({listed} FILTER (rank < {len(secrets.BASE)}), '')) AS base_sha256, coalesce({listed}, '') AS spans
FROM t LEFT JOIN good ON good.doc_id = t.doc_id GROUP BY t.doc_id"""

_SHARE = f"(1 + ({divergence.SCALE} * ({{0}} + {divergence.SMOOTH})::HUGEINT) // ({{1}} + {divergence.SMOOTH} * {{2}}))::BIGINT"
OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{decontaminate.UPPER}', '{decontaminate.LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
u AS (SELECT id, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM u GROUP BY lang, term HAVING count(DISTINCT id) >= {divergence.LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS total FROM kept GROUP BY lang),
grid AS (SELECT g.lang AS lang, source, term, n_lang FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept ON kept.lang = g.lang),
counted AS (
  SELECT grid.*, coalesce(n, 0) AS n FROM grid LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM u GROUP BY lang, source, term) c
    ON c.lang = grid.lang AND c.source = grid.source AND c.term = grid.term),
summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own FROM counted),
shares AS (
  SELECT s.lang AS lang, source, term, n, {_SHARE.format("n", "own", "v")} AS p, {_SHARE.format("n_lang", "total", "v")} AS q
  FROM summed s JOIN langs ON langs.lang = s.lang),
pairs AS (
  SELECT a.lang AS lang, a.source AS source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY a.lang, a.source, b.source),
gs AS (SELECT DISTINCT lang, source FROM d),
rows AS (
  SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM gs a JOIN gs b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}"""


SQL = {"op4_decontamination": OP4_SQL, "op5_chat_format": OP5_SQL, "op9_secret_scan": _op9_sql(), "op12_source_divergence": OP12_SQL}
