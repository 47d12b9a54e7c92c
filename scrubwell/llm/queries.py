"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubwell.functions.storage import fresh_path
from scrubwell.llm import (
    byte_bpe, chat, decontamination, embedding_dedup, filter_audit, line_dedup, minhash, mixing, secret_scan, token_alignment, token_counts, token_files, toxicity,
)
from scrubwell.llm.batches import reach_workers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_mixing",
    """
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
             md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM documents),
    sources AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             CAST([5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight
      FROM sized GROUP BY source),
    filled AS (
      SELECT *, CAST(source_size * 3 AS DOUBLE) AS most,
             CAST(sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (
               ORDER BY source_size * 3 / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
             / sum(weight) OVER (ORDER BY source_size * 3 / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM sources),
    targets AS (SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM filled),
    placed AS (
      SELECT s.*, t.source_size, t.target,
             coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS middle
      FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(size * (floor(target / source_size) + CASE WHEN middle < target - floor(target / source_size) * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM placed
    """,
)
def op1_mixing(spark, sf_dir):
    """The mix, in the order of training: documents by the position of their first copy, those left out at the end."""
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    out = plan.select("row.doc_id", "size", "source_size", "target", "taken", F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0)).alias("position"), "place")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = out.repartitionByRange(parts, "position", "place").sortWithinPartitions("position", "place")
    return ordered.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    return secret_scan.span_digests(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


PROBE = r"\### Assistant: </turn> ok"


@query(
    "op3_chat_format",
    """
    WITH turns AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    marked AS (
      SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT DISTINCT FROM role AS joined,
             replace(replace(replace(replace(text, '\\', '\\b'), '</turn>', '\\e'), '<join>', '\\j'), '### ', '\\h') AS escaped
      FROM turns)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
           coalesce(CAST(sum(length(text)) FILTER (role = 'assistant') AS BIGINT), 0) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length(escaped) + CASE WHEN joined THEN 6 ELSE 4 + length(role) + 2 + 8 END) AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id
    """,
)
def op3_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE)
    )
    return chat.chat_digests(chat.read_back(chat.format_chats(turns.union(probe))))


def token_table(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read a row per document back from them."""
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, path, public_tokenizers.path(TOKENIZER))
    return token_files.read_documents(spark, path)


@query("op4_token_files")
def op4_token_files(spark, sf_dir):
    return token_table(spark, table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.predictions(toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"]))


@query(
    "op6_embedding_dedup",
    """
    WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
    reach(node, root) AS (
      SELECT vec_id, vec_id FROM vectors UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node WHERE r.root < l.b),
    least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT v.vec_id, coalesce(n.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
    FROM vectors v JOIN least l ON l.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
    """,
)
def op6_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query(
    "op8_token_rollups",
    """
    WITH versions AS (SELECT unnest(['blanks-1', 'words-1']) AS version),
    alive AS (
      SELECT d.source, d.lang, CASE WHEN l.quality = 0 THEN regexp_replace(d.text, '[0-9]+', '', 'g') ELSE d.text END AS text
      FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS DISTINCT FROM 1),
    counted AS (
      SELECT source, lang, version, CASE version WHEN 'blanks-1' THEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))
             ELSE len(regexp_extract_all(text, '[A-Za-z0-9]+|[^\x00-\x7F]+')) END AS tokens
      FROM alive, versions)
    SELECT source, lang, version, count(*) AS documents, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM counted GROUP BY ALL
    """,
)
def op8_token_rollups(spark, sf_dir):
    """All documents are inserted, those of low quality revised (without digits), toxic ones deleted; one batch is sent twice."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    masked = docs.withColumn("text", F.regexp_replace("text", "[0-9]++", ""))

    def both(texts: DataFrame) -> DataFrame:
        first, second = (token_counts.count_tokens(texts, v) for v in token_counts.NATIVE)
        return first.union(second)

    store = fresh_path(spark, "rollups")
    low, toxic = (labels.filter(f).select("doc_id") for f in ("quality = 0", "toxic = 1"))
    gone = toxic.select("doc_id", F.explode(F.array(*map(F.lit, token_counts.NATIVE))).alias("version"))
    deletes = gone.select(F.lit("delete").alias("op"), "doc_id", *[F.lit(None).cast("string").alias(c) for c in ("source", "lang")], "version", F.lit(None).cast("bigint").alias("tokens"), F.lit(0).alias("seq"))
    revised = token_counts.changes(both(masked).join(low, "doc_id", "left_semi"), "revise")
    token_counts.commit(store, "1", token_counts.changes(both(docs), "insert"))
    token_counts.commit(store, "2", revised)
    token_counts.commit(store, "3", deletes)
    token_counts.commit(store, "2", revised)
    return token_counts.totals(spark, store)


@query("op9_line_dedup")
def op9_line_dedup(spark, sf_dir):
    """Per document: lines, deleted lines and a digest of the text that is left."""
    found = line_dedup.repeated_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select(
        "row.doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.size("deleted").cast("bigint").alias("n_deleted"),
        F.concat_ws(",", F.col("deleted").cast("array<string>")).alias("deleted"), F.sha2("kept_text", 256).alias("kept_sha256"),
    )


@query("op10_minhash_dedup")
def op10_minhash_dedup(spark, sf_dir):
    """A row per document with its group: class_id, class_size, and whether it is the one that stays."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("row")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op7_decontamination",
    f"""
    WITH docs AS (SELECT doc_id, {_WORDS} AS words FROM documents),
    items AS (SELECT item_id, {_WORDS} AS words FROM benchmark),
    windows AS (
      SELECT DISTINCT item_id, least(len(words), 10) AS n,
             unnest(CASE WHEN len(words) >= 10 THEN list_transform(range(1, len(words) - 8), lambda i: words[i:i + 9]) ELSE [words] END) AS part
      FROM items WHERE len(words) > 0),
    positions AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM docs),
    ahead AS (
      SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS part FROM positions),
    found AS (
      SELECT a.doc_id, a.pos, w.n, w.item_id
      FROM (SELECT *, unnest(lengths) AS n FROM ahead, (SELECT list(DISTINCT n) AS lengths FROM windows)) a
      JOIN windows w ON w.n = a.n AND w.part = a.part[1:a.n]),
    hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS word FROM found) GROUP BY doc_id),
    named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM found GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
)
def op7_decontamination(spark, sf_dir):
    found = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontamination.leak_digests(found)


@query(
    "op11_filter_audit",
    r"""
    WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
    split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM docs),
    marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    failing AS (
      SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
      FROM split LEFT JOIN marks USING (doc_id)),
    cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
    orders AS (
      SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
      WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
    steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
    seen AS (
      SELECT part, filter_order, step, filter_order[step] AS filter, n, good, toxic, fails = filter_order[step] AS alone,
             contains(fails, filter_order[step]) AS now, length(translate(filter_order[1:step - 1], fails, '')) < step - 1 AS gone
      FROM cells, steps),
    counted AS (
      SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT now AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (now AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (now AND gone), 0) AS redundant, coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
             coalesce(sum(good) FILTER (now AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (now AND NOT gone), 0) AS toxic_lost
      FROM seen GROUP BY ALL)
    SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
    FROM counted
    """,
)
def op11_filter_audit(spark, sf_dir):
    return filter_audit.audit(filter_audit.document_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


BYTE_TOKENIZER = "byte_bpe_50k.json"


@query("op13_byte_bpe")
def op13_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path(BYTE_TOKENIZER)
    return byte_bpe.code_digests(byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, keep=["doc_id"]), path))


PIECE_MODEL = "piece_bpe_32k.model"


@query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    paths = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_MODEL)
    found = token_alignment.alignment(docs, *paths, keep=["doc_id"], digest=True)
    return found.select("row.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
