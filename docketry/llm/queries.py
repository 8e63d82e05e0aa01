"""The named queries of these operators, each over its whole tables, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import (
    conversations,
    decontamination,
    exact_dedup,
    id_files,
    language_id,
    licences,
    merkle,
    near_dedup,
    packing,
    quality,
    surrogates,
    toxicity,
    vector_search,
)
from docketry.llm.common import fold, shared_folder
from docketry.llm.tokens import tokenizer_path

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(run: Run) -> Run:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register()
def op1_vantage_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, folder, "documents"))


@register("""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""")
def op2_chunk_recipes(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


@register()
def op3_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    made = surrogates.pseudonymised(table(spark, folder, "documents"), key="public sample key")
    return made.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"),
                       F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["kind"]))), ",").alias("kinds"))


def language_identifier(docs: DataFrame) -> language_id.Identifier:
    """Learned from the documents whose fold is not 0."""
    return language_id.learn(docs.where(fold(F.col("doc_id"), 5) != 0).select("doc_id", "text", "lang"))


def held_out(folds: int, of: int):
    """Whether a row was kept from learning; a NULL id always is."""
    return F.coalesce(fold(F.col("doc_id"), folds) == of, F.lit(True)).alias("held_out")


@register()
def op4_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identified(docs, language_identifier(docs))
    return found.select("doc_id", held_out(5, 0), "lang_pred", "score", "accepted")


@register()
def op5_context_mixing(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "id-files")
    id_files.write_ids(table(spark, folder, "documents"), path, tokenizer_path("byte_bpe_50k.json"), vocabulary=50_257, end_id=0)
    return id_files.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def pack_documents(docs: DataFrame) -> DataFrame:
    pieces = packing.packed_with(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@register()
def op6_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


@register()
def op7_latent_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.learn(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    return quality.quality_scores(docs, model).select("doc_id", held_out(3, 1), "score", "predicted")


@register("""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS win
    FROM (SELECT item_id, w, least(len(w), 13) AS size, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT DISTINCT doc_id, size, i, item_id FROM dw JOIN bw USING (size, win)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op8_aho_corasick(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontamination.benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


@register()
def op9_block_max(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.learn(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return toxicity.toxicity_scores(docs, model).select("doc_id", held_out(5, 0), "score", "predicted", "evidence")


@register()
def op10_licence_templates(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.licence_scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def crc32_sql(text: str) -> str:
    """DuckDB has no crc32: bit by bit, over ASCII text."""
    bits = (f"flatten(list_transform(range(1, len({text}) + 1), lambda i: "
            f"list_transform(range(8), lambda b: CAST((ord(substr({text}, CAST(i AS INT), 1)) >> b) & 1 AS BIGINT))))")
    return (f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295), "
            "4294967295)")


def _field_sql(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(concat(" + ", ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


@register(f"""
WITH RECURSIVE d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf_sql('text')} AS leaf,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf_sql('low')} ELSE {_leaf_sql('text')} END AS shown FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves),
up AS (SELECT grp, 0 AS h, rank AS place, leaf AS node, count(*) OVER (PARTITION BY grp) AS n FROM placed
    UNION ALL SELECT grp, h + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 7) // 8
    FROM up WHERE n > 1 GROUP BY grp, h, place // 8),
subroots AS (SELECT grp, node, h FROM up WHERE n = 1),
names AS (SELECT grp, node, row_number() OVER (ORDER BY grp) - 1 AS place FROM subroots),
top AS (SELECT 0 AS h, place, node, count(*) OVER () AS n FROM names
    UNION ALL SELECT h + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 7) // 8
    FROM top WHERE n > 1 GROUP BY h, place // 8),
root AS (SELECT node FROM top WHERE n = 1),
sides AS (
    SELECT p.grp, p.rank, u.h AS step, coalesce(string_agg(u.node, '' ORDER BY u.place) FILTER (WHERE u.place < p.rank >> (3 * u.h)), '') AS l,
        coalesce(string_agg(u.node, '' ORDER BY u.place) FILTER (WHERE u.place > p.rank >> (3 * u.h)), '') AS r
    FROM placed p JOIN up u ON u.grp = p.grp AND u.n > 1 AND u.place >> 3 = p.rank >> (3 * u.h + 3) GROUP BY 1, 2, 3
    UNION ALL
    SELECT p.grp, p.rank, s.h + t.h, coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (WHERE t.place < a.place >> (3 * t.h)), ''),
        coalesce(string_agg(t.node, '' ORDER BY t.place) FILTER (WHERE t.place > a.place >> (3 * t.h)), '')
    FROM placed p JOIN names a ON a.grp = p.grp JOIN subroots s ON s.grp = p.grp
        JOIN top t ON t.n > 1 AND t.place >> 3 = a.place >> (3 * t.h + 3) GROUP BY 1, 2, s.h, t.h, 3),
paths AS (SELECT grp, rank, string_agg(l || r, '' ORDER BY step) AS proof, max(step) AS last FROM sides GROUP BY 1, 2),
fold AS (SELECT grp, rank, 0 AS step, shown AS node FROM placed
    UNION ALL SELECT f.grp, f.rank, f.step + 1, sha256(s.l || f.node || s.r) FROM fold f JOIN sides s ON s.grp = f.grp AND s.rank = f.rank AND s.step = f.step)
SELECT p.doc_id, p.leaf, s.node AS subroot, root.node AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
    f.node AS folded_root, f.node = root.node AS verified
FROM placed p JOIN subroots s USING (grp) LEFT JOIN paths q USING (grp, rank) CROSS JOIN root
    JOIN fold f ON f.grp = p.grp AND f.rank = p.rank AND f.step = coalesce(q.last + 1, 0)""")
def op11_dag_descent(spark: SparkSession, folder: str) -> DataFrame:
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = merkle.leaf_digest(*[lowered if c == "text" else F.col(c) for c in merkle.FIELDS])
    plan = merkle.manifest(table(spark, folder, "documents"), carried={"tampered": F.when(chosen, tampered)})
    found = merkle.proofs(plan, plan.leaves)
    folded = merkle.folded(F.coalesce("carried.tampered", "leaf"), F.col("siblings"))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(plan.root).alias("root"),
                        merkle.proof_digest(F.col("siblings")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of ``conv_id:turn``, a row is dropped, emptied, robbed of its ends, repeated or given to the user."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(text["conv_id"], F.lit(":"), text["turn"]).cast("binary")) % 20
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text["role"]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text["text"], ".!?", "")).otherwise(text["text"]).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


@register(f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
f AS (SELECT *, {crc32_sql('name')} % 20 AS kind FROM c),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM f JOIN (VALUES (1), (2)) v(n) ON n = 1 OR kind = 3 WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS x FROM damaged),
fault AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'r'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'k' END AS fault,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'r') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE before || x NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM fault GROUP BY conv_id),
inserts(phase, mid, price, sign, line) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
    (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 2, 5, 'I', chr(10) || 'user:')),
edits(mid, x, after, price, sign, role) AS (VALUES (0, NULL, 0, 2, 'D', NULL), (1, NULL, 1, 2, 'D', NULL), (2, NULL, 2, 2, 'D', NULL), (3, NULL, 3, 2, 'D', NULL),
    (0, 's', 1, 0, 'K', NULL), (0, 'u', 2, 0, 'K', NULL), (1, 'u', 2, 0, 'K', NULL), (2, 'a', 3, 0, 'K', NULL), (3, 'u', 2, 0, 'K', NULL),
    (0, NULL, 2, 1, 'R', 'user'), (1, NULL, 2, 1, 'R', 'user'), (2, NULL, 3, 1, 'R', 'assistant'), (3, NULL, 2, 1, 'R', 'user')),
best AS (SELECT conv_id, n, 0 AS i, 0 AS phase, {{'cost': 0, 'audit': '', 'lines': ''}} AS way FROM counts
    UNION ALL
    SELECT b.conv_id, b.n, b.i + 1, e.after, min({{'cost': b.way.cost + p.price + e.price + CASE WHEN e.sign <> 'D' AND r.fault = 't' THEN 5 ELSE 0 END,
        'audit': b.way.audit || p.sign || e.sign,
        'lines': b.way.lines || p.line || CASE WHEN e.sign = 'D' THEN '' ELSE chr(10) || coalesce(e.role, r.role) || ':' || r.text END}})
    FROM best b JOIN fault r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1 JOIN inserts p ON p.phase = b.phase
        JOIN edits e ON e.mid = p.mid AND (e.x IS NULL OR e.x = r.x) AND (e.sign = 'D' OR r.fault IN ('k', 't'))
    GROUP BY b.conv_id, b.n, b.i, e.after),
chosen AS (SELECT b.conv_id, min({{'cost': b.way.cost + p.price, 'audit': b.way.audit || p.sign, 'lines': b.way.lines || p.line}}) AS way
    FROM best b JOIN inserts p ON p.phase = b.phase WHERE b.i = b.n AND p.mid IN (0, 3) GROUP BY b.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(substr(way.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts k ON k.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM o.conv_id""")
def op12_grammar_alignment(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    repair = conversations.repair(damaged(rows))
    hashes = conversations.joined_sha256(repair.turns).select(F.col("conv_id").alias("hashed_id"), "sha256")
    summary = repair.summary.withColumnRenamed("conv_id", "repaired_id")
    every = rows.select("conv_id").distinct()
    whole = every.join(summary, every["conv_id"].eqNullSafe(summary["repaired_id"]), "left").join(
        hashes, F.col("conv_id").eqNullSafe(F.col("hashed_id")), "left")
    numbers = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@register()
def op13_kmeans_tree(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.neighbours(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
