"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, filteraudit, html, language, linededup, pii, quality, runs, simhash, suffixdedup, tokencount, vafile
from .common import crc_bucket, table

QUALITY_THRESHOLD = 0.3


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def may_learn_quality(key: str = "doc_id") -> Column:
    """Labels of a fifth of the keys are held out."""
    return crc_bucket(F.col(key), 5) != 0


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), spans="found").withColumn("clean", pii.sanitised(F.coalesce("text", F.lit("")), F.col("found")))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined_spans(base), 256).alias("base_sha256"), pii.joined_spans(F.col("found")).alias("spans"), F.sha2("clean", 256).alias("sanitised_sha256"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_bucket(F.col("doc_id"), 4) == 2)
    net = language.fit(docs, learn_from=~F.col("held_out"))
    return language.with_language(docs.drop("lang"), net).drop("text")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn_from=may_learn_quality())
    scored = quality.with_scores(docs.withColumn("held_out", crc_bucket(F.col("doc_id"), 5) == 0), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0).alias("predicted"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.with_tokens(docs, tokenizer_path())
    return coded.select("doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.with_counts(docs, tokenizer_path()).drop("text")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_duplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), removed="n_removed")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixdedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return runs.with_runs(docs).select("doc_id", *runs.figures())


QUERIES = {
    "op1_pii": op1_pii,
    "op2_bpe": op2_bpe,
    "op3_topk": op3_topk,
    "op4_language": op4_language,
    "op5_token_counts": op5_token_counts,
    "op6_line_dedup": op6_line_dedup,
    "op7_html": op7_html,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_runs": op13_runs,
}


def _words_sql(text: str) -> str:
    return rf"[x FOR x IN regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+') IF x <> '']"


ORACLE_SQL: dict[str, str] = {
    "op3_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_decontamination": f"""
WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT DISTINCT item_id, unnest([array_to_string(w[k:k+4], ' ') FOR k IN range(1, len(w) - 3)]) AS g FROM i WHERE len(w) >= 5),
t AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k+4], ' ') FOR k IN range(1, len(w) - 3)]) AS g FROM d WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS item_size FROM s GROUP BY item_id)
SELECT t.doc_id, s.item_id, count(*) AS shared, any_value(n.item_size) AS item_size
FROM t JOIN s USING (g) JOIN n USING (item_id)
GROUP BY t.doc_id, s.item_id HAVING count(*) >= 0.8 * any_value(n.item_size) - 1e-9""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM d),
f AS (SELECT t, min(doc_id) AS lo FROM d GROUP BY t),
b AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > lo, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w JOIN f USING (t) LEFT JOIN b USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT l, 1 << (i - 1) AS bit FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest(range(1, 6)) AS i)),
o AS (SELECT p.l || q.l || r.l || s.l || u.l AS filter_order FROM x p JOIN x q ON q.l <> p.l JOIN x r ON r.l NOT IN (p.l, q.l) JOIN x s ON s.l NOT IN (p.l, q.l, r.l) JOIN x u ON u.l NOT IN (p.l, q.l, r.l, s.l)),
st AS (SELECT filter_order, step, x.bit, coalesce((SELECT sum(y.bit) FROM x y WHERE strpos(filter_order, y.l) < step), 0)::BIGINT AS before FROM o, unnest(range(1, 6)) AS g(step) JOIN x ON x.l = substr(filter_order, step, 1)),
r AS (SELECT part, filter_order, step::INTEGER AS step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, st GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r""",
}
