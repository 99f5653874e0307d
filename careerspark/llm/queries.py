"""The registered queries of the operators, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    from .lm_score import score_texts

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder("doc_id", 7) == 2, F.lit(False))
    scored = score_texts(docs, learn=remainder("doc_id", 7) != 2)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, folder, "documents"), threshold=0.75, width=5)


@query
def op5_rank_profiles(spark: SparkSession, folder: str) -> DataFrame:
    from .language import identify

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    found = identify(docs.withColumn("held_out", held_out), learn=remainder("doc_id", 5) != 0, keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_weak_quality(spark: SparkSession, folder: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, folder, "documents"))


@query
def op4_variable_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, folder, "documents"))


@query
def op2_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from .bpe import digest_texts

    return digest_texts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op3_histogram_topk(spark: SparkSession, folder: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, folder, "embeddings"), is_query=F.col("vec_id") % 50 == 0, k=5)


SQL["op3_histogram_topk"] = """
WITH c AS (SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x
      FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sum(q.x * c.x) AS score
      FROM c AS q JOIN c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5"""


@query
def op8_rotated_codes(spark: SparkSession, folder: str) -> DataFrame:
    from .rotated import search

    return search(table(spark, folder, "embeddings"), is_query=F.col("vec_id") % 100 == 0, k=10)


@query
def op6_temporal_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Pages are captures, fetched on days of 2024 that follow from their ids. Every page also files an entry on its
    host, or on the domain above it if the host has more than three labels: pages with a query part ask to block it,
    those with a fragment to allow it, others to review it, dated as many days after the fetch as its URL is long."""
    from .url_lists import host, judge

    pages = table(spark, folder, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    captures = pages.withColumn("fetched", day)
    action = F.when(F.col("url").contains("?"), "block").when(F.col("url").contains("#"), "allow").otherwise("review")
    entries = captures.withColumn("_host", host("url")).select(
        F.when(F.size(F.split("_host", r"\.")) > 3, F.regexp_replace("_host", r"^[^.]*\.", "")).otherwise(F.col("_host")).alias("name"),
        F.date_add("fetched", F.length("url")).alias("dated"), action.alias("action"))
    return judge(captures, entries, "url", "fetched", keep=["page_id", "fetched"])


SQL["op6_temporal_url_lists"] = r"""
WITH c AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched,
         nullif(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host
  FROM pages),
e AS (
  SELECT CASE WHEN len(string_split(host, '.')) > 3 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END AS name,
         fetched + CAST(length(url) AS INTEGER) AS since,
         CASE WHEN contains(url, '?') THEN 1 WHEN contains(url, '#') THEN 3 ELSE 2 END AS a
  FROM c WHERE host IS NOT NULL),
o AS (SELECT name, since, min(a) AS a FROM e GROUP BY name, since),
i AS (SELECT name, since, a, coalesce(lead(since) OVER (PARTITION BY name ORDER BY since), DATE '9999-12-31') AS until FROM o),
m AS (
  SELECT page_id, name, a, since, row_number() OVER (PARTITION BY page_id ORDER BY length(name) DESC) AS r
  FROM c JOIN i ON (c.host = i.name OR ends_with(c.host, '.' || i.name)) AND c.fetched >= i.since AND c.fetched < i.until)
SELECT c.page_id, c.host, c.fetched, m.name AS matched_name,
       CASE m.a WHEN 1 THEN 'block' WHEN 2 THEN 'review' WHEN 3 THEN 'allow' ELSE 'none' END AS action, m.since
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.r = 1"""


@query
def op9_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents are files of a tree: source, then hundreds of ids, then the id. A document that speaks of a licence in
    its last line is the licence file of its directory."""
    from .licences import SPEAKS, scan

    path = F.concat_ws("/", "source", F.expr("doc_id div 1000"), F.expr("doc_id div 100"), F.concat("doc_id", F.lit(".txt")))
    files = table(spark, folder, "documents").select("doc_id", "text", F.when(F.col("source").isNotNull() & F.col("doc_id").isNotNull(), path).alias("path"))
    last_line = F.substring_index("text", "\n", -1)
    return scan(files, "path", "text", is_licence_file=last_line.rlike(SPEAKS), keep=["doc_id"])


@query
def op12_prefix_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Besides the counts: bytes_in_limit, the length of the longest prefix with at most 512 tokens."""
    import public_tokenizers

    from .prefix_tokens import prefix_counts

    counted = prefix_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budgets=[512], store=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.col("cuts")[0].alias("bytes_in_limit"))


@query
def op11_lightest_repair(spark: SparkSession, folder: str) -> DataFrame:
    from .conversations import COUNTS, digest, gaps, repair

    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("fate", F.crc32(named.cast("binary")) % 20)
    fate, text = F.col("fate"), F.coalesce("text", space)
    damaged = rows.filter(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    done = digest(repair(damaged)).withColumnRenamed("conv_id", "_conv")
    every = rows.groupBy("conv_id").agg(gaps(F.when(fate != 0, F.col("turn"))).alias("gaps"))
    found = every.join(done, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    none = {**dict.fromkeys([*COUNTS, "cost"], F.lit(0).cast("long")), "audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return found.select("conv_id", "gaps", *[F.coalesce(c, none[c]).alias(c) for c in none])


@query
def op13_ball_tree(spark: SparkSession, folder: str) -> DataFrame:
    from .ball_tree import ranked

    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


SQL["op13_ball_tree"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT count(*) AS big_n, sum(len(terms)) AS big_l FROM w WHERE len(terms) > 0),
t AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM w),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM t GROUP BY doc_id, n, term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term),
p AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN d USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""
