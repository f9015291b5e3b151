"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, lines, oracle, packing, quality, repair, secrets, topk, toxicity, trie, urls, warc
from .shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda x: F.when(F.abs(x) < 2.0**46, F.floor(x.cast("double") * 64).cast("double")).otherwise(x.cast("double") * 64)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", whole).alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0).withColumn("score", F.col("score").cast("long"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' labels are the outcomes of the pages made from them: a page's url ends in its document's number."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})([.]html)?/?([?#].*)?$', 1) AS BIGINT)")
    bad = F.greatest(1 - F.col("quality"), F.col("toxic"))
    known = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    outcomes = pages.select("page_id", number.alias("doc_id")).join(known, "doc_id").select("page_id", "bad")
    return urls.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "matched", "windows")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.detect(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("spans", lambda x: F.concat_ws("+", x["start"].cast("string"), x["length"].cast("string"))), ",")
    return out.select("conv_id", "speaker", "rendered", mask.alias("mask"), "turns", "loss_chars")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).drop("text")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]
    base = F.filter("spans", lambda x: x["rank"] < len(secrets.BASE))
    shown = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, secrets.KINDS)), x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda rank: F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")
    counts = [of(rank).alias(f"n_{kind}") for rank, (kind, _) in enumerate(secrets.BASE)]
    return spans.select(F.col("id").alias("doc_id"), *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of which one in four is dropped, emptied, robbed of its full stops, repeated or said by the user, told from its place."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("harm")).where("harm <> 0")
    rows = rows.withColumn("role", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")))
    rows = rows.withColumn("text", F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    whole, divided, held = repair.repair(damaged(turns))
    found, _ = written(repair.summaries(whole, divided), "repair-summaries")
    held.drop()
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    every = turns.select("conv_id").distinct()
    told = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    return told.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation begins with up to three turns of the one whose number ends its block of twenty."""
    fork = lambda conv: (conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4)
    return trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), fork)[0]


def _strength(name: str, units: str) -> str:
    return f"""{name} AS (SELECT coalesce(CASE WHEN rho > 0 THEN greatest(2.0, least(1000.0, 1 / rho - 1)) END, 1000.0) AS m, mean FROM (
        SELECT (br - p * B - (k - 1) * p * (1 - p)) / nullif(p * (1 - p) * (N - nn / N - (k - 1)), 0) AS rho, (B + 1.0) / (N + 2.0) AS mean FROM (
            SELECT coalesce(sum(n), 0) AS N, coalesce(sum(b), 0) AS B, count(*) AS k, sum(b * b / CAST(n AS DOUBLE)) AS br, CAST(sum(n * n) AS DOUBLE) AS nn, sum(b) / CAST(nullif(sum(n), 0) AS DOUBLE) AS p FROM {units} WHERE n > 0)))"""


URLS = f"""
        WITH l AS (SELECT doc_id, max(greatest(1 - quality, toxic)) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
        p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, try_cast(nullif(regexp_extract(url, '/([0-9]{{1,18}})([.]html)?/?([?#].*)?$', 1), '') AS BIGINT) AS doc FROM pages),
        h AS (SELECT host, regexp_extract(host, '([^.]+[.][^.]+)[.]?$', 1) AS domain, regexp_extract(host, '([^.]+)[.]?$', 1) AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS b FROM p LEFT JOIN l ON l.doc_id = p.doc GROUP BY host),
        d AS (SELECT suffix, domain, sum(n) AS n, sum(b) AS b FROM h GROUP BY suffix, domain), s AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM d GROUP BY suffix),
        {_strength('ms', 's')}, {_strength('md', 'd')}, {_strength('mh', 'h')},
        os AS (SELECT suffix, (b + ms.m * ms.mean) / (n + ms.m) AS o FROM s, ms), od AS (SELECT d.suffix, d.domain, d.n AS around, (d.b + md.m * os.o) / (d.n + md.m) AS o FROM d JOIN os ON os.suffix = d.suffix, md),
        oh AS (SELECT host, around, n + mh.m AS w, (b + mh.m * o) / (n + mh.m) AS mean FROM h JOIN od ON od.suffix = h.suffix AND od.domain = h.domain, mh),
        r AS (SELECT p.*, around, mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) AS low, CASE
                WHEN (p.host = 'www.example.com' OR ends_with(p.host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN (p.host = 'example.com' OR ends_with(p.host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN (p.host = 'net' OR ends_with(p.host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN (p.host = 'com' OR ends_with(p.host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p LEFT JOIN oh ON oh.host = p.host)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > 0.5 AND around > 0 THEN 'block' ELSE 'allow' END AS verdict FROM r
    """

SQL = {
    "op2_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
    """,
    "op3_urls": URLS,
    "op7_jaccard": """
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}\\x{300}-\\x{36f}]+') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS h FROM t),
        e AS (SELECT doc_id, unnest(h) AS g, len(h) AS n FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
        c AS (SELECT doc_id AS doc, doc_id AS root FROM documents UNION SELECT p.b, c.root FROM c JOIN p ON p.a = c.doc)
        SELECT d.doc_id, CAST(r.class_id AS BIGINT) AS class_id, CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links
        FROM documents d JOIN (SELECT doc, min(root) AS class_id FROM c GROUP BY doc) r ON r.doc = d.doc_id
        LEFT JOIN (SELECT a, count(*) AS n_links FROM p GROUP BY a) l ON l.a = d.doc_id
    """,
    "op8_chat": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
        p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
        r AS (SELECT p.conv_id, p.speaker, t.turn, t.role, t.text, t.role = p.speaker AS own,
                     CASE WHEN t.role = p.speaker THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>' ELSE '<|user name=' || t.role || '|>' END || chr(10) AS head
              FROM p JOIN t ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
        n AS (SELECT *, row_number() OVER w AS k, sum(length(head) + length(text) + 1) OVER w - length(text) - 1 AS start FROM r
              WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, speaker, string_agg(head || text || chr(10), '' ORDER BY k) AS rendered,
               string_agg(CAST(start AS VARCHAR) || '+' || CAST(length(text) AS VARCHAR), ',' ORDER BY k) FILTER (own) AS mask,
               CAST(count(*) AS BIGINT) AS turns, CAST(sum(length(text)) FILTER (own) AS BIGINT) AS loss_chars
        FROM n GROUP BY conv_id, speaker
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM m
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_topk": op2_topk, "op3_urls": op3_urls, "op4_decontam": op4_decontam, "op5_lines": op5_lines, "op6_toxicity": op6_toxicity, "op7_jaccard": op7_jaccard, "op8_chat": op8_chat, "op9_warc": op9_warc, "op10_quality": op10_quality, "op11_secrets": op11_secrets, "op12_repair": op12_repair, "op13_trie": op13_trie}


def oracle_sql() -> dict[str, str]:
    return {**SQL, **oracle.SQL}
