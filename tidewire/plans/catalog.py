"""The relational model over the input tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its SQL start from the same rows. The model:
articles, enrichment (one row an article at most), sources, entities, article_entities, kpis, calendar, reviews, texts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "articles": """
        SELECT o_orderkey AS id, o_custkey AS source_id, concat('https://news.example/', CAST(o_orderkey AS STRING)) AS url,
               concat(substr(o_orderpriority, 3), ' story ', CAST(o_orderkey % 50 AS STRING)) AS title,
               CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderdate END AS published_at,
               o_orderdate + INTERVAL 6 HOURS AS fetched_at, (o_orderkey * 37) % 1500 AS word_count,
               o_orderkey % 13 = 0 AS is_duplicate,
               CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 1 + o_orderkey % 3 END AS duplicate_of_id,
               CASE WHEN o_orderkey % 13 = 0 THEN 'duplicate' WHEN o_orderkey % 7 = 0 THEN 'deduped' ELSE 'enriched' END AS status
        FROM orders""",
    "enrichment": """
        SELECT o.o_orderkey AS article_id, lower(substr(o.o_orderpriority, 3)) AS category,
               CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE concat('sub', CAST(o.o_orderkey % 4 AS STRING)) END AS subcategory,
               CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE lower(r.r_name) END AS region,
               CASE o.o_orderstatus WHEN 'F' THEN 'negative' WHEN 'O' THEN 'positive' ELSE 'neutral' END AS sentiment,
               CAST((o.o_orderkey * 31) % 1000 AS DOUBLE) / 1000 AS importance_score,
               CAST((o.o_orderkey * 17) % 100 AS DOUBLE) / 100 AS confidence_score, o.o_orderkey % 5 AS corroborating_source_count,
               concat(CASE WHEN o.o_orderkey % 12 = 5 THEN '7 ' ELSE '' END, 'Headline ', CAST(o.o_orderkey AS STRING)) AS headline,
               CASE WHEN o.o_orderkey % 8 = 0 THEN '' WHEN o.o_orderkey % 4 = 0 THEN NULL ELSE concat('Baslik ', CAST(o.o_orderkey AS STRING)) END AS headline_tr,
               CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE o.o_orderdate + INTERVAL 7 HOURS END AS translated_at
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
        WHERE o.o_orderkey % 7 <> 0""",
    "sources": """
        SELECT c_custkey AS id, c_name AS name, c_mktsegment AS category, CAST(c_custkey % 11 AS DOUBLE) / 10 AS trust_weight,
               c_custkey % 5 <> 0 AS is_active FROM customer""",
    "entities": """
        SELECT s_suppkey AS id, 'airline' AS entity_type, s_name AS name, concat('A', CAST(s_suppkey % 60 AS STRING)) AS code FROM supplier
        UNION ALL SELECT 1000000 + p_partkey, 'airport', p_name, concat('H', CAST(p_partkey % 40 AS STRING)) FROM part
        UNION ALL SELECT CAST(2000000 + n_nationkey AS BIGINT), 'country', n_name, CAST(NULL AS STRING) FROM nation""",
    "article_entities": """
        SELECT DISTINCT l_orderkey AS article_id, l_suppkey AS entity_id FROM lineitem
        UNION ALL SELECT DISTINCT l_orderkey, 1000000 + l_partkey FROM lineitem WHERE l_partkey % 3 = 0
        UNION ALL SELECT DISTINCT l_orderkey, CAST(2000000 + s_nationkey AS BIGINT) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber = 1""",
    "kpis": """
        SELECT event_id AS id, event_type AS metric_key, value, ts AS as_of, concat('src', CAST(user_id % 7 AS STRING)) AS source,
               event_id % 5 <> 0 AS is_primary, 'unit' AS unit, CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('https://kpi.example/', CAST(user_id AS STRING)) END AS source_url
        FROM events""",
    "calendar": """
        SELECT l_orderkey * 10 + l_linenumber AS id, concat('Event ', CAST(l_partkey AS STRING)) AS name,
               CAST(least(o_orderdate, l_shipdate) AS DATE) AS starts, CAST(greatest(o_orderdate, l_shipdate) AS DATE) AS ends,
               CASE l_returnflag WHEN 'A' THEN 'airshow' WHEN 'N' THEN 'conference' ELSE 'holiday' END AS event_type,
               CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 'europe' ELSE 'asia' END AS region
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 3""",
    "reviews": """
        SELECT doc_id AS id, source AS source_name, concat('https://reviews.example/', CAST(doc_id AS STRING)) AS url, text AS body,
               CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST((doc_id * 7) % 11 AS DOUBLE) END AS rating,
               CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS DATE) END AS review_date
        FROM documents""",
    "gazetteer": """
        SELECT * FROM (VALUES ('the', 'airline', 'The Air', 'TA', 0), ('of the', 'airline', 'The Air', 'TX', 1), ('que', 'airline', 'Que Air', 'QA', 2),
                              ('der', 'airport', 'Der Field', 'DRF', 3), ('en la', 'airport', 'La Field', 'LAF', 4),
                              ('und', 'country', 'Und', NULL, 5), ('with the', 'country', 'With', NULL, 6)) AS g(alias, entity_type, name, code, ord)""",
}

#: Views that stand on other tables than the view's own text shows are none; each stands on the input tables alone.
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Tables of which a view makes distinct rows, by the key that these are dealt by.
DEALT = {"article_entities": {"lineitem": "l_orderkey"}}


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views before it; ``sql`` may start with further ones, as ``name AS (...), ... SELECT``."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + sql


class Catalog:
    """The model's views as DataFrames, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        words = VIEWS[name].replace("(", " ").replace(")", " ").split()
        used = {t: self.table(t) for t in TABLES if t in words}
        for t, key in DEALT.get(name, {}).items():
            # in as many parts as the session shuffles into: left to itself, Spark joins parts by their packed size, and one task holds a hash map of many times that
            used[t] = used[t].repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), key)
        sql = VIEWS[name]
        for t in used:
            for before in ("FROM", "JOIN"):
                sql = sql.replace(f"{before} {t} ", f"{before} {{{t}}} ").replace(f"{before} {t}\n", f"{before} {{{t}}}\n")
                if sql.endswith(f"{before} {t}"):
                    sql = sql[: -len(t)] + f"{{{t}}}"
        return self.spark.sql(sql, **used)

    articles = cached_property(lambda self: self.view("articles"))
    enrichment = cached_property(lambda self: self.view("enrichment"))
    sources = cached_property(lambda self: self.view("sources"))
    entities = cached_property(lambda self: self.view("entities"))
    article_entities = cached_property(lambda self: self.view("article_entities"))
    kpis = cached_property(lambda self: self.view("kpis"))
    calendar = cached_property(lambda self: self.view("calendar"))
    reviews = cached_property(lambda self: self.view("reviews"))
