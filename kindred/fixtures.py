"""Test relations in the engine's shapes, derived from the star-schema tables.

The text of each is SQL that both Spark and the oracle understand, with tables
in braces.  Searches ask for the rows whose id is divisible by 100, against all
rows; all else covers whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

RELATIONS = {
    "support": """SELECT o_custkey AS artist_credit_id, concat('c-', c_custkey) AS artist_mbid, c_name AS artist_credit_name, concat('o-', o_orderkey) AS release_mbid,
        concat(o_orderpriority, ' ', o_orderkey) AS release_name, concat('p-', p_partkey) AS recording_mbid, concat(p_name, ' ', p_type) AS recording_name, l_linenumber AS score
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey""",
    "recording": "SELECT p_partkey AS id, concat('p-', p_partkey) AS gid, p_partkey % 150 AS artist_credit, concat(p_name, ' ', p_type) AS name FROM {part}",
    "release": "SELECT o_orderkey AS id, concat('o-', o_orderkey) AS gid, 1000000 + o_orderkey % 100 AS artist_credit FROM {orders}",
    "artist": "SELECT c_custkey AS id, concat('c-', c_custkey) AS gid, concat(c_mktsegment, ', ', c_name) AS sort_name FROM {customer}",
    "artist_credit": "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN concat('Иванов ', c_name) ELSE c_name END AS name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 1 END AS artist_count FROM {customer}",
    "artist_credit_name": """SELECT c_custkey AS artist_credit, c_custkey AS artist, c_name AS name, 0 AS position, '' AS join_phrase FROM {customer}
        UNION ALL SELECT c_custkey, c_custkey + 1, c_mktsegment, 1, ' and ' FROM {customer} WHERE c_mktsegment = 'MACHINERY'""",
    "artist_alias": "SELECT c_custkey AS id, concat(c_mktsegment, ' ', c_custkey) AS name FROM {customer} WHERE c_mktsegment <> 'MACHINERY' AND c_custkey > 1",
    "recording_alias": "SELECT p_partkey AS recording_id, concat(p_brand, ' ', p_name) AS name FROM {part}",
    "track": "SELECT DISTINCT l_partkey AS recording FROM {lineitem} WHERE l_quantity = 50",
    "built": "SELECT c_custkey AS index_id FROM {customer} WHERE c_mktsegment = 'BUILDING'",
    "requests": """SELECT DISTINCT o_orderkey * 10000000 + p_partkey AS req_id, concat(substr(c_name, 1, 3), substr(c_name, 5), 'zq') AS artist,
        CASE WHEN o_orderstatus = 'F' THEN concat(substr(o_orderpriority, 1, 4), substr(o_orderpriority, 6), ' ', o_orderkey) ELSE '' END AS release,
        concat(substr(p_name, 1, 4), substr(p_name, 6), ' ', p_type) AS recording
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey WHERE o_orderkey % 100 = 0""",
    "odd_names": "SELECT c_custkey AS id, concat(repeat('!', 1 + CAST(c_custkey % 5 AS INT)), ' ', repeat('?', CAST(c_custkey % 3 AS INT))) AS name FROM {customer}",
    "odd_requests": "SELECT c_custkey AS req_id, concat(repeat('!', 1 + CAST(c_custkey % 5 AS INT)), ' ', repeat('?', CAST(c_custkey % 3 AS INT))) AS artist FROM {customer} WHERE c_custkey % 100 = 0",
    "part_docs": "SELECT CAST(0 AS BIGINT) AS index_id, p_partkey AS pos, p_partkey AS entity_id, p_name AS name FROM {part}",
    "part_queries": "SELECT p_partkey AS q, CAST(0 AS BIGINT) AS index_id, concat(p_name, 'zq') AS name FROM {part} WHERE p_partkey % 100 = 0",
    "part_names": "SELECT p_partkey AS q, CAST(0 AS BIGINT) AS index_id, p_name AS name FROM {part} WHERE p_partkey % 100 = 0",
    "long_docs": "SELECT CAST(0 AS BIGINT) AS index_id, p_partkey AS pos, p_partkey AS entity_id, concat(p_name, ' ', p_type, ' ', p_brand, ' size ', p_size) AS name FROM {part}",
    "long_queries": "SELECT p_partkey AS q, CAST(0 AS BIGINT) AS index_id, concat(substr(p_name, 1, 3), substr(p_name, 5), ' ', p_type, 'q ', p_brand, ' size ', p_size) AS name FROM {part} WHERE p_partkey % 100 = 0",
    "title_docs": "SELECT CAST(0 AS BIGINT) AS index_id, page_id AS pos, page_id AS entity_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS name FROM {pages}",
    "title_queries": "SELECT page_id AS q, CAST(0 AS BIGINT) AS index_id, concat(regexp_extract(html, '<title>([^<]*)</title>', 1), 'x') AS name FROM {pages} WHERE page_id % 100 = 0",
}

def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(RELATIONS[name].format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def text(name: str) -> str:
    """The relation for the oracle."""
    return RELATIONS[name].format(**{t: t for t in TABLES})
