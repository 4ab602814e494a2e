"""The archive model over plain tables.

Each archive table is defined once, in SQL that Spark and DuckDB both read, over the tables of a data folder and over
other archive tables. ``frame`` gives it as a DataFrame; ``with_tables`` gives it as common table expressions for the
SQL that a query is compared with.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

#: What the two dialects write differently: (Spark, DuckDB).
DIALECT = {
    "epoch(ts)": ("unix_seconds(CAST(ts AS timestamp))", "CAST(floor(epoch(ts)) AS BIGINT)"),
    "json_k(props)": ("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"),
}

TABLES: dict[str, str] = {
    # events as messages: a user's stream is a thread, sign-ups and errors are service messages
    "message": """
        SELECT event_id AS id, concat('ev/', CAST(user_id AS STRING), '/', CAST(event_id AS STRING)) AS uid,
               concat('t:', CAST(user_id AS STRING)) AS thread_id,
               CASE WHEN event_id % 3 = 0 THEN 'i:owner' ELSE concat('i:', CAST((user_id * 7 + event_id % 5) % 211 AS STRING)) END AS sender_identity_id,
               CASE WHEN event_type IN ('signup', 'error') THEN 'service' ELSE 'message' END AS kind,
               epoch(ts) AS sent_at_unix, concat(event_type, ' ', props) AS plaintext, event_type, value,
               CASE WHEN event_id % 13 = 0 THEN concat('ev/', CAST(user_id AS STRING), '/', CAST(event_id - 1 AS STRING)) END AS reply_to_uid,
               CASE WHEN event_id % 2 = 0 THEN 'src:a' ELSE 'src:b' END AS source_id
        FROM {events}""",
    "thread": """
        SELECT thread_id AS id, CASE n % 10 WHEN 0 THEN 'group' WHEN 1 THEN 'channel' WHEN 2 THEN 'group' WHEN 3 THEN 'saved' ELSE 'dm' END AS kind,
               CASE WHEN n % 7 = 0 THEN NULL ELSE concat('Thread ', CAST(n AS STRING)) END AS title, n % 17 = 0 AS ai_excluded
        FROM (SELECT DISTINCT thread_id, CAST(substr(thread_id, 3) AS BIGINT) AS n FROM {message}) x""",
    "identity": """
        SELECT DISTINCT sender_identity_id AS id,
               CASE WHEN sender_identity_id = 'i:owner' THEN 'Owner' ELSE concat('Name ', CAST(CAST(substr(sender_identity_id, 3) AS BIGINT) % 90 AS STRING)) END AS display_name,
               CASE WHEN sender_identity_id = 'i:owner' THEN 'alpha' WHEN CAST(substr(sender_identity_id, 3) AS BIGINT) % 3 = 0 THEN 'alpha' ELSE 'beta' END AS platform,
               CASE WHEN sender_identity_id = 'i:owner' THEN 'me' WHEN CAST(substr(sender_identity_id, 3) AS BIGINT) % 5 = 0 THEN NULL
                    ELSE concat('h', CAST(CAST(substr(sender_identity_id, 3) AS BIGINT) % 160 AS STRING)) END AS handle,
               CASE WHEN sender_identity_id = 'i:owner' THEN false ELSE CAST(substr(sender_identity_id, 3) AS BIGINT) % 11 = 0 END AS is_synthetic
        FROM (SELECT sender_identity_id FROM {message} WHERE sender_identity_id <> 'i:owner'
              UNION ALL SELECT 'i:owner' AS sender_identity_id) x""",
    "identity_person": """
        SELECT id AS identity_id, CASE WHEN id = 'i:owner' THEN 'owner' ELSE concat('p:', CAST(CAST(substr(id, 3) AS BIGINT) % 150 AS STRING)) END AS person_id,
               CASE WHEN id = 'i:owner' THEN 'seed' ELSE 'auto' END AS confidence FROM {identity}""",
    "person": """
        SELECT person_id AS id, CASE WHEN person_id = 'owner' THEN 'Owner' ELSE concat('Person ', substr(person_id, 3)) END AS display_name,
               person_id = 'owner' AS is_owner, person_id IN ('p:3', 'p:14') AS ai_excluded
        FROM (SELECT DISTINCT person_id FROM {identity_person}) x""",
    "thread_participant": """
        SELECT thread_id, sender_identity_id AS identity_id, min(sent_at_unix) AS first_seen_unix FROM {message} GROUP BY thread_id, sender_identity_id""",
    # conversations as messages of threads with text
    "chat": """
        SELECT conv_id * 1000 + turn AS id, concat('c:', CAST(conv_id AS STRING)) AS thread_id, role AS sender_identity_id,
               CAST(1700000000 AS BIGINT) + conv_id * 86400 + turn * 60 + CASE WHEN turn >= 4 THEN 18000 ELSE 0 END AS sent_at_unix,
               text AS plaintext, turn, conv_id FROM {conversations}""",
    "search_document": """
        SELECT doc_id AS id, text AS body, source AS provenance, lang AS thread_id, concat('p:', CAST(doc_id % 20 AS STRING)) AS person_id,
               doc_id * 3600 AS sent_at_unix FROM {documents}""",
    # the same with words of letters with marks, composed and not
    "marked_document": """
        SELECT id, concat(coalesce(body, ''), CASE id % 6 WHEN 0 THEN ' Мой дом, твой ЁЖ' WHEN 1 THEN ' żółw i Gęś, łódź' WHEN 2 THEN ' ő és ű, větší' WHEN 3 THEN ' мои дома, ёжик'
               WHEN 4 THEN ' zolw ges' ELSE ' gęś mой' END) AS body, provenance, thread_id, person_id, sent_at_unix
        FROM {search_document}""",
    "import_run": """
        SELECT concat('imp-', CAST(c_custkey AS STRING)) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'src:a' ELSE 'src:b' END AS source_id,
               concat('/exports/', c_mktsegment) AS source_path, concat('fp', CAST(c_custkey % 37 AS STRING)) AS source_fingerprint,
               CASE WHEN c_custkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status, c_custkey * 1000 AS finished_unix FROM {customer}""",
    "media": """
        SELECT CAST(page_id AS BIGINT) AS id, html AS content, length(html) AS byte_size, url AS export_path FROM {pages}""",
    # one row for each order line
    "line": """
        SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_discount) AS l_discount,
               min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "fact": """
        SELECT concat('f', CAST(l_orderkey * 10 + l_linenumber AS STRING)) AS id, concat('p:', CAST(l_suppkey % 40 AS STRING)) AS subject_person_id,
               CASE l_linenumber % 4 WHEN 0 THEN 'works_at' WHEN 1 THEN 'lives_in' WHEN 2 THEN 'likes' ELSE 'owns' END AS predicate,
               CASE WHEN l_linenumber % 2 = 0 THEN concat('The Value ', CAST(l_partkey % 30 AS STRING)) ELSE concat('value-', CAST(l_partkey % 30 AS STRING)) END AS object_text,
               l_discount * 10 AS confidence, l_orderkey * 3600 AS valid_from, CASE WHEN l_linestatus = 'F' THEN l_orderkey * 3600 + 86400 END AS valid_to,
               CASE WHEN l_returnflag = 'R' AND l_orderkey % 10 = 0 THEN l_orderkey * 7200 END AS retracted_at,
               CASE WHEN l_linenumber > 1 AND l_orderkey % 9 = 0 THEN concat('f', CAST(l_orderkey * 10 + l_linenumber - 1 AS STRING)) END AS merged_into,
               CASE WHEN l_orderkey % 31 = 0 THEN 'user_edited' WHEN l_orderkey % 29 = 0 THEN 'user_deleted' ELSE 'extracted' END AS source
        FROM {line}""",
    "fact_citation": """
        SELECT concat('f', CAST(l_orderkey * 10 + l_linenumber AS STRING)) AS fact_id, CAST(l_partkey % 1000 AS BIGINT) AS message_id,
               CASE WHEN l_quantity > 25 THEN 'asserts' WHEN l_quantity > 5 THEN 'corroborates' ELSE 'contradicts' END AS role
        FROM {line}""",
    "ai_job": """
        SELECT event_id AS id, event_type AS kind, concat('t:', CAST(user_id AS STRING)) AS subject_id,
               CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'failed' END AS state,
               epoch(ts) DIV_ 86400 AS priority, CAST(event_id % 4 AS BIGINT) AS attempts,
               CASE WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN epoch(ts) + 900 END AS lease_unix, concat('h', CAST(event_id % 50 AS STRING)) AS input_hash
        FROM {events}""",
    "ai_interaction": """
        SELECT event_id AS id, event_type AS purpose, concat('m', CAST(user_id % 3 AS STRING)) AS model, CAST(round(value * 10) AS BIGINT) AS duration_ms,
               CAST(event_id % 700 AS BIGINT) AS total_tokens, event_id % 6 = 0 AS failed,
               CASE WHEN event_id % 6 = 0 THEN CASE event_id % 4 WHEN 0 THEN 'timeout' WHEN 2 THEN 'rate' END END AS failure_kind, epoch(ts) AS created_unix
        FROM {events}""",
    "sync_chat": """
        SELECT 'src:a' AS source_id, concat('t:', CAST(c_custkey AS STRING)) AS chat_id, CASE c_custkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'chat' ELSE 'channel' END AS peer_kind,
               c_name AS title, CASE c_custkey % 4 WHEN 0 THEN 'include' WHEN 1 THEN 'ignore' END AS decision, c_custkey * 100 AS last_message_unix FROM {customer}""",
}


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", TABLES[name])))


def _for(sql: str, dialect: int) -> str:
    for written, forms in DIALECT.items():
        sql = sql.replace(written, forms[dialect])
    return sql.replace("DIV_", ("div", "//")[dialect])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An archive table, or a table of the folder, as a DataFrame."""
    if name in SOURCES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_for(TABLES[name], 0), **{n: frame(spark, sf_dir, n) for n in _needs(name)})


def with_tables(names: str, body: str) -> str:
    """``body`` with the archive tables named before it (space-separated) as common table expressions for DuckDB."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in SOURCES and name not in order:
            for n in _needs(name):
                visit(n)
            order.append(name)

    for name in names.split():
        visit(name)
    ctes = ",\n".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', _for(TABLES[n], 1))})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    return f"WITH {ctes},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes}\n{body}"
