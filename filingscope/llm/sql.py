"""DuckDB SQL for those of queries.py that SQL can express."""

ORACLES: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest, min(page_id) OVER (PARTITION BY payload) AS leader FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> leader THEN leader END AS refers_to FROM q
""",
}
