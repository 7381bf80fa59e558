"""Where queries and their SQL are kept."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# How the SQL of the oracles sees the tables as logs.
EV = """ev AS (SELECT user_id, json_extract_string(props, '$.k') AS item, ts, event_id AS row_id, event_type, value,
  CASE event_type WHEN 'purchase' THEN 'self' WHEN 'click' THEN 'gift_given' WHEN 'view' THEN 'household' WHEN 'signup' THEN 'received' ELSE 'unclear' END AS label
  FROM events)"""
OD = """od AS (SELECT o_custkey AS user_id, l_partkey AS item, o_orderdate AS ts,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
  CASE l_returnflag || l_linestatus WHEN 'NO' THEN 'self' WHEN 'AF' THEN 'gift_given' WHEN 'RF' THEN 'household' WHEN 'NF' THEN 'received' WHEN 'AO' THEN 'self' ELSE 'unclear' END AS label,
  l_quantity AS quantity, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DOC = "doc AS (SELECT doc_id AS row_id, coalesce(text, '') AS text, source AS category, lang FROM documents)"
SPLIT = f"""{EV}, pos AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, row_id) - 1 AS seq_pos, count(*) OVER (PARTITION BY user_id) AS seq_len FROM ev),
sp AS (SELECT *, CASE WHEN seq_len - seq_pos = 1 THEN 'test' WHEN seq_len - seq_pos = 2 THEN 'valid' ELSE 'train' END AS split FROM pos)"""


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return keep
