"""Building blocks of the SQL that checks the queries."""

EVENTS = """
base AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) * 1000 AS start_ns,
         epoch_us(ts) * 1000 + CAST(round(value * 1000000) AS BIGINT) AS end_ns,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
spans AS (
  SELECT lpad(lower(to_hex(user_id)), 32, '0') AS trace_id,
         lpad(lower(to_hex(event_id)), 16, '0') AS span_id,
         CASE WHEN event_id = root_id THEN '' ELSE lpad(lower(to_hex(root_id)), 16, '0') END AS parent_span_id,
         event_type AS name, start_ns, end_ns, k, event_id, user_id,
         CASE WHEN k % 10 <> 0 THEN 'k' || (k % 7) END AS bucket,
         'svc' || (user_id % 3) AS service
  FROM (SELECT *, first_value(event_id) OVER (PARTITION BY user_id ORDER BY start_ns, event_id) AS root_id
        FROM base))"""

CONVERSATIONS = """
base AS (
  SELECT *, 1700000000 + conv_id * 86400 AS epoch,
         (1700000000 + conv_id * 86400 + turn * 60) * 1000000000 AS start_ns
  FROM conversations),
spans AS (
  SELECT lpad(lower(to_hex(conv_id)), 32, '0') AS trace_id,
         lpad(lower(to_hex(conv_id * 1000000 + turn)), 16, '0') AS span_id,
         CASE WHEN role = 'user' THEN '' ELSE lpad(lower(to_hex(conv_id * 1000000)), 16, '0') END AS parent_span_id,
         CASE role WHEN 'user' THEN 'ask' WHEN 'assistant' THEN 'chat' ELSE 'setup' END AS name,
         start_ns, start_ns + 30000000000 AS end_ns,
         'conv/' || conv_id || '/' || epoch AS chat_id, role, text, conv_id, turn
  FROM base)"""

ORDERS = """
spans AS (
  SELECT lpad(lower(to_hex(o_orderkey)), 32, '0') AS trace_id,
         lpad(lower(to_hex(o_orderkey * 16 + line)), 16, '0') AS span_id,
         CASE WHEN line = 0 THEN '' ELSE lpad(lower(to_hex(o_orderkey * 16)), 16, '0') END AS parent_span_id,
         CASE WHEN line = 0 THEN 'order' ELSE 'ship' END AS name, start_ns, end_ns
  FROM (SELECT o_orderkey, 0 AS line, epoch_us(o_orderdate) * 1000 AS start_ns,
               epoch_us(o_orderdate) * 1000 + 3600000000000 AS end_ns FROM orders
        UNION ALL
        SELECT o_orderkey, l_linenumber, epoch_us(o_orderdate) * 1000, epoch_us(l_shipdate) * 1000
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"""

SIM = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey AS part, l_quantity AS quantity,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) AS copy
  FROM lineitem),
sim AS (
  SELECT 'order' || o_orderkey AS trace_id, 'root' AS span_id, CAST(NULL AS VARCHAR) AS parent_id, 'order' AS span_name,
         0 AS start_offset_ms, o_custkey % 5000 AS duration_ms FROM orders
  UNION ALL
  SELECT 'order' || a.l_orderkey, 'line' || a.l_linenumber || CASE WHEN a.copy > 1 THEN '-' || a.copy ELSE '' END,
         CASE WHEN b.l_orderkey IS NULL THEN 'root' ELSE 'line' || (a.l_linenumber - 1) END, 'ship',
         a.part % 3000, CAST(a.quantity * 100 - 300 AS BIGINT)
  FROM lines a LEFT JOIN lines b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1
       AND a.copy = b.copy AND b.copy = 1)"""


def sessions(source: str, key: str, gap_ms: int, ttl_ms: int | None = None) -> str:
    """CTEs up to ``placed``, ``deduped`` and ``evs`` for one source."""
    expired = (
        f"CASE WHEN start_ms - prev > {gap_ms + ttl_ms} THEN 1 ELSE 0 END" if ttl_ms is not None else "0"
    )
    return f"""{source},
keyed AS (SELECT *, {key} AS key, start_ns // 1000000 AS start_ms FROM spans),
lagged AS (
  SELECT *, lag(start_ms) OVER (PARTITION BY key ORDER BY start_ms, span_id, end_ns) AS prev FROM keyed),
flagged AS (
  SELECT *, CASE WHEN prev IS NULL OR start_ms - prev > {gap_ms} THEN 1 ELSE 0 END AS brk,
         {expired} AS expd FROM lagged),
counted AS (
  SELECT *, sum(brk) OVER w AS sno, sum(expd) OVER w AS generation FROM flagged
  WINDOW w AS (PARTITION BY key ORDER BY start_ms, span_id, end_ns ROWS UNBOUNDED PRECEDING)),
placed AS (
  SELECT *, min(start_ms) OVER (PARTITION BY key, sno) AS session_start,
         max(start_ms) OVER (PARTITION BY key, sno) + {gap_ms} AS session_end FROM counted),
deduped AS (
  SELECT * FROM placed
  QUALIFY row_number() OVER (PARTITION BY key, session_start, span_id ORDER BY start_ns, end_ns, trace_id) = 1),
evs AS (
  SELECT *, false AS is_end, start_ns AS epoch_ns FROM deduped
  UNION ALL SELECT *, true, end_ns FROM deduped)"""


TRUTH = "CASE WHEN {0} THEN 'True' WHEN NOT ({0}) THEN 'False' ELSE 'Undecided' END"


def truth(condition: str) -> str:
    return TRUTH.format(condition)


def duration_verdicts(limit: int, match: str, name: str) -> str:
    """CTE ``totals`` and ``judged`` from ``deduped`` spans."""
    return f"""
totals AS (
  SELECT key, generation, session_start, session_end,
         CAST(sum(CASE WHEN {match} THEN abs(end_ns - start_ns) ELSE 0 END) AS BIGINT) AS amount
  FROM deduped GROUP BY ALL),
judged AS (
  SELECT key, session_start, session_end, '{name}' AS propertyName,
         CASE WHEN sum(amount) OVER (PARTITION BY key, generation ORDER BY session_start) < {limit}
              THEN 'True' ELSE 'False' END AS truthValue FROM totals)"""
