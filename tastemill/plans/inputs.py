"""SQL twins of ``tastemill.sources`` (DuckDB dialect), as CTE texts.

Each constant is ``name AS (...)``; compose with ``with_(...)``.
"""

from __future__ import annotations

from tastemill.sources.tables import COMPONENT_OF_EVENT, PRIORITY_CODE, RATING_OF_EVENT

CATALOG = """catalog AS (
  SELECT p.p_partkey AS item_id, p.p_name AS title, p.p_type AS genre, p.p_brand AS subgenre,
         string_split(p.p_name, ' ') AS genres, p.p_retailprice AS price,
         CAST(p.p_size AS DOUBLE) AS size, CAST(a.n_orders AS DOUBLE) AS n_orders, a.qty,
         a.avg_price, a.avg_discount, a.first_ship
  FROM part p LEFT JOIN (
    SELECT l_partkey, count(*) AS n_orders, sum(l_quantity) AS qty, avg(l_extendedprice) AS avg_price,
           avg(l_discount) AS avg_discount, min(l_shipdate) AS first_ship
    FROM lineitem GROUP BY l_partkey) a ON a.l_partkey = p.p_partkey)"""

FEEDBACK = """feedback AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS item_id,
         CASE WHEN max(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN -1 ELSE 1 END AS label,
         CAST(year(min(o.o_orderdate)) AS INTEGER) AS round_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_custkey, l.l_partkey)"""


def _case(mapping: dict, col: str, quote_values: bool = False) -> str:
    parts = []
    for k, v in mapping.items():
        vv = f"'{v}'" if quote_values else repr(v)
        parts.append(f"WHEN {col} = '{k}' THEN {vv}")
    return "CASE " + " ".join(parts) + " END"


INTERACTIONS = f"""interactions AS (
  SELECT user_id, item_id, sum(rating) AS rating FROM (
    SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
           CAST({_case(RATING_OF_EVENT, 'event_type')} AS DOUBLE) AS rating
    FROM events) WHERE item_id IS NOT NULL AND rating IS NOT NULL
  GROUP BY user_id, item_id)"""

RUNS = f"""runs AS (
  SELECT user_id AS run_id, {_case(COMPONENT_OF_EVENT, 'event_type', True)} AS component,
         event_id AS seq, ts, value AS duration_s FROM events)"""

REGRESSION = f"""regression AS (
  SELECT o.o_orderkey AS order_id, c.c_mktsegment AS segment, li.n_lines, li.sum_qty,
         li.avg_discount, li.avg_tax, c.c_acctbal AS acctbal,
         CAST({_case(PRIORITY_CODE, 'o.o_orderpriority')} AS DOUBLE) AS priority,
         o.o_totalprice AS target
  FROM orders o
  JOIN (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS sum_qty,
               avg(l_discount) AS avg_discount, avg(l_tax) AS avg_tax
        FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey)"""

VECTORS = """vectors AS (
  SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS features, label AS genre FROM embeddings)"""


def feats(cols: list[str], name: str = "feats", text: bool = True) -> str:
    """Median-filled, z-scored (population std) catalogue features
    (``text=False`` leaves out the genre columns)."""
    med = ", ".join(f"median({c}) AS m_{c}" for c in cols)
    fill = ", ".join(f"coalesce(CAST(c.{c} AS DOUBLE), m.m_{c}) AS {c}" for c in cols)
    st = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    z = ", ".join(
        f"(f.{c} - s.a_{c}) / (CASE WHEN s.s_{c} = 0 OR s.s_{c} IS NULL THEN 1.0 ELSE s.s_{c} END) AS {c}"
        for c in cols)
    return f"""{name}_med AS (SELECT {med} FROM catalog),
{name}_fill AS (SELECT c.item_id, {"c.genre, c.genres, " if text else ""}{fill} FROM catalog c, {name}_med m),
{name}_st AS (SELECT {st} FROM {name}_fill),
{name} AS (SELECT f.item_id, {"f.genre, f.genres, " if text else ""}{z} FROM {name}_fill f, {name}_st s)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
