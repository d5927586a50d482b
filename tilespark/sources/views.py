"""Map elements derived from the relational tables, as SQL that Spark and other engines read alike.

Positions are hashes of integer keys within latitude 20.5 to 26.5 and longitude 88 to 92.5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LAT, LON = (20.5, 26.5), (88.0, 92.5)


def _spread(key: str, prime: int, low: float, width: float) -> str:
    return f"(CAST({low} AS DOUBLE) + CAST(({key}) * {prime} % 1000003 AS DOUBLE) / CAST(1000003 AS DOUBLE) * CAST({width} AS DOUBLE))"


def _lat(key: str) -> str:
    return _spread(key, 7919, 20.5, 6)


def _lon(key: str) -> str:
    return _spread(key, 104729, 88, 4.5)


def _micro(value: str) -> str:
    return f"(CAST({value} AS DOUBLE) / CAST(1000000 AS DOUBLE))"


_FIVE = "(SELECT CAST(1 AS BIGINT) AS pos UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5)"
_SIDE = "20 + o_orderkey % 280 + (CASE WHEN o_orderkey % 7 = 0 THEN 500 ELSE 0 END)"

VIEWS: dict[str, str] = {
    "road_pt": f"""
SELECT l_orderkey AS way_id, l_partkey AS node_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS pos,
  {_lat('l_orderkey')} + {_micro('(l_partkey * 31) % 20011 - 10005')} AS lat, {_lon('l_orderkey')} + {_micro('(l_suppkey * 37 + l_partkey * 17) % 20011 - 10005')} AS lon
FROM lineitem""",
    "road": """
SELECT o_orderkey AS way_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'trunk' WHEN '2-HIGH' THEN 'primary_link' WHEN '3-MEDIUM' THEN 'tertiary' WHEN '4-NOT SPECIFIED' THEN 'residential'
    ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'service' WHEN o_orderkey % 3 = 1 THEN 'track' ELSE 'footway' END END AS highway,
  CASE WHEN o_orderkey % 11 = 0 THEN 'yes' END AS area
FROM orders""",
    "bld_pt": f"""
SELECT o_orderkey + 100000000 AS way_id, c.pos AS pos,
  {_lat('o_custkey % 40')} + {_micro(f'(o_orderkey * 13) % 2003 + (CASE WHEN c.pos IN (3, 4) THEN {_SIDE} ELSE 0 END)')} AS lat,
  {_lon('o_custkey % 40')} + {_micro(f'(o_orderkey * 29) % 2003 + (CASE WHEN c.pos IN (2, 3) THEN {_SIDE} ELSE 0 END)')} AS lon
FROM orders CROSS JOIN {_FIVE} c""",
    "area_pt": f"""
SELECT p_partkey + 300000000 AS way_id, c.pos AS pos,
  {_lat('p_partkey + 555')} + {_micro('CASE WHEN c.pos IN (3, 4) THEN p_size * p_size * p_size ELSE 0 END')} AS lat,
  {_lon('p_partkey + 555')} + {_micro('CASE WHEN c.pos IN (2, 3) THEN p_size * p_size * p_size ELSE 0 END')} AS lon
FROM part CROSS JOIN {_FIVE} c""",
    "area_tag": """
SELECT p_partkey + 300000000 AS way_id, CAST(1 AS BIGINT) AS tag_no,
  CASE p_partkey % 5 WHEN 0 THEN 'natural' WHEN 1 THEN 'landuse' WHEN 2 THEN 'leisure' WHEN 3 THEN 'amenity' ELSE 'name' END AS k,
  CASE p_partkey % 5 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'water' ELSE 'sand' END WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'farmland' ELSE 'open space' END
    WHEN 2 THEN 'park' WHEN 3 THEN 'school' ELSE p_name END AS v
FROM part
UNION ALL
SELECT p_partkey + 300000000, CAST(2 AS BIGINT), CASE p_partkey % 3 WHEN 0 THEN 'landuse' WHEN 1 THEN 'natural' ELSE 'source' END,
  CASE p_partkey % 3 WHEN 0 THEN 'forest' WHEN 1 THEN 'beach' ELSE 'survey' END
FROM part""",
    "poi": f"""
SELECT c_custkey + 200000000 AS node_id, {_lat('c_custkey + 77')} AS lat, {_lon('c_custkey + 77')} AS lon, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'amenity' WHEN 'AUTOMOBILE' THEN 'railway' WHEN 'HOUSEHOLD' THEN 'place' WHEN 'MACHINERY' THEN 'tourism' ELSE 'shop' END AS k,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'school' WHEN 'AUTOMOBILE' THEN 'station' WHEN 'HOUSEHOLD' THEN CASE WHEN c_custkey % 2 = 0 THEN 'town' ELSE 'hamlet' END
    WHEN 'MACHINERY' THEN 'hotel' ELSE 'books' END AS v
FROM customer""",
    "rel_member": f"""
SELECT s_suppkey + 400000000 AS rel_id, m.pos AS pos, CASE WHEN m.pos = 5 THEN 'node' ELSE 'way' END AS mtype, s_suppkey * 10 + m.pos AS member_id,
  CASE m.pos WHEN 1 THEN 'outer' WHEN 2 THEN '' WHEN 3 THEN 'outer' WHEN 4 THEN 'inner' ELSE 'label' END AS role
FROM supplier CROSS JOIN {_FIVE} m""",
    "rel_way_ref": """
SELECT s_suppkey * 10 + w.wno AS way_id, w.pos AS pos, s_suppkey * 10 + w.n AS node_id
FROM supplier CROSS JOIN (
  SELECT CAST(1 AS BIGINT) AS wno, CAST(1 AS BIGINT) AS pos, CAST(1 AS BIGINT) AS n UNION ALL SELECT 1, 2, 2 UNION ALL SELECT 1, 3, 3
  UNION ALL SELECT 2, 1, 5 UNION ALL SELECT 2, 2, 4 UNION ALL SELECT 2, 3, 3 UNION ALL SELECT 3, 1, 5 UNION ALL SELECT 3, 2, 6 UNION ALL SELECT 3, 3, 1
  UNION ALL SELECT 4, 1, 7 UNION ALL SELECT 4, 2, 8 UNION ALL SELECT 4, 3, 9 UNION ALL SELECT 4, 4, 7) w
WHERE NOT (w.wno = 2 AND s_suppkey % 5 = 0)""",
    "camera": f"""
SELECT user_id, event_id, ts, {_lat('event_id')} AS lat, {_lon('event_id')} AS lon, CAST(0.625 AS DOUBLE) * CAST(1 + event_id % 64 AS DOUBLE) AS scale
FROM events""",
}
_BASE = ("lineitem", "orders", "part", "customer", "supplier", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the Parquet tables of a folder; nothing is registered in the session."""
    sql = VIEWS[name]
    table = next(t for t in _BASE if f"FROM {t}" in sql)
    return spark.sql(sql.replace(f"FROM {table}", "FROM {table}"), table=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_views(*names: str, more: str = "") -> str:
    """WITH clause that defines views for a plain SQL engine."""
    return "WITH " + ", ".join([f"{n} AS ({VIEWS[n]})" for n in names] + ([more] if more else []))
