"""Geometry tables derived from the driver tables, by SQL text that Spark and DuckDB both run.

Coordinates come from keys by modular arithmetic; cubing is a bijection modulo the
two primes, so different keys lie at different places and neighbours scatter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _x(k: str) -> str:
    return f"((({k})*7919+13)%10007)"


def _y(k: str) -> str:
    return f"((({k})*104729+7)%9929)"


def lon(k: str) -> str:
    x = _x(k)
    return f"(34.482724e0+0.100577e0*(({x}*{x}*{x})%10007)/10007e0)"


def lat(k: str) -> str:
    y = _y(k)
    return f"(31.492354e0+0.092842e0*(({y}*{y}*{y})%9929)/9929e0)"


def txt(v: str) -> str:
    return f"CAST(CAST({v} AS DECIMAL(11,7)) AS STRING)"


def box_wkt(a: str, b: str, c: str, d: str) -> str:
    """WKT of the rectangle min_lon a, min_lat b, max_lon c, max_lat d."""
    corners = ((a, b), (c, b), (c, d), (a, d), (a, b))
    return "'POLYGON ((' || " + " || ', ' || ".join(f"{txt(x)} || ' ' || {txt(y)}" for x, y in corners) + " || '))'"


#: Name -> SQL over the raw tables, which stand in braces.
TABLES = {
    "q_points": f"SELECT c_custkey AS geom_id, {lon('c_custkey+50000017')} AS lon, {lat('c_custkey+50000017')} AS lat FROM {{customer}}",
    "o_points": f"""SELECT o_orderkey AS obj_id, {lon('o_orderkey')} AS lon, {lat('o_orderkey')} AS lat,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'school' END AS amenity, CASE WHEN o_orderstatus = 'F' THEN 'yes' END AS shop FROM {{orders}}""",
    "buildings": f"""SELECT obj_id, building, height, ground, min_lon, min_lat, max_lon, max_lat, {box_wkt('min_lon', 'min_lat', 'max_lon', 'max_lat')} AS wkt
  FROM (SELECT p_partkey AS obj_id, CASE WHEN p_size % 5 <> 0 THEN p_type END AS building, p_retailprice/100e0 AS height, CAST(p_size AS DOUBLE) AS ground,
    round({lon('p_partkey+700001')}, 7) AS min_lon, round({lat('p_partkey+700001')}, 7) AS min_lat,
    round({lon('p_partkey+700001')} + (5+p_size)*1e-5/1.11e0, 7) AS max_lon, round({lat('p_partkey+700001')} + (5+p_size%7)*1e-5/1.11e0, 7) AS max_lat FROM {{part}}) x""",
    "road_vertices": f"""SELECT l_orderkey AS obj_id, l_linenumber AS seq, {lon('l_orderkey')}+l_linenumber*3e-4 AS lon, {lat('l_orderkey')}+(MIN(l_partkey)%11-5)*1e-4 AS lat
  FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber""",
    "roads": """SELECT o_orderkey AS obj_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'primary' WHEN '2-HIGH' THEN 'secondary' WHEN '3-MEDIUM' THEN 'residential' WHEN '5-LOW' THEN 'service' END AS highway FROM {orders}""",
    "ways": """SELECT l_suppkey AS source, l_partkey % (SELECT count(*) FROM {supplier}) AS target, MIN(l_extendedprice)/100e0 AS length_m, 30e0+MIN(l_quantity) AS maxspeed_forward
  FROM {lineitem} WHERE l_linenumber = 1 AND l_suppkey <> l_partkey % (SELECT count(*) FROM {supplier}) GROUP BY 1, 2""",
    "scores": "SELECT p_partkey AS obj_id, 'exp' || CAST(p_partkey%2 AS STRING) AS experiment, 'm1' AS model, ((p_partkey*31)%1000)/1000e0 AS scores FROM {part}",
    "probas": "SELECT doc_id, CAST(quality AS DOUBLE) AS y, ((doc_id*37)%1000)/1000e0 AS proba FROM {labels}",
    "areas": f"""SELECT s_suppkey AS source_idx, round({lon('s_suppkey+3000')}, 7) AS min_lon, round({lat('s_suppkey+3000')}, 7) AS min_lat,
  round({lon('s_suppkey+3000')}+4e-3, 7) AS max_lon, round({lat('s_suppkey+3000')}+3e-3, 7) AS max_lat, CAST(s_nationkey%2 AS DOUBLE) AS y FROM {{supplier}}""",
    "events_geo": f"SELECT event_id, ts, user_id, event_type, value, {lon('event_id')} AS lon, {lat('event_id')} AS lat FROM {{events}}",
}

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a raw one."""
    if name in RAW:
        return raw(spark, sf_dir, name)
    text = TABLES[name]
    return spark.sql(text, **{t: raw(spark, sf_dir, t) for t in RAW if "{" + t + "}" in text})


def with_tables(body: str, *names: str) -> str:
    """DuckDB SQL of ``body`` over derived tables."""
    ctes = ", ".join(f"{n} AS ({TABLES[n].format(**{t: t for t in RAW})})" for n in names)
    return f"WITH {ctes} {body}" if not body.lstrip().startswith(",") else f"WITH {ctes}{body}"
