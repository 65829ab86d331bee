"""A two-version policy corpus derived from the `part` table.

Forty clauses make a document pair; the key modulo 16 decides what version B does with a clause: 0-5 keep it, 6 another
number, 7 a negation, 8 another modal, 9 another date, 10 another sum of money, 11 only in B, 12 only in A, 13 other
words, 14 a condition, 15 another text with the same signals. The statement runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SQL = """
WITH parts AS (
  SELECT p_partkey AS id, CAST(p_partkey % 16 AS INT) AS k, CAST(p_partkey % 40 AS INT) AS ordinal,
         concat('pair_', CAST(CAST(floor(p_partkey / 40) AS BIGINT) AS STRING)) AS pair_id, p_type AS kind, p_size AS days,
         CAST(floor(p_retailprice) AS BIGINT) AS price,
         concat(' Refs xa', CAST(p_partkey AS STRING), ' xb', CAST(p_partkey AS STRING), ' xc', CAST(p_partkey AS STRING), ' xd', CAST(p_partkey AS STRING), ' xe', CAST(p_partkey AS STRING), ' xf', CAST(p_partkey AS STRING), '.') AS refs
  FROM {part}),
sides AS (SELECT parts.*, 'a' AS side FROM parts WHERE k <> 11 UNION ALL SELECT parts.*, 'b' AS side FROM parts WHERE k <> 12)
SELECT pair_id, side, ordinal, k, concat(CAST(ordinal + 1 AS STRING), '. ', md5(CAST(id AS STRING))) AS heading,
  CASE WHEN k = 15 AND side = 'b' THEN concat('must shall ', CAST(days AS STRING), ' ', CAST(id AS STRING), refs)
  ELSE concat(
    CASE WHEN k = 13 AND side = 'b' THEN 'Goods of type ' ELSE 'Items of type ' END, kind,
    CASE WHEN k = 7 AND side = 'b' THEN ' must not ship within ' WHEN k = 8 AND side = 'b' THEN ' may ship within ' ELSE ' must ship within ' END,
    CAST(CASE WHEN k = 6 AND side = 'b' THEN days + 1 ELSE days END AS STRING),
    ' days of order and the supplier shall notify the buyer in writing of any delay for lot ', CAST(id AS STRING), '.',
    CASE WHEN k = 9 THEN CASE WHEN side = 'b' THEN ' This rule applies from 6 April 2025.' ELSE ' This rule applies from 5 March 2024.' END ELSE '' END,
    CASE WHEN k = 10 THEN concat(' The fee is $', CAST(CASE WHEN side = 'b' THEN price + 5 ELSE price END AS STRING), ' per lot.') ELSE '' END,
    CASE WHEN k = 14 AND side = 'b' THEN ' This holds provided that stock lasts.' ELSE '' END, refs) END AS text
FROM sides
"""


def clauses(spark, sf_dir: str) -> DataFrame:
    """pair_id, side, ordinal, k, heading, text."""
    return spark.sql(SQL, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def duck(name: str = "corpus") -> str:
    """The corpus as the head of a DuckDB statement."""
    return f"WITH {name} AS ({SQL.format(part='part')})"
