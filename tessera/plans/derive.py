"""Relations derived from the star-schema tables, in SQL that both engines read, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FILES = """SELECT doc_id, text, lang, source, source || '/' || lang || '/' || CASE WHEN doc_id % 10 = 0 THEN 'tests/' ELSE '' END || 'doc_' || CAST(doc_id AS STRING)
  || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.md' WHEN 3 THEN '.txt' ELSE '.png' END AS path FROM {documents}"""
NODES = """SELECT 'r_' || CAST(r_regionkey AS STRING) AS id, r_name AS label, 'region/region.py' AS source_file, CAST(r_regionkey AS BIGINT) AS seq, CAST(r_regionkey AS BIGINT) AS community FROM {region}
UNION ALL SELECT 'n_' || CAST(n_nationkey AS STRING), n_name, 'nation/n_' || CAST(n_nationkey AS STRING) || '.py', 100 + n_nationkey, CAST(n_regionkey AS BIGINT) FROM {nation}
UNION ALL SELECT 's_' || CAST(s_suppkey AS STRING), s_name, 'supplier/n_' || CAST(s_nationkey AS STRING) || '.ts', 1000 + s_suppkey, CAST(s_nationkey % 5 AS BIGINT) FROM {supplier}
UNION ALL SELECT 'p_' || CAST(p_partkey AS STRING), p_name, 'part/' || p_brand || '.md', 10000000 + p_partkey, CAST(p_partkey % 5 AS BIGINT) FROM {part}
UNION ALL SELECT 'c_' || CAST(c_custkey AS STRING), c_name, 'customer/n_' || CAST(c_nationkey AS STRING) || '.py', 2000000000 + c_custkey, CAST(c_nationkey % 5 AS BIGINT) FROM {customer}"""
#: Edges of every row. `seq` orders the edges of one pair of ends: rows that have it alike are alike. `mark` is a number of each.
EDGES = """SELECT source, target, relation, confidence, score AS confidence_score, mark, confidence || lpad(CAST(CAST(round(score * 100) AS INT) AS STRING), 3, '0') || tie AS seq FROM (
SELECT 'r_' || CAST(n_regionkey AS STRING) AS source, 'n_' || CAST(n_nationkey AS STRING) AS target, 'contains' AS relation, 'EXTRACTED' AS confidence, CAST(1.0 AS DOUBLE) AS score, '' AS tie, CAST(n_nationkey AS BIGINT) AS mark FROM {nation}
UNION ALL SELECT 'n_' || CAST(c_nationkey AS STRING), 'c_' || CAST(c_custkey AS STRING), 'method', 'EXTRACTED', CAST(1.0 AS DOUBLE), '', CAST(c_custkey AS BIGINT) FROM {customer}
UNION ALL SELECT 'n_' || CAST(s_nationkey AS STRING), 's_' || CAST(s_suppkey AS STRING), 'method', 'EXTRACTED', CAST(1.0 AS DOUBLE), '', CAST(s_suppkey AS BIGINT) FROM {supplier}
UNION ALL SELECT 's_' || CAST(l_suppkey AS STRING), 'p_' || CAST(l_partkey AS STRING), 'calls', CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'A' THEN 'INFERRED' ELSE 'AMBIGUOUS' END,
  1.0 - CAST(CAST(round(l_discount * 100) AS INT) AS DOUBLE) / 100, CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':' || CAST(CAST(l_quantity AS INT) AS STRING), CAST(l_orderkey AS BIGINT) FROM {lineitem}) x"""
#: The same edges, one for each pair of ends.
SIMPLE = f"""SELECT least(source, target) AS lo, greatest(source, target) AS hi, max_by(relation, seq) AS relation, max_by(confidence, seq) AS confidence, max_by(confidence_score, seq) AS confidence_score,
  max_by(source, seq) AS source, max_by(target, seq) AS target, count(*) AS n, max(seq) AS seq FROM ({EDGES}) e GROUP BY 1, 2"""
CHUNKS = r"""SELECT path, CAST(k * 4 + 1 AS BIGINT) AS start_line, CAST(least(k * 4 + 5, len(lines)) AS BIGINT) AS end_line, array_to_string(lines[k * 4 + 1 : k * 4 + 5], chr(10)) AS content FROM (
  SELECT path, lines, unnest(range(0, greatest(CAST(ceil((len(lines) - 5) / 4.0) AS BIGINT), 0) + 1)) AS k FROM (SELECT path, string_split(regexp_replace(coalesce(text, ''), '\n$', ''), chr(10)) AS lines FROM (""" + FILES + ")))"
DUCK = {t: t for t in TABLES}


def duck(sql: str) -> str:
    """The SQL with plain table names, for the other engine."""
    return sql.format(**DUCK)


class Tables:
    """The tables of a folder by name, and the derived relations."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    @cached_property
    def files(self) -> DataFrame:
        return self.sql(FILES)

    @cached_property
    def nodes(self) -> DataFrame:
        return self.sql(NODES)

    @cached_property
    def edges(self) -> DataFrame:
        return self.sql(EDGES)

    @cached_property
    def simple(self) -> DataFrame:
        from tessera.operators.graph import collapse_edges

        return collapse_edges(self.edges, ["relation", "confidence", "confidence_score"])

    @cached_property
    def chunks(self) -> DataFrame:
        from tessera.operators.chunking import linear

        return linear(self.files, size=5, overlap=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Tables as a query by its name, with its SQL where there is one."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder, f=f: f(Tables(spark, folder))
        if sql is not None:
            SQL[f.__name__] = duck(sql)
        return f

    return add


def big(*names: str) -> list[Column]:
    """The columns as 64-bit integers."""
    return [F.col(n).cast("long").alias(n) for n in names]


def r6(name: str | Column, alias: str | None = None) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.round(c, 6).alias(alias or name)
