"""SQL text over a named set of tables."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from docflow.session import durable

log = logging.getLogger(__name__)


class MissingTables(ValueError):
    pass


def table_session(spark: SparkSession, tables: dict[str, str], required: set[str] = frozenset(),
                  fmt: str = "parquet") -> SparkSession:
    """A session that sees the given tables as views and no file paths as tables.

    `tables` maps a name to its path. Fails when a required name is not given.
    """
    missing = set(required) - set(tables)
    if missing:
        raise MissingTables(f"required tables missing: {sorted(missing)}")
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, path in tables.items():
        session.read.format(fmt).load(path).createOrReplaceTempView(name)
    return session


def missing_tables(spark: SparkSession, required: set[str]) -> set[str]:
    return set(required) - {t.name for t in spark.catalog.listTables()}


def run_sql(session: SparkSession, sql: str, args: dict | None = None) -> DataFrame | None:
    """The result of one query, computed once; text Spark rejects or fails on is logged and gives None.

    As a subquery the text can only be a query, no command. It may read the
    session's views and what it defines itself; other relations, also views
    shared between sessions and tables of other catalogs, and functions that
    call Java by name are refused before anything runs.
    """
    try:
        text = f"SELECT * FROM (\n{sql.strip().rstrip(';')}\n)"
        parsed = session._jsparkSession.sessionState().sqlParser().parsePlan(text)
        given = {t.name.lower() for t in session.catalog.listTables() if t.isTemporary and not t.namespace}
        others = _relations(parsed) - given
        if others:
            log.error("SQL uses tables that were not given: %s", sorted(others))
            return None
        result = session.sql(text, args=args or {})
        if "CallMethodViaReflection" in _expression_names(result._jdf.queryExecution().analyzed()):
            log.error("SQL calls Java by name: %s", sql)
            return None
        return durable(result)
    except (PySparkException, Py4JJavaError) as error:
        log.error("SQL failed: %s", error)
        return None


def _each(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]


def _plans(plan) -> list:
    """A logical plan and all below it, in its subqueries and in its common table expressions."""
    out = [plan]
    for part in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for below in _each(part.toIndexedSeq()):
            out += _plans(below)
    return out


def _relations(parsed) -> set[str]:
    """Names of the relations that the parsed text reads, without those it defines."""
    used, defined = set(), set()
    for plan in _plans(parsed):
        kind = plan.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            used.add(".".join(_each(plan.multipartIdentifier().toIndexedSeq())).lower())
        elif kind == "UnresolvedWith":
            defined |= {c._1().lower() for c in _each(plan.cteRelations().toIndexedSeq())}
    return used - defined


def _expression_names(analyzed) -> set[str]:
    def names(expression) -> set[str]:
        found = {expression.getClass().getSimpleName()}
        for child in _each(expression.children().toIndexedSeq()):
            found |= names(child)
        return found

    return set().union(*[names(e) for plan in _plans(analyzed) for e in _each(plan.expressions().toIndexedSeq())])


def describe_tables(session: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Columns of the session's tables as rows (table_name, column_no, column_name, data_type)."""
    names = sorted(t.name for t in session.catalog.listTables()) if names is None else names
    rows = [(n, i, f.name, f.dataType.simpleString())
            for n in names for i, f in enumerate(session.table(n).schema.fields)]
    return session.createDataFrame(rows, "table_name string, column_no int, column_name string, data_type string")


def register_chunk_function(session: SparkSession) -> None:
    """Make `chunk_words(text, size, overlap)` a SQL table function; Catalyst expands it in place."""
    session.sql(CHUNK_FUNCTION)


# `transform(array(x), ...)[0]` names the word array, so that it is built once per text.
CHUNK_FUNCTION = r"""
CREATE OR REPLACE TEMPORARY FUNCTION chunk_words(body STRING, size INT, overlap INT)
RETURNS TABLE(chunk_no INT, chunk STRING)
RETURN SELECT * FROM posexplode(
  transform(array(regexp_extract_all(body, '(\\S+\\s*)', 1)), tokens ->
    CASE WHEN size(tokens) = 0 THEN array()
         ELSE transform(
           sequence(0, CAST(greatest(ceil((size(tokens) - overlap) / (size - overlap)), 1) AS INT) - 1),
           i -> regexp_replace(array_join(slice(tokens, i * (size - overlap) + 1, size), ''), '\\s+$', ''))
    END)[0])
"""
