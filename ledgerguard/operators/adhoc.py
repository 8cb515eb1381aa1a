"""Ad-hoc governed queries: SQL text of a user, run over the contract-scoped views and masked on the way out.

``governed_query`` takes the text of one SELECT with parameter markers (``:contract_id``, ``:as_of_date``) and:

1. refuses what is no query (commands are never run, only parsed) and what calls code outside of SQL;
2. resolves it over the published views only: each table restricted to rows of a contract (J7), or of the given
   contracts, without restricted columns (P1); parameters are bound as values, never as text;
3. classifies the output columns by the lineage of the resolved plan (M1). A plan that cannot be traced is refused,
   since nothing is known about its columns;
4. masks every row (M3): classified columns by tokens, other text by the detectors. Arrays, maps and structs are
   written as JSON text first, so that nothing in them passes unseen.

Nothing is run but the one masked job; a refusal costs no job at all.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerguard.operators import masking as M
from ledgerguard.operators.lineage import classify_output
from ledgerguard.operators.scope import contract_scope
from ledgerguard.sources.policy import DEFAULT, Policy

ANSWERED, REFUSED = "answered", "refused"
SESSION = "__session"

# Reasons of a refusal
COMMAND, NOT_PARSED, NOT_RESOLVED, UNTRACEABLE, FOREIGN_CODE, SAME_NAMES = (
    "command", "not_parsed", "not_resolved", "untraceable", "foreign_code", "same_names")

# Parsed operators that are no part of a query, by base class
_STATEMENTS = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")
_SCRIPTS = {"CompoundBody", "SingleStatement"}
# Expressions that run code other than Spark's own functions, or tell where data lies
_FOREIGN = {"CallMethodViaReflection", "TryReflect", "ScalaUDF", "PythonUDF", "PythonUDAF", "HiveSimpleUDF", "HiveGenericUDF", "InputFileName",
            "InputFileBlockStart", "InputFileBlockLength"}


class Refusal(Exception):
    def __init__(self, reason: str, detail: str = "") -> None:
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason, self.detail = reason, detail


@dataclass
class Governed:
    """What came of a query. ``rows`` are masked, ``vault`` holds their tokens; both are None after a refusal."""
    verdict: str
    reason: str | None = None
    entities: dict[str, str] = field(default_factory=dict)
    rows: DataFrame | None = None
    vault: DataFrame | None = None

    def shown(self, text_col: str, policy: Policy = DEFAULT) -> DataFrame:
        """M6 for the user's own eyes: tokens of a column back to values where the policy shows their type."""
        return M.unmask(self.rows, text_col, [], self.vault, session_col=SESSION, out_col=text_col, policy=policy)


def _items(scala) -> list:
    return [scala.apply(i) for i in range(scala.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _nodes(plan) -> Iterator:
    """All operators of a plan, those inside subqueries included."""
    yield plan
    for child in [*_items(plan.children()), *_items(plan.innerChildren())]:
        if hasattr(child, "children") and hasattr(child, "innerChildren"):
            yield from _nodes(child)


def _expressions(plan) -> Iterator:
    def down(expression) -> Iterator:
        yield expression
        for child in _items(expression.children()):
            yield from down(child)

    for node in _nodes(plan):
        for expression in _items(node.expressions()):
            yield from down(expression)


def check_query(spark: SparkSession, sql: str) -> None:
    """Refuse text that is not one query. The text is parsed, not run."""
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as error:  # the parser's own error class depends on the version
        raise Refusal(NOT_PARSED, type(error).__name__) from None
    classes = [spark._jvm.java.lang.Class.forName(name) for name in _STATEMENTS]
    for node in _nodes(parsed):
        if any(c.isInstance(node) for c in classes) or _name(node) in _SCRIPTS:
            raise Refusal(COMMAND, _name(node))


@contextmanager
def published(views: Mapping[str, DataFrame]):
    """The views under their names, for as long as a query is resolved."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name, df in views.items():
            df.sparkSession.catalog.dropTempView(name)


def resolve_query(views: Mapping[str, DataFrame], sql: str, args: Mapping[str, object], policy: Policy = DEFAULT) -> tuple[DataFrame, dict[str, str]]:
    """The query over the views, and the entity types of its columns. Raises ``Refusal``."""
    spark = next(iter(views.values())).sparkSession
    check_query(spark, sql)
    with published(views):
        try:
            df = spark.sql(sql, args=dict(args))
        except PySparkException as error:
            raise Refusal(NOT_RESOLVED, error.getCondition() or type(error).__name__) from None
        if len({c.lower() for c in df.columns}) < len(df.columns):
            raise Refusal(SAME_NAMES)
        foreign = {_name(e) for e in _expressions(df._jdf.queryExecution().analyzed())} & _FOREIGN
        if foreign:
            raise Refusal(FOREIGN_CODE, ", ".join(sorted(foreign)))
        types = classify_output(df, policy, tables=set(views))
    if types is None:
        raise Refusal(UNTRACEABLE)
    return df, types


def _as_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = ("array", "map", "struct", "variant")
    return df.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if t.startswith(nested) else F.col(f"`{c}`") for c, t in df.dtypes])


def governed_query(tables: Mapping[str, DataFrame], sql: str, args: Mapping[str, object] | None = None, contracts: DataFrame | None = None,
                   session: object = "adhoc", known_values: DataFrame | None = None, vault: DataFrame | None = None,
                   policy: Policy = DEFAULT) -> Governed:
    """Run one query over the scoped views of the eight tables. ``contracts`` (column ``contract_id``) limits what it
    may see; ``session`` is the session of its tokens, numbered in the order of the output's values, column by column."""
    views = contract_scope(dict(tables), contracts)
    try:
        df, types = resolve_query(views, sql, args or {}, policy)
    except Refusal as refusal:
        return Governed(REFUSED, refusal.reason)
    plain = _as_text(df).withColumn(SESSION, F.lit(session))
    m = M.mask_rows(plain, types, df.columns, df.columns, session_col=SESSION, known_values=known_values, vault=vault, policy=policy)
    return Governed(ANSWERED, None, types, m.cells, m.vault)


RECORD = ("query string, sql string, outcome string, sql_attempts int, sql_errors array<string>, row_count long, "
          "pii_columns map<string,string>, pii_masked_output map<string,int>, latency_ms long")


def run_governed(tables: Mapping[str, DataFrame], queries: Mapping[str, tuple[str, Mapping[str, object]]], out_dir: str,
                 contracts: DataFrame | None = None, known_values: DataFrame | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """Run queries (name -> text, parameters) one after another, write the masked rows of each below ``out_dir`` and
    return a record of each run (L1): the text (masked as text of machines is), the outcome, rows and masked values as
    counted while they were written, entity types by column, and the time it took. One pass over each result."""
    spark = next(iter(tables.values())).sparkSession
    records = []
    for name, (sql, args) in queries.items():
        begin = time.monotonic()
        got = governed_query(tables, sql, args, contracts, session=name, known_values=known_values, policy=policy)
        row_count, masked = 0, {}
        if got.rows is not None:
            seen = Observation()
            found = [F.sum(F.coalesce(F.try_element_at(F.col("pii_counts"), F.lit(e)), F.lit(0))).alias(e) for e in policy.shown]
            got.rows.observe(seen, F.count(F.lit(1)).alias("__rows"), *found).drop(SESSION, "pii_counts").write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")
            metrics = dict(seen.get)
            row_count = metrics.pop("__rows")
            masked = {e: int(n) for e, n in metrics.items() if n}
        latency = int(1000 * (time.monotonic() - begin))
        records.append((name, sql, got.verdict, 1, [got.reason] if got.reason else [], row_count, got.entities, masked, latency))
    written = spark.createDataFrame(records, RECORD)
    clean = M.mask_text(written, "sql", ["query"], session_col="query", out_col="masked_sql", policy=policy.fast()).cells
    return clean.withColumn("sql", F.col("masked_sql")).select(*written.columns)
