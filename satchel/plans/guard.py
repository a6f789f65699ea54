"""Read-only SQL: text is parsed by the session's own parser, and only plans that read registered views with known functions pass."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

from pyspark.sql import DataFrame, SparkSession


class NotReadOnly(ValueError):
    """The statement is not a plain query over registered views."""


#: Plan nodes of statements that change or reveal something, of scripts, and of names that are only known later.
REFUSED = re.compile(r"Insert|Command|Create|Drop|Alter|Delete|Update|Merge|Explain|Set|Show|Describe|Cache|Truncate|Load|Repair|Refresh|Analyze|Use|Write|Replace|Call|Execute|Script|TableValuedFunction|Compound|Identifier|Variable|Stream")
ALLOWED_SETS = {"SetOperation"}
#: Expressions that hold a plan.
WITH_PLAN = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
#: Groups of built-in functions that compute from their arguments alone. What is in no group here (such as the calls of
#: methods, and what tells of files or the session) is refused.
GROUPS = frozenset(
    "agg_funcs array_funcs bitwise_funcs collection_funcs conditional_funcs conversion_funcs csv_funcs datetime_funcs date_funcs generator_funcs hash_funcs json_funcs lambda_funcs map_funcs math_funcs operator_funcs predicate_funcs string_funcs struct_funcs url_funcs variant_funcs window_funcs xml_funcs".split()
)


def _seq(sequence) -> Iterator:
    return (sequence.apply(i) for i in range(sequence.size()))


def _kind(node) -> str:
    return node.getClass().getSimpleName()


class _Check:
    def __init__(self, spark: SparkSession, views: Collection[str]):
        self.spark, self.views = spark, frozenset(v.lower() for v in views)
        self.registry = spark._jsparkSession.sessionState().functionRegistry()

    def plan(self, node, scope: frozenset[str]) -> None:
        """scope: names of common table expressions that hide views here."""
        kind = _kind(node)
        if kind == "UnresolvedWith":
            for entry in _seq(node.cteRelations()):
                name = entry._1().lower()
                self.plan(entry._2(), scope | {name} if node.allowRecursion() else scope)
                scope = scope | {name}
        elif kind == "UnresolvedRelation":
            parts = [p for p in _seq(node.multipartIdentifier())]
            if len(parts) > 1 or parts[0].lower() not in self.views | scope:
                raise NotReadOnly(f"only registered views may be read, not {'.'.join(parts)}")
        elif REFUSED.search(kind) and kind not in ALLOWED_SETS:
            raise NotReadOnly(f"only queries may be run, not {kind}")
        for expression in _seq(node.expressions()):
            self.expression(expression, scope)
        if kind == "Generate":
            self.expression(node.generator(), scope)
        for child in _seq(node.children()):
            self.plan(child, scope)
        if kind != "UnresolvedWith":
            for child in _seq(node.innerChildren()):
                if hasattr(child, "expressions"):
                    self.plan(child, scope)

    def expression(self, e, scope: frozenset[str]) -> None:
        kind = _kind(e)
        if kind == "UnresolvedFunction":
            self.function([p for p in _seq(e.nameParts())])
        elif kind == "UnresolvedGenerator":
            self.function([e.name().funcName()])
        elif "Identifier" in kind:
            raise NotReadOnly(f"names must be written out, not {kind}")
        if kind in WITH_PLAN:
            self.plan(e.plan(), scope)
        for child in _seq(e.children()):
            self.expression(child, scope)

    def function(self, parts: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        found = self.registry.lookupFunction(jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(parts[-1].lower())) if len(parts) == 1 else None
        if found is None or found.isEmpty() or found.get().getSource() != "built-in" or found.get().getGroup() not in GROUPS:
            raise NotReadOnly(f"the function {'.'.join(parts)} may not be used")


def registered_views(spark: SparkSession) -> list[str]:
    """The session's temporary views."""
    return [t.name for t in spark.catalog.listTables() if t.isTemporary]


def check(spark: SparkSession, query: str, views: Collection[str] | None = None) -> None:
    """Raises NotReadOnly unless the text is one SELECT, WITH, VALUES or FROM query over ``views`` (all registered ones by
    default) and its own common table expressions, with functions of GROUPS."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as error:
        raise NotReadOnly(f"not one valid statement: {str(error).splitlines()[0][:200]}") from None
    _Check(spark, registered_views(spark) if views is None else views).plan(plan, frozenset())


def guarded(spark: SparkSession, query: str, limit: int = 100, args: dict | None = None, views: Collection[str] | None = None) -> DataFrame:
    """The first ``limit`` rows of a checked query; values come as named parameters."""
    check(spark, query, views)
    return spark.sql(query, args=args or {}).limit(limit)
