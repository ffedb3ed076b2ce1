"""What a SQL text names and does, read from Spark's own plans without running anything."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Expressions and operators that leave the query engine, by class.
LEAVING = ("CallMethodViaReflection", "TryReflect", "ScriptTransformation")
LEAVING_FUNCTIONS = ("reflect", "java_method", "try_reflect")
# Leaves of a parsed plan that read nothing from storage.
FREE_LEAVES = ("OneRowRelation", "UnresolvedInlineTable", "ResolvedInlineTable", "LocalRelation")
FREE_TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack")


def items(sequence) -> Iterator:
    return (sequence.apply(i) for i in range(sequence.size()))


def class_name(node) -> str:
    return node.getClass().getName().rsplit(".", 1)[-1].removesuffix("$")


def walk(plan) -> Iterator[tuple[str, object]]:
    """``(kind, node)`` of all plan nodes and expressions, those of subqueries and WITH included."""
    todo = [("plan", plan)]
    while todo:
        kind, node = todo.pop()
        yield kind, node
        todo += [(kind, child) for child in items(node.children().toSeq())]
        if kind == "plan":
            todo += [("expression", e) for e in items(node.expressions().toSeq())]
            if class_name(node) == "UnresolvedWith":
                todo += [("plan", relation._2()) for relation in items(node.cteRelations().toSeq())]
            elif class_name(node) == "WithCTE":
                todo += [("plan", definition) for definition in items(node.cteDefs().toSeq())]
        elif holds_plan(node):
            todo.append(("plan", node.plan()))


def holds_plan(expression) -> bool:
    """Whether an expression is a subquery."""
    kind = expression.getClass()
    while kind is not None:
        if kind.getName().endswith((".PlanExpression", ".SubqueryExpression")):
            return True
        kind = kind.getSuperclass()
    return False


def parsed(spark: SparkSession, sql: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def refusal(plan, names: set[str]) -> str | None:
    """Why a parsed text may not be analysed: ``escape_hatch``, ``unknown_source``, or None.

    A relation has to be one of ``names`` (lower case, dotted) or a WITH name of
    the text itself. Nothing is resolved, so no file is looked at.
    """
    found = list(walk(plan))
    own = {
        relation._1().lower()
        for kind, node in found
        if kind == "plan" and class_name(node) == "UnresolvedWith"
        for relation in items(node.cteRelations().toSeq())
    }
    for kind, node in found:
        name = class_name(node)
        if name in LEAVING:
            return "escape_hatch"
        if name == "UnresolvedFunction" and list(items(node.nameParts()))[-1].lower() in LEAVING_FUNCTIONS:
            return "escape_hatch"
    for kind, node in found:
        if kind != "plan" or node.children().toSeq().size():
            continue
        name = class_name(node)
        if name == "UnresolvedRelation":
            parts = [part.lower() for part in items(node.multipartIdentifier())]
            if ".".join(parts) not in names and not (len(parts) == 1 and parts[0] in own):
                return "unknown_source"
        elif name == "UnresolvedTableValuedFunction":
            if ".".join(items(node.name())).lower() not in FREE_TABLE_FUNCTIONS:
                return "unknown_source"
        elif name not in FREE_LEAVES:
            return "unknown_source"
    return None


def leaves_engine(df: DataFrame) -> bool:
    """Whether an analysed frame calls into the JVM or runs a command."""
    return any(class_name(node) in LEAVING for _, node in walk(df._jdf.queryExecution().analyzed()))


def physical_leaves(df: DataFrame) -> Iterator:
    """Leaves of the planned frame, below adaptive nodes, subqueries and caches, without any setting changed."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if class_name(plan) == "AdaptiveSparkPlanExec":
            todo.append(plan.initialPlan())
            continue
        subqueries = plan.subqueriesAll()
        todo += list(items(subqueries))
        leaves = plan.collectLeaves()
        for leaf in items(leaves):
            if class_name(leaf) == "AdaptiveSparkPlanExec":
                todo.append(leaf)
            elif class_name(leaf) == "InMemoryTableScanExec":
                todo.append(leaf.relation().cachedPlan())
            else:
                yield leaf
