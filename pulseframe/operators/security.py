"""Row ownership, ad-hoc SQL over secured views, and audit rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tracking import MAX_PAGE, flagged


def sees_everything(user: str | None, roles: Sequence[str] = ()) -> bool:
    """A blank user or the role admin (any case, exact word) is not filtered."""
    return not (user and user.strip()) or any(str(x).strip().lower() == "admin" for x in roles)


def secured(df: DataFrame, user: str | None, roles: Sequence[str] = (), owner: str = "owner_id") -> DataFrame:
    """Only the user's own rows; applied to base tables, so no query text can escape it."""
    return df if sees_everything(user, roles) else df.filter(F.col(owner) == user)


def secured_children(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Rows of a child table whose parent is visible."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def secure_tables(t: dict[str, DataFrame], user: str | None, roles: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Apply ownership to experiments and let runs, metrics and alerts inherit it."""
    if sees_everything(user, roles):
        return t
    e = secured(t["experiment"], user, roles)
    r = secured_children(t["run"], e, "experiment_id")
    return {**t, "experiment": e, "run": r, "metric": secured_children(t["metric"], r, "run_id"), "alert": secured_children(t["alert"], r, "run_id")}


# Functions an ad-hoc query may call; everything else (reflection, files, session state, user code) is refused.
ALLOWED_FUNCTIONS = frozenset("""
abs any_value approx_count_distinct array_agg avg bool_and bool_or bround case ceil ceiling char_length coalesce concat concat_ws contains corr
count count_if date date_add date_diff date_format date_sub date_trunc datediff day dayofmonth dense_rank endswith exp extract first first_value floor
get_json_object greatest hour if ifnull iff instr isnan isnotnull isnull lag last last_value lead least left length ln log lower ltrim max max_by mean median
min min_by minute mod month ntile nullif nvl percent_rank percentile percentile_approx pow power quarter rank replace right round row_number rtrim
second sign split sqrt startswith std stddev stddev_pop stddev_samp struct substr substring sum timestamp to_date to_timestamp trim trunc unix_timestamp upper
var_pop var_samp variance weekday year
""".split())
# Ways to name a table or function by an expression, or to bring in rows that are not in a secured view.
_REFUSED_NODES = ("TableValued", "UnresolvedIdentifier", "WithUnresolvedIdentifier", "Script", "UnresolvedFile", "Command", "Insert", "Create", "Drop")


class NotAllowed(ValueError):
    """The query names something outside the allow-lists."""


def _nodes(plan):
    """All plan and expression nodes of a parsed query, each with the names of the common table expressions in its scope.

    A WITH names its relations for its own body and for its later relations only, in a subquery
    as on top; a name that it defines is a plain table name everywhere else.
    """
    todo, seen = [(plan, frozenset())], 0
    while todo:
        node, scope = todo.pop()
        seen += 1
        if seen > 20_000:
            raise NotAllowed("the query is too long")
        yield node, scope
        if node.getClass().getSimpleName() == "UnresolvedWith":
            rel, inner, recursive = node.cteRelations(), scope, node.allowRecursion()
            for i in range(rel.size()):
                outer, inner = inner, inner | {rel.apply(i)._1().lower()}
                todo.append((rel.apply(i)._2(), inner if recursive else outer))
            todo.append((node.child(), inner))
            continue
        lists = [node.children()]
        if hasattr_java(node, "expressions"):
            lists += [node.expressions(), node.innerChildren()]
        for found in lists:
            todo += [(found.apply(i), scope) for i in range(found.size())]
        if hasattr_java(node, "plan") and not hasattr_java(node, "expressions"):
            todo.append((node.plan(), scope))


_METHODS: dict[tuple[str, str], bool] = {}


def hasattr_java(node, method: str) -> bool:
    """Whether the node's class has the method without parameters; looked up once per class."""
    key = (node.getClass().getName(), method)
    if key not in _METHODS:
        _METHODS[key] = any(m.getName() == method and m.getParameterCount() == 0 for m in node.getClass().getMethods())
    return _METHODS[key]


def check_query(spark: SparkSession, sql: str, tables: Sequence[str]) -> None:
    """Refuse a query that reads anything but `tables` and the CTEs in scope, or calls a function that is not listed.

    The text is parsed by Spark, not run; the names are taken from the parsed plan. Names are held
    to be equal in any case, so the session that runs the query must not tell cases apart.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    known = {t.lower() for t in tables}
    for n, scope in _nodes(plan):
        kind = n.getClass().getSimpleName()
        if any(word in kind for word in _REFUSED_NODES):
            raise NotAllowed(f"{kind} is not allowed")
        if kind == "UnresolvedRelation":
            parts = n.multipartIdentifier()
            if parts.size() != 1 or parts.apply(0).lower() not in known | scope:
                raise NotAllowed(f"no table {n.tableName()}")
        if kind == "UnresolvedFunction":
            parts = n.nameParts()
            if parts.size() != 1 or parts.apply(0).lower() not in ALLOWED_FUNCTIONS:
                raise NotAllowed(f"no function {parts.mkString('.')}")


def ad_hoc(
    spark: SparkSession,
    sql: str,
    tables: Callable[[SparkSession], dict[str, DataFrame]],
    user: str | None = None,
    roles: Sequence[str] = (),
    args: dict | list | None = None,
    cap: int = MAX_PAGE,
) -> DataFrame:
    """One SELECT over the secured views, at most `cap` rows with a flag `truncated`.

    Spark parses the text first; tables and functions outside the allow-lists are refused before
    anything is resolved or run (NotAllowed). The text is then embedded as a subquery in a fresh
    session, so anything but one query fails to parse, and files cannot be named as tables.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    own.conf.set("spark.sql.caseSensitive", "false")
    own.conf.set("spark.sql.legacy.ctePrecedencePolicy", "CORRECTED")
    views = secure_tables(tables(own), user, roles)
    text = sql.strip().rstrip(";")
    check_query(own, f"SELECT * FROM (\n{text}\n)", list(views))
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    head = own.sql(f"SELECT * FROM (\n{text}\n) LIMIT {int(cap) + 1}", args=args)
    return flagged(head, int(cap))


def audit_row(result: DataFrame, user: str, source: str, params: dict[str, object], status: str = "ok") -> DataFrame:
    """One row describing a query or a search and when it was asked.

    `audit_id` is new for every row; `query_id` is a hash of what was asked, the same each time.
    """
    text = "|".join(f"{k}={v}" for k, v in sorted(params.items()))
    ident = F.substring(F.sha2(F.concat_ws(":", F.lit(user), F.lit(source), F.lit(text)), 256), 1, 32)
    return result.agg(F.count("*").alias("row_count")).select(
        F.lit(uuid.uuid4().hex).alias("audit_id"), F.current_timestamp().alias("recorded_at"), ident.alias("query_id"), F.lit(user).alias("user"), F.lit(source).alias("source"),
        F.lit(text).alias("params"), "row_count", F.lit(status).alias("status"),
    )


def append_audit(row: DataFrame, path: str) -> None:
    row.write.mode("append").json(path)


def audited(run: Callable[[], DataFrame], path: str, user: str, source: str, params: dict[str, object]) -> DataFrame:
    """The result of `run`, after one audit row about it was appended; a refused or failed query leaves a row too."""
    try:
        out = run()
        append_audit(audit_row(out, user, source, params), path)
        return out
    except Exception as e:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            status = "rejected" if isinstance(e, NotAllowed) else "failed"
            append_audit(audit_row(spark.range(0), user, source, params, status), path)
        raise
