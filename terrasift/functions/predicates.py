"""The predicate language of feature selections: {op: value} conditions compiled to Column expressions.

All comparisons but the four numeric ones and isnull look at the string form. A null is unequal to every value, so `ne`
and `not_in` keep it and the others drop it. `regex` searches case-insensitively. Numeric comparisons cast to double; a
value that isn't a number is an error under ANSI mode.
"""

from __future__ import annotations

import ast
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(column: Column | str, condition) -> Column:
    """The condition on one column; a bare value means equality of string forms."""
    c = F.col(column) if isinstance(column, str) else column
    if not isinstance(condition, Mapping):
        condition = {"eq": condition}
    if len(condition) != 1:
        raise ValueError("a condition has exactly one operator")
    ((op, v),) = condition.items()
    s = c.cast("string")
    compiled = {
        "eq": lambda: F.coalesce(s == str(v), F.lit(False)),
        "ne": lambda: F.coalesce(s != str(v), F.lit(True)),
        "in": lambda: F.coalesce(s.isin([str(x) for x in v]), F.lit(False)),
        "not_in": lambda: F.coalesce(~s.isin([str(x) for x in v]), F.lit(True)),
        "contains": lambda: F.coalesce(s.contains(str(v)), F.lit(False)),
        "icontains": lambda: F.coalesce(F.lower(s).contains(str(v).lower()), F.lit(False)),
        "startswith": lambda: F.coalesce(s.startswith(str(v)), F.lit(False)),
        "regex": lambda: F.coalesce(s.rlike("(?i)" + v), F.lit(False)),
        "isnull": lambda: c.isNull() if v else c.isNotNull(),
        "lt": lambda: c.cast("double") < v,
        "le": lambda: c.cast("double") <= v,
        "gt": lambda: c.cast("double") > v,
        "ge": lambda: c.cast("double") >= v,
    }
    if op not in compiled:
        raise ValueError(f"unknown operator {op!r}")
    return compiled[op]()


def select(df: DataFrame, conditions: Mapping | None = None, ids: list | None = None, id_column: str | None = None) -> DataFrame:
    """The rows that meet all conditions and, if ids are given, have one of them; asked-for ids that don't exist, and an
    empty selection, are errors. One pass over the input finds both."""
    if ids is not None:
        found = {str(r[0]) for r in df.select(F.col(id_column).cast("string")).filter(F.col(id_column).cast("string").isin([str(i) for i in ids])).distinct().collect()}
        if missing := sorted({str(i) for i in ids} - found):
            raise LookupError(f"no such ids: {', '.join(missing)}")
        df = df.filter(F.col(id_column).cast("string").isin([str(i) for i in ids]))
    for column, condition in (conditions or {}).items():
        df = df.filter(where(column, condition))
    if df.isEmpty():
        raise LookupError("nothing is selected")
    return df


def find(df: DataFrame, pattern: str, columns: list[str] | None = None, limit: int = 60) -> DataFrame:
    """Rows of which any attribute matches the pattern, with the names of those attributes; the feature is a top list of 60."""
    columns = columns or df.columns
    hits = F.filter(F.array(*(F.when(where(c, {"regex": pattern}), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return df.withColumn("matched", hits).filter(F.size("matched") > 0).orderBy(*df.columns[:1]).limit(limit)


def color_rule(rule: str) -> Column:
    """A whitelisted boolean expression over R, G, B, H, S, V and abs() as a Column; anything else is an error.

    R, G, B: columns of 0 to 255. H: 0 to 360, S and V: 0 to 100, derived from them.
    """
    r, g, b = (F.col(c).cast("double") for c in "RGB")
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = F.when(span == 0, 0.0).when(top == r, F.pmod((g - b) / span, F.lit(6.0))).when(top == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 60
    names = {"R": r, "G": g, "B": b, "H": hue, "S": F.when(top == 0, 0.0).otherwise(span / top * 100), "V": top / 255 * 100}
    comparisons = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}
    arithmetic = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__", ast.BitAnd: "__and__", ast.BitOr: "__or__"}

    def visit(n):
        if isinstance(n, ast.Expression):
            return visit(n.body)
        if isinstance(n, ast.Name) and n.id in names:
            return names[n.id]
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.BinOp) and type(n.op) in arithmetic:
            return getattr(visit(n.left), arithmetic[type(n.op)])(visit(n.right))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -visit(n.operand)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.Not, ast.Invert)):
            return ~visit(n.operand)
        if isinstance(n, ast.BoolOp):
            out = visit(n.values[0])
            for v in n.values[1:]:
                out = out & visit(v) if isinstance(n.op, ast.And) else out | visit(v)
            return out
        if isinstance(n, ast.Compare):
            out, left = None, visit(n.left)
            for op, right in zip(n.ops, n.comparators, strict=True):
                if type(op) not in comparisons:
                    break
                right = visit(right)
                one = getattr(left, comparisons[type(op)])(right)
                out, left = one if out is None else out & one, right
            else:
                return out
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "abs" and len(n.args) == 1 and not n.keywords:
            return F.abs(visit(n.args[0]))
        raise ValueError(f"not allowed in a colour rule: {ast.dump(n)[:60]}")

    try:
        tree = ast.parse(rule, mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not a colour rule: {rule}") from e
    return visit(tree)
