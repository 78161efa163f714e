"""What a lazy array will do: Spark's plan, and facts read from it."""

from __future__ import annotations

import re

from cellgrid.core import Array


def plan(x: Array, mode: str = "formatted") -> str:
    df = x.cells()
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def explain(x: Array, mode: str = "formatted") -> None:
    print(plan(x, mode))


def optimize(x: Array) -> str:
    """The optimised logical plan."""
    return x.cells()._jdf.queryExecution().optimizedPlan().toString()


simplify = optimize


def pushed_filters(x: Array) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan(x))


def read_schema(x: Array) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^\n]*)>", plan(x))


def counts(x: Array) -> dict[str, int]:
    """How often the physical plan has exchanges, joins, windows, aggregates and Python steps."""
    text = x.cells()._jdf.queryExecution().executedPlan().toString()
    return {name: len(re.findall(rf"\b{pattern}", text)) for name, pattern in {"exchange": "Exchange", "join": r"\w*Join", "window": "Window ", "aggregate": r"\w*Aggregate", "python": r"\w*(?:Arrow|Pandas|Python)\w*"}.items()}


def expr_table(x: Array) -> str:
    """The analysed logical plan, one node a line, with what is known of the array."""
    return f"{x!r}\n" + x.cells()._jdf.queryExecution().analyzed().toString()


expr_flow = pprint = expr_table


def transfer_bytes(x: Array) -> tuple[int, int]:
    """Least and most bytes that may move: nothing without an exchange, else Spark's size estimate for each."""
    size = int(str(x.cells()._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 0, size * counts(x)["exchange"]


def trace_rewrites(x: Array) -> dict[str, int]:
    """Catalyst's rules that changed the plan, with how often."""
    execution = x.cells()._jdf.queryExecution()
    execution.optimizedPlan()
    rules, out = execution.tracker().rules().iterator(), {}
    while rules.hasNext():
        pair = rules.next()
        if n := pair._2().numEffectiveInvocations():
            out[pair._1().rsplit(".", 1)[-1]] = int(n)
    return out


def to_svg(x: Array, side: int = 120) -> str:
    """A drawing of a matrix's blocks (higher dimensions: of their last two axes)."""
    rows, cols = (x.chunks[-2], x.chunks[-1]) if x.ndim > 1 else ((1,), x.chunks[-1] if x.ndim else (1,))
    h, w = max(1, sum(rows)), max(1, sum(cols))
    scale = side / max(h, w)
    at = lambda sizes: [0, *[sum(sizes[: k + 1]) for k in range(len(sizes))]]
    lines = [f'<line x1="0" y1="{y * scale:.1f}" x2="{w * scale:.1f}" y2="{y * scale:.1f}"/>' for y in at(rows)] + [f'<line x1="{c * scale:.1f}" y1="0" x2="{c * scale:.1f}" y2="{h * scale:.1f}"/>' for c in at(cols)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w * scale:.0f}" height="{h * scale:.0f}" stroke="black">{"".join(lines)}</svg>'
