"""The factor-expression language: trees, canonical forms, similarity, and compilation to Columns.

Syntax is that of Python expressions: names, numbers, calls, + - * / ** and signs. The compiler turns
an expression into nested window Columns; Catalyst plans the shuffles.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.functions import rolling as R

# The operator names that count as translatable, and the fields.
LISTED = ["Rank", "CSRank", "Ref", "Delta", "Mean", "Std", "Corr", "Correlation", "Sum", "Max", "Min", "Abs", "Log", "Sign", "Delay", "Ts_Mean", "Ts_Std", "Greater", "Less", "If", "Divide", "Div", "Add", "Sub", "Mul", "Neg", "Pow"]
FIELDS = ["close", "open", "high", "low", "volume", "amount", "vwap"]
DOLLAR_FIELDS = ["close", "open", "high", "low", "volume", "amount"]
WINDOWS = [1, 5, 10, 20, 60, 120, 240]

COMMUTES = {"corr", "mul", "max", "min", "add"}
SETTLES = {"rank", "csrank", "abs", "sign"}
FIELD, CONST = "@", "#"
BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "div", ast.Pow: "pow"}
SAME = {"delay": "ref", "ts_mean": "mean", "ts_std": "std", "correlation": "corr", "divide": "div"}


@dataclass(frozen=True)
class Node:
    """An operator with its arguments in order; leaves hold a field name or a number."""

    op: str
    args: tuple = ()

    @property
    def params(self) -> tuple:
        if self.op in (FIELD, CONST):
            return self.args
        return tuple(a.args[0] for a in self.args if a.op == CONST) if self.op not in BINARY.values() else ()

    @property
    def kids(self) -> tuple[Node, ...]:
        if self.op in (FIELD, CONST):
            return ()
        return tuple(a for a in self.args if a.op != CONST or self.op in BINARY.values())

    @property
    def size(self) -> int:
        return 1 + len(self.params) + sum(k.size for k in self.kids)


def parse(text: str) -> Node:
    """The tree of an expression; ValueError for anything outside the grammar."""
    try:
        body = ast.parse(text.replace("$", "").replace("|", "").strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {text!r}") from e
    return _node(body)


def _node(x: ast.AST) -> Node:
    match x:
        case ast.Name(id=name):
            return Node(FIELD, (name.lower(),))
        case ast.Constant(value=v) if isinstance(v, (int, float)) and not isinstance(v, bool):
            return Node(CONST, (float(v),))
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=v)) if isinstance(v, (int, float)) and not isinstance(v, bool):
            return Node(CONST, (-float(v),))
        case ast.UnaryOp(op=ast.USub(), operand=a):
            return Node("neg", (_node(a),))
        case ast.UnaryOp(op=ast.UAdd(), operand=a):
            return _node(a)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in BINARY:
            return Node(BINARY[type(op)], (_node(a), _node(b)))
        case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if not any(isinstance(a, ast.Starred) for a in args):
            return Node(name.lower(), tuple(map(_node, args)))
    raise ValueError(f"not allowed in an expression: {ast.dump(x)[:60]}")


def text_of(n: Node, window: Callable[[object], str] = repr) -> str:
    """The tree as an S-expression: the operator, its numbers, its subtrees."""
    if n.op == FIELD:
        return f"{n.op}{n.args[0]}"
    return f"({' '.join([n.op, *map(window, n.params), *(text_of(k, window) for k in n.kids)])})"


def canonical(n: Node) -> Node:
    """Repeated settling operators fold into one; arguments of commuting ones are sorted."""
    if n.op in (FIELD, CONST):
        return n
    args = tuple(map(canonical, n.args))
    if n.op in SETTLES and len(args) == 1 and args[0].op == n.op:
        return args[0]
    if n.op in COMMUTES:
        kept = [a for a in args if a in Node(n.op, args).kids]
        args = tuple(sorted(kept, key=text_of)) + tuple(a for a in args if a not in kept)
    return Node(n.op, args)


def serialize(n: Node) -> str:
    return text_of(canonical(n))


def window_bucket(v: float) -> int:
    """The nearest of the usual windows; halfway goes up."""
    return next((w for w, up in zip(WINDOWS, WINDOWS[1:], strict=False) if v < (w + up) / 2), WINDOWS[-1])


def bucket_of(v: Column) -> Column:
    """window_bucket as a Column."""
    steps = list(zip(WINDOWS, WINDOWS[1:], strict=False))
    return F.coalesce(*(F.when(v < (w + up) / 2, w) for w, up in steps), F.when(v.isNotNull(), WINDOWS[-1])).cast("int")


def expr_hash(expr: Node | str) -> str:
    n = canonical(parse(expr) if isinstance(expr, str) else expr)
    return hashlib.sha256(text_of(n, lambda p: str(window_bucket(float(p)))).encode()).hexdigest()[:16]


def _walk(n: Node) -> Iterable[Node]:
    yield n
    for k in n.kids:
        yield from _walk(k)


def _aligned(a: Node, b: Node) -> float:
    if a.op != b.op or (a.op == FIELD and a.args != b.args) or len(a.kids) != len(b.kids):
        return 0.0
    if a.op == FIELD:
        return 1.0
    return 1.0 + (len(a.params) if a.params == b.params else 0) + sum(map(_aligned, a.kids, b.kids))


def subtree_sizes(n: Node) -> dict[str, int]:
    """The canonical forms of all subtrees, with the size of the largest of each."""
    out: dict[str, int] = {}
    for x in _walk(n):
        key = serialize(x)
        out[key] = max(out.get(key, 0), x.size)
    return out


def similarity(a: Node, b: Node) -> float:
    """1 for equal canonical forms; else the larger of the share of the largest common subtree and of nodes that match from the top."""
    if serialize(a) == serialize(b):
        return 1.0
    sizes = subtree_sizes(b)
    common = max((min(size, sizes.get(key, 0)) for key, size in subtree_sizes(a).items()), default=0)
    return max(2 * common / (a.size + b.size), _aligned(canonical(a), canonical(b)) / max(a.size, b.size))


def most_similar(text: str, corpus: Iterable[str]) -> float:
    """Against all that parse; 0 if none does. A probe that doesn't parse raises."""
    probe, best = parse(text), 0.0
    for other in corpus:
        try:
            best = max(best, similarity(probe, parse(other)))
        except ValueError:
            continue
    return best


def complexity(n: Node) -> dict[str, int]:
    """sl: size with parameters; pc: numbers; fc: distinct fields."""
    nodes = list(_walk(n))
    return {"sl": n.size, "pc": sum(1 if x.op == CONST else len(x.params) for x in nodes if x.op != FIELD), "fc": len({x.args[0] for x in nodes if x.op == FIELD})}


def is_listed(text: str) -> bool:
    return set(re.findall(r"([A-Za-z_]\w*)\s*\(", text)) <= set(LISTED)


def to_plain(text: str) -> str:
    return re.sub(r"\$([A-Za-z_]\w*)", lambda m: m[1].lower(), text)


def to_dollar(text: str) -> str | None:
    """None where an operator isn't listed."""
    return re.sub(rf"(?<![$\w])({'|'.join(DOLLAR_FIELDS)})\b", r"$\1", text) if is_listed(text) else None


def translation(text: str, dialect: str) -> dict:
    """translatable, and the text with $ fields where it is in the plain dialect and translatable."""
    listed = is_listed(text)
    return {"translatable": listed, "alt_text": to_dollar(text) if listed and dialect == "repro_polars" else None, "operators": sorted(LISTED)}


def _truth(x: Column) -> Column:
    return x.cast("double")


ELEMENTWISE: dict[str, Callable] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": R.divided,
    "pow": F.pow,
    "neg": lambda a: -a,
    "abs": F.abs,
    "log": R.logarithm,
    "sign": F.signum,
    "greater": lambda a, b: _truth(a > b),
    "less": lambda a, b: _truth(a < b),
    "if": lambda c, a, b: F.when(c.isNotNull(), F.when(c != 0, a).otherwise(b)),
    "rank": R.rank,
    "csrank": R.rank_share,
    "cszscore": R.standard_score,
}
WINDOWED: dict[str, Callable] = {"ref": R.lagged, "delta": R.change, "mean": R.mean, "std": R.deviation, "sum": R.total, "max": R.highest, "min": R.lowest, "median": R.median, "ema": R.smoothed, "corr": R.correlation}


def check(n: Node) -> None:
    """ValueError for what doesn't compile; needs no session."""
    op = SAME.get(n.op, n.op)
    if op == FIELD and n.args[0] not in FIELDS:
        raise ValueError(f"unknown field {n.args[0]}")
    if op in (FIELD, CONST):
        return
    arity = {"corr": 3, "if": 3, "neg": 1, "abs": 1, "log": 1, "sign": 1, "rank": 1, "csrank": 1, "cszscore": 1}.get(op, 2)
    if op not in ELEMENTWISE and op not in WINDOWED:
        raise ValueError(f"unknown operator {n.op}")
    if len(n.args) != arity:
        raise ValueError(f"{n.op} takes {arity} arguments")
    if op in WINDOWED and (n.args[-1].op != CONST or n.args[-1].args[0] != int(n.args[-1].args[0]) or n.args[-1].args[0] < 1):
        raise ValueError(f"the window of {n.op} must be a whole number from 1 on")
    for x in n.args if op in ELEMENTWISE else n.args[:-1]:
        check(x)


def compile_node(n: Node) -> Column:
    """A Column over a panel (trade_date, ts_code and fields); of what passes check."""
    op = SAME.get(n.op, n.op)
    if op == FIELD:
        return F.col("amount") / F.nullif(F.col("volume"), F.lit(0.0)) if n.args[0] == "vwap" else F.col(n.args[0])
    if op == CONST:
        return F.lit(n.args[0])
    if op in ELEMENTWISE:
        return ELEMENTWISE[op](*map(compile_node, n.args))
    return WINDOWED[op](*map(compile_node, n.args[:-1]), int(n.args[-1].args[0]))


def compiled(text: str) -> Column:
    n = parse(text)
    check(n)
    return compile_node(n)


def validate(text: str) -> dict:
    """valid, errors, warnings of an expression, without running it."""
    try:
        check(parse(text))
    except ValueError as e:
        return {"valid": False, "errors": [str(e)], "warnings": []}
    return {"valid": True, "errors": [], "warnings": [] if is_listed(text) else ["uses operators that aren't translatable"]}
