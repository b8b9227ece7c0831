"""Arithmetic text over columns -> Column, restricted to operators (no calls, no attributes)."""

from __future__ import annotations

import ast
import io
import re
import tokenize

from pyspark.sql import Column, functions as F

from tidemill.functions.scalars import floor_div, floor_mod
from tidemill.functions.types import ref

_BINARY = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b.cast("double")),
    ast.FloorDiv: floor_div,
    ast.Mod: floor_mod,
    ast.Pow: lambda a, b: F.pow(a, b),
}
_COMPARE = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


def _placeholders(text: str) -> tuple[str, dict[str, str]]:
    """Swap backticked names for plain identifiers, leaving string literals alone."""
    names: dict[str, str] = {}

    def swap(match):
        if match.group("name") is None:
            return match.group(0)
        token = f"quoted_name_{len(names)}_"
        names[token] = match.group("name")
        return token

    pattern = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`(?P<name>[^`]+)`"""
    return re.sub(pattern, swap, text), names


def _word_booleans(text: str) -> str:
    """``&`` and ``|`` bind like ``and`` / ``or``, ``~`` like ``not``."""
    words = {"&": " and ", "|": " or ", "~": " not "}
    tokens = tokenize.generate_tokens(io.StringIO(text).readline)
    return "".join(
        words.get(t.string, t.string + " ") for t in tokens if t.type not in (tokenize.NEWLINE, tokenize.NL)
    ).strip()


def column_expression(text: str, columns: list[str]) -> Column:
    """Compile ``text`` against the given column names; anything else is a ValueError."""
    plain, names = _placeholders(text.strip())
    try:
        tree = ast.parse(_word_booleans(plain), mode="eval").body
    except (SyntaxError, tokenize.TokenError) as error:
        raise ValueError(f"cannot read expression: {text}") from error

    def build(node) -> Column:
        if isinstance(node, ast.Name):
            name = names.get(node.id, node.id)
            if name not in columns:
                raise ValueError(f"unknown column in expression: {name}")
            return ref(name)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool)):
            return F.lit(node.value)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp):
            inner = build(node.operand)
            if isinstance(node.op, ast.USub):
                return -inner
            if isinstance(node.op, ast.UAdd):
                return inner
            if isinstance(node.op, ast.Not):
                return ~inner
        if isinstance(node, ast.BoolOp):
            parts = [build(v) for v in node.values]
            out = parts[0]
            for part in parts[1:]:
                out = out & part if isinstance(node.op, ast.And) else out | part
            return out
        if isinstance(node, ast.Compare):
            left, out = node.left, None
            for op, right in zip(node.ops, node.comparators):
                if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple)):
                    test = build(left).isin([build(v) for v in right.elts])
                    test = ~test if isinstance(op, ast.NotIn) else test
                elif type(op) in _COMPARE:
                    test = _COMPARE[type(op)](build(left), build(right))
                else:
                    raise ValueError(f"operator not allowed in expression: {text}")
                out = test if out is None else out & test
                left = right
            return out
        raise ValueError(f"only operators, names and literals are allowed: {text}")

    return build(tree)


def arithmetic_text(left: str, operator: str, right, right_is_column: bool = True) -> str:
    """Expression text for ``left operator right`` as the guided builder composes it."""
    tail = f"`{right}`" if right_is_column else str(right)
    return f"`{left}` {operator} {tail}"
