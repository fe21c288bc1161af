"""Evaluation of expressions on single rows, and the step machine of ``scan``: for folds whose state follows the rows.

Values follow the language rather than SQL: null is false, sums with text concatenate, what is missing is null.
"""

from __future__ import annotations

import decimal
import math
import time
from collections.abc import Mapping
from typing import Any

from ..errors import CompileError, UnknownFunction
from ..lang import ast as A


def truth(x: Any) -> bool:
    return not (x is None or x is False or x == "" or isinstance(x, (int, float)) and (x == 0 or x != x))


def _number(x: Any) -> float | int | None:
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (int, float)):
        return x
    if isinstance(x, str):
        try:
            return float(x)
        except ValueError:
            return None
    if isinstance(x, decimal.Decimal):
        return float(x)
    return x.timestamp() if hasattr(x, "timestamp") else None


def _arithmetic(op: str, a: Any, b: Any) -> Any:
    if op == "+" and (isinstance(a, str) or isinstance(b, str)):
        return None if a is None or b is None else f"{a}{b}"
    a, b = _number(a), _number(b)
    if a is None or b is None:
        return None
    if op in "/%":
        if b == 0:
            return None
        return a / b if op == "/" else math.fmod(a, b) if isinstance(a, float) or isinstance(b, float) else int(math.fmod(a, b))
    return a + b if op == "+" else a - b if op == "-" else a * b


def _compare(op: str, a: Any, b: Any) -> bool:
    if not (isinstance(a, str) and isinstance(b, str)):
        a, b = _number(a), _number(b)
    if a is None or b is None:
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _same(a: Any, b: Any) -> bool:
    plain = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return a == b and (type(a) is type(b) or plain(a) and plain(b))


def _fold(op: str, empty: int):
    def f(*args):
        if not args:
            return empty
        out = _number(args[0])
        for x in args[1:]:
            out = _arithmetic(op, out, x)
        return out

    return f


def _unless_null(f):
    return lambda *a: None if any(x is None for x in a) else f(*a)


def _numeric(f):
    """``f`` of numbers; null where one can't be coerced, and NaN where ``f`` has no value."""

    def g(*args):
        args = [_number(x) for x in args]
        if any(x is None for x in args):
            return None
        try:
            return f(*args)
        except ValueError:
            return math.nan
        except (OverflowError, ZeroDivisionError):
            return math.inf

    return g


def _power(a: float, b: float) -> float:
    return math.inf if a == 0 and b < 0 else math.pow(a, b)


def _equal(a: Any, b: Any) -> bool:
    """Equality after coercion, as ``eq`` has it; null equals null."""
    if a is None or b is None or type(a) is type(b):
        return a == b
    return _number(a) == _number(b)


def _extreme(pick):
    def f(*args):
        if len(args) < 2 or all(type(x) is type(args[0]) for x in args):
            return pick((x for x in args if x is not None), default=None)
        return pick((float(x) for x in map(_number, args) if x is not None), default=None)

    return f


def _text(x: Any) -> str:
    return str(x).lower() if isinstance(x, bool) else str(x)


def _length(x: Any) -> int:
    return len(x) if isinstance(x, (list, Mapping)) else len(_text(x))


def _rounded(x: Any, digits: int = 0) -> Any:
    """Halves go away from zero."""
    if isinstance(x, int) or math.isinf(x) or math.isnan(x):
        return x
    unit = decimal.Decimal(1).scaleb(-digits)
    return float(decimal.Decimal(repr(x)).quantize(unit, decimal.ROUND_HALF_UP))


#: Parts of the date patterns that ``scan`` knows; longer ones come first.
DATE_PARTS = {"yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S"}


def _format_date(at: Any, pattern: str) -> str:
    out = pattern
    for part, directive in DATE_PARTS.items():
        out = out.replace(part, directive)
    return at.strftime(out)


FUNCTIONS = {
    "add": _fold("+", 0), "sub": _fold("-", 0), "mul": _fold("*", 1), "div": _fold("/", 1),
    "mod": lambda a, b: _arithmetic("%", a, b), "pow": _numeric(_power), "neg": _numeric(lambda a: -a), "abs": _numeric(abs),
    "eq": _equal, "ne": lambda a, b: not _equal(a, b), "lt": lambda a, b: _compare("<", a, b), "le": lambda a, b: _compare("<=", a, b),
    "gt": lambda a, b: _compare(">", a, b), "ge": lambda a, b: _compare(">=", a, b),
    "min": _extreme(min), "max": _extreme(max),
    "and": lambda *a: all(map(truth, a)), "or": lambda *a: any(map(truth, a)), "not": lambda a: not truth(a),
    "exp": lambda *a: _numeric(math.exp)(*a) if len(a) == 1 and isinstance(a[0], (int, float)) and not isinstance(a[0], bool) else None, "pi": lambda: math.pi,
    "length": _unless_null(_length), "array_length": _unless_null(_length), "now": time.time, "format_date": _unless_null(_format_date),
    "if": lambda test, yes, no=None: yes if truth(test) else no,
    "to_upper": _unless_null(lambda a: _text(a).upper()), "to_lower": _unless_null(lambda a: _text(a).lower()), "exists": lambda a: a is not None,
    "coalesce": lambda *a: next((x for x in a if x is not None), None), "round": lambda a, digits=0: _numeric(lambda x: _rounded(x, digits))(a),
    "floor": _numeric(math.floor), "ceil": _numeric(math.ceil), "sqrt": _numeric(math.sqrt), "epoch": _numeric(math.floor),
}


class Evaluator:
    def __init__(self, lookups: Mapping[str, Any] | None = None):
        self.lookups = lookups or {}

    def eval(self, e: A.Expr, row: Mapping[str, Any]) -> Any:
        kind = type(e)
        if kind is A.Lit:
            return e.value
        if kind is A.Name:
            low = e.name.lower()
            return self.lookups[low] if low in self.lookups else row.get(e.name)
        if kind is A.Field:
            base = self.eval(e.base, row)
            if isinstance(base, Mapping):
                return base.get(e.name)
            return len(base) if e.name == "length" and isinstance(base, (list, str)) else getattr(base, e.name, None) if hasattr(base, "_fields") else None
        if kind is A.Index:
            base, at = self.eval(e.base, row), self.eval(e.at, row)
            return base[at] if isinstance(base, list) and isinstance(at, int) and 0 <= at < len(base) else None
        if kind is A.Binary:
            a = self.eval(e.left, row)
            if e.op == "&&":
                return self.eval(e.right, row) if truth(a) else a
            if e.op == "||":
                return a if truth(a) else self.eval(e.right, row)
            b = self.eval(e.right, row)
            if e.op in ("==", "!="):
                return _same(a, b) == (e.op == "==")
            if e.op in ("<", ">", "<=", ">="):
                return _compare(e.op, a, b)
            return _arithmetic(e.op, a, b)
        if kind is A.Unary:
            x = self.eval(e.value, row)
            return not truth(x) if e.op == "!" else _arithmetic("*", x, 1 if e.op == "+" else -1)
        if kind is A.Choice:
            return self.eval(e.yes if truth(self.eval(e.test, row)) else e.no, row)
        if kind is A.IsNull:
            return (self.eval(e.value, row) is None) != e.negated
        if kind is A.InList:
            x = self.eval(e.value, row)
            return any(x == self.eval(o, row) for o in e.options) != e.negated
        if kind is A.ArrayLit:
            return [self.eval(x, row) for x in e.items]
        if kind is A.ObjectLit:
            return self.members(e.items, row)
        if kind is A.Method:
            return self.method(e, row)
        if kind is A.Call:
            if e.name.lower() not in FUNCTIONS:
                raise UnknownFunction(f"unknown function {e.name!r}")
            return FUNCTIONS[e.name.lower()](*[self.eval(a, row) for a in e.args])
        raise CompileError(f"{kind.__name__} has no meaning here")

    def method(self, e: A.Method, row: Mapping[str, Any]) -> Any:
        """``map``, ``filter`` and ``reduce`` of arrays."""
        base = self.eval(e.base, row)
        if e.name not in ("map", "filter", "reduce") or not e.args or not isinstance(e.args[0], A.Lambda):
            raise UnknownFunction(f"unknown method {e.name!r}")
        if not isinstance(base, list):
            return None
        f = e.args[0]
        call = lambda *values: self.eval(f.body, {**row, **dict(zip(f.params, values, strict=False))})
        if e.name == "map":
            return [call(x) for x in base]
        if e.name == "filter":
            return [x for x in base if truth(call(x))]
        out = self.eval(e.args[1], row)
        for x in base:
            out = call(out, x)
        return out

    def members(self, items: tuple[A.Item, ...], row: Mapping[str, Any]) -> dict[str, Any]:
        out: dict[str, Any] = {}
        for it in items:
            if isinstance(it, A.SpreadAll):
                out |= row
            elif isinstance(it, A.Spread):
                out |= self.eval(it.value, row) or {}
        for it in items:
            if isinstance(it, A.Prop):
                out[it.key] = self.eval(it.value, row)
        for it in items:
            if isinstance(it, A.Exclude):
                out.pop(it.key, None)
        return out


class ScanMachine:
    """The steps' slots. A row is offered to the last step first: a step takes over the slot of the step before if its
    test holds, else keeps its own; the first step opens a match. ``step.var`` is state; other names are the row's, and
    assigning one changes the row for the steps that look at it later."""

    def __init__(self, op: A.Scan, lookups: Mapping[str, Any] | None = None, slots: dict[str, Any] | None = None):
        self.op, self.ev = op, Evaluator(lookups)
        self.slots: dict[str, dict[str, dict[str, Any]] | None] = slots or {s.name: None for s in op.steps}

    def _view(self, step: A.Step, slot, row: dict[str, Any]) -> dict[str, Any]:
        return {**row, step.name: (slot or {}).get(step.name, {})}

    def push(self, row: Mapping[str, Any]) -> list[dict[str, Any]]:
        row, out = dict(row), []
        steps = self.op.steps
        for i in range(len(steps) - 1, -1, -1):
            step = steps[i]
            before = self.slots[steps[i - 1].name] if i else None
            if before is not None and truth(self.ev.eval(step.test, self._view(step, before, row))):
                self.slots[steps[i - 1].name] = None
                self.slots[step.name] = {**before, step.name: dict(before.get(step.name, {}))}
            elif self.slots[step.name] is not None or i == 0:
                if not truth(self.ev.eval(step.test, self._view(step, self.slots[step.name], row))):
                    continue
                slot = self.slots[step.name] or {}
                self.slots[step.name] = {**slot, step.name: dict(slot.get(step.name, {}))}
            else:
                continue
            mine = self.slots[step.name][step.name]
            for a in step.assigns:
                value = self.ev.eval(a.value, {**row, step.name: mine})
                if a.step == step.name:
                    mine[a.name] = value
                elif a.step is None:
                    row[a.name] = value
            if step.emit:
                out.append(self.ev.members(step.emit.items, {**row, step.name: mine}))
        return out
