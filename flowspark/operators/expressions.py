"""Expressions to columns: names resolve against lookups, then columns; what is missing is null."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError, UnknownFunction
from ..functions.scalar import BOOL, DOUBLE, LONG, NULL, SCALARS, STRING, Value, arithmetic, loose_equal, number, ordered, strict_equal, truthy
from ..lang import ast as A


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Scope:
    """What names mean: ``fields`` of the rows, lookups, and functions that users registered."""

    df: DataFrame
    fields: Mapping[str, T.DataType]
    lookups: Mapping[str, object] = field(default_factory=dict)
    functions: Mapping[str, Callable[..., Column]] = field(default_factory=dict)
    js_concat: bool = False
    local: Mapping[str, Value] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, visible: list[str], lookups=None, functions=None, js_concat=False) -> Scope:
        kinds = {f.name: f.dataType for f in df.schema.fields}
        return cls(df, {n: kinds[n] for n in visible}, lookups or {}, functions or {}, js_concat)

    def type_of(self, col: Column) -> T.DataType:
        return self.df.select(col.alias("x")).schema[0].dataType

    def value(self, col: Column) -> Value:
        return Value(col, self.type_of(col))

    def literal(self, x: object) -> Value:
        if x is None:
            return Value(F.lit(None), NULL)
        if isinstance(x, bool):
            return Value(F.lit(x), BOOL, x)
        if isinstance(x, int):
            return Value(F.lit(x).cast("long"), LONG, x)
        if isinstance(x, float):
            return Value(F.lit(x), DOUBLE, x)
        if isinstance(x, str):
            return Value(F.lit(x), STRING, x)
        if isinstance(x, (list, tuple)):
            return self.array([self.literal(v) for v in x])
        if isinstance(x, Mapping):
            return self.struct({k: self.literal(v) for k, v in x.items()})
        raise CompileError(f"no literal: {x!r}")

    def struct(self, values: Mapping[str, Value]) -> Value:
        if not values:
            return Value(F.from_json(F.lit("{}"), "struct<_: string>"), T.StructType([]))
        col = F.struct(*[v.col.alias(k) for k, v in values.items()])
        return Value(col, T.StructType([T.StructField(k, v.type) for k, v in values.items()]))

    def array(self, values: list[Value]) -> Value:
        """Elements of unlike kinds become variants."""
        kinds = {type(v.type) for v in values if not v.null}
        if len(kinds) <= 1 and not (kinds & {T.StructType} and len({v.type.simpleString() for v in values}) > 1):
            return self.value(F.array(*[v.col for v in values]))
        if all(v.numeric or v.null for v in values):
            return self.value(F.array(*[v.col.cast("double") for v in values]))
        return Value(F.array(*[_variant(v) for v in values]), T.ArrayType(T.VariantType()))

    # Evaluation

    def compile(self, e: A.Expr) -> Value:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def test(self, e: A.Expr) -> Column:
        return truthy(self.compile(e))

    def predicate(self, e: A.Expr) -> Column:
        """A test for a filter, where null is as good as false: plain comparisons, which sources can push down."""
        if isinstance(e, A.Binary) and e.op in ("&&", "||"):
            a, b = self.predicate(e.left), self.predicate(e.right)
            return a & b if e.op == "&&" else a | b
        v = self.compile(e)
        if isinstance(e, A.Binary) and e.op == "==":
            sides = [self.compile(x) for x in (e.left, e.right)]
            if any(x.literal is not None for x in sides) and all(x.numeric for x in sides) or type(sides[0].type) is type(sides[1].type) and any(x.literal is not None for x in sides):
                return sides[0].col == sides[1].col
        return v.col if v.boolean else truthy(v)

    def _lit(self, e: A.Lit) -> Value:
        return self.literal(e.value)

    def _name(self, e: A.Name) -> Value:
        if e.name in self.local:
            return self.local[e.name]
        if e.name.lower() in self.lookups:
            return self.literal(self.lookups[e.name.lower()])
        if e.name in self.fields:
            return Value(quoted(e.name), self.fields[e.name])
        return Value(F.lit(None), NULL)

    def _field(self, e: A.Field) -> Value:
        base = self.compile(e.base)
        if isinstance(base.type, T.StructType) and e.name in base.type.fieldNames():
            return Value(base.col.getField(e.name), base.type[e.name].dataType)
        if isinstance(base.type, T.MapType):
            return Value(F.try_element_at(base.col, F.lit(e.name)), base.type.valueType)
        if isinstance(base.type, T.VariantType):
            return Value(F.try_variant_get(base.col, f"$.{e.name}", "variant"), base.type)
        if e.name == "length" and (isinstance(base.type, T.ArrayType) or base.text):
            return SCALARS["length"](base)
        return Value(F.lit(None), NULL)

    def _index(self, e: A.Index) -> Value:
        base, at = self.compile(e.base), self.compile(e.at)
        if isinstance(base.type, T.ArrayType):
            i = number(at).col.cast("int")
            return Value(F.when(i >= 0, F.get(base.col, i)), base.type.elementType)
        if isinstance(base.type, T.StructType) and isinstance(at.literal, str):
            return self._field(A.Field(e.base, at.literal))
        if isinstance(base.type, T.VariantType) and isinstance(at.literal, int):
            return Value(F.try_variant_get(base.col, f"$[{at.literal}]", "variant"), base.type)
        return Value(F.lit(None), NULL)

    def _unary(self, e: A.Unary) -> Value:
        v = self.compile(e.value)
        if e.op == "!":
            return Value(~truthy(v), BOOL)
        n = number(v)
        return Value(-n.col, n.type) if e.op == "-" else n

    def _shown(self, v: Value) -> Column:
        """Text of a value in a concatenation."""
        if v.numeric and isinstance(v.type, (T.DoubleType, T.FloatType)):
            whole = (v.col == F.floor(v.col)) & (F.abs(v.col) < 1e15)
            text = F.when(whole, v.col.cast("long").cast("string")).otherwise(v.col.cast("string"))
        else:
            text = v.col.cast("string")
        return F.coalesce(text, F.lit("undefined")) if self.js_concat else text

    def _binary(self, e: A.Binary) -> Value:
        a, b = self.compile(e.left), self.compile(e.right)
        if e.op in ("&&", "||"):
            return self._chosen(e.op, a, b)
        if e.op == "==":
            return Value(strict_equal(a, b), BOOL)
        if e.op == "!=":
            return Value(~strict_equal(a, b), BOOL)
        if e.op in ("<", ">", "<=", ">="):
            return Value(ordered(e.op, a, b), BOOL)
        if e.op == "+" and (a.text or b.text):
            return Value(F.concat(self._shown(a), self._shown(b)), STRING)
        return arithmetic(e.op, a, b)

    def _chosen(self, op: str, a: Value, b: Value) -> Value:
        """The deciding operand itself where both have one kind, else its truth, null for a null operand."""
        first = ~truthy(a) if op == "&&" else truthy(a)
        if a.null:
            return Value(F.lit(None), NULL) if op == "&&" else b
        if b.null or type(a.type) is type(b.type):
            return Value(F.when(first, a.col).otherwise(b.col), a.type)
        if a.numeric and b.numeric:
            return Value(F.when(first, a.col.cast("double")).otherwise(b.col.cast("double")), DOUBLE)
        if op == "||" and (a.text or b.text) and not (a.boolean or b.boolean):
            return Value(F.when(first, _variant(a)).otherwise(_variant(b)), T.VariantType())
        rest = F.when(b.col.isNotNull(), truthy(b))
        return Value(F.when(first, F.when(a.col.isNotNull(), truthy(a))).otherwise(rest), BOOL)

    def _choice(self, e: A.Choice) -> Value:
        test, yes, no = self.test(e.test), self.compile(e.yes), self.compile(e.no)
        yes, no = self._alike(yes, no)
        return Value(F.when(test, yes.col).otherwise(no.col), no.type if yes.null else yes.type)

    def _alike(self, a: Value, b: Value) -> tuple[Value, Value]:
        if a.null or b.null or a.type == b.type:
            return a, b
        if a.numeric and b.numeric:
            return Value(a.col.cast("double"), DOUBLE), Value(b.col.cast("double"), DOUBLE)
        if isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
            kinds = {f.name: f.dataType for f in (*b.type.fields, *a.type.fields)}
            cast = lambda v: self.struct({n: Value(v.col.getField(n) if n in v.type.fieldNames() else F.lit(None).cast(k), k) for n, k in kinds.items()})
            return cast(a), cast(b)
        return Value(_variant(a), T.VariantType()), Value(_variant(b), T.VariantType())

    def _isnull(self, e: A.IsNull) -> Value:
        c = self.compile(e.value).col
        return Value(c.isNotNull() if e.negated else c.isNull(), BOOL)

    def _inlist(self, e: A.InList) -> Value:
        v = self.compile(e.value)
        found = F.lit(False)
        for o in e.options:
            found |= loose_equal(v, self.compile(o))
        return Value(~found if e.negated else found, BOOL)

    def _arraylit(self, e: A.ArrayLit) -> Value:
        return self.array([self.compile(x) for x in e.items])

    def _objectlit(self, e: A.ObjectLit) -> Value:
        return self.struct(self.members(e.items))

    def _call(self, e: A.Call) -> Value:
        name = e.name.lower()
        if name in self.functions:
            return self.value(self.functions[name](*[self.compile(a).col for a in e.args]))
        if name not in SCALARS:
            raise UnknownFunction(f"unknown function {e.name!r}")
        return SCALARS[name](*[self.compile(a) for a in e.args])

    def _method(self, e: A.Method) -> Value:
        """``map``, ``filter`` and ``reduce`` of arrays."""
        base = self.compile(e.base)
        if not isinstance(base.type, T.ArrayType) or e.name not in ("map", "filter", "reduce") or not isinstance(e.args[0], A.Lambda):
            raise UnknownFunction(f"unknown method {e.name!r}")
        f = e.args[0]
        element = base.type.elementType

        def inner(**values: Value) -> Scope:
            return Scope(self.df, self.fields, self.lookups, self.functions, self.js_concat, {**self.local, **values})

        if e.name == "reduce":
            start = self.compile(e.args[1])
            kind = DOUBLE if start.numeric else start.type

            def merge(acc: Column, x: Column) -> Column:
                return inner(**{f.params[0]: Value(acc, kind), f.params[1]: Value(x, element)}).compile(f.body).col.cast(kind)

            return Value(F.aggregate(base.col, start.col.cast(kind), merge), kind)
        apply = lambda x: inner(**{f.params[0]: Value(x, element)})
        if e.name == "filter":
            return Value(F.filter(base.col, lambda x: apply(x).test(f.body)), base.type)
        return self.value(F.transform(base.col, lambda x: apply(x).compile(f.body).col))

    def members(self, items: tuple[A.Item, ...], base: Mapping[str, Value] | None = None) -> dict[str, Value]:
        """Fields of an object or a row: spreads first, then single fields, then exclusions."""
        out: dict[str, Value] = {}
        for it in items:
            if isinstance(it, A.SpreadAll):
                out |= base if base is not None else {n: Value(quoted(n), t) for n, t in self.fields.items()}
            elif isinstance(it, A.Spread):
                out |= self.spread(self.compile(it.value))
        for it in items:
            if isinstance(it, A.Prop):
                out[it.key] = self.compile(it.value)
        for it in items:
            if isinstance(it, A.Exclude):
                out.pop(it.key, None)
        return out

    @staticmethod
    def spread(v: Value) -> dict[str, Value]:
        if isinstance(v.type, T.StructType):
            return {f.name: Value(v.col.getField(f.name), f.dataType) for f in v.type.fields}
        return {}


def _variant(v: Value) -> Column:
    if v.null:
        return F.lit(None).cast("variant")
    if isinstance(v.type, (T.StructType, T.ArrayType, T.MapType)):
        return F.parse_json(F.to_json(v.col, {"ignoreNullFields": "false"}))
    return v.col.cast("variant")
