"""Expressions to columns: comparison over all types, missing operands, arithmetic, conversions, text search, case."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.nodes import Call, Lit, Path
from . import values as V

VARIANT = T.VariantType()


@dataclass
class Val:
    """A column and its type; col None: missing in every row."""

    col: Column | None
    type: T.DataType
    literal: Lit | None = None

    @property
    def family(self) -> int:
        return V.family(self.type)

    @property
    def column(self) -> Column:
        return F.lit(None) if self.col is None else self.col


MISSING = Val(None, T.NullType())


class ExpressionError(ValueError):
    status = 400


def bare(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def literal(x: Lit) -> Val:
    if x.kind == "null":
        return Val(V.null(), VARIANT, x)
    if x.kind == "timespan":
        return Val(F.lit(dt.timedelta(microseconds=x.value)), T.DayTimeIntervalType(), x)
    if x.kind == "datetime":
        return Val(F.lit(x.value).cast("timestamp_ntz"), T.TimestampNTZType(), x)
    if x.kind == "int" and not -(1 << 63) <= x.value < 1 << 63:
        return Val(F.lit(str(x.value)).cast("decimal(38,0)"), T.DecimalType(38, 0), x)
    kind = {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType()}[x.kind]
    return Val(F.lit(x.value).cast(kind), kind, x)


#: Metadata of a typed column whose NULL is a null, not a missing value: the least of no values.
NULLS = "weftlog.null"
#: Comparisons and the like in one filter beyond which it is said in one piece.
MANY = 24


class Expressions:
    """Compiles expressions over the columns of one DataFrame."""

    def __init__(self, df: DataFrame):
        self.df, self.schema = df, {f.name: f.dataType for f in df.schema.fields}
        self.nulls = {f.name for f in df.schema.fields if f.metadata.get(NULLS)}

    def value(self, e) -> Val:
        if isinstance(e, Lit):
            return literal(e)
        if isinstance(e, Path):
            return self.path(e)
        return getattr(self, "_" + NAMES.get(e.name, e.name))(e)

    def of(self, col: Column) -> Val:
        """A column with the type that Spark finds for it."""
        return Val(col, self.df.select(col.alias("x")).schema[0].dataType)

    # fields
    def path(self, p: Path) -> Val:
        (name, ix), rest = p.parts[0], p.parts[1:]
        if name not in self.schema:
            return MISSING
        col, t = bare(name), self.schema[name]
        if name in self.nulls:
            col, t = F.coalesce(V.to_variant(col, t), V.null()), VARIANT
        steps = [*ix, *(s for n, i in rest for s in (n, *i))]
        while steps:
            if isinstance(t, T.VariantType):
                place = "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']" for s in steps)
                return Val(F.try_variant_get(col, place, "variant"), VARIANT)
            s = steps.pop(0)
            if isinstance(t, T.ArrayType) and isinstance(s, int):
                col, t = F.get(col, F.lit(s)), t.elementType
            elif isinstance(t, T.StructType) and isinstance(s, str) and s in t.names:
                col, t = col.getField(s), t[s].dataType
            elif isinstance(t, T.MapType) and isinstance(s, str):
                col, t = F.try_element_at(col, F.lit(s)), t.valueType
            else:
                return MISSING
        return Val(col, t)

    def truth(self, e) -> Column:
        """The expression's truth: true, false, or missing."""
        v = self.value(e)
        return F.lit(None).cast("boolean") if v.col is None else V.truthy(v.col, v.type)

    def filter(self, e) -> Column:
        """True for the rows that a filter keeps. Where false and missing are alike, each comparison stands bare, as scans take it."""
        return self.holds(e) if leaves(e) <= MANY else self.truth(e)

    def holds(self, e) -> Column:
        """True where the expression is; what is missing on the left of `and` and `or` makes the whole missing."""
        if isinstance(e, Call) and e.name == "and":
            return self.holds(e.args[0]) & self.holds(e.args[1])
        if isinstance(e, Call) and e.name == "or":
            return self.holds(e.args[0]) | (self.fails(e.args[0]) & self.holds(e.args[1]))
        return self.fails(e.args[0]) if isinstance(e, Call) and e.name == "not" else self.truth(e)

    def fails(self, e) -> Column:
        """True where the expression is false, not where it is missing."""
        if isinstance(e, Call) and e.name == "and":
            return self.fails(e.args[0]) | (self.holds(e.args[0]) & self.fails(e.args[1]))
        if isinstance(e, Call) and e.name == "or":
            return self.fails(e.args[0]) & self.fails(e.args[1])
        return self.holds(e.args[0]) if isinstance(e, Call) and e.name == "not" else ~self.truth(e)

    # logic
    def _and(self, e: Call) -> Val:
        a, b = map(self.truth, e.args)
        return Val(F.when(a.isNotNull(), a & b), T.BooleanType())

    def _or(self, e: Call) -> Val:
        a, b = map(self.truth, e.args)
        return Val(a | (a.isNotNull() & b), T.BooleanType())

    def _not(self, e: Call) -> Val:
        return Val(~self.truth(e.args[0]), T.BooleanType())

    def _exists(self, e: Call) -> Val:
        v = self.value(e.args[0])
        return Val(F.lit(False) if v.col is None else v.col.isNotNull(), T.BooleanType())

    def _case(self, e: Call) -> Val:
        *pairs, last = e.args
        chosen = [self.value(v) for v in (*pairs[1::2], last)]
        t, cols = unify(chosen)
        out, otherwise = None, cols[-1]
        for p, c in zip(reversed(pairs[::2]), reversed(cols[:-1]), strict=True):
            truth = self.truth(p)
            otherwise = F.when(truth.isNull(), F.lit(None).cast(t)).when(truth, c).otherwise(otherwise)
            out = otherwise
        return Val(out, t)

    # comparison
    def compare(self, op: str, a: Val, b: Val) -> Column:
        if a.col is None or b.col is None:
            return F.lit(None).cast("boolean")
        x, y = a.col, b.col
        if a.family == V.DYNAMIC and b.literal and b.family in (V.BOOL, V.NUMBER, V.STRING) and not isinstance(b.type, T.DecimalType):
            return self.against(op, x, b)
        if b.family == V.DYNAMIC and a.literal and a.family in (V.BOOL, V.NUMBER, V.STRING) and not isinstance(a.type, T.DecimalType):
            return self.against({"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), y, a)
        if V.DYNAMIC in (a.family, b.family) or (a.family == b.family and a.family in (V.ARRAY, V.OBJECT)):
            x, y = V.key(x, a.type), V.key(y, b.type)
        elif a.family != b.family:
            known = {"==": False, "!=": True, "<": a.family < b.family, "<=": a.family < b.family, ">": a.family > b.family, ">=": a.family > b.family}[op]
            return F.when(x.isNotNull() & y.isNotNull(), F.lit(known))
        elif a.family == V.TIMESTAMP and type(a.type) is not type(b.type):  # keep the field as it is, so that it reaches the scan
            x, y = (x, y.cast(a.type)) if b.literal else (x.cast(b.type), y) if a.literal else (x.cast("timestamp"), y.cast("timestamp"))
        elif a.family == V.NUMBER and a.literal is None and b.literal and isinstance(a.type, T.IntegralType) and b.literal.kind == "int":
            low = {T.IntegerType: 31, T.ShortType: 15, T.ByteType: 7}.get(type(a.type), 63)
            y = F.lit(b.literal.value).cast(a.type) if -(1 << low) <= b.literal.value < 1 << low else y
        return compared(op, x, y)

    def against(self, op: str, c: Column, lit: Val) -> Column:
        """A dynamic value against a literal: by value within the literal's type, else by the order of types."""
        below = [k for fam, kinds in V.KINDS.items() if fam < lit.family for k in kinds]
        as_type = {V.BOOL: "boolean", V.NUMBER: "double", V.STRING: "string"}[lit.family]

        def made(v: Column) -> Column:
            kind = V.short_kind(v)
            same = compared(op, V.as_(v, as_type), lit.col.cast(as_type))
            if lit.literal.kind == "int":
                same = F.when(kind == "BIG", compared(op, V.as_(v, "bigint"), lit.col)).otherwise(same)
            other = F.when(kind.isin(*below), F.lit(op in ("<", "<=", "!="))).otherwise(F.lit(op in (">", ">=", "!=")))
            return F.when(v.isNotNull(), F.when(kind.isin(*V.KINDS[lit.family]), same).otherwise(other))

        return V.once(c, made)

    def _compare(self, e: Call) -> Val:
        return Val(self.compare(e.name, *map(self.value, e.args)), T.BooleanType())

    def _in(self, e: Call) -> Val:
        x, *rest = map(self.value, e.args)
        if x.col is None:
            return Val(F.lit(None).cast("boolean"), T.BooleanType())
        rest = [r for r in rest if r.col is not None]
        if x.family in (V.BOOL, V.NUMBER, V.TIMESTAMP, V.STRING):  # literals of other types equal nothing
            rest = [r for r in rest if not r.literal or r.family == x.family]
        if rest and all(r.literal and r.family == x.family != V.DYNAMIC and r.family in (V.NUMBER, V.STRING) for r in rest):
            return Val(x.col.isin([r.literal.value for r in rest]), T.BooleanType())
        hits = [F.coalesce(self.compare("==", x, r), F.lit(False)) for r in rest]
        return Val(F.when(x.col.isNotNull(), reduce(Column.__or__, hits, F.lit(False))), T.BooleanType())

    # arithmetic
    def _arithmetic(self, e: Call) -> Val:
        a, b = map(self.value, e.args)
        if a.col is None or b.col is None:
            return MISSING
        fams = (a.family, b.family)
        if V.DYNAMIC in fams:
            return self.dynamic(e.name, a, b)
        if fams == (V.NUMBER, V.NUMBER):
            return self.numbers(e.name, a, b)
        if e.name == "+" and fams == (V.STRING, V.STRING):
            return Val(F.concat(a.col, b.col), T.StringType())
        spans = {("+", V.TIMESTAMP, V.TIMESPAN), ("+", V.TIMESPAN, V.TIMESTAMP), ("+", V.TIMESPAN, V.TIMESPAN), ("-", V.TIMESTAMP, V.TIMESPAN), ("-", V.TIMESPAN, V.TIMESPAN), ("*", V.TIMESPAN, V.NUMBER), ("*", V.NUMBER, V.TIMESPAN)}
        if (e.name, *fams) in spans:
            return self.of({"+": a.col + b.col, "-": a.col - b.col, "*": a.col * b.col}[e.name] if fams != (V.NUMBER, V.TIMESPAN) else b.col * a.col)
        if e.name == "-" and fams == (V.TIMESTAMP, V.TIMESTAMP):
            t = "timestamp_ntz" if isinstance(a.type, T.TimestampNTZType) or isinstance(b.type, T.TimestampNTZType) else "timestamp"
            return Val(a.col.cast(t) - b.col.cast(t), T.DayTimeIntervalType())
        if e.name == "/" and fams == (V.TIMESPAN, V.NUMBER):
            return self.of(F.try_divide(a.col, F.nullif(b.col.cast("double"), F.lit(0.0))))
        if e.name == "/" and fams == (V.TIMESPAN, V.TIMESPAN):
            return Val(F.try_divide(V.micros(a.col).cast("double"), V.micros(b.col).cast("double")), T.DoubleType())
        return MISSING

    def numbers(self, op: str, a: Val, b: Val) -> Val:
        if op == "/":
            return Val(finite(F.try_divide(a.col.cast("double"), b.col.cast("double"))), T.DoubleType())
        whole = all(isinstance(v.type, T.IntegralType) for v in (a, b))
        t = T.LongType() if whole else T.DoubleType()
        x, y = a.col.cast(t), b.col.cast(t)
        out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
        return Val(out if whole else finite(out), t)

    def dynamic(self, op: str, a: Val, b: Val) -> Val:
        """At least one operand's type is known only row by row."""
        x, y = V.to_variant(a.col, a.type), V.to_variant(b.col, b.type)
        n = self.numbers(op, Val(V.number(x, VARIANT), T.DoubleType()), Val(V.number(y, VARIANT), T.DoubleType())).col.cast("variant")
        out = F.when(V.is_kind(x, V.NUMBER) & V.is_kind(y, V.NUMBER), n)
        if op != "/":
            whole = F.startswith(V.kind(x), F.lit("BIGINT")) & F.startswith(V.kind(y), F.lit("BIGINT"))
            i = self.numbers(op, Val(V.as_(x, "bigint"), T.LongType()), Val(V.as_(y, "bigint"), T.LongType())).col.cast("variant")
            out = F.when(whole, i).otherwise(out)
        if op == "+":
            out = F.coalesce(out, F.concat(V.text(x, VARIANT), V.text(y, VARIANT)).cast("variant"))
        return Val(out, VARIANT)

    def _bin(self, e: Call) -> Val:
        x, step = map(self.value, e.args)
        if x.col is None or step.col is None:
            return MISSING
        if x.family == V.TIMESTAMP and step.family == V.TIMESPAN:
            at = F.unix_micros(x.col.cast("timestamp"))
            width = F.lit(step.literal.value) if step.literal else V.micros(step.col)
            width = F.when(width > 0, width)
            floor = F.timestamp_micros((at - at % width).cast("bigint"))  # towards zero
            return Val(floor.cast(x.type), x.type)
        a, b = V.number(x.col, x.type), V.number(step.col, step.type)
        return Val(finite(F.floor(F.try_divide(a, b)) * b).cast("double"), T.DoubleType())

    # conversions
    def _tobool(self, e: Call) -> Val:
        return Val(self.truth(e.args[0]), T.BooleanType())

    def _tolong(self, e: Call) -> Val:
        return self.cast(e, "bigint", r"^[+-]?[0-9]+$", T.LongType())

    def _toreal(self, e: Call) -> Val:
        return self.cast(e, "double", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", T.DoubleType())

    def cast(self, e: Call, to: str, strict: str, t: T.DataType) -> Val:
        v = self.value(e.args[0])
        if v.col is None:
            return MISSING
        from_text = lambda c: F.when(F.rlike(c, F.lit(strict)), c.try_cast(to))
        if v.family in (V.BOOL, V.NUMBER):
            return Val(v.col.try_cast(to), t)
        if v.family == V.STRING:
            return Val(finite(from_text(v.col)) if to == "double" else from_text(v.col), t)
        if v.family == V.DYNAMIC:
            c = v.col
            whole = F.when(F.startswith(V.kind(c), F.lit("BIGINT")), V.as_(c, "bigint")).otherwise(V.as_(c, "double").try_cast(to)) if to == "bigint" else V.as_(c, "double")
            return Val(F.when(F.is_variant_null(c), F.lit(0).cast(to)).when(V.is_kind(c, V.BOOL), V.as_(c, "boolean").cast("int").cast(to)).when(V.is_kind(c, V.NUMBER), whole).when(V.is_kind(c, V.STRING), from_text(V.as_(c, "string"))), t)
        return MISSING

    def _tostring(self, e: Call) -> Val:
        v = self.value(e.args[0])
        if v.col is None:
            return MISSING
        if v.family in (V.BOOL, V.STRING) or v.family == V.NUMBER and isinstance(v.type, T.IntegralType):
            return Val(v.col.cast("string"), T.StringType())
        if v.family == V.NUMBER:
            return Val(plain(v.col.cast("double")), T.StringType())
        if v.family == V.TIMESPAN:
            return Val(v.col.cast("string"), T.StringType())
        if v.family == V.DYNAMIC:
            c = v.col
            return Val(F.when(F.is_variant_null(c), "null").when(F.startswith(V.kind(c), F.lit("BIGINT")) | V.is_kind(c, V.BOOL) | V.is_kind(c, V.STRING), V.as_(c, "string")).when(V.is_kind(c, V.NUMBER), plain(V.as_(c, "double"))), T.StringType())
        return MISSING

    # texts
    def _text(self, e: Call) -> Val:
        a, b = map(self.value, e.args)
        x, y = (F.lit(None).cast("string") if v.col is None else V.text(v.col, v.type) for v in (a, b))
        if e.name in ("contains", "startswith", "endswith"):
            return Val({"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[e.name](x, y), T.BooleanType())
        head = ("" if e.name == "has_cs" else "(?i)") + r"(?<![A-Za-z0-9])"
        if b.literal and b.literal.kind == "string":
            if not b.literal.value:
                return Val(F.when(x.isNotNull(), True), T.BooleanType())
            return Val(x.rlike(head + quoted(b.literal.value) + r"(?![A-Za-z0-9])"), T.BooleanType())
        pattern = F.concat(F.lit(head + "\\Q"), F.replace(y, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z0-9])"))
        return Val(F.when(y == "", F.when(x.isNotNull(), True)).otherwise(F.rlike(x, pattern)), T.BooleanType())

    def _extract(self, e: Call) -> Val:
        regex, group, source = e.args
        if not (isinstance(regex, Lit) and regex.kind == "string" and isinstance(group, Lit) and group.kind == "int"):
            raise ExpressionError("extract takes a literal pattern and group")
        v = self.value(source)
        if v.col is None or group.value < 0:
            return MISSING
        if re.search(r"\(\?<?[=!]|\\[1-9]", regex.value):
            raise ExpressionError("look-around and back references are not supported in patterns")
        try:
            groups = re.compile(regex.value).groups
        except re.error as x:
            raise ExpressionError(f"bad pattern: {x}") from None
        x, pattern = V.text(v.col, v.type), "(?U)" + regex.value
        if group.value > groups:
            return Val(F.when(x.isNotNull(), V.null()), VARIANT)
        found = F.regexp_extract(x, pattern, group.value)
        # nothing found: an empty group can be matched again, one that takes no part cannot
        empty = x.rlike(f"(?U)(?:{regex.value})" + (f"\\{group.value}" if group.value else ""))
        return Val(F.when(x.isNotNull(), F.when((found != "") | empty, found.cast("variant")).otherwise(V.null())), VARIANT)


NAMES = dict.fromkeys(("==", "!=", "<", "<=", ">", ">="), "compare") | dict.fromkeys(("+", "-", "*", "/"), "arithmetic") | dict.fromkeys(("contains", "startswith", "endswith", "has", "has_cs"), "text")


def compared(op: str, x: Column, y: Column) -> Column:
    return {"==": x.__eq__, "!=": x.__ne__, "<": x.__lt__, "<=": x.__le__, ">": x.__gt__, ">=": x.__ge__}[op](y)


def leaves(e) -> int:
    return sum(map(leaves, e.args)) if isinstance(e, Call) and e.name in ("and", "or", "not") else 1


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\s\x80-\U0010ffff])", r"\\\1", text)


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def plain(c: Column) -> Column:
    """A double as text without an exponent and without a trailing .0."""
    short = c.cast("string")
    wide = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.when(F.contains(short, F.lit("E")), F.coalesce(wide, short)).otherwise(F.regexp_replace(short, r"\.0$", ""))


def unify(vals: list[Val]) -> tuple[T.DataType, list[Column]]:
    """One type for several values: their own, a wider number, or VARIANT."""
    types = [v.type for v in vals if v.col is not None]
    if not types:
        return T.StringType(), [F.lit(None).cast("string") for _ in vals]
    t = wider(types)
    if isinstance(t, T.VariantType):
        return t, [F.lit(None).cast(t) if v.col is None else V.to_variant(v.col, v.type) for v in vals]
    return t, [v.column.cast(t) for v in vals]


def wider(types: list[T.DataType]) -> T.DataType:
    kinds = {t.simpleString(): t for t in types}
    if len(kinds) == 1:
        return types[0]
    if all(isinstance(t, T.IntegralType) for t in types):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    return VARIANT
