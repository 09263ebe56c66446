"""Values: families of types, truth, the order over all types, and the step from typed columns to VARIANT.

SQL NULL is a missing value; a JSON null is a VARIANT null. Typed columns can therefore only be missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Families in the order over all types (null is below all).
NULL, BOOL, NUMBER, TIMESTAMP, TIMESPAN, STRING, ARRAY, OBJECT, DYNAMIC = range(9)


def family(t: T.DataType) -> int:
    if isinstance(t, T.VariantType):
        return DYNAMIC
    if isinstance(t, T.BooleanType):
        return BOOL
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return TIMESTAMP
    if isinstance(t, T.DayTimeIntervalType):
        return TIMESPAN
    if isinstance(t, T.ArrayType):
        return ARRAY
    if isinstance(t, (T.StructType, T.MapType)):
        return OBJECT
    return NULL if isinstance(t, T.NullType) else STRING


def null() -> Column:
    return F.parse_json(F.lit("null"))


def missing() -> Column:
    return F.lit(None)


#: The first three letters of what schema_of_variant says (BIGINT, DECIMAL(3,1), STRING ...), by family.
KINDS = {NULL: ("VOI",), BOOL: ("BOO",), NUMBER: ("BIG", "DOU", "DEC", "FLO", "INT", "SMA", "TIN"), TIMESTAMP: ("TIM", "DAT"), STRING: ("STR",), ARRAY: ("ARR",), OBJECT: ("OBJ",)}


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def short_kind(v: Column) -> Column:
    return F.substring(kind(v), 1, 3)


def is_kind(v: Column, fam: int) -> Column:
    return F.coalesce(short_kind(v).isin(*KINDS[fam]), F.lit(False))


def once(c: Column, make) -> Column:
    """make(c), in which c is evaluated once a row, however often it stands there: filters do not share what stands twice."""
    return F.get(F.transform(F.array(c), make), F.lit(0))


def as_(v: Column, t: str) -> Column:
    return F.try_variant_get(v, "$", t)


def to_variant(c: Column, t: T.DataType) -> Column:
    """The same value as VARIANT. Structs go through JSON, which leaves missing fields out; timespans become microseconds' text."""
    fam = family(t)
    if fam == DYNAMIC:
        return c
    if fam == NULL:
        return F.lit(None).cast("variant")
    if fam == TIMESPAN:
        return c.cast("string").cast("variant")
    if fam == TIMESTAMP:
        return c.cast("timestamp").cast("variant")
    if fam in (ARRAY, OBJECT):
        return F.parse_json(F.to_json(c))
    return c.cast("variant")


def truthy(c: Column, t: T.DataType) -> Column:
    """True or false, missing where c is: numbers other than 0, and what is not empty."""
    fam = family(t)
    if fam == BOOL:
        return c
    if fam == NUMBER:
        return c != 0
    if fam == STRING:
        return c != ""
    if fam == ARRAY or isinstance(t, T.MapType):
        return F.when(c.isNotNull(), F.size(c) > 0)
    if fam == DYNAMIC:
        text = F.to_json(c)
        return F.when(c.isNull(), None).when(F.is_variant_null(c), False).when(is_kind(c, BOOL), as_(c, "boolean")).when(is_kind(c, NUMBER), as_(c, "double") != 0).when(is_kind(c, STRING), as_(c, "string") != "").when(is_kind(c, ARRAY), text != "[]").when(is_kind(c, OBJECT), text != "{}").otherwise(True)
    return F.when(c.isNotNull(), True)


KEY = "struct<rank:int,n:double,i:decimal(38,0),s:string,a:array<struct<rank:int,n:double,i:decimal(38,0),s:string>>>"
WHOLE = 1e37


def _whole(n: Column, exact: Column) -> Column:
    """The integer part beside the double, which tells large integers apart."""
    return F.when(F.abs(n) < WHOLE, exact)


def _flat(rank, n=None, i=None, s=None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(rank).cast("int").alias("rank"), (none if n is None else n).cast("double").alias("n"), (none if i is None else i).cast("decimal(38,0)").alias("i"), (none if s is None else s).cast("string").alias("s"))


def _variant_flat(v: Column) -> Column:
    def made(k: Column) -> Column:
        n = as_(v, "double")
        return (
            F.when(k.isin(*KINDS[NUMBER]), _flat(NUMBER, n, _whole(n, as_(v, "decimal(38,0)"))))
            .when(k.isin(*KINDS[STRING]), _flat(STRING, s=as_(v, "string")))
            .when(k.isin(*KINDS[NULL]), _flat(NULL))
            .when(k.isin(*KINDS[BOOL]), _flat(BOOL, as_(v, "int")))
            .when(k.isin(*KINDS[TIMESTAMP]), _flat(TIMESTAMP, F.unix_micros(as_(v, "timestamp")), F.unix_micros(as_(v, "timestamp"))))
            .when(k.isin(*KINDS[ARRAY]), _flat(ARRAY, s=F.to_json(v)))
            .when(v.isNotNull(), _flat(OBJECT, s=F.to_json(v)))
        )

    return once(short_kind(v), made)


def _keyed(flat: Column, items: Column) -> Column:
    return F.struct(flat["rank"].alias("rank"), flat["n"].alias("n"), flat["i"].alias("i"), flat["s"].alias("s"), items.cast("array<struct<rank:int,n:double,i:decimal(38,0),s:string>>").alias("a"))


def _variant_key(v: Column) -> Column:
    items = F.when(is_kind(v, ARRAY), F.transform(as_(v, "array<variant>"), lambda x: F.coalesce(_variant_flat(x), _flat(NULL))))
    return F.when(v.isNotNull(), once(_variant_flat(v), lambda flat: _keyed(flat, items)))


def key(c: Column, t: T.DataType) -> Column:
    """A struct that orders, groups and joins as the values do, over all types; missing stays missing.

    Arrays compare element by element (nested arrays and objects by their JSON text), objects by their JSON text.
    """
    fam, items = family(t), F.lit(None)
    if fam == DYNAMIC:
        return once(c, _variant_key)
    if fam == NUMBER:
        flat = _flat(NUMBER, c, _whole(c.cast("double"), c.try_cast("decimal(38,0)")))
    elif fam == BOOL:
        flat = _flat(BOOL, c.cast("int"))
    elif fam == STRING:
        flat = _flat(STRING, s=c)
    elif fam == TIMESTAMP:
        flat = _flat(TIMESTAMP, F.unix_micros(c.cast("timestamp")), F.unix_micros(c.cast("timestamp")))
    elif fam == TIMESPAN:
        flat = _flat(TIMESPAN, micros(c), micros(c))
    elif fam == ARRAY:
        v = to_variant(c, t)
        return key(v, T.VariantType())
    elif fam == OBJECT:
        flat = _flat(OBJECT, s=F.to_json(c))
    else:
        return F.lit(None).cast(KEY)
    return F.when(c.isNotNull(), _keyed(flat, items))


def micros(span: Column) -> Column:
    """Microseconds of a timespan."""
    return F.unix_micros(F.timestamp_micros(F.lit(0)) + span)


def number(c: Column, t: T.DataType) -> Column:
    """The value as double where it is a number (booleans and texts are none), else missing."""
    fam = family(t)
    if fam == NUMBER:
        return c.cast("double")
    if fam == DYNAMIC:
        return once(c, lambda v: F.when(short_kind(v).isin(*KINDS[NUMBER]), as_(v, "double")))
    return F.lit(None).cast("double")


def text(c: Column, t: T.DataType) -> Column:
    """The value where it is a text, else missing."""
    fam = family(t)
    if fam == STRING:
        return c
    if fam == DYNAMIC:
        return once(c, lambda v: F.when(short_kind(v).isin(*KINDS[STRING]), as_(v, "string")))
    return F.lit(None).cast("string")
