"""Pipeline steps to DataFrame operations: filters, projections, expansion, order, aggregation, union and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values as V
from ..functions.expressions import MISSING, NULLS, VARIANT, ExpressionError, Expressions, Val, bare, unify, wider
from ..plans.nodes import Agg, Call, Item, Path, SortKey


class StepError(ValueError):
    status = 400


# names


def free(name: str, taken) -> str:
    """The name, or the first of name1, name2, ... that is not taken."""
    k, out = 0, name
    while out in taken:
        k += 1
        out = f"{name}{k}"
    return out


def targets(items: tuple[Item, ...]) -> list[tuple[str, ...]]:
    """Where each item goes: its target, a field's own path, the field inside a conversion or bin, or Column1, Column2, ..."""
    out, taken, n = [], set(), 0
    for item in items:
        if item.target:
            names = item.target.names
        else:
            e = item.expr
            while isinstance(e, Call) and e.name in ("tostring", "tolong", "toreal", "tobool", "bin"):
                e = e.args[0]
            if isinstance(e, Path):
                names = tuple(x for name, ix in e.parts for x in (name, *ix))
            else:
                n += 1
                names = (f"Column{n}",)
            names = (*names[:-1], free(names[-1], {t[-1] for t in taken if t[:-1] == names[:-1]})) if isinstance(names[-1], str) else names
        taken.add(names)
        out.append(names)
    return out


def nested(pairs: list[tuple[tuple, Val]]) -> Val:
    """One value from parts at paths below it; a number in a path is a place in a list, before which nulls stand."""
    if pairs[-1][0] == ():
        return pairs[-1][1]
    groups: dict = {}
    for path, v in pairs:
        if path:
            groups.setdefault(path[0], []).append((path[1:], v))
    inner = {k: nested(p) for k, p in groups.items()}
    if any(isinstance(k, int) for k in inner):
        size = max(k for k in inner if isinstance(k, int)) + 1
        cells = [inner.get(i, Val(V.null(), VARIANT)) for i in range(size)]
        t, cols = (cells[0].type, [cells[0].column]) if size == 1 else unify(cells)
        return Val(F.when(any_there([inner[k] for k in inner if isinstance(k, int)]), F.array(*cols)), T.ArrayType(t))
    inner = {k: v for k, v in inner.items() if v.col is not None}
    if not inner:
        return MISSING
    return Val(F.when(any_there(list(inner.values())), F.struct(*(v.col.alias(k) for k, v in inner.items()))), T.StructType([T.StructField(k, v.type) for k, v in inner.items()]))


def any_there(parts: list[Val]) -> Column:
    """Whether one of the parts is not missing; without any, what holds them is missing too."""
    return reduce(Column.__or__, [v.column.isNotNull() for v in parts])


def laid_out(df: DataFrame, items: tuple[Item, ...]) -> dict[str, Val]:
    x, by_name = Expressions(df), {}
    for names, item in zip(targets(items), items, strict=True):
        by_name.setdefault(names[0], []).append((names[1:], x.value(item.expr)))
    return {k: nested(v) for k, v in by_name.items()}


# rows


def where(df: DataFrame, expr) -> DataFrame:
    return df.filter(Expressions(df).filter(expr))


def project(df: DataFrame, items: tuple[Item, ...]) -> DataFrame:
    return df.select(*(v.col.alias(k) for k, v in laid_out(df, items).items() if v.col is not None))


def extend(df: DataFrame, items: tuple[Item, ...]) -> DataFrame:
    """All expressions see the row as it was; a part of a field replaces the whole field; what is missing leaves the field as it was."""
    new = {k: v for k, v in laid_out(df, items).items() if v.col is not None}
    cols = []
    for name in df.columns:
        if name in new:
            v, old = new.pop(name), Val(bare(name), df.schema[name].dataType)
            t, (a, b) = unify([v, old]) if V.family(v.type) == V.family(old.type) or V.DYNAMIC in (v.family, old.family) or old.family == V.NULL else (VARIANT, [V.to_variant(v.col, v.type), V.to_variant(old.col, old.type)])
            cols.append((v.col if never_missing(v) else F.coalesce(a, b)).alias(name))
        else:
            cols.append(bare(name))
    return df.select(*cols, *(v.col.alias(k) for k, v in new.items()))


def never_missing(v: Val) -> bool:
    return v.literal is not None


def at_path(v: Val, names: tuple[str, ...], make) -> Val:
    """The value with make(old) in the place of the part at names; MISSING there drops the part."""
    if not names:
        return make(v)
    name, rest = names[0], names[1:]
    if isinstance(v.type, T.StructType):
        fields = {f.name: Val(v.col.getField(f.name), f.dataType) for f in v.type.fields}
        fields[name] = at_path(fields.get(name, MISSING), rest, make)
        kept = {k: x for k, x in fields.items() if x.col is not None}
        out = F.struct(*(x.col.alias(k) for k, x in kept.items())) if kept else None
        return MISSING if out is None else Val(F.when(v.col.isNotNull(), out) if names else out, T.StructType([T.StructField(k, x.type) for k, x in kept.items()]))
    if isinstance(v.type, T.VariantType):
        old = V.as_(v.col, "map<string,variant>")
        part = at_path(Val(F.try_element_at(old, F.lit(name)), VARIANT), rest, make)
        others = F.map_filter(old, lambda k, _: k != name)
        made = others if part.col is None else F.when(part.col.isNull(), others).otherwise(F.map_concat(others, F.map_from_arrays(F.array(F.lit(name)), F.array(V.to_variant(part.col, part.type)))))
        return Val(F.when(V.is_kind(v.col, V.OBJECT), F.to_variant_object(made)).otherwise(v.col), VARIANT)
    if v.col is None:
        inner = at_path(MISSING, rest, make)
        return MISSING if inner.col is None else Val(F.struct(inner.col.alias(name)), T.StructType([T.StructField(name, inner.type)]))
    return v


def replaced(df: DataFrame, name: str, v: Val) -> DataFrame:
    if v.col is None:
        return df.select(*(bare(c) for c in df.columns if c != name))
    return df.select(*(v.col.alias(c) if c == name else bare(c) for c in df.columns), *([] if name in df.columns else [v.col.alias(name)]))


def rename(df: DataFrame, pairs: tuple[tuple[Path, Path], ...]) -> DataFrame:
    """One after another; a value moves, the rest stays; a missing source changes nothing."""
    for new, old in pairs:
        v = Expressions(df).path(old)
        if v.col is None or new.names == old.names:
            continue
        if len(new.names) == len(old.names) == 1:
            df = df.select(*(bare(c).alias(new.names[0]) if c == old.names[0] else bare(c) for c in df.columns if c != new.names[0]))
            continue
        df = df.withColumn("__moved", v.col)
        moved = Val(bare("__moved"), df.schema["__moved"].dataType)
        for names, make in ((old.names, lambda _: MISSING), (new.names, lambda _, m=moved: m)):
            root = names[0]
            old_root = Val(bare(root), df.schema[root].dataType) if root in df.columns else MISSING
            df = replaced(df, root, at_path(old_root, names[1:], make))
        df = df.drop("__moved")
    return df


def elements(v: Val, kind: str) -> tuple[Column, T.DataType, Column]:
    """The list that a value expands to, its elements' type, and whether the value expands at all."""
    if isinstance(v.type, T.ArrayType):
        return v.col, v.type.elementType, v.col.isNotNull()
    if v.family == V.OBJECT and not isinstance(v.type, T.MapType):
        v = Val(V.to_variant(v.col, v.type), VARIANT)
    if isinstance(v.type, T.MapType):
        pairs = F.map_entries(v.col)
        if kind == "bag":
            return F.transform(pairs, lambda e: F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))), v.type, v.col.isNotNull()
        return F.flatten(F.transform(pairs, lambda e: F.array(e["key"].cast("variant"), V.to_variant(e["value"], v.type.valueType)))), VARIANT, v.col.isNotNull()
    if v.family == V.DYNAMIC:
        pairs = F.map_entries(V.as_(v.col, "map<string,variant>"))
        if kind == "bag":
            bags = F.transform(pairs, lambda e: F.to_variant_object(F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))
        else:
            bags = F.flatten(F.transform(pairs, lambda e: F.array(e["key"].cast("variant"), e["value"])))
        is_array, is_object = V.is_kind(v.col, V.ARRAY), V.is_kind(v.col, V.OBJECT)
        return F.when(is_array, V.as_(v.col, "array<variant>")).when(is_object, bags), VARIANT, F.coalesce(is_array | is_object, F.lit(False))
    return None, v.type, F.lit(False)


def expand(df: DataFrame, kind: str, paths: tuple[Path, ...]) -> DataFrame:
    """Lists are taken side by side, short ones filled with nulls; what is no list or object repeats; only empty ones: no row."""
    x = Expressions(df)
    found = [(p, v, *elements(v, kind)) for p in paths if (v := x.path(p)).col is not None]
    found = [f for f in found if f[2] is not None]
    if not found:
        return df
    sizes = [F.when(ok, F.size(items)).otherwise(0) for _, _, items, _, ok in found]
    most, some = F.greatest(*sizes) if len(sizes) > 1 else sizes[0], reduce(Column.__or__, [ok for *_, ok in found])
    at = F.when(~some, F.array(F.lit(0))).when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
    lists = [items.alias(f"__list{i}") for i, (_, _, items, _, _) in enumerate(found)]
    oks = [ok.alias(f"__ok{i}") for i, (*_, ok) in enumerate(found)]
    out = df.select(*(bare(c) for c in df.columns), *lists, *oks, F.explode(at).alias("__at"))
    for i, (p, v, _, t, _) in enumerate(found):
        item = F.get(bare(f"__list{i}"), F.col("__at"))
        if isinstance(t, T.VariantType):
            item = F.coalesce(item, V.null())
        if isinstance(v.type, (T.ArrayType, T.MapType)):
            taken = Val(item, t)
        else:
            old = Expressions(out).path(p)
            taken = Val(F.when(bare(f"__ok{i}"), item).otherwise(V.to_variant(old.col, old.type)), VARIANT)
        root = p.names[0]
        whole = Val(bare(root), out.schema[root].dataType)
        out = replaced(out, root, at_path(whole, p.names[1:], lambda _, new=taken: new))
    return out.select(*(bare(c) for c in out.columns if not c.startswith(("__list", "__ok", "__at"))))


# order


def order_keys(df: DataFrame, keys: tuple[SortKey, ...]) -> list[Column]:
    x, out = Expressions(df), []
    for k in keys:
        v = x.path(k.path)
        if v.col is None:
            continue
        c = v.col
        if len(k.path.parts) == 1 and not k.path.parts[0][1] and k.path.names[0] in x.nulls:  # nulls and what is missing sort alike
            v = Val(bare(k.path.names[0]), x.schema[k.path.names[0]])
            c = v.col
        if v.family in (V.DYNAMIC, V.OBJECT):
            key = V.key(c, v.type)
            c = F.when(key["rank"] > V.NULL, key)
        out.append({(False, False): c.asc_nulls_last, (False, True): c.asc_nulls_first, (True, False): c.desc_nulls_last, (True, True): c.desc_nulls_first}[k.desc, k.nulls_first]())
    return out


def sort(df: DataFrame, keys: tuple[SortKey, ...]) -> DataFrame:
    found = order_keys(df, keys)
    return df.orderBy(*found) if found else df


def top(df: DataFrame, n: int, keys: tuple[SortKey, ...]) -> DataFrame:
    return sort(df, keys).limit(n)


# aggregation


def aggregate(x: Expressions, a: Agg) -> Column:
    if a.name == "count":
        return F.count(F.lit(1))
    if a.name == "countif":
        return F.count_if(F.coalesce(x.truth(a.arg), F.lit(False)))
    v = x.path(a.arg)
    if a.name in ("sum", "avg"):
        n = F.lit(None).cast("double") if v.col is None else V.number(v.col, v.type)
        return F.coalesce(F.sum(n) if a.name == "sum" else F.avg(n), F.lit(0.0))
    if v.col is None:
        return F.lit(0).cast("bigint") if a.name == "dcount" else F.any_value(V.null())
    plain = v.family not in (V.DYNAMIC, V.OBJECT, V.ARRAY)
    if a.name == "dcount":
        return F.count_distinct(v.col if plain else V.key(v.col, v.type))
    if plain:
        return F.min(v.col) if a.name == "min" else F.max(v.col)
    least = (F.min_by if a.name == "min" else F.max_by)(v.col, V.key(v.col, v.type))
    return F.coalesce(V.to_variant(least, v.type), V.null())


def aliased(name: str, c: Column, a: Agg) -> Column:
    """The least and the greatest of no values are null."""
    return c.alias(name, metadata={NULLS: True}) if a.name in ("min", "max") else c.alias(name)


def summarize(df: DataFrame, aggs: tuple[Agg, ...], by: tuple[Item, ...]) -> DataFrame:
    """Rows in which a key is missing or null take no part. Keys of dynamic type group by value, across types."""
    x = Expressions(df)
    names = [".".join(map(str, t)) if not by[i].target else t for i, t in enumerate(targets(by))]
    names = [n if isinstance(n, str) else ".".join(n) for n in names]
    taken, made, of = set(names), {}, {}
    for a in aggs:
        path = "" if a.arg is None or a.name == "countif" else "_".join(a.arg.names)
        name = ".".join(a.target.names) if a.target else free(f"{a.name}_{path}", taken)
        taken.add(name)
        made[name], of[name] = aggregate(x, a), a
    if not by:
        if not made:
            return df.agg(F.count(F.lit(1)).alias("__n")).select()
        return df.agg(*(aliased(n, c, of[n]) for n, c in made.items()))
    vals = [x.value(item.expr) for item in by]
    if any(v.col is None for v in vals):
        empty = [F.lit(None).cast("string").alias(n) for n in names]
        return df.limit(0).select(*empty, *(F.lit(None).cast("double").alias(n) for n in made)).filter(F.lit(False))
    keys, finals, seen, checks = [], [], {}, []
    for i, (n, v, item) in enumerate(zip(names, vals, by, strict=True)):
        if str(item.expr) in seen:
            finals.append((seen[str(item.expr)], n))
            continue
        seen[str(item.expr)] = n
        if v.family in (V.DYNAMIC, V.OBJECT, V.ARRAY):
            k = V.key(v.col, v.type)
            checks.append(k["rank"] > V.NULL)
            keys.append(k.alias(f"__key{i}"))
            made[f"__first{i}"] = F.first(v.col)
            finals.append((f"__first{i}", n))
        else:
            checks.append(v.col.isNotNull())
            keys.append(v.col.alias(f"__key{i}"))
            finals.append((f"__key{i}", n))
            seen[str(item.expr)] = f"__key{i}"
            continue
        seen[str(item.expr)] = f"__first{i}"
    kept = df.filter(reduce(Column.__and__, checks))
    grouped = kept.groupBy(*keys)
    out = grouped.agg(*(aliased(n, c, of[n]) if n in of else c.alias(n) for n, c in made.items())) if made else kept.select(*keys).distinct()
    return out.select(*(bare(a).alias(n) for a, n in finals), *(bare(n) for n in made if not n.startswith("__first")))


def one_type(df: DataFrame, exprs: tuple) -> None:
    """Raises where the values of a dynamic key are of several types, nulls aside. Reads the key column once; typed keys need no reading."""
    x = Expressions(df)
    for e in exprs:
        v = x.value(e)
        if v.family == V.DYNAMIC:
            found = df.select(V.key(v.col, v.type)["rank"].alias("rank")).filter(F.col("rank") > V.NULL).distinct().collect()  # a row for each type
            if len(found) > 1:
                raise ExpressionError(f"values of different types in the key {e}")


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("Count"))


# several inputs


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; a field that both have in types that do not widen becomes VARIANT."""
    both = {}
    for name in [*a.columns, *(c for c in b.columns if c not in a.columns)]:
        types = [d.schema[name].dataType for d in (a, b) if name in d.columns]
        both[name] = types[0] if len(types) == 1 else wider(types)

    def shaped(d: DataFrame) -> DataFrame:
        cols = []
        for name, t in both.items():
            if name not in d.columns:
                cols.append(F.lit(None).cast(t).alias(name))
            else:
                own = d.schema[name].dataType
                cols.append(bare(name) if own == t else (V.to_variant(bare(name), own) if isinstance(t, T.VariantType) else bare(name).cast(t)).alias(name))
        return d.select(*cols)

    return shaped(a).unionAll(shaped(b))


def join(left: DataFrame, right: DataFrame, kind: str, on_left: Path, on_right: Path, partitions: int = 1, unique: bool = False) -> DataFrame:
    """One equality. Rows without the key take no part, whatever the kind.

    inner, outer: names of the right side that the left side has get the first free number, or go where the left value is the
    key's. left: each left row once, with what the first matching right row has beside it (the right side is reduced to one row
    a key, unless its keys are known to be unique); right: the same with the sides exchanged.
    """
    if kind == "right":
        return join(right, left, "left", on_right, on_left, partitions, unique)
    lk, rk = Expressions(left).path(on_left), Expressions(right).path(on_right)
    if lk.col is None or rk.col is None:
        return _shape(left, right, kind, on_left, on_right, None)
    simple = lk.family == rk.family and lk.family not in (V.DYNAMIC, V.ARRAY, V.OBJECT)
    a, b = (lk.col, rk.col) if simple else (V.key(lk.col, lk.type), V.key(rk.col, rk.type))
    l2 = left.filter(lk.col.isNotNull()).select(*(bare(c).alias(f"l.{c}") for c in left.columns), a.alias("__lk"), F.lit(True).alias("__l"))
    r2 = right.filter(rk.col.isNotNull()).select(*(bare(c).alias(f"r.{c}") for c in right.columns), b.alias("__rk"), F.lit(True).alias("__r"))
    if partitions > 1:
        l2, r2 = l2.repartition(partitions, "__lk"), r2.repartition(partitions, "__rk")
    if kind == "left" and not unique:
        # rows have some order that does not depend on where they are read: by their hashes
        hashed = [bare(f"r.{f.name}") if V.family(f.dataType) not in (V.DYNAMIC, V.OBJECT) else F.to_json(F.struct(bare(f"r.{f.name}"))) for f in right.schema.fields]
        rank = F.xxhash64(*hashed) if hashed else None
        r2 = r2.groupBy("__rk").agg(*(F.min_by(bare(f"r.{c}"), F.when(bare(f"r.{c}").isNotNull(), rank)).alias(f"r.{c}") for c in right.columns), F.lit(True).alias("__r")) if right.columns else r2.distinct()
    how = {"inner": "inner", "outer": "full_outer", "left": "left"}[kind]
    joined = l2.join(r2, F.col("__lk") == F.col("__rk"), how)
    return _shape(left, right, kind, on_left, on_right, joined)


def _shape(left: DataFrame, right: DataFrame, kind: str, on_left: Path, on_right: Path, joined: DataFrame | None) -> DataFrame:
    lt, rt = ({f.name: f.dataType for f in d.schema.fields} for d in (left, right))
    if joined is None:  # one side never has the key
        joined = left.limit(0).select(*(bare(c).alias(f"l.{c}") for c in lt), *(F.lit(None).cast(t).alias(f"r.{c}") for c, t in rt.items()), F.lit(True).alias("__l"), F.lit(True).alias("__r"), F.lit(None).alias("__lk")).filter(F.lit(False))
    lc, rc = lambda c: bare(f"l.{c}"), lambda c: bare(f"r.{c}")
    cols: dict[str, Column] = {}
    if kind == "left":
        for c, t in lt.items():
            cols[c] = lc(c) if c not in rt else F.coalesce(*unify([Val(lc(c), t), Val(rc(c), rt[c])])[1])
        cols |= {c: rc(c) for c in rt if c not in lt}
        return joined.select(*(v.alias(k) for k, v in cols.items()))
    only_right, only_left = F.col("__l").isNull(), F.col("__r").isNull()
    moved: dict[str, str] = {}
    taken = set(lt)
    for c in sorted(rt):
        if c in lt and not (c == on_left.names[0] == on_right.names[0] and len(on_left.names) == len(on_right.names) == 1):
            moved[c] = free(f"{c}1", ()) if f"{c}1" not in taken else next(f"{c}{k}" for k in range(2, 1 << 30) if f"{c}{k}" not in taken)
            taken.add(moved[c])
        else:
            taken.add(c)
    for c, t in lt.items():
        if c in rt and kind == "outer":
            _, (a, b) = unify([Val(lc(c), t), Val(rc(c), rt[c])])
            cols[c] = F.when(only_right, b).otherwise(a)
        else:
            cols[c] = lc(c)
    for c in (c for c in rt if c not in lt):
        cols[c] = rc(c)
    simple = V.family(lt.get(on_left.names[0], T.NullType())) not in (V.ARRAY, V.OBJECT)
    for c, new in moved.items():
        same = Expressions(joined).compare("==", Val(lc(c), lt[c]), _key_value(joined, on_left, lt)) if simple else F.lit(False)
        both = F.when(only_left | only_right, F.lit(None)).when(F.coalesce(same, F.lit(False)), F.lit(None)).otherwise(rc(c))
        cols[new] = both
    return joined.select(*(v.alias(k) for k, v in cols.items()))


def _key_value(joined: DataFrame, path: Path, types: dict[str, T.DataType]) -> Val:
    (name, ix), rest = path.parts[0], path.parts[1:]
    return Expressions(joined).path(Path(((f"l.{name}", ix), *rest)))
