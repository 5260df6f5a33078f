"""Schemas held as statements: definitions, kinds of properties, hierarchies, removal, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import vocabulary as V
from stratalog.functions.checkpoint import settle
from stratalog.functions.statements import fits, is_property_definition

_KINDS = ("SINGLE", "LIST", "MAP", "SET")


def _statements(df: DataFrame, rows: list[tuple[Column, str | Column, str | Column, str | None]], extra: list[str] = ()) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    each = F.array(*[F.struct(s.alias("subject"), lit(p).alias("predicate"), lit(o).cast("string").alias("object"), F.lit(d).cast("string").alias("datatype")) for s, p, o, d in rows])
    return df.select(*extra, F.explode(each).alias("_t")).select(*extra, "_t.*")


def classes(df: DataFrame) -> DataFrame:
    """Statements that define classes.  df: class, and super (null for none)."""
    own = _statements(df, [(F.col("class"), V.TYPE, V.CLASS, None)])
    return own.union(_statements(df.where("super is not null"), [(F.col("class"), V.SUB_CLASS, F.col("super"), None)])).distinct()


def define(df: DataFrame) -> DataFrame:
    """Statements that define properties.  df: property, kind (SINGLE, LIST, MAP or SET), domain, range, literal."""
    p, dom, ran, lit = F.col("property"), F.col("domain"), F.col("range"), F.col("literal")
    kind = lambda k: df.where(F.col("kind") == k)
    typed = F.when(lit, V.DATA_PROPERTY).otherwise(V.OBJECT_PROPERTY)
    plain = [(p, V.TYPE, typed, None), (p, V.DOMAIN, dom, None), (p, V.RANGE, ran, None)]
    one = F.concat(F.lit("anon::"), p, F.lit("::maxOneCardinality"))
    none = F.lit(None).cast("string")

    def at_most_one(holder: Column, target: Column, data: Column) -> list[tuple]:
        """A restriction to one value, qualified by what it points to unless that is anything."""
        anything = target.isin(V.OWL + "Thing", V.RDFS + "Literal")
        bound = F.when(anything, V.OWL + "maxCardinality").otherwise(V.OWL + "maxQualifiedCardinality")
        qualifier = F.when(~anything, F.when(data, V.OWL + "onDataRange").otherwise(V.OWL + "onClass")).otherwise(none)
        return [(one, V.TYPE, V.OWL + "Restriction", None), (one, V.OWL + "onProperty", p, None), (one, bound, "1", V.XSD + "nonNegativeInteger"), (one, qualifier, target, None), (holder, V.SUB_CLASS, one, None)]

    single = [*plain, *at_most_one(dom, ran, lit), (p, V.SUB_PROPERTY, F.when(lit, V.SINGLE_LITERAL).otherwise(V.SINGLE_OBJECT), None)]
    listed, member = F.concat(p, F.lit("_list")), F.concat(p, F.when(lit, "_liLiteral").otherwise("_liObject"))
    only = F.concat(F.lit("anon::"), member, F.lit("::valueRestriction"))
    as_list = [(listed, V.TYPE, V.CLASS, None), (listed, V.SUB_CLASS, V.LIST_CLASS, None), (p, V.TYPE, V.OBJECT_PROPERTY, None), (p, V.DOMAIN, dom, None), (p, V.RANGE, listed, None), *at_most_one(dom, listed, F.lit(False)), (p, V.SUB_PROPERTY, V.LIST_REF, None), (member, V.TYPE, typed, None), (member, V.SUB_PROPERTY, V.MEMBER, None), (member, V.DOMAIN, listed, None), (member, V.RANGE, ran, None), (only, V.TYPE, V.OWL + "Restriction", None), (only, V.OWL + "onProperty", member, None), (only, V.OWL + "allValuesFrom", ran, None), (listed, V.SUB_CLASS, only, None)]
    entry, value = F.concat(p, F.lit("EntryType")), F.concat(p, F.when(lit, "/literalValue").otherwise("/objectValue"))
    as_map = [(entry, V.TYPE, V.CLASS, None), (entry, V.SUB_CLASS, V.MAP_ENTRY, None), (p, V.TYPE, V.OBJECT_PROPERTY, None), (p, V.DOMAIN, dom, None), (p, V.RANGE, entry, None), (p, V.SUB_PROPERTY, V.MAP_REF, None), (value, V.TYPE, typed, None), (value, V.DOMAIN, entry, None), (value, V.RANGE, ran, None), (value, V.SUB_PROPERTY, F.when(lit, V.MAP_LITERAL).otherwise(V.MAP_OBJECT), None)]
    out = _statements(kind("SET"), plain)
    for k, rows in (("SINGLE", single), ("LIST", as_list), ("MAP", as_map)):
        out = out.union(_statements(kind(k), rows))
    return out.where("predicate is not null").distinct()


def define_new(df: DataFrame, state: DataFrame) -> DataFrame:
    """As define, but properties that are known already are refused."""
    return define(df.join(known_properties(state), "property", "left_anti"))


def meta_model(spark: SparkSession) -> DataFrame:
    """The statements that every graph starts with."""
    rows = [
        (V.SINGLE_LITERAL, V.TYPE, V.DATA_PROPERTY), (V.SINGLE_OBJECT, V.TYPE, V.OBJECT_PROPERTY),
        (V.MAP_ENTRY, V.TYPE, V.CLASS), (V.MAP_KEY, V.TYPE, V.DATA_PROPERTY), (V.MAP_KEY, V.DOMAIN, V.MAP_ENTRY), (V.MAP_KEY, V.RANGE, V.XSD + "string"),
        (V.MAP_LITERAL, V.TYPE, V.DATA_PROPERTY), (V.MAP_LITERAL, V.DOMAIN, V.MAP_ENTRY), (V.MAP_OBJECT, V.TYPE, V.OBJECT_PROPERTY), (V.MAP_OBJECT, V.DOMAIN, V.MAP_ENTRY),
        (V.MAP_OWNER, V.TYPE, V.OBJECT_PROPERTY), (V.MAP_OWNER, V.DOMAIN, V.MAP_ENTRY), (V.MAP_REF, V.TYPE, V.OBJECT_PROPERTY), (V.MAP_REF, V.RANGE, V.MAP_ENTRY),
        (V.LIST_OWNER, V.TYPE, V.OBJECT_PROPERTY), (V.LIST_OWNER, V.DOMAIN, V.LIST_CLASS), (V.LIST_REF, V.TYPE, V.OBJECT_PROPERTY), (V.LIST_REF, V.RANGE, V.LIST_CLASS), (V.MEMBER, V.TYPE, V.PROPERTY),
    ]
    return spark.createDataFrame([(*r, None) for r in rows], "subject string, predicate string, object string, datatype string")


def known_properties(state: DataFrame) -> DataFrame:
    """property: whatever is typed as one."""
    return state.where(is_property_definition()).select(F.col("subject").alias("property")).distinct()


def property_changes(ops: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Properties newly defined, and known ones no longer defined, by a commit (statement, op)."""
    about = ops.where(is_property_definition()).select(F.col("subject").alias("property"), "op").distinct()
    added = about.where("op = 'ADD'").select("property").join(known, "property", "left_anti")
    removed = about.where("op = 'REMOVE'").select("property").join(known, "property", "left_semi")
    return added.distinct(), removed.distinct()


def kinds(state: DataFrame) -> DataFrame:
    """property, kind, domain, range of every property: its kind follows from its super-properties."""
    markers = {V.SINGLE_LITERAL: "SINGLE", V.SINGLE_OBJECT: "SINGLE", V.LIST_REF: "LIST", V.MAP_REF: "MAP"}
    to_kind = F.create_map(*[F.lit(x) for kv in markers.items() for x in kv])
    named = state.groupBy(F.col("subject").alias("property")).agg(
        F.max(is_property_definition()).alias("_is"),
        F.max(F.when(F.col("predicate") == V.SUB_PROPERTY, F.try_element_at(to_kind, F.col("object")))).alias("kind"),
        F.min(F.when(F.col("predicate") == V.DOMAIN, F.col("object"))).alias("domain"),
        F.min(F.when(F.col("predicate") == V.RANGE, F.col("object"))).alias("range"),
    )
    return named.where("_is").select("property", F.coalesce("kind", F.lit("SET")).alias("kind"), "domain", "range")


def members(state: DataFrame) -> DataFrame:
    """property: what holds the elements of lists."""
    return state.where((F.col("predicate") == V.SUB_PROPERTY) & (F.col("object") == V.MEMBER)).select(F.col("subject").alias("property")).distinct()


def declared(state: DataFrame, cls: str) -> DataFrame:
    """The properties that name the class as their domain, without inference."""
    return state.where((F.col("predicate") == V.DOMAIN) & (F.col("object") == cls)).select(F.col("subject").alias("property")).distinct()


def closure(edges: DataFrame) -> DataFrame:
    """sub, super, depth (the least): pairs connected by one or more edges (sub, super).  Cycles end."""
    step = settle(edges.select("sub", "super").distinct().withColumn("depth", F.lit(1)))
    out, newest, n = step, step, 1
    while True:
        n += 1
        longer = newest.select("sub", F.col("super").alias("_via")).join(step.select(F.col("sub").alias("_via"), "super"), "_via").select("sub", "super").distinct().withColumn("depth", F.lit(n))
        newest = settle(longer.join(out.select("sub", "super"), ["sub", "super"], "left_anti"))
        if newest.isEmpty():
            return out
        out = out.union(newest)


def hierarchy(state: DataFrame, predicate: str = V.SUB_CLASS) -> DataFrame:
    return closure(state.where(F.col("predicate") == predicate).select(F.col("subject").alias("sub"), F.col("object").alias("super")))


def instances(state: DataFrame, base: str) -> DataFrame:
    """subject: instances of a class or of its subclasses, such as lists, map entries, or a class of the user's."""
    below = hierarchy(state).where(F.col("super") == base).select("sub").union(state.sparkSession.createDataFrame([(base,)], "sub string"))
    types = state.where(F.col("predicate") == V.TYPE)
    return types.join(below, types.object == below["sub"], "left_semi").select("subject").distinct()


def was_instance(ops: DataFrame, state: DataFrame, base: str) -> DataFrame:
    """subject: what a commit takes a type away from that is the class or a subclass; state has the classes."""
    return instances(hierarchy_rows(state).union(ops.where((F.col("op") == "REMOVE") & (F.col("predicate") == V.TYPE)).select(*V.STATEMENT)), base)


def hierarchy_rows(state: DataFrame) -> DataFrame:
    """The statements that make classes subclasses."""
    return state.where(F.col("predicate") == V.SUB_CLASS).select(*V.STATEMENT)


def has_map_entry_range(state: DataFrame) -> DataFrame:
    """property: those whose range is the class of map entries or a subclass."""
    below = hierarchy(state).where(F.col("super") == V.MAP_ENTRY).select("sub").union(state.sparkSession.createDataFrame([(V.MAP_ENTRY,)], "sub string"))
    return state.where(F.col("predicate") == V.RANGE).join(below, F.col("object") == F.col("sub"), "left_semi").select(F.col("subject").alias("property")).distinct()


def checked_maps(state: DataFrame, prop: str) -> DataFrame:
    """owner, key, value of a map property; an error unless its range is a class of map entries."""
    from stratalog.operators.containment import read_maps

    if has_map_entry_range(state).where(F.col("property") == prop).isEmpty():
        raise TypeError(f"{prop} has no map entries for its range")
    return read_maps(state, prop)


def value_type(uri: Column) -> Column:
    """A primitive-or-class type: uri and is_primitive.  Two are the same if their URIs are."""
    return F.struct(uri.alias("uri"), (uri.startswith(V.XSD) | (uri == V.RDFS + "Literal")).alias("is_primitive"))


def drop_properties(state: DataFrame, properties: DataFrame) -> DataFrame:
    """The graph without these properties (property) and what was made for them: list classes, entries, restrictions."""
    p = F.col("property")
    made = F.array(p, F.concat(p, F.lit("_list")), F.concat(p, F.lit("_liLiteral")), F.concat(p, F.lit("_liObject")), F.concat(p, F.lit("EntryType")), F.concat(p, F.lit("/literalValue")), F.concat(p, F.lit("/objectValue")), F.concat(F.lit("anon::"), p, F.lit("::maxOneCardinality")), F.concat(F.lit("anon::"), p, F.lit("_liLiteral::valueRestriction")), F.concat(F.lit("anon::"), p, F.lit("_liObject::valueRestriction")))
    gone = properties.select(F.explode(made).alias("_gone")).distinct()
    left = state.join(gone, state.subject == gone._gone, "left_anti")
    return left.join(gone, left.object == gone._gone, "left_anti")


def drop_class(state: DataFrame, cls: str, subclasses: bool = False) -> DataFrame:
    """The graph without a class and the properties of its domain, and without its subclasses if asked."""
    spark = state.sparkSession
    doomed = spark.createDataFrame([(cls,)], "_class string")
    if subclasses:
        doomed = doomed.union(hierarchy(state).where(F.col("super") == cls).select("sub"))
    owned = state.where(F.col("predicate") == V.DOMAIN).join(doomed, F.col("object") == F.col("_class"), "left_semi").select(F.col("subject").alias("property")).distinct()
    left = drop_properties(state, owned)
    return left.join(doomed, left.subject == doomed._class, "left_anti")


def single_violations(state: DataFrame, single: DataFrame) -> DataFrame:
    """branch_id, subject, predicate, n of single-valued properties (property) with more than one value."""
    keys = [c for c in ("branch_id",) if c in state.columns]
    values = state.join(single, state.predicate == single.property, "left_semi")
    return values.groupBy(*keys, "subject", "predicate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assignable_literals(values: DataFrame, datatype: str) -> tuple[DataFrame, DataFrame]:
    """Values (column object) that belong to a literal type, and those that do not."""
    ok = F.coalesce(fits(F.col("object"), datatype), F.lit(False))
    return values.where(ok), values.where(~ok)


def assignable_objects(values: DataFrame, state: DataFrame, cls: str) -> tuple[DataFrame, DataFrame]:
    """Values (column object) that are instances of the class or a subclass, and the others."""
    good = instances(state, cls).withColumnRenamed("subject", "object")
    return values.join(good, "object", "left_semi"), values.join(good, "object", "left_anti")


def strict(values: DataFrame, datatype: str) -> DataFrame:
    """The values, with an error at the first one that does not belong to the type."""
    ok = F.coalesce(fits(F.col("object"), datatype), F.lit(False))
    return values.where(F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("not assignable: "), F.coalesce("object", F.lit("null")))).cast("boolean")))
