"""Which owner and property the statements of list and map elements belong to; collections as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratalog.functions import vocabulary as V


def owners(statements: DataFrame) -> DataFrame:
    """element, owner, property: of elements with an owner that one property links them to.

    The super-property of lists or maps counts only if no other links them.
    """
    refs = statements.where(F.col("predicate").isin(V.LIST_OWNER, V.MAP_OWNER)).select(F.col("subject").alias("element"), F.col("object").alias("owner")).distinct()
    links = statements.where(F.col("datatype").isNull()).select(F.col("subject").alias("owner"), F.col("predicate").alias("property"), F.col("object").alias("element"))
    own = links.join(refs, ["owner", "element"]).distinct()
    general = F.col("property").isin(V.LIST_REF, V.MAP_REF)
    count = own.groupBy("element", "owner").agg(F.count_if(~general).alias("_n"), F.min(F.when(~general, F.col("property"))).alias("_one"), F.min("property").alias("_any"), F.count(F.lit(1)).alias("_all"))
    sole = count.where("_n = 1 or (_n = 0 and _all = 1)").select("element", "owner", F.coalesce("_one", "_any").alias("property"))
    return sole.join(sole.groupBy("element").agg(F.count(F.lit(1)).alias("_k")).where("_k = 1").select("element"), "element")


def classes_of(statements: DataFrame) -> DataFrame:
    """element: subjects that are classes, which nothing owns."""
    return statements.where((F.col("predicate") == V.TYPE) & (F.col("object") == V.CLASS)).select(F.col("subject").alias("element")).distinct()


def attribute(ops: DataFrame, state: DataFrame) -> DataFrame:
    """ops with containingsubject and containmentpredicate: from the graph, or for deleted elements from the commit's removals.

    Subjects that are classes, without an owner, or with several, keep nulls.
    """
    now = owners(state)
    gone = owners(ops.where("op = 'REMOVE'"))
    typed_gone = ops.where((F.col("op") == "REMOVE") & (F.col("predicate") == V.TYPE)).select(F.col("subject").alias("element")).distinct()
    before = gone.join(typed_gone, "element", "left_semi")
    found = now.join(before.select("element"), "element", "left_anti").union(before)
    found = found.join(classes_of(state), "element", "left_anti")
    named = found.select(F.col("element").alias("_e"), F.col("owner").alias("containingsubject"), F.col("property").alias("containmentpredicate"))
    return ops.join(named, ops.subject == named._e, "left").drop("_e")


def attribute_typed(ops: DataFrame, state: DataFrame, schema: DataFrame) -> DataFrame:
    """attribute, decided by type: elements that are or were map entries first, then lists; others have no owner.

    schema has the classes; types stand in the graph or, for deleted elements, in the commit's removals.
    """
    from stratalog.operators.ontology import hierarchy_rows, instances

    gone = ops.where((F.col("op") == "REMOVE") & (F.col("predicate") == V.TYPE)).select(*V.STATEMENT)
    known = state.select(*V.STATEMENT).union(gone).union(hierarchy_rows(schema))
    entries, seqs = instances(known, V.MAP_ENTRY).withColumn("_rank", F.lit(1)), instances(known, V.LIST_CLASS).withColumn("_rank", F.lit(2))
    kinds = entries.union(seqs).groupBy("subject").agg(F.min("_rank").alias("_rank"))

    def of(rank: int, other: str) -> DataFrame:
        """Elements of one kind; what refers to owners of the other kind does not count."""
        found = attribute(ops.where(F.col("predicate") != other), state.where(F.col("predicate") != other))
        mine = kinds.where(F.col("_rank") == rank).select("subject")
        named = found.where("containingsubject is not null").select("subject", "containingsubject", "containmentpredicate").distinct()
        return ops.join(mine, "subject", "left_semi").join(named, "subject", "left").select(*ops.columns, "containingsubject", "containmentpredicate")

    rest = ops.join(kinds.select("subject"), "subject", "left_anti").select(*ops.columns)
    null = F.lit(None).cast("string")
    return of(1, V.LIST_OWNER).union(of(2, V.MAP_OWNER)).union(rest.withColumn("containingsubject", null).withColumn("containmentpredicate", null))


def per_instance(ops: DataFrame, group: list[str]) -> DataFrame:
    """The operations of each subject, in the order in which subjects are first touched; additions before removals.

    ops: statement, op and seq.  rank is the place of the subject in its group, pos that of the operation.
    """
    first = F.min("seq").over(W.partitionBy(*group, "subject"))
    touched = ops.withColumn("first_touch", first)
    rank = F.dense_rank().over(W.partitionBy(*group).orderBy("first_touch", "subject"))
    pos = F.row_number().over(W.partitionBy(*group, "subject").orderBy("op", "seq"))
    return touched.withColumn("rank", rank).withColumn("pos", pos)


def get_or_create_lists(df: DataFrame, state: DataFrame) -> DataFrame:
    """The statements of lists that owners lack: type, back-reference, link and the list class of the property.

    df: owner, property and range (the list class).  A list is named by its owner, # and the local name of the property.
    """
    there = state.select(F.col("subject").alias("owner"), F.col("predicate").alias("property")).distinct()
    new = df.join(there, ["owner", "property"], "left_anti")
    node = F.concat("owner", F.lit("#"), F.regexp_extract("property", "([^#/]*)$", 1))
    row = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate") if isinstance(p, str) else p.alias("predicate"), o.alias("object"), F.lit(None).cast("string").alias("datatype"))
    rows = F.array(row(node, V.TYPE, F.lit(V.LIST_CLASS)), row(node, V.TYPE, F.col("range")), row(node, V.LIST_OWNER, F.col("owner")), row(F.col("owner"), F.col("property"), node))
    return new.select(F.explode(rows).alias("t")).select("t.*").distinct()


def delete_lists(state: DataFrame, lists_: DataFrame) -> DataFrame:
    """The graph without the statements of these lists (column list); links of owners to them stay."""
    return state.join(lists_, state.subject == lists_["list"], "left_anti")


def put_change(state: DataFrame, puts: DataFrame, prop: str) -> DataFrame:
    """The operations (statement, op) of putting a literal under a key of each owner's map.  puts: owner, key, value.

    A new key makes five statements; for a known one only the value is replaced, if it differs.
    """
    entry = F.col("entry")
    link = state.where(F.col("predicate") == prop).select(F.col("subject").alias("owner"), F.col("object").alias("entry"))
    keys = state.where(F.col("predicate") == V.MAP_KEY).select(F.col("subject").alias("entry"), F.col("object").alias("key"))
    values = state.where(F.col("predicate") == V.MAP_LITERAL).select(F.col("subject").alias("entry"), F.col("object").alias("old"), F.col("datatype").alias("old_type"))
    known = puts.join(link.join(keys, "entry").join(values, "entry", "left"), ["owner", "key"])
    string = F.lit(V.XSD + "string")
    row = lambda o, d, op: F.struct(entry.alias("subject"), F.lit(V.MAP_LITERAL).alias("predicate"), o.alias("object"), d.alias("datatype"), F.lit(op).alias("op"))
    changed = known.where(~F.col("old").eqNullSafe(F.col("value")))
    replaced = changed.select(F.explode(F.filter(F.array(row(F.col("old"), F.col("old_type"), "REMOVE"), row(F.col("value"), string, "ADD")), lambda r: r["object"].isNotNull())).alias("t")).select("t.*")
    new = puts.join(known.select("owner", "key"), ["owner", "key"], "left_anti")
    made = map_statements(new.select("owner", F.create_map("key", "value").alias("entries")), "owner", "entries", prop)
    return replaced.union(made.withColumn("op", F.lit("ADD")))


def lists(rows: DataFrame, owner: list[str], order: str, value: str) -> DataFrame:
    """A list for each owner, in order."""
    return rows.groupBy(*owner).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda x: x["v"]).alias("items"))


def sets(rows: DataFrame, owner: list[str], value: str) -> DataFrame:
    return rows.groupBy(*owner).agg(F.array_sort(F.collect_set(value)).alias("items"))


def maps(rows: DataFrame, owner: list[str], key: str, value: str, order: str) -> DataFrame:
    """A map for each owner; the last value of a key holds."""
    last = rows.groupBy(*owner, key).agg(F.max_by(value, order).alias("_v"))
    return last.groupBy(*owner).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), F.col("_v")))).alias("entries"))


def list_statements(df: DataFrame, owner: str, items: str) -> DataFrame:
    """owner, predicate (rdf:_1 and on) and object of each element."""
    each = df.select(F.col(owner).alias("owner"), F.posexplode(items).alias("_i", "object"))
    return each.select("owner", F.concat(F.lit(V.RDF + "_"), (F.col("_i") + 1).cast("string")).alias("predicate"), F.col("object").cast("string").alias("object"))


def list_change(df: DataFrame, owner: str, before: str, after: str) -> DataFrame:
    """owner, predicate, object, op: the statements that differ between two lists."""
    a, b = list_statements(df, owner, before), list_statements(df, owner, after)
    keys = ["owner", "predicate", "object"]
    gone, new = a.join(b, keys, "left_anti"), b.join(a, keys, "left_anti")
    return gone.withColumn("op", F.lit("REMOVE")).union(new.withColumn("op", F.lit("ADD")))


def map_statements(df: DataFrame, owner: str, entries: str, prop: str, literal: bool = True) -> DataFrame:
    """The five statements of each entry: type, back-reference, key, value and link."""
    e = df.select(F.col(owner).alias("_o"), F.explode(entries).alias("_k", "_v"))
    node = F.concat_ws("/", "_o", F.lit(prop), "_k")
    string = V.XSD + "string"
    row = lambda s, p, o, d: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.cast("string").alias("object"), F.lit(d).cast("string").alias("datatype"))
    value = row(node, V.MAP_LITERAL if literal else V.MAP_OBJECT, F.col("_v"), string if literal else None)
    rows = F.array(row(node, V.TYPE, F.lit(V.MAP_ENTRY), None), row(node, V.MAP_OWNER, F.col("_o"), None), row(node, V.MAP_KEY, F.col("_k"), string), value, row(F.col("_o"), prop, node, None))
    return e.select(F.explode(rows).alias("t")).select("t.*")


def read_maps(statements: DataFrame, prop: str) -> DataFrame:
    """owner, key, value of a map property; literals before objects, entries without key or value left out."""
    link = statements.where(F.col("predicate") == prop).select(F.col("subject").alias("owner"), F.col("object").alias("entry"))
    parts = statements.where(F.col("predicate").isin(V.MAP_KEY, V.MAP_LITERAL, V.MAP_OBJECT)).groupBy(F.col("subject").alias("entry")).agg(
        *[F.max(F.when(F.col("predicate") == p, F.col("object"))).alias(n) for p, n in ((V.MAP_KEY, "key"), (V.MAP_LITERAL, "_l"), (V.MAP_OBJECT, "_o"))]
    )
    found = link.join(parts, "entry").select("owner", "key", F.coalesce("_l", "_o").alias("value"))
    return found.where("key is not null and value is not null")
