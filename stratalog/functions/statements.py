"""Column functions on statements, names and literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratalog.functions import vocabulary as V


def is_uri(c: Column) -> Column:
    """Resources are URIs if they start with http, else blank nodes."""
    return c.startswith("http")


def resource_id(uri: Column, anonymous: Column) -> Column:
    return F.coalesce(uri, anonymous)


def container(df=None) -> Column:
    """The owner of a list or map element, or the subject itself."""
    return F.coalesce(F.col("containingsubject"), F.col("subject"))


def containment(df=None) -> Column:
    """The owner's property, or the predicate itself."""
    return F.coalesce(F.col("containmentpredicate"), F.col("predicate"))


def branch_name(uri: Column) -> Column:
    """What follows the last ::, null if there is none or nothing."""
    return F.when(F.instr(uri, "::") > 0, F.nullif(F.substring_index(uri, "::", -1), F.lit("")))


def branch_uri(repository: Column, name: Column) -> Column:
    return F.concat(repository, F.lit("::"), name)


def typed(value: Column, kind: str) -> Column:
    """A literal's value as boolean, byte, short, int, long, float, double or string; null if it has none."""
    return value.try_cast(V.TYPED[kind])


def fits(value: Column, datatype: str) -> Column:
    """Whether a lexical form belongs to an XSD type."""
    ok = value.rlike(V.LEXICAL.get(datatype, V.LEXICAL[V.XSD + "string"]))
    width = {V.XSD + "byte": "TINYINT", V.XSD + "short": "SMALLINT", V.XSD + "int": "INT", V.XSD + "long": "BIGINT"}.get(datatype)
    return ok & value.try_cast(width).isNotNull() if width else ok


def is_property_definition() -> Column:
    return (F.col("predicate") == V.TYPE) & F.col("object").isin(*V.PROPERTY_TYPES)


def is_entry_property(predicate: Column) -> Column:
    """A map entry's value property, told by the end of its name."""
    return predicate.rlike("(literalValue|objectValue)$")


def statement_key() -> Column:
    """One column that is equal exactly for equal statements (nulls included)."""
    return F.struct(*V.STATEMENT)


def same_statement(a, b, more: tuple[str, ...] = ()) -> Column:
    """A null-safe join condition on the statement and other columns."""
    out = F.lit(True)
    for c in (*more, *V.STATEMENT):
        out = out & a[c].eqNullSafe(b[c])
    return out
