"""List, set and map functions on ARRAY and MAP columns, with 0-based list indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(a: Column, i: Column | int) -> Column:
    return F.lit(i) if isinstance(i, int) else i


def list_size(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0))


def list_index_of(a: Column, x: Column) -> Column:
    """-1 if absent."""
    return (F.coalesce(F.array_position(a, x), F.lit(0)) - 1).cast("int")


def list_contains(a: Column, x: Column) -> Column:
    return F.coalesce(F.array_contains(a, x), F.lit(False))


def list_get(a: Column, i: Column | int) -> Column:
    return F.try_element_at(a, _at(a, i) + 1)


def list_set(a: Column, i: Column | int, x: Column) -> Column:
    return F.transform(a, lambda v, j: F.when(j == _at(a, i), x).otherwise(v))


def list_add(a: Column, x: Column) -> Column:
    return F.array_append(a, x)


def list_insert(a: Column, i: Column | int, x: Column) -> Column:
    """The tail moves up."""
    return F.concat(F.slice(a, F.lit(1), _at(a, i)), F.array(x), list_slice(a, i, F.size(a)))


def list_insert_all(a: Column, i: Column | int, c: Column) -> Column:
    return F.concat(F.slice(a, F.lit(1), _at(a, i)), c, list_slice(a, i, F.size(a)))


def list_remove_at(a: Column, i: Column | int) -> Column:
    """The tail moves down; an index out of range changes nothing."""
    return F.filter(a, lambda v, j: j != _at(a, i))


def list_remove(a: Column, x: Column) -> Column:
    """Only the first occurrence."""
    at = F.array_position(a, x)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.filter(a, lambda v, j: j + 1 != at)).otherwise(a)


def list_remove_all(a: Column, c: Column) -> Column:
    """One occurrence for each element of c."""
    return F.aggregate(c, a, lambda left, x: F.filter(left, lambda v, j: j + 1 != F.coalesce(F.array_position(left, x), F.lit(0))))


def list_retain_all(a: Column, c: Column) -> Column:
    """First occurrences of elements that c lacks go, one for each such element of the list."""
    return list_remove_all(a, F.filter(a, lambda v: ~F.array_contains(c, v)))


def list_slice(a: Column, start: Column | int, end: Column | int) -> Column:
    """From start up to, not including, end."""
    s, e = _at(a, start), _at(a, end)
    return F.filter(a, lambda v, j: (j >= s) & (j < e))


def list_clear(a: Column) -> Column:
    return F.slice(a, 1, 0)


def list_last_index_of(*_: object) -> Column:
    raise NotImplementedError("lists have no lastIndexOf")


def list_iterator(*_: object) -> Column:
    raise NotImplementedError("lists have no list iterator")


def set_add(a: Column, x: Column) -> Column:
    return F.array_union(a, F.array(x))


def set_remove(a: Column, x: Column) -> Column:
    return F.array_remove(a, x)


def set_retain_all(a: Column, c: Column) -> Column:
    return F.array_intersect(a, c)


def set_remove_all(a: Column, c: Column) -> Column:
    return F.array_except(a, c)


def set_add_all(a: Column, c: Column) -> Column:
    return F.array_union(a, c)


def set_contains_all(a: Column, c: Column) -> Column:
    return F.forall(c, lambda x: F.array_contains(a, x))


def set_for_each(*_: object) -> Column:
    raise NotImplementedError("sets have no forEach, removeIf or spliterator")


def map_put(m: Column, k: Column, v: Column) -> Column:
    """The last value of a key wins, whatever the session's policy."""
    return F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))


def map_put_all(m: Column, other: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda x, _: ~F.map_contains_key(other, x)), other)


def map_remove(m: Column, k: Column) -> Column:
    return F.map_filter(m, lambda x, _: x != k)


def map_get(m: Column, k: Column) -> Column:
    return F.try_element_at(m, k)


def map_contains_value(m: Column, v: Column) -> Column:
    return F.array_contains(F.map_values(m), v)


def map_clear(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: F.lit(False))
