"""Label maps and label names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_labels() -> Column:
    return F.expr("cast(map() as map<string,string>)")


def or_empty(labels: Column) -> Column:
    return F.coalesce(labels, empty_labels())


def let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` over a struct of values, each worked out once.

    A lambda evaluates whatever expression it captures again for every element. Handed in as fields of
    a bound struct, expensive expressions are evaluated once per row.
    """
    return F.get(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body), F.lit(0))


def overlay(base: Column, top: Column) -> Column:
    """Both maps in one; ``top`` wins. Independent of the session's map-key policy."""
    def both(s: Column) -> Column:
        kept = F.map_filter(s["base"], lambda k, _: ~F.map_contains_key(s["top"], k))
        return F.map_concat(kept, s["top"])
    return let(both, base=base, top=top)


def drop_absent(labels: Column) -> Column:
    """An empty value means the label is absent."""
    return F.map_filter(labels, lambda _, v: v.isNotNull() & (v != ""))


def drop_prefix(labels: Column, prefix: str = "__meta_") -> Column:
    return F.map_filter(labels, lambda k, _: ~F.startswith(k, F.lit(prefix)))


def set_label(labels: Column, name: str | Column, value: Column) -> Column:
    """Set one label; an empty or NULL value removes it."""
    key = F.lit(name) if isinstance(name, str) else name

    def changed(s: Column) -> Column:
        others = F.map_filter(s["labels"], lambda k, _: k != s["key"])
        return drop_absent(F.map_concat(others, F.create_map(s["key"], s["value"])))
    return let(changed, labels=labels, key=key, value=value)


def rename_keys(labels: Column, new_name: Callable[[Column], Column]) -> Column:
    """Rename keys; where two keys get one name, the later one in key order wins."""
    entries = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.struct(
        new_name(e["key"]).alias("key"), e["value"].alias("value")))

    def last_of(s: Column, name: Column) -> Column:
        return F.element_at(F.filter(s["entries"], lambda e: e["key"] == name), -1)["value"]

    def unique(s: Column) -> Column:
        names = F.array_distinct(F.transform(s["entries"], lambda e: e["key"]))
        return let(lambda n: F.map_from_arrays(n["names"], F.transform(n["names"], lambda x: last_of(s, x))), names=names)
    return let(unique, entries=entries)


def sanitize_label_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")


def object_labels(labels: Column, prefix: str) -> Column:
    """Labels and their ``present`` companions under ``<prefix>_`` and ``<prefix>present_``."""
    def both(s: Column) -> Column:
        values = rename_keys(s["source"], lambda k: F.concat(F.lit(prefix + "_"), sanitize_label_name(k)))
        present = rename_keys(s["source"], lambda k: F.concat(F.lit(prefix + "present_"), sanitize_label_name(k)))
        return F.map_concat(values, F.transform_values(present, lambda _, __: F.lit("true")))
    return let(both, source=or_empty(labels))


def labels_string(labels: Column) -> Column:
    """``k=v,k=v`` in name order: the comparable, groupable form of a label map."""
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def bool_label(flag: Column) -> Column:
    """A boolean or integer as label text."""
    return flag.cast("string")
