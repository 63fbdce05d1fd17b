"""Access flags of declarations as bitwise column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Access flags of the class-file format, then those that only the two analysis back ends know.
PUBLIC, PRIVATE, PROTECTED, STATIC, FINAL, SUPER, VARARGS, INTERFACE, ABSTRACT = 0x1, 0x2, 0x4, 0x8, 0x10, 0x20, 0x80, 0x200, 0x400
ANNOTATION, ENUM, MODULE, RECORD, DEPRECATED = 0x2000, 0x4000, 0x8000, 0x10000, 0x20000
MODULE_FLAG, VARARGS_FLAG, DEFAULT_FLAG = 1 << 51, 1 << 34, 1 << 43
DEPRECATED_FLAG, DEPRECATED_ANNOTATION, DEPRECATED_REMOVAL = 1 << 17, 1 << 46, 1 << 55
EXTRA_RECORD, EXTRA_SEALED, DEFAULT_ANNOTATION = 1 << 24, 1 << 28, 0x20000
#: A flag of binary members, and a bit among the tags of annotated ones.
DEPRECATED_BIT, TAG_DEPRECATED = 0x100000, 1 << 46
DEPRECATED_SIG = "Ljava/lang/Deprecated;"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def has(flags: Column | str, mask: int) -> Column:
    return _col(flags).bitwiseAND(F.lit(mask).cast("long")) != 0


def without(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.bitwise_not(F.lit(mask).cast("long")))


def add(flags: Column, mask: int, when: Column | None = None) -> Column:
    more = flags.bitwiseOR(F.lit(mask).cast("long"))
    return more if when is None else F.when(when, more).otherwise(flags)


def by_kind(kind: Column | str) -> Column:
    """Flags that a declaration's kind implies; a null kind (a class file) implies none."""
    k = _col(kind)
    return F.when(k == "INTERFACE", INTERFACE | ABSTRACT).when(k == "ENUM", ENUM | FINAL).when(k == "ANNOTATION", ANNOTATION | INTERFACE | ABSTRACT).when(k == "RECORD", RECORD | FINAL).otherwise(0).cast("long")


def class_flags(modifiers: Column | str, kind: Column | str) -> Column:
    raw = _col(modifiers).cast("long").bitwiseOR(by_kind(kind))
    return without(add(without(raw, MODULE), MODULE_FLAG, has(raw, MODULE)), SUPER)


def is_interface(modifiers: Column | str, kind: Column | str) -> Column:
    return F.when(_col(kind).isNotNull(), _col(kind).isin("INTERFACE", "ANNOTATION")).otherwise(has(_col(modifiers).cast("long"), INTERFACE))


def inner_class_flags(modifiers: Column | str, kind: Column | str, outer_modifiers: Column | str, outer_kind: Column | str) -> Column:
    flags = class_flags(modifiers, kind)
    from_source = _col(kind).isNotNull()
    flags = add(flags, PUBLIC | STATIC, from_source & is_interface(outer_modifiers, outer_kind))
    return add(flags, STATIC, from_source & _col(kind).isin("INTERFACE", "ANNOTATION", "ENUM", "RECORD"))


def field_flags(modifiers: Column | str, owner_kind: Column | str) -> Column:
    return add(_col(modifiers).cast("long"), PUBLIC | STATIC | FINAL, F.coalesce(_col(owner_kind).isin("INTERFACE", "ANNOTATION"), F.lit(False)))


def method_flags(modifiers: Column | str, varargs: Column | str, has_body: Column | str, owner_kind: Column | str, owner_modifiers: Column | str) -> Column:
    source_interface = F.coalesce(_col(owner_kind).isin("INTERFACE", "ANNOTATION"), F.lit(False))
    flags = add(without(_col(modifiers).cast("long"), VARARGS), VARARGS_FLAG, _col(varargs))
    flags = add(flags, PUBLIC, source_interface & ~has(flags, PUBLIC | PRIVATE | PROTECTED))
    flags = add(flags, ABSTRACT, source_interface & ~_col(has_body) & ~has(flags, PRIVATE | STATIC))
    return add(flags, DEFAULT_FLAG, is_interface(owner_modifiers, owner_kind) & _col(has_body) & ~has(flags, STATIC | PRIVATE | ABSTRACT))


def deprecated(annotations: Column | str) -> Column:
    """annotations: array of structs with type_sig."""
    return F.coalesce(F.exists(_col(annotations), lambda a: a["type_sig"] == DEPRECATED_SIG), F.lit(False))


def with_deprecation(flags: Column, annotations: Column | str) -> Column:
    """annotations: array of structs with type_sig and a map of JSON values."""
    found = F.filter(_col(annotations), lambda a: a["type_sig"] == DEPRECATED_SIG)
    removal = F.coalesce(F.exists(found, lambda a: a["values"]["forRemoval"] == "true"), F.lit(False))
    return add(add(flags, DEPRECATED_FLAG | DEPRECATED_ANNOTATION, deprecated(annotations)), DEPRECATED_REMOVAL, removal)


def binary_class_modifiers(modifiers: Column | str, kind: Column | str, permitted: Column | str, annotations: Column | str) -> Column:
    """The class modifiers of the other back end, which knows records and sealed types by flags of its own."""
    raw = _col(modifiers).cast("long").bitwiseOR(by_kind(kind))
    flags = add(without(raw, RECORD), EXTRA_RECORD, has(raw, RECORD))
    flags = add(flags, SUPER, ~has(flags, INTERFACE))
    flags = add(flags, EXTRA_SEALED, F.coalesce(F.size(_col(permitted)) > 0, F.lit(False)))
    return add(flags, DEPRECATED_BIT, deprecated(annotations))


def binary_method_modifiers(modifiers: Column | str, varargs: Column | str, has_body: Column | str, owner_kind: Column | str, has_default: Column | str) -> Column:
    source_interface = F.coalesce(_col(owner_kind).isin("INTERFACE", "ANNOTATION"), F.lit(False))
    flags = add(_col(modifiers).cast("long"), VARARGS, _col(varargs))
    flags = add(flags, PUBLIC, source_interface & ~has(flags, PUBLIC | PRIVATE | PROTECTED))
    flags = add(flags, ABSTRACT, source_interface & ~_col(has_body) & ~has(flags, PRIVATE | STATIC))
    return add(flags, DEFAULT_ANNOTATION, _col(has_default))


def binary_field_modifiers(modifiers: Column | str, owner_kind: Column | str, annotations: Column | str) -> Column:
    return add(field_flags(modifiers, owner_kind), DEPRECATED_BIT, deprecated(annotations))


def binary_inner_class_modifiers(modifiers: Column | str, kind: Column | str, permitted: Column | str, annotations: Column | str, outer_modifiers: Column | str, outer_kind: Column | str) -> Column:
    flags = binary_class_modifiers(modifiers, kind, permitted, annotations)
    from_source = _col(kind).isNotNull()
    flags = add(flags, PUBLIC | STATIC, from_source & is_interface(outer_modifiers, outer_kind))
    return add(flags, STATIC, from_source & _col(kind).isin("INTERFACE", "ANNOTATION", "ENUM", "RECORD"))


def annotation_tags(annotations: Column | str) -> Column:
    """Tag bits that annotations give: that of Deprecated."""
    return F.when(deprecated(annotations), F.lit(TAG_DEPRECATED)).otherwise(F.lit(0)).cast("long")


def symbol_kind(modifiers: Column | str, kind: Column | str) -> Column:
    m = _col(modifiers).cast("long")
    binary = F.when(has(m, ANNOTATION | INTERFACE), "Interface").when(has(m, ENUM), "Enum").otherwise("Class")
    return F.when(_col(kind).isNull(), binary).when(_col(kind).isin("INTERFACE", "ANNOTATION"), "Interface").when(_col(kind) == "ENUM", "Enum").otherwise("Class")


def completion_kind(modifiers: Column | str, kind: Column | str) -> Column:
    m = _col(modifiers).cast("long")
    binary = F.when(has(m, ANNOTATION | INTERFACE), "Interface").when(has(m, ENUM), "Enum").when(has(m, RECORD), "Struct").otherwise("Class")
    source = F.when(_col(kind).isin("INTERFACE", "ANNOTATION"), "Interface").when(_col(kind) == "ENUM", "Enum").when(_col(kind) == "RECORD", "Struct").otherwise("Class")
    return F.when(_col(kind).isNull(), binary).otherwise(source)


def is_visible_member(modifiers: Column, name: Column) -> Column:
    """Private members are not indexed, constructors are."""
    return ~has(modifiers.cast("long"), PRIVATE) | (name == "<init>")


def visible_members(members: Column | str) -> Column:
    """members: array of structs with modifiers and name."""
    return F.filter(_col(members), lambda x: is_visible_member(x["modifiers"], x["name"]))


def is_sealed(permitted: Column | str) -> Column:
    return F.coalesce(F.size(_col(permitted)) > 0, F.lit(False))
