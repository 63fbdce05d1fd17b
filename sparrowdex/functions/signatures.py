"""Descriptors and generic signatures of the class-file format, as signature strings.

A type is kept as its signature: primitives V Z B C S I J F D, arrays [x, variables Tname;, wildcards * +x -x, classes
Lname<args>; with .inner<args> for nested generic ones, and Usimple; for a name that is yet to be resolved.
"""

from __future__ import annotations

OBJECT, VOID = "Ljava/lang/Object;", "V"
PRIMITIVES = {"void": "V", "boolean": "Z", "byte": "B", "char": "C", "short": "S", "int": "I", "long": "J", "float": "F", "double": "D"}


def _type_end(sig: str, at: int) -> int:
    """Where the type that starts at `at` ends."""
    c = sig[at]
    if c in "VZBCSIJFD*":
        return at + 1
    if c in "[+-":
        return _type_end(sig, at + 1)
    if c == "T":
        return sig.index(";", at) + 1
    if c in "LU":
        depth = 0
        for i in range(at, len(sig)):
            depth += (sig[i] == "<") - (sig[i] == ">")
            if sig[i] == ";" and depth == 0:
                return i + 1
    raise ValueError(f"no type at {at} of {sig!r}")


def split_types(sig: str) -> list[str]:
    out, at = [], 0
    while at < len(sig):
        end = _type_end(sig, at)
        out.append(sig[at:end])
        at = end
    return out


def parse_field(descriptor: str | None) -> str:
    """A field's type; Object for what is no descriptor."""
    try:
        types = split_types(descriptor or "")
        return types[0] if len(types) == 1 else OBJECT
    except (ValueError, IndexError):
        return OBJECT


def parse_method(descriptor: str | None) -> tuple[list[str], str]:
    """(parameters, result) of a method descriptor; none and void for what is no descriptor."""
    try:
        inner, _, result = (descriptor or "")[1:].partition(")")
        return split_types(inner), split_types(result)[0]
    except (ValueError, IndexError):
        return [], VOID


def _formals(sig: str) -> tuple[list[dict], str]:
    """(type parameters, the rest) of a signature that may begin with <...>."""
    if not sig.startswith("<"):
        return [], sig
    depth, at = 0, 0
    for at, c in enumerate(sig):
        depth += (c == "<") - (c == ">")
        if depth == 0:
            break
    inner, out = sig[1:at], []
    while inner:
        name, _, inner = inner.partition(":")
        bounds = []
        if inner and inner[0] != ":":
            end = _type_end(inner, 0)
            bounds.append(inner[:end])
            inner = inner[end:]
        while inner.startswith(":"):
            end = _type_end(inner, 1)
            bounds.append(inner[1:end])
            inner = inner[end:]
        out.append({"name": name, "bounds": bounds or [OBJECT]})
    return out, sig[at + 1 :]


def class_signature(sig: str) -> tuple[list[dict], str | None, list[str]]:
    """(type parameters, superclass, interfaces) of a class's generic signature."""
    params, rest = _formals(sig)
    types = split_types(rest)
    return params, types[0] if types else None, types[1:]


def method_signature(sig: str) -> tuple[list[dict], list[str], str, list[str]]:
    """(type parameters, parameters, result, thrown types) of a method's generic signature."""
    type_params, rest = _formals(sig)
    inner, _, tail = rest[1:].partition(")")
    result, *thrown = tail.split("^")
    return type_params, split_types(inner), split_types(result)[0], thrown


def erase(sig: str, bounds: dict[str, str] | None = None) -> str:
    """The descriptor of a signature: no arguments, variables by their first bound."""
    if sig.startswith("["):
        return "[" + erase(sig[1:], bounds)
    if sig[:1] in ("+", "-", "*"):
        return erase(sig[1:], bounds) if sig.startswith("+") else OBJECT
    if sig.startswith("T"):
        bound = (bounds or {}).get(sig[1:-1], OBJECT)
        return erase(bound, {k: v for k, v in (bounds or {}).items() if k != sig[1:-1]})
    if sig[:1] not in ("L", "U"):
        return sig
    out, depth = [], 0
    for c in sig:
        depth += c == "<"
        if depth == 0:
            out.append("$" if c == "." else c)
        depth -= c == ">"
    return "".join(out)


def erased_name(sig: str) -> str | None:
    """The binary name of a class signature; None for primitives."""
    e = erase(sig)
    return e[1:-1] if e[:1] in ("L", "U") else None


def method_descriptor(params: list[str], result: str, bounds: dict[str, str] | None = None) -> str:
    return "(" + "".join(erase(p, bounds) for p in params) + ")" + erase(result, bounds)
