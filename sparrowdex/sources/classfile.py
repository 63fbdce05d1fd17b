"""Declarations of a compiled class, read from the bytes of the class-file format; code is skipped."""

from __future__ import annotations

import json
import struct

from ..functions import signatures

#: Fixed values of the format: bytes that follow each constant-pool tag, access flags.
SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
MODULE, SYNTHETIC, BRIDGE, VARARGS, PRIVATE, STATIC, RECORD = 0x8000, 0x1000, 0x40, 0x80, 0x2, 0x8, 0x10000
INNER_MASK = 0x1 | 0x2 | 0x4 | 0x8


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def u1(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def u2(self) -> int:
        self.at += 2
        return int.from_bytes(self.data[self.at - 2 : self.at])

    def u4(self) -> int:
        self.at += 4
        return int.from_bytes(self.data[self.at - 4 : self.at])

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise ValueError("the class file ends early")
        return self.data[self.at - n : self.at]


class ClassFile:
    def __init__(self, data: bytes):
        r = self.r = Reader(data)
        if r.u4() != 0xCAFEBABE:
            raise ValueError("no class file")
        r.take(4)
        self.pool: list = [None] * r.u2()
        i = 1
        while i < len(self.pool):
            tag = r.u1()
            self.pool[i] = (tag, r.take(r.u2()) if tag == 1 else r.take(SIZES[tag]))
            i += 2 if tag in (5, 6) else 1
        self.access = r.u2()
        self.this, self.super = self.name(r.u2()), self.name(r.u2())
        self.interfaces = [self.name(r.u2()) for _ in range(r.u2())]
        self.fields = [self.member() for _ in range(r.u2())]
        self.methods = [self.member() for _ in range(r.u2())]
        self.attributes = self.attrs()

    def text(self, i: int) -> str | None:
        if not i:
            return None
        raw = self.pool[i][1]
        try:
            return raw.decode()
        except UnicodeDecodeError:  # the format's own UTF-8: two-byte zeros and surrogates apart
            return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def name(self, i: int) -> str | None:
        """The text that a class, module, package or string entry points at."""
        return self.text(int.from_bytes(self.pool[i][1])) if i else None

    def constant(self, i: int, descriptor: str | None = None) -> dict | None:
        tag, raw = self.pool[i]
        kind = {3: ">i", 4: ">f", 5: ">q", 6: ">d"}.get(tag)
        if kind is None:
            return {"tag": "String", "i": None, "d": None, "s": self.name(i)} if tag == 8 else None
        value = struct.unpack(kind, raw)[0]
        if tag in (4, 6):
            return {"tag": "Float" if tag == 4 else "Double", "i": None, "d": value, "s": None}
        return {"tag": "Long" if tag == 5 else "Integer", "i": value, "d": None, "s": None}

    def attrs(self) -> dict[str, bytes]:
        return {self.text(self.r.u2()): self.r.take(self.r.u4()) for _ in range(self.r.u2())}

    def member(self):
        return self.r.u2(), self.text(self.r.u2()), self.text(self.r.u2()), self.attrs()

    # --- annotations ---

    def element(self, r: Reader):
        tag = chr(r.u1())
        if tag in "BCDFIJSZ":
            c = self.constant(r.u2())
            value = c["d"] if c["d"] is not None else c["i"]
            return bool(value) if tag == "Z" else chr(value & 0xFFFF) if tag == "C" else value
        if tag == "s":
            return self.text(r.u2())
        if tag == "e":
            return {"enum": self.text(r.u2()), "const": self.text(r.u2())}
        if tag == "c":
            return {"class": self.text(r.u2())}
        if tag == "@":
            return {"annotation": self.annotation(r)}
        if tag == "[":
            return [self.element(r) for _ in range(r.u2())]
        raise ValueError(f"no element value: {tag}")

    def annotation(self, r: Reader) -> dict:
        sig = self.text(r.u2())
        values = {}
        for _ in range(r.u2()):
            name = self.text(r.u2())
            values[name] = json.dumps(self.element(r), ensure_ascii=False, sort_keys=True)
        return {"type_sig": sig, "values": values}

    def annotations(self, attrs: dict[str, bytes]) -> list[dict]:
        out = []
        for name in ("RuntimeVisibleAnnotations", "RuntimeInvisibleAnnotations"):
            if name in attrs:
                r = Reader(attrs[name])
                out += [self.annotation(r) for _ in range(r.u2())]
        return out

    def parameter_annotations(self, attrs: dict[str, bytes], n: int) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(n)]
        for name in ("RuntimeVisibleParameterAnnotations", "RuntimeInvisibleParameterAnnotations"):
            if name in attrs:
                r = Reader(attrs[name])
                count = r.u1()
                for k in range(count):  # synthetic leading parameters have no entry
                    found = [self.annotation(r) for _ in range(r.u2())]
                    if 0 <= k + n - count < n:
                        out[k + n - count] += found
        return out

    # --- rows ---

    def field_row(self, m) -> dict:
        access, name, descriptor, attrs = m
        sig = self.text(int.from_bytes(attrs["Signature"])) if "Signature" in attrs else descriptor
        const = self.constant(int.from_bytes(attrs["ConstantValue"])) if "ConstantValue" in attrs else None
        return {"modifiers": access, "name": name, "sig": sig or signatures.OBJECT, "const": const, "annotations": self.annotations(attrs)}

    def method_row(self, m) -> dict:
        access, name, descriptor, attrs = m
        params, result = signatures.parse_method(descriptor)
        type_params: list = []
        thrown = [f"L{self.name(i)};" for i in struct.unpack(f">{len(attrs['Exceptions']) // 2}H", attrs["Exceptions"])[1:]] if "Exceptions" in attrs else []
        if "Signature" in attrs:
            try:
                type_params, generic, result, more = signatures.method_signature(self.text(int.from_bytes(attrs["Signature"])))
                params, thrown = generic or params, more or thrown
            except (ValueError, IndexError):
                pass
        names: list = []
        if "MethodParameters" in attrs:
            r = Reader(attrs["MethodParameters"])
            names = [(self.text(r.u2()), r.u2()) for _ in range(r.u1())]
        marked = self.parameter_annotations(attrs, len(params))
        rows = [{"name": names[k][0] if len(names) == len(params) else None, "modifiers": names[k][1] if len(names) == len(params) else 0, "sig": p, "annotations": marked[k]} for k, p in enumerate(params)]
        default = json.dumps(self.element(Reader(attrs["AnnotationDefault"])), ensure_ascii=False, sort_keys=True) if "AnnotationDefault" in attrs else None
        return {"modifiers": access, "name": name, "return_sig": result, "params": rows, "throws": thrown, "type_params": type_params, "varargs": bool(access & VARARGS), "has_body": "Code" in attrs, "annotation_default": default, "annotations": self.annotations(attrs)}

    def type_row(self) -> dict | None:
        """The row of a type; None for a module, a package or a private nested type."""
        a = self.attributes
        simple = (self.this or "").rpartition("/")[2]
        if self.access & MODULE or simple in ("module-info", "package-info"):
            return None
        modifiers, inner = self.access, []
        if "InnerClasses" in a:
            r = Reader(a["InnerClasses"])
            for _ in range(r.u2()):
                name, outer, short, flags = self.name(r.u2()), self.name(r.u2()), self.text(r.u2()), r.u2()
                if name == self.this:
                    modifiers = modifiers & ~INNER_MASK | flags & INNER_MASK
                elif outer == self.this and short and not flags & (PRIVATE | SYNTHETIC):
                    inner.append(name)
        if modifiers & PRIVATE:
            return None
        type_params: list = []
        sup, interfaces = f"L{self.super};" if self.super else None, [f"L{i};" for i in self.interfaces]
        if "Signature" in a:
            try:
                type_params, sup, interfaces = signatures.class_signature(self.text(int.from_bytes(a["Signature"])))
            except (ValueError, IndexError):
                pass
        permitted = [self.name(i) for i in struct.unpack(f">{len(a['PermittedSubclasses']) // 2}H", a["PermittedSubclasses"])[1:]] if "PermittedSubclasses" in a else []
        components = []
        if "Record" in a:
            saved, self.r = self.r, Reader(a["Record"])
            for _ in range(self.r.u2()):
                name, descriptor, attrs = self.text(self.r.u2()), self.text(self.r.u2()), self.attrs()
                sig = self.text(int.from_bytes(attrs["Signature"])) if "Signature" in attrs else descriptor
                components.append({"name": name, "sig": sig, "annotations": self.annotations(attrs)})
            self.r = saved
            modifiers |= RECORD
        shown = lambda m: not m[0] & SYNTHETIC and (not m[0] & PRIVATE or m[1] == "<init>") and m[1] != "<clinit>"
        return {
            "jvm_name": self.this, "modifiers": modifiers, "decl_kind": None, "super_sig": sup, "interface_sigs": interfaces, "type_params": type_params,
            "fields": [self.field_row(m) for m in self.fields if shown(m)], "methods": [self.method_row(m) for m in self.methods if shown(m)], "inner_types": inner, "permitted": permitted,
            "record_components": components, "annotations": self.annotations(a), "hints": None,
        }

    def module_row(self) -> dict | None:
        if "Module" not in self.attributes:
            return None
        r, a = Reader(self.attributes["Module"]), self.attributes
        name, flags, version = self.name(r.u2()), r.u2(), self.text(r.u2())
        requires = [{"module": self.name(r.u2()), "flags": r.u2(), "version": self.text(r.u2())} for _ in range(r.u2())]
        opened = lambda: [{"package": self.name(r.u2()), "flags": r.u2(), "to": [self.name(r.u2()) for _ in range(r.u2())]} for _ in range(r.u2())]
        exports, opens = opened(), opened()
        uses = [self.name(r.u2()) for _ in range(r.u2())]
        provides = [{"service": self.name(r.u2()), "impls": [self.name(r.u2()) for _ in range(r.u2())]} for _ in range(r.u2())]
        packages = [self.name(i) for i in struct.unpack(f">{len(a['ModulePackages']) // 2}H", a["ModulePackages"])[1:]] if "ModulePackages" in a else []
        main = self.name(int.from_bytes(a["ModuleMainClass"])) if "ModuleMainClass" in a else None
        return {"name": name, "version": version, "flags": flags, "requires": requires, "exports": exports, "opens": opens, "uses": uses, "provides": provides, "packages": packages, "main_class": main}

    def names(self, surface: bool = False) -> list[str]:
        """Simple names that the class mentions: of all class entries, or of its declared surface; own members too."""
        out = {m[1] for m in (*self.fields, *self.methods) if m[1] and m[1][0] != "<"}
        if surface:
            sigs = [m[2] for m in (*self.fields, *self.methods)] + [f"L{x};" for x in (self.this, self.super, *self.interfaces) if x]
            parts = [p for s in sigs for p in signatures.split_types(s.translate({40: None, 41: None}))]
            out |= {n.rpartition("/")[2].rpartition("$")[2] for p in parts if (n := signatures.erased_name(p.lstrip("[")))}
        else:
            for entry in self.pool:
                if entry and entry[0] == 7:
                    n = (self.text(int.from_bytes(entry[1])) or "").lstrip("[").removeprefix("L").rstrip(";")
                    out.add(n.rpartition("/")[2].rpartition("$")[2])
        return sorted(x for x in out if x)


def parse(data: bytes, surface_names: bool = False) -> tuple[list[dict], list[dict], list[str]]:
    """(types, modules, names) of a class file."""
    c = ClassFile(data)
    row, module = c.type_row(), c.module_row()
    return [row] if row else [], [module] if module else [], c.names(surface_names)
