"""Declarations and name occurrences of a Java source file: a lexer that drops comments, then a declaration parser.

Bodies are skipped by matching braces. Types are signature strings; a simple name that cannot be told is Usimple; until
it is resolved. A dotted selection is cut at its first segment in upper case, as files are parsed apart from each other.
"""

from __future__ import annotations

import json
import re

from ..functions.signatures import OBJECT, PRIMITIVES

TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"""(?:\\.|(?!""").)*?""")|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<char>\'(?:\\.|[^\'\\\n])+\')|(?P<number>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|\.?\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?)[lLfFdD]?)|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<op>\.\.\.|::|->|@(?=\s*interface\b)|.)',
    re.S,
)
#: Explicit modifiers and their access flags; declaration words and their kinds.
MODIFIERS = {"public": 0x1, "private": 0x2, "protected": 0x4, "static": 0x8, "final": 0x10, "synchronized": 0x20, "volatile": 0x40, "transient": 0x80, "native": 0x100, "abstract": 0x400, "strictfp": 0x800}
KINDS = {"class": "CLASS", "interface": "INTERFACE", "enum": "ENUM", "record": "RECORD"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0", "s": " "}
#: Words that are no identifiers.
RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while _".split()
)
PRIVATE = 0x2


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, offset) of each token."""
    return [(m.lastgroup, m.group(), m.start()) for m in TOKEN.finditer(text) if m.lastgroup != "skip"]


def identifiers(text: str) -> list[str]:
    """The distinct identifiers of a file, comments, literals and reserved words apart."""
    return sorted({v for k, v, _ in tokens(text) if k == "name" and v not in RESERVED})


def stripped(body: str) -> str:
    """The content of a text block: without the indentation that its lines share and without spaces at their ends."""
    lines = body.split("\n")
    counted = [x for x in lines[:-1] if x.strip()] + lines[-1:]
    shared = min((len(x) - len(x.lstrip(" \t")) for x in counted), default=0)
    return "\n".join(x[shared:].rstrip(" \t") if x.strip() else "" for x in lines)


def unescape(body: str) -> str:
    body = re.sub(r"\\\n", "", body)  # a line that goes on
    return re.sub(r"\\(u+[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1].lstrip("u"), 16)) if len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), body, flags=re.S)


class Parser:
    def __init__(self, text: str):
        self.t = tokens(text)
        self.at = 0
        self.package = ""
        self.single: dict[str, str] = {}
        self.on_demand: list[str] = []
        self.types: list[dict] = []
        self.siblings: list[str] = []
        self.skipped: list[int] = []  # tokens at which members begin that do not parse
        self.declared: dict[int, dict] = {}  # by the token of the name
        self.bodies: list[tuple[int, int, str]] = []  # first token, last token, type
        self.code: list[tuple[int, int]] = []  # of methods, with their parameters
        self.imported: list[tuple[int, list[str], bool]] = []  # token of the last name, names, whether static
        self.head = 0  # tokens of the package and the imports
        self.around: list[str] = []  # the types that the parser is in

    # --- tokens ---

    def peek(self, k: int = 0) -> str:
        return self.t[self.at + k][1] if self.at + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.at + k][0] if self.at + k < len(self.t) else "end"

    def next(self) -> str:
        if self.at >= len(self.t):
            raise ValueError("the source ends early")
        self.at += 1
        return self.t[self.at - 1][1]

    def accept(self, value: str) -> bool:
        if self.kind() in ("name", "op") and self.peek() == value:
            self.at += 1
            return True
        return False

    def skip_block(self, opening: str = "{", closing: str = "}"):
        """Past a block whose opening is next."""
        depth = 0
        while self.at < len(self.t):
            kind, v, _ = self.t[self.at]
            self.at += 1
            depth += (kind == "op") * ((v == opening) - (v == closing))
            if depth == 0:
                return

    def skip_to(self, *ends: str):
        """To the next of `ends` outside of brackets; it stays."""
        depth = 0
        while self.at < len(self.t):
            kind, v, _ = self.t[self.at]
            if kind == "op":
                if depth == 0 and v in ends:
                    return
                depth += (v in "([{") - (v in ")]}")
            self.at += 1

    def dotted(self) -> list[str]:
        out = [self.next()]
        while self.peek() == "." and self.kind(1) == "name":
            self.at += 1
            out.append(self.next())
        return out

    # --- compilation unit ---

    def unit(self) -> list[dict]:
        self.annotations()
        if self.accept("package"):
            self.package = "/".join(self.dotted())
            self.accept(";")
        while self.accept("import"):
            static = self.accept("static")
            parts = self.dotted()
            last = self.at - 1
            star = self.accept(".") and self.accept("*")
            if not star:
                self.imported.append((last, parts, static))
            self.accept(";")
            if not static:
                if star:
                    self.on_demand.append(self.jvm(parts))
                else:
                    self.single[parts[-1]] = self.jvm(parts)
        self.head = self.at
        while self.at < len(self.t):
            if self.accept(";"):
                continue
            start = self.at
            modifiers, annotations = self.modifiers()
            if not self.declaration(modifiers, annotations, None, []):
                if self.peek() in ("module", "open"):
                    break
                self.at = max(self.at, start + 1)
        hints = {"source_package": self.package, "single_imports": self.single, "on_demand": self.on_demand, "siblings": self.siblings}
        for t in self.types:
            t["hints"] = hints
        return self.types

    @staticmethod
    def jvm(parts: list[str]) -> str:
        first = next((i for i, p in enumerate(parts) if p[:1].isupper()), len(parts) - 1)
        return "/".join(parts[: first + 1]) + "".join("$" + p for p in parts[first + 1 :])

    # --- modifiers and annotations ---

    def modifiers(self) -> tuple[int, list[dict]]:
        flags, found = 0, []
        while True:
            v = self.peek()
            if v == "@" and self.peek(1) != "interface":
                found.append(self.annotation())
            elif self.kind() == "name" and v in MODIFIERS:
                flags |= MODIFIERS[self.next()]
            elif v in ("default", "sealed") and self.kind(1) in ("name", "op") and self.peek(1) not in ("(", "=", ";", ",", "."):
                self.at += 1
            elif v == "non" and self.peek(1) == "-" and self.peek(2) == "sealed":
                self.at += 3
            else:
                return flags, found

    def annotations(self) -> list[dict]:
        found = []
        while self.peek() == "@" and self.peek(1) != "interface":
            found.append(self.annotation())
        return found

    def annotation(self) -> dict:
        self.accept("@")
        sig = self.class_sig(self.dotted(), [], {})
        values: dict[str, str] = {}
        if self.accept("("):
            while not self.accept(")"):
                name = "value"
                if self.kind() == "name" and self.peek(1) == "=" and self.peek(2) != "=":
                    name = self.next()
                    self.at += 1
                values[name] = json.dumps(self.value(), ensure_ascii=False, sort_keys=True)
                if not self.accept(",") and self.peek() != ")":
                    self.skip_to(",", ")")
                    self.accept(",")
        return {"type_sig": sig, "values": values}

    def value(self):
        """An annotation value: literal, array, annotation, class literal, enum constant; else what is not supported."""
        if self.accept("{"):
            out = []
            while not self.accept("}"):
                out.append(self.value())
                self.accept(",")
            return out
        if self.peek() == "@":
            return {"annotation": self.annotation()}
        start = self.at
        literal = self.literal()
        if literal is not None and self.peek() in (",", ")", "}", ";"):
            return literal[1]
        self.at = start
        if self.kind() == "name":
            parts = self.dotted()
            if parts[-1] == "class" and self.peek() in (",", ")", "}", ";"):
                return {"class": self.class_sig(parts[:-1], [], {})}
            if self.peek() in (",", ")", "}", ";") and parts[-1] != "class":
                return {"enum": self.class_sig(parts[:-1], [], {}) if len(parts) > 1 else None, "const": parts[-1]}
        self.at = start
        self.skip_to(",", ")", "}", ";")
        return {"unsupported": "".join(v for _, v, _ in self.t[start : self.at])}

    def literal(self) -> tuple[str, object] | None:
        """(tag, value) of a literal with an optional sign."""
        sign = 1
        while self.peek() in ("-", "+") and self.kind() == "op":
            sign *= -1 if self.next() == "-" else 1
        kind, v = self.kind(), self.peek()
        if kind == "number":
            self.at += 1
            return number(v, sign)
        if kind in ("string", "text"):
            self.at += 1
            body = v[1:-1] if kind == "string" else stripped(v[3:-3].lstrip(" \t").removeprefix("\r").removeprefix("\n"))
            return "String", unescape(body)
        if kind == "char":
            self.at += 1
            return "Character", unescape(v[1:-1])
        if v in ("true", "false"):
            self.at += 1
            return "Boolean", v == "true"
        return None

    # --- types ---

    def class_sig(self, parts: list[str], args: list[str], variables: dict) -> str:
        inner = f"<{''.join(args)}>" if args else ""
        if len(parts) == 1:
            return f"T{parts[0]};" if parts[0] in variables else f"U{parts[0]}{inner};"
        return f"L{self.selected(parts)}{inner};"

    def selected(self, parts: list[str]) -> str:
        """The type that a selection names: below a type around it or an import, if its first name is one's."""
        own = {j.rpartition("/")[2].rpartition("$")[2]: j for j in self.around}
        root = own.get(parts[0]) or self.single.get(parts[0])
        return "$".join([root, *parts[1:]]) if root else self.jvm(parts)

    def type(self, variables: dict) -> str:
        self.annotations()
        if self.accept("?"):
            if self.accept("extends"):
                return "+" + self.type(variables)
            return "-" + self.type(variables) if self.accept("super") else "*"
        if self.kind() != "name":
            raise ValueError(f"no type: {self.peek()}")
        if self.peek() in PRIMITIVES:
            sig = PRIMITIVES[self.next()]
        else:
            parts, args = [self.next()], []
            while True:
                if self.peek() == "<":
                    args = self.arguments(variables)
                elif self.peek() == "." and (self.kind(1) == "name" or self.peek(1) == "@"):
                    self.at += 1
                    self.annotations()
                    parts.append(self.next())
                    args = []
                else:
                    break
            sig = self.class_sig(parts, args, variables)
        return self.dims(sig)

    def arguments(self, variables: dict) -> list[str]:
        self.accept("<")
        out = []
        while not self.accept(">"):
            out.append(self.type(variables))
            while self.accept("&"):
                self.type(variables)
            if not self.accept(",") and self.peek() != ">":
                raise ValueError(f"no type argument: {self.peek()}")
        return out

    def dims(self, sig: str) -> str:
        while True:
            start = self.at
            self.annotations()
            if self.peek() == "[" and self.peek(1) == "]":
                self.at += 2
                sig = "[" + sig
            else:
                self.at = start
                return sig

    def type_parameters(self, variables: dict) -> tuple[list[dict], dict]:
        """The parameters and the variables that are in scope with them."""
        if self.peek() != "<":
            return [], variables
        depth, names = 0, []
        for k in range(self.at, len(self.t)):  # names first: bounds may refer forwards
            v = self.t[k][1]
            depth += (v == "<") - (v == ">")
            if depth == 1 and self.t[k][0] == "name" and self.t[k - 1][1] in ("<", ","):
                names.append(v)
            if depth == 0:
                break
        scope = {**variables, **dict.fromkeys(names, True)}
        self.accept("<")
        out = []
        while not self.accept(">"):
            self.annotations()
            name, bounds = self.next(), []
            if self.accept("extends"):
                bounds.append(self.type(scope))
                while self.accept("&"):
                    bounds.append(self.type(scope))
            out.append({"name": name, "bounds": bounds or [OBJECT]})
            self.accept(",")
        return out, scope

    def type_list(self, variables: dict) -> list[str]:
        out = [self.type(variables)]
        while self.accept(","):
            out.append(self.type(variables))
        return out

    # --- declarations ---

    def declaration(self, modifiers: int, annotations: list, outer: dict | None, shown: list, variables: dict | None = None) -> bool:
        """A type declaration, if one is next. shown: whether what is around it is indexed."""
        v = self.peek()
        if v == "@" and self.peek(1) == "interface":
            self.at += 2
            kind = "ANNOTATION"
        elif v in KINDS and self.kind(1) == "name" and (v != "record" or self.peek(2) in ("(", "<")):
            self.at += 1
            kind = KINDS[v]
        else:
            return False
        name = self.next()
        named = self.at - 1
        jvm = f"{outer['jvm_name']}${name}" if outer else f"{self.package}/{name}" if self.package else name
        self.declared[named] = {"role": "type", "owner": jvm, "params": None}
        visible = not (modifiers & PRIVATE and outer) and all(shown)
        scope = {} if modifiers & 0x8 or kind != "CLASS" else (variables or {})
        type_params, scope = self.type_parameters(scope)
        row = {"jvm_name": jvm, "modifiers": modifiers, "decl_kind": kind, "super_sig": None, "interface_sigs": [], "type_params": type_params, "fields": [], "methods": [], "inner_types": [], "permitted": [], "record_components": [], "annotations": annotations, "hints": None}
        if visible:
            self.types.append(row)
            if outer:
                outer["inner_types"].append(jvm)
            else:
                self.siblings.append(name)
        if kind == "RECORD" and self.peek() == "(":
            row["record_components"] = [{"name": p["name"], "sig": p["sig"], "annotations": p["annotations"]} for p in self.parameters(scope)[0]]
        while self.peek() != "{" and self.at < len(self.t):
            if self.accept("extends"):
                types = self.type_list(scope)
                if kind == "INTERFACE":
                    row["interface_sigs"] = types
                else:
                    row["super_sig"] = types[0]
            elif self.accept("implements"):
                row["interface_sigs"] = self.type_list(scope)
            elif self.accept("permits"):
                row["permitted"] = [s[1:-1] for s in self.type_list(scope)]
            else:
                self.at += 1
        first = self.at
        self.around.append(jvm)
        self.body(row, kind, scope, [*shown, visible])
        self.around.pop()
        self.bodies.append((first, self.at, jvm))
        return True

    def body(self, row: dict, kind: str, scope: dict, shown: list):
        self.accept("{")
        if kind == "ENUM":
            self.constants(row)
        while self.at < len(self.t):
            if self.accept("}"):
                return
            if self.accept(";"):
                continue
            start = self.at
            try:
                self.one(row, kind, scope, shown)
            except ValueError:
                self.skipped.append(start)
                self.at = start
                self.skip_to(";", "{", "}")
                if self.peek() == "{":
                    self.skip_block()
            if self.at == start:
                self.at += 1

    def constants(self, row: dict):
        while self.peek() not in (";", "}") and self.at < len(self.t):
            annotations = self.annotations()
            if self.kind() != "name":
                self.at += 1
                continue
            name = self.next()
            self.declared[self.at - 1] = {"role": "field", "owner": row["jvm_name"], "params": None}
            row["fields"].append({"modifiers": 0x1 | 0x8 | 0x10 | 0x4000, "name": name, "sig": f"L{row['jvm_name']};", "const": None, "annotations": annotations})
            if self.peek() == "(":
                self.skip_block("(", ")")
            if self.peek() == "{":
                self.skip_block()
            self.accept(",")
        self.accept(";")

    def one(self, row: dict, kind: str, scope: dict, shown: list):
        """A member of a body."""
        if self.peek() == "{" or self.peek() == "static" and self.peek(1) == "{":
            self.accept("static")
            self.skip_block()
            return
        modifiers, annotations = self.modifiers()
        if self.declaration(modifiers, annotations, row, shown, scope):
            return
        type_params, inner = self.type_parameters(scope)
        simple = row["jvm_name"].rpartition("/")[2].rpartition("$")[2]
        if self.peek() == simple and self.peek(1) in ("(", "{"):
            self.at += 1
            named = self.at - 1
            params = self.parameters(inner) if self.peek() == "(" else ([{"name": c["name"], "modifiers": 0, "sig": c["sig"], "annotations": []} for c in row["record_components"]], False)
            self.method(row, "<init>", "V", modifiers, annotations, type_params, params, inner, named)
            return
        result = self.type(inner)
        name = self.next()
        named = self.at - 1
        if self.peek() == "(":
            params = self.parameters(inner)
            self.method(row, name, self.dims(result), modifiers, annotations, type_params, params, inner, named)
            return
        while True:
            sig = self.dims(result)
            self.declared[named] = {"role": "field", "owner": row["jvm_name"], "params": None}
            const = None
            if self.accept("="):
                const = self.folded(modifiers, kind, sig)
                self.skip_to(",", ";")
            if not modifiers & PRIVATE:
                row["fields"].append({"modifiers": modifiers, "name": name, "sig": sig, "const": const, "annotations": annotations})
            if not self.accept(","):
                break
            name = self.next()
            named = self.at - 1
        self.accept(";")

    def folded(self, modifiers: int, kind: str, sig: str) -> dict | None:
        """The constant of a static final field whose initializer is a literal."""
        if kind not in ("INTERFACE", "ANNOTATION") and modifiers & 0x18 != 0x18:
            return None
        start = self.at
        found = self.literal()
        if found is None or self.peek() not in (",", ";"):
            self.at = start
            return None
        tag, v = found
        if tag == "String":
            return {"tag": tag, "i": None, "d": None, "s": v}
        if tag in ("Boolean", "Character"):
            tag, v = "Integer", int(v) if tag == "Boolean" else ord(v[0]) if v else 0
        if sig in ("J",) and tag == "Integer":
            tag = "Long"
        if sig in ("F", "D"):
            tag, v = ("Float" if sig == "F" else "Double"), float(v)
        return {"tag": tag, "i": None, "d": float(v), "s": None} if tag in ("Float", "Double") else {"tag": tag, "i": int(v), "d": None, "s": None}

    def parameters(self, scope: dict) -> tuple[list[dict], bool]:
        """(parameters, whether the last one takes any number)."""
        self.accept("(")
        out, varargs = [], False
        while not self.accept(")"):
            modifiers, annotations = self.modifiers()
            sig = self.type(scope)
            self.annotations()
            if self.accept("..."):
                varargs, sig = True, "[" + sig
            if self.peek() == "this" or self.peek(1) == "." and self.peek(2) == "this":  # the receiver is no parameter
                self.skip_to(",", ")")
            else:
                name = self.next()
                out.append({"name": name, "modifiers": modifiers, "sig": self.dims(sig), "annotations": annotations})
            self.accept(",")
        return out, varargs

    def method(self, row: dict, name: str, result: str, modifiers: int, annotations: list, type_params: list, params: tuple, scope: dict, named: int):
        self.declared[named] = {"role": "method", "owner": row["jvm_name"], "params": [p["sig"] for p in params[0]]}
        thrown = self.type_list(scope) if self.accept("throws") else []
        default = None
        if self.accept("default"):
            default = json.dumps(self.value(), ensure_ascii=False, sort_keys=True)
        has_body = self.peek() == "{"
        if has_body:
            self.skip_block()
        else:
            self.accept(";")
        self.code.append((named, self.at))
        if not modifiers & PRIVATE or name == "<init>":
            row["methods"].append({"modifiers": modifiers | (0x80 if params[1] else 0), "name": name, "return_sig": result, "params": params[0], "throws": thrown, "type_params": type_params, "varargs": params[1], "has_body": has_body, "annotation_default": default, "annotations": annotations})


def number(text: str, sign: int) -> tuple[str, object]:
    v = text.replace("_", "")
    hexadecimal = v[:2].lower() == "0x"
    if v[-1] in "lL":
        tag, v = "Long", v[:-1]
    elif v[-1] in "fF" and not hexadecimal:
        return "Float", sign * float(v[:-1])
    elif not hexadecimal and (v[-1] in "dD" or "." in v or "e" in v.lower()):
        return "Double", sign * float(v.rstrip("dD"))
    elif hexadecimal and "p" in v.lower():
        return "Double", sign * float.fromhex(v)
    else:
        tag = "Integer"
    octal = len(v) > 1 and v[0] == "0" and v.isdigit()
    value, bits = sign * int(v, 8 if octal else 0), 64 if tag == "Long" else 32
    return tag, (value + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1)


def parse(text: str) -> tuple[list[dict], list[dict], list[str]]:
    """(types, modules, names) of a source file; a module declaration gives no row."""
    return parse_counted(text)[:3]


def parse_counted(text: str) -> tuple[list[dict], list[dict], list[str], int]:
    """What parse() finds, and the number of members that do not parse."""
    p = Parser(text)
    return p.unit(), [], identifiers(text), len(p.skipped)


def context(text: str) -> tuple[str, list[str], dict[str, str], list[str]]:
    """(package, top-level types, single imports, on-demand imports) of a file."""
    p = Parser(text)
    p.unit()
    return p.package, p.siblings, p.single, p.on_demand


# --- occurrences ------------------------------------------------------------------------------------------------------


def occurrences(text: str) -> list[dict]:
    """Every name of a file with its place and what the file alone tells of it.

    name, start_off, end_off (of the text), line, col (from 0), is_declaration; role: type, method, field or local; scope:
    the type around it; owner: the type that declares it, for a declaration, or the type that an import names; receiver:
    the simple name of the type whose member it is, where a name, a local or a field of the file before the dot tells it,
    `this` or `super`; null without a dot; params: signatures of a declared method's parameters; arity: of a call.
    """
    p = Parser(text)
    p.unit()
    t, out = p.t, []
    breaks = [m.start() + 1 for m in re.finditer("\n", text)]
    scopes = sorted(p.bodies)
    code = sorted(p.code)
    imports = {k: (parts, static) for k, parts, static in p.imported}
    fields: dict[str, str] = {}  # field -> simple name of its class
    methods = set()
    for k, d in p.declared.items():
        if d["role"] == "field":
            fields[t[k][1]] = _class_before(t, k)
        elif d["role"] == "method":
            methods.add(t[k][1])
    locals_: dict[str, str] = {}
    until = line = 0
    inner: list[tuple[int, int, str]] = []
    opened = 0
    for i, (kind, name, start) in enumerate(t):
        while opened < len(scopes) and scopes[opened][0] <= i:
            inner.append(scopes[opened])
            opened += 1
        while inner and inner[-1][1] <= i:
            inner.pop()
        while code and code[0][0] <= i:
            until = code.pop(0)[1]
            locals_ = {}
        if i >= until:
            locals_ = {}
        if kind != "name" or name in RESERVED:
            continue
        while line < len(breaks) and breaks[line] <= start:
            line += 1
        row = {"name": name, "start_off": start, "end_off": start + len(name), "line": line, "col": start - (breaks[line - 1] if line else 0), "is_declaration": i in p.declared, "role": None, "scope": inner[-1][2] if inner else None, "owner": None, "receiver": None, "params": None, "arity": None}
        before, after = t[i - 1][1] if i else "", t[i + 1][1] if i + 1 < len(t) else ""
        if row["is_declaration"]:
            row |= p.declared[i]
            row["arity"] = None if row["params"] is None else len(row["params"])
        elif i < p.head:
            if i not in imports:
                continue  # a package, or a type on the way to a member
            parts, static = imports[i]
            row |= {"role": "field" if static else "type", "owner": Parser.jvm(parts[:-1] if static else parts)}
        elif before in (".", "::") and i > 1:
            owner = t[i - 2][1] if t[i - 2][0] == "name" else None
            row["role"] = "method" if after == "(" or before == "::" else "type" if name[:1].isupper() and owner and owner[:1].isupper() and after not in (")", ";", ",") else "field"
            if owner in ("this", "super"):
                row["receiver"] = owner
            elif owner and (i < 4 or t[i - 3][1] != "."):
                row["receiver"] = locals_.get(owner) or (fields.get(owner) if owner not in locals_ else None) or (owner if owner[:1].isupper() and owner not in fields else None)
            row["receiver"] = row["receiver"] or "?"
        elif until > i and t[i - 1][0] in ("name", "op") and _declares(t, i):
            locals_[name] = _class_before(t, i)
            row["role"] = "local"
        elif name in locals_:
            row["role"] = "local"
        elif after == "(" and before not in ("new", "@"):
            row["role"] = "method"
        elif name in fields or not name[:1].isupper():
            row["role"] = "field"
        else:
            row["role"] = "type"
        if row["role"] == "method" and after == "(" and row["arity"] is None:
            row["arity"] = _arguments(t, i + 1)
        out.append(row)
    return out


def _declares(t: list, i: int) -> bool:
    """Whether the name at i is that of a parameter or a local variable: a type stands before it."""
    after = t[i + 1][1] if i + 1 < len(t) else ""
    kind, before, _ = t[i - 1]
    typed = kind == "name" and (before not in RESERVED or before in PRIMITIVES) or before in (">", "]", "...")
    return typed and after in ("=", ";", ":", ",", ")", "[") or before in ("(", ",") and after == "->"


def _class_before(t: list, i: int) -> str | None:
    """The simple name of the class before the name at i, its arguments and brackets apart."""
    k, depth = i - 1, 0
    while k >= 0:
        v = t[k][1]
        depth += (v in (">", "]")) - (v in ("<", "["))
        if depth == 0 and v not in ("<", "[", "..."):
            return v if t[k][0] == "name" and v not in RESERVED and v != "var" else None
        k -= 1
    return None


def _arguments(t: list, at: int) -> int:
    """The number of arguments of the call whose bracket is at `at`."""
    depth = n = 0
    for k in range(at, len(t)):
        v = t[k][1]
        if t[k][0] == "op":
            if v in ")]}":
                depth -= 1
                if depth == 0:
                    return n + (k > at + 1)
            depth += v in ("(", "[", "{")
            n += v == "," and depth == 1
    return n + 1
