"""What one C# document declares, uses and calls, from its tokens.

There is no compiler here. A document is cut into tokens; a descent over brackets finds namespaces, types and members,
and bodies are read for names and calls. Types are given as they are written; ``extract`` binds them to the solution's
declarations. Code inside interpolated strings is not read, conditional compilation is ignored (all branches count),
and local functions belong to the member around them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

TOKEN = re.compile(
    r'''(?P<doc>///[^\n]*)|(?P<skip>//[^\n]*|/\*.*?\*/|^[ \t]*\#[^\n]*|\s+)|(?P<text>\$*"""+.*?"""+|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+')'''
    r"""|(?P<num>\d[\w.]*)|(?P<id>@?[^\W\d]\w*)|(?P<op>=>|\?\.|\?\?|::|&&|\|\||.)""",
    re.S | re.M,
)
MODIFIERS = frozenset("public private protected internal static abstract sealed virtual override readonly partial async extern unsafe new const volatile required file ref".split())
TYPE_WORDS = {"class": "Class", "struct": "Struct", "interface": "Interface", "record": "Class", "enum": "Enum"}
# The language's names of predefined types.
ALIASES = {
    "bool": "System.Boolean", "byte": "System.Byte", "sbyte": "System.SByte", "char": "System.Char", "decimal": "System.Decimal", "double": "System.Double", "float": "System.Single",
    "int": "System.Int32", "uint": "System.UInt32", "long": "System.Int64", "ulong": "System.UInt64", "short": "System.Int16", "ushort": "System.UInt16", "object": "System.Object",
    "string": "System.String", "void": "System.Void", "nint": "System.IntPtr", "nuint": "System.UIntPtr",
}
#: Words that stand before a bracket without being called, or can't be a variable's type.
KEYWORDS = frozenset(
    "if for foreach while switch using lock fixed return catch when nameof typeof sizeof default checked unchecked await throw new in out ref is as and or not base this else do try finally case goto break "
    "continue yield var dynamic where select from orderby group into let join on equals by with get set init add remove params stackalloc null true false operator implicit explicit event delegate".split()
)
#: What members of frameworks give, where receivers depend on it.
MEMBERS = {
    ("WebApplication", "CreateBuilder"): "WebApplicationBuilder", ("WebApplicationBuilder", "Build"): "WebApplication", ("WebApplicationBuilder", "Services"): "IServiceCollection",
    ("Host", "CreateApplicationBuilder"): "HostApplicationBuilder", ("HostApplicationBuilder", "Services"): "IServiceCollection",
}


@dataclass
class Token:
    kind: str
    text: str
    at: int


@dataclass
class Declared:
    symbol_id: str
    name: str
    kind: str
    namespace: str
    containing_type: str | None
    accessibility: str
    signature: str
    display: str
    xml_doc: str | None
    name_at: int
    end_at: int
    returns: str | None = None
    parameters: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)
    extends: str | None = None  # the first parameter's type of an extension method
    required: int = 0  # parameters without a default


class Document:
    """Reads a text once; found are declarations, uses (name, qualifier, at) and calls."""

    def __init__(self, text: str):
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens: list[Token] = []
        self.docs: dict[int, str] = {}  # by the index of the token that follows
        self.usings: list[str] = []
        self.declared: list[Declared] = []
        self.uses: list[tuple] = []
        self.calls: list[dict] = []
        waiting: list[str] = []
        for m in TOKEN.finditer(text):
            if m.lastgroup == "doc":
                waiting.append(m.group()[3:])
            elif m.lastgroup != "skip":
                if waiting:
                    self.docs[len(self.tokens)] = "<doc>" + "\n".join(waiting) + "</doc>"
                    waiting = []
                self.tokens.append(Token(m.lastgroup, m.group(), m.start()))
        self.close = self._matches()
        self._members(0, len(self.tokens), "", None, {})

    # --- tokens ----------------------------------------------------------------------------------

    def _matches(self) -> dict[int, int]:
        """The closing bracket of each opening one; one that isn't closed reaches to the end."""
        out, open_ = {}, []
        pair = {")": "(", "]": "[", "}": "{"}
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in "([{":
                open_.append(i)
            elif t.text in pair:
                while open_ and self.tokens[open_[-1]].text != pair[t.text]:
                    out[open_.pop()] = i
                if open_:
                    out[open_.pop()] = i
        return out | {i: len(self.tokens) for i in open_}

    def _is(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts

    def _kind(self, i: int, kind: str) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == kind

    def _source(self, i: int, j: int) -> str:
        """The text of tokens i to j - 1, with blanks made one."""
        if i >= j:
            return ""
        last = self.tokens[min(j, len(self.tokens)) - 1]
        return re.sub(r"\s+", " ", self.text[self.tokens[i].at : last.at + len(last.text)])

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.lines, at)
        return line, at - self.lines[line - 1] + 1

    def span(self, at: int, length: int) -> tuple[int, int, int, int]:
        return (*self.place(at), *self.place(at + length))

    def _angles(self, i: int) -> int | None:
        """One past the > that closes the < at i, if what lies between can be types."""
        depth = 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t.text == "<":
                depth += 1
            elif t.text == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif not (t.kind == "id" or t.text in (",", ".", "?", "[", "]", "(", ")", "::")):
                return None
            i += 1
        return None

    def _type(self, i: int) -> int | None:
        """One past a type that begins at i."""
        if self._is(i, "("):
            i = self.close.get(i, len(self.tokens)) + 1
        else:
            while True:
                if not self._kind(i, "id") or self.tokens[i].text in KEYWORDS - {"var", "dynamic"}:
                    return None
                i += 1
                if self._is(i, "<"):
                    i = self._angles(i)
                    if i is None:
                        return None
                if not self._is(i, ".", "::"):
                    break
                i += 1
        while self._is(i, "?", "*") or (self._is(i, "[") and all(self._is(k, ",") for k in range(i + 1, self.close.get(i, i + 1)))):
            i = self.close[i] + 1 if self._is(i, "[") else i + 1
        return i

    def _split(self, i: int, j: int) -> list[tuple[int, int]]:
        """The ranges between commas that lie in no bracket."""
        out, first, k = [], i, i
        while k < j:
            if self._is(k, "(", "[", "{"):
                k = self.close.get(k, j)
            elif self._is(k, "<") and (end := self._angles(k)) is not None and end <= j:
                k = end - 1
            elif self._is(k, ","):
                out.append((first, k))
                first = k + 1
            k += 1
        return [*out, (first, j)] if first < j else out

    # --- declarations ----------------------------------------------------------------------------

    def _members(self, i: int, end: int, namespace: str, owner: Declared | None, scope: dict[str, str]) -> None:
        begin = i
        main: list[int] | None = None
        while i < end:
            start, attributes, modifiers = i, [], []
            while self._is(i, "[") and (owner or self._is(i + 1, "assembly", "module") or self._attributed(i)):
                attributes += self._attribute_names(i)
                i = self.close.get(i, end) + 1
            while self._kind(i, "id") and self.tokens[i].text in MODIFIERS and not self._is(i + 1, "(", "."):
                modifiers.append(self.tokens[i].text)
                i += 1
            word = self.tokens[i].text if i < end else ""
            if word == "global" and self._is(i + 1, "using"):
                i, word = i + 1, "using"
            if owner is None and word == "using" and self._kind(i + 1, "id") and not self._is(i + 1, "var"):
                j = self._until(i, end)
                if not any(self._is(k, "=", "(") for k in range(i, j)):
                    self.usings.append(self._source(i + 1 + self._is(i + 1, "static"), j))
                    i = j + 1
                    continue
            if word == "namespace":
                j = i + 1
                while self._kind(j, "id") or self._is(j, "."):
                    j += 1
                inner = f"{namespace}.{self._source(i + 1, j)}".strip(".")
                if self._is(j, ";"):
                    namespace, i = inner, j + 1
                else:
                    stop = self.close.get(j, end)
                    self._members(j + 1, stop, inner, None, {})
                    i = stop + 1
                continue
            header = (start, attributes, modifiers, namespace, owner)
            if word in TYPE_WORDS and self._kind(i + 1, "id"):
                i = self._type_declaration(i, end, *header)
                continue
            if word == "delegate" and self._type(i + 1):
                i = self._until(i, end) + 1
                continue
            if owner is None:  # a statement at the top
                main = main or [begin]
                j = self._statement(i, end)
                self._body(max(i, start), j, self._main(namespace), scope)
                i = max(j, i + 1)
                continue
            i = max(self._member(i, end, scope, *header), start + 1)

    def _attributed(self, i: int) -> bool:
        j = self.close.get(i, len(self.tokens)) + 1
        return self._is(j, "[", *MODIFIERS, *TYPE_WORDS)

    def _attribute_names(self, i: int) -> list[str]:
        out = []
        for a, z in self._split(i + 1, self.close.get(i, i + 1)):
            if self._is(a + 1, ":"):
                a += 2
            j = self._type(a)
            if j and j <= z:
                out.append(self._source(a, j))
                self._use(a, j, attribute=True)
                if self._is(j, "("):
                    self._uses(j, z)
        return out

    def _until(self, i: int, end: int) -> int:
        """The ; that ends a statement without a block."""
        while i < end and not self._is(i, ";"):
            i = self.close.get(i, i) + 1
        return i

    def _statement(self, i: int, end: int) -> int:
        """One past a statement: its ; or the block that ends it."""
        while i < end:
            if self._is(i, ";"):
                return i + 1
            block = self._is(i, "{")
            i = self.close.get(i, i) + 1
            if block and not self._is(i, ")", ",", ".", ";", "else", "catch", "finally", "while", "?"):
                return i
        return end

    def _main(self, namespace: str) -> Declared:
        return Declared("M:Program.<Main>$", "<Main>$", "Method", namespace, "Program", "Private", "", "Program.<Main>$", None, 0, 0)

    def _access(self, modifiers: list[str], default: str) -> str:
        words = [m for m in modifiers if m in ("public", "private", "protected", "internal")]
        return {"private protected": "Private Protected", "protected private": "Private Protected", "protected internal": "Protected Internal", "internal protected": "Protected Internal"}.get(" ".join(words)) or (words[0].capitalize() if words else default)

    def _type_declaration(self, i: int, end: int, start: int, attributes: list[str], modifiers: list[str], namespace: str, owner: Declared | None) -> int:
        kind = TYPE_WORDS[self.tokens[i].text]
        if self._is(i, "record") and self._is(i + 1, "class", "struct"):
            i += 1
            kind = TYPE_WORDS[self.tokens[i].text]
        at = i + 1
        name, j = self.tokens[at].text.lstrip("@"), at + 1
        arity = ""
        if self._is(j, "<") and (k := self._angles(j)):
            arity, j = f"`{len(self._split(j + 1, k - 1))}", k
        full = f"{owner.display if owner else namespace}.{name}".strip(".")
        d = Declared(f"T:{full}{arity}", name, kind, namespace, owner.display if owner else None, self._access(modifiers, "Private" if owner else "Internal"), "", full, self.docs.get(start), self.tokens[at].at, 0, attributes=attributes)
        scope: dict[str, str] = {}
        primary = None
        if self._is(j, "("):
            primary = (j, self.close.get(j, end))
            j = primary[1] + 1
        if self._is(j, ":"):
            j += 1
            while (k := self._type(j)) is not None:
                d.bases.append(self._source(j, k))
                self._use(j, k)
                if self._is(k, "("):
                    self._uses(k, self.close.get(k, end))
                    k = self.close.get(k, end) + 1
                j = k + 1 if self._is(k, ",") else k
                if not self._is(k, ","):
                    break
        while j < end and not self._is(j, "{", ";"):
            j = self.close.get(j, j) + 1
        d.signature = self._source(i, at + 1)
        self.declared.append(d)
        if primary:
            self._parameters(*primary, d, scope)
            types, d.parameters, needed, d.required = d.parameters, [], d.required, 0
            self.declared.append(Declared(f"M:{full}.#ctor({','.join(types)})", ".ctor", "Method", namespace, full, d.accessibility, f"{name}{self._source(primary[0], primary[1] + 1)}", f"{full}.{name}", None, d.name_at, 0, "void", types, required=needed))
        stop = self.close.get(j, end) if self._is(j, "{") else j
        if self._is(j, "{"):
            if kind == "Enum":
                for a, _ in self._split(j + 1, stop):
                    while self._is(a, "["):
                        a = self.close.get(a, stop) + 1
                    if self._kind(a, "id"):
                        n = self.tokens[a].text
                        self.declared.append(Declared(f"F:{full}.{n}", n, "EnumMember", namespace, full, "Public", n, f"{full}.{n}", self.docs.get(a), self.tokens[a].at, 0))
            else:
                self._fields(j + 1, stop, scope)
                self._members(j + 1, stop, namespace, d, scope)
        d.end_at = self.tokens[min(stop, len(self.tokens) - 1)].at + 1
        return stop + 1

    def _fields(self, i: int, end: int, scope: dict[str, str]) -> None:
        """Types of the fields and properties of a type body, for receivers."""
        while i < end:
            j = self._type(i)
            if j and self._kind(j, "id") and self._is(j + 1, ";", "=", "{", "=>", ","):
                scope[self.tokens[j].text] = self._source(i, j)
                i = j + 1
            else:
                i = self.close.get(i, i) + 1

    def _parameters(self, i: int, end: int, d: Declared, scope: dict[str, str]) -> None:
        for n, (a, z) in enumerate(self._split(i + 1, end)):
            while self._is(a, "["):
                a = self.close.get(a, z) + 1
            first = a
            while self._is(a, "this", "ref", "out", "in", "params", "scoped", "readonly"):
                a += 1
            j = self._type(a)
            if j is None:
                continue
            kind = self._source(a, j)
            d.parameters.append(_metadata(kind))
            d.required += not any(self._is(k, "=") for k in range(j, z))
            if n == 0 and self._is(first, "this"):
                d.extends = kind
            self._use(a, j)
            if self._kind(j, "id"):
                scope[self.tokens[j].text] = kind

    def _member(self, i: int, end: int, scope: dict[str, str], start: int, attributes: list[str], modifiers: list[str], namespace: str, owner: Declared) -> int:
        event = self._is(i, "event")
        i += event
        access = self._access(modifiers, "Public" if owner.kind == "Interface" else "Private")

        def declare(prefix: str, name: str, kind: str, at: int, signature: str, returns: str | None = None) -> Declared:
            d = Declared(f"{prefix}:{owner.display}.{name}", name, kind, namespace, owner.display, access, signature, f"{owner.display}.{name}", self.docs.get(start), self.tokens[at].at, 0, returns, attributes=attributes)
            self.declared.append(d)
            return d

        def method(name: str, at: int, j: int, returns: str, first: int) -> int:
            if self._is(j, "<") and (k := self._angles(j)):
                j = k
            stop = self.close.get(j, end)
            d = declare("M", name, "Method", at, self._source(first, stop + 1), returns)
            inner = dict(scope)
            self._parameters(j, stop, d, inner)
            if d.parameters:
                d.symbol_id += f"({','.join(d.parameters)})"
            if name in (".ctor", ".cctor"):
                d.symbol_id = d.symbol_id.replace(f".{name}", ".#" + name[1:], 1)
            j = stop + 1
            while j < end and not self._is(j, "{", "=>", ";"):
                if self._is(j, "("):
                    self._body(j, self.close.get(j, end), d, inner)
                j = self.close.get(j, j) + 1
            z = self._until(j, end) if not self._is(j, "{") else self.close.get(j, end)
            self._body(j + 1, z, d, inner)
            d.end_at = self.tokens[min(z, len(self.tokens) - 1)].at + 1
            return z + 1

        if self._kind(i, "id") and self.tokens[i].text == owner.name and self._is(i + 1, "("):
            return method(".cctor" if "static" in modifiers else ".ctor", i, i + 1, "void", i)
        if self._is(i, "~"):
            return method("Finalize", i + 1, i + 2, "void", i)
        first, j = i, self._type(i)
        if self._is(i, "implicit", "explicit"):
            j = i
        if j is None:
            return self._statement(i, end)
        if self._is(j, "operator") or self._is(i, "implicit", "explicit"):
            k = j
            while k < end and not self._is(k, "("):
                k += 1
            return method("op_" + self._source(j + 1, k).replace("operator", "").strip(), min(j + 1, end - 1), k, self._source(i, j), first)
        self._use(i, j)
        returns = self._source(i, j)
        at = j
        while self._kind(at, "id") and (self._is(at + 1, ".") or (self._is(at + 1, "<") and (g := self._angles(at + 1)) and self._is(g, "."))):
            at = at + 2 if self._is(at + 1, ".") else g + 1  # an explicit implementation's interface
        if self._is(at, "this") and self._is(at + 1, "["):
            d = declare("P", "Item", "Indexer", at, self._source(first, self.close.get(at + 1, end) + 1), returns)
            return self._accessors(self.close.get(at + 1, end) + 1, end, d, scope)
        if not self._kind(at, "id"):
            return self._statement(i, end)
        name, k = self.tokens[at].text.lstrip("@"), at + 1
        if self._is(k, "(") or (self._is(k, "<") and (g := self._angles(k)) and self._is(g, "(")):
            return method(name, at, k, returns, first)
        if self._is(k, "{", "=>") and not event:
            d = declare("P", name, "Property", at, self._source(first, at + 1), returns)
            return self._accessors(k, end, d, scope)
        z = self._until(k, end)
        if event and self._is(k, "{"):
            z = self.close.get(k, end)
        for n, (a, b) in enumerate(self._split(at, z)):
            if self._kind(a, "id"):
                d = declare("E" if event else "F", self.tokens[a].text, "Event" if event else "Field", a, f"{returns} {self.tokens[a].text}", returns)
                d.end_at = self.tokens[b - 1].at + len(self.tokens[b - 1].text)
                self._body(a + 1, b, d, scope)
        return z + 1

    def _accessors(self, k: int, end: int, d: Declared, scope: dict[str, str]) -> int:
        if self._is(k, "{"):
            z = self.close.get(k, end)
            self._body(k + 1, z, d, scope)
            if self._is(z + 1, "="):
                stop = self._until(z + 1, end)
                self._body(z + 2, stop, d, scope)
                z = stop
        else:
            z = self._until(k, end)
            self._body(k + 1, z, d, scope)
        d.end_at = self.tokens[min(z, len(self.tokens) - 1)].at + 1
        return z + 1

    # --- bodies ----------------------------------------------------------------------------------

    def _use(self, i: int, j: int, attribute: bool = False) -> None:
        """The names in a type."""
        qualifier = ""
        for k in range(i, j):
            if not self._kind(k, "id"):
                continue
            t = self.tokens[k]
            qualifier = f"{qualifier}.{t.text}" if self._is(k - 1, ".") and k > i else t.text
            if t.text not in ALIASES and not self._is(k + 1, "."):
                self.uses.append((t.text, qualifier, t.at, attribute))

    def _uses(self, i: int, j: int) -> None:
        for k in range(i, j):
            if self._kind(k, "id") and self.tokens[k].text not in KEYWORDS and not self._is(k - 1, ".", "?.", "::"):
                self.uses.append((self.tokens[k].text, self.tokens[k].text, self.tokens[k].at, False))

    def _body(self, i: int, end: int, caller: Declared, scope: dict[str, str]) -> None:
        end = min(end, len(self.tokens))
        self._uses(i, end)
        k = i
        while k < end:  # variables first, as they may be declared after a lambda that is read with them
            j = self._type(k) if self._kind(k, "id") and not self._is(k - 1, ".", "?.") else None
            if j and self._kind(j, "id") and self.tokens[j].text not in KEYWORDS and self._is(j + 1, "=", ";", "in", ")", ","):
                kind = self._source(k, j)
                scope[self.tokens[j].text] = self._given(j + 2, end, scope) if kind == "var" and self._is(j + 1, "=") else kind
                k = j
            k += 1
        for k in range(i, end):
            if self._is(k, "("):
                self._call(k, end, caller, scope)

    def _chain(self, k: int) -> int:
        """Where the expression begins whose last name stands at k."""
        while self._is(k - 1, ".", "?."):
            k -= 2
            while self._is(k, ")", "]", ">"):
                opened = next((a for a, z in self.close.items() if z == k), None)
                if opened is None:
                    return k
                k = opened - 1
            if k < 0:
                return 0
        return k

    def _given(self, i: int, end: int, scope: dict[str, str]) -> str | None:
        """The type of an expression that begins at i, as far as names tell."""
        while self._is(i, "await", "("):
            i += 1
        if self._is(i, "new"):
            j = self._type(i + 1)
            return self._source(i + 1, j) if j else None
        if self._kind(i, "text"):
            return "string"
        if not self._kind(i, "id"):
            return None
        kind = scope.get(self.tokens[i].text, self.tokens[i].text if self.tokens[i].text[:1].isupper() else None)
        i += 1
        while i < end and self._is(i, ".") and self._kind(i + 1, "id"):
            kind, i = MEMBERS.get((kind, self.tokens[i + 1].text)), i + 2
            if self._is(i, "("):
                i = self.close.get(i, end) + 1
        return kind

    def _call(self, k: int, end: int, caller: Declared, scope: dict[str, str]) -> None:
        at, type_args = k - 1, []
        if self._is(at, ">"):
            opened = next((a for a in range(at, max(at - 60, -1), -1) if self._is(a, "<") and self._angles(a) == k), None)
            if opened is None:
                return
            type_args = [self._source(a, z) for a, z in self._split(opened + 1, at)]
            at = opened - 1
        if not self._kind(at, "id") or self.tokens[at].text in KEYWORDS:
            return
        begin = self._chain(at)
        if self._is(begin - 1, "new"):
            return
        before = self.tokens[begin - 1] if begin else None
        if before and before.kind == "id" and begin == at and before.text not in KEYWORDS and not self._is(begin - 1, "return", "await"):
            return  # a local function's declaration
        stop = self.close.get(k, end)
        args = [self._source(a, z) for a, z in self._split(k + 1, stop)]
        first = self._split(k + 1, stop)[:1]
        literal = bool(first) and first[0][1] - first[0][0] == 1 and self._kind(first[0][0], "text") and self.tokens[first[0][0]].text[0] in '"@'
        receiver = None
        if begin < at:
            receiver = self._given(begin, at - 1, scope)
        name = self.tokens[at].text
        self.calls.append(
            {
                "caller": caller.symbol_id, "caller_type": caller.containing_type, "method_name": None if self._is(at - 1, "?.") else name, "name": name, "type_args": type_args, "arg_texts": args,
                "arg0_value": self.tokens[first[0][0]].text.lstrip("@").strip('"') if literal else None, "raw_call": self._source(begin, stop + 1), "receiver": receiver, "bare": begin == at, "at": self.tokens[at].at,
            }
        )


def _metadata(kind: str) -> str:
    """A written type with predefined names in full."""
    return re.sub(r"(?<![\w.])[a-z]+(?!\w)", lambda m: ALIASES.get(m.group(), m.group()), kind).replace(" ", "")
