"""Elements of program text: JavaScript, TypeScript and Svelte by line, Go by its declarations and statements.

Both are given as table functions over files. The Go reader is a lexer with automatic semicolons and a reader of declarations and statements; it
takes the common forms of the language (see :func:`go_elements`) and gives a statement's own text, without formatting it anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

Element = tuple[str, str]

# The patterns by which a line of JavaScript is told, in the order in which they are tried.
_JS_IMPORT_FROM = re.compile(r"""import\s+(?:\{[^}]*\}|[^{;]+)\s+from\s+['"]([^'"]+)['"]""")
_JS_RULES: list[tuple[str, re.Pattern, tuple[str, ...]]] = [
    ("import", re.compile(r"""import\s+['"]([^'"]+)['"]"""), ("import",)),
    ("class", re.compile(r"(?:export\s+)?class\s+(\w+)", re.A), ("type", "struct")),
    ("alias", re.compile(r"(?:export\s+)?type\s+(\w+)\s*[=<{]", re.A), ("type",)),
    ("interface", re.compile(r"(?:export\s+)?interface\s+(\w+)", re.A), ("type", "interface")),
    ("enum", re.compile(r"(?:export\s+)?enum\s+(\w+)", re.A), ("type",)),
    ("function", re.compile(r"(?:export\s+)?(?:async\s+)?function\s+(\w+)", re.A), ("func",)),
    ("outside", re.compile(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(", re.A), ("func",)),
    ("outside", re.compile(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\w+\s*=>", re.A), ("func",)),
    ("outside", re.compile(r"(?:export\s+)?(?:const|let|var)\s+(\w+)", re.A), ("ident",)),
    ("member", re.compile(r"^\s+(?:(?:public|private|protected|static)\s+)*get\s+(\w+)\s*\(", re.A), ("method",)),
    ("member", re.compile(r"^\s+(?:(?:public|private|protected|static)\s+)*set\s+(\w+)\s*\(", re.A), ("method",)),
    ("method", re.compile(r"^\s+(?:(?:public|private|protected|static|async|readonly)\s+)*(\w+)\s*\(", re.A), ("method",)),
    ("field", re.compile(r"^\s+(?:(?:public|private|protected|static|readonly)\s+)*(\w+)\s*[?!]?\s*:\s*", re.A), ("field",)),
]
_JS_HIDDEN = {"method": {"if", "for", "while", "switch", "return", "constructor", "new", "throw", "catch"}, "field": {"return", "const", "let"}}
_JS_COMMENT = re.compile(r"^\s*(?://|/\*|\*)")
_JS_COMPONENT = re.compile(r"<([A-Z]\w+)", re.A)
_JS_STRINGS = [re.compile(r"'(?:[^'\\]|\\.){3,}'"), re.compile(r'"(?:[^"\\]|\\.){3,}"'), re.compile(r"`[^`]{3,}`")]


def looks_like_js(text: str) -> bool:
    return any(sign in text for sign in ("import ", "export ", "function ", "<script"))


def looks_like_go(text: str) -> bool:
    """The word ``package`` and a space begin among the first 512 bytes, and not at the very end."""
    data = text.encode()
    at = data[:520].find(b"package ")
    return 0 <= at < min(512, len(data) - 8)


def js_elements(text: str) -> list[Element]:
    """Elements line by line; the first rule that fits a line takes it."""
    out: list[Element] = []
    depth, scope = 0, None  # the depth of the class line while inside a class
    for line in text.split("\n"):
        for sign in re.findall("[{}]", line):
            depth += 1 if sign == "{" else -1
            if scope is not None and sign == "}" and depth < scope:
                scope = None
        if _JS_COMMENT.match(line):
            body = line.strip().lstrip("/* ")
            out += [("comment", body)] if len(body.encode()) > 3 else []
            continue
        if m := _JS_IMPORT_FROM.search(line):
            names = re.search(r"\{([^}]*)\}", line)
            idents = [n.split(" as ", 1)[-1].strip() for n in (names.group(1).split(",") if names else [])]
            out += [("import", m.group(1)), *(("ident", n) for n in idents if n)]
            continue
        for kind, pattern, tags in _JS_RULES:
            inside_only = kind in ("member", "method", "field")
            if (inside_only and scope is None) or not (m := pattern.search(line)):
                continue
            shown = not (kind == "outside" and scope is not None) and m.group(1) not in _JS_HIDDEN.get(kind, ())
            out += [(t, m.group(1) if k == 0 else "") for k, t in enumerate(tags)] if shown else []
            scope = depth if kind == "class" else scope
            break
        else:
            out += [("ident", m.group(1)) for m in _JS_COMPONENT.finditer(line)]
            out += [("literal", m.group(0)) for p in _JS_STRINGS for m in p.finditer(line)]
    return out


_GO_TOKEN = re.compile(
    r"(?P<space>[ \t\r]+|//[^\n]*|/\*.*?\*/)|(?P<line>\n)|(?P<text>`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+')|(?P<name>[^\W\d]\w*)|(?P<number>\d[\w.]*)"
    r"|(?P<sign><-|:=|\+\+|--|&&|\|\||\.\.\.|[-+*/%&|^<>=!]=|<<|>>|.)", re.S
)
_GO_STOPS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
# The tag of a statement by its first word.
_GO_TAGS = {"return": "return", "if": "if", "for": "for", "switch": "switch", "select": "select", "go": "go", "defer": "defer", "var": "decl", "const": "decl", "type": "decl", "break": "branch", "continue": "branch", "goto": "branch", "fallthrough": "branch"}
_OPEN, _CLOSE = {"(", "[", "{"}, {")", "]", "}"}


class _Go:
    def __init__(self, text: str):
        self.text, self.t = text, []  # tokens: (kind, value, start, end); ";" also where a line ends a statement
        for m in _GO_TOKEN.finditer(text):
            kind = m.lastgroup
            if kind == "line" or (kind == "space" and "\n" in m.group()):
                if self.t and (self.t[-1][0] in ("name", "number", "text") and self.t[-1][1] not in _GO_TAGS or self.t[-1][1] in _GO_STOPS):
                    self.t.append(("sign", ";", m.start(), m.start()))
            elif kind != "space":
                self.t.append((kind, m.group(), m.start(), m.end()))
        self.t.append(("sign", ";", len(text), len(text)))

    def value(self, i: int) -> str:
        return self.t[i][1] if i < len(self.t) else ""

    def pair(self, i: int) -> int:
        """The place of the sign that closes the one at ``i``."""
        depth = 0
        while i < len(self.t):
            depth += (self.value(i) in _OPEN) - (self.value(i) in _CLOSE)
            if depth == 0:
                return i
            i += 1
        raise ValueError("unbalanced")

    def end(self, i: int) -> int:
        """The place of the ``;`` (or closing sign) that ends what starts at ``i``."""
        while i < len(self.t) and self.value(i) != ";" and self.value(i) not in _CLOSE:
            i = self.pair(i) + 1 if self.value(i) in _OPEN else i + 1
        return i

    def source(self, i: int, j: int) -> str:
        return self.text[self.t[i][2] : self.t[j - 1][3]] if j > i else ""

    def split(self, i: int, j: int, by: str) -> list[tuple[int, int]]:
        """Spans between the top-level signs ``by`` in i..j."""
        out, start, k = [], i, i
        while k < j:
            if self.value(k) == by:
                out.append((start, k))
                start = k + 1
            k = self.pair(k) + 1 if self.value(k) in _OPEN else k + 1
        return [s for s in [*out, (start, j)] if s[1] > s[0]]

    def fields(self, i: int, j: int) -> list[tuple[str, str]]:
        """(name, type) of the entries of a list of parameters; the name is empty where there are only types."""
        spans = self.split(i, j, ",")
        named = any(b - a >= 2 and self.t[a][0] == "name" and self.value(a + 1) != "." and self.value(a) not in ("func", "map", "chan", "struct", "interface") for a, b in spans)
        out, waiting = [], []
        for a, b in spans:
            if named and b - a == 1:
                waiting.append(self.value(a))
            elif named:
                out += [(n, self.source(a + 1, b)) for n in [*waiting, self.value(a)]]
                waiting = []
            else:
                out.append(("", self.source(a, b)))
        return out

    def signature(self, i: int) -> tuple[str, list[Element], int]:
        """Of the parameter list that opens at ``i``: its text with the results, the names as elements, and the place after it."""
        close = self.pair(i)
        names = [("ident:param", n) for n, _ in self.fields(i + 1, close) if n]
        text, k = "(" + self.source(i + 1, close) + ")", close + 1
        if self.value(k) == "(":
            shut = self.pair(k)
            names += [("ident:result", n) for n, _ in self.fields(k + 1, shut) if n]
            return f"{text} {self.source(k, shut + 1)}", names, shut + 1
        start = k
        while self.value(k) not in ("{", ";", ")", ",") or (self.value(k) == "{" and self.value(k - 1) in ("struct", "interface")):
            k = self.pair(k) + 1 if self.value(k) in _OPEN else k + 1
        return text + (" " + self.source(start, k) if k > start else ""), names, k

    def statements(self, i: int, j: int, parent: str) -> Iterator[Element]:
        while i < j:
            if self.value(i) == ";":
                i += 1
                continue
            word = self.value(i)
            stop = min(self.block_end(i, j) if word in ("if", "for", "switch", "select") else self.end(i), j)
            if word in ("case", "default"):
                stop = next((k for k in range(i + 1, j) if self.value(k) in ("case", "default") and self._level(i, k)), j)
                tag = "comm" if parent.endswith("\1") else "case"
            else:
                tag = _GO_TAGS.get(word) or self.simple(i, stop)
            if word != "{":
                line = self.text.count("\n", 0, self.t[i][2]) + 1
                yield tag, f"{parent.rstrip(chr(1))}\0{line}\0{self.source(i, stop).strip()}"
                if word in ("if", "for", "switch", "select"):
                    yield from self.inner(i, stop, parent.rstrip("\1") + ("\1" if word == "select" else ""))
            i = max(stop, i + 1)

    def _level(self, i: int, k: int) -> bool:
        signs = [self.value(x) for x in range(i, k)]
        return sum(s in _OPEN for s in signs) == sum(s in _CLOSE for s in signs)

    def block(self, i: int, stop: int) -> int:
        """The place of the brace that opens the block of the statement at ``i``; ``stop`` if there is none."""
        k = i + 1
        while k < stop and not (self.value(k) == "{" and self.value(k - 1) not in ("struct", "interface")):
            k = self.pair(k) + 1 if self.value(k) in ("(", "[") else k + 1
        return k

    def block_end(self, i: int, j: int) -> int:
        """The place after the last block of an if, for, switch or select, with all that follows ``else``."""
        k = self.block(i, j)
        if k >= j:
            return j
        close = self.pair(k)
        if self.value(i) == "if" and self.value(close + 1) == "else":
            return self.block_end(close + 2, j) if self.value(close + 2) == "if" else self.pair(close + 2) + 1
        return close + 1

    def inner(self, i: int, stop: int, parent: str) -> Iterator[Element]:
        """Statements of the block of the statement i..stop, and of what follows ``else``."""
        k = self.block(i, stop)
        if k >= stop:
            return
        close = self.pair(k)
        yield from self.statements(k + 1, close, parent)
        if self.value(close + 1) == "else":
            if self.value(close + 2) == "if":
                yield from self.statements(close + 2, stop, parent)
            elif self.value(close + 2) == "{":
                yield from self.statements(close + 3, self.pair(close + 2), parent)

    def simple(self, i: int, stop: int) -> str:
        signs, k = [], i
        while k < stop:
            signs.append(self.value(k))
            k = self.pair(k) + 1 if self.value(k) in _OPEN else k + 1
        if any(s in (":=", "=", "++", "--") or (len(s) == 2 and s[1] == "=" and s not in ("==", "!=", "<=", ">=")) for s in signs):
            return "assign"
        return "send" if "<-" in signs[1:] else "expr"

    def types(self, i: int, stop: int) -> Iterator[Element]:
        name = self.value(i)
        yield "type", name
        yield "ident:type-name", name
        kind = self.value(i + 1)
        if kind not in ("struct", "interface") or self.value(i + 2) != "{":
            return
        yield kind, name
        for a, b in self.split(i + 3, self.pair(i + 2), ";"):
            if kind == "interface" and self.value(a + 1) == "(":
                yield "method", self.value(a) + self.signature(a + 1)[0]
                yield "ident:method-name", self.value(a)
            elif kind == "struct" and b - a >= 2 and self.value(a + 1) != "." and self.t[a][0] == "name":
                tagless = b - 1 if self.t[b - 1][0] == "text" else b
                for n, t in self.fields(a, tagless):
                    if n:
                        yield "field", f"{name}\0{n} {t}"
                        yield "ident:field-name", n

    def run(self) -> Iterator[Element]:
        i, imports, rest = 0, [], []
        if self.value(0) != "package":
            raise ValueError("no package clause")
        yield "package", self.value(1)
        while i < len(self.t):
            word = self.value(i)
            stop = self.end(i)
            if word in ("import", "type", "var", "const"):
                group = self.value(i + 1) == "("
                spans = self.split(i + 2, self.pair(i + 1), ";") if group else [(i + 1, stop)]
                for a, b in spans:
                    if word == "import":
                        imports.append(("import", self.value(b - 1)))
                    elif word == "type":
                        rest += self.types(a, b)
                    else:
                        head = next((k for k in range(a, b) if self.value(k) == "="), b)
                        for n, t in self.fields(a, head) if head - a > 1 else [(self.value(a), "")]:
                            rest.append(("ident:var-name", f"{n or t} {t}".strip() if n else t))
                        rest.append(("var", f"{word} {self.source(a, b)}"))
            elif word == "func":
                rest += self.function(i)
            i = max(stop, i) + 1
        yield from imports
        yield from rest

    def function(self, i: int) -> Iterator[Element]:
        k, owner = i + 1, None
        if self.value(k) == "(":
            owner = (self.fields(k + 1, self.pair(k)) or [("", "")])[0]
            k = self.pair(k) + 1
        name = self.value(k)
        k += 1
        if self.value(k) == "[":
            k = self.pair(k) + 1
        text, names, k = self.signature(k)
        if owner:
            yield "method", f"{owner[0]}\0{owner[1]}.{name}{text}"
            yield "ident:method-name", name
            if owner[0]:
                yield "ident:receiver", owner[0]
        else:
            yield "func", name + text
            yield "ident:func-name", name
        yield from names
        if self.value(k) == "{":
            yield from self.statements(k + 1, self.pair(k), name)


def go_directives(text: str) -> list[Element]:
    """Directives, each with the name of the next declaration below it."""
    out, name = [], ""
    for line in reversed(text.split("\n")):
        line = line.strip()
        if line.startswith("//go:"):
            out.append(("directive", f"{name}\0{line}"))
        elif m := re.match(r"(?:var|type|func|const)\s+(\w+)", line, re.A):
            name = m.group(1)
    return out[::-1]


def go_elements(text: str) -> list[Element]:
    """Directives, package, imports, then declarations with their bodies' statements; directives only where the text cannot be read.

    Taken: grouped and single declarations, structs and interfaces, functions and methods with named and unnamed results and type parameters,
    and statements of if, else, for, switch and select, whose cases are given whole. Not taken: labels and embedded fields.
    """
    try:
        body = list(_Go(text).run())
    except (ValueError, IndexError):
        body = []
    return go_directives(text) + body


READERS: dict[str, Callable[[str], list[Element]]] = {"go": go_elements, "js": js_elements}


def register_reader(language: str, read: Callable[[str], list[Element]]) -> None:
    """Make a reader of one's own known to :func:`source_elements`: it gives the (tag, value) of a text in order."""
    READERS[language] = read


def source_elements(files: DataFrame, key: Column, text: Column, language: str) -> DataFrame:
    """(path, pos, tag, value) of each file's elements, file by file in Arrow batches; null texts have none."""
    ship(files.sparkSession)
    read = READERS[language]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, t, v) for p, s in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) if s for i, (t, v) in enumerate(read(s))]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["path", "pos", "tag", "value"])

    return files.select(key.cast("string").alias("path"), text.alias("text")).mapInArrow(run, "path string, pos int, tag string, value string")


def script_elements(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """Elements of the texts that look like scripts."""
    signs = F.lit(False)
    for sign in ("import ", "export ", "function ", "<script"):
        signs = signs | F.contains(text, F.lit(sign))
    return source_elements(docs.where(signs), key, text, "js")
