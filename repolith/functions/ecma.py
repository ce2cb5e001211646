"""TypeScript and JavaScript by their tokens: what a file imports, exports, defines and calls.

A lexer passes over strings, template literals (with the code in them), regular
expressions and comments, and pairs the brackets; the rest looks at tokens. Bodies
of functions and classes are passed over for nodes, as definitions inside them are
not a file's own; arguments of calls are not.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import cached_property

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[#A-Za-z_$\x80-\U0010ffff][\w$]*)|(?P<num>\.?\d[\w.]*)
    |(?P<str>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<punct>=>|\.\.\.|\?\.(?!\d)|[=!]==?|[<>]=|[-+*%&|^?]+=|.)""",
    re.X | re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
CHUNK = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.S)
CLOSES = {")": "(", "]": "[", "}": "{"}
OPENS = {"(", "[", "{", "${"}
#: Words behind which an expression begins, so that a slash opens a regular expression and a line end is no end.
BEFORE_VALUE = set("return typeof case in of delete void throw new instanceof else do yield await extends default".split())
#: Words that go on with an expression on the next line.
GO_ON = set("instanceof in of as satisfies extends is implements".split())
MODIFIERS = set("public private protected static readonly override abstract async get set declare accessor *".split())
NOT_CALLED = set("if for while switch catch function return typeof await super import with constructor new in of do else void delete throw yield case".split())
TYPE_OPEN = set(": | & < , ( [ => is extends ?".split())
IDENTIFIER = re.compile(r"[a-zA-Z_$][a-zA-Z0-9_$]*")


class Source:
    def __init__(self, text: str):
        self.text = text
        self.kind: list[str] = []
        self.tok: list[str] = []
        self.pos: list[int] = []
        self.match: dict[int, int] = {}
        self._lex()
        self.n = len(self.tok)
        self.newlines = [m.start() for m in re.finditer("\n", text)]
        self.lines = text.split("\n")

    # --- lexer ------------------------------------------------------------------

    def _add(self, kind: str, text: str, at: int) -> None:
        self.kind.append(kind)
        self.tok.append(text)
        self.pos.append(at)

    def _lex(self) -> None:
        text, at, open_ = self.text, 0, []
        if text.startswith("#!"):
            at = len(text) if "\n" not in text else text.index("\n")

        def template(start: int, kind: str) -> int:
            m = CHUNK.match(text, start)
            self._add(kind, "`", start - 1)
            if m[1] == "${":
                open_.append(len(self.tok))
                self._add("punct", "${", m.end() - 2)
            return m.end()

        while at < len(text):
            if text[at] == "`":
                at = template(at + 1, "template")
                continue
            m = TOKEN.match(text, at)
            kind, word = m.lastgroup, m[0]
            if kind == "space":
                at = m.end()
                continue
            if word == "/" and self._value_may_begin() and (r := REGEX.match(text, at)):
                self._add("regex", r[0], at)
                at = r.end()
                continue
            if word in CLOSES and open_:
                partner = self.tok[open_[-1]]
                if partner == CLOSES[word] or (word == "}" and partner == "${"):
                    first = open_.pop()
                    self.match[first], self.match[len(self.tok)] = len(self.tok), first
                    self._add("punct", word, at)
                    at = m.end() if partner != "${" else template(m.end(), "more")
                    continue
            if word in OPENS:
                open_.append(len(self.tok))
            self._add(kind, word, at)
            at = m.end()
        for first in open_:  # what is never closed ends with the file
            self.match[first] = len(self.tok)

    def _value_may_begin(self) -> bool:
        if not self.tok:
            return True
        kind, word = self.kind[-1], self.tok[-1]
        return word in BEFORE_VALUE if kind == "name" else kind == "punct" and word not in (")", "]", "}", "<")

    # --- places -----------------------------------------------------------------

    def at(self, i: int) -> str:
        return self.tok[i] if 0 <= i < self.n else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < self.n and self.kind[i] == "name"

    def line(self, i: int) -> int:
        return bisect_right(self.newlines, self.pos[i] - 1) + 1 if i < self.n else len(self.newlines) + 1

    def end_line(self, i: int) -> int:
        """Line of the last token before i."""
        return self.line(max(i - 1, 0))

    def new_line(self, i: int) -> bool:
        """Whether a token is the first of its line."""
        return i == 0 or i < self.n and "\n" in self.text[self.pos[i - 1] + len(self.tok[i - 1]) : self.pos[i]]

    def over(self, i: int) -> int:
        """The token behind a bracket's partner."""
        return min(self.match.get(i, self.n - 1) + 1, self.n)

    def ends_value(self, i: int) -> bool:
        return self.kind[i] != "punct" and self.tok[i] not in BEFORE_VALUE or self.tok[i] in (")", "]", "}")

    def begins(self, i: int) -> bool:
        return self.kind[i] in ("name", "str", "num") and self.tok[i] not in GO_ON or self.tok[i] in ("{", "@")

    def statement(self, i: int) -> bool:
        """Whether a statement can begin here."""
        if i == 0 or self.at(i - 1) in (";", "{", "}", "export", "default", "declare", "else") and self.kind[i - 1] in ("punct", "name"):
            return True
        return self.new_line(i) and self.ends_value(i - 1)

    def value_end(self, i: int, stops: str = ";,)]}") -> int:
        """The token behind an expression: a closing bracket, comma or semicolon, or one that a line end cuts off."""
        j = i
        while j < self.n:
            if self.tok[j] in stops and self.kind[j] == "punct":
                break
            if j > i and self.new_line(j) and self.begins(j) and self.ends_value(j - 1):
                break
            j = self.over(j) if self.tok[j] in OPENS and self.kind[j] == "punct" else j + 1
        return min(j, self.n)

    def angles(self, i: int) -> int:
        """The token behind <...>, or i itself if that isn't a list of types."""
        depth, j = 0, i
        while j < min(self.n, i + 400):
            t = self.tok[j]
            depth += (t == "<") - (t == ">")
            if not depth:
                return j + 1
            if t in (";", ")", "]", "}") or self.kind[j] == "template":
                return i
            j = self.over(j) if t in OPENS else j + 1
        return i

    def body(self, i: int) -> int | None:
        """The brace that opens the body of a function whose name ends before i; None if there is none."""
        if self.at(i) == "<":
            i = self.angles(i)
        if self.at(i) != "(":
            return None
        j = self.over(i)
        if self.at(j) == ":":
            j += 1
            while j < self.n:
                t = self.tok[j]
                if t == "{" and self.tok[j - 1] not in TYPE_OPEN:
                    return j
                if t in (";", "}", ")", ",") or t != "{" and self.new_line(j) and self.begins(j) and self.ends_value(j - 1):
                    return None
                j = self.angles(j) if t == "<" and self.angles(j) > j else self.over(j) if t in OPENS else j + 1
        return j if self.at(j) == "{" else None

    def arrow(self, i: int) -> bool:
        """Whether an arrow function begins here."""
        j = i + 1 if self.at(i) == "async" and not self.new_line(i + 1) else i
        if self.at(j) == "<":
            j = self.angles(j)
        if self.is_name(j) and self.at(j + 1) == "=>":
            return True
        if self.at(j) != "(":
            return False
        j = self.over(j)
        if self.at(j) == ":":
            while j < self.n and self.tok[j] not in ("=>", ";", ")", "]", "}"):
                j = self.over(j) if self.tok[j] in OPENS else j + 1
        return self.at(j) == "=>"

    def function(self, i: int) -> bool:
        return self.at(i) == "function" or self.at(i) == "async" and self.at(i + 1) == "function"

    def chain_start(self, i: int) -> int:
        """Where a.b().c, which ends with the name i, begins; with the word new before it."""
        j = i
        while self.at(j - 1) in (".", "?."):
            k = j - 2
            if self.at(k) == "!":
                k -= 1
            while self.at(k) in (")", "]", "}") and k in self.match:
                k = self.match[k]
                if self.at(k - 1) in (")", "]") or self.is_name(k - 1) and self.at(k - 1) not in BEFORE_VALUE:
                    k -= 1
                else:
                    break
            if k < 0 or self.kind[k] == "punct" and self.tok[k] not in OPENS:
                break
            j = k
        return j - 1 if self.at(j - 1) == "new" else j

    def unquoted(self, i: int) -> str:
        return self.tok[i][1:].removesuffix(self.tok[i][0])

    # --- nodes ------------------------------------------------------------------

    @cached_property
    def nodes(self) -> list[tuple]:
        """(type, name, signature, start_line, end_line, names): names are the local names of an import, the names of an export, the signature lines of a class's methods."""
        out: list[tuple] = []
        self._walk(0, self.n, out)
        return sorted(out, key=lambda x: (x[3], -x[4]))

    def _walk(self, i: int, end: int, out: list[tuple]) -> None:
        while i < end:
            i = max(self._node(i, out), i + 1)

    def signature(self, i: int) -> str:
        return self.lines[self.line(i) - 1].strip()

    def _node(self, i: int, out: list[tuple]) -> int:
        t = self.tok[i]
        if t == "=" and self.kind[i] == "punct":
            return self._assignment(i, out)
        if self.kind[i] != "name" or self.at(i - 1) in (".", "?.") or self.at(i + 1) == ":":
            return i + 1
        if t == "require" and self.at(i + 1) == "(":
            close = self.over(i + 1)
            spec = next((j for j in self._items(i + 1) if self.kind[j] == "str"), None)
            if spec is not None and self.unquoted(spec):
                out.append(("import", self.unquoted(spec), self.signature(i), self.line(i), self.end_line(close), []))
            return i + 1
        lead = i - 1 if self.at(i - 1) in ("async", "abstract", "const", "declare") and t in ("function", "class", "enum", "abstract") else i
        if not self.statement(lead) and not (t in ("const", "let") and self.at(i - 1) == "("):
            return i + 1
        if t == "import" and self.at(i + 1) not in ("(", "."):
            return self._import(i, out)
        if t == "export":
            return self._export(i, out)
        if t == "function":
            named = i + 2 if self.at(i + 1) == "*" else i + 1
            brace = self.body(named + 1) if self.is_name(named) else None
            if brace is None:
                return i + 1
            out.append(("function", self.tok[named], self._bare(lead, brace), self.line(lead), self.end_line(self.over(brace)), []))
            return self.over(brace)
        if t in ("class", "interface") and self.is_name(i + 1) and self.at(i + 1) not in ("extends", "implements"):
            brace = self.brace(i + 2)
            if brace is None:
                return i + 1
            methods = [self._bare(first, b) for first, name, b in self.members(brace) if b is not None or self.at(name + 1) not in ("(", "<")] if t == "class" else []
            out.append((t, self.tok[i + 1], f"{t} {self.tok[i + 1]}", self.line(lead), self.end_line(self.over(brace)), methods))
            return self.over(brace)
        if t in ("const", "let"):
            return self._lexical(i, out)
        return i + 1

    def _bare(self, i: int, brace: int | None = None) -> str:
        """A signature's line without the body and what ends a statement."""
        line = self.lines[self.line(i) - 1]
        if brace is not None and self.line(brace) == self.line(i):
            line = line[: self.pos[brace] - (self.newlines[self.line(i) - 2] + 1 if self.line(i) > 1 else 0)]
        return re.sub(r"\s*(\{|;)\s*$", "", line).strip()

    def _items(self, i: int) -> list[int]:
        """The tokens directly inside a bracket."""
        out, j, end = [], i + 1, self.match.get(i, self.n)
        while j < end:
            out.append(j)
            j = self.over(j) if self.tok[j] in OPENS and self.kind[j] == "punct" else j + 1
        return out

    def brace(self, i: int) -> int | None:
        """The brace that opens the body of a class or interface whose name ends before i."""
        while i < self.n:
            t = self.tok[i]
            if t == "{" and self.tok[i - 1] not in TYPE_OPEN - {"extends"}:
                return i
            if t in (";", ")", "}"):
                return None
            i = self.angles(i) if t == "<" and self.angles(i) > i else self.over(i) if t in OPENS else i + 1
        return None

    def names(self, i: int, end: int) -> list[str]:
        """Local names of an import's or export's clause: an alias goes before the name."""
        out, j = [], i
        while j < end:
            if self.tok[j] in ("{", "}", ",", "*", "type", "typeof") and not (self.tok[j] == "type" and self.at(j + 1) in (",", "}", "from", "as")):
                j += 1
            elif self.is_name(j) and self.tok[j] != "from":
                if self.at(j + 1) == "as":
                    j += 2
                if self.tok[j] != "as" or self.at(j - 1) != "*":
                    out.append(self.unquoted(j) if self.kind[j] == "str" else self.tok[j])
                j += 1
            else:
                j += 1
        return out

    def _clause(self, i: int) -> tuple[int | None, int]:
        """The string that ends an import or export clause from i on, and the token behind the statement."""
        j = i
        while j < self.n and self.tok[j] != ";" and not (j > i and self.new_line(j) and self.begins(j) and self.ends_value(j - 1) and self.at(j - 1) != "from"):
            if self.kind[j] == "str":
                j += 1
                while self.at(j) in ("with", "assert", "{", ")"):
                    j = self.over(j) if self.tok[j] == "{" else j + 1
                return next(k for k in range(i, j) if self.kind[k] == "str"), j + (self.at(j) == ";")
            j = self.over(j) if self.tok[j] in OPENS and self.kind[j] == "punct" and not self._has_string(j) else j + 1
        return None, j + (self.at(j) == ";")

    def _has_string(self, i: int) -> bool:
        return self.tok[i] == "(" and self.at(i - 1) == "require"

    def _import(self, i: int, out: list[tuple]) -> int:
        spec, end = self._clause(i + 1)
        if spec is None:
            return i + 1
        clause = next((k for k in range(i + 1, spec) if self.tok[k] in ("from", "=") and self.at(k + 1) in (self.tok[spec], "require")), i + 1)
        out.append(("import", self.unquoted(spec), self.signature(i), self.line(i), self.end_line(end), self.names(i + 1, clause)))
        return end

    def _export(self, i: int, out: list[tuple]) -> int:
        j = i + 1
        if self.at(j) in ("{", "*") or self.at(j) == "type" and self.at(j + 1) in ("{", "*"):
            spec, end = self._clause(j)
            source = self.unquoted(spec) if spec is not None else ""
            clause = next((k for k in range(j, end) if self.tok[k] == "from"), end)
            out.append(("export", source, self.signature(i), self.line(i), self.end_line(end), [x for x in self.names(j, clause) if x]))
            return end
        if self.at(j) != "default":
            return j
        j += 1
        lead = j + 1 if self.at(j) in ("async", "abstract") else j
        brace = None
        if self.at(lead) == "function":
            named = lead + 2 if self.at(lead + 1) == "*" else lead + 1
            name = self.tok[named] if self.is_name(named) else "default"
            brace = self.body(named + 1 if self.is_name(named) else named)
            end = self.over(brace) if brace is not None else named + 1
        elif self.at(lead) in ("class", "interface"):
            name = self.tok[lead + 1] if self.is_name(lead + 1) and self.at(lead + 1) not in ("extends", "implements") else "default"
            brace = self.brace(lead + 1 if name == "default" else lead + 2)
            end = self.over(brace) if brace is not None else lead + 1
        else:
            end = self.value_end(j)
            call = self.is_name(j) and self.at(end - 1) == ")" and not self.arrow(j) and self.at(j) not in ("new", "async")
            if not call and not (self.is_name(j) and end == j + 1):
                return j
            name = self.text[self.pos[j] : self.pos[next(k for k in range(j, end) if self.tok[k] == "(")] if call else self.pos[j] + len(self.tok[j])].strip()[:50]
            end += self.at(end) == ";"
        out.append(("export_default", name, self._bare(i, brace), self.line(i), self.end_line(end), []))
        return end

    def _lexical(self, i: int, out: list[tuple]) -> int:
        j = i + 1
        while j < self.n:
            first = j
            if self.at(j) not in ("{", "[") and not self.is_name(j):
                return j
            j = self.over(j) if self.tok[j] in OPENS else j + 1
            name = self.text[self.pos[first] : self.pos[j - 1] + len(self.tok[j - 1])]
            j += self.at(j) == "!"
            if self.at(j) == ":":
                while j < self.n and self.tok[j] not in ("=", ";", ",", ")", "}") and not (self.new_line(j) and self.begins(j) and self.ends_value(j - 1)):
                    j = self.angles(j) if self.tok[j] == "<" and self.angles(j) > j else self.over(j) if self.tok[j] in OPENS else j + 1
            if self.at(j) == "=":
                value, j = j + 1, self.value_end(j + 1)
                if value >= self.n:
                    return j
                if self.function(value) or self.arrow(value):
                    out.append(("arrow_function", name, re.sub(r"\s*=>\s*\{.*$", " => ...", self._bare(first)), self.line(first), self.end_line(j), []))
                elif self.is_name(value) and self.tok[value] not in BEFORE_VALUE and self.at(j - 1) == ")":
                    self._walk(value, j, out)
            if self.at(j) != ",":
                return j
            j += 1
        return j

    def _assignment(self, i: int, out: list[tuple]) -> int:
        member = lambda k: self.is_name(k - 1) and self.at(k - 2) in (".", "?.")
        if not member(i) and not (self.is_name(i - 1) and self.statement(i - 1) and self.at(i - 2) not in ("export", "default", "declare")):
            return i + 1
        targets, right = [i], i + 1
        while True:  # a = b = function () {}
            j = right
            while self.is_name(j) or self.at(j) in (".", "?.", "["):
                j = self.over(j) if self.tok[j] == "[" else j + 1
            if j == right or self.at(j) != "=":
                break
            targets.append(j)
            right = j + 1
        end = self.value_end(i + 1)
        if self.function(right) or self.arrow(right):
            for k in targets:
                if member(k) and IDENTIFIER.fullmatch(self.tok[k - 1]):
                    start = self.chain_start(k - 1)
                    out.append(("method", self.tok[k - 1], self._bare(start)[:200], self.line(start), self.end_line(end), []))
        return end

    # --- calls ------------------------------------------------------------------

    def members(self, brace: int) -> list[tuple[int, int, int | None]]:
        """Of a class's body: each member's first token, its name, and the brace that opens its body."""
        out, j, end = [], brace + 1, self.match.get(brace, self.n)
        while j < end:
            if self.tok[j] in (";", ","):
                j += 1
                continue
            while self.at(j) == "@":
                j += 2
                while self.at(j) in (".", "("):
                    j = self.over(j) if self.tok[j] == "(" else j + 2
            first = j
            while self.at(j) in MODIFIERS and self.at(j + 1) not in ("(", "=", ";", ":", "?", "!", "<", "}"):
                j += 1
            if j >= end:
                break
            if self.tok[j] == "{":  # a static block
                j = self.over(j)
                continue
            name = j
            j = self.over(j) if self.tok[j] == "[" else j + 1
            j += self.at(j) in ("?", "!")
            if self.at(j) in ("(", "<"):
                brace_of = self.body(j)
                out.append((first, name, brace_of))
                j = self.over(brace_of) if brace_of is not None else max(self.value_end(j, ";}"), j + 1)
            else:
                out.append((first, name, None))
                j = max(self.value_end(j, ";}"), j)
        return out

    def _scopes(self) -> tuple[dict[int, tuple[int, str]], set[int], list[tuple[int, int]]]:
        """Token where a named function begins -> (end, name); names that are declared, not called; ranges of types."""
        spans: dict[int, tuple[int, str]] = {}
        declared: set[int] = set()
        types: list[tuple[int, int]] = []
        for i in range(self.n):
            t, kind = self.tok[i], self.kind[i]
            if kind == "punct" and t == "=" and (self.function(i + 1) or self.arrow(i + 1)) and self.is_name(i - 1):
                spans.setdefault(i + 1, (self.value_end(i + 1), self.tok[i - 1]))
            if kind != "name" or self.at(i - 1) in (".", "?."):
                continue
            if t == "function":
                named = i + 2 if self.at(i + 1) == "*" else i + 1
                if self.is_name(named):
                    declared.add(named)
                    if (brace := self.body(named + 1)) is not None:
                        spans[named] = (self.over(brace), self.tok[named])
            elif t == "class" and self.at(i + 1) != ":":
                brace = self.brace(i + 1)
                for _, name, inner in self.members(brace) if brace is not None else []:
                    if self.at(name + 1) in ("(", "<", "?", "!"):
                        declared.add(name)
                    if inner is not None:
                        spans[name] = (self.over(inner), self.tok[name])
            elif t == "interface" and self.is_name(i + 1) and self.statement(i) and (brace := self.brace(i + 2)) is not None:
                types.append((i, self.over(brace)))
            elif t == "type" and self.is_name(i + 1) and self.statement(i):
                types.append((i, self.value_end(i + 1)))
            elif self.at(i + 1) == "(" and t not in NOT_CALLED and self.at(self.over(i + 1)) == "{" and not self.new_line(self.over(i + 1)) and self.at(i - 1) in ("{", ",", "async", "get", "set", "*", "}"):
                declared.add(i)  # a method of an object
                spans[i] = (self.over(self.over(i + 1)), t)
        return spans, declared, types

    @cached_property
    def calls(self) -> list[tuple[str, str, int]]:
        """(caller, callee, line): the callee is a name or a member's last name, the caller the innermost named function or ''."""
        spans, declared, types = self._scopes()
        out, inside, i, types = [], [(self.n, "")], 0, types[::-1]
        while i < self.n:
            while types and types[-1][0] < i:
                types.pop()
            if types and types[-1][0] == i:
                i = types.pop()[1]
                continue
            while inside[-1][0] <= i:
                inside.pop()
            if i in spans:
                inside.append(spans[i])
            if self.kind[i] == "name" and i not in declared and self.tok[i] not in NOT_CALLED and not (self.tok[i] == "async" and self.arrow(i)):
                j = i + 1
                if self.at(j) == "<":
                    j = self.angles(j)
                if self.at(j) == "(" or self.at(j) == "?." and self.at(j + 1) == "(" or j < self.n and self.kind[j] == "template" and j == i + 1:
                    out.append((inside[-1][1], self.tok[i], self.line(self.chain_start(i))))
            i += 1
        return out
