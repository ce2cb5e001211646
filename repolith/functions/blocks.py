"""Definitions and imports of languages with blocks: patterns by line on text whose comments and strings are blanked out, ends by one pass over brackets."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

_SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE, _CHAR = r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"
#: Comments and strings by family.
COMMENTS = dict.fromkeys(("go", "rs", "java", "kt", "cs", "swift", "dart"), _SLASHES) | {"php": _SLASHES + r"|\#(?!\[)[^\n]*", "rb": r"\#[^\n]*|^=begin\b.*?^=end\b"}
STRINGS = {
    "go": rf"`[^`]*`?|{_DOUBLE}|{_CHAR}",
    "rs": rf'\br(?P<fence>\#*)".*?"(?P=fence)|"(?:\\.|[^"\\])*"|{_CHAR}',
    "java": rf'""".*?"""|{_DOUBLE}|{_CHAR}',
    "kt": rf'""".*?"""|{_DOUBLE}|{_CHAR}',
    "cs": rf'@"(?:""|[^"])*"|{_DOUBLE}|{_CHAR}',
    "swift": rf'""".*?"""|{_DOUBLE}',
    "dart": rf"""'{{3}}.*?'{{3}}|\"{{3}}.*?\"{{3}}|{_DOUBLE}|{_SINGLE}""",
    "php": rf"{_DOUBLE}|{_SINGLE}",
    "rb": rf"{_DOUBLE}|{_SINGLE}",
}
_SKIPPED = {fam: re.compile(f"(?P<comment>{COMMENTS[fam]})|(?P<string>{STRINGS[fam]})", re.S | re.M) for fam in COMMENTS}
_MARK = re.compile(r"[()\[\]{};\n]")
_CLOSES = {")": "(", "]": "[", "}": "{"}
_GO_BLOCK = re.compile(r"^import[ \t]*\(", re.M)
_RUBY_END, _RUBY_OPENS = re.compile(r"end\b"), re.compile(r"(?:class|module|def)\b")
_GOES_ON = re.compile(r"\s*(?:\{|throws\b|where\b|extends\b|implements\b|with\b|:)")


def without_comments(text: str, fam: str) -> tuple[str, str]:
    """The text with its comments and strings as blanks, and with its comments alone; places stay."""
    if fam not in _SKIPPED:
        return text, text
    code, plain, at = [], [], 0
    for m in _SKIPPED[fam].finditer(text):
        found, between = m[0], text[at : m.start()]
        blank = " " * len(found) if "\n" not in found else "\n".join(" " * len(x) for x in found.split("\n"))
        code += (between, blank)
        plain += (between, found if m["comment"] is None else blank)
        at = m.end()
    return "".join((*code, text[at:])), "".join((*plain, text[at:]))


def blanked(text: str, fam: str, strings: bool) -> str:
    """The text with its comments, and its strings if wanted, as blanks."""
    return without_comments(text, fam)[0 if strings else 1]


def partners(code: str) -> dict[int, int]:
    """Each opening bracket's closing one, in one pass. One that isn't closed has none."""
    out, open_ = {}, []
    for m in _MARK.finditer(code):
        c = m[0]
        if c in "([{":
            open_.append(m.start())
        elif c in _CLOSES:
            for k in range(len(open_) - 1, -1, -1):
                if code[open_[k]] == _CLOSES[c]:
                    out[open_[k]] = m.start()
                    del open_[k:]
                    break
    return out


def body_end(code: str, at: int, pairs: dict[int, int]) -> int:
    """Where the body of a definition ends whose name ends before a place; where its signature does, if it has none."""
    while m := _MARK.search(code, at):
        c, at = m[0], m.end()
        if c in "([":
            at = pairs.get(m.start(), m.start()) + 1
        elif c == "{":
            return pairs.get(m.start(), len(code) - 1)
        elif c in ")]};":
            return m.start()
        elif code[: m.start()].rstrip(" \t\r")[-1:] not in (",", "(", "<", ":", "=", "|", "&", "\n") and not _GOES_ON.match(code, at):
            return m.start()
    return max(len(code) - 1, 0)


def ruby_ends(lines: list[str]) -> dict[int, int]:
    """The line of the end of each line that opens a block: the next `end` of its indent."""
    out, open_ = {}, {}
    for i, line in enumerate(lines):
        word = line.lstrip(" \t")
        indent = line[: len(line) - len(word)]
        if _RUBY_END.match(word):
            if indent in open_:
                out[open_.pop(indent)] = i
        elif _RUBY_OPENS.match(word):
            open_[indent] = i
    return out


def nodes(text: str, fam: str, rules: list[tuple[str, re.Pattern]], imports: list[re.Pattern]) -> list[tuple]:
    """(type, name, signature, start_line, end_line): definitions by the rules, imports by theirs; of Go's import blocks also the block, by its first name."""
    code, plain = without_comments(text, fam)
    shown = text.split("\n")
    starts = [0, *accumulate(len(x) + 1 for x in shown[:-1])]
    line_of = lambda at: bisect_right(starts, at)
    pairs = partners(code) if fam != "rb" else {}
    ends = ruby_ends(code.split("\n")) if fam == "rb" else {}
    out = []
    for i, line in enumerate(code.split("\n")):
        if not line or line.isspace():
            continue
        for kind, rule in rules:
            if m := rule.match(line):
                last = ends.get(i, i) + 1 if fam == "rb" else line_of(body_end(code, starts[i] + m.end(1), pairs))
                out.append((kind, m[1], shown[i].strip().rstrip("{").strip(), i + 1, max(last, i + 1)))
                break
    for rule in imports:
        for m in rule.finditer(plain):
            if m[1]:
                line = line_of(m.start(1))
                out.append(("import", m[1], shown[line - 1].strip(), line, line_of(m.end(1))))
    if fam == "go":
        for m in _GO_BLOCK.finditer(code):
            first, last = line_of(m.start()), line_of(pairs.get(m.end() - 1, m.end()))
            inner = sorted(x[3] for x in out if x[0] == "import" and first < x[3] <= last)
            if inner:
                out.append(("import", next(x[1] for x in out if x[0] == "import" and x[3] == inner[0]), shown[first - 1].strip(), first, last))
    return sorted(set(out), key=lambda x: (x[3], -x[4], x[0], x[1]))
