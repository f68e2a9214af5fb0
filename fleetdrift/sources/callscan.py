"""Where calls begin and end in source text: one linear pass over strings, comments, templates and brackets."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

TOKEN = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|$)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?|`|[(){}\[\],]|/")
REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
TEMPLATE = re.compile(r"\\[\s\S]|\$\{|`")
CALLEE = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*)\s*(?:\?\.)?\s*$")
BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};\n+*%~^-]|\breturn|\btypeof|=>)\s*$")
# words that a string may follow without a space; after any other word a quote is an apostrophe of tag text
BEFORE_STRING = frozenset("as await case default delete do else export extends from import in instanceof new of return throw typeof void yield".split())
NO_CALL = frozenset("if for while switch catch function return typeof await new".split())
PROPERTY = re.compile(r"""\s*(?:['"]([^'"]+)['"]|([A-Za-z_$][\w$-]*))\s*(:|$)""")
CLOSERS = {")": "(", "]": "[", "}": "{"}


class _Open:
    __slots__ = ("kind", "at", "cuts", "objects")

    def __init__(self, kind: str, at: int):
        self.kind, self.at, self.cuts, self.objects = kind, at, [], {}


def _regex_end(source: str, start: int) -> int | None:
    """Where the regular expression ends that begins at ``start``; None if the slash divides or belongs to a tag."""
    if source.startswith("/>", start) or not BEFORE_REGEX.search(source[max(0, start - 40) : start]):
        return None
    found = REGEX.match(source, start)
    return found.end() if found else None


def _is_apostrophe(source: str, at: int) -> bool:
    if source[at] != "'" or not (source[at - 1 : at].isalnum()):
        return False
    word = re.search(r"[\w$]+$", source[max(0, at - 40) : at])
    return word is None or word[0] not in BEFORE_STRING


def _callee(source: str, at: int) -> tuple[int, str] | None:
    """(start, name) of what is called by the bracket at ``at``; type arguments in between are skipped."""
    head = source[max(0, at - 400) : at]
    if head.rstrip().endswith(">"):
        depth, i = 0, len(head.rstrip()) - 1
        while i >= 0:
            depth += {">": 1, "<": -1}.get(head[i], 0) if not (head[i] == ">" and head[i - 1 : i] == "=") else 0
            if depth == 0:
                break
            i -= 1
        head = head[: max(i, 0)]
    found = CALLEE.search(head)
    if not found or found[1] in NO_CALL or re.search(r"\bfunction\s*$", head[: found.start(1)]):
        return None
    return max(0, at - 400) + found.start(1), found[1].replace("?.", ".")


class _Source:
    """A text and its comments so far, which arguments and properties leave out."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, [], []

    def plain(self, a: int, b: int) -> str:
        out = []
        for i in range(bisect_left(self.starts, a), bisect_left(self.starts, b)):
            out.append(self.text[a : self.starts[i]])
            a = min(self.ends[i], b)
        return "".join([*out, self.text[a:b]]).strip()


def _parts(source: _Source, opened: _Open, end: int) -> list[str]:
    edges = [opened.at, *opened.cuts, end]
    out = [source.plain(a + 1, b) for a, b in zip(edges, edges[1:])]
    return out[:-1] if out and not out[-1] else out


def _properties(source: _Source, opened: _Open, end: int) -> list[tuple[str, str]]:
    out = []
    for text in _parts(source, opened, end):
        if text.startswith("..."):
            out.append(("...", text[3:].strip()))
            continue
        found = PROPERTY.match(text)
        if found:
            name = found[1] or found[2]
            out.append((name, text[found.end() :].strip() if found[3] else name))
    return out


def scan_calls(source: str) -> Iterator[tuple[int, int, str, bool, list[str], list[list[tuple[str, str]]]]]:
    """(start, end, callee, closed, arguments, properties of each argument that is an object literal) per call."""
    stack: list[_Open] = []
    read = _Source(source)
    at, n = 0, len(source)
    while at < n:
        if stack and stack[-1].kind == "`":
            found = TEMPLATE.search(source, at)
            if not found:
                break
            at = found.end()
            if found[0] == "`":
                stack.pop()
            elif found[0] == "${":
                stack.append(_Open("${", found.start()))
            continue
        found = TOKEN.search(source, at)
        if not found:
            break
        token, start, at = found[0], found.start(), found.end()
        if token.startswith(("//", "/*")):
            read.starts.append(start)
            read.ends.append(at)
        elif token == "`":
            stack.append(_Open("`", start))
        elif token == "/":
            at = _regex_end(source, start) or at
        elif token[0] == "'" and _is_apostrophe(source, start):
            at = start + 1
        elif token in "([{":
            stack.append(_Open(token, start))
        elif token == ",":
            if stack:
                stack[-1].cuts.append(start)
        elif token in CLOSERS:
            kinds = ("{", "${") if token == "}" else (CLOSERS[token],)
            if not any(o.kind in kinds for o in stack):
                continue
            while stack[-1].kind not in kinds:  # never closed: what it opened cannot be delimited
                yield from _call(read, stack.pop(), None)
            opened = stack.pop()
            if opened.kind == "{" and stack and stack[-1].kind == "(":
                first = stack[-1].cuts[-1] if stack[-1].cuts else stack[-1].at
                if not read.plain(first + 1, opened.at):
                    stack[-1].objects[len(stack[-1].cuts)] = _properties(read, opened, start)
            if opened.kind == "(":
                yield from _call(read, opened, start)
    while stack:
        yield from _call(read, stack.pop(), None)


def _call(source: _Source, opened: _Open, end: int | None):
    if opened.kind != "(":
        return
    named = _callee(source.text, opened.at)
    if not named:
        return
    if end is None:
        yield named[0], opened.at + 1, named[1], False, [], []
        return
    texts = _parts(source, opened, end)
    yield named[0], end + 1, named[1], True, texts, [opened.objects.get(i, []) if text.startswith("{") else [] for i, text in enumerate(texts)]


def places(source: str, starts: list[int]) -> list[tuple[int, int]]:
    """(line, column) of offsets, counted from 1."""
    lines = [0, *(m.end() for m in re.finditer("\n", source))]
    return [(bisect_right(lines, s), s - lines[bisect_right(lines, s) - 1] + 1) for s in starts]


def plain_template(text: str) -> str:
    """A template literal whose substitutions are names, ``${name}``, or ``${0}`` for any other expression; other text as it is."""
    if not text.startswith("`"):
        return text
    out, at, depth = ["`"], 1, [""]  # what encloses each open expression
    begin = 0
    while at < len(text):
        if depth[-1] in ("", "`"):
            found = TEMPLATE.search(text, at)
            if not found:
                return text
            if len(depth) == 1:
                out.append(text[at : found.start()])
            at = found.end()
            if found[0] == "`":
                if len(depth) == 1:
                    return "".join([*out, "`"]) if at == len(text) else text
                depth.pop()
            elif found[0] == "${":
                begin = at if len(depth) == 1 else begin
                depth.append("{")
            elif len(depth) == 1:
                out.append(found[0])
            continue
        found = TOKEN.search(text, at)
        if not found:
            return text
        at = found.end()
        if found[0] in ("{", "`"):
            depth.append(found[0])
        elif found[0] == "}":
            depth.pop()
            if len(depth) == 1:
                name = text[begin : at - 1].strip()
                out.append(f"${{{name}}}" if re.fullmatch(r"[A-Za-z_$][\w$]*", name) else "${0}")
    return text


IMPORT = re.compile(r"""(?<![\w$.])(?:import\b(?:\s+type\b)?\s*(?:[\w$*\s{},]+?\bfrom\b\s*|[\w$*\s{},]*?[}*\w$]\s*from\s*)?|require\s*\(\s*)(?:'([^'\n]+)'|"([^"\n]+)")""")
QUOTED = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|$)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?|`(?:[^`\\]|\\[\s\S])*`?|/")


def scan_imports(source: str) -> list[tuple[int, str]]:
    """(start, specifier) of import declarations and ``require`` calls, over several lines too; none in comments or strings."""
    plain, done, at, inside = [], 0, 0, []
    while found := QUOTED.search(source, at):
        token, start, at = found[0], found.start(), found.end()
        if token == "/":
            at = _regex_end(source, start) or at
        elif (token[0] == "'" and _is_apostrophe(source, start)) or (token[0] == "`" and (token == "`" or token[-1] != "`")):
            at = start + 1  # an apostrophe or a lone backtick of tag text
        elif token.startswith(("//", "/*")):
            plain += [source[done:start], re.sub(r"[^\n]", " ", token)]
            done = at
        else:
            inside.append((start, at))
    text = "".join([*plain, source[done:]])
    starts = [a for a, _ in inside]
    out = []
    for found in IMPORT.finditer(text):
        i = bisect_right(starts, found.start()) - 1
        if i < 0 or inside[i][1] <= found.start():
            out.append((found.start(), found[1] or found[2]))
    return out
