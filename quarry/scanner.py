"""Symbols of Go, Rust, TypeScript, Java and C by a lexer and a stack of scopes.

A table names each language's comments, strings and keywords.  The lexer turns a text into identifiers
and punctuation, with strings and comments out of the way, and pairs its brackets.  One pass over the
tokens then finds declarations by the keyword or shape before a name, and uses by what stands next to
it: a bracket after it, a dot before it, a type's place.  It is no grammar: what a reader would call
a use is found in ordinary code, and `tests/test_scanner.py` holds how much of it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Comments, strings and character literals of each language, in the order they are tried.
_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_QUOTED = r'"(?:[^"\\\n]|\\.)*"?'
_CHAR = r"'(?:[^'\\\n]|\\.)+'"
SKIPPED = {
    "go": (_C_COMMENT, rf"`[^`]*`?|{_QUOTED}|{_CHAR}"),
    "rust": (r"//[^\n]*", r'b?r(#*)".*?"\1|b?"(?:[^"\\]|\\.)*"?|b?\'(?:[^\'\\\n]|\\[^\n]+?)\''),
    "typescript": (_C_COMMENT, rf"{_QUOTED}|'(?:[^'\\\n]|\\.)*'?"),
    "java": (_C_COMMENT, rf'"""(?:[^\\]|\\.)*?"""|{_QUOTED}|{_CHAR}'),
    "c": (rf"{_C_COMMENT}|^[ \t]*\#(?:[^\n\\]|\\.)*", rf"L?{_QUOTED}|L?{_CHAR}"),
}
LANGUAGES = tuple(SKIPPED)
#: Words of each language that are never names of a use.
WORDS = {
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while yield",
    "typescript": "abstract as async await break case catch class const continue debugger declare default delete do else enum export extends false finally for from function get if implements import in instanceof interface keyof let namespace new null of private protected public readonly return satisfies set static super switch this throw true try type typeof undefined var void while with yield",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new null package private protected public record return short static strictfp super switch synchronized this throw throws transient true false try var void volatile while yield",
    "c": "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool _Atomic _Generic",
}
WORDS = {k: frozenset(v.split()) for k, v in WORDS.items()}
#: Types that no repository defines.
BUILT_IN = {
    "go": frozenset("any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr".split()),
    "typescript": frozenset("any bigint boolean never null number object string symbol undefined unknown void".split()),
}
#: Characters of a signature at most; the pattern of an identifier and of the other tokens.
SIGNATURE = 500
_NAME = r"[^\W\d][\w$]*|\$[\w$]*"
_OTHER = r"\d[\w.]*(?<!\.)|::|->|=>|\.\.\.|[^\s\w]"
_PATTERN = {k: re.compile(rf"(?P<comment>{c})|(?P<string>{s})|(?P<name>{_NAME})|(?P<other>{_OTHER})", re.S | re.M) for k, (c, s) in SKIPPED.items()}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


class Symbol(NamedTuple):
    name: str
    tag: str
    start_line: int
    end_line: int
    signature: str | None
    #: What kind of definition it is; of a use, nothing.
    kind: str
    #: Offsets in the text, to find what lies in what.
    start: int
    end: int


class Tokens:
    """Names and punctuation of a text; `pair` leads from a bracket to its other one (or to the end)."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.language = text, language
        self.value: list[str] = []
        self.start: list[int] = []
        self.line: list[int] = []
        self.named: list[bool] = []
        self._read()
        self.pair = {}
        waiting: list[int] = []
        for i, v in enumerate(self.value):
            if v in _OPEN:
                waiting.append(i)
            elif v in _CLOSE:
                at = len(waiting) - 1
                while at >= 0 and self.value[waiting[at]] != _CLOSE[v]:
                    at -= 1  # an opening bracket that was never closed
                if at >= 0:
                    self.pair[waiting[at]], self.pair[i] = i, waiting[at]
                    del waiting[at:]
        self.pair |= {i: len(self.value) - 1 for i in waiting}

    def _add(self, value: str, at: int, named: bool) -> None:
        self.value.append(value)
        self.start.append(at)
        self.named.append(named)

    def _read(self) -> None:
        text, language = self.text, self.language
        read, at, size = _PATTERN[language].search, 0, len(text)
        depth, templates = 0, []
        while at < size:
            m = read(text, at)
            if m is None:
                break
            kind, value, start, at = m.lastgroup, m[0], m.start(), m.end()
            if kind == "name":
                self._add(value, start, True)
            elif kind == "string":
                self._add('""', start, False)
            elif kind == "comment":
                continue
            elif language == "rust" and text.startswith("/*", start):
                at = _nested(text, start)
            elif language == "rust" and value == "'":
                at = re.compile(r"\w*").match(text, at).end()  # a lifetime
            elif language == "typescript" and value == "/" and self._no_operand():
                at = _regex(text, start)
                self._add('""', start, False)
            elif language == "typescript" and (value == "`" or (value == "}" and templates and templates[-1] == depth)):
                if value == "}":
                    templates.pop()
                    self._add(")", start, False)
                at, inside = _template(text, at)
                self._add('""', start, False)
                if inside:
                    templates.append(depth)
                    self._add("(", at - 1, False)
            else:
                depth += (value == "{") - (value == "}")
                self._add(value, start, False)
        line, seen = 1, 0
        for start in self.start:
            line += text.count("\n", seen, start)
            seen = start
            self.line.append(line)

    def _no_operand(self) -> bool:
        """Whether a slash begins a regular expression here: nothing that could be divided comes before it."""
        before = self.value[-1] if self.value else "("
        return before in ("return", "typeof", "case", "in", "of", "=>") or not (self.named[-1:] == [True] or before in (")", "]", "}", '""') or before[0].isdigit())

    def at(self, i: int) -> str:
        return self.value[i] if 0 <= i < len(self.value) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.value) and self.named[i] and self.value[i] not in WORDS[self.language]

    def past(self, i: int) -> int:
        """The place after a token, or after its bracket's other one."""
        return self.pair.get(i, i) + 1 if self.at(i) in _OPEN else i + 1

    def angles(self, i: int) -> int:
        """The place after `<...>` if one begins here."""
        if self.at(i) != "<":
            return i
        depth = 0
        for k in range(i, min(len(self.value), i + 200)):
            depth += (self.value[k] == "<") - (self.value[k] == ">")
            if depth == 0:
                return k + 1
        return i

    def end_of(self, i: int) -> int:
        return self.start[i] + (2 if self.value[i] == '""' else len(self.value[i]))


def _nested(text: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _regex(text: str, at: int) -> int:
    m = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*").match(text, at)
    return m.end() if m else at + 1


def _template(text: str, at: int) -> tuple[int, bool]:
    """(place, whether an expression begins there): where a template's plain text ends."""
    m = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S).match(text, at)
    if text.startswith("${", m.end()):
        return m.end() + 2, True
    return min(len(text), m.end() + 1), False


class _Scan:
    """Definitions and uses of one text."""

    def __init__(self, text: str, language: str) -> None:
        self.t, self.language = Tokens(text, language), language
        self.defs: list[Symbol] = []
        self.names: set[int] = set()  # tokens that name a definition
        self.uses: dict[int, str] = {}
        self.bodies: dict[int, str] = {}  # opening braces: of a type, an enum, a function
        self._home: list[int | None] = []

    def define(self, kind: str, first: int, name: int, last: int, body: int | None = None) -> None:
        t = self.t
        end = t.start[body] if body is not None else t.end_of(last)
        head = t.text[t.start[first] : end].strip()
        head = head if body is not None else (head.splitlines() or [""])[0].strip()
        self.defs.append(Symbol(t.value[name], "def", t.line[first], t.line[last], head[:SIGNATURE] or None, kind, t.start[first], t.end_of(last)))
        self.names.add(name)

    def use(self, i: int) -> None:
        if i not in self.names and self.t.is_name(i):
            self.uses[i] = self.t.value[i]

    def statement_end(self, i: int) -> int:
        """The `;` that ends what begins at i, brackets passed over; else the last token."""
        t = self.t
        while i < len(t.value) and t.value[i] not in (";", "}"):
            i = t.past(i)
        return min(i, len(t.value) - 1) if t.at(i) == ";" else max(i - 1, 0)

    def line_end(self, i: int) -> int:
        """The last token of a line and of the brackets that it opens."""
        t = self.t
        while True:
            to = min(t.past(i), len(t.value)) - 1
            if to + 1 >= len(t.value) or t.line[to + 1] > t.line[to] or t.value[to + 1] in (";", ")", "}"):
                return to
            i = to + 1

    def around(self, i: int) -> int | None:
        """The innermost bracket around a token; found once for all."""
        if not self._home:
            open_: list[int] = []
            for k, v in enumerate(self.t.value):
                if v in _CLOSE and open_ and self.t.pair.get(open_[-1]) == k:
                    open_.pop()
                self._home.append(open_[-1] if open_ else None)
                if v in _OPEN:
                    open_.append(k)
        return self._home[i]

    def members(self, *dots: str) -> None:
        """Uses after a dot."""
        for i, v in enumerate(self.t.value):
            if v in dots and self.t.is_name(i + 1):
                self.use(i + 1)

    def calls(self) -> None:
        t = self.t
        for i in range(len(t.value) - 1):
            if t.value[i + 1] == "(" and t.is_name(i):
                self.use(i)

    def receivers(self) -> None:
        """Capitalised names before a dot."""
        t = self.t
        for i in range(len(t.value) - 2):
            if t.value[i + 1] == "." and t.is_name(i) and t.value[i][0].isupper() and t.at(i - 1) != "." and t.is_name(i + 2):
                self.use(i)

    # --- Go ---

    def go(self) -> None:
        t, i = self.t, 0
        while i < len(t.value):
            v = t.value[i]
            if v in ("import", "package"):
                i = self.line_end(i + 1) + 1
                continue
            if v == "func":
                name = t.past(i + 1) if t.at(i + 1) == "(" else i + 1
                params = t.past(name + 1) if t.at(name + 1) == "[" else name + 1
                if t.is_name(name) and t.at(params) == "(":
                    self._go_function(i, name, params)
                elif t.at(i + 1) == "(":
                    self._go_function(i, None, i + 1)
            elif v == "type" and (t.is_name(i + 1) or t.at(i + 1) == "("):
                if t.at(i + 1) == "(":
                    k, stop = i + 2, t.pair[i + 1]
                    while k < stop:
                        last = self.line_end(k)
                        self._go_type(k, k, last)
                        k = last + 1
                else:
                    self._go_type(i + 1, i + 1, self.line_end(i + 1))
            elif v in ("var", "const") and t.is_name(i + 1):
                self._go_typed(i + 2, i + 1)
            elif v in ("chan", "range", "return"):
                if v == "chan":
                    self._go_reference(i + 1)
            elif v == "]" and t.is_name(i + 1) and t.line[i] == t.line[i + 1]:
                self._go_reference(i + 1)  # []T, [n]T, map[K]T
            elif v == "[" and t.at(i - 1) == "map":
                self._go_reference(i + 1)
            elif v == "." and t.at(i + 1) == "(":
                self._go_reference(i + 2)  # x.(T)
            elif t.is_name(i) and t.at(i + 1) == "{" and t.at(i - 1) in ("=", "(", ",", "return", "&", ":", "{", "]"):
                self._go_reference(i)  # T{...}
            elif v in ("new", "make") and t.at(i + 1) == "(":
                self._go_reference(i + 2)
            i += 1
        self.members(".")
        self.calls()
        self.uses = {k: v for k, v in self.uses.items() if not (v in BUILT_IN["go"] and t.at(k + 1) != "(")}

    def _go_reference(self, i: int) -> None:
        """The type that begins here: what is pointed to, a package's or its own."""
        t = self.t
        while t.at(i) in ("*", "&", "...", "<", "-") or (t.at(i) == "[" and i in t.pair) or t.at(i) in ("chan", "<-"):
            i = t.past(i)
        if t.is_name(i):
            if t.at(i + 1) != ".":
                self.use(i)
            if t.at(i + 1) == "[" and t.line[i] == t.line[i + 1]:
                for k in range(i + 2, t.pair.get(i + 1, i + 2)):
                    self._go_reference(k)

    def _go_function(self, first: int, name: int | None, params: int) -> None:
        t = self.t
        if name is not None and t.at(first + 1) == "(":
            self._go_parameters(first + 1)
        self._go_parameters(params)
        k = t.past(params)
        if t.at(k) == "(":
            self._go_parameters(k)
            k = t.past(k)
        else:
            self._go_reference(k)
            if t.at(k) in ("interface", "struct"):
                k = t.past(k + 1)
            while k < len(t.value) and t.at(k) != "{" and t.line[k] == t.line[k - 1]:
                k = t.past(k)
        body = k if t.at(k) == "{" else None
        if name is not None:
            last = t.pair[k] if body is not None else k - 1
            self.define("method" if t.at(first + 1) == "(" else "function", first, name, min(last, len(t.value) - 1), body)

    def _go_parameters(self, i: int) -> None:
        """Types of a parameter list: of `a, b T` or of bare types."""
        t, stop = self.t, self.t.pair.get(i, i)
        starts, k = [i + 1], i + 1
        while k < stop:
            if t.value[k] == ",":
                starts.append(k + 1)
            k = t.past(k)
        named = any(t.is_name(s) and t.at(s + 1) not in (",", ")", ".", "[") or (t.is_name(s) and t.at(s + 1) == "[" and t.at(t.past(s + 1)) not in (",", ")", "")) for s in starts)
        for s in starts:
            if s < stop:
                alone = not named or t.at(s + 1) in (",", ")")
                if named and alone:
                    continue
                self._go_reference(s + 1 if named else s)

    def _go_type(self, first: int, name: int, last: int) -> None:
        t = self.t
        if not t.is_name(name):
            return
        k = name + 1
        if t.at(k) == "[" and t.is_name(k + 1) and t.is_name(k + 2):
            k = t.past(k)
        k += t.at(k) == "="
        self.define({"struct": "class", "interface": "interface"}.get(t.at(k), "type"), first, name, last)
        if t.at(k) == "struct" and t.at(k + 1) == "{":
            i, stop = k + 2, t.pair[k + 1]
            while i < stop:
                end = self.line_end(i)
                j = i
                while t.is_name(j) and t.at(j + 1) == ",":
                    j += 2
                embedded = end == i or t.at(i) == "*" or t.at(i + 1) == "."
                self._go_reference(i if embedded else j + 1)
                i = end + 1
        elif t.at(k) == "interface" and t.at(k + 1) == "{":
            i, stop = k + 2, t.pair[k + 1]
            while i < stop:
                end = self.line_end(i)
                if t.at(i + 1) == "(":
                    self.names.add(i)
                    self._go_parameters(i + 1)
                    after = t.past(i + 1)
                    if after <= end:
                        self._go_parameters(after) if t.at(after) == "(" else self._go_reference(after)
                else:
                    self._go_reference(i)
                i = end + 1
        elif t.at(k) != "func":
            self._go_reference(k)

    def _go_typed(self, i: int, name: int) -> None:
        t = self.t
        while t.at(i) == "," and t.is_name(i + 1):
            i += 2
        if t.at(i) != "=" and i < len(t.value) and t.line[i] == t.line[name]:
            self._go_reference(i)

    # --- Rust ---

    def rust(self) -> None:
        t, attributes = self.t, set()
        for i, v in enumerate(t.value):
            first = i
            while t.at(first - 1) in ("unsafe", "async", "const", "extern", "pub", '""') or (t.at(first - 1) == ")" and t.at(t.pair.get(first - 1, 0) - 1) == "pub"):
                first = t.pair[first - 1] if t.at(first - 1) == ")" else first - 1
            name = i + 1
            if v in ("struct", "enum", "union", "trait", "mod", "type", "fn") and t.is_name(name):
                k = t.angles(name + 1)
                while k < len(t.value) and t.value[k] not in ("{", ";", "=", "}"):
                    k = t.past(k)
                if v == "union" and t.at(k) != "{":
                    continue
                kind = {"fn": "function", "trait": "interface", "mod": "module"}.get(v, "class")
                if t.at(k) == "{":
                    self.define(kind, first, name, t.pair[k], k)
                    if v == "enum":  # a variant with values is no call
                        self.names |= {n for n in range(k + 1, t.pair[k]) if t.value[n - 1] in ("{", ",", "]") and t.at(n + 1) == "(" and self.around(n) == k}
                elif v == "fn":
                    self.names.add(name)  # a signature: neither a definition nor a use
                else:
                    self.define(kind, first, name, self.statement_end(k))
            elif v == "#" and "[" in (t.at(name), t.at(name + 1)):
                attributes.update(range(i, t.past(name if t.at(name) == "[" else name + 1)))
            elif v == "macro_rules" and t.at(name) == "!" and t.is_name(i + 2):
                self.define("macro", first, i + 2, min(t.past(i + 3), len(t.value)) - 1)
                self.names.add(i)
            elif v == "impl":
                k = t.angles(name)
                here = k
                while k < len(t.value) and t.value[k] not in ("for", "{", ";", "where"):
                    k = t.angles(k) if t.value[k] == "<" and t.angles(k) > k else k + 1
                # Only a plain name counts: one with arguments or a path is another node.
                if t.is_name(here) and here + 1 == k:
                    self.use(here)
            elif v == "::" and t.is_name(i - 1) and t.is_name(i + 1) and not self._rust_type(i + 1):
                if t.at(i - 2) != "::":
                    self.use(i - 1)
                self.use(i + 1)
            elif v == "::" and t.is_name(i + 1) and not t.is_name(i - 1) and not self._rust_type(i + 1):
                self.use(i + 1)
            elif v == "!" and t.is_name(i - 1) and t.at(i + 1) in ("(", "[", "{") and t.start[i] == t.end_of(i - 1):
                self.use(i - 1)
        self.members(".")
        self.calls()
        self.uses = {k: v for k, v in self.uses.items() if k not in attributes}

    def _rust_type(self, i: int) -> bool:
        """Whether a path ends here in a type's place, where it is none of the uses."""
        t = self.t
        if t.at(i + 1) in ("::", "(", "!"):
            return False
        k = i
        while t.at(k - 1) == "::":
            k -= 2
        while t.at(k - 1) in ("&", "mut", "dyn", "impl"):
            k -= 1
        return t.at(k - 1) in ("<", "->") or (t.at(k - 1) == ":" and t.at(k - 2) != ":" and t.at(i + 1) in (",", ")", "=", "}", ">", ";"))

    # --- TypeScript ---

    def typescript(self) -> None:
        t = self.t
        for i, v in enumerate(t.value):
            name = i + 1
            if v in ("class", "interface", "enum", "module") and t.is_name(name) and t.at(i - 1) != ".":
                k = name + 1
                while k < len(t.value) and t.value[k] not in ("{", ";", "}"):
                    k = t.past(k)
                if t.at(k) == "{":
                    first = i - 1 if t.at(i - 1) == "abstract" or (v == "enum" and t.at(i - 1) == "const") else i
                    self.define(v if v in ("enum", "module") else "class", first, name, t.pair[k], k)
                    self.bodies[k] = "enum" if v == "enum" else "type"
            elif v == "type" and t.is_name(name) and t.at(t.angles(name + 1)) == "=":
                self.define("type", i, name, self.line_or_statement(i))
                if t.at(k := t.angles(name + 1) + 1) == "{":
                    self.bodies[k] = "type"
            elif v == "function":
                name += t.at(name) == "*"
                params = t.angles(name + 1)
                if t.is_name(name) and t.at(params) == "(":
                    first = i - 1 if t.at(i - 1) == "async" else i
                    self._callable("function", first, name, params)
                else:
                    self._parameters(t.angles(i + 1))
            elif v == "=>" and t.at(i - 1) == ")":
                self._parameters(t.pair.get(i - 1, i))
            elif v in ("let", "const", "var") and t.is_name(name) and t.at(name + 1) == ":":
                self._annotation(name + 1)
            elif v == "new" and t.is_name(name) and t.at(name + 1) != ".":
                self.use(name)
        for i, v in enumerate(t.value):
            if v == "(" and i and (t.is_name(i - 1) or t.value[i - 1] in WORDS["typescript"] or t.value[i - 1] == ">"):
                self._method(i)
        for k, kind in self.bodies.items():
            if kind == "type":
                self._fields(k)
        self.members(".")
        self.calls()
        self.receivers()

    def line_or_statement(self, i: int) -> int:
        """The end of a declaration that a `;` or the end of a line ends."""
        t = self.t
        while i + 1 < len(t.value) and t.value[i] != ";":
            to = min(t.past(i), len(t.value)) - 1
            if to + 1 >= len(t.value) or (t.line[to + 1] > t.line[to] and t.value[to] not in ("=", "|", "&") and t.value[to + 1] not in ("|", "&", "=")) or t.value[to + 1] == "}":
                return to
            i = to + 1
        return i

    def _callable(self, kind: str, first: int, name: int, params: int) -> None:
        t = self.t
        self._parameters(params)
        k = self._after_type(t.past(params))
        if t.at(k) == "{":
            self.define(kind, first, name, t.pair[k], k)
            self.bodies.setdefault(k, "function")
        else:
            self.define(kind, first, name, k if t.at(k) == ";" else max(k - 1, params))

    def _after_type(self, k: int) -> int:
        """The place after `: type`, where a body, a `;` or the next line begins."""
        t = self.t
        if t.at(k) != ":":
            return k
        k += 1
        while k < len(t.value) and t.value[k] not in (";", "=", ",", ")", "}", "=>"):
            if t.value[k] == "{" and t.value[k - 1] not in (":", "|", "&", "<", ",", "=>"):
                return k
            if t.line[k] > t.line[k - 1] and t.value[k] not in ("|", "&", "{") and t.value[k - 1] not in (":", "|", "&"):
                return k
            k = t.past(k)
        return k

    def _method(self, params: int) -> None:
        """A method, if the bracket is one's parameters: `name(...) {` where no call can stand."""
        t = self.t
        name = params - 1
        if t.at(name) == ">":  # type parameters
            depth = 0
            while name > 0:
                depth += (t.value[name] == ">") - (t.value[name] == "<")
                name -= 1
                if depth == 0:
                    break
        first = name
        while t.at(first - 1) in ("async", "static", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "*", "declare"):
            first -= 1
        before = t.at(first - 1)
        home = self.around(name)
        close = t.past(params)
        if not t.named[name] or name in self.names or t.at(name) in ("if", "for", "while", "switch", "catch", "function", "return", "super", "with") or t.at(name - 1) == ".":
            return
        body = self._after_type(close)
        if home is not None and self.bodies.get(home) == "type":
            if before in ("{", ";", "}", ")") or t.line[first - 1] < t.line[first]:
                self._callable("method", first, name, params)
        elif t.at(body) == "{" and before in ("{", ",") and self.bodies.get(home) not in ("function", "enum") and (t.at(close) == ":" or body == close):
            self._callable("method", first, name, params)

    def _annotation(self, colon: int) -> None:
        """The type after a colon, if it is a plain name."""
        t = self.t
        if t.is_name(colon + 1) and t.value[colon + 1] not in BUILT_IN["typescript"] and t.at(colon + 2) not in ("<", ".", "[", "|", "&", "is") and t.at(colon) == ":":
            self.use(colon + 1)

    def _parameters(self, i: int) -> None:
        t, k, stop = self.t, i + 1, self.t.pair.get(i, i)
        while k < stop:
            if t.value[k] == ":" and t.value[k - 1] != "?" or (t.value[k] == ":" and t.at(k - 2) not in ("", "=")):
                self._annotation(k)
            k = t.past(k)
        if t.at(stop + 1) == ":":
            self._annotation(stop + 1)

    def _fields(self, brace: int) -> None:
        t, k, stop = self.t, brace + 1, self.t.pair.get(brace, brace)
        while k < stop:
            if t.value[k] == ":" and (t.named[k - 1] or t.value[k - 1] in ("?", "!", "]", '""')):
                self._annotation(k)
            k = t.past(k)

    # --- Java ---

    def java(self) -> None:
        t, skip = self.t, set()
        for i, v in enumerate(t.value):
            name = i + 1
            if v in ("import", "package"):
                skip.update(range(i, self.statement_end(i) + 1))
            if v in ("class", "interface") and t.is_name(name) and t.at(i - 1) != ".":
                first = self._modifiers(i - (t.at(i - 1) == "@"))
                k = name + 1
                while k < len(t.value) and t.value[k] not in ("{", ";"):
                    if t.value[k] in ("extends", "implements"):
                        k = self._java_types(k + 1)
                        continue
                    k = t.angles(k) if t.value[k] == "<" and t.angles(k) > k else k + 1
                if t.at(k) == "{" and t.at(i - 1) != "@":
                    self.define(v, first, name, t.pair[k], k)
                if t.at(k) == "{":
                    self.bodies[k] = "type"
            elif v in ("enum", "record") and t.is_name(name):
                k = name + 1
                while k < len(t.value) and t.value[k] not in ("{", ";"):
                    k = self._java_types(k + 1) if t.value[k] == "implements" else t.past(k)
                if t.at(k) == "{":
                    self.bodies[k] = "type"
                    self.names.add(name)
            elif v == "new" and t.is_name(name):
                k = t.angles(name + 1)
                if t.at(name + 1) == "(":
                    self.use(name)
                if t.at(k) == "(" and t.at(t.past(k)) == "{":
                    self.bodies[t.past(k)] = "type"
                self.names.add(name) if name not in self.uses else None
        made = {i + 1 for i, v in enumerate(t.value) if v == "new"}
        for i in range(1, len(t.value) - 1):
            if t.value[i + 1] != "(" or not t.is_name(i) or t.at(i - 1) == ".":
                continue
            close = t.past(i + 1)
            k = close
            if t.at(k) == "throws":
                while k < len(t.value) and t.value[k] not in ("{", ";"):
                    k += 1
            if self.bodies.get(self.around(i)) == "type" and t.at(k) in ("{", ";", "default") and i not in made:
                first = self._modifiers(i)
                typed = t.named[i - 1] and t.value[i - 1] not in ("public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "default") or t.at(i - 1) in ("]", ">")
                if typed and t.at(i - 1) not in ("return", "new", "throw", "=", "else"):
                    body = k if t.at(k) == "{" else None
                    self.define("method", first, i, t.pair[k] if body is not None else self.statement_end(k), body)
                else:
                    self.names.add(i)  # a constructor
        for i in range(1, len(t.value)):
            if t.value[i - 1] == "." and t.is_name(i) and i not in skip:
                self.use(i)
            elif t.at(i + 1) == "(" and t.is_name(i) and i not in made and t.at(i - 1) != "@":
                self.use(i)
        self.receivers()
        self.uses = {k: v for k, v in self.uses.items() if k not in skip}

    def _modifiers(self, i: int) -> int:
        """The first token of the declaration that holds one: back to the end of what comes before it."""
        t = self.t
        while i > 0 and t.value[i - 1] not in (";", "{", "}"):
            i = t.pair.get(i - 1, i - 1) if t.value[i - 1] in _CLOSE else i - 1
        return i

    def _java_types(self, k: int) -> int:
        t = self.t
        while t.is_name(k):
            after = t.angles(k + 1)
            if after == k + 1 and t.at(after) != ".":
                self.use(k)
            while t.at(after) == ".":
                after = t.angles(after + 2)
            if t.at(after) not in (",", "&"):
                return after
            k = after + 1
        return k

    # --- C ---

    def c(self) -> None:
        t, depth, prototype = self.t, 0, set()
        for i, v in enumerate(t.value):
            name = i + 1
            if v == "typedef":
                last = self.statement_end(i)
                k = last - 1
                while t.at(k) == "]":
                    k = t.pair[k] - 1
                if t.at(k) == ")" and t.at(t.pair[k] - 1) == ")":  # a pointer to a function
                    k = t.pair[k] - 2
                if t.is_name(k):
                    self.define("type", i, k, last)
            if v == "struct" and t.is_name(name) and t.at(name + 1) == "{":
                self.define("class", i, name, t.pair[name + 1], name + 1)
            elif v == "union" and t.is_name(name) and t.is_name(t.past(name + 1) if t.at(name + 1) == "{" else name + 1):
                body = name + 1 if t.at(name + 1) == "{" else None  # a union counts where something is declared with it
                self.define("class", i, name, t.pair[name + 1] if body else name, body)
            elif v == "enum" and t.is_name(name):
                body = name + 1 if t.at(name + 1) == "{" else None
                self.define("type", i, name, t.pair[name + 1] if body else name, body)
            depth += (v == "{") - (v == "}")
            if v == "(" and t.is_name(i - 1) and i - 1 not in self.names and self._declares(i - 1, depth):
                self.define("function", i - 1, i - 1, t.pair[i])
        self.members(".", "->")
        self.calls()

    def _declares(self, name: int, depth: int) -> bool:
        """Whether `name(` declares a function: a type comes before it and no statement's word."""
        t = self.t
        k = name - 1
        while t.at(k) == "*":
            k -= 1
        typed = k >= 0 and t.named[k] and t.value[k] not in ("return", "else", "case", "goto", "do", "sizeof")
        after = t.at(t.past(name + 1))
        if depth == 0:
            return typed and after in ("{", ";", ",", "__attribute__")
        return typed and after == ";" and (t.value[k] in WORDS["c"] or t.at(k - 1) in ("struct", "enum", "union"))


def scan(text: str, language: str) -> tuple[list[Symbol], list[Symbol]]:
    """(definitions, uses) of a text, each in the order of their places."""
    s = _Scan(text, language)
    if s.t.value:
        getattr(s, language)()
    t = s.t
    uses = [Symbol(name, "ref", t.line[i], t.line[i], None, "", t.start[i], t.start[i] + len(name)) for i, name in sorted(s.uses.items()) if i not in s.names]
    return sorted(s.defs, key=lambda d: (d.start, d.end)), uses
