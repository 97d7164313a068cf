"""Functions, classes, imports and deep blocks of one source text.

No parser: comments and strings are blanked, brackets are paired, and headers are found by
pattern wherever they stand, over as many lines as they take. Blocks are pairs of braces,
or deeper indentation in Python and Ruby.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cached_property
from itertools import accumulate

SCRIPT = ("javascript", "typescript", "tsx")
INDENTED = ("python", "ruby")

_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_TICKED = r"'(?:\\.|[^'\\\n])*'"
_BACK = r"`(?:\\.|[^`\\])*`"
_SLASHES = r"//[^\n]*|/\*.*?\*/"
_BLANKED = {
    **{name: f"{_SLASHES}|{_QUOTED}|{_TICKED}|{_BACK}" for name in SCRIPT},
    "python": rf'#[^\n]*|"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|{_QUOTED}|{_TICKED}',
    "java": f'{_SLASHES}|"""(?:\\\\.|[^\\\\])*?"""|{_QUOTED}|{_TICKED}',
    "go": f"{_SLASHES}|{_QUOTED}|{_TICKED}|`[^`]*`",
    "rust": rf"{_SLASHES}|{_QUOTED}|'(?:\\.|[^'\\\n])'",
    "c": rf"^[ \t]*#[^\n]*|{_SLASHES}|{_QUOTED}|{_TICKED}",
    "cpp": rf"^[ \t]*#[^\n]*|{_SLASHES}|{_QUOTED}|{_TICKED}",
    "ruby": rf"^=begin\b.*?^=end\b|#[^\n]*|{_QUOTED}|{_TICKED}",
    "php": rf"#[^\n]*|{_SLASHES}|{_QUOTED}|{_TICKED}",
}
_BLANKED = {name: re.compile(pattern, re.S | re.M) for name, pattern in _BLANKED.items()}

# Words that open a branch.
_BRANCHES = {
    **{name: r"\b(?:if|else|for|while|case|catch)\b|\s\?\s" for name in SCRIPT},
    "python": r"\b(?:if|elif|for|while|except)\b",
    "java": r"\b(?:if|else|for|while|switch|catch)\b|\s\?\s",
    "go": r"\b(?:if|for|select|case)\b",
    "rust": r"\b(?:if|else|for|while|loop)\b|=>",
    "c": r"\b(?:if|else|for|while|case|do)\b",
    "cpp": r"\b(?:if|else|for|while|case|catch)\b",
    "ruby": r"\b(?:if|elsif|unless|while|for|when|rescue)\b",
    "php": r"\b(?:if|else|for|foreach|while|catch|case)\b",
}
_BRANCHES = {name: re.compile(pattern) for name, pattern in _BRANCHES.items()}

_NOT_NAMES = frozenset(
    "if for while switch catch return new throw else do function super foreach match synchronized "
    "sizeof typeof await yield in of assert".split()
)
_GENERIC = r"(?:<[^(){};]*>)?"
_JS_FUNCTION = re.compile(r"(?:\basync\s+)?\bfunction\b\s*([\w$]*)\s*" + _GENERIC + r"\s*(?=\()")
_JS_METHOD = re.compile(
    r"(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?<![.\w$])(#?[A-Za-z_$][\w$]*)\s*"
    + _GENERIC + r"\s*(?=\()"
)
_JS_ARROW = re.compile(r"=>")
_JS_GIVEN_TO = re.compile(r"(?:\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]*)?=|([\w$]+)\s*:)\s*$")
_JS_NEXT_GIVEN = re.compile(r"\s*([\w$]+)\s*=\s*$")
_GOES_ON = re.compile(r"\s*[.?:&|+*/-]")
_PY_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)\s*" + r"(?:\[[^\]]*\])?\s*(?=\()", re.M)
_RUBY_DEF = re.compile(r"^([ \t]*)def[ \t]+(?:self\.)?([\w?!=]+)", re.M)
_GO_FUNC = re.compile(r"^[ \t]*func\s*(?:\([^)]*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\s*(?=\()", re.M)
_RUST_FN = re.compile(r"\bfn\s+(\w+)\s*" + r"(?:<[^(){};]*>)?\s*(?=\()")
_CALL_LIKE = re.compile(r"([A-Za-z_~][\w:~]*)\s*(?=\()")
_JAVA_NEW = re.compile(r"\bnew\s+[\w.]+\s*(?:<[^(){};]*>)?\s*(?=\()")
_PHP_FUNCTION = re.compile(r"\bfunction\s+&?\s*(\w+)\s*(?=\()")
_BEFORE_NAME = re.compile(r"([\w\])>&*@]+)\s*$")

_CLASSES = {
    **{name: re.compile(r"\bclass\s+([A-Za-z_$][\w$]*)") for name in SCRIPT},
    "java": re.compile(r"\b(?:class|interface)\s+(\w+)"),
    "go": re.compile(r"^type\s+(\w+)", re.M),
    "rust": re.compile(r"\bstruct\s+(\w+)|\bimpl\b\s*(?:<[^{};]*?>\s*)?(?:[^{};]*?\bfor\s+)?([A-Za-z_]\w*)"),
    "python": re.compile(r"^([ \t]*)class[ \t]+(\w+)", re.M),
}

_JS_IMPORT = re.compile(r"(?:^|[;}\n])[ \t]*(import\b(?:[^'\"`();]*?\bfrom)?\s*['\"]([^'\"\n]+)['\"])")
_PY_FROM = re.compile(r"(?:^|[;\n])[ \t]*(from[ \t]+([.\w]+)[ \t]+import\b)")
_PY_IMPORT = re.compile(r"(?:^|[;\n])[ \t]*(import[ \t]+([^\n;#]+))")
_JAVA_IMPORT = re.compile(r"(?:^|[;\n])[ \t]*(import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;)")
_GO_IMPORT = re.compile(r"^[ \t]*(import\s+(?:[\w.]+\s+)?(?=\"))", re.M)
_GO_BLOCK = re.compile(r"^[ \t]*(import\s*\()", re.M)
_GO_PATH = re.compile(r'"([^"\n]+)"')
_RUST_USE = re.compile(r"(?:^|[;{}\n])[ \t]*((?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+?)\s*;)")
_DOTTED = re.compile(r"[A-Za-z_][\w.]*")


#: Marks that end a look back, per language.
_STATEMENT, _GIVEN, _TYPED, _WORDS = ";{}", ";{},(", "(){};=", ";{}()[],.=<>:@#&|!?*/+-%^~\"'`"
_LOOK_BACK = {
    **{name: (_STATEMENT, _GIVEN, _TYPED, _WORDS) for name in SCRIPT},
    **{name: (_STATEMENT, _WORDS) for name in ("java", "rust", "c", "cpp", "php")},
}
_MARKS = {marks: re.compile(f"[{re.escape(marks)}]") for marks in (_STATEMENT, _GIVEN, _TYPED, _WORDS)}


def _filled(text: str, fill: str) -> str:
    """The text with every character but line ends replaced."""
    return "\n".join([fill * len(line) for line in text.split("\n")])


class Shape:
    """What is found in one text; positions become lines at the end."""

    def __init__(self, content: str, language: str):
        self.content, self.language = content, language
        # Strings become ~ after their first quote and comments blanks, so that only strings
        # count as text and a line that begins with ~ goes on with a string.
        self.code = _BLANKED[language].sub(self._blank, content)
        self._marked: dict[str, list[int]] = {}

    # Made when first asked for: imports need neither brackets nor branches.

    @cached_property
    def _line_starts(self) -> list[int]:
        return [0, *accumulate(len(line) + 1 for line in self.content.split("\n"))][:-1]

    @cached_property
    def pairs(self) -> dict[int, int]:
        return self._pair_brackets()

    @cached_property
    def braces(self) -> list[tuple[int, int]]:
        return sorted((a, b) for a, b in self.pairs.items() if self.code[a] == "{")

    @cached_property
    def _opens(self) -> list[int]:
        return [a for a, _ in self.braces]

    @cached_property
    def _outer(self) -> list[int]:
        return self._nest()

    @cached_property
    def _branches(self) -> list[int]:
        return [m.start() for m in _BRANCHES[self.language].finditer(self.code)]

    def _marks(self, marks: str) -> list[int]:
        """Where looks back end, so that each one costs its own statement and not the text before it."""
        if marks not in self._marked:
            self._marked[marks] = [m.start() for m in _MARKS[marks].finditer(self.code)]
        return self._marked[marks]

    def _blank(self, match: re.Match) -> str:
        text = match.group()
        if text.lstrip()[0] in "#=" or text[:2] in ("//", "/*"):
            return _filled(text, " ")
        return text[0] + _filled(text[1:], "~")

    def _pair_brackets(self) -> dict[int, int]:
        """Opening to closing position; what never closes ends with the text."""
        closing, stack, pairs = {")": "(", "]": "[", "}": "{"}, [], {}
        waiting = {"(": 0, "[": 0, "{": 0}
        for m in re.finditer(r"[()\[\]{}]", self.code):
            char, at = m.group(), m.start()
            if char in "([{":
                stack.append((char, at))
                waiting[char] += 1
            elif waiting[closing[char]]:
                while stack:
                    opened, start = stack.pop()
                    waiting[opened] -= 1
                    pairs[start] = at
                    if opened == closing[char]:
                        break
        return pairs | {at: len(self.code) for _, at in stack}

    def _nest(self) -> list[int]:
        """For each pair of braces the number of the pair around it, or -1."""
        outer: list[int] = []
        for i, (a, _) in enumerate(self.braces):
            above = i - 1
            while above >= 0 and self.braces[above][1] < a:
                above = outer[above]
            outer.append(above)
        return outer

    def _since(self, marks: str, at: int) -> int:
        """Behind the last of the marks before a position, or the start of the text."""
        found = self._marks(marks)
        i = bisect_left(found, at)
        return found[i - 1] + 1 if i else 0

    def _last_black(self, at: int) -> int:
        """The last position before ``at`` that is no white space, or -1."""
        at -= 1
        while at >= 0 and self.code[at].isspace():
            at -= 1
        return at

    def line(self, at: int) -> int:
        return bisect_right(self._line_starts, at)

    def around(self, at: int) -> tuple[int, int] | None:
        """The innermost pair of braces around a position."""
        i = bisect_left(self._opens, at) - 1
        while i >= 0 and self.braces[i][1] < at:
            i = self._outer[i]
        return self.braces[i] if i >= 0 else None

    def branches(self, start: int, stop: int) -> int:
        return bisect_left(self._branches, stop) - bisect_left(self._branches, start)

    def _skip(self, at: int, pattern: str) -> int:
        match = re.compile(pattern).match(self.code, at)
        return match.end() if match else at

    def _parts(self, start: int, stop: int) -> list[str]:
        """Texts between commas that are in no bracket of their own."""
        parts, at, i = [], start, start
        angle = 0
        while i < stop:
            char = self.code[i]
            if char in "([{" and i in self.pairs:
                i = self.pairs[i]
            elif char == "<":
                angle += 1
            elif char == ">" and self.code[i - 1] not in "=-":
                angle = max(0, angle - 1)
            elif char == "," and not angle:
                parts.append(self.content[at:i])
                at = i + 1
            i += 1
        parts.append(self.content[at:stop])
        return [p for p in (re.sub(r"\s+", " ", p).strip() for p in parts) if p]

    def params(self, opening: int | None) -> list[str]:
        """Names where the language's parameters have one, else the parameter as it stands."""
        if opening is None:
            return []
        parts = self._parts(opening + 1, self.pairs.get(opening, opening))
        language = self.language
        if language == "java":
            return [re.sub(r"(\s*\[\s*\])+$", "", p).split()[-1].lstrip(".") for p in parts]
        if language == "python":
            return [re.split(r"[:=]", p)[0].strip() if "=" in p else p for p in parts]
        if language == "ruby":
            return [re.split(r"[:=]", p)[0].strip() for p in parts]
        if language == "php":
            return [m.group() if (m := re.search(r"\$\w+", p)) else p for p in parts]
        if language == "go" and any(" " in p for p in parts):
            # Names before a type share one declaration, which is known by its first name.
            names, fresh = [], True
            for p in parts:
                if fresh:
                    names.append(p.split()[0])
                fresh = " " in p
            return names
        return parts

    # --- functions ------------------------------------------------------------------

    def functions(self) -> list[dict]:
        found = {
            "python": self._python_functions, "ruby": self._ruby_functions, "java": self._java_functions,
            "go": self._go_functions, "rust": self._rust_functions, "php": self._php_functions,
            "c": self._c_functions, "cpp": self._c_functions,
        }.get(self.language, self._script_functions)()
        rows = []
        for name, start, stop, opening in sorted(found, key=lambda f: (f[1], -f[2])):
            rows.append(
                {"name": name, "start": start, "stop": stop, "line_start": self.line(start), "line_end": self.line(stop),
                 "complexity": 1 + self.branches(start, stop + 1), "params": self.params(opening)}
            )
        return rows

    def _body(self, at: int) -> tuple[int, int] | None:
        """The braces that open at a position, after white space."""
        at = self._skip(at, r"\s*")
        return (at, self.pairs[at]) if self.code[at : at + 1] == "{" else None

    def _script_functions(self):
        given = set()
        for m in _JS_FUNCTION.finditer(self.code):
            opening = m.end()
            after = self._after_type(self.pairs.get(opening, opening) + 1)
            if body := self._body(after):
                given.add(opening)
                name = m.group(1) or self._given_name(m.start())
                yield name, m.start(), body[1], opening
        for m in _JS_METHOD.finditer(self.code):
            opening = m.end()
            if m.group(1) in _NOT_NAMES or opening in given or opening not in self.pairs:
                continue
            end = self._last_black(m.start()) + 1
            if self.code[max(0, end - 8) : end].endswith(("function", "new")):
                continue
            if body := self._body(self._after_type(self.pairs[opening] + 1)):
                yield m.group(1), m.start(), body[1], opening
        closes = {b: a for a, b in self.pairs.items()}
        for m in _JS_ARROW.finditer(self.code):
            end = self._last_black(m.start())
            # A type between the last closing bracket and the arrow.
            since = self._since(_TYPED, end + 1)
            if since and self.code[since - 1] == ")" and re.match(r"\s*:", self.code[since : end + 1]):
                end = since - 1
            if end >= 0 and self.code[end] == ")" and end in closes:
                start = opening = closes[end]
            elif name := re.search(r"[A-Za-z_$][\w$]*$", self.code[self._since(_WORDS, end + 1) : end + 1]):
                start, opening = end + 1 - len(name.group()), None
            else:
                continue
            before = self._since(_TYPED, start)
            generic = re.search(r"<[^(){};]*>$", self.code[before:start])
            start = before + generic.start() if generic else start
            word = self._since(_WORDS, start)
            wait = re.search(r"\basync\s*$", self.code[word:start])
            start = word + wait.start() if wait else start
            body = self._body(m.end())
            stop = body[1] if body else self._expression_end(m.end())
            yield self._given_name(start), start, stop, opening

    def _after_type(self, at: int) -> int:
        """Past a return type, whose own braces are not a body."""
        i = self._skip(at, r"\s*")
        if self.code[i : i + 1] != ":":
            return at
        i = self._skip(i + 1, r"\s*")
        if self.code[i : i + 1] == "{":
            return self.pairs[i] + 1
        return self._skip(i, r"[\w$.\s|&,<>\[\]]*")

    def _given_name(self, start: int) -> str:
        statement = self._since(_GIVEN, start)
        m = _JS_GIVEN_TO.search(self.code, statement, start)
        if not m and statement and self.code[statement - 1] == ",":
            m = _JS_NEXT_GIVEN.match(self.code, statement, start)
            return m.group(1) if m else "<anonymous>"
        return (m.group(1) or m.group(2)) if m else "<anonymous>"

    def _expression_end(self, at: int) -> int:
        at = self._skip(at, r"\s*")
        i = at
        while i < len(self.code):
            char = self.code[i]
            if char in "([{" and i in self.pairs:
                i = self.pairs[i]
            elif char in ",;)]}":
                return max(at, i - 1)
            elif char == "\n" and not _GOES_ON.match(self.code, i):
                return max(at, i - 1)
            i += 1
        return max(at, len(self.code) - 1)

    def _java_functions(self):
        bodies = {self._class_body(m.end()) for m in _CLASSES["java"].finditer(self.code)}
        bodies |= {self._body(self.pairs.get(m.end(), m.end()) + 1) for m in _JAVA_NEW.finditer(self.code)}
        names = {m.group(1) for m in _CLASSES["java"].finditer(self.code)}
        for m in _CALL_LIKE.finditer(self.code):
            opening = m.end()
            if m.group(1) in _NOT_NAMES or opening not in self.pairs or self.around(m.start()) not in bodies:
                continue
            end = self._last_black(m.start()) + 1
            first = end
            while first and (self.code[first - 1].isalnum() or self.code[first - 1] in "_])>&*@"):
                first -= 1
            word = _BEFORE_NAME.search(self.code[first:end])
            typed = word and word.group(1) not in _NOT_NAMES and not word.group(1).startswith("@")
            if not typed and m.group(1) not in names:
                continue
            after = self._skip(self.pairs[opening] + 1, r"\s*(?:\[\s*\]\s*)*(?:throws\s+[\w.,\s]+)?")
            body = self._body(after)
            if not body and self.code[after : after + 1] != ";":
                continue
            start = self._statement_start(m.start())
            yield m.group(1), start, body[1] if body else after, opening

    def _statement_start(self, at: int) -> int:
        """Where the declaration that holds a position begins."""
        start = self._since(_STATEMENT, at)
        return self._skip(start, r"\s*(?:(?:public|private|protected)\s*:\s*)*")

    def _go_functions(self):
        for m in _GO_FUNC.finditer(self.code):
            opening = m.end()
            after = self._skip(self.pairs.get(opening, opening) + 1, r"[ \t]*")
            if self.code[after : after + 1] == "(":
                after = self.pairs[after] + 1
            after = self._skip(after, r"(?:interface\{\}|struct\{\}|[\w.*\[\]<>, \t-])*")
            if body := self._body(after):
                yield m.group(1), self._skip(m.start(), r"[ \t]*"), body[1], opening

    def _rust_functions(self):
        for m in _RUST_FN.finditer(self.code):
            opening = m.end()
            after = self._skip(self.pairs.get(opening, opening) + 1, r"[^{};]*")
            if body := self._body(after):
                yield m.group(1), self._statement_start(m.start()), body[1], opening

    def _php_functions(self):
        for m in _PHP_FUNCTION.finditer(self.code):
            opening = m.end()
            after = self._skip(self.pairs.get(opening, opening) + 1, r"\s*(?::\s*[?\w\\|]+)?")
            if body := self._body(after):
                since = self._since(_WORDS, m.start())
                modifiers = re.search(r"(?:\b(?:public|private|protected|static|final|abstract)\s+)*\Z", self.code[since : m.start()])
                yield m.group(1), since + modifiers.start(), body[1], opening

    def _c_functions(self):
        for m in _CALL_LIKE.finditer(self.code):
            opening = m.end()
            if m.group(1) in _NOT_NAMES or opening not in self.pairs or self._initialises(m.start()):
                continue
            after = self._skip(self.pairs[opening] + 1, r"\s*(?:(?:const|noexcept|override|final)\b\s*)*(?::[^{};]*)?")
            if body := self._body(after):
                yield m.group(1).split("::")[-1], self._statement_start(m.start()), body[1], opening

    def _initialises(self, at: int) -> bool:
        """A member that a constructor sets before its body looks like a header of its own."""
        end = self._last_black(at)
        if end < 0 or self.code[end] not in ":,":
            return False
        return not re.search(r"\b(?:public|private|protected)\s*$", self.code[self._since(_WORDS, end) : end]) or self.code[end] == ","

    def _block_end(self, at: int, indent: int, closed: bool) -> int:
        """Last position of the deeper indented lines after the header that ends at ``at``."""
        stop = at
        i = bisect_right(self._line_starts, at)
        while i < len(self._line_starts):
            start = self._line_starts[i]
            end = self._line_starts[i + 1] - 1 if i + 1 < len(self._line_starts) else len(self.code)
            line = self.code[start:end]
            if bare := line.strip():
                if len(line) - len(line.lstrip()) <= indent and bare[0] not in ")]}~":
                    return end - 1 if closed and bare.split()[0] == "end" else stop
                stop = end - 1
            i += 1
        return stop

    def _python_functions(self):
        for m in _PY_DEF.finditer(self.code):
            opening = m.end()
            yield m.group(2), m.end(1), self._block_end(self.pairs.get(opening, opening), len(m.group(1)), False), opening

    def _ruby_functions(self):
        for m in _RUBY_DEF.finditer(self.code):
            at = self._skip(m.end(), r"[ \t]*")
            opening = at if self.code[at : at + 1] == "(" else None
            end = self.pairs[opening] if opening is not None else m.end()
            yield m.group(2), m.end(1), self._block_end(end, len(m.group(1)), True), opening

    # --- classes --------------------------------------------------------------------

    def _class_body(self, at: int) -> tuple[int, int] | None:
        at = self._skip(at, r"[^{};]*")
        return (at, self.pairs[at]) if self.code[at : at + 1] == "{" else None

    def classes(self, functions: list[dict]) -> list[dict]:
        pattern = _CLASSES.get(self.language)
        rows = []
        starts = [f["start"] for f in functions]
        for m in pattern.finditer(self.code) if pattern else ():
            if self.language == "python":
                start, name = m.end(1), m.group(2)
                header = self.code.find("(", m.end(), self.code.find(":", m.end()) + 1 or None)
                stop = self._block_end(self.pairs.get(header, m.end()), len(m.group(1)), False)
                inside = functions[bisect_right(starts, start) : bisect_right(starts, stop)]
                deep = min((f["start"] - self._line_starts[f["line_start"] - 1] for f in inside), default=0)
                methods = [f["name"] for f in inside if f["start"] - self._line_starts[f["line_start"] - 1] == deep]
            else:
                name = next(g for g in m.groups() if g)
                body = self._class_body(m.end())
                if self.language == "go":
                    body = self._body(self._skip(m.end(), r"[^\n{]*"))
                start = m.start() if self.language == "go" else self._header_start(m.start())
                stop = body[1] if body else self._skip(m.end(), r"[^;\n]*")
                methods = [
                    f["name"] for f in (functions[bisect_right(starts, body[0]) : bisect_left(starts, body[1])] if body else ())
                    if self.language != "go" and self.around(f["start"]) == body and not self._assigned(f["start"])
                ]
            rows.append({"name": name, "start": start, "line_start": self.line(start), "line_end": self.line(min(stop, len(self.code) - 1)), "methods": methods})
        return rows

    def _assigned(self, at: int) -> bool:
        """A function that is a field's value or an argument is no method."""
        end = self._last_black(at)
        return self.language in SCRIPT and end >= 0 and self.code[end] in "=(,:>"

    def _header_start(self, at: int) -> int:
        since = self._since(_WORDS, at) if _WORDS in _LOOK_BACK.get(self.language, ()) else 0
        words = re.search(r"(?:\b(?:public|private|protected|static|final|abstract|pub)\s+)*\Z", self.code[since:at])
        return since + words.start()

    # --- imports --------------------------------------------------------------------

    def imports(self) -> list[tuple[int, str]]:
        """``(position, source)``; a keyword inside a string or comment is none."""
        language, content = self.language, self.content
        found: list[tuple[int, str]] = []

        def run(pattern: re.Pattern, text: str = content):
            # One statement may end where the next begins.
            at = 0
            while m := pattern.search(text, at):
                if self.code[m.start(1)] == content[m.start(1)]:
                    yield m
                at = max(m.end() - 1, m.start() + 1)

        if language in SCRIPT:
            found = [(m.start(1), m.group(2)) for m in run(_JS_IMPORT)]
        elif language == "python":
            found = [(m.start(1), m.group(2)) for m in run(_PY_FROM)]
            for m in run(_PY_IMPORT):
                names = [p.strip() for p in m.group(2).split(",")]
                found += [(m.start(1), p) for p in names if _DOTTED.fullmatch(p)]
        elif language == "java":
            found = [(m.start(1), m.group(2)) for m in run(_JAVA_IMPORT)]
        elif language == "rust":
            found = [(m.start(1), m.group(2)) for m in run(_RUST_USE)]
        elif language == "go":
            for m in run(_GO_IMPORT):
                if path := _GO_PATH.match(content, m.end()):
                    found.append((m.start(1), path.group(1)))
            for m in run(_GO_BLOCK):
                opening = m.end() - 1
                found += [
                    (p.start(), p.group(1)) for p in _GO_PATH.finditer(content, opening, self.pairs[opening])
                    if self.code[p.start()] == '"'
                ]
        return sorted(found, key=lambda f: f[0])

    # --- nesting --------------------------------------------------------------------

    def deep_lines(self, functions: list[dict], most: int) -> list[int]:
        """Lines of a function that open a block nested more than ``most`` deep in it."""
        bodies = {f["stop"] for f in functions}
        depth: dict[tuple[int, int], int | None] = {}
        lines = set()
        for a, b in self.braces:
            outer = self.around(a)
            if b in bodies:
                depth[a, b] = 0
                continue
            above = depth.get(outer) if outer else None
            depth[a, b] = None if above is None else above + 1
            if depth[a, b] is not None and depth[a, b] > most:
                lines.add(self.line(a))
        return sorted(lines)
