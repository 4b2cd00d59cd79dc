"""A light reading of TypeScript and JavaScript: tokens, brackets, functions, classes, calls.

No compiler is at hand on executors, so this reads what the extractor needs: tokens (with strings, templates, regular
expressions and JSX told apart), the ranges of functions and classes, and call chains. It never fails on odd input; what
it can't read it leaves out. Types are skipped, not understood.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

_WORD = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|#[A-Za-z_$][\w$]*")
_NUMBER = re.compile(r"\d[\w.]*|\.\d[\w]*")
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|$))+", re.S)
_MARK = re.compile(r"=>|\.\.\.|\?\.(?!\d)|===|!==|\*\*=?|&&=?|\|\|=?|\?\?=?|==|!=|<=|>=|\+\+|--|[-+*/%&|^]=|<<|.", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = {v: k for k, v in OPEN.items()}
# The language's words after which an expression starts, and those that aren't names of calls.
BEFORE_EXPRESSION = set("return typeof instanceof in of new delete void throw case do else await yield default extends".split())
NOT_CALLED = set("if for while switch catch function return typeof new delete void throw case do else await yield super import with in of instanceof constructor".split())
STATEMENT_WORDS = set("export default declare abstract async public private protected static readonly override".split())


@dataclass
class Token:
    kind: str  # word, number, string, template, regex, mark, text (of JSX)
    text: str
    start: int
    end: int
    value: str = ""
    pair: int = -1
    jsx: str = ""  # open, close: the brackets of a JSX tag; name: an attribute's name


@dataclass
class Function:
    start: int  # tokens: of the node, parameters and body, ends exclusive
    end: int
    kind: str  # declaration, expression, arrow, method
    name: str = ""
    params: tuple[int, int] = (0, 0)
    body: tuple[int, int] = (0, 0)
    own_name: str = ""  # an expression's own name


@dataclass
class Class:
    start: int
    end: int
    name: str
    base: tuple[int, int] | None
    body: tuple[int, int]
    members: list[Function] = field(default_factory=list)


@dataclass
class Named:
    start: int
    end: int
    kind: str
    name: str


@dataclass
class Call:
    start: int
    callee: tuple[int, int]
    open: int
    close: int
    optional: bool = False


class Source:
    """A file's tokens and structure."""

    def __init__(self, text: str, jsx: bool = False):
        self.text, self.jsx = text, jsx
        self.tokens: list[Token] = []
        self._lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self._scan(0, "")
        self._pair()
        self.functions: list[Function] = []
        self.classes: list[Class] = []
        self.named: list[Named] = []  # interfaces, types, enums
        self.variables: list[tuple[int, int, str, int]] = []  # name token, end, name, first token of the value
        self._structure()
        self.calls = self._calls()

    # Tokens

    def line(self, offset: int) -> int:
        return bisect_right(self._lines, offset)

    def start_line(self, token: int) -> int:
        return self.line(self.tokens[token].start)

    def end_line(self, end: int) -> int:
        return self.line(self.tokens[end - 1].end)

    def source(self, start: int, end: int) -> str:
        return self.text[self.tokens[start].start : self.tokens[end - 1].end] if end > start else ""

    def _add(self, kind: str, start: int, end: int, value: str = "", jsx: str = "") -> int:
        self.tokens.append(Token(kind, self.text[start:end], start, end, value, -1, jsx))
        return end

    def _expects_value(self) -> bool:
        if not self.tokens:
            return True
        last = self.tokens[-1]
        if last.jsx == "close":
            return False
        if last.kind == "word":
            return last.text in BEFORE_EXPRESSION
        return last.kind == "mark" and last.text not in (")", "]", "}", "++", "--")

    def _scan(self, at: int, until: str) -> int:
        """Tokens up to the bracket ``until`` (of a template or JSX), or the end."""
        text, depth = self.text, 0
        while at < len(text):
            if space := _SPACE.match(text, at):
                at = space.end()
                continue
            char = text[at]
            if char in "'\"":
                at = self._string(at, char)
            elif char == "`":
                at = self._template(at)
            elif word := _WORD.match(text, at):
                at = self._add("word", at, word.end())
            elif number := _NUMBER.match(text, at):
                at = self._add("number", at, number.end())
            elif char == "/" and self._expects_value() and (regex := _REGEX.match(text, at)):
                at = self._add("regex", at, regex.end())
            elif char == "<" and self.jsx and self._expects_value() and re.match(r"<(>|[A-Za-z_$])", text[at : at + 2]) and not self._generic_arrow(at):
                at = self._element(at)
            else:
                if until and char == until and not depth:
                    return at
                if until == "}":
                    depth += (char == "{") - (char == "}")
                at = self._add("mark", at, _MARK.match(text, at).end())
        return at

    def _generic_arrow(self, at: int) -> bool:
        return bool(re.match(r"<\s*[A-Za-z_$][\w$]*\s*(,|extends\b)", self.text[at : at + 80]))

    def _string(self, at: int, quote: str) -> int:
        end = at + 1
        while end < len(self.text) and self.text[end] != quote and self.text[end] != "\n":
            end += 2 if self.text[end] == "\\" else 1
        end = min(end + 1, len(self.text))
        return self._add("string", at, end, re.sub(r"\\(.)", r"\1", self.text[at + 1 : end - 1]))

    def _template(self, at: int) -> int:
        """A template's text is one token, followed by those of its expressions in brackets of their own."""
        index = len(self.tokens)
        self._add("template", at, at + 1)
        end, plain = at + 1, True
        while end < len(self.text) and self.text[end] != "`":
            if self.text[end] == "\\":
                end += 2
            elif self.text.startswith("${", end):
                plain = False
                self.tokens.append(Token("mark", "{", end, end + 2, jsx="hole"))
                end = self._scan(end + 2, "}")
                self.tokens.append(Token("mark", "}", end, min(end + 1, len(self.text)), jsx="hole"))
                end += 1
            else:
                end += 1
        end = min(end + 1, len(self.text))
        own = self.tokens[index]
        if plain:
            own.kind, own.value = "string", self.text[at + 1 : end - 1]
        own.text, own.end = self.text[at:end] if plain else "`", end if plain else own.end
        if not plain:
            self.tokens.append(Token("mark", ")", end - 1, end, jsx="close"))  # ends the template as a value
            self.tokens[-1].kind, self.tokens[-1].text = "template", "`"
        return end

    def _element(self, at: int) -> int:
        """A JSX element with its attributes and children."""
        text = self.text
        self._add("mark", at, at + 1, jsx="open")
        at += 1
        if name := re.compile(r"[\w$.:-]+").match(text, at):
            at = self._add("word", at, name.end(), jsx="tag")
        while at < len(text):
            if space := _SPACE.match(text, at):
                at = space.end()
            elif text.startswith("/>", at):
                return self._add("mark", at, at + 2, jsx="close")
            elif text[at] == ">":
                at = self._add("mark", at, at + 1, jsx="mid")
                break
            elif text[at] == "{":
                at = self._hole(at)
            elif text[at] in "'\"":
                end = text.find(text[at], at + 1)
                end = len(text) if end < 0 else end + 1
                at = self._add("string", at, end, text[at + 1 : end - 1], jsx="value")
            elif name := re.compile(r"[\w$:.-]+").match(text, at):
                at = self._add("word", at, name.end(), jsx="name")
            else:
                at = self._add("mark", at, at + 1, jsx="other")
        while at < len(text):
            if text.startswith("</", at):
                end = text.find(">", at)
                end = len(text) if end < 0 else end + 1
                return self._add("mark", at, end, jsx="close")
            if text[at] == "{":
                at = self._hole(at)
            elif text[at] == "<":
                at = self._element(at)
            else:
                end = min((p for p in (text.find("<", at), text.find("{", at)) if p >= 0), default=len(text))
                at = self._add("text", at, end)
        return at

    def _hole(self, at: int) -> int:
        self._add("mark", at, at + 1, jsx="hole")
        at = self._scan(at + 1, "}")
        if at < len(self.text):
            at = self._add("mark", at, at + 1, jsx="hole")
        return at

    def _pair(self) -> None:
        stack: list[int] = []
        for k, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in OPEN:
                stack.append(k)
            elif t.text in CLOSE:
                while stack and self.tokens[stack[-1]].text != CLOSE[t.text]:
                    stack.pop()
                if stack:
                    other = stack.pop()
                    t.pair, self.tokens[other].pair = other, k

    # Structure

    def is_mark(self, k: int, *texts: str) -> bool:
        return 0 <= k < len(self.tokens) and self.tokens[k].kind == "mark" and self.tokens[k].text in texts

    def word(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) and self.tokens[k].kind == "word" and not self.tokens[k].jsx else ""

    def _new_line(self, k: int) -> bool:
        return k > 0 and "\n" in self.text[self.tokens[k - 1].end : self.tokens[k].start]

    def _ends_value(self, k: int) -> bool:
        t = self.tokens[k]
        return t.kind in ("string", "number", "regex", "template") or t.jsx == "close" or t.kind == "word" and t.text not in BEFORE_EXPRESSION or t.kind == "mark" and t.text in (")", "]", "}", "++", "--", "!")

    def at_statement(self, k: int) -> bool:
        """Whether a statement starts at the token."""
        return k == 0 or self.is_mark(k - 1, ";", "{", "}") and not self.tokens[k - 1].jsx or self.is_mark(k - 1, ")") and self._new_line(k) or self._new_line(k) and self._ends_value(k - 1)

    def _with_modifiers(self, k: int) -> int:
        """The first token of the declaration whose keyword this is."""
        while k > 0 and self.word(k - 1) in STATEMENT_WORDS:
            k -= 1
        while k > 1 and self.word(k - 1) and self.is_mark(k - 2, "@"):
            k -= 2
        while k > 0 and self.is_mark(k - 1, ")") and self.tokens[k - 1].pair > 1 and self.is_mark(self.tokens[k - 1].pair - 2, "@"):
            k = self.tokens[k - 1].pair - 2
        return k

    def skip_type_arguments(self, k: int) -> int:
        """The token after <...> at k, or k if that isn't a list of types."""
        if not self.is_mark(k, "<"):
            return k
        depth, at = 0, k
        while at < len(self.tokens):
            t = self.tokens[at]
            if t.kind == "mark":
                if t.text == "<":
                    depth += 1
                elif t.text == ">":
                    depth -= 1
                    if not depth:
                        return at + 1
                elif t.text in OPEN and t.pair > 0:
                    at = t.pair
                elif t.text not in (",", ".", "|", "&", "=>", "?", ":", "=", "-"):
                    return k
            elif t.kind not in ("word", "string", "number"):
                return k
            at += 1
        return k

    def _body(self, k: int) -> int:
        """The bracket that opens a function's body after its parameters and result type, or -1."""
        if not self.is_mark(k, ":"):
            return k if self.is_mark(k, "{") else -1
        k += 1
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "mark" and t.text in OPEN and t.pair > 0:
                if t.text == "{" and not self.is_mark(k - 1, ":", "|", "&", "=>", "<", ",", "("):
                    return k
                k = t.pair
            elif t.kind == "mark" and t.text in (";", "=", ")", "]", "}") or self._new_line(k) and self._ends_value(k - 1) and self.word(k):
                return -1
            k += 1
        return -1

    def end_of_value(self, k: int) -> int:
        """The token after the expression that starts at k."""
        first = k
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == "mark" and not t.jsx:
                if t.text in (",", ";", ")", "]", "}"):
                    return k
                if t.text in OPEN and t.pair > 0 and not (k > first and self._new_line(k) and self._ends_value(k - 1) and t.text == "{"):
                    k = t.pair + 1
                    continue
            elif t.jsx == "open":
                depth = 0
                while k < len(self.tokens):
                    depth += (self.tokens[k].jsx == "open") - (self.tokens[k].jsx == "close")
                    k += 1
                    if not depth:
                        break
                continue
            if k > first and self._new_line(k) and self._ends_value(k - 1) and (t.kind != "mark" or t.text in ("{", "@")) and self.word(k) not in ("as", "satisfies", "instanceof", "in", "of"):
                return k
            if t.jsx == "hole" and t.text == "}":
                return k
            k += 1
        return k

    def _structure(self) -> None:
        tokens, k = self.tokens, 0
        for k in range(len(tokens)):
            word = self.word(k)
            if self.is_mark(k - 1, ".", "?."):
                word = ""
            if word == "function":
                self._function(k)
            elif self.is_mark(k, "=>") and not tokens[k].jsx:
                self._arrow(k)
            elif word == "class" and not self.is_mark(k + 1, ":", ",", ")", "="):
                self._class(k)
            elif word in ("interface", "enum", "type") and self.word(k + 1) and self.at_statement(self._with_modifiers(k)) or word == "enum" and self.word(k - 1) == "const" and self.word(k + 1):
                self._named(k, word)
            elif word in ("const", "let", "var"):
                self._variables(k + 1)
            elif self.is_mark(k, "{") and not tokens[k].jsx and self._is_object(k):
                self._object(k)
        self.functions.sort(key=lambda f: (f.start, -f.end))

    def _function(self, k: int) -> None:
        at = k + 1 + self.is_mark(k + 1, "*")
        name = self.word(at)
        at = self.skip_type_arguments(at + bool(name))
        if not self.is_mark(at, "(") or self.tokens[at].pair < 0:
            return
        close = self.tokens[at].pair
        body = self._body(close + 1)
        first = self._with_modifiers(k)
        declared = bool(name) and self.at_statement(first) or self.word(k - 1) == "default" or self.word(k - 1) == "async" and self.word(k - 2) in ("default", "export")
        if not declared:
            first = k - (self.word(k - 1) == "async")
        if body < 0 or self.tokens[body].pair < 0:
            if declared and name:  # a signature without a body
                self.functions.append(Function(first, close + 1, "declaration", name, (at, close)))
            return
        end = self.tokens[body].pair + 1
        kind = "declaration" if declared else "expression"
        self.functions.append(Function(first, end, kind, name if declared else "", (at, close), (body, end), name))

    def _arrow(self, k: int) -> None:
        at, params = k - 1, (k - 1, k)
        if not (self.word(at) and not self.is_mark(at - 1, ":")) and not self.is_mark(at, ")"):
            while at > 0 and not (self.is_mark(at, ":") and self.is_mark(at - 1, ")")):  # a result type
                if self.is_mark(at, ")", "]", "}") and self.tokens[at].pair >= 0:
                    at = self.tokens[at].pair
                if self.is_mark(at, ";", "{", "=", ",", "("):
                    return
                at -= 1
            at -= 1
        elif self.word(at) and self.is_mark(at - 1, ":") and self.is_mark(at - 2, ")"):
            at -= 2
        if self.is_mark(at, ")"):
            if self.tokens[at].pair < 0:
                return
            params = (self.tokens[at].pair, at)
            at = self.tokens[at].pair
        start = at - (self.word(at - 1) == "async")
        if self.is_mark(start - 1, ">") and self.is_mark(at, "("):  # type parameters
            back = start - 1
            while back > 0 and not self.is_mark(back, "<"):
                back -= 1
            if self.skip_type_arguments(back) == start:
                start = back - (self.word(back - 1) == "async")
        if self.is_mark(k + 1, "{") and self.tokens[k + 1].pair > 0:
            end = self.tokens[k + 1].pair + 1
        else:
            end = self.end_of_value(k + 1)
        if end > k + 1:
            self.functions.append(Function(start, end, "arrow", "", params, (k + 1, end)))

    def _class(self, k: int) -> None:
        name = self.word(k + 1) if self.word(k + 1) not in ("extends", "implements") else ""
        at, base = self.skip_type_arguments(k + 1 + bool(name)), None
        while at < len(self.tokens) and not self.is_mark(at, "{"):
            if self.word(at) == "extends" and base is None:
                end = at + 1
                while end < len(self.tokens) and not self.is_mark(end, "{", "<", ",") and self.word(end) != "implements":
                    end = self.tokens[end].pair + 1 if self.is_mark(end, "(") and self.tokens[end].pair > 0 else end + 1
                base, at = (at + 1, end), end
            elif self.is_mark(at, "<") and self.skip_type_arguments(at) > at:
                at = self.skip_type_arguments(at)
            else:
                at += 1
        if at >= len(self.tokens) or self.tokens[at].pair < 0:
            return
        first = self._with_modifiers(k)
        declared = bool(name) and (self.at_statement(first) or first < k)
        own = Class(first, self.tokens[at].pair + 1, name if declared else "", base, (at, self.tokens[at].pair))
        k = at + 1
        while k < own.body[1]:
            k = self._member(k, own.body[1], own)
        self.classes.append(own)

    def _member(self, k: int, stop: int, own: Class | None) -> int:
        """One member of a class or object literal; gives where the next may start."""
        while k < stop and self.is_mark(k, ",", ";"):
            k += 1
        if k >= stop:
            return stop
        start = k
        while self.is_mark(k, "@"):
            k += 2
            while self.is_mark(k, "."):
                k += 2
            k = self.tokens[k].pair + 1 if self.is_mark(k, "(") and self.tokens[k].pair > 0 else k
        words = STATEMENT_WORDS | {"get", "set", "accessor"}
        while self.word(k) in words and not self.is_mark(k + 1, "(", "=", ":", ";", ",", "?", "}", "<") or self.is_mark(k, "*"):
            k += 1
        name_at, name = k, ""
        if k < stop and self.tokens[k].kind in ("word", "string", "number"):
            name, k = self.tokens[k].text, k + 1
        elif self.is_mark(k, "[") and self.tokens[k].pair > 0:
            name, k = self.source(k, self.tokens[k].pair + 1), self.tokens[k].pair + 1
        k += self.is_mark(k, "?", "!")
        at = self.skip_type_arguments(k)
        if name and self.is_mark(at, "(") and self.tokens[at].pair > 0:
            close = self.tokens[at].pair
            body = self._body(close + 1)
            end = self.tokens[body].pair + 1 if body >= 0 and self.tokens[body].pair > 0 else close + 1
            if body >= 0 or own is not None:
                made = Function(start, end, "method", name, (at, close), (body, end) if body >= 0 else (end, end))
                self.functions.append(made)
                if own is not None:
                    own.members.append(made)
                return end if body >= 0 else self.end_of_value(end) + 1
        if own is None and name and self.is_mark(k, ":"):
            self.variables.append((-name_at - 1, k, name, k + 1))  # a property, which may name its function
        end = self.end_of_value(max(k, start + 1) if k == start else k)
        while end < stop and self.is_mark(end, ")", "]"):
            end += 1
        return max(end + (self.is_mark(end, ",", ";")), start + 1)

    def _named(self, k: int, kind: str) -> None:
        first, at = self._with_modifiers(k), k + 2
        if self.word(k - 1) == "const":
            first = self._with_modifiers(k - 1)
        if kind == "type":
            at = self.skip_type_arguments(at)
            if not self.is_mark(at, "="):
                return
            end = self.end_of_value(at + 1)
            end += self.is_mark(end, ";")
        else:
            while at < len(self.tokens) and not self.is_mark(at, "{"):
                at += 1
            if at >= len(self.tokens) or self.tokens[at].pair < 0:
                return
            end = self.tokens[at].pair + 1
        self.named.append(Named(first, end, kind, self.word(k + 1)))

    def _variables(self, k: int) -> None:
        while k < len(self.tokens):
            name, name_at = self.word(k), k
            if not name and self.is_mark(k, "{", "[") and self.tokens[k].pair > 0:
                k = self.tokens[k].pair
            k += 1 + self.is_mark(k + 1, "!")
            if self.is_mark(k, ":"):
                while k < len(self.tokens) and not self.is_mark(k, "=", ",", ";") and self.word(k) not in ("of", "in") and not (self._new_line(k) and self._ends_value(k - 1) and self.word(k)):
                    k = self.tokens[k].pair + 1 if self.tokens[k].kind == "mark" and self.tokens[k].text in OPEN and self.tokens[k].pair > 0 else max(k + 1, self.skip_type_arguments(k))
            if not self.is_mark(k, "="):
                return
            end = self.end_of_value(k + 1)
            if name:
                self.variables.append((name_at, end, name, k + 1))
            if not self.is_mark(end, ","):
                return
            k = end + 1

    def _is_object(self, k: int) -> bool:
        if k == 0 or self.tokens[k].pair < 0:
            return False
        last = self.tokens[k - 1]
        if last.kind == "word":
            return last.text in ("return", "default", "in", "of", "typeof", "yield", "await", "throw") and not last.jsx
        return last.jsx == "hole" and last.text == "{" or last.kind == "mark" and last.text in ("(", ",", "=", ":", "[", "?", "&&", "||", "??", "...")

    def _object(self, k: int) -> None:
        at, stop = k + 1, self.tokens[k].pair
        while at < stop:
            at = self._member(at, stop, None)

    def _calls(self) -> list[Call]:
        out, declared = [], {f.params[0] for f in self.functions}
        for k, t in enumerate(self.tokens):
            if t.kind != "mark" or t.text != "(" or t.pair < 0 or k in declared or t.jsx:
                continue
            end, optional = k, False
            if self.is_mark(end - 1, "?."):
                end, optional = end - 1, True
            if self.is_mark(end - 1, ">"):
                back = end - 1
                while back > 0 and not self.is_mark(back, "<", ";", "{"):
                    back -= 1
                if self.is_mark(back, "<") and self.skip_type_arguments(back) == end:
                    end = back
            start = self.chain_start(end)
            if start is None or start == end:
                continue
            if self.word(start - 1) == "new" and not any(self.is_mark(i, "(") for i in range(start, end)):
                continue
            out.append(Call(start, (start, end), k, t.pair, optional))
        return out

    def chain_start(self, end: int) -> int | None:
        """Where the member and call chain that ends before the token starts; None if there is none."""
        k = end - 1
        while k >= 0:
            t = self.tokens[k]
            if t.kind == "mark" and t.text == "!" and k and self._ends_value(k - 1):
                k -= 1
                continue
            if t.kind == "mark" and t.text in (")", "]") and t.pair >= 0:
                before = t.pair - 1
                if before >= 0 and (self.word(before) and self.word(before) not in NOT_CALLED | BEFORE_EXPRESSION or self.is_mark(before, ")", "]", "!")) and not (self._new_line(t.pair) and self.tokens[t.pair].text == "["):
                    k = before
                    continue
                if before >= 0 and self.is_mark(before, "?."):
                    k = before - 1
                    continue
                if self.word(before) in ("if", "for", "while", "switch", "catch", "with"):
                    return None
                return t.pair
            if t.kind == "word" and not t.jsx:
                if t.text in NOT_CALLED and not self.is_mark(k - 1, ".", "?.") and t.text not in ("super", "import"):
                    return None
                if self.is_mark(k - 1, ".", "?."):
                    k -= 2
                    continue
                return k
            if t.kind in ("string", "template", "regex"):
                return k
            return None
        return None

    def arguments(self, call: Call) -> list[tuple[int, int]]:
        """Token ranges of a call's arguments."""
        out, start, k = [], call.open + 1, call.open + 1
        while k < call.close:
            if self.is_mark(k, ",") and not self.tokens[k].jsx:
                out.append((start, k))
                start = k + 1
            elif self.tokens[k].kind == "mark" and self.tokens[k].text in OPEN and self.tokens[k].pair > 0:
                k = self.tokens[k].pair
            elif self.tokens[k].jsx == "open":
                depth = 0
                while k < call.close:
                    depth += (self.tokens[k].jsx == "open") - (self.tokens[k].jsx == "close")
                    if not depth:
                        break
                    k += 1
            k += 1
        if start < call.close:
            out.append((start, call.close))
        return out
