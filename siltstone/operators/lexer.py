"""One lexer for brace languages and Ruby, driven by a table of what each language calls a comment, a string or a quote.

Tokens are (kind, text, start, line):

    word op open close      code; open and close are brackets, and the two ends of code within a string
    text                    a piece of a string, of a regular expression or of markup; `"` begins it or goes on with it
    note                    a comment, a line for the preprocessor, or what a template file has outside its code
    nl                      a line end in code
    bad                     what is wrong with the text before it: the token's text is the rule

A file is read once, from a stack of modes: code, a string that code may interrupt, or markup.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cache

Token = tuple[str, str, int, int]
OPEN, CLOSE = frozenset("([{"), frozenset(")]}")
PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass(frozen=True)
class Quote:
    """A kind of string. `begin` is a pattern; `end` the closing text, or what makes it of the match of `begin`. `escape`: what
    hides the next character; `doubled`: a closing text said twice is none; `lines`: it may go on over line ends; `code`:
    patterns that begin code within it (the code ends with the bracket that fits). `rule`: what it is called if it stays open."""

    begin: str
    end: str | Callable[[re.Match], str]
    escape: str = "\\"
    doubled: bool = False
    lines: bool = False
    code: str = ""
    rule: str = "unterminated_string"


@dataclass(frozen=True)
class Language:
    line: str = "//"
    block: tuple[tuple[str, str], ...] = ((r"/\*", "*/"),)
    nested: bool = False
    quotes: tuple[Quote, ...] = ()
    words: str = r"[^\W\d][\w$]*|\$\w*"
    notes: str = ""
    outside: str = ""
    regexes: bool = False
    markup: bool = False
    heredoc: str = ""


def _raw(m: re.Match) -> str:
    """The end of a string whose beginning tells it: the hashes or quotes that it opens with."""
    return m[0][m[0].index('"') :][::-1] if "#" not in m[0] else '"' + "#" * m[0].count("#")


_PLAIN = (Quote('"', '"'), Quote("'", "'"))
_C_LIKE = Language(quotes=_PLAIN)
#: Percent literals close with the bracket that fits theirs.
_CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}

LANGUAGES: dict[str, Language] = {
    "java": replace(_C_LIKE, quotes=(Quote('"""', '"""', lines=True), *_PLAIN)),
    "c": replace(_C_LIKE, line=r"//(?:\\\r?\n|[^\n])*+", words=r"[^\W\d][\w$]*", notes=r"(?m:^)[^\S\n]*#[^\S\n]*(?:error|warning|pragma|include|region|endregion)\b[^\n]*", quotes=(Quote(r'\b(?:u8|[uUL])?R"(?P<tag>[^()\\\s]{0,16})\(', lambda m: f'){m["tag"]}"', escape="", lines=True), *_PLAIN)),
    "cs": replace(
        _C_LIKE,
        notes=r"(?m:^)[^\S\n]*#[^\S\n]*(?:error|warning|pragma|region|endregion|nullable|line)\b[^\n]*",
        quotes=(
            Quote(r'\$+"{3,}', lambda m: m[0].lstrip("$"), escape="", lines=True, code=r"\{(?!\{)"),
            Quote(r'"{3,}', lambda m: m[0], escape="", lines=True),
            Quote(r'(?:\$@|@\$)"', '"', escape="", doubled=True, lines=True, code=r"\{(?!\{)"),
            Quote(r'@"', '"', escape="", doubled=True, lines=True),
            Quote(r'\$"', '"', code=r"\{(?!\{)"),
            *_PLAIN,
        ),
    ),
    "go": replace(_C_LIKE, quotes=(*_PLAIN, Quote("`", "`", escape="", lines=True, rule="unterminated_template_literal"))),
    "js": replace(_C_LIKE, quotes=(*_PLAIN, Quote("`", "`", lines=True, code=r"\$\{", rule="unterminated_template_literal")), regexes=True, words=r"[^\W\d][\w$]*|[$#][\w$]*"),
    "php": replace(
        _C_LIKE, line=r"(?://|#(?!\[))(?:(?!\?>)[^\n])*+", outside=r"<\?(?:php\b|=)", heredoc="php", words=r"\$?[^\W\d]\w*",
        quotes=(Quote('"', '"', lines=True, code=r"\$?\{(?=\$|\w+\})"), Quote("'", "'", lines=True), Quote("`", "`", lines=True)),
    ),
    "rust": replace(
        _C_LIKE, nested=True, words=r"(?:r#)?[^\W\d]\w*|'[^\W\d]\w*+(?!')",
        quotes=(Quote(r'\b[bc]?r(#*)"', _raw, escape="", lines=True), Quote(r'(?:\b[bc])?"', '"', lines=True), Quote(r"(?:\bb)?'(?=\\|[^'\n]')", "'")),
    ),
    "kotlin": replace(_C_LIKE, nested=True, words=r"[^\W\d]\w*|`[^`\n]+`", quotes=(Quote('"""', '"""', escape="", lines=True, code=r"\$\{"), Quote('"', '"', code=r"\$\{"), Quote("'", "'"))),
    "swift": replace(
        _C_LIKE, nested=True, words=r"[^\W\d]\w*|`[^`\n]+`|[$#@]\w+",
        quotes=(Quote(r'#+"""', lambda m: '"""' + m[0].rstrip('"'), escape="", lines=True), Quote(r'#+"', _raw, escape=""), Quote('"""', '"""', lines=True, code=r"\\\("), Quote('"', '"', code=r"\\\(")),
    ),
    "ruby": replace(
        _C_LIKE, line="#", block=((r"(?m:^)=begin\b", "\n=end"),), notes=r"(?m:^)__END__\n(?s:.*)", regexes=True, heredoc="ruby",
        words=r"::?[^\W\d]\w*[?!=]?(?![=>])|[@$]*[^\W\d]\w*[?!]?|\$\W|\?[^\s\w](?!\w)|\?\w\b",
        quotes=(
            Quote(r"%[qwis](?P<b>[(\[{<|!/])", lambda m: _CLOSERS.get(m["b"], m["b"]), lines=True),
            Quote(r"%[QWIrx]?(?P<b>[(\[{|!])(?=\S)", lambda m: _CLOSERS.get(m["b"], m["b"]), lines=True, code=r"#\{"),
            Quote('"', '"', lines=True, code=r"#\{"), Quote("'", "'", lines=True), Quote("`", "`", lines=True, code=r"#\{"),
        ),
    ),
    "plain": _C_LIKE,
}
#: The language of each extension; what is not here is plain.
EXTENSIONS = {
    "java": ".java .scala .groovy .dart", "c": ".c .h .cc .cpp .cxx .hpp .hh .m .mm", "cs": ".cs", "go": ".go", "js": ".js .jsx .ts .tsx .mjs .cjs .mts .cts", "php": ".php",
    "rust": ".rs", "kotlin": ".kt .kts", "swift": ".swift", "ruby": ".rb .ex .exs",
}
_BY_EXTENSION = {ext: name for name, exts in EXTENSIONS.items() for ext in exts.split()}
MARKUP = frozenset(".js .jsx .tsx .mjs .cjs".split())
#: Words after which an expression begins, so that a slash or an angle bracket there is no operator.
_EXPECT = frozenset("return typeof case in of delete void throw new else do instanceof yield await default and or not if unless while until when then".split())

_TAG = re.compile(r"<(?:[A-Za-z][\w.:-]*(?!\s*,|\s+extends\b)|>)")
_IN_TAG = re.compile(r"\"[^\"]*\"?|'[^']*'?|\{|/>|>|[^\"'{/>]+|.", re.S)
_IN_TEXT = re.compile(r"</[^>]*>?|<(?:[A-Za-z][\w.:-]*|>)|\{|[^<{]+|.", re.S)
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\n\\])*+\]|[^/\n\\\[])++/[a-z]*")
_HEREDOC = {
    "php": re.compile(r"<<<[ \t]*(?P<q>['\"]?)(?P<tag>[^\W\d]\w*)(?P=q)[ \t]*\r?(?=\n)"),
    "ruby": re.compile(r"<<[~-]?(?P<q>['\"`]?)(?P<tag>[A-Z]\w*)(?P=q)"),
}


@dataclass(frozen=True)
class _Reader:
    language: Language
    code: re.Pattern
    quotes: tuple[re.Pattern, ...]


@cache
def _reader(name: str) -> _Reader:
    """The patterns of a language: one that matches the next piece of code, and one that begins each kind of string."""
    g = LANGUAGES[name]
    line = g.line if g.line.endswith("*+") else rf"(?:{g.line})[^\n]*+"
    number = r"\d(?:'?[\w.](?!\.))*+" if name == "c" else r"\d\w*(?:\.\d\w*)?"
    quote = "|".join(re.sub(r"\(\?P<\w+>", "(?:", q.begin) for q in g.quotes)
    parts = [r"(?P<nl>\n)", f"(?P<line>{line})", f"(?P<block>{'|'.join(a for a, _ in g.block)})", f"(?P<quote>{quote})", f"(?P<word>{g.words}|{number})", r"(?P<open>[(\[{])", r"(?P<close>[)\]}])", r"(?P<op>=>|->|::|\\.|.)", r"\Z"]
    ahead = f"(?P<note>{g.notes})|" if g.notes else ""
    return _Reader(g, re.compile(rf"{ahead}[^\S\n]*+(?:{'|'.join(parts)})", re.S), tuple(re.compile(q.begin) for q in g.quotes))


def language_of(ext: str) -> str:
    return _BY_EXTENSION.get(ext, "plain")


class _Lexer:
    def __init__(self, source: str, ext: str) -> None:
        name = language_of(ext)
        self.source, self.reader = source, _reader(name)
        self.markup = name == "js" and ext in MARKUP
        self.out: list[Token] = []
        self.line = 1
        self.at = 0
        #: code: [depth of brackets within, what the text around goes on with]
        self.modes: list[list] = [[0, None]]
        self.before = ""
        self.heredocs: list[str] = []

    def emit(self, kind: str, end: int) -> None:
        text = self.source[self.at : end]
        self.out.append((kind, text, self.at, self.line))
        self.line += text.count("\n")
        self.at = end

    def bad(self, rule: str, line: int) -> None:
        self.out.append(("bad", rule, self.at, line))

    def run(self) -> list[Token]:
        source, g = self.source, self.reader.language
        if g.outside and (first := re.search(g.outside, source)):
            self.emit("note", first.end())
        elif g.outside and "<?" not in source and source.lstrip().startswith("<!"):
            self.emit("note", len(source))
        n, match, put, modes = len(source), self.reader.code.match, self.out.append, self.modes
        odd = {"<"} if self.markup or g.heredoc else set()
        odd |= ({"/"} if g.regexes else set()) | ({"?"} if g.outside else set())
        while self.at < n:
            if modes[-1][0] == "markup":
                self._markup()
                continue
            m = match(source, self.at)
            kind, end = m.lastgroup, m.end()
            if kind == "word":
                text = m["word"]
                put((kind, text, end - len(text), self.line))
                self.at, self.before = end, text
            elif kind == "op" and (text := m["op"]) not in odd:
                put((kind, text, end - len(text), self.line))
                self.at, self.before = end, text
                self.line += text[-1] == "\n"
            elif kind == "open":
                text = m["open"]
                modes[-1][0] += 1
                put((kind, text, end - 1, self.line))
                self.at, self.before = end, text
            elif kind == "nl":
                put((kind, "\n", end - 1, self.line))
                self.at = end
                self.line += 1
                if self.heredocs:
                    self._heredoc_bodies()
            elif kind is None:
                break
            else:
                self.at = m.start(kind)
                if kind == "close":
                    self._close(m["close"])
                elif kind == "op":
                    self._operator(m["op"])
                elif kind == "quote":
                    self._begin(m["quote"])
                elif kind == "block":
                    self._block(m["block"])
                else:
                    self.emit("note", end)
        for mode in self.modes[1:]:
            if mode[0] == "markup":
                continue
            if mode[1] is not None:
                quote, _, line = mode[1]
                self.bad(quote.rule, line)
                break
        return self.out

    def expects(self) -> bool:
        """Whether an expression may begin here: unless an operand has just ended."""
        b = self.before
        return not b or b in _EXPECT or not (b[0].isalnum() or b[0] in "_$@\"'`)]" or b[0] == "\u0001" or not b.isascii())

    def _block(self, begin: str) -> None:
        source, g, start, line = self.source, self.reader.language, self.at, self.line
        close = next(c for b, c in g.block if re.match(b, begin) or len(g.block) == 1)
        if not g.nested:
            end = source.find(close, start + len(begin))
            end = end + len(close) if end >= 0 else -1
        else:
            depth, end = 0, -1
            for m in re.finditer(r"/\*|\*/", source[start:]):
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    end = start + m.end()
                    break
        self.emit("note", end if end >= 0 else len(source))
        if end < 0:
            self.bad("unterminated_comment", line)

    def _begin(self, begin: str) -> None:
        if begin[0] == "%" and not self.expects():  # a remainder
            self.emit("op", self.at + 1)
            self.before = "%"
            return
        for quote, pattern in zip(self.reader.language.quotes, self.reader.quotes, strict=True):
            if own := pattern.match(self.source, self.at):
                end = quote.end if isinstance(quote.end, str) else quote.end(own)
                self._string(quote, end, own.end(), self.line)
                return

    def _string(self, quote: Quote, end: str, at: int, line: int) -> None:
        """The string from here on: up to its end, or to code within it."""
        source = self.source
        stop = _stops(quote, end)
        while True:
            m = stop.search(source, at)
            if m is None:
                self.emit("text", len(source))
                self.bad(quote.rule, line)
                return
            at = m.end()
            if m.lastgroup == "end":
                self.emit("text", at)
                self.before = "\u0001"
                return
            if m.lastgroup == "nl":
                if quote.lines:
                    continue
                self.emit("text", m.start())
                self.bad(quote.rule, line)
                return
            if m.lastgroup == "code":
                self.emit("text", m.end() - 1)
                self.modes.append([0, (quote, end, line)])
                self.modes[-1][0] += 1
                self.emit("open", at)
                self.before = source[at - 1]
                return

    def _close(self, text: str) -> None:
        mode = self.modes[-1]
        mode[0] -= 1
        self.out.append(("close", text, self.at, self.line))
        self.at += 1
        self.before = text if text != "}" else ""
        if len(self.modes) > 1 and mode[0] <= 0:
            self.modes.pop()
            if mode[1] is not None:
                self._string(*mode[1][:2], self.at, mode[1][2])

    def _operator(self, text: str) -> None:
        """A sign that may begin something else than an operator."""
        source, g, at = self.source, self.reader.language, self.at
        if text == "<" and self.markup and self.expects() and (m := _TAG.match(source, at)):
            self.modes.append(["markup", int(m[0] == "<>"), m[0] != "<>"])
            self.emit("text", m.end())
            return
        if text == "/" and (self.expects() or (g.heredoc == "ruby" and source[at - 1 : at] == " " and source[at + 1 : at + 2] not in (" ", "="))) and (r := _REGEX.match(source, at)):
            self.emit("text", r.end())
            self.before = "\u0001"
            return
        if text == "<" and g.heredoc and (h := _HEREDOC[g.heredoc].match(source, at)) and (g.heredoc == "php" or self.expects() or source[at + 2 : at + 3] in "~-" or h["q"]):
            self.heredocs.append(h["tag"])
            self.emit("text", h.end())
            self.before = "\u0001"
            return
        if text == "?" and g.outside and source.startswith("?>", at):
            again = re.compile(g.outside).search(source, at)
            self.emit("note", again.end() if again else len(source))
            self.before = ""
            return
        self.emit("op", at + len(text))
        self.before = text

    def _heredoc_bodies(self) -> None:
        for tag in self.heredocs:
            line = self.line
            end = re.compile(rf"^[ \t]*{tag}\b", re.M).search(self.source, self.at)
            self.emit("text", end.end() if end else len(self.source))
            if end is None:
                self.bad("unterminated_string", line)
        self.heredocs = []

    def _markup(self) -> None:
        _, depth, tagged = mode = self.modes[-1]
        m = (_IN_TAG if tagged else _IN_TEXT).match(self.source, self.at)
        t = m[0]
        if t == "{":
            self.modes.append([1, None])
            self.emit("open", m.end())
            self.before = "{"
            return
        self.emit("text", m.end())
        if tagged:
            if t in ("/>", ">"):
                mode[1], mode[2] = depth + (t == ">"), False
        elif t.startswith("</"):
            mode[1] -= 1
        elif _TAG.fullmatch(t):
            mode[1], mode[2] = depth + (t == "<>"), t != "<>"
        if not mode[1] and not mode[2]:
            self.modes.pop()
            self.before = "\u0001"


@cache
def _stops(quote: Quote, end: str) -> re.Pattern:
    """What is looked at within a string: what is hidden, its end, code, line ends."""
    parts = []
    if quote.code.startswith(r"\\"):
        parts.append(f"(?P<code>{quote.code})")
    if quote.escape:
        parts.append(rf"(?P<hidden>{re.escape(quote.escape)}(?:\r\n|.|\Z))")
    if quote.doubled:
        parts.append(f"(?P<twice>{re.escape(end * 2)})")
    parts.append(f"(?P<end>{re.escape(end)})")
    if quote.code and not quote.code.startswith(r"\\"):
        parts += [r"(?P<braces>\{\{)", f"(?P<code>{quote.code})"] if quote.code.startswith(r"\{") else [f"(?P<code>{quote.code})"]
    parts.append(r"(?P<nl>\n)")
    return re.compile("|".join(parts), re.S)


def tokens(source: str, ext: str) -> list[Token]:
    return _Lexer(source, ext).run()


def masked(source: str, found: list[Token]) -> str:
    """The text with strings and comments blanked, of the same length and with the same line ends."""
    out, at = [], 0
    for kind, text, start, _ in found:
        if kind in ("text", "note"):
            out.append(source[at:start])
            out.append(" " * len(text) if "\n" not in text else "\n".join(" " * len(x) for x in text.split("\n")))
            at = start + len(text)
    out.append(source[at:])
    return "".join(out)
