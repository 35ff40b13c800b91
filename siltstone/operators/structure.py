"""What the brackets of a file say: structural errors, unreachable statements and declarations, from one pass over its tokens.

A stack of open blocks is kept. A block knows whether a statement has left it, and which declarations it is the body of, so
a file's findings and the ranges of its chunks come from the same tokens.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from siltstone.operators.lexer import PAIRS, Token

LEAVES = frozenset(("return", "throw"))
#: Tokens that may follow a statement that leaves its block, without being dead.
_AFTER = frozenset(("}", ")", "]", ";", "case", "default", "else", "catch", "finally"))
_CLASSES = frozenset(("class", "interface", "struct"))
_VARIABLES = frozenset(("const", "let", "var"))
#: Words that are no function's name, and words that make a statement no head.
CONTROL = frozenset("if for while switch catch else return do try new throw foreach using lock synchronized when with match guard unless until".split())
_NO_HEAD = frozenset("return new throw else case in await yield".split())
#: Lines of a declaration whose end is not found.
OPEN_LINES = 80


@dataclass(slots=True)
class Declaration:
    kind: str
    name: str
    first: int
    last: int = 0


@dataclass(slots=True)
class _Block:
    """An open bracket, or the file. `heads`: declarations that wait for their body in this block; `bodies`: those that this
    block is the body of; `maybe`: what a C-like head has named so far; `before`: the last tokens of the statement."""

    open: str
    line: int
    switch: bool = False
    left: bool = False
    dead: bool = False
    leaving: bool = False
    word: str = ""
    heads: list[Declaration] = field(default_factory=list)
    bodies: list[Declaration] = field(default_factory=list)
    maybe: tuple[str, int] | None = None
    assigned: bool = False
    barred: bool = False
    variable: tuple[str, int] | None = None
    before: list[tuple[str, str]] = field(default_factory=list)

    def next_statement(self) -> None:
        self.maybe, self.assigned, self.barred, self.variable = None, False, False, None
        self.before.clear()


@dataclass(slots=True)
class Outline:
    errors: list[tuple[int, str]]
    unreachable: list[tuple[int, str]]
    declarations: list[Declaration]


def plain(tokens: list[Token]) -> bool:
    """Whether an outline could have neither errors nor unreachable statements: all brackets fit, nothing is wrong with the
    text, and no statement leaves its block."""
    due: list[str] = []
    for kind, text, _, _ in tokens:
        if kind == "open":
            due.append(PAIRS[text[-1]])
        elif kind == "close":
            if not due or due.pop() != text:
                return False
        elif kind == "bad" or (kind == "word" and text in LEAVES):
            return False
    return not due


def outline(source: str, tokens: list[Token], worded: bool = False) -> Outline:
    """The file's first structural error, else its first unreachable statement of each block; and its declarations.

    A bracket out of place counts only if the file opens and closes some bracket unequally often. `worded`: blocks end with
    a line `end` where their head's line opens no brace."""
    counts = dict.fromkeys("()[]{}", 0)
    for kind, text, _, _ in tokens:
        if kind in ("open", "close"):
            counts[text[-1]] += 1
    uneven = any(counts[a] != counts[b] for a, b in PAIRS.items())
    lines = source.split("\n")
    total = len(lines) - (lines[-1] == "" and len(lines) > 1)
    stack, done = [_Block("", 1)], []
    error: list[tuple[int, str]] | None = None
    unreachable: list[tuple[int, str]] = []
    previous, last = "", 1

    def wrong(line: int, rule: str, bracket: bool = True) -> None:
        nonlocal error
        if error is None:
            error = [(line, rule)] if uneven or not bracket else []

    def closed(block: _Block, line: int) -> None:
        for d in block.bodies:
            d.last = line
        for d in block.heads:
            d.last = line if d.kind == "function" else 0

    for kind, text, _, line in tokens:
        if kind == "note" or kind == "nl":
            if kind == "nl" and worded:
                stack[-1].next_statement()
            continue
        if kind == "bad":
            wrong(line, text, bracket=False)
            continue
        block = stack[-1]
        if block.left and not block.dead and text not in _AFTER and block.open in ("", "{") and not block.switch:
            block.dead = True
            unreachable.append((line, "unreachable_code"))
        if kind == "open":
            bracket = text[-1]
            inner = _Block(bracket, line, switch=bracket == "{" and block.word == "switch")
            if bracket == "{":
                _begin_body(block, inner, done)
            elif bracket == "(" and block.before and block.before[-1][0] == "word":
                name, ahead = block.before[-1][1], block.before[-2:-1]
                typed = ahead and (ahead[0][0] == "word" or ahead[0][1] in (">", "*", "&", "]", ")", "::", "?"))
                if typed and name not in CONTROL and (name[0].isalpha() or name[0] in "_$"):
                    block.maybe = name, last
            stack.append(inner)
        elif kind == "close":
            if len(stack) == 1:
                wrong(line, "unexpected_closing_bracket")
            else:
                if PAIRS[block.open] != text:
                    wrong(line, "mismatched_bracket")
                    while len(stack) > 2 and PAIRS[stack[-1].open] != text and any(PAIRS[b.open] == text for b in stack[1:]):
                        closed(stack.pop(), line)
                closed(stack.pop(), line)
                outer = stack[-1]
                if text == "}":
                    outer.next_statement()
                else:
                    outer.before.append(("close", text))
        elif text == ";" and kind == "op":
            if block.leaving:
                block.left, block.leaving = True, False
            block.word = ""
            for d in block.heads:
                if d.kind == "function":
                    d.last = line
                else:
                    done.remove(d)
            block.heads.clear()
            block.next_statement()
        else:
            if kind == "word":
                if text in LEAVES and block.open in ("", "{") and previous in (";", "{", "}", ""):
                    block.leaving = True
                elif text in ("switch", "if", "for", "while"):
                    block.word = text
                _head(block, text, line, done, worded, lines)
                block.barred |= text in _NO_HEAD
            elif text == "=":
                block.assigned = True
            elif text == "=>" and block.variable and block.before and block.before[-1][1] == ")":
                d = Declaration("function", *block.variable)
                block.heads.append(d)
                done.append(d)
                block.variable = None
            block.before.append((kind, text))
            if len(block.before) > 8:
                del block.before[:4]
        previous, last = text if kind != "text" else "x", line
    if error is None and len(stack) > 1:
        wrong(stack[1].line, "unclosed_bracket")
    for d in done:
        if not d.last:
            d.last = min(d.first + OPEN_LINES - 1, max(total, d.first))
    return Outline(error or [], [] if error is not None else unreachable, done)


def _begin_body(block: _Block, inner: _Block, done: list[Declaration]) -> None:
    """A brace opens: it is the body of the heads that wait, and of a C-like head just read."""
    if block.maybe and not block.assigned and not block.barred:
        name, line = block.maybe
        owner = next((d for d in block.heads if d.kind == "class"), None)
        if owner is None or owner.name != name:
            if owner is not None:
                done.remove(owner)  # `struct s *f(int a) {` names a type
                block.heads.remove(owner)
            if not any(d.name == name for d in block.heads):
                d = Declaration("function", name, line)
                done.append(d)
                inner.bodies.append(d)
    inner.bodies += block.heads
    block.heads = []
    block.maybe = None


def _head(block: _Block, text: str, line: int, done: list[Declaration], worded: bool, lines: list[str]) -> None:
    """A word that may name a declaration, by the word before it."""
    if not block.before or not (text[0].isalpha() or text[0] in "_$"):
        return
    kind, ahead = block.before[-1]
    star = ahead == "*" and len(block.before) > 1
    if star:
        kind, ahead = block.before[-2]
    if kind != "word" or len(block.before) > 1 + star and block.before[-2 - star][1] in (".", "::", "?."):
        return
    if ahead in _VARIABLES and not star:
        block.variable = text, line
        return
    if ahead in _CLASSES and not star:
        d = Declaration("class", text, line)
    elif ahead == "function" or (ahead == "def" and not star):
        d = Declaration("function", text, line)
    else:
        return
    if any(x.first == line and x.kind == "class" for x in done) and d.kind == "function":
        return
    done.append(d)
    if worded and "{" not in lines[line - 1]:
        d.last = next((k + 1 for k in range(line, len(lines)) if lines[k].strip() == "end"), 0)
    else:
        block.heads.append(d)
