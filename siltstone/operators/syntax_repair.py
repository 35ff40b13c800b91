"""Repair of Python code by the fewest edits that make it compile.

Brackets of a line are mended by a dynamic programme over its brackets: for every stretch the least number of closers put in,
brackets taken out or closers turned into others. Around it a search goes from the error that Python reports to the edits
that may mend it there, cheapest first, until the code compiles. An open bracket may be closed on its own line or on the last
line before the indentation falls back to its statement's.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache

CLOSERS = {"(": ")", "[": "]", "{": "}"}
#: Brackets of a line up to which the programme runs (it is cubic in them), and steps of a search.
MOST_BRACKETS, MOST_STEPS = 80, 300
_PIECE = re.compile(r"(?P<string>(?P<q>['\"])(?:\\.|(?!(?P=q)).)*+(?P=q))|(?P<open>['\"].*)|(?P<note>#.*)|(?P<bracket>[()\[\]{}])|(?P<code>[^'\"#()\[\]{}]+)", re.S)
_HEADER = re.compile(r"\s*(?:async\s+)?(?:if|elif|else|for|while|def|class|try|except|finally|with|match|case)\b")


def bracket_edits(brackets: str) -> tuple[int, list[tuple[int, str, str]]]:
    """The least number of edits that balance a string of brackets, and the edits: (place, kind, bracket), where kind is `put`
    (before the place), `drop` or `turn`. Of equal ways one that puts in is taken before one that takes out."""
    n = len(brackets)

    @cache
    def best(i: int, j: int) -> tuple[int, int, tuple]:
        """Edits, how many of them take out, and the edits of the stretch."""
        if i >= j:
            return 0, 0, ()
        b = brackets[i]
        cost, out, edits = best(i + 1, j)
        found = [(cost + 1, out + 1, ((i, "drop", b), *edits))]
        if b in CLOSERS:
            found.append((cost + 1, out, (*edits, (j, "put", CLOSERS[b]))))
            for k in range(i + 1, j):
                c = brackets[k]
                if c not in CLOSERS:
                    (a, x, inner), (d, y, rest) = best(i + 1, k), best(k + 1, j)
                    turn = () if CLOSERS[b] == c else ((k, "turn", CLOSERS[b]),)
                    found.append((a + d + len(turn), x + y, (*inner, *turn, *rest)))
        return min(found, key=lambda f: f[:2])

    cost, _, edits = best(0, n)
    return cost, list(edits)


def balanced(line: str) -> tuple[str, int]:
    """A line whose brackets and strings are closed by the fewest edits, and how many."""
    pieces = [(m.lastgroup if m.lastgroup != "q" else "string", m[0]) for m in _PIECE.finditer(line)]
    if pieces and pieces[-1][0] == "open":
        return _with_quote(line, pieces[-1][1])
    places = [k for k, (kind, _) in enumerate(pieces) if kind == "bracket"]
    if not places or len(places) > MOST_BRACKETS:
        return line, 0
    cost, edits = bracket_edits("".join(pieces[k][1] for k in places))
    put: dict[int, str] = {}
    texts = [t for _, t in pieces]
    end = _end_of_code(pieces)
    for at, kind, b in edits:
        if kind == "put":
            where = places[at] if at < len(places) else end
            put[where] = put.get(where, "") + b
        else:
            texts[places[at]] = b if kind == "turn" else ""
    out = []
    for k in range(len(texts) + 1):
        text = texts[k] if k < len(texts) else ""
        if k == end and k in put and k:
            # closers go before a final colon and the blanks around it
            body = out.pop()
            bare = body.rstrip()
            colon = bare.endswith(":") and _HEADER.match(line)
            cut = len(bare) - 1 if colon else len(bare)
            out.append(body[:cut] + put[k] + body[cut:])
        elif k in put:
            out.append(put[k])
        out.append(text)
    return "".join(out), cost


def _end_of_code(pieces: list[tuple[str, str]]) -> int:
    return next((k for k, (kind, _) in enumerate(pieces) if kind == "note"), len(pieces))


def _with_quote(line: str, open_: str) -> tuple[str, int]:
    """The line with its last string closed: at its end, or before what may have closed brackets or the header after it."""
    quote, head = open_[0], line[: len(line) - len(open_)]
    ends = [len(open_)]
    tail = re.search(r"[)\]}:,\s]+\Z", open_)
    if tail and tail.start() > 0:
        ends += range(tail.start(), len(open_))
    ways = []
    for at in ends:
        text, cost = balanced(head + open_[:at] + quote + open_[at:])
        ways.append((cost + 1, text))
    return min(ways, key=lambda w: w[0])[::-1]


def _edits(lines: list[str], at: int, message: str) -> Iterator[tuple[int, list[str]]]:
    """(edits, lines): what may mend an error that is reported at a line, counted from 0."""

    def one(k: int, text: str, cost: int = 1) -> tuple[int, list[str]]:
        return cost, [*lines[:k], text, *lines[k + 1 :]]

    indent = lambda x: len(x) - len(x.lstrip())
    if "was never closed" in message:
        own, last = indent(lines[at]), at
        while last + 1 < len(lines) and (not lines[last + 1].strip() or indent(lines[last + 1]) > own):
            last += 1
        while last > at and not lines[last].strip():
            last -= 1
        opener = re.search(r"'([(\[{])'", message)
        if last > at and opener:
            yield one(last, lines[last].rstrip() + CLOSERS[opener[1]])
    for k in dict.fromkeys((at, at - 1)):
        if not 0 <= k < len(lines) or not lines[k].strip():
            continue
        x = lines[k]
        text, cost = balanced(x)
        if cost:
            yield one(k, text, cost)
            x_header = re.sub(r"\s*$", ":", text) if _HEADER.match(text) and not text.rstrip().endswith(":") else None
            if x_header:
                yield one(k, x_header, cost + 1)
        if _HEADER.match(x) and not x.rstrip().endswith(":"):
            bare = re.split(r"\s+#", x, maxsplit=1)[0].rstrip()
            yield one(k, bare + ":" + x[len(bare) :])
            for gap in re.finditer(r"\s+(?=\w)", x.strip()):
                yield one(k, x[: indent(x)] + x.strip()[: gap.start()] + ":" + x.strip()[gap.start() :])
        if re.match(r"\s*(?:if|elif|while)\b[^=!<>]*=(?!=)", x):
            yield one(k, re.sub(r"^(\s*(?:if|elif|while)\b[^=!<>]*)=(?!=)", r"\1==", x))
        if re.search(r"[)\]}]\s*:?\s*$", x):
            yield one(k, re.sub(r"[)\]}](\s*:?\s*)$", r"\1", x))
        yield one(k, "    " + x)
        if x.startswith(" "):
            yield one(k, x[min(4, indent(x)) :])
        before = next((lines[j] for j in range(k - 1, -1, -1) if lines[j].strip()), "")
        if indent(before) != indent(x):
            yield one(k, " " * indent(before) + x.lstrip())
        if re.match(r"\s*(?:break|continue|return\b.*)\s*$", x):
            yield one(k, re.match(r"\s*", x)[0] + "pass", 2)
        if m := re.match(r"(\s*)from\s+(\S+)\s+import\s*$", x):
            yield one(k, f"{m[1]}import {m[2]}", 2)


def repaired(source: str, error: Callable[[str], tuple[int, str] | None]) -> str | None:
    """The source after the fewest edits that leave `error` (line and message of the first, from 1) without one; null if the
    search ends before. Ways of equal cost go to the one whose next error is further down."""
    wrong = error(source)
    if wrong is None:
        return source
    lines = source.split("\n")
    queue, seen, steps = [(0, -wrong[0], 0, lines, wrong)], {tuple(lines)}, 0
    best: tuple[int, int, list[str]] | None = None
    while queue and steps < MOST_STEPS:
        cost, _, _, lines, wrong = heapq.heappop(queue)
        if best is not None and best[0] <= cost + 1:
            break
        for more, after in _edits(lines, min(wrong[0], len(lines)) - 1, wrong[1]):
            if tuple(after) in seen or (best is not None and cost + more >= best[0]):
                continue
            seen.add(tuple(after))
            steps += 1
            next_ = error("\n".join(after))
            if next_ is None:
                best = cost + more, steps, after
            elif next_[0] >= wrong[0]:
                heapq.heappush(queue, (cost + more, -next_[0], steps, after, next_))
    return None if best is None else "\n".join(best[2])
