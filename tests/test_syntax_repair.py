"""Repairs by the fewest edits: the bracket programme against all edits, and families of common faults."""

import random
from itertools import product

import pytest

from siltstone.operators import python_rules, syntax_repair

PAIRS = {"(": ")", "[": "]", "{": "}"}


def even(text):
    stack = []
    for c in text:
        if c in PAIRS:
            stack.append(PAIRS[c])
        elif not stack or stack.pop() != c:
            return False
    return not stack


def least(text):
    """Breadth first over all single edits: a closer put anywhere, a bracket dropped, a closer turned into another."""
    level, edits = {text}, 0
    while not any(map(even, level)):
        level = {t[:k] + new + t[k + width :] for t in level for k in range(len(t) + 1) for width in (0, 1) for new in ("", *")]}") if not (width and new) or t[k : k + 1] in PAIRS.values()}
        edits += 1
    return edits


def test_bracket_edits_are_the_fewest():
    rng = random.Random(3)
    texts = ["".join(p) for n in range(4) for p in product("([)]", repeat=n)] + ["".join(rng.choice("()[]{}") for _ in range(5)) for _ in range(25)]
    for text in texts:
        cost, edits = syntax_repair.bracket_edits(text)
        out = "".join("".join(b for at, kind, b in edits if kind == "put" and at == k) + ("" if any(at == k and kind == "drop" for at, kind, _ in edits) else next((b for at, kind, b in edits if at == k and kind == "turn"), text[k : k + 1])) for k in range(len(text) + 1))
        assert cost == len(edits) == least(text) and even(out), text


@pytest.mark.parametrize("broken, want", [
    ('def greet(name):\n    message = "Hello, " + name\n    print(message\n\ndef farewell(name):\n    print("Goodbye, " + name)', 'def greet(name):\n    message = "Hello, " + name\n    print(message)\n\ndef farewell(name):\n    print("Goodbye, " + name)'),
    ('def check_status(x)\n    if x > 0:\n        return "positive"', 'def check_status(x):\n    if x > 0:\n        return "positive"'), ("numbers = [1, 2", "numbers = [1, 2]"), ('name = "Munna', 'name = "Munna"'), ('print("abc)', 'print("abc")'), ("f({'a': [1, 2)})", "f({'a': [1, 2]})"),
    ("if x = 1:\n    pass", "if x == 1:\n    pass"), ("if True print(1)", "if True: print(1)"), ("def f(a:\n    return a", "def f(a):\n    return a"), ("def f(a):\nreturn a", "def f(a):\n    return a"), ("x = 1\n  y = 2", "x = 1\ny = 2"), ("x = (1, 2))", "x = (1, 2)"), ("x = [1, (2, 3]", "x = [1, (2, 3)]"),
    ("while x\n    x = f(x", "while x:\n    x = f(x)"), ("from os import", "import os"), ("x = {\n    'a': 1,\n    'b': 2\ny = 3", "x = {\n    'a': 1,\n    'b': 2}\ny = 3"), ("print('it')  # (", "print('it')  # ("), ("f(1  # note", "f(1)  # note"), ("class A\n    def f(self)\n        return [1", "class A:\n    def f(self):\n        return [1]"),
])
def test_common_faults(broken, want):
    got = python_rules.mended(broken)
    compile(got, "f", "exec")
    assert got == want


def test_hopeless_code_stays_and_searches_end():
    for source in ("a b c d e f", "def def def", "(" * 60, "\0", "x = " + "(1 " * 30, "][" * 40, "'" * 7, "if\n" * 50):
        assert isinstance(python_rules.mended(source), str)
    rng = random.Random(4)
    for _ in range(60):
        source = "".join(rng.choice(list("()[]{}:='\" \nabif") + ["def f", "return ", "    "]) for _ in range(rng.randint(1, 40)))
        got = python_rules.mended(source)
        assert got == source or python_rules._error(got) is None
