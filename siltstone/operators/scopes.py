"""Names of a Python file, scope by scope: who binds them, who uses them, what is left over.

The syntax tree is walked once in the order in which Python runs it. Bodies of functions wait until the file around them
is through, as their names are looked up when they are called. Each scope maps a name to its last binding, which knows
whether it has been used and on which branch it stands, so that a second definition on another branch is none.

Besides names: duplicate keys, comparisons of identity with literals, tests that are always true, and format strings
against their arguments.
"""

from __future__ import annotations

import ast
import builtins
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from string import Formatter

_BUILTINS = frozenset(dir(builtins)) | {"__file__", "__name__", "__doc__", "__builtins__", "__path__", "__spec__", "__package__", "__loader__", "__annotations__", "__debug__", "WindowsError"}
_OF_CLASSES = frozenset({"__module__", "__qualname__", "__class__"})
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Names that a function may bind for others to see.
_MAGIC = frozenset({"__tracebackhide__", "__traceback_info__", "__traceback_supplement__", "_"})

Finding = tuple[int, str, str]


@dataclass(slots=True)
class Binding:
    """kind: import, def, assign (a plain local), annotation, loop, other. others: imports of other submodules by this name."""

    kind: str
    name: str
    line: int
    what: str = ""
    fork: tuple = ()
    used: bool = False
    overload: bool = False
    others: list[Binding] = field(default_factory=list)


@dataclass(slots=True)
class Scope:
    """kind: module, class, function, comprehension. outer: names declared global or nonlocal. later: names that a function
    binds somewhere. wanted: those that were read before they were bound."""

    kind: str
    names: dict[str, Binding] = field(default_factory=dict)
    outer: dict[str, str] = field(default_factory=dict)
    later: frozenset[str] = frozenset()
    wanted: set[str] = field(default_factory=set)
    locals_called: bool = False


def _exclusive(a: tuple, b: tuple) -> bool:
    """Whether two places are on different branches of one statement."""
    for x, y in zip(a, b, strict=False):
        if x != y:
            return x[0] == y[0]
    return False


def _bound_in(body: list[ast.stmt]) -> frozenset[str]:
    """The names that a function binds itself, wherever in its body."""
    found: set[str] = set()
    todo: list[ast.AST] = list(body)
    while todo:
        node = todo.pop()
        match node:
            case ast.Name(id=name, ctx=ast.Store() | ast.Del()):
                found.add(name)
            case ast.FunctionDef(name=name) | ast.AsyncFunctionDef(name=name) | ast.ClassDef(name=name):
                found.add(name)
                continue
            case ast.Lambda():
                continue
            case ast.alias():
                found.add((node.asname or node.name).split(".")[0])
            case ast.ExceptHandler(name=str(name)) | ast.MatchAs(name=str(name)) | ast.MatchStar(name=str(name)) | ast.MatchMapping(rest=str(name)):
                found.add(name)
        todo += ast.iter_child_nodes(node)
    return frozenset(found)


class Names(ast.NodeVisitor):
    def __init__(self, tree: ast.Module) -> None:
        self.found: list[Finding] = []
        self.scopes = [Scope("module")]
        self.every = [self.scopes[0]]
        self.fork: tuple = ()
        self.loops = 0
        self.waiting: list[tuple[list[Scope], tuple, Callable[[], None]]] = []
        self.exports: list[tuple[int, str]] = []
        self.stars: list[tuple[int, str]] = []
        self.lazy = any(isinstance(s, ast.ImportFrom) and s.module == "__future__" and any(a.name == "annotations" for a in s.names) for s in tree.body)
        # A name that a function declares global and binds is the module's, from wherever it is read.
        self.globals = {name for node in ast.walk(tree) if isinstance(node, ast.Global) for name in node.names}
        self.missing: list[tuple[int, str]] = []
        for s in tree.body:
            self.visit(s)
        while self.waiting:
            self.scopes, self.fork, run = self.waiting.pop(0)
            self.loops = 0
            run()
        self._close()

    # ---- what is found

    def say(self, node: ast.AST | int, rule: str, detail: str = "") -> None:
        self.found.append((node if isinstance(node, int) else node.lineno, rule, detail))

    def _close(self) -> None:
        top = self.every[0]
        for line, name in self.exports:
            if name in top.names:
                top.names[name].used = True
            elif not self.stars and name not in self.globals:
                self.say(line, "undefined_export", name)
        for line, module in self.stars:
            self.say(line, "import_star", module)
        if not self.stars:
            for line, name in dict.fromkeys(self.missing):
                self.say(line, "undefined_name", name)
        for scope in self.every:
            for b in scope.names.values():
                if b.used or b.name in scope.outer:
                    continue
                if b.kind == "import":
                    for x in (*b.others, b):
                        self.say(x.line, "unused_import", x.what)
                elif scope.kind == "function" and not scope.locals_called and b.name not in _MAGIC and b.kind in ("assign", "annotation"):
                    self.say(b.line, "unused_variable" if b.kind == "assign" else "unused_annotation", b.name)

    # ---- bindings and uses

    def bind(self, node: ast.AST, name: str, kind: str, what: str = "", scope: Scope | None = None, overload: bool = False) -> None:
        scope = scope or self.scopes[-1]
        where = scope.outer.get(name)
        if where:
            scope = self.every[0] if where == "global" else next((s for s in reversed(self.scopes[:-1]) if s.kind == "function" and name in s.names), scope)
        old = scope.names.get(name)
        new = Binding(kind, name, node.lineno, what or name, self.fork, overload=overload)
        if old is not None:
            if old.kind in ("import", "def") and not old.used and not _exclusive(old.fork, self.fork) and not (old.overload or kind == "other" and old.kind == "def"):
                if not (kind == "import" and old.kind == "import" and "." in old.what and "." in new.what and old.what != new.what):
                    self.say(node, "redefined_while_unused", name)
            elif old.kind == "import" and kind == "loop" and scope.kind == "module":
                self.say(node, "import_shadowed_by_loop_variable", name)
            new.used = old.used
            if kind == old.kind == "import" and not old.used and old.what != new.what:
                new.others = [*old.others, old]  # import a.b, import a.c: used or unused together
        new.used |= name in scope.wanted
        scope.names[name] = new

    def use(self, node: ast.AST, name: str) -> None:
        inner = self.scopes[-1]
        for depth, scope in enumerate(reversed(self.scopes)):
            if scope.kind == "class" and depth and any(s.kind == "function" for s in self.scopes[len(self.scopes) - depth :]):
                continue
            if name in scope.names:
                scope.names[name].used = True
                return
            if scope.kind == "function" and name in scope.later and name not in scope.outer:
                scope.wanted.add(name)
                # In a loop an earlier round may have bound it; a function inside is called later.
                if not self.loops and all(s.kind == "comprehension" for s in self.scopes[len(self.scopes) - depth :]):
                    self.say(node, "undefined_local", name)
                return
        if name == "__class__" or name in _OF_CLASSES and any(s.kind == "class" for s in self.scopes):
            return
        if name in _BUILTINS or name in self.globals:
            return
        if inner.kind == "function" and inner.outer.get(name) == "nonlocal":
            return
        self.missing.append((node.lineno, name))

    def later(self, run: Callable[[], None]) -> None:
        self.waiting.append((list(self.scopes), self.fork, run))

    def visit_all(self, nodes: list) -> None:
        for n in nodes:
            if n is not None:
                self.visit(n)

    def branch(self, node: ast.AST, label: str, body: list) -> None:
        before = self.fork
        self.fork = (*before, (id(node), label))
        self.visit_all(body)
        self.fork = before

    # ---- names

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.use(node, node.id)
            if node.id == "locals" and self.scopes[-1].kind == "function":
                self.scopes[-1].locals_called = True
        elif isinstance(node.ctx, ast.Store):
            self.bind(node, node.id, "other")
        else:
            self.delete(node)

    def delete(self, node: ast.Name) -> None:
        scope = self.scopes[-1]
        if node.id in scope.outer:
            scope.outer.pop(node.id)
        elif node.id in scope.names:
            if self.fork or self.loops:
                scope.names[node.id].used = True  # it may still be there
            else:
                del scope.names[node.id]
        elif node.id not in self.globals:
            self.missing.append((node.lineno, node.id))

    def target(self, node: ast.AST, kind: str) -> None:
        """Bind a target: a plain name as a local that wants a use, the names of a tuple as others."""
        if isinstance(node, ast.Name):
            self.bind(node, node.id, kind)
        else:
            self.visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        self.visit(node.value)
        for t in node.targets:
            self.target(t, "assign")
            self._export(t, node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.annotation(node.annotation)
        if node.value is not None:
            self.visit(node.value)
            self.target(node.target, "assign")
            self._export(node.target, node.value)
        elif isinstance(node.target, ast.Name):
            if node.target.id not in self.scopes[-1].names:
                self.bind(node, node.target.id, "annotation")
        else:
            self.visit(node.target)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        if isinstance(node.target, ast.Name):
            self.use(node.target, node.target.id)
        self.visit(node.value)
        self.target(node.target, "other")
        self._export(node.target, node.value)

    def _export(self, target: ast.AST, value: ast.AST) -> None:
        if isinstance(target, ast.Name) and target.id == "__all__" and self.scopes[-1].kind == "module":
            for part in ast.walk(value):
                if isinstance(part, (ast.List, ast.Tuple, ast.Set)):
                    self.exports += [(x.lineno, x.value) for x in part.elts if isinstance(x, ast.Constant) and isinstance(x.value, str)]

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self.visit(node.value)
        scope = next(s for s in reversed(self.scopes) if s.kind != "comprehension")
        self.bind(node.target, node.target.id, "other", scope=scope)

    def visit_Global(self, node: ast.Global | ast.Nonlocal) -> None:
        kind = "global" if isinstance(node, ast.Global) else "nonlocal"
        if self.scopes[-1].kind == "function":
            self.scopes[-1].outer |= dict.fromkeys(node.names, kind)
        if kind == "nonlocal":
            for name in node.names:
                for s in self.scopes[:-1]:
                    if s.kind == "function" and name in s.names:
                        s.names[name].used = True

    visit_Nonlocal = visit_Global

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.bind(node, a.asname or a.name.split(".")[0], "import", a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        for a in node.names:
            if a.name == "*":
                self.stars.append((node.lineno, module))
                continue
            name = a.asname or a.name
            self.bind(node, name, "import", f"{module}{'' if module.endswith('.') else '.'}{a.name}")
            if module == "__future__" or a.asname == a.name:  # said again on purpose
                self.scopes[-1].names[name].used = True

    # ---- definitions

    def _enter(self, kind: str, later: frozenset[str] = frozenset()) -> Scope:
        scope = Scope(kind, later=later)
        self.every.append(scope)
        self.scopes = [*self.scopes, scope]
        return scope

    def _leave(self) -> None:
        self.scopes = self.scopes[:-1]

    def _parameters(self, node: ast.AST) -> bool:
        """Open a scope for type parameters, if there are any."""
        given = getattr(node, "type_params", [])
        if given:
            self._enter("comprehension")
            for p in given:
                self.bind(p, p.name, "other")
            for p in given:
                self.visit_all([getattr(p, "bound", None), getattr(p, "default_value", None)])
        return bool(given)

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.visit_all(node.decorator_list)
        typed = self._parameters(node)
        self.function(node, node.body)
        if typed:
            self._leave()
        overload = any("overload" in (d.id if isinstance(d, ast.Name) else d.attr if isinstance(d, ast.Attribute) else "") for d in node.decorator_list)
        self.bind(node, node.name, "def", overload=overload)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Lambda(self, node: ast.Lambda) -> None:
        self.function(node, [node.body])

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda, body: list) -> None:
        args = node.args
        every = [*args.posonlyargs, *args.args, *filter(None, [args.vararg]), *args.kwonlyargs, *filter(None, [args.kwarg])]
        self.visit_all([*args.defaults, *args.kw_defaults])
        for a in [*every, *([node] if isinstance(node, _FUNCTIONS) else [])]:
            self.annotation(a.annotation if isinstance(a, ast.arg) else a.returns)

        def run() -> None:
            scope = self._enter("function", _bound_in(body) if isinstance(node, _FUNCTIONS) else frozenset())
            for a in every:
                scope.names[a.arg] = Binding("other", a.arg, a.lineno)
            self.fork = ()
            self.visit_all(body)
            self._leave()

        self.later(run)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.visit_all(node.decorator_list)
        typed = self._parameters(node)
        self.visit_all([*node.bases, *node.keywords])
        self._enter("class")
        before, self.fork = self.fork, ()
        self.visit_all(node.body)
        self.fork = before
        self._leave()
        if typed:
            self._leave()
        self.bind(node, node.name, "def")

    def visit_TypeAlias(self, node: ast.AST) -> None:
        typed = self._parameters(node)
        self.later(lambda: self.visit(node.value))
        if typed:
            self._leave()
        self.bind(node, node.name.id, "other")

    def annotation(self, node: ast.AST | None) -> None:
        if node is None:
            return
        if self.lazy:
            self.later(lambda: self._annotated(node))
        else:
            self._annotated(node)

    def _annotated(self, node: ast.AST) -> None:
        """An annotation; strings in it are expressions that are read later, except those of Literal."""
        match node:
            case ast.Constant(value=str(text)):
                try:
                    inner = ast.parse(text.strip(), mode="eval").body
                except (SyntaxError, ValueError):
                    self.say(node, "forward_annotation_syntax_error", text)
                    return
                for n in ast.walk(inner):
                    ast.copy_location(n, node)
                self.later(lambda: self._annotated(inner))
            case ast.Subscript(value=ast.Name(id="Literal") | ast.Attribute(attr="Literal")):
                self.visit(node.value)
            case ast.Subscript(value=ast.Name(id="Annotated") | ast.Attribute(attr="Annotated"), slice=ast.Tuple(elts=[first, *rest])):
                self.visit(node.value)
                self._annotated(first)
                self.visit_all(rest)
            case ast.Name() | ast.Constant():
                self.visit(node)
            case _:
                for n in ast.iter_child_nodes(node):
                    if not isinstance(n, ast.expr_context | ast.operator):
                        self._annotated(n)

    def visit_ListComp(self, node: ast.ListComp | ast.SetComp | ast.GeneratorExp | ast.DictComp) -> None:
        self.visit(node.generators[0].iter)  # runs in the scope around
        self._enter("comprehension")
        for k, g in enumerate(node.generators):
            if k:
                self.visit(g.iter)
            self.visit(g.target)
            self.visit_all(g.ifs)
        self.visit_all([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])
        self._leave()

    visit_SetComp = visit_GeneratorExp = visit_DictComp = visit_ListComp

    # ---- statements with branches

    def visit_If(self, node: ast.If | ast.IfExp) -> None:
        if isinstance(node.test, ast.Tuple) and node.test.elts:
            self.say(node, "if_tuple")
        self.visit(node.test)
        self.branch(node, "body", node.body if isinstance(node.body, list) else [node.body])
        self.branch(node, "else", node.orelse if isinstance(node.orelse, list) else [node.orelse])

    visit_IfExp = visit_If

    def visit_For(self, node: ast.For | ast.AsyncFor) -> None:
        self.visit(node.iter)
        self.loops += 1
        self.target(node.target, "loop")
        self.visit_all([*node.body, *node.orelse])
        self.loops -= 1

    visit_AsyncFor = visit_For

    def visit_While(self, node: ast.While) -> None:
        self.loops += 1
        self.generic_visit(node)
        self.loops -= 1

    def visit_With(self, node: ast.With | ast.AsyncWith) -> None:
        for item in node.items:
            self.visit(item.context_expr)
            if item.optional_vars is not None:
                self.target(item.optional_vars, "assign")
        self.visit_all(node.body)

    visit_AsyncWith = visit_With

    def visit_Try(self, node: ast.Try) -> None:
        self.branch(node, "body", [*node.body])
        for k, h in enumerate(node.handlers):
            self.branch(node, f"except {k}", [h])
        self.branch(node, "body", node.orelse)
        self.branch(node, "finally", node.finalbody)

    visit_TryStar = visit_Try

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        if node.type is not None:
            self.visit(node.type)
        if node.name is None:
            self.visit_all(node.body)
            return
        names = self.scopes[-1].names
        before = names.pop(node.name, None)
        names[node.name] = Binding("other", node.name, node.lineno)
        self.visit_all(node.body)
        # The name goes with the handler.
        mine = names.pop(node.name, None)
        if mine is not None and not mine.used and node.name not in self.scopes[-1].outer:
            self.say(node, "unused_variable", node.name)
        if before is not None:
            names[node.name] = before

    def visit_Match(self, node: ast.Match) -> None:
        self.visit(node.subject)
        for k, case in enumerate(node.cases):
            self.branch(node, f"case {k}", [case])

    def _captured(self, node: ast.MatchAs | ast.MatchStar | ast.MatchMapping) -> None:
        self.generic_visit(node)
        name = node.rest if isinstance(node, ast.MatchMapping) else node.name
        if name:
            self.bind(node, name, "other")

    visit_MatchAs = visit_MatchStar = visit_MatchMapping = _captured

    # ---- expressions that cannot be meant

    def visit_Dict(self, node: ast.Dict) -> None:
        seen: dict[tuple, list[str]] = {}
        for key, value in zip(node.keys, node.values, strict=True):
            if isinstance(key, ast.Constant) or isinstance(key, ast.Name):
                k = (type(key.value).__name__, key.value) if isinstance(key, ast.Constant) else ("name", key.id)
                said = ast.dump(value)
                if k in seen and said not in seen[k]:
                    self.say(key, "duplicate_key", str(k[1]))
                seen.setdefault(k, []).append(said)
        self.generic_visit(node)

    def visit_Compare(self, node: ast.Compare) -> None:
        sides = [node.left, *node.comparators]
        for op, pair in zip(node.ops, zip(sides, sides[1:], strict=False), strict=True):
            if isinstance(op, (ast.Is, ast.IsNot)) and any(map(_literal, pair)):
                self.say(node, "is_literal")
        self.generic_visit(node)

    def visit_Assert(self, node: ast.Assert) -> None:
        if isinstance(node.test, ast.Tuple) and node.test.elts:
            self.say(node, "assert_tuple")
        self.generic_visit(node)

    def visit_Raise(self, node: ast.Raise) -> None:
        raised = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
        if isinstance(raised, ast.Name) and raised.id == "NotImplemented":
            self.say(node, "raise_not_implemented")
        self.generic_visit(node)

    def visit_JoinedStr(self, node: ast.JoinedStr) -> None:
        if not any(isinstance(v, ast.FormattedValue) for v in node.values):
            self.say(node, "f_string_without_placeholder")
        for v in node.values:
            if isinstance(v, ast.FormattedValue):
                self.visit(v.value)
                if v.format_spec is not None:  # a string of its own, which may well hold no placeholder
                    self.visit_all([x for x in v.format_spec.values if isinstance(x, ast.FormattedValue)])

    def visit_FormattedValue(self, node: ast.FormattedValue) -> None:
        self.visit(node.value)
        if node.format_spec is not None:
            self.visit_all([x for x in node.format_spec.values if isinstance(x, ast.FormattedValue)])

    def visit_Call(self, node: ast.Call) -> None:
        match node.func:
            case ast.Attribute(value=ast.Constant(value=str(text)), attr="format"):
                for detail in brace_format(text, node):
                    self.say(node, "format_arguments", detail)
        self.generic_visit(node)

    def visit_BinOp(self, node: ast.BinOp) -> None:
        if isinstance(node.op, ast.Mod) and isinstance(node.left, ast.Constant) and isinstance(node.left.value, str):
            for detail in percent_format(node.left.value, node.right):
                self.say(node, "format_arguments", detail)
        self.generic_visit(node)


def _literal(node: ast.AST) -> bool:
    match node:
        case ast.Constant(value=v):
            return isinstance(v, (str, bytes, int, float, complex)) and not isinstance(v, bool)
        case ast.Tuple(elts=elts):
            return all(isinstance(e, ast.Constant) or _literal(e) for e in elts)
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return _literal(inner)
    return False


def brace_format(text: str, call: ast.Call) -> Iterator[str]:
    """What does not fit between a text and the arguments of its format()."""
    numbered, named, automatic = set(), set(), 0
    todo, manual = [(text, 0)], False
    while todo:
        part, depth = todo.pop()
        try:
            fields = list(Formatter().parse(part))
        except ValueError as e:
            yield str(e)
            return
        for _, name, spec, conversion in fields:
            if name is None:
                continue
            if conversion is not None and conversion not in ("r", "s", "a"):
                yield f"conversion {conversion}"
            head = re.split(r"[.\[]", name, maxsplit=1)[0]
            if not head:
                numbered.add(automatic)
                automatic += 1
            elif head.isdecimal():
                manual = True
                numbered.add(int(head))
            else:
                named.add(head)
            if spec:
                if depth:
                    yield "placeholder nested too deeply"
                    return
                todo.append((spec, depth + 1))
    if automatic and manual:
        yield "numbered and unnumbered placeholders"
        return
    starred = any(isinstance(a, ast.Starred) for a in call.args)
    mapped = any(k.arg is None for k in call.keywords)
    given = {k.arg for k in call.keywords if k.arg}
    if not starred:
        lacking = sorted(n for n in numbered if n >= len(call.args))
        spare = sorted(set(range(len(call.args))) - numbered)
        if lacking and not mapped:
            yield f"no argument for {', '.join(map(str, lacking))}"
        if spare:
            yield f"unused argument {', '.join(map(str, spare))}"
    if not mapped:
        if named - given:
            yield f"no argument for {', '.join(sorted(named - given))}"
    if given - named:
        yield f"unused argument {', '.join(sorted(given - named))}"


_PERCENT = re.compile(r"%(?:\((?P<key>[^)]*)\))?(?P<flags>[#0\-+ ]*)(?P<width>\*|\d*)(?:\.(?P<precision>\*|\d*))?[hlL]?(?P<kind>.|\Z)", re.S)


def percent_format(text: str, right: ast.AST) -> Iterator[str]:
    """What does not fit between a text and the right side of its %."""
    places, keys, stars = 0, set(), 0
    for m in _PERCENT.finditer(text):
        if m["kind"] == "%" and m["key"] is None:
            continue
        if not m["kind"]:
            yield "incomplete placeholder"
            return
        if m["kind"] not in "diouxXeEfFgGcrsa%":
            yield f"unknown placeholder %{m['kind']}"
            return
        stars += (m["width"] == "*") + (m["precision"] == "*")
        if m["key"] is None:
            places += 1
        else:
            keys.add(m["key"])
    if keys and places:
        yield "named and unnamed placeholders"
        return
    if keys and stars:
        yield "* with named placeholders"
        return
    wanted = places + stars
    match right:
        case ast.Dict(keys=given):
            if places > 1 or (places == 1 and not keys and stars):
                yield f"a mapping for {wanted} placeholders"
            elif keys and all(isinstance(k, ast.Constant) and isinstance(k.value, str) for k in given):
                have = {k.value for k in given}
                if keys - have:
                    yield f"no argument for {', '.join(sorted(keys - have))}"
                if have - keys:
                    yield f"unused argument {', '.join(sorted(have - keys))}"
            elif not keys and not places:
                yield f"{len(given)} arguments for 0 placeholders" if given else "no placeholder"
        case ast.Tuple(elts=elts):
            if keys:
                yield "a tuple for named placeholders"
            elif not any(isinstance(e, ast.Starred) for e in elts) and len(elts) != wanted:
                yield f"{len(elts)} arguments for {wanted} placeholders"
        case ast.Constant() | ast.JoinedStr() | ast.List() | ast.ListComp() | ast.Set() | ast.BinOp(op=ast.Add(), left=ast.Constant()):
            if keys:
                yield "no mapping for named placeholders"
            elif wanted != 1:
                yield f"1 argument for {wanted} placeholders"


def messages(tree: ast.Module) -> list[Finding]:
    """(line, rule, detail) in order of lines."""
    return sorted(Names(tree).found)
