"""Source text to entities and references, language by language.

A parser takes (text, module) and gives (entities, references, bases) as dicts; it raises on text that
it can't read. Python goes through the interpreter's own syntax tree. The brace languages are read by
a scanner of their own over text without comments and quotes: it knows definitions, their extent by
braces and calls by name, not types; what it doesn't recognise it leaves out.
"""

from __future__ import annotations

import ast
import builtins
import re
from collections.abc import Callable, Iterator

from ..functions.source import blanked

EMITS, CONSUMES = ("emit", "publish", "dispatch"), ("subscribe", "on", "consume", "register_handler")
DYNAMIC = "EVT:<dynamic>"


def entity(kind, qualname, lineno, end, body, short, signature="", parent=None):
    return {"kind": kind, "qualname": qualname, "lineno": lineno, "end_lineno": end, "body": body, "short": short, "signature": signature, "parent_qualname": parent}


def reference(src, dst, kind, via_attr=False, bare=False, literal=False):
    return {"src_qualname": src, "dst_ref": dst, "kind": kind, "via_attr": via_attr, "bare": bare, "literal_recv": literal}


def _numbered(names: dict, scope: str, name: str) -> str:
    """The nth definition of a name in one scope is name#n from the second on."""
    names[scope, name] = names.get((scope, name), 0) + 1
    k = names[scope, name]
    return f"{scope}.{name}" + (f"#{k}" if k > 1 else "")


class _Python(ast.NodeVisitor):
    """One walk: definitions as they are met, references under the innermost definition around them."""

    def __init__(self, module: str, known: set[str]):
        self.module, self.known = module, known
        # A definition's own names go with it: its full name doesn't come again.
        self.names, self.found, self.refs, self.bases = [{}], [], [], []
        self.scopes, self.classes, self.typed = [(module, "module")], [], [{}]

    def piece(self, text: str, tree: ast.Module, line: int) -> tuple[list, list, list]:
        """What the statements of one piece of the file hold, whose first line is the file's line + 1."""
        self.lines, self.line, self.found, self.refs, self.bases = lines(text), line, [], [], []
        self.visit(tree)
        return self.found, self.refs, self.bases

    def _text(self, node) -> str:
        return "\n".join(self.lines[node.lineno - 1 : node.end_lineno])

    def _define(self, node, kind: str, signature: str = "", typed: dict | None = None) -> None:
        scope, _ = self.scopes[-1]
        name = _numbered(self.names[-1], scope, node.name)
        self.found.append(entity(kind, name, self.line + node.lineno, self.line + node.end_lineno, self._text(node), node.name, signature, scope))
        self.scopes.append((name, kind))
        self.names.append({})
        if kind == "class":
            self.classes.append(name)
            self.bases += [{"cls": name, "base": b.id if isinstance(b, ast.Name) else b.attr} for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        else:
            self.typed.append(typed or {})
        self.generic_visit(node)
        self.scopes.pop()
        self.names.pop()
        if kind == "class":
            self.classes.pop()
        else:
            self.typed.pop()

    def visit_ClassDef(self, node):
        self._define(node, "class")

    def visit_FunctionDef(self, node):
        every = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        typed = {a.arg: getattr(a.annotation, "id", None) or getattr(a.annotation, "attr", None) for a in every if isinstance(a.annotation, (ast.Name, ast.Attribute))}
        self._define(node, "method" if self.scopes[-1][1] == "class" else "function", f"{node.name}({', '.join(a.arg for a in node.args.args)})", typed)

    visit_AsyncFunctionDef = visit_FunctionDef

    def _assigned(self, node, targets):
        scope, kind = self.scopes[-1]
        if kind == "class":
            self.found += [entity("attribute", f"{scope}.{t.id}", self.line + node.lineno, self.line + node.end_lineno, self._text(node), t.id, "", scope) for t in targets if isinstance(t, ast.Name)]
        self.generic_visit(node)

    def visit_Assign(self, node):
        self._assigned(node, node.targets)

    def visit_AnnAssign(self, node):
        self._assigned(node, [node.target])

    def visit_Import(self, node):
        self.refs += [reference(self.module, a.name, "imports") for a in node.names]

    def visit_ImportFrom(self, node):
        if node.module:
            self.refs.append(reference(self.module, node.module, "imports"))
            self.refs += [reference(self.module, f"{node.module}.{a.name}", "imports") for a in node.names]

    def visit_Call(self, node):
        at, src = node.func, self.scopes[-1][0]
        name = at.id if isinstance(at, ast.Name) else at.attr if isinstance(at, ast.Attribute) else None
        if name in EMITS or name in CONSUMES:
            first = node.args[0] if node.args else None
            known = isinstance(first, ast.Constant) and isinstance(first.value, str)
            self.refs.append(reference(src, f"EVT:{first.value}" if known else DYNAMIC, "emits" if name in EMITS else "consumes"))
        elif name:
            owner = at.value if isinstance(at, ast.Attribute) else None
            prefix = None
            if isinstance(owner, ast.Name):
                if owner.id in ("self", "cls") and self.classes:
                    prefix = self.classes[-1]
                elif owner.id in self.known:
                    prefix = owner.id
                else:
                    prefix = self.typed[-1].get(owner.id)
            literal = isinstance(owner, (ast.Constant, ast.JoinedStr, ast.List, ast.Dict, ast.Set, ast.Tuple))
            self.refs.append(reference(src, f"{prefix}.{name}" if prefix else name, "calls", owner is not None and not prefix, owner is None, literal))
        self.generic_visit(node)


def lines(text: str) -> list[str]:
    """Lines as syntax trees count them."""
    out = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return out[:-1] if out[-1] == "" else out


#: Characters of a piece, at least, of a Python file that is read piece by piece.
PIECE = 1 << 18
_TOP = re.compile(r"^(?:async[ \t]+def\b|def\b|class\b|@)", re.M)


def pieces(text: str) -> Iterator[tuple[int, str, ast.Module]]:
    """(lines before it, text, syntax tree) of runs of whole statements of a file.

    A piece ends where a definition begins at the margin and all before it is complete: it parses by
    itself, which no open string, bracket, decorator or continued line does, and no definition goes on
    with an earlier statement. So the trees are the parts of the file's own.
    """
    start = line = 0
    while True:
        size = PIECE
        while True:
            cut = _TOP.search(text, start + size) if start + size < len(text) else None
            part = text[start : cut.start() if cut else len(text)]
            try:
                tree = ast.parse(part)
                break
            except SyntaxError as e:
                if not cut:
                    if e.lineno is not None:
                        e.lineno += line
                    raise
                size *= 2
        yield line, part, tree
        if not cut:
            return
        start, line = cut.start(), line + len(lines(part))


def imported(tree: ast.Module) -> set[str]:
    return {(a.asname or a.name).split(".")[0] if isinstance(n, ast.Import) else a.asname or a.name for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names}


def python_pieces(text: str, module: str) -> Iterator[tuple[list, list, list]]:
    """What python() gives, piece by piece: memory is that of a piece, not of the file's tree. The module comes first.

    The whole file is read once before anything is given: an error is raised then.
    """
    known, n, one = set(), 0, None
    for _, part, tree in pieces(text):
        n += 1
        known |= imported(tree) if "import" in part else set()
        one = tree
    yield [entity("module", module, 1, len(lines(text)) or 1, text, module.rsplit(".", 1)[-1])], [], []
    walk = _Python(module, known)
    for line, part, tree in [(0, text, one)] if n == 1 else pieces(text):
        yield walk.piece(part, tree, line)


def python(text: str, module: str) -> tuple[list, list, list]:
    every = list(python_pieces(text, module))
    return tuple([x for one in every for x in one[k]] for k in range(3))


_CALL = re.compile(r"(?:\bnew\s+)?((?:[A-Za-z_$][\w$]*\.)*)([A-Za-z_$][\w$]*)\s*\(")
_NO_CALL = frozenset("if for while switch catch return function func new typeof await super else do case throw import class interface extends synchronized assert sizeof make len cap append".split())


def _close(text: str, at: int) -> int:
    """The place of the brace that closes the first one from `at` on; the end of the line where there is none before a semicolon."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth <= 0:
                return m.start()
        elif not depth:
            return m.start()
    return len(text) - 1


def braces(text: str, module: str, rules: list[tuple[str, str, str]], imports: list[str], arity: bool = False, receivers: bool = False) -> tuple[list, list, list]:
    """rules: (kind, pattern with groups name and, if there, params, recv, base; kind inside a class or "")."""
    plain, rows, names, bases = blanked(text), text.splitlines(), {}, []
    line_of = lambda at: text.count("\n", 0, at) + 1
    found, spans, taken = [entity("module", module, 1, len(rows) or 1, text, module.rsplit(".", 1)[-1])], [(0, len(text), module, "module")], set()
    hits = sorted(((m.start("name"), kind, inner, m) for kind, pattern, inner in rules for m in re.finditer(pattern, plain, re.M)), key=lambda x: x[0])
    for at, kind, inner, m in hits:
        if at in taken or m["name"] in _NO_CALL:
            continue
        taken.add(at)
        end = _close(plain, m.end() - 1 if plain[m.end() - 1] == "{" else m.end())
        scope, around = next((q, k) for a, b, q, k in reversed(spans) if a <= at <= b)
        groups = m.groupdict()
        if receivers and groups.get("recv"):
            scope, around = f"{module}.{groups['recv']}", "class"
        if inner == "class-only" and around != "class":
            continue
        name = m["name"]
        if arity and groups.get("params") is not None:
            params = groups["params"].strip()
            name += f"/{0 if not params else params.count(',') + 1}"
        full = _numbered(names, scope, name)
        real = "method" if kind == "function" and around == "class" else kind
        first, last = line_of(m.start("name")), line_of(end)
        found.append(entity(real, full, first, last, "\n".join(rows[first - 1 : last]), m["name"], f"{m['name']}({(groups.get('params') or '').strip()})" if groups.get("params") is not None else "", scope))
        spans.append((m.start(), end, full, real))
        bases += [{"cls": full, "base": b.strip().split(".")[-1].split("<")[0]} for b in (groups.get("base") or "").split(",") if b.strip()]
    refs = [reference(module, re.sub(r"^[./]+", "", m[1]).replace("/", "."), "imports") for pattern in imports for m in re.finditer(pattern, text, re.M)]
    heads = {a for a in taken}
    for m in _CALL.finditer(plain):
        name = m[2]
        if m.start(2) in heads or name in _NO_CALL:
            continue
        src = next(q for a, b, q, k in reversed(spans) if a <= m.start() <= b)
        owner = m[1].rstrip(".")
        if name in EMITS or name in CONSUMES:
            literal = re.match(r"\s*(['\"`])([^'\"`$]*)\1", text[m.end() :])
            refs.append(reference(src, f"EVT:{literal[2]}" if literal else DYNAMIC, "emits" if name in EMITS else "consumes"))
        else:
            known = owner == "this" and next((q for a, b, q, k in reversed(spans) if a <= m.start() <= b and k == "class"), None)
            refs.append(reference(src, f"{known}.{name}" if known else name, "calls", bool(owner) and not known, not owner))
    return found, refs, bases


_JS = [
    ("class", r"\bclass\s+(?P<name>[\w$]+)(?:\s+extends\s+(?P<base>[\w$.]+))?[^{]*\{", ""),
    ("function", r"\bfunction\s*\*?\s+(?P<name>[\w$]+)\s*\((?P<params>[^)]*)\)", ""),
    ("function", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?\(?(?P<params>[\w$,\s:?|]*)\)?(?:\s*:\s*[\w<>\[\]|]+)?\s*=>", ""),
    ("function", r"^\s*(?:(?:public|private|protected|static|async|get|set)\s+)*(?P<name>[\w$]+)\s*\((?P<params>[^)]*)\)\s*(?::\s*[^{;=]+)?\{", "class-only"),
]
_TS = [*_JS, ("class", r"\binterface\s+(?P<name>[\w$]+)(?:<[^>{]*>)?(?:\s+extends\s+(?P<base>[\w$.,\s]+))?\s*\{", ""), ("class", r"\btype\s+(?P<name>[\w$]+)(?:<[^>=]*>)?\s*=", "")]
_JS_IMPORTS = [r"\bimport\b[^'\"\n]*['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)"]
_GO = [("class", r"\btype\s+(?P<name>\w+)\s+(?:struct|interface)\s*\{", ""), ("function", r"^func\s+(?:\(\s*\w*\s*\*?(?P<recv>\w+)\s*\)\s*)?(?P<name>\w+)\s*\((?P<params>[^)]*)\)[^{\n]*\{", "")]
_JAVA = [
    ("class", r"\b(?:class|interface|enum|record)\s+(?P<name>\w+)(?:<[^>{]*>)?(?:\s+extends\s+(?P<base>[\w.<>]+))?[^{;]*\{", ""),
    ("function", r"^\s*(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+|@\w+\s+)*(?:<[^>]+>\s+)?(?:[\w<>\[\].,?]+\s+)?(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:throws\s+[\w.,\s]+)?\{", "class-only"),
]


def javascript(text, module):
    return braces(text, module, _JS, _JS_IMPORTS)


def typescript(text, module):
    return braces(text, module, _TS, _JS_IMPORTS)


def go(text, module):
    return braces(text, module, _GO, [r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$"], receivers=True)


def java(text, module):
    return braces(text, module, _JAVA, [r"^import\s+(?:static\s+)?([\w.]+)\s*;"], arity=True)


#: Suffix to (language, parser). Others can be registered under their suffix.
REGISTRY: dict[str, tuple[str, Callable]] = {".py": ("python", python), ".js": ("javascript", javascript), ".jsx": ("javascript", javascript), ".ts": ("typescript", typescript), ".tsx": ("typescript", typescript), ".go": ("go", go), ".java": ("java", java)}

#: Names that a language defines itself, by suffix: a bare call of one isn't a call of a method.
BUILTINS = {".py": sorted(x for x in dir(builtins)), ".go": ["append", "cap", "close", "copy", "delete", "len", "make", "new", "panic", "print", "println", "recover"], ".js": ["parseInt", "parseFloat", "isNaN", "require", "fetch", "setTimeout", "setInterval"]}


def register(suffix: str, language: str, parser: Callable) -> None:
    REGISTRY[suffix] = (language, parser)
