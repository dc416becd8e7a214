"""Digests, measures and comments of one piece of source text. Plain Python, called from Arrow functions."""

from __future__ import annotations

import ast
import functools
import hashlib
import io
import re
import textwrap
import tokenize
from collections.abc import Iterable, Iterator

import numpy as np

from .text import SKETCH_MASK, SKETCH_SALTS

_WORD = re.compile(r"[A-Za-z_]\w*|[^\sA-Za-z_]")
_BRANCH = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.Assert, ast.comprehension, ast.IfExp)
_REGEX_BRANCH = re.compile(r"\b(?:if|else if|for|while|case|catch|\?\?|&&|\|\|)\b|\?")
#: Characters of a comment that are kept for display; its digest is of all of them.
SHOWN = 200


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


def body_hash(text: str) -> str:
    return digest("".join(text.split()))


def tree_of(text: str) -> ast.AST | None:
    try:
        return ast.parse(textwrap.dedent(text))
    except (SyntaxError, ValueError, RecursionError):
        return None


@functools.lru_cache(maxsize=1)
def _seen(text: str) -> ast.AST | None:
    """tree_of() of the text that several measures are taken of; not to be changed."""
    return tree_of(text)


def shape_hash(text: str, short: str) -> str:
    """Digest of the kinds of syntax nodes, breadth first; of the text without the name where it doesn't parse."""
    tree = _seen(text)
    if tree is None:
        return body_hash(text.replace(short, ""))
    return digest("|".join(type(n).__name__ for n in ast.walk(tree)))


def logic_hash(text: str) -> str:
    """Digest of the syntax tree without docstrings and the definition's own name: it moves when behaviour does."""
    tree = tree_of(text)
    if tree is None:
        return body_hash(text)
    if tree.body and hasattr(tree.body[0], "name"):
        tree.body[0].name = "_"
    return digest(ast.dump(_undocumented(tree)))


def _undocumented(tree: ast.AST) -> ast.AST:
    """The tree, changed: without docstrings."""
    for node in ast.walk(tree):
        block = getattr(node, "body", None)
        if isinstance(block, list) and block and isinstance(block[0], ast.Expr) and isinstance(block[0].value, ast.Constant) and isinstance(block[0].value.value, str):
            node.body = block[1:] or [ast.Pass()]
    return tree


def complexity(text: str, suffix: str) -> int:
    """Branches plus one: of the syntax tree for Python, of words and operators for other languages."""
    if suffix != ".py":
        return 1 + len(_REGEX_BRANCH.findall(text))
    tree = _seen(text)
    if tree is None:
        return 1
    return 1 + sum(isinstance(n, _BRANCH) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(tree))


def annotations(text: str) -> tuple[dict[str, str], str]:
    """Declared types of a function's parameters, and of what it returns."""
    tree = _seen(text)
    head = tree.body[0] if tree is not None and tree.body else None
    if not isinstance(head, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return {}, ""
    every = [*head.args.posonlyargs, *head.args.args, *head.args.kwonlyargs]
    return {a.arg: ast.unparse(a.annotation) for a in every if a.annotation is not None}, ast.unparse(head.returns) if head.returns else ""


def _row(line: int, text: str, kind: str) -> dict:
    return {"line": line, "text": text[:SHOWN], "kind": kind, "h": digest(text)}


def python_comments(text: str) -> list[dict]:
    """The docstring, then the comments, with their lines within the text."""
    found = []
    try:
        for t in () if "#" not in text else tokenize.generate_tokens(io.StringIO(text).readline):
            words = t.string.lstrip("#").strip() if t.type == tokenize.COMMENT else ""
            if words:
                found.append(_row(t.start[0], words, "comment"))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        pass
    tree = _seen(text)
    if tree is not None and tree.body:
        named = isinstance(tree.body[0], (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
        owner = tree.body[0] if named else tree
        words = " ".join((ast.get_docstring(owner) or "").split())
        if words:
            found.insert(0, _row(owner.body[0].lineno, words, "docstring"))
    return found


_C_COMMENT = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def brace_comments(text: str) -> list[dict]:
    """// and /* */ comments outside of quotes."""
    found = []
    for m in _C_COMMENT.finditer(text):
        if m[0][0] == "/":
            words = " ".join(re.sub(r"^[\s*]+", "", x) for x in m[0].strip("/*").splitlines()).strip()
            if words:
                found.append(_row(text.count("\n", 0, m.start()) + 1, words, "comment"))
    return found


def comments(text: str, suffix: str) -> list[dict]:
    return python_comments(text) if suffix == ".py" else brace_comments(text)


def blanked(text: str) -> str:
    """The text with comments and quoted parts as spaces; lines and places stay."""
    return _C_COMMENT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def comment_hash(found: list[dict]) -> str:
    return digest("\n".join(c["h"] or c["text"] for c in found)) if found else ""


def shingle_hashes(text: str, family: str = "blake2b6") -> set[int]:
    """48-bit hashes of the distinct runs of three tokens; of all tokens where there are fewer."""
    tokens = _WORD.findall(text)
    runs = {"\0".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))}
    return set(_hashed(runs, family))


def _hashed(runs: Iterable[str], family: str) -> Iterator[int]:
    make = (lambda x: hashlib.blake2b(x, digest_size=6).digest()) if family == "blake2b6" else (lambda x: hashlib.md5(x).digest()[:6])
    return (int.from_bytes(make(r.encode("utf-8", "surrogatepass")), "big") for r in runs)


def sketch(text: str, family: str = "blake2b6") -> tuple[list[int], int]:
    """(48 minima under XOR permutations, number of distinct shingles)."""
    hashes = shingle_hashes(text, family)
    return [min(h ^ k for h in hashes) & SKETCH_MASK for k in SKETCH_SALTS], len(hashes)


_SALTS = np.array(SKETCH_SALTS, np.uint64)[:, None]


def text_sketch(text: str) -> tuple[int, np.ndarray]:
    """(number of distinct shingles, 48 minima) of the 48-bit MD5 hashes: text.sketch_of() for whole tables."""
    t = _WORD.findall(text)
    runs = set(map("\0".join, zip(t, t[1:], t[2:]))) if len(t) > 2 else {"\0".join(t)}
    hashes = np.frombuffer(b"".join([hashlib.md5(r.encode("utf-8", "surrogatepass")).digest()[:8] for r in runs]), ">u8").astype(np.uint64) >> np.uint64(16)
    # Blocks of hashes that stay in the cache, whatever the text's length.
    return len(runs), np.min([(_SALTS ^ hashes[i : i + 2048]).min(axis=1) for i in range(0, len(hashes), 2048)], axis=0).astype(np.int64)


#: The measures of a text, by the columns that hold them.
MEASURES = ("body_hash", "shape_hash", "logic_hash", "comment_hash", "return_type", "param_types", "comments", "loc", "complexity", "n_shingles", "sketch")


def measures(text: str, short: str, suffix: str, family: str, wanted: Iterable[str] = MEASURES) -> dict:
    """The wanted measures of one entity's text."""
    out, wanted = {}, set(wanted)
    if "body_hash" in wanted:
        out["body_hash"] = body_hash(text)
    if "shape_hash" in wanted:
        out["shape_hash"] = shape_hash(text, short)
    if "logic_hash" in wanted:
        out["logic_hash"] = logic_hash(text)
    if wanted & {"comments", "comment_hash"}:
        out["comments"] = comments(text, suffix)
        out["comment_hash"] = comment_hash(out["comments"])
    if wanted & {"param_types", "return_type"}:
        types, out["return_type"] = annotations(text) if suffix == ".py" else ({}, "")
        out["param_types"] = list(types.items())
    if "loc" in wanted:
        out["loc"] = text.count("\n") + 1
    if "complexity" in wanted:
        out["complexity"] = complexity(text, suffix)
    if wanted & {"sketch", "n_shingles"}:
        out["sketch"], out["n_shingles"] = sketch(text, family)
    return out


def measures_of_pieces(pieces: Iterable[tuple[int, str]], family: str, wanted: Iterable[str] = MEASURES) -> dict:
    """measures() of a Python file given as (lines before it, text) of runs of whole statements, one tree at a time.

    Kept of the file are a byte for each syntax node, eight bytes for each distinct run of tokens, and its comments.
    """
    wanted = set(wanted)
    body, logic, names, levels, notes, docstring, types, n_lines, branches, least, hashes, carry, begun, empty = hashlib.sha256(), hashlib.sha256(b"Module("), [], [], [], None, ({}, ""), 1, 1, None, np.empty(0, np.uint64), [], False, True
    ids: dict[str, int] = {}
    for line, text in pieces:
        n_lines += text.count("\n")
        if "body_hash" in wanted:
            body.update("".join(text.split()).encode("utf-8", "surrogatepass"))
        if wanted & {"sketch", "n_shingles"}:
            tokens = carry + _WORD.findall(text)
            if len(tokens) > 2:
                new = np.fromiter(_hashed({"\0".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)}, family), np.uint64)
                lows = [(new ^ np.uint64(k)).min() for k in SKETCH_SALTS]
                least = lows if least is None else [min(x) for x in zip(least, lows)]
                hashes = np.union1d(hashes, new)
            carry = tokens[-2:]
        if wanted & {"comments", "comment_hash"}:
            found = python_comments(text)
            tree = _seen(text)
            if tree is not None and tree.body and found and found[0]["kind"] == "docstring":
                docstring = found.pop(0) if not begun else found.pop(0) and docstring
                if docstring and not begun:
                    docstring["line"] += line
            for c in found:
                c["line"] += line
            notes += found
        tree = _seen(text)
        if tree is None or not tree.body:
            continue
        if "complexity" in wanted:
            branches += complexity(text, ".py") - 1
        if not begun and wanted & {"param_types", "return_type"}:
            types = annotations(text)
        if "shape_hash" in wanted:
            level, k = list(tree.body), 0
            while level:
                if k == len(levels):
                    levels.append(bytearray())
                levels[k] += bytes(ids.setdefault(type(n).__name__, len(ids)) for n in level)
                level, k = [c for n in level for c in ast.iter_child_nodes(n)], k + 1
        if "logic_hash" in wanted:
            own = tree_of(text)
            # Only the file's first statement is its docstring, or the definition whose name doesn't count.
            if not begun and hasattr(own.body[0], "name"):
                own.body[0].name = "_"
            head = own.body[0]
            if not begun and isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and isinstance(head.value.value, str):
                own.body = own.body[1:]
            for n in own.body:
                logic.update((("body=[" if empty else ", ") + ast.dump(_undocumented(n))).encode("utf-8", "surrogatepass"))
                empty = False
        begun = True
    out = {}
    if "body_hash" in wanted:
        out["body_hash"] = body.hexdigest()[:16]
    if "shape_hash" in wanted:
        shape, names = hashlib.sha256(b"Module"), list(ids)
        for level in levels:
            for i in range(0, len(level), 1 << 16):
                shape.update("".join("|" + names[c] for c in level[i : i + (1 << 16)]).encode())
        out["shape_hash"] = shape.hexdigest()[:16]
    if "logic_hash" in wanted:
        logic.update((b"body=[Pass()])" if begun else b")") if empty else b"])")
        out["logic_hash"] = logic.hexdigest()[:16]
    if wanted & {"comments", "comment_hash"}:
        out["comments"] = [docstring, *notes] if docstring else notes
        out["comment_hash"] = comment_hash(out["comments"])
    if wanted & {"param_types", "return_type"}:
        out |= {"param_types": list(types[0].items()), "return_type": types[1]}
    if "loc" in wanted:
        out["loc"] = n_lines
    if "complexity" in wanted:
        out["complexity"] = branches
    if wanted & {"sketch", "n_shingles"}:
        if least is None:
            out["sketch"], out["n_shingles"] = sketch(" ".join(carry), family)
        else:
            out["sketch"], out["n_shingles"] = [int(x) & SKETCH_MASK for x in least], len(hashes)
    return out
