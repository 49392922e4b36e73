"""Code extraction: symbols and metrics of Python sources, definitions of brace languages."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ROW = "file_path string, part string, kind string, name string, qualified string, parent string, target string, start_line long, end_line long, signature string"
METRICS = "file_path string, name string, qualified string, cyclomatic long, cognitive long, nesting long, params long, typed boolean, is_async boolean, has_docstring boolean, patterns array<string>"
# Patterns by words of a name.
NAME_PATTERNS = ("repository", "factory", "singleton", "observer", "strategy", "adapter", "decorator", "command", "builder", "service", "model", "provider", "validator", "serializer", "middleware")
_BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Try)
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert, ast.IfExp)


def _last(node: ast.AST) -> str:
    """The last segment of a possibly dotted or subscripted name."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return node.attr
    if isinstance(node, ast.Subscript):
        return _last(node.value)
    return _last(node.func) if isinstance(node, ast.Call) else ""


def python_symbols(source: str) -> Iterator[tuple]:
    """(part, kind, name, qualified, parent, target, start, end, signature): definitions, references and edges of a module."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return
    lines = source.splitlines()

    def signature(node) -> str:
        text = " ".join(" ".join(lines[node.lineno - 1 : node.body[0].lineno - 1] or [lines[node.lineno - 1]]).split())
        return text[:240].rstrip("; (:=")

    def walk(node: ast.AST, scope: tuple[str, ...], in_class: bool) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            here, parent = ".".join(scope), scope[-1] if scope else ""
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                qualified = ".".join([*scope, child.name])
                yield ("def", kind, child.name, qualified, parent, None, start, child.end_lineno, signature(child))
                for base in getattr(child, "bases", ()):
                    if name := _last(base):
                        yield ("edge", "inherits", child.name, qualified, parent, name, base.lineno, base.lineno, None)
                        yield ("ref", "type", name, here, child.name, None, base.lineno, base.lineno, None)
                yield from walk(child, (*scope, child.name), kind == "class")
                continue
            if isinstance(child, (ast.Import, ast.ImportFrom)):
                for name in dict.fromkeys(x.name.split(".")[-1] for x in child.names):
                    yield ("ref", "import", name, here, parent, None, child.lineno, child.lineno, None)
                    yield ("edge", "imports", parent, here, parent, name, child.lineno, child.lineno, None)
            elif isinstance(child, ast.Call) and (name := _last(child.func)):
                yield ("ref", "call", name, here, parent, None, child.lineno, child.lineno, None)
                if scope:
                    yield ("edge", "calls", parent, here, parent, name, child.lineno, child.lineno, None)
            elif isinstance(child, ast.Attribute) and not (isinstance(node, ast.Call) and node.func is child):
                yield ("ref", "member", child.attr, here, parent, None, child.lineno, child.lineno, None)
            yield from walk(child, scope, in_class and not isinstance(child, ast.Lambda))

    yield from walk(tree, (), False)


def _cyclomatic(node: ast.AST) -> int:
    total = 1
    for x in ast.walk(node):
        total += isinstance(x, _BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0)
    return total


def _nested(node: ast.AST, depth: int = 0) -> tuple[int, int]:
    """(cognitive, deepest nesting) below a node."""
    cost, deepest = 0, depth
    for child in ast.iter_child_nodes(node):
        inner = depth + isinstance(child, _BLOCKS)
        if isinstance(child, _BLOCKS) and not isinstance(child, (ast.Try, ast.With, ast.AsyncWith)):
            cost += 1 + depth
        cost += len(child.values) - 1 if isinstance(child, ast.BoolOp) else 0
        more, deep = _nested(child, inner)
        cost, deepest = cost + more, max(deepest, deep, inner)
    return cost, deepest


def name_patterns(name: str) -> list[str]:
    words = set(re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name.replace("_", " "))) | {name}
    return [p for p in NAME_PATTERNS if any(p == w.lower() for w in words)]


def python_metrics(source: str) -> Iterator[tuple]:
    """A row of metrics for each class and function; nothing for broken sources."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return

    def walk(node, scope):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                args = getattr(child, "args", None)
                every = [*args.posonlyargs, *args.args, *args.kwonlyargs] if args else []
                own = [a for a in every if a.arg not in ("self", "cls")]
                cognitive, nesting = _nested(child)
                typed = args is not None and (child.returns is not None or any(a.annotation is not None for a in own))
                qualified = ".".join([*scope, child.name])
                yield (child.name, qualified, _cyclomatic(child), cognitive, nesting, len(own), typed, any(isinstance(x, (ast.AsyncFunctionDef, ast.Await)) for x in ast.walk(child)), ast.get_docstring(child) is not None, name_patterns(child.name))
                yield from walk(child, [*scope, child.name])
            else:
                yield from walk(child, scope)

    yield from walk(tree, [])


def _apply(files: DataFrame, extract, schema: str) -> DataFrame:
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *row) for path, source in zip(frame.file_path, frame.content) for row in extract(source or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("file_path", "content").mapInPandas(run, schema)


def extract_python(files: DataFrame) -> DataFrame:
    """Definitions, references and edges of (file_path, content), one row each, told apart by `part`."""
    return _apply(files, python_symbols, ROW)


def enrich_python(files: DataFrame) -> DataFrame:
    return _apply(files, python_metrics, METRICS)


def brace_scan(source: str, language: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, name, qualified, start, end) of types and functions in brace languages, by keywords and brace depth.

    Comments and strings are blanked first. This is a scanner, not a parser: it misses
    definitions whose header spans unusual shapes.
    """
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    text = re.sub(r"/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'", blank, source, flags=re.S)
    words = {
        "kotlin": r"(?P<kind>class|interface|object|fun)\s+(?:<[^>]*>\s*)?(?P<name>\w+)", "rust": r"(?P<kind>struct|enum|trait|impl|fn)\s+(?:<[^>]*>\s*)?(?P<name>\w+)",
        "go": r"(?P<kind>func)\s+(?:\([^)]*\)\s*)?(?P<name>\w+)|type\s+(?P<name2>\w+)\s+(?P<kind2>struct|interface)", "dart": r"(?P<kind>class|enum|mixin)\s+(?P<name>\w+)",
        "typescript": r"(?P<kind>class|interface|enum|function)\s+(?P<name>\w+)", "javascript": r"(?P<kind>class|function)\s+(?P<name>\w+)", "java": r"(?P<kind>class|interface|enum|record)\s+(?P<name>\w+)",
        "c": r"(?P<kind>struct|enum)\s+(?P<name>\w+)\s*\{", "cpp": r"(?P<kind>class|struct|enum|namespace)\s+(?P<name>\w+)",
    }.get(language)
    if not words:
        return
    kinds = {"fun": "function", "fn": "function", "func": "function"}
    found = []
    for m in re.finditer(words, text):
        g = m.groupdict()
        kind, name = g.get("kind") or g.get("kind2"), g.get("name") or g.get("name2")
        start, depth, end = text.count("\n", 0, m.start()) + 1, 0, None
        stop = re.compile(r"[{};\n]").search
        i = m.end()
        while end is None:
            s = stop(text, i)
            if s is None:
                end = text.count("\n") + 1
            elif s[0] == "{":
                depth += 1
            elif s[0] == "}" and depth:
                depth -= 1
                end = text.count("\n", 0, s.start()) + 1 if depth == 0 else None
            elif depth == 0 and s[0] in ";}" or depth == 0 and s[0] == "\n" and not re.match(r"\s*[{:(,]", text[s.end() :]) and text[m.end() : s.start()].count("(") == text[m.end() : s.start()].count(")"):
                end = text.count("\n", 0, s.start()) + 1
            i = s.end() if s else len(text)
        outer = [n for k, n, a, b in found if a <= start and end <= b and k != "function"]
        found.append((kinds.get(kind, kind), name, start, end))
        shown = "method" if kinds.get(kind) == "function" and outer else kinds.get(kind, kind)
        yield shown, name, ".".join([*outer, name]), start, end
