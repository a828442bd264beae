"""Python source analysis in Arrow batches; sources that do not parse get nulls and the error."""

from __future__ import annotations

import ast
import io
import keyword
import re
import textwrap
import tokenize
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# What counts as a decision; an elif belongs to its if, and each and/or to its two operands.
_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Match, ast.match_case)
SCHEMA = "ok boolean, error string, blocks array<string>, functions array<string>, classes int, has_body boolean, docstring_only boolean, returns boolean, complexity int, nodes int, tokens int, calls array<string>, keywords array<string>, operators array<string>, names_in_conditions array<string>"


def _parse(code: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(code)


def _is_doc(node: ast.stmt) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


def analyse(code: str | None) -> dict:
    """Syntax, top-level blocks, bodies, cyclomatic complexity (1 and 1 for each decision; and/or count one for each operand more) and names."""
    out: dict = {k.split()[0]: None for k in SCHEMA.split(", ")}
    if code is None:
        return out
    try:
        tree = _parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return out | {"ok": False, "error": f"{getattr(e, 'msg', None) or e} at line {getattr(e, 'lineno', None) or 0}"}
    nodes = list(ast.walk(tree))
    blocks = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    functions = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    bodies = [[s for s in f.body if not _is_doc(s) and not isinstance(s, ast.Pass)] for f in functions]
    lines = code.splitlines()
    elifs = sum(isinstance(n, ast.If) and len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and lines[n.orelse[0].lineno - 1].encode()[n.orelse[0].col_offset :].startswith(b"elif") for n in nodes)
    decisions = sum(isinstance(n, _DECISIONS) for n in nodes) - elifs + sum(len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp))
    try:
        words = [t.string for t in tokenize.generate_tokens(io.StringIO(code).readline) if t.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.COMMENT, tokenize.ENDMARKER)]
    except (tokenize.TokenError, SyntaxError, IndentationError):
        words = []
    called = {n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute))}
    tests = [n.test for n in nodes if isinstance(n, (ast.If, ast.While, ast.IfExp, ast.Assert))]
    return out | {
        "ok": True, "blocks": [n.name for n in blocks], "functions": [f.name for f in functions], "classes": sum(isinstance(n, ast.ClassDef) for n in nodes), "has_body": bool(bodies) and all(bodies), "docstring_only": any(len(f.body) == 1 and _is_doc(f.body[0]) for f in functions),
        "returns": any(isinstance(n, (ast.Return, ast.Yield, ast.YieldFrom)) for n in nodes), "complexity": 1 + decisions, "nodes": len(nodes), "tokens": len(words), "calls": sorted(called), "keywords": sorted({w for w in words if keyword.iskeyword(w)}),
        "operators": sorted({w for w in words if w and not (w[0].isalnum() or w[0] in "_\"'")}), "names_in_conditions": sorted({n.id for t in tests for n in ast.walk(t) if isinstance(n, ast.Name)}),
    }


def _columns(rows: list[dict], schema: str, kinds: dict[str, pa.DataType]) -> list[pa.Array]:
    return [pa.array([r[k.split()[0]] for r in rows], kinds[k.split()[1]]) for k in schema.split(", ")]


_KINDS = {"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def analysed(df: DataFrame, code: str) -> DataFrame:
    """df without the code column, with the columns of SCHEMA."""
    keep = [f for f in df.schema.fields if f.name != code]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [analyse(c) for c in batch.column(code).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *_columns(rows, SCHEMA, _KINDS)], [*(f.name for f in keep), *(k.split()[0] for k in SCHEMA.split(", "))])

    return df.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), SCHEMA]))


METRICS = ("avg_code_lines", "cyclomatic", "keywords", "branch_words", "nesting", "blank_lines", "functions", "declaring_lines")
_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match)
_DECLARES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom, ast.Global, ast.Nonlocal, ast.AnnAssign)
_WORDS = frozenset(keyword.kwlist) | frozenset("abstract auto bool boolean byte case catch char const default delete do double enum extends extern final float implements int interface long namespace new package private protected public short signed sizeof static struct super switch template this throw throws typedef unsigned using virtual void volatile".split())


def _nesting(node: ast.AST) -> int:
    """Control statements inside each other; elif stands beside its if."""
    most, stack = 0, [(node, 0)]
    while stack:
        n, depth = stack.pop()
        depth += isinstance(n, _NESTS)
        most = max(most, depth)
        for c in ast.iter_child_nodes(n):
            beside = isinstance(n, ast.If) and n.orelse == [c] and isinstance(c, ast.If) and c.col_offset == n.col_offset
            stack.append((c, depth - beside))
    return most


def static_metrics(code: str) -> list[float]:
    """METRICS of a source: Python by its tree, what doesn't parse (other languages too) by its words and braces."""
    lines = code.splitlines()
    blank = sum(not x.strip() for x in lines)
    bare = re.sub(r"(?s)/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|#[^\n]*", " ", code)
    try:
        tree = _parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        words = re.findall(r"[A-Za-z_]\w*", bare)
        heads = re.findall(r"\b(?!if\b|for\b|while\b|switch\b|catch\b|return\b|else\b)\w+\s*\([^;{}()]*\)[^;{}()]*\{", bare)
        depth = most = 0
        for c in bare:
            depth += (c == "{") - (c == "}")
            most = max(most, depth)
        decisions = sum(w in ("if", "for", "while", "case", "catch", "except", "elif") for w in words) + len(re.findall(r"&&|\|\||\?", bare))
        full = sum(bool(x.strip()) for x in bare.splitlines())
        declared = sum(bool(re.match(r"\s*(?:#\s*include|import|using|package|class|struct|def|(?:(?:public|private|protected|static|final|const)\s+)*[A-Za-z_][\w:<>,\[\]*&]*\s+\w+\s*(?:=|;|\())", x)) and not re.match(r"\s*(?:return|throw|else|new|delete)\b", x) for x in lines)
        return [full / max(1, len(heads)), len(heads) + decisions, sum(w in _WORDS for w in words), sum(w in ("if", "else", "elif", "while") for w in words), max(0, most - bool(heads)), blank, len(heads), declared]
    nodes = list(ast.walk(tree))
    functions = [n for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    decisions = sum(isinstance(n, _DECISIONS) for n in nodes) + sum(len(n.values) - 1 for n in nodes if isinstance(n, ast.BoolOp))
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(code).readline))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        tokens = []
    used = {i for t in tokens if t.type not in (tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.COMMENT, tokenize.ENDMARKER) for i in range(t.start[0], t.end[0] + 1)}
    words = [t.string for t in tokens if t.type == tokenize.NAME and keyword.iskeyword(t.string)]
    inside = [len(used & set(range(f.lineno, f.end_lineno + 1))) for f in functions]
    return [sum(inside) / max(1, len(inside)), len(functions) + decisions, len(words), sum(w in ("if", "else", "elif", "while") for w in words), _nesting(tree), blank, len(functions), len({n.lineno for n in nodes if isinstance(n, _DECLARES)})]


def with_metrics(df: DataFrame, code: str) -> DataFrame:
    """df without the code column, with METRICS as doubles."""
    keep = [f for f in df.schema.fields if f.name != code]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [static_metrics(c) for c in batch.column(code).to_pylist()]
            made = [pa.array([float(r[i]) for r in rows], pa.float64()) for i in range(len(METRICS))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), *made], [*(f.name for f in keep), *METRICS])

    return df.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{m} double" for m in METRICS)]))


def normalised_names(code: str) -> str | None:
    """The source with its functions as func_n and other bound names as var_n in order of appearance, comments dropped; None where it doesn't parse."""
    try:
        tree = _parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    functions = {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    bound = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)} | {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)}
    known: dict[str, str] = {}
    counts = {"func": 0, "var": 0}
    out: list[tuple[int, str]] = []
    previous = ""
    for t in tokenize.generate_tokens(io.StringIO(code).readline):
        if t.type == tokenize.COMMENT:
            continue
        text = t.string
        if t.type == tokenize.NAME and previous != "." and (text in functions or text in bound):
            if text not in known:
                kind = "func" if text in functions else "var"
                counts[kind] += 1
                known[text] = f"{kind}_{counts[kind]}"
            text = known[text]
        previous = t.string
        out.append((t.type, text))
    return tokenize.untokenize(out)


def composed(prompt: str, continuation: str) -> str:
    """Prompt and continuation dedented as one text, with one line feed at its end."""
    return textwrap.dedent(prompt + continuation).strip() + "\n"


def canonical(source: str | None) -> str:
    """The source with plain line feeds, its common indent and outer white space gone; what code hashes are taken of."""
    return textwrap.dedent((source or "").replace("\r\n", "\n").replace("\r", "\n")).strip()


def dedented(source: str) -> str:
    """The source less its first line's indent on every line that isn't inside a string of several lines."""
    indent = len(source) - len(source.lstrip(" \t"))
    if not indent:
        return source
    inside: set[int] = set()
    try:
        for t in tokenize.generate_tokens(io.StringIO(textwrap.indent(source, "") if not indent else "if 1:\n" + source).readline):
            if t.type == tokenize.STRING and t.end[0] > t.start[0]:
                inside.update(range(t.start[0], t.end[0]))
    except (tokenize.TokenError, SyntaxError, IndentationError):
        pass
    lines = source.splitlines(keepends=True)
    return "".join(x if i in inside or x[:indent].strip() else x[indent:] for i, x in enumerate(lines, 1))


def blocks(code: str | None) -> list[dict]:
    """Top-level functions and classes with their kind, name and lines, decorators included; none for what doesn't parse."""
    try:
        tree = _parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [
        {"kind": kinds[type(n)], "name": n.name, "start_line": min([n.lineno, *(d.lineno for d in n.decorator_list)]), "end_line": n.end_lineno}
        for n in tree.body
        if type(n) in kinds
    ]


def syntax_sequence(code: str | None) -> list[str]:
    """Node types in pre-order, inner nodes opened and closed, names and constants as they are; our own form of a parse tree as tokens."""
    try:
        tree = _parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[str] = []
    stack: list = [tree]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        children = list(ast.iter_child_nodes(n))
        kind = type(n).__name__
        leaf = getattr(n, "id", None) or getattr(n, "arg", None) or (repr(n.value) if isinstance(n, ast.Constant) else None)
        if not children:
            out.append(str(leaf) if leaf is not None else kind)
        else:
            out.append(f"{kind}::left")
            stack.append(f"{kind}::right")
            stack.extend(reversed(children))
    return out


def canonical_json(value: dict) -> str:
    """JSON with sorted keys, no blanks and only ASCII, nulls kept."""
    import json

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def with_blocks(df: DataFrame, code: str) -> DataFrame:
    """One row per top-level block of each source, the code column dropped."""
    keep = [f for f in df.schema.fields if f.name != code]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(c) for c in batch.column(code).to_pylist()]
            rows = pa.array([i for i, b in enumerate(found) for _ in b], pa.int64())
            flat = [(k, x) for b in found for k, x in enumerate(b)]
            part = batch.take(rows)
            made = [pa.array([k for k, _ in flat], pa.int32()), *(pa.array([x[c] for _, x in flat], t) for c, t in (("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())))]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in keep), *made], [*(f.name for f in keep), "block_idx", "kind", "name", "start_line", "end_line"])

    return df.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "block_idx int, kind string, name string, start_line int, end_line int"]))


def with_digest(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """df with the SHA-256 of the columns' canonical JSON; bit for bit what Python's own JSON gives, which to_json isn't."""
    import hashlib

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(columns).to_pylist()
            made = pa.array([hashlib.sha256(canonical_json(r).encode()).hexdigest() for r in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, out])

    return df.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{out} string"]))


def node_taxonomy() -> list[tuple[str, str]]:
    """(node type, family) of all node types of the language's own tree, by what they derive from."""
    families = {ast.stmt: "statement", ast.expr: "expression", ast.boolop: "operator", ast.operator: "operator", ast.unaryop: "operator", ast.cmpop: "operator", ast.pattern: "pattern", ast.mod: "module", ast.excepthandler: "clause", ast.expr_context: "context"}
    kinds = [v for v in vars(ast).values() if isinstance(v, type) and issubclass(v, ast.AST) and v.__module__ == "ast" and v not in families and v is not ast.AST]
    return sorted({(k.__name__, next((name for base, name in families.items() if issubclass(k, base)), "part")) for k in kinds})


def node_counts(code: str | None) -> dict[str, int]:
    """How often each node type stands in a source; empty where it doesn't parse."""
    try:
        tree = _parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {}
    out: dict[str, int] = {}
    for n in ast.walk(tree):
        out[type(n).__name__] = out.get(type(n).__name__, 0) + 1
    return out


def located(source: str | None, begin: int, end: int) -> dict:
    """The function whose body is the source's signs from begin to end (not included), outer blanks and a leading docstring aside: its dotted name, kind, lines and the fault.

    kind is function for one of the module, method for one right inside a class, nested otherwise. fault is '' or one of
    range, syntax, no_function and several_functions.
    """
    none = {"name": None, "kind": None, "start_line": None, "end_line": None}
    text = source or ""
    if not 0 <= begin < end <= len(text) or not text[begin:end].strip():
        return none | {"fault": "range"}
    try:
        tree = _parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return none | {"fault": "syntax"}
    lines = re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    place = lambda line, column: starts[line - 1] + len(lines[line - 1].encode()[:column].decode("utf-8", "ignore"))
    b = begin + len(text[begin:end]) - len(text[begin:end].lstrip())
    e = begin + len(text[begin:end].rstrip())
    found = []
    stack: list[tuple[ast.AST, str, str]] = [(tree, "", "function")]
    while stack:
        node, prefix, kind = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                body = child.body
                ends = place(body[-1].end_lineno, body[-1].end_col_offset)
                first = {place(s.lineno, s.col_offset) for s in (body[:2] if _is_doc(body[0]) else body[:1])}
                if b in first and e == ends:
                    found.append({"name": prefix + child.name, "kind": kind, "start_line": min([child.lineno, *(d.lineno for d in child.decorator_list)]), "end_line": child.end_lineno, "fault": ""})
                stack.append((child, f"{prefix}{child.name}.", "nested"))
            elif isinstance(child, ast.ClassDef):
                stack.append((child, f"{prefix}{child.name}.", "method" if isinstance(node, (ast.Module, ast.ClassDef)) else "nested"))
            else:
                stack.append((child, prefix, kind if isinstance(child, ast.mod) else "nested"))
    return found[0] if len(found) == 1 else none | {"fault": "several_functions" if found else "no_function"}
