"""Generated continuations as the corpus rules take them apart: stops, repeated heads, indents, bodies, prefixes and cuts.

Null counts as an empty text everywhere. None of these functions changes the logic of a text; they cut and shift lines.
"""

from __future__ import annotations

import ast
import re
import textwrap
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# What ends a continuation, as texts and as patterns, for the first and the second way of cleaning.
ENDS = ("<file_sep>", "```")
STARTS_ANEW = (r"\n\n(?=def\s+\w+\s*\()", r"\n\n(?=async\s+def\s+\w+\s*\()", r"\n\n(?=class\s+\w+)")
DANGLING = (r"\n\s{4}def\s*$", r"\n\s{4}async\s+def\s*$", r"\n\s{4}class\s*$", r"\n\s*def\s*$", r"\n\s*async\s+def\s*$", r"\n\s*class\s*$")
SECOND_ENDS = ("<|endoftext|>", "<file_sep>", "```")
SECOND_DANGLING = (r"\n\s{4}def\s*$", r"\n\s*def\s*$", r"\n\s*async\s+def\s*$", r"\n\s*class\s*$")
BODY_ENDS = ("###", "<file_sep>")
SIGNATURE_LINES = 30

_HEAD = re.compile(r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(", re.MULTILINE)
_CLASS_HEAD = re.compile(r"^\s*class\s+([A-Za-z_]\w*)\s*[:(]", re.MULTILINE)
_FENCED = re.compile(r"```[\w+-]*[ \t]*\n(.*?)```", re.DOTALL)
_CODE_BEGINS = re.compile(r"(?m)^(?:from\s+\S+\s+import\s+|import\s+|async\s+def\s+|def\s+|class\s+|\s{4,}\S)")
_DEFINITION = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def plain(text: str | None) -> str:
    """text with line feeds as its only line ends."""
    return (text or "").replace("\r\n", "\n").replace("\r", "\n")


def width(line: str, tab: int = 4) -> int:
    """Columns before the first sign that isn't a blank."""
    wide = line.expandtabs(tab)
    return len(wide) - len(wide.lstrip(" "))


def wanted_indent(prompt: str | None, tab: int = 4, empty: int = 4) -> int:
    """The indent of what follows the prompt: that of its last line, four more behind a colon."""
    said = [x for x in plain(prompt).splitlines() if x.strip()]
    return width(said[-1], tab) + 4 * said[-1].rstrip().endswith(":") if said else empty


def head_name(prompt: str | None) -> str | None:
    """The first function's name in a prompt, else the first class's."""
    code = textwrap.dedent(plain(prompt))
    found = _HEAD.search(code) or _CLASS_HEAD.search(code)
    return found and found.group(1)


def _first_said(lines: list[str]) -> int:
    return next((i for i, x in enumerate(lines) if x.strip()), len(lines))


def _behind(lines: list[str], at: int) -> str:
    """The lines from a place on behind one line end, blank ones before them dropped."""
    return "\n" + "\n".join(lines[at:]).lstrip("\n")


def without_repeated_head(prompt: str | None, text: str) -> str:
    """text without a first line that says the prompt's own def or class again."""
    name, lines = head_name(prompt), plain(text).splitlines()
    at = _first_said(lines)
    if not name or at == len(lines):
        return text if name is None else "\n"
    same = rf"(?:async\s+)?def\s+{name}\s*\(.*\)\s*(?:->\s*[^:]+)?\s*:\s*|class\s+{name}\s*[:(].*"
    if not re.fullmatch(same, lines[at].strip()):
        return text
    return _behind(lines, at + 1) if any(x.strip() for x in lines[at + 1 :]) else "\n"


def without_signature_tail(text: str) -> str:
    """text without the rest of a signature it begins with: lines up to the first that closes one, within SIGNATURE_LINES."""
    lines = plain(text).splitlines()
    at = _first_said(lines)
    if at == len(lines):
        return "\n"
    first = lines[at].strip()
    if not (first[-1] == "," or first[0] == ")" or "->" in first):
        return text
    for k, line in enumerate(lines[at : at + SIGNATURE_LINES], at):
        said = line.strip()
        if said.endswith(":") and (k > at or said[0] == ")" or "->" in said):
            return _behind(lines, k + 1)
    return text


def shifted(prompt: str | None, text: str) -> str:
    """text moved right as a whole where its least indent is short of what the prompt asks for, with a line end on both sides."""
    lines = plain(text).splitlines()
    said = [width(x) for x in lines if x.strip()]
    if not said:
        return "\n"
    short = " " * max(0, wanted_indent(prompt) - min(said))
    body = "\n".join(short + x if x.strip() else x for x in lines).rstrip()
    return ("" if body.startswith("\n") else "\n") + body + "\n"


def _cut(text: str, marks: tuple[str, ...], patterns: tuple[str, ...]) -> str:
    for mark in marks:
        text = text.partition(mark)[0]
    return text[: min((m.start() for p in patterns if (m := re.search(p, text))), default=len(text))]


def cleaned(prompt: str | None, output: str | None) -> str:
    """The continuation without what follows the function, without what repeats its head, at the body's indent."""
    text = _cut(plain(output), ENDS, STARTS_ANEW + DANGLING).rstrip() + "\n"
    return shifted(prompt, without_signature_tail(without_repeated_head(prompt, text)))


def cleaned_second(prompt: str | None, output: str | None) -> str:
    """The independent second way: other stops, tabs become blanks, only a whole def line is dropped."""
    lines = _cut(plain(output), SECOND_ENDS, STARTS_ANEW + SECOND_DANGLING).rstrip("\n ").splitlines()
    lines = lines[_first_said(lines) :]
    name = re.search(r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(", prompt or "")
    if name and lines and re.match(rf"\s*def\s+{name.group(1)}\s*\(.*\)\s*:\s*$", lines[0]):
        lines = lines[1:]
    said = [width(x) for x in lines if x.strip()]
    if not said:
        return "\n"
    short = " " * max(0, wanted_indent(prompt) - min(said))
    return "\n" + "\n".join(short + x.expandtabs(4) if x.strip() else x for x in lines).rstrip() + "\n"


def parses(code: str) -> bool:
    """Whether a source is valid Python as a module."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _as_body(text: str, indent: str) -> str:
    lines = textwrap.dedent(text.strip("\n")).splitlines()
    while lines and not lines[0].strip():
        del lines[0]
    body = "\n".join(indent + x.rstrip() if x.strip() else "" for x in lines).rstrip()
    return f"\n{body}\n" if body else "\n"


def _left(text: str) -> str:
    """text a level further left where some lines stand at the margin and others within."""
    lines = text.strip("\n").splitlines()
    depth = [len(x) - len(x.lstrip(" \t")) for x in lines if x.strip()]
    if 0 not in depth or max(depth) < 4:
        return text
    return "\n".join(x[4:] if x.startswith("    ") else x.removeprefix("\t") for x in lines)


def extracted_body(prompt: str | None, response: str | None) -> str:
    """The body in a chat answer: out of its fence, without headings, repeated head and later definitions; the first of five indentations that parses behind the prompt, else the last."""
    prompt, text = plain(prompt), plain(response)
    fenced = _FENCED.search(text)
    text = _cut(fenced.group(1) if fenced else text, BODY_ENDS, ()).strip("\n")
    begins = _CODE_BEGINS.search(text)
    text = text[begins.start() :] if begins else text
    if re.match(r"\s*(?:async\s+)?def\s+", text):
        marked = text.replace("'''", '"""')
        _, doc, rest = marked.partition('"""')
        rest = rest.partition('"""')
        if doc and rest[1]:
            text = rest[2]
        else:
            lines = marked.splitlines()
            inside = next((i for i, x in enumerate(lines) if i and x.startswith(("    ", "\t"))), 0)
            text = "\n".join(lines[inside:]) if inside else text
    text = _cut(text, (), STARTS_ANEW).rstrip()
    quoted = [x for x in prompt.splitlines() if '"""' in x or "'''" in x]
    indent = re.match(r"\s*", quoted[-1]).group() if quoted else ""
    indent = indent or "    "
    as_is = "\n" if not text.rstrip() else ("" if text.startswith("\n") else "\n") + text.rstrip() + "\n"
    tries = dict.fromkeys([as_is, *(_as_body(x, indent) for x in (text, textwrap.dedent(text), _left(text), textwrap.dedent(_left(text))))])
    return next((x for x in tries if parses(prompt.rstrip() + x)), list(tries)[-1])


def header_alignment(source: str | None, decorated: bool) -> dict:
    """Decorators before the first def, whether they and the def stand in column one, and the fault ('' for none)."""
    lines = plain(source).splitlines()
    at = next((i for i, x in enumerate(lines) if re.match(r"[ \t]*(?:async\s+)?def\b", x)), None)
    marks = [x for x in lines[:at] if x.lstrip(" \t").startswith("@")] if at is not None else []
    aligned, placed = all(x[0] == "@" for x in marks), at is not None and lines[at][:1] not in (" ", "\t")
    fault = "no_header" if at is None else "header_indent" if not placed else "decorator_indent" if not aligned else "decorator_missing" if decorated and not marks else "decorator_unexpected" if marks and not decorated else ""
    return {"decorators": len(marks), "decorators_aligned": aligned, "header_aligned": placed, "fault": fault}


def shared_prompt(human: str | None, machine: str | None) -> tuple[str | None, str]:
    """The prompt that two functions begin with, up to the end of the human one's docstring, and the fault where there is none."""
    text = plain(human)
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None, "syntax"
    if len(body) != 1 or not isinstance(body[0], _DEFINITION):
        return None, "not_one_definition"
    first = body[0].body[0]
    if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
        return None, "no_docstring"
    lines = text.splitlines(keepends=True)
    last = lines[first.end_lineno - 1].encode()[: first.end_col_offset].decode()
    prompt = "".join(lines[: first.end_lineno - 1]) + last
    return (prompt, "") if (machine or "").startswith(prompt) else (None, "not_shared")


def _same_head(one: ast.AST, other: ast.AST) -> str:
    dump = lambda n: n and ast.dump(n)
    if type(one) is not type(other) or one.name != other.name:
        return "name"
    if dump(one.args) != dump(other.args):
        return "arguments"
    if dump(one.returns) != dump(other.returns):
        return "returns"
    return "" if ast.get_docstring(one, clean=False) == ast.get_docstring(other, clean=False) else "docstring"


def cut_continuation(prompt: str | None, solution: str | None, output: str | None) -> dict:
    """The first cut of the output, at a line no deeper than the def's own level or at its end, whose function has the head and docstring of the human one and a body.

    cut is its length in signs and null with the last fault where no cut serves.
    """
    compose = lambda text: textwrap.dedent(plain(prompt) + plain(text)).strip() + "\n"
    failed = {"cut": None, "cuts": 0, "code": None, "fault": "human"}
    try:
        (human,) = ast.parse(compose(solution)).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return failed
    if not isinstance(human, _DEFINITION[:2]):
        return failed
    raw, limit, at = plain(output), max(0, wanted_indent(prompt, 8, 0) - 4), 0
    cuts = []
    for number, line in enumerate(raw.splitlines(keepends=True)):
        if number and line.strip() and not line.lstrip().startswith("#") and width(line.rstrip("\n"), 8) <= limit:
            cuts.append(at)
        at += len(line)
    cuts = sorted({*cuts, len(raw)})
    fault = "none"
    for at in cuts:
        code = compose(raw[:at])
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            fault = "syntax"
            continue
        if len(tree.body) != 1 or not isinstance(tree.body[0], _DEFINITION[:2]):
            fault = "not_one_function"
            continue
        made = tree.body[0]
        works = [s for s in made.body[ast.get_docstring(made) is not None :] if not isinstance(s, ast.Pass)]
        fault = _same_head(human, made) if works else "structure"
        if not fault:
            return {"cut": at, "cuts": len(cuts), "code": code, "fault": ""}
    return {"cut": None, "cuts": len(cuts), "code": None, "fault": fault}


def with_columns(df: DataFrame, inputs: list[str], make: Callable[..., tuple], out: str) -> DataFrame:
    """df without the inputs, with the columns of the schema out that make gives for each row's inputs, in Arrow batches."""
    keep = [f for f in df.schema.fields if f.name not in inputs]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    names = [x.split() for x in out.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(*x) for x in zip(*(b.column(c).to_pylist() for c in inputs))]
            arrays = [pa.array([m[k] for m in made], kinds[kind]) for k, (_, kind) in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), *arrays], [*(f.name for f in keep), *(n for n, _ in names)])

    return df.mapInArrow(work, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), out]))
