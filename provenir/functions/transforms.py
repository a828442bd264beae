"""Comments, names and token sequences of Python, Java and C++ sources, by one scanner for all three.

Names are told by their places: a function's name stands before its parameter list where it is
declared, a variable's before an assignment, behind a type, in a parameter list or a loop head.
This is our own form of a parse; sequences aren't those of another parser.
"""

from __future__ import annotations

import hashlib
import re

# Words of the languages, which are no names, and the types they have built in.
WORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case".split(),
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends false final finally float for goto if implements import instanceof int interface long native new null package private protected public return short static strictfp super switch synchronized this throw throws transient true try void volatile while var record".split(),
    "cpp": "alignas alignof asm auto bool break case catch char class const consteval constexpr constinit const_cast continue decltype default delete do double dynamic_cast else enum explicit export extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register reinterpret_cast return short signed sizeof static static_assert static_cast struct switch template this throw true try typedef typename union unsigned using virtual void volatile wchar_t while".split(),
}
TYPES = {"python": [], "java": "boolean byte char double float int long short var".split(), "cpp": "auto bool char double float int long short unsigned signed wchar_t".split()}
MODES = ("plain", "variables", "functions", "comments")

_STRING = r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"
_REST = r"|(?P<number>\d[\w.]*)|(?P<name>[^\W\d]\w*)|(?P<line>\r\n|\r|\n)|(?P<blank>[ \t\f\v]+|\\(?:\r\n|\r|\n))|(?P<sign>->|::|\*\*|//|<<|>>|<=|>=|==|!=|&&|\|\||\+\+|--|[-+*/%&|^@]=|:=|.)"
_SCAN = {
    "python": re.compile(r"(?P<comment>\#[^\r\n]*)|(?P<string>[rRbBuUfF]{0,2}(?:\"{3}[\s\S]*?(?:\"{3}|\Z)|'{3}[\s\S]*?(?:'{3}|\Z)|" + _STRING + "))" + _REST, re.DOTALL),
    "java": re.compile(r"(?P<comment>//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>\"{3}[\s\S]*?(?:\"{3}|\Z)|" + _STRING + ")" + _REST, re.DOTALL),
    "cpp": re.compile(r"(?P<comment>//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>" + _STRING + r")|(?P<directive>(?m:^)[ \t]*\#(?:[^\r\n\\]|\\(?:\r\n|.))*)" + _REST, re.DOTALL),
}
_CLOSES = {")": "(", "]": "[", "}": "{"}
_GROUPS = {"(": "list", "[": "index", "{": "block"}


def scanned(code: str | None, lang: str) -> list[tuple[str, str]]:
    """(kind, text) of all pieces of a source in order; joined they are the source again. An unknown language is an error."""
    if lang not in _SCAN:
        raise ValueError(f"no scanner for {lang}")
    return [(m.lastgroup, m.group()) for m in _SCAN[lang].finditer(code or "")]


def without_comments(code: str | None, lang: str) -> str:
    """The source without its comments, without lines that only held one, and blanks at line ends gone; strings stay as they are."""
    marked = "".join("\x00" if kind == "comment" else text for kind, text in scanned(code, lang))
    kept = [x for x in re.split(r"(?<=\n)", marked) if x.strip() != "\x00"]
    return re.sub(r"[ \t]*\x00[ \t]*(?=\r?\n|\Z)", "", "".join(kept)).replace("\x00", " ")


def _told(pieces: list[tuple[str, str]], lang: str) -> tuple[list[str], list[str]]:
    """Names of declared functions and of variables, each in order of appearance."""
    said = [(k, t) for k, t in pieces if k not in ("blank", "comment", "line", "directive")]
    words, types = frozenset(WORDS[lang]), frozenset(TYPES[lang])
    functions: dict[str, None] = {}
    variables: dict[str, None] = {}
    at = lambda i: said[i][1] if 0 <= i < len(said) else ""
    depth, inside = 0, 0  # brackets open, and since when a parameter list is
    for i, (kind, value) in enumerate(said):
        depth += kind == "sign" and value in _GROUPS
        if kind == "sign" and value in _CLOSES:
            depth -= 1
            inside = 0 if depth < inside else inside
        if kind != "name" or value in words or at(i - 1) in (".", "->"):
            continue
        before, after = at(i - 1), at(i + 1)
        if lang == "python":
            if before == "def":
                functions[value] = None
                inside = depth + 1
            elif before == "class":
                continue
            elif after in ("=", ":=") and not (depth and after == "=" and not inside) or re.fullmatch(r"[-+*/%&|^@]=", after) or inside and before in ("(", ",", "*", "**") or before in ("for", "as") or after == ":" and at(i + 2) and depth == 0 and before not in ("else", "lambda", "in", "if", "while", "return", "and", "or", "not") and at(i + 3) == "=":
                variables[value] = None
            elif before == "," and after in (",", "in") and any(at(j) == "for" for j in range(max(0, i - 6), i)):
                variables[value] = None
        else:
            typed = said[i - 1][0] == "name" and (before not in words or before in types) or before in (">", "]", "&", "*") and i > 1 and (said[i - 2][0] == "name" or at(i - 2) in (">", "[", "*", "&"))
            if after == "(" and typed and before not in ("new", "return"):
                functions[value] = None
            elif typed and after in ("=", ";", ",", ")", ":", "["):
                variables[value] = None
    return list(functions), [v for v in variables if v not in functions]


def names(code: str | None, lang: str) -> dict[str, list[str]]:
    """functions, variables, keywords and operators of a source: the names in order, the others as sorted sets."""
    pieces = scanned(code, lang)
    functions, variables = _told(pieces, lang)
    words = frozenset(WORDS[lang])
    return {"functions": functions, "variables": variables, "keywords": sorted({t for k, t in pieces if k == "name" and t in words}), "operators": sorted({t for k, t in pieces if k == "sign" and t not in "()[]{},;:."})}


def renamed(code: str | None, lang: str, kind: str) -> str:
    """The source with its variables as var_n or its functions as func_n in order of appearance; names behind a dot are others'."""
    pieces = scanned(code, lang)
    functions, variables = _told(pieces, lang)
    chosen, stem = (variables, "var") if kind == "variables" else (functions, "func")
    new = {v: f"{stem}_{n}" for n, v in enumerate(chosen, 1)}
    out, last = [], ""
    for k, t in pieces:
        out.append(new.get(t, t) if k == "name" and last not in (".", "->") else t)
        last = t if k not in ("blank", "line", "comment") else last
    return "".join(out)


def token_sequence(code: str | None, lang: str) -> list[str]:
    """Tokens in order; a bracket's inside stands between <group>::left and <group>::right. Groups left open are closed at the end, stray closing signs are tokens."""
    out: list[str] = []
    open_: list[str] = []
    for kind, text in scanned(code, lang):
        if kind in ("blank", "line", "comment"):
            continue
        if kind == "sign" and text in _GROUPS:
            open_.append(text)
            out.append(f"{_GROUPS[text]}::left")
        elif kind == "sign" and text in _CLOSES and open_ and open_[-1] == _CLOSES[text]:
            out.append(f"{_GROUPS[open_.pop()]}::right")
        else:
            out.append(text)
    return out + [f"{_GROUPS[x]}::right" for x in reversed(open_)]


def transformed(code: str | None, lang: str, mode: str) -> str:
    """The token sequence of a source after a mode: plain, variables or functions renamed, or comments removed before; an unknown mode is an error."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    made = code if mode == "plain" else without_comments(code, lang) if mode == "comments" else renamed(code, lang, mode)
    return " ".join(token_sequence(made, lang))


def profile(code: str | None, lang: str | None) -> tuple:
    """Tokens, functions, variables, keywords and operators of a source by number, and a digest of each mode's sequence; nulls for a language without a scanner."""
    if lang not in _SCAN or code is None:
        return (None,) * (5 + len(MODES))
    found = names(code, lang)
    return len(token_sequence(code, lang)), *(len(found[k]) for k in ("functions", "variables", "keywords", "operators")), *(hashlib.sha256(transformed(code, lang, m).encode("utf-8", "surrogatepass")).hexdigest() for m in MODES)


PROFILE = ", ".join(["tokens int", *(f"{k} int" for k in ("functions", "variables", "keywords", "operators")), *(f"{m}_sha256 string" for m in MODES)])
