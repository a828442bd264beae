"""Token streams of Python, Java and C++ for the table-driven parser.

Each function gives the tokens' symbols and offsets; a symbol is a terminal
of the grammar, or BAD where no token of the language can begin.
"""

from __future__ import annotations

import re

BAD = "$bad"

PYTHON_WORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
)
_PYTHON = re.compile(
    r"""
    (?P<name>[^\W\d]\w*)(?P<quote>(?<=[rRbBuUfFtT])(?='|"))?
  | (?P<string>"{3}(?:[^"\\]|\\.|"(?!""))*+"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*+'{3}|"(?!"")(?:[^"\\\r\n]|\\(?:\r\n|.))*+"|'(?!'')(?:[^'\\\r\n]|\\(?:\r\n|.))*+')
  | (?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?))(?P<tail>\w*)
  | (?P<line>\r\n|\r|\n)
  | (?P<comment>\#[^\r\n]*)
  | (?P<join>\\(?:\r\n|\r|\n))
  | (?P<blank>[ \t\f]+)
  | (?P<op>\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|<=|>=|==|!=|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%@&|^~<>()\[\]{},:.;=])
  | (?P<bad>.)
    """,
    re.VERBOSE | re.DOTALL,
)
_PREFIXES = frozenset("r b u f t br rb fr rf tr rt".split())
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())


def python_tokens(text: str) -> tuple[list[str], list[int]]:
    """Logical lines with NEWLINE, INDENT and DEDENT, as the language's reference defines them."""
    out: list[str] = []
    at: list[int] = []
    indents = [(0, 0)]
    depth, fresh, begin, first = 0, True, 0, 0
    opened, case, cases = False, False, set()  # a match begins; this is a case; depths of indents that hold cases
    if text.startswith("﻿"):
        begin = 1
    for m in _PYTHON.finditer(text, begin):
        kind, value, start = m.lastgroup, m.group(), m.start()
        if kind == "blank" or kind == "comment" or kind == "join":
            continue
        if kind == "line":
            if not depth and not fresh:
                out.append("NEWLINE")
                at.append(start)
                if out[-2] == ":" and out[first] == "NAME" and len(out) - first > 3 and re.match(r"match\b", text[at[first] : at[first] + 6]) and out[first + 1] not in ("=", ".", ",", ":", ")"):
                    out[first], opened = "MATCH", True
                fresh = True
            continue
        if fresh and not depth:
            fresh = False
            lead = text[text.rfind("\n", 0, start) + 1 : start]
            lead = lead[lead.rfind("\r") + 1 :].rpartition("\f")[2].lstrip("﻿")
            width = (len(lead), len(lead)) if "\t" not in lead else (len(lead.expandtabs(8)), len(lead.expandtabs(1)))
            if width != indents[-1]:
                if width[0] > indents[-1][0]:
                    indents.append(width)
                    if opened:
                        cases.add(len(indents))
                    out.append("INDENT")
                    at.append(start)
                else:
                    while width[0] < indents[-1][0]:
                        indents.pop()
                        out.append("DEDENT")
                        at.append(start)
                if width != indents[-1]:
                    return [*out, BAD], [*at, start]
            cases = {c for c in cases if c <= len(indents)}
            first, opened = len(out), False
            case = len(indents) in cases and value == "case"
            if case:
                out.append("CASE")
                at.append(start)
                continue
        if kind == "name" or kind == "quote":
            if kind == "quote":
                if value.lower() in _PREFIXES:
                    continue  # the string follows
                out.append(BAD)
            elif value in PYTHON_WORDS:
                out.append("GUARD" if case and not depth and value == "if" else value)
            else:
                out.append("NAME")
        elif kind == "op":
            if value in "([{":
                depth += 1
            elif value in ")]}":
                depth = max(0, depth - 1)
            out.append("AUG" if value in _AUGMENTED else value)
        elif kind == "string":
            out.append("STRING")
        elif kind == "number" or kind == "tail":
            number, tail = m.group("number"), m.group("tail")
            zeros = number[0] == "0" and number.isdigit() and number.strip("0") != ""
            out.append("NUMBER" if not zeros and (not tail or tail in ("if", "else", "and", "or", "in", "is", "not", "for")) else BAD)
            if tail and out[-1] != BAD:
                at.append(start)
                out.append(tail)
        else:
            out.append(BAD)
        at.append(start)
        if out[-1] == BAD:
            return out, at
    if not fresh:
        out.append("NEWLINE")
        at.append(len(text))
    out += ["DEDENT"] * (len(indents) - 1)
    at += [len(text)] * (len(indents) - 1)
    return out, at


_C_LIKE = r"""
    (?P<name>[^\W\d][\w$]*|\$[\w$]*)
  | (?P<blank>\s+)
  | (?P<comment>//[^\r\n]*|/\*(?:[^*]|\*(?!/))*+\*/)
  | (?P<unclosed>/\*)
  | (?P<number>(?:0[xX][0-9a-fA-F_']+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01_']+|(?:\d[\d_']*\.?[\d_']*|\.\d[\d_']*)(?:[eE][+-]?\d+)?)[fFdDlLuUzZ]*)(?P<tail>[\w$]*)
"""
_JAVA = re.compile(
    _C_LIKE
    + r"""
  | (?P<string>\"{3}[ \t\f]*[\r\n](?:[^"\\]|\\.|"(?!""))*+\"{3}|"(?:[^"\\\r\n]|\\.)*+"|'(?:[^'\\\r\n]|\\(?:u+[0-9a-fA-F]{4}|[0-7]{1,3}|.))')
  | (?P<op>>>>=|>>=|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<|[-+*/%&|^]=|[-+*/%&|^~!<>=?:;,.@(){}\[\]])
  | (?P<bad>.)
    """,
    re.VERBOSE | re.DOTALL,
)
JAVA_WORDS = frozenset(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import
    instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while""".split()
)
_CPP = re.compile(
    r"""
    (?P<raw>(?:u8|[uUL])?R"(?P<mark>[^()\\\s]{0,16})\((?:.|\n)*?\)(?P=mark)")
  | (?P<literal>(?:u8|[uUL])?(?:"(?:[^"\\\r\n]|\\.)*+"(?:[A-Za-z_]\w*)?|'(?:[^'\\\r\n]|\\(?:[0-7]{1,3}|x[0-9a-fA-F]+|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.))+'))
  | (?P<line>^[ \t]*\#(?:[^\r\n\\]|\\(?:\r\n|.))*)
"""
    + "  |"
    + _C_LIKE.lstrip()
    + r"""
  | (?P<op><<=|>>=|<=>|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|<<|[-+*/%&|^]=|[-+*/%&|^~!<>=?:;,.(){}\[\]])
  | (?P<bad>.)
    """,
    re.VERBOSE | re.DOTALL | re.MULTILINE,
)
CPP_WORDS = frozenset(
    """asm auto bool break case catch char char8_t char16_t char32_t class co_await co_return co_yield const consteval constexpr constinit continue decltype default delete do double else enum
    explicit extern false float for friend goto if inline int long mutable namespace new noexcept nullptr operator private protected public register return short signed sizeof static static_assert
    struct switch template this thread_local throw true try typedef typename union unsigned using virtual void volatile wchar_t while""".split()
)
_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(?:(?:include[ \t]*(?:<[^>\r\n]+>|\"[^\"\r\n]+\"|\w+)|(?:define|undef|if|ifdef|ifndef|elif|else|endif|error|warning|pragma|line)\b[^\r\n]*(?:\\\r?\n[^\r\n]*)*)?[ \t]*(?://[^\r\n]*|/\*.*\*/)?[ \t]*)\Z", re.DOTALL)
_TYPE_ARGUMENT = frozenset("NAME . , ? & * && :: DIM ... extends super const LITERAL int long double float boolean bool char byte short unsigned signed void auto typename class struct ( )".split())


def _type_arguments(out: list[str], starts: frozenset[str]) -> None:
    """Turn '<' and '>' around type arguments into LT and GT."""
    opened: list[int] = []
    for i, s in enumerate(out):
        if s == "<":
            if i and out[i - 1] in starts or opened and i and out[i - 1] == "NAME":
                opened.append(i)
            else:
                opened.clear()
        elif s == ">" and opened:
            out[opened.pop()], out[i] = "LT", "GT"
        elif opened and (s not in _TYPE_ARGUMENT and s not in ("LT", "GT", "=") or s == "NAME" and out[i - 1] in ("&&", "*")):
            opened.clear()


def _double_close(out: list[str], at: list[int]) -> tuple[list[str], list[int]]:
    """Join '>' signs that stand together and close no type arguments into shift operators."""
    made: list[str] = []
    spots: list[int] = []
    for s, p in zip(out, at):
        if s in (">", ">=") and made and made[-1] in (">", ">>") and p == spots[-1] + len(made[-1]):
            made[-1] = {">>": ">>", ">>>": ">>>"}.get(made[-1] + s, "AUG")
        else:
            made.append(s)
            spots.append(p)
    return made, spots


def java_tokens(text: str) -> tuple[list[str], list[int]]:
    """Java tokens; DIM is an empty pair of brackets, LT and GT enclose type arguments, LAMBDA is a parameter list before an arrow."""
    out: list[str] = []
    at: list[int] = []
    for m in _JAVA.finditer(text):
        kind, value, start = m.lastgroup, m.group(), m.start()
        if kind == "blank" or kind == "comment":
            continue
        if kind == "name":
            out.append(value if value in JAVA_WORDS else "LITERAL" if value in ("true", "false", "null") else "NAME")
        elif kind == "op":
            if value == "]" and out and out[-1] == "[":
                out[-1] = "DIM"
                continue
            out.append("AUG" if value[-1] == "=" and len(value) > 1 and value not in ("==", "!=", "<=", ">=") else value)
        elif kind == "string":
            out.append("LITERAL")
        elif (kind == "number" or kind == "tail") and not m.group("tail"):
            out.append("LITERAL")
        else:
            return [*out, BAD], [*at, start]
        at.append(start)
    _type_arguments(out, frozenset(("NAME", ".", "public", "private", "protected", "static", "final", "abstract", "default", "{", "}", ";", "synchronized")))
    out, at = _double_close(out, at)
    made: list[str] = []
    spots: list[int] = []
    opened: list[int] = []
    for i, s in enumerate(out):
        if s == "(":
            opened.append(len(made))
        elif s == ")" and opened:
            b = opened.pop()
            if i + 1 < len(out) and out[i + 1] == "->":
                del made[b:], spots[b + 1 :]
                made.append("LAMBDA")
                continue
        elif s == "NAME":
            following, word = out[i + 1] if i + 1 < len(out) else "", text[at[i] : at[i] + 10]
            before = made[-1] if made else ";"
            if re.match(r"module\s", text[at[i] : at[i] + 7]) and following == "NAME" and not any(x in ("class", "interface", "enum") for x in made) and (before in (";", "]", ")", "NAME") or not made):
                if before == "NAME" and text.startswith("open", spots[-1]):
                    made.pop(), spots.pop()
                s = "MODULE"
            elif word.startswith("record ") and following == "NAME":
                s = "RECORD"
            elif re.match(r"(?:non-)?sealed\s", word) and following in ("class", "interface", "abstract", "public", "static"):
                s = "SEALED"
            elif word.startswith("permits ") and before in ("NAME", "GT") and following == "NAME":
                s = "PERMITS"
            elif word.startswith("yield ") and before in ("{", ";", "}", "->") and following not in ("=", ".", "(", "AUG"):
                s = "YIELD"
        made.append(s)
        spots.append(at[i])
    return made, spots


# The standard library's suffixes of numbers.
_SUFFIXES = frozenset("h min s ms us ns d y i il if".split())
_MACRO = re.compile(r"[A-Z][A-Z0-9_]{2,}\b")
_DECLARES = frozenset("auto bool char char8_t char16_t char32_t class const constexpr consteval constinit double enum explicit extern float friend inline int long public private protected short signed static struct template typedef typename union unsigned using virtual void volatile wchar_t".split())


def _without_macros(out: list[str], at: list[int], text: str) -> tuple[list[str], list[int]]:
    """The tokens without macros that stand before a declaration: a name in capitals, or such a call, that nothing else can explain."""
    if not _MACRO.search(text):
        return out, at
    made: list[str] = []
    spots: list[int] = []
    i = 0
    while i < len(out):
        if out[i] == "NAME" and (not made or made[-1] in (";", "}", "{", ":", ">")) and (m := _MACRO.match(text, at[i])) and i + 1 < len(out):
            after, call = i + 1, False
            if out[after] == "(":
                depth, call = 0, True
                while after < len(out):
                    depth += (out[after] == "(") - (out[after] == ")")
                    after += 1
                    if not depth:
                        break
            following = out[after] if after < len(out) else ""
            next_one = out[after + 1] if after + 1 < len(out) else ""
            if following in _DECLARES or following == "NAME" and (call or next_one in ("NAME", "::")):
                i = after
                continue
        made.append(out[i])
        spots.append(at[i])
        i += 1
    return made, spots


def _matching(out: list[str], at: int) -> int:
    """The place behind the bracket that closes the one at this place."""
    depth = 0
    for k in range(at, len(out)):
        depth += (out[k] in "([{") - (out[k] in ")]}")
        if not depth:
            return k + 1
    return len(out)


def _constraint_end(out: list[str], i: int, text: str, at: list[int]) -> int:
    """The place behind a constraint: names with arguments, groups and requirements, joined by && and ||."""
    while i < len(out):
        if out[i] == "(":
            i = _matching(out, i)
        elif out[i] == "NAME" and text.startswith("requires", at[i]):
            i += 1
            if i < len(out) and out[i] == "(":
                i = _matching(out, i)
            i = _matching(out, i) if i < len(out) and out[i] == "{" else i
        else:
            while i < len(out) and out[i] in ("NAME", "::"):
                i += 1
                if i < len(out) and out[i] == "<":
                    depth = 0
                    while i < len(out):
                        depth += (out[i] == "<") - (out[i] == ">")
                        i += 1
                        if not depth:
                            break
                    if i < len(out) and out[i] != "::":
                        break
                elif i < len(out) and out[i] == "NAME":
                    break
        if i < len(out) and out[i] in ("&&", "||"):
            i += 1
        else:
            return i
    return i


def _later_forms(out: list[str], at: list[int], text: str) -> tuple[list[str], list[int]]:
    """The tokens with concepts as aliases, and without constraints and assembly, whose inside the grammar doesn't know; operators of literals get a plain sign."""
    if not re.search(r"\b(?:concept|requires|asm|operator\s*\"\")", text):
        return out, at
    made: list[str] = []
    spots: list[int] = []
    i = 0
    while i < len(out):
        s, word = out[i], text[at[i] : at[i] + 9]
        if s == "NAME" and re.match(r"concept\b", word) and made[-1:] == [">"] and out[i + 1 : i + 3] == ["NAME", "="]:
            end = i + 3
            while end < len(out) and out[end] != ";":
                end = _matching(out, end) if out[end] in "([{" else end + 1
            made += ["using", "NAME", "=", "int"]
            spots += [at[i], at[i + 1], at[i + 2], at[min(i + 3, len(at) - 1)]]
            i = end
        elif s == "NAME" and re.match(r"requires\b", word) and made[-1:] == [">"]:
            i = _constraint_end(out, i + 1, text, at)
        elif s == "asm":
            k = i + 1
            while k < len(out) and out[k] in ("volatile", "inline", "goto"):
                k += 1
            if k < len(out) and out[k] == "(":
                i = _matching(out, k)
            else:
                made.append(s), spots.append(at[i])
                i += 1
        elif s == "STRING" and made[-1:] == ["operator"]:
            made.append("+"), spots.append(at[i])
            i += 2 if out[i + 1 : i + 2] == ["NAME"] else 1
        else:
            made.append(s), spots.append(at[i])
            i += 1
    return made, spots


def cpp_tokens(text: str) -> tuple[list[str], list[int]]:
    """C++ tokens without preprocessor lines and attributes; LT and GT enclose template arguments."""
    out: list[str] = []
    at: list[int] = []
    for m in _CPP.finditer(text):
        kind, value, start = m.lastgroup, m.group(), m.start()
        if kind == "blank" or kind == "comment":
            continue
        if kind == "line":
            if not _DIRECTIVE.match(value):
                return [*out, BAD], [*at, start]
            continue
        if kind == "name":
            if value in ("final", "override"):
                following = text[m.end() : m.end() + 40].lstrip()[:1]
                out.append(value if following in ("{", ";", ":", "=") else "NAME")
            else:
                out.append(value if value in CPP_WORDS else "NAME")
        elif kind == "op":
            if value == "]" and out[-1:] == ["]"] and "[[" in text:
                b = len(out) - 1
                while b > 0 and out[b] != "[":
                    b -= 1
                if b > 0 and out[b - 1] == "[" and at[b] == at[b - 1] + 1:
                    del out[b - 1 :], at[b - 1 :]
                    continue
            out.append("AUG" if value[-1] == "=" and len(value) > 1 and value not in ("==", "!=", "<=", ">=") else value)
        elif kind == "raw" or kind == "mark":
            out.append("STRING")
        elif kind == "literal":
            out.append("LITERAL" if value[-1] == "'" else "STRING")
        elif (kind == "number" or kind == "tail") and (not m.group("tail") or "_" in value or m.group("tail") in _SUFFIXES):
            out.append("LITERAL")
        else:
            return [*out, BAD], [*at, start]
        at.append(start)
    out, at = _without_macros(*_later_forms(out, at, text), text)
    _type_arguments(out, frozenset(("NAME", "template", "]")))
    return _double_close(out, at)


LEXERS = {"python": python_tokens, "java": java_tokens, "cpp": cpp_tokens}
