"""LALR(1) tables from a grammar text, and the parser that runs on them.

A grammar has lines `name: alternative | alternative`; a line that begins with
blanks goes on with the last rule. Quoted symbols and words in capitals are
terminals. `x?`, `x*` and `x+` are short for helper rules, and `%left`,
`%right` and `%nonassoc` lines give operators rising precedence; an
alternative may end in `%prec TOKEN`. A conflict that precedence doesn't
settle goes to the shift, or to the earlier of two rules.
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

END = "$end"


class Tables(NamedTuple):
    """What the parser needs; terminals are numbered from 0, states from 0, rules from 1."""

    terminals: dict[str, int]
    action: list[dict[int, int]]  # > 0 shift to state - 1, < 0 reduce by rule, 0 accept
    goto: list[dict[int, int]]
    length: list[int]
    left: list[int]


def _read(text: str) -> tuple[list[tuple[str, tuple[str, ...], str]], dict[str, tuple[int, str]], str]:
    rules: list[tuple[str, tuple[str, ...], str]] = []
    precedence: dict[str, tuple[int, str]] = {}
    helpers: set[str] = set()
    named = lambda s: s[1:-1] if s[0] == "'" else s if s.isupper() else f"<{s}>"

    def symbol(s: str) -> list[tuple[str, ...]]:
        """The ways to write a symbol with a mark: as nothing, or as one symbol."""
        if s[-1] not in "?*+" or len(s) == 1:
            return [(named(s),)]
        base, mark = named(s[:-1]), s[-1]
        if mark == "?":
            return [(), (base,)]
        many = f"{base}+"
        if many not in helpers:
            helpers.add(many)
            rules.append((many, (base,), ""))
            rules.append((many, (many, base), ""))
        return [(many,)] if mark == "+" else [(), (many,)]

    start, name = "", ""
    for line in text.strip().splitlines():
        line = line.rstrip()
        if not line or line.lstrip().startswith("//"):
            continue
        if line[0] == "%":
            kind, *tokens = line[1:].split()
            level = 1 + max((p for p, _ in precedence.values()), default=0)
            precedence |= {named(t): (level, kind) for t in tokens}
            continue
        if line[0] not in " \t":
            name, _, line = line.partition(":")
            name = named(name.strip())
            start = start or name
        else:
            line = line.strip()
            line = line[1:] if line.startswith("| ") or line == "|" else line
        for alternative in re.split(r"(?:^|\s)\|(?=\s|$)", line):
            words = alternative.split()
            prec = ""
            if "%prec" in words:
                prec = named(words[words.index("%prec") + 1])
                words = words[: words.index("%prec")]
            for chosen in itertools.product(*(symbol(w) for w in words)):
                rules.append((name, tuple(s for part in chosen for s in part), prec))
    return list(dict.fromkeys(rules)), precedence, start


def build(text: str, conflicts: list | None = None) -> Tables:
    """The LALR(1) tables, by the relations of DeRemer and Pennello.

    conflicts gets (terminal, rule, other rule or "shift") where no precedence decided.
    """
    rules, precedence, start = _read(text)
    rules.insert(0, ("$start", (start, END), ""))
    by_left: dict[str, list[int]] = {}
    for r, (left, _, _) in enumerate(rules):
        by_left.setdefault(left, []).append(r)
    terminals = {s: i for i, s in enumerate(dict.fromkeys(s for _, right, _ in rules for s in right if s not in by_left))}
    nonterminals = {s: i for i, s in enumerate(by_left)}
    nullable: set[str] = set()
    while new := {left for left, right, _ in rules if left not in nullable and all(s in nullable for s in right)}:
        nullable |= new

    closures: dict[frozenset, list] = {}

    def closure(kernel: frozenset) -> list[tuple[int, int]]:
        if kernel not in closures:
            items, seen = list(kernel), set(kernel)
            for r, dot in items:
                right = rules[r][1]
                if dot < len(right) and right[dot] in by_left:
                    for q in by_left[right[dot]]:
                        if (q, 0) not in seen:
                            seen.add((q, 0))
                            items.append((q, 0))
            closures[kernel] = items
        return closures[kernel]

    kernels = [frozenset({(0, 0)})]
    number = {kernels[0]: 0}
    moves: list[dict[str, int]] = []
    for kernel in kernels:  # grows
        by_symbol: dict[str, set] = {}
        for r, dot in closure(kernel):
            if dot < len(rules[r][1]):
                by_symbol.setdefault(rules[r][1][dot], set()).add((r, dot + 1))
        out = {}
        for s, items in by_symbol.items():
            target = frozenset(items)
            if target not in number:
                number[target] = len(kernels)
                kernels.append(target)
            out[s] = number[target]
        moves.append(out)

    steps = [(p, s) for p, out in enumerate(moves) for s in out if s in by_left]
    index = {step: i for i, step in enumerate(steps)}
    sets: list[set[str]] = [{s for s in moves[moves[p][a]] if s not in by_left} for p, a in steps]
    reads = [[index[moves[p][a], s] for s in moves[moves[p][a]] if s in nullable] for p, a in steps]
    _spread(sets, reads)
    includes: list[list[int]] = [[] for _ in steps]
    lookback: dict[tuple[int, int], list[int]] = {}
    for i, (p, a) in enumerate(steps):
        for r in by_left[a]:
            q, right = p, rules[r][1]
            for k, s in enumerate(right):
                if s in by_left and all(x in nullable for x in right[k + 1 :]):
                    includes[index[q, s]].append(i)
                q = moves[q][s]
            lookback.setdefault((q, r), []).append(i)
    _spread(sets, includes)

    action: list[dict[int, int]] = []
    for q, kernel in enumerate(kernels):
        row = {terminals[s]: t + 1 for s, t in moves[q].items() if s in terminals and s != END}
        if END in moves[q]:
            row[terminals[END]] = 0
        for r, dot in closure(kernel):
            right = rules[r][1]
            if dot < len(right) or r == 0:
                continue
            level = precedence.get(rules[r][2] or next((s for s in reversed(right) if s in terminals), ""))
            for s in set().union(*(sets[i] for i in lookback.get((q, r), []))):
                t, ahead = terminals[s], precedence.get(s)
                if t not in row:
                    row[t] = -r
                elif row[t] < 0:
                    if conflicts is not None:
                        conflicts.append((s, rules[r][:2], rules[-row[t]][:2]))
                    row[t] = max(row[t], -r)
                elif level and ahead:
                    if level[0] > ahead[0] or level[0] == ahead[0] and ahead[1] == "left":
                        row[t] = -r
                    elif level[0] == ahead[0] and ahead[1] == "nonassoc":
                        del row[t]
                elif conflicts is not None:
                    conflicts.append((s, rules[r][:2], "shift"))
        action.append(row)
    goto = [{nonterminals[s]: t for s, t in out.items() if s in by_left} for out in moves]
    return Tables(terminals, action, goto, [len(right) for _, right, _ in rules], [nonterminals[left] for left, _, _ in rules])


def _spread(sets: list[set[str]], edges: list[list[int]]) -> None:
    """Add to each set the sets its edges lead to, over whole strong components at once."""
    low: list[int] = [0] * len(sets)
    stack: list[int] = []
    done = len(sets) + 1
    for root in range(len(sets)):
        if low[root]:
            continue
        work = [(root, iter(edges[root]))]
        stack.append(root)
        low[root] = depth = len(stack)
        depths = {root: depth}
        while work:
            x, rest = work[-1]
            y = next(rest, None)
            if y is None:
                work.pop()
                if low[x] == depths[x]:
                    while True:
                        z = stack.pop()
                        low[z] = done
                        if z == x:
                            break
                        sets[z] = sets[x]
                if work:
                    up = work[-1][0]
                    low[up] = min(low[up], low[x])
                    sets[up] |= sets[x]
            elif not low[y]:
                stack.append(y)
                low[y] = depths[y] = len(stack)
                work.append((y, iter(edges[y])))
            else:
                low[x] = min(low[x], low[y])
                sets[x] |= sets[y]


def first_error(tables: Tables, tokens: list[int]) -> int:
    """Where the first token stands that no sentence of the grammar can have there; -1 if all fit.

    tokens must end in the number of END.
    """
    action, goto, length, left = tables.action, tables.goto, tables.length, tables.left
    stack = [0]
    for i, t in enumerate(tokens):
        a = action[stack[-1]].get(t)
        while True:
            if a is None:
                return i
            if a > 0:
                stack.append(a - 1)
                break
            if a == 0:
                return -1
            n = length[-a]
            if n:
                del stack[-n:]
            stack.append(goto[stack[-1]][left[-a]])
            a = action[stack[-1]].get(t)
    return len(tokens)
