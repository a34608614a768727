"""Packrat parsing-expression grammars over token kinds, compiled to Python functions.

A text is first cut into tokens, each of which has a kind of one character; a grammar then works
on the string of kinds. Notation, one rule a line (indented lines continue it)::

    Rule <- 'if' Par Stmt ('else' Stmt)? / !'x' NAME* &';'     memoised by position (packrat)
    Rule =  ...                                                not memoised (cheap)
    Rule ~  ...                                                memoised by content: for rules that end at the
                                                               first of the delimiters after their begin, across texts

``'x'`` is the token x, CAPITALS a class of kinds, ``@name`` a hook (p -> new p or -1), other names
are rules. Ordered choice, greedy repetition, lookahead. The whole input must be consumed. Two sets
of functions are compiled: a fast one, and one that notes the furthest position at which a
terminal failed, used only for texts that the fast one rejects.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)+')|(@\w+)|([A-Za-z_]\w*)|([/*+?!&().]))")
_MEMO_LIMIT = 100_000


class Grammar:
    """A compiled grammar; ``kinds`` maps token text to its kind, ``classes`` a name to its kinds."""

    def __init__(self, text: str, start: str, kinds: dict[str, str], classes: dict[str, str], hooks: dict[str, Callable] | None = None, delimiters: str = ";{}") -> None:
        self.kinds, self.classes, self.start, self.delimiters = kinds, {"EOF": "\0", **classes}, start, delimiters + "\0"
        self.rules: dict[str, tuple] = {}
        self.mode: dict[str, str] = {}
        for line in re.split(r"\n(?=\S)", text.strip()):
            m = re.match(r"(\w+)\s*(<-|=|~)(.*)", line, re.DOTALL)
            self.mode[m[1]] = m[2]
            self.rules[m[1]] = self._read(m[3])
        self._nullable = dict.fromkeys(self.rules, False)
        self._first: dict[str, set[str]] = {r: set() for r in self.rules}
        while True:
            before = sum(map(len, self._first.values())), sum(self._nullable.values())
            for r, e in self.rules.items():
                n, f = self._look(e)
                self._nullable[r] |= n
                self._first[r] |= f
            if before == (sum(map(len, self._first.values())), sum(self._nullable.values())):
                break
        self.spaces = [self._compile(track, hooks or {}) for track in (False, True)]

    # reading the notation

    def _read(self, text: str) -> tuple:
        tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise SyntaxError(f"grammar: {text[at:at + 30]!r}")
            tokens.append(m[0].strip())
            at = m.end()
        tokens.append("")
        pos = 0

        def choice() -> tuple:
            nonlocal pos
            alts = [seq()]
            while tokens[pos] == "/":
                pos += 1
                alts.append(seq())
            return alts[0] if len(alts) == 1 else ("or", alts)

        def seq() -> tuple:
            items = []
            while tokens[pos] not in ("", "/", ")"):
                items.append(prefix())
            return items[0] if len(items) == 1 else ("seq", items)

        def prefix() -> tuple:
            nonlocal pos
            if tokens[pos] in "!&" and tokens[pos]:
                op = tokens[pos]
                pos += 1
                return op, prefix()
            x = atom()
            while tokens[pos] and tokens[pos] in "*+?":
                x = tokens[pos], x
                pos += 1
            return x

        def atom() -> tuple:
            nonlocal pos
            t = tokens[pos]
            pos += 1
            if t == "(":
                x = choice()
                assert tokens[pos] == ")", tokens[pos - 5 : pos + 5]
                pos += 1
                return x
            if t[0] == "'":
                return "set", self.kinds[t[1:-1].replace("\\'", "'")]
            if t[0] == "@":
                return "hook", t[1:]
            if t in self.classes:
                return "set", self.classes[t]
            return "rule", t

        x = choice()
        assert tokens[pos] == "", tokens[pos:]
        return x

    def _look(self, e: tuple) -> tuple[bool, set[str]]:
        """Whether e may match nothing, and the kinds with which it may begin."""
        op = e[0]
        if op == "set":
            return False, set(e[1])
        if op == "rule":
            return self._nullable[e[1]], self._first[e[1]]
        if op in "!&" or op == "hook":
            return True, set()
        if op == "seq":
            f: set[str] = set()
            for x in e[1]:
                n, g = self._look(x)
                f |= g
                if not n:
                    return False, f
            return True, f
        if op == "or":
            both = [self._look(x) for x in e[1]]
            return any(n for n, _ in both), set().union(*(g for _, g in both))
        n, f = self._look(e[1])
        return n or op in "*?", f

    # compiling

    def _compile(self, track: bool, hooks: dict[str, Callable]) -> dict:
        out: list[str] = []
        fresh = iter(range(10**9))

        def put(depth: int, line: str) -> None:
            out.append("    " * depth + line)

        def miss(depth: int) -> None:
            if track:
                put(depth, "if p > FAR[0]: FAR[0] = p")

        def kindset(s: set[str] | str) -> str:
            return repr("".join(sorted(s)))

        def test(s: set[str] | str) -> str:
            return f"K[p] == {kindset(s)}" if len(s) == 1 else f"K[p] in {kindset(s)}"

        def gen(e: tuple, d: int) -> None:
            op = e[0]
            if op == "set":
                put(d, f"if {test(e[1])}: p += 1")
                put(d, "else:")
                miss(d + 1)
                put(d + 1, "p = -1")
            elif op == "rule":
                put(d, f"p = {e[1]}(K, p)")
            elif op == "hook":
                put(d, f"p = {e[1]}(p)")
            elif op == "seq":
                for k, x in enumerate(e[1]):
                    gen(x, d)
                    if k < len(e[1]) - 1:
                        put(d, "if p >= 0:")
                        d += 1
                if not e[1]:
                    put(d, "pass")
            elif op == "or":
                s = f"s{next(fresh)}"
                put(d, f"{s} = p")
                put(d, "p = -1")
                for k, x in enumerate(e[1]):
                    n, f = self._look(x)
                    if k:
                        put(d, "if p < 0:")
                        d += 1
                    put(d, f"p = {s}")
                    if n:
                        gen(x, d)
                    else:
                        put(d, f"if {test(f)}:")
                        gen(x, d + 1)
                        put(d, "else:")
                        miss(d + 1)
                        put(d + 1, "p = -1")
            elif op in "*+?":
                n, f = self._look(e[1])
                s = f"s{next(fresh)}"
                if op == "+":
                    gen(e[1], d)
                    put(d, "if p >= 0:")
                    d += 1
                if op == "?":
                    put(d, f"if {test(f)}:" if not n else "if True:")
                    put(d + 1, f"{s} = p")
                    gen(e[1], d + 1)
                    put(d + 1, f"if p < 0: p = {s}")
                else:
                    put(d, f"while {test(f)}:" if not n else "while True:")
                    put(d + 1, f"{s} = p")
                    gen(e[1], d + 1)
                    put(d + 1, f"if p < 0 or p == {s}:")
                    put(d + 2, f"p = {s}")
                    put(d + 2, "break")
                if track and not n:
                    put(d, f"if p >= 0 and p > FAR[0] and not ({test(f)}): FAR[0] = p")
            else:
                s = f"s{next(fresh)}"
                put(d, f"{s} = p")
                if track:
                    put(d, f"far{s} = FAR[0]")
                gen(e[1], d)
                if track:
                    put(d, f"FAR[0] = far{s}")
                put(d, f"p = {s} if p {'<' if op == '!' else '>='} 0 else -1")

        for r, e in self.rules.items():
            mode = self.mode[r] if not (track and self.mode[r] == "~") else "<-"
            put(0, f"def {r}(K, p):")
            if mode == "<-":
                put(1, f"m = M_{r}.get(p)")
                put(1, "if m is not None: return m")
                put(1, "begin = p")
            elif mode == "~":
                put(1, "begin = p")
                put(1, "end = DELIM(K, p).end()")
                put(1, "part = K[p:end]")
                put(1, f"m = C_{r}.get(part)")
                put(1, "if m is not None: return p + m")
            gen(e, 1)
            if mode == "<-":
                put(1, f"M_{r}[begin] = p")
            elif mode == "~":
                put(1, "if p == end or p == end - 1:")
                put(2, f"if len(C_{r}) > {_MEMO_LIMIT}: C_{r}.clear()")
                put(2, f"C_{r}[part] = p - begin")
            put(1, "return p")
        space: dict = {"FAR": [0], "DELIM": re.compile(f"[^{self.delimiters}]*[{self.delimiters}]").match, **hooks}
        for r in self.rules:
            space[f"M_{r}"] = {}
            space[f"C_{r}"] = {}
        exec("\n".join(out), space)  # noqa: S102
        space["memos"] = [space[f"M_{r}"] for r in self.rules if self.mode[r] == "<-" or track]
        return space

    def failure(self, kinds: str, start: str = "") -> int:
        """-1 if the kinds (without the end mark) follow the grammar as a whole, else the furthest failing token."""
        k = kinds + "\0"
        limit = sys.getrecursionlimit()
        need = 4000 + 40 * len(k)
        if need > limit:
            sys.setrecursionlimit(need)
        try:
            for track in (False, True):
                space = self.spaces[track]
                for m in space["memos"]:
                    m.clear()
                space["FAR"][0] = 0
                p = space[start or self.start](k, 0)
                if p == len(k):
                    return -1
            return min(space["FAR"][0], len(kinds))
        finally:
            if need > limit:
                sys.setrecursionlimit(limit)
