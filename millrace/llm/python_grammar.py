"""Python 3 modules as a parsing-expression grammar over token kinds."""

from __future__ import annotations

import re
import unicodedata

from millrace.llm.peg import Grammar

KEYWORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import "
    "in is lambda nonlocal not or pass raise return try while with yield"
).split()
SOFT = "match case type _".split()
OPERATORS = "**= //= >>= <<= ... != -> := ** // >> << <= >= == += -= *= /= %= &= |= ^= @= ( ) [ ] { } , : . ; @ = + - * / | & < > % ~ ^".split()
NAME, NUMBER, STRING, BYTES, NEWLINE, INDENT, DEDENT, BAD = "i", "n", "s", "b", "N", "I", "D", "\1"
KINDS = {o: o for o in OPERATORS if len(o) == 1}
KINDS |= {w: chr(0x100 + k) for k, w in enumerate([*KEYWORDS, *SOFT, *(o for o in OPERATORS if len(o) > 1)])}

_OPENING = re.compile(r"([rRbBuUfF]{0,2})(\"\"\"|'''|\"|')")
_PLAIN = {
    '"': re.compile(r'(?:[^"\\\n]|\\.)*"', re.DOTALL),
    "'": re.compile(r"(?:[^'\\\n]|\\.)*'", re.DOTALL),
    '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*"""', re.DOTALL),
    "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*'''", re.DOTALL),
}
_TOKEN = re.compile(
    r"(?P<space>[ \t\f]+|\\\n)|(?P<comment>\#[^\n]*)|(?P<newline>\n)"
    r"|(?P<name>[^\W\d]\w*)"
    r"|(?P<number>0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+"
    r"|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?"
    r"|[0-9](?:_?[0-9])*(?:[eE][+-]?[0-9](?:_?[0-9])*[jJ]?|[jJ])|0(?:_?0)*|[1-9](?:_?[0-9])*)"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|>>|<<|<=|>=|==|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[()\[\]{},:.;@=+\-*/|&<>%~^])|(?P<bad>.)",
    re.DOTALL,
)
_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b|(?!\w)")
_ESCAPES = re.compile(r"\\(?:([\\'\"abfnrtv\n0-7])|(x[0-9a-fA-F]{2})|(u[0-9a-fA-F]{4})|(U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4})|N\{([^}]*)\}|([xuUN])|(.))", re.DOTALL)


def _escapes_ok(body: str, raw: bool, is_bytes: bool) -> bool:
    if is_bytes and not body.isascii():
        return False
    if raw or "\\" not in body:
        return True
    for m in _ESCAPES.finditer(body):
        if is_bytes:
            if m[6] == "x":
                return False
        elif m[6]:
            return False
        elif m[5] is not None:
            try:
                unicodedata.lookup(m[5])
            except KeyError:
                return False
    return True


class _Scan:
    """Kinds and places of a module; stops at the first token that cannot be one."""

    def __init__(self, text: str) -> None:
        self.raw = text
        if text.startswith("﻿"):
            text = text[1:]
        self.text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.kinds: list[str] = []
        self.places: list[int] = []

    def add(self, kind: str, at: int) -> None:
        self.kinds.append(kind)
        self.places.append(at)

    def string(self, m: re.Match, at: int) -> tuple[str, int]:
        """Kind and end of the string that begins at ``at``."""
        prefix, quote = m[1].lower(), m[2]
        if prefix not in ("", "r", "b", "u", "f", "rb", "br", "rf", "fr"):
            return BAD, at
        start = m.end()
        if "f" in prefix:
            end = self.fstring(start, quote, "r" in prefix)
            return (STRING, end) if end > 0 else (BAD, at)
        body = _PLAIN[quote].match(self.text, start)
        if not body:
            return BAD, at
        inner = self.text[start : body.end() - len(quote)]
        if not _escapes_ok(inner, "r" in prefix, "b" in prefix):
            return BAD, at
        return BYTES if "b" in prefix else STRING, body.end()

    def fstring(self, at: int, quote: str, raw: bool) -> int:
        """End of an f-string whose body begins at ``at``, or -1."""
        text, begin = self.text, at
        while at < len(text):
            c = text[at]
            if text.startswith(quote, at):
                return at + len(quote) if _escapes_ok(re.sub(r"\{[^}]*\}", "", text[begin:at]).replace("\\{", "").replace("\\}", ""), raw, False) or "\\N{" in text[begin:at] else -1
            if c == "\\":
                if not raw and text.startswith("N{", at + 1):
                    end = text.find("}", at)
                    if end < 0:
                        return -1
                    at = end + 1
                else:
                    at += 1 if text[at + 1 : at + 2] in "{}" else 2
            elif c == "\n" and len(quote) == 1:
                return -1
            elif c in "{}" and text.startswith(c * 2, at):
                at += 2
            elif c == "{":
                at = self.field(at + 1, quote)
                if at < 0:
                    return -1
            elif c == "}":
                return -1
            else:
                at += 1
        return -1

    def field(self, at: int, quote: str) -> int:
        """End of a replacement field whose expression begins at ``at``, or -1."""
        text, depth, kinds = self.text, 0, []
        while True:
            if at >= len(text):
                return -1
            if depth == 0 and text[at] in "!}:=" and not text.startswith("!=", at) and not text.startswith("==", at):
                break
            if (m := _OPENING.match(text, at)) and not (text[at : at + 1].isalpha() and at and (text[at - 1].isalnum() or text[at - 1] == "_")):
                kind, at = self.string(m, at)
                if kind == BAD:
                    return -1
                kinds.append(kind)
                continue
            m = _TOKEN.match(text, at)
            kind = m.lastgroup
            if kind == "bad":
                return -1
            if kind == "name":
                kinds.append(KINDS.get(m[0], NAME))
            elif kind == "number":
                if not _AFTER_NUMBER.match(text, m.end()):
                    return -1
                kinds.append(NUMBER)
            elif kind == "op":
                o = m[0]
                if depth == 0 and o[0] == ":":
                    break
                depth += (o in "([{") - (o in ")]}")
                kinds.append(KINDS[o])
            at = m.end()
        if grammar.failure("".join(kinds), "FieldOnly") >= 0:
            return -1
        if text[at] == "=":
            at += 1
            while at < len(text) and text[at] in " \t\n":
                at += 1
        if text.startswith("!", at):
            m = re.compile(r"!\s*[rsa]\s*").match(text, at)
            if not m:
                return -1
            at = m.end()
        if text.startswith(":", at):
            at += 1
            while at < len(text) and text[at] != "}":
                if text[at] == "{":
                    at = self.field(at + 1, quote)
                    if at < 0:
                        return -1
                elif text.startswith(quote, at) or text[at] == "\n" and len(quote) == 1:
                    return -1
                else:
                    at += 1
        return at + 1 if text.startswith("}", at) else -1

    def run(self) -> None:
        text, add = self.text, self.add
        at, depth, fresh, indents = 0, 0, True, [(0, 0)]
        end = len(text)
        if "\0" in text:
            add(BAD, text.index("\0"))
            return
        while at < end:
            if fresh and not depth:
                col = alt = 0
                while at < end and text[at] in " \t\f":
                    c = text[at]
                    col, alt = (col + 1, alt + 1) if c == " " else ((col // 8 + 1) * 8, alt + 1) if c == "\t" else (0, 0)
                    at += 1
                if at >= end:
                    break
                if text[at] in "#\n":
                    stop = text.find("\n", at)
                    at = end if stop < 0 else stop + 1
                    continue
                if text.startswith("\\\n", at):
                    at += 2
                    while at < end and text[at] in " \t\f":
                        at += 1
                    if at >= end:
                        break
                fresh = False
                if (col, alt) != indents[-1]:
                    if col == indents[-1][0]:
                        return add(BAD, at)
                    if col > indents[-1][0]:
                        if alt <= indents[-1][1] or len(indents) >= 100:
                            return add(BAD, at)
                        indents.append((col, alt))
                        add(INDENT, at)
                    else:
                        while col < indents[-1][0]:
                            indents.pop()
                            add(DEDENT, at)
                        if (col, alt) != indents[-1]:
                            return add(BAD, at)
            m = _TOKEN.match(text, at)
            kind = m.lastgroup
            if kind == "space" or kind == "comment":
                at = m.end()
                if kind == "space" and m[0] == "\\\n" and at >= end:
                    return add(BAD, at - 2)
                continue
            if kind in ("name", "bad") and (s := _OPENING.match(text, at)):
                k, stop = self.string(s, at)
                add(k, at)
                if k == BAD:
                    return None
                at = stop
                continue
            if kind == "name":
                add(KINDS.get(m[0]) or (NAME if m[0].isascii() or m[0].isidentifier() else BAD), at)
            elif kind == "number":
                if not _AFTER_NUMBER.match(text, m.end()):
                    return add(BAD, at)
                add(NUMBER, at)
            elif kind == "op":
                o = m[0]
                depth = max(0, depth + (o in "([{") - (o in ")]}"))
                add(KINDS[o], at)
            elif kind == "newline":
                if not depth:
                    add(NEWLINE, at)
                    fresh = True
            else:
                return add(BAD, at)
            at = m.end()
        if depth:
            return add(BAD, end)
        if not fresh:
            add(NEWLINE, end)
        for _ in indents[1:]:
            add(DEDENT, end)
        return None


def kinds(text: str) -> str:
    """One kind for each token, with NEWLINE, INDENT and DEDENT."""
    s = _Scan(text)
    s.run()
    return "".join(s.kinds)


def place(text: str, token: int) -> int:
    """Character (line ends as one) at which the token begins."""
    s = _Scan(text)
    s.run()
    return s.places[token] if token < len(s.places) else len(text)


GRAMMAR = r"""
Module <- Statement* EOF
FieldOnly <- (YieldExpr / StarExprs) EOF
Statement <- Compound / SimpleLine
SimpleLine ~ Simple (';' Simple)* ';'? NEWLINE
Simple = Assignment / TypeAlias / StarExprs / YieldExpr / 'return' StarExprs? / ImportStmt / 'raise' (Expression ('from' Expression)?)? / 'pass' / 'del' DelTarget (',' DelTarget)* ','? &(';' / NEWLINE) / 'assert' Expression (',' Expression)? / 'break' / 'continue' / ('global' / 'nonlocal') NAME (',' NAME)*
Assignment <- NAME ':' Expression ('=' Rhs)? / ('(' SingleTarget ')' / AttrTarget) ':' Expression ('=' Rhs)? / (StarTargets '=')+ Rhs !'=' / SingleTarget AUG Rhs
Rhs = YieldExpr / StarExprs
TypeAlias <- 'type' NAME TypeParams? '=' Expression
ImportStmt <- 'import' DottedAs (',' DottedAs)* / 'from' (('.' / '...')* Dotted / ('.' / '...')+) 'import' ('*' / '(' FromAs (',' FromAs)* ','? ')' / FromAs (',' FromAs)*)
DottedAs = Dotted ('as' NAME)?
Dotted = NAME ('.' NAME)*
FromAs = NAME ('as' NAME)?
Compound <- Decorators? ('async'? FunctionDef / ClassDef) / 'if' NamedExpr ':' Suite ('elif' NamedExpr ':' Suite)* Else? / 'async'? (ForStmt / WithStmt) / 'while' NamedExpr ':' Suite Else? / TryStmt / MatchStmt
Else = 'else' ':' Suite
Decorators <- ('@' NamedExpr NEWLINE)+
FunctionDef <- 'def' NAME TypeParams? '(' Params? ')' ('->' Expression)? ':' Suite
ClassDef <- 'class' NAME TypeParams? ('(' Args? ')')? ':' Suite
ForStmt <- 'for' StarTargets 'in' StarExprs ':' Suite Else?
WithStmt <- 'with' ('(' WithItem (',' WithItem)* ','? ')' ':' / WithItem (',' WithItem)* ':') Suite
WithItem <- Expression ('as' StarTarget &(',' / ')' / ':'))?
TryStmt <- 'try' ':' Suite (Finally / (ExceptStar+ / Except+) Else? Finally?)
Finally = 'finally' ':' Suite
Except <- 'except' (Expression ('as' NAME)?)? ':' Suite
ExceptStar <- 'except' '*' Expression ('as' NAME)? ':' Suite
MatchStmt <- 'match' (StarNamed ',' StarNameds? / NamedExpr) ':' NEWLINE INDENT CaseBlock+ DEDENT
CaseBlock <- 'case' Patterns ('if' NamedExpr)? ':' Suite
Suite <- NEWLINE INDENT Statement+ DEDENT / SimpleLine
TypeParams <- '[' TypeParam (',' TypeParam)* ','? ']'
TypeParam <- NAME (':' Expression)? ('=' Expression)? / '*' NAME ('=' StarExpr)? / '**' NAME ('=' Expression)?
Params <- SlashPlain ParamPlain* ParamDefault* StarEtc? / SlashDefault ParamDefault* StarEtc? / ParamPlain+ ParamDefault* StarEtc? / ParamDefault+ StarEtc? / StarEtc
SlashPlain <- ParamPlain+ '/' ParamEnd
SlashDefault <- ParamPlain* ParamDefault+ '/' ParamEnd
ParamEnd = ',' / &')'
Param = NAME (':' Expression)?
ParamPlain <- Param ParamEnd
ParamDefault <- Param '=' Expression ParamEnd
ParamMaybe <- Param ('=' Expression)? ParamEnd
StarEtc <- '*' NAME (':' StarExpr)? ParamEnd ParamMaybe* Kwds? / '*' ',' ParamMaybe+ Kwds? / Kwds
Kwds <- '**' Param ParamEnd
LParams <- LSlashPlain LPlain* LDefault* LStarEtc? / LSlashDefault LDefault* LStarEtc? / LPlain+ LDefault* LStarEtc? / LDefault+ LStarEtc? / LStarEtc
LSlashPlain <- LPlain+ '/' LEnd
LSlashDefault <- LPlain* LDefault+ '/' LEnd
LEnd = ',' / &':'
LPlain <- NAME LEnd
LDefault <- NAME '=' Expression LEnd
LMaybe <- NAME ('=' Expression)? LEnd
LStarEtc <- '*' NAME LEnd LMaybe* LKwds? / '*' ',' LMaybe+ LKwds? / LKwds
LKwds <- '**' NAME LEnd
SingleTarget <- AttrTarget / NAME / '(' SingleTarget ')'
AttrTarget <- TPrimary ('.' NAME / '[' Slices ']') !TLook
TPrimary <- Atom &TLook (Trailer &TLook)*
TLook = '(' / '[' / '.'
StarTargets <- StarTarget (',' StarTarget)* ','?
StarTarget <- '*' !'*' StarTarget / AttrTarget / StarAtom
StarAtom <- NAME / '(' StarTargets? ')' / '[' StarTargets? ']'
DelTarget <- AttrTarget / NAME / '(' (DelTarget (',' DelTarget)* ','?)? ')' / '[' (DelTarget (',' DelTarget)* ','?)? ']'
StarExprs <- StarExpr (',' StarExpr)* ','?
StarExpr = '*' Arith / Expression
StarNamed = '*' Arith / NamedExpr
StarNameds <- StarNamed (',' StarNamed)* ','?
AssignExpr = NAME ':=' Expression
NamedExpr <- AssignExpr / Expression !':='
YieldExpr <- 'yield' ('from' Expression / StarExprs?)
Expression <- Lambda / Disjunction ('if' Disjunction 'else' Expression)?
Lambda <- 'lambda' LParams? ':' Expression
Disjunction <- Inversion (('or' / 'and') Inversion)*
Inversion = 'not' Inversion / Comparison
Comparison <- Arith (CompOp Arith)*
CompOp = '==' / '!=' / '<=' / '<' / '>=' / '>' / 'not' 'in' / 'in' / 'is' 'not' / 'is'
Arith <- Factor (BINOP Factor)*
Factor = ('+' / '-' / '~') Factor / Power
Power = AwaitPrimary ('**' Factor)?
AwaitPrimary = 'await' Primary / Primary
Primary <- Atom Trailer*
Trailer <- '.' NAME / '(' NamedExpr ForIf+ ')' / '(' Args? ')' / '[' Slices ']'
Slices <- (Slice / StarArg) (',' (Slice / StarArg))* ','?
Slice <- Expression? ':' Expression? (':' Expression?)? / NamedExpr
StarArg = '*' Expression
Args <- PosArg (',' PosArg)* (',' KwStar)* (',' KwDouble)* ','? / KwStar (',' KwStar)* (',' KwDouble)* ','? / KwDouble (',' KwDouble)* ','?
PosArg <- '*' Expression / (AssignExpr / Expression !':=') !'='
KwStar <- NAME '=' Expression / '*' Expression
KwDouble <- NAME '=' Expression / '**' Expression
Atom <- NAME / NUMBER / STRING+ !BYTES / BYTES+ !STRING / 'True' / 'False' / 'None' / '...' / '(' Paren / '[' Bracket / '{' Brace
Paren <- ')' / YieldExpr ')' / NamedExpr (ForIf+)? ')' / StarNamed ',' StarNameds? ')'
Bracket <- ']' / NamedExpr ForIf+ ']' / StarNameds ']'
Brace <- '}' / KvPair ForIf+ '}' / (KvPair / '**' Arith) (',' (KvPair / '**' Arith))* ','? '}' / NamedExpr ForIf+ '}' / StarNameds '}'
KvPair <- Expression ':' Expression
ForIf <- 'async'? 'for' StarTargets 'in' Disjunction ('if' Disjunction)*
Patterns <- (StarPattern / Pattern) ',' ((StarPattern / Pattern) (',' (StarPattern / Pattern))* ','?)? / Pattern
Pattern <- Closed ('|' Closed)* ('as' CAPTURE)?
StarPattern = '*' NAME
Closed <- LiteralPattern !('+' / '-') / ClassPattern / NAME ('.' NAME)+ !('.' / '(' / '=') / NAME !('.' / '(' / '=') / '(' Pattern ')' / '(' SeqPattern? ')' / '[' (ListPattern)? ']' / MapPattern
SeqPattern <- (StarPattern / Pattern) ',' ((StarPattern / Pattern) (',' (StarPattern / Pattern))* ','?)?
ListPattern <- (StarPattern / Pattern) (',' (StarPattern / Pattern))* ','?
LiteralPattern <- '-'? NUMBER (('+' / '-') NUMBER)? / STRING+ !BYTES / BYTES+ !STRING / 'None' / 'True' / 'False'
ClassPattern <- NAME ('.' NAME)* '(' (ClassArg (',' ClassArg)* ','?)? ')'
ClassArg <- NAME '=' Pattern / Pattern
MapPattern <- '{' (MapItem (',' MapItem)* ','?)? '}'
MapItem <- '**' CAPTURE / (LiteralPattern / NAME ('.' NAME)+) ':' Pattern
"""

_names = NAME + "".join(KINDS[w] for w in SOFT)
CLASSES = {
    "NAME": _names,
    "CAPTURE": _names.replace(KINDS["_"], ""),
    "NUMBER": NUMBER,
    "STRING": STRING,
    "BYTES": BYTES,
    "NEWLINE": NEWLINE,
    "INDENT": INDENT,
    "DEDENT": DEDENT,
    "AUG": "".join(KINDS[o] for o in "**= //= >>= <<= += -= *= /= %= &= |= ^= @=".split()),
    "BINOP": "".join(KINDS[o] for o in "| ^ & << >> + - * / // % @".split()),
}
grammar = Grammar(GRAMMAR, "Module", KINDS, CLASSES, delimiters=NEWLINE)
