"""JSON values (RFC 8259) and XML 1.0 documents as parsing-expression grammars over token kinds."""

from __future__ import annotations

import re

from millrace.llm.peg import Grammar

BAD = "\1"


class Json:
    """One RFC 8259 value."""

    TOKEN = re.compile(r"""[ \t\n\r]+|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|.""", re.DOTALL)
    KINDS = {c: c for c in "{}[]:,"} | {w: "v" for w in ("true", "false", "null")}
    grammar = Grammar(
        """
Json <- Value EOF
Value = '{' (Pair (',' Pair)*)? '}' / '[' (Value (',' Value)*)? ']' / SCALAR
Pair = STRING ':' Value
""",
        "Json",
        KINDS,
        {"SCALAR": "sv", "STRING": "s"},
    )

    @classmethod
    def _kind(cls, t: str) -> str:
        c = t[0]
        if c in " \t\n\r":
            return ""
        if k := cls.KINDS.get(t):
            return k
        if c == '"':
            return "s" if len(t) > 1 else BAD
        return "v" if t[-1] in "0123456789" else BAD

    @classmethod
    def kinds(cls, text: str) -> str:
        return "".join(map(cls._kind, cls.TOKEN.findall(text)))

    @classmethod
    def failure(cls, text: str) -> int:
        """-1 or the furthest failing character."""
        n = cls.grammar.failure(cls.kinds(text))
        if n < 0:
            return -1
        for m in cls.TOKEN.finditer(text):
            if cls._kind(m[0]):
                if not n:
                    return m.start()
                n -= 1
        return len(text)


_START = r"A-Z_a-z:\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02FF\u0370-\u037D\u037F-\u1FFF\u200C\u200D\u2070-\u218F\u2C00-\u2FEF\u3001-\uD7FF\uF900-\uFDCF\uFDF0-\uFFFD\U00010000-\U000EFFFF"
NAME = rf"[{_START}][{_START}.0-9\u00B7\u0300-\u036F\u203F\u2040-]*"
_S = r"[ \t\r\n]"
_LIT = r"(?:\"[^\"]*\"|'[^']*')"
_ATT = rf"{NAME}{_S}*={_S}*(?:\"[^<\"]*\"|'[^<']*')"
_COMMENT = r"<!--(?:[^-]|-[^-])*-->"
_PI = rf"<\?(?![xX][mM][lL](?:{_S}|\?>)){NAME}(?:{_S}(?:(?!\?>).)*)?\?>"
_NAME_CHARS = rf"[{_START}.0-9\u00B7\u0300-\u036F\u203F\u2040-]+"


class Declarations:
    """Tokens of a document type declaration. A word has a kind of its own only where the grammar needs it as a keyword;
    a literal has one for what it may stand for (public identifier, attribute value, entity value)."""

    TOKEN = re.compile(
        rf"(?P<O><!DOCTYPE)|(?P<l><!ELEMENT)|(?P<a><!ATTLIST)|(?P<e><!ENTITY)|(?P<o><!NOTATION)|(?P<H>{_COMMENT})|(?P<P>{_PI})|(?P<W>{_S}+)"
        rf"|(?P<Z>%{NAME};)|(?P<word>{NAME})|(?P<k>{_NAME_CHARS})|(?P<hash>\#[A-Z]+)|(?P<text>{_LIT})|(?P<sign>[][()|,?*+%>])|(?P<bad>.)",
        re.DOTALL,
    )
    WORDS = {"SYSTEM": "y", "PUBLIC": "p", "EMPTY": "m", "ANY": "m", "CDATA": "c", "NOTATION": "N", "NDATA": "d"} | dict.fromkeys(("ID", "IDREF", "IDREFS", "ENTITY", "ENTITIES", "NMTOKEN", "NMTOKENS"), "c")
    HASHES = {"#PCDATA": "D", "#REQUIRED": "r", "#IMPLIED": "r", "#FIXED": "f"}
    PUBLIC_ID = re.compile(r"[ \r\na-zA-Z0-9'()+,./:=?;!*#@$_%-]*")
    #: A literal that may be a public identifier, an attribute value, an entity value: one kind for each combination.
    LITERALS = {(pub, att, ent): chr(0xE0 + 4 * pub + 2 * att + ent) for pub in (False, True) for att in (False, True) for ent in (False, True)}
    REFERENCES = re.compile(rf"&(?:{NAME}|\#[0-9]+|\#x[0-9a-fA-F]+);")

    @classmethod
    def kind(cls, m: re.Match) -> str:
        k, t = m.lastgroup, m[0]
        if k == "word":
            return cls.WORDS.get(t, "w")
        if k == "hash":
            return cls.HASHES.get(t, BAD)
        if k == "sign":
            return t
        if k == "text":
            inner = t[1:-1]
            plain = "&" not in cls.REFERENCES.sub("", inner)
            return cls.LITERALS[bool(cls.PUBLIC_ID.fullmatch(inner)), plain and "<" not in inner, plain and "%" not in inner]
        return BAD if k == "bad" else k

    @classmethod
    def of(cls, flag: int) -> str:
        return "".join(k for f, k in cls.LITERALS.items() if f[flag])

    @classmethod
    def end(cls, text: str, at: int) -> int:
        """Where the declaration that begins at ``at`` ends, or the end of the text."""
        depth = 0
        for m in cls.TOKEN.finditer(text, at):
            t = m[0] if m.lastgroup == "sign" else ""
            depth += (t == "[") - (t == "]")
            if t == ">" and depth <= 0:
                return m.end()
        return len(text)


class Xml:
    """One well-formed XML 1.0 document."""

    TOKEN = re.compile(
        rf"(?P<X><\?xml{_S}+version{_S}*={_S}*(?:\"1\.[0-9]+\"|'1\.[0-9]+')(?:{_S}+encoding{_S}*={_S}*(?:\"[A-Za-z][A-Za-z0-9._-]*\"|'[A-Za-z][A-Za-z0-9._-]*'))?(?:{_S}+standalone{_S}*={_S}*(?:\"(?:yes|no)\"|'(?:yes|no)'))?{_S}*\?>)"
        rf"|(?P<H>{_COMMENT})|(?P<C><!\[CDATA\[(?:(?!\]\]>).)*\]\]>)|(?P<P>{_PI})"
        rf"|(?P<D><!DOCTYPE)"
        rf"|(?P<E></{NAME}{_S}*>)|(?P<M><{NAME}(?:{_S}+{_ATT})*{_S}*/>)|(?P<S><{NAME}(?:{_S}+{_ATT})*{_S}*>)"
        rf"|(?P<R>&(?:{NAME}|\#[0-9]+|\#x[0-9a-fA-F]+);)|(?P<W>{_S}+(?=<|$))|(?P<T>[^<&]+)|(?P<bad>.)",
        re.DOTALL,
    )
    ILLEGAL = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
    NAMES = re.compile(NAME)
    ATTRIBUTE = re.compile(rf"({NAME}){_S}*={_S}*(\"[^<\"]*\"|'[^<']*')")
    REFERENCE = re.compile(rf"&(?:({NAME})|\#([0-9]+)|\#x([0-9a-fA-F]+));|&")
    #: name, and literal or external identifier, of a general entity
    ENTITY = re.compile(rf"<!ENTITY{_S}+({NAME}){_S}+(?:({_LIT})|((?:SYSTEM|PUBLIC)(?:{_LIT}|[^>\"'])*))")
    OUTSIDE = re.compile(rf"<!--.*?-->|<\?.*?\?>|{_LIT}|(?P<pe>%{NAME};)", re.DOTALL)
    _state: dict = {"tokens": [], "open": []}

    @classmethod
    def _reset(cls, p: int) -> int:
        cls._state["open"] = []
        return p

    @classmethod
    def _opened(cls, p: int) -> int:
        cls._state["open"].append(cls.NAMES.match(cls._state["tokens"][p - 1], 1)[0])
        return p

    @classmethod
    def _closes(cls, p: int) -> int:
        at = cls._state["tokens"]
        return p if p < len(at) and at[p].startswith("</") and cls.NAMES.match(at[p], 2)[0] == cls._state["open"].pop() else -1

    @classmethod
    def tokens(cls, text: str, entities: dict[str, str | None] | None = None, strict: bool = True, inside: tuple[str, ...] = ()) -> tuple[list[str], str]:
        """Tokens and their kinds; a token that breaks a constraint of its own has the kind BAD. ``entities``: literals of
        the general entities (None: external, ``&unparsed``: with a notation), given for the text of an entity."""
        out, kinds = [], []
        fragment = entities is not None
        known: dict[str, str | None] = entities if entities is not None else {}
        if m := cls.ILLEGAL.search(text):
            text, tail = text[: m.start()], [BAD]
        else:
            tail = []

        def legal(refs: str, attribute: bool) -> bool:
            for r in cls.REFERENCE.finditer(refs):
                if r[1]:
                    if r[1] in ("lt", "gt", "amp", "apos", "quot"):
                        continue
                    if r[1] not in known:
                        if strict:
                            return False
                    elif not cls._fits(r[1], known, strict, inside, attribute):
                        return False
                elif r[2] or r[3]:
                    n = int(r[2]) if r[2] else int(r[3], 16)
                    if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF or cls.ILLEGAL.match(chr(n)):
                        return False
                else:
                    return False
            return True

        at = 0
        while m := cls.TOKEN.match(text, at):
            k, t, at = m.lastgroup, m[0], m.end()
            if k == "D" and not fragment:
                stop = Declarations.end(text, m.start())
                head = list(Declarations.TOKEN.finditer(text, m.start(), stop))
                out += [x[0] for x in head]
                kinds += [Declarations.kind(x) for x in head]
                declared = text[m.start() : stop]
                for name, literal, outside in cls.ENTITY.findall(re.sub(_COMMENT, "", declared)):
                    known.setdefault(name, literal[1:-1] if literal else "&unparsed" if "NDATA" in re.sub(_LIT, "", outside) else None)
                before = declared.split("[")[0]
                strict = not (any(x["pe"] for x in cls.OUTSIDE.finditer(declared)) or "SYSTEM" in before or "PUBLIC" in before)
                at = stop
                continue
            if k in "SM" and "=" in t:
                atts = cls.ATTRIBUTE.findall(t)
                if len({a for a, _ in atts}) < len(atts) or "&" in t and not all(legal(v, True) for _, v in atts):
                    k = BAD
            elif k == "R":
                k = k if legal(t, False) else BAD
            elif k == "T":
                k = BAD if "]]>" in t else k
            elif k == "X" and (m.start() or fragment):
                k = BAD
            elif k in ("bad", "D"):
                k = BAD
            out.append(t)
            kinds.append(k)
        return out + tail, "".join(kinds) + "".join(tail)

    @classmethod
    def _fits(cls, name: str, known: dict[str, str | None], strict: bool, inside: tuple[str, ...], attribute: bool) -> bool:
        """Whether an entity may be referred to: its replacement text does not come back to it, and is well-formed content, or
        free of ``<`` in an attribute."""
        literal = known[name]
        if name in inside or literal == "&unparsed":
            return False
        if literal is None:
            return not attribute
        text = re.sub(r"&#(?:([0-9]+)|x([0-9a-fA-F]+));", lambda r: chr(n) if (n := int(r[1]) if r[1] else int(r[2], 16)) <= 0x10FFFF else "\0", literal)
        if attribute:
            names = [r[1] for r in cls.REFERENCE.finditer(text)]
            return "<" not in text and all(n is None or n in ("lt", "gt", "amp", "apos", "quot") or (cls._fits(n, known, strict, (*inside, name), True) if n in known else not strict) for n in names)
        tokens, kinds = cls.tokens(text, known, strict, (*inside, name))
        cls._state["tokens"] = tokens
        return cls.grammar.failure(kinds, "Replacement") < 0

    @classmethod
    def failure(cls, text: str) -> int:
        """-1 or the furthest failing character."""
        shift = text.startswith("\ufeff")
        text = text[shift:]
        tokens, kinds = cls.tokens(text)
        cls._state["tokens"] = tokens
        n = cls.grammar.failure(kinds)
        return -1 if n < 0 else shift + sum(map(len, tokens[:n]))


_SIGNS = {x: x for x in "[]()|,?*+%>"}
Xml.grammar = Grammar(
    """
Document = @reset DECLARATION? Misc* (Doctype Misc*)? Element Misc* EOF
Replacement = @reset Content* EOF
Misc = HINT / INSTRUCTION / SPACE
Element = EMPTY / START @opened Content* @closes END
Content = Element / CDATA / TEXT / SPACE / REFERENCE / HINT / INSTRUCTION
Doctype <- DOCTYPE SPACE NAME (SPACE External)? SPACE? ('[' Declared* ']' SPACE?)? '>'
External = SYSTEM SPACE LITERAL / PUBLIC SPACE PUBLICID SPACE LITERAL
Declared = ElementType / AttributeList / EntityText / Notation / HINT / INSTRUCTION / PARAMETER / SPACE
ElementType = ELEMENT SPACE NAME SPACE Model SPACE? '>'
Model = NOMODEL / Mixed / Group QUANTITY?
Mixed = '(' SPACE? PCDATA (SPACE? '|' SPACE? NAME)* SPACE? ')' '*' / '(' SPACE? PCDATA SPACE? ')'
Group <- '(' SPACE? Particle ((SPACE? '|' SPACE? Particle)+ / (SPACE? ',' SPACE? Particle)*) SPACE? ')'
Particle <- (NAME / Group) QUANTITY?
AttributeList = ATTLIST SPACE NAME (SPACE NAME SPACE AttributeType SPACE Default)* SPACE? '>'
AttributeType = ATTTYPE / NOTATION SPACE '(' SPACE? NAME (SPACE? '|' SPACE? NAME)* SPACE? ')' / '(' SPACE? TOKEN (SPACE? '|' SPACE? TOKEN)* SPACE? ')'
Default = IMPLIED / (FIXED SPACE)? ATTVALUE
EntityText = ENTITY SPACE ('%' SPACE NAME SPACE (ENTVALUE / External) / NAME SPACE (ENTVALUE / External (SPACE NDATA SPACE NAME)?)) SPACE? '>'
Notation = NOTATIONTYPE SPACE NAME SPACE (External / PUBLIC SPACE PUBLICID) SPACE? '>'
""",
    "Document",
    _SIGNS,
    {
        "DECLARATION": "X", "HINT": "H", "INSTRUCTION": "P", "SPACE": "W", "EMPTY": "M", "START": "S", "END": "E", "CDATA": "C", "TEXT": "T", "REFERENCE": "R",
        "DOCTYPE": "O", "ELEMENT": "l", "ATTLIST": "a", "ENTITY": "e", "NOTATIONTYPE": "o", "PARAMETER": "Z", "NAME": "wypmcNd", "TOKEN": "wypmcNdk", "SYSTEM": "y", "PUBLIC": "p", "NOMODEL": "m", "ATTTYPE": "c", "NOTATION": "N", "NDATA": "d",
        "PCDATA": "D", "IMPLIED": "r", "FIXED": "f", "QUANTITY": "?*+", "LITERAL": "".join(Declarations.LITERALS.values()), "PUBLICID": Declarations.of(0), "ATTVALUE": Declarations.of(1), "ENTVALUE": Declarations.of(2),
    },
    {"reset": Xml._reset, "opened": Xml._opened, "closes": Xml._closes},
)
