"""Java 17 compilation units as a parsing-expression grammar over token kinds."""

from __future__ import annotations

import re

from millrace.llm.peg import Grammar

KEYWORDS = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally "
    "float for goto if implements import instanceof int interface long native new package private protected public return short "
    "static strictfp super switch synchronized this throw throws transient try void volatile while true false null _"
).split()
CONTEXTUAL = "var record sealed permits yield non module open requires exports opens uses provides to with transitive".split()
OPERATORS = ">>>= <<= >>= ... -> :: ++ -- && || == != <= >= += -= *= /= &= |= ^= %= << ( ) { } [ ] ; , . @ = < ! ~ ? : + - * / & | ^ % >".split()

KINDS = {o: o for o in OPERATORS if len(o) == 1}
KINDS |= {w: chr(0x100 + k) for k, w in enumerate([*KEYWORDS, *CONTEXTUAL, *(o for o in OPERATORS if len(o) > 1)])}
IDENT, NUMBER, STRING, CHAR, ADJACENT, BAD = "i", "n", "s", "c", "G", "\1"
KINDS["'>'next"] = ADJACENT

_ID = r"[^\W\d]"
TOKEN = re.compile(
    r"""[ \t\n\r\f]+|//[^\n\r]*|/\*.*?\*/"""
    r'''|"""[ \t\f]*(?:\r\n|\r|\n)(?:[^\\"]|\\.|"(?!""))*"""'''
    r"""|"(?:[^"\\\n\r]|\\(?:[btnfrs"'\\]|[0-3]?[0-7]?[0-7]))*"|'(?:[^'\\\n\r]|[\ud800-\udbff][\udc00-\udfff]|\\(?:[btnfrs"'\\]|[0-3]?[0-7]?[0-7]))'"""
    r"""|(?:[^\W\d]|[$])(?:\w|[$])*"""
    r"""|0[xX](?:[0-9A-Fa-f](?:[0-9A-Fa-f_]*[0-9A-Fa-f])?)?\.?(?:[0-9A-Fa-f](?:[0-9A-Fa-f_]*[0-9A-Fa-f])?)?[pP][+-]?[0-9](?:[0-9_]*[0-9])?[fFdD]?"""
    r"""|0[xX][0-9A-Fa-f](?:[0-9A-Fa-f_]*[0-9A-Fa-f])?[lL]?|0[bB][01](?:[01_]*[01])?[lL]?"""
    r"""|(?:[0-9](?:[0-9_]*[0-9])?\.(?:[0-9](?:[0-9_]*[0-9])?)?|\.[0-9](?:[0-9_]*[0-9])?)(?:[eE][+-]?[0-9](?:[0-9_]*[0-9])?)?[fFdD]?"""
    r"""|[0-9](?:[0-9_]*[0-9])?(?:[eE][+-]?[0-9](?:[0-9_]*[0-9])?[fFdD]?|[fFdDlL])?"""
    r"""|>>>=|>>=|>=|>(?=>)|<<=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[(){}\[\];,.@=<>!~?:+\-*/&|^%]|.""",
    re.DOTALL,
)
_OCTAL = re.compile(r"0[0-9_]*[89]")
_TEXT_BLOCK_ESCAPE = re.compile(r"\\(?![btnfrs\"'\\\n\r0-7])")


class _Kinds(dict):
    def __missing__(self, t: str) -> str:
        if len(self) > 400_000:
            self.clear()
        k = self[t] = self._kind(t)
        return k

    @staticmethod
    def _kind(t: str) -> str:
        if t in KINDS:
            return KINDS[t]
        c = t[0]
        if c in " \t\n\r\f" or t[:2] in ("//", "/*") and (t[1] == "/" or len(t) >= 4 and t.endswith("*/")):
            return ""
        if c == "\x1a":
            return ""
        if t.startswith('"""') and len(t) >= 7:
            return BAD if _TEXT_BLOCK_ESCAPE.search(t.replace("\\\\", "")) else STRING
        if c == '"':
            return STRING if len(t) > 1 else BAD
        if c == "'":
            return CHAR if len(t) > 1 else BAD
        if c.isdigit() or c == "." and len(t) > 1:
            return BAD if re.fullmatch(r"0[0-9_]*[89][0-9_]*[lL]?", t) or not c.isascii() else NUMBER
        if c == "_" or c == "$" or c.isalpha() or c.isidentifier():
            return IDENT
        return BAD


_kinds = _Kinds()
_UNICODE = re.compile(r"\\(\\|u+([0-9A-Fa-f]{4}))")


def tokens(text: str) -> list[str]:
    """All tokens, white space and comments included; joined they give the text again."""
    if "\\u" in text:
        text = _UNICODE.sub(lambda m: m[0] if not m[2] else chr(int(m[2], 16)), text)
    out = TOKEN.findall(text)
    if ">" in text:
        for k, t in enumerate(out):
            if t == ">" and k + 1 < len(out) and out[k + 1][0] == ">":
                out[k] = "'>'next"
    return out


def kinds(text: str) -> str:
    """One kind for each token that counts."""
    return "".join(map(_kinds.__getitem__, tokens(text)))


def place(text: str, token: int) -> int:
    """Character at which the counted token begins."""
    at = n = 0
    for t in tokens(text):
        if _kinds[t]:
            if n == token:
                return at
            n += 1
        at += 1 if t == "'>'next" else len(t)
    return at


_ctx = "".join(KINDS[w] for w in CONTEXTUAL)
GRAMMAR = r"""
Unit <- ModuleUnit / ';'* Package? (Import / ';')* TopType* EOF
ModuleUnit <- (Import / ';')* Annotation* 'open'? 'module' QName '{' Directive* '}' EOF
Directive <- 'requires' ('transitive' / 'static')* QName ';' / ('exports' / 'opens') QName ('to' QName (',' QName)*)? ';' / 'uses' QName ';' / 'provides' QName 'with' QName (',' QName)* ';'
Package <- Annotation* 'package' QName ';'
Import ~ 'import' 'static'? Name ('.' Name)* ('.' '*')? ';'
QName <- Name ('.' Name)*
Name = NAME
TopType <- ';' / Modifiers TypeDecl
Modifiers <- Modifier*
Modifier = Annotation / 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !(':' / '->') / 'sealed' &ModNext / 'non' '-' 'sealed'
ModNext = 'public' / 'protected' / 'private' / 'static' / 'abstract' / 'final' / 'strictfp' / 'class' / 'interface' / '@' / 'sealed'
Annotation <- '@' !'interface' QName ('(' AnnotationArgs? ')')?
AnnotationArgs <- Name '=' ElementValue (',' Name '=' ElementValue)* / ElementValue
ElementValue <- Annotation / '{' (ElementValue (',' ElementValue)*)? ','? '}' / Cond
TypeDecl <- ClassDecl / InterfaceDecl / EnumDecl / RecordDecl / AnnotationDecl
ClassDecl <- 'class' TypeName TypeParams? ('extends' Type)? ('implements' TypeList)? ('permits' TypeList)? ClassBody
InterfaceDecl <- 'interface' TypeName TypeParams? ('extends' TypeList)? ('permits' TypeList)? ClassBody
AnnotationDecl <- '@' 'interface' TypeName ClassBody
EnumDecl <- 'enum' TypeName ('implements' TypeList)? '{' (EnumConstant (',' EnumConstant)*)? ','? (';' Member*)? '}'
EnumConstant <- Annotation* Name Args? ClassBody?
RecordDecl <- 'record' TypeName TypeParams? '(' (RecordPart (',' RecordPart)*)? ')' ('implements' TypeList)? '{' RecordMember* '}'
RecordPart <- Annotation* Type (Annotation* '...')? Name
RecordMember <- Modifiers Name Block / Member
TypeName = TYPENAME
TypeList <- Type (',' Type)*
TypeParams <- '<' TypeParam (',' TypeParam)* CLOSE
TypeParam <- Annotation* TypeName ('extends' Type ('&' Type)*)?
ClassBody <- '{' Member* '}'
Member <- ';' / 'static'? Block / FieldDecl / Modifiers MemberRest
FieldDecl ~ Modifiers Type Declarators ';'
MemberRest <- TypeDecl / TypeParams? Annotation* ('void' Name MethodRest / Type Name MethodRest / Name ConstructorRest) / Type Declarators ';'
MethodRest <- Params Dims Throws? (Block / ('default' ElementValue)? ';')
ConstructorRest <- Params Throws? Block
Throws <- 'throws' TypeList
Params ~ '(' (Param (',' Param)*)? ')'
Param <- (Annotation / 'final')* Type (Annotation* '...')? (Name '.')* ('this' / Name Dims)
Dims <- (Annotation* '[' ']')*
Declarators <- Declarator (',' Declarator)*
Declarator <- Name Dims ('=' VarInit)?
VarInit <- ArrayInit / Expr
ArrayInit <- '{' (VarInit (',' VarInit)*)? ','? '}'
Type <- Annotation* (PrimType / ClassType) Dims
PrimType = PRIM
ClassType <- Name TypeArgs? ('.' Annotation* Name TypeArgs?)*
TypeArgs <- '<' TypeArg (',' TypeArg)* CLOSE
TypeArg <- Annotation* '?' (('extends' / 'super') Type)? / Annotation* PrimType &(Annotation* '[') Dims / !(Annotation* PrimType) Type
Block <- '{' BlockStmt* '}'
BlockStmt <- SimpleStmt / LocalType / Stmt
LocalType <- Modifiers (ClassDecl / InterfaceDecl / EnumDecl / RecordDecl)
SimpleStmt ~ !STMTWORD (LocalVar / StmtExpr) ';' / 'return' Expr? ';' / 'throw' Expr ';' / 'break' Name? ';' / 'continue' Name? ';' / 'yield' !('=' / '.' / '(' / '[' / '++' / '--' / INFIX) Expr ';' / 'yield' &('(' / '++' / '--') Expr ';' / 'assert' Expr (':' Expr)? ';'
LocalVar <- ('final' / Annotation)* Type Declarators
StmtExpr <- IncDec Unary / Chain (AssignOp Expr / IncDec) / CallChain
IncDec = '++' / '--'
CallChain <- CallBase (Suffix* CallSuffix)? / Base (NonCall* CallSuffix)+
CallBase <- ('this' / 'super') Args / 'new' Creator
NonCall = Suffix &('.' / '[' / '::') !CallSuffixEnd
CallSuffixEnd = @never
CallSuffix <- '.' TypeArgs? Name Args / '.' 'new' Creator / '.' 'super' Args
Stmt <- Block / SimpleOne / ';' / 'if' ParExpr Stmt ('else' Stmt)? / 'for' ForHead Stmt / 'while' ParExpr Stmt / 'do' Stmt 'while' ParExpr ';' / 'switch' ParExpr SwitchBody / 'synchronized' ParExpr Block / Try / Name ':' Stmt
SimpleOne = !(LocalVar ';') SimpleStmt
Try <- 'try' (Resources Block Catch* Finally? / Block (Catch+ Finally? / Finally))
Resources <- '(' Resource (';' Resource)* ';'? ')'
Resource <- ('final' / Annotation)* Type Name '=' Expr / Chain
Catch <- 'catch' '(' ('final' / Annotation)* Type ('|' Type)* Name ')' Block
Finally <- 'finally' Block
ParExpr ~ '(' Expr ')'
ForHead <- '(' (('final' / Annotation)* Type Name ':' Expr / (LocalVar / StmtExpr (',' StmtExpr)*)? ';' Expr? ';' (StmtExpr (',' StmtExpr)*)?) ')'
SwitchBody <- '{' SwitchRule+ '}' / '{' SwitchGroup* '}'
SwitchRule <- Label '->' (Block / 'throw' Expr ';' / Expr ';')
SwitchGroup <- Label ':' BlockStmt*
Label ~ 'case' Cond (',' Cond)* / 'default'
Expr <- Lambda / Cond (AssignOp Expr)?
AssignOp = '=' / '+=' / '-=' / '*=' / '/=' / '&=' / '|=' / '^=' / '%=' / '<<=' / '>>=' / '>>>='
Lambda <- LambdaHead '->' (Block / Expr)
LambdaHead <- Name &'->' / '(' (Name (',' Name)*)? ')' &'->' / Params &'->'
Cond <- Infix ('?' Expr ':' (Lambda / Cond))?
Infix <- Unary (InfixOp Unary / 'instanceof' (('final' / Annotation)+ Type Name / Type Name?))*
InfixOp = '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<<' / '<=' / '<' / '>=' / 'GG' 'GG' '>' / 'GG' '>' / '>' / '+' / '-' / '*' / '/' / '%'
Unary <- ('+' / '-' / '++' / '--' / '!' / '~') Unary / Cast / Postfix
UnaryNotPM <- ('!' / '~') Unary / Cast / Postfix
Cast <- '(' Annotation* (PrimType Dims &')' ')' Unary / Type ('&' Type)* ')' (Lambda / UnaryNotPM))
Postfix <- Chain IncDec*
Chain <- Base Suffix*
Base <- LITERAL / 'this' Args? / 'super' (Args / '.' TypeArgs? Name Args? / MethodRef) / 'new' Creator / 'switch' ParExpr SwitchBody / PrimType ('[' ']')* ('.' 'class' / MethodRef) / 'void' '.' 'class' / Name Args? / '(' Expr ')' / Annotation+ Type MethodRef
Suffix <- '.' (Name Args? / 'this' / 'class' / 'new' Creator / 'super' (Args / '.' TypeArgs? Name Args? / MethodRef) / TypeArgs (Name / 'super') Args) / '[' Expr ']' / ('[' ']')+ ('.' 'class' / MethodRef) / MethodRef / TypeArgs ('.' Name TypeArgs?)* Dims MethodRef
MethodRef <- '::' TypeArgs? (Name / 'new')
Args <- '(' (Expr (',' Expr)*)? ')'
Creator <- TypeArgs? Annotation* (PrimType ArrayRest / CreatedType (ArrayRest / Args ClassBody?))
CreatedType <- Name (TypeArgs / '<' CLOSE)? ('.' Annotation* Name (TypeArgs / '<' CLOSE)?)*
ArrayRest <- ('[' ']')+ ArrayInit / (Annotation* '[' Expr ']')+ (Annotation* '[' ']')*
"""
# A chain is a call if its last suffix is one: walk it suffix by suffix.
GRAMMAR = GRAMMAR.replace(
    """CallChain <- CallBase (Suffix* CallSuffix)? / Base (NonCall* CallSuffix)+
CallBase <- ('this' / 'super') Args / 'new' Creator
NonCall = Suffix &('.' / '[' / '::') !CallSuffixEnd
CallSuffixEnd = @never
""",
    """CallChain <- (CallBase / Base CallTail) CallTail*
CallTail <- PlainSuffix* CallSuffix
PlainSuffix = !CallSuffix Suffix
CallBase <- ('this' / 'super') Args / 'super' '.' TypeArgs? Name Args / 'new' Creator / Name Args
""",
)

KINDS["GG"] = ADJACENT
_names = IDENT + _ctx
_no_type = "".join(KINDS[w] for w in ("var", "record", "sealed", "permits", "yield"))
CLASSES = {
    "NAME": _names,
    "TYPENAME": "".join(c for c in _names if c not in _no_type),
    "CLOSE": ">" + ADJACENT,
    "PRIM": "".join(KINDS[w] for w in "boolean byte char short int long float double".split()),
    "LITERAL": NUMBER + STRING + CHAR + "".join(KINDS[w] for w in ("true", "false", "null")),
    "STMTWORD": "".join(KINDS[w] for w in "return throw break continue assert if for while do try switch".split()),
    "INFIX": "".join(KINDS[w] for w in "|| && | ^ & == != << <= < >= > + - * / % ? : ; ) , ]".split()),
}

grammar = Grammar(GRAMMAR, "Unit", KINDS, CLASSES)
