"""Generalised LL recognition of JavaScript and TypeScript over bracket trees.

Tokens are grouped by their brackets first; equal groups get one number, so a
shape that occurs again is never parsed again.  A grammar terminal such as
``{SL}`` stands for a brace group whose content derives from ``SL``; content is
recognised on demand by a GLL recogniser (descriptors, graph-structured stack
of (nonterminal, position, dialects) nodes) and remembered.

All dialect grammars run together: descriptors carry the set of dialects that
still accept what was read, and alternatives narrow that set.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from skein.functions import jslex

#: Dialects.
SCRIPT, MODULE, TYPED = 1, 2, 4
#: Context of a statement: in a function, async, generator, top level of a file, outside any function.
FUNC, ASYNC, GEN, TOP, OUTSIDE = 1, 2, 4, 8, 16

# Fixed values of the language: keywords, contextual keywords and punctuators.
RESERVED = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
CONTEXTUAL = "async await yield let static get set of as from type interface namespace module declare abstract readonly public private protected override accessor implements keyof unique infer is asserts satisfies global target meta".split()
PUNCT = ["...", "=>", "===", "!==", "==", "!=", "**=", "**", "++", "--", "<<=", "<<", "<=", ">=", "&&=", "&&", "||=", "||", "??=", "??", "?.", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "+", "-", "*", "/", "%", "&", "|", "^", "!", "~", "?", ":", ";", ",", ".", "=", "<", ">", "@"]

NAMES = ["BAD", "NL", "id", "num", "str", "regex", "#id", "oct", *RESERVED, *CONTEXTUAL, *PUNCT]
CODE = {name: i for i, name in enumerate(NAMES)}
BAD, NL, ID, NUM, STR, RX, PRIVATE, OCTAL = range(8)
OPEN = {"{": 1, "(": 2, "[": 3, jslex.TPL: 4, jslex.SUB: 5, jslex.BOX: 6, jslex.ELEM: 7}
CLOSE = {"}": 1, ")": 2, "]": 3, jslex.TPL_END: 4, jslex.SUB_END: 5, jslex.BOX_END: 6, jslex.ELEM_END: 7}
#: Codes of brackets as tokens and, above BASE, of groups.
OPEN_AT, CLOSE_AT, BASE = 300, 400, 1000

_TOKEN = re.compile(
    r"\n\s*|(?:[^\W\d]|[$#]|\\u)(?:[\w$‌‍]|\\u)*|[{}()\[\];,:~@\x01-\x08\x0e]|\"\"|\.\.\.|\.(?!\d)"
    r"|0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?"
    r"|=>|[=!]==?|=|!|\?\.(?!\d)|\?\?=?|\?|&&?=?|\|\|?=?|\*\*?=?|\+[+=]?|-[-=]?|<<?=?|>=?|[/%^]=?|\S"
)


class _Codes(dict):
    """Token text to its code; forgets everything when it grows beyond its bound."""

    def __missing__(self, token: str) -> int:
        c = token[0]
        if c == "\n":
            code = NL
        elif c == "#":
            code = PRIVATE if len(token) > 1 else BAD
        elif c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit():
            code = OCTAL if re.fullmatch(r"0\d[\d_]*", token) else BAD if re.search(r"__|_$|_n$|^0[xX]n?$", token) else NUM
        elif c.isalpha() or c in "_$\\" or c.isidentifier():
            code = ID
        else:
            code = BAD
        if len(self) > 200_000:
            self.clear()
            self.update(_FIXED)
        self[token] = code
        return code


_FIXED = {t: CODE[t] for t in (*RESERVED, *CONTEXTUAL, *PUNCT)} | {t: OPEN_AT + k for t, k in OPEN.items()} | {t: CLOSE_AT + k for t, k in CLOSE.items()} | {'""': STR, jslex.REGEX: RX, jslex.BAD: BAD}
_codes = _Codes(_FIXED)

# One line a nonterminal, alternatives between bars. Marks before one: !ts only typed, !js only untyped, !script, !strict, !top, !fn, !async, !gen.
# Groups: {X} (X) [X] `X` <X> (an element), $X$ a substitution, %X% a container; after a slash the context of a body.
# Conditions: asi, more, NoDecl, NoBrace, Fat and Colon (what follows the group ahead), Fat2, Colon2 (after a word), Eq, Assignable and NoUnary (what stands before).
GRAMMAR = r"""
File: SL
SL: | Item SL
Item: Stmt | Decl | TsDecl | !top Import | !top Export
Stmt: {SL} | ; | NoDecl Expr asi | If | Loop | Jump | Try | 'switch ( Expr ) { Cases }' | Label : Branch | !script with (Expr) Stmt | debugger asi
Branch: Stmt | !script Func
If: if (Expr) Branch | if (Expr) Branch else Branch
Loop: for (ForHead) Stmt | !async for await (ForHead) Stmt | while (Expr) Stmt | do Stmt while (Expr) semi
Jump: !fn return asi | !fn return Expr asi | throw Expr asi | break asi | continue asi | break Id asi | continue Id asi
Try: try {SL} catch Catch | try {SL} finally {SL} | try {SL} catch Catch finally {SL}
Catch: {SL} | (CatchParam) {SL}
CatchParam: Target | !ts Target TypeAnn
Cases: | case Expr : SL Cases | default : SL Cases
Label: Id
semi: ; | asi | more
Decl: const Consts asi | let Lets asi | var Lets asi | Func | Class | Decorators Class
Consts: ConstOne | ConstOne , Consts
ConstOne: Target = Asg | !ts Target TypeAnn = Asg
Lets: LetOne | LetOne , Lets
LetOne: Id | Id = Asg | Pattern = Asg | !ts Id TypeAnn | !ts Id ! TypeAnn | !ts Id TypeAnn = Asg | !ts Pattern TypeAnn = Asg
Target: Id | Pattern
Pattern: {ObjPat} | [ArrPat]
ObjPat: | ObjPatOne | ObjPatOne , ObjPat
ObjPatOne: Id | Id = Asg | PropName : Elem | ... Target
Elem: Target | Target = Asg
ArrPat: | Elem | ... Target | Elem , ArrPat | , ArrPat
ForHead: ForInit ; ExprOpt ; ExprOpt | VarWord Target of Asg | VarWord Target in Expr | Lhs of Asg | Lhs in Expr | AsgPattern of Asg | AsgPattern in Expr | !script var Id = Asg in Expr
ForInit: | Expr | const Consts | let Lets | var Lets
VarWord: const | let | var
ExprOpt: | Expr
Func: function Id Sig {SL/F} | function * Id Sig {SL/FG} | async function Id Sig {SL/FA} | async function * Id Sig {SL/FAG} | !ts function Id Sig asi | !ts async function Id Sig asi
FuncExpr: Func | function Sig {SL/F} | function * Sig {SL/FG} | async function Sig {SL/FA} | async function * Sig {SL/FAG}
Sig: (Params) | !ts (Params) RetType | !ts TypeParams (Params) | !ts TypeParams (Params) RetType
RetType: : Type
Params: | Param | Param , Params | ... Target | !ts ... Target TypeAnn | !ts this TypeAnn | !ts this TypeAnn , Params
Param: Elem | !ts Target TypeAnn | !ts Target TypeAnn = Asg | !ts Id ? | !ts Id ? TypeAnn | !ts Pattern ? TypeAnn | !ts ParamMod Param | Decorators Param
ParamMod: public | private | protected | readonly | override
Class: class Id ClassRest | !ts abstract class Id ClassRest
ClassRest: Heritage {ClassBody} | !ts TypeParams Heritage {ClassBody}
Heritage: | extends Postfix | !ts extends Postfix TypeArgs | !ts implements Types | !ts extends Postfix implements Types | !ts extends Postfix TypeArgs implements Types
ClassBody: | ; ClassBody | Member ClassBody | Decorators Member ClassBody
Member: Mods PropName Method | Mods async PropName MethodA | Mods async * PropName MethodA | Mods * PropName MethodG | Mods get PropName GetM | Mods set PropName SetM | Mods PropName asi | Mods PropName = Asg asi | static {SL} | !ts Mods PropName OptMark asi | !ts Mods PropName OptMark = Asg asi | !ts Mods PropName OptMark TypeAnn asi | !ts Mods PropName OptMark TypeAnn = Asg asi | !ts Mods [IndexSig] TypeAnn asi | !ts Mods PropName ? Method
OptMark: | ? | !
Mods: | static Mods | !ts TsMod Mods
TsMod: public | private | protected | readonly | abstract | override | declare | accessor
Accessor: get | set
GetM: (None) {SL/F} | !ts (None) RetType {SL/F} | !ts (None) asi | !ts (None) RetType asi
SetM: (One) {SL/F} | !ts (One) asi
None: | !ts this TypeAnn
One: Param | Param ,
Method: Sig {SL/F} | !ts Sig asi
MethodA: Sig {SL/FAG} | !ts Sig asi
MethodG: Sig {SL/FG}
PropName: Name | str | num | [Asg] | #id
Name: Id | Word
Import: import str asi | import From asi | !ts import type From asi | !ts import Id = Expr asi | !ts import Expr asi | import str Attrs asi | import From Attrs asi
From: Id from str | {Specs} from str | * as Id from str | Id , {Specs} from str | Id , * as Id from str
Attrs: with {ObjLit}
Specs: | Spec | Spec , Specs
Spec: Name | Name as Name | str as Name | !ts type Name | !ts type Name as Name
Export: !strict export {Specs} asi | !strict export {Specs} from str asi | !strict export * from str asi | !strict export * as Name from str asi | !strict export default Func | !strict export default Class | !strict export default FuncExpr | !strict export default class ClassRest | !strict export default NoDecl Asg asi | !strict export default {ObjLit} asi | !strict export default {ObjLit} BinT asi | !strict export Decl | !ts export TsDecl | !ts export type {Specs} asi | !ts export type {Specs} from str asi | !ts export type * from str asi | !ts export = Expr asi | !ts export default TsDecl | !ts export default abstract class ClassRest | !ts export as namespace Id asi | !strict Decorators export Class | !strict Decorators export default Class
TsDecl: !ts interface Id {TypeBody} | !ts interface Id TypeParams {TypeBody} | !ts interface Id extends Types {TypeBody} | !ts interface Id TypeParams extends Types {TypeBody} | !ts type Id = Type asi | !ts type Id TypeParams = Type asi | !ts enum Id {EnumBody} | !ts const enum Id {EnumBody} | !ts declare DeclareOne | !ts namespace Dotted {SL/T} | !ts module Dotted {SL/T} | !ts module str {SL/T}
DeclareOne: TsDecl | Class | Func | let Lets asi | var Lets asi | const Lets asi | global {SL/T} | module str {SL/T} | module str asi
Dotted: Id | Id . Dotted
EnumBody: | EnumOne | EnumOne , EnumBody
EnumOne: PropName | PropName = Asg
Expr: Asg | Asg , Expr
Asg: Unary BinT | Postfix Assignable AsgOp Asg | Eq AsgPattern = Asg | Arrow | !gen yield | !gen yield Asg | !gen yield * Asg
BinT: | BinOp Unary BinT | NoUnary ** Unary BinT | OrOp Unary OrT | ?? Unary CoT | Choice | !ts as Type BinT | !ts satisfies Type BinT
OrT: | BinOp Unary OrT | NoUnary ** Unary OrT | OrOp Unary OrT | Choice | !ts as Type OrT | !ts satisfies Type OrT
CoT: | BinOp Unary CoT | NoUnary ** Unary CoT | ?? Unary CoT | Choice | !ts as Type CoT | !ts satisfies Type CoT
Choice: ? Asg : Asg
OrOp: '||' | &&
BinOp: + | - | * | / | % | == | != | === | !== | < | > | <= | >= | > > | > > > | << | & | '|' | ^ | in | instanceof
Lhs: Postfix Assignable
AsgPattern: {AObj} | [AArr]
AObj: | AObjOne | AObjOne , AObj
AObjOne: Id | Id = Asg | PropName : AElem | ... Lhs
AElem: Lhs | Lhs = Asg | AsgPattern | AsgPattern = Asg
AArr: | AElem | ... Lhs | ... AsgPattern | AElem , AArr | , AArr
AsgOp: = | += | -= | *= | /= | %= | **= | <<= | > >= | > > >= | &= | '|=' | ^= | &&= | '||=' | ??=
Unary: Postfix | #id in Unary | Postfix ++ | Postfix -- | UnOp Unary | !async await Unary | !ts < Type > Unary
UnOp: ! | ~ | + | - | ++ | -- | typeof | void | delete
Postfix: Primary Suf
Suf: | . Member1 Suf | ?. Member1 Suf | ?. Call Suf | ?. [Expr] Suf | Call Suf | [Expr] Suf | `Tpl` Suf | !ts ! Suf | !ts TypeArgs Call Suf | !ts TypeArgs `Tpl` Suf
Member1: Name | #id
Call: (Args)
Args: | Arg | Arg , Args
Arg: Asg | ... Asg
Primary: Id | Literal | [ArrLit] | {ObjLit} | (Expr) | FuncExpr | class ClassRest | Class | New | import (Args) | !strict import . meta | <Elem1> | super | this | Decorators class ClassRest
Literal: num | str | regex | null | true | false | `Tpl` | !script oct
New: new Primary NewSuf | new . target | !ts new Primary NewSuf TypeArgs
NewSuf: | . Member1 NewSuf | [Expr] NewSuf
ArrLit: | Arg | Arg , ArrLit | , ArrLit
ObjLit: | Prop | Prop , ObjLit
Prop: Id | PropName : Asg | PropName Method | async PropName MethodA | async * PropName MethodA | * PropName MethodG | get PropName GetM | set PropName SetM | ... Asg
Arrow: Id => Body | async Id => BodyA | Fat (Params) => Body | Fat2 async (Params) => BodyA | !ts Colon (Params) RetType => Body | !ts TypeParams (Params) => Body | !ts TypeParams (Params) RetType => Body | !ts Colon2 async (Params) RetType => BodyA | !ts async TypeParams (Params) => BodyA | !ts async TypeParams (Params) RetType => BodyA
Body: {SL/F} | NoBrace Asg
BodyA: {SL/FA} | NoBrace Asg
Tpl: | $Expr$ Tpl
Elem1: | %Box% Elem1 | <Elem1> Elem1
Box: | Expr | ... Asg
Decorators: @ Postfix | @ Postfix Decorators
TypeAnn: : Type
Type: Union | Union extends Union ? Type : Type | FnType
FnType: (Params) => Type | TypeParams (Params) => Type | new (Params) => Type | abstract new (Params) => Type | new TypeParams (Params) => Type
Union: Inter | Inter '|' UnionT | Inter & UnionT | '|' Union | & Union
UnionT: Union | FnType
Inter: TPrim TSuf | TOp Inter | infer Id extends Inter | asserts Id | asserts Id is Type | asserts this is Type | Id is Type | this is Type
TOp: keyof | unique | readonly | infer
TSuf: | [TypeOpt] TSuf
TypeOpt: | Type
TPrim: TName | TName TypeArgs | str | num | - num | `TplT` | {TypeBody} | [Tuple] | (Type) | this | void | null | true | false | typeof TName | typeof TName TypeArgs | import (Type) | import (Type) . TName | typeof import (Type)
TName: Name1 | Name1 . TName
Name1: Id | default
TplT: | $Type$ TplT
Tuple: | TupleOne | TupleOne , Tuple
TupleOne: Type | ... Type | Type ? | Id : Type | Id ? : Type | ... Id : Type
TypeArgs: < Types >
Types: Type | Type , Types
TypeParams: < TParams >
TParams: TParam | TParam , | TParam , TParams
TParam: Id | Id extends Type | Id = Type | Id extends Type = Type | const TParam | in Id | out Id
TypeBody: | TMember TypeBody | sepr TypeBody
TMember: TKey TSep | TKey TypeAnn TSep | TKey ? TSep | TKey ? TypeAnn TSep | TKey Sig TSep | TKey ? Sig TSep | Sig TSep | new Sig TSep | [IndexSig] TypeAnn TSep | readonly [IndexSig] TypeAnn TSep | [Mapped] TypeAnn TSep | [Mapped] ? TypeAnn TSep | readonly [Mapped] TypeAnn TSep | [Mapped] - ? TypeAnn TSep | - readonly [Mapped] TypeAnn TSep | Accessor PropName Sig TSep
TKey: PropName | readonly PropName
TSep: , | asi
sepr: , | ;
IndexSig: Id : Type
Mapped: Id in Type | Id in Type as Type
out: 'of'
""".replace("'switch ( Expr ) { Cases }'", "switch (Expr) {Cases}").replace("out: 'of'\n", "").replace(" | in Id | out Id", "")

TERM, GROUP, NONTERM, PRED, END = range(5)
_SEMI_CODE = CODE[";"]
_GROUPS = {"{": (1, "}"), "(": (2, ")"), "[": (3, "]"), "`": (4, "`"), "$": (5, "$"), "%": (6, "%"), "<": (7, ">")}
_CONTEXTS = {"F": FUNC, "A": ASYNC, "G": GEN, "T": TOP}
#: Content in which line ends part statements or members.
_LINES = {"SL", "ClassBody", "Cases", "TypeBody", "File"}
#: Content that is a list of one nonterminal parted by commas.
_LISTS = {"ArrLit": "Arg", "Args": "Arg", "ObjLit": "Prop"}
_CONDITIONS = frozenset(("asi", "more", "NoDecl", "NoBrace", "Fat", "Colon", "Fat2", "Colon2", "Eq", "Assignable", "NoUnary"))


class Grammar:
    def __init__(self, text: str):
        rules = {}
        for line in text.strip().split("\n"):
            name, _, body = line.partition(":")
            rules[name] = [a.replace("\0", "|").split() for a in body.replace("'||='", "\0\0=").replace("'|='", "\0=").replace("'||'", "\0\0").replace("'|'", "\0").split("|")]
        words = [CODE[w] for w in (*RESERVED,)]
        names = [ID, *(CODE[w] for w in CONTEXTUAL)]
        self.slots: list[tuple] = []
        self.alts: dict[str, list[tuple[int, int, int]]] = {}
        for name, alts in rules.items():
            self.alts[name] = []
            for symbols in alts:
                dialects, need = SCRIPT | MODULE | TYPED, 0
                while symbols and symbols[0] in ("!ts", "!js", "!script", "!strict", "!top", "!fn", "!async", "!gen"):
                    mark = symbols[0]
                    symbols = symbols[1:]
                    dialects &= {"!ts": TYPED, "!js": SCRIPT | MODULE, "!script": SCRIPT, "!strict": MODULE | TYPED}.get(mark, 7)
                    need |= {"!top": TOP, "!fn": FUNC, "!async": ASYNC, "!gen": GEN}.get(mark, 0)
                if name == "Import":
                    dialects &= MODULE | TYPED
                self.alts[name].append((len(self.slots), dialects, need))
                for s in symbols:
                    if s in rules:
                        self.slots.append((NONTERM, s))
                    elif s == "Id":
                        self.slots.append((TERM, frozenset(names)))
                    elif s == "Word":
                        self.slots.append((TERM, frozenset(words)))
                    elif s in _CONDITIONS:
                        self.slots.append((PRED, s))
                    elif len(s) > 1 and s[0] in _GROUPS and s[-1] == _GROUPS[s[0]][1] and s[1:-1].split("/")[0] in rules:
                        inner, _, context = s[1:-1].partition("/")
                        self.slots.append((GROUP, _GROUPS[s[0]][0], inner, sum(_CONTEXTS[c] for c in context)))
                    else:
                        self.slots.append((TERM, frozenset([CODE[s]])))
                self.slots.append((END,))
        self.first: dict[str, set] = {name: set() for name in rules}
        self.nullable: set[str] = set()
        changed = True
        while changed:
            changed = False
            for name, alts in self.alts.items():
                for slot, _, _ in alts:
                    add: set = set()
                    while True:
                        s = self.slots[slot]
                        if s[0] == END:
                            if name not in self.nullable:
                                self.nullable.add(name)
                                changed = True
                            break
                        if s[0] == TERM:
                            add |= s[1]
                            break
                        if s[0] == GROUP:
                            add.add(-s[1])
                            break
                        if s[0] == PRED and s[1] == "asi":
                            add.add(_SEMI_CODE)
                        if s[0] == NONTERM:
                            add |= self.first[s[1]]
                            if s[1] not in self.nullable:
                                break
                        slot += 1
                    if not add <= self.first[name]:
                        self.first[name] |= add
                        changed = True


        self._follow()
        self.select: dict[str, dict[int, list]] = {}
        self.empty: dict[str, list] = {}
        for name, alts in self.alts.items():
            self.select[name], self.empty[name] = {}, []
            firsts = []
            for alt in alts:
                codes, empty = self._first_of(alt[0])
                firsts.append((alt, codes, empty))
                if empty:
                    self.empty[name].append(alt)
            for c in set().union(*(f[1] for f in firsts)):
                self.select[name][c] = [alt for alt, codes, empty in firsts if c in codes or empty]

    def _follow(self) -> None:
        """What can stand after each nonterminal: codes, and whether an end of a statement without a semicolon can (``loose``)."""
        self.follow: dict[str, set] = {name: set() for name in self.alts}
        self.loose: set[str] = set()
        changed = True
        while changed:
            changed = False
            for name, alts in self.alts.items():
                for slot, _, _ in alts:
                    while (s := self.slots[slot])[0] != END:
                        slot += 1
                        if s[0] != NONTERM:
                            continue
                        codes, empty, loose = self._after(slot)
                        if empty:
                            codes = codes | self.follow[name]
                            loose = loose or name in self.loose
                        if not codes <= self.follow[s[1]] or loose and s[1] not in self.loose:
                            self.follow[s[1]] |= codes
                            if loose:
                                self.loose.add(s[1])
                            changed = True

    def _after(self, slot: int) -> tuple[set, bool, bool]:
        """As ``_first_of`` up to an end of a statement, and whether one can come first: what stands behind it needs a line end or a semicolon."""
        codes: set = set()
        while True:
            s = self.slots[slot]
            if s[0] == PRED and s[1] == "asi":
                return codes | {_SEMI_CODE}, False, True
            if s[0] in (TERM, GROUP, END):
                more, empty = self._first_of(slot)
                return codes | more, empty, False
            if s[0] == NONTERM:
                codes |= self.first[s[1]]
                if s[1] not in self.nullable:
                    return codes, False, False
            slot += 1

    def _first_of(self, slot: int) -> tuple[set, bool]:
        """Codes that the symbols from a slot on can begin with, and whether they can be empty."""
        codes: set = set()
        while True:
            s = self.slots[slot]
            if s[0] == END:
                return codes, True
            if s[0] == TERM:
                return codes | s[1], False
            if s[0] == GROUP:
                return codes | {-s[1]}, False
            if s[0] == PRED and s[1] == "asi":
                codes.add(_SEMI_CODE)
            if s[0] == NONTERM:
                codes |= self.first[s[1]]
                if s[1] not in self.nullable:
                    return codes, False
            slot += 1


GRAMMAR_TABLE = Grammar(GRAMMAR)
_DECL_FIRST = frozenset(CODE[x] for x in "function class const var".split())
_AWAIT, _YIELD, _ASYNC, _SEMI, _LET = (CODE[x] for x in ("await", "yield", "async", ";", "let"))
#: Tokens that go on with the statement of the line before, or leave it open.
_GOES_ON = frozenset(CODE[x] for x in (*[p for p in PUNCT if p not in ("++", "--", "!", "~", ";", "@", "...")], "else", "catch", "finally", "instanceof", "in", "as", "satisfies", "while"))
_OPEN_END = frozenset(CODE[x] for x in (*[p for p in PUNCT if p not in ("++", "--", "!", ";")], "else", "do", "try", "new", "typeof", "case", "extends", "const", "let", "var", "export", "default", "function", "class", "import", "from"))


class Recogniser:
    """Numbers bracket groups and remembers which nonterminals their contents derive from.

    ``wanted``: dialects of which any one will do; without it, all that accept a
    text are found.  ``bound``: groups remembered; when it is passed, everything is forgotten between two files.
    """

    def __init__(self, wanted: int = 0, grammar: Grammar = GRAMMAR_TABLE, bound: int = 300_000):
        self.g, self.wanted, self.bound = grammar, wanted, bound
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.kinds: list[int] = []
        self.memo: dict[tuple, int] = {}
        self.chunks: dict[tuple, int] = {}
        self.trees: dict[tuple, list | None] = {}
        self.bearing: dict[tuple, bool] = {}
        self.shapes: dict[tuple, list] = {}

    def tree(self, masked: str) -> tuple | None:
        """Codes of the top level; None if brackets do not match or there is a bad token."""
        masked = spaced(masked)
        tokens = _TOKEN.findall(masked) if len(masked) < 4_000_000 else (m.group() for m in _TOKEN.finditer(masked))  # of a very long text, not all at once
        return self.grouped(list(map(_codes.__getitem__, tokens)), {})

    def grouped(self, codes: list, match: dict) -> tuple | None:
        """As ``tree`` for the codes of all tokens; ``match`` is filled with the closing bracket of each opening one."""
        if BAD in codes:
            return None
        ids, content, kinds = self.ids, self.content, self.kinds
        stack: list[tuple[list, int, int]] = []
        cur: list[int] = []
        last = 0
        for i in [i for i, c in enumerate(codes) if c >= OPEN_AT]:
            if i > last:
                cur.extend(codes[last:i])
            last = i + 1
            c = codes[i]
            if c < CLOSE_AT:
                stack.append((cur, c - OPEN_AT, i))
                cur = []
                continue
            if not stack:
                return None
            before, kind, start = stack.pop()
            match[start] = i
            if kind != c - CLOSE_AT:
                return None
            if kind != 1 and NL in cur:
                cur = [x for x in cur if x != NL]
            key = (kind, *cur)
            number = ids.get(key)
            if number is None:
                number = ids[key] = BASE + len(kinds)
                kinds.append(kind)
                content.append(key[1:])
            cur = before
            cur.append(number)
        cur.extend(codes[last:])
        return None if stack else tuple(cur)

    def derives(self, name: str, group: int, context: int) -> int:
        """Dialects in which the content of the group derives from the nonterminal."""
        key = (name, group, context)
        found = self.memo.get(key)
        if found is None:
            self.memo[key] = 0
            found = self.memo[key] = self.whole(name, self.content[group - BASE], context)
        return found

    def whole(self, name: str, codes: tuple, context: int) -> int:
        if name not in _LINES:
            codes = tuple(c for c in codes if c != NL) if NL in codes else codes
            if name in _LISTS and _COMMA in codes:
                found = self.by_commas(name, codes, context)
                if found == 7 or found & self.wanted or _LESS not in codes:  # commas within type arguments part nothing
                    return found
            return self.run(name, codes, None, context, 7)
        if name in ("SL", "File"):
            found = self.by_lines(codes, context)
            if found == 7 or found & self.wanted or NL not in codes:
                return found
        return self.run(name, *_broken(codes), context, 7)

    def by_commas(self, name: str, codes: tuple, context: int) -> int:
        """As ``whole`` for a list, each part read by itself, so a list takes time in proportion to its length."""
        found, item = 7, _LISTS[name]
        parts = list(_parted(codes))
        for k, (a, b) in enumerate(parts):
            if a == b:
                if name != "ArrLit" and k < len(parts) - 1:
                    return 0
                continue
            found &= self.chunk(item, codes[a:b], context)
            if not found:
                return 0
        return found

    def chunk(self, name: str, part: tuple, context: int) -> int:
        key = (name, context, *part)
        got = self.chunks.get(key)
        if got is None:
            got = self.chunks[key] = self.run(name, part, None, context, 7)
        return got

    def by_lines(self, codes: tuple, context: int) -> int:
        """As ``whole`` for statements, read by lines and semicolons; a part that is no statement by itself gives 0."""
        found = 7
        for part, _ in self.statements(codes):
            found &= self.chunk("SL", part, context)
            if not found:
                return 0
        return found

    def statements(self, codes: tuple) -> list[tuple[tuple, list[tuple[int, int]]]]:
        """Runs of whole statements, as lines and semicolons show them, with the ranges of tokens that they are made of."""
        parts: list[list[tuple[int, int]]] = []
        before, at = _SEMI, 0
        for i in [i for i, c in enumerate(codes) if c == NL or c == _SEMI] + [len(codes)]:
            end = i + 1 if i < len(codes) and codes[i] == _SEMI else i
            if end > at:
                first = codes[at]
                if parts and (first in _GOES_ON or before in _OPEN_END or first >= BASE and before != _SEMI and self.kinds[first - BASE] in (2, 3, 4)):
                    parts[-1].append((at, end))
                else:
                    parts.append([(at, end)])
                before = codes[end - 1]
            at = i + 1
        return [(codes[p[0][0] : p[0][1]] if len(p) == 1 else tuple(c for a, b in p for c in codes[a:b]), p) for p in parts]

    def run(self, start: str, toks, breaks: set | None, context: int, dialects: int, nodes: dict | None = None) -> int:
        """Dialects in which all of ``toks`` derives from ``start``.

        ``nodes``, if given, is filled with the graph-structured stack: for each
        (nonterminal, position, dialects) where it ends.  A nonterminal ends only
        where something follows that can follow it.
        """
        g, slots, kinds = self.g, self.g.slots, self.kinds
        n = len(toks)
        asyncs = n and _ASYNC in toks
        if asyncs:
            context |= ASYNC
        nodes = {} if nodes is None else nodes
        root: tuple[list, dict, str] = ([], {}, "")
        work: list[tuple] = []
        result = 0

        def enter(name: str, i: int, mask: int, back) -> None:
            key = (name, i, mask)
            node = nodes.get(key)
            if node is None:
                node = nodes[key] = ([back], {}, name)
                if i < n:
                    c = toks[i]
                    alts = g.select[name].get(c if c < BASE else -kinds[c - BASE])
                    if alts is None:
                        alts = g.empty[name]
                else:
                    alts = g.empty[name]
                for slot, d, need in alts:
                    m = mask & d
                    if need:
                        if need == ASYNC and context & OUTSIDE and not context & ASYNC:
                            m &= MODULE | TYPED
                        elif need & context != need:
                            continue
                    if m:
                        work.append((slot, node, i, m))
            elif back not in node[0]:
                node[0].append(back)
                for end, m in node[1]:
                    work.append((back[0], back[1], end, m)) if back[1] is not root else done(end, m)

        def done(end: int, m: int) -> None:
            nonlocal result
            if end == n:
                result |= m

        enter(start, 0, dialects, (-1, root))
        while work:
            slot, node, i, mask = work.pop()
            while True:
                s = slots[slot]
                kind = s[0]
                if kind == TERM:
                    if i < n and toks[i] in s[1]:
                        i += 1
                        slot += 1
                        continue
                    break
                if kind == NONTERM:
                    name = s[1]
                    if name not in g.nullable:
                        if i >= n:
                            break
                        c = toks[i]
                        if (c if c < BASE else -kinds[c - BASE]) not in g.first[name]:
                            break
                    elif i >= n or (c := toks[i], (c if c < BASE else -kinds[c - BASE]) not in g.first[name])[1]:
                        slot += 1  # only the empty string can be read here
                        continue
                    enter(name, i, mask, (slot + 1, node))
                    break
                if kind == GROUP:
                    if i < n and toks[i] >= BASE and kinds[toks[i] - BASE] == s[1]:
                        inner = s[3] if s[3] else context & ~TOP
                        mask &= self.derives(s[2], toks[i], inner)
                        if mask:
                            i += 1
                            slot += 1
                            continue
                    break
                if kind == PRED:
                    if s[1] == "asi":
                        if i < n and toks[i] == _SEMI:
                            i += 1
                        elif not (i == n or breaks is not None and i in breaks):
                            break
                    elif not self.holds(s[1], toks, i, n):
                        break
                    slot += 1
                    continue
                if i < n:
                    c = toks[i]
                    if (c if c < BASE else -kinds[c - BASE]) not in g.follow[node[2]] and not (node[2] in g.loose and (c == _SEMI or breaks is not None and i in breaks)):
                        break
                end = (i, mask)
                if end not in node[1]:
                    node[1][end] = 1
                    for back in node[0]:
                        if back[1] is root:
                            done(i, mask)
                        else:
                            work.append((back[0], back[1], i, mask))
                break
        return result

    def holds(self, what: str, toks, i: int, n: int) -> bool:
        """A condition on the tokens around ``i``."""
        if what in _AHEAD:
            step, code = _AHEAD[what]
            return i + step < n and toks[i + step] == code
        if what == "NoBrace" or what == "NoDecl":
            return not (i < n and (toks[i] >= BASE and self.kinds[toks[i] - BASE] == 1 or what == "NoDecl" and toks[i] in _DECL_FIRST))
        if what == "Assignable":
            return self.assignable(toks, i - 1)
        if what == "NoUnary" and toks[i : i + 1] and toks[i] == _POWER:
            at = self.operand_start(toks, i - 1)
            if at > 0 and (toks[at - 1] in _UNARY or toks[at - 1] in _SIGNS and (at < 2 or not self.ends_operand(toks, at - 2))):
                return False
        return True

    def ends_operand(self, toks, i: int) -> bool:
        """Whether an operand can end at the token, as far as it and the one before show."""
        if i < 0:
            return False
        c = toks[i]
        if c >= BASE:
            return self.kinds[c - BASE] != 1 or i > 0 and toks[i - 1] >= BASE
        return c in _OPERAND or c in _WORDS and i > 0 and toks[i - 1] in _DOTS

    def operand_start(self, toks, i: int) -> int:
        """Where the operand with all its members, calls and indexes that ends at the token begins."""
        while i > 0:
            c, before = toks[i], toks[i - 1]
            if before in _DOTS:
                i -= 2
            elif c >= BASE and self.kinds[c - BASE] in (2, 3, 4) and self.ends_operand(toks, i - 1) or c in _UPDATES:
                i -= 1
            else:
                break
        return max(i, 0)

    def assignable(self, toks, i: int) -> bool:
        """Whether a value can be assigned to the operand that ends at the token: a name, a member, or one in parentheses."""
        if i < 0:
            return False
        c = toks[i]
        if c >= BASE:
            kind = self.kinds[c - BASE]
            if kind == 3:
                return self.ends_operand(toks, i - 1) or i > 0 and toks[i - 1] == _CHAIN
            return kind == 2 and not (self.ends_operand(toks, i - 1) or i > 0 and toks[i - 1] == _MORE)
        return c in _ASSIGNED or c == PRIVATE or c == _BANG or c in _WORDS and i > 0 and toks[i - 1] in _DOTS

    # syntax trees ---------------------------------------------------------

    def bears(self, codes, methods: bool) -> bool:
        """Whether a function can be named among the tokens or in a group of them; ``methods``: also one without a word or arrow of its own."""
        head = False
        for c in codes:
            if c >= BASE:
                key = (c, methods)
                found = self.bearing.get(key)
                if found is None:
                    found = self.bearing[key] = self.bears(self.content[c - BASE], methods)
                kind = self.kinds[c - BASE]
                if found or methods and head and kind == 1:
                    return True
                head = head or kind == 2
            elif c in _BEARING:
                return True
            elif c == _COMMA or c == NL:
                head = False
        return False

    def syntax(self, name: str, group: int, context: int, methods: bool = False) -> list | None:
        """Nodes of the syntax tree of a group's content; None if it does not derive from ``name``.

        Statements and list items that bear no function are left out.
        Positions count tokens of the content, line ends included.
        """
        key = (name, group, context, methods)
        if key not in self.trees:
            if len(self.trees) > self.bound:
                self.trees.clear()
            self.trees[key] = self.nodes_of(name, self.content[group - BASE], context, methods) if self.derives(name, group, context) else None
        return self.trees[key]

    def nodes_of(self, name: str, codes: tuple, context: int, methods: bool = False) -> list | None:
        """As ``syntax`` for a sequence of tokens, of a file or known to derive from ``name``."""
        if name in ("SL", "File"):
            parts, dialects = self.statements(codes), 7
            for part, _ in parts:
                dialects &= self.chunk("SL", part, context)
                if not dialects:
                    break
            if dialects:
                found = []
                for part, ranges in parts:
                    if self.bears(part, methods):
                        places = [i for a, b in ranges for i in range(a, b)]
                        found += [_moved(t, places, part) for t in self._tree("SL", part, None, context)]
                return found
        if name == "File" and not self.whole(name, codes, context):
            return None
        places = [i for i, c in enumerate(codes) if c != NL]
        toks, breaks = _broken(codes)
        if name in _LISTS and self.by_commas(name, toks, context):
            found = []
            for a, b in _parted(toks):
                if a < b and self.bears(toks[a:b], methods):
                    found += [_moved(t, places[a:b], toks[a:b]) for t in self._tree(_LISTS[name], toks[a:b], None, context)]
            return found
        return [_moved(t, places, toks) for t in self._tree(name, toks, breaks if name in _LINES else None, context)]

    def _tree(self, start: str, toks: tuple, breaks: set | None, context: int) -> list:
        """Nodes of one derivation of all of ``toks``; equal runs of tokens share them."""
        key = (start, context, *toks) if breaks is None or not breaks else None
        if key is not None and key in self.shapes:
            return self.shapes[key]
        nodes: dict = {}
        self.run(start, toks, breaks, context, 7, nodes)
        found = _Derivation(self, toks, breaks, context | (ASYNC if _ASYNC in toks else 0), nodes).of(start)
        if key is not None:
            if len(self.shapes) > self.bound:
                self.shapes.clear()
            self.shapes[key] = found
        return found

    def accepts(self, text: str, dialects: int, jsx: bool) -> int:
        """Those of ``dialects`` in which the whole text is valid."""
        if len(self.kinds) > self.bound or len(self.chunks) > self.bound:
            self.clear()
        found = self._accepts(text, dialects, jsx)
        if not found and dialects & SCRIPT and not jsx and "<!--" in text:  # scripts may hide comments as HTML does
            found = self._accepts(_HTML_COMMENT.sub("", text), SCRIPT, jsx)
        return found

    def _accepts(self, text: str, dialects: int, jsx: bool) -> int:
        masked, _, ok = jslex.scan(text, jsx)
        if not ok:
            return 0
        top = self.tree(masked)
        if top is None:
            return 0
        return self.whole("File", top, TOP | OUTSIDE) & dialects


_AHEAD = {"Fat": (1, CODE["=>"]), "Fat2": (2, CODE["=>"]), "Colon": (1, CODE[":"]), "Colon2": (2, CODE[":"]), "Eq": (1, CODE["="])}
_COMMA, _LESS, _MORE, _POWER, _BANG, _CHAIN = (CODE[x] for x in (",", "<", ">", "**", "!", "?."))
_DOTS = frozenset((CODE["."], CODE["?."]))
_BEARING = frozenset(CODE[x] for x in ("function", "=>", "class"))
_WORDS = frozenset(CODE[x] for x in RESERVED)
_ASSIGNED = frozenset((ID, *(CODE[x] for x in CONTEXTUAL)))
_OPERAND = _ASSIGNED | {NUM, STR, RX, PRIVATE, OCTAL, *(CODE[x] for x in ("this", "super", "null", "true", "false"))} - {CODE[x] for x in ("await", "yield", "of", "keyof", "as")}
_UNARY = frozenset(CODE[x] for x in ("!", "~", "typeof", "void", "delete", "await"))
_SIGNS, _UPDATES = frozenset((CODE["+"], CODE["-"])), frozenset((CODE["++"], CODE["--"]))
#: Nonterminals that are nodes of the syntax tree; the others give their children to the node around.
NODES = frozenset(("Func", "FuncExpr", "Arrow", "Member", "Prop", "ConstOne", "LetOne", "Decl", "Export", "Class", "ClassRest", "TsDecl", "DeclareOne", "Decorators"))


def spaced(masked: str) -> str:
    """The text with line ends and blanks of one kind, of the same length."""
    return masked.replace("\r\n", " \n").replace("\r", "\n").replace("\ufeff", " ").replace("\xa0", " ")


def _broken(codes: tuple) -> tuple[tuple, set]:
    """Tokens without line ends, and the positions before which lines end."""
    toks, breaks = [], set()
    for c in codes:
        if c == NL:
            breaks.add(len(toks))
        else:
            toks.append(c)
    return tuple(toks), breaks


def _parted(codes: tuple):
    """Ranges between commas."""
    at = 0
    for i, c in enumerate(codes):
        if c == _COMMA:
            yield at, i
            at = i + 1
    yield at, len(codes)


class Node(NamedTuple):
    """A node of the syntax tree: its nonterminal, its first and last token, its children, and for a bracket group (``name`` is the nonterminal of its content) the context of its content."""

    name: str
    first: int
    last: int
    children: tuple = ()
    context: int = -1


def _moved(node: Node, places: list[int], toks) -> Node:
    """The node with its positions among all tokens of the content."""
    return Node(node.name, places[node.first], places[node.last], tuple(_moved(c, places, toks) for c in node.children), node.context)


class _Derivation:
    """One derivation read off the graph that the recogniser left, dialects narrowing as they did there."""

    def __init__(self, recogniser: Recogniser, toks: tuple, breaks: set | None, context: int, nodes: dict):
        self.r, self.toks, self.breaks, self.context, self.nodes = recogniser, toks, breaks, context, nodes
        self.failed: set = set()

    def of(self, start: str) -> list[Node]:
        found = self.part(start, 0, len(self.toks), 7, 0)
        return found[0] if found else []

    def part(self, name: str, i: int, j: int, mask: int, want: int):
        """(nodes, dialects) of ``name`` over tokens i to j, leaving the dialects ``want`` if that is not 0; None if there is no such derivation."""
        key = (name, i, j, mask, want)
        if key in self.failed:
            return None
        g = self.r.g
        if i < len(self.toks):
            alts = g.select[name].get(self.code(i), g.empty[name])
        else:
            alts = g.empty[name]
        for slot, d, need in alts:
            m = mask & d
            if need == ASYNC and self.context & OUTSIDE and not self.context & ASYNC:
                m &= MODULE | TYPED
            elif need & self.context != need:
                continue
            if m:
                got = self.rest(slot, i, j, m, want)
                if got is not None:
                    children, left = got
                    return ([Node(name, i, j - 1, tuple(children))], left) if name in NODES and j > i else (children, left)
        self.failed.add(key)
        return None

    def code(self, i: int) -> int:
        c = self.toks[i]
        return c if c < BASE else -self.r.kinds[c - BASE]

    def rest(self, slot: int, i: int, j: int, mask: int, want: int):
        """As ``part`` for the symbols from a slot on."""
        r, toks, found = self.r, self.toks, []
        while True:
            s = r.g.slots[slot]
            kind = s[0]
            if kind == END:
                return (found, mask) if i == j and (not want or mask == want) else None
            if kind == PRED:
                if s[1] == "asi":
                    if i < j and toks[i] == _SEMI:
                        i += 1
                    elif not (i == len(toks) or self.breaks is not None and i in self.breaks):
                        return None
                elif not r.holds(s[1], toks, i, len(toks)):
                    return None
            elif kind == TERM:
                if i >= j or toks[i] not in s[1]:
                    return None
                i += 1
            elif kind == GROUP:
                if i >= j or self.code(i) != -s[1]:
                    return None
                inner = s[3] if s[3] else self.context & ~TOP
                mask &= r.derives(s[2], toks[i], inner)
                if not mask:
                    return None
                found.append(Node(s[2], i, i, (), inner))
                i += 1
            else:
                name = s[1]
                if name in r.g.nullable and (i >= len(toks) or self.code(i) not in r.g.first[name]):
                    slot += 1
                    continue
                node = self.nodes.get((name, i, mask))
                if node is None:
                    return None
                for end, m in sorted(node[1], reverse=True):
                    if end > j:
                        continue
                    after = self.rest(slot + 1, end, j, m, want)
                    if after is None:
                        continue
                    here = self.part(name, i, end, mask, m)
                    if here is not None:
                        return found + here[0] + after[0], after[1]
                return None
            slot += 1


_HTML_COMMENT = re.compile(r"<!--[^\n\r]*|^[ \t]*-->[^\n\r]*", re.M)
