"""One parsing-expression grammar per language: Python 3, JavaScript module, TypeScript, JSON, TOML."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

from auditloom.llm.syntax.lexers import JS_SOFT, JS_WORDS, PY_WORDS, lex_js, lex_python
from auditloom.llm.syntax.peg import Grammar

PYTHON = r"""
file <- (NEWLINE / stmt)* EOF
stmt <- compound / simple
simple <- small (';' small)* ';'? NEWLINE
small <- 'pass' / 'break' / 'continue' / 'return' starexprs? / 'raise' (expr ('from' expr)?)? / ('global' / 'nonlocal') NAME (',' NAME)*
  / 'del' targets / 'assert' expr (',' expr)? / importing / "type" NAME typeparams? '=' expr / assignment
assignment <- (mtarget / NAME / '(' (mtarget / NAME) ')') (':' expr ('=' rhs)? / augop rhs) / (targets '=')+ rhs / starexprs / yielding
augop <~ '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**='
rhs <~ yielding / starexprs
yielding <- 'yield' ('from' expr / starexprs)?
targets <- startarget (',' startarget)* ','?
startarget <- '*' target / target
target <- mtarget / NAME / '(' targets? ')' / '[' targets? ']'
mtarget <- atom (call* access)+
access <~ '.' NAME / '[' slices ']'
call <~ '(' args? ')'
starexprs <- starexpr (',' starexpr)* ','?
starexpr <~ '*' bitor / expr
starnamed <~ '*' bitor / named
named <- NAME ':=' expr / expr
expr <- lambda / disj ('if' disj 'else' expr)?
lambda <- 'lambda' lparams? ':' expr
disj <- conj ('or' conj)*
conj <~ inv ('and' inv)*
inv <~ 'not'* cmp
cmp <~ bitor (cmpop bitor)*
cmpop <~ '==' / '!=' / '<' / '>' / '<=' / '>=' / 'in' / 'not' 'in' / 'is' 'not'?
bitor <- factor (binop factor)*
binop <~ '+' / '-' / '*' / '/' / '%' / '//' / '|' / '&' / '^' / '<<' / '>>' / '@'
factor <~ ('+' / '-' / '~')* power
power <~ 'await'? primary ('**' factor)?
primary <- atom (access / call)*
atom <- NAME / NUMBER / STRING+ / 'None' / 'True' / 'False' / '...' / paren / list / braces
paren <- '(' (')' / yielding ')' / named compfor ')' / starnamed ',' (starnamed (',' starnamed)* ','?)? ')' / named ')')
list <- '[' (']' / named compfor ']' / starnamed (',' starnamed)* ','? ']')
braces <- '{' ('}' / expr ':' expr compfor '}' / dictitem (',' dictitem)* ','? '}' / named compfor '}' / starnamed (',' starnamed)* ','? '}')
dictitem <- '**' bitor / expr ':' expr
compfor <- ('async'? 'for' targets 'in' disj ('if' disj)*)+
args <- named compfor &')' / posarg (',' posarg)* (',' kwarg)* ','? / kwarg (',' kwarg)* ','?
posarg <- '*' expr / named !'='
kwarg <- NAME '=' expr / '*' expr / '**' expr
slices <- slice (',' slice)* ','?
slice <- expr? ':' expr? (':' expr?)? / '*' bitor / named
params <- (plain (',' (plain / '/'))* (',' preset (',' (preset / '/'))*)? (',' starred)? / preset (',' (preset / '/'))* (',' starred)? / starred) ','?
plain <- NAME (':' expr)? !'='
preset <- NAME (':' expr)? '=' expr
starred <- '*' (NAME (':' starexpr)? / &',' !(',' '**') !(',' ')')) (',' (preset / plain))* (',' '**' NAME (':' expr)?)? / '**' NAME (':' expr)?
lparams <- (lplain (',' (lplain / '/'))* (',' lpreset (',' (lpreset / '/'))*)? (',' lstarred)? / lpreset (',' (lpreset / '/'))* (',' lstarred)? / lstarred) ','?
lplain <- NAME !'='
lpreset <- NAME '=' expr
lstarred <- '*' (NAME / &',') (',' (lpreset / lplain))* (',' '**' NAME)? / '**' NAME
importing <- 'import' dotted ('as' NAME)? (',' dotted ('as' NAME)?)* / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / '(' aliases ','? ')' / aliases)
dotted <~ NAME ('.' NAME)*
aliases <- NAME ('as' NAME)? (',' NAME ('as' NAME)?)*
block <- NEWLINE INDENT stmt+ DEDENT / simple
compound <- 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? / 'while' named ':' block ('else' ':' block)?
  / forstmt / trystmt / withstmt / def / class / 'async' (forstmt / withstmt / def) / ('@' named NEWLINE)+ (class / 'async'? def) / matching
forstmt <- 'for' targets 'in' starexprs ':' block ('else' ':' block)?
trystmt <- 'try' ':' block (('except' (expr ('as' NAME)?)? ':' block)+ / ('except' '*' expr ('as' NAME)? ':' block)+) ('else' ':' block)? ('finally' ':' block)? / 'try' ':' block 'finally' ':' block
withstmt <- 'with' ('(' withitem (',' withitem)* ','? ')' ':' block / withitem (',' withitem)* ':' block)
withitem <- expr ('as' startarget &(',' / ')' / ':'))?
def <- 'def' NAME typeparams? '(' params? ')' ('->' expr)? ':' block
class <- 'class' NAME typeparams? ('(' args? ')')? ':' block
typeparams <- '[' typeparam (',' typeparam)* ','? ']'
typeparam <- ('*' / '**')? NAME (':' expr)? ('=' starexpr)?
matching <- "match" (starnamed ',' (starnamed (',' starnamed)* ','?)? / named) ':' NEWLINE INDENT ("case" patterns ('if' named)? ':' block)+ DEDENT
patterns <- pstar (',' pstar)* ','?
pstar <- '*' NAME / pattern
pattern <- porx ('as' NAME)?
porx <- pclosed ('|' pclosed)*
pclosed <- '-'? NUMBER (('+' / '-') NUMBER)? / STRING+ / 'None' / 'True' / 'False' / NAME ('.' NAME)* ('(' (pkw (',' pkw)* ','?)? ')')?
  / '(' patterns? ')' / '[' patterns? ']' / '{' (pitem (',' pitem)* ','?)? '}'
pkw <- NAME '=' pattern / pattern
pitem <- '**' NAME / pclosed ':' pattern
"""

#: Shared by JavaScript and TypeScript; the rules named ts_* are empty in JavaScript.
ECMASCRIPT = r"""
file <- item* EOF
item <- importing / exporting / ts_item / stmt
eos <~ ';' / &'}' / %nl / &EOF
importing <- 'import' !'(' !'.' (STRING / ts_typeword? importclause "from" STRING / ts_importeq) (("with" / 'with') object)? eos
importclause <- NAME (',' (nsimport / named))? / nsimport / named
nsimport <- '*' "as" NAME
named <- '{' (spec (',' spec)* ','?)? '}'
spec <- ts_typeword? (%word / STRING) ("as" (%word / STRING))?
exporting <- 'export' ('default' (function / class / ts_defaultitem / assign eos) / '*' ("as" (%word / STRING))? "from" STRING eos / ts_typeword? named ("from" STRING)? eos / ts_exporteq / ts_item / var / function / decorator* class)
stmt <- block / var / function / decorator* class / ifstmt / forstmt / 'while' '(' expr ')' stmt / 'do' stmt 'while' '(' expr ')' ';'? / trystmt / switch
  / 'return' (%nonl expr)? eos / 'throw' %nonl expr eos / ('break' / 'continue') (%nonl NAME)? eos / 'debugger' eos / ';' / NAME ':' stmt / !'{' !'function' !'class' expr eos
block <- '{' (ts_item / stmt)* '}'
var <- (('const' !'enum') cbinding (',' cbinding)* / ('var' / "let" &(NAME / '[' / '{')) binding (',' binding)*) eos
binding <- target '!'? ts_ann? ('=' assign)?
cbinding <- target ts_ann? '=' assign
target <- NAME / arrpat / objpat
arrpat <- '[' ','* ((('...' target / target ('=' assign)?) (','+ &(!']')  ('...' target / target ('=' assign)?))*) ','*)? ']'
objpat <- '{' (objprop (',' objprop)* ','?)? '}'
objprop <- '...' NAME / pname ':' target ('=' assign)? / NAME ('=' assign)?
ifstmt <- 'if' '(' expr ')' stmt ('else' stmt)?
forstmt <- 'for' ("await" / 'await')? '(' (forhead ("of" assign / 'in' expr) / (var0 / expr)? ';' expr? ';' expr?) ')' stmt
forhead <- ('var' / 'const' / "let") target ts_ann? / lhs
var0 <- ('var' / 'const' / "let") binding (',' binding)*
trystmt <- 'try' block ('catch' ('(' target ts_ann? ')')? block ('finally' block)? / 'finally' block)
switch <- 'switch' '(' expr ')' '{' (('case' expr / 'default') ':' stmt*)* '}'
function <- ("async" %nonl)? 'function' '*'? NAME? sig (block / ts_eos)
sig <~ ts_params? params ts_ret?
params <- '(' (param (',' param)* (',' rest)? ','? / rest ','?)? ')'
param <- decorator* ts_mods target ts_opt? ts_ann? ('=' assign)? / ts_this
rest <- '...' target ts_ann?
decorator <- '@' ('(' expr ')' / NAME ('.' %word)* args?)
class <- ts_abstract? 'class' NAME? ts_params? ('extends' lhsexpr ts_args?)? ts_impl? '{' member* '}'
member <- ';' / decorator* ts_mods ("static" block / ts_index / method (block / ts_eos) / field eos)
method <- (("get" / "set") pname / ("static")? ("async" %nonl)? '*'? pname / "static" ("get" / "set") pname) ts_opt? sig
field <- ("static")? pname (ts_opt / '!')? ts_ann? ('=' assign)?
pname <- %word / STRING / NUMBER / PRIV / '[' assign ']'
expr <- assign (',' assign)*
assign <- arrow / 'yield' (%nonl '*'? assign)? / lhs assignop assign / cond
assignop <~ '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>' '>' '>'? '=' / '>>>=' / '&=' / '|=' / '^=' / '&&=' / '||=' / '??='
lhs <- primary (calls* access)+ / NAME / arrpat &('=' / "of" / 'in') / objpat &('=' / "of" / 'in') / '(' lhs ')'
arrow <- ("async" %nonl)? (NAME / ts_params? params ts_ret?) %nonl '=>' (block / !'{' assign)
cond <- binary ('?' assign ':' assign)?
binary <- unary (binop unary / ts_cast)*
binop <~ '+' / '-' / '*' / '/' / '%' / '**' / '===' / '!==' / '==' / '!=' / '&&' / '||' / '??' / '<<' / '<=' / '<' / '>' ('=' / '>' '>'?)? / '&' / '|' / '^' / 'instanceof' / 'in'
unary <- ('delete' / 'void' / 'typeof' / '+' / '-' / '~' / '!' / 'await' / '++' / '--')* lhsexpr (%nonl ('++' / '--'))?
lhsexpr <- primary (access / calls)*
access <- '.' (%word / PRIV) / '?.' (%word / PRIV / '[' expr ']') / '[' expr ']' / ts_nonnull
calls <- args / '?.' args / template / ts_args (args / template)
args <- '(' (arg (',' arg)* ','?)? ')'
arg <~ '...'? assign
primary <- 'this' / 'null' / 'true' / 'false' / 'super' / NUMBER / STRING / REGEX / template / array / object / ("async" %nonl)? 'function' '*'? NAME? sig block
  / class / '(' expr ')' / 'new' ('.' NAME / lhsexpr) / 'import' ('.' NAME / args) / PRIV &'in' / NAME
template <- TPL0 / TPLS expr (TPLM expr)* TPLE
array <- '[' ','* (arg (','+ arg)* ','*)? ']'
object <- '{' (prop (',' prop)* ','?)? '}'
prop <- '...' assign / pname ':' assign / method block / NAME
"""

_JS_ONLY = "\n".join(
    f"{r} <~ %never"
    for r in "ts_item ts_typeword ts_importeq ts_defaultitem ts_exporteq ts_ann ts_eos ts_params ts_ret ts_opt ts_this ts_abstract ts_args ts_impl ts_index ts_cast ts_nonnull".split()
) + "\nts_mods <~ ()\n"

_TS_ONLY = r"""
ts_item <- interface / typealias / enum / "declare" %nonl (ts_item / ambientvar / function / class / "global" block) / ("namespace" / "module") %nonl (NAME ('.' NAME)* / STRING) nsblock
ambientvar <- ('var' / 'const' / "let") target ts_ann? (',' target ts_ann?)* eos
nsblock <- '{' item* '}'
interface <- "interface" NAME ts_params? ('extends' type (',' type)*)? objtype
typealias <- "type" NAME ts_params? '=' type eos
enum <- 'const'? 'enum' NAME '{' (pname ('=' assign)? (',' pname ('=' assign)?)* ','?)? '}'
ts_typeword <~ "type" !(',' / "from")
ts_importeq <- NAME '=' ("require" '(' STRING ')' / NAME ('.' NAME)*)
ts_defaultitem <- interface / ts_abstract class
ts_exporteq <- '=' expr eos / "as" "namespace" NAME eos
ts_ann <- ':' type
ts_ret <- ':' ("asserts" (NAME / 'this') ("is" type)? / (NAME / 'this') "is" type / type)
ts_eos <~ eos
ts_params <- '<' ('const' / 'in' / "out")* NAME ('extends' type)? ('=' type)? (',' ('const' / 'in' / "out")* NAME ('extends' type)? ('=' type)?)* ','? '>'
ts_args <- '<' type (',' type)* ','? '>'
ts_opt <~ '?'
ts_this <- 'this' ts_ann
ts_mods <~ (("public" / "private" / "protected" / "readonly" / "override" / "abstract" / "declare" / "accessor") &(%word / STRING / NUMBER / PRIV / '[' / '{' / '*') / "static" &(("readonly" / "override" / "accessor") %word))*
ts_abstract <~ "abstract"
ts_impl <- "implements" type (',' type)*
ts_index <- '[' NAME ':' type ']' ts_ann? eos
ts_cast <- %nonl ("as" / "satisfies") ('const' / type)
ts_nonnull <~ %nonl '!' !'='
type <- "infer" NAME ('extends' uniontype)? / functype / uniontype ('extends' uniontype '?' type ':' type)?
functype <- "abstract"? 'new'? ts_params? params '=>' ("asserts" NAME ("is" type)? / NAME "is" type / type)
uniontype <- '|'? intertype ('|' intertype)*
intertype <- '&'? unarytype ('&' unarytype)*
unarytype <- ("keyof" / "unique" / "readonly" / "infer") unarytype / arraytype
arraytype <- primtype (%nonl '[' type? ']')*
primtype <- '(' type ')' / '-'? NUMBER / STRING / 'true' / 'false' / 'null' / 'void' / 'this' / template_type / 'typeof' ('import' args / NAME) ('.' %word)* ts_args? / 'import' args ('.' %word)* ts_args?
  / tuple / mapped / objtype / NAME ('.' %word)* (%nonl ts_args)?
template_type <- TPL0 / TPLS type (TPLM type)* TPLE
tuple <- '[' (tupitem (',' tupitem)* ','?)? ']'
tupitem <- '...'? (NAME '?'? ':' type / type '?'?)
mapped <- '{' (('+' / '-')? "readonly")? '[' NAME 'in' type ("as" type)? ']' (('+' / '-')? '?')? ts_ann? ';'? '}'
objtype <- '{' (tmember (';' / ',' / %nl / &'}'))* '}'
tmember <- 'new'? ts_params? params ts_ret? / ("readonly")? '[' NAME ':' type ']' ts_ann / ("get" / "set") pname params ts_ret? / "readonly" pname '?'? ts_ann? / pname '?'? (ts_params? params ts_ret? / ts_ann)?
"""

JSON = r"""
file <- ws value ws !~'.'
value <- object / array / string / number / 'true' / 'false' / 'null'
object <- '{' ws (string ws ':' ws value ws (',' ws string ws ':' ws value ws)*)? '}'
array <- '[' ws (value ws (',' ws value ws)*)? ']'
string <~ ~'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
number <~ ~'-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?'
ws <~ ~'[ \t\r\n]*'
"""

TOML = r'''
file <- line (nl line)* !~'.'
line <- sp (tablehead / keyval)? sp comment?
tablehead <- '[[' sp key sp ']]' / '[' sp key sp ']'
keyval <- key sp '=' sp value
key <- keypart (sp '.' sp keypart)*
keypart <- ~'[A-Za-z0-9_-]+' / basic / literal
value <- mlbasic / mlliteral / basic / literal / array / inline / datetime / number / boolean
basic <~ ~'"(?:[^"\\\x00-\x08\x0a-\x1f\x7f]|\\(?:["\\bfnrt]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"'
literal <~ ~'\x27[^\x27\x00-\x08\x0a-\x1f\x7f]*\x27'
mlbasic <~ ~'"""(?:[^"\\\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\\(?:["\\bfnrt]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n\s*)|"{1,2}(?!"))*"{3,5}'
mlliteral <~ ~'\x27\x27\x27(?:[^\x27\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|\x27{1,2}(?!\x27))*\x27{3,5}'
array <- '[' gap (value gap (',' gap value gap)* (',' gap)?)? ']'
inline <- '{' sp (keyval sp (',' sp keyval sp)*)? '}'
datetime <~ ~'\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?' / ~'\d\d:\d\d:\d\d(?:\.\d+)?'
number <~ ~'(?:0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?[0-9])*)(?:\.[0-9](?:_?[0-9])*)?(?:[eE][+-]?[0-9](?:_?[0-9])*)?)(?![A-Za-z0-9_.])'
boolean <~ ~'(?:true|false)(?![A-Za-z0-9_])'
comment <~ ~'#[^\x00-\x08\x0a-\x1f\x7f]*'
gap <- ~'[ \t\r\n]*' (comment ~'[ \t\r\n]*')*
sp <~ ~'[ \t]*'
nl <~ ~'\r?\n'
'''

LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "json": "json", "toml": "toml"}


@lru_cache(None)
def grammar(language: str) -> Grammar:
    if language == "python":
        return Grammar(PYTHON, words=PY_WORDS)
    if language == "javascript":
        return Grammar(ECMASCRIPT + _JS_ONLY, words=JS_WORDS - JS_SOFT)
    if language == "typescript":
        return Grammar(ECMASCRIPT + _TS_ONLY, words=JS_WORDS - JS_SOFT)
    return Grammar(JSON if language == "json" else TOML, chars=True)


_MARKER = re.compile(r"^(?:<{7}|={7}|>{7})(?: |$|\r)", re.M)


def verdict(text: str, language: str) -> tuple[bool | None, int, str]:
    """(valid, furthest failure as character offset or -1, cause). Causes: merge_conflict (a conflict marker
    begins a line at or just before the failure), truncated (the input ends where more is required),
    wrong_language (another of the grammars accepts it whole), syntax. Valid is None, with cause undecided, where
    memory did not suffice: a failure of the parser is no finding about the file."""
    try:
        fail = _parse(text, language)
    except MemoryError:
        return None, -1, "undecided"
    if fail is None:
        return True, -1, ""
    at, unterminated = fail
    lo = max(text.rfind("\n", 0, max(text.rfind("\n", 0, at), 0)), 0)
    if _MARKER.search(text, lo, min(len(text), at + 80)) and _MARKER.search(text):
        return False, at, "merge_conflict"
    for other in LANGUAGES.values():
        if other != language and (language, other) != ("typescript", "javascript") and text.strip():
            try:
                if _accepts(text, other):
                    return False, at, "wrong_language"
            except MemoryError:
                pass
    if unterminated or not text[at:].strip():
        return False, at, "truncated"
    return False, at, "syntax"


FRAMES_PER_CHARACTER = 48  # rules that may be open between two characters of nesting


def _ready(text: str, language: str) -> tuple[Grammar, tuple]:
    """The grammar and what it reads: characters or tokens."""
    # compiled rules call each other as plain Python functions, whose frames are on the heap: the depth of a text is bounded by its
    # length and by memory, by nothing else
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + FRAMES_PER_CHARACTER * len(text)))
    g = grammar(language)
    if g.chars:
        return g, (text[1:] if text[:1] == "\ufeff" else text,)
    return g, (lex_python if language == "python" else lex_js)(text)


def _accepts(text: str, language: str) -> bool:
    g, read = _ready(text, language)
    return g.accepts(*read[:3])


def _parse(text: str, language: str) -> tuple[int, bool] | None:
    g, read = _ready(text, language)
    f = g.parse(*read[:3])
    if f is None:
        return None
    if g.chars:
        return f[0] + len(text) - len(read[0]), False
    T, V, _, P = read
    k = min(f[0], len(T) - 1)
    return P[k], T[k] == "ERR" and V[k] is not None
