"""Bundled grammars of Python, Java and C++ for the table-driven parser.

They cover the whole syntax that files of functions and classes use. Some
rules are wider than the language where only the meaning of a name could
decide, as for an assignment's left side.
"""

PYTHON = r"""
%left 'or'
%left 'and'
%right 'not'
%left '<' '>' '==' '!=' '<=' '>=' 'in' 'is'
%left '|'
%left '^'
%left '&'
%left '<<' '>>'
%left '+' '-'
%left '*' '/' '//' '%' '@'
%right UNARY
%right '**'
%right 'await'
file: stmt*
stmt: simple | compound
simple: smalls NEWLINE | smalls ';' NEWLINE
smalls: small | smalls ';' small
small: rhs | assign | stars AUG rhs | expr ':' expr | expr ':' expr '=' rhs
  | 'pass' | 'break' | 'continue' | 'return' | 'return' stars | 'raise' | 'raise' expr | 'raise' expr 'from' expr
  | 'global' names | 'nonlocal' names | 'del' stars | 'assert' expr | 'assert' expr ',' expr
  | 'import' modules | 'from' origin 'import' '*' | 'from' origin 'import' aliases | 'from' origin 'import' '(' aliases ')' | 'from' origin 'import' '(' aliases ',' ')'
  | TYPE NAME tparams? '=' expr
assign: stars '=' rhs | stars '=' assign
rhs: stars | yield
names: NAME | names ',' NAME
dotted: NAME | dotted '.' NAME
modules: dotted as? | modules ',' dotted as?
as: 'as' NAME
origin: dotted | dots | dots dotted
dots: dot | dots dot
dot: '.' | '...'
aliases: NAME as? | aliases ',' NAME as?
stars: starlist | starlist ','
starlist: star | starlist ',' star
star: expr | '*' test %prec UNARY
yield: 'yield' | 'yield' stars | 'yield' 'from' expr
compound: 'if' expr ':' suite elif* else? | 'while' expr ':' suite else? | for | 'async' for | with | 'async' with
  | 'try' ':' suite except+ else? finally? | 'try' ':' suite finally | def | decorators def | class | decorators class | match
for: 'for' stars_in 'in' stars ':' suite else?
stars_in: target_list | target_list ','
target_list: target | target_list ',' target
target: atomic | '*' atomic
elif: 'elif' expr ':' suite
else: 'else' ':' suite
finally: 'finally' ':' suite
except: 'except' ':' suite | 'except' stars ':' suite | 'except' expr 'as' NAME ':' suite | 'except' '*' expr ':' suite | 'except' '*' expr 'as' NAME ':' suite
with: 'with' items ':' suite
items: item | items ',' item
item: expr | expr 'as' target
decorators: decorator+
decorator: '@' expr NEWLINE
def: 'def' NAME tparams? '(' params? ')' result? ':' suite | 'async' 'def' NAME tparams? '(' params? ')' result? ':' suite
result: '->' stars
class: 'class' NAME tparams? ':' suite | 'class' NAME tparams? '(' args? ')' ':' suite
tparams: '[' tplist ']' | '[' tplist ',' ']'
tplist: tparam | tplist ',' tparam
tparam: NAME | NAME ':' expr | '*' NAME | '**' NAME | NAME '=' expr
params: plist | plist ','
plist: param | plist ',' param
param: NAME | NAME ':' expr | NAME '=' expr | NAME ':' expr '=' expr | '/' | '*' | '*' NAME | '*' NAME ':' star | '**' NAME | '**' NAME ':' expr
lparams: llist | llist ','
llist: lparam | llist ',' lparam
lparam: NAME | NAME '=' expr | '/' | '*' | '*' NAME | '**' NAME
suite: simple | NEWLINE INDENT stmt+ DEDENT
match: MATCH stars ':' NEWLINE INDENT case+ DEDENT
case: CASE patterns guard? ':' suite
guard: GUARD expr
patterns: pattern | patterns ',' pattern | patterns ','
pattern: star | expr 'as' NAME
expr: test | test 'if' test 'else' expr | 'lambda' ':' expr | 'lambda' lparams ':' expr | NAME ':=' expr
test: test 'or' test | test 'and' test | 'not' test | test '<' test | test '>' test | test '==' test | test '!=' test | test '<=' test | test '>=' test
  | test 'in' test | test 'not' 'in' test %prec 'in' | test 'is' test | test 'is' 'not' test %prec 'is'
  | test '|' test | test '^' test | test '&' test | test '<<' test | test '>>' test | test '+' test | test '-' test
  | test '*' test | test '/' test | test '//' test | test '%' test | test '@' test
  | '+' test %prec UNARY | '-' test %prec UNARY | '~' test %prec UNARY | test '**' test | 'await' test | atomic
atomic: NAME | NUMBER | strings | 'None' | 'True' | 'False' | '...' | atomic '.' NAME | atomic '(' args? ')' | atomic '[' subs ']'
  | '(' ')' | '(' rhs ')' | '(' comp ')' | '[' ']' | '[' stars ']' | '[' comp ']' | '{' '}' | '{' stars '}' | '{' comp '}' | '{' pairs '}' | '{' pairs ',' '}' | '{' pair compfor+ '}'
strings: STRING+
comp: star compfor+
compfor: 'for' stars_in 'in' test compif* | 'async' 'for' stars_in 'in' test compif*
compif: 'if' test
pairs: pair | pairs ',' pair
pair: expr ':' expr | '**' expr
args: alist | alist ',' | comp
alist: arg | alist ',' arg
arg: star | NAME '=' expr | '**' expr
subs: sublist | sublist ','
sublist: sub | sublist ',' sub
sub: star | expr? ':' expr? | expr? ':' expr? ':' expr?
"""

JAVA = r"""
%right '=' AUG
%right '->'
%right '?' ':'
%left '||'
%left '&&'
%left '|'
%left '^'
%left '&'
%left '==' '!='
%left '<' '>' '<=' '>=' 'instanceof'
%left '<<' '>>' '>>>'
%left '+' '-'
%left '*' '/' '%'
%right UNARY
%left '++' '--'
%nonassoc 'then'
%nonassoc 'else'
unit: package? import* type* | import* module
package: 'package' qname ';'
import: 'import' qname ';' | 'import' qname '.' '*' ';' | 'import' 'static' qname ';' | 'import' 'static' qname '.' '*' ';'
module: MODULE qname '{' directive* '}' | annotation module
directive: ditem+ ';'
ditem: NAME | 'static' | '.' | ','
type: mod* class | ';'
mod: 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | SEALED | annotation
annotation: '@' qname | '@' qname '(' ')' | '@' qname '(' annovalues ')'
annovalues: annovalue | annovalues ',' annovalue
annovalue: expr | arrayinit | annotation
class: 'class' NAME tparams? extends? implements? permits? body | 'interface' NAME tparams? supers? permits? body
  | 'enum' NAME implements? '{' constants? enumrest? '}' | RECORD NAME tparams? '(' params? ')' implements? body | '@' 'interface' NAME body
extends: 'extends' ref
supers: 'extends' refs
implements: 'implements' refs
permits: PERMITS refs
refs: ref | refs ',' ref
constants: constant | constants ',' constant | constants ','
constant: NAME args? body?
enumrest: ';' member*
tparams: LT tplist GT
tplist: tparam | tplist ',' tparam
tparam: NAME | NAME 'extends' bounds
bounds: ref | bounds '&' ref
body: '{' member* '}'
member: mod* class | mod* method | mod* field | mod* ctor | block | 'static' block | ';'
method: tparams? reftype signature | tparams? 'void' signature
signature: NAME '(' params? ')' dims? throws? block | NAME '(' params? ')' dims? throws? ';' | NAME '(' ')' 'default' annovalue ';'
ctor: tparams? NAME '(' params? ')' throws? block | NAME block
throws: 'throws' refs
field: reftype vars ';'
vars: var | vars ',' var
var: NAME dims? | NAME dims? '=' init
init: expr | arrayinit
arrayinit: '{' '}' | '{' inits '}' | '{' inits ',' '}' | '{' ',' '}'
inits: init | inits ',' init
params: param | params ',' param
param: mod* reftype NAME dims? | mod* reftype '...' NAME | mod* reftype 'this'
ref: qname | qname dims | prim dims
reftype: qname | qname dims | prim | prim dims
prim: 'int' | 'long' | 'double' | 'float' | 'boolean' | 'char' | 'byte' | 'short'
dims: DIM+
qname: part | qname '.' part
part: NAME | NAME LT GT | NAME LT targs GT
targs: targ | targs ',' targ
targ: ref | '?' | '?' 'extends' ref | '?' 'super' ref
block: '{' inner* '}'
inner: local ';' | stmt | localclass
localclass: class | 'final' class | 'abstract' class | 'static' class
local: reftype vars | 'final' reftype vars | annotation reftype vars
stmt: block | ';' | expr ';' | if | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' forinit? ';' expr? ';' exprs? ')' stmt | 'for' '(' reftype NAME ':' expr ')' stmt | 'for' '(' 'final' reftype NAME ':' expr ')' stmt
  | switch | 'try' block catch+ finally? | 'try' block finally | 'try' '(' resources ')' block catch* finally? | 'try' '(' resources ';' ')' block catch* finally?
  | 'return' ';' | 'return' expr ';' | 'throw' expr ';' | 'break' ';' | 'break' NAME ';' | 'continue' ';' | 'continue' NAME ';' | YIELD expr ';'
  | 'synchronized' '(' expr ')' block | 'assert' expr ';' | 'assert' expr ':' expr ';' | NAME ':' stmt
if: 'if' '(' expr ')' stmt %prec 'then' | 'if' '(' expr ')' stmt 'else' stmt
forinit: local | exprs
exprs: expr | exprs ',' expr
group: label+ inner* | rule
label: 'case' cases ':' | 'default' ':'
rule: 'case' cases '->' rulebody | 'default' '->' rulebody
rulebody: expr ';' | block | 'throw' expr ';'
cases: casevalue | cases ',' casevalue
casevalue: expr | reftype NAME | 'default'
catch: 'catch' '(' catchtype NAME ')' block | 'catch' '(' 'final' catchtype NAME ')' block
catchtype: qname | catchtype '|' qname
finally: 'finally' block
resources: resource | resources ';' resource
resource: reftype NAME '=' expr | 'final' reftype NAME '=' expr | expr
args: '(' ')' | '(' exprs ')'
expr: expr '=' expr | expr AUG expr | expr '?' expr ':' expr | expr '||' expr | expr '&&' expr | expr '|' expr | expr '^' expr | expr '&' expr
  | expr '==' expr | expr '!=' expr | expr '<' expr | expr '>' expr | expr '<=' expr | expr '>=' expr | expr 'instanceof' reftype | expr 'instanceof' reftype NAME | expr 'instanceof' 'final' reftype NAME
  | expr '<<' expr | expr '>>' expr | expr '>>>' expr | expr '+' expr | expr '-' expr | expr '*' expr | expr '/' expr | expr '%' expr
  | '+' expr %prec UNARY | '-' expr %prec UNARY | '++' expr %prec UNARY | '--' expr %prec UNARY | castee
  | LAMBDA '->' expr | LAMBDA '->' block | NAME '->' expr | NAME '->' block | switch
switch: 'switch' '(' expr ')' '{' group* '}'
castee: primary | primary '++' | primary '--' | '!' castee | '~' castee | '(' prim ')' expr %prec UNARY | '(' prim dims ')' castee | '(' qname dims ')' castee | '(' expr ')' castee
  | '(' expr ')' LAMBDA '->' expr | '(' expr ')' LAMBDA '->' block
primary: qname | LITERAL | 'this' | 'super' | '(' expr ')' | primary args | primary '[' expr ']' | primary '.' part | primary '.' 'new' part args body? | primary '.' 'this' | primary '.' 'class' | primary '.' 'super'
  | primary '.' LT targs GT NAME | prim '.' 'class' | prim dims '.' 'class' | qname dims '.' 'class' | 'void' '.' 'class'
  | primary '::' NAME | primary '::' 'new' | prim dims '::' 'new' | qname dims '::' 'new'
  | 'new' qname args body? | 'new' qname dims arrayinit | 'new' prim dims arrayinit | 'new' qname sizes dims? | 'new' prim sizes dims?
sizes: size | sizes size
size: '[' expr ']'
"""

CPP = r"""
%left ','
%right '=' AUG 'throw'
%right '?' ':'
%left '||'
%left '&&'
%left '|'
%left '^'
%left '&'
%left '==' '!='
%left '<' '>' '<=' '>=' '<=>'
%left '<<' '>>'
%left '+' '-'
%left '*' '/' '%'
%right UNARY
%left '++' '--'
%left '.' '->' '(' '[' '{'
%nonassoc 'then'
%nonassoc 'else'
unit: top*
top: function | decl ';' | ';' | namespace | template top | 'extern' STRING top | 'extern' STRING '{' top* '}' | using ';' | classdef ';' | classdef declarators ';' | 'typedef' classdef NAME ';'
  | 'typedef' type declarators ';' | enum ';' | 'static_assert' '(' expr ')' ';' | friend
friend: 'friend' decl ';' | 'friend' function | 'friend' 'class' qname ';' | 'friend' 'struct' qname ';'
namespace: 'namespace' qname '{' top* '}' | 'namespace' '{' top* '}' | 'inline' 'namespace' NAME '{' top* '}' | 'namespace' NAME '=' qname ';'
using: 'using' 'namespace' qname | 'using' qname | 'using' NAME '=' type abstract?
template: 'template' LT tparams? GT
tparams: tparam | tparams ',' tparam
tparam: kind NAME? | kind '...' NAME? | kind NAME '=' type | type NAME? | type NAME '=' shift | template kind NAME
kind: 'typename' | 'class'
classdef: quals classhead bases? '{' member* '}'
classhead: 'class' qname | 'struct' qname | 'union' qname | 'class' qname 'final' | 'struct' qname 'final' | 'struct' | 'union'
bases: ':' parent | bases ',' parent
parent: inherit* qname
inherit: access | 'virtual'
access: 'public' | 'private' | 'protected'
member: top | access ':' | special
special: quals qname '(' params? ')' after* ';' | quals '~' NAME '(' ')' after* block | quals '~' NAME '(' ')' after* ';' | quals 'operator' type ptrs '(' ')' after* block | quals 'operator' type ptrs '(' ')' after* ';'
  | quals qname '(' params? ')' after* '=' 'default' ';' | quals qname '(' params? ')' after* '=' 'delete' ';' | quals '~' NAME '(' ')' after* '=' 'default' ';'
inits: ':' memberinit | inits ',' memberinit
memberinit: qname '(' list? ')' | qname braces
enum: 'enum' NAME? enumbase? '{' enumerators? '}' | 'enum' 'class' NAME enumbase? '{' enumerators? '}' | 'enum' 'class' NAME enumbase? | 'enum' 'struct' NAME enumbase? '{' enumerators? '}'
enumbase: ':' type
enumerators: enumerator | enumerators ',' enumerator | enumerators ','
enumerator: NAME | NAME '=' shift
function: type ptrs name '(' params? ')' after* block | type ptrs name '(' params? ')' after* inits block | outside
outside: quals qname '::' '~' NAME '(' ')' after* block | quals qname '(' params? ')' after* inits? block
name: qname | 'operator' op
op: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<=>' | '<<' | '>>' | '&&' | '||' | '&' | '|' | '^' | '!' | '~' | '=' | AUG | '++' | '--' | '->' | '(' ')' | '[' ']' | 'new' | 'delete'
after: 'const' | 'noexcept' | 'noexcept' '(' expr ')' | 'override' | 'final' | '&' | '&&' | '->' type ptrs | 'volatile' | 'throw' '(' ')'
decl: type declarators | type ptrs name '(' params? ')' after* | type ptrs name '(' params? ')' after* '=' LITERAL | type ptrs name '(' params? ')' after* '=' 'default' | type ptrs name '(' params? ')' after* '=' 'delete' | quals classhead | type '[' names ']' '=' shift
names: NAME | names ',' NAME
declarators: declarator | declarators ',' declarator
declarator: ptrs qname sizes? | ptrs qname sizes? '=' init | ptrs qname braces | ptrs '(' '*' NAME ')' '(' params? ')' | ptrs '(' '*' NAME ')' '(' params? ')' '=' init | ptrs qname ':' LITERAL
sizes: size+
size: '[' ']' | '[' expr ']'
init: assign | braces
braces: '{' '}' | '{' items '}' | '{' items ',' '}'
items: item | items ',' item
item: init | '.' NAME '=' init
params: param | params ',' param | params ',' '...' | '...'
param: type abstract? | type ptrs NAME sizes? | type ptrs NAME '=' init | type ptrs '...' NAME? | type ptrs '(' '*' NAME ')' '(' params? ')' | type ptrs '(' '&' NAME ')' sizes
abstract: ptr+ sizes? | sizes | ptr* '(' params? ')' | ptr* '(' '*' ')' '(' params? ')'
ptrs: ptr*
ptr: '*' | '&' | '&&' | '*' 'const'
type: quals base cv*
cv: 'const' | 'volatile'
quals: qual*
qual: 'const' | 'volatile' | 'static' | 'constexpr' | 'consteval' | 'constinit' | 'inline' | 'extern' | 'virtual' | 'explicit' | 'mutable' | 'register' | 'thread_local'
base: builtin+ | qname | 'auto' | 'typename' qname | 'struct' qname | 'class' qname | 'enum' qname | 'decltype' '(' expr ')'
builtin: 'int' | 'long' | 'short' | 'char' | 'bool' | 'float' | 'double' | 'void' | 'unsigned' | 'signed' | 'wchar_t' | 'char8_t' | 'char16_t' | 'char32_t'
qname: part | '::' part | qname '::' part | qname '::' 'template' part
part: NAME | NAME LT GT | NAME LT targs GT
targs: targ | targs ',' targ
targ: type abstract? | type abstract? '...' | LITERAL | '-' LITERAL | 'true' | 'false' | 'sizeof' '(' type ')'
block: '{' stmt* '}'
stmt: block | ';' | expr ';' | local ';' | using ';' | localclass ';' | enum ';' | if | 'while' '(' condition ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' forinit ';' forcondition? ';' expr? ')' stmt | 'for' '(' local ':' init ')' stmt | 'for' '(' expr ':' init ')' stmt
  | 'switch' '(' condition ')' stmt | 'case' shift ':' | 'default' ':' | 'try' block catch+ | 'return' ';' | 'return' expr ';' | 'return' braces ';' | 'break' ';' | 'continue' ';' | 'goto' NAME ';' | NAME ':'
  | 'static_assert' '(' expr ')' ';' | 'co_return' expr? ';' | 'co_yield' expr ';' | 'typedef' type declarators ';'
localclass: classhead bases? '{' member* '}'
if: 'if' '(' condition ')' stmt %prec 'then' | 'if' '(' condition ')' stmt 'else' stmt | 'if' 'constexpr' '(' condition ')' stmt %prec 'then' | 'if' 'constexpr' '(' condition ')' stmt 'else' stmt
forinit: | expr | local
forcondition: expr | local
condition: expr | local | local ';' expr | expr ';' expr
local: localtype localvars | qname namevars | localtype '[' names ']' '=' init | localtype ptr+ '[' names ']' '=' init | localtype '[' names ']' | localtype ptr+ '[' names ']'
namevars: namevar | namevars ',' localvar
namevar: NAME sizes? | NAME sizes? '=' init | NAME braces | NAME '(' list ')' | NAME '(' ')'
localvars: localvar | localvars ',' localvar
localvar: ptrs NAME sizes? | ptrs NAME sizes? '=' init | ptrs NAME braces | ptrs NAME '(' list ')' | ptrs NAME '(' ')' | ptrs '(' '*' NAME ')' '(' params? ')' '=' init
localtype: qual+ base cv* | builtin+ cv* | qname 'const' | 'auto' | 'typename' qname | 'struct' qname | 'decltype' '(' expr ')'
catch: 'catch' '(' param ')' block | 'catch' '(' '...' ')' block
list: init | list ',' init | list '...'
expr: assign | expr ',' assign
assign: shift | shift '=' init | shift AUG init | 'throw' | 'throw' assign
shift: shift '?' expr ':' assign | shift '||' shift | shift '&&' shift | shift '|' shift | shift '^' shift | shift '&' shift | shift '==' shift | shift '!=' shift | shift '<' shift | shift '>' shift | shift '<=' shift | shift '>=' shift | shift '<=>' shift
  | shift '<<' shift | shift '>>' shift | shift '+' shift | shift '-' shift | shift '*' shift | shift '/' shift | shift '%' shift | unary
unary: '+' unary | '-' unary | '!' unary | '~' unary | '*' unary | '&' unary | '&&' unary | '++' unary | '--' unary | 'sizeof' unary | 'sizeof' '(' plain ')' | 'sizeof' '...' '(' NAME ')' | 'delete' unary | 'delete' '[' ']' unary | 'co_await' unary
  | '(' plain ')' unary %prec UNARY | 'new' newtype | 'new' newtype '(' list? ')' | 'new' newtype braces | 'new' newtype sizes | postfix
plain: builtin+ ptrs | 'const' qname ptrs | 'const' builtin+ ptrs
newtype: qname | builtin+ | newtype '*'
postfix: primary | postfix '(' list? ')' | postfix '[' expr ']' | postfix '.' part | postfix '->' part | postfix '.' '~' NAME | postfix '++' | postfix '--' | builtin '(' list? ')' | builtin braces | qname braces | postfix '.' 'template' part
primary: qname | LITERAL | STRING+ | 'this' | 'nullptr' | 'true' | 'false' | '(' expr ')' | '(' '...' shift ')' | lambda | 'typename' qname braces | 'typename' qname '(' list? ')' | 'operator' op
lambda: '[' captures? ']' lambdaparams? 'mutable'? lambdaresult? block
lambdaparams: '(' params? ')' | LT tparams GT '(' params? ')'
lambdaresult: '->' type ptrs
captures: capture | captures ',' capture
capture: '=' | '&' | 'this' | '*' 'this' | NAME | '&' NAME | NAME '=' init | '&' NAME '=' init | NAME '...'
"""
