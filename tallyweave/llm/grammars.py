"""Grammars of the languages whose files are checked, in the notation of parsing.Grammar.

They are written from the public language references. Operators have no precedence, as nobody
needs the trees; where a restriction isn't about form (what may be assigned to, say), a grammar
takes somewhat more than its language. `ID` is a name, words in quotes are keywords.
"""

from __future__ import annotations

JSON = """
file = value ;
value = STR | NUM | 'true' | 'false' | 'null' | '{' ( pair ( ',' pair )* )? '}' | '[' ( value ( ',' value )* )? ']' ;
pair = STR ':' value ;
"""

PYTHON = """
file = stmt* ;
stmt = line | compound ;
line = small ( ';' small )* ';'? NEWLINE ;
small = expr_stmt | 'pass' | 'break' | 'continue' | 'del' stars | 'return' stars? | 'raise' ( expr ( 'from' expr )? )?
  | 'global' name ( ',' name )* | 'nonlocal' name ( ',' name )* | 'assert' expr ( ',' expr )? | import
  | 'type' name typeparams? '=' expr ;
expr_stmt = stars | stars AUG ( stars | yield ) | stars ':' expr ( '=' ( stars | yield ) )? | stars ( '=' ( stars | yield ) )+ | yield ( '=' ( stars | yield ) )* ;
import = 'import' dotted_as ( ',' dotted_as )* | 'from' ( ( '.' | '...' )+ dotted? | dotted ) 'import' ( '*' | '(' name_as ( ',' name_as )* ','? ')' | name_as ( ',' name_as )* ) ;
dotted = name ( '.' name )* ;
dotted_as = dotted ( 'as' name )? ;
name_as = name ( 'as' name )? ;
name = ID | 'match' | 'case' | 'type' ;

block = line | NEWLINE INDENT stmt+ DEDENT ;
compound = 'if' named ':' block ( 'elif' named ':' block )* else?
  | 'while' named ':' block else?
  | 'async'? 'for' targets 'in' stars ':' block else?
  | 'try' ':' block ( except+ else? ( 'finally' ':' block )? | 'finally' ':' block )
  | 'async'? 'with' ( item ( ',' item )* | '(' item ( ',' item )* ','? ')' ) ':' block
  | decorator* ( 'async'? 'def' name typeparams? '(' params? ')' ( '->' expr )? ':' block | 'class' name typeparams? ( '(' args? ')' )? ':' block )
  | 'match' subject ':' NEWLINE INDENT ( 'case' patterns ( 'if' named )? ':' block )+ DEDENT ;
else = 'else' ':' block ;
except = 'except' '*'? ( expr ( 'as' name )? )? ':' block ;
item = expr ( 'as' target )? ;
decorator = '@' named NEWLINE ;
subject = stars | named ;
typeparams = '[' typeparam ( ',' typeparam )* ','? ']' ;
typeparam = ( '*' | '**' )? name ( ':' expr )? ( '=' expr )? ;
params = param ( ',' param )* ','? ;
param = name ( ':' expr )? ( '=' expr )? | '*' ( name ( ':' '*'? expr )? )? | '**' name ( ':' expr )? | '/' ;
plain = plain_param ( ',' plain_param )* ','? ;
plain_param = name ( '=' expr )? | '*' name? | '**' name | '/' ;

stars = star ( ',' star )* ','? ;
star = named | '*' ors ;
named = expr ( ':=' expr )? ;
expr = ors ( 'if' ors 'else' expr )? | 'lambda' plain? ':' expr ;
ors = unary ( binary unary )* ;
binary = OP | '*' | '**' | '/' | '@' | '|' | '-' | '+' | 'and' | 'or' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
unary = ( 'not' | '-' | '+' | '~' | 'await' )* primary ;
primary = atom trailer* ;
trailer = '(' args? ')' | '[' slice ( ',' slice )* ','? ']' | '.' name ;
atom = name | NUM | STR+ | '...' | 'None' | 'True' | 'False'
  | '(' ( yield | stars | named comp )? ')' | '[' ( stars | star comp )? ']' | '{' ( dict | stars | star comp )? '}' ;
dict = entry ( ',' entry )* ','? | expr ':' expr comp ;
entry = expr ':' expr | '**' ors ;
yield = 'yield' ( 'from' expr | stars )? ;
comp = ( 'async'? 'for' targets 'in' ors ( 'if' cond )* )+ ;
cond = ors ( ':=' expr )? | 'lambda' plain? ':' expr ;
targets = target ( ',' target )* ','? ;
target = '*'? primary ;
args = arg ( ',' arg )* ','? ;
arg = named comp? | name '=' expr | '*' expr | '**' expr ;
slice = named | '*' ors | expr? ':' expr? ( ':' expr? )? ;

patterns = pattern_star ( ',' pattern_star )* ','? ;
pattern_star = pattern | '*' name ;
pattern = closed ( '|' closed )* ( 'as' name )? ;
closed = '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | 'None' | 'True' | 'False' | dotted ( '(' ( pattern_arg ( ',' pattern_arg )* ','? )? ')' )?
  | '(' patterns? ')' | '[' patterns? ']' | '{' ( mapping ( ',' mapping )* ','? )? '}' ;
pattern_arg = pattern | name '=' pattern ;
mapping = closed ':' pattern | '**' name ;
"""

C = """
file = external* ;
external = specs declarator attribute* block | declaration | ';' | 'asm' '(' STR+ ')' ';' ;
declaration = specs ( init ( ',' init )* )? ';' | '_Static_assert' '(' expr ( ',' STR+ )? ')' ';' ;
init = declarator attribute* ( 'asm' '(' STR+ ')' )? ( '=' initializer )? ;
specs = qualifier* ( basic ( basic | qualifier )* | ID qualifier* | tagged qualifier* ) ;
qualifier = 'typedef' | 'extern' | 'static' | 'auto' | 'register' | 'inline' | '_Noreturn' | '_Thread_local' | 'const' | 'volatile' | 'restrict' | attribute
  | '_Alignas' '(' ( typename | expr ) ')' ;
basic = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex' | '_Atomic' | 'typeof' '(' ( typename | expr ) ')' ;
attribute = '__attribute__' '(' '(' ( exprs | 'const' )? ')' ')' ;
tagged = ( 'struct' | 'union' ) attribute* ( ID? '{' member* '}' | ID ) | 'enum' ( ID? '{' enumerators? '}' | ID ) ;
member = specs ( field ( ',' field )* )? ';' | ';' ;
field = declarator attribute* ( ':' expr )? | ':' expr ;
enumerators = enumerator ( ',' enumerator )* ','? ;
enumerator = ID ( '=' expr )? ;
declarator = pointer* direct ;
pointer = '*' ( 'const' | 'volatile' | 'restrict' | '_Atomic' | attribute )* ;
direct = ID | '(' declarator ')' | direct '[' ( 'static' | 'const' | 'restrict' )* ( expr | '*' )? ']' | direct '(' params? ')' ;
abstract = pointer+ | pointer* hanging ;
hanging = '(' abstract ')' | hanging? '[' expr? ']' | hanging? '(' params? ')' ;
params = param ( ',' param )* ( ',' '...' )? | '...' ;
param = specs ( declarator | abstract )? attribute* ;
typename = specs abstract? ;
initializer = expr | '{' ( element ( ',' element )* ','? )? '}' ;
element = ( ( '[' expr ( '...' expr )? ']' | '.' ID )+ '=' )? initializer ;

block = '{' inside* '}' ;
inside = declaration | statement ;
statement = block | exprs? ';' | 'if' '(' exprs ')' statement ( 'else' statement )? | 'while' '(' exprs ')' statement | 'do' statement 'while' '(' exprs ')' ';'
  | 'for' '(' ( declaration | exprs? ';' ) exprs? ';' exprs? ')' statement | 'switch' '(' exprs ')' statement
  | 'case' expr ( '...' expr )? ':' inside? | 'default' ':' inside? | ID ':' inside? | 'goto' ID ';' | 'continue' ';' | 'break' ';' | 'return' exprs? ';'
  | 'asm' ( 'volatile' | 'goto' )* '(' asm ')' ';' ;
asm = STR+ ( ( ':' | '::' ) ( operand ( ',' operand )* )? )* ;
operand = ( '[' ID ']' )? STR+ ( '(' expr ')' )? ;
exprs = expr ( ',' expr )* ;
expr = cast ( binary cast )* ;
binary = OP | '*' | '=' | '&' | '-' | '+' | '?' exprs? ':' ;
cast = '(' typename ')' cast | unary ;
unary = ( '&' | '*' | '+' | '-' | '~' | '!' | '&&' ) cast | ( '++' | '--' ) unary | 'sizeof' unary | ( 'sizeof' | '_Alignof' ) '(' typename ')' | postfix ;
postfix = primary ( '[' exprs ']' | '(' ( argument ( ',' argument )* )? ')' | '.' ID | '->' ID | '++' | '--' )* ;
argument = expr | typename ;
primary = ID | NUM | CHAR | STR ( STR | ID )* | ID STR ( STR | ID )* | '(' exprs ')' | '(' block ')' | '(' typename ')' '{' ( element ( ',' element )* ','? )? '}'
  | '_Generic' '(' expr ( ',' ( typename | 'default' ) ':' expr )+ ')' ;
"""

JAVA = """
file = ( annotation* 'package' qualified ';' )? ( import | ';' )* ( type_decl | ';' )* ;
import = 'import' 'static'? qualified ( '.' '*' )? ';' ;
qualified = name ( '.' name )* ;
name = ID | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'when' | 'module' | 'open' | 'exports' | 'requires' | 'to' | 'with' ;
annotation = '@' qualified ( '(' ( pairs | element_value )? ')' )? ;
pairs = pair ( ',' pair )* ;
pair = name '=' element_value ;
element_value = expr | annotation | '{' ( element_value ( ',' element_value )* )? ','? '}' ;
modifier = annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non-sealed' ;
type_decl = modifier* type_body ;
type_body = 'class' name type_params? ( 'extends' type )? ( 'implements' types )? ( 'permits' types )? class_body
  | 'interface' name type_params? ( 'extends' types )? ( 'permits' types )? class_body
  | 'enum' name ( 'implements' types )? '{' ( constant ( ',' constant )* )? ','? ( ';' member* )? '}'
  | 'record' name type_params? '(' ( formal ( ',' formal )* )? ')' ( 'implements' types )? class_body
  | '@' 'interface' name class_body ;
constant = annotation* name ( '(' exprs? ')' )? class_body? ;
class_body = '{' member* '}' ;
member = ';' | 'static'? block | modifier* ( type_body | method | field ) ;
method = type_params? ( annotation* result )? name '(' ( formal ( ',' formal )* )? ')' dims? ( 'throws' types )? ( block | 'default' element_value ';' | ';' ) | name block ;
result = type | 'void' ;
field = type declarators ';' ;
declarators = declarator ( ',' declarator )* ;
declarator = name dims? ( '=' ( expr | array ) )? ;
formal = ( annotation | 'final' )* type ( annotation* '...' )? ( name dims? | ( name '.' )? 'this' ) ;
type_params = '<' type_param ( ',' type_param )* '>' ;
type_param = annotation* name ( 'extends' type ( '&' type )* )? ;
types = type ( ',' type )* ;
type = annotation* ( PRIM | class_type ) dims? ;
class_type = name type_args? ( '.' annotation* name type_args? )* ;
type_args = '<' ( type_arg ( ',' type_arg )* )? '>' ;
type_arg = type | annotation* '?' ( ( 'extends' | 'super' ) type )? ;
dims = ( annotation* '[' ']' )+ ;

block = '{' statement* '}' ;
local = ( annotation | 'final' )* type declarators ;
statement = block | ';' | local ';' | modifier* type_body | expr ';' | name ':' statement | 'if' '(' expr ')' statement ( 'else' statement )?
  | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | 'for' '(' ( local | exprs )? ';' expr? ';' exprs? ')' statement
  | 'for' '(' ( annotation | 'final' )* type name dims? ':' expr ')' statement
  | switch | 'return' expr? ';' | 'break' name? ';' | 'continue' name? ';' | 'throw' expr ';' | 'yield' expr ';' | 'assert' expr ( ':' expr )? ';'
  | 'synchronized' '(' expr ')' block | 'try' block ( catch+ finally? | finally ) | 'try' '(' resource ( ';' resource )* ';'? ')' block catch* finally? ;
resource = local | expr ;
catch = 'catch' '(' ( annotation | 'final' )* type ( '|' type )* name ')' block ;
finally = 'finally' block ;
switch = 'switch' '(' expr ')' '{' ( group* | rule+ ) '}' ;
group = label ':' statement* ;
rule = label '->' ( expr ';' | block | 'throw' expr ';' ) ;
label = 'case' choice ( ',' choice )* ( 'when' expr )? | 'default' ;
choice = expr | pattern | 'default' ;
pattern = ( annotation | 'final' )* type name | type '(' ( pattern ( ',' pattern )* )? ')' name? ;

exprs = expr ( ',' expr )* ;
expr = unary ( binary unary | 'instanceof' ( type | pattern ) )* ;
binary = OP | '<' | '>' | '>' '>' | '>' '>' '>' | '>=' | '>' '>=' | '>' '>' '>=' | '=' | '&' | '|' | '+' | '-' | '?' expr ':' ;
unary = ( '+' | '-' | '++' | '--' | '!' | '~' ) unary | cast | postfix | lambda | switch ;
cast = '(' type ( '&' type )* ')' unary ;
lambda = lambda_params '->' ( expr | block ) ;
lambda_params = name | '(' ( name ( ',' name )* )? ')' | '(' formal ( ',' formal )* ')' ;
postfix = primary ( '++' | '--' )* ;
primary = name | LIT | 'this' | 'super' | '(' expr ')' | primary '.' name | primary '.' 'this' | primary '.' 'super' | primary '.' type_args ( name | 'super' ) | primary '.' 'class' | PRIM dims? '.' 'class' | 'void' '.' 'class' | class_type dims '.' 'class'
  | primary '[' expr ']' | primary '(' exprs? ')' | ( primary '.' )? new | primary '::' type_args? ( name | 'new' ) | type '::' type_args? ( name | 'new' ) ;
new = 'new' type_args? annotation* ( class_type '(' exprs? ')' class_body? | ( PRIM | class_type ) ( '[' expr ']' )+ dims? | ( PRIM | class_type ) dims array ) ;
array = '{' ( ( expr | array ) ( ',' ( expr | array ) )* )? ','? '}' ;
"""

GO = """
file = 'package' ID ';' ( import ';' )* ( top ( ';' top )* ';'? )? ;
import = 'import' ( spec | '(' ( spec ( ';' spec )* ';'? )? ')' ) ;
spec = ( ID | '.' )? STR ;
top = decl | 'func' ( '(' params? ')' )? ID type_params? signature block? ;
decl = 'var' ( var | '(' ( var ( ';' var )* ';'? )? ')' ) | 'const' ( const | '(' ( const ( ';' const )* ';'? )? ')' ) | 'type' ( typespec | '(' ( typespec ( ';' typespec )* ';'? )? ')' ) ;
var = names ( type ( '=' exprs )? | '=' exprs ) ;
const = names ( type? '=' exprs )? ;
typespec = ID type_params? '='? type ;
type_params = '[' type_param ( ',' type_param )* ','? ']' ;
type_param = names constraint ;
constraint = '~'? type ( '|' '~'? type )* ;
names = ID ( ',' ID )* ;
signature = '(' params? ')' result? ;
result = type | '(' params? ')' ;
params = param ( ',' param )* ','? ;
param = ID? '...'? type ;

type = type_name | '*' type | '(' type ')' | composite ;
composite = '[' ']' type | '[' ( expr | '...' ) ']' type | 'map' '[' type ']' type | 'chan' type | 'chan' ARROW type | ARROW 'chan' type | 'func' signature
  | 'struct' '{' ( field ( ';' field )* ';'? )? '}' | 'interface' '{' ( method ( ';' method )* ';'? )? '}' ;
type_name = ID ( '.' ID )? ( '[' type ( ',' type )* ','? ']' )? ;
field = names type STR? | '*'? type_name STR? ;
method = ID signature | constraint ;

block = '{' stmts '}' ;
stmts = ( stmt? ( ';' stmt? )* ) ;
stmt = decl | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | if | switch | select | for | 'defer' expr | 'go' expr | ID ':' stmt? ;
simple = exprs | exprs ( '++' | '--' ) | exprs ( '=' | ASSIGN | ':=' ) exprs | expr ARROW expr | exprs ( ':=' | '=' ) 'range' expr | 'range' expr ;
if = 'if' ( simple? ';' )? simple block ( 'else' ( if | block ) )? ;
switch = 'switch' ( simple? ';' )? simple? '{' clause* '}' ;
clause = ( 'case' ( type_or_expr ( ',' type_or_expr )* ) | 'default' ) ':' stmts ;
type_or_expr = expr | composite ;
select = 'select' '{' ( ( 'case' simple | 'default' ) ':' stmts )* '}' ;
for = 'for' ( simple? ';' simple? ';' simple? | simple )? block ;

exprs = expr ( ',' expr )* ;
expr = unary ( binary unary )* ;
binary = OP | '*' | '+' | '-' | '&' | '^' | '|' ;
unary = ( '+' | '-' | '!' | '^' | '*' | '&' | ARROW | '~' ) unary | primary ;
primary = operand | primary '.' ID | primary '.' '(' ( type | 'type' ) ')' | primary '[' index ']' | primary '(' ( args '...'? ','? )? ')' | primary literal | composite literal | composite '(' expr? ','? ')' ;
index = type_or_expr ( ',' type_or_expr )* ','? | expr? ':' expr? ( ':' expr )? ;
args = type_or_expr ( ',' type_or_expr )* ;
operand = ID | NUM | STR | CHAR | '(' type_or_expr ')' | 'func' signature block ;
literal = '{' ( element ( ',' element )* ','? )? '}' ;
element = ( value ':' )? value ;
value = expr | literal ;
"""

RUST = """
file = INNER* item* ;
item = OUTER* visibility? item_kind ;
visibility = 'pub' ( '(' ( 'crate' | 'self' | 'super' | 'in' path ) ')' )? ;
item_kind = 'use' use_tree ';' | 'mod' ID ( ';' | '{' INNER* item* '}' ) | 'extern' 'crate' ( ID | 'self' ) ( 'as' ID )? ';' | function
  | 'struct' ID generics? ( where? '{' fields? '}' | '(' tuple_fields? ')' where? ';' | where? ';' ) | 'union' ID generics? where? '{' fields? '}'
  | 'enum' ID generics? where? '{' ( variant ( ',' variant )* ','? )? '}' | 'const' ( ID | '_' ) ':' type ( '=' expr )? ';' | 'static' 'mut'? ID ':' type ( '=' expr )? ';'
  | 'type' ID generics? ( ':' bounds? )? where? ( '=' type )? where? ';' | 'unsafe'? 'auto'? 'trait' ID generics? ( ':' bounds? )? where? '{' INNER* item* '}'
  | 'unsafe'? 'impl' generics? '!'? type ( 'for' type )? where? '{' INNER* item* '}' | 'unsafe'? 'extern' STR? '{' INNER* item* '}' | macro_item ;
macro_item = path '!' ID? ( tree_brace | tree_paren ';' | tree_square ';' ) ;
function = ( 'const' | 'async' | 'unsafe' | 'extern' STR? )* 'fn' ID generics? '(' params? ')' ( '->' type )? where? ( block | ';' ) ;
params = param ( ',' param )* ','? ;
param = OUTER* ( pattern ':' type | ( '&' LIFETIME? )? 'mut'? 'self' ( ':' type )? | '...' | type ) ;
use_tree = ( '::'? ( segment '::' )* ) ( '*' | '{' ( use_tree ( ',' use_tree )* ','? )? '}' | segment ( 'as' ( ID | '_' ) )? ) ;
segment = ID | 'self' | 'super' | 'crate' | 'Self' ;
generics = '<' ( generic ( ',' generic )* ','? )? '>' ;
generic = OUTER* ( LIFETIME ( ':' bounds? )? | ID ( ':' bounds? )? ( '=' type )? | 'const' ID ':' type ( '=' ( literal | block ) )? ) ;
where = 'where' ( predicate ( ',' predicate )* ','? )? ;
predicate = LIFETIME ':' bounds? | for_all? type ':' bounds? ;
for_all = 'for' generics ;
bounds = bound ( '+' bound )* '+'? ;
bound = LIFETIME | '?'? for_all? path | '(' '?'? for_all? path ')' ;
fields = record ( ',' record )* ','? ;
record = OUTER* visibility? ID ':' type ;
tuple_fields = tuple_field ( ',' tuple_field )* ','? ;
tuple_field = OUTER* visibility? type ;
variant = OUTER* visibility? ID ( '(' tuple_fields? ')' | '{' fields? '}' )? ( '=' expr )? ;

type = path | '(' ( type ( ',' type )* ','? )? ')' | '&' LIFETIME? 'mut'? type | '&&' LIFETIME? 'mut'? type | '*' ( 'const' | 'mut' ) type | '[' type ( ';' expr )? ']' | '!' | '_'
  | 'impl' bounds | 'dyn' bounds | for_all? ( 'unsafe' | 'extern' STR? )* 'fn' '(' ( fn_arg ( ',' fn_arg )* ','? )? ')' ( '->' type )? | qualified | path '!' tree ;
fn_arg = ( ( ID | '_' ) ':' )? type | '...' ;
path = '::'? path_segment ( '::' path_segment )* ;
path_segment = segment ( '::'? type_args | '(' ( type ( ',' type )* ','? )? ')' ( '->' type )? )? ;
qualified = '<' type ( 'as' type )? '>' ( '::' path_segment )+ ;
type_args = '<' ( type_arg ( ',' type_arg )* ','? )? '>' ;
type_arg = LIFETIME | type | ID type_args? ( '=' type | ':' bounds ) | literal | '-' literal | block ;

pattern = '|'? single ( '|' single )* ;
single = edge | edge RANGE edge | edge RANGE | RANGE edge | RANGE | 'ref'? 'mut'? ID '@' single | ( 'ref' | 'ref'? 'mut' ) ID | '_' | '&' 'mut'? single | '&&' 'mut'? single | '(' patterns? ')' | '[' patterns? ']'
  | expr_path '(' patterns? ')' | expr_path '{' ( field_pattern ( ',' field_pattern )* )? ','? '}' | expr_path '!' tree | 'box' single ;
edge = literal | '-' literal | expr_path ;
patterns = pattern ( ',' pattern )* ','? ;
field_pattern = OUTER* ( ( ID | NUM ) ':' pattern | 'ref'? 'mut'? ID | RANGE ) ;

block = '{' INNER* ( statement* | statement* tail ) '}' ;
tail = OUTER* expr ;
statement = ';' | item | OUTER* 'let' pattern ( ':' type )? ( '=' expr ( 'else' block )? )? ';' | OUTER* expr ';' | OUTER* blocklike | OUTER* expr_path '!' tree_brace ;
blocklike = block_expr | blocklike '.' ( ID | 'await' ) ;
block_expr = ( 'unsafe' | 'async' 'move'? | 'const' )? block | ( LIFETIME ':' )? ( 'loop' block | 'while' expr block | 'for' pattern 'in' expr block | block ) | if | 'match' expr '{' INNER* ( arm* | arm* last_arm ) '}' ;
if = 'if' expr block ( 'else' ( block | if ) )? ;
arm = OUTER* pattern ( 'if' expr )? '=>' ( expr ',' | block_expr ','? ) ;
last_arm = OUTER* pattern ( 'if' expr )? '=>' expr ;

expr = lead? ( operand ( binary operand )* ) | lead? operand ( binary operand )* RANGE | RANGE | jump | lead? ( operand binary )+ jump ;
lead = RANGE ;
binary = OP | '*' | '+' | '-' | '&' | '&&' | '|' | '||' | '<' | '>' | '>' '>' | '>=' | '>' '>=' | '=' | RANGE | '!=' ;
operand = unary ( 'as' type )* ;
unary = ( '-' | '*' | '!' | '&' ( 'raw' ( 'const' | 'mut' ) )? | '&' 'mut' | '&&' | '&&' 'mut' | 'box' ) unary | 'let' pattern '=' unary | postfix ;
jump = ( 'return' | 'break' LIFETIME? | 'yield' ) expr? | 'continue' LIFETIME? | closure ;
closure = ( 'for' generics )? 'static'? 'async'? 'move'? ( '||' | '|' ( closure_param ( ',' closure_param )* ','? )? '|' ) ( '->' type block | expr ) ;
closure_param = OUTER* single ( ':' type )? ;
postfix = primary | postfix '?' | postfix '.' ( ID ( '::' type_args )? | NUM | 'await' ) | postfix '(' exprs? ')' | postfix '[' expr ']' ;
primary = literal | expr_path | expr_path '!' tree | expr_path '{' ( field ( ',' field )* )? ( ','? RANGE expr? | ',' )? '}' | '(' exprs? ')' | '[' ( exprs | expr ';' expr )? ']' | block_expr ;
field = OUTER* ( ( ID | NUM ) ( ':' expr )? ) ;
exprs = OUTER* expr ( ',' expr )* ','? ;
expr_path = '::'? expr_segment ( '::' expr_segment )* | qualified ;
expr_segment = segment ( '::' type_args )? ;
literal = NUM | STR | CHAR | 'true' | 'false' ;
tree = tree_paren | tree_square | tree_brace ;
tree_paren = '(' any* ')' ;
tree_square = '[' any* ']' ;
tree_brace = '{' any* '}' ;
any = tree | ANY ;
"""

#: Lines that begin with `@` are part of the grammar of TypeScript only.
# Words that are names in some places, in JavaScript and besides in TypeScript, and words that never are.
SOFT_WORDS = ["accessor", "as", "async", "from", "get", "of", "set", "static"]
SOFT_TYPED = ["abstract", "asserts", "declare", "global", "implements", "infer", "interface", "is", "keyof", "module", "namespace", "out", "override", "private", "protected", "public", "readonly", "satisfies", "type", "unique"]
RESERVED = ["await", "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "enum", "export", "extends", "false", "finally", "for", "function", "if", "import", "in", "instanceof", "let", "new", "null", "return", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void", "while", "with", "yield"]

SCRIPT = """
file = statement* ;
name = ID | SOFT ;
key = name | RESERVED ;
opens = '{' | 'c{' ;
begins = 'o{' | 'c{' ;
any_brace = '{' | 'o{' | 'c{' ;
block = opens statement* '}' ;
statement = block | ';' | 'var' bindings ';' | 'let' bindings ';' | 'const' bindings ';' | exprs ';' | 'if' '(' exprs ')' statement ( 'else' statement )? | function | class
  | 'do' statement 'while' '(' exprs ')' ';'? | 'while' '(' exprs ')' statement | 'for' 'await'? '(' for ')' statement | 'continue' name? ';' | 'break' name? ';' | 'return' exprs? ';' | 'throw' exprs ';'
  | 'with' '(' exprs ')' statement | 'switch' '(' exprs ')' opens ( ( 'case' exprs | 'default' ) ':' statement* )* '}' | 'try' block ( 'catch' ( '(' binding ')' )? block ( 'finally' block )? | 'finally' block )
  | 'debugger' ';' | name ':' statement | 'import' import ';' | 'export' export ;
for = ( 'var' bindings | 'let' bindings | 'const' bindings | exprs )? ';' exprs? ';' exprs? | ( ( 'var' | 'let' | 'const' ) target | postfix | target ) ( 'of' expr | 'in' exprs ) ;
import = STR with? | clause 'from' STR with? ;
@import = 'type' clause 'from' STR with? | 'type'? name '=' ( name '(' STR ')' | type ) ;
with = 'with' object ;
clause = name ( ',' ( '*' 'as' name | named ) )? | '*' 'as' name | named ;
named = any_brace ( specifier ( ',' specifier )* ','? )? '}' ;
specifier = ( key | STR ) ( 'as' ( key | STR ) )? ;
@specifier = 'type' key ( 'as' key )? ;
export = '*' ( 'as' ( key | STR ) )? 'from' STR with? ';' | named ( 'from' STR with? )? ';' | 'var' bindings ';' | 'let' bindings ';' | 'const' bindings ';' | function | class | 'default' ( function | class | expr ';' ) ;
@export = 'type' named ( 'from' STR )? ';' | 'type' '*' ( 'as' key )? 'from' STR ';' | '=' expr ';' | 'as' 'namespace' name ';' | declaration | 'default' interface ;
bindings = bound ( ',' bound )* ;
bound = target annotated? ( '=' expr )? ;
target = name | any_brace ( property_target ( ',' property_target )* ','? )? '}' | '[' ( ','* element_target ( ','+ element_target )* )? ','* ']' ;
property_target = ( key | STR | NUM | '[' expr ']' ) ':' target ( '=' expr )? | name ( '=' expr )? | '...' target ;
element_target = '...'? target ( '=' expr )? ;
binding = target annotated? ;
params = param ( ',' param )* ','? ;
param = '...'? target annotated? ( '=' expr )? ;
@param = decorator* modifier+ '...'? target '?'? annotated? ( '=' expr )? | decorator+ target '?'? annotated? ( '=' expr )? | '...'? target '?' annotated? ( '=' expr )? | 'this' annotated ;
@annotated = ':' type ;
function = 'async'? 'function' '*'? name? type_params? '(' params? ')' returns? ( block | bodyless ) ;
@returns = ':' ( type | predicate ) ;
@bodyless = ';' ;
class = decorator* abstract? 'class' name? type_params? ( 'extends' postfix type_args? )? implements? any_brace member* '}' ;
@abstract = 'abstract' ;
@implements = 'implements' type ( ',' type )* ;
decorator = '@' postfix ;
member = ';' | decorator* modifier* method | decorator* modifier* field ';' | 'static' block ;
modifier = 'static' | 'accessor' ;
@modifier = 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' ;
@member = modifier* '[' name ':' type ']' ':' type ';' ;
method = ( 'async'? '*'? | 'get' | 'set' ) member_name optional? type_params? '(' params? ')' returns? ( block | bodyless ) ;
@optional = '?' | '!' ;
field = member_name optional? annotated? ( '=' expr )? ;
member_name = key | STR | NUM | PRIVATE | '[' expr ']' ;

exprs = expr ( ',' expr )* ;
expr = unary ( binary unary )* ( binary lone )? | lone ;
lone = arrow | 'yield' ( '*'? expr )? | unary ( binary unary )* '?' expr ':' lone ;
binary = OP | '*' | '+' | '-' | '/' | '<' | '>' | '>' '>' | '>' '>' '>' | '>=' | '>' '>=' | '>' '>' '>=' | '=' | 'in' | 'instanceof' | '|' | '&' | '?' expr ':' ;
@unary = '<' type '>' unary ;
unary = ( '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' ) unary | postfix ( '++' | '--' )? casts? ;
@casts = ( 'as' type | 'as' 'const' | 'satisfies' type )+ ;
arrow = 'async'? ( name | '(' params? ')' ) '=>' ( expr | block ) | 'async'? type_params? '(' params? ')' returns? '=>' ( expr | block ) ;
postfix = primary | postfix ( '.' | '?.' ) ( key | PRIVATE ) | postfix '?.'? '[' exprs ']' | postfix '?.'? arguments | postfix template | 'import' arguments | 'import' '.' key | 'new' '.' key ;
@postfix = postfix '!' | postfix type_args arguments | postfix type_args template ;
arguments = '(' ( argument ( ',' argument )* ','? )? ')' ;
argument = '...'? expr ;
primary = name | NUM | STR | REGEX | template | 'this' | 'super' | 'null' | 'true' | 'false' | '(' exprs ')' | '[' ','* ( argument ( ','+ argument )* )? ','* ']' | object | function_expr | class_expr | 'new' creator arguments? | PRIVATE 'in' unary ;
creator = primary | creator '.' ( key | PRIVATE ) | creator '[' exprs ']' ;
@creator = creator type_args ;
function_expr = 'async'? 'fexpr' '*'? name? type_params? '(' params? ')' returns? block ;
class_expr = decorator* 'cexpr' name? type_params? ( 'extends' postfix type_args? )? implements? any_brace member* '}' ;
object = begins ( property ( ',' property )* ','? )? '}' ;
property = member_name ':' expr | name ( '=' expr )? | '...' expr | ( 'async'? '*'? | 'get' | 'set' ) member_name type_params? '(' params? ')' returns? block ;
template = TEMPLATE | HEAD exprs ( MIDDLE exprs )* TAIL ;

@statement = declaration ;
@declaration = 'declare'? ( interface | 'type' name type_params? '=' type ';' | 'const'? 'enum' name any_brace ( enum_member ( ',' enum_member )* ','? )? '}' | ( 'namespace' | 'module' ) ( name ( '.' name )* | STR ) ( block | ';' ) | 'global' block )
@  | 'declare' ( 'var' bindings ';' | 'let' bindings ';' | 'const' bindings ';' | function | class ) ;
@interface = 'interface' name type_params? ( 'extends' type ( ',' type )* )? object_type ;
@enum_member = ( key | STR ) ( '=' expr )? ;
@type_params = '<' type_param ( ',' type_param )* ','? '>' ;
@type_param = ( 'const' | 'in' | 'out' )* name ( 'extends' type )? ( '=' type )? ;
@type_args = '<' type ( ',' type )* '>' ;
@type = union ( 'extends' union '?' type ':' type )? | 'asserts' name ( 'is' type )? | function_type ;
@function_type = 'abstract'? 'new'? type_params? '(' params? ')' '=>' ( type | predicate ) ;
@predicate = ( name | 'this' ) 'is' type | 'asserts' ( name | 'this' ) ( 'is' type )? ;
@union = '|'? joined ( '|' joined )* ;
@joined = '&'? prefix ( '&' prefix )* ;
@prefix = ( 'keyof' | 'readonly' | 'unique' ) prefix | 'infer' name ( 'extends' prefix )? | array_type ;
@array_type = single_type | array_type '[' type? ']' ;
@single_type = type_name type_args? | 'void' | 'null' | 'this' | 'true' | 'false' | STR | '-'? NUM | 'typeof' type_name type_args? | 'import' '(' STR ')' ( '.' key )* type_args? | '(' type ')' | '[' ( tuple ( ',' tuple )* ','? )? ']' | object_type | TEMPLATE | HEAD type ( MIDDLE type )* TAIL ;
@type_name = name ( '.' key )* ;
@tuple = '...'? type | '...'? name '?'? ':' type | type '?' ;
@object_type = any_brace ( type_member ( ( ';' | ',' ) type_member )* ( ';' | ',' )? )? '}' ;
@type_member = modifier* member_name '?'? ( ':' type )? | ( 'get' | 'set' )? member_name '?'? type_params? '(' params? ')' returns? | 'new'? type_params? '(' params? ')' returns? | modifier* '[' name ':' type ']' ':' type
@  | ( ( '+' | '-' )? 'readonly' )? '[' name 'in' type ( 'as' type )? ']' ( ( '+' | '-' )? '?' )? ':' type ;
"""


def script(typed: bool) -> str:
    """The grammar of JavaScript, or of TypeScript: rules of both are joined, those of the other are left out."""
    lines = SCRIPT.splitlines()
    words = lambda names: " | ".join(f"'{w}'" for w in names)
    if typed:
        text = "\n".join(line.removeprefix("@") for line in lines)
        return text.replace("SOFT ;", words(SOFT_WORDS + SOFT_TYPED) + " ;").replace("RESERVED ;", words(RESERVED) + " ;")
    text = "\n".join(line for line in lines if not line.startswith("@"))
    text = text.replace("SOFT ;", words(SOFT_WORDS) + " ;").replace("RESERVED ;", words(RESERVED) + " ;")
    for absent in ("annotated", "type_params", "type_args", "returns", "implements", "abstract", "optional", "casts"):
        text = text.replace(f" {absent}?", "")
    return text.replace("( block | bodyless )", "block")
