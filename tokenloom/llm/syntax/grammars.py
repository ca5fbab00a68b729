"""Dialect grammars. They describe which texts are sentences of a language, and no more: operators have no precedence,
since that changes the tree of a text but not whether there is one."""

from __future__ import annotations

_C_STATEMENTS = """
Block = '{' BlockItem* '}' ;
Stmt = Block | ';' | Expr ';' | Labelled | 'if' '(' Cond ')' Stmt ('else' Stmt)? | 'switch' '(' Cond ')' Stmt
  | 'while' '(' Cond ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' ForHead ')' Stmt
  | 'goto' '*'? (Id | Expr) ';' | 'continue' ';' | 'break' ';' | 'return' (Expr | InitList)? ';' | Asm ;
Labelled = Id ':' Stmt | 'case' CondExpr ('...' CondExpr)? ':' LabelTail | 'default' ':' LabelTail ;
LabelTail = (Stmt | LocalDecl)? ;
Asm = ('asm' | '__asm__' | '__asm') ('volatile' | '__volatile__' | 'goto' | 'inline')* '(' Balanced* ')' ';' ;
"""

_BALANCED = """
Balanced = '(' Balanced* ')' | '[' Balanced* ']' | '{' Balanced* '}' | Id | NUM | STR | CHR | ',' | '.' | ':' | '::' | '=' | '+' | '-' | '*' | '/'
  | '%' | '&' | '|' | '^' | '~' | '!' | '<' | '>' | '?' | ';' | '->' | '==' | '!=' | '<=' | '>=' | '&&' | '||' | '<<' | 'const' | 'int' | 'void' | 'char' ;
"""

C = (
    """
%dialects c17 c89
Unit = External* ;
External = ';' | Declaration | FunctionDef | StaticAssert | Asm | '__extension__' External ;
FunctionDef = Specs FnDeclarator Attr* (@c89 Declaration+)? Block | @c89 FnDeclarator Attr* Declaration* Block ;
FnDeclarator = Pointer* (Id | '(' Attr* Declarator ')') Suffix* '(' Params? ')' Suffix* ;
Declaration = Specs InitDeclarators? ';' ;
LocalDecl = Declaration | StaticAssert ;
InitDeclarators = InitDeclarator (',' InitDeclarator)* ;
InitDeclarator = Declarator AsmName? Attr* ('=' Init)? ;
AsmName = ('asm' | '__asm__' | '__asm') '(' STR+ ')' ;
StaticAssert = ('_Static_assert' | 'static_assert') '(' Assign (',' STR+)? ')' ';' ;
Specs = Qual* Core (Qual | Builtin)* ;
Core = Builtin | Id | Tagged | ('typeof' | '__typeof__' | 'typeof_unqual') '(' (TypeName | Expr) ')' | '_Atomic' '(' TypeName ')' ;
Qual = 'const' | 'volatile' | 'restrict' | '__restrict' | '__restrict__' | 'static' | 'extern' | 'register' | 'auto' | 'typedef' | 'inline' | '__inline' | '__inline__'
  | '_Noreturn' | '_Thread_local' | 'thread_local' | '_Atomic' | 'constexpr' | '_Alignas' '(' (TypeName | CondExpr) ')' | '__extension__' | Attr ;
Attr = ('__attribute__' | '__declspec') '(' Balanced* ')' | '[' '[' Balanced* ']' ']' ;
Builtin = 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | 'bool' | '_Complex' | '_Imaginary' | '__int128' ;
Tagged = ('struct' | 'union') Attr* (Id | Id? '{' Member* '}') Attr* | 'enum' Attr* (Id | Id? (':' Specs)? '{' (Enumerator (',' Enumerator)* ','?)? '}') ;
Enumerator = Id Attr* ('=' CondExpr)? ;
Member = Specs (MemberDeclarator (',' MemberDeclarator)*)? ';' | StaticAssert | ';' ;
MemberDeclarator = (Declarator (':' CondExpr)? | ':' CondExpr) Attr* ;
Pointer = ('*' | '^') PtrQual* ;
PtrQual = 'const' | 'volatile' | 'restrict' | '__restrict' | '__restrict__' | '_Atomic' | Attr ;
Declarator = Pointer* Direct ;
Direct = (Id | '(' Attr* Declarator ')') Suffix* ;
Suffix = '[' ('static' | PtrQual | '*')* Assign? ']' | '(' Params? ')' ;
Params = Param (',' Param)* (',' '...')? | '...' ;
Param = Specs (Declarator | Abstract)? Attr* ;
Abstract = Pointer+ DirectAbstract? | DirectAbstract ;
DirectAbstract = ('(' Abstract ')' | Suffix) Suffix* ;
TypeName = Specs Abstract? ;
Init = Assign | InitList ;
InitList = '{' (InitItem (',' InitItem)* ','?)? '}' ;
InitItem = (Designator+ '=' | Id ':')? Init ;
Designator = '[' CondExpr ('...' CondExpr)? ']' | '.' Id ;
BlockItem = LocalDecl | Stmt | NestedFunction ;
NestedFunction = 'auto'? Specs FnDeclarator Block ;
Cond = Expr ;
ForHead = (Expr? ';' | Declaration) Expr? ';' Expr? ;
Expr = Assign (',' Assign)* ;
CondExpr = Assign ;
Assign = Unary (BinOp Unary | '?' Expr? ':' Unary)* ;
BinOp = '+' | '-' | '*' | '/' | '%' | '<<' | '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '^' | '|' | '&&' | '||'
  | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '<<=' | '>' '>=' | '&=' | '^=' | '|=' ;
Unary = ('++' | '--' | '&' | '*' | '+' | '-' | '~' | '!' | '&&' | '__extension__' | '__real__' | '__imag__') Unary | ('sizeof' | '_Alignof' | 'alignof' | '__alignof__') (Unary | '(' TypeName ')')
  | '(' TypeName ')' (Unary | InitList) | Postfix ;
Postfix = Primary ('[' Expr ']' | '(' Args? ')' | '.' Id | '->' Id | '++' | '--')* ;
Args = Arg (',' Arg)* ;
Arg = Assign | TypeName ;
Primary = Id | NUM | CHR | StrParts | '(' Expr ')' | '(' Block ')' | '_Generic' '(' Assign (',' (TypeName | 'default') ':' Assign)+ ')' | 'true' | 'false' | 'nullptr' ;
StrParts = STR (STR | Id)* | Id STR+ (STR | Id)* ;
"""
    + _C_STATEMENTS
    + _BALANCED
)

CPP = (
    """
%context override final import module
Unit = Decl* ;
Decl = ';' | Using | Namespace | Template | Simple | FunctionDef | 'extern' STR ('{' Decl* '}' | Decl) | StaticAssert | Asm | 'inline' Namespace | Concept ;
Namespace = 'namespace' Attr* (Id ('::' 'inline'? Id)*)? ('{' Decl* '}' | '=' QualId ';') ;
Using = 'using' 'namespace' QualId ';' | 'using' 'typename'? UsingName (',' UsingName)* ';' | 'using' Id Attr* '=' TypeId ';' | 'using' 'enum' QualId ';' ;
UsingName = '::'? (Part '::')+ LastPart | '::' LastPart ;
Template = 'template' '<' (TParam (',' TParam)*)? '>' Requires? (Decl | MemberDecl | Concept) | 'extern'? 'template' Simple ;
TParam = ('typename' | 'class') '...'? Id? ('=' TypeId)? | 'template' '<' (TParam (',' TParam)*)? '>' ('class' | 'typename') '...'? Id? ('=' QualId)? | Param ;
Requires = 'requires' Assign ;
Concept = 'concept' Id '=' Expr ';' ;
StaticAssert = 'static_assert' '(' Assign (',' STR+)? ')' ';' ;
Simple = Specs InitDeclarators? ';' | 'auto' '&'? '&&'? '[' Id (',' Id)* ']' Init ';' ;
LocalDecl = Simple | Using | StaticAssert | NamespaceAlias | LocalBinding ;
NamespaceAlias = 'namespace' Id '=' QualId ';' ;
LocalBinding = Qual* 'auto' ('&' | '&&')? '[' Id (',' Id)* ']' Init ';' ;
InitDeclarators = InitDeclarator (',' InitDeclarator)* ;
InitDeclarator = Declarator FnTail Init? ;
Init = '=' (Assign | InitList) | InitList | '(' Args ')' ;
InitList = '{' (InitItem (',' InitItem)* ','?)? '}' ;
InitItem = ('.' Id)? '='? (Assign | InitList) '...'? ;
Specs = Qual* Core (Qual | Builtin)* ;
Core = Builtin | QualId | 'typename' QualId | Elaborated | ClassDef | EnumDef | 'auto' | 'decltype' '(' (Expr | 'auto') ')' ;
Qual = 'const' | 'volatile' | 'static' | 'extern' | 'register' | 'mutable' | 'typedef' | 'inline' | 'virtual' | 'explicit' ('(' Assign ')')? | 'friend' | 'constexpr' | 'consteval' | 'constinit'
  | 'thread_local' | 'alignas' '(' (TypeId | Assign) ')' | Attr | '__restrict' | '__inline' ;
Attr = ('__attribute__' | '__declspec') '(' Balanced* ')' | '[' '[' Balanced* ']' ']' ;
Builtin = 'void' | 'char' | 'char8_t' | 'char16_t' | 'char32_t' | 'wchar_t' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | 'bool' | '__int128' ;
Elaborated = ('class' | 'struct' | 'union' | 'enum') Attr* QualId ;
ClassDef = ('class' | 'struct' | 'union') Attr* (QualId 'final'?)? (':' Base (',' Base)*)? '{' MemberDecl* '}' ;
Base = Attr* ('virtual' | 'public' | 'protected' | 'private')* QualId '...'? ;
EnumDef = 'enum' ('class' | 'struct')? Attr* QualId? (':' Specs)? '{' (Enumerator (',' Enumerator)* ','?)? '}' ;
Enumerator = Id Attr* ('=' Assign)? ;
MemberDecl = ('public' | 'protected' | 'private' | Id) ':' | ';' | Using | Template | StaticAssert | MemberVar | FunctionDef | CtorDef ;
MemberVar = Specs (MemberDeclarator (',' MemberDeclarator)*)? ';' | 'friend' Elaborated ';' ;
MemberDeclarator = Declarator FnTail (Init | ':' Assign Init?)? | ':' Assign ;
CtorDef = Qual* '~'? Id '(' Params? ')' FnTail FnBody | Qual* 'operator' TypeId '(' ')' FnTail FnBody ;
FunctionDef = Specs PtrOp* (DeclName | '(' Declarator ')') Suffix* '(' Params? ')' Suffix* FnTail FnBody2 | Qual* '::'? (Part '::')+ ('~'? Id | 'operator' TypeId) '(' Params? ')' FnTail FnBody ;
FnBody = ';' | FnBody2 | '=' NUM ';' ;
FnBody2 = (':' MemInit (',' MemInit)*)? Block | 'try' (':' MemInit (',' MemInit)*)? Block Catch+ | '=' ('default' | 'delete') ';' ;
MemInit = QualId ('(' Args? ')' | InitList) '...'? ;
FnTail = ('const' | 'volatile' | '&' | '&&' | 'noexcept' ('(' Assign ')')? | 'throw' '(' (TypeId (',' TypeId)*)? ')' | 'override' | 'final' | Attr | '->' TypeId | Requires)* ;
PtrOp = ('*' | '&' | '&&' | QualPtr) ('const' | 'volatile' | '__restrict' | Attr)* ;
QualPtr = '::'? (Part '::')+ '*' ;
Declarator = PtrOp* '...'? Direct ;
Direct = (DeclName Attr* | '(' Declarator ')') Suffix* ;
DeclName = QualId ;
Suffix = '[' Assign? ']' | '(' Params? ')' ;
Params = Param (',' Param)* (','? '...')? | '...' ;
Param = Attr* 'this'? Specs (Declarator | Abstract)? ('=' (Assign | InitList))? ;
Abstract = PtrOp+ '...'? DirectAbstract? | DirectAbstract | '...' ;
DirectAbstract = ('(' Abstract ')' | Suffix) (Suffix | 'const' | 'noexcept')* ;
TypeId = Specs Abstract? ;
QualId = '::'? (Part '::')* LastPart ;
Part = 'template'? Id TArgs? | 'decltype' '(' Expr ')' ;
LastPart = 'template'? Id TArgs? | '~' Id TArgs? | 'operator' OpName ;
TArgs = '<' (TArg (',' TArg)*)? '>' ;
TArg = TypeId '...'? | CondNoGt '...'? ;
CondNoGt = Unary (NoGtOp Unary)* ;
NoGtOp = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<' | '<=' ;
OpName = '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '~' | '!' | '=' | '<' | '>' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<' | '>' '>' | '<<=' | '>' '>=' | '==' | '!='
  | '<=' | '>=' | '<=' '>' | '&&' | '||' | '++' | '--' | ',' | '->*' | '->' | '(' ')' | '[' ']' | 'new' ('[' ']')? | 'delete' ('[' ']')? | STR Id ;
BlockItem = LocalDecl | Stmt ;
Cond = (Expr? ';' | Simple)? (Expr | Specs Declarator Init) | 'constexpr' Cond ;
ForHead = (Expr? ';' | Simple) (Expr | Specs Declarator Init)? ';' Expr? | (Simple | Expr? ';')? Specs (Declarator | PtrOp* '[' Id (',' Id)* ']') ':' (Expr | InitList) ;
Expr = Assign (',' Assign)* ;
CondExpr = Assign ;
Assign = Unary (BinOp (Unary | InitList) | '?' Expr ':' Unary)* | 'throw' Assign? | 'co_yield' Assign ;
BinOp = '+' | '-' | '*' | '/' | '%' | '<<' | '>' '>' | '<' | '>' | '<=' | '>=' | '<=' '>' | '==' | '!=' | '&' | '^' | '|' | '&&' | '||' | '.*' | '->*'
  | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '<<=' | '>' '>=' | '&=' | '^=' | '|=' | 'and' | 'or' ;
Unary = ('++' | '--' | '&' | '*' | '+' | '-' | '~' | '!' | 'not' | 'co_await') Unary | 'sizeof' ('...' '(' Id ')' | Unary | '(' TypeId ')') | 'alignof' '(' TypeId ')' | 'noexcept' '(' Expr ')'
  | '(' TypeId ')' Unary | '::'? 'new' ('(' Args ')')? (NewType | '(' TypeId ')') ('(' Args? ')' | InitList)? | '::'? 'delete' ('[' ']')? Unary | Postfix ;
NewType = Specs PtrOp* ('[' Expr ']')* ;
Postfix = Primary ('[' (Expr | InitList)? ']' | '(' Args? ')' | ('.' | '->') QualId | '++' | '--' | '...')* ;
Args = Arg (',' Arg)* ;
Arg = (Assign | InitList) '...'? ;
Primary = QualId InitList? | NUM | CHR | STR+ Id? | 'this' | 'true' | 'false' | 'nullptr' | '(' Expr ')' | '(' Fold ')' | Lambda | TypeCtor ('(' Args? ')' | InitList)
  | ('static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast') '<' TypeId '>' '(' Expr ')' | 'typeid' '(' (Expr | TypeId) ')' | 'requires' ('(' Params? ')')? Block ;
Fold = '...' BinOp Unary | Unary BinOp '...' (BinOp Unary)? ;
TypeCtor = Builtin+ | 'typename' QualId | 'auto' | 'decltype' '(' Expr ')' ;
Lambda = '[' ('&' | '=' | Capture)? (',' Capture)* ']' TParams? ('(' Params? ')')? ('mutable' | 'constexpr' | 'noexcept' | Attr | '->' TypeId)* Block ;
TParams = '<' TParam (',' TParam)* '>' ;
Capture = '&'? '...'? Id '...'? Init? | '*'? 'this' ;
"""
    + _C_STATEMENTS.replace("| Asm ;\nLabelled", "| Asm | 'try' Block Catch+ | 'co_return' Expr? ';' | Attr+ Stmt ;\nCatch = 'catch' '(' (Param | '...') ')' Block ;\nLabelled").replace(
        "'if' '(' Cond ')'", "'if' 'constexpr'? '(' Cond ')'"
    )
    + _BALANCED
)

JAVA = """
%context record sealed permits var yield module open opens requires exports uses provides with to transitive when
Unit = (Annotation* 'package' Name ';')? ('import' 'static'? Name ('.' '*')? ';' | ';')* (TypeDecl | ';')* | ModuleDecl ;
ModuleDecl = Annotation* 'open'? 'module' Name '{' (('requires' ('transitive' | 'static')* | 'exports' | 'opens' | 'uses' | 'provides') Name (('to' | 'with') Name (',' Name)*)? ';')* '}' ;
Name = Id ('.' Id)* ;
TypeDecl = Mod* (ClassDecl | InterfaceDecl | EnumDecl | RecordDecl | AnnotationDecl) ;
Mod = Annotation | 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | Id '-' 'sealed' ;
Annotation = '@' Name ('(' (AnnArg (',' AnnArg)* ','?)? ')')? ;
AnnArg = Id '=' AnnValue | AnnValue ;
AnnValue = Expr | Annotation | '{' (AnnValue (',' AnnValue)*)? ','? '}' ;
ClassDecl = 'class' Id TParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? Body ;
InterfaceDecl = 'interface' Id TParams? ('extends' Types)? ('permits' Types)? Body ;
RecordDecl = 'record' Id TParams? '(' Params? ')' ('implements' Types)? Body ;
EnumDecl = 'enum' Id ('implements' Types)? '{' (EnumConst (',' EnumConst)*)? ','? (';' Member*)? '}' ;
EnumConst = Annotation* Id ('(' Args? ')')? Body? ;
AnnotationDecl = '@' 'interface' Id Body ;
Types = Type (',' Type)* ;
TParams = '<' TParam (',' TParam)* '>' ;
TParam = Annotation* Id ('extends' Type ('&' Type)*)? ;
Body = '{' Member* '}' ;
Member = ';' | 'static'? Block | TypeDecl | Mod* TParams? (MethodHead | CtorHead) | Mod* Type VarDecls ';' | Mod* Id Block ;
MethodHead = ('void' | Type) Id '(' Params? ')' Dims ('throws' Types)? (Block | ('default' AnnValue)? ';') ;
CtorHead = Id '(' Params? ')' ('throws' Types)? Block ;
Params = Param (',' Param)* ;
Param = ('final' | Annotation)* Type Annotation* '...'? (Id '.')* (Id Dims | 'this') ;
VarDecls = VarDecl (',' VarDecl)* ;
VarDecl = Id Dims ('=' VarInit)? ;
VarInit = Expr | ArrayInit ;
ArrayInit = '{' (VarInit (',' VarInit)*)? ','? '}' ;
Dims = (Annotation* '[' ']')* ;
Type = Annotation* (Prim | ClassType) Dims ;
Prim = 'byte' | 'short' | 'int' | 'long' | 'char' | 'float' | 'double' | 'boolean' ;
ClassType = Id TArgs? ('.' Annotation* Id TArgs?)* ;
TArgs = '<' (TArg (',' TArg)*)? '>' ;
TArg = Type | Annotation* '?' (('extends' | 'super') Type)? ;
Block = '{' BlockItem* '}' ;
BlockItem = LocalVar ';' | Stmt | LocalType ;
LocalType = ('final' | 'abstract' | 'static' | 'strictfp' | 'sealed' | Annotation)* (ClassDecl | InterfaceDecl | EnumDecl | RecordDecl) ;
LocalVar = ('final' | Annotation)* Type VarDecls ;
Stmt = Block | ';' | ExprStmt ';' | Id ':' Stmt | 'if' '(' Expr ')' Stmt ('else' Stmt)? | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' ForHead ')' Stmt
  | 'switch' '(' Expr ')' SwitchBody | 'return' Expr? ';' | 'break' Id? ';' | 'continue' Id? ';' | 'throw' Expr ';' | 'synchronized' '(' Expr ')' Block | 'yield' Expr ';'
  | 'assert' Expr (':' Expr)? ';' | 'try' ('(' Resource (';' Resource)* ';'? ')')? Block Catch* ('finally' Block)? ;
Catch = 'catch' '(' ('final' | Annotation)* Type ('|' Type)* Id ')' Block ;
Resource = LocalVar | Expr ;
ForHead = (LocalVar | ExprStmt (',' ExprStmt)*)? ';' Expr? ';' (ExprStmt (',' ExprStmt)*)? | ('final' | Annotation)* Type Id ':' Expr ;
SwitchBody = '{' ((CaseLabel ':')+ BlockItem* | CaseLabel '->' (ExprStmt ';' | Expr ';' | Block | 'throw' Expr ';'))* '}' ;
CaseLabel = 'case' CaseItem (',' CaseItem)* ('when' Expr)? | 'default' ;
CaseItem = NoArrow | Pattern | 'default' ;
Pattern = ('final' | Annotation)* Type (Id | '(' (Pattern (',' Pattern)*)? ')' Id?) ;
NoArrow = Unary (BinOp Unary)* ;
ExprStmt = ('++' | '--') Unary | Postfixed ('++' | '--' | AssignOp Expr) | Primary Selector* '(' Args? ')' | New ;
Postfixed = Primary Selector* ;
Expr = Lambda | Unary (BinOp Unary | 'instanceof' ('final'? Type Id? | Pattern) | '?' Expr ':' (Lambda | Unary) | AssignOp Lambda)* ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
BinOp = AssignOp | '+' | '-' | '*' | '/' | '%' | '<<' | '>' '>' | '>' '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '^' | '|' | '&&' | '||' ;
Unary = ('++' | '--' | '+' | '-' | '~' | '!') Unary | '(' Type ('&' Type)* ')' (Unary | Lambda) | Postfixed ('++' | '--')* | 'switch' '(' Expr ')' SwitchBody ;
Lambda = (Id | '(' ((Id (',' Id)*)? | Params) ')') '->' (Expr | Block) ;
Primary = Id | NUM | STR | CHR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' Expr ')' | New | (Prim Dims | 'void') '.' 'class' | Prim Dims '::' 'new' | ArrayRef ;
ArrayRef = Id TArgs? ('.' Id TArgs?)* ('[' ']')* ('::' TArgs? (Id | 'new') | '.' 'class') ;
Selector = '.' TArgs? Id | '.' ('this' | 'super' | New) | '[' Expr ']' | '(' Args? ')' | '::' TArgs? (Id | 'new') ;
New = 'new' TArgs? Annotation* (ClassType '(' Args? ')' Body? | (Prim | ClassType) (('[' Expr ']')+ Dims | ('[' ']')+ ArrayInit)) ;
Args = Expr (',' Expr)* ;
"""

CSHARP = """
%context get set init add remove value var async await partial where when yield record dynamic from select group into orderby join let in_ on equals by ascending descending global alias file required scoped managed unmanaged nameof notnull with and or not nint nuint args
Unit = ('extern' 'alias' Id ';')* Using* ('[' Id ':' Attrs ']')* (NsMember | TopStmt)* ;
Using = 'global'? 'using' ('static' | 'unsafe')* (Id '=')? Type ';' ;
TopStmt = BlockItem ;
NsMember = 'namespace' QName ('{' ('extern' 'alias' Id ';')* Using* NsMember* '}' ';'? | ';' Using*) | TypeDecl ;
QName = Id ('.' Id)* ;
Attr = '[' (Id ':' | 'return' ':')? Attrs ','? ']' ;
Attrs = AttrItem (',' AttrItem)* ;
AttrItem = Name ('(' (AttrArg (',' AttrArg)*)? ')')? ;
AttrArg = (Id ('=' | ':'))? Expr ;
Mod = 'public' | 'protected' | 'private' | 'internal' | 'static' | 'abstract' | 'sealed' | 'virtual' | 'override' | 'readonly' | 'const' | 'extern' | 'new' | 'unsafe' | 'volatile' | 'async' | 'partial' | 'required' | 'file' | 'ref' | 'fixed' ;
TypeDecl = Attr* Mod* (ClassDecl | EnumDecl | DelegateDecl) ;
ClassDecl = ('class' | 'struct' | 'interface' | 'record' ('class' | 'struct')?) Id TParams? ('(' Params? ')')? (':' Base (',' Base)*)? Where* ('{' Member* '}' ';'? | ';') ;
Base = Type ('(' Args? ')')? ;
Where = 'where' Id ':' Constraint (',' Constraint)* ;
Constraint = 'class' '?'? | 'struct' | 'new' '(' ')' | 'default' | Type ;
TParams = '<' TParam (',' TParam)* '>' ;
TParam = Attr* ('in' | 'out')? Id ;
EnumDecl = 'enum' Id (':' Type)? '{' (EnumItem (',' EnumItem)* ','?)? '}' ';'? ;
EnumItem = Attr* Id ('=' Expr)? ;
DelegateDecl = 'delegate' Type Id TParams? '(' Params? ')' Where* ';' ;
Member = Attr* Mod* (Field | Method | Property | Ctor | Operator | Event | Indexer | ClassDecl | EnumDecl | DelegateDecl) ;
Field = Type Declr (',' Declr)* ';' ;
Declr = Id ('[' Expr ']')? ('=' (Expr | ArrayInit))? ;
Method = Type (Name '.')? Id TParams? '(' Params? ')' Where* FnBody ;
Ctor = '~'? Id '(' Params? ')' (':' ('base' | 'this') '(' Args? ')')? FnBody ;
Operator = ('implicit' | 'explicit') 'operator' 'checked'? Type '(' Params ')' FnBody | Type 'operator' 'checked'? OpName '(' Params ')' FnBody ;
OpName = '+' | '-' | '!' | '~' | '++' | '--' | 'true' | 'false' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' ;
Property = Type (Name '.')? Id ('{' Accessor+ '}' ('=' Expr ';')? | '=>' Expr ';') ;
Indexer = Type (Name '.')? 'this' '[' Params ']' ('{' Accessor+ '}' | '=>' Expr ';') ;
Event = 'event' Type (Declr (',' Declr)* ';' | (Name '.')? Id '{' Accessor+ '}') ;
Accessor = Attr* ('public' | 'protected' | 'private' | 'internal' | 'readonly')* ('get' | 'set' | 'init' | 'add' | 'remove') FnBody ;
FnBody = ';' | Block | '=>' ('ref'? Expr | 'throw' Expr) ';' ;
Params = Param (',' Param)* ;
Param = Attr* ('this' | 'ref' | 'out' | 'in' | 'params' | 'scoped' | 'readonly')* Type Id ('=' Expr)? ;
Type = ('ref' 'readonly'?)? TypeCore TypeSuffix* ;
TypeCore = Prim | Name | TupleType | 'void' | 'delegate' '*' ('managed' | 'unmanaged')? '<' Type (',' Type)* '>' ;
TupleType = '(' Type Id? (',' Type Id?)+ ')' ;
TypeSuffix = '?' | '*' | '[' ','* ']' ;
Prim = 'bool' | 'byte' | 'sbyte' | 'char' | 'decimal' | 'double' | 'float' | 'int' | 'uint' | 'long' | 'ulong' | 'object' | 'short' | 'ushort' | 'string' ;
Name = (Id '::')? Id TArgs? ('.' Id TArgs?)* ;
TArgs = '<' (Type (',' Type)* | ','*) '>' ;
Block = '{' BlockItem* '}' ;
BlockItem = Attr* LocalDecl ';' | Stmt | Attr* LocalFn ;
LocalDecl = ('const' | 'static' | 'await' | 'scoped')* 'using'? Type Declr (',' Declr)* | 'var' '(' Id (',' Id)* ')' '=' Expr ;
LocalFn = ('static' | 'async' | 'unsafe' | 'extern')* Type Id TParams? '(' Params? ')' Where* FnBody ;
Stmt = Block | ';' | ExprStmt ';' | Id ':' Stmt | 'if' '(' Expr ')' Stmt ('else' Stmt)? | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';' | 'for' '(' ForHead ')' Stmt
  | 'await'? 'foreach' '(' ('ref' 'readonly'?)? (Type Id | 'var'? '(' Pattern (',' Pattern)* ')') 'in' Expr ')' Stmt | 'switch' ('(' Expr ')' | Expr) '{' (CaseLabel+ BlockItem*)* '}' | 'return' ('ref'? Expr)? ';'
  | 'break' ';' | 'continue' ';' | 'goto' ('case' Expr | 'default' | Id) ';' | 'throw' Expr? ';' | 'try' Block Catch* ('finally' Block)? | 'lock' '(' Expr ')' Stmt
  | 'await'? 'using' '(' (LocalDecl | Expr) ')' Stmt | ('checked' | 'unchecked' | 'unsafe') Block | 'fixed' '(' Type Declr (',' Declr)* ')' Stmt | 'yield' ('return' Expr | 'break') ';' ;
Catch = 'catch' ('(' Type Id? ')')? ('when' '(' Expr ')')? Block ;
CaseLabel = ('case' Pattern ('when' Expr)? | 'default') ':' ;
ForHead = (LocalDecl | ExprStmt (',' ExprStmt)*)? ';' Expr? ';' (ExprStmt (',' ExprStmt)*)? ;
ExprStmt = ('++' | '--') Unary | 'await' Unary | Postfixed ('++' | '--' | AssignOp ('ref'? Expr | 'throw' Expr)) | Primary Selector* '(' Args? ')' | 'new' NewTail | Tuple '=' Expr | '*' Unary AssignOp Expr | '(' Type ')' Unary AssignOp Expr ;
Tuple = '(' TupleItem (',' TupleItem)+ ')' ;
TupleItem = (Id ':')? (Expr | Type Id) ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '??=' ;
Expr = Lambda | Query | Unary (BinOp (Unary | Lambda | 'throw' Expr) | ('is' | 'as') Pattern | '?' (Expr | 'throw' Expr) ':' (Unary | Lambda | 'throw' Expr) | 'switch' '{' (Arm (',' Arm)* ','?)? '}' | 'with' ObjInit | '..' Unary?)* | '..' Unary? | 'throw' Expr ;
Arm = Pattern ('when' Expr)? '=>' Expr ;
BinOp = AssignOp | '+' | '-' | '*' | '/' | '%' | '<<' | '>' '>' | '>' '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '^' | '|' | '&&' | '||' | '??' ;
Pattern = PatternUnary (('and' | 'or') PatternUnary)* ;
PatternUnary = 'not' PatternUnary | ('<' | '>' | '<=' | '>=') Unary | '(' Pattern (',' Pattern)* ')' | Type (Id | PosPattern? PropPattern? Id?) | 'var' (Id | '(' Id (',' Id)* ')') | PropPattern Id? | PosPattern PropPattern? Id?
  | '[' (Pattern (',' Pattern)*)? ','? ']' Id? | '..' Pattern? | Unary ;
PosPattern = '(' ((Id ':')? Pattern (',' (Id ':')? Pattern)*)? ')' ;
PropPattern = '{' (Id ('.' Id)* ':' Pattern (',' Id ('.' Id)* ':' Pattern)* ','?)? '}' ;
Unary = ('++' | '--' | '+' | '-' | '~' | '!' | '&' | '*' | '^' | 'await') Unary | '(' Type ')' (Unary | Lambda) | Postfixed ('++' | '--' | '!')* ;
Postfixed = Primary Selector* ;
Selector = ('.' | '?.' | '->' | '::') Id TArgs? | ('?'? '[' Args ']') | '(' Args? ')' | '!' ;
Primary = Id TArgs? | NUM | STR | CHR | 'true' | 'false' | 'null' | 'this' | 'base' | Prim | '(' Expr ')' | Tuple | 'new' NewTail | 'typeof' '(' Type ')' | 'sizeof' '(' Type ')' | 'default' ('(' Type ')')?
  | ('checked' | 'unchecked') '(' Expr ')' | 'stackalloc' Type? ('[' Expr? ']')? ArrayInit? | 'delegate' ('(' Params? ')')? Block | '[' (CollItem (',' CollItem)* ','?)? ']' ;
CollItem = '..'? Expr ;
NewTail = NewType ('(' Args? ')' ObjInit? | ObjInit) | NewType '[' Args ']' ('[' ','* ']')* ArrayInit? | NewType? ('[' ','* ']')+ ArrayInit | '{' (AnonItem (',' AnonItem)* ','?)? '}' | '(' Args? ')' ObjInit? ;
NewType = (Prim | Name | TupleType) '?'? ;
AnonItem = (Id '=')? Expr ;
ObjInit = '{' (InitItem (',' InitItem)* ','?)? '}' ;
InitItem = (Id | '[' Args ']') '=' (Expr | ObjInit) | Expr | '{' Args '}' ;
ArrayInit = '{' ((Expr | ArrayInit) (',' (Expr | ArrayInit))* ','?)? '}' ;
Args = Arg (',' Arg)* ;
Arg = (Id ':')? ('ref' Expr | 'in' Expr | 'out' (Expr | Type Id) | Expr) ;
Lambda = Attr* ('static' | 'async')* (Id | Type? '(' (LParam (',' LParam)*)? ')') '=>' (Block | 'ref'? Expr) ;
LParam = Param | Id ;
Query = 'from' Type? Id 'in' Expr QueryPart+ ;
QueryPart = 'from' Type? Id 'in' Expr | 'let' Id '=' Expr | 'where' Expr | 'join' Type? Id 'in' Expr 'on' Expr 'equals' Expr ('into' Id)? | 'orderby' Expr ('ascending' | 'descending')? (',' Expr ('ascending' | 'descending')?)* | 'select' Expr | 'group' Expr 'by' Expr | 'into' Id ;
"""

JAVASCRIPT = """
%context async await get set of let static from as yield target meta
Program = Item* ;
Item = Stmt | Import | Export ;
Import = 'import' (STR | ImportClause 'from' STR) ('with' Object)? @asi_or_semi_ ;
ImportClause = Id (',' (Star | Named))? | Star | Named ;
Star = '*' 'as' Id ;
Named = '{' (Spec (',' Spec)* ','?)? '}' ;
Spec = ModName ('as' ModName)? ;
ModName = Id | STR | Reserved ;
Export = 'export' ('*' ('as' ModName)? 'from' STR Semi | Named ('from' STR)? Semi | Decl | VarStmt | 'default' (Function | Class | Expr1 Semi)) ;
Semi = ';' | @asi ;
Stmt = Block | VarStmt | Decl | ';' | ExprStmt Semi | 'if' '(' Expr ')' Stmt ('else' Stmt)? | 'for' 'await'? '(' ForHead ')' Stmt | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'?
  | 'continue' Id? Semi | 'break' Id? Semi | 'return' Expr? Semi | 'with' '(' Expr ')' Stmt | 'switch' '(' Expr ')' '{' (('case' Expr | 'default') ':' Stmt*)* '}' | Id ':' Stmt | 'throw' Expr Semi
  | 'try' Block ('catch' ('(' Binding ')')? Block ('finally' Block)? | 'finally' Block) | 'debugger' Semi ;
Block = '{' Item* '}' ;
Decl = Function | Class ;
VarStmt = ('var' | 'let' | 'const') VarDecl (',' VarDecl)* Semi ;
VarDecl = Binding ('=' Expr1)? ;
Binding = Id | '[' (BindItem? ',')* BindItem? ']' | '{' (PropBind (',' PropBind)* ','?)? '}' ;
BindItem = '...'? Binding ('=' Expr1)? ;
PropBind = Id ('=' Expr1)? | PropName ':' BindItem | '...' Binding ;
ForHead = (('var' | 'let' | 'const') VarDecl (',' VarDecl)* | Expr)? ';' Expr? ';' Expr? | (('var' | 'let' | 'const') Binding | Unary) ('in' | 'of') Expr ;
Function = 'async'? 'function' '*'? Id? Params Block ;
Params = '(' (BindItem (',' BindItem)* ','?)? ')' ;
Class = Decorator* 'class' Id? ('extends' Unary)? '{' (ClassItem | ';')* '}' ;
Decorator = '@' (Id ('.' Id)* ('(' Args? ')')? | '(' Expr ')') ;
ClassItem = Decorator* 'static'? ('async'? '*'? PropName Params Block | ('get' | 'set') PropName Params Block | PropName ('=' Expr1)? Semi) | 'static' Block ;
PropName = Id | Reserved | STR | NUM | '[' Expr1 ']' ;
Expr = Expr1 (',' Expr1)* ;
Expr1 = Arrow | 'yield' ('*'? Expr1)? | Unary ExprTail ;
ExprStmt = Expr1NoBrace (',' Expr1)* ;
Expr1NoBrace = Arrow | 'yield' ('*'? Expr1)? | UnaryNoBrace ExprTail ;
UnaryNoBrace = PrefixOp Unary | PrimaryNoBrace Tail* ('++' | '--')? ;
PrefixOp = '++' | '--' | '+' | '-' | '~' | '!' | 'typeof' | 'void' | 'delete' | 'await' ;
ExprTail = (BinOp (Unary | Arrow) | '?' Expr1 ':' (Unary | Arrow) | AssignOp 'yield' ('*'? Expr1)?)* ;
Arrow = 'async'? (Id | Params) '=>' (Block | Expr1NoBrace | (Function | Class) Tail* ExprTail) ;
AssignOp = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '>>>=' | '**=' | '&&=' | '||=' | '??=' ;
BinOp = AssignOp | '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>>' | '>>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&' | '^' | '|' | '&&' | '||' | '??' | 'in' | 'instanceof' ;
Unary = PrefixOp Unary | Member ('++' | '--')? ;
Member = Primary Tail* ;
Tail = ('.' | '?.') (Id | Reserved) | '?.'? '[' Expr ']' | '?.'? '(' Args? ')' | Template | '?.' Template ;
Args = Arg (',' Arg)* ','? ;
Arg = '...'? Expr1 ;
Primary = PrimaryNoBrace | Object | Function | Class ;
PrimaryNoBrace = Id | NUM | STR | REGEX | Template | 'this' | 'super' | 'null' | 'true' | 'false' | '(' Expr ')' | Array | 'new' (Member | '.' 'target') | 'import' ('.' 'meta' | '(' Args ')') ;
Template = TPL_FULL | TPL_HEAD Expr (TPL_MID Expr)* TPL_TAIL ;
Array = '[' (Arg? ',')* Arg? ']' ;
Object = '{' (Prop (',' Prop)* ','?)? '}' ;
Prop = Id ('=' Expr1)? | PropName ':' Expr1 | '...' Expr1 | 'async'? '*'? PropName Params Block | ('get' | 'set') PropName Params Block ;
Reserved = 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'export' | 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new'
  | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' ;
""".replace("@asi_or_semi_", "Semi")

PHP = """
%context enum match readonly from self parent get set int float string bool array_ mixed never true false null iterable object void
File = (HTML | Item)* ;
Item = Stmt | Function | ClassDecl | 'namespace' (AnyName ';' | AnyName? Block) | 'use' ('function' | 'const')? UseItem (',' UseItem)* ';' | 'const' ConstItem (',' ConstItem)* ';' | '__halt_compiler' '(' ')' ';' ;
AnyName = Id | QNAME ;
UseItem = AnyName ('as' Id)? | QNAME '{' (('function' | 'const')? AnyName ('as' Id)? ','?)+ '}' ;
ConstItem = MemberId '=' Expr ;
Block = '{' (HTML | Item)* '}' ;
Body = Stmt ;
AltBody = ':' (HTML | Item)* ;
Stmt = Block | ';' | HTML | Expr ';' | 'echo' Expr (',' Expr)* ';' | 'if' '(' Expr ')' Body ('elseif' '(' Expr ')' Body)* ('else' Body)? | 'if' '(' Expr ')' AltBody ('elseif' '(' Expr ')' AltBody)* ('else' AltBody)? 'endif' ';'
  | 'while' '(' Expr ')' (Body | AltBody 'endwhile' ';') | 'do' Body 'while' '(' Expr ')' ';' | 'for' '(' Exprs? ';' Exprs? ';' Exprs? ')' (Body | AltBody 'endfor' ';')
  | 'foreach' '(' Expr 'as' (Ref '=>')? Ref ')' (Body | AltBody 'endforeach' ';') | 'switch' '(' Expr ')' ('{' ';'? Case* '}' | ':' HTML? ';'? Case* 'endswitch' ';')
  | 'break' NUM? ';' | 'continue' NUM? ';' | 'return' Expr? ';' | 'global' Var (',' Var)* ';' | 'static' StaticVar (',' StaticVar)* ';' | 'unset' '(' Exprs ','? ')' ';' | 'throw' Expr ';'
  | 'try' Block ('catch' '(' AnyName ('|' AnyName)* VAR? ')' Block)* ('finally' Block)? | 'goto' Id ';' | Id ':' | 'declare' '(' ConstItem (',' ConstItem)* ')' (Body | AltBody 'enddeclare' ';') ;
Case = ('case' Expr | 'default') (':' | ';') (HTML | Item)* ;
StaticVar = VAR ('=' Expr)? ;
Ref = '&'? Expr ;
Exprs = Expr (',' Expr)* ;
Attr = '#[' AttrItem (',' AttrItem)* ','? ']' ;
AttrItem = AnyName ('(' Args? ')')? ;
Function = Attr* 'function' '&'? Id Params ReturnType? Block ;
Params = '(' (Param (',' Param)* ','?)? ')' ;
Param = Attr* MemberMod* Type? '&'? '...'? VAR ('=' Expr)? HookBody? ;
ReturnType = ':' Type ;
Type = '?'? TypeAtom (('|' | '&') TypeAtom)* ;
TypeAtom = AnyName | 'array' | 'callable' | 'static' | '(' TypeAtom ('&' TypeAtom)+ ')' ;
MemberMod = 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'var' | 'readonly' ;
ClassDecl = Attr* ('abstract' | 'final' | 'readonly')* 'class' Id ClassTail | Attr* 'interface' Id ('extends' AnyName (',' AnyName)*)? Members | Attr* 'trait' Id Members | Attr* 'enum' Id (':' Type)? ('implements' AnyName (',' AnyName)*)? Members ;
ClassTail = ('extends' AnyName)? ('implements' AnyName (',' AnyName)*)? Members ;
Members = '{' Member* '}' ;
Member = Attr* MemberMod* ('function' '&'? MemberId Params ReturnType? (Block | ';') | 'const' Type? ConstItem (',' ConstItem)* ';') | Attr* MemberMod+ Type? PropItem (',' PropItem)* (';' | HookBody) | 'use' AnyName (',' AnyName)* (';' | '{' TraitRule* '}') | 'case' MemberId ('=' Expr)? ';' ;
HookBody = '{' (Attr* 'final'? '&'? ('get' | 'set') Params? (Block | '=>' Expr ';' | ';'))+ '}' ;
PropItem = VAR ('=' Expr)? ;
TraitRule = (AnyName '::')? MemberId ('insteadof' AnyName (',' AnyName)* | 'as' MemberMod? MemberId?) ';' ;
MemberId = Id | Keyword ;
Expr = Unary (BinOp Unary | '?' Expr? ':' Unary | 'instanceof' (AnyName | Unary))* ;
BinOp = '=' '&'? | '+=' | '-=' | '*=' | '/=' | '.=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**=' | '??=' | '+' | '-' | '*' | '/' | '%' | '.' | '**' | '<<' | '>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '<>' | '===' | '!==' | '<=>'
  | '&' | '^' | '|' | '&&' | '||' | '??' | 'and' | 'or' | 'xor' ;
Unary = ('++' | '--' | '+' | '-' | '~' | '!' | '@' | '&' | CAST | 'new_' | 'clone' | 'print' | 'include' | 'include_once' | 'require' | 'require_once' | 'throw') Unary | 'yield' (Expr ('=>' Expr)? | 'from' Expr)? | Postfixed ('++' | '--')? ;
Postfixed = Primary Tail* ;
Tail = '[' Expr? ']' | '{' Expr '}' | ('->' | '?->') (MemberId | Var | '{' Expr '}') | '::' (MemberId | Var | 'class' | '{' Expr '}') | '(' Args? ')' ;
Args = Arg (',' Arg)* ','? ;
Arg = (MemberId ':')? '...'? Expr | '...' ;
Var = VAR | '$' Var | '$' '{' Expr '}' ;
Primary = Var | AnyName | 'static' | 'array' | NUM | STR | '(' Expr ')' | ArrayLit | 'array' '(' Items ')' | 'list' '(' Items ')' | 'isset' '(' Exprs ','? ')' | 'empty' '(' Expr ')' | 'exit' ('(' Expr? ')')? | 'die' ('(' Expr? ')')? | 'eval' '(' Expr ')'
  | New | Closure | 'match' '(' Expr ')' '{' (Arm (',' Arm)* ','?)? '}' ;
New = 'new' (AnyName | 'static' | Var (('->' | '::') (MemberId | Var) | '[' Expr ']')* | '(' Expr ')') ('(' Args? ')')? | 'new' Attr* 'readonly'? 'class' ('(' Args? ')')? ClassTail ;
Closure = Attr* 'static'? ('function' '&'? Params ('use' '(' (UseVar (',' UseVar)* ','?)? ')')? ReturnType? Block | 'fn' '&'? Params ReturnType? '=>' Expr) ;
UseVar = '&'? VAR ;
ArrayLit = '[' Items ']' ;
Items = (ItemX? ',')* ItemX? ;
ItemX = '...' Expr | Expr ('=>' Ref)? | '&' Expr ;
Arm = (Exprs ','? | 'default') '=>' Expr ;
Keyword = 'class' | 'function' | 'echo' | 'if' | 'else' | 'elseif' | 'while' | 'for' | 'foreach' | 'switch' | 'case' | 'default' | 'break' | 'continue' | 'return' | 'global' | 'static' | 'unset' | 'throw' | 'try' | 'catch' | 'finally' | 'goto' | 'declare'
  | 'namespace' | 'use' | 'const' | 'abstract' | 'final' | 'interface' | 'extends' | 'implements' | 'trait' | 'public' | 'protected' | 'private' | 'var' | 'new' | 'clone' | 'print' | 'include' | 'require' | 'yield' | 'array' | 'list' | 'isset' | 'empty' | 'exit'
  | 'die' | 'eval' | 'fn' | 'and' | 'or' | 'xor' | 'do' | 'as' | 'instanceof' | 'callable' ;
"""

#: Before 3.0: statements ``print`` and ``exec``, old spellings of ``except``, ``raise``, ``!=``, numbers and strings.
PYTHON = """
%dialects python3 python2
Start = File ;
Id = Plain | @python3 ('print' | 'exec') | @python2 ('nonlocal' | 'async' | 'await') ;
Plain = IDENT | 'match' | 'case' | 'type' | '_' ;
File = (NEWLINE | Stmt)* ;
Stmt = Simple (';' Simple)* ';'? NEWLINE | Compound ;
Block = Simple (';' Simple)* ';'? NEWLINE | NEWLINE INDENT Stmt+ DEDENT ;
Simple = StarExprs | @python2 'print' (StarExprs | '>>' Expr (',' StarExprs)?)? | @python2 'exec' Expr ('in' Expr (',' Expr)?)? | @python2 'raise' Expr ',' Expr (',' Expr)? | Assignment | 'pass' | 'break' | 'continue' | 'return' StarExprs? | 'raise' (Expr ('from' Expr)?)? | 'global' Id (',' Id)* | @python3 'nonlocal' Id (',' Id)* | 'del' Target (',' Target)* ','? | 'assert' Expr (',' Expr)?
  | 'import' DottedAs (',' DottedAs)* | 'from' ('.' | '...')* Dotted? 'import' ('*' | ImportNames | '(' ImportNames ','? ')') | 'type' Id TypeParams? '=' Expr ;
ImportNames = Id ('as' Id)? (',' Id ('as' Id)?)* ;
DottedAs = Dotted ('as' Id)? ;
Dotted = Id ('.' Id)* ;
Assignment = (Targets '=')+ (StarExprs | Yield) | Single ':' Expr ('=' (StarExprs | Yield))? | Single AugOp (StarExprs | Yield) ;
AugOp = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
Single = Id | Sub | '(' Single ')' ;
Sub = Atom Trailer* LastSub ;
LastSub = '.' Id | '[' Slices ']' ;
Targets = StarTarget (',' StarTarget)* ','? ;
StarTarget = '*'? Target ;
Target = Id | Sub | '(' Targets? ')' | '[' Targets? ']' ;
Compound = Decorator* ((@python3 'async')? 'def' Id TypeParams? '(' Params? ')' ('->' Expr)? ':' Block | 'class' Id TypeParams? ('(' Args? ')')? ':' Block) | 'if' Named ':' Block ('elif' Named ':' Block)* ('else' ':' Block)?
  | 'while' Named ':' Block ('else' ':' Block)? | (@python3 'async')? 'for' Targets 'in' StarExprs ':' Block ('else' ':' Block)? | 'try' ':' Block (Except+ ('else' ':' Block)? ('finally' ':' Block)? | 'finally' ':' Block)
  | (@python3 'async')? 'with' (WithItem (',' WithItem)* | '(' WithItem (',' WithItem)* ','? ')') ':' Block | 'match' StarNamed ':' NEWLINE INDENT CaseBlock+ DEDENT ;
Decorator = '@' Named NEWLINE ;
Except = 'except' Caught? ':' Block ;
Caught = @python3 '*'? Expr (',' Expr)* ('as' Id)? | @python2 Expr (('as' | ',') Target)? ;
WithItem = Expr ('as' Target)? ;
CaseBlock = 'case' Patterns ('if' Named)? ':' Block ;
Patterns = Pattern (',' Pattern)* ','? ;
Pattern = '*' Id | OrPattern ('as' Id)? ;
OrPattern = ClosedPattern ('|' ClosedPattern)* ;
ClosedPattern = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | Dotted ('(' (PatArg (',' PatArg)* ','?)? ')')? | '(' Patterns? ')' | '[' Patterns? ']' | '{' (PatItem (',' PatItem)* ','?)? '}' ;
PatArg = (Id '=')? Pattern ;
PatItem = '**' Id | ('-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | Dotted) ':' Pattern ;
TypeParams = '[' TypeParam (',' TypeParam)* ','? ']' ;
TypeParam = ('*' | '**')? Id (':' Expr)? ('=' '*'? Expr)? ;
Params = PlainParams (',' '/' (',' PlainParams)?)? (',' StarParams)? ','? | PlainParams ',' '/' ',' StarParams ','? | StarParams ','? ;
PlainParams = Param (',' Param)* ;
StarParams = '*' (Id (':' '*'? Expr)?)? (',' Param)* (',' '**' Id (':' Expr)?)? | '**' Id (':' Expr)? ;
Param = Id (':' Expr)? ('=' Expr)? ;
StarExprs = StarExpr (',' StarExpr)* ','? | Yield ;
StarExpr = '*'? Expr ;
StarNamed = '*'? Named (',' ('*'? Named))* ','? ;
Yield = 'yield' ('from' Expr | StarExprs)? ;
Named = (Id ':=')? Expr ;
Expr = Lambda | Cmp ('if' Cmp 'else' Expr)? ;
Lambda = 'lambda' LParams? ':' Expr ;
LParams = LParam (',' LParam)* ','? ;
LParam = Id ('=' Expr)? | '*' Id? | '**' Id | '/' ;
Cmp = Unary (BinOp Unary)* ;
BinOp = 'and' | 'or' | '<' | '>' | @python2 '<>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ;
Unary = ('+' | '-' | '~' | 'not') Unary | @python3 'await' Unary | Atom Trailer* ;
Trailer = '.' Id | '(' Args? ')' | '[' Slices ']' ;
Slices = Slice (',' Slice)* ','? ;
Slice = Expr? ':' Expr? (':' Expr?)? | '*'? Named ;
Args = Arg (',' Arg)* ','? ;
Arg = Named CompFor? | Id '=' Expr | '*' Expr | '**' Expr ;
Str = STR | @python3 STRNEW | @python2 STROLD ;
Num = NUM | @python3 NUMNEW | @python2 NUMOLD ;
Atom = Plain | 'print' | 'exec' | @python2 ('nonlocal' | 'async' | 'await') | @python2 '`' StarExprs '`' | Num | Str+ | 'None' | 'True' | 'False' | '...' | '(' (Yield | StarNamed | Named CompFor)? ')' | '[' (StarNamed | Named CompFor)? ']' | '{' (Entry (',' Entry)* ','? | Entry CompFor | StarNamed | Named CompFor)? '}' ;
Entry = Expr ':' Expr | '**' Expr ;
CompFor = (@python3 'async')? 'for' Targets 'in' Cmp ('if' CompCond)* CompFor? ;
CompCond = (Id ':=')? (Cmp | Lambda) ;
"""
