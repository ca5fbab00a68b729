"""The parser engine on small grammars, the dialects on valid and broken texts, and the operator's cases."""

import ast
import itertools
import random
import sysconfig
import warnings
from pathlib import Path

import pytest

from tokenloom.llm.syntax.gll import Grammar, recognise
from tokenloom.llm.syntax.languages import check, grammar
from tokenloom.llm.syntaxcheck import check_files, invalid_rates, latest_hint, repository_of


def _accepts(g, text):
    kinds = [g.kinds.get(c, -5) for c in text] + [0]
    return recognise(g, kinds)[0] < 0


@pytest.mark.parametrize(
    ("rules", "member"),
    [
        ("Top = Top 'a' | 'a' ;", lambda t: set(t) == {"a"}),
        ("Top = Top Top | 'a' | 'b' ;", lambda t: len(t) > 0),
        ("Top = 'a' Top 'b' | ;", lambda t: t == "a" * (len(t) // 2) + "b" * (len(t) // 2)),
        ("Top = Left 'b' | Right 'a' ; Left = 'a'* ; Right = 'a'+ 'b'? ;", lambda t: (t.endswith("b") and set(t[:-1]) <= {"a"}) or (t.endswith("a") and len(t) > 1 and set(t[:-2]) <= {"a"} and (t[-2] == "a" or (len(t) > 2 and t[-2] == "b")))),
        ("Top = ('a' | 'b' 'a')* 'b'? ;", lambda t: "bb" not in t),
    ],
)
def test_small_languages(rules, member):
    g = Grammar(rules)
    for n in range(7):
        for t in itertools.product("ab", repeat=n):
            assert _accepts(g, "".join(t)) == bool(member("".join(t))), t


def test_palindromes_and_deep_nesting():
    g = Grammar("Top = 'a' Top 'a' | 'b' Top 'b' | 'a' | 'b' | ;")
    for n in range(8):
        for t in itertools.product("ab", repeat=n):
            assert _accepts(g, t) == (t == t[::-1])
    assert check("(" * 50_000 + "1" + ")" * 50_000, "Python").valid
    assert check("x = " + "{" * 20_000 + "}" * 20_000, "JavaScript").valid is False
    assert check("x = " + "[" * 20_000 + "]" * 20_000, "JavaScript").valid


VALID = {
    "C": ["int main(void) { return 0; }", "#include <a.h>\n#define X(a) \\\n a\nstruct s { int a : 3, *b[2]; } v = { .a = 1 };", "typedef long (*f)(int, ...); f g; static void h(f x) { for (;;) { if (*x) goto e; else (void)0; } e: ; }",
          "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint f(a, b) int a; char *b; { return a ? sizeof(int) : b[0]; }\n", "char c = '\\''; // } \n/* } */ const char *s = \"}\" \"{\";", ""],
    "C++": ["#include <vector>\ntemplate <typename T> class A { public: std::vector<T> x; };\nint main() { std::cout << 1 << std::endl; }", "auto s = R\"(<<<<<<< {{ )\"; auto t = R\"x( )\" )x\";", "int f() { std::map<int, std::vector<int>> m; for (auto& [k, v] : m) { m[k](v) ; } return a < b > (c); }",
            "namespace a::b { struct S : public T<3> { explicit S(int x) : y{x}, T<3>(x) {} ~S() = default; bool operator==(const S& o) const noexcept { return y == o.y; } int y = 0; }; }", "auto l = [&, x = 1](int a) mutable -> int { return a + x; };"],
    "Java": ["package a.b;\nimport java.util.*;\npublic class A<T extends B & C> { int[] x = {1, 2}; static <U> void f(List<? super U> l) throws E { for (var y : l) { g(y -> y.h(A::new)); } } }",
             "class A { int f(Object o) { return switch (o) { case Integer i when i > 3 -> i; case String s -> { yield 2; } default -> throw new E(); }; } }", "enum E implements I { A(1) { void f() {} }, B; E() {} }\nrecord P(int x, String... y) {}\n@interface Q { int v() default 3; }",
             "class A { String s = \"\"\"\n  }}} \"quoted\"\n  \"\"\"; char c = '}'; void f() { if (a < b && c > d) x = (int) y >>> 2; new int[3][]; } }".replace("new int[3][];", "int[][] q = new int[3][];")],
    "C#": ["using System;\nnamespace N { class A { public static long F(int a) { Console.WriteLine(\"x \" + (a)); return a; } } }", "string s = @\"a\"\"b\\\"; var t = $\"{a} {{ {b:X} }}\"; Console.WriteLine(s);", "class A<T> : B, I<T> where T : class, new() { public int X { get; private set; } = 3; public int this[int i] => i; event Action E; A() : base(1) {} }",
           "record P(int X, string Y = \"a\"); class Q { object F(object o) => o switch { P { X: > 3 } p => p, null => 1, _ => throw new E() }; }", "#region x\nclass A { void F() { foreach (var (k, v) in d) yield return k; if (x is not null and { Y: 1 }) lock (this) { } var q = from a in b where a > 1 select new { a }; } }\n#endregion"],
    "JavaScript": ["const f = (a, b) => { let r = /[({]+v/g; return `x ${a + `${b}`} }`; };", "async function* g() { for await (const x of y) yield* x\n}\nclass A extends B { #p = 1; static get x() { return this.#p } constructor(...a) { super(...a) } }", "import a, { b as c } from 'x'\nexport default class {}\nexport * as q from \"y\"",
                   "a = b\nc = d / e / f\nx\n++y\nif (a) b\nelse c\ndo x(); while (y) z()", "var { a, b: [c = 1], ...d } = e ?? f?.g?.[0]?.(1); label: for (;;) { continue label }"],
    "PHP": ["<?php\nfunction f($a, ?int &...$b): ?array { return [...$a, 'k' => $b[0]]; }\n?>\n<b><?= $x ?></b>", "<?php\n$s = <<<EOT\n<<<<<<< HEAD\n}\nEOT;\n$t = <<<'X'\n  a\n  X;\necho 'a', $s;", "plain html only", "<?php\nnamespace A\\B;\nuse C\\{D, E as F};\nabstract class G extends D implements F { use H; const X = 1; public function __construct(private readonly int $x = 1) {} abstract function y(); }",
            "<?php if ($a): ?> x <?php elseif ($b): echo 1; else: ?> y <?php endif; foreach ($a as $k => [$x, $y]) { $f = fn($x) => $x ** 2; } echo match(true) { $a, $b => 1, default => 2 };"],
    "Python": ["def f(a, /, b: int = 1, *c, d, **e) -> x:\n    return [i async for i in y if z]\n", "print 'x'\nexec \"y\" in z\n", "match x:\n    case [1, *r] | {'a': b}: pass\n", "if x:\n\ty\nelse:\n        z\n", "x = (1,\n2)\n@d\nclass A(B, metaclass=C): z: int = 3; y", "try:\n  pass\nexcept* A as e: raise B from e\n", "{\n  \"a\": [1, 2],\n  \"b\": {\"c\": None}\n}\n", "f'{a['b']!r:>{w}}'\n"],
}
BROKEN = {
    "C": ["int main(void) { return 0;", "<<<<<<< ours\nint a;\n", "std::cout << 1;", "int f() { int x = 'a; }", "# A title\n\nSome words here.\n", "int a = 12ab;", "#if 1\nint a;\n", "class A {};", "/* open\nint a;", "long f(int a) { return a }"],
    "C++": ["using System;\nclass A { }", "int f() { return 1; }}", "public class A { }", "int f() { if (x { } }", "auto s = R\"(x;", "template <typename T class A {};", "int f() {\n=======\n}\n"],
    "Java": ["using System;\nclass A { }", "#include <stdio.h>\nint main() {}", "class A { void f() { int x = ; } }", "class A { char c = 'ab'; }", "class A { void f() { x = 1 } }", "public static long f(int a) { return a; }", "class A {\n<<<<<<< HEAD\n}", "class A { String s = \"open; }"],
    "C#": ["import java.util.*;\nclass A { }", "class A { void F( { } }", "class A { public F { get } }", "#include <stdio.h>", "function f(a, b) { }", "class A { char c = 'ab'; }", "namespace N {\n=======\n}", "class A { long F() { return 1 } }"],
    "JavaScript": ["int v = 3;", "function f( { }", "const x = `open ${a}", "var s = 'open\n';", "a b", "<?php echo 1;", "function f() {\n>>>>>>> x\n}", "{ \"a\": 1, \"b\": 2 }", "for (let i = 0; i < 3, i++) {}", "x = /open\n/;"],
    "PHP": ["<?php\nfunction f( { }", "<?php $a = ;", "<?php\n<<<<<<< ours\necho 1;", "<?php echo 'open;", "<?php $s = <<<EOT\nx\n", "<?php class { }", "<?php if ($a) { ", "<?php def f(a):\n  return a"],
    "Python": ["def f(:\n  pass", "if x:\npass", "x = 0128", "  x = 1", "x = 'open", "a b", "<<<<<<< HEAD\n", "def f():\n\tx\n        y\n", "f(a=1, b c)", "class A:\n", "return (1 - a", "x = 1 // 2 //", "1 = x", "f() = 3"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    for text in VALID[language]:
        assert check(text, language).valid, (text, check(text, language))


@pytest.mark.parametrize("language", BROKEN)
def test_broken(language):
    for text in BROKEN[language]:
        assert check(text, language).valid is False, text


def test_dialects_are_named():
    assert check("print 'x'\n", "Python").dialect == "python2"
    assert check("print('x')\n", "Python").dialect == "python3"
    assert check("main() { }", "C").dialect == "c89"


def test_python_against_its_own_parser():
    warnings.simplefilter("ignore")
    rng = random.Random(4)
    for file in sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py"))[:60]:
        text = file.read_text(encoding="utf-8")
        cut = rng.randrange(len(text) + 1)
        for part in (text, text[:cut], text[text.rfind("\n", 0, cut) + 1 :][:2000]):
            try:
                ast.parse(part)
                want = True
            except (SyntaxError, ValueError):
                want = False
            v = check(part, "Python")
            assert v.valid == want or v.dialect == "python2", (file.name, v)


def test_time_is_linear():
    assert check("int x;\nlong f(int a) { return a * (a + 1); }\n" * 20_000, "C").valid


def test_operator(spark, rows):
    data = [("Python", "1", "x = 1"), (" PYTHON", "2", "x ="), ("Python", "3", None), ("Python", "4", ""), ("Python", "5", " \n\t"), ("Cobol", "6", "x"), (None, "7", "x"), ("c++", "8", "int x;"), ("c++", "8", "int x;")]
    df = spark.createDataFrame([(*d, "clash") for d in data], "language string, id string, code string, valid string")
    got = check_files(df.select("language", "id", "code", "valid"), ["language", "id"], "language", "code")
    assert rows(got.select("id", "valid")) == sorted([("1", True), ("2", False), ("3", None), ("4", None), ("5", None), ("6", None), ("7", None), ("8", True), ("8", True)], key=repr)
    assert check_files(df.limit(0), ["id"], "language", "code").count() == 0


def test_rates(spark, rows):
    files = spark.createDataFrame([("a/b", "C", "1", True), ("a/b", "C", "2", False), ("a/b", "C", "3", None), (None, "C", "4", None)], "repository string, language string, id string, valid boolean")
    parses = spark.createDataFrame([("C", "1", 1, "v1", "ok"), ("C", "1", 2, "v2", "error"), ("C", "2", 1, "v1", "parsed_with_errors"), ("C", "2", 1, "v1", "parsed_with_errors")], "language string, id string, parsed_at int, parser_version string, status string")
    got = invalid_rates(files, ["repository", "language"], latest_hint(parses, ["language", "id"]), ["language", "id"])
    assert rows(got) == sorted([("a/b", "C", 3, 2, 1, 0.5, 1), (None, "C", 1, 0, 0, None, 0)], key=repr)


def test_repository(spark):
    data = ["a/b/c.py", "./a/b/c.py", "a\\b\\c.py", "././a//b/c", "c.py", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, p) for i, p in enumerate(data)], "i int, p string").orderBy("i").select(repository_of(__import__("pyspark").sql.functions.col("p"))).collect()]
    assert got == ["a/b", "a/b", "a/b", "a/b", None, None, None]


def test_grammars_compile_without_unused_rules():
    for name in ("C", "CPP", "JAVA", "CSHARP", "JAVASCRIPT", "PHP", "PYTHON"):
        assert len(grammar(name).op) > 500
