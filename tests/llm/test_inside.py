"""Expressions inside strings and all branches of conditional directives are parsed, too."""

import pytest

from tokenloom.llm.syntax.languages import check

VALID = {
    "Python": [
        "x = f'{ a!r }' 'b' f\"{c:{d}.{e}}\" 'z'", "f'{a=}{b = !r:>3}{c!=d}{(lambda: 1)()}{ {1: 2}[1] }{{x y}}'.join(y)", "f'''{\n a\n}''' ''", "x = (f'{a}'\n  'b' f'{f\"{c}\"}')[0]",
        "f'{yield}'", "f'\\N{DASH}{a}' rf'\\{b}'", "f'{x # why\n}'",
    ],
    "C#": [
        'class A { string s = $"{a,5:X} {{ }} {d["k"]} {(b ? "x" : "y")}".Trim(); }', 'class A { string s = $@"""{a}\n" + @$"\\{b}"; }', 'class A { string s = $$"""{x} {{a.B(1)}}"""; }',
        'class A { string s = $"{$"{a}"} {global::N.X}"; }', "#if A\nclass A {\n#else\nclass B {\n#endif\n}",
    ],
    "PHP": ["<?php $x = \"{$a[\"k\"]->b(1)} $c[0] $d[k] $e->f ${g} ${h['i']} \\{$j\";", "<?php $x = <<<'E'\n {$a b} \nE;\n", "<?php $x = '{$a b}' . `ls {$d}`;"],
    "C": [
        "#ifdef A\nint f(int x) {\n#else\nint f(void) {\n#endif\nreturn 1; }", "void f() {\n#ifdef A\nif (x) {\n#endif\ng();\n#if defined(A)\n}\n#endif\n}", "#if 0\nDon't read {\n#endif\nint a;",
        "#if A\nint a\n#elif B\nlong a\n#else\nchar a\n#endif\n;", "#if 1\nint a;\n#else\n)))\n#endif\n", "int f() {\n#if A\nreturn 1; }\n#endif\n#if !A\nreturn 2; }\n#endif\n",
        "#ifndef H_\n#define H_\nint a;\n#ifdef A\nint b;\n#endif\n#endif\n", "#if A\nint a =\n#elif 1\nint b =\n#else\nint c =\n#endif\n1;",
    ],
    "C++": ["#ifdef __cplusplus\nclass A {};\n#else\nint f(a) int a; {}\n#endif\n"],
}
BROKEN = {
    "Python": ["x = f'{a b c}'", "x = f'{}'", "f'{a:{b c}}'", "f'{a=1}'", "f'a}'", "f'{a'", "f'{f\"{a b}\"}'", "f'{x}' = 1", "rf'\\{b c}'", "print f'{x}'"],
    "C#": ['class A { string s = $"{a b c ;; }"; }', 'class A { string s = $"{}"; }', 'class A { string s = $$"""{x} {{a b}}"""; }', 'class A { string s = $"{$"{a a}"}"; }', 'class A { string s = $"{a"; }',
           "#if DEBUG\nclass A {}\n#else\nclass B { {{{\n#endif\n"],
    "PHP": ['<?php $x = "{$a b c";', '<?php $x = "{$a b c}";', '<?php $x = "$a[b c]";', "<?php $x = <<<E\n {$a b} \nE;\n", '<?php $x = "${h[1 2]}";'],
    "C": ["#ifdef A\nint a;\n#else\nint f( {\n#endif\n", "#ifdef A\nint f( {\n#else\nint a;\n#endif\n", "#ifdef A\nvoid f() { if (x) {\n#endif\ng();\n#ifdef A\n} }\n#endif\n", "#ifndef H_\n#define H_\n#ifdef A\nint a\n#endif\n#endif\n",
          "#if A\nint a;\n#elif B\nlong a )\n#else\nchar a;\n#endif\n", "#else\n#endif\n", "#if A\n#else\n#else\n#endif\n", "#if A\nint a;\n#elif B\nint a;\n#else\n<<<<<<< ours\n#endif\n"],
}


@pytest.mark.parametrize("language", VALID)
def test_valid(language):
    for text in VALID[language]:
        assert check(text, language).valid, (text, check(text, language))


@pytest.mark.parametrize("language", BROKEN)
def test_broken(language):
    for text in BROKEN[language]:
        assert check(text, language).valid is False, text


def test_branches_that_do_not_go_together():
    """Each is fine alone, and no choice reads both."""
    assert check("#ifdef A\nint a =\n#endif\n#ifdef B\nint b =\n#endif\n1;", "C").valid is False  # nothing defined: 1;
    both = "int a\n#ifdef A\n= 1\n#endif\n#ifdef B\n= 2\n#endif\n;"
    assert check(both, "C").valid


def test_dialects_run_together_and_do_not_mix():
    from tokenloom.llm.syntax.gll import Grammar, recognise

    g = Grammar("%dialects one two\nTop = Item* ; Item = @one 'a' | @two 'b' | 'c' Tail ; Tail = @one 'x' | @two 'y' | @one 'z' | @two 'z' ;")
    for text, want in {"": 3, "a": 1, "b": 2, "ab": 0, "cz": 3, "czcza": 1, "cxb": 0, "cybcz": 2, "czcxczb": 0}.items():
        place, accepted = recognise(g, [*(g.kinds[c] for c in text), 0])
        assert accepted == want and (place < 0) == bool(want), text
    for text, dialect in {
        "print 'x'\n": "python2", "print('x')\n": "python3", "print 'x'\nexcept_ = 0777\n": "python2", "f'{x}'\nprint(1)\n": "python3", "print 'x'\ny = f'{x}'\n": None, "nonlocal_ = ur'x'\nasync def f(): pass\n": None,
        "try:\n  pass\nexcept E, e:\n  print >>f, 1 <> 2\n": "python2", "x = rb'a'\nexec y\n": None, "async = 10L\n": "python2", "def print(): pass\n": "python3", "raise E, 'x'\nf(print=1)\n": None,
    }.items():
        assert check(text, "Python")[:2] == (dialect is not None, dialect), text
    assert check("int f(a) int a; { return a; }\ng() { }\nint h(void) { }", "C").dialect == "c89" and check("int h(void) { }", "C").dialect == "c17"
    assert check("#ifdef A\nint f(a) int a; { }\n#else\nint f(int a) { }\n#endif\n", "C").dialect == "c89"
