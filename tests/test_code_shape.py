"""The analyser's work grows with the text, not with its square."""

import time

import pytest

from linewright.operators.code_shape import Shape
from linewright.operators.structure import _rows

KINDS = frozenset(["function", "class", "import", "deep"])
SHAPES = {
    "javascript": lambda n: "\n".join(f"const f{i} = async (a, b) => {{ return a + b }}" for i in range(n)),
    "typescript": lambda n: "class B {\n" + "\n".join(f"  private async m{i}(a: number): Promise<void> {{ x.map(y => y + 1); }}" for i in range(n)) + "\n}",
    "java": lambda n: "class A {\n" + "\n".join(f"  public static int m{i}(int a) throws E {{ return 2; }}" for i in range(n)) + "\n}",
    "c": lambda n: "\n".join(f"static int f{i}(int a) {{ for (;;) {{ }} return a; }}" for i in range(n)),
    "rust": lambda n: "\n".join(f"pub fn f{i}(a: i32) -> i32 {{ a }}\nstruct S{i} {{}}" for i in range(n)),
    "php": lambda n: "\n".join(f"public static function f{i}($a) {{ return $a; }}" for i in range(n)),
    "python": lambda n: "\n".join(f"class A{i}:\n    def f(self):\n        return 1" for i in range(n)),
    "go": lambda n: "\n".join(f"func F{i}(a int) int {{ return a }}" for i in range(n)),
}


@pytest.mark.parametrize("language", sorted(SHAPES))
def test_eight_times_the_text_is_about_eight_times_the_work(language):
    spent = []
    for n in (1500, 12_000):
        text = SHAPES[language](n)
        began = time.process_time()
        rows = list(_rows(Shape(text, language), KINDS, 4))
        spent.append(time.process_time() - began)
        assert sum(r["kind"] == "function" for r in rows) >= n
    assert spent[1] < 24 * spent[0] + 0.5


def test_brackets_that_never_close():
    began = time.process_time()
    Shape("(" * 200_000 + "]" * 200_000, "javascript")
    assert time.process_time() - began < 5
