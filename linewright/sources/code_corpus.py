"""Valid source code in eleven languages around the text of a document, and what is in it.

The expected functions, classes, imports and deep lines are written down by hand next to each
text. They share nothing with the patterns that look for them. ``<ID>`` is the document's number,
``<NEXT>`` that of the next document in its language, and the line ``<DOC>`` is the
document's text inside a comment or string.
"""

from __future__ import annotations

DOC = "<DOC>"

SOURCES: dict[str, str] = {
    "ts": """import {
  a,
  b,
} from './s<NEXT>'; import type { T } from "lib"
import "side"
// import c from "no"
export class Box<ID><T> extends Base {
  constructor(private x: number, y = 2) { super() }
  static async load<ID>(
    url: string,
    opts: Map<string, number>
  ): Promise<void> {
    /*
<DOC>
    */
    if (a) { } if (b) { } if (c) { } if (d) { } if (url) {
      for (const x of opts) { while (x) { if (y) { if (z) { { go() } } } } }
    } else { stop() }
  }
  get size() { return this.items.map((i) => i.id) }
  handler = (k: string) => k
}
export const add = (p, q) => p + q, twice = async r => r
const run<ID> = function(a: any) { return a ? 1 : 2 }
const o = { key: async (p) => { return p }, act(q) { switch (q) { case 1: break } } }
function one() {} function two(): void {}
export default function main<U>(t: U): { a: number } {
  return t
}""",
    "js": """import x from './s<NEXT>'
import * as y from "lib"; import z from './s<NEXT>'
class Plain<ID> {
  #a = 1
  async *gen(a) { yield a }
  static set value(v) {
    /*
<DOC>
    */
  }
}
items.forEach(function (it) { if (it) { try { a() } catch (e) { b() } } })
var late = function named(x, { y, z }, ...rest) {
  return x || y
}
later(async () => {
  for (let i = 0; i < 3; i++) { continue }
})""",
    "tsx": """import React from 'react'
export interface Props { a: number; b(): void }
export function View<ID>({ a }: Props) {
  const click = useCallback((e) => { go(e) }, [])
  /*
<DOC>
  */
  return <div onClick={() => click(a)}>{a ? 1 : 2}</div>
}""",
    "py": """from .s<NEXT> import (
    x,
    y,
)
import os, sys as s, json  # c
from .. import up; import re
@decorated
class Box<ID>(Base):
    \"\"\"
<DOC>
    \"\"\"
    def run<ID>(
        self,
        a: int,
        b: dict = {"k": (1, 2)},
        *rest,
    ):
        if a:
            for x in b:
                pass
        elif b:
            return [1]

    async def stop(self): pass

# after
def outer(q, n=1):
    def inner():
        return q
    return inner
class Empty: pass""",
    "java": """package app;
import static com.app.F<ID>; import java.util.*;
public class Box<ID> extends Base implements Runnable
{
  private final Map<String, Integer> m = new HashMap<>();
  public Box<ID>(int a)
  {
    super(a);
  }
  int size() { return m.size(); }
  @Override
  public <T> List<T> run<ID>(Map<String, Integer> m, int[] a, final String... rest) throws IOException, Other {
    /*
<DOC>
    */
    if (a > 1) { new Thread() { public void go() { } }; } else { run(); }
    return call(a) ? null : list;
  }
  abstract void later(long b);
}
interface Api<ID> { void open(String s); }""",
    "go": """package main
import "os"
import (
  "./s<NEXT>"
  alias "fmt"
  // "no"
)
type Box<ID> struct {
  a int
}
type Num int
func (b *Box<ID>) Run<ID>(x, y int, s string) (int, error) {
  for i := 0; i < x; i++ {
    /*
<DOC>
    */
    switch s { case "a": return 1, nil }
  }
}
func Map<ID>[T any, U any](f func(T) U, xs []T) map[string]interface{} {
  return func() int { return 1 }
}""",
    "rs": """use super::{
    a,
    b,
};
pub use std::io; use self::s<NEXT>;
pub struct Box<ID><T> {
    a: T,
}
struct Unit;
impl<T> Box<ID><T> {
    pub fn run<ID>(&self, a: i32, b: Vec<(i32, i32)>) -> i32
    where T: Copy
    {
        /*
<DOC>
        */
        match a { 1 => 2, _ => 3 }
    }
}
impl Display for Box<ID><u8> {
    fn fmt<'a>(&self) { if a { loop { } } else { } }
}""",
    "c": """#include <stdio.h>
static int run<ID>(int a, char *b)
{
  /*
<DOC>
  */
  if (a) { do { a = a - 1; } while (a); } else { a = 'x'; }
  return f(a);
}
void stop(void) { for (;;) { } }""",
    "cpp": """#include <map>
class Box<ID> {
public:
  Box<ID>(int a) : a_(a) { }
  int size() const { return 1; }
};
int Box<ID>::run<ID>(std::map<int, int> m, int b) {
  /*
<DOC>
  */
  try { if (b) { } } catch (...) { }
  return b;
}""",
    "rb": """class Box<ID>
  def run<ID>(a, b = 1)
=begin
<DOC>
=end
    if a
      stop unless b
    end
  end
  def self.make
  end
end
def plain
  x = 1
end""",
    "php": """<?php
class Box<ID> {
  public static function run<ID>(array $a, $b = 1): ?int {
    /*
<DOC>
    */
    foreach ($a as $x) { if ($x) { } else { } }
  }
}
function plain() { return 1; }""",
}

#: (name, first line, last line, complexity, parameters), lines as in the text above.
FUNCTIONS: dict[str, list[tuple]] = {
    "ts": [
        ("constructor", 8, 8, 1, ["private x: number", "y = 2"]),
        ("load<ID>", 9, 19, 11, ["url: string", "opts: Map<string, number>"]),
        ("size", 20, 20, 1, []), ("<anonymous>", 20, 20, 1, ["i"]), ("<anonymous>", 21, 21, 1, ["k: string"]),
        ("add", 23, 23, 1, ["p", "q"]), ("twice", 23, 23, 1, []), ("run<ID>", 24, 24, 2, ["a: any"]),
        ("key", 25, 25, 1, ["p"]), ("act", 25, 25, 2, ["q"]), ("one", 26, 26, 1, []), ("two", 26, 26, 1, []),
        ("main", 27, 29, 1, ["t: U"]),
    ],
    "js": [
        ("gen", 5, 5, 1, ["a"]), ("value", 6, 10, 1, ["v"]), ("<anonymous>", 12, 12, 3, ["it"]),
        ("named", 13, 15, 1, ["x", "{ y, z }", "...rest"]), ("<anonymous>", 16, 18, 2, []),
    ],
    "tsx": [
        ("View<ID>", 3, 9, 2, ["{ a }: Props"]), ("<anonymous>", 4, 4, 1, ["e"]), ("<anonymous>", 8, 8, 1, []),
    ],
    "py": [
        ("run<ID>", 12, 22, 4, ["self", "a: int", "b", "*rest"]), ("stop", 24, 24, 1, ["self"]),
        ("outer", 27, 30, 1, ["q", "n"]), ("inner", 28, 29, 1, []),
    ],
    "java": [
        ("Box<ID>", 6, 9, 1, ["a"]), ("size", 10, 10, 1, []), ("run<ID>", 11, 18, 4, ["m", "a", "rest"]),
        ("go", 16, 16, 1, []), ("later", 19, 19, 1, ["b"]), ("open", 21, 21, 1, ["s"]),
    ],
    "go": [("Run<ID>", 12, 19, 3, ["x", "s"]), ("Map<ID>", 20, 22, 1, ["f", "xs"])],
    "rs": [
        ("run<ID>", 11, 18, 3, ["&self", "a: i32", "b: Vec<(i32, i32)>"]), ("fmt", 21, 21, 4, ["&self"]),
    ],
    "c": [("run<ID>", 2, 9, 5, ["int a", "char *b"]), ("stop", 10, 10, 2, ["void"])],
    "cpp": [
        ("Box<ID>", 4, 4, 1, ["int a"]), ("size", 5, 5, 1, []),
        ("run<ID>", 7, 13, 3, ["std::map<int, int> m", "int b"]),
    ],
    "rb": [("run<ID>", 2, 9, 3, ["a", "b"]), ("make", 10, 11, 1, []), ("plain", 13, 15, 1, [])],
    "php": [("run<ID>", 3, 8, 4, ["$a", "$b"]), ("plain", 10, 10, 1, [])],
}

#: (name, first line, last line, methods).
CLASSES: dict[str, list[tuple]] = {
    "ts": [("Box<ID>", 7, 22, ["constructor", "load<ID>", "size"])],
    "js": [("Plain<ID>", 3, 11, ["gen", "value"])],
    "py": [("Box<ID>", 8, 24, ["run<ID>", "stop"]), ("Empty", 31, 31, [])],
    "java": [("Box<ID>", 3, 20, ["Box<ID>", "size", "run<ID>", "later"]), ("Api<ID>", 21, 21, ["open"])],
    "go": [("Box<ID>", 8, 10, []), ("Num", 11, 11, [])],
    "rs": [("Box<ID>", 6, 8, []), ("Unit", 9, 9, []), ("Box<ID>", 10, 19, ["run<ID>"]), ("Box<ID>", 20, 22, ["fmt"])],
}

#: (line, place in the line, source, relative).
IMPORTS: dict[str, list[tuple]] = {
    "ts": [(1, 0, "./s<NEXT>", True), (4, 0, "lib", False), (5, 0, "side", False)],
    "js": [(1, 0, "./s<NEXT>", True), (2, 0, "lib", False), (2, 1, "./s<NEXT>", True)],
    "tsx": [(1, 0, "react", False)],
    "py": [(1, 0, ".s<NEXT>", True), (5, 0, "os", False), (5, 1, "json", False), (6, 0, "..", True), (6, 1, "re", False)],
    "java": [(2, 0, "com.app.F<ID>", False), (2, 1, "java.util", False)],
    "go": [(2, 0, "os", False), (4, 0, "./s<NEXT>", True), (5, 0, "fmt", False)],
    "rs": [(1, 0, "super::{\n    a,\n    b,\n}", True), (5, 0, "std::io", False), (5, 1, "self::s<NEXT>", True)],
}

#: Lines that open a block more than four deep in their function.
DEEP: dict[str, list[int]] = {"ts": [17]}


def _quoted(value: str) -> str:
    """A text with its marks as SQL for Spark and DuckDB alike."""
    out = value.replace("'", "'||chr(39)||'").replace("\n", "'||chr(10)||'")
    out = out.replace("<ID>", "'||doc_id||'").replace("<NEXT>", f"'||(doc_id+{len(SOURCES)})||'")
    return f"'{out}'"


def _content(source: str) -> str:
    before, _, after = source.partition(DOC)
    # What would end the comment or string that holds the text.
    text = "replace(replace(replace(text, '*/', '* /'), chr(34), ' '), chr(92), '/')"
    return f"{_quoted(before)}||{text}||{_quoted(after)}"


_CASES = " ".join(f"WHEN {i} THEN '{ext}'" for i, ext in enumerate(SOURCES))

SOURCE_FILES = f"""
SELECT CAST(floor(doc_id/20) AS BIGINT) AS review_id, doc_id AS file_id, 's'||doc_id||'.'||ext AS filename,
       CASE ext {" ".join(f"WHEN '{ext}' THEN {_content(source)}" for ext, source in SOURCES.items())} END AS content
FROM (SELECT doc_id, text, CASE doc_id%{len(SOURCES)} {_CASES} END AS ext FROM documents) d"""


def _list(values: list[str]) -> str:
    return f"CAST([{', '.join(_quoted(v) for v in values)}] AS VARCHAR[])"


def expected_step(kind: str, name: str = "expected") -> str:
    """DuckDB step ``name``: rows of a kind for every file, from the tables above.

    It needs a step ``code`` (the view with ``language``). Lines after the document's text move by its length.
    """
    tables = {
        "function": (FUNCTIONS, ("name", "a", "b", "complexity", "params", "part")),
        "class": (CLASSES, ("name", "a", "b", "methods")),
        "import": (IMPORTS, ("a", "part", "source", "is_relative")),
        "deep": (DEEP, ("a",)),
    }
    table, columns = tables[kind]
    arms = []
    step = name
    for ext, rows in table.items():
        at = SOURCES[ext].split("\n").index(DOC) + 1
        for part, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (row,)
            if kind == "function":
                row = (*row, part)
            cells = []
            for name, value in zip(columns, row):
                if name in ("a", "b"):
                    cells.append(f"{value}{' + n - 1' if value > at else ''} AS {name}")
                elif isinstance(value, list):
                    cells.append(f"{_list(value)} AS {name}")
                elif isinstance(value, bool):
                    cells.append(f"{str(value).lower()} AS {name}")
                elif isinstance(value, str):
                    cells.append(f"{_quoted(value)} AS {name}")
                else:
                    cells.append(f"{value} AS {name}")
            arms.append(f"SELECT review_id, file_id, filename, language, {', '.join(cells)} FROM {step}_lines WHERE ext = '{ext}'")
    return f"""{step}_lines AS (SELECT c.*, c.file_id AS doc_id, string_split(filename, '.')[-1] AS ext,
        length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS n
      FROM code c JOIN documents d ON d.doc_id = c.file_id),
    {step} AS ({" UNION ALL ".join(arms)})"""
