"""Lines by their lexemes, complexity, scopes and signatures, on literal files."""

import pytest

from millrace.operators import lexer

PY = '''"""Module doc
over lines"""
import os  # why

class A:
    """Doc."""
    x = "# not a comment"

    class B:
        def go(
            self,
            a: int = len("a)b"),
        ) -> int:
            # if only
            if a and x or y:
                return """text
def no(): pass
"""

    def tail(self): return 1

if True:
    def loose(): pass
def top(
    a,
):
    x = [
1]
    def within(): pass
'''
RS = """/* block
   without stars
*/
pub mod outer { // trailing
    pub struct S<'a> { x: &'a str }
    impl<'a> S<'a> {
        fn go(
            &self,
            c: char, /* { */
        ) -> Vec<u8>
        {
            let s = "fn no() { // \\" } ";
            if c == '{' && true || false { for x in y { } }
        }
        fn sig(x: u8) -> u8;
    }
    trait T {
        fn need(&self);
    }
}
fn end() {}
"""
JS = """// one
export class K {
  /* a
  function no() {}
  */
  make() { return `x
function no2() {
`; }
}
export function run(a, b) { while (a) { if (b) {} } }
function
"""
C = """#include <a.h>
struct p {
  int x; /* } */
};
/* x */ int y = 1;

namespace n
{
class q {
};
}
"""
FILES = {"py": PY, "rs": RS, "js": JS, "cpp": C, "txt": "# words\n\nif x\n"}
STATS = {"py": (21, 4, 5, 4), "rs": (18, 3, 1, 4), "js": (7, 4, 1, 2), "cpp": (10, 0, 2, 0), "txt": (2, 0, 2, 0)}
SYMBOLS = {
    "py": [(5, "class", "A", None, None), (9, "class", "B", "A", None), (10, "method", "go", "A.B", '( self, a: int = len(""), ) -> int'), (20, "method", "tail", "A", "(self)"), (23, "function", "loose", None, "()"), (24, "function", "top", None, "( a, )"), (29, "function", "within", "top", "()")],
    "rs": [
        (4, "module", "outer", None, None), (5, "class", "S", "outer", None), (6, "implementation", "S", "outer", None), (7, "method", "go", "outer.S", "( &self, c: char, ) -> Vec<u8>"),
        (15, "method", "sig", "outer.S", "(x: u8) -> u8"), (17, "class", "T", "outer", None), (18, "method", "need", "outer.T", "(&self)"), (21, "function", "end", None, "()"),
    ],
    "js": [(2, "class", "K", None, None), (10, "function", "run", None, "(a, b)")],
    "cpp": [(2, "class", "p", None, None), (7, "module", "n", None, None), (9, "class", "q", "n", None)],
    "txt": [],
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(k, k, t) for k, t in FILES.items()], "file string, ext string, text string")


@pytest.mark.parametrize("ext", list(FILES))
def test_stats(files, ext):
    r = lexer.lexed_stats(files.where(files.file == ext), "file").first()
    assert (r["code"], r["comments"], r["blanks"], r["complexity"]) == STATS[ext]
    assert r["lines"] == FILES[ext].count("\n") + 1 == r["code"] + r["comments"] + r["blanks"] and r["bytes"] == len(FILES[ext].encode())


@pytest.mark.parametrize("ext", list(FILES))
def test_symbols(files, ext):
    rows = lexer.scoped_symbols(files, "file").where(f"file = '{ext}'").orderBy("line_no").collect()
    assert [tuple(r)[2:] for r in rows] == SYMBOLS[ext]


def test_hard_texts(spark):
    """Long strings of escapes, comments and strings without an end, null and empty texts."""
    texts = ["\\\"" * 50_000, "/* never ends\n" + "x\n" * 20_000, '"' + "a" * 200_000, None, "", "'" * 999, "}" * 50 + "\nfn a() {"]
    rows = spark.createDataFrame([(i, "rs", t) for i, t in enumerate(texts)], "file bigint, ext string, text string")
    got = {r["file"]: r for r in lexer.lexed_stats(rows, "file").collect()}
    assert got[1]["comments"] == 20_001 and got[1]["code"] == 0 and got[3]["lines"] == got[4]["lines"] == 1 and got[2]["code"] == 1
    assert [(r["file"], r["name"]) for r in lexer.scoped_symbols(rows, "file").collect()] == [(6, "a")]
