"""Symbols, relations and comments of sources in three languages, against results made by hand."""

from __future__ import annotations

import pytest

from tracegrove.functions import source_code as C
from tracegrove.operators import graph
from tracegrove.plans.lanes import build_graph

JAVA = '''package a;
/* a block comment
   with class Fake { } */
@Ann(value = "x")
public final class Foo<T extends Bar> extends base.Parent<T> implements One, two.Two {
  // line comment with { brace
  private String s = "class Not { void no() { } }";
  char c = '{';
  @Override public void run(int x,
      Map<String, Integer> y) throws IOException {
    helper(x); obj.call().chain(1);
    if (x > 0) { other.deep.last(); }
    Runnable r = new Thread() { public void inner() { insideCall(); } };
  }
  static int helper(int y) { return y; }
  abstract void none(int z);
  String t = """
    void block() { "quoted" }
    """;
  enum Kind { A, B }
}
'''
CPP = '''#include <x>
#define M(x) { x
namespace n {
class Dog : public Animal, private zoo::Base {
 public:
  Dog(int a) : x_(a), y_(make(a)) { start(); }
  ~Dog() { stop(); }
  int bark(const std::string& s) const override { return std::max(len(s), R"x(class Q { )x"); }
};
int Dog::run() { return this->bark("}"); } // tail of the file
template <class T> T twice(T v) { return v * two(); }
}
'''
PYTHON = '''"""doc: class Fake: pass"""
# a comment of some length
class Cat(Animal, mod.Base, metaclass=Meta):
    """class Inner(X): def no(self): call()"""
    async def speak(self, x,
                    y="def z(): no()"):
        self.tail(x)  # wag
        return noise(
            other(y)
        )

    def one(self): return single()
def top(): pass
x = top()
'''
WANT = {
    "Foo.java": (
        [("Class", "Foo", 5, 21, ""), ("Method", "run", 9, 14, "run(int x, Map<String, Integer> y)"), ("Method", "inner", 13, 13, "inner()"), ("Method", "helper", 15, 15, "helper(int y)"), ("Class", "Kind", 20, 20, "")],
        {("INHERITS", "Foo", "Parent"), ("INHERITS", "Foo", "One"), ("INHERITS", "Foo", "Two"), ("MEMBER_OF", "run", "Foo"), ("MEMBER_OF", "inner", "Foo"), ("MEMBER_OF", "helper", "Foo"), *(("CALLS", "run", c) for c in ("helper", "call", "chain", "last")), ("CALLS", "inner", "insideCall")},
        [(2, "/* a block comment\n   with class Fake { } */"), (6, "// line comment with { brace")],
    ),
    "dog.cpp": (
        [("Class", "Dog", 4, 9, ""), ("Method", "Dog", 6, 6, "Dog(int a)"), ("Method", "Dog", 7, 7, "Dog()"), ("Method", "bark", 8, 8, "bark(const std::string& s)"), ("Method", "run", 10, 10, "run()"), ("Method", "twice", 11, 11, "twice(T v)")],
        {("INHERITS", "Dog", "Animal"), ("INHERITS", "Dog", "Base"), ("MEMBER_OF", "Dog", "Dog"), ("MEMBER_OF", "bark", "Dog"), ("CALLS", "Dog", "start"), ("CALLS", "Dog", "stop"), ("CALLS", "bark", "max"), ("CALLS", "bark", "len"), ("CALLS", "run", "bark"), ("CALLS", "twice", "two")},
        [(10, "// tail of the file")],
    ),
    "cat.py": (
        [("Class", "Cat", 3, 12, ""), ("Method", "speak", 5, 10, 'speak(self, x, y = "def z(): no()")'), ("Method", "one", 12, 12, "one(self)"), ("Method", "top", 13, 13, "top()")],
        {("INHERITS", "Cat", "Animal"), ("INHERITS", "Cat", "Base"), ("MEMBER_OF", "speak", "Cat"), ("MEMBER_OF", "one", "Cat"), *(("CALLS", "speak", c) for c in ("tail", "noise", "other")), ("CALLS", "one", "single")},
        [(2, "# a comment of some length"), (7, "# wag")],
    ),
}
TEXTS = {"Foo.java": JAVA, "dog.cpp": CPP, "cat.py": PYTHON}


@pytest.mark.parametrize("path", sorted(WANT))
def test_three_languages(path):
    s = C.parse(TEXTS[path], C.language_of(path))
    symbols, relations, comments = WANT[path]
    assert [(b.kind, b.name, b.start, b.end, b.signature) for b in s.blocks] == symbols
    found = {r[:3] for r in C.relations(s, path)}
    assert {r for r in found if r[0] != "DEFINED_IN"} == relations
    assert {(r[1], r[2]) for r in found if r[0] == "DEFINED_IN"} == {(x[1], path) for x in symbols}
    assert s.comments == comments and s.whole


@pytest.mark.parametrize(
    ("language", "text", "whole"),
    [
        ("java", "", True), ("java", "class A { void f() {", False), ("java", "}", False), ("java", "/* open", True), ("java", 'class A { String s = "open\n; }', True), ("cpp", 'auto x = R"(never closed {', True),
        ("python", "def f(:\n  pass", False), ("python", '"""open', True), ("python", "class A:\n\tdef b(self):\n\t\tc()\n", True), ("cpp", "é = {1, 2};", True), ("java", "\x00\x01{}", True),
    ],
)
def test_odd_sources(language, text, whole):
    s = C.parse(text, language)
    assert s.whole is whole and all(1 <= b.start <= b.end for b in s.blocks)


def test_files_are_parsed_on_workers(spark, tmp_path):
    rows = [(k, "r", path, text) for k, (path, text) in enumerate(TEXTS.items())] + [(8, "r", "x.txt", "class No { }"), (9, "r", "n.java", None)]
    files = spark.createDataFrame(rows, "doc_id long, repo string, path string, content string")
    got = sorted(map(tuple, graph.extract_symbols(files).collect()))
    assert got == sorted((kind, name, path, a, b, sig) for path, (symbols, _, _) in WANT.items() for kind, name, a, b, sig in symbols)
    density = {r["path"]: r["density"] for r in graph.by_density(files).collect()}
    assert density["Foo.java"] == round(sum(len(t) for _, t in WANT["Foo.java"][2]) / len(JAVA), 6) and density["cat.py"] == round(26 / len(PYTHON), 6) and density["x.txt"] == density["n.java"] == 0
    build_graph(files, str(tmp_path / "graph"))
    edges = {tuple(r) for r in spark.read.parquet(str(tmp_path / "graph/edges")).collect()}
    assert {("symbol:run", "symbol:helper", "CALLS"), ("symbol:Foo", "file:0", "DEFINED_IN"), ("symbol:Cat", "symbol:Base", "INHERITS")} <= edges
    broken = spark.createDataFrame([(1, "r", "a.java", "class A {"), (2, "r", "b.java", "class B { }")], "doc_id long, repo string, path string, content string")
    with pytest.raises(RuntimeError, match="1 of 2"):
        build_graph(broken, str(tmp_path / "broken"))
