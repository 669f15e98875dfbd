"""Plans that must not grow: no constant is copied into them, and nothing is extracted twice."""

from quarry.operators import corpus
from quarry.plans import tools


def test_index_project_plan(spark, sf):
    df = tools.index_project(spark, sf)
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    got = corpus.index_project(spark.createDataFrame([("a.py", "python", "def f():\n    g()\n")], "file_path string, language string, content string"))
    plan = got["relations"]._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract" not in plan and "Generate" not in plan


def test_nested_symbols(spark):
    """Ends by indentation: a definition reaches to the last line that is deeper."""
    text = "class A:\n  def f(self):\n    def g():\n      pass\n  def h(self):\n    pass\nx = 1\ndef k():\n  pass\n"
    got = {r.name: (r.start_line, r.end_line) for r in corpus.extract_symbols(spark.createDataFrame([("a.py", "python", text)], "file_path string, language string, content string")).collect()}
    assert got == {"A": (1, 6), "f": (2, 4), "g": (3, 4), "h": (5, 6), "k": (8, 9)}


SOURCES = {
    "rust": """use std::io;
/* fn hidden() {
} */
impl<T> Show for Thing<T> {
    fn show(&self) -> String {
        let s = "}}{"; // }
        format!("{}", '{')
    }
}
pub trait Named {
    fn name(&self) -> &'static str;
    fn twice(
        &self,
    ) -> String {
        x()
    }
}
mod inner { pub struct Unit; }
""",
    "python": """import os
import sys
X = 1
class A(Base):
    \"\"\"Doc
def not_this():
    \"\"\"
    def run(
        self,
    ):
        def helper():
            pass
        return {

}
def late(): return 1
""",
    "typescript": """export class Box {
  label = `a {
  b`;
  size() { return '{'; }
}
export interface Shape {
  area(): number;
}
function go() {
  if (x) {
    y();
  }
}
""",
    "go": "type Server struct {\n\tname string\n}\n\nfunc (s *Server) Run() error {\n\tfor {\n\t}\n}\n\nfunc main() {\n}\n",
    "java": "public class Main {\n    enum Kind { A, B }\n    interface Inner {\n        void f();\n    }\n}\n",
    "c": "struct point {\n    int x;\n};\nint add(int a, int b)\n{\n    return a + b;\n}\nint later(int a);\n",
    "cpp": "namespace geo {\nclass Shape {\npublic:\n    int area() {\n        return 1;\n    }\n};\n}\n",
    "swift": "protocol Runs {\n    func run()\n}\nfinal class Dog {\n    func bark() {\n        print(1)\n    }\n}\n",
    "dart": "abstract class Animal {\n  void speak() {\n    print('{');\n  }\n}\n",
    "kotlin": "package demo\n\ndata class P(val x: Int)\n\nfun main() {\n    println(\"{\")\n}\n",
    "objective_c": "@interface Foo\n- (void) bar;\n@end\n@implementation Foo\n- (void) bar {\n    x();\n}\n@end\n",
    "javascript": "export default function main() {\n  return '}';\n}\nclass K {\n}\n",
}
#: (name, kind, first line, last line, scopes around it)
WANT = {
    "rust": {("Thing", "impl", 4, 9, None), ("show", "function", 5, 8, "impl:Thing"), ("Named", "trait", 10, 17, None), ("name", "function", 11, 11, "trait:Named"), ("twice", "function", 12, 16, "trait:Named"), ("inner", "module", 18, 18, None)},
    "python": {("A", "class", 4, 15, None), ("run", "function", 8, 15, "class:A"), ("helper", "function", 11, 12, "class:A > fn:run"), ("late", "function", 16, 16, None)},
    "typescript": {("Box", "class", 1, 5, None), ("Shape", "interface", 6, 8, None), ("go", "function", 9, 13, None)},
    "go": {("Server", "class", 1, 3, None), ("Run", "method", 5, 8, None), ("main", "function", 10, 11, None)},
    "java": {("Main", "class", 1, 6, None), ("Kind", "enum", 2, 2, "class:Main"), ("Inner", "interface", 3, 5, "class:Main")},
    "c": {("point", "struct", 1, 3, None), ("add", "function", 4, 7, None)},
    "cpp": {("geo", "namespace", 1, 8, None), ("Shape", "class", 2, 7, "ns:geo")},
    "swift": {("Runs", "interface", 1, 3, None), ("run", "function", 2, 2, "iface:Runs"), ("Dog", "class", 4, 8, None), ("bark", "function", 5, 7, "class:Dog")},
    "dart": {("Animal", "class", 1, 5, None), ("speak", "function", 2, 4, "class:Animal")},
    "kotlin": {("demo", "module", 1, 1, None), ("P", "class", 3, 3, None), ("main", "function", 5, 7, None)},
    "objective_c": {("Foo", "class", 1, 3, None), ("bar", "method", 2, 2, "class:Foo"), ("Foo", "class", 4, 8, None), ("bar", "method", 5, 7, "class:Foo")},
    "javascript": {("main", "function", 1, 3, None), ("K", "class", 4, 5, None)},
}


def test_definitions_of_twelve_languages(spark):
    """Nested and multi-line declarations; brackets in strings and comments are none; what a comment holds is no definition."""
    df = spark.createDataFrame([(lang, lang, text) for lang, text in SOURCES.items()], "file_path string, language string, content string")
    got = {lang: set() for lang in SOURCES}
    for r in corpus.nodes(df).where("kind <> 'other'").collect():
        got[r.file_path].add((r.name, r.kind, r.start, r.end, r.path))
    assert got == WANT


def test_definition_chunks(spark):
    """Definitions and inner ones of open scopes, other runs of three lines, large ones cut, files without any by paragraphs."""
    big = "fn big() {\n" + "\n".join(f"    let _variable_{i:04} = {i} * {i} + {i};" for i in range(200)) + "\n}\n"
    texts = {"a.py": SOURCES["python"], "big.rs": big, "one.rs": "use std::io;\n\nfn hello() {\n    x();\n}\n", "note.rs": "// only\n// words here\n", "short.rs": "x"}
    df = spark.createDataFrame([(p, "python" if p.endswith("py") else "rust", t) for p, t in texts.items()], "file_path string, language string, content string")
    rows = corpus.definition_chunks(df).collect()
    of = lambda p: [(r.start_line, r.end_line, r.chunk_type, r.name, r.context_path) for r in sorted(rows, key=lambda r: r.chunk) if r.file_path == p]
    # a function inside a function is no chunk of its own
    assert of("a.py") == [(1, 3, "other", None, None), (4, 15, "class", "A", None), (8, 15, "function", "run", "class:A"), (16, 16, "function", "late", None)]
    assert of("big.rs") == [(1, 150, "other", "big", None), (151, 202, "other", "big", None)]
    assert of("one.rs") == [(3, 5, "function", "hello", None)] and len(of("note.rs")) == 1 and of("short.rs") == []
    for r in rows:
        if r.file_path != "note.rs":
            assert r.content == "\n".join(texts[r.file_path].split("\n")[r.start_line - 1 : r.end_line])
