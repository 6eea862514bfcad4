import pytest

from tallyglass.kernels import declarations as decl
from tallyglass.kernels import slices as sl

GO = """package x

// func Commented() {}
const Alpha, Beta = 1, 2
var gamma = "func Fake() {"

type Store struct {
	name string
}

type Reader interface {
	Read() error
}

type ID int

func (s *Store) Get(k string) (string, error) {
	if err := s.check("}"); err != nil {
		return "", err
	}
	return k, nil
}

func New() *Store {
	return &Store{}
}
"""
JAVA = """public class Box<T> extends Base {
    private final int n; // class Hidden {}
    public Box(int n) { this.n = n; }
    @Override
    public String name(List<String> xs) throws IOException {
        if (n > 1) { return "x}"; }
        return null;
    }
    interface Part { void go(); }
    enum Kind { A, B }
}
"""
TS = """export interface Shape { area(): number }
export type Name = string;
enum Color { Red }
export default class Circle implements Shape {
  private r = 1;
  constructor(r: number) { this.r = r; }
  area(): number {
    return `${this.r}}`.length;
  }
}
export async function main(a: string): Promise<void> { return; }
const LIMIT = 3;
"""
RUST = """pub struct Point { x: i32 }
impl Point {
    pub fn new(x: i32) -> Self { Point { x } }
    fn hidden(&self) -> char { '}' }
}
pub trait Draw {
    fn draw(&self);
}
enum E { A }
type T = u8;
const N: u8 = 1;
fn free<'a>(s: &'a str) -> &'a str { s }
"""
CPP = """class Widget : public Base {
 public:
  int size() const { return n_; }
 private:
  int n_;
};
struct Pod { int a; };
enum class Mode { On, Off };
int Widget::total(int k) { return k; }
int main() { return 0; }
"""
PY = '''import os

class A(Base):
    """def fake(): pass"""
    def __init__(self):
        self.x = 1

    async def go(self):
        def inner():
            return 1
        return inner

def top(a,
        b):
    return a
'''


def _names(text, language):
    return [(s.type, s.name, s.container) for s in decl.symbols(text, language)]


def test_go():
    assert _names(GO, "go") == [
        ("constant", "Alpha", ""), ("constant", "Beta", ""), ("variable", "gamma", ""), ("struct", "Store", ""), ("interface", "Reader", ""), ("type", "ID", ""),
        ("method", "Get", "Store"), ("function", "New", ""),
    ]
    get = next(s for s in decl.symbols(GO, "go") if s.name == "Get")
    assert (get.start_line, get.end_line) == (17, 22) and GO[get.start : get.end].endswith("nil\n}")


def test_java():
    assert _names(JAVA, "java") == [("class", "Box", ""), ("constructor", "Box", "Box"), ("method", "name", "Box"), ("interface", "Part", "Box"), ("method", "go", "Part"), ("enum", "Kind", "Box")]


def test_typescript_and_javascript():
    assert _names(TS, "typescript") == [
        ("interface", "Shape", ""), ("type", "Name", ""), ("enum", "Color", ""), ("class", "Circle", ""), ("method", "constructor", "Circle"), ("method", "area", "Circle"), ("function", "main", ""), ("constant", "LIMIT", ""),
    ]
    assert ("interface", "Shape", "") not in _names(TS, "javascript")


def test_rust():
    assert _names(RUST, "rust") == [
        ("struct", "Point", ""), ("impl", "Point", ""), ("method", "new", "Point"), ("method", "hidden", "Point"), ("trait", "Draw", ""), ("method", "draw", "Draw"), ("enum", "E", ""), ("type", "T", ""), ("constant", "N", ""), ("function", "free", ""),
    ]


def test_cpp():
    assert _names(CPP, "cpp") == [("class", "Widget", ""), ("method", "size", "Widget"), ("struct", "Pod", ""), ("enum", "Mode", ""), ("function", "total", ""), ("function", "main", "")]


def test_python():
    assert _names(PY, "python") == [("class", "A", ""), ("function", "__init__", "A"), ("function", "go", "A"), ("function", "inner", "A"), ("function", "top", "")]
    with pytest.raises(SyntaxError):
        decl.symbols("def (", "python")
    with pytest.raises(SyntaxError):
        decl.symbols("- " * 200000 + "x", "python")


def test_markup():
    html = "<!DOCTYPE html><div id='a>b'>\n<br><p>x</p><script>if (a<b) {}</script></div>"
    assert [(s.type, s.name, s.container) for s in decl.symbols(html, "html")] == [("element", "div", ""), ("element", "br", "div"), ("element", "p", "div"), ("script", "script", "div")]
    assert [s.name for s in decl.symbols("<a><B/><!-- <c> --></a>", "xml")] == ["a", "B"]
    assert decl.symbols("anything", "cobol") == []


def test_go_groups_and_nested_fields():
    text = "package x\n\nconst (\n\tA = iota // one\n\tB, b2 = 1,\n\t\t2\n)\nvar (\n\tc = \"x\"\n\td map[string]int\n)\ntype (\n\tP struct {\n\t\tinner struct {\n\t\t\tx int\n\t\t}\n\t}\n\tQ[T any] interface{ Do() T }\n\tR [5]int\n\tS = int\n)\nfunc F(a int) interface{} {\n\tvar k = 1\n\treturn k\n}\n"
    assert _names(text, "go") == [
        ("constant", "A", ""), ("constant", "B", ""), ("constant", "b2", ""), ("variable", "c", ""), ("variable", "d", ""), ("struct", "P", ""), ("interface", "Q", ""), ("type", "R", ""), ("function", "F", ""), ("variable", "k", ""),
    ]
    spans = {s.name: text[s.start : s.end] for s in decl.symbols(text, "go")}
    assert spans["B"] == "B, b2 = 1,\n\t\t2" and spans["d"] == "d map[string]int" and spans["F"].endswith("return k\n}") and spans["P"].startswith("P struct") and spans["P"].endswith("\t}")
    assert [(c.node_type, c.start_line, c.end_line) for c in decl.chunks(text, "go")] == [("type", 12, 21), ("function", 22, 25)]


def test_members_on_one_line_and_annotations():
    java = "class A { A() {} @Override public @Nullable String get() { return f(1); } int[] xs(int a) { if (a > 1) { g(); } return null; } }"
    assert _names(java, "java") == [("class", "A", ""), ("constructor", "A", "A"), ("method", "get", "A"), ("method", "xs", "A")]
    anonymous = "class B {\n  Runnable r = new Runnable() {\n    public void run() { go(); }\n  };\n}"
    assert ("method", "run", "B") in _names(anonymous, "java")
    js = "class C { a() { return 1 } static async b(x = {y: 1}) { if (x) { z(x) } } }\nconst f = (a) => {\n  let q = a\n  return q\n}, g = 2\nfoo(() => { bar() })\nvar s = /[{]/, t = 1\n"
    assert _names(js, "javascript") == [("class", "C", ""), ("method", "a", "C"), ("method", "b", "C"), ("constant", "f", ""), ("variable", "q", ""), ("constant", "g", ""), ("variable", "s", ""), ("variable", "t", "")]
    ts = "export class D {\n  m(): { a: number } { return { a: 1 } }\n  n(f: () => void): Map<string, number> {\n    return new Map()\n  }\n}\n"
    assert _names(ts, "typescript") == [("class", "D", ""), ("method", "m", "D"), ("method", "n", "D")]


def test_cpp_constructors_and_templates():
    text = "#define X {\nnamespace n {\nclass W {\n public:\n  explicit W(int k) : a_(k), b_{k} { go(k); }\n  ~W() {}\n  W(const W&) = delete;\n};\ntemplate <typename T>\nT most(T a, T b) { return a > b ? a : b; }\nW::W(double d) : a_(f(d)) {}\nbool operator==(const W& a, const W& b) { return true; }\n}\n"
    assert _names(text, "cpp") == [("class", "W", ""), ("method", "W", "W"), ("method", "~W", "W"), ("function", "most", ""), ("function", "W", ""), ("function", "operator==", "")]
    assert [(c.node_type, c.start_line, c.end_line) for c in decl.chunks(text, "cpp")] == [("namespace", 2, 13)]
    assert [(c.node_type, c.start_line) for c in decl.chunks("struct P { int a; };\ntemplate <class T>\nclass Q { };\nint main() { return 0; }\n", "c")] == [("struct", 1), ("template", 2), ("function", 4)]


def test_chunks_by_language():
    assert [(c.node_type, c.start_line, c.end_line) for c in decl.chunks("import os\n\n@cache\ndef f():\n    return 1\n\nclass A:\n    @x\n    def g(self): pass\n", "python")] == [("decorated", 3, 5), ("class", 7, 9)]
    tsx = "import x from 'x'\nexport default function App() {\n  return 1\n}\nconst k = 1;\napp.get('/', (q, r) => {\n  r.end()\n})\n"
    assert [(c.node_type, c.start_line, c.end_line) for c in decl.chunks(tsx, "tsx")] == [("export", 2, 4), ("declaration", 5, 5), ("function", 6, 8)]
    assert [(c.node_type, c.start_line) for c in decl.chunks("mod a {\n  fn f() {}\n}\nimpl<T: Into<U>> Foo<T> for Bar<T> { fn g(&self) {} }\n", "rust")] == [("module", 1), ("impl", 4)]
    assert decl.chunks("def (", "python") == [] and decl.chunks("x", "ruby") == [] and decl.chunks("", "go") == []


def test_scanner_is_linear_and_survives_any_text():
    import random
    import time

    rnd = random.Random(5)
    hard = ["*" * 20000, "a<b> " * 5000, "{" * 20000, "(" * 20000, "x(" * 10000, "a, " * 9000, "class A { " * 3000, "f(a) : b(c), " * 4000, "const (" * 3000, "=> " * 5000, "'" * 9999, "a.b::c " * 4000]
    words = ["class", "func", "type", "const", "(", ")", "{", "}", "[", "]", ";", "\n", "=>", ":", ",", "A", "b", "<", ">", "'", '"', "`", "/", "*", "#", "~", "fn", "impl", "struct", " "]
    for language in ("go", "java", "javascript", "typescript", "rust", "cpp"):
        for text in [*hard, *(" ".join(rnd.choices(words, k=300)) for _ in range(60))]:
            began = time.monotonic()
            for s in decl.nodes(text, language):
                assert 0 <= s.start <= s.end <= len(text) and 1 <= s.start_line <= s.end_line <= text.count("\n") + 1
            assert time.monotonic() - began < 5, (language, text[:20])


def test_slices():
    body = [f"line {i}" for i in range(1, 101)]
    body[49] = "if err != nil {"
    text = "\n".join(body)
    out = sl.definition(text, 1, 100)
    assert [(s.label, s.start, s.end) for s in out] == [("Header slice", 1, 13), ("Error path slice", 50, 60), ("Return path slice", 90, 100)]
    body[2] = "f.Read(x)"
    assert [(s.label, s.start) for s in sl.definition("\n".join(body), 1, 100)][0] == ("Header slice", 1)
    short = sl.definition("\n".join(["x"] * 20), 1, 20)
    assert [s.label for s in short] == ["Header slice"]
    assert len(sl.salient(["Read"] * 200, 1, 200)) == 3
