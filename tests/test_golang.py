"""Digests of function bodies: what must not change them, and what must."""

import re

import pytest

from factloom.functions.golang import body_digest, canonical_hash, classify_sources, declaration, signature

CLIP = """
func clip(values []float64, low, high float64) (kept []float64) {
	for at, value := range values {
		switch {
		case value < low:
			kept = append(kept, low)
		case value > high:
			kept = append(kept, high)
		default:
			kept = append(kept, values[at])
		}
	}
	return kept
}
"""


def renamed(source, **names):
    return re.sub(r"[A-Za-z]+", lambda m: names.get(m[0], m[0]), source)


@pytest.mark.parametrize(
    "other",
    [
        renamed(CLIP, at="i", value="v"),
        renamed(CLIP, kept="out"),
        renamed(CLIP, low="high", high="low"),  # both are parameters, so numbers stand for them
        renamed(CLIP, values="xs", low="a", high="b"),
        CLIP.replace("switch {", "switch { // three ways").replace("default:", "/* between */ default:"),
        "// clip is old\n\n" + CLIP.replace("\t", "    ").replace("append(kept, low)", "append(kept,\n low,\n)"),
    ],
)
def test_layout_comments_and_local_names_do_not_count(other):
    assert body_digest(other) == body_digest(CLIP) != ""


@pytest.mark.parametrize(
    "other",
    [
        CLIP.replace("value < low", "value <= low"),
        CLIP.replace("append(kept, high)", "append(kept, low)"),
        renamed(CLIP, append="push"),  # no local
        CLIP.replace("values[at]", "values[at+0]"),
        CLIP.replace("\tdefault:\n\t\t\tkept = append(kept, values[at])\n", ""),
        CLIP.replace("return kept", "return"),
    ],
)
def test_what_is_done_counts(other):
    assert other != CLIP and body_digest(other) != body_digest(CLIP)


def same(a, b):
    return body_digest(a) == body_digest(b)


def test_declarations_of_locals():
    assert same("func f() { var left, right = ends(); swap(left, right) }", "func f() { var l, r = ends(); swap(l, r) }")
    assert same("func f() { var (\n n = 3\n s string\n)\n put(n, s) }", "func f() { var (\n k = 3\n t string\n)\n put(k, t) }")
    assert same("func (b *Box) f(items ...any) {}", "func (c *Box) f(parts ...any) {}")
    assert same("func f(seen map[string]struct{}) bool { return seen == nil }", "func f(done map[string]struct{}) bool { return done == nil }")
    assert not same("func f(io.Reader) int { return io.Max }", "func f(os.File) int { return os.Max }")  # a type's name is no local


def test_literals_are_kept_as_they_are():
    assert same('func f(u string) string { return "http://" + u }', 'func f(v string) string { return "http://" + v }')
    assert not same("func f() string { return `one  gap` }", "func f() string { return `one gap` }")


def test_without_a_body(spark):
    rows = spark.createDataFrame([(1, "func F(x int) int"), (2, ""), (3, None), (4, CLIP)], "id int, source string")
    got = {r.id: r.h for r in rows.select("id", canonical_hash("source").alias("h")).collect()}
    assert got == {1: "", 2: "", 3: "", 4: body_digest(CLIP)}


def test_signatures_have_a_type_each():
    assert signature("func F(x, y int, f func(a int) error) (n int, err error) {}") == signature("func F(a int, b int, g func(a int) error) (int, error) {}") == "(int, int, func(a int) error) (int, error)"
    assert signature("func (s *S) F(xs ...string) map[string][]byte { return nil }") == "(...string) map[string][]byte"
    assert signature("func F()") == "()" and signature("var x int") == "" == signature(None)
    assert signature("func F(a int) {}") != signature("func F(a, b int) {}")


FILE = "package p\n\nimport (\n\t\"x\"\n)\n\n// func Gone() {}\nfunc A(x int) int { return x + 1 }\n\nfunc (t *T[K]) A(y string) { f := func() {}; f() }\n"


def test_declarations_are_found_by_name_and_receiver():
    assert declaration(FILE, "A")[0] == "(int) int" and declaration(FILE, "A", "T")[0] == "(string)"
    assert declaration(FILE, "Gone") is None and declaration(FILE, "f") is None
    assert declaration(FILE, "A")[1] == declaration(FILE.replace("x", "z"), "A")[1] != ""


def test_classify_sources(spark):
    symbols = spark.createDataFrame([("f.go", "p.A"), ("f.go", "p.(T).A"), ("f.go", "p.New"), ("new.go", "p.B")], "path string, symbol string")
    after = FILE.replace("x + 1", "x + 1 /* one */").replace("y string", "y int") + "func New() {}\n"
    make = lambda rows: spark.createDataFrame(rows, "path string, content string")
    out = classify_sources(symbols, make([("f.go", FILE)]), make([("f.go", after), ("new.go", "package p\nfunc B() {}\n")]))
    assert {r.symbol: r.change for r in out.collect()} == {"p.A": "trivial", "p.(T).A": "signature_change", "p.New": "logic_change", "p.B": "logic_change"}
