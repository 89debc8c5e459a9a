"""Go and TypeScript facts, whole scans, and the tools of a snapshot."""

import re

from pyspark.sql import functions as F

from cairn.sources import go_facts, go_syntax, tsjs_facts, tsjs_syntax
from cairn.sources.analyze import analyze, report, scan_to_snapshot
from cairn.sources.store import SnapshotStore
from cairn.surface import Snapshot
from tests.test_graph import packages

FILES = "path string, content binary"


def repo(spark, files):
    return spark.createDataFrame([(p, c.encode()) for p, c in files.items()], FILES)


GO = """// Package b: package no
package b

import (
	"fmt"
	al "example.org/app/alpha" // "commented/out"
	. "example.org/app/dot"
	`raw`
)

import "C"

type S struct{ a, b int }
type (
	I interface{ Do() }
	N int
	G[T any] struct{}
	A = struct{}
	L [4]int
)

var x, Y = 1, func() int { var inner = 2; return inner }()

const (
	One = iota +
		1
	two
	_
)

func (s *S) Do(al int) { fmt.Println(al.Not) }
func (g *G[T]) Get() {}
func init() {}
func init() {}

func Run(p int) {
	s := "al.Text" + `al.Raw`
	al.First(s)
	if al := p; al > 0 {
		al.Shadowed()
	}
	for range 3 {
		al := 1
		al.Hidden()
	}
	al.Second.Third()
}
"""


def test_go_syntax():
    rows = go_syntax.facts_of("b/b.go", GO.encode())
    by = lambda *facts: [r[2] for r in rows if r[1] in facts]
    assert rows[0][:3] == ("b/b.go", "parsed", "b")
    assert [(r[2], r[3]) for r in rows if r[1] == "import"] == [(None, '"fmt"'), ("al", '"example.org/app/alpha"'), (".", '"example.org/app/dot"'), (None, "`raw`"), (None, '"C"')]
    assert by("STRUCT") == ["S", "G"] and by("INTERFACE") == ["I"] and by("TYPE") == ["N", "A", "L"]
    assert by("VARIABLE") == ["x", "Y"] and by("CONSTANT") == ["One", "two"] and by("METHOD") == ["S.Do", "G.Get"]
    assert [(r[2], r[3]) for r in rows if r[1] == "FUNCTION"] == [("init", "init@1"), ("init", "init@2"), ("Run", None)]
    assert [r[3] for r in rows if r[1] == "reference" and r[2] == "al"] == ["Not", "First", "Shadowed", "Hidden", "Second"]
    assert [(r[3], r[4]) for r in rows if r[1] == "binding"] == [("parameter", 31), ("variable", 39), ("variable", 43)]
    place = next(r for r in rows if r[1] == "import" and r[2] == "al")
    assert place[4:9] == (6, 2, 6, 28, 'al "example.org/app/alpha"')
    for bad in ("package", "package a\nfunc f( {", "package a\nx := 1", "package a\n}"):
        assert go_syntax.facts_of("x.go", bad.encode())[0][1] == "failed"
    assert go_syntax.facts_of("x.go", b"package a\nvar s = \"\xff\"")[0][1] == "failed"


# each reference of dep is named after what it takes: In a local name, Out the import
SCOPES = """package p
import dep "x.org/m/dep"
func a(dep dep.OutA) (r dep.OutB) { _ = dep.InA; return }
func b() (dep int) { dep.InB(); return }
func (dep *dep.OutC) m() { dep.InC() }
func c[dep any](x dep) { var y dep.InD }
func d() {
	dep.OutD()
	if dep := dep.OutE(); dep.InE() { dep.InF() } else if x := dep.InG(); x { dep.InH() } else { dep.InI() }
	for i, dep := range dep.OutF() { dep.InJ(i) }
	for dep := dep.OutG(); dep.InK(); dep.InL() { dep.InM() }
	switch dep := dep.OutH().(type) { case dep.InN: dep.InO()
	default: dep.InP() }
	switch x := 1; x { case 1: dep := dep.OutI; dep.InQ()
	case dep.OutJ: dep.OutK() }
	select { case dep := <-dep.OutL(): dep.InR()
	case <-dep.OutM: }
	f := func(dep int) dep.OutN { return dep.InS }
	var dep, z = dep.OutO, 1
	{ type dep struct{ x dep.InT }; dep.InU() }
	g := func() { dep.InV() }
	const k = dep.InW
}
func e() { dep, err := dep.OutP(); _ = err; dep.InX()
	x.dep.Skip() }
func h() { const dep = dep.OutQ; dep.InY() }
func i(f func(dep int) dep.OutR, m map[string]dep.OutS) map[string]struct{} { return dep.OutT }
var v = func(dep int) { dep.InZ() }
type G[dep any] struct{ x dep.InAa }
type L [dep.OutU]int
func j() {
	x := []dep.OutV{{a: dep.OutW}}
	for _, dep := range []struct{ n dep.OutX }{{dep.OutY}} { dep.InAb() }
	if f := func() bool { dep := 1; return dep.InAc }; f() { dep.OutZ() }
	go func(dep int) { dep.InAd() }(dep.OutAa)
	_ = dep.OutAb
	take(dep.OutAc)
	x.
		dep.Skip()
}
func k(more ...dep.OutAd) chan<- dep.OutAe { return nil }
"""


def test_go_scopes(spark):
    """Shadowing in every kind of scope: what is left are exactly the import's references."""
    files = repo(spark, {"p.go": SCOPES})
    facts = go_facts.extract(files)
    named = {r.detail for r in facts.where("fact = 'reference' and name = 'dep'").collect()}
    free = {r.detail for r in go_facts.unbound(facts).where("name = 'dep'").collect()}
    assert named == set(re.findall(r"\bdep\.((?:In|Out)\w+)", SCOPES)) and free == {n for n in named if n.startswith("Out")}


def test_go_export_uses(spark):
    """USES_EXPORT rows of a file with a package-level name, dot and blank imports, a method value, and one alias of two imports."""
    files = repo(spark, {
        "go.mod": "module x.org/m\n", "dep/a.go": "package dep\n\nfunc One() {}\nfunc (t T) Two() {}\ntype T struct{}\n", "dep/b.go": "package dep\n\nvar Three = 1\n", "dep/c_test.go": "package dep\n\nvar Four = 1\n",
        "dot/d.go": "package dot\n\nvar Five = 1\n",
        "use.go": 'package use\n\nimport (\n\t"x.org/m/dep"\n\t. "x.org/m/dot"\n\t_ "x.org/m/dot"\n)\n\ntype dot struct{}\n\nfunc f() {\n\tg := dep.One\n\t_, _ = dep.Three, dep.T.Two\n\t_ = dot.Five\n\t{ dep := g; dep.One() }\n\tdep.Four()\n\tdep.Two()\n}\n',
        "twice.go": 'package use\n\nimport dep "x.org/m/dep"\nimport dep "x.org/m/dot"\n\nvar v = dep.One\n',
    })
    fragment = go_facts.go_fragment(files)
    uses = {(r.from_id, r.to_id) for r in fragment.graph.edges.where("kind = 'USES_EXPORT'").collect()}
    assert uses == {("file:use.go", "file:dep/a.go"), ("file:use.go", "file:dep/b.go")}
    assert {r.snippet for r in fragment.evidence.where("edge.kind = 'USES_EXPORT'").collect()} == {"dep.One", "dep.Three", "dep.T"}
    assert {r.reason.split(" ")[2] for r in fragment.issues.where("kind = 'UNRESOLVED_EXPORT_SOURCE'").collect()} == {"dep.Four", "dep.Two"}


def test_go(spark):
    files = repo(spark, {
        "go.mod": "module example.org/app // here\n\nrequire (\n\tgithub.com/x/y v1.2.3\n\tgithub.com/x/old v1.0.0\n\texample.org/app/taken v1.0.0\n)\nreplace github.com/x/old => ./moved\nexclude github.com/x/y/bad v1.0.0\n",
        "main.go": 'package main\n\nimport (\n\t"fmt"\n\tb "example.org/app/beta"\n\t"github.com/x/y/z"\n\t"example.org/app/none"\n\t"other.org/q"\n\t"github.com/x/old/deep"\n\t"example.org/app/taken/p"\n\t"example.org/app/two"\n)\n\nimport "C"\n\nfunc main() { b.Make(); b.Lost(); b.Lost() }\n',
        "beta/b.go": "package beta\n\nfunc Make() {}\n", "beta/b_test.go": "package beta\n\nfunc Lost() {}\n", "beta/x_test.go": "package beta_test\n",
        "moved/deep/d.go": "package deep\n", "two/a.go": "package a\n", "two/b.go": "package b\n", "odd.go": "package",
    })
    fragment = go_facts.go_fragment(files)
    got = {r.import_path: (r["class"], r.target) for r in go_facts.resolve(go_facts.extract(files), go_facts.modules_of(files), go_facts.workspaces_of(files)).collect()}
    assert got == {
        "fmt": ("standard_library", None), "example.org/app/beta": ("internal_resolved", "package:beta#beta"), "github.com/x/y/z": ("external", None), "example.org/app/none": ("unresolved", None), "other.org/q": ("unclassified", None),
        "C": ("cgo", None), "github.com/x/old/deep": ("internal_resolved", "package:moved/deep#deep"), "example.org/app/taken/p": ("external", None), "example.org/app/two": ("unresolved", None),
    }
    edges = {(r.kind, r.from_id, r.to_id) for r in fragment.graph.edges.where("from_id = 'file:main.go'").collect()}
    assert edges == {("IMPORTS", "file:main.go", "package:beta#beta"), ("IMPORTS", "file:main.go", "package:moved/deep#deep"), ("USES_EXPORT", "file:main.go", "file:beta/b.go"), ("CONTAINS", "file:main.go", "function:main.go#main")}
    issues = {(r.kind, r.path, r.import_path) for r in fragment.issues.collect()}
    assert issues == {
        ("FAILED_FILE", "odd.go", ""), ("UNRESOLVED_IMPORT", "main.go", "example.org/app/none"), ("UNRESOLVED_IMPORT", "main.go", "example.org/app/two"), ("UNCLASSIFIED_IMPORT", "main.go", "other.org/q"),
        ("UNRESOLVED_EXPORT_SOURCE", "main.go", "example.org/app/beta"),
    }
    assert {(r.edge.kind, r.snippet) for r in fragment.evidence.collect()} == {("IMPORTS", 'b "example.org/app/beta"'), ("IMPORTS", '"github.com/x/old/deep"'), ("USES_EXPORT", "b.Make")}


def test_go_workspace(spark):
    files = repo(spark, {
        "go.work": "go 1.22\nuse (\n\t./a\n\t./b\n)\n", "a/go.mod": "module x.org/a\nrequire z.org/z v1.0.0\n", "b/go.mod": "module x.org/b\n", "c/go.mod": "module x.org/c\n",
        "a/m.go": 'package a\nimport "x.org/b/in"\nimport "z.org/z"\nimport "x.org/c"\n', "b/in/i.go": "package in\n", "c/c.go": 'package c\nimport "x.org/c/d"\n', "c/d/d.go": "package d\n",
    })
    rows = go_facts.resolve(go_facts.extract(files), go_facts.modules_of(files), go_facts.workspaces_of(files)).collect()
    assert {(r.path, r.import_path): (r["class"], r.target) for r in rows} == {
        ("a/m.go", "x.org/b/in"): ("internal_resolved", "package:b/in#in"), ("a/m.go", "z.org/z"): ("unclassified", None), ("a/m.go", "x.org/c"): ("unclassified", None), ("c/c.go", "x.org/c/d"): ("unresolved", None),
    }


TS = r"""import x from './b' // import y from './c'
import type { Y } from "../lib/c.js";
import 'react'
export * from 'node:fs'
import eq = require('q')
export default class Big { constructor(private a: number) {} get size() { return 1 } async run<T>(x: T) { if (x) { call(x) } } 'quoted name'() {} static #own() {} }
export interface Face { go(): void }
type Alias = string
const enum Kind { A }
export const { a, b: [c], ...rest } = load(), arrow = async (x) => x, plain = 3, fn = function () {}
let re = /["'{]/g, t = `{ ${x} '`
function deep() { const inner = 1; return import('./lazy') }
export function deep2() {}
function deep() {}
"""


def test_tsjs_syntax():
    rows = tsjs_syntax.facts_of("src/a.ts", TS.encode())
    by = lambda fact: [r[2] for r in rows if r[1] == fact]
    assert by("import") == ["./b", "../lib/c.js", "react", "node:fs"]
    assert by("CLASS") == ["Big"] and by("METHOD") == ["Big.constructor", "Big.run", "Big.quoted name", "Big.#own"]
    assert by("INTERFACE") == ["Face"] and by("TYPE") == ["Alias"] and by("ENUM") == ["Kind"]
    assert by("FUNCTION") == ["arrow", "fn", "deep", "deep2", "deep"] and by("VARIABLE") == ["a", "c", "rest", "plain", "re", "t"]
    assert [r[3] for r in rows if r[1] == "limitation"] == [tsjs_syntax.IMPORT_EQUALS, tsjs_syntax.DYNAMIC]
    assert next(r for r in rows if r[2] == "../lib/c.js")[4:9] == (2, 1, 2, 38, 'import type { Y } from "../lib/c.js";')
    assert tsjs_syntax.facts_of("x.ts", b"function f( {")[0][1] == "failed"


def names(path, text):
    rows = tsjs_syntax.facts_of(path, text.encode())
    return [(r[1], r[2]) for r in rows[1:]] if rows[0][1] == "parsed" else rows[0][3]


def test_tsjs_lexer():
    """Slashes, templates and elements that hold brackets and quotes."""
    assert names("a.ts", "function a(x) { return /[{]/.test(x) }\nexport const b = 1") == [("FUNCTION", "a"), ("VARIABLE", "b")]
    assert names("a.ts", 'const x = `x ${b ? `{` : ""}`; export function z() {}') == [("VARIABLE", "x"), ("FUNCTION", "z")]
    assert names("a.js", "if (x) /}/.exec(y)\nlet c = (a) / 2 / d, e = x++ / 1, f = [1] / g['}'] / h\nclass K {}") == [("VARIABLE", "c"), ("VARIABLE", "e"), ("VARIABLE", "f"), ("CLASS", "K")]
    assert names("a.js", "x = {} / 1; while (y) /'/g.test(z); const o = typeof /`/, p = q.return / 2 // it's\n/* ` */ var r = a.if(b) / 2") == [("VARIABLE", "o"), ("VARIABLE", "p"), ("VARIABLE", "r")]
    tsx = "const A = <T,>(x: T) => <div a={{b: 1}} c='}'>it's {x ? <b>{`${'}'}`}</b> : null} / {/* } */}</div>\ntype F = <T>(x: T) => T\ninterface I { <T>(x: T): T; a?: <U extends T>(u: U) => U }\nexport function B() { return <><A<T> x=\"}\"/><a.b-c:d {...e} f=<i/>>'</a.b-c:d></> }\nconst z = a < b, y = c > d"
    assert names("a.tsx", tsx) == [("FUNCTION", "A"), ("TYPE", "F"), ("INTERFACE", "I"), ("FUNCTION", "B"), ("VARIABLE", "z"), ("VARIABLE", "y")]
    assert names("a.ts", "const c = <T>(x: T) => x, d = <any>e\nlet f = a < b") == [("FUNCTION", "c"), ("VARIABLE", "d"), ("VARIABLE", "f")]
    for bad in ("`${a", "'x\n'", "a = /x\n/", "f(]", "}", "/* open", "`a\\"):
        assert isinstance(names("a.ts", bad), str), bad
    assert isinstance(names("a.tsx", "const a = <div>{b}</span>; }"), str)


def test_tsjs_statements():
    """Members behind accessors, patterns, generics, statements without semicolons, and what only looks like a declaration."""
    klass = "class Q extends M<{a: 1}> { get w() { return 1 } ['w']() {} static #p() {} foo<T>(a: T): {a: number} { return {a: 1} } async *gen() {} x = () => {}; readonly y: string\n bar(): void\n bar(z?: number): void {} static { f() } static() {} get() {} constructor(private a = {}) {} abstract q(): Map<string, number>; @Dec({b: 1}) deco() {} 'quoted'() {} 3() {} [k]() {} set v(x) {} }"
    methods = ["w", "#p", "foo", "gen", "bar", "bar", "static", "get", "constructor", "q", "deco", "quoted", "3"]
    assert names("a.ts", klass) == [("CLASS", "Q"), *(("METHOD", f"Q.{m}") for m in methods)]
    variables = "export const {a, b: {c}, ...d} = f<A, B>(1), [e,, g = 2] = h, i = async (x: number): Promise<Map<string, void>> => 1, j = function () {}, k = function(){}(), l: (a: b) => c = z\nlet o = 1 < 2, p = x as M<A, B>, q = a < b, r = 3\n  .toFixed(), s"
    assert names("a.ts", variables) == [*(("VARIABLE", n) for n in "acdeg"), ("FUNCTION", "i"), ("FUNCTION", "j"), *(("VARIABLE", n) for n in "klopqrs")]
    imports = "import a, {b} from 'x'\nimport type {C} from \"y\";import * as z from 'z' with {type: 'json'};\nexport * as ns from './n\\u0073'\nexport {a}\nlet t: typeof import('u')\nimport 'side'; type A = import('v').B\ndeclare module 'm' { import 'inner' }\ntype = 3\nexport type F<T> = T\nexport declare const enum En {A}\nconst g =\n  function named() {}\nimport from from 'f'"
    assert names("a.ts", imports) == [("import", "x"), ("import", "y"), ("import", "z"), ("import", "./ns"), ("VARIABLE", "t"), ("import", "side"), ("TYPE", "A"), ("TYPE", "F"), ("ENUM", "En"), ("FUNCTION", "g"), ("import", "f")]
    for text, reasons in {"import('a')": 1, "x.require('a')": 0, "require('a'); import b = require('c')": 2, "class A { require() {} }": 0, "export import a = b.c": 1, "`${require('x')}`": 1, "'import(1)' // import(2)": 0}.items():
        assert sum(kind == "limitation" for kind, _ in names("a.ts", text)) == reasons, text


def test_tsjs_resolution_is_stable(spark):
    """The same targets however the rows are dealt, for many files that ask for the same and for other modules."""
    files = repo(spark, {**{f"d{i % 3}/f{i}.ts": f"import './f{(i + 3) % 60}'\nimport '../d{(i + 1) % 3}/f{i + 1}.js'\nimport 'x'\n" for i in range(60)}})
    facts = tsjs_facts.extract(files)
    parsed = facts.where("fact = 'parsed'").select("path")
    run = lambda n: sorted(tuple(r) for r in tsjs_facts.resolve(tsjs_facts.imports_of(facts).repartition(n), parsed.repartition(n), tsjs_facts.configs_of(files), tsjs_facts.packages_of(files)).select("path", "spec", "class", "target").collect())
    rows = run(1)
    assert rows == run(7) and len(rows) == 180
    want = {(f"d{i % 3}/f{i}.ts", f"./f{(i + 3) % 60}", "internal_resolved", f"file:d{i % 3}/f{(i + 3) % 60}.ts") for i in range(60)}
    assert want <= set(rows) and sum(r[2] == "internal_resolved" for r in rows) == 60 + 59


def test_tsjs(spark):
    files = repo(spark, {
        "src/a.ts": "import x from './b'\nimport type { Y } from \"../lib/c.js\"\nimport 'react'\nexport * from 'node:fs'\nimport z from './none'\nimport q from 'left/x'\nimport r from '../../out'\nimport s from '@/c'\nimport t from 'lib/c'\nimport u from '#in'\nimport v from 'exact'\n",
        "src/b/index.tsx": "", "lib/c.ts": "", "package.json": '{"devDependencies": {"react": "1"}, "workspaces": []}', "tsconfig.json": '{\n// base\n"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["lib/*"], "exact": ["src/b"],}}}',
        "odd/tsconfig.json": '{"extends": "../tsconfig.json"}', "odd/o.js": "import './p'\n",
    })
    fragment = tsjs_facts.tsjs_fragment(files)
    facts = tsjs_facts.extract(files)
    rows = tsjs_facts.resolve(tsjs_facts.imports_of(facts), facts.where("fact = 'parsed'").select("path"), tsjs_facts.configs_of(files), tsjs_facts.packages_of(files))
    assert {r.spec: (r["class"], r.target) for r in rows.collect()} == {
        "./b": ("internal_resolved", "file:src/b/index.tsx"), "../lib/c.js": ("internal_resolved", "file:lib/c.ts"), "react": ("external", None), "node:fs": ("standard_library", None), "./none": ("unresolved", None),
        "left/x": ("unclassified", None), "../../out": ("unresolved", None), "@/c": ("internal_resolved", "file:lib/c.ts"), "lib/c": ("internal_resolved", "file:lib/c.ts"), "#in": ("unresolved", None), "exact": ("internal_resolved", "file:src/b/index.tsx"),
        "./p": ("unresolved", None),
    }
    assert fragment.graph.edges.where("kind = 'IMPORTS'").count() == 2 and fragment.evidence.count() == 5
    limits = {(r.path, r.reason) for r in fragment.issues.where("kind = 'TSJS_LIMITATION'").collect()}
    assert ("odd/o.js", "configuration extends is unsupported") in limits and ("src/a.ts", "package workspaces are not resolved") in limits


def test_scan_to_snapshot(spark, tmp_path):
    """From a folder to a saved snapshot: three languages, ignored files, evidence in order, issues and counters."""
    root = tmp_path / "repo"
    for path, text in {
        "go.mod": "module m.org\n", "a/a.go": 'package a\nimport "m.org/b"\nfunc Run() { b.Do() }\n', "b/b.go": "package b\nfunc Do() {}\n", "p/__init__.py": "", "p/x.py": "from . import y\nimport none\n", "p/y.py": "", "web/i.ts": "import './j'\n",
        "web/j.ts": "export const k = 1\n", "old/z.rs": "", "gen/g.py": "", ".cairnignore": "gen/\n", "node_modules/n.js": "",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    scan = scan_to_snapshot(spark, str(root), store, "")
    graph, parts = store.load(scan)
    used = {(r.kind, r.from_id, r.to_id) for r in graph.edges.where("kind <> 'CONTAINS'").collect()}
    assert used == {("IMPORTS", "file:a/a.go", "package:b#b"), ("USES_EXPORT", "file:a/a.go", "file:b/b.go"), ("IMPORTS", "file:p/x.py", "file:p/y.py"), ("IMPORTS", "file:web/i.ts", "file:web/j.ts")}
    assert [(r.ordinal, r.path, r.line) for r in parts["evidence"].orderBy("ordinal").collect()] == [(0, "a/a.go", 2), (1, "a/a.go", 3), (2, "p/x.py", 1), (3, "web/i.ts", 1)]
    assert [(r.ordinal, r.kind, r.path) for r in parts["issues"].orderBy("ordinal").collect()] == [(0, "UNCLASSIFIED_IMPORT", "p/x.py"), (1, "UNSUPPORTED_FILE", "old/z.rs")]
    assert [(r.path, r.reason) for r in parts["exclusions"].collect()] == [("gen/", '.cairnignore:1 pattern "gen/"')]
    row = store.list().first()
    assert (row.status, row.files_discovered, row.supported_source_files, row.files_analyzed, row.imports_discovered, row.internal_resolved, row.unclassified) == ("completed_with_gaps", 9, 7, 7, 4, 3, 1)
    lines = report(analyze(repo(spark, {"a.py": "import os\n"}))).collect()
    assert [tuple(r) for r in lines] == [("node", "FILE file:a.py a.py a.py")]


def test_tools(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    g = packages(spark, "AB", [], [("f", "FILE", "f")], [("CONTAINS", "A", "f"), ("IMPORTS", "f", "B")])
    s = Snapshot(store, store.save("root", g))
    assert s.call("dependency_path", {"from_id": "A", "to_id": "B"}) == {"path": ["A", "B"]}
    assert [p["id"] for p in s.call("package_dependencies", {"package_id": "A"})["packages"]] == ["B"]
    assert s.call("package_impact", {"package_id": "B"})["affected"] == [{"id": "A", "distance": 1}]
    assert s.call("package_impact", {"package_id": "B", "offset": 1})["affected"] == [] and s.call("file_symbols", {"file_id": "f"})["total"] == 0
    assert s.call("scan_info", {}, pinned="other")["error"]["code"] == "snapshot_changed" and "error" not in s.call("scan_info", {}, pinned=s.scan)
    assert s.call("scan_info", {})["packages"] == 2
    assert s.call("node_children", {"node_id": "A"}) == {"children": [{"id": "f", "kind": "FILE", "path": "f", "name": "f", "language": "go", "import_count": None, "export_count": None}], "total": 1, "offset": 0}
    assert [n["id"] for n in s.call("related_nodes", {"node_id": "B", "incoming": True})["nodes"]] == ["A"] and s.call("related_nodes", {"node_id": "f"})["total"] == 1
    whole = s.call("package_detail", {"package_id": "A"})
    assert [n["id"] for n in whole["nodes"]] == ["A", "B", "f"] and "import_count" not in whole["nodes"][0] and len(whole["edges"]) == 2
    assert [n["id"] for n in s.call("file_detail", {"file_id": "f"})["nodes"]] == ["A", "f"] and s.call("overview", {})["nodes"][0]["id"] == "A"
    assert s.call("neighborhood", {"node_id": "A", "scope": "package"})["dependencies_total"] == 1 and s.call("search_page", {"term": "F"})["total"] == 1
    assert s.call("relationship_facts", {"kind": "IMPORTS", "from_id": "A", "to_id": "B", "scope": "package"})["total"] == 1
    assert s.call("source_status", {"root": str(tmp_path)})["sources"] == [] and len(s.call("snapshots", {})["snapshots"]) == 1
    for tool, arguments in (("node_children", {"node_id": "x"}), ("related_nodes", {"node_id": "x"}), ("related_nodes", {"node_id": "f", "incoming": 1}), ("node_children", {"node_id": "A", "offset": -1}), ("node_children", {"node_id": "A", "offset": True}), ("source_status", {"root": "/none"})):
        assert "error" in s.call(tool, arguments), tool
    assert s.call("source_evidence", {"kind": "IMPORTS", "from_id": "A", "to_id": "B", "scope": "package"})["recorded"] is False
    for tool, arguments, code in (("none", {}, "route_not_found"), ("inspect_node", {}, "invalid_argument"), ("inspect_node", {"node_id": 3}, "invalid_argument"), ("inspect_node", {"node_id": "x"}, "node_not_found"), ("file_symbols", {"file_id": "A"}, "wrong_node_kind"), ("search_nodes", {"limit": 0}, "invalid_argument"), ("search_nodes", {"odd": 1}, "invalid_argument")):
        assert s.call(tool, arguments)["error"]["code"] == code
