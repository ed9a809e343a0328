import json

import pytest
from lodestrata.functions import paths, text
from lodestrata.operators import envelope
from lodestrata.sources import discover, encodings, ignore, store
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("rules", "path", "directory", "said"),
    [
        (["*.o"], "a/b.o", False, "ignored"), (["/a.o"], "x/a.o", False, "none"), (["build/"], "x/build", True, "ignored"), (["build/"], "x/build", False, "none"),
        (["*.log", "!keep.log"], "keep.log", False, "kept"), (["a/**/z"], "a/z", False, "ignored"), (["a/**/z"], "a/b/c/z", False, "ignored"), (["a/**"], "a", True, "none"),
        ([r"\#x"], "#x", False, "ignored"), (["# x"], "# x", False, "none"), (["f[!0-9]"], "fa", False, "ignored"), (["f[!0-9]"], "f1", False, "none"), (["../x"], "x", False, "none"), (["a?c"], "a/c", False, "none"),
    ],
)
def test_ignore(rules, path, directory, said):
    assert ignore.decide([(0, ignore.parse(rules))], path.split("/"), directory) == said


@pytest.mark.parametrize(
    ("content", "name"),
    [
        (b"", "UTF-8"), (b"\xef\xbb\xbfx", "UTF-8-BOM"), ("日本".encode("utf-16-le"), "undetermined"), (b"a\0b", "binary"), ("日本語".encode("iso2022_jp"), "ISO-2022-JP"),
        ("é日本".encode(), "UTF-8"), (b"\xff\xfea\0", "UTF-16LE"), ("ｱ ｲ 漢".encode("shift_jis"), "Shift_JIS"),
    ],
)
def test_encodings(content, name):
    found = encodings.detect(content)[0]
    assert found == name or (name == "undetermined" and found in encodings._STRUCTURE)


TREE = {
    "a.c": "/* generated by x */\n#include <s.h>\n#define N 1\n#define F(x) x\nstruct Pt { int x; };\n// TODO: fix it\nstatic int twice(struct Pt *p) { return F(p->x) + once(p); }\n#ifdef CONFIG_MORE\nint more;\n#endif\n",
    "lib/deep/m.py": "import os\nclass A:\n    def go(self): pass\n",
    "lib/Kconfig": "config MORE\n",
    ".gitignore": "*.o\n",
    "b.o": "x",
    ".hid/x.c": "int x;",
    "empty.txt": "",
    "bin.txt": "a\0b",
}


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    from lodestrata import cli

    base = tmp_path_factory.mktemp("tree")
    for name, body in TREE.items():
        (base / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (base / "src" / name).write_text(body)
    return base / "src", base / "out", cli.index(spark, str(base / "src"), str(base / "out"), "r")


def test_walk(indexed, tmp_path):
    root, _, _ = indexed
    seen = list(discover.walk(str(root)))
    assert [p for p, _, _, what in seen if what is None] == [".gitignore", "a.c", "bin.txt", "empty.txt", "lib/Kconfig", "lib/deep/m.py"]
    assert [p for p, _, _, what in seen if what == discover.DIRECTORY] == ["lib", "lib/deep"]
    assert [what for *_, what in discover.walk(str(root), most_entries=2)].count("EntryLimitExceeded") == 1
    assert "DepthLimitExceeded" in [what for *_, what in discover.walk(str(root), most_depth=1)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/l").symlink_to(tmp_path / "s")
    assert [what for *_, what in discover.walk(str(tmp_path / "s"))] == ["SymbolicLinkSkipped"]
    assert [what for *_, what in discover.walk(str(tmp_path / "s"), follow=True)] == ["DirectoryCycle"]


def test_graph_of_a_tree(spark, indexed):
    """Nodes, edges of all kinds with their ends, references, order and diagnostics."""
    _, out, _ = indexed
    t = store.open_artifact(spark, str(out))
    nodes = {r["node_id"]: r for r in t["nodes"].collect()}
    name = {k: r["qualified_name"] for k, r in nodes.items()}
    by_number = [r["qualified_name"] for r in sorted(nodes.values(), key=lambda r: r["dense_idx"])]
    assert by_number[:9] == ["r", "lib", "lib/deep", ".gitignore", "a.c", "bin.txt", "empty.txt", "lib/Kconfig", "lib/deep/m.py"] and by_number[-1] == "CONFIG_MORE"
    edges = {(r["kind"], name[r["src"]], name[r["dst"]]) for r in t["edges"].collect()}
    note = "TODO: fix it"
    assert {e for e in edges if e[0] == 1} == {
        (1, "r", x) for x in ("lib", ".gitignore", "a.c", "bin.txt", "empty.txt", "CONFIG_MORE")
    } | {(1, "lib", "lib/deep"), (1, "lib", "lib/Kconfig"), (1, "lib/deep", "lib/deep/m.py"), (1, "lib/Kconfig", "MORE"), (1, "lib/deep/m.py", "A"), (1, "lib/deep/m.py", "go"), (1, "Pt", "Pt::x")} | {
        (1, "a.c", x) for x in ("N", "F", "Pt", note, "a.c::twice", "more")
    }
    assert {e[2] for e in edges if e[0] == 5} == {"N", "F", "Pt", "Pt::x", "a.c::twice", "more", "MORE", "A", "go"}
    assert {e for e in edges if e[0] == 15} == {(15, "more", "CONFIG_MORE")}
    refs = {(name[r["source"]], r["edge_kind"], r["target"]) for r in t["refs"].collect()}
    assert refs == {("a.c", 2, "s.h"), ("a.c::twice", 7, "Pt"), ("a.c::twice", 6, "F"), ("a.c::twice", 6, "once"), (note, 18, "a.c::twice"), ("more", 15, "CONFIG_MORE"), ("lib/deep/m.py", 3, "os")}
    flags = {r["qualified_name"]: r["flags"] for r in nodes.values()}
    assert flags["a.c"] == 8 and flags["N"] == 9 and flags["a.c::twice"] == 1 + 8 + 2048 and flags[note] == 8 and flags["bin.txt"] & 64
    tiers = {(r["tier"], r["reason"]): r["files"] for r in t["coverage"].collect()}
    assert tiers[2, None] == 1 and tiers[0, "binary"] == 1


def test_verified_and_rebuilt(spark, indexed, tmp_path):
    from lodestrata import cli

    root, out, first = indexed
    checks = {r["check"]: r["issues"] for r in store.verify(spark, str(out)).collect()}
    assert not any(checks.values()) and {"transpose", "dictionary lacks", "ids", "dense numbers", "references without node"} <= checks.keys()
    assert cli.index(spark, str(root), str(out), "r") == first
    assert not any(n for _, n in cli.rebuilt(spark, str(root), str(out), str(tmp_path / "again")))
    # a reverse edge is lost: contents and the manifest no longer agree
    t = store.open_artifact(spark, str(out))
    assert store.transpose_issues(t["edges"], t["redges"].filter("kind <> 15")).count() == 1
    missing, extra = store.lookup_issues(t["nodes"], t["lookup"].filter("key <> 'Pt'"))
    assert missing.count() == 2 and extra.count() == 0
    other = store.publish(spark, str(tmp_path / "bad"), {k: t[k] for k in ("nodes", "edges")} | {"refs": t["refs"].withColumn("stage", F.lit(9))})
    assert other and {r["check"] for r in store.verify(spark, str(tmp_path / "bad")).collect() if r["issues"]} == {"fields of references"}
    twice = t["nodes"].unionByName(t["nodes"])
    with pytest.raises(store.Collision):
        store.publish(spark, str(tmp_path / "twice"), {"nodes": twice})
    with pytest.raises(store.Partial):
        store.publish(spark, str(out), {}, complete=False)


def test_commands(spark, indexed, tmp_path):
    from lodestrata.operators.commands import Command, freshness, sidecar

    root, out, first = indexed
    tables = store.open_artifact(spark, str(out))
    c = Command(tables, first, 20, 8000)
    assert c.search("Pt")[0] == envelope.OK and c.search("nothing here")[0] == envelope.NOTHING
    code, said = c.neighbors("a.c", 1, "out")
    near = json.loads(said)
    assert code == envelope.OK and {n["name"] for n in near["nodes"]} == {"a.c", "N", "F", "Pt", "x", "TODO", "twice", "more"} and near["summary"]["totalReachable"] == 8
    assert {n["name"] for n in json.loads(c.neighbors("a.c", 1, "out", "defines")[1])["nodes"]} == {"a.c", "N", "F", "Pt", "x", "twice", "more"}
    assert [n["name"] for n in json.loads(c.path("more", "go", kinds="contains")[1])["nodes"]] == ["more", "a.c", "r", "lib", "deep", "m.py", "go"]
    assert [n["name"] for n in json.loads(c.path("more", "CONFIG_MORE", direction="out")[1])["nodes"]] == ["more", "CONFIG_MORE"]
    assert c.path("more", "go", depth=2)[0] == envelope.NOTHING
    shown = json.loads(c.show("x")[1])
    assert [n["name"] for n in shown["nodes"]] == ["x", "a.c", "Pt"]
    pack = json.loads(c.context(["Pt", "go"])[1])
    assert pack["summary"]["matchedKeywords"] == 2 and pack["summary"]["totalMatches"] == 3 and pack["summary"]["seedLimit"] == 10
    few = Command(tables, first, 2, 8000)
    assert few.search("o")[0] == envelope.PARTIAL and json.loads(few.search("o")[1])["omittedNodeCount"] > 0
    assert c.export(str(tmp_path / "p.html"), "a.c") == envelope.OK and c.export(str(tmp_path / "o.html")) == envelope.OK
    assert "Function a.c::twice a.c:7 [Definition Generated InternalLinkage] <substring>" in envelope.lines(c.search("twice")[1]) or "Function" in envelope.lines(c.search("twice")[1])
    (root / "a.c").write_text("changed")
    states = freshness(tables["files"], str(root), ["a.c", "lib/deep/m.py", "zz", "empty.txt"])
    assert states == [("a.c", "changed", ""), ("lib/deep/m.py", "unchanged", ""), ("zz", "unchecked", "not-indexed"), ("empty.txt", "unchanged", "")]
    assert freshness(tables["files"], str(root), ["lib/deep/m.py"], most_bytes=3)[0][1:] == ("unchecked", "byte-limit")
    (root / "a.c").write_text(TREE["a.c"])
    bound = json.loads(sidecar(str(tmp_path / "ctx.json"), str(out), str(root)))
    assert bound["INDEX_DIR"] == str(out) and sidecar(str(tmp_path / "ctx.json"), str(out))
    with pytest.raises(ValueError):
        sidecar(str(tmp_path / "ctx.json"), str(tmp_path))
    (tmp_path / "m").mkdir()
    (tmp_path / "m/manifest.json").write_text(json.dumps({"formatVersion": 99, "generation": "g", "complete": True, "tables": {}}))
    for bad in (tmp_path / "m", tmp_path):
        with pytest.raises(store.Corrupt):
            store.manifest(spark, str(bad))


C_CODE = """#ifndef A_H
#define A_H
namespace geo {
// A shape.
class Shape : public Base, ns::Other {
 public:
  virtual ~Shape();
  Point at_;
  int (*callback)(int), size = 3;
  bool operator==(const Shape &o) const { return cmp(o) == 0; }
};
namespace { int hidden(); }
template <class T> T maximum(T a, T b) { return a < b ? b : a; }
enum class Kind : int { kOne, kTwo = make(2) };
using Alias = Shape;
}
#if defined(X) && (Y > 2) // why
extern int declared;
#elif Z
struct Later;
#else
typedef struct { int v; } Anon, *AnonP;
#endif
static const int table[] = { f(1), 2 };
int *pick(void (*fn)(int), struct Opaque *o) { static int calls = 0; obj->do_it(o); if (calls) run(); return 0; }
TEST_P(Suite, Case) { EXPECT_TRUE(ok()); }
MODULE_INIT(start);
#endif
"""


def test_syntax():
    from lodestrata.sources import syntax

    symbols, refs, truncated = syntax.read(C_CODE, "cpp-header", "a.h")
    got = {(s.kind, s.qualified): s for s in symbols}
    assert not truncated
    assert set(got) == {
        ("Constant", "A_H"), ("Module", "geo"), ("Type", "geo::Shape"), ("Function", "geo::Shape::~Shape"), ("Field", "geo::Shape::at_"), ("Field", "geo::Shape::callback"), ("Field", "geo::Shape::size"),
        ("Function", "geo::Shape::operator=="), ("Function", "a.h::geo::hidden"), ("Function", "geo::maximum"), ("Type", "geo::Kind"), ("Constant", "geo::Kind::kOne"), ("Constant", "geo::Kind::kTwo"), ("Type", "geo::Alias"),
        ("Variable", "declared"), ("Type", "Later"), ("Type", "Anon"), ("Type", "AnonP"), ("Field", "Anon::v"), ("Variable", "a.h::table"), ("Function", "pick"), ("Variable", "pick::calls"), ("Function", "Suite.Case"),
    }
    assert got["Variable", "declared"].condition == "defined(X) && (Y > 2)" and got["Variable", "declared"].flags == 2 + 32
    assert got["Type", "Later"].condition == "!(defined(X) && (Y > 2)) && (Z)" and got["Type", "Anon"].condition == "!(defined(X) && (Y > 2)) && !(Z)"
    assert got["Constant", "A_H"].condition == "" and got["Type", "geo::Shape"].doc == 11 and got["Function", "Suite.Case"].flags == 5
    assert got["Function", "a.h::geo::hidden"].flags == 2 + 2048 and symbols[got["Field", "Anon::v"].parent].name == "Anon"
    assert (got["Type", "geo::Shape"].start_line, got["Type", "geo::Shape"].end_line) == (5, 11)
    found = {(symbols[r.source].name if r.source >= 0 else "", r.kind, r.target) for r in refs}
    assert {("Shape", "INHERITS", "Base"), ("Shape", "INHERITS", "ns::Other"), ("at_", "TYPED_AS", "Point"), ("operator==", "CALLS", "cmp"), ("pick", "CALLS", "obj->do_it"), ("pick", "CALLS", "run"), ("pick", "REFERENCES", "Opaque"), ("Case", "TESTS", "Suite"), ("Case", "CALLS", "EXPECT_TRUE"), ("Case", "CALLS", "ok"), ("", "CALLS", "MODULE_INIT"), ("", "CALLS", "f")} <= found
    assert {r.target for r in refs if r.kind == "GUARDED_BY"} == {"X", "Y", "Z"}


@pytest.mark.parametrize("text", ["", "int", "{" * 5000, "}" * 500, "(" * 20000, "#if\n" * 600, "#else\n#endif\n", '"', "/*", "struct {", "template<", "a::b::", "enum { , , }", "\x00\ud83d", "f(" * 3000 + ")" * 3000, "x y z\n" * 5000])
def test_syntax_never_raises(text):
    from lodestrata.sources import extract, syntax

    syntax.read(text, "cpp", "p")
    assert extract.file(text, "cpp", "p").reason in (None, "extraction-limit")


def test_places_in_bytes():
    from lodestrata.sources import extract

    text = "// é\r\nint größe; // TODO: ü\r\nint b;\n"
    found = extract.file(text, "c", "p")
    raw = text.encode()
    assert [raw[s.start : s.end].decode() for s in found.symbols] == ["int größe;", "TODO: ü", "int b;"]
    assert [(r.kind, r.target) for r in found.references] == [("EXPLAINS", "b")]


@pytest.mark.parametrize(
    ("language", "text", "symbols", "refs"),
    [
        ("makefile", "include x.mk\nobj-y += a.o\nall: b\n\tx: y\n# NOTE: n\n", {"obj-y", "all", "NOTE"}, {"x.mk"}),
        ("fsharp-signature", "module M\nopen System.IO\nval f: int\n", {"M", "f"}, {"System.IO"}),
        ("shell", "source ./a.sh\n", set(), {"./a.sh"}),
        ("assembly", "main: ; TODO: x\n  ret\n", {"main", "TODO"}, set()),
        ("rust", "use a::b::{c};\npub async fn go() {}\n", {"go"}, {"a::b"}),
        ("javascript", "import x from \"./y\"; // import 'no'\nexport default class K {}\n", {"K"}, {"./y"}),
        ("csharp", "using System.Text;\npublic sealed record R;\n", {"R"}, {"System.Text"}),
        ("cmake", "include(\"x.cmake\")\ninclude(bare)\n", set(), {"x.cmake"}),
        ("cpp", "enum class X { A };\n", {"class"}, set()),
        ("kconfig", "menuconfig A\nsource \"b/Kconfig\"\n", {"A"}, {"b/Kconfig"}),
    ],
)
def test_lines(language, text, symbols, refs):
    from lodestrata.sources import lines

    s, r, _, _ = lines.scan(text, language)
    assert {x.name for x in s} == symbols and {x.target for x in r} == refs


def test_generated_marker():
    from lodestrata.sources import lines

    generated = lambda text: lines.scan(text, "c")[2]
    assert generated("// Do Not Modify\n") and generated("/* a\n * @generated */") and not generated('x = "do not edit";') and not generated("\n" * 40 + "// do not edit")
    assert not generated("//" + "x" * 9000 + " do not edit") and not generated("// this file was generated\n")


def test_envelope():
    nodes = [{"node_id": str(i), "qualified_name": "n" * 40, "kind": 6} for i in range(200)]
    edges = [{"src": "0", "dst": "1", "kind": 1}, {"src": "0", "dst": "199", "kind": 1}]
    whole = json.loads(text_ := envelope.fit("search", "g", {}, nodes, edges, budget=1000))
    assert whole["tokenEstimate"] == envelope.estimate(text_) <= 1000
    assert whole["omittedNodeCount"] == 200 - len(whole["nodes"]) > 0
    assert whole["omittedEdgeCount"] == 1 and whole["exitCode"] == envelope.PARTIAL
    with pytest.raises(ValueError):
        envelope.fit("search", "g", {}, [], budget=5)
    assert envelope.estimate(envelope.error("x", "m" * 100_000, 2, 300)) <= 300
    assert "</script><b>" not in envelope.page("t", [{"node_id": "1", "qualified_name": "</script><b>"}], [])


def test_functions(spark):
    rows = [("HTTPServerName2x", "a/b.tar.GZ"), ("日本語 file\x1b", "third_party/x/test_a.py"), ("", "Makefile"), (None, None)]
    df = spark.createDataFrame(rows, "t string, p string")
    got = df.select(text.words(F.col("t")), text.ngrams(F.col("t")), text.token_estimate(F.col("t")), text.sanitize(F.col("t")), text.display_width(F.col("t")), text.line_count(F.col("t")), paths.extension(F.col("p")), paths.language(F.col("p")), paths.flags(F.col("p")), text.truncate_to_width(F.col("t"), 5)).collect()
    assert got[0][0] == ["http", "server", "name", "2", "x"] and got[0][6] == "gz"
    assert got[1][0] == ["日本語", "file"] and got[1][2] == 5 and got[1][3].endswith("�") and got[1][4] == 11 and got[1][7] == 9 and got[1][8] == 20 and got[1][9] == "日本"
    assert got[2][0] == [] and got[2][2] == 0 and got[2][5] == 0 and got[2][7] == 18
    assert got[3][0] is None


def test_sizes_and_names(spark):
    assert [text.size_of(x) for x in ("4096", "64KiB", "1 gb", "2B", "1tib")] == [4096, 65536, 10**9, 2, 1 << 40]
    for bad in ("", "x", "1TB", "-1", "1.5KB", "9999999999TiB"):
        with pytest.raises(ValueError):
            text.size_of(bad)
    df = spark.createDataFrame([("a😀b",), ("e\u0301x",), ("plain",), (None,)], "t string")
    assert [r[0] for r in df.select(text.name_of(F.col("t"), 2)).collect()] == ["a", "éx", "pl", None]
    assert [r[0] for r in df.select(text.grapheme_count(F.col("t"))).collect()] == [3, 2, 5, None]
    starts = spark.createDataFrame([("é\r\nb\rc\n",), ("",)], "t string").select(text.line_starts(F.col("t"))).collect()
    assert [r[0] for r in starts] == [[0, 4, 6, 8], [0]]


def test_checkpoint_folder_must_be_shared(monkeypatch):
    from types import SimpleNamespace

    from lodestrata import session

    def fake(master):
        empty = SimpleNamespace(isEmpty=lambda: True, get=lambda: "")
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)), setCheckpointDir=lambda d: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context)

    session.ensure_checkpoint_dir(fake("local[4]"))
    for master in ("spark://x:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            session.ensure_checkpoint_dir(fake(master))
