"""Facts of the small project in the catalog, and of a tree on disk."""

import pytest

from factloom.functions import paths
from factloom.plans import catalog
from factloom.sources import extract, facts, manifests, tree


@pytest.fixture(scope="module")
def project(spark):
    return {k: v.cache() for k, v in catalog.project_facts(spark).items()}


def test_python_entities(project):
    got = {(r.file, r.name): r for r in project["entities"].collect()}
    cart = got["shop/cart.py", "Cart"]
    assert (cart.entity_type, cart.docstring, cart.exported, cart.container) == ("class", "A cart.", None, "shop.cart")
    add = got["shop/cart.py", "add"]
    assert add.signature == "def add(self, item, /, n: int = 1, *, gift = False) -> None"
    assert (add.entity_type, add.parent, add.exported) == ("method", "Cart", None)
    assert got["shop/cart.py", "total"].is_async and got["shop/cart.py", "total"].signature.startswith("async def total(cart: Cart)")
    assert got["shop/prices.py", "_secret"].exported is False


def test_script_entities(project):
    got = {(r.file, r.name): r for r in project["entities"].collect()}
    start = got["web/index.ts", "start"]
    assert (start.entity_type, start.exported, start.docstring, start.return_annotation) == ("function", True, "Starts.", "number")
    assert [(p.name, p.annotation, p["default"]) for p in start.parameters] == [("a", "number", None), ("b", None, "2")]
    assert (got["web/index.ts", "render"].entity_type, got["web/index.ts", "render"].is_async) == ("method", True)
    assert (got["web/lib/sum.ts", "sum"].line_start, got["web/lib/sum.ts", "sum"].line_end) == (1, 3)


def test_edges(project):
    got = {(r.source_file, r.imported): (r.dependency_type, r.resolved_file) for r in project["edges"].collect()}
    assert got["app.py", "shop.cart"] == ("internal", "shop/cart.py")
    assert got["app.py", "json"] == ("stdlib", None)
    assert got["app.py", "requests"] == ("third_party", None)
    assert got["shop/cart.py", "shop.prices"] == ("internal", "shop/prices.py")
    assert got["web/index.ts", "./lib/sum"] == ("internal", "web/lib/sum.ts")
    assert got["web/index.ts", "fs"] == ("node_builtin", None)
    assert got["web/index.ts", "react"] if ("web/index.ts", "react") in got else True
    assert got["web/index.ts", "nowhere"] == ("unresolved", None)


def test_dependencies(project):
    got = {(r.name, r.version, r.manifest_type) for r in project["dependencies"].collect()}
    assert ("react", "^18.0.0", "package.json:dependencies") in got
    assert ("requests", "==2.31.0", "requirements.txt") in got and ("rich", ">=13", "requirements.txt") in got
    assert not any(n.startswith("pkg") for n, _, _ in got)
    assert ("click[x]", "~= 8", "pyproject.toml:project.dependencies") in got
    assert ("local", None, "pyproject.toml:tool.poetry.dependencies") in got and not any(n == "python" for n, _, _ in got)


def test_relations_and_candidates(project):
    got = {(r.source, r.target): r.confidence for r in project["relations"].collect()}
    assert got == {("tests/test_cart.py", "shop/cart.py"): "high", ("tests/test_prices.py", "shop/prices.py"): "medium"}
    kinds = {(r.type, r.name): r for r in project["candidates"].collect()}
    assert kinds["entrypoint", "entry:app"].files == ["app.py", "shop/cart.py", "shop/prices.py"]
    assert kinds["package", "shop"].confidence == "high"
    assert kinds["test_target", "prices"].confidence == "medium"
    assert ("directory", "web") in kinds and ("directory", "shop") not in kinds


def test_broken_sources_give_no_rows(spark):
    texts = spark.createDataFrame([("a.py", "def ("), ("b.py", None), ("c.js", None), ("d.txt", "def x(): pass")], "path string, text string")
    assert extract.entities(texts).count() == 0 and extract.imports(texts).count() == 0


def test_manifests_of_wrong_shape(spark):
    texts = spark.createDataFrame([("package.json", "[1]"), ("x/package.json", "{"), ("pyproject.toml", "=")], "path string, text string")
    assert manifests.external_dependencies(texts).count() == 0


def test_tree(spark, tmp_path):
    for name in ("pkg/__init__.py", ".gitignore", "node_modules/x.js", "src/a.ts", "out2/keep.md", "skipme/y.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x\xff" if name.endswith("a.ts") else b"x")
    got = tree.read_tree(spark, str(tmp_path), skip=str(tmp_path / "skipme"))
    assert sorted(r.path for r in got.collect()) == [".gitignore", "out2/keep.md", "pkg/__init__.py", "src/a.ts"]
    assert {r.path: r.text for r in tree.decoded(got).collect()}["src/a.ts"] == "x"
    kinds = {r.path: r.file_type for r in tree.inventory(got).collect()}
    assert kinds == {".gitignore": "config", "out2/keep.md": "doc", "pkg/__init__.py": "source", "src/a.ts": "source"}


def test_inclusion(spark):
    rows = paths.classify(spark.createDataFrame([("src/a.py",), ("tests/a.py",), ("samples/a.py",), ("x.egg-info/PKG",), ("inventory.json",)], "path string"))
    keep = lambda **o: sorted(r.path for r in rows.filter(paths.included(**o)).collect())
    assert keep() == ["src/a.py", "tests/a.py"]
    assert keep(tests=False, fixtures=True) == ["samples/a.py", "src/a.py"]
    assert len(keep(fixtures=True, generated=True)) == 5


def test_lenient_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"module": "m", "n": 1}')
    (tmp_path / "b.json").write_text('{"module": "m", "n": 2}')
    (tmp_path / "c.json").write_text("[")
    good, bad = facts.read_lenient(spark, str(tmp_path), "module string, n long")
    assert [r.n for r in facts.last_by_key(good, "module").collect()] == [2]
    assert bad.count() == 1
    (tmp_path / "c.json").unlink()
    assert facts.read_strict(spark, str(tmp_path), "module string, n long").count() == 2


def test_dotenv():
    assert facts.dotenv("# c\nA=1\nexport B='x=y'\nnothing") == {"A": "1", "B": "x=y"}


SCRIPT = """// class Commented {
/* function no() { */
import {
  a,
} from "several/lines";
import one from 'one'; const two = require("two"), three = require('three');
import "side/effect";
export * from "./again";
const brace = "{", pattern = /[{/]+/g, text = `function f() { ${[1].map((x) => `{${x}`)} }`;
export async function load(
  path: string,
  { deep = 1, ...rest } = {},
): Promise<{ ok: boolean }> {
  if (path) { return { ok: true }; }
}
export default class Shelf extends Base.of({ a: 1 }) {
  static async put(item = "}") {
    function inner() {}
  }
  field = () => { };
  get;
}
const pick = async (a, b = [1, 2]): T => a;
let single = x => {
  return x;
};
export { pick, single as one };
export const number = 1;
  function late(x) { return x }
{ function hidden() {} }
"""


def test_scripts_with_odd_places_of_braces_and_lines():
    from factloom.sources import script

    got = script.read(SCRIPT)
    told = {d.name: d for d in got.declarations}
    assert [d.name for d in got.declarations] == ["load", "Shelf", "put", "pick", "single", "late"]
    load = told["load"]
    assert (load.line, load.end, load.is_async, load.returns) == (10, 15, True, "Promise<{ ok: boolean }>")
    assert extract.script_parameters(load.arguments)[0] == ("path", "parameter", "string", None, False)
    assert extract.script_parameters(load.arguments)[1][0] == "{ deep = 1, ...rest }"
    assert (told["Shelf"].base, told["Shelf"].line, told["Shelf"].end) == ("Base.of({ a: 1 })", 16, 22)
    assert (told["put"].parent, told["put"].is_async, told["put"].end) == ("Shelf", True, 19)
    assert (told["pick"].returns, told["pick"].is_async, told["pick"].line, told["pick"].end) == ("T", True, 23, 23)
    assert (told["single"].arguments, told["single"].end) == ("x", 26)
    assert got.exported == {"load", "Shelf", "pick", "single", "number"}
    assert got.imports == [("import", 6, "one"), ("require", 6, "two"), ("require", 6, "three"), ("import", 7, "side/effect"), ("re-export", 8, "./again")]


def test_scripts_that_end_early():
    from factloom.sources import script

    for text in ("", "class", "class A {", "export", "export default", "function f(", "const a =", "import", "import 'x", "`${", "/*", "'", "export {", "async function", "a = /["):
        script.read(text)


def test_tree_parts(spark, tmp_path):
    """Few or many parts, all files are read once."""
    for i in range(30):
        at = tmp_path / "one" / f"d{i % 3}" / f"e{i % 5}"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{i}.txt").write_bytes(b"x")
    spark.dataSource.register(tree.TreeSource)
    for parts in ("1", "3", "100"):
        got = spark.read.format(tree.TreeSource.name()).option("path", str(tmp_path)).option("parts", parts).option("files", "2").load()
        assert sorted(r.path.rsplit("/", 1)[1] for r in got.collect()) == sorted(f"{i}.txt" for i in range(30))


def test_specs(spark):
    from factloom.functions import text
    from pyspark.sql import functions as F

    rows = [("click[x] ~= 8", "click[x]", "~= 8"), (" attrs>=23 ", "attrs", ">=23"), ("a.b-c_d", "a.b-c_d", None), ("x[]>1", "x", "[]>1"), ("@scope", "", None), ("", "", None), ("n [e]", "n", "[e]")]
    got = spark.createDataFrame(rows, "s string, n string, v string").select("s", "n", "v", text.spec_name(F.col("s")).alias("name"), text.spec_version(F.col("s")).alias("version"))
    for r in got.collect():
        assert (r["name"], r["version"]) == (r["n"], r["v"]), r


def test_requirement_lines(spark):
    lines = "a==1\n b >= 2 # c\n-e x\n# a\nc\nd[x]==1\ne;python\nf @ url\ng ~=1\n\n"
    got = manifests.requirements(spark.createDataFrame([("requirements.txt", lines)], "path string, text string"))
    assert [(r["name"], r["version"]) for r in got.collect()] == [("a", "==1"), ("b", ">= 2 # c"), ("c", None), ("g", "~=1")]
