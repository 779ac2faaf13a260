import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking, extract
from tessera.plans.engine import Engine, embed
from tessera.sources import files
from tessera.sources.store import Store

PY = '''"""A module that has a rather long docstring."""
import os
from .b import Base, other

class Child(Base):
    def run(self):
        helper()
        other()

def helper():
    # NOTE: keep it small
    return os.getcwd()
'''
B = "class Base:\n    pass\n\ndef other():\n    return 1\n"
TS = "import { x } from './util';\nexport class Shop extends Base {\n  open() { greet(); }\n}\nconst greet = () => { return far(); };\n"


@pytest.fixture
def tree(tmp_path):
    for name, text in {"pkg/a.py": PY, "pkg/b.py": B, "web/shop.ts": TS, "README.md": "how to run\n" * 3, "node_modules/x.js": "1", ".env": "k", "my_secret.txt": "no"}.items():
        (tmp_path / "repo" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / name).write_text(text)
    return tmp_path


def test_scan_prunes(spark, tree):
    got = files.scan(spark, str(tree / "repo"))
    assert sorted(r["path"] for r in got.collect()) == ["README.md", "pkg/a.py", "pkg/b.py", "web/shop.ts"]
    s = files.statistics(got).first()
    assert (s["files"], s["code"], s["documents"], s["words"]) == (4, 3, 1, 9)


def test_extraction_and_links(spark, tree):
    rows = extract.extract(files.scan(spark, str(tree / "repo"))).cache()
    ids = {r["label"]: r["id"] for r in rows.where("kind = 'node'").collect()}
    assert {"Child", ".run()", "helper()", "Base", "other()", "Shop", ".open()", "greet()"} <= set(ids)
    e = {(r["source"], r["target"], r["relation"]) for r in rows.where("kind = 'edge'").collect()}
    assert (ids[".run()"], ids["helper()"], "calls") in e and (ids["Child"], ids[".run()"], "method") in e and (ids[".open()"], ids["greet()"], "calls") in e
    assert ("pkg_a_py", "pkg_b_py", "imports_from") in e and any(r == "rationale_for" for *_, r in e)
    calls = {(r["source"], r["target"]) for r in extract.link_calls(rows).collect()}
    assert (ids[".run()"], ids["other()"]) in calls
    assert (ids["Child"], ids["Base"]) in {(r["source"], r["target"]) for r in extract.link_bases(rows).collect()}
    assert (ids["Child"], ids["other()"]) in {(r["source"], r["target"]) for r in extract.link_imports(rows).collect()}


def test_bad_source_gives_its_file_only():
    assert [r["kind"] for r in extract.python_rows("x.py", "def (")] == ["node"]


def test_build_search_rebuild(spark, tree):
    engine = Engine(spark, f"file://{tree}/index")
    first = engine.build("demo", str(tree / "repo"), commit="c1")
    assert engine.build("demo", str(tree / "repo"), commit="c1") == first
    hits = engine.search("helper docstring", top_k=5)
    rows = hits.collect()
    assert rows and rows[0]["path"] == "pkg/a.py" and [r["relevance"] for r in rows] == sorted((r["relevance"] for r in rows), reverse=True)
    (tree / "repo/pkg/c.py").write_text("def fresh_thing():\n    return 2\n")
    second = engine.build("demo", str(tree / "repo"), commit="c2")
    assert second != first and engine.store.current("demo")["previous"] == first
    assert engine.search("fresh_thing").first()["path"] == "pkg/c.py"
    assert engine.list_repos()[1] == 1 and engine.search("x", slugs=[]).count() == 0
    with pytest.raises(ValueError):
        engine.search(" ")
    assert engine.delete("demo") and engine.list_repos()[1] == 0


def test_failed_build_keeps_the_pointer(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    g = store.publish("s", {"t": spark.range(3)})
    with pytest.raises(Exception):
        store.publish("s", {"t": spark.range(3), "u": spark.range(1).select(F.raise_error("no").alias("x"))})
    assert store.current("s")["generation"] == g and store.read("s", "t").count() == 3


def test_retention(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    names = [store.publish("s", {"t": spark.range(i + 1)}) for i in range(3)]
    assert store.collect_garbage("s", 3600) == [] and store.collect_garbage("s", -1) == names[:1]
    assert store.read("s", "t").count() == 3


def test_embedding_halves_what_is_too_long(spark):
    def picky(texts):
        if sum(map(len, texts)) > 8:
            raise ValueError("too long")
        return [[float(len(t)), 1.0] for t in texts]

    c = spark.createDataFrame([("a", "1234"), ("b", "12345678abcd"), ("c", " ")], "vector_id string, content string")
    got = {r["vector_id"]: r["embedding"] for r in embed(c, picky).collect()}
    assert got == {"a": [4.0, 1.0], "b": [6.0, 1.0]}


@pytest.mark.parametrize(("n", "want"), [(0, [(1, 1)]), (5, [(1, 5)]), (6, [(1, 5), (5, 6)]), (9, [(1, 5), (5, 9)]), (10, [(1, 5), (5, 9), (9, 10)])])
def test_windows(spark, n, want):
    f = spark.createDataFrame([("p", "\n".join("x" * n))], "path string, text string")
    got = chunking.linear(f, 5, 1).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"]) for r in got] == want and got[0]["embeddable"] == (n > 0)


def test_islands(spark):
    s = spark.createDataFrame([("p", 1, 2, False, 0), ("p", 3, 5, True, 1), ("p", 6, 6, False, 2), ("p", 9, 9, False, 3)], "path string, start_line int, end_line int, structural boolean, ordinal int")
    assert [(r["start_line"], r["end_line"]) for r in chunking.islands(s).orderBy("start_line").collect()] == [(1, 2), (3, 6), (9, 9)]


def test_ignore_and_ids(spark):
    one = spark.range(1)
    hit = lambda p, *g: one.select(T.ignored(F.lit(p), list(g))).first()[0]
    assert hit("a/b/c.py", "*.py") and hit("a/b/c.py", "a/b") and hit("a/b/c.py", "b") and not hit("a/b/c.py", "d", "*.js")
    assert one.select(T.make_id(F.lit("_a."), F.lit(""), F.lit("B c!"))).first()[0] == "a_b_c"
    assert one.select(T.halves(F.lit("ab\ncdef"))).first()[0] == ["ab\n", "cdef"]


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    assert files.docx_text(out.getvalue()) == "# Top\n| a |\n| --- |" and files.docx_text(b"no") == ""


def test_landing_stream(spark, tmp_path):
    from tessera import streaming

    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"path": "a.py", "text": "x\\ny"}\n')
    q = streaming.index(streaming.landing(spark, f"file://{tmp_path}/in"), lambda b: chunking.linear(b), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    q.awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 1
