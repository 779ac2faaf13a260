"""Files, addresses, Git and the map of repositories; ids and kinds of files by what they should give."""

import subprocess

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import extract
from tessera.sources import files


def column(spark, f, rows):
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in d.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_sensitive_names(spark):
    yes = ["SERVER.PEM", "a/ID.Key", ".ENV", ".env.local", "x/.envrc", "cert.P12", "MyPassword.txt", "id_rsa", "id_ed25519.pub", ".netrc", ".PGPASS", "AWS_Credentials.json", "service-account.json", "private_key.txt"]
    no = ["a.py", "ID_RSA", "key.py", "secret/plain.py", "environment.md", "pem"]
    assert column(spark, T.sensitive, yes + no) == [True] * len(yes) + [False] * len(no)


def test_slugs_of_addresses(spark):
    got = column(spark, V.slug_of, ["https://h/a/b", "https://h/a/b.git", "https://h/a/b.git/", "https://h/a/b/", "git@h:a/b.git", "git@h:a/b", "https://h/a/b.c.git", "no/url:x.git"])
    assert got == ["a-b", "a-b", "a-b", "a-b", "a-b", "a-b", "a-b.c", "no-url-x"]
    assert column(spark, V.is_ssh_address, ["git@h:a/b.git", "https://h/a/b"]) == [True, False]


def test_kinds_of_files(spark):
    assert column(spark, T.file_kind, ["a.ejs", "a.JSX", "a.html", "a.docx", "a"]) == ["code", "code", "document", None, None]
    assert column(spark, T.category, ["a.ejs", "a.docx", "a.tex", "a.bib", "a.pdf", "a.ico", "a.md"]) == ["code", "paper", "paper", "paper", "paper", "image", "doc"]


def test_papers(spark):
    paper = "Abstract\nWe propose a thing, see arXiv:1706.03762."
    assert column(spark, T.looks_like_paper, [paper, "as [\n3\n] shows, eq. 4 of the Journal", "Smith et al wrote an abstract", None]) == [True, True, False, False]
    assert column(spark, T.paper_signals, ["\\cite{x} [1]", "\\CITE{x}", "Smith et al"]) == [2, 0, 0]


def test_scan_leaves_out_what_tools_write_and_follows_anchored_patterns(spark, tmp_path):
    top = tmp_path / "top"
    names = ["sub/a.py", "sub/gen/b.py", "sub/keep/c.py", "sub/go.sum", "sub/pnpm-lock.yaml", "sub/.pyrefly_cache/d.py", "sub/graph-out/e.py", "sub/graph-out/memory/f.md", "sub/x/Gemfile.lock", "sub/g.ejs"]
    for n in names:
        (top / n).parent.mkdir(parents=True, exist_ok=True)
        (top / n).write_text("x\n")
    (top / ".git").mkdir()
    (tmp_path / ".graphignore").write_text("keep\n")  # beyond the repository's top
    (top / ".graphignore").write_text("# c\n\nsub/gen\n/\n")
    rules = files.ignore_patterns(str(top / "sub"))
    assert rules == [("sub", "sub/gen")]
    got = files.scan(spark, str(top / "sub"), rules)
    assert sorted(r["path"] for r in got.collect()) == ["a.py", "g.ejs", "graph-out/memory/f.md", "keep/c.py"]
    assert sorted(r["path"] for r in files.scan(spark, str(top / "sub"), ["*.py"]).collect()) == ["g.ejs", "graph-out/memory/f.md"]


def test_paths_stay_inside(tmp_path):
    assert files.within("a/../b.py", str(tmp_path)) == "b.py" and files.within(str(tmp_path / "c"), str(tmp_path)) == "c"
    for bad in ("../x", "/etc/passwd", str(tmp_path) + "-other/x"):
        with pytest.raises(ValueError, match="outside"):
            files.within(bad, str(tmp_path))


def test_warnings():
    assert "not be needed" in files.warning(3, 49_999) and files.warning(3, 50_000) is None
    assert "subfolder" in files.warning(200, 50_000) and "subfolder" in files.warning(1, 500_000)


def run(folder, *args):
    return subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True, text=True).stdout.strip()


def test_checkout_heads_changes_and_map(spark, tmp_path):
    origin = tmp_path / "origin"
    origin.mkdir()
    run(origin, "init", "-b", "trunk")
    (origin / "a.py").write_text("one = 1\n" * 20)
    run(origin, "add", "."), run(origin, "commit", "-m", "1")
    first = run(origin, "rev-parse", "HEAD")
    target = str(tmp_path / "here")
    assert files.checkout(str(origin), target) == first and files.remote_head(target) == "origin/trunk"
    run(origin, "mv", "a.py", "b.py")
    (origin / "c.py").write_text("new\n")
    run(origin, "add", "."), run(origin, "commit", "-m", "2")
    run(origin, "branch", "side")
    second = run(origin, "rev-parse", "HEAD")
    assert files.checkout(str(origin), target, "side") == second
    assert sorted(map(tuple, files.changes(spark, target, first, second).collect())) == [("A", "c.py", None), ("R", "b.py", "a.py")]
    run(target, "symbolic-ref", "-d", "refs/remotes/origin/HEAD")
    assert files.remote_head(target) in ("origin/side", "origin/trunk")
    with pytest.raises(RuntimeError):
        files.checkout(str(tmp_path / "none"), str(tmp_path / "x"))
    known, url = files.RepoMap(str(tmp_path / "m/map.json")), "https://h/o/r.git"
    with pytest.raises(FileNotFoundError):
        files.resolve(url, str(tmp_path / "repos"), known, fetch=False)
    with pytest.raises(ValueError):
        files.resolve("nothing", str(tmp_path), known)
    known.register(url, target)
    assert files.resolve(url, str(tmp_path / "repos"), known, fetch=False) == target
    assert known.path_of(url) == target and known.url_of(target) == url
    known.register("git@h:o/r2", "/p2")
    known.unregister(url)
    assert known.path_of(url) is None and known.load() == {"git@h:o/r2": "/p2"}


def test_ids():
    assert extract.slug("src/My File.py") == "src_my_file_py" and extract.slug("_a.", "", "B.c()") == "a_b_c" and extract.slug("..") == ""
