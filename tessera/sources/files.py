"""Files of a tree as a table, Git checkouts, ignore files, documents of Word."""

from __future__ import annotations

import io
import json
import os
import re
import subprocess
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.operators.incremental import parse_changes


#: Answers that are put back into the index lie here; neither hidden nor made files are left out below it.
MEMORY = "graph-out/memory/"


def scan(spark: SparkSession, root: str, ignore: list[tuple[str, str]] | list[str] | None = None, keep_text: bool = True) -> DataFrame:
    """(path, kind, bytes, mtime, text) of the indexed files below root.

    Paths are judged before contents are read: hidden, made, ignored and sensitive files never are. `ignore` has patterns, or
    pairs of a pattern and the way from the folder that it was found in down to the root; such a pattern may fit either the path
    below the root or the one below that folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.rstrip("/").removeprefix("file://"))
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + base + "/", "")
    rows = raw.withColumn("path", path)
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith("."))
    fine = F.col("path").startswith(MEMORY) | (~hidden & ~T.noisy(F.col("path")))
    fine = fine & ~T.sensitive(F.col("path")) & ~T.file_name(F.col("path")).isin(C.LOCK_FILES)
    rules = [("", x) if isinstance(x, str) else x for x in ignore or []]
    if rules:
        fine = fine & ~T.ignored(F.col("path"), [p for _, p in rules])
    for down in sorted({d for d, _ in rules if d}):
        fine = fine & ~T.ignored(F.concat(F.lit(down + "/"), F.col("path")), [p for d, p in rules if d == down])
    rows = rows.where(fine).withColumn("kind", T.file_kind(F.col("path"))).where(F.col("kind").isNotNull())
    text = [F.decode("content", "UTF-8").alias("text")] if keep_text else []
    return rows.select("path", "kind", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), *text)


def ignore_patterns(root: str, name: str = ".graphignore") -> list[tuple[str, str]]:
    """(way down to root, pattern) of the ignore files from root up to the repository's top; the way is empty for root's own."""
    top = os.path.abspath(root.removeprefix("file://"))
    out, at = [], top
    while True:
        file = os.path.join(at, name)
        if os.path.isfile(file):
            down = "" if at == top else os.path.relpath(top, at).replace(os.sep, "/")
            with open(file, errors="ignore") as f:
                out += [(down, x) for x in map(str.strip, f) if x.strip("/") and not x.startswith("#")]
        if os.path.exists(os.path.join(at, ".git")) or os.path.dirname(at) == at:
            return out
        at = os.path.dirname(at)


def within(path: str, root: str) -> str:
    """The path relative to root, with slashes; an error if it leads out of root."""
    top = os.path.realpath(root)
    full = os.path.realpath(path if os.path.isabs(path) else os.path.join(top, path))
    if full != top and not full.startswith(top.rstrip(os.sep) + os.sep):
        raise ValueError(f"{path} is outside {root}")
    return os.path.relpath(full, top).replace(os.sep, "/")


def resolve(url: str, folder: str, known: RepoMap, fetch: bool = True, branch: str | None = None) -> str:
    """Where the repository of an address is: its known checkout, brought up to date, or a new clone below `folder`. Without
    `fetch` nothing is asked of the remote, and a checkout must be there already."""
    form = next((m for m in (re.match(C.HTTPS_ADDRESS, url), re.match(C.SSH_ADDRESS, url)) if m), None)
    if form is None:
        raise ValueError(f"{url} is no HTTPS or SSH address of a repository")
    place = known.path_of(url) or os.path.join(folder, f"{form[1]}-{form[2]}")
    if not fetch:
        if not os.path.isdir(os.path.join(place, ".git")):
            raise FileNotFoundError(f"no checkout of {url}")
    else:
        os.makedirs(os.path.dirname(place) or ".", exist_ok=True)
        checkout(url, place, branch)
    if known.path_of(url) != place:
        known.register(url, place)
    return place


def warning(files: int, words: int) -> str | None:
    """What is said of a tree that is small enough for a prompt, or large."""
    if words < C.FEW_WORDS:
        return f"{words} words fit into one prompt; a graph may not be needed"
    if words >= C.MANY_WORDS or files >= C.MANY_FILES:
        return f"{files} files and {words} words: consider a subfolder"
    return None


def statistics(files: DataFrame) -> DataFrame:
    """One row: files, code files, documents, words of documents."""
    words = F.sum(F.when(F.col("kind") == "document", T.word_count(F.col("text"))))
    return files.agg(F.count("*").alias("files"), F.count_if(F.col("kind") == "code").alias("code"), F.count_if(F.col("kind") == "document").alias("documents"), F.coalesce(words, F.lit(0)).cast("long").alias("words"))


def git(target: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", target, *args], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.strip()}")
    return done.stdout


def checkout(url: str, target: str, branch: str | None = None) -> str:
    """Clone or fetch, and detach at the remote commit; the commit."""
    if not os.path.isdir(os.path.join(target, ".git")):
        done = subprocess.run(["git", "clone", "--no-checkout", url, target], capture_output=True, text=True)
        if done.returncode:
            raise RuntimeError(f"git clone: {done.stderr.strip()}")
    git(target, "remote", "set-url", "origin", url)
    git(target, "fetch", "--prune", "origin")
    ref = f"origin/{branch}" if branch else remote_head(target)
    git(target, "checkout", "--force", "--detach", ref)
    return git(target, "rev-parse", "HEAD").strip()


def remote_head(target: str) -> str:
    refs = git(target, "for-each-ref", "--format=%(symref:short) %(refname:short)", "refs/remotes/origin").splitlines()
    named = sorted((x.split(" ") for x in refs), key=lambda x: x[0] == "")  # the remote's own choice first
    if not named:
        raise RuntimeError("the remote has no branch")
    return named[0][0] or named[0][1]


def changes(spark: SparkSession, target: str, old: str, new: str) -> DataFrame:
    """(status, path, old_path) between two commits, renames and copies found."""
    listed = git(target, "diff", "--name-status", "-z", "-M", "-C", old, new)
    return spark.createDataFrame(parse_changes(listed), "status string, path string, old_path string")


def docx_text(content: bytes) -> str:
    """Headings, lists, paragraphs and tables of a Word file; empty if it is none."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    out = []
    for e in body if body is not None else []:
        if e.tag == f"{w}tbl":
            rows = [[said(c) for c in r.iter(f"{w}tc")] for r in e.iter(f"{w}tr")]
            if rows:
                out += ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]
        elif e.tag == f"{w}p" and said(e):
            style = next((s.get(f"{w}val", "") for s in e.iter(f"{w}pStyle")), "")
            level = re.match(r"Heading(\d)", style)
            out.append(("#" * int(level[1]) + " " if level else "- " if "List" in style else "") + said(e))
    return "\n".join(out)


class RepoMap:
    """URL to path, in a JSON file that is replaced whole."""

    def __init__(self, path: str) -> None:
        self.path = path

    def load(self) -> dict[str, str]:
        if not os.path.exists(self.path):
            return {}
        with open(self.path) as f:
            return json.load(f)

    def save(self, mapping: dict[str, str]) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(self.path + ".tmp", "w") as f:
            json.dump(mapping, f, indent=1, sort_keys=True)
        os.replace(self.path + ".tmp", self.path)

    def register(self, url: str, path: str) -> None:
        self.save({**self.load(), url: path})

    def unregister(self, url: str) -> None:
        self.save({k: v for k, v in self.load().items() if k != url})

    def path_of(self, url: str) -> str | None:
        return self.load().get(url)

    def url_of(self, path: str) -> str | None:
        return next((u for u, p in self.load().items() if p == path), None)
