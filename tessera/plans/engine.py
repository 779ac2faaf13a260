"""The engine: build, search, list, delete and look after repositories.

A build resolves a folder to files, extracts entities, builds the graph, chunks files, maps chunks to nodes, finds communities
and embeds chunks, and then publishes all tables as one generation. Each stage can be replaced by a function.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import errors as E
from tessera.functions import text as T
from tessera.functions import values as V
from tessera.operators import chunking, community, extract, graph, incremental, retrieval
from tessera.operators._plan import cut
from tessera.sources import files as sources
from tessera.sources.store import Store

SCHEMA_VERSION = 2
STAGES = ("detect", "extract", "build", "chunk", "map", "cluster", "embed", "publish")


def hashed_embedding(texts: list[str], size: int = 64) -> list[list[float]]:
    """An embedding that needs no service: words hashed to signed places, unit length."""
    import re

    out = np.zeros((len(texts), size))
    for i, t in enumerate(texts):
        for w in re.findall(r"[a-z0-9_]+", t.lower()):
            h = hashlib.blake2b(w.encode(), digest_size=8).digest()
            out[i, int.from_bytes(h[:4], "little") % size] += 1 if h[4] & 1 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm == 0, 1, norm)).tolist()


def embed(chunks: DataFrame, embed_fn: Callable[[list[str]], list[list[float]]] = hashed_embedding, batch: int = 50, depth: int = 3) -> DataFrame:
    """(vector_id, embedding) of chunks (vector_id, content) that hold text, in batches.

    Limits of the rate are waited out and passing failures tried again. If a text is too long (a ValueError, or what a service
    says so by), a batch is halved, and a single text is cut in two up to `depth` times and its vectors averaged by
    length; a text that still fails is left out. Any other error ends the build."""

    def ask(texts: list[str]) -> list[list[float]]:
        return E.with_retries(lambda: list(embed_fn(texts)))

    def one(text: str, left: int) -> list[float] | None:
        try:
            return ask([text])[0]
        except Exception as e:
            if not E.too_long(e):
                raise
            if not left or len(text) < 2:
                return None
        middle = len(text) // 2
        feeds = [i + 1 for i in (text.rfind("\n", 0, middle), text.find("\n", middle)) if 0 < i + 1 < len(text)]
        cut = min(feeds, key=lambda i: abs(i - middle)) if feeds else middle
        parts = [(p, one(p, left - 1)) for p in (text[:cut], text[cut:])]
        got = [(max(1, len(p)), v) for p, v in parts if v is not None]
        return (sum(n * np.array(v) for n, v in got) / sum(n for n, _ in got)).tolist() if got else None

    def many(texts: list[str]) -> list[list[float] | None]:
        try:
            return ask(texts)
        except Exception as e:
            if not E.too_long(e):
                raise
            if len(texts) == 1:
                return [one(texts[0], depth)]
        half = len(texts) // 2
        return many(texts[:half]) + many(texts[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                vectors = many(part["content"].tolist())
                kept = [(k, v) for k, v in zip(part["vector_id"], vectors) if v is not None and len(v)]
                yield pd.DataFrame(kept, columns=["vector_id", "embedding"])

    return chunks.where(F.trim("content") != "").select("vector_id", "content").mapInPandas(run, "vector_id string, embedding array<double>")


@dataclass
class Engine:
    spark: SparkSession
    path: str
    embed_fn: Callable[[list[str]], list[list[float]]] = hashed_embedding
    chunk_size: int = 100
    overlap: int = 20
    overrides: dict[str, Callable] = field(default_factory=dict)
    progress: Callable[[str, int], None] | None = None

    def __post_init__(self) -> None:
        self.store = Store(self.spark, self.path)

    def _stage(self, name: str, default: Callable, *args):
        if self.progress:
            self.progress(name, int(100 * STAGES.index(name) / len(STAGES)))
        return self.overrides.get(name, default)(*args)

    def settings(self) -> str:
        return V.fingerprint({"size": self.chunk_size, "overlap": self.overlap, "schema": SCHEMA_VERSION})

    def build(self, slug: str, root: str, commit: str = "", branch: str = "") -> str:
        """Index a folder; the generation that is published, or the current one if nothing changed."""
        meta = self.store.metadata(slug)
        mode = incremental.can_reuse(meta, schema=SCHEMA_VERSION, fingerprint=self.settings(), branch=branch, commit=commit or "-", snapshot_ok=meta is not None)
        if mode == "same" and commit:
            return self.store.current(slug)["generation"]
        found = self._stage("detect", lambda: sources.scan(self.spark, root, sources.ignore_patterns(root)))
        # what several tables are made of is worked out once
        found = cut(found.withColumn("file_hash", V.content_hash(F.col("text"))))
        rows = cut(self._stage("extract", extract.extract, found.where("kind = 'code'")))
        nodes, edges = map(cut, self._stage("build", self._graph, rows))
        chunks = cut(self._stage("chunk", lambda f: chunking.linear(f, self.chunk_size, self.overlap, keep=("file_hash",)), found))
        pairs = self._stage("map", graph.node_chunks, nodes, chunks)
        groups = self._stage("cluster", community.communities, nodes, edges)
        nodes = nodes.join(groups, "id", "left")
        vectors = self._stage("embed", self._vectors, slug, chunks, mode)
        index = retrieval.postings(chunks.select(F.col("vector_id").alias("id"), "content").dropDuplicates(["id"]), "id", "content").tables()
        if self.progress:
            self.progress("publish", 95)
        tables = {"files": found.select("path", "kind", "bytes", "file_hash"), "nodes": nodes, "edges": edges, "chunks": chunks, "pairs": pairs, "vectors": vectors, **index}
        return self.store.publish(slug, tables, {"schema": SCHEMA_VERSION, "fingerprint": self.settings(), "branch": branch, "commit": commit, "root": root})

    def _graph(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        # files in the order of their paths, rows in the order of their files: the last of them wins
        rows = rows.withColumn("seq", F.struct("source_file", "seq"))
        nodes = graph.merge_nodes(rows.where("kind = 'node'"), ["label", "file_type", "source_file", "start_line", "end_line"])
        plain = rows.where("kind = 'edge'").select("source", "target", "relation", F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), "source_file")
        every = plain.unionByName(extract.link_bases(rows)).unionByName(extract.link_imports(rows)).unionByName(extract.link_calls(rows))
        every = every.withColumn("seq", F.struct("source_file", "confidence", "relation", "source"))
        kept = graph.without_dangling(every, nodes)
        return nodes, graph.collapse_edges(kept, ["relation", "confidence", "confidence_score", "source_file"]).withColumn("seq", F.xxhash64("lo", "hi"))

    def _vectors(self, slug: str, chunks: DataFrame, mode: str) -> DataFrame:
        wanted = chunks.where("embeddable").select("vector_id", "content", "hash").dropDuplicates(["vector_id"])
        if mode == "full":
            return embed(wanted, self.embed_fn).join(wanted.select("vector_id", "hash"), "vector_id")
        prior = self.store.read(slug, "vectors")
        kept = prior.join(wanted.select("vector_id"), "vector_id", "left_semi")
        new = wanted.join(kept.select("vector_id"), "vector_id", "left_anti")
        return kept.unionByName(embed(new, self.embed_fn).join(new.select("vector_id", "hash"), "vector_id"))

    def search(self, query: str, slugs: list[str] | None = None, top_k: int = 20, each: int = 5, depth: int = 2) -> DataFrame:
        """The best hits of all named repositories (all there are, if none are named); a repository that fails is left out."""
        if not query.strip():
            raise ValueError("the query is blank")
        vector, out = self.embed_fn([query])[0], None
        for slug in self.store.slugs(slugs):
            try:
                t = {n: self.store.read(slug, n) for n in ("nodes", "edges", "chunks", "pairs", "vectors", "postings", "terms", "totals")}
            except FileNotFoundError:
                continue
            hits = retrieval.hybrid(
                t["chunks"].select(F.col("vector_id").alias("id"), "path", "start_line", "end_line", "content"), t["vectors"].select(F.col("vector_id").alias("id"), "embedding"), query, vector,
                nodes=t["nodes"], edges=t["edges"], pairs=t["pairs"].select(F.col("id").alias("node"), F.col("vector_id").alias("chunk")), top_k=each, depth=depth,
                index=retrieval.Postings(t["postings"], t["terms"], t["totals"]),
            ).withColumn("slug", F.lit(slug))
            out = hits if out is None else out.unionByName(hits)
        if out is None:
            return self.spark.createDataFrame([], "slug string, id string, path string, start_line int, end_line int, provenance string, distance double, weight double, graph_path array<string>, relevance double")
        return out.orderBy(F.desc("relevance"), F.asc_nulls_last("distance"), "slug", "id").limit(top_k)

    def list_repos(self, page: int = 1, page_size: int = 50) -> tuple[list[dict], int]:
        """A page of repositories with their metadata, and how many there are."""
        every = self.store.slugs()
        return [{"slug": s, **(self.store.metadata(s) or {})} for s in every[(page - 1) * page_size : page * page_size]], len(every)

    def delete(self, slug: str) -> bool:
        return self.store.drop(slug)

    def recover(self, grace_seconds: int = 3600) -> dict[str, list[str]]:
        return {s: self.store.collect_garbage(s, grace_seconds) for s in self.store.slugs()}


def show(hits: DataFrame, full: bool = False) -> str:
    """Hits as text for a terminal."""
    rows = hits.select(T.place_label(F.col("path"), F.col("start_line"), F.col("end_line")).alias("place"), "provenance", "relevance", "weight").collect()
    return "\n".join(f"{r['relevance']:.3f}  {r['provenance']:<6}  {r['place']}" + (f"  weight {r['weight']:.2f}" if full and r["weight"] is not None else "") for r in rows)
