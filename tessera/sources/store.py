"""Generations: each build writes its tables into a folder of its own, and a pointer names the one to read.

Publishing replaces the pointer through a rename on the table's file system, after the new tables have been read back; a
failed build leaves the pointer where it was. Retired generations stay for a grace period.
"""

from __future__ import annotations

import json
import secrets
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession


STAMP = "%Y%m%dT%H%M%S%fZ"


def new_generation() -> str:
    """A sortable name: UTC to the microsecond, and a random end."""
    return datetime.now(timezone.utc).strftime(STAMP) + "-" + secrets.token_hex(4)


def generation_time(name: str) -> datetime | None:
    try:
        return datetime.strptime(name.split("-")[0], STAMP).replace(tzinfo=timezone.utc)
    except ValueError:
        return None


@dataclass
class Store:
    spark: SparkSession
    path: str

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _get(self, name: str) -> dict | None:
        p, fs = self._fs(name)
        if not fs.exists(p):
            return None
        rows = self.spark.read.text(p.toString(), wholetext=True).collect()
        try:
            return json.loads(rows[0][0])
        except (ValueError, IndexError):
            return None

    def _put(self, name: str, value: dict) -> None:
        draft, fs = self._fs(f"{name}.{secrets.token_hex(4)}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        final, _ = self._fs(name)
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(context.makeQualified(draft), context.makeQualified(final), options)

    def slugs(self, wanted: list[str] | None = None) -> list[str]:
        """Repositories that have a pointer, sorted; or those of `wanted`, in its order. An empty list names none."""
        p, fs = self._fs("")
        have = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory() and self._fs(f"{f.getPath().getName()}/current.json")[1].exists(self._fs(f"{f.getPath().getName()}/current.json")[0])) if fs.exists(p) else []
        return have if wanted is None else [s for s in wanted if s in have]

    def current(self, slug: str) -> dict | None:
        return self._get(f"{slug}/current.json")

    def read(self, slug: str, name: str, generation: str | None = None) -> DataFrame:
        g = generation or (self.current(slug) or {}).get("generation")
        if not g:
            raise FileNotFoundError(f"{slug} has no generation")
        return self.spark.read.parquet(f"{self.path}/{slug}/{g}/{name}")

    def publish(self, slug: str, tables: dict[str, DataFrame], meta: dict | None = None) -> str:
        """Write, read back, then point; the generation's name."""
        g = new_generation()
        try:
            counts = {}
            for name, df in tables.items():
                df.write.parquet(f"{self.path}/{slug}/{g}/{name}")
                counts[name] = self.spark.read.parquet(f"{self.path}/{slug}/{g}/{name}").count()
        except Exception:
            p, fs = self._fs(f"{slug}/{g}")
            fs.delete(p, True)
            raise
        before = self.current(slug)
        now = datetime.now(timezone.utc).isoformat()
        self._put(f"{slug}/{g}.json", {**(meta or {}), "counts": counts, "built_at": now})
        self._put(f"{slug}/current.json", {"generation": g, "previous": (before or {}).get("generation")})
        if before:
            old = self._get(f"{slug}/{before['generation']}.json") or {}
            self._put(f"{slug}/{before['generation']}.json", {**old, "retired_at": now})
        return g

    def metadata(self, slug: str) -> dict | None:
        now = self.current(slug)
        return self._get(f"{slug}/{now['generation']}.json") if now else None

    def collect_garbage(self, slug: str, grace_seconds: int, now: datetime | None = None) -> list[str]:
        """Drop generations other than the current and the previous one: incomplete ones at once, others when retired for the grace period."""
        at = self.current(slug)
        keep = {at["generation"], at.get("previous")} if at else set()
        now, gone = now or datetime.now(timezone.utc), []
        p, fs = self._fs(slug)
        for f in fs.listStatus(p) if fs.exists(p) else []:
            g = f.getPath().getName()
            if not f.isDirectory() or g in keep or generation_time(g) is None:
                continue
            meta = self._get(f"{slug}/{g}.json")
            if meta is not None:
                try:
                    retired = datetime.fromisoformat(meta.get("retired_at") or "")
                except ValueError:
                    self._put(f"{slug}/{g}.json", {**meta, "retired_at": now.isoformat()})
                    continue
                if retired > now - timedelta(seconds=grace_seconds):
                    continue
            fs.delete(f.getPath(), True)
            fs.delete(self._fs(f"{slug}/{g}.json")[0], False)
            gone.append(g)
        return gone

    def drop(self, slug: str) -> bool:
        p, fs = self._fs(slug)
        return bool(fs.exists(p) and fs.delete(p, True))

    def token(self, slugs: list[str] | None = None) -> str:
        """Changes whenever one of the repositories has another generation."""
        return json.dumps([[s, (self.current(s) or {}).get("generation")] for s in self.slugs(slugs)])
