"""An indexed corpus on disk: segments of chunks and links, a snapshot of files, and a manifest.

A sync writes one new segment with the rows of the files it did again, and a new snapshot of files that says in which
segment each file's chunks and links lie; rows of other files are neither read nor written. The manifest is swapped last,
so readers see the old state or the new one. A segment of which most rows are out of date is written anew.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.textops import anchor_slug, heading_leaf, is_markdown
from lodestone.functions.vectors import fake_embedding
from lodestone.sources import code, markdown, walk

STAMPS = {"chunk_version": 2, "link_version": 1}
NAMES = {"chunk_version": "chunker", "link_version": "link extraction", "embed_id": "embedding model"}
FILES = "rel_path string, mtime_ns long, size long, content_hash string, indexed_at_ns long, chunk_seg int, link_seg int"
CHUNKS = "rel_path string, chunk_key string, heading string, variant string, text string, line int, vec array<double>, seg int"
LINKS = "src_rel_path string, target string, anchor string, kind string, line int, seg int"
LAYOUT = 2  # of the files below a store; a store of an older one is brought up to it when it is opened
COMPACT = 8  # segments beyond which what is still valid is gathered in one


def diff(old: DataFrame, now: DataFrame, force: bool = False) -> DataFrame:
    """(rel_path, action) of a snapshot against a walk: add, check (stat differs), skip or delete."""
    o, n = old.select("rel_path", F.col("mtime_ns").alias("om"), F.col("size").alias("os")), now.select("rel_path", "mtime_ns", "size")
    same = (F.col("om") == F.col("mtime_ns")) & (F.col("os") == F.col("size")) & F.lit(not force)
    action = F.when(F.col("om").isNull(), "add").when(F.col("mtime_ns").isNull(), "delete").when(same, "skip").otherwise("check")
    return o.join(n, "rel_path", "full_outer").select("rel_path", action.alias("action"))


def actions(old: DataFrame, now: DataFrame, bare: DataFrame, force: bool = False, relink: bool = False) -> DataFrame:
    """(rel_path, action) of a snapshot against a walk with the hashes of what was read.

    ``old`` and ``now`` are (rel_path, mtime_ns, size, content_hash), ``bare`` (rel_path) the files whose chunks have no
    vectors yet and can get them. Actions: ``add`` and ``update`` (chunks, vectors and links anew), ``heal`` (the same for
    an unchanged file without vectors), ``relink`` (links only), ``touch`` (the new stat only), ``skip`` and ``delete``.
    """
    o = old.select("rel_path", F.col("mtime_ns").alias("om"), F.col("size").alias("os"), F.col("content_hash").alias("oh"))
    n = now.select("rel_path", "mtime_ns", "size", "content_hash")
    rows = o.join(n, "rel_path", "full_outer").join(bare.select("rel_path", F.lit(True).alias("bare")).distinct(), "rel_path", "left")
    whole, known = ~F.coalesce("bare", F.lit(False)), F.lit(not force)
    stat = (F.col("om") == F.col("mtime_ns")) & (F.col("os") == F.col("size"))
    text = F.col("oh") == F.col("content_hash")
    action = (
        F.when(F.col("mtime_ns").isNull(), "delete").when(F.col("om").isNull(), "add").when(F.lit(relink), "relink")
        .when(known & stat & whole, "skip").when(known & text & whole, "touch").when(known & text, "heal").otherwise("update")
    )
    return rows.select("rel_path", action.alias("action"))


def index_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, chunks, and when the last file was indexed."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.max("indexed_at_ns").alias("last_ns")).crossJoin(
        chunks.agg(F.count(F.lit(1)).alias("chunks"))
    )


def headings(chunks: DataFrame) -> DataFrame:
    """(rel_path, slug): the anchors that files have."""
    return chunks.filter("heading <> ''").select("rel_path", anchor_slug(heading_leaf(F.col("heading"))).alias("slug")).distinct()


class Corpus:
    """A directory and its index."""

    def __init__(self, spark: SparkSession, root: str, store: str | None = None, embedder: Callable[[Column], Column] | None = fake_embedding, embed_id: str = "fake+d4"):
        self.spark, self.root, self.embedder, self.embed_id = spark, os.path.abspath(root), embedder, embed_id
        self.store = store or os.path.join(self.root, ".lodestone")
        self._migrate()

    def _migrate(self) -> None:
        """Bring a store of the first layout, whose snapshots hold every table whole, up to this one; newer ones are refused."""
        found = self.manifest()
        layout = found.get("layout", 1 if "segments" not in found else LAYOUT)
        if layout > LAYOUT:
            raise ValueError(f"{self.store} has layout {layout}; this code knows {LAYOUT}")
        if layout == 1:
            n = found["snapshot"]
            here, segment = os.path.join(self.store, f"snap={n}"), os.path.join(self.store, f"seg={n}")
            for name, key in (("chunks", CHUNKS), ("links", LINKS)):
                whole = self.spark.read.schema(key.rpartition(", ")[0]).parquet(os.path.join(here, name, "*.parquet"))
                whole.withColumn("seg", F.lit(n)).write.mode("overwrite").parquet(os.path.join(segment, name))
            files = self.spark.read.schema(FILES.split(", chunk_seg")[0]).parquet(os.path.join(here, "files", "*.parquet"))
            moved, there = files.withColumns({"chunk_seg": F.lit(n), "link_seg": F.lit(n)}), os.path.join(self.store, f"snap={n + 1}")
            moved.write.mode("overwrite").parquet(os.path.join(there, "files"))
            self.spark.read.schema("rel_path string").parquet(os.path.join(here, "entries", "*.parquet")).write.mode("overwrite").parquet(os.path.join(there, "entries"))
            self._publish({"snapshot": n + 1, "segments": [n], "stamps": found["stamps"], "files": moved.count()})
            shutil.rmtree(here, ignore_errors=True)

    def manifest(self) -> dict:
        try:
            with open(os.path.join(self.store, "manifest.json"), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"snapshot": None, "segments": [], "stamps": {}, "files": 0}

    def stale(self, embed: bool = True) -> list[str]:
        """Which stamps differ from what this code would write; none for an index without files.

        Vectors count only where they can be made: without an embedder another model's vectors stay as they are.
        """
        found, wanted = self.manifest(), {**STAMPS, **({"embed_id": self.embed_id} if embed else {})}
        return [k for k, v in wanted.items() if found["files"] and found["stamps"].get(k) != v]

    def reason(self, embed: bool = True) -> str:
        """Why the next sync does more than the files' changes ask for; empty if it does not."""
        found, now = self.manifest()["stamps"], {**STAMPS, "embed_id": self.embed_id}
        return "; ".join(f"another {NAMES[k]} than before ({found.get(k) or 'unknown'}, now {now[k]})" for k in self.stale(embed))

    def _read(self, name: str, schema: str, segments: list[int]) -> DataFrame:
        paths = [p for s in segments if os.path.exists(p := os.path.join(self.store, f"seg={s}", name))]
        # the files themselves are named, as a path's ``seg=`` would be taken for a column
        return self.spark.read.schema(schema).parquet(*[os.path.join(p, "*.parquet") for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        found = self.manifest()
        if name in ("files", "entries"):
            schema = FILES if name == "files" else "rel_path string"
            place = os.path.join(self.store, f"snap={found['snapshot']}", name, "*.parquet")
            return self.spark.createDataFrame([], schema) if found["snapshot"] is None else self.spark.read.schema(schema).parquet(place)
        schema, key, at = (CHUNKS, "rel_path", "chunk_seg") if name == "chunks" else (LINKS, "src_rel_path", "link_seg")
        valid = self.table("files").select(F.col("rel_path").alias(key), F.col(at).alias("seg"))
        return self._read(name, schema, found["segments"]).join(valid, [key, "seg"], "left_semi").drop("seg")

    def sync(self, force: bool = False, embed: bool = True, progress: Callable[[str], None] = lambda text: None) -> dict:
        """Bring the index up to date; counts of what was done. ``progress`` hears what comes next.

        Without ``embed`` no vector is made and none is lost: chunks whose text stays keep theirs, others get none yet,
        and a later sync with an embedder heals their files. If only the extraction of links changed, links alone are
        done again.
        """
        embed = embed and self.embedder is not None
        began, stale, why = time.time(), self.stale(embed), self.reason(embed)
        force = force or "chunk_version" in stale or "embed_id" in stale
        relink = "link_version" in stale and not force
        found = self.manifest()
        n, spark = (found["snapshot"] or 0) + 1, self.spark
        here, segment = os.path.join(self.store, f"snap={n}"), os.path.join(self.store, f"seg={n}")
        progress(f"listing {self.root}")
        now, entries = walk.listing(spark, self.root)
        old, chunks = self.table("files"), self.table("chunks")
        bare = chunks.filter(F.size("vec") == 0).select("rel_path").distinct() if embed else chunks.limit(0).select("rel_path")
        first = diff(old, now, force or relink).filter("action IN ('add', 'check')")
        if relink:  # only documents have links
            first = first.filter((F.col("action") == "add") | is_markdown(F.col("rel_path")))
        first = first.select("rel_path")
        todo = first.unionByName(bare.join(now, "rel_path", "left_semi")).distinct()
        progress("reading what changed")
        walk.read_files(todo, self.root).write.mode("overwrite").parquet(os.path.join(here, "read"))
        read = spark.read.parquet(os.path.join(here, "read"))
        now = now.join(read.select("rel_path", "content_hash"), "rel_path", "left")
        actions(old, now, bare, force, relink).write.mode("overwrite").parquet(os.path.join(here, "plan"))
        plan = spark.read.parquet(os.path.join(here, "plan"))
        counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
        progress(", ".join(f"{n} to {k}" for k, n in sorted(counts.items()) if k != "skip") or "nothing to do")
        made, linked = F.col("action").isin("add", "update", "heal"), F.col("action").isin("add", "update", "heal", "relink")
        changed = read.join(plan.filter(made).select("rel_path"), "rel_path", "left_semi")
        fresh = code.code_chunks(changed)
        if embed:
            fresh = fresh.withColumn("vec", self.embedder(F.col("text")))
        else:
            known = chunks.filter(F.size("vec") > 0).select("rel_path", "chunk_key", "text", "vec")
            fresh = fresh.join(known, ["rel_path", "chunk_key", "text"], "left").withColumn("vec", F.coalesce("vec", F.array().cast("array<double>")))
        links = markdown.markdown_links(read.join(plan.filter(linked).select("rel_path"), "rel_path", "left_semi").filter(is_markdown(F.col("rel_path"))))
        stat = now.join(plan, "rel_path").join(old.select("rel_path", *(F.col(c).alias(f"was_{c}") for c in ("mtime_ns", "size", "content_hash", "indexed_at_ns", "chunk_seg", "link_seg"))), "rel_path", "left")
        kept, at = F.col("action").isin("skip", "relink"), F.lit(time.time_ns())
        pick = lambda new, name: F.when(kept, F.col(f"was_{name}")).otherwise(new).alias(name)
        files = stat.select(
            "rel_path", pick(F.col("mtime_ns"), "mtime_ns"), pick(F.col("size"), "size"), pick(F.coalesce("content_hash", "was_content_hash"), "content_hash"),
            pick(at, "indexed_at_ns"), F.when(made, F.lit(n)).otherwise(F.col("was_chunk_seg")).alias("chunk_seg"),
            F.when(linked, F.lit(n)).otherwise(F.col("was_link_seg")).alias("link_seg"),
        )
        select = lambda df, schema: df.withColumn("seg", F.lit(n)).select(*[c.split()[0] for c in schema.split(", ")])
        select(fresh, CHUNKS).write.mode("overwrite").parquet(os.path.join(segment, "chunks"))
        select(links, LINKS).write.mode("overwrite").parquet(os.path.join(segment, "links"))
        files.write.mode("overwrite").parquet(os.path.join(here, "files"))
        entries.write.mode("overwrite").parquet(os.path.join(here, "entries"))
        added, deleted, updated, relinked = (sum(counts.get(k, 0) for k in ks) for ks in (("add",), ("delete",), ("update", "heal"), ("relink",)))
        total = sum(counts.values()) - deleted
        # what was not made anew keeps its stamp
        stamps = {**STAMPS, "embed_id": self.embed_id} if embed else {**found["stamps"], **STAMPS}
        self._publish({"snapshot": n, "segments": [*found["segments"], n], "stamps": stamps, "files": total})
        for name in ("read", "plan"):
            shutil.rmtree(os.path.join(here, name))
        if found["snapshot"] is not None:
            shutil.rmtree(os.path.join(self.store, f"snap={found['snapshot']}"), ignore_errors=True)
        if len(found["segments"]) >= COMPACT:
            self.compact()
        return {
            "added": added, "updated": updated, "unchanged": total - added - updated - relinked, "relinked": relinked, "deleted": deleted, "files": total,
            "reason": why, "seconds": time.time() - began,
        }

    def compact(self) -> None:
        """Gather what is valid in one segment and remove the others."""
        found = self.manifest()
        n = found["snapshot"] + 1
        segment, here = os.path.join(self.store, f"seg={n}"), os.path.join(self.store, f"snap={n}")
        for name in ("chunks", "links"):
            self.table(name).withColumn("seg", F.lit(n)).write.mode("overwrite").parquet(os.path.join(segment, name))
        self.table("files").withColumns({"chunk_seg": F.lit(n), "link_seg": F.lit(n)}).write.mode("overwrite").parquet(os.path.join(here, "files"))
        self.table("entries").write.mode("overwrite").parquet(os.path.join(here, "entries"))
        self._publish({**found, "snapshot": n, "segments": [n]})
        for old in [f"snap={found['snapshot']}", *(f"seg={s}" for s in found["segments"])]:
            shutil.rmtree(os.path.join(self.store, old), ignore_errors=True)

    def _publish(self, manifest: dict) -> None:
        with open(os.path.join(self.store, "manifest.tmp"), "w", encoding="utf-8") as f:
            json.dump({**manifest, "layout": LAYOUT}, f)
        os.replace(os.path.join(self.store, "manifest.tmp"), os.path.join(self.store, "manifest.json"))
