"""Files as tables: scans, listings, content hashes, remote listings, configuration.

Nothing here follows paths on executors by itself; Spark's binaryFile source lists
and reads them. Names are judged by columns, so that the rules hold for a manifest
of a remote place as well.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S

#: Folder names that are never scanned, in any case.
JUNK = ("resources", "database", "caches", "thumbnails", "private", ".photoslibrary", "external", "scopes", ".git", "@eaDir", "#recycle", "$RECYCLE.BIN", "System Volume Information")
MODES = ("full", "shard")
EDGE = 65_536


def wanted(rel_path: Column) -> Column:
    """Whether a file is media to import: no name on its way is hidden, no folder is junk, and its extension is known."""
    parts = F.split(rel_path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    clean = ~F.exists(parts, lambda p: p.startswith(".")) & ~F.exists(folders, lambda p: F.lower(p).isin(*[x.lower() for x in JUNK]))
    return clean & S.extension(rel_path).isin(*S.IMAGE_EXT, *S.VIDEO_EXT)


def below(path: Column, root: str) -> Column:
    """Path below root; a file system's prefix and doubled slashes don't count."""
    plain = F.regexp_replace(F.regexp_replace(path, "^[a-z]+:/+", "/"), "%20", " ")
    return F.substring(plain, len(root.rstrip("/")) + 2, 1 << 20)


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """rel_path, size, modified and, if asked, content of all files under a folder; files that can't be read are passed over."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    rows = read.load(root).select(below(F.col("path"), root).alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if content else []))
    return rows


def media(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, size, modified, ext, hash, content of all media under a folder. Names are judged before any content is read."""
    return scan(spark, root, content=True).where(wanted(F.col("rel_path"))).select("rel_path", "size", "modified", S.extension(F.col("rel_path")).alias("ext"), F.sha2("content", 256).alias("hash"), "content")


def listing(files: DataFrame, partial: bool = True) -> DataFrame:
    """rel_path of the files that a replica holds: names without a leading dot; partial says whether unfinished .part files count."""
    name = F.element_at(F.split("rel_path", "/"), -1)
    rows = files.where(~name.startswith("."))
    return (rows if partial else rows.where(~name.endswith(".part"))).select("rel_path").distinct()


def quick_signature(size: Column, content: Column) -> Column:
    """Size and hash of both ends of the content."""
    ends = F.concat(F.substring(content, 1, EDGE), F.when(size > EDGE, F.substring(content, -EDGE, EDGE)).otherwise(F.lit(b"")))
    return F.concat_ws(":", size.cast("string"), F.sha2(ends, 256))


def snapshot(files: DataFrame) -> DataFrame:
    """What a watcher compares: path, size and time of change."""
    return files.select("rel_path", "size", F.unix_millis(F.col("modified").cast("timestamp")).alias("modified"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """rel_path of what is new, gone or different between two snapshots."""
    both = after.exceptAll(before).unionByName(before.exceptAll(after))
    return both.select("rel_path").distinct()


PAGE = "struct<assets:struct<items:array<struct<id:string,originalFileName:string,originalPath:string,checksum:string,type:string,fileCreatedAt:string,isTrashed:boolean,libraryId:string>>,nextPage:string,total:bigint>>"


def remote_assets(pages: DataFrame, body: str = "body") -> DataFrame:
    """Rows of the answers of a paged listing: own images and videos that aren't in its trash."""
    items = pages.select(F.explode(F.from_json(body, PAGE)["assets"]["items"]).alias("x")).select("x.*")
    return items.where(F.col("libraryId").isNull() & ~F.coalesce("isTrashed", F.lit(False)) & F.col("type").isin("IMAGE", "VIDEO")).drop("libraryId", "isTrashed")


def all_pages(spark: SparkSession, fetch) -> DataFrame:
    """Bodies of a paged listing as a table: fetch(page) gives the text of an answer; the next page is named in it."""
    import json

    bodies, page = [], "1"
    while page:
        body = fetch(page)
        bodies.append((body,))
        page = json.loads(body)["assets"].get("nextPage")
    return spark.createDataFrame(bodies, "body string")


def unseen(items: DataFrame, source_file: DataFrame, prefix: str = "immich:") -> DataFrame:
    """Items whose id no source file has recorded behind the prefix."""
    seen = source_file.where(F.col("abs_path").startswith(prefix)).select(F.substring("abs_path", len(prefix) + 1, 1 << 20).alias("id")).distinct()
    return items.join(seen, "id", "left_anti")


def config(spark: SparkSession, text: str) -> DataFrame:
    """Replicas of a TOML configuration as rows, in its order; a broken rule raises ValueError."""
    given = tomllib.loads(text)
    replicas = given.get("replica") or given.get("replicas") or []
    if not replicas:
        raise ValueError("at least one replica is needed")
    primary = given.get("primary", replicas[0].get("name"))
    rows = []
    for i, r in enumerate(replicas):
        mode, root = r.get("mode", "full"), r.get("root", "")
        if mode not in MODES:
            raise ValueError(f"mode {mode!r} of {r.get('name')!r} is none of {MODES}")
        if r.get("kind", "local") == "local" and "://" in root:
            raise ValueError(f"root {root!r} of a local replica must be a path")
        rows.append((r.get("name"), r.get("kind", "local"), root, bool(r.get("offline", False)), mode == "shard", r.get("capacity", "auto"), i, r.get("name") == primary))
    if primary not in {r[0] for r in rows}:
        raise ValueError(f"the primary {primary!r} is no replica")
    if any(r[7] and r[4] for r in rows):
        raise ValueError("the primary must hold everything")
    if given.get("immich", {}).get("enabled") and not given["immich"].get("url"):
        raise ValueError("a remote library needs a url")
    return spark.createDataFrame(rows, "replica string, kind string, root string, is_offline boolean, is_shard boolean, capacity string, place int, is_primary boolean")
