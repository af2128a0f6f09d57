"""A sink for pages: rows of (path, page) become files below a folder that all executors see.

Tasks write what they have into a folder of their own attempt; the commit moves
the files to their places, deletes those of the last manifest that are gone and
writes the new manifest. An aborted job leaves the pages as they were; a task that
is still at work then may leave its staging folder. Only names pass through the
driver.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MANIFEST = "doc-manifest.json"


def inside(path: str) -> str:
    """A relative path with / that stays in its folder; an error for any other."""
    plain = path.replace("\\", "/")
    parts = [p for p in plain.split("/") if p not in ("", ".")]
    if not parts or plain.startswith("/") or ".." in parts or ":" in parts[0] or parts[0].startswith("_staging-") or plain == MANIFEST:
        raise ValueError(f"leaves the folder: {path}")
    return "/".join(parts)


@dataclass
class Written(WriterCommitMessage):
    folder: str = ""
    paths: list[str] = field(default_factory=list)


class PageWriter(DataSourceWriter):
    def __init__(self, root: str, manifest: dict):
        self.root, self.manifest = root, manifest
        self.staging = os.path.join(root, f"_staging-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = os.path.join(self.staging, uuid.uuid4().hex)  # an attempt's own
        paths = []
        for row in iterator:
            path = inside(row["path"])
            place = os.path.join(folder, path)
            os.makedirs(os.path.dirname(place), exist_ok=True)
            with open(place, "w", encoding="utf-8", newline="\n") as f:
                f.write(row["page"])
            paths.append(path)
        return Written(folder, paths)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        paths = [p for m in told for p in m.paths]
        if twice := len(paths) - len(set(paths)):
            self.abort(messages)
            raise ValueError(f"{twice} paths have more than one page")
        before = generated(self.root)
        for m in told:
            for p in m.paths:
                place = os.path.join(self.root, p)
                os.makedirs(os.path.dirname(place), exist_ok=True)
                os.replace(os.path.join(m.folder, p), place)
        for p in before - set(paths):
            self._delete(p)
        entries = sorted(paths)
        text = json.dumps({**self.manifest, "generated_files": entries, "generated_file_count": len(entries)}, ensure_ascii=False, indent=2) + "\n"
        os.makedirs(self.root, exist_ok=True)
        made = os.path.join(self.root, f"{MANIFEST}.new")
        with open(made, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(made, os.path.join(self.root, MANIFEST))
        shutil.rmtree(self.staging, ignore_errors=True)

    def _delete(self, path: str) -> None:
        place = os.path.join(self.root, inside(path))
        if os.path.isfile(place):
            os.remove(place)
            above = os.path.dirname(place)
            while above != self.root and not os.listdir(above):
                os.rmdir(above)
                above = os.path.dirname(above)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class PageSink(DataSource):
    """``df.write.format("factloom_pages").option("root", folder).mode("append")``; the option ``manifest`` holds further fields, as JSON."""

    @classmethod
    def name(cls) -> str:
        return "factloom_pages"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(os.path.normpath(self.options["root"]), json.loads(self.options.get("manifest") or "{}"))


def generated(root: str) -> set[str]:
    """The files of the last manifest; none without one that can be read."""
    try:
        with open(os.path.join(root, MANIFEST), encoding="utf-8") as f:
            return {p for p in json.load(f).get("generated_files", []) if isinstance(p, str)}
    except (OSError, ValueError, AttributeError):
        return set()


def write_pages(pages: DataFrame, root: str, manifest: dict | None = None) -> list[str]:
    """Writes (path, page) rows below root and deletes what the last manifest had and this one hasn't; other files stay. Returns the new manifest's files."""
    spark: SparkSession = pages.sparkSession
    spark.dataSource.register(PageSink)
    rows = pages.select("path", "page")
    rows.write.format("factloom_pages").option("root", root).option("manifest", json.dumps(manifest or {}, ensure_ascii=False)).mode("append").save()
    return sorted(generated(root))
