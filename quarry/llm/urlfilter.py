"""URL filter: a trie over reversed host labels, then path segments; the longest match of allow and block entries decides."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import LOWER, UPPER, cut

_LOWER = str.maketrans(UPPER, LOWER)
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class Trie:
    """Entries (verdict, host, path). An entry fits its host and all subdomains, if the path starts with the entry's path.

    A node is a dict. Under a host's node, the key ``"/"`` leads to the trie of its paths, where whole segments lead on and
    ``None`` holds what ends inside a segment: {prefix: (verdict, rule)}. The entry with the most host labels wins, then that with
    the longest path; of two entries alike in both, the last one given.
    """

    def __init__(self, entries: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in entries:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, {})[last] = (verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest match."""
        found = self.ranked(host, path)
        return found and found[1]

    def ranked(self, host: str, path: str) -> tuple[tuple[int, int], tuple[str, str]] | None:
        """((labels, path's length), (verdict, rule)) of the longest match."""
        node, segments, best = self.root, path.split("/"), None
        for k, label in enumerate(reversed(host.split("."))):
            node = node.get(label) if label != "/" else None
            if node is None:
                break
            if "/" in node and (found := self._path(node["/"], segments)):
                best = (k + 1, len(found[1]) - found[1].find("/") if "/" in found[1] else 0), found
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            for end, found in sorted(node.get(None, {}).items(), key=lambda x: len(x[0])):
                if segment.startswith(end):
                    best = found
            node = node.get(segment)
            if node is None:
                break
        return best


def judge(pages: DataFrame, entries: list[tuple[str, str, str]], *, default: str = "allow", id_col: str = "page_id", url_col: str = "url", most_entries: int = 1_000_000) -> DataFrame:
    """One row per page: its id, ``host``, ``path``, ``rule`` (null without a match) and ``verdict`` (``default`` without one).

    Tries of up to ``most_entries`` entries are broadcast. More entries are dealt out to several, through which the urls pass in turn, each pass a table in the shared folder; the
    longest match of all counts, so the result is the same. A null or empty url has an empty host and path; very long urls are read whole. Of entries alike in host and path
    the last one counts. Repeated rows give repeated results; an empty table an empty one; other columns aren't read, so their names can't clash.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), *[F.lit(None).cast(t).alias(c) for c, t in (("labels", "int"), ("length", "int"), ("rule", "string"), ("verdict", "string"))])
    schema = f"id {rows.schema['id'].dataType.simpleString()}, url string, labels int, length int, rule string, verdict string"
    parts = [entries[k : k + most_entries] for k in range(0, len(entries), most_entries)] or [[]]
    for k, part in enumerate(parts):
        rows = (cut(rows) if k else rows).mapInArrow(_pass(pages.sparkSession.sparkContext.broadcast(Trie(part))), schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split_url(x) for x in batch.column(1).to_pylist()]
            cols = [pa.array([x[k] for x in found], pa.string()) for k in (0, 1)]
            verdicts = pa.array([x or default for x in batch.column(5).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, batch.column(4), verdicts], names=["id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(split, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def _pass(shared):
    """Put the match of a trie where it is at least as long as the one found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, *before in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                found = shared.value.ranked(*split_url(url))
                if found and (before[0] is None or found[0] >= (before[0], before[1])):
                    before = [*found[0], found[1][1], found[1][0]]
                out.append(before)
            cols = [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["id", "url", "labels", "length", "rule", "verdict"])

    return run
