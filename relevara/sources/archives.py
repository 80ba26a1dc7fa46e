"""Chosen members of zip archives: the central directory tells what there is, and only what is wanted is unpacked.

Archives come as a table (path, content), as ``binaryFile`` reads a folder of them, one task for each few; a member is unpacked in
chunks and cut into lines, so that no member is held whole.

Defined cases: an archive that cannot be read, or has none of the members, gives no rows; a member in a folder is chosen by its whole name; a null content
is no archive; text that isn't UTF-8 has replacement characters; the last line needs no line end.
"""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a batch, and bytes of one read.
LINES, CHUNK = 5000, 1 << 20
SCHEMA = "path string, member string, n_members int, line long, value string"


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the zip files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")


def lines_of(member: io.BufferedIOBase) -> Iterator[bytes]:
    rest = b""
    while chunk := member.read(CHUNK):
        *full, rest = (rest + chunk).split(b"\n")
        yield from full
    if rest:
        yield rest


def member_batches(batches: Iterator[pa.RecordBatch], patterns: list[str]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string())
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["path", "member", "n_members", "line", "value"])
    rows: list[tuple] = []
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if not content.is_valid:
                continue
            try:
                whole = zipfile.ZipFile(io.BytesIO(content.as_buffer()))
            except zipfile.BadZipFile:
                continue
            names = [i.filename for i in whole.infolist() if not i.is_dir()]
            for name in names:
                if any(fnmatchcase(name, p) for p in patterns):
                    with whole.open(name) as member:
                        for n, line in enumerate(lines_of(member)):
                            rows.append((path, name, len(names), n, line.decode("utf-8", "replace").removesuffix("\r")))
                            if len(rows) >= LINES:
                                yield pack(rows)
                                rows = []
    if rows:
        yield pack(rows)


def members(found: DataFrame, patterns: list[str]) -> DataFrame:
    """(path, member, n_members, line, value): the lines of the members whose names match a pattern; n_members is what the archive has."""
    return found.select("path", "content").mapInArrow(lambda it: member_batches(it, patterns), SCHEMA)


def packed(files: DataFrame, by: str, name: str, text: str) -> DataFrame:
    """(path, content): the rows of each ``by`` as a zip archive of its texts, named by ``name``; a group is one archive."""

    def pack(frame):
        import pandas as pd

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for n, t in sorted(zip(frame[name], frame[text], strict=True)):
                z.writestr(zipfile.ZipInfo(n), t or "", zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"path": [str(frame[by].iloc[0])], "content": [out.getvalue()]})

    return files.select(F.col(by), F.col(name), F.col(text)).groupBy(by).applyInPandas(pack, "path string, content binary")


# functions go to the executors by value, which need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
