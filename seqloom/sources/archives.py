"""Two named feature files out of ``<number>_P.tar.gz`` archives.

A compressed archive can only be read front to back, so an archive is the unit of work. It is inflated
once: its lines are streamed in batches to a stored table, and a member that could be read to its end
leaves a mark of completeness behind its lines. A join on the marks keeps whole members; what a
damaged spot has cut short is staged, but never given out.
"""

from __future__ import annotations

import os
import tarfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators.skew import join_spread, work_partitions
from seqloom.session import stored
from seqloom.sources.files import archive_participant, base_name
from seqloom.sources.storage import open_sequential

# The payload names inside an archive.
PAYLOADS = {
    "visual": "{pid}_OpenFace2.1.0_Pose_gaze_AUs.csv",
    "acoustic": "{pid}_OpenSMILE2.3.0_egemaps.csv",
}
LINE_BATCH = 20_000
_DAMAGE = (tarfile.TarError, EOFError, OSError, zlib.error)
#: ``record`` is "line", "whole" (the mark behind a member's lines) or "warning", numbered by ``line_no``.
_STAGED = (
    "participant long, archive string, record string, kind string, member long, line_no long, line string"
)
_MEMBER = ["participant", "archive", "kind", "member"]
_LISTING = "archive string, member string, error string"


def archive_table(listing: DataFrame) -> DataFrame:
    """``participant, archive, path`` of files that are named like an archive."""
    table = listing.select(
        archive_participant(F.col("path")).alias("participant"),
        base_name(F.col("path")).alias("archive"),
        "path",
    )
    return table.where(F.col("participant").isNotNull())


@contextmanager
def _open(path: str):
    with open_sequential(path) as source, tarfile.open(fileobj=source, mode="r|gz") as tar:
        yield tar


def _records(path: str, wanted: dict[str, str]) -> Iterator[tuple]:
    """``(record, kind, member, line_no, line)`` of the wanted members, in one pass over the archive.

    The pass ends early once every kind has been read whole.
    """
    missing = set(wanted.values())
    warnings: list[str] = []
    try:
        with _open(path) as tar:
            for position, member in enumerate(tar):
                name = os.path.basename(member.name)
                kind = wanted.get(name)
                if kind is None:
                    continue
                source = tar.extractfile(member)
                if source is None:
                    warnings.append(f"{name}: not a regular file")
                    continue
                number = 0
                try:
                    for raw in source:
                        text = raw.decode("utf-8", errors="replace").rstrip("\r\n")
                        yield "line", kind, position, number, text
                        number += 1
                except _DAMAGE as exc:
                    warnings.append(f"{name}: {exc}")
                    continue
                yield "whole", kind, position, number, None
                missing.discard(kind)
                if not missing:
                    break
    except _DAMAGE as exc:
        warnings.append(str(exc))
    for number, warning in enumerate(warnings):
        yield "warning", None, None, number, warning


def stage_payloads(archives: DataFrame, payloads: dict[str, str] | None = None) -> DataFrame:
    """Lines, marks and warnings of all archives as a stored table, each archive inflated once.

    Damaged and empty archives give a warning and fail nothing. The table is partitioned by
    ``record`` and ``kind``, so that reading the marks or one kind touches nothing else.
    """
    names = payloads or PAYLOADS

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                wanted = {t.format(pid=row.participant): kind for kind, t in names.items()}
                rows: list[tuple] = []
                for record in _records(row.path, wanted):
                    rows.append((row.participant, row.archive, *record))
                    if len(rows) >= LINE_BATCH:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    spread = archives.select("participant", "archive", "path").repartition(
        work_partitions(archives), "path"
    )
    return stored(spread.mapInPandas(read, _STAGED), "payload-lines", ("record", "kind"))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in _STAGED.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"member": "Int64", "line_no": "Int64"})


def whole_members(staged: DataFrame) -> DataFrame:
    """``participant, archive, kind, member``: where each kind stands whole.

    Of several members with one name, in several folders say, the last whole one counts.
    """
    marks = staged.where(F.col("record") == "whole")
    return marks.groupBy("participant", "archive", "kind").agg(F.max("member").alias("member"))


def payload_lines(staged: DataFrame) -> DataFrame:
    """``participant, archive, kind, member, line_no, line`` of whole members only."""
    lines = staged.where(F.col("record") == "line").drop("record")
    kept = join_spread(lines, whole_members(staged), _MEMBER, "line_no")
    return kept.select(*_MEMBER, "line_no", "line")


def read_payload_lines(archives: DataFrame, payloads: dict[str, str] | None = None) -> DataFrame:
    """Stage the archives and return the lines of their whole members."""
    return payload_lines(stage_payloads(archives, payloads))


def first_archives(archives: DataFrame, n: int = 3) -> DataFrame:
    return archives.orderBy("path").limit(n)


def list_members(archives: DataFrame) -> DataFrame:
    """``archive, member, error``: base names inside each archive."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows: list[tuple] = []
                try:
                    with _open(row.path) as tar:
                        for member in tar:
                            rows.append((row.archive, os.path.basename(member.name), None))
                except _DAMAGE as exc:
                    rows.append((row.archive, None, str(exc)))
                yield pd.DataFrame(rows, columns=["archive", "member", "error"])

    return archives.select("archive", "path").mapInPandas(read, _LISTING)


def distinct_warnings(staged: DataFrame) -> DataFrame:
    """Warnings per participant, each once, in the order met; an archive has at most a few."""
    met = F.collect_list(F.struct("archive", "line_no", "line"))
    warned = staged.where(F.col("record") == "warning")
    return warned.groupBy("participant").agg(
        F.array_distinct(F.transform(F.array_sort(met), lambda w: w["line"])).alias("warnings")
    )
