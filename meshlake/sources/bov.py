"""Bricks of values: a text header and raw binary data.

Headers are small; bricks are read in byte ranges (``ranges``), each variable as one table
whatever the number of files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import Index, Layout, list_files, open_range

FORMATS = {"INT": "i4", "FLOAT": "f4", "DOUBLE": "f8"}
#: Bytes of a header at most.
LONGEST = 1 << 20


@dataclass(frozen=True)
class Header:
    variable: str
    data_file: str
    size: tuple[int, int, int]
    format: str
    time: float = 0.0
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    brick: tuple[float, float, float] = (1.0, 1.0, 1.0)
    offset: int = 0
    little: bool = True


def parse_header(text: str) -> Header:
    """A header's ``NAME: value`` lines; # starts a comment.  Every size must be 2 or more."""
    found = {}
    for line in text.splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        if colon:
            found[name.strip().upper()] = value.split()
    for needed in ("DATA_FILE", "DATA_SIZE", "DATA_FORMAT", "VARIABLE"):
        if not found.get(needed):
            raise ValueError(f"the header has no {needed}")
    size = tuple(int(x) for x in found["DATA_SIZE"])
    if len(size) != 3 or min(size) < 2:
        raise ValueError(f"bad DATA_SIZE {size}")
    kind = found["DATA_FORMAT"][0].upper()
    kind = {"INTEGER": "INT"}.get(kind, kind)
    if kind not in FORMATS:
        raise ValueError(f"unknown DATA_FORMAT {kind}")
    triple = lambda name, default: tuple(float(x) for x in found[name]) if name in found else default
    return Header(
        variable=found["VARIABLE"][0].strip('"'),
        data_file=found["DATA_FILE"][0],
        size=size,
        format=kind,
        time=float(found.get("TIME", ["0"])[0]),
        origin=triple("BRICK_ORIGIN", (0.0, 0.0, 0.0)),
        brick=triple("BRICK_SIZE", (1.0, 1.0, 1.0)),
        offset=int(found.get("BYTE_OFFSET", ["0"])[0]),
        little=found.get("DATA_ENDIAN", ["LITTLE"])[0].upper() != "BIG",
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(variable, ts, i, j, k, x, y, z, value) of all headers that ``path`` matches.

    Headers must agree on size, origin and brick; time steps are the sorted distinct times.  Of
    headers with the same variable and time the first, in order of paths, counts.
    """
    headers = []
    for where in list_files(spark, path):
        with open_range(where) as file:
            headers.append((where, parse_header(file.read_at(min(file.size(), LONGEST), 0).decode())))
    if len({(h.size, h.origin, h.brick) for _, h in headers}) > 1:
        raise ValueError("headers disagree on size or place")
    times = sorted({h.time for _, h in headers})
    out = None
    for name in sorted({h.variable for _, h in headers}):
        paths: list[str] = []
        layouts: list[Layout] = []
        steps: dict[int, tuple[int, int, int]] = {}
        for where, h in headers:
            ts = times.index(h.time)
            if h.variable != name or ts in steps:
                continue
            paths.append(h.data_file if h.data_file.startswith("/") or "://" in h.data_file else f"{where.rsplit('/', 1)[0]}/{h.data_file}")
            layout = Layout(list(reversed(h.size)), ("<" if h.little else ">") + FORMATS[h.format], h.offset)
            if layout not in layouts:
                layouts.append(layout)
            steps[ts] = (len(paths) - 1, layouts.index(layout), 0)
        one = Index(paths, layouts, [(ts, *steps[ts]) for ts in sorted(steps)]).table(spark)
        one = one.select(F.lit(name).alias("variable"), *one.columns)
        out = one if out is None else out.unionByName(one)
    h = headers[0][1]
    place = [F.lit(h.origin[a]) + F.col("ijk"[a]) * F.lit(h.brick[a] / (h.size[a] - 1)) for a in range(3)]
    return out.select("variable", "ts", "i", "j", "k", place[0].alias("x"), place[1].alias("y"), place[2].alias("z"), "value")
