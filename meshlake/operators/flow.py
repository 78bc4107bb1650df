"""Particles in velocity fields: seeds, time integration, properties, export rows.

A field is three (two) component grids of equal shape at one or more times.  A small one is closed
over by the tasks, and a batch of particles is advected together with NumPy until all have ended.

A larger one stays in a table, cut in blocks that share their border samples.  Particles are sent to the block
(and stretch of time) whose samples they need next, advance there until they need another's, also in the
middle of a step, and are handed on in rounds through written tables.  A block with many particles is
sent to several tasks, each with a bounded number of them.  Both forms do the same arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import scratch
from .grid import AXES, RegularGrid

#: Values of a field that is sent to tasks; larger ones stay in tables.
IN_MEMORY = 2_000_000
#: Fixed value: steps after which a run until a time is given up.
RUNAWAY = 10_000
#: Rows of traces that are held before they are passed on; particles of a block in one task.
ROWS, TOGETHER = 500_000, 20_000
#: Cells of a block of a field.
BLOCK = 64**3
#: Samples that are dealt to blocks together.
PIECE = 500_000


class Field:
    """Velocity arrays (time, k, j, i) per component over a regular grid; NaN is missing.

    ``origin`` is the first sample along each axis, and ``step`` the first time, that the arrays have.
    """

    def __init__(
        self, grid: RegularGrid, times: Sequence[float], parts: Sequence[np.ndarray], multiplier: float = 1.0,
        origin: Sequence[int] | None = None, step: int = 0,
    ):
        self.grid, self.times, self.multiplier = grid, np.asarray(times, float), multiplier
        self.parts = [np.asarray(p, float) for p in parts]
        self.origin, self.step = tuple(origin or [0] * len(grid.n)), step

    @property
    def steady(self) -> bool:
        return len(self.times) < 2

    def inside(self, place: np.ndarray, time: np.ndarray) -> np.ndarray:
        ok = np.all((place >= self.grid.low) & (place <= self.grid.high), axis=1)
        return ok if self.steady else ok & (time >= self.times[0]) & (time <= self.times[-1])

    def cells(self, place: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The cell of each place along each axis, and the share of the way through it."""
        g = self.grid
        cell, share = [], []
        for a in range(len(g.n)):
            at = np.nan_to_num((place[:, a] - g.low[a]) / (g.delta(a) or 1.0))  # lost places are blanked by the caller
            c = np.clip(np.floor(at), 0, max(g.n[a] - 2, 0)).astype(int)
            cell.append(c)
            share.append(np.clip(at - c, 0.0, 1.0))
        return cell, share

    def stretch(self, time: np.ndarray) -> np.ndarray:
        """The step before each time."""
        if self.steady:
            return np.zeros(len(time), int)
        return np.clip(np.searchsorted(self.times, np.nan_to_num(time), side="right") - 1, 0, len(self.times) - 2)

    def _space(self, part: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Multilinear samples of one time; NaN if a corner of non-zero weight is missing."""
        g, d = self.grid, len(self.grid.n)
        cell, share = self.cells(place)
        out = np.zeros(len(place))
        for corner in range(1 << d):
            weight, index = np.ones(len(place)), []
            for a in range(d):
                up = corner >> a & 1
                weight = weight * (share[a] if up else 1 - share[a])
                index.append(np.minimum(cell[a] + up, g.n[a] - 1) - self.origin[a])
            value = part[tuple(reversed(index))]
            out += np.where(weight == 0, 0.0, weight * value)
        return out

    def velocity(self, time: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Vectors, NaN where missing or outside; linear between the two steps around a time."""
        out = np.full((len(place), len(self.parts)), np.nan)
        here = np.flatnonzero(self.inside(place, time))
        own = place[here]
        if self.steady:
            for a, p in enumerate(self.parts):
                out[here, a] = self._space(p[0], own)
        else:
            first = self.stretch(time[here])
            share = (time[here] - self.times[first]) / (self.times[first + 1] - self.times[first])
            for step in np.unique(first):
                rows = first == step
                w = share[rows]
                for a, p in enumerate(self.parts):
                    lo, hi = self._space(p[step - self.step], own[rows]), self._space(p[step + 1 - self.step], own[rows])
                    out[here[rows], a] = np.where(w == 0, lo, np.where(w == 1, hi, lo * (1 - w) + hi * w))
        return out * self.multiplier

    def first_step(self, samples: int = 10) -> float:
        """A time step that crosses about one cell at the largest speed met on a lattice of
        interior points: the domain's diagonal by that speed and the cells along it."""
        axes = [np.linspace(lo, hi, samples + 2)[1:-1] for lo, hi in zip(self.grid.low, self.grid.high)]
        place = np.stack([m.ravel() for m in np.meshgrid(*axes)], axis=1)
        speed = np.nanmax(np.linalg.norm(self.velocity(np.full(len(place), self.times[0]), place), axis=1), initial=0.0)
        diagonal = math.dist(self.grid.low, self.grid.high)
        return diagonal / (speed * math.sqrt(sum(n * n for n in self.grid.n))) if speed > 0 else 1.0


def even_block(grid: RegularGrid, cells: int | None = None) -> tuple[int, ...]:
    """Cells of a block along each axis: about ``BLOCK`` in all and equally long sides, as far as the grid is as long.

    A particle leaves a block of equal sides after as many steps in any direction, so the rounds are few, also where
    the samples are much closer along one axis than along another.
    """
    size, left = {}, float(cells or BLOCK)
    free = [a for a in range(len(grid.n)) if grid.n[a] > 1]
    while free:
        delta = {a: grid.delta(a) or 1.0 for a in free}
        side = (left * math.prod(delta.values())) ** (1 / len(free))
        short = [a for a in free if side / delta[a] >= grid.n[a] - 1 or side < delta[a]]
        if not short:
            size |= {a: int(side / delta[a]) for a in free}
            break
        a = max(short, key=lambda a: max(side / delta[a] / (grid.n[a] - 1), delta[a] / side))
        size[a] = grid.n[a] - 1 if side / delta[a] >= grid.n[a] - 1 else 1
        left = max(1.0, left / size[a])
        free.remove(a)
    return tuple(size.get(a, 1) for a in range(len(grid.n)))


def _together(batches, rows: int):
    """Record batches as tables of about so many rows."""
    import pyarrow as pa

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held)
            held, count = [], 0
    if count:
        yield pa.Table.from_batches(held)


class StoredField:
    """A velocity field in tables (ts, i, j, k, value), a table for each component, of any size."""

    def __init__(self, grid: RegularGrid, parts: Sequence[DataFrame], times: Sequence[float] = (0.0,), multiplier: float = 1.0, block: int | Sequence[int] | None = None):
        self.grid, self.tables, self.times, self.multiplier = grid, list(parts), list(times), multiplier
        self.block = (block,) * len(grid.n) if isinstance(block, int) else tuple(block or even_block(grid))
        self._blocks: DataFrame | None = None

    @property
    def steady(self) -> bool:
        return len(self.times) < 2

    def counts(self) -> list[int]:
        """Blocks along each axis."""
        return [max(1, -(-(n - 1) // b)) for n, b in zip(self.grid.n, self.block)]

    def empty(self) -> Field:
        """The geometry without samples."""
        return Field(self.grid, self.times, [], self.multiplier)

    def place_of(self, key: int) -> tuple[int, list[int]]:
        """The step and the first sample of a block by its number."""
        origin = []
        for n, size in zip(self.counts(), self.block):
            key, b = divmod(key, n)
            origin.append(b * size)
        return key, origin

    def blocks(self) -> DataFrame:
        """(key, samples): the blocks with the samples of all components, at the two steps of their stretch of time; written once."""
        if self._blocks is None:
            axes = self.grid.axes
            long = None
            for a, part in enumerate(self.tables):
                step = F.col("ts") if "ts" in part.columns else F.lit(0)
                one = part.select(F.lit(a).alias("_a"), step.cast("int").alias("_t"), *[F.col(x).cast("int").alias(x) for x in axes], F.col("value").cast("double").alias("value"))
                long = one if long is None else long.unionByName(one)
            plain, parts = StoredField(self.grid, [], self.times, self.multiplier, self.block), len(self.tables)

            def pieces(batches):
                for some in _together(batches, PIECE):
                    yield plain.pieces(some, parts)

            def run(key, group):
                import pyarrow as pa

                number = key[0].as_py()
                out = np.full(plain.samples_of(number, parts), np.nan)
                for places, values in zip(group.column("places"), group.column("values")):
                    out[np.frombuffer(places.as_py(), np.int64)] = np.frombuffer(values.as_py())
                return pa.table({"key": pa.array([number], pa.int64()), "samples": pa.array([out.tobytes()], pa.binary())})

            made = long.mapInArrow(pieces, "key long, places binary, values binary").groupBy("key").applyInArrow(run, "key long, samples binary")
            self._blocks = scratch.written(made, "field")
        return self._blocks

    def samples_of(self, key: int, parts: int) -> int:
        """Samples of a block, of all components and steps."""
        return (1 if self.steady else 2) * parts * math.prod(self.shape_of(key))

    def pieces(self, rows, parts: int):
        """Rows (_a, _t, i, j, k, value) as record batch (key, places, values): what they have of each block, and where."""
        import pyarrow as pa

        n, d = self.grid.n, len(self.grid.n)
        time, part = (rows.column(c).to_numpy().astype(np.int64) for c in ("_t", "_a"))
        at = [rows.column(x).to_numpy().astype(np.int64) for x in self.grid.axes]
        value = rows.column("value").to_numpy()
        # A sample is in one block, or on the border of two, along each axis; and in one or two stretches of time.
        listed = []
        for back in (0, 1):
            last = max(len(self.times) - 2, 0)
            start = np.clip(time - back, 0, last)
            new = np.flatnonzero(start != np.clip(time, 0, last)) if back else np.arange(len(time))
            listed.append((new, start[new]))
        row, key = (np.concatenate(x) for x in zip(*listed))
        place = (time[row] - key) * parts + part[row]
        for a in reversed(range(d)):
            last, size = max(n[a] - 2, 0), self.block[a]
            own = np.clip(at[a][row], 0, last) // size
            before = np.clip(at[a][row] - 1, 0, last) // size
            shared = np.flatnonzero(before != own)
            block = np.concatenate([own, before[shared]])
            row, key, place = (np.concatenate([x, x[shared]]) for x in (row, key, place))
            key = key * self.counts()[a] + block
            place = place * np.minimum(size + 1, n[a] - block * size) + at[a][row] - block * size
        order = np.argsort(key, kind="stable")
        key, place, value = key[order], place[order], value[row[order]]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(first, len(key))
        cut = [pa.array([x[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()) for x in (place, value)]
        return pa.RecordBatch.from_arrays([pa.array(key[first]), *cut], ["key", "places", "values"])

    def shape_of(self, key: int) -> list[int]:
        """Samples of a block along each axis."""
        return [min(b + 1, n - o) for b, n, o in zip(self.block, self.grid.n, self.place_of(key)[1])]

    def opened(self, key: int, samples: bytes, parts: int) -> Field:
        """The field of a block."""
        step, origin = self.place_of(key)
        shape = self.shape_of(key)
        data = np.frombuffer(samples).reshape(1 if self.steady else 2, parts, *reversed(shape))
        return Field(self.grid, self.times, [data[:, a] for a in range(parts)], self.multiplier, origin, step)

    def keys(self, time: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The block that has the samples around each place and time."""
        geometry, counts = self.empty(), self.counts()
        cell, _ = geometry.cells(place)
        key = geometry.stretch(time).astype(np.int64)
        for a in reversed(range(len(counts))):
            key = key * counts[a] + cell[a] // self.block[a]
        return key

    def first_step(self, samples: int = 10) -> float:
        """As of a field in memory, from a lattice of points that are sampled as a table."""
        from .sample import sample_linear

        g = self.grid
        spark = self.tables[0].sparkSession
        lattice = spark.range(samples ** len(g.n)).select(F.col("id").alias("_p"))
        for a, (c, lo, hi) in enumerate(zip(g.coords, g.low, g.high)):
            number = F.floor(F.col("_p") / samples**a) % samples + 1
            lattice = lattice.withColumn(c, F.lit(lo) + number * F.lit((hi - lo) / (samples + 1)))
        speed = None
        for n, part in enumerate(self.tables):
            values = part.where("ts = 0").drop("ts") if "ts" in part.columns else part
            one = sample_linear(lattice, values, g, ["_p"], f"_v{n}").select("_p", f"_v{n}")
            speed = one if speed is None else speed.join(one, "_p")
        squares = [F.col(f"_v{n}") * F.col(f"_v{n}") for n in range(len(self.tables))]
        total = squares[0]
        for sq in squares[1:]:
            total = total + sq
        fastest = (speed.agg(F.max(F.sqrt(total))).first()[0] or 0.0) * abs(self.multiplier)
        return math.dist(g.low, g.high) / (fastest * math.sqrt(sum(n * n for n in g.n))) if fastest > 0 else 1.0


def field_from_tables(grid: RegularGrid, parts: Sequence[DataFrame], times: Sequence[float] = (0.0,), multiplier: float = 1.0, block: int | Sequence[int] | None = None) -> Field | StoredField:
    """A field of component tables (ts, i, j, k, value): in memory if it is small, else in its tables."""
    shape = (len(times), *reversed(grid.n))
    if math.prod(shape) * len(parts) > IN_MEMORY:
        return StoredField(grid, parts, times, multiplier, block)
    arrays = []
    for table in parts:
        out = np.full(shape, np.nan)
        has_time = "ts" in table.columns
        found = table.select(*(["ts"] if has_time else []), *grid.axes, F.col("value").cast("double").alias("value")).toArrow()
        index = [found.column(a).to_numpy() for a in (*(["ts"] if has_time else []), *reversed(grid.axes))]
        out[tuple(index) if has_time else (0, *index)] = found.column("value").to_numpy()
        arrays.append(out)
    return Field(grid, times, arrays, multiplier)


#: Fixed values of the step rule: angles in degrees and factors of straight and of sharp turns, limits of the step.
STRAIGHT, SHARP, LONGER, SHORTER, LIMIT = 3.0, 15.0, 1.25, 0.5, 20.0


def _bend_factor(older, old, new):
    a, b = old - older, new - old
    size = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cosine = np.sum(a * b, axis=1) / size
    factor = np.where(cosine > math.cos(math.radians(STRAIGHT)), LONGER, np.where(cosine < math.cos(math.radians(SHARP)), SHORTER, 1.0))
    return np.where(size < 1e-7, 1.0, factor)


#: How far into a step each stage of an integration evaluates the field: Euler's, and the fourth order's.
STAGES = {True: (0.0,), False: (0.0, 0.5, 0.5, 1.0)}


class Particles:
    """The state of some traces: places, times, the two places before, and how far into its step each one is."""

    VECTORS = ("place", "older", "old", "k0", "k1", "k2", "k3")
    NUMBERS = ("time", "used", "h", "seen", "number", "count", "taken", "stage")

    def __init__(self, n: int, d: int):
        self.d = d
        self.vectors = {k: np.zeros((n, d)) for k in self.VECTORS}
        self.numbers = {k: np.zeros(n) for k in self.NUMBERS}

    @classmethod
    def at(cls, seeds: np.ndarray, start: float, dt: float) -> Particles:
        out = cls(len(seeds), seeds.shape[1])
        for k in ("place", "older", "old"):
            out.vectors[k][:] = seeds
        out.numbers["time"][:], out.numbers["used"][:] = start, dt
        return out

    @classmethod
    def unpacked(cls, flat: np.ndarray, d: int) -> Particles:
        out, at = cls(len(flat), d), 0
        for k in cls.VECTORS:
            out.vectors[k][:] = flat[:, at : at + d]
            at += d
        for k in cls.NUMBERS:
            out.numbers[k][:] = flat[:, at]
            at += 1
        return out

    def packed(self, which: np.ndarray) -> np.ndarray:
        return np.concatenate([*[self.vectors[k][which] for k in self.VECTORS], *[self.numbers[k][which, None] for k in self.NUMBERS]], axis=1)

    def asked(self, which: np.ndarray, euler: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where and when each particle needs the field next."""
        stage = self.numbers["stage"][which].astype(int)
        time, place = self.numbers["time"][which].copy(), self.vectors["place"][which].copy()
        h = self.numbers["h"][which]
        for s, part in enumerate(STAGES[euler]):
            own = stage == s
            if s and own.any():
                time[own] += part * h[own]
                place[own] += (part * h[own])[:, None] * self.vectors[f"k{s - 1}"][which][own]
        return time, place


def trace(
    field: Field, particles: Particles, dt: float, steps: int | None, until: float | None, fixed: bool, euler: bool, periodic: Sequence[bool],
    known: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, rows: int | None = None,
) -> Iterator[tuple[list[np.ndarray], np.ndarray | None]]:
    """Rows (particle, step, place, time, special, capped) of traces that go on, in parts, and with the last part
    the particles that haven't ended: those that need the field where ``known`` says it isn't here, or all
    once there are so many ``rows``.

    A trace ends where it is missing, leaves a box that isn't periodic, or stands still;
    its last row is then special.  A row that jumps a periodic side is preceded by a
    special one, which separates the parts.  A run until a time that takes too many steps ends with a special
    row that is marked as capped.
    """
    v, s = particles.vectors, particles.numbers
    n = len(s["time"])
    alive, waiting = np.ones(n, bool), np.zeros(n, bool)
    low, high = np.array(field.grid.low), np.array(field.grid.high)
    stages = STAGES[euler]
    parts: list[tuple] = []
    held = written = 0

    def tell(which: np.ndarray, special: bool, capped: bool = False) -> None:
        nonlocal held
        if len(which):
            flags = [np.full(len(which), x) for x in (special, capped)]
            parts.append((which, s["number"][which].astype(int), v["place"][which], s["time"][which], *flags))
            held += len(which)

    def told() -> list[np.ndarray]:
        nonlocal held, written
        out = [np.concatenate([p[c] for p in parts]) for c in range(6)]
        written += held
        parts.clear()
        held = 0
        return out

    new = np.flatnonzero(s["seen"] == 0)  # places since the last separator
    tell(new, False)
    s["seen"][new] = 1
    while True:
        # Particles between steps: those that have done enough end, the others choose their next step.
        at = np.flatnonzero(alive & ~waiting & (s["stage"] == 0))
        if steps is not None:
            alive[at[s["count"][at] >= steps]] = False
        if until is not None:
            alive[at[(s["time"][at] >= until) if dt > 0 else (s["time"][at] <= until)]] = False
        at = at[alive[at]]
        if steps is None:  # a run until a time may never get there
            late = at[s["taken"][at] >= RUNAWAY]
            s["number"][late] += 1
            tell(late, True, True)
            alive[late] = False
            at = at[alive[at]]
        h = np.full(len(at), float(dt))
        if not fixed:
            bent = s["seen"][at] > 2
            factor = _bend_factor(v["older"][at], v["old"][at], v["place"][at])
            lo, hi = sorted((dt / LIMIT, dt * LIMIT))
            h = np.where(bent, np.clip(s["used"][at] * factor, lo, hi), h)
        if until is not None:
            left = until - s["time"][at]
            h = np.where(np.abs(h) > np.abs(left), left, h)
        s["h"][at] = h
        # Evaluations, as far as the samples are here.
        active = np.flatnonzero(alive & ~waiting)
        if not len(active) or (rows is not None and written + held >= rows):
            break
        time, place = particles.asked(active, euler)
        here = np.ones(len(active), bool)
        if known is not None:
            here = known(time, place)
            waiting[active[~here]] = True
        active = active[here]
        got = field.velocity(time[here], place[here])
        stage = s["stage"][active].astype(int)
        for k in range(len(stages)):
            v[f"k{k}"][active[stage == k]] = got[stage == k]
        s["stage"][active] = stage + 1
        done = active[stage + 1 == len(stages)]
        if not len(done):
            continue
        # Whole steps.
        s["stage"][done] = 0
        s["taken"][done] += 1
        old, time, h = v["place"][done], s["time"][done], s["h"][done][:, None]
        k = [v[f"k{x}"][done] for x in range(4)]
        to = old + h * k[0] if euler else old + h / 6 * (k[0] + 2 * (k[1] + k[2]) + k[3])
        bad = np.isnan(to).any(axis=1)
        missing = np.isnan(k[0]).any(axis=1)
        inside = field.inside(old, time)
        retry = bad & inside & ~missing  # close to a side: a plain step
        to[retry] = old[retry] + h[retry] * k[0][retry]
        bad &= ~retry
        still = ~bad & (to == old).all(axis=1)
        wrapped = old.copy()
        for a, yes in enumerate(periodic[: len(low)]):
            if yes and high[a] > low[a]:
                span = high[a] - low[a]
                c = wrapped[:, a]
                c = np.where(c < low[a], c + np.ceil((low[a] - c) / span) * span, c)
                wrapped[:, a] = np.where(c > high[a], c - np.ceil((c - high[a]) / span) * span, c)
        moved = bad & ~inside & any(periodic) & field.inside(wrapped, time)
        ended = (bad & ~moved) | still
        go = ~bad & ~still
        ids = done[go]
        v["older"][ids], v["old"][ids] = v["old"][ids], v["place"][ids]
        v["place"][ids], s["used"][ids] = to[go], s["h"][ids]
        s["time"][ids] += s["h"][ids]
        for name in ("count", "seen", "number"):
            s[name][ids] += 1
        tell(ids, False)
        s["number"][done[moved | ended]] += 1
        tell(done[moved | ended], True)
        jumped = done[moved]
        v["place"][jumped], s["seen"][jumped] = wrapped[moved], 1
        s["number"][jumped] += 1
        tell(jumped, False)
        alive[done[ended]] = False
        if held >= ROWS:
            yield told(), None
    left = np.flatnonzero(alive)
    if parts or len(left):
        parts = parts or [tuple(x[:0] for x in (left, s["number"].astype(int), v["place"], s["time"], alive, alive))]
        yield told(), left


def advect(
    seeds: DataFrame,
    field: Field | StoredField,
    dt: float,
    steps: int | None = None,
    until: float | None = None,
    start: float = 0.0,
    method: str = "rk4",
    fixed: bool = False,
    periodic: Sequence[bool] = (False, False, False),
) -> DataFrame:
    """Traces (stream, step, x, y, z, time, special, capped) of seeds (seed, x, y, z).

    Give ``steps`` (steady) or ``until`` (a time); a negative ``dt`` goes backwards.  ``capped`` marks the last row of a
    run until a time that was given up after ``RUNAWAY`` steps.
    """
    axes, euler = field.grid.coords, method == "euler"
    rows = seeds.select(F.col("seed").cast("long").alias("seed"), *[F.col(c).cast("double").alias(c) for c in axes])
    if isinstance(field, StoredField):
        return _routed(rows, field, dt, steps, until, start, fixed, euler, periodic)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in axes], axis=1)
            for part, _ in trace(field, Particles.at(places, start, dt), dt, steps, until, fixed, euler, periodic):
                yield pa.RecordBatch.from_arrays(_columns(batch.column("seed"), part, len(axes)), _names(axes))

    return rows.mapInArrow(run, _schema(axes))


def _names(axes: Sequence[str]) -> list[str]:
    return ["stream", "step", *axes, "time", "special", "capped"]


def _schema(axes: Sequence[str]) -> str:
    return f"stream long, step int, {', '.join(f'{c} double' for c in axes)}, time double, special boolean, capped boolean"


def _columns(ids, part: list[np.ndarray], d: int) -> list:
    import pyarrow as pa

    who, step, place, time, special, capped = part
    return [ids.take(pa.array(who)), pa.array(step, pa.int32()), *[pa.array(place[:, a]) for a in range(d)], pa.array(time), pa.array(special), pa.array(capped)]


def _routed(seeds: DataFrame, field: StoredField, dt, steps, until, start, fixed, euler, periodic) -> DataFrame:
    """The traces of seeds in a stored field: rounds of particles that meet the blocks they need."""
    import pyarrow as pa

    axes, d, n_parts, spark = field.grid.coords, len(field.grid.n), len(field.tables), seeds.sparkSession
    blocks, plain = field.blocks(), StoredField(field.grid, [], field.times, field.multiplier, field.block)
    base = scratch.fresh_path(spark, "traces")
    state_schema = "stream long, key long, state array<double>"
    schema = f"kind int, {_schema(axes)}, key long, state array<double>"

    def begin(batches):
        for batch in batches:
            places = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in axes], axis=1)
            time = np.full(len(places), float(start))
            flat = Particles.at(places, start, dt).packed(np.arange(len(places)))
            yield pa.RecordBatch.from_arrays([batch.column("seed"), pa.array(plain.keys(time, places)), pa.array(list(flat), pa.list_(pa.float64()))], ["stream", "key", "state"])

    def advance(key, particles, block):
        number = key[0].as_py()
        if not particles.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        if block.num_rows:
            own = plain.opened(number, block.column("samples")[0].as_py(), n_parts)
        else:  # the tables have nothing there
            own = plain.opened(number, np.full(plain.samples_of(number, n_parts), np.nan).tobytes(), n_parts)
        state = np.stack(particles.column("state").to_numpy())
        moving = Particles.unpacked(state, d)
        known = lambda time, place: (plain.keys(time, place) == number) | ~own.inside(place, time)
        ids = particles.column("stream").combine_chunks()
        made = []
        for part, left in trace(own, moving, dt, steps, until, fixed, euler, periodic, known, ROWS):
            count = len(part[0])
            told = [pa.array(np.zeros(count, np.int32)), *_columns(ids, part, d), pa.nulls(count, pa.int64()), pa.nulls(count, pa.list_(pa.float64()))]
            made.append(pa.table(told, names=names))
            if left is not None and len(left):
                time, place = moving.asked(left, euler)
                rest = [pa.array(np.ones(len(left), np.int32)), ids.take(pa.array(left)), *[pa.nulls(len(left), t) for t in kinds[2:-2]]]
                rest += [pa.array(plain.keys(time, place)), pa.array(list(moving.packed(left)), pa.list_(pa.float64()))]
                made.append(pa.table(rest, names=names))
        return pa.concat_tables(made) if made else pa.table([pa.array([], t) for t in kinds], names=names)

    names = ["kind", *_names(axes), "key", "state"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.float64()] * (d + 1), pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.float64())]
    state = scratch.written(seeds.mapInArrow(begin, state_schema), "particles")
    rounds, done = [], 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    while not state.isEmpty():
        # Blocks go to as many tasks as their particles need.
        many = state.groupBy("key").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_n"))
        sent = state.join(many, "key").withColumn("_part", F.pmod(F.xxhash64("stream"), F.col("_n")).cast("int")).drop("_n")
        met = _slices(many, blocks)
        path = f"{base}/{done:06d}"
        # As few bytes as they are, rows of one partition would be one task's work.
        deal = sent.repartition(tasks, "key", "_part").groupBy("key", "_part").cogroup(met.repartition(tasks, "_key", "_slice").groupBy("_key", "_slice"))
        deal.applyInArrow(advance, schema).write.partitionBy("kind").parquet(path)
        rounds.append(path)
        done += 1
        state = spark.read.schema(schema).option("basePath", path).parquet(path).where("kind = 1").select("stream", "key", "state")
    if not rounds:
        return spark.createDataFrame([], _schema(axes))
    return spark.read.schema(schema.removeprefix("kind int, ")).parquet(f"{base}/*/kind=0").select(_names(axes))


def _slices(many: DataFrame, blocks: DataFrame) -> DataFrame:
    """(_key, samples, _slice): the blocks of particles (key, _n), once for each of their _n tasks.

    The numbers are broadcast, a row for each block; the samples never are, however small their files: constant samples
    of any size take few bytes there, and would go whole through the driver.
    """
    met = blocks.join(F.broadcast(many), "key")
    return met.select(F.col("key").alias("_key"), "samples", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_slice"))


def bidirectional(seeds: DataFrame, field: Field, dt: float, **options) -> DataFrame:
    """Forward traces and backward ones, the latter with negative steps."""
    forward = advect(seeds, field, abs(dt), **options)
    backward = advect(seeds, field, -abs(dt), **options).where("step > 0").withColumn("step", -F.col("step"))
    return forward.unionByName(backward)


def random_rake(spark, low: Sequence[float], high: Sequence[float], n: int, seed: int = 32) -> DataFrame:
    """n seeds evenly distributed in a box, the same for the same ``seed`` and number."""
    out = spark.range(n).withColumnRenamed("id", "seed")
    for a, (lo, hi) in enumerate(zip(low, high)):
        draw = F.pmod(F.xxhash64(F.col("seed"), F.lit(seed), F.lit(a)), F.lit(1 << 53)) / F.lit(float(1 << 53))
        out = out.withColumn("xyz"[a], F.lit(float(lo)) + draw * F.lit(float(hi - lo)))
    return out


def biased_seeds(candidates: DataFrame, value: str, n: int, lowest: bool = False, tie: str = "seed") -> DataFrame:
    """The n candidates with the largest (smallest) value; those without one don't count."""
    order = F.col(value).asc() if lowest else F.col(value).desc()
    return candidates.where(F.col(value).isNotNull()).orderBy(order, tie).limit(n)


def biased_rake(values: DataFrame, grid: RegularGrid, low: Sequence[float], high: Sequence[float], n: int, bias: float, seed: int = 32) -> DataFrame:
    """n random seeds of a box that prefer large (``bias`` above 0) or small values of a variable: the best of
    (abs(bias) + 1) n that are drawn.  Those where the variable is missing don't count."""
    from .sample import sample_linear

    spark = values.sparkSession
    drawn = random_rake(spark, low, high, math.ceil((abs(bias) + 1) * n), seed)
    if not bias:
        return drawn
    met = drawn.join(sample_linear(drawn, values, grid, ["seed"], "_value"), "seed")
    return biased_seeds(met, "_value", n, bias < 0).drop("_value")


def reinjected(seeds: DataFrame, steps: DataFrame, every: int) -> DataFrame:
    """Seeds once more at every n-th time step."""
    return seeds.join(F.broadcast(steps.where(F.col("ts") % every == 0)))


def attach_property(streams: DataFrame, values: DataFrame, grid: RegularGrid, name: str, times: Sequence[float] = ()) -> DataFrame:
    """Streams with a scalar sampled at their places; null outside and at separators.

    With ``times`` the values have a step ``ts`` each, and are linear between the two steps around a
    place's time; null before the first and after the last.
    """
    from .sample import locate, sample_linear

    key = ["stream", "step"]
    if len(times) < 2:
        if times:
            values = values.where("ts = 0")
        sampled = sample_linear(streams.where("not special"), values, grid, key, name)
        return streams.join(sampled, key, "left")
    axis = streams.sparkSession.createDataFrame(list(enumerate(map(float, times))), "_n int, _time double")
    placed = locate(streams.where("not special"), axis, "_n", "_time", "time", max(64, len(times)))
    two = F.array(F.struct(F.col("cell").alias("ts"), (1.0 - F.col("weight")).alias("_share")), F.struct((F.col("cell") + 1).alias("ts"), F.col("weight").alias("_share")))
    each = placed.where("cell is not null").withColumn("_e", F.explode(F.filter(two, lambda e: e["_share"] != 0))).withColumns({"ts": F.col("_e.ts"), "_share": F.col("_e._share")})
    at = sample_linear(each, values, grid, [*key, "ts", "_share"], "_v", ["ts"])
    found = at.groupBy(*key).agg(F.when(F.bool_and(F.col("_v").isNotNull()), F.sum(F.col("_v") * F.col("_share"))).alias(name))
    return streams.join(found, key, "left")


def export_rows(streams: DataFrame, properties: Sequence[str] = (), steps: int | None = None, until: float | None = None) -> DataFrame:
    """Rows of an export: the first ``steps`` + 1 places of each stream, or those up to a time
    (with the time formatted in UTC); separators are left out."""
    from pyspark.sql import Window

    coords = [c for c in ("x", "y", "z") if c in streams.columns]
    rows = streams.where("not special")
    if steps is not None:
        order = Window.partitionBy("stream").orderBy("step")
        rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= steps + 1)
    if until is not None:
        rows = rows.where(F.col("time") <= until)
    stamp = [F.date_format(F.timestamp_micros((F.col("time") * 1e6).cast("long")), "yyyy-MM-dd HH:mm:ss").alias("date")] if until is not None else []
    return rows.select(F.col("stream").alias("ID"), "step", *coords, *stamp, *properties)
