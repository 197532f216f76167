"""Embedding whitening by an incremental eigendecomposition.

Entries become whole numbers, so sums and deviations are exact. Every partition keeps the spectrum of
its rows' centred scatter up to date by rank-one changes (``spectrum``); spectra are joined, a few at a
time, by one rank-one change per eigenvector and one for the distance of their means. What comes out is
an orthonormal basis close to the components. A last pass over all rows sums the covariance in that
basis, where it is nearly diagonal, and its eigenvectors turn the basis into the components
(Rayleigh-Ritz), to the precision of a direct decomposition.

Blocks of rows are first turned into as many rows as there are columns, with the same scatter, so the
number of secular equations does not grow with the rows of a block. A task holds one block and a few
matrices of the size of the covariance; so does the driver.

Rows whose vector is null or holds a null, NaN or infinite entry are left out, as are vectors of
another length than the commonest (of two, the longer). Repeated rows and ids count as often as they
occur; a null id is kept. Components whose eigenvalue is not above the rounding error are not returned:
a single vector, or none, or equal vectors, have no component. Other columns are not read. Entries whose
64-fold exceeds 2^62 saturate there, sums have 64 bits, and a deviation that does not fit is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselink.llm.spectrum import EPS, Spectrum
from caselink.session import savepoint

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
BLOCK = 2048
FAN_IN = 16
STATE = "slot int, n bigint, sums array<bigint>, mean binary, vals binary, vecs binary"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: rows with whole vectors of the commonest length, as doubles."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull() & finite)
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0))


def _whole(column: pa.Array, size: int) -> np.ndarray:
    """A batch of vectors as whole numbers, less the shift that all of them carry."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.clip(np.floor(flat * SCALE), -(2.0**62), 2.0**62).astype(np.int64).reshape(-1, size)


def _state(slot: int, n: int, sums: np.ndarray, s: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([slot], pa.int32()),
            pa.array([n], pa.int64()),
            pa.array([sums.tolist()], pa.list_(pa.int64())),
            *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (s.mean, s.values, s.vectors)),
        ],
        names=["slot", "n", "sums", "mean", "vals", "vecs"],
    )


def _spectrum(row) -> Spectrum:
    mean, values, vectors = (np.frombuffer(bytes(x)) for x in row)
    out = Spectrum(len(mean))
    out.mean, out.values, out.vectors = mean, values, vectors.reshape(len(mean), -1)
    return out


def _gather(size: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spectrum, n, sums = Spectrum(size), 0, np.zeros(size, np.int64)
        for batch in batches:
            rows = _whole(batch.column(0), size)
            n, sums = n + len(rows), sums + rows.sum(axis=0)
            for at in range(0, len(rows), block):
                spectrum.add_rows(rows[at : at + block].astype(float))
        if n:
            yield _state(TaskContext.get().partitionId(), n, sums, spectrum)

    return run


def _join(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray, Spectrum]] = {}
        for batch in batches:
            for row in batch.to_pylist():  # a few states, each of the size of the covariance
                slot, sums, other = row["slot"] % slots, np.array(row["sums"], np.int64), _spectrum((row["mean"], row["vals"], row["vecs"]))
                other.n = row["n"]
                if slot not in held:
                    held[slot] = (row["n"], sums, other)
                else:
                    n, before, spectrum = held[slot]
                    spectrum.add(other)
                    held[slot] = (n + row["n"], before + sums, spectrum)
        for slot, (n, sums, spectrum) in held.items():
            yield _state(slot, n, sums, spectrum)

    return run


def spectrum_of(rows: DataFrame, size: int, block: int = BLOCK) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, their exact sums (less the shift) and an orthonormal basis near the components."""
    states = savepoint(rows.select("v").mapInArrow(_gather(size, block), STATE), "spectra")
    while (count := states.count()) > 1:
        slots = -(-count // FAN_IN)
        dealt = states.repartitionById(slots, F.col("slot") % slots).sortWithinPartitions("slot")
        states = savepoint(dealt.mapInArrow(_join(slots), STATE), "spectra")
    last = states.first()
    if last is None:
        return 0, np.zeros(size, np.int64), np.eye(size)
    # Many products have let the vectors drift from orthogonality by rounding only.
    basis, _ = np.linalg.qr(_spectrum((last.mean, last.vals, last.vecs)).vectors[:, ::-1])
    return last.n, np.array(last.sums, np.int64), basis


class Centre:
    """Exact means: whole part and rest of sums over n rows."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n = n
        self.whole, self.left = np.divmod(sums, n)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.left / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum of ``(n * x - S)^2``; the shift cancels out."""
        near = x - self.whole
        reach = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if reach * reach * max(x.shape[1], 1) < 1 << 63:
            apart = near * self.n - self.left
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((a * self.n - b) ** 2 for a, b in zip(row, self.left.tolist())) for row in near.tolist()]
        return [value if value < 1 << 63 else None for value in exact]


def _product(size: int, centre: Centre, turn: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = centre.rows(_whole(batch.column(0), size)) @ turn
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["product"])

    return run


def covariance(rows: DataFrame, size: int, centre: Centre, turn: np.ndarray) -> np.ndarray:
    """Covariance of the centred rows times ``turn``: summed by task, then entry by entry in Spark."""
    parts = rows.select("v").mapInArrow(_product(size, centre, turn), "product array<double>")
    entries = parts.select(F.posexplode("product").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(turn.shape[1] ** 2)
    for row in entries.collect():  # as many as the covariance has entries
        out[row.place] = row.value
    return out.reshape(turn.shape[1], -1) / centre.n


def _projected(size: int, centre: Centre, turn: np.ndarray, explained: np.ndarray, error: float):
    k = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _whole(batch.column(1), size)
            n = len(x)
            apart = pa.array(centre.deviations(x), pa.int64())
            row = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, centre.n)),
                    apart.take(row),
                    pa.array((centre.rows(x) @ turn).ravel()),
                    pa.array(np.tile(explained, n)),
                    pa.array(np.full(n * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(
    vectors: DataFrame,
    components: int = COMPONENTS,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every usable vector.

    ``identity_error`` is the largest entry of the whitened values' covariance less the identity, from
    a pass of its own over all rows.
    """
    rows = usable(vectors, id_col, vector_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = (
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    first = rows.select(F.size("v").alias("size")).first()
    size = first["size"] if first else 0
    n, sums, basis = spectrum_of(rows, size, block) if size else (0, np.zeros(0, np.int64), np.eye(0))
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    centre = Centre(n, sums)
    values, turn = np.linalg.eigh(covariance(rows, size, centre, basis))
    values, turn = values[::-1], basis @ turn[:, ::-1]
    total = float(values.sum())
    real = values > 16 * size * EPS * max(total, 0.0)
    turn, kept = turn[:, real][:, :components], values[real][:components]
    if not len(kept):
        return vectors.sparkSession.createDataFrame([], schema)
    # The largest entry of a component is positive, so runs agree on the sign.
    turn = turn * np.sign(turn[np.abs(turn).argmax(axis=0), np.arange(len(kept))]) / np.sqrt(kept)
    error = float(np.abs(covariance(rows, size, centre, turn) - np.eye(len(kept))).max())
    return rows.mapInArrow(_projected(size, centre, turn, kept / total, error), schema)
