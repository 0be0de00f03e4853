"""Walking over Arrow batches in pieces of bounded size."""

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T


_ROWS = 256


def column(batch: pa.RecordBatch, name: str, kind=None) -> list:
    col = batch.column(batch.schema.get_field_index(name))
    return (col if kind is None else col.cast(kind)).to_pylist()


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return column(batch, name, pa.binary())


def give_back() -> None:
    """Return freed memory to the system, since a worker outlives its task and an executor has many."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(batches, name: str = "text", limit: int = 1 << 20):
    """Slices of the batches with at most ``limit`` bytes of text each, or a single row.

    Once they are used up, the task's freed memory goes back to the system.
    """
    for batch in batches:
        start = size = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
        for i, n in enumerate(sizes.to_pylist()):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows > start:
            yield batch.slice(start)
    give_back()


def shards(batches, name: str = "text", limit: int = 1 << 25):
    """Lists of slices with about ``limit`` bytes of text together."""
    group, size = [], 0
    for part in slices(batches, name, min(limit, 1 << 20)):
        group.append(part)
        size += part.nbytes
        if size >= limit:
            yield group
            group, size = [], 0
    if group:
        yield group


def with_columns(df: DataFrame, extra: str, fn) -> DataFrame:
    """``df`` plus the columns of the schema ``extra``, made by ``fn(batch) -> list of arrays`` for a few rows at a time.

    ``fn`` reads columns by their place in ``df``. Columns of ``df`` with a name of ``extra`` are
    replaced; others pass unchanged, whatever their names.
    """
    added = T.StructType.fromDDL(extra)
    names = {f.name.lower() for f in added}
    width = len(df.columns)
    plain = df.toDF(*[f"c{i}" for i in range(width)])

    def run(batches):
        for b in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            arrays = [pa.array(x) if not isinstance(x, pa.Array) else x for x in fn(b)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *arrays], names=[*b.schema.names, *[f"x{i}" for i in range(len(arrays))]]
            )

    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(df.schema)]
    fields += [T.StructField(f"x{i}", f.dataType) for i, f in enumerate(added)]
    done = plain.mapInArrow(run, T.StructType(fields))
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in names]
    return done.select(*[f"c{i}" for i in kept], *[f"x{i}" for i in range(len(added))]).toDF(
        *[df.columns[i] for i in kept], *added.names
    )
