"""What the operators of this subpackage share: tables in the shared folder and vectorised words."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder

#: Bytes of text that a numpy pass works on at once; a longer single text makes a pass of its own.
CHUNK_BYTES = 1 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, deleted with all of the application's when that ends."""
    return folder(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: lineage ends here and any executor may be lost."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def discard(df: DataFrame) -> None:
    """Deletes what written() has stored, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(conf).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that df, a table or its filtered rows, reads, as the optimiser knows them; 0 for rows that stand in no file."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def release_memory() -> None:
    """Gives what a Python worker no longer needs back to the system: workers that wait for another task stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Rows and bytes of a batch that goes to a Python worker: what a task holds at once, whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker gets at once, where the session allows more."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem


def crc_mod(doc_id, n: int):
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def random_words(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


_BYTE_VALUES = random_words(1, 256)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes that end a run of letters: all of ASCII but its letters. Bytes above ASCII count as letters.
NO_LETTER = np.ones(256, dtype=bool)
NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers below n, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        if n > 16 * CHUNK_BYTES:
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the result depends on every bit of h."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column with nulls as empty texts, in one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes of text; together they are all rows."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to
        at = to


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows on end, and where each row starts (one more at the end)."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a block of texts, [^\\x20\\x09-\\x0D]+ or as `ends_word` says, A-Z lower-cased, as 64-bit hashes.

    hashes: of all words in order; rows: each word's row; first: where each row's words start
    (one more at the end); starts and ends: byte positions in `data`, the lower-cased bytes.
    """

    def __init__(self, texts: pa.Array, ends_word: np.ndarray = _SPACE):
        data, offsets = raw_bytes(texts)
        n = len(data)
        self.data = low = _LOWER[data]
        inside = ~ends_word[data]
        begins = inside.copy()
        stops = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            stops[:-1] &= ~inside[1:]
            cuts = offsets[:-1][offsets[:-1] < n]
            begins[cuts] = inside[cuts]
            before = offsets[1:][offsets[1:] > 0] - 1
            stops[before] = inside[before]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(len(counts)), counts)
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[low] * up[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles of `size` words (all its words, if fewer; none for no words), and where each row's start."""
    counts = np.diff(words.first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=first[1:])
    heads = np.repeat(words.first[:-1] - first[:-1], n) + np.arange(first[-1])
    ends = np.repeat(words.first[1:], n)
    h = np.zeros(len(heads), dtype=np.uint64)
    padded = np.concatenate([words.hashes, np.zeros(size, np.uint64)])
    for j in range(size):
        part = mix(padded[heads + j] + np.uint64(j + 1))
        part[heads + j >= ends] = np.uint64(0)
        h = h * np.uint64(0x9E3779B97F4A7C15) + part
    return mix(h), first


def sums_of_rows(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]], each made by itself: they don't depend on what else is in the block."""
    made = np.zeros((len(first) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        made[some] = np.add.reduceat(values, first[some], axis=0)
    return made


def map_texts(df: DataFrame, text: str, keep: dict[str, str], fn, out: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """fn(block of kept columns, texts) -> columns, over blocks of about `limit` bytes of whole texts.

    keep: columns of df to hand through and their new names; fn gets the texts as a string array
    without nulls and returns a dict of the further columns; out: their schema as DDL. The input's
    other columns, whatever their names, are not read.
    """
    small_batches(df.sparkSession)
    kept = [F.col(f"`{a}`").alias(f"k{i}") for i, a in enumerate(keep)]
    whole = F.col(f"`{text}`")
    once = text in keep and dict(df.dtypes)[text] == "string"  # then the text goes to the worker once
    source = df.select(*kept) if once else df.select(*kept, whole.cast("string").alias("t"))
    at = list(keep).index(text) if once else len(keep)
    fields = [(b, source.schema[f"k{i}"].dataType) for i, b in enumerate(keep.values())]
    ddl = ", ".join([*(f"`{b}` {kind.simpleString()}" for b, kind in fields), *([out] if out else [])])
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(ddl))
    names = list(keep.values())

    def run(batches):
        try:
            for batch in batches:
                texts = texts_of(batch.column(at))
                for a, b in chunks(texts, limit):
                    made = fn(texts.slice(a, b - a))
                    columns = {n: batch.column(i).slice(a, b - a) for i, n in enumerate(names)} | made
                    yield pa.RecordBatch.from_arrays([_column(columns[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            release_memory()

    return source.mapInArrow(run, ddl)


def _column(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)
