"""What the operators share: reading, kept tables, word splitting, word and shingle hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than these six (ASCII white space).
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Let Spark send this package to the Python workers, once a context."""
    context = spark.sparkContext
    if getattr(context, "_narralake_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="narralake-"), "narralake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._narralake_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a folder of its own is set where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that are done.

    It does so once the driver's JVM has collected their plans, and a driver
    with little to do may not collect anything for as long as a query runs.
    """
    spark.sparkContext._jvm.System.gc()


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them back, which cuts the lineage.

    A lost executor then costs a read of these files, not the work before them.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    free_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a batch of texts, where the session sets no number itself.
BATCH = 1000


def text_batches(docs: DataFrame) -> None:
    """Hand texts to Python in smaller batches than Spark's ten thousand rows.

    A batch is held several times over, in the JVM and in each worker.
    """
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, BATCH)


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def rows_of(batches: Iterable[pa.RecordBatch], size: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def give_back() -> None:
    """Return freed memory to the system: workers stay for the next tasks, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """rows, after which its worker keeps no memory that is free."""

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        give_back()

    return run


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() knows the same six white-space characters."""
    return text.encode().split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    return hashed(pa.array([text], pa.string()))[0]


_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_MUL = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(2**32 - 1)
#: The first 64 bytes of the secret of XXH3, in words of eight.
_SECRET = [
    int.from_bytes(bytes.fromhex(x), "little")
    for x in "b8fe6c3923a44bbe 7c01812cf721ad1c ded46de9839097db 7240a4a4b7b3671f"
    " cb79e64eccc0e578 825ad07dccff7221 b8084674f743248e e03590e6813a264c".split()
]


def _fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The two halves of the 128-bit product, one xor the other."""
    half = np.uint64(32)
    al, ah, bl, bh = a & _LOW, a >> half, b & _LOW, b >> half
    low, left, right = al * bl, ah * bl, al * bh
    middle = (low >> half) + (left & _LOW) + right
    return ((left >> half) + (middle >> half) + ah * bh) ^ ((middle << half) | (low & _LOW))


def _avalanche(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(37))) * np.uint64(0x165667919E3779F9)
    return h ^ (h >> np.uint64(32))


def xxh3(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH3 of 64 bits, seed 0, of each word data[start : start + size]; those of up to 32 bytes all at once."""
    padded = np.zeros((len(data) + 31) // 8 * 8, np.uint8)
    padded[: len(data)] = data
    eights = padded.view("<u8")

    def at(place: np.ndarray) -> np.ndarray:
        """The eight bytes from there on."""
        word, bits = place >> 3, ((place & 7) << 3).astype(np.uint64)
        return (eights[word] >> bits) | (eights[word + 1] << np.uint64(1) << (np.uint64(63) - bits))

    out = np.empty(len(start), np.uint64)
    s = _SECRET
    with np.errstate(over="ignore"):
        for least, most in ((1, 3), (4, 8), (9, 16), (17, 32)):
            some = np.flatnonzero((size >= least) & (size <= most))
            if len(some) == 0:
                continue
            p, signed = start[some], size[some]
            n = signed.astype(np.uint64)
            first = at(p)
            if most == 3:
                byte = lambda i, first=first: (first >> (i.astype(np.uint64) << np.uint64(3))) & np.uint64(255)
                h = byte(signed * 0) << np.uint64(16) | byte(signed >> 1) << np.uint64(24) | byte(signed - 1) | n << np.uint64(8)
                h ^= np.uint64((s[0] & 0xFFFFFFFF) ^ (s[0] >> 32))
                h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
                h = h ^ (h >> np.uint64(32))
            elif most == 8:
                last = (first >> ((n - np.uint64(4)) << np.uint64(3))) & _LOW
                h = (last + (first << np.uint64(32))) ^ np.uint64(s[1] ^ s[2])
                h ^= (h << np.uint64(49) | h >> np.uint64(15)) ^ (h << np.uint64(24) | h >> np.uint64(40))
                h *= np.uint64(0x9FB21C651E98DF25)
                h ^= (h >> np.uint64(35)) + n
                h *= np.uint64(0x9FB21C651E98DF25)
                h ^= h >> np.uint64(28)
            elif most == 16:
                low, high = first ^ np.uint64(s[3] ^ s[4]), at(p + signed - 8) ^ np.uint64(s[5] ^ s[6])
                h = _avalanche(n + low.byteswap() + high + _fold(low, high))
            else:
                h = n * np.uint64(0x9E3779B185EBCA87)
                h += _fold(first ^ np.uint64(s[0]), at(p + 8) ^ np.uint64(s[1]))
                h += _fold(at(p + signed - 16) ^ np.uint64(s[2]), at(p + signed - 8) ^ np.uint64(s[3]))
                h = _avalanche(h)
            out[some] = h
    for i in np.flatnonzero(size > 32).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return out


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, one text after the other, and the number of words of each; a null has none."""
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)  # where a text begins or ends
    edge[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(start, ends))
    return xxh3(data, start, np.flatnonzero(last) + 1 - start), counts


def text_slices(batches: Iterable[pa.RecordBatch], column: int, size: int = 300_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, at = np.cumsum(length, dtype=np.int64), 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def word_lists(texts: pa.Array) -> Iterator[np.ndarray]:
    """The hashes of the words of each text."""
    for batch in text_slices([pa.RecordBatch.from_arrays([texts], ["text"])], 0):
        words, counts = hashed(batch.column(0))
        yield from np.split(words, np.cumsum(counts)[:-1])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words; a shorter, non-empty text is one run."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out = out * _MUL + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of df has it, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of a histogram that a step of `heaviest` sends to the driver, at most.
BINS = 4096


def heaviest(counts: DataFrame, word: str, n: str, size: int) -> Column:
    """A condition: at most `size` rows of (word, n) with the greatest n; all, if there are no more.

    The least n comes from histograms, each over the bin of the one before in
    which it lies, so the driver gets BINS rows a step whatever the number of
    partitions.  Equal n are ordered by 12 bits of the word's hash; words that
    are equal in both are taken alike, so a few less than `size` may return.
    counts is read some six times: keep it.
    """
    rank = F.col(n) * BINS + F.pmod(F.xxhash64(word), F.lit(BINS))
    low, high = 0, (counts.select(F.max(rank)).first()[0] or 0) + 1
    above = 0
    while True:
        step = -(-(high - low) // BINS)
        inside = counts.where((rank >= low) & (rank < high))
        place = F.floor((rank - low) / F.lit(step)).cast("int")
        bins = inside.groupBy(place.alias("b")).agg(F.count("*")).collect()
        for b, rows in sorted((tuple(r) for r in bins), reverse=True):
            if above + rows > size:
                break
            above += rows
        else:
            return rank >= low
        low, high = low + b * step, min(high, low + (b + 1) * step)
        if high - low == 1:
            return rank >= high


#: Words of 64 bits in a sieve; its size is fixed, whatever the number of keys.
SIEVE = 131_072


def sieve(df: DataFrame, column: Column, keys: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """df in two: rows whose column may be in keys, and rows whose column is not.

    A bitmap of fixed size marks the hashes of all keys.  It saves the shuffle
    of rows that a join would not touch; a join on the first part still
    decides.  With many million keys nearly all rows are in the first part.
    keys has one column; null is a key like any other.
    """

    def place(c: Column) -> tuple[Column, Column]:
        h = F.xxhash64(F.coalesce(c.cast("string"), F.lit("")))
        return F.pmod(h, F.lit(SIEVE)), F.pmod(F.shiftright(h, 20), F.lit(64))

    slot, bit = place(keys[keys.columns[0]])
    marks = keep(
        keys.select(slot.alias("_slot"), F.expr("1L").alias("_one"), bit.cast("int").alias("_bit"))
        .groupBy("_slot")
        .agg(F.bit_or(F.call_function("shiftleft", F.col("_one"), F.col("_bit"))).alias("_word")),
        label,
    )
    slot, bit = place(column)
    at, in_word, word = (unused(df, n) for n in ("_slot", "_bit", "_word"))
    named = marks.select(F.col("_slot").alias(at), F.col("_word").alias(word))
    marked = df.withColumns({at: slot, in_word: bit.cast("int")}).join(F.broadcast(named), at, "left")
    hit = F.call_function("getbit", F.coalesce(F.col(word), F.lit(0).cast("long")), F.col(in_word)) == 1
    return marked.where(hit).select(*df.columns), marked.where(~hit).select(*df.columns)
