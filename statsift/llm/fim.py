"""Fill-in-the-middle: texts cut in three and put in another order.

A text is a run of units: a stretch of the letters A-Z and a-z, or any other code
point.  One numpy kernel works on the UTF-8 buffer of all rows of an Arrow batch
together: a table gives each byte its class, a mask of neighbouring bytes marks where
units begin, running counts that start anew with each document number them, and one
sorted search finds the cuts of all rows.  Parts are views of the same buffer, and the
output is joined from them at once; no row is looked at by itself.

``transform`` gives the outputs as texts, ``restore`` rebuilds the texts from outputs
and forms alone.

Defined cases: a null text is an empty one, and plain; a null id is hashed as an empty
one, and stays null; repeated ids are cut at the same draws; a text of any length is cut
whole, and the kernel holds about ten bytes for each of its bytes; an empty table
gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statsift.llm import _common as c

# What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
INNER, LETTER, OTHER = 0, 1, 2
DRAWS = ("h1", "h2", "h3", "h4")
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def byte_classes() -> np.ndarray:
    """Of each byte: within a code point, a letter, or the start of another code point."""
    table = np.full(256, OTHER, np.uint8)
    table[0x80:0xC0] = INNER
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1] = LETTER
    return table


CLASSES = byte_classes()


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets (n + 1 of them, from 0) and the bytes of a string array without nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], held


def parts_of(ends: np.ndarray, data: np.ndarray) -> list[pa.Array]:
    """The parts of all rows as string arrays over one buffer; ``ends``: a row's part k ends at ``ends[row, k]``."""
    rows, n = ends.shape
    offsets = np.concatenate((np.zeros(1, np.int64), ends.reshape(-1)))
    views = pa.Array.from_buffers(pa.large_string(), rows * n, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return [views.take(pa.array(np.arange(k, rows * n, n))) for k in range(n)]


def unit_starts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A mask of the bytes at which units begin: code points but for letters behind a letter of the same row."""
    kind = CLASSES[data]
    starts = kind != INNER
    if len(kind) > 1:
        starts[1:] &= ~((kind[1:] == LETTER) & (kind[:-1] == LETTER))
    inside = begin[begin < len(data)]
    starts[inside] = True
    return starts


def counts_at(mask: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bytes before each place are marked."""
    running = np.zeros(len(mask) + 1, np.int32 if len(mask) < 2**31 else np.int64)
    np.cumsum(mask, out=running[1:])
    return running[places].astype(np.int64)


def cut_batch(texts: pa.Array, draws: list[np.ndarray], plain_from: int, spm_below: int) -> dict[str, pa.Array | np.ndarray]:
    """The columns of ``OUT`` but for the id, for all rows of an array at once.

    ``draws``: four numbers a row; the first two give the cuts, the others the form."""
    offsets, data = buffer_of(texts)
    begin, end = offsets[:-1], offsets[1:]
    starts = unit_starts(data, begin)
    running = np.zeros(len(data) + 1, np.int32 if len(data) < 2**31 else np.int64)
    np.cumsum(starts, out=running[1:])
    before = running[begin].astype(np.int64)
    n = running[end] - before  # the count starts anew with each row
    one, two = draws[0] % (n + 1), draws[1] % (n + 1)
    low, high = np.minimum(one, two), np.maximum(one, two)

    def place(units: np.ndarray) -> np.ndarray:
        """Where unit number ``units`` of each row begins, or the row's end."""
        at = np.searchsorted(running, before + units + 1, side="left") - 1
        return np.where(units < n, np.minimum(at, end), end)

    first, second = place(low), place(high)
    del running
    marked = pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}").to_numpy(zero_copy_only=False).astype(bool)
    plain = (n == 0) | marked | (draws[2] % 100 >= plain_from)
    spm = ~plain & (draws[3] % 100 < spm_below)

    whole = CLASSES[data] != INNER
    chars = counts_at(whole, np.concatenate((begin, first, second))).reshape(3, -1)
    prefix, middle, suffix = parts_of(np.stack((first, second, end), axis=1), data)
    say = lambda *parts: pc.binary_join_element_wise(*(pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts), pa.scalar("", pa.large_string()))
    psm = say(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    output = pc.case_when(pc.make_struct(pa.array(plain), pa.array(spm)), texts.cast(pa.large_string()), say(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), psm)
    form = pc.case_when(pc.make_struct(pa.array(plain), pa.array(spm)), "plain", "spm", "psm")
    return {"n": pa.array(n), "form": form, "prefix_chars": pa.array(chars[1] - chars[0], mask=plain), "middle_chars": pa.array(chars[2] - chars[1], mask=plain), "output": output}


def restore_batch(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts of all rows; the markers' first places tell the parts, since a text that has one is plain."""
    plain = pc.equal(forms, "plain").to_numpy(zero_copy_only=False)
    spm = pc.equal(forms, "spm").to_numpy(zero_copy_only=False)
    offsets, data = buffer_of(outputs)
    begin, end = offsets[:-1], offsets[1:]
    find = lambda mark: begin + np.maximum(pc.find_substring(outputs, mark).to_numpy(zero_copy_only=False), 0)
    second = np.where(plain, begin, np.where(spm, find(PREFIX), find(SUFFIX)))
    third = np.where(plain, begin, find(MIDDLE))
    head, gap = np.where(plain, 0, len(PREFIX)), np.where(plain, 0, len(SUFFIX))
    # marker, part, marker, part, marker, part; of a plain row all is in the last part
    _, a, _, b, _, m = parts_of(np.stack((begin + head, second, second + gap, third, third + gap, end), axis=1), data)
    swapped = pa.array(spm)
    join = lambda *parts: pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string()))
    return join(pc.if_else(swapped, b, a), m, pc.if_else(swapped, a, b))


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(h) for i, h in enumerate(DRAWS)]


def transform(docs: DataFrame, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every text.

    Of 100 draws those from ``plain_from`` on leave a text plain; of the others
    those below ``spm_below`` put the suffix first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in c.slices(whole, "text"):
                got = cut_batch(batch.column("text"), [batch.column(h).to_numpy() for h in DRAWS], plain_from, spm_below)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **got, "output": got["output"].cast(pa.string())})

    rows = c.pick(docs, doc_id=id_col, text=text_col)
    drawn = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *draws(F.col("doc_id"), seed))
    return drawn.mapInArrow(run, OUT)


def restore(transformed: DataFrame) -> DataFrame:
    """The columns of ``transform`` and the text rebuilt from output and form: ``restored``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in c.slices(whole, "output"):
                text = restore_batch(batch.column("output"), batch.column("form"))
                yield batch.append_column("restored", text.cast(pa.string()))

    return transformed.mapInArrow(run, OUT + ", restored string")
