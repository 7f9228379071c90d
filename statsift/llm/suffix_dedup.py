"""Suffix-array dedup of repeated passages, by two-stage suffix sorting.

Removed is every byte covered by a string of ``length`` bytes that also starts
earlier: in a document with a smaller id, or earlier in the same one.

1. *Segments.*  Each window of ``length`` bytes is keyed by its anchor, the
   smallest hash among its ``ANCHOR``-byte grams.  Neighbouring windows with the
   same anchor form a segment; equal windows have equal anchors, so a window need
   only be compared within its anchor's group.  Only digests are shuffled.
2. *Pre-aggregation.*  Of segments that are equal as a whole, the first stays and
   the others are repeats; a batch does this before the shuffle, so a group of
   copies however large sends few rows.
3. *Suffix arrays.*  What remains under an anchor that has several different
   segments is fetched and sorted block by block.  Of a block's suffixes only
   those smaller than their successors are sorted directly; one scan over the
   buckets induces the rest; adjacent common prefixes of ``length`` bytes and more
   are the equal windows, and all but the earliest are repeats.
4. An anchor with more than ``HOT`` different segments would make too large a
   block.  Its windows are compared one by one by 128-bit digests instead, which
   spreads them over all tasks.

Defined cases: a null text is an empty one; texts shorter than ``length`` lose
nothing; null ids come before all others; rows that share an id and a text are
one document, rows that share an id but not a text are versions of it (a string
at the same start in another version is not earlier); a very long text is cut into
segments part by part, but held by one task; ``length`` is at most ``MOST_LENGTH``, else
a ValueError; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statsift.llm import _common as c

LENGTH = 100
ANCHOR = 32
BLOCK = 1 << 20
HOT = 4096
#: A segment has at most ``length`` - ``ANCHOR`` + 1 windows, which seven bits must hold.
MOST_LENGTH = ANCHOR + 126
#: Bits of a place in a buffer, below the hash that decides an anchor.
PLACE = 26
#: Windows of a longer text are cut into segments a part at a time.
PART = 1 << 20
#: Bytes of short texts that are gone through at once; the arrays over them take some sixty times as much.
JOINED = 1 << 19
#: ``packed``: start, 24 bits of the text's hash, windows of the segment.
SEGMENTS = "anchor long, segment long, doc_id long, packed long, again boolean"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BYTE_HASH = np.random.default_rng(1).integers(0, 1 << 63, 256).astype(np.uint64)


# --- segments ---------------------------------------------------------------


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` bytes, by doubling."""
    power, block, width = _ODD, _BYTE_HASH[data], 1
    out, done = None, 0
    rest = size
    while rest:
        if rest & 1:
            if out is None:
                out, done = block.copy(), width
            else:
                tail = block[done:]
                out = out[: len(tail)] * power + tail
                done += width
        rest >>= 1
        if rest:
            block = block[:-width] * power + block[width:]
            power = np.uint64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)
            width *= 2
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return out ^ (out >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """``text, start, windows, anchor, digest`` of the segments of some texts."""
    size = min(ANCHOR, length)
    found = []
    parts = []  # (text, start, bytes)
    for k, data in enumerate(texts):
        for at in range(0, len(data) - length + 1, PART):
            parts.append((k, at, data[at : at + PART + length - 1]))
    i = 0
    while i < len(parts):
        j, held = i, 0
        while j < len(parts) and (j == i or held + len(parts[j][2]) <= JOINED):
            held += len(parts[j][2])
            j += 1
        joined = b"".join(p[2] for p in parts[i:j])
        data = np.frombuffer(joined, np.uint8)
        lengths = np.array([len(p[2]) for p in parts[i:j]])
        offsets = np.cumsum(lengths) - lengths
        grams = gram_hashes(data, size)
        low = np.uint64((1 << PLACE) - 1)
        marked = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(marked, length - size + 1) & low).astype(np.int64)
        owner = np.repeat(np.arange(j - i), lengths)[: len(place)]
        whole = np.arange(len(place)) + length <= (offsets + lengths)[owner]
        first = np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))) & whole
        begin = np.flatnonzero(first)
        # a segment ends where the next begins or its text has no further window
        last_of_text = (offsets + lengths - length + 1)[owner[begin]]
        end = np.minimum(np.append(begin[1:], len(place)), last_of_text)
        digest = np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(begin.tolist(), (end + length - 1).tolist())), np.uint64, len(begin))
        who = np.array([p[0] for p in parts[i:j]])[owner[begin]]
        base = np.array([p[1] for p in parts[i:j]])[owner[begin]]
        found.append((who, begin - offsets[owner[begin]] + base, end - begin, grams[place[begin]], digest))
        i = j
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(map(np.concatenate, zip(*found)))


def text_mark(data: bytes) -> int:
    """24 bits that tell versions of a document apart."""
    return xxhash.xxh3_64_intdigest(data) & 0xFFFFFF


def _segment_rows(batch: pa.RecordBatch, length: int) -> pa.Table:
    """The segments of a batch; those that repeat one of the batch are marked and spread by chance."""
    ids = batch.column("doc_id")
    rank = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
    columns: list[list[np.ndarray]] = [[], [], [], []]
    at = 0
    for part in c.slices(batch, "text"):
        texts = [(t or "").encode() for t in part.column("text").to_pylist()]
        who, start, windows, anchor, digest = segments(texts, length)
        mark = np.array([text_mark(t) if len(t) >= length else 0 for t in texts], np.int64)
        for column, values in zip(columns, (who + at, start << 31 | mark[who] << 7 | windows, anchor, digest)):
            column.append(values)
        at += part.num_rows
    who, packed, anchor, digest = map(np.concatenate, columns)
    order = np.lexsort((packed, rank[who], digest, anchor))
    who, packed, anchor, digest = who[order], packed[order], anchor[order], digest[order]
    same = np.zeros(len(who), bool)
    same[1:] = (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same)))) if len(same) else np.zeros(0, np.int64)
    again = same & ((rank[who] != rank[who[lead]]) | (packed >> 31 != packed[lead] >> 31))
    anchor = np.where(again, (rank[who].view(np.uint64) + packed.view(np.uint64)) * _ODD, anchor)
    return pa.table({
        "anchor": anchor.view(np.int64), "segment": np.where(again, anchor, digest).view(np.int64),
        "doc_id": ids.take(pa.array(who)), "packed": packed, "again": again,
    })


# --- suffix arrays ----------------------------------------------------------


def packs(t: np.ndarray) -> np.ndarray:
    """Seven symbols of nine bits from every place on, as one number."""
    wide = np.concatenate((t, np.zeros(7, t.dtype))).astype(np.int64)
    out = np.zeros(len(t), np.int64)
    for k in range(7):
        out = out << 9 | wide[k : k + len(t)]
    return np.concatenate((out, np.zeros(1, np.int64)))


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one counts as smaller."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    at = np.where(differs, np.arange(n), n - 1)
    decides = np.minimum.accumulate(at[::-1])[::-1]  # the first place from here on that differs from its next
    return np.append(t[:-1] < t[1:], True)[decides]


def sort_directly(which: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Some suffixes in the order of their first ``depth`` symbols; ties stay as they are."""
    last = len(words) - 1
    order = which[np.argsort(words[which], kind="stable")]
    key = words[order]
    tied = np.concatenate(([False], key[1:] == key[:-1]))
    for at in range(7, depth, 7):
        member = tied | np.append(tied[1:], False)
        places = np.flatnonzero(member)
        if not len(places):
            break
        group = np.cumsum(~tied[places])
        here = order[places]
        key = words[np.minimum(here + at, last)]
        fine = np.lexsort((key, group))
        order[places] = here[fine]
        key = key[fine]
        tied[places] = np.concatenate(([False], (group[1:] == group[:-1]) & (key[1:] == key[:-1])))
    return order


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``t`` in the order of ``depth`` symbols or more.

    Symbols lie in 0 to 256; 0 separates texts, and what stands behind a
    separator does not count.  Two stages: suffixes smaller than their successors
    are sorted directly, the larger ones induced."""
    n = len(t)
    small = smaller_than_next(t)
    words = packs(t)
    counts = np.bincount(t, minlength=257)
    ends = np.cumsum(counts)
    fill = ends - counts  # where the next induced suffix of a bucket goes
    direct = np.flatnonzero(small & (t > 0))
    out = np.full(n, -1, np.int64)
    smalls = np.bincount(t[small], minlength=257)
    ordered = sort_directly(direct, words, depth)
    first = t[ordered].astype(np.int64)
    nth = np.arange(len(ordered)) - (np.cumsum(np.bincount(first, minlength=257)) - np.bincount(first, minlength=257))[first]
    out[ends[first] - smalls[first] + nth] = ordered
    breaks = np.flatnonzero(t == 0)
    out[: len(breaks)] = breaks  # in any order
    fill[0] = ends[0]

    def induce(scanned: np.ndarray, symbol: int) -> None:
        before = scanned[scanned > 0] - 1
        before = before[~small[before] & (t[before] >= max(symbol, 1))]
        if not len(before):
            return
        bucket = t[before]
        by = np.argsort(bucket, kind="stable")
        bucket = bucket[by].astype(np.int64)
        got = np.bincount(bucket, minlength=257)
        start = np.cumsum(got) - got
        out[fill[bucket] + np.arange(len(bucket)) - start[bucket]] = before[by]
        fill[:] += got

    for symbol in np.flatnonzero(counts).tolist():
        at = int(ends[symbol] - counts[symbol])
        if symbol:
            while at < fill[symbol]:  # induced ones; a run of one symbol induces into its own bucket
                upto = int(fill[symbol])
                induce(out[at:upto], symbol)
                at = upto
        induce(out[int(ends[symbol] - smalls[symbol]) : int(ends[symbol])], symbol)
    return out


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix with the one before it in order, ``most`` at most."""
    words = packs(t)
    last = len(words) - 1
    out = np.zeros(len(order), np.int64)
    a, b, rows = order[:-1], order[1:], np.arange(1, len(order))
    for at in range(0, most, 7):
        x = words[np.minimum(a + at, last)] ^ words[np.minimum(b + at, last)]
        equal = x == 0
        for k in range(1, 8):
            out[rows] += x < np.int64(1) << (63 - 9 * k) if k < 7 else equal
        a, b, rows = a[equal], b[equal], rows[equal]
        if not len(rows):
            break
    return np.minimum(out, most)


def repeated_windows(pieces: list[bytes], ranks: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that also start earlier: (piece, place in it).

    Pieces stand in order of (rank of their document, start)."""
    data = b"\xff".join(pieces) + b"\xff"
    lengths = np.array([len(p) + 1 for p in pieces])
    offsets = np.cumsum(lengths) - lengths
    t = np.frombuffer(data, np.uint8).astype(np.int16) + 1
    t[offsets + lengths - 1] = 0
    order = suffix_array(t, length)
    same = common_prefixes(t, order, length) >= length
    owner = np.repeat(np.arange(len(pieces)), lengths)
    room = (offsets + lengths - 1)[owner] - np.arange(len(t)) >= length
    same[1:] &= room[order[1:]] & room[order[:-1]]
    class_start = np.flatnonzero(~same)
    least = np.minimum.reduceat(order, class_start)
    first = np.repeat(least, np.diff(np.append(class_start, len(order))))
    later = order != first
    here, there = order[later], first[later]
    mine, its = owner[here], owner[there]
    earlier = (ranks[mine] != ranks[its]) | (starts[mine] + here - offsets[mine] != starts[its] + there - offsets[its])
    here = np.sort(here[earlier])
    return owner[here], here - offsets[owner[here]]


# --- the operator -----------------------------------------------------------

SPANS = "doc_id long, mark int, low long, high long"


def _fetch(batch: pa.RecordBatch, length: int) -> pa.Table:
    """The bytes of the wanted segments of each document."""
    anchors, many, ids, places, data = [], [], [], [], []
    for doc_id, text, wanted in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "wanted"))):
        raw = (text or "").encode()
        mark = text_mark(raw)
        for w in wanted:
            if w["packed"] >> 7 & 0xFFFFFF == mark:
                start = w["packed"] >> 31
                anchors.append(w["anchor"])
                many.append(w["different"])
                ids.append(doc_id)
                places.append(w["packed"])
                data.append(raw[start : start + (w["packed"] & 0x7F) + length - 1])
    return pa.table({"anchor": pa.array(anchors, pa.int64()), "different": pa.array(many, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "packed": pa.array(places, pa.int64()), "data": pa.array(data, pa.binary())})


def _spans(ids: list, packed: np.ndarray, piece: np.ndarray, place: np.ndarray, length: int) -> pa.Table:
    """Runs of neighbouring window starts as spans of bytes."""
    new = np.concatenate(([True], (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1))) if len(piece) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(piece)) - 1 if len(begin) else begin
    who = piece[begin]
    low = (packed[who] >> 31) + place[begin]
    return pa.table({"doc_id": pa.array([ids[k] for k in who.tolist()], pa.int64()), "mark": pa.array(packed[who] >> 7 & 0xFFFFFF, pa.int32()), "low": low, "high": low + (place[end] - place[begin]) + length})


def _sorted_blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole anchor groups through the suffix array."""
    held: list[tuple] = []
    size, last = 0, None

    def finish() -> pa.Table:
        ids = [r[1] for r in held]
        packed = np.array([r[2] for r in held], np.int64)
        ranks = np.array([-(1 << 63) if d is None else d for d in ids], np.int64)
        piece, place = repeated_windows([r[3] for r in held], ranks, packed >> 31, length)
        return _spans(ids, packed, piece, place, length)

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("anchor", "doc_id", "packed", "data"))):
            if size >= BLOCK and row[0] != last:
                yield from finish().to_batches()
                held, size = [], 0
            held.append(row)
            size += len(row[3])
            last = row[0]
    if held:
        yield from finish().to_batches()


def _single_windows(batch: pa.RecordBatch, length: int) -> pa.Table:
    """Every window of a segment as a segment of its own, keyed by its 128-bit digest."""
    digests, rows, places = [], [], []
    at = 0
    for part in c.slices(batch, "data", 1 << 18):
        keys = []
        for k, (packed, data) in enumerate(zip(part.column("packed").to_pylist(), part.column("data").to_pylist()), at):
            n = len(data) - length + 1
            keys += [xxhash.xxh3_128_digest(data[i : i + length]) for i in range(n)]
            rows.append(np.full(n, k))
            places.append((packed & ~0x7F) + (np.arange(n) << 31) + 1)
        digests.append(np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2))
        at += part.num_rows
    both, which = np.concatenate(digests), np.concatenate(rows)
    return pa.table({"anchor": both[:, 0].copy(), "segment": both[:, 1].copy(), "doc_id": batch.column("doc_id").take(pa.array(which)), "packed": np.concatenate(places), "again": np.zeros(len(which), bool)})


def _mark_repeats(rows: DataFrame) -> DataFrame:
    """``again`` for all but the earliest of equal segments; ``lead`` for that one."""
    order = Window.partitionBy("anchor", "segment").orderBy("again", F.col("doc_id").asc_nulls_first(), "packed")
    first_id, first_packed = F.first("doc_id").over(order), F.first("packed").over(order)
    start = lambda p: F.shiftrightunsigned(p, 31)
    later = ~F.col("doc_id").eqNullSafe(F.col("first_id")) | (start(F.col("packed")) != start(F.col("first_packed")))
    marked = rows.repartition("anchor").withColumns({"first_id": first_id, "first_packed": first_packed, "lead": F.row_number().over(order) == 1})
    return marked.select("anchor", "doc_id", "packed", (F.col("again") | later).alias("again"), (F.col("lead") & ~F.col("again")).alias("lead"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, low, high``: the bytes [low, high) of a text are covered by repeats.

    The segments are compared when this is called."""
    if not 1 <= length <= MOST_LENGTH:
        raise ValueError(f"length {length} is not in 1 to {MOST_LENGTH}")
    rows = c.pick(docs, doc_id=id_col, text=text_col)
    found = rows.mapInArrow(c.per_batch(_segment_rows, length=length), SEGMENTS)
    different = F.sum(F.col("lead").cast("long")).over(Window.partitionBy("anchor"))
    repeats = _mark_repeats(found).withColumn("different", different).filter("again OR (lead AND different > 1)")
    repeats = c.cut(repeats.select("anchor", "doc_id", "packed", "again", "different"), "repeats")

    wanted = repeats.filter("NOT again").groupBy("doc_id").agg(F.collect_list(F.struct("packed", "anchor", "different")).alias("wanted"))  # no more than a document has
    wanted = wanted.withColumnRenamed("doc_id", "id")
    fetched = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "wanted")
    data = fetched.mapInArrow(c.per_batch(_fetch, length=length), "anchor long, different long, doc_id long, packed long, data binary")
    data = c.cut(data, "segments")

    few = data.filter(F.col("different") <= HOT).select("anchor", "doc_id", "packed", "data")
    few = few.repartition("anchor").sortWithinPartitions("anchor", F.col("doc_id").asc_nulls_first(), "packed")
    by_sorting = few.mapInArrow(lambda batches: _sorted_blocks(batches, length), SPANS)

    single = data.filter(F.col("different") > HOT).select("doc_id", "packed", "data").mapInArrow(c.per_batch(_single_windows, length=length), SEGMENTS)
    whole = repeats.filter("again").select("doc_id", "packed").union(_mark_repeats(single).filter("again").select("doc_id", "packed"))
    low = F.shiftrightunsigned("packed", 31)
    as_spans = whole.select(
        "doc_id",
        F.shiftrightunsigned("packed", 7).bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("mark"),
        low.alias("low"),
        (low + F.col("packed").bitwiseAND(F.lit(0x7F)) + F.lit(length - 1)).alias("high"),
    )
    return by_sorting.union(as_spans)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``data`` without the bytes of ``spans``, which are merged."""
    at, kept = 0, []
    for low, high in spans:
        kept.append(data[at:low])
        at = high
    return b"".join(kept) + data[at:]


def _with_spans(docs: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    taken = {x.lower() for x in docs.columns}
    key, spans_of = (next(n for n in (f"{x}{i}" for i in range(len(taken) + 1)) if n not in taken) for x in ("__span_doc", "__spans"))
    listed = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("mark", "low", "high")).alias(spans_of))
    return docs.join(listed, docs[id_col].eqNullSafe(listed[key]), "left").drop(key)


def _own(spans: list[dict] | None, data: bytes) -> list[tuple[int, int]]:
    if not spans:
        return []
    mark = text_mark(data)
    return merged([(s["low"], s["high"]) for s in spans if s["mark"] == mark])


def dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""

    def summarise(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column(2).to_pylist()):
            data = (text or "").encode()
            own = _own(spans, data)
            rows.append((len(data), sum(b - a for a, b in own), len(own), hashlib.sha256(without(data, own)).hexdigest()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in zip(*rows))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = c.pick(docs, doc_id=id_col, text=text_col)
    joined = _with_spans(rows, repeated_spans(rows, length), "doc_id")
    return joined.mapInArrow(c.per_batch(summarise), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeats cut out of the texts; all columns and rows stay.

    A character of which only some bytes are left goes too."""
    names = docs.columns

    def strip(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = names.index(text_col)
        texts = []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
            data = (text or "").encode()
            own = _own(spans, data)
            texts.append(without(data, own).decode("utf-8", "ignore") if own else text)
        arrays = [pa.array(texts, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(len(names))]
        return pa.RecordBatch.from_arrays(arrays, names)

    joined = _with_spans(docs, repeated_spans(docs, length, id_col, text_col), id_col)
    return joined.mapInArrow(c.per_batch(strip), docs.schema)
