"""Exact removal of passages that repeat across all documents, by suffix arrays.

Every 100-byte window of every text is judged: it repeats if the same bytes start earlier (a smaller id,
or earlier in the same document). Three steps keep that whole and bring only what can repeat together:

1. Anchors. The least-hashed 24-byte string of a window is a place that equal windows share (and share its
   offset), so a text is cut into runs of windows with one anchor each, about one for 39 bytes. A run is known by the
   hash of its anchor and of its bytes; runs of unlike anchors have no window in common.
2. Equal runs are reduced to the first, whose copies repeat as a whole. Runs that are alone with their anchor are done.
3. Different runs with one anchor are gathered by the bytes that all windows at some offsets of the anchor hold,
   in blocks, and go through ``classes``: a suffix array and Burrows-Wheeler order of the block, and threshold-bounded
   expansion of intervals, breadth first by backward extension: boundaries of intervals with common prefix l, mapped
   back by one symbol, are those with l + 1; it stops at length 100 or when a level has no new boundary.
   Windows in one interval then are equal, and all but the first repeat.

Hot groups are split twice. A task sends a run that it has sent before on as a copy, and of an anchor's unlike runs
only two to where the anchor's others are, which is enough to know that there are any; the rest are dealt by their
own bytes (``_Seen``). So a passage in a third of all documents costs a few rows a task. Step 3 counts its groups, and
one of more than ``HOT_PIECES`` is divided: the range of offsets is halved, the halves hold more bytes in common,
and pieces that differ there part, until at a single offset a group is one window.

Defined cases: a null text is empty; texts under 100 bytes keep all. A document is a row's id and text: rows that
repeat both are one document and all get its result, rows that repeat an id with other texts are documents of their own,
in the order of a hash of their texts. Null ids come last, in that order too. An empty table gives an empty result.
Runs of one byte or period and very long texts need no special care: a run is at most 176 bytes, equal ones
collapse, and long texts are cut in overlapping slices. A row that is repeated any number of times costs its runs once a task.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import Workspace, parts_for, table
from sparkloom.llm.texthash import INVERSE, U, groups, mix, powers, prefix_sums, text_groups

LENGTH = 100
ANCHOR = 24
#: Offsets of an anchor in a window are 0 .. WIDTH - 1; those up to HALF are the right side.
WIDTH = LENGTH - ANCHOR + 1
HALF = WIDTH // 2
SLICE = 1 << 19
PLACE_BITS = U(23)
BLOCK = 300_000
#: Unlike pieces that a group of step 3 holds at most before it is divided.
HOT_PIECES = 512
#: Pieces that a task divides.
DIVIDE_ROWS = 20_000
#: Entries of the tables in which a task finds what it has sent.
SLOT_BITS = U(18)
NORMAL_RUN, COPY, DEALT = 0, 1, 2
BROADCAST_IDS = 1_000_000
NO_ID = 2**63 - 1


def anchors(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of valid window starts with one anchor: first start, last start, anchor's place, hashes of anchor and run. data: at most 2 ** 23 bytes."""
    if len(data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    sums, inverse = prefix_sums(data), powers(len(data), INVERSE)
    hashes = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: len(data) - ANCHOR + 1])
    place = (U(1) << PLACE_BITS) - U(1)
    least = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= WIDTH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = WIDTH - width
    least = np.minimum(least[: len(least) - rest], least[rest:])
    at = (least & place).astype(np.int64)
    valid = valid[: len(at)]
    change = np.empty(len(at) + 1, bool)
    change[0] = change[-1] = True
    change[1:-1] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    lo = np.flatnonzero(change[:-1] & valid)
    hi = np.flatnonzero(change[1:] & valid)
    q = at[lo]
    offsets = ((q - lo) * 128 + (q - hi)).astype(np.uint64)
    runs = mix((sums[hi + LENGTH] - sums[lo]) * inverse[lo] + mix(offsets))
    return lo, hi, q, hashes[q], runs


def _slices(text: bytes):
    """(offset, bytes) that hold each window once: neighbours overlap by one byte less than a window."""
    for a in range(0, max(1, len(text) - LENGTH + 1), SLICE):
        yield a, text[a : a + SLICE + LENGTH - 1]


class _Seen:
    """Runs that a task has sent, in tables of fixed size whose entries make way for later ones; what is no longer known only costs rows."""

    def __init__(self):
        slots = 1 << int(SLOT_BITS)
        self.run, self.place = np.zeros(slots, np.uint64), np.zeros((3, slots), np.int64)
        self.anchor, self.sample, self.unlike = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, bool)

    def copies(self, h: np.ndarray, run: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which of some different runs were sent with an earlier place; place: id, tie and meta of each."""
        name = mix(run + h * U(3))
        slot = (name >> (U(64) - SLOT_BITS)).astype(np.int64)
        known, (a, b, c), (x, y, z) = self.run[slot] == name, self.place[:, slot], place
        later = known & ((x > a) | (x == a) & ((y > b) | (y == b) & (z > c)))
        new = ~later
        self.run[slot[new]] = name[new]
        self.place[:, slot[new]] = place[:, new]
        return later

    def dealt(self, h: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Which of some different runs, sorted by anchor, can be dealt by their bytes, as two unlike ones of the anchor were sent to its others."""
        if not len(h):
            return np.zeros(0, bool)
        slot = (h >> (U(64) - SLOT_BITS)).astype(np.int64)
        known = self.anchor[slot] == h
        before = np.where(known, 1 + self.unlike[slot], 0)
        new = ~(known & (self.sample[slot] == run))
        starts = np.flatnonzero(_starts(h))
        upto = np.cumsum(new)
        rank = upto - new - np.repeat((upto - new)[starts], np.diff(np.append(starts, len(h))))
        out = new & (before + rank >= 2) | (before >= 2)
        sent = before[starts] + np.add.reduceat(new.astype(np.int64), starts)
        at = slot[starts]
        self.sample[at] = np.where(known[starts], self.sample[at], run[starts])
        self.anchor[at], self.unlike[at] = h[starts], sent >= 2
        return out


class _Documents:
    """Documents that a task has met, in a table of fixed size whose entries make way for later ones; a document that is no longer known only costs rows."""

    def __init__(self):
        self.met = np.full((1 << int(SLOT_BITS), 2), -1, np.int64)
        self.free = np.ones(1 << int(SLOT_BITS), bool)

    def again(self, doc: int, tie: int) -> bool:
        slot = hash((doc, tie)) & ((1 << int(SLOT_BITS)) - 1)
        if not self.free[slot] and self.met[slot, 0] == doc and self.met[slot, 1] == tie:
            return True
        self.met[slot], self.free[slot] = (doc, tie), False
        return False


RUNS = "h long, run long, id long, tie long, meta long, kind byte"


def _anchor_rows(batches):
    """(id, tie, text) to runs of three kinds: to be judged with their anchor's others, copies, and those dealt by their bytes."""
    seen, documents = _Seen(), _Documents()
    for batch in batches:
        ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for x, y, texts in text_groups(batch.column(2)):
            yield from _runs_of([(k, e, a, part) for k, e, t in zip(ids[x:y], ties[x:y], texts, strict=True) if len(t) >= LENGTH and not documents.again(k, e) for a, part in _slices(t)], seen)


def _runs_of(pieces: list[tuple[int, int, int, bytes]], seen: _Seen):
    """(id, tie, offset, bytes) to rows of runs."""
    if pieces:
        for x, y in groups([len(p[3]) for p in pieces]):
            own = pieces[x:y]
            ends = np.cumsum([len(p[3]) for p in own])
            data = np.frombuffer(b"".join(p[3] for p in own), np.uint8)
            valid = np.ones(len(data), bool)
            for e in ends:
                valid[max(0, e - LENGTH + 1) : e] = False
            lo, hi, q, h, run = anchors(data, valid)
            which = np.searchsorted(ends, lo, "right")
            start = np.array([p[2] for p in own]) - np.concatenate(([0], ends[:-1]))
            meta = ((q + start[which]) << 16) | ((q - lo) << 8) | (q - hi)
            doc, tie = (np.array([p[k] for p in own], np.int64)[which] for k in (0, 1))
            order = np.lexsort((meta, tie, doc, run, h))
            h, run, doc, tie, meta = h[order], run[order], doc[order], tie[order], meta[order]
            once = _starts(h, run, doc, tie, meta)
            h, run, doc, tie, meta = h[once], run[once], doc[once], tie[once], meta[once]
            kind = np.full(len(h), COPY, np.int8)
            first = np.flatnonzero(_starts(h, run))
            first = first[~seen.copies(h[first], run[first], np.stack((doc[first], tie[first], meta[first])))]
            kind[first] = np.where(seen.dealt(h[first], run[first]), DEALT, NORMAL_RUN)
            columns = h.view(np.int64), run.view(np.int64), doc, tie, meta, kind
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "run", "id", "tie", "meta", "kind"])


def _whole(batches) -> pa.Table | None:
    batches = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(batches) if batches else None


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _judge_runs(batches):
    """All runs of some anchors, and all dealt ones of some bytes, to (id, tie, meta, again): copies of an equal run, and first runs with unlike mates, to be compared."""
    rows = _whole(batches)
    if rows is None:
        return
    columns = h, run, doc, tie, meta, kind = [rows.column(c).to_numpy() for c in ("h", "run", "id", "tie", "meta", "kind")]
    copy = kind == COPY

    def found(at: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(tie[at]), pa.array(meta[at]), pa.array(again)], names=["id", "tie", "meta", "again"])

    if copy.any():
        yield found(copy, np.ones(copy.sum(), bool))
        h, run, doc, tie, meta, kind = (c[~copy] for c in columns)
    if not len(h):
        return
    order = np.lexsort((h, kind))
    size = np.diff(np.append(np.flatnonzero(_starts(kind[order], h[order])), len(h)))
    order = order[np.repeat(size > 1, size) | (kind[order] == DEALT)]  # the rest is alone with its anchor
    order = order[np.lexsort((meta[order], tie[order], doc[order], run[order], h[order], kind[order]))]
    order = order[_starts(kind[order], h[order], run[order], doc[order], tie[order], meta[order])] if len(order) else order
    if not len(order):
        return
    first = _starts(kind[order], h[order], run[order])
    group = np.cumsum(_starts(kind[order], h[order])) - 1
    unlike = (np.bincount(group[first])[group] > 1) | (kind[order] == DEALT)
    chosen = ~first | unlike
    yield found(order[chosen], ~first[chosen])


PIECES = "key long, u byte, v byte, off byte, id long, tie long, lo long, hi long, piece binary, again boolean"


def _key(u: int, v: int, held: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(bytes((u, v)) + held, digest_size=8).digest(), "little", signed=True)


class _Pieces:
    """Rows of windows whose anchors lie at offsets u to v, and so hold the same bytes of the anchor's surroundings. A piece that the task has sent with an earlier place goes on as a copy."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.sent: dict[bytes, tuple[int, int, int]] = {}

    def add(self, u: int, v: int, off: int, low: int, doc: int, tie: int, lo: int, text: bytes) -> None:
        """text: the bytes of windows at offsets off (the first window's) to low of which some lie in u to v; lo: the first window's start."""
        a, c = min(off, v), max(low, u)
        if a < c:
            return
        lo, piece = lo + off - a, text[off - a : off - c + LENGTH]
        place, again = (doc, tie, lo), False
        name = bytes((u, v)) + piece
        held = self.sent.get(name)
        if held is None or place < held:
            if len(self.sent) >= 20_000:
                self.sent.clear()
            self.sent[name] = place
        elif place == held:
            return  # a repeated row's, which is one document with the row that sent it
        else:
            again = True
        # offset o of a window is its distance to the anchor, so text begins off bytes before it
        key = None if again else _key(u, v, text[off - u : off - v + LENGTH])
        self.rows.append((key, u, v, a, doc, tie, lo, lo + a - c, None if again else piece, again))

    def batch(self) -> pa.RecordBatch:
        types = (pa.int64(), pa.int8(), pa.int8(), pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(types)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])


def _cut_runs(batches):
    """(id, tie, text, metas) to pieces: the windows of a run on either side of its anchor."""
    out, documents = _Pieces(), _Documents()
    for batch in batches:
        for x, _, texts in text_groups(batch.column(2)):
            for k, text in enumerate(texts, x):
                doc, tie = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if documents.again(doc, tie):
                    continue
                for meta in batch.column(3)[k].as_py():
                    q, a, c = meta >> 16, meta >> 8 & 255, meta & 255
                    run = text[q - a : q - c + LENGTH]
                    out.add(0, HALF, a, c, doc, tie, q - a, run)
                    out.add(HALF + 1, WIDTH - 1, a, c, doc, tie, q - a, run)
            yield out.batch()


def _divide(batches):
    """Pieces to those of the halves of their offsets."""
    out = _Pieces()
    for batch in batches:
        for r in batch.to_pylist():
            middle = (r["u"] + r["v"]) // 2
            low = r["off"] - (r["hi"] - r["lo"])
            for u, v in ((r["u"], middle), (middle + 1, r["v"])):
                out.add(u, v, r["off"], low, r["id"], r["tie"], r["lo"], r["piece"])
        yield out.batch()


def suffix_order(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of text in the order of their suffixes, to depth symbols at least, by doubling."""
    n = len(text)
    padded = np.concatenate((text.astype(np.uint64), np.zeros(8, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << U(8)) | padded[j : j + n]
    held = 8
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        steps = np.cumsum(_starts(key[order]))
        rank[order] = steps
        if held >= depth or steps[-1] == n:
            return order
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - held)] = rank[held:]
        key = (rank.astype(np.uint64) << U(32)) | behind.astype(np.uint64)
        held *= 2


def classes(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place the number of its class: places are in one class if the next length symbols are equal.

    place[j - 1] and place[j] in suffix order are in one interval of common prefix l + 1 if their first symbols are equal and
    the places behind them are in one interval of common prefix l. So the boundaries of a level come from those of the
    level before by stepping back over the symbol that the Burrows-Wheeler order has there; entries still open are
    kept, and each gets its boundary once, in order of increasing prefix.
    """
    n = len(text)
    order = suffix_order(text, length)
    inverse = np.empty(n + 1, np.int32)
    inverse[order] = np.arange(n, dtype=np.int32)
    inverse[n] = 0
    bound = _starts(text[order])
    open_ = np.flatnonzero(~bound).astype(np.int32)
    behind = inverse[order + 1]
    here, before = behind[open_], behind[open_ - 1]
    for _ in range(length - 1):
        interval = np.cumsum(bound, dtype=np.int32)
        new = interval[here] != interval[before]
        if not new.any():
            break
        bound[open_[new]] = True
        stay = ~new
        open_, here, before = open_[stay], here[stay], before[stay]
    out = np.empty(n, np.int32)
    out[order] = np.cumsum(bound, dtype=np.int32)
    return out


def _repeats_of_block(doc: np.ndarray, start: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, window start) of the windows in pieces that also start earlier in another piece."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
    number = classes(text)
    at = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    windows = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(pieces)), windows)
    within = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    number, doc, start = number[at[owner] + within], doc[owner], start[owner] + within
    order = np.lexsort((start, doc, number))
    again = order[~_starts(number[order])]
    return doc[again], start[again]


def _ranges(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and window starts with neighbouring ones joined."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.maximum.reduceat(hi, at) if len(at) else hi


def _compare(batches):
    """All pieces of some keys to ranges (id, tie, lo, hi) of window starts that repeat."""
    rows = _whole(batches)
    if rows is None:
        return
    key, ids, ties, start = (rows.column(c).to_numpy() for c in ("key", "id", "tie", "lo"))
    column = rows.column("piece").combine_chunks()
    order = np.argsort(key, kind="stable")
    size = np.diff(np.append(np.flatnonzero(_starts(key[order])), len(key)))
    order = order[np.repeat(size > 1, size)]
    if not len(order):
        return
    by = np.lexsort((ties, ids))
    doc = np.empty(len(ids), np.int64)  # documents numbered in their order
    doc[by] = np.cumsum(_starts(ids[by], ties[by])) - 1
    order = order[np.lexsort((start[order], doc[order], key[order]))]
    order = order[_starts(key[order], doc[order], start[order])]  # rows that repeat are one document
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[int, bytes]] = []
    raw = 0

    def flush():
        at = np.array([k for k, _ in held])
        d, s = _repeats_of_block(doc[at], start[at], [p for _, p in held])
        out.append((d, s, s))

    edges = np.append(np.flatnonzero(_starts(key[order])), len(order))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        first: dict[bytes, int] = {}
        copies = []
        for k, piece in zip(order[a:b], column.take(pa.array(order[a:b])).to_pylist(), strict=True):
            if piece in first:
                copies.append((doc[k], start[k], start[k] + len(piece) - LENGTH))
            else:
                first[piece] = k
        if copies:
            out.append(tuple(np.array(x, np.int64) for x in zip(*copies, strict=True)))
        if len(first) > 1:
            held += [(k, p) for p, k in first.items()]
            raw += sum(len(p) + 1 for p in first)
        if raw >= BLOCK:
            flush()
            held, raw = [], 0
    if held:
        flush()
    if out:
        doc_of, lo, hi = _ranges(*(np.concatenate(c) for c in zip(*out, strict=True)))
        row = by[np.searchsorted(doc[by], doc_of)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ties[row]), pa.array(lo), pa.array(hi)], names=["id", "tie", "lo", "hi"])


_SPANS = T.ArrayType(T.ArrayType(T.LongType()))


@F.arrow_udf(_SPANS)
def _spans(marks: pa.Array) -> pa.Array:
    """Ranges of window starts to the byte runs that they cover, joined."""
    out = []
    for row in marks.to_pylist():
        spans: list[list[int]] = []
        for lo, hi in sorted((x["lo"], x["hi"]) for x in row):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi + LENGTH)
            else:
                spans.append([lo, hi + LENGTH])
        out.append(spans)
    return pa.array(out, pa.list_(pa.list_(pa.int64())))


def _meet(docs: DataFrame, rows: DataFrame, others: bool) -> DataFrame:
    """docs with the row of their id and tie. With few rows no other text is shuffled; others: docs without a row stay, with nulls."""
    by = ["id", "tie"]
    if rows.count() > BROADCAST_IDS:
        return docs.join(rows, by, "left" if others else "inner")
    few = F.broadcast(rows.select(*by))
    met = docs.join(few, by, "left_semi").join(rows.hint("shuffle_hash"), by)
    if not others:
        return met
    return docs.join(few, by, "left_anti").select("*", *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in by)).unionByName(met)


def _compared(work: Workspace, pieces: DataFrame, parts: int) -> DataFrame:
    """(id, tie, lo, hi): what repeats among the pieces. Groups that are too large are divided until none is; all that are small enough are compared in one go."""
    copies, small = [], []
    while True:
        pieces = work.keep(pieces, "pieces")
        copies.append(pieces.where("again").select("id", "tie", "lo", "hi"))
        fresh = pieces.where("not again")
        hot = work.keep(fresh.where("u < v").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_PIECES).repartition(1), "hot")  # few rows
        n_hot, n_pieces = hot.agg(F.count("n"), F.sum("n")).first()
        hot = hot.select("key")
        wanted = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
        small.append((fresh.join(wanted, "key", "left_anti") if n_hot else fresh).select("key", "id", "tie", "lo", "piece"))
        if not n_hot:
            break
        tasks = min(parts, 1 + n_pieces // DIVIDE_ROWS)
        pieces = fresh.join(wanted, "key", "left_semi").repartition(tasks).mapInArrow(_divide, PIECES)
    cold = reduce(DataFrame.union, small).repartition(parts, "key")
    return reduce(DataFrame.union, copies, work.keep(cold.mapInArrow(_compare, "id long, tie long, lo long, hi long"), "compared"))


def repeated_spans(work: Workspace, docs: DataFrame) -> DataFrame:
    """(id, tie, text as binary) to (id, tie, spans): the byte runs to remove, for documents that have any."""
    parts = parts_for(docs)
    texts = docs.select("id", "tie", "text")
    kind = F.col("kind")
    where = F.when(kind == NORMAL_RUN, F.col("h")).when(kind == DEALT, F.col("run")).otherwise(F.xxhash64("id", "meta"))
    runs = texts.mapInArrow(_anchor_rows, RUNS)
    judged = work.keep(runs.repartition(parts, where).mapInArrow(_judge_runs, "id long, tie long, meta long, again boolean"), "judged")
    asked = work.keep(judged.where("not again").groupBy("id", "tie").agg(F.collect_list("meta").alias("metas")), "asked")
    cut = _meet(texts, asked, others=False).select("id", "tie", "text", "metas").mapInArrow(_cut_runs, PIECES)
    q, a, c = F.shiftright("meta", 16), F.shiftright("meta", 8).bitwiseAND(F.lit(255)), F.col("meta").bitwiseAND(F.lit(255))
    marks = judged.where("again").select("id", "tie", (q - a).alias("lo"), (q - c).alias("hi"))
    marks = marks.union(_compared(work, cut, parts))
    return work.keep(marks.groupBy("id", "tie").agg(F.collect_list(F.struct("lo", "hi")).alias("marks")).select("id", "tie", _spans("marks").alias("spans")), "spans")


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (null ids as the largest long), tie (a hash of the text), row (all columns of docs), text (binary, empty for null), spans (null if none)."""
    work = Workspace(docs.sparkSession, "suffix")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    source = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"),
        F.struct(*(docs[c] for c in docs.columns if c != text_col)).alias("row"),
    )
    return _meet(source, repeated_spans(work, source), others=True)


def _left(text: bytes, spans) -> bytes:
    kept, at = [], 0
    for a, b in spans or ():
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


@F.arrow_udf(T.StringType())
def _left_sha256(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(_left(t, spans[a + k].as_py())).hexdigest() for a, _, texts in text_groups(text) for k, t in enumerate(texts)], pa.string())


@F.arrow_udf(T.StringType())
def _left_text(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([_left(t, spans[a + k].as_py()).decode("utf-8", "ignore") for a, _, texts in text_groups(text) for k, t in enumerate(texts)], pa.string())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with what is left of their texts; a character cut in two is left out. n_chars, if there is one, is counted anew where the text changed."""
    found = with_spans(docs, id_col, text_col)
    text = F.when(F.col("spans").isNull(), F.decode("text", "utf-8")).otherwise(_left_text("text", "spans"))
    columns = {c: F.col("row").getField(c).alias(c) for c in docs.columns if c != text_col}
    found = found.select("row", "spans", text.alias("left"))
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("left")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*(F.col("left").alias(c) if c == text_col else columns[c] for c in docs.columns))


def op3_suffix_dedup(spark, sf_dir):
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0]), F.lit(0).cast("long"))
    sha = F.when(F.col("spans").isNull(), F.sha2("text", 256)).otherwise(_left_sha256("text", "spans"))
    return found.select("row.doc_id", F.octet_length("text").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), sha.alias("kept_sha256"))
