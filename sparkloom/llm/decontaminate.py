"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Texts and items are lower-cased (A-Z) and split into runs of ASCII letters, digits and bytes from 0x80, so
one table maps byte to byte and every offset in the normalised text is an offset in the original. Words are
numbered and coded in few letters: each item of 13 words or more is cut in whole blocks of 7, of which every
window of 13 holds one, and the first ``PART`` words of a block are a pattern; shorter items are patterns themselves. So the
automaton has at most 2 nodes for each word of a long item, not 13 for each byte. A single scan of a text's words finds the
patterns; from each the words before and behind are compared with the item's, and if 13 in a row are equal, all that
are equal hold windows of the item.

The items are read once to the driver and broadcast as normalised text; every worker builds the automaton once.
``MOST_BYTES`` bounds them, checked before they are read: a larger benchmark is an error, never cut. A worker holds some
20 bytes for each byte of the items.

Defined cases: a null or empty text has no words and is clean; items without words are ignored; items with
equal windows are all reported; an item without an id marks words and counts as one item, whose id is null, last among the
items, and left out of ``items_sha256``; repeated rows are judged alike; empty tables give empty results or no hits.
Only the text column is read, columns of other names pass through, the one named like the result is replaced.
"""

from __future__ import annotations

import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import table, unused
from sparkloom.llm.texthash import text_groups

WINDOW = 13
#: Bytes of all items' texts together that a broadcast may have.
MOST_BYTES = 64_000_000
#: Words of a block that the automaton holds.
PART = 4
#: Automata that a worker keeps, of queries that ran in it.
HELD = 2
#: Word bytes stay, A-Z in lower case; all others become spaces.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])
ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64())))])

_automata: dict = {}


class Scanner:
    """The automaton of some items: [(item id as text or None, normalised text)]."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        import ahocorasick

        self.window, self.block = window, (window + 1) // 2
        part = min(PART, self.block)
        vocabulary: dict[bytes, int] = {}
        for _, text in items:
            for w in text.split():
                vocabulary.setdefault(w, len(vocabulary))
        # a word is a letter of 64 to 127 and others below, so that patterns start where words do and nodes have few ways on
        self.width = 3 if len(vocabulary) <= 64**3 else 4
        self.code = {w: bytes(((k == 0) << 6) | (n >> 6 * (self.width - 1 - k) & 63) for k in range(self.width)) for w, n in vocabulary.items()}
        self.unknown = b"\x80" * self.width
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        ids: dict[str | None, int] = {}
        named: dict[bytes, int] = {}
        coded, ends, owner, lengths = [], array("q"), array("l"), array("b")
        places, short, of, which_ = array("q"), array("b"), array("l"), array("l")
        at = 0
        for item, text in items:
            row = b"".join(map(self.code.__getitem__, text.split()))
            n = len(row) // self.width
            for k in range(0, n - self.block + 1, self.block) if n >= window else range(min(n, 1)):
                size = part if n >= window else n
                pattern = row[k * self.width : (k + size) * self.width]
                which = named.setdefault(pattern, len(named))
                if which == len(lengths):
                    lengths.append(size)
                    automaton.add_word(pattern.decode("latin-1"), which)
                for column, value in ((which_, which), (places, at + k), (of, len(ends)), (short, n < window)):
                    column.append(value)
            coded.append(row)
            at += n
            ends.append(at)
            owner.append(ids.setdefault(item, len(ids)))
        self.flat = self._numbers(b"".join(coded))
        self.ids, self.lengths, self.ends, self.owner = list(ids), lengths, np.array(ends, np.int64), np.array(owner, np.int64)
        self.starts = np.concatenate(([0], self.ends))[:-1]
        # by pattern: where it lies in flat, in which item, and whether it is a whole short item
        which_ = np.array(which_, np.int64)
        order = np.argsort(which_, kind="stable")
        self.bounds = np.searchsorted(which_[order], np.arange(len(lengths) + 1))
        self.place, self.item, self.short = np.array(places, np.int64)[order], np.array(of, np.int64)[order], np.array(short, bool)[order]
        self.automaton = automaton if named else None
        if named:
            automaton.make_automaton()

    def _numbers(self, coded: bytes) -> np.ndarray:
        """The words of a coded text as numbers."""
        letters = np.frombuffer(coded, np.uint8).reshape(-1, self.width).astype(np.int32)
        return sum(letters[:, k] << 8 * k for k in range(1, self.width)) + letters[:, 0]

    def _found(self, numbers: np.ndarray, end: int, which: int):
        """(first word, word behind the last, item) of what is equal around a pattern that ends at end, for each place in the items that holds windows there."""
        n = self.lengths[which]
        begin = end + 1 - n
        at, item, short = (x[self.bounds[which] : self.bounds[which + 1]] for x in (self.place, self.item, self.short))
        for k in np.unique(item[short]):
            yield begin, end + 1, k
        at, item = at[~short], item[~short]
        if not len(at):
            return
        before, behind = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        # a window that holds the whole block starts and ends within these
        for side, run, reach in ((-1, before, self.window - self.block), (1, behind, self.window - n)):
            alive = np.arange(len(at))
            for d in range(1, reach + 1):
                here = begin - d if side < 0 else end + d
                there = at[alive] - d if side < 0 else at[alive] + n - 1 + d
                if here < 0 or here >= len(numbers):
                    break
                inside = there >= self.starts[item[alive]] if side < 0 else there < self.ends[item[alive]]
                alive, there = alive[inside], there[inside]
                same = self.flat[there] == numbers[here]
                alive = alive[same]
                if not len(alive):
                    break
                run[alive] = d
        for k in np.flatnonzero(before + behind + n >= self.window):
            yield begin - int(before[k]), end + 1 + int(behind[k]), item[k]

    def scan(self, text: bytes) -> tuple[int, int, list[str | None], list[list[int]]]:
        """Words, words hit, items found in order of their ids as text, and the hit runs as (start, end) code points of the original."""
        normal = text.translate(NORMAL)
        words = normal.split()
        if self.automaton is None or not words:
            return len(words), 0, [], []
        unknown = self.unknown
        coded = b"".join([self.code.get(w, unknown) for w in words])
        matches = list(self.automaton.iter(coded.decode("latin-1")))
        if not matches:
            return len(words), 0, [], []
        row, change, items = self._numbers(coded), np.zeros(len(words) + 1, np.int64), set()
        for end, which in matches:
            for a, b, k in self._found(row, end // self.width, which):
                change[a] += 1
                change[b] -= 1
                items.add(int(self.owner[k]))
        hit = np.cumsum(change[:-1]) > 0
        if not items:
            return len(words), 0, [], []
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        at = [m.span() for m in re.finditer(rb"[^ ]+", normal)]
        points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        spans = [[int(points[at[a][0]]), int(points[at[b - 1][1]])] for a, b in edges.reshape(-1, 2)]
        named = [self.ids[k] for k in items]
        return len(words), int(hit.sum()), sorted(x for x in named if x is not None) + [None] * (None in named), spans


def _scan_udf(shared, window: int):
    key = uuid.uuid4().hex

    @F.arrow_udf(RESULT)
    def scan(texts: pa.Array) -> pa.Array:
        scanner = _automata.get(key)
        if scanner is None:
            while len(_automata) >= HELD:
                del _automata[next(iter(_automata))]
            scanner = _automata[key] = Scanner(shared.value, window)
        rows = [scanner.scan(t) for _, _, raw in text_groups(texts) for t in raw]
        return pa.array([dict(zip(("n_words", "n_hit", "items", "spans"), r, strict=True)) for r in rows], ARROW)

    return scan


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> list[tuple[str | None, bytes]]:
    """The items in normalised form."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the benchmark's texts take {size} bytes, more than MOST_BYTES = {MOST_BYTES}")
    rows = benchmark.select(F.col(item_col).cast("string"), text).toLocalIterator()
    return [(item, b" ".join(bytes(raw).translate(NORMAL).split())) for item, raw in rows]


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, name: str = "contamination") -> DataFrame:
    """docs with a struct column: n_words, n_hit, items (ids as text, in order), spans (hit runs, in code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(_items(benchmark, item_col, item_text))
    return docs.withColumn(name, _scan_udf(shared, window)(F.col(text_col)))


def is_contaminated(name: str = "contamination"):
    """At least one word hit, and at least a twentieth of all."""
    return (F.col(f"{name}.n_hit") > 0) & (F.col(f"{name}.n_hit") * 20 >= F.col(f"{name}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    (mark,) = unused(docs.columns, "contamination")
    return contamination(docs, benchmark, name=mark, **how).where(~is_contaminated(mark)).select(*docs.columns)


def op9_decontaminate(spark, sf_dir):
    docs = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = "contamination"
    return docs.select(
        "doc_id", f"{c}.n_words", f"{c}.n_hit", F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{c}.items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


#: Words by RE2 over code points: what the byte rule keeps are ASCII letters, digits and all beyond ASCII.
ORACLE = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win), place AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens WHERE len(w) >= n)
), found AS (
  SELECT doc_id, i, place.n, item_id FROM place JOIN win ON place.s = win.s AND place.n = win.n
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
