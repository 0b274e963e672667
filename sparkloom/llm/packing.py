"""Best-fit packing of tokenized documents into sequences, planned on a histogram of lengths.

Every document's token ids, with an end id behind, are cut from the back into pieces of at most ``size``, so only a document's first piece may be
short. The driver sees how many pieces there are of each length, ``size`` numbers at most. Best-fit decreasing runs
over these counts: of all open sequences those with the least room that is enough take as many pieces of the length as they hold, all
sequences of one history at once. The plan is a short list of arithmetic rules: pieces of a length with ranks in a range
go, so many to a sequence, to consecutive sequences at an offset. Pieces then take their places by a join on their rank within
their length.

Ranks need no sort and no window over pieces: a task numbers its pieces of each length as it makes them, and what the tasks before it have of
the length is a prefix sum over (length, task) counts. So the most frequent length is spread over as many tasks as wrote it.

Texts are tokenized whole. A text is cut where one space stands between two characters that are not white space, since the tokenizer's own
pattern always starts a token there; each distinct word is tokenized once in a task and its ids are reused as bytes, which is
several times faster than handing over whole texts and gives the same ids (a test compares them).

Defined cases: a null text is empty, an empty text is the end id alone; rows that repeat an id are documents each; a null id stays null; an
empty table gives an empty result. Only the id and the text are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import bisect
import functools
import re
import sys
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace, table
from sparkloom.llm.texthash import groups

SIZE, END = 1024, 2
TOKENIZER = "byte_bpe_50k.json"
#: One space between characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Within a word, places where the pattern always starts a token too: behind a letter before one of these signs, and behind a single end of line.
STEM = re.compile(r"(?<=[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF])(?=[.,;:!?])|(?<=\S\n)(?=[A-Za-z])")
#: Words up to so many characters are remembered, twice so many of them at most; a long text is cut to words so many characters at a time, and
#: short ones are handled so many bytes together.
WORD_CHARS, MEMORY, CHUNK, GROUP = 48, 600_000, 1_000_000, 6_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, k long"
PLAN = "length long, first long, last long, per long, sequence long, place long"


def public_tokenizer(name: str = TOKENIZER) -> str:
    """The place of one of the installed public tokenizers' files, found where the task runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A word that the pattern leaves whole and that holds no special token.
LETTERS = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")


def _odd(word: str) -> bool:
    """Whether a text must not be cut at the spaces around this word."""
    return not word or word[0].isspace() or word[-1].isspace()


def byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte: itself, or the next one from 256 on where it is no printable sign of Latin-1."""
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 256 and b != 173]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in {*shown})}


class Tokens:
    """Token ids of texts as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.signs = self.tokenizer.model.tokenize, byte_signs()
        # words by what stands before them, those of late and those before; what was not met in between is forgotten
        self.known: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {"": ({}, {}), " ": ({}, {})}

    def _whole(self, word: str, lead: str) -> bytes:
        if LETTERS.fullmatch(word):
            ids = array("I", [t.id for t in self.merge((lead + word).encode().decode("latin-1").translate(self.signs))])
        else:
            ids = array("I", self.tokenizer.encode(lead + word, add_special_tokens=False).ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _word(self, word: str, lead: str) -> bytes:
        """Ids of an unknown word: a stem and what follows it, which more words share."""
        stem, *rest = STEM.split(word)
        if not rest:
            return self._whole(word, lead)
        return b"".join([*self._words([stem], lead), *self._words(rest, "")])

    def _words(self, words: list[str], lead: str, odd: list[int] | None = None) -> list[bytes]:
        """Ids of words; odd gets the numbers of odd ones, which are never remembered."""
        late, before = self.known[lead]
        out = list(map(late.get, words))
        if None in out:
            if len(late) > MEMORY:
                self.known[lead] = late, before = {}, late
            for k, word in enumerate(words):
                if out[k] is None:
                    out[k] = late.get(word) or before.get(word) or self._word(word, lead)
                    if _odd(word):
                        if odd is not None:
                            odd.append(k)
                    elif len(word) <= WORD_CHARS:
                        late[word] = out[k]
        return out

    def __call__(self, text: str) -> bytes:
        """One text, a chunk at a time."""
        out, at = [], 0
        while at < len(text):
            cut = CUT.search(text, at + CHUNK)
            words = CUT.split(text[at : cut.start() if cut else len(text)])
            if not at:
                out += self._words(words[:1], "")
                words = words[1:]
            out += self._words(words, " ")
            at = cut.end() if cut else len(text)
        return b"".join(out)

    def together(self, texts: pa.Array) -> Iterator[bytes]:
        """Texts of a few MB, none empty: each different word is looked up once, and ids are gathered by number."""
        parts = pc.split_pattern(texts, " ")
        at = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        words = parts.flatten().dictionary_encode()
        number, known = words.indices.to_numpy().copy(), words.dictionary.to_pylist()
        heads, odd = number[at[:-1]], []
        ids = [*self._words(known, " ", odd), *self._words([known[k] for k in heads], "")]
        # words that are odd stand at spaces where a text must not be cut: such texts go by themselves
        alone = np.logical_or.reduceat(np.isin(number, odd), at[:-1]) if odd else np.zeros(len(texts), bool)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        flat = np.frombuffer(b"".join(ids), "<u4")
        number[at[:-1]] = len(known) + np.arange(len(heads))
        taken = sizes[number]
        ends = np.cumsum(taken)
        out = flat[np.repeat(starts[number] - (ends - taken), taken) + np.arange(ends[-1])]
        bounds = np.concatenate(([0], ends))[at]
        for k, single in enumerate(alone):
            yield self(texts[k].as_py()) if single else out[bounds[k] : bounds[k + 1]].tobytes()

    def all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text of a batch, null as empty."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for a, b in groups(sizes, GROUP):
            some = texts.slice(a, b - a)
            if b == a + 1:
                yield self(some[0].as_py() or "")
                continue
            full = np.flatnonzero(sizes[a:b])
            found = self.together(some.take(pa.array(full))) if len(full) else iter(())
            for n in sizes[a:b]:
                yield next(found) if n else b""


@functools.lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    """A worker keeps what it knows from one task to the next."""
    return Tokens(path)


def pieces(ids: bytes, size: int = SIZE) -> Iterator[tuple[int, bytes]]:
    """(start, ids) of a document's pieces: full ones from the back."""
    n = len(ids) // 4
    at = 0
    while at < n:
        end = at + ((n - at) % size or size)
        yield at, ids[4 * at : 4 * end]
        at = end


def _cutter(tokenizer, size: int, end: int, with_ids: bool):
    last = end.to_bytes(4, "little")

    def cut(batches):
        tokens = tokens_of(tokenizer() if callable(tokenizer) else tokenizer)
        task, ranks = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for doc, found in zip(batch.column(0), tokens.all(batch.column(1)), strict=True):
                rows = []
                for n, (at, ids) in enumerate(pieces(found + last, size)):
                    length = len(ids) // 4
                    rows.append((doc.as_py(), n, at, length, zlib.crc32(ids), task, ranks[length], *([ids] if with_ids else [])))
                    ranks[length] += 1
                yield rows

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("k", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def batches(source):
        held = []
        for rows in cut(source):
            held += rows
            if len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return batches


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best fit over counts, longest first: rules (length, first rank, last rank, per, sequence, place) and how many sequences there are.

    A piece with rank r from first to before last goes to sequence + (r - first) // per at place + (r - first) % per * length.
    """
    rules, made = [], 0
    room: dict[int, list[tuple[int, int]]] = {}  # (first, count) of open sequences by their room
    rooms: list[int] = []  # its keys, sorted

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            else:  # no open sequence is roomy enough
                left, first, n = size, made, -(-rest // (size // length))
                made += n
            per = left // length
            full = min(n, rest // per)
            if full:
                rules.append((length, rank, rank + full * per, per, first, size - left))
                put(left - per * length, first, full)
                rank, rest, first, n = rank + full * per, rest - full * per, first + full, n - full
            if n and rest and rest < per:
                rules.append((length, rank, rank + rest, rest, first, size - left))
                put(left - rest * length, first, 1)
                rest, first, n = 0, first + 1, n - 1
            put(left, first, n)
    return rules, made


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, tokenizer=public_tokenizer, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids in bytes if asked for.

    tokenizer: the path of a file that all executors have, or a function that gives it there.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_cutter(tokenizer, size, end, with_ids), PIECES + (", ids binary" if with_ids else ""))
    made = work.keep(made, "pieces")
    held = work.keep(made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "held")
    counts = {length: n for length, n in held.groupBy("length").agg(F.sum("n")).collect()}  # size rows at most
    rules = spark.createDataFrame(plan(counts, size)[0], PLAN)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("k"))
    placed = ranked.join(F.broadcast(rules), "length").where("rank >= first and rank < last")  # a few rules for each length, whatever the input
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("place") + nth % F.col("per") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with their ids to (sequence_id, ids, doc_ids): the training sequences themselves, of bounded length each."""
    row = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(row.alias("r")).select("sequence_id", F.array_join(F.transform("r.ids", F.hex), "").alias("x"), F.col("r.doc_id").alias("doc_ids")).select("sequence_id", F.unhex("x").alias("ids"), "doc_ids")


def op13_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
