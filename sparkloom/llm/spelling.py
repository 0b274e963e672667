"""Groups of spelling variants: all pairs of words one edit apart, by a positional q-gram index with a count filter.

Words are counted in each task before they are shuffled. A word's bigrams are ordered from the rarest to the most common (numbers of
bigrams, at most the square of the alphabet, are all that the driver gathers). One inserted, deleted or replaced character
touches two bigrams of the longer word, or of both if they are of one length, and one of the shorter word; what is left keeps its order and its place, or
moves by one behind an insertion. So the first bigram that both words keep is among the first three, or two, of each, and near words meet
under its key: (length of the longer, bigram, place). A key is a piece of the inverted index that one task holds.

Within a piece the words' first ``GRAMS`` bigrams are posted under (bigram, place). For each word the postings at its bigrams' places, and one
place on for the shorter words, are needed: those of its rarest bigrams there are merged by a heap, the longer ones only looked up, and words that
share as many as one edit leaves (the count filter) are compared.

A piece of more than ``MOST`` words is divided, however common its bigram: its words go on to keys of two kept bigrams, then three, and so on, each
the next in order of which at most two, or one, are passed over. Words under a key of as many bigrams as one edit leaves differ in one place
only, so the dividing ends. No pair is lost on the way, and pairs that meet twice are made one.

Roots are found by doubling: in each round a word's root becomes its root's root. A form is at least twice as frequent as its word, so there are no
circles, and rounds grow as the logarithm of the longest chain.

Defined cases: a null text has no words; a null id stands as the empty text where ids matter; rows that repeat an id are
counted each; forms of equal number are taken in code-point order; very long words are words; an empty table gives an empty result. Only the id and
the text are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import Workspace, table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_CHARS, LEAST_COUNT, SPOILED = 5, 3, 97
#: Bigrams of a word that are posted and merged; longer words are told apart by these and compared in full.
GRAMS = 32
#: Words that one piece of the index holds before it is divided, and words counted in a task before they are passed on.
MOST, HELD = 500, 300_000
_PRIME, _BITS = 0x9E3779B97F4A7C15, 2**63 - 1
ROWS = "key long, shorter boolean, word string, n long, path array<int>"
_ROWS = pa.schema([("key", pa.int64()), ("shorter", pa.bool_()), ("word", pa.string()), ("n", pa.int64()), ("path", pa.list_(pa.int32()))])
PAIRS = "a string, a_n long, b string, b_n long"
_PAIRS = pa.schema([("a", pa.string()), ("a_n", pa.int64()), ("b", pa.string()), ("b_n", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def runs(doc: object, text: str, least: int = LEAST_CHARS, spoiled: int | None = SPOILED) -> Iterator[tuple[str, int]]:
    """Words of a text and how often they stand there. spoiled: of so many, one loses a character, by a checksum of id and word."""
    head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # of bytes, lower() changes A-Z only
        if spoiled:
            h = zlib.crc32(word.encode(), head)
            if not h % spoiled:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            yield word, n


def _counter(least: int, spoiled: int | None):
    def count(batches):
        schema, held = pa.schema([("word", pa.string()), ("n", pa.int64())]), {}
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):  # one text is held at a time
                for word, n in runs(doc, text.as_py() or "", least, spoiled):
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield _batch(list(held.items()), schema)
                    held = {}
        yield _batch(list(held.items()), schema)

    return count


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, spoiled: int | None = None) -> DataFrame:
    """(word, n): lower-cased runs of letters with their numbers over all texts."""
    found = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(_counter(least_chars, spoiled), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _grams(batches):
    held: Counter = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            held.update(map("".join, zip(word, word[1:], strict=False)))
    yield _batch(list(held.items()), pa.schema([("gram", pa.string()), ("c", pa.int64())]))


def ordered(word: str, rank: dict[str, int]) -> list[int]:
    """A word's bigrams, rarest first, as rank and place in one number."""
    return sorted(rank[word[i : i + 2]] << 32 | i for i in range(len(word) - 1))


def _key(key: int, code: int) -> int:
    return ((key ^ code) * _PRIME + (key >> 29)) & _BITS


def _kept(word: str, shorter: bool) -> int:
    """Bigrams of a word that one edit leaves at least."""
    return len(word) - 1 - (1 if shorter else 2)


def further(key: int, path: list[int], shorter: bool, codes: list[int]) -> Iterator[tuple[int, list[int]]]:
    """Keys of one more kept bigram: (key, path). path: for each bigram so far its number in order, doubled, plus one if it stands one place on."""
    last = path[-1] // 2 if path else -1
    passed = last + 1 - len(path)
    for k in range(last + 1, min(len(codes), last + 2 + (1 if shorter else 2) - passed)):
        at = codes[k] & 0xFFFFFFFF
        for move in (0, 1) if shorter else (0,):
            # an insertion moves all behind it and nothing before it
            if all(move >= p % 2 if codes[p // 2] & 0xFFFFFFFF < at else move <= p % 2 for p in path):
                yield _key(key, codes[k] + move), [*path, 2 * k + move]


def _first_keys(rank: dict[str, int]):
    def keys(batches):
        for batch in batches:
            rows = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = ordered(word, rank)
                for shorter in (False, True):
                    rows += [(key, shorter, word, n, path) for key, path in further((len(word) + shorter) * _PRIME & _BITS, [], shorter, codes)]
            yield _batch(rows, _ROWS)

    return keys


def _next_keys(rank: dict[str, int]):
    def keys(batches):
        for batch in batches:
            rows = []
            for key, shorter, word, n, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(k, shorter, word, n, p) for k, p in further(key, path, shorter, ordered(word, rank))]
                if len(rows) > 20_000:
                    yield _batch(rows, _ROWS)
                    rows = []
            yield _batch(rows, _ROWS)

    return keys


def one_edit(a: str, b: str) -> bool:
    """Whether b, no shorter than a, is a with exactly one character inserted or replaced."""
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :] and a != b


def _met(grams: list[list[list[int]]], least: int, first: int = 0) -> Iterator[int]:
    """Numbers from first on that at least so many bigrams have in one of their sorted postings.

    Such a number is in the postings of one of the len(grams) - least + 1 bigrams that have the fewest: these are merged by a heap, and what they
    bring is looked up in the others until it has enough or cannot get there.
    """
    grams.sort(key=lambda lists: sum(map(len, lists)))
    few = len(grams) - least + 1
    merged = heapq.merge(*(p[bisect.bisect_left(p, first) :] for lists in grams[:few] for p in lists))
    last = -1
    for j in merged:
        if j == last:
            continue
        last, missed = j, 0
        for lists in grams:
            for p in lists:
                at = bisect.bisect_left(p, j)
                if at < len(p) and p[at] == j:
                    break
            else:
                missed += 1
                if missed == few:
                    break
        else:
            yield j


def near_in_piece(shorter: list[bool], words: list[str], ns: list[int], rank: dict[str, int]) -> Iterator[tuple[str, int, str, int]]:
    """Near pairs of one piece of the index: words of one length with each other, and shorter ones with them."""
    index = sorted((w, n) for s, w, n in zip(shorter, words, ns, strict=True) if not s)
    codes = [ordered(w, rank)[: GRAMS + 2] for w, _ in index]
    postings: dict[int, list[int]] = {}
    for j, known in enumerate(codes):
        for code in known:
            postings.setdefault(code, []).append(j)
    for j, (a, n) in enumerate(index):
        grams, missed = [], 0
        for code in codes[j][:GRAMS]:
            p = postings[code]
            if p[-1] == j and (missed := missed + 1) > 2:  # none behind this word; a near one shares all but two
                break
            grams.append([p])
        else:
            yield from ((a, n, *index[k]) for k in _met(grams, len(grams) - 2, j + 1) if one_edit(a, index[k][0]))
    known = postings.get
    for s, a, n in zip(shorter, words, ns, strict=True):
        if s:
            grams, missed = [], 0
            for code in ordered(a, rank)[:GRAMS]:
                p, q = known(code), known(code + 1)
                if p is None and q is None and (missed := missed + 1) > 1:  # a near word shares all but one
                    break
                grams.append([x for x in (p, q) if x])
            else:
                yield from ((a, n, *index[k]) for k in _met(grams, len(grams) - 1) if one_edit(a, index[k][0]))


def _pairs(rank: dict[str, int]):
    """Pieces of rows sorted by key to their pairs; a piece may lie over several batches."""

    def pairs(batches):
        rest = None
        for batch in batches:
            rows = batch if rest is None else pa.concat_batches([rest, batch])
            keys = rows.column("key").to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1
            whole = int(edges[-1]) if len(edges) else 0
            rest = rows.slice(whole)
            yield found(rows.slice(0, whole), edges[:-1] if len(edges) else edges)
        if rest is not None:
            yield found(rest, np.zeros(0, np.int64))

    def found(rows, edges):
        columns = [rows.column(c).to_pylist() for c in ("shorter", "word", "n")]
        bounds = [0, *edges.tolist(), rows.num_rows]
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1 and not all(columns[0][a:b]):
                out += near_in_piece(*(c[a:b] for c in columns), rank)
        return _batch(out, _PAIRS)

    return pairs


def near_pairs(work: Workspace, words: DataFrame, most: int = MOST) -> DataFrame:
    """(a, a_n, b, b_n), each pair of words one edit apart once. words: (word, n), each word once, of five characters or more."""
    counted = words.select("word").mapInArrow(_grams, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c")).collect()  # the alphabet squared at most
    rank = {g: k for k, (_, g) in enumerate(sorted((r["c"], r["gram"]) for r in counted))}
    rows = work.keep(words.select("word", "n").mapInArrow(_first_keys(rank), ROWS), "keys")
    found = []
    while True:
        length = F.length("word") + F.col("shorter").cast("int")
        open_ = F.size("path") < F.greatest(length - 3, F.lit(1))
        large = work.keep(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(open_).alias("open")).where((F.col("c") > most) & F.col("open")).select("key"), "large")
        more = not large.isEmpty()
        small = rows.join(large, "key", "left_anti") if more else rows
        pieces = small.select("key", "shorter", "word", "n").repartition("key").sortWithinPartitions("key")
        found.append(work.keep(pieces.mapInArrow(_pairs(rank), PAIRS).distinct(), "pairs"))
        if not more:
            break
        divided = work.keep(rows.join(large, "key", "left_semi").select("key", "shorter", "word", "n", "path").mapInArrow(_next_keys(rank), ROWS), "keys")
        work.drop(rows, large)
        rows = divided
    work.drop(rows, large)
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out.distinct() if len(found) > 1 else out


def roots(work: Workspace, forms: DataFrame) -> DataFrame:
    """(word, form) links without circles to (word, root), the last word of each chain."""
    now = work.keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = work.keep(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        work.drop(now)
        now = step
        if step.where("moved").isEmpty():
            return now.drop("moved")


def variants(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n) to a row for each word: word, form, root, n, n_near, form_n."""
    work = Workspace(words.sparkSession, "spelling")
    words = work.keep(words, "words")
    pairs = near_pairs(work, words, most)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("n")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "near")).alias("best"))
    takes = -F.col("best.n") >= 2 * F.col("n")
    facts = work.keep(words.join(best, "word", "left").select("word", F.when(takes, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, -F.col("best.n")).alias("form_n")), "facts")
    ends = roots(work, facts.where("form is not null"))
    return facts.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark, sf_dir):
    return variants(count_words(table(spark, sf_dir, "documents"), spoiled=SPOILED))


#: Near words share a word, or a word less one character: of one length at the same place.
ORACLE = f"""
WITH RECURSIVE tables AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents
), counted AS (
  SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM counted, tables
), spoiled AS (
  SELECT CASE WHEN h % {SPOILED} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM spoiled WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, range(1000) r(i) WHERE i < length(word)
), pairs AS MATERIALIZED (
  SELECT DISTINCT a.word AS word, b.word AS near, b.n AS n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY word
), facts AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, form AS at FROM facts WHERE form IS NOT NULL
  UNION ALL SELECT chain.word, facts.form FROM chain JOIN facts ON facts.word = chain.at WHERE facts.form IS NOT NULL
), ends AS (
  SELECT chain.word, chain.at AS root FROM chain JOIN facts ON facts.word = chain.at WHERE facts.form IS NULL
)
SELECT facts.word, form, coalesce(root, facts.word) AS root, n, n_near, form_n FROM facts LEFT JOIN ends ON ends.word = facts.word
"""
