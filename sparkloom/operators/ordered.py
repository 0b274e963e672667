"""Operators on sequences: matches with offsets, first and last wins, ordered distinct lists, carry-forward, budgets.

Tables have explicit order columns; nothing here depends on how rows are partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_ONE = "\x01"
_LOCATED = "array<struct<at:int,m:string>>"


def _mark(text: Column) -> Column:
    """A string that the text does not hold, and that no end of the text can complete: more U+0001 than it has in a row, and U+0002."""
    runs = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"{_ONE}+"), 0), F.length))
    return F.when(text.contains(_ONE), F.concat(F.repeat(F.lit(_ONE), runs + 1), F.lit("\x02"))).otherwise(_ONE)


def _parts(text: Column, pattern: str) -> Column:
    """The text cut around all matches, in one search: what lies between at even places, matches at odd ones."""
    return bound(_mark(text), lambda mark: F.split(F.regexp_replace(text, F.lit(pattern), F.concat(mark, F.lit("$0"), mark)), mark, -1))


def bound(value: Column, then) -> Column:
    """then(value) with the value computed once, however often it is named: in a lambda a column's expression would be computed anew each time."""
    return F.get(F.transform(F.array(value), then), 0)


#: Parts up to which each match's offset is summed by itself, and up to which a list is folded at once.
FEW_PARTS, ONE_BLOCK = 9, 64


def _located(parts: Column) -> Column:
    """[(at, m)] of the matches with their 0-based offsets.

    A list that grows in a fold is copied at each step, so parts are folded in blocks of about the root of their number, each from the
    place where it starts: 20,000 matches take some millions of steps, not hundreds of millions. Few parts are one block, and for the fewest,
    as most texts have them, no list grows at all.
    """
    none = F.array().cast(_LOCATED)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        found = F.when(acc["odd"], F.concat(acc["all"], F.array(F.struct(acc["at"].alias("at"), x.alias("m"))))).otherwise(acc["all"])
        return F.struct((acc["at"] + F.length(x)).alias("at"), (~acc["odd"]).alias("odd"), found.alias("all"))

    def of(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), F.lit(False).alias("odd"), none.alias("all")), step)["all"]

    def few(p: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(p, F.lit(1), i), F.lit(0), lambda n, x: n + F.length(x))
        found = F.transform(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), lambda i: F.struct(before(i).alias("at"), F.get(p, i).alias("m")))
        return F.when(F.size(p) > 1, found).otherwise(none)

    def cut(p: Column) -> Column:
        size = F.greatest(F.lit(2), F.ceil(F.sqrt(F.size(p)) / 2).cast("int") * 2)  # even, so that each block starts between matches
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda b: F.slice(p, b * size + 1, size))

    def located(blocks: Column) -> Column:
        long = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x)))
        starts = F.aggregate(long, first, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")))["all"]
        return F.flatten(F.zip_with(blocks, starts, of))

    return bound(parts, lambda p: F.when(F.size(p) <= FEW_PARTS, few(p)).when(F.size(p) <= ONE_BLOCK, of(p, F.lit(0))).otherwise(bound(cut(p), located)))


def match_offsets(text: Column, pattern: str) -> Column:
    return F.transform(_located(_parts(text, pattern)), lambda x: x["at"])


#: Matches up to which each is looked for as a plain string.
FEW_MATCHES = 3


def _found(text: Column, own: Column, pattern: str) -> Column:
    """[(at, m)] of a text's matches, own: their strings in order.

    A match is the first place behind the match before it where its string stands, as a pattern that does not look around would have matched there. So few
    matches are found as plain strings, without folds; where one is not (bytes that are no UTF-8), and for many matches, the text is cut around them.
    """
    places: list[Column] = []
    out = F.when(F.size(own) == 0, F.array().cast(_LOCATED))
    for k in range(FEW_MATCHES):
        places.append(F.position(F.get(own, k), text, places[-1] + F.length(F.get(own, k - 1)) if k else F.lit(1)))
        few = F.array(*(F.struct((at - 1).alias("at"), F.get(own, i).alias("m")) for i, at in enumerate(places))).cast(_LOCATED)
        out = out.when((F.size(own) == k + 1) & reduce(lambda a, b: a & b, (at > 0 for at in places)), few)
    return out.when(F.size(own) > 0, _located(_parts(text, pattern))).otherwise(F.array().cast(_LOCATED))


def matches(df: DataFrame, text: str, patterns: str | list[str], groups: dict[str, int], *keep: str, windows: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """A row for each match: keep columns, pattern (its number), match_seq, pos, a column for each group, and one for each window around.

    Each pattern's text is searched once, and once more where it has many matches; groups are taken from the match alone, so a pattern must not look
    around, nor match the empty string. Windows (characters before and behind a match's start) are taken in the row, so the text is not carried on.
    What is computed is tested only behind the explode, and that is an outer one: a filter of a computed column, as an explode brings one
    along, would be pushed below and compute it once more.
    """
    patterns = [patterns] if isinstance(patterns, str) else patterns
    cut = df.select(*keep, text, *(F.regexp_extract_all(text, F.lit(p), 0).alias(f"_m{k}") for k, p in enumerate(patterns)))
    cut = cut.select(*keep, text, *(_found(F.col(text), F.col(f"_m{k}"), p).alias(f"_p{k}") for k, p in enumerate(patterns)))

    def entry(k: int):
        def of(x: Column, i: Column) -> Column:
            near = (around(F.col(text), x["at"], *span).alias(name) for name, span in (windows or {}).items())
            return F.struct(F.lit(k).alias("pattern"), i.alias("match_seq"), x["at"].alias("pos"), x["m"].alias("m"), *near)

        return of

    found = F.concat(*(F.transform(f"_p{k}", entry(k)) for k in range(len(patterns))))
    hits = cut.select(*keep, F.explode_outer(found).alias("x")).where("x is not null")

    def group(g: int) -> Column:
        own = [F.col("x.m") if g == 0 else F.regexp_extract("x.m", p, g) for p in patterns]
        return reduce(lambda rest, k: F.when(F.col("x.pattern") == k, own[k]).otherwise(rest), range(len(own) - 1), own[-1])

    return hits.select(*keep, "x.pattern", "x.match_seq", "x.pos", *(group(g).alias(name) for name, g in groups.items()), *(F.col(f"x.{name}") for name in windows or {}))


def around(text: Column, pos: Column, before: int, after: int) -> Column:
    """text from before characters ahead of pos up to after characters behind it."""
    start = F.greatest(pos - before, F.lit(0))
    return F.substring(text, start + 1, pos + after - start)


def first_wins(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, by: list[str], value: str, order: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.max_by(value, order).alias(value))


def cap(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, numbered."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def ordered_list(order: Column, value: Column, condition: Column | None = None) -> Column:
    """Aggregate: values in order. The order is sorted, never taken from how rows arrive."""
    entry = F.struct(order.alias("o"), value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(entry if condition is None else F.when(condition, entry))), lambda x: x["v"])


@dataclass(frozen=True)
class Listed:
    """A list that a group is to have: the first n entries of values (an array for each row) in order, once each if distinct; all for n None."""

    order: Column
    values: Column
    n: int | None
    distinct: bool = True


def capped_lists(df: DataFrame, by: list[str], lists: dict[str, Listed], *more: Column) -> DataFrame:
    """by, a column for each list, and more aggregates: a row for each group, also for one whose lists are all empty.

    No group is gathered before it is cut. Entries become rows; each distinct one keeps its least place, a number, so that it is hashed and combined
    before the shuffle; places are ranked within a group's list, and only those within n are gathered. Nulls and empty values are left out. Lists with and
    without a cap are exploded apart, so that what a list takes is computed once.
    """
    def entries(k: int, asked: Listed) -> Column:
        at = asked.order.cast("long")
        rows = F.transform(asked.values, lambda v, i: F.struct(F.lit(k).alias("k"), v.alias("v"), at.alias("o"), i.cast("int").alias("i"), F.when(F.lit(not asked.distinct), at).alias("u")))
        return F.coalesce(F.filter(rows, lambda x: x["v"].isNotNull() & (x["v"] != "")).cast(kind), F.array().cast(kind))

    kind = "array<struct<k:int,v:string,o:bigint,i:int,u:bigint>>"
    group = F.array(F.struct(F.lit(-1), F.lit(""), F.lit(0).cast("long"), F.lit(0), F.lit(None).cast("long"))).cast(kind)

    def firsts(some: dict[int, Listed]) -> DataFrame:
        """A row for each entry with its least place; one that says that the group exists where a row of df has no entry."""
        found = bound(F.concat(*(entries(k, asked) for k, asked in some.items())), lambda x: F.when(F.size(x) == 0, group).otherwise(x))
        rows = df.select(*by, F.explode_outer(found).alias("x")).select(*by, "x.k", "x.v", "x.u", (F.col("x.o").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("x.i").cast("decimal(10,0)")).alias("at"))
        return rows.groupBy(*by, "k", "v", "u").agg(F.min("at").alias("at"))

    cut = {k: asked for k, asked in enumerate(lists.values()) if asked.n is not None}
    whole = {k: asked for k, asked in enumerate(lists.values()) if asked.n is None}
    parts = [firsts(whole).withColumn("rank", F.lit(0))] if whole else []
    if cut:
        first = Window.partitionBy(*by, "k").orderBy("at", "v")
        parts.append(firsts(cut).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= max(asked.n for asked in cut.values())))
    few = reduce(DataFrame.unionByName, parts)
    within = lambda k, n: (F.col("k") == k) & (F.lit(True) if n is None else F.col("rank") <= n)
    sorted_ = lambda k, n: F.transform(F.array_sort(F.collect_list(F.when(within(k, n), F.struct("at", "v")))), lambda x: x["v"])
    out = few.groupBy(*by).agg(*(sorted_(k, asked.n).alias(name) for k, (name, asked) in enumerate(lists.items())))
    return out if not more else out.join(df.groupBy(*by).agg(*more), by)


def running(df: DataFrame, by: list[str], part: Column, order: list[Column], counts: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, numbers: str | None = None) -> DataFrame:
    """df with running columns over each group's rows in order, of which part is a coarse first key (rows in order have rising parts).

    counts: how many earlier rows have a flag; lasts: the last value that is not null, up to and with the row; numbers: the row's number,
    from 1. Each part is scanned by itself, and what the parts before it hold is added, so a group of any size is as many tasks as it has parts. Only a row
    for each part meets in one window. df is read twice, so pass a written table.
    """
    counts, lasts = counts or {}, lasts or {}
    flags = {f"_c{k}": F.coalesce(flag.cast("long"), F.lit(0)) for k, flag in enumerate(counts.values())} | ({"_n": F.lit(1).cast("long")} if numbers else {})
    values = {f"_v{k}": v for k, v in enumerate(lasts.values())}
    base = df.withColumns({"_part": part, **flags, **values}).repartition(*by, "_part")
    at = F.struct(*order)
    sums = base.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"{c}t") for c in flags), *(F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(f"{v}t") for v in values))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(*by, "_part", *(F.coalesce(F.sum(f"{c}t").over(before), F.lit(0)).alias(f"{c}b") for c in flags), *(F.last(f"{v}t", ignorenulls=True).over(before).alias(f"{v}b") for v in values))
    own = Window.partitionBy(*by, "_part").orderBy(*order)
    ahead, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base.withColumns({**{f"{c}o": F.coalesce(F.sum(c).over(ahead), F.lit(0)) for c in flags}, **{f"{v}o": F.last(v, ignorenulls=True).over(so_far) for v in values}})
    keys = [*by, "_part"]
    met = local.join(heads.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), *(c for c in heads.columns if c not in keys)), reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys))))
    named = {name: F.col(f"_c{k}o") + F.col(f"_c{k}b") for k, name in enumerate(counts)} | {name: F.coalesce(f"_v{k}o", f"_v{k}b") for k, name in enumerate(lasts)}
    if numbers:
        named[numbers] = F.col("_no") + F.col("_nb") + 1
    return met.select(*(c for c in df.columns if c not in named), *(c.alias(name) for name, c in named.items()))
