"""String expressions: clipping, normalising, tokens, segments, estimates and renderings.

All are Catalyst expressions over columns. Lengths and offsets are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts in a browser see it: what Java's \s holds and further Unicode spaces.
WS_CHARS = r"\s   -     　﻿"
WS = f"[{WS_CHARS}]"
#: ASCII word boundaries, as Java's \b follows Unicode.
LEFT, RIGHT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def words_re(*alternatives: str) -> str:
    """Case-insensitive pattern of whole ASCII words."""
    return f"(?i){LEFT}(?:{'|'.join(alternatives)}){RIGHT}"


def quick(pattern: str) -> str:
    """A pattern of ``words_re`` that tells at each place by one character whether any of its words can begin there; other patterns as they are."""
    ahead = f"(?i){LEFT}(?:"
    if not pattern.startswith(ahead):
        return pattern
    first = "".join(sorted({word[0].lower() for word in pattern[len(ahead) : -len(RIGHT) - 1].split("|")}))
    return pattern.replace("(?i)", f"(?i)(?=[{first}])", 1)


def squeeze(text: Column) -> Column:
    """Runs of white space to one space, trimmed. A single space between visible ASCII is passed over, and other ASCII is told from white space by one range."""
    return F.trim(F.regexp_replace(text, f"(?=[^!-~])(?! [!-~]){WS}+", " "))


def clip(text: Column, n: int = 220) -> Column:
    return F.substring(squeeze(text), 1, n)


def clip_dots(text: Column, n: int = 300) -> Column:
    """Null-safe clip that marks a cut."""
    short = squeeze(F.coalesce(text, F.lit("")))
    return F.when(F.length(short) > n, F.concat(F.substring(short, 1, n), F.lit("…"))).otherwise(short)


def preview(text: Column, n: int = 1400) -> Column:
    plain = F.trim(F.regexp_replace(text, "\r\n", "\n"))
    return F.when(F.length(plain) > n, F.concat(F.substring(plain, 1, n), F.lit("\n…"))).otherwise(plain)


def normal_or_null(text: Column) -> Column:
    return F.nullif(squeeze(text), F.lit(""))


def content_of(formatted: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(formatted, F.lit("")), raw)


def rag_tokens(text: Column) -> Column:
    """Search tokens of the whole text: runs of two or more of letters, digits and _ $ . -, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_$.-]{2,})"), 1)


def report_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z_$][a-z0-9_$-]{2,})"), 1)


def segments(text: Column, size: int = 16384) -> Column:
    """Slices of size characters; none for an empty text."""
    n = F.ceil(F.length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def token_estimate(text: Column) -> Column:
    n = F.length(F.trim(text))
    return F.when(n > 0, F.greatest(F.lit(1), F.ceil(n / 4))).otherwise(F.lit(0)).cast("long")


def tokens_per_second(tokens: Column, ms: Column) -> Column:
    return F.when((tokens > 0) & (ms >= 250), F.round(tokens / (ms / 1000.0), 1))


def duration(ms: Column) -> Column:
    s = F.round(ms / 1000.0).cast("long")
    hours, minutes, seconds = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m")))
        .when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), seconds.cast("string"), F.lit("s")))
        .otherwise(F.concat(seconds.cast("string"), F.lit("s")))
    )


def remaining_ms(done: Column, total: Column, elapsed: Column) -> Column:
    return F.when((done > 0) & (done < total) & (elapsed > 0), F.round(elapsed / done * (total - done)).cast("long"))


def middle_truncate(text: Column, width: Column | int) -> Column:
    """At most width characters, with 70 % of what ``...`` leaves at the head."""
    width = F.lit(width) if isinstance(width, int) else width
    head = F.greatest(F.lit(1), F.ceil((width - 3) * 0.7).cast("int"))
    tail = F.greatest(F.lit(1), width - 3 - head)
    cut = F.concat(F.substring(text, F.lit(1), head), F.lit("..."), F.substring(text, F.length(text) - tail + 1, tail))
    return F.when(F.length(text) <= width, text).when(width <= 3, F.substring(text, F.lit(1), width)).otherwise(cut)


def strip_ansi(text: Column) -> Column:
    """Without the escape sequences of terminals."""
    return F.regexp_replace(text, "\x1B(?:[@-Z\\\\-_]|\\[[0-?]*[ -/]*[@-~])", "")


# Terminal widths from which a bar is so wide, and the letters of a bar.
BAR_WIDTHS, BAR_LEAST = ((140, 24), (110, 20), (90, 16)), 12
TERMINAL_LEAST, TERMINAL = 80, 120


def bar_width(terminal: Column) -> Column:
    out = F.lit(BAR_LEAST)
    for least, width in reversed(BAR_WIDTHS):
        out = F.when(terminal >= least, width).otherwise(out)
    return out


def progress_bar(done: Column, total: Column, width: Column | int = 24) -> Column:
    """``[====----] 50%``."""
    width = F.lit(width) if isinstance(width, int) else width
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / F.greatest(F.lit(1), total)))
    full = F.round(share * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("="), full), F.repeat(F.lit("-"), width - full), F.lit("] "), F.round(share * 100).cast("int").cast("string"), F.lit("%"))


def telemetry_suffix(tokens: Column, tps: Column, estimated: Column) -> Column:
    """`` [~12 tok 3.4 tps]``: reported tokens, else estimated ones; empty without either."""
    label = F.coalesce(F.concat(tokens.cast("string"), F.lit(" tok")), F.concat(F.lit("~"), estimated.cast("string"), F.lit(" tok")))
    rate = F.coalesce(F.concat(F.lit(" "), _number(tps), F.lit(" tps")), F.lit(""))
    return F.coalesce(F.concat(F.lit(" ["), label, rate, F.lit("]")), F.lit(""))


def _number(x: Column) -> Column:
    """As scripts print it: whole numbers without a point."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def _labels(state: Column, lane: Column, chunk: Column, chunks: Column) -> tuple[Column, Column, Column]:
    lane_label = F.coalesce(F.concat(F.lit("lane "), lane.cast("string"), F.lit(" ")), F.lit(""))
    state_label = F.when(state.isin("streaming", "completed"), state).otherwise("running")
    chunk_label = F.coalesce(F.concat(F.lit(" chunk "), chunk.cast("string"), F.lit("/"), chunks.cast("string")), F.lit(""))
    return lane_label, state_label, chunk_label


def progress_line(done: Column, total: Column, elapsed: Column, agent: Column, state: Column, url: Column, lane: Column, chunk: Column, chunks: Column, tokens: Column, estimated: Column, tps: Column, terminal: Column) -> Column:
    """One line for a terminal: what does not fit is left out from the end, and the URL is cut in its middle. Columns that may be unknown are null then."""
    wide = F.greatest(F.lit(TERMINAL_LEAST), F.coalesce(terminal, F.lit(TERMINAL)))
    lane_label, state_label, chunk_label = _labels(state, lane, chunk, chunks)
    prefix = F.concat(progress_bar(done, total, bar_width(wide)), F.lit(" "), lane_label, agent, F.lit(" agent "), state_label, F.lit(" "))
    told = telemetry_suffix(tokens, tps, estimated)
    eta = F.coalesce(F.concat(F.lit(" [eta "), duration(remaining_ms(done, total, elapsed)), F.lit("]")), F.lit(""))
    out = F.concat(prefix, middle_truncate(url, 8))
    for suffix in (F.lit(""), chunk_label, F.concat(chunk_label, told), F.concat(chunk_label, told, eta)):
        room = wide - F.length(prefix) - F.length(suffix)
        line = F.concat(prefix, middle_truncate(url, F.greatest(F.lit(1), room)), suffix)
        out = F.when(((room >= 4) | (F.length(suffix) == 0)) & (F.length(line) <= wide), line).otherwise(out)
    return out


def log_line(done: Column, total: Column, elapsed: Column, agent: Column, state: Column, url: Column, lane: Column, chunk: Column, chunks: Column, tokens: Column, estimated: Column, tps: Column, terminal: Column) -> Column:
    """One line for a log: all parts, with a URL of at least 18 characters."""
    wide = F.greatest(F.lit(TERMINAL_LEAST), F.coalesce(terminal, F.lit(TERMINAL)))
    lane_label, state_label, chunk_label = _labels(state, lane, chunk, chunks)
    prefix, told = F.concat(lane_label, agent, F.lit(" "), state_label), telemetry_suffix(tokens, tps, estimated)
    eta = F.coalesce(F.concat(F.lit(" eta "), duration(remaining_ms(done, total, elapsed))), F.lit(""))
    room = wide - F.length(prefix) - F.length(chunk_label) - F.length(told) - F.length(eta) - 4
    return F.concat(prefix, F.lit(" "), middle_truncate(url, F.greatest(F.lit(18), room)), chunk_label, told, eta)


def friendly_error(message: Column) -> Column:
    low = F.lower(message)
    return F.when(message.isNull(), "Unknown analysis error.").when(low.contains("rate limit"), "The provider's rate limit was reached; wait and run again.").when(low.contains("api key"), "The provider refused the API key.").otherwise(message)


def file_name(text: Column) -> Column:
    """A name safe for files: other characters to dashes, at most 80."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), "-+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(F.substring(safe, 1, 80), F.lit("")), F.lit("artifact"))


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def script_json(value: Column) -> Column:
    """JSON that can stand inside a script element."""
    out = F.to_json(value)
    for char in "<>&  ":
        out = F.replace(out, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return out
