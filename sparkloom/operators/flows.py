"""Flows and signals of a run: authentication, captcha, fingerprinting, encryption, findings, and runtime overlays.

Inputs are per run: artifacts (artifact_seq, url, content), snapshots (page_seq, url, title, headings, forms, buttons,
summary), endpoints (rank, url, methods, purpose, request_fields) and traces (one row, see ``runtime_signals``). Rules are
arrays in expressions, so a row is tested against them where it lies, and only hits are grouped. Tables with a row a run are
joined by exchanges: as stored lists take some thirtieth of their memory, Spark would broadcast what no driver holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import clip, quick, words_re
from sparkloom.operators.ordered import Listed, bound, capped_lists, ordered_list

# Rule vocabularies, labels and caps.
AUTH = words_re("login", "signin", "signup", "auth", "oauth", "session", "token", "password", "mfa", "2fa", "verify", "reset")
CAPTCHA = (
    ("Cloudflare Turnstile", words_re("turnstile")),
    ("Google reCAPTCHA", words_re("recaptcha")),
    ("hCaptcha", words_re("hcaptcha")),
    ("GeeTest", words_re("geetest")),
    ("Arkose Labs", r"(?i)(?<![A-Za-z0-9_])arkose|funcaptcha(?![A-Za-z0-9_])"),
    ("Generic captcha", words_re("captcha")),
)
CAPTCHA_RELATED = "(?i)captcha|risk|challenge|verify"
FINGERPRINT = (
    ("navigator fingerprinting", r"(?i)navigator\.(?:userAgent|platform|languages|language|webdriver|hardwareConcurrency|deviceMemory)"),
    ("screen fingerprinting", r"(?i)screen\.(?:width|height|availWidth|availHeight|colorDepth|pixelDepth)"),
    ("canvas fingerprinting", "(?i)(?:toDataURL|getImageData|measureText|canvas)"),
    ("webgl fingerprinting", r"(?i)(?:WebGLRenderingContext|getParameter\(|WEBGL_debug_renderer_info)"),
    ("audio fingerprinting", "(?i)(?:AudioContext|OfflineAudioContext|AnalyserNode|createOscillator)"),
    ("timezone fingerprinting", r"(?i)(?:Intl\.DateTimeFormat|resolvedOptions\(\)\.timeZone|getTimezoneOffset)"),
)
FINGERPRINT_TO = "(?i)telemetry|track|collect|event|risk|device|fingerprint|profile"
ENCRYPTION = (
    ("subtle", r"(?i)crypto\.subtle\.(?:encrypt|decrypt|digest|sign|verify|importKey|deriveBits|deriveKey)"),
    ("algorithms", words_re("AES", "RSA", "SHA-1", "SHA-256", "SHA-384", "SHA-512", "HMAC", "PBKDF2")),
    ("helpers", words_re("CryptoJS", "createCipheriv", "createDecipheriv", "btoa", "atob")),
)
ENCRYPTION_IN = words_re("token", "password", "payload", "fingerprint", "deviceId", "signature", "nonce", "timestamp")
ENCRYPTION_OUT = words_re("ciphertext", "digest", "signature", "hash", "encrypted", "token")
ENCRYPTION_TO = "(?i)sign|token|auth|risk|device|verify"
ERRORS = "(?i)[\"'`]([^\"'`]*(?:invalid|expired|captcha|verify|unauthorized|forbidden|too many|rate limit|blocked|challenge)[^\"'`]*)[\"'`]"
TOUCHES = (("cookie", "cookie"), ("localStorage", "localStorage"), ("sessionStorage", "sessionStorage"), ("indexedDB", "indexedDB"), ("Authorization", "Authorization header"), ("Bearer", "Bearer token"))
RUNTIME_AUTH = "(?i)(auth|login|signin|signup|session|token|password|verify|mfa|2fa|oauth)"
RUNTIME_CHALLENGE = "(?i)(captcha|challenge|risk|turnstile|recaptcha|hcaptcha|verify)"
RUNTIME_FINGERPRINT = "(?i)(device|fingerprint|telemetry|collect|track|risk|profile)"
RUNTIME_CRYPTO = r"(?i)(?<![A-Za-z0-9_])(?:crypto\.subtle\.[A-Za-z0-9_]+|AES|RSA|SHA-256|SHA-512|HMAC|PBKDF2|CryptoJS)(?![A-Za-z0-9_])"
RUNTIME_PROVIDERS = (("turnstile", "Cloudflare Turnstile"), ("recaptcha", "Google reCAPTCHA"), ("hcaptcha", "hCaptcha"), ("geetest", "GeeTest"), ("arkose|funcaptcha", "Arkose Labs"))
#: For each rule in lower case what a text must hold for its pattern to match at all: a cheap test before the pattern.
CAPTCHA_NEEDLES = (("turnstile",), ("recaptcha",), ("hcaptcha",), ("geetest",), ("arkose", "funcaptcha"), ("captcha",))
FINGERPRINT_NEEDLES = (
    ("navigator.",), ("screen.",), ("todataurl", "getimagedata", "measuretext", "canvas"), ("webglrenderingcontext", "getparameter(", "webgl_debug_renderer_info"),
    ("audiocontext", "analysernode", "createoscillator"), ("intl.datetimeformat", "resolvedoptions().timezone", "gettimezoneoffset"),
)
ENCRYPTION_NEEDLES = (("crypto.subtle.",), ("aes", "rsa", "sha-", "hmac", "pbkdf2"), ("cryptojs", "createcipheriv", "createdecipheriv", "btoa", "atob"))
ERROR_NEEDLES = ("invalid", "expired", "captcha", "verify", "unauthorized", "forbidden", "too many", "rate limit", "blocked", "challenge")
#: All of them, for one scan of a text.
NEEDLES = tuple(dict.fromkeys(n for group in (*CAPTCHA_NEEDLES, *FINGERPRINT_NEEDLES, *ENCRYPTION_NEEDLES, ERROR_NEEDLES, tuple(w.lower() for w, _ in TOUCHES)) for n in group))
SNIPPETS = "(?i)(auth|login|signin|signup|session|token|password|verify|mfa|2fa|oauth|captcha|challenge|risk|telemetry|fingerprint|device|profile)"
GLOBALS = "(?i)(captcha|turnstile|grecaptcha|hcaptcha|geetest|arkose|fingerprint|device|crypto)"
SENT = "Collected browser/device traits appear to be forwarded into telemetry, anti-abuse, or risk endpoints."
KEPT = "Collected browser/device traits appear to support client-side risk, telemetry, or anti-automation logic."
AUTH_TITLE = "Primary authentication flow"
RUNTIME_STEP = "Runtime network activity"
RUNTIME_STEP_TEXT = "Browser-assisted tracing observed auth-like requests after hydration."
RUNTIME_CHALLENGE_TITLE = "Runtime challenge flow"
RUNTIME_COLLECTOR = "runtime telemetry and device profiling"
RUNTIME_PURPOSE = "Browser-assisted tracing observed likely telemetry or device-risk network activity after hydration."
FINDING_INTROSPECTION = "GraphQL introspection is enabled"
FINDING_TRAITS = "Client fingerprinting logic is present"
FINDING_BARE = "No obvious captcha challenge was detected on auth flow"
FINDING_TEXTS = {
    1: ("Same-origin GraphQL introspection responded successfully, which may disclose schema surface to unauthenticated clients.", "Disable production introspection where possible or gate it behind authentication."),
    2: ("The frontend collects device or browser traits that appear to support telemetry, risk scoring, or bot detection.", "Review data minimization, consent, and retention requirements for collected browser/device traits."),
    3: ("The analyzed auth surface did not expose an obvious captcha or challenge gate in static assets.", "Confirm rate-limiting, MFA escalation, and anti-automation controls on the server side."),
}


def take(text: Column, pattern: str, n: int = 12, group: int = 0) -> Column:
    return F.slice(F.filter(F.regexp_extract_all(text, F.lit(quick(pattern)), group), lambda x: x != ""), 1, n)


def _held(low: Column, needles: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*(F.when(low.contains(n), n) for n in needles)))


def needles_held(text: Column, needles: tuple[str, ...] = NEEDLES) -> Column:
    """Which of the needles, in lower case, a text holds, whatever its case. Looking for one plain string after the other takes a third of what one pattern of all takes."""
    return F.when(text.isNotNull(), bound(F.lower(text), lambda low: _held(low, needles)))


def scanned(artifacts: DataFrame, *groups) -> DataFrame:
    """artifacts with ``held``, the needles that their text holds: those of all rules, or of groups alone; what has it keeps it, so a run scans its texts once."""
    if "held" in artifacts.columns:
        return artifacts
    needles = tuple(dict.fromkeys(n for group in groups for n in group)) or NEEDLES
    return artifacts.withColumn("_low", F.lower("content")).withColumn("held", F.when(F.col("content").isNotNull(), _held(F.col("_low"), needles))).drop("_low")


def may_hold(text: Column, needles, held: Column | None = None) -> Column:
    """Whether any of the needles, in lower case, is in the text whatever its case; held: what a scan found."""
    if held is not None:
        return reduce(lambda a, b: a | b, (F.array_contains(held, n) for n in needles))
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (low.contains(n) for n in needles))


def error_strings(text: Column, held: Column | None = None) -> Column:
    return F.when(may_hold(text, ERROR_NEEDLES, held), take(text, ERRORS, 12, 1)).otherwise(F.array().cast("array<string>"))


def token_touches(text: Column, held: Column | None = None) -> Column:
    return F.array_compact(F.array(*(F.when(may_hold(text, (word.lower(),), held) & text.rlike(quick(words_re(word))), label) for word, label in TOUCHES)))


def found_by_rule(text: Column, rules, needles, name: str, held: Column | None = None) -> Column:
    """[(rule, its first matches)] of the rules that match; each pattern is searched once, where it can match."""
    hits_ = F.array(*(F.struct(F.lit(k).alias("rule"), F.when(may_hold(text, needles[k], held), take(text, p)).alias(name)) for k, (_, p) in enumerate(rules)))
    return F.filter(hits_, lambda x: F.size(x[name]) > 0)


def captcha_providers(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), label) for p, label in RUNTIME_PROVIDERS)))


def interesting_globals(names: Column) -> Column:
    return F.slice(F.filter(names, lambda x: x.rlike(GLOBALS)), 1, 20)


def wants_snippet(resource_type: Column, url: Column) -> Column:
    return resource_type.isin("fetch", "xhr") & url.rlike(SNIPPETS)


def hits(text: Column, rules, needles, held: Column | None = None) -> Column:
    """Numbers of the rules that match."""
    return F.array_compact(F.array(*(F.when(may_hold(text, needles[k], held) & text.rlike(quick(pattern)), F.lit(k)) for k, (_, pattern) in enumerate(rules))))


def _label(rules) -> Column:
    return F.element_at(F.array(*(F.lit(name) for name, _ in rules)), F.col("rule") + 1)


def _evidence(text: Column) -> Column:
    return clip(F.substring(text, 1, 260))


def _exploded(rows: DataFrame, hits_: str, name: str, keep: list[str], taken: dict[str, Column]) -> DataFrame:
    """A row for each hit of a list, with keep and what is taken of the text: once for a text, and only of one that has hits."""
    once = rows.select(*keep, hits_, *(F.when(F.size(hits_) > 0, c).alias(k) for k, c in taken.items()))
    return once.select(*keep, *taken, F.explode_outer(hits_).alias(name)).where(F.col(name).isNotNull())


def _empty(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<string>"))


def _destinations(endpoints: DataFrame, pattern: str, n: int = 8) -> DataFrame:
    hit = endpoints.where(F.concat_ws(" ", "url", "purpose").rlike(pattern))
    return hit.groupBy("run_id").agg(F.slice(ordered_list(F.col("rank"), F.col("url")), 1, n).alias("destination_urls")).hint("merge")


def auth_flows(snapshots: DataFrame, endpoints: DataFrame, artifacts: DataFrame) -> DataFrame:
    """At most one flow a run: triggers, steps, tokens, errors, evidence."""
    fields = F.exists("forms", lambda f: F.exists(f["input_types"], lambda t: F.lower(t).isin("password", "email", "tel")))
    forms = snapshots.where(fields | F.concat_ws(" ", F.col("title"), F.array_join("headings", " ")).rlike(quick(AUTH)))
    known = endpoints.select("run_id", "rank", "url", "methods", "purpose", F.col("url").rlike(quick(AUTH)).alias("is_auth"))
    auth_ends = known.where(F.col("is_auth") | F.col("purpose").rlike(quick(AUTH))).groupBy("run_id").agg(
        F.max("is_auth").alias("any_url"),
        F.slice(ordered_list(F.col("rank"), F.col("url")), 1, 4).alias("end_urls"),
        F.slice(ordered_list(F.col("rank"), F.concat(F.col("url"), F.lit(" via "), F.when(F.size("methods") > 0, F.array_join("methods", ",")).otherwise("unknown method"))), 1, 8).alias("end_evidence"),
    )
    pages = forms.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("page_seq", "url", "title", "headings", "buttons", "summary", "forms"))).alias("pages")
    )
    held, seq = scanned(artifacts, ERROR_NEEDLES, (w.lower() for w, _ in TOUCHES)), F.col("artifact_seq")
    told = F.filter(error_strings(F.col("content"), F.col("held")), lambda e: e.rlike(quick(AUTH)) | e.rlike("(?i)captcha"))
    texts = capped_lists(held.select("run_id", "artifact_seq", token_touches(F.col("content"), F.col("held")).alias("tokens"), told.alias("errors")), ["run_id"], {"tokens": Listed(seq, F.col("tokens"), None), "errors": Listed(seq, F.col("errors"), None)})
    rows = pages.join(auth_ends, "run_id", "full").where(F.col("pages").isNotNull() | F.col("any_url")).join(texts.hint("merge"), "run_id", "left")
    none = F.array().cast("array<string>")
    urls_, pages_ = F.coalesce("end_urls", none), F.coalesce("pages", F.expr("from_json('[]', 'array<struct<page_seq:int,url:string,title:string,headings:array<string>,buttons:array<string>,summary:string,forms:array<struct<action:string,method:string,input_names:array<string>,input_types:array<string>,submit_labels:array<string>>>>>')"))
    step = lambda p, f: F.struct(
        F.concat_ws(" ", f["method"], f["action"]).alias("title"),
        F.concat(F.lit("Form submits "), F.coalesce(F.nullif(F.array_join(f["input_names"], ", "), F.lit("")), F.nullif(F.array_join(f["input_types"], ", "), F.lit("")), F.lit("credential fields")), F.lit(" from "), p["url"], F.lit(".")).alias("description"),
        F.concat(F.array(f["action"]), urls_).alias("endpoints"),
        F.concat(F.array(p["summary"]), F.slice(f["submit_labels"], 1, 2)).alias("evidence"),
    )
    words = F.flatten(F.transform(pages_, lambda p: F.concat(F.array(p["title"]), p["headings"], p["buttons"])))
    return rows.select(
        "run_id", F.lit(AUTH_TITLE).alias("title"), F.slice(F.array_distinct(F.filter(words, lambda x: x.rlike(quick(AUTH)))), 1, 10).alias("triggers"),
        F.flatten(F.transform(pages_, lambda p: F.transform(p["forms"], lambda f: step(p, f)))).alias("steps"), _empty("tokens").alias("tokens"), _empty("errors").alias("errors"),
        F.array_distinct(F.concat(F.transform(pages_, lambda p: F.concat_ws(": ", p["url"], p["summary"])), F.coalesce("end_evidence", none))).alias("evidence"),
    )


def captcha_flows(snapshots: DataFrame, endpoints: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A flow for each provider that a run's artifacts or page summaries name."""
    rules = hits(F.col("content"), CAPTCHA, CAPTCHA_NEEDLES, F.col("held"))
    own = scanned(artifacts, *CAPTCHA_NEEDLES, ERROR_NEEDLES).select("run_id", "artifact_seq", "content", "held", rules.alias("rules"))
    own = _exploded(own, "rules", "rule", ["run_id", "artifact_seq"], {"errors": error_strings(F.col("content"), F.col("held")), "evidence": _evidence(F.col("content"))})
    seq = F.col("artifact_seq")
    own = capped_lists(own, ["run_id", "rule"], {"errors": Listed(seq, F.col("errors"), 8), "texts": Listed(seq, F.array("evidence"), 10)})
    told = scanned(snapshots.select("run_id", "page_seq", "summary", F.col("summary").alias("content")), *CAPTCHA_NEEDLES)
    told = told.select("run_id", "page_seq", "summary", F.explode_outer(hits(F.col("content"), CAPTCHA, CAPTCHA_NEEDLES, F.col("held"))).alias("rule")).where("rule is not null").groupBy("run_id", "rule").agg(ordered_list(F.col("page_seq"), F.col("summary")).alias("summaries"))
    flows = own.join(told, ["run_id", "rule"], "full")
    named = scanned(endpoints.select("run_id", "rank", "url", "request_fields", F.concat_ws(" ", "url", "purpose").alias("content")), *CAPTCHA_NEEDLES)
    rules = F.when(F.col("url").rlike(CAPTCHA_RELATED), F.sequence(F.lit(0), F.lit(len(CAPTCHA) - 1))).otherwise(hits(F.col("content"), CAPTCHA, CAPTCHA_NEEDLES, F.col("held")))
    ends = named.select("run_id", "rank", "url", "request_fields", F.explode_outer(rules).alias("rule")).where("rule is not null")
    ends = capped_lists(ends, ["run_id", "rule"], {"endpoints": Listed(F.col("rank"), F.array("url"), 12, distinct=False), "request_fields": Listed(F.col("rank"), F.col("request_fields"), 12)})
    entries = F.concat(F.array("title"), F.col("headings"), F.array("summary"))
    words = snapshots.groupBy("run_id").agg(F.flatten(ordered_list(F.col("page_seq"), entries)).alias("words"))
    none = F.array().cast("array<string>")
    triggers = reduce(lambda acc, k: F.when(F.col("rule") == k, F.filter("words", lambda x: x.rlike(quick(CAPTCHA[k][1])) | x.rlike(CAPTCHA_RELATED))).otherwise(acc), range(len(CAPTCHA)), none)
    out = flows.join(ends.hint("merge"), ["run_id", "rule"], "left").join(words.hint("merge"), "run_id", "left")
    return out.select(
        "run_id", "rule", _label(CAPTCHA).alias("provider"), F.slice(F.array_distinct(F.coalesce(triggers, none)), 1, 10).alias("triggers"), _empty("endpoints").alias("endpoints"),
        _empty("request_fields").alias("request_fields"), _empty("errors").alias("errors"), F.slice(F.array_distinct(F.concat(_empty("texts"), _empty("summaries"))), 1, 10).alias("evidence"),
    )


def fingerprint_signals(endpoints: DataFrame, artifacts: DataFrame) -> DataFrame:
    found = found_by_rule(F.col("content"), FINGERPRINT, FINGERPRINT_NEEDLES, "points", F.col("held"))
    rows = scanned(artifacts, *FINGERPRINT_NEEDLES).select("run_id", "artifact_seq", "url", F.substring("content", 1, 260).alias("head"), F.explode_outer(found).alias("f")).where("f is not null")
    rows, seq = rows.select("run_id", "artifact_seq", "url", clip(F.col("head")).alias("text"), "f", F.col("f.rule").alias("rule")), F.col("artifact_seq")
    rows = capped_lists(rows, ["run_id", "rule"], {"data_points": Listed(seq, F.col("f.points"), 12), "evidence": Listed(seq, F.array(F.concat_ws(": ", "url", "text")), 8, distinct=False)})
    rows = rows.join(_destinations(endpoints, FINGERPRINT_TO), "run_id", "left").withColumn("destination_urls", _empty("destination_urls"))
    return rows.select("run_id", "rule", _label(FINGERPRINT).alias("collector"), "data_points", "destination_urls", F.when(F.size("destination_urls") > 0, SENT).otherwise(KEPT).alias("purpose"), "evidence")


def encryption_signals(endpoints: DataFrame, artifacts: DataFrame) -> DataFrame:
    text, seq = F.col("content"), F.col("artifact_seq")
    found = found_by_rule(text, ENCRYPTION, ENCRYPTION_NEEDLES, "hints", F.col("held"))
    rows = scanned(artifacts, *ENCRYPTION_NEEDLES).select("run_id", "artifact_seq", "url", "content", found.alias("found"))
    rows = _exploded(rows, "found", "f", ["run_id", "artifact_seq", "url"], {"text": _evidence(text), "ins": take(text, ENCRYPTION_IN), "outs": take(text, ENCRYPTION_OUT)}).withColumn("rule", F.col("f.rule"))
    lists = {"algorithm_hints": "f.hints", "inputs": "ins", "outputs": "outs"}
    rows = capped_lists(rows, ["run_id", "rule"], {**{name: Listed(seq, F.col(c), 12) for name, c in lists.items()}, "evidence": Listed(seq, F.array(F.concat_ws(": ", "url", "text")), 8, distinct=False)})
    rows = rows.join(_destinations(endpoints, ENCRYPTION_TO), "run_id", "left")
    return rows.select("run_id", "rule", "algorithm_hints", "inputs", "outputs", _empty("destination_urls").alias("destination_urls"), "evidence")


def security_findings(auth: DataFrame, captcha: DataFrame, fingerprint: DataFrame, graphql: DataFrame) -> DataFrame:
    """run_id, rule, severity, title, detail, remediation, evidence: introspection on, fingerprinting, sign-in without captcha."""
    finding = lambda rule, severity, title: [F.lit(x).alias(n) for n, x in zip(("rule", "severity", "title", "detail", "remediation"), (rule, severity, title, *FINDING_TEXTS[rule]), strict=True)]
    open_ = graphql.where("introspection_status = 'supported'").groupBy("run_id").agg(ordered_list(F.col("rank"), F.col("url")).alias("evidence"))
    traits = fingerprint.groupBy("run_id").agg(ordered_list(F.col("rule"), F.col("collector")).alias("evidence"))
    bare = auth.join(captcha.select("run_id").distinct(), "run_id", "left_anti").select("run_id", F.array("title").alias("evidence"))
    parts = [
        open_.select("run_id", *finding(1, "medium", FINDING_INTROSPECTION), "evidence"),
        traits.select("run_id", *finding(2, "low", FINDING_TRAITS), "evidence"),
        bare.select("run_id", *finding(3, "low", FINDING_BARE), "evidence"),
    ]
    return reduce(DataFrame.unionByName, parts)


#: What a recorded session may hold besides requests, with the types that stand in where a column is missing.
REQUEST_COLUMNS = {"request_body_snippet": "string", "console_text": "string", "console_type": "string", "page_error": "string", "frame_url": "string"}
SESSION_COLUMNS = {"page_text": "string", "global_names": "array<string>", "cookie_names": "array<string>", "local_storage_keys": "array<string>", "session_storage_keys": "array<string>"}


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with nulls for the columns that it lacks."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def runtime_signals(requests: DataFrame, session: DataFrame | None = None) -> DataFrame:
    """Recorded requests, console lines and page errors (run_id, seq, url and REQUEST_COLUMNS) and what the page held at the end (run_id and SESSION_COLUMNS) to one row of signals a run.

    Providers and encryption hints are looked for in the page's text, the console, the errors and the names of globals, in that order.
    """
    rows = with_columns(requests, REQUEST_COLUMNS)
    asked = F.concat_ws(" ", "url", F.coalesce("request_body_snippet", F.lit("")))
    seq, url, console, error = F.col("seq"), F.col("url"), F.coalesce("console_text", F.lit("")), F.coalesce("page_error", F.lit(""))
    line = F.when(console != "", F.concat(F.coalesce("console_type", F.lit("log")), F.lit(": "), console))
    crypto = lambda text: F.regexp_extract_all(text, F.lit(RUNTIME_CRYPTO), 0)
    told = lambda p: F.bool_or(console.rlike(f"(?i){p}") | error.rlike(f"(?i){p}"))
    when = lambda c, p: F.when(asked.rlike(p), F.array(c))
    asked_for = {"auth_request_urls": RUNTIME_AUTH, "challenge_request_urls": RUNTIME_CHALLENGE, "fingerprinting_request_urls": RUNTIME_FINGERPRINT}
    lists = capped_lists(
        rows, ["run_id"],
        {
            **{name: Listed(seq, when(url, p), 20) for name, p in asked_for.items()}, "_console_hints": Listed(seq, crypto(console), 20), "_error_hints": Listed(seq, crypto(error), 20),
            "console": Listed(seq, F.array(console), 60), "console_lines": Listed(seq, F.array(line), 60, distinct=False), "page_errors": Listed(seq, F.array(error), 20), "frame_urls": Listed(seq, F.array("frame_url"), 40),
        },
        *(told(p).alias(f"_told{k}") for k, (p, _) in enumerate(RUNTIME_PROVIDERS)),
    )
    if session is None:
        session = requests.select("run_id").distinct()
    own = with_columns(session, SESSION_COLUMNS).select(
        "run_id", F.coalesce("page_text", F.lit("")).alias("_text"), interesting_globals(_empty("global_names")).alias("interesting_globals"), F.slice(_empty("cookie_names"), 1, 40).alias("cookie_names"),
        _empty("local_storage_keys").alias("local_storage_keys"), _empty("session_storage_keys").alias("session_storage_keys"),
    )
    both = own.join(lists, "run_id", "full")
    globals_, text = _empty("interesting_globals"), F.coalesce("_text", F.lit(""))
    named = F.array_compact(F.array(*(F.when(F.coalesce(f"_told{k}", F.lit(False)) | text.rlike(f"(?i){p}") | F.exists(globals_, lambda g: g.rlike(f"(?i){p}")), label) for k, (p, label) in enumerate(RUNTIME_PROVIDERS))))  # noqa: B023
    hints = F.concat(crypto(text), _empty("_console_hints"), _empty("_error_hints"), F.flatten(F.transform(globals_, crypto)))
    keys = lambda label, column: F.transform(_empty(column), lambda k: F.concat(F.lit(f"{label}:"), k))
    names = ("auth_request_urls", "challenge_request_urls", "fingerprinting_request_urls", "console", "console_lines", "page_errors", "frame_urls", "cookie_names", "local_storage_keys", "session_storage_keys")
    return both.select(
        "run_id", named.alias("captcha_providers"), F.slice(F.array_distinct(hints), 1, 20).alias("encryption_hints"), globals_.alias("interesting_globals"),
        F.concat(keys("cookie", "cookie_names"), keys("localStorage", "local_storage_keys"), keys("sessionStorage", "session_storage_keys")).alias("storage_names"), *(_empty(n).alias(n) for n in names),
    )


def merge_auth(flows: DataFrame, traces: DataFrame) -> DataFrame:
    """A captured trace's requests, storage names and messages added to the run's flow. traces: ``runtime_signals`` with status and notes."""
    both = flows.join(traces.where("status = 'captured'").hint("merge"), "run_id", "left")
    seen = F.col("status").isNotNull()
    step = F.array(F.struct(F.lit(RUNTIME_STEP).alias("title"), F.lit(RUNTIME_STEP_TEXT).alias("description"), F.col("auth_request_urls").alias("endpoints"), F.slice("console_lines", 1, 4).alias("evidence")))
    more = lambda column, n, *add: F.when(seen, F.slice(F.array_distinct(F.concat(column, *(_empty(a) for a in add))), 1, n)).otherwise(F.col(column)).alias(column)
    steps = F.when(seen & (F.size(_empty("auth_request_urls")) > 0), F.concat("steps", step)).otherwise(F.col("steps")).alias("steps")
    return both.select("run_id", "title", "triggers", steps, more("tokens", 20, "storage_names"), more("errors", 16, "page_errors", "console"), more("evidence", 20, "auth_request_urls", "notes"))


def merge_captcha(flows: DataFrame, traces: DataFrame) -> DataFrame:
    """The first runtime provider names every flow of its run; a run without flows gets one if the trace tells of a challenge."""
    seen = traces.where("status = 'captured'").withColumn("messages", F.filter(F.array_distinct(F.concat("page_errors", "console")), lambda x: x.rlike("(?i)(captcha|challenge|turnstile|recaptcha|hcaptcha|verify|risk)")))
    seen = seen.where((F.size("captcha_providers") > 0) | (F.size("challenge_request_urls") > 0) | (F.size("messages") > 0)).select("run_id", "captcha_providers", "challenge_request_urls", "messages", "notes")
    first = F.get("captcha_providers", 0)
    more = lambda column, *add: F.when(F.col("messages").isNotNull(), F.slice(F.array_distinct(F.concat(column, *add)), 1, 12)).otherwise(F.col(column))
    return _merged(flows, seen, {
        "provider": (F.coalesce(first, "provider"), F.coalesce(first, F.lit(RUNTIME_CHALLENGE_TITLE))), "triggers": (F.col("triggers"), F.slice("messages", 1, 6)), "endpoints": (more("endpoints", "challenge_request_urls"), F.col("challenge_request_urls")),
        "request_fields": (F.col("request_fields"), F.array().cast("array<string>")), "errors": (more("errors", "messages"), F.slice("messages", 1, 10)), "evidence": (more("evidence", "captcha_providers", "notes"), F.concat("captcha_providers", "notes")),
    })


def _merged(known: DataFrame, seen: DataFrame, columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """run_id, rule and columns: each by its first expression for known rows, with what was seen of their run, and by its second for runs of which only seen has a row. One join, so both are computed once."""
    both, new = known.join(seen, "run_id", "full"), F.col("rule").isNull()
    return both.select("run_id", F.coalesce("rule", F.lit(0)).alias("rule"), *(F.when(new, alone).otherwise(told).alias(name) for name, (told, alone) in columns.items()))


def merge_fingerprint(signals: DataFrame, traces: DataFrame) -> DataFrame:
    seen = traces.where((F.col("status") == "captured") & (F.size("fingerprinting_request_urls") > 0)).select("run_id", "fingerprinting_request_urls", "notes", "interesting_globals")
    has = F.col("notes").isNotNull()
    more = lambda column, add, n: F.when(has, F.slice(F.array_distinct(F.concat(column, add)), 1, n)).otherwise(F.col(column))
    return _merged(signals, seen, {
        "collector": (F.col("collector"), F.lit(RUNTIME_COLLECTOR)), "data_points": (F.col("data_points"), F.col("interesting_globals")), "destination_urls": (more("destination_urls", "fingerprinting_request_urls", 10), F.col("fingerprinting_request_urls")),
        "purpose": (F.col("purpose"), F.lit(RUNTIME_PURPOSE)), "evidence": (more("evidence", "notes", 12), F.col("notes")),
    })


def merge_encryption(signals: DataFrame, traces: DataFrame) -> DataFrame:
    seen = traces.where((F.col("status") == "captured") & (F.size("encryption_hints") > 0)).select("run_id", "encryption_hints", "auth_request_urls", "notes")
    has, none = F.col("notes").isNotNull(), F.array().cast("array<string>")
    more = lambda column, add, n: F.when(has, F.slice(F.array_distinct(F.concat(column, add)), 1, n)).otherwise(F.col(column))
    return _merged(signals, seen, {
        "algorithm_hints": (more("algorithm_hints", "encryption_hints", 12), F.col("encryption_hints")), "inputs": (F.col("inputs"), none), "outputs": (F.col("outputs"), none),
        "destination_urls": (more("destination_urls", "auth_request_urls", 10), F.col("auth_request_urls")), "evidence": (more("evidence", "notes", 12), F.col("notes")),
    })
