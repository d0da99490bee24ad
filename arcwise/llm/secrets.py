"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds, each leftmost and not overlapping: ``assign`` (a keyword, a sign, a value of 12
characters or more), ``access`` (AKIA identifiers of 18 characters or more) and ``hex`` (runs of 16
or more). Spans are code points, end exclusive; they come from the lengths of the pieces between
the matches.

Linking: weak candidates mean nothing alone. These are ``value`` (an assigned value of 6 to 11
characters), ``key_id`` (AKIA identifiers of 12 to 17 characters), ``blob`` (runs of 40 or more base64
characters that mix upper case, lower case and digits) and ``endpoint`` (a URL's scheme and host).
Roles are identifier (access, key_id), secret (assign, hex, value, blob) and endpoint. A part's
scope reaches ``SCOPE`` characters to either side. Parts are joined with the scopes of others by
overlap of intervals, by document and bin; a weak candidate is reported only if parts in reach
complete a credential: an identifier needs a secret, a secret an identifier, an endpoint both. One
that overlaps a base span is not reported again.

The join asks for each candidate whether complements exist in any of its bins, so no pair is emitted; a bin's list
holds what fits into ``BIN`` characters, whatever the document's length.

Null and empty texts have no spans. Very long texts are scanned whole. Rows that repeat an id are
scanned alike, each returned; rows of equal id and different texts are told apart by a hash of the
text. Null ids are kept. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Patterns of the weak kinds; runs are looked at whole, so that longer identifiers are of the base kind.
KEY_ID = r"(?<![A-Z0-9])AKIA[A-Z0-9]{8,13}(?![A-Z0-9])"
BLOB = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}={0,2}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"
KINDS = ["assign", "access", "hex", "value", "key_id", "blob", "endpoint"]
BASE = KINDS[:3]
ROLES = {"identifier": ["access", "key_id"], "secret": ["assign", "hex", "value", "blob"], "endpoint": ["endpoint"]}
SCOPE = 400
BIN = 800


def _pieces(pattern: str) -> Column:
    """For each match of the pattern: the length of what stands between the match before and it, the match's length, the match."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    between = F.split("text", pattern, -1)
    return F.transform(found, lambda m, i: F.struct(F.length(F.get(between, i)).alias("gap"), F.length(m).alias("size"), m.alias("match")))


def _spans(rows: DataFrame) -> DataFrame:
    """(key, kind, start, end) of all base spans and weak candidates, once for each key."""
    scans = [("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("key_id", KEY_ID), ("blob", BLOB), ("endpoint", ENDPOINT)]
    none = F.array().cast("array<struct<gap: int, size: int, match: string>>")
    # Texts are first asked whether a kind occurs at all; most are passed over once for each kind.
    lists = [F.struct(F.lit(kind).alias("kind"), F.when(F.col("text").rlike(p), _pieces(p)).otherwise(none).alias("got")) for kind, p in scans]
    each = rows.select("key", F.explode(F.filter(F.array(*lists), lambda x: F.size(x["got"]) > 0)).alias("x"))
    each = each.select("key", "x.kind", F.posexplode("x.got").alias("nth", "m")).select("key", "kind", "nth", "m.*").dropDuplicates(["key", "kind", "nth"])
    order = Window.partitionBy("key", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap").cast("bigint") + F.col("size")).over(order)).withColumn("start", F.col("end") - F.col("size"))
    value = F.length(F.regexp_extract("match", ASSIGN, 2))
    mixed = F.col("match").rlike("[a-z]") & F.col("match").rlike("[A-Z]") & F.col("match").rlike("[0-9]")
    kind = F.when(F.col("kind") == "assign", F.when(value >= 12, "assign").when(value >= 6, "value")).when((F.col("kind") != "blob") | mixed, F.col("kind"))
    return each.withColumn("kind", kind).filter("kind is not null").select("key", "kind", "start", "end")


def _linked(spans: DataFrame) -> DataFrame:
    """The weak candidates that parts in reach complete."""
    def bins(a, b):
        return F.explode(F.sequence(F.floor(a / BIN), F.floor(b / BIN))).alias("bin")

    weak = spans.filter(~F.col("kind").isin(BASE)).select("key", "kind", "start", "end", bins(F.col("start"), F.col("end") - 1))
    reach = spans.select("key", "kind", F.struct("start", "end").alias("at"), bins(F.col("start") - SCOPE, F.col("end") + SCOPE))
    of = lambda kinds: F.collect_list(F.when(F.col("kind").isin(kinds), F.col("at")))
    held = reach.groupBy("key", "bin").agg(*[of(kinds).alias(role) for role, kinds in ROLES.items()], of(BASE).alias("base"))

    def near(role, far):
        return F.exists(role, lambda x: (x["start"] < F.col("end") + far) & (x["end"] > F.col("start") - far))

    flags = {r: F.max(near(r, SCOPE)).alias(f"has_{r}") for r in ("identifier", "secret")} | {"base": F.max(near("base", 0)).alias("in_base")}
    found = weak.join(held, ["key", "bin"]).groupBy("key", "kind", "start", "end").agg(*flags.values())
    role = lambda r: F.col("kind").isin(ROLES[r])
    need = (role("identifier") | F.col("has_identifier")) & (role("secret") | F.col("has_secret"))
    return found.filter(~F.col("in_base") & need).select("key", "kind", "start", "end")


def scan_secrets(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: its id and ``spans``, an array of {start, kind, end} by start, then by kind as KINDS lists it.

    Base spans are those whose kind is in BASE; the others were linked.
    """
    rows = docs.select(F.col(doc).alias(doc), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.concat_ws(":", F.coalesce(F.col(doc).cast("string"), F.lit("null")), F.xxhash64("text").cast("string")))
    spans = _spans(rows)
    every = spans.filter(F.col("kind").isin(BASE)).unionByName(_linked(spans))
    nth = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    by_key = every.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", nth.alias("nth"), "end"))).alias("found"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.coalesce("found", F.array().cast("array<struct<start: bigint, nth: int, end: bigint>>")), lambda x: F.struct(x["start"].alias("start"), F.element_at(kinds, x["nth"]).alias("kind"), x["end"].alias("end")))
    return rows.select(doc, "key").join(by_key, "key", "left").select(doc, spans.alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"].isin(BASE))
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(said(base), 256).alias("base_sha256"), said("spans").alias("spans"))
