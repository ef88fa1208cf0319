"""Secret scans with multipart credential linking, in DataFrame and SQL functions only.

Base spans come from three patterns. Weak parts (key-like strings, account or
access identifiers, endpoints) say little alone: one is reported only when its
complement starts within SCOPE code points: a key with an identifier, an
identifier with a secret, an endpoint with both. Base spans count as parts.

The link is an interval join by scope: parts are dealt to cells of SCOPE code
points of their document, a cell keeps its first and last start for each role,
and a part meets its own cell and the two beside it. That join makes three rows
for a part at most, however many parts stand together.

Weak parts that overlap a base span are dropped by a join of the same kind. Work
grows in proportion to a text's spans: offsets are running sums in chunks of CHUNK
matches, and redaction works on blocks of BLOCK code points.

Defined cases: null text is empty; repeated rows get the same spans each; an
empty table gives an empty result; other columns are ignored. Positions are code
points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, quoted, table, whole_row

SCOPE = 256
#: Matches of one running sum, and code points of a block of redaction.
CHUNK, BLOCK = 128, 4096
#: The base patterns. Minimal lengths apply to matches (assign: to the value).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
#: Weak parts.
KEY = r"[A-Za-z0-9+/_-]{24,}+"
ID = r"""(?i:access_?key_?id|client_?id|user_?name|user|account|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+"""
ENDPOINT = r"(?:https?|wss?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:/@%-]++"
#: Kinds in the order in which spans with one start are listed, and the role each plays.
KINDS = ("assign", "access", "hex", "key", "id", "endpoint")
ROLES = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "id": "id", "endpoint": "endpoint"}
REDACTED = "[REDACTED]"

_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _spans(kind: str, pattern: str, guard: Column, least: int, measured: int = 0, only: str | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches whose group `measured` has `least` characters.

    Matches and the gaps between them come from the same pattern, so a match
    starts after the gaps and matches before it.
    """
    rank, quoted_ = KINDS.index(kind), pattern.replace("\\", "\\\\").replace("'", "\\'")
    wanted = f"length(m.`2`) >= {least}" + (f" AND m.`2` RLIKE '{only}'" if only else "")
    advance = "length(m.`0`) + coalesce(length(m.`1`), 0)"
    # transform(array(x), x -> ...) names x once; chunks bound what an aggregate copies.
    found = F.expr(
        f"flatten(transform(array(arrays_zip(split(t, '{quoted_}', -1), regexp_extract_all(t, '{quoted_}', 0), regexp_extract_all(t, '{quoted_}', {measured}))), "
        f"all -> flatten(transform(array(transform(sequence(0, (size(all) - 1) div {CHUNK}), c -> slice(all, c * {CHUNK} + 1, {CHUNK}))), "
        "chunks -> flatten(zip_with(chunks, "
        f"aggregate(chunks, named_struct('at', 0, 'out', cast(array() AS array<int>)), (s, chunk) -> named_struct('at', s.at + aggregate(chunk, 0, (n, m) -> n + {advance}), 'out', array_append(s.out, s.at)), s -> s.out), "
        f"(chunk, first) -> aggregate(chunk, named_struct('at', first, 'out', cast(array() AS {_SPANS})), "
        f"(s, m) -> named_struct('at', s.at + {advance}, 'out', "
        f"CASE WHEN m.`1` IS NOT NULL AND {wanted} THEN array_append(s.out, named_struct('start', s.at + length(m.`0`), 'rank', {rank}, 'end', s.at + length(m.`0`) + length(m.`1`))) ELSE s.out END), "
        "s -> s.out)))))))"
    )
    return F.when(guard, found).otherwise(F.expr(f"cast(array() AS {_SPANS})"))


def found_spans(docs: DataFrame) -> DataFrame:
    """(id, doc_id, tag, base, weak) of every row; the tag tells repeated ids with other texts apart. Weak spans may overlap base ones."""
    t = F.col("t")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64("t").alias("tag"), "t")
    longer = F.lit(f"[0-9a-f]{{{HEX_LEAST}}}")
    base = F.concat(
        _spans("assign", ASSIGN, F.rlike(t, F.lit(ASSIGN)), ASSIGN_LEAST, 2),
        _spans("access", ACCESS, F.contains(t, F.lit("AKIA")), ACCESS_LEAST),
        _spans("hex", HEX, F.rlike(t, longer), HEX_LEAST),
    )
    mix = "(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
    weak = F.concat(
        _spans("key", KEY, F.rlike(t, F.lit(KEY)), 24, 0, mix),
        _spans("id", ID, F.rlike(t, F.lit(ID)), 1),
        _spans("endpoint", ENDPOINT, F.contains(t, F.lit("://")), 1),
    )
    return rows.select("doc_id", "id", "tag", F.array_sort(base).alias("base"), weak.alias("weak"))


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(id, tag, linked): the weak parts of a row whose complement is in scope, in order."""
    role = F.element_at(F.array(*(F.lit(ROLES[k]) for k in KINDS)), F.col("p.rank") + 1)
    weak_first = len(KINDS) - 3
    parts = (
        found.where("size(weak) > 0 AND size(weak) + size(base) > 1").select("id", "tag", F.explode(F.concat("weak", "base")).alias("p"))
        .select("id", "tag", "p", role.alias("role"), F.expr(f"p.start div {scope}").alias("cell")).distinct()
    )
    # A weak part that overlaps a base span is no part of its own; the two meet in a cell that both touch.
    touched = parts.select("id", "tag", "p", F.explode(F.expr(f"sequence(p.start div {scope}, (p.end - 1) div {scope})")).alias("at"))
    base = touched.where(F.col("p.rank") < weak_first).select("id", "tag", "at", F.col("p").alias("b"))
    covered = touched.where(F.col("p.rank") >= weak_first).join(base, ["id", "tag", "at"]).where("b.start < p.end AND p.start < b.end").select("id", "tag", "p").distinct()
    parts = parts.join(covered, ["id", "tag", "p"], "left_anti")
    cells = parts.groupBy("id", "tag", "cell").agg(*(f(F.when(F.col("role") == r, F.col("p.start"))).alias(f"{r}_{n}") for r in ("secret", "id") for n, f in (("first", F.min), ("last", F.max))))
    near = parts.where(F.col("p.rank") >= weak_first).select("id", "tag", "p", F.explode(F.expr("array(cell - 1, cell, cell + 1)")).alias("cell"))
    met = near.join(cells, ["id", "tag", "cell"])
    within = lambda r: F.coalesce(F.bool_or((F.abs(F.col(f"{r}_first") - F.col("p.start")) <= scope) | (F.abs(F.col(f"{r}_last") - F.col("p.start")) <= scope)), F.lit(False))
    sides = met.groupBy("id", "tag", "p").agg(within("secret").alias("has_secret"), within("id").alias("has_id"))
    rank = F.col("p.rank")
    complement = F.when(rank == KINDS.index("key"), F.col("has_id")).when(rank == KINDS.index("id"), F.col("has_secret")).otherwise(F.col("has_id") & F.col("has_secret"))
    return sides.where(complement).groupBy("id", "tag").agg(F.array_sort(F.collect_set("p")).alias("linked"))


def scan_secrets(spark: SparkSession, docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of docs: doc_id, id, tag, base and all spans (arrays of start, rank of kind, end)."""
    scratch = Scratch(spark)
    found = scratch.table(found_spans(docs), "found")
    linked = scratch.table(linked_parts(found, scope), "linked")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.expr(f"cast(array() AS {_SPANS})"))))
    return found.join(linked, ["id", "tag"], "left").select("doc_id", "id", "tag", "base", spans.alias("spans"))


def _listed(spans: str) -> Column:
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at({kinds}, s.rank + 1), ':', s.start, ':', s.end)), ',')")


def redacted(spark: SparkSession, docs: DataFrame, mark: str = REDACTED, block: int = BLOCK) -> DataFrame:
    """docs with every span replaced by the mark, overlapping spans by one; n_chars, where present, follows."""
    scratch = Scratch(spark)
    spans = scratch.table(scan_secrets(spark, docs).where("size(spans) > 0").select("id", "tag", "spans").groupBy("id", "tag").agg(F.first("spans").alias("spans")), "spans")
    # Spans that overlap become one stretch: it begins where no earlier span reaches.
    order = Window.partitionBy("id", "tag").orderBy("start", "end")
    each = spans.select("id", "tag", F.explode("spans").alias("s")).select("id", "tag", F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    reached = each.withColumn("fresh", (F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) <= F.col("start")).cast("int"))
    stretch = reached.withColumn("nth", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "tag", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cut = stretch.select("id", "tag", "start", "end", F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})")).alias("block"))
    inner = F.expr(f"named_struct('from', cast(greatest(0, start - block * {block}) AS int), 'to', cast(least({block}, end - block * {block}) AS int), 'mark', start div {block} = block)")
    cut = cut.groupBy("id", "tag", "block").agg(F.array_sort(F.collect_list(inner)).alias("gone"))
    # The row travels as one struct, so columns of any name keep their values.
    text = F.coalesce(quoted("text").cast("string"), F.lit(""))
    keyed = docs.select(whole_row(docs).alias("_row"), F.coalesce(quoted("doc_id").cast("long"), F.lit(-1)).alias("_id"), F.xxhash64(text).alias("_tag"))
    named = spans.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"))
    texts = keyed.join(named, ["_id", "_tag"], "left_semi").groupBy("_id", "_tag").agg(F.first("_row.text").alias("text"))
    blocks = texts.select(F.col("_id").alias("id"), F.col("_tag").alias("tag"), F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))).alias("block", "part"))
    left = F.expr(
        f"aggregate(gone, named_struct('at', 0, 'out', ''), (s, g) -> named_struct('at', g.to, 'out', concat(s.out, substring(part, s.at + 1, g.from - s.at), CASE WHEN g.mark THEN '{mark}' ELSE '' END)), "
        "s -> concat(s.out, substring(part, s.at + 1)))"
    )
    changed = blocks.join(cut, ["id", "tag", "block"], "left").select("id", "tag", "block", F.when(F.col("gone").isNull(), F.col("part")).otherwise(left).alias("part"))
    new = changed.groupBy("id", "tag").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part"))), lambda b: b["part"]), "").alias("_new"))
    new = scratch.table(new.select(F.col("id").alias("_id"), F.col("tag").alias("_tag"), "_new"), "redacted")
    out = keyed.join(new, ["_id", "_tag"], "left").select("_row", F.coalesce("_new", F.col("_row.text")).alias("_text"), F.col("_new").isNotNull().alias("_found"))
    columns = {"text": F.col("_text").alias("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_found"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars")).alias("n_chars")
    return out.select(*(columns.get(c, quoted(c, "_row").alias(c)) for c in docs.columns))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark, table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
