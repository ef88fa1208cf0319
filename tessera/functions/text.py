"""Text functions as Spark columns: normalising, tokens, stems, sentences, passages, quantities, polarity.

All are built-in expressions that stay in the JVM. Accents go by a translate()
table made from Unicode's own decompositions; `normalize_exact` is the Arrow
function for texts with ligatures and other characters that decompose into several.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.sources.shared import Scratch


def _accents() -> tuple[str, str]:
    """Characters of Latin blocks and compatibility forms whose decomposition is one base character and marks."""
    source, target = [], []
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _accents()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _set(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize(c: Column | str) -> Column:
    """Accents off, white space to single spaces, trimmed, lower case."""
    plain = F.regexp_replace(F.translate(_col(c), _FROM, _TO), "\\p{Mn}+", "")
    return F.lower(F.trim(F.regexp_replace(plain, "(?U)\\s+", " ")))


def normalize_exact(c: Column | str) -> Column:
    """The same for every character that decomposes, ligatures included; an Arrow function."""

    def run(s: pd.Series) -> pd.Series:
        plain = s.str.normalize("NFKD").map(lambda t: None if t is None else "".join(x for x in t if not unicodedata.combining(x)))
        return plain.str.split().str.join(" ").str.lower()

    return F.pandas_udf(run, "string")(_col(c))


def stem(t: Column) -> Column:
    """The first suffix that fits and leaves enough of the word goes: ies to y, sses, ing, ed, s."""
    n = F.length(t)
    out = t
    for suffix, put in reversed((("ies", "y"), ("sses", ""), ("ing", ""), ("ed", ""), ("s", ""))):
        cut = F.concat(t.substr(F.lit(1), n - len(suffix)), F.lit(put))
        out = F.when(F.endswith(t, F.lit(suffix)) & (n > len(suffix) + 2), cut).otherwise(out)
    return out


def raw_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit(L.WORD), F.lit(0))


def tokens(c: Column | str, stemmed: bool = True, keep_stopwords: bool = False) -> Column:
    """Words of the normalised text in order, repeats kept; one-character words and stopwords go before stemming."""
    out = F.filter(raw_tokens(c), lambda t: F.length(t) > 1)
    if not keep_stopwords:
        out = F.filter(out, lambda t: ~t.isin(*L.STOPWORDS))
    return F.transform(out, stem) if stemmed else out


def exploded_tokens(df: DataFrame, c: Column | str, keys: list[str], out: str = "term", stemmed: bool = True) -> DataFrame:
    """keys and one row per word of `tokens`: stopwords, lengths and stems are plain columns here, not lambdas."""
    words = df.select(*keys, F.explode(raw_tokens(c)).alias(out)).where((F.length(out) > 1) & ~F.col(out).isin(*L.STOPWORDS))
    return words.withColumn(out, stem(F.col(out))) if stemmed else words


def distinct_tokens(c: Column | str) -> Column:
    """(plain, stems): the different words of `tokens`, before and after stemming, from one reading of the text."""
    words = F.filter(F.array_distinct(raw_tokens(c)), lambda t: (F.length(t) > 1) & ~t.isin(*L.STOPWORDS))
    return bound(words, lambda w: F.struct(w.alias("plain"), F.array_distinct(F.transform(w, stem)).alias("stems")))


def sentences(c: Column | str) -> Column:
    """Cut after . ! ? and before a capital or bracket; trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(_col(c), L.SENTENCE_BREAK), lambda s: F.regexp_replace(s, "(?U)^\\s+|\\s+$", "")), lambda s: s != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("(?U)\\S+"))


#: White space as (?U)\\s has it, and as \\s has it in the sentence break.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BREAK = re.compile(L.SENTENCE_BREAK.replace("\\s", "[\t-\r ]"))
_EDGES, _WORDS = re.compile(f"^[{_SPACE}]+|[{_SPACE}]+$"), re.compile(f"[^{_SPACE}]+")
#: Characters of texts whose passages are Python objects together, about.
_SLICE = 1 << 20
_PASSAGE = "array<struct<ordinal:int,text:string,char_start:int,char_end:int,sentences:int,words:int>>"


def packed_passages(text: str, target: int = 70, overlap: int = 1) -> list[tuple[int, str, int, int, int, int]]:
    """(ordinal, text, char_start, char_end, sentences, words) of one text's passages, in one run over it."""
    found, at = [], 0
    for part in _BREAK.split(text):
        sentence = _EDGES.sub("", part)
        if sentence:
            begin = max(text.find(sentence, at), 0)
            at = begin + len(sentence)
            found.append((sentence, begin, at, len(_WORDS.findall(sentence))))
    done, held, size = [], [], 0
    for x in found:
        if size > 0 and size + x[3] > target:
            done.append(held)
            held = held[-overlap:] if overlap else []
            size = sum(y[3] for y in held)
        held.append(x)
        size += x[3]
    if held and not (done and len(held) <= overlap):
        done.append(held)
    return [(k, " ".join(y[0] for y in p), p[0][1], p[-1][2], len(p), sum(y[3] for y in p)) for k, p in enumerate(done)]


def passage_arrays(column: pa.Array, target: int = 70, overlap: int = 1) -> pa.Array:
    """The passages of each text; only those of about _SLICE characters are Python objects at a time."""
    names = ("ordinal", "text", "char_start", "char_end", "sentences", "words")
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    structs, sizes, at = [], [], 0
    while at < len(column):
        flat, size = [], 0
        while at < len(column) and size < _SLICE:
            text = column[at].as_py() or ""
            found = packed_passages(text, target, overlap)
            flat += found
            sizes.append(len(found))
            size += len(text) + 1
            at += 1
        structs.append(pa.StructArray.from_arrays([pa.array([p[k] for p in flat], kind) for k, kind in enumerate(kinds)], list(names)))
    held = pa.concat_arrays(structs) if structs else pa.array([], pa.struct(list(zip(names, kinds, strict=True))))
    return pa.ListArray.from_arrays(pa.array(list(accumulate(sizes, initial=0)), pa.int32()), held, mask=column.is_null())


def passages(c: str, target: int = 70, overlap: int = 1) -> Column:
    """Array of (ordinal, text, char_start, char_end, sentences, words): sentences packed up to `target` words.

    A new passage begins with the last `overlap` sentences of the one before. A
    passage that would only repeat that overlap is not made; one that holds more is.
    Packing needs the sentence before, so it is an Arrow function, linear in the
    text; nested aggregates copy what they have gathered at every sentence.
    """

    @F.arrow_udf(_PASSAGE)
    def run(column: pa.Array) -> pa.Array:
        return passage_arrays(column, target, overlap)

    return run(F.col(c))


def with_measurements(df: DataFrame, column: str, out: str = "measurements", legacy_numbers: bool = False, window: int = 6, prefix: int = 3) -> DataFrame:
    """df with an array of (raw, value, unit, family, base_value, anchors): quantities with a unit within three words.

    Thousands and decimals such as 25,000 or 2.5 are one number; with
    legacy_numbers they fall apart at the separator. Anchors are the stems of the
    content words near the number and of the first ones of the sentence.
    """
    text = normalize(column)
    if not legacy_numbers:
        text = F.regexp_replace(text, "(?<=\\b[0-9]{1,3}),(?=[0-9]{3}\\b)", "")
        text = F.regexp_replace(text, "(?<=[0-9])\\.(?=[0-9])", "·")
    word = L.WORD if legacy_numbers else f"[0-9]+·[0-9]+|{L.WORD}"
    units = "map(" + ", ".join(f"'{u}', named_struct('family', '{f}', 'times', {m!r}D)" for u, f, m in L.UNITS) + ")"
    stop = "array(" + ", ".join(f"'{w}'" for w in L.STOPWORDS) + ")"
    numbers = "map(" + ", ".join(f"'{k}', {float(v)}D" for k, v in L.NUMBER_WORDS.items()) + ")"
    # Per word: its number, its unit and whether it can be an anchor; then one entry per number with a unit near.
    marked = (
        f"transform(__words, (t, i) -> named_struct('t', t, 'i', i, 'unit', try_element_at({units}, t), 'value', "
        f"coalesce(try_element_at({numbers}, t), CASE WHEN t RLIKE '^[0-9]+(·[0-9]+)?$' THEN cast(replace(t, '·', '.') AS double) END), "
        f"'content', NOT array_contains({stop}, t) AND length(t) > 2))"
    )
    found = (
        "transform(filter(transform(filter(__marked, x -> x.value IS NOT NULL), x -> named_struct('x', x, "
        "'u', try_element_at(filter(slice(__marked, x.i + 2, 3), y -> y.unit IS NOT NULL), 1))), m -> m.u IS NOT NULL), m -> named_struct("
        "'raw', concat(replace(m.x.t, '·', '.'), ' ', m.u.t), 'value', m.x.value, 'unit', m.u.t, 'family', m.u.unit.family, 'base_value', m.x.value * m.u.unit.times, "
        f"'anchors', transform(concat(filter(slice(__marked, greatest(m.x.i - {window} + 1, 1), least(m.x.i, {window}) + {window} + 1), y -> y.content AND y.unit IS NULL AND y.value IS NULL), "
        f"slice(filter(__marked, y -> y.content AND y.unit IS NULL AND y.value IS NULL), 1, {prefix})), y -> y.t)))"
    )
    rows = df.withColumn("__words", F.regexp_extract_all(text, F.lit(word), F.lit(0))).withColumn("__marked", F.expr(marked)).withColumn(out, F.expr(found))
    stemmed = F.transform(out, lambda m: m.withField("anchors", F.array_sort(F.array_distinct(F.transform(m["anchors"], stem)))))
    return rows.withColumn(out, stemmed).drop("__words", "__marked")


def polarity(c: Column | str) -> Column:
    """-1 where an odd number of words negates, else 1."""
    text = F.regexp_replace(normalize(c), "\\b(must|may|should|can|will|shall)\\s+not\\b", "$1-not")
    text = F.regexp_replace(text, "\\bis\\s+not\\b|\\bare\\s+not\\b|\\bdo\\s+not\\b|\\bdoes\\s+not\\b", "not")
    marks = _set(L.NEGATION_MARKERS)
    hits = F.size(F.filter(F.regexp_extract_all(text, F.lit(L.WORD), F.lit(0)), lambda t: F.array_contains(marks, t)))
    return F.when(hits % 2 == 1, -1).otherwise(1)


def with_claim_words(df: DataFrame, column: str) -> DataFrame:
    """df with tokens (each once), polarity and measurements of a text column, found once for every different text."""
    texts = df.select(column).distinct()
    words = with_measurements(texts.withColumns({"tokens": F.array_distinct(tokens(column)), "polarity": polarity(column)}), column)
    return df.join(Scratch(df.sparkSession, tidy=False).table(words, "words"), column)


def truncated(c: Column | str, limit: int) -> Column:
    """At most `limit` characters on one line, cut at a space past the middle if there is one, with an ellipsis."""
    flat = F.trim(F.regexp_replace(_col(c), "(?U)\\s+", " "))
    head = F.substring(flat, 1, limit - 1)
    at = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (at > limit // 2), head.substr(F.lit(1), at)).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def version_key(c: Column | str) -> Column:
    """Numbers of a dotted version; what is no number counts 0. Arrays compare in order."""
    return F.transform(F.split(_col(c), "\\."), lambda v: F.when(F.rlike(v, F.lit("^[0-9]+$")), v.cast("int")).otherwise(0))


def parse_date(c: Column | str) -> Column:
    """An ISO date; anything else is 2000-01-01."""
    return F.coalesce(F.try_to_date(_col(c), "yyyy-MM-dd"), F.lit("2000-01-01").cast("date"))
