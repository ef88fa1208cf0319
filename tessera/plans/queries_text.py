"""Text-layer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lexicons as L
from tessera.functions import text as T
from tessera.operators import index as I
from tessera.operators import understanding as U
from tessera.plans.registry import DOCS, content, document_postings, documents, norm, query, raw, read, stem, tok
from tessera.sources.shared import spread

_SENT = "list_filter(list_transform(string_split(regexp_replace({c}, '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s, E' \\t\\n\\r')), lambda s: s <> '')"


def sent(c: str) -> str:
    return _SENT.replace("{c}", c)


@query("normalize_text", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize("text").alias("norm"))


@query("tok_term_freq", f"WITH {DOCS} SELECT domain, term, count(*) AS tf FROM (SELECT domain, unnest({tok('text')}) AS term FROM docs) GROUP BY domain, term")
def tok_term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.exploded_tokens(spread(documents(spark, sf_dir)), "text", ["domain"]).groupBy("domain", "term").agg(F.count("*").alias("tf"))


@query("stem_families", f"SELECT stem, count(*) AS words FROM (SELECT DISTINCT t, {stem('t')} AS stem FROM (SELECT unnest({content('text')}) AS t FROM documents)) GROUP BY stem HAVING count(*) > 1")
def stem_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.exploded_tokens(spread(read(spark, sf_dir, "documents")), "text", [], "t", stemmed=False).distinct()
    return t.groupBy(T.stem(F.col("t")).alias("stem")).agg(F.count("*").alias("words")).where("words > 1")


@query("sentence_split", f"SELECT doc_id, len(s)::BIGINT AS sentences, list_max(list_transform(s, lambda x: len(x)))::BIGINT AS longest FROM (SELECT doc_id, {sent('text')} AS s FROM documents)")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.sentences("text")
    return read(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


_CHUNK = f"""WITH RECURSIVE s AS (
  SELECT doc_id, x.i AS i, x.t AS t, len(regexp_extract_all(x.t, '\\S+')) AS n FROM (
    SELECT doc_id, unnest(list_transform(sent, lambda t, i: {{'i': i, 't': t}})) AS x FROM (SELECT doc_id, {sent('text')} AS sent FROM documents))
), walk AS (
  SELECT doc_id, i, n, 0 AS ordinal, i AS first, n AS size, false AS started FROM s WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, s.n, CASE WHEN w.size > 0 AND w.size + s.n > 70 THEN w.ordinal + 1 ELSE w.ordinal END,
    CASE WHEN w.size > 0 AND w.size + s.n > 70 THEN w.i ELSE w.first END, CASE WHEN w.size > 0 AND w.size + s.n > 70 THEN w.n + s.n ELSE w.size + s.n END, true
  FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1
), packed AS (SELECT doc_id, ordinal, min(first) AS first, max(i) AS last, max(size) AS words FROM walk GROUP BY doc_id, ordinal)
"""


@query("chunk_pack", _CHUNK + "SELECT doc_id, ordinal::BIGINT AS ordinal, (last - first + 1)::BIGINT AS sentences, words::BIGINT AS words FROM packed")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.passages("text")).alias("p"))
    return p.select("doc_id", *(F.col(f"p.{c}").cast("long").alias(c) for c in ("ordinal", "sentences", "words")))


@query("chunk_offsets_valid", "SELECT count(*) FILTER (WHERE false) AS outside FROM documents")
def chunk_offsets_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = I.passage_table(documents(spark, sf_dir)).withColumnRenamed("text", "passage").join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    flat = lambda c: F.regexp_replace(c, "(?U)\\s+", " ")
    return p.agg(F.count_if(flat(F.expr("substring(text, char_start + 1, char_end - char_start)")) != flat(F.col("passage"))).alias("outside"))


@query("chunk_spans", _CHUNK.replace("WITH RECURSIVE s AS", "WITH RECURSIVE s AS MATERIALIZED") + """, place AS (
  SELECT s.doc_id, s.i, strpos(d.text, s.t) - 1 AS a, strpos(d.text, s.t) - 1 + len(s.t) AS z FROM s JOIN documents d USING (doc_id) WHERE s.i = 1
  UNION ALL
  SELECT s.doc_id, s.i, p.z + strpos(d.text[p.z + 1:], s.t) - 1, p.z + strpos(d.text[p.z + 1:], s.t) - 1 + len(s.t) FROM place p JOIN s ON s.doc_id = p.doc_id AND s.i = p.i + 1 JOIN documents d ON d.doc_id = s.doc_id
) SELECT k.doc_id, k.ordinal::INT AS ordinal, a.a::INT AS char_start, z.z::INT AS char_end FROM packed k JOIN place a ON a.doc_id = k.doc_id AND a.i = k.first JOIN place z ON z.doc_id = k.doc_id AND z.i = k.last""")
def chunk_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each passage begins and ends in its document."""
    p = spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(T.passages("text")).alias("p"))
    return p.select("doc_id", "p.ordinal", "p.char_start", "p.char_end")


@query("passage_words", "SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS words FROM documents")
def passage_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


@query("truncate_line", "WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), h AS (SELECT doc_id, t, t[1:159] AS h FROM f), p AS (SELECT *, CASE WHEN contains(h, ' ') THEN len(h) - strpos(reverse(h), ' ') ELSE -1 END AS pos FROM h) SELECT doc_id, CASE WHEN len(t) <= 160 THEN t ELSE rtrim(CASE WHEN pos > 80 THEN h[1:pos] ELSE h END) || '…' END AS line FROM p")
def truncate_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.truncated("text", 160).alias("line"))


_NEG = "['not','never','no','cannot','prohibited','forbidden','disallowed','must-not','may-not','banned','denied','refuse','reject','rejected','withdrawn']"
_POL = f"CASE WHEN len(list_filter(regexp_extract_all(regexp_replace(regexp_replace({{n}}, '\\b(must|may|should|can|will|shall)\\s+not\\b', '\\1-not', 'g'), '\\bis\\s+not\\b|\\bare\\s+not\\b|\\bdo\\s+not\\b|\\bdoes\\s+not\\b', 'not', 'g'), '[a-z0-9]+(?:[-''][a-z0-9]+)*'), lambda t: list_contains({_NEG}, t))) % 2 = 1 THEN -1 ELSE 1 END"
POLARITY_CASES = ("You must not deploy.", "You may not never deploy.", "It is not required.", "Access shall not pass.", "Never and no.", "Deploy now.", "Requests are not denied.", "")
_POLAR = "[" + ", ".join(f"'{c}'" for c in POLARITY_CASES) + f"][((conv_id + turn) % {len(POLARITY_CASES)} + 1)::INT] || ' ' || text"


@query("polarity", "SELECT conv_id, turn, " + _POL.replace("{n}", norm(f"({_POLAR})")) + " AS polarity FROM conversations")
def polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polarity of every turn behind a statement of known polarity."""
    said = F.element_at(F.array(*map(F.lit, POLARITY_CASES)), ((F.col("conv_id") + F.col("turn")) % len(POLARITY_CASES) + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(said, F.lit(" "), "text").alias("s")).select("conv_id", "turn", T.polarity("s").alias("polarity"))


@query("polarity_documents", "SELECT polarity, count(*) AS n FROM (SELECT " + _POL.replace("{n}", norm("text")) + " AS polarity FROM documents) GROUP BY polarity")
def polarity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(T.polarity("text").alias("polarity")).agg(F.count("*").alias("n"))


@query("measurements", """WITH n AS (SELECT o_orderkey % 5 AS shape, o_custkey % 90 + 2 AS n FROM orders), m AS (
  SELECT n || ' days' AS raw, 'duration' AS family, n::DOUBLE AS base, 'log,retain' AS anchors FROM n WHERE shape = 0
  UNION ALL SELECT n || '000 eur', 'currency', n * 1000.0, 'council,need,spend' FROM n WHERE shape = 1
  UNION ALL SELECT n || '.5 hours', 'duration', (n + 0.5) / 24, 'wait' FROM n WHERE shape = 2
  UNION ALL SELECT 'two reviewers', 'people', 2.0, 'approve,independent,must,within' FROM n WHERE shape = 3
  UNION ALL SELECT n || ' weeks', 'duration', n * 7.0, 'approve,independent,must,within' FROM n WHERE shape = 3)
SELECT raw, family, round(base::DOUBLE, 6) AS base, anchors, count(*) AS n FROM m GROUP BY ALL""")
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of a sentence per order, in five shapes: whole numbers, thousands, decimals, words, and none; each different sentence is read once."""
    n = (F.col("o_custkey") % 90 + 2).cast("string")
    shapes = (("Logs are retained for ", " days."), ("Spend above ", ",000 EUR needs the council."), ("Wait ", ".5 hours."), ("Two independent reviewers must approve it within ", " weeks."), ("Version ", " is out."))
    sentence = F.element_at(F.array(*(F.concat(F.lit(a), n, F.lit(z)) for a, z in shapes)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    # explode would have empty arrays filtered before the grouping, that is, measure every row.
    rows = read(spark, sf_dir, "orders").select(sentence.alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    m = T.with_measurements(rows, "s").select(F.explode_outer("measurements").alias("m"), "n").where("m IS NOT NULL")
    return m.groupBy("m.raw", "m.family", F.round("m.base_value", 6).alias("base"), F.array_join("m.anchors", ",").alias("anchors")).agg(F.sum("n").alias("n"))


@query("version_keys", "SELECT v, list_transform(string_split(v, '.'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN p::INT ELSE 0 END)::VARCHAR AS k, count(*) AS n FROM (SELECT [p_size || '.0', p_partkey % 7 || '.' || p_size || '.3', 'x.' || p_size, 'v' || p_partkey % 5 || '.1-rc', ''][(p_partkey % 5 + 1)::INT] AS v FROM part) GROUP BY ALL")
def version_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    forms = F.array(F.concat(size, F.lit(".0")), F.concat((key % 7).cast("string"), F.lit("."), size, F.lit(".3")), F.concat(F.lit("x."), size), F.concat(F.lit("v"), (key % 5).cast("string"), F.lit(".1-rc")), F.lit(""))
    rows = read(spark, sf_dir, "part").select(F.element_at(forms, (key % 5 + 1).cast("int")).alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    return rows.select("v", F.concat(F.lit("["), F.array_join(T.version_key("v").cast("array<string>"), ", "), F.lit("]")).alias("k"), "n")


@query("parse_dates", "SELECT s, coalesce(try_cast(s AS DATE), DATE '2000-01-01') AS d, count(*) AS n FROM (SELECT [o_orderdate::DATE::VARCHAR, 'soon', strftime(o_orderdate, '%Y') || '-13-' || strftime(o_orderdate, '%d'), '', strftime(o_orderdate, '%d.%m.%Y')][(o_orderkey % 5 + 1)::INT] AS s FROM orders) GROUP BY ALL")
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda form: F.date_format("o_orderdate", form)
    forms = F.array(day("yyyy-MM-dd"), F.lit("soon"), F.concat(day("yyyy"), F.lit("-13-"), day("dd")), F.lit(""), day("dd.MM.yyyy"))
    rows = read(spark, sf_dir, "orders").select(F.element_at(forms, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return rows.select("s", T.parse_date("s").alias("d"), "n")


@query("doc_freq_idf", f"WITH {DOCS}, n AS (SELECT domain, count(*) AS n FROM docs GROUP BY domain), t AS (SELECT DISTINCT domain, doc_id, unnest({tok('text')}) AS term FROM docs), f AS (SELECT domain, term, count(*) AS df FROM t GROUP BY domain, term) SELECT f.domain, term, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf, round(greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS idf_bm25 FROM f JOIN n USING (domain)")
def doc_freq_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    df = I.term_stats(I.postings(spread(d.select("domain", "doc_id", "text")), ["domain", "doc_id"]), ["domain"])
    n = d.groupBy("domain").agg(F.count("*").alias("n"))
    return df.join(F.broadcast(n), "domain").select("domain", "term", "df", F.round(I.idf_smooth(F.col("n"), F.col("df")), 6).alias("idf"), F.round(I.idf_bm25(F.col("n"), F.col("df")), 6).alias("idf_bm25"))


TFIDF = f"""{DOCS}, n AS (SELECT count(*) AS n FROM docs), tf AS (SELECT domain, doc_id, term, count(*) AS tf FROM (SELECT domain, doc_id, unnest({tok('text')}) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), r AS (SELECT domain, doc_id, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS r FROM tf JOIN df USING (term), n),
w AS (SELECT domain, doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM r), size AS (SELECT domain, count(*) AS size FROM docs GROUP BY domain),
m AS (SELECT domain, term, sum(w) / any_value(size) AS w FROM w JOIN size USING (domain) GROUP BY domain, term), c AS (SELECT domain, term, w / sqrt(sum(w * w) OVER (PARTITION BY domain)) AS w FROM m)"""


def unit_weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, term statistics with n, unit weights): over postings that are written once."""
    d, post = document_postings(spark, sf_dir)
    stats = I.term_stats(post, []).crossJoin(F.broadcast(d.agg(F.count("*").alias("n"))))
    return d, stats, I.tfidf(post, stats, F.col("n"), ["domain", "doc_id"], [])


@query("tfidf_unit_weights", f"WITH {TFIDF} SELECT doc_id, term, round(w, 6) AS w FROM w")
def tfidf_unit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit weight of every document."""
    return unit_weights(spark, sf_dir)[2].select("doc_id", "term", F.round("w", 6).alias("w"))


@query("tfidf_all_unit_weights", f"WITH {TFIDF} SELECT doc_id, term, round(w, 6) AS w FROM w")
def tfidf_all_unit_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as tfidf_unit_weights, which once gave the larger weights only."""
    return tfidf_unit_weights(spark, sf_dir)


@query("domain_centroid", f"WITH {TFIDF} SELECT domain, term, round(w, 6) AS w FROM c")
def domain_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, _, weights = unit_weights(spark, sf_dir)
    return I.centroids(weights, d).select("domain", "term", F.round("w", 6).alias("w"))


@query("query_domain_cosine", f"WITH {TFIDF}, qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({tok('text')}) AS term FROM benchmark) GROUP BY ALL), qr AS (SELECT item_id, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS r FROM qt JOIN df USING (term), n), qw AS (SELECT item_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY item_id)) AS q FROM qr) SELECT item_id, domain, round(sum(q * w), 6) AS similarity FROM qw JOIN c USING (term) GROUP BY item_id, domain")
def query_domain_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, stats, weights = unit_weights(spark, sf_dir)
    q = I.tfidf(I.postings(read(spark, sf_dir, "benchmark"), ["item_id"]), stats, F.col("n"), ["item_id"], []).withColumnRenamed("w", "q")
    return q.join(I.centroids(weights, d), "term").groupBy("item_id", "domain").agg(F.round(F.sum(F.col("q") * F.col("w")), 6).alias("similarity"))


@query("clause_split")
def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(U.clauses("text")).alias("n", "clause"))


#: What the questions of intent_and_clauses begin with.
ASKED = ("What's the process for deploying a new service", "Why is the api slow", "Who can approve the vendor contract", "build or buy a cache", "what is a dpia", "tell me everything")
_BREAKS = [b for b in L.CLAUSE_SPLITTERS if "(?=" not in b]  # a text has no question mark here
_INTENT = "CASE " + " ".join("WHEN " + " OR ".join("contains(x, '{}')".format(c.replace("'", "''")) for c in cues) + f" THEN '{name}'" for name, cues in L.INTENTS) + f" ELSE '{L.DEFAULT_INTENT}' END"


@query("intent_and_clauses", f"""WITH q AS (SELECT item_id, [{', '.join("'" + a.replace("'", "''") + "'" for a in ASKED)}][(item_id % {len(ASKED)} + 1)::INT] || '; ' || regexp_replace(replace(text, '?', '.'), '\\.\\s*', '; ', 'g') AS q FROM benchmark),
c AS (SELECT item_id, {norm('q')} AS x, list_filter(list_transform(string_split_regex(q, '(?i){'|'.join(_BREAKS)}'), lambda p: regexp_replace(p, '^[ ,;?]+|[ ,;?]+$', '', 'g')), lambda p: p <> '') AS parts FROM q)
SELECT item_id, {_INTENT} AS intent, list_reduce(parts, lambda a, p: a || CASE WHEN len(regexp_extract_all(p, '\\S+')) < 4 THEN ' ' ELSE '|' END || p) AS clauses FROM c""")
def intent_and_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent and clauses of a question per benchmark text, whose sentences are its clauses; short ones join the one before."""
    opening = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("item_id") % len(ASKED) + 1).cast("int"))
    q = F.concat(opening, F.lit("; "), F.regexp_replace(F.replace(F.col("text"), F.lit("?"), F.lit(".")), "\\.\\s*", "; "))
    rows = read(spark, sf_dir, "benchmark").select("item_id", q.alias("q"))
    return rows.select("item_id", U.intent("q").alias("intent"), F.array_join(U.clauses("q"), "|").alias("clauses"))


@query("duplicate_sentences", f"SELECT sentence, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({sent('text')}) AS sentence FROM documents) GROUP BY sentence HAVING count(DISTINCT doc_id) > 1")
def duplicate_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.sentences("text")).alias("sentence"))
    return s.groupBy("sentence").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents")).where("documents > 1")


@query("raw_token_counts", f"SELECT doc_id, len({raw('text')})::BIGINT AS n FROM documents")
def raw_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.raw_tokens("text")).cast("long").alias("n"))


