"""The registered queries and their SQL. Keys begin with the operator that they show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking
from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import images as im
from ..operators import index as ix
from ..operators import manage as mg
from ..operators import ranking as rk
from ..operators import search as se
from ..operators import store as st
from ..session import Scratch, table
from ..streaming import watch as wa

QUERY = "drainage tunnel section threshold"
DIMS = 64

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The chunk store of the test data: row_id stands for id and for the order of ingestion."""
    return table(spark, d, "my_docs").withColumns({"id": F.col("row_id"), "seq": F.col("row_id")})


def _first_vector(rows: DataFrame, id_col: str) -> list[float]:
    return [float(x) for x in rows.filter(vx.usable(F.col("vector"), DIMS)).orderBy(id_col).limit(1).first().vector]


# ---- text functions


@query(r"""SELECT row_id, len(p) AS paragraphs, coalesce(list_sum(list_transform(p, lambda x: length(x))), 0)::BIGINT AS chars FROM (
  SELECT row_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM my_docs WHERE text IS NOT NULL)""")
def t1_paragraphs(spark, d):
    p = table(spark, d, "my_docs").filter("text is not null").select("row_id", tx.paragraphs(F.col("text")).alias("p"))
    return p.select("row_id", F.size("p").cast("long").alias("paragraphs"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


#: white space as Python and Java with Unicode classes see it
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# The chunkers as recursions: a piece ends at the last sentence end within 800 characters, a chunk before the paragraph that fills it.


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _pieces_sql(units: str) -> str:
    """Common tables up to pieces (doc_id, sec, i, pos, piece) of units (doc_id, sec, prefix, text)."""
    return rf"""unit AS ({units}),
  para AS (SELECT doc_id, sec, i, {_stripped("p")} AS p FROM (SELECT doc_id, sec, unnest(string_split_regex(text, '\n{_WS}*\n')) AS p, generate_subscripts(string_split_regex(text, '\n{_WS}*\n'), 1) AS i FROM unit)),
  long AS (SELECT doc_id, sec, i, string_split(regexp_replace(p, '([。！？；!?;.]){_WS}*', '\1' || chr(1), 'g'), chr(1)) AS s FROM para WHERE length(p) > 800),
  ended AS (SELECT doc_id, sec, i, array_to_string(s, '') AS p, list_transform(range(1, len(s) + 1), lambda k: list_sum(list_transform(s[1:k], lambda x: length(x)))::BIGINT) AS ends FROM long),
  cut AS (SELECT doc_id, sec, i, 0::BIGINT AS pos, coalesce(list_max(list_filter(ends, lambda e: e > 0 AND e <= 800)), 800)::BIGINT AS stop FROM ended
    UNION ALL SELECT c.doc_id, c.sec, c.i, c.stop, coalesce(list_max(list_filter(ends, lambda e: e > c.stop AND e <= c.stop + 800)), c.stop + 800)::BIGINT FROM cut c JOIN ended e USING (doc_id, sec, i) WHERE c.stop < length(e.p)),
  pieces AS (SELECT doc_id, sec, i, 0::BIGINT AS pos, p AS piece FROM para WHERE p <> '' AND length(p) <= 800 UNION ALL SELECT c.doc_id, c.sec, c.i, c.pos, substr(e.p, c.pos + 1, c.stop - c.pos) FROM cut c JOIN ended e USING (doc_id, sec, i))"""


def _chunks_sql(units: str) -> str:
    """Common tables up to chunks (doc_id, sec, k, chunk) of such units."""
    stop = "coalesce(list_min(list_filter(range({s} + 1, len(u.p)), lambda t: length({h}) + u.upto[t + 1] - u.upto[{s} + 1] + length(u.p[t + 1]) >= 800)), len(u.p))"
    head = "(u.prefix || right(c.chunk, 400) || chr(10))"
    text = "array_to_string(u.p[{s} + 1:{t}], chr(10))"
    first, more = stop.format(s="0", h="u.prefix"), stop.format(s="c.stop", h=head)
    return rf"""{_pieces_sql(units)},
  lists AS (SELECT doc_id, sec, prefix, list({_stripped("piece")} ORDER BY i, pos) AS p FROM pieces JOIN unit USING (doc_id, sec) WHERE {_stripped("piece")} <> '' GROUP BY ALL),
  packed AS (SELECT *, list_transform(range(0, len(p) + 1), lambda k: coalesce(list_sum(list_transform(p[1:k], lambda x: length(x) + 1)), 0)::BIGINT) AS upto FROM lists),
  chunks AS (SELECT doc_id, sec, 0 AS k, {first} AS stop, {_stripped("u.prefix || " + text.format(s="0", t=first))} AS chunk FROM packed u
    UNION ALL SELECT doc_id, sec, k + 1, to_stop, {_stripped("head || " + text.format(s="from_stop", t="to_stop"))} FROM
      (SELECT u.doc_id, u.sec, u.p, c.k, c.stop AS from_stop, {more} AS to_stop, {head} AS head FROM chunks c JOIN packed u USING (doc_id, sec) WHERE c.stop < len(u.p)) u)"""


_PLAIN = "SELECT doc_id, 0 AS sec, '' AS prefix, text FROM documents WHERE text IS NOT NULL"
# lines, the headings among them, and for each the lines up to the next
_SECTIONS = rf"""line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE length(text) >= 20),
  head AS (SELECT doc_id, n, l, regexp_extract({_stripped("l")}, '^#{{1,4}}{_WS}+(.+?)(?:{_WS}+#+)?$', 1) AS title FROM line),
  numbered AS (SELECT *, (count(*) FILTER (WHERE title <> '') OVER (PARTITION BY doc_id ORDER BY n))::BIGINT AS sec FROM head),
  part AS (SELECT doc_id, sec, {_stripped("max(title)")} AS title, {_stripped("string_agg(l, chr(10) ORDER BY n)")} AS body FROM numbered GROUP BY doc_id, sec),
  many AS (SELECT doc_id FROM part GROUP BY doc_id HAVING max(sec) >= 2)"""
_TITLED = """SELECT doc_id, sec, CASE WHEN sec > 0 THEN '# ' || title || chr(10) || chr(10) ELSE '' END AS prefix, body AS text FROM part WHERE doc_id IN (FROM many) AND (sec = 0 OR length(body) > 1200)
  UNION ALL SELECT doc_id, 0, '', text FROM documents WHERE length(text) >= 20 AND doc_id NOT IN (FROM many)"""


@query(f"""WITH RECURSIVE {_pieces_sql(_PLAIN)}
  SELECT d.doc_id, count(piece) AS pieces, coalesce(max(length(piece)), 0)::BIGINT AS longest FROM documents d LEFT JOIN pieces p ON p.doc_id = d.doc_id WHERE d.text IS NOT NULL GROUP BY d.doc_id""")
def t2_split_paragraphs(spark, d):
    """Paragraphs of documents in pieces of at most 800 characters: how many, and the longest."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [[len(x) for x in chunking.split_paragraphs(t, 800)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, got), pa.int64()), pa.array([max(x, default=0) for x in got], pa.int64())], names=["doc_id", "pieces", "longest"])

    return table(spark, d, "documents").select("doc_id", "text").filter("text is not null").mapInArrow(run, "doc_id long, pieces long, longest long")


@query(f"""WITH RECURSIVE {_chunks_sql(_PLAIN + " AND length(text) >= 20")} SELECT doc_id, source, k::BIGINT AS chunk_index, chunk AS text FROM chunks JOIN documents USING (doc_id)""")
def t3_paragraph_chunks(spark, d):
    """Chunks of documents as plain texts."""
    docs = table(spark, d, "documents").withColumns({"seq": F.col("doc_id"), "markdown": F.lit(False)})
    return chunking.chunk_documents(docs, markdown_col="markdown").withColumnRenamed("seq", "doc_id")


@query(rf"""WITH RECURSIVE {_SECTIONS}, {_chunks_sql(_TITLED)},
  every AS (SELECT doc_id, sec, k, chunk FROM chunks UNION ALL SELECT doc_id, sec, 0, '# ' || title || chr(10) || chr(10) || body FROM part WHERE doc_id IN (FROM many) AND sec > 0 AND length(body) <= 1200)
  SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY sec, k) - 1 AS chunk_index, chunk AS text FROM every JOIN documents USING (doc_id)""")
def t4_markdown_chunks(spark, d):
    """Chunks of documents by their headings."""
    docs = table(spark, d, "documents").withColumns({"seq": F.col("doc_id"), "markdown": F.lit(True)})
    return chunking.chunk_documents(docs, markdown_col="markdown").withColumnRenamed("seq", "doc_id")


_CATEGORY_CASE = "CASE " + " ".join(f"WHEN contains(dirs, '{k}') THEN '{c}'" for k, c in tx.CATEGORIES) + " ELSE '' END"


@query(rf"""SELECT row_id, {_CATEGORY_CASE} AS category FROM (SELECT row_id, lower(array_to_string(list_slice(string_split_regex(source, '[/\\]'), 1, len(string_split_regex(source, '[/\\]')) - 1), '/')) AS dirs
  FROM my_docs WHERE source IS NOT NULL)""")
def t6_category(spark, d):
    return table(spark, d, "my_docs").filter("source is not null").select("row_id", tx.category_of(F.col("source")).alias("category"))


@query("SELECT row_id, left(sha256(coalesce(source, '') || chr(0) || coalesce(chunk_index, 0)::VARCHAR || chr(0) || coalesce(text, '')), 16) AS fingerprint FROM my_docs")
def t7_fingerprint(spark, d):
    return table(spark, d, "my_docs").select("row_id", tx.fingerprint(F.col("source"), F.col("chunk_index"), F.col("text")).alias("fingerprint"))


#: the first eight hex digits of the MD5 as a number
_MD5_TOP = "list_sum(list_transform(range(1, 9), lambda i: (instr('0123456789abcdef', md5(t)[i]) - 1) * CAST(16 ** (8 - i) AS BIGINT)))::BIGINT"
_LIGATURES = "text"
for _bad, _good in tx.LIGATURES.items():
    _LIGATURES = f"replace({_LIGATURES}, '{_bad}', '{_good}')"


@query(f"SELECT doc_id, md5({_LIGATURES}) AS plain, length({_LIGATURES})::BIGINT AS chars FROM documents WHERE text IS NOT NULL")
def t9_ligatures(spark, d):
    plain = tx.ligatures(F.col("text"))
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(plain.cast("binary")).alias("plain"), F.length(plain).cast("long").alias("chars"))


# spans of dollar signs lie between the parts that the same expression splits at; of a span the blanks go that stand between single letters
_SPAN = r"(?s)\$\$.+?\$\$|\$.+?\$"


@query(rf"""WITH d AS (SELECT doc_id, text, {_LIGATURES} AS plain FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, text, string_split_regex(plain, '{_SPAN}') AS parts, regexp_extract_all(plain, '{_SPAN}') AS spans FROM d),
  f AS (SELECT doc_id, text, parts, list_transform(spans, lambda x: array_to_string(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN regexp_matches(x[i], '^{_WS}$') AND i > 1
    AND regexp_matches(x[i - 1], '^[A-Za-z]$') AND NOT (i > 2 AND regexp_matches(x[i - 2], '^[A-Za-z\\]$')) AND regexp_matches(x[i + 1], '^[A-Za-z]$') AND NOT regexp_matches(x[i + 2], '^[A-Za-z]$') THEN '' ELSE x[i] END), '')) AS spans FROM s),
  j AS (SELECT doc_id, text, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(spans[i], '')), '') AS fixed FROM f)
  SELECT doc_id, fixed FROM j WHERE fixed <> text""")
def t10_math(spark, d):
    """Texts of documents whose formulas had letters set apart."""
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", "text", tx.normalize(F.col("text")).alias("fixed"))
    return docs.filter(F.col("fixed") != F.col("text")).select("doc_id", "fixed")


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?s)(\$\$.+?\$\$|\$[^$\n]+\$)', 1))::BIGINT AS formulas, len(regexp_extract_all(text, '!\[[^\]]*\]\((images/[^)]+)\)', 1))::BIGINT AS images,
  (len(regexp_extract_all(text, '\$\$')) // 2 + (len(regexp_extract_all(text, '\$')) - 2 * len(regexp_extract_all(text, '\$\$'))) // 2)::BIGINT AS by_delimiters FROM documents WHERE text IS NOT NULL""")
def t11_formulas(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", tx.formula_count(t).cast("long").alias("formulas"), F.size(tx.image_links(t)).cast("long").alias("images"), tx.formula_delimiters(t).cast("long").alias("by_delimiters"))


@query(r"""SELECT count(*) AS tokens, count(DISTINCT t) AS distinct_tokens, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)) AS t FROM documents)""")
def t15_token_stats(spark, d):
    # ids are unique: a text's first token counts the text
    t = table(spark, d, "documents").select(F.posexplode(tx.tokens(F.col("text"))).alias("at", "t"))
    words = t.groupBy("t").agg(F.count("*").alias("n"), F.sum((F.col("at") == 0).cast("long")).alias("firsts"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return words.agg(zero("n").alias("tokens"), F.count("*").alias("distinct_tokens"), zero("firsts").alias("docs"))


@query(r"""SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped, length(regexp_replace(text, '\s+', '', 'g'))::BIGINT AS dense FROM documents WHERE text IS NOT NULL""")
def t16_escape(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(tx.html_escape(t).cast("binary")).alias("escaped"), F.length(tx.compact(t)).cast("long").alias("dense"))


@query(r"SELECT row_id, CASE WHEN contains(source, '\') THEN list_extract(string_split(source, '\'), -1) ELSE list_extract(string_split(source, '/'), -1) END AS name FROM my_docs WHERE source IS NOT NULL")
def t19_basename(spark, d):
    return table(spark, d, "my_docs").filter("source is not null").select("row_id", tx.basename(F.col("source")).alias("name"))


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}]+)', 1)) AS t FROM documents), b AS (SELECT doc_id, md5_top(t) % 64 AS b, count(*) AS n FROM t GROUP BY 1, 2),
  v AS (SELECT doc_id, count(*) AS buckets, round(max(n) / sqrt(sum(n * n)), 4) AS peak FROM b GROUP BY 1)
  SELECT d.doc_id, coalesce(buckets, 1) AS buckets, coalesce(peak, 1.0) AS peak FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id""".replace("md5_top(t)", _MD5_TOP))
def t13_embedding(spark, d):
    """Vectors of documents by the default embedder: how many components aren't zero, and the largest."""
    v = table(spark, d, "documents").select("doc_id", vx.doubles(vx.embed(F.col("text"), vx.HashingEmbedder(DIMS))).alias("v"))
    return v.select("doc_id", F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("buckets"), F.round(F.array_max("v"), 4).alias("peak"))


# ---- sources


@query(r"""WITH l AS (SELECT row_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|[\n\r\f\x0b]'), lambda x: regexp_replace(x, '\s+', '', 'g')), lambda x: length(x) >= 3) AS l FROM my_docs),
  m AS (SELECT row_id, l, len(l) AS n, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS total, len(list_distinct(l)) AS k, coalesce(list_max(map_values(histogram_of.h)), 0) AS modal
        FROM l, LATERAL (SELECT list_histogram(l) AS h) histogram_of)
  SELECT row_id, CASE WHEN total < 500 THEN NOT (n = 1 AND length(l[1]) >= 30) ELSE n >= 8 AND (k <= greatest(3, n // 8) OR modal / n >= 0.85) END AS needs_ocr FROM m""".replace("coalesce(list_max(map_values(histogram_of.h)), 0)", "coalesce(list_max(list_transform(list_distinct(l), lambda d: len(list_filter(l, lambda x: x = d)))), 0)").replace(", LATERAL (SELECT list_histogram(l) AS h) histogram_of", ""))
def s7_needs_ocr(spark, d):
    return table(spark, d, "my_docs").select("row_id", tx.needs_ocr(F.col("text")).alias("needs_ocr"))


@query(r"""WITH x AS (SELECT row_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '\s+', '', 'g') AS c, coalesce(source, '') AS s FROM my_docs),
  y AS (SELECT *, CASE WHEN c <> '' THEN (length(c) - length(regexp_replace(c, '[\x{3400}-\x{9FFF}]', '', 'g'))) / length(c) >= 0.15 ELSE regexp_matches(s, '[\x{3400}-\x{9FFF}]') END AS ch FROM x)
  SELECT row_id, CASE WHEN ch THEN 'ch' ELSE 'en' END AS lang, CASE WHEN ch OR (c <> '' AND regexp_matches(t, '[\x{FFFD}\x{E000}-\x{F8FF}\x{1D400}-\x{1D7FF}]|\(cid:')) THEN 'ocr' ELSE 'auto' END AS method FROM y""")
def s10_profile(spark, d):
    p = tx.conversion_profile(F.col("text"), F.coalesce("source", F.lit("")))
    return table(spark, d, "my_docs").select("row_id", p.alias("p")).select("row_id", "p.lang", "p.method")


@query("SELECT image_id, left(sha1(concat_ws('|', image_path, coalesce(length(caption), 0)::VARCHAR, mtime_ns::VARCHAR)), 16) AS cache_key FROM image_chunks")
def s11_cache_key(spark, d):
    return table(spark, d, "image_chunks").select("image_id", tx.cache_key(F.col("image_path"), F.coalesce(F.length("caption"), F.lit(0)), F.col("mtime_ns")).alias("cache_key"))


@query("SELECT file_path AS id, range AS segment, range * 200 + 1 AS first_page, least((range + 1) * 200, chunks) AS last_page FROM (SELECT file_path, attempt, updated_at, chunks, unnest(range(0, ((chunks + 199) // 200)::BIGINT)) AS range FROM rebuild_checkpoint WHERE chunks > 0)")
def s18_page_ranges(spark, d):
    from ..sources.files import page_ranges

    return page_ranges(table(spark, d, "rebuild_checkpoint").select(F.col("file_path").alias("id"), F.col("chunks").alias("pages")))


@query("SELECT row_id, sha256(text) AS digest FROM my_docs WHERE text IS NOT NULL")
def t18_content_hash(spark, d):
    return table(spark, d, "my_docs").filter("text is not null").select("row_id", tx.content_hash(F.col("text")).alias("digest"))


@query(r"""SELECT row_id, left(regexp_replace('page-' || split_part(split_part(u, '//', 2), '/', 1), '[\\/:*?"<>|]', '_', 'g'), 80) AS source_name FROM (SELECT row_id, regexp_extract(text, 'https?://[^\s]+') AS u FROM my_docs WHERE text IS NOT NULL) WHERE u <> ''""")
def f13_host_source(spark, d):
    u = table(spark, d, "my_docs").select("row_id", F.regexp_extract("text", r"https?://[^\s]+", 0).alias("u")).filter("u <> ''")
    return u.select("row_id", tx.host_source(F.col("u")).alias("source_name"))


# ---- filters


@query("SELECT row_id, source FROM my_docs WHERE source LIKE '%notes/v_0%'")
def f1_source_like(spark, d):
    return corpus(spark, d).filter(rk.filters("notes/v_0")).select("row_id", "source")


@query("SELECT row_id FROM my_docs WHERE source LIKE '%papers%' AND category = 'paper'")
def f2_category(spark, d):
    return corpus(spark, d).filter(rk.filters("papers", "paper")).select("row_id")


@query("SELECT row_id, source FROM my_docs WHERE contains(lower(source), 'tutorial/v00/')")
def f4_source_match(spark, d):
    return corpus(spark, d).filter(st.source_match("Tutorial/V00/")).select("row_id", "source")


@query("SELECT image_id FROM image_chunks WHERE image_path LIKE '%g_l%' OR source_doc LIKE '%g_l%'")
def f7_image_filter(spark, d):
    return table(spark, d, "image_chunks").filter(im.source_filter("g_l%")).select("image_id")


@query("SELECT row_id, coalesce(source, '') AS source, coalesce(chunk_index, 0) AS chunk_index, length(coalesce(text, ''))::BIGINT AS chars FROM my_docs")
def f8_defaults(spark, d):
    return table(spark, d, "my_docs").select("row_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("chunk_index", F.lit(0).cast("long")).alias("chunk_index"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))


@query("SELECT row_id FROM my_docs WHERE length(text) >= 20")
def f11_long_enough(spark, d):
    return table(spark, d, "my_docs").filter(F.length("text") >= 20).select("row_id")


# ---- ranking

_OK = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_U = f"u AS (SELECT row_id AS id, source, category, text, chunk_index, vector::DOUBLE[] AS v FROM my_docs WHERE {_OK})"
_Q = "q AS (SELECT v AS q FROM u ORDER BY id LIMIT 1)"
_COS = "list_dot_product(v, q) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)))"
_NEAR = f"{_U}, {_Q}, near AS (SELECT id, source, category, 1 - {_COS} AS distance FROM u, q ORDER BY distance, id LIMIT 20)"


def _near(spark, d, k=20, **how):
    c = corpus(spark, d)
    return rk.top_vectors(c, _first_vector(c, "row_id"), k, **how)


@query(f"WITH {_NEAR} SELECT id, round(1 - distance, 6) AS similarity FROM near")
def r1_vector_cosine(spark, d):
    return _near(spark, d).select("id", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query(f"WITH {_U}, {_Q} SELECT id, round(list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 5) AS distance FROM u, q ORDER BY list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), id LIMIT 20")
def r1_vector_l2(spark, d):
    return _near(spark, d, metric="l2").select("id", F.round("distance", 5).alias("distance"))


@query(f"WITH {_NEAR} SELECT id, round(1 - distance, 6) AS similarity FROM near WHERE source LIKE '%a%' AND category = 'note'")
def r1_postfilter(spark, d):
    return _near(spark, d, where=rk.filters("a", "note")).select("id", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query(f"WITH {_U}, {_Q} SELECT id, round({_COS}, 6) AS similarity FROM u, q WHERE source LIKE '%a%' AND category = 'note' ORDER BY 1 - {_COS}, id LIMIT 20")
def r1_prefilter(spark, d):
    return _near(spark, d, where=rk.filters("a", "note"), prefilter=True).select("id", F.round(1 - F.col("distance"), 6).alias("similarity"))


def _bm25_sql(where: str = "true") -> str:
    terms = QUERY.split()
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(terms))
    df = ", ".join(f"sum((f{i} > 0)::INT) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms)))
    hit = " + ".join(f"f{i}" for i in range(len(terms)))
    return rf"""tok AS (SELECT row_id AS id, source, category, chunk_index, text, regexp_extract_all(lower(coalesce(text, '')), '([\p{{L}}\p{{N}}]+)', 1) AS t FROM my_docs),
  tf AS (SELECT id, source, category, chunk_index, text, len(t) AS len, {tf} FROM tok), st AS (SELECT count(*) AS n, avg(len) AS mean, {df} FROM tf),
  hits AS (SELECT id, source, category, chunk_index, text, {score} AS bm25 FROM tf, st WHERE {hit} > 0 AND {where} ORDER BY bm25 DESC, id LIMIT 20)"""


@query(f"WITH {_bm25_sql()} SELECT id, round(bm25, 6) AS bm25 FROM hits")
def r2_bm25(spark, d):
    return rk.top_bm25(corpus(spark, d), QUERY, 20).select("id", F.round("bm25", 6).alias("bm25"))


_FILTER = "source LIKE '%a%' AND category = 'note'"


@query(f"WITH {_bm25_sql(_FILTER)} SELECT id, round(bm25, 6) AS bm25 FROM hits")
def r2_bm25_filtered(spark, d):
    return rk.top_bm25(corpus(spark, d), QUERY, 20, where=rk.filters("a", "note")).select("id", F.round("bm25", 6).alias("bm25"))


_LISTS = f"""{_NEAR}, {_bm25_sql()}, vl AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM near), tl AS (SELECT id, row_number() OVER (ORDER BY bm25 DESC, id) AS rank FROM hits)"""
_FUSED = f"{_LISTS}, fused AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM vl UNION ALL SELECT * FROM tl) GROUP BY id)"


def hybrid(spark, d, **how) -> se.Found:
    c = corpus(spark, d)
    return se.search(c, QUERY, _first_vector(c, "row_id"), 20, "hybrid", **how)


@query(f"WITH {_FUSED} SELECT id, round(score, 4) AS score FROM fused ORDER BY score DESC, id LIMIT 20")
def r4_rrf_hybrid(spark, d):
    return hybrid(spark, d, use_reranker=False).rows.select("id", F.col("relevance_score").alias("score"))


_SCORE = r"len(list_intersect(list_distinct(regexp_extract_all(lower(left(coalesce(m.text, ''), 1024)), '([\p{L}\p{N}]+)', 1)), ['drainage', 'section', 'threshold', 'tunnel'])) / 4.0"
_MERGED = f"{_LISTS}, f AS (SELECT id, min(b * 1000 + rank) AS o FROM (SELECT id, 0 AS b, rank FROM vl UNION ALL SELECT id, 1, rank FROM tl) GROUP BY id), pos AS (SELECT id, row_number() OVER (ORDER BY o) AS position FROM f)"


@query(f"WITH {_MERGED} SELECT pos.id, position, CASE WHEN position <= 32 THEN round({_SCORE}, 4) ELSE 0.0 END AS score FROM pos JOIN my_docs m ON m.row_id = pos.id")
def r5_rerank(spark, d):
    c, scratch = corpus(spark, d), Scratch(spark, "rerank")
    near = scratch.save(rk.top_vectors(c, _first_vector(c, "row_id"), 20).select("id", "text", "distance"), "near")
    hits = scratch.save(rk.top_bm25(c, QUERY, 20).select("id", "text", "bm25"), "hits")
    order = rk.merged(rk.ranked(near, "distance", "id"), rk.ranked(hits, F.desc("bm25"), "id"))
    texts = near.select("id", "text").unionByName(hits.select("id", "text")).dropDuplicates(["id"])
    return rk.rerank(texts.join(order, "id"), QUERY).select("id", "position", F.round("score", 4).alias("score"))


@query(f"WITH {_U}, {_Q} SELECT id, round({_COS}, 4) AS similarity, replace(left(coalesce(text, ''), 200), chr(10), ' ') || '...' AS snippet FROM u, q ORDER BY 1 - {_COS}, id LIMIT 6")
def r10_similar(spark, d):
    return _near(spark, d, 6).select("id", F.round(1 - F.col("distance"), 4).alias("similarity"), tx.one_line(F.coalesce("text", F.lit(""))).alias("snippet"))


_IMG = f"u AS (SELECT image_id AS id, image_path, source_doc, vector::DOUBLE[] AS v FROM image_chunks WHERE {_OK})"


@query(f"WITH {_IMG}, {_Q} SELECT id, image_path, round(greatest(0, {_COS}), 4) AS similarity FROM u, q WHERE image_path LIKE '%a%' OR source_doc LIKE '%a%' ORDER BY 1 - {_COS}, id LIMIT 8")
def r11_images(spark, d):
    images = table(spark, d, "image_chunks")
    return im.top_images(images, _first_vector(images, "image_id"), 8, "a").select("id", "image_path", "similarity")


@query(f"WITH {_U}, q5 AS (SELECT id AS query_id, v AS q FROM u ORDER BY id LIMIT 5), s AS (SELECT query_id, id, {_COS} AS sim FROM u, q5), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS rank FROM s) SELECT query_id, id, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 10")
def r12_batch(spark, d):
    c = corpus(spark, d).filter(vx.usable(F.col("vector"), DIMS))
    five = c.orderBy("id").limit(5).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return rk.batch_top(c, five, 10).select("query_id", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_IMG}, l AS (SELECT id AS label, v AS q FROM u ORDER BY id LIMIT 8), s AS (SELECT u.id, label, {_COS} AS sim FROM u, l), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, label) AS k FROM s) SELECT id, label, round(sim, 6) AS similarity FROM r WHERE k = 1")
def r13_argmax(spark, d):
    images = table(spark, d, "image_chunks").filter(vx.usable(F.col("vector"), DIMS)).withColumnRenamed("image_id", "id")
    labels = images.orderBy("id").limit(8).select(F.col("id").alias("label"), F.col("vector").alias("label_vector"))
    return im.best_labels(images, labels).select("id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_bm25_sql()} SELECT '[' || row_number() OVER (ORDER BY bm25 DESC, id)::VARCHAR || ']' AS cite, coalesce(source, '') AS source, coalesce(chunk_index, 0) AS chunk_index, coalesce(category, '') AS category, coalesce(text, '') AS text FROM hits ORDER BY bm25 DESC, id LIMIT 5")
def r14_evidence(spark, d):
    return se.evidence_rows(se.search(corpus(spark, d), QUERY, limit=5, mode="fts").rows)


@query(r"""WITH x AS (SELECT row_id, text, left(text, 500) AS cut FROM my_docs WHERE text IS NOT NULL),
  y AS (SELECT *, greatest(CASE WHEN contains(cut, '. ') THEN 500 - instr(reverse(cut), ' .') - 0 ELSE 0 END, CASE WHEN contains(cut, '。') THEN 501 - instr(reverse(cut), '。') ELSE 0 END,
    CASE WHEN contains(cut, chr(10)) THEN 501 - instr(reverse(cut), chr(10)) ELSE 0 END, CASE WHEN contains(cut, ' ') THEN 501 - instr(reverse(cut), ' ') ELSE 0 END) AS last FROM x)
  SELECT row_id, CASE WHEN length(text) > 500 THEN (CASE WHEN last > 201 THEN left(cut, last) ELSE cut END) || '...' ELSE text END AS snippet FROM y""")
def r15_snippets(spark, d):
    return table(spark, d, "my_docs").filter("text is not null").select("row_id", tx.snippet(F.col("text")).alias("snippet"))


@query("""WITH s AS (SELECT DISTINCT source FROM my_docs WHERE contains(replace(lower(source), 'ß', 'ss'), 'manuals/v00') ORDER BY source LIMIT 5)
  SELECT source, count(*) AS chunks, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY chunk_index, row_id)) AS digest FROM my_docs JOIN s USING (source) GROUP BY source""")
def r17_reassemble(spark, d):
    out = mg.reassemble(corpus(spark, d), mg.casefold_match("Manuals/v00"))
    return out.select("source", "chunks", F.md5(F.col("text").cast("binary")).alias("digest"))


# ---- listings


@query("SELECT count(*) AS n, count(DISTINCT source) AS sources FROM my_docs")
def a1_counts(spark, d):
    return table(spark, d, "my_docs").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("SELECT DISTINCT source FROM my_docs")
def a2_sources(spark, d):
    return table(spark, d, "my_docs").select("source").distinct()


_COUNTS = "SELECT source, count(*) AS chunks, arg_min(coalesce(category, ''), row_id) AS category, min(row_id) AS first_seq FROM my_docs GROUP BY source"


@query(_COUNTS)
def a3_doc_counts(spark, d):
    return mg.document_counts(corpus(spark, d))


@query("SELECT category, count(*) AS n FROM my_docs WHERE category <> '' GROUP BY category")
def a4_category_counts(spark, d):
    return mg.category_counts(corpus(spark, d))


@query(f"SELECT source, chunks, category FROM ({_COUNTS}) WHERE lower(category) = 'paper' ORDER BY chunks DESC, first_seq LIMIT 50")
def a5_listing(spark, d):
    return mg.listing(corpus(spark, d), "Paper", 50)


@query("SELECT count(*) AS rows, (count(DISTINCT source) + max((source IS NULL)::INT))::BIGINT AS documents, count(vector) AS with_vector, max(ingested_at) AS last_ingested FROM my_docs")
def a6_status(spark, d):
    return mg.status(corpus(spark, d))


_LAST = "SELECT * FROM rebuild_checkpoint QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY attempt DESC NULLS LAST, updated_at DESC NULLS LAST, status NULLS FIRST, chunks DESC NULLS LAST) = 1"


@query(f"SELECT status, count(*) AS files, sum(CASE WHEN chunks > 0 THEN chunks ELSE 0 END)::BIGINT AS chunks FROM ({_LAST}) GROUP BY status")
def a9_run_summary(spark, d):
    return mg.run_summary(table(spark, d, "rebuild_checkpoint"))


# ---- changes


@query(f"SELECT DISTINCT file_path FROM rebuild_checkpoint WHERE file_path NOT IN (SELECT file_path FROM ({_LAST}) WHERE status IN ('done', 'empty') AND file_path IS NOT NULL)")
def w16_pending(spark, d):
    c = table(spark, d, "rebuild_checkpoint")
    return mg.pending_files(c.select("file_path").filter("file_path is not null").distinct(), c)


@query("""SELECT count(*) AS files, count(*) FILTER (WHERE length(coalesce(text, '')) < 20) AS short, coalesce(sum(length(text)) FILTER (WHERE length(text) >= 20), 0)::BIGINT AS chars,
  (coalesce(sum(length(text)) FILTER (WHERE length(text) >= 20), 0) // 800 + count(*) FILTER (WHERE length(text) >= 20))::BIGINT AS chunks FROM documents""")
def w17_estimate(spark, d):
    return mg.estimate(table(spark, d, "documents"))


@query("SELECT row_id, doc_id FROM my_docs WHERE coalesce(trim(doc_id), '') = '' UNION ALL SELECT min(row_id), doc_id FROM my_docs WHERE trim(doc_id) <> '' GROUP BY doc_id")
def w9_keep_first(spark, d):
    return st.keep_first(corpus(spark, d)).select("row_id", "doc_id")


@query("SELECT row_id, doc_id FROM my_docs WHERE coalesce(trim(doc_id), '') = '' OR doc_id NOT IN (SELECT doc_id FROM my_docs WHERE trim(doc_id) <> '' GROUP BY doc_id HAVING count(*) > 1)")
def w9_purge(spark, d):
    return st.purge_repeated(corpus(spark, d)).select("row_id", "doc_id")


@query("SELECT source, count(*) AS chunks FROM chunk_batches b WHERE source IS NULL OR source NOT IN (SELECT source FROM my_docs WHERE source IS NOT NULL) GROUP BY source")
def j1_new_sources(spark, d):
    return st.new_sources(table(spark, d, "chunk_batches"), table(spark, d, "my_docs")).groupBy("source").agg(F.count("*").alias("chunks"))


@query("SELECT image_path, max(mtime_ns) AS mtime_ns FROM image_chunks GROUP BY image_path HAVING min(mtime_ns) IS DISTINCT FROM max(mtime_ns)")
def j3_changed_images(spark, d):
    """Against each path's first time as stored: paths that were stored again with another time."""
    g = table(spark, d, "image_chunks").filter("image_path is not null").groupBy("image_path")
    return st.changed_images(g.agg(F.max("mtime_ns").alias("mtime_ns")), g.agg(F.min("mtime_ns").alias("mtime_ns")))


_NAME = r"lower(CASE WHEN contains(source, '\') THEN list_extract(string_split(source, '\'), -1) ELSE list_extract(string_split(source, '/'), -1) END)"


@query(f"WITH n AS (SELECT DISTINCT {_NAME} AS name FROM chunk_batches WHERE source IS NOT NULL), k AS (SELECT source FROM my_docs WHERE source IS NULL OR {_NAME} NOT IN (SELECT name FROM n) UNION ALL SELECT source FROM chunk_batches) SELECT source, count(*) AS chunks FROM k GROUP BY source")
def w6_update(spark, d):
    """Rows by source after the files of chunk_batches took the place of stored ones of their names."""
    old, new = table(spark, d, "my_docs"), table(spark, d, "chunk_batches")
    name = F.lower(tx.basename(F.col("source"))).alias("name")
    kept = old.select("source", name).join(new.select(name).filter("name is not null").distinct(), "name", "left_anti").select("source")
    return kept.unionByName(new.select("source")).groupBy("source").agg(F.count("*").alias("chunks"))


@query("SELECT row_id FROM my_docs WHERE source IS NULL OR NOT contains(lower(source), 'misc')")
def w7_delete(spark, d):
    return corpus(spark, d).filter(~F.coalesce(st.source_match("MISC"), F.lit(False))).select("row_id")


@query(f"WITH {_bm25_sql()} SELECT id, round(bm25, 6) AS bm25 FROM hits")
def w11_postings(spark, d):
    """BM25 from a stored postings index."""
    index = ix.PostingsIndex(spark, Scratch(spark, "postings").root, 16)
    index.append(corpus(spark, d).select("id", "text"))
    return index.search(QUERY, 20).select("id", F.round("bm25", 6).alias("bm25"))


def _store_index(spark, d) -> ix.StoreIndex:
    store = st.Store(spark, Scratch(spark, "store").root, buckets=8)
    rows = table(spark, d, "my_docs").select("text", "vector", "source", "chunk_index", "category", "doc_id", "ingested_at", F.col("row_id").alias("seq"))
    store.append(rows)
    index = ix.StoreIndex(store, DIMS)
    index.refresh()
    return index


@query(f"WITH {_bm25_sql()} SELECT row_number() OVER (ORDER BY bm25 DESC) AS rank, round(bm25, 6) AS bm25 FROM hits")
def r2_from_index(spark, d):
    """The scores of the 20 best rows from the index of a store."""
    hits = _store_index(spark, d).text_hits(QUERY, 20)
    return hits.select(F.row_number().over(Window.orderBy(F.desc("bm25"))).cast("long").alias("rank"), F.round("bm25", 6).alias("bm25"))


@query(f"WITH {_bm25_sql().replace('FROM my_docs)', "FROM my_docs WHERE source IS NULL OR NOT contains(lower(source), 'a'))")} SELECT row_number() OVER (ORDER BY bm25 DESC) AS rank, round(bm25, 6) AS bm25 FROM hits")
def r2_from_index_after_delete(spark, d):
    """The same after rows were deleted: what was indexed before stays, the new version's folders are added."""
    index = _store_index(spark, d)
    index.store.replace(st.source_match("a"))
    index.refresh()
    hits = index.text_hits(QUERY, 20)
    return hits.select(F.row_number().over(Window.orderBy(F.desc("bm25"))).cast("long").alias("rank"), F.round("bm25", 6).alias("bm25"))


@query(f"WITH {_NEAR} SELECT row_number() OVER (ORDER BY distance) AS rank, round(1 - distance, 6) AS similarity FROM near")
def r1_from_index(spark, d):
    """The similarities of the 20 nearest rows from the index of a store, all its cells read."""
    near = _store_index(spark, d).vector_hits(_first_vector(corpus(spark, d), "row_id"), 20, probes=1 << 20)
    return near.select(F.row_number().over(Window.orderBy("distance")).cast("long").alias("rank"), F.round(1 - F.col("distance"), 6).alias("similarity"))


@query("SELECT true AS recalled, count(*) AS queries FROM my_docs WHERE row_id % 100 = 0 AND " + _OK)
def w10_recall(spark, d):
    """Whether the cell index finds nine in ten of the 20 nearest rows, at its own number of cells read, of all rows whose id is divisible by 100."""
    c = corpus(spark, d).filter(vx.usable(F.col("vector"), DIMS))
    asked = c.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    index = ix.CellIndex(spark, Scratch(spark, "cells").root, DIMS)
    index.build(c.select("id", "vector"))
    found = index.search_many(asked, 20).select("query_id", "id")
    want = rk.batch_top(c, asked, 20).select("query_id", "id")
    hit = want.join(found.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg((F.count("hit") >= 0.9 * F.count("*")).alias("recalled"))
    return hit.crossJoin(asked.agg(F.count("*").alias("queries")))  # a row each


@query()
def w10_cells(spark, d):
    """The 20 nearest rows from a stored cell index."""
    c = corpus(spark, d)
    index = ix.CellIndex(spark, Scratch(spark, "cells").root, DIMS)
    index.build(c.select("id", "vector"))
    return index.search(_first_vector(c, "row_id"), 20).select("id", F.round("similarity", 6).alias("similarity"))


@query("""SELECT coalesce(category, '') AS category, count(*) AS n, count(DISTINCT source) AS sources FROM (
  SELECT source, category FROM my_docs WHERE source IS NULL OR NOT contains(lower(source), 'misc') UNION ALL SELECT source, category FROM chunk_batches) GROUP BY 1""")
def w7_store_cycle(spark, d):
    """A store that takes my_docs, loses what matches a pattern and takes chunk_batches in the same version, then is compacted."""
    store = st.Store(spark, Scratch(spark, "store").root, buckets=8)
    rows = lambda t, v: t.select("text", v.alias("vector"), "source", "chunk_index", "category", "doc_id", "ingested_at", F.col("row_id").alias("seq"))
    store.append(rows(table(spark, d, "my_docs"), F.col("vector")))
    store.replace(st.source_match("misc"), rows(table(spark, d, "chunk_batches"), F.lit(None).cast("array<float>")))
    store.compact()
    return store.read().groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


# ---- changes of files

_EXCLUDED = " AND ".join(f"NOT contains(target, '{n}')" for n in wa.EXCLUDED_DIRS)
_EXT = ", ".join(f"'{x}'" for x in wa.TEXT_EXTENSIONS)
_RELEVANT = rf"""SELECT * FROM (SELECT *, lower(trim(change_kind)) AS kind, replace(CASE WHEN lower(trim(change_kind)) = 'moved' THEN nullif(trim(dest_path), '') ELSE file_path END, '\', '/') AS target FROM watch_events)
  WHERE kind IN ('created', 'modified', 'moved') AND target IS NOT NULL AND lower(regexp_extract(target, '(\.[^./\\]*)$', 1)) IN ({_EXT}) AND {_EXCLUDED}"""


@query(f"""WITH RECURSIVE r AS ({_RELEVANT}), e AS (SELECT event_no, target, epoch_us(happened_at) AS t, kind = 'moved' AS m, row_number() OVER (PARTITION BY target ORDER BY happened_at, event_no) AS k FROM r WHERE happened_at IS NOT NULL),
  s AS (SELECT event_no, target, k, true AS ok, CASE WHEN m THEN NULL ELSE t END AS last FROM e WHERE k = 1
    UNION ALL SELECT e.event_no, e.target, e.k, e.m OR s.last IS NULL OR e.t - s.last > 5000000, CASE WHEN NOT e.m AND (s.last IS NULL OR e.t - s.last > 5000000) THEN e.t ELSE s.last END FROM s JOIN e ON e.target = s.target AND e.k = s.k + 1)
  SELECT event_no, target FROM s WHERE ok""")
def e2_debounce(spark, d):
    return wa.debounce(wa.relevant(table(spark, d, "watch_events"))).select("event_no", "target")


@query(f"SELECT event_no, kind, target FROM ({_RELEVANT})")
def e3_relevant(spark, d):
    return wa.relevant(table(spark, d, "watch_events")).select("event_no", "kind", "target")


@query(f"SELECT target, count(*) AS moves FROM ({_RELEVANT}) WHERE kind = 'moved' GROUP BY target")
def e4_moves(spark, d):
    return wa.relevant(table(spark, d, "watch_events")).filter("kind = 'moved'").groupBy("target").agg(F.count("*").alias("moves"))


@query("SELECT coalesce(lower(trim(change_kind)), '') AS kind, count(*) AS n FROM watch_events GROUP BY 1")
def e5_kinds(spark, d):
    return wa.event_counts(table(spark, d, "watch_events"))


# ---- plain relational work


@query("""SELECT n_name AS nation, count(*) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY n_name""")
def x1_revenue(spark, d):
    li = table(spark, d, "lineitem").filter("l_shipdate >= timestamp '1995-01-01'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o, c, n = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation")
    x = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("lines"), F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT l_suppkey AS supplier, l_orderkey AS order_no, l_linenumber AS line FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def x2_top_lines(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    x = table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).filter("r <= 3")
    return x.select(F.col("l_suppkey").alias("supplier"), F.col("l_orderkey").alias("order_no"), F.col("l_linenumber").alias("line"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search with reranking."""
    return hybrid(spark, d).rows
