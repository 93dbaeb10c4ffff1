"""SQL twins of the problems' queries, where SQL can express them on whole tables in reasonable time."""

from .lookalikes import by_table

_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: pairs (a, b) of my_docs rows that share sequences of {width} tokens, counted, of likeness {least} or more
_ALIKE = r"""t AS (SELECT row_id, regexp_extract_all(regexp_replace(lower(text), '([\x{{4E00}}-\x{{9FFF}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+') AS t FROM my_docs WHERE text IS NOT NULL),
  g AS (SELECT DISTINCT row_id, unnest(list_transform(range(1, len(t) - {width} + 2), lambda i: array_to_string(t[i:i + {width} - 1], ' '))) AS s FROM t WHERE len(t) >= {width}),
  n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id),
  c AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.row_id < b.row_id GROUP BY a.row_id, b.row_id),
  alike AS (SELECT a, b FROM c JOIN n x ON x.row_id = a JOIN n y ON y.row_id = b WHERE c / (x.n + y.n - c) >= {least} - 1e-12)"""


def _vectors(tab: str, table: str, key: str) -> str:
    """Brute force: the five most similar rows of each usable one, of similarity 0.9 or more."""
    ok = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
    cosine = "list_dot_product(x.v, y.v) / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v)))"
    return f"""SELECT '{tab}' AS tab, id, other FROM (SELECT x.id, y.id AS other, round({cosine}, 6) AS s FROM (SELECT {key} AS id, vector::DOUBLE[] AS v FROM {table} WHERE {ok}) x
      JOIN (SELECT {key} AS id, vector::DOUBLE[] AS v FROM {table} WHERE {ok}) y ON x.id <> y.id WHERE round({cosine}, 6) >= 0.9) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, other) <= 5"""


def _table_form(text: str) -> str:
    """Normalisation by table alone: characters replaced one by one, the longer forms by replacement, then accents composed."""
    every = {c: f for cp in range(0x80, 0x10000) if not 0xD800 <= cp < 0xE000 and (f := by_table(c := chr(cp))) != c}
    one = {c: f for c, f in every.items() if len(f) < 2}
    kept = sorted(one, key=lambda c: one[c] == "")  # characters without a form come last: translate leaves them out
    quoted = lambda x: x.replace("'", "''")
    out = f"translate({text}, '{quoted(''.join(kept))}', '{quoted(''.join(one[c] for c in kept))}')"
    for c, f in every.items():
        out = out if len(f) < 2 else f"replace({out}, '{c}', '{quoted(f)}')"
    return f"nfc_normalize({out})"


SQL: dict[str, str] = {
    # pairs that share a sequence of four tokens, counted
    "p1_found": f"WITH {_ALIKE.format(width=4, least=0.6)} SELECT a AS row_id_a, b AS row_id_b FROM alike",
    # the lowest id that is reached over such pairs
    "p1_groups": f"""WITH RECURSIVE {_ALIKE.format(width=5, least=0.8)}, e AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
  r AS (SELECT row_id AS a, row_id AS g FROM n UNION SELECT e.b, r.g FROM r JOIN e ON e.a = r.a WHERE r.g < e.b)
  SELECT a AS row_id, min(g) AS group_id FROM r GROUP BY a""",
    "p3_found": f"""WITH f AS ({_vectors("chunk", "my_docs", "row_id")} UNION ALL {_vectors("image", "image_chunks", "image_id")})
  SELECT DISTINCT tab, least(id, other) AS id_a, greatest(id, other) AS id_b FROM f""",
    # boundaries become a control character that the texts don't hold
    "p6_found": rf"""WITH x AS (SELECT row_id, string_split_regex(regexp_replace(regexp_replace(text, '([。！？；])', '\1' || chr(1), 'g'), '([.!?;])({_BLANK})', '\1' || chr(1) || '\2', 'g'), '[\n\r\x01]') AS p FROM my_docs WHERE length(text) > 800)
  SELECT row_id, CASE WHEN list_max(list_transform(p, lambda s: length(regexp_replace(s, '^{_BLANK}+|{_BLANK}+$', '', 'g')))) > 800 THEN 'hard' ELSE 'soft' END AS kind FROM x""",
    # what any right splitting gives
    "p6_rebuilt": "SELECT row_id, md5(text) AS digest, true AS fits, true AS laps, true AS in_order FROM my_docs WHERE length(text) > 800",
    # what any right placing gives: each text with a character has a token
    "p7_placed": "SELECT doc_id, true AS whole, true AS split_as_needed, true AS fits FROM documents WHERE text <> ''",
    # the report's counts from the tables, its bounds as they must be
    "p8_bounds": r"""WITH t AS (SELECT nullif(lower(trim(source)), '') AS source, sum(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets WHERE target_share > 0 GROUP BY 1),
  d AS (SELECT nullif(lower(trim(source)), '') AS source, count(*) AS docs FROM documents WHERE text <> '' GROUP BY 1)
  SELECT t.source, target_share, max_repeats, coalesce(docs, 0) AS docs, true AS repeats_kept, true AS share_kept, true AS within_stock FROM t LEFT JOIN d ON d.source = t.source WHERE t.source IS NOT NULL""",
    # what table normalisation makes equal
    "p9_found": f"""WITH f AS (SELECT doc_id, text, {_table_form("replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))")} AS form FROM documents WHERE regexp_matches(text, '[^\\s\\x0b\\x1c-\\x1f]'))
  SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
}
