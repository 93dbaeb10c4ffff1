"""Problem 5: continuous text from scanned pages.

Method. Lines of scanned rows are numbered by SQL windows. Lines at page edges whose text repeats in a source once digits are
masked (and confusable glyphs folded) are running titles; lines there with nothing but a number are page numbers. The rest is
reflowed by windows: words cut at line ends are joined, lines become paragraphs. Words are grouped by the skeleton of their
confusable glyphs: a form gives way to a more frequent one of its group that differs by known confusions, chosen by the words
beside it, then by frequency. Unless it is far more frequent, something else must speak against the form as it stands: a digit
in it, that no text but PDF ones has it, or that it leans to PDF texts and the other one is more usual beside the same words. Copies of a text don't count.
Of words of one or two letters only what stands beside them decides.

Scale. Words are counted over the whole store, in each task first; all else touches the scanned rows only, and their rare words.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, broadcast_if_small

# Glyphs and what recognition takes them for.
CONFUSED = [
    ("e", "c"), ("i", "1"), ("l", "1"), ("i", "l"), ("l", "i"), ("n", "ri"), ("u", "ii"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("s", "5"), ("o", "0"), ("t", "f"), ("e", "f"),
    ("g", "q"), ("g", "9"), ("h", "b"), ("b", "h"), ("b", "8"), ("é", "6"), ("a", "á"), ("ß", "b"), ("z", "2"), ("о", "0"), ("в", "8"), ("з", "3"), ("б", "6"), ("c", "e"), ("f", "t"), ("q", "g"), ("é", "c"), ("m", "nn"), ("ü", "ii"), ("ó", "6"), ("ö", "6"), ("ô", "6"), ("ú", "ii"),
]
MARKS = "-¬­‐"
RATIO, MOST = 30, 3
#: Page numbers that can be nothing else, wherever they stand: pages aren't always set apart.
DRESSED = r"(?iu)^(?:\[\s*\d{1,4}\s*\]|[-–—]\s*\d{1,4}\s*[-–—]|(?:page|seite|página|стр\.)\s*\d{1,4}(?:\s*/\s*\d{1,4})?|\d{1,4}\s*/\s*\d{1,4}|第\s*\d{1,4}\s*页.*)$"

_WORD = re.compile(r"[^\W_一-鿿]+(?:[-'’][^\W_一-鿿]+)*")
JAVA_WORD = r"[[\p{L}\p{M}\p{N}]&&[^一-鿿]]+(?:[-'’][[\p{L}\p{M}\p{N}]&&[^一-鿿]]+)*"
PAGE_NO = (
    r"(?iu)^(?:[\[(]\s*\d{1,5}\s*[\])]|[-–—]\s*(?:\d{1,5}|[ivxlcdm]+)\s*[-–—]|(?:page|seite|página|pagina|стр\.?|p\.|s\.|pág\.)?\s*\d{1,5}(?:\s*(?:/|of|von|de|из|sur)\s*\d{1,5})?"
    r"|第\s*\d{1,5}\s*[页頁](?:\s*[共/]\s*\d{1,5}\s*[页頁]?)?|[ivxlcdm]{1,8})$"
)


#: glyph classes of the skeleton, by script; digits stand with the letters that they are taken for
_LATIN = {**dict.fromkeys("1ilíìï!|", "l"), **dict.fromkeys("0oóòôõö", "o"), **dict.fromkeys("üúùû", "u"), **dict.fromkeys("5s", "s"), **dict.fromkeys("8bhß", "h"), **dict.fromkeys("6cefté", "c"), **dict.fromkeys("èêë", "c"), **dict.fromkeys("9gq", "g"), **dict.fromkeys("aáàâã", "a"), **dict.fromkeys("2z", "z")}
_CYRILLIC = {"0": "о", "8": "в", "3": "з", "6": "б"}
_DIGRAPHS = [("ri", "n"), ("nn", "m"), ("rn", "m"), ("ii", "u"), ("cl", "d"), ("vv", "w")]


@lru_cache(200_000)
def skeletons(word: str) -> tuple[str, ...]:
    """Skeletons of a lower-case word: its glyph classes, with and without pairs of glyphs taken for one."""
    if re.search("[а-яё]", word):
        return ("".join(_CYRILLIC.get(c, c) for c in word),)
    # none, each and all of the pairs of glyphs taken for one; a 6 may have been an e or an o
    forms = [word]
    joined = word
    for pair, one in _DIGRAPHS:
        if pair in word:
            forms.append(word.replace(pair, one))
        joined = joined.replace(pair, one)
    forms.append(joined)
    if "6" in word:
        forms += [w.replace("6", "o") for w in forms]
    return tuple(dict.fromkeys("".join(_LATIN.get(c, c) for c in w) for w in forms))


def confusions(seen: str, right: str, most: int = MOST) -> int | None:
    """The least number of known confusions that turn ``right`` into ``seen``; None if there is no way with at most ``most``."""
    ways = {0: {0: 0}}  # position in right -> position in seen -> confusions
    for i in range(len(right)):
        for j, n in ways.get(i, {}).items():
            if j < len(seen) and seen[j] == right[i]:
                at = ways.setdefault(i + 1, {})
                at[j + 1] = min(n, at.get(j + 1, 99))
            if n < most:
                for one, other in CONFUSED:
                    if right[i] == one and seen.startswith(other, j):
                        at = ways.setdefault(i + 1, {})
                        at[j + len(other)] = min(n + 1, at.get(j + len(other), 99))
    return ways.get(len(right), {}).get(len(seen))


def word_counts(df: DataFrame, text_col: str = "text", apart: Column | None = None) -> DataFrame:
    """(word, n, o): how often each lower-case word stands in all texts, and in those not ``apart``; words have inner hyphens and apostrophes, runs of Han characters aren't words."""

    def run(batches):
        n: Counter = Counter()
        o: Counter = Counter()

        def out():
            words = [w for w in n if not w.isdigit()]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (n, o))], names=["word", "n", "o"])

        for b in batches:
            for t, other in zip(b.column("text").to_pylist(), b.column("apart").to_pylist()):
                words = _WORD.findall(t.lower())
                n.update(words)
                if not other:
                    o.update(words)
            if len(n) > 1_000_000:
                yield out()
                n.clear()
                o.clear()
        yield out()

    x = df.select(F.col(text_col).alias("text"), F.coalesce(F.lit(False) if apart is None else apart, F.lit(False)).alias("apart")).filter("text is not null")
    return x.mapInArrow(run, "word string, n long, o long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("o").alias("o"))


def _without_copies(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """The rows of df without those whose text is that of a row of a lower id; hashes and ids are moved, texts aren't."""
    same = Window.partitionBy("h").orderBy("id")
    hashed = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    copies = scratch.save(hashed.withColumn("r", F.row_number().over(same)).filter("r > 1").select(F.col("id").alias(id_col)), "copies")
    return df.join(broadcast_if_small(copies), id_col, "left_anti")


def _skeleton_table(df: DataFrame) -> DataFrame:
    """df (word, n, o) with a row for each skeleton."""

    def run(batches):
        for b in batches:
            rows = [(i, s) for i, w in enumerate(b.column("word").to_pylist()) for s in skeletons(w)]
            take = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("word", "n", "o")), pa.array([s for _, s in rows], pa.string())], names=["word", "n", "o", "skeleton"])

    return df.select("word", "n", "o").mapInArrow(run, "word string, n long, o long, skeleton string")


def scanned_lines(df: DataFrame, id_col: str, text_col: str, source_col: str, scratch: Scratch) -> DataFrame:
    """(row_id, src, n, line, gap, page): the lines that aren't blank of rows that hold scanned pages; gap: a blank line comes before.

    Scanned pages are texts of `.pdf` sources whose lines are cut at the page's width: at least three lines run on without a mark
    at their end. Rows of a source of which half the rows are such count as well.
    """
    pdf = df.select(F.col(id_col).cast("long").alias("row_id"), F.replace(F.col(source_col), F.lit("\\"), F.lit("/")).alias("src"), F.col(text_col).alias("text")).filter("lower(src) like '%.pdf' and text is not null")
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "[\n\f]")
    full = F.filter(F.transform(lines, F.trim), lambda x: x != "")
    runs_on = F.size(F.filter(full, lambda x: (F.length(x) > 15) & ~x.rlike(r"[.!?。！？；;:]$|^#|^https?://")))
    seen = scratch.save(pdf.withColumn("cut", (runs_on >= 3) & (F.coalesce(F.array_max(F.transform(full, F.length)), F.lit(0)) <= 110)), "pdf")
    some = seen.groupBy("src").agg(F.avg(F.col("cut").cast("int")).alias("share")).filter("share >= 0.5").select("src", F.lit(True).alias("mostly"))
    rows = seen.join(broadcast_if_small(some), "src", "left").filter("cut or mostly")
    text = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), "\f", "\n\f\n")
    every = rows.select("row_id", "src", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    w = Window.partitionBy("row_id", "src").orderBy("n")
    blank = F.trim("line") == ""
    feed = F.col("line") == "\f"
    x = every.withColumns({"page": F.sum(feed.cast("int")).over(w), "gap": F.coalesce(F.lag(blank | feed).over(w), F.lit(True))})
    return x.filter(~blank & ~feed)


def marked_lines(lines: DataFrame) -> DataFrame:
    """Adds kind (header, pageno or body) to the lines."""
    row = Window.partitionBy("row_id", "src").orderBy("n")
    page = Window.partitionBy("row_id", "src", "page")
    t = F.trim("line")
    x = lines.withColumns(
        {
            "t": t,
            "number": t.rlike(PAGE_NO),
            "top": F.row_number().over(page.orderBy("n")),
            "bottom": F.row_number().over(page.orderBy(F.desc("n"))),
            "before": F.lag(t).over(row),
            "after": F.lead(t).over(row),
            "width": F.max(F.length("line")).over(Window.partitionBy("row_id", "src")),
        }
    )
    x = x.withColumns({"number_before": F.coalesce(F.col("before").rlike(PAGE_NO), F.lit(False)), "number_after": F.coalesce(F.col("after").rlike(PAGE_NO), F.lit(False))})
    masked = F.trim(F.regexp_replace(F.regexp_replace(F.lower("t"), r"(?<![\p{L}\p{N}])\d+(?![\p{L}\p{N}])", "#"), r"^(#|[ivxlcdm]+)\s{2,}|\s{2,}(#|[ivxlcdm]+)$", ""))
    # glyph classes, so that a misread title is still the same title
    folded = masked
    for pair, one in _DIGRAPHS:
        folded = F.replace(folded, F.lit(pair), F.lit(one))
    folded = F.translate(folded, "".join(_LATIN), "".join(_LATIN.values()))
    edge = (F.col("top") <= 2) | (F.col("bottom") <= 2) | F.col("number_before") | F.col("number_after")
    may = edge & ~F.col("number") & ~F.col("t").rlike(r"[.!?。！？；;:,，]$|^#|^https?://|^\|") & (F.length("t") <= 90) & F.col("t").rlike(r"\p{L}{3}|[一-鿿]{2}") & F.col("t").rlike(r"^(\d+\s{2,}|[ivxlcdm]+\s{2,})?[\p{Lu}一-鿿\d]")
    x = x.withColumns({"may": may, "key": F.when(may, folded)})
    repeated = x.filter("may").groupBy("src", "key").agg(F.count_distinct(F.when((F.col("top") <= 2) | F.col("number_before") | F.col("number_after"), F.col("after"))).alias("tops"), F.count_distinct(F.when((F.col("bottom") == 1) | ((F.col("bottom") == 2) & F.col("number_after")), F.col("before"))).alias("ends")).filter("tops > 1 or ends > 1").select("src", "key", F.lit(True).alias("repeated"))
    starts = r"^[\p{Lu}#一-鿿\d«„“\"(¿¡]"
    alone = (
        F.col("may") & ((F.col("top") == 1) | ((F.col("top") == 2) & F.col("number_before")) | (F.col("number_after") & F.col("before").rlike(r"[.!?。！？；;]$"))) & F.col("t").rlike(r"^(\d+\s{2,})?[\p{Lu}一-鿿]") & (F.length("t") < 0.8 * F.col("width"))
        & (F.size(F.split("t", r"\s+")) <= 9) & (F.col("number_after") | F.col("after").rlike(starts)) & ~F.col("t").rlike(r"\d.*\s{2,}.*\d|[-¬‐­]$")
    )
    x = x.join(repeated, ["src", "key"], "left").withColumn("header", F.coalesce(F.col("may") & F.col("repeated"), F.lit(False)) | F.coalesce(alone, F.lit(False)))
    x = x.withColumns({"head_before": F.coalesce(F.lag("header").over(row), F.lit(False)), "head_after": F.coalesce(F.lead("header").over(row), F.lit(False))})
    at_edge = (F.col("top") == 1) | (F.col("bottom") == 1) | F.col("head_before") | F.col("head_after")
    return x.withColumn("kind", F.when(F.col("header"), "header").when(F.col("number") & (at_edge | F.col("t").rlike(DRESSED)), "pageno").otherwise("body"))


def _count_of(words: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """counts (word, n) of the distinct words asked for."""
    asked = scratch.save(words.distinct(), "asked")
    return scratch.save(counts.join(broadcast_if_small(asked), "word", "left_semi"), "counts")


def repair(df: DataFrame, id_col: str = "row_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The findings (row_id, kind, reading) and the repaired texts (row_id, text) of the rows that hold scanned pages.

    kind is break, misread, header or pageno. Rows of other sources, null texts and null sources have no row; ids must be unique;
    other columns are ignored. Empty tables give empty results.
    """
    scratch = Scratch(df.sparkSession, "p5")
    once = _without_copies(df.select(*dict.fromkeys([id_col, text_col, source_col])), id_col, text_col, scratch)
    counts = scratch.save(word_counts(once, text_col, F.lower(source_col).endswith(".pdf")), "words")
    lines = scratch.save(marked_lines(scratch.save(scanned_lines(df, id_col, text_col, source_col, scratch), "lines")).select("row_id", "src", "n", "line", "t", "gap", "kind", "width"), "marked")
    row = Window.partitionBy("row_id").orderBy("n")
    body = lines.filter("kind = 'body'").withColumn("next", F.lead("t").over(row))
    cut = F.col("t").rlike(rf"\p{{L}}[{MARKS}]$") & F.coalesce(F.col("next").rlike(r"^\p{Ll}"), F.lit(False))
    part = r"[[\p{L}\p{M}\p{N}'’]&&[^一-鿿]]"
    body = body.withColumn("cut", cut).withColumns(
        {
            "head": F.when(F.col("cut"), F.lower(F.regexp_extract("t", rf"((?:{part}|[-])*{part})[{MARKS}]$", 1))),
            "tail": F.when(F.col("cut"), F.lower(F.regexp_extract("next", rf"^({part}+(?:-{part}+)*)", 1))),
            "mark": F.when(F.col("cut"), F.right(F.col("t"), F.lit(1))),
        }
    )
    body = scratch.save(body.withColumns({"joined": F.concat("head", "tail"), "hyphened": F.concat("head", F.lit("-"), "tail")}), "body")
    both = _count_of(body.filter("cut").select(F.explode(F.array("joined", "hyphened")).alias("word")), counts, scratch)
    n1, n2 = both.select(F.col("word").alias("joined"), F.col("n").alias("n1")), both.select(F.col("word").alias("hyphened"), F.col("n").alias("n2"))
    chosen = F.when(F.col("mark").isin("-", "‐") & (F.coalesce("n2", F.lit(0)) > F.coalesce("n1", F.lit(0))), F.col("hyphened")).otherwise(F.col("joined"))
    breaks = scratch.save(body.filter("cut").join(n1, "joined", "left").join(n2, "hyphened", "left").select("row_id", "n", chosen.alias("word"), (chosen == F.col("hyphened")).alias("own")), "breaks")

    # reflow: the text of a line goes on after a blank, after nothing (a cut word, Han characters), or in a new paragraph
    flow = body.join(breaks.select("row_id", "n", "own"), ["row_id", "n"], "left").withColumns({"last": F.lag("t").over(row), "last_own": F.lag("own").over(row), "last_cut": F.lag("cut").over(row)})
    ended = F.col("last").rlike(r"[.!?。！？；;:]$") & (F.length("last") < 0.7 * F.col("width"))
    new = F.col("last").isNull() | ((F.col("gap") | F.col("t").startswith("#") | F.col("last").startswith("#") | ended) & ~F.coalesce("last_cut", F.lit(False)))
    glue = F.when(F.coalesce("last_cut", F.lit(False)), "").when(new, "\n\n").when(F.col("last").rlike(r"[一-鿿，。、；！？（）]$") | F.col("t").rlike(r"^[一-鿿，。、；！？（）]"), "").otherwise(" ")
    own_text = F.when(F.col("cut") & ~F.coalesce("own", F.lit(False)), F.col("t").substr(F.lit(1), F.length("t") - 1)).otherwise(F.col("t"))
    flowed = flow.select("row_id", "n", F.concat(F.when(F.col("last").isNull(), "").otherwise(glue), own_text).alias("piece"))
    # one row's lines: bounded by its text
    text = scratch.save(flowed.groupBy("row_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x.piece), "").alias("text")), "flowed")

    words = text.select("row_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(JAVA_WORD), F.lit(0))).alias("at", "word"))
    beside = Window.partitionBy("row_id").orderBy("at")
    words = scratch.save(words.withColumns({"left": F.lag("word").over(beside), "right": F.lead("word").over(beside)}), "tokens")
    right = _right_forms(words, counts, scratch)
    fixes = scratch.save(_in_context(words, right).select("row_id", "word", "reading").distinct(), "fixes")

    fixed = breaks.join(fixes, ["row_id", "word"], "left").select("row_id", F.lit("break").alias("kind"), F.coalesce("reading", "word").alias("reading"))
    found = fixed.unionByName(fixes.select("row_id", F.lit("misread").alias("kind"), "reading")).unionByName(lines.filter("kind <> 'body'").select("row_id", "kind", F.col("t").alias("reading")))
    return found.distinct(), _corrected(text, fixes)


def _right_forms(words: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, reading, m, k, sure): for words of the scanned rows the more frequent forms of their skeletons, k known confusions away; sure: whatever stands beside."""
    own = _count_of(words.select("word").filter(r"word rlike '\\p{L}'"), counts, scratch)
    seen = _skeleton_table(own)
    others = scratch.save(_skeleton_table(counts.filter("n > 1").filter(r"not word rlike '[0-9]'")).select(F.col("word").alias("reading"), F.col("n").alias("m"), F.col("o").alias("mo"), "skeleton"), "others")
    # what one or two letters could be is too much: they always go by what stands beside
    sure = F.expr(f"(length(word) > 2 and (m >= {RATIO} * n or o = 0)) or word rlike '[0-9]'")
    pairs = seen.join(others, "skeleton").filter("word <> reading and m > n").filter(sure | F.expr("length(word) <= 2 or 2 * o * m <= n * mo")).select("word", "reading", "m", sure.alias("sure")).distinct()

    def run(batches):
        for b in batches:
            k = [confusions(w, r) for w, r in zip(b.column("word").to_pylist(), b.column("reading").to_pylist())]
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in ("word", "reading", "m")), pa.array(k, pa.int32()), b.column("sure")], names=["word", "reading", "m", "k", "sure"])
            yield out.filter(pa.array([x is not None for x in k]))

    return scratch.save(pairs.mapInArrow(run, "word string, reading string, m long, k int, sure boolean"), "forms")


def _in_context(words: DataFrame, right: DataFrame) -> DataFrame:
    """(row_id, at, word, reading): the form that most scanned rows have beside the same words, then with fewest confusions, then the most frequent.

    One that isn't sure must be more usual beside these words than the form that stands there.
    """
    asked = words.join(right, "word")
    left = words.groupBy("left", F.col("word").alias("reading")).agg(F.count_distinct("row_id").alias("nl"))
    after = words.groupBy("right", F.col("word").alias("reading")).agg(F.count_distinct("row_id").alias("nr"))
    scored = asked.join(left, ["left", "reading"], "left").join(after, ["right", "reading"], "left").withColumn("support", F.coalesce("nl", F.lit(0)) + F.coalesce("nr", F.lit(0)))
    scored = scored.join(left.select("left", F.col("reading").alias("word"), F.col("nl").alias("ol")), ["left", "word"], "left").join(after.select("right", F.col("reading").alias("word"), F.col("nr").alias("or")), ["right", "word"], "left")
    scored = scored.filter(F.col("sure") | (F.col("support") > F.coalesce("ol", F.lit(0)) + F.coalesce("or", F.lit(0))))
    best = Window.partitionBy("row_id", "at").orderBy(F.desc(F.col("support") > 0), "k", F.desc("support"), F.desc("m"), "reading")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").select("row_id", "at", "word", "reading")


def _corrected(text: DataFrame, fixes: DataFrame) -> DataFrame:
    """(row_id, text) with the misread words put right, in the letter case they stand in."""
    maps = fixes.groupBy("row_id").agg(F.collect_list(F.struct("word", "reading")).alias("m"))
    j = text.join(maps, "row_id", "left")

    def run(batches):
        for b in batches:
            out = []
            for t, m in zip(b.column("text").to_pylist(), b.column("m").to_pylist()):
                by = {x["word"]: x["reading"] for x in m or ()}

                def put(x, by=by):
                    r = by.get(x[0].lower())
                    return x[0] if r is None else r.upper() if x[0].isupper() and len(r) > 1 else r.capitalize() if x[0][0].isupper() else r

                out.append(_WORD.sub(put, t) if by else t)
            yield pa.RecordBatch.from_arrays([b.column("row_id"), pa.array(out, pa.string())], names=["row_id", "text"])

    return j.mapInArrow(run, "row_id long, text string")
