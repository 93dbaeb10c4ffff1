"""Problem 9: one consistent form for texts that look the same.

Method. The clean words of the collection (one script, composed accents, nothing invisible) are the vocabulary. Each other word
that could be a disguised clean word runs through a trie of the vocabulary as a weighted edit automaton: to take a look-alike letter
or width form for another and to leave out an invisible character costs nothing; to leave out, put in or replace anything else costs
one, within a budget of edits. The vocabulary word that is reached at the least cost, of these the most frequent, is its
canonical spelling. The budget is 0 by default, as other words must stay different. What reaches none, and all that is no word, is
normalised by table.

Scale. One scan of the texts emits distinct words per task, the disguised words by document and, for texts without any, the
finished form. Words and tries are partitioned by the first letters' shapes; only texts that hold disguised words are joined.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

# Letters and signs of one shape, by script.
CYRILLIC = dict(zip("асеорхуіјѕԁԛԝһѵӏАВЕКМНОРСТХУІЈЅԌԚԜӀҮ", "aceopxyijsdqwhvlABEKMHOPCTXYIJSGQWIY"))
GREEK = dict(zip("οϲϳνΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ocjvABEZHIKMNOPTYXCJ"))
SIGNS = {"‐": "-", "‑": "-", "−": "-", "∕": "/", "⁄": "/", "∶": ":", "∼": "~", "∣": "|", "ǃ": "!", "∙": "·", "⋅": "·", " ": "\n", "\u0085": "\n"}
IGNORABLE = "­͏؜᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿"
NO_WORDS = ((0x2E80, 0xA4CF), (0xAC00, 0xD7FF), (0xF900, 0xFAFF), (0xFF65, 0xFFDC))  # scripts written without word breaks


def _compatible() -> dict[str, str]:
    """Characters that Unicode calls another width, blank or ligature form of others, and that look like these."""
    out = {}
    for cp in range(0xA0, 0x10000):
        ch = chr(cp)
        how = ud.decomposition(ch).partition(" ")
        if ud.category(ch) == "Zs":
            out[ch] = " "
        elif how[0] in ("<wide>", "<narrow>", "<noBreak>") or (how[0] == "<compat>" and not how[2].startswith("0020") and ch not in "ſ№" and ud.category(ch) not in ("No",)):
            out[ch] = ud.normalize("NFD", ud.normalize("NFKC", ch))
    return out


def _ranges(cps: list[int]) -> str:
    out, start = [], None
    for i, cp in enumerate(cps):
        start = cp if start is None else start
        if i + 1 == len(cps) or cps[i + 1] != cp + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(cp))}")
            start = None
    return "".join(out)


_ignorable = re.compile(f"[{IGNORABLE}]+")
_COMPAT = _compatible()
_IGNORED = [cp for cp in range(0xA0, 0x10000) if _ignorable.fullmatch(chr(cp))]
_WORD_CPS = [
    cp
    for cp in range(0x41, 0x10000)
    if not any(a <= cp <= b for a, b in NO_WORDS) and ((c := ud.category(chr(cp)))[0] == "L" or c == "Mn" or _ignorable.fullmatch(chr(cp))) and not 0xD800 <= cp < 0xE000
]
WORD = re.compile(f"[{_ranges(_WORD_CPS)}]+")
_ASCII_WORD = re.compile("[A-Za-z]+")
#: shape of a decomposed character
_SHAPE = {**_COMPAT, **CYRILLIC, **GREEK, **SIGNS}
_SHAPE = {k: "".join({**CYRILLIC, **GREEK, **SIGNS}.get(x, x) for x in v) for k, v in _SHAPE.items()}
_TABLE = str.maketrans({**_SHAPE, **{chr(cp): None for cp in _IGNORED}})
_words = set(map(chr, _WORD_CPS))
#: the part of the table for what is no word
_REST = {k: v for k, v in _SHAPE.items() if k not in _words}
_in_rest = re.compile(f"[{_ranges(sorted(map(ord, _REST)))}]")
_TWINS = {"C": set(CYRILLIC.values()), "G": set(GREEK.values())}


def by_table(text: str) -> str:
    """The text with every character replaced by its table form, accents composed, invisible characters left out."""
    return text if text.isascii() else ud.normalize("NFC", ud.normalize("NFD", text).translate(_TABLE))


@lru_cache(None)
def _script(ch: str) -> str:
    name = ud.name(ch, "")
    return {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}.get(name.partition(" ")[0], "" if ud.category(ch)[0] != "L" or ch in "µªº" else "?")


CLEAN, TABLE, DISGUISED = 0, 1, 2


def classify(word: str) -> int:
    """CLEAN: is its own canonical spelling. DISGUISED: may be a spelling of a clean word. TABLE: can be none, or only a Latin one."""
    shape = ud.normalize("NFD", word).translate(_TABLE)
    bases = [c for c in shape if ud.category(c)[0] == "L"]
    scripts = {_script(c) for c in word} - {""}
    plain = len(scripts) == 1 and ud.normalize("NFC", word) == word and not any(c in _COMPAT or _ignorable.match(c) for c in word)
    if plain:
        s = next(iter(scripts))
        if s == "L" or s == "?" or any(_script(c) == s for c in bases):
            return CLEAN
        return TABLE  # each of its letters has a Latin twin, and so the Latin spelling stands for all
    for s in "LCG":
        if bases and all(_script(c) == s or (s != "L" and c in _TWINS[s]) for c in bases):
            return DISGUISED
    return TABLE


@lru_cache(None)
def _peers(shape: str) -> tuple[str, ...]:
    """The decomposed characters of one shape."""
    return tuple({shape, *(c for c, x in _SHAPE.items() if x == shape)})


class Trie:
    """Vocabulary words by decomposed characters; ``spell`` gives the word that a disguised one stands for."""

    def __init__(self):
        self.root: dict = {}

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in ud.normalize("NFD", word):
            node = node.setdefault(c, {})
        best = node.get("")
        if best is None or (-n, word) < (-best[1], best[0]):
            node[""] = (word, n)

    def spell(self, word: str, most: int = 0) -> str | None:
        """The automaton: a state is a trie node with its least cost so far; states over ``most`` edits die out.

        Of the words reached the cheapest is taken, then the most frequent, then the first by its characters.
        """
        states = _widened({id(self.root): (self.root, 0)}, most)
        for c in ud.normalize("NFD", word):
            invisible = _ignorable.match(c) is not None
            for shape in (c,) if invisible else _SHAPE.get(c, c):  # a ligature is several letters
                after: dict[int, tuple[dict, int]] = {}
                for node, cost in states.values():
                    if invisible or cost < most:  # left out
                        _reach(after, node, cost + (not invisible))
                    if invisible:
                        continue
                    for edge in _peers(shape):
                        if edge in node:
                            _reach(after, node[edge], cost)
                    if cost < most:  # replaced
                        for edge, child in node.items():
                            if edge:
                                _reach(after, child, cost + 1)
                states = _widened(after, most)
                if not states:
                    return None
        ends = [(cost, -node[""][1], node[""][0]) for node, cost in states.values() if "" in node]
        return min(ends)[2] if ends else None


def _reach(states: dict[int, tuple[dict, int]], node: dict, cost: int) -> None:
    if id(node) not in states or states[id(node)][1] > cost:
        states[id(node)] = (node, cost)


def _widened(states: dict[int, tuple[dict, int]], most: int) -> dict[int, tuple[dict, int]]:
    """The states and those that letters put in lead to."""
    todo = [x for x in states.values() if x[1] < most]
    while todo:
        node, cost = todo.pop()
        for edge, child in node.items():
            if edge and (id(child) not in states or states[id(child)][1] > cost + 1):
                states[id(child)] = (child, cost + 1)
                if cost + 1 < most:
                    todo.append((child, cost + 1))
    return states


def _shape_key(word: str) -> str:
    return ud.normalize("NFD", word).translate(_TABLE)[:3]


_kinds: dict[str, int] = {}


def _kind(word: str) -> int:
    k = _kinds.get(word)
    if k is None:
        if len(_kinds) > 500_000:
            _kinds.clear()
        k = _kinds[word] = CLEAN if word.isascii() else classify(word)
    return k


def _rest(text: str) -> str:
    """What is no word by table; words of a text as they are."""
    text = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    return text if text.isascii() else _in_rest.sub(lambda m: _REST[m[0]], text)


def rewrite(text: str, spelling: dict[str, str] | None = None) -> str:
    """The canonical form of a text, given the spellings of its disguised words."""
    spelling = spelling or {}

    def one(m):
        w = m[0]
        return w if _kind(w) == CLEAN else spelling.get(w) or by_table(w)

    return _rest(text if text.isascii() else WORD.sub(one, text))


def _digest(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


_SCAN = "kind int, word string, shape string, n long, id long, raw binary, form binary, text string"


def _scan(df: DataFrame, keep_text: bool) -> DataFrame:
    """kind 0: vocabulary words with counts by task; 1: disguised words by document; 2: finished documents; 3: texts that wait for spellings."""

    def rows(out):
        cols = list(zip(*out)) or [()] * 8
        types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["kind", "word", "shape", "n", "id", "raw", "form", "text"])

    def run(batches):
        words: Counter = Counter()
        for batch in batches:
            out = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                odd: list[str] = []
                if t is None or not t.strip():
                    continue
                raw = _digest(t)
                if t.isascii():
                    words.update(_ASCII_WORD.findall(t))
                    hidden = ()
                else:
                    found = Counter(WORD.findall(t))
                    words.update(found)
                    odd = [w for w in found if _kind(w) != CLEAN]
                    hidden = [w for w in odd if _kind(w) == DISGUISED]
                if hidden:
                    out.extend((1, w, _shape_key(w), None, i, None, None, None) for w in hidden)
                    out.append((3, None, None, None, i, raw, None, t))
                else:
                    form = rewrite(t) if odd else _rest(t)
                    out.append((2, None, None, None, i, raw, _digest(form), form if keep_text else None))
            yield rows(out)
            if len(words) > 1_000_000:
                yield rows([(0, w, _shape_key(w), n, None, None, None, None) for w, n in words.items() if _kind(w) == CLEAN])
                words.clear()
        yield rows([(0, w, _shape_key(w), n, None, None, None, None) for w, n in words.items() if _kind(w) == CLEAN])

    return df.mapInArrow(run, _SCAN)


def _spellings(scan: DataFrame, hidden: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(word, spelling): disguised words that reach a vocabulary word."""
    spark = scan.sparkSession
    asked = scratch.save(hidden.select("word", "shape").distinct(), "disguised")
    # tries of about as many words, whatever the size of the vocabulary; the words of one beginning stay together
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), asked.count() // 2_000)
    vocab = scan.filter("kind = 0").select("word", "shape", "n").join(asked.select("shape").distinct(), "shape", "left_semi").groupBy("word", "shape").agg(F.sum("n").alias("n"))
    both = vocab.select("word", "shape", "n").unionByName(asked.select("word", "shape", F.lit(0).cast("long").alias("n")))

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        known = pdf[pdf.n > 0]
        for w, n in zip(known.word, known.n):
            trie.add(w, n)
        words = sorted(pdf[pdf.n == 0].word)
        return pd.DataFrame({"word": words, "spelling": [trie.spell(w, most) for w in words]}, dtype=object)

    # the first letters' shapes are the same for a disguised word and its clean spelling
    return both.groupBy(F.pmod(F.xxhash64("shape"), F.lit(buckets)).alias("b")).applyInPandas(resolve, "word string, spelling string").filter("spelling is not null")


def canonical(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, most: int = 0) -> DataFrame:
    """(id, raw, form[, text]): digests of the text as stored and of its canonical form, and that form.

    most: edits within which a disguised word is taken for one of the vocabulary, behind its first three letters. Null and blank
    texts have no row. Ids may repeat, with one row each; other columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "p9")
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scan = scratch.save(_scan(src, keep_text), "scan")
    hidden = scan.filter("kind = 1").select("id", "word", "shape")
    spelled = scratch.save(_spellings(scan, hidden, scratch, most), "spellings")
    maps = hidden.join(spelled, "word").groupBy("id").agg(F.collect_set(F.struct("word", "spelling")).alias("m"))
    waiting = scan.filter("kind = 3").select("id", "raw", "text").join(maps, "id", "left")

    def finish(batches):
        for b in batches:
            forms = [rewrite(t, {x["word"]: x["spelling"] for x in m or ()}) for t, m in zip(b.column("text").to_pylist(), b.column("m").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("raw"), pa.array([_digest(f) for f in forms], pa.binary()), pa.array(forms if keep_text else [None] * len(forms), pa.string())],
                names=["id", "raw", "form", "text"],
            )

    done = waiting.mapInArrow(finish, "id long, raw binary, form binary, text string")
    out = scan.filter("kind = 2").select("id", "raw", "form", "text").unionByName(done)
    return out if keep_text else scratch.save(out.drop("text"), "forms")


def look_alike_pairs(forms: DataFrame) -> DataFrame:
    """(a, b), a < b: documents of one form whose texts differ as stored. Equal texts are compared once, not by row."""
    texts = forms.groupBy("form", "raw").agg(F.count("*").alias("n"))
    many = texts.groupBy("form").agg(F.count("*").alias("k")).filter("k > 1").select("form")
    some = forms.join(many, "form", "left_semi")
    kinds = some.select("form", "raw").distinct()
    x, y = (kinds.select("form", F.col("raw").alias(f"raw_{s}")) for s in "xy")
    pairs = x.join(y, "form").filter("raw_x < raw_y")
    left = some.select("form", F.col("raw").alias("raw_x"), F.col("id").alias("i"))
    right = some.select("form", F.col("raw").alias("raw_y"), F.col("id").alias("j"))
    out = pairs.join(left, ["form", "raw_x"]).join(right, ["form", "raw_y"])
    return out.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
