"""Problem 4: languages of texts and of their stretches, by a linear-chain conditional random field.

Method. Words are labelled by a chain model whose features are affixes, letter n-grams, shapes and a lexicon, with learned
transitions inside and between sentences; forward-backward gives each word's probabilities, whose sums decide sentence by sentence.
The model is fitted on a bounded sample of labelled rows (``Fit.rows``); as some labels are wrong and some texts mixed, sentences
of the sample are first relabelled by word counts of the whole sample.

Scale. The model is a fixed number of weights, sent to every task; each text is labelled on its own, in one pass without a shuffle.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sampling import bounded_sample

LANGS = ("en", "zh", "de", "fr", "es", "pt", "ru")
L = len(LANGS)
HASHED = 1 << 16

#: Page labels, links, data (what holds a digit between blanks), codes, words, sentence ends, and line breaks that end a sentence or heading.
TOKEN = re.compile(
    r"^(?:Page|Seite|Página|Стр\.) *\d.*$|(?:https?://|www\.)[^\s，。；！？）]+|(?<![\w!-~])[!-/:-~A-Za-z]*\d[!-~]*?(?=[)\].,:;!?]*(?![!-~]))|[A-Z]{1,4}-\d+|[一-鿿㐀-䶿]{1,3}|[^\W\d_一-鿿㐀-䶿]+(?:['’][^\W\d_一-鿿]+)?"
    r"|[。！？；]|[.!?;](?=\s|\Z)|\n(?=\s*[A-ZÀ-ÖØ-ÞА-ЯЁ#>|*\-\n])|(?<![一-鿿，、])\n(?=[一-鿿])",
    re.M,
)
#: numbers of pages before the first
_ROMAN = re.compile(r"(?=[ivxl])(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
#: languages that are not written in Latin letters
OTHER_SCRIPTS = (LANGS.index("zh"), LANGS.index("ru"))
_END = -1  # a token that ends a sentence
_SKIP = -2
HAN = 0


@dataclass(frozen=True)
class Fit:
    """rows: bound of the labelled sample; a text's own words decide where the sample's lexicon knows at least ``seen`` uses."""

    rows: int = 5000
    epochs: int = 3
    batch: int = 64
    rate: float = 0.25
    decay: float = 1e-6
    seen: int = 3


def features(word: str, lexicon: dict[str, tuple[int, int]]) -> list[int]:
    """Hashed features of a word: shape, script, affixes, the word, its entry of the lexicon and all its trigrams."""
    low = word.lower()
    first = word[0]
    shape = ("C" if word.isupper() and len(word) > 1 else "c" if first.isupper() else "l") + ("a" if word.isascii() else "u")
    script = "H" if "㐀" <= first <= "鿿" else "K" if "Ѐ" <= first <= "ӿ" else "G" if "Ͱ" <= first <= "Ͽ" else "L"
    names = [f"s{shape}{script}", f"s{script}", f"a{low[:2]}", f"b{low[:3]}", f"c{low[-1:]}", f"d{low[-2:]}", f"e{low[-3:]}", f"f{low[-4:]}", f"w{low}"]
    known = lexicon.get(low)
    names.append(f"x{known[0]}{known[1]}" if known else "x?" + shape)
    padded = f"^{low}$"
    names += [f"t{padded[i : i + 3]}" for i in range(len(padded) - 2)]
    return [zlib.crc32(n.encode()) % HASHED for n in names]


class Words(dict):
    """Numbers of words, with their features; Han characters, three to a word, share the number 0."""

    def __init__(self, lexicon: dict[str, tuple[int, int]], weights: np.ndarray | None = None, most: int = 400_000):
        super().__init__()
        self.lexicon, self.weights, self.most = lexicon, weights, most
        self.rows: list = []
        self.single: list[bool] = []  # letters on their own, such as units, speak for no language
        self.add("一")
        self.single[HAN] = False

    def add(self, word: str) -> int:
        f = features(word, self.lexicon)
        self.single.append(len(word) == 1)
        self.rows.append(f if self.weights is None else self.weights[f].sum(0))
        return len(self.rows) - 1

    def __missing__(self, token: str) -> int:
        c = token[0]
        if "㐀" <= c <= "鿿":
            return HAN
        if "://" in token or token.startswith("www.") or any(map(str.isdigit, token)):
            return _SKIP
        if not c.isalpha():
            return _END
        if _ROMAN.fullmatch(token):
            return _SKIP
        n = self[token] = self.add(token)
        return n


def sequence(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of a text and the sentence (from 0) of each."""
    get = words.__getitem__
    found = TOKEN.findall(text)
    ids = np.fromiter(map(get, found), dtype=np.int64, count=len(found))
    sentence = np.cumsum(ids == _END)
    keep = ids >= 0
    return ids[keep], sentence[keep]


@dataclass
class Model:
    weights: np.ndarray  # HASHED x L
    inside: np.ndarray  # L x L, transitions inside a sentence
    across: np.ndarray  # L x L, transitions to the next sentence
    lexicon: dict[str, tuple[int, int]]

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model to a folder, so that later runs need no fitting: four rows of bytes."""
        parts = [(k, np.asarray(getattr(self, k), np.float64).tobytes()) for k in ("weights", "inside", "across")]
        rows = [*parts, ("lexicon", json.dumps(self.lexicon).encode())]
        spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "part string, data binary").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        found = {r.part: bytes(r.data) for r in spark.read.parquet(path).collect()}  # four rows
        weights, inside, across = (np.frombuffer(found[k]).reshape(-1, L) for k in ("weights", "inside", "across"))
        return cls(weights.astype(np.float32), inside, across, {w: tuple(x) for w, x in json.loads(found["lexicon"]).items()})


def _pad(seqs: list[tuple[np.ndarray, np.ndarray]]):
    longest = max(len(s) for s, _ in seqs)
    ids, new, mask = np.zeros((len(seqs), longest), np.int64), np.zeros((len(seqs), longest), bool), np.zeros((len(seqs), longest), bool)
    for r, (s, sent) in enumerate(seqs):
        n = len(s)
        ids[r, :n], mask[r, :n] = s, True
        new[r, 1:n] = sent[1:] != sent[:-1]
    return ids, new, mask


def forward_backward(scores: np.ndarray, new: np.ndarray, mask: np.ndarray, inside: np.ndarray, across: np.ndarray, pairs: bool = False):
    """Posteriors (texts x words x L) of padded chains; with ``pairs`` also the expected transitions inside and across sentences."""
    b, t, _ = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    a_in, a_out = np.exp(inside), np.exp(across)
    alpha, beta = np.empty((t, b, L)), np.ones((t, b, L))
    x = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    alpha[0] = x
    for i in range(1, t):
        y = np.where(new[:, i, None], x @ a_out, x @ a_in) * e[:, i]
        y /= y.sum(1, keepdims=True)
        x = np.where(mask[:, i, None], y, x)
        alpha[i] = x
    x = np.ones((b, L))
    for i in range(t - 1, 0, -1):
        z = x * e[:, i]
        y = np.where(new[:, i, None], z @ a_out.T, z @ a_in.T)
        y /= y.sum(1, keepdims=True)
        x = np.where(mask[:, i, None], y, x)
        beta[i - 1] = x
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    post = post.transpose(1, 0, 2)
    if not pairs:
        return post
    sums = []
    left, right = alpha[:-1].transpose(1, 0, 2), (beta[1:] * e.transpose(1, 0, 2)[1:]).transpose(1, 0, 2)
    for m, which in ((a_in, mask[:, 1:] & ~new[:, 1:]), (a_out, mask[:, 1:] & new[:, 1:])):
        l, r = left[which], right[which]
        norm = np.einsum("ni,ij,nj->n", l, m, r)
        sums.append(m * (l.T @ (r / norm[:, None])) if len(l) else np.zeros((L, L)))
    return post, sums


def declared(lang) -> F.Column:
    """The language that a label names: letter case, blanks and a region suffix don't matter; null for none or an unknown one."""
    low = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2})([-_].*)?$", 1)
    return F.when(low.isin(*LANGS), low)


def fit(sample: list[tuple[str, str]], p: Fit = Fit()) -> Model:
    """Fits a model on (text, label) rows, of which some are mixed or wrongly labelled."""
    plain = Words({})
    seqs, labels = [], []
    for text, lang in sample:
        s = sequence(text, plain)
        if len(s[0]):
            seqs.append(s)
            labels.append(LANGS.index(lang))
    if not seqs:
        return Model(np.zeros((HASHED, L)), np.zeros((L, L)), np.zeros((L, L)), {})
    names: list[str] = ["一"] * len(plain.rows)
    for w, i in plain.items():
        names[i] = w.lower()
    lower = {w: i for i, w in enumerate(dict.fromkeys(names))}
    fold = np.array([lower[w] for w in names])
    seqs_low = [fold[s] for s, _ in seqs]
    word_labels = [np.full(len(s), y) for (s, _), y in zip(seqs, labels)]
    for _ in range(3):  # relabel sentences by the words' counts, which most rows have right
        counts = np.zeros((len(lower), L))
        np.add.at(counts, (np.concatenate(seqs_low), np.concatenate(word_labels)), 1)
        share = (counts + 0.05) / (counts.sum(0) + 0.05 * len(lower))
        logp = np.log(share)
        word_labels = []
        for s, (_, sent) in zip(seqs_low, seqs):
            place = sent - sent[0]
            total = np.zeros((place[-1] + 1, L))
            np.add.at(total, place, logp[s])
            word_labels.append(total.argmax(1)[place])
    best = counts.argmax(1)
    strength = counts.max(1) / np.maximum(1, counts.sum(1))
    lexicon = {w: (int(best[i]), int(strength[i] * 4)) for w, i in lower.items() if counts[i].sum() >= p.seen}

    words = Words(lexicon)
    remap = np.zeros(len(names), np.int64)
    for w, i in plain.items():
        remap[i] = words[w]
    size = np.array([len(r) for r in words.rows])
    begin, feats = np.concatenate([[0], np.cumsum(size)]), np.concatenate([np.array(r) for r in words.rows])
    foreign = np.zeros(len(words.rows), bool)
    for x, i in words.items():
        foreign[i] = len(x) > 2 and not ("Ѐ" <= x[0] <= "ӿ")
    w, grad2 = np.zeros((HASHED, L)), np.full((HASHED, L), 1e-2)
    inside, across = np.eye(L) * 2, np.eye(L)
    t2 = [np.full((L, L), 1.0), np.full((L, L), 1.0)]
    order = sorted(range(len(seqs)), key=lambda i: len(seqs[i][0]))
    starts = list(range(0, len(order), p.batch))
    rng = np.random.default_rng(7)
    for _ in range(p.epochs):
        for at in rng.permutation(starts):
            pick = order[at : at + p.batch]
            ids, new, mask = _pad([(remap[seqs[i][0]], seqs[i][1]) for i in pick])
            gold = np.zeros(ids.shape, np.int64)
            for r, i in enumerate(pick):
                gold[r, : len(word_labels[i])] = word_labels[i]
            kinds, where = np.unique(ids, return_inverse=True)
            flat = feats[np.concatenate([np.arange(begin[k], begin[k + 1]) for k in kinds])]
            own = size[kinds]
            scores = np.add.reduceat(w[flat], np.cumsum(own) - own)[where.reshape(ids.shape)]
            post, expected = forward_backward(scores, new, mask, inside, across, pairs=True)
            g = -post
            np.put_along_axis(g, gold[..., None], np.take_along_axis(g, gold[..., None], 2) + 1, 2)
            # names and terms in Latin letters say nothing of Chinese or Russian, though they stand in such sentences; units are everywhere
            g[foreign[ids] & np.isin(gold, OTHER_SCRIPTS)] = 0
            per_kind = np.zeros((len(kinds), L))
            np.add.at(per_kind, where.reshape(ids.shape)[mask], g[mask])
            per_feature = np.zeros((HASHED, L))
            np.add.at(per_feature, flat, np.repeat(per_kind, own, 0))
            touched = np.flatnonzero(np.abs(per_feature).sum(1))
            d = per_feature[touched] - p.decay * w[touched]
            grad2[touched] += d * d
            w[touched] += p.rate * d / np.sqrt(grad2[touched])
            for k, (m, which) in enumerate(((inside, mask[:, 1:] & ~new[:, 1:]), (across, mask[:, 1:] & new[:, 1:]))):
                seen = np.zeros((L, L))
                np.add.at(seen, (gold[:, :-1][which], gold[:, 1:][which]), 1)
                d = seen - expected[k]
                t2[k] += d * d
                m += p.rate * d / np.sqrt(t2[k])
    return Model(w.astype(np.float32), inside, across, lexicon)


class Tagger:
    """A fitted model with the words met so far; one for each worker."""

    def __init__(self, model: Model):
        self.model = model
        self._fresh()

    def _fresh(self):
        self.words = Words(self.model.lexicon, self.model.weights)
        self.scores, self.single = np.zeros((0, L)), np.zeros(0, bool)

    def tag(self, texts: list[str | None], group: int = 256, cells: int = 400_000):
        """For each text its segments as (lang, confidence, words)."""
        if len(self.words) > self.words.most:
            self._fresh()
        seqs = [sequence(t or "", self.words) for t in texts]
        if len(self.scores) < len(self.words.rows):
            self.scores = np.concatenate([self.scores, np.array(self.words.rows[len(self.scores) :], np.float64).reshape(-1, L)])
            self.single = np.array(self.words.single)
        out: list[list[tuple[str, float, int]]] = [[] for _ in texts]
        order = sorted((i for i in range(len(texts)) if len(seqs[i][0])), key=lambda i: len(seqs[i][0]))
        at = 0
        while at < len(order):
            n = 1
            while n < group and at + n < len(order) and (n + 1) * len(seqs[order[at + n]][0]) <= cells:
                n += 1
            pick = order[at : at + n]
            at += n
            ids, new, mask = _pad([seqs[i] for i in pick])
            post = forward_backward(self.scores[ids], new, mask, self.model.inside, self.model.across)
            for r, i in enumerate(pick):
                k = len(seqs[i][0])
                out[i] = self._segments(seqs[i][0], seqs[i][1], post[r, :k])
        return out

    def _segments(self, ids, sentence, post):
        """Stretches of sentences by the sums of their words' probabilities; a sentence of single letters only, such as units, is none, unless all are."""
        place = sentence - sentence[0]
        n = place[-1] + 1
        total = np.stack([np.bincount(place, post[:, j], n) for j in range(L)], 1)
        words = np.bincount(place, minlength=n)
        real = np.bincount(place, ~self.single[ids], n) > 0
        out: list[list] = []
        for s in np.flatnonzero(real if real.any() else words):
            lang = int(total[s].argmax())
            if not out or out[-1][0] != lang:
                out.append([lang, 0.0, 0])
            out[-1][1] += float(total[s, lang])
            out[-1][2] += int(words[s])
        return [(LANGS[g], a / c, c) for g, a, c in out]


def sample(df: DataFrame, id_col: str, text_col: str, lang_col: str, p: Fit) -> list[tuple[str, str]]:
    """At most p.rows labelled rows, in the order of a hash of the id."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), declared(F.col(lang_col)).alias("lang")).filter("lang is not null and length(trim(text)) > 0")
    return [(r.text, r.lang) for r in bounded_sample(rows, "id", p.rows).select("text", "lang").collect()]


def segments(df: DataFrame, id_col: str = "row_id", text_col: str = "text", lang_col: str = "lang", p: Fit = Fit(), model: Model | None = None) -> DataFrame:
    """(id, declared, seg_no, n_segs, lang, confidence, words): each longest stretch of sentences in one language.

    Texts without words (and null ones) have no row. Repeated ids give their segments each; other columns are ignored. Without any
    labelled row all languages are equally likely. An empty table gives no rows. A model that was fitted before (``Model.load``) may
    be given; else one is fitted on a sample of the rows.
    """
    model = model or fit(sample(df, id_col, text_col, lang_col, p), p)
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = "id long, declared string, seg_no long, n_segs int, lang string, confidence double, words int"

    def run(batches):
        tagger = Tagger(shared.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            for at in range(0, len(texts), 2000):
                rows, no, n, lang, conf, words = [], [], [], [], [], []
                for i, segs in enumerate(tagger.tag(texts[at : at + 2000])):
                    for k, (g, c, w) in enumerate(segs, 1):
                        rows.append(at + i)
                        no.append(k)
                        n.append(len(segs))
                        lang.append(g)
                        conf.append(c)
                        words.append(w)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(take), b.column("declared").take(take), pa.array(no, pa.int64()), pa.array(n, pa.int32()), pa.array(lang, pa.string()), pa.array(conf, pa.float64()), pa.array(words, pa.int32())],
                    names=["id", "declared", "seg_no", "n_segs", "lang", "confidence", "words"],
                )

    src = df.select(F.col(id_col).cast("long").alias("id"), declared(F.col(lang_col)).alias("declared"), F.col(text_col).alias("text")).filter("text is not null")
    return src.mapInArrow(run, schema)
