"""Splitting, look-alikes, languages and scanned pages."""

import random
import re

import pytest

from lodestone.llm import languages as lg
from lodestone.llm import lookalikes as la
from lodestone.llm import scans as sc
from lodestone.llm import splitting as sp
from lodestone.session import Scratch


@pytest.mark.parametrize("limit,overlap", [(800, 100), (50, 0), (20, 19), (64, 10)])
def test_pieces_keep_limit_and_overlap_and_text(limit, overlap):
    rng = random.Random(limit)
    for n in (0, 1, limit, limit + 1, 3 * limit, 20 * limit):
        for alphabet in ("a", "ab. \n", "水文。 x", " \n", "word word. Next\n\n"):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            got = sp.cuts(text, limit, overlap)
            assert all(b - a <= limit for a, b, _ in got)
            assert [a for a, _, _ in got[1:]] == [b - overlap for _, b, _ in got[:-1]]
            assert "".join(text[a + (overlap if k else 0) : b] for k, (a, b, _) in enumerate(got)) == text
            assert (len(got) <= 1) == (n <= limit)


def test_cuts_prefer_natural_boundaries():
    text = ("A sentence of some words stands here. " * 12 + "\n\n") * 4
    assert {k for _, _, k in sp.cuts(text)} <= {"paragraph", "sentence", "end"}
    assert {k for _, _, k in sp.cuts("word " * 500)} == {"word", "end"}
    assert {k for _, _, k in sp.cuts("x" * 2000)} == {"hard", "end"}
    assert all(b - a <= 800 for a, b, _ in sp.cuts(" " * 3000 + "x" + " " * 900))
    with pytest.raises(ValueError):
        sp.cuts("x", 10, 10)


def test_kinds_equal_the_longest_stretch():
    rng = random.Random(8)
    marks = ["。", ". ", ".", "! ", "\n", "\r", " ", "  ", "；", "? ", "\n \n", "\t"]
    seen = set()
    for k in range(600):
        text = "".join(rng.choice("ab") * rng.choice([1, 9, 20, 37, 41]) + rng.choice(marks) for _ in range(rng.randrange(1, 30)))
        at = [0, *(p for p, _ in sp.boundaries(text)), len(text)]
        hard = max(len(text[a:b].strip()) for a, b in zip(at, at[1:])) > 40
        kinds = {kind for _, _, kind in sp.cuts(text, 40, 0, trimmed=True)}
        assert len(text) <= 40 or hard == bool(kinds & set(sp.UNNATURAL)), text
        assert all(len(text[a:b].strip()) <= 40 for a, b, _ in sp.cuts(text, 40, 0, trimmed=True))
        seen.add(hard)
    assert seen == {True, False}


def test_cuts_have_the_least_cost():
    rng = random.Random(9)

    def cost(text, ends, kinds, limit, overlap):
        share = (len(text) - overlap) / -(-(len(text) - overlap) // (limit - overlap))
        begins = [overlap, *ends[:-1]]
        return sum(sp.PENALTY[kinds.get(e, "hard")] + sp.PIECE + sp.UNEVEN * ((e - b - share) / share) ** 2 for b, e in zip(begins, ends))

    for _ in range(60):
        text = "".join(rng.choice("ab") * rng.choice([1, 2, 5]) + rng.choice(["。", ". ", " ", "\n", ""]) for _ in range(9))[:34]
        limit, overlap = 12, 3
        kinds = {p: "word" for p in (m.end() for m in re.finditer(r"\s+", text))} | dict(sp.boundaries(text)) | {len(text): "end"}
        best = {overlap: (0.0, [])}  # all ways, from all places
        for e in range(overlap + 1, len(text) + 1):
            ways = [(cost(text, [*v[1], e], kinds, limit, overlap), [*v[1], e]) for s, v in best.items() if e - s <= limit - overlap and s < e]
            if ways:
                best[e] = min(ways)
        got = [e for _, e, _ in sp.cuts(text, limit, overlap)]
        if len(text) > limit:
            unnatural = lambda ends: sum(kinds.get(e, "hard") in sp.UNNATURAL for e in ends)
            assert unnatural(got) == unnatural(best[len(text)][1])


def test_split_table(spark):
    long = "One. " * 400
    df = spark.createDataFrame([(1, long, 7), (1, long, 8), (2, None, 9), (3, "", 9), (4, "short", 9)], "row_id long, text string, start int")
    got = sp.split_oversized(df).collect()
    assert {r.id for r in got} == {1} and len(got) == 2 * len(sp.cuts(long)) and all(r.text == long[r.start : r.start + r.n_chars] for r in got)
    assert sp.split_oversized(df.limit(0)).count() == 0


SAME = ["Straße près du café", "Straße pre\u0300s du cafe\u0301", "\uff33traße près du café", "Str\u200baße près du café", "Stra\u00df\u0435 \u0440r\u00e8s du caf\u00e9", "S\u00adtraße près\u3000du c\u0430fé"]


def test_look_alike_forms(spark):
    rows = list(enumerate([*SAME, "Strasse près du café", "straße près du café", "Straße pres du café", "m² ﬁx K 水", "m2 fix K 水", "m² fix K ⽔", None, "", "  ", "Мост Вода", "Moст Вoда", SAME[0]]))
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, raw string, form string")
    forms = la.canonical(df)
    got = {(r.a, r.b) for r in la.look_alike_pairs(forms.select("id", "raw", "form")).collect()}
    first = set(range(6))
    want = {(a, b) for a in first for b in first if a < b} | {(a, 17) for a in first if a} | {(9, 11), (15, 16)}
    assert got == want
    text = {r.id: r.text for r in forms.collect()}
    assert text[16] == text[15] == "Мост Вода" and {text[i] for i in first} == {SAME[0]} and text[11] == "m² fix K 水" and set(text) == set(range(18)) - {12, 13, 14}
    assert la.canonical(df.limit(0)).count() == 0


def test_trie_costs():
    trie = la.Trie()
    for w, n in (("Мост", 3), ("мостик", 1), ("scale", 2)):
        trie.add(w, n)
    assert trie.spell("Moст") == "Мост" and trie.spell("ѕсаlе") == "scale" and trie.spell("s‍cale") == "scale"
    assert trie.spell("scales") is None and trie.spell("scald") is None and trie.spell("scald", most=1) == "scale"


SENTENCES = {
    "en": ["The bridge stands near the river.", "Water levels rise during the wet season.", "We measure the flow at each station."],
    "de": ["Die Brücke steht nahe am Fluss.", "Der Wasserstand steigt während der Regenzeit.", "Wir messen den Abfluss an jeder Stelle."],
    "fr": ["Le pont se trouve près de la rivière.", "Le niveau monte pendant la saison humide.", "Nous mesurons le débit à chaque station."],
    "es": ["El puente está cerca del río.", "El nivel sube durante la temporada húmeda.", "Medimos el caudal en cada estación."],
    "pt": ["A ponte fica perto do rio.", "O nível sobe durante a estação húmida.", "Medimos o caudal em cada estação, não é?"],
    "ru": ["Мост стоит у реки.", "Уровень растёт в сезон дождей.", "Мы измеряем сток на каждой станции."],
    "zh": ["桥梁靠近河流。", "水位在雨季上升。", "我们在每个站点测量流量。"],
}


def test_segments_of_mixed_texts(spark):
    rng = random.Random(1)
    rows = []
    for i in range(700):
        lang = rng.choice(lg.LANGS)
        label = lang if rng.random() < 0.9 else rng.choice(lg.LANGS)
        rows.append((i, " ".join(rng.choices(SENTENCES[lang], k=4)), label))
    mixed = [(1000, SENTENCES["en"][0] + " " + SENTENCES["en"][1] + " " + SENTENCES["fr"][1] + "\n\n" + SENTENCES["zh"][0] + SENTENCES["zh"][1], None), (1001, "12.5 % 33 https://x.example/the/river", "en"), (1002, None, "de"), (1003, "", "de"), (1004, SENTENCES["de"][0] + " " + SENTENCES["de"][2], " DE-at ")]
    df = spark.createDataFrame(rows + mixed, "row_id long, text string, lang string").withColumn("seg_no", lg.F.lit(1))
    got = lg.segments(df, p=lg.Fit(rows=400)).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.id, r.seg_no)):
        by.setdefault(r.id, []).append(r.lang)
        assert 0 <= r.confidence <= 1.0000001
    assert by[1000] == ["en", "fr", "zh"] and by[1004] == ["de"] and not {1001, 1002, 1003} & set(by)
    truth = {i: next(k for k, v in SENTENCES.items() if t.startswith(tuple(v))) for i, t, _ in rows}
    assert sum(by[i] == [truth[i]] for i in truth) >= 0.98 * len(truth)  # many sentences were never labelled right in the sample's order
    assert lg.segments(df.limit(0)).count() == 0
    model = lg.fit(lg.sample(df, "row_id", "text", "lang", lg.Fit(rows=400)), lg.Fit(rows=400))
    at = Scratch(spark, "model").path("model")
    model.save(spark, at)
    assert sorted(lg.segments(df, model=lg.Model.load(spark, at)).collect()) == sorted(got)


def test_data_are_no_words():
    words = lg.Words({})
    text = "The gauge fell. #7=IFCPOINT((30.7,7.4));#14=IFC((1)) b65c67ef 47.68 (see 3). xxiv\n表115列出KT-6496数据。 https://a.b/c Der Pegel"
    ids, sentence = lg.sequence(text, words)
    names = {i: w for w, i in words.items()}
    assert [names.get(i, "Han") for i in ids] == ["The", "gauge", "fell", "see", "Han", "Han", "Han", "Der", "Pegel"]
    assert [int(x) for x in sentence - sentence[0]] == [0, 0, 0, 1, 3, 3, 3, 4, 4]


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    s, inside, across = rng.normal(size=(1, 4, lg.L)), rng.normal(size=(lg.L, lg.L)), rng.normal(size=(lg.L, lg.L))
    new = np.array([[False, False, True, False]])
    want, z = np.zeros((4, lg.L)), 0.0
    for path in itertools.product(range(lg.L), repeat=4):
        w = np.exp(sum(s[0, i, y] for i, y in enumerate(path)) + sum((across if new[0, i + 1] else inside)[a, b] for i, (a, b) in enumerate(itertools.pairwise(path))))
        z += w
        for i, y in enumerate(path):
            want[i, y] += w
    got = lg.forward_backward(s, new, np.ones((1, 4), bool), inside, across)
    assert np.allclose(got[0], want / z)


PAGE = """River station Pelmo
{n}
The water station measures the levels of the catch-
ment in the long-
term programme and the rnanual of the river station
was revised by the members of the field team near
the northern bank of the river.

Once again the station rep0rts the flow in most of
the cases and the members of the team store them
in the manual of the river.
{foot}"""


def test_scanned_pages(spark):
    plain = "The water station reports the levels of the catchment in the manual of the long-term programme near the northern bank. " * 60
    pages = [(i, PAGE.format(n=40 + i, foot="") if i else PAGE.format(n="", foot="").replace("Once again", "Later on"), "a\\b.PDF") for i in range(3)]
    rows = [*pages, (10, plain, "notes.md"), (11, plain, None), (12, None, "x.pdf"), (13, "", "x.pdf"), (14, plain, "y.pdf")]
    df = spark.createDataFrame(rows, "row_id long, text string, source string").withColumn("kind", sc.F.lit("k"))
    found, texts = sc.repair(df)
    got = {tuple(r) for r in found.collect()}
    assert {x for x in got if x[0] == 1} == {(1, "header", "River station Pelmo"), (1, "pageno", "41"), (1, "break", "catchment"), (1, "break", "long-term"), (1, "misread", "manual"), (1, "misread", "reports")}
    assert {x[0] for x in got} == {0, 1, 2}
    text = dict(texts.collect())
    assert "catchment in the long-term programme and the manual of" in text[1] and "Pelmo" not in text[1] and text[1].count("\n\n") == 1
    assert [x.count() for x in sc.repair(df.limit(0))] == [0, 0]


def test_rare_right_forms(spark):
    # the right form is in two texts only; a copy of the scanned page adds nothing; words that other texts use as well stay
    page = PAGE.format(n=7, foot="").replace("rnanual", "manual") + "The geländeerqebnisse of the digue were kept in the yearbook.\n"
    notes = ["The geländeergebnisse of the year.", "Many geländeergebnisse stand here.", "La digue est longue.", *(f"El dique {i} es largo." for i in range(40)), "The digue of the town."]
    rows = [(1, page, "a.pdf"), (2, page, "b.pdf"), *((10 + i, t, "notes.md") for i, t in enumerate(notes))]
    found, texts = sc.repair(spark.createDataFrame(rows, "row_id long, text string, source string"))
    got = {r.reading for r in found.filter("kind = 'misread' and row_id = 1").collect()}
    assert "geländeergebnisse" in got
    text = dict(texts.collect())[1]
    assert "geländeergebnisse" in text


def test_short_misreads_go_by_context(spark):
    pages = [(i, f"the team took la prévision of the day {i} into the\nlist of the river and lá procédure of the town {i} as\nthe base of the plan and la procédure of the river\nstays with la procédure of the town.\n", f"{i}.pdf") for i in range(6)]
    other = [(100 + i, f"la rivière {i} la digue", "notes.md") for i in range(30)] + [(200, "ele está lá hoje", "notes.md")]
    found, texts = sc.repair(spark.createDataFrame(pages[:1] + [(i, t.replace("lá", "la"), s) for i, t, s in pages[1:]] + other, "row_id long, text string, source string"))
    assert (0, "misread", "la") in {tuple(r) for r in found.collect()} and "and la procédure" in dict(texts.collect())[0]


def test_confusions():
    assert sc.confusions("rnanuel", "manuel") == 1 and sc.confusions("r6su1tats", "résultats") == 2
    assert sc.confusions("manual", "manuel") is None and sc.confusions("same", "same") == 0


def test_automaton_equals_edit_distance():
    rng = random.Random(12)
    vocabulary = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))): rng.randint(1, 9) for _ in range(60)}
    trie = la.Trie()
    for w, n in vocabulary.items():
        trie.add(w, n)

    def distance(a, b):
        x, y = (la.ud.normalize("NFD", la._ignorable.sub("", t)) for t in (a, b))
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row, last = [i], row
            for j, e in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (la._SHAPE.get(c, c) != la._SHAPE.get(e, e))))
        return row[-1]

    for _ in range(300):
        word = "".join(rng.choice(["a", "а", "b", "с", "c", "é", "​", "d"]) for _ in range(rng.randint(1, 6)))
        for most in (0, 1, 2):
            near = [(d, -n, w) for w, n in vocabulary.items() if (d := distance(word, w)) <= most]
            assert trie.spell(word, most) == (min(near)[2] if near else None), (word, most)
