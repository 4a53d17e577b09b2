import random

from kgloom.llm import boilerplate, canonical, splits


# --- splits ---------------------------------------------------------------------------
def test_notations(spark):
    d = spark.createDataFrame([(x,) for x in ("doc_00000012", " DOC_12", "doc-0012 ", "", None, "other")], "x string")
    assert [r[0] for r in d.select(splits.document_id(d.x)).collect()] == ["doc_00000012"] * 3 + [None, None, "other"]
    d = spark.createDataFrame([(x,) for x in ("doc_1__A__B", "doc_1 | A | B", "doc-1::A::B", None)], "x string")
    assert [r[0] for r in d.select(splits.document_id(splits.first_part(d.x))).collect()] == ["doc_00000001"] * 3 + [None]


def test_components_against_union_find(spark):
    random.seed(5)
    links = [(f"n{random.randint(0, 300):03d}", f"n{random.randint(0, 300):03d}") for _ in range(180)] + [("hub", f"h{i}") for i in range(200)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    sizes = {}
    for x in up:
        sizes.setdefault(find(x), []).append(x)
    want = {(x, k) for k, v in sizes.items() if len(v) > 1 for x in v}
    got = {tuple(r) for r in splits.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == want
    assert splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_split_shares(spark):
    random.seed(6)
    rows = [(f"doc_{k:08d}__A__B", f"doc_{k:08d}", [random.choice("XYZ")]) for k in range(300) for _ in range(random.randint(1, 6))]
    rows += [(f"doc_{random.randint(0, 299):08d}__A__B", f"doc_{random.randint(0, 299):08d}", ["X"]) for _ in range(60)] + [(None, None, None), ("", " ", []), ("doc_00000001__A__B",) * 2 + (["X"],)]
    rows += [("doc_00009999__A__B", "doc_00009999", ["Y"])] * 300  # one group with a good part of the rows
    bags = spark.createDataFrame(rows, "bag_id string, doc_id string, label_names array<string>")
    got = splits.split_bags(bags, spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], "split string, share double")).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r.component, set()).add(r.split)
    assert all(len(v) == 1 for v in of.values())
    share = {s: sum(r.split == s for r in got) / len(got) for s in ("train", "dev", "test")}
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["dev"] - 0.1) < 0.02


def test_rare_labels_count_as_one(spark, monkeypatch):
    monkeypatch.setattr(splits, "LABELS", 1)
    random.seed(7)
    rows = [(f"doc_{k:08d}__A__B", f"doc_{k:08d}", ["X"] if k % 2 else [f"rare{k % 40}"]) for k in range(400) for _ in range(random.randint(1, 5))]
    bags = spark.createDataFrame(rows, "bag_id string, doc_id string, label_names array<string>")
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], "split string, share double")
    got = splits.split_bags(bags, targets).collect()
    of = {r.split: [0, 0] for r in got}
    for r in got:
        of[r.split][r.label_names[0] == "X"] += 1
    rare = sum(v[0] for v in of.values())
    assert abs(of["dev"][0] / rare - 0.1) < 0.03 and abs(of["test"][0] / rare - 0.1) < 0.03
    report = {r.split: r for r in splits.split_report(splits.split_bags(bags, targets), targets).collect()}
    assert set(report) == {"train", "dev", "test"} and abs(report["train"].reached - 0.8) < 0.02 and report["dev"].deviation >= 0
    assert sum(r.n_rows for r in report.values()) == len(rows)


# --- canonical names ------------------------------------------------------------------
ENTITIES = [
    ("E1", "PERSON", "Hasko Bápaukest"), ("E2", "PERSON", "Senna Trenagreirk"), ("E3", "PERSON", "Tamsin Trenagreirk"), ("E4", "ORGANIZATION", "University of Trauzund"), ("E5", "ORGANIZATION", "Kirjamir Institute of Technology"),
    ("E6", "PLACE", "Trauzund"), ("E7", "MACHINE", "Mogoror Differential Analyser"), ("E8", "WORK", "Cyclic games: an essay on translation"), ("E9", "PLACE", "Betisut on the Moor"), ("E10", "AWARD", "Jeigrikren Prize for Logic"), ("E11", "ORGANIZATION", "Royal Society of Fanumack"),
]
MEANT = {
    "HASKO BÁPAUKEST": "E1", "Bápaukest, Hasko": "E1", "H. Bápaukest": "E1", "Bápaukest H": "E1", "Dr. Bápaukest": "E1", "Hasko K. Bápaukest": "E1", "HaskoBápaukest": "E1", "Hasko-Bápaukest": "E1", "hasko bapaukset": "E1", "Hasko Bápaukest's": "E1",
    "Hasko Bápaukest (1911-1956)": "E1", "Hasko Bápaukest, mathematician": "E1", "Hаsko Bápaukest;": "E1", "Dr. Trenagreirk": "NIL", "T. Trenagreirk": "E3", "Senna Trenagreirk": "E2", "Univ. of Trauzund": "E4", "the U. of Trauzund": "E4",
    "Kirjamir I.T.": "E5", "Krijamir Inst Tech": "E5", "Trauzund": "E6", "Upper Trauzund": "NIL", "Mogoror Diff. Analyzer": "E7", "Cyclic games: essay on translation": "E8", "Betisut o. t. Moor": "E9", "Jeigrikren Pr. for Logic": "E10", "R. Soc. Fanumack": "E11",
    "Letters to Bápaukest": "NIL", "Bápaukest revisited": "NIL", "Collected lectures of Bápaukest": "NIL", "he": "NIL", "-": "NIL", "": "NIL", "somebody": "NIL", "Tebadrath test": "NIL", "Florian Bápaukest": "NIL",
}


def test_meant_entities(spark):
    e = spark.createDataFrame([(*x, None, None) for x in ENTITIES], "entity_id string, entity_type string, canonical_name string, label_en string, label_zh string")
    v = spark.createDataFrame([("f", k, k, "x") for k in MEANT] + [("f", "null", None, "x"), ("f", "he", "he", "x")], "field string, row_id string, value string, entity_id string")
    for block in (canonical.BLOCK, 4):
        got = {r.row_id: r.entity_id for r in canonical.canonical_values(v, e, block=block).collect()}
        wrong = {k: (got.get(k), w) for k, w in MEANT.items() if got.get(k) != w}
        assert not wrong, (block, wrong)
        assert "null" not in got
    empty = canonical.canonical_values(v.limit(0), e)
    assert empty.count() == 0
    none = canonical.canonical_values(v, e.limit(0))
    assert {r.entity_id for r in none.collect()} == {"NIL"}


def _meant(spark, names, values, block, aliases=None):
    e = spark.createDataFrame([(f"E{i:03d}", kind, n, None, None) for i, (kind, n) in enumerate(names)], "entity_id string, entity_type string, canonical_name string, label_en string, label_zh string")
    v = spark.createDataFrame([("f", x, x) for x in values], "field string, row_id string, value string")
    a = spark.createDataFrame(aliases, "entity_id string, alias string") if aliases else None
    by = {f"E{i:03d}": n for i, (_, n) in enumerate(names)}
    return {r.row_id: by.get(r.entity_id, r.entity_id) for r in canonical.canonical_values(v, e, a, block=block).collect()}


def test_words_that_many_names_share(spark):
    firsts = [f"{a}{b}" for a in "BCDFGHJK" for b in ("alto", "erim", "ondo", "umak", "inar", "opel", "yst", "ulda", "evin")]
    names = [("PERSON", f"Anna {x}") for x in firsts] + [("PERSON", f"{x} Smith") for x in firsts] + [("PERSON", "Anne Quimby"), ("PERSON", "Anna Smith")]
    for block in (canonical.BLOCK, 60):
        assert _meant(spark, names, ["Anna Smyth", "A. Smith", "Smith", "A. Quimby"], block) == {"Anna Smyth": "Anna Smith", "A. Smith": "Anna Smith", "Smith": "NIL", "A. Quimby": "Anne Quimby"}


def test_blocks_decide_like_one_list(spark):
    names = [("ORGANIZATION", "Marlow Institute"), ("ORGANIZATION", "Marlow Institute"), ("ORGANIZATION", "Barlow Institute"), ("PLACE", "Torlond"), ("ORGANIZATION", "Torlond Academy of Logic")]
    values = ["Marlow Institute", "Marlow Inst.", "Barlov Institute", "the Torlond Academy of Logic", "Torlond"]
    one = _meant(spark, names, values, canonical.BLOCK)
    assert one["Marlow Institute"] == one["Marlow Inst."] == "NIL" and one["Barlov Institute"] == "Barlow Institute" and one["the Torlond Academy of Logic"] == "Torlond Academy of Logic"
    for block in (1, 2, 3):
        assert _meant(spark, names, values, block) == one


def test_aliases_are_patterns(spark):
    names = [("PERSON", "Hasko Bapaukest"), ("PLACE", "Trauzund"), ("PERSON", "Senna Trenag")]
    aliases = [("E000", "The Wizard of Tapes"), ("E000", "Old Grey"), ("E002", "Old Grey"), (None, "Nobody Known"), ("E001", None)]
    got = _meant(spark, names, ["wizard of tapes", "Dr. Wizard of Tapes", "Old Grey", "Nobody Known", "Letters to the Wizard of Tapes"], canonical.BLOCK, aliases)
    assert got == {"wizard of tapes": "Hasko Bapaukest", "Dr. Wizard of Tapes": "Hasko Bapaukest", "Old Grey": "NIL", "Nobody Known": "NIL", "Letters to the Wizard of Tapes": "NIL"}


def test_distance():
    import itertools

    def plain_distance(a, b):
        d = {}
        for i in range(-1, len(a)):
            d[i, -1] = i + 1
        for j in range(-1, len(b)):
            d[-1, j] = j + 1
        for i, j in itertools.product(range(len(a)), range(len(b))):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a) - 1, len(b) - 1]

    rng = random.Random(8)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 7))) for _ in range(2))
        assert canonical.distance(a, b, 3) == min(4, plain_distance(a, b)) or abs(len(a) - len(b)) > 3, (a, b)
    assert canonical.distance("abcd", "abdc", 2) == 1 and canonical.distance("abcd", "abcd", 2) == 0
    assert canonical.distance("abcd", "axyd", 2) == 2 and canonical.distance("abcd", "wxyz", 2) == 3 and canonical.distance("", "ab", 2) == 2


# --- main bodies ----------------------------------------------------------------------
PAGE = """Home
People
Home > People > A history of tapes
We use cookies to remember your choices. You can change this in your settings at any time.
A history of tapes

The cook sent a cookie tin full of spare relays to the academy. Nobody expected the machine to settle it.
Fig. 12: The first tape, 1922
Later years
- Store: 817 memories
Sponsored
After the war the drums were moved to the moor, long before the engine ran. It printed 12 lines.
Read also: The other tape

Related pages
The classification of gates
The machine never refused a program…
379 comments
© 2020 Some Museum.
All rights reserved."""
OUT = [0, 1, 2, 3, 10, 12, 14, 15, 16, 17, 18, 19]


def test_furniture(spark):
    schema = "doc_id string, title string, source_type string, clean_text string, line_no int"
    pages = [(f"d{i}", "A history of tapes", "html", PAGE.replace("817", str(i)), 0) for i in range(30)] + [("n", None, None, None, 0), ("b", "x", "html", " \n ", 0), ("d0", "A history of tapes", "html", PAGE.replace("817", "0"), 0), ("p", "A history of tapes", "pdf", PAGE.replace("\n", "\n\n"), 0)]
    got = boilerplate.furniture(spark.createDataFrame(pages, schema)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.line_no)
    assert set(by) == {f"d{i}" for i in range(30)} | {"p"}
    assert sorted(by["d0"]) == OUT and sorted(by["d7"]) == OUT
    assert boilerplate.furniture(spark.createDataFrame([], schema)).count() == 0
    body = boilerplate.main_bodies(spark.createDataFrame(pages, schema)).filter("doc_id = 'd3'").first().main_text
    assert body.startswith("A history of tapes") and "cookie tin" in body and "©" not in body and "Sponsored" not in body


def _dutch(n: int):
    """Pages of three sites in a language without fixed words: (rows, furniture lines by page)."""
    rng = random.Random(3)
    words = "de het een oude nieuwe machine tafel kaart brief molen brug stad rekenaar band trommel lamp schakel draad bewijs reeks som".split()
    line = lambda k: (" ".join(rng.choice(words) for _ in range(k)) + ".").capitalize()
    titles = {(s, i): f"{rng.choice(words).capitalize()} {rng.choice(words)} {s} {i}" for s in range(3) for i in range(n)}
    rows, want = [], {}
    for (s, i), title in titles.items():
        other = titles[s, (i + 7) % n]
        lines = [("Startpagina | Over ons | Winkel", 1), (title, 0), (line(30), 0), (rng.choice(["Leven", "Werk", "Jeugd"]), 0), (line(40), 0)]
        if i % 2:
            lines += [(f"Lees ook: {other}", 1), (line(35), 0)]
        lines += [(f"{i + 3} reacties", 1), ("Schrijf u in voor onze maandelijkse brief en lees iedere maand het laatste uit het depot. " * 6, 1), ("Alle rechten voorbehouden", 1), (f"Stichting Depot {s}", 1)]
        rows.append((f"d{s}_{i:03d}", f"site{s}", title, "html", "\n".join(t for t, _ in lines), "x"))
        want[f"d{s}_{i:03d}"] = {k for k, (_, y) in enumerate(lines) if y}
    return rows, want


def test_furniture_without_fixed_words(spark):
    rows, want = _dutch(60)
    pages = spark.createDataFrame(rows, "doc_id string, source_id string, title string, source_type string, clean_text string, line_no string")
    model = boilerplate.fit(pages, sample=90)
    seen = {r.doc_id for r in pages.orderBy(boilerplate.F.xxhash64("doc_id"), "doc_id").limit(90).collect()}
    good = total = 0
    for doc, _, title, _, text, _ in rows:
        if doc not in seen:  # held out
            got = set(boilerplate.furniture_lines(text, title, False, model))
            total += text.count("\n") + 1
            good += text.count("\n") + 1 - len(got ^ want[doc])
    assert total > 700 and good / total > 0.98, good / total


def test_long_furniture(spark):
    menu = " | ".join(["Home", "People", "Search", "Shop"] * 25)
    notice = "We use cookies to remember your choices. You can change this in your settings at any time. " * 7
    pages = [(f"d{i}", "A history of tapes", "html", f"{menu}\n{notice}\n{PAGE}\n{menu}", 0) for i in range(30)]
    got = boilerplate.furniture(spark.createDataFrame(pages, "doc_id string, title string, source_type string, clean_text string, line_no int"))
    assert sorted(r.line_no for r in got.filter("doc_id = 'd4'").collect()) == [0, 1] + [i + 2 for i in OUT] + [PAGE.count("\n") + 3]


def test_decoding_keeps_the_tree_consistent():
    import numpy as np

    pages = boilerplate.Pages(["\n".join(["Menu", "T", "x" * 120, "a", "b", "c"])], ["T"], [False], lambda t: boilerplate.own_features(t, boilerplate.Odds([], [])))
    for leaf in (np.array([3.0, 3, -3, 3, -0.2, 3]), np.array([1.0, 1, -3, 2, 2, 0.5])):
        for group in np.random.default_rng(1).normal(size=(20, len(pages.group_at))) * 3:
            gone = pages.decode(leaf, group)
            assert not gone[1]  # the title


def test_trees_held_out():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 6))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    t = boilerplate.Trees(trees=40, depth=4).fit(x[:1500], y[:1500])
    assert ((t.logit(x[1500:]) > 0) == (y[1500:] > 0.5)).mean() > 0.93
