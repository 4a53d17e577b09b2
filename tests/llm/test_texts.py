import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kgloom.llm import encode, lookalike, packing, sentences, spam


# --- encoding -------------------------------------------------------------------------
@pytest.fixture(scope="module")
def codec():
    return encode.encoder(encode.vocabulary_path())


@pytest.fixture(scope="module")
def public():
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_exact_merges_and_round_trip(text):
    import base64

    import public_tokenizers as P
    import tiktoken

    global _PUBLIC
    try:
        enc = _PUBLIC
    except NameError:
        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = _PUBLIC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = encode.encoder(encode.vocabulary_path())
    text = text.encode("utf-8", "ignore").decode("utf-8")
    ids = e.encode(text)
    assert ids == enc.encode_ordinary(text)
    assert e.decode(ids) == text


def test_long_pieces_take_linear_time(codec, public):
    for s in ("a" * 30_000, "=-" * 10_000, "继" * 5_000):
        assert codec.encode(s) == public.encode_ordinary(s)


def test_encoded_rows(spark):
    d = spark.createDataFrame([(1, "hello world", 1), (2, "", 2), (3, None, 3), (1, "hello world", 1)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encode.encoded(d).collect() if r.ids is not None)
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, [])]
    assert encode.encoded(d).filter("ids is null").count() == 1
    assert encode.encoded(spark.createDataFrame([], d.schema)).count() == 0


def test_round_trip_and_null_texts(spark):
    d = spark.createDataFrame([(1, "hello wörld 继"), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in encode.round_trip(d).collect())[1:] == [(2, 0, True), (3, None, None)] and encode.round_trip(d).filter("same").count() == 2
    got = {r.doc_id: r.container_id for r in packing.packed(encode.token_counts(d), 16).collect()}
    assert set(got) == {1, 2, 3} and got[1] is not None and got[2] is None and got[3] is None


# --- packing --------------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.data())
def test_best_fit_against_brute_force(capacity, data):
    sizes = sorted(data.draw(st.lists(st.integers(1, capacity), max_size=60)), reverse=True)
    box, offset = packing.best_fit_decreasing(sizes, capacity)
    room, used = [], {}
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits)[1]] -= s
        else:
            room.append(capacity - s)
    for b, o, s in zip(box, offset, sizes):
        assert used.get(b, 0) == o
        used[b] = o + s
    assert sorted(capacity - u for u in used.values()) == sorted(room)


def test_packed_rows(spark):
    random.seed(1)
    rows = [(i, random.choice([0, 1, 5, 60, 99, 100, 101, 250])) for i in range(400)] + [(1000, None), (1001, 60), (1001, 60)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, n_tokens int"), 100, containers_per_shard=16).collect()
    fill = {}
    for r in got:
        if r.container_id is not None:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.token_end - r.token_start
    assert max(fill.values()) <= 100
    total = sum(n or 0 for _, n in rows)
    assert sum(fill.values()) == total and len(fill) <= 1.15 * total / 100 + 16
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append((r.token_start, r.token_end))
    for i, n in rows[:400]:
        p = sorted(pieces[i])
        assert p[0][0] == 0 and p[-1][1] == n and all(a[1] == b[0] for a, b in zip(p, p[1:]))
        if n <= 100:
            assert len(p) == 1
    assert packing.packed(spark.createDataFrame([], "doc_id long, n_tokens int"), 100).count() == 0


# --- look-alikes ----------------------------------------------------------------------
def test_plain_forms():
    assert lookalike.plain("Ｆｕｌｌ　ﬁne​­ x y é a‑b") == "Full fine x y é a-b"
    assert lookalike.plain("x² … Ⅳ ½") == "x² … Ⅳ ½"  # visible differences stay
    assert lookalike.plain("") == ""


def test_script_aware_repair():
    assert dict(lookalike.suspects("Оnlу the соdе")) == {"Оnlу": "Only", "соdе": "code"}
    assert lookalike.suspects("машина работает") == [] and lookalike.suspects("plain") == []
    assert dict(lookalike.suspects("мaшинa работает")) == {"мaшинa": "машина"}


def test_more_scripts():
    assert lookalike.plain("𝐀𝐥𝐩𝐡𝐚") == "Alpha"
    assert dict(lookalike.suspects("cօde here")) == {"cօde": "code"} and dict(lookalike.suspects("ᎪLPHA")) == {"ᎪLPHA": "ALPHA"}


def test_classes_give_the_links_of_the_pairs(spark):
    random.seed(9)
    swap = {"a": "а", "e": "е", "o": "о"}
    rows = [("f", "0", "the code", "")] * 3 + [("f", f"h{i}", "the code", "") for i in range(40)]
    rows += [("f", f"{i:03d}", "".join(swap.get(c, c) if random.random() < 0.3 else c for c in random.choice(["the code", "a proof", "one tape"])), "") for i in range(60)]
    texts = spark.createDataFrame(rows, "field string, id string, text string, form string")
    links = {}
    for _, a, b in _pairs(spark, rows):
        links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
    got = {r.id: r.n_links for r in lookalike.lookalike_classes(texts).collect()}
    assert got == links
    forms = {r.id: r.form for r in lookalike.canonical_forms(texts).collect()}
    assert forms["h1"] == "the code" and set(forms) == {r[1] for r in rows}


def _pairs(spark, rows):
    return sorted(tuple(r) for r in lookalike.lookalike_pairs(spark.createDataFrame(rows, "field string, id string, text string, form string")).collect())


def test_pairs(spark):
    rows = [
        ("f", "1", "the code", ""), ("f", "2", "thе соdе", ""), ("f", "3", "the code", ""), ("f", "4", "The code", ""), ("f", "5", None, ""), ("f", "6", "", ""),
        ("f", "7", "the code", ""), ("f", "1", "the code", ""), ("g", "8", "thе code", ""), ("f", "9", "the códe", ""), ("f", "10", "rаrе wоrd", ""), ("f", "11", "rarе wоrd", ""),
    ]
    assert _pairs(spark, rows) == sorted([("f", "1", "2"), ("f", "1", "3"), ("f", "2", "3"), ("f", "2", "7"), ("f", "3", "7"), ("f", "10", "11")])
    assert _pairs(spark, []) == []


def test_pairs_against_brute_force(spark):
    random.seed(4)
    swap = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "x": "х", "y": "у"}
    words = "alpha beta code proof tape store the relay counter gate".split()
    rows = []
    for i in range(160):
        t = " ".join(random.choices(words[:6], k=3))
        if i % 3 == 0:
            t = "".join(swap.get(c, c) if random.random() < 0.4 else c for c in t)
        if i % 7 == 0:
            t = t.replace(" ", " ", 1)
        rows.append(("f", f"{i:03d}", t, ""))
    back = {v: k for k, v in swap.items()}
    skeleton = lambda t: unicodedata.normalize("NFKC", "".join(back.get(c, c) for c in t))
    want = sorted(("f", a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[2] != b[2] and skeleton(a[2]) == skeleton(b[2]))
    assert _pairs(spark, rows) == want


# --- sentences ------------------------------------------------------------------------
CASES = [
    ('Her note reads: "Do not touch. Do not oil. Do not ask." Critics found the growth.', 2),
    ('"It works!" she shouted across the hall. He left.', 2),
    ("« Est-ce qu'elle s'arrête ? » demanda Pagruth. M. Krad partit.", 2),
    ("他问：“它会停机吗？”1931年，他在北原出生。“带子是空的。读头在等待。”他写道。后来", 4),
    ("「テープは空だ。ヘッドは待っている。」と書かれている。「それは止まるのか？」と彼女は尋ねた。", 2),
    ("He moved to the U.S. in 1955. Dr. J. K. Krub arrived at 9 a.m. and left. The trials ended at 6 p.m. She left.", 4),
    ("See Fig. 443 and vol. 432, no. 46, for it. Its store held 5.", 2),
    ("kept 3 in reserve.Unknown to X, it ran 3.85 MHz.By all accounts", 3),
    ("Im 19. Jh. kannte man 5. Am 3. März 1930 begann. Tabelle Nr. 2. Benedra kam usw. Zik schrieb.", 5),
    ("Das Band enthält u. a. die Tabelle. Er lehrte Logik, d. h. Beweistheorie.", 2),
    ("Θα σταματήσει ποτέ; Η απόδειξη δημοσιεύτηκε το 1910. Ο κ. Foo δίδαξε λογική, δηλ. θεωρία.", 3),
    ("в 1893 г. в городе. «Она остановится?» — спросил Xavier. Архив хранит 9 писем и т. д. См. рис. 2 и стр. 1.", 4),
    ("በ1913 ዓ.ም. በምሥራቅበር ተወለደ። መቼ ይቆማል? በ1932", 3),
    ("the keys. de Gruweir never answered. The relay clicked... and then nothing moved.", 3),
    ("What could 20 states not do?! The count. (The signals were later scrapped.) It printed", 4),
    ("Las cartas de EE. UU. llegaron en 1933. ¡La nota se perdió! ¿Por qué no? La Sra. Vovith dejó.", 4),
    ("2. Drusilla Krofopox, operator", 1),
    ("قال د. Trazeit إن الشريط فارغ. هل تتوقف الآلة؟ وُلد في 1922.", 3),
    ("डॉ. Nus ने पढ़ाया। क्या यह रुकेगा? 1964 की", 3),
    ("打字机每秒运行38.13次……然后停了。后来", 2),
    ("They bought cards from X Bros. Ltd. for 5. She left.", 2),
]


@pytest.mark.parametrize("text,n", CASES)
def test_units(text, n):
    got = sentences.sentence_units(text)
    assert len(got) == n, [text[a:b] for a, b in got]


AMBIGUOUS = [
    ("He told me. Then he left.", None, 2), ("They met at the dept. Later they left.", None, 2), ("We saw the mt. It rose.", None, 2), ("Vitamin C. It helps the crew.", None, 2), ("He lives on Mt. Krub in the north.", None, 1),
    ("Il a vu Me. Krub hier dans la salle.", None, 1), ("She met J. Krub at the hall. He left.", None, 2), ("Gen. Krub was there. It rained.", None, 2), ("The authors (Krub et al. 1931) agree.", None, 1), ("Read Krub et al. They agree.", None, 2),
    ("Dijo que no. 3 cartas llegaron por la noche.", None, 2), ("See the table in no. 3 of the list.", None, 1), ("Er sprach mit Fr. Krub und mit dem Wirt. Dann ging er.", None, 2), ("Krub. Fr. Zik", "de", 2), ("La Sra. Krub y el Sr. Zik. Luego nada.", None, 2),
    ("Univ. Krub paid for it. Nobody knew.", None, 2), ("The plan b. Then it was over.", None, 2),
]


@pytest.mark.parametrize("text,language,n", AMBIGUOUS)
def test_units_by_language(text, language, n):
    got = sentences.sentence_units(text, language=language)
    assert len(got) == n, [text[a:b] for a, b in got]


def test_pieces_and_lines():
    assert [len(sentences.sentence_units(t, piece=True)) for t in ('"The tape is blank. The head waits.', 'Do not oil. Do not ask." The translation of networks', "2.", " ", "")] == [1, 2, 1, 0, 0]
    assert len(sentences.sentence_units("Menu\nHome\n\nA line that\nwraps. End.")) == 5
    assert len(sentences.sentence_units("Menu\n\nA line that\nwraps. End.", wrapped=True)) == 3
    assert sentences.sentence_units(None) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB. \n\"“”!?。1(«»…é", max_size=60), st.booleans(), st.booleans())
def test_units_cover_the_text(text, wrapped, piece):
    got = sentences.sentence_units(text, wrapped, piece)
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
    inside = {i for a, b in got for i in range(a, b)}
    assert all(i in inside for i, c in enumerate(text) if not c.isspace())


def test_unit_rows(spark):
    docs = spark.createDataFrame([("d", "html", "One. Two.\nThree", "x"), ("e", None, None, "x"), ("d", "html", "One. Two.\nThree", "x")], "doc_id string, source_type string, clean_text string, text string")
    rows = spark.createDataFrame([("s", "One. Two.", 0), ("s", "One. Two.", 0)], "sentence_id string, text string, offset_start int")
    assert sorted(tuple(r) for r in sentences.all_units(docs, rows).collect()) == [("document_records", "d", 0, 4), ("document_records", "d", 5, 9), ("document_records", "d", 10, 15), ("sentences", "s", 0, 4), ("sentences", "s", 5, 9)]


# --- spam -----------------------------------------------------------------------------
PROSE = ["The archive keeps the letters of the first operators.", "Nobody expected the machine to settle the question.", "She wrote a paper on the growth of tables while living by the river.", "Its store held three hundred words, each read once per turn of the drum.", "Critics found the design too austere; others praised it."]


def test_spam_pages(spark):
    random.seed(2)
    prose = [" ".join(random.choices(PROSE, k=8)) + f" In {1900 + i} it ended." for i in range(60)]
    words = "relay kit"
    bad = {
        100: "\n".join(random.choice([words, f"{words} cheap", f"buy {words}", f"{words} online"]) for _ in range(60)),
        101: ", ".join(f"{random.choice(['best', 'new', 'used'])} {words}" for _ in range(60)),
        102: "\n".join(f"www.shop-{random.randint(0, 9999)}.test/item_{i}" for i in range(15)),
        103: " ".join(f"#Tag{random.randint(0, 9999)}" for _ in range(40)),
        104: "Our relay kit is the relay kit that relay kit buyers choose. Why relay kit? Because relay kit fans love relay kit! Cheap relay kit, new relay kit and used relay kit for all. " * 6,
    }
    good = {
        200: "\n".join(f"09:{i:02d} step {i}: the head reads {i % 2}, writes 1 and moves left." for i in range(30)),
        201: "Contents\n" + "\n".join(f"1.{i} The order of things ......... {i * 7}" for i in range(20)),
        202: PROSE[0] + " " + " ".join(PROSE) + "\n#one #two",
        203: "\n".join(f'[{i}] A. Name, "On the growth of tables", Proceedings {i} (19{i:02d}), pp. 1-9.' for i in range(10, 25)),
    }
    rows = [(i, t, None) for i, t in enumerate(prose)] + [(i, t, None) for d in (bad, good) for i, t in d.items()] + [(300, None, None), (301, "", None), (302, "  ", None), (100, bad[100], None)]
    got = {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string, ratio int")).collect()}
    assert got == set(bad)
    assert spam.spam_pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spam_short_and_half_stuffed(spark):
    random.seed(3)
    prose = [" ".join(random.choices(PROSE, k=8)) + f" In {1900 + i} it ended." for i in range(60)]
    stuffed = ", ".join(f"{random.choice(['best', 'new', 'used'])} relay kit" for _ in range(200))
    odd = {100: "buy shoes, " * 5, 101: prose[0] + "\n" + stuffed, 102: "\n".join(f"https://shop.test/{random.randint(0, 10**9):x}/{random.randint(0, 10**9):x}" for _ in range(30))}
    fine = {200: "Buy shoes.", 201: " ".join(random.choices(PROSE, k=40)) + "\nrelay kit, relay kit, relay kit", 202: "См. рис. 28 и стр. 165. См. рис. 712 и стр. 555.", 203: "See https://a.test/x for the list."}
    rows = [(i, t, "EN ", 1) for i, t in enumerate(prose)] + [(i, t, None, 1) for d in (odd, fine) for i, t in d.items()]
    got = {r.doc_id for r in spam.spam_pages(spark.createDataFrame(rows, "doc_id long, text string, lang string, ratio int")).collect()}
    assert got == set(odd)


def test_no_text_with_units_is_skipped():
    import itertools

    assert len(sentences.sentence_units("„Es läuft!“ Niemand antwortete.")) == len(sentences.units("„Es läuft!“ Niemand antwortete.", 0, 31)) == 2
    assert len(sentences.sentence_units("Er sagte: „Das ist gut.“ Danach ging er.")) == 2
    for a, mark, b, c, gap, d in itertools.product(("Er kam", "„Es lief", "‹Ja", "「好"), ".!?…。;", ("", *sentences.CLOSERS, *sentences._OPEN), ("", "“", "›", "』", ")"), ("", " "), ("Niemand kam.", "“Nein.", "2 kamen.", "niemand.", "他走了。")):
        t = a + mark + b + c + gap + d
        assert sentences._INNER.search(t) or len(sentences.units(t, 0, len(t))) < 2, t
