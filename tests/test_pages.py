"""Main text of pages and rule sentences, by the rules of the original."""

import pytest

from kgloom.functions import pages, splitter
from kgloom.operators import linking, metrics

P = "<p>{}</p>"
LONG = "The archive keeps the letters of the first operators, and nobody expected the machine to settle it."


def test_containers_are_spared():
    story = f'<div class="related-story"><h2>On looms</h2>{P.format(LONG)}{P.format("Second paragraph of it.")}{P.format("Third one, too.")}</div>'
    assert LONG in pages.main_text(f"<body>{story}</body>") and "Second paragraph" in pages.main_text(f"<body>{story}</body>")
    assert "Alone" not in pages.main_text(f'<body>{P.format(LONG)}<div class="related"><p>Alone it goes away.</p></div></body>')


def test_hidden_and_noise():
    html = f'<body><header><nav>Menu of the site, in the header</nav></header><nav><p>Kept, as it is in no header.</p></nav><!-- note --><script>x</script><article>{P.format(LONG)}<p style="opacity: 0">Gone by its style.</p><p hidden>Gone too.</p><p aria-hidden="true">And this.</p></article><footer>Terms</footer></body>'
    got = pages.main_text(html)
    assert LONG in got and not any(x in got for x in ("Menu", "Gone", "And this", "Terms", "note"))
    bare = pages.main_text(f"<body><nav>{P.format('A sentence in a plain nav element.')}</nav></body>")
    assert "nav" not in bare or bare == "A sentence in a plain nav element."


def test_references_and_contents():
    body = "".join(P.format(x) for x in (LONG, LONG[::-1], "[1] The first.", "[2]", "1.1 Start 1.2 Middle", "Retrieved 3 May", "He said so. [12]", "( spaced ) words , here"))
    got = pages.main_text(f"<body>{body}<h2>References</h2><p>{LONG}</p></body>").split("\n\n")
    assert got[2:] == ["The first.", "He said so.", "(spaced) words, here"]
    assert "See also" in pages.main_text(f"<body><h2>See also</h2><p>{LONG}</p></body>")  # no tail before a body


def test_lists_and_repeats():
    got = pages.main_text(f"<body><article><li>short item</li><li>an item of more than twenty-four letters</li><p>{LONG}</p><p>{LONG}</p></article></body>").split("\n\n")
    assert got.count("short item") == 0 and got.count("an item of more than twenty-four letters") == 1
    assert pages.main_text(None) is None and pages.main_text("") == "" and pages.main_text("<b>no block") == "no block"


def test_preface_before_numbered_chapters():
    pre = "".join(P.format(f"Preface line {chr(97 + i)}, with words.") for i in range(9))
    body = "".join(f"<h2>{i}. Chapter with name</h2>{P.format(LONG + str(i))}" for i in range(1, 6))
    got = pages.main_text(f"<article>{pre}{body}</article>")
    assert "Preface" not in got and LONG + "1" in got


DISCARDED = ["abc", "[1] [2]", "--- ***", "1.2.3", "12", "Retrieved 3 May 2001.", "^ Somebody.", "Author: someone", "Vol. 3 of the work, 1950.", "Alan Turing Home Page", "Topic: looms", "Turing, A. M."]
KEPT = ["He left it.", "see 1.1 and 1.2 and 1.3 of it", "The work went on", "In 1936: the paper", "A long line: with more than thirty-six letters in it"]


@pytest.mark.parametrize("text,gone", [(t, True) for t in DISCARDED] + [(t, False) for t in KEPT])
def test_discarded_sentences(text, gone):
    assert splitter.discard(text) == gone


def sentences(text):
    return [s for _, s, _, _ in splitter.rule_sentences(text)]


def test_headings_close_and_meet():
    assert sentences("Chapter 2 Early work on looms\n\nthe second line\n\nHe left. She stayed.") == ["Early work on looms the second line.", "He left.", "She stayed."]
    assert sentences("早期的工作和生活\n\n他离开了。") == ["早期的工作和生活。", "他离开了。"]


def test_lines_within_a_block():
    assert sentences("Early work here\nHe left it. She stayed.\nThey met.") == ["Early work here.", "He left it.", "She stayed.", "They met."]
    assert sentences("He left the hall,\nand she stayed in\nthe other one.") == ["He left the hall, and she stayed in the other one."]
    assert sentences("Alan\n \nMathison was born there. He left.") == ["Alan Mathison was born there.", "He left."]
    assert sentences("1.1 Looms 1.2 Cards") == ["Looms.", "Cards."]  # contents


def test_cleaning():
    assert splitter.clean('He said"so it is"then. [3]') == 'He said "so it is" then.'
    assert splitter.clean("t he loom and T uring saw A man , here") == "the loom and Turing saw A man, here"
    assert splitter.clean("2.3 The looms") == "The looms" and splitter.clean("( a )") == "(a)"


def test_boundaries():
    assert sentences("It ran 3.14 times. Dr. Krub left... He saw the U.S. army. It was J. Krub! Yes?") == ["It ran 3.14 times.", "Dr. Krub left... He saw the U.S. army.", "It was J. Krub!", "Yes?"]
    text = "First one here.  Second\nline of it goes on and on. First"
    for _, s, a, b in splitter.rule_sentences(text):
        assert "".join(text[a:b].split()).rstrip(".") == "".join(s.split()).rstrip(".")
    assert sentences("He left. He left. She stayed.") == ["He left.", "She stayed."] and sentences(None) == [] == sentences("")


# --- measures -------------------------------------------------------------------------
def test_link_scores(spark):
    schema = "mention_id string, doc_id string, sentence_id string, token_start int, token_end int, decision string, entity_id string, top array<string>"
    p = spark.createDataFrame([("1", "d", "s", 0, 1, "LINKED", "A", ["A", "B"]), ("2", "d", "s", 1, 3, "REVIEW", "B", ["C", "B"]), ("3", "x", "y", 0, 1, "NIL", None, None), ("4", "d", "s", 5, 7, "LINKED", "A", ["A"])], schema)
    g = spark.createDataFrame([("1", "d", "s", 0, 1, "A"), ("2", "d", "s", 1, 3, "B"), ("3", "d", "s", 3, 4, "NIL"), ("4", "d", "s", 5, 7, ""), ("9", "d", "s", 8, 9, "Z")], "mention_id string, doc_id string, sentence_id string, token_start int, token_end int, entity_id string")
    r = metrics.link_scores(p, g).first()
    assert (r.n, r.matched, r.missing, r.gold_linked, r.recall_at_1, r.recall_at_5, r.accuracy, r.nil_precision, r.short_accuracy) == (5, 4, 1, 2, 0.5, 1.0, 0.5, 0.5, 1.0)
    assert metrics.link_scores(p, g.limit(0)).first().accuracy is None


def test_gaps(spark):
    rows = [("Xyz", "PERSON", f"d{i}", "NIL", 0, f"c{i}") for i in range(3)] + [("Abc", "PLACE", "d", "REVIEW", 2, None)] * 4 + [("Ok", "PERSON", "d", "LINKED", 1, "c")] * 9
    d = spark.createDataFrame(rows, "text string, type string, doc_id string, decision string, n_candidates int, context string")
    got = {r.text: (r.n, r.priority) for r in linking.gaps(d).collect()}
    assert got == {"Xyz": (3, "P0"), "Abc": (4, "P1")}
    assert [r.context for r in linking.gap_contexts(d, linking.gaps(d)).orderBy("rank").collect()] == ["c0", "c1", "c2"]


def test_illegal_and_sequence_confidence(spark):
    d = spark.createDataFrame([(["I-PER", "I-PER", "O"], [0.9, 0.5, 0.1]), (["B-PER", "I-ORG"], [1.0, 0.0]), (["O"], [0.4])], "labels array<string>, c array<double>")
    assert tuple(metrics.illegal_counts(d).first()) == (2, 1, 2)
    assert [r.x for r in d.select(metrics.sequence_confidence(d.labels, d.c).alias("x")).collect()] == [0.7, 0.5, 0.4]


def test_slices(spark):
    t = spark.createDataFrame([("1", "At the University of X"), ("2", "no")], "key string, text string")
    g = spark.createDataFrame([("1", 0, 2, "ORG"), ("2", 0, 1, "PER")], "key string, s int, e int, type string")
    got = {r.phrase: (r.n_texts, r.tp, r.fp, r.fn) for r in metrics.slice_scores(t, g, g.limit(1), ["university of", "absent"]).collect()}
    assert got == {"university of": (1, 1, 0, 0)}
