"""Literal rows for every text rule."""

import sys
import unicodedata

from pyspark.sql import functions as F

from marginalia.functions import citations as C
from marginalia.functions import grading as G
from marginalia.functions import mining as M
from marginalia.functions import quality as Q
from marginalia.functions import text as T
from marginalia.operators import report as R


def test_caption_chunk(one):
    got = one(
        Q.is_caption, "Figure 6:The horizontal profile of ROI [1]", "Table 4. Ablation results on the validation set.",
        "We evaluate our approach on three datasets " * 20, "Figure 1: " + "x" * 400,
    )
    assert got == [True, True, False, False]


def test_caption_sentence(one):
    got = one(
        Q.is_caption_sentence, "**Table 3: Variations on the Transformer**", "Figure 1: The Transformer - model architecture.",
        "As Figure 6 shows, the profile peaks near the nose.",
    )
    assert got == [True, True, False]


def test_boilerplate(one):
    header = "(IJCSIS) International Journal of Computer Science and Information Security, Vol. 7, No. 1, 2010"
    prose = " we propose the method combine both feature-based and image-based approach to detect the point between the eyes by using a Six-Segmented Rectangular filter."
    got = one(
        Q.boilerplate_rule, header, header + prose, "AUTHORS PROFILE She has completed her Bachelor of engineering from XYZ University.",
        "ISSN 1947-5500", "(a) Text prompt: a teddy bear on a bench", "We propose a novel method for face detection.", "- 12 -",
        "https://host.example/a.pdf", "", "The editor hereby grants permission to reproduce the tables.", "(c) 2020 The Press",
    )
    assert got == [
        "journal_header", None, "author_profile", "id_stamp", None, None, "page_number", "url", None, "licence", "copyright",
    ]


def test_front_matter(one):
    assert one(
        Q.strip_title_block, "J. Doe, Anna University, Chennai, India Abstract— We propose a vision-based tracker.",
        "The abstract syntax tree is built in one pass.", "{a, b}@mail.example.edu\n\nWe propose a new method for inpainting.",
        "Write to us at a@b.edu for the dataset.",
    ) == [
        "We propose a vision-based tracker.", "The abstract syntax tree is built in one pass.", "We propose a new method for inpainting.",
        "Write to us at a@b.edu for the dataset.",
    ]


def test_prose_score(one):
    prose, noise = one(
        Q.prose_score, "We propose a method to detect the point between the eyes.",
        "File Help Scale Factor xan fiz.e=] yaxs Refresh Preview Show Eyes Show Blink Show Nose Show Eyebrows",
    )
    assert prose > 0.3 and noise < 0.15


def test_cloze_number(one):
    texts = [
        "Our model achieves 28.4 BLEU on the translation task.", "It uses tricks [21].", "Many architectures [38, 24, 15].",
        "We test on newstest2013.", "It is as shown in Figure 1.", "Performance on TG-2 is shown here.", "It costs $5 and 20% more.", "t2013.5 then 7",
    ]
    assert one(M.blanked_value, *texts) == ["28.4", None, None, None, None, None, "$5", "7"]
    assert one(M.blanked_sentence, texts[0]) == ["Our model achieves ____ BLEU on the translation task."]


def test_usable_text(one):
    got = one(
        Q.is_usable, "The encoder is composed of a stack of N = 6 identical layers.", "1http://www.collectspace.com/images/news-091516d-lg.jpg 2",
        "This section could not be written.",
    )
    assert got == [True, False, False]


def test_marker_repair(one):
    got = one(
        lambda c: T.repair_markers(c, F.lit(5)), "The nose is brighter. [n] 3", "...lighting conditions **(1)**.", "substituting into (5) gives",
        "out of range **(97)** here", "bare [n] mark",
    )
    assert got == ["The nose is brighter. [3]", "...lighting conditions [1].", "substituting into (5) gives", "out of range **(97)** here", "bare mark"]


def test_snippets(one):
    text = "First sentence is here. Second one goes on and on without an end for a while"
    assert one(lambda c: T.clean_snippet(c, 40), text, "short  text") == ["First sentence is here.", "short text"]
    assert one(lambda c: T.clean_snippet(c, 20), "alpha, beta, gamma, delta, epsilon") == ["alpha, beta, gamma…"]


def test_body_blocks(one):
    body = "- one\n- two\n\n3. three is\nlonger\n\n\n"
    assert one(T.body_blocks, body) == [["one", "two", "three is longer"]]


def test_preamble(one):
    assert one(T.strip_preamble, "Here is the summary:\n\nBody.", "```md\nBody.\n```", "Body: text") == ["Body.", "Body.", "Body: text"]


def test_intents(one):
    asked = {
        "cite this in bibtex": "citation", "how do I cite this": "citation", "bibtex": "citation", "who wrote this?": "metadata",
        "how many figures are in this paper": "structure", "what is the MLA dataset used for": "content",
        "what IEEE standard does it follow": "content", "which papers does this cite?": "content", "What are the limitations of this work?": "content",
    }
    assert one(C.intent, *asked) == list(asked.values())


def test_author_names(one):
    names = {
        "S. Sumathi": ("S.", "Sumathi"), "Sumathi S.": ("S.", "Sumathi"), "Ms.S.Sumathi": ("S.", "Sumathi"), "Sumathi, S.": ("S.", "Sumathi"),
        "M. Uma Maheswari": ("M. Uma", "Maheswari"), "Plato": ("", "Plato"), "": ("", ""),
    }
    assert [tuple(r) for r in one(C.split_name, *names)] == list(names.values())


def test_grading(spark):
    rows = [
        ("idk", ["Attention"]), ("the attention", ["Attention"]), ("Multi-head  attention!", ["multi head attention"]), ("", ["x"]),
        ("scaled dot products attention", ["scaled dot product attention layer"]), ("nothing alike", ["gradient descent"]),
    ]
    df = spark.createDataFrame(rows, "a string, acc array<string>").select(G.grade_short_answer(F.col("a"), F.col("acc")).alias("v"))
    got = [(r.v.is_correct, r.v.exact, round(r.v.overlap, 2)) for r in df.collect()]
    assert got == [(False, False, 0.0), (True, False, 1.0), (True, True, 1.0), (False, False, 0.0), (True, False, 0.8), (False, False, 0.0)]


def test_content_tokens(one):
    assert one(G.content_tokens, "The model's 28.4% multi-task scores") == [["model", "28.4%", "multi", "task", "scores"]]
    assert one(G.normalize_text, "“Straße—Ｆｕｌｌ…”") == ["strasse-full"]


def test_terms(one):
    assert one(M.term_variants, "Byte Pair Encoding (BPE)") == [["Byte Pair Encoding (BPE)", "Byte Pair Encoding", "BPE"]]
    masked = one(lambda c: M.mask_term(c, F.lit("Byte Pair Encoding (BPE)")), "BPE's table and byte pair encodings, not BPEX")
    assert masked == ["___ table and ___, not BPEX"]


def test_number_mutation(spark):
    rows = spark.createDataFrame([("2017", ""), ("0", ""), ("28.4", "%"), ("0.0", ""), ("12", "%"), ("1.25", "")], "v string, s string")
    got = [r[0] for r in rows.select(M.mutate_number(F.col("v"), F.col("s"))).collect()]
    assert got == ["2024", "1", "56.8%", "1.5", "24%", "2.5"]


def test_predicates(one):
    assert one(M.as_predicate, "It is defined as a stack of layers", "This is a", "In this work, these are simple ideas") == [
        "a stack of layers", "This is a", "simple ideas",
    ]
    assert one(M.lower_first, "Attention is", "BPE is", "") == ["attention is", "BPE is", ""]


def test_article_ids(one):
    assert one(T.paper_id_of, "arXiv:2401.00001v2", "cs.CL/0301001", "nonsense", "2401.123") == ["2401-00001", "cs-cl-0301001", None, None]


def test_figure_mentions(one):
    text = "As Figures 6 and 7 and Table 4-5 show, unlike Fig. 9."
    assert [[tuple(m) for m in r] for r in one(R.mentioned_figures, text)] == [
        [("figure", 6), ("figure", 7), ("table", 4), ("table", 5), ("figure", 9)]
    ]
    assert one(R.label_number, "Figure 6", "Figure (p3)", "Table 4", "") == [6, None, 4, None]


def test_headings(one):
    from marginalia.sources.readers import looks_like_heading

    got = one(lambda c: looks_like_heading(c, F.lit(False)), "2.1 Model architecture", "References", "We go on.", "x" * 120)
    assert got == [True, True, False, False]


def test_card_plans_compile(spark, sf, capfd):
    from marginalia.catalog import all_queries

    for name in ("cards_definitions", "cards_cloze", "cards_recall"):
        all_queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
    assert "grows beyond 64 KB" not in "".join(capfd.readouterr())


def test_compatibility_fold_equals_the_standard(spark):
    """Every character that the fold changes, every composed letter taken apart, and what surrounds them."""
    codes = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    changed = [c for c in codes if unicodedata.normalize("NFKC", c) != c]
    apart = [unicodedata.normalize("NFD", c) for c in codes if 0xC0 <= ord(c) < 0x2000 and unicodedata.normalize("NFD", c) != c]
    texts = [*changed, *apart, *codes[:3000], *codes[3000::97], *(f"a{c}b" for c in changed[::7]), "½ of ﬃ ㍿ Ǆ", "plain", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.f for r in rows.select("i", G.fold_compatibility(F.col("text")).alias("f")).collect()}
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != unicodedata.normalize("NFKC", t)] == []


def test_no_pattern_lists_the_characters_of_the_fold(spark, one):
    """A class of a thousand characters is tried one by one on every character of a text that is not all ASCII."""
    plan = spark.range(1).select(G.fold_compatibility(F.lit("é").substr(F.col("id").cast("int"), F.lit(1))))._jdf.queryExecution().analyzed().toString()
    assert "\\x{" not in plan
    long = "café ½ of ﬃ, 1 ㎏ and more " * 40
    assert one(G.fold_compatibility, long, "x…", "…\n…", "né") == [unicodedata.normalize("NFKC", t) for t in (long, "x…", "…\n…", "né")]


def test_tokens_with_and_without_joints(one):
    got = one(G.content_tokens, "State-of-the-art models don't use 3-gram counts 12.5% plain", "a-b it's --x--", "")
    assert got == [["state", "art", "models", "don", "3", "gram", "counts", "12.5%", "plain"], [], []]
