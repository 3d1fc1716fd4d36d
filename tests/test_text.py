import pytest
from pyspark.sql import functions as F

from lectern.functions import rules as R
from lectern.functions import text as T
from lectern.operators import audio, markdown, speech, views
from lectern.operators.sentences import chunk_sentence, sentences, split_sentences
from lectern.operators.text_blocks import text_blocks
from lectern.plans import registry


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("See e.g. Smith. It works.", ["See e.g. Smith.", "It works."]),
        ("We use 3.14 here. Next.", ["We use 3.14 here.", "Next."]),
        ("J. Smith wrote this. Ok.", ["J. Smith wrote this.", "Ok."]),
        ("1. First item. Done.", ["1. First item.", "Done."]),
        ("3.1. Setup is here. Go.", ["3.1. Setup is here.", "Go."]),
        ("It stops.Then it goes.", ["It stops.", "Then it goes."]),
        ("Fin. été suit.", ["Fin.", "été suit."]),
        ('He said "Go." Then left.', ['He said "Go."', "Then left."]),
        ("Wait... Really?", ["Wait...", "Really?"]),
        ("Say no. Yes.", ["Say no. Yes."]),
        ("He left! then came back. End.", ["He left! then came back.", "End."]),
        ("", []),
    ],
)
def test_sentences(text, parts):
    assert split_sentences(text) == parts


def test_long_words_are_looked_at_whole():
    long = "1" + "a" * 250
    assert split_sentences(long + ".Then it goes.") == [long + ".Then it goes."]
    assert split_sentences("b" * 250 + ".Then it goes.") == ["b" * 250 + ".", "Then it goes."]
    assert split_sentences("x.y.Then it. (stops.Then it goes.") == ["x.y.Then it.", "(stops.", "Then it goes."]


def test_chunks():
    assert [list(map(len, chunk_sentence(x))) for x in ("a" * 400, "ab " * 200, "x" * 50 + ", " + "y " * 200, "x" * 200 + ", " + "y " * 200)] == [[381, 19], [377, 221], [379, 71], [201, 379, 19]]


SPEECH = {
    "See Fig. 3 and Figs. 4 and 5": "See Figure 3 and Figures 4 and 5",
    "e.g., cats and i.e. dogs": "for example, cats and that is, dogs",
    "5−3 is −2": "5minus 3 is minus 2",
    "pages 1–2–3": "pages 1-2-3",
    "90% of A & B": "90 percent of A and B",
    "10^5 or 10^−5": "10 to the power of 5 or 10 to the power of minus 5",
    "x × y ± 2": "x times y plus or minus 2",
    "takes ~5 ms, ≤ 9": "takes about 5 ms, at most 9",
    "Smith et al. propose": "Smith et al propose",
    "a ( , b) ; c": "a (b); c",
    "see Sec. 3, Appx. B, Ref. [4]": "see Section 3, Appendix B, Reference [4]",
    "éFig. 3": "éFigure 3",
}


def test_speech_rules(spark):
    rows = spark.createDataFrame([(k,) for k in SPEECH], "t string").select("t", R.clean_for_speech(F.col("t"), citations=False).alias("s")).collect()
    assert {r.t: r.s for r in rows} == SPEECH


def test_groups_skip_nothing(spark):
    frame = spark.createDataFrame([(k,) for k in SPEECH] + [("cf. that",), ("vs them",), ("Eqn. 4",), ("plain",), (None,)], "t string")
    rows = frame.select(R.speech_rules(F.col("t")).alias("a"), R.apply_rules(F.col("t"), R.SPEECH).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


GONE = ["Smith et al., 2020", "Smith, 2020; Jones and Li, 2019b", "2020", "see Smith, 2020, p. 12", "e.g., Smith, 2020;", ";Smith 2020", "cf. Li 2020; 2021", "Li, 2020, §3–4"]
KEPT = ["see Fig. 3", "n = 2020", "in press", "de Vries, 2020", "Smith, Jones, and Li, 2020", "AB 1599", "X;2020"]


def test_citations(spark):
    frame = spark.createDataFrame([(f"a ({x}) b", "a b") for x in GONE] + [(f"a ({x}) b", f"a ({x}) b") for x in KEPT] + [("x [1, 2–3] y", "x y"), ("x [1234] y", "x [1234] y")], "t string, want string")
    assert [r for r in frame.withColumn("got", R.strip_citations(F.col("t"))).collect() if r.got != r.want] == []


def test_plain_text(spark):
    text = "My Paper\n\nA. Author, B. Author\n\nAbstract\n\nWe do inter-\nnational it.\n\nReferences\n\n[1] Foo. [2] Bar."
    rows = text_blocks(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).orderBy("doc_id", "block_id").collect()
    assert [(r.doc_id, r.block_id, r.kind, r.heading) for r in rows] == [(1, 0, "heading", False), (1, 1, "authors", False), (1, 2, "heading", False), (1, 3, "body", False), (1, 4, "reference", True), (1, 5, "reference", False), (1, 6, "reference", False)]
    assert rows[3].text == "We do international it."


def test_normalize(spark):
    samples = ["ﬁne", "e´tude ´e", "a b", "x­y�", "plain  text "]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select("t", T.normalize_text(F.col("t")).alias("n")).collect()
    assert all(r.n == T.normalize(r.t) for r in rows)
    assert T.normalize("ﬁne ´etude") == "fine étude"


def test_markdown():
    table = markdown.blocks_of("| a | b |\n|---|---|\n| 1 | 2 |\n\n| c | d |")
    assert len(table) == 1 and table[0]["text"] == "a, b. 1, 2. c, d" and len(table[0]["rows"]) == 3
    text = "# Title\n\nAnn Lee\n\nSetup\n-----\n\n- item *one*\n- two\n\n```\ncode\n~~~\n$$\nx = 1\n$$\n\n> quoted\n\n[^1]: note\n\n## References\n\n[1] A. [2] B.\n\n# After\n\nprose | cell"
    found = [(b["kind"], b["text"]) for b in markdown.blocks_of(text)]
    assert found == [("heading", "Title"), ("authors", "Ann Lee"), ("heading", "Setup"), ("body", "item one"), ("body", "two"), ("code", "code"), ("equation", "x = 1"), ("body", "quoted"), ("footnote", "note"), ("reference", "References"), ("reference", "[1] A."), ("reference", "[2] B."), ("heading", "After"), ("table", "prose, cell")]
    assert markdown.blocks_of("```\nopen") == [{"kind": "code", "text": "open", "number": None, "heading": False, "rows": None}]
    assert markdown.inline("**b** _i_ [l](u) ![p](q) ~~s~~ `c` &amp; &#65; \\*") == "b i l p s c & A *"


def test_wav():
    data = audio.wav_bytes([[0, 1, -1, 2]], rate=8)
    assert len(data) == 56
    assert memoryview(data)[44:].cast("h").tolist() == [0, 32767, -32768, 32767, 0, 0]


def test_wav_files_at_the_full_rate(spark, tmp_path):
    clips = spark.createDataFrame([(1, 1, [0.5]), (1, 0, [0.0, 1.0, -1.0]), (2, 0, [2.0])], "doc_id long, sentence_id int, samples array<float>")
    assert {r.doc_id: bytes(r.wav) for r in audio.wav_files(clips, rate=8).collect()} == {1: audio.wav_bytes([[0, 1, -1], [0.5]], rate=8), 2: audio.wav_bytes([[2.0]], rate=8)}
    spark.sql("SELECT 7L conv_id, 0L turn, 'user' role, 'fourteen chars' text").write.parquet(f"{tmp_path}/conversations.parquet")
    wav = bytes(registry.tts_wav(spark, tmp_path).first().wav)
    assert int.from_bytes(wav[24:28], "little") == 24000 and len(wav) == 44 + 2 * (24000 + 6000)


def test_durations(spark):
    rows = spark.createDataFrame([(406,), (420,), (49000,), (50400,), (75600,)], "n long").select(views.reading_time(F.col("n")).alias("l")).collect()
    assert [r.l for r in rows] == ["under a minute", "1 min", "58 min", "1 h 0 min", "1 h 30 min"]


def test_sentence_rows_and_partitions(spark):
    docs = spark.createDataFrame([(i, f"Paper {i}\n\nAnn Lee\n\nWe saw 3.{i} things. They were good (Smith, 2020).\n\nReferences\n\n[1] X.") for i in range(20)], "doc_id long, text string")
    rows = [sentences(speech.apply_options(text_blocks(docs.repartition(n)))).orderBy("doc_id", "sentence_id").collect() for n in (1, 8)]
    assert rows[0] == rows[1]
    assert [(r.sentence_id, r.text, r.display) for r in rows[0] if r.doc_id == 3] == [(0, "Paper 3.", "Paper 3"), (1, "Ann Lee.", "Ann Lee"), (2, "We saw 3.3 things.", None), (3, "They were good.", None)]


def test_ranges_reach_the_last_page(spark, tmp_path):
    spark.range(3100).selectExpr("7L conv_id", "id turn", "'user' role", "'four' text").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [(r.doc_id, r.position, r.in_range) for r in registry.range_positions(spark, tmp_path).collect()] == [(7, 3, 3100)]
    assert {r.sentence_id: r.remaining_chars for r in registry.remaining_chars(spark, tmp_path).collect()} == {i: 4 * (3100 - i) for i in range(3100)}


def test_more_options_read_less(spark):
    kinds = spark.createDataFrame([(k,) for k in speech.LABELS], "kind string")
    count = lambda o: kinds.where(speech.default_included(F.col("kind"), o)).count()
    assert count(speech.Options(paper_mode=False)) == 15
    assert count(speech.Options(skip_tables=False)) == count(speech.Options()) + 2
