import random
import re
import unicodedata

import numpy as np
import pytest
from lodestrata.llm import leakage, lookalike, mail, markup, quality, repetition, sentences, stuffing, tokenizer, trees
from pyspark.sql import functions as F

PROSE = "The parser queue was slow in the morning, and nobody knew why. We looked at the log and found that it had been full since Monday. Then the team moved it to another disk. It has been quiet after that."


def frame(spark, texts, extra=True):
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, text string, form string, value string, score int")
    return df if extra else df.select("id", "text")


# encoding


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    bpe = tokenizer.load(f"{tokenizer.TOKENIZERS}/{tokenizer.VOCABULARY}")
    return tiktoken.Encoding("own", pat_str=tokenizer.PIECES, mergeable_ranks=bpe.ranks, special_tokens={})


def test_encoding_equals_the_public_encoder(spark, reference):
    random.seed(5)
    texts = ["".join(random.choices("aAbe 1é日\n\t\x1c😀's=<|>", k=random.randint(0, 120))) for _ in range(300)]
    texts += [None, "", " ", "a" * 3000, "=" * 700, "日本" * 400, "<|endoftext|>", PROSE, PROSE]
    got = {r.id: r.ids for r in tokenizer.encode(frame(spark, texts), "id", "text").collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokenizer.encode(frame(spark, texts).limit(0), "id", "text").count() == 0


def test_encoding_round_trip(reference):
    e = tokenizer.Encoder(f"{tokenizer.TOKENIZERS}/{tokenizer.VOCABULARY}")
    flat, counts = e.encode([PROSE, "naïve — 東京\r\n"])
    assert reference.decode(flat.tolist()) == PROSE + "naïve — 東京\r\n" and counts.sum() == len(flat)


# leakage


def test_index_finds_what_a_plain_search_finds():
    random.seed(1)
    for size in (1, 5, 80, 400):
        symbols = np.array([random.randint(1, 4) for _ in range(size)] + [0])
        index = leakage.FmIndex(symbols, 6)
        phrases = np.array([[random.randint(2, 5) for _ in range(3)] for _ in range(40)])
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi, strict=True):
            want = [i for i in range(len(symbols) - 2) if (symbols[i : i + 3] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_leaks_in_any_dress(spark):
    import base64
    import quopri

    passage = "Children of Mavo learn to count with dried acorns before they can spell Ruki, says the old map"
    html_ = f"<html><head><title>{passage}</title></head><body><p>Hi <b>all</b>,<br>{passage.replace('acorns', 'ac<i>or</i>ns')}</p></body></html>"
    mails = [
        f"Subject: a\n\nHello,\n> {passage[:36]}\n> {passage[36:].upper()}\n",
        "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(passage.encode()).decode(),
        "Content-Type: text/html\nContent-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring(html_.encode()).decode(),
        'Content-Type: multipart/mixed; boundary="b"\n\n--b\n\nhello\n--b\nContent-Type: text/plain; name="x.txt"\nContent-Disposition: attachment\n\n' + passage,
        f"Subject: {passage}\n\nno",
        "A: b\n\n" + passage.replace("acorns", "nuts").replace("count", "read"),
        "A: b\n\n" + " ".join(passage.split()[:11]),
        'Content-Type: multipart/mixed; boundary="b"\n\n--b\nContent-Type: application/pdf\n\n' + passage,
        None,
        "",
        "A: b\n\n" + "word " * 500 + passage,
    ]
    items = spark.createDataFrame([(7, passage, "q"), (7, passage, "q"), (8, None, "q"), (9, "too short", "q")], "item_id bigint, passage string, text string")
    for shard in (30, 1_000_000):
        got = leakage.leaks(frame(spark, mails), items, "id", "text", shard_words=shard).select("id", "item_id").distinct().collect()
        assert {r.id for r in got} == {0, 1, 2, 3, 10} and {r.item_id for r in got} == {7}
    assert leakage.leaks(frame(spark, mails), items.limit(0), "id", "text").count() == 0


# look-alikes


def test_pairs_that_look_the_same(spark):
    texts = ["Paper 10", "Ｐａｐｅｒ　１０", "Рареr 10", "Pa\u200bper\u00a010", "paper 10", "Páper 10", "Pa\u0301per 10", "Paper 1⁰", "Paper 10", None, " ", "\u200b", "ガ", "ｶﾞ", "カ\u3099", "金", "\uf90a"]
    got = {(r.id_a, r.id_b) for r in lookalike.pairs({"t": (frame(spark, texts), "id", "text")}).collect()}
    one, two = [0, 1, 2, 3, 8], [5, 6]
    want = {(a, b) for g in (one, two, [12, 13, 14], [15, 16]) for a in g for b in g if a < b and texts[a] != texts[b]}
    assert got == want
    forms = {r.id: r.form for r in lookalike.forms(frame(spark, texts), "id", "text").collect()}
    assert forms[9] is None and forms[1] == "Paper 10" and forms[6] == unicodedata.normalize("NFC", "Páper 10")


def test_look_alikes_with_accents_and_compatibility_forms(spark):
    groups = [
        ["ä", "а\u0308", "ӓ", "a\u0308"], ["ö", "о\u0308", "ӧ", "օ\u0308"], ["è", "ѐ", "е\u0300"], ["ă", "ӑ"], ["ĕ", "ӗ"], ["ó", "ό", "\u1f79"],
        ["ㄱㅏ", "ﾡￂ"], ["ab", "a\u3164b", "a\U000e0041b", "a\u115fb"], ["file", "ﬁle", "𝐟𝐢𝐥𝐞"], ["IV", "Ⅳ", "Ӏѵ".replace("ѵ", "Ѵ")], ["pai", "ραι"], ["v\u030f", "ѷ"],
        ["hn", "հո"], ["Y", "Ү"], ["a\u0313\u0301", "ἄ"], ["й"], ["и"], ["x²"], ["x2"], ["Paper"], ["paper"], ["I"], ["l"],
    ]
    texts = [t for g in groups for t in g]
    of = [k for k, g in enumerate(groups) for _ in g]
    got = {(r.id_a, r.id_b) for r in lookalike.pairs({"t": (frame(spark, texts), "id", "text")}).collect()}
    assert got == {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if of[a] == of[b]}


# sentences

SPLIT = [
    ("Dr. Ebb met Mr. Quist at 4 p.m. near gate 9. It rained.", ["Dr. Ebb met Mr. Quist at 4 p.m. near gate 9.", "It rained."]),
    ("J. R. Kas left. iOS took 2.5 s vs. 3 s.", ["J. R. Kas left.", "iOS took 2.5 s vs. 3 s."]),
    ('"Stop! Not here," he said. "Go." She went.', ['"Stop! Not here," he said.', '"Go."', "She went."]),
    ("Am 3. 7. kam z. B. Nr. 5, vgl. S. 6 ff. Dann Ruhe", ["Am 3. 7. kam z. B. Nr. 5, vgl. S. 6 ff.", "Dann Ruhe"]),
    ("one\ntwo\n\nthree", ["one\ntwo", "three"]),
    ("彼は「だめだ。」と言った。『やあ！』という声。「終わり。」次。", ["彼は「だめだ。」と言った。", "『やあ！』という声。", "「終わり。」", "次。"]),
    ("他说：“好。再见。”走了。", ["他说：“好。再见。”", "走了。"]),
    ("यह है। वह था।", ["यह है।", "वह था।"]),
    ("ที่นี่ดี ไม่มีใคร", ["ที่นี่ดี", "ไม่มีใคร"]),
    ("See https://a.example/x.Y?b=c.D now. Wait... what?! Yes", ["See https://a.example/x.Y?b=c.D now.", "Wait... what?!", "Yes"]),
]


def test_sentences(spark):
    texts = [t for t, _ in SPLIT] + [None, "", " \n ", SPLIT[0][0]]
    df = frame(spark, texts)
    got: dict[int, list] = {}
    for r in sentences.spans(df, ["id"], "text").collect():
        got.setdefault(r.id, []).append((r.start_pos, r.end_pos))
    for i, (text, want) in enumerate(SPLIT):
        assert [text[a:b] for a, b in sorted(got[i])] == want
    assert not {len(SPLIT), len(SPLIT) + 1, len(SPLIT) + 2} & got.keys()
    assert all(r.sentence == texts[r.id][r.start_pos : r.end_pos] for r in sentences.sentences(df, ["id"], "text").collect())


def test_brackets_of_any_length_and_unpaired_ones(spark):
    long, link = "Ab cd. " * 200, "https://a.example/" + "x.Y" * 200
    split = [
        (f"He said ({long}end) so. Then.", [f"He said ({long}end) so.", "Then."]),
        ("彼は「" + "だめだ。" * 300 + "うん」と言った。次。", ["彼は「" + "だめだ。" * 300 + "うん」と言った。", "次。"]),
        ("A (b. (c. D) E. F) g. Then.", ["A (b. (c. D) E. F) g.", "Then."]),
        ("One. Two. 3) Three. Nice :) Yes.", ["One.", "Two.", "3) Three.", "Nice :) Yes."]),
        ("One (two. Three. Four.", ["One (two.", "Three.", "Four."]),
        (f"See {link}.Z now. Yes.", [f"See {link}.Z now.", "Yes."]),
    ]
    got: dict[int, list] = {}
    for r in sentences.spans(frame(spark, [t for t, _ in split]), ["id"], "text").collect():
        got.setdefault(r.id, []).append((r.start_pos, r.end_pos))
    for i, (text, want) in enumerate(split):
        assert [text[a:b] for a, b in sorted(got[i])] == want


# repetition


def test_repeated_share_against_brute_force(spark):
    def brute(text):
        units, n, seen, covered = re.findall(r"[a-z]+|\.", text.lower()), 5, set(), set()
        for i in range(len(units) - n + 1):
            run = tuple(units[i : i + n])
            if "." in run:
                continue
            if run in seen:
                covered |= set(range(i, i + n))
            seen.add(run)
        letters = sum(len(u) for u in units if u != ".")
        return sum(len(units[i]) for i in covered) / letters if letters else 0.0

    random.seed(2)
    texts = [" ".join(random.choices(["alpha", "beta", "gamma", "delta."], k=random.randint(0, 60))) for _ in range(60)] + ["", None, "1 2 3", PROSE, "x " * 50]
    got = {r.id: r.repeated_share for r in repetition.measured(frame(spark, texts, False), "text").collect()}
    assert all(abs(got[i] - brute((t or "") + " ")) < 1e-9 for i, t in enumerate(texts))
    loops = ["最後に一覧画面が二つ目の写しを報告した。" * 4, "We lost the old file again. " * 6 + PROSE, PROSE]
    assert {r.row_id for r in repetition.repetitive(frame(spark, loops), "id", "text").collect()} == {0, 1}


def test_repeated_short_sentences_and_paragraphs(spark):
    other = "Nobody in the quiet house had read the long letter about copper and rain."
    texts = [
        "Wait here. " * 5 + "Come in.",
        f"{other}\n\n- Copy it\n- copy it!\n- 3 copy, it\n- Copy it.\n- Copy it.\n- Copy it.\n- copy it",
        "他走了。雨停了。门开着。\n\n" * 3 + "最后一行说的是别的事情。",
        "Old queue, new disk.\n\nOld. Queue. New. Disk.",
        f"{other} Wait here.",
        "The tool (cf. Fig. 3) copied one file. It (cf. Fig. 4) copied one line.",
        None,
        "... 1. 2.\n\n3.",
        "A tool (cf. Fig. 3) copied one file. A tool (cf. Fig. 4) copied one line.",
    ]
    rows = {r.id: r for r in repetition.measured(frame(spark, texts, False), "text").collect()}
    size = sum(map(str.isalpha, other))
    want = [32 / 46, 36 / (42 + size), 18 / 38, 0.5, 0, 0, 0, 0, 19 / 46]
    assert all(abs(rows[i].again_share - w) < 1e-9 for i, w in enumerate(want))
    assert {r.row_id for r in repetition.repetitive(frame(spark, texts), "id", "text").collect()} == {0, 1, 2, 3, 8}


def test_related_lines(spark):
    docs = spark.createDataFrame([(1, "Abc 1\nx\nabc, 1!\n--\nABC1"), (2, None)], "corpus_id bigint, text string")
    rows = [(1, 1, 1, [3, 5, 3]), (2, 1, 1, [2, 3]), (3, 1, 1, [1]), (4, 1, 4, [3]), (5, 1, 1, [99, -1, 0]), (6, 2, 1, [1, 2]), (7, 1, 1, None), (8, 9, 1, [2]), (9, 1, 1, [2, 3, 99])]
    f = spark.createDataFrame(rows + rows[:1], "finding_id bigint, corpus_id bigint, line int, related_lines array<int>")
    assert {r.row_id for r in repetition.same_lines(f, docs).collect()} == {1, 2}


# markup

MARKUP = [
    ("# Title\n\ntext", {"heading"}), ("Title\n=====\n\ntext", {"heading"}), ("== Wiki ==\ntext [[a|b]]", {"heading"}), ("<h2>x</h2>y", {"heading"}), (r"\section{x} y", {"heading"}),
    ("- a\n- b", {"list"}), ("1. a\n2. b", {"list"}), ("see [[x]]\n\n# one\n", {"list"}), ("<OL><LI>a<LI>b</OL>", {"list"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"list"}),
    ("```\na = 1\n```", {"code"}), ("<pre><code>x</code></pre>", {"code"}), ("\\begin{verbatim}\nx\n\\end{verbatim}", {"code"}),
    ("so $x_1$ is", {"formula"}), ("\\[ x \\]", {"formula"}), ("<math><mi>x</mi></math>", {"formula"}),
    ("a **b** c", set()), ("x&nbsp;y", set()), ("| a | b |\n|---|---|\n| c | d |", set()), (r"a\footnote{b} c", set()),
]
PLAIN = ["• a\n• b", "(1) a\n(2) b", "a) x", "if a < 5 and b > 4", "fixed #63", "It cost $5 on Monday and $7 on Friday", r"C:\temp\new", "<ann@b.example> wrote", "5 * 6 * 7", "x_1 = y_2 + 2^3", "[sic] a -> b", "{1, 2, {e}}", "", "  "]


@pytest.mark.parametrize(("text", "pieces"), MARKUP)
def test_marked(text, pieces):
    page = markup.read(text)
    assert page.marked and page.pieces == pieces


@pytest.mark.parametrize("text", [*PLAIN, None, "\x02\x03", "<" * 500, "[" * 500])
def test_not_marked(text):
    assert not markup.read(text).marked


def test_rendering(spark):
    page = markup.read("<html><head><title>t</title></head><body><h1>A</h1><p>one <b>two</b><!-- no --></p><ul><li>x<li>y</ul><table><tr><td>a<td>bbb<tr><td>cc<td>d</table></body></html>")
    assert page.render() == "A\n\none two\n\n- x\n- y\n\na   bbb\ncc  d"
    got = markup.found(frame(spark, ["# a\n\n- b", "plain", None, "a **b**"]), ["id"], "text").collect()
    assert {(r.id, r.piece) for r in got} == {(0, "heading"), (0, "list"), (3, "none")}


def test_nested_lists_and_visibility():
    html_ = "<p hidden>no</p><ol start=3><li>a<ul>\n<li>\n b\n c<li>d</ul><li>e</ol><div style='display: none'>no<div>no</div></div><p title='hidden'>f</p>"
    assert markup.read(html_).render() == "3. a\n  - b c\n  - d\n4. e\n\nf"
    assert markup.read("- a\n  - b\n    1. c\n    2. d\n- e\n\n7. f").render() == "- a\n  - b\n    1. c\n    2. d\n- e\n7. f"
    latex = "\\begin{enumerate}\n\\item a\n\\begin{itemize}\n\\item b\n\\end{itemize}\n\\item c\n\\end{enumerate}\nd"
    assert markup.read(latex).render() == "1. a\n  - b\n2. c\n\nd"
    assert markup.read(latex.replace("enumerate", "itemize")).render() == "- a\n  - b\n- c\n\nd"
    assert markup.read("* a\n** b\n*# c\n*# d\n* e").render() == "- a\n  - b\n  1. c\n  2. d\n- e"
    assert markup.read("<table><tr><td>a\n<p>b<td><i>c</b><tr><td>dd</table>e").render() == "a b  c\ndd\n\ne"
    assert markup.read("<pre>a\n\n&lt;b&gt;</pre>c").render() == "a\n\n<b>\n\nc"
    assert markup.read("<b>" * 20000 + "<div><li>" * 20000 + "x").render().endswith("x")


def test_code_stays_and_nothing_unclosed_hides_the_rest():
    code = 'List<p> x = a &lt; b; <!-- c\n<script>\n\\section{y} $x_1$ - no\n\n<b>z</b>'
    page = markup.read(f"a\n\n```java\n{code}\n```\nb **c**")
    assert page.render() == f"a\n\n{code}\n\nb c" and page.pieces == {"code"}
    assert markup.read(f"\\begin{{verbatim}}\n{code}\n```\n\\end{{verbatim}}\n# d").render() == f"{code}\n```\n\nd"
    assert markup.read("<syntaxhighlight lang=x>List<p> &lt;</syntaxhighlight>y").render() == "List<p> &lt;\n\ny"
    for opened in ("<script>var a;", "<style>p", "<head><title>t", "<!-- c", "<template>c", "<span hidden>c"):
        page = markup.read(f"a {opened}\n\n# B\n\n- d")
        assert page.render() == "a\n\nB\n\n- d" and page.pieces == {"heading", "list"}
        assert markup.read(f"a {opened}\n```\n<p>\n```").render() == "a\n\n<p>"
    assert markup.read("İİ <script>a <p> b</SCRIPT> c <!-- d --> e").render().split() == ["İİ", "c", "e"]
    front = "---\n" + "".join(f"key{i}: x\n" for i in range(60)) + "---\ntext"
    assert markup.read(front).marked and markup.read(front).render() == "text"


# quality


def test_rules_are_learned_and_exported():
    draw = np.random.default_rng(0)
    x = draw.random((600, 3))
    y = (x[:, 0] < 0.3) | ((x[:, 1] > 0.8) & (x[:, 2] > 0.5))
    rules = quality.learn(x[:400], y[:400])
    said = np.zeros(200, dtype=bool)
    for r in rules:
        said |= quality._holds(r, x[400:])
    assert (said == y[400:]).mean() > 0.9
    assert quality.rules_sql(rules, ["a", "b", "c"]).startswith("CASE WHEN ")


def test_prose_and_junk(spark):
    junk = ["\n".join(f"• item {i}: broken link" for i in range(12)), "a,b,c\n" + "1,2,3\n" * 20, "Map › Help › Top › Next › Login\n" * 6, "QWxhZGRpbjpvcGVuIHNlc2FtZQ" * 12]
    good = [PROSE, "まだ82個のファイルが照合の手順を指している。設定ファイルと辞書を比べると、空の行が目につく。", PROSE.replace(" ", "\u2009")]
    texts = (junk + good) * 8 + [None, "", " "]
    got = {r.id for r in quality.found(frame(spark, texts), "id", "text").collect()}
    assert got == {i for i in range(8 * 7) if i % 7 < 4}
    assert quality.found(frame(spark, texts).limit(0), "id", "text").count() == 0


# stuffing


def test_trees_on_held_out_rows(spark):
    draw = np.random.default_rng(1)
    x = draw.random((800, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 2] < 0.2)).astype(float)
    forest = trees.bagged(x[:500], y[:500])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[500:])], "i int, a double, b double, c double, d double")
    said = {r.i: r.p >= 0.5 for r in df.select("i", F.expr(trees.sql(forest, list("abcd"))).alias("p")).collect()}
    assert np.mean([said[i] == bool(y[500 + i]) for i in range(300)]) > 0.93


def test_stuffed_mails(spark):
    links = "\n".join(f"cheap lamps: https://s{i}.example/p/{i}" for i in range(15))
    head = "From: a@b.example\nSubject: x\n\n"
    bodies = ["Hello Ann,\n" + links, PROSE, PROSE + "\n\n" + "\n".join("> " + x for x in links.split("\n")), "usb cable | wall paint | " * 30, PROSE + " More at https://a.example/x.", "", "> only quoted"]
    rows = [(i * 10 + k, head + b, "a@b.example", 1.0) for i in range(10) for k, b in enumerate(bodies)] + [(900, None, None, 1.0), (901, " ", "nobody", 1.0)]
    df = spark.createDataFrame(rows, "id bigint, text string, sender string, page double")
    assert {r.id % 10 for r in stuffing.found(df, "id").collect()} == {0, 3}
    assert stuffing.found(df.limit(0), "id").count() == 0


def test_own_text():
    text = "From: a\n\nHi Ann,\n\nMine here.\n\nOn Mon, 1 Mar 2021, B wrote:\n> theirs\n\n-- \nA\nB"
    assert mail.own_text(text) == "Mine here."
    assert mail.own_text(None) == "" and mail.parts("Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain\n\nunfinished")[0].text == "unfinished"


# no case is lost by its size


def test_short_words_and_long_links_count(spark):
    again = repetition.measured(frame(spark, ["I go up to it. " * 10]), "text").first()
    assert again.repeated_share > 0.8 and again.again_share > 0.8
    for n in (10, 400, 5000):
        text = f"See https://a.example/{'x.y!z?' * n}q for it. Then go on."
        rows = sentences.spans(frame(spark, [text]).select("id", "text"), ["id"], "text").orderBy("start_pos").collect()
        assert [text[r.start_pos : r.end_pos] for r in rows] == [text[:-12], "Then go on."]


def test_sentences_of_a_very_long_text(spark):
    text = "".join(f"Line {k} is here. " for k in range(3000)) + "日本です。"
    rows = sentences.sentences(frame(spark, [text, None, " "]).select("id", "text"), ["id"], "text").orderBy("start_pos").collect()
    assert len(rows) == 3001 and all(text[r.start_pos : r.end_pos] == r.sentence for r in rows)
    assert rows[2999].sentence == "Line 2999 is here." and rows[3000].sentence == "日本です。"


def test_parts_at_any_depth():
    text = "the text"
    for k in range(40):
        text = f'Content-Type: multipart/mixed; boundary="b{k}"\n\n--b{k}\n{text if k else "Content-Type: text/plain" + chr(10) * 2 + text}\n--b{k}--\n'
    text = "Content-Type: message/rfc822\n\n" + text
    assert [p.text for p in mail.parts(text)] == ["the text"]


def test_long_headings_labels_and_references():
    assert "heading" in markup.read("x" * 500 + "\n====\n\ntext").pieces
    assert markup.read(f"[a][{'r' * 100}] is a link").render() == "a is a link"
    assert "123456. x" in markup.read("123456. x").render()
    assert markup.read("a &CounterClockwiseContourIntegral; b").marked


def test_large_classes_are_split(spark):
    texts = ["Paper 10"] * 7 + ["Ｐａｐｅｒ　１０"] * 5 + ["Рареr 10"] * 3 + ["other"] * 4
    tables = {"t": (frame(spark, texts), "id", "text")}
    want = {(a, b) for a in range(19) for b in range(a + 1, 19) if texts[a] != texts[b] and "other" not in (texts[a], texts[b])}
    for rows in (2, 50_000):
        assert {(r.id_a, r.id_b) for r in lookalike.pairs(tables, rows).collect()} == want
    got = lookalike.classes(tables).collect()
    assert {(r.id, r.n) for r in got} == {(k, texts.count(texts[k])) for k in range(15)} and len({r.form for r in got}) == 1 and len({r.body for r in got}) == 3


def test_blocks_of_phrases_and_spans_over_cuts(spark):
    passages = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(5)]
    items = spark.createDataFrame([(k, p) for k, p in enumerate(passages)], "item_id bigint, passage string")
    text = "A: b\n\n" + "start " * 20 + passages[3] + " stop " * 5 + passages[1]
    for shard, block in ((15, 10), (1_000_000, 300), (1_000_000, 8_000_000)):
        got = {tuple(r) for r in leakage.leaks(frame(spark, [text]), items, "id", "text", shard_words=shard, block_chars=block).collect()}
        assert got == {(0, 3, 20, 60), (0, 1, 65, 105)}


def test_fits_do_not_depend_on_the_order_of_rows(spark):
    texts = [PROSE + f" No. {k}." for k in range(40)] + [f"- item {k}\n- more\n- {k}" for k in range(40)]
    one, two = frame(spark, texts), frame(spark, texts).orderBy(F.desc("id")).repartition(5)
    assert quality.rule_list(one, "text") == quality.rule_list(two, "text")
    labelled = one.withColumn("junk", F.col("id") >= 40)
    assert {r.id for r in quality.found(labelled, "id", "text", label_column="junk").collect()} == set(range(40, 80))


def test_against_sql(spark):
    import os

    import duckdb
    from lodestrata.llm import queries, sql

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{data}/{f}')")
    for name, text in sql.oracle_sql().items():
        got, want = queries.queries()[name](spark, data).toPandas(), con.execute(text).df()
        assert sorted(map(tuple, got[sorted(got.columns)].to_numpy().tolist())) == sorted(map(tuple, want[sorted(want.columns)].to_numpy().tolist())) and len(want)
