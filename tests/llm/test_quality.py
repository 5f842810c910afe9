import random
import re

import duckdb
from fixtures import awkward, frame, prose

from sparkrecall.llm import oracles, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF0001 = "/root/testdata/sf0.001"


def metrics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)


def test_metrics_against_brute_force(spark):
    pairs = awkward()
    rnd = random.Random(6)
    pairs += [(30_000 + i, " ".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 80))) + "\n| # x\n| # x") for i in range(20)]
    got = sorted((tuple(r)[:7] for r in quality.verdicts(frame(spark, pairs)).collect()), key=str)
    assert got == sorted(((i, *metrics(t)) for i, t in pairs), key=str)


def test_line_rules():
    good = ["A plain sentence with several words in it.", "Is this one fine as well?", "« Une phrase. »",
            "a long line that has no mark at its end but goes on", "Cost was 5% & rose."]
    bad = ["Home | News | About | Contact", "thing### other$$$ more%%% again***", "BUY!! NOW!! CHEAP!! STUFF!!",
           "THIS WHOLE LINE IS IN CAPITALS ALL THE WAY.", "Read more", "We use a cookie to make this page better for you."]
    assert not [x for x in good if quality.line_fails(x.encode(), len(x.split()))]
    assert not [x for x in bad if not quality.line_fails(x.encode(), len(x.split()))]


CLEAN = ["The new design in Berlin won a prize.", "She keeps a blog in French and another one in her own language.",
         "The dialog in the second act is the best part of the whole play.", "JavaScript is a language that most browsers can run.",
         "Cream the butter, then press each cookie flat with a fork.", "We use a cookie cutter to shape the dough before it goes in.",
         "In 1998 the company changed its privacy policy and lost many readers.", "JavaScript is fun.", "He did not read more that day.",
         "Sign in hand, the old man walked through the rain to the square.", "They put a log in the fire and went to sleep.",
         "Read more books this year, she told herself every January.", "Designers set lorem ipsum where the text is still missing.",
         "Many readers subscribe for the crossword and stay for the essays.", "Share this bread with the people at your table.",
         "The function sets a cookie and returns the page to the browser", "Users who log in from two places are asked for a code."]
NOTICES = ["Please sign in.", "Log in to leave a comment on this article!", "Click here to download the file.", "Read more about our products.",
           "Please enable JavaScript to view the comments on this page.", "You need to enable JavaScript to run this app.",
           "This website uses cookies to ensure you get the best experience.", "Subscribe to our newsletter for the latest news and offers.",
           "By continuing to browse you agree to our use of cookies.", "I have read and I accept the privacy policy of the shop.",
           "Share this article with your friends.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
           "We and our partners use cookies to personalise content and ads.", "JavaScript is disabled in your browser, so the map is not shown."]


def test_words_of_notices_in_prose(spark):
    assert not [x for x in CLEAN if quality.line_fails(x.encode(), len(x.split()))]
    assert not [x for x in NOTICES if not quality.line_fails(x.encode(), len(x.split()))]
    text = "\n".join(CLEAN)
    docs = frame(spark, [(1, text), (2, text + "\n" + "\n".join(NOTICES[:3]))])
    assert {r.doc_id: r.text for r in quality.clean(docs).collect()} == {1: text, 2: text}


KEEP = """Chapter One

What happened next

The rain had stopped by the time they reached the old mill.
- two cups of flour
- one cup of sugar
- three eggs
1. Mix the flour
2. Add eggs
3. Bake
Rough winds do shake the darling buds of May
And summer's lease hath all too short a date
Sometime too hot the eye of heaven shines
O Rose thou art sick
def f(x):
    y = x + 1
    return y
x = f(2)
print(x)
Zusammenfassung
Am Ende war alles gut, sagte sie.
été
en ville
au bord de l'eau"""
MENUS = ["Home\nAbout us\nContact\nJobs & Careers", "Home\n\nAbout us\n \t\nContact", "首页\n新闻\n关于"]


def test_short_lines_by_context(spark):
    body = "\n".join(f"{w} sentence number {i} of the text that stands here is long enough for it." for i, w in enumerate(CLEAN))
    keep = body + "\n" + KEEP
    pairs = [(0, keep)] + [(i + 1, f"{keep}\nA last line of prose stands here.\n{m}\n{body[:90]}") for i, m in enumerate(MENUS)]
    pairs.append((9, "\n".join(f"Reply\n{x}" for x in body.split("\n"))))
    out = {r.doc_id: r.text for r in quality.clean(frame(spark, pairs)).collect()}
    assert out[0] == keep
    for i, m in enumerate(MENUS):
        blank = "".join(f"{x}\n" for x in m.split("\n") if not x.strip())
        assert out[i + 1] == f"{keep}\nA last line of prose stands here.\n{blank}{body[:90]}"
    assert out[9] == body


def test_oracle_on_notices_and_menus(spark):
    body = prose(random.Random(3), 90)
    texts = [x for y in (CLEAN, NOTICES, MENUS, KEEP.split("\n"), [KEEP, "A\nB\nC", "A\nB\nc\nD", "A\nx y z.\nA\nA b\n\nA"]) for x in y]
    texts += [f"  {x.upper()}" for x in NOTICES] + [f"» {x}" for x in NOTICES] + [f"中文 {x}" for x in NOTICES + CLEAN] + [f"{x}\r" for x in NOTICES]
    docs = frame(spark, [(2 * i + j, f"{t}\n{body}" if j else t) for i, t in enumerate(texts) for j in (0, 1)])
    got = {tuple(r) for r in quality.verdicts(docs).collect()}
    rel = docs.select("doc_id", "text").toArrow()
    con = duckdb.connect()
    con.register("documents", rel)
    order = "doc_id, " + ", ".join(x.split()[0] for x in f"{quality.METRICS}, {quality.VERDICT}".split(", "))
    assert got == set(con.sql(oracles.ORACLES["op9_quality_rules"]).select(order).fetchall())
    assert sum(r[8] > 0 for r in got) > 50


def test_clean(spark):
    rnd = random.Random(7)
    fine = prose(rnd, 120)
    junk = "\n".join(f"a{k} | b{k} | c{k} | d{k}" for k in range(40))
    pairs = [(1, fine), (2, fine + "\nHome | News | About"), (3, fine + "\n" + junk), (4, "too few words."), (5, None), (6, "")]
    docs = frame(spark, pairs)
    out = quality.clean(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (fine, len(fine)), 2: (fine, len(fine))}
    verdicts = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert [verdicts[i].kept for i in range(1, 7)] == [True, True, False, False, False, False] and not verdicts[3].base_failed


def test_clean_documents_stay(spark):
    rows = {r.doc_id: r for r in queries.op9_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    good = [rows[x.doc_id] for x in labels if x.quality == 1]
    poor = [rows[x.doc_id] for x in labels if x.quality == 0]
    assert all(r.kept for r in good if not r.base_failed)
    assert sum(r.kept for r in poor) < 0.7 * len(poor)


def test_empty(spark):
    docs = frame(spark, awkward()).limit(0)
    assert quality.verdicts(docs).count() == 0 and quality.clean(docs).count() == 0


def test_oracle(spark):
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_bad_lines n_lost_words".split()
    got = {tuple(r) for r in queries.op9_quality_rules(spark, SF0001).select(*columns).collect()}
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{SF0001}/documents.parquet'")
    assert got == set(duckdb.sql(oracles.ORACLES["op9_quality_rules"]).select(", ".join(columns)).fetchall())
