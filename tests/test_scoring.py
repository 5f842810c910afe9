import duckdb
import pytest

from sparkrecall.operators.scoring import contains_any, evaluate_predictions, lcs_length, rouge_l
from sparkrecall.plans.oracles import ORACLES

# Worked out by hand: prediction, golds, em, f1, bleu, contains, rouge_l.
# BLEU: product of the four precisions (a missing one 0.1 / its denominator) to the 1/4, times the brevity penalty.
CASES = [
    ("Paris", ["Paris", "paris, France"], 1.0, 1.0, 0.1 ** 0.75, True, 1.0),
    ("", ["something"], 0.0, 0.0, 0.0, False, 0.0),
    ("", [], 0.0, 0.0, 0.0, False, 0.0),
    ("The", ["the"], 1.0, 0.0, 0.0, False, 1.0),
    ("an apple", ["The"], 0.0, 0.0, 0.0, False, 0.0),
    ("the the the cat cat", ["cat cat dog", "a cat"], 0.0, 0.8, 0.1 ** 0.5, True, 0.5),
    ("Évian-les-Bains est là", ["évian les bains", "Bains"], 0.0, 0.75, 0.005 ** 0.25, True, 0.75),
    ("one", ["one two three"], 0.0, 0.5, 0.1 ** 0.75 * 2.718281828459045 ** -2, False, 0.5),
    ("one two", ["one two"], 1.0, 1.0, 0.1 ** 0.5, True, 1.0),
    ("one two three", ["one two three four five", "one two"], 0.0, 0.8, 0.1 ** 0.25, True, 0.8),
    ("[LLM_ERROR] model failed to load", ["Paris"], 0.0, 0.0, 0.0, False, 0.0),
    ("punctuation!!! only...", ["punctuation only"], 1.0, 1.0, 0.1 ** 0.5, True, 1.0),
    ("x y z w v", ["", "  ", "x y"], 0.0, 4 / 7, (0.4 * 0.25 * 0.1 / 3 * 0.05) ** 0.25, True, 4 / 7),
]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)],
                               "id long, prediction string, golds array<string>")
    return {r["id"]: r for r in evaluate_predictions(df, "id").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_metrics(scored, i):
    r = scored[i]
    assert (r["em"], r["answer_contains_gold"]) == (CASES[i][2], CASES[i][5])
    assert [r["f1"], r["bleu"], r["rouge_l"]] == pytest.approx([CASES[i][3], CASES[i][4], CASES[i][6]], abs=1e-12)


def test_rouge_with_a_stemmer(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("walked dogs", ["walks dog"])], "p string, g array<string>")
    got = df.select(rouge_l("p", "g").alias("plain"), rouge_l("p", "g", lambda t: F.regexp_replace(t, "(ed|s)$", "")).alias("stemmed")).first()
    assert (got.plain, got.stemmed) == (0.0, 1.0)


def test_em_implies_f1_and_symmetry(spark):
    rows = [(0, "the cat sat", ["cat sat"]), (1, "cat sat", ["the cat sat"])]
    df = spark.createDataFrame(rows, "id long, prediction string, golds array<string>")
    out = {r["id"]: r for r in evaluate_predictions(df, "id", with_rouge=False).collect()}
    assert out[0]["em"] == 1.0 and out[0]["f1"] == 1.0
    assert out[0]["f1"] == out[1]["f1"]


def test_lcs_bitparallel_equals_table():
    import random
    rnd = random.Random(7)
    for _ in range(300):
        a = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        b = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        best = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                best[i, j] = 0 if 0 in (i, j) else best[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(best[i - 1, j], best[i, j - 1])
        assert lcs_length(a, b) == best[len(a), len(b)]


@pytest.mark.parametrize("name", ["answer_scores", "rouge_l_scores", "doc_exact_match", "doc_contains_benchmark"])
def test_against_sql(spark, name):
    from sparkrecall.plans.queries import REGISTRY
    sf = "/root/testdata/sf0.001"
    for t in ("conversations", "documents", "benchmark"):
        duckdb.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = REGISTRY[name](spark, sf).toPandas()
    want = duckdb.sql(ORACLES[name]).df()[list(got.columns)]
    key = [c for c in ("conv_id", "turn", "doc_id") if c in got]
    got, want = got.sort_values(key).to_numpy().tolist(), want.sort_values(key).to_numpy().tolist()
    assert len(got) == len(want) > 0 and all(x == pytest.approx(y, abs=2e-6) for x, y in zip(got, want, strict=True))


def test_contains_any(spark):
    texts = ["The quick brown fox jumps", "nothing here", "Über café, naïve!", "", None, "an apple a day", "scarfaced", "x yz w",
             "day after day", "q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for golds, hits in ((["brown fox", "CAFE", "café naïve", "The", "apple day", "zzz"], {0, 2, 5}), (["fac"], {6}), (["y", "q r"], {5, 7, 8}),
                        (["row fo"], set()), (["ck brown fo"], {0}), (["y aft"], {8}), (["q"], {0, 9}), ([], set()), (["", None], set()),
                        (["x yz w", "ay"], {5, 7, 8})):
        g = spark.createDataFrame([(x,) for x in golds], "g string")
        rows = contains_any(docs, "id", "text", g, "g").collect()
        assert len(rows) == len(texts) and {r["id"] for r in rows if r["answer_contains_gold"]} == hits, golds


def test_exact_match_of_null_groups(spark):
    from sparkrecall.operators.scoring import exact_match_in_group
    rows = [(1, None, "Same text"), (2, None, "same, text!"), (3, 5, "same text"), (4, None, None), (5, None, "")]
    df = spark.createDataFrame(rows, "id long, grp long, t string")
    got = {r["id"]: r["em"] for r in exact_match_in_group(df, "id", "grp", "t").collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 0.0, 4: 1.0, 5: 1.0}
