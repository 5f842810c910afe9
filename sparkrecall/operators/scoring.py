"""Answer scoring against gold aliases: exact match, token F1, sentence BLEU
(uniform 4-gram weights, smoothing method 1), contains-gold and ROUGE-L.

EM and contains-gold are in-row higher-order functions (the alias list of one
row is small). Token F1 and BLEU compare token/n-gram multisets; they are
written as explode -> groupBy -> join so their cost stays linear in text length
(an in-row nested ``filter`` would be quadratic on long answers). ROUGE-L needs
a longest common subsequence; it runs as an Arrow-batched pandas UDF with a
bit-parallel LCS (one Python big-integer operation per token).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_answer, normalized_tokens
from ..session import cut_lineage
from .ordering import text_digest

# BLEU maximum n-gram order (uniform weights 1/4) and the
# smoothing-method-1 epsilon added to zero n-gram matches.
BLEU_MAX_N = 4
BLEU_EPSILON = 0.1


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# In-row metrics
# ---------------------------------------------------------------------------
def exact_match(pred, golds) -> Column:
    """1.0 if any alias normalises to the normalised prediction (two empties match)."""
    pn = normalize_answer(pred)
    return F.when(F.exists(_c(golds), lambda g: normalize_answer(g) == pn), F.lit(1.0)).otherwise(F.lit(0.0))


def contains_gold(pred, golds) -> Column:
    """Any non-empty normalised alias is a substring of the normalised prediction."""
    pn = normalize_answer(pred)
    return F.coalesce(F.exists(_c(golds), lambda g: (normalize_answer(g) != F.lit("")) &
                               pn.contains(normalize_answer(g))), F.lit(False))


# ---------------------------------------------------------------------------
# Multiset metrics (explode / aggregate / join)
# ---------------------------------------------------------------------------
def _tokenised(df: DataFrame, rid: str, pred: str, golds: str) -> DataFrame:
    """(rid, pt, gts): normalised prediction tokens and per-alias token arrays."""
    return df.select(rid, normalized_tokens(pred).alias("pt"),
                     F.transform(F.coalesce(F.col(golds), F.array().cast("array<string>")),
                                 lambda g: normalized_tokens(g)).alias("gts"))


def _by_row(df: DataFrame, rid: str, partitioned: bool) -> DataFrame:
    """Hash-partition by ``rid`` once: every later aggregation keyed by
    (rid, ...) and every join on rid alone is then partition-local."""
    if partitioned:
        return df
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rid)


def _tag(tokens: Column, ai) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.lit(ai).cast("int").alias("ai"), t.alias("tok")))


def token_f1(df: DataFrame, rid: str, pred: str, golds: str, empty_without_gold_is_one: bool = False,
             partitioned: bool = False, tokenised: DataFrame | None = None) -> DataFrame:
    """(rid, f1): best token-F1 over aliases; empty prediction -> 0; empty
    aliases skipped; no usable alias -> 0. ``empty_without_gold_is_one``: the
    smoke-runner variant where an empty prediction with no aliases scores 1.

    Multiset overlap per alias = sum over tokens of min(pred count, alias
    count): one explode of tagged tokens and aggregations keyed by rid, all
    partition-local after a single repartition by rid."""
    t = tokenised if tokenised is not None else _tokenised(_by_row(df, rid, partitioned), rid, pred, golds)
    tagged = F.concat(_tag(F.col("pt"), -1),
                      F.flatten(F.transform("gts", lambda g, i: F.transform(
                          g, lambda x: F.struct(i.cast("int").alias("ai"), x.alias("tok"))))))
    c = (t.select(rid, F.explode(tagged).alias("x"))
         .groupBy(rid, F.col("x.tok").alias("tok"), F.col("x.ai").alias("ai")).agg(F.count(F.lit(1)).alias("c")))
    per_tok = c.groupBy(rid, "tok").agg(
        F.sum(F.when(F.col("ai") < 0, F.col("c"))).alias("cp"),
        F.collect_list(F.when(F.col("ai") >= 0, F.struct("ai", "c"))).alias("gl"))
    same = (per_tok.filter(F.col("cp").isNotNull()).select(rid, "cp", F.explode("gl").alias("g"))
            .groupBy(rid, F.col("g.ai").alias("ai")).agg(F.sum(F.least("cp", F.col("g.c"))).alias("same"))
            .groupBy(rid).agg(F.collect_list(F.struct("ai", "same")).alias("sl")))
    j = t.join(same, rid, "left")
    np_ = F.size("pt")

    def alias_f1(g, i):
        ng = F.size(g)
        sm = F.aggregate(F.coalesce(F.col("sl"), F.array().cast("array<struct<ai:int,same:bigint>>")),
                         F.lit(0).cast("bigint"), lambda acc, x: F.when(x["ai"] == i, x["same"]).otherwise(acc))
        prec, rec = sm / np_, sm / ng
        return F.when(ng == 0, F.lit(None).cast("double")).when(sm > 0, 2 * prec * rec / (prec + rec)) \
            .otherwise(F.lit(0.0))

    best = F.array_max(F.filter(F.transform("gts", alias_f1), lambda x: x.isNotNull()))
    empty = F.lit(0.0)
    if empty_without_gold_is_one:
        empty = F.when(F.size("gts") <= 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return j.select(rid, F.when(np_ == 0, empty).otherwise(F.coalesce(best, F.lit(0.0))).alias("f1"))


def _ngrams(tokens: Column, n: int, ai) -> Column:
    size = F.size(tokens)
    grams = F.transform(F.sequence(F.lit(1), size - n + 1),
                        lambda i: F.struct(ai.cast("int").alias("ai"), F.lit(n).alias("n"),
                                           F.array_join(F.slice(tokens, i, n), " ").alias("gram")))
    return F.when(size >= n, grams).otherwise(F.array().cast("array<struct<ai:int,n:int,gram:string>>"))


def _all_ngrams(tokens: Column, ai) -> Column:
    return F.concat(*[_ngrams(tokens, n, ai) for n in range(1, BLEU_MAX_N + 1)])


def bleu(df: DataFrame, rid: str, pred: str, golds: str, partitioned: bool = False,
         tokenised: DataFrame | None = None) -> DataFrame:
    """(rid, bleu): multi-reference sentence BLEU, clipped n-gram precision,
    brevity penalty against the closest reference length (shorter on ties).
    Empty prediction or no non-empty reference -> 0; no unigram match -> 0.
    Same layout as ``token_f1``: aggregations keyed by rid after one repartition."""
    t = tokenised if tokenised is not None else _tokenised(_by_row(df, rid, partitioned), rid, pred, golds)
    grams = F.concat(_all_ngrams(F.col("pt"), F.lit(-1)),
                     F.flatten(F.transform("gts", lambda g, i: _all_ngrams(g, i))))
    c = (t.select(rid, F.explode(grams).alias("x"))
         .groupBy(rid, F.col("x.n").alias("n"), F.col("x.gram").alias("gram"), F.col("x.ai").alias("ai"))
         .agg(F.count(F.lit(1)).alias("c")))
    g2 = c.groupBy(rid, "n", "gram").agg(F.sum(F.when(F.col("ai") < 0, F.col("c"))).alias("ch"),
                                         F.max(F.when(F.col("ai") >= 0, F.col("c"))).alias("mr"))
    clipped = (g2.filter(F.col("ch").isNotNull())
               .groupBy(rid).agg(*[F.sum(F.when(F.col("n") == n, F.least("ch", F.coalesce("mr", F.lit(0))))
                                         .otherwise(0)).alias(f"m{n}") for n in range(1, BLEU_MAX_N + 1)]))
    j = t.join(clipped, rid, "left")
    c_len = F.size("pt").cast("double")
    ref_lens = F.filter(F.transform("gts", lambda g: F.size(g)), lambda x: x > 0)
    closest = F.array_min(F.transform(ref_lens, lambda x: F.struct(F.abs(x - F.size("pt")).alias("d"),
                                                                    x.alias("rl"))))["rl"]
    logs = []
    for n in range(1, BLEU_MAX_N + 1):
        den = F.greatest(F.lit(1.0), c_len - (n - 1))
        m = F.coalesce(F.col(f"m{n}"), F.lit(0)).cast("double")
        logs.append(F.log(F.when(m > 0, m / den).otherwise(F.lit(BLEU_EPSILON) / den)))
    bp = F.when(c_len > closest, F.lit(1.0)).otherwise(F.exp(1 - closest / c_len))
    score = bp * F.exp(sum(logs) / BLEU_MAX_N)
    valid = (F.size("pt") > 0) & (F.size(ref_lens) > 0) & (F.coalesce(F.col("m1"), F.lit(0)) > 0)
    return j.select(rid, F.when(valid, score).otherwise(F.lit(0.0)).alias("bleu"))


# ---------------------------------------------------------------------------
# ROUGE-L: tokens by column functions, the LCS in an Arrow batch
# ---------------------------------------------------------------------------
def rouge_tokens(text) -> Column:
    """Lower-case, non [a-z0-9] runs -> space, split."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]+", " "), " "),
                    lambda t: t != F.lit(""))


def lcs_length(a: list[str], b: list[str]) -> int:
    """Bit-parallel LCS length (Allison-Dix / Hyyro): O(len(b)) big-int ops."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


@F.pandas_udf(T.DoubleType())
def _rouge_l(preds: pd.Series, golds: pd.Series) -> pd.Series:
    out = []
    for p, gs in zip(preds, golds):
        best = 0.0
        for g in gs if gs is not None else []:
            lcs = lcs_length(list(g), list(p)) if len(p) and len(g) else 0
            if lcs:
                prec, rec = lcs / len(p), lcs / len(g)
                best = max(best, 2 * prec * rec / (prec + rec))
        out.append(best)
    return pd.Series(out, dtype="float64")


def rouge_l(pred, golds, stem: Callable[[Column], Column] | None = None) -> Column:
    """Best ROUGE-L F-measure over aliases (0.0 without aliases). ``stem``: an
    optional column function of a token, the user's stemmer (default: none)."""
    def tokens(x):
        return rouge_tokens(x) if stem is None else F.transform(rouge_tokens(x), stem)
    return _rouge_l(tokens(pred), F.transform(_c(golds), tokens))


# ---------------------------------------------------------------------------
# All metrics for a prediction table
# ---------------------------------------------------------------------------
def evaluate_predictions(df: DataFrame, rid: str, pred: str = "prediction", golds: str = "golds",
                         with_rouge: bool = True, smoke_f1: bool = False) -> DataFrame:
    """Input rows (rid, pred, golds array<string>) -> rid, em, f1, bleu,
    answer_contains_gold [, rouge_l]; ``rid`` must be unique."""
    # one shuffle: by row id; everything after it is partition-local
    base = _by_row(df.select(rid, pred, golds), rid, False)
    tok = _tokenised(base, rid, pred, golds)
    inrow = [exact_match(pred, golds).alias("em"), contains_gold(pred, golds).alias("answer_contains_gold")]
    if with_rouge:
        inrow.append(rouge_l(pred, golds).alias("rouge_l"))
    out = base.select(rid, *inrow)
    return (out.join(token_f1(base, rid, pred, golds, smoke_f1, partitioned=True, tokenised=tok), rid)
            .join(bleu(base, rid, pred, golds, partitioned=True, tokenised=tok), rid))


def capture_errors(preds: DataFrame, answer_col: str = "generated_answer", limit: int | None = None,
                   metrics: tuple[str, ...] = ("em", "f1", "rouge_l", "bleu", "answer_contains_gold")) -> DataFrame:
    """Row-level error policy: rows whose answer is a generation error keep an
    ``error`` message (cut to ``limit`` characters) and null metrics, so they
    drop out of valid-row summaries (``em IS NOT NULL``)."""
    from .generate import is_error
    err = is_error(answer_col)
    msg = F.col(answer_col) if limit is None else F.substring(answer_col, 1, limit)
    out = preds.withColumn("error", F.when(err, msg))
    for m in metrics:
        if m in out.columns:
            out = out.withColumn(m, F.when(~err, F.col(m)))
    return out


# ---------------------------------------------------------------------------
# Table-scale variants
# ---------------------------------------------------------------------------
def exact_match_in_group(df: DataFrame, rid: str, group: str, text: str) -> DataFrame:
    """(rid, em): 1.0 when another row of the same ``group`` (null is a group)
    normalises to the same text (EM of each row against the others as gold
    aliases). Counts per (group, digest of the normalised text) via a partial
    aggregate, joined back -- no pairs, and no texts in the shuffle."""
    norm = df.select(F.col(rid), F.col(group).alias("_g"), normalize_answer(text).alias("_n"))
    h1, h2 = text_digest("_n")
    n = norm.select(rid, "_g", h1.alias("_h1"), h2.alias("_h2"))
    # written, so that the join's sides are plain shuffles and Spark can split a hot text
    cnt = cut_lineage(n.groupBy("_g", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_k")).toDF("_cg", "_c1", "_c2", "_k"))
    same = n["_g"].eqNullSafe(cnt["_cg"]) & (n["_h1"] == cnt["_c1"]) & (n["_h2"] == cnt["_c2"])
    return n.join(cnt, same).select(rid, F.when(F.col("_k") > 1, 1.0).otherwise(0.0).alias("em"))


def _anchors(text: Column, kinds: set[str]) -> Column:
    """The anchors a normalised text offers: its tokens (t), the pairs of characters
    on both sides of its spaces (b), and its character runs of length 1 to 3 (1, 2, 3)."""
    toks = F.split(text, " ")
    none = F.array().cast("array<string>")
    parts = []
    if "t" in kinds:
        parts.append(F.transform(toks, lambda t: F.concat(F.lit("t"), t)))
    if "b" in kinds:
        around = F.transform(F.sequence(F.lit(1), F.size(toks) - 1), lambda i: F.concat(
            F.lit("b"), F.right(F.get(toks, i - 1), F.lit(1)), F.substring(F.get(toks, i), F.lit(1), F.lit(1))))
        parts.append(F.when(F.size(toks) > 1, around).otherwise(none))
    for k in sorted(kinds - {"t", "b"}):
        runs = F.transform(F.sequence(F.lit(1), F.char_length(text)),
                           lambda i: F.concat(F.lit(k), F.substring(text, i, F.lit(int(k)))))  # noqa: B023
        parts.append(F.when(F.char_length(text) > 0, runs).otherwise(none))
    return F.array_distinct(F.concat(*parts))


def _gold_anchors(gold: Column) -> Column:
    """The anchors that every text containing the gold offers: the tokens strictly
    inside it, else the characters around its space, else its runs of three characters
    (of all its characters, where it has fewer)."""
    toks = F.split(gold, " ")
    inner = F.transform(F.slice(toks, 2, F.greatest(F.lit(0), F.size(toks) - 2)), lambda t: F.concat(F.lit("t"), t))
    around = F.concat(F.lit("b"), F.right(F.get(toks, F.lit(0)), F.lit(1)), F.substring(F.get(toks, F.lit(1)), F.lit(1), F.lit(1)))
    n = F.least(F.lit(3), F.char_length(gold))
    runs = F.transform(F.sequence(F.lit(1), F.char_length(gold) - n + 1), lambda i: F.concat(n.cast("string"), F.substring(gold, i, n)))
    return F.array_distinct(F.when(F.size(toks) > 2, inner).when(F.size(toks) == 2, F.array(around)).otherwise(runs))


def contains_any(df: DataFrame, rid: str, text: str, golds: DataFrame, gold_text: str) -> DataFrame:
    """(rid, answer_contains_gold) against one shared gold table: true when any
    non-empty normalised gold is a substring of the normalised text.

    Filter and verify: a containing text must offer every anchor of a gold. Only
    anchors that some gold has are kept of the texts, and each gold is looked up by
    its rarest one, by the number of texts that offer it; a gold with an anchor that
    no text offers is in none. An equi-join on anchors gives candidates (row, gold),
    whose texts are then compared. Anchor rows are ids and short strings; texts meet
    their candidates only. Spark broadcasts or shuffles by the sizes it sees."""
    t = cut_lineage(df.select(F.col(rid), normalize_answer(text).alias("_t")).withColumn("_row", F.monotonically_increasing_id()))
    g = golds.select(normalize_answer(gold_text).alias("_g")).filter(F.col("_g") != "").distinct()
    g = cut_lineage(g.select(F.xxhash64("_g").alias("_h"), "_g", F.explode(_gold_anchors(F.col("_g"))).alias("_a")))
    kinds = {r[0] for r in g.select(F.substring("_a", 1, 1)).distinct().collect()}  # at most five
    if not kinds:
        return t.select(rid, F.lit(False).alias("answer_contains_gold"))
    keys = cut_lineage(g.select("_a").distinct())
    offered = cut_lineage(t.select("_row", F.explode(_anchors(F.col("_t"), kinds)).alias("_a")).join(keys, "_a", "left_semi"))
    df_a = offered.groupBy("_a").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (g.join(df_a, "_a", "left").groupBy("_h", "_g").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_a")).alias("_m"))
              .where("_m.n > 0").select("_g", F.col("_m._a").alias("_a")))
    cand = offered.join(cut_lineage(rarest), "_a").select("_row", "_g")
    hits = t.join(cand, "_row").where(F.col("_t").contains(F.col("_g"))).select("_row").distinct()
    return (t.select(rid, "_row").join(hits.withColumn("_hit", F.lit(True)), "_row", "left")
            .select(rid, F.coalesce("_hit", F.lit(False)).alias("answer_contains_gold")))
