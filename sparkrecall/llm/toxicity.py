"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons, patterns of attack, and lexicons mined from
labelled rows (whole words and word beginnings that are found in toxic rows far more
often than chance). Whoever fires sets a bit. Vote patterns of all documents, counted
on the executors, feed a generative label model (``label_model``) that estimates how
right each voter is and which voters depend on each other. Its posteriors label the
rows that train a linear classifier on words, word beginnings and votes, and the
classifier scores every document.

Texts are read whole. Labels come only from rows outside the held-out quarter (crc32
of the doc_id as text, modulo 4, is 2), at most ``FIT_ROWS`` of them, drawn by a hash
of the doc_id: the mined terms and the classifier are fitted on that sample, everything
else covers all documents. No label, language, source or id is an input of a score.

Defined results: null and empty texts get a score like any text without a hit. A null
doc_id is not held out and has no label. Of a doc_id with several labels the mean
decides (a half counts as toxic), null labels are ignored. Repeated rows and repeated
ids get one result each. Without labelled rows the score is the label model's
posterior; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrecall.llm import label_model
from sparkrecall.llm.common import mix64, text_slices
from sparkrecall.session import cut_lineage

#: Labelled rows that terms are mined from and the classifier is fitted on, at most.
FIT_ROWS = 20_000
#: Terms that the classifier knows, at most.
TERMS = 4096
#: Tasks that the fit sample is dealt over.
SAMPLE_PARTS = 16
#: A term needs this many rows and this distance from chance (standard errors); a
#: beginning of several words in a text is seldom chance and needs less.
LEAST_ROWS, LEAST_Z, LEAST_Z_REPEATED = 3, 6.0, 4.0
#: A mined term is in a lexicon if at least this share of its rows is toxic, two standard
#: errors off; the classifier knows those, and terms of which at most CLEAN_SHARE is toxic.
LEXICON_SHARE, CLEAN_SHARE = 0.5, 0.02
#: Lengths of word beginnings; a repeated beginning has this many different words.
HEADS, REPEATED = (4, 5, 6, 7, 8), 3
#: Held-out rows: remainder of crc32 modulo 4.
HELD_OUT = 2
#: Words of the runs by whose least hashes copies are told, and hashes taken.
COPY_RUN, COPY_HASHES = 5, 3
#: Word sets that a task remembers, and characters split at once.
REMEMBERED, WINDOW = 1 << 17, 1 << 20

# Words of abuse by kind.
INSULTS = """idiot idiots moron morons loser losers clown clowns scum trash imbecile cretin dunce fool fools jerk jerks
 dimwit halfwit nitwit numbskull airhead bonehead lowlife scumbag dirtbag sleazebag degenerate weirdo freak creep coward
 parasite vermin filth maggot rat pig swine garbage""".split()
CONTEMPT = """stupid pathetic worthless disgusting dumb ridiculous useless idiotic moronic brainless clueless spineless
 gutless repulsive revolting vile despicable contemptible hideous ugly filthy rotten miserable laughable""".split()
FOREIGN = """dumm dummkopf blöd blödmann trottel arsch arschloch schwachkopf vollidiot versager abschaum widerlich
 erbärmlich imbécile crétin débile stupide connard abruti ordure racaille pourriture minable idiota imbécil estúpido
 estúpida tonto tonta basura payaso asqueroso patético inútil escoria""".split()
PROFANE = "fuck fucking fucked shit shitty bullshit bitch bastard asshole ass dick crap damn piss slut whore retard retarded".split()
ATTACK = re.compile(r"\b(?:you(?:'re|\s+are)|u\s+r|they(?:'re|\s+are)\s+all)\s+(?:\w+\s+){0,3}?(?:" + "|".join(INSULTS + CONTEMPT + PROFANE) + r")\b")
THREAT = re.compile(r"\b(?:shut\s+(?:the\s+\w+\s+)?up|go\s+to\s+hell|kill\s+(?:yourself|you)|drop\s+dead|i\s+hate\s+you|hope\s+you\s+die"
                    r"|get\s+lost|nobody\s+likes\s+you|burn\s+in\s+hell)\b")
MASKED = re.compile(r"\b(?:f[*@#$]+\w*k\w*|s[h*]?[*@#$!1]+t|b[!1*@]tch|a[*$]{2,}(?:hole)?|st[*u]p[!1*]d|[i!1]d[i!1*][o0*]t)\b")
#: The voters, by bit; the last one speaks for a clean text, the others for a toxic one.
VOTERS = ("insult", "contempt", "foreign", "profane", "attack", "threat", "masked", "three_insults", "mined_word", "mined_words_3",
          "mined_head", "mined_heads_3", "mined_repeated_head", "mined_repeated_heads_3", "nothing")
NOTHING = VOTERS.index("nothing")

_WORD = re.compile(r"[^\W\d_]+")
_SETS = [frozenset(x) for x in (INSULTS, CONTEMPT, FOREIGN, PROFANE)]


def word_set(text: str) -> set[str]:
    """The different words of a text, lower-cased; long texts are split in pieces, cut
    after white space where there is some."""
    found, begin = set(), 0
    while begin < len(text):
        end = begin + WINDOW
        if end < len(text):
            cut = max(text.rfind(" ", begin, end), text.rfind("\n", begin, end))
            end = cut + 1 if cut > begin else end
        found.update(_WORD.findall(text[begin:end].lower()))
        begin = end
    return found


def _heads(word: str) -> list[str]:
    return [word[:k] for k in HEADS if len(word) > k]


def terms_of(words: set[str]) -> set[str]:
    """``=word``, ``^beginning`` and, for beginnings of several words, ``^^beginning``."""
    heads = Counter(h for w in words for h in _heads(w))
    return {f"={w}" for w in words} | {f"^{h}" for h in heads} | {f"^^{h}" for h, n in heads.items() if n >= REPEATED}


@dataclass(frozen=True)
class Terms:
    """Terms of the classifier, in order, and which of them are in the mined lexicons."""
    names: tuple[str, ...]
    toxic: tuple[bool, ...]


class Voting:
    """Votes and term numbers of texts; words are looked up once per task."""

    def __init__(self, terms: Terms):
        self.known = {t: i for i, t in enumerate(terms.names)}
        self.repeated = {t[2:]: i for t, i in self.known.items() if t.startswith("^^")}
        self.kind = {i: ("=", "^", "^^").index(re.match(r"=|\^+", t).group()) for t, i in self.known.items() if terms.toxic[i]}
        self.seen: dict[str, tuple] = {}

    def _look(self, word: str) -> tuple:
        """(term numbers, beginnings that may be repeated) of a word."""
        heads = _heads(word)
        numbers = [self.known[t] for t in (f"={word}", *(f"^{h}" for h in heads)) if t in self.known]
        found = (tuple(numbers), tuple(h for h in heads if h in self.repeated))
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        self.seen[word] = found
        return found

    def vote(self, text: str) -> tuple[int, list[int]]:
        """(bits of the voters that fire, sorted term numbers) of a text."""
        words = word_set(text)
        numbers, heads = set(), Counter()
        seen, look = self.seen, self._look
        for w in words:
            of, repeat = seen.get(w) or look(w)
            if of:
                numbers.update(of)
            if repeat:
                heads.update(repeat)
        numbers.update(self.repeated[h] for h, n in heads.items() if n >= REPEATED)
        listed = [len(words & s) for s in _SETS]
        kinds = Counter(self.kind[i] for i in numbers if i in self.kind)
        fired = [n > 0 for n in listed]
        low = text.lower() if words & {"you", "u", "they", "shut", "hell", "kill", "drop", "hate", "die", "lost"} else ""
        fired += [bool(low and ATTACK.search(low)), bool(low and THREAT.search(low)),
                  bool(MASKED.search(text.lower()) if any(c in text for c in "*@$!") else False),
                  sum(listed) >= 3]
        for k in range(3):
            fired += [kinds[k] >= 1, kinds[k] >= 3]
        return sum(1 << v for v, f in enumerate(fired) if f) or 1 << NOTHING, sorted(numbers)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def train_labels(labels: DataFrame, doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """Written table (doc_id, label int), one row per labelled id outside the held-out quarter."""
    known = labels.where(labels[doc_id].isNotNull() & labels[label].isNotNull() & ~held_out(labels[doc_id]))
    return cut_lineage(known.groupBy(known[doc_id].cast("long").alias("doc_id"))
                       .agg((F.avg(known[label].cast("double")) >= 0.5).cast("int").alias("label")))


def _inputs(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))


def _least_hashes(text: str) -> list[int]:
    """Least hashes of a text's runs of words: near copies have most of them in common."""
    words = _WORD.findall(text.lower())
    runs = {" ".join(words[i:i + COPY_RUN]) for i in range(max(1, len(words) - COPY_RUN + 1))}
    hashed = np.fromiter((zlib.crc32(r.encode()) for r in runs), np.uint64)
    return [int(mix64(hashed + np.uint64(i << 32)).min() >> np.uint64(1)) for i in range(COPY_HASHES)]


def without_copies(sample: DataFrame) -> DataFrame:
    """(label, text) rows of the sample without near copies of a kept row, so that the
    words of one text that was copied often don't pass for signs of its label."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            at = b.schema.get_field_index("text")
            for part, texts in text_slices(b, "text"):
                found = zip(*(_least_hashes(t.decode("utf-8", "replace")) for t in texts), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(at), *(pa.array(f, pa.int64()) for f in found)],
                                                 names=["label", "text", *names])

    names = [f"h{i}" for i in range(COPY_HASHES)]
    keyed = cut_lineage(sample.select("label", "text").mapInArrow(keys, "label int, text string, " + ", ".join(f"{n} long" for n in names))
                        .withColumn("row", F.monotonically_increasing_id()))
    kept = keyed.select("row", "label", *names)
    for n in names:   # of rows with an equal hash the first one stays
        kept = kept.groupBy("label", n).agg(F.min_by(F.struct("row", *[m for m in names if m != n]), "row").alias("s")).select("label", n, "s.*")
    return keyed.join(F.broadcast(kept.select("row")), "row", "left_semi").select("label", "text")


def mine_terms(sample: DataFrame, most: int = TERMS) -> Terms:
    """Terms of (label, text) rows that are found nearly always with one of the two labels."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}

        def flush():
            names = list(held)
            cols = [pa.array(names), *(pa.array([held[t][y] for t in names], pa.int64()) for y in (0, 1))]
            held.clear()
            return pa.RecordBatch.from_arrays(cols, names=["term", "clean", "toxic"])

        totals = [0, 0]
        for b in batches:
            label_at = b.schema.get_field_index("label")
            for part, texts in text_slices(b, "text"):
                for y, t in zip(part.column(label_at).to_pylist(), texts, strict=True):
                    totals[y] += 1
                    for term in terms_of(word_set(t.decode("utf-8", "replace"))):
                        held.setdefault(term, [0, 0])[y] += 1
                    if len(held) > 1 << 19:
                        yield flush()
        held[""] = totals
        yield flush()

    counts = cut_lineage(sample.select("label", "text").mapInArrow(count, "term string, clean long, toxic long")
                         .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(f"clean + toxic >= {LEAST_ROWS} or term = ''"))
    all_rows = counts.where("term = ''").first()
    if not all_rows or not all_rows.clean or not all_rows.toxic:
        return Terms((), ())
    a, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    big_a, big_c = float(all_rows.toxic), float(all_rows.clean)
    p = (a + c) / (big_a + big_c)
    z = (a / big_a - c / big_c) / F.sqrt(p * (1 - p) * (1 / big_a + 1 / big_c))
    n, s = a + c, a / (a + c)
    middle, reach = s + 2 / n, 2 * F.sqrt((s * (1 - s) + 1 / n) / n)   # Wilson bounds, two standard errors
    listed, clean = (middle - reach) / (1 + 4 / n) >= LEXICON_SHARE, (middle + reach) / (1 + 4 / n) <= CLEAN_SHARE
    best = (counts.where((F.col("term") != "") & (p < 1)).withColumns({"z": z, "listed": listed})
            .where((F.abs("z") >= F.when(F.col("term").startswith("^^"), LEAST_Z_REPEATED).otherwise(LEAST_Z)) & (listed | clean)).orderBy(F.desc(F.abs("z")), "term").limit(most).collect())
    best = sorted(best, key=lambda r: r.term)
    return Terms(tuple(r.term for r in best), tuple(bool(r.listed) for r in best))


def votes(docs: DataFrame, terms: Terms) -> DataFrame:
    """Written table (doc_id, mask, terms) of (doc_id, text) rows: one pass over all texts."""
    held = docs.sparkSession.sparkContext.broadcast(terms)   # at most TERMS short words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = Voting(held.value)
        for b in batches:
            for part, texts in text_slices(b, "text"):
                masks, numbers = zip(*(voting.vote(t.decode("utf-8", "replace")) for t in texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(masks, pa.int32()), pa.array(numbers, pa.list_(pa.int16()))],
                    names=["doc_id", "mask", "terms"])

    return cut_lineage(docs.mapInArrow(run, "doc_id long, mask int, terms array<short>"))


def _patterns(voted: DataFrame, labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vote patterns with their label (-1: none) and count: at most 3 * 2^voters rows."""
    rows = (voted.select("doc_id", "mask").join(labelled, "doc_id", "left").groupBy("mask", F.coalesce("label", F.lit(-1)).alias("label"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("mask", "label").collect())
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


@dataclass(frozen=True)
class Classifier:
    bias: float
    terms: np.ndarray
    voters: np.ndarray

    def score(self, masks: np.ndarray, numbers: list[list[int]]) -> np.ndarray:
        sums = np.array([self.terms[n].sum() if n else 0.0 for n in numbers])
        bits = (masks[:, None] >> np.arange(len(self.voters))) & 1
        return 1 / (1 + np.exp(-np.clip(self.bias + sums + bits @ self.voters, -500, 500)))


def train_classifier(masks: np.ndarray, numbers: list[list[int]], goal: np.ndarray, terms: int, penalty: float = 1e-4,
                     rounds: int = 25, inner: int = 40) -> Classifier:
    """Logistic regression on soft labels: Newton steps, each solved by conjugate
    gradients on the sparse rows, halved until the loss falls."""
    voters = len(VOTERS)
    rows = [[*n, *(terms + v for v in range(voters) if m >> v & 1), terms + voters] for m, n in zip(masks, numbers, strict=True)]
    cols = np.concatenate([np.array(r, np.int64) for r in rows])
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    width = terms + voters + 1
    ease = np.full(width, penalty)
    ease[-1] = 1e-9

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row_of, weights=w[cols], minlength=len(rows))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(cols, weights=r[row_of], minlength=width) / len(rows)

    def loss(w: np.ndarray, z: np.ndarray) -> float:
        return float((np.logaddexp(0, z) - goal * z).mean() + 0.5 * (ease * w * w).sum())

    w, z = np.zeros(width), np.zeros(len(rows))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = back(p - goal) + ease * w
        if np.abs(grad).max() < 1e-7:
            break
        curve = p * (1 - p)
        step, left = np.zeros(width), -grad
        way, size = left.copy(), float(left @ left)
        for _ in range(inner):
            bent = back(curve * times(way)) + ease * way
            far = size / float(way @ bent)
            step += far * way
            left = left - far * bent
            new = float(left @ left)
            if new < 1e-4 * float(grad @ grad):
                break
            way, size = left + new / size * way, new
        share, at, moved = 1.0, loss(w, z), times(step)
        while share > 1e-4 and loss(w + share * step, z + share * moved) > at:
            share /= 2
        w, z = w + share * step, z + share * moved
    return Classifier(float(w[-1]), w[:terms], w[terms:-1])


def score_documents(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
                    threshold: float = 0.3, fit_rows: int = FIT_ROWS, most_terms: int = TERMS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    spark = docs.sparkSession
    rows = _inputs(docs, text, doc_id)
    labelled = train_labels(labels, doc_id, label)
    drawn = cut_lineage(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    sample = rows.join(F.broadcast(drawn), "doc_id").select("label", "text")   # fit_rows ids at most
    terms = mine_terms(without_copies(sample.repartition(SAMPLE_PARTS)), most_terms)
    voted = votes(rows, terms)

    masks, given, counts = _patterns(voted, labelled)
    model = label_model.fit(masks, given, counts, [v for v in range(len(VOTERS)) if v != NOTHING], [NOTHING])
    fit = (voted.join(F.broadcast(drawn), "doc_id").orderBy(F.xxhash64("doc_id", "mask", "terms"), "doc_id")
           .limit(fit_rows).select("mask", "label", "terms").toArrow())   # fit_rows rows of small numbers
    if fit.num_rows:
        seen = fit.column("mask").to_numpy().astype(np.int64)
        numbers = fit.column("terms").to_pylist()
        goal = model.posterior(seen, fit.column("label").to_numpy())
        linear = train_classifier(seen, numbers, goal, len(terms.names))
    else:
        linear = None
    held = spark.sparkContext.broadcast((linear, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, prior = held.value
        for b in batches:
            if b.num_rows:
                m = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                s = scorer.score(m, b.column(2).to_pylist()) if scorer else prior.posterior(m)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["doc_id", "score"])

    scored = voted.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
