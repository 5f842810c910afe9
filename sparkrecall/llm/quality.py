"""Quality rules, line first.

Each line is judged by four rules of its own: navigation (many separators for its
words), symbols (many of ``#*$%&|<>`` for its words), shouting (capitals and runs
of exclamation marks) and notices (a notice phrase in the form of a notice: a call to the
reader that begins the line, or a site that speaks of itself; prose that only has the
words stays). A fifth rule, menus, judges short lines by their company: a title-like line
of at most ``MENU_WORDS`` words (it begins with a capital or a letter without case, is not
indented, and has no mark but hyphens, apostrophes and ampersands) fails in a run of
``MENU_LINES`` such lines or more, lines without a word aside, or if the text repeats it
so often. So headings, list items with a marker, verse and code stay; three bare one-word
lines in a row can't be told from a menu and go. Failing lines are removed; then a
document is rejected when it lost more than ``MOST_LOST_PERCENT`` of its words, or when
the base test fails: too few words, or too many words inside repeated three-word windows.

Words are runs of anything but ASCII white space; lines are split at ``\\n``. Lines
without a word are kept and never counted. A null text has no words and fails the
base test. Every row gets a verdict, repeated rows and null ids included; other
columns, whatever their names, pass through ``clean`` unchanged, except n_chars,
which follows a text that lost lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkrecall.llm.common import text_slices

LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50
MOST_LOST_PERCENT = 30
#: Title-like lines of so many words at most count as menu entries where so many stand together.
MENU_WORDS = 4
MENU_LINES = 3
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_NAV = re.compile("\\||»|›|•|·".encode())
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")
#: A title-like line (patterns here are written for Python and RE2 alike).
MENU = (r"^[^\x00-@\[-\x7fß-öø-ÿ•·–—«»‹›“”‘’„…]"
        r"[^\x00-\x08\x0e-\x1f!\"#$%()*+,./:;<=>?@\[\\\]^_`{|}~•·–—«»‹›“”„…。！？।؟]*$")
_MENU = re.compile(MENU)
#: Notice phrases, lower case.
NOTICES = ("javascript", "cookie", "lorem ipsum", "privacy policy", "terms of use", "terms of service", "sign in", "log in",
           "subscribe", "click here", "read more", "share this")
_NOTICE = re.compile(b"|".join(re.escape(n.encode()) for n in NOTICES))
_SITE = r"(?:this|our|the) (?:web ?)?(?:site|page|app|application|shop|service)"
_TERMS = r"(?:privacy policy|terms of (?:use|service)|cookie policy)"
_SWITCH = r"(?:enable|activate|allow|accept|turn on|switch on) (?:all |the |our )?(?:javascript|cookies?)"
_MARKS = r"[\x00-/:-@\[-`{-\x7f•·–—«»‹›“”‘’„…]*"
_STOP = rf"(?:{_MARKS}$|\s*[.!?…:;,»›>|(])"
#: Notices, in lower case with single spaces. Calls begin the line; the others stand at a word boundary.
CALL = rf"^{_MARKS}" + r"(?:(?:please|to continue,?|you (?:must|need to|have to)|(?:want|would you like) to) )?(?:" + "|".join((
    rf"(?:sign|log) in(?:{_STOP}| (?:to|or|with|using|now|here|below|for|and|via)\b)",
    r"click here\b",
    rf"read more(?:{_STOP}| (?:about|at|on|here|from)\b)",
    rf"share this(?:{_STOP}| (?:article|page|post|story|video|recipe|link|on|via|with (?:your )?(?:friends|followers|others))\b)",
    rf"subscribe(?:{_STOP}| (?:to (?:our|the|this|my)|now|today|here|for|via)\b)",
    rf"{_SWITCH}(?:{_STOP}| (?:to|in your|for|on)\b)",
    rf"(?:see|read|view|review) (?:our|the) (?:full )?{_TERMS}\b",
    rf"lorem ipsum(?:{_STOP}| dolor\b)")) + ")"
OWN = "|".join((
    rf"\b(?:we|{_SITE}) (?:and our partners )?(?:also )?(?:uses?|sets?|stores?|requires?|needs?) (?:\w+ ){{0,3}}(?:javascript|cookies?)(?: (?:to (?:make|improve|give|offer|"
    rf"provide|ensure|personali[sz]e|analy[sz]e|enhance|remember|help|work|run|function)|on|for|in order|and|or|so)\b|{_STOP})",
    rf"\bby (?:using|visiting|browsing|continuing|clicking|signing|subscribing|accessing)\b.*\b(?:{_TERMS}|cookies)\b",
    rf"\b(?:you|i) (?:agree|consent|accept)\b.*\b(?:{_TERMS}|cookies)\b",
    rf"\b{_SWITCH} (?:to (?:run|use|view|see|access) (?:this|the|our)|in your browser)\b",
    r"\bjavascript (?:is|seems to be|must be) (?:disabled|turned off|enabled) (?:in|on) your browser\b",
    r"\byour browser (?:does not|doesn't|has no)\b.*\bjavascript\b",
    r"\bsubscribe to (?:our|the|this|my) (?:\w+ )?(?:newsletter|channel|feed|mailing list|podcast)\b",
    r"\bclick here (?:to|for|if)\b"))
_CALL, _OWN = re.compile(CALL, re.ASCII), re.compile(OWN, re.ASCII)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
VERDICT = "base_failed boolean, kept boolean, n_bad_lines long, n_lost_words long"


def is_notice(line: bytes) -> bool:
    """Whether a line that holds a notice phrase has the form of a notice."""
    text = _SPACE.sub(" ", line.decode("utf-8", "replace").lower())
    return _CALL.search(text) is not None or _OWN.search(text) is not None


def line_fails(line: bytes, n_words: int) -> bool:
    """The rules that judge a line with at least one word on its own."""
    if 10 * len(_NAV.findall(line)) >= max(20, 3 * n_words):
        return True
    if 10 * len(_SYMBOLS.findall(line)) >= max(30, 3 * n_words):
        return True
    if 10 * line.count(b"!!") >= max(20, 3 * n_words):
        return True
    if n_words >= 5:
        text = line.decode("utf-8", "replace")
        if 10 * len(_UPPER.findall(text)) > 7 * max(10, len(_LETTER.findall(text))):
            return True
    return n_words < 30 and _NOTICE.search(line.lower()) is not None and is_notice(line)


def menu_lines(lines: list[bytes], sizes: list[int]) -> set[int]:
    """The places of the lines that count as menu entries by their company."""
    titles = [i for i, k in enumerate(sizes) if 0 < k <= MENU_WORDS and _MENU.match(lines[i].decode("utf-8", "replace"))]
    times = Counter(lines[i] for i in titles)
    out, run, after = set(), [], 0
    for i in titles:
        if any(sizes[after:i]):
            run = []
        run.append(i)
        after = i + 1
        if len(run) >= MENU_LINES:
            out.update(run[-MENU_LINES:])
        if times[lines[i]] >= MENU_LINES:
            out.add(i)
    return out


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    n, end = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def judge(text: bytes) -> tuple[tuple, bytes | None]:
    """Metrics and verdict of one text, and the text without its failing lines
    (None where no line fails)."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    word_chars = len(joined.decode("utf-8", "replace"))
    symbols = len(_SYMBOLS.findall(text))
    seen: set[bytes] = set()
    dup = lost = bad = 0
    good = []
    lines = text.split(b"\n")
    sizes = [len(x.split()) for x in lines]
    menu = menu_lines(lines, sizes)
    for i, (line, k) in enumerate(zip(lines, sizes, strict=True)):
        if not k:
            good.append(line)
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        if i in menu or line_fails(line, k):
            lost += k
            bad += 1
        else:
            good.append(line)
    repeat = repeat_words(words)
    base_failed = n < LEAST_WORDS or 100 * repeat > MOST_REPEAT_PERCENT * n
    kept = not base_failed and 100 * lost <= MOST_LOST_PERCENT * n
    return (n, word_chars, symbols, dup, repeat, base_failed, kept, bad, lost), b"\n".join(good) if bad else None


def verdicts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, metrics and verdict, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in f"{METRICS}, {VERDICT}".split(", ")]
        kinds = [pa.bool_() if " boolean" in x else pa.int64() for x in f"{METRICS}, {VERDICT}".split(", ")]
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                columns = zip(*(judge(t)[0] for t in texts), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                                 names=["doc_id", *names])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, f"doc_id long, {METRICS}, {VERDICT}")


def clean(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The kept rows of ``docs`` without their failing lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, count = batch.schema.get_field_index(text), batch.schema.get_field_index(n_chars)
            for part, texts in text_slices(batch, text):
                judged = [judge(t) for t in texts]
                rows = [i for i, (v, _) in enumerate(judged) if v[6]]
                out = [texts[i] if judged[i][1] is None else judged[i][1] for i in rows]
                columns = [c.take(pa.array(rows, pa.int64())) for c in part.columns]
                columns[at] = pa.array(out, pa.binary()).cast(part.schema.field(at).type)
                if count >= 0:
                    old = columns[count].to_pylist()
                    columns[count] = pa.array([o if judged[i][1] is None or o is None else len(t.decode("utf-8", "replace"))
                                               for o, i, t in zip(old, rows, out, strict=True)], part.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
