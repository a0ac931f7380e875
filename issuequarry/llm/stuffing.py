"""Keyword-stuffed and link-list pages (problem 8): a hidden Markov model over the lines of a page.

A page is cut into lines, and long lines into pieces of about 24 words. Each piece shows one of a few signs (SIGNS): a sentence, a record of a
log, trace, table, code or package list, links, short phrases in a list, few words over and over, a short line. A Viterbi search labels the pieces
as prose (records are part of it), link list, tag list or menu. A page is flagged where more than half of its words stand in pieces
that aren't prose; a menu counts where its lines repeat each other or the page's own words.

What the signs need to know of languages and hosts is counted over all pages first: the words that stand in sentences (lines that end as sentences do) more often than in
other lines, and the top-level names of explicit links. No word list of a language is fixed; scripts written without spaces count as sentences by the length of their runs.
The transition and emission tables start from a rough guess and are fitted by rounds of Viterbi training over all pages; the guess keeps a tenth of the weight, at any corpus size.

Nulls: a null or empty text has no words and is no case; pages under `least` words are no cases (very short pages are none by definition). Repeated rows are each reported. Empty tables give no
rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuequarry.llm.textform import ConsistentForm
from issuequarry.session import Scratch

RUN = 6
STATES = ("prose", "link list", "tag list", "menu")
SIGNS = ("sentence", "record", "link", "list", "repeat", "short", "other")

# Start of the fit. Rows: states; columns: signs, or the next state.
EMIT = (
    (0.55, 0.25, 0.01, 0.02, 0.01, 0.06, 0.10),
    (0.01, 0.01, 0.88, 0.03, 0.03, 0.02, 0.02),
    (0.01, 0.01, 0.03, 0.48, 0.42, 0.02, 0.03),
    (0.03, 0.02, 0.05, 0.10, 0.10, 0.60, 0.10),
)
MOVE = (
    (0.94, 0.02, 0.02, 0.02),
    (0.05, 0.90, 0.03, 0.02),
    (0.05, 0.03, 0.90, 0.02),
    (0.10, 0.05, 0.05, 0.80),
)
FIRST = (0.85, 0.05, 0.05, 0.05)

KEPT, ROUNDS = 0.1, 3  # share of the guess in a fitted table, and rounds of training

_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"</?[a-z]\w*|\bhref\b|/a>", re.I)
_SEPARATOR = re.compile("[,;|/•·>、，-]$|^[#–—]")
_RECORD = re.compile(
    r"\s*at \S+\(|\s*(?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d:\d\d|\s*\|.*\||\s*(?:File|from) \S+.*line \d+|\s*[$>]\s|\s*(?:def|class|return|import|public|private|func|if|for|while)\b.*[:({;]\s*$|\s*[\w.-]+\s*=\s*\S+\s*$|\s*(?:traceback|environment|caused by)\b.*:|```",
    re.I,
)
_PACKAGE = re.compile(r"\s*(?:[-*] )?[\w.+@/-]+(?:\s*(?:==|>=|~=|@|[:=])\s*|\s+)v?\d+\.\d+[\w.+-]*\b.{0,40}$")
_LEET = str.maketrans("01345678@$", "oieasgtbas")
_FLOW = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]{4,}")  # scripts without spaces: Thai, Lao, Burmese, Khmer, kana, Han


class Lexicon:
    """What was counted over the corpus: words of sentences, and expressions for links by the top-level names of explicit ones."""

    def __init__(self, words: frozenset[str] = frozenset(), tops: tuple[str, ...] = ()):
        self.words, self.tops = words, tops
        top = "|".join(sorted(map(re.escape, tops), key=lambda x: (-len(x), x))) or "(?!)"
        self.link = re.compile(rf"(?:(?:[a-z]{{3,6}})\W{{0,3}}:?//|//(?=[\w-]+\.)|\bwww\.)[^\s<>\"')\]]+|\b(?:[a-z0-9][a-z0-9-]*(?:\[?\.\]?|\(dot\)))+(?:{top})\b(?:/[^\s<>\"')\]]*)?|[\w.+-]+@[\w-]+(?:\.[\w-]+)+", re.I)
        self.dotted = re.compile(rf"www\.|[\]).]\W?(?:{top})\b", re.I)

    def __getstate__(self) -> dict:
        return {"words": self.words, "tops": self.tops}

    def __setstate__(self, s: dict) -> None:
        self.__init__(s["words"], s["tops"])


def stem(w: str) -> str:
    """A word without case, digits for letters and endings, roughly."""
    w = w.lower().translate(_LEET)
    for e in ("ings", "ing", "ers", "es", "s"):
        if len(w) - len(e) >= 3 and w.endswith(e):
            w = w[: -len(e)]
            break
    return w[:5]


def token(x: str, known: Lexicon) -> tuple[int, int, tuple[str, ...], int, int, int, int]:
    """Of one token between spaces: words, links, stems of its topic words, sentence words, separator after it (2: a hash tag), end of a sentence, letters in runs without spaces."""
    n = len(_WORD.findall(x))
    links = 0
    bare = x
    if "//" in x or "@" in x or "." in x[:-1] and known.dotted.search(x):
        bare, links = known.link.subn(" ", x)
    if "<" in x or "href" in x:
        bare = _MARK.sub(" ", bare)
    topics, grammar = [], 0
    for w in _WORD.findall(bare):
        if w.lower() in known.words:
            grammar += 1
        elif not w.isdigit():
            topics.append(stem(w))
    tag = x[0] == "#" and len(x) > 1 and x[1].isalpha()
    flow = 0 if x.isascii() else sum(map(len, _FLOW.findall(x)))
    return n, links, tuple(topics), grammar, 2 if tag else int(bool(_SEPARATOR.search(x))), int(x[-1] in ".!?。？！" and not links), flow


def pieces(tokens: list[str], info: list[tuple], size: int = 24) -> Iterator[tuple[int, int]]:
    """(from, to) over the tokens of a line: a line of up to 3/2 size whole, a longer one in pieces of about `size`, cut at the end of a sentence where one is near."""
    if len(tokens) <= size * 3 // 2:
        yield 0, len(tokens)
        return
    at = 0
    for i in range(len(tokens)):
        if i + 1 - at >= size * 3 // 2 or i + 1 - at >= size // 2 and info[i][5]:
            yield at, i + 1
            at = i + 1
    if at < len(tokens):
        yield at, len(tokens)


def sign(line: str, whole: bool, info: list[tuple], often: Counter, many: float, total: int, round_: bool) -> tuple[int, int, float]:
    """(sign, words, share of the topic words that fill the page). often: the page's stems with their counts, many: the count that fills it, round_: whether its stems come again and again, however many they are."""
    counts, linked, stems, known, cut, _, flowing = zip(*info, strict=True)
    n = sum(counts)
    if not n:
        return 6, 0, 0.0
    links, grammar, flow = sum(linked), sum(known), sum(flowing)
    seps, tags = len(cut) - cut.count(0), cut.count(2)
    topics = list(chain.from_iterable(stems))
    t = len(topics)
    heavy = sum(often[w] >= many for w in topics) / t if t else 0.0
    if links and t + grammar <= 6 * links and grammar < max(2, 0.2 * (t + grammar)):
        return 2, n, heavy
    if tags >= 3 and 2 * tags >= len(info):
        return 3, n, heavy
    variety = len(set(topics)) / t if t else 1.0
    if whole and _RECORD.match(line):
        return 1, n, heavy
    if t >= 6 and heavy >= 0.5 and variety < 0.75 and grammar < 0.25 * (t + grammar) or t >= 2 and heavy >= 0.75 and total > 30 and flow < 8:
        return 4, n, heavy
    if round_ and t >= 6 and not grammar and not flow and all(often[w] >= 4 for w in topics):
        return 4, n, heavy
    if flow >= 8 or grammar >= 2 and grammar >= 0.12 * (t + grammar) or grammar and t + grammar <= 6 and info[-1][5]:
        return 0, n, heavy
    if whole and (_PACKAGE.match(line) or line.rstrip()[-1:] in "{};"):
        return 1, n, heavy
    if t >= 6 and seps >= 3 and t <= 4 * (seps + 1):
        return 3, n, heavy
    if t >= 6 and variety < 0.5:
        return 4, n, heavy
    return (5 if t < 8 else 6), n, heavy


def log_table(rows) -> list[list[float]]:
    return [[math.log(x) for x in r] for r in rows]


def plain_signs(model: tuple) -> int:
    """How many of the first signs are surely prose on a page that shows no other: none of their states, beginnings or moves beats prose."""
    first, move, emit = model
    if max(first) > first[0] or max(max(r) for r in move) > move[0][0]:
        return 0
    return next((x for x in range(len(SIGNS)) if max(e[x] for e in emit) > emit[0][x]), len(SIGNS))


def viterbi(signs: list[int], words: list[int], model: tuple, plain: int = 0) -> list[int]:
    """The likeliest states; a piece speaks as loud as it is long, as half a line to six lines of eight words. plain: see plain_signs()."""
    if max(signs) < plain:
        return [0] * len(signs)
    first, move, emit = model
    loud = [min(6.0, max(0.5, n / 8)) for n in words]
    best = [first[s] + loud[0] * emit[s][signs[0]] for s in range(4)]
    back = []
    for x, l in zip(signs[1:], loud[1:], strict=True):
        step, now = [], []
        for s in range(4):
            p = max(range(4), key=lambda q: best[q] + move[q][s])
            step.append(p)
            now.append(best[p] + move[p][s] + l * emit[s][x])
        back.append(step)
        best = now
    path = [max(range(4), key=best.__getitem__)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


START = ([math.log(x) for x in FIRST], log_table(MOVE), log_table(EMIT))


class _Known(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, x: str) -> tuple:
        self[x] = v = token(x, self.lexicon)
        return v


class Observer:
    """Signs, word counts and repetition of the pieces of a page; what is known of a token is kept, up to a bound."""

    def __init__(self, lexicon: Lexicon):
        self.form, self.known = ConsistentForm(), _Known(lexicon)

    def __call__(self, text: str) -> tuple[list[int], list[int], list[float]]:
        known = self.known
        if len(known) > 300_000:
            known.clear()
        lines = []
        for line in self.form(text).split("\n"):
            tokens = line.split()
            if tokens:
                lines.append((line, tokens, [known[x] for x in tokens]))
        every = [w for x in lines for i in x[2] for w in i[2]]
        total, often = len(every), Counter(every)
        many, round_ = max(4.0, 0.05 * total), total >= 8 * max(1, len(often))
        signs, words, heavy, run = [], [], [], 0
        for line, tokens, info in lines:
            for a, b in pieces(tokens, info):
                s, n, h = sign(line, b - a == len(tokens), info[a:b], often, many, total, round_)
                if n:
                    signs.append(s), words.append(n), heavy.append(h)
                    # names one a line: a run of lines of few words, without a sentence word or an end, is a list
                    run = run + 1 if s == 5 and n <= 4 and not info[b - 1][5] and not any(x[3] for x in info[a:b]) else 0
                    if run == RUN:
                        signs[-RUN:] = [3] * RUN
                    elif run > RUN:
                        signs[-1] = 3
        return signs, words, heavy


def label(signs: list[int], n: list[int], heavy: list[float], model: tuple = START, plain: int = 0) -> tuple[int, dict[str, int]]:
    """(words, words under each state); a menu whose words don't fill the page is prose."""
    out = dict.fromkeys(STATES, 0)
    if not signs:
        return 0, out
    if max(signs) < plain:
        out["prose"] = sum(n)
        return out["prose"], out
    for s, w, h in zip(viterbi(signs, n, model, plain), n, heavy, strict=True):
        out[STATES[s if s != 3 or h > 0.5 else 0]] += w
    return sum(n), out


_LETTERS = re.compile(r"[^\W\d_]+")
_HOST = re.compile(r"(?:[a-z]{3,6}:)?(?://|\bwww\.)(?:[\w-]+\.)+([a-z]{2,18})(?![\w.-])")


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, w, p, q): of words (kind 0) how often they stand in lines that end as sentences do, and in other lines and lists; of top-level names (kind 1) how often they end an explicit host.
    Tokens are counted as they are and cut into words once each; a task holds some hundred thousand."""
    inside, outside, tops = Counter(), Counter(), Counter()

    def flush() -> pa.RecordBatch:
        words: dict[str, list[int]] = {}
        for i, counts in enumerate((inside, outside)):
            for token_, m in counts.items():
                for w in _LETTERS.findall(token_):
                    words.setdefault(w, [0, 0])[i] += m
        cols = [[0] * len(words) + [1] * len(tops), [*words, *tops], [*(x[0] for x in words.values()), *tops.values()], [*(x[1] for x in words.values()), *[0] * len(tops)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["kind", "w", "p", "q"])

    for b in batches:
        for text in b.column(0).to_pylist():
            for line in (text or "").lower().split("\n"):
                tokens = line.split()
                if not tokens:
                    continue
                n, end, cuts = len(tokens), tokens[-1][-1] in ".!?。？！", sum(map(line.count, ",;|/•·>"))
                link = "//" in line or "www." in line or "@" in line
                if link:
                    tops.update(_HOST.findall(line))
                elif n >= 5 and end and cuts * 4 <= n:
                    inside.update(tokens)
                if not end or cuts * 3 > n:
                    outside.update(tokens)
            if len(inside) + len(outside) > 400_000:
                yield flush()
                inside, outside, tops = Counter(), Counter(), Counter()
    yield flush()


def lexicon(df: DataFrame, text: str, scratch: Scratch, most: int = 3000, odds: float = 0.9) -> Lexicon:
    """Counted over all pages. Words of sentences: those whose share among the words of lines that end as sentences do is above that among the other lines' (by 1 / odds); the
    `most` most frequent, which bounds what is handed out. Top-level names: last labels of the hosts of explicit links that stand there twice (at most 500)."""
    counts = df.select(F.col(text).cast("string")).mapInArrow(count_words, "kind int, w string, p bigint, q bigint").groupBy("kind", "w").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    counts = scratch.keep(counts)
    all_ = counts.filter("kind = 0").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).first()
    known = counts.filter((F.col("kind") == 0) & (F.col("p") >= max(2.0, 1e-5 * (all_.p or 0))) & ((F.col("q") + 0.5) / ((all_.q or 0) + 1) < odds * (F.col("p") + 0.5) / ((all_.p or 0) + 1)))
    tops = counts.filter("kind = 1 and p > 1").orderBy(F.desc("p"), "w").limit(500)
    return Lexicon(frozenset(r.w for r in known.orderBy(F.desc("p"), "w").limit(most).select("w").collect()), tuple(sorted(r.w for r in tops.collect())))


def observed(df: DataFrame, key: str, text: str, known: Lexicon) -> DataFrame:
    """key and, for each page, signs (bytes), words and fill of its pieces: all that the model needs of a page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ob = Observer(known)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                c = b.slice(at, 1000)
                rows = [ob(t) if t else ((), (), ()) for t in c.column(1).to_pylist()]
                cols = [pa.array([bytes(r[0]) for r in rows], pa.binary()), pa.array([list(r[1]) for r in rows], pa.list_(pa.int32())), pa.array([bytes(x > 0.5 for x in r[2]) for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([c.column(0), *cols], ["key", "signs", "words", "fill"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string")).mapInArrow(work, f"key {df.schema[key].dataType.simpleString()}, signs binary, words array<int>, fill binary")


def trained(pages: DataFrame, model: tuple) -> tuple:
    """The tables after a round of Viterbi training over all observed pages with `model`. The counts are at most 48 numbers a task."""
    plain = plain_signs(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            simple = []
            for i, signs in enumerate(b.column(0).to_pylist()):
                if signs and max(signs) < plain:
                    simple.append(signs)
                elif signs:
                    path = viterbi(list(signs), b.column(1)[i].as_py(), model)
                    c["f", path[0], 0] += 1
                    c.update(("e", s, x) for s, x in zip(path, signs, strict=True))
                    c.update(("m", s, x) for s, x in zip(path, path[1:], strict=False))
            if simple:  # all prose
                c["f", 0, 0] += len(simple)
                c["m", 0, 0] += sum(map(len, simple)) - len(simple)
                for x, m in Counter(b"".join(simple)).items():
                    c["e", 0, x] += m
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.string()), pa.array([k[1] for k in c], pa.int32()), pa.array([k[2] for k in c], pa.int32()), pa.array(list(c.values()), pa.int64())], ["t", "i", "j", "n"])

    rows = pages.select("signs", "words").mapInArrow(work, "t string, i int, j int, n bigint").groupBy("t", "i", "j").agg(F.sum("n").alias("n")).collect()
    n = {(r.t, r.i, r.j): r.n for r in rows}

    def row(fixed, counts: list[int]) -> list[float]:
        seen = sum(counts)
        return [math.log(KEPT * x + (1 - KEPT) * m / seen if seen else x) for x, m in zip(fixed, counts, strict=True)]

    table = lambda kind, fixed: [row(r, [n.get((kind, i, j), 0) for j in range(len(r))]) for i, r in enumerate(fixed)]
    return row(FIRST, [n.get(("f", i, 0), 0) for i in range(4)]), table("m", MOVE), table("e", EMIT)


def fitted(pages: DataFrame, rounds: int = ROUNDS) -> tuple:
    model = START
    for _ in range(rounds):
        model = trained(pages, model)
    return model


def label_pages(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 20, more_than: float = 0.5) -> DataFrame:
    """key, words, prose, links, tags, menu (words under each), share (of words outside prose), stuffed."""
    scratch = Scratch(df.sparkSession, "stuffing")
    pages = scratch.keep(observed(df, key, text, lexicon(df, text, scratch)))
    model = fitted(pages)
    plain = plain_signs(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [label(list(s), w, f, model, plain) for s, w, f in zip(*[b.column(i).to_pylist() for i in (1, 2, 3)], strict=True)]
            n = [r[0] for r in rows]
            share = [1 - r[1]["prose"] / r[0] if r[0] else 0.0 for r in rows]
            cols = [pa.array(n, pa.int64()), *[pa.array([r[1][s] for r in rows], pa.int64()) for s in STATES], pa.array(share, pa.float64()), pa.array([m >= least and s > more_than for m, s in zip(n, share, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names)

    names = [key, "words", "prose", "links", "tags", "menu", "share", "stuffed"]
    kind = df.schema[key].dataType.simpleString()
    return pages.mapInArrow(work, f"`{key}` {kind}, words bigint, prose bigint, links bigint, tags bigint, menu bigint, share double, stuffed boolean")
