"""Repair of text read from scanned pages.

A caption is taken apart into lines; lines that the page added (running headers,
page numbers) and figure labels are set apart, and the others are joined to one
character stream with a mark at every line end that a hyphen closes. A running
header is a line that stands on several pages of its paper and interrupts the
text there, or one that has the form of a header.

The stream is decoded into words by one dynamic programme (``Decoder.decode``).
Its edges are the words of the lexicon, read with confused characters, blanks
within them and hyphens at line ends put right, each at its price; a word may
follow another without a blank (a split); and each run of letters may stay as
it is, as an unknown word. The cheapest path is the text. Words of at least
``COMMON`` of all words and what holds no letters are read as they stand, which
bounds the stretches to decode; a stretch goes beyond a blank only where one of
its sides would stay unknown. Paragraph bounds are chosen by dynamic programming
over the body lines.

The frequencies are those of all words of all distinct captions. The lexicon
holds the words that make up at least ``RARE`` of all words: at most 1 / RARE
entries at any size of input, so that it can be broadcast.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.runtime import SharedTables, spread

RARE = 1e-6
#: How characters are misread (fixed values): as read, as printed.
CONFUSED = [
    ("€", "e"), ("@", "a"), ("0", "o"), ("5", "s"), ("1", "l"), ("|", "l"), ("!", "i"), ("9", "g"), ("8", "b"),
    ("c", "e"), ("ii", "u"), ("li", "h"), ("rn", "m"), ("vv", "w"), ("d", "cl"), ("m", "rn"), ("ﬁ", "fi"), ("ﬂ", "fl"),
    ("1", "i"), ("|", "i"), ("!", "l"), ("6", "b"), ("3", "e"), ("$", "s"), ("4", "a"), ("7", "t"), ("2", "z"),
]
#: Signs that no printed word holds between its letters.
ODD = re.compile(r"[€@|!$ﬁﬂ]|\d")
#: A word is known from this count on.
LEAST = 3
#: Prices in nats: of a confused character (the word is that many times as frequent as its misreading), of a blank
#: put in or left out, of a short piece; an unknown word has a price of its own and one for each letter, and is no more likely than one counted as ONCE.
CONFUSE, SPLIT, MERGE, SHORT = math.log(8), 6.0, 8.0, 4.0
UNKNOWN, LETTER, ONCE = 5.0, math.log(26), 0.01
COMMON = 1e-4
#: A line is a running header if it stands on so many pages of a paper, and interrupts the text in so many of its places.
PAGES, INTERRUPTS = 3, 0.8
HARD, SOFT = "\x01", "\x02"  # a line end closed by a hyphen, or by a mark that is no hyphen

_NEWLINE = re.compile("\r\n|[\n\r\x85\u2028\u2029]")
_PAGE = re.compile(r"(?:\[ ?\d{1,5} ?\]|([~—–-]) ?\d{1,5} ?\1|(?:p|pp|pag|pág|page|s|seite|página)\.? ?\d{1,5}|\d{1,5}\.?|(?=[ivxl]{2})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))", re.I)
_LABEL = re.compile(r"\(?[A-Za-z]\)?(?:(?:[–-]|, ?)\(?[A-Za-z]\)?)*\.?|\d{1,2}[–-]\d{1,2}|(?:Scale )?[Bb]ars? ?= ?[\d.,]+ ?[µμn]?m\.?")
_FRONT, _BACK = re.compile(r"(\d{1,5})(?:\s{2,}| ?\| ?)(?=\D)"), re.compile(r"(?:\s{2,}|\s*\|\s*)(\d{1,5})$")
_NAME = r"[^\W\d_][^\W\d_'’]*\.?"
_TITLE = rf"{_NAME}(?: {_NAME}){{0,5}}"
_YEAR = r"(?:1[5-9]|20)\d\d"
_HEADS = [
    re.compile(x)
    for x in (
        r"(?:[*=~•] ?){2,}.{3,80}?(?: ?[*=~•]){2,}",  # * * * JOURNAL * * *
        rf"{_TITLE},? (?:[Vv]ol|VOL|[Nn]o|NO|[Tt]omo)\.? ?\d+(?: ?\({_YEAR}\))?",  # Journal, vol. 7 (1990)
        rf"{_TITLE} \d+ ?(?:\(\d+\))?: ?{_YEAR}",  # Journal 9(4): 2017
        rf"{_NAME}(?: (?:&|et|and|e|y) {_NAME})?,? {_YEAR} ?[·•|–—-] ?{_TITLE}",  # Author, 1990 · Journal
        rf"[A-ZÀ-Þ]{_NAME} & [A-ZÀ-Þ]{_NAME}: {_TITLE}",  # Author & Author: Title
        rf"{_TITLE} [—–] {_TITLE}",  # Title — Author
    )
]
_CHUNK = re.compile(r"\S+")
_SIGNS = re.compile(r"\W*")
_PLATE = re.compile(r"(?:fig|plate|pl|est|estampa|prancha|l[áa]m|l[áa]mina|planche|tab)(?:s|ure|ures|ura|uras|e)?", re.I)
_END = re.compile(r"[-\u2010\u2011¬\u00ad][^\S\n]*$")
_CODE = re.compile(r"[A-Z]{1,3}-?\d+[a-z]?|\d[\d.,–×%/()-]*(?:[a-zµ]{1,2})?|[A-Za-z]\d?")


def role(line: str) -> tuple[str, bool]:
    """('body' | 'blank' | 'label' | 'header' | 'page', whether the line has a page number)."""
    s = line.strip()
    if not s:
        return "blank", False
    if _PAGE.fullmatch(s):
        return "page", True
    if _LABEL.fullmatch(s):
        return "label", False
    if _headed(s):
        return "header", False
    m = _FRONT.match(s)
    rest = s[m.end() :] if m else s[: m.start()] if (m := _BACK.search(s)) else None
    return ("header", True) if rest is not None and _headed(rest) else ("body", False)


def _headed(line: str) -> bool:
    """Whether a line has the form of a running header, as printed or in capitals, blanks and noughts aside."""
    s = re.sub(r"\s+", " ", line.strip())
    s = re.sub(r"(?<=[^\W\d_])0|0(?=[^\W\d_])", lambda m: "o" if s[m.start() - 1 : m.start()].islower() else "O", s)
    if (s[:1].isupper() or s[:1] in "*=~•") and any(h.fullmatch(s) for h in _HEADS):
        return True
    words = re.findall(r"[^\W\d_]+", s)
    return len(words) >= 3 and all(w.isupper() for w in words) and not re.search(r"\b\d+\b", s)


class Decoder:
    """Reads the stream as words of a lexicon (lower-case word to count)."""

    def __init__(self, lexicon: dict[str, int], total: int):
        self.lex, self.total = {w: n for w, n in lexicon.items() if n >= LEAST}, max(total, 1)
        self.sorted = sorted(self.lex)
        self.first: dict[str, list[tuple[str, str]]] = {}
        for read, printed in CONFUSED:
            self.first.setdefault(read[0], []).append((read, printed))
        self.known: dict[str, tuple] = {}
        self.chunks: dict[str, tuple] = {}

    def cost(self, word: str) -> float:
        return math.log(self.total / self.lex[word])

    def unknown(self, letters: int) -> float:
        return max(math.log(self.total / ONCE), UNKNOWN + LETTER * letters)

    def words_from(self, s: str, i: int) -> Iterator[tuple[int, float, str, int, bool]]:
        """(end, price, word, confusions, whether a line end was closed) of all readings of ``s`` from ``i`` on as one word of the lexicon.

        Words that share a beginning are a range of the sorted lexicon, which
        each character read narrows; a reading ends where no word is left.
        """
        words, n = self.sorted, len(s)
        todo = [(i, "", 0, len(words), 0.0, 0, False)]
        while todo:
            p, prefix, lo, hi, price, swaps, closed = todo.pop()
            if prefix and words[lo] == prefix:
                yield p, price + self.cost(prefix), prefix, swaps, closed
            if p == n:
                continue
            c = s[p]
            steps = [(p + 1, c, 0.0, 0, closed)]
            if c == " ":
                steps = [(p + 1, "", MERGE, 0, closed)] if prefix else []
            elif c == HARD:
                steps = [(p + 1, "", 0.0, 0, True), (p + 1, "-", 0.0, 0, closed)]
            elif c == SOFT:
                steps = [(p + 1, "", 0.0, 0, True)]
            else:
                for read, printed in self.first.get(c, ()):
                    if s.startswith(read, p):
                        steps.append((p + len(read), printed, CONFUSE, 1, closed))
                    elif len(read) == 2 and p + 2 < n and s[p + 1] in (HARD, SOFT) and s[p + 2] == read[1]:
                        steps.append((p + 3, printed, CONFUSE, 1, True))
            for q, more, extra, swap, shut in steps:
                a, b, longer = lo, hi, prefix + more
                if more:
                    a = bisect_left(words, longer, lo, hi)
                    b = bisect_left(words, longer + "\uffff", a, hi)
                if a < b:
                    todo.append((q, longer, a, b, price + extra, swaps + swap, shut))

    def decode(self, s: str) -> tuple[str, frozenset, bool]:
        """(text, kinds of noise, whether a part stays unknown) of a stretch: runs of letters and misread signs, with blanks or line-end marks between them."""
        low, n = s.lower(), len(s)
        if len(low) != n:  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in s)
        best: list[tuple | None] = [(0.0, -1, "", frozenset(), False)] + [None] * n  # price, from where, text, kinds, unknown

        def reach(i: int, j: int, price: float, text: str, kinds: frozenset, unknown: bool) -> None:
            if best[j] is None or price < best[j][0]:
                best[j] = (price, i, text, kinds, unknown)

        for i in range(n):
            if best[i] is None:
                continue
            so_far = best[i][0]
            if s[i] == " ":
                reach(i, i + 1, so_far, " ", frozenset(), False)
                continue
            begins = i == 0 or s[i - 1] == " "
            for j, price, word, swaps, closed in self.words_from(low, i):
                ends = j == n or s[j] == " "
                if j < n and s[j] in (HARD, SOFT):
                    continue
                if not (begins and ends):
                    price += SHORT * (len(word) < 3)
                kinds = ({"char_error"} if swaps else set()) | ({"hyphen_break"} if closed else set())
                text = s[i:j] if low[i:j] == word else _cased(word, s[i:j])
                reach(i, j, so_far + price + (0.0 if begins else SPLIT), text if begins else " " + text, frozenset(kinds), False)
            if begins:
                j = s.find(" ", i)
                j = n if j < 0 else j
                whole = s[i:j]
                closed = HARD in whole or SOFT in whole
                whole = whole.replace(HARD, "").replace(SOFT, "")
                kinds = {"hyphen_break"} if closed else set()
                if _misread(whole):
                    kinds.add("char_error")
                    whole = self._plain(whole)
                reach(i, j, so_far + self.unknown(len(whole)), whole, frozenset(kinds), True)
        out, kinds, unknown, j = [], set(), False, n
        while j > 0:
            _, i, text, k, u = best[j]
            out.append(text)
            kinds |= k
            unknown, j = unknown or u, i
        return "".join(reversed(out)), frozenset(kinds), unknown

    def alone(self, part: str) -> tuple[str, frozenset, bool]:
        got = self.known.get(part)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            got = self.known[part] = self.decode(part)
        return got

    def parts(self, chunk: str) -> list[tuple[str, bool]]:
        """The chunk cut into what may be words to decode (True) and what stands as it is."""
        if chunk.isalpha() and (self.lex.get(chunk.lower(), 0) >= self.total * COMMON or len(chunk) < 3):
            return [(chunk, False)]
        pre = _SIGNS.match(chunk)[0]
        post = _SIGNS.match(chunk[len(pre) :][::-1])[0][::-1]
        core = chunk[len(pre) : len(chunk) - len(post)]
        # signs that are misread letters may stand at either end of a word
        while pre and pre[-1] in "€@|$" and core:
            pre, core = pre[:-1], pre[-1] + core
        while post and post[0] in "€@|!$" and core and core[-1].isalnum() and not (post[0] == "!" and self.lex.get(core.lower(), 0)):
            core, post = core + post[0], post[1:]
        if len(core) < 2 or _CODE.fullmatch(core) or not any(c.isalpha() for c in core):
            return [(pre + core + post, False)]
        out = [(pre, False)]
        for part in re.split(r"([-–/.,;:()\[\]]+)", core):
            fixed = len(part) < 3 or not any(c.isalpha() for c in part) or bool(_CODE.fullmatch(part))
            odd = bool(ODD.search(part)) and bool(re.search(r"[^\W\d_]{2}", part))
            out.append((part, not fixed and (odd or self.lex.get(part.lower(), 0) < self.total * COMMON)))
        return [x for x in (*out, (post, False)) if x[0]]

    def chunk(self, chunk: str) -> tuple:
        """(texts of its parts, kinds, number of signs before, of signs after, the run as read if it is one run of letters, whether a part stays unknown)."""
        got = self.chunks.get(chunk)
        if got is None:
            ps = self.parts(chunk)
            read = [self.alone(p) if open_ else (p, frozenset(), False) for p, open_ in ps]
            # signs may stand before a word that goes on, and after one that ends
            head = int(len(ps) > 1 and not ps[0][1] and ps[0][0] in "([\"“")
            tail = int(len(ps) - head > 1 and not ps[-1][1] and ps[-1][0][0] in ".,;:)]\"”")
            run = ps[head][0] if len(ps) - head - tail == 1 and (ps[head][1] or ps[head][0].isalpha()) else None
            got = ([r[0] for r in read], frozenset().union(*(r[1] for r in read)), head, tail, run, any(r[2] for r in read))
            if len(self.chunks) > 300_000:
                self.chunks.clear()
            self.chunks[chunk] = got
        return got

    def line(self, text: str) -> tuple[str, frozenset]:
        """(text, kinds of noise) of one paragraph of the stream."""
        done: list[list] = []  # of each chunk: its text, and, if it is one run of letters that could be part of a word: the run as read, whether it stays unknown
        kinds: set[str] = set()
        for chunk in _CHUNK.findall(text):
            entry = list(self.chunk(chunk))
            run = entry[4]
            before = done[-1] if done else None
            if before and run and before[4] and not entry[2] and not before[3] and (entry[5] or before[5]) and run[0].islower() | (not run[0].isalpha()):
                span = f"{before[4]} {run}"
                fixed, k, unknown = self.alone(span)
                if fixed.count(" ") < span.count(" ") and not unknown:
                    # the blank stood within a word
                    before[0] = [*before[0][: before[2]], fixed, *entry[0][1:]]
                    before[1], before[3], before[4], before[5] = k, entry[3], span, False
                    continue
            done.append(entry)
        for e in done:
            kinds |= e[1]
        return " ".join("".join(e[0]) for e in done), frozenset(kinds)

    @staticmethod
    def _plain(w: str) -> str:
        """``w`` with its signs and digits between letters put back, without a lexicon."""
        for read, printed in CONFUSED:
            if not read.isalpha() or not read.isascii():
                w = re.sub(rf"(?<=[^\W\d_]){re.escape(read)}|{re.escape(read)}(?=[^\W\d_])", printed, w)
        return w

    def caption(self, text: str, headed: Callable[[str], bool] | None = None) -> tuple[str, frozenset]:
        """(repaired text, kinds of noise) of a caption; ``headed`` tells of a ``header_key`` whether it is a running header of its paper."""
        kinds: set[str] = set()
        lines = _NEWLINE.split(text)
        if len(lines) == 1:
            body, bounds = [text.strip()], set()
        else:
            body, gaps, gap = [], [], False
            for line in lines:
                what, number = role(line)
                if what == "body" and headed and headed(header_key(line)):
                    s = line.strip()
                    what, number = "header", bool(_FRONT.match(s) or _BACK.search(s))
                if what == "header":
                    kinds.add("running_header")
                if number:
                    kinds.add("page_number")
                if what == "body":
                    body.append(line.strip())
                    gaps.append(gap)
                    gap = False
                elif what == "blank":
                    gap = True
            bounds = paragraphs(body, gaps)
        stream = []
        for i, line in enumerate(body):
            m = _END.search(line)
            after = body[i + 1][:1] if i + 1 < len(body) else ""
            if m and m.start() and after and (line[m.start() - 1].isalpha() or line[m.start() - 1] in "€@|!$") and (after.islower() or after in "€@|!015689ﬁﬂ"):
                joins = self._plain(body[i + 1][:2])[:1].isalpha()
                stream.append(line[: m.start()] + (HARD if line[m.start()] in "-\u2010\u2011" else SOFT) if joins else line)
            else:
                stream.append(line + ("\n" if i in bounds else " "))
        out = []
        for piece in "".join(stream).split("\n"):
            fixed, k = self.line(piece)
            out.append(fixed)
            kinds |= k
        return "\n".join(x for x in out if x), frozenset(kinds)


def _cased(word: str, read: str) -> str:
    """The word in the case of what was read."""
    letters = "".join(c for c in read if c.isalpha())
    if letters.isupper() and len(read) > 3:
        return word.upper()
    return word[0].upper() + word[1:] if read[0].isupper() or read[0] == "8" else word  # only B is read as 8


def _misread(w: str) -> bool:
    """Whether a word no lexicon knows holds signs or digits that stand for letters."""
    if not ODD.search(w) or not re.search(r"[^\W\d_]{2}", w):
        return False
    return bool(re.search(r"[^\W\d_]\W?[€@|!$ﬁﬂ\d][^\W\d_]|^[€@|!$\d][^\W\d_]{3}|[^\W\d_]{3}[€@|!$\d]$", w))


def header_key(line: str) -> str:
    """A line without case, signs, and the numbers at its ends: equal for one running header on several pages."""
    return re.sub(r"[\W_]+", " ", line.lower()).strip(" 0123456789")


def line_hash(paper: str, key: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{paper}\0{key}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def places(text: str) -> list[tuple[str, bool]]:
    """(key, whether it interrupts) of the lines of a caption that could be running headers.

    A line interrupts if the text goes on across it: after a full stop, or at
    the caption's beginning, with a capital; else in lower case.
    """
    lines = [x.strip() for x in _NEWLINE.split(text)]
    if len(lines) < 2:
        return []
    roles, out = [role(x)[0] for x in lines], []
    body = [i for i, r in enumerate(roles) if r == "body"]
    for n, i in enumerate(body):
        first = re.search(r"[^\W\d_]", lines[i])
        key = header_key(lines[i])
        if not first or not first[0].isupper() or len(key) < 4 or _PLATE.fullmatch(key):
            continue
        before = lines[body[n - 1]][-1:] if n else ""
        after = lines[body[n + 1]][:1] if n + 1 < len(body) else ""
        stop = not before or before in ".!?:)"
        out.append((key, not stop if after.islower() else stop))
    return out


def paragraphs(lines: list[str], gaps: list[bool]) -> set[int]:
    """Lines after which a paragraph ends: the cheapest set, by dynamic programming.

    Ending one costs less after a full stop, before a blank line, and after a
    line far shorter than the longest; going on costs more in these cases; a
    paragraph of one short line costs extra.
    """
    n = len(lines)
    if n < 2:
        return set()
    width = max(len(x) for x in lines)
    end, on = [], []
    for i in range(n - 1):
        stop = bool(re.search(r"[.!?][)\]\"”]?$", lines[i]))
        fits = len(lines[i]) + 1 + len(lines[i + 1].split(" ", 1)[0]) <= width
        start = lines[i + 1][:1].isupper() or lines[i + 1][:1].isdigit()
        strong = 2.0 * stop + 1.0 * fits + 0.5 * start + 2.0 * gaps[i + 1]
        end.append(3.0 + (not stop) * 2.0 + (not start) * 2.0)
        on.append(strong)
    best, came = [math.inf] * n + [0.0], [0] * n  # best[i]: a paragraph begins at line i
    for i in range(n - 1, -1, -1):
        run = 0.0
        for j in range(i, n):
            if j > i:
                run += on[j - 1]
            if run >= best[i]:  # no cost is below 0
                break
            c = run + (end[j] if j < n - 1 else 0.0) + (1.0 if i == j and len(lines[i]) < width / 3 else 0.0) + best[j + 1]
            if c < best[i]:
                best[i], came[i] = c, j
    out, i = set(), 0
    while i < n:
        i = came[i] + 1
        out.add(i - 1)
    return out - {n - 1}


def lexicon(captions: DataFrame, column: str = "caption_raw") -> tuple[dict[str, int], int]:
    """Counts of the words that make up at least RARE of all words of distinct captions, and the number of all words.

    At most 1 / RARE entries are gathered.
    """
    texts = captions.select(F.col(column).alias("t")).filter("t IS NOT NULL").distinct()
    joined = F.regexp_replace("t", r"(\p{L})[-\u2010\u2011¬\u00ad][ \t]*(?:\r\n|[\n\r\u0085\u2028\u2029])[ \t]*(?=\p{Ll})", "$1")
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(joined), F.lit(r"\p{L}+(?:['’-]\p{L}+)*"), F.lit(0))).alias("w"))
    counts = words.groupBy("w").agg(F.count("*").alias("n")).persist()
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    rows = counts.filter((F.col("n") >= RARE * total) & (F.col("n") >= 2)).collect()
    counts.unpersist()
    return {r["w"]: r["n"] for r in rows}, total


def running_headers(records: DataFrame, key: str, column: str) -> DataFrame:
    """(key, headers): hashes of the lines of each record that repeat as running headers over the pages of its paper.

    Lines are counted by the hash of paper and line, pre-aggregated by page, so
    a paper with many records is spread over its lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, g, line_hash(p, k), i) for r, p, g, t in zip(b[key], b["paper"], b["page"], b["t"], strict=True) for k, i in places(t)]
            yield pd.DataFrame(rows, columns=[key, "page", "line", "interrupts"])

    many = records.filter(F.col("paper").isNotNull() & F.col("page").isNotNull() & F.col(column).rlike("[\n\r\u0085\u2028\u2029]"))
    lines = many.select(key, F.col("paper").cast("string"), F.xxhash64("page").alias("page"), F.col(column).alias("t"))
    lines = spread(lines).mapInPandas(run, f"{key} long, page long, line long, interrupts boolean")
    lines = SharedTables(records.sparkSession, "ocr").save(lines, "lines")
    heads = (
        lines.groupBy("line", "page")
        .agg(F.count("*").alias("n"), F.count_if("interrupts").alias("m"))
        .groupBy("line")
        .agg(F.count("*").alias("pages"), F.sum("n").alias("n"), F.sum("m").alias("m"))
        .filter((F.col("pages") >= PAGES) & (F.col("m") >= INTERRUPTS * F.col("n")))
    )
    return lines.join(heads.select("line"), "line", "left_semi").groupBy(key).agg(F.collect_set("line").alias("headers"))


def repair(records: DataFrame, key: str = "rec_id", column: str = "caption_raw") -> DataFrame:
    """(key, text, kinds) of each record with a caption.

    ``text`` is the repaired text, paragraphs divided by a line feed; ``kinds``
    the kinds of noise met (hyphen_break, char_error, running_header,
    page_number), empty for a clean caption. An empty or blank caption gives an
    empty text; a null one no row. Repeated rows are repaired alike. Without
    columns ``paper`` and ``page``, or where they are null, running headers are
    known by their form only.
    """
    words, total = lexicon(records, column)
    shared = records.sparkSession.sparkContext.broadcast((words, total))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = Decoder(*shared.value)
        for b in batches:
            got = [decoder.caption(t, None if h is None else lambda k, p=p, h=frozenset(h): line_hash(p, k) in h) for t, p, h in zip(b["t"], b["paper"], b["headers"], strict=True)]
            yield pd.DataFrame({key: b[key], "text": [g[0] for g in got], "kinds": [sorted(g[1]) for g in got]})

    paged = {"paper", "page"} <= set(records.columns)
    rows = records.select(key, F.col(column).alias("t"), (F.col("paper") if paged else F.lit(None)).cast("string").alias("paper")).filter("t IS NOT NULL")
    if paged:
        rows = rows.join(running_headers(records, key, column), key, "left").select(key, "t", "paper", "headers")
    else:
        rows = rows.withColumn("headers", F.lit(None).cast("array<long>"))
    return spread(rows).mapInPandas(run, f"{key} long, text string, kinds array<string>")


def noise(records: DataFrame) -> DataFrame:
    """(rec_id, kind): one row for each kind of noise in a caption."""
    return repair(records).select("rec_id", F.explode("kinds").alias("kind"))
