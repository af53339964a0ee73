"""Evaluation texts that leak into training text.

The test items get a BM25 inverted index whose terms are pairs of neighbouring
words: per term a list of postings (item, impact) in the order of items, cut
into blocks that know their largest impact. Impacts are divided by the item's
threshold, the least score that a passage can have which holds RUN of its words
in a row with LOST of them altered, so that one threshold, 1, holds for all
items and no case is lost. Every passage of every document (PASSAGE words, each
STRIDE) is a query: block-max WAND moves through the lists of its terms from
pivot to pivot, skips blocks whose maxima stay below 1, and retrieves all items
that reach it. Retrieved items are verified by aligning the words, and it is
seen whether the item's answer stands in the document as well.

Items are a stated query set. They are indexed in groups of about GROUP_CHARS
characters, so what goes to the driver and the executors is bounded; each group
passes over all documents.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.runtime import spread

GROUP_CHARS, BLOCK = 8_000_000, 8
#: A passage holds any stretch of 30 words with three of them divided, wherever it begins.
PASSAGE, STRIDE = 48, 14
#: At least RUN words in a row, at most one in ALTERED altered.
RUN, ALTERED = 20, 10
#: Any such stretch holds 20 words with two altered or 30 with three (words, altered).
STRETCHES = ((20, 2), (30, 3))
#: Words in a term.
TERM = 4
K1, B = 1.2, 0.75

_TAGS = re.compile(r"</?[A-Za-z!][^<>]{0,200}>|&[A-Za-z]{2,8};|&#\d{1,6};")
_LINKS = re.compile(r"\]\((?:https?:|/|#|mailto:)[^()\s]*\)")
_BREAKS = re.compile(
    r"(?<=\w)(?:[-\u2010\u2011\u00ac][^\S\n\r]*(?:\r\n|[\n\r\u0085\u2028\u2029])[\s>|*#]*"
    r"|[\u00ad\u200b-\u200d\u2060\ufeff]\s*(?:\r\n|[\n\r\u0085\u2028\u2029])?[^\S\n\r]*)(?=\w)"
)
#: What every match of _BREAKS begins with.
_MARKS = re.compile(r"[-\u2010\u2011\u00ac][^\S\n\r]*[\n\r\u0085\u2028\u2029]|[\u00ad\u200b-\u200d\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words without case, punctuation, spacing, markup, and line ends with their marks."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _TAGS.sub(" ", text)
    if "](" in text:
        text = _LINKS.sub(" ", text)
    if _MARKS.search(text):
        text = _BREAKS.sub("", text)
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).casefold())


class Index:
    """Postings of BM25 impacts over one group of items, in blocks with their maxima."""

    def __init__(self, items: list[tuple]):
        """``items``: (item_id, words) or (item_id, words, words of the answer)."""
        self.items = items
        self.words: dict[str, int] = {}
        texts = [np.array([self.words.setdefault(w, len(self.words) + 1) for w in ws], dtype=np.int64) for _, ws, *_ in items]
        self.base = len(self.words) + 1
        self.pairs = np.unique(np.concatenate([np.zeros(0, dtype=np.int64)] + [t[:-1] * self.base + t[1:] for t in texts]))
        runs = [self._codes(t).tolist() for t in texts]
        df = Counter(t for ts in runs for t in set(ts))
        n, mean = len(items), (sum(map(len, runs)) / max(len(items), 1)) or 1
        lists: dict[int, list[tuple[int, float]]] = {}
        for k, ts in enumerate(runs):
            tf = Counter(ts)
            imp = {t: float(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5))) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ts) / mean)) for t, f in tf.items()}
            least = float("inf")
            for m, lost in STRETCHES:
                for i in range(len(ts) - m + TERM):
                    own = sorted(imp[t] for t in set(ts[i : i + m - TERM + 1]))
                    # an altered word takes TERM terms along; where terms repeat, one is left at least
                    least = min(least, max(sum(own[: -lost * TERM]), own[0]))
            for t, x in imp.items():
                lists.setdefault(t, []).append((k, x / least))
        self.terms = np.array(sorted(lists), dtype=np.int64)
        self.docs = [[k for k, _ in lists[t]] for t in self.terms.tolist()]
        self.imps = [[x for _, x in lists[t]] for t in self.terms.tolist()]
        self.tops = [[max(xs[i : i + BLOCK]) for i in range(0, len(xs), BLOCK)] for xs in self.imps]
        self.top = np.array([max(xs) for xs in self.tops])

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """A number for each run of TERM words, made of its two pairs; -1 if the index has no such pair."""
        pair = ids[:-1] * self.base + ids[1:]
        at = self.pairs.searchsorted(pair)
        at[at == len(self.pairs)] = 0
        known = self.pairs[at] == pair if len(self.pairs) else at < 0
        return np.where(known[:-2] & known[2:], at[:-2] * len(self.pairs) + at[2:], -1)

    def wand(self, terms: list[int]) -> list[int]:
        """All items whose impacts over the distinct ``terms`` (rows of the index) sum up to 1 or more, by block-max WAND."""
        out: list[int] = []
        at = [[self.docs[t][0], 0, t] for t in terms]  # current item, its place in the list, the list
        top = self.top
        while at:
            at.sort()
            bound, p = 0.0, -1
            for i, c in enumerate(at):
                bound += top[c[2]]
                if bound >= 0.9999:
                    p = i
                    break
            if p < 0:
                break
            pivot = at[p][0]
            while p + 1 < len(at) and at[p + 1][0] == pivot:
                p += 1
            # the blocks that would hold the pivot
            inside, until = 0.0, at[p + 1][0] if p + 1 < len(at) else len(self.items)
            for c in at[: p + 1]:
                docs = self.docs[c[2]]
                i = bisect_left(docs, pivot, c[1])
                if i < len(docs):
                    b = i // BLOCK
                    inside += self.tops[c[2]][b]
                    end = (b + 1) * BLOCK
                    until = min(until, docs[end] if end < len(docs) else len(self.items))
            if inside < 0.9999:
                target = max(until, pivot + 1)
            elif at[0][0] == pivot:
                if sum(self.imps[c[2]][c[1]] for c in at[: p + 1]) >= 0.9999:
                    out.append(pivot)
                target = pivot + 1
            else:
                target = pivot
            for c in at[: p + 1]:
                docs = self.docs[c[2]]
                if c[0] < target:
                    c[1] = bisect_left(docs, target, c[1])
                    c[0] = docs[c[1]] if c[1] < len(docs) else -1
            if any(c[0] < 0 for c in at[: p + 1]):
                at = [c for c in at if c[0] >= 0]
        return out

    def retrieve(self, ws: list[str]) -> dict[int, tuple[int, int]]:
        """Of each item with a passage that reaches its threshold, the span of words of such passages."""
        found: dict[int, tuple[int, int]] = {}
        if len(ws) < RUN - 2 or not len(self.terms):
            return found
        get = self.words.get
        ids = np.fromiter((get(w, 0) for w in ws), dtype=np.int64, count=len(ws))
        codes = self._codes(ids)
        row = self.terms.searchsorted(codes)
        row[row == len(self.terms)] = 0
        hit = self.terms[row] == codes
        starts = np.arange(0, max(len(ws) - (PASSAGE - STRIDE), 1), STRIDE)
        ends = np.minimum(starts + PASSAGE, len(ws)) - TERM + 1
        bound = np.concatenate(([0.0], np.cumsum(np.where(hit, self.top[row], 0.0))))
        for p in np.nonzero(bound[ends] - bound[starts] >= 0.999)[0]:
            lo, hi = int(starts[p]), int(ends[p])
            part = row[lo:hi][hit[lo:hi]]
            for k in self.wand(list(dict.fromkeys(part.tolist()))):
                a, b = found.get(k, (1 << 60, 0))
                found[k] = (min(a, lo), max(b, hi + TERM - 1))
        return found

    def leaks(self, text: str | None) -> list[tuple[int, bool]]:
        """(item_id, whether its answer stands in the text too) of the items that the text holds."""
        ws = words(text)
        out = []
        for k, (lo, hi) in sorted(self.retrieve(ws).items()):
            item_id, item, *answer = self.items[k]
            if holds(item, ws[max(lo - PASSAGE, 0) : hi + PASSAGE]):
                out.append((item_id, bool(answer and answer[0]) and f" {' '.join(answer[0])} " in f" {' '.join(ws)} "))
        return out


def misspelt(a: str, b: str) -> bool:
    """Whether ``a`` is ``b``, of four letters or more, with one letter changed, left out, added, or two exchanged."""
    if len(b) < 4 or abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def holds(item: list[str], doc: list[str], run: int = RUN, per: int = ALTERED) -> bool:
    """Whether ``doc`` has ``run`` or more words of ``item`` in a row and in order, at most one in ``per`` altered.

    Each match (i, j) keeps, for every number of altered words so far, the
    longest stretch of the item that ends in it. Between two matches, words of
    the item count as altered, as do words of the document beyond two for each.
    A stretch begins and ends with an equal word, or with one that is misspelt
    or divided; a word that was changed altogether isn't known at an end.
    """
    at: dict[str, list[int]] = {}
    for i, w in enumerate(item):
        at.setdefault(w, []).append(i)
    most = max(len(item) // per, 1)
    recent: deque[dict[int, list[int]]] = deque(maxlen=5)  # matches of the last words of the document, latest first
    for j, w in enumerate(doc):
        here: dict[int, list[int]] = {}
        for i in at.get(w, ()):
            best = [1] + [0] * most
            if i and j and (misspelt(doc[j - 1], item[i - 1]) or "".join(doc[max(j - 2, 0) : j]) == item[i - 1]):
                best[1] = 2
            for gj, before in enumerate(recent):
                for gi in range(3):
                    if gj > 2 * gi + 1 or (old := before.get(i - gi - 1)) is None:
                        continue
                    cost = max(gi, gj - gi)
                    for k in range(most + 1 - cost):
                        if old[k] and old[k] + gi + 1 > best[k + cost]:
                            best[k + cost] = old[k] + gi + 1
            here[i] = best
            for k, n in enumerate(best):
                if n >= run and k * per <= n:
                    return True
                if n == run - 1 and (k + 1) * per <= run and i + 1 < len(item) and j + 1 < len(doc):
                    if misspelt(doc[j + 1], item[i + 1]) or "".join(doc[j + 1 : j + 3]) == item[i + 1]:
                        return True
        recent.appendleft(here)
    return False


def find(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, answer): the items whose text leaked into each document, and whether their answer stands there too.

    Null, empty and short texts on either side hold and leak nothing; equal
    items, and rows of one item_id with different texts, are all searched; exact
    copies of a document are judged alike. A null or empty answer stands nowhere.
    """
    answer = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    rows = items.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text", answer.alias("answer")).distinct()
    groups = int((rows.agg(F.sum(F.length("text"))).collect()[0][0] or 0) // GROUP_CHARS) + 1
    rows = rows.withColumn("group", F.pmod(F.xxhash64("item_id", "text", "answer"), F.lit(groups)))
    spark, out, texts = docs.sparkSession, None, spread(docs.select("doc_id", "text"))
    for g in range(groups):
        group = [(r["item_id"], ws, words(r["answer"])) for r in rows.filter(F.col("group") == g).orderBy("item_id", "text", "answer").collect() if len(ws := words(r["text"])) >= RUN]
        index = spark.sparkContext.broadcast(Index(group))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for b in batches:
                hits = [(d, i, a) for d, t in zip(b["doc_id"], b["text"], strict=True) for i, a in index.value.leaks(t)]
                yield pd.DataFrame(hits, columns=["doc_id", "item_id", "answer"]).astype({"doc_id": "int64", "item_id": "int32", "answer": "bool"})

        hits = texts.mapInPandas(search, "doc_id long, item_id int, answer boolean")
        out = hits if out is None else out.union(hits)
    # rows of one item_id may leak into one document more than once
    return out.groupBy("doc_id", "item_id").agg(F.max("answer").alias("answer"))


def report(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, suite, words, docs, with_answer) of each item: in how many documents it stands, in how many with its answer.

    An item of fewer than RUN words can't be found; its ``docs`` is null.
    """
    n = found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("docs"), F.count_if("answer").alias("with_answer"))
    count = F.pandas_udf(lambda t: t.map(lambda x: len(words(x))).astype("int32"), "int")
    sized = items.filter("item_id IS NOT NULL").groupBy("item_id").agg(F.min("suite").alias("suite"), F.max(count("text")).alias("words"))
    shown = lambda c: F.when(F.col("words") >= RUN, F.coalesce(c, F.lit(0))).alias(c)
    return sized.join(n, "item_id", "left").select("item_id", "suite", "words", shown("docs"), shown("with_answer"))
