"""Evaluation passages that occur, wholly or partly, in training texts.

A document contains a passage if at least ``words`` consecutive words of it occur in the
document's speech, apart from case, accents, punctuation, encodings, recognition errors,
markup and what subtitle files put in between (:mod:`plumbline.llm.subtitles`), with an edit
budget: up to ``edits`` letters of the words may be wrong, missing or too many, one in a word of
four and more letters and none in shorter ones; a lost letter of the document costs one edit
wherever it is. Words may be split or joined. A window of words too short for the filter below
has a smaller budget, ``(letters - Q) // Q``. Accented letters that a document has lost cost
nothing where it has lost all of them.

Filter by the q-gram lemma: two strings of ``m`` letters within ``e`` edits share at least
``m - q + 1 - q * e`` q-grams, on diagonals that differ by no more than ``e``. The letters of
all documents of a batch are one array; q-grams of the passages are looked up in it, places
where too few lie close together are dropped, and the rest is counted per passage in
overlapping bands of diagonals. Bands with a window of the passage that meets its bound are
regions, in which a banded alignment (:func:`aligned`) settles the window. The bound is that of
the budget, so the filter loses nothing that the alignment accepts.

The passages are a stated query set. Up to ``pass_letters`` letters of them are broadcast at
once; beyond, the cleaned documents are written once and read once for each such part. A task
indexes ``block_letters`` letters at a time. Any number of passages is served, and every text is
cleaned once.

Defined results: null and empty texts and passages, and passages with fewer words, give no
row; equal passages under two ids are two items; a pair is reported once; equal doc ids are
one document; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.subtitles import LOST, folded_words, spoken
from plumbline.operators.written import written

WORDS, Q, EDITS = 12, 7, 4
BLOCK_LETTERS, PASS_LETTERS = 400_000, 16_000_000
BAND = 32
FOUND, CLEANED = "doc_id bigint, item_id string", "doc_id bigint, words string"
_BITS = 22
_CODE = np.zeros(128, np.uint8)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz*", 1):
    _CODE[ord(_c)] = _k
for _c in "0123456789":
    _CODE[ord(_c)] = 28 + int(_c) % 4


def letter_codes(letters: str) -> np.ndarray:
    """Five bits per letter, 0 for none; what falls together is told apart on verifying."""
    if letters.isascii():
        return _CODE[np.frombuffer(letters.encode("ascii"), np.uint8)]
    u = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(u < 128, _CODE[np.minimum(u, 127)], 1 + u % 31).astype(np.uint8)


def qgrams(codes: np.ndarray) -> np.ndarray:
    """The key of the Q letters from each place on."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = codes[:n].astype(np.int64)
    for k in range(1, Q):
        h = (h << 5) | codes[k : k + n]
    return h


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def budget(letters: int, edits: int = EDITS) -> int:
    """Edits that a window of so many letters bears."""
    return max(0, min(edits, (letters - Q) // Q))


def bound(letters: int, edits: int = EDITS) -> int:
    """Q-grams that a window shares with any text within its budget."""
    return max(1, letters - Q + 1 - Q * budget(letters, edits))


class Passage:
    """A passage of the index, with its windows of so many words."""

    def __init__(self, item: str, words: list[str], size: int, edits: int = EDITS) -> None:
        self.item, self.words = item, words
        starts = np.cumsum([0, *map(len, words)])
        self.letters = int(starts[-1])
        letters = (starts[size:] - starts[:-size]).tolist()
        #: first place of a window, last place of a q-gram in it, q-grams it needs, its budget
        self.first = starts[: len(letters)]
        self.last = self.first + np.array(letters, int) - Q
        self.bounds = np.array([bound(m, edits) for m in letters], int)
        self.spare = [budget(m, edits) for m in letters]
        self.least = int(self.bounds.min()) if letters else 0
        self.span = max(letters, default=0) - Q


@dataclass
class PassageIndex:
    passages: list[Passage]
    least: np.ndarray  # shared q-grams that a region of each passage needs
    span: np.ndarray  # within so many letters
    keys: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # their ranges in item and place
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # which slots of the keys' hash are taken

    @classmethod
    def of(cls, passages: list[Passage]) -> "PassageIndex":
        keys, item, place = [], [], []
        for k, p in enumerate(passages):
            g = qgrams(letter_codes("".join(p.words)))
            keys.append(g), item.append(np.full(len(g), k)), place.append(np.arange(len(g)))
        keys, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, item, place))
        order = np.argsort(keys, kind="stable")
        distinct, first = np.unique(keys[order], return_index=True)
        seen = np.zeros(1 << _BITS, bool)
        seen[_slot(distinct)] = True
        return cls(passages, np.array([p.least for p in passages], int), np.array([p.span for p in passages], int), distinct, np.r_[first, len(keys)], item[order], place[order], seen)

    @property
    def longest(self) -> int:
        return max(p.letters for p in self.passages)


def _word_ends(doc: str, at: int, word: str, spare: int) -> Iterator[tuple[int, int]]:
    """Where a word that begins at letter ``at`` of the document may end, and what it costs."""
    n = len(word)
    if doc.startswith(word, at):
        yield at + n, 0
        if n >= 4 and spare and at + n < len(doc):
            yield at + n + 1, 1
        return
    part = doc[at : at + n]
    if len(part) == n:
        differ = [k for k in range(n) if part[k] != word[k]]
        lost = sum(part[k] == "*" for k in differ)
        if len(differ) <= spare and len(differ) - lost <= (1 if n >= 4 else 0):
            yield at + n, len(differ)
    if n < 4 or not spare:
        return
    k = next((k for k in range(len(part)) if part[k] != word[k]), len(part))
    if doc.startswith(word[k + 1 :], at + k) and at + n - 1 <= len(doc):
        yield at + n - 1, 1
    if doc.startswith(word[k:], at + k + 1):
        yield at + n + 1, 1


def aligned(doc: str, breaks: set[int], starts: list[int], words: list[str], spare: int) -> bool:
    """Banded alignment: whether the words stand in the document from one of the starts on, up
    to a break between words. Letter by letter within a word; from word to word the places stay
    in a band as wide as the budget, each with the least cost that reaches it."""
    reached = dict.fromkeys(starts, 0)
    for word in words:
        step: dict[int, int] = {}
        for at, cost in reached.items():
            for end, more in _word_ends(doc, at, word, spare - cost):
                total = cost + more
                if total <= spare and total < step.get(end, spare + 1):
                    step[end] = total
        if not step:
            return False
        reached = step
    return any(end in breaks for end in reached)


def contains(doc: list[str], passage: list[str], words: int, edits: int = EDITS) -> bool:
    """The definition, without a filter: each window at each place."""
    letters = "".join(doc)
    breaks = np.cumsum([0, *map(len, doc)]).tolist()
    spare = Passage("", passage, words, edits).spare
    return any(aligned(letters, set(breaks), breaks[:-1], passage[r : r + words], n) for r, n in enumerate(spare))


def leaks(ids: list, texts: list[list[str]], index: PassageIndex, words: int, edits: int = EDITS) -> list[tuple]:
    """(doc id, item id) of a batch of documents, given by their folded words."""
    letters = ["".join(w) for w in texts]
    codes = letter_codes("\x00".join(letters) + "\x00" * Q)
    start = np.cumsum([0, *(len(x) + 1 for x in letters)])
    if not len(index.keys):
        return []
    keys = qgrams(codes)
    p = np.flatnonzero(index.seen[_slot(keys)])
    k = np.searchsorted(index.keys, keys[p])
    k[k == len(index.keys)] = 0
    ok = index.keys[k] == keys[p]
    p, k = p[ok], k[ok]
    if not len(p):
        return []
    # in some stretch as long as the longest window there must be enough of these places
    reach = np.searchsorted(p, p + int(index.span.max()) + edits, "right")
    enough = reach - np.arange(len(p)) >= index.least.min()
    cover = np.zeros(len(p) + 1, int)
    np.add.at(cover, np.flatnonzero(enough), 1)
    np.add.at(cover, reach[enough], -1)
    keep = np.cumsum(cover[:-1]) > 0
    p, k = p[keep], k[keep]
    times = index.first[k + 1] - index.first[k]
    total = int(times.sum())
    if not total:
        return []
    post = np.repeat(index.first[k] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(total)
    item, place = index.item[post], index.place[post]
    doc = np.searchsorted(start, p, "right") - 1
    at = np.repeat(p - start[doc], times)
    pair = np.repeat(doc, times) * len(index.passages) + item
    some = np.bincount(pair, minlength=len(ids) * len(index.passages))
    keep = np.flatnonzero(some[pair] >= index.least[item])
    pair, place, at = pair[keep], place[keep], at[keep]
    longest = index.longest
    diagonal = at - place + longest
    bands = int(max(map(len, letters)) + longest) // BAND + 2
    out: set[tuple] = set()
    breaks: dict[int, tuple[list[int], set[int]]] = {}
    for shift in (0, BAND // 2):
        region = pair * bands + (diagonal + shift) // BAND
        order = np.argsort(region * longest + place)
        ordered, along = region[order], place[order]
        # so many q-grams of one region as a window needs, within the letters of a window
        of = ordered // bands % len(index.passages)
        last = np.arange(len(order)) + index.least[of] - 1
        inside = np.flatnonzero(last < len(order))
        last = last[inside]
        dense = inside[(ordered[last] == ordered[inside]) & (along[last] - along[inside] <= index.span[of[inside]])]
        found = np.unique(ordered[dense])
        if shift:
            # bands whose q-grams lie in one band of the first round have been looked at
            a, b = np.searchsorted(ordered, found), np.searchsorted(ordered, found, "right")
            band = diagonal[order] // BAND
            edges = np.c_[a, b].ravel()
            if len(edges) and edges[-1] == len(band):
                band = np.r_[band, band[-1]]
            new = (np.minimum.reduceat(band, edges)[::2] != np.maximum.reduceat(band, edges)[::2]) if len(edges) else np.zeros(0, bool)
            found = found[new]
        for found in found.tolist():
            d, i = divmod(found // bands, len(index.passages))
            passage = index.passages[i]
            if (ids[d], passage.item) in out:
                continue
            a, b = np.searchsorted(ordered, [found, found + 1])
            if d not in breaks:
                line = np.cumsum([0, *map(len, texts[d])]).tolist()
                breaks[d] = line, set(line)
            if _region(letters[d], *breaks[d], passage, at[order[a:b]], along[a:b], words, edits):
                out.add((ids[d], passage.item))
    return sorted(out)


def _region(doc: str, line: list[int], breaks: set[int], passage: Passage, at: np.ndarray, place: np.ndarray, words: int, edits: int) -> bool:
    """Whether a window of the passage that meets its bound with these q-grams stands there;
    they are in order of their place in the passage."""
    low, high = np.searchsorted(place, passage.first), np.searchsorted(place, passage.last, "right")
    diagonal = at - place
    for r in np.flatnonzero(high - low >= passage.bounds).tolist():
        own = diagonal[low[r] : high[r]]
        first = int(passage.first[r])
        k, j = bisect_left(line, first + int(own.min()) - edits), bisect_right(line, first + int(own.max()) + edits)
        if aligned(doc, breaks, line[k:j], passage.words[r : r + words], passage.spare[r]):
            return True
    return False


def _spellings(passage: str) -> list[list[str]]:
    """Words of a passage, and of the same with its accented letters lost."""
    lost = "".join(LOST if c.isalpha() and ord(c) > 127 else c for c in passage)
    return [folded_words(t) for t in dict.fromkeys((passage, lost))]


def _indexed(passages: list[tuple[str, str]], words: int, edits: int, letters: int) -> Iterator[PassageIndex]:
    """The passages, so many letters at a time."""
    block: list[Passage] = []
    size = 0
    for item, text in passages:
        for w in _spellings(text):
            p = Passage(item, w, words, edits)
            if len(w) < words or p.letters < Q:
                continue
            if block and size + p.letters > letters:
                yield PassageIndex.of(block)
                block, size = [], 0
            block.append(p)
            size += p.letters
    if block:
        yield PassageIndex.of(block)


def _parts(items: DataFrame, letters: int) -> Iterator[list[tuple[str, str]]]:
    """The passages, so many letters of them at a time; no more are held by the driver."""
    part: list[tuple[str, str]] = []
    size = 0
    for row in items.select("item_id", "passage").where("item_id is not null and passage <> ''").distinct().toLocalIterator():
        if part and size + len(row["passage"]) > letters:
            yield part
            part, size = [], 0
        part.append((row["item_id"], row["passage"]))
        size += len(row["passage"])
    if part:
        yield part


def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The folded words of each text's speech."""
    for b in batches:
        yield pa.record_batch({"doc_id": b.column("doc_id"), "words": pa.array([" ".join(folded_words(spoken(t))) for t in b.column("text").to_pylist()], pa.string())})


def leaked_passages(
    documents: DataFrame, items: DataFrame, words: int = WORDS, edits: int = EDITS, block_letters: int = BLOCK_LETTERS, pass_letters: int = PASS_LETTERS,
) -> DataFrame:
    """``(doc_id, item_id)``: documents and the passages that leaked into them."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("doc_id is not null and text <> ''")
    known: list = []

    def lookup(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            small = sum(len(t) for _, t in shared.value) * 2 <= block_letters
            kept = list(_indexed(shared.value, words, edits, block_letters)) if small else None
            for batch in batches:
                for part in (batch.slice(k, 500) for k in range(0, len(batch), 500)):
                    texts = [w.split() for w in part.column("words").to_pylist()] if "words" in part.schema.names else [folded_words(spoken(t)) for t in part.column("text").to_pylist()]
                    ids = part.column("doc_id").to_pylist()
                    got = sorted({g for index in (kept if small else _indexed(shared.value, words, edits, block_letters)) for g in leaks(ids, texts, index, words, edits)})
                    yield pa.record_batch({"doc_id": pa.array([g[0] for g in got], pa.int64()), "item_id": pa.array([g[1] for g in got], pa.string())})

        return run

    found = None
    for part in _parts(items, pass_letters):
        known.append(spark.sparkContext.broadcast(part))
        if len(known) == 2:  # more than one pass: clean once
            docs = written(docs.mapInArrow(cleaned, CLEANED))
            found = docs.mapInArrow(lookup(known[0]), FOUND)
        rows = docs.mapInArrow(lookup(known[-1]), FOUND)
        found = rows if found is None else found.unionByName(rows)
    return (spark.createDataFrame([], FOUND) if found is None else found).distinct()


def leak_counts(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Per passage, the number of documents that contain it."""
    return leaked_passages(documents, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
