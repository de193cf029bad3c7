"""Texts that lack the end of their file.

Evidence, all from the whole corpus:

* length: a source that cuts at a field limit piles up texts of one length, in characters or
  in UTF-8 bytes, far above the number of texts of about that length;
* form: the text ends in a cue's number or times, in an opened bracket or tag;
* vocabulary: its last token is an unknown proper prefix of known words. The vocabulary is a
  trie kept as a table, one row per node with the count of its best word, and joined to the
  last tokens; a token is unknown if it is rare against the words that it begins. A second
  trie holds the words by the word before them: there a prefix that is a word elsewhere
  ("the a") is unknown too;
* phrase: its last token and the one before occur often, but next to never at the end of a
  cue, so the cue was cut between words.

Equal texts are equally truncated, so what one copy shows holds for all.

Defined results: null and empty texts are not truncated and are no rows of the report's
``texts``; white space at the end is no part of a text; a null source is a source of its own
in the report; equal doc ids are judged by each of their texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.subtitles import LOST, lines_unified, plain, repaired
from plumbline.operators.written import written

#: A pile holds at least so many texts, and so many times what the lengths around it hold.
PILE_TEXTS, PILE_TIMES, AROUND = 8, 12.0, 0.15
#: and at least this share of it shows by its form or last words that something is missing.
PILE_SHOWN = 0.3
#: A prefix is unknown if its count is at most this share of its best word's, which in turn
#: occurs at least so often.
RARE, KNOWN = 0.02, 4
#: A phrase needs this many occurrences to say something, and ends cues at most this often.
PHRASES, ENDS = 12, 0.004
#: Letters down to which the tries have a row for each node.
DEPTH = 40
CUE = "\x1e"
PARTS = "kind string, doc_id bigint, w1 string, w2 string, seen bigint, ends bigint, source string, chars bigint, bytes bigint, hash bigint, form boolean, lost boolean, open boolean"

_CUES = re.compile(r"(?:^|\n)[ \t]*(?:\d+[ \t]*\n[ \t]*)?[^\n]*-->[^\n]*(?:\n|$)")
_TAG = re.compile(r"<[^<>\n]*>|\{[^{}\n]*\}")
_TOKEN = re.compile(r"(?:[^\W_]|\*)+(?:'[^\W_]+)*'?|\x1e")
_TIMES_END = re.compile(r"(?:^|\n)[ \t]*\d{1,3}:[\d:.,]*(?:[ \t]*-{0,2}>?[ \t]*[\d:.,]*)?$|-->[ \t]*[\d:.,]*$")
_NUMBER_END = re.compile(r"\n[ \t]*\n[ \t]*\d+(?:\n[ \t]*[\d:.,]*)?$")
_OPENERS = re.compile(r"(?:[\[({<¿¡“«]|</?\w{0,6}|(?:^|\n)[ \t]*-)$")
_DOTS = re.compile(r"[ \t]*(?:…|\.{3})$")
_CLOSERS = ".?!…)]}>♪=\"”»:;"
_BLANK = "\ufeff \t\n\v\f\r\x00\xa0"


def ends_in_form(text: str) -> bool:
    """Whether the form of the last lines shows that something is missing. An open tag only
    does in a text whose other cues close theirs."""
    tail = text[-600:]
    if _TIMES_END.search(tail) or _NUMBER_END.search(tail) or _OPENERS.search(tail):
        return True
    at = text.rfind("\n\n") + 2 if "\n\n" in text else 0
    cue, before = text[at:], text[:at]
    for a, b in ("()", "[]", "{}"):
        if cue.rfind(a) > cue.rfind(b):
            return True
    if cue.rfind("<") > cue.rfind(">"):
        return True
    for x in ("i>", "b>", "u>", "font"):
        if cue.count(f"<{x}") > cue.count(f"</{x}") and before.count(f"<{x}") == before.count(f"</{x}") and (x != "font" or f"<{x}" in before):
            return True
    return False


def tokens(text: str) -> list[str]:
    """Words without accents and case, ``0`` for a number, and ``CUE`` between cues."""
    t = plain(_TAG.sub("", _CUES.sub("\n\x1e\n", text)).replace("’", "'"))
    return ["0" if w.isdigit() else w for w in _TOKEN.findall(t)]


def read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrase counts of each batch, and one row with the ending of each text."""
    schema = pa.schema([(n, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (c.split() for c in PARTS.split(", "))])
    for batch in batches:
        seen: Counter = Counter()
        ends: Counter = Counter()
        rows: list[tuple] = []
        for doc, source, text, hashed in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "text", "hash")), strict=True):
            body = lines_unified(text).rstrip(_BLANK)
            if not body:
                continue
            if not body.isascii():
                body = repaired(body)
            # dots may be a speaker's or stand for what a field limit took
            body = _DOTS.sub("", body) or body
            words = [CUE, *tokens(body)]
            # the last phrase is what is asked about, so it is not counted as evidence
            seen.update(zip(words[:-2], words[1:-1], strict=True))
            ends.update((words[k - 2], words[k - 1]) for k in range(2, len(words)) if words[k] == CUE)
            w1, w2 = words[-2:] if len(words) > 1 else (CUE, CUE)
            rows.append(("end", doc, w1, w2, None, None, source, len(text), len(text.encode("utf-8", "surrogatepass")), hashed, ends_in_form(body), body.endswith(LOST), body[-1] not in _CLOSERS))
        for phrase, n in seen.items():
            rows.append(("phrase", None, *phrase, n, ends.get(phrase, 0), None, None, None, None, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def vocabulary(phrases: DataFrame) -> DataFrame:
    """``(word, count)`` of the words of the corpus."""
    return phrases.where(~F.col("w2").isin(CUE, "0")).groupBy(F.col("w2").alias("word")).agg(F.sum("seen").alias("count"))


def _best_word(asked: DataFrame, words: DataFrame, keys: list[str], word: str, count: str, name: str) -> DataFrame:
    """Adds ``name`` to ``asked`` (``keys`` and ``w2``): the count of the most frequent word
    (after the same keys) that ``w2`` begins. The trie is a table with one row per node down to
    DEPTH letters; longer tokens are compared with the words below the node at that depth."""
    known = words.where((F.col(count) >= KNOWN) & (F.length(word) > 1)).select(*keys, F.col(word).alias("_word"), F.col(count).alias("_n"))
    depth = F.least(F.length("_word") - 1, F.lit(DEPTH))
    node = F.explode(F.transform(F.sequence(F.lit(1), depth), lambda n: F.substring("_word", 1, n))).alias("w2")
    trie = known.select(*keys, node, "_n").groupBy(*keys, "w2").agg(F.max("_n").alias("_near"))
    at = [F.substring("w2", 1, DEPTH).alias("_node"), "w2"]
    long = asked.where(F.length("w2") > DEPTH).select(*keys, *at).distinct()
    below = known.where(F.length("_word") > DEPTH + 1).withColumn("_node", F.substring("_word", 1, DEPTH))
    deep = long.join(below, [*keys, "_node"]).where(F.startswith("_word", F.col("w2")) & (F.col("_word") != F.col("w2"))).groupBy(*keys, "w2").agg(F.max("_n").alias("_far"))
    out = asked.join(trie, [*keys, "w2"], "left").join(deep, [*keys, "w2"], "left")
    return out.withColumn(name, F.when(F.length("w2") > DEPTH, F.col("_far")).otherwise(F.col("_near"))).drop("_near", "_far")


def piles(ends: DataFrame) -> DataFrame:
    """``(source, unit, size)``: the lengths at which a source cuts. A pile stands out from
    the lengths below it, little lies above it, and its texts end in the middle (``shown``)
    far more often than files that just happen to be equally long."""
    each = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))
    counts = ends.select("source", "shown", F.explode(each).alias("x")).groupBy("source", "x.unit", "x.size").agg(F.count(F.lit(1)).alias("n"), F.count_if("shown").alias("shown"))
    counts = counts.withColumn("log", F.floor(F.log(F.col("size").cast("double")) * 10_000))
    near = Window.partitionBy("source", "unit").orderBy("log")
    below = F.coalesce(F.sum("n").over(near.rangeBetween(-int(AROUND * 10_000), -1)), F.lit(0))
    above = F.coalesce(F.sum("n").over(near.rangeBetween(1, int(AROUND * 10_000))), F.lit(0))
    usual = below / (F.col("size") * AROUND)
    counts = counts.withColumns({"usual": usual, "above": above})
    return counts.where((F.col("shown") >= PILE_SHOWN * F.col("n")) & (F.col("n") >= PILE_TEXTS) & (F.col("n") >= PILE_TIMES * F.col("usual")) & (F.col("n") >= 3 * F.col("above"))).select("source", "unit", "size")


def truncated_texts(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, truncated)`` for every text that is not empty."""
    rows = documents.select("doc_id", "source", "text", F.xxhash64("text").alias("hash")).where("doc_id is not null and text <> ''")
    # phrases and endings come from one pass over the texts; a few bytes of it are written
    parts = written(rows.mapInArrow(read_parts, PARTS))
    # so are their sums, which four branches use
    phrases = written(parts.where("kind = 'phrase'").groupBy("w1", "w2").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends")))
    ends = parts.where("kind = 'end'").select("doc_id", "source", "w1", "w2", "chars", "bytes", "hash", "form", "lost", "open")
    words = vocabulary(phrases)

    asked = ends.where("open").select("w1", "w2").distinct()
    asked = asked.join(phrases, ["w1", "w2"], "left").join(words.select(F.col("word").alias("w2"), "count"), "w2", "left")
    asked = _best_word(asked, words, [], "word", "count", "best")
    asked = _best_word(asked, phrases, ["w1"], "w2", "seen", "best_after")
    prefix = (F.coalesce("count", F.lit(0)) <= F.col("best") * RARE) | (F.coalesce("seen", F.lit(0)) <= F.col("best_after") * RARE)
    phrase = (F.col("seen") >= PHRASES) & (F.col("ends") <= F.col("seen") * ENDS)
    cut = asked.where(F.coalesce(prefix, F.lit(False)) | F.coalesce(phrase, F.lit(False))).select("w1", "w2", F.lit(True).alias("cut"))
    ends = ends.join(cut, ["w1", "w2"], "left").withColumn("cut", F.coalesce(F.col("cut") & F.col("open"), F.lit(False)))
    ends = ends.withColumn("shown", F.col("form") | F.col("cut"))

    # some sources times two units; a handful of lengths each
    found = piles(ends).groupBy("source", "unit").agg(F.collect_set("size").alias("sizes"))
    for unit in ("chars", "bytes"):
        at = found.where(F.col("unit") == unit).select(F.col("source").alias("_s"), F.col("sizes").alias(f"{unit}_limits"))
        ends = ends.join(at, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")

    def at_limit(unit: str) -> Column:
        # white space or half a character at the cut may have gone, or become a lost one
        over = F.when(F.col("lost"), 2).otherwise(0)
        return F.coalesce(F.exists(f"{unit}_limits", lambda x: (F.col(unit) >= x - 3) & (F.col(unit) <= x + over)), F.lit(False))

    ends = ends.withColumn("limit", at_limit("chars") | at_limit("bytes")).drop("chars_limits", "bytes_limits")
    own = F.col("shown") | F.col("limit")
    ends = ends.select("doc_id", "source", "hash", own.alias("own"), "limit")
    copies = ends.where("limit").select("hash").distinct().withColumn("copy", F.lit(True))
    return ends.join(copies, "hash", "left").select("doc_id", "source", (F.col("own") | F.coalesce("copy", F.lit(False))).alias("truncated"))


def truncation_report(documents: DataFrame) -> DataFrame:
    """``(source, texts, truncated, share)``: how often each source truncates."""
    per = truncated_texts(documents).groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("truncated"))
    return per.withColumn("share", F.col("truncated") / F.col("texts"))
