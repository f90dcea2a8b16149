"""Operator 8: repeated passages by MinHash banding of paragraphs.

A paragraph is a sentence of a line, so a passage is cut the same way wherever it stands in a document.
Paragraphs of ``least_words`` words or more are hashed: MinHash of their five-word shingles, in ``BANDS``
bands of ``ROWS`` values, tuned so that a pair of similarity 0.8 is found with probability 0.994. Paragraphs
that collide in a band are compared by exact Jaccard similarity, except those whose words are the same;
the links make components, and in each component the first paragraph (by document, then place) stays.
Repeats in other documents than the first one's are marked; a run of marked paragraphs, with less than
``gap_words`` other words between two of them, is a repeated passage if it has ``run_words`` words or more.
Short repeated sentences alone are left in place.

Cuts at stops lose what repeats inside a sentence, or in lines of few words. So windows of ``WINDOW`` words,
whatever their punctuation, are looked up as well: of every ``CHOICE`` windows in a row the one of least hash
is chosen, so copies choose the same ones, and any ``WINDOW + CHOICE - 1`` words that two documents share hold
one. Windows that are the same in an earlier document are marked like paragraphs, up to ``CHOICE - 1`` words
at either end of a copy are not, and a changed word leaves a gap under ``gap_words`` between two windows.
Texts that similarity of 0.8 finds have 45 words or so between changes, so equal windows find their parts.
In scripts without blanks between words each character counts as a word.

Plan: windows need no bands, only a shuffle of their hashes, and another that joins them to those that repeat.
The identity of a paragraph is the hash of its words, so equal ones collapse before and in every shuffle,
however frequent. Each bucket links its members to its least member; members of different components that
still share a bucket meet by classes of size, and are compared if their sizes and parity sketches allow
similarity, which loses no link. Texts are read again for the paragraphs that must be compared, and only
these move.

Defined cases: null and empty texts have no paragraphs and stay as they are; repeated rows of one id count as
one document each at the same place, so they do not mark each other; documents with a null id are neither
marked nor kept as the first; texts of any length are read whole; texts of under ``WINDOW`` words have no
windows; a sentence of over ``LONGEST`` words is cut
there; ties go to the smaller id, then the earlier place; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.llm.components import connected
from tidegrid.llm.minhash import across, differing_bits, mixed_buckets, parities
from tidegrid.llm.shared import blocks, discard, in_python, saved
from tidegrid.llm.words import Words, mix, windows, words_of

BANDS, ROWS = 5, 2
WIDTH = 5
LONGEST = 1000
WINDOW, CHOICE = 12, 6
BLOCK_CHARS = 1 << 19
#: Up to so many documents are named by broadcast to the scan that reads texts again; beyond, by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words of 64 bits of a paragraph's parity sketch.
PARITY_WORDS = 4
#: Paragraphs that a task remembers having given the keys of, in some 10 MB.
REMEMBERED = 100_000


#: Thai to Myanmar and Khmer, kana, and Han with its extensions.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_unspaced = re.compile(f"([{_UNSPACED}])")


def spaced(text: str | None) -> str:
    """The text with blanks around every character of a script without them."""
    text = text or ""
    # In UTF-8 all of these characters start with a byte from 0xE0 on, which is quicker to look for.
    if text.isascii() or np.frombuffer(text.encode("utf-8", "replace"), np.uint8).max() < 0xE0:
        return text
    return _unspaced.sub(r" \1 ", text)


def chosen_windows(words: Words) -> np.ndarray:
    """Numbers of the first words of the windows that are looked up, in order; every one lies in one text."""
    hashes = windows(words.hashes, WINDOW)
    most = np.uint64(np.iinfo(np.uint64).max)
    # WINDOW - 1 places without a window, CHOICE - 1 at least, lie between the windows of two texts.
    hashes[words.text[: len(hashes)] != words.text[WINDOW - 1 :][: len(hashes)]] = most
    edge = np.full(CHOICE - 1, most)
    row = np.concatenate([edge, hashes, edge])
    least, at = row.copy(), np.arange(len(row))
    for k in range(1, CHOICE):
        better = row[k:] < least[: len(row) - k]
        least[: len(row) - k][better] = row[k:][better]
        at[: len(row) - k][better] = np.flatnonzero(better) + k
    chosen = np.unique(at[row[at] != most]) - len(edge)
    return chosen


def paragraphs(texts: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first word of each paragraph, and of the word after it: cut after a single . ! ? and at line ends."""
    encoded = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join([*encoded, b""]), np.uint8)
    offset = np.cumsum([0, *(len(e) + 1 for e in encoded)])[words.text]
    starts, ends = words.starts + offset, words.ends + offset
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.cumsum(data == 10)
    mark = np.isin(data, np.frombuffer(b".!?", np.uint8))
    stop = mark[ends - 1] & ~mark[np.maximum(ends - 2, 0)]
    cut = np.ones(len(starts), bool)
    cut[1:] = stop[:-1] | (lines[starts[1:]] != lines[starts[:-1]]) | (words.text[1:] != words.text[:-1])
    first = np.flatnonzero(cut)
    lengths = np.diff(np.append(first, len(starts)))
    if lengths.max() > LONGEST:
        parts = -(-lengths // LONGEST)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(first, parts) + number * LONGEST
    return first, np.append(first[1:], len(starts))


def _identities(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the sequence of words of each paragraph."""
    if not len(first):
        return np.zeros(0, np.uint64)
    place = np.arange(len(words.hashes)) - np.repeat(first, last - first)
    return mix(np.add.reduceat(mix(words.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first) + (last - first).astype(np.uint64))


def _band_keys(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """int64, paragraphs x BANDS; every paragraph has WIDTH words at least."""
    hashes = windows(words.hashes, WIDTH)
    low, high = first, last - WIDTH + 1
    # The least of a paragraph is that of two overlapping stretches of 2 ** level hashes, at either end of it.
    level = np.frexp(high - low)[1] - 1
    of_level = [np.flatnonzero(level == k) for k in range(level.max() + 1)]
    minima = np.empty((BANDS * ROWS, len(first)), np.uint64)
    for i, row in enumerate(minima):
        least = mix(hashes + np.uint64((i + 1) * 0xA0761D6478BD642F % (1 << 64)))
        for k, at in enumerate(of_level):
            row[at] = np.minimum(least[low[at]], least[high[at] - (1 << k)])
            least = np.minimum(least[: -(1 << k)], least[1 << k :])  # from every place on, of twice as many
    out = np.empty((len(first), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(first), b + 1, np.uint64)
        for row in minima[b * ROWS : (b + 1) * ROWS]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
        out[:, b] = key
    return out.view(np.int64)


def _scan(docs: DataFrame, id_col: str, text_col: str, least_words: int, what: str) -> DataFrame:
    """Paragraphs of every text. ``places``: (doc, place, words, identity); ``keys``: (identity, key) of every band.

    ``windows`` gives the chosen windows of every text in the form of ``places``, ``hashes`` (doc, identity) of them.

    A task gives the keys of a paragraph once, unless over ``REMEMBERED`` others came between.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            ids, texts = batch["id"].to_numpy(), list(map(spaced, batch["text"]))
            if len(seen) > REMEMBERED:
                seen.clear()
            for a, b in blocks([len(t or "") for t in texts], BLOCK_CHARS):
                words = words_of(texts[a:b])
                if what in ("windows", "hashes"):
                    first = chosen_windows(words)
                    text = words.text[first]
                    identity = windows(words.hashes, WINDOW)[first].view(np.int64)
                    if what == "hashes":
                        yield pd.DataFrame({"doc": ids[a:b][text], "identity": identity})
                        continue
                    yield pd.DataFrame({"doc": ids[a:b][text], "place": first - words.first[text], "words": np.full(len(first), WINDOW), "identity": identity})
                    continue
                first, last = paragraphs(texts[a:b], words)
                use = last - first >= max(least_words, WIDTH)
                identity = _identities(words, first, last).view(np.int64)
                if what == "keys":
                    if use.any():
                        keep, at = np.unique(identity[use], return_index=True)
                        new = np.array([i not in seen for i in keep.tolist()])
                        if not new.any():
                            continue
                        keep, at = keep[new], at[new]
                        seen.update(keep.tolist())
                        keys = _band_keys(words, first[use][at], last[use][at])
                        yield pd.DataFrame({"identity": np.repeat(keep, BANDS), "key": keys.reshape(-1)})
                else:
                    text = words.text[first[use]] if len(first) else np.zeros(0, int)
                    yield pd.DataFrame({"doc": ids[a:b][text], "place": first[use] - words.first[text], "words": (last - first)[use], "identity": identity[use]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    fields = {"keys": "identity long, key long", "hashes": "doc long, identity long"}
    return in_python(rows, run, fields.get(what, "doc long, place int, words int, identity long"))


def _texts(docs: DataFrame, needed: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(identity, shingles, parity) of the paragraphs in ``needed`` (identity, doc), from their documents."""
    wanted = needed.groupBy("doc").agg(F.collect_set("identity").alias("wanted"))  # at most the paragraphs of one document
    small = needed.select("doc").distinct().count() <= BROADCAST_ROWS
    ids = needed.select(F.col("doc").alias("id")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if small else ids, "id", "left_semi")
    rows = rows.join(wanted.withColumnRenamed("doc", "id"), "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(map(spaced, batch["text"]))
            for a, b in blocks([len(t or "") for t in texts], BLOCK_CHARS):
                words = words_of(texts[a:b])
                first, last = paragraphs(texts[a:b], words)
                identity = _identities(words, first, last).view(np.int64)
                out = []
                for t, wanted in enumerate(batch["wanted"][a:b]):
                    own = np.flatnonzero((words.text[first] == t) & np.isin(identity, wanted)) if len(first) else ()
                    out += [(identity[p], np.unique(windows(words.hashes[first[p] : last[p]], WIDTH)).view(np.int64)) for p in own if last[p] - first[p] >= WIDTH]
                shingles = [s.view(np.uint64) for _, s in out]
                owner = np.repeat(np.arange(len(out)), list(map(len, shingles)))
                found = pd.DataFrame(out, columns=["identity", "shingles"])
                found["parity"] = list(parities(np.concatenate(shingles), owner, np.ones(len(owner)), len(out), PARITY_WORDS)) if out else []
                yield found

    return in_python(rows, run, "identity long, shingles array<long>, parity array<long>").dropDuplicates(["identity"])


def _sets(docs: DataFrame, ends: DataFrame, places: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """``_texts`` of the paragraphs in ``ends`` (identity), each from the least document that holds it; saved."""
    small = ends.count() <= BROADCAST_ROWS
    where = places.join(F.broadcast(ends) if small else ends, "identity").groupBy("identity").agg(F.min("doc").alias("doc"))
    return saved(_texts(docs, saved(where), id_col, text_col, least_words))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    a, b = (sets.select(F.col("identity").alias(e), F.col("shingles").alias(f"s_{e}")) for e in "uv")
    common = F.size(F.array_intersect("s_u", "s_v"))
    alike = common >= threshold * (F.size("s_u") + F.size("s_v") - common)
    return saved(pairs.join(a, "u").join(b, "v").where(alike).select("u", "v"))


def repeated_paragraphs(docs: DataFrame, threshold: float = 0.8, least_words: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, place, words, class_doc, class_place) of every paragraph whose component reaches over documents.

    ``place`` counts words from the start of the document; class_doc and class_place name the first paragraph.
    """
    least_words = max(least_words, WIDTH)
    places = saved(_scan(docs, id_col, text_col, least_words, "places"))
    firsts = places.groupBy("identity").agg(F.min(F.struct("doc", "place")).alias("first"), F.max("doc").alias("last_doc"))
    firsts = firsts.select("identity", "first.doc", "first.place", "last_doc")
    keys = _scan(docs, id_col, text_col, least_words, "keys")
    bucket = Window.partitionBy("key")  # of distinct paragraphs; a task gives each of them once
    keys = keys.withColumn("v", F.min("identity").over(bucket)).withColumn("w", F.max("identity").over(bucket))
    shared = saved(keys.where("v != w").select("key", "identity", "v").distinct())
    candidates = saved(shared.where("identity != v").select(F.col("identity").alias("u"), "v").distinct())
    sets = _sets(docs, saved(shared.select("identity").distinct()), places, id_col, text_col, least_words)
    links = _verified(candidates, sets, threshold)
    label = connected(links)
    labelled = shared.join(label.withColumnRenamed("node", "identity"), "identity", "left").select("key", "identity", F.coalesce("component", "identity").alias("component"))
    open_rows = labelled.join(mixed_buckets(labelled), "key")
    open_rows = saved(open_rows.join(sets.select("identity", F.size("shingles").alias("n"), "parity"), "identity"))
    may_differ = (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    cross = across(open_rows, "identity", threshold, differing_bits(F.col("parity_a"), F.col("parity_b"), PARITY_WORDS) <= may_differ)
    cross = saved(cross.join(candidates, ["u", "v"], "left_anti"))
    if not cross.isEmpty():
        label = connected(label.union(_verified(cross, sets, threshold)))  # the components so far stand for their links
    for table in (shared, candidates, sets, open_rows, cross):
        discard(table)
    # Classes of identities that repeat over documents, by themselves or by links.
    linked = firsts.join(label.withColumnRenamed("node", "identity"), "identity", "left").withColumn("component", F.coalesce("component", "identity"))
    several = linked.groupBy("component").agg(F.min(F.struct("doc", "place")).alias("first"), F.max("last_doc").alias("last")).where("last != first.doc")
    classes = linked.join(several, "component").select("identity", F.col("first.doc").alias("class_doc"), F.col("first.place").alias("class_place"))
    return places.join(classes, "identity").select("doc", "place", "words", "class_doc", "class_place")


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, place, words, class_doc) of every chosen window that stands in several documents; class_doc is the least of these.

    Texts are read twice, first for the hashes alone, and no windows are stored; both times they meet by a shuffle,
    as those that repeat grow with the documents.
    """
    places = _scan(docs, id_col, text_col, WINDOW, "windows")
    ends = _scan(docs, id_col, text_col, WINDOW, "hashes").groupBy("identity").agg(F.min("doc").alias("class_doc"), F.max("doc").alias("last_doc"))
    classes = saved(ends.where("last_doc != class_doc").drop("last_doc"))
    return places.join(classes.hint("merge"), "identity").select("doc", "place", "words", "class_doc")


def repeated_passages(
    docs: DataFrame, threshold: float = 0.8, least_words: int = 6, run_words: int = 20, gap_words: int = 12, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, start, stop, n_words, first_doc) of every passage that repeats one of an earlier document.

    Words start..stop-1 of the document, counted from 0, are the passage; ``n_words`` of them are in marked
    paragraphs or windows. ``first_doc`` holds the first occurrence of the passage's first one.
    """
    marked = repeated_paragraphs(docs, threshold, least_words, id_col, text_col).drop("class_place").unionByName(repeated_windows(docs, id_col, text_col))
    marked = marked.where("doc != class_doc").repartition("doc")  # the one shuffle for all that follows
    marked = marked.dropDuplicates(["doc", "place", "words"]).withColumn("end", F.col("place") + F.col("words"))
    in_order = Window.partitionBy("doc").orderBy("place", "words")
    past = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    runs = marked.withColumn("past", past).withColumn("run", F.sum(F.when(F.col("place") - F.col("past") < gap_words, 0).otherwise(1)).over(in_order))
    runs = runs.withColumn("words", F.greatest(F.lit(0), F.col("end") - F.greatest("place", F.coalesce("past", "place"))))  # that no row before has
    out = runs.groupBy("doc", "run").agg(
        F.min("place").alias("start"), F.max("end").alias("stop"), F.sum("words").alias("n_words"), F.min_by("class_doc", "place").alias("first_doc")
    )
    return out.where(F.col("n_words") >= run_words).select(F.col("doc").alias(id_col), "start", "stop", "n_words", "first_doc")


_word = re.compile(rf"[{_UNSPACED}]|[^\t\n\x0b\x0c\r {_UNSPACED}]+")


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    starts = [m.start() for m in _word.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, stop in sorted(spans):
        out.append(text[at : max(at, starts[min(start, len(starts) - 1)])])
        at = max(at, starts[min(stop, len(starts) - 1)])
    return "".join([*out, text[at:]])


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the passages cut out of their texts; documents of which nothing but white space is left go.

    Other rows are passed on as they are. Passages of a document are at most its own paragraphs.
    """
    spans = passages.groupBy(id_col).agg(F.collect_list(F.struct("start", "stop")).alias("spans_")).withColumnRenamed(id_col, "cut_id_")
    columns = docs.columns
    joined = docs.join(spans, F.col(id_col) == F.col("cut_id_"), "left").drop("cut_id_")
    # Not deterministic for the optimiser's sake: it would cut once for the filter and once more for the result.
    cut = F.pandas_udf(lambda t, s: pd.Series([x if z is None else cut_out(x or "", [(y["start"], y["stop"]) for y in z]) for x, z in zip(t, s)], dtype=object), "string").asNondeterministic()
    done = joined.withColumn(text_col, cut(F.col(text_col), F.col("spans_")))
    return done.where(F.col("spans_").isNull() | (F.trim(F.regexp_replace(text_col, r"\s+", " ")) != "")).select(*columns)
