"""Operator 1: near-duplicate documents by DartMinHash.

The shingles of a text are a weighted set. Hashed darts fall into the region of each element (its weight
wide, as high as the rank limit of the set); every coordinate of the signature keeps its earliest dart, so
two sets agree in a coordinate with the probability of their weighted Jaccard similarity. Bands of
coordinates that agree make two texts candidates, and the similarity of candidates is computed exactly.

Plan: equal texts are collapsed first, by digest. In every bucket of a band, each text is compared with the
bucket's most central text only, so work is linear in the bucket. Buckets that still hold texts of different
components are then searched across components. Texts meet there only within a bucket's classes of size, as
similar sets are of about the same size, and of such pairs only those are compared that can be similar:
distances of a metric differ by no more than the pair's own, so both must be about as far from the bucket's
central text, and parity sketches of their sets may differ in no more bits than the sets in elements. All
these are exact bounds, so no link between different texts is lost but by the chance that banding itself has.
Sets of shingles are made for candidates only.

Defined cases: texts without words (null, empty, white space) are in a class of their own row; texts of
fewer words than a shingle are one shingle; repeated rows are kept, each with its class; rows with a null id
take part, and the class is named by the least id that is not null; texts of any length are hashed whole;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import connected
from tidegrid.llm.shared import blocks, discard, in_python, saved
from tidegrid.llm.words import mix, shingles, words_of

#: 24 bands of 6: a pair of similarity 0.8 meets with probability 0.9993, one of 0.5 with 0.31, one of 0.3 with 0.017.
COORDINATES, BANDS = 144, 24
BLOCK_CHARS = 1 << 19
#: Up to so many candidate texts, their ids (24 bytes each) are broadcast to the scan; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Digests of texts that a task remembers having made the set of, in some 6 MB.
REMEMBERED = 50_000


def weighted_shingles(texts: list[str | None], width: int = 5, weights: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of its text, weight) of the distinct shingles of each text; weight 1, or their count."""
    hashes, text = shingles(words_of(texts), width)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(hashes)))
    return hashes[at], text[at], (np.ones(len(at)) if weights == "set" else counts.astype(float))


def dart_signatures(hashes: np.ndarray, text: np.ndarray, weights: np.ndarray, n_texts: int, k: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """(signatures uint64 of n_texts x k, which texts have any) of weighted sets.

    A region of weight w is cut into cells one wide, the last in part; darts of a cell come at exponential
    gaps of rank, drawn from hashes of element, cell and number, and so are the same in every set.
    """
    signatures = np.zeros((n_texts, k), np.uint64)
    mass = np.bincount(text, weights, n_texts)
    filled = mass > 0
    cells = np.ceil(weights).astype(np.int64)
    if len(cells) and cells.max() > 1:
        owner = np.repeat(np.arange(len(cells)), cells)
        cell = np.arange(len(owner)) - np.repeat(np.cumsum(cells) - cells, cells)
        hashes, text, part = mix(hashes[owner] + cell.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), text[owner], np.minimum(weights[owner] - cell, 1.0)
    else:
        part = weights
    hashes = mix(hashes ^ np.uint64(0x1F83D9ABFB41BD6B))
    limit = (k * np.log(k) + 2 * k) / np.maximum(mass, 1e-300)
    todo = filled.copy()
    while todo.any():
        use = todo[text]
        h, t, w, rank = hashes[use], text[use], part[use], np.zeros(int(use.sum()))
        slots, ranks, names = [], [], []
        number = 0
        while len(h):
            dart = mix(h + np.uint64((number * 0x9FB21C651E98DF25 + 1) % (1 << 64)))
            rank = rank - np.log1p((dart >> np.uint64(11)) * -(2.0**-53))
            near = rank <= limit[t]
            h, t, w, rank, dart = h[near], t[near], w[near], rank[near], dart[near]
            name = mix(dart ^ np.uint64(0xD1B54A32D192ED03))
            hit = (mix(name) >> np.uint64(11)) * 2.0**-53 <= w
            slots.append((t * k + (name % np.uint64(k)).astype(np.int64))[hit])
            ranks.append(rank[hit].astype(np.float32))
            names.append(name[hit])
            number += 1
        slot, rank32, name = np.concatenate(slots), np.concatenate(ranks), np.concatenate(names)
        order = np.argsort(slot.astype(np.uint64) << np.uint64(32) | rank32.view(np.uint32).astype(np.uint64), kind="stable")
        slot = slot[order]
        first = np.ones(len(slot), bool)
        first[1:] = slot[1:] != slot[:-1]
        signatures.reshape(-1)[slot[first]] = name[order][first]
        have = np.bincount(slot[first] // k, minlength=n_texts)
        todo &= have < k
        limit[todo] *= 2
    return signatures, filled


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """int64 of n_texts x bands."""
    n, k = signatures.shape
    rows = k // bands
    out = np.empty((n, bands), np.uint64)
    for b in range(bands):
        key = np.full(n, b + 1, np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, i])
        out[:, b] = key
    return out.view(np.int64)


#: Words of 64 bits of a parity sketch.
PARITY_WORDS = 8


def parities(hashes: np.ndarray, text: np.ndarray, weights: np.ndarray, n_texts: int, words: int = PARITY_WORDS) -> np.ndarray:
    """int64 of n_texts x words: each bit is the parity of the elements that hash to it.

    Two sketches differ in at most as many bits as their sets differ in elements. An element of weight w
    counts as floor(w) elements, so the bound holds for whole weights.
    """
    copies = weights.astype(np.int64)
    owner = np.repeat(np.arange(len(copies)), copies)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(copies) - copies, copies)
    bit = mix(hashes[owner] + number.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)) % np.uint64(64 * words)
    odd = np.bincount(text[owner] * (64 * words) + bit.astype(np.int64), minlength=n_texts * 64 * words) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n_texts, -1), axis=1).view(np.int64)


def differing_bits(a: Column, b: Column, words: int = PARITY_WORDS) -> Column:
    return sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(1, words)), F.bit_count(a[0].bitwiseXOR(b[0])))


def _digest(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8", "replace"), usedforsecurity=False).digest()


def _text_digest(text_col: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int, weights: str) -> DataFrame:
    """(id, digest, n shingles or their mass, band keys) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["id"], batch["text"].tolist()
            for a, b in blocks([len(t or "") for t in texts], BLOCK_CHARS):
                h, t, w = weighted_shingles(texts[a:b], width, weights)
                signatures, filled = dart_signatures(h, t, w, b - a)
                keys = band_keys(signatures)
                yield pd.DataFrame({"id": ids[a:b], "digest": [_digest(x) for x in texts[a:b]], "n": np.bincount(t, w, b - a), "keys": [k if f else None for k, f in zip(keys, filled)]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return in_python(rows, run, "id long, digest binary, n double, keys array<long>")


def _sets(docs: DataFrame, needed: DataFrame, text_col: str, width: int, weights: str) -> DataFrame:
    """(digest, shingles, their weights, parity) of the texts in ``needed`` (digest), one row each."""
    rows = docs.select(_text_digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    small = needed.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(needed) if small else needed, "digest", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            for digest, text in zip(batch["digest"], batch["text"]):
                if digest in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(digest)
                h, t, w = weighted_shingles([text], width, weights)
                yield pd.DataFrame({"digest": [digest], "shingles": [h.view(np.int64)], "weights": [None if weights == "set" else w], "parity": list(parities(h, t, w, 1))})

    return in_python(rows, run, "digest binary, shingles array<long>, weights array<double>, parity array<long>").dropDuplicates(["digest"])


def _similarity(weights: str):
    if weights == "set":
        common = F.size(F.array_intersect("a.shingles", "b.shingles"))
        return common / (F.size("a.shingles") + F.size("b.shingles") - common)
    left, right = (F.map_from_arrays(f"{x}.shingles", f"{x}.weights") for x in "ab")
    low = F.aggregate(F.map_values(F.map_zip_with(left, right, lambda _, x, y: F.coalesce(F.least(x, y) * F.when(x.isNotNull() & y.isNotNull(), 1.0), F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)
    mass = F.aggregate("a.weights", F.lit(0.0), lambda s, x: s + x) + F.aggregate("b.weights", F.lit(0.0), lambda s, x: s + x)
    return low / (mass - low)


def _compared(pairs: DataFrame, sets: DataFrame, weights: str) -> DataFrame:
    """(u, v, similarity), exact, of ``pairs``, written to the shared folder."""
    with_a = pairs.join(sets.select(F.col("digest").alias("u"), F.struct("shingles", "weights").alias("a")), "u")
    both = with_a.join(sets.select(F.col("digest").alias("v"), F.struct("shingles", "weights").alias("b")), "v")
    return saved(both.select("u", "v", _similarity(weights).alias("similarity")))


def mixed_buckets(labelled: DataFrame) -> DataFrame:
    """(key, major) of buckets with texts of several components; ``major`` is the one with the most of them.

    Pairs across components have an end outside the major one, so a large component is never paired with itself.
    """
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("size"))
    out = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("major"), F.count("*").alias("components"))
    return out.where("components > 1").select("key", "major")


def size_class(n: Column, threshold: float) -> Column:
    """Number of the class of sizes: sets as similar as ``threshold`` are in the same class or in neighbouring ones."""
    return F.floor(F.log(F.greatest(n, F.lit(1e-9))) / (math.log(1 / threshold) * (1 + 1e-9)) if threshold < 1 else n)


def across(open_rows: DataFrame, name: str, threshold: float, can_be: Column) -> DataFrame:
    """Distinct (u, v) of rows of one key in different components that ``can_be`` similar, u > v by ``name``.

    ``open_rows`` have key, major, component, n, ``name`` and what ``can_be`` compares, with endings _a and _b.
    Rows of the major component are paired with others only, and all only with rows of about their size.
    """
    classed = open_rows.withColumn("class", size_class(F.col("n"), threshold))
    a, b = (classed.select("key", "class", "major", *(F.col(c).alias(f"{c}_{x}") for c in open_rows.columns if c not in ("key", "major"))) for x in "ab")
    a = a.where("component_a != major").withColumn("class", F.explode(F.array(*(F.col("class") + d for d in (-1, 0, 1)))))
    alike_size = F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    met = a.drop("major").join(b.drop("major"), ["key", "class"]).where((F.col("component_a") != F.col("component_b")) & alike_size & can_be)
    return met.select(F.greatest(f"{name}_a", f"{name}_b").alias("u"), F.least(f"{name}_a", f"{name}_b").alias("v")).distinct()


def _classified(docs: DataFrame, threshold: float, width: int, weights: str, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, digest, has_words) of every row, and (digest, component, id, copies) of every text with words; both saved."""
    signed = saved(_signed(docs, id_col, text_col, width, weights))
    texts = saved(signed.where("keys IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("keys").alias("keys")))
    rows = texts.select("digest", F.explode("keys").alias("key"))
    several = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = rows.join(several, "key")
    # The centre of a bucket is the text that meets most others over all its buckets: copies are nearest to it.
    meets = members.groupBy("digest").agg(F.sum("size").alias("meets"))
    members = saved(members.join(meets, "digest").select("key", "digest", "meets"))
    centres = members.groupBy("key").agg(F.max(F.struct("meets", "digest")).alias("centre")).select("key", F.col("centre.digest").alias("v"))
    with_meets, members = members, saved(members.drop("meets").join(centres, "key"))
    discard(with_meets)
    candidates = saved(members.where("digest != v").select(F.col("digest").alias("u"), "v").distinct())
    needed = saved(members.select("digest").distinct())
    sets = saved(_sets(docs, needed, text_col, width, weights))
    compared = _compared(candidates, sets, weights)
    links = compared.where(F.col("similarity") >= threshold).select("u", "v")
    label = connected(links)
    # Across the components that still share a bucket: every pair that can be similar and was not compared yet.
    labelled = members.join(label.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    to_centre = compared.withColumnRenamed("u", "digest")
    open_rows = labelled.join(mixed_buckets(labelled), "key").join(to_centre, ["digest", "v"], "left")
    open_rows = open_rows.withColumn("similarity", F.when(F.col("digest") == F.col("v"), 1.0).otherwise(F.col("similarity"))).drop("v")
    open_rows = saved(open_rows.join(texts.select("digest", "n"), "digest").join(sets.select("digest", "parity"), "digest"))
    may_differ = (F.col("n_a") + F.col("n_b")) * ((1 - threshold) / (1 + threshold)) + 1e-9
    can_be = (F.abs(F.col("similarity_a") - F.col("similarity_b")) <= 1 - threshold + 1e-9) & (differing_bits(F.col("parity_a"), F.col("parity_b")) <= may_differ)
    cross = saved(across(open_rows, "digest", threshold, can_be).join(candidates, ["u", "v"], "left_anti"))
    if not cross.isEmpty():
        more = _compared(cross, sets, weights).where(F.col("similarity") >= threshold).select("u", "v")
        label = connected(label.union(more))  # the components so far stand for the links they are made of
    of_text = texts.join(label.withColumnRenamed("node", "digest"), "digest", "left")
    of_text = saved(of_text.select("digest", F.coalesce("component", "digest").alias("component"), "id", "copies"))
    rows = saved(signed.select("id", "digest", F.col("keys").isNotNull().alias("has_words")))
    for table in (signed, texts, members, candidates, needed, sets, compared, open_rows, cross):
        discard(table)
    return rows, of_text


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, weights: str = "set", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, class_id, class_size) of every row: near copies, also by way of others, have the same class.

    The class is named by its least id; its size counts rows.
    """
    signed, of_text = _classified(docs, threshold, width, weights, id_col, text_col)
    classes = of_text.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = of_text.join(classes, "component").select("digest", "class_id", "class_size")
    with_words = signed.where("has_words").join(named, "digest").select("id", "class_id", "class_size")
    alone = signed.where("NOT has_words").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return with_words.union(alone).withColumnRenamed("id", id_col)


def deduplicated(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, weights: str = "set", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row of each class of near copies, with all columns; rows whose texts have no words all stay.

    The row of the least id stays, by the digest of its text where rows share that id; a class whose ids are
    all null is kept by a row, too. Of rows equal in id and text any one stays.
    """
    signed, of_text = _classified(docs, threshold, width, weights, id_col, text_col)
    first = of_text.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "digest")).alias("first"))
    keepers = saved(first.select("first.no_id", "first.id", "first.digest"))
    repeated = signed.where("has_words").groupBy("id", "digest").agg(F.count("*").alias("rows")).where("rows > 1")
    own = F.col(id_col).cast("long")
    columns = [f"c{i}_" for i in range(len(docs.columns))]
    named = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, columns)), own.isNull().alias("no_id"), F.coalesce(own, F.lit(0)).alias("id"), _text_digest(text_col).alias("digest"))
    # Texts without words have no class: what lower case and trimming leave of them is white space.
    wordless = F.rtrim(F.coalesce(F.col(columns[docs.columns.index(text_col)]), F.lit("")), F.lit(" \t\n\x0b\f\r")) == ""
    kept = named.where(~wordless).join(keepers, ["no_id", "id", "digest"], "left_semi")
    if not repeated.isEmpty():
        kept = kept.dropDuplicates(["no_id", "id", "digest"])
    return kept.unionByName(named.where(wordless)).select(*(F.col(n).alias(c) for c, n in zip(docs.columns, columns)))
