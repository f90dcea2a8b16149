import hashlib
import itertools
import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidegrid.llm.bpe import SPLIT, Bpe, decode, encode, latin_split, round_trip
from tidegrid.llm.queries import vocabulary_path

PATH = vocabulary_path()
OURS, THEIRS = Bpe(PATH, cached=50), Tokenizer.from_file(PATH)
CASES = ["", " ", "a", "a<|endoftext|>b  <|endoftext|> c", "x  y \n\n z ", "it's I'LL we'll 123abc", "漢字 😀👍🏽", "\x1c a\x85b", "ab" * 3000]


@pytest.mark.parametrize("text", CASES)
def test_ids_and_text_equal_the_library(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == ids
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aehtnoi TH.,'s\n\t 12é%|<endoftext>"), max_size=60))
def test_any_text_equals_the_library(text):
    assert OURS.encode(text) == THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.decode(OURS.encode(text)) == text


def test_decoding_broken_sequences_equals_the_library():
    ids = OURS.encode("é漢")[:-1]
    assert OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_queries_on_frames(spark):
    rows = [(i, t, "extra") for i, t in enumerate([*CASES, None, "a"])] + [(None, "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in round_trip(docs, PATH).collect()}
    for i, text, _ in rows:
        ids = THEIRS.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r.doc_id: r.text for r in decode(encode(docs, PATH), PATH).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert round_trip(docs.limit(0), PATH).count() == 0


def test_a_task_merges_each_of_many_pieces_once():
    letters = "etaoinsrhdlucmfywgpbv"
    words = ["".join(w) for w in itertools.islice(itertools.product(letters, repeat=4), 125_000)]  # within one generation
    ours, merged = Bpe(PATH), []
    ours.merge = lambda piece, merge=ours.merge: merged.append(piece) or merge(piece)
    texts = [" " + " ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    first = [ours.encode_joined(t) for t in texts]
    assert first == [ours.encode_joined(t) for t in texts]
    assert len(merged) == len(words)
    assert ours.encode(texts[7]) == THEIRS.encode(texts[7], add_special_tokens=False).ids


def test_latin_texts_are_split_as_any_text():
    latin, any_text = re.compile(latin_split()).findall, regex.compile(SPLIT).findall
    chars = [chr(i) for i in range(256)]
    for a, b in itertools.product(chars, chars):
        text = f"x{a}{b}'s {b}{a}{a}"
        assert latin(text) == any_text(text), text
    text = "".join(chars) * 2 + "\u0100 "
    assert OURS.encode(text) == THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text[:-2]) == THEIRS.encode(text[:-2], add_special_tokens=False).ids
