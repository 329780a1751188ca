import random

import public_tokenizers
from tokenizers import Tokenizer

from cohortloom.llm import token_counts
from cohortloom.llm.token_counts import TokenCounter, count_tokens, frequent_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = [*"abZÉßſ ½²12_'\t\n.!-–’日😀\x85\xa0\x1ćΣİªŉǅÅ", "'re", "<|endoftext|>", "<|", "don't", "THE "]


def random_texts(n, seed, letters=LETTERS):
    draw = random.Random(seed)
    return ["".join(draw.choices(letters, k=draw.randint(0, 30))) for _ in range(n)]


def test_same_as_the_library():
    library, counter = Tokenizer.from_file(PATH), TokenCounter(PATH)
    narrow = [x for x in LETTERS if token_counts._CHECKED.fullmatch(x) and "|" not in x]
    for text in random_texts(2000, 1) + random_texts(2000, 2, narrow):
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert all(counter.pre_tokens(t) is not None for t in random_texts(50, 3, narrow))


def test_every_checked_character_alone():
    library, counter = Tokenizer.from_file(PATH), TokenCounter(PATH)
    for code in range(0x250):
        for text in (chr(code), f"a{chr(code)}1", f"{chr(code)}'s "):
            assert counter(text) == len(library.encode(text, add_special_tokens=False).ids), hex(code)


def test_small_cache_gives_the_same(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 3)
    library, counter = Tokenizer.from_file(PATH), TokenCounter(PATH, {"the": 1})
    for text in random_texts(300, 5):
        assert counter(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(counter.lengths) <= 5


def test_documents(spark, awkward, nothing):
    library = Tokenizer.from_file(PATH)
    expected = sorted(
        (str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids))
        for r in awkward.collect()
    )
    rows = count_tokens(awkward, PATH).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == expected
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
    assert count_tokens(nothing, PATH).count() == 0


def test_table_holds_right_lengths(spark, awkward):
    library = Tokenizer.from_file(PATH)
    table = frequent_lengths(awkward, PATH)
    assert "licence" in table and "twice" not in table
    assert table and all(len(library.encode(p, add_special_tokens=False).ids) == n for p, n in table.items())
