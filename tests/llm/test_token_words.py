"""Words that need no split rule get the library's ids all the same."""

import random

from loomspark.llm import queries, token_files

SIGNS = ["a", "B", "ze", " ", " ", ",", ".", "'s", "'", "é", "ß", "1", "\n", "\t", "<", "<|endoftext|>", "我", "-", "\x1c", "\xa0"]


def test_words_with_and_without_marks_equal_the_library():
    encoder = token_files.PieceEncoder(queries.tokenizer_path("byte_bpe_50k.json"))
    chance = random.Random(1)
    texts = ["", " ", ".", ",", " .", "a,", "a.", "a.,", "word, word. word"] + ["".join(chance.choices(SIGNS, k=chance.randint(1, 12))) for _ in range(3000)]
    got = [list(memoryview(ids).cast("I"))[:-1] for ids in encoder.encode_batch(texts)]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoder.simple
