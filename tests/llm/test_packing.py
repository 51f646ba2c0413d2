import random

import numpy as np
import pyarrow as pa

from etalage.llm.packing import TOKENIZER, Encoder

SIGNS = [*"aAbZ zÀÖ×÷øÿÞß'’.,!?:;|#$%&*()-\n\t 09µªİıΑΣς́e中ﬁ🙂<|>_@/~", "<|endoftext|>", "don't", "Ünï", "\r\n"]


def test_pieces_have_the_ids_of_whole_texts():
    dice = random.Random(3)
    texts = [None, "", "  ", "\n", *("".join(dice.choice(SIGNS) for _ in range(dice.randrange(60))) for _ in range(3000))]
    encoder = Encoder(TOKENIZER)
    for text, ids in zip(texts, encoder.texts(pa.array(texts)), strict=True):
        assert np.array_equal(ids, encoder.tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_a_word_is_looked_up_once_whatever_its_case_and_marks():
    encoder = Encoder(TOKENIZER)
    assert [len(ids) for ids in encoder.texts(pa.array(["Étude, étude; ÉTUDE", "ÉTUDE,étude"]))]
    assert set(encoder.known.young) == {"étude".encode(), b",", b";", "ÉTUDE,étude".encode()}
