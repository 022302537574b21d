"""Memory that task functions take."""

import random
import tracemalloc

from recordloom.llm import sampled_pieces


def test_chunk_of_the_encoder_takes_bounded_memory():
    rng = random.Random(5)
    vocabulary = sampled_pieces.Vocabulary(sampled_pieces.load_pieces(), 2e-4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    texts, size = [], 0
    while size < sampled_pieces.CHUNK_CHARS:
        texts.append(" ".join(word() for _ in range(400)))
        size += len(texts[-1])
    tracemalloc.start()
    try:
        sampled_pieces.sample_chunk(vocabulary, texts, list(range(len(texts))), 4)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 << 20
